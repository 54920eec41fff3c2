"""HMAC-SHA256 from sha2, for keys that the driver holds."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Lower-case hex of HMAC-SHA256 over the UTF-8 bytes of a text."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in key)
    outer = bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)
