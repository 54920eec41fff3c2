"""Quality rules kept as a bitmask ledger.

``ledger`` measures every text once and evaluates every rule once: one row per
document with the measurements and ``fail_bits``, bit i being set if rule i
failed.  A policy is a versioned bit mask, so that ``apply_policy`` and
``ablation`` need no text again: a document is kept if ``fail_bits & mask`` is
0, and what a rule alone rejects has that one bit left in ``fail_bits & mask``.

Null and empty texts have no words: all measurements are 0 and only the
``few_words`` rule fails.  Repeated rows are measured alike; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import Batch, small_batches, window_hashes

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: Words of one window of the repetition measure.
WINDOW = 3

#: The measurements, all of them counts.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_digits")

#: Rule names by bit, and when each fails; whole numbers only, so that no rounding decides.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("upper_case", "100 * n_upper > 30 * n_letters"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("digits", "100 * n_digits > 40 * word_chars"),
    ("long_words", "word_chars > 25 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("one_line", "n_lines < 2"),
)

_BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(*rules: str) -> int:
    return sum(_BIT[r] for r in rules)


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int


BASE = Policy("base", mask("few_words", "repeated_words"))
#: Policies by version; a new version is a new entry, never a changed one.
POLICIES: tuple[Policy, ...] = (
    BASE,
    Policy("v1", BASE.mask | mask("symbols", "upper_case", "duplicate_lines", "digits", "long_words", "short_words")),
    Policy("v2-strict", (1 << len(RULES)) - 1),
)
DEFAULT = POLICIES[1]


def _table(chosen: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chosen)] = 1
    return out


_UPPER = _table(bytes(range(65, 91)))
_LETTER = _UPPER + _table(bytes(range(97, 123)))
_DIGIT = _table(b"0123456789")
_SYMBOL = _table(SYMBOLS)
_POINT = np.ones(256, dtype=np.int64)  # bytes that begin a code point outside white space
_POINT[[*range(0x80, 0xC0), 0x20, *range(9, 14)]] = 0


def measure(batch: Batch) -> dict[str, np.ndarray]:
    """The measurements of every row of the batch."""
    parts: dict[str, list[np.ndarray]] = {m: [] for m in MEASURES}
    for a, b in batch.pieces():
        data, _, _, words, first = batch.words(a, b)
        bounds = batch.offsets[a : b + 1] - batch.offsets[a]
        n = b - a

        def total(weights: np.ndarray, data: np.ndarray = data, bounds: np.ndarray = bounds) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(weights[data])))
            return sums[bounds[1:]] - sums[bounds[:-1]]

        lines, copies, repeated = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(n):
            found = [x for x in data[bounds[i] : bounds[i + 1]].tobytes().split(b"\n") if x.strip()]
            lines[i], copies[i] = len(found), len(found) - len(set(found))
            windows = window_hashes(words[first[i] : first[i + 1]], WINDOW)
            if len(windows) > 1:
                _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
                twice = count[which] > 1
                if twice.any():
                    covered = np.zeros(len(windows) + WINDOW - 1, dtype=bool)
                    for k in range(WINDOW):
                        covered[k : k + len(windows)] |= twice
                    repeated[i] = covered.sum()
        for name, value in (
            ("n_words", np.diff(first)), ("word_chars", total(_POINT)), ("n_symbols", total(_SYMBOL)), ("n_lines", lines),
            ("n_dup_lines", copies), ("n_repeat_words", repeated), ("n_letters", total(_LETTER)), ("n_upper", total(_UPPER)), ("n_digits", total(_DIGIT)),
        ):
            parts[name].append(value)
    return {m: np.concatenate(v) if v else np.zeros(0, np.int64) for m, v in parts.items()}


def ledger(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, measurements, fail_bits): every rule evaluated once for every row."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(Batch(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[m], pa.int64()) for m in MEASURES)], names=[key, *MEASURES])

    kind = df.schema[key].dataType.simpleString()
    measured = df.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " + ".join(f"cast({rule} as bigint) * {1 << i}L" for i, (_, rule) in enumerate(RULES))
    return measured.withColumn("fail_bits", F.expr(bits))


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(kept: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ledger with base_failed, kept and policy_version."""
    return kept.withColumns({"base_failed": ~passes(BASE), "kept": passes(BASE) & passes(policy), "policy_version": F.lit(policy.version)})


def ablation(kept: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """(policy_version, rule, n_docs, n_kept, n_failed, n_only, n_kept_without) from the bits alone.

    Documents are first counted by ``fail_bits``, which has at most
    2^len(RULES) values however many documents there are; n_only counts those
    that this rule alone rejects, and n_kept_without what stays without it.
    """
    counts = kept.groupBy("fail_bits").agg(F.count("*").alias("n"))
    per = [
        (p.version, p.mask, name, 1 << i) for p in policies for i, (name, _) in enumerate(RULES) if p.mask & (1 << i)
    ]
    rules = F.explode(F.array(*(F.struct(F.lit(v).alias("policy_version"), F.lit(m).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for v, m, r, b in per)))
    rows = counts.select("fail_bits", "n", rules.alias("r")).select("fail_bits", "n", "r.*").withColumn("hit", F.expr("fail_bits & mask"))
    total = lambda cond: F.sum(F.expr(f"case when {cond} then n else 0 end"))
    return rows.groupBy("policy_version", "rule").agg(
        F.sum("n").alias("n_docs"), total("hit = 0").alias("n_kept"), total("(hit & bit) <> 0").alias("n_failed"),
        total("hit = bit").alias("n_only"), total("(hit & ~bit) = 0").alias("n_kept_without"),
    )
