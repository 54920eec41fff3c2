"""Language identification by interpolated Kneser-Ney character models.

Training counts the character 4-grams of every learned text per language, in
parallel and pre-aggregated; lower orders follow from the distinct higher ones,
as Kneser-Ney asks.  The model is one sorted array of 64-bit n-gram keys for
each order with a matrix of log probabilities, a column per language, so that
one binary search serves all languages.

Texts are lower-cased; letters and marks stay, any run of other characters
becomes one boundary.  Of each character 16 bits are kept, so that a 4-gram is
exactly one 64-bit key (letters beyond U+FFFF share keys).

A text's language has the lowest cross-entropy per character.  ``score`` is the
posterior of that language under equal priors, with the difference in nats
divided by a temperature fitted on all learned texts.  ``rejected`` is true if
the text has no letter, or if its cross-entropy is above the limit of its
language and length class that calibration found, by a margin that errs towards
keeping.  Where calibration saw too little there is no limit (``limits_of``).

The size bound of the broadcast model: at most ``MAX_LANGUAGES`` columns and
``MAX_GRAMS`` 4-grams of each language, the most frequent ones by a threshold on
counts taken from a histogram; rarer 4-grams are scored by their back-off.

Null texts and texts without a letter: ``und``, score 0, rejected.  Rows
without a language are not learned; with no learnable row at all, every text
is ``und``.  Ties go to the language first in order of name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import CHUNK_BYTES, Scratch, small_batches

UNKNOWN = "und"
ORDER = 4
MAX_LANGUAGES = 256
MAX_GRAMS = 100_000
#: Length classes, and the temperatures that calibration tries.
CLASSES = 9
TEMPERATURES = np.geomspace(0.05, 5, 25)
#: Standard deviations above the mean entropy beyond which a learned text is itself an outlier.
FAR = 6
#: A model of fewer learned texts knows them by heart: their entropies say nothing about others.
LEAST_TEXTS = 100

_B = 16  # bits of a character in a key


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: 16 bits of itself in lower case if a letter or mark, else 0; and whether it is a letter."""
    kept, letter = np.zeros(0x110000, dtype=np.uint16), np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            own = ord(low) if len(low) == 1 else c
            kept[c] = own if own < 1 << 16 else own & 0xFFFF | 1
            letter[c] = kind == "L"
    return kept, letter


_CLASS: tuple[np.ndarray, np.ndarray] | None = None


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4-gram key of every letter or mark, first key of each text and the total, letters of each text).

    Letters are the characters of the category L of all planes.  The three characters before a text's
    first are boundaries, and each run of letters ends with one boundary.
    """
    global _CLASS
    if _CLASS is None:
        _CLASS = _classes()
    parts = [t.encode("utf-32-le", "replace") for t in texts]
    points = np.frombuffer(b"".join(x for p in parts for x in (p, b"\0\0\0\0")), dtype=np.uint32)
    bounds = np.concatenate(([0], np.cumsum([len(p) // 4 + 1 for p in parts], dtype=np.int64)))
    chars = _CLASS[0][points]
    letters = chars > 0
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # a text ends with its separator, which is no letter
    kept = np.concatenate(([0], np.cumsum(keep)))
    first = kept[bounds]
    total = np.concatenate(([0], np.cumsum(_CLASS[1][points])))
    n_letters = total[bounds[1:]] - total[bounds[:-1]]
    packed = chars[keep].astype(np.uint64)
    n = len(packed)
    key = packed.copy()
    at = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    for back in range(1, min(ORDER, n)):
        earlier = np.where(at[back:] >= back, packed[:-back], np.uint64(0))
        key[back:] |= earlier << np.uint64(_B * back)
    return key, first, n_letters


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(texts):
        b, size = a + 1, len(texts[a])
        while b < len(texts) and size + len(texts[b]) < CHUNK_BYTES:
            size += len(texts[b])
            b += 1
        yield a, b
        a = b


def count_grams(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, key, n) of all 4-grams of all rows with a language; partly summed in each task."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def fold(name: str) -> None:
            keys = np.concatenate([k for k, _ in held[name]])
            counts = np.concatenate([c for _, c in held[name]])
            keys, which = np.unique(keys, return_inverse=True)
            held[name] = [(keys, np.bincount(which, weights=counts).astype(np.int64))]

        def flush() -> Iterator[pa.RecordBatch]:
            for name in list(held):
                fold(name)
                (keys, counts), = held.pop(name)
                for i in range(0, len(keys), 100_000):
                    k, c = keys[i : i + 100_000], counts[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c)], names=["lang", "key", "n"])

        for batch in batches:
            names = np.asarray(batch.column(1).to_pylist(), dtype=object)
            texts = batch.column(0).to_pylist()
            for name in set(names):
                own = [texts[i] for i in np.flatnonzero(names == name)]
                for a, b in _pieces(own):
                    key, _, _ = keys_of(own[a:b])
                    keys, counts = np.unique(key, return_counts=True)
                    held.setdefault(name, []).append((keys, counts))
                    size += len(keys)
                if len(held.get(name, ())) > 8:
                    fold(name)
            if size > 20_000_000 and sum(len(k) for v in held.values() for k, _ in v) > 2_000_000:
                yield from flush()
                size = 0
        yield from flush()

    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang)
    return rows.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted keys of each order, 1 to ORDER, and log probabilities by key and language.

    For order k, ``logp[k]`` has the interpolated log probability of seen
    n-grams, ``back[k]`` the log of the weight that a context of k characters
    gives to the next lower order.
    """

    languages: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    back: list[np.ndarray]
    floor: float
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def per_key(self, key: np.ndarray) -> np.ndarray:
        """Log probability of each key's last character given the three before, a column per language."""
        return self._lookup(key, ORDER)

    def _lookup(self, key: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.full((len(key), len(self.languages)), self.floor, dtype=np.float32)
        own = key & np.uint64((1 << (_B * order)) - 1)
        table = self.keys[order]
        at = np.searchsorted(table, own)
        at[at == len(table)] = 0
        hit = table[at] == own if len(table) else np.zeros(len(own), bool)
        out = self.logp[order][at] if len(table) else np.zeros((len(own), len(self.languages)), np.float32)
        missing = np.flatnonzero(~hit)
        if len(missing):
            lower = self._lookup(own[missing], order - 1)
            if order > 1:
                context = own[missing] >> np.uint64(_B)
                held = self.contexts[order]
                where = np.searchsorted(held, context)
                where[where == len(held)] = 0
                lower = lower + np.where((held[where] == context)[:, None], self.back[order][where], np.float32(0))
            out[missing] = lower
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per character of each text and language, letters of each text)."""
        key, first, letters = keys_of(texts)
        rows = self.per_key(key)
        sums = np.zeros((len(key) + 1, len(self.languages)))
        np.cumsum(rows, axis=0, dtype=np.float64, out=sums[1:])
        length = np.maximum(np.diff(first), 1)[:, None]
        return -(sums[first[1:]] - sums[first[:-1]]) / length, letters

    def judge(self, entropy: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, score, rejected) of each text."""
        if not len(letters) or not self.languages:
            return np.full(len(letters), -1), np.zeros(len(letters)), np.ones(len(letters), bool)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        gap = (entropy - low[:, None]) * np.sqrt(np.maximum(letters, 1))[:, None] / self.temperature
        score = 1.0 / np.exp(-gap).sum(axis=1)
        limit = np.inf if self.limits is None else self.limits[best, length_class(letters)]
        none = letters == 0
        return np.where(none, -1, best), np.where(none, 0.0, score), none | (low > limit)


def length_class(letters: np.ndarray) -> np.ndarray:
    """0 for up to 15 letters, then one class for every doubling, up to 8."""
    return np.clip(np.log2(np.maximum(letters, 1)).astype(np.int64) - 3, 0, CLASSES - 1)


def build(counted: DataFrame, max_grams: int = MAX_GRAMS) -> Model:
    """The model of (lang, key, n).  Only the bounded tables of the docstring reach the driver."""
    # the lowest count that keeps at most max_grams of a language, from a histogram of rounded-down counts
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = counted.groupBy("lang", step.alias("step")).agg(F.count("*").alias("size"), F.min("n").alias("low")).collect()
    languages = sorted({r["lang"] for r in sizes})
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    least: dict[str, int] = {}
    for name in languages:
        total, least[name] = 0, 1 << 62
        for r in sorted((r for r in sizes if r["lang"] == name), key=lambda r: -r["step"]):
            total += r["size"]
            if total > max_grams:
                break
            least[name] = r["low"]
    if not languages:
        return Model([], *([np.zeros(0, np.uint64)] * (ORDER + 1) for _ in range(4)), floor=0.0)
    chosen = F.create_map(*(F.lit(x) for name in languages for x in (name, least[name])))
    rows = counted.where(F.col("n") >= chosen[F.col("lang")]).toArrow()
    name_of = np.asarray(rows.column("lang").to_pylist(), dtype=object)
    key_of = rows.column("key").to_numpy().view(np.uint64)
    n_of = rows.column("n").to_numpy().astype(np.float64)
    per: list[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
    alphabet = 1 + len(np.unique(key_of & np.uint64(0xFFFF)))
    floor = -float(np.log(alphabet))
    for name in languages:
        own = name_of == name
        order = np.argsort(key_of[own])
        per.append(_kneser_ney(key_of[own][order], n_of[own][order], floor))
    keys, logp, contexts, back = ([np.zeros(0, np.uint64)] for _ in range(4))
    for k in range(1, ORDER + 1):
        all_keys = np.unique(np.concatenate([p[k][0] for p in per]))
        all_contexts = np.unique(np.concatenate([p[k][2] for p in per]))
        keys.append(all_keys)
        contexts.append(all_contexts)
        logp.append(np.full((len(all_keys), len(languages)), np.nan, dtype=np.float32))
        back.append(np.zeros((len(all_contexts), len(languages)), dtype=np.float32))
        for j, p in enumerate(per):
            logp[k][np.searchsorted(all_keys, p[k][0]), j] = p[k][1]
            back[k][np.searchsorted(all_contexts, p[k][2]), j] = p[k][3]
    model = Model(languages, keys, logp, contexts, back, floor)
    # what one language has not seen is its back-off, worked out once, from low orders up
    for k in range(1, ORDER + 1):
        gap = np.isnan(logp[k])
        at = np.flatnonzero(gap.any(axis=1))
        if len(at):
            low = model._lookup(keys[k][at], k - 1)
            if k > 1:
                low = low + back[k][np.searchsorted(contexts[k], keys[k][at] >> np.uint64(_B))]
            logp[k][at] = np.where(gap[at], low, logp[k][at])
    return model


def _kneser_ney(keys: np.ndarray, counts: np.ndarray, floor: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By order: n-gram keys, their log probabilities, contexts, and the logs of the contexts' back-off weights."""
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = {ORDER: (keys, counts)}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before
        low, n = np.unique(grams[k + 1][0] & np.uint64((1 << (_B * k)) - 1), return_counts=True)
        grams[k] = (low, n.astype(np.float64))
    out: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
    below: np.ndarray | None = None
    for k in range(1, ORDER + 1):
        key, n = grams[k]
        context, where = np.unique(key >> np.uint64(_B), return_inverse=True)
        total = np.bincount(where, weights=n)
        kinds = np.bincount(where)
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = once / (once + 2 * twice) if once else 0.5
        discount = min(max(discount, 0.1), 0.9)
        weight = discount * kinds / total
        if below is None:
            lower = np.full(len(key), np.exp(floor))
        else:
            short = key & np.uint64((1 << (_B * (k - 1))) - 1)
            lower = below[np.searchsorted(grams[k - 1][0], short)]
        p = np.maximum(n - discount, 0) / total[where] + weight[where] * lower
        below = p
        out[k] = (key, np.log(p), context, np.log(weight))
    return out


def limits_of(highest: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Rejection limits of (language, length class) from the highest ordinary cross-entropies found and the number of texts.

    A limit is the highest value of the class plus half a nat, and never below
    that of a longer class or of all languages together.  A class without a text
    takes the limit of the next shorter one that has some; there is no limit
    below the shortest of those, nor for languages of fewer than LEAST_TEXTS texts.
    """
    def rows(high: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.maximum.accumulate(np.where(n > 0, high, -np.inf)[:, ::-1], axis=1)[:, ::-1]
        last = np.maximum.accumulate(np.where(n > 0, np.arange(CLASSES), -1), axis=1)
        return np.where(last < 0, np.inf, np.take_along_axis(out, np.maximum(last, 0), axis=1)) + 0.5

    shared = rows(np.where(texts > 0, highest, -np.inf).max(axis=0, keepdims=True), texts.sum(axis=0, keepdims=True))
    few = texts.sum(axis=1, keepdims=True) < LEAST_TEXTS
    return np.where(few, np.inf, np.maximum(rows(highest, texts), shared))


def calibrate(model: Model, learn: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Set the temperature, the one of TEMPERATURES with the least log loss, and the rejection limits from all rows of ``learn``.

    Each task sends one row for each language and length class that it has seen.
    """
    shared = learn.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: i for i, name in enumerate(shared.value.languages)}
        cells = len(number) * CLASSES
        high, n, loss = np.full(cells, -np.inf), np.zeros(cells, np.int64), np.zeros((cells, len(TEMPERATURES)))
        s1, s2 = np.zeros(cells), np.zeros(cells)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            truths = np.array([number.get(x, -1) for x in batch.column(1).to_pylist()], dtype=np.int64)
            for a, b in _pieces(texts):
                entropy, letters = shared.value.entropies(texts[a:b])
                use = (letters > 0) & (truths[a:b] >= 0)
                entropy, letters, truth = entropy[use], letters[use], truths[a:b][use]
                cell, own = truth * CLASSES + length_class(letters), np.arange(len(truth))
                np.maximum.at(high, cell, entropy[own, truth])
                np.add.at(n, cell, 1)
                np.add.at(s1, cell, entropy[own, truth])
                np.add.at(s2, cell, entropy[own, truth] ** 2)
                gap = (entropy - entropy.min(axis=1, keepdims=True)) * np.sqrt(letters)[:, None]
                for i, t in enumerate(TEMPERATURES):
                    np.add.at(loss[:, i], cell, np.log(np.exp(-gap / t).sum(axis=1)) + gap[own, truth] / t)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(high[seen]), pa.array(n[seen]), pa.array(s1[seen]), pa.array(s2[seen]), *(pa.array(loss[seen, i]) for i in range(len(TEMPERATURES)))], names=["cell", "high", "n", "s1", "s2", *(f"t{i}" for i in range(len(TEMPERATURES)))])

    small_batches(learn.sparkSession)
    rows = learn.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang)
    names = [f"t{i}" for i in range(len(TEMPERATURES))]
    told = rows.mapInArrow(run, "cell long, high double, n long, s1 double, s2 double, " + ", ".join(f"{x} double" for x in names))
    found = told.groupBy("cell").agg(F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), *(F.sum(x).alias(x) for x in names)).collect()
    shape = (len(model.languages), CLASSES)
    highest, texts = np.full(shape, -np.inf), np.zeros(shape, np.int64)
    for r in found:
        mean = r["s1"] / r["n"]
        spread = max(r["s2"] / r["n"] - mean**2, 0.0) ** 0.5
        # one text of another language or of noise must not lift the limit for all
        highest.flat[r["cell"]], texts.flat[r["cell"]] = min(r["high"], mean + FAR * spread), r["n"]
    if found:
        model.temperature = float(TEMPERATURES[np.argmin([sum(r[x] for r in found) for x in names])])
        model.limits = limits_of(highest, texts)
    return model


def fit(learn: DataFrame, text: str = "text", lang: str = "lang", max_grams: int = MAX_GRAMS) -> Model:
    """Count all rows of ``learn``, then calibrate on all of them."""
    scratch = Scratch(learn.sparkSession)
    try:
        model = build(scratch.keep(count_grams(learn, text, lang)), max_grams)
    finally:
        scratch.drop()
    return calibrate(model, learn, text, lang) if model.languages else model


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``df`` besides lang_pred, score and rejected, which are added anew."""
    spark: SparkSession = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    own = [c for c in df.columns if c not in ("lang_pred", "score", "rejected")]
    place = own.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.asarray([*shared.value.languages, UNKNOWN], dtype=object)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            found = []
            for a, b in _pieces(texts):
                if shared.value.languages:
                    found.append(shared.value.judge(*shared.value.entropies(texts[a:b])))
                else:
                    found.append((np.full(b - a, -1), np.zeros(b - a), np.ones(b - a, bool)))
            if not found:
                found.append((np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)))
            which, score, rejected = (np.concatenate(x) for x in zip(*found, strict=True))
            new = [pa.array(names[which], pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = df.select(*own).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return df.select(*own).mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")


def not_held_out(key: str = "doc_id") -> F.Column:
    """True for documents that may be learned from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2
