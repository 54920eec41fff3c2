"""Fuzzy removal of repeated lines.

1. A line is normalised: lower case, runs of anything but letters and digits
   become one space.  Lines with equal normal forms are one class.
2. Pairs of which the longer form has at most SHORT characters are found without loss:
   it is cut into one segment more than the edits that it may have, so one segment
   stands unchanged in the other form, near its place (``places``).
3. All other pairs meet in a grid: lines fall into bands by length, so wide that a pair is of
   one band or of two neighbours, bands into parts of PART lines at most, and a cell of the grid
   is two parts.  In a cell each line is cut into segments that are rare among the cell's lines and do
   not overlap, so an edit spoils one at most.  A shorter line that lacks more of them, near their
   places, than the edits are is no pair; of the others, the edits of their first two fifths
   may not be more than those of the whole.  No pair of the threshold fails either test.
4. Lines of one component, as far as the cell knows, are not compared again, and only links
   leave a cell, so that a group of near copies is no square of rows.  Cells are taken in rounds, so
   that what is shuffled at a time grows with the texts.  The number of cells and of pairs is not so:
   the work grows with the square of the number of different lines.
5. A pair is verified: edit distance of the normal forms at most (100 - percent) % of
   the longer one, in characters, or in words if it has more than LONG characters.
6. Of each connected group of classes one occurrence stays: the first by key,
   then by line number.  Texts are rebuilt without the others.

Lines are described and pairs verified in Arrow batches; all that shuffles is DataFrame work.

Lines without a letter or digit always stay.  Null texts stay null.  A row is known by
its key and its text: rows that share a key and differ in text are documents of their
own, equal rows are one.  Null keys are a key like others.  Two normal forms of equal
64-bit hashes are told apart by a second one; the later form is then left alone.
Extra columns pass through, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import CHUNK_BYTES, Scratch, connected_components, mix, small_batches

PERCENT = 80
#: Characters of the longer normal form up to which pairs are found without loss.
SHORT = 32
#: Characters beyond which edits are counted in words.
LONG = 2_000
#: Lines of a cell that share one table of segments; each longer line is compared with all of them at once.
CENTRES = 1024
#: Longer lines that are looked up together.
LOOKED_UP = 128
#: Lines and characters of one part of the grid.
PART, PART_CHARS = 32_768, 12_000_000
#: Letters of a segment.
SEGMENTS = (2, 3, 4, 5, 6)
#: Letters whose segments are counted, to tell rare ones, and those that are cut into segments at a time.
COUNTED, CUT = 1 << 21, 1 << 20
#: Letters of the longer lines whose segments are held at a time, whatever the size of the cell.
SLAB = 6_000_000
#: Bits of the hash by which segments are counted.
COUNT_BITS = 20
#: Standard deviations that a pair of unlike lines is to stay beyond its edits; more segments of a line are not looked up.
BEYOND = 7
#: Bytes of the table of segments, and its least number of rows: segments and places are told apart by so many hashes.
TABLE, HASHES = 1 << 26, 1 << 16
#: Letters beyond which lines are cut into so many blocks.
WHOLE, BLOCKS = 900, 8
#: Times the texts that one round of cells may shuffle.
ROUND = 2
#: Pairs of a cell that are verified at a time.
WAITING = 8192
PACKED_WORDS = 65_535

_LANES = 0x0001000100010001


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _identity(df: DataFrame, text: str, key: str) -> Column:
    return F.struct(df[key].alias("key"), F.xxhash64(df[text]).alias("text"))


# -- lines of a batch -----------------------------------------------------------

_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    if not _TABLES:
        _TABLES["letter"] = np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)], dtype=bool)
    return _TABLES["letter"]


class Lines:
    """The lines with a letter or digit of some texts: their normal forms."""

    def __init__(self, texts: list[str | None]) -> None:
        parts = [f"{t or ''}\n".lower().encode("utf-32-le", "replace") for t in texts]
        points = np.frombuffer(b"".join(parts), dtype=np.uint32)
        letter = _letters()[points]
        before = np.concatenate(([False], letter[:-1]))
        ends = points == 10
        kept = letter | ends | (before & ~letter)
        flat = np.where(letter, points, np.where(ends, np.uint32(10), np.uint32(32)))[kept]
        all_lines = [x.rstrip(" ") for x in flat.astype("<u4").tobytes().decode("utf-32-le").split("\n")[:-1]]
        bounds = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)))
        first = np.searchsorted(np.flatnonzero(ends), bounds[:-1])  # the first line of each text
        held = np.flatnonzero([bool(x) for x in all_lines])
        self.norms = [all_lines[i] for i in held]
        self.text = np.searchsorted(first, held, side="right") - 1
        self.line_no = (held - first[self.text]).astype(np.int32)
        digests = [xxhash.xxh3_128_intdigest(x.encode()) for x in self.norms]
        mask = (1 << 64) - 1
        self.node = np.array([d & mask for d in digests], dtype=np.uint64).view(np.int64)
        self.other = np.array([d >> 64 for d in digests], dtype=np.uint64).view(np.int64)
        self.chars = np.array([len(x) for x in self.norms], dtype=np.int32)


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(texts):
        b, size = a + 1, len(texts[a] or "")
        while b < len(texts) and size + len(texts[b] or "") < CHUNK_BYTES // 2:
            size += len(texts[b] or "")
            b += 1
        yield a, b
        a = b


_LINE = "line_no int, node long, other long"


def describe(df: DataFrame, text: str, key: str, norms: bool = False) -> DataFrame:
    """(doc, line_no, node, other) of all lines with a letter or digit, with chars, or norm in its place.

    node and other are the halves of a 128-bit hash of the normal form.
    """
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in _pieces(texts):
                told = Lines(texts[a:b])
                own = [batch.column(c).take(pa.array(told.text + a)) for c in (0, 1)]
                base = [*own, pa.array(told.line_no), pa.array(told.node), pa.array(told.other)]
                new = pa.array(told.norms, pa.string()) if norms else pa.array(told.chars)
                yield pa.RecordBatch.from_arrays([*base, new], names=["k", "h", "line_no", "node", "other", "norm" if norms else "chars"])

    more = "norm string" if norms else "chars int"
    rows = df.select(df[key].alias("k"), F.xxhash64(df[text]).alias("h"), df[text].alias("t")).where("t is not null").mapInArrow(run, f"k {kind}, h long, {_LINE}, {more}")
    return rows.select(F.struct(F.col("k").alias("key"), F.col("h").alias("text")).alias("doc"), *rows.columns[2:])


def simhash(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, fp) of (keys, h, packed): bit i of fp is set if it is set in more than half of the h of the keys.

    ``packed`` is the same for all rows of a key: true promises PACKED_WORDS rows at most.
    """
    lane = lambda s: F.shiftrightunsigned("h", s).bitwiseAND(F.lit(_LANES).cast("long"))
    short = words.where("packed").groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(lane(s)).alias(f"c{s}") for s in range(16)))
    power = lambda i: F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")
    zero = F.lit(0).cast("long")
    fp = zero
    for s in range(16):
        for k in range(4):
            count = F.shiftrightunsigned(f"c{s}", 16 * k).bitwiseAND(F.lit(0xFFFF))
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("n"), power(s + 16 * k)).otherwise(zero))
    one = lambda i: F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1).cast("long"))
    long_ = words.where("not packed").groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(one(i)).alias(f"b{i}") for i in range(64)))
    wide = zero
    for i in range(64):
        wide = wide.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("n"), power(i)).otherwise(zero))
    return short.select(*keys, fp.alias("fp")).unionByName(long_.select(*keys, wide.alias("fp")))


# -- candidates ---------------------------------------------------------------


def places(percent: int, longest: int = SHORT) -> list[tuple[int, int, int, int, int, bool]]:
    """(length of a line, length of the longer of the pair, segment, start, size, whether the line is the longer).

    The longer line has edits + 1 segments.  The shorter one holds an unchanged
    one at a start that leaves room for the edits before and after it.
    """
    out = []
    for n in range(1, longest + 1):
        edits = (100 - percent) * n // 100
        size, more = divmod(n, edits + 1)
        start = 0
        for i in range(edits + 1 if edits and size else 0):
            own = size + (i > edits - more)
            out.append((n, n, i, start, own, True))
            for short in range(n - edits, n + 1):
                low = max(start - i, start + short - n - (edits - i), 0)
                high = min(start + i, start + short - n + (edits - i), short - own)
                out += [(short, n, i, at, own, False) for at in range(low, high + 1)]
            start += own
    return out


def short_links(scratch: Scratch, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Distinct links (u, v) between (node, norm) of at most SHORT characters; a pair is verified where it meets."""
    plan = scratch.spark.createDataFrame(places(percent), "len int, longer int, segment int, start int, size int, whole boolean")
    cut = texts.withColumn("len", F.length("norm")).where(f"len <= {SHORT}").join(F.broadcast(plan), "len")
    cut = scratch.keep(cut.select("node", "norm", "whole", F.xxhash64("longer", "segment", F.expr("substring(norm, start + 1, size)")).alias("h")).distinct())
    left = cut.where("whole").select(F.col("node").alias("u"), F.col("norm").alias("tu"), "h")
    right = cut.where("not whole").select(F.col("node").alias("v"), F.col("norm").alias("tv"), F.col("h").alias("g"))
    most = F.floor(F.greatest(F.length("tu"), F.length("tv")) * (100 - percent) / 100).cast("int")
    pairs = left.join(right, (F.col("h") == F.col("g")) & (F.col("u") != F.col("v")) & (F.levenshtein("tu", "tv") <= most))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


# -- verification -------------------------------------------------------------


def distance(a, b) -> int:  # noqa: ANN001
    """Edit distance of two sequences, all of a column at once as the bits of integers."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    places_of: dict = {}
    for i, x in enumerate(a):
        places_of[x] = places_of.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, out = full, 0, len(a)
    for x in b:
        same = places_of.get(x, 0)
        level = (((same & up) + up) ^ up) | same | down
        more, less = down | (full & ~(level | up)), up & level
        out += bool(more & top) - bool(less & top)
        more = (more << 1 | 1) & full
        less = less << 1 & full
        up, down = less | (full & ~((same | down) | more)), more & (same | down)
    return out


def distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Edit distances of many pairs of texts side by side, 64 places of a column to a word of bits."""
    out = np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    lo = 0
    while lo < len(order):
        # about as many words of bits in each step, whatever the lengths
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * (len(pairs[order[hi]][0]) // 64 + 1) <= 8192:
            hi += 1
        part = order[lo:hi]
        out[part] = _columns([pairs[i][0] for i in part], [pairs[i][1] for i in part])
        lo = hi
    return out


def _columns(left: list[str], right: list[str]) -> np.ndarray:
    g = len(left)
    m, n = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    if not m.all():  # nothing but insertions
        out = n.copy()
        some = np.flatnonzero(m)
        if len(some):
            out[some] = _columns([left[i] for i in some], [right[i] for i in some])
        return out
    points = np.frombuffer("".join([*left, *right]).encode("utf-32-le", "replace"), dtype=np.uint32)
    letters, ids = np.unique(points, return_inverse=True)
    own, words = np.repeat(np.arange(g), m), int(m.max() + 63) // 64
    at = np.arange(len(own)) - np.repeat(np.cumsum(m) - m, m)
    places_of = np.zeros(((len(letters) + 1) * g, words), np.uint64)
    np.bitwise_or.at(places_of, (ids[: len(own)] * g + own, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    text = np.full((int(n.max()), g), len(letters))
    other = np.repeat(np.arange(g), n)
    text[np.arange(len(other)) - np.repeat(np.cumsum(n) - n, n), other] = ids[len(own) :]
    one, top = np.uint64(1), np.uint64(63)
    up, down, out = np.full((words, g), ~np.uint64(0)), np.zeros((words, g), np.uint64), m.copy()
    last, bit = (m - 1) // 64, ((m - 1) % 64).astype(np.uint64)
    ends = [np.flatnonzero(last == w) for w in range(words)]
    for j in range(len(text)):
        same_all = places_of[text[j] * g + np.arange(g)]
        more_in, less_in = np.ones(g, np.uint64), np.zeros(g, np.uint64)
        for w in range(words):
            same, u, d = same_all[:, w], up[w], down[w]
            cross = same | d
            same = same | less_in
            level = (((same & u) + u) ^ u) | same
            more, less = d | ~(level | u), u & level
            k = ends[w]
            if len(k):
                k = k[j < n[k]]
                out[k] += ((more[k] >> bit[k]) & one).astype(np.int64) - ((less[k] >> bit[k]) & one).astype(np.int64)
            carry = more >> top, less >> top
            more, less = (more << one) | more_in, (less << one) | less_in
            up[w], down[w] = less | ~(cross | more), more & cross
            more_in, less_in = carry
    return out


def _settled(a: str, b: str, percent: int) -> bool | tuple[str, str, int]:
    """Whether two normal forms are alike, or the texts whose distance decides it, and its limit.

    Only what is between their common first and last words is compared.  What few
    edited words can cost at most may settle it before letters are looked at.
    """
    longest = max(len(a), len(b))
    most = longest * (100 - percent) // 100
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.split(" "), b.split(" ")
    words = max(len(x), len(y))
    p = 0
    while p < min(len(x), len(y)) and x[p] == y[p]:
        p += 1
    q = 0
    while q < min(len(x), len(y)) - p and x[-1 - q] == y[-1 - q]:
        q += 1
    x, y = x[p : len(x) - q], y[p : len(y) - q]
    if longest > LONG:
        return distance(x, y) <= words * (100 - percent) // 100
    if len(x) == len(y) and sum(max(len(v), len(w)) for v, w in zip(x, y, strict=True) if v != w) <= most:
        return True
    return "".join(w + " " for w in x), "".join(w + " " for w in y), most


def alike(pairs: Iterable[tuple[str, str]], percent: int = PERCENT) -> np.ndarray:
    """Whether the edit distance of each two normal forms is at most (100 - percent) % of the longer, in words if it has more than LONG characters."""
    told = [_settled(a, b, percent) for a, b in pairs]
    out = np.array([x is True for x in told], dtype=bool)
    left = [i for i, x in enumerate(told) if isinstance(x, tuple)]
    out[left] = distances([told[i][:2] for i in left]) <= np.array([told[i][2] for i in left], dtype=np.int64)
    return out


# -- the grid -------------------------------------------------------------------


def _keys(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hash of the segment of that size that begins at each letter); at the end of ``codes`` zeros follow."""
    more = np.concatenate([codes, np.zeros((SEGMENTS[-1], *codes.shape[1:]), codes.dtype)]).astype(np.uint32)
    key = np.zeros(codes.shape, np.uint32)
    for size in range(1, SEGMENTS[-1] + 1):
        key = key * np.uint32(0x01000193) + more[size - 1 : size - 1 + len(codes)] + np.uint32(1)
        if size in SEGMENTS:
            out = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield size, (out ^ (out >> np.uint32(13))) * np.uint32(0xC2B2AE35)


def _row(key: np.ndarray, bin_: np.ndarray, hashes: int) -> np.ndarray:
    out = (key ^ bin_.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)
    return ((out ^ (out >> np.uint32(16))) & np.uint32(hashes - 1)).astype(np.int64)


class Cell:
    """The lines of a cell in the order of their lengths, and what is known of their components."""

    def __init__(self, norms: list[str], percent: int) -> None:
        self.norms, self.percent = norms, percent
        self.chars = np.array([len(x) for x in norms], dtype=np.int64)
        self.start = np.cumsum(self.chars) - self.chars
        known = np.zeros(0x110000, bool)
        for _, points in self._points():
            known[points] = True
        self.letters = int(known.sum())
        code = (np.cumsum(known) - 1).astype(np.uint16 if self.letters < 1 << 16 else np.uint32)
        self.codes = np.empty(int(self.chars.sum()), code.dtype)
        for at, points in self._points():
            self.codes[at : at + len(points)] = code[points]
        self.share: np.ndarray | None = None
        self.label = np.arange(len(norms))
        self.links: list[tuple[int, int]] = []
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = 0

    def _points(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the first, code points) of some lines after others, about CUT letters at a time."""
        for lo, hi in self._slabs(np.arange(len(self.norms)), CUT):
            yield int(self.start[lo]), np.frombuffer("".join(self.norms[lo:hi]).encode("utf-32-le", "replace"), dtype=np.uint32)

    def _slabs(self, lines: np.ndarray, letters: int) -> list[tuple[int, int]]:
        """Ranges of the lines of so many letters at most, or of one line."""
        ends = np.cumsum(self.chars[lines])
        cuts = [0]
        while cuts[-1] < len(lines):
            before = int(ends[cuts[-1] - 1]) if cuts[-1] else 0
            cuts.append(max(int(np.searchsorted(ends, before + letters, side="right")), cuts[-1] + 1))
        return list(zip(cuts, cuts[1:]))

    def edits(self, size: np.ndarray) -> np.ndarray:
        return size * (100 - self.percent) // 100

    def _letters(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, place, which of the lines) of each letter."""
        count = self.chars[lines]
        own = np.repeat(np.arange(len(lines)), count)
        place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        return self.codes[self.start[lines][own] + place], place, own

    def _count(self) -> None:
        """Share of the places of the cell's lines, or of some of them, at which each hash of a segment begins."""
        some = np.arange(0, len(self.norms), int(self.chars.sum()) // COUNTED + 1)
        codes, place, own = self._letters(some)
        room = self.chars[some][own] - place
        count = np.zeros(1 << COUNT_BITS, np.int64)
        for size, key in _keys(codes):
            count += np.bincount(key[room >= size] >> np.uint32(32 - COUNT_BITS), minlength=len(count))
        self.share = count / max(len(codes), 1)

    def cut(self, lines: np.ndarray, reach: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segments, keys, middles) of blocks of lines: how many, their hashes, twice how far behind the line's middle theirs is.

        The segments of a line do not overlap, so an edit spoils one at most.  Of all cuts, that one is taken which
        leaves most of them without their like in ``reach`` letters of an unlike line, by their shares; the rarest come first.
        """
        size, most = self.chars[lines], self.edits(self.chars[lines])
        chance = np.power(1 - self.share, 6 * (reach + 1)).astype(np.float32)
        top, n = int(size.max()), len(lines)
        inside = np.arange(top)[:, None] < size
        codes = self.codes[np.where(inside, self.start[lines] + np.arange(top)[:, None], 0)]
        keys, worth = {}, {}
        for k, key in _keys(codes):
            keys[k] = key
            worth[k] = chance[key >> np.uint32(32 - COUNT_BITS)]
            worth[k][np.arange(top)[:, None] + k > size] = -1
        best, taken = np.zeros((top + 1, n), np.float32), np.zeros((top + 1, n), np.uint8)
        for end in range(1, top + 1):
            now = best[end - 1].copy()
            for k in SEGMENTS:
                if k <= end:
                    value = best[end - k] + worth[k][end - k]
                    np.copyto(taken[end], k, where=value > now)
                    np.maximum(now, value, out=now)
            best[end] = now
        at = np.full(n, top)
        for end in range(top, 0, -1):
            here = at == end
            taken[end] *= here
            at -= here * np.maximum(taken[end], 1)
        which, end = np.nonzero(taken.T)
        length = taken[end, which]
        key, value = np.zeros(len(which), np.uint32), np.zeros(len(which), np.float32)
        for k in SEGMENTS:
            of = np.flatnonzero(length == k)
            key[of], value[of] = keys[k][end[of] - k, which[of]], worth[k][end[of] - k, which[of]]
        place = 2 * end - length - size[which]
        row = which * blocks + (end - 1) * blocks // size[which]
        order = np.lexsort((-value, row))
        row = row[order]
        count = np.bincount(row, minlength=n * blocks)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        wide = int(count.max(initial=1))
        out, middle, hoped = np.zeros((n * blocks, wide), np.uint32), np.zeros((n * blocks, wide), np.int32), np.zeros((n * blocks, wide))
        out[row, rank], middle[row, rank], hoped[row, rank] = key[order], place[order], value[order]
        if blocks == 1:
            score = (np.cumsum(hoped, axis=1) - most[:, None]) / np.sqrt(np.cumsum(hoped * (1 - hoped), axis=1) + 0.5)
            score[np.arange(wide) >= count[:, None]] = -np.inf
            enough = score >= BEYOND
            count = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, count)
        shape = n, blocks, wide
        return count.reshape(n, blocks), out.reshape(shape), middle.reshape(shape)

    def compare(self, x: np.ndarray, y: np.ndarray) -> None:
        """Links of each of x with each of y that comes after it: lines, in order."""
        y = y[self.chars[y] > SHORT]
        middle = int(np.searchsorted(self.chars[y], LONG, side="right"))
        for lo, hi in self._slabs(y[:middle], SLAB):
            self._by_letters(x, y[lo:hi])
        for lo in range(middle, len(y), CENTRES):
            tile = y[lo : lo + CENTRES]
            low = self.chars[tile[0]] - self.edits(self.chars[tile[0]])
            self._by_words(x[(self.chars[x] >= low) & (x < tile[-1])], tile)
        self._settle()

    def _by_letters(self, x: np.ndarray, y: np.ndarray) -> None:
        """Of a pair within the edits, all segments of y but as many as the edits stand in x.

        They are as far from the middle of x as from that of y, but for half of the edits: what the lines
        shift against each other before a segment and behind it are edits, and so is what they differ in length.
        Lines of more than WHOLE letters are cut into blocks: with at most ``spare`` edits in a block, it shifts by
        no more than these, so its segments are looked for in narrow windows, one of which holds all that are left.
        """
        if len(x):
            y = y[(y > x[0]) & (self.chars[y] - self.edits(self.chars[y]) <= self.chars[x[-1]])]
        if not len(x) or not len(y):
            return
        if self.share is None:
            self._count()
        most = self.edits(self.chars[y])
        limit = int(most.max())
        blocks = BLOCKS if self.chars[y[-1]] > WHOLE else 1
        spare = -(-7 * limit // (5 * blocks)) if blocks > 1 else limit
        reach = min(2 * spare, limit) if blocks > 1 else limit
        windows = [2 * k * spare + reach - limit for k in range(max(-(-(limit - spare) // max(spare, 1)), 1))]
        step = np.searchsorted(np.cumsum(self.chars[y]), np.arange(CUT, int(self.chars[y].sum()) + CUT, CUT), side="right").tolist()
        cuts = [self.cut(y[lo:hi], min(reach, int(np.median(most[lo:hi]))), blocks) for lo, hi in zip([0, *step[:-1]], step, strict=True) if hi > lo]
        size = np.concatenate([c[0] for c in cuts])
        bin_ = max(reach, 1)
        wanted = np.zeros(1 << COUNT_BITS, bool)
        hashes = HASHES << max(int(self.chars[y[-1]] - 1) // 300, 0).bit_length()
        rows = np.full((len(windows), len(y), blocks, int(size.max())), hashes, np.int32)
        lo = 0
        for count, keys, middle in cuts:
            counts = np.arange(keys.shape[2]) < count[:, :, None]
            wanted[keys[counts] >> np.uint32(32 - COUNT_BITS)] = True
            wide = min(keys.shape[2], rows.shape[3])
            for k, centre in enumerate(windows):
                rows[k, lo : lo + len(count), :, :wide] = np.where(counts, _row(keys, (middle - centre) // bin_, hashes), hashes)[:, :, :wide]
            lo += len(count)
        centres = min(CENTRES, TABLE // hashes)
        held = np.zeros((hashes + 1, -(-min(len(x), centres) // 8) * 8), np.uint8)
        for lo in range(0, len(x), centres):
            tile = x[lo : lo + centres]
            begin = int(np.searchsorted(y, tile[0], side="right"))
            end = int(np.searchsorted(self.chars[y] - most, self.chars[tile[-1]], side="right"))
            if begin < end:
                self._hold(held, tile, wanted, reach, bin_)
                for at in range(begin, end, LOOKED_UP):
                    to = min(at + LOOKED_UP, end)
                    self._look_up(held, tile, y[at:to], rows[:, at:to], size[at:to], most[at:to], spare)

    def _hold(self, held: np.ndarray, tile: np.ndarray, wanted: np.ndarray, reach: int, bin_: int) -> None:
        """Mark the segments of the tile's lines, each at all places within reach."""
        held.fill(0)
        codes, place, own = self._letters(tile)
        flat = held.reshape(-1)
        for k, key in _keys(codes):
            of = np.flatnonzero(wanted[key >> np.uint32(32 - COUNT_BITS)] & (place + k <= self.chars[tile][own]))
            key, who = key[of], own[of]
            middle = 2 * place[of] + k - self.chars[tile][who]
            first, last = (middle - reach) // bin_, (middle + reach) // bin_
            for b in range(int((last - first).max(initial=-1)) + 1):
                flat[_row(key, np.minimum(first + b, last), len(held) - 1) * held.shape[1] + who] = 1

    def _look_up(self, held: np.ndarray, tile: np.ndarray, y: np.ndarray, rows: np.ndarray, size: np.ndarray, most: np.ndarray, spare: int) -> None:
        spoilt = np.zeros((len(y), held.shape[1]), np.int16)
        for block in range(size.shape[1]):
            found = self._found(held, rows[:, :, block], int(size[:, block].max()))
            if size.shape[1] == 1 and found.dtype == np.uint8:
                good = found >= np.maximum(size - most[:, None], 0)
                break
            spoilt += np.minimum(size[:, block, None] - found.astype(np.int16), spare + 1).astype(np.int16)
        else:
            good = spoilt <= most[:, None]
        i, j = np.divmod(np.flatnonzero(good), held.shape[1])
        i, j = i[j < len(tile)], j[j < len(tile)]
        far = (tile[j] < y[i]) & (self.chars[y[i]] - self.chars[tile[j]] <= most[i])
        self._wait(tile[j[far]], y[i[far]])

    def _found(self, held: np.ndarray, rows: np.ndarray, wide: int) -> np.ndarray:
        """How many segments of each line each line of the tile holds, in the window that has most of them."""
        words, best = held.view(np.uint64), None
        got = np.empty((rows.shape[1], words.shape[1]), np.uint64)
        for window in rows:
            total = np.zeros((len(got), held.shape[1]), np.uint16) if wide > 255 else None
            for lo in range(0, wide, 255):  # as many as a byte counts
                count = np.zeros_like(got)
                for k in range(lo, min(lo + 255, wide)):
                    count += words.take(window[:, k], axis=0, out=got, mode="clip")
                if total is not None:
                    total += count.view(np.uint8)
            count = count.view(np.uint8) if total is None else total
            best = count if best is None else np.maximum(best, count, out=best)
        return best

    def _by_words(self, x: np.ndarray, y: np.ndarray) -> None:
        """The words that x shares with y are as many as the edits leave, counted in words."""
        held = np.zeros((HASHES, len(y)), bool)
        row, own = self._words(y)
        held[row, own] = True
        count = np.bincount(own, minlength=len(y))
        least, longest = count - self.edits(count), self.edits(self.chars[y])
        row, own = self._words(x)
        bound = np.searchsorted(own, np.arange(len(x) + 1))
        for i, line in enumerate(x):
            mine = row[bound[i] : bound[i + 1]]
            need = np.maximum(least, len(mine) - self.edits(np.array(len(mine))))
            other = y[(np.add.reduce(held[mine], axis=0, dtype=np.int32) >= need) & (y > line) & (self.chars[y] - self.chars[line] <= longest)]
            self._wait(np.full(len(other), line), other)

    def _words(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, which of the lines) of each word."""
        words = [self.norms[i].split(" ") for i in lines]
        flat = np.array([xxhash.xxh3_64_intdigest(w.encode()) & (HASHES - 1) for x in words for w in x], dtype=np.int64)
        return flat, np.repeat(np.arange(len(lines)), [len(x) for x in words])

    def _wait(self, x: np.ndarray, y: np.ndarray) -> None:
        for lo in range(0, len(x), WAITING):
            a, b = x[lo : lo + WAITING], y[lo : lo + WAITING]
            open_ = self.label[a] != self.label[b]
            if open_.any():
                self.waiting.append((a[open_], b[open_]))
                self.count += int(open_.sum())
                if self.count >= WAITING:
                    self._settle()

    def _settle(self) -> None:
        if not self.waiting:
            return
        x, y = (np.concatenate([w[k] for w in self.waiting]) for k in (0, 1))
        self.waiting.clear()
        self.count = 0
        open_ = self.label[x] != self.label[y]
        x, y = x[open_], y[open_]
        near = self.chars[y] > LONG  # those are counted in words
        words = (self._first(x) + 63) // 64
        for w in np.unique(words[~near]).tolist():
            of = np.flatnonzero(~near & (words == w))
            # a table of places has a row for each letter and x
            step = max((4 << 20) // (self.letters * w), 1)
            run = np.cumsum(np.diff(x[of], prepend=-1) != 0)
            for lo in range(1, int(run[-1]) + 1, step):
                some = of[(run >= lo) & (run < lo + step)]
                near[some] = self.plausible(x[some], y[some], w)
        x, y = x[near], y[near]
        for a, b, good in zip(x.tolist(), y.tolist(), alike([(self.norms[a], self.norms[b]) for a, b in zip(x, y)], self.percent), strict=True):
            if good and self.label[a] != self.label[b]:
                self.links.append((a, b))
                self.label[self.label == self.label[b]] = self.label[a]

    def _first(self, x: np.ndarray) -> np.ndarray:
        """Letters of the first two fifths, or what fills the last word of bits."""
        return np.minimum(-(-2 * self.chars[x] // 320) * 64, self.chars[x])

    def plausible(self, x: np.ndarray, y: np.ndarray, words: int) -> np.ndarray:
        """Whether the first two fifths of x, and as much of y and what y is longer by, are within the edits of the whole.

        Where the cheapest alignment leaves the part of x, it has still to make up for its shift, so the part costs
        no more than the whole.  The bits of a column are counted as in ``_columns``, in so many words for all pairs;
        pairs that cannot end within the edits leave early.
        """
        out = np.zeros(len(x), bool)
        own, which = np.unique(x, return_inverse=True)
        rows = self._first(own)
        of = np.repeat(np.arange(len(own)), rows)
        at = np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
        places_of = np.zeros((words, len(own) * self.letters), np.uint64)
        np.bitwise_or.at(places_of, (at // 64, of * self.letters + self.codes[self.start[own][of] + at]), np.uint64(1) << (at % 64).astype(np.uint64))
        cost, base, limit = rows[which], which * self.letters, self.edits(self.chars[y])
        n, begin, back = cost + self.chars[y] - self.chars[x], self.start[y], np.arange(len(x))
        one, top, last = np.uint64(1), np.uint64(63), ((cost - 1) % 64).astype(np.uint64)
        up, down = np.full((words, len(x)), ~np.uint64(0)), np.zeros((words, len(x)), np.uint64)
        j, ending = 0, int(n.min(initial=0))
        while len(back):
            letter = base + self.codes[begin + j]
            more_in, less_in = one, np.uint64(0)
            for w in range(words):
                same, u, d = places_of[w][letter], up[w], down[w]
                cross = same | d
                same |= less_in
                level = same & u
                level += u
                level ^= u
                level |= same
                more, less = d | ~(level | u), u & level
                if w == words - 1:
                    cost += ((more >> last) & one).astype(np.int64) - ((less >> last) & one).astype(np.int64)
                carry = more >> top, less >> top
                more <<= one
                more |= more_in
                less <<= one
                less |= less_in
                np.bitwise_and(more, cross, out=d)
                cross |= more
                np.bitwise_or(less, ~cross, out=u)
                more_in, less_in = carry
            j += 1
            if j == ending or j % 16 == 0:
                done = n == j
                out[back[done & (cost <= limit)]] = True
                going = np.flatnonzero(~done & (cost - (n - j) <= limit))
                if len(going) < len(back):
                    base, limit, n, begin, back, cost, last, up, down = base[going], limit[going], n[going], begin[going], back[going], cost[going], last[going], up[:, going], down[:, going]
                ending = int(n.min()) if len(n) else 0
        return out


def near_links(scratch: Scratch, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) between (node, norm, chars) of which the longer one has more than SHORT characters: of their components, none is left out.

    A line is shuffled once for each cell that it is in, so cells are taken in rounds that shuffle about ROUND times the texts.
    """
    edges = [SHORT * percent // 100]
    while edges[-1] < 1 << 31:
        edges.append(max(-(-edges[-1] * 100 // max(percent, 1)), edges[-1] * 21 // 20 + 1))
    band = F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in edges)), lambda e: e <= F.col("chars")))
    rows = texts.where(f"100 * chars >= {SHORT * percent}").withColumn("band", band)
    size = F.greatest(F.count("*") / PART, F.sum("chars") / PART_CHARS)
    parts = scratch.keep(rows.groupBy("band").agg(F.ceil(size).cast("int").alias("parts"), F.sum("chars").alias("chars")))  # as many rows as there are bands
    each = parts.select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left = each.select(F.col("band").alias("a"), F.col("part").alias("i"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("b"))
    cells = left.join(each.select(F.col("band").alias("b"), F.col("part").alias("j")), "b").where("a < b or i <= j").select("a", "i", "b", "j")
    # characters of all cells, and of all lines
    own = parts.select(F.col("band").alias("a"), (F.col("chars") / F.col("parts")).alias("left"))
    other = parts.select(F.col("band").alias("b"), (F.col("chars") / F.col("parts")).alias("right"))
    told = cells.join(own, "a").join(other, "b").agg(F.count("*").alias("cells"), F.sum(F.col("left") + F.col("right")).alias("chars")).first()
    every = parts.agg(F.sum("chars").alias("chars")).first()
    rounds = max(-(-int(told["chars"] or 0) // (ROUND * int(every["chars"] or 0) + 1)), 1)
    cells = scratch.keep(cells.withColumn("round", F.pmod(F.xxhash64("a", "i", "b", "j"), F.lit(rounds))))
    rows = rows.join(F.broadcast(parts.select("band", "parts")), "band").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("band", "part", "node", "norm")

    def run(rows: pa.Table) -> pa.Table:
        order = np.lexsort((rows.column("node").to_numpy(), pc.utf8_length(rows.column("norm")).to_numpy()))
        rows = rows.take(pa.array(order))
        node, second = rows.column("node").to_numpy(), rows.column("second").to_numpy()
        cell = Cell(rows.column("norm").to_pylist(), percent)
        if second.any():
            cell.compare(np.flatnonzero(~second), np.flatnonzero(second))
            cell.compare(np.flatnonzero(second), np.flatnonzero(~second))
        else:
            cell.compare(np.arange(len(node)), np.arange(len(node)))
        u, v = np.array(cell.links, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"u": node[u], "v": node[v]})

    columns, found = ["a", "i", "b", "j", "second", "node", "norm"], []
    for r in range(rounds):
        now = cells.where(F.col("round") == r)
        first = rows.join(F.broadcast(now), (F.col("band") == F.col("a")) & (F.col("part") == F.col("i"))).withColumn("second", F.lit(False))
        second = rows.join(F.broadcast(now.where("a < b or i < j")), (F.col("band") == F.col("b")) & (F.col("part") == F.col("j"))).withColumn("second", F.lit(True))
        dealt = first.select(columns).unionByName(second.select(columns)).repartition(max(2 * int(told["cells"]) // rounds, 1), "a", "i", "b", "j")
        found.append(scratch.keep(dealt.groupBy("a", "i", "b", "j").applyInArrow(run, "u long, v long")))
        scratch.release()
    return reduce(DataFrame.unionByName, found)


# -- groups -------------------------------------------------------------------


def groups(scratch: Scratch, df: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(lines, classes): all lines (doc, line_no, node, other), and (node, other, keep_doc, keep_no, n, component) of the classes that are repeated or linked."""
    lines = scratch.keep(describe(df, text, key))
    first = lines.groupBy("node").agg(F.min(F.struct("other", "doc", "line_no")).alias("first"), F.count("*").alias("n"))
    first = scratch.keep(first.select("node", "first.*", "n"))
    texts = describe(df, text, key, norms=True).join(first.select("node", "other", "doc", "line_no"), ["node", "other", "doc", "line_no"], "left_semi")
    texts = scratch.keep(texts.select("node", "norm", F.length("norm").alias("chars")).dropDuplicates(["node"]))
    scratch.release()
    links = scratch.keep(short_links(scratch, texts, percent))
    scratch.release()
    links = links.unionByName(near_links(scratch, texts, percent))
    component = connected_components(scratch, links)
    named = first.join(component, "node", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "node"))
    named = scratch.keep(named)
    kept = named.groupBy("component").agg(F.min(F.struct("doc", "line_no")).alias("keep"))
    return lines.select("doc", "line_no", "node", "other"), named.join(kept, "component").select("node", "other", F.col("keep.doc").alias("keep_doc"), F.col("keep.line_no").alias("keep_no"), "n", "component")


def dropped_lines(scratch: Scratch, df: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(doc, dropped) of the rows that lose lines; doc is the row's key and hash, dropped has the lines' numbers, from 0."""
    lines, found = groups(scratch, df, text, key, percent)
    gone = lines.join(found, ["node", "other"]).where("not (doc = keep_doc and line_no = keep_no)")
    return gone.groupBy("doc").agg(F.collect_set("line_no").alias("dropped"))


def without_lines(df: DataFrame, gone: DataFrame, text: str = "text", key: str = "doc_id", count: str | None = None) -> DataFrame:
    """All columns and rows of ``df``, the text without the lines of (doc, dropped); ``count`` names a column for their number."""
    # the split stays below the join: inside the lambda it would be taken anew for every line
    parts = df.withColumn("__doc", _identity(df, text, key)).withColumn("__lines", F.split(F.col(text), "\n"))
    parts = parts.join(gone.select(F.col("doc").alias("__gone"), F.col("dropped").alias("__dropped")), F.col("__doc") == F.col("__gone"), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__dropped")
    cut = F.array_join(F.transform(left, lambda i: F.col("__lines")[i]), "\n")
    whole = F.col("__dropped").isNull() | F.col(text).isNull()
    told = [F.coalesce(F.size("__dropped"), F.lit(0)).alias(count)] if count else []
    return parts.withColumn(text, F.when(whole, F.col(text)).otherwise(cut)).select(*df.columns, *told)
