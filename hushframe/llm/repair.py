"""Repair of conversation structure: cheapest edits to role sequences ``(s?(ua)+)?``.

A conversation's rows are taken by turn (nulls first), then role and text.  The first fault of a
row counts: ``blank`` (no character but white space), ``duplicate`` (role and text seen earlier
in the conversation), ``truncated`` (its last such character ends no sentence).  Edits: Keep,
Rerole to user or assistant, Delete (the only one for blank and duplicate rows), Insert an empty
row of user or assistant.  The initials of the edits in order are the audit; of equally cheap
ones the least in ASCII is taken.

The costs of one row are a min-plus matrix over the four states of the role pattern, so those of
a run of equal rows are a power of it.  Rows are sorted into ranges, so that one conversation
may lie in many of them; each range of a conversation is one *segment*:

1. equal consecutive role / fault symbols of a segment collapse into runs, and the segment
   into the product of the cached binary powers of its runs' matrices;
2. from the last segment of a conversation back to the first, the costs to go;
3. segment by segment, in any order, the choices for each state in which it may be entered;
4. from the first segment on, the state that is entered, and so the edits.

Steps 2 and 4 pass one row for each range that a conversation lies in.  Nothing collects a
conversation but the audit of the result, one letter for each edit.

Null roles and texts count as one space; rows of a null conversation are a conversation.  The
order of the rows of one turn is that of role and text; rows that are equal in all of it are
duplicates but for the first.  A conversation all of whose rows are marked ``dropped`` has no
rows: zeros and an empty audit.  An empty table gives no conversations.  Columns beyond the
four named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import Scratch, small_batches

#: The price of each edit, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: More than any repair costs.
NEVER = 1 << 50

#: States: nothing yet, behind the system row, behind a user row, behind an assistant row.
STATES, COMPLETE = 4, (0, 3)
#: The state behind a user or assistant row that may follow each state; there is always just one.
TURN = (2, 2, 3, 2)
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "?": (None,) * 4}

#: Symbols of rows: to be deleted, or a role initial with a sound or truncated text.
GONE, ROLES = 0, "sua?"


def symbol(role: int, truncated: bool) -> int:
    return 1 + 2 * role + truncated


def _steps(row: int) -> list[list[tuple[str, int, int | None]]]:
    """For each state, the edits of a row in the order of the audit: initial, price, state behind (None: not allowed)."""
    if row == GONE:
        return [[("D", DELETE, s)] for s in range(STATES)]
    role, late = ROLES[(row - 1) // 2], TRUNCATED * ((row - 1) % 2)
    return [[("D", DELETE, s), ("K", late, NEXT[role][s]), ("R", late + REROLE, TURN[s])] for s in range(STATES)]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


def _inserts() -> np.ndarray:
    one = np.full((STATES, STATES), NEVER, np.int64)
    one[range(STATES), range(STATES)] = 0
    one[range(STATES), TURN] = INSERT
    return reduce(times, [one] * STATES)


INSERTS = _inserts()
#: Costs to go when no row is left.
END = INSERTS[:, COMPLETE].min(axis=1)


@lru_cache(maxsize=None)
def power(row: int, k: int) -> np.ndarray:
    """The matrix of 2^k rows of one symbol, inserts before each included."""
    if k:
        half = power(row, k - 1)
        return times(half, half)
    own = np.full((STATES, STATES), NEVER, np.int64)
    for s, edits in enumerate(_steps(row)):
        for _, price, behind in edits:
            if behind is not None:
                own[s, behind] = min(own[s, behind], price)
    return times(INSERTS, own)


def run_matrix(row: int, length: int) -> np.ndarray:
    return reduce(times, [power(row, k) for k in range(length.bit_length()) if length >> k & 1])


def matrix(rows: bytes, lengths: np.ndarray) -> np.ndarray:
    return reduce(times, [run_matrix(r, int(n)) for r, n in zip(rows, lengths)])


def costs(row: int, length: int, after: np.ndarray) -> np.ndarray:
    """Costs to go before each row of a run and behind its last, doubling what is known by the cached powers."""
    back = np.empty((length + 1, STATES), np.int64)  # back[i]: i rows of the run are left
    back[0] = after
    known, k = 1, 0
    while known <= length:
        more = min(known, length + 1 - known)
        back[known : known + more] = np.minimum((power(row, k)[None] + back[:more, None, :]).min(axis=2), NEVER)
        known, k = known + more, k + 1
    return back[::-1]


def unroll(rows: bytes, lengths: np.ndarray, after: np.ndarray, entry: int, last: bool) -> tuple[str, int, int]:
    """(audit, cost, state behind) of the cheapest edits of a segment entered in ``entry``, least in ASCII among equals."""
    todo = []
    for row, n in zip(reversed(rows), reversed(lengths.tolist())):
        todo.append((row, n, costs(row, n, after)))
        after = todo[-1][2][0]
    audit, state, spent = [], entry, 0
    for row, n, left in reversed(todo):
        edits, to_go, at = _steps(row), left.tolist(), 0
        while at < n:
            now, behind = to_go[at][state], to_go[at + 1]
            for initial, price, then in (edits[state][0], ("I", INSERT, None), *edits[state][1:]):  # D, I, K, R
                if initial == "I":
                    if INSERT + to_go[at][TURN[state]] == now:
                        state = TURN[state]
                        break
                elif then is not None and price + behind[then] == now:
                    state, at = then, at + 1
                    break
            audit.append(initial)
            spent += price
    while last and state not in COMPLETE:
        audit.append("I")
        state, spent = TURN[state], spent + INSERT
    return "".join(audit), spent, state


@lru_cache(maxsize=1 << 16)
def _unrolled(rows: bytes, lengths: bytes, after: bytes, entry: int, last: bool) -> tuple[str, int, int]:
    return unroll(rows, np.frombuffer(lengths, np.int32), np.frombuffer(after, np.int64), entry, last)


# --------------------------------------------------------------------------
# rows and their faults


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, dropped): the rows after the damage that crc32 of ``conv:turn`` deals, modulo 20.

    0 drops the row (which stays here, marked), 1 empties its text, 2 takes its ``.!?``
    away, 3 repeats it, 4 makes it the user's.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)))
    rows = df.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.crc32(name) % 20).alias("kind"),
    )
    new_text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    new_role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.col("kind") == 0, F.when(F.col("kind") == 3, 2).otherwise(1))).alias("dropped")
    return rows.select("conv", "turn", new_role.alias("role"), new_text.alias("text"), copies)


def ordered(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """The rows with ``seg``, the range that they were sorted into, and ``place``, which grows with the order."""
    by = ["conv", "turn", "role", "text"]
    dealt = rows.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(*by, "n").sortWithinPartitions(*by).drop("n")
    return scratch.keep(dealt.withColumn("place", F.monotonically_increasing_id())).withColumn("seg", F.shiftright("place", 33))


def symbols(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """(conv, seg, place, turn, initial, fault, row) of ordered rows: fault is blank, duplicate, truncated or empty."""
    content = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    own = rows.where("not dropped").select(
        "conv", "seg", "place", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"), F.unhex(F.sha2(content, 256)).alias("content"),
    )
    # messages of which a conversation has several; written first, so that the join may split a frequent one
    again = scratch.keep(own.where("not blank").groupBy("content").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    told = own.join(again, "content", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("first"), "duplicate").when(F.col("open"), "truncated").otherwise("")
    role = F.instr(F.lit("sua"), F.col("initial")) - 1
    role = F.when((F.col("initial") == "") | (role < 0), 3).otherwise(role)
    row = F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(1 + 2 * role + (F.col("fault") == "truncated").cast("int"))
    return told.withColumn("fault", fault).select("conv", "seg", "place", "turn", "initial", "fault", row.cast("int").alias("row"))


# --------------------------------------------------------------------------
# segments


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(begins a group, its next rows) of batches that are sorted by the first ``keys`` columns."""
    seen = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in batch.columns[:keys]:
            own = np.array(c.to_pylist(), dtype=object)
            new[1:] |= own[1:] != own[:-1]
        first = tuple(c[0].as_py() for c in batch.columns[:keys])
        new[0] = seen is None or first != seen
        seen = tuple(c[n - 1].as_py() for c in batch.columns[:keys])
        starts = np.flatnonzero(new).tolist()
        if not new[0]:
            starts = [0, *starts]
        for lo, hi in zip(starts, [*starts[1:], n]):
            yield bool(new[lo]), batch.slice(lo, hi - lo)


def segments(rows: DataFrame) -> DataFrame:
    """One row for each conversation and range: its runs, their matrix, and what the counts need of both ends."""
    small_batches(rows.sparkSession)
    kind = rows.schema["conv"].dataType.simpleString()
    faults = ("blank", "duplicate", "truncated")
    shape = f"conv {kind}, seg long, rows binary, lengths binary, costs binary, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, turns long, first_initial string, last_initial string"
    names = [f.split()[0] for f in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in names]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, types)], names=names)
            for x in held:
                x.clear()
            return out

        def put(parts: list[tuple]) -> None:
            conv, seg = parts[0][:2]
            row = np.concatenate([p[2] for p in parts])
            at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            lengths = np.diff(np.append(at, len(row))).astype(np.int32)
            kinds = row[at].astype(np.uint8).tobytes()
            initial, fault = [x for p in parts for x in p[3]], [x for p in parts for x in p[4]]
            turn = [t for p in parts for t in p[5] if t is not None]
            pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initial, initial[1:]))
            distinct = bool(turn) + sum(a != b for a, b in zip(turn, turn[1:]))
            ends = (turn[0], turn[-1]) if turn else (None, None)
            new = (conv, seg, kinds, lengths.tobytes(), matrix(kinds, lengths).tobytes(), *(fault.count(f) for f in faults), pairs, *ends, distinct, initial[0], initial[-1])
            for x, v in zip(held, new):
                x.append(v)

        types, parts = None, []
        for begins, batch in _grouped(batches, 2):
            types = types or [batch.schema.types[0], pa.int64(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.string()]
            if begins and parts:
                put(parts)
                parts = []
                if len(held[0]) >= 4096:
                    yield flush()
            c = batch.columns
            parts.append((c[0][0].as_py(), c[1][0].as_py(), c[2].to_numpy(zero_copy_only=False), c[3].to_pylist(), c[4].to_pylist(), c[5].to_pylist()))
        if parts:
            put(parts)
        if held[0]:
            yield flush()

    dealt = rows.repartition("conv", "seg").sortWithinPartitions("conv", "seg", "place")
    return dealt.select("conv", "seg", "row", "initial", "fault", "turn").mapInArrow(run, shape)


def _mapped(rows: DataFrame, added: str, step) -> DataFrame:
    """``rows`` with the columns ``added`` that ``step`` tells of each row, in order; ``step`` is made anew for each task."""
    names = [f.split()[0] for f in added.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    arrow = [types[f.split()[1]] for f in added.split(", ")]
    have = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = step()
        for batch in batches:
            new = [tell(r) for r in batch.to_pylist()]
            cols = zip(*new) if new else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, t in zip(cols, arrow))], names=[*have, *names])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{shape}, {added}")


def costs_to_go(found: DataFrame) -> DataFrame:
    """Segments with ``after``: the costs to go behind them; from each conversation's last to its first."""

    def step():
        at: list = [object(), None]

        def tell(r: dict) -> tuple:
            last = r["conv"] != at[0]
            after = END if last else at[1]
            own = np.frombuffer(r["costs"], np.int64).reshape(STATES, STATES)
            at[:] = r["conv"], (own + after[None, :]).min(axis=1)
            return after.tobytes(), last

        return tell

    dealt = found.repartition("conv").sortWithinPartitions("conv", F.desc("seg"))
    return _mapped(dealt, "after binary, last boolean", step).drop("costs")


def choices(found: DataFrame) -> DataFrame:
    """Segments with the audit, cost and state behind for each state that they may be entered in."""

    def step():
        def tell(r: dict) -> tuple:
            told = [_unrolled(r["rows"], r["lengths"], r["after"], s, r["last"]) for s in ((0,) if r["opens"] else range(STATES))]
            return [a for a, _, _ in told], [c for _, c, _ in told], [s for _, _, s in told]

        return tell

    return _mapped(found.repartition("conv", "seg"), "audits array<string>, spent array<long>, behind array<long>", step)


def chosen(found: DataFrame) -> DataFrame:
    """(conv, seg, alone, audit, and this segment's share of cost, gaps and counts); ``entry`` is the state it was entered in."""

    def step():
        at: dict = {"conv": object()}

        def tell(r: dict) -> tuple:
            if r["conv"] != at["conv"]:
                at.update(conv=r["conv"], state=0, initial=None, turn=None)
            entry = at["state"]
            audit, spent, at["state"] = (r[c][entry] for c in ("audits", "spent", "behind"))
            gaps, illegal = 0, r["illegal"]
            if at["initial"] is not None and at["initial"] + r["first_initial"] not in ("su", "ua", "au"):
                illegal += 1
            if r["first_turn"] is not None:
                gaps = r["last_turn"] - r["first_turn"] + 1 - r["turns"]
                if at["turn"] is not None:
                    gaps += r["first_turn"] - at["turn"] - (r["first_turn"] != at["turn"])
                at["turn"] = r["last_turn"]
            at["initial"] = r["last_initial"]
            return entry, audit, spent, gaps, illegal

        return tell

    dealt = found.repartition("conv").sortWithinPartitions("conv", "seg")
    told = _mapped(dealt, "entry long, audit string, cost long, gaps long, illegal_pairs long", step)
    return told.select("conv", "seg", (F.col("opens") & F.col("last")).alias("alone"), "entry", "audit", "cost", "gaps", "blank", "duplicate", "truncated", F.col("illegal_pairs").alias("illegal"))


def repair(scratch: Scratch, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, edits) of ``rows`` (conv, turn, role, text, dropped).

    Segments are those of ``chosen``.  Edits are (conv, seg, alone, edit, role, text): each
    edit of each conversation, with the row as it is repaired, null where it is deleted;
    within a task they are in the order of conv, seg and place.
    """
    placed = ordered(scratch, rows)
    found = scratch.keep(segments(symbols(scratch, placed)))
    opens = F.col("seg") == F.min("seg").over(Window.partitionBy("conv"))
    told = scratch.keep(chosen(choices(costs_to_go(found).withColumn("opens", opens))))
    return told, edits(placed, told)


def edits(placed: DataFrame, told: DataFrame) -> DataFrame:
    """The rows of ``ordered`` under the audits of their segments."""
    small_batches(placed.sparkSession)
    kind = placed.schema["conv"].dataType.simpleString()
    lead = told.select("conv", "seg", F.lit(-1).cast("long").alias("place"), "alone", "entry", "audit")
    both = placed.where("not dropped").select("conv", "seg", "place", "role", "text").unionByName(lead, allowMissingColumns=True)
    names = ["conv", "seg", "alone", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, body, state, alone = "", 0, 0, 0, False
        for batch in batches:
            out: list[tuple] = []
            for r in batch.select(["conv", "seg", "place", "role", "text", "alone", "entry", "audit"]).to_pylist():
                if r["place"] < 0:
                    audit, at, state, alone = r["audit"], 0, r["entry"], r["alone"]
                    body = len(audit.rstrip("I"))  # the rest is inserted behind the last row
                else:
                    while True:
                        edit = audit[at]
                        at += 1
                        role, text = r["role"], r["text"]
                        if edit == "D":
                            role = text = None
                        elif edit == "K":
                            state = NEXT[role[:1]][state]
                        else:
                            state = TURN[state]
                            role, text = ("user", "assistant")[state - 2], "" if edit == "I" else text
                        out.append((r["conv"], r["seg"], alone, edit, role, text))
                        if edit != "I":
                            break
                    while at >= body and at < len(audit):
                        state = TURN[state]
                        out.append((r["conv"], r["seg"], alone, audit[at], ("user", "assistant")[state - 2], ""))
                        at += 1
            types = [batch.schema.field("conv").type, pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string()]
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names=names)

    dealt = both.repartition("conv", "seg").sortWithinPartitions("conv", "seg", "place")
    return dealt.mapInArrow(run, f"conv {kind}, seg long, alone boolean, edit string, role string, text string")


# --------------------------------------------------------------------------
# digests


def _hashed(repaired: DataFrame) -> DataFrame:
    """(conv, seg, sha256, piece, no) of edits in their order: a digest of what lies in one segment, else its lines in pieces."""
    kind = repaired.schema["conv"].dataType.simpleString()
    names = ["conv", "seg", "sha256", "no", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, digest, held = None, None, {}

        def row(sha256: str | None, lines: list[str] | None) -> tuple:
            held["no"] += 1
            return held["conv"], held["seg"], sha256, held["no"], None if lines is None else "\n".join(lines)

        for begins, batch in _grouped(batches, 2):
            conv_type = conv_type or batch.schema.types[0]
            out = []
            if begins:
                if digest is not None:
                    out.append(row(digest.hexdigest(), None))
                held.update(conv=batch.column(0)[0].as_py(), seg=batch.column(1)[0].as_py(), no=0, lines=0)
                digest = hashlib.sha256() if batch.column(2)[0].as_py() else None
            lines = [f"{role}:{text}" for role, text in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()) if role is not None]
            if lines and digest is None:
                out.append(row(None, lines))
            elif lines:
                digest.update((("\n" if held["lines"] else "") + "\n".join(lines)).encode())
                held["lines"] += len(lines)
            if out:
                yield table(out, conv_type)
        if digest is not None:
            yield table([row(digest.hexdigest(), None)], conv_type)

    def table(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
        types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    return repaired.mapInArrow(run, f"conv {kind}, seg long, sha256 string, no long, piece string")


def _joined(pieces: DataFrame) -> DataFrame:
    """(conv, sha256) of the pieces of conversations that lie in several segments, streamed in order: a digest is one chain."""
    kind = pieces.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, out = None, None, []
        for begins, batch in _grouped(batches, 1):
            if begins:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest, lead = batch.column(0)[0].as_py(), hashlib.sha256(), ""
                conv_type = batch.schema.types[0]
            for piece in batch.column(1).to_pylist():
                digest.update((lead + piece).encode())
                lead = "\n"
        if digest is not None:
            out.append((conv, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], conv_type), pa.array([d for _, d in out])], names=["conv", "sha256"])

    dealt = pieces.repartition("conv").sortWithinPartitions("conv", "seg", "no").select("conv", "piece")
    return dealt.mapInArrow(run, f"conv {kind}, sha256 string")


def summary(scratch: Scratch, rows: DataFrame, told: DataFrame, repaired: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``rows``, also of those all of whose rows were dropped.

    The digest is of the ``role:text`` lines of the repaired rows.
    """
    hashed = scratch.keep(_hashed(repaired))
    digest = hashed.where("sha256 is not null").select("conv", "sha256").unionByName(_joined(hashed.where("piece is not null")))
    every = rows.where("dropped").select("conv").distinct()
    parts = told.drop("alone", "entry").unionByName(digest, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    pieces = F.array_sort(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("seg", "audit"))))
    audit = F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit")
    sha256 = F.coalesce(F.max("sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return parts.groupBy("conv").agg(*counts, audit, sha256)
