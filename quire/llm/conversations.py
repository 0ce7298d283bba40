"""Conversation structure repair by a rank-convergence parallel Viterbi.

A repaired conversation has roles with the initials `(s?(ua)+)?`. Its rows are
kept, given another role, or deleted, and empty rows may be inserted; the
cheapest edits are a shortest path through four states (nothing yet, after s,
after u, after a). Blank and duplicate rows can only be deleted, at a fixed
cost, so they leave no choice and stand outside of the path.

Rows are sorted by (conversation, turn) across partitions and cut into chunks
of at most ``ROWS`` rows with a choice, wherever a conversation crosses a
partition. Every chunk computes the cost from each state to the end backward,
starting from a speculative vector: that of a conversation that ends here.
Fix-up passes then hand each chunk the vector its successor has found and
rerun the chunks for which it differs by more than a constant, until none does;
the constants add up to the cost. Costs to the end differ between states by ten
at most, so vectors agree soon: one pass is the usual case, a conversation of n
chunks takes at most n. The stitched backward costs then drive the tracing: in
each state the ASCII-least edit on a cheapest path. A conversation that lies
in one chunk is finished where it stands; of the others the chunks meet once
more in order, because a SHA-256 over the repaired text is sequential, and are
streamed, so memory does not grow with the conversation.

Defined results: a null role or text is one space; null turns come first; rows
of one turn are ordered by role, then by the MD5 of their text; a null
conversation id is a conversation; a role is told by its initial, so 'user' is
also kept as 'usher'; an empty role has none and can't be kept; ``gaps`` beyond
a long is null; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, lots, store

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5             # costs; keeping costs nothing
ROWS, BYTES = 256, 4 << 20            # rows with a choice, and bytes of their text, in one chunk
BLANKS = " \t\n\x0b\f\r"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Costs from each state when no row is left: two inserts behind s, one behind u.
END = (0, 2 * INSERT, INSERT, 0)
INITIALS = {"s": 0, "u": 1, "a": 2}
LEGAL = {"su", "ua", "au"}
CUT = 4                               # added to a row's kind when its text is cut off


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: a known damage of every row, told by crc32 of `conv_id:turn`."""
    s = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(s["conv_id"], F.lit(":"), s["turn"]).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", s["role"].alias("role"), s["text"].alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """One row for all copies of a (conv_id, turn, role, text): ``copies``, ``blank``, ``first`` (not seen earlier) and ``cut``."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    s = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), s["role"].alias("role"), s["text"].alias("text"), copies.cast("long").alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("h", F.md5(F.col("text").cast("binary")))
    again = (rows.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h").alias("_h"))
             .agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("turn").isNull()).alias("_null"), F.min("turn").alias("_least")).where("_n > 1"))
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("h") == F.col("_h")), "left")
    first = F.when(F.col("_n").isNull(), True).when(F.col("_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("_least"))
    end = F.rtrim("text", F.lit(BLANKS))
    return rows.select("conv_id", "turn", "role", "h", "text", "copies", (end == "").alias("blank"), first.alias("first"),
                       (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))


def step(kind: int, w: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """Costs to the end from the states before a row of this kind, from those behind it."""
    role, more = kind & 3, TRUNCATED if kind & CUT else 0
    u = w[AFTER_U] + more + (0 if role == 1 else REROLE)
    a = w[AFTER_A] + more + (0 if role == 2 else REROLE)
    start, s = min(w[START] + DELETE, u), min(w[AFTER_S] + DELETE, u)
    if role == 0:
        start = min(start, w[AFTER_S] + more)
    at_u, at_a = min(w[AFTER_U] + DELETE, a), min(w[AFTER_A] + DELETE, u)
    at_u, at_a = min(at_u, at_a + INSERT), min(at_a, at_u + INSERT)            # rows inserted before this one
    return min(start, at_u + INSERT), min(s, at_u + INSERT), at_u, at_a


def backward(kinds: bytes, end: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    for kind in reversed(kinds):
        end = step(kind, end)
    return end


def trace(kinds: bytes, deleted: list[int], end: tuple[int, int, int, int], state: int, last: bool) -> tuple[str, list[tuple[int, str]], int]:
    """Letters, repaired rows (row or -1, role or '' for its own) and the state behind
    a chunk that is entered in ``state``. ``deleted`` blanks and duplicates stand before each row and at the end."""
    costs = [end]
    for kind in reversed(kinds):
        costs.append(step(kind, costs[-1]))
    costs.reverse()
    letters, rows = [], []

    def insert() -> int:
        letters.append("I")
        rows.append((-1, "assistant" if state == AFTER_U else "user"))
        return AFTER_A if state == AFTER_U else AFTER_U

    for i, kind in enumerate(kinds):
        letters.append("D" * deleted[i])
        role, more, behind = kind & 3, TRUNCATED if kind & CUT else 0, costs[i + 1]
        while behind[state] + DELETE != costs[i][state]:
            other = AFTER_A if state == AFTER_U else AFTER_U                   # what the next u or a leads to
            if costs[i][other] + INSERT == costs[i][state]:
                state = insert()
                continue
            own = 2 if state == AFTER_U else 1                                 # the initial expected here
            keep = AFTER_S if role == 0 and state == START else other if role == own else None
            if keep is not None and behind[keep] + more == costs[i][state]:
                letters.append("K")
                rows.append((i, ""))
                state = keep
            else:
                letters.append("R")
                rows.append((i, "assistant" if state == AFTER_U else "user"))
                state = other
            break
        else:
            letters.append("D")
    letters.append("D" * deleted[len(kinds)])
    while last and state in (AFTER_S, AFTER_U):
        state = insert()
    return "".join(letters), rows, state


class Chunk:
    """Rows of one conversation in order: counts, and what the path needs of the rows with a choice."""

    def __init__(self, conv, number: int, opens: bool):
        self.conv, self.number, self.opens = conv, number, opens               # opens: nothing of the conversation stands before, as far as the task knows
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.bytes = 0
        self.first_role = self.last_role = None
        self.first_turn = self.last_turn = None
        self.kinds, self.deleted, self.roles, self.texts = bytearray(), [0], [], []

    def add(self, turn, role: str, text: str, copies: int, blank: bool, first: bool, cut: bool) -> None:
        initial = role[:1]
        if self.first_role is None:
            self.first_role = initial
        else:
            self.illegal += self.last_role + initial not in LEGAL
        self.illegal += copies - 1                         # copies stand side by side
        self.last_role = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if blank or not first:
            self.blank += copies if blank else 0
            self.duplicate += 0 if blank else copies
            self.deleted[-1] += copies
            return
        self.duplicate += copies - 1
        self.truncated += cut
        self.kinds.append(INITIALS.get(initial, 3) | (CUT if cut else 0))
        self.deleted.append(copies - 1)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)


class Repaired:
    """A conversation's results, from its chunks in order."""

    def __init__(self, conv):
        self.conv, self.state, self.cost = conv, START, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.last_role = self.first_turn = self.last_turn = None
        self.audit, self.digest, self.some = [], hashlib.sha256(), False

    def add(self, c: Chunk, start: tuple, end: tuple, last: bool) -> None:
        self.cost += min(start) if self.last_role is not None else start[START]
        self.cost += DELETE * sum(c.deleted)
        self.illegal += c.illegal + (self.last_role is not None and self.last_role + c.first_role not in LEGAL)
        self.last_role = c.last_role
        self.blank, self.duplicate, self.truncated = self.blank + c.blank, self.duplicate + c.duplicate, self.truncated + c.truncated
        if c.turns:
            self.turns += c.turns - (c.first_turn == self.last_turn)
            self.first_turn = c.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = c.last_turn
        letters, rows, self.state = trace(bytes(c.kinds), c.deleted, end, self.state, last)
        self.audit.append(letters)
        for k, role in rows:
            text = f"{role or c.roles[k]}:{c.texts[k] if k >= 0 else ''}"
            self.digest.update(("\n" + text if self.some else text).encode())
            self.some = True

    def row(self) -> tuple:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return (self.conv, gaps if gaps < 1 << 63 else None, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
                "".join(self.audit), self.digest.hexdigest())


_LONG, _STRING, _VECTOR = T.LongType(), T.StringType(), T.ArrayType(T.LongType())
_RESULT = [("gaps", _LONG), ("blank", _LONG), ("duplicate", _LONG), ("truncated", _LONG), ("illegal", _LONG), ("cost", _LONG),
           ("audit", _STRING), ("repaired_sha256", _STRING)]
_CHUNK = [("id", _LONG), ("next", _LONG), ("start", _VECTOR), ("first_role", _STRING), ("last_role", _STRING), ("first_turn", _LONG), ("last_turn", _LONG),
          ("turns", _LONG), ("kinds", T.BinaryType()), ("deleted", _VECTOR), ("roles", T.ArrayType(_STRING)), ("texts", T.ArrayType(_STRING))]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, wide: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += sum(len(x) for x in r if isinstance(x, (str, bytes))) + sum(sum(map(len, x)) for x in r if isinstance(x, list) and x and isinstance(x[0], str))
        if len(held) >= size or weight >= wide:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _chunked(rows: DataFrame, size: int) -> tuple[DataFrame, T.StructType]:
    """Results of conversations inside one chunk, chunks (with ``id``) of all others."""
    order = ["conv_id", "turn", "role", "h"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    conv = rows.schema["conv_id"]
    schema = T.StructType([T.StructField("conv_id", conv.dataType), *[T.StructField(n, t) for n, t in [*_RESULT, *_CHUNK]]])
    arrow = _arrow(schema)
    none_result, none_chunk = (None,) * len(_RESULT), (None,) * len(_CHUNK)

    def as_row(c: Chunk, follows: int | None) -> tuple:
        """A chunk's row; ``follows``: the next chunk's id, -1 for the first one of the next partition."""
        counts = (None, c.blank, c.duplicate, c.truncated, c.illegal, None, None, None)
        return (c.conv, *counts, c.number, follows, list(backward(bytes(c.kinds), END)), c.first_role, c.last_role, c.first_turn, c.last_turn,
                c.turns, bytes(c.kinds), c.deleted, c.roles, c.texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            base = TaskContext.get().partitionId() << 32
            now: Chunk | None = None
            for b in (x for y in batches for x in lots(y)):
                for conv, turn, role, text, copies, blank, first, cut in zip(*[column(b, n).to_pylist() for n in names], strict=True):
                    if now is None:
                        now = Chunk(conv, base, False)     # its conversation may have begun in the partition before
                    elif now.conv != conv:
                        if now.opens:
                            done = Repaired(now.conv)
                            done.add(now, backward(bytes(now.kinds), END), END, True)
                            yield (*done.row(), *none_chunk)
                            now = Chunk(conv, now.number, True)
                        else:
                            yield as_row(now, None)
                            now = Chunk(conv, now.number + 1, True)
                    elif len(now.kinds) >= size or now.bytes >= BYTES:
                        yield as_row(now, now.number + 1)
                        now = Chunk(conv, now.number + 1, False)
                    now.add(turn, role, text, copies, blank, first, cut)
            if now is not None:
                yield as_row(now, -1)

        yield from _batches(results(), arrow)

    names = ["conv_id", "turn", "role", "text", "copies", "blank", "first", "cut"]
    return rows.select(*names).mapInArrow(run, schema), schema


def _converged(chunks: DataFrame) -> DataFrame:
    """id, start, end, last: every chunk's own vector and the one behind it, after the fix-up passes."""
    spark = chunks.sparkSession
    parts = sorted(r.p for r in chunks.where("id % 4294967296 = 0").select(F.shiftright("id", 32).alias("p")).collect())   # one per task
    follows = spark.createDataFrame([(p, n << 32) for p, n in zip(parts[:-1], parts[1:], strict=True)], "_p long, _first long")
    v = chunks.select("conv_id", "id", "start", F.when(F.col("next") >= 0, F.col("next")).alias("_next"),
                      F.when(F.col("next") == -1, F.shiftright("id", 32)).alias("_p")).join(follows, "_p", "left")
    v = v.select("conv_id", "id", "start", F.coalesce("_next", "_first").alias("next"))
    same = v.select(F.col("conv_id").alias("_c"), F.col("id").alias("_id"))
    v = v.join(same, (F.col("next") == F.col("_id")) & F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    speculative = F.array(*[F.lit(x).cast("long") for x in END])
    v = store(v.select("id", F.col("_id").alias("next"), "start", speculative.alias("end")), "vectors")
    kinds = chunks.select("id", "kinds")

    def rerun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = column(b, "end")
            starts = [list(backward(k, tuple(e))) for k, e in zip(column(b, "kinds").to_pylist(), ends.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "next"), pa.array(starts, pa.list_(pa.int64())), ends], names=["id", "next", "start", "end"])

    while True:
        least = F.array_min("start")
        found = v.select(F.col("id").alias("next"), F.transform("start", lambda x: x - least).alias("found"))
        wrong = v.drop("start").join(found, "next").where("found <> end").select("id", "next", F.col("found").alias("end"))
        again = store(wrong.join(kinds, "id").mapInArrow(rerun, "id long, next long, start array<long>, end array<long>"), "again")
        if again.isEmpty():
            return v.select("id", "start", "end", F.col("next").isNull().alias("last"))
        v = store(v.join(again, "id", "left_anti").unionByName(again), "vectors")


def _finished(chunks: DataFrame, schema: T.StructType) -> DataFrame:
    """The results of conversations of several chunks, which meet in order."""
    rows = chunks.drop("start", "next").join(_converged(chunks), "id")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "id")
    out = T.StructType(schema.fields[:len(_RESULT) + 1])
    arrow = _arrow(out)
    names = ["conv_id", "start", "end", "last", "blank", "duplicate", "truncated", "illegal", *[n for n, _ in _CHUNK[3:]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            now: Repaired | None = None
            for b in (y.slice(a, 16) for y in batches for a in range(0, y.num_rows, 16)):     # chunks have at most BYTES
                for values in zip(*[column(b, n).to_pylist() for n in names], strict=True):
                    x = dict(zip(names, values, strict=True))
                    c = Chunk(x["conv_id"], 0, False)
                    for n in names[4:]:
                        setattr(c, n, x[n])
                    if now is None:
                        now = Repaired(c.conv)
                    now.add(c, tuple(x["start"]), tuple(x["end"]), x["last"])
                    if x["last"]:
                        yield now.row()
                        now = None

        yield from _batches(results(), arrow)

    return rows.select(*names).mapInArrow(run, out)


def repair(rows: DataFrame, ids: DataFrame | None = None, size: int = ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of every conversation in ``rows`` (conv_id, turn, role,
    text, and ``copies`` if rows stand for several), and of those in ``ids``
    that have no row: zeros, no audit, the hash of the empty string."""
    stored, schema = _chunked(marked(rows), size)
    stored = store(stored, "chunks")
    names = ["conv_id", *[n for n, _ in _RESULT]]
    found = stored.where("id is null").select(*names).unionByName(_finished(stored.where("id is not null"), schema))
    if ids is None:
        return found
    found = ids.select(F.col("conv_id").alias("_id")).distinct().join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    missing = F.col("audit").isNull()
    zero = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return found.select(F.col("_id").alias("conv_id"), *[F.when(missing, zero.get(n, F.lit(0).cast("long"))).otherwise(F.col(n)).alias(n) for n in names[1:]])
