"""Repair of conversations by the cheapest edits, found by Hirschberg's divide and conquer over four role states.

A right conversation is empty, or an optional system turn and then user and assistant turns in pairs.  Reading it goes
through four states (nothing yet, after system, after user, after assistant).  A row is kept, given another role, or
deleted, and turns can be inserted; a row is thus a 4 x 4 table of least costs from state to state.  Going forward from
the start and backward from the end with vectors of four costs, the two meet in the middle; the crossing with the
least sum is kept and both halves are solved in the same way.  Only the states at the borders are held: memory is
linear in the rows of a block.

Equal costs go to the least audit (the initials of the edits, D < I < K < R).  Insertions belong to the row after
them, so the audits of two ways through the same rows never start one another; the order of two ways is thus decided
once and stays, and a forward vector carries the rank of its four states beside the costs.

Tables of costs and ranks can be put together.  Long conversations are therefore cut into blocks of ``BLOCK`` rows:
every block gives its table, the crossings between blocks are found from the tables, and then each block is solved
between the two crossings at its ends.  No task holds the rows of a whole conversation; only its audit, which is one
value, and the checksum of its text, which reads rows one after the other, are made in one place.

Defined results: rows are ordered by turn, null first, then by role and by the digest of their text; null roles and
texts are one space; rows without a conversation id are one conversation.  The second of equal rows is a duplicate.
An empty table gives no rows.  Only conv_id, turn, role and text are read, so other names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewindows.llm import store

BLANKS = "\t\n\x0b\x0c\r "
BLOCK = 4096  # a power of two
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
FAR = 1 << 60

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what a state asks for
ROLE = {USER: "user", ASSISTANT: "assistant"}
# codes of rows: role initial (system, user, assistant, other), whether it must go, whether its text is cut off
MUST_GO, TRUNCATED = 4, 8

Table = tuple[tuple[tuple[int, int], ...], ...]  # [from][to] = (cost, rank among the ways that start in ``from``)


def _ways(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Least (cost, audit) between states for one row; insertions come before the row's own edit."""
    role, out = code & 3, {}
    for start in range(4):
        state, cost, audit = start, 0, ""
        for _ in range(4):  # after so many insertions every state has been seen
            ends = [(state, cost + DELETE, "D")]
            if not code & MUST_GO:
                extra = CUT_OFF if code & TRUNCATED else 0
                ends.append((NEXT[state], cost + REROLE + extra, "R"))
                if role < 3 and (role == 0 and state == START or role and NEXT[state] == role + 1):
                    ends.append((role + 1, cost + extra, "K"))
            for end, total, edit in ends:
                out[start, end] = min(out.get((start, end), (FAR, "")), (total, audit + edit))
            state, cost, audit = NEXT[state], cost + INSERT, audit + "I"
    return out


def _closing() -> dict[tuple[int, int], tuple[int, str]]:
    """The end of a conversation: insertions that complete it; all ways lead to state 0."""
    return {(START, 0): (0, ""), (ASSISTANT, 0): (0, ""), (USER, 0): (INSERT, "I"), (SYSTEM, 0): (2 * INSERT, "II")}


def _table(ways: dict[tuple[int, int], tuple[int, str]]) -> Table:
    rows = []
    for start in range(4):
        found = sorted((audit, end) for (p, end), (_, audit) in ways.items() if p == start)
        rank = {end: k for k, (_, end) in enumerate(found)}
        rows.append(tuple((ways[start, end][0], rank[end]) if end in rank else (FAR, 9) for end in range(4)))
    return tuple(rows)


WAYS = [_ways(code) for code in range(16)]
TABLES = [_table(w) for w in WAYS]
CLOSING, CLOSE = _closing(), _table(_closing())


def forward(tables: Sequence[Table], low: int, high: int, start: int) -> list[tuple[int, int]]:
    """(cost, rank of the least audit) of every state after ``tables[low:high]``."""
    vector = [(FAR, 9)] * 4
    vector[start] = (0, 0)
    for k in range(low, high):
        table, best = tables[k], [(FAR, 9, 9)] * 4
        for p in range(4):
            cost, rank = vector[p]
            if cost < FAR:
                for q in range(4):
                    step, order = table[p][q]
                    if step < FAR and (cost + step, rank, order) < best[q]:
                        best[q] = (cost + step, rank, order)
        ranks = {x: n for n, x in enumerate(sorted({(b[1], b[2]) for b in best}))}
        vector = [(b[0], ranks[b[1], b[2]]) for b in best]
    return vector


def backward(tables: Sequence[Table], low: int, high: int, end: int) -> list[int]:
    """Least cost from every state before ``tables[low:high]`` to ``end``."""
    vector = [FAR] * 4
    vector[end] = 0
    for k in range(high - 1, low - 1, -1):
        table = tables[k]
        vector = [min(min(table[p][q][0] + vector[q], FAR) for q in range(4)) for p in range(4)]
    return vector


def crossings(tables: Sequence[Table], start: int, end: int) -> list[int]:
    """The states before, between and after ``tables`` on the cheapest way with the least audit."""
    states = [start] * (len(tables) + 1)
    states[-1] = end
    open_parts = [(0, len(tables))]
    while open_parts:
        low, high = open_parts.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        left = forward(tables, low, middle, states[low])
        right = backward(tables, middle, high, states[high])
        states[middle] = min(range(4), key=lambda s: (left[s][0] + right[s], left[s][1]))
        open_parts += [(low, middle), (middle, high)]
    return states


@lru_cache(maxsize=50_000)
def block_table(codes: bytes) -> Table:
    """The table of a block: one forward pass from each state."""
    tables = [TABLES[c] for c in codes]
    return tuple(tuple(forward(tables, 0, len(tables), p)) for p in range(4))


@lru_cache(maxsize=50_000)
def block_edits(codes: bytes, start: int, end: int) -> tuple[tuple[str, str], ...]:
    """(edits, states after them) of every row of a block between two crossings, insertions first: 'K', 'IK', 'D', ..."""
    states = crossings([TABLES[c] for c in codes], start, end)
    out = []
    for code, p, q in zip(codes, states, states[1:], strict=False):
        edits, after = WAYS[code][p, q][1], ""
        for edit in edits:
            p = p if edit == "D" else q if edit == "K" else NEXT[p]
            after += str(p)
        out.append((edits, after))
    return tuple(out)


# -- rows ------------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy`` after the damage that the checksum of a row's key asks for."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _digest(role: str | Column = "role", text: str | Column = "text") -> Column:
    return F.unhex(F.sha2(F.concat(role, F.lit("\0"), text), 256))


def _joined(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """An equality join in which nulls are equal; the columns come from the left."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in columns else F.col(c) for c in right.columns])
    condition = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in columns]
    return left.join(named, condition, how).drop(*[f"_r_{c}" for c in columns])


def coded(rows: DataFrame) -> DataFrame:
    """``conv_id, pos, turn, role, digest, code, blank, duplicate, truncated`` of every row, in the shared folder.

    ``pos`` ascends through each conversation; the rows of one may lie in many parts.  Texts stay behind."""
    last = F.rtrim("text", F.lit(BLANKS))
    facts = rows.select("conv_id", "turn", "role", _digest().alias("digest"), (last == "").alias("blank"), (~F.right(last, F.lit(1)).isin(".", "!", "?")).alias("open"))
    order = ["conv_id", "turn", "role", "digest"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = facts.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = store.stored(placed.withColumn("pos", F.monotonically_increasing_id()), "turns")
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("first"))
    placed = _joined(placed, first, ["conv_id", "role", "digest"])
    duplicate = ~F.col("blank") & (F.col("pos") > F.col("first"))
    truncated = ~F.col("blank") & ~duplicate & F.col("open")
    initial = F.left("role", F.lit(1))
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = code + F.when(F.col("blank") | duplicate, MUST_GO).otherwise(0) + F.when(truncated, TRUNCATED).otherwise(0)
    return placed.select("conv_id", "pos", "turn", "role", "digest", code.alias("code"), "blank", duplicate.alias("duplicate"), truncated.alias("truncated"))


def blocks(rows: DataFrame) -> DataFrame:
    """``conv_id, block, turns`` with at most ``BLOCK`` rows each, in order."""
    turn = F.struct("pos", "turn", "role", "digest", F.col("code").cast("byte").alias("code"), "blank", "duplicate", "truncated")
    block = F.shiftright("pos", BLOCK.bit_length() - 1).alias("block")
    return rows.groupBy("conv_id", block).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _codes(turns: pa.ListArray) -> list[bytes]:
    codes = turns.values.field("code").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
    ends = turns.offsets.to_numpy()
    return [codes[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        flat = [[n for row in block_table(c) for way in row for n in way] for c in _codes(batch.column(names.index("turns")))]
        keep = [i for i, n in enumerate(names) if n != "turns"]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(flat, pa.list_(pa.int64()))], names=[*[names[i] for i in keep], "table"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every conversation the crossings between its blocks, its cost and what is inserted at its end."""
    for batch in batches:
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        states, costs, closing = [], [], []
        for parts in at["parts"].to_pylist():
            tables = [tuple(tuple((p["table"][8 * i + 2 * k], p["table"][8 * i + 2 * k + 1]) for k in range(4)) for i in range(4)) for p in parts]
            found = crossings([*tables, CLOSE], START, 0)
            states.append([(p["block"], a, b) for p, a, b in zip(parts, found, found[1:], strict=False)])
            costs.append(sum(t[a][b][0] for t, a, b in zip([*tables, CLOSE], found, found[1:], strict=False)))
            closing.append(CLOSING[found[-2], 0][1])
        kind = pa.list_(pa.struct([("block", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
        rows = [[{"block": x, "start": a, "end": b} for x, a, b in s] for s in states]
        yield pa.RecordBatch.from_arrays([at["conv_id"], pa.array(rows, kind), pa.array(costs, pa.int64()), pa.array(closing, pa.string())], names=["conv_id", "crossings", "cost", "closing"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of the rows of each block between its crossings."""
    for batch in batches:
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        ends = zip(at["start"].to_pylist(), at["end"].to_pylist(), strict=True)
        found = [block_edits(c, a, b) for c, (a, b) in zip(_codes(at["turns"]), ends, strict=True)]
        names = [n for n in at if n not in ("start", "end")]
        made = [pa.array([[pair[k] for pair in row] for row in found], pa.list_(pa.string())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*[at[n] for n in names], *made], names=[*names, "edits", "states"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conversations, turns)`` for rows ``conv_id, turn, role, text`` (and ``copy``, ignored).

    ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, of conversations with rows.
    ``turns``: conv_id, place, edit, role, text of every turn of the repaired conversations; ``place`` orders them."""
    cut = store.stored(blocks(coded(rows)), "turn-blocks")
    kind = cut.schema["turns"].dataType.simpleString()
    id_kind = cut.schema["conv_id"].dataType.simpleString()

    tables = cut.mapInArrow(_tables, f"conv_id {id_kind}, block long, table array<long>")
    tables = tables.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "table"))).alias("parts"))
    found = tables.mapInArrow(_meet, f"conv_id {id_kind}, crossings array<struct<block:bigint,start:int,end:int>>, cost long, closing string")
    found = store.stored(found, "crossings")
    ends = found.select("conv_id", F.explode("crossings").alias("x")).select("conv_id", "x.*")
    solved = _joined(cut, ends, ["conv_id", "block"])
    solved = store.stored(solved.select("conv_id", "block", "turns", "start", "end").mapInArrow(_solve, f"conv_id {id_kind}, block long, turns {kind}, edits array<string>, states array<string>"), "edits")

    conversations = _figures(solved, found)
    return conversations, _turns(rows, solved, found)


def _figures(solved: DataFrame, found: DataFrame) -> DataFrame:
    """Counts of a conversation from those of its blocks and of the borders between them."""
    each = F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), F.left(t["role"], F.lit(1)).alias("initial")))
    tally = lambda name: F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t[name].cast("long")).alias(name)
    rows = solved.select("conv_id", "block", each.alias("rows"), *[tally(n) for n in ("blank", "duplicate", "truncated")], F.array_join("edits", "").alias("edits"))

    def neighbours(column: str, left: str | None = None, right: str | None = None) -> Column:
        before, after = F.slice(column, 1, F.size(column) - 1), F.slice(column, 2, F.size(column))
        return F.zip_with(before, after, lambda x, y: F.struct((x[left] if left else x).alias("x"), (y[right] if right else y).alias("y")))

    rows = rows.withColumn("pairs", neighbours("rows"))

    def broken(p: Column) -> Column:
        return ~F.concat(p["x"]["initial"], p["y"]["initial"]).isin("su", "ua", "au")

    def new(p: Column) -> Column:
        return p["y"]["turn"].isNotNull() & ~p["x"]["turn"].eqNullSafe(p["y"]["turn"])

    first, last = F.element_at("rows", 1), F.element_at("rows", -1)
    rows = rows.select(
        "conv_id", "block", "blank", "duplicate", "truncated", "edits",
        first.alias("x"), last.alias("y"),
        F.size(F.filter("pairs", broken)).cast("long").alias("illegal"),
        (F.size(F.filter("pairs", new)) + F.when(first["turn"].isNotNull(), 1).otherwise(0)).cast("long").alias("turns"),
        F.array_min(F.transform("rows", lambda t: t["turn"])).alias("low"),
        F.array_max(F.transform("rows", lambda t: t["turn"])).alias("high"),
    )
    part = F.struct("block", "x", "y", "edits")
    whole = rows.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")], F.min("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_list(part)).alias("parts"))
    whole = whole.withColumn("borders", neighbours("parts", "y", "x"))
    more = F.size(F.filter("borders", broken))
    same = F.size(F.filter("borders", lambda p: p["y"]["turn"].isNotNull() & ~new(p)))
    audit = F.array_join(F.transform("parts", lambda p: p["edits"]), "")
    whole = _joined(whole, found.select("conv_id", "cost", "closing"), ["conv_id"])
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("turns") - same), F.lit(0))
    return whole.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + more).alias("illegal"), "cost", F.concat(audit, "closing").alias("audit"))


def _turns(rows: DataFrame, solved: DataFrame, found: DataFrame) -> DataFrame:
    """The turns that stay, with their texts, and the inserted ones.  A text is looked up by conversation and digest:
    rows that stay are no duplicates."""
    row = F.explode(F.arrays_zip("turns", "edits", "states")).alias("r")
    each = solved.select("conv_id", row).select("conv_id", "r.turns.pos", "r.turns.role", "r.turns.digest", "r.edits", "r.states")
    letter = F.explode(F.sequence(F.lit(1), F.length("edits"))).alias("n")
    each = each.select("*", letter).select("*", F.expr("substr(edits, n, 1)").alias("edit"), F.expr("substr(states, n, 1)").alias("state"))
    asked = F.when(F.col("state") == USER, ROLE[USER]).otherwise(ROLE[ASSISTANT])
    kept = each.filter(F.col("edit").isin("K", "R"))
    texts = rows.select("conv_id", "role", _digest().alias("digest"), "text").groupBy("conv_id", "role", "digest").agg(F.first("text").alias("text"))
    kept = _joined(kept, texts, ["conv_id", "role", "digest"])
    kept = kept.select("conv_id", "pos", "n", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(asked).alias("role"), "text")
    added = each.filter("edit = 'I'").select("conv_id", "pos", "n", "edit", asked.alias("role"), F.lit("").alias("text"))
    # what completes a conversation ends with an assistant turn
    end = F.when(F.col("n") == F.length("closing"), ROLE[ASSISTANT]).otherwise(ROLE[USER])
    last = found.filter("closing <> ''").select("conv_id", F.lit(1 << 62).alias("pos"), F.explode(F.sequence(F.lit(1), F.length("closing"))).alias("n"), "closing")
    last = last.select("conv_id", "pos", "n", F.lit("I").alias("edit"), end.alias("role"), F.lit("").alias("text"))
    return kept.unionByName(added).unionByName(last).select("conv_id", F.struct("pos", "n").alias("place"), "edit", "role", "text")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checksums of whole conversations from turns in order; one checksum is open at a time."""
    now, made, ids, sums = None, None, [], []
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if made is not None and conv == now:
                made.update(b"\n")
            else:
                if made is not None:
                    ids.append(now)
                    sums.append(made.hexdigest())
                now, made = conv, hashlib.sha256()
            made.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sums, pa.string())], names=["conv_id", "repaired_sha256"])
        ids, sums = [], []
    if made is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([made.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def checksums(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of newline-joined ``role:text``; turns of a conversation are read one by one."""
    id_kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", "role", "text").mapInArrow(_written, f"conv_id {id_kind}, repaired_sha256 string")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    conversations, turns = repair(damaged(given))
    out = _joined(given.select("conv_id").distinct(), conversations, ["conv_id"], "left")
    out = _joined(out, checksums(turns), ["conv_id"], "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
