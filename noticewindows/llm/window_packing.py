"""Packing of whole documents into token windows by best-fit decreasing, decided once for the whole corpus.

A document's ids (with its end id) are cut into full windows and one rest.  Best-fit decreasing only looks at lengths,
and there are no more lengths than a window has tokens.  So the corpus is counted by length, and the driver packs that
histogram: for each length from the longest down, a segment tree over remaining capacities finds the tightest open
window, and all equal pieces that it and its equals can take are placed in one step.  The outcome is a list of runs
(pieces of one length, numbered through the corpus, go to consecutive windows at one offset).  Its size depends on
the window length, not on the corpus; it is the packing that the sequential algorithm gives for all pieces.

Pieces learn their number without a shuffle of tokens: each task numbers its pieces per length, and a prefix sum over
the tasks' counts turns that into a number over all pieces.  Tokens move once, when windows are put together.

Defined results: a null text is an empty one, its only token is the end id.  Repeated rows and null ids are documents
of their own; pieces of equal length are placed in the order of the tasks that read them.  An empty table gives no
windows.  Input columns other than the named ones are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticewindows.llm import store
from noticewindows.llm.textblocks import slabs
from noticewindows.llm.token_files import chunk_encoder, default_vocabulary

WINDOW = 1024
END_ID = 0
SLAB_BYTES = 4 << 20
BROADCAST_COUNTS = 200_000  # rows of (task, length), about 160 bytes each; more than that are joined by a shuffle


class OpenWindows:
    """Runs of open windows by remaining capacity, and a segment tree that finds the tightest that fits."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.tree = [0] * (2 * self.leaves)  # open windows below each node
        self.runs: list[deque] = [deque() for _ in range(length + 1)]

    def _change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.tree[node] += by
            node >>= 1

    def add(self, capacity: int, first: int, count: int) -> None:
        if capacity and count:
            self.runs[capacity].append((first, count))
            self._change(capacity, count)

    def tightest(self, size: int) -> int | None:
        """The smallest capacity of an open window that holds ``size`` tokens."""
        node = self.leaves + size
        if not self.tree[node]:
            while True:  # up until a right sibling has open windows, then down to its leftmost one
                if node == 1:
                    return None
                if not node & 1 and self.tree[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.leaves:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.leaves

    def open(self, capacity: int) -> int:
        return self.tree[self.leaves + capacity]

    def take(self, capacity: int, count: int) -> Iterator[tuple[int, int]]:
        """Remove ``count`` windows of one capacity; yields them as (first, count)."""
        self._change(capacity, -count)
        runs = self.runs[capacity]
        while count:
            first, n = runs.popleft()
            if n > count:
                runs.appendleft((first + count, n - count))
                n = count
            yield first, n
            count -= n


def best_fit(counts: dict[int, int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Pack ``counts[size]`` pieces of every size.

    ``(runs, first)``: rows (number of the first piece, its window, offset) in ascending order of pieces, where pieces
    are numbered from the largest size down and ``first[size]`` is the first number of a size."""
    open_windows, made, runs = OpenWindows(length), 0, []
    first, number = np.zeros(length + 2, np.int64), 0
    for size in sorted(counts, reverse=True):
        left = counts[size]
        first[size] = number
        while left:
            room = open_windows.tightest(size)
            if room is None:
                new = max(1, left // (length // size))
                open_windows.add(length, made, new)
                made += new
                continue
            each = room // size  # a window that took one piece is the tightest for the next one
            windows = min(open_windows.open(room), left // each)
            if not windows:
                windows, each = 1, left
            for window, n in open_windows.take(room, windows):
                for k in range(each):
                    runs.append((number, window, length - room + k * size))
                    number += n
                open_windows.add(room - each * size, window, n)
            left -= windows * each
    return np.array(runs, np.int64).reshape(-1, 3), first


def _pieces(vocabulary: str, end_id: int, length: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = chunk_encoder(vocabulary, special=True), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in slabs(batches, text, SLAB_BYTES):
            place = batch.schema.get_field_index(text)
            ids, offsets = encoder.encode(batch.column(place), end_id)
            tokens = np.diff(offsets)
            pieces = -(-tokens // length)
            row = np.repeat(np.arange(len(tokens)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
            size = np.minimum(length, tokens[row] - start)
            order = np.argsort(size, kind="stable")
            sizes, at, many = np.unique(size[order], return_index=True, return_counts=True)
            number = np.empty(len(row), np.int64)
            number[order] = np.arange(len(row)) - np.repeat(at, many) + np.repeat(seen[sizes], many)
            seen[sizes] += many
            kept = [(f.name, batch.column(i).take(pa.array(row))) for i, f in enumerate(batch.schema) if i != place]
            made = [
                ("doc_tokens", pa.array(tokens[row])),
                ("start", pa.array(start)),
                ("length", pa.array(size)),
                ("part", pa.array(np.full(len(row), part, np.int32))),
                ("number", pa.array(number)),
                ("ids", pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(ids))),
            ]
            yield pa.RecordBatch.from_arrays([c for _, c in kept + made], names=[n for n, _ in kept + made])

    return run


def _placed(plan, digest: bool):
    """Window and offset of each numbered piece; with ``digest`` the ids give way to their checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, first = plan.value
        for batch in batches:
            column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            size, number, before = (column.pop(c).to_numpy(zero_copy_only=False) for c in ("length", "number", "before"))
            piece = first[size] + before + number
            at = np.searchsorted(runs[:, 0], piece, "right") - 1
            column["length"] = pa.array(size)
            column["sequence_id"] = pa.array(runs[at, 1] + piece - runs[at, 0])
            column["offset"] = pa.array(runs[at, 2])
            ids = column.pop("ids")
            if digest:
                ends = ids.offsets.to_numpy()
                values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")
                column["ids_crc32"] = pa.array([zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
            else:
                column["ids"] = ids
            yield pa.RecordBatch.from_arrays(list(column.values()), names=list(column))

    return run


def cut(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, end_id: int = END_ID, length: int = WINDOW) -> DataFrame:
    """Pieces of all texts, written to the shared folder: kept columns, ``doc_tokens, start, length, part, number,
    ids``.  ``number`` counts the pieces of one length in one ``part``."""
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_packed text"))
    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    schema = ", ".join([*given, "doc_tokens long, start long, length long, part int, number long, ids array<int>"])
    run: Callable = _pieces(vocabulary or default_vocabulary(), end_id, length, "_packed text")
    return store.stored(kept.mapInArrow(run, schema), "pieces")


def place(pieces: DataFrame, length: int = WINDOW, digest: bool = False) -> DataFrame:
    """``pieces`` of :func:`cut` with their window (``sequence_id``) and place in it (``offset``)."""
    spark = pieces.sparkSession
    counts = store.stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    plan = spark.sparkContext.broadcast(best_fit(totals, length))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    if counts.count() <= BROADCAST_COUNTS:
        before = F.broadcast(before)
    numbered = pieces.join(before, ["part", "length"])
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields if f.name not in ("part", "number", "before", "length", "ids")]
    last = "ids_crc32 long" if digest else "ids array<int>"
    order = [f.name for f in numbered.schema.fields if f.name not in ("part",)]
    return numbered.select(*[F.col(f"`{c}`") for c in order]).mapInArrow(_placed(plan, digest), ", ".join([*columns, "length long, sequence_id long, offset long", last]))


def pack(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, end_id: int = END_ID, length: int = WINDOW) -> DataFrame:
    """One row per piece: kept columns, ``doc_tokens, start, length, sequence_id, offset, ids``."""
    return place(cut(df, text, keep, vocabulary, end_id, length), length)


def windows(packed: DataFrame, length: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the pieces of each window in order, padded to ``length``; a window that holds a
    power of two of tokens stays as it is."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    short = n.bitwiseAND(n - 1) != 0
    padding = F.array_repeat(F.lit(pad_id), F.when(short, F.lit(length) - n).otherwise(0))
    return whole.select("sequence_id", n.cast("long").alias("n_tokens"), F.concat("ids", padding).alias("ids"))


def op11_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    placed = place(cut(documents), digest=True)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
