"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of words: the marked words are hashed, the others may differ.  The hashes of all
windows of the benchmark texts are joined with those of the training texts; a hit fixes a benchmark item and a
diagonal (document place less item place).  Every diagonal is taken once, however many hits it has, and the words of both
along it are compared around its hits.
A run of aligned words is an overlap when it has at least ``min_words`` equal words, ``min_share`` of the run is equal
and both ends are equal; of an item in which ``min_share`` of its words are fewer than ``min_words``, that many suffice.

The masks are chosen so that with the default rule no overlap is missed, wherever the changed words stand: every row of
equal and changed words that passes the rule holds at least one mask (the tests walk through all rows of all lengths).

The seeds of the benchmark are held by every task in blocks of at most ``HELD_SEEDS``, so a larger benchmark means more
passes, not larger tasks.

Defined results: words are compared in lower case and without punctuation at their ends; null and blank texts and
items match nothing, nor do items of fewer than four words; shorter items have shorter masks, of less weight.
Repeated documents each get their rows; rows with a null id are reported under the null id.  Items that repeat are
reported each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewindows.llm import store
from noticewindows.llm.textblocks import BASE, U, Words, mix, released, slabs, span_hashes

# 1 = the word counts, 0 = the word may differ.  Found by a greedy cover; leaving one out would lose overlaps.
MASKS = ("1111011", "110010111", "11000100111", "111100011", "1101010101", "11101101", "1010011011", "110100001011", "1101111")
LONG_WORDS = 12  # an item of so many words has MASKS, a shorter one those of the largest length below, which cover it too
SHORT_MASKS = {4: ("111", "1101", "1011"), 6: ("1111", "11011"), 8: ("11101", "100111", "1101001")}
SHORT_MASK_WORDS = min(SHORT_MASKS)  # shorter items are too short to mean anything
MIN_WORDS = 13
MIN_SHARE = 0.75
HELD_SEEDS = 4_000_000  # about 130 MB in a worker: hash, item and place of a seed, 16 MB of first bits
SLAB_BYTES = 2 << 20
COMPARED = 1 << 20  # words compared, or pairs of places made, at a time

PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[list(b"!\"'(),-.:;?[]{}`*_")] = True


def plain_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of the words without punctuation at their ends, and the offsets of the texts."""
    words = Words(pc.utf8_lower(column))
    starts, ends = words.starts.copy(), words.ends.copy()
    marks = PUNCTUATION[words.data] if len(words.data) else np.zeros(0, dtype=bool)
    while True:
        trim = (starts < ends) & marks[np.minimum(starts, max(len(marks) - 1, 0))] if len(starts) else np.zeros(0, dtype=bool)
        if not trim.any():
            break
        starts[trim] += 1
    while True:
        trim = (starts < ends) & marks[np.maximum(ends - 1, 0)] if len(starts) else np.zeros(0, dtype=bool)
        if not trim.any():
            break
        ends[trim] -= 1
    keep = starts < ends
    kept = np.concatenate([[0], np.cumsum(keep)])
    return words.data, starts[keep], ends[keep], kept[words.offsets]


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of those words, and the offsets of the texts."""
    data, starts, ends, offsets = plain_spans(column)
    return span_hashes(data, starts, ends), offsets


def seed_hashes(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of the marked words of every window of one text."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.full(n, U(number + 1), U)
    for k, used in enumerate(mask):
        if used == "1":
            total = (total * U(BASE)) ^ hashes[k : k + n]
            total = total ^ (total >> U(31))
    return mix(total)


def masks_of(n_words: int, masks: tuple[str, ...]) -> list[tuple[int, str]]:
    """The numbered masks for an item: all masks that fit, or those of its length for a shorter item."""
    fitting = [(i, m) for i, m in enumerate(masks) if len(m) <= n_words and n_words >= LONG_WORDS]
    if fitting or n_words < SHORT_MASK_WORDS:
        return fitting
    least = max(n for n in SHORT_MASKS if n <= n_words)
    return [(1000 + 10 * least + i, m) for i, m in enumerate(SHORT_MASKS[least])]


def words_needed(n_words: int, min_words: int, min_share: float) -> int:
    """The equal words that make an overlap with an item of ``n_words`` words."""
    return min(min_words, math.ceil(min_share * n_words - 1e-9))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, offsets = plain_words(batch.column(1))
        words = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], names=["item_id", "words"])


class Seeds:
    """The seeds of a block of benchmark items, sorted, with the item and place of each."""

    def __init__(self, items: list[tuple[int, bytes]], masks: tuple[str, ...]):
        self.ids = [i for i, _ in items]
        self.words = [np.frombuffer(w, U) for _, w in items]
        self.used: dict[int, str] = {}
        found, item, at = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, words in enumerate(self.words):
            for number, mask in masks_of(len(words), masks):
                self.used[number] = mask
                seeds = seed_hashes(words, mask, number)
                found.append(seeds)
                item.append(np.full(len(seeds), i))
                at.append(np.arange(len(seeds)))
        seeds = np.concatenate(found)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item, self.at = seeds[order], np.concatenate(item)[order], np.concatenate(at)[order]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.all_words = np.concatenate([np.zeros(0, U), *self.words])
        self.shift = U(64 - min(24, max(10, (16 * len(seeds)).bit_length())))
        self.first_bits = np.zeros(1 << (64 - int(self.shift)), dtype=bool)  # most words of a text have no seed's first bits
        self.first_bits[self.seeds >> self.shift] = True

    def diagonals(self, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (text, item, diagonal), each once, on which some place of a text has a seed of the item.

        Pairs of a place and an item place are made ``COMPARED`` at a time and become diagonals at once, so a word that
        repeats in a text and in an item costs memory by its diagonals, not by its pairs."""
        longest = int(self.lengths.max(initial=0))
        begins = offsets + longest * np.arange(1, len(offsets) + 1)  # of each text's diagonals in one row of numbers
        span = int(begins[-1])
        found = np.zeros(0, np.int64)
        for number, mask in self.used.items():
            seeds = seed_hashes(hashes, mask, number)
            place = np.flatnonzero(self.first_bits[seeds >> self.shift])
            low = np.minimum(np.searchsorted(self.seeds, seeds[place]), len(self.seeds) - 1)
            same = self.seeds[low] == seeds[place]
            place, low = place[same], low[same]
            text = np.searchsorted(offsets, place, "right") - 1
            inside = place + len(mask) <= offsets[text + 1]  # windows do not run into the next text
            place, text, low = place[inside], text[inside], low[inside]
            n = np.searchsorted(self.seeds, seeds[place], "right") - low
            done = np.cumsum(n) - n  # pairs before each place
            for first in range(0, int(n.sum()), COMPARED):
                pair = np.arange(first, min(first + COMPARED, int(n.sum())))
                of = np.searchsorted(done, pair, "right") - 1
                which = low[of] + pair - done[of]
                line = begins[text[of]] + place[of] - offsets[text[of]] - self.at[which]
                found = np.union1d(found, self.item[which] * span + line)
        item, line = found // span, found % span
        text = np.searchsorted(begins - longest, line, "right") - 1
        return np.stack([text, item, line - begins[text]], axis=1)

    def enough(self, lines: np.ndarray, hashes: np.ndarray, offsets: np.ndarray, needed: np.ndarray) -> np.ndarray:
        """The diagonals on which at least the ``needed`` words of the item are equal."""
        if not len(lines):
            return lines
        text, item, diagonal = lines.T
        low = np.maximum(0, -diagonal)
        n = np.minimum(self.lengths[item], offsets[text + 1] - offsets[text] - diagonal) - low
        good = np.zeros(len(text), dtype=bool)
        block = np.cumsum(n) // COMPARED
        for rows in np.split(np.arange(len(text)), np.flatnonzero(np.diff(block)) + 1):
            begin = np.cumsum(n[rows]) - n[rows]
            place = np.arange(n[rows].sum())
            own = np.repeat(offsets[text[rows]] + low[rows] + diagonal[rows] - begin, n[rows]) + place
            other = np.repeat(self.starts[item[rows]] + low[rows] - begin, n[rows]) + place
            good[rows] = np.add.reduceat((hashes[own] == self.all_words[other]).astype(np.int64), begin) >= needed[item[rows]]
        return lines[good]


def mask_places(equal: np.ndarray, masks: list[tuple[int, str]]) -> np.ndarray:
    """The places of one diagonal at which some mask finds all its words equal, in order."""
    hit = np.zeros(len(equal), dtype=bool)
    for _, mask in masks:
        n = len(equal) - len(mask) + 1
        if n > 0:
            hit[:n] |= np.logical_and.reduce([equal[k : k + n] for k, used in enumerate(mask) if used == "1"])
    return np.flatnonzero(hit)


def aligned_run(equal: np.ndarray, hit: int, min_share: float) -> tuple[int, int]:
    """The run with most equal words (then the longest) that holds place ``hit``, starts and ends with an equal word and
    has ``min_share`` equal words.

    Ends are tried from the far side, so mismatches inside are crossed as long as the share allows it."""
    total = np.concatenate([[0], np.cumsum(equal)])
    lows = np.flatnonzero(equal[: hit + 1])
    highs = np.flatnonzero(equal[hit:]) + hit + 1
    if not len(lows) or not len(highs):
        return hit, hit
    best = (hit, hit)
    for low in lows:
        good = highs[total[highs] - total[low] >= min_share * (highs - low)]
        if len(good):
            best = max(best, (int(low), int(good[-1])), key=lambda r: (total[r[1]] - total[r[0]], r[1] - r[0]))
    return best


def _overlaps(held, masks: tuple[str, ...], min_words: int, min_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = held.value
        needed = np.array([words_needed(n, min_words, min_share) for n in seeds.lengths.tolist()], np.int64)
        for batch in slabs(released(batches), "text", SLAB_BYTES):
            hashes, offsets = plain_words(batch.column(1))
            kept = []
            for text, item, diagonal in seeds.enough(seeds.diagonals(hashes, offsets), hashes, offsets, needed).tolist():
                words, own = seeds.words[item], hashes[offsets[text] : offsets[text + 1]]
                low, high = max(0, -diagonal), min(len(words), len(own) - diagonal)
                equal = words[low:high] == own[low + diagonal : high + diagonal]
                covered = 0
                for at in mask_places(equal, masks_of(len(words), masks)).tolist():
                    if at < covered:
                        continue
                    a, b = aligned_run(equal, at, min_share)
                    same = int(equal[a:b].sum())
                    if same >= needed[item]:
                        covered = b
                        start = diagonal + low + a
                        kept.append((text, seeds.ids[item], start, start + b - a, same))
            kept = list(dict.fromkeys(kept))
            place = pa.array([k[0] for k in kept], pa.int64())
            columns = [batch.column(0).take(place), *[pa.array([k[i] for k in kept], pa.int64()) for i in range(1, 5)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "start_word", "end_word", "n_equal"])

    return run


def overlaps(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, held_seeds: int = HELD_SEEDS) -> DataFrame:
    """``doc_id, item_id, start_word, end_word, n_equal``: every verified overlap, in words of the document.

    Tasks hold the seeds of the benchmark; their number is counted first, and a benchmark with more than ``held_seeds``
    is taken in blocks of items, one pass over the documents per block."""
    spark = documents.sparkSession
    docs = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{text}`").alias("text"))
    items = items.mapInArrow(_item_words, "item_id long, words binary").where("length(words) > 0")
    n_seeds = items.agg(F.sum(F.length("words") / 8 * len(masks))).first()[0] or 0
    blocks = max(1, math.ceil(n_seeds / held_seeds))
    kind, parts = "doc_id long, item_id long, start_word long, end_word long, n_equal long", []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block).toLocalIterator()
        seeds = Seeds(sorted(((r.item_id, bytes(r.words)) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])), masks)
        if len(seeds.seeds):
            found = docs.mapInArrow(_overlaps(spark.sparkContext.broadcast(seeds), masks, min_words, min_share), kind)
            parts.append(found if blocks == 1 else store.stored(found, "overlaps"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kind)


def contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, n_overlaps, n_equal`` (words of the widest overlap) of each contaminated pair."""
    found = overlaps(documents, benchmark, **options)
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_overlaps"), F.max("n_equal").alias("n_equal"))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` without a verified overlap; rows with a null id stay."""
    bad = overlaps(documents, benchmark, **options).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_bad")).distinct()
    return documents.join(bad, F.col("doc_id") == F.col("_bad"), "left_anti")


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
