"""Token-ID output: texts encoded by a public tokenizer, written as Parquet list columns and read back selectively.

Rows are put in ascending document order by ranges, encoded, and written with bounded row groups and pages (Parquet
keeps the column and offset index of each page).  Token ids use dictionary pages, numbers such as ids, counts and
positions delta pages.  A reader takes whole columns, or the documents of a range, without the token pages of others.

Encoding works on chunks: a run of white space and the word after it.  The pre-tokenizer of the byte-level vocabulary
never joins bytes across the start of such a chunk, so distinct chunks are encoded once per task and put together.
Texts with white space outside ASCII are encoded whole, and so are texts that spell a special token: the ids are those
of the library's plain call, which takes such a spelling for the token.  ``special=False`` makes it ordinary text.

Defined results: a null text is an empty one, its only token is the end id.  Rows with equal document ids stay
neighbours in the order of their texts, a null id comes first.  An empty table gives an empty file set.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticewindows.llm import store
from noticewindows.llm.textblocks import WHITE, slabs, span_hashes, text_bytes

END_ID = 2
SLAB_BYTES = 1 << 20
BATCH = 2_000  # chunks that the library encodes at once
CACHE_BYTES = 64 << 20  # of the chunks that a worker remembers; beyond that it starts anew
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10

# White space that is not one of the six ASCII blanks, and the separators that some patterns count as such.
ODD_SPACE = re.compile(
    "|".join("\x1c \x1d \x1e \x1f \x85 \xa0 \u1680 \u2000 \u2001 \u2002 \u2003 \u2004 \u2005 \u2006 \u2007 \u2008 \u2009 \u200a \u2028 \u2029 \u202f \u205f \u3000".split(" ")).encode()
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkEncoder:
    """Encodes text columns with a tokenizer file, distinct chunks once.

    With ``special`` the spelling of a special token in a text is that token, as in a plain call of the library."""

    def __init__(self, vocabulary: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = not special
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.whole = [t.content.encode() for t in added if t.content and (special or not t.special)]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flats, sizes = [], []
        for at in range(0, len(pieces), BATCH):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[at : at + BATCH], add_special_tokens=False)]
            size = np.fromiter((len(x) for x in found), np.int64, len(found))
            flats.append(np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())))
            sizes.append(size)
        return np.concatenate(flats), np.concatenate(sizes)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Add sorted new ``keys`` to the sorted known ones."""
        flat, size = self._encode(pieces)
        place = len(self.flat) + np.cumsum(size) - size
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place, self.size = np.insert(self.keys, at, keys), np.insert(self.place, at, place), np.insert(self.size, at, size)
        self.flat = np.concatenate([self.flat, flat])

    def _starts(self, data: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Where the chunks start: at every text, and at a blank after something solid."""
        solid = ~WHITE[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = solid[:-1] & ~solid[1:] if len(data) else False
        cut[where] = True
        cut[len(data)] = False
        starts = np.flatnonzero(cut)
        raw = data.tobytes()
        spots = [m.start() for m in ODD_SPACE.finditer(raw)]
        for spelling in self.whole:
            at = raw.find(spelling)
            while at >= 0:
                spots.append(at)
                at = raw.find(spelling, at + 1)
        odd = np.unique(np.searchsorted(where, np.array(spots, np.int64), "right") - 1)
        keep = np.ones(len(starts), dtype=bool)
        for i in odd:  # such a text is one chunk
            a, b = np.searchsorted(starts, (where[i], where[i + 1]))
            keep[a + 1 : b] = False
        return starts[keep]

    def encode(self, column: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of the texts, each text followed by ``end_id``, and the n + 1 offsets."""
        data, where = text_bytes(column)
        return self.encode_bytes(data, where, self._starts(data, where), end_id)

    def encode_bytes(self, data: np.ndarray, where: np.ndarray, starts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        ends = np.append(starts[1:], len(data))[: len(starts)]
        keys, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if 24 * len(self.keys) + 4 * len(self.flat) > CACHE_BYTES:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(keys[new], [data[starts[k] : ends[k]].tobytes().decode("utf-8") for k in first[new]])
            at = np.searchsorted(self.keys, keys)
        place, size, flat, order = self.place[at], self.size[at], self.flat, inverse
        chunks = np.searchsorted(starts, where)  # the first chunk of each text
        if end_id is not None:  # one more chunk after the last of each text
            place, size, flat = np.append(place, len(flat)), np.append(size, 1), np.append(flat, np.int32(end_id))
            order = np.insert(inverse, chunks[1:], len(keys))
            chunks = chunks + np.arange(len(chunks))
        sizes = size[order]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(place[order] - before[:-1], sizes) + np.arange(int(before[-1]))]
        return ids.astype(np.int32), before[chunks].astype(np.int64)


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def chunk_encoder(vocabulary: str, special: bool = True) -> ChunkEncoder:
    """One encoder per worker process: later tasks of the worker know the chunks of earlier ones."""
    if (vocabulary, special) not in _ENCODERS:
        _ENCODERS[vocabulary, special] = ChunkEncoder(vocabulary, special)
    return _ENCODERS[vocabulary, special]


def _encoder(vocabulary: str, end_id: int, text: str, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, done = chunk_encoder(vocabulary, special), TaskContext.get().partitionId(), 0
        for batch in slabs(batches, text, SLAB_BYTES):
            place = batch.schema.get_field_index(text)
            ids, offsets = encoder.encode(batch.column(place), end_id)
            n = np.diff(offsets)
            kept = [(batch.schema.field(i), batch.column(i)) for i in range(batch.num_columns) if i != place]
            made = [
                ("part", pa.array(np.full(len(n), part, np.int32))),
                ("part_start", pa.array(done + offsets[:-1])),
                ("n_tokens", pa.array(n)),
                ("ids", pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))),
            ]
            done += int(offsets[-1])
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [c for _, c in made], names=[f.name for f, _ in kept] + [k for k, _ in made])

    return run


def encode(df: DataFrame, order: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = (), vocabulary: str | None = None, end_id: int = END_ID, parts: int | None = None, special: bool = True) -> DataFrame:
    """One row per row of ``df`` in ascending ``order``: ``part``, ``part_start`` (ids before it in its part),
    ``n_tokens`` and ``ids``.  ``parts`` ranges of rows become as many files."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = df.select(F.col(f"`{order}`").alias("doc_id"), *[F.col(f"`{c}`") for c in metadata], F.col(f"`{text}`").alias("_text"))
    ranged = kept.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "_text")
    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "_text"]
    schema = ", ".join([*given, "part int, part_start long, n_tokens long, ids array<int>"])
    return ranged.mapInArrow(_encoder(vocabulary or default_vocabulary(), end_id, "_text", special), schema)


def write(encoded: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Write encoded rows: dictionary pages for the ids, delta pages for numbers, indexed pages of bounded size."""
    writer = encoded.write.option("compression", "zstd").option("parquet.writer.version", "v2")
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    writer = writer.option("parquet.enable.dictionary", "true")
    for column in ("doc_id", "part_start", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "ids"), low: int | None = None, high: int | None = None) -> DataFrame:
    """Chosen columns of chosen documents; the range is pushed to row groups and pages."""
    files = spark.read.parquet(path)
    if low is not None:
        files = files.where(F.col("doc_id") >= low)
    if high is not None:
        files = files.where(F.col("doc_id") <= high)
    return files.select(*columns)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        offsets = lists.offsets.to_numpy()
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        keep = [i for i, f in enumerate(batch.schema) if f.name != "ids"]
        columns = [batch.column(i) for i in keep] + [pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.field(i).name for i in keep] + ["ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``.

    The totals that are broadcast have one row per part; the number of parts is a parameter of ``encode``."""
    rows = read(spark, path, ("doc_id", "part", "part_start", "n_tokens", "ids"))
    totals = read(spark, path, ("part", "n_tokens")).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.sum("total").over(earlier).alias("before"))
    crc = rows.mapInArrow(_crc, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    start = F.coalesce(F.col("before"), F.lit(0)) + F.col("part_start")
    return crc.join(F.broadcast(before), "part").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = store.fresh_folder(spark, "token-files")
    write(encode(documents), path)
    return digest(spark, path)
