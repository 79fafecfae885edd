"""Near-duplicate classes by an inverted join of MinHash signature coordinates.

A document is its set of distinct word shingles.  Two documents are linked when their sets overlap by at least the
given share of their union.  The search runs over distinct sets ("nodes"), so exact copies cost one row each:

1. every document gets the size, a 128-bit digest and K MinHash coordinates of its set, in one pass over the text;
2. each (coordinate, value) pair is a posting key.  Two nodes with at least T equal coordinates share one of their
   K - T + 1 rarest keys (prefix merging), so only those are posted.  Keys of one node, and nodes whose prefix holds
   only such keys, are skipped;
3. postings of a key are dealt in chunks of bounded size; a few anchors of the key are in all of them.  A chunk counts
   equal marks (further coordinates, of one byte) and links what reaches the match threshold by a strongest spanning
   forest, not by all pairs;
4. candidate pairs are confirmed on the full sets; confirmed pairs are contracted to components;
5. keys whose nodes fell in more than one component are read again: all pairs of different components that reach the
   threshold and were not tried are confirmed.  Nodes of the component that dominates a long key are not paired with each other.

A pair of similarity s is missed if fewer than T of K coordinates or fewer than 275 of 384 marks agree: for K = 48,
T = 27 and s = 0.8 that is about 5 in 100,000, and less for closer pairs and for groups, where one of many links is enough.

Defined results: null and blank texts have an empty set, are linked with nothing and are their own class; rows with a
null id have a null class and are kept; rows with the same id and text are one document.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewindows.llm import store
from noticewindows.llm.components import connected
from noticewindows.llm.textblocks import Words, mix, released, shingles, slabs

COORDINATES = 48
SHARED_KEYS = 27  # T: equal coordinates of a pair that is looked at
MARKS = 384  # further coordinates, of 8 bits, that are counted for the pairs that meet
MATCHES = 275  # equal ones of a candidate
CHUNK = 256
ANCHORS = 3  # nodes of a key that every chunk of it sees, so that chunks of one group meet
SLAB_BYTES = 2 << 20
BROADCAST_IDS = 2_000_000  # ids of documents to look at again that are broadcast (16 MB); more are joined by shuffle

_RANDOM = np.random.RandomState(20)
_NUMBERS = _RANDOM.randint(1, 2**63 - 1, (2, COORDINATES + MARKS), dtype=np.int64).astype(np.uint64)
FLIPS, MULTIPLIERS = _NUMBERS[0], _NUMBERS[1] | np.uint64(1)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    return np.unique(shingles(hashes, size))


def set_digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def smallest(found: np.ndarray, low: int, high: int) -> np.ndarray:
    """Coordinates ``low`` to ``high``: the smallest shingle under each order, mixed with the number of the order."""
    least = np.full(high - low, np.uint64(2**64 - 1))
    for at in range(0, len(found), 2048):
        least = np.minimum(least, ((found[at : at + 2048, None] ^ FLIPS[low:high]) * MULTIPLIERS[low:high]).min(axis=0))
    return mix(least ^ FLIPS[low:high])


def marks_of(found: np.ndarray) -> np.ndarray:
    return smallest(found, COORDINATES, COORDINATES + MARKS).astype(np.uint8)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(released(batches), "text", SLAB_BYTES):
            words = Words(batch.column(batch.schema.get_field_index("text")), lower=True)
            counts, digests, tokens = [], [], []
            for i in range(len(words)):
                found = shingle_set(words.hashes[words.offsets[i] : words.offsets[i + 1]], size)
                counts.append(len(found))
                digests.append(set_digest(found) if len(found) else None)
                tokens.append(smallest(found, 0, COORDINATES).tobytes() if len(found) else None)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "signature"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signature bytes to posting keys."""
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), COORDINATES)), pa.array(keys)], names=["node", "key"])


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of equal ``by`` values in sorted input; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(batch.num_rows, dtype=bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(v[a] for v in values)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, MARKS)


def _equal_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)), dtype=np.int16)
    for i, row in enumerate(a):
        out[i] = np.count_nonzero(b == row, axis=1)
    return out


def _forest(nodes: np.ndarray, marks: np.ndarray) -> list[tuple[int, int]]:
    """A strongest spanning forest of the pairs with at least MATCHES equal coordinates."""
    nodes, first = np.unique(nodes, return_index=True)  # an anchor may be in its own chunk
    marks = marks[first]
    counts = _equal_counts(marks, marks)
    counts[counts < MATCHES] = -1
    np.fill_diagonal(counts, -1)
    inside = np.zeros(len(nodes), dtype=bool)
    best, link, edges = np.full(len(nodes), -1, np.int16), np.zeros(len(nodes), np.int64), []
    for _ in range(len(nodes)):
        at = int(np.argmax(np.where(inside, -2, best)))
        if best[at] > 0:
            edges.append((int(nodes[link[at]]), int(nodes[at])))
        inside[at] = True
        closer = counts[at] > best
        best[closer], link[closer] = counts[at][closer], at
    return edges


def _pairs(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    flat = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(flat.min(axis=1) if len(flat) else flat[:, 0]), pa.array(flat.max(axis=1) if len(flat) else flat[:, 1])], names=["a", "b"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges: set[tuple[int, int]] = set()
    for group in _groups(batches, ("key", "chunk")):
        if group.num_rows < 2:
            continue
        edges.update(tuple(sorted(e)) for e in _forest(group["node"].to_numpy(), _matrix(group["marks"])))
        if len(edges) > 100_000:
            yield _pairs(list(edges))
            edges = set()
    yield _pairs(list(edges))


def _first_common(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest key that the rows ``a`` and ``b`` of ``keys`` (padded by the largest number) have in common."""
    out, none = [np.zeros(0, np.int64)], np.iinfo(np.int64).max
    for at in range(0, len(a), 4096):
        x, y = keys[a[at : at + 4096]], keys[b[at : at + 4096]]
        out.append(np.where((x[:, :, None] == y[:, None, :]).any(axis=2), x, none).min(axis=1))
    return np.concatenate(out)


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in a chunk: its own rows, and rows of rarer components of the whole key.

    A pair is reported by the smallest of the keys that both post, and by the smaller node where both are rare."""
    for group in _groups(batches, ("key", "chunk", "part")):
        guest = group["guest"].to_numpy(zero_copy_only=False).astype(bool)
        a, b = np.flatnonzero(guest), np.flatnonzero(~guest)
        if not len(a) or not len(b):
            continue
        key, node, comp, marks = group["key"][0].as_py(), group["node"].to_numpy(), group["comp"].to_numpy(), _matrix(group["marks"])
        rare = group["rare"].to_numpy(zero_copy_only=False).astype(bool)
        lists = group["keys"].to_pylist()
        keys = np.full((len(lists), max(map(len, lists))), np.iinfo(np.int64).max)
        for i, own in enumerate(lists):
            keys[i, : len(own)] = own
        for at in range(0, len(a), 256):
            rows = a[at : at + 256]
            hit = (comp[rows][:, None] != comp[b][None, :]) & ~(rare[b][None, :] & (node[rows][:, None] > node[b][None, :]))
            hit &= _equal_counts(marks[rows], marks[b]) >= MATCHES
            i, j = np.nonzero(hit)
            i, j = rows[i], b[j]
            mine = _first_common(keys, i, j) == key
            if mine.any():
                yield _pairs(list(zip(node[i[mine]].tolist(), node[j[mine]].tolist(), strict=True)))


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(released(batches), "text", SLAB_BYTES):
            words = Words(batch.column(batch.schema.get_field_index("text")), lower=True)
            sets = [shingle_set(words.hashes[words.offsets[i] : words.offsets[i + 1]], size) for i in range(len(words))]
            digests = batch.column(batch.schema.get_field_index("digest")).to_pylist()
            keep = [i for i, s in enumerate(sets) if len(s) and set_digest(s) == digests[i]]
            nodes = batch.column(batch.schema.get_field_index("node")).take(pa.array(keep, pa.int64()))
            marks = pa.array([marks_of(sets[i]).tobytes() for i in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([nodes, marks, pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["node", "marks", "items"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


class _Search:
    """The tables of one search that several steps read."""

    def __init__(self, docs: DataFrame, shingle_words: int, percent: int):
        self.spark, self.docs = docs.sparkSession, docs
        self.shingle_words, self.percent = shingle_words, percent
        signed = docs.mapInArrow(_signatures(shingle_words), "doc_id long, n_shingles long, digest binary, signature binary")
        self.signed = store.stored(signed, "signatures")
        sets = self.signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        nodes = sets.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"))
        self.nodes = store.stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def prefixes(self) -> DataFrame:
        """``node, prefix``: the rarest K - T + 1 keys (``n``: nodes with that key) of each node, unshared keys left out."""
        keys = self.nodes.select("node", "signature").mapInArrow(_keys, "node long, key long")
        shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        own = keys.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
        length = F.size("keys") - (SHARED_KEYS - 1)  # of K keys, K - size are unshared and come first
        return own.where(length > 0).select("node", F.slice("keys", F.lit(1), length).alias("prefix"))

    def sets(self, prefixes: DataFrame) -> DataFrame:
        """``node, marks, items`` (the full set) of the nodes in ``prefixes``, from a second pass over their texts."""
        wanted = store.stored(self.nodes.join(prefixes.select("node"), "node").select("node", "digest", "doc_id"), "wanted")
        named = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        found = self.docs.join(named, "doc_id").select("node", "digest", "text")
        found = found.mapInArrow(_sets(self.shingle_words), "node long, marks binary, items binary")
        return store.stored(found, "sets")

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs whose full sets overlap enough."""
        left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
        joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
        return joined.mapInArrow(_confirm(self.percent), "a long, b long")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``documents``: the class is named by its smallest id."""
    docs = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    search = _Search(docs, shingle_words, percent)
    prefixes = store.stored(search.prefixes(), "prefixes")
    postings = prefixes.select("node", F.explode("prefix").alias("k")).select("node", "k.key", F.ceil(F.col("k.n") / CHUNK).cast("int").alias("chunks"))
    postings = postings.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    sets = search.sets(prefixes)
    marks = sets.select("node", "marks").dropDuplicates(["node"])

    lowest = [F.min(F.struct(F.xxhash64("node", F.lit(i)), "node"))["node"] for i in range(ANCHORS)]
    anchors = postings.where("chunks > 1").groupBy("key", "chunks").agg(F.array_distinct(F.array(*lowest)).alias("anchors"))
    everywhere = anchors.select("key", "chunks", F.explode("anchors").alias("node"))
    everywhere = everywhere.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("chunk"), "node")
    dealt = postings.select("key", "chunk", "node").unionByName(everywhere).join(marks, "node").select("key", "chunk", "node", "marks")
    dealt = dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "node")
    first = store.stored(dealt.mapInArrow(_forests, "a long, b long").distinct(), "pairs")
    links = store.stored(search.confirmed(first, sets), "links")
    comps = connected(links)

    labelled = postings.join(comps.withColumnRenamed("u", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    labelled = store.stored(labelled, "labelled")
    sizes = labelled.groupBy("key", "comp").agg(F.count("*").alias("members"))
    main = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("members", "comp")).alias("main"), F.sum("members").alias("all")).where("comps > 1")
    main = main.select("key", F.col("main.comp").alias("main"), F.ceil((F.col("all") - F.col("main.members")) / CHUNK).cast("int").alias("parts"))
    keys = prefixes.select("node", F.transform("prefix", lambda k: k["key"]).alias("keys"))
    opened = labelled.join(main, "key").join(marks, "node").join(keys, "node").withColumn("rare", F.col("comp") != F.col("main"))
    row = ("node", "comp", "marks", "keys", "rare")
    hosts = opened.select("key", "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *row, F.lit(False).alias("guest"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("chunk")
    part = F.pmod(F.xxhash64("node", "key", F.lit(1)), F.col("parts")).cast("int").alias("part")
    guests = opened.where("rare").select("key", every, part, *row, F.lit(True).alias("guest"))
    crossing = hosts.unionByName(guests).repartition("key", "chunk", "part").sortWithinPartitions("key", "chunk", "part")
    second = crossing.mapInArrow(_crossings, "a long, b long").distinct().join(first, ["a", "b"], "left_anti")
    more = search.confirmed(store.stored(second, "pairs"), sets)
    comps = connected(links.unionByName(more))

    classes = search.nodes.select("node", "digest", "doc_id").join(comps.withColumnRenamed("u", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = classes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    classes = classes.join(lowest, "comp").select("digest", "component_id")
    out = search.signed.join(classes, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each(documents: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` that represent their class; of repeated rows with one id, one stays."""
    classes = near_duplicates(documents, shingle_words=shingle_words, percent=percent)
    kept = classes.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    named = documents.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(documents.where("doc_id IS NULL"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=4, percent=80)


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 1))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b
), classes AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN classes c ON c.doc_id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""
