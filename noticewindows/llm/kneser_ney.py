"""Scoring of texts by an interpolated modified Kneser-Ney model of word pairs, counted in Spark.

The model lives in the shared folder as sorted arrays that scoring tasks map into memory; nothing of it passes through
the driver but counts of counts, whatever the corpus.  Three grouped passes build it:

1. word hashes and counts, dealt by ranges of the hash: sorted key arrays whose position is the word's number;
2. word pairs as numbers, dealt by a hash of the first word, and by both words where the first is frequent, so that a
   frequent word is split: sorted pair arrays with counts;
3. what pass 2 found for single words, dealt by number: how many different pairs start with the word (with count one,
   two, more), and how many different words stand before it.

Every task first sums what it has read, slab by slab, and sends one sorted array per target.

The order is two: arrays of word triples of a corpus would need more disk than the corpus itself.

    p(w | v) = max(c(vw) - D, 0) / c(v) + g(v) * p(w),   p(w) = max(a(w) - D', 0) / A + g' / (V + 1)

with a(w) the number of different words before w, and the discounts D, D' of one, two and more from counts of counts.
A text starts after a start mark that is no token and ends with an end token.  An unknown word has a(w) = 0.

Defined results: a null text is empty and has the end token only; a row with a null id counts as one to learn from.
Repeated rows count again.  Without any training row every token has probability one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewindows.llm import store
from noticewindows.llm.textblocks import U, Words, mix, slabs

SLAB_BYTES = 3 << 20
START, END = U(0x5354415254), U(0x454E44)  # hashes of the two marks, far from those of words
FREQUENT = 1 / 1000  # words with this share of all tokens are split in pass 2


class SharedArrays:
    """Named arrays below a folder that all machines reach; mapped straight from a mounted path, else from a copy that
    is unlinked at once."""

    def __init__(self, uri: str):
        self.uri = uri

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri if "://" in self.uri else "file://" + os.path.abspath(self.uri))

    def write(self, name: str, data: np.ndarray) -> None:
        """Written under another name first: a task that runs twice leaves one whole file."""
        files, root = self._open()
        files.create_dir(root, recursive=True)
        part = f"{root}/{name}.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            out.write(np.ascontiguousarray(data).view(np.uint8).data)
        files.move(part, f"{root}/{name}")

    def read(self, name: str, kind: str) -> np.ndarray:
        files, root = self._open()
        if files.get_file_info(f"{root}/{name}").size in (None, 0):
            return np.zeros(0, kind)
        if isinstance(files, fs.LocalFileSystem):
            return np.memmap(f"{root}/{name}", dtype=kind, mode="r")
        with tempfile.NamedTemporaryFile() as copy:
            with files.open_input_stream(f"{root}/{name}") as source:
                while block := source.read(1 << 24):
                    copy.write(block)
            copy.flush()
            return np.memmap(copy.name, dtype=kind, mode="r")


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with the end token after each text, and the n + 1 offsets; words are lower-cased (A-Z)."""
    words = Words(column, lower=True)
    return np.insert(words.hashes, words.offsets[1:], END), words.offsets + np.arange(len(words.offsets))


def _before(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The token before each token, the start mark before the first of a text."""
    out = np.empty_like(hashes)
    out[1:] = hashes[:-1]
    out[offsets[:-1]] = START
    return out


def _range_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((keys >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


def _rows(target: np.ndarray, parts: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per target with the bytes of its part of each column; input order is kept."""
    order = np.argsort(target, kind="stable")
    cuts = np.searchsorted(target[order], np.arange(parts + 1))
    used = np.flatnonzero(np.diff(cuts))
    arrays = [pa.array(used.astype(np.int32))]
    for values in columns.values():
        values = np.ascontiguousarray(values[order])
        arrays.append(pa.array([values[cuts[i] : cuts[i + 1]].tobytes() for i in used], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["part", *columns])


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct sorted keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(v[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for v in values]
    return [keys[first], *sums]


def _per_part(reduce_part: Callable[[int, list[dict]], dict], schema: pa.Schema):
    """Run ``reduce_part(part, rows)`` on the rows of each part, which arrive sorted by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    yield pa.RecordBatch.from_pylist([reduce_part(held[0]["part"], held)], schema=schema)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([reduce_part(held[0]["part"], held)], schema=schema)

    return run


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "part").sortWithinPartitions("part")


def _joined(rows: list[dict], column: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[column], kind) for r in rows])


class Vocabulary:
    """The sorted word keys in ranges; the number of a word is its place in all of them."""

    def __init__(self, arrays: SharedArrays, sizes: list[int]):
        self.arrays, self.parts = arrays, len(sizes)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.held: dict[str, np.ndarray] = {}

    def part(self, kind: str, part: int, dtype: str) -> np.ndarray:
        if (name := f"{kind}-{part}") not in self.held:
            self.held[name] = self.arrays.read(name, dtype)
        return self.held[name]

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of sorted keys, -1 where unknown."""
        out = np.full(len(keys), -1, np.int64)
        cuts = np.searchsorted(_range_of(keys, self.parts), np.arange(self.parts + 1))
        for part in range(self.parts):
            mine, own = keys[cuts[part] : cuts[part + 1]], self.part("words", part, "u8")
            if len(mine) and len(own):
                at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                out[cuts[part] : cuts[part + 1]] = np.where(own[at] == mine, at + self.first[part], -1)
        return out

    def values(self, kind: str, numbers: np.ndarray) -> np.ndarray:
        """The values of sorted numbers (none of them -1)."""
        out = np.zeros(len(numbers), np.int64)
        cuts = np.searchsorted(numbers, self.first)
        for part in range(self.parts):
            mine = numbers[cuts[part] : cuts[part + 1]]
            if len(mine):
                out[cuts[part] : cuts[part + 1]] = self.part(kind, part, "i8")[mine - self.first[part]]
        return out


def _pair_part(v: np.ndarray, w: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """Where a pair is kept: by its first word, by both if that is frequent."""
    spread = mix(v.astype(U) + U(1))
    if len(hot):
        split = hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v
        spread = np.where(split, mix(spread ^ mix(w.astype(U) + U(7))), spread)
    return _range_of(spread, parts)


def _word_counts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "text", SLAB_BYTES):
            hashes, offsets = tokens(batch.column(0))
            keys, counts = np.unique(np.append(hashes, np.full(len(offsets) - 1, START)), return_counts=True)
            yield _rows(_range_of(keys, parts), parts, {"keys": keys, "counts": counts.astype(np.int32)})

    return run


def _write_words(arrays: SharedArrays):
    def reduce_part(part: int, rows: list[dict]) -> dict:
        keys, counts = _summed(_joined(rows, "keys", "u8"), _joined(rows, "counts", "i4"))
        arrays.write(f"words-{part}", keys)
        arrays.write(f"count-{part}", counts)
        top = np.argsort(-counts, kind="stable")[:64]
        starts = int(counts[keys == START].sum())
        return {"part": part, "words": len(keys), "tokens": int(counts.sum()) - starts, "starts": starts, "top": top.tolist(), "top_counts": counts[top].tolist()}

    return reduce_part


def _pair_counts(arrays: SharedArrays, sizes: list[int], hot: np.ndarray, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(arrays, sizes)
        for batch in slabs(batches, "text", SLAB_BYTES):
            hashes, offsets = tokens(batch.column(0))
            keys, inverse = np.unique(np.append(hashes, START), return_inverse=True)
            numbers = words.numbers(keys)[inverse]
            w = numbers[:-1]
            v = np.empty_like(w)
            v[1:] = w[:-1]
            v[offsets[:-1]] = numbers[-1]
            pairs, counts = np.unique(v * words.first[-1] + w, return_counts=True)
            target = _pair_part(pairs // words.first[-1], pairs % words.first[-1], hot, parts)
            yield _pair_rows(target, parts, pairs, counts)

    return run


def _pair_rows(target: np.ndarray, parts: int, pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sorted pairs of each target as steps from one to the next, in four bytes where they fit."""
    order = np.argsort(target, kind="stable")
    pairs, counts = pairs[order], counts[order].astype(np.int32)
    cuts = np.searchsorted(target[order], np.arange(parts + 1))
    used = np.flatnonzero(np.diff(cuts))
    first, steps, wide, many = [], [], [], []
    for i in used:
        own = pairs[cuts[i] : cuts[i + 1]]
        step = np.diff(own)
        big = bool(len(step)) and int(step.max()) >= 1 << 32
        first.append(int(own[0]))
        wide.append(big)
        steps.append(step.astype(np.int64 if big else np.uint32).tobytes())
        many.append(counts[cuts[i] : cuts[i + 1]].tobytes())
    columns = [pa.array(used.astype(np.int32)), pa.array(first, pa.int64()), pa.array(wide, pa.bool_()), pa.array(steps, pa.binary()), pa.array(many, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "first", "wide", "steps", "counts"])


def _write_pairs(arrays: SharedArrays, n_words: int, sizes: list[int]):
    ranges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def by_number(numbers: np.ndarray, values: list[np.ndarray]) -> list[dict]:
        cuts = np.searchsorted(numbers, ranges)
        return [
            {"target": i, "numbers": numbers[a:b].astype(np.int64).tobytes(), "values": np.stack([v[a:b] for v in values], axis=1).astype(np.int32).tobytes()}
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
            if b > a
        ]

    def reduce_part(part: int, rows: list[dict]) -> dict:
        pairs = np.concatenate([r["first"] + np.concatenate([[0], np.cumsum(np.frombuffer(r["steps"], np.int64 if r["wide"] else np.uint32).astype(np.int64))]) for r in rows])
        pairs, counts = _summed(pairs, _joined(rows, "counts", "i4"))
        arrays.write(f"pairs-{part}", pairs)
        arrays.write(f"pair-counts-{part}", counts.astype(np.uint32))
        kinds = [(counts == 1), (counts == 2), (counts >= 3)]
        of_counts = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        del counts
        first = pairs // n_words  # in order already
        change = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        ahead = by_number(first[change], [np.add.reduceat(k, change, dtype=np.int64) for k in kinds])
        del first, kinds
        w, behind = np.unique(pairs % n_words, return_counts=True)
        return {"part": part, "of_counts": of_counts, "ahead": ahead, "behind": by_number(w, [behind])}

    return reduce_part


def _write_words_again(arrays: SharedArrays, sizes: list[int]):
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def reduce_part(part: int, rows: list[dict]) -> dict:
        table = np.zeros((sizes[part], 4), np.int64)
        for r in rows:
            at = np.frombuffer(r["numbers"], np.int64) - first[part]
            values = np.frombuffer(r["values"], np.int32).reshape(len(at), -1)
            if r["ahead"]:
                table[at, :3] += values
            else:
                table[at, 3] += values[:, 0]
        for k, name in enumerate(("one", "two", "more", "behind")):
            arrays.write(f"{name}-{part}", table[:, k])
        behind = table[:, 3]
        return {"part": part, "of_counts": [int((behind == k).sum()) for k in (1, 2, 3, 4)], "more": int((behind >= 3).sum()), "total": int(behind.sum())}

    return reduce_part


def discounts(of_counts: list[int]) -> tuple[float, float, float]:
    """The discounts of counts one, two and more from the numbers of n-grams with count 1 to 4."""
    n1, n2, n3, n4 = of_counts
    if n1 == 0 or n2 == 0:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.1 * (k + 1)), 0.9 * (k + 1)) for k, x in enumerate(d))


class Model:
    """What tasks need besides the arrays: sizes, totals and discounts."""

    def __init__(self, uri: str, sizes: list[int], pair_parts: int, hot: list[int], n_tokens: int, n_types: int, of_pairs: list[int], of_words: list[int], more: int, total: int):
        self.uri, self.sizes, self.pair_parts, self.hot = uri, sizes, pair_parts, np.array(hot, np.int64)
        self.n_tokens, self.n_types, self.total = n_tokens, n_types, total
        self.pair_discount = np.array([0.0, *discounts(of_pairs)])
        self.word_discount = np.array([0.0, *discounts(of_words)])
        held = self.word_discount[1] * of_words[0] + self.word_discount[2] * of_words[1] + self.word_discount[3] * more
        self.word_rest = held / total if total else 1.0


class Scorer:
    def __init__(self, model: Model):
        self.model, self.arrays = model, SharedArrays(model.uri)
        self.words = Vocabulary(self.arrays, model.sizes)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _of_words(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        """What the model knows of sorted distinct words."""
        numbers = self.words.numbers(keys)
        known = np.flatnonzero(numbers >= 0)
        out = {"number": numbers}
        for name in ("count", "one", "two", "more", "behind"):
            out[name] = np.zeros(len(keys), np.int64)
            out[name][known] = self.words.values(name, numbers[known])
        return out

    def _pair_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v), np.int64)
        place = np.flatnonzero((v >= 0) & (w >= 0))
        if not len(place):
            return out
        pair = v[place] * self.words.first[-1] + w[place]
        part = _pair_part(v[place], w[place], self.model.hot, self.model.pair_parts)
        order = np.lexsort((pair, part))
        cuts = np.searchsorted(part[order], np.arange(self.model.pair_parts + 1))
        for i in range(self.model.pair_parts):
            mine = order[cuts[i] : cuts[i + 1]]
            if not len(mine):
                continue
            if i not in self.held:
                self.held[i] = self.arrays.read(f"pairs-{i}", "i8"), self.arrays.read(f"pair-counts-{i}", "u4")
            keys, counts = self.held[i]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, pair[mine]), len(keys) - 1)
                out[place[mine]] = np.where(keys[at] == pair[mine], counts[at], 0)
        return out

    def score(self, hashes: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """Per text: ``n_tokens``, ``n_known``, ``base_score`` and ``score`` (log10)."""
        m = self.model
        keys, inverse = np.unique(np.append(hashes, START), return_inverse=True)
        of = self._of_words(keys)
        behind = of["behind"]
        alone = (behind - m.word_discount[np.minimum(behind, 3)]) / max(m.total, 1) + m.word_rest / (m.n_types + 1)
        w, start = inverse[:-1], inverse[-1]
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[offsets[:-1]] = start
        pairs, which = np.unique(v * len(keys) + w, return_inverse=True)
        pv, pw = pairs // len(keys), pairs % len(keys)
        count = self._pair_counts(of["number"][pv], of["number"][pw])
        context = of["count"][pv]
        rest = (m.pair_discount[1] * of["one"] + m.pair_discount[2] * of["two"] + m.pair_discount[3] * of["more"])[pv]
        seen = np.maximum(context, 1)
        p = np.where(context > 0, (count - m.pair_discount[np.minimum(count, 3)]) / seen + rest / seen * alone[pw], alone[pw])
        with np.errstate(divide="ignore"):
            logs = np.log10(p)[which]
            base = np.log10((of["count"] + 1) / (m.n_tokens + m.n_types + 1))[w]
        known = (of["count"] > 0)[w].astype(np.int64)
        at = offsets[:-1]
        add = lambda x: np.add.reduceat(x, at) if len(at) else x[:0]
        return {"n_tokens": np.diff(offsets), "n_known": add(known), "base_score": add(base), "score": add(logs)}


def train(texts: DataFrame, text: str = "text", parts: int | None = None) -> Model:
    """Count the model of all rows of ``texts`` into a new folder of the shared folder."""
    spark = texts.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    arrays = SharedArrays(store.fresh_folder(spark, "kneser-ney"))
    rows = texts.select(F.col(f"`{text}`").alias("text"))

    counted = rows.mapInArrow(_word_counts(parts), "part int, keys binary, counts binary")
    schema = pa.schema([("part", pa.int32()), ("words", pa.int64()), ("tokens", pa.int64()), ("starts", pa.int64()), ("top", pa.list_(pa.int64())), ("top_counts", pa.list_(pa.int64()))])
    kinds = "part int, words long, tokens long, starts long, top array<long>, top_counts array<long>"
    found = {r.part: r for r in _dealt(counted, parts).mapInArrow(_per_part(_write_words(arrays), schema), kinds).collect()}  # a row per part
    sizes = [found[i].words if i in found else 0 for i in range(parts)]
    first = np.concatenate([[0], np.cumsum(sizes)])
    n_tokens, starts = sum(r.tokens for r in found.values()), sum(r.starts for r in found.values())
    hot = sorted(int(first[i] + k) for i, r in found.items() for k, n in zip(r.top, r.top_counts, strict=True) if n > FREQUENT * (n_tokens + starts))
    n_types = int(first[-1]) - (1 if starts else 0)

    paired = rows.mapInArrow(_pair_counts(arrays, sizes, np.array(hot, np.int64), parts), "part int, first long, wide boolean, steps binary, counts binary")
    entry = pa.struct([("target", pa.int32()), ("numbers", pa.binary()), ("values", pa.binary())])
    schema = pa.schema([("part", pa.int32()), ("of_counts", pa.list_(pa.int64())), ("ahead", pa.list_(entry)), ("behind", pa.list_(entry))])
    kind = "array<struct<target: int, numbers: binary, values: binary>>"
    written = _dealt(paired, parts).mapInArrow(_per_part(_write_pairs(arrays, int(first[-1]), sizes), schema), f"part int, of_counts array<long>, ahead {kind}, behind {kind}")
    written = store.stored(written, "kneser-ney-words")
    of_pairs = written.select([F.coalesce(F.sum(F.get("of_counts", F.lit(k))), F.lit(0)) for k in range(4)]).first()

    sides = [written.select(F.explode(side).alias("x")).select(F.col("x.target").alias("part"), "x.numbers", "x.values", F.lit(side == "ahead").alias("ahead")) for side in ("ahead", "behind")]
    schema = pa.schema([("part", pa.int32()), ("of_counts", pa.list_(pa.int64())), ("more", pa.int64()), ("total", pa.int64())])
    again = _dealt(sides[0].unionByName(sides[1]), parts).mapInArrow(_per_part(_write_words_again(arrays, sizes), schema), "part int, of_counts array<long>, more long, total long")
    last = again.collect()  # a row per part
    of_words = [sum(r.of_counts[k] for r in last) for k in range(4)]
    return Model(arrays.uri, sizes, parts, hot, n_tokens, n_types, list(of_pairs), of_words, sum(r.more for r in last), sum(r.total for r in last))


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in slabs(batches, "_text", SLAB_BYTES):
            place = batch.num_columns - 1
            found = scorer.score(*tokens(batch.column(place)))
            kept = [batch.column(i) for i in range(place)]
            made = [pa.array(found["n_tokens"], pa.int64()), pa.array(found["n_known"], pa.int64()), pa.array(found["base_score"]), pa.array(found["score"])]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[f.name for f in batch.schema][:-1] + ["n_tokens", "n_known", "base_score", "score"])

    return run


def score(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``n_tokens, n_known, base_score, score`` and ``perplexity``."""
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    kinds = ", ".join([*given, "n_tokens long, n_known long, base_score double, score double"])
    out = kept.mapInArrow(_score(df.sparkSession.sparkContext.broadcast(model)), kinds)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 7 == 2


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = train(documents.where("NOT held_out"))
    scored = score(documents, model, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
