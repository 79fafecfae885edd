"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over the presence of words and word stems; each model also sees the
log odds of the categories before it.  In training these are out-of-fold predictions: the models of a fold never saw
the row they predict, so a later model learns how far earlier ones can be trusted on new texts.

The chain is fitted on at most ``MAX_LABELLED`` labelled rows, taken by a hash of their id; copies of one text share
the weight of one row.  Scoring reads every whole text.

The last category is the table's own label.  The categories before it have no label of their own: a row has one when it
is labelled toxic and holds one of the category's seed words.

Defined results: null and blank texts have no words and get the prior of the chain; rows without a label are not
fitted; repeated label rows count once each.  Without labelled rows every probability is 0.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewindows.llm.spaced_seeds import plain_spans
from noticewindows.llm.textblocks import U, mix, shingles, slabs, span_hashes

MAX_LABELLED = 8000
MAX_FEATURES = 1024
MIN_WEIGHT = 4.0  # rows with a word, copies counted once, for it to be a feature
MIN_SURPRISE = 3.0  # standard deviations by which a feature must go with the label or against it
FOLDS = 5
THRESHOLD = 0.5
RIDGE = 0.3
ROUNDS = 100
MOMENTUM = 0.9
STEM_BYTES = 5  # the start of a word that is a feature of its own, for inflected forms
COPIES = 9  # coordinates by which copies in the training rows are recognised
SLAB_BYTES = 8 << 20

CATEGORIES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("insult", ("idiot", "moron", "stupid", "clown", "loser")),
    ("contempt", ("trash", "scum", "worthless", "pathetic", "disgusting")),
)
LABEL = "toxic"


def features_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, of their stems, and the offsets of the texts, which hold for both."""
    data, starts, ends, offsets = plain_spans(column)
    stems = span_hashes(data, starts, np.minimum(ends, starts + STEM_BYTES))
    return span_hashes(data, starts, ends), mix(stems ^ U(0x5354454D)), offsets


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, distinct features and a short signature of each row."""
    turn = mix(np.arange(1, COPIES + 1, dtype=U))
    for batch in slabs(batches, "text", SLAB_BYTES):
        hashes, stems, offsets = features_of(batch.column(1))
        words, marks = [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            words.append(np.unique(np.concatenate([hashes[a:b], stems[a:b]])).tobytes())
            runs = shingles(hashes[a:b], 4)
            marks.append((runs[:, None] * (turn | U(1))).min(axis=0).tobytes() if len(runs) else bytes(8 * COPIES))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), pa.array(marks, pa.binary())], names=["label", "words", "marks"])


def _seed_hashes(seeds: tuple[str, ...]) -> np.ndarray:
    return np.sort(features_of(pa.array([" ".join(seeds)]))[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Linear:
    """Ridge logistic regression over a sparse presence matrix and a few dense columns."""

    def __init__(self, n_sparse: int, n_dense: int):
        self.sparse, self.dense, self.bias = np.zeros(n_sparse), np.zeros(n_dense), 0.0

    def logits(self, row: np.ndarray, column: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.sparse[column], minlength=len(dense)) + dense @ self.dense + self.bias

    def fit(self, row: np.ndarray, column: np.ndarray, dense: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Linear:
        """Accelerated gradient steps, each column scaled by its own curvature; deterministic."""
        scale_s = RIDGE + 0.25 * np.bincount(column, weight[row], minlength=len(self.sparse))
        scale_d = RIDGE + 0.25 * (weight[:, None] * dense**2).sum(axis=0)
        scale_b = 0.25 * weight.sum() + 1e-9
        share = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-4, 1 - 1e-4)
        self.bias = float(np.log(share / (1 - share)))
        width = max(1.0, float(np.bincount(row, minlength=len(dense)).max(initial=0)) ** 0.5)
        speed = [np.zeros_like(self.sparse), np.zeros_like(self.dense), 0.0]
        for _ in range(ROUNDS):
            error = weight * (_sigmoid(self.logits(row, column, dense)) - y)
            step = (
                (np.bincount(column, error[row], minlength=len(self.sparse)) + RIDGE * self.sparse) / scale_s / width,
                (dense.T @ error + RIDGE * self.dense) / scale_d / width,
                float(error.sum()) / scale_b / width,
            )
            speed = [MOMENTUM * v - s for v, s in zip(speed, step, strict=True)]
            self.sparse, self.dense, self.bias = self.sparse + speed[0], self.dense + speed[1], self.bias + speed[2]
        return self


class Chain:
    """The features and the models of all categories, in order."""

    def __init__(self, names: list[str], features: np.ndarray, models: list[Linear]):
        self.names, self.features, self.models = names, features, models

    def matrix(self, hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) pairs of word hashes."""
        if not len(self.features) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        hit = self.features[at] == hashes
        pairs = np.unique(text[hit] * len(self.features) + at[hit])
        return pairs // len(self.features), pairs % len(self.features)

    def probabilities(self, hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        row, column = self.matrix(hashes, text)
        logits = np.zeros((n, 0))
        for model in self.models:
            logits = np.column_stack([logits, np.clip(model.logits(row, column, logits), -30, 30)])
        return _sigmoid(logits)


def copy_weights(marks: np.ndarray) -> np.ndarray:
    """One over the number of rows that look like copies of a row: the middle count of equal coordinates."""
    counts = np.ones(marks.shape, np.int64)
    for k in range(marks.shape[1]):
        _, inverse, n = np.unique(marks[:, k], return_inverse=True, return_counts=True)
        counts[:, k] = n[inverse]
    return 1.0 / np.median(counts, axis=1) if len(marks) else np.zeros(0)


def fit(labels: np.ndarray, words: list[np.ndarray], marks: np.ndarray, categories=CATEGORIES) -> Chain:
    names = [c for c, _ in categories] + [LABEL]
    if not len(labels):
        return Chain(names, np.zeros(0, U), [])
    weight = copy_weights(marks)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    keys, column = np.unique(np.concatenate(words), return_inverse=True)
    with_word = np.bincount(column, weight[row])
    toxic_with = np.bincount(column, (weight * labels)[row])
    share = (weight * labels).sum() / weight.sum()
    surprise = (toxic_with - share * with_word) / np.sqrt(share * (1 - share) * with_word + 1e-9)
    good = np.flatnonzero((with_word >= MIN_WEIGHT) & (np.abs(surprise) >= MIN_SURPRISE))
    chosen = np.sort(good[np.argsort(-np.abs(surprise[good]), kind="stable")[:MAX_FEATURES]])
    number = np.full(len(keys), -1)
    number[chosen] = np.arange(len(chosen))
    used = number[column] >= 0
    row, column = row[used], number[column[used]]
    targets = []
    for _, seeds in categories:
        wanted = _seed_hashes(seeds)
        targets.append(np.array([float(y and len(np.intersect1d(w, wanted)) > 0) for y, w in zip(labels, words, strict=True)]))
    targets.append(labels.astype(float))
    fold = (mix(marks[:, 0]) % U(FOLDS)).astype(np.int64)  # copies fall in one fold
    logits, models = np.zeros((len(labels), 0)), []
    for y in targets:
        models.append(Linear(len(chosen), logits.shape[1]).fit(row, column, logits, y, weight))
        outside = np.zeros(len(labels))
        for k in range(FOLDS):
            own = Linear(len(chosen), logits.shape[1]).fit(row, column, logits, y, weight * (fold != k))
            outside = np.where(fold == k, own.logits(row, column, logits), outside)
        logits = np.column_stack([logits, np.clip(outside, -30, 30)])
    return Chain(names, keys[chosen], models)


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Chain:
    """Fit on the labelled rows with the ``max_labelled`` smallest hashes of their id."""
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)
    rows = documents.select("doc_id", "text").join(chosen, "doc_id").select("label", "text")
    found = rows.mapInArrow(_training_rows, "label int, words binary, marks binary").toLocalIterator()  # at most max_labelled rows
    found = sorted((r.label, bytes(r.words), bytes(r.marks)) for r in found)
    marks = np.array([np.frombuffer(m, U) for _, _, m in found], U).reshape(-1, COPIES)
    return fit(np.array([x for x, _, _ in found]), [np.frombuffer(w, U) for _, w, _ in found], marks)


def _scores(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = held.value
        for batch in slabs(batches, "_text", SLAB_BYTES):
            place = batch.num_columns - 1
            hashes, stems, offsets = features_of(batch.column(place))
            text = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            found = chain.probabilities(np.concatenate([hashes, stems]), np.concatenate([text, text]), batch.num_rows) if chain.models else np.zeros((batch.num_rows, len(chain.names)))
            kept = [batch.column(i) for i in range(place)]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(found[:, i]) for i in range(found.shape[1])]], names=[f.name for f in batch.schema][:-1] + [f"p_{c}" for c in chain.names])

    return run


def score(df: DataFrame, chain: Chain, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep``, a probability ``p_<category>`` per category and the verdict ``toxic``."""
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    kinds = ", ".join([*given, *[f"p_{c} double" for c in chain.names]])
    out = kept.mapInArrow(_scores(df.sparkSession.sparkContext.broadcast(chain)), kinds)
    return out.withColumn("toxic", F.col(f"p_{LABEL}") >= threshold)


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chain = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, chain)
