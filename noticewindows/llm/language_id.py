"""Language identification by Bayesian fusion of text, declaration, address and host.

Evidence of a document for each language:

- text: smoothed log likelihood of hashed byte trigrams of the lower-cased text, divided by a temper because
  neighbouring trigrams are not independent;
- declared language: how often documents whose text speaks for a language declare each language;
- address suffix (the last label of the host, e.g. ``fr``): the same;
- host: the share of each language among the documents of the host, smoothed towards the share of its suffix, which is
  smoothed towards the share in the whole corpus.  The document's own vote is taken out of its host.

All shares are grouped aggregates over all documents; the tables that are joined back have one row per (host, language)
or less, and join by shuffle, whatever their size.

A document is rejected when it has no letters, when its text is of no known language (less likely than a uniform
guess by ``MAX_SHORTFALL`` nats), when the best language is not in the wanted set, or when its posterior is
below ``MIN_POSTERIOR``.

Languages are all labels found, however many, by their first subtag in lower case; counts and likelihoods are held in
blocks of languages.

Defined results: null or blank texts have no text evidence, language null and are rejected; null declarations and hosts
add no evidence.  Ties go to the first language in name order.  Repeated rows get equal results.  An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewindows.llm import store
from noticewindows.llm.kneser_ney import SharedArrays
from noticewindows.llm.textblocks import released, slabs, text_bytes

BUCKETS = 1 << 16
BLOCK = 64  # languages whose counts a task or the driver holds at a time
SCORES = 4_000_000  # likelihoods that a task holds at a time
SLAB_BYTES = 1 << 20
TEMPER = 20.0  # trigrams that count as one independent observation
ALPHA = 0.5  # smoothing of trigram counts
HOST_WEIGHT = 8.0  # documents that the suffix share counts for in a host share, likewise one level up
MIN_POSTERIOR = 0.60
MAX_SHORTFALL = 10.0  # nats that a text may be less likely than a uniform guess; a few rare trigrams are no proof


def trigram_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each text, in text order, and the n + 1 offsets.

    Digits, ASCII punctuation and blanks count as one blank, runs of blanks as one."""
    padded = pc.binary_join_element_wise("", pc.utf8_lower(pc.fill_null(column, "")), "", " ")
    data, where = text_bytes(padded)
    letters = LETTER[data]
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # the first blank after a letter stays
    keep[where[:-1]] = True  # and the one before the text
    kept = np.concatenate([[0], np.cumsum(keep)])
    plain = np.where(letters, data, 32)[keep].astype(np.uint32)
    offsets = kept[where]
    if len(plain) < 3:
        return np.zeros(0, np.int64), np.zeros(len(where), np.int64)
    code = (plain[:-2] << 16) | (plain[1:-1] << 8) | plain[2:]
    code = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    inside = np.ones(len(plain), dtype=bool)
    for back in (1, 2):  # trigrams that run into the next text
        at = offsets[1:] - back
        inside[at[at >= 0]] = False
    whole = np.concatenate([[0], np.cumsum(inside[: len(code)])])
    return code[inside[: len(code)]], whole[np.minimum(offsets, len(code))]


LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = True
LETTER[128:] = True


def label_of(label: Column) -> Column:
    """The language of a label: its first subtag in lower case (``EN``, ``en-US`` and ``en_gb`` are ``en``); null if blank."""
    found = F.regexp_extract(F.lower(label.cast("string")), r"^\s*([^_-]*[^\s_-])", 1)
    return F.when(found != "", found)


def plain_label(label: str) -> str:
    found = re.match(r"\s*([^_-]*[^\s_-])", label.lower())
    return found.group(1) if found else ""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def counted() -> pa.RecordBatch:
        parts = [(language, np.flatnonzero(n)) for language, n in total.items()]
        languages = pa.array([language for language, _ in parts], pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), [len(at) for _, at in parts])))
        buckets = np.concatenate([np.zeros(0, np.int64), *[at for _, at in parts]])
        n = np.concatenate([np.zeros(0, np.int64), *[total[language][at] for language, at in parts]])
        return pa.RecordBatch.from_arrays([languages, pa.array(buckets), pa.array(n)], names=["lang", "bucket", "n"])

    for batch in slabs(released(batches), "text", SLAB_BYTES):
        codes, offsets = trigram_codes(batch.column(1))
        found = batch.column(0).dictionary_encode()
        number = pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False)
        of = np.repeat(number, np.diff(offsets))
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(found.dictionary) + 1))
        for k, language in enumerate(found.dictionary.to_pylist()):
            if language not in total:
                if len(total) >= BLOCK:
                    yield counted()
                    total.clear()
                total[language] = np.zeros(BUCKETS, np.int64)
            total[language] += np.bincount(codes[order[cuts[k] : cuts[k + 1]]], minlength=BUCKETS)
    yield counted()


class TextModel:
    """Log likelihoods of trigram buckets: blocks of languages x BUCKETS in the shared folder, mapped by tasks."""

    def __init__(self, languages: tuple[str, ...], uri: str):
        self.languages, self.uri = languages, uri


def train(labelled: DataFrame, language: str = "lang", text: str = "text", languages: tuple[str, ...] | None = None) -> TextModel:
    """Count trigrams of all labelled rows per language.  Languages default to all labels found, by ``label_of``."""
    spark = labelled.sparkSession
    rows = labelled.select(label_of(F.col(f"`{language}`")).alias("lang"), F.col(f"`{text}`").alias("text")).where("lang IS NOT NULL")
    if languages is None:
        languages = tuple(sorted(r.lang for r in rows.select("lang").distinct().toLocalIterator()))
    else:
        languages = tuple(sorted({plain_label(x) for x in languages}))
    counts = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = store.stored(counts, "trigrams")
    arrays = SharedArrays(store.fresh_folder(spark, "language-model"))
    for b in range(0, len(languages), BLOCK):
        block = languages[b : b + BLOCK]
        number = {x: k for k, x in enumerate(block)}
        smooth = np.full((len(block), BUCKETS), ALPHA)
        for r in counts.where(F.col("lang").isin(*block)).toLocalIterator():  # bounded by BLOCK x BUCKETS
            smooth[number[r.lang], r.bucket] += r.n
        arrays.write(f"logs-{b // BLOCK}", np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32))
    return TextModel(languages, arrays.uri)


def _likelihoods(model: TextModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, arrays = len(model.languages), SharedArrays(model.uri)
        blocks = [arrays.read(f"logs-{b}", "f4").reshape(-1, BUCKETS) for b in range(-(-step // BLOCK))]
        rows = max(1, SCORES // step)
        for slab in slabs(released(batches), "_text", SLAB_BYTES):
            for batch in (slab.slice(i, rows) for i in range(0, slab.num_rows, rows)):
                codes, offsets = trigram_codes(batch.column(batch.num_columns - 1))
                sums = np.empty((batch.num_rows, step))
                for k, log in enumerate(log for logs in blocks for log in logs):
                    total = np.concatenate([[0.0], np.cumsum(log[codes], dtype=np.float64)])
                    sums[:, k] = total[offsets[1:]] - total[offsets[:-1]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * step), pa.array(sums.ravel()))
                n = np.diff(offsets)
                speaks = (n > 0) & (sums.max(axis=1) - n * float(np.log(1.0 / BUCKETS)) > -MAX_SHORTFALL)
                vote = pa.array(sums.argmax(axis=1).astype(np.int32), mask=~speaks)
                kept = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n), lists, pa.array(speaks), vote], names=[f.name for f in batch.schema][:-1] + ["n_trigrams", "logs", "speaks", "vote"])

    return run


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not once for every element that needs it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _softmax(logs: Column) -> Column:
    exps = lambda held: _let(F.array_max(held), lambda top: F.transform(held, lambda x: F.exp(x - top)))
    shares = lambda held: _let(_sum(held), lambda total: F.transform(held, lambda x: x / total))
    return _let(_let(logs, exps), shares)


def host_of(address: Column) -> Column:
    """The host of a URL, or the value itself if it is no URL."""
    host = F.lower(F.regexp_replace(F.regexp_replace(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?", ""), r"[/?#:].*$", ""))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def suffix_of(host: Column) -> Column:
    return F.when(host.contains("."), F.regexp_extract(host, r"\.([^.]+)\.?$", 1))


def identify(documents: DataFrame, model: TextModel, wanted: tuple[str, ...] | None = None, text: str = "text", declared: str = "lang", address: str = "source", min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """The columns of ``documents`` but the text, as the struct ``row``, with ``language, posterior, text_language,
    n_trigrams, kept``."""
    languages = model.languages
    wanted = languages if wanted is None else tuple(plain_label(x) for x in wanted)
    if not languages:
        none = documents.select(F.struct(*[f"`{c}`" for c in documents.columns if c != text] or [F.lit(None).alias("none")]).alias("row"))
        return none.selectExpr("row", "CAST(NULL AS string) language", "CAST(NULL AS double) posterior", "CAST(NULL AS string) text_language", "0L n_trigrams", "false kept")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text])
    rows = documents.select(row.alias("row"), host_of(F.col(f"`{address}`").cast("string")).alias("host"), label_of(F.col(f"`{declared}`")).alias("declared"), F.col(f"`{text}`").alias("_text"))
    kinds = f"row {rows.schema['row'].dataType.simpleString()}, host string, declared string, n_trigrams long, logs array<double>, speaks boolean, vote int"
    scored = store.stored(rows.mapInArrow(_likelihoods(model), kinds), "likelihoods")
    names = F.array(*[F.lit(x) for x in languages])
    tempered = F.transform("logs", lambda x: x / F.lit(TEMPER))
    scored = scored.withColumn("suffix", suffix_of(F.col("host"))).withColumn("tempered", tempered)

    # Shares: soft votes would need floats to add up alike everywhere, whole votes do.
    votes = scored.where("vote IS NOT NULL").groupBy("host", "suffix", "declared", "vote").agg(F.count("*").alias("n"))
    votes = store.stored(votes, "votes")
    k = len(languages)

    def shares(by: list[str]) -> DataFrame:
        """One row per key with the votes of all languages."""
        counts = votes.groupBy(*by, "vote").agg(F.sum("n").alias("n")).groupBy(*by)
        found = counts.agg(F.map_from_entries(F.collect_list(F.struct("vote", "n"))).alias("found"))  # an entry per language
        every = F.sequence(F.lit(0), F.lit(k - 1))
        return found.select(*by, F.transform(every, lambda i: F.coalesce(F.try_element_at("found", i), F.lit(0))).alias("votes"))

    total = [0.0] * k
    for r in votes.groupBy("vote").agg(F.sum("n").alias("n")).collect():  # a row per language
        total[r.vote] = float(r.n)
    n_all = sum(total)
    base = F.array(*[F.lit((x + 1.0) / (n_all + k)) for x in total])
    weight = F.lit(HOST_WEIGHT)

    def blend(votes: Column, parent: Column) -> Column:
        return _let(_sum(votes), lambda n: F.zip_with(votes, parent, lambda v, p: (v + weight * p) / (n + weight)))

    zero = F.array_repeat(F.lit(0.0), k)
    hosts = shares(["host"]).where("host IS NOT NULL").withColumnRenamed("votes", "host_votes")
    suffixes = shares(["suffix"]).where("suffix IS NOT NULL").withColumnRenamed("votes", "suffix_votes")
    claims = shares(["declared"]).where("declared IS NOT NULL").withColumnRenamed("votes", "claim_votes")
    joined = scored.join(hosts, "host", "left").join(suffixes, "suffix", "left").join(claims, "declared", "left")
    own = lambda column: F.transform(F.coalesce(F.col(column).cast("array<double>"), zero), lambda v, i: v - F.when(F.col("vote") == i, F.lit(1.0)).otherwise(F.lit(0.0)))
    without = {c: F.when(F.col(c).isNull(), zero).otherwise(own(c)) for c in ("host_votes", "suffix_votes", "claim_votes")}
    joined = joined.withColumns(without)
    joined = joined.withColumn("prior", blend(F.col("host_votes"), blend(F.col("suffix_votes"), base)))
    # P(declared | language) up to a factor: the share of the language among the claimants over its share in the corpus.
    claim = F.when(F.col("declared").isNull(), zero).otherwise(
        F.zip_with(F.col("claim_votes"), base, lambda v, b: F.log((v + weight * b) / b))
    )
    joined = joined.withColumn("claim", claim)
    text_part = F.when(F.col("speaks"), F.col("tempered")).otherwise(zero)
    fused = F.zip_with(F.zip_with(text_part, "prior", lambda x, p: x + F.log(p)), "claim", lambda x, c: x + c)
    joined = joined.withColumn("fused", fused).withColumn("posteriors", _softmax(F.col("fused")))
    top = F.array_max("posteriors")
    language = F.get(names, F.array_position("posteriors", top).cast("int") - 1)
    out = joined.select("row", F.when(F.col("speaks"), language).alias("language"), F.when(F.col("speaks"), top).alias("posterior"), F.get(names, F.col("vote")).alias("text_language"), "n_trigrams")
    accepted = F.col("language").isin(*wanted) & (F.col("posterior") >= min_posterior)
    return out.withColumn("kept", F.coalesce(accepted, F.lit(False)))


def keep_known(documents: DataFrame, wanted: tuple[str, ...] | None = None, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``documents`` that are accepted, by id; rows with a null id are judged by nothing and stay."""
    model = train(documents)
    judged = identify(documents.select(doc_id, "text", "lang", "source"), model, wanted, **options)
    # written first: a filter on the verdict would be moved down and every use of a posterior written out again
    judged = store.stored(judged.select(F.col(f"row.{doc_id}").alias("_rejected"), "kept"), "language-verdicts")
    rejected = judged.where("NOT kept AND _rejected IS NOT NULL").select("_rejected").distinct()
    return documents.join(rejected, F.col(doc_id) == F.col("_rejected"), "left_anti")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = identify(documents, train(documents))
    return out.select("row.doc_id", "language", "posterior", "text_language", "n_trigrams", "kept")
