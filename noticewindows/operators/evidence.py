"""Where quotes stand in a corpus: the check of a quote against its post, for all documents at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticewindows import fixed_values as fv
from noticewindows.functions import textcols
from noticewindows.session import cut_lineage

RUN = fv.EVIDENCE_MIN_WORDS  # words of the runs that are looked up; shorter quotes count for nothing
BITS_PER_RUN = 64
TESTS = 4
MOST_BITS = 1 << 24  # 4 MB of filter in every task; beyond 262,144 runs it lets more through, the join stays exact


def _runs(words: Column) -> Column:
    """Hashes of all runs of RUN words, each once."""
    split = F.split(words, " ")
    return F.transform(
        F.array(split),
        lambda w: F.when(
            F.size(w) >= RUN,
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(0), F.size(w) - RUN), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(RUN)])
                )
            ),
        ),
    )[0]


def _bit(run: Column, k: int, n_bits: int) -> Column:
    """The k-th bit of a run in a filter of ``n_bits``, a power of two."""
    low, high = run.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(run, 32).bitwiseOR(F.lit(1))
    return (low + F.lit(k) * high).bitwiseAND(F.lit(n_bits - 1))


def run_filter(runs: DataFrame) -> Callable[[Column], Column]:
    """A test that every run of ``runs`` (a column ``run``) passes, and hardly any other.

    A Bloom filter: Spark sets the bits of all runs, and its words, at most ``MOST_BITS`` / 64 rows, become one binary
    value in the plan of the reader.  Four bits go into a byte, so that a byte is a character and can be read as one."""
    n_runs = runs.agg(F.count_distinct("run")).first()[0]
    n_bits = min(MOST_BITS, max(64, 1 << (BITS_PER_RUN * n_runs - 1).bit_length()))
    bit = F.explode(F.array(*[_bit(F.col("run"), k, n_bits) for k in range(TESTS)])).alias("bit")
    value = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    words = runs.select(bit).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(value).alias("bits")).toArrow()
    held = np.zeros(n_bits // 64, np.int64)
    held[words["at"].to_numpy()] = words["bits"].to_numpy()
    set_bits = np.unpackbits(held.view(np.uint8), bitorder="little").reshape(-1, 4)
    packed = F.lit(bytearray((set_bits << np.arange(4, dtype=np.uint8)).sum(axis=1).astype(np.uint8).tobytes()))

    def passes(run: Column) -> Column:
        def is_set(k: int) -> Column:
            bit = _bit(run, k, n_bits)
            byte = F.substring(packed, (F.shiftright(bit, 2) + 1).cast("int"), F.lit(1)).cast("string")
            return F.getbit(F.ascii(byte), bit.bitwiseAND(F.lit(3)).cast("int")) == 1

        return reduce(Column.__and__, [is_set(k) for k in range(TESTS)])

    return passes


def wanted_runs(held: DataFrame, runs: DataFrame) -> DataFrame:
    """``doc_id, run`` of the runs of ``held`` (doc_id, text_words) that pass the filter of ``runs``; the others never
    become rows."""
    return held.select("doc_id", F.explode(F.filter(_runs(F.col("text_words")), run_filter(runs))).alias("run"))


def evidence_search(quotes: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(quote_id, doc_id)`` for every document that holds the words of a quote in one piece.

    ``quotes``: quote_id, quote; ``corpus``: doc_id, text.  Only document runs that some quote has go on: a filter
    drops nearly all others inside the row of the document, a semi-join the rest.  Of the runs of a quote the one that
    the fewest documents hold finds the candidates, and their words decide.  Joins are on the hash of a run, so a
    frequent run is split by adaptive execution and never dropped.
    """
    asked = quotes.select("quote_id", textcols.words(F.col("quote")).alias("quote_words"))
    asked = asked.filter(textcols.word_count(F.col("quote_words")) >= RUN)
    held = corpus.select("doc_id", textcols.words(F.col("text")).alias("text_words")).filter("text_words <> ''")
    of_quotes = cut_lineage(asked.select("quote_id", F.explode(_runs(F.col("quote_words"))).alias("run")), "evidence-runs")
    of_docs = wanted_runs(held, of_quotes)
    hits = cut_lineage(of_docs.join(of_quotes.select("run").distinct(), "run", "left_semi"), "evidence-hits")
    spread = hits.groupBy("run").agg(F.count("*").alias("n"))
    rarest = (
        of_quotes.join(spread, "run", "left")
        .groupBy("quote_id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("best"))
        .filter("best.n > 0")
        .select("quote_id", "best.run")
    )
    pairs = hits.join(rarest, "run").select("quote_id", "doc_id").distinct()
    padded = [F.concat(F.lit(" "), c, F.lit(" ")) for c in ("text_words", "quote_words")]
    found = pairs.join(asked, "quote_id").join(held, "doc_id").filter(F.contains(*padded))
    return found.select("quote_id", "doc_id")
