"""Connected components of an edge table by repeated contraction; every step is a join or a grouped aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewindows.llm import store


def _lookup(df: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` by its parent where it has one."""
    pairs = parents.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
    return df.join(pairs, F.col(column) == F.col("_u"), "left").withColumn(column, F.coalesce("_p", column)).drop("_u", "_p")


def connected(edges: DataFrame) -> DataFrame:
    """``u, comp`` for every node of ``edges`` (``a``, ``b`` long): the smallest node that it can reach.

    Each round hangs every node below its smallest neighbour, follows that pointer twice and contracts the edges.
    A node that is no local minimum disappears, hence the number of rounds is logarithmic.  Null ends and loops are
    ignored; an empty table gives an empty table.
    """
    edges = store.stored(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "edges")
    comps = edges.select(F.explode(F.array("a", "b")).alias("u")).distinct().withColumn("comp", F.col("u"))
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        parents = store.stored(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "parents")
        for _ in range(2):
            parents = _lookup(parents, parents, "p")
        parents = store.stored(parents, "parents")
        comps = store.stored(_lookup(comps, parents, "comp"), "comps")
        edges = _lookup(_lookup(edges, parents, "a"), parents, "b").where("a <> b")
        edges = store.stored(edges.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "edges")
    return comps
