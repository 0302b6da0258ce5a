"""Connected components by alternating large and small stars, as Spark joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.llm._common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b: neighbours are linked to the least of their neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = both.join(least, "a")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(v, comp) for every vertex of the undirected edges (a, b): comp is the smallest vertex that it reaches.

    The number of rounds is logarithmic in practice; the loop ends when a round changes no edge.
    """
    scratch, old = Scratch(edges.sparkSession), Scratch(edges.sparkSession)
    e = scratch.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    last = mark(e)
    for _ in range(rounds):
        if not last[0]:
            break
        old.paths, scratch.paths = scratch.paths, []
        e = scratch.written(_star(_star(e, True), False))
        now = mark(e)
        old.drop()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("v"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("v"), F.col("b").alias("comp"))).distinct()
