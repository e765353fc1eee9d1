"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written


def _with_least(edges: DataFrame, spread: int) -> DataFrame:
    """The edges (a, b, m): ``m`` is the smallest of a and all its neighbours b.

    A vertex of many edges is dealt over up to ``spread`` places by its neighbours' hashes, each with a row of the minimum.
    """
    e = edges.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(spread)).cast("int"))
    low = e.groupBy("a", "s").agg(F.min("b").alias("m")).groupBy("a").agg(F.min("m").alias("m"), F.collect_list("s").alias("s"))
    low = low.select(F.col("a").alias("u"), F.least("a", "m").alias("m"), F.explode("s").alias("v"))
    return e.join(low, (F.col("a") == F.col("u")) & (F.col("s") == F.col("v"))).select("a", "b", "m")


def _settled(e: DataFrame) -> bool:
    """Whether the edges (a, b; b at most a) are stars: a vertex that points to another one points to no third, and none to it."""
    ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("to")), F.struct(F.col("b").alias("v"), F.lit(None).cast("long").alias("to")))
    of = e.where("a <> b").select(F.explode(ends).alias("p")).select("p.v", "p.to").groupBy("v").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.count_if(F.col("to").isNull()).alias("pointed"))
    return of.where("low <> high or low is not null and pointed > 0").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) of every vertex of the undirected ``edges`` (a, b): the smallest vertex that it reaches.

    Each round's edges are written to the shared folder, so a lost executor costs one round; the labels never meet on one
    machine, and a vertex of many edges is aggregated partially before its shuffle and divided in the joins. Self-loops keep
    a vertex in the result.
    """
    spread = max(16, partitions(edges.sparkSession))
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every greater neighbour of a vertex points to the smallest neighbour
        large = _with_least(both, spread).where("b >= a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of a vertex, and itself, point to the smallest of them
        small = _with_least(large, spread).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("p")).select("p.a", "p.b").distinct()
        e = written(small, "edges")
        if _settled(e):
            break
    else:
        raise RuntimeError("the components didn't settle")
    return e.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("id"), "label")
