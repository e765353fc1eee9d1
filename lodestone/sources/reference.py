"""Reference tables: small keyed tables for membership and lookup.

A table is read by Spark, checked (columns, row limit, unique keys) and joined to the probes: broadcast while its size is
below a bound, else by a shuffled join. A literal table is limited by its declaration (``max_rows``), as recipes demand.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is broadcast.
BROADCAST_ROWS = 200_000


class ReferenceError_(ValueError):
    """A reference table that can't be used."""


@dataclass
class ReferenceTable:
    """Key (text) and, for lookups, value (text); ``rows`` physical rows."""

    name: str
    df: DataFrame
    rows: int
    has_value: bool


def load(spark: SparkSession, decl: dict, base: str = "") -> ReferenceTable:
    """A table of a csv, tsv or ndjson source: ``column`` for membership, ``key_column`` and ``value_column`` for lookups."""
    path = str(decl["source"])
    path = path if "://" in path or path.startswith("/") or not base else f"{base}/{path}"
    if ".." in path.split("/"):
        raise ReferenceError_(f"{decl['name']}: the source lies outside the workspace")
    if base and "://" not in path and not str(decl["source"]).startswith("/"):  # a link may lead out of a local workspace
        home = os.path.realpath(base.removeprefix("file:"))
        if os.path.commonpath([home, os.path.realpath(path.removeprefix("file:"))]) != home:
            raise ReferenceError_(f"{decl['name']}: the source is linked to a place outside the workspace")
    fmt = str(decl.get("format") or "").lower()
    if fmt in ("csv", "tsv"):
        raw = spark.read.option("header", True).option("sep", "," if fmt == "csv" else "\t").option("mode", "FAILFAST").option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)
    elif fmt == "ndjson":
        raw = spark.read.option("mode", "FAILFAST").option("primitivesAsString", True).json(path)
    else:
        raise ReferenceError_(f"{decl['name']}: unknown format {fmt!r}")
    return from_frame(raw, decl)


def from_frame(raw: DataFrame, decl: dict) -> ReferenceTable:
    """A table of a DataFrame's columns; duplicate lookup keys and too many rows are errors."""
    name = str(decl["name"])
    member, key, value = decl.get("column"), decl.get("key_column"), decl.get("value_column")
    if bool(member) == bool(key and value):
        raise ReferenceError_(f"{name}: give either column, or key_column and value_column")
    names = [c for c in (member, key, value) if c]
    lost = [c for c in names if c not in raw.columns]
    if lost:
        raise ReferenceError_(f"{name}: no columns {lost}")
    cols = raw.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in zip(names, ("k", "v"), strict=False)))
    rows = cols.count()
    limit = int(decl.get("max_rows") or 0)
    if limit and rows > limit:
        raise ReferenceError_(f"{name}: {rows} rows, at most {limit} are declared")
    if member:
        return ReferenceTable(name, cols.distinct(), rows, False)
    twice = cols.groupBy("k").count().where("count > 1").first()
    if twice is not None:
        raise ReferenceError_(f"{name}: duplicate key {twice['k']!r}")
    return ReferenceTable(name, cols, rows, True)


def probe(df: DataFrame, table: ReferenceTable, key: Column, out: str) -> DataFrame:
    """Adds ``out`` (struct of hit and v) for a probe Column: keys are compared verbatim, an empty or null probe is a miss."""
    right = table.df.select(F.col("k").alias("_rk"), (F.col("v") if table.has_value else F.lit(None).cast("string")).alias("_rv"), F.lit(True).alias("_hit"))
    right = F.broadcast(right) if table.rows <= BROADCAST_ROWS else right
    left = df.withColumn("_probe", F.nullif(key.cast("string"), F.lit("")))
    joined = left.join(right, F.col("_probe") == F.col("_rk"), "left")
    return joined.withColumn(out, F.struct(F.coalesce("_hit", F.lit(False)).alias("hit"), F.col("_rv").alias("v"))).drop("_probe", "_rk", "_rv", "_hit")
