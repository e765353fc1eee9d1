"""Inputs: directory discovery, file lists with declared integrity, ordinals and availability."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class InputError(ValueError):
    """A file list or input that can't be used."""


@dataclass(frozen=True)
class Declared:
    """An input of a file list; size and sha256 are checked where declared."""

    ordinal: int
    uri: str
    size: int | None = None
    sha256: str | None = None


def parse_file_list(text: str) -> list[Declared]:
    """Lines of URIs, or of JSON objects uri, size, sha256; blank lines and ``#`` comments are skipped, others are strict."""
    out = []
    for k, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if not line.startswith("{"):
            out.append(Declared(len(out) + 1, line))
            continue
        try:
            o = json.loads(line)
        except ValueError as e:
            raise InputError(f"line {k}: {e}") from None
        if not isinstance(o.get("uri"), str) or not o["uri"] or set(o) - {"uri", "size", "sha256"}:
            raise InputError(f"line {k}: expected uri, size and sha256")
        size, sha = o.get("size"), o.get("sha256")
        if (size is not None and (not isinstance(size, int) or isinstance(size, bool) or size < 0)) or (sha is not None and (not isinstance(sha, str) or len(sha) != 64 or set(sha) - set("0123456789abcdef"))):
            raise InputError(f"line {k}: bad size or sha256")
        out.append(Declared(len(out) + 1, o["uri"], size, sha))
    return out


def declared_frame(spark: SparkSession, inputs: list[Declared]) -> DataFrame:
    return spark.createDataFrame([(d.ordinal, d.uri, d.size, d.sha256) for d in inputs], "input_ordinal long, uri string, declared_size long, declared_sha256 string")


def verified(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Documents (source_file, size_bytes, input_sha256, content) in declared order; ``content`` is null where the input is missing
    or isn't as declared, with the reason in ``input_problem``."""
    strip = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    f = files.drop("input_ordinal")
    j = declared.join(f, strip(F.col("uri")) == strip(F.col("source_file")), "left")
    problem = (
        F.when(F.col("source_file").isNull(), "input_unavailable")
        .when(F.col("declared_size").isNotNull() & (F.col("declared_size") != F.col("size_bytes")), "size_mismatch")
        .when(F.col("declared_sha256").isNotNull() & (F.col("declared_sha256") != F.col("input_sha256")), "sha256_mismatch")
    )
    return j.select(F.col("uri").alias("source_file"), "input_ordinal", "size_bytes", "input_sha256", problem.alias("input_problem"), F.when(problem.isNull(), F.col("content")).alias("content"))


def discover(spark: SparkSession, root: str, include: str = "*", exclude: str | None = None, depth: int | None = None) -> DataFrame:
    """Files below a folder by Spark's own listing: source_file, size_bytes, input_ordinal (by path)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", include).load(root).select(F.col("path").alias("source_file"), F.col("length").alias("size_bytes"))
    if exclude:
        pattern = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in ".+()[]{}^$|\\" else c for c in exclude)
        raw = raw.where(~F.element_at(F.split("source_file", "/"), -1).rlike(f"^{pattern}$"))
    if depth is not None:
        base = len([p for p in root.removeprefix("file:").split("/") if p])
        raw = raw.where(F.size(F.filter(F.split(F.regexp_replace("source_file", r"^file:/+", "/"), "/"), lambda p: p != "")) - 1 - base <= depth)
    ordered = raw.orderBy("source_file").rdd.zipWithIndex().map(lambda r: (r[0][0], r[0][1], r[1] + 1))
    return spark.createDataFrame(ordered, "source_file string, size_bytes long, input_ordinal long")


def read_list(spark: SparkSession, declared: list[Declared]) -> DataFrame:
    """The inputs of a file list as documents in declared order; missing ones and those that aren't as declared have no content.

    Which inputs are there is found before the run, by their names alone.
    """
    from .scan import read_files

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(uri: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(conf).isFile(path)

    found = [d.uri for d in declared if there(d.uri)]
    if found:
        files = read_files(spark, sorted(set(found)))
    else:
        files = spark.createDataFrame([], "source_file string, size_bytes long, input_ordinal long, input_sha256 string, content binary")
    return verified(files, declared_frame(spark, declared))
