"""File manifests and artifact descriptors: what was made, from what, and whether it is still so."""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.extract import Extraction

LIFECYCLE = {"applied": "complete", "partial": "partial", "none": "empty"}


def build_manifest(files: DataFrame) -> DataFrame:
    """(uri, size, sha256) of files (source_file, size_bytes, content or input_sha256)."""
    sha = F.col("input_sha256") if "input_sha256" in files.columns else F.sha2("content", 256)
    return files.select(F.col("source_file").alias("uri"), F.col("size_bytes").alias("size"), sha.alias("sha256"))


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows (uri, problem) of files that are missing, not listed, or of another size or digest; none where all is well."""
    now = build_manifest(files).select(F.col("uri").alias("_u"), F.col("size").alias("_s"), F.col("sha256").alias("_h"))
    j = manifest.join(now, F.col("uri") == F.col("_u"), "full")
    problem = F.when(F.col("_u").isNull(), "missing").when(F.col("uri").isNull(), "not listed").when(F.col("size") != F.col("_s"), "size differs").when(F.col("sha256") != F.col("_h"), "digest differs")
    return j.select(F.coalesce("uri", "_u").alias("uri"), problem.alias("problem")).where("problem is not null")


def descriptor(e: Extraction, path: str, fmt: str) -> dict[str, Any]:
    """Descriptor of an output: format, fields with types and sources, record count and lifecycle."""
    d = {r["disposition"]: r["n"] for r in e.dispositions.groupBy("disposition").agg(F.count("*").alias("n")).collect()}
    state = LIFECYCLE["none"] if not d.get("applied") else LIFECYCLE["partial"] if d.get("failed") else LIFECYCLE["applied"]
    fields = [{"name": m.name, "type": m.spark_type().simpleString(), "source": m.xpath or m.expression, "description": m.description} for m in e.recipe.public()]
    return {"artifact": "extract", "path": path, "format": fmt, "record_type": e.recipe.record_type, "fields": fields, "records": e.records.count(), "lifecycle": state, "operations": ["columnar_scan"] if fmt == "parquet" else ["line_scan"]}


def check_descriptor(d: dict[str, Any]) -> list[str]:
    """What is wrong with a descriptor; nothing where it is good."""
    out = [f"{k} is missing" for k in ("artifact", "path", "format", "record_type", "fields", "lifecycle") if k not in d]
    if d.get("format") not in ("ndjson", "parquet"):
        out.append("unknown format")
    if d.get("lifecycle") not in LIFECYCLE.values():
        out.append("unknown lifecycle")
    names = [f.get("name") for f in d.get("fields") or ()]
    return out + (["field names repeat"] if len(set(names)) < len(names) else [])


#: What each mode checks, with all before it.
LADDER = ("off", "sidecars", "artifact", "envelope-sample", "strict")
PROBLEMS = "rung string, what string, problem string"


def validate_output(spark: SparkSession, path: str, mode: str, manifest: dict[str, Any] | None = None, every: int = 100) -> DataFrame:
    """What is wrong with the written shards of a run (rung, what, problem); no rows where all is well.

    ``sidecars``: the manifest and what it says of dispositions; ``artifact``: the descriptor; ``envelope-sample``: the first,
    every hundredth and last envelope that a task reads of a file; ``strict``: all envelopes, and every shard's rows, bytes
    and digest. Shards are read by tasks; the driver holds the manifest, which names each of them.
    """
    if mode not in LADDER:
        raise ValueError(f"the output can be validated by {LADDER}, not by {mode!r}")
    upto, found, frames = LADDER.index(mode), [], []
    if upto == 0:
        return spark.createDataFrame([], PROBLEMS)
    m = manifest if manifest is not None else _json_of(spark, f"{path}/manifest")
    found += [("sidecars", "manifest", p) for p in check_manifest(m)]
    told = _dispositions_of(spark, path)
    if told is None:
        found.append(("sidecars", "dispositions", "it is missing"))
    elif m:
        found += [("sidecars", "dispositions", f"{told.get(k, 0)} inputs {k}, the manifest has {m.get(f'inputs_{k}')}") for k in ("applied", "not_applicable", "failed") if told.get(k, 0) != m.get(f"inputs_{k}")]
    if upto >= 2:
        d = _json_of(spark, f"{path}/artifact")
        found += [("artifact", "descriptor", p) for p in check_descriptor(d or {})]
        if d and m and d.get("records") != m.get("records"):
            found.append(("artifact", "descriptor", f"{d.get('records')} records, the manifest has {m.get('records')}"))
    shards = (m or {}).get("shards") or []
    if upto >= 3 and shards:
        number = F.monotonically_increasing_id()
        lines = spark.read.text(f"{path}/shards").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value", number.alias("n"))
        if upto == 3:
            last = lines.groupBy("file").agg(F.max("n").alias("last"), F.min("n").alias("first"))  # a row a shard
            lines = lines.join(F.broadcast(last), "file").where(((F.col("n") - F.col("first")) % every == 0) | (F.col("n") == F.col("last")))
        from .sinks import invalid_envelopes

        bad = invalid_envelopes(lines.select("file", "value")).groupBy("file").agg(F.count("*").alias("k"))
        frames.append(bad.select(F.lit(LADDER[upto]).alias("rung"), F.col("file").alias("what"), F.concat(F.col("k").cast("string"), F.lit(" envelopes don't fit the contract")).alias("problem")))
    if upto == 4 and shards:
        want = spark.createDataFrame([(s["file"], s["rows"], s["bytes"], s["sha256"]) for s in shards], "file string, rows long, bytes long, sha256 string")
        there = spark.read.format("binaryFile").load(f"{path}/shards").select(F.element_at(F.split("path", "/"), -1).alias("f"), "length", F.sha2("content", 256).alias("h"))
        rows = lines.groupBy("file").agg(F.count("*").alias("k")).withColumnRenamed("file", "g")
        j = want.join(there, F.col("file") == F.col("f"), "full").join(rows, F.coalesce("file", "f") == F.col("g"), "left")
        problem = F.when(F.col("f").isNull(), "it is missing").when(F.col("file").isNull(), "the manifest doesn't name it").when(F.col("length") != F.col("bytes"), "its size differs").when(F.col("h") != F.col("sha256"), "its digest differs").when(F.coalesce("k", F.lit(0)) != F.col("rows"), "its rows differ")
        frames.append(j.select(F.lit("strict").alias("rung"), F.coalesce("file", "f").alias("what"), problem.alias("problem")).where("problem is not null"))
    out = spark.createDataFrame(found, PROBLEMS)
    for f in frames:
        out = out.unionByName(f)
    return out


def check_manifest(m: dict[str, Any] | None) -> list[str]:
    """What is wrong with a run's manifest."""
    if not m:
        return ["it is missing"]
    out = [f"{k} is missing" for k in ("record_type", "inputs_total", "inputs_applied", "inputs_not_applicable", "inputs_failed", "records", "fields") if k not in m]
    if not out and m["inputs_total"] != m["inputs_applied"] + m["inputs_not_applicable"] + m["inputs_failed"]:
        out.append("its inputs don't add up")
    if "shards" in m and not out:
        if sum(s["rows"] for s in m["shards"]) != m["records"]:
            out.append("the rows of its shards aren't its records")
        if [s["shard"] for s in m["shards"]] != list(range(len(m["shards"]))):
            out.append("its shards aren't numbered in a row")
    return out


def _json_of(spark: SparkSession, path: str) -> dict[str, Any] | None:
    try:
        row = spark.read.text(path).first()
    except AnalysisException:  # no such path
        return None
    return json.loads(row[0]) if row else None


def _dispositions_of(spark: SparkSession, path: str) -> dict[str, int] | None:
    try:
        d = spark.read.schema("disposition string").json(f"{path}/dispositions")
    except AnalysisException:
        return None
    return {r["disposition"]: r["count"] for r in d.groupBy("disposition").count().collect()}
