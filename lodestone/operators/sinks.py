"""Sinks: NDJSON per input, rolling shards, Parquet, dispositions and a manifest.

Shards are staged and moved when all are whole, other files are committed by Spark; the manifest comes last: a reader that
finds none has an unfinished run."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.extract import Extraction, envelope
from lodestone.plans.staging import create_file, written

from .profile import FieldState, ProfileConfig, report, states_as_json, states_from_json, texts_of


#: Rows that share the list of the shards that begin among them; runs and starts up to which the lists are broadcast.
RUN, RUNS = 256, 2_000_000


def ranged(df: DataFrame, order: list[str], partitions: int | None = None) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``df`` in ranges of an order, as a table: ``_p`` is a row's range, ``_k`` its place there from 0; and (range, rows) of each.

    Ranges are sorted by their tasks; the driver gets one count for each of them.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.monotonically_increasing_id()
    out = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", number)
    out = written(out.withColumns({"_p": F.shiftright("_id", 33).cast("int"), "_k": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), "ranged")
    return out, sorted((r["_p"], r["n"]) for r in out.groupBy("_p").agg(F.count("*").alias("n")).collect())


def numbered(df: DataFrame, order: list[str], name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """Adds a 1-based number over the whole order without one task seeing all rows."""
    out, counts = ranged(df, order, partitions)
    return _with_numbers(out, counts, name).drop("_p", "_k")


def _with_numbers(out: DataFrame, counts: list[tuple[int, int]], name: str) -> DataFrame:
    before = list(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0), strict=False))
    base = out.sparkSession.createDataFrame(before, "_p int, _base long")
    return out.join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + F.col("_k") + 1).drop("_base")


def shards_by_rows(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Adds ``shard`` (from 0): a new one every ``rows`` rows of the order."""
    if rows < 1:
        raise ValueError("rows must be positive")
    return numbered(df, order, "_n").withColumn("shard", F.floor((F.col("_n") - 1) / rows).cast("long")).drop("_n")


class _Range:
    """The rows of one range: global numbers from ``first``, sums of sizes up to and with each row."""

    def __init__(self, t: pa.Table, first: int, before: int, limit: int, rows: int) -> None:
        size = t.column("_size").to_numpy()[np.argsort(t.column("_k").to_numpy())]
        self.first, self.n, self.limit, self.rows = first, len(size), limit, rows
        self.sums = before + np.cumsum(size)
        self.before = self.sums - size
        # a shard from each row: the sum it may reach (its first row counts however large) and the number it ends before
        self.most = np.maximum(self.before + limit, self.sums)
        at = np.arange(self.n)
        self.next = np.minimum(np.searchsorted(self.sums, self.most, "right"), at + rows)

    def entries(self) -> np.ndarray:
        """Rows that a shard of an earlier range may end before."""
        return np.flatnonzero((self.before - self.before[0] <= self.limit) & (np.arange(self.n) < self.rows))

    def last_starts(self) -> np.ndarray:
        """Of each row the last start that is reached from it in the range, by doubling pointers."""
        at = np.arange(self.n)
        to = np.where(self.next < self.n, self.next, at)
        while True:
            twice = to[to]
            if (twice == to).all():
                return to
            to = twice

    def starts(self, entry: int) -> list[int]:
        out, k = [], entry
        while k < self.n:
            out.append(self.first + k)
            k = int(self.next[k])
        return out


def shards_by_bytes(df: DataFrame, order: list[str], size: Column, limit: int, rows: int | None = None) -> DataFrame:
    """Adds ``shard``: greedy packing, a row that would exceed ``limit`` (or ``rows``) begins a new shard; a larger row has its own.

    Ranges of the order find by themselves which start each possible first one leads to, and where the shard that leaves them
    ends; pointers between ranges are doubled until every range knows its first start. Only (range, place, size) is
    shuffled, 20 bytes a row; the driver gets sums and the first start of each range. The rows stay where they are.
    """
    spark = df.sparkSession
    own, counts = ranged(df.withColumn("_size", size.cast("long")), order)
    if not counts:
        return own.withColumn("shard", F.lit(None).cast("long")).drop("_p", "_k", "_size")
    slim = own.select("_p", "_k", "_size")
    sums = {r["_p"]: r["s"] for r in slim.groupBy("_p").agg(F.sum("_size").alias("s")).collect()}
    parts = [p for p, _ in counts]
    number = np.cumsum([0, *(n for _, n in counts)])  # rows before each range, and all
    total = np.cumsum([0, *(sums[p] for p in parts)])
    place, most_rows = {p: j for j, p in enumerate(parts)}, rows or 1 << 62

    def of(t: pa.Table) -> tuple[int, _Range]:
        j = place[t.column("_p")[0].as_py()]
        return j, _Range(t, int(number[j]), int(total[j]), limit, most_rows)

    def leave(t: pa.Table) -> pa.Table:
        """For each entry of a range where the shard that leaves the range ends: in which range, at what sum or number."""
        j, r = of(t)
        e = r.entries() if j else np.array([0])
        last = r.last_starts()[e]
        sum_to, upto = r.most[last], np.minimum(r.first + last, (1 << 62) - most_rows) + most_rows
        to = np.minimum(np.searchsorted(total[1:], sum_to, "right"), np.searchsorted(number[1:], upto, "right"))
        return pa.table({"p": pa.array(np.full(len(e), j), pa.int32()), "i": r.first + e, "to": pa.array(to, pa.int32()), "sum": sum_to, "upto": upto})

    def enter(asked: pa.Table, t: pa.Table) -> pa.Table:
        """The rows that shards from other ranges end before."""
        if not asked.num_rows or not t.num_rows:
            return pa.table({"p": pa.array([], pa.int32()), "i": pa.array([], pa.int64()), "q": pa.array([], pa.int32()), "m": pa.array([], pa.int64())})
        j, r = of(t)
        k = np.minimum(np.searchsorted(r.sums, asked.column("sum").to_numpy(), "right"), np.maximum(asked.column("upto").to_numpy() - r.first, 0))
        return pa.table({"p": asked.column("p"), "i": asked.column("i"), "q": pa.array(np.full(len(k), j), pa.int32()), "m": r.first + k})

    left = slim.groupBy("_p").applyInArrow(leave, "p int, i long, to int, sum long, upto long").where(F.col("to") < len(parts))
    known = spark.createDataFrame([(j, p) for p, j in place.items()], "to int, _p int")
    step = written(left.join(F.broadcast(known), "to").groupBy("_p").cogroup(slim.groupBy("_p")).applyInArrow(enter, "p int, i long, q int, m long"), "pointers")
    reached = spark.createDataFrame([(0, 0)], "p int, i long")
    for _ in range(max(1, len(parts) - 1).bit_length()):
        on = reached.join(step, ["p", "i"]).select(F.col("q").alias("p"), F.col("m").alias("i"))
        reached = written(reached.union(on).distinct(), "reached")
        then = step.select(F.col("p").alias("q"), F.col("i").alias("m"), F.col("q").alias("q2"), F.col("m").alias("m2"))
        step = written(step.join(then, ["q", "m"]).select("p", "i", F.col("q2").alias("q"), F.col("m2").alias("m")), "pointers")
    first = {r["p"]: r["i"] for r in reached.collect()}  # one for each range that a shard begins in

    def mark(t: pa.Table) -> pa.Table:
        """Of each run of ``RUN`` rows how many shards of its range begin before it, and those that begin in it."""
        j, r = of(t)
        got = np.array(r.starts(first[j] - r.first) if j in first else [], np.int64)
        cut = np.searchsorted(got, r.first + np.arange(-(-r.n // RUN) + 1) * RUN)
        inside = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(got, pa.int64()))
        return pa.table({"_p": pa.array(np.full(len(inside), parts[j]), pa.int32()), "_run": pa.array(np.arange(len(inside)), pa.int64()), "_before": pa.array(cut[:-1], pa.int64()), "_starts": inside})

    starts = written(slim.groupBy("_p").applyInArrow(mark, "_p int, _run long, _before long, _starts array<long>"), "starts")
    many = sorted((r["_p"], r["n"]) for r in starts.groupBy("_p").agg(F.sum(F.size("_starts")).alias("n")).collect())
    upto = spark.createDataFrame(list(zip((p for p, _ in many), accumulate((n for _, n in many), initial=0), strict=False)), "_p int, _upto long")
    runs = starts.join(F.broadcast(upto), "_p")
    if sum(-(-n // RUN) for _, n in counts) <= RUNS and sum(n for _, n in many) <= RUNS:
        runs = F.broadcast(runs)
    # one number for each shard: as many as there will be files; a row looks through the starts of its own run only
    rows_of = _with_numbers(own, counts, "_n").withColumn("_run", F.floor(F.col("_k") / RUN).cast("long")).join(runs, ["_p", "_run"])
    inside = F.size(F.filter("_starts", lambda x: x < F.col("_n")))
    return rows_of.withColumn("shard", F.col("_upto") + F.col("_before") + inside - 1).drop("_p", "_k", "_n", "_size", "_run", "_before", "_starts", "_upto")


def write_ndjson(e: Extraction, path: str, meta: dict[str, Any] | None = None) -> None:
    """Envelopes as text, a folder per input (``source_file`` or the documents' key), in record order."""
    key = F.concat_ws("|", *(F.col(f"`{k}`").cast("string") for k in e.keys)) if e.keys else F.lit("all")
    rows = envelope(e, meta).select(key.alias("input"), "record_num", "value")
    rows.repartition("input").sortWithinPartitions("input", "record_num").select("input", "value").write.mode("errorifexists").partitionBy("input").text(path)


def write_shards(e: Extraction, path: str, rows: int | None = None, limit: int | None = None, meta: dict[str, Any] | None = None) -> dict[str, Any]:
    """Envelopes as ordered shards and a manifest with each one's rows, bytes, digest and span of inputs; returns the manifest.

    Order: input_ordinal (else the key columns), then record_num; the result doesn't depend on the number of tasks. Nothing
    is to be seen below ``shards`` before all shards are whole; the manifest, written last, commits the run.
    """
    order = (["input_ordinal"] if "input_ordinal" in e.keys else e.keys) + ["record_num"]
    config = ProfileConfig.of(e.recipe.value_profile) if e.recipe.value_profile else None
    more = {}
    if config:
        types = {f.name: f.dataType.simpleString() for f in e.rows.schema["data"].dataType.fields}
        more = {f"_v{k}": c for k, c in enumerate(texts_of(types, config, lambda n: F.col(f"data.{n}")))}
    env = envelope(e, meta, more)
    size = F.octet_length("value") + 1
    parts = shards_by_bytes(env, order, size, limit, rows) if limit else shards_by_rows(env, order, rows or 1 << 62)
    messages = commit_shards(parts.select("shard", F.col(order[0]).cast("string").alias("input"), "value", *more, *order), order, path, config)
    names = [c.split()[0] for c in MESSAGE.split(", ")][:-1]
    manifest = manifest_of(e) | {"shards": [r.asDict() for r in messages.select(*names).orderBy("shard").collect()]}
    if config:
        manifest["value_profile"] = report(messages.select(states_from_json("profile").alias("s")).select("s.*"), config)
    write_json(env, f"{path}/manifest", manifest)
    return manifest


MESSAGE = "shard long, file string, rows long, bytes long, sha256 string, first_input string, last_input string, profile string"


def commit_shards(rows: DataFrame, order: list[str], path: str, config: ProfileConfig | None = None) -> DataFrame:
    """Writes rows (shard, input, value, order columns) as a file for each shard: staged by tasks, then moved by the driver.

    A task hashes and counts a shard while it writes it, and tells so in one message (rows, bytes, sha256, span of inputs)
    when it ends; a task that fails or runs again tells nothing of its first try. If any of them fails for good the staged
    files are deleted and nothing is visible. Moving needs the name of each shard at the driver. With a profile its fields
    are observed in the same pass (columns ``_v0``, ... beside the value). Returns the messages.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    if _fs(spark, path).exists(_path(spark, f"{path}/shards")):
        raise FileExistsError(f"{path}/shards is there already")
    fields = [f.name for f in config.fields] if config else []
    most = config.max_distinct if config else 0
    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith(" long") else pa.string()) for c in MESSAGE.split(", ")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sink, at, sha, held = None, {}, None, {}

        def close() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pylist([at | {"sha256": sha.hexdigest(), "profile": states_as_json(held) if held else None}], schema)

        try:
            for b in batches:
                own = b.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else []
                for a, z in zip(edges, edges[1:], strict=False):
                    shard, names = int(own[a]), b.column(1)
                    if shard != at.get("shard"):
                        if sink is not None:
                            yield close()
                        at = {"shard": shard, "file": f"shard-{shard:06d}.ndjson-{uuid.uuid4().hex}", "rows": 0, "bytes": 0, "first_input": names[a].as_py()}
                        sha, held = hashlib.sha256(), {f: FieldState(most) for f in fields}
                        sink = create_file(f"{staging}/{at['file']}")
                    data = "".join(f"{v}\n" for v in b.column(2).slice(a, z - a).to_pylist()).encode()
                    sink.write(data)
                    sha.update(data)
                    at |= {"rows": at["rows"] + z - a, "bytes": at["bytes"] + len(data), "last_input": names[z - 1].as_py()}
                    for k, state in enumerate(held.values()):
                        state.observe(b.column(3 + k).slice(a, z - a))
            if sink is not None:
                yield close()
                sink = None
        finally:
            if sink is not None:
                sink.close()

    try:
        dealt = rows.repartitionByRange(n, "shard").sortWithinPartitions("shard", *order).select("shard", "input", "value", *(f"_v{k}" for k in range(len(fields))))
        messages = written(dealt.mapInArrow(write, MESSAGE), "messages")
        fs = _fs(spark, path)
        fs.mkdirs(_path(spark, f"{path}/shards"))
        for m in messages.select("file").collect():
            if not fs.rename(_path(spark, f"{staging}/{m['file']}"), _path(spark, f"{path}/shards/{m['file'].rsplit('-', 1)[0]}")):
                raise OSError(f"can't move {m['file']}")
    except BaseException:
        _fs(spark, path).delete(_path(spark, f"{path}/shards"), True)
        raise
    finally:
        _fs(spark, path).delete(_path(spark, staging), True)
    return messages.withColumn("file", F.regexp_replace("file", "-[0-9a-f]+$", ""))


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest_of(e: Extraction) -> dict[str, Any]:
    """Recipe, counts by disposition and reason, records by selector; Σ of the counts is the number of inputs."""
    d = e.dispositions.groupBy("disposition", "reason").agg(F.count("*").alias("n"), F.sum("records").alias("records")).collect()
    by = {}
    for r in d:
        by[r["disposition"]] = by.get(r["disposition"], 0) + r["n"]
    return {
        "record_type": e.recipe.record_type, "recipe": e.recipe.id, "inputs_total": sum(by.values()), **{f"inputs_{k}": by.get(k, 0) for k in ("applied", "not_applicable", "failed")},
        "records": sum(r["records"] for r in d), "reasons": {r["reason"]: r["n"] for r in sorted(d, key=lambda r: str(r["reason"])) if r["reason"]},
        "fields": [{"name": m.name, "type": m.type, "xpath": m.xpath, "expression": m.expression, "description": m.description} for m in e.recipe.public()],
    }


def write_json(df: DataFrame, path: str, value: Any) -> None:
    """A JSON value as a one-line text file, through Spark's writer."""
    df.sparkSession.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_dispositions(e: Extraction, path: str) -> None:
    """Dispositions of all inputs, and the failed ones, as JSON lines."""
    d = e.dispositions.persist()
    d.write.mode("errorifexists").json(f"{path}/dispositions")
    d.where("disposition = 'failed'").write.mode("errorifexists").json(f"{path}/failures")
    d.unpersist()


def write_parquet(e: Extraction, path: str, compression: str = "zstd", withhold: list[str] | None = None, statistics: bool = False) -> None:
    """The records' data as Parquet: fields in mapping order; withheld ones left out; page and chunk statistics off by default.

    Fields carry their description as column metadata.
    """
    if compression not in ("zstd", "snappy", "gzip", "none"):
        raise ValueError(f"unknown compression {compression!r}")
    lost = [c for c in withhold or () if c not in e.fields]
    if lost:
        raise ValueError(f"withheld columns aren't there: {lost}")
    notes = {m.name: m.description for m in e.recipe.mappings}
    out = e.records.select(*(F.col(f"data.`{f}`").alias(f, metadata={"comment": notes[f]}) if notes.get(f) else F.col(f"data.`{f}`").alias(f) for f in e.fields if f not in (withhold or ())))
    out.write.mode("errorifexists").option("compression", compression).option("parquet.column.statistics.enabled", str(statistics).lower()).option("parquet.bloom.filter.enabled", "false").parquet(path)


def sampled(env: DataFrame, every: int = 100) -> DataFrame:
    """The first, every hundredth and last envelope of the order, for checks of the output."""
    n = numbered(env, ["record_num"], "_n")
    last = n.agg(F.max("_n").alias("_last"))
    return n.crossJoin(F.broadcast(last)).where((F.col("_n") == 1) | (F.col("_n") % every == 0) | (F.col("_n") == F.col("_last"))).drop("_n", "_last")


def invalid_envelopes(env: DataFrame) -> DataFrame:
    """Envelopes that don't parse or lack the record's data or runtime part."""
    parsed = env.withColumn("_j", F.try_parse_json("value"))
    return parsed.where(F.col("_j").isNull() | F.expr("variant_get(_j, '$.extract.data') is null") | F.expr("variant_get(_j, '$._runtime.record_type') is null")).drop("_j")


def column_lineage(e: Extraction) -> DataFrame:
    """Field catalog of the output: name, type, source expression, description."""
    rows = [(m.name, m.spark_type().simpleString(), m.xpath or m.expression, m.description) for m in e.recipe.public()]
    return e.rows.sparkSession.createDataFrame(rows, "field string, type string, source string, description string")
