"""What the operators of this subpackage share: shared storage, table access, hashing and the bounded training sample."""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Bytes of an Arrow batch, where the session sets no bound: the rows of a batch alone bound nothing where texts are long.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A table of the data folder, through Spark's own reader.

    Texts of fewer splits than half the cores (a small table in one file) are dealt over all cores, since the work is in
    the Python behind the scan; a table of more splits, or without ``spread``, is read as it is, without a shuffle.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and name in ("documents", "conversations") and 2 * df.rdd.getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Unset is allowed for a local master only (tests); a temporary folder is set then.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="lodestone-")
        shared_dir.own = found
    return found.rstrip("/")


_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def remove_work(spark: SparkSession) -> int:
    """Deletes what this driver's operators have put in the shared folder, once their results are written elsewhere."""
    jvm, n = spark.sparkContext._jvm, 0
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the user sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI and the path in it; the Hadoop names of S3 (``s3a``, ``s3n``) are known too."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def id_ranges(ids: DataFrame, n: int) -> Callable[[str, str], Column]:
    """Cuts the one column of ``ids`` (long) into ``n`` ascending ranges of like numbers of rows; reads that column only.

    Returns what gives a row's range from its id and a hash (long): null ids come first, and an id that fills several
    ranges is dealt over them in the order of the hash. A row is compared with about two square roots of ``n`` bounds.
    """
    (c,) = ids.columns
    low = -(1 << 63)
    bounds = [int(x) for x in ids.select(F.coalesce(F.col(c), F.lit(low)).cast("double").alias("k")).approxQuantile("k", [j / n for j in range(1, n)], 0.25 / n)] if n > 1 else []
    wide = max(1, math.isqrt(len(bounds)))
    rows = [bounds[a : a + wide] for a in range(0, len(bounds), wide)]

    def longs(x: list[int]) -> Column:
        return F.array(*(F.lit(max(low, min((1 << 63) - 1, v))).cast("long") for v in x))

    def of(col: str, tie: str) -> Column:
        key = F.coalesce(F.col(col), F.lit(low))
        if not rows:
            return F.lit(0)

        def before(test: Callable[[Column], Column]) -> Column:
            """How many bounds meet the test, which the first ones do."""
            whole = F.size(F.filter(longs([r[-1] for r in rows]), test))
            part = F.when(whole < len(rows), F.size(F.filter(F.element_at(F.array(*map(longs, rows)), F.least(whole + 1, F.lit(len(rows)))), test))).otherwise(0)
            return F.least(whole * wide, F.lit(len(bounds))) + part

        first, last = before(lambda b: b < key), before(lambda b: b <= key)
        share = F.col(tie) / F.lit(2.0**64) + 0.5
        return F.when(first == last, first).otherwise(first + F.least(F.floor(share * (last - first + 1)), last - first)).cast("int")

    return of


def id_crc(col: str | Column) -> Column:
    """Unsigned crc32 of an id's decimal text; a null id counts as an empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def py_id_crc(value: int | None) -> int:
    """The same as :func:`id_crc`, in Python."""
    return zlib.crc32(b"" if value is None else str(value).encode())


def give_back() -> None:
    """Returns freed memory to the machine, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches that ``fn`` gets as Arrow record batches; empty batches are left out.

    Batches hold about ``BATCH_BYTES``, a longer row alone is one; results don't depend on it. The bound is set for the
    session, unless that has one. A task gives unused memory back when it ends, Arrow's and the C library's, since workers
    are used again by later stages.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(b for b in batches if b.num_rows)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """At most ``rows`` labels' documents (id, text, label, extra): those whose ids hash lowest; twice as many where ids repeat.

    The choice is made on ids alone; the ids broadcast for the join are at most ``rows``.
    """
    picked = labels.select(F.col(id_col).alias("_sid"), F.col(label).cast("int").alias("_label")).where("_sid is not null and _label in (0, 1)")
    if where is not None:
        picked = picked.where(where)
    picked = picked.orderBy(F.xxhash64(F.col("_sid"), F.lit(17)), "_sid", "_label").limit(rows)
    docs = documents.select(F.col(id_col).alias("_did"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *(F.col(c).alias(f"_x_{c}") for c in extra))
    own = docs.join(F.broadcast(picked), F.col("_did") == F.col("_sid")).select(F.col("_did").alias("id"), F.col("_text").alias("text"), F.col("_label").alias("label"), *(F.col(f"_x_{c}").alias(c) for c in extra))
    return own.orderBy("id", "label", "text").limit(2 * rows)
