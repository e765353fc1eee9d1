"""Target-distribution importance resampling: documents are drawn by hashed n-gram likelihood ratios and Gumbel noise.

Identical texts are collapsed by grouping the full text; a group's features and weight are computed once and its counts
multiplied by its number of rows. Weights are joined back to the rows by a digest of the text before the noise of each
document is added: texts that fill more than their share of rows are few and joined by broadcast, all others by a shuffle.
Features are kept as bucket numbers, so words are cut and hashed once. Ranks come from ranges of the final order.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, partitions, table, written
from .wordlists import flat_rows, packed_rows, starts_of, word_lists

#: What lies between words, of texts whose A-Z are lower-cased.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: A text is hot beyond this many rows and beyond a quarter of a shuffle partition's share of them.
HOT_ROWS = 1000


def buckets_of(texts: pa.Array, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features, text by text, and of each text the numbers of features and of words.

    Features are the runs of ``low`` to ``high`` consecutive words, joined by one space; shorter runs come first in a text.
    """
    words, n_words = word_lists(texts, SEPARATORS)
    start = starts_of(n_words)
    parts, owners = [], []
    for n in range(low, high + 1):
        runs = np.maximum(n_words - n + 1, 0)
        owner = np.repeat(np.arange(len(runs)), runs)
        at = np.arange(int(runs.sum())) - np.repeat(starts_of(runs)[:-1], runs) + start[owner]
        cols = [words.take(pa.array(at + k)) for k in range(n)]
        coded = (pc.binary_join_element_wise(*cols, " ") if n > 1 else cols[0]).dictionary_encode()
        crc = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary)) % buckets
        parts.append(crc[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64))
        owners.append(owner)
    flat, owner = np.concatenate(parts), np.concatenate(owners)
    if high > low:
        flat = flat[np.argsort(owner, kind="stable")]
    return flat, np.bincount(owner, minlength=len(n_words)).astype(np.int64), n_words


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows (``m`` times each row's ``b``) lie in each bucket; the driver gets ``buckets`` numbers."""
    dtype = _dtype(buckets)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            flat, n = flat_rows(batch.column(1), dtype)
            total += np.bincount(flat, weights=np.repeat(batch.column(0).to_numpy(), n), minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["k", "s"])

    out = np.zeros(buckets, np.int64)
    for r in arrow_map(rows.select("m", "b"), tally, "k int, s long").groupBy("k").agg(F.sum("s").alias("s")).collect():
        out[r["k"]] = r["s"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the thousandfold log ratio of its smoothed shares of the target's and the source's features, rounded down."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: str, doc_id: str) -> Column:
    """The thousandfold Gumbel noise of a document, rounded down: from the first 32 bits of sha256 of seed and id (null: empty)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _dtype(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _featurised(rows: DataFrame, low: int, high: int, buckets: int) -> DataFrame:
    """(h, m, words, b) of rows (h, m, t): b holds the buckets of a text's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            flat, n, n_words = buckets_of(batch.column(2), low, high, buckets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words), packed_rows(flat.astype(_dtype(buckets)), n).cast(pa.binary())], ["h", "m", "words", "b"])

    return arrow_map(rows, run, "h string, m long, words long, b binary")


def _weighted(groups: DataFrame, gain: np.ndarray) -> DataFrame:
    """(h, m, words, f, w) of the groups: numbers of rows, words and features, and the sum of the features' gains."""
    dtype = _dtype(len(gain))
    shared = groups.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            flat, n = flat_rows(batch.column(3), dtype)
            sums, at = np.concatenate([[0], np.cumsum(shared.value[flat])]), starts_of(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(sums[at[1:]] - sums[at[:-1]])], ["h", "m", "words", "f", "w"])

    return arrow_map(groups, run, "h string, m long, words long, f long, w long")


def _numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``r``, their place from 1 in the given order: ranges of rows, and the driver gets one count for each."""
    spark, n = rows.sparkSession, partitions(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(k + 1, k + 1 + b.num_rows))], [*b.schema.names, "_part", "r"])
            k += b.num_rows

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = written(arrow_map(rows.repartitionByRange(n, *order).sortWithinPartitions(*order), count, f"{kinds}, _part int, r long"), "ordered")
    sizes = sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before = list(zip((p for p, _ in sizes), [0, *accumulate(n for _, n in sizes)], strict=False))
    base = spark.createDataFrame(before, "_part int, _before long")
    return dealt.join(F.broadcast(base), "_part").withColumn("r", F.col("r") + F.col("_before")).drop("_part", "_before")


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, low: int = 1, high: int = 1, buckets: int = 10_000, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Draws ``percent`` of the documents that have ``least_words`` words, more likely the more alike ``target`` they are.

    Returns doc_id, n_features, weight, score and rank (null where undrawn) of every row. A null text is an empty one and
    has no features; weight is 0 then. Repeated rows are documents of their own, with equal weights and noise; of equal
    scores the smaller id ranks first, null ids last, rows of one id in any order. An empty target or table is allowed.
    The driver and tasks hold ``buckets`` numbers; the rows joined by broadcast are at most four for each shuffle partition.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    texts = docs.groupBy("t").agg(F.count("*").alias("m")).select(F.sha2(F.col("t").cast("binary"), 256).alias("h"), "m", "t")
    groups = written(_featurised(texts, low, high, buckets), "distinct-texts")
    wanted = target.select(F.lit("").alias("h"), F.lit(1).cast("long").alias("m"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    gain = gains(bucket_counts(groups, buckets), bucket_counts(_featurised(wanted, low, high, buckets), buckets))
    weights = written(_weighted(groups, gain), "weights")
    total = weights.agg(F.sum("m").alias("all"), F.sum(F.when(F.col("words") >= least_words, F.col("m"))).alias("enough")).first()
    limit = max(HOT_ROWS, (total["all"] or 0) // (4 * partitions(spark)))
    hot = weights.where(F.col("m") > limit).select(F.col("h").alias("hot"), F.struct("words", "f", "w").alias("hot_row"))
    rest = weights.where(F.col("m") <= limit).select("h", F.struct("words", "f", "w").alias("row"))
    own = docs.select("i", F.sha2(F.col("t").cast("binary"), 256).alias("d"), F.monotonically_increasing_id().alias("u"))
    # a row whose text is hot has its weight already; it goes through the second join by a key that no text has
    own = own.join(F.broadcast(hot), F.col("d") == F.col("hot"), "left").withColumn("k", F.when(F.col("hot").isNull(), F.col("d")).otherwise(F.concat(F.lit("-"), F.col("u").cast("string"))))
    got = own.join(rest, F.col("k") == F.col("h"), "left").select("i", "u", F.coalesce("hot_row", "row").alias("row")).select("i", "u", "row.*")
    scored = got.select("i", "f", "w", (F.col("w") + noise(seed, "i")).alias("s"), (F.col("words") >= least_words).alias("e"), "u")
    ranked = _numbered(scored, F.col("e").desc(), F.col("s").desc(), F.col("i").asc_nulls_last(), F.col("u").asc())
    drawn = F.col("e") & (F.col("r") <= percent * (total["enough"] or 0) // 100)
    return ranked.select(F.col("i").alias("doc_id"), F.col("f").alias("n_features"), F.col("w").alias("weight"), F.col("s").alias("score"), F.when(drawn, F.col("r")).alias("rank"))


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    """Draws a tenth of ``documents`` towards ``benchmark``, by single words in 10,000 buckets."""
    return resample(table(spark, sf_dir, "documents", spread=False), table(spark, sf_dir, "benchmark"))
