"""Language identification by string kernels.

Kernel: blended-spectrum presence kernel, the number of n-grams (sizes 1 to 3, hashed bytes of the lower-cased text) that
occur in both texts, divided by the root of both self-counts. Landmarks of a bounded training sample span the Nyström
feature map; kernel ridge regression, one against the rest, is solved there. Since the kernel is linear in a text's
presence vector, a batch is scored as one product: presence matrix times (landmark presence' x coefficients).
N-grams that occur in no landmark have no part in the kernel, nor in the self-counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chargrams import blocks, grams, joined
from .common import arrow_map, id_crc, table

BITS = 18
SIZES = range(1, 4)
LETTER = re.compile(r"[^\W\d_]")


def _presence(texts: list[str], column: np.ndarray, width: int) -> np.ndarray:
    """A row per text, a column per known n-gram: 1 where it occurs; column 0 gathers the unknown ones and is cleared."""
    data, doc = joined([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    m = np.zeros((len(texts), width), np.uint8)
    flat, base = m.reshape(-1), doc.astype(np.int64) * width
    for h in grams(data, SIZES, BITS):
        flat[base[: len(h)] + column[h]] = 1
    m[:, 0] = 0
    return m.astype(np.float32)


@dataclass
class KernelRidge:
    langs: list[str]
    column: np.ndarray
    width: int
    product: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores (share of the clipped one-against-rest outputs); ``und`` and 0 without letters or model."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        live = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        own = [texts[k] for k in live]
        for a, b in blocks(own, 1 << 19):
            for c in range(a, b, 256):
                d = min(b, c + 256)
                p = _presence(own[c:d], self.column, self.width)
                f = (p @ self.product) / np.sqrt(np.maximum(1, p.sum(1)))[:, None]
                share = np.clip((f + 1) / 2, 1e-6, None)
                best = share.argmax(1)
                got = share[np.arange(len(best)), best] / share.sum(1)
                for k, j, s in zip(live[c:d], best, got, strict=True):
                    names[k], scores[k] = self.langs[j], min(1.0, float(s))
        return names, scores


def fit(texts: list[str], langs: list[str], landmarks: int = 256, ridge: float = 1e-3) -> KernelRidge:
    """Kernel ridge regression in the span of ``landmarks`` texts, taken evenly over the languages in the order given."""
    known = sorted(set(langs))
    if not known:
        return KernelRidge([], np.zeros(1 << BITS, np.int64), 1, np.zeros((1, 0), np.float32))
    by = {g: [k for k, x in enumerate(langs) if x == g] for g in known}
    picked = sorted(k for g in known for k in by[g][: max(1, landmarks // len(known))])
    data, _ = joined([texts[k].lower().encode("utf-8", "surrogatepass") for k in picked])
    seen = np.unique(np.concatenate(list(grams(data, SIZES, BITS))))
    column = np.zeros(1 << BITS, np.int64)
    column[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    norm = lambda p: p / np.sqrt(np.maximum(1, p.sum(1)))[:, None]
    marks = norm(_presence([texts[k] for k in picked], column, width))
    kmm = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kmm)
    ok = values > 1e-6 * values.max(initial=1e-12)
    root = vectors[:, ok] / np.sqrt(values[ok])
    knm = np.concatenate([norm(_presence(texts[k : k + 64], column, width)) @ marks.T for k in range(0, len(texts), 64)])
    phi = knm @ root
    y = np.where(np.array(langs)[:, None] == np.array(known)[None, :], 1.0, -1.0)
    coef = np.linalg.solve(phi.T @ phi + ridge * len(texts) * np.eye(phi.shape[1]), phi.T @ y)
    return KernelRidge(known, column, width, (marks.T @ (root @ coef)).astype(np.float32))


def lowest(rows: DataFrame, share: int) -> DataFrame:
    """Of rows (g, i, h) at least the ``share`` lowest hashes of each g: each task gives those of its own rows, so that few rows of one g meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            code = t.column("g").combine_chunks().dictionary_encode().indices.to_numpy()
            order = np.lexsort((t.column("i").to_numpy(), t.column("h").to_numpy(), code))
            own = code[order]
            place = np.arange(len(own)) - np.searchsorted(own, own)
            return t.take(pa.array(order[place < share])).combine_chunks().to_batches()[0]

        size = most = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size > max(100_000, 2 * most):
                held = [cut()]
                size = most = held[0].num_rows
        if held:
            yield cut()

    return arrow_map(rows, run, rows.schema)


def train(documents: DataFrame, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KernelRidge:
    """Fits on at most ``sample`` rows with a language, a letter and crc32(id) mod 5 not 0; twice as many where ids repeat.

    Every language has an equal share of the sample (8 rows at least, or all it has): its rows of the lowest id hashes.
    """
    rows = documents.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("g")).where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col(text_col).rlike(r"\p{L}") & (id_crc("i") % 5 != 0))
    langs = rows.agg(F.count_distinct("g")).first()[0]
    share = max(8, sample // max(1, langs))
    hashes = rows.select("g", F.col("i").cast("long").alias("i"), F.xxhash64("i", F.lit(29)).alias("h"))
    first = Window.partitionBy("g").orderBy("h", "i")
    picked = lowest(hashes, share).withColumn("r", F.row_number().over(first)).where(F.col("r") <= share).select("i").distinct()
    sample = share * max(1, langs)
    own = documents.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("g")).where("t is not null and g is not null")
    got = sorted(own.join(F.broadcast(picked), F.col("d") == F.col("i")).select("d", "g", "t").orderBy("d", "g", "t").limit(2 * sample).collect(), key=lambda r: (r["d"], r["g"], r["t"]))
    got = [r for r in got if LETTER.search(r["t"])]
    return fit([r["t"] for r in got], [r["g"] for r in got])


def identify(df: DataFrame, model: KernelRidge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; null texts and texts without a letter give ``und`` and 0, repeated rows are kept.

    Ties go to the language that comes first in the alphabet; a model without languages gives ``und`` for all.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            names, scores = held.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicts the language of every text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(table(spark, sf_dir, "documents", spread=False)))
    return out.select(F.col("id").alias("doc_id"), (id_crc("id") % 5 == 0).alias("held_out"), "lang_pred", "score")
