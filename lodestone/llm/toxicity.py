"""Toxicity: linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its lower-cased form, ASCII punctuation and digits read as spaces.
Each feature's value is its log-count ratio r between toxic and other training texts; a logistic regression on these
values gives the score. Only a bounded sample of the training rows is read (``sample``); every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chargrams import blocks, grams, joined
from .common import arrow_map, give_back, id_crc, labelled_sample, sigmoid, table
from .linear import fit_logistic

BITS = 20
SIZES = range(4, 7)
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _raw(texts: list[str]) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass").translate(_PLAIN) for t in texts]


@dataclass
class NbLinear:
    """The fitted model: ``slot`` maps a hashed n-gram to a weight (0: none); ``weight[0]`` is 0."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        if len(self.weight) > 1:
            for a, b in blocks(texts):
                data, doc = joined(_raw(texts[a:b]))
                hits = []
                for h in grams(data, SIZES, BITS):
                    s = self.slot[h]
                    at = np.flatnonzero(s)
                    hits.append(doc[at].astype(np.int64) * len(self.weight) + s[at])
                key = np.unique(np.concatenate(hits))
                out[a:b] = np.bincount(key // len(self.weight), self.weight[key % len(self.weight)], b - a)
        return sigmoid(out + self.bias)


def fit(texts: list[str], labels: np.ndarray, alpha: float = 1.0, least_docs: int = 3, least_ratio: float = 0.7, l2: float = 1e-5) -> NbLinear:
    """Fits on the texts; n-grams of fewer than ``least_docs`` texts or with a ratio nearer to 0 than ``least_ratio`` get no weight.

    No texts give score 0 for all; one class alone gives its share, smoothed.
    """
    y = labels.astype(np.float64)
    slot = np.zeros(1 << BITS, np.int32)
    prior = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.0
    plain = NbLinear(slot, np.zeros(1), float(np.log(prior / (1 - prior))) if len(y) else -40.0)
    if not len(y) or y.min() == y.max():
        return plain
    rows = []
    for t in texts:
        data, _ = joined(_raw([t]))
        rows.append(np.unique(np.concatenate(list(grams(data, SIZES, BITS)))).astype(np.int32))
    pos = np.zeros(1 << BITS)
    neg = np.zeros(1 << BITS)
    for row, v in zip(rows, y, strict=True):
        (pos if v else neg)[row] += 1
    p, q = (alpha + pos) / (alpha + y.sum()), (alpha + neg) / (alpha + (1 - y).sum())
    ratio = np.log(p / q)
    keep = np.flatnonzero((pos + neg >= least_docs) & (np.abs(ratio) >= least_ratio))
    if not len(keep):
        return plain
    slot[keep] = np.arange(1, len(keep) + 1)
    r = ratio[keep]
    chunks = []  # features of some hundred texts each: (feature, text, ratio), so that no step needs large arrays
    for k in range(0, len(rows), 250):
        cols = [slot[x] for x in rows[k : k + 250]]
        cols = [c[c > 0] - 1 for c in cols]
        idx = np.concatenate(cols)
        chunks.append((idx, np.repeat(np.arange(len(cols), dtype=np.int32), [len(c) for c in cols]), r[idx].astype(np.float32), len(cols)))
    del rows

    def forward(w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(doc, w[idx] * scaled, n) for idx, doc, scaled, n in chunks])

    def back(g: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(keep)), 0
        for idx, doc, scaled, n in chunks:
            out += np.bincount(idx, g[at : at + n][doc] * scaled, len(keep))
            at += n
        return out

    w, bias = fit_logistic(forward, back, y, len(keep), l2, rounds=60)
    return NbLinear(slot, np.concatenate([[0.0], r * w]), bias)


def train(documents: DataFrame, labels: DataFrame, sample: int = 4000) -> NbLinear:
    """Fits on at most ``sample`` labelled rows whose crc32(doc_id) mod 5 isn't 0."""
    rows = labelled_sample(documents, labels, "toxic", sample, where=id_crc("_sid") % 5 != 0).collect()
    rows.sort(key=lambda x: (x["id"], x["label"], x["text"]))
    model = fit([x["text"] for x in rows], np.array([x["label"] for x in rows]))
    del rows
    give_back()  # the driver's too, which plans the stages to come
    return model


def score_toxicity(df: DataFrame, model: NbLinear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, toxicity score) of every row; null and empty texts get the model's base score, repeated rows are kept."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.scores(b.column(1).to_pylist()))], ["id", "score"])

    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), run, "id long, score double")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores every text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    model = train(table(spark, sf_dir, "documents", spread=False), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(F.col("id").alias("doc_id"), (id_crc("id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a toxicity score of at least 0.5 go, ties at 0.5 too; all columns of ``docs`` stay."""
    model = train(table(spark, sf_dir, "documents", spread=False), table(spark, sf_dir, "labels"))
    held = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            keep = held.value.scores([t or "" for t in b.column(at).to_pylist()]) < 0.5
            yield b.filter(pa.array(keep))

    return arrow_map(docs, run, docs.schema)
