"""Quality classifier by co-training.

Two logistic models see each document from sides that don't share features: the text content (hashed byte pairs, word,
line and character statistics) and the page metadata (recorded source, language and length; nothing of the text). Starting
from the labelled sample, each model labels in every round those of all unlabelled documents that it is most sure of, for
the other one: one pass over the corpus a round. On labelled rows set aside both are calibrated (Platt) and a logistic model combines the two calibrated views.
The rows that reach a fit are bounded (``labelled`` rows, shares of ``unlabelled`` pseudo-labelled ones); every document is
offered and scored whole.

Null and empty texts have the features of an empty text, null metadata have places of their own; repeated rows are scored
each, and offered once. Ties of equally sure rows go by a hash of the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, give_back, labelled_sample, sigmoid, table, written
from .linear import fit_dense

PAIRS, STATS = 1024, 13
#: Hashed places of sources, languages and both together, and one of each power of two of the recorded length.
SOURCES, LANGS, BOTH, LENGTHS = 256, 64, 512, 33
#: Labelled ids that are broadcast, 8 bytes each.
LABELS = 2_000_000
META = 3 + SOURCES + LANGS + BOTH + LENGTHS
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))


def text_view(text: str) -> np.ndarray:
    """Roots of the shares of hashed byte pairs, and statistics of words, lines and characters, of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = np.zeros(PAIRS + STATS, np.float32)
    if len(b) > 1:
        pair = ((b[:-1] * np.uint32(257) + b[1:]) * np.uint32(2654435761)) >> np.uint32(22)
        out[:PAIRS] = np.sqrt(np.bincount(pair, minlength=PAIRS) / len(pair))
    words = raw.split()
    if words:
        out[PAIRS : PAIRS + 4] = len(set(words)) / len(words), min(len(raw) / len(words), 40) / 10, min(len(words), 1000) / 1000, float(np.mean([w == v for w, v in zip(words, words[1:], strict=False)] or [0]))
    n, lines = max(1, len(raw)), raw.count(b"\n") + 1
    share = [4 * np.sqrt(1 - len(raw.translate(None, cls)) / n) for cls in (_PUNCT, _DIGITS, _UPPER, b" ", b"|")]
    out[PAIRS + 4 :] = np.log1p(lines) / 5, np.log1p(len(raw) / lines) / 10, len(text) / n, *share, 0.0 if raw else 1.0
    return out


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """What is recorded about a document beside its text; nulls have a place of their own."""
    out = np.zeros(META, np.float32)
    size = -1 if n_chars is None else max(0, n_chars)
    out[:3] = np.log1p(max(0, size)) / 10, size < 0, source is None
    at = 3
    for name, wide, seed in ((source or "", SOURCES, 3), (lang or "", LANGS, 5), (f"{source}\n{lang}", BOTH, 7)):
        out[at + xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass"), seed) % wide] = 0.5
        at += wide
    if size >= 0:
        out[at + min(LENGTHS - 1, size.bit_length())] = 0.5
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class CoTrained:
    """Weights and intercepts of both views, their calibration, and the combination (two weights, intercept)."""

    text: tuple[np.ndarray, float]
    meta: tuple[np.ndarray, float]
    text_platt: tuple[float, float]
    meta_platt: tuple[float, float]
    both: tuple[float, float, float]
    pseudo: int = 0

    def views(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        zt, zm = xt @ self.text[0] + self.text[1], xm @ self.meta[0] + self.meta[1]
        return sigmoid(self.text_platt[0] * zt + self.text_platt[1]), sigmoid(self.meta_platt[0] * zm + self.meta_platt[1])

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, q = self.views(xt, xm)
        return p, q, sigmoid(self.both[0] * _logit(p) + self.both[1] * _logit(q) + self.both[2])


Model = tuple[np.ndarray, float]
#: From both models, the rows wanted of label 1 and 0 and the keys that each view has: of each view's model (key, label) of
#: its surest rows for the other view, and the views' features by key.
Offer = Callable[[list[Model], dict[int, int], list[dict[int, float]]], tuple[list[list[tuple[int, float]]], dict[int, tuple[np.ndarray, np.ndarray]]]]


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, offer: Offer, most: int, rounds: int = 4, l2: float = 1e-4) -> CoTrained:
    """Co-trains on labelled rows (views ``xt``, ``xm``, labels ``y``) and the unlabelled ones that ``offer`` finds.

    Every fourth labelled row is set aside for calibration. A round gives each model at most ``most`` rows in all, by the
    labels' shares, of which the other model is surest. Fewer than eight labelled rows, or
    one class only, give a constant score (the smoothed share of label 1; 1 without labels, so that nothing is rejected).
    """
    if len(y) < 8 or len(np.unique(y)) < 2 or len(np.unique(y[3::4])) < 2 or len(np.unique(np.delete(y, np.s_[3::4]))) < 2:
        prior = float(_logit(np.array([(y.sum() + 1) / (len(y) + 1)]))[0])
        zero = (np.zeros(PAIRS + STATS), 0.0), (np.zeros(META), 0.0)
        return CoTrained(*zero, (1.0, 0.0), (1.0, 0.0), (0.0, 0.0, prior))
    aside = np.zeros(len(y), bool)
    aside[3::4] = True
    x, own = (xt[~aside], xm[~aside]), y[~aside].astype(np.float64)
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    taken: list[dict[int, float]] = [{}, {}]  # pseudo-labels that each view's model has got
    models = []
    for r in range(rounds + 1):
        models = []
        for v in (0, 1):
            rows = sorted(taken[v])
            data = np.concatenate([x[v], np.stack([held[k][v] for k in rows])]) if rows else x[v]
            models.append(fit_dense(data, np.concatenate([own, [taken[v][k] for k in rows]]), l2, np.concatenate([np.ones(len(own)), np.full(len(rows), 0.5)]), rounds=60))
        if r == rounds or most < 1:
            break
        share = {1: max(1, int(most * own.mean())), 0: max(1, int(most * (1 - own.mean())))}
        found, features = offer(models, share, taken)
        held |= features
        for v in (0, 1):
            taken[1 - v].update(found[v])
    cal = y[aside].astype(np.float64)
    platt = []
    for v, data in enumerate((xt[aside], xm[aside])):
        w, b = fit_dense((data @ models[v][0] + models[v][1])[:, None], cal, 1e-3)
        platt.append((float(w[0]), b))
    out = CoTrained(models[0], models[1], platt[0], platt[1], (0.5, 0.5, 0.0), len(taken[0]) + len(taken[1]))
    p, q = out.views(xt[aside], xm[aside])
    w, b = fit_dense(np.stack([_logit(p), _logit(q)], 1), cal, 1e-3)
    out.both = (float(w[0]), float(w[1]), b)
    return out


_COLS = ("lang", "source", "n_chars")


def _features(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.stack([text_view(r["text"]) for r in rows]) if rows else np.zeros((0, PAIRS + STATS), np.float32),
        np.stack([meta_view(r["lang"], r["source"], r["n_chars"]) for r in rows]) if rows else np.zeros((0, META), np.float32),
    )


def _surest(keys: np.ndarray, conf: np.ndarray, sure: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` surest distinct keys of at least ``sure``, ties by key."""
    live = np.flatnonzero(conf >= sure)
    live = live[np.lexsort((keys[live], -conf[live]))]
    _, first = np.unique(keys[live], return_index=True)
    live = live[np.sort(first)][:most]
    return keys[live], conf[live]


def _offer(docs: DataFrame, labels: DataFrame, sure: float) -> Offer:
    """Offers all documents without a label, each distinct row once, by its hash.

    A task sends no more than the surest rows that could be wanted, so a pass doesn't shuffle the corpus. Up to
    ``LABELS`` labelled ids are broadcast; more are joined by a shuffle.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("key", F.xxhash64("text", *_COLS))
    marked = labels.select(F.col("doc_id").cast("long").alias("_labelled")).where("_labelled is not null").distinct()
    free = keyed.join(F.broadcast(marked) if marked.count() <= LABELS else marked, F.col("doc_id") == F.col("_labelled"), "left_anti").select("key", "text", *_COLS)

    def offer(models: list[Model], share: dict[int, int], taken: list[dict[int, float]]) -> tuple[list[list[tuple[int, float]]], dict[int, tuple[np.ndarray, np.ndarray]]]:
        held = spark.sparkContext.broadcast(models)
        most = {(v, label): share[label] + len(taken[1 - v]) for v in (0, 1) for label in (0, 1)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            best = {x: (np.zeros(0, np.int64), np.zeros(0)) for x in most}
            for b in batches:
                for part in _parts(b):
                    x, key = _views(part), part.column(0).to_numpy()
                    for v in (0, 1):
                        p = sigmoid(x[v] @ held.value[v][0] + held.value[v][1])
                        for label, conf in ((1, p), (0, 1 - p)):
                            k, c = best[v, label]
                            best[v, label] = _surest(np.append(k, key), np.append(c, conf), sure, most[v, label])
            for (v, label), (k, c) in best.items():
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(k), pa.int32()), pa.array([label] * len(k), pa.int32()), pa.array(k), pa.array(c)], ["v", "label", "key", "c"])

        seen = written(arrow_map(free, run, "v int, label int, key long, c double").groupBy("v", "label", "key").agg(F.max("c").alias("c")), "sure")
        found: list[list[tuple[int, float]]] = [[], []]
        for v, label in most:
            rows = seen.where((F.col("v") == v) & (F.col("label") == label)).orderBy(F.desc("c"), "key").limit(most[v, label]).collect()
            found[v] += [(r["key"], float(label)) for r in rows if r["key"] not in taken[1 - v]][: share[label]]
        wanted = sorted({k for f in found for k, _ in f})
        names = spark.createDataFrame([(k,) for k in wanted], "key long")
        rows = keyed.join(F.broadcast(names), "key").dropDuplicates(["key"]).collect() if wanted else []
        rows.sort(key=lambda r: r["key"])
        return found, {r["key"]: x for r, *x in zip(rows, *_features(rows), strict=True)}

    return offer


def train(documents: DataFrame, labels: DataFrame, labelled: int = 3000, unlabelled: int = 3000, share: float = 0.1, sure: float = 0.95) -> CoTrained:
    """Trains on at most so many labelled documents, those of the lowest id hashes (twice as many where ids repeat), and on
    pseudo-labels of all others: a round gives each model at most ``share`` of ``unlabelled`` rows (or of all, where they are
    fewer) whose probability under the other model is at least ``sure``, the surest of the whole corpus."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *_COLS)
    rows = sorted(labelled_sample(docs, labels, "quality", labelled, extra=_COLS).collect(), key=lambda r: (r["id"], r["label"], r["text"]))
    order = np.random.default_rng(5).permutation(len(rows))
    rows = [rows[k] for k in order]
    xt, xm = _features(rows)
    free = docs.select("doc_id").join(labels.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_anti").limit(unlabelled).count()
    y = np.array([r["label"] for r in rows])
    del rows
    model = co_train(xt, xm, y, _offer(docs, labels, sure), max(1, int(share * free)) if free else 0)
    del xt, xm
    give_back()  # the driver's too, which plans the stages to come
    return model


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces, so that features take little memory."""
    for a in range(0, b.num_rows, 256):
        yield b.slice(a, 256)


def _views(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    xt, xm = np.empty((b.num_rows, PAIRS + STATS), np.float32), np.empty((b.num_rows, META), np.float32)
    cols = [b.column(b.schema.names.index(c)).to_pylist() for c in ("text", *_COLS)]
    for k, (text, lang, source, n) in enumerate(zip(*cols, strict=True)):
        xt[k], xm[k] = text_view(text or ""), meta_view(lang, source, n)
    return xt, xm


def _scored(model: CoTrained, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return model.scores(*_views(b))


def score_quality(documents: DataFrame, model: CoTrained, id_col: str = "doc_id") -> DataFrame:
    """(id, text_score, meta_score, score) of every row; null texts count as empty, repeated rows are kept."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b):
                p, q, s = _scored(held.value, part)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(np.float64)) for x in (p, q, s))], ["id", "text_score", "meta_score", "score"])

    return arrow_map(documents.select(F.col(id_col).cast("long").alias("id"), "text", *_COLS), run, "id long, text_score double, meta_score double, score double")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Scores every document; ``keep`` is false for those more likely of quality 0 (a score of exactly 0.5 keeps)."""
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, train(table(spark, sf_dir, "documents", spread=False), table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).alias("keep"))


def filter_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a quality score below 0.5 go, those of exactly 0.5 stay; all columns of ``docs`` stay."""
    held = spark.sparkContext.broadcast(train(table(spark, sf_dir, "documents", spread=False), table(spark, sf_dir, "labels")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b):
                yield part.filter(pa.array(_scored(held.value, part)[2] >= 0.5))

    return arrow_map(docs, run, docs.schema)
