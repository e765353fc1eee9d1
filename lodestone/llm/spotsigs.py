"""Document fingerprints by spot signatures: chains of content words that follow common-word anchors.

Every anchor begins a spot: the anchor and the next ``CHAIN`` words that are no anchors. A document's fingerprint is the
set of its spots, hashed to 32 bits and written in ascending order. A text without any whole spot takes each of its words
as an anchor and shorter chains at its end; a text without words has the empty fingerprint. Two fingerprints are compared
by Jaccard similarity, pruned by set sizes first; two empty ones are alike (1), an empty and a full one aren't (0).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix64, partitions, table

CHAIN = 2
# Common words of the languages of the corpus.
ANCHORS = frozenset(
    "a an and are as at be by for from has he in is it of on or that the this to was were will with "
    "der die das und ist in den von zu mit ein eine auf für nicht sich des dem im "
    "le la les de des du et un une est que qui en pour dans au sur par ce il elle "
    "el los las y se no su con al lo como más del una es por para".split()
)
WORD = re.compile(r"\w+")


class _Hashes(dict):
    """Hash of each word; the lowest bit tells anchors. Emptied by its user when large."""

    def __missing__(self, word: str) -> int:
        h = (xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & ~1) | (word in ANCHORS)
        self[word] = h
        return h


_HASHES = _Hashes()


def spots(text: str) -> np.ndarray:
    """The distinct spot hashes of a text, ascending."""
    words = WORD.findall(text.lower())
    if len(_HASHES) > 300_000:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    anchor = (h & np.uint64(1)).astype(bool)
    content = np.flatnonzero(~anchor)
    at = np.flatnonzero(anchor)
    first = np.searchsorted(content, at)
    whole = first + CHAIN <= len(content)
    at, first = at[whole], first[whole]
    if len(at):
        chain = h[at]
        for k in range(CHAIN):
            chain = mix64(chain) + h[content[first + k]]
    else:
        chain = h.copy()
        for k in range(1, CHAIN + 1):
            chain[: len(h) - k] = mix64(chain[: len(h) - k]) + h[k:]
    return np.unique((mix64(chain) >> np.uint64(32)).astype(np.uint32))


def packed(sig: np.ndarray) -> str:
    """A fingerprint as text: the spots, big-endian, in base 64."""
    return base64.b64encode(sig.astype(">u4").tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard similarity; 0 without a comparison where the set sizes alone keep it below ``at_least`` or empty meets full."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if not small or small < at_least * large:
        return 0.0
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (small + large - both)


def length_ranges(least: float, longest: int) -> list[int]:
    """Lower ends of set-length partitions: sets that are ``least`` alike lie in the same or neighbouring partitions."""
    ends = [1]
    while ends[-1] <= longest:
        ends.append(max(ends[-1] + 1, int(np.ceil(ends[-1] / least))))
    return ends


def similar(sets: list[np.ndarray], least: float = 0.8) -> list[tuple[int, int, float]]:
    """All pairs of one task's sets that are at least ``least`` alike, by length partitions, prefix lists and pruned Jaccard."""
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), k))
    ends = length_ranges(least, max((len(s) for s in sets), default=0))
    lists: dict[tuple[int, int], list[int]] = {}
    out: list[tuple[int, int, float]] = []
    empty = [k for k in order if not len(sets[k])]
    out += [(min(empty[0], k), max(empty[0], k), 1.0) for k in empty[1:]]
    for k in order[len(empty) :]:
        s = sets[k]
        part = int(np.searchsorted(ends, len(s), "right")) - 1
        prefix = s[: len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1].tolist()
        seen: set[int] = set()
        for p in (part - 1, part):
            for x in prefix:
                seen.update(lists.get((p, x), ()))
        for j in sorted(seen):
            v = likeness(sets[j], s, least)
            if v >= least:
                out.append((min(j, k), max(j, k), v))
        for x in prefix:
            lists.setdefault((part, x), []).append(k)
    return sorted(out)


def near_duplicates(documents: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents whose fingerprints are at least ``percent`` alike: doc_id, n_shingles (spots), component_id, n_links.

    Fingerprints are partitioned by set length and meet by equal parts, as in the Jaccard join; no list of a spot is paired out.
    """
    from .jaccard_join import jaccard_components

    return jaccard_components(documents, num=percent, id_col=id_col, text_col=text_col, make=_wide_spots)


def _wide_spots(text: str) -> np.ndarray:
    return spots(text).astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first code points of the following one, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_spots long"


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to it and to the next document.

    Documents follow each other by id, null ids first, equal ids by text; the last one is followed by the first. Texts are
    shuffled once: ranges of ids are buckets, each bucket also gets the first document of the next one.
    """
    spark = documents.sparkSession
    n = partitions(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("k", F.coalesce("i", F.lit(-(1 << 63))))
    bounds = sorted({int(x) for x in docs.approxQuantile("k", [j / (4 * n) for j in range(1, 4 * n)], 0.25 / (4 * n))})
    bucket = F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<long>"), lambda b: b <= F.col("k")))
    docs = docs.withColumn("b", bucket)
    firsts = sorted((r["b"], r["m"]) for r in docs.groupBy("b").agg(F.min("k").alias("m")).collect())
    follow = [(m, firsts[(j - 1) % len(firsts)][0]) for j, (_, m) in enumerate(firsts)]
    tails = spark.createDataFrame(follow, "m long, tail int")
    both = docs.join(F.broadcast(tails), F.col("k") == F.col("m"), "left")
    rows = both.select("i", "t", "k", F.explode(F.when(F.col("tail").isNull(), F.array(F.struct("b", F.lit(0).alias("tail")))).otherwise(F.array(F.struct("b", F.lit(0).alias("tail")), F.struct(F.col("tail").alias("b"), F.lit(1).alias("tail"))))).alias("p"))
    rows = rows.select("p.b", "p.tail", "i", "t", "k").repartition(n, "b").sortWithinPartitions("b", "tail", "k", "t").select("b", "tail", "i", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: tuple | None = None
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for b, tail, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None and tail:
                    continue  # a bucket's further tail rows
                own = (b, i, t, spots(t))
                if held is not None:
                    out.append(_row(held, own))
                    size += len(out[-1][3]) + len(out[-1][4])
                held = None if tail else own
                if size > 4 << 20 or len(out) >= 1024:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    return arrow_map(rows, run, SCHEMA)


def _row(held: tuple, own: tuple) -> tuple:
    _, i, t, sig = held
    new = edited(t, own[2])
    other = spots(new)
    return (i, len(t), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), packed(sig), packed(other), likeness(sig, other), likeness(sig, own[3]), len(sig))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints every text of ``documents`` and its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))
