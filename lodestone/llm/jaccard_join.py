"""Exact n-gram Jaccard join with set-relation skipping.

Sets of word shingles are linked when their Jaccard similarity reaches a threshold. Three steps:

1. *Meeting*. Sets fall into size classes so that linked sets lie in the same or neighbouring classes. In a class, sets
   that are linked differ in at most H shingles; the shingles are dealt by hash into H + 1 + spare parts, so linked sets
   have at least 1 + spare equal parts. Sets that share an equal part are joined to one candidate group. Each map task
   first joins its own sets, so a key that many sets share crosses the shuffle once per batch. Equal sets are represented
   by one of them. Parts leave out shingles that are frequent in the corpus (by a sketch of counts over all documents),
   else a passage that many documents share would join them all. This loses nothing: without frequent shingles linked
   sets differ in no more than before. A set that has more than the spare number of empty parts goes on to a level at which only
   more frequent shingles are left out, at last none; it has keys at every level up to its own, where sets of lower
   levels find it.
2. *Join in a group*, in one task, of representatives only: an inverted index whose lists hold the sets by size. Runs of
   sets of like sizes read only the blocks of a list between the first and the last position that a partner can have.
   Overlap counts of a set are derived from those of the set before it, when the two are highly similar: the lists of
   shingles that only one of the two has are added or taken away.
3. A group above ``block_shingles`` is cut into blocks; every pair of blocks is a task of its own, so no task is larger.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK, arrow_map, fresh_path, mix64, partitions, table, written
from .components import components
from .elias_fano import map_arrays, save_arrays

SPARE = 3
SKIP = 64
#: Counters of the sketch (about ``PER_ROW`` for each row, from ``NARROW`` to ``WIDE``) and of a slice of it, and how far
#: above the mean counter frequent shingles begin at each level.
PER_ROW, NARROW, WIDE, SLICE = 16, 1 << 22, 1 << 25, 1 << 18
LEVELS = (8, 64, 512)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        self[word] = h
        return h


_HASHES = _Hashes()


def words(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str, n: int = 3) -> np.ndarray:
    """The distinct n-word shingles of a whole text as 64-bit hashes, ascending; fewer words are one shingle, none are none."""
    w = words(text)
    if len(_HASHES) > 300_000:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))
    k = min(n, len(h))
    if not k:
        return h
    z = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        z = (z ^ (z >> np.uint64(31))) * _A + h[j : len(h) - k + 1 + j] * _B
    return np.unique(mix64(z + _C))


class Threshold:
    """The similarity as a fraction num / den: all tests are exact in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def tops(self, most: int) -> np.ndarray:
        """Largest sizes of the size classes: linked sets lie in one class or in neighbours."""
        tops = [1]
        while tops[-1] < most:
            tops.append(max(tops[-1] + 1, tops[-1] * self.den // self.num))
        return np.array([*tops, max(tops[-1] + 1, tops[-1] * self.den // self.num)])

    def parts(self, top: int) -> int:
        """More parts than linked sets of at most ``top`` shingles can have differences, and spare ones."""
        return self.most_differences(top) + 1 + self.spare(top)

    def most_differences(self, top: int) -> int:
        return 2 * top * (self.den - self.num) // (self.den + self.num)

    def spare(self, top: int) -> int:
        """Empty parts that a set may have at a level: linked sets then still have an equal part that isn't empty."""
        return SPARE + self.most_differences(top) // 8

    def linked(self, both: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (a + b - both)


@dataclass
class Sketch:
    """Counts of all shingles of the corpus by hash, in files that all tasks map into memory; ``limits`` of the levels."""

    files: list[str]
    width: int
    limits: list[float]
    slices: list | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "slices": None}

    def counts(self, s: np.ndarray) -> np.ndarray:
        if self.slices is None:
            self.slices = [map_arrays(f)["n"] for f in self.files]
        at = (s & np.uint64(self.width - 1)).astype(np.int64)
        out = np.zeros(len(s), np.int64)
        which = at // SLICE
        order = np.argsort(which, kind="stable")
        cut = np.searchsorted(which[order], np.arange(len(self.files) + 1))
        for j in np.flatnonzero(np.diff(cut)).tolist():
            own = order[cut[j] : cut[j + 1]]
            out[own] = self.slices[j][at[own] - j * SLICE]
        return out


def build_sketch(docs: DataFrame, make: Callable[[str], np.ndarray]) -> Sketch:
    """Counts the set elements of all documents (columns i, t); the sketch's width grows with the number of rows up to ``WIDE``."""
    path = fresh_path(docs.sparkSession, "sketch")
    width = min(WIDE, max(NARROW, 1 << (PER_ROW * docs.count() - 1).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total, held, many = np.zeros(width, np.uint32), [], 0

        def add_held() -> None:
            np.add.at(total, (np.concatenate(held) & np.uint64(width - 1)).astype(np.int64), np.uint32(1))

        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(make(t))
                many += len(held[-1])
                if many > 1_000_000:
                    add_held()
                    held, many = [], 0
        if held:
            add_held()
        z = zstandard.ZstdCompressor(level=1)
        for j in range(width // SLICE):
            part = np.ascontiguousarray(total[j * SLICE : (j + 1) * SLICE].view(np.uint8).reshape(-1, 4).T)
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([z.compress(part.tobytes())], pa.binary())], ["slice", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for j, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = np.frombuffer(z.decompress(raw), np.uint8).reshape(4, -1).T.copy().view(np.uint32).reshape(-1)
                sums[j] = sums[j] + part if j in sums else part.astype(np.uint64)
        for j, v in sums.items():
            name = f"{path}/slice-{j}-{np.random.default_rng().integers(1 << 62):x}"
            save_arrays(name, {"n": np.minimum(v, (1 << 32) - 1).astype(np.uint32)})
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([name]), pa.array([int(v.sum())], pa.int64())], ["slice", "uri", "total"])

    rows = written(arrow_map(arrow_map(docs.select("t"), count, "slice int, n binary").repartition(width // SLICE, "slice"), add, "slice int, uri string, total long"), "sketch").collect()
    mean = sum(r["total"] for r in rows) / width
    return Sketch([r["uri"] for r in sorted(rows, key=lambda r: r["slice"])], width, [mean + 4 * mean**0.5 + x for x in LEVELS])


def meeting_keys(s: np.ndarray, t: Threshold, tops: np.ndarray, counts: np.ndarray, limits: list[float]) -> np.ndarray:
    """The keys of a set: non-empty parts of its own and the next size class, level by level, until few parts are empty."""
    k = int(np.searchsorted(tops, len(s)))
    spread = mix64(s ^ _C) >> np.uint64(32)
    low, high = (s & np.uint64(0xFFFFFFFF)).astype(np.float64), (s >> np.uint64(32)).astype(np.float64)
    masks = [counts <= x for x in limits]
    out = []
    for c in (k, k + 1):
        m = t.parts(int(tops[c]))
        part = (spread * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        for level in range(len(limits) + 1):
            last = level == len(limits)
            p, a, b = (part, low, high) if last else (part[masks[level]], low[masks[level]], high[masks[level]])
            full = np.bincount(p, minlength=m) > 0
            few = m - full.sum() <= t.spare(int(tops[c]))
            total = np.bincount(p, a, m).astype(np.uint64) + (np.bincount(p, b, m).astype(np.uint64) << np.uint64(32))
            key = mix64(total * _A + np.arange(m, dtype=np.uint64) * _B + np.uint64((int(tops[c]) * 8 + level) * int(_C) & MASK))
            out.append(key if last and not few else key[full])
            if few:
                break
    return np.unique(np.concatenate(out))


def join_group(sets: list[np.ndarray], weight: np.ndarray, t: Threshold, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each set of a group: a root (index) that linked sets share, and the weight of the sets linked with it.

    With ``side`` (0 or 1 for each set) only pairs of different sides count. Equal sets are linked as any others.
    """
    n = len(sets)
    root, links = np.arange(n), np.zeros(n, np.int64)
    size = np.array([len(s) for s in sets])
    order = np.lexsort(([int(s[0]) if len(s) else 0 for s in sets], size))
    size = size[order]
    flat = np.concatenate([sets[k] for k in order])
    owner = np.repeat(np.arange(n), size)
    token, dense = np.unique(flat, return_inverse=True)
    by = np.argsort(dense, kind="stable")
    lists = owner[by]
    ends = np.cumsum(np.bincount(dense, minlength=len(token)))
    begins = np.concatenate([[0], ends[:-1]])
    heads = lists[::SKIP]  # skip table over the concatenated lists
    start = np.concatenate([[0], np.cumsum(size)])
    own = [dense[start[k] : start[k + 1]] for k in range(n)]
    side_o = None if side is None else side[order]
    w = weight[order]

    def gather(tokens: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """The members of the tokens' lists from rank ``lo`` to below ``hi``."""
        out = []
        for a, b in zip(begins[tokens].tolist(), ends[tokens].tolist(), strict=True):
            if b - a > 2 * SKIP:  # jump over whole blocks by their first members
                i, j = a // SKIP + 1, (b - 1) // SKIP + 1
                first = i + int(np.searchsorted(heads[i:j], lo))
                last = i + int(np.searchsorted(heads[i:j], hi))
                a, b = max(a, (first - 1) * SKIP), min(b, last * SKIP)
            out.append(lists[a:b])
        if not out:
            return np.zeros(0, np.int64)
        got = np.concatenate(out)
        return got[(got >= lo) & (got < hi)]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    k = 0
    while k < n:
        stop = int(np.searchsorted(size, size[k] * t.den // t.num, "right"))  # a run: like sizes, one window of positions
        lo = int(np.searchsorted(size, -(-size[k] * t.num // t.den)))
        hi = int(np.searchsorted(size, size[stop - 1] * t.den // t.num, "right"))
        counts, before = None, None
        for x in range(k, stop):
            if counts is not None:
                plus, minus = np.setdiff1d(own[x], own[before], assume_unique=True), np.setdiff1d(own[before], own[x], assume_unique=True)
                if len(plus) + len(minus) >= len(own[x]):
                    counts = None
            if counts is None:
                counts = np.bincount(gather(own[x], lo, hi) - lo, minlength=hi - lo)
            else:
                counts = counts + np.bincount(gather(plus, lo, hi) - lo, minlength=hi - lo) - np.bincount(gather(minus, lo, hi) - lo, minlength=hi - lo)
            before = x
            ok = t.linked(counts, int(size[x]), size[lo:hi]) & (counts > 0)
            ok[x - lo] = False
            if side_o is not None:
                ok &= side_o[lo:hi] != side_o[x]
            with_x = np.flatnonzero(ok) + lo
            links[x] = w[with_x].sum()
            r = find(x)
            for y in with_x.tolist():
                q = find(y)
                if q != r:
                    root[q] = r
        k = stop
    out_root, out_links = np.empty(n, np.int64), np.empty(n, np.int64)
    for x in range(n):
        out_root[order[x]] = order[find(x)]
        out_links[order[x]] = links[x]
    return out_root, out_links


def _planes(a: np.ndarray) -> bytes:
    """64-bit numbers as byte planes, whose empty ones compress to nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes()


def _pairs_of(bucket: np.ndarray, rows: list[np.ndarray], n: int, planes: int) -> Iterator[pa.RecordBatch]:
    """Packs arrays of equal length by bucket into one row per bucket; from column ``planes`` on in byte planes."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n + 1))
    cols = [r[order] for r in rows]
    live = [j for j in range(n) if cut[j + 1] > cut[j]]
    for a in range(0, len(live), 64):
        part = live[a : a + 64]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array([_planes(c[cut[j] : cut[j + 1]]) if k >= planes else c[cut[j] : cut[j + 1]].tobytes() for j in part], pa.binary()) for k, c in enumerate(cols)), pa.array([b""] * len(part), pa.binary())], ["bucket", "keys", "ids", "facts"])


FACT = np.dtype([("id", "<i8"), ("n", "<i8"), ("s1", "<i8"), ("s2", "<i8"), ("h", "<i8")])


def _meet(docs: DataFrame, make: Callable[[str], np.ndarray], t: Threshold, buckets: int, sketch: Sketch, flush: int = 600_000) -> DataFrame:
    """Rows kind 1: edges (a, b) of the candidate graph; kind 2: facts of each row (a id, b set size, s1, s2 the set's signature, h the text's hash)."""

    held_sketch = docs.sparkSession.sparkContext.broadcast(sketch)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        tops = t.tops(1000)
        sk = held_sketch.value
        keys, ids, facts, held = [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            key, i = np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(ids) if ids else np.zeros(0, np.int64)
            order = np.lexsort((i, key))
            key, i = key[order], i[order]
            first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
            head = i[first][np.cumsum(first) - 1] if len(key) else i
            edge = np.unique(np.stack([i, head], 1)[~first & (i != head)], axis=0)
            yield from _pairs_of((key[first] % np.uint64(buckets)).astype(np.int64), [key[first], i[first]], buckets, planes=1)
            raw = np.array(facts, FACT)
            yield pa.RecordBatch.from_arrays([pa.array([len(raw) * 7919 % buckets], pa.int32()), pa.array([edge.astype("<i8").tobytes()], pa.binary()), pa.array([None], pa.binary()), pa.array([raw.tobytes()], pa.binary())], ["bucket", "keys", "ids", "facts"])

        for b in batches:
            for i, text, h in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                s = make(text)
                raw = s.tobytes()
                sig = xxhash.xxh3_128_intdigest(raw) if len(s) else 0
                facts.append((i, len(s), np.uint64(sig >> 64).astype(np.int64), np.uint64(sig & (1 << 64) - 1).astype(np.int64), h))
                if len(s):
                    if len(s) > tops[-3]:
                        tops = t.tops(2 * len(s))
                    k = meeting_keys(s, t, tops, sk.counts(s), sk.limits)
                    keys.append(k)
                    ids.append(np.full(len(k), i, np.int64))
                    held += len(k)
                if held > flush:
                    yield from out()
                    keys, ids, facts, held = [], [], [], 0
        if facts:
            yield from out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows: dict[int, tuple[list, list]] = {}
        for b in batches:
            for bucket, key, i, fact in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i is None:
                    e = np.frombuffer(key, "<i8").reshape(-1, 2)
                    yield _edges(e[:, 0], e[:, 1])
                    f = np.frombuffer(fact, FACT)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), 2, np.int32)), *(pa.array(f[c]) for c in ("id", "n", "s1", "s2", "h"))], ["kind", "a", "b", "s1", "s2", "h"])
                else:
                    k, v = rows.setdefault(bucket, ([], []))
                    k.append(np.frombuffer(key, np.uint64))
                    v.append(np.frombuffer(i, np.uint8).reshape(8, -1).T.copy().view(np.int64).reshape(-1))
        for bucket in list(rows):
            k, v = rows.pop(bucket)
            key, i = np.concatenate(k), np.concatenate(v)
            order = np.lexsort((i, key))
            key, i = key[order], i[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            head = i[first][np.cumsum(first) - 1]
            e = np.unique(np.stack([i, head], 1)[~first & (i != head)], axis=0)
            yield _edges(e[:, 0], e[:, 1])

    sent = arrow_map(docs, send, "bucket int, keys binary, ids binary, facts binary")
    return arrow_map(sent.repartition(partitions(docs.sparkSession), "bucket"), meet, "kind int, a long, b long, s1 long, s2 long, h long")


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    zero = pa.array(np.zeros(len(a), np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.ones(len(a), np.int32)), pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b)), zero, zero, zero], ["kind", "a", "b", "s1", "s2", "h"])


def jaccard_components(documents: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = 4_000_000, make: Callable[[str], np.ndarray] | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links), n_links, representative (of equal sets).

    Null and empty texts have no shingles and no links. Rows of one id are one vertex, each row is returned with the links
    of its own text; links count rows, those of equal sets included. A null id is returned with a null component. ``make``
    gives a text's set (ascending distinct 64-bit numbers) where it isn't word shingles. Every distinct set goes into its
    group's join once, however many rows have it.
    """
    make = make or functools.partial(shingles, n=n)
    t = Threshold(num, den)
    docs = documents.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    live = docs.where("i is not null").withColumn("h", F.xxhash64("t"))
    met = written(_meet(live, make, t, 4 * partitions(documents.sparkSession), build_sketch(live, make)), "met")
    facts = met.where("kind = 2").select(F.col("a").alias("id"), F.col("b").alias("n"), "s1", "s2", "h")
    full = facts.where("n > 0")
    equal = written(full.groupBy("s1", "s2").agg(F.min(F.struct("id", "h")).alias("r"), F.count("*").alias("copies"), F.max("n").alias("n")).select("s1", "s2", F.col("r.id").alias("rep"), F.col("r.h").alias("h"), "copies", "n"), "equal")
    repeated = written(full.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "repeated")
    some_repeated = not repeated.isEmpty()
    groups = components(met.where("kind = 1").select("a", "b"))
    # representatives of groups in which two different sets meet, with their blocks
    mine = groups.join(equal, F.col("id") == F.col("rep")).select("rep", "h", "s1", "s2", "copies", "n", "label")
    sizes = mine.groupBy("label").agg(F.count("*").alias("many"), F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks")).where("many > 1")
    cand = mine.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("s1", "s2"), F.col("blocks")).cast("int"))
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y"))))
    # one row of each representative's text
    once = live.withColumnRenamed("h", "th")
    if some_repeated:
        once = once.dropDuplicates(["i", "th"])
    texts = cand.select("rep", "h", "s1", "s2", "copies", "label", "own", pairs.alias("p")).join(once, (F.col("rep") == F.col("i")) & (F.col("h") == F.col("th"))).select("label", "rep", "s1", "s2", "copies", "own", "t", F.explode("p").alias("p"))
    tasks = texts.select("label", "p.x", "p.y", "rep", "s1", "s2", "copies", "own", "t").repartition(partitions(documents.sparkSession), "label", "x", "y").sortWithinPartitions("label", "x", "y", "rep")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            ids, s1, s2, w = (np.array([h[k] for h in held], np.int64) for k in range(4))
            side = np.array([h[4] for h in held]) if at[1] != at[2] else None
            root, links = join_group([h[5] for h in held], w, t, side)
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, root, ids)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, least[root], s1, s2, links)], ["a", "b", "s1", "s2", "links"])

        for b in batches:
            for label, x, y, *row, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != (label, x, y):
                    if len(held) > 1:
                        yield out()
                    at, held = (label, x, y), []
                held.append((*row, make(text)))
        if len(held) > 1:
            yield out()

    joined = written(arrow_map(tasks, join, "a long, b long, s1 long, s2 long, links long"), "joined")
    edges = joined.select("a", "b")
    if some_repeated:  # an id with several sets is linked with the representatives of all of them
        edges = edges.union(full.join(repeated, "id", "left_semi").join(equal.select("s1", "s2", "rep"), ["s1", "s2"]).select("id", "rep"))
    label = components(edges).withColumnRenamed("id", "v")
    sets = equal.select("s1", "s2", "rep", "copies").join(joined.groupBy("s1", "s2").agg(F.sum("links").alias("links")), ["s1", "s2"], "left").join(label, F.col("rep") == F.col("v"), "left")
    rows = facts.join(sets, ["s1", "s2"], "left")
    found = rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("label", "rep", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("rep", "id").alias("representative"))
    lost = docs.where("i is null").select(F.col("i").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.col("i").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.col("i").alias("representative"))
    return found.union(lost)


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Joins all ``documents`` on distinct 3-word shingles at a similarity of 0.9."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document, that of the smallest id, of each group of near-duplicates (five words, 0.8) stays; rows without id stay.

    Of several rows of a staying id one stays: that of the smallest hash of all its columns.
    """
    found = written(jaccard_components(docs, n=5, num=80).select("doc_id", "component_id"), "classes")
    stay = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_stay")).agg(F.count("*").alias("_rows"))
    lost = docs.where("doc_id is null")
    several = stay.where("_rows > 1")
    if several.isEmpty():
        return docs.join(stay, docs["doc_id"] == stay["_stay"], "left_semi").union(lost)
    once = stay.where("_rows = 1")
    first = docs.join(several, docs["doc_id"] == several["_stay"], "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return docs.join(once, docs["doc_id"] == once["_stay"], "left_semi").union(first).union(lost)
