"""Language-model scoring by an Elias-Fano trie of n-grams (order 3).

Words are known by 64-bit hashes. Level 1, the vocabulary, is a set of files with Elias-Fano hashes and counts that all
tasks map into memory. The n-gram levels are cut into shards by the word before the predicted one (the context); each
shard is one file, mapped by the task that answers the shard's queries:

* contexts, and monotone pointers to their successors: Elias-Fano;
* successors of each context: Elias-Fano of context * vocabulary + word, with a quantised log probability each;
* nodes (context, word before it), with a quantised back-off weight, and monotone pointers to their children;
* children of a node: Elias-Fano of the *position of the word among the context's successors*, a number as small as the
  context has few successors, with a quantised log probability each.

A query looks up the word among the context's successors, the node, then that position among the node's children, each by
successor search in the compressed level (two selects and a binary search on low bits). Probabilities are interpolated by
Witten and Bell: p(w | h) = (c + d p(w | shorter h)) / (T + d), with T the tokens and d the distinct words seen after h.
The unigram level is the smoothed base distribution itself.

A context so frequent that it would outgrow a shard is divided into classes by a hash of the word before it; the starts of
documents, which have none, by a hash of their first word. Its bigrams are counted over all classes in a pass of their own
and kept in mapped files as the vocabulary is: estimates, and so scores, don't depend on the number of shards. What isn't
divided is one frequent pair of words: all tokens that follow it lie in one shard.

One shuffle carries each token once, as (word before, context, word, document) in packed columns; one more carries sums
per document and shard, and one the pre-aggregated bigrams of frequent contexts.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh_path, mix64, partitions, py_id_crc, table, written
from .elias_fano import EliasFano, map_arrays, save_arrays

END, BOS, UNKNOWN, FIRST = 0, 1, 2, 3
TOP = 65_000
QUANT = 65535.0 / 24.0
FLUSH = 1_500_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        self[word] = h
        return h


_HASHES = _Hashes()


def hashed(text: str) -> np.ndarray:
    """Hashes of the words of a text: A-Z lower-cased, cut at ASCII white space."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if len(_HASHES) > 300_000:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the hashes, ascending as they are."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(counts[order], first) if len(k) else counts


@dataclass
class Vocabulary:
    """Level 1. ``files``: (uri, first position) of each bucket; totals of the training tokens; the ids of frequent words."""

    files: list[tuple[str, int] | None]
    words: int
    train_docs: int
    tokens: int
    all_tokens: int
    top_at: np.ndarray
    top_count: np.ndarray
    maps: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "maps": {}}

    @property
    def wide(self) -> int:
        """More than any word's id."""
        return FIRST + len(self.top_at) + self.words

    def hashes_of(self, top: list[int]) -> np.ndarray:
        """Hashes of frequent words, given by their places among them."""
        pos, out = np.empty(len(self.top_at), np.int64), []
        pos[self.top_at[:, 1]] = self.top_at[:, 0]
        live = [j for j, f in enumerate(self.files) if f is not None]
        starts = [self.files[j][1] for j in live]
        for p in pos[top].tolist():
            m = self._map(live[bisect.bisect_right(starts, p) - 1])
            out.append(m[0].access(np.array([p - m[2]]))[0])
        return np.array(out, np.uint64)

    @property
    def distinct(self) -> int:
        return self.words + (self.train_docs > 0)

    def _map(self, j: int) -> tuple[EliasFano, np.ndarray, int] | None:
        if j not in self.maps:
            f = self.files[j]
            if f is not None:
                a = map_arrays(f[0])
                self.maps[j] = EliasFano.of([a["n"], a["low"], a["high"]]), a["count"], f[1]
            else:
                self.maps[j] = None
        return self.maps[j]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and training counts of ascending distinct hashes; unknown words have the id UNKNOWN and count 0."""
        ids, counts = np.full(len(h), UNKNOWN, np.int64), np.zeros(len(h), np.int64)
        b = _bucket(h, len(self.files))
        for j in np.unique(b).tolist():
            m = self._map(j)
            if m is None:
                continue
            a, z = np.searchsorted(b, j), np.searchsorted(b, j, "right")
            at = m[0].find(h[a:z])
            hit = np.flatnonzero(at >= 0)
            pos = at[hit] + m[2]
            counts[a + hit] = m[1][at[hit]]
            t = np.minimum(np.searchsorted(self.top_at[:, 0], pos), max(0, len(self.top_at) - 1))
            top = self.top_at[t, 0] == pos if len(self.top_at) else np.zeros(len(pos), bool)
            ids[a + hit] = np.where(top, FIRST + self.top_at[t, 1] if len(self.top_at) else 0, FIRST + len(self.top_at) + pos)
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of ascending ids."""
        out = np.zeros(len(ids), np.int64)
        out[ids == END] = self.train_docs
        top = (ids >= FIRST) & (ids < FIRST + len(self.top_at))
        out[top] = self.top_count[ids[top] - FIRST]
        rest = np.flatnonzero(ids >= FIRST + len(self.top_at))
        if len(rest):
            pos = ids[rest] - FIRST - len(self.top_at)
            live = [j for j, f in enumerate(self.files) if f is not None]
            starts = [self.files[j][1] for j in live]
            a = 0
            while a < len(pos):
                k = bisect.bisect_right(starts, int(pos[a])) - 1
                z = int(np.searchsorted(pos, starts[k + 1])) if k + 1 < len(starts) else len(pos)
                m = self._map(live[k])
                out[rest[a:z]] = m[1][pos[a:z] - starts[k]]
                a = z
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the smoothed unigram probability."""
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def build_vocabulary(docs: DataFrame, path: str, held_out_mod: int, top: int = TOP) -> Vocabulary:
    """Counts the words of the training texts (columns i, t) over all rows and writes level 1."""
    spark = docs.sparkSession
    buckets = partitions(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        keys, sums, size, train, every = [], [], 0, 0, 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            k, c = _summed(np.concatenate(keys), np.concatenate(sums)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            cut = np.searchsorted(_bucket(k, buckets), np.arange(buckets + 1))
            live = [j for j in range(buckets) if cut[j + 1] > cut[j]]
            yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([k[cut[j] : cut[j + 1]].tobytes() for j in live], pa.binary()), pa.array([c[cut[j] : cut[j + 1]].astype("<i8").tobytes() for j in live], pa.binary()), *(pa.array([0] * len(live), pa.int64()) for _ in range(2))], ["bucket", "h", "c", "train", "every"])
            if last:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([train], pa.int64()), pa.array([every], pa.int64())], ["bucket", "h", "c", "train", "every"])

        held: list[np.ndarray] = []
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = hashed(t)
                every += len(h) + 1
                if py_id_crc(i) % held_out_mod:
                    train += 1
                    held.append(h)
                    size += len(h)
                    if size > 1_000_000:
                        k, c = np.unique(np.concatenate(held), return_counts=True)
                        keys.append(k)
                        sums.append(c)
                        held, size = [], 0
                        if sum(map(len, keys)) > 4_000_000:
                            yield from out(False)
                            keys, sums = [], []
        if held:
            k, c = np.unique(np.concatenate(held), return_counts=True)
            keys.append(k)
            sums.append(c)
        yield from out(True)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        at, keys, sums, train, every = -1, [], [], 0, 0

        def out() -> pa.RecordBatch:
            k, c = _summed(np.concatenate(keys), np.concatenate(sums)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            name = f"{path}/words-{at:06d}-{np.random.default_rng().integers(1 << 62):x}"
            e = EliasFano.build(k).arrays()
            save_arrays(name, {"n": e[0], "low": e[1], "high": e[2], "count": c.astype(np.int32 if not len(c) or c.max() < 1 << 31 else np.int64)})
            best = np.sort(np.argsort(-c, kind="stable")[:top])
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([name]), pa.array([len(k)], pa.int64()), pa.array([int(c.sum())], pa.int64()), pa.array([train], pa.int64()), pa.array([every], pa.int64()), pa.array([best.tolist()], pa.list_(pa.int64())), pa.array([c[best].tolist()], pa.list_(pa.int64()))], ["bucket", "uri", "n", "tokens", "train", "every", "best", "counts"])

        for b in batches:
            for bucket, h, c, tr, ev in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if bucket != at:
                    if at >= 0:
                        yield out()
                    at, keys, sums, train, every = bucket, [], [], 0, 0
                keys.append(np.frombuffer(h, np.uint64))
                sums.append(np.frombuffer(c, np.int64))
                train, every = train + tr, every + ev
        if at >= 0:
            yield out()

    sent = arrow_map(docs, count, "bucket int, h binary, c binary, train long, every long")
    levels = written(arrow_map(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket"), level, "bucket int, uri string, n long, tokens long, train long, every long, best array<long>, counts array<long>"), "levels")
    files: list[tuple[str, int] | None] = [None] * buckets
    first = {}
    words = tokens = train = every = 0
    for r in sorted(levels.drop("best", "counts").collect(), key=lambda r: r["bucket"]):
        files[r["bucket"]] = (r["uri"], words)
        first[r["bucket"]] = words
        words, tokens, train, every = words + r["n"], tokens + r["tokens"], train + r["train"], every + r["every"]
    # the frequent words: a histogram of counts tells where the first ``top`` end, so that no task sends more than it has of them
    counted = levels.select("bucket", F.explode(F.arrays_zip("best", "counts")).alias("p")).select("bucket", F.col("p.best").alias("at"), F.col("p.counts").alias("c")).withColumn("step", F.floor(F.log2("c") * 16))
    least, have = 0, 0
    for r in sorted(counted.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        least, have = r["step"], have + r["count"]
        if have >= top:
            break
    ranked = counted.where(F.col("step") >= least).orderBy(F.desc("c"), "bucket", "at").limit(top).collect()
    pos = np.array([(first[r["bucket"]] + r["at"], k) for k, r in enumerate(ranked)], np.int64).reshape(-1, 2)
    return Vocabulary(files, words, train, tokens + train, every, pos[np.argsort(pos[:, 0])], np.array([r["c"] for r in ranked], np.int64))


def _planes(a: np.ndarray) -> bytes:
    """Numbers that aren't negative as byte planes, compressed: as many planes as the largest one needs, told by the first byte."""
    width = max(1, -(-int(a.max(initial=0)).bit_length() // 8))
    own = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(own.tobytes())


def _numbers(raw: bytes) -> np.ndarray:
    own = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((own.shape[1], 8), np.uint8)
    out[:, : raw[0]] = own.T
    return out.view("<u8").reshape(-1).astype(np.int64)


@dataclass
class Routes:
    """Where contexts live: frequent ones (``hot``, ascending) have several classes, each with a virtual id above all words."""

    shards: int
    base: int
    hot: np.ndarray
    classes: np.ndarray

    @classmethod
    def of(cls, v: Vocabulary, shard_tokens: int) -> Routes:
        shards = max(1, -(-v.all_tokens // shard_tokens))
        frequent = [(BOS, v.train_docs)] + [(FIRST + k, int(c)) for k, c in enumerate(v.top_count.tolist())]
        hot = [(w, n) for w, c in frequent if (n := -(-2 * c * shards // max(1, v.tokens))) > 1]
        return cls(shards, v.wide, np.array([w for w, _ in hot], np.int64), np.array([n for _, n in hot], np.int64))

    def contexts(self, before: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context ids and shards. Before a document's first word there is no other: its starts are dealt by that word."""
        out = context.copy()
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            hit = np.flatnonzero(self.hot[at] == context)
            first = np.cumsum(self.classes) - self.classes
            out[hit] = self.base + first[at[hit]] + (mix64(np.where(context[hit] == BOS, word[hit], before[hit]) + 77) % self.classes[at[hit]].astype(np.uint64)).astype(np.int64)
        return out, (mix64(out) % np.uint64(self.shards)).astype(np.int64)

    def hot_of(self, context: np.ndarray) -> np.ndarray:
        """Of context ids the place among the frequent ones, -1 for others."""
        return np.where(context >= self.base, np.searchsorted(np.cumsum(self.classes), context - self.base, "right"), -1)


@dataclass
class HotBigrams:
    """Training counts of all bigrams of frequent contexts, in mapped files by a hash of the word; tokens and distinct words of each context."""

    wide: int
    files: list[str | None]
    tokens: np.ndarray
    distinct: np.ndarray
    maps: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "maps": {}}

    def counts(self, hot: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(word), np.int64)
        bucket = (mix64(word) % np.uint64(len(self.files))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(len(self.files) + 1))
        for j in np.flatnonzero(np.diff(cut)).tolist():
            if self.files[j] is None:
                continue
            if j not in self.maps:
                a = map_arrays(self.files[j])
                self.maps[j] = EliasFano.of([a["n"], a["low"], a["high"]]), a["count"]
            own = order[cut[j] : cut[j + 1]]
            at = self.maps[j][0].find(hot[own] * self.wide + word[own])
            out[own] = np.where(at >= 0, self.maps[j][1][np.maximum(at, 0)], 0)
        return out


def build_hot(docs: DataFrame, path: str, v: Vocabulary, routes: Routes, held_out_mod: int) -> HotBigrams:
    """Counts the bigrams of frequent contexts over all training texts (columns i, t), summed in each task before the shuffle."""
    spark, hot = docs.sparkSession, routes.hot
    counts = [v.train_docs if w == BOS else int(v.top_count[w - FIRST]) for w in hot.tolist()]
    if not len(hot):
        return HotBigrams(v.wide, [None], np.zeros(0, np.int64), np.zeros(0, np.int64))
    own = [k for k, w in enumerate(hot.tolist()) if w != BOS]
    h = v.hashes_of([int(hot[k]) - FIRST for k in own])
    order = np.argsort(h)
    names, place = h[order], np.array(own, np.int64)[order]
    first = hot.tolist().index(BOS) if BOS in hot else -1
    buckets = partitions(spark)
    held = spark.sparkContext.broadcast(v)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        v = held.value
        ctx, nxt, ends, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            c, n, end = np.concatenate(ctx), np.concatenate(nxt), np.concatenate(ends)
            u, inv = np.unique(n, return_inverse=True)
            word = v.look_up(u)[0][inv]
            word[end] = END
            key, many = np.unique(c * v.wide + word, return_counts=True)
            bucket = (mix64(key % v.wide) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            live = np.flatnonzero(np.diff(cut)).tolist()
            z = zstandard.ZstdCompressor(level=1)
            cols = [[z.compress(np.diff(x[order[cut[j] : cut[j + 1]]], prepend=0).astype("<i8").tobytes()) for j in live] for x in (key, many)]
            return pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["bucket", "key", "n"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not py_id_crc(i) % held_out_mod:
                    continue
                w = hashed(t)
                at = np.searchsorted(names, w)
                at[at == len(names)] = 0
                hit = np.flatnonzero(names[at] == w) if len(names) else at[:0]
                more = np.append(w[1:], np.uint64(0)) if len(w) else w
                ctx.append(place[at[hit]])
                nxt.append(more[hit])
                ends.append(hit == len(w) - 1)
                if first >= 0:
                    ctx.append(np.array([first]))
                    nxt.append(w[:1] if len(w) else np.zeros(1, np.uint64))
                    ends.append(np.array([not len(w)]))
                size += len(hit) + 1
                if size > FLUSH:
                    yield out()
                    ctx, nxt, ends, size = [], [], [], 0
        if size:
            yield out()

    def level(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        at, keys, sums = -1, [], []

        def out() -> pa.RecordBatch:
            k, c = _summed(np.concatenate(keys), np.concatenate(sums))
            name = f"{path}/bigrams-{at:06d}-{np.random.default_rng().integers(1 << 62):x}"
            e = EliasFano.build(k).arrays()
            save_arrays(name, {"n": e[0], "low": e[1], "high": e[2], "count": c.astype(np.int32 if c.max() < 1 << 31 else np.int64)})
            distinct = np.bincount(k // v_wide, minlength=n_hot)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([name]), pa.array([np.arange(n_hot).tolist()], pa.list_(pa.int64())), pa.array([distinct.tolist()], pa.list_(pa.int64()))], ["bucket", "uri", "hot", "n"])

        z = zstandard.ZstdDecompressor()
        for b in batches:
            for bucket, k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if bucket != at:
                    if at >= 0:
                        yield out()
                    at, keys, sums = bucket, [], []
                keys.append(np.cumsum(np.frombuffer(z.decompress(k), "<i8")))
                sums.append(np.cumsum(np.frombuffer(z.decompress(c), "<i8")))
        if at >= 0:
            yield out()

    v_wide, n_hot = v.wide, len(hot)
    sent = arrow_map(docs, count, "bucket int, key binary, n binary")
    levels = written(arrow_map(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket"), level, "bucket int, uri string, hot array<long>, n array<long>"), "bigrams")
    files: list[str | None] = [None] * buckets
    for r in levels.select("bucket", "uri").collect():
        files[r["bucket"]] = r["uri"]
    distinct = np.zeros(n_hot, np.int64)
    for r in levels.select(F.explode(F.arrays_zip("hot", "n")).alias("p")).groupBy("p.hot").agg(F.sum("p.n").alias("n")).collect():
        distinct[r["hot"]] = r["n"]
    return HotBigrams(v.wide, files, np.array(counts, np.int64), distinct)


def _quantised(log10p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10p * QUANT), 0, 65535).astype(np.uint16)


class Trie:
    """One shard's mapped levels."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.a = arrays
        self.words = int(arrays["words"][0])
        for k in ("contexts", "successor_at", "successors", "nodes", "child_at", "children"):
            setattr(self, k, EliasFano.of([arrays[f"{k}.n"], arrays[f"{k}.low"], arrays[f"{k}.high"]]))

    @staticmethod
    def build(before: np.ndarray, context: np.ndarray, word: np.ndarray, count: np.ndarray, p1: np.ndarray, words: int, routes: Routes | None = None, hot: HotBigrams | None = None) -> dict[str, np.ndarray]:
        """Levels from distinct trigrams (ascending by context, before, word), their training counts (0: asked for only) and their words' unigram probabilities."""
        ctx, ci = np.unique(context, return_inverse=True)
        starts = ctx[:0]
        bk, bi = np.unique(ci * words + word, return_inverse=True)
        low = np.zeros(len(bk))
        low[bi] = p1
        b_ctx, b_word = bk // words, bk % words
        c2 = np.bincount(bi, count, len(bk)).astype(np.int64)
        t2, d2 = np.bincount(b_ctx, c2, len(ctx)).astype(np.int64), np.bincount(b_ctx, c2 > 0, len(ctx)).astype(np.int64)
        if routes is not None and len(routes.hot):
            which = routes.hot_of(ctx)
            t2, d2 = (np.where(which >= 0, x[np.maximum(which, 0)], y) for x, y in ((hot.tokens, t2), (hot.distinct, d2)))
            own = np.flatnonzero(which[b_ctx] >= 0)
            c2[own] = hot.counts(which[b_ctx[own]], b_word[own])
            first = routes.hot.tolist().index(BOS) if BOS in routes.hot else -2
            starts = np.flatnonzero(which == first)  # a class of document starts: its node has the tokens and words of all
        all2 = np.maximum(t2 + d2, 1)
        p2 = (c2 + d2[b_ctx] * low) / all2[b_ctx]
        seen = c2 > 0  # successors of the context; of a frequent one those that this shard is asked for
        at = np.cumsum(seen) - 1
        begin = np.searchsorted(b_ctx[seen], np.arange(len(ctx) + 1))
        live = np.flatnonzero(count > 0)
        del bk, low
        own = ci[live] * words + before[live]
        nk = np.unique(np.concatenate([own, starts * words + BOS]))
        ni = np.searchsorted(nk, own)
        kids = np.bincount(ni, minlength=len(nk))
        t3, d3 = np.bincount(ni, count[live], len(nk)), kids.copy()
        if len(starts):
            at_start = np.searchsorted(nk, starts * words + BOS)
            t3[at_start], d3[at_start] = hot.tokens[first], hot.distinct[first]
        p3 = (count[live] + d3[ni] * p2[bi[live]]) / (t3 + d3)[ni] if len(live) else np.zeros(0)
        wide = int(np.diff(begin).max(initial=0)) + 1
        child = ni * wide + at[bi[live]] - begin[ci[live]]
        order = np.argsort(child, kind="stable")
        del bi, ci, at, ni
        known = np.flatnonzero(t2 > 0)  # all that is left out comes from contexts never seen in training
        out = {"words": np.array([words, wide], np.int64), "p2": _quantised(np.log10(p2[seen])), "back2": _quantised(np.log10(d2[known] / all2[known])), "p3": _quantised(np.log10(p3[order])), "back3": _quantised(np.log10(d3 / (t3 + d3)))}
        new = np.zeros(len(ctx), np.int64)
        new[known] = np.arange(len(known))
        levels = {
            "contexts": lambda: ctx[known], "successor_at": lambda: np.append(begin[known], begin[-1]), "successors": lambda: new[b_ctx[seen]] * words + b_word[seen],
            "nodes": lambda: new[nk // words] * words + nk % words, "child_at": lambda: np.append(0, np.cumsum(kids)), "children": lambda: child[order],
        }
        for k, values in levels.items():
            e = EliasFano.build(values()).arrays()
            out |= {f"{k}.n": e[0], f"{k}.low": e[1], f"{k}.high": e[2]}
        return out

    def score(self, before: np.ndarray, context: np.ndarray, word: np.ndarray, log1: np.ndarray) -> np.ndarray:
        """log10 probabilities of words (unigram ones given) after two words; runs of one context, and of one word before it, are looked up once."""
        out = log1.astype(np.float64).copy()
        run, of = _runs(context)
        r = self.contexts.find(context[run])
        start = self.successor_at.access(np.maximum(r, 0)).astype(np.int64) if self.successor_at.n else r
        r, start = r[of], start[of]
        has = np.flatnonzero(r >= 0)
        if not len(has):
            return out
        r, start = r[has], start[has]
        pos = self.successors.find(r * self.words + word[has])
        seen = pos >= 0
        out[has] = np.where(seen, -(self.a["p2"][np.maximum(pos, 0)] / QUANT) if self.successors.n else 0.0, out[has] - self.a["back2"][r] / QUANT)
        key = r * self.words + before[has]
        run, of = _runs(key)
        node = self.nodes.find(key[run])[of]
        on = np.flatnonzero(node >= 0)
        if not len(on):
            return out
        child = np.full(len(on), -1, np.int64)
        known = seen[on]
        child[known] = self.children.find(node[on][known] * int(self.a["words"][1]) + pos[on][known] - start[on][known])
        out[has[on]] = np.where(child >= 0, -(self.a["p3"][np.maximum(child, 0)] / QUANT), out[has[on]] - self.a["back3"][node[on]] / QUANT)
        return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of runs of equal numbers, and of each place its run."""
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _shard_scores(cols: list[np.ndarray], trained: np.ndarray, v: Vocabulary, routes: Routes, hot: HotBigrams | None, uri: str) -> np.ndarray:
    """log10 probability of every token of a shard; ``cols`` (word before, context, word) is emptied, ``trained`` marks training tokens (1)."""
    words = int(max(c.max(initial=0) for c in cols)) + 1
    uw, key = np.unique(cols.pop(), return_inverse=True)
    p1 = 10 ** v.base(v.counts_of(uw))
    ctx, ci = np.unique(cols.pop(), return_inverse=True)
    ub, ib = np.unique(cols.pop(), return_inverse=True)
    if len(ctx) * len(ub) * len(uw) < 1 << 62:
        ci *= len(ub)
        ci += ib
        ci *= len(uw)
        key += ci
        del ci, ib
        key, inv = np.unique(key, return_inverse=True)
        qc, qb, qw = key // len(uw) // len(ub), key // len(uw) % len(ub), key % len(uw)
    else:
        key, inv = np.unique(np.stack([ci, ib, key], 1), axis=0, return_inverse=True)
        qc, qb, qw = key.T
    count = np.bincount(inv, trained, len(key)).astype(np.int64)
    del key
    before, context, word, p = ub[qb], ctx[qc], uw[qw], p1[qw]
    del qc, qb, qw
    save_arrays(uri, Trie.build(before, context, word, count, p, words, routes, hot))
    return Trie(map_arrays(uri)).score(before, context, word, np.log10(p))[inv]


DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("held", "u1"), ("n", "<i8"), ("known", "<i8"), ("base", "<f8")])


def score_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_mod: int = 10, shard_tokens: int = 1_500_000) -> DataFrame:
    """Learns from all rows whose crc32(id) mod ``held_out_mod`` isn't 0 and scores every row.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null and empty texts have the end token
    only; repeated rows are learned and scored each; without training rows every token is unknown. Scores don't depend on
    ``shard_tokens``, the tokens of a shard, up to the rounding of stored probabilities.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    path = fresh_path(spark, "lm")
    vocabulary = build_vocabulary(docs, path, held_out_mod)
    routes = Routes.of(vocabulary, shard_tokens)
    hot = build_hot(docs, path, vocabulary, routes, held_out_mod)
    held = spark.sparkContext.broadcast((vocabulary, routes, hot))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        v, routes, _ = held.value
        chunk = TaskContext.get().partitionId() << 24

        def out(ids: list, hashes: list[np.ndarray], chunk: int) -> Iterator[pa.RecordBatch]:
            u, inv = np.unique(np.concatenate(hashes), return_inverse=True)
            uid, uc = v.look_up(u)
            lens = np.array([len(h) + 1 for h in hashes], np.int64)
            ends = np.cumsum(lens)
            total = int(ends[-1])
            word, count = np.zeros(total, np.int64), np.zeros(total, np.int64)
            last = np.zeros(total, bool)
            last[ends - 1] = True
            word[~last], count[~last] = uid[inv], uc[inv]
            word[last], count[last] = END, v.train_docs
            context = np.concatenate([[BOS], word[:-1]])
            starts = ends - lens
            context[starts] = BOS
            before = np.concatenate([[BOS], context[:-1]])
            before[starts] = BOS
            doc = np.repeat(np.arange(len(ids)), lens)
            facts = np.zeros(len(ids), DOC)
            facts["id"], facts["null"] = [i or 0 for i in ids], [i is None for i in ids]
            facts["held"] = [py_id_crc(i) % held_out_mod == 0 for i in ids]
            facts["n"], facts["known"] = lens, np.add.reduceat((count > 0).astype(np.int64), starts)
            facts["base"] = np.add.reduceat(v.base(count), starts)
            context, shard = routes.contexts(before, context, word)
            order = np.argsort(shard.astype(np.uint16 if routes.shards < 1 << 16 else np.int64), kind="stable")
            cut = np.searchsorted(shard[order], np.arange(routes.shards + 1))
            tag = 2 * doc + (1 - facts["held"][doc])
            live = np.flatnonzero(np.diff(cut)).tolist()
            for a in range(0, len(live), 64):
                part = live[a : a + 64]
                at = [order[cut[j] : cut[j + 1]] for j in part]
                cols = [[_planes(x[k]) for k in at] for x in (before, context, word)]
                cols.append([_planes(np.diff(tag[k], prepend=0) & 0xFFFFFFFF) for k in at])
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([chunk] * len(part), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], ["shard", "chunk", "w1", "w2", "w3", "doc"])
            yield pa.RecordBatch.from_arrays([pa.array([-1 - chunk % 4096], pa.int32()), pa.array([chunk], pa.int64()), *(pa.array([x], pa.binary()) for x in (facts.tobytes(), b"", b"", b""))], ["shard", "chunk", "w1", "w2", "w3", "doc"])

        ids, hashes, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                hashes.append(hashed(t))
                size += len(hashes[-1])
                if size > FLUSH:
                    yield from out(ids, hashes, chunk)
                    ids, hashes, size, chunk = [], [], 0, chunk + 1
        if ids:
            yield from out(ids, hashes, chunk)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        v, routes, hot = held.value
        at, rows = None, []

        def out() -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate([_numbers(r[k]) for r in rows]) for k in (1, 2, 3)]
            tags = [np.cumsum(_numbers(r[4]).astype(np.uint32).view(np.int32), dtype=np.int64) for r in rows]
            rows[:] = [r[:1] for r in rows]
            score = _shard_scores(cols, np.concatenate(tags) & 1, v, routes, hot, f"{path}/trie-{at:06d}-{np.random.default_rng().integers(1 << 62):x}")
            a = 0
            for r, t in zip(rows, tags, strict=True):
                d = t >> 1
                first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                sums = np.add.reduceat(score[a : a + len(d)], first)
                a += len(d)
                yield pa.RecordBatch.from_arrays([pa.array([r[0]], pa.int64()), pa.array([at], pa.int32()), pa.array([_planes(d[first])], pa.binary()), pa.array([sums.astype("<f8").tobytes()], pa.binary())], ["chunk", "shard", "doc", "sums"])

        for b in batches:
            for shard, chunk, *cols in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([-1], pa.int32()), pa.array([cols[0]], pa.binary()), pa.array([b""], pa.binary())], ["chunk", "shard", "doc", "sums"])
                    continue
                if shard != at:
                    if rows:
                        yield from out()
                    at, rows = shard, []
                rows.append((chunk, *cols))
        if rows:
            yield from out()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        v = held.value[0]
        at, facts, score = None, None, None

        def out() -> pa.RecordBatch:
            n = len(facts)
            return pa.RecordBatch.from_arrays([pa.array(facts["id"].astype(np.int64), mask=facts["null"].astype(bool)), pa.array(facts["held"] == 1), pa.array(facts["n"]), pa.array(facts["known"]), pa.array(np.full(n, v.tokens, np.int64)), pa.array(facts["base"]), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for b in batches:
            for chunk, shard, doc, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk != at:
                    if at is not None:
                        yield out()
                    at, facts = chunk, np.frombuffer(doc, DOC)
                    score = np.zeros(len(facts))
                if shard >= 0:
                    score[_numbers(doc)] += np.frombuffer(sums, "<f8")
        if at is not None:
            yield out()

    sent = arrow_map(docs, send, "shard int, chunk long, w1 binary, w2 binary, w3 binary, doc binary").repartition(routes.shards, "shard").sortWithinPartitions("shard", "chunk")
    parts = arrow_map(sent, answer, "chunk long, shard int, doc binary, sums binary").repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "shard")
    return arrow_map(parts, gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores all whole texts of ``documents``."""
    return score_corpus(table(spark, sf_dir, "documents"))
