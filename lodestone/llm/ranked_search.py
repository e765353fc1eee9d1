"""Ranked lexical search over a forward index in blocks, pruned by block maxima.

Documents are indexed in the order in which tables are read: a segment is a run of documents with its own dictionary, a
block up to ``BLOCK_DOCS`` consecutive ones of a segment. A block keeps the largest impact that each of its terms has in
it, and its documents' terms and impacts as a forward index of its own. For a query every block of a segment gets a bound,
the sum of the query's weights times the maxima; blocks are scored from the highest bound on until it drops below the
lowest score that still counts. A first share of the segments is searched before the others and gives them that score.

Impacts depend on a document's length and the table's totals only, weights on document frequencies only, so an index
serves any set of queries. All numbers are 64-bit integers: scores are exact, and equal scores are told apart by id.
"""

from __future__ import annotations

import io
import math
import pickle
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, file_system, fresh_path, partitions, table, written
from .wordlists import flat_rows, starts_of, word_lists

#: What lies between terms, of texts whose A-Z are lower-cased.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
BLOCK_DOCS = 64
#: Bytes of text of a segment (one longer text is one alone), and of the query texts that are held at once.
SEGMENT_BYTES, QUERY_BYTES = 8 << 20, 1 << 20
#: One segment in so many is searched first.
FIRST_SHARE = 16
NO_ID = np.iinfo(np.int64).max


def impact(tf: np.ndarray, length: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What an occurrence count adds for each unit of its term's weight, in a document of so many terms."""
    m = 25 + (75 * length * documents) // words
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


# ---- building ------------------------------------------------------------------------------------------------

FORWARD = "n_docs long, n_words long, ids binary, nulls binary, lengths binary, per_doc binary, terms binary, tf binary, dictionary binary"


def _forward(ids: pa.Array, texts: pa.Array) -> list | None:
    """One segment's documents with any term: their ids, lengths, terms (places in an ascending dictionary) and counts."""
    words, lengths = word_lists(texts, SEPARATORS)
    if not len(words):
        return None
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    key, tf = np.unique(doc * len(order) + rank[coded.indices.to_numpy()], return_counts=True)
    per_doc = np.bincount(key // len(order), minlength=len(lengths))
    live = np.flatnonzero(lengths)
    held = ids.take(pa.array(live))
    sink = io.BytesIO()
    names = pa.record_batch([coded.dictionary.take(pa.array(order))], ["w"])
    with pa.ipc.new_stream(sink, names.schema) as out:
        out.write_batch(names)
    return [len(live), int(lengths.sum()), pc.fill_null(held, 0).to_numpy().astype("<i8").tobytes(), held.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes(), lengths[live].astype("<i8").tobytes(), per_doc[live].astype("<i8").tobytes(), _packed((key % len(order)).astype("<i4")), _packed(tf.astype("<i8")), sink.getvalue()]


def _packed(values: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest one needs, compressed: the width comes first."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << (8 * w))
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(values.astype(f"<u{width}").tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), f"<u{raw[0]}").astype(np.int64)


def _dictionary(raw: bytes) -> pa.Array:
    return pa.ipc.open_stream(raw).read_all().column(0).combine_chunks()


class Segment:
    """A sealed segment: dictionary, block maxima by term and, read when asked for, the blocks' forward indexes."""

    def __init__(self, src, at: int) -> None:
        self.src, self.at = src, at
        src.seek(at)
        head = np.frombuffer(src.read(16), "<i8")
        maps = pickle.loads(src.read(int(head[0])))
        self.terms = _dictionary(zstandard.ZstdDecompressor().decompress(maps["dictionary"]))
        self.first, self.block, self.most = (_unpacked(maps[n]) for n in ("first", "block", "most"))
        self.ends, self.body = maps["ends"], at + 16 + int(head[0])
        self.held: dict[int, tuple] = {}

    def forward(self, b: int) -> tuple[np.ndarray, ...]:
        """A block's ids, null marks, where each document begins, terms and impacts."""
        if b not in self.held:
            self.src.seek(self.body + int(self.ends[b]))
            ids, nulls, first, terms, impacts = pickle.loads(self.src.read(int(self.ends[b + 1] - self.ends[b])))
            self.held[b] = ids, nulls, first, _unpacked(terms), _unpacked(impacts)
        return self.held[b]

    @staticmethod
    def sealed(row: dict, documents: int, words: int) -> bytes:
        """The file form of a segment of the forward table, with the table's totals."""
        ids, nulls = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nulls"], "u1").astype(bool)
        lengths, per_doc = np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row["per_doc"], "<i8")
        terms, tf = _unpacked(row["terms"]), _unpacked(row["tf"])
        at = starts_of(per_doc)
        got = impact(tf, np.repeat(lengths, per_doc), documents, words)
        edges = [*range(0, len(ids), BLOCK_DOCS), len(ids)]
        bodies = []
        for a, z in zip(edges, edges[1:], strict=False):
            own = slice(int(at[a]), int(at[z]))
            bodies.append(pickle.dumps((ids[a:z], nulls[a:z], at[a:z] - at[a], _packed(terms[own]), _packed(got[own])), 5))
        block = np.repeat(np.arange(len(ids)) // BLOCK_DOCS, per_doc)
        order = np.lexsort((block, terms))
        key = terms[order] * len(bodies) + block[order]
        head = np.flatnonzero(np.diff(key, prepend=-1))
        term_of = (key[head] // len(bodies)).astype(np.int64)
        maps = {"dictionary": zstandard.ZstdCompressor(level=1).compress(row["dictionary"]), "block": _packed(key[head] % len(bodies)), "most": _packed(np.maximum.reduceat(got[order], head)), "ends": starts_of(np.array([len(b) for b in bodies]))}
        maps["first"] = _packed(np.searchsorted(term_of, np.arange(len(_dictionary(row["dictionary"])) + 1)))
        packed = pickle.dumps(maps, 5)
        return np.array([len(packed), len(bodies)], "<i8").tobytes() + packed + b"".join(bodies)


class Index:
    """A built index: ``manifest`` (path, at, nr: one row a segment), ``counts`` (term, n: documents by segment), the totals."""

    def __init__(self, manifest: DataFrame, counts: DataFrame, documents: int, words: int) -> None:
        self.manifest, self.counts, self.documents, self.words = manifest, counts, documents, words


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Indexes every document that has a term; null and empty texts have none. Nothing is shuffled but the segments' names.

    Repeated rows are documents of their own. The files lie below the session's shared folder, a file for each task; one
    of a task that ran again is named by its own run and no other.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    names = [c.split()[0] for c in FORWARD.split(", ")]

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held, size = [], 0

        def close() -> Iterable[pa.RecordBatch]:
            row = _forward(pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1) for b in held])) if held else None
            if row:
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in row], names)

        for b in batches:
            if held and size + b.nbytes > SEGMENT_BYTES:
                yield from close()
                held, size = [], 0
            held.append(b)
            size += b.nbytes
        yield from close()

    rows = written(arrow_map(docs, forward, FORWARD), "forward")
    total = rows.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("w")).first()
    n, words, path = total["n"], total["w"], fresh_path(spark, "search")

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        sink, at, nr = None, 0, 0
        for b in batches:
            for row in b.to_pylist():
                if sink is None:
                    store, place = file_system(name)
                    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    sink = store.open_output_stream(place, compression=None)
                raw = Segment.sealed(row, n, words)
                sink.write(raw)
                yield pa.RecordBatch.from_pydict({"path": [name], "at": [at], "nr": pa.array([nr], pa.int32())})
                at, nr = at + len(raw), nr + 1
        if sink is not None:
            sink.close()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for raw, terms in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                names = _dictionary(raw)
                yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(_unpacked(terms.as_py()), minlength=len(names)))], ["term", "n"])

    manifest = written(arrow_map(rows, seal, "path string, at long, nr int"), "segments")
    return Index(manifest, arrow_map(rows.select("dictionary", "terms"), count, "term string, n long"), n, words)


# ---- searching -----------------------------------------------------------------------------------------------


class Queries:
    """A block of queries: their rows' numbers, the distinct terms, and (query, term, weight times repeats) as columns."""

    def __init__(self, rows: np.ndarray, terms: list[str], query: np.ndarray, term: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(query, kind="stable")
        self.rows, self.terms, self.query, self.term, self.weights = rows, pa.array(terms, pa.string()), query[order], term[order], weights[order]
        self.first = np.searchsorted(self.query, np.arange(len(rows) + 1))


class Best:
    """The highest scores of one query so far, by score, then id (null ids last); ``least`` is what a further one must reach."""

    def __init__(self, k: int, least: int = 1) -> None:
        self.k, self.floor, self.least, self.rows = k, least, least, []

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.least)
        if len(at):
            self.rows = sorted([*self.rows, *zip((-scores[at]).tolist(), nulls[at].tolist(), ids[at].tolist(), strict=True)])[: self.k]
            if len(self.rows) == self.k:
                self.least = max(self.floor, -self.rows[-1][0])


def search_segment(seg: Segment, queries: Queries, best: list[Best]) -> int:
    """Adds a segment's documents to the queries' ``best``; returns how many blocks were scored."""
    blocks = len(seg.ends) - 1
    own = pc.index_in(queries.terms, value_set=seg.terms)
    own = pc.fill_null(own, -1).to_numpy()[queries.term]
    live = np.flatnonzero(own >= 0)
    term, weights, query = own[live], queries.weights[live], queries.query[live]
    many = seg.first[term + 1] - seg.first[term]
    place = np.arange(int(many.sum())) - np.repeat(starts_of(many)[:-1] - seg.first[term], many)
    bound = np.bincount(np.repeat(query, many) * blocks + seg.block[place], np.repeat(weights, many).astype(float) * seg.most[place], minlength=len(best) * blocks).reshape(-1, blocks)
    bound = np.floor(bound * (1 + 1e-12)) + 1  # sums in doubles may be short by less than this; one above where exact
    edges, scored = np.searchsorted(query, np.arange(len(best) + 1)), 0
    dense = np.zeros(len(seg.terms), np.int64)
    for q in np.flatnonzero(bound.max(1) > np.array([b.least for b in best])).tolist():
        of = slice(int(edges[q]), int(edges[q + 1]))
        if of.start == of.stop:
            continue
        dense[term[of]] = weights[of]
        for b in np.argsort(-bound[q], kind="stable").tolist():
            if bound[q, b] <= best[q].least:
                break
            ids, nulls, first, terms, impacts = seg.forward(b)
            best[q].add(np.add.reduceat(dense[terms] * impacts, first), ids, nulls)
            scored += 1
        dense[term[of]] = 0
    return scored


def _search(segments: DataFrame, uris: list[str], k: int) -> DataFrame:
    """(b, q, doc_id, score): the best of each task for query q of block b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]  # names only
        for number, uri in enumerate(uris if rows else []):
            queries, least = _load(uri)
            best = [Best(k, n) for n in least]
            for path, at in rows:
                store, place = file_system(path)
                with store.open_input_file(place) as src:
                    search_segment(Segment(src, at), queries, best)
            found = [(number, int(queries.rows[q]), None if null else i, -score) for q, b in enumerate(best) for score, null, i in b.rows]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["b", "q", "doc_id", "score"])

    return arrow_map(segments, run, "b int, q long, doc_id long, score long")


def _load(uri: str) -> tuple[Queries, list[int]]:
    """A block of queries, and what a score of each must reach at least."""
    store, at = file_system(uri)
    with store.open_input_stream(at, compression=None) as src:
        return pickle.loads(src.read())


def _save(uri: str, value) -> None:
    store, at = file_system(uri)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at, compression=None) as sink:
        sink.write(pickle.dumps(value, 5))


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item_id, rank, doc_id, score.

    Every row of ``items`` is a query; repeated rows and rows without id have results of their own. A query without terms,
    or none of them in a document, has no rows. Of equal scores the smaller id comes first, null ids last. Queries lie in
    files of about ``QUERY_BYTES`` of text, made by tasks; the driver gets the files' names and the table's totals.
    """
    spark = items.sparkSession
    rows = written(items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("q")), "queries")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = size // QUERY_BYTES + 1

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            words, lengths = word_lists(b.column(1), SEPARATORS)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), lengths))), words], ["q", "term"])

    asked = arrow_map(rows.select("q", "t"), terms, "q long, term string").groupBy("q", "term").agg(F.count("*").alias("n"))
    asked = written(asked, "query-terms")
    df = index.counts.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    n = F.lit(float(index.documents))
    known = asked.join(df, "term").select(F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("b"), "q", "term", (F.col("n") * F.floor(1000 * F.log((2 * n + 2) / (2 * F.col("df") + 1)))).alias("w"))
    path = fresh_path(spark, "query-blocks")

    def save(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"uri": pa.array([], pa.string())})
        names = t.column("term").combine_chunks().dictionary_encode()
        own, query = np.unique(t.column("q").to_numpy(), return_inverse=True)
        uri = f"{path}/{t.column('b')[0].as_py()}-{uuid.uuid4().hex}"
        _save(uri, (Queries(own, names.dictionary.to_pylist(), query, names.indices.to_numpy().astype(np.int64), t.column("w").to_numpy()), [1] * len(own)))
        return pa.table({"uri": [uri]})

    uris = sorted(r["uri"] for r in written(known.groupBy("b").applyInArrow(save, "uri string"), "query-files").collect())
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not uris:
        return empty
    tasks = partitions(spark)
    first = F.pmod(F.xxhash64("path", "at"), F.lit(FIRST_SHARE)) == 0
    early = written(_top(_search(index.manifest.where(first).repartition(tasks), uris, k), k), "first-found")

    def raise_floor(t: pa.Table) -> pa.Table:
        number = t.column("b")[0].as_py()
        queries, least = _load(uris[number])
        at = np.searchsorted(queries.rows, t.column("q").to_numpy())
        for j, score in zip(at.tolist(), t.column("score").to_pylist(), strict=True):
            least[j] = score
        uri = f"{uris[number]}-{uuid.uuid4().hex}"
        _save(uri, (queries, least))
        return pa.table({"b": pa.array([number], pa.int32()), "uri": [uri]})

    raised = {r["b"]: r["uri"] for r in written(early.where(F.col("rank") == k).groupBy("b").applyInArrow(raise_floor, "b int, uri string"), "raised-files").collect()}
    late = _search(index.manifest.where(~first).repartition(tasks), [raised.get(j, u) for j, u in enumerate(uris)], k)
    found = _top(early.drop("rank").unionByName(late), k)
    return found.join(rows.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """Ranks all ``documents`` for each item of ``benchmark``."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
