"""Record index: byte ranges of the records of large files, as a table; built by pieces, verified, and read by range.

Every file is cut into pieces of ``PIECE`` bytes that all tasks share (``sources/pieces.py``): one pass gives each piece's
transition, its records and digests, the transitions are composed per file, and what is left of the records falls into place
by a join on pieces. JSON files are read by one task each, incrementally. Files are read as bytes
through the store's own API.
"""

from __future__ import annotations

import hashlib
import json
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.plans.staging import open_file, written
from lodestone.sources import pieces as P
from lodestone.sources.doctree import DocumentError

SCHEMA = "source_file string, file_size long, file_digest string, piece_size long, record_num long, start_offset long, end_offset long, size_bytes long, depth int, sha256 string, namespaces string"
PIECE = 16 << 20
#: Ranges of a file that lie this close are read at once, up to so many bytes; bytes of content in a batch.
GAP, READ = 64 << 10, 8 << 20
COMPRESSED = (".gz", ".bz2", ".xz", ".zst")


class StaleIndex(ValueError):
    """Files that aren't as they were when they were indexed."""


@dataclass
class Index:
    """``records`` (SCHEMA, sound files only) and ``files`` (source_file, file_size, file_digest, records, problem)."""

    records: DataFrame
    files: DataFrame


FOUND = "source_file string, piece long, kind string, state string, blob binary, start long, end long, after int, pops int, depth int, namespaces string, sha256 string, nr long"
_KINDS = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64())


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], [c.split()[0] for c in FOUND.split(", ")])


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _scan_piece(path: str, size: int, k: int, name: str, fmt: str, piece: int) -> Iterator[tuple]:
    """One piece's rows: its digest (d), transitions (s) and records (r, numbered where none is left out later); a JSON file is one piece."""
    try:
        with open_file(path) as src:
            if fmt == "json":
                own = P.Digests(src, piece)
                problem = None
                try:
                    for nr, (s, e, body) in enumerate(P.json_records(own, name), 1):
                        yield path, k, "r", "text", None, s, e, 0, 0, 1, "{}", _sha(body), nr
                except DocumentError as error:
                    problem = str(error)
                while own.read(1 << 20):
                    pass
                yield path, k, "d", None, pickle.dumps((own.all(), problem)), *[None] * 8
                return
            begin, data, digest = (P.line_piece if fmt == "ndjson" else P.xml_piece)(src, k * piece, piece, size)
    except OSError as error:
        yield path, k, "d", None, pickle.dumps(([], f"input_unavailable: {error}")), *[None] * 8
        return
    wide = fmt == "xml" and k == 0 and data[:2] in (b"\xff\xfe", b"\xfe\xff")
    yield path, k, "d", None, pickle.dumps(([digest], "UTF-16 can't be cut into pieces" if wide else None)), *[None] * 8
    if fmt == "ndjson":
        for nr, (s, e) in enumerate(P.lines_of(data, begin), 1):
            yield path, k, "r", "text", None, s, e, 0, 0, 1, "{}", _sha(data[s - begin : e - begin]), nr
        return
    for state, (t, found) in (P.transitions_of(data, begin, name.encode()) if data and not wide else {}).items():
        yield path, k, "s", state, pickle.dumps(t), *[None] * 8
        for f in found:
            yield path, k, "r", state, None, f.start, f.end, f.after, f.pops, f.depth, json.dumps(f.namespaces), _sha(data[f.start - begin : f.end - begin]), None


ENTRIES = "source_file string, kind string, piece long, state string, scopes string, open_records int, start long, end long, depth int, file_digest string, problem string"


def _compose(t: pa.Table) -> pa.Table:
    """One file's pieces: how each is entered (e), the records in several pieces (l), and the file's digest and problem (f)."""
    rows = sorted((r["piece"], r["kind"], r["state"], r["blob"]) for r in t.select(["piece", "kind", "state", "blob"]).to_pylist())
    path = t.column("source_file")[0].as_py()
    whole = [(k, pickle.loads(b)) for k, kind, _, b in rows if kind == "d"]
    by: list[dict] = [{} for _ in whole]
    place = {k: j for j, (k, _) in enumerate(whole)}
    for k, kind, state, blob in rows:
        if kind == "s":
            by[place[k]][state] = pickle.loads(blob)
    problem = next((p for _, (_, p) in whole if p), None)
    entries, long, fault = P.compose(by) if any(by) else ([], [], None)
    if not any(by) and not problem and t.column("fmt")[0].as_py() == "xml":
        fault = "malformed XML: 0 root elements"
    out = [{"kind": "e", "piece": whole[j][0], "state": e.state, "scopes": json.dumps(e.scopes), "open_records": e.records} for j, e in enumerate(entries)]
    out += [{"kind": "l", "piece": whole[k][0], "start": s, "end": e, "depth": d, "scopes": json.dumps(ns)} for k, s, e, d, ns in long]
    out.append({"kind": "f", "file_digest": P.digest_of([d for _, (own, _) in whole for d in own]) if not problem or whole[0][1][0] else None, "problem": problem or fault})
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
    return pa.table([pa.array([path if n == "source_file" else r.get(n) for r in out], k) for n, k in zip(names, kinds, strict=True)], names)


def build_index(files: DataFrame, name: str, fmt: str = "xml", piece: int = PIECE) -> Index:
    """Index of the records of files (columns source_file, size_bytes). Compressed sources are refused.

    XML records are the outermost elements of a local name, JSON ones the values of that name anywhere, NDJSON the lines;
    they are numbered in the order of their starts. A file that isn't well-formed has a problem and no records. A file's
    digest is that of its bytes up to ``piece``, beyond that the digest of its pieces' digests. What is held per file by one
    task is a few hundred bytes a piece. An empty list of files gives no rows.
    """
    spark = files.sparkSession
    own = files.select(F.col("source_file").cast("string").alias("source_file"), F.col("size_bytes").cast("long").alias("size"))
    bad = own.where(F.lower("source_file").rlike(r"\.(gz|bz2|xz|zst)$")).first()
    if bad is not None:
        raise DocumentError(f"{bad['source_file']}: compressed sources can't be indexed")
    last = F.lit(0).cast("long") if fmt == "json" else F.greatest(F.ceil(F.col("size") / piece) - 1, F.lit(0).cast("long"))
    tasks = max(1, spark.sparkContext.defaultParallelism * 4)
    parts = own.select("source_file", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).repartition(tasks, "source_file", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            rows = chain.from_iterable(_scan_piece(path, size, k, name, fmt, piece) for path, size, k in zip(*(c.to_pylist() for c in b.columns), strict=True))
            while held := list(islice(rows, 5000)):
                yield _found(held)

    found = written(parts.mapInArrow(run, FOUND), "index-pieces")
    small = found.where("kind in ('d', 's')").select("source_file", "piece", "kind", "state", "blob", F.lit(fmt).alias("fmt"))
    told = written(small.groupBy("source_file").applyInArrow(_compose, ENTRIES), "index-entries")
    seen = told.where("kind = 'f'").select("source_file", "file_digest", "problem")
    sound = seen.where("problem is null").select("source_file")
    candidates = found.where("kind = 'r'").select("source_file", "piece", "state", "start", "end", "after", "pops", "depth", "namespaces", "sha256", "nr")
    if fmt == "xml":
        entry = told.where("kind = 'e'").select("source_file", "piece", "state", "scopes", "open_records")
        hit = candidates.join(entry, ["source_file", "piece", "state"]).where("after >= open_records")
        open_scopes = F.from_json("scopes", "array<map<string,string>>")
        left = F.size(open_scopes) - F.col("pops")
        outer = F.to_json(F.slice(open_scopes, 1, left))
        whole = hit.select("source_file", "piece", "start", "end", (left + F.col("depth")).cast("int").alias("depth"), outer.alias("outer"), "namespaces", "sha256")
        long = told.where("kind = 'l'").select("source_file", "piece", "start", "end", "depth", F.lit("[]").alias("outer"), F.col("scopes").alias("namespaces"))
        whole = whole.unionByName(_digested(long))
    else:
        whole = candidates.select("source_file", "piece", "start", "end", "depth", "nr", "sha256")
    whole = whole.join(sound, "source_file", "left_semi")
    counts = written(whole.groupBy("source_file", "piece").agg(F.count("*").alias("n")), "index-counts")
    before = Window.partitionBy("source_file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("source_file", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if fmt == "xml":
        whole = whole.withColumn("nr", F.row_number().over(Window.partitionBy("source_file", "piece").orderBy("start")))
    numbered = whole.join(base, ["source_file", "piece"])
    about = own.join(seen, "source_file")
    records = numbered.join(about.select("source_file", "size", "file_digest"), "source_file").select(
        "source_file", F.col("size").alias("file_size"), "file_digest", F.lit(piece).cast("long").alias("piece_size"), (F.col("nr") + F.col("base")).alias("record_num"),
        F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), (F.col("end") - F.col("start")).alias("size_bytes"), "depth", "sha256", (_scope_lines() if fmt == "xml" else F.lit("")).alias("namespaces"),
    )
    total = counts.groupBy("source_file").agg(F.sum("n").alias("records"))
    about = about.join(total, "source_file", "left").select("source_file", F.col("size").alias("file_size"), "file_digest", F.coalesce("records", F.lit(0)).alias("records"), "problem")
    return Index(written(records, "index-records"), written(about, "index-files"))


def _scope_lines():
    """``prefix=uri`` lines, by prefix, of the namespaces in scope: inner declarations hide outer ones."""
    maps = F.concat(F.from_json("outer", "array<map<string,string>>"), F.array(F.from_json("namespaces", "map<string,string>")))
    pairs = F.flatten(F.transform(maps, lambda m: F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>"))))
    merged = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda a, e: F.concat(F.filter(a, lambda x: x["key"] != e["key"]), F.array(e)))
    return F.concat_ws("\n", F.transform(F.array_sort(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"])))


def _digested(long: DataFrame) -> DataFrame:
    """Records in several pieces with their digests: each is read once more, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, s, e in zip(*(b.column(b.schema.names.index(n)).to_pylist() for n in ("source_file", "start", "end")), strict=True):
                h = hashlib.sha256()
                with open_file(path) as src:
                    src.seek(s)
                    while s < e:
                        h.update(src.read(min(1 << 20, e - s)))
                        s += 1 << 20
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "sha256"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long.schema.fields)
    return long.repartition(max(1, long.sparkSession.sparkContext.defaultParallelism), "source_file", "start").mapInArrow(run, f"{kinds}, sha256 string")


def build(files: DataFrame, name: str, fmt: str = "xml", limit: int | None = None, piece: int = PIECE) -> DataFrame:
    """The records of an index, of sound files; with ``limit`` the first ones of each file."""
    records = build_index(files, name, fmt, piece).records
    return records if limit is None else records.where(F.col("record_num") <= limit)


def reads(rows: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """The runs of (file, start, end) rows that one read takes: at most ``READ`` bytes where there are several, no gap above ``GAP``."""
    k = 0
    while k < len(rows):
        path, low, high = rows[k]
        z = k + 1
        while z < len(rows) and rows[z][0] == path and high <= rows[z][1] <= high + GAP and rows[z][2] - low <= READ:
            high = rows[z][2]
            z += 1
        yield k, z
        k = z


def read_ranges(index: DataFrame, partitions: int | None = None, documents: bool = False) -> DataFrame:
    """The index with each record's bytes (``content``): neighbouring ranges of a file are read at once, in order by each task.

    With ``documents`` XML records are documents of their own (:func:`_document`), made where they are read: no second
    Python worker for a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        at, src = None, None
        try:
            for b in batches:
                names = b.schema.names
                rows = list(zip(*(b.column(names.index(n)).to_pylist() for n in ("source_file", "start_offset", "end_offset")), strict=True))
                for k, z in reads(rows):
                    path, low, high = *rows[k][:2], rows[z - 1][2]
                    if path != at:
                        if src is not None:
                            src.close()
                        at, src = path, open_file(path)
                    src.seek(low)
                    data = src.read(high - low)
                    content = [data[s - low : e - low] for _, s, e in rows[k:z]]
                    if documents:
                        content = list(map(_document, b.column(names.index("namespaces")).slice(k, z - k).to_pylist(), content))
                    yield pa.RecordBatch.from_arrays([*b.slice(k, z - k).columns, pa.array(content, pa.binary())], [*names, "content"])
        finally:
            if src is not None:
                src.close()

    n = partitions or index.sparkSession.sparkContext.defaultParallelism * 4
    ordered = index.repartitionByRange(n, "source_file", "start_offset").sortWithinPartitions("source_file", "start_offset")
    return ordered.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields) + ", content binary")


def _document(namespaces: str, c: bytes) -> bytes:
    """A record as a document of its own: the namespaces in scope are declared on its start tag."""
    end = len(c) if not c else min(x for x in (c.find(b" "), c.find(b">"), c.find(b"/"), c.find(b"\n"), len(c)) if x > 0)
    head = c[: c.find(b">")]
    more = b""
    for line in filter(None, namespaces.split("\n")):
        p, u = line.split("=", 1)
        key = f"xmlns:{p}=" if p else "xmlns="
        if key.encode() not in head:
            more += f' {key}"{u}"'.encode()
    return c[:end] + more + c[end:]


def wrap(ranges: DataFrame) -> DataFrame:
    """Records that were read as they are, as documents of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            cols = list(b.columns)
            cols[names.index("content")] = pa.array(map(_document, b.column(names.index("namespaces")).to_pylist(), b.column(names.index("content")).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names)

    return ranges.mapInArrow(run, ranges.schema)


def verify(index: DataFrame) -> DataFrame:
    """Rows (source_file, problem) of files or records that aren't as indexed; none where all is well. Files are read by pieces."""
    files = index.select("source_file", "file_size", "file_digest", "piece_size").distinct()
    parts = files.select("source_file", "file_size", "piece_size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("file_size") / F.col("piece_size")) - 1, F.lit(0).cast("long")))).alias("piece"))

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, size, step, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    with open_file(path) as src:
                        now = src.size()
                        src.seek(min(now, k * step))
                        data = src.read(step)
                    out.append((path, k, hashlib.sha256(data).digest(), None if now == size else f"size {now}, indexed {size}"))
                except OSError:
                    out.append((path, k, None, "missing"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["source_file", "piece", "digest", "problem"])

    tasks = index.sparkSession.sparkContext.defaultParallelism * 4
    now = parts.repartition(tasks, "source_file", "piece").mapInArrow(piece, "source_file string, piece long, digest binary, problem string")
    # the digests of a file's pieces, 32 bytes each, in order
    rows = now.groupBy("source_file").agg(F.max("problem").alias("problem"), F.transform(F.array_sort(F.collect_list(F.struct("piece", "digest"))), lambda p: p["digest"]).alias("p"))
    digest = F.when(F.size("p") == 1, F.lower(F.hex(F.col("p")[0]))).otherwise(F.sha2(F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p)), 256))
    bad_files = files.join(rows, "source_file").select("source_file", F.coalesce("problem", F.when(digest != F.col("file_digest"), "the file's digest differs")).alias("problem")).where("problem is not null")
    bad_files = written(bad_files, "index-faults")
    sound = index.join(bad_files.select(F.col("source_file").alias("_bad")), F.col("source_file") == F.col("_bad"), "left_anti").select(*[c.split()[0] for c in SCHEMA.split(", ")])
    records = read_ranges(sound).where(F.sha2("content", 256) != F.col("sha256")).select("source_file", F.concat(F.lit("record "), F.col("record_num").cast("string"), F.lit(": the digest differs")).alias("problem"))
    return bad_files.union(records)


def check_before_run(index: DataFrame, files: DataFrame) -> None:
    """Refuses an index whose files (source_file, size_bytes) are gone, have another size, or other bytes at their first piece.

    A cheap check of what is to be read; :func:`verify` reads everything. At most a hundred problems are told.
    """
    known = index.select("source_file", "file_size", "file_digest", "piece_size").distinct()
    now = files.select(F.col("source_file").alias("_now"), F.col("size_bytes").alias("_size"))
    sizes = known.join(now, F.col("source_file") == F.col("_now"), "full").select(F.coalesce("source_file", "_now").alias("f"), F.when(F.col("_now").isNull(), "missing").when(F.col("source_file").isNull(), "not in the index").when(F.col("_size") != F.col("file_size"), "its size differs").alias("p"))
    first = index.where("record_num = 1").select(*[c.split()[0] for c in SCHEMA.split(", ")])
    gone = sizes.where("p is not null").limit(100).collect()
    if not gone:
        gone = read_ranges(first).where(F.sha2("content", 256) != F.col("sha256")).select(F.col("source_file").alias("f"), F.lit("its first record differs").alias("p")).limit(100).collect()
    if gone:
        raise StaleIndex("; ".join(f"{r['f']}: {r['p']}" for r in gone))


def size_stats(index: DataFrame) -> DataFrame:
    """Records, smallest, largest, mean and exact interpolated p50, p95, p99 (rounded half up) of the sizes."""
    p = F.percentile("size_bytes", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    s = index.agg(F.count("*").alias("records"), F.min("size_bytes").alias("smallest"), F.max("size_bytes").alias("largest"), F.avg("size_bytes").alias("mean"), p.alias("p"))
    return s.select("records", "smallest", "largest", "mean", *(F.floor(F.get("p", F.lit(k)) + 0.5).alias(n) for k, n in enumerate(("p50", "p95", "p99"))))


def load(spark: SparkSession, path: str) -> DataFrame:
    """An index that was written as Parquet."""
    return spark.read.parquet(path)
