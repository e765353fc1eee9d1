"""Inspection of documents: element paths, record candidates, sizes, streaming advice, starter recipes and dialects.

Documents become rows of (path, kind, sample, size) by one Arrow pass; the rest is grouping.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources import doctree
from lodestone.sources.doctree import DocumentError, Node, detect_encoding

SCHEMA = "doc string, path string, name string, depth int, kind string, value_kind string, sample string, size long, start long, pos long, parent long"


def check_head(data: bytes, fmt: str) -> str | None:
    """Why a document's head doesn't fit its format; None where it does."""
    if data.startswith(b"\x1f\x8b"):
        return "compressed input"
    head = data.lstrip(b"\xef\xbb\xbf \t\r\n")[:1]
    if fmt == "xml" and head and head not in (b"<", b"\xff", b"\xfe", b"\0"):
        return "not XML"
    if fmt != "xml" and head and head not in (b"{", b"["):
        return "not JSON"
    return None


def _key_step(key: str) -> str:
    """The XPath step that selects a key of any spelling."""
    if re.fullmatch(r"[^\W\d][\w.\-]*", key):
        return key
    if "'" not in key:
        return f"*[local-name()='{key}']"
    if '"' not in key:
        return f'*[local-name()="{key}"]'
    pieces = [f"'{p}'" for p in key.split("'")]
    return "*[local-name()=concat(" + ""","'",""".join(pieces) + ")]"


def _rows(doc: str, root: Node, fmt: str) -> Iterator[tuple]:
    todo = [(c, "", 1) for c in reversed(list(root.elements()))]
    while todo:
        n, above, depth = todo.pop()
        path = f"{above}/{n.name}"
        kids = list(n.elements())
        text = "".join(c.value for c in n.children if c.kind == "text").strip()
        kind = "object" if kids else n.scalar or ("text" if text else "empty")
        yield doc, path, n.name, depth, "element", kind if fmt != "xml" else None, text[:200] or None, (n.stop - n.start) if n.stop >= 0 else None, n.start, n.pos, n.parent.pos if n.parent else 0
        for a in n.attrs:
            yield doc, f"{path}/@{a.name}", a.name, depth, "attribute", None, a.value[:200], None, None, a.pos, n.pos
        todo.extend((c, path, depth + 1) for c in reversed(kids))


def paths(docs: DataFrame, fmt: str = "xml", id_col: str = "source_file", content: str = "content") -> DataFrame:
    """A row per element and attribute of each document; a document that can't be parsed gives one row of kind ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        schema = pa.schema([pa.field(f.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f.split()[1]]) for f in SCHEMA.split(", ")])
        for b in batches:
            out: list[tuple] = []
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    bad = "no content" if data is None else check_head(data, fmt)
                    if bad:
                        raise DocumentError(bad)
                    trees = [t for t, _, _ in doctree.parse_ndjson(data)] if fmt == "ndjson" else [doctree.parse_xml(data) if fmt == "xml" else doctree.parse_json(data)]
                    for t in trees:
                        out.extend(_rows(doc, t, fmt))
                except DocumentError as e:
                    out.append((doc, None, None, None, "error", None, str(e), None, None, None, None))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return docs.select(F.col(id_col).cast("string"), F.col(content).cast("binary")).mapInArrow(run, SCHEMA)


def encodings(docs: DataFrame, id_col: str = "source_file", content: str = "content") -> DataFrame:
    """(doc, encoding) by the head of each document."""

    @F.pandas_udf(T.StringType())
    def of(head):
        return head.map(lambda h: detect_encoding(bytes(h)))

    return docs.select(F.col(id_col).alias("doc"), of(F.substring(F.col(content).cast("binary"), 1, 1024)).alias("encoding"))


def path_report(rows: DataFrame, most: int = 1000, samples: int = 3) -> DataFrame:
    """Paths by frequency: path, kind, n, docs, empties and the first samples; the most frequent ``most``, ties by path."""
    live = rows.where("kind <> 'error'")
    order = Window.partitionBy("path").orderBy("doc", "pos")
    first = live.where("sample is not null").withColumn("k", F.row_number().over(order)).where(F.col("k") <= samples).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sample"))), lambda x: x["sample"]).alias("samples"))
    counts = live.groupBy("path", "kind").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("docs"), F.sum(F.when(F.col("sample").isNull(), 1).otherwise(0)).alias("empties"))
    return counts.join(first, "path", "left").orderBy(F.desc("n"), "path").limit(most)


def value_kinds(rows: DataFrame) -> DataFrame:
    """Of each JSON path how many values are objects, strings, numbers, booleans and nulls."""
    kinds = ("object", "string", "number", "bool", "null")
    return rows.where("kind = 'element'").groupBy("path").agg(*(F.count_if(F.col("value_kind") == k).alias(f"n_{k}") for k in kinds))


def histogram_percentile(sizes: DataFrame, share: float, col: str = "size") -> DataFrame:
    """The upper end of the power-of-two bucket that holds a share of the sizes (1 KiB to 1 GiB)."""
    bucket = F.greatest(F.lit(10), F.least(F.lit(30), F.ceil(F.log2(F.greatest(F.col(col), F.lit(1))))))
    counts = sizes.where(F.col(col).isNotNull()).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    w = Window.orderBy("b")  # at most 21 rows
    c = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(1))))
    return c.where(F.col("upto") >= F.ceil(F.col("all") * share)).agg(F.min(F.pow(F.lit(2.0), F.col("b"))).cast("long").alias("percentile"))


def record_candidates(rows: DataFrame, most: int = 10) -> DataFrame:
    """Elements that may be records: name, n, sizes; the most frequent first, ties by path."""
    own = rows.where("kind = 'element' and size is not null")
    return own.groupBy("path", "name", "depth").agg(F.count("*").alias("n"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.avg("size").alias("mean_size"), F.percentile("size", F.array(F.lit(0.5), F.lit(0.95))).alias("p")).where("n > 1").orderBy(F.desc("n"), "path").limit(most)


def suitability(n: Column, p95: Column, largest: Column) -> Column:
    """Advice on record streaming: high from 10,000 records with p95 up to 200 KB and at most 5,120 KB, medium from 1,000."""
    return F.when((n >= 10_000) & (p95 <= 200 * 1024) & (largest <= 5120 * 1024), "high").when(n >= 1000, "medium").otherwise("low")


def sample_type(c: Column) -> Column:
    """The type of a text: boolean, integer (no leading zero), number, else string."""
    return F.when(F.lower(c).isin("true", "false"), "boolean").when(c.rlike(r"^[+-]?(0|[1-9]\d*)$"), "integer").when(c.rlike(r"^[+-]?(0|[1-9]\d*)\.\d+$"), "number").otherwise("string")


def path_types(rows: DataFrame) -> DataFrame:
    """The narrowest type that all samples of a path have: integers and numbers together are numbers, other mixes strings."""
    t = rows.where("sample is not null").select("path", sample_type(F.col("sample")).alias("t")).groupBy("path").agg(F.collect_set("t").alias("ts"))
    kinds = F.array_sort("ts")
    return t.select("path", F.when(F.size("ts") == 1, F.get("ts", F.lit(0))).when(kinds == F.array(F.lit("integer"), F.lit("number")), "number").otherwise("string").alias("type"))


def starter_recipe(docs: DataFrame, fmt: str = "xml", record_type: str = "record", id_col: str = "source_file", content: str = "content") -> dict:
    """A recipe to start from: the record element, its scalar fields with types, and arrays of repeated children.

    The record is the shallowest element that repeats at least three quarters as often as the most frequent repeated
    element that has children. The driver sees one row per distinct path of the records.
    """
    rows = paths(docs, fmt, id_col, content).persist()
    try:
        own = rows.where("kind = 'element'").alias("e")
        inner = rows.where("kind = 'element'").select("doc", F.col("parent").alias("pos")).distinct()
        reps = own.join(inner, ["doc", "pos"], "left_semi").groupBy("path", "depth", "name").agg(F.count("*").alias("n")).collect()
        if not reps:
            raise ValueError("no records found")
        most = max(r["n"] for r in reps)
        best = min((r for r in reps if r["n"] >= 0.75 * most), key=lambda r: (r["depth"], -r["n"], r["path"]))
        base = best["path"]
        below = rows.where(F.col("path").startswith(base + "/")).groupBy("doc", "parent", "path", "kind", "name").agg(F.count("*").alias("k")).groupBy("path", "kind", "name").agg(F.max("k").alias("per"))
        types = {r["path"]: r["type"] for r in path_types(rows.where(F.col("path").startswith(base + "/"))).collect()}
        found = {r["path"]: r for r in below.collect()}
    finally:
        rows.unpersist()
    parents = {p.rsplit("/", 1)[0] for p in found}

    def step(rel: str) -> str:
        return "/".join(s if s.startswith("@") else _key_step(s) for s in rel.split("/"))

    mappings, arrays = [], sorted(p for p, r in found.items() if r["per"] > 1)
    for p in sorted(found):
        holder = next((a for a in arrays if p.startswith(a + "/")), None)
        if holder or (p in parents and p not in arrays):
            continue
        rel = p[len(base) + 1 :]
        name = re.sub(r"\W+", "_", rel.replace("@", "")).strip("_").lower()
        if p in arrays:
            items = [{"output_field": re.sub(r"\W+", "_", q[len(p) + 1 :].replace("@", "")).strip("_").lower(), "xpath": step(q[len(p) + 1 :]), "type": types.get(q, "string")} for q in sorted(found) if q.startswith(p + "/") and q not in parents]
            mappings.append({"output_field": name, "xpath": step(rel), "type": "array", **({"item_mapping": items} if items else {})})
        else:
            mappings.append({"output_field": name, "xpath": step(rel), "type": types.get(p, "string")})
    return {"record_type": record_type, "match_selectors": [{"xpath": f"//{_key_step(best['name'])}"}], "field_mappings": mappings}


def detect_dialect(names: DataFrame, patterns: DataFrame, least: float = 0.0) -> DataFrame:
    """The best dialect of each document: names (doc, name) against patterns (dialect, pattern, weight); shares of the weight matched.

    Patterns are names with ``*``; ties go to the dialect that comes first by name. Patterns are a small declared table.
    """
    total = patterns.groupBy("dialect").agg(F.sum("weight").alias("total"))
    own = names.select("doc", "name").distinct()
    like = F.expr("name rlike concat('^', replace(regexp_replace(pattern, '([.+()\\\\[\\\\]{}|^$?])', '\\\\\\\\$1'), '*', '.*'), '$')")
    hits = own.join(F.broadcast(patterns), like).select("doc", "dialect", "pattern", "weight").distinct().groupBy("doc", "dialect").agg(F.sum("weight").alias("got"))
    scored = hits.join(F.broadcast(total), "dialect").withColumn("score", F.col("got") / F.col("total")).where(F.col("score") >= least)
    w = Window.partitionBy("doc").orderBy(F.desc("score"), "dialect")
    return scored.withColumn("k", F.row_number().over(w)).where("k = 1").select("doc", "dialect", "score")


def merge_dialects(base: dict[str, dict], own: dict[str, dict], mode: str = "blend") -> dict[str, dict]:
    """A registry of dialects with own ones: ``blend`` joins patterns, ``override`` replaces same names, ``replace`` takes own only."""
    if mode == "replace":
        return dict(own)
    if mode == "override":
        return {**base, **own}
    if mode != "blend":
        raise ValueError(f"unknown mode {mode!r}")
    return {k: {**base.get(k, {}), **own.get(k, {})} for k in sorted({*base, *own})}


def boundaries(records: DataFrame, large: int = 10 << 20) -> DataFrame:
    """Of each file of an index: records, bytes, mean, first offset, three sample offsets, how many are ``large``, advice on streaming.

    Samples are a ring of three: the first records fill it in order, record n then takes place n mod 3. All of it is
    aggregated before the shuffle, three rows a file at most for the ring.
    """
    n, size = F.col("record_num"), F.col("size_bytes")
    slot = F.when(n <= 3, n - 1).otherwise(n % 3)
    ring = records.groupBy("source_file", slot.alias("slot")).agg(F.max_by("start_offset", "record_num").alias("offset"))
    ring = ring.groupBy("source_file").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "offset"))), lambda x: x["offset"]).alias("sample_offsets"))
    bucket = F.greatest(F.lit(10), F.least(F.lit(30), F.ceil(F.log2(F.greatest(size, F.lit(1))))))
    hist = records.groupBy("source_file", bucket.alias("b")).agg(F.count("*").alias("k"))
    w = Window.partitionBy("source_file")  # at most 21 rows
    upto = hist.withColumns({"upto": F.sum("k").over(w.orderBy("b")), "all": F.sum("k").over(w)})
    p95 = upto.where(F.col("upto") >= F.ceil(F.col("all") * 0.95)).groupBy("source_file").agg(F.min(F.pow(F.lit(2.0), F.col("b"))).cast("long").alias("p95_size"))
    agg = records.groupBy("source_file").agg(F.count("*").alias("records"), F.sum(size).alias("bytes"), F.avg(size).alias("mean_size"), F.max(size).alias("max_size"), F.min("start_offset").alias("first_offset"), F.count_if(size > large).alias("large_records"))
    out = agg.join(ring, "source_file").join(p95, "source_file")
    return out.withColumn("streaming", suitability(F.col("records"), F.col("p95_size"), F.col("max_size")))


def largest(records: DataFrame, k: int = 5, above: int = 0) -> DataFrame:
    """The ``k`` largest records above a size: source_file, record_num, start_offset, size_bytes; ties in the order of files and records."""
    return records.where(F.col("size_bytes") > above).select("source_file", "record_num", "start_offset", "size_bytes").orderBy(F.desc("size_bytes"), "source_file", "record_num").limit(k)
