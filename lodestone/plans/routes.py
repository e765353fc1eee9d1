"""Routes of an extraction: whole documents, records by byte range, lines of split files, or Spark's own record reader.

All give the same records and the same dispositions by file. Records and lines are extracted one by one and staged once in
the shared folder; what fails a file (a bad record, too few records, a signature, a fault found by the index) is gathered
from the staged errors and from counts, and the files that failed prune the staged rows. No window or shuffle sees data.
"""

from __future__ import annotations

import json
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import index as IX
from lodestone.sources.reference import ReferenceTable
from lodestone.sources.scan import NAMES, listed, read_files, read_lines
from lodestone.sources.xpath import compile_xpath

from .extract import Extraction, extract
from .native import scan_native
from .recipe import Mapping, Recipe, RecipeError, Selector, record_name
from .staging import written

#: Bytes from which files are cut into records; gzip files count ten times their size.
LARGE = 100 << 20
#: Bytes of lines that a task reads at least, where the files' splits are smaller and every core has four tasks.
LINES = 16 << 20
SPLIT = "spark.sql.files.maxPartitionBytes"
OUTSIDE = frozenset({"ancestor", "ancestor-or-self", "parent", "preceding", "preceding-sibling", "following", "following-sibling"})


def _all(ms: list[Mapping] | tuple[Mapping, ...]):
    for m in ms:
        yield m
        yield from _all(m.items)
        for v in m.variants:
            yield from _all(v.fields)


def needs_document(r: Recipe) -> str | None:
    """Why a recipe can't be run record by record; None where it can."""
    if r.applicability:
        return "it has an applicability predicate"
    if len(r.selectors) != 1 or record_name(r.selectors[0].xpath) is None:
        return "it has no single selector Name or //Name"
    if r.match_scope == "document" and (r.signature or {}).get("match_patterns"):
        return "its signature matches whole documents"
    for m in _all(r.mappings):
        if m.xpath:
            p = compile_xpath(m.xpath, r.namespaces)
            if p.axes & OUTSIDE or m.xpath.lstrip().startswith(("/", "(/")):
                return f"{m.xpath!r} may look outside its record"
    return None


def choose_route(r: Recipe, size: int, name: str = "") -> str:
    """``lines`` for NDJSON; else ``document`` up to LARGE, beyond it ``records``, or ``unsupported`` where that can't be."""
    if r.format == "ndjson":
        return "lines"
    if size * (10 if name.lower().endswith(".gz") else 1) <= LARGE:
        return "document"
    return "unsupported" if needs_document(r) or name.lower().endswith(IX.COMPRESSED) else "records"


KEYS = ["source_file", "size_bytes", "input_ordinal", "input_sha256"]


def _keyed(files: DataFrame) -> DataFrame:
    """Files with the columns that identify an input; digests of files that aren't read as a whole are left out."""
    out = files if "input_ordinal" in files.columns else files.withColumn("input_ordinal", F.lit(None).cast("long"))
    out = out if "input_sha256" in out.columns else out.withColumn("input_sha256", F.lit(None).cast("string"))
    return out.select(*KEYS, *(c for c in ("file",) if c in out.columns))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where its counted rows are few names."""
    return F.broadcast(df) if rows <= NAMES else df


def _by_file(e: Extraction, files: DataFrame, r: Recipe, problems: DataFrame | None) -> Extraction:
    """Outcomes by file of rows that each tell their own error (columns source_file, record_num, nr: the order of errors).

    Faults of the file come first, then documents that don't parse, signatures that don't match, other errors, floors.
    """
    rows = e.rows
    level = F.when(F.col("reason") == "parse_error", 0).when(F.col("disposition") == "not_applicable", 1).when(F.col("_class").isNotNull(), 2 + F.col("_class"))
    told = rows.where(level.isNotNull()).groupBy("source_file").agg(F.min(F.struct(level.alias("level"), "nr", "disposition", "reason", "error")).alias("first"))
    counts = rows.groupBy("source_file", "selector").agg(F.count("record_num").alias("n"))
    per = counts.where("selector is not null").groupBy("source_file").agg(F.map_from_entries(F.collect_list(F.struct("selector", "n"))).alias("per"))
    sure = rows.groupBy("source_file").agg(F.min("confidence").alias("confidence"), F.count("confidence").alias("scored"))
    all_files = files.join(told, "source_file", "left").join(per, "source_file", "left").join(sure, "source_file", "left")
    all_files = all_files.join(problems.select("source_file", "problem"), "source_file", "left") if problems is not None else all_files.withColumn("problem", F.lit(None).cast("string"))
    n = [F.coalesce(F.col("per")[F.lit(k)], F.lit(0)) for k in range(len(r.selectors))]
    low = [F.when(n[k] < s.min_occurrences, F.concat(F.lit(f"selector {k} matched "), n[k].cast("string"), F.lit(f" records, at least {s.min_occurrences} are needed"))) for k, s in enumerate(r.selectors) if s.min_occurrences]
    floor = F.nullif(F.concat_ws("; ", *low), F.lit("")) if low else F.lit(None).cast("string")
    gone = F.col("problem").startswith("input_unavailable")
    outcome = F.when(F.col("problem").isNotNull(), F.struct(F.lit("failed").alias("d"), F.when(gone, "input_unavailable").otherwise("parse_error").alias("r"), F.col("problem").alias("e")))
    outcome = outcome.when(F.col("first").isNotNull(), F.struct(F.col("first.disposition").alias("d"), F.col("first.reason").alias("r"), F.when(F.col("first.reason") == "parse_error", F.concat(F.lit("record " if r.format != "ndjson" else "line "), F.col("first.nr").cast("string"), F.lit(": "), F.col("first.error"))).otherwise(F.col("first.error")).alias("e")))
    outcome = outcome.when(floor.isNotNull(), F.struct(F.lit("failed").alias("d"), F.lit("min_occurrences_violation").alias("r"), floor.alias("e")))
    about = written(all_files.select(*KEYS, outcome.alias("o"), F.coalesce(F.aggregate(F.map_values("per"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("n"), F.array(*n).alias("selector_counts"), "confidence"), "outcomes")
    many = about.count()
    lost = _small(about.where("o is not null").select(F.col("source_file").alias("_lost")), many)
    kept = rows.where("record_num is not null").join(lost, F.col("source_file") == F.col("_lost"), "left_anti")
    own = _small(about.select("source_file", F.col("size_bytes").alias("_s"), F.col("input_ordinal").alias("_o"), F.col("input_sha256").alias("_h"), F.col("selector_counts").alias("_c"), F.col("confidence").alias("_k")), many)
    kept = kept.join(own, "source_file").withColumns({"size_bytes": F.col("_s"), "input_ordinal": F.col("_o"), "input_sha256": F.col("_h"), "selector_counts": F.col("_c"), "confidence": F.col("_k"), "document": F.lit(0).cast("long")})
    names = [*KEYS, *(c for c in rows.columns if c not in ("source_file", "nr", *KEYS))]
    kinds = {f.name: f.dataType for f in kept.schema.fields}
    empty = about.where("o is not null or n = 0").select(*KEYS, "confidence", "selector_counts", F.coalesce("o.d", F.lit("applied")).alias("disposition"), F.col("o.r").alias("reason"), F.col("o.e").alias("error"), F.lit(False).alias("kept"), F.lit(0).cast("long").alias("document"))
    empty = empty.withColumns({c: F.lit(None).cast(kinds[c]) for c in names if c not in empty.columns})
    return Extraction(kept.select(*names).unionByName(empty.select(*names)), e.recipe, e.fields, list(KEYS))


def extract_records(spark: SparkSession, files: DataFrame | str | list[str], r: Recipe, parameters: dict[str, Any] | None = None, index: IX.Index | DataFrame | None = None, references: list[ReferenceTable] | None = None) -> Extraction:
    """Record by record, by byte ranges: one large file is dealt over all tasks. Dispositions are those of the document route.

    A given index is compared with the files first (``index.check_before_run``).
    """
    why = needs_document(r)
    if why:
        raise RecipeError(f"the recipe can't take records: {why}")
    files = _keyed(files if isinstance(files, DataFrame) else listed(spark, files))
    if r.format == "ndjson":
        return extract_lines(spark, files, r, parameters, references)
    name = record_name(r.selectors[0].xpath)
    if index is None:
        index = IX.build_index(files, name, r.format)
    elif isinstance(index, DataFrame):
        IX.check_before_run(index, files)
    records, problems = (index.records, index.files.where("problem is not null")) if isinstance(index, IX.Index) else (index, None)
    if r.format == "json" and not r.selectors[0].xpath.strip().startswith("//"):
        records = records.where("depth = 1")
    docs = IX.read_ranges(records, documents=r.format == "xml").select("source_file", F.col("record_num").alias("nr"), "content")
    selector = "/*"
    if r.format == "json":
        docs = docs.withColumn("content", F.concat(F.lit(b"{" + json.dumps(name).encode() + b":"), F.col("content"), F.lit(b"}")))
        selector = f"/{name}"
    e = extract(docs, replace(r, selectors=[Selector(selector)], match_scope="document"), parameters, references, settle=False)
    rows = written(e.rows.withColumn("record_num", F.when(F.col("record_num").isNotNull(), F.col("nr"))), "extracted")
    return _by_file(replace(e, rows=rows, recipe=e.recipe), files, r, problems)


def extract_lines(spark: SparkSession, files: DataFrame | str | list[str], r: Recipe, parameters: dict[str, Any] | None = None, references: list[ReferenceTable] | None = None, split: int | None = None) -> Extraction:
    """NDJSON files by lines: files are split, a task reads whole splits. A bad line fails its file.

    ``split`` bytes are a split in place of the session's; tasks don't grow in number with small ones (``LINES``). Records are numbered and errors placed by counts of each split: the driver sees none of them, and content isn't shuffled.
    """
    files = _keyed(files if isinstance(files, DataFrame) else listed(spark, files))
    names = files if "file" in files.columns else files.join(listed(spark, [x["source_file"] for x in files.select("source_file").collect()]).select("source_file", "file"), "source_file")
    many = names.count()
    paths = [x["source_file"] for x in names.select("source_file").toLocalIterator()]
    own = replace(r, selectors=[Selector(x.xpath) for x in r.selectors])  # floors hold for files
    if not paths:
        return _by_file(_numbered_lines(extract(spark.createDataFrame([], "file string, block long, content string"), own, parameters, references, settle=False), names, many), files, r, None)
    tasks = max(spark.sparkContext.defaultParallelism * 4, (names.agg(F.sum("size_bytes")).first()[0] or 0) // LINES)
    e = extract(read_lines(spark, paths, tasks), own, parameters, references, settle=False, run_on=["file", "block"])
    session = spark.conf.get(SPLIT)
    spark.conf.set(SPLIT, split or session)
    try:
        rows = written(e.rows, "extracted")
    finally:
        spark.conf.set(SPLIT, session)
    return _by_file(_numbered_lines(replace(e, rows=rows), names, many), files, r, None)


def _numbered_lines(e: Extraction, names: DataFrame, many: int) -> Extraction:
    """Rows numbered over their files: ``record_num`` over selectors and splits, ``nr`` the line."""
    from pyspark.sql import Window

    last = Window.unboundedPreceding, -1
    lines = e.rows.groupBy("file", "block").agg(F.min("document").alias("first"), (F.max("document") - F.min("document") + 1).alias("n"))
    lines = lines.withColumn("lines", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(*last)), F.lit(0))).select("file", "block", "first", "lines")
    counts = e.rows.where("record_num is not null").groupBy("file", "selector", "block").agg(F.max("record_num").alias("n"))
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("selector", "block").rowsBetween(*last)), F.lit(0))).select("file", "selector", "block", "base")
    splits = lines.join(counts.groupBy("file", "block").agg(F.map_from_entries(F.collect_list(F.struct("selector", "base"))).alias("bases")), ["file", "block"], "left").join(names.select("file", "source_file"), "file")
    splits = written(splits, "splits")
    at = _small(splits, splits.count())
    rows = e.rows.join(at, ["file", "block"]).withColumns({"nr": F.col("document") - F.col("first") + F.col("lines") + 1, "record_num": F.col("record_num") + F.col("bases")[F.col("selector")]})
    return replace(e, rows=rows.select("source_file", "nr", *(c for c in rows.columns if c not in ("file", "block", "first", "lines", "bases", "source_file", "nr"))))


def extract_native(spark: SparkSession, files: DataFrame | str | list[str], r: Recipe, parameters: dict[str, Any] | None = None, references: list[ReferenceTable] | None = None) -> Extraction:
    """Recipes that Columns can say (``native.compile_recipe``) by Spark's own record reader: no Python on the data; a file is one task.

    Records and outcomes by file are those of the other routes, but faults of a file outside its records aren't seen, and the
    text of an element that holds elements isn't refused where only the data shows it.
    """
    files = _keyed(files if isinstance(files, DataFrame) else listed(spark, files))
    names = files if "file" in files.columns else files.join(listed(spark, [x["source_file"] for x in files.select("source_file").collect()]).select("source_file", "file"), "source_file")
    paths = [x["source_file"] for x in names.select("source_file").toLocalIterator()]
    own = replace(r, selectors=[Selector(x.xpath) for x in r.selectors])
    e = extract(scan_native(spark, paths, own), own, parameters, references, settle=False, scanned=True)
    rows = written(e.rows, "extracted")
    first = rows.groupBy("file", "block").agg(F.min("document").alias("_first"))
    rows = rows.join(_small(first, first.count()), ["file", "block"]).withColumn("record_num", F.when(F.col("record_num").isNotNull(), F.col("document") - F.col("_first") + 1)).drop("_first")
    return _by_file(_numbered_lines(replace(e, rows=rows), names, names.count()), files, r, None)


def extract_files(spark: SparkSession, paths: str | list[str] | DataFrame, r: Recipe, parameters: dict[str, Any] | None = None, references: list[ReferenceTable] | None = None) -> Extraction:
    """Files (paths, or documents with the columns of ``read_files``), each by the route that its size and the recipe ask for.

    A file that is too large for the document route, of a recipe that can't take its records, has failed: ``route_unsupported``.
    """
    documents = paths if isinstance(paths, DataFrame) else read_files(spark, paths)
    large = F.col("size_bytes") * F.when(F.lower("source_file").endswith(".gz"), 10).otherwise(1) > LARGE
    sizes = documents.select("source_file", "size_bytes", "input_ordinal")
    if r.format == "ndjson":
        faulty = documents.where("input_problem is not null") if "input_problem" in documents.columns else None
        sound = sizes if faulty is None else documents.where("input_problem is null").select("source_file", "size_bytes", "input_ordinal")
        e = extract_lines(spark, sound, r, parameters, references)
        return e if faulty is None else _unavailable(e, faulty)
    big = sizes.where(large).collect()  # a few files of over 100 MiB: names and sizes
    rest = documents.where(~F.coalesce(large, F.lit(False))) if big else documents
    if big and not isinstance(paths, DataFrame):
        rest = rest.where(F.col("size_bytes") <= LARGE)  # the file source takes this one: the contents of large files aren't read
    problem = "input_problem" in documents.columns
    e = extract(rest.drop("input_problem"), r, parameters, references)
    why = needs_document(r)
    refused = [x for x in big if why or x["source_file"].lower().endswith(IX.COMPRESSED)]
    taken = [x for x in big if x not in refused]
    schema = "source_file string, size_bytes long, input_ordinal long"
    if taken:
        other = extract_records(spark, spark.createDataFrame(taken, schema), r, parameters, None, references)
        e = replace(e, rows=e.rows.unionByName(other.rows))
    if refused:
        e = _refused(e, spark.createDataFrame([(*x, why or "a compressed file can't be cut into records") for x in refused], schema + ", why string"))
    return _unavailable(e, documents.where("input_problem is not null")) if problem else e


def _refused(e: Extraction, files: DataFrame) -> Extraction:
    row = _keyed_failure(files, e, "route_unsupported", F.concat(F.lit("it is too large for the document route, and its records can't be taken: "), F.col("why")))
    return replace(e, rows=e.rows.unionByName(row))


def _unavailable(e: Extraction, files: DataFrame) -> Extraction:
    """Inputs that are missing or not as declared, in place of the rows that the scan gave for them."""
    bad = files.select("source_file", "size_bytes", "input_ordinal", "input_problem")
    rows = e.rows.join(bad.select(F.col("source_file").alias("_bad"), F.col("input_ordinal").alias("_nr")), (F.col("source_file") == F.col("_bad")) & F.col("input_ordinal").eqNullSafe(F.col("_nr")), "left_anti")
    return replace(e, rows=rows.unionByName(_keyed_failure(bad, e, "input_unavailable", F.col("input_problem"))))


def _keyed_failure(files: DataFrame, e: Extraction, reason: str, error) -> DataFrame:
    row = files.withColumns({"disposition": F.lit("failed"), "reason": F.lit(reason), "error": error, "kept": F.lit(False), "document": F.lit(-1).cast("long")})
    given = set(row.columns)
    return row.select(*(F.col(f"`{f.name}`") if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in e.rows.schema.fields))
