"""Extraction: a recipe over documents, as one DataFrame plan.

Scan (Python, Arrow) -> transforms and expressions -> parameters and source fields -> filters -> schema checks ->
validation and summaries. A bad record fails its input: its rows are dropped by the disposition of their document. The scan
does that for its own errors; where a recipe has errors of Columns (expressions, schemas, rules) or floors, a pass over the
rows does, without a shuffle, since a document's rows lie beside each other. Other documents go on. An input is a row of the
documents, whatever its key: of two inputs with one key a bad one fails alone.

Reasons are the closed set ``REASONS``: errors of the scan come before those of Columns, floors last; of equal ones the
first record counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import expressions as X
from lodestone.functions.expressions import Scope, Typed, compile_node, first_error, parse
from lodestone.functions.transforms import apply_transform
from lodestone.operators import validation as V
from lodestone.sources import reference as R
from lodestone.sources.scan import checked_fields, scan, scan_many

from .recipe import Mapping, Recipe, RecipeError
from .staging import fresh_path, written


REASONS = ("applicability_predicate_false", "signature_mismatch", "min_occurrences_violation", "parse_error", "validation_error", "internal_error", "route_unsupported", "input_unavailable")


@dataclass
class Extraction:
    """``rows``: all rows of the scan with data, validation, summary, disposition and error; see the properties."""

    rows: DataFrame
    recipe: Recipe
    fields: list[str]
    keys: list[str]

    @property
    def records(self) -> DataFrame:
        """Records of applied documents that pass the filters."""
        return self.rows.where("disposition = 'applied' and kept")

    @property
    def data(self) -> DataFrame:
        """The records' own columns, with those of their document and their number."""
        return self.records.select(*(F.col(f"`{k}`") for k in self.keys), "record_num", "selector", *(F.col(f"data.`{f}`").alias(f) for f in self.fields))

    @property
    def dispositions(self) -> DataFrame:
        """One row per document: disposition, reason, error, records, confidence."""
        return self.rows.groupBy(*(F.col(f"`{k}`") for k in self.keys), "document").agg(
            F.min("disposition").alias("disposition"), F.min("reason").alias("reason"), F.min("error").alias("error"),
            F.sum(F.when((F.col("disposition") == "applied") & F.col("kept"), 1).otherwise(0)).alias("records"), F.min("confidence").alias("confidence"),
        ).drop("document")


def converted(t: Typed, kind: str) -> tuple[Column, Column | None]:
    """An expression's value as a field of a type."""
    if kind == "string":
        return F.regexp_replace(X.as_text(t), f"^{X.WHITE}+|{X.WHITE}+$", ""), t.error
    if kind == "boolean":
        if t.kind == "string":
            return ~F.lower(F.trim(t.value)).isin("", "0", "false", "no", "off"), t.error
        return F.coalesce(t.value.cast("boolean"), F.lit(False)), t.error
    to = "double" if kind == "number" else "long"
    if t.kind == "string":
        s = F.nullif(F.trim(t.value), F.lit(""))
        v = s.try_cast("double")
        bad = F.when(s.isNotNull() & v.isNull(), F.concat(F.lit(f"failed to parse {kind}: "), s))
        return (v if kind == "number" else F.when(s.contains("."), v.try_cast("long")).otherwise(s.try_cast("long"))), first_error(t.error, bad)
    return t.value.try_cast(to), t.error


def _source_fields(r: Recipe) -> tuple[dict[str, Column], set[str], Column | None]:
    """Named groups of patterns over the input's name; later patterns win. Internal ones and an error for missing ones."""
    out: dict[str, Column] = {}
    internal: set[str] = set()
    for p in r.source_extraction:
        pattern = str(p["pattern"])
        names = re.findall(r"\(\?P?<(\w+)>", pattern)
        java = re.sub(r"\(\?P<", "(?<", pattern)
        source = {"filename": F.element_at(F.split("source_file", "/"), -1), "absolute_path": F.regexp_replace("source_file", r"^file:/+", "/")}.get(str(p.get("source")), F.col("source_file"))
        order = [m for m in re.finditer(r"\((?!\?(?!P?<\w))", pattern) if not _escaped(pattern, m.start())]
        for name in names:
            k = next(j for j, m in enumerate(order, 1) if re.match(rf"\(\?P?<{name}>", pattern[m.start() :]))
            v = F.nullif(F.regexp_extract(source, java, k), F.lit(""))
            out[name] = F.coalesce(v, out[name]) if name in out else v
            if p.get("internal"):
                internal.add(name)
    lost = [F.when(out[n].isNull(), F.lit(f"source extraction found no {n}")) if n in out else F.lit(f"source extraction found no {n}") for n in r.source_required]
    return out, internal, first_error(*lost)


def _escaped(text: str, at: int) -> bool:
    return (len(text[:at]) - len(text[:at].rstrip("\\"))) % 2 == 1


def schema_error(schema: dict[str, Any], columns: dict[str, T.DataType], of) -> Column | None:
    """The first violation of an object schema by a record: required, type, enum, const, pattern, lengths, bounds, items."""
    checks: list[Column] = []
    for name in schema.get("required") or ():
        checks.append(F.when(of(name).isNull(), F.lit(f"{name} is required")) if name in columns else F.lit(f"{name} is required"))
    for name, rule in (schema.get("properties") or {}).items():
        if name in columns and isinstance(rule, dict):
            checks += [F.when(of(name).isNotNull() & bad, F.lit(f"{name}: {what}")) for bad, what in _violations(rule, of(name), columns[name])]
    if schema.get("additionalProperties") is False:
        checks += [F.when(of(n).isNotNull(), F.lit(f"{n} isn't allowed")) for n in columns if n not in (schema.get("properties") or {})]
    return first_error(*checks)


def _violations(rule: dict, c: Column, t: T.DataType) -> list[tuple[Column, str]]:
    kinds = rule.get("type")
    kinds = [kinds] if isinstance(kinds, str) else list(kinds or ())
    own = {"string": ("string",), "boolean": ("boolean",), "number": ("number",), "integer": ("integer", "number"), "strings": ("array",), "other": ("array", "object")}[V.kind_of(t)]
    out: list[tuple[Column, str]] = []
    if kinds and not set(kinds) & set(own):
        whole = "integer" in kinds and V.kind_of(t) == "number"
        out.append((c != F.floor(c) if whole else F.lit(True), f"must be {' or '.join(kinds)}"))
    if "enum" in rule:
        out.append((~c.isin([v for v in rule["enum"] if v is not None]), "isn't one of the allowed values"))
    if "const" in rule:
        out.append((c != F.lit(rule["const"]), "isn't the required value"))
    if V.kind_of(t) == "string":
        if "pattern" in rule:
            out.append((~c.rlike(rule["pattern"]), "doesn't match the pattern"))
        if "minLength" in rule:
            out.append((F.char_length(c) < rule["minLength"], "is too short"))
        if "maxLength" in rule:
            out.append((F.char_length(c) > rule["maxLength"], "is too long"))
    if V.kind_of(t) in ("number", "integer"):
        for k, bad in (("minimum", lambda v: c < v), ("maximum", lambda v: c > v), ("exclusiveMinimum", lambda v: c <= v), ("exclusiveMaximum", lambda v: c >= v)):
            if k in rule:
                out.append((bad(rule[k]), f"breaks {k}"))
    if isinstance(t, T.ArrayType):
        if "minItems" in rule:
            out.append((F.size(c) < rule["minItems"], "has too few items"))
        if "maxItems" in rule:
            out.append((F.size(c) > rule["maxItems"], "has too many items"))
        if isinstance(rule.get("items"), dict) and isinstance(t.elementType, T.StructType):
            types = {f.name: f.dataType for f in t.elementType.fields}
            inner = schema_error(rule["items"], types, lambda n: F.col("_"))
            if inner is not None:
                out.append((F.exists(c, lambda x: schema_error(rule["items"], types, lambda n: x[n]).isNotNull()), "has a bad item"))
    return out


def _nan(t: T.DataType, c: Column) -> Column | None:
    """Whether a value holds a NaN or an infinity, which JSON can't."""
    if isinstance(t, T.DoubleType):
        return F.isnan(c) | (F.abs(c) == float("inf"))
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType) and any(_nan(f.dataType, F.col("_")) is not None for f in t.elementType.fields):
        return F.exists(c, lambda x: reduce(lambda a, b: a | b, [F.coalesce(_nan(f.dataType, x[f.name]), F.lit(False)) for f in t.elementType.fields if _nan(f.dataType, x[f.name]) is not None]))
    return None


def extract(docs: DataFrame, recipe: Recipe, parameters: dict[str, Any] | None = None, references: list[R.ReferenceTable] | None = None, content: str = "content", settle: bool = True, run_on: list[str] | None = None, scanned: bool = False) -> Extraction:
    """Applies a recipe to documents (a text or binary column; all other columns go with the document's rows).

    An empty table of documents gives no records. Without ``settle`` each row tells its own error only;
    ``run_on`` is the scan's. ``scanned`` documents are rows of the recipe's scan that a table holds.
    """
    r = recipe.with_parameters(parameters or {})
    own = {"record_num", "selector", "confidence", "selector_counts", "disposition", "reason", "error", "late", "document", "fields"}
    keys = [c for c in docs.columns if c != content and not (scanned and c in own)]
    clash = set(keys) & {"record_num", "selector", "fields", "data", "disposition", "reason", "error", "confidence", "selector_counts", "kept", "late", "document"}
    if clash:
        raise RecipeError(f"columns of the documents have reserved names: {sorted(clash)}")
    df = docs if scanned else scan(docs, r, content, run_on)
    live = F.col("fields").isNotNull()
    errors: list[Column] = []
    invalid: list[Column] = []
    columns: dict[str, T.DataType] = {}
    scope = Scope()
    adds: dict[str, Column] = {}
    for m in r.mappings:
        if m.xpath:
            c = F.col(f"fields.`{m.name}`")
            adds[f"_f_{m.name}"] = apply_transform(c, m.transform, dict(m.params)) if m.transform and m.transform != "exists" else c
    df = df.withColumns(adds) if adds else df
    for m in r.mappings:
        if m.xpath:
            scope.variables[m.name] = Typed(F.col(f"`_f_{m.name}`"), V.kind_of(m.spark_type()))
            columns[m.name] = m.spark_type()
    source, internal, lost = _source_fields(r)
    if lost is not None:
        invalid.append(F.when(F.col("disposition") == "applied", lost))
    external: dict[str, tuple[Column, T.DataType]] = {k: (F.array(*(F.lit(x) for x in v)) if isinstance(v, list) else F.lit(str(v)), T.ArrayType(T.StringType()) if isinstance(v, list) else T.StringType()) for k, v in r.parameters.items()}
    external |= {k: (c, T.StringType()) for k, c in source.items()}
    for k, (c, t) in external.items():
        if k in columns:
            raise RecipeError(f"{k!r} is a field and a parameter or source field")
        df = df.withColumn(f"_f_{k}", c)
        scope.variables[k] = Typed(F.col(f"`_f_{k}`"), V.kind_of(t), literal=r.parameters.get(k) if isinstance(r.parameters.get(k), list) else None)
    tables = {t.name: t for t in references or ()}
    for m in r.mappings:
        if m.expression:
            df = _expression(df, m, scope, tables, errors, live)
            scope.variables[m.name] = Typed(F.col(f"`_f_{m.name}`"), V.kind_of(m.spark_type()))
            columns[m.name] = m.spark_type()
    public = {m.name: m.spark_type() for m in r.public()}
    public |= {k: t for k, (_, t) in external.items() if k not in internal and k not in r.parameters_internal}
    kept = live
    for name, condition in r.filters.items():
        if name in public and isinstance(condition, str) and condition.startswith("> ") and isinstance(public[name], T.StringType):
            kept = kept & F.coalesce(F.col(f"`_f_{name}`") > F.lit(condition[2:]), F.lit(True))
    df = df.withColumn("kept", F.coalesce(kept, F.lit(False)))
    of = lambda n: F.col(f"`_f_{n}`")
    bad = schema_error(r.output_schema, public, of) if r.output_schema else None
    if bad is not None:
        invalid.append(F.when(F.col("kept"), bad))
    done_in_scan = {m.name for m in checked_fields(r)}
    for n, t in public.items():
        nan = _nan(t, of(n)) if n not in done_in_scan else None
        if nan is not None:
            errors.append(F.when(F.col("kept") & nan, F.lit(f"{n}: NaN isn't a value")))
    df = df.withColumn("data", F.when(live, F.struct(*(of(n).alias(n) for n in public)))) if public else df.withColumn("data", F.lit(None).cast("struct<_:string>"))
    record = T.StructType([T.StructField(n, t) for n, t in public.items()])
    summary_scope = scope
    extra = ["data"]
    if r.validation and r.validation.get("enable"):
        flat = df.withColumns({n: of(n) for n in public})
        named = Scope({n: Typed(F.col(f"`{n}`"), V.kind_of(t)) for n, t in public.items()})
        later = {n for s in r.summaries for e in [s.get("total") or {}, *(s.get("components") or ())] if e.get("expression") for n in X.names(parse(str(e["expression"])))}
        done = V.validate(flat, record, named, r.validation, later)
        q = V.quality(F.col(done.results))
        done.errors.append(V.policy_error(q, r.validation.get("failure_policy") or {}))
        report = F.struct(
            F.lit(str(r.validation.get("expression_language") or "dsl")).alias("expression_language"),
            F.lit(str(r.validation.get("placement") or "").strip() or "footer").alias("placement"),
            F.lit(str(r.validation.get("array_path") or "")).alias("array_path"),
            done.record_count.alias("record_count"),
            _struct({k: F.col(f"`{c}`") for k, c in done.accumulations.items()}).alias("accumulations"),
            _struct({k: F.col(f"`{c}`") for k, c in done.aggregations.items()}).alias("aggregations"),
            (F.array(*(F.col(f"`{c}`") for c in done.reconciliations)) if done.reconciliations else F.array().cast("array<struct<name:string>>")).alias("reconciliations"),
            F.col(done.results).alias("validations"),
            q.alias("quality_summary"),
        )
        df = done.df.withColumn("validation", F.when(F.col("kept"), report))
        invalid += [F.when(F.col("kept"), e) for e in done.errors]
        summary_scope = Scope(done.scope)
        extra.append("validation")
    if r.summaries:
        made, bad_sums = V.summaries(r.summaries, summary_scope)
        df = df.withColumn("summary", F.when(F.col("kept"), F.struct(*(c.alias(k) for k, c in made.items()))))
        errors += [F.when(F.col("kept"), e) for e in bad_sums]
        extra.append("summary")
    none = F.lit(None).cast("string")
    if errors or invalid or any(x.min_occurrences for x in r.selectors):
        df = df.withColumns({"_internal": F.coalesce(*errors, none), "_invalid": F.coalesce(*invalid, none)})
        df = df.withColumn("_class", F.when(F.col("error").isNotNull(), 0).when(F.col("_internal").isNotNull() | F.col("_invalid").isNotNull(), 1).when(F.col("late").isNotNull(), 2))
        df = df.withColumn("reason", F.when(F.col("_class") == 1, F.when(F.col("_internal").isNotNull(), "internal_error").otherwise("validation_error")).when(F.col("_class") == 2, "min_occurrences_violation").otherwise(F.col("reason")))
        df = df.withColumn("error", F.coalesce("error", "_internal", "_invalid", "late"))
    else:  # the scan alone can fail a document, and it gives such a document one row: nothing is to be told to its other rows
        df, settle = df.withColumn("_class", F.when(F.col("error").isNotNull(), 0)), False
    df = df.withColumn("disposition", F.when(F.col("_class").isNotNull(), "failed").otherwise(F.col("disposition")))
    df = df.select(*(F.col(f"`{k}`") for k in keys), "record_num", "selector", "confidence", "selector_counts", "disposition", "reason", "error", "kept", "document", "_class", *extra)
    if settle:
        used = {str(c.args[0].value) for m in r.mappings if m.expression for c in _probes(parse(m.expression))}
        df = _settled_table(df) if scanned else _settled(df) if all(tables[n].rows <= R.BROADCAST_ROWS for n in used) else _settled_apart(df)
    return Extraction(df, r, list(public), keys)


def _packed(b: pa.RecordBatch) -> pa.RecordBatch:
    """A copy that holds nothing of its message, equal texts once: a large document's rows wait for its last one."""
    b = b.take(pa.array(np.arange(b.num_rows)))
    return pa.RecordBatch.from_arrays([c.dictionary_encode() if pa.types.is_string(c.type) else c for c in b.columns], b.schema.names)


def _unpacked(b: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in b.columns], schema=schema)


def _settled(df: DataFrame) -> DataFrame:
    """One row of each document that has an error, all rows of the others: documents are runs of rows, nothing is shuffled."""
    doc_at, class_at = df.columns.index("document"), df.columns.index("_class")

    def whole(held: list[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        if all(b.column(class_at).null_count == b.num_rows for b in held):
            yield from held
            return
        doc = np.concatenate([b.column(doc_at).to_numpy() for b in held])
        level = np.concatenate([b.column(class_at).fill_null(9).to_numpy() for b in held]).astype(np.int64)
        order = np.lexsort((np.arange(len(doc)), level, doc))
        first = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
        bad = first[level[first] < 9]
        keep = ~np.isin(doc, doc[bad])
        keep[bad] = True
        at = 0
        for b in held:
            if keep[at : at + b.num_rows].any():
                yield b.filter(pa.array(keep[at : at + b.num_rows]))
            at += b.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        schema = None
        for b in batches:
            if not b.num_rows:
                continue
            schema = b.schema
            doc = b.column(doc_at).to_numpy()
            if held and held[-1].column(doc_at)[-1].as_py() != doc[0]:
                yield from (_unpacked(x, schema) for x in whole(held))
                held = []
            last = int(np.searchsorted(doc, doc[-1]))  # documents are numbered in the order of their rows
            if last:
                yield from (_unpacked(x, schema) for x in whole([*held, b.slice(0, last)]))
                held = []
            held.append(_packed(b.slice(last)))
        if held:
            yield from (_unpacked(x, schema) for x in whole(held))

    return df.mapInArrow(run, df.schema)


def _settled_table(df: DataFrame) -> DataFrame:
    """The same for rows that a table holds: documents with an error are gathered first, and prune the rows."""
    order = F.struct(F.col("_class").alias("c"), F.coalesce("record_num", F.lit(0)).alias("r"))
    bad = written(df.where("_class is not null").groupBy("document").agg(F.min(order).alias("_first")).withColumnRenamed("document", "_bad"), "failed")
    few = bad.count() <= R.BROADCAST_ROWS
    df = df.join(F.broadcast(bad) if few else bad, F.col("document") == F.col("_bad"), "left")
    return df.where(F.col("_bad").isNull() | (F.col("_class").isNotNull() & (order == F.col("_first")))).drop("_bad", "_first")


def _settled_apart(df: DataFrame) -> DataFrame:
    """The same where a join with a large reference table has parted a document's rows."""
    order = F.struct(F.col("_class").isNull().alias("n"), F.col("_class").alias("c"), F.coalesce("record_num", F.lit(0)).alias("r"))
    df = df.withColumn("_first", F.min(order).over(Window.partitionBy("document")))
    return df.where(F.col("_first.n") | (order == F.col("_first"))).drop("_first")


def _struct(cols: dict[str, Column]) -> Column:
    return F.struct(*(c.alias(k) for k, c in cols.items())) if cols else F.lit(None).cast("struct<_:string>")


def _expression(df: DataFrame, m: Mapping, scope: Scope, tables: dict[str, R.ReferenceTable], errors: list[Column], live: Column) -> DataFrame:
    """Adds an expression field; reference probes become joins before it."""
    node = parse(m.expression)
    for j, call in enumerate(_probes(node)):
        name = str(call.args[0].value)
        if name not in tables:
            raise RecipeError(f"{m.name}: unknown reference table {name!r}")
        key = compile_node(call.args[1], scope)
        col = f"_ref_{m.name}_{j}"
        df = R.probe(df, tables[name], X.as_text(key) if key.kind != "null" else F.lit(None).cast("string"), col)
        scope.variables[col] = Typed(F.col(f"`{col}`"), "other")
    order = iter([F.col(f"`_ref_{m.name}_{j}`") for j in range(len(_probes(node)))])

    def look(_: str, __: Column) -> tuple[Column, Column]:
        c = next(order)
        return c["hit"], c["v"]

    t = compile_node(node, Scope(scope.variables, dict.fromkeys(tables, look)))
    value, error = converted(t, m.type)
    if error is not None:
        df = df.withColumn(f"_e_{m.name}", F.when(live, error))
        errors.append(F.col(f"`_e_{m.name}`"))
        value = F.when(F.col(f"`_e_{m.name}`").isNull(), value)
    return df.withColumn(f"_f_{m.name}", F.when(live, value))


def _probes(node: X.Node) -> list[X.Node]:
    """The reference calls of an expression in the order in which they are compiled."""
    own = [node] if node.kind == "call" and node.value in ("in_reference", "lookup_reference") else []
    inner = [p for a in node.args for p in _probes(a)]
    # a call compiles its probe before itself; the default of a lookup after it
    if own and node.value == "lookup_reference":
        return [*_probes(node.args[1]), node, *_probes(node.args[2])]
    return [*inner, *own]


def extract_many(docs: DataFrame, recipes: list[Recipe], parameters: dict[str, Any] | None = None, references: list[R.ReferenceTable] | None = None, content: str = "content") -> dict[str, Extraction]:
    """Several recipes over the same documents, by recipe id or record type: each document is read and parsed once.

    One scan gives the rows of all recipes, which are staged by recipe in the shared folder; dispositions are by recipe and
    document. A document that fails under one recipe may be applied under another.
    """
    names = [r.id or r.record_type for r in recipes]
    if len(set(names)) < len(names):
        raise RecipeError(f"recipes need names of their own: {names}")
    if not recipes:
        return {}
    ready = [r.with_parameters({k: v for k, v in (parameters or {}).items()}) for r in recipes]
    path = fresh_path(docs.sparkSession, "scanned")
    rows = scan_many(docs, ready, content)
    rows.write.partitionBy("recipe").parquet(path)
    staged = docs.sparkSession.read.schema(rows.schema).parquet(path)
    shared = [c for c in rows.columns if c != "recipe" and not c.startswith("fields_")]
    return {n: extract(staged.where(F.col("recipe") == k).select(*(F.col(f"`{c}`") for c in shared), F.col(f"fields_{k}").alias("fields")), r, None, references, scanned=True) for k, (n, r) in enumerate(zip(names, ready, strict=True))}


def envelope(e: Extraction, meta: dict[str, Any] | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """Records as JSON envelopes (``value``), with the document's columns, record_num and ``more`` columns.

    Absent top-level fields are left out; items of arrays keep explicit nulls, but those of polymorphic ones don't. With a
    uniform schema all fields are there.
    """
    r = e.recipe
    polymorphic = {m.name for m in r.mappings if m.variants}
    arrays = {m.name for m in r.mappings if m.items}

    def part(name: str) -> Column:
        c = F.col(f"data.`{name}`")
        text = F.to_json(c if name in arrays or name in polymorphic else F.struct(c.alias("v")), {"ignoreNullFields": str(name not in arrays).lower()})
        if name in arrays or name in polymorphic:
            body = F.concat(F.lit(f'"{name}":'), text)
        else:
            body = F.concat(F.lit(f'"{name}":'), F.regexp_extract(text, r'^\{"v":(?s)(.*)\}$', 1))
        return F.when(c.isNotNull(), body).otherwise(F.lit(f'"{name}":null') if r.uniform_schema else F.lit(None).cast("string"))

    data = F.concat(F.lit("{"), F.concat_ws(",", *(part(n) for n in sorted(e.fields))), F.lit("}"))
    runtime = F.struct(F.lit(r.record_type).alias("record_type"), F.col("record_num"), *(F.lit(v).alias(k) for k, v in (meta or {}).items()), *(F.col(f"`{k}`").alias(k) for k in e.keys if k in ("source_file", "input_ordinal", "input_sha256")), F.lit(bool(r.summaries)).alias("summaries_included"), F.lit("validation" in e.rows.columns).alias("validation_included"))
    parts = [F.concat(F.lit('"_runtime":'), F.to_json(runtime))]
    if "validation" in e.rows.columns:
        parts.append(F.concat(F.lit('"_validation":'), F.to_json("validation")))
    inner = [F.concat(F.lit('"data":'), data)]
    if "summary" in e.rows.columns:
        inner.append(F.concat(F.lit('"summary":'), F.to_json("summary")))
    parts.append(F.concat(F.lit('"extract":{'), F.concat_ws(",", *inner), F.lit("}")))
    return e.records.select(*(F.col(f"`{k}`") for k in e.keys), "record_num", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"), *(c.alias(n) for n, c in (more or {}).items()))


def run_workspace(spark: SparkSession, path: str, inputs: str | list[str] | DataFrame, parameters: dict[str, Any] | None = None) -> Extraction:
    """The recipe of a workspace over files (paths, or documents of a file list), each by the route that its size asks for."""
    from .recipe import load_workspace
    from .routes import extract_files

    r = load_workspace(path)
    return extract_files(spark, inputs, r, parameters, [R.load(spark, d, path) for d in r.reference_tables])
