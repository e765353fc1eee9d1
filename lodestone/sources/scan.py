"""Document scan: one row per record of each document, with typed fields.

The only Python in an extraction: trees are built and XPath is evaluated on Arrow batches. Errors are data; a document with
an error gives one row that tells it. Whole files come through Spark's ``binaryFile`` source, line-delimited ones too (a
bad line fails its file); rendered documents come as a column.
"""

from __future__ import annotations

import gzip
import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.plans.recipe import Mapping, Recipe, record_name

from . import doctree, elements, values
from .doctree import DocumentError, Node
from .xpath import XPathError, compile_xpath, to_boolean

GZIP_LIMIT = 1 << 30
#: Bytes from which a document's records are read one after another, without its tree, where the recipe allows.
STREAMED = 4 << 20
#: Names of files that are numbered in one task and broadcast (about 50 MB); more are numbered by ranges and joined by a shuffle.
NAMES = 500_000


class FieldError(ValueError):
    """A value that can't be converted."""


def _text(v: Any, fmt: str) -> Any:
    """What an XPath gives to a field: None where absent, else a bool, a float or trimmed text."""
    if isinstance(v, list):
        if not v or (fmt != "xml" and v[0].scalar == "null"):
            return None
        return v[0].text().strip()
    return v.strip() if isinstance(v, str) else v


def number_text(v: float) -> str:
    """A number as decimal text without an exponent."""
    if v == math.floor(v) and abs(v) < 1e21:
        return str(int(v))
    text = repr(v)
    return format(v, "f") if "e" in text else text


def coerce(v: Any, kind: str, name: str) -> Any:
    """A field's value by its type; absent booleans are false, other absent values stay absent."""
    if kind == "boolean":
        if isinstance(v, str):
            return v.strip().lower() not in ("", "0", "false", "no", "off")
        return bool(v) if v is not None else False
    if v is None:
        return None
    if kind == "string":
        return v.strip() if isinstance(v, str) else ("true" if v else "false") if isinstance(v, bool) else number_text(v)
    if isinstance(v, str):
        v = v.strip()
        if not v:
            return None
        try:
            if kind == "number":
                return float(v.replace("_", "x"))
            return int(float(v)) if "." in v else int(v.replace("_", "x"))
        except (ValueError, OverflowError):
            raise FieldError(f"{name}: failed to parse {kind} {v!r}") from None
    if kind == "number":
        return float(v)
    if isinstance(v, float) and not math.isfinite(v):
        raise FieldError(f"{name}: {v} isn't an integer")
    return int(v)


PLAIN = re.compile(r"(?:@[^\W\d][\w.\-]*|[^\W\d][\w.\-]*(?:/[^\W\d][\w.\-]*)*(?:/@[^\W\d][\w.\-]*)?)\Z")


class PlainPath:
    """A path of unprefixed child steps with an attribute at its end at most: the common case, without the evaluator."""

    def __init__(self, text: str) -> None:
        *self.steps, last = text.split("/")
        self.attribute = last[1:] if last.startswith("@") else None
        if self.attribute is None:
            self.steps.append(last)

    def nodes(self, node: Node) -> list[Node]:
        now = [node]
        for name in self.steps:
            now = [c for n in now for c in n.children if c.kind == "element" and c.name == name and not c.prefix]
        if self.attribute is not None:
            now = [a for n in now for a in n.attrs if a.name == self.attribute and not a.prefix]
        return now

    evaluate = nodes


class Extractor:
    """Evaluates a recipe's selectors and XPath mappings; built once per task."""

    def __init__(self, recipe: Recipe) -> None:
        self.r, self.ns = recipe, recipe.namespaces
        self.compiled: dict[str, Any] = {}
        self.finite = [m.name for m in checked_fields(recipe)]
        self.plain = self._plain()
        self.values = self._values()

    def _plain(self) -> tuple[list, list] | None:
        """Selectors and fields over elements that are built without Python, where the recipe asks for nothing beyond them."""
        r = self.r
        if r.format != "xml" or r.match_scope != "document" or r.applicability or (r.signature or {}).get("match_patterns"):
            return None
        try:
            return [elements.selector(compile_xpath(s.xpath, self.ns).tree) for s in r.selectors], [(m.name, self._plain_field(m)) for m in r.mappings if m.xpath]
        except elements.Outside:
            return None

    def _plain_field(self, m: Mapping) -> Callable[[Any], Any]:
        """:meth:`value` of a mapping as a function of an element."""
        c = elements.compiled(compile_xpath(m.xpath, self.ns).tree)
        every, first, kind, name = c.all, c.first, m.type, m.name
        if m.transform == "exists":
            return lambda e: coerce(len(every(e)) > 0 if c.nodes else to_boolean(every(e)), kind, name)
        if kind == "array":
            if not c.nodes or ((m.items or m.variants) and c.kind != "elements"):
                raise elements.Outside(name)
            if m.variants:
                return self._plain_variants(m, every)
            if m.items:
                items = [(f.name, self._plain_field(f)) for f in m.items]
                return lambda e: [{k: of(x) for k, of in items} for x in every(e)] or None
            text = elements.text_of if c.kind == "elements" else str
            return lambda e: [x for x in (text(n).strip() for n in every(e)) if x] or None
        if c.nodes:
            def value(e: Any) -> Any:
                v = first(e)
                return None if v is None else v.strip()
        elif c.kind == "string":
            value = lambda e: every(e).strip()
        else:
            value = every
        if m.transform:
            return lambda e: None if (v := value(e)) is None else v if isinstance(v, str) else number_text(v) if isinstance(v, float) else str(v).lower()
        return lambda e: coerce(value(e), kind, name)

    def _plain_variants(self, m: Mapping, every: Callable[[Any], list]) -> Callable[[Any], Any]:
        variants = []
        for v in m.variants:
            if v.element_type and not v.match_xpath:
                raise elements.Outside(m.name)
            to = elements.compiled(compile_xpath(v.match_xpath, self.ns).tree) if v.match_xpath else None
            if to is not None and to.kind != "elements":
                raise elements.Outside(m.name)
            variants.append((to.all if to else lambda n: [n], [(f.name, self._plain_field(f)) for f in v.fields], v.item_type))

        def run(e: Any) -> list | None:
            out = []
            for n in every(e):
                for targets, fields, item_type in variants:
                    for x in targets(n):
                        item = {k: y for k, of in fields if (y := of(x)) is not None}
                        if item_type:
                            item.setdefault("item_type", item_type)
                        if item:
                            out.append(item)
            return out or None

        return run

    def _values(self) -> tuple[list | None, list] | None:
        """Selectors (none where each line is a record) and fields over JSON values, where the recipe asks for nothing beyond them."""
        r = self.r
        if r.format == "xml" or (r.format == "json" and r.match_scope != "document") or r.applicability or (r.signature or {}).get("match_patterns"):
            return None
        try:
            return [values.selector(s.xpath) for s in r.selectors] if r.format == "json" else None, [(m.name, self._value_field(m)) for m in r.mappings if m.xpath]
        except values.Outside:
            return None

    def _value_field(self, m: Mapping) -> Callable[[Any], Any]:
        """:meth:`value` of a mapping as a function of a JSON value."""
        nodes, kind, name = values.path(m.xpath), m.type, m.name
        if m.transform == "exists":
            return lambda v: coerce(len(nodes(v)) > 0, kind, name)
        if kind == "array":
            if m.variants:
                raise values.Outside(name)
            if m.items:
                items = [(f.name, self._value_field(f)) for f in m.items]
                return lambda v: [{k: of(x) for k, of in items} for x in nodes(v)] or None
            return lambda v: [x for x in (values.text(n).strip() for n in nodes(v)) if x] or None

        def first(v: Any) -> str | None:
            found = nodes(v)
            return None if not found or found[0] is None else values.text(found[0]).strip()

        return first if m.transform else lambda v: coerce(first(v), kind, name)

    def _of_values(self, data: bytes) -> list[Iterable[dict]]:
        """The fields of each selector's records."""
        selectors, fields = self.values
        if selectors is None:
            lines = values.parsed_lines(data)
            return [({k: of(v) for k, of in fields} for v in lines) for _ in self.r.selectors]
        doc = values.parsed(data)
        return [({k: of(v) for k, of in fields} for v in select(doc)) for select in selectors]

    def xpath(self, text: str) -> Any:
        """The compiled expression, or a walk over children where it is a plain relative path."""
        p = self.compiled.get(text)
        if p is None:
            p = self.compiled[text] = PlainPath(text) if PLAIN.match(text) else compile_xpath(text, self.ns)
        return p

    def value(self, node: Node, m: Mapping) -> Any:
        p = self.xpath(m.xpath)
        if m.transform == "exists":
            v = p.evaluate(node)
            return coerce(len(v) > 0 if isinstance(v, list) else to_boolean(v), m.type, m.name)
        if m.type == "array":
            return self.array(p.nodes(node), m)
        v = _text(p.evaluate(node), self.r.format)
        if m.transform:
            return None if v is None else v if isinstance(v, str) else number_text(v) if isinstance(v, float) else str(v).lower()
        return coerce(v, m.type, m.name)

    def array(self, nodes: list[Node], m: Mapping) -> list | None:
        if m.variants:
            out = []
            for n in nodes:
                for v in m.variants:
                    for target in self._targets(n, v):
                        item = {f.name: self.value(target, f) for f in v.fields}
                        item = {k: x for k, x in item.items() if x is not None}
                        if v.item_type:
                            item.setdefault("item_type", v.item_type)
                        if item:
                            out.append(item)
            if not out and nodes and self.r.format != "xml" and any(v.element_type for v in m.variants):
                raise FieldError(f"{m.name}: no item matches a variant")
            return out or None
        if m.items:
            return [{f.name: self.value(n, f) for f in m.items} for n in nodes] or None
        return [x for x in (n.text().strip() for n in nodes) if x] or None

    def _targets(self, n: Node, v) -> list[Node]:
        if v.match_xpath:
            return self.xpath(v.match_xpath).nodes(n)
        if v.element_type:
            want = v.element_type.lower()
            return [x for x in ([n] if n.name.lower() == want else []) + [c for c in n.elements() if c.name.lower() == want]]
        return [n]

    def confidence(self, doc: Node) -> float:
        got = total = 0.0
        for p in self.r.signature.get("match_patterns") or ():
            w = float(p.get("weight") or 0)
            total += w
            try:
                got += w * to_boolean(compile_xpath(str(p.get("selector") or ""), dict(self.r.signature.get("namespaces") or {})).evaluate(doc))
            except XPathError:
                pass
        if not total:
            raise DocumentError("the signature has no patterns with a weight")
        return got / total

    def documents(self, data: bytes, shared: dict | None = None) -> list[tuple[Node, int, int]]:
        """The trees to select from: the whole document, or one for each record. Whole trees are kept in ``shared`` by format."""
        key = self.r.format if self.r.match_scope == "document" else None
        if shared is None or key is None:
            return self._parsed(data)
        if key not in shared:
            try:
                shared[key] = self._parsed(data)
            except DocumentError as e:
                shared[key] = e
        if isinstance(shared[key], DocumentError):
            raise shared[key]
        return shared[key]

    def _parsed(self, data: bytes) -> list[tuple[Node, int, int]]:
        fmt = self.r.format
        if fmt == "ndjson":
            return doctree.parse_ndjson(data)
        doc = doctree.parse_xml(data) if fmt == "xml" else doctree.parse_json(data)
        if self.r.match_scope == "record":
            name = record_name(self.r.selectors[0].xpath)
            if len(self.r.selectors) != 1 or name is None:
                raise DocumentError("match_scope record takes one selector Name or //Name")
            return [(doctree.node_of_record(n), n.start, n.stop) for n in outermost(doc, name, fmt, self.r.selectors[0].xpath)]
        return [(doc, 0, len(data))]

    def streamed(self, data: bytes) -> tuple[list[dict], list[pa.Array]] | None:
        """Of a large document its rows' common values, or a row that tells why it failed, and its records' fields as Arrow arrays.

        None where it takes :meth:`rows`: small ones, and those of recipes that ask for more than records of one name.
        """
        name = record_name(self.r.selectors[0].xpath)
        if len(data) < STREAMED or self.plain is None or len(self.r.selectors) != 1 or name is None or not self.r.selectors[0].xpath.strip().startswith("//") or not elements.simple(data):
            return None
        bad = elements.fault(data)
        if bad:
            return [{"disposition": "failed", "reason": "parse_error", "error": bad}], []
        kind = to_arrow_schema(T.StructType([T.StructField("fields", fields_type(self.r))])).field(0).type
        chunks: list[pa.Array] = []
        held: list[dict] = []
        try:
            for n in elements.records(data, name):
                fields = {k: of(n) for k, of in self.plain[1]}
                for k in self.finite:
                    if not finite(fields[k]):
                        raise FieldError(f"{k}: NaN isn't a value")
                held.append(fields)
                if len(held) == 5000:
                    chunks.append(pa.array(held, kind))
                    held = []
        except FieldError as e:
            return [{"disposition": "failed", "reason": "internal_error", "error": str(e)}], []
        if held:
            chunks.append(pa.array(held, kind))
        count, least = sum(map(len, chunks)), self.r.selectors[0].min_occurrences
        late = f"selector 0 matched {count} records, at least {least} are needed" if count < least else None
        return [{"disposition": "applied", "selector_counts": [count], "late": late}], chunks

    def rows(self, data: bytes, shared: dict | None = None) -> Iterator[dict]:
        """The records of a document, or one row with its disposition."""
        root = elements.parsed(data) if self.plain and shared is None else None  # several recipes share one tree
        if root is not None:
            selectors, fields = self.plain
            try:
                yield from self._records((({k: of(n) for k, of in fields} for n in select(root)) for select in selectors), None)
            except FieldError as e:
                yield {"disposition": "failed", "reason": "internal_error", "error": str(e)}
            return
        if self.values and shared is None:
            try:
                yield from self._records(self._of_values(data), None)
                return
            except FieldError as e:
                yield {"disposition": "failed", "reason": "internal_error", "error": str(e)}
                return
            except values.Outside:
                pass  # the trees tell what it is
        try:
            docs = self.documents(data, shared)
        except (DocumentError, XPathError) as e:
            yield {"disposition": "failed", "reason": "parse_error", "error": str(e)}
            return
        try:
            applies = not self.r.applicability or to_boolean(compile_xpath(self.r.applicability, self.ns).evaluate(docs[0][0]))
        except (XPathError, IndexError, RecursionError) as e:
            yield {"disposition": "failed", "reason": "validation_error", "error": f"applicability: {e}"}
            return
        try:
            confidence = None
            if not applies:
                yield {"disposition": "not_applicable", "reason": "applicability_predicate_false"}
                return
            if self.r.signature and self.r.signature.get("match_patterns") and docs:
                confidence = min(self.confidence(d) for d, _, _ in docs)
                if confidence < float(self.r.signature.get("confidence_threshold") or 0):
                    yield {"disposition": "not_applicable", "reason": "signature_mismatch", "confidence": confidence}
                    return
            record = self.r.match_scope == "record"

            def of(s: Any) -> Iterator[dict]:
                for doc, _, _ in docs:
                    for n in [next(doc.elements())] if record and self.r.format != "ndjson" else [doc] if record else self.xpath(s.xpath).nodes(doc):
                        yield {m.name: self.value(n, m) for m in self.r.mappings if m.xpath}

            yield from self._records(map(of, self.r.selectors), confidence)
        except (FieldError, DocumentError, XPathError, RecursionError) as e:
            yield {"disposition": "failed", "reason": "internal_error", "error": str(e)}

    def _records(self, by_selector: Iterable[Iterable[dict]], confidence: float | None) -> Iterator[dict]:
        """Rows of the fields that each selector gives."""
        number, counts, out = 0, [], []
        for k, records in enumerate(by_selector):
            found = 0
            for fields in records:
                number, found = number + 1, found + 1
                for name in self.finite:
                    if not finite(fields[name]):
                        raise FieldError(f"{name}: NaN isn't a value")
                out.append({"record_num": number, "selector": k, "fields": fields, "confidence": confidence, "disposition": "applied"})
            counts.append(found)
        low = [f"selector {k} matched {c} records, at least {s.min_occurrences} are needed" for k, (s, c) in enumerate(zip(self.r.selectors, counts, strict=True)) if c < s.min_occurrences]
        late = "; ".join(low) or None
        for row in out:
            row |= {"selector_counts": counts, "late": late}
        yield from out or [{"disposition": "applied", "selector_counts": counts, "confidence": confidence, "late": late}]


def checked_fields(recipe: Recipe) -> list[Mapping]:
    """Fields with numbers that the scan itself checks: those that go to the record as they are read, where no filter may drop it first."""
    public = {m.name for m in recipe.public()}
    return [m for m in recipe.mappings if m.xpath and not m.expression and not m.transform and m.name in public and "double" in m.spark_type().simpleString()] if not recipe.filters else []


def finite(value: Any) -> bool:
    """Whether a value, or what an array or struct holds, has no NaN and no infinity."""
    if isinstance(value, float):
        return math.isfinite(value)
    if isinstance(value, dict):
        return all(map(finite, value.values()))
    return all(map(finite, value)) if isinstance(value, list) else True


def outermost(doc: Node, name: str, fmt: str, xpath: str) -> list[Node]:
    """Records of a record route: XML the outermost elements of a local name; JSON those of a name, at the top only for ``Name``."""
    if fmt != "xml":
        return [n for n in doc.walk() if n.kind == "element" and n.name == name and (xpath.startswith("//") or n.parent is doc)]
    out, todo = [], [doc]
    while todo:
        n = todo.pop()
        if n.kind == "element" and n.name == name:
            out.append(n)
        else:
            todo.extend(reversed(n.children))
    return out


def fields_type(recipe: Recipe) -> T.StructType:
    return T.StructType([T.StructField(m.name, m.spark_type()) for m in recipe.mappings if m.xpath])


def scan_schema(recipe: Recipe, keep: T.StructType) -> T.StructType:
    text = T.StringType()
    kinds = {"record_num": T.LongType(), "selector": T.IntegerType(), "confidence": T.DoubleType(), "selector_counts": T.ArrayType(T.LongType()), "disposition": text, "reason": text, "error": text, "late": text, "document": T.LongType()}
    own = T.StructType([T.StructField(k, v) for k, v in kinds.items()])
    return T.StructType([*keep.fields, *own.fields, T.StructField("fields", fields_type(recipe))])


def unpacked(data: bytes, name: str) -> bytes:
    """The bytes of a file; those of a name that ends with .gz are decompressed, up to a limit."""
    if not name.endswith(".gz"):
        return data
    try:
        z = zlib.decompressobj(31)
        out = z.decompress(data, GZIP_LIMIT)
        if z.unconsumed_tail:
            raise DocumentError(f"more than {GZIP_LIMIT} bytes after decompression")
        return out if z.eof and not z.unused_data else gzip.decompress(data)
    except (zlib.error, OSError, EOFError) as e:
        raise DocumentError(f"bad gzip data: {e}") from None


def scan(docs: DataFrame, recipe: Recipe, content: str = "content", run_on: list[str] | None = None) -> DataFrame:
    """Records of the documents in a string or binary column; all other columns are kept beside them.

    With ``run_on`` records are numbered on, by selector, over documents beside each other that have equal values there.

    A null document gives a failed row ``input_unavailable``; a document without records one row without fields. ``late``
    is an error that counts where no other one does (too few records); ``document`` numbers the documents of the scan, the
    rows of one lie beside each other.
    """
    keep = T.StructType([f for f in docs.schema.fields if f.name != content])
    schema = scan_schema(recipe, keep)
    arrow = to_arrow_schema(schema)
    columns = [f.name for f in keep.fields]
    src = docs.select(*(F.col(f"`{c}`") for c in columns), F.col(content).cast("binary").alias("_content"))
    path_at = columns.index("source_file") if "source_file" in columns else None

    def batch(b: pa.RecordBatch, at: list[int], rows: list[dict]) -> pa.RecordBatch:
        """Rows beside the kept columns of those documents of ``b`` that they are of; never beside the contents, which are as large as all rows of one."""
        own = b.columns[: len(columns)]
        if at != list(range(b.num_rows)):
            own = [c.take(pa.array(at, pa.int64())) for c in own]
        beside = [c if c.type == f.type else pa.array(c.to_pylist(), f.type) for c, f in zip(own, arrow, strict=False)]
        return pa.RecordBatch.from_arrays([*beside, *(pa.array([r.get(f.name) for r in rows], f.type) for f in list(arrow)[len(columns) :])], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        ex, number = Extractor(recipe), TaskContext.get().partitionId() << 36
        group, upto, told = None, {}, [columns.index(c) for c in run_on or ()]
        for b in batches:
            kept = [b.column(k).to_pylist() if k == path_at or k in told else [None] * b.num_rows for k in range(len(columns))]
            out: list[dict] = []
            at: list[int] = []
            size = 0
            for j, (row, data) in enumerate(zip(zip(*kept, strict=True) if kept else [()] * b.num_rows, b.column(len(columns)).to_pylist(), strict=True)):
                large = ex.streamed(data) if data is not None and not run_on and len(data) >= STREAMED and not (path_at is not None and str(row[path_at]).endswith(".gz")) else None
                if large and large[1]:
                    if out:
                        yield batch(b, at, out)
                        out, at, size = [], [], 0
                    common, many = {"document": number, "selector": 0} | large[0][0], 0
                    for c in large[1]:
                        b_ = batch(b, [j] * len(c), [common | {"record_num": many + k} for k in range(1, len(c) + 1)])
                        yield b_.set_column(len(arrow) - 1, arrow.field(len(arrow) - 1), c)
                        many += len(c)
                    number += 1
                    continue
                if large:
                    found: Iterable[dict] = large[0]
                elif data is None:
                    found = [{"disposition": "failed", "reason": "input_unavailable", "error": "no content"}]
                else:
                    try:
                        found = ex.rows(unpacked(data, str(row[path_at]) if path_at is not None else ""))
                    except DocumentError as e:
                        found = [{"disposition": "failed", "reason": "parse_error", "error": str(e)}]
                if run_on:
                    now = [row[k] for k in told]
                    if now != group:
                        group, upto = now, {}
                for r in found:
                    if run_on and "record_num" in r:
                        r["record_num"] = upto[r["selector"]] = upto.get(r["selector"], 0) + 1
                    r["document"] = number
                    out.append(r)
                    at.append(j)
                number += 1
                size += len(data or b"")
                if size > 4 << 20 or len(out) > 5000:
                    yield batch(b, at, out)
                    out, at, size = [], [], 0
            if out:
                yield batch(b, at, out)

    return src.mapInArrow(run, schema)


def scan_many(docs: DataFrame, recipes: list[Recipe], content: str = "content") -> DataFrame:
    """The rows of :func:`scan` for several recipes over the same documents, each parsed once: ``recipe`` is the place of the recipe
    that a row is of, ``fields_<recipe>`` its fields."""
    keep = T.StructType([f for f in docs.schema.fields if f.name != content])
    own = [f for f in scan_schema(recipes[0], keep).fields if f.name != "fields"]
    schema = T.StructType([*own, T.StructField("recipe", T.IntegerType()), *(T.StructField(f"fields_{k}", fields_type(r)) for k, r in enumerate(recipes))])
    arrow, columns = to_arrow_schema(schema), [f.name for f in keep.fields]
    src = docs.select(*(F.col(f"`{c}`") for c in columns), F.col(content).cast("binary").alias("_content"))
    path_at = columns.index("source_file") if "source_file" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        extractors, number = [Extractor(r) for r in recipes], TaskContext.get().partitionId() << 36
        for b in batches:
            kept = [b.column(k).to_pylist() for k in range(len(columns))]
            out: list[dict] = []
            size = 0
            for row, data in zip(zip(*kept, strict=True) if kept else [()] * b.num_rows, b.column(len(columns)).to_pylist(), strict=True):
                own_keys = dict(zip(columns, row, strict=True)) | {"document": number}
                shared: dict = {}
                failed = {"disposition": "failed", "reason": "input_unavailable", "error": "no content"} if data is None else None
                if data is not None:
                    try:
                        data = unpacked(data, str(row[path_at]) if path_at is not None else "")
                    except DocumentError as e:
                        failed = {"disposition": "failed", "reason": "parse_error", "error": str(e)}
                for k, ex in enumerate(extractors):
                    for r in [failed] if failed else ex.rows(data, shared):
                        out.append(own_keys | {"recipe": k, **{(f"fields_{k}" if n == "fields" else n): v for n, v in r.items()}})
                number += 1
                size += len(data or b"")
                if size > 4 << 20 or len(out) > 5000:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    return src.mapInArrow(run, schema)


def _empty(raw: DataFrame, counted: int) -> DataFrame | None:
    """The empty files of a file source, of which ``counted`` others are read: Spark leaves them out. None where there are none."""
    names = raw.inputFiles()
    if len(names) <= counted:
        return None
    spark = raw.sparkSession
    lost = spark.createDataFrame([(re.sub("^file:/+", "file:/", n),) for n in names], "file string").join(raw.select(F.col("_metadata.file_path").alias("file")), "file", "left_anti").collect()
    rows = [(unquote(r["file"]), 0, r["file"], bytearray()) for r in lost]
    return spark.createDataFrame(rows, "source_file string, size_bytes long, file string, content binary")


def _reader(spark: SparkSession, pattern: str | None, recursive: bool):
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.option("pathGlobFilter", pattern) if pattern else reader


def listed(spark: SparkSession, paths: list[str] | str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """Files without their contents: source_file, size_bytes, file (as ``_metadata.file_path`` has it); empty ones too."""
    raw = _reader(spark, pattern, recursive).load(paths)
    out = raw.select(F.col("path").alias("source_file"), F.col("length").alias("size_bytes"), F.col("_metadata.file_path").alias("file"))
    empty = _empty(raw, out.count())
    return out.unionByName(empty.select("source_file", "size_bytes", "file")) if empty is not None else out


def read_lines(spark: SparkSession, paths: list[str] | str, tasks: int | None = None) -> DataFrame:
    """Lines as documents: file, block (where its split of the file begins), content. Files are split, a task reads whole splits in order.

    With ``tasks`` splits that are more than these are read by so many tasks.
    """
    raw = spark.read.text(paths, lineSep="\n")
    raw = raw.coalesce(tasks) if tasks else raw
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("content"))


def read_files(spark: SparkSession, paths: list[str] | str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """Whole files as documents: source_file, size_bytes, input_ordinal (by path), input_sha256, content.

    Ordinals come from the names alone. Up to ``NAMES`` files they are broadcast, so no content is shuffled.
    """
    files = _reader(spark, pattern, recursive).load(paths)
    raw = files.select("path", "length", "content")
    many = raw.select("path").count()
    empty = _empty(files, many)
    if empty is not None:
        raw = raw.unionByName(empty.select(F.col("source_file").alias("path"), F.col("size_bytes").alias("length"), "content"))
    names = raw.select("path")
    if many <= NAMES:  # one sort of the names; each row is a name and a number
        ordered = F.broadcast(names.withColumn("input_ordinal", F.row_number().over(Window.orderBy("path")).cast("long")))
    else:
        from lodestone.operators.sinks import numbered

        ordered = numbered(names, ["path"], "input_ordinal")
    return raw.join(ordered, "path").select(F.col("path").alias("source_file"), F.col("length").alias("size_bytes"), "input_ordinal", F.sha2("content", 256).alias("input_sha256"), "content")
