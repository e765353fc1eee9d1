"""Recipes compiled to Spark's own XML reader and to Columns: no Python runs on the data.

The reader cuts files at the record's tag, on any store, with a schema that holds just what the recipe names; a file is one
task, so large ones take the route by byte ranges. Child steps and attributes are fields and arrays of it, predicates are ``filter``, item mappings ``transform``,
``count`` and ``sum`` folds over arrays, string functions Columns. What can't be said so is refused: other axes, namespaces,
regular expressions, text of elements that hold elements.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.expressions import WHITE, let, once
from lodestone.sources.xpath import compile_xpath

from .recipe import Mapping, Recipe, RecipeError, record_name

CORRUPT, VALUE = "_corrupt_record", "_VALUE"
DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


class NotNative(RecipeError):
    """A recipe that needs the evaluator."""


@dataclass
class Shape:
    """What a recipe asks of an element: attributes, child elements, its text."""

    attrs: set[str] = field(default_factory=set)
    children: dict[str, Shape] = field(default_factory=dict)
    text: bool = False

    def child(self, name: str) -> Shape:
        return self.children.setdefault(name, Shape())

    @property
    def leaf(self) -> bool:
        return not self.attrs and not self.children

    def fields(self) -> list[T.StructField]:
        if self.text and self.children:
            raise NotNative("the text of an element that holds elements")
        out = [T.StructField(f"_{a}", T.StringType()) for a in sorted(self.attrs)]
        out += [T.StructField(n, T.ArrayType(T.StringType() if c.leaf else T.StructType(c.fields()))) for n, c in sorted(self.children.items())]
        return out + ([T.StructField(VALUE, T.StringType())] if self.text else [])


@dataclass
class Value:
    """An expression's value: ``kind`` is nodes (an array, each of a shape or an attribute's text), string, number or boolean."""

    kind: str
    col: Column
    shape: Shape | None = None


#: A context: how to get at a field of the current node, its shape, and the node itself (a record has none).
Context = tuple[Callable[[str], Column], Shape, Column | None]


def _none() -> Column:
    return F.array()


def _getter(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def _of_field(of: Callable[[Column], Column], name: str) -> Callable[[Column], Column]:
    return lambda x: of(x[name])


class Compiler:
    """Compiles expressions against a shape; the first pass, without Columns, fills the shape in."""

    def __init__(self, root: Shape, collect: bool) -> None:
        self.root, self.collect = root, collect

    def value(self, t: tuple, ctx: Context) -> Value:
        kind = t[0]
        if kind == "const":
            return Value("string", F.lit(t[1])) if isinstance(t[1], str) else Value("number", F.lit(float(t[1])))
        if kind == "group":
            return self.value(t[1], ctx)
        if kind == "neg":
            return Value("number", -self.number(self.value(t[1], ctx)))
        if kind == "steps":
            return self.steps(t, ctx)
        if kind == "binary":
            return self.binary(t, ctx)
        if kind == "call":
            return self.call(t[1], t[2], ctx)
        raise NotNative(f"{kind} isn't said by Columns")

    def steps(self, t: tuple, ctx: Context) -> Value:
        if t[1] != ("context",):
            raise NotNative("a path from the document or from an expression")
        get, shape, node = ctx
        steps = [s for s in t[2] if s[:2] != ("self", ("node",)) or s[2]]
        if any(s[0] == "self" for s in steps) or (not steps and node is None):
            raise NotNative("the node itself")
        if not steps:
            shape.text = True
            return Value("nodes", F.array(node), shape)
        now: Column | None = None  # an array of nodes, after the first step
        for j, (axis, test, preds) in enumerate(steps):
            if test[0] != "name" or test[1] or axis not in ("child", "attribute"):
                raise NotNative(f"a step {axis}::{test[0]}")
            name = test[2]
            if axis == "attribute":
                if j + 1 < len(steps) or preds:
                    raise NotNative("a step after an attribute")
                shape.attrs.add(name)
                col = _none() if self.collect else F.array(get(f"_{name}")) if now is None else F.transform(now, _getter(f"_{name}"))
                return Value("nodes", F.filter(col, lambda x: x.isNotNull()), None)
            own = shape.child(name)
            if self.collect:
                for p in preds:
                    self.predicate(p, _none(), own)
                now = _none()
            else:
                of = self.children_of(own, preds)
                now = of(get(name)) if now is None else F.flatten(F.transform(now, _of_field(of, name)))
            shape = own
        return Value("nodes", now, shape)

    def children_of(self, own: Shape, preds: list) -> Callable[[Column], Column]:
        """The children of one node that pass the predicates, none where it has none."""
        empty = F.array().cast(T.ArrayType(T.StringType() if own.leaf else T.StructType(own.fields())))
        return lambda arr: self.narrowed(F.coalesce(arr, empty), own, preds)

    def narrowed(self, arr: Column, shape: Shape, preds: list) -> Column:
        for p in preds:
            arr = self.predicate(p, arr, shape)
        return arr

    def predicate(self, p: tuple, arr: Column, shape: Shape) -> Column:
        if p[0] == "const" and not isinstance(p[1], str):
            if p[1] != int(p[1]) or p[1] < 1:
                raise NotNative("a place that isn't a whole number")
            return F.slice(arr, int(p[1]), 1)

        def test(x: Column) -> Column:
            v = self.value(p, (lambda n: x[n], shape, x))
            if v.kind == "number":
                raise NotNative("a computed place")
            return F.coalesce(self.boolean(v), F.lit(False))

        if self.collect:
            test(F.lit(None))
            return arr
        return F.filter(arr, test)

    def text_of(self, x: Column, shape: Shape | None) -> Column:
        """The text of one node."""
        if shape is None:
            return x
        shape.text = True
        return F.coalesce(x if shape.leaf or self.collect else x[VALUE], F.lit(""))

    def string(self, v: Value) -> Column:
        if v.kind == "nodes":
            if v.shape is not None:
                v.shape.text = True
            return F.lit("") if self.collect else F.coalesce(self.text_of(F.get(v.col, F.lit(0)), v.shape), F.lit(""))
        if v.kind == "boolean":
            return F.when(v.col, "true").otherwise("false")
        if v.kind == "number":
            raise NotNative("a number as text")
        return v.col

    def number(self, v: Value) -> Column:
        if v.kind == "number":
            return v.col
        if v.kind == "boolean":
            return v.col.cast("double")
        s = F.trim(F.translate(self.string(v), "\t\r\n", "   "))
        return F.when(s.rlike(DECIMAL), s.try_cast("double")).otherwise(F.lit(float("nan")))

    def boolean(self, v: Value) -> Column:
        if v.kind == "nodes":
            return F.lit(True) if self.collect else F.size(v.col) > 0
        if v.kind == "number":
            return (v.col != 0) & ~F.isnan(v.col)
        return v.col if v.kind == "boolean" else v.col != ""

    def binary(self, t: tuple, ctx: Context) -> Value:
        op, left, right = t[1], self.value(t[2], ctx), self.value(t[3], ctx)
        if op in ("and", "or"):
            a, b = self.boolean(left), self.boolean(right)
            return Value("boolean", a & b if op == "and" else a | b)
        if op in ("=", "!=", "<", "<=", ">", ">="):
            return Value("boolean", self.related(op, left, right))
        a, b = self.number(left), self.number(right)
        if op == "div":
            return Value("number", F.when(b != 0, F.try_divide(a, b)).otherwise(F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(F.lit(float("nan")))))
        if op == "mod":
            raise NotNative("mod")
        return Value("number", a + b if op == "+" else a - b if op == "-" else a * b)

    def related(self, op: str, left: Value, right: Value) -> Column:
        compare = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
        if left.kind == "nodes" and right.kind == "nodes":
            raise NotNative("a comparison of two paths")
        if "nodes" in (left.kind, right.kind):
            nodes, other, turned = (left, right, False) if left.kind == "nodes" else (right, left, True)
            if other.kind == "boolean":
                return compare(*((self.boolean(left), self.boolean(right))))
            if nodes.shape is not None:
                nodes.shape.text = True
            if self.collect:
                return F.lit(True)
            as_number = other.kind == "number" or op not in ("=", "!=")
            want = self.number(other) if as_number else other.col

            def one(x: Column) -> Column:
                own = Value("string", self.text_of(x, nodes.shape))
                own_col = self.number(own) if as_number else own.col
                found = compare(want, own_col) if turned else compare(own_col, want)
                return found & ~F.isnan(own_col) if as_number and op != "!=" else found

            return F.exists(nodes.col, one)
        if op not in ("=", "!=") or "number" in (left.kind, right.kind):
            a, b = self.number(left), self.number(right)
            return compare(a, b) & ~F.isnan(a) & ~F.isnan(b) if op != "!=" else compare(a, b)
        return compare(self.boolean(left), self.boolean(right)) if "boolean" in (left.kind, right.kind) else compare(left.col, right.col)

    def call(self, name: str, args: list, ctx: Context) -> Value:
        if not args and name not in ("true", "false"):
            raise NotNative(f"{name}() of the node itself")
        if name in ("round", "translate", "substring", "matches", "replace", "name", "local-name", "namespace-uri", "position", "last"):
            raise NotNative(f"{name}()")
        v = [self.value(a, ctx) for a in args]
        if name in ("true", "false"):
            return Value("boolean", F.lit(name == "true"))
        if name in ("count", "sum"):
            if v[0].kind != "nodes":
                raise NotNative(f"{name}() of something else than a path")
            if name == "count":
                return Value("number", F.lit(0.0) if self.collect else F.size(v[0].col).cast("double"))
            if v[0].shape is not None:
                v[0].shape.text = True
            if self.collect:
                return Value("number", F.lit(0.0))
            numbers = F.transform(v[0].col, lambda x: self.number(Value("string", self.text_of(x, v[0].shape))))
            return Value("number", F.aggregate(F.filter(numbers, lambda x: ~F.isnan(x)), F.lit(0.0), lambda a, x: a + x))
        if name == "not":
            return Value("boolean", ~self.boolean(v[0]))
        if name == "boolean":
            return Value("boolean", self.boolean(v[0]))
        if name == "number":
            return Value("number", self.number(v[0]))
        if name in ("floor", "ceiling"):
            return Value("number", (F.floor if name == "floor" else F.ceil)(self.number(v[0])).cast("double"))
        s = [self.string(x) for x in v]
        if name == "string":
            return Value("string", s[0])
        if name == "concat":
            return Value("string", F.concat(*s))
        if name in ("starts-with", "ends-with", "contains"):
            return Value("boolean", {"starts-with": s[0].startswith, "ends-with": s[0].endswith, "contains": s[0].contains}[name](s[1]))
        if name == "string-length":
            return Value("number", F.octet_length(s[0]).cast("double"))
        if name == "normalize-space":
            return Value("string", F.trim(F.regexp_replace(s[0], r"[ \t\r\n]+", " ")))
        if name == "lower-case":
            return Value("string", F.lower(s[0]))
        if name == "substring-before":
            return Value("string", F.when(F.instr(s[0], s[1]) > 0, F.left(s[0], F.instr(s[0], s[1]) - 1)).otherwise(""))
        if name == "substring-after":
            at = F.instr(s[0], s[1])
            return Value("string", F.when(at > 0, F.substr(s[0], at + F.char_length(s[1]))).otherwise(""))
        raise NotNative(f"{name}()")

    # ---- fields

    def field(self, m: Mapping, ctx: Context) -> Column:
        """A mapping's value ``v`` and its error ``e``, each part computed once."""
        if m.variants:
            raise NotNative("polymorphic arrays")
        v = self.value(compile_xpath(m.xpath).tree, ctx)
        if m.transform == "exists":
            return self.made(self.boolean(v), m)
        if m.type == "array":
            return self.array(m, v)
        if v.kind == "nodes" and v.shape is not None:
            v.shape.text = True
        if self.collect:
            return F.lit(None)
        if v.kind == "nodes":
            first = F.get(v.col, F.lit(0))
            v = Value("string", let(first, lambda x: F.when(x.isNotNull(), self.trimmed(self.text_of(x, v.shape)))) if v.shape is None or v.shape.leaf else let(v.col, lambda c: F.when(F.size(c) > 0, self.trimmed(self.text_of(F.get(c, F.lit(0)), v.shape)))))
        elif v.kind == "string":
            v = Value("string", self.trimmed(v.col))
        if m.transform:
            if v.kind != "string":
                raise NotNative("a transform of a number or boolean")
            return self.made(v.col, m)
        return let(v.col, lambda c: self.coerced(Value(v.kind, c), m))

    @staticmethod
    def made(c: Column, m: Mapping, error: Column | None = None) -> Column:
        return F.struct(c.cast(m.spark_type()).alias("v"), (F.lit(None) if error is None else error).cast("string").alias("e"))

    def array(self, m: Mapping, v: Value) -> Column:
        if v.kind != "nodes":
            raise NotNative("an array that isn't a path")
        if not m.items:
            if v.shape is not None:
                v.shape.text = True
            if self.collect:
                return F.lit(None)
            texts = F.filter(F.transform(v.col, lambda x: self.trimmed(self.text_of(x, v.shape))), lambda x: x != "")
            return let(texts, lambda c: self.made(F.when(F.size(c) > 0, c), m))
        if v.shape is None:
            raise NotNative("items of attributes")
        if self.collect:
            for f in m.items:
                self.field(f, (lambda n: F.lit(None), v.shape, F.lit(None)))
            return F.lit(None)
        if v.shape.leaf:
            raise NotNative("items without fields of their own")

        def item(x: Column) -> Column:
            parts = F.struct(*(self.field(f, (lambda n: x[n], v.shape, x)).alias(f.name) for f in m.items))
            return let(parts, lambda p: F.struct(F.struct(*(p[f.name]["v"].alias(f.name) for f in m.items)).alias("v"), F.coalesce(*(p[f.name]["e"] for f in m.items)).alias("e")))

        return let(F.transform(v.col, item), lambda c: self.made(F.when(F.size(c) > 0, F.transform(c, _getter("v"))), m, F.get(F.filter(F.transform(c, _getter("e")), lambda e: e.isNotNull()), F.lit(0))))

    @staticmethod
    def trimmed(c: Column) -> Column:
        return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")

    def coerced(self, v: Value, m: Mapping) -> Column:
        if m.type == "boolean":
            if v.kind == "string":
                return self.made(F.coalesce(~F.lower(v.col).isin("", "0", "false", "no", "off"), F.lit(False)), m)
            return self.made(self.boolean(v), m)
        if m.type == "string":
            return self.made(self.string(v), m)
        if v.kind == "boolean":
            v = Value("number", v.col.cast("double"))
        if v.kind == "number":
            if m.type == "number":
                return self.made(v.col, m)
            bad = F.isnan(v.col) | (F.abs(v.col) == float("inf"))
            return self.made(F.when(~bad, v.col.cast("long")), m, F.when(bad, F.concat(F.lit(f"{m.name}: "), v.col.cast("string"), F.lit(" isn't an integer"))))
        s = F.nullif(v.col, F.lit(""))
        plain = s.rlike(DECIMAL) | F.lower(s).rlike(r"^[+-]?(inf|infinity|nan)$")
        number = F.when(plain, s.try_cast("double"))
        out = number if m.type == "number" else F.when(s.contains("."), number.try_cast("long")).otherwise(F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("long")))
        return let(out, lambda o: self.made(o, m, F.when(s.isNotNull() & o.isNull(), F.concat(F.lit(f"{m.name}: failed to parse {m.type} '"), s, F.lit("'")))))


@dataclass
class Native:
    """A compiled recipe: the record's tag, what is read of it, the fields (each with ``v``, its value, and ``e``, its error), and which records count."""

    row_tag: str
    schema: T.StructType
    names: list[str]
    fields: Column
    selected: Column


def compile_recipe(r: Recipe) -> Native:
    """Compiles a recipe, or tells why it can't be (:class:`NotNative`)."""
    if r.format != "xml" or r.namespaces or r.applicability or len(r.selectors) != 1 or (r.signature or {}).get("match_patterns"):
        raise NotNative("the recipe is of another format, has namespaces, several selectors, or looks at documents")
    selector = r.selectors[0].xpath.strip()
    name, _, rest = selector.partition("[")
    if record_name(name) is None or not name.startswith("//") or (rest and not rest.endswith("]")):
        raise NotNative("its selector isn't //Name, with a predicate or without")
    tag, preds = record_name(name), []
    if rest:
        tree = compile_xpath(f"self::node()[{rest}").tree
        preds = tree[2][0][2]
    mappings = [m for m in r.mappings if m.xpath]
    root = Shape()
    for collect in (True, False):
        c = Compiler(root, collect)
        ctx: Context = (lambda n: F.col(f"`{n}`"), root, None)
        tests = [c.value(p, ctx) for p in preds]
        if any(t.kind == "number" for t in tests):
            raise NotNative("a place among records")
        made = [c.field(m, ctx) for m in mappings]
    selected = F.lit(True)
    for t in tests:
        selected = selected & F.coalesce(c.boolean(t), F.lit(False))
    schema = T.StructType([*root.fields(), T.StructField(CORRUPT, T.StringType())])
    names = [m.name for m in mappings]
    return Native(tag, schema, names, F.struct(*(col.alias(k) for k, col in zip(names, made, strict=True))), selected)


def scan_native(spark: SparkSession, paths: str | list[str], r: Recipe) -> DataFrame:
    """The rows of the scan (``sources.scan``) by Spark's reader: file, block and the scan's columns; ``record_num`` counts a task's rows."""
    n = compile_recipe(r)
    raw = spark.read.format("xml").option("rowTag", n.row_tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("ignoreSurroundingSpaces", "false").schema(n.schema).load(paths)
    none = F.lit(None).cast("string")
    raw = raw.where(F.col(CORRUPT).isNotNull() | n.selected).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("document"), F.col(CORRUPT).isNotNull().alias("_bad"), once(n.fields).alias("_made"))
    bad, of = F.col("_bad"), lambda k, part: F.col("_made")[k][part]
    raw = raw.withColumn("_error", F.when(bad, F.lit("malformed record")).otherwise(F.coalesce(*(of(k, "e") for k in n.names), none)))
    error = F.col("_error")
    out = raw.select(
        "file", "block",
        F.when(~bad, F.lit(1).cast("long")).alias("record_num"), F.lit(0).alias("selector"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("array<long>").alias("selector_counts"),
        F.when(error.isNull(), "applied").otherwise("failed").alias("disposition"), F.when(bad, "parse_error").when(error.isNotNull(), "internal_error").alias("reason"), error.alias("error"), none.alias("late"),
        "document", F.when(error.isNull(), F.struct(*(of(k, "v").alias(k) for k in n.names))).alias("fields"),
    )
    return out


def native_reason(r: Recipe) -> str | None:
    """Why a recipe needs the evaluator; None where it doesn't."""
    try:
        compile_recipe(r)
    except NotNative as e:
        return str(e)
    return None

