"""Per-record validation as Columns: accumulations, aggregations, reconciliations, rules and the failure policy.

Arrays are folded with higher-order functions inside the row, so nothing is shuffled. Errors are collected as text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import expressions as X
from lodestone.functions.expressions import Scope, Typed, compile_node, first_error, parse, parse_filter


def kind_of(t: T.DataType) -> str:
    """The expression language's kind of a Spark type."""
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "number"
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
        return "strings"
    return "other"


def variables_of(t: T.StructType, of) -> dict[str, Typed]:
    """Typed variables of a struct's fields; ``of(name)`` gives the Column."""
    return {f.name: Typed(of(f.name), kind_of(f.dataType)) for f in t.fields}


@dataclass
class Validated:
    """What validation adds: names of the columns of each part, typed scalars for later expressions, and errors."""

    df: DataFrame
    scope: dict[str, Typed] = field(default_factory=dict)
    accumulations: dict[str, str] = field(default_factory=dict)
    aggregations: dict[str, str] = field(default_factory=dict)
    reconciliations: list[str] = field(default_factory=list)
    results: str = ""
    record_count: Column | None = None
    errors: list[Column] = field(default_factory=list)


def _nested(t: T.DataType, path: str) -> T.DataType | None:
    for part in path.split("."):
        t = t[part].dataType if isinstance(t, T.StructType) and part in t.names else None
        if t is None:
            return None
    return t


def items_of(schema: T.StructType, path: str) -> tuple[Column, T.StructType, Column | None]:
    """The records of an ``array_path``, their type, and an error where it isn't an array of objects."""
    if not path.strip():
        return F.array(F.struct(*(F.col(f"`{n}`") for n in schema.names))), schema, None
    t = _nested(schema, path)
    if not isinstance(t, T.ArrayType) or not isinstance(t.elementType, T.StructType):
        return F.array(), T.StructType(), F.lit(f"array_path {path!r} must resolve to an array of objects")
    c = F.col(".".join(f"`{p}`" for p in path.split(".")))
    return F.coalesce(c, F.array().cast(t)), t.elementType, F.when(c.isNull(), F.lit(f"array_path {path!r} not found in the record"))


def accumulation(cfg: dict, items: Column, item_type: T.StructType) -> tuple[Column, str, Column | None]:
    """Value, kind and error of one accumulation over an array of structs."""
    op, name = cfg["operation"], cfg["name"]
    live, errors = items, []
    if cfg.get("filter"):
        node = parse_filter(str(cfg["filter"]))

        def test(x: Column) -> Typed:
            return compile_node(node, Scope(variables_of(item_type, lambda f: x[f])))

        live = F.filter(items, lambda x: F.coalesce(test(x).value, F.lit(False)))
        errors.append(F.array_max(F.transform(items, lambda x: F.lit(None).cast("string") if test(x).error is None else test(x).error)))
    if op in ("count", "increment"):
        return F.size(live).cast("long"), "integer", first_error(*errors)
    path = str(cfg["field"])
    t = _nested(item_type, path)
    if t is not None and kind_of(t) not in ("number", "integer"):
        errors.append(F.when(F.exists(live, lambda x: _get(x, path).isNotNull()), F.lit(f"accumulation {name}: {path} isn't numeric")))
        return F.lit(None).cast("double"), "number", first_error(*errors)
    values = F.filter(F.transform(live, lambda x: (F.lit(None) if t is None else _get(x, path)).cast("double")), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    value = {"sum": total, "avg": F.try_divide(total, F.size(values)), "min": F.array_min(values), "max": F.array_max(values)}[op]
    return value, "number", first_error(*errors)


def _get(x: Column, path: str) -> Column:
    for p in path.split("."):
        x = x[p]
    return x


def validate(df: DataFrame, record: T.StructType, scope: Scope, cfg: dict[str, Any], later: set[str] = frozenset()) -> Validated:
    """Adds validation columns to rows whose record's fields are columns. ``later``: names that summaries refer to."""
    out = Validated(df)
    items, item_type, error = items_of(record, str(cfg.get("array_path") or ""))
    if error is not None:
        out.errors.append(error)
    accs, adds = cfg.get("accumulations") or (), {}
    own: dict[str, Typed] = {}
    for a in accs:
        value, kind, e = accumulation(a, items, item_type)
        col = f"_acc_{a['name']}"
        adds[col] = value
        if e is not None:
            adds[col + "_error"] = e
            out.errors.append(F.col(col + "_error"))
        own[a["name"]] = Typed(F.col(f"`{col}`"), kind, literal="nullable" if a["operation"] in ("avg", "min", "max") else None)
        out.accumulations[a["name"]] = col
    out.df = out.df.withColumns(adds) if adds else out.df
    out.record_count = F.size(items).cast("long") if accs else F.lit(0 if str(cfg.get("array_path") or "").strip() else 1).cast("long")
    # aggregations see accumulations < earlier aggregations < the record
    for a in cfg.get("aggregations") or ():
        names = {**own, **{k: Typed(F.col(f"`{c}`"), "number") for k, c in out.aggregations.items()}}
        t = compile_node(parse(a["expression"]), Scope({**names, **scope.variables}, scope.references))
        col = f"_agg_{a['name']}"
        numeric = t.kind in ("number", "integer")
        out.df = out.df.withColumn(col, t.value.cast("double") if numeric else t.value)
        if t.error is not None:
            out.errors.append(t.error)
        target = str(a.get("compare_to") or "").strip()
        if target:
            if target not in scope.variables:
                out.errors.append(F.lit(f"aggregation {a['name']}: compare_to {target!r} not found"))
            else:
                c = scope.variables[target].value
                limit = float(a["tolerance"]) if "tolerance" in a else 0.01
                out.errors.append(F.when(c.isNull(), F.lit(f"aggregation {a['name']}: compare_to {target!r} not found")).when(F.abs(F.col(f"`{col}`") - c) > limit, F.lit(f"aggregation {a['name']} differs from {target}")))
        out.aggregations[a["name"]] = col
    aggs = {k: Typed(F.col(f"`{c}`"), kind_of(out.df.schema[c].dataType)) for k, c in out.aggregations.items()}
    scalars: dict[str, Typed] = {}
    wanted = later | {n for v in cfg.get("validations") or () for n in X.names(parse(v["rule"]))}
    for r in cfg.get("reconciliations") or ():
        names = {**own, **aggs, **scope.variables, **scalars}
        _reconcile(out, record, Scope(names, scope.references), r, scalars, wanted)
    # rules see accumulations < aggregations < record < reconciliation scalars; summaries the record lowest
    rules = {**own, **aggs, **scope.variables, **scalars}
    out.scope = {**scope.variables, **own, **aggs, **scalars}
    _rules(out, Scope(rules, scope.references), cfg)
    return out


def _named(slug: str):
    return lambda g: g["slug"] == slug


def _field(name: str):
    return lambda x: x[name]


COMPONENT = "struct<name:string,description:string,value:double>"


def _reconcile(out: Validated, record: T.StructType, scope: Scope, r: dict, scalars: dict[str, Typed], wanted: set[str]) -> None:
    name = r["name"]
    base = compile_node(parse(r["base_expression"]), scope)
    col = f"_rec_{name}"
    value, e = X._number(base, f"reconciliation {name}")
    if e is not None:
        out.errors.append(e)
    out.df = out.df.withColumn(f"{col}_base", value)
    base_c = F.col(f"`{col}_base`")
    parts: list[Column] = []
    if r.get("group_by"):
        out.errors.append(_grouped(out, col, record, scope, r["group_by"], base_c))
        groups = F.col(f"`{col}_groups`")
        parts.append(F.transform(groups, lambda g: F.struct(g["name"].alias("name"), g["description"].alias("description"), g["value"].alias("value"))))
        scalars[f"{name}_group_components_total"] = Typed(F.aggregate(groups, F.lit(0.0), lambda a, g: a + g["value"]), "number")
        for n in wanted:
            if n.startswith(f"{name}_component_"):
                slug = n[len(name) + 11 :]
                scalars[n] = Typed(F.array_max(F.transform(F.filter(groups, _named(slug)), lambda g: g["value"])), "number")
    inner = Scope({**scope.variables, **scalars}, scope.references)
    for c in r.get("components") or ():
        t = compile_node(parse(c["expression"]), inner)
        v, e = X._number(t, f"component {c.get('name')}")
        if e is not None:
            out.errors.append(e)
        parts.append(F.array(F.struct(F.lit(str(c.get("name") or "")).alias("name"), F.lit(str(c.get("description") or "")).alias("description"), v.alias("value"))))
    out.df = out.df.withColumn(f"{col}_components", X.once(F.concat(*parts)) if parts else F.array().cast(f"array<{COMPONENT}>"))
    components = F.col(f"`{col}_components`")
    out.df = out.df.withColumn(f"{col}_total", X.once(F.aggregate(components, F.lit(0.0), lambda a, c: a + c["value"])))
    total = F.col(f"`{col}_total`")
    tolerance = float(r.get("tolerance") or 0) or 0.01
    residual = base_c - total
    status = F.when(F.abs(residual) <= tolerance, "balanced").otherwise("unexplained" if r.get("allow_unexplained") else "unbalanced")
    out.df = out.df.withColumn(col, F.struct(F.lit(name).alias("name"), base_c.alias("base_value"), components.alias("components"), total.alias("components_total"), residual.alias("residual"), F.lit(tolerance).alias("tolerance"), status.alias("status"), F.lit(bool(r.get("allow_unexplained"))).alias("allow_unexplained"), F.lit(str(r.get("severity") or "").strip() or "warning").alias("severity")))
    out.reconciliations.append(col)
    for k, f, kind in (("base", "base_value", "number"), ("components_total", "components_total", "number"), ("residual", "residual", "number"), ("status", "status", "string")):
        scalars[f"{name}_{k}"] = Typed(F.col(f"`{col}`")[f], kind)


def group_items(schema: T.StructType, path: str) -> tuple[Column, T.StructType]:
    """The records of a ``source`` path such as ``orders[].lines[]``: arrays are flattened, nulls left out."""
    here: Column | None = None
    t: T.DataType = schema
    many = False
    for segment in path.split("."):
        name, array = segment.strip().removesuffix("[]"), segment.strip().endswith("[]")
        if not name:
            raise X.ExpressionError(f"bad source path {path!r}")
        if not isinstance(t, T.StructType) or name not in t.names:
            return F.array(), T.StructType()
        ft = t[name].dataType
        if array != isinstance(ft, T.ArrayType):
            raise X.ExpressionError(f"source {path!r}: {name} is{'' if array else ' not'} expected to be an array")
        if here is None:
            here = F.col(f"`{name}`")
        elif many:
            here = F.filter(F.transform(here, _field(name)), lambda v: v.isNotNull())
            here = F.flatten(here) if array else here
        else:
            here = here[name]
        many = many or array
        t = ft.elementType if array else ft
    if not isinstance(t, T.StructType):
        raise X.ExpressionError(f"source {path!r} doesn't lead to objects")
    here = here if many else F.array(here)
    return F.coalesce(F.filter(here, lambda v: v.isNotNull()), F.array().cast(T.ArrayType(t))), t


def _grouped(out: Validated, col: str, record: T.StructType, scope: Scope, g: dict, base: Column) -> Column:
    """Adds components by group (name, description, value, slug), ascending by group, sums in item order; returns the error.

    Each step is a column of its own that is computed once, so that no array is folded twice.
    """

    def step(name: str, c: Column) -> Column:
        out.df = out.df.withColumn(f"{col}_{name}", X.once(c))
        return F.col(f"`{col}_{name}`")

    if str(g.get("aggregation") or "sum").strip().lower() != "sum":
        raise X.ExpressionError(f"group_by aggregation {g.get('aggregation')!r} isn't supported")
    items, t = group_items(record, str(g["source"]))
    missing = str(g.get("missing_label") or "").strip() or "unknown"
    keep = parse(g["filter"]) if str(g.get("filter") or "").strip() else None
    value_node = parse(g["value_expression"])

    def own(x: Column) -> Scope:
        return scope.with_(variables_of(t, lambda f: x[f]))

    def text(x: Column, path: str) -> Column:
        ft = _nested(t, path)
        return F.lit(None).cast("string") if ft is None else F.trim(X.as_text(Typed(_get(x, path), kind_of(ft))))

    def problem(x: Column) -> Column:
        none = F.lit(None).cast("string")
        bad = X._number(compile_node(value_node, own(x)), "group value")[1]
        if keep is None:
            return none if bad is None else bad
        test = compile_node(keep, own(x))
        return F.coalesce(none if test.error is None else test.error, none if bad is None else F.when(test.value, bad), none)

    error = F.array_max(F.transform(items, problem))
    live = F.filter(items, lambda x: compile_node(keep, own(x)).value) if keep else items
    rows = F.transform(
        step("live", live),
        lambda x: F.struct(
            F.coalesce(F.nullif(text(x, str(g["field"])), F.lit("")), F.lit(missing)).alias("k"),
            F.nullif(text(x, str(g["label_field"])) if str(g.get("label_field") or "").strip() else F.lit(None).cast("string"), F.lit("")).alias("l"),
            X._number(compile_node(value_node, own(x)), "group value")[0].alias("v"),
        ),
    )
    rows = step("rows", rows)
    keys = step("keys", F.array_sort(F.array_distinct(F.transform(rows, lambda p: p["k"]))))
    sums = F.transform(
        keys,
        lambda k: F.struct(
            k.alias("k"),
            F.coalesce(F.aggregate(F.filter(rows, lambda p: p["k"] == k), F.lit(None).cast("string"), lambda a, p: F.coalesce(p["l"], a)), k).alias("l"),
            F.aggregate(F.filter(rows, lambda p: p["k"] == k), F.lit(0.0), lambda a, p: a + p["v"]).alias("v"),
        ),
    )
    sums = step("sums", sums)
    total = step("sum", F.aggregate(sums, F.lit(0.0), lambda a, s: a + s["v"]))
    limit = F.abs(base)
    scale = F.when((total > 0) & (limit < total), limit / total).otherwise(F.lit(1.0)) if str(g.get("overflow_strategy") or "").strip().lower() == "cap_to_base" else F.lit(1.0)

    scale = step("scale", scale)

    def filled(template: str, s: Column) -> Column:
        return F.replace(F.replace(F.lit(template.strip()), F.lit("{{group}}"), s["k"]), F.lit("{{label}}"), s["l"])

    def named(s: Column, k: Column) -> Column:
        n = F.nullif(F.trim(filled(str(g.get("name_template") or ""), s)), F.lit(""))
        return F.coalesce(n, F.nullif(F.trim(s["l"]), F.lit("")), F.concat(F.lit("component_"), (k + 1).cast("string")))

    parts = F.transform(sums, lambda s, k: F.struct(named(s, k).alias("name"), filled(str(g.get("description_template") or ""), s).alias("description"), F.when(F.abs(s["v"] * scale) < 1e-9, F.lit(0.0)).otherwise(s["v"] * scale).alias("value")))
    parts = step("parts", parts)
    slugs = F.transform(parts, lambda p, k: F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(p["name"])), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.concat(F.lit("component_"), (k + 1).cast("string"))))

    slugs = step("slugs", slugs)

    def slug(k: Column) -> Column:
        mine = F.get(slugs, k)
        before = F.size(F.filter(F.slice(slugs, F.lit(1), k), lambda s: s == mine))
        return F.when(before > 0, F.concat(mine, F.lit("_"), (before + 1).cast("string"))).otherwise(mine)

    step("groups", F.transform(parts, lambda p, k: F.struct(p["name"].alias("name"), p["description"].alias("description"), p["value"].alias("value"), slug(k).alias("slug"))))
    return step("problem", error)


RESULT = "struct<name:string,severity:string,result:string,value:boolean,message:string>"


def message(template: str, scope: Scope) -> Column:
    """A message with ``{name}`` replaced by the values of variables."""
    out = F.lit(template)
    for name in sorted({m for m in scope.variables if "{" + m + "}" in template}):
        t = scope.variables[name]
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(X.as_text(t), F.lit("<nil>")))
    return out


def _rules(out: Validated, scope: Scope, cfg: dict) -> None:
    policy = cfg.get("failure_policy") or {}
    halt = policy.get("halt_on_first_fatal", True)
    found: list[Column] = []
    halted: Column = F.lit(False)
    for v in cfg.get("validations") or ():
        t = compile_node(parse(v["rule"]), scope)
        severity = str(v.get("severity") or "error").strip().lower()
        severity = severity if severity in ("info", "warning", "error", "fatal") else "error"
        if t.kind != "boolean":
            out.errors.append(first_error(t.error, F.lit(f"validation {v['name']} isn't boolean")))
            continue
        col = f"_rule_{v['name']}"
        out.df = out.df.withColumn(col, t.value)
        c = F.col(f"`{col}`")
        if t.error is not None:
            out.errors.append(F.when(~halted, t.error))
        row = F.struct(F.lit(v["name"]).alias("name"), F.lit(severity).alias("severity"), F.when(c, "pass").otherwise("fail").alias("result"), c.alias("value"), F.when(~c, message(str(v.get("message") or ""), scope)).otherwise(F.lit("")).alias("message"))
        found.append(F.when(~halted, row))
        if halt and severity == "fatal":
            halted = halted | ~F.coalesce(c, F.lit(True))
    out.results = "_results"
    out.df = out.df.withColumn("_results", F.filter(F.array(*found), lambda r: r.isNotNull()) if found else F.array().cast(f"array<{RESULT}>"))


def quality(results: Column) -> Column:
    """Counts of the results by severity: total_checks, passed, warnings, errors, fatals."""

    def failed(s: str) -> Column:
        return F.size(F.filter(results, lambda r: (r["result"] == "fail") & (r["severity"] == s))).cast("long")

    return F.struct(F.size(results).cast("long").alias("total_checks"), F.size(F.filter(results, lambda r: r["result"] == "pass")).cast("long").alias("passed"), failed("warning").alias("warnings"), failed("error").alias("errors"), failed("fatal").alias("fatals"))


def policy_error(q: Column, policy: dict) -> Column:
    """An error where fatals (unless switched off) or too many errors fail the record; a negative threshold switches off."""
    out = F.lit(None).cast("string")
    limit = int(policy.get("error_threshold") or 0)
    if limit >= 0:
        out = F.when(q["errors"] > limit, F.lit("validation errors exceed the threshold"))
    if policy.get("fail_on_fatal", True):
        out = F.coalesce(F.when(q["fatals"] > 0, F.lit("a fatal validation failed")), out)
    return out


def summaries(configs: list[dict], scope: Scope) -> tuple[dict[str, Column], list[Column]]:
    """Summaries with shares and remainder, as structs; and errors."""
    out, errors = {}, []

    def number(text: str) -> Column:
        if not str(text or "").strip():
            return F.lit(0.0)
        t = compile_node(parse(text), scope)
        if t.error is not None:
            errors.append(t.error)
        if t.kind == "string":
            return F.coalesce(F.nullif(F.trim(t.value), F.lit("")).cast("double"), F.lit(0.0))
        return t.value.cast("double")

    def rounded(c: Column) -> Column:
        return X._away(c * 1e6) / 1e6

    for s in configs:
        total = number((s.get("total") or {}).get("expression"))
        parts, acc, rest = [], F.lit(0.0), None
        share = lambda v, total=total: F.when(total != 0, rounded(v / total))

        def part(c: dict, v: Column, share=share) -> Column:
            return F.struct(F.lit(str(c.get("name"))).alias("name"), F.lit(str(c.get("label") or "")).alias("label"), rounded(v).alias("value"), F.lit(c.get("format")).cast("string").alias("format"), share(v).alias("share"))

        for c in s.get("components") or ():
            if c.get("remainder"):
                rest = c
                continue
            v = number(c.get("expression"))
            acc = acc + v
            parts.append(part(c, v))
        if rest is not None:
            v = total - acc
            v = F.when(F.abs(v) < 1e-9, F.lit(0.0)).otherwise(v)
            parts.append(part(rest, v))
            acc = acc + v
        gap = total - acc
        out[s["name"]] = F.struct(F.lit(str(s.get("label") or "")).alias("label"), F.lit(s.get("format")).cast("string").alias("format"), rounded(total).alias("total"), F.array(*parts).alias("components"), F.when(F.abs(gap) > 1e-6, rounded(gap)).alias("unreconciled"))
    return out, errors
