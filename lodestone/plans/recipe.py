"""Recipes: loading, defaults and checks. A recipe is YAML text or a mapping; a workspace is a folder with ``recipe.yaml``."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from lodestone.functions import expressions as X
from lodestone.functions.transforms import REGISTRY
from lodestone.sources.xpath import XPathError, compile_xpath

TYPES = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}
FORMATS = ("xml", "json", "ndjson")
SEVERITIES = ("info", "warning", "error", "fatal")


class RecipeError(ValueError):
    """A recipe that can't be run."""


@dataclass(frozen=True)
class Variant:
    """One kind of item of a polymorphic array."""

    item_type: str
    element_type: str
    match_xpath: str
    fields: tuple[Mapping, ...]


@dataclass(frozen=True)
class Mapping:
    """One output field."""

    name: str
    type: str = "string"
    xpath: str = ""
    expression: str = ""
    transform: str = ""
    params: tuple[tuple[str, Any], ...] = ()
    internal: bool = False
    description: str = ""
    items: tuple[Mapping, ...] = ()
    variants: tuple[Variant, ...] = ()

    def spark_type(self) -> T.DataType:
        if self.variants:
            fields: dict[str, T.DataType] = {"item_type": T.StringType()} if any(v.item_type for v in self.variants) else {}
            for v in self.variants:
                for m in v.fields:
                    fields.setdefault(m.name, m.spark_type())
            return T.ArrayType(T.StructType([T.StructField(k, t) for k, t in fields.items()]))
        if self.items:
            return T.ArrayType(T.StructType([T.StructField(m.name, m.spark_type()) for m in self.items]))
        if self.type == "array":
            return T.ArrayType(T.StringType())
        return T.StringType() if self.transform and self.transform != "exists" else TYPES[self.type]


@dataclass(frozen=True)
class Selector:
    xpath: str
    min_occurrences: int = 0


@dataclass
class Recipe:
    record_type: str
    selectors: list[Selector]
    mappings: list[Mapping]
    format: str = "xml"
    match_scope: str = "document"
    namespaces: dict[str, str] = field(default_factory=dict)
    output_schema: dict[str, Any] = field(default_factory=dict)
    filters: dict[str, Any] = field(default_factory=dict)
    validation: dict[str, Any] | None = None
    summaries: list[dict[str, Any]] = field(default_factory=list)
    signature: dict[str, Any] | None = None
    applicability: str = ""
    parameters: dict[str, str | list[str]] = field(default_factory=dict)
    parameters_required: list[str] = field(default_factory=list)
    parameters_internal: list[str] = field(default_factory=list)
    source_extraction: list[dict[str, Any]] = field(default_factory=list)
    source_required: list[str] = field(default_factory=list)
    reference_tables: list[dict[str, Any]] = field(default_factory=list)
    value_profile: dict[str, Any] | None = None
    uniform_schema: bool = False
    parquet: dict[str, Any] = field(default_factory=dict)
    id: str = ""
    warnings: list[str] = field(default_factory=list)

    def scalar_names(self) -> list[str]:
        return [m.name for m in self.mappings]

    def public(self) -> list[Mapping]:
        return [m for m in self.mappings if not m.internal]

    def with_parameters(self, given: dict[str, str | list[str]]) -> Recipe:
        """Given values win over defaults; required ones must be there, names must not be those of fields."""
        merged = {**self.parameters, **given}
        missing = [p for p in self.parameters_required if p not in merged or merged[p] in ("", [])]
        if missing:
            raise RecipeError(f"required parameters are missing: {', '.join(missing)}")
        clash = sorted(set(merged) & set(self.scalar_names()))
        if clash:
            raise RecipeError(f"parameters have the names of fields: {', '.join(clash)}")
        for k, v in merged.items():
            if isinstance(v, list) and (not v or any(not isinstance(x, str) or not x for x in v)):
                raise RecipeError(f"parameter {k!r} needs a list of non-empty strings")
        return replace(self, parameters=merged)


def _mapping(raw: dict, top: bool) -> Mapping:
    name = str(raw.get("output_field") or "").strip()
    if not name:
        raise RecipeError("a field mapping has no output_field")
    kind = str(raw.get("type") or "string")
    if kind not in (*TYPES, "array"):
        raise RecipeError(f"{name}: unknown type {kind!r}")
    if raw.get("expression") and not top:
        raise RecipeError(f"{name}: nested mappings take XPath only")
    if bool(raw.get("expression")) == bool(raw.get("xpath")):
        raise RecipeError(f"{name}: give either xpath or expression")
    if raw.get("internal") and (not top or kind == "array"):
        raise RecipeError(f"{name}: only top-level scalar fields can be internal")
    transform = str(raw.get("transform") or "")
    if transform and transform != "exists" and transform not in REGISTRY:
        raise RecipeError(f"{name}: unknown transform {transform!r}")
    variants = tuple(Variant(str(v.get("item_type") or ""), str(v.get("element_type") or ""), str(v.get("match_xpath") or ""), tuple(_mapping(m, False) for m in v.get("field_mappings") or ())) for v in raw.get("polymorphic_mapping") or ())
    items = tuple(_mapping(m, False) for m in raw.get("item_mapping") or ())
    if (items or variants) and kind != "array":
        raise RecipeError(f"{name}: nested mappings need type array")
    if raw.get("expression"):
        try:
            X.parse(str(raw["expression"]))
        except X.ExpressionError as e:
            raise RecipeError(f"{name}: {e}") from None
    return Mapping(name, kind, str(raw.get("xpath") or ""), str(raw.get("expression") or ""), transform, tuple(sorted((raw.get("transform_params") or {}).items())), bool(raw.get("internal")), str(raw.get("description") or ""), items, variants)


def _xpaths(r: Recipe) -> list[str]:
    out = [s.xpath for s in r.selectors] + ([r.applicability] if r.applicability else [])

    def add(ms: tuple[Mapping, ...] | list[Mapping]) -> None:
        for m in ms:
            out.extend([m.xpath] if m.xpath else [])
            add(m.items)
            for v in m.variants:
                out.extend([v.match_xpath] if v.match_xpath else [])
                add(v.fields)

    add(r.mappings)
    return out + [str(p.get("selector") or "") for p in (r.signature or {}).get("match_patterns") or () if p.get("selector")]


def record_name(xpath: str) -> str | None:
    """``Name`` of a selector ``Name`` or ``//Name``, which record routes take; else None."""
    m = re.fullmatch(r"(?://)?([^\W\d][\w.\-]*)", xpath.strip())
    return m[1] if m else None


def build(extract: dict, signature: dict | None = None, manifest: dict | None = None, applicability: dict | None = None) -> Recipe:
    """A checked recipe of its parts."""
    manifest, d = manifest or {}, (manifest or {}).get("defaults") or {}
    fmt = str((signature or {}).get("format_type") or "xml").lower()
    declared = str((d.get("input") or {}).get("format") or "").lower()
    if declared and signature and signature.get("format_type") and declared != fmt:
        raise RecipeError(f"input format {declared!r} isn't the signature's {fmt!r}")
    fmt = declared or fmt
    if fmt not in FORMATS:
        raise RecipeError(f"unknown input format {fmt!r}")
    r = Recipe(
        record_type=str(extract.get("record_type") or ""),
        selectors=[Selector(str(s.get("xpath") or ""), int(s.get("min_occurrences") or 0)) for s in extract.get("match_selectors") or ()],
        mappings=[_mapping(m, True) for m in extract.get("field_mappings") or ()],
        format=fmt,
        match_scope=str((signature or {}).get("match_scope") or ("record" if fmt == "ndjson" else "document")),
        namespaces=dict(extract.get("namespaces") or {}),
        output_schema=extract.get("output_schema") or {},
        filters=dict(extract.get("filters") or {}),
        validation=extract.get("validation_metadata"),
        summaries=list(extract.get("summaries") or ()),
        signature=signature,
        applicability=str(((applicability or {}).get("applicability") or {}).get("expression") or ""),
        parameters=dict(d.get("parameters") or {}),
        parameters_required=list(d.get("parameters_required") or ()),
        parameters_internal=list(d.get("parameters_internal") or ()),
        source_extraction=list(d.get("source_extraction") or ()),
        source_required=list(d.get("source_extraction_required") or ()),
        reference_tables=list(d.get("reference_tables") or ()),
        value_profile=d.get("value_profile"),
        uniform_schema=bool((d.get("output") or {}).get("uniform_schema")),
        parquet=dict((d.get("output") or {}).get("parquet") or {}),
        id=str(manifest.get("id") or ""),
    )
    if not r.selectors or not all(s.xpath for s in r.selectors):
        raise RecipeError("a recipe needs match selectors")
    names = r.scalar_names()
    if len(set(names)) < len(names):
        raise RecipeError("two field mappings have one output_field")
    for s in extract.get("match_selectors") or ():
        if s.get("attributes"):
            r.warnings.append("match_selectors.attributes has no effect")
    for text in _xpaths(r):
        try:
            p = compile_xpath(text, r.namespaces)
        except XPathError as e:
            raise RecipeError(str(e)) from None
        if fmt != "xml" and "attribute" in p.axes:
            raise RecipeError(f"JSON has no attributes: {text!r}")
        if fmt != "xml" and p.prefixes:
            raise RecipeError(f"JSON has no namespaces: {text!r}")
    if fmt != "xml" and r.namespaces:
        raise RecipeError("JSON has no namespaces")
    if r.match_scope not in ("document", "record"):
        raise RecipeError(f"unknown match_scope {r.match_scope!r}")
    if fmt == "ndjson" and (r.match_scope != "record" or r.applicability):
        raise RecipeError("ndjson takes match_scope record and no applicability")
    if r.match_scope == "record" and r.applicability:
        raise RecipeError("match_scope record takes no applicability")
    v = r.validation
    if v and v.get("enable"):
        if not str(v.get("expression_language") or "dsl").endswith("dsl"):
            raise RecipeError(f"unknown expression language {v.get('expression_language')!r}")
        for a in v.get("accumulations") or ():
            if a.get("operation") not in ("count", "increment", "sum", "avg", "min", "max"):
                raise RecipeError(f"unknown accumulation {a.get('operation')!r}")
            if a.get("operation") in ("sum", "avg", "min", "max") and not a.get("field"):
                raise RecipeError(f"accumulation {a.get('name')} needs a field")
    if r.reference_tables:
        check_references(r)
    return r


def check_references(r: Recipe) -> None:
    """Refuses expressions that ask for reference tables which the recipe doesn't declare."""
    declared = {t.get("name") for t in r.reference_tables}
    for m in r.mappings:
        unknown = X.reference_tables(X.parse(m.expression)) - declared if m.expression else set()
        if unknown:
            raise RecipeError(f"{m.name}: undeclared reference tables {sorted(unknown)}")


def load_yaml(text: str) -> dict:
    """YAML text to a mapping."""
    import yaml

    out = yaml.safe_load(text)
    if not isinstance(out, dict):
        raise RecipeError("a recipe file must hold a mapping")
    return out


def load_workspace(path: str) -> Recipe:
    """The recipe of a workspace folder on the driver's disk: ``recipe.yaml`` and its assets."""

    def read(name: str) -> dict:
        full = os.path.normpath(os.path.join(path, name))
        if os.path.isabs(name) or os.path.commonpath([os.path.abspath(full), os.path.abspath(path)]) != os.path.abspath(path):
            raise RecipeError(f"{name!r} lies outside the workspace")
        with open(full, encoding="utf-8") as f:
            return load_yaml(f.read())

    manifest = read("recipe.yaml")
    assets = manifest.get("assets") or {}
    r = build(read(assets["extract"]), read(assets["signature"]) if assets.get("signature") else None, manifest, read(assets["applicability"]) if assets.get("applicability") else None)
    check_references(r)  # a workspace has no other tables than its own
    return r
