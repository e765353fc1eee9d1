"""End-to-end cases: documents and recipes in, envelopes out."""

import json

import pytest

from lodestone.plans import extract as E
from lodestone.plans.recipe import RecipeError, build


def run(spark, recipe, docs, params=None, references=None):
    df = spark.createDataFrame([(f"f{k}", d.encode() if isinstance(d, str) else d) for k, d in enumerate(docs)], "source_file string, content binary")
    return E.extract(df, recipe, params, references)


def envelopes(e):
    out = [json.loads(r.value) for r in E.envelope(e).orderBy("source_file", "record_num").collect()]
    for o in out:
        o.pop("_runtime")
    return out


def data(e):
    return [o["extract"]["data"] for o in envelopes(e)]


def field(name, xpath=None, type="string", **more):
    return {"output_field": name, "type": type, **({"xpath": xpath} if xpath else {}), **more}


def recipe(mappings, selector="//Order", **more):
    sig = more.pop("signature", None)
    manifest = more.pop("manifest", None)
    return build({"record_type": "t", "match_selectors": [{"xpath": selector}], "field_mappings": mappings, **more}, sig, manifest)


ORDERS = """<Shop><Section code="S1"><Order id="A-1" status="open"><Customer> Ann </Customer><Total>42.50</Total>
<Lines><Line sku="x"><Qty>2</Qty><Price>1.5</Price><Cat>gears</Cat></Line><Line sku="y"><Qty>1</Qty><Price>4</Price><Cat> </Cat></Line></Lines></Order>
<Order id="A-2" status="held" hold="YES"><Customer/><Total>7</Total></Order></Section></Shop>"""


def test_scalars_arrays_and_presence(spark):
    r = recipe([
        field("id", "@id"), field("customer", "Customer"), field("total", "Total", "number"), field("hold", "@hold", "boolean"), field("note", "Note"),
        field("has_lines", "Lines/Line", "boolean", transform="exists"), field("skus", "Lines/Line/@sku", "array"),
        field("lines", "Lines/Line", "array", item_mapping=[field("sku", "@sku"), field("qty", "Qty", "integer"), field("gone", "Nope")]),
    ])
    a, b = data(run(spark, r, [ORDERS]))
    assert a == {"id": "A-1", "customer": "Ann", "total": 42.5, "hold": False, "has_lines": True, "skus": ["x", "y"], "lines": [{"sku": "x", "qty": 2, "gone": None}, {"sku": "y", "qty": 1, "gone": None}]}
    assert b == {"id": "A-2", "customer": "", "total": 7.0, "hold": True, "has_lines": False}


def test_json_twin_keeps_lexemes(spark):
    doc = '{"Shop":{"Order":[{"id":"A-1","amount":2.50,"tags":["a",null,"b"],"gone":null,"none":[]},{"id":"A-2","amount":1e3}]}}'
    r = recipe([field("id", "id"), field("amount", "amount"), field("value", "amount", "number"), field("tags", "tags", "array"), field("gone", "gone"), field("none", "none")], signature={"format_type": "json"})
    assert data(run(spark, r, [doc])) == [{"id": "A-1", "amount": "2.50", "value": 2.5, "tags": ["a", "b"]}, {"id": "A-2", "amount": "1e3", "value": 1000.0}]


def test_ndjson_and_bad_line(spark):
    r = recipe([field("id", "id"), field("n", "n", "integer")], "row", signature={"format_type": "ndjson", "match_scope": "record"})
    e = run(spark, r, ['{"id":"a","n":1}\n\n{"id":"b","n":2}\n', '{"id":"c"}\n{bad}\n'])
    assert data(e) == [{"id": "a", "n": 1}, {"id": "b", "n": 2}]
    assert {x.source_file: (x.disposition, x.reason) for x in e.dispositions.collect()} == {"f0": ("applied", None), "f1": ("failed", "parse_error")}


def test_expressions_internal_and_parameters(spark):
    r = recipe(
        [field("id", "@id"), field("total", "Total", "number"), field("big", type="boolean", expression="total > 10 && value_in(id, ids)", internal=True), field("verdict", expression='big ? "YES" : "no"'), field("cents", type="integer", expression="round(total * 100)")],
        manifest={"defaults": {"parameters": {"tenant": "demo", "ids": ["A-1", "Z"]}, "parameters_required": ["tenant"], "parameters_internal": ["ids"]}},
    )
    assert data(run(spark, r, [ORDERS], {"tenant": "t2"})) == [{"id": "A-1", "total": 42.5, "verdict": "YES", "cents": 4250, "tenant": "t2"}, {"id": "A-2", "total": 7.0, "verdict": "no", "cents": 700, "tenant": "t2"}]


def test_polymorphic_union_ancestor_and_siblings(spark):
    doc = '<R><G code="g"><Order id="1"><B>b</B><A>a</A><E><Sale sku="s"/><Back sku="t"><Why>w</Why></Back></E></Order><Order id="2"><A>z</A></Order></G></R>'
    r = recipe([
        field("id", "@id"), field("group", "ancestor::G[1]/@code"), field("before", "string(preceding-sibling::Order[1]/@id)"), field("first", "(A | B)[1]"), field("prefer", "(A | B[not(../A)])[1]"),
        field("events", "E", "array", polymorphic_mapping=[{"item_type": "sale", "element_type": "sale", "field_mappings": [field("sku", "@sku")]}, {"item_type": "back", "element_type": "Back", "field_mappings": [field("sku", "@sku"), field("why", "Why")]}]),
    ])
    assert data(run(spark, r, [doc])) == [
        {"id": "1", "group": "g", "before": "", "first": "b", "prefer": "a", "events": [{"item_type": "sale", "sku": "s"}, {"item_type": "back", "sku": "t", "why": "w"}]},
        {"id": "2", "group": "g", "before": "1", "first": "z", "prefer": "z"},
    ]


def test_validation_reconciliation_and_summary(spark):
    lines = field("lines", "Lines/Line", "array", item_mapping=[field("cat", "Cat"), field("qty", "Qty", "integer"), field("price", "Price", "number")])
    r = recipe(
        [field("id", "@id"), field("total", "Total", "number"), lines], "//Order[Lines]",
        validation_metadata={
            "enable": True, "expression_language": "dsl", "array_path": "lines", "failure_policy": {"fail_on_fatal": True},
            "accumulations": [{"name": "n", "operation": "count"}, {"name": "qty", "operation": "sum", "field": "qty"}, {"name": "dear", "operation": "count", "filter": "price > 2"}, {"name": "top", "operation": "max", "field": "price"}],
            "aggregations": [{"name": "rest", "expression": "n - dear"}],
            "reconciliations": [{"name": "rec", "base_expression": "total", "group_by": {"source": "lines[]", "field": "cat", "value_expression": "price * qty", "name_template": "cat_{{group}}", "missing_label": "none"}}],
            "validations": [{"name": "many", "rule": "n > 5", "severity": "warning", "message": "only {n}"}, {"name": "ok", "rule": "rec_status == 'unbalanced' && rec_component_cat_gears == 3", "severity": "error"}],
        },
        summaries=[{"name": "s", "label": "S", "total": {"expression": "n"}, "components": [{"name": "dear", "label": "D", "expression": "dear"}, {"name": "other", "label": "O", "remainder": True}]}],
    )
    (o,) = envelopes(run(spark, r, [ORDERS]))
    v = o["_validation"]
    assert v["accumulations"] == {"n": 2, "qty": 3.0, "dear": 1, "top": 4.0} and v["aggregations"] == {"rest": 1.0} and v["record_count"] == 2
    (rec,) = v["reconciliations"]
    assert [(c["name"], c["value"]) for c in rec["components"]] == [("cat_gears", 3.0), ("cat_none", 4.0)]
    assert (rec["residual"], rec["status"], rec["tolerance"], rec["severity"]) == (35.5, "unbalanced", 0.01, "warning")
    assert [(x["name"], x["result"], x["message"]) for x in v["validations"]] == [("many", "fail", "only 2"), ("ok", "pass", "")]
    assert v["quality_summary"] == {"total_checks": 2, "passed": 1, "warnings": 1, "errors": 0, "fatals": 0}
    assert o["extract"]["summary"]["s"]["components"] == [{"name": "dear", "label": "D", "value": 1.0, "share": 0.5}, {"name": "other", "label": "O", "value": 1.0, "share": 0.5}]


@pytest.mark.parametrize(
    ("doc", "mappings", "more", "reason"),
    [
        ("<a><Order></a>", [field("id", "@id")], {}, "parse_error"),
        ("<a><Order/></a>", [field("id", "@id")], {"output_schema": {"required": ["id"]}}, "validation_error"),
        ("<a><Order><N>TBD</N></Order></a>", [field("n", "number(N)", "number")], {}, "internal_error"),
        ("<a><Order><N>1e3</N></Order></a>", [field("n", "N", "integer")], {}, "internal_error"),
        ("<a><Order/></a>", [field("n", "N", "number"), field("m", type="number", expression="n + 1")], {}, "internal_error"),
        ("<a><Order><N>0</N></Order></a>", [field("n", "N", "number"), field("m", type="number", expression="1 / n")], {}, "internal_error"),
    ],
)
def test_a_bad_record_fails_its_input_only(spark, doc, mappings, more, reason):
    e = run(spark, recipe(mappings, **more), [doc, '<a><Order id="1"><N>1</N></Order></a>'.replace("<N>1</N>", "<N>5</N>")])
    found = {x.source_file: (x.disposition, x.reason) for x in e.dispositions.collect()}
    assert found == {"f0": ("failed", reason), "f1": ("applied", None)}
    assert [r.source_file for r in e.data.collect()] == ["f1"]


def test_untaken_branches_have_no_errors(spark):
    r = recipe([field("n", "N", "number"), field("has", "N", "boolean", transform="exists"), field("m", type="number", expression="has ? n + 1 : 0")])
    assert data(run(spark, r, ["<a><Order/><Order><N>2</N></Order></a>"])) == [{"has": False, "m": 0.0}, {"n": 2.0, "has": True, "m": 3.0}]


def test_signature_floor_filter_numbers_and_namespaces(spark):
    sig = {"match_patterns": [{"selector": "/Shop", "weight": 3}, {"selector": "//Nope", "weight": 1}], "confidence_threshold": 0.7}
    r = recipe([field("id", "@id"), field("c", "Customer")], signature=sig, filters={"c": "> B"})
    e = run(spark, r, [ORDERS, "<Other/>"])
    assert [x.record_num for x in e.records.collect()] == []
    assert {x.source_file: (x.disposition, x.reason, x.confidence) for x in e.dispositions.collect()} == {"f0": ("applied", None, 0.75), "f1": ("not_applicable", "signature_mismatch", 0.0)}
    r = build({"record_type": "t", "match_selectors": [{"xpath": "//Order", "min_occurrences": 3}], "field_mappings": [field("id", "@id")]})
    assert run(spark, r, [ORDERS]).dispositions.first().reason == "min_occurrences_violation"
    r = build({"record_type": "t", "namespaces": {"k": "urn:x"}, "match_selectors": [{"xpath": "//k:O"}], "field_mappings": [field("v", "k:V")]})
    assert data(run(spark, r, ['<r xmlns:a="urn:x" xmlns="urn:y"><a:O><a:V>1</a:V><V>2</V></a:O><O><V>3</V></O></r>'])) == [{"v": "1"}]


def test_record_scope_sees_nothing_outside(spark):
    maps = [field("id", "@id"), field("up", "ancestor::Section/@code")]
    wide, own = recipe(maps), recipe(maps, signature={"match_scope": "record"})
    assert [r["up"] for r in data(run(spark, wide, [ORDERS]))] == ["S1", "S1"]
    assert [r.get("up") for r in data(run(spark, own, [ORDERS]))] == [None, None]


@pytest.mark.parametrize(
    "bad",
    [
        {"field_mappings": [field("a", "matches(A, '[x')")]}, {"field_mappings": [field("a", "upper-case(A)")]}, {"field_mappings": [field("a", "replace(A, 'b', '$1')")]},
        {"field_mappings": [field("a", "x:A")], "namespaces": {"y": "u"}}, {"field_mappings": [field("a", "A"), field("a", "B")]}, {"field_mappings": [field("a", "A", "date")]},
        {"field_mappings": [field("a", "A", expression="1")]}, {"match_selectors": []},
    ],
)
def test_recipes_are_refused_at_load(bad):
    with pytest.raises(RecipeError):
        build({"record_type": "t", "match_selectors": [{"xpath": "//O"}], "field_mappings": [], **bad})


def test_empty_table_and_null_document(spark):
    r = recipe([field("id", "@id")])
    empty = spark.createDataFrame([], "source_file string, content binary")
    assert E.extract(empty, r).data.count() == 0
    e = E.extract(spark.createDataFrame([("x", None)], "source_file string, content binary"), r)
    assert e.dispositions.first().reason == "input_unavailable"


def test_many_recipes_parse_once(spark, monkeypatch):
    docs = spark.createDataFrame([(f"f{k}", d) for k, d in enumerate([ORDERS, "<bad", "<Shop/>", None])], "source_file string, content string")
    ids = build({"record_type": "ids", "match_selectors": [{"xpath": "//Order"}], "field_mappings": [field("id", "@id"), field("n", "Total", "number"), field("half", type="number", expression="n / 2")]})
    lines = build({"record_type": "lines", "match_selectors": [{"xpath": "//Line", "min_occurrences": 1}], "field_mappings": [field("sku", "@sku")]})
    own = build({"record_type": "own", "match_selectors": [{"xpath": "Order"}], "field_mappings": [field("up", "ancestor::Section/@code"), field("bad", type="number", expression="1 / 0")]}, {"match_scope": "record"})
    many = E.extract_many(docs, [ids, lines, own])
    for name, r in (("ids", ids), ("lines", lines), ("own", own)):
        alone = E.extract(docs, r)
        assert sorted(map(str, many[name].data.collect())) == sorted(map(str, alone.data.collect()))
        assert sorted(map(str, many[name].dispositions.collect())) == sorted(map(str, alone.dispositions.collect()))
    plan = many["ids"].data._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "fields_1" not in plan.split("ReadSchema")[1]
    from lodestone.sources import scan

    calls = []
    plain = scan.doctree.parse_xml
    monkeypatch.setattr(scan.doctree, "parse_xml", lambda d: (calls.append(1), plain(d))[1])
    shared = {}
    for r in (ids, lines):
        list(scan.Extractor(r).rows(ORDERS.encode(), shared))
    assert len(calls) == 1
    with pytest.raises(RecipeError):
        E.extract_many(docs, [ids, ids])
