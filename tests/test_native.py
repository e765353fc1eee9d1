"""Recipes compiled to Columns against the evaluator, on the same files."""

import pytest

from lodestone.plans import native as N
from lodestone.plans import routes as RT
from lodestone.plans.extract import extract
from lodestone.plans.recipe import build
from lodestone.sources.scan import read_files

DOC = """<?xml version="1.0"?><Shop><Section code="S">
<Order id="1" status="open"><Customer> Ann &amp; Co </Customer><Total>42.50</Total><Empty/><Lines><Line no="1"><Q>2</Q><F>N</F></Line><Line no="2"><Q/><F>R</F></Line><Line no="3"><Q>x</Q><F>R</F></Line></Lines><Tag>a</Tag><Tag> </Tag><Tag>b</Tag></Order>
<Order id="2"><Customer/><Lines/><Note k="v">txt  is
 here</Note><Note>b<![CDATA[ <c> ]]></Note><Flag>YES</Flag></Order>
<Order id="30" status="held"><Total> 7 </Total><Lines><Line no="9"><Q>1.5</Q></Line></Lines><Flag>off</Flag><Note k="w"/></Order>
</Section></Shop>"""


def field(name, xpath, type="string", **more):
    return {"output_field": name, "xpath": xpath, "type": type, **more}


FIELDS = [
    field("id", "@id", "integer"), field("status", "@status"), field("customer", "Customer"), field("total", "Total", "number"), field("empty", "Empty"), field("flag", "Flag", "boolean"),
    field("has", "Lines/Line", "boolean", transform="exists"), field("r", "Lines/Line[F='R']", "boolean", transform="exists"), field("none", "Lines/Line[@no > 8]", "boolean", transform="exists"),
    field("tags", "Tag", "array"), field("nos", "Lines/Line/@no", "array"), field("n", "count(Lines/Line)", "integer"), field("nr", "count(Lines/Line[F='R' and @no != 3])", "integer"), field("sum", "sum(Lines/Line/Q)", "number"),
    field("lines", "Lines/Line", "array", item_mapping=[field("no", "@no", "integer"), field("f", "F"), field("late", "boolean(@no > 1)", "boolean"), field("q", "Q")]),
    field("first", "Lines/Line[1]/@no"), field("second", "Tag[2]"), field("note", "Note[@k='v']"), field("k", "Note/@k"), field("plain", "normalize-space(Note)"), field("low", "lower-case(Customer)", transform="upper"),
    field("joined", "concat(@id, '-', Customer, '-', @status)"), field("before", "substring-before(Customer, ' &')"), field("after", "substring-after(Customer, 'n ')"), field("starts", "starts-with(Customer, ' A')", "boolean"),
    field("ends", "ends-with(@status, 'en')", "boolean"), field("dear", "Total > 10 or not(Total)", "boolean"), field("size", "string-length(Customer)", "integer"), field("half", "(count(Tag) + 1) div 2", "number"), field("neg", "-count(Tag) * 3", "number"),
    field("whole", "floor(sum(Lines/Line/Q))", "integer"), field("bool", "boolean(Empty)", "boolean"), field("eq", "@id = 30", "boolean"),
]


def recipe(maps, selector="//Order", **more):
    return build({"record_type": "o", "match_selectors": [{"xpath": selector, **more}], "field_mappings": maps})


def same(spark, path, r):
    a, b = extract(read_files(spark, path), r), RT.extract_native(spark, path, r)
    one, two = ([sorted(map(str, df.collect())) for df in (e.data.drop("size_bytes", "input_ordinal", "input_sha256"), e.dispositions.select("source_file", "disposition", "reason", "records"))] for e in (a, b))
    assert one == two
    return one


def test_columns_say_what_the_evaluator_does(spark, tmp_path):
    (tmp_path / "a.xml").write_text(DOC)
    (tmp_path / "b.xml").write_text("<Shop/>")
    (tmp_path / "c.xml").write_text(DOC.replace('id="30"', 'id="31"'))
    data, _ = same(spark, str(tmp_path), recipe(FIELDS))
    assert len(data) == 6
    for selector in ("//Order[@status='held' or Total > 40]", "//Order[Lines/Line]", "//Order[not(@status)]"):
        same(spark, str(tmp_path), recipe(FIELDS[:16], selector))
    more = [*FIELDS[:4], {"output_field": "double", "type": "number", "expression": "total * 2"}]
    assert len(same(spark, str(tmp_path), recipe(more, "//Order[Total]"))[0]) == 4
    plan = extract(N.scan_native(spark, str(tmp_path), recipe(FIELDS)), recipe(FIELDS), scanned=True, settle=False).data._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Exchange" not in plan


def test_outcomes_are_those_of_the_evaluator(spark, tmp_path):
    (tmp_path / "bad.xml").write_text(DOC.replace(">42.50<", ">4x<"))
    (tmp_path / "good.xml").write_text(DOC)
    (tmp_path / "few.xml").write_text("<Shop><Order id='1'/></Shop>")
    same(spark, str(tmp_path), recipe(FIELDS[:6]))
    same(spark, str(tmp_path), recipe(FIELDS[:3], min_occurrences=2))
    items = [field("lines", "Lines/Line", "array", item_mapping=[field("no", "@no", "integer"), field("q", "Q", "number")])]
    _, outcomes = same(spark, str(tmp_path), recipe(items))
    assert sum("internal_error" in o for o in outcomes) == 2  # a line of both has the quantity x


@pytest.mark.parametrize("maps", [
    [field("a", "ancestor::S/@c")], [field("a", "matches(A, 'x')")], [field("a", ".")], [field("a", "/R/A")], [field("a", "A[last()]")], [field("a", "A"), field("b", "A/B")], [field("a", "count(A)")],
    [field("a", "A", "array", polymorphic_mapping=[{"item_type": "x", "field_mappings": [field("b", "B")]}])], [field("a", "A | B")], [field("a", "A = B", "boolean")],
])
def test_what_columns_cannot_say_is_refused(spark, maps):
    assert N.native_reason(recipe(maps))
    assert N.native_reason(recipe(FIELDS)) is None and N.native_reason(recipe(FIELDS, "//S/Order")) and N.native_reason(recipe(FIELDS, "Order")) and N.native_reason(recipe(FIELDS, "//Order[2]"))
