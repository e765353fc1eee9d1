"""What keeps large tables cheap: steps computed once, small trees, outcomes that hold no file."""

from lodestone.plans import queries as Q


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_steps_of_a_grouped_reconciliation_are_computed_once(spark):
    plan = optimized(Q.QUERIES["reconciliation_cap_to_base"](spark, "/root/testdata/sf0.001"))
    assert plan.count("array_distinct(") == 1 and plan.count("aggregate(") <= 8


def test_fields_of_native_recipes_are_computed_once(spark):
    plan = optimized(Q.QUERIES["native_item_mapping"](spark, "/root/testdata/sf0.001"))
    assert plan.count("failed to parse number") == 2 and plan.count("failed to parse integer") == 3


ODD = [
    b"<R><Order id='1'>x<!--c-->y<?p q?>z<Total> 7 </Total>t<!--d-->u</Order></R>",
    b"<Order id='2' xml:lang='e'><Order id='3'><Total>x</Total></Order><Total>1_0</Total><Total>5</Total></Order>",
    b"<R><Order id='4'><Total>NaN</Total></Order><Order id='x'/></R>", b"<R><Order id='4'><Total>1</Total></Order><Order id='x'/></R>",
    b"<R><Order/><Order id=' 12 '><Total><a>1</a>2<b/></Total><Tag> </Tag><Tag>a<b>c</b></Tag></Order></R>",
    b"<R xmlns='u'><Order id='5'><Total>1</Total></Order></R>", b"<!DOCTYPE R [<!ENTITY e 'f'>]><R><Order id='6'><Tag>&e;</Tag></Order></R>",
    b"<R><Order>", b"", b"<R>&e;</R>", b"<R/>", b"<p:R/>", "<?xml version='1.0' encoding='latin-1'?><R><Order id='7'><Tag>\xe9</Tag></Order></R>".encode("latin-1"),
    "<R><Order id='8'><Tag>\xe9\U0001f600</Tag><Total>-1.50</Total><Flag>no</Flag></Order></R>".encode("utf-16"), b"<R><Order id='9'><Tag><![CDATA[<a>]]>&amp;&#65;</Tag><Lines><Line no='1'><Q>2</Q></Line><Line><Q>3</Q></Line></Lines></Order></R>",
]


def test_elements_give_what_the_evaluator_gives():
    import itertools

    from lodestone.sources.scan import Extractor
    from tests.test_native import DOC, FIELDS, field, recipe

    more = [
        field("whole", "."), field("text", "string(Tag[2])"), field("sub", "substring(Tag, 1, 2)"), field("t", "translate(Tag, 'ab', 'c')"), field("re", "replace(Tag, 'a', 'b')"), field("lang", "@lang"), field("mod", "count(Tag) mod 2", "number"),
        field("round", "round(sum(Total) * 10) div 10", "number"), field("fallback", "Tag/following-sibling::*"), field("match", "matches(Tag, 'a')", "boolean"), field("last", "Tag[last()]"), field("deep", "Total//b"), field("attrs", "@*", "array"),
        field("poly", "Lines", "array", polymorphic_mapping=[{"item_type": "a", "match_xpath": "Line[@no]", "field_mappings": [field("q", "Q", "number")]}, {"match_xpath": "Line", "field_mappings": [field("no", "@no", "integer")]}]),
    ]
    fast = 0
    for m, select in itertools.product([*FIELDS, *more, field("n", "@id", "number")], ("//Order", "/R/Order", "Order", "//Order[@id > 2 or Total]", "/R/Order[2]", "//Order[1]")):
        r = recipe([m, field("_total", "Total", "number")], select)
        a, b = Extractor(r), Extractor(r)
        fast += a.plain is not None
        b.plain = None
        for d in (*ODD, DOC.encode()):
            assert repr(list(a.rows(d))) == repr(list(b.rows(d))), (m, select, d)
    assert fast > 180


def test_small_documents_are_read_without_trees(monkeypatch):
    from lodestone.sources import doctree
    from lodestone.sources.scan import Extractor

    monkeypatch.setattr(doctree, "parse_xml", lambda data: 1 / 0)
    (row,) = Extractor(Q.recipe([*Q.BASIC, Q.LINES], "//Order[Lines/Line]")).rows(b"<Orders><Order id='1'><Total>2</Total><Lines><Line no='3'/></Lines></Order></Orders>")
    assert row["fields"]["order_id"] == 1 and row["fields"]["lines"][0]["no"] == 3


def test_large_documents_are_read_record_by_record(monkeypatch):
    from lodestone.sources import scan
    from lodestone.sources.scan import Extractor

    body = b"".join(b"<Order id='%d'><Total>%d</Total>\n</Order><Other><x/></Other>" % (k, k) for k in range(12_000))
    nested = body + b"<Order id='a'><Order id='7'/></Order>"
    r = Q.recipe([Q.field("id", "@id"), Q.field("total", "Total", "number")], namespaces={"q": "u"})
    ex = Extractor(r)
    assert ex.streamed(b"<R>" + nested + b"</R>") is None
    monkeypatch.setattr(scan, "STREAMED", 1 << 16)
    for d in (b"<R>" + nested + b"</R>", b"<R>" + body, b"<R>" + body.replace(b">77<", b">x<") + b"</R>"):
        slow = Extractor(r)
        slow.plain = None
        want = list(slow.rows(d))
        (common,), chunks = ex.streamed(d)
        got = [common | {"record_num": k, "fields": f} for k, f in enumerate((f for c in chunks for f in c.to_pylist()), 1)] or [common]
        keys = ("record_num", "fields", "disposition", "reason", "error", "late", "selector_counts")
        assert [[x.get(k) for k in keys] for x in got] == [[x.get(k) for k in keys] for x in want]


def test_waiting_rows_hold_equal_texts_once():
    import pyarrow as pa

    from lodestone.plans.extract import _packed, _unpacked

    b = pa.RecordBatch.from_pylist([{"k": j, "s": "x" * 200, "n": None if j % 2 else "y", "d": {"t": str(j)}} for j in range(5000)])
    p = _packed(b.slice(1000))
    assert p.nbytes < b.nbytes / 5 and _unpacked(p, b.schema).equals(b.slice(1000))


def test_records_do_not_carry_their_documents_content(spark, monkeypatch):
    import types

    import pyarrow as pa
    import pyspark
    from pyspark.sql.classic.dataframe import DataFrame

    from lodestone.sources.scan import scan

    held = {}
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **k: held.setdefault("run", f))
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    scan(spark.createDataFrame([], "source_file string, content string"), Q.recipe([Q.field("id", "@id")]))
    content = b"<R>" + b"<Order id='a'/>".join([b" " * 100] * 2001) + b"</R>"
    b = pa.RecordBatch.from_arrays([pa.array(["x", "y"]), pa.array([content, b"<R/>"])], ["source_file", "_content"])
    pool = pa.proxy_memory_pool(pa.default_memory_pool())
    before = pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        rows = [r["source_file"] for x in held["run"](iter([b])) for r in x.to_pylist()]
    finally:
        pa.set_memory_pool(before)
    assert rows == ["x"] * 2000 + ["y"] and pool.max_memory() < 10 * len(content)
