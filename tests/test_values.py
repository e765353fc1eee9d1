"""JSON records by the values of the C scanner: what the trees give, and no more tasks than the bytes ask for."""

import itertools
import json

from lodestone.plans import routes as RT
from lodestone.plans.recipe import build
from lodestone.sources import scan, values
from lodestone.sources.scan import Extractor


def field(name, xpath, kind="string", **more):
    return {"output_field": name, "xpath": xpath, "type": kind, **more}


def recipe(maps, selector="row", fmt="ndjson", **more):
    return build({"record_type": "o", "match_selectors": [{"xpath": selector, **more}], "field_mappings": maps}, {"format_type": fmt})


FIELDS = [
    field("s", "a"), field("deep", "a/b/c"), field("i", "a", "integer"), field("n", "n", "number"), field("b", "a", "boolean"), field("there", "a", "boolean", transform="exists"), field("cut", "a", transform="trim"),
    field("all", "a", "array"), field("items", "a", "array", item_mapping=[field("b", "b"), field("n", "n", "number"), field("c", "b/c", "array")]), field("dot", "."), field("count", "count(a)", "integer"), field("late", "a[2]"),
    field("poly", "a", "array", polymorphic_mapping=[{"item_type": "x", "match_xpath": "b", "field_mappings": [field("c", "c")]}]),
]
ODD = [
    b"{}", b'{"a":1}', b' { "a" : " 7 " } ', b'{"a":null}', b'{"a":[]}', b'{"a":[null,2]}', b'{"a":[[1,2],[3]]}', b'{"a":{"b":{"c":[1,"x",true,null,{"d":2}]}}}', b'{"a":[{"b":1,"n":1.50},{"b":[{"c":"y"},{"c":[5]}],"n":"2"},3]}', b'{"a":1,"a":2}', b'{"a":{"k":1,"\\u006b":2}}',
    b'{"a":12345678901234567890123,"n":1e5}', b'{"n":-0.10E+2,"a":false}', b'{"n":NaN}', b'{"n":"NaN"}', b'{"n":"inf"}', b'{"a":-Infinity}', b'{"a":01}', b'{"a":1.}', b'{"a":.5}', b'{"a":+1}', b'{"a":"x","n":"y"}', b'{"a":"\\ud83d\\ude00 \\u00e9"}', b'{"a":"\\ud83d"}', b'{"a":"\\udc00\\n"}',
    '{"a":"é😀\x7f"}'.encode(), b'{"a":"\xff"}', b'{"a":"\xed\xa0\x80"}', b'{"a":"\x01"}', b'{"a":"\\x"}', b'{"a":"\\/\\b\\""}', b"[1]", b'[{"a":1}]', b"5", b"", b" ", b"\r", b'{"a":1}\r', b'\xef\xbb\xbf{"a":1}', b"\xef\xbb\xbf", b'{"a":1}x', b'{"a":1,}', b"{'a':1}", b'{"a":1} {"a":2}', b'{"a"', b'{"a":\x00}', b'{\x0c"a":1}',
    b'{"a":1}\n\n {"a":2}\r\n', b'{"a":1}\n{"a":', b'{"a":"x"}\n{', b'{"a":' * 70 + b"1" + b"}" * 70, b'{"a":' + b"[" * 1100 + b"]" * 1100 + b"}", b'{"a":[' + b'{"b":1},' * 90 + b'{"b":2}]}', b'{"o":{"a":{"a":1,"n":2},"x":[{"a":[3,{"a":4}]}]},"a":{"b":5}}', b'{"a":[' + b"1," * 3000 + b"1]}",
]


def test_values_give_what_the_trees_give():
    fast = 0
    for m, (fmt, select) in itertools.product(FIELDS, [("ndjson", "row"), ("json", "/a"), ("json", "//a"), ("json", "o/x"), ("json", "a/b"), ("json", "//a/b"), ("json", "//*"), ("json", "a[1]")]):
        r = recipe([m, field("_n", "n", "number")], select, fmt, min_occurrences=2 * (select in ("row", "//a")))
        a, b = Extractor(r), Extractor(r)
        fast += a.values is not None
        b.values = None
        for d in ODD:
            assert repr(list(a.rows(d))) == repr(list(b.rows(d))), (m, select, d)
    assert fast == 5 * 9


def test_plain_lines_are_read_without_trees(monkeypatch):
    monkeypatch.setattr(scan.doctree, "parse_json", lambda *a, **k: 1 / 0)
    r = recipe(FIELDS[:9])
    rows = [x for line in (b'{"a":"1","n":2.0}', b"", '{"a":"1","q":"é\\u00e9"}'.encode()) for x in Extractor(r).rows(line)]
    assert [x.get("record_num") for x in rows] == [1, None, 1] and rows[0]["fields"]["n"] == 2.0


def test_an_array_in_an_array_takes_the_trees():
    assert values.text({"a": [True, None, {"b": "x"}]}) == "truex"
    for data in (b'{"a":"\\uD800"}', b"[1]", b'{"a":1,"a":1}', b'{"a":NaN}'):
        try:
            values.parsed(data)
        except values.Outside:
            continue
        raise AssertionError(data)


def test_small_splits_make_no_small_tasks(spark, tmp_path, monkeypatch):
    """Lines of many splits are numbered over their files, by a few tasks."""
    for f, many in (("a", 5000), ("b", 3000), ("c", 1)):
        (tmp_path / f"{f}.ndjson").write_text("".join(json.dumps({"id": k, "pad": "x" * (k % 50)}) + "\n" * (1 + k % 2) for k in range(many)))
    staged = []
    plain = RT.written

    def written(df, name):
        out = plain(df, name)
        staged.extend([out] if name == "extracted" else [])
        return out

    monkeypatch.setattr(RT, "written", written)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    e = RT.extract_lines(spark, str(tmp_path), recipe([field("id", "id", "integer")]), split=2048)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert staged[0].select("file", "block").distinct().count() > 50 and len(staged[0].inputFiles()) <= 4 * spark.sparkContext.defaultParallelism
    got = sorted((r.source_file[-8], r.record_num, r.id) for r in e.data.collect())
    assert got == [(f, k + 1, k) for f, many in (("a", 5000), ("b", 3000), ("c", 1)) for k in range(many)]


def test_records_of_json_are_found_whole(monkeypatch):
    """Records are found by one scan each; those that hold records, escapes or faults, or go on, give what their tokens give."""
    import io
    import random

    from lodestone.sources import pieces as P

    tokens = []
    plain = P._JSON

    class Counted:
        def match(self, *a):
            tokens.append(1)
            return plain.match(*a)

    monkeypatch.setattr(P, "_JSON", Counted())
    whole = json.dumps({"o": [{"a": k, "b": {"c": [k, "x"]}} for k in range(500)]}).encode()
    assert len(list(P.json_records(io.BytesIO(whole), "o"))) == 500 and len(tokens) < 500 * 3
    monkeypatch.setattr(P, "_JSON", plain)

    def found(data, step, fast):
        monkeypatch.setattr(P, "_whole", own if fast else lambda *a: -1)
        out = []
        try:
            out.extend(P.json_records(io.BytesIO(data), "é", step))
        except P.DocumentError as e:
            return str(e)
        return out

    own, r = P._whole, random.Random(5)
    bodies = ['{"a":1}', '{"a":1,"a":2}', '{"\\u00e9":{"a":2}}', '{"é":[{"x":1},2]}', '{"k":"é"}', '{"é":1,"\\u00e9":2}', '{"/":1,"\\/":2}', '{"a":NaN}', '{"a":01}', '{"a":"\\ud800"}', '{"a":[[{"é":3}]]}', '{"a":"\x01"}', "{}", "3", "[{}]", '{"a" :\n"é😀}{"}', "{" * 3, '{"a":' * 1030 + "1" + "}" * 1030, '{"a":' * 900 + "1" + "}" * 900, '{"b":1]']
    for k in range(300):
        few = [r.choice(bodies[:1] * 9 + bodies) for _ in range(r.randrange(6))]
        data = ('{"q":' * (150 * (k % 2)) + '{"é":[' + ", ".join(few) + "]}" + "}" * (150 * (k % 2))).encode()[: r.choice((None, None, -1))]
        for step in (1, 7, 1 << 20):
            assert found(data, step, True) == found(data, step, False), (few, step)
    assert found(b'{"\xc3\xa9":[{"a":"\xff"}]}', 1 << 20, True) == "invalid UTF-8"


def test_json_records_are_numbered_as_they_are_found(spark, tmp_path, monkeypatch):
    from lodestone.operators import index as IX

    for f in "ab":
        (tmp_path / f"{f}.json").write_text(json.dumps({"o": [{"id": k, "o": {"x": 1}} if k % 5 == 0 else {"id": k} for k in range(300)]}))
    files = spark.createDataFrame([(str(f), f.stat().st_size) for f in tmp_path.iterdir()], "source_file string, size_bytes long")
    seen = []
    plain = IX.written

    def written(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, name)

    monkeypatch.setattr(IX, "written", written)
    rows = IX.build_index(files, "o", "json").records.collect()
    plan = dict(seen)["index-records"]
    assert "row_number" not in plan and "from_json" not in plan.lower() and "jsontostructs" not in plan.lower()
    for f in "ab":
        own = sorted((x for x in rows if x.source_file.endswith(f"{f}.json")), key=lambda x: x.start_offset)
        assert [x.record_num for x in own] == list(range(1, 361)) and {x.namespaces for x in own} == {""}
