"""Sinks, inputs, index, inspection, profiles, reference tables and streams."""

import gzip
import hashlib
import json

import pytest

from lodestone.operators import index as IX
from lodestone.operators import inspect as IN
from lodestone.operators import profile as P
from lodestone.operators import sinks as S
from lodestone.plans import extract as E
from lodestone.plans.recipe import build
from lodestone.sources import inputs as I
from lodestone.sources import reference as R
from lodestone.sources import scan as SC
from lodestone.streaming import files as ST


def order(k, total):
    return f'<Order id="{k}"><Total>{total}</Total><L><X s="{k}a"/><X s="{k}b"/></L></Order>'


@pytest.fixture
def shop(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.xml").write_text('<R xmlns:q="urn:q">' + "".join(order(k, k) for k in range(5)) + "</R>")
    (d / "b.xml").write_text("<R>" + "".join(order(k, k) for k in range(5, 8)) + "</R>")
    (d / "c.xml").write_text("<R><Order></R>")
    return d


RECIPE = build({"record_type": "o", "match_selectors": [{"xpath": "//Order"}], "field_mappings": [{"output_field": "id", "xpath": "@id", "type": "integer", "description": "key"}, {"output_field": "total", "xpath": "Total", "type": "number"}, {"output_field": "xs", "xpath": "L/X", "type": "array", "item_mapping": [{"output_field": "s", "xpath": "@s"}, {"output_field": "z", "xpath": "@z"}]}]})


def extraction(spark, shop):
    return E.extract(SC.read_files(spark, str(shop)), RECIPE)


def test_ordinals_dispositions_and_manifest(spark, shop, tmp_path):
    e = extraction(spark, shop)
    assert [(r.input_ordinal, r.record_num, r.id) for r in e.data.orderBy("input_ordinal", "record_num").collect()] == [(1, k + 1, k) for k in range(5)] + [(2, k - 4, k) for k in range(5, 8)]
    m = S.manifest_of(e)
    assert (m["inputs_total"], m["inputs_applied"], m["inputs_failed"], m["records"], m["reasons"]) == (3, 2, 1, 8, {"parse_error": 1})
    S.write_dispositions(e, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d/failures")).count() == 1


@pytest.mark.parametrize(("rows", "limit"), [(3, None), (None, 700), (2, 10_000)])
def test_shards(spark, shop, tmp_path, rows, limit):
    e = extraction(spark, shop)
    out = str(tmp_path / "out")
    m = S.write_shards(e, out, rows, limit)
    env = E.envelope(e).orderBy("input_ordinal", "record_num").collect()
    want, used, count = [], 0, 0
    for r in env:
        n = len(r.value.encode()) + 1
        if not want or (limit and used + n > limit) or (rows and count >= rows):
            want.append([])
            used = count = 0
        want[-1].append(r.value)
        used, count = used + n, count + 1
    assert [s["rows"] for s in m["shards"]] == [len(w) for w in want]
    for k, w in enumerate(want):
        f = tmp_path / "out/shards" / m["shards"][k]["file"]
        assert f.read_text().splitlines() == w
        assert m["shards"][k]["sha256"] == hashlib.sha256(f.read_bytes()).hexdigest() and m["shards"][k]["bytes"] == f.stat().st_size
    assert json.loads(spark.read.text(out + "/manifest").first()[0])["records"] == 8


@pytest.mark.parametrize("seed", range(6))
def test_shards_by_bytes_are_greedy_whatever_the_ranges(spark, seed):
    import random

    r = random.Random(seed)
    sizes = [r.choice([0, 1, 3, 5, 40]) for _ in range(r.choice([1, 7, 200]))]
    limit, most = r.choice([5, 12, 100]), r.choice([None, 1, 4])
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, s long").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", r.choice(["2", "9", "30"]))
    try:
        got = {x.k: x.shard for x in S.shards_by_bytes(df, ["k"], df.s, limit, most).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, shard, used, count = {}, -1, 0, 0
    for k, n in enumerate(sizes):
        if shard < 0 or used + n > limit or (most and count >= most):
            shard, used, count = shard + 1, 0, 0
        used, count = used + n, count + 1
        want[k] = shard
    assert got == want
    assert S.shards_by_bytes(df.where("false"), ["k"], df.s, 5).count() == 0


def test_a_failed_run_leaves_no_shard(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(20).selectExpr("id div 5 as shard", "'a' as input", "cast(id as string) as value", "id")
    bad = rows.withColumn("value", F.when(F.col("id") == 17, F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no"):
        S.commit_shards(bad, ["id"], str(tmp_path / "o"))
    assert not list((tmp_path / "o").rglob("*shard*"))
    got = S.commit_shards(rows, ["id"], str(tmp_path / "o")).orderBy("shard").collect()
    assert [(m["shard"], m["rows"], m["bytes"]) for m in got] == [(0, 5, 10), (1, 5, 10), (2, 5, 15), (3, 5, 15)]
    assert sorted(p.name for p in (tmp_path / "o").rglob("*") if p.is_file() and not p.name.startswith(".")) == [m["file"] for m in got]
    with pytest.raises(FileExistsError):
        S.commit_shards(rows, ["id"], str(tmp_path / "o"))


def test_ndjson_parquet_and_output_checks(spark, shop, tmp_path):
    e = extraction(spark, shop)
    S.write_ndjson(e, str(tmp_path / "n"))
    assert spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "n")).count() == 8
    S.write_parquet(e, str(tmp_path / "p"), "zstd", ["total"])
    import pyarrow.parquet as pq

    (f, *_) = (tmp_path / "p").glob("part-*")
    meta = pq.ParquetFile(f)
    assert meta.schema_arrow.names == ["id", "xs"]
    assert not meta.metadata.row_group(0).column(0).is_stats_set and meta.metadata.row_group(0).column(0).compression == "ZSTD"
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "p")).collect()) == list(range(8))
    env = E.envelope(e)
    assert '{"s":"0a","z":null}' in env.orderBy("input_ordinal", "record_num").first().value
    assert S.invalid_envelopes(env).count() == 0 and S.sampled(env.withColumn("record_num", env.record_num + 0)).count() >= 2
    assert [r.field for r in S.column_lineage(e).collect()] == ["id", "total", "xs"]


def test_file_lists_and_integrity(spark, shop):
    a = (shop / "a.xml").read_bytes()
    text = f'# list\n{shop}/b.xml\n\n{json.dumps({"uri": f"{shop}/a.xml", "size": len(a), "sha256": hashlib.sha256(a).hexdigest()})}\n{json.dumps({"uri": f"{shop}/c.xml", "size": 1})}\n{shop}/none.xml\n'
    listed = I.parse_file_list(text)
    docs = I.verified(SC.read_files(spark, str(shop)), I.declared_frame(spark, listed))
    got = {r.input_ordinal: r.input_problem for r in docs.collect()}
    assert got == {1: None, 2: None, 3: "size_mismatch", 4: "input_unavailable"}
    for bad in ("{", '{"uri": 1}', '{"uri": "x", "size": -1}', '{"uri": "x", "more": 1}'):
        with pytest.raises(I.InputError):
            I.parse_file_list(bad)
    assert [r.input_ordinal for r in I.discover(spark, str(shop), "*.xml", "c*").collect()] == [1, 2]


def test_gzip_and_index_routes_agree(spark, shop, tmp_path):
    z = tmp_path / "z"
    z.mkdir()
    (z / "a.xml.gz").write_bytes(gzip.compress((shop / "a.xml").read_bytes()))
    assert E.extract(SC.read_files(spark, str(z)), RECIPE).data.count() == 5
    (shop / "c.xml").unlink()
    ix = IX.build(SC.read_files(spark, str(shop)), "Order").cache()
    assert ix.count() == 8 and IX.verify(ix).count() == 0
    docs = IX.wrap(IX.read_ranges(ix)).select("source_file", "start_offset", "content")
    own = build({"record_type": "o", "match_selectors": [{"xpath": "/Order"}], "field_mappings": [{"output_field": "id", "xpath": "@id", "type": "integer"}, {"output_field": "total", "xpath": "Total", "type": "number"}]})
    got = E.extract(docs, own)
    assert sorted((r.id, r.total) for r in got.data.collect()) == sorted((r.id, r.total) for r in extraction(spark, shop).data.collect())
    s = IX.size_stats(ix).first()
    assert s.records == 8 and s.smallest == s.p50 == s.largest
    (shop / "b.xml").write_text("<R/>")
    assert {r.problem for r in IX.verify(ix).collect()} == {"size 4, indexed " + str(ix.where("source_file like '%b.xml'").first().file_size)}
    with pytest.raises(Exception, match="can't be indexed"):
        IX.build(SC.read_files(spark, str(z)), "Order").count()
    (z / "none.xml").write_bytes(b"")
    assert {r.source_file[-6:]: r.reason for r in E.extract(SC.read_files(spark, str(z)), RECIPE).dispositions.collect()} == {"xml.gz": None, "ne.xml": "parse_error"}


def test_namespaces_in_scope_go_with_a_record(spark, tmp_path):
    (tmp_path / "n.xml").write_text('<R xmlns:q="urn:q" xmlns="urn:d"><q:Order id="1"><q:V>x</q:V></q:Order></R>')
    ix = IX.build(SC.read_files(spark, str(tmp_path)), "Order")
    docs = IX.wrap(IX.read_ranges(ix)).select("source_file", "content")
    r = build({"record_type": "o", "namespaces": {"a": "urn:q"}, "match_selectors": [{"xpath": "/a:Order"}], "field_mappings": [{"output_field": "v", "xpath": "a:V"}]})
    assert [x.v for x in E.extract(docs, r).data.collect()] == ["x"]


def test_inspection_and_starter_recipe(spark, shop):
    (shop / "c.xml").unlink()
    docs = SC.read_files(spark, str(shop))
    rows = IN.paths(docs).cache()
    report = {r.path: (r.n, r.docs) for r in IN.path_report(rows).collect()}
    assert report["/R/Order"] == (8, 2) and report["/R/Order/L/X/@s"] == (16, 2)
    raw = IN.starter_recipe(docs)
    assert raw["match_selectors"] == [{"xpath": "//Order"}]
    assert {m["output_field"]: m["type"] for m in raw["field_mappings"]} == {"id": "integer", "l_x": "array", "total": "integer"}
    got = E.extract(docs, build(raw))
    assert got.data.count() == 8
    j = spark.createDataFrame([("d", b'{"a":[{"k":1,"m":null},{"k":"x"}]}')], "source_file string, content binary")
    kinds = {r.path: (r.n_string, r.n_number, r.n_null) for r in IN.value_kinds(IN.paths(j, "json")).collect()}
    assert kinds == {"/a": (0, 0, 0), "/a/k": (1, 1, 0), "/a/m": (0, 0, 1)}
    bad = spark.createDataFrame([("d", b"\x1f\x8b..")], "source_file string, content binary")
    assert IN.paths(bad).first().kind == "error"
    enc = spark.createDataFrame([("u", b"\xff\xfe<\0"), ("w", b'<?xml version="1.0" encoding="windows-1252"?>'), ("n", b"<a/>")], "source_file string, content binary")
    assert {r.doc: r.encoding for r in IN.encodings(enc).collect()} == {"u": "utf-16-le", "w": "windows-1252", "n": "utf-8"}
    assert IN._key_step("a b") == "*[local-name()='a b']" and IN._key_step("both'and\"") == "*[local-name()=concat('both',\"'\",'and\"')]"
    names = spark.createDataFrame([("d1", "us-gaap"), ("d1", "Order"), ("d2", "Item")], "doc string, name string")
    pats = spark.createDataFrame([("gaap", "us-*", 2.0), ("gaap", "Nope", 2.0), ("shop", "Ord*", 1.0), ("shop", "Item", 1.0)], "dialect string, pattern string, weight double")
    assert {r.doc: (r.dialect, r.score) for r in IN.detect_dialect(names, pats).collect()} == {"d1": ("gaap", 0.5), "d2": ("shop", 0.5)}


def test_profiles_are_closed_by_default(spark):
    df = spark.createDataFrame([("a", 1.0, "x1")] * 6 + [("b", 2.5, "x2")] * 2 + [(None, 3.0, "é")], "k string, v double, s string")
    c = P.ProfileConfig.of({"fields": [{"field": "k", "safe_to_profile": True, "sensitivity": "public", "protection_tags": ["quasi_identifier"]}, {"field": "v", "safe_to_profile": True, "sensitivity": "internal"}, {"field": "s", "safe_to_profile": True, "sensitivity": "public", "protection_tags": ["direct_identifier"]}]})
    assert sorted((r.field, r.value, r.n) for r in P.value_counts(df, c).collect()) == [("k", "a", 6), ("v", "1", 6), ("v", "2.5", 2), ("v", "3", 1)]
    rows = {r.field: r for r in P.profile(df, c).collect()}
    assert (rows["k"].tier, rows["k"].count_, rows["k"].nulls) == ("enumeration", 9, 1) if hasattr(rows["k"], "count_") else rows["k"].tier == "enumeration"
    assert (rows["v"].low, rows["v"].high) == (1.0, 3.0)
    assert (rows["s"].tier, rows["s"].shape, rows["s"].len_min, rows["s"].low) == ("aggregates", "opaque_string", 2, None)
    small = P.ProfileConfig.of({"max_distinct": 2, "fields": [{"field": "v", "safe_to_profile": True, "sensitivity": "public"}, {"field": "k", "protection_tags": ["linkage_key"]}]})
    got = {r.field: (r.tier, r.status, r.distinct) for r in P.profile(df, small).collect()}
    assert got == {"v": ("aggregates", "high_cardinality_capped", ">=2"), "k": ("aggregates", "complete", "<5")}
    with pytest.raises(P.ProfileError):
        P.ProfileConfig.of({"fields": [{"field": "k", "protection_tags": ["odd"]}]})


def test_reference_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("code,name\n1,one\n2,\n")
    t = R.load(spark, {"name": "t", "source": "t.csv", "format": "csv", "key_column": "code", "value_column": "name", "max_rows": 10}, str(tmp_path))
    m = R.load(spark, {"name": "m", "source": "t.csv", "format": "csv", "column": "code"}, str(tmp_path))
    r = build({"record_type": "o", "match_selectors": [{"xpath": "//Order"}], "field_mappings": [{"output_field": "id", "xpath": "@id"}, {"output_field": "name", "expression": "lookup_reference('t', id, 'none')"}, {"output_field": "in", "type": "boolean", "expression": "in_reference('m', id) && !in_reference('m', '9')"}]})
    docs = spark.createDataFrame([("f", b'<R><Order id="1"/><Order id="2"/><Order id=" 3"/><Order id=""/></R>')], "source_file string, content binary")
    got = E.extract(docs, r, references=[t, m]).data.orderBy("record_num").collect()
    assert [(x.id, x.name, x["in"]) for x in got] == [("1", "one", True), ("2", "", True), ("3", "none", False), ("", "none", False)]
    (tmp_path / "d.csv").write_text("code,name\n1,a\n1,b\n")
    for decl in ({"source": "d.csv", "key_column": "code", "value_column": "name"}, {"source": "t.csv", "column": "x"}, {"source": "t.csv", "column": "code", "max_rows": 1}, {"source": "../t.csv", "column": "code"}):
        with pytest.raises(R.ReferenceError_):
            R.load(spark, {"name": "d", "format": "csv", **decl}, str(tmp_path))


def test_a_folder_as_a_stream(spark, shop, tmp_path):
    out = str(tmp_path / "s")
    for _ in range(2):
        q = ST.extract_stream(ST.stream_files(spark, str(shop), "*.xml", 2), RECIPE, ST.parquet_sink(out), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert spark.read.parquet(out + "/data").count() == 8 and spark.read.parquet(out + "/dispositions").count() == 3
    lines = []
    ev = ST.RunEvents(lines.append, "r1")
    ev.emit("started")
    ev.emit("progress", done=1)
    ev.emit("completed")
    assert [json.loads(x)["event"] for x in lines] == ["started", "progress", "completed"]
    with pytest.raises(RuntimeError):
        ev.emit("failed")


def test_the_profile_of_a_run_leaves_failed_inputs_out(spark, tmp_path):
    """In the pass that writes and in one of its own: the same; values beyond the limit stop growing in each task."""
    docs = spark.createDataFrame([(f"f{k}", "<R>" + "".join(f"<O><c>{c}</c><n>{j}</n></O>" for j, c in enumerate(cs)) + "</R>") for k, cs in enumerate([["a", "b", "a"], ["secret", "x", ""], ["b"], ["c", "d"]])], "source_file string, content string").repartition(3)
    raw = {"record_type": "o", "match_selectors": [{"xpath": "//O", "min_occurrences": 1}], "field_mappings": [{"output_field": "c", "xpath": "c"}, {"output_field": "n", "xpath": "n", "type": "integer"}], "output_schema": {"properties": {"c": {"maxLength": 2}}}}
    public = {"safe_to_profile": True, "sensitivity": "public"}
    r = build(raw, None, {"defaults": {"value_profile": {"max_distinct": 4, "fields": [{"field": "c", **public}, {"field": "n", **public}, {"field": "gone"}]}}})
    e = E.extract(docs, r)
    m = S.write_shards(e, str(tmp_path / "p"), 2)
    want = {"c": {"tier": "enumeration", "status": "complete", "count": 6, "nulls": 0, "distinct": "4", "values": {"a": 2, "b": 2, "c": 1, "d": 1}}, "n": {"tier": "enumeration", "status": "complete", "count": 6, "nulls": 0, "distinct": "3", "low": 0.0, "high": 2.0, "values": {"0": 3, "1": 2, "2": 1}}}
    assert {k: m["value_profile"][k] for k in ("c", "n")} == want and m["value_profile"]["gone"]["nulls"] == 6
    assert P.run_profile(e) == m["value_profile"] and [s["rows"] for s in m["shards"]] == [2, 2, 2]
    state = P.FieldState(3)
    import pyarrow as pa

    for k in range(20):
        state.observe(pa.array([f"v{k}", None, ""]))
    assert state.capped and not state.vals and (state.count, state.nulls) == (60, 40)


def test_a_workspace_holds_its_reference_tables(spark, tmp_path):
    from lodestone.plans.recipe import RecipeError, load_workspace

    w = tmp_path / "w"
    w.mkdir()
    (w / "x.yaml").write_text("record_type: o\nmatch_selectors: [{xpath: //O}]\nfield_mappings: [{output_field: a, type: boolean, expression: \"in_reference('t', 'x')\"}]\n")
    (w / "recipe.yaml").write_text("id: r\nassets: {extract: x.yaml}\n")
    with pytest.raises(RecipeError, match="undeclared"):
        load_workspace(str(w))
    (w / "recipe.yaml").write_text("id: r\nassets: {extract: x.yaml}\ndefaults: {reference_tables: [{name: t, source: t.csv, format: csv, column: k}]}\n")
    (w / "t.csv").write_text("k\nx\n")
    (decl,) = load_workspace(str(w)).reference_tables
    assert R.load(spark, decl, str(w)).rows == 1
    (tmp_path / "out.csv").write_text("k\nx\n")
    (w / "t.csv").unlink()
    (w / "t.csv").symlink_to(tmp_path / "out.csv")
    for bad in (decl, {**decl, "source": "../out.csv"}):
        with pytest.raises(R.ReferenceError_, match="outside"):
            R.load(spark, bad, str(w))
