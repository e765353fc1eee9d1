"""Routes give the same records; manifests, descriptors and the command line."""

import json

import pytest

from lodestone.__main__ import main, parameters
from lodestone.operators import artifacts as A
from lodestone.plans import routes as RT
from lodestone.plans.extract import extract
from lodestone.plans.recipe import build
from lodestone.sources.scan import read_files

MAPS = [{"output_field": "id", "xpath": "@id", "type": "integer"}, {"output_field": "total", "xpath": "Total", "type": "number"}, {"output_field": "open", "xpath": "@open", "type": "boolean"}]


def recipe(selector="//Order", maps=MAPS, fmt="xml", **more):
    return build({"record_type": "o", "match_selectors": [{"xpath": selector}], "field_mappings": maps, **more}, {"format_type": fmt})


@pytest.fixture
def shop(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for f in "ab":
        (d / f"{f}.xml").write_text("<R><S>" + "".join(f'<Order id="{k}" open="{"yes" if k % 2 else "off"}"><Total> {k}.5 </Total><Note>é {k}</Note></Order>\n' for k in range(40)) + "</S></R>")
    return d


def rows(df):
    return sorted((r.id, r.total, r.open) for r in df.collect())


def test_routes_agree(spark, shop, monkeypatch):
    r = recipe()
    whole = rows(extract(read_files(spark, str(shop)), r).data)
    assert len(whole) == 80 and rows(RT.extract_records(spark, str(shop), r).data) == whole
    assert rows(RT.extract_native(spark, str(shop), r).data) == whole
    monkeypatch.setattr(RT, "LARGE", 1000)
    assert rows(RT.extract_files(spark, str(shop), r).data) == whole
    monkeypatch.setattr(RT, "LARGE", 1 << 30)
    assert rows(RT.extract_files(spark, str(shop), r).data) == whole


def test_json_records_by_range(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"R": {"Order": [{"id": k, "Total": k, "open": True} for k in range(9)]}}))
    (tmp_path / "b.ndjson").write_text("\n".join(json.dumps({"id": k, "Total": k, "open": True}) for k in range(7)))
    maps = [{**m, "xpath": m["xpath"].removeprefix("@")} for m in MAPS]
    r = recipe(maps=maps, fmt="json")
    assert rows(RT.extract_records(spark, str(tmp_path / "a.json"), r).data) == rows(extract(read_files(spark, str(tmp_path / "a.json")), r).data) and len(rows(RT.extract_records(spark, str(tmp_path / "a.json"), r).data)) == 9
    n = recipe("row", maps, "ndjson")
    assert len(rows(RT.extract_records(spark, str(tmp_path / "b.ndjson"), n).data)) == 7


def test_route_choice():
    assert RT.choose_route(recipe(), 10) == "document" and RT.choose_route(recipe(), RT.LARGE + 1) == "records"
    assert RT.choose_route(recipe(maps=[{"output_field": "id", "xpath": "id"}], fmt="ndjson"), 1) == "lines"
    for bad in (recipe("//Order[@id]"), recipe(maps=[{"output_field": "up", "xpath": "../@x"}])):
        assert RT.choose_route(bad, 10) == "document"
        assert RT.choose_route(bad, RT.LARGE + 1) == "unsupported"
    assert RT.choose_route(recipe(), RT.LARGE // 9, "x.gz") == "unsupported"


def test_manifests_and_descriptors(spark, shop):
    files = read_files(spark, str(shop))
    m = spark.createDataFrame(A.build_manifest(files).collect())  # a stored manifest; a cached plan would answer for the changed files too
    assert m.count() == 2 and A.verify_manifest(files, m).count() == 0
    (shop / "a.xml").write_text("<R/>")
    (shop / "c.xml").write_text("<R/>")
    (shop / "b.xml").unlink()
    got = {r.uri[-5:]: r.problem for r in A.verify_manifest(read_files(spark, str(shop)), m).collect()}
    assert got == {"a.xml": "size differs", "b.xml": "missing", "c.xml": "not listed"}
    d = A.descriptor(extract(read_files(spark, str(shop)), recipe()), "out", "parquet")
    assert (d["lifecycle"], d["records"]) == ("complete", 0) and A.check_descriptor(d) == []
    assert A.check_descriptor({"format": "csv", "fields": [{"name": "a"}, {"name": "a"}]})


def test_command_line(spark, shop, tmp_path, capsys):
    w = tmp_path / "w"
    w.mkdir()
    (w / "recipe.yaml").write_text("id: shop\nassets: {extract: x.yaml}\ndefaults: {parameters: {site: s1}}\n")
    (w / "x.yaml").write_text("record_type: o\nmatch_selectors: [{xpath: //Order}]\nfield_mappings: [{output_field: id, xpath: '@id', type: integer}]\n")
    assert main(["extract", str(w), str(shop), "--out", str(tmp_path / "o"), "--format", "parquet", "--param", "site=s2"]) == 0
    out = spark.read.parquet(str(tmp_path / "o/records"))
    assert out.count() == 80 and {r.site for r in out.collect()} == {"s2"}
    assert main(["extract", str(w), str(shop), "--out", str(tmp_path / "s"), "--format", "shards", "--rows", "30", "--validate-output", "strict"]) == 0
    with pytest.raises(SystemExit):
        main(["extract", str(w), str(shop), "--out", str(tmp_path / "p"), "--validate-output", "strict"])
    assert main(["inspect", str(shop)]) == 0 and main(["starter", str(shop)]) == 0 and main(["manifest", str(shop)]) == 0 and main(["transforms"]) == 0
    assert main(["index", str(shop), "--record", "Order", "--out", str(tmp_path / "ix")]) == 0 and main(["verify-index", str(tmp_path / "ix")]) == 0
    assert '"path": "/R/S/Order"' in capsys.readouterr().out
    assert parameters(["a=1", "b=x", "b=y", "c="]) == {"a": "1", "b": ["x", "y"], "c": ""}
    with pytest.raises(SystemExit):
        parameters(["a"])
    (tmp_path / "list").write_text(f"{shop}/b.xml\n{shop}/none.xml\n# c\n{shop}/a.xml\n")
    assert main(["extract", str(w), "--file-list", str(tmp_path / "list"), "--format", "stdout", "--events", str(tmp_path / "log")]) == 1
    told = capsys.readouterr()
    lines = [json.loads(x) for x in told.out.splitlines()]
    assert len(lines) == 80 and lines[0]["_runtime"]["source_file"].endswith("b.xml") and lines[79]["_runtime"]["source_file"].endswith("a.xml")
    assert json.loads(told.err.splitlines()[-1])["reason"] == "input_unavailable"
    events = [json.loads(x)["event"] for x in (tmp_path / "log").read_text().splitlines()]
    assert events[0] == "started" and events[-1] == "completed" and events.count("completed") == 1
    assert main(["boundaries", str(shop), "--record", "Order", "--max-records", "5"]) == 0
    shown = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["records"] for x in shown[:2]] == [5, 5] and len(shown) == 7


def outcomes(e):
    return {r.source_file.rsplit("/", 1)[-1].split(".")[0]: (r.disposition, r.reason, r.records) for r in e.dispositions.collect()}


def told(e):
    return sorted((r.source_file.rsplit("/", 1)[-1].split(".")[0], r.record_num, *(r[c] for c in ("id", "big"))) for r in e.data.collect())


@pytest.mark.parametrize("fmt", ["xml", "json", "ndjson"])
@pytest.mark.parametrize("floor", [0, 2])
def test_dispositions_are_the_same_on_all_routes(spark, tmp_path, fmt, floor):
    """Sound, empty, too few, a bad field in the second record, a bad expression in the first, broken at its end."""
    files = {"sound": [1, 2, 3], "none": [], "few": [5], "field": [1, "x", 3], "expression": [0, 1], "broken": [1, 2]}
    for name, ids in files.items():
        if fmt == "xml":
            text = "<R>" + "".join(f"<Order><id>{k}</id></Order>" for k in ids) + ("</R>" if name != "broken" else "")
        elif fmt == "json":
            text = json.dumps({"Order": [{"id": k} for k in ids]})[: -1 if name == "broken" else None]
        else:
            text = "".join(json.dumps({"id": k}) + "\n\n" for k in ids)[: -3 if name == "broken" else None]
        (tmp_path / f"{name}.{fmt}").write_text(text)
    maps = [{"output_field": "id", "xpath": "id", "type": "integer"}, {"output_field": "big", "type": "number", "expression": "10 / id"}]
    selector = {"xpath": "//Order" if fmt != "ndjson" else "row", "min_occurrences": floor}
    r = build({"record_type": "o", "match_selectors": [selector], "field_mappings": maps}, {"format_type": fmt})
    whole = extract(read_files(spark, str(tmp_path)), r)
    want = {"sound": ("applied", None, 3), "none": ("applied", None, 0), "few": ("applied", None, 1), "field": ("failed", "internal_error", 0), "expression": ("failed", "internal_error", 0), "broken": ("failed", "parse_error", 0)}
    if floor:
        want |= {k: ("failed", "min_occurrences_violation", 0) for k in ("none", "few")}
    other = RT.extract_records(spark, str(tmp_path), r)
    assert outcomes(whole) == want == outcomes(other) and told(whole) == told(other)
    assert other.keys == whole.keys and set(other.rows.columns) == set(whole.rows.columns)
    ran = RT.extract_files(spark, str(tmp_path), r)
    assert outcomes(ran) == want and told(ran) == told(whole)


def test_inputs_fail_alone_and_large_ones_may_be_unsupported(spark, shop, monkeypatch):
    from lodestone.sources import inputs as I

    listed = I.parse_file_list(f'{shop}/a.xml\n{shop}/none.xml\n{{"uri": "{shop}/b.xml", "size": 1}}\n')
    docs = I.verified(read_files(spark, str(shop)), I.declared_frame(spark, listed))
    e = RT.extract_files(spark, docs, recipe())
    got = {(r.input_ordinal, r.disposition, r.reason, r.error, r.records) for r in e.dispositions.collect()}
    assert got == {(1, "applied", None, None, 40), (2, "failed", "input_unavailable", "input_unavailable", 0), (3, "failed", "input_unavailable", "size_mismatch", 0)}
    monkeypatch.setattr(RT, "LARGE", 1000)
    bad = recipe(maps=[{"output_field": "up", "xpath": "../@x"}])
    assert outcomes(RT.extract_files(spark, str(shop), bad)) == {k: ("failed", "route_unsupported", 0) for k in "ab"}


def test_an_extraction_of_files_shuffles_no_data(spark, shop):
    maps = [*MAPS, {"output_field": "twice", "type": "number", "expression": "total * 2"}]
    for r in (recipe(), recipe(maps=maps)):
        plan = RT.extract_files(spark, str(shop), r).data._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window [") == 1 and "path#" in plan.split("Window [")[1][:100] and "hashpartitioning" not in plan  # names are numbered


def test_of_two_inputs_with_one_key_the_bad_one_fails_alone(spark):
    docs = spark.createDataFrame([("k", '<R><Order id="1"><Total>1</Total></Order></R>'), ("k", "<R>")], "source_file string, content string")
    for maps in (MAPS, [*MAPS, {"output_field": "t", "type": "number", "expression": "total + 1"}]):
        e = extract(docs, recipe(maps=maps))
        assert [r.id for r in e.data.collect()] == [1] and sorted(r.disposition for r in e.dispositions.collect()) == ["applied", "failed"]


def test_a_run_tells_its_progress_and_exactly_one_end(spark):
    import time

    from lodestone.streaming.files import Watched

    log = []
    with Watched(spark, log.append, "r1", every=0.05):
        spark.range(8).repartition(8).mapInPandas(lambda it: (time.sleep(0.2) or b for b in it), "id long").count()
        time.sleep(0.2)
    events = [json.loads(x) for x in log]
    names = [x["event"] for x in events]
    assert names[0] == "started" and names[-1] == "completed" and "progress" in names and "heartbeat" in names
    assert [x["seq"] for x in events] == list(range(1, len(events) + 1)) and {x["run_id"] for x in events} == {"r1"}
    for error, end in ((ValueError("no"), "failed"), (KeyboardInterrupt(), "cancelled")):
        log.clear()
        with pytest.raises(type(error)), Watched(spark, log.append):
            raise error
        assert [json.loads(x)["event"] for x in log] == ["started", end]


def test_streams_tell_their_end(spark, shop, tmp_path):
    from lodestone.streaming import files as ST

    log = []
    listener = ST.StreamEvents(log.append)
    spark.streams.addListener(listener)
    try:
        for k, sink in enumerate((ST.parquet_sink(str(tmp_path / "o")), lambda e, n: 1 / 0)):
            q = ST.extract_stream(ST.stream_files(spark, str(shop)), recipe(), sink, str(tmp_path / f"c{k}"))
            try:
                q.awaitTermination()
            except Exception:
                assert k == 1
        for _ in range(100):
            if sum('"completed"' in x or '"failed"' in x for x in log) == 2:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    runs = {}
    for x in map(json.loads, log):
        runs.setdefault(x["run_id"], []).append(x["event"])
    ends = sorted(r[-1] for r in runs.values())
    assert ends == ["completed", "failed"] and all(r[0] == "started" and sum(e in ("completed", "failed") for e in r) == 1 for r in runs.values())
    assert spark.read.parquet(str(tmp_path / "o/data")).count() == 80


def test_rungs_of_output_validation(spark, shop, tmp_path):
    from lodestone.operators import sinks as S

    e, out = RT.extract_files(spark, str(shop), recipe()), str(tmp_path / "o")
    S.write_shards(e, out, 30)
    assert {r.what for r in A.validate_output(spark, out, "artifact").collect()} == {"dispositions", "descriptor"}
    S.write_dispositions(e, out)
    S.write_json(e.rows, f"{out}/artifact", A.descriptor(e, out, "ndjson"))
    assert [A.validate_output(spark, out, mode).count() for mode in A.LADDER] == [0] * 5
    shard = tmp_path / "o/shards/shard-000001.ndjson"
    lines = shard.read_text().splitlines()
    lines[7] = '{"extract": 1}'
    shard.write_text("\n".join(lines) + "\n")
    (tmp_path / "o/shards/shard-000009.ndjson").write_text(lines[0] + "\n")
    got = {mode: {(r.what[-7:], r.problem) for r in A.validate_output(spark, out, mode, every=5).collect()} for mode in A.LADDER[2:]}
    assert got["artifact"] == set() == got["envelope-sample"]  # the eighth line isn't in the sample
    assert got["strict"] == {(".ndjson", "1 envelopes don't fit the contract"), (".ndjson", "its size differs"), (".ndjson", "the manifest doesn't name it")}
    assert A.validate_output(spark, out, "envelope-sample", every=7).count() == 1
    assert A.check_manifest({}) == ["it is missing"] and "its inputs don't add up" in A.check_manifest({"record_type": "o", "inputs_total": 3, "inputs_applied": 1, "inputs_not_applicable": 0, "inputs_failed": 0, "records": 0, "fields": []})
    with pytest.raises(ValueError):
        A.validate_output(spark, out, "much")
