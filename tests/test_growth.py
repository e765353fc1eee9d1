"""Steps whose work or memory a task must not grow faster than its input."""

import random

from pyspark.sql import functions as F

from lodestone.operators import index as IX
from lodestone.operators import sinks as S
from lodestone.plans import queries as Q


def test_rows_look_through_the_starts_of_their_own_run_only(spark, monkeypatch):
    held = []
    plain = S.written

    def written(df, name):
        out = plain(df, name)
        if name == "starts":
            held.append(out)
        return out

    monkeypatch.setattr(S, "written", written)
    r = random.Random(3)
    sizes = [r.choice((1, 30, 99, 250)) for _ in range(3000)]
    for limit, rows in ((100, None), (100000, 7), (100000, None)):
        want, shard, used, many = {}, -1, 0, 0
        for k, s in enumerate(sizes):
            if k == 0 or used + s > limit or many == (rows or 1 << 62):
                shard, used, many = shard + 1, 0, 0
            used, many = used + s, many + 1
            want[k] = shard
        df = spark.createDataFrame(list(enumerate(sizes)), "k long, s long")
        got = {x.k: x.shard for x in S.shards_by_bytes(df, ["k"], F.col("s"), limit, rows).collect()}
        assert got == want
        assert held.pop().agg(F.max(F.size("_starts"))).first()[0] <= 256


def test_documents_of_large_tables_go_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(Q, "SPREAD", 50, raising=False)
    assert Q.spread(spark.range(10)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    out = Q.spread(spark.range(1000))
    assert out.rdd.getNumPartitions() == 20 and out.count() == 1000


def test_records_are_made_documents_where_they_are_read(spark, tmp_path):
    f = tmp_path / "a.xml"
    f.write_text('<R xmlns:q="urn:q"><q:O id="1"/><q:O>x</q:O></R>')
    files = spark.createDataFrame([(str(f), f.stat().st_size)], "source_file string, size_bytes long")
    ix = IX.build_index(files, "O").records
    own = IX.read_ranges(ix, documents=True)
    assert own._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(bytes(x.content) for x in own.collect()) == sorted(bytes(x.content) for x in IX.wrap(IX.read_ranges(ix)).collect()) == [b'<q:O xmlns:q="urn:q" id="1"/>', b'<q:O xmlns:q="urn:q">x</q:O>']


def test_files_of_nations_are_put_together_in_runs(spark, monkeypatch):
    from lodestone.plans import file_queries as FQ

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(FQ, "RUN", 100)
    rows = Q.t(spark, sf, "orders").join(Q.t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey").collect()
    for ends, sep in (((F.lit("<"), F.lit(">")), ""), ((F.lit("["), F.lit("]")), ","), (None, "")):
        path = FQ.nation_orders(spark, sf, F.col("o_orderkey").cast("string"), ends, sep)
        got = {r.nation: r.text for r in spark.read.text(path, wholetext=True).select(FQ.key_of("_metadata.file_path").alias("nation"), F.col("value").alias("text")).collect()}
        files = spark.read.format("binaryFile").load(path).count()
        want: dict[int, list[int]] = {}
        for nation, key in sorted((r[0], r[1]) for r in rows):
            want.setdefault(nation, []).append(key)
        assert files == len(want) == len(got)
        for nation, keys in want.items():
            a, z = ("", "") if ends is None else ("[", "\n]") if sep else ("<", "\n>")
            text = a + "\n".join(map(str, keys)) + z + "\n"
            assert got[nation] == text if not sep else got[nation].replace("\n", "") == a + ",".join(map(str, keys)) + "]"


def test_contents_of_files_above_the_limit_are_not_read(spark, monkeypatch):
    from lodestone.plans import file_queries as FQ
    from lodestone.plans import routes as RT

    sf = "/root/testdata/sf0.01"
    path = FQ.mixed_files(spark, sf, "xml")
    recipe = FQ.order_recipe("xml", min_occurrences=50)
    want = sorted(map(tuple, FQ.outcomes(RT.extract_files(spark, path, recipe)).collect()))
    seen = []
    plain = RT.extract
    monkeypatch.setattr(RT, "extract", lambda docs, *a, **k: (seen.append(docs), plain(docs, *a, **k))[1])
    sizes = sorted(r[0] for r in spark.read.format("binaryFile").load(path).select("length").collect())
    monkeypatch.setattr(RT, "LARGE", sizes[len(sizes) // 2])
    e = RT.extract_files(spark, path, recipe)
    assert f"LessThanOrEqual(length,{RT.LARGE})" in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, FQ.outcomes(e).collect())) == want
