"""The pipeline against plain Python, its stages over odd tables, and the registered queries."""

import os
import random

import pytest

from lodestone.llm import merge_dropout, quality, queries, toxicity
from lodestone.llm.common import table
from tests.llm.conftest import odd_texts, prose
from tests.llm.test_operators import PIECES, brute_join, items, junk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, docs, labels, bench):
    spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in docs], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    docs, labels, bench = [], [], items()
    for i in range(260):
        bad, toxic = i % 5 == 0, i % 7 == 0
        x = junk(i) if bad else prose(i, 60)
        docs.append((i, f"{x} you stupid moron {x[:20]}" if toxic else x))
        labels.append((i, 0 if bad else 1, 1 if toxic else 0))
    r = random.Random(1)
    for k in range(80):
        w = prose(r.randrange(30), 60).split()
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = "other"
        docs.append((1000 + k, " ".join(w)))
    docs += [(2000 + k, f"{prose(5000 + k, 80)} {bench[k][1]}") for k in range(15)]
    return write(spark, tmp_path_factory.mktemp("corpus"), docs, labels, bench)


def test_pipeline_equals_plain_python(spark, corpus):
    import corpus_pipeline

    docs = {r.doc_id: r for r in table(spark, corpus, "documents").collect()}
    tables = [table(spark, corpus, t) for t in ("documents", "labels")]
    good, fair = quality.train(*tables), toxicity.train(*tables)
    import numpy as np

    kept = [i for i, r in docs.items() if good.scores(quality.text_view(r.text)[None], quality.meta_view(r.lang, r.source, r.n_chars)[None])[2][0] >= 0.5]
    kept = [i for i in kept if fair.scores([docs[i].text])[0] < 0.5]
    classes = brute_join([(i, docs[i].text) for i in kept], 5, 80)
    kept = [i for i in kept if classes[i][1] == i]
    plain = lambda x: " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())
    kept = [i for i in kept if not any(plain(x) in plain(docs[i].text) for _, x in items())]
    coder = merge_dropout.MergeDropout(PIECES, 0.1, 7)
    want = {i: len(coder.encode([docs[i].text], [i])[0]) // 4 for i in kept}
    got = {r.doc_id: r.n_pieces for r in corpus_pipeline.run(spark, corpus).collect()}
    assert got == want and 100 < len(got) < len(docs)
    assert not any(2000 <= i < 2015 for i in got) and isinstance(np.mean(list(got.values())), float)


def test_stages_keep_columns_and_take_odd_tables(spark, corpus, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "jaccard_join", "decontamination", "sentencepiece"]
    odd = spark.createDataFrame([(i, x, None, None, None) for i, x in odd_texts()], SCHEMA)
    for docs in (odd, odd.where("false")):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, corpus)
            if name != "sentencepiece":
                assert rows.columns == docs.columns
        assert rows.count() <= docs.count()
    same = odd.where("doc_id is null or doc_id in (1, 2)")
    left = [r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, same, corpus).collect()]
    assert sorted(left, key=lambda i: (i is not None, i)) == [None, None, 1]
    bare = write(spark, tmp_path / "bare", [], [], [])
    assert corpus_pipeline.run(spark, bare).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize(("name", "columns"), [
    ("op1_quality", {"doc_id", "score", "keep"}), ("op2_decontamination", {"doc_id", "item_id"}), ("op3_jaccard_join", {"doc_id", "n_shingles", "component_id"}),
    ("op4_lm_scoring", {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}), ("op5_chat_formatting", {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"}),
    ("op6_token_output", {"doc_id", "start", "n_tokens", "ids_crc32"}), ("op7_toxicity", {"doc_id", "held_out", "score", "predicted"}), ("op8_sentencepiece", {"doc_id", "n_pieces", "restored"}),
    ("op9_fingerprints", {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}), ("op10_language_id", {"doc_id", "held_out", "lang_pred", "score"}),
    ("op11_resampling", {"doc_id", "n_features", "weight", "score", "rank"}),
])
def test_registered_queries_cover_their_tables(spark, name, columns):
    df = queries.QUERIES[name](spark, SF).cache()
    assert columns <= set(df.columns)
    n = table(spark, SF, "documents").count()
    if name == "op5_chat_formatting":
        n = table(spark, SF, "conversations").select("conv_id").distinct().count() + 1
    assert df.count() == n if name != "op2_decontamination" else 0 < df.count() < n


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = db.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=key) == sorted(want.fetchall(), key=key)
