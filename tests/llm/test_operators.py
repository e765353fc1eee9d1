"""Each operator against a brute-force version, a round trip or held-out rows, and over odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import LONG, crc, odd_texts, prose, rows_of

from lodestone.llm import chat, decontam, jaccard_join, langid, merge_dropout, ngram_lm, quality, seekable_tokens, spotsigs, toxicity
from lodestone.llm.common import BATCH_BYTES, arrow_map, fresh_path, id_ranges, remove_work, written
from lodestone.llm.components import components
from lodestone.llm.elias_fano import EliasFano

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# ---- 1 quality and 7 toxicity --------------------------------------------------------------------------------


def junk(seed):
    r = random.Random(seed)
    return " ".join(w.upper() + "!!" for w in prose(seed, 40).split()) if r.random() < 0.5 else " | ".join(prose(seed, 40).split())


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = [], []
    for i in range(300):
        bad, toxic = i % 5 == 0, i % 7 == 0
        x = junk(i) if bad else prose(i, 60)
        docs.append((i, f"{x} you stupid moron {x[:20]}" if toxic else x))
        if i < 220:
            labels.append((i, 0 if bad else 1, 1 if toxic else 0))
    return rows_of(spark, docs), spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int"), labels


def test_quality_keeps_clean_documents(labelled):
    docs, labels, truth = labelled
    model = quality.train(docs, labels, 200, 80)
    got = {r.id: r.score >= 0.5 for r in quality.score_quality(docs, model).collect()}
    assert np.mean([got[i] == bool(q) for i, q, _ in truth]) > 0.97 and model.pseudo > 0
    assert all(got[i] for i, q, _ in truth if q)


def test_all_unlabelled_documents_are_offered(labelled, monkeypatch):
    docs, labels, truth = labelled
    passes, views = [], quality.co_train

    def watched(xt, xm, y, offer, most, **more):
        def every(models, share, taken):
            found, features = offer(models, share, taken)
            free = {(r.text, r.lang, r.source, r.n_chars) for r in docs.collect() if r.doc_id not in {i for i, _, _ in truth}}
            for v in (0, 1):
                x = [(quality.text_view(t), quality.meta_view(*m))[v] for t, *m in free]
                p = quality.sigmoid(np.stack(x) @ models[v][0] + models[v][1])
                for label, conf in ((1, p), (0, 1 - p)):
                    got = [k for k, k_label in found[v] if k_label == label]
                    own = [quality.sigmoid(features[k][v] @ models[v][0] + models[v][1]) for k in got]
                    sure = sorted(conf[conf >= 0.5])[::-1]
                    if not taken[1 - v]:
                        assert np.allclose(sorted(own if label else [1 - q for q in own])[::-1], sure[: share[label]])
                    passes.append(len(got))
            return found, features

        return views(xt, xm, y, every, most, **more)

    monkeypatch.setattr(quality, "co_train", watched)
    assert quality.train(docs, labels, 200, 30, share=0.5, sure=0.5).pseudo > 30 and sum(passes) > 30


def test_views_share_nothing_and_the_exchange_teaches(spark):
    """Bad pages come from one source; half of the bad words occur in unlabelled pages only, so only metadata can teach them."""
    r = random.Random(6)
    docs, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        known = i < 60
        text = prose(i, 40) + (" " + " ".join(r.choice(["qzx", "xqz"] if known else ["vkj", "jvk"]) for _ in range(12)) if bad else "")
        docs.append((i, text, "en", ("spam" if bad else f"good{i % 4}") if i % 9 else None, 300))
        if known:
            labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    probe = [prose(5000 + k, 40) + " vkj jvk vkj vkj jvk vkj vkj jvk vkj" for k in range(30)]
    x = np.stack([quality.text_view(t) for t in probe])
    alone, taught = (quality.train(docs, labels, unlabelled=u, sure=0.8).text for u in (0, 900))
    assert (quality.sigmoid(x @ taught[0] + taught[1]) < 0.5).mean() > 0.9 > (quality.sigmoid(x @ alone[0] + alone[1]) < 0.5).mean()


def test_toxicity_finds_held_out_toxic_documents(labelled):
    docs, labels, truth = labelled
    got = {r.id: r.score for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    held = [(i, x) for i, _, x in truth if crc(i) % 5 == 0]
    assert all((got[i] >= 0.5) == bool(x) for i, x in held)


def test_toxicity_is_a_regression_on_scaled_presence():
    """The same scores from a table of one column per n-gram, scaled by its log-count ratio, and plain gradient descent's optimum."""
    texts = [prose(k, 12) + (" you stupid moron" if k % 3 == 0 else "") for k in range(60)]
    y = np.array([k % 3 == 0 for k in range(60)], float)
    model = toxicity.fit(texts, y, l2=1e-2)
    sets = []
    for t in texts:
        raw = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in t.lower().encode())
        sets.append({raw[a : a + n] for n in (4, 5, 6) for a in range(len(raw) - n + 1)})
    pos, neg = (Counter(g for s, v in zip(sets, y, strict=True) if v == side for g in s) for side in (1, 0))
    ratio = {g: math.log((1 + pos[g]) / (1 + y.sum()) * (1 + len(y) - y.sum()) / (1 + neg[g])) for g in {*pos, *neg} if pos[g] + neg[g] >= 3}
    names = sorted(g for g, v in ratio.items() if abs(v) >= 0.7)
    x = np.array([[ratio[g] * (g in s) for g in names] for s in sets])
    w, b = np.zeros(len(names)), 0.0
    step = 1 / (np.linalg.norm(x, 2) ** 2 / 4 / len(y) + 1)
    for _ in range(20_000):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - step * (x.T @ e / len(y) + 1e-2 * w), b - step * e.mean()
    assert np.abs(1 / (1 + np.exp(-(x @ w + b))) - model.scores(texts)).max() < 0.03


def test_toxicity_reads_whole_texts(labelled):
    docs, labels, _ = labelled
    model = toxicity.train(docs, labels)
    late = prose(7, 3000) + " you stupid moron " + prose(8, 20)
    assert model.scores([late, prose(7, 3000)]).round().tolist() == [1.0, 0.0]
    assert model.scores([late] * 2 + ["a"])[0] == model.scores([late])[0]


def test_classifiers_over_odd_tables(spark, labelled, odd, none):
    _, labels, _ = labelled
    empty_labels = labels.where("false")
    for docs in (odd, none):
        for lab in (labels, empty_labels):
            n = docs.count()
            q = quality.score_quality(docs, quality.train(docs, lab)).collect()
            x = toxicity.score_toxicity(docs, toxicity.train(docs, lab)).collect()
            assert len(q) == len(x) == n and all(0 <= r.score <= 1 for r in (*q, *x))
    assert all(r.score >= 0.5 for r in quality.score_quality(odd, quality.train(odd, empty_labels)).collect())
    assert all(r.score < 0.5 for r in toxicity.score_toxicity(odd, toxicity.train(odd, empty_labels)).collect())
    same = [r.score for r in quality.score_quality(odd, quality.train(*labelled[:2])).where("id = 1").collect()]
    assert len(same) == 2


# ---- 2 decontamination ----------------------------------------------------------------------------------------


def items():
    return [(k, f"Which {prose(1000 + k, 24)} It is {prose(2000 + k, 4, [f'zq{k}a', f'zq{k}b', 'the'])}.") for k in range(60)]


def figures(rows):
    words = {k: decontam.WORD.findall(x.lower()) for k, (_, x) in enumerate(rows) if x and decontam.WORD.search(x)}
    return words, Counter(w for v in words.values() for w in set(v)), len(words), sum(map(len, words.values())) / len(words)


def test_block_max_wand_finds_all_above_the_threshold():
    rows, r = items(), random.Random(3)
    ix = decontam.ItemIndex(rows, *figures(rows)[1:], 0.5)
    (c,) = ix.classes
    found = 0
    for _ in range(200):
        own = sum(decontam.split_item(rows[r.randrange(60)][1]), [])[: r.randrange(1, 30)]
        terms = sorted({c.term[w] for w in own} | set(r.sample(range(len(c.term)), r.choice([0, 3, 20]))))
        score = Counter()
        for t in terms:
            for d, v in zip(c.docs[t], c.impact[t], strict=True):
                score[d] += v
        want = sorted(d for d, v in score.items() if v >= 0.5 - 1e-12)
        assert [d for d, _ in c.search(terms)] == want
        found += len(want)
    assert found > 50


def brute_contaminated(docs, rows, threshold=0.5):
    """Every item against every passage of its length class, by the formula."""
    words, df, n, mean = figures(rows)
    out = set()
    for d, text in docs:
        w = decontam.WORD.findall((text or "").lower())
        for k, own in words.items():
            if len(own) < 4:
                first = next((j for j in range(len(w) - len(own) + 1) if w[j : j + len(own)] == own), -1)
                if own and first >= 0:
                    out.add((d, rows[k][0], 1.0, 1.0, 1.0, first))
                continue
            impact = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(own) / mean)) for x, f in Counter(own).items()}
            q, a = decontam.split_item(rows[k][1])
            step, best = max(16, 1 << (len(own) - 1).bit_length()), None
            for at in range(0, len(w), step):
                p = w[at : at + 2 * step]
                score = sum(v for x, v in impact.items() if x in set(p)) / sum(impact.values())
                size = min(3, len(q))
                runs = lambda x, size=size: {tuple(x[j : j + size]) for j in range(len(x) - size + 1)}
                over = len(runs(q) & runs(p)) / len(runs(q)), len(set(a) & set(p)) / len(set(a))
                if score >= threshold - 1e-9 and min(over) >= 0.5 and (best is None or (round(score, 9), *over) > best[:3]):
                    best = round(score, 9), *over, at
            if best:
                out.add((d, rows[k][0], *best))
    return out


def test_whole_query_against_every_passage_whatever_the_blocks(spark, monkeypatch):
    rows = [*items()[:25], (70, prose(3000, 150)), (71, prose(3001, 300)), (72, prose(3002, 9)), (73, "zq1a"), (74, "Zq2b of zq3c"), (None, prose(3003, 40)), (None, prose(3004, 40)), (76, None), (77, "!")]
    r, docs = random.Random(4), [(900, "zq1a"), (901, "zq2b OF zq3c!"), (902, "the zq1a the zq1a"), (907, "zq2b of of zq3c"), (908, f"{prose(5, 50)} zq2b, of zq3c {prose(6, 50)}"), (903, None), (904, ""), (905, f"y {rows[30][1]} x")]
    for k in range(60):
        own = r.choice(rows[:28])[1].split()
        own = own[: r.randrange(len(own) // 2, len(own) + 1)]
        for _ in range(r.randrange(4)):
            own.insert(r.randrange(len(own)), prose(k, r.choice([1, 30])))
        docs.append((k, f"{prose(k, r.randrange(200))} {' '.join(own)} {prose(k + 7, r.randrange(90))}"))
    want = brute_contaminated(docs, rows)
    assert len(want) > 20 and {(900, 73), (902, 73), (901, 74), (908, 74)} == {x[:2] for x in want if x[1] in (73, 74)} and any(x[1] is None for x in want)
    df, bench = rows_of(spark, docs), spark.createDataFrame(rows, "item_id long, text string")
    for size in (8 << 20, 1500):
        monkeypatch.setattr(decontam, "INDEX_BYTES", size)
        got = {(x.doc_id, x.item_id, round(x.score, 9), x.question_overlap, x.answer_overlap, x.first_word) for x in decontam.contaminated(df, bench).collect()}
        assert got == want
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(df, bench.union(spark.createDataFrame([(99, prose(1, 5000))], bench.schema))).collect()} >= {x[:2] for x in want if x[2] > 0.6}


def test_leaks_are_found_and_clean_documents_left(spark):
    rows = items()
    docs = [(k, prose(k, 150)) for k in range(40)]
    docs += [(100 + k, f"{prose(k, 90)} {rows[k][1]} {prose(k + 5, 30)}") for k in range(20)]  # whole copies
    docs += [(200 + k, f"{prose(k, 200)} {rows[k][1].upper().replace('.', ' ;')}") for k in range(10)]  # other case and marks
    docs += [(300, f"{prose(0, 100_000)} {rows[7][1]}")]  # at the end of a very long text
    docs += [(400 + k, prose(k, 40) + " " + " ".join(rows[k][1].split()[:4])) for k in range(10)]  # a few words only
    bench = spark.createDataFrame([*rows, (None, "zq4x"), (900, None), (901, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(rows_of(spark, docs), bench).collect()}
    assert got == {(100 + k, k) for k in range(20)} | {(200 + k, k) for k in range(10)} | {(300, 7)}


def test_the_stage_keeps_texts_that_only_mention_short_items(spark, tmp_path):
    spark.createDataFrame([(1, "the of"), (2, prose(50, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = rows_of(spark, [(1, "The of"), (2, f"say the of {prose(1, 20)}"), (3, f"{prose(2, 40)} {prose(50, 30)}"), (4, None), (5, "of the")])
    assert sorted(r.doc_id for r in decontam.drop_contaminated(spark, docs, str(tmp_path)).collect()) == [2, 4, 5]


def test_decontamination_over_odd_tables(spark, odd, none):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(odd, bench.where("false")).columns[0] == "doc_id"


# ---- 3 Jaccard join -------------------------------------------------------------------------------------------


def brute_join(rows, n, num):
    sets = {}
    for i, x in rows:
        w = (x or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root, links = {i: i for i in sets}, defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    links[a] += 1
                    links[b] += 1
                    root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


def near_copies(seed=5):
    r = random.Random(seed)
    rows = [(k, prose(k, r.choice([1, 2, 3, 8, 20, 60, 150]))) for k in range(60)]
    for k in range(140):
        w = r.choice(rows)[1].split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            w[r.randrange(len(w))] = r.choice(["new", "word", "here"])
        rows.append((100 + k, " ".join(w)))
    shared = prose(777, 45)
    return rows + [(400 + k, f"{prose(900 + k, 60)} {shared}") for k in range(30)] + [(500, None), (501, ""), (502, " ")]


@pytest.mark.parametrize(("n", "num", "block"), [(3, 90, 4_000_000), (5, 80, 4_000_000), (3, 70, 500), (1, 60, 300)])
def test_join_is_exact(spark, n, num, block):
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(rows_of(spark, rows), n, num, block_shingles=block).collect()}
    assert got == brute_join(rows, n, num)


def test_join_counts_shared_passages_without_joining_them(spark):
    rows = [(k, f"{prose(k, 70)} {prose(777, 45)}") for k in range(80)]
    got = jaccard_join.jaccard_components(rows_of(spark, rows), 5, 80).collect()
    assert all(r.component_id == r.doc_id for r in got)


def test_join_with_repeated_rows(spark):
    a = prose(1, 60)
    near = " ".join(["new", *a.split()[1:]])
    far = prose(2, 50)
    rows = [(1, a), (1, a), (2, a), (9, near), (9, near), (4, far), (4, near), (5, far), (0, None), (0, near + " x")]
    sets = [set(jaccard_join.shingles(t or "").tolist()) for _, t in rows]
    want = Counter()
    for k, (i, _) in enumerate(rows):
        links = sum(10 * len(sets[k] & x) >= 9 * len(sets[k] | x) for j, x in enumerate(sets) if j != k) if sets[k] else 0
        want[i, len(sets[k]), 0, links] += 1  # all are one component: id 4 has rows of both kinds
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(rows_of(spark, rows)).collect())
    assert got == want


def test_one_row_of_each_group_stays(spark):
    rows = [(1, prose(1, 60)), (1, prose(2, 60)), (2, prose(1, 60)), (3, prose(3, 60)), (None, prose(3, 60)), (4, None)]
    docs = rows_of(spark, rows)
    got = [[(r.doc_id, r.text) for r in jaccard_join.one_of_each(spark, d, "").collect()] for d in (docs, docs.repartition(5, "text"))]
    assert sorted(i or 0 for i, _ in got[0]) == [0, 1, 3, 4] and {t for i, t in got[0] if i == 1} == {t for i, t in got[1] if i == 1}


def test_join_over_odd_tables(odd, none):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(odd).collect()}
    a = len(jaccard_join.shingles(odd_texts()[0][1]))
    assert {r for r in rows if r[0] in (1, 2)} == {(1, a, 1, 2), (2, a, 1, 2)}
    assert {r for r in rows if r[0] in (3, 4, 5)} == {(k, 0, k, 0) for k in (3, 4, 5)}
    assert jaccard_join.jaccard_components(odd).count() == odd.count() and jaccard_join.jaccard_components(none).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 380)]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.id: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root}


def test_every_language_is_learned(spark):
    rows = [(k, prose(k, 30), "en" if k % 250 else "xx") for k in range(1000)]
    rows = [(k, t if g == "en" else "".join(reversed(t)).replace("e", "ø").replace("t", "þ"), g) for k, t, g in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, 100)
    assert model.langs == ["en", "xx"] and {r.id for r in langid.identify(docs, model).where("lang_pred = 'xx'").collect()} == {0, 250, 500, 750}


# ---- 4 language model -----------------------------------------------------------------------------------------


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, u in ((0, 1), (1, 1), (5, 10), (1000, 1 << 40), (1000, 1500), (3000, 1 << 62)):
        v = np.unique(r.integers(0, u, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
        e = EliasFano.build(v)
        at = {int(x): k for k, x in enumerate(v)}
        for q in (v, v[:: max(1, len(v) // 7)], r.integers(0, u + 9, 40, dtype=np.uint64), np.array([0, u + (1 << 20)], np.uint64)):
            assert e.find(q).tolist() == [at.get(int(x), -1) for x in q]
        if len(v):
            i = r.integers(0, len(v), 9)
            assert (e.access(i) == v[i]).all() and (e.access(np.arange(len(v))) == v).all()
            assert len(v) < 100 or e.high.nbytes + e.low_bytes.nbytes < len(v) * (3 + max(0, math.log2(u / len(v)))) / 8 + 64


def reference_lm(rows, mod):
    words = {k: [*(x or "").encode().lower().split(), None] for k, (_, x) in enumerate(rows)}
    train = [k for k, (i, _) in enumerate(rows) if crc(i) % mod]
    count = Counter(w for k in train for w in words[k])
    total, v = sum(count.values()), len(count)
    return [(crc(i) % mod == 0, len(words[k]), sum(count[w] > 0 for w in words[k]), total, sum(math.log10((count[w] + 0.1) / (total + 0.1 * (v + 1))) for w in words[k])) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("tokens", [1_500_000, 300])
def test_base_scores_and_counts_are_exact(spark, tokens):
    rows = [(k, prose(k % 40, 80)) for k in range(90)] + odd_texts()
    got = sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in ngram_lm.score_corpus(rows_of(spark, rows), shard_tokens=tokens).collect())
    assert got == sorted((*w[:4], round(w[4], 6)) for w in reference_lm(rows, 10))


def witten_bell(rows, mod):
    """log10 probabilities of whole texts by counting n-grams in dictionaries."""
    words = [[*(x or "").encode().lower().split(), None] for _, x in rows]
    one, total = Counter(), [0]
    after: dict = defaultdict(Counter)
    for (i, _), w in zip(rows, words, strict=True):
        if crc(i) % mod:
            h = ["<", "<", *w]
            for k in range(2, len(h)):
                one[h[k]] += 1
                after[h[k - 1],][h[k]] += 1
                after[h[k - 2], h[k - 1]][h[k]] += 1
    total = sum(one.values())

    def p(h, x):
        if not h:
            return (one[x] + 0.1) / (total + 0.1 * (len(one) + 1))
        c = after.get(h, {})
        t, d = sum(c.values()), len(c)
        return (c.get(x, 0) + d * p(h[1:], x)) / (t + d) if t else p(h[1:], x)

    return [sum(math.log10(p((h[k - 2], h[k - 1]), h[k])) for h in [["<", "<", *w]] for k in range(2, len(h))) for w in words]


def test_scores_are_those_of_the_model_whatever_the_shards(spark):
    r = random.Random(9)
    rows = [(k, " ".join(r.choice(["the", "the", "of", *prose(k % 25, 6).split()]) for _ in range(r.randrange(60)))) for k in range(150)] + odd_texts()[:8]
    rows += [(500 + k, r.choice(["", "the", "of", "x", f"y{k}"])) for k in range(120)]  # many starts
    want = sorted((r.held_out, n, s) for (r, n), s in zip([(type("R", (), {"held_out": crc(i) % 10 == 0}), len((x or "").split()) + 1) for i, x in rows], witten_bell(rows, 10), strict=True))
    scores = []
    for tokens in (1_500_000, 300, 60):
        got = sorted((x.held_out, x.n_tokens, x.score) for x in ngram_lm.score_corpus(rows_of(spark, rows), shard_tokens=tokens).collect())
        assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 * a[1] for a, b in zip(got, want, strict=True))
        scores.append([round(x[2], 6) for x in got])
    assert scores[0] == scores[1] == scores[2]


def test_starts_of_documents_are_dealt_over_shards():
    v = ngram_lm.Vocabulary([None], 10, 50_000, 200_000, 220_000, np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    routes = ngram_lm.Routes.of(v, 10_000)
    n = 50_000
    _, shard = routes.contexts(np.full(n, ngram_lm.BOS), np.full(n, ngram_lm.BOS), np.arange(n))
    assert np.bincount(shard).max() < 2 * 10_000 and len(np.unique(shard)) > 5


def test_ids_beyond_32_bits_are_kept():
    for a in ([], [0], [3, 255, 256], [4_294_967_301, 5, 1 << 55]):
        x = np.array(a, np.int64)
        assert ngram_lm._numbers(ngram_lm._planes(x)).tolist() == a


def test_trie_holds_the_model_and_sums_to_one():
    r = np.random.default_rng(3)
    tri = np.unique(r.zipf(1.5, (4000, 3)) % 30, axis=0)
    count = r.integers(1, 5, len(tri))
    order = np.lexsort((tri[:, 2], tri[:, 0], tri[:, 1]))
    before, context, word, count = tri[order, 0], tri[order, 1], tri[order, 2], count[order]
    p1 = np.bincount(word, count, 30) + 0.1
    p1 /= p1.sum()
    trie = ngram_lm.Trie(ngram_lm.Trie.build(before, context, word, count, p1[word], 30))
    for b, c in ((before[0], context[0]), (29, context[5]), (1, 2), (before[-1], context[-1])):
        p = 10 ** trie.score(np.full(30, b), np.full(30, c), np.arange(30), np.log10(p1))
        assert abs(p.sum() - 1) < 2e-3
    assert (trie.child_at.decode()[-1], trie.children.n) == (len(tri), len(tri))
    assert (trie.score(np.array([5]), np.array([77]), np.array([3]), np.log10(p1[[3]])) == np.log10(p1[3])).all()


def test_model_beats_its_base_on_held_out_copies(spark):
    rows = [(k, prose(k % 12, 100)) for k in range(200)]
    got = [r for r in ngram_lm.score_corpus(rows_of(spark, rows)).collect() if r.held_out]
    assert got and all(r.score > r.base_score + 0.3 * r.n_tokens for r in got)


def test_language_model_over_empty_tables(none):
    assert ngram_lm.score_corpus(none).count() == 0


# ---- 5 chat formatting ----------------------------------------------------------------------------------------


def test_chat_round_trip_and_loss(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<|", "\n", "", None, "日本語 é" * 3, "a" * 5000, "<\\\\|x|> <||>"]
    rows = [(c, t, role, hard[(c * 3 + t) % len(hard)]) for c in range(20) for t, role in enumerate(["system", "user", "assistant", "assistant", "us\\er\n<|x", None])]
    rows += [(30, 0, "assistant", "x"), (30, 0, "assistant", "x"), (30, None, "user", "first"), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, c string, x int")
    out = chat.format_conversations(df, BYTE_BPE).cache()
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    want = defaultdict(list)
    for c, t, role, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        said, loss = "".join(f"{r}\n{x}\n" for r, x in turns), "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    for r in out.collect():
        assert t.decode(r.ids) == r.formatted
        assert [x for x in chat.read_loss(r.formatted, r.loss_mask, r.loss_starts, r.loss_ends) if x] == [x for role, x in chat.read_turns(r.formatted) if role == "assistant" and x]
    assert chat.format_conversations(df.where("false"), BYTE_BPE).count() == 0
    with pytest.raises(ValueError):
        chat.read_turns("<|im_start|>user\nx")


def test_ranges_ascend_and_divide_an_id_of_many_rows(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 500, if(id = 1, null, id)) as i", "xxhash64(id) as h")
    got = df.withColumn("b", id_ranges(df.select("i"), 40)("i", "h")).orderBy(F.col("i").asc_nulls_first(), "h").collect()
    assert [r.b for r in got] == sorted(r.b for r in got) and got[0].b == 0
    many = Counter(r.b for r in got)
    assert len(many) == 40 and max(many.values()) < 200
    none = df.where("false")
    assert none.withColumn("b", id_ranges(none.select("i"), 40)("i", "h")).count() == 0 and df.withColumn("b", id_ranges(df.select("i"), 1)("i", "h")).where("b <> 0").isEmpty()


# ---- 6 token files --------------------------------------------------------------------------------------------


def test_token_files_read_back(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    rows = odd_texts() + [(20, "a  b\n\nc 'tis don't I'll\t x<|endoftext|>y  "), (21, "word. word, Word!! w\nNext\n"), (22, "naïve café\x1cz 1234abc"), (23, "a<|endoftext|>b"), (24, "<|endoftext|> c"), (25, "x \u3000y\x85 z\n \nq"), (26, " a b "), (27, "Ᲊᲊ aᲉb Ωμ'ς привет, don't")]
    left = defaultdict(list)
    for i, x in rows:
        left[i].append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    manifest = seekable_tokens.write_tokens(rows_of(spark, rows), fresh_path(spark, "tok"), BYTE_BPE, shards=3, frame_bytes=4096).cache()
    got = sorted(seekable_tokens.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        raw = bytes(r.ids)
        left[r.doc_id].remove(raw)  # rows of one id lie beside each other
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    assert t.encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65] and not any(left.values())
    assert seekable_tokens.read_tokens(manifest, with_ids=False).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    few = seekable_tokens.read_tokens(manifest, [7, 6]).collect()
    assert sorted(r.doc_id for r in few) == [6, 7]
    empty = seekable_tokens.write_tokens(none, fresh_path(spark, "tok"), BYTE_BPE)
    assert seekable_tokens.read_tokens(empty).count() == 0


def test_readers_touch_only_wanted_frames_and_see_damage():
    import io

    b = io.BytesIO()
    w = seekable_tokens.ShardWriter(b, 64)
    docs = [(k, bytes([k]) * (4 * (k % 40))) for k in range(100)]
    for d in docs:
        w.add(*d)
    w.close()
    r = seekable_tokens.ShardReader(b, b.tell())
    assert r.read(57) == docs[57][1] and r.frames_read <= 3
    assert list(r.documents()) == docs
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(b.getvalue()), read_across_frames=True).read() == b"".join(d[1] for d in docs)
    raw = bytearray(b.getvalue())
    raw[int(r.at[3]) + 12] ^= 0xFF
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(seekable_tokens.ShardReader(io.BytesIO(bytes(raw)), len(raw)).documents())
    with pytest.raises(ValueError, match="no seek table"):
        seekable_tokens.ShardReader(io.BytesIO(b"x" * 40), 40)


# ---- 8 SentencePiece ------------------------------------------------------------------------------------------


def texts8():
    return ["", "a", " a", "  a  b \n\tc ", "\n\nx", "a \n b", "é ﬁ", "日本語 text\n", "x\r\ny", " \n", "a\n\n  b  \n", *(x or "" for _, x in odd_texts()[:7]), prose(5, 400)]


def test_without_dropout_it_is_the_models_own_segmentation():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = merge_dropout.MergeDropout(PIECES, 0.0)
    for x, g in zip(texts8(), own.encode(texts8(), list(range(len(texts8())))), strict=True):
        assert np.frombuffer(g, "<u4").tolist() == sp.encode(x)


def test_dropout_is_seeded_varied_and_lossless():
    x = [*texts8(), "▁ literal ▁▁ marks", "\x00\x1f"]
    keys = list(range(len(x)))
    m = merge_dropout.MergeDropout(PIECES, 0.3, 7)
    a = m.encode(x, keys)
    assert [m.decode(g) for g in a] == x
    assert merge_dropout.MergeDropout(PIECES, 0.3, 7, limit=10).encode(x, keys) == a
    b = merge_dropout.MergeDropout(PIECES, 0.3, 8).encode(x, keys)
    assert a != b and [m.decode(g) for g in b] == x
    plain = merge_dropout.MergeDropout(PIECES, 0.0).encode(x, keys)
    assert sum(map(len, a)) > sum(map(len, plain))
    assert len(set(m.encode(["internationalization"] * 40, list(range(40))))) > 1
    every = merge_dropout.MergeDropout(PIECES, 1.0).encode(["ab cd"], [0])
    assert [m.bytes[i] for i in np.frombuffer(every[0], "<u4")] == [b" ", b"a", b"b", b" ", b"c", b"d"]


def test_dropout_is_drawn_for_every_occurrence():
    m = merge_dropout.MergeDropout(PIECES, 0.3, 7)
    words = " ".join(["internationalization"] * 400)
    cuts = {m.encode(["internationalization"], [k])[0] for k in range(400)}
    assert len(cuts) > 20
    # the trees give what each occurrence has by itself
    x = [*texts8(), words]
    own = merge_dropout.MergeDropout(PIECES, 0.3, 7)
    for _ in range(3):
        got = m.encode(x, list(range(len(x))))
    salts = merge_dropout.mix64(np.uint64(merge_dropout.xxhash.xxh64_intdigest((len(x) - 1).to_bytes(16, "little"), 7)) + np.arange(400, dtype=np.uint64))
    assert got[-1] == b"".join(own.segment(["internationalization"] * 400, salts)) and got == [own.encode([t], [k])[0] for k, t in enumerate(x)]


def test_pieces_over_odd_tables(odd, none):
    got = merge_dropout.encode_pieces(odd, PIECES).cache()
    assert got.count() == odd.count() and got.where("not restored").count() == 0
    back = merge_dropout.decode_pieces(got, PIECES).select("text").collect()
    assert sorted(r.text for r in back) == sorted(x or "" for _, x in odd_texts())
    assert merge_dropout.encode_pieces(none, PIECES).count() == 0


# ---- 9 fingerprints -------------------------------------------------------------------------------------------


def test_fingerprints_follow_each_other(spark, none):
    rows = odd_texts() + [(30 + k, prose(k, 50)) for k in range(60)]
    got = spotsigs.fingerprints(rows_of(spark, rows)).collect()
    order = sorted(((i, x or "") for i, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, x) in enumerate(order):
        y = order[(k + 1) % len(order)][1]
        n = len(x) // 4
        e = x[: len(x) - n] + y[:n]
        s = [spotsigs.spots(v) for v in (x, e, y)]
        want.append((i, len(x), hashlib.sha256(e.encode()).hexdigest(), spotsigs.packed(s[0]), spotsigs.packed(s[1]), round(spotsigs.likeness(s[0], s[1]), 9), round(spotsigs.likeness(s[0], s[2]), 9)))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=key) == sorted(want, key=key)
    assert spotsigs.fingerprints(none).count() == 0
    assert spotsigs.fingerprints(rows_of(spark, [(1, "only the one")])).first().near_next == 1.0


def test_spots_are_alike_for_edits_only():
    a, b = prose(1, 400), prose(2, 400)
    assert spotsigs.likeness(spotsigs.spots(a), spotsigs.spots(spotsigs.edited(a, b))) > 0.4
    assert spotsigs.likeness(spotsigs.spots("the"), spotsigs.spots("")) == 0 and spotsigs.likeness(spotsigs.spots(""), spotsigs.spots("!")) == 1
    assert (spotsigs.unpacked(spotsigs.packed(spotsigs.spots(a))) == spotsigs.spots(a)).all()
    assert spotsigs.likeness(np.arange(5, dtype=np.uint32), np.arange(50, dtype=np.uint32), 0.5) == 0.0


def test_similar_pairs_are_exact():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, r.integers(0, 40)).astype(np.uint32)) for _ in range(80)]
    sets += [np.unique(np.append(s, 70)) for s in sets[:40]]
    want = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if spotsigs.likeness(sets[a], sets[b]) >= 0.8 and len(sets[a]) + len(sets[b])]
    assert [(a, b) for a, b, _ in spotsigs.similar(sets, 0.8) if len(sets[a])] == want


def test_near_duplicates_by_spots(spark):
    rows = near_copies()
    got = {r.doc_id: (r.component_id, r.n_links) for r in spotsigs.near_duplicates(rows_of(spark, rows)).collect()}
    sets = {i: spotsigs.spots(x or "") for i, x in rows}
    links = {i: {j for j in sets if j != i and len(sets[i]) and len(sets[j]) and spotsigs.likeness(sets[i], sets[j]) >= 0.8} for i in sets}
    assert {i: n for i, (_, n) in got.items()} == {i: len(v) for i, v in links.items()}
    assert all(got[i][0] == got[j][0] for i, v in links.items() for j in v)


# ---- 10 language identification -------------------------------------------------------------------------------

TONGUES = {"en": ["the", "thing", "with", "other", "when"], "de": ["und", "nicht", "schön", "über", "für"], "fr": ["été", "où", "leçon", "nous", "quand"]}


def test_languages_of_held_out_documents(spark):
    rows = [(k, prose(k, 30, TONGUES[g]), g) for k, g in enumerate(list(TONGUES) * 60)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r.id: r.lang_pred for r in langid.identify(df, langid.train(df)).collect()}
    assert all(got[i] == g for i, _, g in rows if crc(i) % 5 == 0)


def test_rows_without_letters_take_no_share_and_one_language_may_fill_all(spark):
    rows = [(k, "12 34" if k % 3 else f"das {prose(k, 9)}", "de") for k in range(3000)] + [(5000 + k, f"le {prose(k, 9)}", "fr") for k in range(4)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 16)
    assert model.langs == ["de", "fr"]
    many = spark.createDataFrame([("g", k, (k * 7919) % 5003) for k in range(5000)], "g string, i long, h long").repartition(3)
    got = langid.lowest(many, 40).collect()
    assert len(got) <= 120 and {r.h for r in got} >= {r.h for r in many.orderBy("h").limit(40).collect()}


def test_nystrom_with_all_landmarks_is_kernel_ridge():
    texts, langs = [prose(k, 12, TONGUES[g]) for k, g in enumerate(list(TONGUES) * 8)], list(TONGUES) * 8
    m = langid.fit(texts, langs, landmarks=len(texts), ridge=1e-2)
    p = langid._presence(texts, m.column, m.width)
    k = (p @ p.T) / np.sqrt(np.outer(p.sum(1), p.sum(1)))
    y = np.where(np.array(langs)[:, None] == np.array(m.langs)[None, :], 1.0, -1.0)
    exact = k @ np.linalg.solve(k + 1e-2 * len(texts) * np.eye(len(texts)), y)
    assert np.abs((p @ m.product) / np.sqrt(p.sum(1))[:, None] - exact).max() < 0.02


def test_languages_over_odd_tables(spark, odd, none):
    model = langid.train(odd)
    got = {(r.id, r.lang_pred) for r in langid.identify(odd, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (9, "und"), (6, "en")} <= got
    assert langid.identify(none, model).count() == 0
    nothing = langid.train(none)
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert len(LONG) > 100_000


def test_batches_are_bounded_by_bytes_and_change_nothing(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "size"])

    rows = near_copies()
    docs = rows_of(spark, rows).coalesce(1)
    name, texts = "spark.sql.execution.arrow.maxBytesPerBatch", docs.select("text")
    had = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        assert arrow_map(texts, sizes, "n long, size long").count() == 1 and int(spark.conf.get(name)) == BATCH_BYTES
        spark.conf.set(name, "4000")
        got = arrow_map(texts, sizes, "n long, size long").collect()
        assert len(got) > 10 and sum(r.n for r in got) == len(rows) and max(r.size for r in got if r.n > 1) < 12_000
        joined = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(docs).collect()}
        assert joined == brute_join(rows, 3, 90)
        pieces = {r.id: r.ids_crc32 for r in merge_dropout.encode_pieces(docs, PIECES).collect()}
        own = merge_dropout.MergeDropout(PIECES, 0.1, 7)
        assert pieces == {i: zlib.crc32(own.encode([x or ""], [i])[0]) for i, x in rows}
    finally:
        spark.conf.unset(name) if had is None else spark.conf.set(name, had)


def test_work_is_removed(spark):
    remove_work(spark)
    df = written(spark.range(3), "some")
    assert df.count() == 3 and remove_work(spark) == 1
    with pytest.raises(Exception, match="(?i)not.exist|no such file"):
        df.count()
