"""Resampling, packing and ranked search against brute-force versions, and over odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import odd_texts, prose, rows_of

from lodestone.llm import packing, ranked_search, resampling
from lodestone.llm.wordlists import flat_rows, packed_rows, word_lists

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LOWER = {c: c + 32 for c in range(65, 91)}


def test_words_are_cut_as_the_pattern_says():
    texts = [t for _, t in odd_texts()] + ["A.B--c", "  É1 ÉA_b\x7f", "\x00", "a", " a ", "É" * 3]
    for separators in (resampling.SEPARATORS, ranked_search.SEPARATORS):
        words, lengths = word_lists(pa.array(texts, pa.string()), separators)
        want = [re.findall(f"[^{separators}]+", (t or "").translate(LOWER)) for t in texts]
        assert lengths.tolist() == list(map(len, want)) and words.to_pylist() == [w for ws in want for w in ws]
    flat = np.arange(7, dtype="<u2")
    got, n = flat_rows(packed_rows(flat, np.array([0, 3, 0, 4])).slice(1), "<u2")
    assert got.tolist() == flat.tolist() and n.tolist() == [3, 0, 4]


# ---- 11 resampling -------------------------------------------------------------------------------------------


def brute_resample(docs, target, percent, least_words, low, high, buckets, seed):
    def features(t):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        return [zlib.crc32(" ".join(ws[k : k + n]).encode()) % buckets for n in range(low, high + 1) for k in range(len(ws) - n + 1)], len(ws)

    source, aim = Counter(b for _, t in docs for b in features(t)[0]), Counter(b for t in target for b in features(t)[0])
    s_all, t_all = sum(source.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (t_all * 0 + s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, t in docs:
        f, n = features(t)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least_words))
    enough = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    ranks = [((*r[:4],), k + 1) for k, r in enumerate(enough[: percent * len(enough) // 100])]
    for r in rows:
        drawn[(*r[:4],)] += 1
    for r, _ in ranks:
        drawn[r] -= 1
    return Counter([*((*r, k) for r, k in ranks), *((*r, None) for r in drawn.elements())])


@pytest.mark.parametrize(("low", "high", "buckets", "hot"), [(1, 1, 10_000, 1000), (1, 3, 50, 2), (2, 2, 70_000, 0)])
def test_resampling_equals_brute_force(spark, monkeypatch, low, high, buckets, hot):
    monkeypatch.setattr(resampling, "HOT_ROWS", hot)
    r = random.Random(5)
    docs = [(k, prose(r.randrange(40), r.choice([0, 5, 19, 20, 60]))) for k in range(150)] + [(1000 + k, prose(3, 60)) for k in range(90)]
    docs += [(i, t) for i, t in odd_texts() if i != 6] + [(7, None)] * 3
    target = [prose(k, 50) for k in range(3)] + [None, ""]
    got = resampling.resample(rows_of(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), 30, 20, low, high, buckets, "9")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute_resample(docs, target, 30, 20, low, high, buckets, "9")


def test_resampling_over_odd_tables(spark, odd, none):
    empty = spark.createDataFrame([], "text string")
    assert resampling.resample(none, empty).count() == 0
    got = resampling.resample(odd, empty, percent=100).collect()
    assert len(got) == odd.count() and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1 + sum(r.rank is not None for r in got)))
    assert {r.doc_id: r.weight for r in got if r.n_features == 0} == {3: 0, 4: 0, 5: 0, None: 0}


def test_resampling_draws_what_is_like_the_target(spark):
    docs = [(k, " ".join(["stock", "market", f"w{k % 7}"] * 10) if k % 20 == 0 else prose(k, 30)) for k in range(400)]
    got = resampling.resample(rows_of(spark, docs), spark.createDataFrame([("stock market " * 30,)], "text string"), 5).where("rank is not null").collect()
    assert len(got) == 20 and all(r.doc_id % 20 == 0 for r in got)


# ---- 12 packing ----------------------------------------------------------------------------------------------


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(rows, docs, capacity):
    """Every piece of every document once, sequences gapless and not overfull."""
    want = Counter()
    for i, t in docs:
        ids = np.array(plain_ids(t), "<u4")
        for k in range(0, len(ids), capacity):
            own = ids[k : k + capacity]
            want[i, k // capacity, k, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


def test_packing_is_whole_gapless_and_dense(spark, odd, none):
    texts = [(k, prose(k, (k * 7) % 90)) for k in range(120)] + [(500 + k, prose(1, 20)) for k in range(60)]
    strange = ["it's DON'T they're x's' a'S", "H̱ello H̱ KK İİ", "a b c　d", "tab\there\r\n\nnew", "<|endoftext|> in <|startoftext|>text", "12 3a4 a1b2, x… y…! “q”.", "é! ß? Ως ΑΣ. é, ﬁ", "'' 's 't' '", "日本語, 中文!!", "word" * 300 + "!?", "a!b a! !a", "́ x", "x ́."]
    docs = texts + list(enumerate(strange, 900)) + [(i, t) for i, t in odd_texts() if i != 6]
    got = packing.pack(rows_of(spark, docs).repartition(5), WORD_BPE, 128, with_ids=True)
    rows = got.collect()
    used = check_packing(rows, docs, 128)
    tokens = sum(r.length for r in rows)
    lengths = Counter(r.length for r in rows)
    best = sum(n for _, n in packing.best_fit(list(lengths), list(lengths.values()), 128))
    assert -(-tokens // 128) <= used <= best
    whole = {r.sequence_id: (r.ids, r.offsets) for r in packing.sequences(got).collect()}
    for r in rows:
        ids, offsets = whole[r.sequence_id]
        assert zlib.crc32(ids[4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32 and r.offset in offsets
    assert packing.pack(none, WORD_BPE).count() == 0
    assert check_packing(packing.pack(odd, WORD_BPE).collect(), odd_texts(), 2048) > 1


def test_patterns_are_all_that_fill_a_sequence():
    lengths = np.array([1, 2, 3, 5, 8, 10])
    got = {tuple(sorted(int(lengths[k]) for k in p if k >= 0)) for p in packing.patterns_of(lengths, 10)}
    want = {t for t in [(10,), *((a, b) for a in lengths for b in lengths if a <= b), *((a, b, c) for a in lengths for b in lengths for c in lengths if a <= b <= c)] if sum(t) == 10}
    assert got == {tuple(map(int, t)) for t in want}


def test_fit_is_the_least_squares_solution():
    r = np.random.default_rng(3)
    lengths = np.arange(1, 25)
    patterns = packing.patterns_of(lengths, 24)
    counts, weights = r.integers(0, 50, len(lengths)).astype(float), lengths / 24
    x = packing.fit(patterns, counts, weights, 20_000)
    a = np.zeros((len(lengths), len(patterns)))
    for j, p in enumerate(patterns.tolist()):
        for k in p:
            if k >= 0:
                a[k, j] += weights[k]
    slope = a.T @ (a @ x - weights * counts)
    assert x.min() >= 0 and slope.min() > -1e-3 and np.abs(slope[x > 1e-6]).max() < 1e-3  # conditions of optimality


@pytest.mark.parametrize("scale", [1, 1000])
def test_plans_reach_best_fit_and_place_every_rank(scale):
    r = np.random.default_rng(scale)
    histogram = {int(k): int(v) * scale for k, v in zip(*np.unique(np.minimum(r.geometric(0.004, 3000), 512), return_counts=True), strict=True)}
    plan = packing.Plan(histogram, 512)
    best = sum(n for _, n in packing.best_fit(list(histogram), list(histogram.values()), 512))
    assert -(-sum(k * v for k, v in histogram.items()) // 512) <= plan.sequences <= best and plan.fitted
    if scale == 1:
        length, rank = (np.concatenate(c) for c in zip(*((np.full(v, k), np.arange(v)) for k, v in histogram.items()), strict=True))
        sequence, offset = plan.places(length, rank)
        order = np.lexsort((offset, sequence))
        new = np.diff(sequence[order], prepend=-1) > 0
        assert (offset[order][new] == 0).all() and ((offset + length)[order][:-1] == offset[order][1:])[~new[1:]].all()
        assert (offset + length).max() <= 512 and len(set(sequence.tolist())) == plan.sequences == sequence.max() + 1
    assert packing.Plan({}, 8).sequences == 0 and packing.Plan({3: 5}, 8).sequences == 3


# ---- 13 ranked search ----------------------------------------------------------------------------------------


def terms_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute_search(docs, items, k):
    held = [(i, terms_of(t)) for i, t in docs if terms_of(t)]
    n, words = len(held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for item, text in items:
        rows = []
        for i, t in held:
            tf, m = Counter(t), 100 - 75 + (75 * len(t) * n) // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in terms_of(text) if tf[w])
            if s > 0:
                rows.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(rows)[:k])]
    return Counter(out)


@pytest.mark.parametrize(("segment", "share", "query"), [(8 << 20, 16, 1 << 20), (3000, 3, 200), (1, 2, 1)])
def test_search_equals_brute_force(spark, monkeypatch, segment, share, query):
    monkeypatch.setattr(ranked_search, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(ranked_search, "FIRST_SHARE", share)
    monkeypatch.setattr(ranked_search, "QUERY_BYTES", query)
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 5)
    r = random.Random(2)
    docs = [(k, prose(r.randrange(60), r.choice([3, 20, 70]))) for k in range(150)] + [(i, t) for i, t in odd_texts() if i != 6] + [(2000, prose(7, 20))] * 12
    items = [(k, prose(k, 15)) for k in range(20)] + [(3, "the THE the derlon"), (3, "the THE the derlon"), (None, prose(1, 5)), (50, None), (51, ""), (52, "nowhere-to-be-found"), (53, "日本語 x É")]
    conf = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if segment < 8 << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "500")
    try:
        index = ranked_search.build_index(rows_of(spark, docs).repartition(3))
        got = ranked_search.search(index, spark.createDataFrame(items, "item_id long, text string"), 4)
        assert Counter(map(tuple, got.collect())) == brute_search(docs, items, 4)
    finally:
        if conf is None:
            spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        else:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", conf)


def test_blocks_below_the_bound_are_not_scored():
    docs = [(k, "rare needle " * 3 + "common" if k == 300 else prose(k, 30) + " common") for k in range(1000)]
    ids, texts = pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs])
    names = [c.split()[0] for c in ranked_search.FORWARD.split(", ")]
    row = dict(zip(names, ranked_search._forward(ids, texts), strict=True))
    import io

    seg = ranked_search.Segment(io.BytesIO(b"x" * 9 + ranked_search.Segment.sealed(row, row["n_docs"], row["n_words"])), 9)
    queries = ranked_search.Queries(np.array([5]), ["needle", "common", "absent"], np.array([0, 0, 0]), np.array([0, 1, 2]), np.array([7000, 1, 9]))
    best = [ranked_search.Best(1)]
    scored = ranked_search.search_segment(seg, queries, best)
    assert best[0].rows[0][2] == 300 and scored == 1 and len(seg.ends) - 1 == 16


def test_search_over_odd_tables(spark, odd, none):
    items = spark.createDataFrame([(1, prose(1, 60)), (2, None)], "item_id long, text string")
    assert ranked_search.search(ranked_search.build_index(none), items).count() == 0
    index = ranked_search.build_index(odd)
    assert ranked_search.search(index, items.where("false")).count() == 0
    got = ranked_search.search(index, items).orderBy("rank").collect()
    assert [r.doc_id for r in got][:4] == [6, 1, 1, 2] and [r["rank"] for r in got] == list(range(1, len(got) + 1))
