"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND with every passage of the corpus.

The items are the indexed documents, the passages the queries. Impacts are divided by an item's score against its own
words, so one threshold holds for all items. Items fall into classes of length by powers of two; the passages that a class
is searched with are windows of twice its longest possible item, half overlapping, so each item's copy lies whole in one of
them, and what is found for an item doesn't depend on the other items' lengths or on how items are cut into blocks. Before
WAND, the largest impacts in ranges of items bound the scores of the passages of many texts in one product; only passages
whose bound reaches the threshold are searched: this skips no hit. What is retrieved counts when question and answer both
overlap. Items of fewer than ``LEAST_WORDS`` words are no passages of their own: such an item is found wherever its words
stand beside each other in that order. Items come in blocks of bounded size, each a file in the shared folder; one scan of the texts
goes through all of them. Document frequencies cover all items.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, file_system, fresh_path, table

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
BLOCK = 16
RANGES = 64
SENTENCE = re.compile(r"[.!?]\s+")
#: Bytes of item texts in one index block; characters of texts that are searched at once, and that meet a block at once.
INDEX_BYTES = 8 << 20
AT_ONCE, PER_BLOCK = 1 << 20, 32 << 20
LEAST_WORDS, SHORTEST = 4, 16


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words: the last sentence answers; an item of one sentence (or a last one of over half) is cut at three quarters."""
    words = WORD.findall(text.lower())
    ends = [m.end() for m in SENTENCE.finditer(text.strip())]
    answer = WORD.findall(text.strip()[ends[-1] :].lower()) if ends else []
    k = len(words) - len(answer)
    if not answer or 2 * len(answer) > len(words):
        k = -(-3 * len(words) // 4)
    return words[:k], words[k:]


def grams(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


class BlockMaxIndex:
    """Inverted index of the items of one length class, with block maxima; ``search`` returns all whose normalised score reaches a threshold.

    Items are (id, question words, answer words), of at most ``longest`` words together.
    """

    def __init__(self, items: list[tuple[int | None, list[str], list[str]]], df: dict[str, int], n_items: int, mean_len: float, threshold: float, longest: int, ranges: int = RANGES) -> None:
        self.threshold, self.longest = threshold, longest
        self.ids = [i for i, _, _ in items]
        self.question = [grams(q) for _, q, _ in items]
        self.answer = [set(a) for _, _, a in items]
        posts: dict[str, list[tuple[int, float]]] = {}
        for k, (_, q, a) in enumerate(items):
            words = q + a
            tf: dict[str, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            impact = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean_len)) for w, f in tf.items()}
            own = sum(impact.values())
            for w in sorted(impact):
                posts.setdefault(w, []).append((k, impact[w] / own))
        names = sorted(posts)
        self.term = {w: j for j, w in enumerate(names)}
        self.docs = [[k for k, _ in posts[w]] for w in names]
        self.impact = [[v for _, v in posts[w]] for w in names]
        self.most = [max(v) for v in self.impact]
        self.block_max = [[max(v[a : a + BLOCK]) for a in range(0, len(v), BLOCK)] for v in self.impact]
        self.block_last = [[d[min(a + BLOCK, len(d)) - 1] for a in range(0, len(d), BLOCK)] for d in self.docs]
        # the largest impact of each term in each of the ranges of items: bounds for a whole passage at once
        wide = -(-len(items) // ranges)
        self.range_max = np.zeros((len(names), -(-len(items) // wide)), np.float32)
        for t, (docs, impacts) in enumerate(zip(self.docs, self.impact, strict=True)):
            np.maximum.at(self.range_max[t], np.array(docs) // wide, np.array(impacts, np.float32))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item number, score) of every item whose distinct ``terms`` sum up to the threshold, by block-max WAND."""
        need = self.threshold - 1e-12
        at = [[self.docs[t][0], 0, t] for t in terms]  # current item, position, term
        out = []
        while at:
            at.sort()
            total, pivot = 0.0, -1
            for j, (_, _, t) in enumerate(at):
                total += self.most[t]
                if total >= need:
                    pivot = j
                    break
            if pivot < 0:
                break
            d = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == d:
                pivot += 1
            bound, jump = 0.0, at[pivot + 1][0] if pivot + 1 < len(at) else 1 << 60
            for _, p, t in at[: pivot + 1]:
                last, b = self.block_last[t], p // BLOCK
                while b < len(last) and last[b] < d:
                    b += 1
                if b < len(last):
                    bound += self.block_max[t][b]
                    jump = min(jump, last[b] + 1)
            if bound >= need:
                if at[0][0] == d:
                    score = sum(self.impact[t][p] for _, p, t in at[: pivot + 1])
                    if score >= need:
                        out.append((d, score))
                    target, moved = d + 1, range(pivot + 1)
                else:
                    target, moved = d, range(pivot)
            else:
                target, moved = max(jump, d + 1), range(pivot + 1)
            for j in moved:
                self._advance(at[j], target)
            at = [c for c in at if c[0] >= 0]
        return sorted(out)

    def _advance(self, cursor: list[int], target: int) -> None:
        docs, last = self.docs[cursor[2]], self.block_last[cursor[2]]
        b = cursor[1] // BLOCK
        while b < len(last) and last[b] < target:
            b += 1
        p = max(cursor[1], b * BLOCK)
        while p < len(docs) and docs[p] < target:
            p += 1
        cursor[0], cursor[1] = (docs[p], p) if p < len(docs) else (-1, p)

    def passages(self, term: np.ndarray, doc: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, window) of the passages that an item may reach the threshold with; of each word its term here (-1: none), text and place."""
        halves = -(-lengths // self.longest)
        base = np.cumsum(halves) - halves
        live = np.flatnonzero(term >= 0)
        key = np.unique((base[doc[live]] + place[live] // self.longest) * len(self.docs) + term[live])
        if not len(key):
            return key, key
        half = key // len(self.docs)
        first = np.flatnonzero(np.concatenate([[True], half[1:] != half[:-1]]))
        sums = np.zeros((int(halves.sum()) + 1, self.range_max.shape[1]), np.float32)
        sums[half[first]] = np.add.reduceat(self.range_max[key % len(self.docs)], first, axis=0)
        owner = np.repeat(np.arange(len(lengths)), halves)
        last = np.append(owner[1:] != owner[:-1], True)
        bound = np.where(last, sums[:-1].max(1), (sums[:-1] + sums[1:]).max(1))
        at = np.flatnonzero(bound >= self.threshold - 1e-3)
        return owner[at], at - base[owner[at]]


class ItemIndex:
    """The items of one block: an index for each length class, and the short items by their words."""

    def __init__(self, items: list[tuple[int | None, str]], df: dict[str, int], n_items: int, mean_len: float, threshold: float, anywhere: bool = True) -> None:
        self.anywhere = anywhere
        by: dict[int, list] = {}
        self.short: dict[tuple[str, ...], list[int | None]] = {}
        for i, t in items:
            q, a = split_item(t)
            if len(q) + len(a) < LEAST_WORDS:
                self.short.setdefault(tuple(q + a), []).append(i)
            else:
                by.setdefault(max(SHORTEST, 1 << (len(q) + len(a) - 1).bit_length()), []).append((i, q, a))
        self.openers = {w[0] for w in self.short if w}
        self.short_lengths = sorted({len(w) for w in self.short if w})
        many = sum(map(len, by.values()))
        self.classes = [BlockMaxIndex(part, df, n_items, mean_len, threshold, n, max(8, RANGES * len(part) // many)) for n, part in sorted(by.items())]
        names = sorted({w for c in self.classes for w in c.term})
        self.term = {w: j for j, w in enumerate(names)}
        self.own = [np.array([*(c.term.get(w, -1) for w in names), -1], np.int64) for c in self.classes]

    def _short(self, words: list[str]) -> list[tuple[int | None, float, float, float, int]]:
        """The short items of a text, each at its first place."""
        if not self.anywhere:
            return [(i, 1.0, 1.0, 1.0, 0) for i in self.short.get(tuple(words), ())] if len(words) < LEAST_WORDS else []
        places = [k for k, w in enumerate(words) if w in self.openers] if self.openers else ()
        found: dict[tuple[str, ...], int] = {}
        for k in places:
            for n in self.short_lengths:
                run = tuple(words[k : k + n])
                if len(run) == n and run in self.short:
                    found.setdefault(run, k)
        return [(i, 1.0, 1.0, 1.0, k) for run, k in sorted(found.items()) for i in self.short[run]]

    def hits(self, texts: list[list[str]], least_question: float = 0.5, least_answer: float = 0.5) -> list[list[tuple[int | None, float, float, float, int]]]:
        """Of each text (its words) the verified items: (item id, score, question overlap, answer overlap, first word of the passage)."""
        out: list[list] = [self._short(w) for w in texts]
        lengths = np.array([len(w) for w in texts], np.int64)
        get, none = self.term.get, len(self.term)
        term = np.fromiter((get(w, none) for w in chain.from_iterable(texts)), np.int64, int(lengths.sum()))
        known = np.flatnonzero(term < none)
        doc = np.repeat(np.arange(len(texts)), lengths)[known]
        place = known - (np.cumsum(lengths) - lengths)[doc]
        term = term[known]
        for c, own in zip(self.classes, self.own, strict=True):
            best: dict[tuple[int, int], tuple] = {}
            for d, k in zip(*(x.tolist() for x in c.passages(own[term], doc, place, lengths)), strict=True):
                passage = texts[d][k * c.longest : (k + 2) * c.longest]
                terms = sorted({c.term[w] for w in passage if w in c.term})
                found = c.search(terms) if c.range_max[terms].sum(0).max() >= c.threshold - 1e-3 else []
                if not found:
                    continue
                held, seen = [grams(passage, n) for n in (1, 2, 3)], set(passage)
                for j, score in found:
                    q = c.question[j]
                    over_q = len(q & held[len(next(iter(q))) - 1]) / len(q)
                    over_a = len(c.answer[j] & seen) / len(c.answer[j])
                    if over_q >= least_question and over_a >= least_answer:
                        row = (c.ids[j], score, over_q, over_a, k * c.longest)
                        if (d, j) not in best or row[1:4] > best[d, j][1:4]:
                            best[d, j] = row
            for d, j in sorted(best):
                out[d].append(best[d, j])
        return out


def build_index(items: DataFrame, threshold: float = 0.5, id_col: str = "item_id", text_col: str = "text", anywhere: bool = True) -> list[str]:
    """Writes the items' index files, ``INDEX_BYTES`` of text each at the driver at a time; returns their URIs.

    Items without id are indexed as any others; items without words can't be found and are left out. Without ``anywhere``
    items of fewer than ``LEAST_WORDS`` words are found in texts of just their words only.
    """
    spark = items.sparkSession
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("b")).first()
    if not size["n"]:
        return []
    blocks = -(-size["b"] // INDEX_BYTES) or 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            tf: dict[str, int] = {}
            lens = 0
            n = 0
            for t in b.column(0).to_pylist():
                w = WORD.findall(t.lower())
                lens, n = lens + len(w), n + bool(w)
                for x in set(w):
                    tf[x] = tf.get(x, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([*tf, "", " "]), pa.array([*tf.values(), lens, n], pa.int64())], ["w", "n"])

    df = arrow_map(rows.select("t"), count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    total = {r["w"]: r["n"] for r in df.where("w in ('', ' ')").collect()}
    block = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    path, out = fresh_path(spark, "items"), []
    for k in range(blocks):
        part = sorted(((r["i"], r["t"]) for r in rows.where(block == k).collect() if WORD.search(r["t"])), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        if not part:
            continue
        own = {w for _, t in part for w in WORD.findall(t.lower())}
        if blocks == 1:
            known = {r["w"]: r["n"] for r in df.collect()}
        else:
            names = spark.createDataFrame([(w,) for w in sorted(own)], "w string")
            known = {r["w"]: r["n"] for r in df.join(F.broadcast(names), "w").collect()}
        out.append(f"{path}/block-{k:06d}")
        store, at = file_system(out[-1])
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(at, compression=None) as sink:
            sink.write(pickle.dumps(ItemIndex(part, known, total[" "], total[""] / total[" "], threshold, anywhere), 5))
    return out


@functools.lru_cache(maxsize=4)
def load_index(uri: str) -> ItemIndex:
    """One block's index; a worker keeps four of them."""
    store, at = file_system(uri)
    with store.open_input_stream(at, compression=None) as src:
        return pickle.loads(src.read())


def search_texts(uris: list[str], texts: list[str | None]) -> list[list[tuple[int | None, float, float, float, int]]]:
    """The verified items of whole texts in all blocks; a block is read again after every ``PER_BLOCK`` characters only."""
    out: list[list] = [[] for _ in texts]
    a = 0
    while a < len(texts):
        z, size, parts = a, 0, [a]
        while z < len(texts) and (z == a or size < PER_BLOCK):
            size += len(texts[z] or "")
            z += 1
            if z == len(texts) or size >= PER_BLOCK or sum(len(t or "") for t in texts[parts[-1] : z]) >= AT_ONCE or z - parts[-1] >= 256:
                parts.append(z)
        for uri in uris:
            index = load_index(uri)
            for b, c in zip(parts, parts[1:], strict=False):
                for k, found in enumerate(index.hits([WORD.findall((t or "").lower()) for t in texts[b:c]]), b):
                    out[k] += found
        a = z
    return out


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def contaminated(documents: DataFrame, items: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The verified (document, item) pairs of all whole texts; null and empty texts have none, repeated rows have theirs each.

    Of passages with equal figures the first one counts; an item without id gives pairs with a null item_id.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    uris = build_index(items, threshold)
    if not uris:
        return documents.sparkSession.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *h) for i, found in zip(b.column(0).to_pylist(), search_texts(uris, b.column(1).to_pylist()), strict=True) for h in found]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    return arrow_map(docs, run, SCHEMA)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Finds the items of ``benchmark`` in all ``documents``."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a test item go, those with null or empty texts stay; all columns of ``docs`` stay.

    An item of fewer than ``LEAST_WORDS`` words takes only documents away that consist of just its words: a word or two of
    common language would take clean ones too.
    """
    at = docs.columns.index("text")
    uris = build_index(table(spark, sf_dir, "benchmark"), anywhere=False)
    if not uris:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not found for found in search_texts(uris, b.column(at).to_pylist())], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
