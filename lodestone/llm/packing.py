"""Packing into sequences by patterns of few documents, fitted to the histogram of lengths by non-negative least squares.

Patterns are all sets of up to three lengths that fill a sequence exactly. How often each is used is the non-negative
least-squares solution that rebuilds the histogram; it is rounded, never beyond what there is, and what remains is packed
best fit first, by decreasing length, on counts (all of it where that takes fewer sequences). The fit sees the histogram only (one number for each length), so it costs
the same at every size. Documents get their place by their rank among those of their length: ranks come from counts by
task, a plan of ranges turns (length, rank) into sequence and offset.
"""

from __future__ import annotations

import functools
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, table, written
from .wordlists import starts_of

CAPACITY, END_ID = 2048, 0
STEPS = 400
#: Shares of the fitted uses that a plan is tried with.
SHARES = (1.0, 0.75, 0.5)
#: All of a chunk up to the ASCII punctuation at its end.
MARKS_AFTER = r"(?s)\A.*[^!-/:-@\[-`{-~]"
#: Bytes of texts that are encoded at once.
AT_ONCE = 4 << 20


class WordEncoder:
    """Encodes whole texts with a ``tokenizers`` file that drops white space; equal words are encoded once.

    No token crosses white space, so the ids of a text are those of its chunks between spaces in a row. Punctuation after a
    letter or digit is a token run of its own, and letters are lower-cased: a chunk is a base and the marks after it.
    Texts that hold one of the added tokens go through the library as they are. Bases are kept for as long as they were met
    among the last ``limit`` ones: memory is bounded, results don't depend on it.
    """

    def __init__(self, file: str, limit: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.limit = limit
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _library(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for k in range(0, len(chunks), 20_000) for e in self.tokenizer.encode_batch(chunks[k : k + 20_000], add_special_tokens=False)]

    def _table(self, names: list[str]) -> list[bytes]:
        """The ids of distinct bases; lower-case ASCII letters are one pre-token and go to the library's BPE model directly."""
        if len(self.cache) > self.limit:
            self.cache, self.older = {}, self.cache
        found = list(map(self.cache.get, names))
        missed = [k for k, v in enumerate(found) if v is None]
        tokenize, rest = self.model.tokenize, []
        for k in missed:
            c = names[k]
            v = self.older.get(c)
            if v is None and c.isalpha() and c.isascii():
                v = array("I", [t.id for t in tokenize(c)]).tobytes()
            if v is None:
                rest.append(k)
            else:
                found[k] = self.cache[c] = v
        for k, v in zip(rest, self._library([names[k] for k in rest]), strict=True):
            found[k] = self.cache[names[k]] = v
        return found

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers; null texts are empty."""
        texts = pc.fill_null(texts, "")
        size, a = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + AT_ONCE, "right")))
            yield from self._part(texts[a:z])
            a = z

    def _part(self, texts: pa.Array) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)
        for k in np.flatnonzero(whole).tolist():
            out[k] = self._library([texts[k].as_py()])[0]
        plain = np.flatnonzero(~whole)
        split = pc.split_pattern(pc.replace_substring_regex(texts.take(pa.array(plain)), r"[\t\n\r]", " "), " ")
        chunks = split.flatten().dictionary_encode()
        base = pc.ascii_rtrim(chunks.dictionary, string.punctuation)
        cut_off = pc.match_substring_regex(base, r"[\p{L}\p{N}]\z")
        base = pc.if_else(cut_off, base, chunks.dictionary)
        marks = pc.if_else(cut_off, pc.replace_substring_regex(chunks.dictionary, MARKS_AFTER, ""), "")
        base = pc.if_else(pc.string_is_ascii(base), pc.ascii_lower(base), base)
        pieces = pa.concat_arrays([base, marks]).dictionary_encode()
        ids = self._table(pieces.dictionary.to_pylist())
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        code = pieces.indices.to_numpy().reshape(2, -1).T[chunks.indices.to_numpy()].ravel()
        each, begin = length[code], starts_of(length)[code]
        ends = starts_of(each)
        pool = np.frombuffer(b"".join(ids), "<u4")
        flat = pool[np.repeat(begin - ends[:-1], each) + np.arange(int(ends[-1]))].tobytes()
        cut = (4 * ends[2 * (split.offsets.to_numpy() - split.offsets[0].as_py())]).tolist()
        for k, a, z in zip(plain.tolist(), cut, cut[1:], strict=False):
            out[k] = flat[a:z]
        return out


@functools.lru_cache(maxsize=1)
def encoder(file: str) -> WordEncoder:
    """One encoder for each worker process."""
    return WordEncoder(file)


# ---- plan ----------------------------------------------------------------------------------------------------


def patterns_of(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All sets of one to three of the ascending ``lengths`` that sum up to ``capacity``, as rows of places in it (-1: none)."""
    place = np.full(capacity + 1, -1, np.int64)
    place[lengths] = np.arange(len(lengths))
    out = []
    if len(lengths) and place[capacity] >= 0:
        out.append(np.array([[place[capacity], -1, -1]]))
    for k, a in enumerate(lengths.tolist()):
        b = lengths[lengths >= a] if 2 * a <= capacity else lengths[:0]
        if a < capacity and 2 * a <= capacity and place[capacity - a] >= 0:
            out.append(np.array([[k, place[capacity - a], -1]]))
        c = capacity - a - b
        b, c = b[c >= b], c[c >= b]
        hit = place[c] >= 0
        if hit.any():
            out.append(np.stack([np.full(int(hit.sum()), k), place[b[hit]], place[c[hit]]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit(patterns: np.ndarray, counts: np.ndarray, weights: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """How often each pattern is used: x >= 0 with the least weighted squares of (uses of each length - ``counts``).

    Accelerated projected gradient descent with restarts; the step comes from the largest singular value by powers.
    """
    n = len(counts)
    at = np.where(patterns < 0, n, patterns)
    w2 = np.append(weights**2, 0.0)

    def uses(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(at[:, k], x, n + 1) for k in range(3))

    def gradient(x: np.ndarray) -> np.ndarray:
        rest = w2 * (uses(x) - np.append(counts, 0.0))
        return rest[at[:, 0]] + rest[at[:, 1]] + rest[at[:, 2]]

    v = np.ones(len(patterns))
    top = 1.0
    for _ in range(20):
        g = w2 * uses(v)
        v = g[at[:, 0]] + g[at[:, 1]] + g[at[:, 2]]
        top = float(np.linalg.norm(v))
        v /= top or 1.0
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - gradient(y) / (1.05 * top))
        if float((y - new) @ (new - x)) > 0:
            t = 1.0
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def rounded(patterns: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of uses, and what remains of ``counts``: fractions are carried on from pattern to pattern, uses that exceed what there is are cut."""
    total = np.floor(np.cumsum(x) + 0.5).astype(np.int64)
    uses, left = np.diff(total, prepend=0), counts.astype(np.int64).copy()
    for p in np.flatnonzero(uses).tolist():
        members = [k for k in patterns[p].tolist() if k >= 0]
        most = min(left[k] // members.count(k) for k in set(members))
        uses[p] = min(int(uses[p]), int(most))
        for k in members:
            left[k] -= uses[p]
    return uses, left


def best_fit(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit by decreasing length on counts: (contents as (length, copies), number of sequences) of each kind of sequence."""
    open_by: list[list[tuple[list[tuple[int, int]], int]]] = [[] for _ in range(capacity + 1)]
    for length, left in sorted(zip(lengths, counts, strict=True), reverse=True):
        room = length
        while left and room <= capacity:
            if not open_by[room]:
                room += 1
                continue
            held, many = open_by[room].pop()
            each = room // length
            full = min(many, left // each)
            if full:
                open_by[room - each * length].append(([*held, (length, each)], full))
            left -= full * each
            many -= full
            if many and left:  # fewer than a full share: one sequence takes them
                open_by[room - left * length].append(([*held, (length, left)], 1))
                many, left = many - 1, 0
            if many:
                open_by[room].append((held, many))
        each = capacity // length
        if left // each:
            open_by[capacity - each * length].append(([(length, each)], left // each))
        if left % each:
            open_by[capacity - left % each * length].append(([(length, left % each)], 1))
    return [kind for kinds in open_by for kind in kinds]


def _contents(members: list[int]) -> list[tuple[int, int]]:
    return [(n, members.count(n)) for n in sorted(set(members), reverse=True)]


class Plan:
    """Ranges of ranks: the documents ``first`` to ``first + many * copies`` of a length fill ``copies`` places of ``many`` sequences each.

    Where lengths are few, exact patterns may use up what best fit needs: of the fitted uses, shares of them and none, the
    plan with the fewest sequences counts, patterns before none.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY) -> None:
        lengths = np.array(sorted(k for k, v in histogram.items() if v), np.int64)
        counts = np.array([histogram[k] for k in lengths.tolist()], np.int64)
        patterns = patterns_of(lengths, capacity)
        kinds = best_fit(lengths.tolist(), counts.tolist(), capacity)
        self.fitted = 0
        if len(patterns):
            x = fit(patterns, counts.astype(float), lengths / capacity)
            for share in SHARES:
                uses, left = rounded(patterns, share * x, counts)
                own = [(_contents(lengths[patterns[p][patterns[p] >= 0]].tolist()), int(uses[p])) for p in np.flatnonzero(uses).tolist()]
                rest = best_fit(lengths.tolist(), left.tolist(), capacity)
                if sum(many for _, many in own + rest) < sum(many for _, many in kinds) + (not self.fitted):
                    kinds, self.fitted = own + rest, sum(many for _, many in own)
        self.sequences = sum(many for _, many in kinds)
        rows, used, base = [], dict.fromkeys(lengths.tolist(), 0), 0
        for contents, many in kinds:
            offset = 0
            for length, copies in contents:
                rows.append((length, used[length], copies, base, offset))
                used[length] += many * copies
                offset += length * copies
            base += many
        rows.sort()
        self.table = np.array(rows, np.int64).reshape(-1, 5)
        self.key = (self.table[:, 0] << 44) + self.table[:, 1]

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the documents with these lengths and ranks (from 0) among their length."""
        row = self.table[np.searchsorted(self.key, (length << 44) + rank, "right") - 1]
        k = rank - row[:, 1]
        return row[:, 3] + k // row[:, 2], row[:, 4] + k % row[:, 2] * length


# ---- Spark ---------------------------------------------------------------------------------------------------

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, _part int, _nth long"


def pieces(documents: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' pieces of at most ``capacity`` tokens, their end id included; ``_nth`` counts a task's pieces of each length."""
    docs = documents.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    end = array("I", [END_ID]).tobytes()
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, coder = TaskContext.get().partitionId(), [0] * (capacity + 1), encoder(tokenizer_file)
        for b in batches:
            rows: list[tuple] = []
            for i, raw in zip(b.column(0).to_pylist(), coder.ids(b.column(1)), strict=True):
                raw += end
                for k in range(0, len(raw), 4 * capacity):
                    own = raw[k : k + 4 * capacity]
                    n = len(own) // 4
                    rows.append((i, k // (4 * capacity), k // 4, n, zlib.crc32(own), own if with_ids else None, part, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return arrow_map(docs, run, PIECES)


def pack(documents: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places every document in sequences of ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Only documents longer than a sequence are cut. A null text is an empty one: its end id alone. Repeated rows and rows
    without id are documents of their own. An empty table gives no rows. The driver gets one number for each length; a
    length's ranks are summed over tasks, whose number bounds what one window holds.
    """
    spark = documents.sparkSession
    rows = written(pieces(documents, tokenizer_file, capacity, with_ids, id_col, text_col), "pieces")
    counts = written(rows.groupBy("_part", "length").agg(F.count("*").alias("n")), "piece-counts")
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    ranked = rows.join(base, ["_part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("_nth") + F.col("_base")).alias("rank"))
    shared = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            sequence, offset = shared.value.places(b.column(3).to_numpy(), b.column(6).to_numpy())
            cols = [*b.columns[:5], pa.array(sequence), pa.array(offset), *([b.column(5)] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"][: len(cols)])

    return arrow_map(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of a result with ids: sequence_id, ids (32-bit integers in a row), where each piece begins."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.transform("p", lambda p: p["offset"]).alias("offsets"))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    """Packs all ``documents`` into sequences of 2,048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
