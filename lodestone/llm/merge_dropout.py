"""SentencePiece BPE with seeded merge-dropout.

A text is cut where no piece of the model can lie across (before runs of spaces after other characters, and at line
ends), so every chunk is segmented by itself. Chunks are merged many at a time: each round takes, in every chunk, the
best-scored adjacent pair (leftmost on ties) off its agenda. A candidate merge is skipped when a hash keyed by seed,
document, the chunk's position in it, place and merged piece falls below ``dropout``: every occurrence of a word is drawn
by itself. What the draws lead to is kept as a tree for each chunk met again (a node is the next merge, with a branch
where it is made and one where it is skipped), which all occurrences walk at once; those that leave the tree are segmented
by themselves, with the same result. Dropout 0 gives the model's own pieces.
Characters without a piece, and a literal U+2581, become byte pieces: decoding restores every text exactly.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK, arrow_map, mix64, table

SPACE = 0x2581
NONE = np.int64(1 << 40)
CHUNK = re.compile(r"\n[^ \n]*| +[^ \n]*")
#: Longer chunks have no tree; a node is laid out when occurrences have left the tree there so often; characters dealt with at once.
LONGEST, OFTEN, AT_ONCE = 32, 6, 2_000_000
OPEN, LEAF = -1, -2
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Trees(dict):
    """The root of each chunk's tree, in arrays of nodes: what is hashed, the branches (``take``: OPEN, LEAF), and the
    state behind an open node (a chunk, or a way down a tree and the step that is skipped) or the ids of a leaf."""

    def __init__(self) -> None:
        self.draw, self.left = np.zeros(1024, np.uint64), np.zeros(1024, np.int64)
        self.take, self.skip = np.full(1024, OPEN, np.int64), np.full(1024, OPEN, np.int64)
        self.state: list = [None]  # node 0 stands for the chunks without a tree
        self.new: list[tuple[int, int, int, int]] = []

    def fit(self) -> None:
        """Room for all nodes, and the branches laid out since."""
        more = len(self.state) - len(self.take)
        if more > 0:
            more += len(self.take)
            self.draw, self.left = np.concatenate([self.draw, np.zeros(more, np.uint64)]), np.concatenate([self.left, np.zeros(more, np.int64)])
            self.take, self.skip = (np.concatenate([x, np.full(more, OPEN, np.int64)]) for x in (self.take, self.skip))
        if self.new:
            at, draw, take, skip = np.array(self.new, np.int64).T
            self.draw[at], self.take[at], self.skip[at] = draw.astype(np.uint64), take, skip
            self.new = []

    def __missing__(self, chunk: str) -> int:
        if len(chunk) > LONGEST:
            return 0
        self[chunk] = n = len(self.state)
        self.state.append(chunk)
        return n


class MergeDropout:
    """Encoder and decoder for one model file; ``limit`` bounds the nodes of kept trees, results don't depend on it."""

    def __init__(self, file: str, dropout: float = 0.1, seed: int = 0, limit: int = 1_000_000) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        n = sp.get_piece_size()
        if sp.decode(sp.encode("  a  b \n")) != "  a  b \n":
            raise ValueError("the model changes white space; its decoding isn't lossless")
        self.vocab, self.dropout, self.seed, self.limit = n, dropout, seed, limit
        self.below = np.uint64(min(MASK, int(dropout * 2.0**64)))
        self.byte_id = np.full(256, -1, np.int64)
        self.bytes: list[bytes] = []
        text_of: dict[str, int] = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                text_of[p] = i
                self.bytes.append(p.replace("▁", " ").encode())
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        if any("▁" in p.lstrip("▁") or ("\n" in p) for p in text_of):
            raise ValueError("pieces of this model lie across the edges of chunks")
        order = sorted(text_of.values(), key=lambda i: (-sp.get_score(i), i))
        rank = {i: k for k, i in enumerate(order)}
        single = sorted((ord(p), i) for p, i in text_of.items() if len(p) == 1)
        self.cp = np.array([c for c, _ in single], np.int64)
        self.cp_id = np.array([i for _, i in single], np.int64)
        pairs = {}
        for p, i in text_of.items():
            for k in range(1, len(p)):
                a, b = text_of.get(p[:k]), text_of.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        bits = max(4, (8 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        slots: list[int] = [-1] * (1 << bits)
        for key in sorted(pairs):
            at = (key * int(SPREAD) & MASK) >> 64 - bits
            while slots[at] >= 0:
                at = at + 1 & (1 << bits) - 1
            slots[at] = key
        self.slot_key = np.array(slots, np.int64)
        self.slot_piece = np.array([pairs.get(k, -1) for k in slots], np.int64)
        self.rank = np.full(n, NONE, np.int64)
        self.rank[list(rank)] = list(rank.values())
        self.piece = np.full(n, -1, np.int64)
        self.piece[list(rank.values())] = list(rank)
        self.pairs, self.ranks = pairs, self.rank.tolist()
        self.single = {chr(c): i for c, i in zip(self.cp.tolist(), self.cp_id.tolist(), strict=True)}
        self.trees = _Trees()

    def _ranks(self, left: np.ndarray, right: np.ndarray, salt: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Of each candidate merge its rank, or NONE where there is no such piece or the merge is skipped."""
        out = np.full(len(left), NONE, np.int64)
        ok = np.flatnonzero((left < self.vocab) & (right < self.vocab))
        key = left[ok] << 32 | right[ok]
        slot = (key.astype(np.uint64) * SPREAD >> self.shift).astype(np.int64)
        found = self.slot_key[slot]
        off = np.flatnonzero((found != key) & (found >= 0))
        while len(off):
            slot[off] = (slot[off] + 1) & (len(self.slot_key) - 1)
            found[off] = self.slot_key[slot[off]]
            off = off[(found[off] != key[off]) & (found[off] >= 0)]
        hit = np.flatnonzero(found == key)
        ok, piece = ok[hit], self.slot_piece[slot[hit]]
        if self.dropout > 0:
            u = mix64(salt[ok] ^ (start[ok].astype(np.uint64) << np.uint64(32)) ^ piece.astype(np.uint64))
            stay = u >= self.below
            ok, piece = ok[stay], piece[stay]
        out[ok] = self.rank[piece]
        return out

    def segment(self, chunks: list[str], salts: np.ndarray) -> list[bytes]:
        """Piece ids (little-endian unsigned 32-bit) of each chunk under its salt; a chunk that doesn't begin with a line end has one more space before it."""
        lengths = np.array([len(c) + (c[:1] != "\n") for c in chunks], np.int64)
        text = "".join(c if c[:1] == "\n" else " " + c for c in chunks)
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        cp = np.where(cp == 32, SPACE, np.where(cp == SPACE, 32, cp))  # 32 now stands for a literal U+2581, which has no piece
        at = np.minimum(np.searchsorted(self.cp, cp), len(self.cp) - 1)
        sym = np.where((self.cp[at] == cp) & (cp != 32), self.cp_id[at], self.vocab + cp)
        word = np.repeat(np.arange(len(chunks)), lengths)
        start = np.arange(len(sym)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        done_word, done_start, done_sym = [], [], []
        r = np.full(len(sym), NONE, np.int64)
        same = np.flatnonzero(word[1:] == word[:-1])
        r[same] = self._ranks(sym[same], sym[same + 1], salts[word[same]], start[same])
        while len(sym):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(r, heads)
            sizes = np.diff(np.append(heads, len(sym)))
            each = np.repeat(best, sizes)
            live = each < NONE
            if not live.all():
                over = ~live
                done_word.append(word[over])
                done_start.append(start[over])
                done_sym.append(sym[over])
                sym, word, start, r, each = sym[live], word[live], start[live], r[live], each[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(r == each)
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
            sym[hit] = self.piece[each[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))
            sym, word, start, r = sym[keep], word[keep], start[keep], r[keep]
            touched = np.zeros(len(sym), bool)
            touched[moved] = True
            touched[moved[moved > 0] - 1] = True
            redo = np.flatnonzero(touched)
            r[redo] = NONE
            redo = redo[redo < len(sym) - 1]
            redo = redo[word[redo] == word[redo + 1]]
            r[redo] = self._ranks(sym[redo], sym[redo + 1], salts[word[redo]], start[redo])
        word, start, sym = np.concatenate(done_word), np.concatenate(done_start), np.concatenate(done_sym)
        placed = np.full(int(lengths.sum()), -1, np.int64)
        placed[(np.cumsum(lengths) - lengths)[word] + start] = sym
        live = np.flatnonzero(placed >= 0)
        word, sym = np.repeat(np.arange(len(chunks)), lengths)[live], placed[live]
        raw = np.flatnonzero(sym >= self.vocab)
        if len(raw):
            parts = [chr(SPACE if c == 32 else c).encode("utf-8", "surrogatepass") for c in (sym[raw] - self.vocab).tolist()]
            reps = np.ones(len(sym), np.int64)
            reps[raw] = [len(p) for p in parts]
            spread = np.repeat(sym, reps)
            spread[np.repeat(sym >= self.vocab, reps)] = self.byte_id[np.frombuffer(b"".join(parts), np.uint8)]
            word, sym = np.repeat(word, reps), spread
        data = sym.astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(word, minlength=len(chunks))) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Piece ids of whole texts; ``keys`` are the documents' ids (or any numbers) that key the draws with the place of each chunk."""
        split = []
        for t in texts:
            s = " " + t
            split.append([] if not t else [c[1:] if c[0] == " " else c for c in CHUNK.findall(s)] if "  " in s else t.replace("\n", " \n").split(" "))
        out, a = [], 0
        while a < len(texts):
            z, size = a, 0
            while z < len(texts) and (z == a or size + len(texts[z]) <= AT_ONCE):
                size += len(texts[z])
                z += 1
            out += self._encode(split[a:z], keys[a:z])
            a = z
        return out

    def _encode(self, split: list[list[str]], keys: list[int]) -> list[bytes]:
        chunks = [c for part in split for c in part]
        salts = np.zeros(len(chunks), np.uint64)
        ends = np.cumsum([len(part) for part in split]).tolist()
        if self.dropout > 0:
            for part, k, z in zip(split, keys, ends, strict=True):
                salts[z - len(part) : z] = np.uint64(xxhash.xxh64_intdigest(int(k).to_bytes(16, "little", signed=True), self.seed & MASK)) + np.arange(len(part), dtype=np.uint64)
            salts = mix64(salts)
        trees = self.trees
        node = np.fromiter(map(trees.__getitem__, chunks), np.int64, len(chunks))
        trees.fit()
        alone, at = [], np.arange(len(chunks))
        while len(at):
            left = []
            while len(at):
                here = node[at]
                take = trees.take[here]
                left.append(at[take == OPEN])
                inner = take >= 0
                if not inner.all():
                    at, here, take = at[inner], here[inner], take[inner]
                if self.dropout > 0:
                    take = np.where(mix64(salts[at] ^ trees.draw[here]) < self.below, trees.skip[here], take)
                node[at] = take
            at = np.sort(np.concatenate(left))
            wanted, n = np.unique(node[at], return_counts=True)
            trees.left[wanted] += n
            lay = wanted[(trees.left[wanted] >= OFTEN) & (wanted > 0)]
            for k in lay.tolist():
                self._lay_out(k)
            trees.fit()
            known = trees.take[node[at]] != OPEN
            alone.append(at[~known])
            at = at[known]
        got = list(map(trees.state.__getitem__, node.tolist()))
        rest = np.concatenate(alone) if alone else at
        for a in range(0, len(rest), 100_000):
            part = rest[a : a + 100_000]
            for k, ids in zip(part.tolist(), self.segment([chunks[k] for k in part.tolist()], salts[part]), strict=True):
                got[k] = ids
        if len(trees.state) > self.limit:
            self.trees = _Trees()
        return [b"".join(got[z - len(part) : z]) for part, z in zip(split, ends, strict=True)]

    def _lay_out(self, node: int) -> None:
        """Adds the nodes from an open one down to the leaf where no more merges are skipped."""
        trees, none = self.trees, int(NONE)
        state = trees.state[node]
        if isinstance(state, str):
            chars = state if state[:1] == "\n" else " " + state
            sym = [self.single[x] if (x := "▁" if c == " " else " " if c == "▁" else c) in self.single and x != " " else self.vocab + ord(x) for c in chars]
            start, dead = list(range(len(sym))), frozenset()
        else:
            (sym, start, dead, steps), skipped = state
            sym, start = list(sym), list(start)
            for k, piece in steps[:skipped]:
                sym[k : k + 2] = [piece]
                del start[k + 1]
            k, piece = steps[skipped]
            dead = dead | {start[k] << 32 | piece}
        way = (tuple(sym), tuple(start), dead, [])

        def candidate(k: int) -> tuple[int, int]:
            p = self.pairs.get(sym[k] << 32 | sym[k + 1], -1)
            return (p, self.ranks[p]) if p >= 0 and start[k] << 32 | p not in dead else (-1, none)

        agenda = [candidate(k) for k in range(len(sym) - 1)]
        rank = [r for _, r in agenda]
        all_states = trees.state
        all_states[node] = None
        while rank:
            least = min(rank)
            if least >= none:
                break
            k = rank.index(least)
            piece = agenda[k][0]
            n = len(all_states)
            all_states += (None, (way, len(way[3])))
            trees.new.append((node, start[k] << 32 | piece, n, n + 1))
            way[3].append((k, piece))
            node = n
            sym[k : k + 2] = [piece]
            del start[k + 1], agenda[k], rank[k]
            for j in (k - 1, k):
                if 0 <= j < len(agenda):
                    agenda[j] = candidate(j)
                    rank[j] = agenda[j][1]
        ids = [i for v in sym for i in ([v] if v < self.vocab else self.byte_id[list(chr(SPACE if v - self.vocab == 32 else v - self.vocab).encode("utf-8", "surrogatepass"))].tolist())]
        trees.new.append((node, 0, LEAF, OPEN))
        all_states[node] = array("I", ids).tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of piece ids."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "surrogatepass")[1:]


@functools.cache
def coder_of(file: str, dropout: float, seed: int, nodes: int = 1_000_000) -> MergeDropout:
    """One coder for each worker process and setting."""
    return MergeDropout(file, dropout, seed, nodes)


def encode_pieces(df: DataFrame, model_file: str, dropout: float = 0.1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", nodes: int = 1_000_000) -> DataFrame:
    """(id, ids binary, n_pieces, ids_crc32, restored) of every row: the ids, and whether decoding them gives the text.

    Null and empty texts have no ids and are restored as empty; a null id keys the draws as 0; repeated rows are kept.
    A worker keeps about ``nodes`` tree nodes; fewer of them cost time and change no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        coder = coder_of(model_file, dropout, seed, nodes)
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                texts, ids = part.column(1).to_pylist(), part.column(0).to_pylist()
                got = coder.encode(texts, [i or 0 for i in ids])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary()), pa.array([len(g) // 4 for g in got], pa.int64()), pa.array([zlib.crc32(g) for g in got], pa.int64()), pa.array([coder.decode(g) == t for g, t in zip(got, texts, strict=True)])], ["id", "ids", "n_pieces", "ids_crc32", "restored"])

    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), run, "id long, ids binary, n_pieces long, ids_crc32 long, restored boolean")


def decode_pieces(df: DataFrame, model_file: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of piece ids (binary, little-endian unsigned 32-bit); null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        coder = coder_of(model_file, 0.0, 0)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids")), run, "id long, text string")


def _model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text of ``documents``; returns counts and checksums of the piece ids."""
    return encode_pieces(table(spark, sf_dir, "documents"), _model()).select(F.col("id").alias("doc_id"), "n_pieces", "ids_crc32", "restored")


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the piece ids of every document that is left; null texts have none, repeated rows are kept.

    Its workers have run the stages before, so they keep a quarter of the trees.
    """
    return encode_pieces(docs, _model(), nodes=250_000).select(F.col("id").alias("doc_id"), "n_pieces", "ids_crc32", "restored")
