"""Token-id files: independent zstandard frames, a trailing seek table and a checksum for every frame.

File layout (little-endian), readable by any zstandard decoder:

* data frames: the ids of all documents, 4 bytes each, cut every ``FRAME_BYTES``; each frame is decompressed by itself;
* a skippable frame ``DOCS_MAGIC``: compressed directory of the documents (ids, null marks, first byte, byte count);
* a skippable frame ``SEEK_MAGIC``: per data frame compressed size, raw size and checksum, then the footer
  (number of frames, descriptor, ``FOOTER_MAGIC``), as the public seekable format has it.

A reader takes the footer, then the two tables, and decompresses only the frames that hold the wanted documents.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, file_system, fresh_path, id_ranges, partitions

FRAME_BYTES = 1 << 20
# Fixed values of the public seekable zstandard format.
SEEK_MAGIC, FOOTER_MAGIC, DOCS_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A5D
END_ID = 0
#: Between two characters that aren't white space, a single space always begins a new pre-token of the byte-level pattern,
#: and a single line end is one: a chunk is a space (left out) or a line end (kept) and what follows up to the next one.
BREAK = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
#: Texts with runs of white space, or white space at an end, are cut by ``BREAK`` itself; others at every space and line end.
RUNS = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]{2}|\A[\s\p{Z}\x0b\x1c-\x1f\x{85}]|[\s\p{Z}\x0b\x1c-\x1f\x{85}]\z"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The byte-level alphabet by its rule: printable bytes stand for themselves, the others for the code points from 256 on.
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
SPACE = chr(BYTE_CHARS[32])
#: Bytes of texts that are encoded at once.
AT_ONCE = 8 << 20


class ChunkEncoder:
    """Encodes whole texts with a ``tokenizers`` file; equal space-separated chunks are encoded once.

    A byte-level tokenizer never merges over a pre-token's edge, so the ids of a text are those of its chunks in a row.
    Texts that hold one of the tokenizer's added tokens go through the library as they are. Chunks are kept for as long as
    they were met among the last ``limit`` ones: memory is bounded, results don't depend on it.
    """

    def __init__(self, file: str, limit: int = 450_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = "|".join(re.escape(t) for t in added)
        self.limit = limit
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.model = self.tokenizer.model

    def _plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[mark] = self._plain(mark) if mark else b""
        return self.marks[mark]

    def _learn(self, need: list[str]) -> None:
        """Letters and a run of punctuation after them are two pre-tokens; chunks of another kind, or with letters beyond
        the common alphabets, go through the whole tokenizer."""
        rest, cache, tokenize = [], self.cache, self.model.tokenize
        for c in need:
            base = c.rstrip(PUNCTUATION)
            letters = base[1:] if c[:1] == "\n" else base
            ascii_only = letters.isascii()
            if not letters.isalpha() or not (ascii_only or max(letters) < "\u0500"):
                rest.append(c)
                continue
            # letters are one pre-token, with the space before them or not: the library's BPE model takes their byte form
            form = letters if ascii_only else letters.encode().decode("latin-1").translate(BYTE_CHARS)
            got = cache.get(base) if letters is base else self._mark("\n")
            if letters is not base or got is None:
                got = (b"" if letters is base else got) + array("I", [t.id for t in tokenize(SPACE + form if letters is base else form)]).tobytes()
            cache[c] = got if len(base) == len(c) else got + self._mark(c[len(base) :])
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            got = self.tokenizer.encode_batch([c if c[:1] == "\n" else " " + c for c in part], add_special_tokens=False)
            cache.update((c, array("I", e.ids).tobytes()) for c, e in zip(part, got, strict=True))

    def _table(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        if len(self.cache) > self.limit:
            self.cache, self.older = {}, self.cache
        found = list(map(self.cache.get, chunks))
        missed = [k for k, v in enumerate(found) if v is None]
        if missed:
            names = [chunks[k] for k in missed]
            kept = list(map(self.older.get, names))
            self.cache.update((c, v) for c, v in zip(names, kept, strict=True) if v is not None)
            self._learn([c for c, v in zip(names, kept, strict=True) if v is None])
            for k, c in zip(missed, names, strict=True):
                found[k] = self.cache[c]
        return found

    def _head(self, chunk: str) -> bytes:
        if chunk not in self.heads:
            if len(self.heads) > 100_000:
                self.heads.clear()
            self.heads[chunk] = self._plain(chunk)
        return self.heads[chunk]

    def ids(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        size, out, a = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), [], 0
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + AT_ONCE, "right")))
            out += self._part(texts[a:z])
            a = z
        return out

    def _part(self, texts: pa.Array) -> list[bytes]:
        runs = pc.match_substring_regex(texts, RUNS).to_numpy(zero_copy_only=False)
        whole = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)
        out: list[bytes] = [b""] * len(texts)
        for k in np.flatnonzero(whole).tolist():
            out[k] = self._plain(texts[k].as_py())
        for k in np.flatnonzero(runs & ~whole).tolist():
            chunks = BREAK.split(texts[k].as_py())
            distinct = list(dict.fromkeys(chunks[1:]))
            at = dict(zip(distinct, self._table(distinct), strict=True))
            out[k] = self._head(chunks[0]) + b"".join(map(at.__getitem__, chunks[1:]))
        plain = np.flatnonzero(~runs & ~whole)
        if not len(plain):
            return out
        split = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), " ")
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy().copy()
        first = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        names = code[first]
        distinct, code[first] = np.unique(names, return_inverse=True)
        heads = [self._head(chunks[k]) for k in distinct.tolist()]
        inner = np.ones(len(code), bool)
        inner[first] = False
        used = np.zeros(len(chunks), bool)
        used[code[inner]] = True
        live = np.flatnonzero(used)
        place = np.zeros(len(chunks), np.int64)
        place[live] = len(heads) + np.arange(len(live))
        code = np.where(inner, place[np.where(inner, code, 0)], code)
        table = heads + self._table([chunks[k] for k in live.tolist()])
        ids = np.frombuffer(b"".join(table), "<u4")
        length = np.fromiter(map(len, table), np.int64, len(table)) // 4
        begin = np.cumsum(length) - length
        each = length[code]
        end = np.cumsum(each)
        flat = ids[np.repeat(begin[code] - (end - each), each) + np.arange(int(end[-1]))].tobytes()
        cut = (4 * np.append(end, 0)[np.append(first[1:], len(code)) - 1]).tolist()
        for k, a, z in zip(plain.tolist(), [0, *cut[:-1]], cut, strict=True):
            out[k] = flat[a:z]
        return out


@functools.cache
def encoder(file: str) -> ChunkEncoder:
    """One encoder for each worker process."""
    return ChunkEncoder(file)


class ShardWriter:
    """Writes one token file to a binary stream."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 1) -> None:
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.buffer, self.frames = bytearray(), []
        self.docs: list[tuple[int | None, int, int]] = []
        self.raw = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, self.raw, len(ids)))
        self.raw += len(ids)
        self.buffer += ids
        while len(self.buffer) >= self.frame_bytes:
            self._frame(bytes(self.buffer[: self.frame_bytes]))
            del self.buffer[: self.frame_bytes]

    def _frame(self, raw: bytes) -> None:
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.buffer:
            self._frame(bytes(self.buffer))
        n = len(self.docs)
        null = np.array([d is None for d, _, _ in self.docs], np.uint8)
        cols = [np.array([d or 0 for d, _, _ in self.docs], "<i8"), null, np.array([a for _, a, _ in self.docs], "<u8"), np.array([b for _, _, b in self.docs], "<u8")]
        raw = b"".join(c.tobytes() for c in cols)
        body = struct.pack("<QQQ", n, len(raw), xxhash.xxh64_intdigest(raw)) + self.zstd.compress(raw)
        self.out.write(struct.pack("<II", DOCS_MAGIC, len(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.docs_bytes = 8 + len(body)


class ShardReader:
    """Random access to one token file; raises ``ValueError`` on a bad checksum or a damaged table."""

    def __init__(self, src, size: int) -> None:
        self.src = src
        src.seek(size - 9)
        n, descriptor, magic = struct.unpack("<IBI", src.read(9))
        if magic != FOOTER_MAGIC or not descriptor & 0x80:
            raise ValueError("no seek table at the end of the file")
        start = size - 9 - 12 * n - 8
        src.seek(start)
        head = struct.unpack("<II", src.read(8))
        if head != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("the seek table's frame is damaged")
        t = np.frombuffer(src.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(t[:, 0])])
        self.raw_at = np.concatenate([[0], np.cumsum(t[:, 1])])
        self.sums = t[:, 2]
        src.seek(int(self.at[-1]))
        magic, length = struct.unpack("<II", src.read(8))
        body = src.read(length)
        if magic != DOCS_MAGIC or len(body) != length:
            raise ValueError("the directory of documents is damaged")
        m, raw_len, want = struct.unpack("<QQQ", body[:24])
        raw = zstandard.ZstdDecompressor().decompress(body[24:], max_output_size=max(1, raw_len)) if raw_len else b""
        if xxhash.xxh64_intdigest(raw) != want:
            raise ValueError("the directory's checksum doesn't match")
        self.doc_ids = np.frombuffer(raw, "<i8", m)
        self.null = np.frombuffer(raw, np.uint8, m, 8 * m).astype(bool)
        self.first = np.frombuffer(raw, "<u8", m, 9 * m).astype(np.int64)
        self.length = np.frombuffer(raw, "<u8", m, 17 * m).astype(np.int64)
        self.zstd = zstandard.ZstdDecompressor()
        self.held: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def _frame(self, k: int) -> bytes:
        if self.held[0] != k:
            self.src.seek(int(self.at[k]))
            raw = self.zstd.decompress(self.src.read(int(self.at[k + 1] - self.at[k])), max_output_size=int(self.raw_at[k + 1] - self.raw_at[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k}: the checksum doesn't match")
            self.held, self.frames_read = (k, raw), self.frames_read + 1
        return self.held[1]

    def read(self, i: int) -> bytes:
        """The ids of the i-th document of the file, from the frames that hold them only."""
        a, n = int(self.first[i]), int(self.length[i])
        k, out = int(np.searchsorted(self.raw_at, a, "right")) - 1, []
        while n:
            frame = self._frame(k)
            off = a - int(self.raw_at[k])
            out.append(frame[off : off + n])
            a, n, k = a + len(out[-1]), n - len(out[-1]), k + 1
        return b"".join(out)

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.doc_ids)):
            yield (None if self.null[i] else int(self.doc_ids[i])), self.read(i)


def write_tokens(documents: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes every document's ids to files below ``path`` (a URI that all machines reach), ascending by id.

    Returns the manifest, one row per file: path, size, first and last id, n_docs, n_tokens, shard. Null texts count as
    empty, null ids come first; rows of an id are ordered by a hash of their text, then the text, and all kept, so that an
    id of many rows is spread over several files; no rows give no files. A task that is run again writes a file of another
    name; the manifest names those of finished tasks only.
    """
    spark = documents.sparkSession
    n = shards or partitions(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    docs = docs.withColumn("h", F.xxhash64("t"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = sink = None
        tokens, last, name = 0, None, ""
        coder = encoder(tokenizer_file)
        end = array("I", [END_ID]).tobytes()
        try:
            for b in batches:
                if writer is None:
                    name = f"{path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids.zst"
                    store, at = file_system(name)
                    store.create_dir(os.path.dirname(at), recursive=True)
                    sink = store.open_output_stream(at, compression=None)
                    writer, first = ShardWriter(sink, frame_bytes), b.column(0)[0].as_py()
                ids = b.column(0).to_pylist()
                for a in range(0, len(ids), 1024):
                    for i, raw in zip(ids[a : a + 1024], coder.ids(b.column(1)[a : a + 1024]), strict=True):
                        writer.add(i, raw + end)
                        tokens += len(raw) // 4 + 1
                last = ids[-1]
        except BaseException:
            if sink is not None:
                sink.close()
                store.delete_file(at)
            raise
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [name], "size": [store.get_file_info(at).size], "first_id": pa.array([first], pa.int64()), "last_id": pa.array([last], pa.int64()), "n_docs": [len(writer.docs)], "n_tokens": [tokens]})

    ranges = id_ranges(docs.select("i"), n)
    rows = docs.repartitionById(n, ranges("i", "h")).sortWithinPartitions(F.col("i").asc_nulls_first(), "h", "t").select("i", "t")
    arrow_map(rows, write, "shard long, path string, size long, first_id long, last_id long, n_docs long, n_tokens long").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_tokens(manifest: DataFrame, ids_wanted: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Reads the files of a manifest: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids (binary).

    With ``ids_wanted`` only the frames of those documents are decompressed. The driver sees one row per file.
    """
    spark = manifest.sparkSession
    files = manifest.orderBy("shard").collect()
    starts = [0, *accumulate(f["n_tokens"] for f in files)]
    rows = [(f["path"], f["size"], s) for f, s in zip(files, starts, strict=False)]
    wanted = None if ids_wanted is None else np.array(sorted(ids_wanted), np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for name, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, at = file_system(name)
                with store.open_input_file(at) as src:
                    r = ShardReader(src, size)
                    pick = range(len(r.doc_ids)) if wanted is None else np.flatnonzero(np.isin(r.doc_ids, wanted) & ~r.null).tolist()
                    held, held_bytes = [], 0
                    for i in pick:
                        raw = r.read(i)
                        held.append((None if r.null[i] else int(r.doc_ids[i]), start + int(r.first[i]) // 4, len(raw) // 4, zlib.crc32(raw), *([raw] if with_ids else [])))
                        held_bytes += len(raw) if with_ids else 64
                        if held_bytes > 8 << 20:
                            yield _rows(held)
                            held, held_bytes = [], 0
                    if held:
                        yield _rows(held)

    names = spark.createDataFrame(rows, "path string, size long, start long").repartition(max(1, min(len(rows), 10_000)))
    return arrow_map(names, read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: len(held[0])]
    return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate(kinds)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)])


def op6_token_output(spark, sf_dir: str) -> DataFrame:
    """Writes the whole ``documents`` table as token files, reads the files back and returns the digest of each document."""
    import public_tokenizers

    from .common import table

    manifest = write_tokens(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(manifest, with_ids=False)
