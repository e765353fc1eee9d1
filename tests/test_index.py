"""Indexes by pieces against sequential parsers; verification, safety checks and coalesced reads."""

import hashlib
import io
import json
import random
from collections.abc import Iterator
from itertools import chain
from xml.parsers import expat

import pytest

from lodestone.operators import index as IX
from lodestone.sources import doctree
from lodestone.sources import pieces as P
from lodestone.sources.doctree import DocumentError


def xml_ranges(src, name: str) -> Iterator[tuple[int, int, int, dict[str, str]]]:
    """(start, end, depth, namespaces in scope) of the outermost elements of a local name, by a parser that goes through the file in order."""
    p = expat.ParserCreate()
    out: list[tuple[int, int, int, dict[str, str]]] = []
    depth, inside, start, scope = 0, 0, 0, [{}]
    ended = False

    def begin(tag: str, attrs: dict[str, str]) -> None:
        nonlocal depth, inside, start
        depth += 1
        own = {k[6:]: v for k, v in attrs.items() if k.startswith("xmlns:")} | ({"": attrs["xmlns"]} if "xmlns" in attrs else {})
        scope.append({**scope[-1], **own} if own else scope[-1])
        if not inside and tag.rsplit(":", 1)[-1] == name:
            inside, start = depth, p.CurrentByteIndex

    def finish(tag: str) -> None:
        nonlocal depth, inside, ended
        if inside == depth:
            out.append((start, -1, depth, scope[-2]))
            inside, ended = 0, True
        scope.pop()
        depth -= 1

    def after(*_: object) -> None:
        nonlocal ended
        if ended:
            s, _e, d, n = out[-1]
            out[-1] = (s, p.CurrentByteIndex, d, n)
            ended = False

    def wrapped(f):
        def g(*a):
            after()
            f(*a)

        return g

    p.StartElementHandler, p.EndElementHandler = wrapped(begin), wrapped(finish)
    p.CharacterDataHandler = p.CommentHandler = p.ProcessingInstructionHandler = after
    try:
        while piece := src.read(1 << 16):
            p.Parse(piece, False)
            done = [r for r in out if r[1] >= 0]
            yield from done
            out[:] = [r for r in out if r[1] < 0]
        p.Parse(b"", True)
    except expat.ExpatError as e:
        raise DocumentError(f"malformed XML: {e}") from None
    after()
    yield from out



def sample(doctype=False):
    r = random.Random(1)
    doc = '<?xml version="1.0"?>' + ('<!DOCTYPE R [<!ENTITY a "<x>">]>' if doctype else "") + '<!-- <Order> --><R xmlns:k="u:k" xmlns="u:d">'
    for k in range(60):
        x = f'<k:Order id="{k}" a=">">' + ("<Order><b/></Order>" if k % 3 == 0 else "") + f"<t>é &amp; --> ?></t><![CDATA[<Order> ]]><!-- </Order> {'x' * r.randrange(60)}--><?p <Order?></k:Order>"
        doc += x if k % 2 else f'<S xmlns:z="u:{k}"><z:Order/>text<Order q=\'"\'/></S>'
        doc += "\n" if k % 5 else ""
    return (doc + "</R>").encode()


def by_pieces(doc, name, length):
    made = []
    for at in range(0, max(1, len(doc)), length):
        begin, data, _ = P.xml_piece(io.BytesIO(doc), at, length, len(doc))
        made.append(P.transitions_of(data, begin, name) if data else {})
    entries, long, problem = P.compose([{s: t for s, (t, _) in m.items()} for m in made])
    out = [(s, e, d, ns) for _, s, e, d, ns in long]
    for entry, m in zip(entries, made, strict=False):
        for f in m[entry.state][1] if entry.state in m else ():
            if f.after >= entry.records:
                left = len(entry.scopes) - f.pops
                scope = {k: v for ns in entry.scopes[:left] for k, v in (ns or {}).items()}
                out.append((f.start, f.end, left + f.depth, {**scope, **f.namespaces}))
    return sorted(out, key=lambda x: x[:2]), problem


@pytest.mark.parametrize("doctype", [True, False])
def test_xml_records_whatever_the_pieces(doctype):
    doc = sample(doctype)
    want = list(xml_ranges(io.BytesIO(doc), "Order"))
    assert len(want) == 90
    for length in (300, 10**6) if doctype else (1, 7, 20, 64, 333, 10**6):
        assert by_pieces(doc, b"Order", length) == (want, None)


@pytest.mark.parametrize("bad", [b"", b"<a>", b"<a></b>", b"<a><Order></a></Order>", b"<a/><b/>", b"<a><!-- x</a>", b"<a><Order><b></Order></a>", b"<a></a></a>", b"text", b"<a><![CDATA[</a>", b"<a b=<c/></a>"])
def test_malformed_files_are_told_whatever_the_pieces(bad):
    for length in (1, 4, 1000):
        assert by_pieces(bad, b"Order", length)[1]


def test_lines_whatever_the_pieces():
    raw = b'\xef\xbb\xbf{"a":1}\n\n  \n{"b":2}\r\n{"c":"x"}'
    want = list(P.lines_of(raw, 0))
    assert [raw[s:e] for s, e in want] == [b'{"a":1}', b'{"b":2}', b'{"c":"x"}']
    for length in range(1, 30):
        got = []
        for at in range(0, len(raw), length):
            begin, data, _ = P.line_piece(io.BytesIO(raw), at, length, len(raw))
            got += P.lines_of(data, begin)
        assert got == want


def test_json_records_whatever_the_reads():
    r = random.Random(1)

    def some(d):
        c = r.randrange(6)
        if d > 4 or c == 0:
            return r.choice([1, -2.5e3, 'x"é', "", None, True, False])
        if c < 3:
            return [some(d + 1) for _ in range(r.randrange(4))]
        return {r.choice(["Order", "b", "ü"]) + (str(k) if k else ""): some(d + 1) for k in range(r.randrange(4))}

    for k in range(150):
        v = some(0)
        raw = json.dumps(v if isinstance(v, (dict, list)) else [v], indent=r.choice([None, 1]), ensure_ascii=k % 2 == 0).encode()
        for name in ("Order", "item"):
            want = sorted((n.start, n.stop) for n in doctree.parse_json(raw).walk() if n.kind == "element" and n.name == name)
            for step in (1, 3, 50, 10**6):
                got = list(P.json_records(io.BytesIO(raw), name, step))
                assert [x[:2] for x in got] == want and all(raw[s:e] == body for s, e, body in got)
    for bad in (b'{"a":1,}', b"[1 2]", b'{"a":1}x', b'{"a"', b'"x"', b'{"a":tru}', b'{"a":1,"a":2}', b"[01]", b"", b'{"a":"\xff"}'):
        for step in (1, 100):
            with pytest.raises(DocumentError):
                list(P.json_records(io.BytesIO(bad), "a", step))


def test_json_is_forgotten_as_it_is_read():
    class Source:
        """A file of many records that is made as it is read."""

        def __init__(self):
            self.parts = chain([b'{"Order":['], (b'{"id":%d,"x":"%s"},' % (k, b"y" * 1000) for k in range(3000)), [b'{"id":-1}]}'])

        def read(self, n):
            return next(self.parts, b"")

    import tracemalloc

    tracemalloc.start()
    assert sum(1 for _ in P.json_records(Source(), "Order")) == 3001
    assert tracemalloc.get_traced_memory()[1] < 300_000
    tracemalloc.stop()


def listed(spark, folder):
    return spark.read.format("binaryFile").load(str(folder)).selectExpr("path source_file", "length size_bytes")


def test_index_equals_a_sequential_one(spark, tmp_path):
    doc = sample()
    (tmp_path / "a.xml").write_bytes(doc)
    (tmp_path / "b.xml").write_bytes(b"<R><Order>1</Order></R>")
    (tmp_path / "c.xml").write_bytes(b"<R><Order>1</Order>")
    (tmp_path / "d.xml").write_bytes(b"<R><Order>1<b></Order></R>")
    (tmp_path / "e.xml").write_bytes(b"<R/>")
    want = list(xml_ranges(io.BytesIO(doc), "Order"))
    for piece in (100, 1 << 20):
        ix = IX.build_index(listed(spark, tmp_path), "Order", piece=piece)
        got = ix.records.where("source_file like '%a.xml'").orderBy("record_num").collect()
        assert [(r.start_offset, r.end_offset, r.depth) for r in got] == [w[:3] for w in want] and [r.record_num for r in got] == list(range(1, 91))
        assert [r.sha256 for r in got] == [hashlib.sha256(doc[s:e]).hexdigest() for s, e, _, _ in want]
        assert [r.namespaces for r in got] == ["\n".join(f"{p}={u}" for p, u in sorted(ns.items())) for *_, ns in want]
        about = {r.source_file[-5:]: (r.records, r.problem is None) for r in ix.files.collect()}
        assert about == {"a.xml": (90, True), "b.xml": (1, True), "c.xml": (0, False), "d.xml": (0, False), "e.xml": (0, True)}
        assert {r.source_file[-5] for r in ix.records.collect()} == {"a", "b"}
        assert IX.verify(ix.records).count() == 0
        digest = next(r.file_digest for r in got)
        parts = [doc[k : k + piece] for k in range(0, len(doc), piece)]
        assert digest == (hashlib.sha256(doc).hexdigest() if len(parts) == 1 else hashlib.sha256(b"".join(hashlib.sha256(x).digest() for x in parts)).hexdigest())
        content = {r.record_num: r.content for r in IX.read_ranges(ix.records.where("source_file like '%a.xml'"), 2).collect()}
        assert [content[k + 1] for k in range(90)] == [doc[s:e] for s, e, _, _ in want]


def test_lines_and_json_are_indexed_and_changes_found(spark, tmp_path):
    (tmp_path / "a.ndjson").write_bytes(b"".join(b'{"id":%d}\n' % k for k in range(500)))
    ix = IX.build_index(listed(spark, tmp_path), "row", "ndjson", piece=64)
    rows = ix.records.orderBy("record_num").collect()
    assert [r.record_num for r in rows] == list(range(1, 501)) and rows[-1].end_offset == (tmp_path / "a.ndjson").stat().st_size - 1
    j = tmp_path / "j"
    j.mkdir()
    raw = json.dumps({"R": {"Order": [{"id": k} for k in range(9)]}}).encode()
    (j / "a.json").write_bytes(raw)
    (j / "b.json").write_bytes(raw[:-1])
    ix = IX.build_index(listed(spark, j), "Order", "json", piece=16)
    assert ix.records.count() == 9 and {r.source_file[-6:]: r.problem is None for r in ix.files.collect()} == {"a.json": True, "b.json": False}
    (j / "b.json").unlink()
    IX.check_before_run(ix.records, listed(spark, j))
    (j / "a.json").write_bytes(raw.replace(b'"id": 8', b'"id": 7'))
    assert {r.problem for r in IX.verify(ix.records).collect()} == {"the file's digest differs"}
    (j / "a.json").write_bytes(raw.replace(b'"id": 0', b'"id": 7'))
    with pytest.raises(IX.StaleIndex, match="first record"):
        IX.check_before_run(ix.records, listed(spark, j))
    (j / "a.json").write_bytes(raw + b" ")
    (j / "c.json").write_bytes(raw)
    with pytest.raises(IX.StaleIndex, match="size differs.*not in the index|not in the index.*size differs"):
        IX.check_before_run(ix.records, listed(spark, j))
    with pytest.raises(DocumentError, match="compressed"):
        IX.build_index(spark.createDataFrame([("x.gz", 1)], "source_file string, size_bytes long"), "Order")
    assert IX.build_index(listed(spark, j).where("false"), "Order").records.count() == 0


def test_neighbouring_ranges_are_read_at_once():
    rows = [("a", 0, 10), ("a", 10, 20), ("a", 30, 40), ("a", 40 + IX.GAP + 1, 40 + IX.GAP + 9), ("b", 0, IX.READ + 5), ("b", IX.READ + 5, IX.READ + 6), ("b", IX.READ, IX.READ + 9)]
    assert list(IX.reads(rows)) == [(0, 3), (3, 4), (4, 5), (5, 6), (6, 7)] and list(IX.reads([])) == []
