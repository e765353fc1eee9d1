"""Records of one file found in pieces: each piece tells what it does to the parser's state, whatever state it is entered in.

A piece of an XML file begins and ends before a ``<``, so no delimiter straddles an edge; it may be entered in text, or
inside a comment, CDATA section or processing instruction. For each state that it can leave, a piece gives a
transition: the elements that it closes and those that it leaves open, with namespaces declared on them. Transitions are
composed in the order of the pieces; then each piece knows where it was entered, and which of the record elements that it
found are outermost ones. Records that lie in several pieces come out of the composition itself.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

from .doctree import MAX_DEPTH, DocumentError
from .values import DECODER

#: States a piece can be entered in, and what ends them.
ENDS = {"comment": b"-->", "cdata": b"]]>", "instruction": b"?>"}
_TAG = re.compile(
    rb"""<(?:(?P<tag>/?)(?P<name>[^\s/>"'<!?=][^\s/>"'<=]*)(?P<attrs>(?:[^>"'<]|"[^"<]*"|'[^'<]*')*)>"""
    rb"""|!--(?s:.*?)(?P<comment>-->|\Z)|!\[CDATA\[(?s:.*?)(?P<cdata>\]\]>|\Z)|\?(?s:.*?)(?P<instruction>\?>|\Z)"""
    rb"""|!DOCTYPE(?P<doctype>(?:[^\[>"']|"[^"]*"|'[^']*')*(?:\[(?:<!--(?s:.*?)-->|"[^"]*"|'[^']*'|[^\]"'])*\]\s*)?>)|)"""
)
_DECLARED = re.compile(rb"""\sxmlns(?::([^\s=]+))?\s*=\s*(?:"([^"]*)"|'([^']*)')""")


@dataclass
class Transition:
    """What a piece does from one state on: ``closes`` names elements opened before it, ``opens`` (name, namespaces, record, offset) stay open.

    ``ends`` are (place in ``closes``, offset after the end tag); ``leaves`` is the state at its end, ``error`` the first fault.
    """

    leaves: str = "text"
    closes: list[bytes] = field(default_factory=list)
    opens: list[tuple[bytes, dict[str, str] | None, bool, int]] = field(default_factory=list)
    ends: list[tuple[int, int]] = field(default_factory=list)
    error: str | None = None
    #: Elements that lie whole in the piece and in no other of its own, by how many closes came before.
    tops: dict[int, int] = field(default_factory=dict)


@dataclass
class Found:
    """A record element that lies whole in a piece: it counts if at least as many records were closed before it in the piece (``after``) as were open at its start."""

    start: int
    end: int
    after: int
    pops: int
    depth: int
    namespaces: dict[str, str]


def declared(attrs: bytes) -> dict[str, str] | None:
    if b"xmlns" not in attrs:
        return None
    return {(m[1] or b"").decode(): (m[2] if m[2] is not None else m[3]).decode() for m in _DECLARED.finditer(attrs)} or None


@functools.lru_cache(maxsize=64)
def _inside(name: bytes) -> re.Pattern[bytes]:
    """Inside a record only tags of its own name matter, and what may hide them."""
    return re.compile(
        rb"""<(?:(?P<tag>/?)(?:[^\s/>"'<!?=:]+:)?""" + re.escape(name) + rb"""(?=[\s/>])(?P<attrs>(?:[^>"'<]|"[^"<]*"|'[^'<]*')*)>"""
        rb"""|!--(?s:.*?)(?:-->|\Z)|!\[CDATA\[(?s:.*?)(?:\]\]>|\Z)|\?(?s:.*?)(?:\?>|\Z))"""
    )


def _record_end(data: bytes, at: int, name: bytes) -> int:
    """Where the record whose start tag ends at ``at`` ends; -1 where it goes on after the data."""
    depth = 1
    for m in _inside(name).finditer(data, at):
        if m["tag"] is None or m["attrs"].endswith(b"/"):
            continue
        depth += -1 if m["tag"] else 1
        if not depth:
            return m.end()
    return -1


def _fault(record: bytes) -> str | None:
    """What is wrong with a record's own bytes; entities may be declared elsewhere."""
    p = expat.ParserCreate()
    p.UseForeignDTD(True)
    try:
        p.Parse(record, True)
    except expat.ExpatError as e:
        return str(e)
    return None


def lex_xml(data: bytes, at: int, base: int, name: bytes) -> tuple[Transition, list[Found]]:
    """The transition of ``data`` from ``at`` on, in text, and the record elements (of a local name) that lie whole in it."""
    t, found = Transition(), []
    opens, closes, suffix = t.opens, t.closes, b":" + name
    records = inner = 0  # record ends so far of elements opened before; open record elements of the piece
    scope: dict[str, str] | None = {}  # namespaces declared on the piece's open elements; None: to be gathered
    find, size = _TAG.search, len(data)
    while at < size and (m := find(data, at)):
        at, tag = m.end(), m["name"]
        if tag is None:
            kind = m.lastgroup
            if kind == "doctype":
                continue
            if kind not in ENDS:
                t.error = f"malformed XML at byte {base + m.start()}"
                break
            if not m[kind]:
                t.leaves = kind
                break
        elif m["tag"]:
            if opens:
                own, ns, record, _ = opens.pop()
                if own != tag:
                    t.error = f"malformed XML: </{tag.decode(errors='replace')}> at byte {base + m.start()} closes <{own.decode(errors='replace')}>"
                    break
                inner -= record
                scope = None if ns else scope
                if not opens:
                    t.tops[len(closes)] = t.tops.get(len(closes), 0) + 1
            else:
                if tag == name or tag.endswith(suffix):
                    t.ends.append((len(closes), base + at))
                    records += 1
                closes.append(tag)
        else:
            attrs, record, start = m["attrs"], tag == name or tag.endswith(suffix), m.start()
            end = at if attrs.endswith(b"/") else -1
            if record and not inner:
                end = end if end >= 0 else _record_end(data, at, name)
                if end >= 0:
                    if scope is None:
                        scope = {k: v for _, ns, _, _ in opens for k, v in (ns or {}).items()}
                    found.append(Found(base + start, base + end, records, len(closes), len(opens) + 1, scope))
                    at = end
            if end >= 0 and not opens:
                t.tops[len(closes)] = t.tops.get(len(closes), 0) + 1
            if end < 0:
                inner += record
                ns = declared(attrs) if attrs else None
                scope = None if ns else scope
                opens.append((tag, ns, record, base + start))
                if len(opens) > MAX_DEPTH:
                    t.error = f"XML is nested deeper than {MAX_DEPTH}"
                    break
    # the records are parsed together; one by one only where that fails
    if found and _fault(b"<r>" + b"".join(data[f.start - base : f.end - base] for f in found) + b"</r>"):
        for k, f in enumerate(found):
            fault = _fault(data[f.start - base : f.end - base])
            if fault:
                t.error = f"malformed XML in the record at byte {f.start}: {fault}"
                del found[k:]
                break
    return t, found


def transitions_of(data: bytes, base: int, name: bytes) -> dict[str, tuple[Transition, list[Found]]]:
    """For each state that a piece can leave or changes: its transition and records. States that aren't there stay as they are."""
    out = {"text": lex_xml(data, 0, base, name)}
    for state, end in ENDS.items():
        k = data.find(end)
        if k >= 0:
            out[state] = lex_xml(data, k + len(end), base, name)
    return out


@dataclass
class Entry:
    """How a piece is entered: the state, the open elements' namespaces, outermost first, and how many records are open."""

    state: str
    scopes: list[dict[str, str] | None]
    records: int


def compose(pieces: Iterable[dict[str, Transition]]) -> tuple[list[Entry], list[tuple[int, int, int, int, dict[str, str]]], str | None]:
    """Each piece's entry; the records in several pieces as (piece of the start, start, end, depth, namespaces); what is wrong with the file."""
    state, stack, entries, long = "text", [], [], []
    begun: tuple[int, int, int, dict[str, str]] | None = None
    roots = 0
    for k, by in enumerate(pieces):
        records = sum(r for _, _, r in stack)
        entries.append(Entry(state, [ns for _, ns, _ in stack], records))
        t = by.get(state)
        if t is None:
            continue
        ends = dict(t.ends)
        roots += t.tops.get(len(stack), 0)
        for j, tag in enumerate(t.closes):
            own = stack.pop() if stack else None
            if own is None or own[0] != tag:
                return entries, long, f"malformed XML: </{tag.decode(errors='replace')}> closes {'<' + own[0].decode(errors='replace') + '>' if own else 'nothing'}"
            if own[2]:
                records -= 1
                if not records and begun:
                    long.append((*begun[:2], ends[j], *begun[2:]))
                    begun = None
            roots += not stack
        if t.error:
            return entries, long, t.error
        for tag, ns, record, start in t.opens:
            if record and not records:
                scope: dict[str, str] = {}
                for _, other, _ in stack:
                    scope |= other or {}
                begun = (k, start, len(stack) + 1, scope)
            records += record
            stack.append((tag, ns, record))
        state = t.leaves
    return entries, long, f"malformed XML: it ends inside {'<' + stack[-1][0].decode(errors='replace') + '>' if stack else 'a ' + state}" if stack or state != "text" else None if roots == 1 else f"malformed XML: {roots} root elements"


def xml_piece(src, at: int, length: int, size: int) -> tuple[int, bytes, bytes]:
    """The piece that begins at or after ``at``: (first byte, bytes, digest of ``length`` bytes from ``at`` on), up to the first ``<`` from ``at + length`` on."""
    src.seek(at)
    data = src.read(min(length, size - at))
    digest = hashlib.sha256(data).digest()
    begin = data.find(b"<") if at else 0
    if begin < 0:
        return at, b"", digest
    end = at + len(data)
    parts = [data[begin:]]
    while end < size:
        more = src.read(min(1 << 16, size - end))
        k = more.find(b"<")
        parts.append(more if k < 0 else more[:k])
        end += len(more)
        if k >= 0:
            break
    return at + begin, b"".join(parts), digest


def line_piece(src, at: int, length: int, size: int) -> tuple[int, bytes, bytes]:
    """The whole lines that begin from ``at`` on and before ``at + length``: (first byte, bytes, digest of ``length`` bytes from ``at`` on)."""
    src.seek(max(0, at - 1))
    data = src.read(min(length + (at > 0), size - max(0, at - 1)))
    digest = hashlib.sha256(data[1:] if at else data).digest()
    begin = data.find(b"\n") + 1 if at else 0
    if at and not begin:
        return at, b"", digest
    end, parts = max(0, at - 1) + len(data), [data[begin:]]
    begin += max(0, at - 1)
    if begin >= end:  # a line begins at this piece's last byte: the next piece has it
        return begin, b"", digest
    while end < size and not parts[-1].endswith(b"\n"):
        more = src.read(min(1 << 16, size - end))
        k = more.find(b"\n")
        parts.append(more if k < 0 else more[: k + 1])
        end += len(more)
        if k >= 0:
            break
    return begin, b"".join(parts), digest


def lines_of(data: bytes, base: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines that aren't blank, without their line ends."""
    at = 3 if base == 0 and data.startswith(codecs.BOM_UTF8) else 0
    while at < len(data):
        k = data.find(b"\n", at)
        k = len(data) if k < 0 else k
        body = data[at:k].removesuffix(b"\r")
        if body.strip(b" \t\r"):
            yield base + at, base + at + len(body)
        at = k + 1


_JSON = re.compile(rb"""[ \t\n\r]*(?:(?P<mark>[{}\[\]:,])|(?P<text>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<other>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))""")


def _whole(text: str, start: int, quoted: str, above: int) -> int:
    """Where the object at ``start`` ends, of bytes as code points; -1 where its tokens must tell: it may hold records, have a fault or go on."""
    try:
        _, end = DECODER.scan_once(text, start)
    except (StopIteration, ValueError, RecursionError):
        return -1
    # keys may be written with escapes, and then be the name or equal others
    plain = text.find(quoted, start, end) < 0 and text.find("\\u", start, end) < 0
    return end if plain and above + text.count("{", start, end) + text.count("[", start, end) <= MAX_DEPTH else -1


def json_records(src, name: str, piece: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of the values of a name in a JSON file, in the order of their starts.

    The file is read in pieces and forgotten as far as no record is open: memory holds a piece, the largest record and the
    keys of the objects that are open. Items of an array have the name of the array; the tree of ``parse_json`` has the same.
    Objects that are records and hold none are found by the scanner of the standard library, others token by token.
    """
    buffer, base, pos, over = b"", 0, 0, False
    text, quoted = None, f'"{name}"'.encode().decode("latin-1")
    stack: list[list] = []  # of open containers: kind, name, keys seen, start where it is a record
    waiting: list[tuple[int, int, bytes]] = []
    open_records, expect, key, first_open = 0, "value", "", -1
    digest = codecs.getincrementaldecoder("utf-8")()

    def bad(what: str) -> DocumentError:
        return DocumentError(f"malformed JSON at byte {base + pos}: {what}")

    while True:
        m = None if pos >= len(buffer) and not over else _JSON.match(buffer, pos)
        if not over and (m is None or len(buffer) - m.end() < 3):  # a number may go on by a sign or point and a digit
            more = src.read(piece)
            try:
                digest.decode(more, not more)
            except UnicodeDecodeError:
                raise DocumentError("invalid UTF-8") from None
            keep = min(pos, first_open - base) if open_records else pos
            buffer, base, pos, text = buffer[keep:] + more, base + keep, pos - keep, None
            if base == 0 and pos == 0 and buffer.startswith(codecs.BOM_UTF8):
                pos = 3
            over = not more
            continue
        if m is None:
            if buffer[pos:].strip(b" \t\n\r"):
                raise bad("no token")
            break
        start, end = m.end() - len(m[m.lastgroup]), m.end()
        token, kind = m[m.lastgroup], m.lastgroup
        pos = start
        done: list | None = None
        if expect in ("key", "key or end"):
            if kind == "text":
                key = _key(token)
                if key in stack[-1][2]:
                    raise bad(f"duplicate key {key[:64]!r}")
                stack[-1][2].add(key)
                expect = ":"
            elif token == b"}" and expect == "key or end":
                done = stack.pop()
            else:
                raise bad("expected a key")
        elif expect == ":":
            if token != b":":
                raise bad("expected :")
            expect = "value"
        elif expect == "next":
            if not stack:
                raise bad("data after the top-level value")
            if token == b",":
                expect = "key" if stack[-1][0] == "{" else "value"
            elif token == (b"}" if stack[-1][0] == "{" else b"]"):
                done = stack.pop()
            else:
                raise bad("expected , or the end")
        elif token == b"]" and expect == "value or end":
            done = stack.pop()
        elif token in (b"{", b"["):
            own = "" if not stack else key if stack[-1][0] == "{" else stack[-1][1]
            if token == b"[" and not stack:
                own = "item"
            # an array isn't a value of its own unless it lies in an array
            named = bool(stack) and own == name and (token == b"{" or stack[-1][0] == "[")
            if named and token == b"{" and not open_records:
                text = buffer.decode("latin-1") if text is None else text
                stop = _whole(text, start, quoted, len(stack))
                if stop >= 0:
                    yield base + start, base + stop, buffer[start:stop]
                    pos, expect = stop, "next"
                    continue
            if named:
                if not open_records:
                    first_open = base + start
                open_records += 1
            stack.append([token.decode(), own, set() if token == b"{" else None, base + start if named else -1])
            if len(stack) > MAX_DEPTH:
                raise DocumentError(f"JSON is nested deeper than {MAX_DEPTH}")
            expect = "key or end" if token == b"{" else "value or end"
        elif kind == "mark" or not stack:
            raise bad("no value")
        else:
            own = key if stack[-1][0] == "{" else stack[-1][1]
            if own == name:
                waiting.append((base + start, base + end, token))
            expect = "next"
        pos = end
        if done is not None:
            expect = "next"
            if done[3] >= 0:
                waiting.append((done[3], base + end, buffer[done[3] - base : end]))
                open_records -= 1
        if waiting and not open_records:
            yield from sorted(waiting)
            waiting = []
    if stack or expect != "next":
        raise DocumentError("malformed JSON: the input ends inside a value")


def _key(token: bytes) -> str:
    from .doctree import _unescaped

    return _unescaped(token[1:-1])


class Digests:
    """A source of bytes that is read once: digests of its pieces of ``length`` bytes beside what it gives."""

    def __init__(self, src, length: int) -> None:
        self.src, self.length, self.done, self.now, self.left = src, length, [], hashlib.sha256(), length

    def read(self, n: int) -> bytes:
        data = self.src.read(n)
        view = memoryview(data)
        while len(view) >= self.left:
            self.now.update(view[: self.left])
            self.done.append(self.now.digest())
            view, self.now, self.left = view[self.left :], hashlib.sha256(), self.length
        self.now.update(view)
        self.left -= len(view)
        return data

    def all(self) -> list[bytes]:
        return [*self.done, self.now.digest()] if self.left < self.length or not self.done else self.done


def digest_of(pieces: list[bytes]) -> str:
    """A file's digest from those of its pieces: that of a single one, else the digest of all of them in a row."""
    return pieces[0].hex() if len(pieces) == 1 else hashlib.sha256(b"".join(pieces)).hexdigest()
