"""Ordered read-only document trees of XML, JSON and line-delimited JSON.

A JSON tree has elements and text only: members are elements, array items are repeated siblings (items of a top-level
array are called ``item``, nested arrays keep their name), scalars keep their source text, null has no text.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from xml.parsers import expat

MAX_DEPTH = 1024


class DocumentError(ValueError):
    """Input that isn't a well-formed document."""


class Node:
    """A tree node; ``kind``: document, element, attribute or text. ``pos`` is its place in document order."""

    __slots__ = ("attrs", "children", "kind", "name", "ns", "parent", "pos", "prefix", "scalar", "start", "stop", "value")

    def __init__(self, kind: str, name: str = "", parent: Node | None = None, pos: int = 0, value: str = "", ns: str = "", prefix: str = "") -> None:
        self.kind, self.name, self.parent, self.pos, self.value, self.ns, self.prefix = kind, name, parent, pos, value, ns, prefix
        self.children: list[Node] = []
        self.attrs: list[Node] = []
        self.scalar: str | None = None
        self.start = self.stop = -1

    def text(self) -> str:
        """The string-value: all text below, in document order."""
        if self.kind in ("text", "attribute"):
            return self.value
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if n.kind == "text":
                out.append(n.value)
            else:
                todo.extend(reversed(n.children))
        return "".join(out)

    def elements(self) -> Iterator[Node]:
        return (c for c in self.children if c.kind == "element")

    def root(self) -> Node:
        n = self
        while n.parent is not None:
            n = n.parent
        return n

    def walk(self) -> Iterator[Node]:
        """This node and all below, in document order, without attributes."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.children))


def detect_encoding(data: bytes) -> str:
    """The encoding of the head of a document: byte order mark, zero bytes, or XML declaration; else UTF-8."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return name
    if data[:4] == b"<\0?\0":
        return "utf-16-le"
    if data[:4] == b"\0<\0?":
        return "utf-16-be"
    m = re.match(rb"<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)", data[:1024])
    return m[1].decode().lower() if m else "utf-8"


def parse_xml(data: bytes) -> Node:
    """The tree of an XML document; raises DocumentError with line and column."""
    doc = Node("document")
    at, pos, buffer = doc, 0, []
    p = expat.ParserCreate(namespace_separator="\x1f")
    p.namespace_prefixes = True
    p.ordered_attributes = True

    def named(raw: str) -> tuple[str, str, str]:
        parts = raw.split("\x1f")
        return (parts[1], parts[0], parts[2] if len(parts) > 2 else "") if len(parts) > 1 else (raw, "", "")

    def flush() -> None:
        nonlocal pos
        if buffer:
            pos += 1
            at.children.append(Node("text", parent=at, pos=pos, value="".join(buffer)))
            buffer.clear()

    def start(raw: str, attrs: list[str]) -> None:
        nonlocal at, pos
        flush()
        name, ns, prefix = named(raw)
        pos += 1
        e = Node("element", name, at, pos, ns=ns, prefix=prefix)
        e.start = p.CurrentByteIndex
        for k in range(0, len(attrs), 2):
            n, u, x = named(attrs[k])
            pos += 1
            e.attrs.append(Node("attribute", n, e, pos, attrs[k + 1], u, x))
        at.children.append(e)
        at = e

    def end(_: str) -> None:
        nonlocal at
        flush()
        at.stop = p.CurrentByteIndex
        at = at.parent

    p.StartElementHandler, p.EndElementHandler = start, end
    p.CharacterDataHandler = lambda s: buffer.append(s) if at is not doc else None
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise DocumentError(f"malformed XML: {e}") from None
    return doc


_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_STRING = re.compile(rb'"((?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*)"')
_SPACE = re.compile(rb"[ \t\n\r]*")
_ESCAPE = re.compile(r'\\(u[0-9a-fA-F]{4}|["\\/bfnrt])')
_PLAIN = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\", "/": "/"}


def _unescaped(raw: bytes) -> str:
    text = raw.decode()
    if "\\" not in text:
        return text
    text = _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" else _PLAIN[m[1]], text)
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def parse_json(data: bytes, offset: int = 0, only_object: bool = False) -> Node:
    """The tree of a JSON document; strict: duplicate keys, deep nesting, data after the value and scalars are errors."""
    if data[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) or data[:4] == codecs.BOM_UTF32_BE or (len(data) > 1 and 0 in data[:2]):
        raise DocumentError("JSON input must be UTF-8")
    at = 3 if data.startswith(codecs.BOM_UTF8) else 0
    try:
        data.decode()
    except UnicodeDecodeError as e:
        raise DocumentError(f"invalid UTF-8 at byte {offset + e.start}") from None
    doc, count = Node("document"), 0

    def space(k: int) -> int:
        return _SPACE.match(data, k).end()

    def fail(k: int, what: str) -> DocumentError:
        return DocumentError(f"malformed JSON at byte {offset + k}: {what}" if k < len(data) else "malformed JSON: the input ends inside a value")

    def value(parent: Node, name: str, k: int, depth: int) -> int:
        nonlocal count
        k = space(k)
        c = data[k : k + 1]
        if c == b"[":
            # the items are elements of the array's name beside each other; an inner array is an element that holds its own
            return array(parent, name, k, depth)
        count += 1
        e = Node("element", name, parent, count)
        e.start = k
        parent.children.append(e)
        if c == b"{":
            k = members(e, k, depth)
        else:
            k = scalar(e, k)
        e.stop = k
        return k

    def scalar(e: Node, k: int) -> int:
        nonlocal count
        for word, kind in ((b"true", "bool"), (b"false", "bool"), (b"null", "null")):
            if data.startswith(word, k):
                e.scalar = kind
                if kind == "bool":
                    count += 1
                    e.children.append(Node("text", parent=e, pos=count, value=word.decode()))
                return k + len(word)
        m = _STRING.match(data, k)
        if m:
            e.scalar, text = "string", _unescaped(m[1])
        else:
            m = _NUMBER.match(data, k)
            if not m:
                raise fail(k, "no value")
            e.scalar, text = "number", m[0].decode()
        count += 1
        if text:
            e.children.append(Node("text", parent=e, pos=count, value=text))
        return m.end()

    def array(parent: Node, name: str, k: int, depth: int) -> int:
        nonlocal count
        if depth > MAX_DEPTH:
            raise DocumentError(f"JSON is nested deeper than {MAX_DEPTH}")
        k = space(k + 1)
        if data[k : k + 1] == b"]":
            return k + 1
        while True:
            k = space(k)
            if data[k : k + 1] == b"[":
                count += 1
                inner = Node("element", name, parent, count)
                inner.start = k
                parent.children.append(inner)
                k = array(inner, name, k, depth + 1)
                inner.stop = k
            else:
                k = value(parent, name, k, depth + 1)
            k = space(k)
            c = data[k : k + 1]
            if c == b"]":
                return k + 1
            if c != b",":
                raise fail(k, "expected , or ]")
            k += 1

    def members(parent: Node, k: int, depth: int) -> int:
        if depth > MAX_DEPTH:
            raise DocumentError(f"JSON is nested deeper than {MAX_DEPTH}")
        seen: set[str] = set()
        k = space(k + 1)
        if data[k : k + 1] == b"}":
            return k + 1
        while True:
            k = space(k)
            m = _STRING.match(data, k)
            if not m:
                raise fail(k, "expected a key")
            key = _unescaped(m[1])
            if key in seen:
                raise DocumentError(f"duplicate key {key[:64]!r} at byte {offset + k}")
            seen.add(key)
            k = space(m.end())
            if data[k : k + 1] != b":":
                raise fail(k, "expected :")
            k = space(value(parent, key, k + 1, depth + 1))
            c = data[k : k + 1]
            if c == b"}":
                return k + 1
            if c != b",":
                raise fail(k, "expected , or }")
            k += 1

    at = space(at)
    c = data[at : at + 1]
    try:
        if c == b"{":
            at = members(doc, at, 1)
        elif c == b"[" and not only_object:
            at = array(doc, "item", at, 1)
        else:
            raise fail(at, "the top-level value must be an object" + " or an array" * (not only_object))
    except RecursionError:
        raise DocumentError(f"JSON is nested deeper than {MAX_DEPTH}") from None
    at = space(at)
    if at != len(data):
        raise fail(at, "data after the top-level value")
    return doc


def parse_ndjson(data: bytes) -> list[tuple[Node, int, int]]:
    """(tree, first byte, end byte) of each line that isn't blank; the first bad line is an error."""
    out, at = [], 3 if data.startswith(codecs.BOM_UTF8) else 0
    for number, line in enumerate(data[at:].split(b"\n"), 1):
        body = line.removesuffix(b"\r")
        if body.strip(b" \t\r"):
            try:
                out.append((parse_json(body, at, only_object=True), at, at + len(body)))
            except DocumentError as e:
                raise DocumentError(f"line {number}: {e}") from None
        at += len(line) + 1
    return out


def node_of_record(n: Node) -> Node:
    """A document that holds one record only, with nothing outside it."""
    doc = Node("document")
    clone = Node("element", n.name, doc, n.pos, ns=n.ns, prefix=n.prefix)
    clone.children, clone.attrs, clone.scalar, clone.start, clone.stop = n.children, n.attrs, n.scalar, n.start, n.stop
    for c in (*clone.children, *clone.attrs):
        c.parent = clone
    doc.children.append(clone)
    return doc
