"""Expressions over the elements of ElementTree, which expat builds without Python: the common case of a scan.

Child steps, attributes at their end, predicates and functions of strings, numbers and booleans give what ``xpath`` gives;
what needs other axes, prefixes, places or document order is refused (:class:`Outside`) and takes the evaluator's trees.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from xml.parsers import expat

from .doctree import Node, detect_encoding
from .xpath import XPath, to_boolean, to_number

#: Bytes of a large document that are parsed at once.
PIECE = 1 << 18
NUMBERS = frozenset({"count", "sum", "number", "round", "floor", "ceiling", "string-length"})
BOOLEANS = frozenset({"not", "boolean", "true", "false", "starts-with", "ends-with", "contains"})
STRINGS = frozenset({"string", "concat", "substring-before", "substring-after", "substring", "normalize-space", "translate", "lower-case", "replace"})


class Outside(ValueError):
    """An expression that needs the evaluator."""


class Text(Node):
    """A node's text, for the evaluator's functions."""

    __slots__ = ()

    def __init__(self, value: str) -> None:
        self.kind, self.value = "text", value


class Given(XPath):
    """The evaluator's functions and operators over arguments that are functions of an element."""

    def __init__(self) -> None:
        pass

    def _eval(self, t, n, pos, last):
        return t(n)


GIVEN = Given()


def simple(data: bytes) -> bool:
    return not (b"xmlns" in data or b"<!DOCTYPE" in data or b"\0" in data or detect_encoding(data) != "utf-8")


def parsed(data: bytes) -> ET.Element | None:
    """The root of a document without namespaces and document type; None where it is another or isn't well-formed."""
    if not simple(data):
        return None
    try:
        return ET.XML(data)
    except (ET.ParseError, ValueError, LookupError):
        return None


def records(data: bytes, name: str) -> Iterator[ET.Element]:
    """The elements of a name in a large well-formed document, in order; all that ended and isn't inside one is let go."""
    parser, above, inside = ET.XMLPullParser(("start", "end")), [], 0
    for at in range(0, len(data), PIECE):
        parser.feed(data[at : at + PIECE])
        for event, e in parser.read_events():
            if event == "start":
                above.append(e)
                inside += e.tag == name
                continue
            above.pop()
            inside -= e.tag == name
            if not inside:
                if e.tag == name:
                    yield from e.iter(name)
                if above:
                    above[-1].remove(e)
    parser.close()


def fault(data: bytes) -> str | None:
    """Why a document isn't well-formed; no tree is built."""
    try:
        expat.ParserCreate(namespace_separator="\x1f").Parse(data, True)
    except expat.ExpatError as e:
        return f"malformed XML: {e}"
    return None


def text_of(e: ET.Element) -> str:
    return "".join(e.itertext()) if len(e) else e.text or ""


class Compiled:
    """``kind``: elements, texts (of attributes), string, number or boolean; ``all``: an element's value; ``first``: the first text of nodes."""

    def __init__(self, kind: str, every: Callable, first: Callable | None = None) -> None:
        self.kind, self.all = kind, every
        self.nodes = kind in ("elements", "texts")
        self.first = first or (self._first_element if kind == "elements" else self._first_text)

    def _first_element(self, e: ET.Element) -> str | None:
        found = self.all(e)
        return text_of(found[0]) if found else None

    def _first_text(self, e: ET.Element) -> str | None:
        found = self.all(e)
        return found[0] if found else None

    def value(self) -> Callable:
        """As an argument of the evaluator's functions."""
        if self.kind == "elements":
            return lambda e: [Text(text_of(x)) for x in self.all(e)]
        return (lambda e: [Text(x) for x in self.all(e)]) if self.kind == "texts" else self.all


def compiled(t: tuple) -> Compiled:
    kind = t[0]
    if kind == "const":
        return Compiled("number" if isinstance(t[1], float) else "string", lambda e, v=t[1]: v)
    if kind == "group":
        return compiled(t[1])
    if kind == "neg":
        v = compiled(t[1]).value()
        return Compiled("number", lambda e: -to_number(v(e)))
    if kind == "binary" and t[1] in ("=", "!=") and t[3][0] == "const" and isinstance(t[3][1], str) and (left := compiled(t[2])).nodes:
        same, want = t[1] == "=", t[3][1]
        text = text_of if left.kind == "elements" else str
        return Compiled("boolean", lambda e: any((text(x) == want) == same for x in left.all(e)))
    if kind == "binary":
        own = ("binary", t[1], compiled(t[2]).value(), compiled(t[3]).value())
        return Compiled("number" if t[1] in ("+", "-", "*", "div", "mod") else "boolean", lambda e: GIVEN._binary(own, e, 1, 1))
    if kind == "steps" and t[1] == ("context",):
        return _steps(t[2])
    if kind == "call":
        return _call(t[1], t[2])
    raise Outside(kind)


def _call(name: str, args: list) -> Compiled:
    if name not in NUMBERS | BOOLEANS | STRINGS or (not args and name not in ("true", "false")):
        raise Outside(name)
    own = [compiled(a) for a in args]
    if name in ("count", "sum") and not own[0].nodes:
        raise Outside(name)
    if name == "count":
        return Compiled("number", lambda e: float(len(own[0].all(e))))
    values = [c.value() for c in own]
    return Compiled("number" if name in NUMBERS else "boolean" if name in BOOLEANS else "string", lambda e: GIVEN._call(name, values, e, 1, 1))


def _test(preds: list) -> list[tuple[bool, Callable]]:
    out = [compiled(p) for p in preds]
    return [(c.kind == "number", c.value()) for c in out]


def _kept(found: list, tests: list[tuple[bool, Callable]]) -> list:
    for place, test in tests:
        found = [x for k, x in enumerate(found, 1) if (test(x) == k if place else to_boolean(test(x)))]
    return found


def _named(step: tuple) -> str:
    axis, test, _ = step
    if axis not in ("child", "attribute") or test[0] != "name" or test[1] or test[3] is not None:
        raise Outside(axis)
    return test[2]


def _steps(steps: list) -> Compiled:
    steps = [s for s in steps if s[:2] != ("self", ("node",)) or s[2]]
    if not steps:
        return Compiled("elements", lambda e: [e])
    names, tests = [_named(s) for s in steps], [_test(s[2]) for s in steps]
    if any(s[0] == "attribute" for s in steps[:-1]):
        raise Outside("a step after an attribute")
    last = steps[-1]
    if last[0] == "attribute":
        if last[2]:
            raise Outside("a predicate of an attribute")
        name = names.pop()
        if not names:
            return Compiled("texts", lambda e: [e.attrib[name]] if name in e.attrib else [], lambda e: e.get(name))
        above = _walk(names, tests)
        return Compiled("texts", lambda e: [x.attrib[name] for x in above(e) if name in x.attrib])
    if len(names) == 1 and not tests[0]:
        name = names[0]

        def first(e: ET.Element) -> str | None:
            x = e.find(name)
            return None if x is None else text_of(x)

        return Compiled("elements", lambda e: e.findall(name), first)
    return Compiled("elements", _walk(names, tests))


def _walk(names: list[str], tests: list) -> Callable:
    def run(e: ET.Element) -> list[ET.Element]:
        now = [e]
        for name, own in zip(names, tests, strict=False):
            now = [y for x in now for y in (_kept(x.findall(name), own) if own else x.findall(name))]
        return now

    return run


def selector(t: tuple) -> Callable:
    """``//Name``, ``/Name/Child`` or ``Name`` from the document, with predicates that aren't places after ``//``: the elements below a root."""
    if t[0] != "steps" or t[1] not in (("root",), ("context",)) or not t[2]:
        raise Outside("not a path from the document")
    steps = t[2]
    if steps[0][:2] == ("descendant-or-self", ("node",)) and not steps[0][2] and len(steps) == 2:
        name, tests = _named(steps[1]), _test(steps[1][2])
        if steps[1][0] != "child" or any(place for place, _ in tests):
            raise Outside("a place among siblings")
        return lambda root: _kept(list(root.iter(name)), tests)
    names, tests = [_named(s) for s in steps], [_test(s[2]) for s in steps]
    if any(s[0] != "child" for s in steps):
        raise Outside("an attribute")
    below = _walk(names[1:], tests[1:])
    return lambda root: [y for x in _kept([root] if root.tag == names[0] else [], tests[0]) for y in below(x)]
