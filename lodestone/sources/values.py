"""Plain paths over the values that the standard library's JSON scanner builds in C: the common case of a scan.

Numbers keep their text, an array is its items beside each other. What the strict trees of ``doctree`` see otherwise (lone
surrogates, deep nesting, arrays in arrays, a top-level array) and all faults are refused (:class:`Outside`) and take those trees.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

#: Nesting up to which values are walked.
DEPTH = 64
_NAME = re.compile(r"[^\W\d][\w.\-]*\Z")
_SURROGATE = re.compile(rb"\\u[dD][89a-fA-F]")
_NONE = object()


class Outside(ValueError):
    """What needs the evaluator's trees."""


def _members(pairs: list[tuple[str, Any]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise Outside("a key is there twice")
    return out


def _constant(name: str) -> Any:
    raise Outside(name)


DECODER = json.JSONDecoder(object_pairs_hook=_members, parse_float=str, parse_int=str, parse_constant=_constant)


def _deeper(v: Any, left: int) -> bool:
    if not isinstance(v, (dict, list)):
        return False
    return not left or any(_deeper(x, left - 1) for x in (v.values() if isinstance(v, dict) else v))


def parsed(data: bytes) -> dict:
    """A top-level object; numbers are their text."""
    if b"\\u" in data and _SURROGATE.search(data):
        raise Outside("surrogates")
    try:
        v = DECODER.decode(data.decode())
    except (ValueError, RecursionError) as e:
        raise Outside(str(e)) from None
    if type(v) is not dict or (data.count(b"{") + data.count(b"[") > DEPTH and _deeper(v, DEPTH)):
        raise Outside("not a shallow object")
    return v


def parsed_lines(data: bytes) -> list[dict]:
    """The objects of the lines that aren't blank."""
    return [parsed(body) for line in data.split(b"\n") if (body := line.removesuffix(b"\r")).strip(b" \t\r")]


def below(v: Any, name: str) -> list:
    """The elements of a name below an element."""
    x = v.get(name, _NONE) if type(v) is dict else _NONE
    if x is _NONE:
        return []
    if type(x) is not list:
        return [x]
    if any(type(y) is list for y in x):
        raise Outside("an array in an array")
    return x


def text(v: Any) -> str:
    if type(v) is str:
        return v
    if v is None:
        return ""
    if type(v) is bool:
        return "true" if v else "false"
    return "".join(map(text, v.values() if type(v) is dict else v))


def path(xpath: str) -> Callable[[Any], list]:
    """The elements of a path of child names from an element on."""
    names = xpath.split("/")
    if not all(map(_NAME.match, names)):
        raise Outside(xpath)
    if len(names) == 1:
        return lambda v: below(v, xpath)

    def run(v: Any) -> list:
        now = [v]
        for name in names:
            now = [y for x in now for y in below(x, name)]
        return now

    return run


def selector(xpath: str) -> Callable[[dict], Any]:
    """``//Name``, ``/Name/Child`` or ``Name`` from the document: the elements in their order."""
    if not xpath.startswith("//"):
        return path(xpath.removeprefix("/"))
    name = xpath[2:]
    if not _NAME.match(name):
        raise Outside(xpath)
    return lambda v: _named(v, name)


def _named(v: Any, name: str) -> Iterator[Any]:
    if type(v) is not dict:
        return
    for key in v:
        for x in below(v, key):
            if key == name:
                yield x
            yield from _named(x, name)
