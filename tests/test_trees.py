"""Document trees and XPath."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestone.sources.doctree import DocumentError, detect_encoding, parse_json, parse_ndjson, parse_xml
from lodestone.sources.xpath import XPathError, compile_xpath, to_text

XML = parse_xml(b'<r xmlns:p="urn:p"><a n="1">x<b>1</b>y</a><p:a n="2"> 2 </p:a><a n="3"/><c>-4.5</c><c> 5 </c></r>')


@pytest.mark.parametrize(
    ("xpath", "want"),
    [
        ("string(/r/a)", "x1y"), ("count(//a)", "2"), ("count(//p:a)", "1"), ("count(//@n)", "3"), ("/r/a[2]/@n", "3"), ("/r/a[@n='3']/preceding-sibling::a/@n", "1"), ("//b/ancestor::*[2]/*[last()]", " 5 "), ("sum(//c)", "-4.5"),
        ("name(/r/*[2])", "p:a"), ("local-name(/r/*[2])", "a"), ("namespace-uri(/r/*[2])", "urn:p"), ("boolean(//nope)", "false"), ("not(//nope)", "true"), ("number('x')", "NaN"), ("number(' 3.0 ')", "3"), ("7 mod 4 - -1", "4"), ("6 div 4", "1.5"),
        ("1 = 1 and 2 < 1 or true()", "true"), ("//c > 4", "true"), ("//c = '-4.5'", "true"), ("//c != '-4.5'", "true"), ("concat('a', 1, true())", "a1true"), ("substring('12345', 2, 3)", "234"), ("string-length('é')", "2"), ("normalize-space('  a   b ')", "a b"),
        ("translate('bar','abc','AB')", "BAr"), ("matches(//nope, '^$')", ""), ("matches(string(//nope), '^$')", "true"), ("replace('a1b2', '([a-z])([0-9])', '$2$1')", "1a2b"), ("replace('x', 'x', '$$')", "$"), ("replace('x', '(?P<k>x)', '${k}${0}')", "xx"),
        ("round(2.5)", "3"), ("round(-2.5)", "-2"), ("floor(-1.5)", "-2"), ("ceiling(1.2)", "2"), ("(//c | //a)[1]/@n", "1"), ("//a[position()=2]/@n", "3"), ("count(//b/following::*)", "4"), ("count(//c[1]/preceding::*)", "4"), ("string(//a/text())", "x"), ("/r/a/..//b", "1"), ("count(/)", "1"), ("self::node()", "x1y 2 -4.5 5 "),
        ("substring-before('a.b.c', '.')", "a"), ("substring-after('a.b.c', '.')", "b.c"), ("substring-after('abc', 'x')", ""), ("lower-case('ÀB')", "àb"), ("ends-with('abc', 'bc')", "true"), ("contains('abc', '')", "true"), ("5 * 2", "10"), ("//*[@n]/@n", "1"),
    ],
)
def test_xpath(xpath, want):
    assert to_text(compile_xpath(xpath).evaluate(XML)) == want


@pytest.mark.parametrize("bad", ["", "a[", "tokenize(a, 'b')", "upper-case(a)", "matches(a, b)", "matches(a, 'x', 'i')", "replace(a, '(x)', '$2')", "replace(a, 'x', '$name')", "replace(a, 'x', 'a$')", "replace(a, '(x)', '$01')", "replace(a, 'x', '$0b')", "replace(a, 'x', '\\$')", "replace(a, '(x)', '$$1')", "matches(a, '(?=x)')", "matches(a, '(x)\\1')", "a b", "foo::a", "count(1, 2)"])
def test_xpath_is_refused(bad):
    with pytest.raises(XPathError):
        compile_xpath(bad)


def test_prefixes_are_bound_by_uri():
    assert len(compile_xpath("//q:a", {"q": "urn:p"}).nodes(XML)) == 1
    with pytest.raises(XPathError):
        compile_xpath("//z:a", {"q": "urn:p"})


@pytest.mark.parametrize(
    ("text", "error"),
    [(b'{"a":1,"a":2}', "duplicate key 'a' at byte 7"), (b"[1,]", "byte 3"), (b'{"a":1} x', "byte 8"), (b"5", "top-level"), (b'{"a":"\xff"}', "byte 6"), (b'{"a":[1', "ends inside"), (b'{"a":01}', "byte 6"), (b'{"a":"\x01"}', "byte 5"), (b"\xff\xfe{", "UTF-8"), (b'{"a":' * 1100 + b"1" + b"}" * 1100, "1024"), (b'{"a":NaN}', "byte 5"), (b"", "ends inside")],
)
def test_json_is_strict(text, error):
    with pytest.raises(DocumentError, match=error):
        parse_json(text)


def test_json_trees():
    d = parse_json(b'\xef\xbb\xbf{"m":[[1,2],[3]],"e":[],"n":null,"s":"\\u00e9\\ud83d\\ude00\\n","x":{"k":9007199254740993}}')
    m = compile_xpath("m").nodes(d)
    assert [[to_text([c]) for c in compile_xpath("m").nodes(n)] for n in m] == [["1", "2"], ["3"]]
    assert to_text(compile_xpath("s").evaluate(d)) == "é😀\n" and to_text(compile_xpath("x/k").evaluate(d)) == "9007199254740993"
    assert compile_xpath("e").nodes(d) == [] and compile_xpath("n").nodes(d)[0].scalar == "null"
    assert [to_text([n]) for n in compile_xpath("/item").nodes(parse_json(b"[1, {}]"))] == ["1", ""]
    assert [(s, e) for _, s, e in parse_ndjson(b'{"a":1}\r\n\n{"b":2}')] == [(0, 7), (10, 17)]
    with pytest.raises(DocumentError, match="line 2"):
        parse_ndjson(b'{"a":1}\n[1]\n')


def test_encodings():
    for name, data in (("utf-8-sig", "﻿<a>é</a>".encode()), ("utf-16-le", "﻿<a>é</a>".encode("utf-16-le")), ("windows-1252", '<?xml version="1.0" encoding="windows-1252"?><a>é</a>'.encode("cp1252"))):
        assert detect_encoding(data) == name and parse_xml(data).text() == "é"


@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cs", "Cc"]), max_size=5), max_size=4))
def test_json_strings_round_trip(values):
    import json

    got = compile_xpath("v").nodes(parse_json(json.dumps({"v": values}).encode()))
    assert [n.text() for n in got] == values
