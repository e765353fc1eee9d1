"""The expression language: parsing order, values, errors, and random expressions against a direct interpreter."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions.expressions import ExpressionError, Node, Scope, Typed, compile_expression, parse, reference_tables
from lodestone.functions.transforms import REGISTRY, apply_transform, describe


def shape(n: Node):
    return n.value if n.kind in ("var", "const") else (n.value or n.kind, *map(shape, n.args))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a*b/c", ("*", "a", ("/", "b", "c"))), ("a+b-c", ("+", "a", ("-", "b", "c"))), ("a-b+c-d", ("+", ("-", "a", "b"), ("-", "c", "d"))), ("a - b - c", ("-", ("-", "a", "b"), "c")),
        ("x ? 1 : y ? 2 : 3", ("ternary", "x", 1, ("ternary", "y", 2, 3))), ("a * -5", ("-", "a *", 5)), ("1e-5", ("-", "1e", 5)), ("-5", -5), ("(a + b) * c", ("*", ("+", "a", "b"), "c")),
        ("a || b && c", ("||", "a", ("&&", "b", "c"))), ("a && b || c && d", ("||", ("&&", "a", "b"), ("&&", "c", "d"))), ('f == "a ? b: -" ', ("==", "f", "a ? b: -")), ("!(a)", ("!", "a")),
        ("min(a, max(b, 1))", ("min", "a", ("max", "b", 1))), ("abs(x)-abs(y)", ("-", ("abs", "x"), ("abs", "y"))), ("f(\"a,b\", ')')", ("f", "a,b", ")")), ("count()", ("count",)), ("a.b", "a.b"),
    ],
)
def test_parse(text, want):
    assert shape(parse(text)) == want


@pytest.mark.parametrize("bad", ["", "  ", "a ? b", '"open', "x ? : 1"])
def test_parse_errors(bad):
    with pytest.raises(ExpressionError):
        parse(bad)


def value(spark, text, **variables):
    kinds = {bool: "boolean", int: "integer", float: "number", str: "string", list: "strings"}
    scope = Scope({k: Typed(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)), kinds[type(v)], literal=v if isinstance(v, list) else None) for k, v in variables.items()})
    t = compile_expression(text, scope)
    r = spark.range(1).select(t.value.alias("v"), (F.lit(None).cast("string") if t.error is None else t.error).alias("e")).first()
    return r.e if r.e is not None else r.v


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 + 2", 3.0), ("7 / 2", 3.5), ("1 / 0", "division by zero"), ("nil", "undefined variable: nil"), ("'a' == 1", False), ("'a' != 1", True), ("'a' < 'b'", "< needs numbers"), ("s + 1", "+: not a number"),
        ("round(1.005, 2)", 1.0), ("round(-2.5)", -3.0), ("round(2.5)", 3.0), ("mask_tail(s, 2)", "XXXlo"), ("mask_tail(s, 9)", "hello"), ("mask_tail(s, -1)", "mask_tail() needs a whole number of at least 0"),
        ("mask_middle(s, 1, 1, '*')", "h***o"), ("mask_middle(s, 3, 3)", "hello"), ("string_length('é€')", 2), ("normalize_space(' a  b ')", "a b"), ("starts_with_any(s, l)", True), ("value_in(s, l)", False),
        ("true ? 1 : 1 / 0", 1.0), ("false && (1 / 0 > 1)", "division by zero"), ("!b", False), ("max(1, 2.5, i)", 4.0), ("null == null", True), ("s == null", False), ("UPPER(s)", "HELLO"),
    ],
)
def test_values(spark, text, want):
    assert value(spark, text, s="hello", i=4, b=True, l=["he", "x"]) == want


def test_unknown_names_are_refused():
    for bad in ("nope(1)", "abs(1, 2)", "in_reference(t, x)", "mask_tail(s, 1, 'ab')"):
        with pytest.raises(ExpressionError):
            compile_expression(bad, Scope({"t": Typed(F.lit("t"), "string"), "x": Typed(F.lit("x"), "string"), "s": Typed(F.lit("s"), "string")}))
    assert reference_tables(parse("a && in_reference('t', lookup_reference('u', k, 'd'))")) == {"t", "u"}


NUMBERS = st.sampled_from(["a", "b", "2", "0.5", "7"])
EXPRESSIONS = st.recursive(NUMBERS, lambda inner: st.one_of(st.tuples(inner, st.sampled_from("+-*"), inner).map(lambda p: f"({p[0]} {p[1]} {p[2]})"), inner.map(lambda x: f"abs({x})"), st.tuples(inner, inner, inner).map(lambda p: f"({p[0]} > {p[1]} ? {p[1]} : {p[2]})")), max_leaves=8)


def interpret(n, scope):
    if n.kind in ("const", "var"):
        return float(scope[n.value]) if n.kind == "var" else float(n.value)
    v = [interpret(a, scope) for a in n.args]
    return {"+": lambda: v[0] + v[1], "-": lambda: v[0] - v[1], "*": lambda: v[0] * v[1], ">": lambda: v[0] > v[1], "abs": lambda: abs(v[0])}[n.value]() if n.kind != "ternary" else v[1] if v[0] else v[2]


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=EXPRESSIONS, a=st.integers(-9, 9), b=st.floats(-3, 3))
def test_random_expressions(spark, text, a, b):
    got, want = float(value(spark, text, a=a, b=b)), interpret(parse(text), {"a": a, "b": b})
    assert got == want or math.isclose(got, want, rel_tol=1e-12)


def test_transforms(spark):
    def run(text, name, **p):
        return spark.range(1).select(apply_transform(F.lit(text).cast("string"), name, p).alias("v")).first().v

    assert run(" a ", "trim") == "a" and run("\t a ", "ltrim") == "a " and run(" a \n", "rtrim") == " a"
    assert run("ab cd", "title") == "Ab Cd" and run("aXbX", "replace", old="X", new="--") == "a--b--" and run(None, "upper") == "<NIL>"
    assert run("abcdef", "blind_string") == "abcd**" and run("abc", "blind_string") == "***" and run("abcdef", "blind_string", mode="keep_last", count=2) == "****ef"
    assert run("joe.doe@x.org", "blind_string", mode="keep_domain", count=3) == "joe****@x.org" and run(" nobody ", "blind_string", mode="keep_domain") == "nobody"
    assert [d[0] for d in describe()] == sorted(REGISTRY)
    with pytest.raises(ValueError):
        run("a", "nope")
