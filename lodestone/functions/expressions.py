"""The recipe expression language: parser and compiler to Columns.

The grammar has no tokenizer: an expression is split at an operator outside quotes and parentheses. Operators are tried
one by one in a fixed order, each at its last occurrence, so ``a*b/c`` is ``a*(b/c)`` and ``a+b-c`` is ``a+(b-c)``. There
is no unary minus but in literals. A split whose sides don't parse is given up for the next operator.

A compiled expression is a pair of Columns: the value, and an error text that is null where the value is good. Errors
are data, so that one bad record fails its own input only. Branches that aren't taken have no errors.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the language: operators in the order in which they are tried.
BINARY = (("||", "&&"), ("==", "!=", ">=", "<=", ">", "<"), ("+", "-"), ("*", "/"))
COMPARE = BINARY[1]
FUNCTIONS = frozenset("abs round min max count sum lower upper normalize_space mask_tail mask_middle string_length starts_with_any value_in in_reference lookup_reference".split())
#: White space as Unicode has it, for Java patterns.
WHITE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


class ExpressionError(ValueError):
    """An expression that can't be parsed or compiled."""


@dataclass(frozen=True)
class Node:
    """``kind``: const, var, unary, binary, ternary or call; ``value``: constant, name or operator."""

    kind: str
    value: object = None
    args: tuple[Node, ...] = ()


def _outer(text: str) -> str:
    """The text with quoted parts and everything in parentheses blanked, of equal length."""
    out, depth, quote, escaped = [], 0, "", False
    for c in text:
        if quote:
            out.append("\0")
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
            out.append("\0")
        else:
            if c == ")":
                depth -= 1
            out.append(c if depth == 0 and c not in "()" else "\0")
            if c == "(":
                depth += 1
    if quote:
        raise ExpressionError(f"unterminated string literal in {text!r}")
    return "".join(out)


def _constant(text: str) -> Node | None:
    if text in ("true", "false"):
        return Node("const", text == "true")
    if text == "null":
        return Node("var", "null")
    if len(text) >= 2 and text[0] in "\"'" and text[-1] == text[0]:
        return Node("const", text[1:-1])
    if re.fullmatch(r"[+-]?\d+", text) and -(1 << 63) <= int(text) < 1 << 63:
        return Node("const", int(text))
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        return Node("const", float(text))
    return None


def _arguments(text: str) -> list[str]:
    outer, out, at = _outer(text), [], 0
    for k, c in enumerate(outer):
        if c == ",":
            out.append(text[at:k])
            at = k + 1
    out.append(text[at:])
    return [] if len(out) == 1 and not out[0].strip() else out


def parse(text: str) -> Node:
    """The syntax tree of an expression."""
    if not text.strip():
        raise ExpressionError("empty expression")
    text = text.strip()
    outer = _outer(text)
    call = re.match(r"([A-Za-z0-9_]+)\s*\(", text)
    if call and text.endswith(")") and not outer[call.end(1) :].strip("\0 \t\n"):
        name = call[1].lower()
        if _closes_at_end(text[call.end() - 1 :]):
            return Node("call", name, tuple(parse(a) for a in _arguments(text[call.end() : -1])))
    q = outer.find("?")
    if q >= 0:
        depth, colon = 0, -1
        for k in range(q + 1, len(outer)):
            if outer[k] == "?":
                depth += 1
            elif outer[k] == ":":
                if not depth:
                    colon = k
                    break
                depth -= 1
        if colon < 0:
            raise ExpressionError(f"malformed ternary {text!r}: missing ':'")
        return Node("ternary", None, (parse(text[:q]), parse(text[q + 1 : colon]), parse(text[colon + 1 :])))
    for level in BINARY:
        for op in level:
            k = outer.rfind(op)
            left, right = text[:k].strip(), text[k + len(op) :].strip()
            if k < 0 or not left or not right:
                continue
            try:
                return Node("binary", op, (parse(left), parse(right)))
            except ExpressionError:
                continue
    if text[0] == "!":
        return Node("unary", "!", (parse(text[1:]),))
    if text[0] == "(" and _closes_at_end(text):
        return parse(text[1:-1])
    return _constant(text) or Node("var", text)


def _closes_at_end(text: str) -> bool:
    """Whether the parenthesis that begins the text is closed by its last character."""
    depth, quote, escaped = 0, "", False
    for k, c in enumerate(text):
        if quote:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return k == len(text) - 1
    return False


def parse_filter(text: str) -> Node:
    """A filter: with ``&&``, ``||`` or parentheses outside strings a whole expression, else ``field op value``."""
    text = text.strip()
    quiet = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", lambda m: "\0" * len(m[0]), text)
    if any(m in quiet for m in ("&&", "||", "(", ")")):
        return parse(text)
    outer = _outer(text)
    for op in COMPARE:
        k = outer.find(op)
        if k >= 0:
            name, value = text[:k].strip(), text[k + len(op) :].strip()
            if not name or not value:
                raise ExpressionError(f"filter {text!r} needs a field and a value")
            const = Node("var", "null") if value == "null" else _constant(value) or Node("const", value)
            return Node("filter", op, (Node("var", name), const))
    raise ExpressionError(f"no operator in filter {text!r}")


def names(node: Node) -> set[str]:
    """The variables of an expression."""
    return ({str(node.value)} if node.kind == "var" else set()).union(*(names(a) for a in node.args))


def reference_tables(node: Node) -> set[str]:
    """The reference tables of an expression; their names must be literals."""
    own = set()
    if node.kind == "call" and node.value in ("in_reference", "lookup_reference"):
        if not node.args or node.args[0].kind != "const" or not isinstance(node.args[0].value, str):
            raise ExpressionError(f"{node.value}() needs a literal table name")
        own = {node.args[0].value}
    return own.union(*(reference_tables(a) for a in node.args))


@dataclass
class Typed:
    """A compiled value: its Column, its kind (number, integer, string, boolean, null, strings, map, other) and its error."""

    value: Column
    kind: str
    error: Column | None = None
    literal: object = None


Lookup = Callable[[str, Column], tuple[Column, Column]]


@dataclass
class Scope:
    """Names to typed Columns, and reference tables to functions that give (hit, value) of a probe Column."""

    variables: dict[str, Typed] = field(default_factory=dict)
    references: dict[str, Lookup] = field(default_factory=dict)

    def with_(self, more: dict[str, Typed]) -> Scope:
        return Scope({**self.variables, **more}, self.references)


def first_error(*errors: Column | None) -> Column | None:
    live = [e for e in errors if e is not None]
    return F.coalesce(*live) if len(live) > 1 else live[0] if live else None


def once(c: Column) -> Column:
    """A column that is computed once a row: under a condition that isn't deterministic the optimizer copies it into none of its users.

    Filters that Spark infers and pushes down (those of ``explode`` too) would otherwise hold every step below them, again and again.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside lambdas."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _fail(text: str) -> Column:
    return F.lit(text)


def _is_number(t: Typed) -> bool:
    return t.kind in ("number", "integer")


def _number(t: Typed, what: str) -> tuple[Column, Column | None]:
    """As a double, with an error for other kinds and for null."""
    if not _is_number(t):
        return F.lit(None).cast("double"), first_error(t.error, _fail(f"{what}: not a number"))
    return t.value.cast("double"), t.error


def _guarded(value: Column, error: Column | None) -> Column:
    return value if error is None else F.when(error.isNull(), value)


def compile_node(node: Node, scope: Scope) -> Typed:
    """The Column of a syntax tree over a scope."""
    if node.kind == "const":
        v = node.value
        if isinstance(v, bool):
            return Typed(F.lit(v), "boolean", literal=v)
        if isinstance(v, int):
            return Typed(F.lit(v).cast("long"), "integer", literal=v)
        return Typed(F.lit(v), "number" if isinstance(v, float) else "string", literal=v)
    if node.kind == "var":
        name = str(node.value)
        if name == "null":
            return Typed(F.lit(None), "null")
        if name in ("true", "false"):
            return Typed(F.lit(name == "true"), "boolean")
        if name not in scope.variables:
            return Typed(F.lit(None), "null", _fail(f"undefined variable: {name}"))
        t = scope.variables[name]
        if t.kind == "null" or t.literal == "nullable":
            return t
        return Typed(t.value, t.kind, first_error(t.error, F.when(t.value.isNull(), F.lit(f"undefined variable: {name}"))), t.literal)
    if node.kind == "ternary":
        c, a, b = (compile_node(x, scope) for x in node.args)
        if c.kind != "boolean":
            return Typed(F.lit(None), "null", first_error(c.error, _fail("the condition isn't boolean")))
        kind = a.kind if a.kind == b.kind or b.kind == "null" else b.kind if a.kind == "null" else "number" if _is_number(a) and _is_number(b) else "mixed"
        x, y = a.value, b.value
        if kind == "mixed":
            x, y, kind = as_text(a), as_text(b), "string"
        elif kind == "number":
            x, y = x.cast("double"), y.cast("double")
        none = F.lit(None).cast("string")
        branch = None if a.error is None and b.error is None else F.when(c.value, none if a.error is None else a.error).otherwise(none if b.error is None else b.error)
        return Typed(F.when(c.value, x).otherwise(y), kind, first_error(c.error, branch))
    if node.kind == "unary":
        t = compile_node(node.args[0], scope)
        if t.kind != "boolean":
            return Typed(F.lit(None), "boolean", first_error(t.error, _fail("! needs a boolean")))
        return Typed(~t.value, "boolean", t.error)
    if node.kind == "binary":
        return _binary(str(node.value), compile_node(node.args[0], scope), compile_node(node.args[1], scope))
    if node.kind == "filter":
        return _simple(node, scope)
    return _call(str(node.value), node, scope)


def _binary(op: str, a: Typed, b: Typed) -> Typed:
    error = first_error(a.error, b.error)
    if op in ("&&", "||"):
        if a.kind != "boolean" or b.kind != "boolean":
            return Typed(F.lit(None).cast("boolean"), "boolean", first_error(error, _fail(f"{op} needs booleans")))
        return Typed(a.value & b.value if op == "&&" else a.value | b.value, "boolean", error)
    if op in COMPARE:
        return Typed(*_compare(op, a, b, error))
    x, ex = _number(a, op)
    y, ey = _number(b, op)
    error = first_error(ex, ey)
    if op == "/":
        return Typed(F.try_divide(x, y), "number", first_error(error, F.when(y == 0, F.lit("division by zero"))))
    return Typed({"+": x + y, "-": x - y, "*": x * y}[op], "number", error)


def _compare(op: str, a: Typed, b: Typed, error: Column | None) -> tuple[Column, str, Column | None]:
    if _is_number(a) and _is_number(b):
        x, y = a.value.cast("double"), b.value.cast("double")
    elif a.kind == b.kind and a.kind in ("string", "boolean"):
        x, y = a.value, b.value
    elif "null" in (a.kind, b.kind):
        x, y = a.value, b.value
        if op not in ("==", "!="):
            return F.lit(None).cast("boolean"), "boolean", first_error(error, _fail(f"{op} needs numbers"))
        both = F.lit(True) if a.kind == b.kind else (x if b.kind == "null" else y).isNull()
        # an absent operand of a null test is null, not undefined
        own = first_error(*(t.error for t in (a, b) if t.kind == "null"))
        return (both if op == "==" else ~both), "boolean", own if a.kind != b.kind else error
    elif op in ("==", "!="):
        return F.lit(op == "!="), "boolean", error
    else:
        return F.lit(None).cast("boolean"), "boolean", first_error(error, _fail(f"{op} needs numbers"))
    if op not in ("==", "!=") and not (_is_number(a) and _is_number(b)):
        return F.lit(None).cast("boolean"), "boolean", first_error(error, _fail(f"{op} needs numbers"))
    return {"==": x == y, "!=": x != y, ">=": x >= y, "<=": x <= y, ">": x > y, "<": x < y}[op], "boolean", error


def _simple(node: Node, scope: Scope) -> Typed:
    """``field op value``: a missing field passes only ``== null``."""
    name, op = str(node.args[0].value), str(node.value)
    t = _path(name, scope)
    if node.args[1].kind == "var":
        if op not in ("==", "!="):
            return Typed(F.lit(False), "boolean")
        absent = F.lit(True) if t is None else t.value.isNull()
        return Typed(absent if op == "==" else ~absent, "boolean")
    if t is None:
        return Typed(F.lit(False), "boolean")
    value, _, error = _compare(op, Typed(t.value, t.kind), compile_node(node.args[1], scope), None)
    return Typed(F.coalesce(value, F.lit(False)), "boolean", None if error is None else F.when(t.value.isNotNull(), error))


def _path(name: str, scope: Scope) -> Typed | None:
    """A field by its name, or nested by a dotted path."""
    if name in scope.variables:
        return scope.variables[name]
    head, *rest = name.split(".")
    if head in scope.variables and rest:
        t = scope.variables[head]
        return Typed(reduce(lambda c, k: c[k], rest, t.value), "string" if not isinstance(t.literal, dict) else t.literal.get(".".join(rest), "string"))
    return None


def as_text(t: Typed) -> Column:
    """The text of a value as the language prints it: whole numbers without a fraction."""
    if t.kind == "number":
        whole = (t.value == F.floor(t.value)) & (F.abs(t.value) < 1e15)
        return F.when(whole, t.value.cast("long").cast("string")).otherwise(t.value.cast("string"))
    return t.value.cast("string")


def normalized_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WHITE + "+", " "))


def _text_arg(name: str, t: Typed) -> tuple[Column, Column | None]:
    if t.kind == "null":
        return F.lit(None).cast("string"), t.error
    if t.kind != "string":
        return F.lit(None).cast("string"), first_error(t.error, _fail(f"{name}() needs a string"))
    return t.value, t.error


def _count_arg(name: str, t: Typed) -> tuple[Column, Column | None]:
    v, e = _number(t, f"{name}()")
    bad = F.when(F.isnan(v) | (v < 0) | (v != F.floor(v)), F.lit(f"{name}() needs a whole number of at least 0"))
    return v.cast("int"), first_error(e, bad)


def _mask_char(name: str, node: Node, k: int) -> str:
    if k >= len(node.args):
        return "X"
    a = node.args[k]
    if a.kind != "const" or not isinstance(a.value, str) or len(a.value) != 1:
        raise ExpressionError(f"{name}() needs a mask of one character")
    return a.value


def _arity(node: Node, low: int, high: int | None = None) -> None:
    n = len(node.args)
    if n < low or (high is not None and n > high):
        raise ExpressionError(f"{node.value}() has {n} arguments")


def _call(name: str, node: Node, scope: Scope) -> Typed:
    if name not in FUNCTIONS:
        raise ExpressionError(f"unknown function {name}()")
    if name in ("count", "sum"):
        t = scope.variables.get(name)
        return t if t is not None else Typed(F.lit(0).cast("long") if name == "count" else F.lit(0.0), "integer" if name == "count" else "number")
    if name in ("in_reference", "lookup_reference"):
        _arity(node, 2 if name == "in_reference" else 3, 2 if name == "in_reference" else 3)
        (tbl,) = reference_tables(Node("call", name, node.args[:1]))
        if tbl not in scope.references:
            raise ExpressionError(f"unknown reference table {tbl!r}")
        probe = compile_node(node.args[1], scope)
        key = as_text(probe) if probe.kind != "null" else F.lit(None).cast("string")
        hit, value = scope.references[tbl](tbl, key)
        missed = probe.error if probe.kind == "null" else None  # an absent probe is a miss
        if name == "in_reference":
            return Typed(F.coalesce(hit, F.lit(False)), "boolean", missed)
        default = compile_node(node.args[2], scope)
        return Typed(F.when(F.coalesce(hit, F.lit(False)), value).otherwise(as_text(default)), "string", first_error(missed, default.error))
    args = [compile_node(a, scope) for a in node.args]
    if name in ("abs", "round"):
        _arity(node, 1, 1 if name == "abs" else 2)
        x, e = _number(args[0], f"{name}()")
        if name == "abs":
            return Typed(F.abs(x), "number", e)
        if len(args) == 1:
            return Typed(_away(x), "number", e)
        n, e2 = _number(args[1], "round()")
        scale = F.pow(F.lit(10.0), F.greatest(_away(n), F.lit(0.0)))
        return Typed(_away(x * scale) / scale, "number", first_error(e, e2))
    if name in ("min", "max"):
        _arity(node, 1)
        parts = [_number(a, f"{name}()") for a in args]
        values = [p[0] for p in parts]
        return Typed(values[0] if len(values) == 1 else (F.least if name == "min" else F.greatest)(*values), "number", first_error(*(p[1] for p in parts)))
    if name in ("starts_with_any", "value_in"):
        _arity(node, 2, 2)
        s, e = _text_arg(name, args[0])
        if node.args[0].kind == "var" and args[0].kind == "string":
            e = scope.variables[str(node.args[0].value)].error  # an absent value is no member
        if args[1].kind != "strings":
            return Typed(F.lit(None).cast("boolean"), "boolean", first_error(e, args[1].error, _fail(f"{name}() needs a list of strings")))
        if args[1].literal and "" in args[1].literal:
            raise ExpressionError(f"{name}() list has an empty member")
        members = args[1].value
        hit = F.exists(members, lambda p: s.startswith(p)) if name == "starts_with_any" else F.array_contains(members, s)
        return Typed(F.coalesce(hit, F.lit(False)), "boolean", first_error(e, args[1].error))
    _arity(node, {"mask_tail": 2, "mask_middle": 3}.get(name, 1), {"mask_tail": 3, "mask_middle": 4}.get(name, 1))
    s, e = _text_arg(name, args[0])
    if name == "string_length":
        if node.args[0].kind == "var" and args[0].kind == "string":
            e = scope.variables[str(node.args[0].value)].error
        return Typed(F.coalesce(F.char_length(s), F.lit(0)).cast("long"), "integer", e)
    if name in ("lower", "upper", "normalize_space"):
        return Typed({"lower": F.lower, "upper": F.upper, "normalize_space": normalized_space}[name](s), "string", e)
    n = F.char_length(s)
    k, e1 = _count_arg(name, args[1])
    if name == "mask_tail":
        mask = F.lit(_mask_char(name, node, 2))
        return Typed(F.when(k >= n, s).otherwise(F.concat(F.repeat(mask, n - k), F.right(s, k))), "string", first_error(e, e1))
    m, e2 = _count_arg(name, args[2])
    mask = F.lit(_mask_char(name, node, 3))
    return Typed(F.when(k >= n - m, s).otherwise(F.concat(F.left(s, k), F.repeat(mask, n - k - m), F.right(s, m))), "string", first_error(e, e1, e2))


def _away(x: Column) -> Column:
    """Rounded to a whole number, halves away from zero, on the binary value."""
    return F.when(x >= 0, F.when(x - F.floor(x) >= 0.5, F.floor(x) + 1).otherwise(F.floor(x))).otherwise(-F.when(-x - F.floor(-x) >= 0.5, F.floor(-x) + 1).otherwise(F.floor(-x))).cast("double")


def compile_expression(text: str, scope: Scope) -> Typed:
    return compile_node(parse(text), scope)
