"""JMESPath: a parser, an interpreter, and a compiler to Columns for what DataFrames can say.

Compiled are paths of names, literals, comparisons, and, or, not, contains, starts_with, ends_with and length. Anything
else runs in the interpreter behind an Arrow UDF. In both a run-time error of a record is no match.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marklake.functions.arrow import lazy
from marklake.functions.values import canonical, kind, plain

TOKEN = re.compile(
    r"""\s*(?:(?P<id>[A-Za-z_][A-Za-z0-9_]*)|(?P<quoted>"(?:\\.|[^"\\])*")|(?P<raw>'(?:\\'|[^'])*')|(?P<lit>`(?:\\`|[^`])*`)|(?P<num>-?\d+)|(?P<op>\[\?|\[\]|\|\||&&|==|!=|<=|>=|[.*@&|!<>()\[\]{},:])|(?P<end>\Z))"""
)
COMPARE = ("==", "!=", "<", "<=", ">", ">=")


class JMESPathError(ValueError):
    pass


class _Parser:
    """Recursive descent with binding powers; nodes are tuples."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while True:
            m = TOKEN.match(text, at)
            if not m:
                raise JMESPathError(f"unexpected character at {at}")
            at = m.end()
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            if m.lastgroup == "end":
                break
        self.i = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i]

    def take(self, want: str | None = None) -> tuple[str, str]:
        t = self.tokens[self.i]
        if want is not None and t[1] != want or t[0] == "end" and want is not None:
            raise JMESPathError(f"expected {want!r}, found {t[1]!r}")
        self.i += 1
        return t

    def whole(self):
        e = self.pipe()
        if self.peek()[0] != "end":
            raise JMESPathError(f"unexpected {self.peek()[1]!r}")
        return e

    def pipe(self):
        e = self.either()
        while self.peek()[1] == "|" and self.peek()[0] == "op":
            self.take()
            e = ("pipe", e, self.either())
        return e

    def either(self):
        e = self.both()
        while self.peek() == ("op", "||"):
            self.take()
            e = ("or", e, self.both())
        return e

    def both(self):
        e = self.compared()
        while self.peek() == ("op", "&&"):
            self.take()
            e = ("and", e, self.compared())
        return e

    def compared(self):
        e = self.negated()
        if self.peek()[0] == "op" and self.peek()[1] in COMPARE:
            e = ("cmp", self.take()[1], e, self.negated())
        return e

    def negated(self):
        if self.peek() == ("op", "!"):
            self.take()
            return ("not", self.negated())
        return self.chain(self.first())

    def first(self):
        group, t = self.peek()
        if group == "id":
            self.take()
            return self.call(t) if self.peek() == ("op", "(") else ("field", t)
        if group == "quoted":
            self.take()
            return ("field", json.loads(t))
        if group == "raw":
            self.take()
            return ("lit", t[1:-1].replace("\\'", "'"))
        if group == "lit":
            self.take()
            inner = t[1:-1].replace("\\`", "`").strip()
            try:
                return ("lit", plain(json.loads(inner)))
            except ValueError:
                return ("lit", inner)
        if t == "@":
            self.take()
            return ("self",)
        if t == "*":
            return ("self",)
        if t in ("[", "[?", "[]"):
            return ("self",) if self._bracket_is_access() else self.many()
        if t == "{":
            return self.many()
        if t == "&":
            self.take()
            return ("expref", self.either())
        if t == "(":
            self.take()
            e = self.pipe()
            self.take(")")
            return e
        raise JMESPathError(f"unexpected {t!r}")

    def _bracket_is_access(self) -> bool:
        if self.peek()[1] in ("[?", "[]"):
            return True
        group, t = self.tokens[self.i + 1]
        return group == "num" or t == ":" or (t == "*" and self.tokens[self.i + 2][1] == "]")

    def call(self, name: str):
        self.take("(")
        args = []
        while self.peek()[1] != ")":
            args.append(self.pipe())
            if self.peek()[1] == ",":
                self.take()
            elif self.peek()[1] != ")":
                raise JMESPathError("expected , or )")
        self.take(")")
        if name not in FUNCTIONS:
            raise JMESPathError(f"unknown function {name}")
        return ("call", name, tuple(args))

    def many(self):
        if self.take()[1] == "[":
            items = [self.pipe()]
            while self.peek()[1] == ",":
                self.take()
                items.append(self.pipe())
            self.take("]")
            return ("list", tuple(items))
        pairs = []
        while True:
            group, t = self.take()
            if group not in ("id", "quoted"):
                raise JMESPathError("expected a key")
            self.take(":")
            pairs.append((json.loads(t) if group == "quoted" else t, self.pipe()))
            if self.take()[1] == "}":
                return ("hash", tuple(pairs))

    def chain(self, e):
        """What follows a first part; a projection takes the rest of the chain as its right side."""
        while True:
            group, t = self.peek()
            if group != "op":
                return e
            if t == ".":
                self.take()
                group, t = self.peek()
                if t == "*" and group == "op":
                    self.take()
                    return ("values", e, self.chain(("self",)))
                if t in ("[", "{"):
                    e = ("sub", e, self.many())
                elif group in ("id", "quoted"):
                    e = ("sub", e, self.first())
                else:
                    raise JMESPathError(f"unexpected {t!r} after .")
            elif t == "*" and e == ("self",):
                self.take()
                return ("values", e, self.chain(("self",)))
            elif t == "[]":
                self.take()
                return ("flatten", e, self.chain(("self",)))
            elif t == "[?":
                self.take()
                test = self.pipe()
                self.take("]")
                return ("filter", e, test, self.chain(("self",)))
            elif t == "[":
                self.take()
                if self.peek() == ("op", "*"):
                    self.take()
                    self.take("]")
                    return ("each", e, self.chain(("self",)))
                parts: list[int | None] = [None]
                colons = 0
                while self.peek()[1] != "]":
                    group, t = self.take()
                    if group == "num":
                        parts[-1] = int(t)
                    elif t == ":":
                        colons += 1
                        parts.append(None)
                    else:
                        raise JMESPathError(f"unexpected {t!r} in brackets")
                self.take("]")
                if not colons:
                    if parts[0] is None:
                        raise JMESPathError("empty brackets")
                    e = ("index", e, parts[0])
                else:
                    return ("slice", e, tuple((parts + [None] * 3)[:3]), self.chain(("self",)))
            else:
                return e


def parse(text: str):
    return _Parser(text).whole()


def truthy(v: Any) -> bool:
    """Null, false and empty strings, arrays and objects are false; every number is true."""
    return not (v is None or v is False or v in ("", [], {}) and not isinstance(v, (int, float)))


def _same(a: Any, b: Any) -> bool:
    return kind(a) == kind(b) and canonical(a) == canonical(b)


def _number(x):
    if kind(x) != "number":
        raise JMESPathError("not a number")
    return x


def _contains(a, b):
    if isinstance(a, str):
        return isinstance(b, str) and b in a
    if isinstance(a, list):
        return any(_same(x, b) for x in a)
    raise JMESPathError("contains takes a string or an array")


def _length(a):
    if isinstance(a, (str, list, dict)):
        return len(a)
    raise JMESPathError("no length")


def _text(x):
    if not isinstance(x, str):
        raise JMESPathError("not a string")
    return x


def _ordered(xs: list) -> list:
    if not all(isinstance(x, str) for x in xs):
        [_number(x) for x in xs]
    return sorted(xs)


def _to_number(x):
    if kind(x) == "number":
        return x
    try:
        return plain(json.loads(x)) if isinstance(x, str) and kind(json.loads(x)) == "number" else None
    except ValueError:
        return None


def _keyed(xs, e):
    return [(search(e, x), i, x) for i, x in enumerate(xs)]


FUNCTIONS = {
    "abs": lambda x: abs(_number(x)), "avg": lambda xs: plain(sum(map(_number, xs)) / len(xs)) if xs else None, "ceil": lambda x: -int(-_number(x) // 1), "floor": lambda x: int(_number(x) // 1),
    "contains": _contains, "ends_with": lambda a, b: _text(a).endswith(_text(b)), "starts_with": lambda a, b: _text(a).startswith(_text(b)), "join": lambda glue, xs: _text(glue).join(map(_text, xs)),
    "keys": lambda o: list(o.keys()), "values": lambda o: list(o.values()), "length": _length, "map": lambda e, xs: [search(e[1], x) for x in xs], "max": lambda xs: _ordered(xs)[-1] if xs else None, "min": lambda xs: _ordered(xs)[0] if xs else None,
    "max_by": lambda xs, e: max(_keyed(xs, e[1]), key=lambda t: t[0])[2] if xs else None, "min_by": lambda xs, e: min(_keyed(xs, e[1]), key=lambda t: t[0])[2] if xs else None, "merge": lambda *os: {k: v for o in os for k, v in o.items()},
    "not_null": lambda *xs: next((x for x in xs if x is not None), None), "reverse": lambda x: x[::-1], "sort": _ordered, "sort_by": lambda xs, e: [t[2] for t in sorted(_keyed(xs, e[1]), key=lambda t: (t[0], t[1]))], "sum": lambda xs: sum(map(_number, xs)),
    "to_array": lambda x: x if isinstance(x, list) else [x], "to_number": _to_number, "to_string": lambda x: x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":")), "type": kind,
}


def search(e, v: Any) -> Any:
    """Value of a parsed expression."""
    match e:
        case ("self",):
            return v
        case ("field", name):
            return v.get(name) if isinstance(v, dict) else None
        case ("lit", x):
            return x
        case ("sub", a, b):
            left = search(a, v)
            return None if left is None else search(b, left)
        case ("pipe", a, b):
            return search(b, search(a, v))
        case ("index", a, i):
            xs = search(a, v)
            return xs[i] if isinstance(xs, list) and -len(xs) <= i < len(xs) else None
        case ("each", a, b):
            xs = search(a, v)
            return [y for x in xs if (y := search(b, x)) is not None] if isinstance(xs, list) else None
        case ("values", a, b):
            o = search(a, v)
            return [y for x in o.values() if (y := search(b, x)) is not None] if isinstance(o, dict) else None
        case ("flatten", a, b):
            xs = search(a, v)
            if not isinstance(xs, list):
                return None
            flat = [y for x in xs for y in (x if isinstance(x, list) else [x])]
            return [y for x in flat if (y := search(b, x)) is not None]
        case ("filter", a, test, b):
            xs = search(a, v)
            return [y for x in xs if truthy(search(test, x)) and (y := search(b, x)) is not None] if isinstance(xs, list) else None
        case ("slice", a, parts, b):
            xs = search(a, v)
            if parts[2] == 0:
                raise JMESPathError("slice step is 0")
            return [y for x in xs[slice(*parts)] if (y := search(b, x)) is not None] if isinstance(xs, list) else None
        case ("list", items):
            return None if v is None else [search(x, v) for x in items]
        case ("hash", pairs):
            return None if v is None else {k: search(x, v) for k, x in pairs}
        case ("or", a, b):
            left = search(a, v)
            return left if truthy(left) else search(b, v)
        case ("and", a, b):
            left = search(a, v)
            return search(b, v) if truthy(left) else left
        case ("not", a):
            return not truthy(search(a, v))
        case ("cmp", op, a, b):
            x, y = search(a, v), search(b, v)
            if op in ("==", "!="):
                return _same(x, y) == (op == "==")
            if kind(x) != "number" or kind(y) != "number":
                return None
            return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        case ("expref", _):
            return e
        case ("call", name, args):
            try:
                return FUNCTIONS[name](*(search(a, v) for a in args))
            except (TypeError, AttributeError, ValueError, KeyError, IndexError) as bad:
                raise JMESPathError(f"{name}: {bad}") from bad
    raise JMESPathError(f"bad expression {e[0]}")


def _path(e) -> list[str] | None:
    match e:
        case ("field", name):
            return [name] if re.fullmatch(r"[^'\"\[\].$*]+", name) else None
        case ("sub", a, b):
            left, right = _path(a), _path(b)
            return left + right if left and right else None
    return None


def _kind(v: Column) -> Column:
    s = F.schema_of_variant(v)
    return F.when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").when(v.isNull() | (s == "VOID"), "null").otherwise("number")


class _Compiler:
    """Columns over a VARIANT; None from a method means: not expressible."""

    def __init__(self, variant: Column):
        self.variant = variant

    def value(self, e) -> tuple[Column, Column] | None:
        """(kind, JSON text) of an operand."""
        if e[0] == "lit":
            return F.lit(kind(e[1])), F.lit(canonical(e[1]))
        if e[0] == "call" and e[1] == "length" and (p := _path(e[2][0])):
            v = self.at(p)
            items = F.size(F.try_variant_get(v, "$", "array<variant>"))
            n = F.when(_kind(v) == "string", F.length(F.try_variant_get(v, "$", "string"))).when(_kind(v) == "array", items)
            return F.when(n.isNotNull(), "number").otherwise("error"), n.cast("string")
        p = _path(e)
        return (_kind(self.at(p)), F.coalesce(F.to_json(self.at(p)), F.lit("null"))) if p else None

    def at(self, path: list[str]) -> Column:
        return F.try_variant_get(self.variant, "$" + "".join(f"['{x}']" for x in path), "variant")

    def holds(self, e) -> Column | None:
        """Truthiness."""
        if e[0] in ("and", "or"):
            a, b = self.holds(e[1]), self.holds(e[2])
            return None if a is None or b is None else a & b if e[0] == "and" else a | b
        if e[0] == "not":
            a = self.holds(e[1])
            return None if a is None or "call" in str(e[1]) else ~a  # an error under `not` is still no match
        if e[0] == "cmp":
            a, b = self.value(e[2]), self.value(e[3])
            if a is None or b is None:
                return None
            fine = (a[0] != "error") & (b[0] != "error")
            numbers = (a[0] == "number") & (b[0] == "number")
            x, y = F.when(numbers, a[1].cast("double")), F.when(numbers, b[1].cast("double"))
            same = F.when(numbers, x == y).otherwise((a[0] == b[0]) & (a[1] == b[1]))
            out = {"==": same, "!=": ~same, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[e[1]]
            return F.coalesce(fine & out, F.lit(False))
        if e[0] == "call" and e[1] in ("contains", "starts_with", "ends_with") and len(e[2]) == 2 and e[2][1][0] == "lit" and (p := _path(e[2][0])):
            v, x = self.at(p), e[2][1][1]
            text = F.try_variant_get(v, "$", "string")
            inside = F.lit(False)
            if isinstance(x, str):
                inside = {"contains": text.contains(x), "starts_with": text.startswith(x), "ends_with": text.endswith(x)}[e[1]] & (_kind(v) == "string")
            if e[1] == "contains":
                items = F.try_variant_get(v, "$", "array<variant>")
                inside = F.when(_kind(v) == "array", F.exists(items, lambda i: (_kind(i) == kind(x)) & (F.coalesce(F.to_json(i), F.lit("null")) == canonical(x)))).otherwise(inside)
            return F.coalesce(inside, F.lit(False))
        if p := _path(e):
            v = self.at(p)
            json_ = F.to_json(v)
            return F.coalesce(F.when(_kind(v) == "null", False).when(_kind(v) == "boolean", json_ == "true").otherwise(~json_.isin('""', "[]", "{}")), F.lit(False))
        return None


@lazy("boolean")
def _matches(json_: pa.Array, expression: pa.Array) -> pa.Array:
    parsed: dict[str, Any] = {}
    out = []
    for j, x in zip(json_.to_pylist(), expression.to_pylist(), strict=True):
        try:
            e = parsed.get(x) or parsed.setdefault(x, parse(x))
            out.append(j is not None and truthy(search(e, json.loads(j))))
        except JMESPathError:
            out.append(False)
    return pa.array(out, pa.bool_())


def matches(json_: Column, expression: str) -> Column:
    """Whether a record's frontmatter (JSON text; null for none) satisfies an expression. Syntax errors are raised here."""
    e = parse(expression)
    column = _Compiler(F.try_parse_json(json_)).holds(e)
    return _matches(json_, F.lit(expression)) if column is None else F.coalesce(json_.isNotNull() & column, F.lit(False))


@lazy("struct<kind:string,json:string,error:string>")
def _value(json_: pa.Array, expression: pa.Array) -> pa.Array:
    out = []
    parsed: dict[str, Any] = {}
    for j, x in zip(json_.to_pylist(), expression.to_pylist(), strict=True):
        try:
            e = parsed.get(x) or parsed.setdefault(x, parse(x))
            v = search(e, json.loads(j)) if j is not None else None
            out.append({"kind": kind(v), "json": canonical(v), "error": None})
        except JMESPathError as bad:
            out.append({"kind": None, "json": None, "error": str(bad)})
    return pa.array(out, pa.struct([("kind", pa.string()), ("json", pa.string()), ("error", pa.string())]))


def value(json_: Column, expression: str) -> Column:
    """struct(kind, json, error) of an expression; paths stay Columns, the rest is interpreted."""
    e = parse(expression)
    if p := _path(e):
        v = _Compiler(F.try_parse_json(json_)).at(p)
        return F.struct(F.coalesce(_kind(v), F.lit("null")).alias("kind"), F.coalesce(F.to_json(v), F.lit("null")).alias("json"), F.lit(None).cast("string").alias("error"))
    return _value(json_, F.lit(expression))
