from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from marklake.functions import frontmatter as fm
from marklake.functions import jmespath, jsonschema, predicates

FM = '---\ns: text\nn: 5\nf: 1.5\nb: true\nz: null\ne: ""\na: [1, "1", x]\no: {}\nd: 2026-01-02\nt: 2026-01-02T10:00:00+02:00\n---\n'
CASES = [
    ("z", "hasKey", None, True), ("z", "notEmpty", None, True), ("z", "doesntEqual", 1, True), ("q", "doesntEqual", 1, False), ("q", "notIn", [1], False), ("q", "doesntHaveKey", None, True), ("n", "equals", 5, True), ("n", "equals", "5", False), ("f", "equals", 1, False),
    ("a", "includes", 1, True), ("a", "includes", "1", True), ("a", "includes", "2", False), ("s", "notIncludes", "x", False), ("e", "empty", None, True), ("o", "emptyObject", None, True), ("n", "empty", None, False), ("s", "regex", "ex", True), ("n", "regex", "5", False), ("b", "typeIs", "boolean", True),
    ("d", "onOrAfter", "2026-01-02T00:00:00Z", False), ("d", "onOrAfter", "2026-01-02", True), ("t", "after", "2026-01-02T07:59:59Z", True), ("t", "before", "2026-01-02T08:00:00Z", False), ("t", "onOrBefore", "2026-01-02", True), ("d", "between", ["2026-01-01", "2026-01-03"], True), ("n", "between", [1, 5], True), ("s", "greaterThan", 1, False), ("n", "in", [4, 5], True),
]


def test_fields(spark):
    d = fm.with_frontmatter(spark.createDataFrame([("p", FM)], "path string, content string"))
    row = d.select(*(predicates.field(F.col("fm.entries"), k, op, x).alias(f"c{i}") for i, (k, op, x, _) in enumerate(CASES))).first()
    assert [(c[:3], v) for c, v in zip(CASES, row, strict=True)] == [(c[:3], c[3]) for c in CASES]


def test_globs():
    m = lambda g, p, **k: bool(re.search(predicates.glob(g, **k).replace(r"\z", r"\Z"), p))
    assert m("**/index.md", "myindex.md") and not m("**/index.md", "myindex.md", segment_exact=True)
    assert m("books/**/*.md", "books/a/b.md") and m("*.md", "a.md") and not m("*.md", "a/b.md") and m("?.md", "a.md")
    x = lambda g, p: bool(re.search(predicates.exclude_glob(g).replace(r"\z", r"\Z"), p))
    assert x("/a/b", "/a/b/c.md") and not x("/a/b", "/a/bc.md") and x("/a/[!x]*.md", "/a/yz.md") and not x("/a/[!x]*.md", "/a/xz.md") and x("/a/**/c.md", "/a/c.md")


DOC = {"draft": True, "tags": ["x", "y"], "n": 0, "title": "Dune", "nested": {"a": [{"b": 1}, {"b": 2}]}, "none": None, "empty": [], "q-k": 1}
EXPRESSIONS = [
    ("draft == `true`", True), ("contains(tags, 'x')", True), ("contains(tags, `\"z\"`)", False), ("draft && contains(title, 'un')", True), ("n", True), ("none", False), ("empty", False), ("!draft", False), ("length(tags) == `2`", True), ("n < `1` && n >= `0`", True), ("starts_with(title, 'D')", True),
    ("nested.a[1].b == `2`", True), ("nested.a[?b > `1`].b | [0]", True), ("nested.a[*].b", True), ("sum(nested.a[*].b) == `3`", True), ("to_string(n) == '0'", True), ('"q-k" == `1`', True), ("missing.x.y", False), ("contains(n, 'x')", False), ("max_by(nested.a, &b).b == `2`", True), ("tags[-1] == 'y'", True), ("tags[::-1] | [0] == 'y'", True),
    ("{a: title}.a == 'Dune'", True), ("[title, n][0] == 'Dune'", True), ("title == 'Dune' || missing", True), ("title != 'x'", True), ("keys(nested)[0] == 'a'", True), ("not_null(missing, title) == 'Dune'", True), ("*.a | [0][0].b == `1`", True), ("nested.a[].b | length(@) == `2`", True), ("title < `1`", False), ("!contains(n, 'x')", False),
]


def test_jmespath_interpreted():
    for text, want in EXPRESSIONS:
        try:
            got = jmespath.truthy(jmespath.search(jmespath.parse(text), DOC))
        except jmespath.JMESPathError:
            got = False
        assert got == want, text
    for bad in ("a ==", "foo(", "a..b", "unknown(a)", "[?a", ""):
        with pytest.raises(jmespath.JMESPathError):
            jmespath.parse(bad)


def test_jmespath_columns_agree(spark):
    d = spark.createDataFrame([(json.dumps(DOC),), ("{}",), (None,)], "j string")
    row = d.select(*(jmespath.matches(F.col("j"), t).alias(f"c{i}") for i, (t, _) in enumerate(EXPRESSIONS))).collect()
    assert list(row[0]) == [w for _, w in EXPRESSIONS]
    assert not any(row[2])


def test_json_schema():
    s = {"type": "object", "required": ["a"], "properties": {"a": {"$ref": "#/$defs/pos"}, "l": {"type": "array", "contains": {"const": 1}, "uniqueItems": True}}, "additionalProperties": False, "$defs": {"pos": {"type": "integer", "minimum": 1}}}
    words = lambda v: [e[0] for e in jsonschema.errors(s, v)]
    assert words({"a": 1}) == [] and words({}) == ["required"] and words({"a": 0}) == ["minimum"] and words({"a": "x"}) == ["type"] and words({"a": 1, "z": 1}) == ["additionalProperties"]
    assert words({"a": 1, "l": [2, 2]}) == ["uniqueItems", "contains"]
    assert [e[0] for e in jsonschema.errors({"oneOf": [{"type": "string"}, {"minLength": 1}]}, "x")] == ["oneOf"]
    assert [e[0] for e in jsonschema.errors({"if": {"const": 1}, "then": False, "else": {"type": "string"}}, 1)] == ["false"]
    with pytest.raises(jsonschema.SchemaError):
        jsonschema.errors({"unevaluatedProperties": False}, {})
    files = {"b.json": {"$id": "b", "$defs": {"t": {"type": "string"}}, "properties": {"x": {"$ref": "#/$defs/t"}}}}
    r = jsonschema.resolve({"$ref": "b.json"}, lambda ref, base: files[ref])
    assert jsonschema.errors(r, {"x": 1})[0][0] == "type"
    with pytest.raises(jsonschema.SchemaError):
        jsonschema.resolve({"$ref": "c.json"})
    loop = {"a": {"$ref": "b"}, "b": {"$ref": "a"}}
    with pytest.raises(jsonschema.SchemaError):
        jsonschema.resolve({"$ref": "a"}, lambda ref, base: loop[ref])
