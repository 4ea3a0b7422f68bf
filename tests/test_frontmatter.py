from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marklake.functions import frontmatter as fm
from marklake.functions import values
from marklake.operators import collection

SPLITS = [
    ("---\na: 1\n---\nBody", "yaml", "a: 1", "Body"), ("---\n---\nB", "yaml", "", "B"), ("---\na: 1\n---foo\nB", "yaml", "a: 1", "foo\nB"), ("---\na: 1\nno close", None, None, "---\na: 1\nno close"),
    ("--- \na\n---\nB", None, None, "--- \na\n---\nB"), ("---\r\na\n---\nB", None, None, "---\r\na\n---\nB"), ("---\na: 1\n---\r\nB", "yaml", "a: 1", "B"), ("+++\na = 1\n+++\nB", "toml", "a = 1", "B"), ("", None, None, ""), ("plain", None, None, "plain"),
]


def test_split(spark):
    d = spark.createDataFrame([(i, c[0]) for i, c in enumerate(SPLITS)], "i int, content string").select("i", fm.split(F.col("content")).alias("s"))
    for r in d.collect():
        assert (r.s.form, r.s.raw, r.s.body) == SPLITS[r.i][1:]


def test_values():
    assert values.read_yaml("a: yes\nb: 1_000\nc: 2020-01-01\nd: ~\ne: 1.0\nf: true") == {"a": "yes", "b": "1_000", "c": "2020-01-01", "d": None, "e": 1, "f": True}
    assert values.read_yaml("  \n") == {}
    for text, code in (("- a", "root-not-mapping"), ("1: a", "non-string-key"), ("a: [", "invalid-yaml")):
        with pytest.raises(values.FrontmatterError) as e:
            values.read_yaml(text)
        assert e.value.code == code
    with pytest.raises(values.FrontmatterError):
        values.write_toml({"a": {"b": None}})
    many = {"title": "x"} | {f"key{i}": str(i) for i in range(1000)}
    assert values.read_yaml(values.write_yaml(many)) == many
    assert values.read_toml("d = 2020-01-02\nt = 2020-01-02T03:04:05Z") == {"d": "2020-01-02", "t": "2020-01-02T03:04:05Z"}


leaves = st.none() | st.booleans() | st.integers(-(2**50), 2**50) | st.text(st.characters(blacklist_categories=("Cs", "Cc"), blacklist_characters="\u0085  ﻿"), max_size=12)
trees = st.recursive(leaves, lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(st.characters(whitelist_categories=("Ll", "Lu")), min_size=1, max_size=6), c, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(st.characters(whitelist_categories=("Ll", "Lu")), min_size=1, max_size=6), trees, max_size=4))
def test_yaml_round_trip(mapping):
    assert values.read_yaml(values.write_yaml(mapping)) == mapping


line = st.from_regex(r"\A(?:[a-c]{1,2}:(?: [a-cn0-9:# ./_-]{0,6})?|(?:  )?- [a-cn0-9:# ./_-]{0,6}|k: (?:true|null|Null|0x1|007|12|2020-01-02|1.5|1e3|no|\\~))\Z")


@settings(max_examples=600, deadline=None)
@given(st.lists(line, min_size=1, max_size=5))
def test_simple_yaml_is_yaml(lines):
    import yaml

    text = "\n".join(lines)
    simple = values._simple_yaml(text)
    if simple is not None:
        assert values.plain(yaml.load(text, values.Loader)) == simple
    assert values._simple_yaml("id: 7\nstatus: F\ndate: 2020-01-02\ntags:\n  - f\n  - 3-medium") is not None


def test_wrapped_blocks():
    text = "import a\n/*\n---\ntitle: x\n---\n*/\ncode\n/*\n+++\nb = 1\n+++\n*/"
    found = fm.wrapped_blocks(text, "/*", "*/")
    assert [(x[0], x[1], x[4]) for x in found] == [("yaml", "title: x\n", 2), ("toml", "b = 1\n", 8)]
    assert text[found[0][2] : found[0][3]].startswith("/*\n---") and text[found[0][2] : found[0][3]].endswith("---\n*/")
    assert fm.wrapped_blocks("/*\n---\na: 1\n*/", "/*", "*/") == []


def test_mutations(spark):
    d = fm.with_frontmatter(spark.createDataFrame([("a.md", "---\nb: 1\na: [x, y, x]\n---\nText\n"), ("b.md", "Only text")], "path string, content string"))
    e = F.col("fm.entries")
    text = lambda entries: {r.path: r.content for r in collection.rewrite(d, entries).collect()}
    assert text(collection.set_key(e, "c", "v")) == {"a.md": "---\nb: 1\na:\n  - x\n  - y\n  - x\nc: v\n---\nText\n", "b.md": "---\nc: v\n---\nOnly text"}
    assert text(collection.sort_keys(e))["a.md"].startswith("---\na:\n")
    assert text(collection.remove_key(collection.remove_key(e, "a"), "b"))["a.md"] == "Text\n"
    removed, error = collection.edit_array(e, "a", "x", "remove")
    assert text(removed)["a.md"] == "---\nb: 1\na:\n  - y\n  - x\n---\nText\n"
    assert [r[0] for r in d.orderBy("path").select(error).collect()] == [None, "key-not-found"]
    renamed, error = collection.rename_key(e, "b", "a")
    assert [r[0] for r in d.orderBy("path").select(error).collect()] == ["key-exists", "key-not-found"]
    assert text(collection.touch(e, ["b", "n"]))["b.md"] == "---\nb: null\nn: null\n---\nOnly text"


def test_unique_status(spark):
    d = fm.with_frontmatter(spark.createDataFrame([("a", "---\nx: 1\n---\n"), ("b", "---\nx: '1'\n---\n"), ("c", "---\nx: null\n---\n"), ("d", "text"), ("e", "---\nx: [1]\n---\n"), ("f", "+++\nx = 1\n+++\n"), ("g", "---\nx: 1\n---\n"), ("h", "---\nx: [\n---\n")], "path string, content string"))
    found = collection.scalars(d, "x")
    assert {r.path: (r.status, r.vtype, r.v) for r in found.collect()} == {"a": ("value", "number", "1"), "b": ("value", "string", "1"), "c": ("null", None, None), "d": ("missing", None, None), "e": ("error", None, None), "f": ("error", None, None), "g": ("value", "number", "1"), "h": ("error", None, None)}
    assert [(r.vtype, r.v, r.n, r.paths) for r in collection.duplicates(found).collect()] == [("number", "1", 2, ["a", "g"])]


def test_paging():
    token = collection.token({"r": "a"}, "k")
    assert collection.read_token(token, {"r": "a"}) == "k"
    for bad, q in ((token, {"r": "b"}), ("xx", {"r": "a"})):
        with pytest.raises(ValueError):
            collection.read_token(bad, q)


def test_hints(spark):
    c = f'---\n{fm.SYSTEM_KEY}:\n  typeHints: [book, {{name: note, version: "1"}}, 5, book]\ntitle: T\n---\n'
    d = fm.with_frontmatter(spark.createDataFrame([("a", c)], "path string, content string"))
    r = d.select(fm.type_hints(F.col("fm.json")).alias("h"), F.transform(fm.user_entries(F.col("fm.entries")), lambda e: e["key"]).alias("k")).first()
    assert [(h.name, h.version) for h in r.h][:2] == [("book", None), ("note", "1")]
    assert r.k == ["title"]
    assert json.loads(d.select("fm.json").first()[0])["title"] == "T"
