from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marklake.functions import body as bodies
from marklake.functions import markdown as M
from marklake.operators import links


def heads(text):
    return [(h["level"], h["text"], h["line"], h["parent_idx"], h["end_line"]) for h in M.headings(text)]


def test_headings():
    assert heads("# A *b* `c`\n\n```\n# no\n```\n> # q\n\n- # item\n  more\n\nSet\n===\n\n## B [x](u) ![i](j) #\n\n    # code\n") == [(1, "A b c", 1, None, 10), (1, "Set", 11, None, 17), (2, "B x", 14, 2, 17)]
    assert heads("#no\n####### seven\n\\# esc\n#\ttab") == [(1, "tab", 4, None, 4)]
    assert heads("<!--\n# no\n-->\n# yes") == [(1, "yes", 4, None, 4)]
    assert heads("para\n---\n\n---\n") == [(2, "para", 1, None, 5)]
    assert heads("") == []


def test_slugs(spark):
    d = spark.createDataFrame([(["a", "a", "a-1", "!!!", "Ünï Çode_x", "- b -"],)], "t array<string>")
    assert d.select(bodies.slugs(F.col("t"))).first()[0] == ["a", "a-1", "a-1-1", "section", "ünï-çode_x", "b"]


BODY = "# T\n\n## A\n\na\n\n## B\n\nb\n\n### B1\n\n## C\n\nc\n"


def one(spark, column, body=BODY):
    d = spark.createDataFrame([(body,)], "body string").withColumn("headings", bodies.headings(F.col("body")))
    return d.select(column).first()[0]


def test_moves(spark):
    H, B = F.col("headings"), F.col("body")
    moved = one(spark, bodies.move_section(B, H, bodies.find(H, "A"), by=1))
    assert moved.body == "# T\n\n## B\n\nb\n\n### B1\n\n## A\n\na\n\n## C\n\nc\n" and moved.error is None
    back = one(spark, bodies.move_section(B, H, bodies.find(H, "A"), by=-1), moved.body)
    assert back.body == BODY
    assert one(spark, bodies.move_section(B, H, bodies.find(H, "A"), by=-1)).error == "target-out-of-range"
    assert one(spark, bodies.move_section(B, H, bodies.find(H, "T"), by=1)).error == "no-siblings"
    assert one(spark, bodies.move_section(B, H, bodies.find(H, "nope"), by=1)).error == "section-not-found"
    assert one(spark, bodies.move_section(B, H, bodies.find(H, "C"), to=1)).body.startswith("# T\n\n## C\n\nc\n")


def test_levels(spark):
    H, B = F.col("headings"), F.col("body")
    down = one(spark, bodies.adjust_level(B, H, bodies.find(H, "B"), 1))
    assert "### B\n" in down.body and "#### B1\n" in down.body and not down.clamped
    assert one(spark, bodies.adjust_level(B, H, bodies.find(H, "B"), -1), down.body).body == BODY
    assert one(spark, bodies.adjust_level(B, H, bodies.find(H, "T"), -1, children=False)).clamped
    assert one(spark, bodies.adjust_level(B, H, bodies.find(H, "x"), 1)).error == "heading-not-found"
    assert one(spark, bodies.insert_section(B, bodies.find(H, "B1"), "N", "# a\n## b\n### c\n#### d")).error == "heading-level-out-of-range"


def test_line_range(spark):
    assert one(spark, bodies.line_range(F.col("body"), 2, 99), "a\nb\nc") == "b\nc"
    assert one(spark, bodies.line_range(F.col("body"), 4), "a\nb\nc") is None


def test_toc():
    e = [{"level": 2, "text": "A<&", "slug": "a"}, {"level": 4, "text": "B", "slug": "b"}, {"level": 3, "text": "C", "slug": "c"}, {"level": 1, "text": "D", "slug": None}]
    assert M.render_toc(e, "md-bullet-links") == "- [A<&](#a)\n  - [B](#b)\n  - [C](#c)\n- D"
    assert M.render_toc(e, "tree") == "├── A<&\n│   ├── B\n│   └── C\n└── D"
    assert "&lt;&amp;" in M.render_toc(e, "html")
    with pytest.raises(ValueError):
        bodies.toc(F.lit(None), 3, 2)


def test_text():
    t = "# T\n\nHi **b** [l](u) ![alt](x)\nnext\n\n- a\n- b\n  - c\n\n> q\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n<div>\nraw\n</div>\n\n---\n\n```\ncode\n```\n"
    assert M.plain_text(t) == "T\n\nHi b l alt\nnext\n\n  a\n  b\n    c\n\n  q\n\ncode"
    assert M.plain_text(t, M.SINGLE_LINE) == "T Hi b l alt next a b c q code"
    assert M.plain_text(t, M.PlainText(code=False, alt=False)).endswith("  q")
    assert M.align_tables("| a | bb |\n|---|:-:|\n| 1 \\| x | 2 |") == "| a      | bb  |\n| ------ | :-: |\n| 1 \\| x | 2   |"
    assert M.align_tables("a | b\nno rule | x") == "a | b\nno rule | x"
    assert M.bullets("* a\n  + b\n> * c\n***\n```\n* x\n```") == "- a\n  - b\n> - c\n***\n```\n* x\n```"
    assert M.italics("_a_ `_c_` **d** x_y_z", "*") == "*a* `_c_` **d** x_y_z"


@settings(max_examples=100, deadline=None)
@given(st.text("#ab \n*_-`>|[](){}.1", max_size=80))
def test_scanner_is_total(text):
    for h in M.headings(text):
        assert 1 <= h["line"] <= h["end_line"] <= text.count("\n") + 1
    M.plain_text(text)
    M.formatted(text)


def test_links(spark):
    text = "![[img.png]] [[P#H|t]] [[P#^b]] [[]] [[a[[b]] [[x\\|y|z]] `[[code]]` [[open"
    d = spark.createDataFrame([(text,)], "b string").select(links.parse(F.col("b")).alias("w"))
    got = [(w.target, w.display, w.anchor_kind, w.anchor, w.embed) for w in d.first().w]
    assert got == [("img.png", None, None, None, True), ("P", "t", "heading", "H", False), ("P", None, "block", "b", False), ("b", None, None, None, False), ("x|y", "z", None, None, False), ("code", None, None, None, False)]


def test_resolution(spark):
    files = {"a/Note.md": "[[b]] [[sub/deep]] [[../root]] [[x.png]] [[gone]] [[#self]] [[Other/b]]", "c/b.md": "", "a/sub/deep.md": "", "root.md": "", "img/x.png": "", "d/dup.md": "", "e/Dup.md": "[[dup]]", ".hidden/b.md": ""}
    v = spark.createDataFrame(list(files.items()), "path string, content string")
    r = {(x.source_path, x.target): (x.status, x.resolved_path, x.candidates) for x in links.resolve(links.edges(v), links.index(v)).collect()}
    a = "a/Note.md"
    assert r[a, "b"] == ("resolved", "c/b.md", None) and r[a, "sub/deep"][1] == "a/sub/deep.md" and r[a, "../root"][1] == "root.md" and r[a, "x.png"][1] == "img/x.png"
    assert r[a, "gone"][0] == "unresolved" and r[a, ""][1] == a and r[a, "Other/b"][1] == "c/b.md"
    assert r["e/Dup.md", "dup"] == ("ambiguous", None, ["d/dup.md", "e/Dup.md"])


def test_links_in_frontmatter_and_long_ones(spark):
    from marklake.operators import links

    long = "[[" + "a" * 500_000 + "|" + "b\\|" * 100_000 + "]]"
    rows = [("a.md", '---\na: "[[x]]"\nup: ["[[x]]", "[[z|y]] \\"q\\" [[w]]"]\n---\nsee [[body]]\n'), ("b.md", long), ("c.md", "---\nt: '" + "x" * 300_000 + " [[k]]'\n---\n")]
    got = {}
    for r in links.edges(spark.createDataFrame(rows, "path string, content string")).collect():
        got.setdefault(r.source_path, []).append((r.pos, r.target, r.display))
    assert sorted(got["a.md"]) == [(0, "x", None), (1, "x", None), (2, "z", "y"), (3, "w", None), (4, "body", None)]
    assert [(p, len(t), len(d)) for p, t, d in got["b.md"]] == [(0, 500_000, 300_000)] and got["c.md"] == [(0, "k", None)]


def test_ambiguous_targets_list_some_and_count_all(spark, monkeypatch):
    from marklake.operators import links

    rows = [(f"d{i}/readme.md", "x [[readme]] [[d1/readme]]" if i == 3 else "x") for i in range(9)]
    d = spark.createDataFrame(rows, "path string, content string")
    monkeypatch.setattr(links, "LISTED", 4)
    files, edges = links.index(d), links.edges(d)
    got = {r.target: r for r in links.resolve(edges, files).collect()}
    assert got["readme"].status == "ambiguous" and got["readme"].candidates == [f"d{i}/readme.md" for i in range(4)]
    assert links.candidates(edges, files).filter("target = 'readme'").count() == 9
