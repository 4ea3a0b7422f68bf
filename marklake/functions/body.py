"""Bodies as Columns: headings by one Arrow UDF, and everything on sections over arrays of headings and lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marklake import schemas
from marklake.functions import markdown
from marklake.functions.arrow import lazy

_HEADING = pa.struct([("idx", pa.int32()), ("level", pa.int32()), ("text", pa.string()), ("line", pa.int32()), ("parent_idx", pa.int32()), ("end_line", pa.int32()), ("direct_empty", pa.bool_()), ("setext", pa.bool_()), ("path", pa.list_(pa.string()))])


@lazy(schemas.HEADINGS, deterministic=False)
def headings(body: pa.Array) -> pa.Array:
    """Top-level headings of a body; one scan, evaluated once. Stage B of analysis."""
    return pa.array([markdown.headings(b) if b is not None else [] for b in body.to_pylist()], pa.list_(_HEADING))


@lazy("string")
def plain_text(body: pa.Array, gap: pa.Array, indent: pa.Array, code: pa.Array, alt: pa.Array, soft: pa.Array) -> pa.Array:
    """Body without markup."""
    rows = zip(*(c.to_pylist() for c in (body, gap, indent, code, alt, soft)), strict=True)
    return pa.array([None if r[0] is None else markdown.plain_text(r[0], markdown.PlainText(*r[1:])) for r in rows], pa.string())


def to_plain_text(body: Column, options: markdown.PlainText = markdown.DEFAULT) -> Column:
    return plain_text(body, *(F.lit(x) for x in (options.gap, options.indent, options.code, options.alt, options.soft)))


@lazy("string")
def _formatted(body: pa.Array, bullet: pa.Array, italic: pa.Array, tables: pa.Array, widest: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in (body, bullet, italic, tables, widest)), strict=True)
    return pa.array([None if r[0] is None else markdown.formatted(*r) for r in rows], pa.string())


def formatted(body: Column, bullet: str | None = "-", italic: str | None = "*", tables: bool = True, widest: int = 80) -> Column:
    """Bullets, emphasis and tables made uniform (T4-T7); None leaves a part as it is."""
    return _formatted(body, F.lit(bullet).cast("string"), F.lit(italic).cast("string"), F.lit(tables), F.lit(widest))


def slug(text: Column) -> Column:
    """Anchor of a heading before it is made unique."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), " ", "-"), r"[^\p{L}\p{N}_-]", "")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.when(s == "", "section").otherwise(s)


def slugs(texts: Column) -> Column:
    """Unique anchors of an array of headings, in order: -1, -2 and so on for taken ones."""

    def add(taken: Column, text: Column) -> Column:
        def pick(s: Column) -> Column:
            free = F.filter(F.sequence(F.lit(1), F.size(taken) + 1), lambda k: ~F.array_contains(taken, F.concat_ws("-", s, k)))
            return F.when(F.array_contains(taken, s), F.concat_ws("-", s, F.get(free, F.lit(0)))).otherwise(s)

        return F.concat(taken, F.transform(F.array(slug(text)), pick))

    return F.aggregate(texts, F.array().cast("array<string>"), add)


def toc(heads: Column, low: int = 1, high: int = 6) -> Column:
    """Entries (idx, level, text, slug, line, parent) of a table of contents; parent counts among the entries."""
    if not 1 <= low <= high <= 6:
        raise ValueError("levels must be between 1 and 6, lowest first")
    kept = F.filter(heads, lambda h: h["level"].between(low, high))

    def over(k: Column) -> Column:
        names = slugs(F.transform(k, lambda h: h["text"]))
        parent = lambda i, h: F.array_max(F.transform(F.filter(F.sequence(F.lit(0), F.size(k) - 1), lambda j: (j < i) & (F.get(k, j)["level"] < h["level"])), lambda j: j + 1))
        return F.transform(F.array(names), lambda s: F.transform(k, lambda h, i: F.struct(h["idx"].alias("idx"), h["level"].alias("level"), h["text"].alias("text"), F.get(s, i).alias("slug"), h["line"].alias("line"), parent(i, h).alias("parent"))))[0]

    return F.element_at(F.transform(F.array(kept), over), 1)


@lazy("string")
def _rendered(entries: pa.Array, form: pa.Array) -> pa.Array:
    return pa.array([None if e is None else markdown.render_toc(e, f) for e, f in zip(entries.to_pylist(), form.to_pylist(), strict=True)], pa.string())


def render_toc(entries: Column, form: str) -> Column:
    """A table of contents in one of seven forms (S5); the flat forms stay Columns."""
    if form == "md-only-headings":
        return F.array_join(F.transform(entries, lambda e: F.concat(F.repeat(F.lit("#"), e["level"]), F.lit(" "), e["text"])), "\n")
    return _rendered(entries, F.lit(form))


def lines(body: Column) -> Column:
    return F.split(body, "\n", -1)


def line_range(text: Column, start: int, end: int | None = None) -> Column:
    """Lines start to end, counted from 1, the end cut to the text; null if start lies behind it."""
    ls = lines(text)
    size = F.size(ls)
    stop = size if end is None else F.least(F.lit(end), size)
    return F.when((size >= start) & (F.lit(start) >= 1), F.array_join(F.slice(ls, F.lit(start), stop - start + 1), "\n"))


def line_of(text: Column, at: Column) -> Column:
    """Line number, from 1, of a position counted from 0."""
    return F.size(F.split(F.substring(text, F.lit(1), at), "\n", -1))


def find(heads: Column, name: str | None = None, index: int | None = None, case_sensitive: bool = False) -> Column:
    """The heading with a 1-based index, or the first of a name; null if there is none."""
    if index is not None:
        return F.get(F.filter(heads, lambda h: h["idx"] == index), F.lit(0))
    same = (lambda h: h["text"] == name) if case_sensitive else (lambda h: F.lower(h["text"]) == name.lower())
    return F.get(F.filter(heads, same), F.lit(0))


def _cut(ls: Column, start: Column, end: Column) -> Column:
    """Lines start to end, both included, counted from 1; none if end lies before start."""
    return F.slice(ls, start, F.greatest(end - start + 1, F.lit(0)))


def section(body: Column, h: Column) -> Column:
    """Text of a section, its heading included."""
    return F.array_join(_cut(lines(body), h["line"], h["end_line"]), "\n")


def remove_section(body: Column, h: Column) -> Column:
    """Body without a section."""
    ls = lines(body)
    return F.array_join(F.concat(_cut(ls, F.lit(1), h["line"] - 1), _cut(ls, h["end_line"] + 1, F.size(ls))), "\n")


def replace_section(body: Column, h: Column, content: str) -> Column:
    """Body with a section's text replaced; its heading stays."""
    ls = lines(body)
    head = h["line"] + F.when(h["setext"], 1).otherwise(0)
    new = F.array(*(F.lit(x) for x in content.strip("\n").split("\n")))
    return F.array_join(F.concat(_cut(ls, F.lit(1), head), F.array(F.lit("")), new, F.when(h["end_line"] < F.size(ls), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), _cut(ls, h["end_line"] + 1, F.size(ls))), "\n")


def shifted(content: str, level: int) -> str | None:
    """Content whose top heading stands at a level; None if a heading would be deeper than six."""
    heads = markdown.headings(content)
    if not heads:
        return content
    by = level - min(h["level"] for h in heads)
    if max(h["level"] for h in heads) + by > 6:
        return None
    out = content.split("\n")
    for h in heads:
        out[h["line"] - 1] = "#" * (h["level"] + by) + " " + h["text"]
    return "\n".join(out)


def insert_section(body: Column, h: Column, name: str, content: str, before: bool = False, level: int | None = None) -> Column:
    """struct(body, error) with a new section before or after a section, at its level unless told otherwise."""
    new, deep = None, None
    for at in range(1, 7) if level is None else [level]:
        text = shifted(content.strip("\n"), at + 1)
        block = None if text is None else F.array(*(F.lit(x) for x in [("#" * at) + " " + name, "", *text.split("\n"), ""]))
        block = F.lit(None).cast("array<string>") if block is None else block
        here = F.lit(True) if level is not None else h["level"] == at
        new = F.when(here, block) if new is None else new.when(here, block)
    ls = lines(body)
    cut = h["line"] - 1 if before else h["end_line"]
    joined = F.array_join(F.concat(_cut(ls, F.lit(1), cut), new, _cut(ls, cut + 1, F.size(ls))), "\n")
    deep = F.when(h.isNull(), "section-not-found").when(joined.isNull(), "heading-level-out-of-range")
    return F.struct(joined.alias("body"), deep.alias("error"))


def siblings(heads: Column, h: Column) -> Column:
    """Headings of the same level under the same parent, in order."""
    return F.filter(heads, lambda x: (x["level"] == h["level"]) & x["parent_idx"].eqNullSafe(h["parent_idx"]))


def move_section(body: Column, heads: Column, h: Column, by: int | None = None, to: int | None = None) -> Column:
    """struct(body, error): a section moved among its siblings by a number of places, or to a 1-based place.

    Sections trade places; what stands between them stays.
    """

    def over(sib: Column) -> Column:
        at = F.array_position(F.transform(sib, lambda s: s["idx"]), h["idx"]).cast("int")
        target = at + by if to is None else F.lit(to)
        rest = F.filter(sib, lambda s: s["idx"] != h["idx"])
        order = F.concat(F.slice(rest, F.lit(1), F.greatest(target - 1, F.lit(0))), F.array(h), F.slice(rest, F.greatest(target, F.lit(1)), F.size(sib)))
        ls = lines(body)
        start = F.struct(F.lit(1).alias("line"), F.array().cast("array<string>").alias("out"))
        step = lambda a, p: F.struct((p["slot"]["end_line"] + 1).alias("line"), F.concat(a["out"], _cut(ls, a["line"], p["slot"]["line"] - 1), _cut(ls, p["new"]["line"], p["new"]["end_line"])).alias("out"))
        moved = F.aggregate(F.arrays_zip(sib.alias("slot"), order.alias("new")), start, step, lambda a: F.array_join(F.concat(a["out"], _cut(ls, a["line"], F.size(ls))), "\n"))
        error = F.when(h.isNull(), "section-not-found").when(F.size(sib) < 2, "no-siblings").when((target < 1) | (target > F.size(sib)), "target-out-of-range").when(target == at, "already-there")
        return F.struct(F.when(error.isNull(), moved).alias("body"), error.alias("error"))

    return F.element_at(F.transform(F.array(siblings(heads, h)), over), 1)


def scope(heads: Column, h: Column) -> Column:
    """Headings below a heading: the following deeper ones."""
    return F.filter(heads, lambda x: (x["idx"] > h["idx"]) & (x["line"] <= h["end_line"]))


def adjust_level(body: Column, heads: Column, h: Column, by: int, children: bool = True) -> Column:
    """struct(body, clamped, error): heading levels moved by `by` within one to six."""
    group = F.concat(F.array(h), scope(heads, h)) if children else F.array(h)
    level = lambda x: F.greatest(F.lit(1), F.least(F.lit(6), x["level"] + by))

    def line(text: Column, i: Column, g: Column) -> Column:
        hit = F.get(F.filter(g, lambda x: x["line"] == i + 1), F.lit(0))
        written = F.concat(F.regexp_extract(text, r"^(\s*)", 1), F.repeat(F.lit("#"), level(hit)), F.lit(" "), F.regexp_extract(text, r"^\s*#*[ ]*(.*)$", 1))
        return F.when(hit.isNull(), text).otherwise(written)

    out = F.element_at(F.transform(F.array(group), lambda g: F.array_join(F.transform(lines(body), lambda t, i: line(t, i, g)), "\n")), 1)
    clamped = F.exists(group, lambda x: (x["level"] + by < 1) | (x["level"] + by > 6))
    return F.struct(F.when(h.isNotNull(), out).alias("body"), F.when(h.isNotNull(), clamped).alias("clamped"), F.when(h.isNull(), "heading-not-found").alias("error"))
