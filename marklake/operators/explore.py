"""Exploring documents: sections as rows, targets, suggestions and renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.functions import body as bodies
from marklake.functions import predicates


def sections(analyzed: DataFrame) -> DataFrame:
    """A row for every section: path, id, level, title, full and body line ranges, title path, words, lines, children.

    analyzed has path, content, body and headings; line numbers are those of the content.
    """
    d = analyzed.withColumn("_before", F.size(F.split("content", "\n", -1)) - F.size(F.split("body", "\n", -1))).withColumn("_lines", bodies.lines(F.col("body")))
    d = d.select("path", "_before", "_lines", "headings", F.explode("headings").alias("h"))
    text = F.array_join(F.slice("_lines", F.col("h.line"), F.col("h.end_line") - F.col("h.line") + 1), "\n")
    children = F.size(F.filter("headings", lambda x: x["parent_idx"] == F.col("h.idx")))
    return d.select(
        "path", F.col("h.idx").alias("id"), F.col("h.level").alias("level"), F.col("h.text").alias("title"), (F.col("h.line") + F.col("_before")).alias("start_line"), (F.col("h.end_line") + F.col("_before")).alias("end_line"),
        (F.col("h.line") + F.col("_before") + F.when(F.col("h.setext"), 2).otherwise(1)).alias("body_start"), F.col("h.path").alias("title_path"), predicates.n_words_explored(text).alias("n_words"), (F.col("h.end_line") - F.col("h.line") + 1).alias("n_lines"), children.alias("n_children"),
    )


def preamble(analyzed: DataFrame) -> DataFrame:
    """path and the text in front of the first heading."""
    first = F.coalesce(F.get("headings", F.lit(0))["line"], F.size(bodies.lines(F.col("body"))) + 1)
    return analyzed.select("path", F.array_join(F.slice(bodies.lines(F.col("body")), F.lit(1), first - 1), "\n").alias("preamble"))


def target(found: DataFrame, title: str | None = None, title_path: list[str] | None = None, line: int | None = None, contains: str | None = None, recursive: bool = False) -> DataFrame:
    """Sections that a target names; recursive adds all that lie below them."""
    hit: Column = F.lit(False)
    if title is not None:
        hit = F.col("title") == title
    elif title_path is not None:
        hit = F.col("title_path") == F.array(*map(F.lit, title_path))
    elif line is not None:
        hit = (F.col("start_line") <= line) & (F.col("end_line") >= line)
    elif contains is not None:
        hit = F.lower("title").contains(contains.lower())
    chosen = found.filter(hit)
    if not recursive:
        return chosen
    tops = chosen.select(F.col("path").alias("_p"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    return found.join(tops, (F.col("path") == F.col("_p")) & F.col("start_line").between(F.col("_s"), F.col("_e"))).drop("_p", "_s", "_e").distinct()


def ancestors(found: DataFrame, title_path: list[str]) -> DataFrame:
    """Sections above a title path."""
    return found.filter(F.col("title_path").isin([F.array(*map(F.lit, title_path[:k])) for k in range(1, len(title_path))])) if len(title_path) > 1 else found.limit(0)


def suggest(found: DataFrame, text: str) -> DataFrame:
    """title and rank of what a missing title may have meant: exact, prefix, part, without case."""
    low = F.lower("title")
    rank = F.when(low == text.lower(), 0).when(low.startswith(text.lower()), 1).when(low.contains(text.lower()), 2)
    return found.select("title", rank.alias("rank")).filter("rank is not null").distinct().orderBy("rank", "title")


def render(rows: list[dict], form: str = "tree", stubs: bool = True) -> str:
    """Sections of one document as terminal, markdown, markdown-no-stubs or tree text."""
    out = []
    for r in rows:
        depth = len(r["title_path"]) - 1
        size = f"{r['n_words']} words, lines {r['start_line']}-{r['end_line']}"
        if form == "tree":
            out.append("  " * depth + r["title"])
        elif form == "terminal":
            out.append("  " * depth + f"{r['title']}  ({size})")
        else:
            out.append("#" * r["level"] + " " + r["title"])
            if stubs and form == "markdown":
                out += ["", f"_{size}_", ""]
    return "\n".join(out)
