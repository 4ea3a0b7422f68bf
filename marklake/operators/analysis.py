"""The analyzed view of records (P10): one cheap stage for frontmatter, a second for structure only where it is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake import schemas
from marklake.functions import body as bodies
from marklake.functions import frontmatter as fm
from marklake.operators import links


def analyze(records: DataFrame, structure: bool = True, wikilinks: bool = False) -> DataFrame:
    """records (path, content, ...) with content_kind, form, raw, body, has_frontmatter, fm, user_entries, user_json,
    hints, parse_diagnostics, supports_structure, unavailable_ext, and headings and wikilinks if asked for.

    Filters on the records' own columns belong before this call: the stages are evaluated once and not pushed through.
    """
    kind = fm.content_kind(F.col("path")) if "path" in records.columns else F.lit("markdown")
    d = records.withColumn("content_kind", kind).withColumn("_s", fm.split(F.col("content")))
    wrapped = F.col("content_kind") == "wrapped"
    d = d.withColumn("_w", F.when(wrapped, fm.wrapped_split(F.col("content"), fm.syntax(F.col("path"))))) if "path" in records.columns else d.withColumn("_w", F.lit(None).cast("struct<form:string,raw:string,start:int,end:int,line:int,more:array<int>>"))
    plain = F.col("content_kind").isin("markdown", "plainText")
    d = d.withColumns({"form": F.when(plain, F.col("_s.form")).otherwise(F.col("_w.form")), "raw": F.when(plain, F.col("_s.raw")).otherwise(F.col("_w.raw")), "body": F.when(plain, F.col("_s.body")).otherwise(F.col("content")), "more_blocks": F.coalesce(F.col("_w.more"), F.array().cast("array<int>"))}).drop("_s", "_w")
    d = d.withColumn("has_frontmatter", F.col("raw").isNotNull()).withColumn("fm", fm.parse(F.col("raw"), F.col("form")))
    user = fm.user_entries(F.col("fm.entries"))
    # Keys as JSON strings: the array's brackets go.
    keyed = F.concat(F.lit("{"), F.array_join(F.transform(user, lambda e: F.concat(F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", ""), F.lit(":"), e["json"])), ","), F.lit("}"))
    bad = F.when(F.col("fm.error").isNotNull(), F.array(F.struct(F.concat(F.lit("record.frontmatter.invalid-"), F.coalesce("form", F.lit("yaml"))).alias("code"), F.lit("error").alias("severity"), F.lit("frontmatter").alias("domain"), F.lit(None).cast("string").alias("constraint_id"), F.lit("frontmatter").alias("location"), F.col("fm.error").alias("message"))))
    more = F.transform("more_blocks", lambda n: F.struct(F.lit("record.frontmatter.multiple-blocks").alias("code"), F.lit("warning").alias("severity"), F.lit("frontmatter").alias("domain"), F.lit(None).cast("string").alias("constraint_id"), F.concat(F.lit("line "), n.cast("string")).alias("location"), F.lit("another frontmatter block").alias("message")))
    none = F.array().cast(schemas.DIAGNOSTICS)
    d = d.withColumns({
        "user_entries": user, "user_json": F.when(F.col("fm.error").isNull() & F.col("has_frontmatter"), keyed), "hints": fm.type_hints(F.col("fm.json")), "parse_diagnostics": F.concat(F.coalesce(bad, none), F.coalesce(more, none)),
        "supports_structure": F.col("content_kind") == "markdown", "unavailable_ext": F.when(F.col("content_kind") == "unmapped", fm.extension(F.col("path")) if "path" in records.columns else F.lit(None)),
    })
    if structure:
        d = d.withColumn("headings", bodies.headings(F.when(F.col("supports_structure"), F.col("body"))))
    if wikilinks:
        d = d.withColumn("wikilinks", links.of_record(F.col("fm.json"), F.col("body")))
    return d
