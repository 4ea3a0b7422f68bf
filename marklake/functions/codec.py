"""Typed rows to records and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.functions import frontmatter as fm


def encode(rows: DataFrame, body: str | None = None, form: str = "yaml", keep_body: bool = False) -> Column:
    """struct(content, error) of a row: its columns sorted by name, recursively, as frontmatter, and one column as the body.

    keep_body leaves the body's column in the frontmatter, too. TOML can't hold nulls: that is an error of the row.
    """
    names = sorted(c for c in rows.columns if c != body or keep_body)
    keys = F.array(*map(F.lit, names))
    # A one-element array writes any kind of value as JSON; its brackets go.
    plain = [F.coalesce(F.regexp_replace(F.to_json(F.array(F.col(c)), {"ignoreNullFields": "false"}), r"^\[|\]$", ""), F.lit("null")) for c in names]
    text = fm.serialize(keys, F.array(*plain), F.lit(form))
    mark = "+++\n" if form == "toml" else "---\n"
    tail = F.coalesce(F.col(body), F.lit("")) if body else F.lit("")
    return F.struct(F.concat(F.lit(mark), text["text"], F.lit(mark), tail).alias("content"), text["error"].alias("error"))


def decode(records: DataFrame, schema: str, body: str | None = None) -> DataFrame:
    """path, value (of the schema) and error: missing-frontmatter, invalid-frontmatter or type-mismatch.

    body names the member that takes the text behind the frontmatter.
    """
    d = fm.with_frontmatter(records)
    bad = "_mismatch"
    value = F.from_json("fm.json", f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    d = d.withColumn("_v", value)
    error = F.when(~F.col("has_frontmatter"), "missing-frontmatter").when(F.col("fm.error").isNotNull(), "invalid-frontmatter").when(F.col(f"_v.{bad}").isNotNull(), "type-mismatch")
    clean = F.col("_v").dropFields(bad)
    clean = clean.withField(body, F.col("body")) if body else clean
    return d.select("path", F.when(error.isNull(), clean).alias("value"), error.alias("error"))
