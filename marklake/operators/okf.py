"""Knowledge bundles: validation, analysis, type changes and a scaffold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.functions import frontmatter as fm
from marklake.operators import collection

# Reserved names and recommended fields.
RESERVED = ("index.md", "log.md")
RECOMMENDED = ("title", "description", "resource", "tags", "timestamp")
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2})$"


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def prepare(records: DataFrame) -> DataFrame:
    """Analyzed Markdown records of a bundle; only YAML blocks count as frontmatter."""
    d = fm.with_frontmatter(records.filter(fm.extension(F.col("path")).isin("md", "markdown")))
    return d.withColumns({"reserved": _name().isin(*RESERVED), "yaml_block": F.coalesce(F.col("form") == "yaml", F.lit(False))})


def issues(prepared: DataFrame) -> DataFrame:
    """path, location, message of every hard error (K1)."""
    t = fm.entry(F.col("fm.entries"), "type")
    concept = (
        F.when(~F.col("yaml_block"), F.when(F.col("content").startswith("---\n"), F.struct(F.lit("frontmatter").alias("location"), F.lit("frontmatter block is not closed with ---").alias("message"))).otherwise(F.struct(F.lit("frontmatter").alias("location"), F.lit("required by OKF v0.1 draft concept documents").alias("message"))))
        .when(F.col("fm.error").isNotNull(), F.struct(F.lit("frontmatter").alias("location"), F.lit("invalid YAML").alias("message")))
        .when(~fm.has(F.col("fm.entries"), "type"), F.struct(F.lit("frontmatter.type").alias("location"), F.lit('missing required field "type"').alias("message")))
        .when(t["kind"] != "string", F.struct(F.lit("frontmatter.type").alias("location"), F.lit("must be a string").alias("message")))
        .when(F.trim(F.regexp_replace(t["text"], r"\s+", " ")) == "", F.struct(F.lit("frontmatter.type").alias("location"), F.lit("must not be empty").alias("message")))
    )
    lines = F.transform(F.split("content", "\n", -1), lambda x, i: F.struct(F.concat(F.lit("line "), (i + 1).cast("string")).alias("location"), x.alias("message")))
    log = F.transform(F.filter(lines, lambda x: x["message"].startswith("## ") & ~F.trim(F.substring(x["message"], 4, 1 << 20)).rlike(r"^\d{4}-\d{2}-\d{2}$")), lambda x: F.struct(x["location"].alias("location"), F.lit('expected ISO date heading like "## 2026-06-20"').alias("message")))
    found = F.when(F.col("reserved"), F.when(_name() == "log.md", log)).otherwise(F.when(concept.isNotNull(), F.array(concept)))
    return prepared.select("path", F.explode(found).alias("i")).select("path", "i.location", "i.message")


def counts(prepared: DataFrame) -> DataFrame:
    """One row: scanned, concept, reserved, citations, empty bodies (A5)."""
    concept = ~F.col("reserved")
    readable = concept & F.col("yaml_block") & F.col("fm.error").isNull()
    return prepared.agg(F.count("*").alias("scanned"), F.count_if(concept).alias("concepts"), F.count_if("reserved").alias("reserved"), F.count_if(readable & F.col("body").contains("# Citations")).alias("citations"), F.count_if(readable & (F.trim(F.regexp_replace("body", r"\s+", " ")) == "")).alias("empty_bodies"))


def type_counts(prepared: DataFrame) -> DataFrame:
    """type, n of concepts with a usable type (A4)."""
    t = fm.entry(F.col("fm.entries"), "type")
    d = prepared.filter(~F.col("reserved") & F.col("yaml_block")).select(F.when(t["kind"] == "string", F.trim(t["text"])).alias("type"))
    return d.filter("type is not null and type <> ''").groupBy("type").agg(F.count("*").alias("n"))


def missing_fields(prepared: DataFrame) -> DataFrame:
    """path and recommended fields that are absent."""
    names = F.array_except(F.array(*map(F.lit, RECOMMENDED)), F.transform("fm.entries", lambda e: e["key"]))
    return prepared.filter(~F.col("reserved") & F.col("yaml_block") & F.col("fm.error").isNull()).select("path", names.alias("missing")).filter(F.size("missing") > 0)


def advisories(prepared: DataFrame) -> DataFrame:
    """path, location, message of advice; none of it fails a bundle (K2)."""
    d = prepared.filter(~F.col("reserved") & F.col("yaml_block") & F.col("fm.error").isNull())
    stamp = fm.entry(F.col("fm.entries"), "timestamp")
    missing = missing_fields(prepared).select("path", F.lit("frontmatter").alias("location"), F.concat(F.lit("missing recommended field(s): "), F.array_join("missing", ", ")).alias("message"))
    when = d.filter((stamp["kind"] == "string") & ~stamp["text"].rlike(ISO)).select("path", F.lit("frontmatter.timestamp").alias("location"), F.lit("optional field is not ISO 8601").alias("message"))
    empty = d.filter(F.trim(F.regexp_replace("body", r"\s+", " ")) == "").select("path", F.lit("body").alias("location"), F.lit("concept body is empty").alias("message"))
    root = prepared.agg(F.count_if(F.col("path") == "index.md").alias("n")).filter("n = 0").select(F.lit("index.md").alias("path"), F.lit("file").alias("location"), F.lit("root index.md is optional but recommended for progressive disclosure").alias("message"))
    return missing.unionByName(when).unionByName(empty).unionByName(root)


def set_type(prepared: DataFrame, value: str, only_with: tuple[str, str] | None = None) -> DataFrame:
    """path and new content with the type set, where an array holds an item if asked (K3)."""
    d = prepared.filter(~F.col("reserved") & F.col("fm.error").isNull())
    d = collection.array_contains(d, *only_with) if only_with else d
    return collection.rewrite(d, collection.set_key(F.col("fm.entries"), "type", value))


def scaffold(spark: SparkSession, name: str) -> DataFrame:
    """Records of a new bundle (K4)."""
    rows = [("index.md", f"# {name}\n\nStart here.\n"), ("log.md", f"# {name} log\n"), ("concepts/example.md", "---\ntype: concept\ntitle: Example\n---\n# Example\n")]
    return spark.createDataFrame(rows, "path string, content string")
