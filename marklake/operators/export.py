"""Exports: CSV, dumps in several formats, file metadata (IO12-IO19)."""

from __future__ import annotations

import json
import plistlib
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.functions import frontmatter as fm
from marklake.functions import values

METADATA = ("$absPath", "$fileName", "$relPath")


def key_union(analyzed: DataFrame) -> list[str]:
    """All keys of the records, sorted (A7). The distinct keys of a collection are its columns, so they fit the driver."""
    rows = analyzed.select(F.explode("fm.entries").alias("e")).select("e.key").distinct().collect()
    return sorted(r.key for r in rows)


def _metadata(name: str, root: str) -> Column:
    return {"$fileName": F.element_at(F.split("path", "/"), -1), "$relPath": F.col("path"), "$absPath": F.concat(F.lit(root.rstrip("/") + "/"), F.col("path"))}[name]


def table(analyzed: DataFrame, metadata: tuple[str, ...] = ("$relPath",), body: bool = True, root: str = "/", keys: list[str] | None = None) -> DataFrame:
    """A wide table: metadata columns by name, $body, then all keys; missing and null are empty, nested values JSON (IO12, IO13)."""
    keys = key_union(analyzed) if keys is None else keys
    d = analyzed.withColumn("_m", F.map_from_entries(F.transform("fm.entries", lambda e: F.struct(e["key"], F.when(e["kind"] == "null", "").otherwise(F.coalesce(e["text"], e["json"]))))))
    columns = [_metadata(n, root).alias(n) for n in sorted(metadata)] + ([F.col("body").alias("$body")] if body else [])
    return d.select(*columns, *(F.coalesce(F.try_element_at("_m", F.lit(k)), F.lit("")).alias(k) for k in keys))


def _quoted(c: Column) -> Column:
    return F.when(c.rlike(r'[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_lines(wide: DataFrame) -> tuple[str, DataFrame]:
    """Header, and one line for each row: fields with a comma, quote or line feed are quoted (IO12)."""
    plain = [x if not any(c in x for c in ',"\n') else '"' + x.replace('"', '""') + '"' for x in wide.columns]
    return ",".join(plain), wide.select(F.concat_ws(",", *(_quoted(F.col(f"`{c}`")) for c in wide.columns)).alias("line"))


def write_csv(wide: DataFrame, path: str) -> None:
    """Part files with a header each (IO14)."""
    wide.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def dump(analyzed: DataFrame, form: str = "json", delimiters: bool = False) -> DataFrame:
    """path and the frontmatter as json, yaml, toml or raw text."""
    e = F.col("fm.entries")
    mark = F.when(F.col("form") == "toml", "+++\n").otherwise("---\n")
    if form == "json":
        text = F.coalesce("fm.json", F.lit("{}"))
    elif form == "raw":
        text = F.coalesce("raw", F.lit(""))
    else:
        text = fm.serialize(F.transform(e, lambda x: x["key"]), F.transform(e, lambda x: x["json"]), F.lit(form))["text"]
    return analyzed.select("path", (F.concat(mark, text, mark) if delimiters and form in ("yaml", "toml") else text).alias("text"))


def format_any(value: Any, form: str) -> str:
    """A value as json, json-pretty, yaml, toml, plist or raw (IO15, IO17)."""
    value = values.plain(value)
    if form in ("json", "json-pretty"):
        return json.dumps(value, ensure_ascii=False, indent=2 if form == "json-pretty" else None, sort_keys=True)
    if form == "yaml":
        import yaml

        return yaml.dump(value, Dumper=values.Dumper, sort_keys=False, allow_unicode=True)
    if form == "toml":
        return values.write_toml(value)
    if form == "plist":
        return plistlib.dumps(value).decode()
    if form == "raw":
        return "\n".join(map(str, value)) if isinstance(value, list) else str(value)
    raise ValueError(f"unknown format {form}")


def read_any(text: str, form: str) -> dict:
    """A mapping from json or plist (IO16)."""
    value = json.loads(text) if form == "json" else plistlib.loads(text.encode())
    if not isinstance(value, dict):
        raise values.FrontmatterError("root-not-mapping", f"{form} is not a mapping")
    return values.plain(value)


def permissions(mode: Column) -> Column:
    """rwxr-x--- of the nine low bits (IO18)."""
    return F.concat(*(F.when(mode.bitwiseAND(F.lit(1 << (8 - i))) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)))


def markdown_table(wide: DataFrame) -> DataFrame:
    """Rows as lines of a Markdown table, without its two header lines (IO19)."""
    cells = [F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in wide.columns]
    return wide.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
