"""Frontmatter of records as Columns: splitting (P1-P3, P11), parsing (P4, P5, P7, P9), rendering."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake import schemas
from marklake.functions import values
from marklake.functions.arrow import lazy

SPLIT = r"(?s)\A---\n(?:---|(.*?)\n---)(?:\r?\n)?(.*)\z"
SPLIT_TOML = r"(?s)\A\+\+\+\n(?:\+\+\+|(.*?)\n\+\+\+)(?:\r?\n)?(.*)\z"

# Host syntaxes and the file extensions they belong to.
SYNTAXES = {
    "c-block": ("/*", "*/", ("c", "h", "cc", "cpp", "cxx", "hpp", "hxx", "m", "mm", "swift", "java", "kt", "kts", "scala", "js", "mjs", "cjs", "jsx", "ts", "mts", "cts", "tsx", "cs", "go", "rs", "dart", "php", "css", "scss", "less", "sql", "jsonc")),
    "html-comment": ("<!--", "-->", ("html", "htm", "xhtml", "xml", "svg", "vue", "svelte")),
    "python-docstring": ('"""', '"""', ("py", "pyi")),
    "powershell-block": ("<#", "#>", ("ps1", "psm1", "psd1")),
    "lua-block": ("--[[", "]]", ("lua",)),
}
MARKDOWN = ("md", "markdown")


def extension(path: Column) -> Column:
    """Lower-cased part after the last dot of the last segment; the whole name if it has no dot."""
    return F.lower(F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\."), -1))


def content_kind(path: Column) -> Column:
    """markdown, plainText, wrapped or unmapped, by extension."""
    wrapped = [e for _, _, es in SYNTAXES.values() for e in es]
    ext = extension(path)
    return F.when(ext.isin(*MARKDOWN), "markdown").when(ext == "txt", "plainText").when(ext.isin(*wrapped), "wrapped").otherwise("unmapped")


def syntax(path: Column) -> Column:
    """Name of the host syntax of a source file, or null."""
    ext, out = extension(path), None
    for name, (_, _, es) in SYNTAXES.items():
        out = F.when(ext.isin(*es), name) if out is None else out.when(ext.isin(*es), name)
    return out


def split(content: Column) -> Column:
    """struct(form, raw, body): form is yaml, toml or null; raw is null without frontmatter and may be empty."""

    def part(pattern: str, form: str) -> Column:
        return F.struct(F.lit(form).alias("form"), F.regexp_extract(content, pattern, 1).alias("raw"), F.regexp_extract(content, pattern, 2).alias("body"))

    none = F.struct(F.lit(None).cast("string").alias("form"), F.lit(None).cast("string").alias("raw"), content.alias("body"))
    yaml_, toml = content.startswith("---\n") & content.rlike(SPLIT), content.startswith("+++\n") & content.rlike(SPLIT_TOML)
    return F.when(yaml_, part(SPLIT, "yaml")).when(toml, part(SPLIT_TOML, "toml")).otherwise(none)


def wrapped_blocks(source: str, opening: str, closing: str) -> list[tuple[str, str, int, int, int]]:
    """(form, raw, start, end, opening line) of the complete wrapped blocks of a source text."""
    lines = source.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    starts, at = [], 0
    for x in lines:
        starts.append(at)
        at += len(x) + 1
    out, i = [], 0
    while i + 1 < len(lines):
        form = {"---": "yaml", "+++": "toml"}.get(lines[i + 1]) if lines[i] == opening else None
        end = next((j for j in range(i + 2, len(lines) - 1) if lines[j] == lines[i + 1] and lines[j + 1] == closing), None) if form else None
        if end is None:
            i += 1
            continue
        raw = "".join(f"{x}\n" for x in lines[i + 2 : end])
        out.append((form, raw, starts[i], starts[end + 1] + len(closing), i + 1))
        i = end + 2
    return out


def _wrapped_split(content: pa.Array, name: pa.Array) -> pa.Array:
    """First wrapped block of a source text under a host syntax, and the lines of later ones."""
    out = []
    for text, kind in zip(content.to_pylist(), name.to_pylist(), strict=True):
        found = wrapped_blocks(text, *SYNTAXES[kind][:2]) if text is not None and kind in SYNTAXES else []
        out.append(dict(zip(("form", "raw", "start", "end", "line"), found[0], strict=True)) | {"more": [x[4] for x in found[1:]]} if found else None)
    return pa.array(out, pa.struct([("form", pa.string()), ("raw", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("line", pa.int32()), ("more", pa.list_(pa.int32()))]))


wrapped_split = lazy("struct<form:string,raw:string,start:int,end:int,line:int,more:array<int>>")(_wrapped_split)


_ENTRY = pa.struct([("pos", pa.int32()), ("key", pa.string()), ("kind", pa.string()), ("json", pa.string()), ("text", pa.string()), ("items", pa.list_(pa.string()))])
_PARSED = pa.struct([("json", pa.string()), ("entries", pa.list_(_ENTRY)), ("error", pa.string())])


def _parse(raw: pa.Array, form: pa.Array) -> pa.Array:
    out = []
    for text, kind in zip(raw.to_pylist(), form.to_pylist(), strict=True):
        if text is None:
            out.append({"json": None, "entries": [], "error": None})
            continue
        try:
            mapping = values.read(text, kind)
            out.append({"json": json.dumps(mapping, ensure_ascii=False, separators=(",", ":")), "entries": values.entries(mapping), "error": None})
        except values.FrontmatterError as e:
            out.append({"json": None, "entries": [], "error": f"{e.code}: {e}"})
    return pa.array(out, _PARSED)


#: struct(json, entries, error) of raw frontmatter.
parse = lazy(schemas.FRONTMATTER, deterministic=False)(_parse)


def _serialize(keys: pa.Array, jsons: pa.Array, form: pa.Array) -> pa.Array:
    out = []
    for ks, js, kind in zip(keys.to_pylist(), jsons.to_pylist(), form.to_pylist(), strict=True):
        try:
            out.append({"text": values.write(dict(zip(ks, map(json.loads, js), strict=True)), kind or "yaml"), "error": None})
        except values.FrontmatterError as e:
            out.append({"text": None, "error": f"{e.code}: {e}"})
    return pa.array(out, pa.struct([("text", pa.string()), ("error", pa.string())]))


#: struct(text, error) of keys and JSON values.
serialize = lazy("struct<text:string,error:string>")(_serialize)


def render(entries: Column, body: Column, form: Column) -> Column:
    """Content of a record from its entries and body: the body alone without entries."""
    text = serialize(F.transform(entries, lambda e: e["key"]), F.transform(entries, lambda e: e["json"]), F.coalesce(form, F.lit("yaml"))).getField("text")
    mark = F.when(form == "toml", "+++\n").otherwise("---\n")
    return F.when(F.size(entries) == 0, body).otherwise(F.concat(mark, text, mark, body))


def render_wrapped(content: Column, block: Column, entries: Column, form: Column) -> Column:
    """Source text with the first wrapped block's frontmatter replaced; without entries the block goes."""
    before, after = F.substring(content, F.lit(1), block["start"]), F.expr("''")
    inner = serialize(F.transform(entries, lambda e: e["key"]), F.transform(entries, lambda e: e["json"]), form).getField("text")
    old = F.substring(content, block["start"] + 1, block["end"] - block["start"])
    opening, closing = F.element_at(F.split(old, "\n"), 1), F.element_at(F.split(old, "\n"), -1)
    mark = F.when(form == "toml", "+++\n").otherwise("---\n")
    after = F.substring(content, block["end"] + 1, F.length(content))
    new = F.concat(opening, F.lit("\n"), mark, inner, mark, closing)
    return F.when(F.size(entries) == 0, F.concat(before, F.regexp_replace(after, r"\A\n", ""))).otherwise(F.concat(before, new, after))


def with_frontmatter(records: DataFrame) -> DataFrame:
    """records with form, raw, body, has_frontmatter and fm = struct(json, entries, error). Stage A of analysis (P10)."""
    part = split(F.col("content"))
    d = records.withColumn("_s", part).select(*records.columns, F.col("_s.form").alias("form"), F.col("_s.raw").alias("raw"), F.col("_s.body").alias("body"))
    return d.withColumn("has_frontmatter", F.col("raw").isNotNull()).withColumn("fm", parse(F.col("raw"), F.col("form")))


def with_wrapped_frontmatter(records: DataFrame) -> DataFrame:
    """The same for source files by their extension: the block stands in a comment, the body is the whole text (IO3)."""
    d = records.withColumn("syntax", syntax(F.col("path"))).withColumn("block", wrapped_split(F.col("content"), F.col("syntax")))
    d = d.withColumns({"form": F.col("block.form"), "raw": F.col("block.raw"), "body": F.col("content"), "more_blocks": F.coalesce(F.size("block.more"), F.lit(0))})
    return d.withColumn("has_frontmatter", F.col("raw").isNotNull()).withColumn("fm", parse(F.col("raw"), F.col("form")))


def entry(entries: Column, key: str) -> Column:
    """The entry of a key, or null."""
    return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))


def has(entries: Column, key: str) -> Column:
    return F.exists(entries, lambda e: e["key"] == key)


#: The key of the engine's own member; deployments that write another one set it here.
SYSTEM_KEY = "$engine"


def user_entries(entries: Column) -> Column:
    """Entries without the engine's own member."""
    return F.filter(entries, lambda e: e["key"] != SYSTEM_KEY)


def type_hints(json_: Column) -> Column:
    """array of struct(name, version) from the system member: names as strings or objects; malformed ones are left out."""
    raw = F.from_json(F.get_json_object(json_, f"$['{SYSTEM_KEY}'].typeHints"), "array<string>")
    one = lambda x: F.when(x.startswith("{"), F.struct(F.get_json_object(x, "$.name").alias("name"), F.get_json_object(x, "$.version").alias("version"))).otherwise(F.struct(x.alias("name"), F.lit(None).cast("string").alias("version")))
    return F.array_distinct(F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), one), lambda h: h["name"].isNotNull()))
