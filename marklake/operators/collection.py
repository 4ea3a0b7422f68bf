"""Queries and changes of frontmatter over collections (F1-F24, A1, A7, W-rows that sort, page and deduplicate)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake import schemas
from marklake.functions import frontmatter as fm
from marklake.functions import jmespath, values

ENTRIES = "fm.entries"


def get(analyzed: DataFrame, key: str) -> DataFrame:
    """path, present, kind and text of a top-level key; JSON text for arrays and objects (F1)."""
    v = fm.entry(F.col(ENTRIES), key)
    return analyzed.select("path", fm.has(F.col(ENTRIES), key).alias("present"), v["kind"].alias("kind"), F.coalesce(v["text"], F.when(v["kind"] != "null", v["json"])).alias("value"))


def as_text(v: Column, form: str = "inline") -> Column:
    """A value inline, as bullets or as a numbered list (F2)."""
    items = F.when(v["kind"] == "array", F.transform(v["items"], lambda x: F.when(x.startswith('"'), F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>")[0]).otherwise(x))).otherwise(F.array(F.coalesce(v["text"], v["json"])))
    if form == "inline":
        return F.array_join(items, ", ")
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("- "), x) if form == "bullets" else F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def keys(analyzed: DataFrame) -> DataFrame:
    """path and sorted keys (F4); records without any have an empty list."""
    return analyzed.select("path", F.array_sort(F.transform(ENTRIES, lambda e: e["key"])).alias("keys"))


def categories(analyzed: DataFrame) -> DataFrame:
    """path and one of frontMatter, noFrontMatter, emptyFrontMatter."""
    return analyzed.select("path", F.when(~F.col("has_frontmatter"), "noFrontMatter").when(F.size(ENTRIES) == 0, "emptyFrontMatter").otherwise("frontMatter").alias("category"))


def search(analyzed: DataFrame, expression: str) -> DataFrame:
    """Records whose YAML frontmatter satisfies a JMESPath expression; errors of a record are no match."""
    return analyzed.filter((F.col("form") == "yaml") & jmespath.matches(F.col("fm.json"), expression))


def scalars(analyzed: DataFrame, expression: str) -> DataFrame:
    """path, status (value, missing, null, error), vtype and v of an expression, typed as uniqueness needs it."""
    v = jmespath.value(F.col("fm.json"), expression)
    d = analyzed.withColumn("_v", v)
    kind, json_ = F.col("_v.kind"), F.col("_v.json")
    known = jmespath._path(jmespath.parse(expression))
    absent = ~fm.has(F.col(ENTRIES), known[0]) if known and len(known) == 1 else F.lit(False)
    bad = F.col("fm.error").isNotNull() | (F.col("form") != "yaml") | F.col("_v.error").isNotNull() | kind.isin("array", "object")
    status = F.when(F.coalesce(bad, F.lit(False)), "error").when(absent | F.col("form").isNull(), "missing").when(kind == "null", "null").otherwise("value")
    text = F.when(kind == "string", F.from_json(F.concat(F.lit("["), json_, F.lit("]")), "array<string>")[0]).when(kind == "number", F.coalesce(F.regexp_replace(json_.try_cast("decimal(38,18)").cast("string"), r"(?:\.0+|(\.\d*?)0+)$", "$1"), json_)).otherwise(json_)
    return d.select("path", status.alias("status"), F.when(status == "value", kind).alias("vtype"), F.when(status == "value", text).alias("v"))


def duplicates(found: DataFrame) -> DataFrame:
    """vtype, v, n and sorted paths of values that several records have (F8, A1). Counts are combined before the shuffle;
    paths are gathered only for values that repeat."""
    values_ = found.filter("status = 'value'")
    many = values_.groupBy("vtype", "v").agg(F.count("*").alias("n")).filter("n > 1")
    return values_.join(many, ["vtype", "v"]).groupBy("vtype", "v", "n").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def duplicate_counts(found: DataFrame) -> DataFrame:
    """The same without the paths: one combined aggregate."""
    return found.filter("status = 'value'").groupBy("vtype", "v").agg(F.count("*").alias("n")).filter("n > 1")


def collisions_with(found: DataFrame, path: str) -> DataFrame:
    """Other records with the value of one record (F9); that one row is broadcast."""
    one = found.filter((F.col("path") == path) & (F.col("status") == "value")).limit(1).select("vtype", "v")
    return found.filter(F.col("path") != path).join(F.broadcast(one), ["vtype", "v"])


def unique_report(found: DataFrame) -> DataFrame:
    """One row of counters, and whether all values are unique."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    total = found.agg(F.count("*").alias("n_records"), *(count(s) for s in ("value", "missing", "null", "error")))
    groups = duplicate_counts(found).agg(F.count("*").alias("n_collisions"))
    return total.withColumn("_k", F.lit(1)).join(F.broadcast(groups.withColumn("_k", F.lit(1))), "_k").drop("_k").withColumn("passed", (F.col("n_collisions") == 0) & (F.col("n_error") == 0))


def array_contains(analyzed: DataFrame, key: str, item: str, invert: bool = False, ignore_case: bool = False) -> DataFrame:
    """Records whose array has a string; records without the key or with another value never count."""
    v = fm.entry(F.col(ENTRIES), key)
    fold = (lambda x: F.lower(x)) if ignore_case else (lambda x: x)
    want = values.canonical(item.lower() if ignore_case else item)
    hit = F.exists(v["items"], lambda x: fold(x) == want)
    return analyzed.filter(F.coalesce((v["kind"] == "array") & (~hit if invert else hit), F.lit(False)))


# Changes. Each takes and returns an array of entries; `rewrite` turns it into content.


def _new(key: str, value: Any) -> Column:
    e = values.entries({key: value})[0]
    items = F.lit(None) if e["items"] is None else F.array(*(F.lit(x) for x in e["items"]))
    return F.struct(F.lit(0).alias("pos"), F.lit(key).alias("key"), F.lit(e["kind"]).alias("kind"), F.lit(e["json"]).alias("json"), F.lit(e["text"]).cast("string").alias("text"), items.cast("array<string>").alias("items")).cast(schemas.ENTRY)


def set_key(entries: Column, key: str, value: Any) -> Column:
    """Value in place, or at the end."""
    new = _new(key, value)
    return F.when(fm.has(entries, key), F.transform(entries, lambda e: F.when(e["key"] == key, new).otherwise(e))).otherwise(F.concat(entries, F.array(new)))


def remove_key(entries: Column, key: str) -> Column:
    return F.filter(entries, lambda e: e["key"] != key)


def rename_key(entries: Column, old: str, new: str) -> tuple[Column, Column]:
    """Entries with the key renamed and moved to the end, and an error code."""
    error = F.when(~fm.has(entries, old), "key-not-found").when(fm.has(entries, new), "key-exists")
    moved = F.transform(F.filter(entries, lambda e: e["key"] == old), lambda e: e.withField("key", F.lit(new)))
    return F.when(error.isNull(), F.concat(remove_key(entries, old), moved)).otherwise(entries), error


def touch(entries: Column, names: list[str]) -> Column:
    """Missing keys added as nulls."""
    out = entries
    for name in dict.fromkeys(names):
        out = F.when(fm.has(out, name), out).otherwise(F.concat(out, F.array(_new(name, None))))
    return out


def sort_keys(entries: Column, by: str = "alphabetical", reverse: bool = False) -> Column:
    """Entries by key or by length of key, equals in their order (F16)."""
    first = (lambda e: F.length(e["key"])) if by == "length" else (lambda e: e["key"])
    ranked = F.transform(entries, lambda e, i: F.struct(first(e).alias("a"), i.alias("i"), e.alias("e")))
    if not reverse:
        return F.transform(F.sort_array(ranked), lambda r: r["e"])
    return F.transform(F.array_sort(ranked, lambda x, y: F.when(x["a"] > y["a"], -1).when(x["a"] < y["a"], 1).otherwise(x["i"] - y["i"])), lambda r: r["e"])


def replace_all(text: str, form: str) -> Column:
    """Entries of a whole new frontmatter given as json, yaml, toml or plist (F17, IO16)."""
    import json
    import plistlib

    mapping = json.loads(text) if form == "json" else plistlib.loads(text.encode()) if form == "plist" else values.read(text, form)
    if not isinstance(mapping, dict):
        raise values.FrontmatterError("root-not-mapping", "frontmatter is not a mapping")
    found = [_new(k, v) for k, v in values.plain(mapping).items()]
    return F.array(*found) if found else F.array().cast(schemas.ENTRIES)


def edit_array(entries: Column, key: str, item: str, how: str, skip_duplicates: bool = False) -> tuple[Column, Column]:
    """append, prepend or remove (the first occurrence) of a string, and an error code."""
    v = fm.entry(entries, key)
    text = values.canonical(item)
    old = F.coalesce(v["items"], F.array().cast("array<string>"))
    if how == "remove":
        at = F.array_position(old, text).cast("int")
        new = F.concat(F.slice(old, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(old, at + 1, F.size(old)))
        error = F.when(~fm.has(entries, key), "key-not-found").when(v["kind"] != "array", "not-an-array").when(at == 0, "value-not-found")
    else:
        new = F.concat(old, F.array(F.lit(text))) if how == "append" else F.concat(F.array(F.lit(text)), old)
        new = F.when(F.array_contains(old, text), old).otherwise(new) if skip_duplicates else new
        error = F.when(fm.has(entries, key) & (v["kind"] != "array"), "not-an-array")
    made = F.element_at(F.transform(F.array(new), lambda x: F.struct(F.lit(0).alias("pos"), F.lit(key).alias("key"), F.lit("array").alias("kind"), F.concat(F.lit("["), F.array_join(x, ","), F.lit("]")).alias("json"), F.lit(None).cast("string").alias("text"), x.alias("items")).cast(schemas.ENTRY)), 1)
    changed = F.when(fm.has(entries, key), F.transform(entries, lambda e: F.when(e["key"] == key, made).otherwise(e))).otherwise(F.concat(entries, F.array(made)))
    return F.when(error.isNull(), changed).otherwise(entries), error


def rewrite(analyzed: DataFrame, entries: Column, form: str | None = None) -> DataFrame:
    """path and new content of records whose entries are replaced; form converts between YAML and TOML."""
    return analyzed.select("path", fm.render(entries, F.col("body"), F.lit(form) if form else F.col("form")).alias("content"))


# Sorting, paging, deduplication.


def page(records: DataFrame, key: str, size: int, after: str | None = None, prefix: str | None = None) -> DataFrame:
    """The next `size` records by key behind the last one seen: a top-k, never an offset."""
    d = records if after is None else records.filter(F.col(key) > after)
    d = d if prefix is None else d.filter(F.col("path").startswith(prefix.rstrip("/") + "/"))
    return d.orderBy(key).limit(size)


def token(query: dict, last: str) -> str:
    """Opaque continuation token, bound to a query."""
    import base64
    import hashlib
    import json

    mark = hashlib.sha256(json.dumps(query, sort_keys=True).encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(json.dumps({"q": mark, "after": last}).encode()).decode()


def read_token(text: str, query: dict) -> str:
    """Last key of a token; a token of another query is an error."""
    import base64
    import json

    try:
        found = json.loads(base64.urlsafe_b64decode(text.encode()))
        if token(query, found["after"]) != text:
            raise ValueError
    except (ValueError, KeyError) as e:
        raise ValueError("invalid continuation token") from e
    return found["after"]


def distinct_records(records: DataFrame) -> DataFrame:
    """One row of equal identity, revision, path and content."""
    return records.dropDuplicates([c for c in ("identity", "revision", "path", "content") if c in records.columns])


def latest(records: DataFrame, by: str = "modification_ts") -> DataFrame:
    """The last version of every path."""
    w = Window.partitionBy("path").orderBy(F.desc_nulls_last(by), F.desc("content"))
    return records.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
