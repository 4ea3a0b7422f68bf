"""Wikilinks: parsing, the edge table, resolution, checks and backlinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.functions import frontmatter as fm

# Two brackets, no further pair of either inside, two brackets. A failed opening is skipped, so a nested one is found.
# Groups that repeat are possessive: the regex engine loops over them, where it would recurse once a character.
LINK = r"(?s)!?\[\[(?:(?!\[\[|\]\]).)++\]\]"
#: A string of a JSON text, with the colon behind it if it is a key.
JSON_STRING = r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?+'
#: Files of an ambiguous target that are listed with a link; `candidates` has all of them as rows.
LISTED = 100


def parse(text: Column) -> Column:
    """Links of a text from left to right, also in code: pos, raw, target, display, anchor_kind, anchor, embed."""

    def one(raw: Column, pos: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(raw, r"(?s)\A!?\[\[", ""), r"\]\]\z", "")
        # The first pipe that no backslash takes ends the target.
        part = r"(?s)\A((?:[^\\|]++|\\.|\\\z)*+)\|(.*)\z"
        piped = inner.rlike(part)
        target = F.replace(F.when(piped, F.regexp_extract(inner, part, 1)).otherwise(inner), F.lit("\\|"), F.lit("|"))
        hash_ = F.instr(target, "#")
        after = F.substring(target, hash_ + 1, F.length(target))
        block = after.startswith("^")
        return F.struct(
            pos.cast("int").alias("pos"), raw.alias("raw"), F.when(hash_ > 0, F.substring(target, F.lit(1), hash_ - 1)).otherwise(target).alias("target"), F.when(piped, F.regexp_extract(inner, part, 2)).alias("display"),
            F.when(hash_ > 0, F.when(block, "block").otherwise("heading")).alias("anchor_kind"), F.when(hash_ > 0, F.when(block, F.substring(after, F.lit(2), F.length(after))).otherwise(after)).alias("anchor"), raw.startswith("!").alias("embed"),
        )

    return F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), one)


def leaves(json_: Column) -> Column:
    """The strings among the values of a JSON text, from left to right, without its keys."""
    found = F.filter(F.regexp_extract_all(json_, F.lit(JSON_STRING), F.lit(0)), lambda x: ~x.endswith(":"))
    return F.coalesce(F.from_json(F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")), "array<string>"), F.array().cast("array<string>"))


def of_record(json_: Column, body: Column) -> Column:
    """Links of the frontmatter's strings, then of the body."""
    both = F.concat(leaves(json_), F.array(body))
    return F.transform(F.flatten(F.transform(both, parse)), lambda w, i: w.withField("pos", i.cast("int")))


def edges(records: DataFrame, frontmatter: bool = True) -> DataFrame:
    """source_path and a link for every link of the records (path, content)."""
    d = fm.with_frontmatter(records) if frontmatter else records.withColumn("body", fm.split(F.col("content"))["body"])
    found = of_record(F.col("fm.json"), F.col("body")) if frontmatter else parse(F.col("body"))
    return d.select(F.col("path").alias("source_path"), F.explode(found).alias("w")).select("source_path", "w.*")


def stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")


def _ext(name: Column) -> Column:
    return F.regexp_extract(F.element_at(F.split(name, "/"), -1), r".\.([^.]*)$", 1)


def index(records: DataFrame) -> DataFrame:
    """The files of the records by lower-cased stem; hidden ones are left out."""
    d = records.select(F.col("path").alias("file")).distinct()
    return d.filter(~F.col("file").rlike(r"(^|/)\.")).select("file", F.lower(stem(F.col("file"))).alias("stem"), _ext(F.col("file")).alias("ext"))


def normal_path(path: Column) -> Column:
    """Path without empty, . and .. segments."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))), "/")


def wanted(files: DataFrame) -> DataFrame:
    """(stem, want, file): want is the extension that a target names, or empty for a Markdown file."""
    md = files.filter(F.col("ext").isin("md", "markdown")).select("stem", F.lit("").alias("want"), "file")
    return md.unionByName(files.filter("ext <> ''").select("stem", F.col("ext").alias("want"), "file"))


def candidates(links: DataFrame, files: DataFrame) -> DataFrame:
    """(target, file) of every file that a target of the links may mean by its stem, however many there are."""
    t = links.filter("target <> ''").select("target").distinct()
    t = t.select("target", F.lower(stem(F.col("target"))).alias("stem"), _ext(F.col("target")).alias("want"))
    return t.join(wanted(files), ["stem", "want"]).select("target", "file")


def resolve(links: DataFrame, files: DataFrame) -> DataFrame:
    """Adds status, resolved_path, candidates and anchor_text to edges.

    An empty target is the source itself. One file of the stem (of the target's extension, or a Markdown one) resolves,
    several are ambiguous; else a path relative to the source, then from the root, is tried. All this is found out once
    for every folder and target that links from it name, however many links there are; the links then look up what was
    found. Files of a stem are counted, and listed up to LISTED.
    """
    all_of = wanted(files)
    known = all_of.groupBy("stem", "want").agg(F.count("*").alias("many"), F.min("file").alias("only"))
    here = F.regexp_replace(F.col("source_path"), r"[^/]*$", "")
    d = links.filter("target <> ''").select(here.alias("here"), "target").distinct()
    d = d.withColumns({"want": _ext(F.col("target")), "stem": F.lower(stem(F.col("target")))})
    # A dot in a name is no extension if no file of that stem and extension exists: then the whole name is a stem.
    d = d.join(known, ["stem", "want"], "left")
    plain = F.when(F.col("want") == "", F.concat(F.col("target"), F.lit(".md"))).otherwise(F.col("target"))
    d = d.withColumns({"rel": normal_path(F.concat("here", plain)), "root": normal_path(plain)})
    for way in ("rel", "root"):
        d = d.join(files.select(F.col("file").alias(way), F.lit(True).alias(f"has_{way}")), way, "left")
    first = Window.partitionBy("stem", "want").orderBy("file")
    several = all_of.join(d.filter("many > 1").select("stem", "want").distinct(), ["stem", "want"], "left_semi").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= LISTED)
    d = d.join(several.groupBy("stem", "want").agg(F.sort_array(F.collect_list("file")).alias("candidates")), ["stem", "want"], "left")
    status = F.when(F.col("many") == 1, "resolved").when(F.col("many") > 1, "ambiguous").when(F.coalesce("has_rel", "has_root").isNotNull(), "resolved").otherwise("unresolved")
    path = F.when(F.col("many") == 1, F.col("only")).when(F.col("many") > 1, None).when(F.col("has_rel"), F.col("rel")).when(F.col("has_root"), F.col("root"))
    d = d.select("here", F.col("target").alias("meant"), status.alias("status"), path.alias("resolved_path"), "candidates")
    anchor = F.when(F.col("anchor_kind") == "block", F.concat(F.lit("#^"), F.col("anchor"))).when(F.col("anchor_kind") == "heading", F.concat(F.lit("#"), F.col("anchor")))
    out = links.alias("l").join(d, (here == F.col("here")) & (F.col("l.target") == F.col("meant")), "left")
    own = F.col("l.target") == ""
    return out.select("l.*", F.when(own, "resolved").otherwise(F.col("status")).alias("status"), F.when(own, F.col("l.source_path")).otherwise(F.col("resolved_path")).alias("resolved_path"), "candidates", anchor.alias("anchor_text"))


def check(resolved: DataFrame) -> DataFrame:
    """Totals by status."""
    return resolved.groupBy("status").agg(F.count("*").alias("links"), F.countDistinct("source_path").alias("files"))


def broken(resolved: DataFrame) -> DataFrame:
    """Links that lead nowhere."""
    return resolved.filter("status = 'unresolved'")


def backlinks(resolved: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """path, n_links and n_sources for every target: what links to it from other records; ambiguous links don't count.

    targets (path) keeps those without links, too.
    """
    found = resolved.filter((F.col("status") == "resolved") & (F.col("resolved_path") != F.col("source_path"))).groupBy(F.col("resolved_path").alias("path")).agg(F.count("*").alias("n_links"), F.countDistinct("source_path").alias("n_sources"))
    if targets is None:
        return found
    return targets.select("path").join(found, "path", "left").select("path", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))
