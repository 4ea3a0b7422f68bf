"""Queries on structure: headings, sections, tables of contents, text, links (S, T, J rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.functions import body as bodies
from marklake.functions import frontmatter as fm
from marklake.functions import markdown
from marklake.operators import analysis, explore, links
from marklake.plans.registry import NOTES, query
from marklake.sources import corpora

E = F.col

#: An atlas: a page per region with a section per nation (in order of key), which has a subsection; for moves and levels.
ATLAS = """SELECT concat('atlas/', r_regionkey, '.md') AS path, r_name AS r, list(n_name ORDER BY n_nationkey) AS ns FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name"""
PART = "concat('## ', x, chr(10), chr(10), 'About ', x, '.', chr(10), chr(10), '### More', chr(10), chr(10))"


def notes(spark: SparkSession, sf: str) -> DataFrame:
    d = corpora.order_notes(spark, sf).select("path", "content", fm.split(E("content"))["body"].alias("body"))
    return d.withColumn("headings", bodies.headings(E("body")))


def atlas(spark: SparkSession, sf: str) -> DataFrame:
    r, n = spark.read.parquet(f"{sf}/region.parquet"), spark.read.parquet(f"{sf}/nation.parquet")
    d = r.join(n, r.r_regionkey == n.n_regionkey).groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    part = F.transform("ns", lambda x: F.concat(F.lit("## "), x["n_name"], F.lit("\n\nAbout "), x["n_name"], F.lit(".\n\n### More\n\n")))
    d = d.select(F.concat(F.lit("atlas/"), E("r_regionkey").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# "), E("r_name"), F.lit("\n\n"), F.array_join(part, "")).alias("body"), E("ns")[0]["n_name"].alias("first"))
    return d.withColumn("content", E("body")).withColumn("headings", bodies.headings(E("body")))


def _atlas_sql(order: str, columns: str = "path, md5(body) AS body", each: str = PART, head: str = "concat('# ', r, chr(10), chr(10))") -> str:
    return f"WITH a AS ({ATLAS}), b AS (SELECT *, {order} AS os FROM a), c AS (SELECT *, concat({head}, array_to_string(list_transform(os, lambda x: {each}), '')) AS body FROM b) SELECT {columns} FROM c"


@query(f"SELECT path, 1::bigint AS idx, 1::bigint AS level, concat('Order ', k) AS text, 1::bigint AS line, NULL::bigint AS parent, n_lines::bigint AS end_line, false AS direct_empty FROM ({NOTES}) UNION ALL SELECT path, 2, 2, 'Notes', notes_line, 1, n_lines, k % 3 = 0 FROM ({NOTES})")
def s01_headings(spark, sf):
    d = notes(spark, sf).select("path", F.explode("headings").alias("h"))
    big = lambda c: E(f"h.{c}").cast("bigint")
    return d.select("path", big("idx").alias("idx"), big("level").alias("level"), "h.text", big("line").alias("line"), big("parent_idx").alias("parent"), big("end_line").alias("end_line"), "h.direct_empty")


@query(_atlas_sql("ns", "path, concat(lower(replace(r, ' ', '-')), ',', array_to_string(flatten(list_transform(ns, lambda x, i: [lower(replace(x, ' ', '-')), CASE WHEN i = 1 THEN 'more' ELSE concat('more-', i - 1) END])), ',')) AS slugs"))
def s02_slugs(spark, sf):
    return atlas(spark, sf).select("path", F.array_join(bodies.slugs(F.transform("headings", lambda h: h["text"])), ",").alias("slugs"))


@query(_atlas_sql("ns", "path, len(ns)::bigint AS n, array_to_string(list_transform(ns, lambda x: concat('2:', x)), ',') AS entries"))
def s03_toc(spark, sf):
    t = bodies.toc(E("headings"), 2, 2)
    return atlas(spark, sf).select("path", t.alias("t")).select("path", F.size("t").cast("bigint").alias("n"), F.array_join(F.transform("t", lambda e: F.concat_ws(":", e["level"], e["text"])), ",").alias("entries"))


@query(f"SELECT path, 2::bigint AS total, 1::bigint AS low, 2::bigint AS high FROM ({NOTES})")
def s04_toc_counts(spark, sf):
    d = notes(spark, sf).select("path", bodies.toc(E("headings")).alias("t"))
    level = F.transform("t", lambda e: e["level"].cast("bigint"))
    return d.select("path", F.size("t").cast("bigint").alias("total"), F.array_min(level).alias("low"), F.array_max(level).alias("high"))


@query(f"SELECT path, concat('- [Order ', k, '](#order-', k, ')', chr(10), '  - [Notes](#notes)') AS bullets, concat('# Order ', k, chr(10), '## Notes') AS heads, concat('Order ', k, chr(10), '  Notes') AS plain, concat('└── Order ', k, chr(10), '    └── Notes') AS tree, concat('{{\"entries\":[{{\"level\":1,\"text\":\"Order ', k, '\",\"slug\":\"order-', k, '\",\"children\":[{{\"level\":2,\"text\":\"Notes\",\"slug\":\"notes\",\"children\":[]}}]}}],\"minLevel\":1,\"maxLevel\":2}}') AS json FROM ({NOTES})")
def s05_toc_render(spark, sf):
    d = notes(spark, sf).select("path", bodies.toc(E("headings")).alias("t"))
    return d.select("path", *(bodies.render_toc(E("t"), f).alias(n) for f, n in (("md-bullet-links", "bullets"), ("md-only-headings", "heads"), ("plain", "plain"), ("tree", "tree"), ("json", "json"))))


@query(f"SELECT path, concat('## Notes', chr(10), CASE WHEN k % 3 = 0 THEN '' ELSE concat(chr(10), 'Placed on ', d, '.', chr(10)) END) AS text FROM ({NOTES})")
def s08_extract_section(spark, sf):
    d = notes(spark, sf).withColumn("h", bodies.find(E("headings"), "NOTES"))
    return d.select("path", bodies.section(E("body"), E("h")).alias("text"))


@query(f"SELECT path, concat(substr(body, 1, instr(body, '## Notes') - 1), '## Notes', chr(10), chr(10), 'New text.') AS body FROM ({NOTES})")
def s09_replace_section(spark, sf):
    d = notes(spark, sf).withColumn("h", bodies.find(E("headings"), "Notes"))
    return d.select("path", bodies.replace_section(E("body"), E("h"), "New text.").alias("body"))


@query(f"SELECT path, concat(substr(body, 1, instr(body, '## Notes') - 1), '## Extra', chr(10), chr(10), '### Deep', chr(10), 'x', chr(10), chr(10), substr(body, instr(body, '## Notes'))) AS body, NULL::varchar AS error FROM ({NOTES})")
def s10_insert_section(spark, sf):
    d = notes(spark, sf).withColumn("h", bodies.find(E("headings"), "Notes"))
    return d.withColumn("x", bodies.insert_section(E("body"), E("h"), "Extra", "# Deep\nx", before=True)).select("path", "x.body", "x.error")


@query(f"SELECT path, substr(body, 1, instr(body, '## Notes') - 2) AS body FROM ({NOTES})")
def s11_remove_section(spark, sf):
    d = notes(spark, sf).withColumn("h", bodies.find(E("headings"), index=2))
    return d.select("path", bodies.remove_section(E("body"), E("h")).alias("body"))


@query(_atlas_sql("ns", "path, array_to_string(ns, ',') AS siblings"))
def s12_siblings(spark, sf):
    d = atlas(spark, sf).withColumn("h", bodies.find(E("headings"), index=2))
    return d.select("path", F.array_join(F.transform(bodies.siblings(E("headings"), E("h")), lambda s: s["text"]), ",").alias("siblings"))


def _moved(d: DataFrame, **how) -> DataFrame:
    d = d.withColumn("h", F.get(F.filter("headings", lambda h: h["text"] == E("first")), F.lit(0)))
    return d.withColumn("x", bodies.move_section(E("body"), E("headings"), E("h"), **how)).select("path", F.md5("x.body").alias("body"))




@query(_atlas_sql("CASE WHEN len(ns) > 1 THEN list_concat([ns[2], ns[1]], ns[3:]) END", "path, CASE WHEN len(ns) > 1 THEN md5(body) END AS body"))
def s13_move_down(spark, sf):
    return _moved(atlas(spark, sf), by=1)


@query(_atlas_sql("CASE WHEN len(ns) > 2 THEN list_concat(ns[2:3], [ns[1]], ns[4:]) END", "path, CASE WHEN len(ns) > 2 THEN md5(body) END AS body"))
def s14_move_to(spark, sf):
    return _moved(atlas(spark, sf), to=3)


@query(_atlas_sql("ns", "path, (2 * len(ns))::bigint AS n"))
def s15_scope(spark, sf):
    d = atlas(spark, sf).withColumn("h", bodies.find(E("headings"), index=1))
    return d.select("path", F.size(bodies.scope(E("headings"), E("h"))).cast("bigint").alias("n"))


@query(_atlas_sql("ns", "path, md5(regexp_replace(body, '(^|\\n)(#+)', '\\1\\2#', 'g')) AS down, false AS clamped, md5(regexp_replace(regexp_replace(regexp_replace(body, '^# ', '@ '), '\\n## ', chr(10) || '# ', 'g'), '\\n### ', chr(10) || '## ', 'g').replace('@ ', '# ')) AS up, true AS up_clamped"))
def s16_adjust_levels(spark, sf):
    d = atlas(spark, sf).withColumn("h", bodies.find(E("headings"), index=1))
    d = d.withColumn("x", bodies.adjust_level(E("body"), E("headings"), E("h"), 1)).withColumn("y", bodies.adjust_level(E("body"), E("headings"), E("h"), -1))
    return d.select("path", F.md5("x.body").alias("down"), "x.clamped", F.md5("y.body").alias("up"), E("y.clamped").alias("up_clamped"))


@query(f"SELECT path, 2::bigint AS id, 'Notes' AS title, (n_keys + 4 + notes_line)::bigint AS start_line, concat('Order ', k, '/Notes') AS title_path, 1 + 5 * (k % 3 <> 0)::bigint AS n_words, 0::bigint AS n_children FROM ({NOTES})")
def s18_explore(spark, sf):
    d = explore.sections(notes(spark, sf)).filter("id = 2")
    return d.select("path", E("id").cast("bigint").alias("id"), "title", E("start_line").cast("bigint").alias("start_line"), F.array_join("title_path", "/").alias("title_path"), "n_words", E("n_children").cast("bigint").alias("n_children"))


@query(f"SELECT path, title FROM (SELECT path, k, unnest([concat('Order ', k), 'Notes']) AS title FROM ({NOTES})) WHERE k = 17")
def s19_explore_target(spark, sf):
    found = explore.sections(notes(spark, sf))
    return explore.target(found, title="Order 17", recursive=True).select("path", "title")


@query(f"SELECT path, concat('Order ', k, chr(10), chr(10), 'For [[customer-', c, '|the customer]].', CASE WHEN k % 10 = 0 THEN concat(chr(10), 'See [[missing-', k, ']].') ELSE '' END, chr(10), chr(10), 'Notes', CASE WHEN k % 3 = 0 THEN '' ELSE concat(chr(10), chr(10), 'Placed on ', d, '.') END) AS text, concat('Order ', k, ' For [[customer-', c, '|the customer]].', CASE WHEN k % 10 = 0 THEN concat(' See [[missing-', k, ']].') ELSE '' END, ' Notes', CASE WHEN k % 3 = 0 THEN '' ELSE concat(' Placed on ', d, '.') END) AS line FROM ({NOTES})")
def t01_plain_text(spark, sf):
    return notes(spark, sf).select("path", bodies.to_plain_text(E("body")).alias("text"), bodies.to_plain_text(E("body"), markdown.SINGLE_LINE).alias("line"))


@query("SELECT n_nationkey::bigint AS k, concat('- *', n_name, '*', chr(10), '  - b', chr(10), chr(10), '| name', repeat(' ', greatest(0, length(n_name) - 4)), ' | key |', chr(10), '| ', repeat('-', greatest(4, length(n_name))), ' | --- |', chr(10), '| ', rpad(n_name, greatest(4, length(n_name))::int, ' '), ' | ', rpad(n_nationkey::varchar, 3, ' '), ' |', chr(10)) AS text FROM nation")
def t07_format(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    text = F.concat(F.lit("* _"), E("n_name"), F.lit("_\n  + b\n\n|name|key|\n|-|-|\n|"), E("n_name"), F.lit("|"), E("n_nationkey").cast("string"), F.lit("|\n"))
    return n.select(E("n_nationkey").cast("bigint").alias("k"), bodies.formatted(text).alias("text"))


#: The links of the vault (C4), from the tables.
VAULT = """SELECT concat('customers/customer-', c_custkey, '.md') AS source_path, lower(replace(n_name, ' ', '-')) AS target, NULL AS anchor, 'n' AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('nations/', lower(replace(n_name, ' ', '-')), '.md'), lower(replace(r_name, ' ', '-')), NULL, 'r' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT concat('nations/', lower(replace(n_name, ' ', '-')), '.md'), '', '#History', 's' FROM nation"""


def vault_links(spark: SparkSession, sf: str) -> DataFrame:
    v = corpora.vault(spark, sf)
    return links.resolve(links.edges(v), links.index(v))


@query(f"SELECT path AS source_path, concat('[[customer-', c, '|the customer]]') AS raw, concat('customer-', c) AS target, 'the customer' AS display, 0::bigint AS pos FROM ({NOTES}) UNION ALL SELECT path, concat('[[missing-', k, ']]'), concat('missing-', k), NULL, 1 FROM ({NOTES}) WHERE k % 10 = 0")
def j01_links(spark, sf):
    return links.edges(corpora.order_notes(spark, sf)).select("source_path", "raw", "target", "display", E("pos").cast("bigint").alias("pos"))


@query(r"""SELECT path AS source_path, unnest(CASE WHEN k % 2 = 0 THEN ['the "top"', concat('n-', k), 'a/b', concat('n-', k)] ELSE [concat('body-', k)] END) AS target, unnest(CASE WHEN k % 2 = 0 THEN [0, 1, 2, 3]::bigint[] ELSE [0]::bigint[] END) AS pos FROM (SELECT n_nationkey AS k, concat('n/', n_nationkey, '.md') AS path FROM nation)""")
def j03_frontmatter_links(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(E("n_nationkey").cast("string").alias("k"))
    front = F.concat(F.lit('---\nup: "[[the \\"top\\"]]"\n"[[key]]": plain\nsee:\n  - "x [[n-'), E("k"), F.lit("|shown]] y\"\n  - deep: {at: '[[a/b]]'}\n---\nBody [[n-"), E("k"), F.lit("]].\n"))
    text = F.when(E("k").cast("int") % 2 == 0, front).otherwise(F.concat(F.lit("---\nup: none\n---\nBody [[body-"), E("k"), F.lit("]].\n")))
    d = links.edges(n.select(F.concat(F.lit("n/"), E("k"), F.lit(".md")).alias("path"), text.alias("content")))
    return d.select("source_path", "target", E("pos").cast("bigint").alias("pos"))


@query("SELECT target, file FROM (SELECT lower(replace(r_name, ' ', '-')) AS target, unnest(['archive', 'regions']) AS folder FROM region JOIN nation ON n_regionkey = r_regionkey) t, LATERAL (SELECT concat(t.folder, '/', t.target, '.md') AS file) GROUP BY ALL UNION ALL SELECT lower(replace(n_name, ' ', '-')), concat('nations/', lower(replace(n_name, ' ', '-')), '.md') FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def j06_candidates(spark, sf):
    v = corpora.vault(spark, sf)
    return links.candidates(links.edges(v), links.index(v))


@query("SELECT lower(replace(r_name, ' ', '-')) AS stem, 2::bigint AS n FROM region UNION ALL SELECT lower(replace(n_name, ' ', '-')), 1 FROM nation UNION ALL SELECT concat('customer-', c_custkey), 1 FROM customer")
def j04_stem_index(spark, sf):
    return links.index(corpora.vault(spark, sf)).groupBy("stem").agg(F.count("*").alias("n"))


@query(f"SELECT source_path, target, CASE WHEN kind = 'r' THEN 'ambiguous' ELSE 'resolved' END AS status, CASE kind WHEN 'n' THEN concat('nations/', target, '.md') WHEN 's' THEN source_path END AS resolved_path, CASE WHEN kind = 'r' THEN concat('archive/', target, '.md,regions/', target, '.md') END AS candidates, anchor AS anchor_text FROM ({VAULT})")
def j05_resolve(spark, sf):
    return vault_links(spark, sf).select("source_path", "target", "status", "resolved_path", F.array_join("candidates", ",").alias("candidates"), "anchor_text")


def both(spark: SparkSession, sf: str) -> DataFrame:
    """Order notes and vault: their links lead from the notes to the customers."""
    return corpora.order_notes(spark, sf).unionByName(corpora.vault(spark, sf))


def both_links(spark: SparkSession, sf: str) -> DataFrame:
    d = both(spark, sf)
    return links.resolve(links.edges(d, frontmatter=False), links.index(d))


@query(f"SELECT status, count(*) AS links, count(DISTINCT source_path) AS files FROM (SELECT path AS source_path, 'resolved' AS status FROM ({NOTES}) UNION ALL SELECT path, 'unresolved' FROM ({NOTES}) WHERE k % 10 = 0 UNION ALL SELECT source_path, CASE WHEN kind = 'r' THEN 'ambiguous' ELSE 'resolved' END FROM ({VAULT})) GROUP BY status")
def j08_links_check(spark, sf):
    return links.check(both_links(spark, sf))


@query(f"SELECT path, count(*) AS n_links, count(DISTINCT s) AS n_sources FROM (SELECT concat('customers/customer-', c, '.md') AS path, path AS s FROM ({NOTES}) UNION ALL SELECT concat('nations/', target, '.md'), source_path FROM ({VAULT}) WHERE kind = 'n') GROUP BY path")
def j09_backlinks(spark, sf):
    return links.backlinks(both_links(spark, sf))


@query(f"WITH f AS (SELECT concat('regions/', lower(replace(r_name, ' ', '-')), '.md') AS path FROM region UNION ALL SELECT concat('customers/customer-', c_custkey, '.md') FROM customer), l AS (SELECT concat('customers/customer-', c, '.md') AS path, count(*) AS n FROM ({NOTES}) GROUP BY c) SELECT path, coalesce(n, 0) AS n_links, coalesce(n, 0) AS n_sources FROM f LEFT JOIN l USING (path)")
def j09_backlinks_of_targets(spark, sf):
    targets = corpora.vault(spark, sf).filter(F.col("path").startswith("regions/") | F.col("path").startswith("customers/"))
    return links.backlinks(both_links(spark, sf), targets)


@query(f"SELECT path AS source_path, concat('missing-', k) AS target FROM ({NOTES}) WHERE k % 10 = 0")
def j13_broken_links(spark, sf):
    return links.broken(both_links(spark, sf)).select("source_path", "target")


@query(f"SELECT path, count(*) AS n_sections FROM ({NOTES}), LATERAL (SELECT unnest([1, 2])) GROUP BY path")
def a10_explore_counts(spark, sf):
    return explore.sections(notes(spark, sf)).groupBy("path").agg(F.count("*").alias("n_sections"))


@query(f"SELECT path, n_keys::bigint AS n_keys, 2::bigint AS n_headings, 1 + (k % 10 = 0)::bigint AS n_links FROM ({NOTES})")
def p10_full_analysis(spark, sf):
    d = analysis.analyze(corpora.order_notes(spark, sf), wikilinks=True)
    return d.select("path", F.size("user_entries").cast("bigint").alias("n_keys"), F.size("headings").cast("bigint").alias("n_headings"), F.size("wikilinks").cast("bigint").alias("n_links"))
