"""Queries on frontmatter: splitting, parsing, reading, searching, changing (P, F, Q, D rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.functions import body as bodies
from marklake.functions import codec, predicates
from marklake.functions import frontmatter as fm
from marklake.operators import analysis, collection, export
from marklake.plans.registry import NOTES, query
from marklake.sources import corpora

E = F.col


def notes(spark: SparkSession, sf: str) -> DataFrame:
    return fm.with_frontmatter(corpora.order_notes(spark, sf))


@query(f"SELECT path, 'yaml' AS form, md5(raw) AS raw, md5(body) AS body FROM ({NOTES})")
def p01_split(spark, sf):
    s = fm.split(E("content"))
    return corpora.order_notes(spark, sf).select("path", s["form"].alias("form"), F.md5(s["raw"]).alias("raw"), F.md5(s["body"]).alias("body"))


@query("SELECT concat('pages/page-', page_id, '.html') AS path, 'yaml' AS form, 1::bigint AS line, page_id::varchar AS page, url, 0::bigint AS more, 'html-comment' AS syntax FROM pages")
def p02_wrapped_split(spark, sf):
    d = fm.with_wrapped_frontmatter(corpora.wrapped_pages(spark, sf))
    return d.select("path", "form", E("block.line").cast("bigint").alias("line"), fm.entry(E("fm.entries"), "page")["text"].alias("page"), fm.entry(E("fm.entries"), "url")["text"].alias("url"), E("more_blocks").cast("bigint").alias("more"), "syntax")


@query(f"""SELECT path, concat('{{"id":', k, ',"status":"', s, '","cents":', cents, CASE WHEN k % 5 = 0 THEN '' ELSE concat(',"date":"', d, '"') END, ',"customer":', c, ',"tags":["', lower(s), '","', pr, '"]', CASE WHEN k % 4 = 0 THEN ',"discount":null' ELSE '' END, '}}') AS json, n_keys::bigint AS n_keys FROM ({NOTES})""")
def p04_yaml_parse(spark, sf):
    return notes(spark, sf).select("path", E("fm.json").alias("json"), F.size("fm.entries").cast("bigint").alias("n_keys"))


@query("""SELECT concat('nations/', n_nationkey, '.md') AS path, 'toml' AS form, concat('{"key":', n_nationkey, ',"name":"', n_name, '","open":true,"since":"2020-01-02"}') AS json FROM nation""")
def p05_toml_parse(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    text = F.concat(F.lit("+++\nkey = "), E("n_nationkey").cast("string"), F.lit('\nname = "'), E("n_name"), F.lit('"\nopen = true\nsince = 2020-01-02\n+++\nBody\n'))
    d = fm.with_frontmatter(n.select(F.concat(F.lit("nations/"), E("n_nationkey").cast("string"), F.lit(".md")).alias("path"), text.alias("content")))
    return d.select("path", "form", E("fm.json").alias("json"))


@query(f"SELECT path, md5(concat('---', chr(10), raw, chr(10), '---', chr(10), body)) AS content FROM ({NOTES})")
def p08_render(spark, sf):
    return notes(spark, sf).select("path", F.md5(fm.render(E("fm.entries"), E("body"), E("form"))).alias("content"))


@query(f"SELECT path, 'markdown' AS kind, n_keys::bigint AS n_keys, 2::bigint AS n_headings, 0::bigint AS n_diagnostics FROM ({NOTES})")
def p10_analyze(spark, sf):
    d = analysis.analyze(corpora.order_notes(spark, sf))
    return d.select("path", E("content_kind").alias("kind"), F.size("user_entries").cast("bigint").alias("n_keys"), F.size("headings").cast("bigint").alias("n_headings"), F.size("parse_diagnostics").cast("bigint").alias("n_diagnostics"))


@query("SELECT concat('pages/page-', page_id, '.html') AS path, 'wrapped' AS kind FROM pages UNION ALL SELECT concat('docs/', coalesce(lang, 'xx'), '/doc-', doc_id, '.md'), 'markdown' FROM documents")
def p11_content_kind(spark, sf):
    both = corpora.wrapped_pages(spark, sf).unionByName(corpora.text_docs(spark, sf))
    return both.select("path", fm.content_kind(E("path")).alias("kind"))


@query("SELECT r_regionkey::bigint AS r_regionkey, concat('---', chr(10), 'key: ', r_regionkey, chr(10), 'name: ', r_name, chr(10), '---', chr(10), 'Region.') AS content, NULL::varchar AS error FROM region")
def p12_encode(spark, sf):
    r = spark.read.parquet(f"{sf}/region.parquet").select(E("r_regionkey").alias("key"), E("r_name").alias("name"), F.lit("Region.").alias("text"))
    d = r.withColumn("x", codec.encode(r, body="text"))
    return d.select(E("key").cast("bigint").alias("r_regionkey"), "x.content", "x.error")


@query(f"SELECT path, k::bigint AS id, s AS status, c::bigint AS customer, length(body)::bigint AS n_body, NULL::varchar AS error FROM ({NOTES})")
def p13_decode(spark, sf):
    d = codec.decode(corpora.order_notes(spark, sf), "id bigint, status string, customer bigint", body="text")
    return d.select("path", "value.id", "value.status", "value.customer", F.length("value.text").cast("bigint").alias("n_body"), "error")


@query(f"SELECT path, k % 5 <> 0 AS present, CASE WHEN k % 5 <> 0 THEN 'string' END AS kind, CASE WHEN k % 5 <> 0 THEN d END AS value FROM ({NOTES})")
def f01_get(spark, sf):
    return collection.get(notes(spark, sf), "date")


@query(f"SELECT path, concat(lower(s), ', ', pr) AS inline, concat('- ', lower(s), chr(10), '- ', pr) AS bullets, concat('1. ', lower(s), chr(10), '2. ', pr) AS numbered FROM ({NOTES})")
def f02_text_formats(spark, sf):
    v = fm.entry(E("fm.entries"), "tags")
    return notes(spark, sf).select("path", collection.as_text(v).alias("inline"), collection.as_text(v, "bullets").alias("bullets"), collection.as_text(v, "numbered").alias("numbered"))


@query(f"SELECT path, k % 4 = 0 AS has FROM ({NOTES})")
def f03_has(spark, sf):
    return notes(spark, sf).select("path", fm.has(E("fm.entries"), "discount").alias("has"))


@query(f"SELECT path, concat('cents,customer,', CASE WHEN k % 5 <> 0 THEN 'date,' ELSE '' END, CASE WHEN k % 4 = 0 THEN 'discount,' ELSE '' END, 'id,status,tags') AS keys FROM ({NOTES})")
def f04_list_keys(spark, sf):
    return collection.keys(notes(spark, sf)).select("path", F.array_join("keys", ",").alias("keys"))


@query(f"SELECT path, concat('---', chr(10), raw, chr(10), '---', chr(10)) AS text FROM ({NOTES})")
def f05_dump(spark, sf):
    return export.dump(notes(spark, sf), "yaml", delimiters=True)


@query("""WITH a AS (SELECT p_partkey AS k FROM part UNION ALL SELECT s_suppkey FROM supplier), b AS (SELECT CASE WHEN k % 13 = 0 THEN 'noFrontMatter' ELSE 'frontMatter' END AS category FROM a UNION ALL SELECT unnest(['noFrontMatter', 'noFrontMatter']))
SELECT category, count(*) AS n FROM b GROUP BY category""")
def f06_categories(spark, sf):
    return collection.categories(fm.with_frontmatter(corpora.bundle(spark, sf))).groupBy("category").agg(F.count("*").alias("n"))


@query(f"SELECT path, s AS status FROM ({NOTES}) WHERE s = 'F'")
def f07_fm_search(spark, sf):
    return collection.search(notes(spark, sf), "status == 'F'").select("path", fm.entry(E("fm.entries"), "status")["text"].alias("status"))


@query(f"SELECT path FROM ({NOTES}) WHERE (pr = '1-urgent' OR cents > 20000000) AND NOT (s = 'O') AND k % 5 <> 0")
def f07_search_compound(spark, sf):
    return collection.search(notes(spark, sf), "(contains(tags, '1-urgent') || cents > `20000000`) && status != 'O' && date").select("path")


@query(f"SELECT path FROM ({NOTES}) WHERE lower(s) = 'p' AND starts_with(pr, '2')")
def f07_search_interpreted(spark, sf):
    return collection.search(notes(spark, sf), "tags[0] == 'p' && length(tags[?starts_with(@, '2')]) == `1`").select("path")


@query(f"SELECT 'number' AS vtype, c::varchar AS v, count(*) AS n FROM ({NOTES}) GROUP BY c HAVING count(*) > 1")
def f08_unique_collisions(spark, sf):
    return collection.duplicate_counts(collection.scalars(notes(spark, sf), "customer"))


@query(f"SELECT 'number' AS vtype, c::varchar AS v, count(*) AS n, string_agg(path, ',' ORDER BY path) AS paths FROM ({NOTES}) GROUP BY c HAVING count(*) > 1")
def f08_unique_paths(spark, sf):
    return collection.duplicates(collection.scalars(notes(spark, sf), "customer")).select("vtype", "v", "n", F.array_join("paths", ",").alias("paths"))


@query(f"WITH n AS ({NOTES}) SELECT path, c::varchar AS v FROM n WHERE path <> 'orders/order-7.md' AND c = (SELECT c FROM n WHERE path = 'orders/order-7.md')")
def f09_unique_reference(spark, sf):
    return collection.collisions_with(collection.scalars(notes(spark, sf), "customer"), "orders/order-7.md").select("path", "v")


@query(f"WITH n AS ({NOTES}), g AS (SELECT d FROM n WHERE k % 5 <> 0 GROUP BY d HAVING count(*) > 1) SELECT count(*) AS n_records, count_if(k % 5 <> 0)::bigint AS n_value, count_if(k % 5 = 0)::bigint AS n_missing, 0::bigint AS n_null, 0::bigint AS n_error, (SELECT count(*) FROM g) AS n_collisions, (SELECT count(*) FROM g) = 0 AS passed FROM n")
def f10_unique_report(spark, sf):
    return collection.unique_report(collection.scalars(notes(spark, sf), "date"))


@query(f"SELECT path, CASE WHEN k % 4 = 0 THEN 'null' ELSE 'missing' END AS status FROM ({NOTES})")
def f11_scalar_status(spark, sf):
    return collection.scalars(notes(spark, sf), "discount").select("path", "status")


def _changed(sql_raw: str) -> str:
    return f"SELECT path, md5(concat('---', chr(10), {sql_raw}, chr(10), '---', chr(10), body)) AS content FROM ({NOTES})"


def _md5(d: DataFrame) -> DataFrame:
    return d.select("path", F.md5("content").alias("content"))


@query(_changed("concat(replace(raw, concat('status: ', s), 'status: done'), chr(10), 'owner: me')"))
def f12_set(spark, sf):
    e = collection.set_key(collection.set_key(E("fm.entries"), "status", "done"), "owner", "me")
    return _md5(collection.rewrite(notes(spark, sf), e))


@query(_changed("replace(raw, concat('cents: ', cents, chr(10)), '')"))
def f13_remove(spark, sf):
    return _md5(collection.rewrite(notes(spark, sf), collection.remove_key(E("fm.entries"), "cents")))


@query(f"SELECT path, CASE WHEN k % 5 = 0 THEN 'key-not-found' END AS error, md5(concat('---', chr(10), CASE WHEN k % 5 = 0 THEN raw ELSE concat(replace(raw, concat(chr(10), 'date: ', d), ''), chr(10), 'day: ', d) END, chr(10), '---', chr(10), body)) AS content FROM ({NOTES})")
def f14_rename(spark, sf):
    e, error = collection.rename_key(E("fm.entries"), "date", "day")
    d = notes(spark, sf)
    return d.select("path", error.alias("error"), F.md5(fm.render(e, E("body"), E("form"))).alias("content"))


@query(_changed("concat(raw, CASE WHEN k % 4 = 0 THEN '' ELSE concat(chr(10), 'discount: null') END, chr(10), 'note: null')"))
def f15_touch(spark, sf):
    return _md5(collection.rewrite(notes(spark, sf), collection.touch(E("fm.entries"), ["discount", "note"])))


@query(f"SELECT path, concat('cents,customer,', CASE WHEN k % 5 <> 0 THEN 'date,' ELSE '' END, CASE WHEN k % 4 = 0 THEN 'discount,' ELSE '' END, 'id,status,tags') AS up, concat('id,', CASE WHEN k % 5 <> 0 THEN 'date,' ELSE '' END, 'tags,cents,status,customer', CASE WHEN k % 4 = 0 THEN ',discount' ELSE '' END) AS by_length, concat('tags,status,id,', CASE WHEN k % 4 = 0 THEN 'discount,' ELSE '' END, CASE WHEN k % 5 <> 0 THEN 'date,' ELSE '' END, 'customer,cents') AS down FROM (SELECT * REPLACE (k AS k) FROM ({NOTES}))")
def f16_sort_keys(spark, sf):
    names = lambda e: F.array_join(F.transform(e, lambda x: x["key"]), ",")
    e = E("fm.entries")
    # Equal lengths keep their order: date stands before tags in the notes.
    return notes(spark, sf).select("path", names(collection.sort_keys(e)).alias("up"), names(collection.sort_keys(e, "length")).alias("by_length"), names(collection.sort_keys(e, reverse=True)).alias("down"))


@query(_changed("concat('title: New', chr(10), 'n: 3')"))
def f17_replace(spark, sf):
    return _md5(collection.rewrite(notes(spark, sf), collection.replace_all('{"title": "New", "n": 3}', "json")))


@query(f"SELECT path, md5(body) AS content FROM ({NOTES})")
def f18_remove_frontmatter(spark, sf):
    return _md5(notes(spark, sf).select("path", E("body").alias("content")))


@query(f"SELECT path, 'has' AS test FROM ({NOTES}) WHERE pr = '1-urgent' UNION ALL SELECT path, 'not' FROM ({NOTES}) WHERE lower(s) <> 'f'")
def f19_array_contains(spark, sf):
    d = notes(spark, sf)
    a = collection.array_contains(d, "tags", "1-URGENT", ignore_case=True).select("path", F.lit("has").alias("test"))
    return a.unionByName(collection.array_contains(d, "tags", "f", invert=True).select("path", F.lit("not").alias("test")))


@query(_changed("replace(raw, concat('  - ', pr), CASE WHEN pr = '1-urgent' THEN concat('  - ', pr) ELSE concat('  - ', pr, chr(10), '  - 1-urgent') END)"))
def f20_array_append(spark, sf):
    e, _ = collection.edit_array(E("fm.entries"), "tags", "1-urgent", "append", skip_duplicates=True)
    return _md5(collection.rewrite(notes(spark, sf), e))


@query(_changed("replace(raw, concat('tags:', chr(10)), concat('tags:', chr(10), '  - first', chr(10)))"))
def f21_array_prepend(spark, sf):
    e, _ = collection.edit_array(E("fm.entries"), "tags", "first", "prepend")
    return _md5(collection.rewrite(notes(spark, sf), e))


@query(f"SELECT path, CASE WHEN lower(s) <> 'f' THEN 'value-not-found' END AS error, CASE WHEN lower(s) = 'f' THEN pr ELSE concat(lower(s), ',', pr) END AS tags FROM ({NOTES})")
def f22_array_remove(spark, sf):
    e, error = collection.edit_array(E("fm.entries"), "tags", "f", "remove")
    return notes(spark, sf).select("path", error.alias("error"), F.array_join(F.from_json(fm.entry(e, "tags")["json"], "array<string>"), ",").alias("tags"))


@query("SELECT concat('pages/page-', page_id, '.html') AS path, md5(concat('<!--', chr(10), '---', chr(10), 'page: ', page_id, chr(10), 'seen: x', chr(10), '---', chr(10), '-->', chr(10), coalesce(html, ''))) AS content FROM pages")
def f23_wrapped_render(spark, sf):
    d = fm.with_wrapped_frontmatter(corpora.wrapped_pages(spark, sf))
    e = collection.set_key(collection.remove_key(E("fm.entries"), "url"), "seen", "x")
    return d.select("path", F.md5(fm.render_wrapped(E("content"), E("block"), e, E("form"))).alias("content"))


@query(f"""SELECT path, md5(concat('+++', chr(10), 'cents = ', cents, chr(10), 'customer = ', c, chr(10), CASE WHEN k % 5 <> 0 THEN concat('date = "', d, '"', chr(10)) ELSE '' END, 'id = ', k, chr(10), 'status = "', s, '"', chr(10), 'tags = ["', lower(s), '", "', pr, '"]', chr(10), '+++', chr(10), body)) AS content FROM ({NOTES})""")
def f24_convert_toml(spark, sf):
    return _md5(collection.rewrite(notes(spark, sf), collection.remove_key(E("fm.entries"), "discount"), "toml"))


FIELD_TESTS = (
    ("equals", "status", "F", "s = 'F'"), ("doesntEqual", "status", "F", "s <> 'F'"), ("includes", "tags", "f", "lower(s) = 'f'"), ("notIncludes", "tags", "f", "lower(s) <> 'f'"), ("hasKey", "discount", None, "k % 4 = 0"), ("doesntHaveKey", "date", None, "k % 5 = 0"),
    ("regex", "date", "-0[1-3]-", "k % 5 <> 0 AND regexp_matches(d, '-0[1-3]-')"), ("startsWith", "date", "199", "k % 5 <> 0 AND starts_with(d, '199')"), ("endsWith", "date", "1", "k % 5 <> 0 AND ends_with(d, '1')"), ("contains", "date", "-1", "k % 5 <> 0 AND contains(d, '-1')"),
    ("empty", "discount", None, "false"), ("emptyString", "status", None, "false"), ("emptyArray", "tags", None, "false"), ("emptyObject", "tags", None, "false"), ("notEmpty", "discount", None, "k % 4 = 0"),
    ("in", "status", ["F", "P"], "s IN ('F', 'P')"), ("notIn", "status", ["F", "P"], "s NOT IN ('F', 'P')"), ("greaterThan", "cents", 10_000_000, "cents > 10000000"), ("greaterThanOrEqual", "customer", 50, "c >= 50"), ("lessThan", "cents", 10_000_000, "cents < 10000000"), ("lessThanOrEqual", "customer", 50, "c <= 50"),
    ("after", "date", "1995-06-17", "k % 5 <> 0 AND d > '1995-06-17'"), ("onOrAfter", "date", "1995-06-17", "k % 5 <> 0 AND d >= '1995-06-17'"), ("before", "date", "1995-06-17", "k % 5 <> 0 AND d < '1995-06-17'"), ("onOrBefore", "date", "1995-06-17T00:00:00Z", "false"),
    ("between", "cents", [5_000_000, 20_000_000], "cents BETWEEN 5000000 AND 20000000"), ("typeIs", "discount", "null", "k % 4 = 0"),
)


def _counted(tests) -> str:
    return f"WITH n AS ({NOTES}) " + " UNION ALL ".join(f"SELECT '{name}' AS test, count_if({cond})::bigint AS n FROM n" for name, cond in tests)


def _stack(d: DataFrame, tests: list[tuple[str, F.Column]]) -> DataFrame:
    """test, n of boolean Columns, from one aggregate over one pass."""
    one = d.agg(*(F.count_if(c).alias(f"c{i}") for i, (_, c) in enumerate(tests)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("test"), F.col(f"c{i}").cast("bigint").alias("n")) for i, (name, _) in enumerate(tests)))).alias("x")).select("x.*")


@query(_counted([(op, cond) for op, _, _, cond in FIELD_TESTS]))
def q01_field_operators(spark, sf):
    return _stack(notes(spark, sf), [(op, predicates.field(E("fm.entries"), key, op, operand)) for op, key, operand, _ in FIELD_TESTS])


RECORD_TESTS = (
    ("pathRegex", "order-1", "contains(path, 'order-1')"), ("filenameEquals", "order-7.md", "k = 7"), ("extensionIn", ["MD"], "true"), ("modifiedAfter", "1995-06-17", "d > '1995-06-17'"), ("modifiedBefore", "1995-06-17", "d < '1995-06-17'"),
    ("hasHeading", "Notes", "true"), ("hasHeadingAtLevel", (1, "Notes"), "false"), ("headingRegex", "^Order 1", "starts_with(k::varchar, '1')"), ("hasSection", "Notes", "k % 3 <> 0"), ("bodyContains", "Placed on", "k % 3 <> 0"), ("bodyRegex", r"missing-\d+", "k % 10 = 0"),
    ("hasWikilink", "customer-7", "c = 7"), ("lineCount", (None, 6), "n_lines <= 6"), ("wordCount", (10, None), "8 + 2 * (k % 10 = 0)::int + 3 * (k % 3 <> 0)::int >= 10"),
)


@query(_counted([(n, c) for n, _, c in RECORD_TESTS] + [("paths", "k % 2 = 1 AND k::varchar LIKE '1%'"), ("glob", "true")]))
def d01_record_predicates(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("orders/order-"), E("o_orderkey").cast("string"), F.lit(".md")).alias("path"), E("o_orderdate").cast("timestamp").alias("modification_ts"))
    d = analysis.analyze(corpora.order_notes(spark, sf).join(o, "path"), wikilinks=True)
    tests = [(n, predicates.record(n, v)) for n, v, _ in RECORD_TESTS]
    odd = predicates.path_matches(E("path"), ["orders/order-1*.md"], [f"**/*{k}.md" for k in (0, 2, 4, 6, 8)])
    return _stack(d, [*tests, ("paths", odd), ("glob", predicates.path_matches(E("path"), ["**/order-*.md"]))])


@query("SELECT concat('docs/', coalesce(lang, 'xx'), '/doc-', doc_id, '.md') AS path, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END::bigint AS n_lines, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''))::bigint AS n_words FROM documents")
def t08_counts(spark, sf):
    s = fm.split(E("content"))["body"]
    d = corpora.text_docs(spark, sf).select("path", s.alias("body"))
    return d.select("path", predicates.n_lines(E("body")).alias("n_lines"), predicates.n_words(E("body")).alias("n_words"))


@query(f"SELECT path, body FROM ({NOTES})")
def s24_body(spark, sf):
    return corpora.order_notes(spark, sf).select("path", fm.split(E("content"))["body"].alias("body"))


@query(f"SELECT path, concat('For [[customer-', c, '|the customer]].') AS line, 3::bigint AS number FROM ({NOTES})")
def s21_lines(spark, sf):
    d = corpora.order_notes(spark, sf).select("path", fm.split(E("content"))["body"].alias("body"))
    return d.select("path", bodies.line_range(E("body"), 3, 3).alias("line"), bodies.line_of(E("body"), F.instr("body", "For") - 1).cast("bigint").alias("number"))


#: Values by a nation's key modulo 8, as YAML and what they are.
BLANKS = (("''", "emptyString"), ("[]", "emptyArray"), ("{}", "emptyObject"), ("null", None), ("0", None), ("' '", None), ("[x]", None), ("2021-02-03T04:05:06Z", None))
#: operator, operand, the remainders (modulo 8) for which it holds.
BLANK_TESTS = (
    ("empty", True, (0, 1, 2)), ("emptyString", True, (0,)), ("emptyArray", True, (1,)), ("emptyObject", True, (2,)), ("notEmpty", True, (3, 4, 5, 6, 7)), ("typeIs", "null", (3,)), ("typeIs", "number", (4,)), ("typeIs", "array", (1, 6)), ("typeIs", "object", (2,)),
    ("includes", "x", (6,)), ("notIncludes", "x", (1,)), ("equals", 0, (4,)), ("doesntEqual", 0, (0, 1, 2, 3, 5, 6, 7)), ("in", ["", 0], (0, 4)), ("notIn", ["", 0], (1, 2, 3, 5, 6, 7)), ("after", "2021-02-03T04:05:05Z", (7,)), ("onOrAfter", "2021-02-03", (7,)), ("before", "2021-02-04", (7,)), ("between", ("2021-02-03", "2021-02-03"), (7,)), ("doesntHaveKey", True, ()),
)


@query("WITH n AS (SELECT n_nationkey % 8 AS m FROM nation) " + " UNION ALL ".join(f"SELECT '{i} {op}' AS test, count_if(m IN ({', '.join(map(str, (*held, -1)))}))::bigint AS n FROM n" for i, (op, _, held) in enumerate(BLANK_TESTS)))
def q11_blank_values(spark, sf):
    k = E("n_nationkey") % 8
    value = F.lit("")
    for i, (text, _) in enumerate(BLANKS):
        value = F.when(k == i, F.lit(text)).otherwise(value)
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("n/"), E("n_nationkey").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("---\nv: "), value, F.lit("\n---\nBody\n")).alias("content"))
    return _stack(fm.with_frontmatter(n), [(f"{i} {op}", predicates.field(E("fm.entries"), "v", op, operand)) for i, (op, operand, _) in enumerate(BLANK_TESTS)])
