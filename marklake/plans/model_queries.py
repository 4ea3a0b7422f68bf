"""Queries on types, rules, identities, bundles, exports, stores and served selections (C, Y, R, I, K, A, V, W, IO rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.functions import frontmatter as fm
from marklake.functions import jsonschema
from marklake.operators import analysis, collection, configuration, endpoints, export, identity, okf, rules, serve, store, types
from marklake.plans.registry import NOTES, query
from marklake.sources import corpora, files

E = F.col

ORDER_SCHEMA = {"type": "object", "required": ["id", "status"], "properties": {"id": {"type": "integer", "minimum": 0}, "status": {"enum": ["F", "O"]}, "date": {"type": "string", "pattern": "^\\d{4}-\\d{2}-\\d{2}$"}, "tags": {"type": "array", "minItems": 2, "items": {"type": "string"}}}}
ORDER_TYPE = {
    "name": "order", "version": "1.0.0", "frontmatter": {"presence": "required", "schemas": [{"id": "schema", "schema": ORDER_SCHEMA}]},
    "body": {"constraints": [{"id": "h", "heading": {"text": "Notes", "level": 2}}, {"id": "s", "section": {"heading": "Notes", "content": "nonEmpty"}}, {"id": "l", "maxBodyLines": 8}, {"id": "w", "maxBodyWords": 11}]},
    "context": {"constraints": [{"id": "p", "path": {"glob": "orders/*.md"}}]},
}
FREE_TYPE = {"name": "free", "version": "2.1.0", "body": {"constraints": [{"id": "r", "headingRelationship": {"parent": "Atlas", "child": "Notes", "relationship": "descendant"}}]}}
NOTE_TYPE = {"name": "note", "version": "1.0.0", "frontmatter": {"schemas": [{"id": "date", "schema": {"required": ["date"]}}]}}


def registry() -> types.Registry:
    return types.Registry.of([types.from_mapping(t) for t in (ORDER_TYPE, FREE_TYPE, NOTE_TYPE)])


def analyzed(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.analyze(corpora.order_notes(spark, sf))


#: What fails for the order type, as conditions on the tables.
_FAILS = (("frontmatter.schema.invalid", "s NOT IN ('F', 'O')"), ("body.section.empty-or-missing", "k % 3 = 0"), ("body.lines.maximum", "n_lines > 8"), ("body.words.maximum", "8 + 2 * (k % 10 = 0)::int + 3 * (k % 3 <> 0)::int > 11"))
_CONFORMS = " AND ".join(f"NOT ({c})" for _, c in _FAILS)


@query(f"WITH n AS ({NOTES}) " + " UNION ALL ".join(f"SELECT path, '{code}' AS code FROM n WHERE {cond}" for code, cond in _FAILS))
def c01_type_diagnostics(spark, sf):
    d = types.assess_all(analyzed(spark, sf), registry())
    a = F.get(F.filter("assessments", lambda x: x["subject"] == "order"), F.lit(0))
    return d.select("path", F.explode(a["diagnostics"]).alias("d")).select("path", "d.code")


@query(f"SELECT path, 'frontmatter.schema.required-property' AS code, 'date' AS location FROM ({NOTES}) WHERE k % 5 = 0")
def c08_json_schema(spark, sf):
    d = fm.with_frontmatter(corpora.order_notes(spark, sf))
    return d.select("path", F.explode(jsonschema.diagnostics(E("fm.json"), {"required": ["date"], "properties": {"cents": {"type": "integer"}}}, "x")).alias("d")).select("path", "d.code", "d.location")


@query(f"SELECT path, array_to_string(list_filter([CASE WHEN k % 5 <> 0 THEN 'note' END, CASE WHEN {_CONFORMS} THEN 'order' END], lambda x: x IS NOT NULL), ',') AS types FROM ({NOTES})")
def j10_assess_types(spark, sf):
    return types.assess_all(analyzed(spark, sf), registry()).select("path", F.array_join(types.conforming(E("assessments")), ",").alias("types"))


@query(f"SELECT subject, count_if(ok)::bigint AS n FROM (SELECT 'order' AS subject, {_CONFORMS} AS ok FROM ({NOTES}) UNION ALL SELECT 'free', false FROM ({NOTES}) UNION ALL SELECT 'note', k % 5 <> 0 FROM ({NOTES})) GROUP BY subject")
def a11_conforming_counts(spark, sf):
    d = types.assess_all(analyzed(spark, sf), registry()).select(F.explode("assessments").alias("a"))
    return d.groupBy("a.subject").agg(F.count_if("a.conforms").alias("n"))


@query("SELECT concat('h/', n_nationkey, '.md') AS path, unnest(['note', 'note', 'none']) AS name, unnest([NULL, '9.0.0', NULL]) AS version, unnest([CASE WHEN n_nationkey % 2 = 0 THEN 'confirmed' ELSE 'rejected' END, 'unavailableVersion', 'unknownType']) AS status FROM nation")
def y05_type_hints(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    text = F.concat(F.lit(f'---\n{fm.SYSTEM_KEY}:\n  typeHints: [note, {{name: note, version: "9.0.0"}}, none]\n'), F.when(E("n_nationkey") % 2 == 0, 'date: "2020-01-01"\n').otherwise(""), F.lit("---\nBody\n"))
    d = n.select(F.concat(F.lit("h/"), E("n_nationkey").cast("string"), F.lit(".md")).alias("path"), text.alias("content"))
    return types.verify_hints(types.assess_all(analysis.analyze(d), registry()), registry())


@query(f"SELECT path, CASE WHEN k % 5 = 0 THEN md5(concat('---', chr(10), raw, chr(10), 'date: today', chr(10), '---', chr(10), body)) ELSE md5(concat('---', chr(10), raw, chr(10), '---', chr(10), body)) END AS content, '' AS open FROM ({NOTES})")
def y06_fix_types(spark, sf):
    note = next(t for t in registry().types if t.name == "note")
    d = corpora.order_notes(spark, sf).withColumn("x", types.fix(E("content"), note, {"date": "today"}))
    return d.select("path", F.md5("x.content").alias("content"), F.array_join("x.open", ",").alias("open"))


RULES = {
    "version": "0.2.0",
    "rules": [
        {"name": "dated", "match": {"paths": ["orders/*.md"], "frontmatter": {"date": {"hasKey": True}}}, "checks": [{"id": "c1", "maxBodyWords": 11}]},
        {"name": "open", "match": {"frontmatterQuery": {"jmespath": "status == 'O'"}, "document": {"hasSection": "Notes"}}, "checks": [{"id": "c2", "requiredHeading": "Notes"}]},
        {"name": "strict", "match": {"paths": ["orders/order-1*.md"]}, "checks": [{"id": "c3", "frontmatterSchema": ORDER_SCHEMA}]},
        {"name": "elsewhere", "match": {"paths": ["other/**"]}, "checks": [{"id": "c4", "maxBodyLines": 1}]},
        {"name": "typed", "match": {"allTypes": ["note"], "document": {"wordCount": {"min": 11}}}, "checks": [{"id": "c5", "maxBodyLines": 8, "severity": "warning"}]},
    ],
}


def compiled() -> rules.Compiled:
    return rules.Compiled.of(rules.decode(RULES), registry())


_WORDS = "8 + 2 * (k % 10 = 0)::int + 3 * (k % 3 <> 0)::int"
#: rule, applies, fails
_RULES = (("dated", "k % 5 <> 0", f"{_WORDS} > 11"), ("open", "s = 'O' AND k % 3 <> 0", "false"), ("strict", "starts_with(k::varchar, '1')", "s NOT IN ('F', 'O')"), ("elsewhere", "false", "false"), ("typed", f"k % 5 <> 0 AND {_WORDS} >= 11", "false"))
_RULE_ROWS = f"WITH n AS ({NOTES}), r AS (" + " UNION ALL ".join(f"SELECT path, '{r}' AS rule, CASE WHEN NOT ({a}) THEN 'notApplicable' WHEN {f} THEN 'failed' ELSE 'passed' END AS status FROM n" for r, a, f in _RULES) + ")"


@query(f"{_RULE_ROWS} SELECT path, rule, status FROM r")
def r03_rules_validate(spark, sf):
    return rules.assess_all(analyzed(spark, sf), compiled()).select("path", "rule", "status")


@query(f"{_RULE_ROWS} SELECT path FROM r WHERE rule = 'open' AND status <> 'notApplicable'")
def r05_files_matching(spark, sf):
    return rules.files_matching(analyzed(spark, sf), compiled(), "open")


@query("SELECT 'dated' AS rule, unnest(['paths', 'frontmatter.date.hasKey']) AS predicate, unnest(['matched', 'notMatched']) AS result UNION ALL SELECT 'strict', 'paths', 'matched' UNION ALL SELECT 'elsewhere', 'paths', 'notMatched' UNION ALL SELECT 'open', unnest(['hasSection', 'frontmatterQuery']), unnest([CASE WHEN o_orderkey % 3 <> 0 THEN 'matched' ELSE 'notMatched' END, CASE WHEN o_orderstatus = 'O' THEN 'matched' ELSE 'notMatched' END]) FROM orders WHERE o_orderkey = 10 UNION ALL SELECT 'typed', unnest(['wordCount', 'allTypes']), unnest(['matched', 'notMatched'])")
def r06_rules_of_file(spark, sf):
    d = analysis.analyze(corpora.order_notes(spark, sf).filter("path = 'orders/order-10.md'"))
    return rules.explain(rules.assess_all(d, compiled()), "orders/order-10.md").select("rule", "predicate", "result")


@query(f"{_RULE_ROWS} SELECT count_if(status <> 'notApplicable')::bigint AS n_matches, count(DISTINCT CASE WHEN status <> 'notApplicable' THEN path END)::bigint AS n_files, count_if(status = 'failed')::bigint AS n_errors, 0::bigint AS n_skipped, count_if(status = 'failed')::bigint AS n_failed, count_if(status = 'passed')::bigint AS n_passed FROM r")
def a03_rule_summary(spark, sf):
    return rules.summary(rules.assess_all(analyzed(spark, sf), compiled()))


@query("WITH e AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT concat('events/event-', event_id, '.md') AS path, user_id::varchar AS identity, CASE WHEN n > 1 THEN 'duplicate' ELSE 'available' END AS status FROM e")
def i01_identity(spark, sf):
    d = analysis.analyze(corpora.event_props(spark, sf), structure=False)
    return identity.assess(d, identity.Policy("frontmatter", ("user",), "integer")).select("path", "identity", E("identity_status").alias("status"))


@query(f"SELECT path, CASE WHEN k % 5 = 0 THEN 'identity.frontmatter.missing' ELSE 'identity.frontmatter.invalid-uuid' END AS uuid, CASE WHEN lower(s) <> s THEN 'identity.frontmatter.invalid-slug' END AS strict, CASE WHEN true THEN 'identity.frontmatter.unsupported-value' END AS int_of_text FROM ({NOTES})")
def i02_identity_formats(spark, sf):
    d = analysis.analyze(corpora.order_notes(spark, sf), structure=False).select("path", "user_json", "parse_diagnostics")
    code = lambda path, form, name: identity.assess(d, identity.Policy("frontmatter", path, form)).select("path", F.when(E("identity_code") == identity.CODES[9], None).otherwise(E("identity_code")).alias(name))
    return code(("date",), "uuid", "uuid").join(code(("status",), "slug:strictASCII", "strict"), "path").join(code(("status",), "integer", "int_of_text"), "path")


@query("SELECT 'identity.primary.duplicate' AS code, user_id::varchar AS key, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def a02_identity_collisions(spark, sf):
    d = analysis.analyze(corpora.event_props(spark, sf), structure=False)
    return identity.collisions(identity.assess(d, identity.Policy("frontmatter", ("user",), "integer"))).select("code", "key", "n")


@query("WITH k AS (SELECT unnest(['0', '1', '999999999']) AS key), e AS (SELECT user_id::varchar AS key, count(*) AS n FROM events GROUP BY user_id) SELECT key, CASE WHEN n IS NULL THEN 'notFound' WHEN n = 1 THEN 'record' ELSE 'conflict' END AS result, coalesce(n, 0) AS n FROM k LEFT JOIN e USING (key)")
def w10_identity_lookup(spark, sf):
    d = identity.assess(analysis.analyze(corpora.event_props(spark, sf), structure=False), identity.Policy("frontmatter", ("user",), "integer"))
    keys = spark.createDataFrame([("0",), ("1",), ("999999999",)], "key string")
    return identity.lookup(d, keys).select("key", "result", F.coalesce(F.size("candidates"), F.lit(0)).cast("bigint").alias("n"))


_BUNDLE = "SELECT concat('parts/part-', p_partkey, '.md') AS path, p_partkey AS k, p_type AS t FROM part UNION ALL SELECT concat('suppliers/supplier-', s_suppkey, '.md'), s_suppkey, 'Supplier' FROM supplier"


@query(f"""SELECT path, CASE WHEN k % 13 = 0 THEN 'frontmatter' ELSE 'frontmatter.type' END AS location, CASE WHEN k % 13 = 0 THEN 'required by OKF v0.1 draft concept documents' WHEN k % 7 = 0 THEN 'missing required field "type"' ELSE 'must not be empty' END AS message FROM ({_BUNDLE}) WHERE k % 13 = 0 OR k % 7 = 0 OR k % 11 = 0 UNION ALL SELECT 'log.md', 'line 7', 'expected ISO date heading like "## 2026-06-20"'""")
def k01_okf_validate(spark, sf):
    return okf.issues(okf.prepare(corpora.bundle(spark, sf)))


@query(f"SELECT location, count(*) AS n FROM (SELECT 'frontmatter' AS location FROM ({_BUNDLE}) WHERE k % 13 <> 0 UNION ALL SELECT 'body' FROM ({_BUNDLE}) WHERE k % 13 <> 0 AND k % 5 = 0) GROUP BY location")
def k02_okf_advisories(spark, sf):
    return okf.advisories(okf.prepare(corpora.bundle(spark, sf))).groupBy("location").agg(F.count("*").alias("n"))


@query("SELECT concat('c/', r_regionkey, '.md') AS path, concat('---', chr(10), 'tags:', chr(10), '  - a', chr(10), 'type: concept', chr(10), '---', chr(10), 'Body', chr(10)) AS content FROM region WHERE r_regionkey % 2 = 0")
def k03_okf_set_type(spark, sf):
    r = spark.read.parquet(f"{sf}/region.parquet")
    tag = F.when(E("r_regionkey") % 2 == 0, "a").otherwise("b")
    d = r.select(F.concat(F.lit("c/"), E("r_regionkey").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("---\ntags:\n  - "), tag, F.lit("\n---\nBody\n")).alias("content"))
    return okf.set_type(okf.prepare(d), "concept", only_with=("tags", "a"))


@query(f"SELECT t AS type, count(*) AS n FROM ({_BUNDLE}) WHERE k % 13 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 GROUP BY t")
def a04_okf_types(spark, sf):
    return okf.type_counts(okf.prepare(corpora.bundle(spark, sf)))


@query(f"SELECT count(*) + 2 AS scanned, count(*) AS concepts, 2::bigint AS reserved, count_if(k % 13 <> 0 AND k % 5 <> 0 AND k % 3 = 0)::bigint AS citations, count_if(k % 13 <> 0 AND k % 5 = 0)::bigint AS empty_bodies FROM ({_BUNDLE})")
def a05_okf_counts(spark, sf):
    return okf.counts(okf.prepare(corpora.bundle(spark, sf)))


@query(f"SELECT path, CASE WHEN k % 2 = 0 THEN 'description,resource,tags,timestamp' ELSE 'resource,tags,timestamp' END AS missing FROM ({_BUNDLE}) WHERE k % 13 <> 0")
def a06_okf_missing_fields(spark, sf):
    return okf.missing_fields(okf.prepare(corpora.bundle(spark, sf))).select("path", F.array_join("missing", ",").alias("missing"))


@query("SELECT unnest(['cents', 'customer', 'date', 'discount', 'id', 'status', 'tags']) AS key")
def a07_key_union(spark, sf):
    return spark.createDataFrame([(k,) for k in export.key_union(fm.with_frontmatter(corpora.order_notes(spark, sf)))], "key string")


@query(f"""SELECT concat('order-', k, '.md,', path, ',', cents, ',', c, ',', CASE WHEN k % 5 <> 0 THEN d ELSE '' END, ',', '', ',', k, ',', s, ',"[""', lower(s), '"",""', pr, '""]"') AS line FROM ({NOTES})""")
def io12_csv(spark, sf):
    wide = export.table(fm.with_frontmatter(corpora.order_notes(spark, sf)), ("$relPath", "$fileName"), body=False)
    return export.csv_lines(wide)[1]


@query("SELECT concat('orders/order-', o_orderkey, '.md') AS path FROM orders ORDER BY path LIMIT 20")
def w01_first_by_path(spark, sf):
    return collection.page(corpora.order_notes(spark, sf).select("path"), "path", 20)


@query("SELECT concat('orders/order-', o_orderkey, '.md') AS path FROM orders WHERE concat('orders/order-', o_orderkey, '.md') > 'orders/order-2' ORDER BY path LIMIT 15")
def w03_page(spark, sf):
    query_ = {"root": "orders"}
    last = collection.read_token(collection.token(query_, "orders/order-2"), query_)
    return collection.page(corpora.order_notes(spark, sf).select("path"), "path", 15, after=last, prefix="orders")


@query("SELECT concat('orders/order-', o_orderkey, '.md') AS path FROM orders")
def w04_distinct_records(spark, sf):
    d = corpora.order_notes(spark, sf)
    return collection.distinct_records(d.unionByName(d)).select("path")


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'replaced' WHEN o_orderkey % 3 = 1 THEN 'revisionMismatch' ELSE 'deleted' END AS outcome, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'created', count(*) FROM region UNION ALL SELECT 'notFound', count(*) FROM region")
def io21_store_changes(spark, sf):
    held = store.load(corpora.order_notes(spark, sf).withColumn("identity", E("path")))
    k = F.regexp_extract("identity", r"order-(\d+)", 1).cast("bigint")
    op, expected = F.when(k % 3 == 2, "delete").otherwise("replace"), F.when(k % 3 == 1, 7).otherwise(1).cast("bigint")
    changes = held.select("identity", op.alias("op"), "path", F.lit("new").alias("content"), expected.alias("expected"))
    r = spark.read.parquet(f"{sf}/region.parquet")
    new = lambda kind: r.select(F.concat(F.lit(f"{kind}-"), E("r_regionkey").cast("string")).alias("identity"), F.lit(kind).alias("op"), F.lit("x.md").alias("path"), F.lit("new").alias("content"), F.lit(None).cast("bigint").alias("expected"))
    return store.apply(held, changes.unionByName(new("create")).unionByName(new("replace")))[1].groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT concat('orders/order-', o_orderkey, '.md') AS identity, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END::bigint AS revision FROM orders WHERE o_orderkey % 5 <> 0")
def io21_store_state(spark, sf):
    held = store.load(corpora.order_notes(spark, sf).withColumn("identity", E("path")))
    k = F.regexp_extract("identity", r"order-(\d+)", 1).cast("bigint")
    changes = held.filter((k % 2 == 0) | (k % 5 == 0)).select("identity", F.when(k % 5 == 0, "delete").otherwise("replace").alias("op"), "path", F.lit("new").alias("content"), F.lit(1).cast("bigint").alias("expected"))
    return store.apply(held, changes)[0].select("identity", "revision")


def plan() -> serve.Plan:
    made, bad = serve.compile_plan(serve.decode({"version": "1", "resources": [
        {"name": "notes", "selection": {"type": "note", "searchRoot": "orders"}, "identity": {"source": "frontmatter", "path": ["id"], "format": "integer"}}, {"name": "dated", "selection": {"rule": "dated"}}, {"name": "strict", "route": "/strict/orders", "selection": {"rule": "strict", "type": "order"}},
    ]}), compiled(), registry())
    assert made, bad
    return made


_MEMBERS = f"WITH n AS ({NOTES}), m AS (SELECT path, 'notes' AS resource, true AS valid, k::varchar AS identity FROM n WHERE k % 5 <> 0 UNION ALL SELECT path, 'dated', {_WORDS} <= 11, path FROM n WHERE k % 5 <> 0 UNION ALL SELECT path, 'strict', {_CONFORMS}, path FROM n WHERE starts_with(k::varchar, '1'))"


@query(f"{_MEMBERS} SELECT path, resource, valid, identity FROM m")
def v03_snapshot(spark, sf):
    return serve.memberships(corpora.order_notes(spark, sf), plan()).select("path", "resource", "valid", "identity")


@query(f"{_MEMBERS} SELECT path, string_agg(resource, ',' ORDER BY resource) AS resources, bool_and(valid) AS valid FROM m GROUP BY path")
def v04_envelopes(spark, sf):
    return serve.envelopes(serve.memberships(corpora.order_notes(spark, sf), plan())).select("path", F.array_join("resources", ",").alias("resources"), "valid")


@query("SELECT 200::bigint AS status, 'orders/order-7.md' AS path")
def io22_get_by_id(spark, sf):
    status, rows = serve.respond(serve.memberships(corpora.order_notes(spark, sf), plan()), plan(), "/notes", "7")
    return rows.select(F.lit(status).cast("bigint").alias("status"), "path")


@query("SELECT unnest(['/dated', '/dated/by-path/{path}', '/dated/{id}', '/notes', '/notes/by-path/{path}', '/notes/{id}', '/strict/orders', '/strict/orders/by-path/{path}', '/strict/orders/{id}']) AS path")
def io23_openapi_paths(spark, sf):
    return spark.createDataFrame([(p,) for p in serve.openapi(plan())["paths"]], "path string")


@query("SELECT unnest(['a/b.md', './a.md', '/a', 'a//b', 'a/../b', 'a/', 'a\\b', '']) AS path, unnest([NULL, NULL, 'absolute', 'empty-segment', 'dot-segment', 'trailing-slash', 'backslash', 'empty']) AS error")
def io09_logical_paths(spark, sf):
    d = spark.createDataFrame([(p,) for p in ("a/b.md", "./a.md", "/a", "a//b", "a/../b", "a/", "a\\b", "")], "path string")
    return d.select("path", files.path_error(E("path")).alias("error"))


@query("SELECT unnest(['rwxr-x---', 'rw-r--r--', '---------']) AS text")
def io18_permissions(spark, sf):
    return spark.createDataFrame([(0o750,), (0o644,), (0,)], "mode int").select(export.permissions(E("mode")).alias("text"))


#: A rule file of the older version and one of the newer.
OLD_FILE = {"schemaDirectory": "s/", "schemaRules": [{"name": "dated", "schema": "dated.json", "match": {"paths": ["orders/*7.md"], "frontmatter": {"date": {"hasKey": True}}}}, {"name": "free", "schema": "dated.json", "frontmatterRequired": False, "match": {"file": {"pathRegex": "order-1[0-9]\\.md$"}}}]}
NEW_FILE = {"configVersion": "0.2.0", "rules": [{"name": "headed", "match": {"document": {"hasHeadingAtLevel": {"heading": "Notes", "level": 2}, "lineCount": {"max": 6}}}, "checks": [{"type": "requiredHeading", "heading": "Notes"}, {"type": "maxBodyWords", "max": 9}]}, {"name": "cheap", "match": {"frontmatter": {"customer": {"between": {"from": 1, "to": 50}}, "status": {"in": ["F", "O"]}}}, "checks": [{"type": "frontmatterSchema", "schema": "dated.json"}]}]}


@query(f"""WITH n AS ({NOTES}) SELECT path, 'dated' AS rule, 'passed' AS status FROM n WHERE k % 10 = 7 AND k % 5 <> 0
UNION ALL SELECT path, 'free', CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'passed' END FROM n WHERE k BETWEEN 10 AND 19
UNION ALL SELECT path, 'headed', CASE WHEN {_WORDS} <= 9 THEN 'passed' ELSE 'failed' END FROM n WHERE n_lines <= 6
UNION ALL SELECT path, 'cheap', CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'passed' END FROM n WHERE c BETWEEN 1 AND 50 AND s IN ('F', 'O')""")
def r01_rule_files(spark, sf):
    load = {"s/dated.json": {"required": ["date"]}, "schemas/dated.json": {"required": ["date"]}}.__getitem__
    made, bad = configuration.compile_rules([*configuration.decode(OLD_FILE, load), *configuration.decode(NEW_FILE, load)], registry(), spark=spark)
    assert made, bad
    return rules.assess_all(analyzed(spark, sf), made).filter("status <> 'notApplicable'").select("path", "rule", "status")


@query("SELECT unnest(['rules[0].name', 'rules[1].name', 'rules[2].name', 'rules[3]', 'rules[4].applicability.requirements[0]', 'rules[4].applicability.requirements[1]', 'rules[5].capabilities', 'rules[6].applicability.types', 'rules[7].checks', 'rules[8].applicability.requirements[0]', 'rules[8].checks']) AS location, unnest(['rule.name.invalid', 'rule.name.duplicate', 'rule.name.duplicate', 'rule.identifier.duplicate', 'rule.operand.invalid', 'rule.operand.invalid', 'rule.capability.missing', 'rule.type.missing', 'rule.schema.unresolved', 'rule.feature.unsupported', 'rule.feature.unsupported']) AS code")
def r02_compile_codes(spark, sf):
    heading = rules.Check("c", "requiredHeading", "H")
    wrong = [
        rules.Rule(" a", ("*",)), rules.Rule("b", ("*",)), rules.Rule("b", ("*",)), rules.Rule("c", ("*",), checks=(heading, heading)), rules.Rule("d", fields=(("k", "regex", "(?P<n>x)"),), record=(("lineCount", (3, 1)),)),
        rules.Rule("e", query="a"), rules.Rule("f", any_types=("none",)), rules.Rule("g", ("*",), checks=(rules.Check("s", "frontmatterSchema", "gone.json"),)), rules.Rule("h", fields=(("k", "nope", 1),), checks=(rules.Check("x", "nope", 1),)),
    ]
    return spark.createDataFrame([x[:2] for x in configuration.diagnose(wrong, registry(), {"jmespath"}, spark)], "location string, code string")


def _endpoint(name: str, route: str, selection: dict, **more) -> dict:
    return {"name": name, "route": route, "operations": ["list", "get"], "selection": selection, **more}


SERVED = {"serverConfigVersion": "1", "resources": [
    _endpoint("notes", "/notes", {"mode": "type", "type": "note", "searchRoot": "orders/"}, identityPolicy={"source": "frontmatter", "path": ["id"], "format": "integer"}), _endpoint("dated", "/dated", {"mode": "rule", "rule": "dated"}, operations=["list"]),
    _endpoint("strict", "/strict/orders", {"mode": "ruleWithExpectedType", "rule": "strict", "type": "order"}, operationIDOverrides=[{"operation": "get", "operationID": "one"}]),
]}


@query(f"{_MEMBERS} SELECT resource, count(*) AS n, count_if(valid)::bigint AS n_valid FROM m GROUP BY resource")
def v01_configured_resources(spark, sf):
    made, bad = endpoints.compile_plan(SERVED, compiled(), registry())
    assert made, bad
    return serve.memberships(corpora.order_notes(spark, sf), made).groupBy("resource").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"))


@query("""SELECT * FROM (VALUES ('resources[0].name', 'endpoint.resource.invalid-name'), ('resources[0].route', 'endpoint.route.unsafe'), ('resources[1].name', 'endpoint.resource.duplicate-name'), ('resources[2].name', 'endpoint.resource.duplicate-name'), ('resources[2].operations', 'endpoint.operation.missing'),
('resources[3].operations', 'endpoint.operation.duplicate'), ('resources[3].operationIDOverrides[0]', 'endpoint.operation-id.duplicate-override'), ('resources[3].operationIDOverrides[1]', 'endpoint.operation-id.duplicate-override'), ('resources[3].operationIDOverrides[1].operationID', 'endpoint.operation-id.invalid'),
('resources[4].operationIDOverrides[0]', 'endpoint.operation-id.disabled-operation'), ('resources[4].selection.rule', 'endpoint.reference.rule-missing'), ('resources[5].selection.type', 'endpoint.reference.type-missing'), ('resources[5].selection.searchRoot', 'endpoint.selection.invalid-search-root'),
('resources[6].route', 'endpoint.route.reserved'), ('resources[7].operations.get', 'endpoint.route.collision'), ('resources[8].operations.list', 'endpoint.route.collision'), ('resources[8].operations.list', 'endpoint.operation-id.duplicate'), ('resources[9].operations.list', 'endpoint.operation-id.duplicate'), ('serverConfigVersion', 'endpoint.configuration.unsupported-version')) t(location, code)""")
def v02_plan_codes(spark, sf):
    rule = {"mode": "rule", "rule": "dated"}
    over = lambda *x: [{"operation": op, "operationID": i} for op, i in x]
    wrong = [
        _endpoint(" a", "/a/../b", rule), _endpoint("b", "/b", rule), _endpoint("b", "/c", rule, operations=[]), _endpoint("d", "/d", rule, operations=["get", "get"], operationIDOverrides=over(("get", "x"), ("get", " "))),
        _endpoint("e", "/e", {"mode": "rule", "rule": "none"}, operations=["list"], operationIDOverrides=over(("get", "y"))), _endpoint("f", "/f", {"mode": "type", "type": "none", "searchRoot": "../x/"}), _endpoint("g", f"/{endpoints.NAMESPACE}/x", rule),
        _endpoint("h", "/h", rule), _endpoint("i", "/h/list", rule, operations=["list"]), _endpoint("j", "/j", rule, operations=["list"], operationIDOverrides=over(("list", "i.list"))),
    ]
    version, found = endpoints.decode({"serverConfigVersion": "2", "resources": wrong})
    return spark.createDataFrame(endpoints.diagnose(version, found, compiled(), registry()), "location string, code string")


#: Fails in every part that it has: heading, relationship, path, presence, structure, syntax.
STRICT_TYPE = {
    "name": "strict", "version": "1.0.0", "frontmatter": {"presence": "required", "schemas": [{"id": "s", "schema": {"required": ["v"]}}]},
    "body": {"constraints": [{"id": "h", "heading": {"text": "Top", "level": 1}}, {"id": "r", "headingRelationship": {"parent": "Top", "child": "Sub", "relationship": "directChild"}}]}, "context": {"constraints": [{"id": "p", "path": {"glob": "good/*"}}]},
}


@query("""WITH n AS (SELECT n_nationkey AS k, n_nationkey % 5 AS m FROM nation)
SELECT k::bigint AS k, unnest(CASE m WHEN 0 THEN [] WHEN 1 THEN ['body.heading.missing', 'body.heading.relationship'] WHEN 2 THEN ['body.heading.relationship', 'context.path.mismatch'] WHEN 3 THEN ['frontmatter.presence.required', 'frontmatter.schema.required-property']
ELSE ['record.frontmatter.syntax-unavailable', 'record.markdown-structure.unsupported', 'record.markdown-structure.unsupported'] END) AS code FROM n""")
def c04_failing_records(spark, sf):
    m = E("n_nationkey") % 5
    front, headed = F.lit("---\nv: 1\n---\n"), F.lit("# Top\n\n## Sub\n")
    path = F.concat(F.when(m == 2, "bad/").otherwise("good/"), E("n_nationkey").cast("string"), F.when(m == 4, ".zzz").otherwise(".md"))
    text = F.when(m == 1, F.concat(front, F.lit("# Other\n"))).when(m == 2, F.concat(front, F.lit("# Top\n\n# Sub\n"))).when(m == 3, headed).otherwise(F.concat(front, headed))
    d = analysis.analyze(spark.read.parquet(f"{sf}/nation.parquet").select(E("n_nationkey").alias("k"), path.alias("path"), text.alias("content")))
    return d.select(E("k").cast("bigint").alias("k"), F.explode(types.assess(types.from_mapping(STRICT_TYPE))["diagnostics"]).alias("d")).select("k", "d.code")


@query(f"SELECT path, 'dated' AS rule, 'passed' AS status FROM ({NOTES}) WHERE k % 10 = 7")
def j11_pruned_validation(spark, sf):
    load = {"s/dated.json": {"required": ["date"]}}.__getitem__
    made, _ = configuration.compile_rules(configuration.decode({**OLD_FILE, "schemaRules": OLD_FILE["schemaRules"][:1]}, load), spark=spark)
    return rules.validate(corpora.order_notes(spark, sf), made).select("path", "rule", "status")
