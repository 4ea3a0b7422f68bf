from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from marklake.functions import codec, values
from marklake.operators import analysis, explore, export, identity, okf, rules, serve, store, types
from marklake.plans import model_queries
from marklake.sources import files


def records(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_type_decoding():
    t = types.decode(json.dumps(model_queries.ORDER_TYPE), "json")
    assert t.name == "order" and [c.id for c in t.body] == ["h", "s", "l", "w"]
    for bad, code in (({"name": "x", "version": "1", "extra": 1}, "unknown-key"), ({"version": "1"}, "missing-name"), ({"name": "x", "version": "1", "formatVersion": "2"}, "unsupported-format-version"), ({"name": "x", "version": "1", "body": {"constraints": [{"id": "a"}]}}, "invalid-constraint")):
        with pytest.raises(types.DefinitionError) as e:
            types.from_mapping(bad)
        assert e.value.code == code
    with pytest.raises(types.DefinitionError) as e:
        types.Registry.of([t, t])
    assert e.value.code == "duplicate-type"
    assert types.doctor(types.Registry.of([types.from_mapping({"name": "x", "version": "one"})]))


def test_type_assessment(spark):
    reg = types.Registry.of([types.from_mapping({"name": "book", "version": "1.0.0", "frontmatter": {"presence": "required", "schemas": [{"id": "s", "schema": {"required": ["title"]}}]}, "body": {"constraints": [{"id": "b", "headingRelationship": {"parent": "Book", "child": "Part", "relationship": "directChild"}}]}})])
    rows = [("a.md", "---\ntitle: T\n---\n# Book\n\n## Part\n"), ("b.md", "# Book\n\n## X\n\n### Part\n"), ("c.txt", "---\ntitle: T\n---\n# Book\n## Part"), ("d.xyz", "text"), ("e.md", "---\ntitle: [\n---\n# Book\n## Part\n")]
    d = types.assess_all(analysis.analyze(records(spark, rows)), reg)
    got = {r.path: [x.code for x in r.assessments[0].diagnostics] for r in d.collect()}
    assert got == {"a.md": [], "b.md": ["frontmatter.presence.required", "frontmatter.schema.required-property", "body.heading.relationship"], "c.txt": ["record.markdown-structure.unsupported"], "d.xyz": ["record.frontmatter.syntax-unavailable", "record.markdown-structure.unsupported"], "e.md": ["record.frontmatter.invalid-yaml"]}


def test_rules(spark):
    with pytest.raises(rules.RuleError) as e:
        rules.Compiled.of(rules.decode({"version": "0.2.0", "rules": [{"name": "a", "match": {"frontmatter": {"k": {"nope": 1}}}}]}))
    assert e.value.code == "unknown-operator"
    old = {"version": "0.1.0", "rules": [{"name": "a", "paths": ["*.md"], "requiredHeadings": ["H"]}]}
    new = rules.migrate(old)
    assert new["version"] == "0.2.0" and rules.decode(new)[0].paths == ("*.md",) and new["rules"][0]["checks"][0]["requiredHeading"] == "H"
    made = rules.decode({"version": "0.2.0", "rules": [{"name": "m", "match": {"file": {"modifiedAfter": "2020-01-01"}}}, {"name": "opt", "checks": [{"id": "c", "frontmatterSchema": {"required": ["x"]}, "presence": "optional"}]}, {"name": "h", "match": {"document": {"hasHeading": "H"}}}]})
    d = rules.assess_all(analysis.analyze(records(spark, [("a.md", "text"), ("b.txt", "# H")])), rules.Compiled.of(made))
    assert {(r.path, r.rule): r.status for r in d.collect()} == {("a.md", "m"): "failed", ("a.md", "opt"): "skipped", ("a.md", "h"): "notApplicable", ("b.txt", "m"): "failed", ("b.txt", "opt"): "skipped", ("b.txt", "h"): "failed"}
    assert "2 files" in rules.render_summary(rules.summary(d).first().asDict())
    assert rules.remove(rules.add(made, rules.Rule("z")), "z") == made


def test_identity(spark):
    d = analysis.analyze(records(spark, [("a.md", "---\nid: A-1\n---\n"), ("b.md", "---\nid: a_b\n---\n"), ("c.md", "---\nid: null\n---\n"), ("d.md", "---\nid: [\n---\n"), ("e.md", "---\nid: 1.5\n---\n"), ("f.md", "---\nid: a-1\n---\n"), ("g.md", "---\nid: a-1\n---\n")]), structure=False)
    got = lambda form: {r.path: (r.identity_status, r.identity_code) for r in identity.assess(d, identity.Policy("frontmatter", ("id",), form)).collect()}
    s = got("slug:strictASCII")
    assert s["a.md"] == ("invalid", "identity.frontmatter.invalid-slug") and s["c.md"] == ("missing", "identity.frontmatter.missing") and s["d.md"] == ("invalid", "identity.frontmatter.invalid") and s["e.md"][1] == "identity.frontmatter.unsupported-value" and s["f.md"] == ("duplicate", "identity.primary.duplicate")
    assert got("slug:preserve")["a.md"] == ("available", None) and got("slug:unicode")["b.md"] == ("available", None)
    assert got("integer")["e.md"] == ("invalid", "identity.frontmatter.invalid-integer")


def planned(spark, df):
    """The physical plan as it is before any part has run."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def served(spark):
    return serve.memberships(records(spark, [("orders/a.md", "---\nid: 1\ndate: x\n---\n"), ("orders/b.md", "---\nid: 1\ndate: x\n---\n"), ("orders/c.md", "---\ndate: x\n---\n"), ("orders/d.md", "---\nid: 4\ndate: x\n---\n")]), model_queries.plan())


def test_memberships_parse_once(spark):
    """Counting identities reads what joining back reads: frontmatter is parsed in one place of the plan."""
    found = served(spark).select("path", "resource", "valid", "identity", "identity_status").filter("resource = 'notes'")
    assert {r.path: (r.valid, r.identity, r.identity_status) for r in found.collect()} == {"orders/a.md": (False, "1", "duplicate"), "orders/b.md": (False, "1", "duplicate"), "orders/c.md": (False, None, "missing"), "orders/d.md": (True, "4", "available")}
    plan = planned(spark, served(spark).select("path", "resource", "valid", "identity"))
    assert plan.count("_parse(") == 1 and plan.count("ReusedExchange") == 1
    d = identity.assess(analysis.analyze(records(spark, [("a.md", "---\nid: 1\n---\n")]), structure=False), identity.Policy("frontmatter", ("id",), "integer"))
    assert planned(spark, d.select("path", "identity", "identity_status")).count("_parse(") == 1


def test_envelopes_parse_once(spark):
    plan = planned(spark, serve.envelopes(served(spark)).select("path", "resources", "valid"))
    assert plan.count("_parse(") == 1 and plan.count("ReusedExchange") == 1
    for v in (None, True, 7, -1, 2**70, 1.5, 3.0, "ä\"", [], [1, "x", [None, {"b": 1, "a": [False]}]], {"z": 1, "a": (1, 2)}):
        assert values.canonical(v) == json.dumps(values.plain(v), ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def test_store(spark):
    held = store.load(spark.createDataFrame([("a", "a.md", "1"), ("b", "b.md", "2")], "identity string, path string, content string"))
    c = spark.createDataFrame([("a", "replace", "a.md", "x", 1), ("b", "delete", None, None, 9), ("n", "create", "n.md", "n", None)], "identity string, op string, path string, content string, expected bigint")
    after, out = store.apply(held, c)
    assert {r.identity: r.outcome for r in out.collect()} == {"a": "replaced", "b": "revisionMismatch", "n": "created"}
    assert {(r.identity, r.content, r.revision) for r in after.collect()} == {("a", "x", 2), ("b", "2", 1), ("n", "n", 1)}
    assert [r.identity for r in store.page(after, 2, "a").collect()] == ["b", "n"]


def test_bundle_and_export(spark):
    rows = [("index.md", "# I"), ("log.md", "## 2026-13-45\n## x\n"), ("c/a.md", "---\ntype: t\ntimestamp: soon\n---\nB, \"q\"\n"), ("c/b.md", "---\ntype: [x]\n---\n"), ("c/c.md", "---\ntype: x"), ("c/d.md", "+++\ntype = 'x'\n+++\n")]
    p = okf.prepare(records(spark, rows))
    assert {(r.path, r.location) for r in okf.issues(p).collect()} == {("log.md", "line 2"), ("c/b.md", "frontmatter.type"), ("c/c.md", "frontmatter"), ("c/d.md", "frontmatter")}
    assert ("c/a.md", "frontmatter.timestamp") in {(r.path, r.location) for r in okf.advisories(p).collect()}
    assert okf.scaffold(spark, "N").count() == 3
    header, lines = export.csv_lines(export.table(p.filter("path = 'c/a.md'"), ("$relPath",)))
    assert header == "$relPath,$body,timestamp,type" and lines.first()[0] == 'c/a.md,"B, ""q""\n",soon,t'
    assert export.read_any(export.format_any({"a": [1, "x"]}, "plist"), "plist") == {"a": [1, "x"]}
    assert export.format_any({"b": 1}, "toml") == "b = 1\n" and export.format_any([1, 2], "raw") == "1\n2"


def test_codec(spark):
    d = spark.createDataFrame([("t", None, [1, 2], "Body")], "name string, n int, xs array<int>, text string")
    made = d.select(codec.encode(d, "text").alias("y"), codec.encode(d, "text", "toml").alias("t")).first()
    assert made.y.content == "---\nn: null\nname: t\nxs:\n  - 1\n  - 2\n---\nBody" and made.t.error.startswith("null-in-toml")
    r = codec.decode(records(spark, [("a", made.y.content), ("b", "none"), ("c", "---\nname: [\n---\n"), ("d", "---\nxs: text\n---\n")]), "name string, xs array<int>", "text")
    assert {x.path: x.error for x in r.collect()} == {"a": None, "b": "missing-frontmatter", "c": "invalid-frontmatter", "d": "type-mismatch"}
    assert r.filter("path = 'a'").first().value.asDict() == {"name": "t", "xs": [1, 2], "text": "Body"}


def test_files(spark, tmp_path):
    for name in ("a.md", "_u.md", ".h.md", "sub/b.markdown", "sub/c.txt", "x/skip.md", "d.swift"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text(f"---\nn: {name}\n---\nbody")
    root = str(tmp_path)
    names = lambda xs: [os.path.relpath(x, root) for x in xs]
    assert names(files.list_files(root, exclude=["x"])) == ["_u.md", "a.md", "sub/b.markdown"]
    assert "d.swift" in names(files.list_files(root, include_non_md=True)) and names(files.list_files(root, recursive=False)) == ["_u.md", "a.md"]
    assert [r.path for r in files.read(spark, root).orderBy("path").collect()] == ["a.md", "sub/b.markdown", "x/skip.md"]
    listed = files.read_listed(spark, root, files.list_files(root))
    assert listed.filter("path = '_u.md'").first().content.endswith("body")
    new = listed.filter("path = 'a.md'").select("path", F.lit("new").alias("content"), "revision")
    assert [r.status for r in files.write(new, root, expected="revision").collect()] == ["written"] and (tmp_path / "a.md").read_text() == "new"
    (tmp_path / "a.md").write_text("changed")
    assert [r.status for r in files.write(new.withColumn("revision", F.lit("0")), root, expected="revision").collect()] == ["revisionMismatch"]
    assert files.metadata(spark, root, [f"{root}/a.md"]).first()["size"] == 7
    with pytest.raises(ValueError):
        files.confined(root, "../x")
    assert files.valid_path("./a/b.md") and not files.valid_path("/a")


def test_explore(spark):
    d = analysis.analyze(records(spark, [("a.md", "---\nx: 1\n---\npre\n\n# A\n\none, two-three\n\n## B\n\n### C\n")]))
    s = explore.sections(d)
    assert [(r.title, r.start_line, r.end_line, r.n_children) for r in s.orderBy("id").collect()] == [("A", 6, 13, 1), ("B", 10, 13, 1), ("C", 12, 13, 0)]
    assert explore.preamble(d).first().preamble == "pre\n"
    assert [r.title for r in explore.target(s, title_path=["A", "B"], recursive=True).orderBy("id").collect()] == ["B", "C"]
    assert [r.title for r in explore.ancestors(s, ["A", "B", "C"]).orderBy("id").collect()] == ["A", "B"]
    assert [r.title for r in explore.suggest(s, "b").collect()] == ["B"]
    assert explore.render([r.asDict() for r in s.orderBy("id").collect()]) == "A\n  B\n    C"


def test_serving(spark):
    plan = model_queries.plan()
    _, bad = serve.compile_plan(serve.decode({"resources": [{"name": "a", "route": "/x", "selection": {"rule": "nope"}}, {"name": "a", "route": "/x/y", "selection": {"type": "note"}}]}), plan.rules, plan.registry)
    assert {c for c, _ in bad} >= {"resource.rule.unknown", "resource.name.duplicate", "resource.route.overlap", "resource.search-root.missing"}
    found = serve.memberships(records(spark, [("orders/a.md", "---\nid: 1\ndate: x\n---\n"), ("orders/b.md", "---\nid: 1\ndate: x\n---\n"), ("orders/c.md", "---\nid: 2\ndate: x\n---\n")]), plan)
    assert serve.respond(found, plan, "/notes", "1")[0] == 409 and serve.respond(found, plan, "/notes", "2")[0] == 200 and serve.respond(found, plan, "/notes", "9")[0] == 404 and serve.respond(found, plan, "/gone")[0] == 404 and serve.respond(found, plan, "/notes", "")[0] == 400
    assert serve.respond(found, plan, "/notes", "orders/a.md", "path")[0] == 200
    assert serve.openapi(plan)["openapi"] == "3.1.1"


@pytest.mark.parametrize(
    ("data", "code"),
    [
        ("{", "invalid-serialization"), ([], "invalid-serialization"), ({"configVersion": ""}, "invalid-field"), ({"configVersion": "9"}, "unsupported-version"), ({"rules": []}, "unsupported-feature"), ({"configVersion": "0.2.0", "schemaRules": []}, "unsupported-feature"),
        ({"schemaRules": [{"name": "a", "match": {"paths": ["*"]}}]}, "invalid-field"), ({"schemaRules": [{"name": "a", "schema": "s", "match": {}}]}, "invalid-field"), ({"configVersion": "0.2.0", "rules": [{"name": "a", "match": {"paths": ["*"]}, "checks": []}]}, "invalid-field"),
        ({"configVersion": "0.2.0", "rules": [{"name": "a", "match": {"paths": ["*"]}, "checks": [{"type": "x"}]}]}, "unsupported-feature"), ({"configVersion": "0.2.0", "rules": [{"name": "a", "match": {"paths": ["*"]}, "checks": [{"type": "maxBodyLines", "max": -1}]}]}, "invalid-field"),
        ({"schemaRules": [{"name": "a", "schema": "s", "match": {"frontmatter": {"k": {"hasKey": False}}}}]}, "invalid-field"), ({"schemaRules": [{"name": "a", "schema": "s", "match": {"frontmatter": {"k": {"between": {"from": 2, "to": 1}}}}}]}, "invalid-field"), ({"schemaRules": [{"name": "a", "schema": "s", "match": {"document": {"lineCount": {}}}}]}, "invalid-field"),
        ({"schemaRules": [{"name": "a", "schema": "s", "match": {"frontmatter": {"k": {"nope": 1}}}}]}, "unsupported-feature"), ({"schemaRules": [{"name": "a", "schema": "s", "match": {"paths": ["*"]}}] * 2}, "invalid-field"),
    ],
)
def test_rule_files_that_are_wrong(data, code):
    from marklake.operators import configuration

    with pytest.raises(rules.RuleError) as e:
        configuration.decode(data)
    assert e.value.code == code


def test_rule_files_keep_references():
    from marklake.operators import configuration

    (r,) = configuration.decode({"schemaRules": [{"name": "a", "schema": "x.json", "frontmatterRequired": False, "match": {"file": {"extensionIn": [".MD", "txt"]}}}]})
    assert r.checks[0].operand == "x.json" and r.checks[0].presence == "optional" and r.checks[0].id == "a.check[0]" and r.record == (("extensionIn", ["md", "txt"]),)
