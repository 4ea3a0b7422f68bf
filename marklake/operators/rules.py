"""Rules: configuration, compilation to Columns, assessment and summaries."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake import schemas
from marklake.functions import jmespath, jsonschema, predicates
from marklake.operators import analysis, types

VERSIONS = ("0.1.0", "0.2.0")
FILE_PREDICATES = ("pathRegex", "filenameEquals", "extensionIn", "modifiedAfter", "modifiedBefore")
DOCUMENT_PREDICATES = ("hasHeading", "hasHeadingAtLevel", "headingRegex", "hasSection", "bodyContains", "bodyRegex", "hasWikilink", "lineCount", "wordCount")
CHECKS = ("frontmatterSchema", "requiredHeading", "maxBodyLines", "maxBodyWords")
EVIDENCE = "struct<predicate:string,status:string>"


class RuleError(ValueError):
    """code: one of the names that decoding and compiling give."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Check:
    id: str
    kind: str
    operand: Any
    severity: str = "error"
    presence: str = "required"


@dataclass(frozen=True)
class Rule:
    """Applicability (globs, field, file, query and document predicates, types) and checks."""

    name: str
    paths: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()
    fields: tuple[tuple[str, str, Any], ...] = ()
    record: tuple[tuple[str, Any], ...] = ()
    query: str | None = None
    any_types: tuple[str, ...] = ()
    all_types: tuple[str, ...] = ()
    checks: tuple[Check, ...] = ()


def decode(data: dict | str) -> list[Rule]:
    """Rules of a configuration of version 0.1.0 or 0.2.0."""
    data = json.loads(data) if isinstance(data, str) else data
    if not isinstance(data, dict) or not isinstance(data.get("rules"), list):
        raise RuleError("invalid-structure", "rules is not a list")
    version = str(data.get("version", VERSIONS[0]))
    if version not in VERSIONS:
        raise RuleError("unsupported-version", version)
    return [_rule(r, version) for r in data["rules"]]


def _rule(r: dict, version: str) -> Rule:
    if not isinstance(r.get("name"), str) or not r["name"].strip():
        raise RuleError("missing-name", "a rule needs a name")
    if extra := sorted(set(r) - {"name", "description", "match", "checks", "paths", "excludePaths", "schema", "requiredHeadings"}):
        raise RuleError("unknown-key", f"{r['name']}.{extra[0]}")
    match = r.get("match") or {}
    if version == "0.1.0":  # the older form has globs and one schema beside the name
        match = {"paths": r.get("paths", match.get("paths", [])), "excludePaths": r.get("excludePaths", match.get("excludePaths", [])), **{k: v for k, v in match.items() if k not in ("paths", "excludePaths")}}
    fields = [(key, op, operand) for key, ops in (match.get("frontmatter") or {}).items() for op, operand in (ops.items() if isinstance(ops, dict) else [("equals", ops)])]
    record = [(k, v) for group in ("file", "document") for k, v in (match.get(group) or {}).items()]
    record = [(k, (v.get("min"), v.get("max")) if k in ("lineCount", "wordCount") else (v["level"], v["text"]) if k == "hasHeadingAtLevel" else v) for k, v in record]
    checks = [_check(r["name"], i, c) for i, c in enumerate(r.get("checks", []))]
    if "schema" in r:
        checks.append(Check(f"{r['name']}.schema", "frontmatterSchema", r["schema"]))
    checks += [Check(f"{r['name']}.heading.{i}", "requiredHeading", h) for i, h in enumerate(r.get("requiredHeadings", []))]
    query = (match.get("frontmatterQuery") or {}).get("jmespath") if isinstance(match.get("frontmatterQuery"), dict) else match.get("frontmatterQuery")
    return Rule(r["name"], tuple(match.get("paths", [])), tuple(match.get("excludePaths", [])), tuple(fields), tuple(record), query, tuple(match.get("anyTypes", [])), tuple(match.get("allTypes", [])), tuple(checks))


def _check(rule: str, i: int, c: dict) -> Check:
    kinds = [k for k in c if k in CHECKS or k in types.PREDICATES]
    if len(kinds) != 1:
        raise RuleError("invalid-check", f"{rule}.checks[{i}]")
    return Check(c.get("id", f"{rule}.check.{i}"), kinds[0], c[kinds[0]], c.get("severity", "error"), c.get("presence", "required"))


def encode(rules: list[Rule]) -> dict:
    """A configuration of version 0.2.0."""

    def one(r: Rule) -> dict:
        match: dict[str, Any] = {}
        if r.paths:
            match["paths"] = list(r.paths)
        if r.exclude_paths:
            match["excludePaths"] = list(r.exclude_paths)
        for key, op, operand in r.fields:
            match.setdefault("frontmatter", {}).setdefault(key, {})[op] = operand
        for k, v in r.record:
            v = {"min": v[0], "max": v[1]} if k in ("lineCount", "wordCount") else {"level": v[0], "text": v[1]} if k == "hasHeadingAtLevel" else v
            match.setdefault("file" if k in FILE_PREDICATES else "document", {})[k] = v
        if r.query:
            match["frontmatterQuery"] = {"jmespath": r.query}
        match |= {k: list(v) for k, v in (("anyTypes", r.any_types), ("allTypes", r.all_types)) if v}
        return {"name": r.name, **({"match": match} if match else {}), "checks": [{"id": c.id, c.kind: c.operand, "severity": c.severity, **({"presence": c.presence} if c.presence != "required" else {})} for c in r.checks]}

    return {"version": VERSIONS[1], "rules": [one(r) for r in rules]}


@dataclass(frozen=True)
class Compiled:
    """Checked rules with what their assessment needs of the analysis."""

    rules: tuple[Rule, ...]
    registry: types.Registry | None
    structure: bool
    wikilinks: bool

    @classmethod
    def of(cls, rules: list[Rule], registry: types.Registry | None = None) -> Compiled:
        """Checks names, patterns, queries, types and schemas, all on the driver (R2)."""
        names: set[str] = set()
        known = {t.name for t in registry.types} if registry else set()
        for r in rules:
            if r.name in names:
                raise RuleError("duplicate-rule", r.name)
            names.add(r.name)
            for key, op, operand in r.fields:
                if op not in predicates.OPERATORS:
                    raise RuleError("unknown-operator", f"{r.name}.{key}.{op}")
                if op == "regex":
                    _pattern(r.name, operand)
            for k, v in r.record:
                if k not in (*FILE_PREDICATES, *DOCUMENT_PREDICATES):
                    raise RuleError("unknown-predicate", f"{r.name}.{k}")
                if k in ("pathRegex", "headingRegex", "bodyRegex"):
                    _pattern(r.name, v)
                if k in ("lineCount", "wordCount") and None not in v and v[0] > v[1]:
                    raise RuleError("invalid-range", f"{r.name}.{k}")
            if r.query:
                try:
                    jmespath.parse(r.query)
                except jmespath.JMESPathError as e:
                    raise RuleError("invalid-query", f"{r.name}: {e}") from e
            for t in (*r.any_types, *r.all_types):
                if t not in known:
                    raise RuleError("unknown-type", f"{r.name}: {t}")
            for c in r.checks:
                if c.kind == "frontmatterSchema":
                    try:
                        jsonschema.resolve(c.operand)
                    except jsonschema.SchemaError as e:
                        raise RuleError("invalid-schema", f"{r.name}: {e}") from e
        structural = any(k in predicates.STRUCTURAL for r in rules for k, _ in r.record) or any(c.kind in ("requiredHeading", "heading", "headingRelationship", "section") for r in rules for c in r.checks) or any((r.any_types or r.all_types) and registry and registry.needs_structure() for r in rules)
        return cls(tuple(rules), registry, bool(structural), any(k == "hasWikilink" for r in rules for k, _ in r.record))

    def candidates(self, path: Column) -> Column:
        """Whether any rule's globs allow a path: apply it to the records before they are analyzed."""
        out = F.lit(False)
        for r in self.rules:
            out = out | predicates.path_matches(path, list(r.paths), list(r.exclude_paths)) if r.paths or r.exclude_paths else F.lit(True)
        return out


def java_pattern(spark: SparkSession | None, pattern: str) -> bool:
    """Whether the engine's regular expressions take a pattern: those of the JVM, which evaluate it."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return True
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:  # what a PatternSyntaxException becomes once SQL is set up
        return False
    except Py4JJavaError as e:
        if "PatternSyntaxException" in str(e):
            return False
        raise
    return True


def _pattern(rule: str, pattern: str) -> None:
    if not java_pattern(None, pattern):
        raise RuleError("invalid-regex", f"{rule}: {pattern}")


def _said(name: str, holds: Column, available: Column | None = None) -> Column:
    status = F.when(F.coalesce(holds, F.lit(False)), "matched").otherwise("notMatched")
    return F.struct(F.lit(name).alias("predicate"), (status if available is None else F.when(available, status).otherwise("unavailable")).alias("status"))


def evidence(r: Rule, columns: list[str]) -> Column:
    """A row of evidence for every predicate: matched, notMatched or unavailable. None is skipped for another's result."""
    out = []
    if r.paths or r.exclude_paths:
        out.append(_said("paths", predicates.path_matches(F.col("path"), list(r.paths), list(r.exclude_paths))))
    readable = (F.size("parse_diagnostics") == 0) & F.col("unavailable_ext").isNull()
    out += [_said(f"frontmatter.{key}.{op}", predicates.field(F.col("user_entries"), key, op, operand), readable) for key, op, operand in r.fields]
    for k, v in r.record:
        available = None
        if k.startswith("modified"):
            available = F.col("modification_ts").isNotNull() if "modification_ts" in columns else F.lit(False)
        elif k in predicates.STRUCTURAL:
            available = F.col("supports_structure")
        out.append(_said(k, predicates.record(k, v) if not (k.startswith("modified") and "modification_ts" not in columns) else F.lit(False), available))
    if r.query:
        out.append(_said("frontmatterQuery", jmespath.matches(F.coalesce("user_json", F.lit("{}")), r.query), readable))
    if r.any_types:
        out.append(_said("anyTypes", F.arrays_overlap(types.conforming(F.col("assessments")), F.array(*map(F.lit, r.any_types)))))
    if r.all_types:
        names = types.conforming(F.col("assessments"))
        out.append(_said("allTypes", F.forall(F.array(*map(F.lit, r.all_types)), lambda t: F.array_contains(names, t))))
    return F.array(*out) if out else F.array().cast(f"array<{EVIDENCE}>")


def _checked(c: Check, rule: str) -> tuple[Column, Column]:
    """Diagnostics of a check, and whether it was skipped."""
    none, no = F.array().cast(schemas.DIAGNOSTICS), F.lit(False)
    if c.kind == "frontmatterSchema":
        found = jsonschema.diagnostics(F.col("user_json"), jsonschema.resolve(c.operand), c.id, c.severity, "rule.frontmatter.schema")
        absent = F.array(types.diagnostic("frontmatter.presence.required", "frontmatter", c.id, "frontmatter", f'required by rule "{rule}"', c.severity))
        gone = F.array(types.diagnostic("record.frontmatter.syntax-unavailable", "frontmatter", c.id, "frontmatter", "no frontmatter syntax for this extension", c.severity))
        optional = c.presence == "optional"
        out = F.when(F.col("unavailable_ext").isNotNull(), gone).when(~F.col("has_frontmatter"), none if optional else absent).when(F.size("parse_diagnostics") > 0, F.slice("parse_diagnostics", 1, 1)).otherwise(found)
        return out, (~F.col("has_frontmatter") & F.col("unavailable_ext").isNull()) if optional else no
    kind = {"requiredHeading": "heading"}.get(c.kind, c.kind)
    return types.constraint(types.Constraint(c.id, kind, c.operand), c.severity), no


def assess(r: Rule, columns: list[str]) -> Column:
    """struct(rule, status, evidence, diagnostics): notApplicable, skipped, passed or failed."""
    none = F.array().cast(schemas.DIAGNOSTICS)
    made = [_checked(c, r.name) for c in r.checks]
    found = F.concat(none, *(d for d, _ in made))
    skipped = F.lit(bool(made))
    for _, s in made:
        skipped = skipped & s

    def over(x: Column) -> Column:
        unavailable = F.exists(x["e"], lambda e: e["status"] == "unavailable")
        applies = F.forall(x["e"], lambda e: e["status"] == "matched")
        bad = F.exists(x["d"], lambda d: d["severity"] == "error")
        status = F.when(unavailable, "failed").when(~applies, "notApplicable").when(bad, "failed").when(x["s"], "skipped").otherwise("passed")
        return F.struct(F.lit(r.name).alias("rule"), status.alias("status"), x["e"].alias("evidence"), F.when(applies & ~unavailable, x["d"]).otherwise(none).alias("diagnostics"))

    return F.element_at(F.transform(F.array(F.struct(evidence(r, columns).alias("e"), found.alias("d"), skipped.alias("s"))), over), 1)


def assess_all(analyzed: DataFrame, compiled: Compiled) -> DataFrame:
    """path and a row for every rule: rule, status, evidence, diagnostics. One projection and one explode."""
    if compiled.registry and any(r.any_types or r.all_types for r in compiled.rules):
        analyzed = types.assess_all(analyzed, compiled.registry)
    rows = F.array(*(assess(r, analyzed.columns) for r in compiled.rules))
    return analyzed.select("path", F.explode(rows).alias("a")).select("path", "a.*")


def validate(records: DataFrame, compiled: Compiled) -> DataFrame:
    """Assesses records (path, content) that have not been analyzed: what no rule's globs allow is never parsed."""
    wanted = records.filter(F.coalesce(compiled.candidates(F.col("path")), F.lit(True)))
    return assess_all(analysis.analyze(wanted, structure=compiled.structure, wikilinks=compiled.wikilinks), compiled)


def files_matching(analyzed: DataFrame, compiled: Compiled, name: str) -> DataFrame:
    """Paths to which a rule applies."""
    return assess_all(analyzed, Compiled(tuple(r for r in compiled.rules if r.name == name), compiled.registry, compiled.structure, compiled.wikilinks)).filter("status <> 'notApplicable'").select("path")


def explain(assessed: DataFrame, path: str) -> DataFrame:
    """Rules of one record with their evidence."""
    return assessed.filter(F.col("path") == path).select("rule", "status", F.explode_outer("evidence").alias("e")).select("rule", "status", "e.predicate", F.col("e.status").alias("result"))


def summary(assessed: DataFrame) -> DataFrame:
    """One row: matches of files and rules, distinct files, errors, skipped, failed."""
    applies = F.col("status") != "notApplicable"
    return assessed.agg(F.count_if(applies).alias("n_matches"), F.count_distinct(F.when(applies, F.col("path"))).alias("n_files"), F.coalesce(F.sum(F.size(F.filter("diagnostics", lambda d: d["severity"] == "error"))), F.lit(0)).alias("n_errors"), F.count_if(F.col("status") == "skipped").alias("n_skipped"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("status") == "passed").alias("n_passed"))


def render_summary(row: dict) -> str:
    """The summary as text."""
    return f"{row['n_files']} files, {row['n_matches']} matches: {row['n_passed']} passed, {row['n_skipped']} skipped, {row['n_failed']} failed, {row['n_errors']} errors"


def add(rules: list[Rule], rule: Rule) -> list[Rule]:
    """Rules with one more, whose name must be new."""
    if any(r.name == rule.name for r in rules):
        raise RuleError("duplicate-rule", rule.name)
    return [*rules, rule]


def remove(rules: list[Rule], name: str) -> list[Rule]:
    """Rules without one, which must exist."""
    if all(r.name != name for r in rules):
        raise RuleError("unknown-rule", name)
    return [r for r in rules if r.name != name]


def describe(rule: Rule) -> dict:
    """A rule with the fields that its schemas name."""
    fields = [{"field": k, "type": v.get("type") if isinstance(v, dict) else None, "required": k in c.operand.get("required", [])} for c in rule.checks if c.kind == "frontmatterSchema" for k, v in c.operand.get("properties", {}).items()]
    return {**encode([rule])["rules"][0], "fields": fields}


def init_config() -> dict:
    """An empty configuration."""
    return encode([])


def migrate(data: dict) -> dict:
    """A 0.1.0 configuration as 0.2.0."""
    return encode(decode(data))


CONFIG_SCHEMA = {"type": "object", "required": ["version", "rules"], "properties": {"version": {"enum": list(VERSIONS)}, "rules": {"type": "array", "items": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 1}, "match": {"type": "object"}, "checks": {"type": "array"}}}}}}
