"""Served selections: endpoint plans, snapshots, envelopes, lookups and OpenAPI (V1-V4, J12, IO22, IO23)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake import schemas
from marklake.functions.values import canonical
from marklake.operators import analysis, identity, rules, types

ROUTE = r"/[a-z0-9]+(?:[-_][a-z0-9]+)*(?:/[a-z0-9]+(?:[-_][a-z0-9]+)*)*"


@dataclass(frozen=True)
class Resource:
    """A collection that is served: selection is rule, type or typed-rule."""

    name: str
    route: str
    mode: str
    rule: str | None = None
    type: str | None = None
    search_root: str | None = None
    policy: identity.Policy = identity.Policy()


@dataclass(frozen=True)
class Plan:
    resources: tuple[Resource, ...]
    rules: rules.Compiled
    registry: types.Registry


def decode(data: dict) -> list[Resource]:
    """Resources of a server configuration (V1)."""
    if str(data.get("version", "1")) != "1":
        raise ValueError("unsupported configuration version")
    out = []
    for r in data.get("resources", []):
        s = r.get("selection", {})
        mode = "typed-rule" if "rule" in s and "type" in s else "rule" if "rule" in s else "type"
        i = r.get("identity", {})
        policy = identity.Policy(i.get("source", "path"), tuple(i.get("path", [])), i.get("format", "string"), i.get("pathFallback", True))
        out.append(Resource(r["name"], r.get("route", "/" + r["name"]), mode, s.get("rule"), s.get("type"), s.get("searchRoot"), policy))
    return out


def compile_plan(resources: list[Resource], compiled: rules.Compiled, registry: types.Registry) -> tuple[Plan | None, list[tuple[str, str]]]:
    """A plan, or (code, resource) of what is wrong with it (V2)."""
    bad: list[tuple[str, str]] = []
    rule_names, type_names = {r.name for r in compiled.rules}, {t.name for t in registry.types}
    seen: dict[str, set[str]] = {"name": set(), "route": set(), "operation": set()}
    for r in resources:
        if not r.name.strip():
            bad.append(("resource.name.empty", r.name))
        if r.name in seen["name"]:
            bad.append(("resource.name.duplicate", r.name))
        if not r.route.startswith("/"):
            bad.append(("resource.route.not-absolute", r.name))
        elif not re.fullmatch(ROUTE, r.route):
            bad.append(("resource.route.unsafe", r.name))
        if r.route in seen["route"]:
            bad.append(("resource.route.duplicate", r.name))
        if any(r.route.startswith(o + "/") or o.startswith(r.route + "/") for o in seen["route"]):
            bad.append(("resource.route.overlap", r.name))
        if r.route == "/openapi":
            bad.append(("resource.route.reserved", r.name))
        op = operation_id(r, "list")
        if op in seen["operation"]:
            bad.append(("resource.operation.duplicate", r.name))
        if r.mode != "type" and r.rule not in rule_names:
            bad.append(("resource.rule.unknown", r.name))
        if r.mode != "rule" and r.type not in type_names:
            bad.append(("resource.type.unknown", r.name))
        if r.mode == "type" and not r.search_root:
            bad.append(("resource.search-root.missing", r.name))
        if r.search_root and (r.search_root.startswith("/") or ".." in r.search_root.split("/")):
            bad.append(("resource.search-root.unsafe", r.name))
        if r.policy.source not in ("existing", "path", "frontmatter"):
            bad.append(("resource.identity.unknown-source", r.name))
        if r.policy.source == "frontmatter" and not all(r.policy.path or [""]):
            bad.append(("resource.identity.invalid-path", r.name))
        if r.policy.form.partition(":")[0] not in ("string", "integer", "uuid", "slug"):
            bad.append(("resource.identity.unknown-format", r.name))
        seen["name"].add(r.name)
        seen["route"].add(r.route)
        seen["operation"].add(op)
    return (None if bad else Plan(tuple(sorted(resources, key=lambda r: r.route)), compiled, registry)), bad


def operation_id(r: Resource, what: str) -> str:
    words = re.findall(r"[A-Za-z0-9]+", r.name)
    return what + "".join(w[:1].upper() + w[1:] for w in words)


def memberships(records: DataFrame, plan: Plan) -> DataFrame:
    """resource, path, valid, identity, identity_status and diagnostics of every selected record.

    Records are read and assessed once, for all resources: what each resource makes of a record is an element of one
    array, which is exploded; duplicate identities are counted once, by resource.
    """
    needs = plan.registry.needs_structure() or plan.rules.structure
    d = types.assess_all(analysis.analyze(records, structure=needs, wikilinks=plan.rules.wikilinks), plan.registry)
    d = d.withColumn("rule_results", F.array(*(rules.assess(r, d.columns) for r in plan.rules.rules)) if plan.rules.rules else F.array().cast(f"array<struct<rule:string,status:string,evidence:array<{rules.EVIDENCE}>,diagnostics:{schemas.DIAGNOSTICS}>>"))
    none = F.array().cast(schemas.DIAGNOSTICS)

    def seen(r: Resource) -> Column:
        rule = F.get(F.filter("rule_results", lambda x: x["rule"] == r.rule), F.lit(0))
        kind = F.get(F.filter("assessments", lambda x: x["subject"] == r.type), F.lit(0))
        applies, passed = rule["status"] != "notApplicable", rule["status"] != "failed"
        chosen, ok, found = {"type": (kind["conforms"], F.lit(True), kind["diagnostics"]), "rule": (applies, passed, rule["diagnostics"]), "typed-rule": (applies, passed & kind["conforms"], F.concat(rule["diagnostics"], kind["diagnostics"]))}[r.mode]
        if r.search_root:
            chosen = chosen & F.col("path").startswith(r.search_root.rstrip("/") + "/")
        ident, code = identity.derive(r.policy, d.columns)
        return F.when(chosen, F.struct(F.lit(r.name).alias("resource"), ok.alias("ok"), F.coalesce(found, none).alias("diagnostics"), ident.alias("identity"), code.alias("identity_code")))

    if not plan.resources:
        return d.limit(0).select(F.lit("").alias("resource"), "path", F.lit(True).alias("valid"), F.lit("").alias("identity"), F.lit("").alias("identity_status"), none.alias("diagnostics"))
    rows = d.select("path", F.explode(F.filter(F.array(*map(seen, plan.resources)), lambda x: x.isNotNull())).alias("x")).select("path", "x.*")
    found = identity.judge(rows, ("resource", "identity"), tuple(rows.columns))
    return found.select("resource", "path", (F.col("ok") & (F.col("identity_status") == "available")).alias("valid"), "identity", "identity_status", "diagnostics")


def envelopes(found: DataFrame) -> DataFrame:
    """path, resources, valid (all memberships are) and distinct diagnostics of every selected record."""
    return found.groupBy("path").agg(F.array_sort(F.collect_list("resource")).alias("resources"), F.every("valid").alias("valid"), F.array_distinct(F.flatten(F.collect_list("diagnostics"))).alias("diagnostics"))


def respond(found: DataFrame, plan: Plan, route: str, key: str | None = None, by: str = "id") -> tuple[int, DataFrame | None]:
    """(status, rows) of a list, get-by-id or get-by-path request: 200, 400, 404 or 409 (IO22)."""
    r = next((x for x in plan.resources if x.route == route), None)
    if r is None:
        return 404, None
    rows = found.filter(F.col("resource") == r.name)
    if key is None:
        return 200, rows.orderBy("path")
    if not key or by not in ("id", "path"):
        return 400, None
    hit = rows.filter(F.col("identity" if by == "id" else "path") == key).orderBy("path")
    n = len(hit.select("path").take(2))
    return (404, None) if n == 0 else (200 if n == 1 else 409, hit)


def openapi(plan: Plan, title: str = "Records") -> dict[str, Any]:
    """OpenAPI 3.1.1 of a plan; needs no records (IO23)."""
    names = {t.name: re.sub(r"[^A-Za-z0-9._-]", "_", t.name) for t in plan.registry.types}
    error = {"description": "error", "content": {"application/json": {"schema": {"$ref": "#/components/schemas/Error"}}}}
    paths: dict[str, Any] = {}
    for r in plan.resources:
        item = {"$ref": f"#/components/schemas/{names[r.type]}"} if r.type else {"$ref": "#/components/schemas/Record"}
        ok = lambda schema: {"description": "ok", "content": {"application/json": {"schema": schema}}}
        paths[r.route] = {"get": {"operationId": operation_id(r, "list"), "responses": {"200": ok({"type": "array", "items": item})}}}
        for what, param in (("get", "id"), ("getByPath", "path")):
            at = f"{r.route}/{{id}}" if param == "id" else f"{r.route}/by-path/{{path}}"
            paths[at] = {"get": {"operationId": operation_id(r, what), "parameters": [{"name": param, "in": "path", "required": True, "schema": {"type": "string"}}], "responses": {"200": ok(item), "400": error, "404": error, "409": error}}}
    components = {"Record": {"type": "object", "required": ["path", "valid"], "properties": {"path": {"type": "string"}, "identity": {"type": ["string", "null"]}, "valid": {"type": "boolean"}, "frontmatter": {"type": "object"}, "body": {"type": "string"}}}, "Error": {"type": "object", "required": ["code", "message"], "properties": {"code": {"type": "string"}, "message": {"type": "string"}}}}
    for t in plan.registry.types:
        front = [s for _, s in t.resolved]
        components[names[t.name]] = {"allOf": [{"$ref": "#/components/schemas/Record"}, {"type": "object", "properties": {"frontmatter": front[0] if len(front) == 1 else {"allOf": front} if front else {"type": "object"}}}]}
    out = {"openapi": "3.1.1", "info": {"title": title, "version": "1"}, "paths": dict(sorted(paths.items())), "components": {"schemas": components}}
    canonical(out)
    return out
