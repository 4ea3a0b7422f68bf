"""Structural types: definitions, registry, assessment, hints and fixes."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake import schemas
from marklake.functions import jsonschema, markdown, predicates, values
from marklake.functions.arrow import lazy

VERSION = "1"
PREDICATES = ("heading", "headingRelationship", "section", "path", "maxBodyLines", "maxBodyWords")


class DefinitionError(ValueError):
    """code: one of the names a definition's checks give."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Constraint:
    """A predicate (one of PREDICATES) with its operand."""

    id: str
    predicate: str
    operand: Any


@dataclass(frozen=True)
class TypeDefinition:
    """A structural type: schemas for the frontmatter and constraints on body and context."""

    name: str
    version: str
    presence: str = "optional"
    schemas: tuple[tuple[str, dict], ...] = ()
    body: tuple[Constraint, ...] = ()
    context: tuple[Constraint, ...] = ()
    resolved: tuple[tuple[str, dict], ...] = field(default=(), compare=False)


def decode(text: str, form: str = "yaml") -> TypeDefinition:
    """A definition from yaml, json or toml; unknown keys are errors."""
    try:
        data = json.loads(text) if form == "json" else values.read(text, form)
    except (ValueError, values.FrontmatterError) as e:
        raise DefinitionError("invalid-syntax", str(e)) from e
    return from_mapping(data)


def _strict(data: Any, allowed: str, where: str) -> dict:
    if not isinstance(data, dict):
        raise DefinitionError("invalid-structure", f"{where} is not a mapping")
    if extra := sorted(set(data) - set(allowed.split())):
        raise DefinitionError("unknown-key", f"{where}.{extra[0]}")
    return data


def from_mapping(data: dict) -> TypeDefinition:
    data = _strict(data, "formatVersion name version description frontmatter body context", "type")
    if str(data.get("formatVersion", VERSION)) != VERSION:
        raise DefinitionError("unsupported-format-version", str(data.get("formatVersion")))
    for key in ("name", "version"):
        if not isinstance(data.get(key), str) or not data[key].strip():
            raise DefinitionError(f"missing-{key}", f"type.{key}")
    front = _strict(data.get("frontmatter", {}), "presence schemas", "frontmatter")
    if front.get("presence", "optional") not in ("required", "optional"):
        raise DefinitionError("invalid-presence", str(front["presence"]))
    found = []
    for i, s in enumerate(front.get("schemas", [])):
        s = _strict(s, "id schema", f"frontmatter.schemas[{i}]")
        found.append((s.get("id", f"frontmatter.schema.{i}"), s.get("schema", {})))

    def group(name: str, allowed: tuple[str, ...]) -> tuple[Constraint, ...]:
        out = []
        for i, c in enumerate(_strict(data.get(name, {}), "constraints", name).get("constraints", [])):
            c = _strict(c, "id " + " ".join(allowed), f"{name}.constraints[{i}]")
            kinds = [k for k in c if k != "id"]
            if len(kinds) != 1:
                raise DefinitionError("invalid-constraint", f"{name}.constraints[{i}]")
            out.append(Constraint(c.get("id", f"{name}.{i}"), kinds[0], c[kinds[0]]))
        return tuple(out)

    return TypeDefinition(data["name"], data["version"], front.get("presence", "optional"), tuple(found), group("body", ("heading", "headingRelationship", "section", "maxBodyLines", "maxBodyWords")), group("context", ("path",)))


@dataclass(frozen=True)
class Registry:
    """Checked definitions in order of name."""

    types: tuple[TypeDefinition, ...]

    @classmethod
    def of(cls, types: list[TypeDefinition], load: Callable[[str, str | None], dict] | None = None) -> Registry:
        """Checks names and constraint ids and resolves all schemas (Y2); equal schemas are resolved once."""
        names: set[str] = set()
        out, done = [], {}
        for t in types:
            if t.name in names:
                raise DefinitionError("duplicate-type", t.name)
            names.add(t.name)
            ids = [i for i, _ in t.schemas] + [c.id for c in (*t.body, *t.context)]
            if repeated := [i for i in ids if ids.count(i) > 1]:
                raise DefinitionError("duplicate-constraint-id", repeated[0])
            resolved = []
            for i, s in t.schemas:
                key = json.dumps(s, sort_keys=True)
                try:
                    if key not in done:
                        done[key] = jsonschema.resolve(s, load)
                except jsonschema.SchemaError as e:
                    raise DefinitionError("unresolved-schema", f"{i}: {e}") from e
                resolved.append((i, done[key]))
            out.append(TypeDefinition(t.name, t.version, t.presence, t.schemas, t.body, t.context, tuple(resolved)))
        return cls(tuple(sorted(out, key=lambda t: t.name)))

    def needs_structure(self) -> bool:
        return any(c.predicate in ("heading", "headingRelationship", "section") for t in self.types for c in t.body)


def diagnostic(code: str, domain: str, constraint: str | None, location: str, message: str, severity: str = "error") -> Column:
    return F.struct(*(F.lit(v).cast("string").alias(k) for k, v in (("code", code), ("severity", severity), ("domain", domain), ("constraint_id", constraint), ("location", location), ("message", message))))


def _when(bad: Column, d: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.array(d)).otherwise(F.array().cast(schemas.DIAGNOSTICS))


def _same(h: Column, want: dict | str) -> Column:
    want = {"text": want} if isinstance(want, str) else want
    return (h["text"] == want["text"]) & ((h["level"] == want["level"]) if want.get("level") else F.lit(True))


def constraint(c: Constraint, severity: str = "error") -> Column:
    """Diagnostics of a body or context constraint."""
    heads = F.col("headings") if c.predicate in ("heading", "headingRelationship", "section") else None
    if c.predicate == "path":
        pattern = c.operand["glob"] if isinstance(c.operand, dict) else c.operand
        missing = _when(F.col("path").isNull(), diagnostic("context.path.unavailable", "context", c.id, "context.path", "the record has no path", severity))
        return F.when(F.col("path").isNull(), missing).otherwise(_when(~predicates.path_matches(F.col("path"), [pattern]), diagnostic("context.path.mismatch", "context", c.id, "context.path", f"path does not match {pattern}", severity)))
    if c.predicate == "maxBodyLines":
        return _when(predicates.n_lines(F.col("body")) > int(c.operand), diagnostic("body.lines.maximum", "body", c.id, "body", f"more than {c.operand} lines", severity))
    if c.predicate == "maxBodyWords":
        return _when(predicates.n_words(F.col("body")) > int(c.operand), diagnostic("body.words.maximum", "body", c.id, "body", f"more than {c.operand} words", severity))
    if c.predicate == "heading":
        found = _when(~F.exists(heads, lambda h: _same(h, c.operand)), diagnostic("body.heading.missing", "body", c.id, "body", f"missing heading {json.dumps(c.operand, ensure_ascii=False)}", severity))
    elif c.predicate == "headingRelationship":
        parent, child, direct = c.operand["parent"], c.operand["child"], c.operand.get("relationship", "directChild") == "directChild"
        at = parent if isinstance(parent, dict) else {"text": parent}

        def below(h: Column) -> Column:
            if direct:
                return F.exists(heads, lambda p: (p["idx"] == h["parent_idx"]) & _same(p, at))
            return F.exists(heads, lambda p: (p["idx"] < h["idx"]) & (p["level"] < h["level"]) & (p["end_line"] >= h["line"]) & _same(p, at))

        found = _when(~F.exists(heads, lambda h: _same(h, child) & below(h)), diagnostic("body.heading.relationship", "body", c.id, "body", "no such heading under its parent", severity))
    elif c.predicate == "section":
        name, filled = c.operand["heading"], c.operand.get("content", "any") == "nonEmpty"
        hit = F.exists(heads, lambda h: _same(h, name) & (~h["direct_empty"] if filled else F.lit(True)))
        found = _when(~hit, diagnostic("body.section.empty-or-missing" if filled else "body.section.missing", "body", c.id, "body", f"section {json.dumps(name, ensure_ascii=False)}", severity))
    else:
        raise DefinitionError("invalid-constraint", c.predicate)
    return F.when(F.col("supports_structure"), found).otherwise(_when(F.lit(True), diagnostic("record.markdown-structure.unsupported", "body", c.id, "body", "the record has no Markdown structure", severity)))


def assess(t: TypeDefinition) -> Column:
    """struct(subject, version, conforms, diagnostics) of one type for the analyzed record."""
    none = F.array().cast(schemas.DIAGNOSTICS)
    front = none
    if t.presence == "required":
        front = _when(~F.col("has_frontmatter"), diagnostic("frontmatter.presence.required", "frontmatter", None, "frontmatter", f"required by {t.name}"))
    for cid, schema in t.resolved or t.schemas:
        front = F.concat(front, F.when(F.size("parse_diagnostics") > 0, none).otherwise(jsonschema.diagnostics(F.col("user_json"), schema, cid)))
    if t.schemas or t.presence == "required":
        gone = F.array(diagnostic("record.frontmatter.syntax-unavailable", "frontmatter", None, "frontmatter", "no frontmatter syntax for this extension"))
        front = F.when(F.col("unavailable_ext").isNotNull(), gone).otherwise(F.concat("parse_diagnostics", front))
    found = F.concat(front, *(constraint(c) for c in (*t.body, *t.context)))
    return F.element_at(F.transform(F.array(found), lambda d: F.struct(F.lit(t.name).alias("subject"), F.lit(t.version).alias("version"), (~F.exists(d, lambda x: x["severity"] == "error")).alias("conforms"), d.alias("diagnostics"))), 1)


def assess_all(analyzed: DataFrame, registry: Registry) -> DataFrame:
    """Adds assessments, one for each type: a projection, never a join."""
    return analyzed.withColumn("assessments", F.array(*(assess(t) for t in registry.types)) if registry.types else F.array().cast(f"array<struct<subject:string,version:string,conforms:boolean,diagnostics:{schemas.DIAGNOSTICS}>>"))


def conforming(assessments: Column) -> Column:
    """Names of the types a record conforms to."""
    return F.transform(F.filter(assessments, lambda a: a["conforms"]), lambda a: a["subject"])


def verify_hints(assessed: DataFrame, registry: Registry) -> DataFrame:
    """path, name, version and status of every type hint: confirmed, rejected, unknownType or unavailableVersion."""
    d = assessed.select("path", "assessments", F.explode("hints").alias("h"))
    a = F.get(F.filter("assessments", lambda x: x["subject"] == F.col("h.name")), F.lit(0))
    status = F.when(a.isNull(), "unknownType").when(F.col("h.version").isNotNull() & (a["version"] != F.col("h.version")), "unavailableVersion").when(a["conforms"], "confirmed").otherwise("rejected")
    return d.select("path", F.col("h.name").alias("name"), F.col("h.version").alias("version"), status.alias("status"))


def _fix(content: str, t: dict, inputs: dict) -> tuple[str, list[str]]:
    """Content with the type's mechanical fixes, and what still needs a value."""
    m = {f: p for f, p in (("yaml", "---"), ("toml", "+++"))}
    form, raw, body = None, "", content
    for f, mark in m.items():
        if content.startswith(mark + "\n"):
            end = content.find("\n" + mark, 3)
            if end >= 0:
                form, raw = f, content[4:end] if end > 3 else ""
                rest = content[end + 4 :]
                body = rest[2:] if rest.startswith("\r\n") else rest[1:] if rest.startswith("\n") else rest
    open_: list[str] = []
    mapping = values.read(raw, form) if form else {}
    added = {}
    for schema in t["schemas"]:
        for name in schema.get("required", []):
            if name in mapping or name in added:
                continue
            rule = schema.get("properties", {}).get(name, {})
            if name in inputs:
                added[name] = inputs[name]
            elif "const" in rule or "default" in rule:
                added[name] = rule.get("const", rule.get("default"))
            else:
                open_.append(name)
    missing = form is None and (t["presence"] == "required" or added)
    if missing or added:
        form = form or "yaml"
        mark = m[form]
        # Existing text is kept as it stands; new members are appended to it.
        head = (raw.rstrip("\n") + "\n" if raw.strip() else "") + values.write(added, form) if form == "yaml" else values.write({**mapping, **added}, form)
        content = f"{mark}\n{head}{mark}\n{body}"
    heads = {(h["text"], h["level"]) for h in markdown.headings(body)}
    for want in t["headings"]:
        level = want.get("level") or 1
        if not any(text == want["text"] and (not want.get("level") or want["level"] == lv) for text, lv in heads):
            content = content.rstrip("\n") + ("\n\n" if content.strip() else "") + "#" * level + " " + want["text"] + "\n"
    return content, open_


@lazy("struct<content:string,open:array<string>,error:string>")
def _fixed(content: pa.Array, definition: pa.Array, inputs: pa.Array) -> pa.Array:
    out = []
    for c, t, i in zip(*(x.to_pylist() for x in (content, definition, inputs)), strict=True):
        try:
            text, open_ = _fix(c, json.loads(t), json.loads(i))
            out.append({"content": text, "open": open_, "error": None})
        except values.FrontmatterError as e:
            out.append({"content": c, "open": [], "error": e.code})
    return pa.array(out, pa.struct([("content", pa.string()), ("open", pa.list_(pa.string())), ("error", pa.string())]))


def fix(content: Column, t: TypeDefinition, inputs: dict | None = None) -> Column:
    """struct(content, open, error): required members that a schema or the inputs give, frontmatter and headings added;
    open names members that need a value (Y6)."""
    heads = [c.operand if isinstance(c.operand, dict) else {"text": c.operand} for c in t.body if c.predicate == "heading"]
    data = {"presence": t.presence, "schemas": [s for _, s in t.resolved or t.schemas], "headings": heads}
    return _fixed(content, F.lit(json.dumps(data)), F.lit(json.dumps(inputs or {})))


def describe(registry: Registry) -> list[dict]:
    """Names, versions and constraints."""
    return [{"name": t.name, "version": t.version, "presence": t.presence, "schemas": [i for i, _ in t.schemas], "constraints": [{"id": c.id, c.predicate: c.operand} for c in (*t.body, *t.context)]} for t in registry.types]


def doctor(registry: Registry) -> list[str]:
    """Advice on versions that are no semantic versions."""
    import re

    return [f"{t.name}: version {t.version} is not a semantic version" for t in registry.types if not re.fullmatch(r"\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.+-]+)?", t.version)]

