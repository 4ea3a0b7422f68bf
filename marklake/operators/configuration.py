"""Rule files as users write them, and all that is wrong with a set of rules."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import SparkSession

from marklake.functions import jmespath, jsonschema, predicates
from marklake.operators import types
from marklake.operators.rules import Check, Compiled, Rule, RuleError, java_pattern

# The members that each object of a rule file may have, by version of the file.
LEGACY, CURRENT = "0.1.0", "0.2.0"
FILE_MEMBERS = {LEGACY: ("$schema", "configVersion", "schemaDirectory", "schemaRules"), CURRENT: ("$schema", "configVersion", "schemaDirectory", "rules")}
RULE_MEMBERS = {LEGACY: ("name", "schema", "frontmatterRequired", "match"), CURRENT: ("name", "match", "checks")}
MATCH_MEMBERS = ("paths", "excludePaths", "file", "frontmatter", "frontmatterQuery", "document")
CHECK_MEMBERS = {"frontmatterSchema": ("type", "schema", "frontmatterRequired"), "requiredHeading": ("type", "heading"), "maxBodyLines": ("type", "max"), "maxBodyWords": ("type", "max")}

# What the operand of a predicate has to be.
OPERANDS = {
    "equals": "any", "doesntEqual": "any", "includes": "any", "notIncludes": "any", "hasKey": "true", "doesntHaveKey": "true", "regex": "text", "startsWith": "text", "endsWith": "text", "contains": "text",
    "empty": "true", "emptyString": "true", "emptyArray": "true", "emptyObject": "true", "notEmpty": "true", "in": "list", "notIn": "list",
    "greaterThan": "number", "greaterThanOrEqual": "number", "lessThan": "number", "lessThanOrEqual": "number", "after": "date", "onOrAfter": "date", "before": "date", "onOrBefore": "date", "between": "span", "typeIs": "kind",
    "pathRegex": "text", "filenameEquals": "text", "extensionIn": "texts", "modifiedAfter": "date", "modifiedBefore": "date",
    "hasHeading": "text", "headingRegex": "text", "hasHeadingAtLevel": "heading", "hasSection": "text", "bodyContains": "text", "bodyRegex": "text", "hasWikilink": "link", "lineCount": "range", "wordCount": "range",
}
FILE_PREDICATES = ("pathRegex", "filenameEquals", "extensionIn", "modifiedAfter", "modifiedBefore")
DOCUMENT_PREDICATES = ("hasHeading", "headingRegex", "hasHeadingAtLevel", "hasSection", "bodyContains", "bodyRegex", "hasWikilink", "lineCount", "wordCount")
KINDS = ("null", "boolean", "number", "string", "array", "object")

# Codes of what is wrong with a rule.
INVALID_NAME, DUPLICATE_NAME, DUPLICATE_ID, INVALID_OPERAND = "rule.name.invalid", "rule.name.duplicate", "rule.identifier.duplicate", "rule.operand.invalid"
NO_CAPABILITY, NO_TYPE, NO_SCHEMA, UNSUPPORTED = "rule.capability.missing", "rule.type.missing", "rule.schema.unresolved", "rule.feature.unsupported"
#: What a runtime may lack: predicates that need it.
CAPABILITIES = {"jmespath": "frontmatterQuery", "regularExpressions": "regex"}


def _wrong(where: str, what: str, code: str = "invalid-field") -> RuleError:
    return RuleError(code, f"{where} {what}")


def _members(value: Any, allowed: Iterable[str], where: str) -> dict:
    if not isinstance(value, dict):
        raise _wrong(where, "must be an object")
    if unknown := sorted(set(value) - set(allowed)):
        raise _wrong(where, f"contains unsupported key(s): {', '.join(unknown)}", "unsupported-feature")
    return value


def _text(value: Any, where: str) -> str:
    if not isinstance(value, str) or not value:
        raise _wrong(where, "must be a nonempty string")
    return value


def _texts(value: Any, where: str) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, str) and x for x in value):
        raise _wrong(where, "must be an array of nonempty strings")
    return value


def _number(value: Any, where: str, whole: bool = False) -> float:
    if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)) or (whole and value < 0):
        raise _wrong(where, "must be a nonnegative integer" if whole else "must be a number")
    return value


def _date(value: Any, where: str) -> str:
    if not predicates._is_date(value):
        raise _wrong(where, "must be a date or a date-time")
    return value


def operand(name: str, value: Any, where: str) -> Any:
    """The operand of a predicate as the engine takes it, once it is what the predicate asks for."""
    kind = OPERANDS.get(name)
    if kind is None:
        raise _wrong(where, "is no supported predicate", "unsupported-feature")
    if kind == "true" and value is not True:
        raise _wrong(where, "must be true")
    if kind == "text":
        return _text(value, where)
    if kind == "texts":
        return [x.lower().strip(".") for x in _texts(value, where)]
    if kind == "list" and not isinstance(value, list):
        raise _wrong(where, "must be an array")
    if kind == "number":
        return _number(value, where)
    if kind == "date":
        return _date(value, where)
    if kind == "kind" and _text(value, where) not in KINDS:
        raise _wrong(where, f'has unsupported JSON type "{value}"')
    if kind == "link":
        return True if value is True else _text(value, where)
    if kind == "heading":
        at = _members(value, ("heading", "level"), where)
        if _number(at.get("level"), f"{where}.level", whole=True) not in range(1, 7):
            raise _wrong(f"{where}.level", "must be 1...6")
        return (at["level"], _text(at.get("heading"), f"{where}.heading"))
    if kind == "range":
        ends = _members(value, ("min", "max"), where)
        if not ends:
            raise _wrong(where, "requires min or max")
        low, high = (None if ends.get(k) is None else _number(ends[k], f"{where}.{k}", whole=True) for k in ("min", "max"))
        if None not in (low, high) and low > high:
            raise _wrong(where, "min cannot exceed max")
        return (low, high)
    if kind == "span":
        ends = _members(value, ("from", "to"), where)
        if set(ends) != {"from", "to"}:
            raise _wrong(where, "requires from and to")
        pair = (ends["from"], ends["to"])
        checked = [_date(x, where) for x in pair] if isinstance(pair[0], str) else [_number(x, where) for x in pair]
        if checked[0] > checked[1]:
            raise _wrong(where, "from cannot exceed to")
        return pair
    return value


def _match(data: Any, name: str) -> dict[str, Any]:
    where = f'Rule "{name}" match'
    m = _members(data, MATCH_MEMBERS, where)
    fields = []
    for key, ops in sorted(_members(m.get("frontmatter", {}), m.get("frontmatter", {}), f"{where}.frontmatter").items()):
        if not isinstance(ops, dict):
            raise _wrong(f"{where}.frontmatter.{key}", "must be an object")
        fields += [(key, op, operand(op, value, f"frontmatter.{key}.{op}")) for op, value in sorted(ops.items())]
    record = [(k, operand(k, v, f"{where}.{group}.{k}")) for group, allowed in (("file", FILE_PREDICATES), ("document", DOCUMENT_PREDICATES)) for k, v in sorted(_members(m.get(group, {}), allowed, f"{where}.{group}").items())]
    query = _members(m.get("frontmatterQuery", {}), ("jmespath",), f"{where}.frontmatterQuery").get("jmespath")
    found = {"paths": tuple(_texts(m.get("paths", []), f"{where}.paths")), "exclude_paths": tuple(_texts(m.get("excludePaths", []), f"{where}.excludePaths")), "fields": tuple(fields), "record": tuple(record), "query": None if query is None else _text(query, f"{where}.frontmatterQuery.jmespath")}
    if not (found["paths"] or fields or record or query):
        raise _wrong(where, "must define at least one match condition")
    return found


def _check(data: Any, name: str, i: int) -> Check:
    where, kind = f'Rule "{name}" check[{i}]', data.get("type") if isinstance(data, dict) else None
    if kind not in CHECK_MEMBERS:
        raise _wrong(where, f"has unsupported type {kind!r}", "unsupported-feature")
    c = _members(data, CHECK_MEMBERS[kind], where)
    if kind == "frontmatterSchema":
        return Check(f"{name}.check[{i}]", kind, _text(c.get("schema"), f"{where}.schema"), presence="optional" if c.get("frontmatterRequired", True) is False else "required")
    return Check(f"{name}.check[{i}]", kind, _text(c.get("heading"), f"{where}.heading") if kind == "requiredHeading" else _number(c.get("max"), f"{where}.max", whole=True))


def decode(data: dict | str, load: Callable[[str], dict] | None = None) -> list[Rule]:
    """Rules of a rule file (R1): 0.1.0 (without a version, too) has schemaRules with a schema each, 0.2.0 rules with checks.

    Schemas are named by reference. load gives the schema of a path (schemaDirectory and reference); without it they
    stay references, which `diagnose` reports. Raises RuleError: invalid-serialization, invalid-field,
    unsupported-version or unsupported-feature.
    """
    if isinstance(data, str):
        try:
            data = json.loads(data)
        except ValueError as e:
            raise RuleError("invalid-serialization", str(e)) from e
    if not isinstance(data, dict):
        raise RuleError("invalid-serialization", "the configuration is not an object")
    version = _text(data["configVersion"], "configVersion") if "configVersion" in data else LEGACY
    if version not in FILE_MEMBERS:
        raise RuleError("unsupported-version", version)
    _members(data, FILE_MEMBERS[version], "configuration")
    rows = data.get("schemaRules" if version == LEGACY else "rules", [])
    out = []
    for i, r in enumerate(rows if isinstance(rows, list) else []):
        _members(r, RULE_MEMBERS[version], f"rules[{i}]")
        name = _text(r.get("name"), f"rules[{i}].name")
        match = _match(r.get("match"), name)
        checks = [{"type": "frontmatterSchema", **{k: v for k, v in r.items() if k in ("schema", "frontmatterRequired")}}] if version == LEGACY else r.get("checks")
        if not isinstance(checks, list) or not checks:
            raise _wrong(f'Rule "{name}"', "requires at least one check")
        made = [_check(c, name, k) for k, c in enumerate(checks)]
        if load:
            folder = str(data.get("schemaDirectory", "schemas/")).rstrip("/")
            made = [Check(c.id, c.kind, load(f"{folder}/{c.operand}"), c.severity, c.presence) if c.kind == "frontmatterSchema" else c for c in made]
        out.append(Rule(name, match["paths"], match["exclude_paths"], match["fields"], match["record"], match["query"], checks=tuple(made)))
    if repeated := [n for n, k in Counter(r.name for r in out).items() if k > 1]:
        raise RuleError("invalid-field", f"rule names must be unique: {', '.join(sorted(repeated))}")
    return out


def diagnose(rules: list[Rule], registry: types.Registry | None = None, lacks: Iterable[str] = (), spark: SparkSession | None = None) -> list[tuple[str, str, str]]:
    """(location, code, message) of everything that is wrong with the rules, sorted (R2). lacks: capabilities that the runtime does not have."""
    out, names, known = [], Counter(r.name for r in rules), {t.name for t in registry.types} if registry else set()
    for i, r in enumerate(rules):
        at = f"rules[{i}]"
        say = lambda code, where, message, at=at: out.append((f"{at}{where}", code, message))
        if not r.name or r.name.strip() != r.name:
            say(INVALID_NAME, ".name", "rule names must be nonempty and cannot have surrounding whitespace")
        if names[r.name] > 1:
            say(DUPLICATE_NAME, ".name", f'rule name "{r.name}" is configured more than once')
        for identifier, n in sorted(Counter(c.id for c in r.checks).items()):
            if n > 1:
                say(DUPLICATE_ID, "", f'rule "{r.name}" contains duplicate identifier "{identifier}"')
        for t in (*r.any_types, *r.all_types):
            if t not in known:
                say(NO_TYPE, ".applicability.types", f'rule "{r.name}" references unavailable type "{t}"')
        needs = set()
        asked = [(op, value) for _, op, value in r.fields] + [(k, list(v) if isinstance(v, tuple) else v) for k, v in r.record]
        for k, (op, value) in enumerate(asked):
            where = f".applicability.requirements[{k}]"
            if op not in OPERANDS:
                say(UNSUPPORTED, where, f"unsupported predicate {op}")
            elif op == "regex" or op.endswith("Regex"):
                needs.add("regularExpressions")
                if not isinstance(value, str) or not java_pattern(spark, value):
                    say(INVALID_OPERAND, where, f"invalid pattern {value!r}")
            elif op in ("lineCount", "wordCount", "between") and None not in value and value[0] > value[1]:
                say(INVALID_OPERAND, where, "the lower end exceeds the upper one")
        if r.query:
            needs.add("jmespath")
            try:
                jmespath.parse(r.query)
            except jmespath.JMESPathError as e:
                say(INVALID_OPERAND, f".applicability.requirements[{len(asked)}]", f"invalid query: {e}")
        for c in sorted(needs & set(lacks)):
            say(NO_CAPABILITY, ".capabilities", f'rule "{r.name}" requires runtime capability "{c}"')
        for c in r.checks:
            if c.kind == "frontmatterSchema":
                try:
                    if isinstance(c.operand, str):
                        raise jsonschema.SchemaError(f"{c.operand} is not loaded")
                    jsonschema.resolve(c.operand)
                except jsonschema.SchemaError as e:
                    say(NO_SCHEMA, ".checks", f"{c.id}: {e}")
            elif c.kind not in CHECK_MEMBERS and c.kind not in types.PREDICATES:
                say(UNSUPPORTED, ".checks", f"{c.id}: {c.kind}")
    return sorted(out)


def compile_rules(rules: list[Rule], registry: types.Registry | None = None, lacks: Iterable[str] = (), spark: SparkSession | None = None) -> tuple[Compiled | None, list[tuple[str, str, str]]]:
    """The compiled rules, or what is wrong with them."""
    bad = diagnose(rules, registry, lacks, spark)
    return (None if bad else Compiled.of(rules, registry)), bad
