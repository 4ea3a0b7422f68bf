"""Server configurations: which selections are served under which routes, and what is wrong with them (V1, V2)."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass
from itertools import zip_longest

from marklake.operators import identity, rules, serve, types

# Version, operations, projection, selection modes with their members, and diagnostic codes.
VERSION, OPERATIONS, PROJECTIONS = "1", ("get", "list"), ("genericRecord",)
MODES = {"rule": ("rule",), "type": ("type", "searchRoot"), "ruleWithExpectedType": ("rule", "type")}
BAD_VERSION, BAD_NAME, SAME_NAME = "endpoint.configuration.unsupported-version", "endpoint.resource.invalid-name", "endpoint.resource.duplicate-name"
NO_OPERATION, SAME_OPERATION = "endpoint.operation.missing", "endpoint.operation.duplicate"
SAME_OVERRIDE, DISABLED_OVERRIDE, BAD_ID, SAME_ID = "endpoint.operation-id.duplicate-override", "endpoint.operation-id.disabled-operation", "endpoint.operation-id.invalid", "endpoint.operation-id.duplicate"
NO_RULE, NO_TYPE, BAD_ROOT = "endpoint.reference.rule-missing", "endpoint.reference.type-missing", "endpoint.selection.invalid-search-root"
UNSAFE, RESERVED, COLLISION = "endpoint.route.unsafe", "endpoint.route.reserved", "endpoint.route.collision"
OPENAPI = "/openapi.json"
#: First segment of the routes that the server keeps for itself; deployments with another one give it.
NAMESPACE = "_engine"


@dataclass(frozen=True)
class Endpoint:
    name: str
    route: str
    operations: tuple[str, ...]
    mode: str
    rule: str | None = None
    type: str | None = None
    search_root: str | None = None
    policy: identity.Policy = identity.Policy()
    overrides: tuple[tuple[str, str], ...] = ()

    def resource(self) -> serve.Resource:
        """What `serve.memberships` selects for it."""
        mode = {"ruleWithExpectedType": "typed-rule"}.get(self.mode, self.mode)
        root = None if self.search_root in (None, ".") else self.search_root.rstrip("/")
        return serve.Resource(self.name, self.route, mode, self.rule, self.type, root, self.policy)


def decode(data: dict | str) -> tuple[str, list[Endpoint]]:
    """Version and endpoints of a server configuration (V1). Raises ValueError where a member is missing or unknown."""
    data = json.loads(data) if isinstance(data, str) else data
    out = []
    for i, r in enumerate(data.get("resources", [])):
        where, s = f"resources[{i}]", r.get("selection", {})
        mode = s.get("mode")
        if mode not in MODES or not all(isinstance(s.get(k), str) for k in MODES[mode]):
            raise ValueError(f"{where}.selection: a mode ({', '.join(MODES)}) and its members are needed")
        if not all(isinstance(r.get(k), str) for k in ("name", "route")):
            raise ValueError(f"{where}: name and route are needed")
        if unknown := set(r.get("operations", [])) - set(OPERATIONS):
            raise ValueError(f"{where}.operations: unknown {sorted(unknown)[0]}")
        if r.get("projectionPolicy", PROJECTIONS[0]) not in PROJECTIONS:
            raise ValueError(f"{where}.projectionPolicy: unknown")
        p = r.get("identityPolicy", {})
        policy = identity.Policy(p.get("source", "path"), tuple(p.get("path", [])), p.get("format", "string"), p.get("logicalPathFallbackEnabled", True))
        overrides = tuple((o["operation"], o["operationID"]) for o in r.get("operationIDOverrides", []))
        out.append(Endpoint(r["name"], r["route"], tuple(r.get("operations", [])), mode, s.get("rule"), s.get("type"), s.get("searchRoot"), policy, overrides))
    return str(data.get("serverConfigVersion", VERSION)), out


def safe(route: str) -> bool:
    """Whether a route is an absolute path of literal segments."""
    return bool(re.fullmatch(r"(?:/(?!\.{1,2}(?:/|\Z))[^/\\?#*{}:%\s\x00-\x1f\x7f-\x9f]+)+", route))


def root_ok(root: str) -> bool:
    """Whether a search root is . or a directory below the collection, with a slash at its end."""
    return root == "." or (root.endswith("/") and all(x not in ("", ".", "..") for x in root[:-1].split("/")) and "\\" not in root)


def overlap(a: str, b: str) -> bool:
    """Whether two templates can match one path: parameters match any segment, {path} any rest."""
    x, y = ([s for s in t.split("/") if s] for t in (a, b))
    x, y = (y, x) if y[-1:] == ["{path}"] and x[-1:] != ["{path}"] else (x, y)
    if x[-1:] == ["{path}"]:
        x, y = x[:-1], y[: len(x) - 1]
    meets = lambda p, q: None not in (p, q) and (p == q or p[0] == "{" or q[0] == "{")
    return all(meets(p, q) for p, q in zip_longest(x, y))


def routes(endpoints: list[Endpoint], namespace: str = NAMESPACE) -> list[tuple[str, str, str]]:
    """(location, template, operation id) of every operation that the endpoints expose, and of the server's own."""
    out = []
    for i, e in enumerate(endpoints):
        ids = dict(e.overrides)
        out += [(f"resources[{i}].operations.{op}", e.route + ("/{id}" if op == "get" else ""), ids.get(op, f"{e.name}.{op}")) for op in sorted(set(e.operations))]
    if any("get" in e.operations and e.policy.path_fallback for e in endpoints):
        out.append(("routes.logicalPath", f"/{namespace}/path/{{path}}", f"{namespace}.path.get"))
    return [*out, ("routes.openAPI", OPENAPI, f"{namespace}.openapi.get")]


def diagnose(version: str, endpoints: list[Endpoint], compiled: rules.Compiled, registry: types.Registry, namespace: str = NAMESPACE) -> list[tuple[str, str]]:
    """(location, code) of everything that is wrong, sorted (V2). Only endpoints without a fault of their own collide with others."""
    out = [("serverConfigVersion", BAD_VERSION)] if version != VERSION else []
    names, known_rules, known_types = Counter(e.name for e in endpoints), {r.name for r in compiled.rules}, {t.name for t in registry.types}
    sound = {}
    for i, e in enumerate(endpoints):
        at, before = f"resources[{i}]", len(out)
        faults = [
            (".name", BAD_NAME, not e.name or e.name.strip() != e.name), (".name", SAME_NAME, names[e.name] > 1), (".operations", NO_OPERATION, not e.operations),
            (".route", UNSAFE, not safe(e.route)), (".route", RESERVED, safe(e.route) and e.route.split("/")[1] == namespace), (".selection.rule", NO_RULE, e.rule is not None and "rule" in MODES[e.mode] and e.rule not in known_rules),
            (".selection.type", NO_TYPE, "type" in MODES[e.mode] and e.type not in known_types), (".selection.searchRoot", BAD_ROOT, e.mode == "type" and not root_ok(e.search_root or "")),
        ]
        faults += [(".operations", SAME_OPERATION, True) for n in Counter(e.operations).values() if n > 1]
        repeated = Counter(op for op, _ in e.overrides)
        for k, (op, given) in enumerate(e.overrides):
            over = f".operationIDOverrides[{k}]"
            faults += [(over, SAME_OVERRIDE, repeated[op] > 1), (over, DISABLED_OVERRIDE, op not in e.operations), (f"{over}.operationID", BAD_ID, not given.strip())]
        out += [(at + where, code) for where, code, wrong in faults if wrong]
        sound[at] = len(out) == before
    all_of = [x for x in routes(endpoints, namespace) if sound.get(x[0].split(".")[0], True)]
    ids = Counter(x[2] for x in all_of)
    out += [(where, SAME_ID) for where, _, given in all_of if ids[given] > 1]
    out += [(where, COLLISION) for k, (where, template, _) in enumerate(all_of) if any(j != k and overlap(template, other) for j, (_, other, _) in enumerate(all_of))]
    return sorted(out)


def compile_plan(data: dict | str, compiled: rules.Compiled, registry: types.Registry, namespace: str = NAMESPACE) -> tuple[serve.Plan | None, list[tuple[str, str]]]:
    """A plan for `serve`, ordered by route, or what is wrong with the configuration."""
    version, found = decode(data)
    bad = diagnose(version, found, compiled, registry, namespace)
    return (None if bad else serve.Plan(tuple(sorted((e.resource() for e in found), key=lambda r: r.route)), compiled, registry)), bad
