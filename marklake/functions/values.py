"""Scalar values of frontmatter in plain Python: reading and writing YAML and TOML, canonical JSON. No Spark here."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import tomllib
from typing import Any

import yaml

_Base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


class Loader(_Base):
    """YAML with these plain scalars only: null, true/false, integers, floats; dates stay strings."""


Loader.yaml_implicit_resolvers = {}
Loader.add_implicit_resolver("tag:yaml.org,2002:null", re.compile(r"^(?:~|null|Null|NULL|)$"), ["~", "n", "N", ""])
Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
Loader.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^[-+]?(?:0|[1-9][0-9]*|0o[0-7]+|0x[0-9a-fA-F]+)$"), list("-+0123456789"))
Loader.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$"), list("-+0123456789."))


class FrontmatterError(ValueError):
    """code: one of root-not-mapping, non-string-key, invalid-yaml, invalid-toml, null-in-toml."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


#: Lines of the simple form: a key with a scalar that needs no quotes, and items of a list of such scalars.
_KEY = re.compile(r"([A-Za-z][A-Za-z0-9_-]*):(?: ([A-Za-z0-9](?:[A-Za-z0-9 _./-]*[A-Za-z0-9_./-])?))?")
_ITEM = re.compile(r"((?:  )?)- ([A-Za-z0-9](?:[A-Za-z0-9 _./-]*[A-Za-z0-9_./-])?)")
_INT, _DAY = re.compile(r"0|[1-9][0-9]*"), re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]+-[A-Za-z][A-Za-z-]*")
_NAMED = {w: v for v, ws in ((None, "null Null NULL"), (True, "true True TRUE"), (False, "false False FALSE")) for w in ws.split()}


def _simple_yaml(text: str) -> dict[str, Any] | None:
    """Mapping of a block of simple lines, as the loader would read it; None for anything else."""
    out: dict[str, Any] = {}
    items: list | None = None
    key = indent = ""
    for line in text.split("\n"):
        m = _ITEM.fullmatch(line) if items is not None else None
        if m is not None:
            indent = m[1] if not items else indent
            if m[1] != indent:
                return None
        if m is None:
            m = _KEY.fullmatch(line)
            if m is None or m[1] in _NAMED:
                return None
            key, word = m[1], m[2]
            if word is None:
                if key in out:
                    return None
                items = []
                out[key] = None
                continue
            items = None
        else:
            word = m[2]
        if word in _NAMED:
            value = _NAMED[word]
        elif word[0].isdigit():
            if _INT.fullmatch(word):
                value = int(word)
            elif _DAY.fullmatch(word):
                value = word
            else:
                return None
        else:
            value = word
        if items is None:
            out[key] = value
        else:
            items.append(value)
            out[key] = items
    return out


def read_yaml(text: str) -> dict[str, Any]:
    """Mapping of a YAML block; a blank one is empty. Blocks of simple lines don't need the full loader."""
    if not text.strip():
        return {}
    if (simple := _simple_yaml(text)) is not None:
        return simple
    try:
        value = yaml.load(text, Loader)  # noqa: S506
    except (yaml.YAMLError, ValueError) as e:
        raise FrontmatterError("invalid-yaml", str(e).split("\n")[0]) from e
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise FrontmatterError("root-not-mapping", "frontmatter is not a mapping")
    return plain(value)


def read_toml(text: str) -> dict[str, Any]:
    try:
        return plain(tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise FrontmatterError("invalid-toml", str(e)) from e


def plain(value: Any) -> Any:
    """Value of JSON kinds only: TOML dates become text, integral floats integers."""
    if isinstance(value, dict):
        if bad := [k for k in value if not isinstance(k, str)]:
            raise FrontmatterError("non-string-key", f"key is not a string: {bad[0]!r}")
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, dt.datetime):
        return value.isoformat().replace("+00:00", "Z")
    if isinstance(value, (dt.date, dt.time)):
        return value.isoformat()
    if isinstance(value, float):
        return int(value) if math.isfinite(value) and value == int(value) and abs(value) < 2**53 else value if math.isfinite(value) else str(value)
    return value


#: Made once: json.dumps with options makes an encoder for every call.
_canonical = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode


def canonical(value: Any) -> str:
    """JSON text that is equal for equal values."""
    if type(value) is int:
        return repr(value)
    if type(value) is list:
        return "[" + ",".join(map(canonical, value)) + "]"
    return _canonical(plain(value))


def kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def entries(mapping: dict[str, Any]) -> list[dict]:
    out = []
    for pos, (key, v) in enumerate(mapping.items()):
        k = kind(v)
        text = v if k == "string" else canonical(v) if k in ("number", "boolean") else None
        out.append({"pos": pos, "key": key, "kind": k, "json": canonical(v), "text": text, "items": [canonical(x) for x in v] if k == "array" else None})
    return out


class Dumper(getattr(yaml, "SafeDumper", yaml.SafeDumper)):
    """Block style with indented sequences; strings that read back as strings stay plain."""

    def increase_indent(self, flow: bool = False, indentless: bool = False):  # noqa: ARG002
        return super().increase_indent(flow, False)


Dumper.yaml_implicit_resolvers = Loader.yaml_implicit_resolvers


def write_yaml(mapping: dict[str, Any]) -> str:
    return yaml.dump(mapping, Dumper=Dumper, sort_keys=False, allow_unicode=True, default_flow_style=False, width=10**9) if mapping else ""


def write_toml(mapping: dict[str, Any]) -> str:
    """TOML with sorted keys; nulls can't be written."""
    lines: list[str] = []

    def basic(s: str) -> str:
        return json.dumps(s, ensure_ascii=False).replace("\x7f", "\\u007f")

    def name(k: str) -> str:
        return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else basic(k)

    def inline(v: Any, path: str) -> str:
        if v is None:
            raise FrontmatterError("null-in-toml", f"null at {path}")
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return basic(v)
        if isinstance(v, list):
            return "[" + ", ".join(inline(x, f"{path}[{i}]") for i, x in enumerate(v)) + "]"
        if isinstance(v, dict):
            return "{ " + ", ".join(f"{name(k)} = {inline(v[k], f'{path}.{k}')}" for k in sorted(v)) + " }" if v else "{}"
        return repr(v)

    def section(m: dict, path: list[str]) -> None:
        flat, nested = [k for k in sorted(m) if not isinstance(m[k], dict)], [k for k in sorted(m) if isinstance(m[k], dict)]
        if path and (flat or not nested):
            lines.append(("\n" if lines else "") + "[" + ".".join(map(name, path)) + "]")
        lines.extend(f"{name(k)} = {inline(m[k], '.'.join([*path, k]))}" for k in flat)
        for k in nested:
            section(m[k], [*path, k])

    section(mapping, [])
    return "".join(f"{x}\n" for x in lines)


def read(text: str, form: str) -> dict[str, Any]:
    return read_toml(text) if form == "toml" else read_yaml(text)


def write(mapping: dict[str, Any], form: str) -> str:
    return write_toml(mapping) if form == "toml" else write_yaml(mapping)
