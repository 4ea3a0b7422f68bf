"""Markdown in plain Python: block and inline scanning, plain text, formatting. No Spark here; Columns are in body.py.

The scanner knows ATX and setext headings, fenced and indented code, HTML blocks, block quotes and lists. Only headings
of the top level count. Inline text knows escapes, code spans, images, links, autolinks, emphasis and strikethrough.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$")
CLOSING = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})(.*)$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
THEMATIC = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
QUOTE = re.compile(r"^ {0,3}> ?")
HTML_LONG = ((re.compile(r"^ {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)), (re.compile(r"^ {0,3}<!--"), re.compile(r"-->")), (re.compile(r"^ {0,3}<\?"), re.compile(r"\?>")), (re.compile(r"^ {0,3}<![A-Za-z]"), re.compile(r">")), (re.compile(r"^ {0,3}<!\[CDATA\["), re.compile(r"\]\]>")))
# Element names that begin an HTML block, as CommonMark lists them.
HTML_NAMES = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
HTML_BLOCK = re.compile(rf"^ {{0,3}}</?(?:{'|'.join(HTML_NAMES.split())})(?:\s|/?>|$)", re.I)
HTML_ANY = re.compile(r"^ {0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$")
TABLE_RULE = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


@dataclass
class Block:
    """kind: heading, paragraph, code, html, quote, list, item, rule or table; lines are counted from 0, end exclusive."""

    kind: str
    start: int
    end: int
    text: list[str] = field(default_factory=list)
    level: int = 0
    parts: list[Block] = field(default_factory=list)


def blocks(lines: list[str], first: int = 0) -> list[Block]:
    """Blocks of lines, whose first has the number `first`."""
    out: list[Block] = []
    para: list[str] = []
    i, n = 0, len(lines)

    def close(at: int) -> None:
        if para:
            table = next((k for k in range(1, len(para)) if "|" in para[k - 1] and TABLE_RULE.match(para[k]) and "|" in para[k]), 0)
            kind = "table" if table == 1 else "paragraph"
            out.append(Block(kind, first + at - len(para), first + at, list(para)))
            para.clear()

    while i < n:
        line = lines[i].replace("\t", "    ")
        if not line.strip():
            close(i)
            i += 1
            continue
        if not para and line.startswith("    "):
            j = i
            while j < n and (lines[j].startswith(("    ", "\t")) or not lines[j].strip()):
                j += 1
            while not lines[j - 1].strip():
                j -= 1
            out.append(Block("code", first + i, first + j, [x.replace("\t", "    ", 1)[4:] for x in lines[i:j]]))
            i = j
            continue
        if m := FENCE.match(line):
            close(i)
            indent = len(line) - len(line.lstrip(" "))
            end = re.compile(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
            j = next((k for k in range(i + 1, n) if end.match(lines[k])), n)
            out.append(Block("code", first + i, first + min(n, j + 1), [re.sub(rf"^ {{0,{indent}}}", "", x) for x in lines[i + 1 : j]]))
            i = j + 1
            continue
        if m := ATX.match(line):
            close(i)
            out.append(Block("heading", first + i, first + i + 1, [CLOSING.sub("", m[2] or "").strip()], len(m[1])))
            i += 1
            continue
        if para and (m := SETEXT.match(line)):
            text = [x.strip() for x in para]
            start = first + i - len(para)
            para.clear()
            out.append(Block("heading", start, first + i + 1, text, 1 if m[1][0] == "=" else 2))
            i += 1
            continue
        if THEMATIC.match(line):
            close(i)
            out.append(Block("rule", first + i, first + i + 1))
            i += 1
            continue
        long = next((end for begin, end in HTML_LONG if begin.match(line)), None)
        if long:
            close(i)
            j = next((k for k in range(i, n) if long.search(lines[k])), n - 1)
            out.append(Block("html", first + i, first + j + 1, lines[i : j + 1]))
            i = j + 1
            continue
        if HTML_BLOCK.match(line) or not para and HTML_ANY.match(line):
            close(i)
            j = next((k for k in range(i, n) if not lines[k].strip()), n)
            out.append(Block("html", first + i, first + j, lines[i:j]))
            i = j
            continue
        if QUOTE.match(line):
            close(i)
            j, inner = i, []
            while j < n and (QUOTE.match(lines[j]) or lines[j].strip() and inner and inner[-1].strip() and not _starts(lines[j])):
                inner.append(QUOTE.sub("", lines[j], count=1))
                j += 1
            out.append(Block("quote", first + i, first + j, parts=blocks(inner, first + i)))
            i = j
            continue
        m = ITEM.match(line)
        if m and not (para and (m[3] == "" or m[2][0].isdigit() and m[2][:-1] != "1")):
            close(i)
            items, j, mark = [], i, m[2][-1]
            while j < n and (m := ITEM.match(lines[j].replace("\t", "    "))) and m[2][-1] == mark and not THEMATIC.match(lines[j]):
                width = len(m[1]) + len(m[2]) + (len(m[3]) if 0 < len(m[3]) <= 4 else 1)
                inner, k, blank = [lines[j].replace("\t", "    ")[width:]], j + 1, False
                while k < n:
                    x = lines[k].replace("\t", "    ")
                    if not x.strip():
                        blank = True
                        inner.append("")
                    elif x.startswith(" " * width):
                        blank = False
                        inner.append(x[width:])
                    elif not blank and not _starts(x):
                        inner.append(x.strip())
                    else:
                        break
                    k += 1
                items.append(Block("item", first + j, first + k, parts=blocks(inner, first + j)))
                j = k
            out.append(Block("list", first + i, first + j, parts=items))
            i = j
            continue
        para.append(lines[i])
        i += 1
    close(n)
    return out


def _starts(line: str) -> bool:
    """Whether a line begins a block of its own, so that it can't continue a paragraph."""
    return bool(ATX.match(line) or FENCE.match(line) or THEMATIC.match(line) or QUOTE.match(line) or ITEM.match(line) or HTML_BLOCK.match(line))


ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|<!--.*?-->", re.S)
LINK = re.compile(r"(!?)\[((?:[^\[\]]|\[[^\[\]]*\])*)\](?:\(\s*(?:<[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)|\[[^\[\]]*\])")
EMPHASIS = tuple(
    re.compile(p, re.S)
    for p in (r"(?<!\*)\*\*(?=\S)(.+?)(?<=\S)\*\*(?!\*)|(?<![\w_])__(?=\S)(.+?)(?<=\S)__(?![\w_])", r"(?<!\*)\*(?![\s*])(.+?)(?<![\s*])\*(?!\*)|(?<![\w_])_(?![\s_])(.+?)(?<![\s_])_(?![\w_])", r"(?<!~)~~?(?=\S)([^~]+?)(?<=\S)~~?(?!~)")
)


def inline(text: str, html_kept: bool, alt: bool, line_break: str) -> str:
    """Text of inline content. html_kept: raw tags stay; alt: an image's description stays; line_break: for each break."""
    held: list[str] = []

    def hold(s: str) -> str:
        held.append(s)
        return f"\x00{len(held) - 1}\x01"

    def link(m: re.Match) -> str:
        return ((m[2] if alt else "") if m[1] else m[2]) or ""

    text = CODE.sub(lambda m: hold(m[2][1:-1] if m[2].startswith(" ") and m[2].endswith(" ") and m[2].strip() else m[2]), text)
    text = ESCAPED.sub(lambda m: hold(m[1]), text)
    text = AUTOLINK.sub(lambda m: hold(m[1]), text)
    text = TAG.sub(lambda m: hold(m[0] if html_kept else ""), text)
    for _ in range(4):
        text, n = LINK.subn(link, text)
        if not n:
            break
    for pattern in EMPHASIS:
        for _ in range(4):
            text, n = pattern.subn(lambda m: next(g for g in m.groups() if g is not None), text)
            if not n:
                break
    text = re.sub(r"(?: {2,}|\\)?\n[ \t]*", lambda m: line_break, text)
    text = html.unescape(text)
    while "\x00" in text:
        text = re.sub("\x00(\\d+)\x01", lambda m: held[int(m[1])], text)
    return text


def heading_text(parts: list[str]) -> str:
    """Text of a heading: code and raw HTML stay, images and breaks don't."""
    return inline("\n".join(parts), True, False, "").strip()


def headings(body: str) -> list[dict]:
    """Top-level headings in order, with the end of their section, their parent, and whether direct content is empty."""
    lines = body.split("\n")
    found = [b for b in blocks(lines) if b.kind == "heading"]
    out: list[dict] = []
    stack: list[int] = []
    for i, b in enumerate(found):
        while stack and out[stack[-1]]["level"] >= b.level:
            out[stack.pop()]["end_line"] = b.start
        parent = stack[-1] if stack else None
        text = heading_text(b.text)
        after = found[i + 1].start if i + 1 < len(found) else len(lines)
        out.append({
            "idx": i + 1, "level": b.level, "text": text, "line": b.start + 1, "parent_idx": None if parent is None else parent + 1, "end_line": len(lines),
            "direct_empty": not "".join(lines[b.end : after]).strip(), "setext": b.end - b.start > 1, "path": ([] if parent is None else out[parent]["path"]) + [text],
        })
        stack.append(i)
    return out


@dataclass(frozen=True)
class PlainText:
    """How text is laid out (T1): newlines between blocks, indent of quotes and lists, code, images, soft breaks."""

    gap: int = 2
    indent: str = "  "
    code: bool = True
    alt: bool = True
    soft: str = "\n"


DEFAULT, COMPACT, SINGLE_LINE = PlainText(), PlainText(gap=1), PlainText(gap=0, indent="", soft=" ")


def plain_text(body: str, options: PlainText = DEFAULT) -> str:
    """Body without markup: rules, raw HTML and tables are dropped, quotes and lists indented."""
    single = options.gap == 0

    def lay(found: list[Block], depth: int) -> list[str]:
        out, pad = [], options.indent * depth
        for b in found:
            if b.kind in ("paragraph", "heading"):
                text = heading_text(b.text) if b.kind == "heading" else inline("\n".join(x.strip() for x in b.text), False, options.alt, options.soft)
                if text.strip():
                    out.append("\n".join(pad + x for x in text.split("\n")))
            elif b.kind == "code" and options.code:
                out.append("\n".join(pad + x for x in b.text))
            elif b.kind == "quote":
                out += lay(b.parts, depth + 1)
            elif b.kind == "list":
                texts = [x for item in b.parts for x in lay(item.parts, depth + 1)]
                if texts:
                    out.append((" " if single else "\n").join(texts))
        return out

    parts = lay(blocks(body.split("\n")), 0)
    text = (" " if single else "\n" * options.gap).join(parts)
    return " ".join(text.split()) if single else text


def _code_lines(body: str) -> set[int]:
    out: set[int] = set()

    def walk(found: list[Block]) -> None:
        for b in found:
            if b.kind in ("code", "html"):
                out.update(range(b.start, b.end))
            walk(b.parts)

    walk(blocks(body.split("\n")))
    return out


BULLET = re.compile(r"^((?:[ \t]*>)*[ \t]*(?:(?:[-+*]|\d{1,9}[.)])[ \t]+)*?)([-+*])(?=[ \t]|$)")


def bullets(body: str, mark: str = "-") -> str:
    """Unordered list markers made equal, nested and quoted ones too (T4)."""
    code = _code_lines(body)
    out = []
    for i, line in enumerate(body.split("\n")):
        if i not in code and not THEMATIC.match(re.sub(r"^(?:[ \t]*>)+ ?", "", line)):
            line = BULLET.sub(lambda m: m[1] + mark, line)
        out.append(line)
    return "\n".join(out)


ITALIC = re.compile(r"(?<![*\\\w])\*(?![\s*])([^*\n]+?)(?<![\s*\\])\*(?![*\w])|(?<![_\\\w])_(?![\s_])((?:[^_\n]|(?<=\w)_+(?=\w))+?)(?<![\s_\\])_(?![_\w])")


def italics(body: str, mark: str = "*") -> str:
    """Emphasis markers made equal, outside code; only the outermost emphasis changes (T5)."""
    code = _code_lines(body)
    out = []
    for i, line in enumerate(body.split("\n")):
        if i not in code:
            pieces, at = [], 0
            for m in CODE.finditer(line):
                pieces += [ITALIC.sub(lambda x: f"{mark}{x[1] or x[2]}{mark}", line[at : m.start()]), m[0]]
                at = m.end()
            line = "".join([*pieces, ITALIC.sub(lambda x: f"{mark}{x[1] or x[2]}{mark}", line[at:])])
        out.append(line)
    return "\n".join(out)


PIPE = re.compile(r"((?:[^|\\]|\\.)*)(\||$)", re.S)


def cells(line: str) -> list[str]:
    """Cells of a table line, split at pipes that no odd number of backslashes precedes."""
    parts = [m[1].strip() for m in PIPE.finditer(line.strip()) if m[0]]
    text = line.strip()
    if text.startswith("|"):
        parts = parts[1:]
    elif not text:
        return []
    # The last pipe ends a cell; text behind it is a cell of its own.
    return parts if parts else [""]


def align_tables(body: str, widest: int = 80) -> str:
    """Pads the cells of runs of lines with pipes whose second line is a separator; nothing is ever cut."""
    lines = body.split("\n")
    out: list[str] = []
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and "|" in lines[j]:
            j += 1
        if j == i:
            out.append(lines[i])
            i += 1
            continue
        rows = [cells(x) for x in lines[i:j]]
        rule = len(rows) > 1 and bool(rows[1]) and all(re.fullmatch(r":*-+:*", c) for c in rows[1])
        if not rule:
            out += lines[i:j]
        else:
            n = len(rows[0])
            rows = [r + [""] * (n - len(r)) for r in rows]
            count = max(map(len, rows))
            measured = lambda c: max(3, len(c)) if re.fullmatch(r":*-+:*", c) else len(c)
            width = [min(widest, max(measured(r[k]) for r in rows if k < len(r))) for k in range(count)]
            for k, r in enumerate(rows):
                if k == 1:
                    r = [(":" if c.startswith(":") else "") + "-" * max(1 if ":" in c else 3, w - c.startswith(":") - c.endswith(":")) + (":" if c.endswith(":") else "") for c, w in zip(r, width, strict=False)]
                out.append("| " + " | ".join(c.ljust(w) for c, w in zip(r, width, strict=False)) + " |")
        i = j
    return "\n".join(out)


def formatted(body: str, bullet: str | None = "-", italic: str | None = "*", tables: bool = True, widest: int = 80) -> str:
    """Bullets, then emphasis, then tables."""
    body = bullets(body, bullet) if bullet else body
    body = italics(body, italic) if italic else body
    return align_tables(body, widest) if tables else body


def tree(found: list[dict]) -> list[dict]:
    """Headings with children, from entries of level, text and slug; a parent is the last earlier lower level (S3)."""
    top: list[dict] = []
    stack: list[dict] = []
    for h in found:
        node = {"level": h["level"], "text": h["text"], "slug": h.get("slug"), "children": []}
        while stack and stack[-1]["level"] >= node["level"]:
            stack.pop()
        (stack[-1]["children"] if stack else top).append(node)
        stack.append(node)
    return top


def render_toc(found: list[dict], form: str) -> str:
    """A table of contents as md-bullet-links, md-only-headings, tree, json, json-pretty, plain or html."""
    import json

    top = tree(found)

    def flat(nodes: list[dict], depth: int = 0):
        for n in nodes:
            yield n, depth
            yield from flat(n["children"], depth + 1)

    if form == "md-bullet-links":
        return "\n".join("  " * d + (f"- [{n['text']}](#{n['slug']})" if n["slug"] is not None else f"- {n['text']}") for n, d in flat(top))
    if form == "md-only-headings":
        return "\n".join("#" * n["level"] + " " + n["text"] for n, _ in flat(top))
    if form == "plain":
        return "\n".join("  " * d + n["text"] for n, d in flat(top))
    if form == "tree":

        def drawn(nodes: list[dict], lead: str):
            for k, n in enumerate(nodes):
                last = k == len(nodes) - 1
                yield f"{lead}{'└── ' if last else '├── '}{n['text']}"
                yield from drawn(n["children"], lead + ("    " if last else "│   "))

        return "\n".join(drawn(top, ""))
    if form in ("json", "json-pretty"):
        clean = lambda n: {k: [clean(c) for c in v] if k == "children" else v for k, v in n.items() if v is not None}
        levels = [h["level"] for h in found] or [0]
        data = {"entries": [clean(n) for n in top], "minLevel": min(levels), "maxLevel": max(levels)}
        return json.dumps(data, ensure_ascii=False, **({"indent": 2, "sort_keys": True} if form == "json-pretty" else {"separators": (",", ":")}))
    if form == "html":

        joined = lambda nodes, depth: "".join(listed(nodes, depth))

        def listed(nodes: list[dict], depth: int):
            pad = "  " * (depth + 1)
            for n in nodes:
                text = html.escape(n["text"]).replace("&#x27;", "&#39;")
                body = f'<a href="#{n["slug"]}">{text}</a>' if n["slug"] is not None else text
                if n["children"]:
                    body += f"\n{pad}  <ul>\n{joined(n['children'], depth + 2)}{pad}  </ul>\n{pad}"
                yield f"{pad}<li>{body}</li>\n"

        return f"<ul>\n{joined(top, 0)}</ul>"
    raise ValueError(f"unknown format {form}")
