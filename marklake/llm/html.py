"""Operator 9, HTML extraction: a bidirectional LSTM labels the leaf blocks of a page.

A page is cut into blocks at block-level tags. Every block has a vector: its tag path and the words of its ancestors'
class, id and role attributes (hashed), its own words (hashed), and counts. The network reads all blocks of a page in
both directions, so each label uses the whole page. It is trained in numpy on a bounded sample of pages whose own
markup tells the main text (an article or main element) and on pages composed here in other layouts.

Defined results: null or empty html gives an empty text. Scripts, styles, comments, the head, form controls and hidden
parts never become blocks; math is read as text of its block, without its annotations. Repeated rows and null ids are kept, an empty table gives no rows, other columns are not
looked at, and blocks are never dropped for their number or length.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.llm.common import sliced

#: Sizes of the hashed parts of a block's vector, and of the state of a direction.
PATH, TEXT, COUNTS, HIDDEN = 192, 32, 6, 16
#: The sample to learn from: at most so many pages of the table, as many composed ones; epochs, pages of a batch, learning rate, seed.
SAMPLE_PAGES, COMPOSED_PAGES, EPOCHS, BATCH, RATE, SEED = 192, 900, 6, 24, 0.01, 11
SCHEMA = "page_id bigint, url string, text string, n_chars bigint"

# Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math semantics maction menclose merror mfenced mfrac mi mlabeledtr mmultiscripts mn mo mover mpadded mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none".split()
)
SILENT = frozenset("head title button select option datalist svg iframe object canvas audio video map noframes".split())
RAW = "script|style|noscript|template|textarea|xmp|annotation-xml|annotation"
#: Elements whose start or end closes an open p.
NOT_IN_P = frozenset("address article aside blockquote body details dialog div dl dd dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())

MARKUP = re.compile(
    rf"<!--(?:.*?)(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([A-Za-z][^\s/>]*)((?:=\s*"[^"<]*"|=\s*'[^'<]*'|[^>"'])*+|[^>]*)(?:>|\Z)""",
    re.S | re.I,
)
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
MAY_HIDE = re.compile(r"hidden|none", re.I)
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
PART = re.compile(r"[A-Za-z]+")


@lru_cache(maxsize=50_000)
def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


def hides(attributes: str) -> bool:
    """Whether the attributes of a tag hide its element: hidden by its name, style and aria-hidden by their values."""
    if not MAY_HIDE.search(attributes):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "style" and NOT_SHOWN.search(value)) or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True
    return False


class Node:
    """An open element: its tag, the words of its names (None if it is hidden), its parent, and the spots of its ancestors and itself in a vector."""

    __slots__ = ("base", "leaf", "names", "parent", "tag")

    def __init__(self, tag: str, names: tuple | None, parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.base = (parent.base if parent else frozenset()) | {_bucket(f"t:{tag}", PATH), *(_bucket(f"n:{n}", PATH) for n in names or ())}
        self.leaf: list[int] | None = None

    def spots(self) -> list[int]:
        if self.leaf is None:
            pair = f"{self.parent.tag}/{self.tag}" if self.parent else self.tag
            self.leaf = sorted(self.base | {_bucket(f"leaf:{self.tag}", PATH), _bucket(f"pair:{pair}", PATH)})
        return self.leaf


TOP = sorted({_bucket("leaf:", PATH), _bucket("pair:", PATH)})


class Block:
    """Text of a leaf, the element it stands in and the characters that are inside links."""

    __slots__ = ("links", "node", "text")

    def __init__(self, text: str, node: Node | None, links: int):
        self.text, self.node, self.links = text, node, links


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; unclosed and stray tags are tolerated."""
    out: list[Block] = []
    stack: list[Node] = []
    opened: Counter = Counter()
    buffer: list[str] = []
    linked: list[int] = [0]
    quiet = link = 0

    def flush() -> None:
        if buffer:
            text = " ".join(references.unescape("".join(buffer)).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, linked[0]))
            buffer.clear()
        linked[0] = 0

    def leave(k: int) -> None:
        nonlocal quiet
        for x in stack[k:]:
            quiet -= x.names is None or x.tag in SILENT
            opened[x.tag] -= 1
        del stack[k:]

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at and not quiet:
            piece = page[at : m.start()]
            buffer.append(piece)
            if link:
                linked[0] += len(piece.strip())
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag, closing = tag.lower(), m[2] == "/"
        if tag in INLINE:
            if tag == "br":
                buffer.append(" ")
            elif tag == "a":
                link = 0 if closing else 1
            continue
        flush()
        link = 0
        if closing:
            if opened[tag]:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            continue
        if tag in NOT_IN_P and stack and stack[-1].tag == "p":
            leave(len(stack) - 1)
        if tag == "li" and stack and stack[-1].tag == "li":
            leave(len(stack) - 1)
        if tag == "body" and opened["head"]:
            leave(next(k for k, x in enumerate(stack) if x.tag == "head"))
        if tag in VOID:
            continue
        attributes = m[4] or ""
        names = None if attributes and hides(attributes) else tuple(w.lower() for n in NAMED.findall(attributes) for w in PART.findall("".join(n))) if attributes else ()
        stack.append(Node(tag, names, stack[-1] if stack else None))
        opened[tag] += 1
        quiet += names is None or tag in SILENT
    if at < len(page) and not quiet:
        buffer.append(page[at:])
    flush()
    return out


def vectors(found: list[Block]) -> np.ndarray:
    """Vectors of a page's blocks."""
    out = np.zeros((len(found), PATH + TEXT + COUNTS), np.float32)
    for row, b in zip(out, found, strict=True):
        row[b.node.spots() if b.node else TOP] = 1
        n, n_words = len(b.text), b.text.count(" ") + 1
        own = b.text.lower().split()
        for w in own:
            row[PATH + _bucket(w, TEXT)] += 1 / sqrt(len(own))
        row[PATH + TEXT :] = log1p(n) / 6, log1p(n_words) / 4, min(1.0, b.links / n), b.text[-1] in ".!?\"”»", sum(map(b.text.count, ".,;:!?")) / (n_words + 1), b.text[0].isupper()
    return out


def _lstm(x: np.ndarray, p: dict, d: int, keep: bool = False):
    """States over steps of x (steps, n, size); padding must stand after the blocks of the page, also for direction 1."""
    steps, n, _ = x.shape
    hid = p[f"u{d}"].shape[0]
    pre = x @ p[f"x{d}"] + p[f"b{d}"]
    h, c = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
    out, kept = np.empty((steps, n, hid), np.float32), []
    for t in range(steps):
        z = pre[t] + h @ p[f"u{d}"]
        g = 0.5 * np.tanh(0.5 * z[:, : 3 * hid]) + 0.5
        cand = np.tanh(z[:, 3 * hid :])
        before = c
        c = g[:, :hid] * cand + g[:, hid : 2 * hid] * c
        tc = np.tanh(c)
        if keep:
            kept.append((g, cand, before, tc, h))
        h = out[t] = g[:, 2 * hid :] * tc
    return out, kept


def _lstm_back(x, p, d, kept, d_out):
    steps, n, _ = x.shape
    hid = p[f"u{d}"].shape[0]
    d_z = np.empty((steps, n, 4 * hid), np.float32)
    d_u, dh, dc = np.zeros_like(p[f"u{d}"]), np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
    for t in range(steps - 1, -1, -1):
        g, cand, before, tc, h = kept[t]
        i, f, o = g[:, :hid], g[:, hid : 2 * hid], g[:, 2 * hid :]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        z = d_z[t]
        z[:, :hid], z[:, hid : 2 * hid], z[:, 2 * hid : 3 * hid], z[:, 3 * hid :] = dc * cand * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - cand * cand)
        d_u += h.T @ z
        dh, dc = z @ p[f"u{d}"].T, dc * f
    return {f"x{d}": np.tensordot(x, d_z, ((0, 1), (0, 1))), f"u{d}": d_u, f"b{d}": d_z.sum((0, 1))}


def _batch(pages: list[np.ndarray]):
    """Padded inputs by step, also with every page reversed, and each page's index for that."""
    steps = max(map(len, pages))
    x, y = (np.zeros((steps, len(pages), PATH + TEXT + COUNTS), np.float32) for _ in range(2))
    for k, v in enumerate(pages):
        x[: len(v), k], y[: len(v), k] = v, v[::-1]
    return x, y


def _states(model: dict, pages: list[np.ndarray], keep: bool = False):
    x, y = _batch(pages)
    (a, ka), (r, kr) = _lstm(x, model, 0, keep), _lstm(y, model, 1, keep)
    b = np.zeros_like(r)
    for k, v in enumerate(pages):
        b[: len(v), k] = r[: len(v), k][::-1]
    return x, y, a, b, ka, kr


def scores(model: dict, pages: list[np.ndarray]) -> list[np.ndarray]:
    """Logits of every block of every page; pages are taken together by similar length, in bounded batches."""
    out: list = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    while order:
        n = 1
        while n < len(order) and n < 256 and (n + 1) * len(pages[order[n]]) <= 16_384:
            n += 1
        pick, order = order[:n], order[n:]
        _, _, a, b, _, _ = _states(model, [pages[k] for k in pick])
        z = np.concatenate([a, b], axis=2) @ model["w"] + model["b"]
        for j, k in enumerate(pick):
            out[k] = z[: len(pages[k]), j]
    return out


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """A model from (vectors, labels 0 or 1) of pages."""
    rng = np.random.default_rng(seed)
    size = PATH + TEXT + COUNTS
    p = {"w": rng.normal(0, 0.2, 2 * HIDDEN), "b": np.zeros(1)}
    for d in (0, 1):
        p |= {f"x{d}": rng.normal(0, 0.2, (size, 4 * HIDDEN)), f"u{d}": rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"b{d}": np.zeros(4 * HIDDEN)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    pages = [x for x in pages if len(x[0])]
    for _ in range(epochs if pages else 0):
        order = rng.permutation(len(pages))
        for i in range(0, len(order), BATCH):
            pick = [pages[k] for k in order[i : i + BATCH]]
            xs = []
            for x, _ in pick:  # without some of the words and paths, so that no single one decides
                x = x.copy()
                x[:, : PATH + TEXT] *= rng.random((len(x), PATH + TEXT)) > 0.1
                xs.append(x)
            x, y, a, b, ka, kr = _states(p, xs, True)
            z = np.concatenate([a, b], axis=2) @ p["w"] + p["b"]
            d_z = np.zeros_like(z)
            for k, (_, want) in enumerate(pick):
                d_z[: len(want), k] = (1 / (1 + np.exp(-np.clip(z[: len(want), k], -30, 30))) - want) / len(want)
            d_z /= len(pick)
            da, db = d_z[:, :, None] * p["w"][:HIDDEN], d_z[:, :, None] * p["w"][HIDDEN:]
            dr = np.zeros_like(db)
            for k, (_, want) in enumerate(pick):
                dr[: len(want), k] = db[: len(want), k][::-1]
            grad = {"w": np.concatenate([np.einsum("tnh,tn->h", a, d_z), np.einsum("tnh,tn->h", b, d_z)]), "b": d_z.sum(keepdims=True).reshape(1)}
            grad |= _lstm_back(x, p, 0, ka, da) | _lstm_back(y, p, 1, kr, dr)
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
                p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


#: Stands in front of labelled texts of composed pages; a private-use character.
MARK = "\ue000"
#: Names of parts that are not main text, and elements they stand in; for composed pages.
BOILER = {
    "nav": ("nav", "ul", "div", "header"), "menu": ("ul", "div", "nav"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "aside"),
    "cookie": ("div", "section", "dialog"), "ad": ("div", "aside", "ins"), "promo": ("div", "section"), "sponsored": ("div", "aside"), "newsletter": ("form", "div"), "subscribe": ("form", "div"), "share": ("div", "ul"),
    "related": ("div", "section", "aside"), "comments": ("div", "section", "ol"), "comment": ("div", "article", "li"), "breadcrumb": ("nav", "ol", "div"), "login": ("form",), "banner": ("div", "header"), "copyright": ("div", "p", "small"), "search": ("form", "div"), "tags": ("ul", "div"),
}
FRAMES = (("article", ""), ("main", ""), ("div", "content"), ("div", "article-body"), ("section", "post"), ("div", "entry-content"), ("div", "story"), ("div", "main"))


def compose(rng: np.random.Generator, words: list[str]) -> tuple[list[Block], np.ndarray]:
    """A page in one of many layouts, with labels: the same words stand in its main text and around it."""

    def prose(lo: int, hi: int) -> str:
        n = int(rng.integers(lo, hi))
        out = " ".join(words[k] for k in rng.integers(0, len(words), n))
        return (out[:1].upper() + out[1:]).rstrip(".,") + ("." if rng.random() < 0.8 else "")

    def boiler(kind: str) -> list[tuple[str, int]]:
        tag = BOILER[kind][int(rng.integers(len(BOILER[kind])))]
        names = f' class="{kind}{["", "-box", " widget", "-list"][int(rng.integers(4))]}"' if tag == "div" or rng.random() < 0.6 else f' id="{kind}"' if rng.random() < 0.5 else ""
        if not names and tag in ("p", "small", "section", "ol", "ul", "li", "article"):
            names = f' class="{kind}"'
        linked = kind in ("nav", "menu", "breadcrumb", "related", "tags", "share", "footer", "header")
        parts = [(f"<{tag}{names}>", -1)]
        for _ in range(int(rng.integers(1, 7 if linked else 5))):
            text = prose(1, 6) if linked else prose(2, 45 if "comment" in kind else 22)
            inner = f'<a href="/x">{text}</a>' if linked and rng.random() < 0.85 else text
            box = ("li", "li", "span")[int(rng.integers(3))] if linked else ("p", "p", "div", "label")[int(rng.integers(4))]
            if tag in ("p", "small"):
                box = "span"
            parts.append((f"<{box}>{inner}</{box}>", 0))
        return [*parts, (f"</{tag}>", -1)]

    kinds = list(BOILER)
    some = lambda n: [x for _ in range(int(rng.integers(0, n + 1))) for x in boiler(kinds[int(rng.integers(len(kinds)))])]
    tag, name = FRAMES[int(rng.integers(len(FRAMES)))]
    title = prose(3, 12)
    main: list[tuple[str, int]] = [(f"<h1>{title}</h1>", 1)]
    for _ in range(int(rng.integers(1, 16))):
        kind = rng.random()
        text = prose(1, 90) if rng.random() < 0.9 else prose(1, 4)
        if kind < 0.7:
            main.append((f"<p>{'<b>' if rng.random() < 0.2 else ''}{text}{'<br>' if rng.random() < 0.2 else ''}" + ("</p>" if rng.random() < 0.8 else ""), 1))
        elif kind < 0.78:
            main.append((f"<h2>{prose(1, 8)}</h2>", 1))
        elif kind < 0.86:
            main += [("<ul>", -1), *((f"<li>{prose(2, 20)}</li>", 1) for _ in range(int(rng.integers(1, 5)))), ("</ul>", -1)]
        elif kind < 0.9:
            main.append((f"<blockquote>{text}</blockquote>", 1))
        elif kind < 0.93:
            main.append((f"<table><tr><td>{prose(1, 6)}</td></tr></table>", 1))
        else:
            main += boiler(("ad", "notice", "share", "newsletter", "related", "promo")[int(rng.integers(6))])
    inside = boiler("comments") if rng.random() < 0.25 else []
    frame = f"<{tag}{f' {('class', 'id')[int(rng.integers(2))]}={name}' if name else ''}>"
    parts = [("<body>", -1), *some(3), (frame, -1), *main, *inside, (f"</{tag}>", -1), *some(4), ("</body>", -1)]
    # Labels go through the same cutter: a mark that no word contains stands in front of each labelled text.
    found = blocks("".join(re.sub(r">(?=[^<>])", ">" + MARK, p, count=1) if k == 1 else p for p, k in parts))
    label = np.array([MARK in b.text for b in found], np.float32)
    for b in found:
        b.text = b.text.replace(MARK, "").strip() or "."
    return found, label


def in_main(node: Node | None) -> bool:
    """Whether an element is main text by the page's own markup.

    It stands in an article or main element, and nothing between says that it is something else there: no other
    element than those of text, and no name of a part that is not main text (comments, adverts, shares ...).
    """
    while node:
        if node.tag in ("article", "main"):
            return not BOILER.keys() & set(node.names or ())
        if node.tag in ("nav", "aside", "footer", "form", "dialog", "ins") or BOILER.keys() & set(node.names or ()):
            return False
        node = node.parent
    return False


def learn(pages: list[str]) -> dict:
    """A model from pages of the table with an article or main element, and composed pages."""
    rng, data, words = np.random.default_rng(SEED), [], []
    for page in pages:
        found = blocks(page)
        label = np.array([in_main(b.node) for b in found], np.float32)
        words += [w for b in found for w in b.text.split()[:60]][:400]
        if label.any():
            data.append((vectors(found), label))
    words = words or [f"word{k}" for k in range(50)]
    for _ in range(COMPOSED_PAGES):
        found, label = compose(rng, words)
        data.append((vectors(found), label))
    return train(data)


def extract_page(page: str | None, model: dict) -> str:
    found = blocks(page or "")
    (z,) = scores(model, [vectors(found)])
    return "\n".join(b.text for b, s in zip(found, z, strict=True) if s > 0)


def _extractor(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            pages = [blocks(x or "") for x in batch.column(2).to_pylist()]
            found = scores(model, [vectors(p) for p in pages])
            texts = ["\n".join(b.text for b, s in zip(p, z, strict=True) if s > 0) for p, z in zip(pages, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def sample(pages: DataFrame) -> list[str]:
    """At most SAMPLE_PAGES pages, those of lowest hash in as many buckets."""
    hashed = pages.filter(F.col("html").isNotNull()).select(F.col("html").cast("string").alias("html"), F.xxhash64(F.col("page_id").cast("bigint")).alias("h"))
    chosen = hashed.groupBy(F.pmod("h", F.lit(SAMPLE_PAGES)).alias("bucket")).agg(F.min("h").alias("h")).select("h")
    rows = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("html").alias("html")).collect()
    return [r.html for r in sorted(rows, key=lambda r: r.h)]


def extract(pages: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """page_id, url, main text and its length of every page."""
    model = learn(sample(pages if learn_from is None else learn_from))
    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extractor(model), SCHEMA)
