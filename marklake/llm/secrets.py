"""Operator 1, secret scans: fixed patterns, and a token-efficiency test that exposes random strings.

A random string takes many tokens under a vocabulary that was learned from prose. Runs of key characters whose
characters per token fall below a bound are reported, and so are the parts of a run between separators, after known
digests and identifiers of fixed form are excluded.

Defined results: a null or empty text has no spans, and its digest is that of the empty string. Repeated rows are
scanned one by one, a null doc_id is kept, an empty table gives no rows, and other columns are not looked at. Spans
count code points. Texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.llm.common import sliced

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Runs that may be keys.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_RUN = 20
#: What separates the parts of a run.
PARTS = re.compile(r"[+/=_-]+")
#: What is known by its form not to be a secret: UUIDs, digests of the usual lengths, and numbers.
KNOWN = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
    r"|(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})"
    r"|[0-9+/_=-]+"
)
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns, by start and kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, taken: list[tuple[int, int, int]], n_tokens, most_chars_per_token: float) -> list[tuple[int, int]]:
    """Runs that take more tokens than prose would, or else their parts that do, where no fixed pattern has reported."""
    out = []
    starts = [a for a, _, _ in taken]
    reach = list(accumulate((b for _, _, b in taken), max))  # how far the spans up to each reach
    random = lambda s, e: e - s < most_chars_per_token * n_tokens(text[s:e])
    for m in RUN.finditer(text):
        s, e = m.span()
        before = bisect_left(starts, e)
        if (before and reach[before - 1] > s) or KNOWN.fullmatch(m[0]):
            continue
        if random(s, e):
            out.append((s, e))
            continue
        start = s
        for x in [*(x.span() for x in PARTS.finditer(text, s, e)), (e, e)]:
            if (start, x[0]) != (s, e) and x[0] - start >= LEAST_RUN and not KNOWN.fullmatch(text, start, x[0]) and random(start, x[0]):
                out.append((start, x[0]))
            start = x[1]
    return out


def _scanner(ranks_path: str, pattern: str, most_chars_per_token: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in sliced(batches):
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                more = random_spans(text or "", base, lambda s: len(encode(s)), most_chars_per_token)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                counts[3].append(len(more))
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                spans.append(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted([(s, k, KINDS[k], e) for s, k, e in base] + [(s, 3, "random", e) for s, e in more])))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in counts[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return run


def scan_secrets(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, most_chars_per_token: float = 1.9) -> DataFrame:
    """One row per document: counts of the fixed kinds, their digest, and all spans as kind:start:end."""
    if ranks_path is None:
        import public_tokenizers

        ranks_path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_scanner(ranks_path, pattern, most_chars_per_token), SCHEMA)


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """Documents with their spans replaced; needs doc_id to be a key."""
    found = scan_secrets(docs, **options).select("doc_id", "spans")
    ends = F.sort_array(F.transform(F.filter(F.split("spans", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("s"), F.split(x, ":")[2].cast("int").alias("e"))))
    init = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    fold = F.aggregate(ends, init, lambda a, x: F.struct(F.when(x.s < a.at, a.out).otherwise(F.concat(a.out, F.substring(F.col("text"), a.at + 1, x.s - a.at), F.lit(mark))).alias("out"), F.greatest(a.at, x.e).alias("at")))
    return docs.join(found, "doc_id").withColumn("_f", fold).withColumn("text", F.concat(F.col("_f.out"), F.expr("substring(text, _f.at + 1)"))).drop("_f", "spans")
