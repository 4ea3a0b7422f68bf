"""Operator 6, language ID: a bidirectional gated recurrent network over bytes.

Each direction is a GRU with a reset and an update gate. It is trained in numpy by backpropagation through time on
slices of bytes from a bounded sample of labelled documents, labels every byte position, and a document's
probabilities are the mean over its letter positions. Every byte of a text is read. A text is computed in windows side
by side; each direction comes to a window with the state that it has after the CONTEXT bytes before it, so a position
knows its neighbours across the seams.

Defined results: a null text or one without a letter is `und` with score 0, as is every text if nothing can be learned.
Documents with a null doc_id are predicted, not learned from, and not held out. Repeated rows are predicted one by
one. Rows with a null or unknown language are predicted like any other. An empty table gives no rows. `annotate` keeps
all columns, whatever their names, and names its own ones as it is told.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from marklake.llm.common import maybe_broadcast, sliced

#: Bytes of a window, bytes around it that only lead in, size of the state of a direction, windows that are computed together.
WINDOW, CONTEXT, HIDDEN, BLOCK = 192, 32, 8, 512
#: The sample to learn from: documents of a language at most and at least, of all languages (every language has its share), slices of a document, bytes of a slice.
LANG_DOCS, LEAST_DOCS, SAMPLE_DOCS, DOC_SLICES, SLICE = 192, 4, 12_288, 8, 64
EPOCHS, BATCH, RATE, SEED = 8, 128, 0.01, 7
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
#: Bytes that belong to letters: ASCII letters and all parts of longer characters.
LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def _forward(x: np.ndarray, u: np.ndarray, back: bool, keep: bool):
    """States at every step of sequences (steps, n); u: update, reset and candidate weights (3, H, H); x: their inputs by step (steps, n, 3H)."""
    steps, n, _ = x.shape
    hid = u.shape[1]
    u_gates, uc = np.concatenate([u[0].T, u[1].T], axis=1), np.ascontiguousarray(u[2].T)
    h, out = np.zeros((n, hid), np.float32), np.empty((steps, n, hid), np.float32)
    gates = np.empty((steps, n, 3 * hid), np.float32) if keep else None
    for t in range(steps - 1, -1, -1) if back else range(steps):
        g = 0.5 * np.tanh(0.5 * (h @ u_gates + x[t, :, : 2 * hid])) + 0.5
        z, r = g[:, :hid], g[:, hid:]
        c = np.tanh((r * h) @ uc + x[t, :, 2 * hid :])
        if keep:
            gates[t, :, : 2 * hid], gates[t, :, 2 * hid :] = g, c
        h = out[t] = h + z * (c - h)
    return out, gates


def _backward(out: np.ndarray, gates: np.ndarray, u: np.ndarray, d_out: np.ndarray, back: bool):
    """Gradients of the inputs by step and of u, given those of the states."""
    steps, n, hid = out.shape
    d_x, d_u, dh = np.empty((steps, n, 3 * hid), np.float32), np.zeros_like(u), np.zeros((n, hid), np.float32)
    order = list(range(steps - 1, -1, -1) if back else range(steps))
    zero = np.zeros((n, hid), np.float32)
    for k in range(steps - 1, -1, -1):
        t = order[k]
        h = out[order[k - 1]] if k else zero
        z, r, c = gates[t, :, :hid], gates[t, :, hid : 2 * hid], gates[t, :, 2 * hid :]
        dh = dh + d_out[t]
        d_c = dh * z * (1 - c * c)
        d_rh = d_c @ u[2]
        d_z = dh * (c - h) * z * (1 - z)
        d_r = d_rh * h * r * (1 - r)
        d_u[0] += d_z.T @ h
        d_u[1] += d_r.T @ h
        d_u[2] += d_c.T @ (r * h)
        d_x[t, :, :hid], d_x[t, :, hid : 2 * hid], d_x[t, :, 2 * hid :] = d_z, d_r, d_c
        dh = dh * (1 - z) + d_rh * r + d_z @ u[0] + d_r @ u[1]
    return d_x, d_u


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=-1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=-1, keepdims=True)
    return z


def _slices(raw: bytes) -> np.ndarray:
    """Bytes as rows to learn from, the last one filled with zeros."""
    n = -(-len(raw) // SLICE)
    return np.frombuffer(raw.ljust(n * SLICE, b"\0"), np.uint8).reshape(n, SLICE)


def _windows(raw: bytes) -> np.ndarray:
    """Bytes as rows of windows with CONTEXT bytes before and behind, filled with zeros around the text."""
    n = -(-len(raw) // WINDOW)
    all_ = np.frombuffer((b"\0" * CONTEXT + raw).ljust(n * WINDOW + 2 * CONTEXT, b"\0"), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(all_, WINDOW + 2 * CONTEXT)[::WINDOW]


def probabilities(model: dict, windows: np.ndarray, context: int = 0) -> np.ndarray:
    """Language probabilities of every position but the `context` ones at either end: (languages, steps, windows)."""
    by = np.ascontiguousarray(windows.T)
    steps, n = by.shape
    hid = model["u0"].shape[1]
    z = np.empty((len(model["b"]), steps - 2 * context, n), np.float32)
    z[:] = model["b"][:, None, None]
    g, x, rh, c = np.empty((n, 2 * hid), np.float32), np.empty((n, 3 * hid), np.float32), np.empty((n, hid), np.float32), np.empty((n, hid), np.float32)
    for d in (0, 1):
        # A gate is the logistic function, (1 + tanh(a / 2)) / 2; the halves go into the weights.
        xs = model[f"x{d}"].copy()
        xs[:, : 2 * hid] /= 2
        u = model[f"u{d}"]
        u_gates, uc = np.concatenate([u[0].T, u[1].T], axis=1) / 2, np.ascontiguousarray(u[2].T)
        w, h = np.ascontiguousarray(model["w"][d * hid : (d + 1) * hid].T), np.zeros((n, hid), np.float32)
        # A direction needs no step after its last position that counts.
        for t in range(steps - 1, context - 1, -1) if d else range(steps - context):
            np.take(xs, by[t], axis=0, out=x, mode="clip")
            np.matmul(h, u_gates, out=g)
            g += x[:, : 2 * hid]
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            np.multiply(g[:, hid:], h, out=rh)
            np.matmul(rh, uc, out=c)
            c += x[:, 2 * hid :]
            np.tanh(c, out=c)
            c -= h
            c *= g[:, :hid]
            h += c
            if context <= t < steps - context:
                z[:, t - context] += w @ h.T
    np.exp(np.clip(z, -60, 60, out=z), out=z)
    z /= z.sum(axis=0)
    return z


def train(samples: list[tuple[bytes, str]], epochs: int = EPOCHS, seed: int = SEED) -> dict | None:
    """A model from (bytes, language) pairs; None without any."""
    langs = sorted({lang for raw, lang in samples if raw})
    if not langs:
        return None
    data = [(w, langs.index(lang)) for raw, lang in samples if raw for w in _slices(raw)]
    x, y = np.stack([w for w, _ in data]), np.array([k for _, k in data])
    rng = np.random.default_rng(seed)
    n_lang = len(langs)
    model = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in (("x0", (256, 3 * HIDDEN)), ("x1", (256, 3 * HIDDEN)), ("u0", (3, HIDDEN, HIDDEN)), ("u1", (3, HIDDEN, HIDDEN)), ("w", (2 * HIDDEN, n_lang)))} | {"b": np.zeros(n_lang, np.float32)}
    m, v, step = {k: np.zeros_like(p) for k, p in model.items()}, {k: np.zeros_like(p) for k, p in model.items()}, 0
    weight = (len(y) / (n_lang * np.maximum(1, np.bincount(y, minlength=n_lang)))).astype(np.float32)
    total = epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            pick = order[i : i + BATCH]
            by, want = np.ascontiguousarray(x[pick].T), y[pick]
            ins = [model[k].take(by, axis=0) for k in ("x0", "x1")]
            (a, ga), (b, gb) = _forward(ins[0], model["u0"], False, True), _forward(ins[1], model["u1"], True, True)
            h = np.concatenate([a, b], axis=2)
            d_z = _softmax(h @ model["w"] + model["b"])
            d_z[:, np.arange(len(want)), want] -= 1
            mask = LETTER[by] * weight[want]
            d_z *= (mask / max(1, mask.sum()))[:, :, None]
            d_h = d_z @ model["w"].T
            grad = {"w": np.tensordot(h, d_z, ((0, 1), (0, 1))), "b": d_z.sum((0, 1))}
            for d, out, gates, part in ((0, a, ga, d_h[:, :, :HIDDEN]), (1, b, gb, d_h[:, :, HIDDEN:])):
                d_x, grad[f"u{d}"] = _backward(out, gates, model[f"u{d}"], part, bool(d))
                grad[f"x{d}"] = np.zeros_like(model[f"x{d}"])
                np.add.at(grad[f"x{d}"], by.ravel(), d_x.reshape(-1, 3 * HIDDEN))
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for k, p in model.items():
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
                p -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model | {"langs": langs}


def predict(model: dict | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of every text."""
    raw = [t.encode("utf-8", "replace") if model and t and any(map(str.isalpha, t)) else b"" for t in texts]
    sizes = np.array([-(-len(r) // WINDOW) for r in raw])
    if not sizes.sum():
        return [("und", 0.0)] * len(texts)
    sums, doc_of, fill, at = np.zeros((len(raw), len(model["langs"]))), np.repeat(np.arange(len(raw)), sizes), [], 0
    counts = np.zeros(len(raw))
    pending: list[np.ndarray] = []

    def flush() -> None:
        nonlocal at
        block = np.concatenate(pending)
        for i in range(0, len(block), BLOCK):
            part = block[i : i + BLOCK]
            mask = LETTER[part[:, CONTEXT : CONTEXT + WINDOW]].T
            docs = doc_of[at : at + len(part)]
            p = probabilities(model, part, CONTEXT)
            p *= mask
            np.add.at(sums, docs, p.sum(axis=1).T)
            np.add.at(counts, docs, mask.sum(axis=0))
            at += len(part)
        pending.clear()

    held = 0
    for r in raw:
        if r:
            pending.append(_windows(r))
            held += len(pending[-1])
            if held >= 4 * BLOCK:
                flush()
                held = 0
    if pending:
        flush()
    out = []
    for s, n, r in zip(sums, counts, raw, strict=True):
        k = int(s.argmax())
        out.append((model["langs"][k], min(1.0, float(s[k] / max(1, n)))) if r else ("und", 0.0))
    return out


def sample(docs: DataFrame) -> list[tuple[bytes, str]]:
    """Slices of documents of every language, those of lowest hash in as many buckets as the language has documents in the sample."""
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)).withColumn("h", F.xxhash64("doc_id"))
    n_langs = known.agg(F.count_distinct("lang")).first()[0]
    share = max(LEAST_DOCS, min(LANG_DOCS, SAMPLE_DOCS // max(1, n_langs)))
    chosen = known.groupBy("lang", F.pmod("h", F.lit(share)).alias("bucket")).agg(F.min("h").alias("h")).select("lang", "h")
    slices = F.transform(F.sequence(F.lit(0), F.lit(DOC_SLICES - 1)), lambda i: F.substring(F.col("text"), F.floor(i * F.length("text") / DOC_SLICES).cast("int") + 1, F.lit(SLICE)))
    rows = known.join(maybe_broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "h", slices.alias("s")).collect()
    return [(part, r.lang) for r in sorted(rows, key=lambda r: (r.lang, r.h)) for part in dict.fromkeys(x.encode("utf-8", "replace")[:SLICE] for x in r.s) if part]


def _predictor(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = predict(model, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; the model is trained on the driver from a bounded sample."""
    model = train(sample(docs if learn_from is None else learn_from))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("bigint").cast("string")) % 4 == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("bigint"), held.alias("held_out"), F.col("text").cast("string")).mapInArrow(_predictor(model), SCHEMA)


def _annotator(model: dict | None, text: int, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = predict(model, b.column(text).to_pylist())
            columns = [*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, *names])

    return run


def annotate(docs: DataFrame, learn_from: DataFrame | None = None, names: tuple[str, str] = ("_lang_pred", "_score")) -> DataFrame:
    """All columns of the documents, with the language and its score under these names."""
    model = train(sample(docs if learn_from is None else learn_from))
    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return docs.mapInArrow(_annotator(model, docs.columns.index("text"), names), schema)
