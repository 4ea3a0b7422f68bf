"""Operator 5, packing: concatenate all token streams and cut them into fixed windows.

Pass one encodes each document once and writes its ids with the document's place inside its partition. The
partitions' token totals (one number each) are then summed up to global offsets, and pass two cuts every stream at
the multiples of the window. Only the last window is ever shorter than the others.

Defined results: a null or empty text is one end-of-document id. Repeated rows and doc_ids (null too) are packed as
often as they occur. An empty table gives no pieces. Texts of any length are cut as often as needed. Other columns
of the input are not looked at.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.llm.common import materialize, sliced

#: Distinct chunks whose ids a task keeps.
CACHE_CHUNKS = 400_000
ENCODED = "doc_id bigint, part int, start bigint, n bigint, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Encoder:
    """Byte-level BPE with a bounded cache of chunks.

    A lone space or newline between two visible characters always begins a pre-token, so texts with only such white
    space are looked up chunk by chunk. Any other text is encoded whole. Ids are those of the vocabulary file either way.
    """

    #: White space next to a space or newline, white space of other kinds, or the mark that is used for splitting.
    ODD = re.compile(r"[\x20\n]\s|\s[\x20\n]|[^\S\x20\n]|[\x00\x1c-\x1f\x85]|\A\s|\s\Z")

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= CACHE_CHUNKS:
                    self.clear()
                self[chunk] = ids = np.array(encode(chunk), np.uint16).tobytes()
                return ids

        self.chunks = Chunks()

    def __call__(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 16-bit numbers."""
        if self.ODD.search(text):
            return np.array(self.encode(text), np.uint16).tobytes()
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0"))) if text else b""


def _encoder(ranks_path: str, pattern: str, eos: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, encode, end = TaskContext.get().partitionId(), 0, Encoder(ranks_path, pattern), np.array([eos], np.uint16).tobytes()
        for b in sliced(batches):
            ids = [encode(t or "") + end for t in b.column(1).to_pylist()]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "part", "start", "n", "ids"])

    return run


def _cutter(base: dict[int, int], size: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out: list[list] = [[] for _ in names]
            for doc, part, start, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = base[part] + start
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                lo = 0
                while lo < n:
                    seq, off = divmod(at + lo, size)
                    hi = min(n, lo + size - off)
                    row = (doc, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), n, seq, off) + ((ids[lo:hi],) if with_ids else ())
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                    lo = hi
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    return run


def pack(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, size: int = 2048, eos: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents in windows of `size` ids; with_ids adds each piece's ids as an array.

    The driver holds one total per partition of the encoded table, and nothing per document.
    """
    if ranks_path is None:
        import public_tokenizers

        ranks_path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = materialize(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_encoder(ranks_path, pattern, eos), ENCODED), "packing-ids")
    base, at = {}, 0
    for part, n in sorted(encoded.groupBy("part").agg(F.sum("n")).collect()):
        base[part] = at
        at += n
    return encoded.mapInArrow(_cutter(base, size, with_ids), PIECES + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """Training rows from pieces with ids: sequence_id, ids, and the documents' boundaries inside the sequence.

    Groups are at most one window large.
    """
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return (
        pieces.groupBy("sequence_id").agg(rows.alias("p"))
        .select("sequence_id", F.flatten(F.transform("p", lambda x: x.ids)).alias("ids"), F.transform("p", lambda x: F.struct(x.offset.alias("offset"), x.doc_id.alias("doc_id"), x.start.alias("start"), x.length.alias("length"))).alias("bounds"))
    )
