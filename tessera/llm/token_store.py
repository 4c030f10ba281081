"""Token ids as directly addressable codes in files.

An id is cut into chunks of eight bits, lowest first. Level k holds the k-th chunk of every id that has
one, a bitmap that says which of these ids go on, and a rank directory (set bits before each block of 512)
that turns an index of level k into one of level k + 1. Any token is found with one lookup a level; no
block is decoded.

A file is a Parquet table of segments without compression; a row's `blob` is one segment of whole
documents: magic, counts, document ids and starts, then the levels. Parquet only carries the blobs: it
commits files of finished tasks alone, so a lost executor leaves nothing half written, and its row
statistics lead to the segment of a document or position.

Null texts are empty and still get the end id; null document ids come first; rows with equal ids stand in
the order of their texts. An empty table gives no segment.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import codec
from .runtime import staged

MAGIC = b"TDAC\x01\x00"
RANK_BITS = 512
#: Tokens after which a segment ends with its document.
SEGMENT_TOKENS = 1 << 18
_HEAD = struct.Struct("<6sHQQ")
_NO_ID = -(1 << 63)


class Dac:
    """A sequence of unsigned 32-bit integers; get(i) is random access."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int):
        self.levels, self.n = levels, n

    @classmethod
    def encode(cls, ids: np.ndarray) -> Dac:
        rest, levels = np.asarray(ids, np.uint32), []
        while len(rest):
            more = rest > 255
            bitmap = np.packbits(more, bitorder="little")
            padded = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, bool)
            padded[: len(more)] = more
            rank = np.concatenate([[0], np.cumsum(padded.reshape(-1, RANK_BITS).sum(1))]).astype("<u4")
            levels.append((rest.astype(np.uint8), bitmap, rank))
            rest = rest[more] >> np.uint32(8)
        return cls(levels, len(ids))

    def get(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, rank) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            inside = np.unpackbits(bitmap[block * (RANK_BITS // 8) : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i = int(rank[block]) + int(inside.sum())
        return value

    def all(self) -> np.ndarray:
        out, at = np.zeros(self.n, np.uint32), np.arange(self.n)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            at = at[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return out

    def to_bytes(self) -> bytes:
        return b"".join([struct.pack("<QH", self.n, len(self.levels))] + [struct.pack("<Q", len(c)) + c.tobytes() + m.tobytes() + r.tobytes() for c, m, r in self.levels])

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> Dac:
        n, count = struct.unpack_from("<QH", data, at)
        at, levels = at + 10, []
        for _ in range(count):
            (size,) = struct.unpack_from("<Q", data, at)
            at += 8
            parts = []
            for kind, m in (("u1", size), ("u1", -(-size // 8)), ("<u4", -(-size // RANK_BITS) + 1)):
                parts.append(np.frombuffer(data, kind, m, at))
                at += parts[-1].nbytes
            levels.append(tuple(parts))
        return cls(levels, n)


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    own = np.array([_NO_ID if d is None else d for d in doc_ids], "<i8")
    return _HEAD.pack(MAGIC, 8, len(doc_ids), len(ids)) + own.tobytes() + starts.tobytes() + Dac.encode(ids).to_bytes()


class Segment:
    """One segment of a file."""

    def __init__(self, blob: bytes):
        magic, _, n_docs, self.n_tokens = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.doc_ids = np.frombuffer(blob, "<i8", n_docs, _HEAD.size)
        self.starts = np.frombuffer(blob, "<u8", n_docs + 1, _HEAD.size + 8 * n_docs)
        self.dac = Dac.from_bytes(blob, _HEAD.size + 8 * n_docs + 8 * (n_docs + 1))

    def token(self, i: int) -> int:
        return self.dac.get(i)


SEGMENTS = "part int, seg int, first_doc long, last_doc long, n_docs long, n_tokens long, part_start long, blob binary"


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Segments of all documents in ascending order of doc_id, from files in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, part, end = codec(path), TaskContext.get().partitionId(), np.uint32(end_id).tobytes()
        docs_, lengths, packed, held, seg, before = [], [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(packed), "<u4")
            row = [part, seg, docs_[0], docs_[-1], len(docs_), len(ids), before, pack_segment(docs_, lengths, ids)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["part", "seg", "first_doc", "last_doc", "n_docs", "n_tokens", "part_start", "blob"])

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = c.packed(x.as_py()) + end
                docs_.append(d)
                packed.append(one)
                lengths.append(len(one) // 4)
                held += len(one) // 4
                if held >= segment_tokens:
                    yield segment()
                    seg, before = seg + 1, before + held
                    docs_, lengths, packed, held = [], [], [], 0
        c.forget()
        if docs_:
            yield segment()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return staged(ordered.mapInArrow(run, SEGMENTS), "tokens", "uncompressed")


def read_documents(segments: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Only one row a file's partition, its number of ids, goes to the driver."""
    total, base = 0, {}
    for part, n in sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        base[part], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = Segment(blob.as_py())
                data, cuts = memoryview(s.dac.all().astype("<u4").tobytes()), s.starts.astype(np.int64)
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64(), mask=s.doc_ids == _NO_ID), pa.array(cuts[:-1] + base[part] + before, pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("part", "part_start", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


class TokenFiles:
    """Random access to written segments, by position in the whole sequence or within a document.

    The driver knows one number a part of the files. A lookup reads the one segment that row statistics lead
    to, and of its codes one chunk, bit and rank entry a level; nothing is decoded."""

    def __init__(self, segments: DataFrame):
        self.segments, self.starts, self.total = segments, [], 0
        for part, n in sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
            self.starts.append((self.total, part))
            self.total += n

    def token_at(self, position: int) -> int:
        """The token at a position of the sequence of all documents."""
        if not 0 <= position < self.total:
            raise IndexError(position)
        start, part = self.starts[bisect_right(self.starts, (position, 1 << 40)) - 1]
        at = position - start
        row = self.segments.filter((F.col("part") == part) & (F.col("part_start") <= at) & (F.col("part_start") + F.col("n_tokens") > at)).select("part_start", "blob").first()
        return Segment(row["blob"]).token(at - row["part_start"])

    def token_of(self, doc_id: int, k: int) -> int:
        """Token k of a document; of several with its id, of the first."""
        own = self.segments.filter((F.col("last_doc") >= doc_id) & (F.col("first_doc").isNull() | (F.col("first_doc") <= doc_id)))
        # the ids of the segments are in order, so only the first that can hold the document and has it counts
        for row in own.orderBy("part", "seg").select("blob").toLocalIterator():
            s = Segment(row["blob"])
            i = int(np.searchsorted(s.doc_ids, doc_id))
            if i < len(s.doc_ids) and s.doc_ids[i] == doc_id:
                if not 0 <= k < int(s.starts[i + 1] - s.starts[i]):
                    raise IndexError(k)
                return s.token(int(s.starts[i]) + k)
        raise KeyError(doc_id)
