"""BPE encoding and decoding of whole texts by tree concatenation.

A text of more than LEAF characters is halved, wherever that falls, down to leaves; the leaves are encoded
independently of each other, then neighbours are joined level by level. At a join the units (white space and what follows
it) that meet become one, as nothing but white space is sure to end a piece, and its pieces are found. Where a piece goes on across
the join, a window of the last tokens on its left and the first on its right is encoded anew and grows until its
first token is the left side's and its last token the right side's: from there on every adjacent pair of
tokens is one that BPE itself produces, so the joined ids are those of the whole. A piece that is neither a side's nor two of theirs
put together is encoded anew.

Texts of more than SPREAD bytes are dealt to the tasks in stretches. Each stretch is a subtree; FAN
neighbours at a time are joined in a task, round by round, so a very long text is neither encoded nor joined
in one place. Only the finished ids of a text are held by one task, as a text itself is.

Nulls and empty texts have no ids and decode to the empty text. Rows are independent: repeated rows give
repeated results, an empty table an empty one, and further columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import _UNIT, LONG_PIECE, SPACES, PieceCodec, codec
from .runtime import released, staged

#: Characters of a leaf of the tree.
LEAF = 1024
#: Tokens on each side of a join at first.
WINDOW = 4
#: Bytes beyond which a text is dealt to the tasks, characters of a stretch, and neighbours joined by a task.
SPREAD, STRETCH, FAN = 1 << 16, 1 << 15, 64


class Encoded(NamedTuple):
    """A stretch of text: its first and last unit with their ids, and the ids between them.

    A stretch of one unit has no tail."""

    head: str = ""
    head_ids: bytes = b""
    mid: bytes = b""
    tail: str = ""
    tail_ids: bytes = b""

    @property
    def ids(self) -> bytes:
        return self.head_ids + self.mid + self.tail_ids


def _last_unit(text: str) -> int:
    """Where the last unit begins."""
    n = 4 * LONG_PIECE
    while True:
        at = max(0, len(text) - n)
        starts = [m.start() for m in _UNIT.finditer(text, at)]
        if len(starts) > 1 or not at:
            return starts[-1]
        n *= 4


class TreeCodec(PieceCodec):
    """Byte-level BPE of texts as trees, and back."""

    def __init__(self, path: str):
        super().__init__(path)
        if self.kind != "byte":
            raise ValueError("trees are of byte-level BPE")
        size = self.tok.get_vocab_size(with_added_tokens=True)
        back = {c: b for b, c in self.shown.items()}
        self.tokens = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(map(back.__getitem__, t)) if all(c in back for c in t) else t.encode() for t in self.tokens]
        self.sizes = np.array([len(b) for b in self.bytes])
        self.decimal = [b"%d" % i for i in range(size)]
        #: Joins, windows grown at them, and pieces encoded anew.
        self.joins = self.windows = self.anew = 0

    def window(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of one piece, from those of its two sides."""
        k = WINDOW
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            made = [t.id for t in self.tokenize("".join([self.tokens[i] for i in (*left[len(left) - a :].tolist(), *right[:b].tolist())]))]
            if (a == len(left) or made[0] == left[-a]) and (b == len(right) or made[-1] == right[b - 1]):
                return np.concatenate([left[: len(left) - a], np.array(made, np.uint32), right[b:]])
            k *= 2

    def _pieces_of(self, unit: str, ids: bytes, at: int) -> dict[tuple[int, int], np.ndarray]:
        """The unit's pieces by their place, `at` characters further on, with their ids."""
        own = np.frombuffer(ids, "<u4")
        pieces = self.pieces(unit)
        ends = np.searchsorted(np.cumsum(self.sizes[own]), np.cumsum([len(p.encode()) for p in pieces])) + 1
        out, a = {}, 0
        for p, b in zip(pieces, ends.tolist()):
            out[at, at + len(p)] = own[a:b]
            at, a = at + len(p), b
        return out

    def seam(self, left: str, left_ids: bytes, right: str, right_ids: bytes) -> bytes:
        """The ids of a unit whose two sides are encoded: those of its pieces that lie in one side, and for the piece that goes on across
        the join a window that grows. Where the whole's pieces are not the sides' (a mark that joins another kind of piece), the piece is
        encoded anew."""
        unit, c = left + right, len(left)
        known = self._pieces_of(left, left_ids, 0) | self._pieces_of(right, right_ids, c)
        out, at = [], 0
        for p in self.pieces(unit):
            place, at = (at, at + len(p)), at + len(p)
            if place in known:
                out.append(known[place])
            elif place[0] < c < place[1] and (place[0], c) in known and (c, place[1]) in known:
                self.windows += 1
                out.append(self.window(known[place[0], c], known[c, place[1]]))
            else:
                self.anew += 1
                out.append(np.frombuffer(self.piece(p), "<u4"))
        return np.concatenate(out).astype("<u4").tobytes()

    def leaf(self, text: str) -> Encoded:
        if not text:
            return Encoded()
        a, b = _UNIT.match(text).end(), _last_unit(text)
        if not b:
            return Encoded(text, self.unit(text))
        return Encoded(text[:a], self.unit(text[:a]), self.plain(text[a:b]), text[b:], self.unit(text[b:]))

    def join(self, left: Encoded, right: Encoded) -> Encoded:
        """The two sides as one."""
        if not left.head or not right.head:
            return left if left.head else right
        self.joins += 1
        unit, ids = (left.tail, left.tail_ids) if left.tail else (left.head, left.head_ids)
        if right.head[0] in SPACES and unit[-1] not in SPACES:
            # the sides meet where a unit ends
            if not right.tail:
                return Encoded(left.head, left.head_ids, left.mid + left.tail_ids, right.head, right.head_ids)
            return Encoded(left.head, left.head_ids, left.mid + left.tail_ids + right.head_ids + right.mid, right.tail, right.tail_ids)
        met, met_ids = unit + right.head, self.seam(unit, ids, right.head, right.head_ids)
        if not left.tail:
            return Encoded(met, met_ids, right.mid, right.tail, right.tail_ids)
        if not right.tail:
            return Encoded(left.head, left.head_ids, left.mid, met, met_ids)
        return Encoded(left.head, left.head_ids, left.mid + met_ids + right.mid, right.tail, right.tail_ids)

    def joined(self, level: list[Encoded]) -> Encoded:
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else Encoded()

    def tree(self, text: str, leaf: int = LEAF) -> Encoded:
        """A text without added tokens."""
        return self.joined([self.leaf(text[i : i + leaf]) for i in range(0, len(text), leaf)])

    def packed(self, text: str | None) -> bytes:
        parts = self.parts(text) if text else []
        return b"".join([array("I", [self.added[x]]).tobytes() if k % 2 else self.tree(x).ids for k, x in enumerate(parts)])

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False): broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _columns(rows: list[tuple], kinds: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)]


KEY = ["h1", "h2", "bytes"]
_STRETCH = "h1 long, h2 long, bytes long, part int, k int, "
_ENCODED = _STRETCH + "head string, head_ids binary, mid binary, tail string, tail_ids binary"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def encode_long(texts: DataFrame, path: str) -> DataFrame:
    """(h1, h2, bytes, ids) of the distinct texts of (h1, h2, bytes, text), encoded and joined by many tasks.

    ids are packed little-endian unsigned 32-bit integers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, TreeCodec)
        for batch in batches:
            for *key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for part, x in enumerate(c.parts(text)):
                    for k in range(0, max(1, len(x)), STRETCH):
                        yield pa.RecordBatch.from_arrays(_columns([(*key, part, k // STRETCH, x[k : k + STRETCH])], [*_KINDS, pa.string()]), [*KEY, "part", "k", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, TreeCodec)
        for batch in batches:
            rows = []
            for *key, part, k, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                made = Encoded(text, array("I", [c.added[text]]).tobytes()) if part % 2 else c.tree(text)
                rows.append((*key, part, k, *made))
            yield pa.RecordBatch.from_arrays(_columns(rows, [*_KINDS, pa.string(), pa.binary(), pa.binary(), pa.string(), pa.binary()]), [x.split(" ")[0] for x in _ENCODED.split(", ")])
        c.forget()
        released()

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(c.to_pylist() for c in table.columns)), key=lambda r: r[4])
        made = codec(path, TreeCodec).joined([Encoded(*r[5:]) for r in rows])
        return pa.table(_columns([(*rows[0][:4], rows[0][4] // FAN, *made)], table.schema.types), table.schema.names)

    def finish(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(c.to_pylist() for c in table.columns)), key=lambda r: r[3])
        return pa.table(_columns([(*rows[0][:3], b"".join(Encoded(*r[5:]).ids for r in rows))], [*_KINDS[:3], pa.binary()]), [*KEY, "ids"])

    # equal stretches of equal texts are one row
    stretches = texts.select(*KEY, "text").mapInArrow(cut, _STRETCH + "text string").groupBy(*KEY, "part", "k").agg(F.first("text").alias("text"))
    level = staged(stretches.mapInArrow(encode, _ENCODED), "stretches", "lz4")
    most = (level.agg(F.max("k")).first()[0] or 0) + 1
    while most > 1:
        level, most = level.groupBy(*KEY, "part", F.floor(F.col("k") / FAN).alias("to")).applyInArrow(join, _ENCODED), -(-most // FAN)
        if most > 1:
            level = staged(level, "joined", "lz4")
    return level.groupBy(*KEY).applyInArrow(finish, "h1 long, h2 long, bytes long, ids binary")


def encoded(docs: DataFrame, path: str, row, schema: str, kinds: list[pa.DataType], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, then what row(codec, packed ids) gives of its ids."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, TreeCodec)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns([row(c, c.packed(x.as_py())) for x in batch.column(1)], kinds)], ["id", *names])
        c.forget()
        released()

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, TreeCodec)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *_columns([row(c, x.as_py()) for x in batch.column(3)], kinds)], [*KEY, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    out = own.filter(size <= SPREAD).mapInArrow(short, f"id {kind}, {schema}")
    far = own.filter(size > SPREAD)
    far = staged(far.select("id", F.xxhash64("text").alias("h1"), F.crc32(F.encode("text", "UTF-8")).alias("h2"), size.cast("long").alias("bytes"), "text"), "long-texts")
    if not far.isEmpty():
        made = encode_long(far, path).mapInArrow(long, f"h1 long, h2 long, bytes long, {schema}")
        out = out.unionAll(far.select("id", *KEY).join(made, KEY).select("id", *names))
    return out.withColumnRenamed("id", id_col)


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, ids array<int>, decoded) a document."""

    def row(c: TreeCodec, packed: bytes) -> tuple:
        ids = array("I", packed).tolist()
        return ids, c.decode(ids)

    return encoded(docs, path, row, "ids array<int>, decoded string", [pa.list_(pa.int32()), pa.string()], id_col, text_col)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: its number of ids, and digests of the ids and of the text decoded from them."""

    def row(c: TreeCodec, packed: bytes) -> tuple:
        ids = array("I", packed).tolist()
        return len(ids), hashlib.sha256(b",".join(map(c.decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encoded(own, path, row, "n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()])
