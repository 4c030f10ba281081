"""Exact corpus counts of many small keys (shingles, n-grams), brought back to the texts that asked.

Texts are dealt into batches of bounded size by a hash. A batch sends its distinct keys, sorted and packed,
to the parts of the key space; a part sums each key over all batches and answers each batch with the sums
of its keys, in the order in which it asked. A key that a third of all documents have is sent once a
batch, so no part and no task gets more than its share, and neither keys nor counts reach the driver. What a batch sends is
one row for each part that it has keys of: with few parts a row a part, with very many parts at most a row a key, so the rows grow
as the text does.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import lower_words, partitions, released

#: Bytes of text in a batch, on average.
BATCH_TEXT = 4 << 20
#: Bytes of text whose keys a part of the key space holds, on average.
PART_TEXT = 32 << 20
#: Words whose hash a worker remembers.
KNOWN_WORDS = 400_000
KEY_BITS = 48

REQUEST = "part int, batch int, lo binary, hi binary, n binary"
ANSWER = "batch int, part int, n binary, keys long, total long"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()
def forget_words() -> None:
    """Empties what word_hashes remembers: a worker lives on, and other steps need its memory."""
    _HASHES.clear()


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of the text, A-Z lower-cased."""
    found = lower_words(text)
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def mixed(h: np.ndarray) -> np.ndarray:
    """A hash of each 64-bit value whose every bit depends on all of its bits."""
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n values, in order."""
    size = len(h) - n + 1
    out = h[:size].copy()
    for k in range(1, n):
        out ^= out >> np.uint64(31)
        out *= _M1
        out += h[k : k + size]
    return mixed(out)


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    h = np.sort(h)
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def part_count(docs: DataFrame, text_col: str = "text") -> int:
    """Parts of the key space: as many as there are shuffle partitions, and more with more text, so that a part's
    size doesn't grow with the data."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-total // PART_TEXT))


def batch_count(docs: DataFrame, text_col: str = "text") -> int:
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(1, -(-total // BATCH_TEXT))


def batch_of(key: Column, batches: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")


def requests(batch: int, keys: np.ndarray, n: np.ndarray | None, parts: int, first_part: int = 0, bits: int = KEY_BITS) -> Iterable[tuple]:
    """Rows of REQUEST for sorted distinct keys below 2 ** bits: one for each part that has any of them, so never more than keys."""
    part = ((keys >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
    for a, b in zip(edges, edges[1:]):
        own = keys[a:b]
        yield first_part + int(part[a]), batch, own.astype("<u4").tobytes(), (own >> np.uint64(32)).astype("<u4").tobytes(), n[a:b].astype("<u4").tobytes() if n is not None else b""


def request_table(rows: Iterable[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "batch", "lo", "hi", "n"])


def answers(requested: DataFrame, most: int | None = None) -> DataFrame:
    """ANSWER for every row of REQUEST: the sums of its keys as unsigned 32-bit integers (or bytes, up to `most`).

    Requests without counts count 1 a key. A part also tells, in one row with batch -1, how many keys it has whose sum isn't 0, and their total."""

    def run(table: pa.Table) -> pa.Table:
        part, batches = table["part"][0].as_py(), table["batch"].to_pylist()
        lo = [np.frombuffer(x.as_py(), "<u4") for x in table["lo"]]
        cuts = np.cumsum([0, *map(len, lo)]).tolist()
        # a part has millions of keys: no array of them lives longer than it is needed
        keys = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table["hi"]]).astype(np.uint64)
        keys <<= np.uint64(32)
        for x, a, b in zip(lo, cuts, cuts[1:]):
            keys[a:b] |= x
        del lo
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        del keys
        first = np.flatnonzero(new)
        del new
        times = np.diff(first, append=len(order))
        n = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table["n"]])
        sums = np.add.reduceat(n[order], first, dtype=np.int64) if len(n) else times
        del n
        kind = "<u4" if most is None else "u1"
        back = np.empty(len(order), kind)
        back[order] = np.repeat(np.minimum(sums, (1 << 32) - 1 if most is None else most).astype(kind), times)
        keyed, total = int((sums > 0).sum()), int(sums.sum())
        del order, first, times, sums
        packed = [back[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        del back
        released()
        return pa.table([pa.array([*batches, -1], pa.int32()), pa.array([part] * (len(batches) + 1), pa.int32()), pa.array([*packed, b""], pa.binary()), pa.array([0] * len(batches) + [keyed], pa.int64()), pa.array([0] * len(batches) + [total], pa.int64())], ["batch", "part", "n", "keys", "total"])

    return requested.groupBy("part").applyInArrow(run, ANSWER)


def answered(table: pa.Table, first: int, last: int, kind: str = "<u4") -> np.ndarray:
    """The sums for a batch's sorted keys from its answers of parts first to last - 1."""
    rows = sorted((p, n) for p, n in zip(table["part"].to_pylist(), table["n"].to_pylist()) if first <= p < last)
    return np.frombuffer(b"".join(n for _, n in rows), kind)
