"""Packing of whole documents into sequences of a fixed number of tokens by bin completion.

Documents are encoded once; of each piece its length, place and checksum are kept. How many pieces there are of each length is
all that a packing depends on, so it is searched on that histogram, of as many numbers as a sequence has tokens, whatever
the size of the corpus. The search is a branch-and-bound over sequences: the largest piece left opens one,
the undominated fillings of the rest of it are its branches, best first, and a filling is used as often as the histogram
allows. A branch is cut when its sequences and what its waste so far leaves room for can no longer beat the best packing
known, which is at first the one by best-fit decreasing. The search ends when the best packing needs no more than the
tokens themselves do, or after NODES branches: it need not be the optimum then, but is never worse than best fit.

A filling is dominated, and left out, if several of its pieces, or one, could make room for one larger piece that is at hand: the small
pieces are more useful later.

Every piece knows its number among those of its length in its part of the staged table; sums of counts by part make these numbers
of the whole corpus, and the plan (at most some hundred thousand numbers) says where the n-th piece of a length goes. Nothing else passes
the driver, and no task holds more than a batch of pieces.

Null and empty texts are documents of the end id alone; repeated rows are packed each on its own; a null doc_id stays
null; an empty table gives no pieces; further columns, whatever their names, are not read. A text is encoded whole in
one task, as it is one row.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pieces import codec
from .runtime import staged

CAPACITY, END_ID = 2048, 0
#: Fillings tried for a sequence, and branches after which the search ends.
WIDTH, NODES = 4, 6000

#: (length, how often) of the pieces of a sequence, longest first, and how many sequences are filled so.
Filling = tuple[tuple[int, int], ...]
Plan = list[tuple[Filling, int]]


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing: each piece, longest first, goes where least room is left, equal pieces together."""
    room: dict[int, list[tuple[Filling, int]]] = {}
    rest: list[int] = []  # the residues with open sequences, ascending
    for n in range(capacity, 0, -1):
        left = int(counts[n])
        while left:
            at = bisect_left(rest, n)
            r = rest[at] if at < len(rest) else capacity
            if at < len(rest):
                filling, bins = room[r].pop()
                if not room[r]:
                    del room[r], rest[at]
            else:
                filling, bins = (), -(-left // (capacity // n))
            # once in a sequence, a piece leaves it the tightest place for the next of its length
            each = r // n
            full = min(bins, left // each)
            made = [((*filling, (n, each)), full, r - each * n)]
            left -= full * each
            if full < bins:
                if left:
                    made.append(((*filling, (n, left)), 1, r - left * n))
                    full, left = full + 1, 0
                made.append((filling, bins - full, r))
            for filling, bins, r in made:
                if bins:
                    if r not in room:
                        rest.insert(bisect_left(rest, r), r)
                    room.setdefault(r, []).append((filling, bins))
    return [x for own in room.values() for x in own if x[0]]


def fillings(counts: np.ndarray, room: int, width: int = WIDTH) -> list[Filling]:
    """Undominated fillings of the room from pieces at hand, those that leave least first, of these the largest pieces first."""
    sizes = [n for n in range(min(room, len(counts) - 1), 0, -1) if counts[n]]
    if not sizes:
        return [()]
    if sizes[0] == room:
        return [((room, 1),)]  # dominates all others
    mask = (1 << (room + 1)) - 1
    # sums that the pieces from the k-th size on can have
    sums = [1] * (len(sizes) + 1)
    for k in range(len(sizes) - 1, -1, -1):
        s, n, left = sums[k + 1], sizes[k], min(int(counts[sizes[k]]), room // sizes[k])
        step = 1
        while left:
            step = min(step, left)
            s |= s << (n * step) & mask
            left, step = left - step, 2 * step
        sums[k] = s
    at_hand = sum(1 << n for n in sizes)
    out: list[Filling] = []
    total, tried = sums[0].bit_length() - 1, 0
    while total > 0 and len(out) < width and tried < 8 * width:
        if sums[0] >> total & 1:
            # depth first, the largest pieces first; the sums say which choices lead to the total
            stack: list[tuple[int, int, Filling]] = [(0, total, ())]
            while stack and len(out) < width and tried < 8 * width:
                k, need, own = stack.pop()
                if not need:
                    tried += 1
                    if not _dominated(own, room - total, counts, at_hand):
                        out.append(own)
                    continue
                while k < len(sizes) and sizes[k] > need:
                    k += 1
                if k == len(sizes) or not sums[k] >> need & 1:
                    continue
                n = sizes[k]
                for times in range(min(int(counts[n]), need // n) + 1):
                    if sums[k + 1] >> (need - times * n) & 1:
                        stack.append((k + 1, need - times * n, (*own, (n, times)) if times else own))
        total -= 1
    return out or [()]


def _dominated(own: Filling, waste: int, counts: np.ndarray, at_hand: int) -> bool:
    """Whether some of the filling's pieces could make way for one larger piece that is at hand and not in it."""
    for n, times in own:
        if counts[n] == times:
            at_hand &= ~(1 << n)
    one = several = 0  # sums of one piece, and of two or more
    for n, times in own:
        for _ in range(times):
            several |= (one | several) << n
            one |= 1 << n
    # one larger piece in place of one or none, or any that several leave room for: up to the waste more
    replaced, wide = several, 1
    larger = (one | 1) << 1 if waste else 0
    while wide <= waste:
        step = min(wide, waste + 1 - wide)
        replaced |= replaced << step
        wide += step
    wide = 1
    while wide < waste:
        step = min(wide, waste - wide)
        larger |= larger << step
        wide += step
    return bool((replaced | larger) & at_hand)


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY, width: int = WIDTH, nodes: int = NODES) -> Plan:
    """Fillings and how often each is used, so that every piece of the histogram is in one."""
    left = np.array(counts, np.int64)
    tokens = int((left * np.arange(len(left))).sum())
    least = -(-tokens // capacity)
    best = best_fit(left, capacity)
    used = sum(times for _, times in best)

    def branches() -> list[tuple[Filling, int]]:
        """What the longest piece left can share a sequence with, and how often, worst first."""
        n = int(np.flatnonzero(left)[-1])
        left[n] -= 1
        out = []
        for own in fillings(left, capacity - n, width):
            full = ((n, 1), *own) if not own or own[0][0] != n else ((n, own[0][1] + 1), *own[1:])
            out.append((full, min(int(left[m] + (m == n)) // k for m, k in full)))
        left[n] += 1
        return out[::-1]

    def put(own: Filling, times: int) -> int:
        for n, k in own:
            left[n] -= k * times
        return times * (capacity - sum(n * k for n, k in own))

    # each frame: the branches not yet tried, the one that is being tried, the waste before it, the sequences before it
    frames: list[list] = []
    waste = bins = 0
    if used > least:
        frames.append([branches(), None, 0, 0])
    while frames and used > least and nodes:
        rest, now, waste, bins = frames[-1]
        if now is not None:
            put(now[0], -now[1])
            frames[-1][1] = None
        if not rest:
            frames.pop()
            continue
        own, times = rest.pop()
        nodes -= 1
        frames[-1][1] = (own, times)
        waste, bins = waste + put(own, times), bins + times
        # the pieces left need what they weigh; with what is wasted already this must be less than the best
        if tokens + waste > (used - 1) * capacity:
            continue
        if not left.any():
            best, used = [f[1] for f in frames], bins
            continue
        frames.append([branches(), None, waste, bins])
    return best


class Places:
    """Where the n-th piece of a length goes."""

    def __init__(self, plan: Plan, capacity: int = CAPACITY):
        seen = np.zeros(capacity + 1, np.int64)
        rows, sequence = [], 0
        for own, times in plan:
            offset = 0
            for n, k in own:
                rows.append((n, int(seen[n]), k, sequence, offset))
                seen[n] += k * times
                offset += n * k
            sequence += times
        self.sequences = sequence
        rows.sort()
        length, self.first, self.each, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 5).T.copy()
        self.stride = int(seen.max()) + 1
        self.key = length * self.stride + self.first

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        at = np.searchsorted(self.key, length * self.stride + number, "right") - 1
        k = number - self.first[at]
        return self.sequence[at] + k // self.each[at], self.offset[at] + k % self.each[at] * length


PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents, in the shared folder: doc_id, piece, start, length, ids_crc32, the part of the table, and the
    piece's number among those of its length in that part; with keep_ids also its ids as packed unsigned 32-bit integers.

    Only documents of more tokens than a sequence are cut; the first piece takes what is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, part, end = codec(path), TaskContext.get().partitionId(), np.uint32(end_id).tobytes()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(c.packed(x.as_py()) + end)
                n = len(ids) // 4
                pieces = -(-n // capacity)
                a = 0
                for k in range(pieces):
                    b = n - (pieces - 1 - k) * capacity
                    own = ids[4 * a : 4 * b]
                    rows.append((d, k, a, b - a, zlib.crc32(own), part, seen[b - a], *((bytes(own),) if keep_ids else ())))
                    seen[b - a] += 1
                    a = b
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if keep_ids else [])]
            names = [x.split(" ")[0] for x in PIECE.split(", ")] + ["ids"] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)], names)
        c.forget()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(own.mapInArrow(run, PIECE + ", ids binary" * keep_ids), "pieces")


def pack(pieces: DataFrame, capacity: int = CAPACITY, width: int = WIDTH, nodes: int = NODES) -> DataFrame:
    """The pieces with sequence_id, from 0 without gaps, and offset, their place in that sequence."""
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # at most as many rows as a sequence has tokens
        counts[length] = n
    places = Places(plan_packing(counts, capacity, width, nodes), capacity)
    # one row a part and length: the pieces of that length in the parts before
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    known = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = pieces.join(known, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places(batch.column("length").to_numpy().astype(np.int64), batch.column("nth").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    return numbered.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields) + ", sequence_id long, offset long")


def packed_sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): the token ids of each sequence, and whose they are in that order.

    A group is one sequence, so it has at most as many tokens as that."""
    placed = pack(cut(docs, path, capacity, end_id, keep_ids=True), capacity)

    def fill(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("offset", "doc_id", "length", "ids"))), key=lambda r: r[0])
        ids = np.frombuffer(b"".join(r[3] for r in rows), "<u4").astype(np.int64)
        return pa.table({"sequence_id": table.column("sequence_id")[:1], "ids": [ids], "doc_ids": [[r[1] for r in rows]], "lengths": [[r[2] for r in rows]]}, pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))]))

    return placed.groupBy("sequence_id").applyInArrow(fill, "sequence_id long, ids array<long>, doc_ids array<long>, lengths array<int>")


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per piece of a document where it lies: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(docs, path)).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
