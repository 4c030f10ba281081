"""Vectors and queries in blocks that meet in pairs, for products of two large tables.

Rows are packed into blocks, one row of a table each. Every block of queries meets every block of vectors of its dimension: a small
query side is broadcast, its bytes summed first; a large one and the vectors are dealt to the cells of a grid, so that
a cell joins about as many bytes of either, and neither side is on the driver or in one task as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import spread, staged

#: Rows and values of a block at most.
BLOCK_ROWS, BLOCK_VALUES = 2048, 1 << 18
#: Rows of a block of queries at most, so that a pair has at most 2 million products.
QUERY_ROWS = 1024
#: Bytes of queries that may be broadcast, and of either side in a cell of the grid.
BROADCAST_BYTES, CELL_BYTES = 64 << 20, 64 << 20
#: (query, vector) pairs that a task holds before it passes its best on.
HELD = 4_000_000
#: Keys of a block of lists at most, but for one row.
LIST_VALUES = 1 << 19

SCHEMA = "block long, dim int, cell int, n int, ids binary, vectors binary, more binary"


def pack(rows: DataFrame, kind: str = "<f8", most: int = BLOCK_ROWS) -> DataFrame:
    """rows (id long, vector array, cell int if they are of cells, further long columns) as blocks: block, dim, cell, n, ids, vectors, more.

    A block's vectors are of one dimension and cell; `more` has the further columns, one after the other. Rows without a vector are
    left out."""
    extra = [c for c in rows.columns if c not in ("id", "vector", "cell")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[tuple[int, int], list[tuple]] = {}
        part, made = TaskContext.get().partitionId(), 0

        def block(of: tuple[int, int]) -> pa.RecordBatch:
            nonlocal made
            ids, vectors, more = (np.concatenate(x) for x in zip(*held.pop(of)))
            made += 1
            row = [(part << 32) + made - 1, *of, len(ids), ids.tobytes(), vectors.astype(kind).tobytes(), more.T.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], [x.split(" ")[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            lists = batch.column("vector")
            values, ends = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64), np.cumsum(lists.value_lengths().to_numpy())
            dims = np.diff(ends, prepend=0)
            ids = batch.column("id").to_numpy()
            more = np.column_stack([np.zeros((len(ids), 0), np.int64), *(batch.column(c).to_numpy() for c in extra)]).astype(np.int64)
            cells = batch.column("cell").to_numpy() if "cell" in batch.schema.names else np.zeros(len(ids), np.int64)
            for dim, cell in np.unique(np.column_stack([dims, cells]), axis=0).tolist():
                of, own = (dim, cell), np.flatnonzero((dims == dim) & (cells == cell))
                matrix = values[(ends[own] - dim)[:, None] + np.arange(dim)]
                size = max(1, min(most, BLOCK_VALUES // max(dim, 1)))
                a = 0
                while a < len(own):
                    free = size - sum(len(x[0]) for x in held.get(of, ()))
                    held.setdefault(of, []).append((ids[own[a : a + free]], matrix[a : a + free], more[own[a : a + free]]))
                    if len(own) - a >= free:
                        yield block(of)
                    a += free
            # many dimensions or cells, each with a few rows
            while sum(x[1].size + len(x[0]) for own in held.values() for x in own) > 4 * BLOCK_VALUES:
                yield block(max(held, key=lambda d: sum(x[1].size for x in held[d])))
        for of in sorted(held):
            yield block(of)

    return rows.filter("vector is not null").mapInArrow(run, SCHEMA)


def packed(rows: DataFrame, kind: str = "<f8", most: int = BLOCK_ROWS) -> DataFrame:
    """The blocks of `pack` in the shared folder."""
    return staged(pack(rows, kind, most), "blocks", "lz4")


def paired(vectors: DataFrame, queries: DataFrame, dealt: bool = True) -> DataFrame:
    """Each block of vectors beside each block of queries of its dimension and cell, whose columns begin with q_; blocks of vectors that
    aren't tables yet stay in the tasks that make them, unless the queries are too large to be broadcast."""
    asked = queries.select(*(F.col(c).alias(c if c in ("dim", "cell") else f"q_{c}") for c in queries.columns))
    size = lambda df: df.agg(F.sum(F.length("vectors") + F.length("ids") + F.length("more"))).first()[0] or 0
    if (bytes_ := size(queries)) <= BROADCAST_BYTES:
        return (spread(vectors) if dealt else vectors).join(F.broadcast(asked), ["dim", "cell"])
    vectors = vectors if dealt else staged(vectors, "blocks", "lz4")
    rows, columns = math.ceil(bytes_ / CELL_BYTES), max(1, math.ceil(size(vectors) / CELL_BYTES))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    own = vectors.select("*", place("block", columns).alias("column"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"))
    asked = asked.select("*", place("q_block", rows).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"))
    return own.join(asked, ["dim", "cell", "row", "column"]).drop("row", "column")


def best_products(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, pos, score, rank): the k largest inner products of each query (id, vector) with vectors (id, vector).

    Both are blocks by `packed`. Products are rounded to six places; equal ones rank by pos; those that are not numbers are left out."""

    def products(r: dict) -> np.ndarray:
        q, v = (np.frombuffer(x, "<f8").reshape(n, r["dim"]) for x, n in ((r["q_vectors"], r["q_n"]), (r["vectors"], r["n"])))
        return np.round(q @ v.T, 6)

    return best_scores(paired(vectors, queries).drop("more", "q_more"), products, k)


def best_scores(pairs: DataFrame, scores_of: Callable[[dict], np.ndarray], k: int) -> DataFrame:
    """(query_id, pos, score, rank): the k largest scores of each query, where scores_of gives those of a pair of blocks, a row a query.

    A task keeps the best k of a query over all pairs of blocks that it sees, and only these become rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def told(own: list) -> pa.RecordBatch:
            asked, query, pos, score, _ = own
            return pa.RecordBatch.from_arrays([pa.array(asked[query], pa.int64()), pa.array(pos, pa.int64()), pa.array(score)], ["query_id", "pos", "score"])

        for batch in batches:
            # one pair after the other: a batch may have many, each with two blocks
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                asked = np.frombuffer(r["q_ids"], "<i8")
                own = held.get(r["q_block"]) or [asked, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(asked), -np.inf)]
                scores = scores_of(r)
                query, at = np.nonzero(scores >= own[4][:, None])
                held[r["q_block"]] = keep_best(own, query, np.frombuffer(r["ids"], "<i8")[at], scores[query, at], k)
                if sum(len(x[1]) for x in held.values()) > HELD:
                    yield from map(told, held.values())
                    held.clear()
        yield from map(told, held.values())

    found = pairs.mapInArrow(run, "query_id long, pos long, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("pos")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def pack_lists(rows: DataFrame, most: int) -> DataFrame:
    """rows (id long, keys array<long>, values array<double>, further long columns) as blocks: `vectors` has all keys, then all values, and
    `more` how many a row has, then the further columns."""
    extra = [c for c in rows.columns if c not in ("id", "keys", "values")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                lengths = batch.column("keys").slice(a, most).value_lengths().to_numpy().astype(np.int64)
                n = max(1, int(np.searchsorted(np.cumsum(lengths), LIST_VALUES, "right")))
                own, lengths = batch.slice(a, min(n, len(lengths))), lengths[:n]
                keys, values = (own.column(c).flatten().to_numpy(zero_copy_only=False).astype(t) for c, t in (("keys", "<i8"), ("values", "<f8")))
                more = [lengths, *(own.column(c).to_numpy() for c in extra)]
                row = [(part << 32) + made, 0, 0, own.num_rows, own.column("id").to_numpy().tobytes(), keys.tobytes() + values.tobytes(), np.array(more, np.int64).tobytes()]
                made, a = made + 1, a + own.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], [x.split(" ")[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def lists(n: int, vectors: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block by pack_lists the row of each key, keys and values, and the further columns."""
    half = len(vectors) // 2
    told = np.frombuffer(more, "<i8").reshape(-1, n)
    return np.repeat(np.arange(n), told[0]), np.frombuffer(vectors[:half], "<i8"), np.frombuffer(vectors[half:], "<f8"), told[1:]


def keep_best(own: list, query: np.ndarray, pos: np.ndarray, score: np.ndarray, k: int) -> list:
    """The best k of each query from those held and new ones, and the score that another must reach."""
    asked, least = own[0], own[4].copy()
    query, pos, score = (np.concatenate([a, b]) for a, b in zip(own[1:4], (query, pos, score)))
    order = np.lexsort((pos, -score, query))
    query, pos, score = query[order], pos[order], score[order]
    place = np.arange(len(order)) - np.searchsorted(query, np.arange(len(asked)))[query]
    kept = place < k
    query, pos, score, place = query[kept], pos[kept], score[kept], place[kept]
    last = place == k - 1
    least[query[last]] = score[last]
    return [asked, query, pos, score, least]
