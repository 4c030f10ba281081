"""Hard negatives by bit-sliced integer products.

Components are integers. A row's components are cut into bit-planes, and the products of an anchor's vector with
the planes are added, most significant first. After a plane of weight 2^k the score lies between what has been added and that plus what the
remaining bits can add at most: 2^k - 1 times the anchor's positive components upwards, times its negative ones downwards.
So every plane halves the interval; a pair of anchor and row is dropped as soon as its interval ends below the k-th best lower
end known for the anchor, or lies outside the scores that are asked for. At first whole blocks are multiplied with a plane; when
few pairs are left, each pair for itself.

Two passes are made, over the same blocks: the best rows of the anchor's label, then, for the scores that each of
these positives allows, the best rows of other labels. Blocks of anchors meet blocks of rows as in dense search:
a small side is broadcast, its bytes summed first, a large one dealt to a grid.

Of rows equal in label and components only as many as could be chosen are searched, those of smallest id: a
vector that a third of all rows have costs no more than one that a few have. Anchors are not thinned.

Rows without an id, a label or a vector, or with a null or non-finite component take no part. Rows repeated in full count once; rows that
share an id with others are rows of their own, but never their anchor's positive. Rows whose vector has another length than the
anchor's have no score with it; an empty vector scores 0. Anchors without a positive, or positives without a fitting negative,
give no rows, and so does an empty table; further columns, whatever their names, are not read. Scores are exact below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.blocks import HELD, QUERY_ROWS, keep_best, packed, paired
from ..sources.shared import spread
from .runtime import discard, staged

#: Share of a block's pairs below which each is followed for itself.
FEW = 1 / 16
#: Pairs whose planes are multiplied at once.
PAIRS = 1 << 15
_LEAST, _MOST = -(1 << 62), 1 << 62


class Windows:
    """For each anchor of a block, ranges of scores of which the best k rows are asked for, and the best so far."""

    def __init__(self, anchors: int, low: np.ndarray, high: np.ndarray, k: int):
        # ranges in rows, anchors in columns; nothing lies in an empty one
        self.low, self.high, self.k = np.where(low > high, _MOST, low), high, k
        none = np.zeros(0, np.int64)
        self.held = [[np.arange(anchors), none, none, none, np.full(anchors, _LEAST)] for _ in low]

    def qualify(self, score: np.ndarray, down: np.ndarray, up: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Which pairs of a whole block, anchors in rows, could be among the best of some range; the interval of a pair is from
        score + down to score + up of its anchor.

        For anchors without k rows so far, k intervals of the block inside the range bound its others from below."""
        most = {4: 1 << 24, 8: 1 << 53}[score.itemsize] if score.dtype.kind == "f" else _MOST
        bound = lambda x: np.clip(x, -most, most).astype(score.dtype)[:, None]
        out = np.zeros(allowed.shape, bool)
        for low, high, own in zip(self.low, self.high, self.held):
            least = np.maximum(low, own[4])
            new = np.flatnonzero((own[4] == _LEAST) & (low < _MOST))
            if len(new) and allowed.shape[1] >= self.k:
                inside = allowed[new] & (score[new] >= bound((low - down)[new])) & (score[new] <= bound((high - up)[new]))
                kth = -np.partition(np.where(inside, -score[new], np.inf), self.k - 1, 1)[:, self.k - 1] + down[new]
                least[new] = np.maximum(least[new], np.maximum(kth, _LEAST).astype(np.int64))
            out |= (score >= bound(least - up)) & (score <= bound(high - down))
        return out & allowed

    def tightened(self, lower: np.ndarray, upper: np.ndarray, who: np.ndarray) -> np.ndarray:
        """The same for single pairs; who: the anchor of each."""
        out = np.zeros(len(who), bool)
        for low, high, own in zip(self.low, self.high, self.held):
            least = np.maximum(low, own[4])
            inside = np.flatnonzero((lower >= low[who]) & (upper <= high[who]))
            order = inside[np.lexsort((-lower[inside], who[inside]))]
            first = np.searchsorted(who[order], np.arange(len(least)))
            last = first + self.k - 1
            enough = last < np.append(first[1:], len(order))
            least[enough] = np.maximum(least[enough], lower[order[last[enough]]])
            out |= (upper >= least[who]) & (lower <= high[who])
        return out

    def take(self, who: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        for i, (low, high, own) in enumerate(zip(self.low, self.high, self.held)):
            inside = (score >= low[who]) & (score <= high[who])
            self.held[i] = keep_best(own, who[inside], ids[inside], score[inside], self.k)


def sliced(anchors: np.ndarray, rows: np.ndarray, allowed: np.ndarray, ids: np.ndarray, wanted: Windows) -> int:
    """Hands the pairs (anchors in rows, rows in columns of allowed) that can qualify to wanted; returns how many were followed to
    the last plane."""
    planes = int(np.abs(rows).max(initial=0)).bit_length() + 1
    up, down = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    most = int((up - down).max(initial=0)) << planes
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    a = anchors.astype(kind)
    score, pairs, k = np.zeros(allowed.shape, kind), None, planes - 1

    def plane(k: int) -> tuple[np.ndarray, int]:
        return (((rows < 0), -(1 << k)) if k == planes - 1 else ((rows >> k & 1), 1 << k))

    # whole blocks, as long as many pairs can qualify
    while k >= 0 and pairs is None:
        bits, weight = plane(k)
        score += kind(weight) * (a @ bits.astype(kind).T)
        rest = (1 << k) - 1
        k -= 1
        # while every interval is wider than all scores lie apart none can end below another
        if k >= 0 and score.size and ((up - down) * rest).min() > np.ptp(score):
            continue
        alive = wanted.qualify(score, down * rest, up * rest, allowed)
        if alive.sum() <= FEW * alive.size or k < 0:
            pairs = np.nonzero(alive)
    i, j = pairs if pairs is not None else np.nonzero(allowed)
    s = score[i, j].astype(np.int64)
    # the pairs that are left
    while k >= 0:
        rest = (1 << (k + 1)) - 1
        kept = wanted.tightened(s + down[i] * rest, s + up[i] * rest, i)
        i, j, s = i[kept], j[kept], s[kept]
        bits, weight = plane(k)
        bits = bits.astype(kind)
        for x in range(0, len(i), PAIRS):
            s[x : x + PAIRS] += weight * np.einsum("pd,pd->p", a[i[x : x + PAIRS]], bits[j[x : x + PAIRS]]).astype(np.int64)
        k -= 1
    kept = wanted.tightened(s, s, i)
    wanted.take(i[kept], ids[j[kept]], s[kept])
    return len(i)


def _search(rows: DataFrame, anchors: DataFrame, same_label: bool, k: int, ranges: int) -> DataFrame:
    """(key, range, id, score): for each anchor and range its best k rows of the same or of other labels.

    Blocks: rows with their label, anchors with id, label and the ends of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, Windows]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for keys, wanted in held.values():
                for i, (_, who, ids, score, _) in enumerate(wanted.held):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[who], pa.int64()), pa.array(np.full(len(who), i), pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], ["key", "range", "id", "score"])
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                keys, ids, labels = (np.frombuffer(r[c], "<i8") for c in ("q_ids", "ids", "more"))
                own, label, *ends = np.frombuffer(r["q_more"], "<i8").reshape(-1, len(keys))
                if r["q_block"] not in held:
                    held[r["q_block"]] = keys, Windows(len(keys), np.array(ends[::2]), np.array(ends[1::2]), k)
                allowed = (label[:, None] == labels) & (own[:, None] != ids) if same_label else label[:, None] != labels
                a, b = (np.frombuffer(x, "<i8").reshape(n, r["dim"]) for x, n in ((r["q_vectors"], r["q_n"]), (r["vectors"], r["n"])))
                sliced(a, b, allowed, ids, held[r["q_block"]][1])
                if len(held) * QUERY_ROWS * ranges * k > HELD:
                    yield from told()
        yield from told()

    found = paired(rows, anchors).mapInArrow(run, "key long, range int, id long, score long")
    place = F.row_number().over(W.partitionBy("key", "range").orderBy(F.desc("score"), F.asc("id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows and anchors: id long, label, components array<long>. An anchor's positives are its best other rows of its label; for each, its
    negatives are the best rows of other labels whose score is at least `low` and at most `high` percent of the positive's."""
    complete = lambda df: df.filter("id is not null and label is not null and components is not null and not exists(components, x -> x is null)").select("id", F.col("label").cast("long").alias("label"), "components").distinct()
    rows, anchors = staged(complete(rows), "rows"), staged(complete(anchors).withColumn("key", F.monotonically_increasing_id()), "anchors")
    # of equal rows those that can be chosen: the positives and the anchor's own, or the negatives
    equal = F.row_number().over(W.partitionBy("label", "components").orderBy("id"))
    able = rows.withColumn("equal", equal).filter(F.col("equal") <= max(positives + 1, negatives))
    blocks = packed(spread(able.select("id", F.col("components").alias("vector"), "label")), "<i8")
    asked = packed(anchors.select(F.col("key").alias("id"), F.col("components").alias("vector"), F.col("id").alias("own"), "label", F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high")), "<i8", QUERY_ROWS)
    near = staged(_search(blocks, asked, True, positives, 1).select("key", "id", "score", "rank"), "positives")
    # the scores that each positive allows, as columns beside the anchor; none where there are fewer positives
    at = lambda i: F.max(F.when(F.col("rank") == i + 1, F.col("score")))
    ends = near.groupBy("key").agg(*(at(i).alias(f"s{i}") for i in range(positives)))
    floor = lambda x: F.expr(f"({x} - pmod({x}, 100)) div 100")
    bound = []
    for i in range(positives):
        bound += [F.coalesce(-floor(f"(-{low} * s{i})"), F.lit(1)).alias(f"low{i}"), F.coalesce(floor(f"({high} * s{i})"), F.lit(0)).alias(f"high{i}")]
    again = packed(anchors.join(ends, "key").select(F.col("key").alias("id"), F.col("components").alias("vector"), F.col("id").alias("own"), "label", *bound), "<i8", QUERY_ROWS)
    far = _search(blocks, again, False, negatives, positives).select("key", (F.col("range") + 1).alias("of"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("rank"))
    chosen = near.select("key", F.col("rank").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("key", F.col("id").alias("anchor_id"))
    out = staged(far.join(chosen, ["key", "of"]).join(named, "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(rows, anchors, blocks, asked, near, again)
    return out


def integer_rows(vectors: DataFrame) -> DataFrame:
    """id, label, components of the vectors that take part: floor(256 * x) of each component; the label of every seventh id is one
    further, of ten."""
    finite = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).filter(finite).select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x * 256)).alias("components"))


def mine(vectors: DataFrame) -> DataFrame:
    """The hard negatives of every fiftieth id."""
    rows = integer_rows(vectors)
    return hard_negatives(rows, rows.filter("id % 50 = 0"))
