"""Sharding by a k-d tree over document metadata, built for equal bytes.

Every document is a point (language, source, size in octaves) with a weight, its bytes. A node splits
along its widest dimension, relative to the corpus, at the weighted median, until leaves reach the target
bytes. Medians are exact and distributed: each dimension orders the documents by one 64-bit key (the
coordinate, then a hash of the text), and a few rounds of weighted histograms, BINS a node, narrow the
key at which half the bytes are reached. Only these histograms come to the driver.

Equal texts share all coordinates if the group's smallest metadata stands for all its members, so a cut
falls between groups. A group that is too heavy for that (over SLACK of its node) is itself cut by
doc_id, and rows of one doc_id, or of none, that are too heavy still by their place in the table as it was written first; so one text
with a third of all rows still spreads over shards, whatever its ids.

Null metadata sort first, a null or empty text weighs 1, repeated rows are documents of their own, and
an empty table gives no rows. A text heavier than a shard's share makes its shard the heavier; texts themselves are only hashed and
measured, so their length costs nothing more. Columns other than doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import discard, hot_join, staged

DIMENSIONS = ("lang", "source", "octave")
BINS = 4096
#: A group of equal texts may put a cut off its place by this share of the node's bytes.
SLACK = 0.002
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass
class Node:
    """How many shards a node's rows go to, and the first of them; node n has the children 2n + 1 and 2n + 2."""

    leaves: int
    first: int


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and a key for each dimension, equal for equal texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    column = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        column("lang").alias("lang"), column("source").alias("source"),
    )
    # the smallest metadata of a group of equal texts stands for all of them; only groups of two or more are joined back
    copies = base.groupBy("text_hash", "size", "text_crc32").agg(F.min("lang").alias("g_lang"), F.min("source").alias("g_source"), F.max("lang").alias("x_lang"), F.max("source").alias("x_source"), F.count("*").alias("rows_of"))
    mixed = staged(copies.filter("g_lang <> x_lang or g_source <> x_source").select("text_hash", "size", "text_crc32", "g_lang", "g_source", "rows_of"), "mixed")
    one = hot_join(base, mixed, ["text_hash", "size", "text_crc32"], "left").withColumns({"lang": F.coalesce("g_lang", "lang"), "source": F.coalesce("g_source", "source")})
    # strings are placed by their last three bytes, where names with a common beginning differ
    place = lambda c: F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(c), "UTF-8"), -3, 3)), 6, "0"), 16, 10).cast("long")
    octave = F.floor(F.log2("size") * 64).cast("long")
    tail = F.shiftrightunsigned(F.col("text_hash"), 25)
    key = lambda place: place * F.lit(1 << 39) + tail
    return one.select("doc_id", "size", "text_crc32", key(place("lang")).alias("k_lang"), key(place("source")).alias("k_source"), key(octave).alias("k_octave"))


def _search(rows: DataFrame, value, targets: dict[int, int], ranges: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int, int]]:
    """For each node the value at which its weight reaches the target, the weight below it and its own weight."""
    spans, below = {n: ranges[n] for n in targets}, dict.fromkeys(targets, 0)
    done: dict[int, tuple[int, int, int]] = {}
    while spans:
        # span (lo, hi) inclusive; width of a bin is at least 1
        width = {n: (hi - lo) // BINS + 1 for n, (lo, hi) in spans.items()}
        pick = lambda table: F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in table.items() for x in kv]), F.col("node"))
        lo, hi = pick({n: s[0] for n, s in spans.items()}), pick({n: s[1] for n, s in spans.items()})
        inside = rows.filter(F.col("node").isin(list(spans))).withColumn("v", value).filter((F.col("v") >= lo) & (F.col("v") <= hi))
        bins = inside.groupBy("node", F.call_function("div", F.col("v") - lo, pick(width)).alias("bin"))
        found: dict[int, list[tuple[int, int]]] = {n: [] for n in spans}
        for r in bins.agg(F.sum("size").alias("w")).collect():
            found[r["node"]].append((r["bin"], r["w"]))
        for n in list(spans):
            for b, w in sorted(found[n]):
                if below[n] + w >= targets[n]:
                    start = spans[n][0] + b * width[n]
                    if width[n] == 1:
                        done[n] = start, below[n], w
                        del spans[n]
                    else:
                        spans[n] = start, min(start + width[n] - 1, spans[n][1])
                    break
                below[n] += w
            else:
                raise AssertionError("weights changed between rounds")
    return done


def _ends(rows: DataFrame, value: Column) -> dict[int, tuple[int, int]]:
    """The least and greatest value of each node."""
    return {r["node"]: (r["lo"], r["hi"]) for r in rows.groupBy("node").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).collect()}


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, row: a leaf of the tree for every document, in shards 0 to shards - 1, and the row's number."""
    # each row has a number of its own, for rows that nothing else tells apart
    rows = staged(points(docs).withColumns({"node": F.lit(0).cast("long"), "row": F.monotonically_increasing_id()}), "points")
    keys = [f"k_{d}" for d in DIMENSIONS]
    nodes = {0: Node(shards, 0)}
    whole: dict[str, int] = {}
    leaf_of: dict[int, int] = {}
    while nodes:
        for n in [n for n, x in nodes.items() if x.leaves == 1]:
            leaf_of[n] = nodes.pop(n).first
        if not nodes:
            break
        stats = {r["node"]: r for r in rows.filter(F.col("node").isin(list(nodes))).groupBy("node").agg(F.sum("size").alias("w"), *(f(k).alias(f"{name}_{k}") for k in keys for name, f in (("min", F.min), ("max", F.max)))).collect()}
        if 0 in stats:
            whole = {k: max(1, stats[0][f"max_{k}"] - stats[0][f"min_{k}"]) for k in keys}
        along, targets, ranges, after = {}, {}, {}, {}
        for n, x in nodes.items():
            left = x.leaves // 2
            after[2 * n + 1], after[2 * n + 2] = Node(left, x.first), Node(x.leaves - left, x.first + left)
            if s := stats.get(n):
                along[n] = max(keys, key=lambda k: (s[f"max_{k}"] - s[f"min_{k}"]) / whole[k])
                targets[n], ranges[n] = max(1, s["w"] * left // x.leaves), (s[f"min_{along[n]}"], s[f"max_{along[n]}"])
        if targets:
            value = F.coalesce(*(F.when(F.col("node") == n, F.col(k)) for n, k in along.items()))
            cuts = _search(rows, value, targets, ranges)
            split = F.lit(None).cast("boolean")
            heavy = {}
            for n, (cut, below, w) in cuts.items():
                if w > SLACK * stats[n]["w"]:
                    heavy[n] = targets[n] - below
            ids: dict[int, tuple[int, int, int]] = {}
            numbers: dict[int, tuple[int, int, int]] = {}
            doc, number = F.coalesce("doc_id", F.lit(_LOW >> 1)), F.col("row")
            if heavy:
                own = rows.filter(F.col("node").isin(list(heavy))).withColumn("k", value).filter(F.coalesce(*(F.when(F.col("node") == n, F.col("k") == cuts[n][0]) for n in heavy)))
                ids = _search(own, doc, heavy, _ends(own, doc))
                same = {n: heavy[n] - below for n, (_, below, w) in ids.items() if w > SLACK * stats[n]["w"]}
                if same:
                    equal = own.filter(F.coalesce(*(F.when(F.col("node") == n, doc == ids[n][0]) for n in same), F.lit(False)))
                    numbers = _search(equal, number, same, _ends(equal, number))
            for n, (cut, below, w) in cuts.items():
                key = F.col(along[n])
                if n in numbers:
                    goes_left = (key < cut) | ((key == cut) & ((doc < ids[n][0]) | ((doc == ids[n][0]) & (number <= numbers[n][0]))))
                elif n in ids:
                    goes_left = (key < cut) | ((key == cut) & (doc <= ids[n][0]))
                else:
                    # the group at the cut goes to the side that leaves the smaller error
                    goes_left = key <= cut if below + w - targets[n] <= targets[n] - below else key < cut
                split = F.when(F.col("node") == n, goes_left).otherwise(split)
            # written at each level, so that the next one's conditions do not stack up
            before = rows
            rows = staged(rows.withColumn("node", F.when(split, F.col("node") * 2 + 1).when(~split, F.col("node") * 2 + 2).otherwise(F.col("node"))), "nodes")
            discard(before)
        nodes = after
    shard = F.element_at(F.create_map(*[F.lit(x) for n, leaf in leaf_of.items() for x in (n, leaf)]), F.col("node").cast("int"))
    return rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), "row")


def with_slots(assigned: DataFrame) -> DataFrame:
    """Adds slot: 0, 1, ... in each shard in the order of doc_id.

    Rows are dealt into ranges of (shard, doc_id); a range's rows are numbered on their own and begin where
    the ranges before it end. The driver gets one count a range and shard."""
    order = ["shard", F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "row"]
    ranged = staged(assigned.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = sorted((r["shard"], r["range"], r["n"]) for r in ranged.groupBy("shard", "range").agg(F.count("*").alias("n")).collect())
    before: dict[int, int] = {}
    starts = []
    for shard, part, n in counts:
        starts.append((shard, part, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + n
    first = ranged.sparkSession.createDataFrame(starts, "shard int, range int, first long")
    number = F.row_number().over(W.partitionBy("shard", "range").orderBy(*order[1:]))
    return ranged.withColumn("k", number).join(F.broadcast(first), ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("k") - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    out = with_slots(assign(docs, shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
