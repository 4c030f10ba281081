"""Periodic runs of words by Main-Lorentz divide and conquer, and texts without the repeats.

Words are interned to numbers, a batch of texts at a time, with a number of its own between texts, so that no match leaves
its text. A stretch is halved again and again; a run that crosses the midpoint m of the smallest such stretch that
holds it is found there. With F(j) the words that follow j as they follow m, and G(j) those that precede j as they precede m
(both inside the stretch), the words around m and j repeat with period |m - j| for F(j) + G(j) words, so it is a run where
that is as much as the period. F is the Z-function of the words from m on, G that of the words before m read backwards.

A run worth reporting has F + G of 6 words or more, so F or G of 3 or more: places whose next (or last) three words differ from
those at m need no Z value. Which places are left, and how far they match within STEP words, is found for all midpoints of a
level at once; where a match goes on, the midpoint's Z values are computed in order with a Z box, so that no word is
compared over and over and the time is n log n whatever the text.

What is found is maximal if the words just outside break the period; a run cut off by its stretch is found whole at a midpoint
further up. Equal intervals keep their smallest period.

Null and empty texts have no runs; a row without an id is treated like any other; repeated rows give repeated
results, an empty table an empty one; texts of any length are taken whole, in one task as they are one row; of further
columns, whatever their names, nothing is used.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a run at least, if twice its period is less.
LEAST = 12
#: Words that F or G has at least for any run of LEAST words: half of what both have together.
SEED = 3
#: Words compared at once when a match is extended, at first and at most.
STEP, MOST_STEP = 16, 1 << 16
#: Pairs whose next words are compared at once.
_PAIRS = 1 << 15


def common(x: np.ndarray, i: int, j: int, limit: int) -> int:
    """How many words from i on equal those from j on, limit at most."""
    n, step = 0, STEP
    while n < limit:
        w = min(step, limit - n)
        differ = x[i + n : i + n + w] != x[j + n : j + n + w]
        k = int(differ.argmax())
        if differ[k]:
            return n + k
        n, step = n + w, min(4 * step, MOST_STEP)
    return n


def z_values(x: np.ndarray, m: int, end: int, after: list[int], before: list[int]) -> dict[int, int]:
    """F(j) for the ascending places after m and before it, the only ones whose value is SEED or more."""
    z: dict[int, int] = {}
    for places in (after, before):
        left = right = 0
        for j in places:
            known = max(0, right - j)
            if known >= SEED and z[m + j - left] < known:
                z[j] = z[m + j - left]
                continue
            limit = end - max(j, m)
            known += common(x, m + known, j + known, limit - known)
            z[j] = known
            if j + known > right:
                left, right = j, j + known
    return z


def _seeds(x: np.ndarray) -> np.ndarray:
    """A number for the SEED words from each place on; different words may share one, which costs time alone."""
    out = x.astype(np.uint64)
    for k in range(1, SEED):
        out[:-k] = out[:-k] * np.uint64(0x9E3779B97F4A7C15) + x[k:].astype(np.uint64)
    return out


def _level(seeds: np.ndarray, half: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The midpoints of a level, and for each the places at most reach away that have its seed."""
    n = -(-len(seeds) // (2 * half)) * 2 * half
    grid = np.concatenate([seeds, np.arange(n - len(seeds), dtype=np.uint64) + np.uint64(1 << 62)]).reshape(-1, 2 * half)
    same = grid[:, half - reach : half + reach] == grid[:, half : half + 1]
    same[:, reach] = False
    row, column = np.nonzero(same)
    return row * 2 * half + half, row * 2 * half + column + half - reach


def _near(x: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """common() for many pairs, STEP at most."""
    out = np.zeros(len(i), np.int64)
    for a in range(0, len(i), _PAIRS):
        k = np.arange(STEP)
        inside = k < limit[a : a + _PAIRS, None]
        last = len(x) - 1
        same = inside & (x[np.minimum(i[a : a + _PAIRS, None] + k, last)] == x[np.minimum(j[a : a + _PAIRS, None] + k, last)])
        out[a : a + _PAIRS] = np.where(same.all(1), STEP, same.argmin(1))
    return out


def find_runs(x: np.ndarray, start: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, smallest period), in order, of the runs of several texts.

    Text k is x[start[k] : start[k + 1] - 1]; the number that follows it occurs nowhere else."""
    if least < 2 * SEED:
        raise ValueError(f"runs have at least {2 * SEED} words")
    n = len(x)
    longest = int(np.diff(start).max(initial=1)) - 1
    if longest < least:
        return np.zeros((0, 3), np.int64)
    back = x[::-1].copy()
    seeds = _seeds(x)
    ending = np.concatenate([np.arange(SEED, dtype=np.uint64) + np.uint64(1 << 63), seeds])[:n]  # the SEED words before each place
    found, half = [np.zeros((0, 3), np.int64)], 1 << max(1, (least // 2).bit_length() - 2)
    while half < n:
        reach = min(half, longest)
        m, j = np.divmod(np.unique(np.concatenate([(m * n + j)[(m < n) & (j < n)] for m, j in (_level(s, half, reach) for s in (seeds, ending))])), n)
        text = np.searchsorted(start, m, "right") - 1
        inside = (start[text] <= j) & (start[text] < m) & (np.maximum(m, j) < start[text + 1] - 1)
        m, j, text = m[inside], j[inside], text[inside]
        low, high = np.maximum(m - reach, start[text]), np.minimum(m + reach, start[text + 1] - 1)
        ahead, behind = high - np.maximum(m, j), np.minimum(m, j) - low
        after, before = _near(x, m, j, ahead), _near(back, n - m, n - j, behind)
        # matches that go on: the Z-functions of their midpoints
        on = np.unique(m[((after == STEP) & (ahead > STEP)) | ((before == STEP) & (behind > STEP))])
        for mid, a, b in zip(on.tolist(), np.searchsorted(m, on).tolist(), np.searchsorted(m, on, "right").tolist()):
            own, seen, met = j[a:b], after[a:b] >= SEED, before[a:b] >= SEED
            z = z_values(x, mid, int(high[a]), own[seen & (own > mid)].tolist(), own[seen & (own < mid)].tolist())
            after[a:b][seen] = [z[k] for k in own[seen].tolist()]
            mirrored = (n - own)[::-1]
            z = z_values(back, n - mid, n - int(low[a]), mirrored[met[::-1] & (mirrored > n - mid)].tolist(), mirrored[met[::-1] & (mirrored < n - mid)].tolist())
            before[a:b][met] = [z[k] for k in (n - own[met]).tolist()]
        period = np.abs(m - j)
        runs = np.flatnonzero(after + before >= np.maximum(period, least - period))
        found.append(np.column_stack([np.minimum(m, j)[runs] - before[runs], np.maximum(m, j)[runs] + after[runs], period[runs]]))
        half *= 2
    s, e, p = np.concatenate(found).T
    # what a text's first or last word bounds is maximal too: the numbers around a text match nothing
    outside = np.where(s > 0, x[s - 1], -1)
    whole = (outside != x[s - 1 + p]) & (x[e] != x[e - p])
    s, e, p = s[whole], e[whole], p[whole]
    order = np.lexsort((p, e, s))
    s, e, p = s[order], e[order], p[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    out = np.column_stack([s, e - s, p])[first]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of(texts: list[str | None], least: int = LEAST) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """The runs of each text, counted from its own first word, and each text's words without the repeats."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    words = [t.encode().split() if t else [] for t in texts]
    start = np.cumsum([0, *(len(w) + 1 for w in words)])
    x = np.empty(int(start[-1]), np.int64)
    for k, w in enumerate(words):
        x[start[k] : start[k + 1] - 1] = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
        x[start[k + 1] - 1] = -2 - k
    found = find_runs(x, start, least)
    dropped = np.zeros(len(x) + 1, np.int64)
    np.add.at(dropped, found[:, 0] + found[:, 2], 1)
    np.add.at(dropped, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(dropped)[:-1] == 0
    own = np.searchsorted(start, found[:, 0], "right") - 1
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (s, n, p) in zip(own.tolist(), found.tolist()):
        runs[k].append((s - int(start[k]), n, p))
    left = [b" ".join(compress(w, kept[start[k] : start[k + 1] - 1].tolist()) if runs[k] else w).decode() for k, w in enumerate(words)]
    return runs, left


#: Bytes of text after which the runs of what was read are searched.
BATCH_TEXT = 1 << 21
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row (id_col, runs, collapsed): its runs by start, then period, as (start, length, period) in words,
    and its words, joined by one space, without those that repeat what stands a period before them in a run."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = 0, 0
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for k, n in enumerate(lengths):
                size += n
                if size >= BATCH_TEXT or k + 1 == len(lengths):
                    part = batch.slice(at, k + 1 - at)
                    runs, left = runs_of(part.column(1).to_pylist(), least)
                    flat = [r for own in runs for r in own]
                    each = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(3)], fields=list(RUN))
                    listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), each)
                    yield pa.RecordBatch.from_arrays([part.column(0), listed, pa.array(left, pa.string())], ["id", "runs", "collapsed"])
                    size, at = 0, k + 1

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, f"id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_col)


def with_planted_run(doc_id: Column, text: Column) -> Column:
    """The text with its words from some place on repeating, for one in ten ids; others, and texts without words, as they are.

    With h the unsigned crc32 of the decimal id and g = floor(h / 10): where h % 10 = 0, each word from a = g % n on becomes
    that at a + (i - a) % p, where p = 1 + floor((n - a) / (3 + g % 8)). A null id has no h."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))

    def planted(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        times = F.ceil((n - a) / p).cast("int")
        return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a.cast("int")), F.flatten(F.array_repeat(tail, times))), F.lit(1), n.cast("int")), " ")

    # the words are cut once, inside the branch that needs them
    made = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(text)), 1)
    return F.when((h % 10 == 0) & text.isNotNull(), made).otherwise(text)


def digests(docs: DataFrame) -> DataFrame:
    """Per document its number of runs, the longest of them and digests, of the texts with planted runs."""
    planted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), with_planted_run(F.col("doc_id"), F.col("text").cast("string")).alias("text"))
    found = periodic_runs(planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))
    start, period = -F.col("top.start"), -F.col("top.period")
    return out.select("doc_id", "n_runs", start.alias("start"), F.col("top.length").alias("length"), period.alias("period"), F.floor(1000 * F.col("top.length") / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
