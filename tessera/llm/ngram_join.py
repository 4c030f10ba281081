"""Exact n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Rows of the incidence are documents, columns five-word shingles. The product of the incidence with its
transpose holds the overlaps of all pairs; bounds on size keep almost all of it from being made:

1. Equal texts are one row, under a number of its own; numbers are in the order of the smallest doc_id of each text.
2. A column with one document adds to no overlap. Columns are counted over the whole corpus (exchange.py);
   a row with more than its slack of such columns (20 of 100, from 100 * overlap >= 80 * union) has no partner.
3. The other rows are ordered by the rest of their columns; only its first columns, as many as the slack leaves,
   can be where a row first meets a partner. Rows that meet there are joined into candidate groups by
   chains, one edge a row, never all pairs.
4. A group is cut into blocks by size class (a partner is at most 1.25 times as large) and bounded numbers
   of rows and columns; each pair of blocks that sizes allow is one product: overlaps of a row with all
   others are summed from the columns' row lists, pairs below the bound are dropped. A block pair gives a
   spanning forest of its links and each row's number of links, not the links.
5. Components of the links' forests give component_id.

Shingles are held as 64-bit hashes. Words: runs without ASCII white space, A-Z lower-cased. Fewer than five
words are one shingle; null, empty and blank texts have none and link with nothing, not even with
each other. A doc_id may occur with several texts: each is joined for itself. Rows without a doc_id are joined like others and come
back with a null component. A repeated row is repeated in the result; repeats beyond a few
hundred of one id and text are one row before texts are dealt out.
A very long text is one row of the incidence, its columns in one array. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import KEY_BITS, answered, answers, batch_count, batch_of, distinct, forget_words, part_count, request_table, requests, runs, word_hashes
from .graph import components
from .runtime import HOT_ROWS, discard, hot_join, released, staged

SHINGLE = 5
#: A link: 100 * overlap >= PERCENT * union.
PERCENT = 80
#: Shingles of the rows of a block, and rows.
BLOCK_SHINGLES, BLOCK_ROWS = 1_500_000, 8_192
#: Columns are counted by the first KEY_BITS of their hash; two that share them are at worst taken for more frequent.
_SHORT = np.uint64(64 - KEY_BITS)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes."""
    h = word_hashes(text)
    return distinct(runs(h, min(SHINGLE, len(h)))) if len(h) else h


def needed(n: int) -> int:
    """Least overlap of a set of that size with any partner: 100 * overlap >= PERCENT * n."""
    return -(-PERCENT * n // 100)


def _sets(table: pa.Table, keys: dict[tuple, int]) -> dict[int, np.ndarray]:
    """The batch's rows, each text class once; keys: the numbers of classes by the id and hashes of the row that stands for them."""
    out: dict[int, np.ndarray] = {}
    for *named, text in zip(*(table[c].to_pylist() for c in NAMED), table["text"]):
        key = keys.get(tuple(named))
        if key is not None and key not in out:
            out[key] = shingles(text.as_py())
    return out


#: What tells a row's text class from others of its id.
NAMED = ("doc_id", "h1", "h2", "h3")
ROWS = "key long, n_shingles long, cols binary, meets array<long>"


def incidence_rows(texts: DataFrame, firsts: DataFrame, parts: int) -> DataFrame:
    """ROWS for every class in firsts (key, NAMED, batch); cols and meets only of those that may have a partner."""
    known = lambda t: dict(zip(zip(*(t[c].to_pylist() for c in NAMED)), t["key"].to_pylist()))

    def ask(batch: tuple, table: pa.Table, own: pa.Table) -> pa.Table:
        sets = _sets(table, known(own)) if table.num_rows else {}
        if not sets:
            return request_table([])
        keys = np.sort(np.concatenate([s >> _SHORT for s in sets.values()]))
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        out = request_table(requests(batch[0].as_py(), keys[at], np.diff(at, append=len(keys)), parts))
        del sets, keys, at
        forget_words()
        released()
        return out

    def rows(batch: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if table.num_rows and told.num_rows:
            sets = _sets(table, known(told.filter(pc.is_valid(told["key"]))))
            # every row's columns get the counts of the batch's sorted distinct columns
            every = np.concatenate([s >> _SHORT for s in sets.values()]) if sets else np.zeros(0, np.uint64)
            order = np.argsort(every, kind="stable")
            new = np.zeros(len(every), np.int64)
            new[1:] = every[order][1:] != every[order][:-1]
            df = answered(told.filter(pc.is_valid(told["part"])), 0, parts, "u1")
            often = np.zeros(len(every), bool)
            often[order] = df[np.cumsum(new)] > 1 if len(every) else False
            del every, order, new, df
            at = 0
            for d, s in sets.items():
                shared, at = often[at : at + len(s)], at + len(s)
                slack = len(s) - needed(len(s)) - int(len(s) - shared.sum())
                if len(s) and slack >= 0:
                    out.append((d, len(s), s.astype("<u8").tobytes(), s[shared][: slack + 1].astype(np.int64).tolist()))
                else:
                    out.append((d, len(s), None, None))
            del sets, often
        cols = list(zip(*out)) or [[]] * 4
        made = pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))], ["key", "n_shingles", "cols", "meets"])
        del out, cols
        forget_words()
        released()
        return made

    asked = texts.groupBy("batch").cogroup(firsts.groupBy("batch")).applyInArrow(ask, "part int, batch int, lo binary, hi binary, n binary")
    none = lambda **kinds: [F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    told = answers(asked, most=2).filter("batch >= 0").select("batch", "part", "n", *none(key="long", doc_id="long", h1="long", h2="long", h3="int"))
    own = firsts.select("batch", *none(part="int", n="binary"), "key", *NAMED)
    return texts.groupBy("batch").cogroup(told.union(own).groupBy("batch")).applyInArrow(rows, ROWS)


def product(sets: list[np.ndarray], side: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links between rows, and each row's number of links.

    side is 0 and 1 for rows of two blocks, of which only pairs across count, or all 0 for one block. A row's overlaps
    are summed from the row lists of its columns, later rows alone; links are joined by whole components."""
    size = np.array([len(s) for s in sets])
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    by_col = np.argsort(col, kind="stable")
    rows_of, start = row[by_col].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(col))])
    # where each entry stands in its column's list: the rows after it are the later ones
    place = np.empty(len(col), np.int64)
    place[by_col] = np.arange(len(col))
    left = start[col + 1] - place - 1
    at = np.concatenate([[0], np.cumsum(size)])
    across = bool(side.any())
    component, edges, links = np.arange(len(sets)), [], np.zeros(len(sets), np.int64)
    for i in range(len(sets)):
        own = slice(at[i], at[i + 1])
        n, a = left[own], place[own] + 1
        total = int(n.sum())
        if not total:
            continue
        met = rows_of[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)]
        if 8 * total < len(sets):
            j, overlap = np.unique(met, return_counts=True)
        else:
            every = np.bincount(met, minlength=len(sets))
            j = np.flatnonzero(every)
            overlap = every[j]
        ok = 100 * overlap >= PERCENT * (size[i] + size[j] - overlap)
        if across:
            ok &= side[j] != side[i]
        j = j[ok]
        if not len(j):
            continue
        links[i] += len(j)
        links[j] += 1
        others, first = np.unique(component[j], return_index=True)
        for c, k in zip(others.tolist(), j[first].tolist()):
            if c != component[i]:
                edges.append((i, k))
                component[component == c] = component[i]
    return edges, links


LINKS = "u long, v long, links long"


def link_rows(rows: DataFrame) -> DataFrame:
    """(u, v) edges of forests that span the links; rows with a null v carry a number of links of u."""
    meets = rows.filter("meets is not null").select(F.explode("meets").alias("h"), "key")
    hubs = staged(meets.groupBy("h").agg(F.min("key").alias("hub"), F.max("key").alias("other"), F.count("*").alias("rows_of")).filter("hub <> other").select("h", "hub", "rows_of"), "hubs")
    # the chain: each row of a column goes to the column's smallest row
    groups = components(hot_join(meets, hubs, ["h"]).select(F.col("key").alias("u"), F.col("hub").alias("v")))
    cls = F.floor(F.log("n_shingles") / F.log(F.lit(1.25))).cast("int")
    cand = rows.filter("cols is not null").join(groups.withColumnRenamed("node", "key"), "key").select("root", "key", "n_shingles", "cols", cls.alias("cls"))
    cand = staged(cand, "rows", "lz4")
    size = cand.groupBy("root", "cls").agg(F.sum("n_shingles").alias("all"), F.count("*").alias("rows_of"))
    size = staged(size.select("root", "cls", "rows_of", F.ceil(F.greatest(F.col("all") / BLOCK_SHINGLES, F.col("rows_of") / BLOCK_ROWS)).cast("int").alias("b")), "sizes")
    up = size.select("root", (F.col("cls") + 1).alias("cls"), F.col("b").alias("below"))
    down = size.select("root", (F.col("cls") - 1).alias("cls"), F.col("b").alias("above"))
    plan = size.join(up, ["root", "cls"], "left").join(down, ["root", "cls"], "left")
    dealt = hot_join(cand, plan, ["root", "cls"]).withColumn("blk", F.pmod(F.xxhash64("key"), F.col("b")).cast("int"))
    # a row stands in every product of its block: with blocks of its own class, of the class above and of the one below
    same = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda j: F.struct(F.col("cls").alias("c"), F.least(F.col("blk"), j).alias("i"), F.greatest(F.col("blk"), j).alias("j"), F.lit(0).alias("kind"), (F.col("blk") > j).cast("int").alias("side")))
    over = F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda j: F.struct(F.col("cls").alias("c"), F.col("blk").alias("i"), j.alias("j"), F.lit(1).alias("kind"), F.lit(0).alias("side")))
    under = F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda j: F.struct((F.col("cls") - 1).alias("c"), j.alias("i"), F.col("blk").alias("j"), F.lit(1).alias("kind"), F.lit(1).alias("side")))
    kind = "array<struct<c:int,i:int,j:int,kind:int,side:int>>"
    none = F.array().cast(kind)
    products = F.concat(same.cast(kind), F.coalesce(over.cast(kind), none), F.coalesce(under.cast(kind), none))
    each = dealt.select("root", "key", "cols", F.inline(products))

    def multiply(table: pa.Table) -> pa.Table:
        docs, side, kind = table["key"].to_pylist(), np.array(table["side"].to_pylist()), table["kind"][0].as_py()
        out: list[tuple] = []
        lone = kind == 1 or table["i"][0].as_py() != table["j"][0].as_py()
        if len(docs) > 1 and not (lone and side.min() == side.max()):
            sets = [np.frombuffer(x.as_py(), "<u8") for x in table["cols"]]
            edges, links = product(sets, side if lone else np.zeros(len(docs), int))
            out = [(docs[a], docs[b], 0) for a, b in edges] + [(docs[k], None, int(n)) for k, n in enumerate(links) if n]
            del sets
            released()
        cols = list(zip(*out)) or [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["u", "v", "links"])

    links = staged(each.groupBy("root", "c", "i", "j", "kind").applyInArrow(multiply, LINKS), "links")
    discard(hubs, cand, size)
    return links


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """NAMED of every row, and of every text: h1, h2, h3, rows_of, key, first (its smallest id), n_shingles, n_links, root (the smallest key it
    is linked with) and component_id."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = own.select("*", F.xxhash64("text").alias("h1"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("h2"), F.octet_length("text").alias("h3"))
    rows = staged(named.drop("text"), "classes")
    counted = rows.filter("h3 > 0").groupBy("h1", "h2", "h3").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows_of"))
    # numbers in the order of the first ids; classes without an id come last
    order = [F.col("first").asc_nulls_last(), "h1", "h2", "h3"]
    classes = staged(counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id()), "firsts")
    texts = named.filter("h3 > 0")
    if not rows.groupBy(*NAMED).count().filter(F.col("count") > HOT_ROWS).isEmpty():
        texts = texts.dropDuplicates(list(NAMED))
    dealt = lambda df, d: df.withColumn("batch", batch_of(F.struct(d, "h1"), batches))
    batches = batch_count(own)
    firsts = dealt(classes, "first").select("batch", "key", F.col("first").alias("doc_id"), "h1", "h2", "h3")
    incidence = staged(incidence_rows(dealt(texts, "doc_id"), firsts, part_count(own)), "incidence", "lz4")
    links = link_rows(incidence.filter("cols is not null"))
    roots = components(links.filter("v is not null").select("u", "v"))
    counts = links.filter("v is null").groupBy("u").agg(F.sum("links").alias("n_links"))
    of_class = incidence.select("key", "n_shingles").join(roots.withColumnRenamed("node", "key"), "key", "left").join(counts.withColumnRenamed("u", "key"), "key", "left")
    told = staged(classes.join(of_class, "key").withColumn("root", F.coalesce("root", "key")), "told")
    # a component is named by the first id of its smallest class
    of_root = classes.select(F.col("key").alias("root"), F.col("first").alias("component_id")).join(told.groupBy("root").agg(F.count("*").alias("rows_of")), "root")
    out = staged(hot_join(told, of_root, ["root"]), "named")
    discard(classes, incidence, links, told)
    return rows, out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document.

    n_links: representatives of other texts that this one links with."""
    rows, classes = _classes(docs)
    made = hot_join(rows, classes.select("h1", "h2", "h3", "rows_of", "n_shingles", "n_links", "component_id"), ["h1", "h2", "h3"], "left")
    n = F.coalesce("n_shingles", F.lit(0).cast("long"))
    return made.select("doc_id", n.alias("n_shingles"), F.when(n == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest id, with the columns it came with.

    Documents without words are no one's copies and all stay, as do those without an id; a row repeated with its text stays once."""
    own = docs.columns
    safe = docs.toDF(*(f"own{k}" for k in range(len(own))))
    id_, text = (f"own{own.index(c)}" for c in ("doc_id", "text"))
    rows, classes = _classes(docs.select("doc_id", "text"))
    # the classes that go, and of those that stay the id that stays
    told = classes.filter("n_shingles > 0 and first is not null and (key <> root or rows_of > 1)")
    gone = told.select("h1", "h2", "h3", F.when(F.col("key") == F.col("root"), F.col("first")).alias("stays"), "rows_of", F.lit(True).alias("told"))
    c = F.col(text).cast("string")
    hashed = safe.withColumns({"h1": F.xxhash64(c), "h2": F.crc32(F.encode(F.coalesce(c, F.lit("")), "UTF-8")), "h3": F.octet_length(c), "d": F.col(id_).cast("long")})
    kept = hot_join(hashed, gone, ["h1", "h2", "h3"], "left").filter("told is null or d is null or d <=> stays")
    if not rows.filter("doc_id is not null").groupBy(*NAMED).count().filter("count > 1").isEmpty():
        kept = kept.filter("told is null or d is null").unionByName(kept.filter("told and d is not null").dropDuplicates(["h1", "h2", "h3", "d"]))
    return kept.select(*(f"own{k}" for k in range(len(own)))).toDF(*own)


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, text, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents
),
s AS (SELECT doc_id, text, list_distinct(list_transform(range(greatest(len(w) - 4, least(len(w), 1))), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' '))) AS s FROM w),
sh AS (SELECT doc_id, unnest(s) AS x FROM s),
often AS (SELECT x FROM sh GROUP BY x HAVING count(*) > 1),
few AS (SELECT sh.doc_id, sh.x FROM sh JOIN often USING (x)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM few a JOIN few b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b, s1.text AS ta, s2.text AS tb FROM pairs JOIN s s1 ON s1.doc_id = a JOIN s s2 ON s2.doc_id = b WHERE 100 * n >= 80 * (len(s1.s) + len(s2.s) - n)),
e AS (SELECT a, b, ta, tb FROM link UNION ALL SELECT b, a, tb, ta FROM link),
r AS (SELECT doc_id AS d, doc_id AS c FROM s UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.c)
SELECT s.doc_id, len(s.s) AS n_shingles, (SELECT min(c) FROM r WHERE d = s.doc_id) AS component_id, (SELECT count(DISTINCT tb) FROM e WHERE e.a = s.doc_id AND ta <> tb) AS n_links FROM s
"""
