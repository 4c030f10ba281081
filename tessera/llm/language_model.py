"""Language-model scores by deleted interpolation.

A word's probability after another is a mixture of maximum-likelihood estimates: the bigram's share of
its context, the word's share of all words, and an even share. The weights depend on how often the context was
seen (buckets of its count's logarithm). They are learned by expectation-maximisation on held-out counts:
for documents of one fold of the training data, every count is taken without the document itself.

Counts of words and bigrams go through exchange.py: exact sums over the whole corpus, answered to the batches
of texts that ask, so the model is never in one place. To the driver come only the numbers of tokens and types and
a histogram of the held-out estimates (bins of a quarter of an octave), both bounded.

Text: A-Z lower-cased; words are runs without ASCII white space; then one end, a token. The first word's context is
a begin mark, seen once a document. Null and empty texts are just the end. Documents of the held-out remainder teach
nothing. A null doc_id counts as the empty text in the split. Repeated rows each count. An empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import answered, answers, batch_count, mixed, part_count, request_table, requests, word_hashes
from .runtime import staged

END, BEGIN = np.uint64(0x1F0E1D0C0B0A0908), np.uint64(0x2B3C4D5E6F708192)
FOLDS, HELD_OUT, EM_FOLD = 10, 0, 1
BUCKETS = 24
EM_ROUNDS = 60
STEPS = 4
NEVER = -(1 << 14)
_48 = np.uint64((1 << 48) - 1)


def _tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, each text with its end, and where each begins (and the last ends)."""
    each = []
    for x in texts:
        h = word_hashes(x.as_py())
        each.append(np.concatenate([h, [END]]) if len(h) else np.array([END]))
    at = np.concatenate([[0], np.cumsum([len(h) for h in each])]).astype(np.int64)
    return np.concatenate(each) if each else np.zeros(0, np.uint64), at


def _bigrams(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context of each token, and a 48-bit key of the pair."""
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[at[:-1]] = BEGIN
    return context, mixed(mixed(context) + tokens) & _48


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place among them of every key."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = own[1:] != own[:-1]
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return own[new], at


def _asked(table: pa.Table):
    """A batch's keys and counts: what `ask` sends and the later passes look up, in the same order."""
    tokens, at = _tokens(table["text"])
    context, pair = _bigrams(tokens, at)
    train = np.repeat(np.array(table["fold"].to_pylist()) != HELD_OUT, np.diff(at))
    words, word_at = _places(np.concatenate([tokens, [BEGIN]]))
    pairs, pair_at = _places(pair)
    return tokens, at, context, train, words, word_at[:-1], pairs, pair_at


def _requests(batch: tuple, table: pa.Table, parts: int) -> pa.Table:
    tokens, at, context, train, words, word_at, pairs, pair_at = _asked(table)
    n_words = np.bincount(word_at[train], minlength=len(words))
    # the begin mark is no token, but as a context it is seen once a training document
    n_words[np.searchsorted(words, BEGIN)] = int(train[at[:-1]].sum())
    n_pairs = np.bincount(pair_at[train], minlength=len(pairs))
    rows = [*requests(batch[0].as_py(), words, n_words, parts, 0, 64), *requests(batch[0].as_py(), pairs, n_pairs, parts, parts)]
    return request_table(rows)


class Counts:
    """For each token of a batch: counts of it, its context and the pair, over all training documents."""

    def __init__(self, table: pa.Table, told: pa.Table, parts: int):
        self.tokens, self.at, self.context, self.train, words, word_at, pairs, pair_at = _asked(table)
        n_words = answered(told, 0, parts).astype(np.int64)
        self.word = n_words[word_at]
        context_at = np.empty_like(word_at)
        context_at[1:] = word_at[:-1]
        context_at[self.at[:-1]] = np.searchsorted(words, BEGIN)
        self.before = n_words[context_at]
        self.pair = answered(told, parts, 2 * parts).astype(np.int64)[pair_at]
        self.keys = word_at, context_at, pair_at


def bucket(context_count: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(context_count + 1)).astype(np.int64), BUCKETS - 1)


def _step(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.rint(STEPS * np.log2(np.where(p > 0, p, 1))), NEVER).astype(np.int64)


def _share(n: np.ndarray, of: np.ndarray | float) -> np.ndarray:
    return np.where(np.asarray(of) > 0, n / np.maximum(of, 1), 0.0)


def held_out_bins(table: pa.Table, told: pa.Table, parts: int, total: int) -> pa.Table:
    """(bucket, pair, word, n): how many held-out tokens have estimates of these logarithms, their document left out."""
    found = []
    if table.num_rows:
        c = Counts(table, told, parts)
        for a, b in zip(c.at[:-1], c.at[1:]):
            own = []
            for k in c.keys:
                _, back, n = np.unique(k[a:b], return_inverse=True, return_counts=True)
                own.append(n[back])
            # the document's own count of a context: how often it is a context in it
            before = c.before[a:b] - own[1]
            found.append(np.stack([bucket(before), _step(_share(c.pair[a:b] - own[2], before)), _step(_share(c.word[a:b] - own[0], total - (b - a)))]))
    rows, n = np.unique(np.concatenate(found, 1), axis=1, return_counts=True) if found else (np.zeros((3, 0), np.int64), np.zeros(0, np.int64))
    return pa.table([pa.array(x, pa.int64()) for x in (*rows, n)], ["bucket", "pair", "word", "n"])


def learn_weights(bins: np.ndarray, even: float) -> np.ndarray:
    """Expectation-maximisation: BUCKETS rows of weights for (pair, word, even). bins: rows of (bucket, pair, word, n).

    Buckets without held-out tokens take the weights of the nearest lower bucket that has some."""
    weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    for b in range(BUCKETS):
        own = bins[bins[:, 0] == b] if len(bins) else bins
        if not len(own):
            if b:
                weights[b] = weights[b - 1] if b > 1 else weights[0]
            continue
        p = np.stack([*(np.where(own[:, k] == NEVER, 0.0, 2.0 ** (own[:, k] / STEPS)) for k in (1, 2)), np.full(len(own), even)], 1)
        # one word in a thousand of weight stays with each estimate, so that no text gets probability 0
        w = np.array([0.4, 0.5, 0.1]) if p[:, 0].any() else np.array([0.0, 0.9, 0.1])
        for _ in range(EM_ROUNDS):
            part = p * w
            part /= part.sum(1, keepdims=True)
            w = (part * own[:, 3:]).sum(0) / own[:, 3].sum()
        w = np.maximum(w, [0.0, 1e-3, 1e-3])
        weights[b] = w / w.sum()
    weights[0] = [0.0, *(weights[0][1:] / weights[0][1:].sum())]
    return weights


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_batch(table: pa.Table, told: pa.Table, parts: int, total: int, types: int, weights: np.ndarray) -> pa.Table:
    names = [x.split(" ")[0] for x in SCORED.split(", ")]
    if not table.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
    c = Counts(table, told, parts)
    base = np.log10((c.word + 0.1) / (total + 0.1 * (types + 1)))
    w = weights[bucket(c.before)]
    p = w[:, 0] * _share(c.pair, c.before) + w[:, 1] * _share(c.word, total) + w[:, 2] / (types + 1)
    # a context never seen has no pairs: its share goes to the other two
    score = np.log10(p)
    add = lambda x: np.add.reduceat(x, c.at[:-1])
    held = np.array(table["fold"].to_pylist()) == HELD_OUT
    n = len(held)
    return pa.table([table["doc_id"], pa.array(held), pa.array(np.diff(c.at)), pa.array(add((c.word > 0).astype(np.int64))), pa.array(np.full(n, total, np.int64)), pa.array(add(base)), pa.array(add(score))], names)


def score_documents(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS)).cast("int")
    batches, parts = batch_count(own), part_count(own)
    few = max(1, batches // FOLDS)
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.octet_length("text").cast("long"))), F.lit(1 << 30))
    # the fold for the weights has batches of its own, so that its pass reads no other text
    batch = F.when(F.col("fold") == EM_FOLD, F.pmod(place, F.lit(few))).otherwise(few + F.pmod(place, F.lit(batches))).cast("int")
    texts = own.withColumn("fold", fold).withColumn("batch", batch)
    learning = texts.filter(F.col("fold") == EM_FOLD)

    asked = texts.groupBy("batch").applyInArrow(lambda key, t: _requests(key, t, parts), "part int, batch int, lo binary, hi binary, n binary")
    told = staged(answers(asked), "counts", "lz4")
    # keys with training counts and their sums, of the words alone; the begin mark is not a word
    sums = told.filter((F.col("batch") == -1) & (F.col("part") < parts)).agg(F.sum("keys"), F.sum("total")).first()
    trained = texts.filter(F.col("fold") != HELD_OUT).select("doc_id").count()
    types, total = (sums[0] or 0) - (1 if trained else 0), (sums[1] or 0) - trained
    told = told.filter("batch >= 0").select("batch", "part", "n")

    bins = learning.groupBy("batch").cogroup(told.filter(F.col("batch") < few).groupBy("batch")).applyInArrow(lambda a, b: held_out_bins(a, b, parts, total), "bucket long, pair long, word long, n long")
    found = [tuple(r) for r in bins.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).collect()]
    weights = learn_weights(np.array(found, np.float64).reshape(-1, 4), 1.0 / (types + 1))
    # the counts are written, so nothing can need the shuffled requests again; their files go when the references are cleared
    del bins, asked
    spark.sparkContext._jvm.System.gc()
    return texts.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(lambda a, b: score_batch(a, b, parts, total, types, weights), SCORED)
