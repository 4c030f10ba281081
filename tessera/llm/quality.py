"""Quality rules: plain counts, then divergence from what the document's language looks like.

References are learned from the whole corpus: for each language the share of every character class and of
its most common words (all other words are one bin). A document is held against its language's reference
by the Jensen-Shannon distance (base 2, so from 0 to 1) of both histograms. Copies and near copies of one
text together weigh no more in a reference than the longest of them or MAX_SHARE of the language's distinct
text, whichever is more; they are known by SKETCHES smallest hashes of their stretches. Short documents are judged by
the base rules alone: a histogram of few characters or words diverges by chance (MIN_CHARS, MIN_WORDS).
Languages with fewer than MIN_REFERENCE words, null among them, have no reference and are judged by the base rules
alone too. The references of the LANGUAGES largest go to the tasks as they are, those of all others by a join.

Null and empty texts have no words and fail the base rules. Equal rows get equal verdicts. An empty table
gives no rows. Columns other than doc_id, text and lang are ignored; a missing lang column counts as null.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import WORD, released, staged

_WORD = re.compile(WORD)
_LETTERS = re.compile(r"[^\W\d_]+")
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "letter", "mark", "digit", "space", "punctuation", "symbol", "other")
#: Stands for the number of words among the classes of characters.
TOTAL = "words"
#: Words of a language's histogram, and languages whose references come to the driver; the others' are joined.
COMMON_WORDS, LANGUAGES = 100, 512
MIN_REFERENCE = 2_000
MIN_CHARS, MIN_WORDS = 200, 60
#: Largest distances: a constant, and what chance adds to a histogram of n, as 1 / sqrt(n).
MAX_CHARS_DISTANCE, MAX_WORDS_DISTANCE = (0.17, 2.0), (0.20, 2.7)
#: What a group of copies may weigh in a reference, as a share of the language's characters with each group once.
MAX_SHARE = 0.01
#: Smallest hashes by which near copies are known, and the bytes (white space apart) of the stretches hashed.
SKETCHES, STRETCH = 4, 24
#: Bytes hashed at a time, and groups of copies up to which their weights are broadcast.
SKETCH_BLOCK, BROADCAST_GROUPS = 1 << 16, 100_000
#: Distinct words that a task counts before it passes them on.
FLUSH_WORDS = 300_000
WINDOW = 8


def _class_table() -> np.ndarray:
    kinds = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "M": 3, "N": 4, "Z": 5, "P": 6, "S": 7, "C": 8}
    table = np.empty(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        table[c] = kinds.get(k, kinds.get(k[0], 8))
    table[9:14] = 5
    for c in SYMBOLS:
        table[ord(c)] = 7
    return table


_TABLE: list[np.ndarray] = []


def char_classes(text: str) -> np.ndarray:
    """Characters of each class."""
    if not _TABLE:
        _TABLE.append(_class_table())
    return np.bincount(_TABLE[0][np.frombuffer(text.encode("utf-32-le"), "<u4")], minlength=len(CLASSES))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence to base 2 of two histograms."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


_RNG = np.random.default_rng(8)
_MIX = _RNG.integers(1, 2**63, WINDOW, np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list[str]) -> int:
    """Words in windows of eight that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        mixed = (ids + np.uint64(1)) * _SPREAD
        mixed ^= mixed >> np.uint64(29)
        h = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            h += mixed[k : k + n] * _MIX[k]
    order = np.argsort(h, kind="stable")
    equal = h[order][1:] == h[order][:-1]
    if not equal.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][equal]] = maybe[order[:-1][equal]] = True
    where = defaultdict(list)
    for i in np.flatnonzero(maybe).tolist():
        where[ids[i : i + WINDOW].tobytes()].append(i)
    step = np.zeros(len(words) + 1, np.int64)
    for at in where.values():
        if len(at) > 1:
            step[at] += 1
            step[np.array(at) + WINDOW] -= 1
    return int((np.cumsum(step[:-1]) > 0).sum())


def dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


@dataclass
class Reference:
    chars: np.ndarray
    words: dict[str, int]
    counts: np.ndarray


@dataclass
class References:
    by_lang: dict[str | None, Reference] = field(default_factory=dict)
    #: (lang, total, rows) of the languages that are not in by_lang; None if there are none.
    others: DataFrame | None = None


_ODD = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_ODD, k, 1 << 64) for k in range(SKETCH_BLOCK + STRETCH)], np.uint64)
_INVERSE = np.array([pow(pow(_ODD, -1, 1 << 64), k, 1 << 64) for k in range(SKETCH_BLOCK)], np.uint64)


def sketch(text: str) -> list[int]:
    """The smallest hash of the text's stretches for each of SKETCHES hashes: near copies share most of them."""
    data = np.frombuffer(text.lower().encode().translate(None, b" \t\n\x0b\x0c\r").ljust(STRETCH, b"\0"), np.uint8)
    best = [(1 << 64) - 1] * SKETCHES
    with np.errstate(over="ignore"):
        for at in range(0, len(data) - STRETCH + 1, SKETCH_BLOCK):
            part = data[at : at + SKETCH_BLOCK + STRETCH - 1].astype(np.uint64) + np.uint64(1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _POWERS[: len(part)], dtype=np.uint64)])
            h = (sums[STRETCH:] - sums[:-STRETCH]) * _INVERSE[: len(sums) - STRETCH]
            h ^= h >> np.uint64(32)
            for k in range(SKETCHES):
                mixed = h * _MIX[k]
                mixed ^= mixed >> np.uint64(29)
                best[k] = min(best[k], int((mixed * _SPREAD).min()))
    return best


def _sketched(docs: DataFrame, text: bool) -> DataFrame:
    """(text, lang, chars, keys) of documents with a text: a key for each sketch, apart by language and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(t.as_py()) for t in batch.column(0)]
            found = pa.array([np.array(x, np.uint64).view(np.int64).tolist() for x in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[0 if text else 1 :], found], [*batch.schema.names[0 if text else 1 :], "sketches"])
        released()

    known = docs.filter("text <> ''").select("text", "lang", F.length("text").cast("long").alias("chars"))
    out = known.mapInArrow(run, ("text string, " if text else "") + "lang string, chars long, sketches array<long>")
    keys = F.array(*(F.xxhash64("lang", F.lit(k), F.col("sketches")[k]) for k in range(SKETCHES)))
    return out.select(*(["text"] if text else []), "lang", "chars", keys.alias("keys"))


def weighted(docs: DataFrame) -> DataFrame:
    """(text, lang, weight) of documents with a text; weight is under 1 in a group of copies above its bound."""
    each = _sketched(docs, False).select(F.posexplode("keys").alias("k", "key"), "lang", "chars").select(F.xxhash64("lang", "k").alias("whose"), "key", "chars")
    groups = staged(each.groupBy("whose", "key").agg(F.sum("chars").alias("chars"), F.max("chars").alias("longest")), "op4-groups")
    whole = groups.groupBy("whose").agg(F.sum("longest").alias("whole"))
    bound = F.greatest("longest", F.floor(MAX_SHARE * F.col("whole")))
    heavy = staged(groups.filter("chars > longest").join(whole, "whose").filter(F.col("chars") > bound).select("key", (bound / F.col("chars")).alias("weight")), "op4-heavy")
    n = heavy.count()
    if not n:
        return docs.filter("text <> ''").select("text", "lang", F.lit(1.0).alias("weight"))
    out = _sketched(docs, True)
    for k in range(SKETCHES):
        own = heavy.select(F.col("key").alias(f"key{k}"), F.col("weight").alias(f"weight{k}"))
        out = out.withColumn(f"key{k}", F.col("keys")[k]).join(F.broadcast(own) if n <= BROADCAST_GROUPS else own, f"key{k}", "left")
    return out.select("text", "lang", F.least(F.lit(1.0), *(f"weight{k}" for k in range(SKETCHES))).alias("weight"))


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, kind, key, n): characters by class and words of (text, lang, weight), summed by weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str | None, float], tuple[np.ndarray, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, weight), (chars, words) in held.items():
                keys, n = [*CLASSES, TOTAL, *words], [weight * x for x in (*chars.tolist(), words.total(), *words.values())]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([k <= len(CLASSES) for k in range(len(keys))]), pa.array(keys, pa.string()), pa.array(n, pa.float64())], ["lang", "chars", "key", "n"])
            held.clear()

        for batch in batches:
            for text, whose in zip(batch.column(0), zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if text := text.as_py():
                    if whose not in held:
                        held[whose] = np.zeros(len(CLASSES), np.int64), Counter()
                    held[whose][0][:] += char_classes(text)
                    held[whose][1].update(_LETTERS.findall(text.lower()))
            if sum(len(w) for _, w in held.values()) > FLUSH_WORDS:
                yield from flush()
        yield from flush()
        released()

    return docs.mapInArrow(run, "lang string, chars boolean, key string, n double").groupBy("lang", "chars", "key").agg(F.sum("n").alias("n"))


def _reference(total: float, rows: list, common_words: int) -> Reference:
    """Of the counts of a language, rows of (chars, key, n)."""
    chars = np.zeros(len(CLASSES))
    for r in rows:
        if r["chars"] and r["key"] != TOTAL:
            chars[CLASSES.index(r["key"])] = r["n"]
    words = sorted(((r["key"], r["n"]) for r in rows if not r["chars"]), key=lambda x: (-x[1], x[0]))[:common_words]
    return Reference(chars, {w: k for k, (w, _) in enumerate(words)}, np.array([*(m for _, m in words), total - sum(m for _, m in words)]))


def _among(column: str, langs: Iterable[str | None]) -> Column:
    """Whether the language is one of langs, null among them or not."""
    known = F.coalesce(F.col(column).isin([x for x in langs if x is not None]), F.lit(False))
    return known | F.col(column).isNull() if None in langs else known


def learn(docs: DataFrame, common_words: int = COMMON_WORDS) -> References:
    """At most common_words + 10 rows a language come to the driver, for at most LANGUAGES languages; the rest stay a table."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    found = _counts(weighted(docs.select(F.col("text").cast("string").alias("text"), lang.alias("lang"))))
    best = W.partitionBy("lang", "chars").orderBy(F.desc("n"), "key")
    top = found.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= max(common_words, len(CLASSES) + 1))
    words_of = F.max(F.when(F.col("chars") & (F.col("key") == TOTAL), F.col("n"))).alias("total")
    each = staged(top.groupBy("lang").agg(words_of, F.collect_list(F.struct("chars", "key", "n")).alias("rows")).filter(F.col("total") >= MIN_REFERENCE), "op4-references")
    out = References({r["lang"]: _reference(r["total"], r["rows"], common_words) for r in each.orderBy(F.desc("total"), "lang").limit(LANGUAGES).collect()})
    if len(out.by_lang) == LANGUAGES:
        others = each.filter(~_among("lang", out.by_lang))
        out.others = None if others.isEmpty() else others.withColumn("common", F.lit(common_words))
    return out


def distances(text: str, ref: Reference | None) -> tuple[float | None, float | None, bool]:
    """Of character classes and common words, and whether one is too large.

    None where the guard of length or a missing reference forbids a judgement."""
    if ref is None:
        return None, None, False
    a = b = None
    far = False
    if len(text) >= MIN_CHARS:
        a = js_distance(char_classes(text), ref.chars)
        far = a > MAX_CHARS_DISTANCE[0] + MAX_CHARS_DISTANCE[1] / len(text) ** 0.5
    words = _LETTERS.findall(text.lower())
    if len(words) >= MIN_WORDS:
        get, rest = ref.words.get, len(ref.words)
        b = js_distance(np.bincount([get(w, rest) for w in words], minlength=rest + 1), ref.counts)
        far = far or b > MAX_WORDS_DISTANCE[0] + MAX_WORDS_DISTANCE[1] / len(words) ** 0.5
    return a, b, far


JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, js_chars double, js_words double"


def measure(text: str | None, ref: Reference | None) -> tuple:
    text = text or ""
    words = _WORD.findall(text)
    n, repeats = len(words), repeat_words(words)
    failed = n < 20 or 100 * repeats > 30 * n
    a, b, far = distances(text, ref)
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup_lines(text), repeats, failed, not failed and not far, a, b


def judge(docs: DataFrame, refs: References, carry: list[str]) -> DataFrame:
    """The columns named in carry, then those of JUDGED, one row a document."""

    by_lang, kinds = refs.by_lang, [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def measured(batch: pa.RecordBatch, found: list[Reference | None], at: int) -> pa.RecordBatch:
        rows = [measure(t.as_py(), ref) for t, ref in zip(batch.column(0), found)]
        cols = list(zip(*rows)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([*batch.columns[at:], *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield measured(batch, [by_lang.get(x) for x in batch.column(1).to_pylist()], 2)
        released()

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, Reference | None] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for k, lang in enumerate(langs):
                if lang not in held:
                    ref = batch.column(2)[k].as_py()
                    held[lang] = _reference(ref["total"], ref["rows"], ref["common"]) if ref else None
            yield measured(batch, [held[x] for x in langs], 3)
            if len(held) > LANGUAGES:
                held.clear()

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    out = [x.strip().split(" ")[0] for x in JUDGED.split(",")]
    names = [*(f"c{k}" for k in range(len(carry))), *out]
    schema = ", ".join([*(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry)), JUDGED])
    view = docs.select(F.col("text").cast("string").alias("of_text"), lang.alias("of_lang"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)))
    if refs.others is None:
        made = view.mapInArrow(run, schema)
    else:
        own = refs.others.select(F.col("lang").alias("ref_lang"), F.struct("total", "rows", "common").alias("ref"))
        held_here = _among("of_lang", by_lang)
        joined = view.filter(~held_here).join(own, F.col("of_lang").eqNullSafe(F.col("ref_lang")), "left").select("of_text", "of_lang", "ref", *names[: len(carry)])
        made = view.filter(held_here).mapInArrow(run, schema).unionAll(joined.mapInArrow(run_joined, schema))
    return made.withColumnsRenamed({f"c{k}": c for k, c in enumerate(carry) if c not in out})


def quality(docs: DataFrame) -> DataFrame:
    """doc_id and JUDGED for every document, with references learned from all of them."""
    return judge(docs, learn(docs), ["doc_id"])


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    own = docs.columns
    safe = docs.toDF(*(f"own{k}" for k in range(len(own))))
    view = safe.withColumns({"text": F.col(f"own{own.index('text')}"), **({"lang": F.col(f"own{own.index('lang')}")} if "lang" in own else {})})
    return judge(view, learn(docs), safe.columns).filter("kept").select(*(F.col(f"own{k}").alias(c) for k, c in enumerate(own)))
