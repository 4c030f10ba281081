"""Eight quality metrics of a chunking, their weights, and the choice of the best strategy.

A chunking is a row with its section's text and an array of chunks; metrics are Columns over that row, or
come from one Arrow pass where they need embeddings or places of matches. Scoring needs no shuffle; choosing a winner is one
aggregation a section.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .chunking import count_tokens, token_places
from .names import Patterns

METRICS = ("icc", "dcc", "rc", "sc", "bi", "nds", "tbi", "sps")
# Weights of the metrics by the section's type.
WEIGHTS = {
    "narrative": dict(icc=0.25, dcc=0.20, rc=0.20, sc=0.15, bi=0.10, nds=0.05, tbi=0.02, sps=0.03),
    "financial_table": dict(icc=0.05, dcc=0.03, rc=0.01, sc=0.20, bi=0.25, nds=0.01, tbi=0.35, sps=0.10),
    "mixed": dict(icc=0.18, dcc=0.15, rc=0.10, sc=0.15, bi=0.15, nds=0.05, tbi=0.18, sps=0.04),
}
MIN_TOKENS, MAX_TOKENS = 80, 1200
TOLERANCE, FLOOR = 0.15, 0.02
REACH = 200
DIMENSIONS = 16


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), F.nullif(whole, F.lit(0))), F.lit(empty))


def _bounded(c: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 4)


def _spaced(c: Column) -> Column:
    return X.strip(F.regexp_replace(c, rf"[{X.SPACE}]+", " "))


def size_compliance(chunks: Column) -> Column:
    fit = F.filter(chunks, lambda c: X.token_count(c).between(MIN_TOKENS, MAX_TOKENS))
    return _share(F.size(fit), F.size(chunks), 0.0)


# List items, table rows, item headers, separators of tables.
LIST_ITEM, TABLE_ROW, ITEM_HEADER = r"(?m)^\s*[-*•]\s+\S|^\s*\d+\.\s+\S", r"(?m)^\s*\|.+\|\s*$", r"(?m)^\s*(?:Item\s+\d+[A-Z]?|ITEM\s+\d+[A-Z]?)"
DATA_ROW, SEPARATOR_ROW = r"(?m)^[ \t]*\|.+\|[ \t]*$", r"^\|[-:| ]+\|$"
ITEM_NUMBER = r"(?:^|\n)\s*(?:ITEM|Item)\s+(\d+[A-Za-z]?)\b"


def structural_blocks(c: Column) -> Column:
    """Paragraphs of twenty tokens or more, beginnings of list items, table rows and item headers."""
    strip = lambda a: F.transform(a, X.strip)
    paragraphs = F.filter(strip(F.split(c, r"\n{2,}")), lambda p: (p != "") & (X.token_count(p) >= 20))
    rest = F.concat(*(strip(F.regexp_extract_all(c, F.lit(p), 0)) for p in (LIST_ITEM, TABLE_ROW, ITEM_HEADER)))
    return X.once(paragraphs, lambda own: F.concat(own, F.array_except(F.array_distinct(F.filter(rest, lambda x: x != "")), own)))


def data_rows(c: Column) -> Column:
    """Rows of tables that are no separators."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(DATA_ROW), 0), X.strip), lambda r: ~r.rlike(SEPARATOR_ROW))


#: What the integrity of a section's chunkings is measured against, for a chunking to carry.
PARTS = ("_blocks", "_rows")


def with_parts(sections: DataFrame) -> DataFrame:
    """Adds a section's structural blocks and rows of tables, white space evened out: found once, before several strategies cut it."""
    spaced = lambda parts: F.transform(parts, _spaced)
    return sections.withColumns({"_blocks": spaced(structural_blocks(F.col("text"))), "_rows": spaced(data_rows(F.col("text")))})


def with_integrity(chunked: DataFrame) -> DataFrame:
    """Adds bi and tbi: the shares of structural blocks, and of rows of tables, that stand whole in some chunk; white space is evened out.

    All blocks and rows of a section are looked for at once, so a chunk is read once however many there are. Those that `with_parts` has
    found are taken, and left out of the result."""
    own = chunked if set(PARTS) <= set(chunked.columns) else with_parts(chunked)
    chunked = chunked.drop(*PARTS)
    kept = chunked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the chunkings of a section follow each other, and share many chunks
        told, among, known = None, None, {}
        for batch in batches:
            shares = []
            for blocks, rows, chunks in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*PARTS, "chunks"))):
                blocks, rows, chunks = blocks or [], rows or [], chunks or []
                if told != (blocks, rows):
                    told, among, known = (blocks, rows), Patterns([*blocks, *rows]), {}
                for c in chunks:
                    if c not in known:
                        # white space of Python's split is that of text.SPACE
                        known[c] = among.found_in(" ".join(c.split()))
                found = set().union(*(known[c] for c in chunks))
                shares.append([0.0 if not chunks else _clipped(sum(p in found for p in parts) / len(parts)) if parts else 1.0 for parts in (blocks, rows)])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *(pa.array([x[k] for x in shares], pa.float64()) for k in range(2))], [*kept, "bi", "tbi"])

    return own.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunked.schema) + ", bi double, tbi double")


def density_spread(target: Column, chunks: Column) -> Column:
    def one(c: Column) -> Column:
        return X.once(F.abs(X.numerical_density(c) - target), lambda off: F.when(off <= TOLERANCE, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - (off - TOLERANCE) / TOLERANCE)))

    total = F.aggregate(F.transform(chunks, one), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(chunks) == 0, 0.0).when(target < FLOOR, 1.0).otherwise(_bounded(_share(total, F.size(chunks), 0.0)))


def section_purity(item: Column, chunks: Column) -> Column:
    own = F.upper(X.strip(item))

    def pure(c: Column) -> Column:
        headers = F.regexp_extract_all(c, F.lit(ITEM_NUMBER), 1)
        return F.forall(headers, lambda h: F.upper(h) == own)

    return _bounded(_share(F.size(F.filter(chunks, pure)), F.size(chunks), 0.0))


# What counts as a mention and as a word that refers back to one.
_ENTITY = re.compile(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*|[A-Z]{2,}|\$[\d,.]+[BMK]?|\d+\.?\d*\s*%)\b")
_PRONOUN = re.compile(r"\b(it|its|they|their|them|this|these|those|such|the company|the firm|the group)\b", re.I)


@lru_cache(1)
def _references(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where mentions begin and end, and where words that refer back begin; the chunkings of a section follow each other."""
    return np.array([m.span() for m in _ENTITY.finditer(text)]).reshape(-1, 2), np.array([m.start() for m in _PRONOUN.finditer(text)])


def reference_share(text: str, chunks: list[str]) -> float:
    """Share of mentions and nearby references back to them that the chunking leaves in one chunk.

    Places map to chunks by the lengths of the chunks before, one character apart."""
    if len(chunks) <= 1:
        return 1.0
    mentions, back = _references(text)
    if not len(mentions) or not len(back):
        return 1.0
    # references within reach of each mention are a range of the sorted places
    lo, hi = np.searchsorted(back, mentions[:, 1], "left"), np.searchsorted(back, mentions[:, 1] + REACH, "right")
    lengths = np.array([len(c) for c in chunks])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])

    def chunk_of(at):
        k = np.searchsorted(starts, at, "right") - 1
        inside = at < starts[np.minimum(k, len(chunks) - 1)] + lengths[np.minimum(k, len(chunks) - 1)]
        return np.where((k < len(chunks)) & inside, k, len(chunks) - 1)

    near = hi - lo
    total = int(near.sum())
    # the references of one mention after the other
    at = np.arange(total) + np.repeat(lo - np.cumsum(near) + near, near)
    broken = int((chunk_of(back)[at] != np.repeat(chunk_of(mentions[:, 0]), near)).sum())
    return _clipped(float(1.0 - broken / total)) if total else 1.0


#: Marks of where a sentence and a chunk end, while many are read at once.
_STOP, _END = "\x01", "\x02"


class TermBins:
    """The offline embedder: counts of the text's terms in DIMENSIONS bins by a digest of the term."""

    class _Bins(dict):
        def __missing__(self, term: str) -> int:
            if len(self) > 200_000:
                self.clear()
            b = self[term] = -1 if term in (_STOP, _END) else hashlib.md5(term.encode()).digest()[0] % DIMENSIONS
            return b

    def __init__(self):
        self.bins = self._Bins()

    def bin(self, term: str) -> int:
        return self.bins[term]

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        return [np.bincount(list(map(self.bins.__getitem__, terms(text))), minlength=DIMENSIONS).astype(float) if text else np.zeros(DIMENSIONS) for text in texts]

    def sentences(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Vectors of chunks and of their sentences of more than three tokens, as embed gives them, and each sentence's chunk; all in one
        pass over the chunks. None where the texts have characters that the pass needs or can't place.

        No term or token crosses the white space between sentences, so a chunk's counts are the sums of its sentences'."""
        joined = "".join([c.strip() + _END for c in chunks])
        if _STOP in joined or joined.count(_END) != len(chunks):
            return None
        joined = _SENTENCE.sub(_STOP, joined)
        places = token_places(joined)
        if places is None:
            return None
        codes, counts = places
        ends = np.flatnonzero((codes == ord(_STOP)) | (codes == ord(_END)))
        # both marks are tokens themselves
        tokens = np.diff(np.cumsum(counts)[ends], prepend=0) - 1
        told = np.array([self.bins[t] for t in _MARKED.findall(_plain(joined).lower())], np.int64)
        sentence = np.cumsum(told < 0) - (told < 0)
        each = np.bincount(sentence[told >= 0] * DIMENSIONS + told[told >= 0], minlength=len(ends) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(float)
        last = codes[ends] == ord(_END)
        of = np.cumsum(last) - last
        whole = np.add.reduceat(each, np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]))
        return whole, each[tokens > 3], of[tokens > 3]


class Remembered:
    """An embedder that embeds each text of a section once, however many strategies and metrics ask for it."""

    def __init__(self, embedder):
        self.embedder, self.section, self.known, self.close = embedder, None, {}, {}
        # an embedder with an embed of its own is asked for each text
        self.joint = isinstance(embedder, TermBins) and type(embedder).embed is TermBins.embed

    def of(self, section: str) -> Remembered:
        if section != self.section:
            self.section, self.known, self.close = section, {}, {}
        return self

    def closeness(self, chunks: list[str]) -> list[float]:
        """How close each chunk's sentences are to it on average; 1 with fewer than two."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.close]
        told = self.embedder.sentences(new) if new and self.joint else None
        if told is not None:
            whole, each, of = told
            self.known.update(zip(new, whole))
            lengths = np.sqrt(np.einsum("ij,ij->i", each, each)) * np.sqrt(np.einsum("ij,ij->i", whole, whole))[of]
            products = np.einsum("ij,ij->i", each, whole[of])
            shares = np.divide(products, lengths, out=np.zeros(len(of)), where=lengths > 0).tolist()
            ends = np.searchsorted(of, np.arange(len(new) + 1)).tolist()
            self.close.update((c, sum(shares[a:b]) / (b - a) if b - a > 1 else 1.0) for c, a, b in zip(new, ends, ends[1:]))
        else:
            self.close.update((c, self._one(c)) for c in new)
        return [self.close[c] for c in chunks]

    def _one(self, chunk: str) -> float:
        own = [s for s in _SENTENCE.split(chunk.strip()) if count_tokens(s) > 3]
        if len(own) < 2:
            return 1.0
        whole, *each = (np.asarray(v, float) for v in self.embed([chunk, *own]))
        each = np.array(each)
        lengths, products = np.sqrt(np.einsum("ij,ij->i", each, each)) * math.sqrt(float(whole @ whole)), each @ whole
        return sum((p / n if n > 0 else 0.0) for p, n in zip(products.tolist(), lengths.tolist())) / len(own)

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        new = [t for t in dict.fromkeys(texts) if t not in self.known]
        if new:
            self.known.update(zip(new, (np.asarray(v, float) for v in self.embedder.embed(new))))
        return [self.known[t] for t in texts]


_ITEM, _AMOUNT, _TERM = re.compile(rf"(?ai)\b(item)[{re.escape(X.BLANKS)}]+(\d+[a-zA-Z]?)\b"), re.compile(r"\$[\d,]+", re.A), re.compile(r"[\w$%.]{2,}|\$")
_MARKED = re.compile(rf"{_TERM.pattern}|[{_STOP}{_END}]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _plain(text: str) -> str:
    """Items joined to their numbers, amounts without commas."""
    if "item" in text.lower():
        text = _ITEM.sub(r"item_\2", text)
    if "$" in text and "," in text:
        text = _AMOUNT.sub(lambda m: m[0].replace(",", ""), text)
    return text


def terms(text: str) -> list[str]:
    """What text.tokenise does, for one text."""
    return _TERM.findall(_plain(text).lower())


def _clipped(x: float) -> float:
    return math.floor(max(0.0, min(1.0, x)) * 10_000 + 0.5) / 10_000


def cohesion(chunks: list[str], embedder) -> float:
    """Mean over chunks of how close a chunk's sentences are to it; without an embedder 1."""
    if embedder is None:
        return 1.0
    total = 0.0
    for x in (embedder if isinstance(embedder, Remembered) else Remembered(embedder)).closeness(chunks):
        total += x
    return _clipped(total / len(chunks)) if chunks else 0.0


def coherence(chunks: list[str], embedder) -> float:
    """Mean closeness of neighbours; one chunk alone, or no embedder, gives 1."""
    if embedder is None or len(chunks) < 2:
        return 1.0
    v = np.array([np.asarray(x, float) for x in embedder.embed(chunks)])
    lengths = np.sqrt(np.einsum("ij,ij->i", v, v))
    both = lengths[:-1] * lengths[1:]
    near = np.divide(np.einsum("ij,ij->i", v[:-1], v[1:]), both, out=np.zeros(len(both)), where=both > 0)
    return _clipped(sum(near.tolist()) / (len(v) - 1))


def with_text_metrics(chunked: DataFrame, embed: Callable[[], object] | None = TermBins) -> DataFrame:
    """Adds rc, icc and dcc in one pass: what places of matches or vectors of texts decide. embed makes the embedder of a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = Remembered(embed()) if embed else None
        for batch in batches:
            found = []
            for t, c in zip(batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("chunks"))):
                text, own = t.as_py() or "", c.as_py() or []
                told = embedder and embedder.of(text)
                found.append((reference_share(text, own), cohesion(own, told), coherence(own, told)))
            cols = list(zip(*found)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.float64()) for c in cols)], [*batch.schema.names, "rc", "icc", "dcc"])

    return chunked.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunked.schema) + ", rc double, icc double, dcc double")


def plain_metrics(chunked: DataFrame) -> DataFrame:
    """Adds the metrics that need no model."""
    chunks = F.col("chunks")
    return with_integrity(chunked).withColumns({"sc": F.round(size_compliance(chunks), 4), "nds": density_spread(F.col("numerical_density"), chunks), "sps": section_purity(F.col("item_number"), chunks)})


def score(chunked: DataFrame, embed: Callable[[], object] | None = TermBins) -> DataFrame:
    """chunked: text, chunks, item_number, section_type, numerical_density (of the section). Adds the metrics and total."""
    scored = plain_metrics(with_text_metrics(chunked, embed))
    return scored.withColumn("total", weighted_total(F.col("section_type")))


def weighted_total(section_type: Column) -> Column:
    sums = {t: sum((F.col(m) * w for m, w in weights.items()), F.lit(0.0)) for t, weights in WEIGHTS.items()}
    return _bounded(F.when(section_type == "financial_table", sums["financial_table"]).when(section_type == "mixed", sums["mixed"]).otherwise(sums["narrative"]))


def winners(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each section the strategy with the best total, then the fewest chunks, then the earlier candidate."""
    rank = F.struct("total", -F.size("chunks"), -F.col("ord"))
    return scored.groupBy(key).agg(F.max_by(F.struct("strategy", "total", "chunks"), rank).alias("w")).select(key, "w.strategy", F.col("w.total").alias("chunking_score"), "w.chunks")


def with_fallback(won: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections without any scored strategy keep their text as one chunk, scored 0."""
    return sections.select(key, "text").join(won, key, "left").select(key, F.coalesce("strategy", F.lit("recursive_600")).alias("strategy"), F.coalesce("chunking_score", F.lit(0.0)).alias("chunking_score"), F.coalesce("chunks", F.array(X.strip(F.col("text")))).alias("chunks"))


def competition(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every strategy of a section with its total and whether it won; sections are scored once, and their texts and chunks stay where they are."""
    told = scored.select(key, "strategy", "ord", "total", F.size("chunks").alias("n_chunks"))
    rank = F.struct("total", -F.col("n_chunks"), -F.col("ord"))
    packed = told.groupBy(key).agg(F.max_by("strategy", rank).alias("best"), F.collect_list(F.struct("strategy", "total", "n_chunks")).alias("each")).filter(F.col(key).isNotNull())
    return packed.select(key, "best", F.explode("each").alias("s")).select(key, "s.*", (F.col("s.strategy") == F.col("best")).alias("won"))
