"""Splitting strategies: recursive, table-aware and by pattern, as one flat map over sections.

A section is cut where it stands: a task reads sections in Arrow batches and gives one row a section and
strategy with its chunks as an array. No shuffle, and all strategies of a section in one pass.
"""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

log = logging.getLogger(__name__)
_TOKEN = re.compile(r"\w+|[^\s\w]")
STRATEGIES = ("recursive_600", "recursive_1100", "table_aware", "llm_regex")


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Which characters of the first plane belong to words, and which are marks, as _TOKEN has it."""
    plane = "".join(map(chr, range(1 << 16)))
    out = np.zeros((2, 1 << 16), bool)
    for k, pattern in enumerate((r"\w", r"[^\s\w]")):
        out[k, [m.start() for m in re.finditer(pattern, plane)]] = True
    return out[0], out[1]


def token_places(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The text's characters as numbers, and at which of them a word or mark begins; None beyond the first plane."""
    codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    if len(codes) != len(text):
        return None
    words, marks = _kinds()
    own = words[codes]
    begins = marks[codes]
    begins[:1] |= own[:1]
    begins[1:] |= own[1:] & ~own[:-1]
    return codes, begins


def count_tokens(text: str) -> int:
    if len(text) > 256 and (places := token_places(text)) is not None:
        return int(np.count_nonzero(places[1]))
    return len(_TOKEN.findall(text))


class _Lengths(dict):
    """Lengths of the texts asked for so far."""

    def __init__(self, length: Callable[[str], int]):
        self.length = length

    def __missing__(self, text: str) -> int:
        n = self[text] = self.length(text)
        return n


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in what `length` counts: words and marks, or the tokens of a model, by a function that workers can import or unpickle.

    `strategies` adds to the built-in ones, or replaces them, by name: functions of text, config and pattern that give chunks."""

    small_size: int = 600
    small_overlap: int = 60
    large_size: int = 1100
    large_overlap: int = 110
    min_tokens: int = 80
    separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")
    pipe_share: float = 0.5
    pattern_min_tokens: int = 300
    length: Callable[[str], int] = count_tokens
    strategies: tuple[tuple[str, Callable[[str, ChunkConfig, str | None], list[str]]], ...] = ()

    def __post_init__(self):
        if self.small_overlap >= self.small_size or self.large_overlap >= self.large_size:
            raise ValueError("an overlap must be smaller than its chunk")


def cut(text: str, separator: str, size: int) -> list[str]:
    """Pieces that end with the separator, blank ones dropped; without a separator slices of a quarter of the size."""
    if not separator:
        step = max(1, size // 4)
        return [text[k : k + step] for k in range(0, len(text), step)]
    *heads, last = text.split(separator)
    return [p for p in (*(h + separator for h in heads), last) if p.strip()]


def pieces(text: str, size: int, separators: tuple[str, ...], length: Callable[[str], int] = count_tokens) -> Iterator[str]:
    """Pieces of at most that size, in order, cut at the first separator that makes them small enough."""
    todo = [(text, 0)]
    while todo:
        own, level = todo.pop()
        if length(own) <= size:
            yield own
            continue
        separator = separators[level] if level < len(separators) else ""
        todo.extend((p, level + 1) for p in reversed(cut(own, separator, size)))


def pack(parts: Iterator[str], size: int, overlap: int, length: Callable[[str], int] = count_tokens) -> Iterator[str]:
    """Chunks filled up to the size; a new one begins with the last whole parts of the one before, as far as the overlap allows."""
    held: list[tuple[str, int]] = []
    total = 0
    for part in parts:
        n = length(part)
        if held and total + n > size:
            yield "".join(p for p, _ in held).strip()
            keep, tail = len(held), 0
            while keep and tail + held[keep - 1][1] <= overlap:
                keep -= 1
                tail += held[keep][1]
            held = [*held[keep:], (part, n)]
            total = length("".join(p for p, _ in held))
        else:
            held.append((part, n))
            total += n
    if held:
        yield "".join(p for p, _ in held).strip()


def glue_small(chunks: Iterator[str], least: int, length: Callable[[str], int] = count_tokens) -> list[str]:
    """Chunks below the least size go to the one before, after a newline; the first one may be small."""
    out: list[str] = []
    for c in chunks:
        if not c.strip():
            continue
        if out and length(c) < least:
            out[-1] += "\n" + c
        else:
            out.append(c)
    return [c.strip() for c in out]


def recursive(text: str, size: int, overlap: int, config: ChunkConfig) -> list[str]:
    if not text.strip():
        return []
    return glue_small(pack(pieces(text.strip(), size, config.separators, config.length), size, overlap, config.length), config.min_tokens, config.length)


def is_table_row(line: str, share: float) -> bool:
    own = line.strip()
    return bool(own) and (re.fullmatch(r"\|[-:| ]+\|", own) is not None or ("|" in own and own.count("|") / len(own) >= share))


def table_blocks(text: str, share: float) -> list[tuple[str, bool]]:
    """Runs of lines that are all table rows or all not; blank runs dropped."""
    out: list[tuple[list[str], bool]] = []
    for line in text.splitlines():
        kind = is_table_row(line, share)
        if out and out[-1][1] == kind:
            out[-1][0].append(line)
        else:
            out.append(([line], kind))
    return [(block, kind) for ls, kind in out if (block := "\n".join(ls)).strip()]


def table_aware(text: str, config: ChunkConfig) -> list[str]:
    """Tables whole up to twice the size, prose between them recursively."""
    out: list[str] = []
    for block, is_table in table_blocks(text, config.pipe_share):
        if not is_table:
            out += recursive(block, config.large_size, config.large_overlap, config)
        elif config.length(block) <= 2 * config.large_size:
            out.append(block.strip())
        else:
            out += [s.strip() for s in re.split(r"\n{2,}", block) if s.strip()]
    return out or recursive(text, config.large_size, config.large_overlap, config)


def valid_pattern(pattern: str | None) -> bool:
    if not pattern or len(pattern.strip()) < 2:
        return False
    try:
        return re.compile(pattern).match("") is None
    except re.error:
        return False


def split_by_pattern(text: str, pattern: str) -> list[str]:
    """Pieces that end with what matched, stripped, blank ones dropped. Groups within the pattern count as pieces too."""
    parts = [p or "" for p in re.split(f"({pattern})", text)]
    joined = ("".join(parts[k : k + 2]).strip() for k in range(0, len(parts), 2))
    return [p for p in joined if p] or [text.strip()]


def without_fences(answer: str) -> str:
    """A model's answer without the code fences around it."""
    return re.sub(r"\n?```$", "", re.sub(r"^```[a-z]*\n?", "", answer.strip())).strip()


def find_pattern(ask: Callable[[str], str], prompt: str, attempts: int = 2, pause: float = 0.5) -> str | None:
    """The first valid pattern of the model's answers to the prompt; None if no attempt gives one."""
    for k in range(attempts):
        try:
            pattern = without_fences(ask(prompt) or "")
            if valid_pattern(pattern):
                return pattern
            log.warning("no pattern to split by in attempt %d: %r", k + 1, pattern[:80])
        except Exception as e:
            log.warning("attempt %d to get a pattern failed: %s: %s", k + 1, type(e).__name__, e)
        if k + 1 < attempts:
            time.sleep(pause)
    return None


PATTERN_TOKENS = 3000
PATTERN_PROMPT = (
    "Item {item} ({title}, {kind}, {tokens} tokens) of an annual report begins below. Give one regular expression that matches where "
    "it should be cut, after numbered parts or where prose and figures change, and nothing else.\n\n{text}"
)


def with_patterns(sections: DataFrame, make: Callable[[], object], attempts: int = 2, pause: float = 0.5, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Adds `pattern`, asked of a provider with a method propose(prompt) for each section long enough to be worth it; null where none is valid."""
    tokens = X.token_count(F.col("text"))
    own = lambda c, t: F.coalesce(F.col(c).cast(t), F.lit("")) if c in sections.columns else F.lit("")
    prompt = F.lit(PATTERN_PROMPT)
    for name, value in (("item", own("item_number", "string")), ("title", own("item_title", "string")), ("kind", own("section_type", "string")), ("tokens", tokens.cast("string")), ("text", X.truncate_tokens(F.col("text"), PATTERN_TOKENS))):
        prompt = F.replace(prompt, F.lit("{%s}" % name), value)
    asked = sections.withColumn("prompt", F.when(tokens >= config.pattern_min_tokens, prompt))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for batch in batches:
            prompts = batch.column(batch.schema.get_field_index("prompt"))
            found = pa.array([find_pattern(provider.propose, x.as_py(), attempts, pause) if x.is_valid else None for x in prompts], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k, n in enumerate(batch.schema.names) if n != "prompt"), found], [*(n for n in batch.schema.names if n != "prompt"), "pattern"])

    return asked.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sections.schema) + ", pattern string")


def pattern_chunks(text: str, pattern: str | None, config: ChunkConfig) -> list[str]:
    """By a pattern from a provider; short sections and bad patterns fall back to the small recursive strategy."""
    if config.length(text) < config.pattern_min_tokens or not valid_pattern(pattern):
        return recursive(text, config.small_size, config.small_overlap, config)
    out: list[str] = []
    for piece in split_by_pattern(text, pattern):
        n = config.length(piece)
        if n > 2 * config.large_size:
            out += recursive(piece, config.large_size, config.large_overlap, config)
        elif n < config.min_tokens and out:
            out[-1] += "\n" + piece
        else:
            out.append(piece)
    return [c.strip() for c in out if c.strip()] or recursive(text, config.small_size, config.small_overlap, config)


def _small(text: str, config: ChunkConfig, pattern: str | None) -> list[str]:
    return recursive(text, config.small_size, config.small_overlap, config)


#: The built-in strategies; a config may have others beside them.
BUILT_IN: dict[str, Callable[[str, ChunkConfig, str | None], list[str]]] = {
    "recursive_600": _small,
    "recursive_1100": lambda text, config, pattern: recursive(text, config.large_size, config.large_overlap, config),
    "table_aware": lambda text, config, pattern: table_aware(text, config),
    "llm_regex": lambda text, config, pattern: pattern_chunks(text, pattern, config),
}


def run_strategy(name: str, text: str, config: ChunkConfig, pattern: str | None = None) -> list[str]:
    """Unknown names use the small recursive strategy; a text that gives nothing is one chunk."""
    return (BUILT_IN | dict(config.strategies)).get(name, _small)(text, config, pattern) or [text.strip()]


def candidates(section_type: Column, table_density: Column, tokens: Column, use_pattern: bool = True, pattern_min_tokens: int = 300) -> Column:
    """Strategies worth running for a section, in the order that breaks ties."""
    return F.array_compact(F.array(
        F.lit("recursive_600"), F.lit("recursive_1100"),
        F.when(section_type.isin("financial_table", "mixed") | (table_density >= 0.10), "table_aware"),
        F.when(F.lit(use_pattern) & (tokens >= pattern_min_tokens), "llm_regex"),
    ))


def chunk_sections(sections: DataFrame, key: str = "doc_id", config: ChunkConfig = ChunkConfig(), pattern: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """sections: key, text, strategies (an array). Gives key, strategy, ord (its place), chunks (an array), and the columns to carry.

    A column `pattern` of the sections goes before the pattern given for all."""
    kept = [F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]
    pattern_of = F.col("pattern") if "pattern" in sections.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names, places, made = [], [], [], []
            for k, (text, wanted, told) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                text = text.as_py()
                if text and text.strip():
                    # the strategies of a section count many of the same pieces
                    own = replace(config, length=_Lengths(config.length).__getitem__)
                    for place, name in enumerate(wanted or ()):
                        rows.append(k)
                        names.append(name)
                        places.append(place)
                        made.append(run_strategy(name, text, own, told or pattern))
            back = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(back), pa.array(names, pa.string()), pa.array(places, pa.int32()), pa.array(made, pa.list_(pa.string())), *(c.take(back) for c in batch.columns[4:])], ["key", "strategy", "ord", "chunks", *(f"c{k}" for k in range(len(carry)))])

    kinds = "".join(f", c{k} {sections.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    out = sections.select(F.col(key).alias("key"), "text", "strategies", pattern_of.alias("pattern"), *kept).mapInArrow(run, f"key {sections.schema[key].dataType.simpleString()}, strategy string, ord int, chunks array<string>{kinds}")
    return out.withColumnsRenamed({"key": key, **{f"c{k}": c for k, c in enumerate(carry)}})


def separator_pieces(docs: DataFrame, separator: str, size: int = 600, key: str = "doc_id") -> DataFrame:
    """key, i, piece: each text cut once at the separator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [cut(x.as_py() or "", separator, size) for x in batch.column(1)]
            back = pa.array([k for k, own in enumerate(made) for _ in own], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(back), pa.array([i for own in made for i in range(len(own))], pa.int32()), pa.array([p for own in made for p in own], pa.string())], [key, "i", "piece"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, i int, piece string")


def table_islands(docs: DataFrame, key: str = "doc_id", text: str = "text", pipe_share: float = 0.5) -> DataFrame:
    """The same runs of lines as table_blocks, as rows: key, block, is_table, first_line, n_lines."""
    each = docs.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    own = X.strip(F.col("line"))
    pipes = F.length(own) - F.length(F.replace(own, F.lit("|"), F.lit("")))
    flag = (own != "") & (own.rlike(r"^\|[-:| ]+\|$") | ((pipes > 0) & (pipes / F.length(own) >= pipe_share)))
    w = W.partitionBy(key).orderBy("i")
    runs = each.withColumn("t", flag).withColumn("new", F.coalesce((F.col("t") != F.lag("t").over(w)).cast("int"), F.lit(1))).withColumn("block", F.sum("new").over(w))
    return runs.groupBy(key, "block").agg(F.first("t").alias("is_table"), F.min("i").alias("first_line"), F.count("*").alias("n_lines"), F.max((X.strip(F.col("line")) != "").cast("int")).alias("full")).filter("full = 1").drop("full")


def groups_of_lines(text: Column, n: Column) -> Column:
    """The text's lines in groups of n, as an array; the text is split once, not once a group."""
    cut = lambda lines: F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / n).cast("int")), lambda k: F.array_join(F.slice(lines, k * n + 1, n), "\n"))
    return X.once(F.split(text, "\n"), cut)


def line_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    """A plain chunking for comparison across engines: n lines each. key, chunk_index, chunk, total."""
    groups = docs.select(key, groups_of_lines(F.col(text), F.lit(n)).alias("groups"))
    return groups.select(key, F.size("groups").alias("total"), F.posexplode("groups").alias("chunk_index", "chunk"))


def is_table_chunk(text: Column) -> Column:
    """Two of five lines or more have a bar."""
    own = X.lines(text)
    bars = F.filter(own, lambda x: x.contains("|"))
    return F.coalesce(F.try_divide(F.size(bars), F.nullif(F.size(own), F.lit(0))) >= 0.4, F.lit(False))


def materialise(chunked: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of chunks with ids and their own signals; blank chunks are skipped but keep their index and count in the total."""
    each = chunked.select(key, "strategy", F.size("chunks").alias("total_chunks_in_section"), F.posexplode("chunks").alias("chunk_index", "text")).filter(X.strip(F.col("text")) != "")
    named = each.join(sections.select(key, "ticker", "fiscal_year", "item_number"), key)
    return named.withColumns({
        "chunk_id": X.chunk_id(F.col("ticker"), F.col("fiscal_year"), F.col("item_number"), F.col("chunk_index")),
        "token_count": X.token_count(F.col("text")),
        "numerical_density": F.round(X.numerical_density(F.col("text")), 4),
        "is_table_chunk": is_table_chunk(F.col("text")),
    })
