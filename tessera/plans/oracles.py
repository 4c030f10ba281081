"""DuckDB SQL that gives the same rows as the library's queries."""

from __future__ import annotations

from ..functions import text as X
from ..operators import answers, chunk_quality, ingest, search

#: Beginnings of questions; they name two companies and a metric, a risk, one company, and so on.
ASKS = (
    "Compare Apple and Microsoft revenue", "What risk does JPMorgan face?", "Why did Exxon and Chevron grow", "goldman sachs outlook", "net income of Walmart", "pineapple", "legal trouble", "",
)
#: Companies of the documents in turn, the year that some questions are limited to, and the years for which filings are asked.
TICKERS = tuple(sorted(ingest.DEFAULT_CORPUS))
#: Lines of the chunks that compete.
LINE_COUNTS = (3, 5, 8)
YEAR_ASKED, FIRST_YEAR, LAST_YEAR = 2022, 1992, 1998


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(c: str, pairs, other: str = "NULL") -> str:
    return f"CASE {c} " + " ".join(f"WHEN {_q(str(k))} THEN {_q(v)}" for k, v in pairs) + f" ELSE {other} END"


# --- pieces ---

_strip = lambda x: f"trim({x}, {_q(X.BLANKS)})"
_toks = lambda x: f"list_filter(string_split_regex({x}, '[{X.SPACE}]+'), lambda t: t <> '')"
_lines = lambda x: f"list_filter(string_split({x}, chr(10)), lambda l: {_strip('l')} <> '')"
_count = lambda x: f"len(regexp_extract_all({x}, {_q(X.TOKEN)}))"
_num = lambda x: f"regexp_matches({x}, {_q(X.NUMERIC)})"
_density = lambda x: f"coalesce(len(list_filter({_toks(x)}, lambda t: {_num('t')}))::DOUBLE / nullif(len({_toks(x)}), 0), 0.0)"
_row = lambda l: f"(contains({l}, '|') OR (len({_toks(l)}) >= 3 AND {_num(l)}))"  # noqa: E731, E741
_tdensity = lambda x: f"coalesce(len(list_filter({_lines(x)}, lambda l: {_row('l')}))::DOUBLE / nullif(len({_lines(x)}), 0), 0.0)"


def _tokenise(x: str) -> str:
    t = f"regexp_replace({x}, '(?i)\\b(item)[{X.SPACE}]+(\\d+[a-zA-Z]?)\\b', 'item_\\2', 'g')"
    # commas go from what follows a dollar sign
    amount = "replace(regexp_extract(s, '^[0-9,]*'), ',', '') || regexp_replace(s, '^[0-9,]*', '')"
    t = f"list_reduce(list_transform(string_split({t}, '$'), lambda s, i: CASE WHEN i = 1 THEN s ELSE {amount} END), lambda a, s: a || '$' || s)"
    return f"list_filter(string_split(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_$%.]', ' ', 'g'), ' '), lambda x: length(x) > 1 OR starts_with(x, '$'))"


_ITEM = "CASE doc_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '1A' WHEN 2 THEN '7' ELSE '8' END"
_DEFAULT = _case("item_number", [(n, k) for _, n, _, k in ingest.ITEMS] + [("8", "financial_table")])
_TITLE = _case("item_number", [(n, t) for _, n, t, _ in ingest.ITEMS] + [("8", ingest.ITEM_8[1])])
SEC = f"sec AS (SELECT doc_id, upper(source) AS ticker, source AS company_name, (2020 + doc_id % 5)::INTEGER AS fiscal_year, {_ITEM} AS item_number, lang AS sector, text FROM documents WHERE {_strip('text')} <> '')"
SIG = f"""{SEC},
sig AS (
  SELECT *, {_DEFAULT} AS default_type, {_count('text')}::INTEGER AS token_count, round({_density('text')}, 4) AS numerical_density, round({_tdensity('text')}, 4) AS table_density FROM sec
),
typed AS (
  SELECT *, CASE WHEN item_number = '8' OR table_density >= 0.45 THEN 'financial_table'
    WHEN (table_density >= 0.2 OR numerical_density >= 0.15) AND default_type = 'narrative' THEN 'mixed' ELSE default_type END AS section_type FROM sig
)"""
_SENT = f"list_filter(string_split_regex(text, '[.!?]+'), lambda s: {_strip('s')} <> '')"

# --- search ---

BM25 = f"""
tok AS MATERIALIZED (SELECT doc_id AS pos, {_tokenise('text')} AS terms FROM documents),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)) AS mean FROM tok),
post AS MATERIALIZED (SELECT term, pos, count(*) AS tf, any_value(n) AS len FROM (SELECT pos, len(terms) AS n, unnest(terms) AS term FROM tok) GROUP BY term, pos),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, corpus),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN {search.EPSILON} * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


_PLAIN = "SELECT item_id AS query_id, text AS query FROM benchmark"


def _scores(asked: str = _PLAIN) -> str:
    return f"""{BM25},
ask AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_tokenise('query')}) AS term FROM ({asked})) GROUP BY query_id, term),
lex AS (
  SELECT query_id, pos, round(sum(times * idf * tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * len / mean))), 6) AS score
  FROM post JOIN ask USING (term) JOIN idf USING (term), corpus GROUP BY query_id, pos
)"""


def _top(source: str, k: int, within: str = "query_id", columns: str = "*") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {within} ORDER BY score DESC, pos) AS rank FROM {source}) WHERE rank <= {k}"


def _dense(queries: str) -> str:
    return f"""
vec AS (SELECT vec_id AS pos, embedding::DOUBLE[] AS v, label FROM embeddings),
den AS (SELECT q.pos AS query_id, x.pos, round(list_dot_product(q.v, x.v), 6) AS score FROM vec q, vec x WHERE {queries})"""


DENSE, DENSE_ASKED = _dense("q.pos % 100 = 0"), _dense("q.pos IN (SELECT item_id FROM benchmark)")

FUSED = f"""{_scores()},{DENSE_ASKED},
a AS ({_top("(SELECT * FROM lex WHERE score > 0)", 30)}), b AS ({_top("den", 30)})"""

_RRF = f"round(coalesce(1.0::DOUBLE / ({search.RRF_K} + {{a}}), 0) + coalesce(1.0::DOUBLE / ({search.RRF_K} + {{b}}), 0), 6)"

_HINTED = f"CASE WHEN NOT regexp_matches(query, {_q(X.METRIC_TERMS)}) AND regexp_matches(query, {_q(X.RISK_TERMS)}) THEN '1A' END"

# --- questions ---

_ASK = _case("(item_id % 8)::VARCHAR", list(enumerate(ASKS)))
QUESTIONS = f"ask0 AS (SELECT item_id AS query_id, concat_ws(' ', {_ASK}, text) AS query FROM benchmark)"
# list_distinct does not keep the order: the first place of each ticker does
_ALL = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(query), {_q(n)}) THEN {_q(t)} END" for n, t in X.by_length(X.COMPANIES)) + "], lambda t: t IS NOT NULL)"
COMPANIES = f"""found AS (SELECT query_id, query, {_ALL} AS every FROM ask0),
comp AS (SELECT query_id, query, list_filter(every, lambda t, i: list_position(every, t) = i) AS c FROM found)"""


def _route(ticker: str, item: str) -> str:
    hint = f"coalesce({item}, {_HINTED})"
    job = lambda t, i, w="1.0": f"{{'ticker': {t}, 'item_number': {i}, 'weight': {w}::DOUBLE}}"
    return f"""WITH {QUESTIONS}, {COMPANIES},
jobs AS (
  SELECT query_id, CASE
    WHEN {ticker} IS NOT NULL THEN [{job(ticker, hint)}]
    WHEN len(c) >= 2 AND {item} IS NOT NULL THEN [{job('c[1]', item)}, {job('c[2]', item)}]
    WHEN len(c) >= 2 AND regexp_matches(query, {_q(X.METRIC_TERMS)}) THEN [{job('c[1]', "'8'")}, {job('c[1]', "'7'", '0.8')}, {job('c[2]', "'8'")}, {job('c[2]', "'7'", '0.8')}]
    WHEN len(c) >= 2 THEN [{job('c[1]', hint)}, {job('c[2]', hint)}]
    WHEN len(c) = 1 THEN [{job('c[1]', hint)}]
    ELSE [{job('NULL::VARCHAR', hint)}] END AS j
  FROM comp
)
SELECT query_id, (i - 1)::INTEGER AS job, j.ticker, j.item_number, j.weight FROM (SELECT query_id, unnest(j) AS j, generate_subscripts(j, 1) AS i FROM jobs)"""


# --- hybrid retrieval ---

#: Companies change every twenty documents, so that each has chunks of every year and item.
_TICKER = "[" + ", ".join(map(_q, TICKERS)) + "][({} // 20) % " + str(len(TICKERS)) + " + 1]"


def _jobs_of(source: str, name: str, k: int) -> str:
    """The best k of every job of the source's scores, each document once, in the order of jobs and ranks."""
    return f"""{name}0 AS (
  SELECT s.query_id, s.pos, s.score, j.job FROM {source} s JOIN job0 j USING (query_id) JOIN sec0 USING (pos)
  WHERE (j.ticker IS NULL OR j.ticker = sec0.ticker) AND (j.item_number IS NULL OR j.item_number = sec0.item_number) AND (query_id % 4 <> 3 OR sec0.fiscal_year = {YEAR_ASKED})
),
{name}1 AS ({_top(name + '0', k, 'query_id, job')}),
{name}2 AS (SELECT query_id, pos, max(score) AS score, min(job * 1000 + rank) AS first FROM {name}1 GROUP BY query_id, pos),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM {name}2)"""


HYBRID = f"""{_scores(f"WITH {QUESTIONS} SELECT * FROM ask0")},{DENSE_ASKED},
sec0 AS (SELECT doc_id AS pos, {_TICKER.format('doc_id')} AS ticker, (2020 + doc_id % 5)::INTEGER AS fiscal_year, {_ITEM} AS item_number FROM documents WHERE {_strip('text')} <> ''),
job0 AS ({_route("NULL::VARCHAR", "NULL::VARCHAR")}),
hint AS (WITH {QUESTIONS} SELECT query_id, query FROM ask0 WHERE query_id IN (SELECT pos FROM vec)),
pos_lex AS (SELECT lex.* FROM lex JOIN hint USING (query_id) WHERE score > 0),
best AS ({_top("den", 600, columns="query_id, pos, score")}),
{_jobs_of('pos_lex', 'la', 60)},
{_jobs_of('best', 'lb', 60)},
fused AS (
  SELECT coalesce(la.query_id, lb.query_id) AS query_id, coalesce(la.pos, lb.pos) AS pos, la.rank AS bm25_rank, lb.rank AS dense_rank, {_RRF.format(a="la.rank", b="lb.rank")} AS rrf_score
  FROM la FULL JOIN lb ON la.query_id = lb.query_id AND la.pos = lb.pos
),
hyb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, pos) AS rank FROM fused) WHERE rank <= 20)"""
#: The same with all vectors as candidates, whatever a job's filters are.
_BEST = f"""best AS ({_top("den", 600, columns="query_id, pos, score")}),"""
HYBRID_WHOLE = HYBRID.replace(_BEST, "best AS (SELECT query_id, pos, score FROM den),")

_HEAD = f"array_to_string(list_slice(regexp_extract_all(text, '[{X.SPACE}]*[^{X.SPACE}]+'), 1, {search.RERANK_TOKENS}), '')"
RERANK = f"""{HYBRID},
pair AS (
  SELECT h.query_id, h.pos, h.rrf_score, h.rank AS rrf_rank, h.bm25_rank, h.dense_rank, query, d.text, d.source, list_distinct({_tokenise('hint.query')}) AS q, {_tokenise(_HEAD.replace('text', 'd.text'))} AS p
  FROM hyb h JOIN hint USING (query_id) JOIN documents d ON d.doc_id = h.pos
),
ce AS (SELECT * EXCLUDE (q, p), round(1 / (1 + exp(-(8.0::DOUBLE * len(list_intersect(q, p)) / len(q) - 4))), 4) AS ce_score FROM pair),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ce_score DESC, rrf_score DESC, rrf_rank) AS rank FROM ce)"""

# --- chunks ---


def _cut(x: str, separator: str) -> str:
    """Pieces with the separator at their end, blank ones dropped."""
    parts = f"string_split({x}, {separator})"
    return f"list_filter(list_transform({parts}, lambda h, i: CASE WHEN i < len({parts}) THEN h || {separator} ELSE h END), lambda h: {_strip('h')} <> '')"


def _recursive(name: str, source: str, size: int, overlap: int, least: int) -> str:
    """CTEs that end in `name` (doc_id, b, chunks): the texts of source (doc_id, b, text) split, packed and glued.

    Pieces that are too long are cut at the next separator, level by level; the last level, slices of characters, always fits."""
    levels = ["chr(10) || chr(10)", "chr(10)", "'. '", "' '"]
    out = [f"{name}0 AS (SELECT doc_id, b, [{_strip('text')}] AS p FROM {source} WHERE {_strip('text')} <> '')"]
    for k, separator in enumerate(levels):
        out.append(f"{name}{k + 1} AS (SELECT doc_id, b, flatten(list_transform(p, lambda x: CASE WHEN {_count('x')} <= {size} THEN [x] ELSE {_cut('x', separator)} END)) AS p FROM {name}{k})")
    step = size // 4
    slices = f"list_transform(range(0, length(x), {step}), lambda i: substr(x, i::INTEGER + 1, {step}))"
    out.append(f"{name}5 AS (SELECT doc_id, b, list_transform(flatten(list_transform(p, lambda x: CASE WHEN {_count('x')} <= {size} THEN [x] ELSE {slices} END)), lambda x: {{'p': x, 'n': {_count('x')}}}) AS p FROM {name}4)")
    # the last whole pieces that the overlap allows begin the next chunk
    keep = f"len(list_filter(range(1, len(s.lens) + 1), lambda j: list_sum(s.lens[len(s.lens) - j + 1 : len(s.lens)]) <= {overlap}))"
    flush = f"""{{'out': list_append(s.out, {_strip("array_to_string(s.held, '')")}), 'held': list_append(s.held[len(s.held) - {keep} + 1 : len(s.held)], x.p), 'lens': list_append(s.lens[len(s.lens) - {keep} + 1 : len(s.lens)], x.n),
  'total': {_count(f"(array_to_string(s.held[len(s.held) - {keep} + 1 : len(s.held)], '') || x.p)")}::BIGINT}}"""
    more = "{'out': s.out, 'held': list_append(s.held, x.p), 'lens': list_append(s.lens, x.n), 'total': s.total + x.n}"
    none = "{'out': []::VARCHAR[], 'held': []::VARCHAR[], 'lens': []::BIGINT[], 'total': 0::BIGINT}"
    out.append(f"{name}6 AS (SELECT doc_id, b, list_reduce(p, lambda s, x: CASE WHEN len(s.held) > 0 AND s.total + x.n > {size} THEN {flush} ELSE {more} END, {none}) AS s FROM {name}5)")
    out.append(f"""{name}7 AS (SELECT doc_id, b, CASE WHEN len(s.held) > 0 THEN list_append(s.out, {_strip("array_to_string(s.held, '')")}) ELSE s.out END AS c FROM {name}6)""")
    glued = f"CASE WHEN {_strip('c')} = '' THEN s WHEN len(s) > 0 AND {_count('c')} < {least} THEN list_append(s[1 : len(s) - 1], s[len(s)] || chr(10) || c) ELSE list_append(s, c) END"
    out.append(f"{name} AS (SELECT doc_id, b, list_transform(list_reduce(c, lambda s, c: {glued}, []::VARCHAR[]), lambda c: {_strip('c')}) AS chunks FROM {name}7)")
    return ",\n".join(out)


def _listed(chunks: str, strategy: str) -> str:
    return f"SELECT doc_id, {_q(strategy)} AS strategy, unnest(chunks) AS chunk, (generate_subscripts(chunks, 1) - 1)::INTEGER AS chunk_index FROM {chunks}"


#: Mentions, and words that refer back to them.
_MENTION, _BACK = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*|[A-Z]{2,}|\$[\d,.]+[BMK]?|\d+\.?\d*\s*%)\b", r"(?i)\b(it|its|they|their|them|this|these|those|such|the company|the firm|the group)\b"


def _places(name: str, pattern: str, source: str) -> str:
    """CTEs that end in `name` (doc_id, a, e): where the pattern matches the source's text, by the lengths of what stands before.

    Letters and digits beyond ASCII become a word's character, other characters a mark, so that boundaries are those of Unicode."""
    plain = "regexp_replace(regexp_replace(regexp_replace(text, '[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', ' ', 'g'), '[^\\p{L}\\p{N}\\x00-\\x7f]', ';', 'g'), '[^\\x00-\\x7f]', '_', 'g')"
    return f"""{name}0 AS (SELECT doc_id, string_split(regexp_replace({plain}, {_q(pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS p FROM {source}),
{name}1 AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM {name}0),
{name}2 AS (SELECT doc_id, i, strpos(x, chr(2)) - 1 AS n, coalesce(sum(length(replace(x, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM {name}1),
{name} AS (SELECT doc_id, a, a + n AS e FROM {name}2 WHERE i > 1)"""


def _references(name: str, source: str, chunked: str) -> str:
    """CTEs that end in `name` (k, rc): of chunked (k, doc_id, chunks) the share of references that stay in the chunk of their mention."""
    place = lambda at: f"coalesce((SELECT max(c.i) FROM {name}c c WHERE c.k = w.k AND c.a <= {at} AND {at} < c.a + c.n), w.n - 1)"
    return f"""{_places(name + 'm', _MENTION, source)},
{_places(name + 'p', _BACK, source)},
{name}pair AS MATERIALIZED (SELECT m.doc_id, m.a AS own, p.a AS back FROM {name}m m JOIN {name}p p ON p.doc_id = m.doc_id AND p.a >= m.e AND p.a <= m.e + 200),
{name}u AS (SELECT k, unnest(chunks) AS c, generate_subscripts(chunks, 1) - 1 AS i FROM {chunked}),
{name}c AS MATERIALIZED (SELECT k, i, length(c) AS n, coalesce(sum(length(c) + 1) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM {name}u),
{name}w AS (SELECT k, doc_id, len(chunks) AS n FROM {chunked}),
{name}at AS (SELECT DISTINCT doc_id, own AS at FROM {name}pair UNION SELECT DISTINCT doc_id, back FROM {name}pair),
{name}in AS MATERIALIZED (SELECT w.k, t.at, {place('t.at')} AS chunk FROM {name}w w JOIN {name}at t USING (doc_id)),
{name}sum AS (SELECT w.k, count(*) AS every, count(*) FILTER (a.chunk <> b.chunk) AS broken FROM {name}w w JOIN {name}pair p USING (doc_id) JOIN {name}in a ON a.k = w.k AND a.at = p.own JOIN {name}in b ON b.k = w.k AND b.at = p.back GROUP BY w.k),
{name} AS (SELECT w.k, CASE WHEN w.n <= 1 OR every IS NULL THEN 1.0 ELSE round(1 - broken::DOUBLE / every, 4) END AS rc FROM {name}w w LEFT JOIN {name}sum USING (k))"""


_WHOLE = f"{SEC}, whole AS (SELECT doc_id, 0 AS b, text FROM sec)"
# runs of lines that are table rows or not
_ROW_LINE = f"({_strip('l')} <> '' AND (regexp_matches({_strip('l')}, '^\\|[-:| ]+\\|$') OR (contains(l, '|') AND (length({_strip('l')}) - length(replace({_strip('l')}, '|', '')))::DOUBLE / length({_strip('l')}) >= 0.5)))"
_RUNS = """list_reduce(list_transform(string_split(text, chr(10)), lambda l: {'t': l, 'k': %s}), lambda s, x: CASE WHEN len(s) > 0 AND s[len(s)].k = x.k
  THEN list_append(s[1 : len(s) - 1], {'t': s[len(s)].t || chr(10) || x.t, 'k': x.k}) ELSE list_append(s, x) END, []::STRUCT(t VARCHAR, k BOOLEAN)[])""" % _ROW_LINE

LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"
CHUNKS = f"{LINES},\nchk AS (SELECT doc_id, (i // 5)::INTEGER AS chunk_index, string_agg(line, chr(10) ORDER BY i) AS chunk FROM ln GROUP BY doc_id, i // 5)"


def _spaced(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _table_aware(name: str, source: str, size: tuple[int, int] = (110, 11), least: int = 8) -> str:
    """CTEs that end in `name` (doc_id, chunks): tables whole up to twice the size, prose between them recursively."""
    return f"""{name}runs AS (SELECT doc_id, unnest(r) AS r, generate_subscripts(r, 1) AS b FROM (SELECT doc_id, {_RUNS} AS r FROM {source})),
{name}blk AS (SELECT doc_id, b, r.t AS text, r.k AS k FROM {name}runs WHERE {_strip('r.t')} <> ''),
{name}prose AS (SELECT * FROM {name}blk WHERE NOT k), {_recursive(name + 'r', name + 'prose', *size, least)},
{name}every AS (SELECT doc_id, b, chunks FROM {name}r UNION ALL SELECT doc_id, b, CASE WHEN {_count('text')} <= {2 * size[0]} THEN [{_strip('text')}] ELSE list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda x: {_strip('x')}), lambda x: x <> '') END FROM {name}blk WHERE k),
{name} AS (SELECT doc_id, flatten(list(chunks ORDER BY b)) AS chunks FROM {name}every GROUP BY doc_id)"""


def _by_pattern(name: str, source: str) -> str:
    """CTEs that end in `name` (doc_id, chunks): cut after a sentence at the end of a line, long pieces recursively, small ones glued."""
    return f"""{name}short AS (SELECT * FROM {source} WHERE {_count('text')} < 30), {_recursive(name + 'r', name + 'short', 60, 6, 8)},
{name}cut AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]\n)', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') AS p FROM {source} WHERE {_count('text')} >= 30),
{name}piece AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) AS b FROM {name}cut),
{name}long AS (SELECT * FROM {name}piece WHERE {_count('text')} > 220), {_recursive(name + 'q', name + 'long', 110, 11, 8)},
{name}each AS (SELECT p.doc_id, p.b, coalesce(q.chunks, [p.text]) AS c, q.chunks IS NULL AND {_count('p.text')} < 8 AS small FROM {name}piece p LEFT JOIN {name}q q ON p.doc_id = q.doc_id AND p.b = q.b),
{name}fold AS (SELECT doc_id, list_reduce(list({{'c': c, 'small': small}} ORDER BY b), lambda s, x: CASE WHEN x.small AND len(s) > 0 THEN list_append(s[1 : len(s) - 1], s[len(s)] || chr(10) || x.c[1]) ELSE list_concat(s, x.c) END, []::VARCHAR[]) AS c FROM {name}each GROUP BY doc_id),
{name} AS (SELECT doc_id, list_filter(list_transform(c, lambda x: {_strip('x')}), lambda x: x <> '') AS chunks FROM {name}fold UNION ALL SELECT doc_id, chunks FROM {name}r)"""


ARRAYS = f"""{SIG}, {CHUNKS},
arr AS (SELECT doc_id, list(chunk ORDER BY chunk_index) AS chunks FROM chk GROUP BY doc_id),
own AS (SELECT typed.*, chunks, list_transform(chunks, lambda c: {_spaced('c')}) AS spaced FROM typed JOIN arr USING (doc_id))"""
_BOUND = lambda x: f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x})), 4)"
_FOUND_IN = lambda parts: f"list_filter({parts}, lambda b: len(list_filter(spaced, lambda c: contains(c, {_spaced('b')}))) > 0)"


def _embed(x: str) -> str:
    bins = f"list_transform({_tokenise(x)}, lambda t: ('0x' || left(md5(t), 2))::INTEGER % {chunk_quality.DIMENSIONS})"
    return f"list_transform([{bins}], lambda own: list_transform(range({chunk_quality.DIMENSIONS}), lambda d: len(list_filter(own, lambda b: b = d))::DOUBLE))[1]"


def _cos(a: str, b: str) -> str:
    na, nb = f"sqrt(list_dot_product({a}, {a}))", f"sqrt(list_dot_product({b}, {b}))"
    return f"CASE WHEN {na} > 0 AND {nb} > 0 THEN list_dot_product({a}, {b}) / ({na} * {nb}) ELSE 0.0::DOUBLE END"


_STRIP = lambda a: f"list_transform({a}, lambda x: trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g')))"
_RAW = """(text || ' [Source ' || (turn % 7 + 1)::VARCHAR || '] may  [source  ' || (turn % 3 + 1)::VARCHAR || '] [Source ' || (turn + 4)::VARCHAR || ']')"""
RAW = f"said AS (SELECT conv_id * 1000 + turn AS query_id, {_RAW} AS raw_answer FROM conversations WHERE role = 'assistant')"
_CITED = "list_transform(regexp_extract_all(raw_answer, '(?i)\\[Source\\s+(\\d+)\\]', 1), lambda n: n::INTEGER)"
_CLEAN = "trim(regexp_replace(list_reduce(list_transform(list_distinct(bad), lambda n: n::VARCHAR), lambda s, n: regexp_replace(s, '(?i)\\[Source\\s+' || n || '\\]', '', 'g'), raw_answer), '  +', ' ', 'g'))"
CHECKED = f"""cit AS (SELECT *, {_CITED} AS cited FROM said),
val AS (SELECT *, list_filter(cited, lambda n: n NOT BETWEEN 1 AND 5) AS bad, list_sort(list_distinct(list_filter(cited, lambda n: n BETWEEN 1 AND 5))) AS good FROM cit),
chkd AS (SELECT *, {_CLEAN} AS answer FROM val)"""
ANSWERED = f"""{RERANK}, res AS (SELECT * FROM rr WHERE rank <= 5),
said AS (SELECT query_id, query, 'It may be so [Source 2] [Source ' || (query_id % 6)::VARCHAR || '] ' || query AS raw_answer FROM hint),
{CHECKED}"""

_fmt = lambda v: f"""CASE WHEN abs({v}) >= 1e9 THEN '$' || printf('%.2f', {v} / 1e9) || 'B' WHEN abs({v}) >= 1e6 THEN '$' || printf('%.0f', {v} / 1e6) || 'M'
  WHEN abs({v}) >= 1e3 THEN '$' || printf('%.0f', {v} / 1e3) || 'K' WHEN abs({v}) > 0 AND abs({v}) < 2 THEN printf('%.2f', {v} * 100) || '%' ELSE printf('%.0f', {v}) END"""  # noqa: E731
_SIC = "[" + ", ".join(map(_q, [*X.SECTORS, "3571"])) + ", NULL]"
_TITLED = lambda x: f"array_to_string(list_transform(regexp_extract_all({x}, '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')"

_TABLE = f"coalesce(len(list_filter({_lines('text')}, lambda l: contains(l, '|')))::DOUBLE / nullif(len({_lines('text')}), 0) >= 0.4, false)"

_SC = f"round(len(list_filter(chunks, lambda c: {_count('c')} BETWEEN 80 AND 1200))::DOUBLE / len(chunks), 4)"
_BLOCKS = f"""p AS (SELECT *, list_filter({_STRIP("string_split_regex(text, '\\n{2,}')")}, lambda p: p <> '' AND {_count('p')} >= 20) AS paras,
  list_distinct(list_filter({_STRIP("list_concat(list_concat(regexp_extract_all(text, '(?m)^\\s*[-*•]\\s+\\S|^\\s*\\d+\\.\\s+\\S'), regexp_extract_all(text, '(?m)^\\s*\\|.+\\|\\s*$')), regexp_extract_all(text, '(?m)^\\s*(?:Item\\s+\\d+[A-Z]?|ITEM\\s+\\d+[A-Z]?)'))")}, lambda x: x <> '')) AS rest FROM own),
b AS (SELECT *, list_concat(paras, list_filter(rest, lambda r: NOT list_contains(paras, r))) AS blocks FROM p)"""
_BI = f"""CASE WHEN len(blocks) = 0 THEN 1.0 ELSE {_BOUND(f"len({_FOUND_IN('blocks')})::DOUBLE / len(blocks)")} END"""
_OFF = f"list_transform(chunks, lambda c: abs({_density('c')} - numerical_density))"
_NDS = f"""CASE WHEN numerical_density < 0.02 THEN 1.0 ELSE {_BOUND("list_sum(list_transform(off, lambda x: CASE WHEN x <= 0.15 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0 - (x - 0.15) / 0.15) END)) / len(off)")} END"""
_ROWS = f"""list_filter(list_transform(regexp_extract_all(text, '(?m)^[ \\t]*\\|.+\\|[ \\t]*$'), lambda x: trim(x)), lambda r: NOT regexp_matches(r, '^\\|[-:| ]+\\|$'))"""
_TBI = f"""CASE WHEN len(rws) = 0 THEN 1.0 ELSE {_BOUND(f"len({_FOUND_IN('rws')})::DOUBLE / len(rws)")} END"""
_SPS = f"""{_BOUND("len(list_filter(chunks, lambda c: len(list_filter(regexp_extract_all(c, '(?:^|\\n)\\s*(?:ITEM|Item)\\s+(\\d+[A-Za-z]?)\\b', 1), lambda h: upper(h) <> upper(item_number))) = 0))::DOUBLE / len(chunks)")}"""
# a total is a sum of tenths of thousandths, so it may lie between two shown figures: its shortest digits are rounded, as Spark does
_DIGITS = lambda x: f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE"
_TOTAL = _DIGITS("CASE section_type " + " ".join(f"WHEN '{t}' THEN " + " + ".join(f"{m} * {w}::DOUBLE" for m, w in ws.items()) for t, ws in chunk_quality.WEIGHTS.items()) + " END")
COMPETITION = f"""{SIG}, {LINES},
cut AS (SELECT doc_id, n, (i // n)::INTEGER AS ci, string_agg(line, chr(10) ORDER BY i) AS chunk FROM ln, (SELECT unnest({list(LINE_COUNTS)}) AS n) WHERE doc_id % 7 <> 0 GROUP BY doc_id, n, i // n),
cuts AS (SELECT doc_id, n, list(chunk ORDER BY ci) AS chunks FROM cut GROUP BY doc_id, n),
own AS (SELECT typed.*, n, chunks, list_transform(chunks, lambda c: {_spaced('c')}) AS spaced FROM typed JOIN cuts USING (doc_id)),
{_BLOCKS},
parts AS (SELECT *, {_OFF} AS off, {_ROWS} AS rws FROM b),
met AS (SELECT *, 1.0::DOUBLE AS icc, 1.0::DOUBLE AS dcc, 1.0::DOUBLE AS rc, {_SC} AS sc, {_BI} AS bi, {_NDS} AS nds, {_TBI} AS tbi, {_SPS} AS sps FROM parts),
tot AS (SELECT doc_id, n, len(chunks)::INTEGER AS n_chunks, {_TOTAL} AS total FROM met),
comp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, n_chunks, n) AS k FROM tot)"""

def _competing(small: tuple[int, int], large: tuple[int, int], least: int, pattern: bool) -> str:
    """All strategies of all sections at these sizes, by all eight metrics, ending in comp."""
    return f"""{SIG}, whole AS (SELECT doc_id, 0 AS b, text FROM typed),
tabular AS (SELECT doc_id, text FROM typed WHERE section_type IN ('financial_table', 'mixed') OR table_density >= 0.1),
wordy AS (SELECT doc_id, 0 AS b, text FROM typed WHERE token_count >= 300 AND {str(pattern).lower()}),
{_recursive('ra', 'whole', *small, least)}, {_recursive('rb', 'whole', *large, least)}, {_table_aware('ta', 'tabular', large, least)}, {_by_pattern('px', 'wordy')},
cuts AS (SELECT doc_id, 0 AS ord, 'recursive_600' AS strategy, chunks FROM ra UNION ALL SELECT doc_id, 1, 'recursive_1100', chunks FROM rb
  UNION ALL SELECT doc_id, 2, 'table_aware', chunks FROM ta UNION ALL SELECT doc_id, 3, 'llm_regex', chunks FROM px),
own AS MATERIALIZED (SELECT typed.*, doc_id * 4 + ord AS k, ord, strategy, chunks, list_transform(chunks, lambda c: {_spaced('c')}) AS spaced FROM typed JOIN cuts USING (doc_id)),
{_references('ref', 'typed', 'own')},
chs AS (SELECT k, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS i FROM own),
emb AS MATERIALIZED (SELECT k, i, {_embed('chunk')} AS v, list_filter(string_split(regexp_replace(trim(chunk), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_count('s')} > 3) AS s FROM chs),
near AS (SELECT k, v, lead(v) OVER (PARTITION BY k ORDER BY i) AS w FROM emb),
dcs AS (SELECT k, CASE WHEN count(*) < 2 THEN 1.0 ELSE {_BOUND(f"sum(CASE WHEN w IS NOT NULL THEN {_cos('v', 'w')} END) / (count(*) - 1)")} END AS dcc FROM near GROUP BY k),
one AS (SELECT k, i, v, unnest(s) AS one FROM emb), sen AS (SELECT k, i, v, {_embed('one')} AS w FROM one), mean AS (SELECT k, i, avg({_cos('w', 'v')}) AS m FROM sen GROUP BY k, i),
ics AS (SELECT emb.k, {_BOUND("avg(CASE WHEN len(emb.s) < 2 THEN 1.0 ELSE mean.m END)")} AS icc FROM emb LEFT JOIN mean USING (k, i) GROUP BY emb.k),
{_BLOCKS},
parts AS (SELECT *, {_OFF} AS off, {_ROWS} AS rws FROM b),
met AS (SELECT parts.*, icc, dcc, rc, {_SC} AS sc, {_BI} AS bi, {_NDS} AS nds, {_TBI} AS tbi, {_SPS} AS sps FROM parts JOIN ics USING (k) JOIN dcs USING (k) JOIN ref USING (k)),
tot AS (SELECT doc_id, ord, strategy, chunks, len(chunks)::INTEGER AS n_chunks, {_TOTAL} AS total FROM met),
comp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, n_chunks, ord) AS place FROM tot)"""


STRATEGIES = _competing((60, 6), (110, 11), 8, True)
ENGINE_CHUNKS = _competing((600, 60), (1100, 110), 80, False)

_CONFIDENCE = f"""CASE WHEN s.n IS NULL THEN 0.0 ELSE {_BOUND(f"0.5 * CASE WHEN c = 0 THEN 0.3::DOUBLE ELSE ce END + 0.3 * len(good)::DOUBLE / s.n + 0.2 * (1 - least(1.0::DOUBLE, len(regexp_extract_all(answer, {_q(X.HEDGES)}))::DOUBLE / greatest(len({_toks('answer')}), 1) * 10))")} END"""

ORACLE_SQL: dict[str, str] = {
    "text_tokenise": f"SELECT doc_id, array_to_string({_tokenise('text')}, ' ') AS terms FROM documents",
    "text_token_count": f"SELECT doc_id, {_count('text')}::INTEGER AS tokens, array_to_string(list_slice(regexp_extract_all(text, '[{X.SPACE}]*[^{X.SPACE}]+'), 1, 20), '') AS head FROM documents",
    "text_numerical_density": f"SELECT doc_id, round({_density('text')}, 4) AS density FROM documents",
    "text_sentences": f"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_count('s')} > 3) AS s FROM documents)
SELECT doc_id, len(s)::INTEGER AS n, coalesce(s[1], '') AS first FROM s""",
    "section_signals": f"""WITH {SIG}
SELECT doc_id, token_count, numerical_density, table_density,
  coalesce(round(list_sum(list_transform({_SENT}, lambda s: {_count('s')}))::DOUBLE / nullif(len({_SENT}), 0), 2), 0.0) AS avg_sentence_length,
  {' OR '.join(f"regexp_matches(text, {_q(p)})" for p in X.SUBSECTIONS)} AS has_subsections,
  len(list_filter({_lines('text')}, lambda l: {_row('l')}))::INTEGER AS table_row_count,
  len(list_filter(string_split_regex(text, '\\n{{2,}}'), lambda p: {_strip('p')} <> ''))::INTEGER AS paragraph_count FROM typed""",
    "section_classify": f"WITH {SIG} SELECT doc_id, item_number, section_type FROM typed",
    "section_ids": f"""WITH {SEC}, i AS (SELECT doc_id, ticker || '_' || fiscal_year::VARCHAR || '_item_' || lower(item_number) AS section_id FROM sec)
SELECT doc_id, section_id, section_id || printf('_chunk_%04d', (doc_id % 50)::INTEGER) AS chunk_id FROM i""",
    "section_type_counts": f"WITH {SIG} SELECT section_type, count(*) AS sections, sum(token_count)::BIGINT AS tokens FROM typed GROUP BY section_type",
    "embedded_tables": """WITH t AS (SELECT doc_id, text || chr(10) || '| a | ' || doc_id::VARCHAR || ' |' || chr(10) || '| b | 2 |' || chr(10) || 'end' || chr(10) || '| one |' || chr(10) AS x FROM documents),
f AS (SELECT doc_id, list_transform(regexp_extract_all(x, '(\\|.+\\|(?:\\n\\|.+\\|)+)', 1), lambda s: trim(s)) AS f FROM t)
SELECT doc_id, len(f)::INTEGER AS n, array_to_string(f, '#') AS tables FROM f""",
    "label_clean": f"""WITH r AS (SELECT p_partkey, 'us_' || replace({_TITLED('lower(p_type)')}, ' ', '') || '_Tier' || p_size::VARCHAR || 'capital' || chr(160) || 'ratio-per ' AS raw FROM part),
c AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^[a-zA-Z]+[-_]', ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[-_{X.SPACE}]+', ' ', 'g')) AS x FROM r)
SELECT p_partkey, {_TITLED('x')} AS label FROM c""",
    "number_format": f"""WITH v AS (SELECT o_orderkey, o_totalprice * [1.000123::DOUBLE, 1000.0717, 999983.0, 1.0000717e-6, -1.70031e-2][o_orderkey % 5 + 1] AS v FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '—' WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE {_fmt('v')} END AS shown FROM v""",
    "sector_lookup": f"SELECT s_suppkey, {_SIC}[s_suppkey % 12 + 1] AS sic, CASE WHEN {_SIC}[s_suppkey % 12 + 1] IS NOT NULL THEN {_case(_SIC + '[s_suppkey % 12 + 1]', X.SECTORS.items(), _q('Other'))} END AS sector FROM supplier",
    "filing_pick": f"""WITH o AS (SELECT o_custkey::VARCHAR AS ticker, strftime(o_orderdate, '%Y-%m-%d') AS p, lpad(o_orderkey::VARCHAR, 18, '0') AS a FROM orders),
y AS (SELECT unnest(range({FIRST_YEAR}, {LAST_YEAR + 1}))::INTEGER AS y),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker, y ORDER BY starts_with(p, y::VARCHAR) DESC, p DESC, a DESC) AS k FROM o, y)
SELECT ticker, y AS fiscal_year, p AS period_of_report, left(a, 10) || '-' || substr(a, 11, 2) || '-' || substr(a, 13, 6) AS accession_no FROM r WHERE k = 1""",
    "section_unpivot": """WITH u AS (
  SELECT s_name, '1' AS item_number, 'Business' AS item_title, 'narrative' AS section_type, trim(s_name) AS text FROM supplier
  UNION ALL SELECT s_name, '1A', 'Risk Factors', 'narrative', CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'risk ' || s_name END FROM supplier
  UNION ALL SELECT s_name, '7', 'Management''s Discussion and Analysis', 'mixed', 'mda ' || s_suppkey::VARCHAR FROM supplier)
SELECT upper(s_name) || '_2024_item_' || lower(item_number) AS section_id, item_number, item_title, CASE WHEN {dens} >= 0.15 THEN 'mixed' ELSE section_type END AS section_type, text FROM u WHERE text <> ''""".replace("{dens}", _density("text")),
    "statement_table": f"""WITH r AS (SELECT s_nationkey AS nation, s_suppkey AS line, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Net Income' || s_nationkey::VARCHAR END AS label, s_acctbal * 1000.0717 AS a, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal * 3e6 + 0.1 END AS b FROM supplier)
SELECT nation, '### Income' || chr(10) || chr(10) || '| Metric | FY2024 | FY2023 |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
  string_agg('| ' || label || ' | ' || {_fmt('a')} || ' | ' || CASE WHEN b IS NULL THEN '—' ELSE {_fmt('b')} END || ' |', chr(10) ORDER BY line) AS "table" FROM r GROUP BY nation""",
    "financial_sections": """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '[Fallback]' || chr(10) || n_name ELSE '[Balance Sheet]' || chr(10) || '| ' || n_name || ' |' ||
  CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || chr(10) || '[Cash Flow]' || chr(10) || '| 1 |' ELSE '' END END AS text, (CASE WHEN n_nationkey % 3 > 0 AND n_nationkey % 2 = 0 THEN 2 ELSE 1 END)::INTEGER AS n_tables FROM nation""",
    "html_text": """WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>|<noscript\\b.*?</noscript\\s*>|<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br\\s*/?>|</(p|div|li|tr|h[1-6]|table|section|article)\\s*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \\t\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')) AS text FROM c)
SELECT page_id, text FROM d WHERE text <> ''""",
    "bm25_term_stats": f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_df_classes": f"WITH {BM25} SELECT df, count(*) AS terms, min(term) AS first, max(term) AS last, round(any_value(idf), 6) AS idf FROM idf GROUP BY df",
    "bm25_topk": f"WITH {_scores()} {_top('(SELECT * FROM lex WHERE score > 0)', 10)}",
    "bm25_topk_segments": f"WITH {_scores()} {_top('(SELECT * FROM lex WHERE score > 0)', 10)}",
    "filter_bitmaps": f"""WITH sec0 AS (SELECT doc_id AS pos, {_TICKER.format('doc_id')} AS ticker, (2020 + doc_id % 5)::VARCHAR AS fiscal_year, {_ITEM} AS item_number, lang AS sector FROM documents WHERE {_strip('text')} <> '')
SELECT field, value, count(*) AS n FROM (UNPIVOT sec0 ON ticker, fiscal_year, item_number, sector INTO NAME field VALUE value) GROUP BY field, value""",
    "bm25_topk_filtered": f"WITH {_scores()}, keep AS (SELECT doc_id AS pos FROM documents WHERE {_ITEM} = '1A' AND lang = 'en' AND trim(text) <> '') {_top('(SELECT * FROM lex WHERE score > 0 AND pos IN (SELECT pos FROM keep))', 10)}",
    "vec_normalise": """WITH v AS (SELECT vec_id AS pos, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings), n AS (SELECT pos, v, sqrt(list_dot_product(v, v)) AS n FROM v)
SELECT pos, round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 6) AS norm, round(v[1] / n, 6) AS first FROM n""",
    "vec_cosine": f"WITH {DENSE} SELECT x.pos, round({_cos('x.v', 'q.v')}, 6) AS cosine FROM vec x, (SELECT v FROM vec WHERE pos = 0) q",
    "dense_topk": f"WITH {DENSE} {_top('den', 10)}",
    "dense_topk_cells": f"WITH {DENSE} {_top('den', 10)}",
    "dense_cells_recall": "SELECT sum(least(10, n))::BIGINT AS nearest, true AS enough FROM (SELECT count(*) OVER () AS n FROM embeddings)",
    "dense_topk_postfilter": f"WITH {DENSE}, best AS ({_top('den', 100, columns='query_id, pos, score')}) {_top('(SELECT best.* FROM best JOIN vec USING (pos) WHERE label = 3)', 10)}",
    "dense_topk_prefilter": f"WITH {DENSE} {_top('(SELECT den.* FROM den JOIN vec USING (pos) WHERE label = 3)', 10)}",
    "classify_query": f"""WITH {QUESTIONS} SELECT query_id, CASE WHEN regexp_matches(query, {_q(X.COMPARATIVE)}) THEN 'comparative' WHEN regexp_matches(query, {_q(X.ANALYTICAL)}) THEN 'analytical' ELSE 'factual' END AS query_type,
  CASE WHEN regexp_matches(query, {_q(X.METRIC_TERMS)}) THEN 'metric' WHEN regexp_matches(query, {_q(X.RISK_TERMS)}) THEN 'risk' WHEN regexp_matches(query, {_q(X.STRATEGY_TERMS)}) THEN 'strategy' ELSE 'none' END AS intent, {_HINTED} AS hint FROM ask0""",
    "detect_companies": f"WITH {QUESTIONS}, {COMPANIES} SELECT query_id, array_to_string(c, ',') AS tickers FROM comp",
    "detect_names": "WITH n AS (SELECT item_id AS name_id, lower(array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ')) AS name FROM benchmark) SELECT doc_id, name_id, (strpos(lower(text), name) - 1)::BIGINT AS first FROM documents JOIN n ON contains(lower(text), name)",
    "named_companies": f"WITH {QUESTIONS}, {COMPANIES} SELECT query_id, array_to_string(c, ',') AS tickers FROM comp WHERE len(c) > 0",
    "route_query": _route("NULL::VARCHAR", "NULL::VARCHAR"),
    "route_query_filtered": _route("CASE WHEN query_id % 5 = 0 THEN 'GS' END", "CASE WHEN query_id % 3 = 0 THEN '2' END"),
    "rrf_fusion": f"""WITH {FUSED} SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.pos, b.pos) AS pos, a.rank AS bm25_rank, b.rank AS dense_rank, {_RRF.format(a='a.rank', b='b.rank')} AS rrf_score
FROM a FULL JOIN b ON a.query_id = b.query_id AND a.pos = b.pos""",
    "multi_job_dedup": f"""WITH {_scores()}, sec0 AS (SELECT doc_id AS pos, {_ITEM} AS item_number FROM documents WHERE trim(text) <> ''),
j AS (SELECT 0 AS job, lex.* FROM lex JOIN sec0 USING (pos) WHERE score > 0 AND item_number = '7' UNION ALL SELECT 1, lex.* FROM lex JOIN sec0 USING (pos) WHERE score > 0),
r AS ({_top('j', 15, 'query_id, job')}),
f AS (SELECT query_id, pos, max(score) AS score, min(job * 1000 + rank) AS first FROM r GROUP BY query_id, pos)
SELECT query_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM f""",
    "hybrid_retrieve": f"WITH {HYBRID_WHOLE} SELECT query_id, rank, pos, rrf_score, bm25_rank, dense_rank FROM hyb",
    "hybrid_chunks": f"WITH {HYBRID_WHOLE} SELECT query_id, rank AS place, hyb.pos, sec0.ticker, sec0.item_number, d.text FROM hyb JOIN sec0 USING (pos) JOIN documents d ON d.doc_id = hyb.pos",
    "default_corpus": f"SELECT unnest([{', '.join(map(_q, TICKERS))}]) AS ticker, 2024::INTEGER AS fiscal_year",
    "rerank_topk": f"WITH {RERANK} SELECT query_id, rank, pos, ce_score, rrf_rank FROM rr WHERE rank <= 5",
    "rerank_model": f"""WITH {RERANK}, m AS (SELECT *, contains(query, 'pineapple') AS failed, CASE WHEN NOT contains(query, 'pineapple') THEN ce_score END AS told FROM ce),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY told DESC NULLS LAST, rrf_score DESC, rrf_rank) AS place FROM m)
SELECT query_id, place AS rank, pos, told AS ce_score, rrf_rank, failed FROM r WHERE place <= 5""",
    "hybrid_degraded": f"""WITH {HYBRID}, one AS (SELECT query_id, pos, rank AS bm25_rank, round(1.0::DOUBLE / ({search.RRF_K} + rank), 6) AS rrf_score FROM la),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, pos) AS rank FROM one)
SELECT query_id, rank, pos, rrf_score, bm25_rank, NULL::INTEGER AS dense_rank FROM o WHERE rank <= 20""",
    "rank_movement": f"WITH {RERANK} SELECT query_id, pos, rrf_rank, rank, rrf_rank - rank AS movement FROM rr",
    "table_blocks_islands": f"""WITH {LINES}, f AS (SELECT *, trim(line) AS own, length(trim(line)) - length(replace(trim(line), '|', '')) AS pipes FROM ln),
t AS (SELECT *, own <> '' AND (regexp_matches(own, '^\\|[-:| ]+\\|$') OR (pipes > 0 AND pipes::DOUBLE / length(own) >= 0.5)) AS t FROM f),
n AS (SELECT *, CASE WHEN t = lag(t) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM t),
b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM n)
SELECT doc_id, block::BIGINT AS block, any_value(t) AS is_table, min(i)::INTEGER AS first_line, count(*) AS n_lines FROM b GROUP BY doc_id, block HAVING max(CASE WHEN own <> '' THEN 1 ELSE 0 END) = 1""",
    "chunk_lines": f"WITH {CHUNKS} SELECT doc_id, chunk_index, chunk, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS total FROM chk",
    "chunk_materialise": f"""WITH {SEC}, {CHUNKS}, c AS (SELECT *, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS total FROM chk)
SELECT doc_id, ticker || '_' || fiscal_year::VARCHAR || '_item_' || lower(item_number) || printf('_chunk_%04d', chunk_index) AS chunk_id, chunk_index, total AS total_chunks_in_section, {_count('chunk')}::INTEGER AS token_count,
  round({_density('chunk')}, 4) AS numerical_density, coalesce(len(list_filter({_lines('chunk')}, lambda l: contains(l, '|')))::DOUBLE / nullif(len({_lines('chunk')}), 0) >= 0.4, false) AS is_table_chunk
FROM c JOIN sec USING (doc_id) WHERE trim(chunk) <> ''""",
    "chunk_separator_split": f"""WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(\\. )', '\\1' || chr(1), 'g'), chr(1)), lambda p: {_strip('p')} <> '') AS p FROM documents)
SELECT doc_id, (generate_subscripts(p, 1) - 1)::INTEGER AS i, unnest(p) AS piece FROM p""",
    "chunk_recursive_600": f"WITH {_WHOLE}, {_recursive('r', 'whole', 600, 60, 80)} {_listed('r', 'recursive_600')}",
    "chunk_recursive_1100": f"WITH {_WHOLE}, {_recursive('r', 'whole', 1100, 110, 80)} {_listed('r', 'recursive_1100')}",
    "chunk_table_aware": f"WITH {_WHOLE}, {_table_aware('t', 'whole')} {_listed('t', 'table_aware')}",
    "chunk_regex": f"WITH {_WHOLE}, {_by_pattern('x', 'whole')} {_listed('x', 'llm_regex')}",
    "engine_chunks": f"""WITH {ENGINE_CHUNKS}, won AS (SELECT doc_id, strategy, total, n_chunks, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) - 1 AS i FROM comp WHERE place = 1)
SELECT upper(source) || '-' || doc_id::VARCHAR || '_' || (2020 + doc_id % 5)::VARCHAR || '_item_' || lower({_ITEM}) || printf('_chunk_%04d', i) AS chunk_id, strategy AS chunking_strategy, total AS chunking_score, n_chunks AS total_chunks_in_section,
  i::INTEGER AS chunk_index, {_count('chunk')}::INTEGER AS token_count, round({_density('chunk')}, 4) AS numerical_density, {_TABLE.replace("'text'", "'chunk'").replace('text', 'chunk')} AS is_table_chunk, md5(chunk) AS digest
FROM won JOIN documents USING (doc_id)""",
    "strategy_winner": f"WITH {STRATEGIES} SELECT typed.doc_id, coalesce(strategy, 'recursive_600') AS strategy, coalesce(total, 0.0) AS chunking_score, coalesce(n_chunks, 1)::INTEGER AS n_chunks FROM typed LEFT JOIN (SELECT * FROM comp WHERE place = 1) USING (doc_id)",
    "strategy_competition": f"WITH {STRATEGIES} SELECT doc_id, strategy, total, n_chunks, place = 1 AS won FROM comp",
    "metric_sc": f"WITH {ARRAYS} SELECT doc_id, {_SC} AS sc FROM own",
    "metric_dcc": f"""WITH {CHUNKS}, e AS (SELECT doc_id, chunk_index, {_embed('chunk')} AS v FROM chk WHERE doc_id IN (SELECT doc_id FROM documents WHERE trim(text) <> '')),
p AS (SELECT doc_id, v, lead(v) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS w FROM e)
SELECT doc_id, CASE WHEN count(*) < 2 THEN 1.0 ELSE {_BOUND(f"sum(CASE WHEN w IS NOT NULL THEN {_cos('v', 'w')} END) / (count(*) - 1)")} END AS dcc FROM p GROUP BY doc_id""",
    "metric_icc": f"""WITH {CHUNKS}, s AS (SELECT doc_id, chunk_index, {_embed('chunk')} AS v, list_filter(string_split(regexp_replace(trim(chunk), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_count('s')} > 3) AS s FROM chk WHERE doc_id IN (SELECT doc_id FROM documents WHERE trim(text) <> '')),
u AS (SELECT doc_id, chunk_index, v, unnest(s) AS one FROM s), e AS (SELECT doc_id, chunk_index, v, {_embed('one')} AS w FROM u),
m AS (SELECT doc_id, chunk_index, avg({_cos('w', 'v')}) AS m FROM e GROUP BY doc_id, chunk_index)
SELECT s.doc_id, {_BOUND("avg(CASE WHEN len(s.s) < 2 THEN 1.0 ELSE m.m END)")} AS icc FROM s LEFT JOIN m USING (doc_id, chunk_index) GROUP BY s.doc_id""",
    "metric_bi": f"WITH {ARRAYS}, {_BLOCKS} SELECT doc_id, {_BI} AS bi FROM b",
    "metric_nds": f"WITH {ARRAYS}, d AS (SELECT *, {_OFF} AS off FROM own) SELECT doc_id, {_NDS} AS nds FROM d",
    "metric_tbi": f"WITH {ARRAYS}, r AS (SELECT *, {_ROWS} AS rws FROM own) SELECT doc_id, {_TBI} AS tbi FROM r",
    "metric_rc": f"""WITH {ARRAYS}, kept AS (SELECT doc_id AS k, doc_id, chunks FROM own), {_references('ref', 'own', 'kept')} SELECT k AS doc_id, rc FROM ref""",
    "metric_sps": f"WITH {ARRAYS} SELECT doc_id, {_SPS} AS sps FROM own",
    "lines_winner": f"WITH {COMPETITION} SELECT typed.doc_id, CASE WHEN n IS NULL THEN 'recursive_600' ELSE 'lines_' || n::VARCHAR END AS strategy, coalesce(total, 0.0) AS chunking_score, coalesce(n_chunks, 1)::INTEGER AS n_chunks FROM typed LEFT JOIN (SELECT * FROM comp WHERE k = 1) USING (doc_id)",
    "lines_competition": f"WITH {COMPETITION} SELECT doc_id, 'lines_' || n::VARCHAR AS strategy, total, n_chunks, k = 1 AS won FROM comp",
    "weighted_total": f"""WITH {SIG}, m AS (SELECT doc_id, section_type, {', '.join(f"(doc_id * {k + 3} % 101)::DOUBLE / 100 AS {m}" for k, m in enumerate(chunk_quality.METRICS))} FROM typed)
SELECT doc_id, section_type, {_TOTAL} AS total FROM m""",
    "candidate_strategies": f"""WITH {SIG} SELECT doc_id, 'recursive_600,recursive_1100' || CASE WHEN section_type IN ('financial_table', 'mixed') OR table_density >= 0.1 THEN ',table_aware' ELSE '' END || CASE WHEN token_count >= 300 THEN ',llm_regex' ELSE '' END AS strategies FROM typed""",
    "context_assemble": f"""WITH {RERANK}, c AS (SELECT rr.*, {_ITEM.replace('doc_id', 'pos')} AS item_number FROM rr WHERE rank <= 5)
SELECT query_id, chr(10) || chr(10) || string_agg('[SOURCE ' || rank::VARCHAR || '] ' || source || ' | 10-K FY' || (2020 + pos % 5)::VARCHAR || ' | Item ' || item_number || ' — ' || {_TITLE} || chr(10) || CASE WHEN {_TABLE} THEN '[TABLE]' ELSE '[TEXT]' END || chr(10) || trim(text), chr(10) || chr(10) || repeat('—', 60) || chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) AS context, count(*)::INTEGER AS n_sources
FROM c GROUP BY query_id""",
    "prompt_assemble": f"""WITH {QUESTIONS}, t AS (SELECT query_id, query, CASE WHEN regexp_matches(query, {_q(X.COMPARATIVE)}) THEN 'comparative' WHEN regexp_matches(query, {_q(X.ANALYTICAL)}) THEN 'analytical' ELSE 'factual' END AS k FROM ask0)
SELECT query_id, {_case('k', [(k, f'{v} {answers.CITE}') for k, v in answers.PROMPTS.items()])} AS system, 'Context:' || chr(10) || text || chr(10) || 'Question: ' || query AS "user" FROM t JOIN benchmark ON item_id = query_id""",
    "citations_extract": f"""WITH {RAW} SELECT query_id, array_to_string(regexp_extract_all(raw_answer, '(?i)\\[Source\\s+(\\d+)\\]', 1), ',') AS cited, len(regexp_extract_all(raw_answer, {_q(X.HEDGES)}))::INTEGER AS hedges FROM said""",
    "citations_validate": f"WITH {RAW}, {CHECKED} SELECT query_id, answer, array_to_string(good, ',') AS sources_cited, array_to_string(bad, ',') AS invalid_citations FROM chkd",
    "source_citations": f"""WITH {ANSWERED} SELECT res.query_id, res.rank AS source_num, res.pos, {_TICKER.format('res.pos')} AS ticker, (2020 + res.pos % 5)::INTEGER AS fiscal_year, {_ITEM.replace('doc_id', 'res.pos')} AS item_number, ce_score, left(res.text, 200) AS text_preview
FROM res JOIN chkd USING (query_id) WHERE list_contains(good, res.rank::INTEGER)""",
    "confidence_score": f"""WITH {ANSWERED}, s AS (SELECT res.query_id, count(*) AS n, count(CASE WHEN list_contains(good, res.rank::INTEGER) THEN 1 END) AS c, avg(CASE WHEN list_contains(good, res.rank::INTEGER) THEN ce_score END) AS ce FROM res JOIN chkd USING (query_id) GROUP BY res.query_id)
SELECT query_id, {_CONFIDENCE} AS confidence
FROM chkd LEFT JOIN s USING (query_id)""",
    "audit_trail": f"""WITH {ANSWERED}, e AS (SELECT query_id, count(*) AS n, string_agg(rank::VARCHAR || ':' || pos::VARCHAR || ':' || {_TICKER.format('pos')} || '_' || (2020 + pos % 5)::VARCHAR || '_' || {_ITEM.replace('doc_id', 'pos')} || ':' || ((pos % 10)::DOUBLE / 10)::VARCHAR || ':' || coalesce(bm25_rank, 0)::VARCHAR || ':' || coalesce(dense_rank, 0)::VARCHAR, ',' ORDER BY rank) AS scores,
  string_agg('lines_' || (pos % 2)::VARCHAR, ',' ORDER BY rank) AS strategies FROM res GROUP BY query_id),
s AS (SELECT res.query_id, count(*) AS n, count(CASE WHEN list_contains(good, res.rank::INTEGER) THEN 1 END) AS c, avg(CASE WHEN list_contains(good, res.rank::INTEGER) THEN ce_score END) AS ce FROM res JOIN chkd USING (query_id) GROUP BY res.query_id)
SELECT query_id, CASE WHEN regexp_matches(query, {_q(X.COMPARATIVE)}) THEN 'comparative' WHEN regexp_matches(query, {_q(X.ANALYTICAL)}) THEN 'analytical' ELSE 'factual' END AS query_type, {_CONFIDENCE} AS confidence,
  CASE WHEN e.n IS NULL THEN {_q(answers.NO_RESULTS)} ELSE '20240506T070809_' END AS id_time, '2024-05-06T07:08:09' AS timestamp_utc, 'none' AS model_used, (query_id % 9)::INTEGER AS tokens_used, coalesce(e.n, 0) AS chunks_used,
  array_to_string(good, ',') AS sources_cited, array_to_string(bad, ',') AS invalid_citations, coalesce(scores, '') AS scores, coalesce(strategies, '') AS strategies
FROM chkd LEFT JOIN s USING (query_id) LEFT JOIN e USING (query_id)""",
    "refusals": f"SELECT item_id AS query_id, {_q(answers.REFUSAL)} AS raw_answer, 0::INTEGER AS tokens_used FROM benchmark WHERE item_id % 2 = 1",
    "embed_batch": f"SELECT doc_id, array_to_string(list_transform({_embed('text')}, lambda x: x::BIGINT), ',') AS embedding, text IS NULL OR doc_id % 97 = 4 AS missing FROM documents WHERE doc_id % 97 <> 4 UNION ALL SELECT doc_id, NULL, true FROM documents WHERE doc_id % 97 = 4",
    "sections_json": f"WITH {SIG} SELECT upper(ticker) || '_' || fiscal_year::VARCHAR || '_item_' || lower(item_number) || '_' || doc_id::VARCHAR AS section_id, item_number, section_type, {_strip('text')} AS text, token_count, numerical_density, ticker, fiscal_year FROM typed",
    "chunks_json": f"WITH {CHUNKS} SELECT doc_id::VARCHAR || ':' || chunk_index::VARCHAR AS chunk_id, chunk_index, md5(chunk) AS digest FROM chk",
    "filings_json": "SELECT upper(s_name) AS ticker, lpad(s_suppkey::VARCHAR, 10, '0') AS cik, 2020 + s_nationkey AS fiscal_year, make_date(2024, 1 + s_nationkey % 12, 1) AS filing_date, left(lpad(s_suppkey::VARCHAR, 18, '0'), 10) || '-' || substr(lpad(s_suppkey::VARCHAR, 18, '0'), 11, 2) || '-' || substr(lpad(s_suppkey::VARCHAR, 18, '0'), 13, 6) AS accession_no FROM supplier",
    "filings_source": """WITH y AS (SELECT unnest([2023, 2024])::INTEGER AS fiscal_year), a AS (SELECT upper(n_name) AS ticker, y.fiscal_year, lower(n_name) AS n, n_nationkey AS k, y.fiscal_year = 2023 + n_nationkey % 2 AS ok FROM nation, y)
SELECT ticker, fiscal_year, CASE WHEN ok THEN n END AS company_name, CASE WHEN ok THEN DATE '2024-11-01' END AS filing_date, CASE WHEN ok THEN k::VARCHAR END AS accession_no, CASE WHEN NOT ok THEN 'no such filing' END AS error FROM a""",
    "dense_topk_saved": f"WITH {DENSE} {_top('den', 10)}",
    "embed_missing_antijoin": "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)",
    "pipeline_stats": f"WITH {SIG} SELECT count(*) AS sections, sum(token_count)::BIGINT AS tokens, count(DISTINCT ticker) AS companies, sum(CASE WHEN section_type = 'financial_table' THEN 1 ELSE 0 END)::BIGINT AS tables FROM typed",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}


def _whole_strip(sql: str) -> str:
    """trim(x) of one argument as trim(x, blanks): all white space, where DuckDB's own takes blanks alone."""
    out, at = [], 0
    while (k := sql.find("trim(", at)) >= 0:
        depth, commas, end, quoted = 1, 0, k + 5, False
        while depth:
            c = sql[end]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c in "([{") - (c in ")]}")
                commas += depth == 1 and c == ","
            end += 1
        out.append(sql[at : k + 5] + _whole_strip(sql[k + 5 : end - 1]) + ("" if commas else f", {_q(X.BLANKS)}") + ")")
        at = end
    return "".join([*out, sql[at:]])


ORACLE_SQL = {name: _whole_strip(sql) for name, sql in ORACLE_SQL.items()}
