"""Scalar text functions as Column expressions: tokens, densities, lines, labels, numbers, intents.

Everything is built from built-in functions, so it runs in the JVM inside the plan that uses it. Word
classes are spelled out ([\\p{L}\\p{N}_]) since the engines' own \\w differ beyond ASCII; so is white space, of which
the engines' \\s and trim know only a part, while filings are full of no-break spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all of Unicode, inside a class of a pattern, and as characters.
SPACE = r"\t-\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# These patterns decide which results are right.
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^{SPACE}\p{{L}}\p{{N}}_]"
NUMERIC = r"\$[\d,]+|\d+\.?\d*%|[\d,]+\s?bps|\d[\d,]*\.\d+|\b\d{4}\b|\b\d[\d,]{2,}\b"
SUBSECTIONS = (r"(?m)^\s*\d+\.\s+[A-Z]", r"(?m)^\s*\([a-z]\)\s+[A-Z]", r"(?m)^\s*[ivxlc]+\.\s+[A-Z]")
METRIC_TERMS = (
    r"(?i)\b(revenue|net income|earnings|profit|loss|margin|ebitda|assets|liabilities|equity|cash flow|operating income|gross margin|"
    r"return on|roa|roe|eps|dividend|capital expenditure|capex|net sales|total sales|operating expense)\b"
)
RISK_TERMS = (
    r"(?i)\b(risk|liquidity|uncertainty|regulatory|compliance|litigation|cyber|market risk|credit risk|interest rate|inflation|geopolit|"
    r"competition risk|operational risk|legal|lawsuit)\b"
)
STRATEGY_TERMS = (
    r"(?i)\b(strategy|strategic|business model|competition|growth|expansion|acquisition|investment|product|service|market position|outlook|"
    r"capital allocation|dividend policy|share repurchase)\b"
)
COMPARATIVE = r"(?i)\b(compare|versus|vs\.?|relative to|against|difference between|how does .+ compare|better|worse|higher|lower than)\b"
ANALYTICAL = (
    r"(?i)\b(why|explain|analyse|analyze|assess|evaluate|impact|implication|risk|trend|outlook|strategy|what does .+ mean|how will|forecast|"
    r"should|recommend|concern|challenge|opportunity)\b"
)
HEDGES = (
    r"(?i)\b(approximately|roughly|estimated|may|might|could|unclear|uncertain|not specified|not available|limited information|"
    r"insufficient data|cannot confirm|unclear from)\b"
)
LABEL_PREFIX = r"^[a-zA-Z]+[-_]"
LABEL_SPLIT = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
CITATION = r"(?i)\[Source\s+(\d+)\]"
#: Names as they may stand in a question.
COMPANIES = {
    "apple": "AAPL", "microsoft": "MSFT", "google": "GOOGL", "alphabet": "GOOGL", "jpmorgan": "JPM", "jp morgan": "JPM", "goldman": "GS", "goldman sachs": "GS",
    "blackrock": "BLK", "exxon": "XOM", "exxonmobil": "XOM", "chevron": "CVX", "walmart": "WMT", "amazon": "AMZN",
}
SECTORS = {
    "7372": "Technology", "7371": "Technology", "5045": "Technology", "6022": "Finance", "6211": "Finance", "6282": "Finance",
    "2911": "Energy", "1311": "Energy", "5311": "Retail", "5961": "Retail",
}


def once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(BLANKS))


def token_count(c: Column) -> Column:
    """Words and single marks: the stand-in for a model's tokens, whose vocabulary is a plug-in."""
    return F.regexp_count(c, F.lit(TOKEN))


def truncate_tokens(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(c, F.lit(rf"[{SPACE}]*[^{SPACE}]+"), 0), 1, n), "")


def whitespace_tokens(c: Column) -> Column:
    return F.filter(F.split(c, rf"[{SPACE}]+"), lambda t: t != "")


def lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n"), lambda x: strip(x) != "")


def _share(part: Column, whole: Column) -> Column:
    """0.0 for an empty whole."""
    return F.coalesce(F.try_divide(F.size(F.coalesce(part, F.array())).cast("double"), F.nullif(F.size(F.coalesce(whole, F.array())), F.lit(0))), F.lit(0.0))


def numerical_density(c: Column) -> Column:
    return once(whitespace_tokens(c), lambda toks: _share(F.filter(toks, lambda t: t.rlike("[0-9$]") & t.rlike(NUMERIC)), toks))


def is_table_line(line: Column) -> Column:
    return line.contains("|") | ((F.size(whitespace_tokens(line)) >= 3) & line.rlike(NUMERIC))


def table_density(c: Column) -> Column:
    return once(lines(c), lambda own: _share(F.filter(own, is_table_line), own))


def table_row_count(c: Column) -> Column:
    return F.size(F.filter(lines(c), is_table_line))


def avg_sentence_length(c: Column) -> Column:
    """Mean tokens of what [.!?]+ separates; decimals are cut too. 0.0 without sentences."""

    def mean(own: Column) -> Column:
        total = F.aggregate(own, F.lit(0), lambda acc, s: acc + token_count(s))
        return F.coalesce(F.round(F.try_divide(total.cast("double"), F.nullif(F.size(own), F.lit(0))), 2), F.lit(0.0))

    return once(F.filter(F.split(c, r"[.!?]+"), lambda s: strip(s) != ""), mean)


def has_subsections(c: Column) -> Column:
    return c.rlike(SUBSECTIONS[0]) | c.rlike(SUBSECTIONS[1]) | c.rlike(SUBSECTIONS[2])


def paragraph_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\n{2,}"), lambda p: strip(p) != ""))


SIGNALS = ("token_count", "numerical_density", "table_density", "avg_sentence_length", "has_subsections", "table_row_count", "paragraph_count")


def signals(c: Column) -> Column:
    """All of a section's signals as one struct."""
    return F.struct(
        token_count(c).alias("token_count"), F.round(numerical_density(c), 4).alias("numerical_density"), F.round(table_density(c), 4).alias("table_density"),
        avg_sentence_length(c).alias("avg_sentence_length"), has_subsections(c).alias("has_subsections"), table_row_count(c).alias("table_row_count"), paragraph_count(c).alias("paragraph_count"),
    )


def classify_section(default: Column, numerical: Column, table: Column) -> Column:
    mixed = ((table >= 0.20) | (numerical >= 0.15)) & (default == "narrative")
    return F.when(table >= 0.45, "financial_table").when(mixed, "mixed").otherwise(default)


def embedded_tables(c: Column) -> Column:
    """Runs of two or more lines that begin and end with a bar."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\|.+\|(?:\n\|.+\|)+)"), 1), strip)


def section_id(ticker: Column, year: Column, item: Column) -> Column:
    return F.concat_ws("_", F.upper(ticker), year.cast("string"), F.lit("item"), F.lower(item))


def chunk_id(ticker: Column, year: Column, item: Column, index: Column) -> Column:
    return F.concat(section_id(ticker, year, item), F.format_string("_chunk_%04d", index))


def normal_ticker(c: Column) -> Column:
    return F.upper(strip(c))


def normal_cik(c: Column) -> Column:
    """Ten digits at least; longer ones stay as they are."""
    t = strip(c)
    return F.when(F.length(t) < 10, F.lpad(t, 10, "0")).otherwise(t)


def dashed_accession(c: Column) -> Column:
    plain = F.regexp_replace(strip(c), "-", "")
    return F.when(plain.rlike(r"^\d{18}$"), F.concat_ws("-", F.substring(plain, 1, 10), F.substring(plain, 11, 2), F.substring(plain, 13, 6))).otherwise(c)


def title(c: Column) -> Column:
    """A capital after everything that is no letter, digits and marks among it."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), 0), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 30)))), "")


def clean_label(c: Column) -> Column:
    """us-gaap_NetIncomeLoss: one leading prefix goes, camel case is split, words get capitals."""
    t = F.regexp_replace(F.regexp_replace(strip(c), LABEL_PREFIX, ""), LABEL_SPLIT, " ")
    t = strip(F.regexp_replace(t, rf"[-_{SPACE}]+", " "))
    return F.when(strip(c).isin("nan", "None", "") | c.isNull(), "").otherwise(title(t))


def fixed_two(x: Column) -> Column:
    """x with two places as C's printf shows it: the binary value itself is rounded, half to even, not its shortest decimal as in Java.

    The fraction in units of 2^-52 times 100 fits a long; what lies below such a unit can only break a tie."""
    a = F.abs(x)
    whole = F.floor(a)
    below = (a - whole) * float(1 << 52)
    units = F.floor(below)
    hundredths = F.shiftright(units * 100, 52)
    rest = units * 100 - F.shiftleft(hundredths, 52) - (1 << 51) + (below - units) * 100
    up = (rest > 0) | ((rest == 0) & (hundredths % 2 == 1))
    places = hundredths + up.cast("long")
    shown = F.format_string("%s%d.%02d", F.when(x < 0, "-").otherwise(""), whole + (places == 100).cast("long"), places % 100)
    return F.when(a < float(1 << 52), shown).otherwise(F.format_string("%.2f", x))


def format_number(c: Column) -> Column:
    """$33.68B, $25M, $3K, percent below 2, or whole numbers with commas; words pass, missing values become a dash."""
    v = c.try_cast("double")
    a = F.abs(v)
    text = strip(c)
    whole = lambda x: F.format_string("%.0f", F.rint(x))
    return (
        F.when(F.isnan(v), "—")
        .when(a >= 1e9, F.concat(F.lit("$"), fixed_two(v / 1e9), F.lit("B")))
        .when(a >= 1e6, F.concat(F.lit("$"), whole(v / 1e6), F.lit("M")))
        .when(a >= 1e3, F.concat(F.lit("$"), whole(v / 1e3), F.lit("K")))
        .when((a > 0) & (a < 2), F.concat(fixed_two(v * 100), F.lit("%")))
        .when(v.isNotNull(), F.format_string("%,.0f", F.rint(v)))
        .when(text.isNull() | text.isin("nan", "None", ""), "—")
        .otherwise(text)
    )


def sector(sic: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SECTORS.items() for x in kv])
    return F.when(sic.isNotNull(), F.coalesce(F.try_element_at(table, sic), F.lit("Other")))


def tokenise(c: Column) -> Column:
    """Terms of the lexical index: items joined, amounts without commas, lower case, marks but $ % . gone."""
    t = F.regexp_replace(c, rf"(?i)\b(item)[{SPACE}]+(\d+[a-zA-Z]?)\b", "item_$2")
    # a comma in an amount follows its dollar sign and digits, or the comma before it and digits
    t = F.lower(F.regexp_replace(t, r"(\$\d*|(?!^)\G\d*),", "$1"))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_$%.]", " ")
    return F.filter(F.split(t, " +"), lambda x: (F.length(x) > 1) | x.startswith("$"))


def sentences(c: Column) -> Column:
    """Cut after . ! ? and white space; those of more than three tokens."""
    return F.filter(F.split(strip(c), rf"(?<=[.!?])[{SPACE}]+"), lambda s: token_count(s) > 3)


def classify_query(c: Column) -> Column:
    return F.when(c.rlike(COMPARATIVE), "comparative").when(c.rlike(ANALYTICAL), "analytical").otherwise("factual")


def intent(c: Column) -> Column:
    return F.when(c.rlike(METRIC_TERMS), "metric").when(c.rlike(RISK_TERMS), "risk").when(c.rlike(STRATEGY_TERMS), "strategy").otherwise("none")


def item_hint(c: Column) -> Column:
    return F.when(intent(c) == "risk", "1A")


def by_length(names: dict[str, str]) -> list[tuple[str, str]]:
    """Longer names first; those of equal length in their order."""
    return sorted(names.items(), key=lambda x: -len(x[0]))


def companies(c: Column) -> Column:
    """Tickers of the names in the text, by the length of the name, each once."""
    low = F.lower(c)
    return F.array_distinct(F.array_compact(F.array(*(F.when(low.contains(name), ticker) for name, ticker in by_length(COMPANIES)))))


def hedges(c: Column) -> Column:
    return F.regexp_count(c, F.lit(HEDGES))


def cited(c: Column) -> Column:
    """Source numbers in order of appearance, repeated as they are."""
    return F.transform(F.regexp_extract_all(c, F.lit(CITATION), 1), lambda n: n.cast("int"))


def html_text(c: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags gone, block ends as newlines, entities decoded."""
    t = F.regexp_replace(c, r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|table|section|article)\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n"))
