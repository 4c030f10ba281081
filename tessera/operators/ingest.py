"""From filings to typed sections: picking a filing, unpivoting its items, statements as tables, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# The items of an annual report, their titles and usual kinds.
ITEMS = (
    ("business", "1", "Business", "narrative"),
    ("risk_factors", "1A", "Risk Factors", "narrative"),
    ("unresolved_staff_comments", "1B", "Unresolved Staff Comments", "narrative"),
    ("properties", "2", "Properties", "narrative"),
    ("legal_proceedings", "3", "Legal Proceedings", "narrative"),
    ("management_discussion", "7", "Management's Discussion and Analysis", "mixed"),
    ("market_risk", "7A", "Quantitative and Qualitative Disclosures about Market Risk", "narrative"),
    ("controls_and_procedures", "9A", "Controls and Procedures", "narrative"),
)
ITEM_8 = ("8", "Financial Statements and Supplementary Data", "financial_table")
#: Columns of a statement that describe the taxonomy and hold no values.
META_COLUMNS = ("concept", "label", "level", "abstract", "dimension", "breakdown", "axis", "member", "balance", "weight", "sign", "member label", "abstract concept", "concept label")
DEFAULT_CORPUS = tuple(dict.fromkeys(X.COMPANIES.values()))
MISSING = ("nan", "None", "", "—")


def default_corpus(spark: SparkSession, year: int = 2024) -> DataFrame:
    return spark.createDataFrame([(t, year) for t in sorted(DEFAULT_CORPUS)], "ticker string, fiscal_year int")


def pick_filing(requests: DataFrame, filings: DataFrame) -> DataFrame:
    """For each requested ticker and year its filing: the latest whose period is of that year, else the latest of all.

    The requested year names the result either way."""
    asked = requests.select(X.normal_ticker(F.col("ticker")).alias("ticker"), F.col("fiscal_year").alias("requested"))
    own = filings.drop("fiscal_year").withColumn("ticker", X.normal_ticker(F.col("ticker")))
    rank = F.struct(F.col("period_of_report").startswith(F.col("requested").cast("string")).cast("int").alias("fits"), F.to_date(F.left(F.col("filing_date").cast("string"), F.lit(10))).alias("filed"), F.col("accession_no"))
    joined = asked.join(own, "ticker")
    best = joined.groupBy("ticker", "requested").agg(F.max_by(F.struct(*[c for c in own.columns if c != "ticker"]), rank).alias("f"))
    return best.select("ticker", F.col("requested").alias("fiscal_year"), "f.*").withColumn("accession_no", X.dashed_accession(F.col("accession_no")))


def sections(filings: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """One row an item that has text: the items' columns of a filing become rows.

    statements (ticker, fiscal_year, text, tables), as from financial_sections, add item 8."""
    present = [i for i in ITEMS if i[0] in filings.columns]
    each = F.array(*(F.struct(F.lit(n).alias("item_number"), F.lit(t).alias("item_title"), F.lit(k).alias("default_type"), X.strip(F.col(c)).alias("text")) for c, n, t, k in present))
    rest = [c for c in filings.columns if c not in {i[0] for i in ITEMS}]
    items = filings.select(*rest, F.inline(each)).filter("text <> ''")
    if statements is None:
        return typed(items)
    number, title, kind = ITEM_8
    own = statements.select("ticker", "fiscal_year", F.lit(number).alias("item_number"), F.lit(title).alias("item_title"), F.lit(kind).alias("default_type"), X.strip(F.col("text")).alias("text"), F.col("tables").alias("statement_tables"))
    eighth = filings.select(*rest).join(own, ["ticker", "fiscal_year"]).filter("text <> ''")
    both = typed(items.unionByName(eighth, allowMissingColumns=True))
    return both.withColumn("tables", F.coalesce("statement_tables", "tables")).drop("statement_tables")


def typed(rows: DataFrame) -> DataFrame:
    """Adds signals, section_type and section_id to rows with ticker, fiscal_year, item_number, default_type and text."""
    # columns of their own that are read more than once: fields of a struct would be found anew for each reader
    shares = ("numerical_density", "table_density")
    own = X.signals(F.col("text"))
    out = rows.withColumns({f"_{c}": own[c] for c in shares})
    out = out.withColumn("signals", F.struct(*((F.col(f"_{c}") if c in shares else own[c]).alias(c) for c in X.SIGNALS)))
    kind = F.when(F.col("item_number") == "8", "financial_table").otherwise(X.classify_section(F.col("default_type"), *(F.col(f"_{c}") for c in shares)))
    out = out.withColumn("section_type", kind).drop(*(f"_{c}" for c in shares))
    out = out.withColumn("section_id", X.section_id(F.col("ticker"), F.col("fiscal_year"), F.col("item_number")))
    tables = F.when(F.col("section_type") != "narrative", X.embedded_tables(F.col("text"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("tables", tables)


def kept_columns(columns: list[str]) -> list[str]:
    """Columns of a statement with values: those with a year, and those of several words that are no taxonomy."""
    import re

    def keeps(c: str) -> bool:
        s = c.strip()
        if re.search(r"\d{4}", s):
            return True
        return s.lower() not in META_COLUMNS and (len(s.split()) > 1 or s[:1].isdigit())

    return [c for c in columns if keeps(c)]


def _label(raw: str) -> str:
    """What clean_label does, of a column's name."""
    import re

    found = re.sub(X.LABEL_SPLIT, " ", re.sub(X.LABEL_PREFIX, "", raw.strip()))
    return " ".join(re.split(r"[-_\s]+", found)).strip().title()


def heading(column: str) -> str:
    """A column with a year is named by it, others like a label."""
    import re

    year = re.search(r"\d{4}", column)
    return f"FY{year[0]}" if year else _label(column) or column.strip()


def statement_markdown(rows: DataFrame, key: str, order: str, label: str = "label", concept: str = "concept", title: str = "") -> DataFrame:
    """A statement a key as one markdown table: key, table. Rows without any value are left out, empty tables too.

    A row is named by its label or, where that is missing, by its concept; statements without a label column by their concepts."""
    kept = [c for c in kept_columns(rows.columns) if c not in (key, order)]
    own = {f.name: f.dataType.typeName() for f in rows.schema}

    def value(c: str) -> Column:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return F.when(F.isnan(f"`{c}`"), F.lit("nan")).otherwise(text) if own[c] in ("double", "float") else text

    line_of = lambda c: F.replace(c, F.lit("\n"), F.lit(" "))
    stated = X.strip(F.col(label)) if label in own else F.lit("")
    name = F.when(F.coalesce(stated, F.lit("")).isin("nan", "None", ""), F.coalesce(F.nullif(X.clean_label(F.col(concept)), F.lit("")), X.strip(F.col(concept)))).otherwise(stated)
    line = F.concat(F.lit("| "), line_of(name), F.lit(" | "), F.array_join(F.array(*(line_of(X.format_number(value(c))) for c in kept)), " | "), F.lit(" |"))
    full = F.lit(False)
    for c in kept:
        full = full | ~X.strip(value(c)).isin(*MISSING)
    body = rows.filter(full).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("lines"))
    head = ([f"### {title}", ""] if title else []) + ["| Metric | " + " | ".join(map(heading, kept)) + " |", "| --- | " + " | ".join(["---"] * len(kept)) + " |"]
    return body.select(key, F.concat_ws("\n", F.lit("\n".join(head)), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("table"))


def financial_sections(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """key, text, tables of item 8: tables (key, ord, title, table) of the primary path, the fallback's only for keys without any."""
    rest = fallback.join(primary.select(key).distinct(), key, "left_anti")
    text = F.concat(F.lit("["), F.col("title"), F.lit("]\n"), F.col("table"))
    packed = primary.unionByName(rest).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", text.alias("text"), "table"))).alias("t"))
    return packed.select(key, F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"), F.transform("t", lambda x: x["table"]).alias("tables"))


def sections_view(docs: DataFrame) -> DataFrame:
    """Documents as sections: ticker from the source, item and year from doc_id, sector from the language."""
    item = F.element_at(F.array(F.lit("1"), F.lit("1A"), F.lit("7"), F.lit("8")), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = docs.filter(X.strip(F.col("text")) != "").select("doc_id", F.upper("source").alias("ticker"), F.col("source").alias("company_name"), (F.lit(2020) + F.col("doc_id") % 5).cast("int").alias("fiscal_year"), item.alias("item_number"), F.col("lang").alias("sector"), "text")
    names = {n: (t, k) for _, n, t, k in ITEMS} | {ITEM_8[0]: ITEM_8[1:]}
    pick = lambda k: F.element_at(F.create_map(*[F.lit(x) for n, v in names.items() for x in (n, v[k])]), F.col("item_number"))
    return rows.withColumn("item_title", pick(0)).withColumn("default_type", pick(1))


def type_counts(typed_sections: DataFrame) -> DataFrame:
    return typed_sections.groupBy("section_type").agg(F.count("*").alias("sections"), F.sum("signals.token_count").alias("tokens"))


def run_ingestion(spark: SparkSession, filings: DataFrame, requests: DataFrame | None = None, statements: DataFrame | None = None, **chunking_options) -> DataFrame:
    """From filings to chunks in one call: the filing of each request (the default corpus without any), its sections, their best chunks.

    An error if no filing or no section is found."""
    from . import build

    picked = pick_filing(default_corpus(spark) if requests is None else requests, filings)
    if picked.isEmpty():
        raise ValueError("no filings for these requests")
    found = sections(picked, statements)
    if found.isEmpty():
        raise ValueError("no sections in these filings")
    return build.chunk_table(found, **chunking_options)
