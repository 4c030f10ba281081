"""Operators against hand-made rows and plain restatements."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import providers
from tessera.functions import text as X
from tessera.operators import answers, chunk_quality, chunking, ingest, search
from tessera.sources import tables
from tessera.streaming import incremental


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", make(F.col("v")).alias("x")).orderBy("k").collect()]


# --- text ---


def test_numeric_tokens(spark):
    got = column(spark, ["$1,200 sold", "12.5% up", "25 bps 3.14", "2024 12", "1,200 a b c", "", "no numbers"], X.numerical_density)
    assert got == [0.5, 0.5, 1 / 3, 0.5, 0.25, 0.0, 0.0]


def test_tokenise(spark):
    got = column(spark, ["Item 7A: revenue. $1,200,300 (Été) a_b x $ 5%", "revenue, and-more", ""], X.tokenise)
    assert got == [["item_7a", "revenue.", "$1200300", "été", "a_b", "$", "5%"], ["revenue", "and", "more"], []]


def test_signals(spark):
    text = "1. First item here\nplain line\n| a | b |\nthree words 2024\n\nNext paragraph. Yes!"
    s = column(spark, [text, ""], X.signals)[0]
    assert (s.table_row_count, s.has_subsections, s.paragraph_count) == (2, True, 2)
    assert s.table_density == 0.4
    for line, want in (("(a) Some text", True), ("iv. Roman", True), ("a) no", False), ("1. lower", False)):
        assert column(spark, [line], X.has_subsections) == [want]


def test_classify_section(spark):
    df = spark.createDataFrame([("narrative", 0.0, 0.45), ("narrative", 0.15, 0.0), ("narrative", 0.0, 0.2), ("mixed", 0.9, 0.3), ("narrative", 0.1, 0.1)], "d string, n double, t double")
    assert [r.x for r in df.select(X.classify_section(F.col("d"), F.col("n"), F.col("t")).alias("x")).collect()] == ["financial_table", "mixed", "mixed", "mixed", "narrative"]


def test_labels_and_numbers(spark):
    assert column(spark, ["us-gaap_NetIncomeLoss", "jpm_TotalAssets", "EBITDAMargin", "", None, "nan"], X.clean_label) == ["Gaap Net Income Loss", "Total Assets", "Ebitda Margin", "", "", ""]
    assert column(spark, ["33680000000.0", "2.6e6", "1700", "1.5", "0", "nan", "", None, "text", "-5", "999"], X.format_number) == ["$33.68B", "$3M", "$2K", "150.00%", "0", "—", "—", "—", "text", "-5", "999"]


def test_keys(spark):
    assert column(spark, [" aapl "], X.normal_ticker) == ["AAPL"]
    assert column(spark, ["320193", "12345678901"], X.normal_cik) == ["0000320193", "12345678901"]
    assert column(spark, ["000032019324000123", "x"], X.dashed_accession) == ["0000320193-24-000123", "x"]
    assert column(spark, ["7372", "3571", None], X.sector) == ["Technology", "Other", None]


def test_companies_and_intent(spark):
    assert column(spark, ["Apple vs Goldman Sachs", "pineapple", "google and alphabet", "none", "JP Morgan or jpmorgan and Microsoft"], X.companies) == [["GS", "AAPL"], ["AAPL"], ["GOOGL"], [], ["MSFT", "JPM"]]
    assert column(spark, ["revenue risk", "cyber threats", "cybersecurity", "growth plan", "hello"], X.intent) == ["metric", "risk", "none", "strategy", "none"]
    assert column(spark, ["compare a and b", "why so", "who"], X.classify_query) == ["comparative", "analytical", "factual"]


def test_html(spark):
    html = "<html><head><title>t</title></head><body><script>x<y</script><p>A &amp; B</p><br>c&nbsp;d<!-- no --></body></html>"
    assert column(spark, [html], X.html_text) == ["A & B\nc d"]


# --- ingest ---


def test_sections_and_picking(spark):
    filings = spark.createDataFrame([("a", "2023-12-31", "2024-02-01", "1", " Biz ", "", None), ("A", "2024-12-31", "2025-02-01", "2", None, "risk", "x | y")], "ticker string, period_of_report string, filing_date string, accession_no string, business string, risk_factors string, management_discussion string")
    asked = spark.createDataFrame([("a", 2023), ("A", 2019)], "ticker string, fiscal_year int")
    got = {r.fiscal_year: r.accession_no for r in ingest.pick_filing(asked, filings).collect()}
    assert got == {2023: "1", 2019: "2"}
    rows = ingest.sections(filings.withColumn("fiscal_year", F.lit(2024))).select("item_number", "section_type", "text", "section_id").collect()
    assert sorted((r.item_number, r.section_type, r.text) for r in rows) == [("1", "narrative", "Biz"), ("1A", "narrative", "risk"), ("7", "financial_table", "x | y")]
    assert {r.section_id for r in rows} == {"A_2024_item_1", "A_2024_item_1a", "A_2024_item_7"}


def test_statement(spark):
    assert ingest.kept_columns(["concept", "Label", "2024 12 31 (FY)", "units", "Some Long Name", "level", "1Q"]) == ["2024 12 31 (FY)", "Some Long Name", "1Q"]
    rows = spark.createDataFrame([(1, 1, "Revenue", "us_Rev", 2.5e9, None), (1, 2, None, "us_NetIncome", 1.0e6, 5.0), (1, 3, "Empty", "e", None, None)], "k int, o int, label string, concept string, `2024 12 31` double, `2023` double")
    table = ingest.statement_markdown(rows, "k", "o").first().table
    assert table.split("\n") == ["| Metric | FY2024 | FY2023 |", "| --- | --- | --- |", "| Revenue | $2.50B | — |", "| Net Income | $1M | 5 |"]
    assert ingest.statement_markdown(rows.filter("o = 3"), "k", "o").count() == 0


# --- search ---


def test_bm25_against_formula(spark):
    docs = ["apple pie apple", "banana pie", "cherry", "apple banana cherry date", ""]
    index = search.build_lexical(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    toks = [d.split() for d in docs]
    n, mean = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(w for t in toks for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: low if x < 0 else x for w, x in idf.items()}
    query = ["apple", "pie", "apple", "unknown"]
    want = {k: sum(idf.get(q, 0) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for q in query) for k, t in enumerate(toks)}
    got = {r.pos: r.score for r in search.lexical_scores(index, spark.createDataFrame([(0, " ".join(query))], "query_id long, query string")).collect()}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in want.items() if v}


def test_postfilter_returns_fewer(spark):
    vectors = spark.createDataFrame([(k, [1.0 - k / 1000, 0.0]) for k in range(300)] + [(300, None)], "pos long, vector array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query_vector array<double>")
    keep = vectors.filter("pos >= 15").select("pos")
    assert [r.pos for r in search.dense_top_k(vectors, asked, 2, keep).collect()] == [15, 16]
    assert search.dense_top_k(vectors, asked, 2, vectors.filter("pos >= 20").select("pos")).count() == 0
    assert [r.pos for r in search.dense_top_k(vectors, asked, 2, vectors.filter("pos >= 20").select("pos"), strict_prefilter=True).collect()] == [20, 21]


def test_zero_vectors(spark):
    assert column(spark, [[0.0, 0.0], [3.0, 4.0]], search.normalise, "array<double>") == [[0.0, 0.0], [0.6, 0.8]]
    df = spark.createDataFrame([([0.0], [1.0]), ([2.0], [1.0])], "a array<double>, b array<double>")
    assert [r.x for r in df.select(search.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [0.0, 1.0]


def test_routing(spark):
    asked = spark.createDataFrame([(0, "Apple revenue against Microsoft", None, None), (1, "Apple or Microsoft risk", None, None), (2, "risk", "GS", None), (3, "Apple and Exxon", None, "2"), (4, "hello", None, None), (5, "legal risk of Chevron", None, None)], "query_id long, query string, ticker string, item_number string")
    got = {}
    for r in search.routed(asked).collect():
        got.setdefault(r.query_id, []).append((r.job, r.ticker, r.item_number, r.weight))
    assert sorted(got[0]) == [(0, "MSFT", "8", 1.0), (1, "MSFT", "7", 0.8), (2, "AAPL", "8", 1.0), (3, "AAPL", "7", 0.8)]
    assert sorted(got[1]) == [(0, "MSFT", "1A", 1.0), (1, "AAPL", "1A", 1.0)]
    assert got[2] == [(0, "GS", "1A", 1.0)] and sorted(got[3]) == [(0, "AAPL", "2", 1.0), (1, "XOM", "2", 1.0)]
    assert got[4] == [(0, None, None, 1.0)] and got[5] == [(0, "CVX", "1A", 1.0)]


def test_dedup_and_fusion(spark):
    ranked = spark.createDataFrame([(0, 0, 10, 5.0, 1), (0, 0, 11, 4.0, 2), (0, 1, 12, 9.0, 1), (0, 1, 11, 6.0, 2)], "query_id long, job int, pos long, score double, rank int")
    got = [(r.pos, r.score, r.rank) for r in search.dedup(ranked).orderBy("rank").collect()]
    assert got == [(10, 5.0, 1), (11, 6.0, 2), (12, 9.0, 3)]
    dense = spark.createDataFrame([(0, 11, 0.9, 1), (0, 13, 0.8, 2)], "query_id long, pos long, score double, rank int")
    fused = {r.pos: r.rrf_score for r in search.fuse(search.dedup(ranked), dense).collect()}
    assert fused == {10: round(1 / 61, 6), 11: round(1 / 62 + 1 / 61, 6), 12: round(1 / 63, 6), 13: round(1 / 62, 6)}


def test_rerank_orders(spark):
    rows = spark.createDataFrame([(0, "red fox", 1, "nothing", 0.5, 1), (0, "red fox", 2, "a red fox", 0.4, 2), (0, "red fox", 3, "red", 0.3, 3)], "query_id long, query string, pos long, text string, rrf_score double, rank int")
    got = search.rerank(rows, 2).orderBy("rank").collect()
    assert [(r.pos, r.ce_score) for r in got] == [(2, round(1 / (1 + math.exp(-4)), 4)), (3, 0.5)]
    assert [r.pos for r in search.rerank(rows, 3, None).orderBy("rank").collect()] == [1, 2, 3]
    assert {r.pos: r.movement for r in search.rank_movement(search.rerank(rows, 3)).collect()} == {1: -2, 2: 1, 3: 1}


def test_filters(spark):
    df = spark.createDataFrame([("AAPL", 2024, "7"), ("MSFT", 2024, "8")], "ticker string, fiscal_year int, item_number string")
    assert df.filter(search.filter_column({"ticker": "aapl", "fiscal_year": "2024", "unknown": 1})).count() == 1
    assert df.filter(search.filter_column({})).count() == 2


def test_plans_stay_distributed(spark):
    docs = spark.createDataFrame([(k, f"term{k % 7} other") for k in range(50)], "doc_id long, text string")
    index = search.build_lexical(docs)
    plan = search.lexical_top_k(index, spark.createDataFrame([(0, "term1 other")], "query_id long, query string"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


# --- chunking ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "a", "longerword.", "\n\n", "\n", ". ", "|---|", "x" * 90]), max_size=120), st.integers(8, 60))
def test_recursive_properties(parts, size):
    text = " ".join(parts)
    config = chunking.ChunkConfig(min_tokens=1)
    out = chunking.recursive(text, size, size // 5, config)
    assert all(c == c.strip() and c for c in out)
    assert all(chunking.count_tokens(p) <= size for p in chunking.pieces(text.strip(), size, config.separators)) if text.strip() else out == []
    assert set("".join(text.split())) <= set("".join("".join(out).split())) | set()
    if size // 5 == 0:
        assert Counter("".join(out).split()) == Counter(text.split())


def test_overlap_and_small_chunks():
    config = chunking.ChunkConfig(min_tokens=3)
    text = " ".join(f"w{k}" for k in range(25))
    out = chunking.recursive(text, 10, 2, config)
    assert out[0].split() == [f"w{k}" for k in range(10)] and out[1].split()[:2] == ["w8", "w9"]
    assert chunking.glue_small(iter(["a", "b b b b", "c"]), 3) == ["a", "b b b b\nc"]
    assert chunking.cut("a\n\n\nb", "\n\n", 9) == ["a\n\n", "\nb"] and chunking.cut("abcdefgh", "", 8) == ["ab", "cd", "ef", "gh"]


def test_tables_stay_whole():
    text = "Prose before.\n|---|---|\n||||\nprose | one bar\nAfter."
    assert chunking.table_blocks(text, 0.5) == [("Prose before.", False), ("|---|---|\n||||", True), ("prose | one bar\nAfter.", False)]
    assert "|---|---|\n||||" in chunking.table_aware(text, chunking.ChunkConfig(min_tokens=1))


def test_patterns():
    assert [chunking.valid_pattern(p) for p in (None, "", "x", "(", "a*", "ab")] == [False, False, False, False, False, True]
    assert chunking.split_by_pattern("one. two. three", r"\. ") == ["one.", "two.", "three"]
    small = chunking.ChunkConfig(small_size=20, small_overlap=2, large_size=30, large_overlap=3, min_tokens=2, pattern_min_tokens=5)
    assert chunking.run_strategy("llm_regex", "a b c d. e f g h. i", small, r"\. ") == ["a b c d.", "e f g h.\ni"]
    assert chunking.run_strategy("unknown", "short", small) == ["short"] and chunking.run_strategy("llm_regex", " ", small) == [""]


def test_islands_equal_blocks(spark):
    texts = ["a\n|---|\n||\nb\n\nc", "|-|\n|-|", "x", "\n\n|--|\n\n"]
    got = Counter((r.doc_id, r.is_table) for r in chunking.table_islands(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == Counter((k, t) for k, x in enumerate(texts) for _, t in chunking.table_blocks(x, 0.5))


# --- quality of chunks ---


def scored(spark, text, chunks, item="7", kind="narrative", density=0.1):
    df = spark.createDataFrame([(1, 0, "s", text, chunks, item, kind, density)], "doc_id long, ord int, strategy string, text string, chunks array<string>, item_number string, section_type string, numerical_density double")
    return chunk_quality.score(df).first()


def test_metrics(spark):
    text = "Item 7 Overview of the year\n| a | 1 |\n| --- | --- |\n| b | 2 |\n\nApple grew fast. It sold more."
    r = scored(spark, text, ["Item 7 Overview of the year\n| a | 1 |", "| b | 2 |\nItem 8 here Apple grew fast.", "It sold more."])
    assert (r.tbi, r.sps) == (1.0, round(2 / 3, 4))
    # the first paragraph and the separator row are in no chunk; two rows and the header are
    assert r.bi == 0.6
    assert scored(spark, text, ["| a |", "1 |"]).tbi == 0.0
    assert r.sc == 0.0 and r.total == pytest.approx(sum(getattr(r, m) * w for m, w in chunk_quality.WEIGHTS["narrative"].items()), abs=1e-4)
    assert all(round(sum(w.values()), 9) == 1 for w in chunk_quality.WEIGHTS.values())


def test_reference_share():
    text = "Apple sold phones. It grew."
    assert chunk_quality.reference_share(text, [text]) == 1.0
    assert chunk_quality.reference_share(text, ["Apple sold phones.", "It grew."]) == 0.0
    assert chunk_quality.reference_share("nothing here", ["nothing", "here"]) == 1.0


def test_density_spread(spark):
    assert scored(spark, "x", ["1000 2000", "a b"], density=0.5).nds == 0.0
    assert scored(spark, "x", ["1000 2000", "a b"], density=0.01).nds == 1.0
    assert scored(spark, "x", ["1000 a b c"], density=0.475).nds == pytest.approx(0.5)


def test_winner_and_fallback(spark):
    rows = spark.createDataFrame([(1, "a", 0, 0.5, ["x", "y"]), (1, "b", 1, 0.5, ["x"]), (1, "c", 2, 0.5, ["x"]), (2, "a", 0, 0.1, ["x"]), (2, "b", 1, 0.9, ["x"] * 9)], "doc_id long, strategy string, ord int, total double, chunks array<string>")
    won = chunk_quality.winners(rows)
    assert {r.doc_id: r.strategy for r in won.collect()} == {1: "b", 2: "b"}
    own = chunk_quality.with_fallback(won, spark.createDataFrame([(1, "t"), (3, " t ")], "doc_id long, text string"))
    assert {(r.doc_id, r.strategy, r.chunking_score) for r in own.collect()} == {(1, "b", 0.5), (3, "recursive_600", 0.0)}


# --- answers ---


def test_citations(spark):
    raw = spark.createDataFrame([(0, "q", "A [Source 1] b [source  9] c [Source 2][Source 9].  End", [1, 2, 3]), (1, "q", "none", None)], "query_id long, query string, raw_answer string, source_numbers array<int>")
    got = {r.query_id: r for r in answers.validate(raw).collect()}
    assert (got[0].answer, got[0].sources_cited, got[0].invalid_citations) == ("A [Source 1] b c [Source 2]. End", [1, 2], [9, 9])
    assert (got[1].answer, got[1].sources_cited) == ("none", [])


def test_confidence(spark):
    results = spark.createDataFrame([(0, 1, 10, 0.9, 0.03), (0, 2, 11, 0.5, 0.02), (1, 1, 10, None, 0.04), (1, 2, 11, None, 0.02), (3, 1, 10, 0.9, 0.03)], "query_id long, rank int, pos long, ce_score double, rrf_score double")
    raw = spark.createDataFrame([(0, "q", "a b [Source 1]", [1, 2]), (1, "q", "a [Source 1][Source 2]", [1, 2]), (2, "q", "x", []), (3, "q", "may could might", [1])], "query_id long, query string, raw_answer string, source_numbers array<int>")
    got = {r.query_id: r.confidence for r in answers.confidence(results, answers.validate(raw)).collect()}
    assert got == {0: pytest.approx(0.5 * 0.9 + 0.15 + 0.2), 1: pytest.approx(0.5 * 0.75 + 0.3 + 0.2), 2: 0.0, 3: pytest.approx(0.15)}


def test_context_and_writer(spark):
    results = spark.createDataFrame([(0, 2, "Co", 2024, "7", "MDA", False, " two "), (0, 1, "Co", 2024, "8", "FS", True, "| one |")], "query_id long, rank int, company_name string, fiscal_year int, item_number string, item_title string, is_table_chunk boolean, text string")
    r = answers.assemble_context(results).first()
    assert r.source_numbers == [1, 2] and r.context.startswith("\n\n[SOURCE 1] Co | 10-K FY2024 | Item 8 — FS\n[TABLE]\n| one |\n\n" + "—" * 60)
    assert providers.ExtractiveWriter().write([r.context]) == ["| one | [Source 1] two [Source 2]"]


# --- providers, sources, streaming ---


class Flaky:
    calls = 0

    def embed(self, texts):
        Flaky.calls += 1
        if Flaky.calls < 3:
            raise RuntimeError("busy")
        return [[1.0]] * len(texts)


def test_retries():
    assert providers.with_retries(Flaky().embed, ["a", "b"], attempts=4, pause=0.0) == [[1.0], [1.0]]
    failed = providers.with_retries(lambda x: 1 / 0, ["a", "b"], attempts=2, pause=0.0)
    assert failed == ["ZeroDivisionError: division by zero"] * 2 and all(isinstance(x, providers.Failed) for x in failed)


def test_provider_over_a_column(spark):
    df = spark.createDataFrame([(0, "a b"), (1, None)], "k int, v string")
    got = {r.k: r.e for r in providers.map_provider(df, "v", "e", "array<float>", providers.HashEmbedder, "embed").collect()}
    assert got[1] is None and sum(x * x for x in got[0]) == pytest.approx(1)


def test_json_round_trip(spark, tmp_path):
    (tmp_path / "AAPL.json").write_text('{"company_name": "Apple", "ticker": " aapl", "cik": "320193", "fiscal_year": 2024, "filing_date": "2024-11-01T00:00", "accession_no": "000032019324000123", "sic_code": "3571"}')
    r = tables.read_filings(spark, str(tmp_path)).first()
    assert (r.ticker, r.cik, str(r.filing_date), r.accession_no, r.sector) == ("AAPL", "0000320193", "2024-11-01", "0000320193-24-000123", "Other")
    own = ingest.sections(spark.createDataFrame([("AAPL", "Apple", 2024, "text one", "risk two")], "ticker string, company_name string, fiscal_year int, business string, risk_factors string")).withColumn("source_url", F.lit("u"))
    tables.write_sections(own, f"{tmp_path}/sections")
    back = tables.read_sections(spark, f"{tmp_path}/sections/*", lines=True)
    assert sorted((x.section_id, x.text, x.ticker) for x in back.collect()) == [("AAPL_2024_item_1", "text one", "AAPL"), ("AAPL_2024_item_1a", "risk two", "AAPL")]


def test_indexes_round_trip(spark, tmp_path):
    assert tables.read_chunks(spark, f"{tmp_path}/none").count() == 0
    docs = spark.createDataFrame([(0, "apple pie"), (1, "banana")], "doc_id long, text string")
    index = search.build_lexical(docs)
    tables.save_lexical(index, f"{tmp_path}/bm25")
    again = tables.load_lexical(spark, f"{tmp_path}/bm25")
    asked = spark.createDataFrame([(0, "apple")], "query_id long, query string")
    assert search.lexical_scores(again, asked).collect() == search.lexical_scores(index, asked).collect()


def test_stream_adds_once(spark, tmp_path):
    rng = random.Random(1)
    text = "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma."]) for _ in range(40)) for _ in range(5))
    docs = spark.createDataFrame([(k, text, "en", "src", len(text)) for k in range(3)], incremental.DOCUMENT)
    docs.write.parquet(f"{tmp_path}/in")
    incremental.stream_documents(spark, f"{tmp_path}/in", f"{tmp_path}/chunks", f"{tmp_path}/state").awaitTermination()
    first = spark.read.parquet(f"{tmp_path}/chunks").count()
    incremental.append_new(docs, f"{tmp_path}/chunks")
    assert first >= 3 and spark.read.parquet(f"{tmp_path}/chunks").count() == first
    more = docs.withColumn("doc_id", F.col("doc_id") + 10)
    more.write.mode("append").parquet(f"{tmp_path}/in")
    incremental.stream_documents(spark, f"{tmp_path}/in", f"{tmp_path}/chunks", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/chunks").count() == 2 * first


def test_entry_stands_without_the_llm_folder(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert re.search(r"\d+ \d+ False", said.stdout), said.stderr
