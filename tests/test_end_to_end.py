"""White space and labels as Python has them, providers, stores and the engine from filings to audited answers."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import providers
from tessera.functions import text as X
from tessera.operators import answers, blocks, build, chunk_quality, chunking, ingest, postings, search
from tessera.sources import shared, tables


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", make(F.col("v")).alias("x")).orderBy("k").collect()]


# --- text ---

SPACED = ["\n\n", " a\u00a0", "\u2003x y\u3000\x1c", "10\u00a0000 $5\u00a0up a", "", "\x85"]


def test_strip_is_pythons(spark):
    assert column(spark, SPACED, X.strip) == [x.strip() for x in SPACED]
    assert [c for c in map(chr, range(0x110000)) if c.isspace()] == sorted(X.BLANKS)


def test_no_break_spaces_part_tokens(spark):
    assert column(spark, SPACED, lambda c: F.size(X.whitespace_tokens(c))) == [len(x.split()) for x in SPACED]
    assert column(spark, ["Item\u00a07 here"], lambda c: F.array_join(X.tokenise(c), " ")) == ["item_7 here"]


def test_amounts_lose_their_commas(spark):
    texts = ["$1,234,567 and 1,234", "$,5 $,,,", "a$1,2b,c", "," * 5 + "$" + "1," * 100 + "9", "x,$3,4,x"]
    want = [["$1234567", "and", "234"], ["$5", "$"], ["a$12b"], ["$" + "1" * 100 + "9"], ["$34x"]]
    assert column(spark, texts, X.tokenise) == want
    assert [chunk_quality.terms(t) for t in texts] == want


@pytest.mark.parametrize("raw, want", [("us-gaap_Tier1capitalRatio", "Gaap Tier1Capital Ratio"), ("us_Tier1capital Ratio", "Tier1Capital Ratio"), ("jpm_TotalAssets\u00a0", "Total Assets"), ("bob's x", "Bob'S X"), ("", "")])
def test_labels_are_titled_like_python(spark, raw, want):
    assert column(spark, [raw], X.clean_label) == [want]
    assert ingest._label(raw) == want


# --- ingest ---


def test_blank_sections_go(spark):
    filings = spark.createDataFrame([("A", 2024, "\n\n", "\u00a0risk\n")], "ticker string, fiscal_year int, business string, risk_factors string")
    assert [(r.item_number, r.text) for r in ingest.sections(filings).collect()] == [("1A", "risk")]


def test_item_8_joins_the_items(spark):
    filings = spark.createDataFrame([("A", 2024, "business text"), ("B", 2024, "other")], "ticker string, fiscal_year int, business string")
    statements = spark.createDataFrame([("A", 2024, "[Income]\n| a | 1 |", ["| a | 1 |"])], "ticker string, fiscal_year int, text string, tables array<string>")
    rows = {(r.ticker, r.item_number): r for r in ingest.sections(filings, statements).collect()}
    assert set(rows) == {("A", "1"), ("A", "8"), ("B", "1")}
    assert (rows["A", "8"].section_type, rows["A", "8"].tables, rows["A", "8"].section_id) == ("financial_table", ["| a | 1 |"], "A_2024_item_8")


def test_statement_rows_of_nan_go_and_headings_are_cleaned(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1, 1, "A\nB", "c", 1.0, nan, "x\ny"), (1, 2, "Gone", "c", nan, nan, None), (1, 3, "Text", "c", nan, 5.0, "\u00a0")], "k int, o int, label string, concept string, `2024` double, `Per-Share Amount` double, `Some Note` string")
    assert ingest.statement_markdown(rows, "k", "o").first().table.split("\n") == ["| Metric | FY2024 | Share Amount | Some Note |", "| --- | --- | --- | --- |", "| A B | 100.00% | — | x y |", "| Text | — | 5 | — |"]
    assert ingest.statement_markdown(rows.drop("label"), "k", "o").first().table.split("\n")[2].startswith("| C |")


def test_default_corpus_and_ingestion(spark):
    assert ingest.default_corpus(spark).count() == len(set(X.COMPANIES.values())) == 10
    filings = spark.createDataFrame([("aapl", "2024-09-28", "2024-11-01", "000032019324000123", "What the business is about. " * 20, "One risk.")], "ticker string, period_of_report string, filing_date string, accession_no string, business string, risk_factors string")
    chunks = ingest.run_ingestion(spark, filings)
    assert sorted(r.chunk_id for r in chunks.collect()) == ["AAPL_2024_item_1_chunk_0000", "AAPL_2024_item_1a_chunk_0000"]
    with pytest.raises(ValueError):
        ingest.run_ingestion(spark, filings.filter("ticker = 'none'"))


# --- patterns ---


class Proposer:
    """Fenced answers; the first for each prompt is no pattern."""

    def __init__(self):
        self.asked = {}

    def propose(self, prompt):
        n = self.asked[prompt] = self.asked.get(prompt, 0) + 1
        if "never" in prompt:
            raise RuntimeError("busy")
        return "(" if n == 1 else "```regex\n;\\s+\n```"


def test_patterns_of_a_provider(spark):
    text = "; ".join("some words that stand in a part of it" for _ in range(40))
    rows = spark.createDataFrame([(1, text, "7"), (2, text + " never", "7"), (3, "short; text", "7")], "doc_id long, text string, item_number string")
    got = {r.doc_id: r.pattern for r in chunking.with_patterns(rows, Proposer, pause=0.0, config=chunking.ChunkConfig(pattern_min_tokens=50)).collect()}
    assert got == {1: r";\s+", 2: None, 3: None}
    made = chunking.chunk_sections(chunking.with_patterns(rows, Proposer, pause=0.0).withColumn("strategies", F.array(F.lit("llm_regex"))), config=chunking.ChunkConfig(min_tokens=5, pattern_min_tokens=50))
    assert {r.doc_id: len(r.chunks) for r in made.collect()} == {1: 40, 2: 1, 3: 1}


def test_groups_inside_a_pattern_are_pieces_too():
    assert chunking.split_by_pattern("a1b2c", r"(\d)") == ["a1", "1b", "22", "c"]
    assert "".join(chunking.split_by_pattern("a. b. c", r"\. ")).replace(".", ". ").strip() == "a. b. c"
    assert chunking.without_fences("```python\nab\n```") == "ab" == chunking.without_fences(" ab ")


# --- dense search ---


def test_dense_best_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(400, 6)), 1)
    vectors = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "pos long, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v[:37])] + [(99, None)], "query_id long, query_vector array<double>")
    want = {(q, p, round(float(s), 6), k + 1) for q in range(37) for k, (s, p) in enumerate(sorted(((round(float(v[q] @ x), 6), p) for p, x in enumerate(v)), key=lambda t: (-t[0], t[1]))[:7])}
    # blocks of one size and another, a broadcast side and a grid of cells
    for values, sent, cell in ((blocks.BLOCK_VALUES, blocks.BROADCAST_BYTES, blocks.CELL_BYTES), (30, 1 << 20, 1), (60, 0, 900)):
        for name, value in (("BLOCK_VALUES", values), ("BROADCAST_BYTES", sent), ("CELL_BYTES", cell)):
            monkeypatch.setattr(blocks, name, value)
        assert {(r.query_id, r.pos, r.score, r["rank"]) for r in search.dense_best(vectors, asked, 7).collect()} == want
    monkeypatch.setattr(blocks, "HELD", 1)  # every pair of blocks passes its best on
    assert search.dense_best(vectors, asked, 7).count() == len(want)
    assert search.dense_best(vectors, asked.limit(0), 7).count() == 0 and search.dense_best(vectors.limit(0), asked, 7).count() == 0


def test_dense_best_of_more_queries_than_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(300, 5)), rng.normal(size=(3000, 5))
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(blocks, "CELL_BYTES", 40_000)
    vectors = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "pos long, vector array<double>")
    asked = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)], "query_id long, query_vector array<double>").repartition(6)
    found = search.dense_best(vectors, asked, 2)
    assert "BroadcastNestedLoop" not in (plan := found._jdf.queryExecution().toString()) and "Cartesian" not in plan
    best = np.argsort(-np.round(q @ v.T, 6), axis=1, kind="stable")[:, :2]
    assert {(r.query_id, r["rank"]): r.pos for r in found.collect()} == {(k, j + 1): int(best[k, j]) for k in range(3000) for j in range(2)}


def test_vectors_of_several_dimensions_and_odd_values(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0]), (3, []), (4, None), (5, [float("nan"), 1.0]), (6, [None, 2.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "pos long, vector array<double>")
    asked = vectors.select(F.col("pos").alias("query_id"), F.col("vector").alias("query_vector")).filter("query_id < 4")
    got = {(r.query_id, r["rank"]): (r.pos, r.score) for r in search.dense_best(vectors, asked, 2).collect()}
    assert got == {(0, 1): (0, 1.0), (0, 2): (1, 0.5), (1, 1): (0, 0.5), (1, 2): (1, 0.5), (2, 1): (2, 1.0), (3, 1): (3, 0.0)}


def test_one_side_alone(spark):
    docs = spark.createDataFrame([(0, "orange pie"), (1, "banana"), (2, "cherry"), (3, "plum")], "doc_id long, text string")
    chunks = docs.select(F.col("doc_id").alias("pos"), F.lit("A").alias("ticker"), F.lit("7").alias("item_number"), "text")
    asked = spark.createDataFrame([(0, "orange", [1.0])], "query_id long, query string, query_vector array<double>")
    vectors = spark.createDataFrame([(1, [2.0]), (0, [1.0])], "pos long, vector array<double>")
    assert [r.pos for r in search.hybrid(search.build_lexical(docs), None, chunks, asked).collect()] == [0]
    assert [r.pos for r in search.hybrid(None, vectors, chunks, asked).orderBy("rank").collect()] == [1, 0]
    assert [r.text for r in search.chunks_only(search.hybrid(None, vectors, chunks, asked), chunks).orderBy("place").collect()] == ["banana", "orange pie"]


# --- stores ---


def test_filing_and_chunk_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"ticker": "AAPL", "cik": "1", "fiscal_year": 2024, "accession_no": "x", "filing_date": "2024-11-01"}))
    (tmp_path / "in" / "b.json").write_text("{broken")
    (tmp_path / "in" / "c.json").write_text("{}")
    assert sorted((r.source.rsplit("/", 1)[1], r.why) for r in tables.broken_filings(spark, f"{tmp_path}/in").collect()) == [("b.json", "no JSON of a filing"), ("c.json", "no ticker")]
    own = tables.read_filings(spark, f"{tmp_path}/in")
    assert own.count() == 1
    tables.write_filings(own, f"{tmp_path}/out")
    assert tables.read_json(spark, f"{tmp_path}/out/*", tables.FILING, lines=True).first().filing_date == "2024-11-01"
    sections = ingest.sections(spark.createDataFrame([("AAPL", 2024, "one"), ("MSFT", 2024, "two")], "ticker string, fiscal_year int, business string"))
    tables.write_all_sections(sections, f"{tmp_path}/all")
    assert sorted((r.ticker, r.text, r.signals.token_count) for r in tables.read_sections(spark, f"{tmp_path}/all", lines=True).collect()) == [("AAPL", "one", 1), ("MSFT", "two", 1)]
    chunks = spark.createDataFrame([("c1", "text", [0.5])], "chunk_id string, text string, embedding array<float>")
    full = chunks.select(*(F.col(n) if n in chunks.columns else F.lit(None).cast(t).alias(n) for n, t in (x.split(" ") for x in tables.CHUNK.split(", "))))
    tables.write_chunks_json(full, f"{tmp_path}/chunks")
    again = tables.read_chunks_json(spark, f"{tmp_path}/chunks")
    assert again.first() == full.first() and tables.chunk_by_id(again, "c1").count() == 1 and tables.chunk_by_id(again, "c2").count() == 0
    tables.save_vectors(spark.createDataFrame([(1, [0.5]), (2, None)], "pos long, vector array<float>"), f"{tmp_path}/v")
    assert [tuple(r) for r in tables.load_vectors(spark, f"{tmp_path}/v").collect()] == [(1, [0.5])]
    own.select("ticker", "cik").write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError):
        tables.load_vectors(spark, f"{tmp_path}/other")


def test_small_tables_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t")
    assert shared.spread(spark.read.parquet(f"{tmp_path}/t")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    # one of unknown size stays as it is
    assert shared.spread(spark.createDataFrame([(1,)], "k int").coalesce(1)).rdd.getNumPartitions() == 1


# --- generation ---


class Broken:
    def write(self, prompts):
        raise RuntimeError("no service")


def test_a_failing_writer_keeps_the_row(spark):
    prompts = spark.createDataFrame([(0, "q", "s", "u", [1])], "query_id long, query string, system string, user string, source_numbers array<int>")
    r = providers.generate(prompts, Broken, "m", attempts=2, pause=0.0).first()
    assert "RuntimeError: no service" in r.raw_answer and (r.tokens_used, r.model, r.source_numbers) == (0, "m", [1])
    assert providers.generate(prompts, providers.ExtractiveWriter).first().tokens_used > 0
    with pytest.raises(ValueError):
        providers.embed_query(" \n")
    assert len(providers.embed_query("a b")) == 64


# --- engine ---


def test_engine_from_sections_to_audited_answers(spark, tmp_path):
    rng = random.Random(4)
    say = lambda topic: ". ".join(f"The {topic} of the company {rng.choice(['rose', 'fell', 'stood'])} by {rng.randrange(100)} percent in quarter {k}" for k in range(12)) + "."
    filings = spark.createDataFrame([(t, n, 2024, "2024-11-01", "x", say(f"business of {n}"), say(f"risk for {n}"), say(f"revenue {n}")) for t, n in (("AAPL", "Apple"), ("MSFT", "Microsoft"), ("JPM", "JPMorgan"))], "ticker string, company_name string, fiscal_year int, filing_date string, accession_no string, business string, risk_factors string, management_discussion string")
    engine = build.Engine(spark, f"{tmp_path}/engine")
    assert not engine.is_built and engine.stats()["chunks"] == 0
    with pytest.raises(RuntimeError):
        engine.chunks()
    sections = ingest.sections(filings)
    engine.build(sections)
    stats = engine.stats()
    assert stats["is_built"] and stats["chunks"] == stats["vectors"] == stats["documents"] >= 9
    assert set(x.split(" ")[0] for x in tables.CHUNK.split(", ")) - {"embedding"} <= set(engine.chunks().columns)
    # nothing is embedded twice; force makes all anew
    before = spark.read.parquet(f"{tmp_path}/engine/embeddings").count()
    engine.build(sections)
    assert spark.read.parquet(f"{tmp_path}/engine/embeddings").count() == before
    engine.build(sections, force_rechunk=True, force_reembed=True)
    assert engine.stats() == stats and spark.read.parquet(f"{tmp_path}/engine/embeddings").count() == before
    one = engine.chunk("AAPL_2024_item_7_chunk_0000").first()
    assert one.company_name == "Apple" and one.total_chunks_in_section >= 1

    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    r = engine.query("What is the risk for Apple?", at=at).first()
    assert r.sources and {s.ticker for s in r.sources} == {"AAPL"} and {s.item_number for s in r.sources} == {"1A"}
    trail = r.audit_trail
    assert trail.query_id.startswith("20240506T070809_") and trail.timestamp_utc.startswith("2024-05-06T07:08:09") and trail.model_used == "extractive" and trail.tokens_used > 0
    assert trail.chunks_used == len(trail.retrieval_scores) == len(trail.chunking_strategies) and trail.retrieval_scores[0].chunk_id.startswith("AAPL_2024_item_1a") and trail.retrieval_scores[0].chunking_score is not None
    assert 0 < r.confidence <= 1 and answers.display(engine.query("What is the risk for Apple?", at=at)).first().report.startswith("Q: What is the risk for Apple?")
    # filters hold for every job, many questions at once, none found, none asked
    assert {s.ticker for s in engine.query("revenue", {"ticker": "jpm", "item_number": "7"}).first().sources} == {"JPM"}
    none = engine.query("revenue", {"fiscal_year": 1999}).first()
    assert (none.answer, none.confidence, none.audit_trail.query_id, none.audit_trail.chunks_used) == (answers.REFUSAL, 0.0, answers.NO_RESULTS, 0)
    many = spark.createDataFrame([(1, "Compare Apple and Microsoft revenue", None), (2, "risk", "MSFT"), (3, " ", None)], "query_id long, query string, ticker string")
    got = {r.query_id: r for r in engine.query(many).collect()}
    assert {s.ticker for s in got[1].sources} == {"AAPL", "MSFT"} and {s.ticker for s in got[2].sources} == {"MSFT"} and got[3].answer == answers.REFUSAL
    assert engine.retrieve_chunks("Apple revenue", top=3).count() == 3
    with pytest.raises(ValueError):
        engine.query("  ")


def _say(k, what):
    return (f"The {what} number{k} of this company grows. It rests on number{k % 7} customers and word{k * 31 % 97}. " * 5).strip()


def _filings(spark, rows):
    return ingest.sections(spark.createDataFrame([(t, t, 2024, "2024-11-01", "x", _say(k, "business"), _say(k + 1, "risk")) for t, k in rows], "ticker string, company_name string, fiscal_year int, filing_date string, accession_no string, business string, risk_factors string"))


def _found(engine, k=4):
    asked = engine.spark.createDataFrame([(q, f"number{q} customers word{q * 31 % 97}") for q in range(6)], "query_id long, query string")
    found = engine.retrieve(asked, top=k).join(engine.chunks().select("pos", "chunk_id"), "pos")
    return sorted((r.query_id, r.chunk_id, r.bm25_score, round(r.dense_score or 0, 5)) for r in found.collect())


def test_a_build_writes_what_is_new_and_answers_as_a_full_one(spark, tmp_path):
    rows = [(f"T{k:03d}", 10 * k) for k in range(30)]
    step = build.Engine(spark, f"{tmp_path}/step").build(_filings(spark, rows))
    changed = [("T003", 777), ("T100", 888)]  # one of thirty is new, one has another text
    step.build(_filings(spark, [*rows[:3], *changed[:1], *rows[4:], *changed[1:]]))
    whole = build.Engine(spark, f"{tmp_path}/whole").build(_filings(spark, [*rows[:3], *rows[4:], *changed]))
    count = lambda name, n: spark.read.parquet(f"{tmp_path}/step/{name}/build={n}").count()
    assert count("chunks", 1) == count("vectors", 1) == 4 and count("gone", 1) == 2 and count("chunks", 0) == 60
    assert {k: v for k, v in step.stats().items() if k != "path"} == {k: v for k, v in whole.stats().items() if k != "path"}
    # ranks may differ where scores tie, as positions do; which chunks have which scores does not
    scores = lambda e: sorted(x[:1] + x[2:] for x in _found(e))
    assert scores(step) == scores(whole)
    texts = lambda e: sorted((r.chunk_id, r.text) for r in e.chunks().collect())
    assert texts(step) == texts(whole)
    # sections that are not given again stay; a build with nothing new adds nothing
    step.build(_filings(spark, rows[5:7]))
    assert texts(step) == texts(whole) and count("chunks", 2) == 0
    # a build that dies before its commit leaves nothing, and the next one removes what it indexed
    postings.SegmentedIndex(spark, f"{tmp_path}/step/lexical").add(spark.createDataFrame([(1 << 40, "number1 customers")], "pos long, text string"))
    step.build(_filings(spark, rows[5:7]))
    assert scores(step) == scores(whole)
