"""What keeps the work of a query in proportion to its tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunk_quality, chunking, search
from tessera.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    """Tables of a few documents, as the registered queries read them."""
    texts = ["\n".join(f"Item {k} of line {k + d} costs {d}{k} %." for k in range(3 + d % 9)) for d in range(40)]
    spark.createDataFrame([(d, t, "en", "web") for d, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_strategies_are_scored_once_by_a_competition(spark, folder):
    made = registry.strategy_competition(spark, folder)
    assert plan(made).count("MapInArrow") == 3  # chunks, places and vectors, integrity
    assert made.filter("won").count() == 40


def test_a_text_is_split_into_lines_once(spark, folder):
    """A split within the function of a group would be made again for each group."""
    at = [m for m in plan(registry._line_arrays(spark, folder).select("chunks")).split("split(text")]
    assert len(at) == 2 and at[0].endswith("array(")
    n = chunking.line_chunks(spark.createDataFrame([(0, "\n".join(map(str, range(12))))], "doc_id long, text string"))
    assert [r.chunk for r in n.orderBy("chunk_index").collect()] == ["0\n1\n2\n3\n4", "5\n6\n7\n8\n9", "10\n11"]


def test_a_section_is_embedded_once():
    class Counting(chunk_quality.TermBins):
        asked = 0

        def embed(self, texts):
            Counting.asked += len(texts)
            return super().embed(texts)

    chunks = ["One two three four. Five six seven eight.", "Nine ten eleven twelve. One two three four."]
    told = chunk_quality.Remembered(Counting()).of("a")
    first = chunk_quality.cohesion(chunks, told), chunk_quality.coherence(chunks, told)
    assert Counting.asked == 5  # two chunks and three different sentences
    assert first == (chunk_quality.cohesion(chunks, told), chunk_quality.coherence(chunks, told)) and Counting.asked == 5
    assert first == (chunk_quality.cohesion(chunks, chunk_quality.TermBins()), chunk_quality.coherence(chunks, chunk_quality.TermBins()))


def test_lengths_of_long_texts_are_those_of_the_pattern():
    chars = "aB1 ,.-_\n\té\x1c　ʼ𝒳{}"
    for k in range(50):
        text = "".join(random.Random(k).choices(chars, k=600))
        for own in (text, text.replace("𝒳", "x")):
            assert chunking.count_tokens(own) == len(chunking._TOKEN.findall(own))


def test_no_row_is_made_for_each_pair_of_query_and_document(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 11}" for j in range(1, 9))) for k in range(60)], "doc_id long, text string")
    chunks = docs.select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("t"), F.col("doc_id") % 3)).alias("ticker"), (F.lit(2020) + F.col("doc_id") % 2).cast("int").alias("fiscal_year"))
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q} w3", None if q % 2 else "T1", 2021 if q % 3 else None) for q in range(6)], "query_id long, query string, ticker string, fiscal_year int")
    jobs = asked.select("query_id", F.lit(0).alias("job"), "ticker", "fiscal_year").union(asked.select("query_id", F.lit(1), F.lit(None).cast("string"), F.lit(None).cast("int")))
    index = search.build_lexical(docs)
    want = search.multi_job(search.lexical_scores(index, asked).filter("score > 0"), jobs, chunks, 4)
    made = search.lexical_jobs(index, asked, jobs, chunks, 4)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "job", "pos", "score", "rank").collect()))
    assert rows(made) == rows(want)
    for df in (made, search.lexical_top_k(index, asked, 3)):
        assert "MapInArrow" in plan(df) and "Aggregate [query_id" not in plan(df)


def test_numbers_are_rounded_as_printf_does(spark):
    """Ties of the shortest decimal are none of the binary value, and true ties go to the even figure."""
    values = [0.125, 0.375, 1.005, 2.675, 0.145, 99.995, 199.995, 0.001, 0.005, 0.015, 33.685, 1e-9, 0.0, -1.005, -0.001, 123456.785, 999.995, 0.999999, 4503599627370495.5, *(random.Random(7).randrange(200_000) / 1000 for _ in range(2000))]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.fixed_two(F.col("v")).alias("shown")).collect()
    assert [(r.v, r.shown) for r in got if r.shown != "%.2f" % r.v] == []
    words = [r[0] for r in spark.createDataFrame([("2.5",), ("1002500",), ("2500",), ("2500000",)], "w string").select(X.format_number(F.col("w"))).collect()]
    assert words == ["2", "$1M", "$2K", "$2M"]


def test_numbers_are_shown_as_the_sql_has_them(spark, tmp_path):
    """-999.7 is rounded to a thousand, which the SQL shows without a comma."""
    spark.createDataFrame([(4, 58795.5), (9, 58797.27)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.shown for r in registry.number_format(spark, str(tmp_path)).orderBy("o_orderkey").collect()] == ["-1000", "-1000"]


def test_chunks_of_a_section_are_read_in_one_pass():
    """Vectors and closeness are those of embedding each chunk and sentence by itself."""

    class Each(chunk_quality.TermBins):
        def embed(self, texts):
            return super().embed(texts)

    parts = ["Item 7 costs $1,200.50 a b. ", "item  1A says so?  ", "No. 5 of ΑΣ. ΣΑ x! ", "\n\n| a | b |\n", "It fell by 3.5 %. The rest held its place well. ", "", " . ", "one two three four"]
    for k in range(60):
        chunks = ["".join(random.Random(k * 9 + j).choices(parts, k=j)) for j in range(7)]
        one, joint = chunk_quality.Remembered(Each()), chunk_quality.Remembered(chunk_quality.TermBins())
        assert not one.joint and joint.joint and one.closeness(chunks) == joint.closeness(chunks)
        assert chunk_quality.coherence(chunks, one) == chunk_quality.coherence(chunks, joint)
        whole, each, of = chunk_quality.TermBins().sentences(chunks)
        assert whole.tolist() == [v.tolist() for v in Each().embed(chunks)] and len(each) == len(of)
    assert chunk_quality.TermBins().sentences(["a \x01 b"]) is None and chunk_quality.TermBins().sentences(["𝒳 y"]) is None


def test_an_automaton_serves_all_chunkings_of_a_section(spark, monkeypatch):
    made = []
    monkeypatch.setattr("tessera.operators.names.automaton", lambda own, f=chunk_quality.Patterns.__init__.__globals__["automaton"]: made.append(1) or f(own))
    among = chunk_quality.Patterns([f"row {k}" for k in range(30)] + [""])
    assert [among.found_in(f"a row {k} b") for k in (3, 4, 29, 99)] == [{"", "row 3"}, {"", "row 4"}, {"", "row 2", "row 29"}, {"", "row 9"}] and len(made) == 1


def test_a_section_is_judged_by_shares_that_are_found_once(spark, folder):
    """A share that several columns read stands in the plan once, besides where it is shown."""
    from tessera.operators import ingest

    own = ingest.typed(ingest.sections_view(spark.read.parquet(f"{folder}/documents.parquet"))).select("doc_id", "section_type", "signals.numerical_density", "signals.table_density")
    assert plan(own).count(r"bps") == 2


def test_a_filter_leaves_all_vectors_that_meet_it(spark):
    """The best vectors of the corpus are of another company than the one asked for."""
    n = 60
    chunks = spark.createDataFrame([(k, "T1" if k >= n - 3 else "T2", "1", f"w{k}") for k in range(n)], "pos long, ticker string, item_number string, text string")
    vectors = spark.createDataFrame([(k, [float(n - k), 1.0]) for k in range(n)], "pos long, vector array<double>")
    asked = spark.createDataFrame([(1, "where", "t1", [1.0, 0.0]), (2, "where", None, [1.0, 0.0])], "query_id long, query string, ticker string, query_vector array<double>")
    found = lambda **o: [(r.query_id, r.pos, r.dense_rank) for r in search.hybrid(None, vectors, chunks, asked, top=2, fan_out=1, **o).orderBy("query_id", "rank").collect()]
    assert found() == [(1, n - 3, 1), (1, n - 2, 2), (2, 0, 1), (2, 1, 2)]
    assert found(over_fetch=10) == [(2, 0, 1), (2, 1, 2)]
