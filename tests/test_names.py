"""Many patterns in one pass: names in texts, blocks in chunks."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunk_quality, names


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", max_size=4), max_size=30), st.lists(st.text("ab ", max_size=20), max_size=6))
def test_found_is_a_plain_search(patterns, texts):
    want = {p for p in patterns if any(p in t for t in texts)}
    few, names.FEW = names.FEW, 0
    try:
        assert names.found_in(patterns, texts) == want
    finally:
        names.FEW = few
    assert names.found_in(patterns, texts) == want


def rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.name_id, r.n, r["first"]) for r in df.collect())


def by_search(docs, known):
    out = []
    for d, t in docs:
        for i, name in known:
            low, own = (t or "").lower(), (name or "").lower()
            places = [k for k in range(len(low)) if own and low.startswith(own, k)]
            if places:
                out.append((-1 if d is None else d, i, len(places), places[0]))
    return sorted(out)


def test_occurrences_in_one_block_and_in_several(spark, monkeypatch):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice(["Apple", "pine", "pineapple", "ÉTÉ", "aaaa", "x"]) for _ in range(rng.randrange(12)))) for k in range(40)] + [(None, "apple"), (50, None), (51, ""), (3, "apple")]
    known = [(0, "apple"), (1, "APPLE"), (2, "pineapple"), (3, "aa"), (4, "été"), (5, "nothing"), (6, ""), (7, None), (8, "e p")]
    d, n = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x")), spark.createDataFrame(known, "name_id long, name string")
    assert rows(names.occurrences(d, n)) == by_search(docs, known)
    monkeypatch.setattr(names, "BLOCK_NAMES", 2)
    assert rows(names.occurrences(d, n)) == by_search(docs, known)
    assert rows(names.occurrences(d, n.limit(0))) == [] == rows(names.occurrences(d.limit(0), n))


def test_a_hundred_thousand_names(spark):
    known = spark.range(100_000).select(F.col("id").alias("name_id"), F.concat(F.lit("company "), F.col("id").cast("string"), F.lit(" ltd")).alias("name"))
    docs = spark.createDataFrame([(k, f"We sold to Company {k * 997} Ltd and to company {k} ltd. " * 3) for k in range(100)], "doc_id long, text string")
    got = rows(names.occurrences(docs, known))
    assert got == sorted({(k, i, 3 if k else 6, f"We sold to Company {k * 997} Ltd and to company {k} ltd. ".lower().index(f"company {i} ltd")) for k in range(100) for i in {k, k * 997}})


def test_labels_by_the_length_of_the_name(spark):
    known = spark.createDataFrame([(k, name, ticker) for k, (name, ticker) in enumerate(X.COMPANIES.items())], "name_id long, name string, label string")
    texts = ["Apple vs Goldman Sachs", "pineapple", "google and alphabet", "none", "JP Morgan or jpmorgan and Microsoft", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.c for r in docs.select("doc_id", X.companies(F.col("text")).alias("c")).collect() if r.c}
    assert {r.doc_id: r.labels for r in names.named(docs, known).collect()} == want


def test_integrity_of_blocks_and_rows(spark):
    table = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |  4 |"
    prose = "word " * 25
    text = f"Item 7\n\n{prose}\n\n- one thing\n2. another\n{table}"
    cases = [(0, text, [text]), (1, text, [f"Item 7 {prose}", table[:12], table[23:]]), (2, text, []), (3, "plain", ["plain"]), (4, text, ["nothing"])]
    got = {r.doc_id: (r.bi, r.tbi) for r in chunk_quality.with_integrity(spark.createDataFrame(cases, "doc_id long, text string, chunks array<string>")).collect()}
    assert got[0] == (1.0, 1.0) and got[2] == (0.0, 0.0) and got[3] == (1.0, 1.0) and got[4] == (0.0, 0.0)
    assert 0 < got[1][0] < 1 and got[1][1] == round(2 / 3, 4)
