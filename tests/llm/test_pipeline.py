import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"{rng.choice(['tion', 'ring', 'ou'])}{rng.choice(['the', 'nd', 'sh'])}{rng.choice('abcdefgh')}{rng.choice('ijkl')}" for _ in range(n)) + "."


def test_whole_pipeline(spark, tmp_path):
    rng = random.Random(6)
    good = [(k, prose(rng, 120), "en", "a", 1) for k in range(40)]
    item = prose(rng, 40)
    copy = good[3][1].split()
    copy[60] = "changed"
    rows = good + [(50, good[3][1], "en", "b", 1), (51, " ".join(copy), "en", "b", 1), (52, f"{prose(rng, 60)} {item} {prose(rng, 60)}", "en", "b", 1), (53, "too short", "en", "c", 1), (54, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(40))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, text, *_ in good:
        ids = tok.encode(text, add_special_tokens=False).ids
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, prose(rng, 120), "en", "a", 1) for k in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, "unused").schema == docs.schema
        assert stage(spark, docs.limit(0), "unused").count() == 0


def test_last_stages_on_nulls_repeats_and_clashing_names(spark, tmp_path):
    rng = random.Random(7)
    item, clean = prose(rng, 30), prose(rng, 90)
    rows = [(1, clean, 1), (1, clean, 1), (1, f"{prose(rng, 20)} {item} x", 2), (2, None, 3), (None, "", 4), (None, item, 5), (3, prose(rng, 9000), 6)]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, n_tokens long, text_hash string, h1 string")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    (_, leaks), (_, encode) = corpus_pipeline.STAGES[2:]
    kept = leaks(spark, docs, str(tmp_path))
    assert kept.schema == docs.schema and sorted(map(repr, ((r.doc_id, r.n_tokens) for r in kept.collect()))) == sorted(map(repr, [(1, 1), (1, 1), (2, 3), (None, 4), (3, 6)]))
    assert leaks(spark, docs.limit(0), str(tmp_path)).count() == 0
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(((r.doc_id, r.n_tokens) for r in encode(spark, docs, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((d, len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows), key=repr)
    assert encode(spark, docs.limit(0), str(tmp_path)).count() == 0
