"""Every registered query over small whole tables, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from tests.llm.test_leaks_joins_models_shards import WORD, join_by_brute_force, leaks_by_brute_force, lower, prose
from tests.llm.test_quality_urls_preferences import brute, url_brute
from tessera.llm import url_rules


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    items = [(k, prose(rng, 20 + 3 * k, 3000)) for k in range(6)]
    texts = [prose(rng, rng.randrange(1, 150), 3000) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + " more", f"{prose(rng, 30, 3000)} {items[2][1]} {prose(rng, 9, 3000)}", None, "", "Released under the MIT License.", "É ü <|endoftext|> x", prose(rng, 9000, 3000)]
    docs = [(k, t, "en" if k % 3 else "fr", f"src{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    urls = ["http://m.example.com/fr/1", "http://example.org/es/", "x", None, "https://a.org/en/1?q#f", "http://b.com/de/"]
    turns = [(c, k, "user" if k % 2 == 0 else "assistant", f"t{k if c < 4 else c}") for c in range(7) for k in range(2 + c % 3)]
    path = str(tmp_path_factory.mktemp("tables"))
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", items, "item_id long, text string"),
        ("pages", [(k, u, "<p>x</p>") for k, u in enumerate(urls)], "page_id long, url string, html string"), ("conversations", turns, "conv_id long, turn long, role string, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path, docs, items, urls, turns


def run(spark, name, path):
    return __spark_entry__.queries()[name](spark, path).collect()


def test_token_queries(spark, tables):
    path, docs, *_ = tables
    word, byte = (Tokenizer.from_file(public_tokenizers.path(x)) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    start, want = 0, []
    for d, t, *_ in docs:
        ids = np.array([*word.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op1_token_ids", path)) == want
    for r in run(spark, "op9_bpe", path):
        ids = byte.encode(docs[r.doc_id][1] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id][1] or "").encode()).hexdigest()


def test_document_queries(spark, tables):
    path, docs, items, *_ = tables
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in run(spark, "op4_quality", path)) == [(d, *brute(t)) for d, t, *_ in docs]
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in run(spark, "op6_ngram_join", path)) == join_by_brute_force([d[:2] for d in docs])
    rows = lambda data, *names: [type("Row", (), dict(zip(names, d))) for d in data]
    assert {(r.doc_id, r.item_id) for r in run(spark, "op2_decontaminate", path)} == leaks_by_brute_force(rows(docs, "doc_id", "text"), rows(items, "item_id", "text")) == {(63, 2)}
    assert [(r.doc_id, r.license) for r in run(spark, "op5_licenses", path)] == [(66, "MIT")]


def test_language_model_query(spark, tables):
    path, docs, *_ = tables
    tokens = {d: [*WORD.findall(lower(t)), None] for d, t, *_ in docs}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens}
    c = Counter(w for d, ts in tokens.items() if not held[d] for w in ts)
    n, v = sum(c.values()), len(c)
    for r in run(spark, "op7_language_model", path):
        ts = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ts), sum(w in c for w in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts), abs=1e-6)
        assert math.isfinite(r.score) and r.score < 0


def test_other_queries(spark, tables):
    path, docs, _, urls, turns = tables
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in run(spark, "op3_url_rules", path)) == [(k, *url_brute(u, url_rules.RULES)) for k, u in enumerate(urls)]
    by = {}
    for c, k, role, text in turns:
        by.setdefault(c, []).append((role, text))
    for r in run(spark, "op8_preferences", path):
        a, b = by.get(2 * r.pair_id, []), by.get(2 * r.pair_id + 1, [])
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        made = ["".join(f"<|turn|>{x}\n{y}<|end|>\n" for x, y in part) for part in (a[:k], a[k:], b[k:])]
        assert (r.prompt_turns, [r.prompt, r.chosen_completion, r.rejected_completion]) == (k, made)
    got = run(spark, "op10_kd_shards", path)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in docs]
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_every_query_is_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
