import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, token_store
from tessera.llm.pieces import codec

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PLAIN = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
HARD = [None, "", " ", "a", "Hello, it's  me\n\n  and 123\u00a0x\x1cy\x85z ", "<|endoftext|>a<|endoftext|><|startoftext|>", "\u4f60\u597d \u0391\u03a3 \ud55c\uad6d e\u0301 \U0001f600", "\u0130I\u00df", "x" * 5000, "!?" * 3000, " " * 3000, "ab" * 700 + "\u4f60" * 900, "caf\u00e9 " * 50]


def same(text):
    for path, tok in zip((BYTE, WORD), PLAIN):
        want = tok.encode(text or "", add_special_tokens=False).ids
        assert codec(path).ids(text) == want
    c = codec(BYTE, bpe.TreeCodec)
    want = PLAIN[0].encode(text or "", add_special_tokens=False).ids
    assert c.ids(text) == want
    assert c.decode(want) == PLAIN[0].decode(want, skip_special_tokens=False)


def test_hard_texts():
    for text in HARD:
        same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("aeinrst'-  \n\u00e9!1", max_size=200))
def test_any_text(text):
    same(text)


def test_tree_equals_whole():
    rng = random.Random(1)
    c = codec(BYTE, bpe.TreeCodec)
    for k in range(300):
        piece = "".join(rng.choice("etaoinshr" if k % 2 else "ab") for _ in range(rng.randrange(1, 900)))
        if k % 5 == 0:
            piece = "".join(rng.choice(["!", "?", "--", "\u00a7", "...", "=", "\U0001f600"]) for _ in range(rng.randrange(1, 400)))
        assert np.frombuffer(c.tree(piece, leaf=rng.choice([1, 2, 7, 64])).ids, "<u4").tolist() == PLAIN[0].encode(piece, add_special_tokens=False).ids


def test_long_texts_are_joined_by_many_tasks(spark, monkeypatch):
    """Unsplit runs of 1 MB and prose alike; every row comes from a tree."""
    rng = random.Random(4)
    prose = "  ".join("".join(rng.choice("etaoin shrdlu.,'") for _ in range(200)) + "\n" for _ in range(1500))
    run = "".join(rng.choice("etaoinshrdlu") for _ in range(1 << 20))
    texts = [prose, run, prose + "<|endoftext|>" + run[:90000], "\u4f60\u597d" * 40000, " " * 100_000 + "x", prose, "short " * 400, None]
    rows = [(k, t) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(table, BYTE).collect()}
    assert len(got) == len(texts)
    for k, t in rows:
        ids = PLAIN[0].encode(t or "", add_special_tokens=False).ids
        assert got[k] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), k
    c = codec(BYTE, bpe.TreeCodec)
    before = c.joins
    assert c.ids(texts[6]) == PLAIN[0].encode(texts[6], add_special_tokens=False).ids and c.joins == before + 2
    # several rounds of joins
    monkeypatch.setattr(bpe, "FAN", 2)
    far = spark.createDataFrame([(1, 2, 3, run)], "h1 long, h2 long, bytes long, text string")
    assert np.frombuffer(bpe.encode_long(far, BYTE).first().ids, "<u4").tolist() == PLAIN[0].encode(run, add_special_tokens=False).ids


def test_other_pipelines_go_to_the_library(tmp_path):
    import json

    made = json.loads(PLAIN[0].to_str())
    made["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(made))
    c = codec(str(tmp_path / "t.json"))
    assert c.kind is None and codec(BYTE).kind == "byte" and codec(WORD).kind == "word"
    for text in HARD:
        assert c.ids(text) == Tokenizer.from_file(str(tmp_path / "t.json")).encode(text or "", add_special_tokens=False).ids


def docs(spark):
    rows = [(k, t, "clash") for k, t in enumerate(HARD)] + [(3, "a", "twice"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_digests(spark):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs(spark), BYTE).collect()}
    want = set()
    for r in docs(spark).collect():
        ids = PLAIN[0].encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(PLAIN[0].decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert bpe.digests(docs(spark).limit(0), BYTE).count() == 0
    assert bpe.encode_ids(docs(spark), BYTE).filter("decoded = 'a'").count() == 2


def test_token_files(spark):
    segments = token_store.write_tokens(docs(spark), WORD, segment_tokens=500)
    got = sorted(map(tuple, token_store.read_documents(segments).collect()), key=lambda r: r[1])
    start, want = 0, []
    for r in sorted(docs(spark).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = np.array([*PLAIN[1].encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    # random access through the files: every document's first, last and some middle tokens
    files = token_store.TokenFiles(segments)
    every = [t for r in sorted(docs(spark).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")) for t in (*PLAIN[1].encode(r.text or "", add_special_tokens=False).ids, 2)]
    assert files.total == len(every)
    for p in [0, 1, 499, 500, 501, len(every) // 2, len(every) - 1]:
        assert files.token_at(p) == every[p]
    for d, at, n, _ in want[-4:]:
        assert [files.token_of(d, k) for k in (0, n // 2, n - 1)] == [every[at], every[at + n // 2], every[at + n - 1]]
    for wrong, error in ((lambda: files.token_at(len(every)), IndexError), (lambda: files.token_of(want[-1][0], want[-1][2]), IndexError), (lambda: files.token_of(10**6, 0), KeyError)):
        with pytest.raises(error):
            wrong()
    assert token_store.read_documents(token_store.write_tokens(docs(spark).limit(0), WORD)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_random_access(ids):
    d = token_store.Dac.from_bytes(token_store.Dac.encode(np.array(ids, np.uint32)).to_bytes())
    assert d.all().tolist() == ids
    assert [d.get(i) for i in range(len(ids))] == ids


def test_windows_grow_at_joins():
    """Most joins fall into a piece, whose two sides are put together by a window; few pieces are encoded anew."""
    rng = random.Random(21)
    words = ["alpha", "beta", "gammadelta", "internationalisation", "é", "über", "don't", "x1y2", "end.", "\n"]
    c = bpe.TreeCodec(BYTE)
    for _ in range(40):
        text = " ".join(rng.choice(words) for _ in range(3000))
        assert c.ids(text) == PLAIN[0].encode(text, add_special_tokens=False).ids
    assert c.windows > c.joins / 3 and c.anew < c.windows


def test_windows_grow_until_both_sides_agree(monkeypatch):
    rng = random.Random(22)
    c = bpe.TreeCodec(BYTE)
    sizes = []
    tokenize = c.tokenize
    monkeypatch.setattr(c, "tokenize", lambda text: sizes.append(len(text)) or tokenize(text))
    for _ in range(60):
        piece = "".join(rng.choice("abcxyz") for _ in range(400))
        k = rng.randrange(1, 400)
        left, right = (np.array(PLAIN[0].encode(x, add_special_tokens=False).ids, np.uint32) for x in (piece[:k], piece[k:]))
        sizes.clear()
        assert c.window(left, right).tolist() == PLAIN[0].encode(piece, add_special_tokens=False).ids
        assert sizes == sorted(sizes) and sizes[0] <= 80


def test_few_row_groups_are_dealt_to_all_cores(spark, tmp_path):
    from tessera.llm.runtime import dealt

    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    small, large = spark.read.parquet(f"{tmp_path}/one"), spark.range(0, 100, 1, 50)
    assert dealt(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and dealt(large) is large
