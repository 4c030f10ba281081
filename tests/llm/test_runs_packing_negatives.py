"""Periodic runs, packing and hard negatives against brute force, with nulls, ties, repeats and odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import negatives, packing, periodic, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


# --- periodic runs ---


def runs_by_brute_force(words, least=12):
    """Every stretch on which words a period apart are equal, for every period."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(least, 2 * p) and i > s:
                out.setdefault((s, i + p - s), p)
            i += 1
    runs = sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in dropped)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("abc", min_size=1, max_size=12), st.integers(1, 6)), max_size=8), min_size=1, max_size=5))
def test_runs_of_repeated_stretches(texts):
    words = [list("".join(s * k for s, k in t)) for t in texts]
    runs, left = periodic.runs_of([" ".join(w) for w in words])
    assert list(zip(runs, left)) == [runs_by_brute_force(w) for w in words]


def test_runs_longer_than_a_step_and_of_one_word():
    rng = random.Random(5)
    texts = []
    for n, p in ((500, 1), (700, 2), (900, 37), (1300, 333), (40, 3)):
        unit = [f"w{rng.randrange(50)}" for _ in range(p)]
        texts.append(["x", *((unit * n)[:n]), *unit[: p // 2], "y", *((unit * 4)[: 3 * p])])
    runs, left = periodic.runs_of([" ".join(w) for w in texts])
    assert list(zip(runs, left)) == [runs_by_brute_force(w) for w in texts]


def test_a_long_text_of_one_word_takes_no_square():
    n = 200_000
    assert periodic.runs_of(["a " * n + "b"])[0] == [[(0, n, 1)]]


def test_seeds_that_collide_are_compared(monkeypatch):
    monkeypatch.setattr(periodic, "_seeds", lambda x: np.zeros(len(x), np.uint64))
    rng = random.Random(6)
    words = [[rng.choice("ab") for _ in range(rng.randrange(70))] for _ in range(20)]
    assert list(zip(*periodic.runs_of([" ".join(w) for w in words]))) == [runs_by_brute_force(w) for w in words]


def planted_by_brute_force(doc_id, text):
    w, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not w:
        return w
    n = len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest_by_brute_force(doc_id, text):
    words = [w.decode() for w in planted_by_brute_force(doc_id, text)]
    runs, left = runs_by_brute_force(words)
    s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), s, n, p, 1000 * n // p if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(left)


def test_digests_of_documents(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60))) for _ in range(120)]
    texts += [None, "", " \t\n\x0b\x0c\r ", "\x1c a b\x85c é", "a\tb\nc\x0bd\x0ce\rf " * 5, ("é ü " * 40).strip(), texts[0]]
    rows = [*enumerate(texts), (None, "a b " * 20), (None, None), (3, texts[3]), (3, texts[4]), (-17, texts[5])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, runs int")
    got = [tuple(r) for r in periodic.digests(docs).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted((digest_by_brute_force(*r) for r in rows), key=key)
    assert sum(r[1] for r in got) > 5 and periodic.digests(docs.limit(0)).collect() == []


# --- packing ---


def held(plan, capacity, counts):
    left = np.array(counts)
    for own, times in plan:
        assert times > 0 and sum(n * k for n, k in own) <= capacity
        for n, k in own:
            left[n] -= k * times
    assert not left.any()
    return sum(times for _, times in plan)


def fewest(lengths, capacity):
    """The least number of sequences, by trying every place for every piece."""
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i, r in enumerate(rooms):
            if r >= lengths[k] and r not in rooms[:i]:
                place(k + 1, [*rooms[:i], r - lengths[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.integers(5, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=11))))
def test_few_pieces_are_packed_into_the_fewest_sequences(case):
    capacity, lengths = case
    counts = np.bincount(lengths, minlength=capacity + 1)
    assert held(packing.plan_packing(counts, capacity), capacity, counts) == fewest(sorted(lengths, reverse=True), capacity)


def test_never_worse_than_best_fit_and_near_the_bound():
    rng = np.random.default_rng(8)
    for n, draw in ((200, rng.lognormal), (20_000, rng.lognormal), (3000, lambda *_a, size: rng.integers(300, 1200, size))):
        counts = np.bincount(np.clip(draw(6.0, 1.0, size=n), 1, 2048).astype(int), minlength=2049)
        best, made = (held(p, 2048, counts) for p in (packing.best_fit(counts, 2048), packing.plan_packing(counts)))
        assert made <= best and made <= 1.01 * -(-int((counts * np.arange(2049)).sum()) // 2048) + 1
    assert held(packing.plan_packing(counts, nodes=5), 2048, counts) <= best


def best_fit_by_brute_force(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - n)
    return len(rooms)


def test_best_fit_in_bulk_is_best_fit():
    rng = np.random.default_rng(9)
    for _ in range(100):
        capacity = int(rng.integers(4, 60))
        lengths = rng.integers(1, capacity + 1, rng.integers(0, 200))
        counts = np.bincount(lengths, minlength=capacity + 1)
        assert held(packing.best_fit(counts, capacity), capacity, counts) == best_fit_by_brute_force(lengths.tolist(), capacity)


def test_dominated_fillings_are_left_out():
    counts = np.zeros(21, np.int64)
    counts[[7, 5, 3, 2]] = 1
    assert packing.fillings(counts, 10, 9) == [((7, 1), (3, 1))]  # 5 + 3 + 2 makes way for 7 + 3, as 5 + 2 is 7
    counts[10] = 1
    assert packing.fillings(counts, 10, 9) == [((10, 1),)]
    assert packing.fillings(counts, 1) == [()]


def packed_is_right(rows, docs, capacity=2048):
    """Every document's ids in order in its pieces, and every sequence without a gap."""
    tok, of, sequences = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    want = defaultdict(list)
    for d, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want[d] += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert {d: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own) for d, own in of.items()} == {d: sorted(x) for d, x in want.items()}
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences)


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(10)
    word = lambda: rng.choice(["alpha", "bet", "Gam ma", "deltas", "é", "7", "\n"])
    texts = [" ".join(word() for _ in range(rng.choice([3, 40, 400, 900]))) for _ in range(60)]
    texts += [None, "", texts[0], " ".join(word() for _ in range(6000)), "<|endoftext|>"] + ["same text " * 30] * 40
    return [*enumerate(texts), (None, texts[1]), (7, texts[7]), (7, "other")]


def test_documents_are_packed(spark, documents):
    docs = spark.createDataFrame([(*r, 1, "x") for r in documents], "doc_id long, text string, length int, part string").repartition(5)
    rows = packing.pack_documents(docs, PATH).collect()
    tokens = sum(r.length for r in rows)
    assert packed_is_right(rows, documents) == -(-tokens // 2048)
    assert [f.name for f in packing.pack_documents(docs.limit(0), PATH).schema] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_sequences_hold_the_ids_of_their_documents(spark, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    tok, ids = Tokenizer.from_file(PATH), defaultdict(int)
    for r in packing.packed_sequences(docs, PATH, capacity=256).collect():
        assert len(r.ids) == sum(r.lengths) <= 256
        for n in r.ids:
            ids[n] += 1
    want = defaultdict(int)
    for _, text in documents:
        for n in [*tok.encode(text or "", add_special_tokens=False).ids, 0]:
            want[n] += 1
    assert ids == want


# --- hard negatives ---


def negatives_by_brute_force(rows, anchors, positives=5, negatives=3):
    """rows: distinct (id, label, components)."""
    out = []
    for a, label, v in anchors:
        same_size = [r for r in rows if len(r[2]) == len(v)]
        scored = sorted(((sum(x * y for x, y in zip(v, w)), -i, m) for i, m, w in same_size), reverse=True)
        near = [(s, -i) for s, i, m in scored if m == label and -i != a][:positives]
        for ps, p in near:
            far = [(s, -i) for s, i, m in scored if m != label and 50 * ps <= 100 * s <= 95 * ps][:negatives]
            out += [(a, p, k + 1, n, ps, s) for k, (s, n) in enumerate(far)]
    return sorted(out)


def integer(rows):
    """The rows that take part, by the contract's words."""
    out = set()
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not np.isfinite(x) for x in v):
            continue
        out.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * float(x))) for x in v)))
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, key string, rank int").repartition(3)
    return sorted(tuple(r) for r in negatives.mine(df).collect())


def unit(rng, dim=16):
    v = rng.normal(size=dim).astype(np.float32)
    return (v / np.linalg.norm(v)).tolist()


def test_negatives_of_clusters_ties_and_odd_rows(spark):
    rng = np.random.default_rng(11)
    centres = [rng.normal(size=16) for _ in range(6)]
    rows = []
    for i in range(500):
        v = (centres[i % 6] + 0.4 * rng.normal(size=16)).astype(np.float32)
        rows.append((i, int(rng.integers(0, 10)), (v / np.linalg.norm(v)).tolist()))
    hot = unit(rng)
    rows += [(i, 3 + i % 2, hot) for i in range(1000, 1300)]  # one vector, a third of all rows
    rows += [(2000, None, hot), (2050, 1, None), (2100, 1, [None, *hot[1:]]), (2150, 1, [float("nan"), *hot[1:]]), (2200, 1, [float("inf"), *hot[1:]]), (None, 1, hot), (2250, 1, []), (2251, 1, []), (2252, 2, []), (2300, 1, [1.0, 2.0]), (2301, 1, [1.0, 2.0]), (2302, 2, [1.0, 1.0]), (2350, 1, [100.0, -3e4]), (2351, 1, [90.0, -3e4]), (2352, 4, [90.0, -2e4]), rows[50], rows[50], (51, 4, rows[50][2]), (50, 7, hot)]
    kept = integer(rows)
    want = negatives_by_brute_force(kept, [r for r in kept if r[0] % 50 == 0])
    assert mined(spark, rows) == want and len(want) > 30
    assert mined(spark, rows[:0]) == [] and mined(spark, [(50, 1, hot)]) == []


def test_negatives_in_a_grid_of_small_blocks(spark, monkeypatch):
    from tessera.operators import blocks

    for name, value in (("BLOCK_VALUES", 320), ("BROADCAST_BYTES", 0), ("CELL_BYTES", 9000)):
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(negatives, "HELD", 1)
    rng = np.random.default_rng(12)
    rows = [(i, int(rng.integers(0, 4)), unit(rng, 8)) for i in range(400)]
    kept = integer(rows)
    assert mined(spark, rows) == negatives_by_brute_force(kept, [r for r in kept if r[0] % 50 == 0])


def test_planes_drop_pairs_and_lose_none():
    """The bit-planes alone find the best of each range; most pairs never see the last plane."""
    rng = np.random.default_rng(13)
    a, b = (np.floor(256 * rng.normal(size=(n, 64)) / 8).astype(np.int64) for n in (40, 3000))
    exact, ids = a @ b.T, np.arange(3000) * 3
    low, high = np.array([np.full(40, -(1 << 40)), np.full(40, 2000), np.full(40, 5)]), np.array([np.full(40, 1 << 40), np.full(40, 9000), np.full(40, 4)])
    wanted = negatives.Windows(40, low, high, 4)
    followed = 0
    for x in range(0, 3000, 1000):
        followed += negatives.sliced(a, b[x : x + 1000], np.ones((40, 1000), bool), ids[x : x + 1000], wanted)
    for i in range(3):
        _, who, got, score, _ = wanted.held[i]
        want = [(q, int(ids[j]), int(exact[q, j])) for q in range(40) for j in [j for j in np.lexsort((ids, -exact[q])) if low[i][q] <= exact[q, j] <= high[i][q]][:4]]
        assert list(zip(who.tolist(), got.tolist(), score.tolist())) == want
    assert not len(wanted.held[2][1]) and followed < exact.size / 10


def test_registered_over_whole_tables(spark, tmp_path):
    rng = np.random.default_rng(14)
    spark.createDataFrame([(k, "a b c " * k) for k in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, i % 3, unit(rng, 8)) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(tuple(r) for r in run("op11_periodic_runs").collect()) == [digest_by_brute_force(k, "a b c " * k) for k in range(30)]
    assert packed_is_right(run("op12_packing").collect(), [(k, "a b c " * k) for k in range(30)]) == 1
    kept = integer(rows)
    assert sorted(tuple(r) for r in run("op13_hard_negatives").collect()) == negatives_by_brute_force(kept, [r for r in kept if r[0] % 50 == 0])
    assert run("op11_periodic_runs").agg(F.sum("n_runs")).first()[0] > 0
