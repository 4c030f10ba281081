import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import decontaminate, exchange, graph, kd_shards, language_model, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- benchmark decontamination ---


def leak_tables(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, rng.randrange(12, 60), 4000)) for k in range(12)] + [(20, "only four little words"), (21, None), (22, ""), (23, "!?"), (24, "one")]
    docs, want = [], set()
    for k in range(40):
        docs.append((k, prose(rng, 80, 4000)))
    for k in range(12):
        text = items[k][1]
        docs.append((100 + k, f"{prose(rng, 30, 4000)} {text.upper().replace(' ', '!! ')}\n{prose(rng, 30, 4000)}"))
        docs.append((200 + k, text))
        docs.append((300 + k, " ".join(text.split()[: len(text.split()) // 2])))
        want |= {(100 + k, k), (200 + k, k)}
    long = prose(rng, 59, 4000).split()
    items.append((30, " ".join(long)))
    docs.append((400, f"{prose(rng, 500, 4000)} {' '.join(long[:57])} new end {prose(rng, 20000, 4000)}"))
    docs += [(500, "see only four little words here"), (501, None), (502, ""), (None, items[0][1]), (200, items[0][1]), (503, "one")]
    want |= {(400, 30), (500, 20), (None, 0), (503, 24)}
    schema = "doc_id long, text string, item_id string, similarity string"
    return spark.createDataFrame([(*d, "x", "y") for d in docs], schema), spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, own string"), want


def words(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def shingle_set(w):
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())


def leaks_by_brute_force(docs, items):
    """Every window of every document against every item."""
    found = set()
    for d in docs:
        w = words(d.text)
        for i in items:
            v = words(i.text)
            b = shingle_set(v)
            if not b:
                continue
            for s in range(-len(v) + 1, len(w)):
                a = shingle_set(w[max(0, s) : s + len(v)])
                if a & b and sum(map(len, a & b)) / sum(map(len, a | b)) >= 0.8:
                    found.add((d.doc_id, i.item_id))
                    break
    return found


def test_leaks(spark):
    docs, items, want = leak_tables(spark)
    got = decontaminate.leaks(docs, items)
    pairs = [(r.doc_id, r.item_id) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and want <= set(pairs)
    assert set(pairs) == leaks_by_brute_force(docs.collect(), items.collect())
    clean = decontaminate.without_leaks(docs, items)
    assert clean.columns == docs.columns
    dirty = {d for d, _ in want}
    assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(r.doc_id) for r in docs.collect() if r.doc_id not in dirty)
    assert decontaminate.leaks(docs.limit(0), items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == docs.count()


def test_fingerprints_within_the_radius_meet(spark):
    rng = random.Random(3)
    rows = []
    for k in range(200):
        f = rng.getrandbits(64)
        g = f
        for b in rng.sample(range(64), k % (decontaminate.RADIUS + 1)):
            g ^= 1 << b
        rows.append((k, f - (1 << 64) if f >> 63 else f, g - (1 << 64) if g >> 63 else g))
    df = spark.createDataFrame(rows, "k long, fingerprint long, other long")
    index = decontaminate.hamming_index(df.select("k", "fingerprint"))
    from pyspark.sql import functions as F

    probes = df.select(F.col("k").alias("p"), F.inline(F.array(*(F.struct(F.lit(b).alias("block"), decontaminate._block(F.col("other"), b).alias("value")) for b in range(4)))))
    assert probes.join(index, ["block", "value"]).filter("p = k").select("k").distinct().count() == 200


# --- n-gram Jaccard join ---


def join_by_brute_force(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    texts = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
                if rows[i][1] != rows[j][1]:
                    texts[rows[i][1]].add(rows[j][1])
                    texts[rows[j][1]].add(rows[i][1])
    least = {}
    for k, (d, _) in enumerate(rows):
        least[root(k)] = min(d, least.get(root(k), d))
    return sorted((d, len(sets[k]), least[root(k)], len(texts[t])) for k, (d, t) in enumerate(rows))


def join_rows():
    rng = random.Random(11)
    rows = []
    for k in range(25):
        base = prose(rng, rng.choice([6, 12, 40, 90, 300])).split()
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 40 + 1)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                w = w + prose(rng, len(w) // 6).split()
            rows.append(" ".join(w))
    passage = prose(rng, 60)
    rows += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(12)]
    rows += [rows[0], rows[0].upper().replace(" ", "\t"), "a b c", "A b\nc", "a b", "", None, " \n ", "", "x", "  y", prose(rng, 9000), "same same same same same same same", "same same same same same"]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize("block", [1_500_000, 400])
def test_jaccard_components(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    rows = join_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    got = sorted(map(tuple, ngram_join.jaccard_components(docs).collect()))
    assert got == join_by_brute_force(rows)


def test_jaccard_edges(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (5, None)], "doc_id long, text string")
    got = sorted(map(repr, map(tuple, ngram_join.jaccard_components(docs).collect())))
    assert got == sorted(["(3, 2, 2, 0)", "(3, 2, 2, 0)", "(2, 2, 2, 0)", "(None, 2, None, 0)", "(5, 0, 5, 0)"])
    assert sorted(repr(r.doc_id) for r in ngram_join.one_of_each(docs).collect()) == ["2", "5", "None"]
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0 and ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(60)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}


# --- language model ---


def test_language_model(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice([f"a{rng.randrange(9)}", f"B{rng.randrange(60)} c"]) for _ in range(rng.randrange(1, 80)))) for k in range(160)]
    rows += [(500, None), (501, ""), (502, " \n"), (7, rows[7][1]), (503, "zz zz zz"), (504, prose(rng, 9000))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    got = {(r.doc_id, r.n_tokens): r for r in language_model.score_documents(docs).collect()}
    tokens = [(d, [*WORD.findall(lower(t)), None]) for d, t in rows]
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    c = Counter(w for d, ts in tokens if not held[d] for w in ts)
    pairs = Counter(p for d, ts in tokens if not held[d] for p in zip(["<begin>", *ts], ts))
    before = Counter(h for d, ts in tokens if not held[d] for h in ["<begin>", *ts[:-1]])
    n, v = sum(c.values()), len(c)
    weights = weights_by_brute_force(tokens, held, c, pairs, before, n, v)
    assert sum(1 for d in {d for d, _ in rows}) == len({d for d, _ in got})
    for d, ts in tokens:
        r = got[d, len(ts)]
        assert (r.held_out, r.n_known, r.train_tokens) == (held[d], sum(w in c for w in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts), abs=1e-6)
        want = 0.0
        for h, w in zip(["<begin>", *ts], ts):
            x = weights[min(int(math.log2(before[h] + 1)), language_model.BUCKETS - 1)]
            want += math.log10((x[0] * pairs[h, w] / before[h] if before[h] else 0) + x[1] * c[w] / n + x[2] / (v + 1))
        assert r.score == pytest.approx(want, rel=0.02)
    better = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in better) > sum(r.base_score for r in better)
    assert language_model.score_documents(docs.limit(0)).count() == 0


def weights_by_brute_force(tokens, held, c, pairs, before, n, v):
    """Expectation-maximisation over the held-out tokens themselves, without bins."""
    events = defaultdict(list)
    for d, ts in tokens:
        if zlib.crc32(str(d).encode()) % 10 == language_model.EM_FOLD:
            own, own_pairs, own_before = Counter(ts), Counter(zip(["<begin>", *ts], ts)), Counter(["<begin>", *ts[:-1]])
            for h, w in zip(["<begin>", *ts], ts):
                b = before[h] - own_before[h]
                events[min(int(math.log2(b + 1)), language_model.BUCKETS - 1)].append(((pairs[h, w] - own_pairs[h, w]) / b if b else 0.0, (c[w] - own[w]) / (n - len(ts)), 1 / (v + 1)))
    bins = np.array([(b, *(round(4 * math.log2(x)) if x else language_model.NEVER for x in e[:2]), 1) for b, es in events.items() for e in es], float)
    out = language_model.learn_weights(bins, 1 / (v + 1))
    for b, es in events.items():
        p = np.array(es)
        x = np.array([0.4, 0.5, 0.1]) if p[:, 0].any() else np.array([0.0, 0.9, 0.1])
        for _ in range(language_model.EM_ROUNDS):
            part = p * x
            part /= part.sum(1, keepdims=True)
            x = part.mean(0)
        assert np.abs(out[b] - x).max() < 0.06
    return out


# --- sharding ---


def test_shards(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.randrange(1, 120)), rng.choice(["en", "fr", None]), f"src{rng.randrange(5)}") for k in range(900)]
    hot = prose(rng, 50)
    rows += [(1000 + k, hot, rng.choice(["en", "de"]), f"src{k % 3}") for k in range(450)] + [(2000, None, None, None), (2001, "", "en", "x"), (None, "nobody", "en", "x"), (5, rows[5][1], "en", "y"), (2002, "é" * 3000, "en", "x")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, shard string")
    got = kd_shards.shard_documents(docs).collect()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((repr(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert sorted(by) == list(range(8))
    mean = sum(r.size for r in got) / 8
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert [r.doc_id for r in sorted(own, key=lambda r: r.slot)] == sorted((r.doc_id for r in own), key=lambda d: (d is not None, d or 0))
        assert abs(sum(r.size for r in own) - mean) < 0.03 * mean + 6100
    homes = defaultdict(set)
    for r in got:
        homes[r.size, r.text_crc32].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 4
    assert kd_shards.shard_documents(docs.limit(0)).count() == 0


def test_ids_with_several_texts_are_joined_for_each(spark):
    rng = random.Random(31)
    a, b, c = (prose(rng, 40, 3000) for _ in range(3))
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " else"), (None, a), (None, c), (None, c + " x"), (7, c), (7, c), (7, None), (8, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, key long")
    got = sorted(((r.doc_id or -1, r.component_id or -1, r.n_links) for r in ngram_join.jaccard_components(docs).collect()))
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (-1, -1, 1), (-1, -1, 1), (-1, -1, 1), (7, 7, 1), (7, 7, 1), (7, 7, 0), (8, 8, 0)])
    # both texts of id 1 stay, each the first of its own component; rows without an id or words all do
    assert sorted(r.key for r in ngram_join.one_of_each(docs).collect()) in ([0, 1, 4, 5, 6, k, 9, 10] for k in (7, 8))


@pytest.mark.parametrize("hot", [7, None])
def test_a_third_of_the_rows_with_one_id(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 20)
    rng = random.Random(32)
    texts = [prose(rng, 30, 3000) for _ in range(60)]
    rows = [(100 + k, t) for k, t in enumerate(texts)] + [(hot, texts[k % 20] + " end") for k in range(30)] + [(hot, texts[0])] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id or -1, r.component_id or -1, r.n_links) for r in ngram_join.jaccard_components(docs).collect())
    first = lambda k: 100 + k if hot is None or k >= 20 else min(100 + k, hot)
    want = [(100 + k, first(k), 1 if k < 20 else 0) for k in range(60)] + [(hot or -1, hot and first(k % 20) or -1, 1) for k in [*range(30), *[0] * 40]]
    assert got == sorted(want)


def test_requests_are_no_more_than_keys():
    keys = np.unique(np.random.default_rng(33).integers(0, 1 << 48, 5000, dtype=np.uint64))
    n = np.arange(len(keys))
    for parts in (1, 7, 300, 10_000_000):
        rows = list(exchange.requests(3, keys, n, parts, first_part=5))
        assert len(rows) <= min(parts, len(keys)) and [r[0] for r in rows] == sorted({r[0] for r in rows}) and rows[-1][0] < parts + 5
        lo, hi, counts = (np.concatenate([np.frombuffer(r[k], "<u4") for r in rows]).astype(np.uint64) for k in (2, 3, 4))
        assert np.array_equal(lo | hi << np.uint64(32), keys) and np.array_equal(counts, n)
    assert list(exchange.requests(0, keys[:0], None, 9)) == []


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 7, lambda k: k % 2])
def test_shards_of_one_text_with_few_ids(spark, ids):
    docs = spark.createDataFrame([(ids(k), "the same text") for k in range(400)], "doc_id long, text string").repartition(3)
    got = kd_shards.shard_documents(docs).collect()
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert len(got) == 400 and max(sizes) - min(sizes) <= 2 * 14
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
