"""Operators that SQL cannot express against plain re-computations of their results."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import decontaminate, kd_shards, language_model, licenses, quality
from tests.llm.test_leaks_joins_models_shards import WORD, lower, shingle_set, words


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" for _ in range(n))


# --- language model ---


def test_scores_to_the_last_digit(spark):
    rng = random.Random(9)
    docs = [(k, prose(rng, rng.randrange(0, 120), 150)) for k in range(300)] + [(None, prose(rng, 30)), (7000, ""), (7001, None), (7002, "Never SEEN words")]
    lm = language_model
    fold = {d: zlib.crc32(str("" if d is None else d).encode()) % lm.FOLDS for d, _ in docs}
    tokens = [(d, [*WORD.findall(lower(t)), "<end>"]) for d, t in docs]
    pairs_of = lambda ts: list(zip(["<begin>", *ts], ts))
    train = [ts for d, ts in tokens if fold[d] != lm.HELD_OUT]
    word, pair = Counter(w for ts in train for w in ts), Counter(p for ts in train for p in pairs_of(ts))
    context = word | Counter({"<begin>": len(train)})
    total, types = sum(word.values()), len(word)
    share = lambda n, of: n / of if of > 0 else 0.0
    step = lambda p: round(lm.STEPS * math.log2(p)) if p > 0 else lm.NEVER
    bucket = lambda n: min(int(math.log2(n + 1)), lm.BUCKETS - 1)
    bins = Counter()
    for d, ts in tokens:
        if fold[d] == lm.EM_FOLD:
            own_word, own_pair, own_context = Counter(ts), Counter(pairs_of(ts)), Counter(a for a, _ in pairs_of(ts))
            for a, b in pairs_of(ts):
                before = context[a] - own_context[a]
                bins[bucket(before), step(share(pair[a, b] - own_pair[a, b], before)), step(share(word[b] - own_word[b], total - len(ts)))] += 1
    weights = lm.learn_weights(np.array([(*k, n) for k, n in sorted(bins.items())], float), 1 / (types + 1))
    want = {}
    for d, ts in tokens:
        p = [(w := weights[bucket(context[a])])[0] * share(pair[a, b], context[a]) + w[1] * share(word[b], total) + w[2] / (types + 1) for a, b in pairs_of(ts)]
        want[d] = sum(map(math.log10, p))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = lm.score_documents(table).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-9)
    # weights are a distribution in every bucket, and held-out text is likelier than by words alone
    assert np.allclose(weights.sum(1), 1)


# --- shards ---


def test_the_tree_is_the_exact_one(spark):
    rng = random.Random(2)
    rows = [(k, "x" * rng.randrange(0, 3000) + str(k), rng.choice(["en", "fr", None]), f"s{rng.randrange(9)}") for k in range(800)]
    rows += [(1000 + k, "the same text " * 40, "en", f"s{k % 9}") for k in range(400)] + [(5, rows[5][1], "de", "s1"), (None, None, None, None), (2000, "y" * 90000, "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    keys = [f"k_{d}" for d in kd_shards.DIMENSIONS]
    points = [r.asDict() for r in kd_shards.points(docs).collect()]
    whole = {k: max(1, max(p[k] for p in points) - min(p[k] for p in points)) for k in keys}
    low = kd_shards._LOW >> 1
    want = []

    def grow(own, leaves, first):
        if leaves == 1 or not own:
            want.extend((p["doc_id"], p["size"], p["text_crc32"], first) for p in own)
            return
        left, weight = leaves // 2, sum(p["size"] for p in own)
        k = max(keys, key=lambda k: (max(p[k] for p in own) - min(p[k] for p in own)) / whole[k])
        target, below = max(1, weight * left // leaves), 0
        by = Counter()
        for p in own:
            by[p[k]] += p["size"]
        for cut in sorted(by):
            if below + by[cut] >= target:
                break
            below += by[cut]
        if by[cut] > kd_shards.SLACK * weight:
            rest = target - below
            ids = Counter()
            for p in own:
                if p[k] == cut:
                    ids[low if p["doc_id"] is None else p["doc_id"]] += p["size"]
            for last in sorted(ids):
                rest -= ids[last]
                if rest <= 0:
                    break
            inside = lambda p: p[k] < cut or (p[k] == cut and (low if p["doc_id"] is None else p["doc_id"]) <= last)
        elif below + by[cut] - target <= target - below:
            inside = lambda p: p[k] <= cut
        else:
            inside = lambda p: p[k] < cut
        grow([p for p in own if inside(p)], left, first)
        grow([p for p in own if not inside(p)], leaves - left, first + left)

    grow(points, 8, 0)
    got = [(r.doc_id, r.size, r.text_crc32, r.shard) for r in kd_shards.assign(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # one text of 90,001 bytes in a corpus of some 1.4 MB still leaves the shards nearly even
    load = Counter()
    for _, size, _, shard in got:
        load[shard] += size
    assert max(load.values()) - min(load.values()) < 90_001


# --- quality ---


def test_verdicts(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(70, 200)) for _ in range(60)]
    texts += [" ".join("zq%x" % rng.randrange(10**6) for _ in range(150)), "#### $$$$ %%%% " * 60 + prose(rng, 30), "short", None, "ABC DEF GHI " * 50, prose(rng, 25)]
    docs = [(k, t, "en") for k, t in enumerate(texts)]
    kinds = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "M": 3, "N": 4, "Z": 5, "P": 6, "S": 7, "C": 8}
    import unicodedata

    def classes(text):
        out = [0] * len(quality.CLASSES)
        for c in text:
            k = unicodedata.category(c)
            out[7 if c in quality.SYMBOLS else 5 if "\t" <= c <= "\r" else kinds.get(k, kinds.get(k[0], 8))] += 1
        return out

    letters = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    counts = Counter(w for _, t, _ in docs if t for w in letters(t))
    common = sorted(counts, key=lambda w: (-counts[w], w))[: quality.COMMON_WORDS]
    all_words = [counts[w] for w in common] + [sum(counts.values()) - sum(counts[w] for w in common)]
    all_chars = [sum(x) for x in zip(*(classes(t) for _, t, _ in docs if t))]

    def distance(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        part = lambda a: sum(x * math.log2(x / ((x + y) / 2)) for x, y in a if x)
        return math.sqrt(max(0.0, (part(zip(p, q)) + part(zip(q, p))) / 2))

    refs = quality.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert list(refs.by_lang) == ["en"] and refs.by_lang["en"].counts.tolist() == all_words and refs.by_lang["en"].chars.tolist() == all_chars
    for r in quality.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect():
        text, far = texts[r.doc_id] or "", False
        own = letters(text)
        a = distance(classes(text), all_chars) if len(text) >= quality.MIN_CHARS else None
        b = distance([sum(w == c for w in own) for c in common] + [sum(w not in common for w in own)], all_words) if len(own) >= quality.MIN_WORDS else None
        for x, n, (most, chance) in ((a, len(text), quality.MAX_CHARS_DISTANCE), (b, len(own), quality.MAX_WORDS_DISTANCE)):
            far = far or (x is not None and x > most + chance / math.sqrt(n))
        assert (r.js_chars, r.js_words) == (pytest.approx(a, abs=1e-9), pytest.approx(b, abs=1e-9))
        assert r.kept == (not r.base_failed and not far)


# --- licences ---


def in_order(template, window):
    """Length of the longest common subsequence."""
    row = [0] * (len(window) + 1)
    for w in template:
        last = 0
        for k, v in enumerate(window):
            last, row[k + 1] = row[k + 1], last + 1 if w == v else max(row[k + 1], row[k])
    return row[-1]


def test_every_template_against_every_window():
    """Nothing is found that has not the words, and every notice with at most a tenth of its words changed is found."""
    rng = random.Random(5)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    notices = [(name, text, licenses.words(text)) for name, texts in licenses.TEMPLATES.items() for text in texts]
    for _ in range(120):
        name, text, own = rng.choice(notices)
        w = text.split()
        for k in rng.sample(range(2, len(w)), min(len(w) - 2, len(own) // 10 and rng.randrange(len(own) // 10 + 1))):
            w[k] = "changed"
        block = f"{prose(rng, rng.randrange(30))} {' '.join(w)} {prose(rng, rng.randrange(30))}"
        found = {r[2] for r in scanner.scan(block)}
        b = licenses.words(block)
        share = lambda t: max(in_order(t, b[s : s + licenses.window_size(t)]) for s in range(len(b))) / len(t)
        possible = {n for n, _, t in notices if share(t) >= licenses.MIN_WORDING}
        assert found <= possible | {"BSD-2-Clause"}
        if share(own) >= licenses.MIN_WORDING and in_order(own, licenses.words(" ".join(w))) == sum(a == c for a, c in zip(own, licenses.words(" ".join(w)))):
            assert found, block


def best_places(notices, words_):
    """Every window of every template that has enough words in order: (template, first and last word of the shortest such stretch)."""
    out = []
    for k, (_, _, t) in enumerate(notices):
        need = -(-9 * len(t) // 10)
        for s in range(len(words_)):
            if in_order(t, words_[s : s + licenses.window_size(t)]) >= need:
                out.append((k, s))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_any_tenth_of_any_notice_may_be_changed(seed):
    """Changed words anywhere, the first and last ones too: the name and the place are those of the notice."""
    rng = random.Random(seed)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    filler = lambda n: " ".join(f"filler{rng.randrange(50)}" for _ in range(n))
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            t = licenses.words(text)
            spans = [m.span() for m in licenses._WORDS.finditer(text)]
            may = len(t) - -(-9 * len(t) // 10)
            some = rng.choice([list(range(may)), list(range(len(t) - may, len(t))), rng.sample(range(len(t)), may)]) if may else []
            if any(t[k] in ("2", "3", "2.1", "1991", "2007", "lesser", "affero", "noncommercial", "sharealike", "attribution-noncommercial", "attribution-sharealike") for k in some):
                some = [k for k in some if not any(c.isdigit() for c in t[k]) and t[k] not in ("lesser", "affero", "attribution-noncommercial", "attribution-sharealike")]
            changed = text
            for k in sorted(some, reverse=True):
                a, b = spans[k]
                changed = changed[:a] + "changed" + changed[b:]
            before = filler(60)
            block = f"{before} {changed} {filler(30)}"
            rows = scanner.scan(block)
            kept = [k for k in range(len(t)) if k not in some]
            a, b = ([m.span() for m in licenses._WORDS.finditer(changed)][k] for k in (kept[0], kept[-1]))
            assert [(r[2], r[0], r[0] + r[1]) for r in rows] == [(name, len(before) + 1 + a[0], len(before) + 1 + b[1])], (text, some, rows)
            assert best_places([n for n in scanner.notices if n[1] == text], licenses.words(block))


def test_what_is_saved_decides_between_licences(monkeypatch):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    header = next(x for x in licenses.TEMPLATES["GPL-3.0"] if "redistribute" in x)
    right = scanner.scan(header)
    assert [r[2] for r in right] == ["GPL-3.0"] and right[0][4] > 0.5
    other = licenses.Scanner.saving
    monkeypatch.setattr(licenses.Scanner, "saving", lambda self, text, k, alone=None: -other(self, text, k, alone))
    assert [r[2] for r in scanner.scan(header)] != ["GPL-3.0"]


def test_alignment_keeps_as_many_words_as_can_stand_in_order():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = licenses.aligned(a, b)
        assert len(pairs) == in_order(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_templates_without_any_usual_word(spark):
    own = {"House-1": ("Anyone may copy this work, change it and pass it on to friends and neighbours alike.",), "None": ("?!",)}
    assert set(licenses.triggers(own)) & set(licenses.words(own["House-1"][0]))
    docs = spark.createDataFrame([(1, "Foreword. Anyone may copy this work, change it and pass it on to friends and neighbours alike. Bye."), (2, "no such thing")], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in licenses.scan_licenses(docs, own).collect()] == [(1, "House-1")]


# --- decontamination ---


def near_copy(rng, item):
    """The item with its ends changed so far that the similarity stays just above the bound, and the similarity."""
    w, best = item.split(), None
    a = shingle_set(words(item))
    for k in range(1, len(w)):
        left = rng.randrange(k + 1)
        changed = [f"y{rng.randrange(10**6)}" for _ in range(k)]
        v = changed[:left] + w[left : len(w) - (k - left)] + changed[left:]
        b = shingle_set(v)
        if (s := sum(map(len, a & b)) / sum(map(len, a | b))) < decontaminate.SIMILARITY:
            break
        best = " ".join(v), s
    return best


def test_recall_of_pairs_just_above_the_bound(spark):
    rng = random.Random(8)
    items = [(k, " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(15 + k % 46))) for k in range(460)]
    made = [(k, x) for k, text in items if (x := near_copy(rng, text))]
    docs = [(k, f"{prose(rng, 40)} {text} {prose(rng, 40)}") for k, (text, _) in made]
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(made) > 400 and all(d == i for d, i in found)
    assert len(found) / len(made) >= 0.99


# --- skew ---


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_like_others(spark, how):
    from tessera.llm.runtime import HOT_ROWS, hot_join

    rows = spark.createDataFrame([(1, "a", k) for k in range(3 * HOT_ROWS)] + [(2, "b", k) for k in range(5)] + [(3, "c", 0), (None, "a", 1), (1, None, 2)], "x int, y string, v int")
    keyed = spark.createDataFrame([(1, "a", 10, 3 * HOT_ROWS), (2, "b", 20, 5), (4, "d", 40, 0)], "x int, y string, w int, rows_of long")
    plan = hot_join(rows, keyed, ["x", "y"], how)
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, plan.collect())) == sorted(map(repr, rows.join(keyed.drop("rows_of"), ["x", "y"], how).collect()))


def test_a_large_group_of_near_copies_in_small_blocks(spark, monkeypatch):
    from tests.llm.test_leaks_joins_models_shards import join_by_brute_force
    from tessera.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 100)
    rng = random.Random(6)
    base, rows = prose(rng, 40).split(), []
    for k in range(620):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.choice([0, 1, 20, 38, 39])] = f"n{rng.randrange(40)}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, rows[0][1]) for k in range(620)] + [(3000 + k, prose(rng, 30)) for k in range(20)]
    got = sorted(map(tuple, ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == join_by_brute_force(rows)


# --- urls ---


def test_hosts_of_thousands_of_labels(spark):
    from tessera.llm import url_rules

    rows = [(1, "http://" + "a." * 5000 + "com/de/x"), (2, "http://" + "a." * 5000 + "COM/fr/"), (3, "http://com/de/"), (4, "http://xcom/de/")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), url_rules.RULES).collect()}
    assert got == {1: ("com/de/", "block"), 2: ("com/fr/", "allow"), 3: ("com/de/", "block"), 4: (None, "allow")}
