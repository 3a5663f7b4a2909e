import math
import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinolith.llm import bpe, canonical, knn, leaks, nearest, runs, topn

NAN = float("nan")


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 16):
        held = [sorted((rng.choice("abc"), rng.randint(0, 9), i) for i in range(rng.randint(1, 12))) for _ in range(k)]
        runs_ = [topn.Run(iter([rows[:5], [], rows[5:]]), 1) for rows in held]
        got = [(r, row) for r, row in topn.merge_runs(runs_, [topn.By("x")], 3)]
        want = []
        for g in "abc":
            rows = sorted(row[1] for rows in held for row in rows if row[0] == g)[:3]
            want += [(i + 1, g, v) for i, v in enumerate(rows)]
        assert [(r, row[0], row[1]) for r, row in got] == want


def test_top_n(spark):
    rows = [("hot" if i % 2 else f"g{i % 5}", float(i % 4), None if i % 6 == 0 else i % 3, f"q{i}", "clash") for i in range(300)]
    rows += [(None, NAN, 1, "n1", ""), (None, None, 1, "n2", ""), (None, -0.0, 1, "z2", ""), (None, 0.0, 1, "z1", ""), ("d", 1.0, 1, "r", ""), ("d", 1.0, 1, "r", "")]
    df = spark.createDataFrame(rows, "g string, s double, f int, q string, bucket_ string").repartition(6)
    order = [topn.By("s", True), topn.By("f"), topn.By("q", True)]
    got = defaultdict(list)
    for r in topn.top_n_per_group(df, ["g"], order, 4, block_rows=16).collect():
        got[r.g].append((r.rank_no, r.q))
    key = lambda x: (x[1] is None, -(math.inf if x[1] != x[1] else x[1] or 0.0), x[2] is None, x[2] or 0, [-ord(c) for c in x[3]] + [1])
    for g in {r[0] for r in rows}:
        want = [x[3] for x in sorted([r for r in rows if r[0] == g], key=key)][:4]
        assert [q for _, q in sorted(got[g])] == want, g
    several = sorted(repr(tuple(r)) for r in topn.top_n_per_group(df, ["g"], order, 4, block_rows=16, fan_in=2).collect())  # three levels of merges
    assert several == sorted(repr(tuple(r)) for r in topn.top_n_per_group(df, ["g"], order, 4).collect())
    assert topn.top_n_per_group(df.limit(0), ["g"], order, 4).count() == 0
    with pytest.raises(ValueError):
        topn.top_n_per_group(df.withColumnRenamed("f", "rank_no"), ["g"], [topn.By("rank_no")], 4)


def brute_runs(rows, penalty):
    by = defaultdict(dict)
    for v, o, x, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], math.inf if r[2] is None or r[2] != r[2] else r[2], math.inf if r[3] is None else r[3])):
        by[v].setdefault(o, (x, t))
    out = []
    for v, events in by.items():
        cur = None
        for o, (x, t) in events.items():
            bad = x is None or x != x
            if cur and not bad and o == cur[1] + 1 and abs(x - cur[2]) <= penalty:
                cur = [cur[0], o, x, cur[3] + 1]
            else:
                if cur:
                    out.append((v, cur[0], cur[1], cur[3]))
                cur = None if bad else [o, o, x, 1]
        if cur:
            out.append((v, cur[0], cur[1], cur[3]))
    return sorted(out, key=repr)


def squares(values):
    m = sum(values) / len(values)
    return sum((v - m) ** 2 for v in values)


def best_cost(values, penalty, weight):
    n = len(values)
    cuts = ([0, *[i + 1 for i in range(n - 1) if bits >> i & 1], n] for bits in range(1 << (n - 1)))
    return min(sum(weight * squares(values[a:z]) for a, z in zip(c, c[1:])) + penalty * (len(c) - 2) for c in cuts)


def cost_of(values, starts, penalty, weight):
    c = [*starts, len(values)]
    return sum(weight * squares(values[a:z]) for a, z in zip(c, c[1:])) + penalty * (len(starts) - 1)


def test_segmentation_is_optimal():
    rng = random.Random(2)
    widest, by_threshold = 0, 0
    for _ in range(300):
        values = [rng.choice([0.0, 0.1, 0.2, 0.5, 1.0]) + rng.choice([0.0, 0.01]) for _ in range(rng.randint(1, 10))]
        starts = runs.segment(values, 0.05, 1.0)
        assert cost_of(values, starts, 0.05, 1.0) == pytest.approx(best_cost(values, 0.05, 1.0))
        x, n = runs.squeeze(values)
        solver = runs.Segmenter(0.05, 1.0)
        solver.starts(x, n)
        widest = max(widest, solver.most)
        by_threshold += starts == [0, *[i for i in range(1, len(values)) if abs(values[i] - values[i - 1]) > math.sqrt(0.1)]]
        assert runs.segment(values, 0.05, 0.0) == [0]
    assert widest > 3 and by_threshold < 250  # several starts live, and the result is no comparison of neighbours
    drift = [i * 0.01 for i in range(40)]
    assert len(runs.segment(drift, 0.05, 1.0)) > 1


def test_certain_boundaries_hold_in_any_surroundings():
    rng = random.Random(3)
    seen = 0
    for _ in range(150):
        middle = [rng.choice([0.0, 1.0, 2.0]) + rng.random() / 10 for _ in range(12)]
        certain = runs.Segmenter(0.2, 1.0, 0.2).starts(middle, [1] * 12)[1]
        seen += len(certain)
        for _ in range(4):
            before, after = ([rng.random() * 3 for _ in range(rng.randint(0, 6))] for _ in range(2))
            whole = runs.segment(before + middle + after, 0.2, 1.0)
            assert {len(before) + c for c in certain} <= set(whole)
    assert seen > 100


def test_levels_do_not_depend_on_blocks(spark):
    rng = random.Random(5)
    rows = []
    for v in ("a", None):
        x = 0.0
        for o in range(400):
            x += rng.choice([0, 0, 0, 0.02, -0.02, 0.3, -0.3])
            if rng.random() < 0.97:
                rows.append((v, o, NAN if rng.random() < 0.02 else x + rng.choice([0, 0.01]), o * 40.0))
    rows += [("c", o, float("inf"), 0.0) for o in range(60)] + [("d", o, o * 0.01, 0.0) for o in range(200)]
    df = spark.createDataFrame(rows, "v string, o long, x double, t double")
    got = [sorted([tuple(r) for r in runs.collapse_runs(df, "v", "o", "x", "t", 0.31, 0.05, 1.0, block=block).collect()], key=repr) for block in (16, 50, 10_000)]
    assert got[0] == got[1] == got[2] and ("c", 0, 59) in {r[:3] for r in got[0]} and sum(r[0] == "d" for r in got[0]) > 5
    values = {(v, o): x for v, o, x, _ in rows}
    for v, first, last, n, *_ in got[0]:
        assert n == last - first + 1 and all((v, o) in values for o in range(first, last + 1))


def test_runs(spark):
    rng = random.Random(4)
    rows = []
    for v in ("a", None, "b"):
        x = 0.0
        for o in range(300):
            x += rng.choice([0, 0, 0.01, -0.01, 0.5])
            if rng.random() < 0.95:
                rows.append((v, o, NAN if rng.random() < 0.03 else x, None if rng.random() < 0.1 else o * 40.0))
    rows += rows[:20] + [("a", None, 1.0, 1.0), ("a", 7, 99.0, 3.0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "v string, o long, x double, t double, ent string")
    for block in (7, 1000):
        got = sorted([(r.v, r.first_id, r.last_id, r.n_events) for r in runs.collapse_runs(df, "v", "o", "x", "t", 0.02, least=1, block=block).collect()], key=repr)
        assert got == brute_runs(rows, 0.02)
        long_ = runs.collapse_runs(df, "v", "o", "x", "t", 0.02, least=4, block=block)
        assert sorted([(r.v, r.first_id, r.last_id, r.n_events) for r in long_.collect()], key=repr) == [x for x in got if x[3] >= 4]
    assert runs.collapse_runs(df.limit(0), "v", "o", "x", "t", 0.02).count() == 0


def test_trie():
    rng = random.Random(5)
    for _ in range(30):
        times = sorted(rng.sample(range(256), rng.randint(1, 40)))
        trie = nearest.XFastTrie(times, 8)
        for q in range(256):
            assert trie.neighbours(q) == (max((t for t in times if t <= q), default=None), min((t for t in times if t > q), default=None))


def test_nearest(spark):
    rng = random.Random(6)
    points = [(rng.choice("ab"), rng.randint(-300, 300), i) for i in range(60)] + [("a", 5, None), (None, 5, 1), ("a", None, 3), ("a", 5, 900), ("a", 5, 900)]
    events = [(rng.choice("abc"), rng.randint(-320, 320) + rng.choice([0.0, 0.5]), f"e{i}") for i in range(150)] + [("a", None, "n"), (None, 1.0, "m"), ("a", NAN, "o")]
    left = spark.createDataFrame(events, "v string, t double, e string")
    right = spark.createDataFrame([(*p, "x") for p in points], "v string, s long, i long, t string")
    for bits, hot in ((4, 1000), (5, 3), (17, 10)):
        got = {r.e: (r.i, r.nearest_time) for r in nearest.nearest_in_time(left, right, "v", "t", "s", "i", 12, ["e"], bits, hot).collect()}
        want = {}
        for v, t, e in events:
            near = [(abs(s - t), s, i) for w, s, i in points if w == v and v and s is not None and i is not None and t is not None and t == t and abs(s - t) <= 12]
            if near:
                want[e] = min(near)[2], min(near)[1]
        assert got == want
    far = {r.e: r.i for r in nearest.nearest_in_time(left, right, "v", "t", "s", "i", 500, ["e"], 4).collect()}  # a tolerance of many blocks
    assert len(far) == sum(v in ("a", "b") and t is not None and t == t for v, t, _ in events)
    assert nearest.nearest_in_time(left, right.limit(0), "v", "t", "s", "i", 12, ["e"]).count() == 0


def test_look_alike_letters(spark):
    alike = canonical.lookalikes()
    assert len(alike) > 800 and all(len(v) == 1 and v.isascii() and v.isalpha() for v in alike.values())
    assert {c: alike.get(c) for c in "αρυνΙІЗᎪ𝐚ꓐьЬא"} == {"α": "a", "ρ": "p", "υ": "u", "ν": "v", "Ι": "I", "І": "I", "З": None, "Ꭺ": "A", "𝐚": "a", "ꓐ": "B", "ь": None, "Ь": None, "א": None}
    assert all(c.isupper() <= v.isupper() for c, v in alike.items())


def test_form(spark):
    form = canonical.form_function()
    replace, _ = canonical.tables()
    assert form(None) is None and form("") == "" and form("plain text") == "plain text"
    assert form("Ｈｅ​ｌｌｏ　w") == "Hello w" and form("é") == "é" and form("раураl") == "paypal"
    assert form("é") == "é" and form("a\tb\r\nc") == "a b\r\nc" and form("ﬁ ² ½") == "ﬁ ² ½" and form("́a") == "́a"
    rng = random.Random(7)
    letters = "aeọ́̈​еі \t\n각가ÅéấＡ゙か‑ß"
    for _ in range(5000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))
        whole = unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(replace))
        assert form(s) == whole and form(whole) == whole
    long_ = "é" * 200_000
    assert form(long_) == "é" * 200_000


def test_look_alikes(spark):
    rows = [(1, "раураl x"), (2, "paypal x"), (3, "paypal x"), (4, "Paypal x"), (5, None), (6, ""), (7, " "), (8, " "), (9, "paypal x"), (9, "paypal x"), (10, "​"), (11, "paypal  x")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, form_key string")
    got = {tuple(r) for r in canonical.look_alikes(df).collect()}
    assert got == {(1, 2), (1, 3), (1, 9), (2, 9), (3, 9)}
    assert {tuple(r) for r in canonical.look_alikes(df, hot_rows=1).collect()} == got
    classes = {r.doc_id: (r.class_id, r.n_texts) for r in canonical.look_alike_classes(df).collect()}
    assert classes[9] == (1, 3) and classes[4] == (4, 1) and 6 not in classes
    assert canonical.look_alikes(df.limit(0)).count() == 0


def test_bpe_equals_library():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(8)
    texts = ["", " ", "<|endoftext|>", "a" * 5000, "ab" * 3000, "Xin chào các bạn 👩‍👧 ½ \n\n\t x", "don't we'll 12345 !!!???", "\x00\x7f­ ﻿"]
    texts += ["".join(rng.choice("aabcé ộ1\n'st!漢") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    e = bpe.Encoder(bpe.default_vocabulary(), cache=50)
    for x in texts:
        assert e.encode(x) == t.encode(x, add_special_tokens=False).ids
    assert e.encode(None) == []


def test_bitmap_queue():
    rng = random.Random(9)
    q, held = bpe.BitmapQueue(600_000), defaultdict(list)
    for _ in range(3000):
        if rng.random() < 0.6:
            r, p = rng.randint(0, rng.choice([49_999, 599_999])), rng.randint(0, 9)
            q.push(r, p)
            held[r].append(p)
        elif held:
            least = min(held)
            assert q.pop() == (least, held.pop(least))


def test_encode_documents(spark):
    df = spark.createDataFrame([(1, "Hello", "x"), (1, "Hello", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, ids string")
    assert sorted((r.doc_id, r.ids) for r in bpe.encode_documents(df).collect()) == [(1, [15496]), (2, []), (3, [])]


def test_leaks(spark):
    rng = random.Random(10)
    vocab = [f"w{i}" for i in range(300)]
    item = {i: [rng.choice(vocab) for _ in range(40)] for i in range(5)}
    item[9] = item[0][:11]
    docs = {}
    for d in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 90))]
        if d % 3 == 0:
            i, a, n = rng.randint(0, 4), rng.randint(0, 26), rng.choice([11, 12, 13, 20])
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if d % 2 else w.replace("w", "ｗ") for w in item[i][a : a + n]]
        docs[d] = " , ".join(words)
    want = set()
    for d, t in docs.items():
        w = t.lower().replace("ｗ", "w").split(" , ")
        for i, x in item.items():
            if any(w[a : a + 12] == x[b : b + 12] for a in range(len(w) - 11) for b in range(len(x) - 11)):
                want.add((d, i))
    df = spark.createDataFrame([(d, t, 1) for d, t in docs.items()] + [(1000, None, 1), (0, docs[0], 1)], "doc_id long, text string, words int")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in item.items()] + [(50, None), (51, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, items).filter("kind = 'verbatim'").collect()}
    assert got == want
    blocks = {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, items, block_words=45).filter("kind = 'verbatim'").collect()}  # an item a block
    assert blocks == want
    assert leaks.find_leaks(df.limit(0), items).count() == 0 and leaks.find_leaks(df, items.limit(0)).count() == 0
    assert leaks.common_subsequence([1, 2, 3, 4], [2, 9, 4]) == 2


def test_paraphrases_equal_an_exhaustive_check(spark):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(400)]
    items = {i: [rng.choice(vocab) for _ in range(n)] for i, n in ((1, 13), (2, 24), (3, 30), (4, 37))}
    docs = {}
    for d in range(40):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 25))]
        if d % 4:
            every, at = d % 4 + 2, rng.randint(0, len(words))
            words[at:at] = [f"x{d}" if j % every == every - 1 else w for j, w in enumerate(items[rng.randint(1, 4)])]
        docs[d] = words
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    idf = leaks.inverse_frequencies(df.select(leaks.word_hashes("text").alias("words")))
    hashed = leaks.word_function()
    want = set()
    for d, i in ((d, i) for d in docs for i in items):
        x, y = np.array(hashed(" ".join(docs[d])), np.int64), np.array(hashed(" ".join(items[i])), np.int64)
        if len(x) < 12 or any((x[p : p + 12] == y[q : q + 12]).all() for p in range(len(x) - 11) for q in range(len(y) - 11)):
            continue
        for p, q in ((p, q) for p in range(0, len(x) - 7, 5) for q in range(len(y) - 7)):
            a, b = x[max(0, p - 12) : p + 20], y[max(0, q - 8) : q + 16]
            weight = idf[leaks.bins(b)]
            answer = set(b[weight >= np.quantile(weight, 0.75)].tolist())
            if len(answer & set(a.tolist())) >= 0.7 * len(answer) and leaks.common_subsequence(b.tolist(), a.tolist()) >= 0.7 * len(b):
                want.add((d, i))
    held = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = leaks.find_leaks(df, held, cosine=0.9, paraphrases=True).filter("kind = 'paraphrase'").collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want) and len(want) > 12
    small = leaks.find_leaks(df, held, cosine=0.9, paraphrases=True, block_words=30).filter("kind = 'paraphrase'").collect()
    assert sorted((r.doc_id, r.item_id) for r in small) == sorted(want)
    said = held.withColumn("answer", F.when(F.col("item_id") == 2, F.lit("w1 nowhere")).otherwise(F.lit("")))
    only = leaks.find_leaks(df, said, cosine=0.9, paraphrases=True, answer="answer").filter("kind = 'paraphrase'").collect()
    assert sorted((r.doc_id, r.item_id) for r in only) == sorted(x for x in want if x[1] != 2)
    same = np.random.default_rng(2).random((50, 24, 32)) < 0.1
    table = np.zeros((50, 25, 33), int)
    for x in range(24):
        for y in range(32):
            table[:, x + 1, y + 1] = np.maximum(np.maximum(table[:, x, y + 1], table[:, x + 1, y]), table[:, x, y] + same[:, x, y])
    assert leaks.common_subsequences(same).tolist() == table[:, 24, 32].tolist()


def test_adaptive_scan_keeps_near_pairs():
    rng = np.random.default_rng(1)
    x = knn.unit(rng.standard_normal((300, 64))).astype(np.float32)
    q = knn.unit(x + 0.03 * rng.standard_normal(x.shape)).astype(np.float32)
    rows, cols = knn.adaptive_scan(q, x, np.full(300, 0.2))
    near = {(i, j) for i, j in zip(*np.nonzero(2 - 2 * q @ x.T <= 0.2))}
    assert near <= set(zip(rows, cols)) and len(rows) < 2000


def test_nearest_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 8))
    rows = [(f"v{i:03d}", "m", 8, base[i % 60].tolist() if i < 80 else (base[i % 60] + 0.1 * rng.standard_normal(8)).tolist(), "x") for i in range(160)]
    rows += [rows[0], ("bad1", "m", 8, None, ""), ("bad2", "m", 8, [0.0] * 8, ""), ("bad3", "m", 8, [NAN] + [1.0] * 7, ""), ("bad4", "m", 9, [1.0] * 8, ""), ("solo", None, 2, [1.0, 0.0], "")]
    df = spark.createDataFrame(rows, "id string, model string, dim int, vec array<float>, grp string")
    good = {r[0]: knn.unit(np.array([r[3]], np.float32).astype(float))[0] for r in rows if not r[0].startswith(("bad", "solo"))}
    for block, hot in ((8192, 10**6), (20, 10)):
        got = defaultdict(list)
        for r in knn.nearest_vectors(df, "id", "vec", "model", "dim", 5, least=0.5, list_rows=1000, block_rows=block, hot_rows=hot).collect():
            got[r.id].append((r.rank_no, r.neighbour_id))
        for i, v in good.items():
            want = sorted((-round(float(v @ w), 6), j) for j, w in good.items() if j != i and v @ w >= 0.5)[:5]
            assert [j for _, j in sorted(got[i])] == [j for _, j in want], i
    assert knn.nearest_vectors(df.limit(0), "id", "vec", "model", "dim", 5).count() == 0


def test_lists_in_two_levels(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((40, 16))
    v = knn.unit(centre[rng.integers(0, 40, 4000)] + 0.4 * rng.standard_normal((4000, 16))).astype(np.float32)
    lists = knn.Lists(v[:5], v[:50], np.array([0, 10, 20, 30, 40, 50]), np.ones(50, np.int64))
    near, sim = lists.nearest(v[:20], 4, cells=5)
    want = np.sort(v[:20] @ v[:50].T, axis=1)[:, ::-1][:, :4]
    assert np.allclose(sim, want, atol=1e-5) and np.allclose((v[:20, None] * v[:50][near]).sum(2), sim, atol=1e-5)
    monkeypatch.setattr(knn, "FLAT", 8)
    monkeypatch.setattr(knn, "CELL_LISTS", 8)
    df = spark.createDataFrame([(f"v{i:04d}", "m", 16, x.tolist()) for i, x in enumerate(v)], "id string, model string, dim int, vec array<float>")
    rows = df.select(F.lit("g").alias("grp"), "id", F.col("vec").alias("vector"))
    fitted = knn.fit_lists(rows, 50, 8192)["g"]
    assert len(fitted.cells) == 10 and 60 <= len(fitted.centres) <= 100 and fitted.first[-1] == len(fitted.centres) == len(fitted.blocks)
    asks = F.substring("id", 2, 9).cast("long") % 50 == 0
    got = knn.nearest_vectors(df, "id", "vec", "model", "dim", 10, queries=asks, probes=0.2, list_rows=50).collect()
    hits = 0
    for i in range(0, 4000, 50):
        s = v @ v[i]
        s[i] = -2
        hits += len({f"v{j:04d}" for j in np.argsort(-s)[:10]} & {r.neighbour_id for r in got if r.id == f"v{i:04d}"})
    assert hits / 800 > 0.9
