import random

import numpy as np

from gridwright.llm import contamination as c


def plain_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_against_brute_force():
    rng = np.random.default_rng(1)
    items = [rng.integers(0, 6, rng.integers(1, 20)).astype(np.int32) for _ in range(60)]
    texts = [rng.integers(0, 6, rng.integers(1, 30)).astype(np.int32) for _ in range(60)]
    score, first, end = c.smith_waterman(items, texts)
    for a, b, s, lo, hi in zip(items, texts, score, first, end, strict=True):
        assert s == plain_align(a, b)
        assert plain_align(a, b[lo:hi]) == s


def corpus():
    rng = random.Random(5)
    common, rare = "the of and to in a is it".split(), [f"w{i}" for i in range(400)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else rng.choice(rare)
    items = [(i, [word() for _ in range(rng.randint(20, 60))]) for i in range(12)]
    docs = []
    for i in range(80):
        words = [word() for _ in range(rng.randint(0, 150))]
        if i % 4 == 0:
            own = list(items[i // 4 % 12][1])
            if i % 8 == 0:
                own = [x for x in own if rng.random() > 0.1]
                own[3] = "edited"
            at = rng.randint(0, len(words))
            words[at:at] = own
        docs.append((i, " ".join(words)))
    return [(i, ", ".join(x).upper()) for i, x in items], docs


def test_same_as_aligning_everything(spark):
    items, docs = corpus()
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in c.contaminated(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        for i, own in items:
            a, b = c.words_of(own), c.words_of(t)
            s = plain_align(a, b) / (2 * len(a))
            if s >= c.LEAST_SCORE:
                want[d, i] = s
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert {d for d, _ in want} >= {i for i in range(0, 80, 4)}


def test_blocks_of_items_and_odd_rows(spark):
    items, docs = corpus()
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "too short"), (None, items[0][1]), (0, items[0][1])], "item_id long, text string")
    df = spark.createDataFrame([*docs, (None, None), (None, items[0][1]), (5, ""), (6, items[1][1] + " x" * 100_000)], "doc_id long, text string")
    whole = sorted(map(str, c.contaminated(df, bench).collect()))
    parts = sorted(map(str, c.contaminated(df, bench, block_words=70).collect()))
    assert whole == parts and any("doc_id=None" in x for x in whole)
    assert c.contaminated(df.limit(0), bench).count() == 0 and c.contaminated(df, bench.limit(0)).count() == 0


def found(spark, items, docs):
    got = c.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]) for r in got.collect()}


def test_evenly_spaced_edits_of_the_only_copy(spark):
    rng = random.Random(8)
    items, docs, want = [], [], set()
    for k in range(60):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(8, 59))]
        every, kind = rng.randint(3, 8), k % 3
        text = []
        for i, w in enumerate(own):
            edited = i % every == every - 1
            text += ["odd"] if edited and kind == 0 else [] if edited and kind == 1 else [w, "odd"] if kind == 2 and (edited or k % 2) else [w]
        items.append((k, " ".join(own)))
        docs.append((k, " ".join(["x"] * 30 + text + ["y"] * 30)))
        if plain_align(own, text) >= len(own):
            want.add((k, k))
    assert len(want) > 40 and found(spark, items, docs) == want


def test_short_items_word_by_word_and_passages_of_long_ones(spark):
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    long, pad = text(200), ["x"] * 20
    items = [(1, "one short item"), (2, "single"), (3, " ".join(long))]
    edited = ["odd" if i % 6 == 5 else w for i, w in enumerate(long[60:155])]
    cut = {1: pad + ["one", "short", "item"] + pad, 2: ["one", "short", "x", "item"], 3: pad + ["Single"], 4: pad + long[52:147] + pad, 5: edited, 6: long[71:91] + pad, 7: long[71:86] + pad, 8: pad + long[:95] + pad * 30 + long[100:190]}
    assert found(spark, items, [(k, " ".join(x)) for k, x in cut.items()]) == {(1, 1), (3, 2), (4, 3), (5, 3), (6, 3), (8, 3)}
    one = c.contaminated(spark.createDataFrame([(8, " ".join(cut[8]))], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["first_word"], r["end_word"], r["score"]) for r in one) == [(20, 115, 95 / 200), (715, 805, 90 / 200)]
