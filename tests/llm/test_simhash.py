import re

import numpy as np
import xxhash

from gridwright.llm import simhash


def plain_fingerprint(text, width=3):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(fps))]


def test_fingerprint():
    for text in ["", " \t", "One", "one TWO", "a b c", "É a É b  c\x0bd e f", "x " * 500, None]:
        assert simhash.fingerprint(text or "", 3) == plain_fingerprint(text), text


def near(rng, n, groups):
    base = rng.integers(0, 2**64, groups, np.uint64)
    fps = base[rng.integers(0, groups, n)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n, np.uint64)) * rng.integers(0, 2, n).astype(np.uint64)
    return np.unique(fps)


def test_shards_and_blocks_lose_no_link(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = np.random.default_rng(1)
    fps = near(rng, 1500, 300)
    want = plain_components(list(map(int, fps)), 3)
    assert simhash.link(fps, 3).tolist() == want
    tree = simhash.plan(fps, 3, 3)
    assert tree
    forest = simhash.Forest(len(fps))
    for _, rows in simhash.leaves(tree, fps, np.arange(len(fps)), 3):
        rows = np.sort(rows)
        forest.join(rows, rows[simhash.link(fps[rows], 3)])
    forest.flatten()
    assert forest.up.tolist() == want


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 16)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", "  ", "Hello", "hello", "a b c"]
    for _ in range(60):
        own = list(rng.choice(words, 120))
        texts.append(" ".join(own))
        own[5] = "changed"
        texts += [" ".join(own)] * 2
    ids = [int(i) for i in rng.permutation(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, ids, strict=True)), "doc_id long, text string, fp long")
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_components(df).collect()}
    order = np.argsort(ids)
    fps = [plain_fingerprint(texts[i]) for i in order]
    top = plain_components(fps, 3)
    assert got == {i: (fps[i], top[i]) for i in range(len(ids))}


def test_ties_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "same text here now"), (3, "same text here now"), (3, "same text here now"), (3, "other words entirely so"), (2, "other words entirely so")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(df).collect()), key=str)
    assert got == [(2, 2), (3, 2), (3, 3), (3, 3), (None, 3)]
    assert simhash.simhash_components(df.where("doc_id is null")).first()["component_id"] is None
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_links_are_exact_around_the_threshold(spark):
    rows, want = [], set()
    for k in range(240):
        n, similarity = (30, 100, 300)[k % 3], (0.7, 0.75, 0.79, 0.8, 0.82, 0.85)[k // 3 % 6]
        words = [f"a{k}_{i}" for i in range(n)]
        shared = round(2 * n * similarity / (1 + similarity))  # of n single-word shingles each
        other = words[:shared] + [f"b{k}_{i}" for i in range(n - shared)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        if shared < 0.8 * (2 * n - shared):
            want.add(2 * k + 1)
    rows += [(900, "again and again " * 5), (901, "again and again " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(df, width=1).collect()}
    assert kept == {2 * k for k in range(240)} | want | {900}
