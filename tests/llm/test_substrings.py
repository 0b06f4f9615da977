import random
import re

from gridwright.llm import substrings


def plain(rows):
    """rows: (order, text). Words, words removed and kept text of each, by brute force."""
    seen, out = {}, []
    split = [(o, re.findall("[^\x20\x09-\x0d]+", t or "")) for o, t in rows]
    for o, words in split:
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            seen[w] = min(seen.get(w, (o, k)), (o, k))
    for o, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            if seen[tuple(words[k : k + 20])] < (o, k):
                gone[k : k + 20] = [True] * 20
        out.append((len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def corpus(n=80, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "日本"]
    shared = [[rng.choice(words) for _ in range(rng.randint(19, 60))] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "a " * 100), (3, " ".join(["b c"] * 60)), (4, " ".join(shared[0]))]
    for i in range(5, n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [rng.choice(words) for _ in range(rng.randint(0, 40))]
            own = list(rng.choice(shared))
            cut = rng.randint(0, 10)
            if rng.random() < 0.3:
                own[rng.randrange(len(own))] = "edited"
            parts += own[cut:]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(n, rows[10][1]), (n + 1, rows[10][1]), (n + 1, rows[10][1]), (n + 2, rows[11][1]), (n + 2, rows[12][1])]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, salt int")
    want = sorted((i, *x) for (i, _), x in zip(rows, plain(rows), strict=True))
    for parts in (1, 3):
        got = sorted(tuple(r) for r in substrings.dedup(df, parts).collect())
        assert got == want


def test_batches_runs_and_compaction(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_RUNS", 2)
    rows = corpus(60, 2)
    batches = [rows[i::5] for i in range(5)]
    want = plain([((b, i), t) for b, own in enumerate(batches) for i, t in own])
    index, got = substrings.SubstringIndex(spark), []
    for own in batches:
        got.append(sorted(tuple(r) for r in index.cleaned(spark.createDataFrame(own, "doc_id long, text string")).collect()))
    assert len(index.runs) <= 2
    at = 0
    for own, found in zip(batches, got, strict=True):
        assert found == sorted((i, *x) for (i, _), x in zip(own, want[at : at + len(own)], strict=True))
        at += len(own)


def test_null_ids_and_empty(spark):
    text = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (5, text)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.dedup(df).collect()}
    assert got == {None: 0, 5: 30}
    assert substrings.dedup(df.limit(0)).count() == 0
