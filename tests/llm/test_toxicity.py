import itertools
import random
import re
import zlib

import numpy as np
import pytest

from gridwright.llm import toxicity

CLEAN = "the and of river stone cloud walking yellow table garden morning silver people answer".split()
BAD = ["nastyword", "vilething"]


def corpus(n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) + rng.choice(["", "s", "ly", "ing"]) for _ in range(40)]
        toxic = int(i % 5 == 1 or i % 7 == 0)
        if toxic:
            words[rng.randrange(40)] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def cheapest(model, raw):
    """The reading of a token by trying all paths through its lattice."""
    options, last, apart = [], "", False
    for c in raw.lower():
        if c.isspace() or c in toxicity.SEPARATORS and c not in toxicity.LOOKALIKES:
            apart = bool(options)
            continue
        found = [(c, 0.0)] if c.isalpha() and c not in toxicity.LOOKALIKES else [(x, toxicity.SWAP) for x in toxicity.LOOKALIKES.get(c, "")] + [(c, toxicity.ODD)] + [("", toxicity.SWAP)] * (c in toxicity.SEPARATORS)
        found = found + [("", toxicity.DROP)] * (c == last)
        options.append([(gap, *way) for way in found for gap in ([False, True] if apart and way[0] else [False])])
        last, apart = c, False
    best = []
    for way in itertools.product(*options):
        a = b = 0
        cost, text = 0.0, ""
        for gap, piece, price in way:
            if gap and not b:
                cost = np.inf  # a word cannot end before it has begun
                break
            if gap:
                cost += toxicity.GAP - model.log_p[a, b, 0]
                a, b, text = b, 0, text + " "
            cost += price
            if piece:
                k = toxicity.class_of(piece)
                cost -= model.log_p[a, b, k]
                a, b, text = b, k, text + piece
        best.append((cost - model.log_p[a, b, 0], text))
    return min(best)[1]


def test_viterbi_finds_the_cheapest_path():
    model = toxicity.ToxicityModel(np.log(np.random.default_rng(1).dirichlet(np.ones(28), (28, 28))))
    for raw in ["1d10t", "aab", "s3x", "b00k", "x", "a.b.c", "i d  i\no t", "well-known", "*bc*", "aa-bb", "8-8"]:
        assert model.restore(raw) == cheapest(model, raw)


def test_query_against_brute_force(spark, tmp_path):
    """Every document's score from its text, restored by trying all paths, and the learned entries."""
    from gridwright.llm import queries

    rows, labels = corpus(200)
    odd = ["n4styword", "nastyword.", "na-sty-word", "n a s t y w o r d", "v1leth!ng", "yellow 8-8 b00k", "", "a  b c", "NASTYWORD, x"]
    rows += [(1000 + i, t) for i, t in enumerate(odd)] + [(2000, None), (None, "vilething")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in queries.op9_toxicity(spark, str(tmp_path)).collect()}
    model = toxicity.fit_outside_fold(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert len(got) == len(rows)
    for i, text in rows:
        text, words = text or "", set()
        spelled = re.findall(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)", text)
        for run in spelled:
            words.update(re.findall(r"[^\W\d_]+", cheapest(model, run)))
            text = text.replace(run, " ")
        for token in text.lower().split():
            words.update(re.findall(r"[^\W\d_]+", cheapest(model, token.strip(".,"))))
        clean = 1 - model.base
        for f in {f for w in words for f in [w + "$", *(w[:n] for n in range(4, 9) if n <= len(w))]} & set(model.entries):
            clean *= 1 - model.entries[f]
        assert abs(got[i]["score"] - (1 - clean)) < 1e-9 and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
        assert got[i]["held_out"] == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0)
    assert sum(r["predicted"] for r in got.values()) > 40


def test_trigrams_by_hand():
    counts = toxicity.trigram_counts("Ab é")
    assert counts.sum() == 5
    assert counts[(0 * 28 + 1) * 28 + 2] == 1 and counts[(2 * 28 + 0) * 28 + 27] == 1


def test_learns_and_sees_through_disguise(spark):
    rows, labels = corpus()
    documents, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_outside_fold(documents, marks)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_texts(documents, model).collect()}
    right = [(scored[i] >= 0.5) == bool(t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(right) > 40 and np.mean(right) > 0.98
    odd = ["n4styword", "naaastyword", "n a s t y w o r d", "v.i.l.e.t.h.i.n.g", "v1leth!ng", "plain", "", None]
    df = spark.createDataFrame([(i, f"river {t} stone" if t else t, "x") for i, t in enumerate(odd)], "doc_id long, text string, restored string")
    got = [r["score"] >= 0.5 for r in toxicity.score_texts(df, model).orderBy("doc_id").collect()]
    assert got == [True] * 5 + [False] * 3
    back = toxicity.restore_texts(df, model, restored="back").orderBy("doc_id").collect()
    assert back[0]["back"] == "river nastyword stone" and back[7]["back"] is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = toxicity.fit_outside_fold(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert model.entries == {}
    assert toxicity.score_texts(empty, model).count() == 0 == toxicity.restore_texts(empty, model).count()
    for f, name in ((toxicity.score_texts, "score"), (toxicity.restore_texts, "restored")):
        with pytest.raises(ValueError, match=name):
            f(empty.selectExpr("*", f"1 as {name}"), model)
    long = spark.createDataFrame([(1, "n4sty " * 50_000)], "doc_id long, text string")
    assert len(toxicity.restore_texts(long, model).first()["restored"]) > 200_000
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    assert toxicity.fit_outside_fold(twice, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).entries == {}
    one = spark.createDataFrame([(None, None), (None, "x" * 100_000 + " 1" * 50_000)], "doc_id long, text string")
    assert [r["score"] for r in toxicity.score_texts(one, model).collect()] == [0.0, 0.0]


def test_doubled_letters_and_wide_spelling(spark):
    rows, labels = corpus()
    documents, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_outside_fold(documents, marks)
    odd = ["naastyword", "vilethiing", "nnasttyword", "n  a  s  t  y  w  o  r  d", "v\ni\nl\ne\nt\nh\ni\nn\ng", "v \t i l  e\r\nt h i n g", "yellow", "y  e  l  l  o  w"]
    df = spark.createDataFrame([(i, f"river {t} stone") for i, t in enumerate(odd)], "doc_id long, text string")
    assert [r["score"] >= 0.5 for r in toxicity.score_texts(df, model).orderBy("doc_id").collect()] == [True] * 6 + [False] * 2
    assert model.restored_text("yellow") == "yellow"
