import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.llm import language

WORDS = {"aa": "kata mona lipo sara taku".split(), "bb": "strung krecht zwirl pfandt schlock".split()}


def test_backpropagation_against_differences():
    model = language.BiGru.fresh(["x", "y", "z"], 3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 103, (5, 4)), rng.integers(0, 3, 4)
    weight = np.array([1.0, 2.0, 0.5, 1.0])
    _, grad = model.gradients(x, y, weight)
    for name in model.w:
        flat = model.w[name].reshape(-1)
        tried = [int(np.abs(grad[name]).argmax()), *rng.integers(0, flat.size, 3).tolist()]
        for k in tried:
            keep, found = flat[k], []
            for step in (1e-3, -1e-3):
                flat[k] = keep + step
                loss, _ = model.gradients(x, y, weight)
                found.append(loss)
            flat[k] = keep
            assert abs((found[0] - found[1]) / 2e-3 - grad[name].reshape(-1)[k]) < 1e-4


def corpus(n=120):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "o", "en"]) for _ in range(30)), lang))
    return rows


def test_learns_and_handles_odd_texts(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id % 4 <> 2"))
    assert model.languages == ["aa", "bb"]
    got = {r["doc_id"]: r for r in language.identify(df.select("doc_id", "text"), model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if i % 4 == 2]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !? 5"), (4, "kata " * 50_000), (5, "k" * 200_000), (5, "…kata…")], "doc_id long, text string")
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(odd, model).orderBy("doc_id").collect()]
    assert [x[1:] for x in found[:3]] == [("und", 0.0)] * 3
    assert found[3][1] == "aa" and all(0 < s <= 1 for _, _, s in found[3:])


def by_hand(model, symbols):
    """Probabilities at every symbol, one after the other in plain numbers."""
    w = {k: v.astype(float) for k, v in model.w.items()}
    logits = np.tile(w["bias"], (len(symbols), 1))
    for d in "fb":
        state = np.zeros(language.HIDDEN)
        for t in range(len(symbols)) if d == "f" else reversed(range(len(symbols))):
            c = symbols[t]
            z = 1 / (1 + np.exp(-(w["xz" + d][c] + state @ w["sz" + d])))
            r = 1 / (1 + np.exp(-(w["xr" + d][c] + state @ w["sr" + d])))
            new = np.tanh(w["xn" + d][c] + r * (state @ w["sn" + d]))
            state = z * state + (1 - z) * new
            logits[t] += state @ w["o" + d]
    p = np.exp(logits)
    return p / p.sum(1, keepdims=True)


def whole_by_hand(model, text):
    """A text's mean over all its bytes, chunk by chunk."""
    raw, total = list(text.encode()), np.zeros(len(model.languages))
    padded = [language.OUTSIDE] * language.WARM + raw + [language.OUTSIDE] * (language.CHUNK + language.WARM)
    for at in range(0, len(raw), language.CHUNK):
        p = by_hand(model, padded[at : at + language.CHUNK + 2 * language.WARM])
        total += p[language.WARM : language.WARM + min(language.CHUNK, len(raw) - at)].sum(0)
    return total / max(1, len(raw))


TEXTS = ["One, two one 33 ünï " + "long" * 20, "x", "", "é" * language.CHUNK, "ab cd. " * 100, "7", "z" * (language.CHUNK - 1), "z" * (language.CHUNK + 1)]


def test_every_byte_is_labelled():
    model = language.BiGru.fresh(["x", "y", "z"])
    got = model.pooled([t.encode() for t in TEXTS])
    for text, p in zip(TEXTS, got, strict=True):
        assert np.allclose(p, whole_by_hand(model, text), atol=1e-5)
    long = b"ab cd. " * 40_000
    assert np.allclose(model.pooled([long])[0], whole_by_hand(model, long.decode()[: 7 * language.CHUNK * 2]), atol=1e-3)


def test_query_against_brute_force(spark, monkeypatch, tmp_path):
    """The query's answers are those of the fitted weights, byte by byte, for every document."""
    from gridwright.llm import queries

    monkeypatch.setattr(language, "STEPS", 5)
    rows = [(i, t, lang) for i, t, lang in corpus(60)] + [(100 + i, t, None) for i, t in enumerate(TEXTS)] + [(200, None, "aa"), (None, "kata mona", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    held_out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    model = language.fit(df.where(~F.col("doc_id").isin([i for i, _, _ in rows if i is not None and held_out(i)]) | F.col("doc_id").isNull()).select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in queries.op5_language(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and {i for i, r in got.items() if r["held_out"]} == {i for i, _, _ in rows if held_out(i)}
    for i, text, _ in rows:
        p = whole_by_hand(model, text or "") if any(map(str.isalpha, text or "")) else np.zeros(2)
        assert abs(got[i]["score"] - p.max()) < 1e-4
        assert got[i]["lang_pred"] == (model.languages[int(p.argmax())] if p.any() else "und") or abs(p[0] - p[1]) < 1e-4


def test_empty_table_and_clashes(spark):
    model = language.BiGru.fresh(["x", "y"])
    none = spark.createDataFrame([], "doc_id long, text string, extra int")
    found = language.identify(none, model)
    assert found.columns == ["doc_id", "text", "extra", "lang_pred", "score"] and found.count() == 0
    with pytest.raises(ValueError, match="score"):
        language.identify(none.withColumnRenamed("extra", "score"), model)


def test_no_labels(spark):
    model = language.fit(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string"))
    assert language.identify(spark.createDataFrame([(1, "text")], "doc_id long, text string"), model).first()["lang_pred"] == "und"
