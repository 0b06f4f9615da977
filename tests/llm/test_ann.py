import numpy as np

from gridwright.llm import ann


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 65_536, (500, 4), np.uint16)
    code[100:200] = code[0] ^ (rng.random((100, 4)) < 0.5).astype(np.uint16)
    index = ann.Index(code)
    for radius in (0, 1, 3, 7, 25, 64):
        for q in (0, 150, 300):
            far = np.bitwise_count(code ^ code[q]).sum(1)
            assert index.within(code[q], radius).tolist() == np.flatnonzero(far <= radius).tolist()


def test_recall_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 300)
    monkeypatch.setattr(ann, "BLOCK", 20)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[500:560] = x[20]  # repeated vectors: ties go to the smaller id
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    rows += [(1000, None, ""), (1020, [0.0] * 16, ""), (1040, [None] + [1.0] * 15, ""), (1060, [float("nan")] * 16, ""), (None, [1.0] * 16, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 20))
    full, found = x.astype(np.float64), 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21))
        scores = full @ full[q]
        assert np.allclose([s for _, _, s in own], scores[[v for _, v, _ in own]])
        scores[q] = -np.inf
        found += len({v for _, v, _ in own} & set(np.lexsort((np.arange(900), -scores))[:20].tolist()))
    assert found >= 0.9 * 20 * len(got)
    assert [v for _, v, _ in got[20]] == list(range(500, 520))


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df).orderBy("rank").collect()] == [(1, 1, 0.5), (2, 2, -1.0)]
    assert ann.nearest(df.limit(0)).count() == 0
