"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Fit, on a bounded sample: mean and four rotations by iterative quantization, which give a code of 4 x width bits; and
the Hamming radius within which the sample's true neighbours lie. Index: every vector's code, cut into substrings of 16
bits, each with a table from its value to the rows of a shard. Search: a code within the radius agrees with the query's
in some substring up to radius // substrings bits, so probing all values that near finds every such code. What is found
is checked by its whole code and then ranked by inner products of the vectors in double precision.

The stated queries meet all rows in blocks of bounded size; each block gives out k rows for each query, and a grouped
top-k merges them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwright.llm._shared import bounded_sample, settle

SAMPLE, ROUNDS, ROTATIONS = 4096, 12, 4
#: Rows of a shard and queries of a block, about.
SHARD, BLOCK = 32_768, 4096
#: Share of the sample's true neighbours that the radius holds.
KEPT = 0.95
POPCOUNT = np.bitwise_count(np.arange(65_536, dtype=np.uint16))


def rotations(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Columns that turn centred rows into bits: for each of several random starts the rotation that, by turns, fits
    the signs of the turned rows best."""
    d = x.shape[1]
    found = []
    for _ in range(ROTATIONS):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ vt).T
        found.append(r)
    return np.concatenate(found, 1)


def codes(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """(rows, substrings) of 16 bits."""
    bits = (x - mean) @ turn > 0
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 16)))
    return np.packbits(bits, axis=1, bitorder="little").view("<u2")


def fit(sample: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, rotation and radius."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    turn = rotations(sample - mean, rng)
    own = codes(sample, mean, turn)
    far = []
    for q in range(0, len(sample), max(1, len(sample) // 256)):
        scores = sample @ sample[q]
        scores[q] = -np.inf
        near = np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]
        far.append(POPCOUNT[own[near] ^ own[q]].sum(1, dtype=np.int64))
    return mean, turn, int(np.quantile(np.concatenate(far), KEPT)) if len(sample) > 1 else own.shape[1] * 16


NEAR = [np.flatnonzero(POPCOUNT <= k).astype(np.uint16) for k in range(17)]


class Index:
    """A shard's tables: for each substring the values that occur, each row's place among them, and a table from any
    value to its place (one past the last for those that don't occur)."""

    def __init__(self, code: np.ndarray):
        self.code = np.ascontiguousarray(code)
        self.words = self.code.view(np.uint64) if code.shape[1] % 4 == 0 else self.code
        self.tables = []
        for j in range(code.shape[1]):
            values, place = np.unique(code[:, j], return_inverse=True)
            where = np.full(65_536, len(values), np.int32)
            where[values] = np.arange(len(values))
            self.tables.append((values, place.astype(np.intp), where))

    def probe(self, j: int, value: np.uint16, most: int) -> np.ndarray:
        """Rows (as flags) whose substring j is within `most` bits of value: all values so near are looked up, or the
        values that occur are run through where those are fewer."""
        values, place, where = self.tables[j]
        near = np.zeros(len(values) + 1, bool)
        if len(NEAR[most]) < len(values):
            near[where[NEAR[most] ^ value]] = True
        else:
            np.less_equal(np.bitwise_count(values ^ value), most, out=near[:-1])
        return near.take(place)

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within radius of the query's. Of m substrings, radius // m bits may differ in one; only
        the first radius % m + 1 of them need that many, the others one less."""
        m = self.code.shape[1]
        marked = np.zeros(len(self.code), bool)
        for j in range(m):
            most = radius // m - (j > radius % m)
            if most >= 0:
                marked |= self.probe(j, query[j], min(most, 16))
        rows = np.flatnonzero(marked)
        whole = query.view(np.uint64) if self.words is not self.code else query
        words = self.words if len(rows) == len(marked) else self.words.take(rows, 0)
        far = np.bitwise_count(words ^ whole)
        return rows[sum(far[:, k].astype(np.int16) for k in range(far.shape[1])) <= radius]


def search(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, mean, turn, radius: int):
    """(query, row, score) of each query's k best among the rows found; all rows where the codes give fewer than k."""
    index, own = Index(codes(x, mean, turn)), codes(queries, mean, turn)
    for q in range(len(queries)):
        rows = index.within(own[q], radius)
        rows = rows[ids[rows] != query_ids[q]]
        if len(rows) < k:
            rows = np.flatnonzero(ids != query_ids[q])
        scores = (x[rows] * queries[q]).sum(1)
        best = np.lexsort((ids[rows], -scores))[:k]
        yield q, rows[best], scores[best]


def nearest(df: DataFrame, k: int = 20, every: int = 20, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`, by inner product.

    Rows with a null id, or whose vector is null, zero, of another length than the first kept, or holds null or
    non-finite components, take no part. Rows that share an id count as one: the largest vector. An empty df gives no rows.
    """
    v = F.col("v")
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    rows = rows.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0))
    rows = settle(rows.groupBy("id").agg(F.max("v").alias("v")), "ann-vectors")  # read several times
    spark = df.sparkSession
    drawn = bounded_sample(rows, SAMPLE, "id").select("v").toArrow().column("v").to_pylist()
    if not drawn:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = len(drawn[0])
    rows = rows.where(F.size("v") == width)
    mean, turn, radius = fit(np.array([x for x in drawn if len(x) == width]), k)
    n = rows.count()
    shards, blocks = math.ceil(n / SHARD), math.ceil(n / every / BLOCK)
    mine = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int")
    as_rows = rows.select(mine.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "id", "v")
    as_queries = rows.where(F.col("id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"), F.lit(True).alias("asks"), "id", "v")

    def run(key, group):
        asks = group.column("asks").to_numpy()
        ids = group.column("id").to_numpy()
        x = group.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width)
        out = [[], [], []]
        for q, found, scores in search(x[asks], ids[asks], x[~asks], ids[~asks], k, mean, turn, radius):
            out[0].append(np.full(len(found), ids[asks][q]))
            out[1].append(ids[~asks][found])
            out[2].append(scores)
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        return pa.table({"query_id": join(out[0], np.int64), "vec_id": join(out[1], np.int64), "score": join(out[2], np.float64)})

    found = as_rows.union(as_queries).groupBy("shard", "block").applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
