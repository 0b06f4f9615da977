"""SimHash near-duplicate detection with vantage-point trees over fingerprints.

Fingerprints: 64 bits, a majority vote of the XXH64 (seed 42) of all word shingles. Equal fingerprints are one point.
A tree of vantage points, fitted on a bounded sample, deals the points into shards: a point lies in the inner child if
its Hamming distance d to the vantage point is at most the threshold t, else in the outer one. By the triangle
inequality two points within r of each other are apart only if the inner one has d > t - r, so these overlap into the
outer child too, at every level. Each shard goes on with trees of its own until blocks are small, compares those in
full, and gives out a spanning forest of the links that it found, so a group of m near copies costs m - 1 rows. The
components of all forests together are those of all links.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.llm._shared import Scratch, bounded_sample, discard, even_join, fresh, key_of, release, settle, settled, small_batches, text_of, tidy
from gridwright.llm.components import components

SEED = 42
#: Fingerprints drawn to choose vantage points at least and at most, and for each shard; points aimed at for each shard.
SAMPLE, MOST_SAMPLE, DRAWN, SHARD = 65_536, 1_048_576, 64, 32_768
#: Points compared in full; vantage points tried for each split.
BLOCK, TRIED = 1024, 6


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of these hashes: the bits that more than half of them have."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int) -> int:
    """The fingerprint of one text, as an unsigned number; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - width + 1].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], "<u8")
    return majority(hashes)


def simhash(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id (as it is) and fp (long, the fingerprint's 64 bits) of every row. Null texts count as empty."""
    small_batches(df.sparkSession)
    source = df.select(F.col(id).cast("long").alias("doc_id"), text_of(text).alias("text"))

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
        tidy()

    return source.mapInArrow(run, "doc_id long, fp long")


def distance(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def choose(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int, float]:
    """The vantage point and threshold that leave the least to compare, and what they leave of it."""
    best = (points[0], 0, 1.0)
    n = len(points)
    looked = points if n <= 4096 else points[rng.integers(0, n, 4096)]
    for v in points[rng.integers(0, n, TRIED)]:
        inner = np.cumsum(np.bincount(distance(looked, v), minlength=65)) / len(looked)  # share with d <= t
        for t in range(radius, 64):
            cost = inner[t] ** 2 + (1 - inner[t - radius]) ** 2  # the outer child also gets those with t - radius < d <= t
            if cost < best[2]:
                best = (v, t, cost)
    return best


def route(points: np.ndarray, rows: np.ndarray, vantage, threshold: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    d = distance(points[rows], vantage)
    return rows[d <= threshold], rows[d > threshold - radius]


def plan(sample: np.ndarray, depth: int, radius: int) -> list:
    """A tree as nested lists [vantage, threshold, inner, outer]; [] is a leaf."""
    if depth == 0 or len(sample) < 32:
        return []
    rng = np.random.default_rng(len(sample))
    v, t, cost = choose(sample, radius, rng)
    if cost > 0.85:
        return []
    inner, outer = route(sample, np.arange(len(sample)), v, t, radius)
    return [int(v), t, plan(sample[inner], depth - 1, radius), plan(sample[outer], depth - 1, radius)]


def leaves(tree: list, points: np.ndarray, rows: np.ndarray, radius: int, path: int = 1):
    """(leaf number, rows) of the points, for the leaves that they reach."""
    if not len(rows):
        return
    if not tree:
        yield path, rows
        return
    inner, outer = route(points, rows, np.uint64(tree[0]), tree[1], radius)
    yield from leaves(tree[2], points, inner, radius, 2 * path)
    yield from leaves(tree[3], points, outer, radius, 2 * path + 1)


class Forest:
    """Disjoint sets of 0..n-1, joined by arrays of pairs; a set's name is its smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def flatten(self) -> None:
        while True:
            above = self.up[self.up]
            if np.array_equal(above, self.up):
                return
            self.up = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            self.flatten()
            x, y = self.up[a], self.up[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def link(points: np.ndarray, radius: int) -> np.ndarray:
    """For each of these distinct points the smallest index among those that it is linked to, through others too."""
    forest = Forest(len(points))
    rng = np.random.default_rng(len(points))
    stack = [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        if len(rows) > BLOCK:
            v, t, cost = choose(points[rows], radius, rng)
            if cost < 0.85:
                inner, outer = route(points, rows, v, t, radius)
                if max(len(inner), len(outer)) < len(rows):
                    stack += [inner, outer]
                    continue
        for at in range(0, len(rows), 256):
            # those of the largest tree so far need no comparison with each other, so a dense group takes few of them
            forest.flatten()
            top = forest.up[rows]
            names, sizes = np.unique(top, return_counts=True)
            if len(names) == 1:
                break
            large = top == names[sizes.argmax()]
            mine = np.arange(at, min(at + 256, len(rows)))
            later = np.arange(at, len(rows))
            for some, others in ((mine[large[mine]], later[~large[later]]), (mine[~large[mine]], later)):
                a, b = np.nonzero(distance(points[rows[others]], points[rows[some], None]) <= radius)
                forest.join(rows[some[a]], rows[others[b]])
    forest.flatten()
    return forest.up


def hamming_links(points: DataFrame, radius: int) -> DataFrame:
    """points: distinct fp (long). Returns links a, b between them: a spanning forest of each shard's links, through
    which all points within radius of each other are connected."""
    n = points.count()
    depth = max(0, math.ceil(1.6 * math.log2(max(n, 1) / SHARD)))  # overlap makes a level's halves larger than halves
    rows = min(MOST_SAMPLE, max(SAMPLE, DRAWN * n // SHARD))
    drawn = bounded_sample(points.select("fp"), rows, "fp").toArrow().column("fp").to_numpy().view(np.uint64) if depth else np.zeros(0, np.uint64)
    tree = plan(drawn, depth, radius)

    def deal(batches):
        kept, size = [], 0
        for batch in itertools.chain(batches, [None]):  # many points at once, however small the batches are
            if batch is not None:
                kept.append(batch.column(0).to_numpy(zero_copy_only=False))
                size += len(batch)
            if size and (batch is None or size >= SAMPLE):
                fps = np.concatenate(kept).view(np.uint64)
                for leaf, rows in leaves(tree, fps, np.arange(len(fps)), radius):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf, np.int64)), pa.array(fps[rows].view(np.int64))], names=["shard", "fp"])
                kept, size = [], 0

    def forest(key, group):
        nodes = np.sort(group.column("fp").to_numpy())
        top = link(nodes.view(np.uint64), radius)
        tied = np.flatnonzero(top != np.arange(len(top)))
        return pa.table({"a": pa.array(nodes[tied]), "b": pa.array(nodes[top[tied]])})

    dealt = points.select("fp").mapInArrow(deal, "shard long, fp long")
    return dealt.groupBy("shard").applyInArrow(forest, "a long, b long")


def simhash_components(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp (long) and component_id of every row: the smallest doc_id reachable over links between fingerprints
    that differ in at most radius bits.

    A null doc_id names no component, unless all are null. Texts are read whole, however long they are; those without
    words all have fp 0 and are linked as any other. Repeated rows come out repeated. Extra columns take no part; an empty
    df gives no rows.
    """
    scratch = Scratch(df.sparkSession)
    fps = settle(simhash(df, id, text, width), "simhash-fingerprints")
    points = scratch.settle(fps.groupBy("fp").agg(F.min("doc_id").alias("key"), F.count("*").alias("n")), "simhash-points")
    parts = components(hamming_links(points, radius), "simhash-components")
    linked = scratch.settle(parts.join(points, parts["node"] == points["fp"]).select("fp", "component", "key"), "simhash-linked")
    least = scratch.settle(linked.groupBy("component").agg(F.min("key").alias("least"), F.count("*").alias("m")), "simhash-least")
    named = even_join(linked.select("fp", "component"), least, "component", "fp", "m").select("fp", "least")
    of_point = settle(points.join(named, "fp", "left").select("fp", "n", F.coalesce("least", "key").alias("component_id")), "simhash-of-point")
    scratch.clear()
    return even_join(fps, of_point, "fp", "doc_id", "n").select("doc_id", "fp", "component_id")


#: MinHash bands and minima of each: of pairs at similarity 0.8 one in 37,000 shares no band, and fewer above it.
BANDS, MINIMA = 20, 4
#: Points, pairs looked at and shingles of a group when buckets are compared; standard errors added to the Hamming distance that the
#: similarity stands for, so that of pairs at the similarity itself less than one in a million is passed over.
BUCKET, COMPARED, GROUP_SHINGLES, MARGIN = 16_384, 2**26, 1_000_000, 5.0
_ODD = np.random.default_rng(7).integers(0, 2**63, BANDS * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, width: int) -> np.ndarray:
    """The XXH64 of the distinct shingles, sorted. A text of fewer words is one shingle, one without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    n = max(1, len(words) - width + 1)
    starts = (ends - lengths + 1)[:n].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(width, len(words)) - 1 :].tolist(), strict=True)], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS numbers; two sets share each with the probability similarity ** MINIMA. None of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    mixed = hashes ^ (hashes >> np.uint64(29))
    least = np.full(len(_ODD), ~np.uint64(0))
    for at in range(0, len(mixed), 4096):
        least = np.minimum(least, (mixed[at : at + 4096, None] * _ODD).min(0))
    least = (least ^ (least >> np.uint64(31))) * _ODD[::-1]
    return least.reshape(BANDS, MINIMA).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)


def bits_for(similarity: float, bits: int, errors: float) -> int:
    """The Hamming distance of fingerprints whose shingles have this Jaccard similarity, and so many standard errors."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + errors * math.sqrt(bits * share * (1 - share)))


class Sets:
    """Sets of 64-bit numbers (binary, 8 bytes each, none empty) side by side, numbered so that one set's similarity to
    many others is counted at once."""

    def __init__(self, column: pa.ChunkedArray):
        column = column.combine_chunks().cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        flat = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u8")
        self.starts, self.sizes = (ends[:-1] - ends[0]) // 8, np.diff(ends) // 8
        names, self.items = np.unique(flat, return_inverse=True)
        self.marked = np.zeros(len(names), bool)

    def similar(self, one: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Those of the others whose Jaccard similarity to this one is as high."""
        mine = self.items[self.starts[one] : self.starts[one] + self.sizes[one]]
        self.marked[mine] = True
        found = []
        pieces = np.cumsum(self.sizes[others]) // GROUP_SHINGLES  # a long row of others takes bounded room
        for rows in np.split(others, np.flatnonzero(np.diff(pieces)) + 1):
            sizes = self.sizes[rows]
            at = np.cumsum(sizes) - sizes
            places = np.repeat(self.starts[rows] - at, sizes) + np.arange(sizes.sum())
            shared = np.add.reduceat(self.marked[self.items[places]], at, dtype=np.int64)
            found.append(rows[shared >= similarity * (len(mine) + sizes - shared) - 1e-9])
        self.marked[mine] = False
        return np.concatenate(found)


def apart(fps: np.ndarray, n: np.ndarray, group: np.ndarray, similarity: float):
    """Pairs of points in different groups that may be as similar, by length and fingerprint, as arrays, in pieces. Points
    of the largest group are not compared with each other."""
    near = bits_for(similarity, 64, MARGIN)
    names, which, sizes = np.unique(group, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return
    rest = np.flatnonzero(which != sizes.argmax())
    for at in range(0, len(rest), 256):
        mine = rest[at : at + 256]
        a, b = np.nonzero(distance(fps, fps[mine, None]) <= near)
        a = mine[a]
        ok = (which[a] != which[b]) & ((a < b) | (which[b] == sizes.argmax())) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]))
        yield a[ok], b[ok]


def verified(pairs: DataFrame, sets_of, similarity: float, scratch: Scratch) -> DataFrame:
    """pairs: distinct a, b (nodes). Those whose sets are as similar: the members of each a are brought to it in groups of
    bounded size. sets_of: gives node, n and shingles of a table's nodes."""
    pairs = scratch.settle(pairs, "simhash-pairs")
    release(pairs.sparkSession)
    of_a = scratch.settle(pairs.groupBy("a").agg(F.count("*").alias("m")), "simhash-leads")
    of_b = scratch.settle(pairs.groupBy("b").agg(F.count("*").alias("k")), "simhash-asked")
    own = scratch.settle(sets_of(of_b.select(F.col("b").alias("node")).union(of_a.select(F.col("a").alias("node"))).distinct()), "simhash-sets")
    known = own.join(of_b, own["node"] == of_b["b"]).select("b", "k", F.col("n").alias("nb"), F.col("shingles").alias("s"))
    members = even_join(pairs, known.drop("nb"), "b", "a", "k")
    total = known.agg(F.sum(F.col("k") * F.col("nb"))).first()[0] or 0
    cells = max(1, math.ceil(total / GROUP_SHINGLES))
    leads = own.join(of_a, own["node"] == of_a["a"]).select("a", F.col("n").alias("na"), F.col("shingles").alias("s"), "m")
    # members of one a go to as many parts as its work needs, by the share of all members' shingles
    weight = leads.select("a", F.greatest(F.lit(1), F.ceil(F.col("m") * F.col("na") / GROUP_SHINGLES)).cast("int").alias("parts"), "m", "na", "s")
    few = weight.where("parts > 1").select("a", "parts")  # at most one for each GROUP_SHINGLES of work
    part = F.pmod(F.xxhash64("b", F.lit(3)), F.coalesce("parts", F.lit(1))).cast("int")
    cell = F.pmod(F.xxhash64("a", "part"), F.lit(cells)).cast("int")
    members = members.join(few, "a", "left").withColumn("part", part).select(cell.alias("cell"), "a", "part", "b", "s")
    leads = weight.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(cell.alias("cell"), "a", "part", F.col("a").alias("b"), "s")

    def check(key, group):
        group = group.sort_by([("a", "ascending"), ("part", "ascending")])
        a, part, b = (group.column(c).to_numpy() for c in ("a", "part", "b"))
        found, sets = np.zeros(len(a), bool), Sets(group.column("s"))
        edges = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (part[1:] != part[:-1])))
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(a)], strict=True):
            lead = lo + int(np.flatnonzero(b[lo:hi] == a[lo:hi])[0])
            members = np.arange(lo, hi)
            found[sets.similar(lead, members[members != lead], similarity)] = True
        tidy()
        return pa.table({"a": pa.array(a[found]), "b": pa.array(b[found])})

    return scratch.settle(members.union(leads).groupBy("cell").applyInArrow(check, "a long, b long"), "simhash-links")


def cells_of(frame: DataFrame, key: str, node: str, other, large, cells: int) -> DataFrame:
    """frame with block, cell, lo and hi: where rows of one key are compared. `large`: key, p and q of the keys that are cut
    into blocks: rows of which `other` holds into p, the rest into q; a pair of blocks meets unless both are of the rest.
    The other keys share `cells` cells."""
    frame = frame.join(F.broadcast(large.select(key, "p", "q")), key, "left")
    spread = lambda n: F.pmod(F.xxhash64(node, F.lit(1)), n)
    block = F.when(F.col("p").isNull(), 0).when(other, spread(F.col("p"))).otherwise(F.col("p") + spread(F.col("q"))).cast("int")
    with_ = F.when(F.col("p").isNull(), F.array(F.lit(0))).when(other, F.sequence(F.lit(0), F.col("p") + F.col("q") - 1)).otherwise(F.sequence(F.lit(0), F.col("p") - 1))
    frame = frame.withColumn("block", block).withColumn("with", F.explode(with_)).withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with"))
    cell = F.when(F.col("p").isNull(), F.pmod(F.xxhash64(key, F.lit(5)), F.lit(cells))).otherwise(F.xxhash64(key, "lo", "hi"))
    return frame.withColumn("cell", cell).drop("p", "q", "with")


def runs(*columns: np.ndarray):
    """(first, end) of each run of equal rows of these columns."""
    n = len(columns[0])
    changed = np.zeros(max(0, n - 1), bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    edges = np.flatnonzero(np.append(True, changed)).tolist()
    return zip(edges, [*edges[1:], n], strict=True)


def verified_within(ties: DataFrame, points: DataFrame, parts: DataFrame, sets_of, similarity: float, scratch: Scratch) -> DataFrame:
    """ties: links that connect all candidates. A forest of the similar ones among the nodes that they connect, which share
    a band and are not of one part. The sets of a cluster are brought together once, and those of a cluster beyond
    GROUP_SHINGLES in pairs of blocks, where those of its largest part don't meet each other. Pairs are made where they
    are compared, so what is written grows with the nodes."""
    clusters = scratch.settle(components(scratch.settle(ties, "simhash-dense"), "simhash-cluster", scratch), "simhash-clusters")
    named = clusters.join(points, "node").join(parts.withColumnRenamed("component", "part"), "node", "left")
    named = scratch.settle(named.select("node", F.col("component").alias("cluster"), F.coalesce("part", "node").alias("part"), "n", "fp", "bands"), "simhash-named")
    weight = F.greatest("n", F.lit(GROUP_SHINGLES // BUCKET))  # so that a cell's rows are bounded too
    sizes = named.groupBy("cluster", "part").agg(F.sum(weight).alias("w")).groupBy("cluster").agg(F.max(F.struct("w", "part")).alias("most"), F.sum("w").alias("total"))
    sizes = scratch.settle(sizes.select("cluster", F.col("most.part").alias("largest"), F.col("most.w").alias("in_largest"), "total"), "simhash-sizes")
    cells = max(1, math.ceil((sizes.agg(F.sum("total")).first()[0] or 0) / GROUP_SHINGLES))
    in_blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / GROUP_SHINGLES)).cast("int")
    large = sizes.where(F.col("total") > GROUP_SHINGLES)  # at most `cells`
    large = large.select("cluster", "largest", in_blocks(F.col("total") - F.col("in_largest")).alias("p"), in_blocks(F.col("in_largest")).alias("q"))
    named = named.join(F.broadcast(large.select("cluster", "largest")), "cluster", "left")
    placed = cells_of(named, "cluster", "node", F.col("part") != F.col("largest"), large, cells)
    own = scratch.settle(sets_of(clusters.select("node")), "simhash-sets")
    brought = placed.join(own.select("node", "shingles"), "node").select("cell", "cluster", "lo", "hi", "block", "node", "part", "n", "fp", "bands", "shingles")

    def check(key, group):
        group = group.sort_by([("cluster", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("node", "ascending")])
        cluster, lo, hi, block, node, part, n = (group.column(c).to_numpy() for c in ("cluster", "lo", "hi", "block", "node", "part", "n"))
        fps, own, found = group.column("fp").to_numpy().view(np.uint64), Sets(group.column("shingles")), [np.zeros((0, 2), np.int64)]
        kept = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        for at, end in runs(cluster, lo, hi):
            _, first, which = np.unique(part[at:end], return_index=True, return_inverse=True)
            forest = Forest(end - at)
            forest.up = first[which]  # nodes of one part are connected already
            for a, b in apart(fps[at:end], n[at:end], part[at:end], similarity):
                if lo[at] != hi[at]:  # pairs within a block are compared where it meets itself, or are of the largest part
                    across = block[at + a] != block[at + b]
                    a, b = a[across], b[across]
                if not len(a):
                    continue
                for i, j in runs(a):
                    one, others = int(a[i]), b[i:j]
                    others = others[forest.up[others] != forest.up[one]]
                    others = others[(kept[at + others] == kept[at + one]).any(1)]
                    if not len(others):
                        continue
                    near = own.similar(at + one, at + others, similarity) - at
                    if len(near):
                        near = near[np.unique(forest.up[near], return_index=True)[1]]  # one of each tree
                        forest.join(np.full(len(near), one), near)
                        forest.flatten()
                        found.append(np.stack([np.full(len(near), one), near], 1) + at)
        found = np.concatenate(found)
        tidy()
        return pa.table({"a": pa.array(node[found[:, 0]]), "b": pa.array(node[found[:, 1]])})

    return scratch.settle(brought.groupBy("cell").applyInArrow(check, "a long, b long"), "simhash-links")


def similar_components(df: DataFrame, id: str, text: str, width: int, similarity: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): node, its smallest row (key, text hash, and c, how often that row occurs); node and component of the
    nodes that are linked. They are there until scratch is cleared.

    A node is a set of shingles. Candidates are: nodes of one fingerprint, the links of the vantage-point trees, and, as
    the trees can't prune at the distance that such a similarity allows, nodes that share one of BANDS MinHash bands. At
    first each node is compared with the smallest of its bucket. Buckets whose nodes are all connected then are done; in
    the others nodes of different components are compared, the largest component's not with each other.

    Shingles take more room than texts and most nodes have no candidate, so none are kept: those of the nodes to be
    compared are made from the texts again.
    """
    source = df.select(key_of(id).alias("key"), F.xxhash64(text).alias("hash"), text_of(text).alias("text"))

    def in_slices(batches, make, names):
        for whole in batches:
            for at in range(0, len(whole), 200):  # a text's shingles take more room than the text
                batch = whole.slice(at, 200)
                yield pa.RecordBatch.from_arrays(make(batch, [shingles(t, width) for t in batch.column("text").to_pylist()]), names=names)
        tidy()

    def marks(batch, own):
        fps = np.array([majority(x) if len(x) else 0 for x in own], np.uint64).view(np.int64)
        nodes = np.array([xxhash.xxh64_intdigest(x.astype("<u8").tobytes(), SEED) for x in own], np.uint64).view(np.int64)
        kept = pa.array([bands(x).view(np.int64) for x in own], pa.list_(pa.int64()))
        return [batch.column("key"), batch.column("hash"), pa.array(nodes), pa.array([len(x) for x in own], pa.int64()), pa.array(fps), kept]

    def members(batch, own):
        return [batch.column("node"), pa.array([len(x) for x in own], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in own], pa.binary())]

    small_batches(df.sparkSession)
    marked = source.mapInArrow(lambda batches: in_slices(batches, marks, ["key", "hash", "node", "n", "fp", "bands"]), "key long, hash long, node long, n long, fp long, bands array<long>")
    marked, path = settled(marked, "simhash-rows")
    # of equal rows one; of a node's rows the smallest
    rows = marked.groupBy("node", "key", "hash").agg(F.count("*").alias("c")).groupBy("node").agg(F.min(F.struct("key", "hash", "c")).alias("row"))
    rows = scratch.settle(rows.select("node", "row.key", "row.hash", "row.c"), "simhash-of-node")
    points = scratch.settle(marked.select("node", "n", "fp", "bands").dropDuplicates(["node"]).where("n > 0"), "simhash-nodes")
    discard(df.sparkSession, path)
    repeated = rows.where("c > 1").limit(1).count() > 0

    def sets_of(nodes: DataFrame) -> DataFrame:
        # written, so that its size is known when the join is planned: texts are exchanged only if there are too many nodes to send
        asked = scratch.settle(rows.join(nodes, "node", "left_semi").select("node", "key", "hash"), "simhash-asked")
        texts = source.join(asked, ["key", "hash"]).select("node", "text")
        sets = texts.mapInArrow(lambda batches: in_slices(batches, members, ["node", "n", "shingles"]), "node long, n long, shingles binary")
        return sets.dropDuplicates(["node"]) if repeated else sets

    near = bits_for(similarity, 64, MARGIN)

    def may_be(x: str, y: str):
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        return (F.least(n, m) >= similarity * F.greatest(n, m)) & (F.bit_count(F.col(f"{x}.fp").bitwiseXOR(F.col(f"{y}.fp"))) <= near)

    # candidates by fingerprint
    own = F.struct("node", "n", "fp").alias("own")
    of_fp = scratch.settle(points.groupBy("fp").agg(F.min(F.struct("node", "n", "fp")).alias("lead"), F.count("*").alias("m")), "simhash-fps")
    same = even_join(points.select("fp", own), of_fp.where("m > 1").select("fp", "lead", "m"), "fp", "own", "m").where("own.node <> lead.node")
    edges = hamming_links(of_fp.select("fp"), 3)
    tied = edges.join(of_fp.select(F.col("fp").alias("a"), F.col("lead").alias("own")), "a").join(of_fp.select(F.col("fp").alias("b"), "lead"), "b")
    # candidates by bands: most bands have one node, so they are counted before anything else goes along
    placed = points.select(F.explode("bands").alias("band"), "node", "n", "fp")
    counted = placed.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    counted = scratch.settle(counted, "simhash-counted")
    release(df.sparkSession)
    shared = scratch.settle(even_join(placed, counted, "band", "node", "m").select("band", own), "simhash-shared")
    release(df.sparkSession)
    buckets = scratch.settle(shared.groupBy("band").agg(F.min("own").alias("lead"), F.count("*").alias("m")), "simhash-buckets")
    led = even_join(shared, buckets, "band", "own", "m").where("own.node <> lead.node")
    every = same.select("lead", "own").union(tied.select("lead", "own")).union(led.select("lead", "own")).where(may_be("lead", "own"))
    first = verified(every.select(F.least("lead.node", "own.node").alias("a"), F.greatest("lead.node", "own.node").alias("b")).distinct(), sets_of, similarity, scratch)
    release(df.sparkSession)
    # buckets that are not connected by these
    parts = scratch.settle(components(first, "simhash-similar", scratch), "simhash-parts")
    grouped = shared.join(parts, F.col("own.node") == parts["node"], "left").select("band", "own", F.coalesce("component", "own.node").alias("part"))
    grouped = scratch.settle(grouped, "simhash-grouped")
    sizes = grouped.groupBy("band", "part").agg(F.count("*").alias("k"))
    open_ones = sizes.groupBy("band").agg(F.max(F.struct("k", "part"))["part"].alias("largest"), F.max("k").alias("in_largest"), F.sum("k").alias("m"), F.count("*").alias("parts")).where("parts > 1")
    open_ones = scratch.settle(open_ones, "simhash-open")
    left = even_join(grouped, open_ones, "band", "own", "m")
    # the largest component's nodes in blocks of their own; pairs of blocks in which others take part
    q, p = (F.greatest(F.lit(1), F.ceil(c / BUCKET)).cast("int") for c in (F.col("in_largest"), F.col("m") - F.col("in_largest")))
    large = open_ones.where(F.col("m") > BUCKET).select("band", p.alias("p"), q.alias("q"))  # at most one for each BUCKET rows
    total = open_ones.where(F.col("m") <= BUCKET).agg(F.sum("m"), F.sum((F.col("m") - F.col("in_largest")) * F.col("m"))).first()
    cells = max(1, math.ceil((total[0] or 0) / BUCKET), math.ceil((total[1] or 0) / COMPARED))
    left = cells_of(left, "band", "own.node", F.col("part") != F.col("largest"), large, cells)
    left = left.select("cell", "band", "lo", "hi", "block", "own.node", "own.n", "own.fp", "part")

    def look(key, group):
        group = group.sort_by([("band", "ascending"), ("lo", "ascending"), ("hi", "ascending")])
        band, lo, hi, block, node, n, part = (group.column(c).to_numpy() for c in ("band", "lo", "hi", "block", "node", "n", "part"))
        fps, found = group.column("fp").to_numpy().view(np.uint64), [np.zeros((0, 2), np.int64)]
        for at, end in runs(band, lo, hi):
            forest = Forest(end - at)  # candidates go out as a forest, not as pairs: what is written grows with the nodes
            for a, b in apart(fps[at:end], n[at:end], part[at:end], similarity):
                if lo[at] != hi[at]:
                    across = block[at + a] != block[at + b]
                    a, b = a[across], b[across]
                forest.join(a, b)
            forest.flatten()
            tied = np.flatnonzero(forest.up != np.arange(end - at))
            found.append(np.stack([node[at + tied], node[at + forest.up[tied]]], 1))
        found = np.concatenate(found)
        tidy()
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    release(df.sparkSession)
    ties = left.groupBy("cell").applyInArrow(look, "a long, b long").distinct()
    second = verified_within(ties, points, parts, sets_of, similarity, scratch)
    return rows, components(first.union(second), "simhash-similar", scratch)


def drop_near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """df without near copies: of each group of linked texts the row with the smallest (doc_id, text hash) stays, once.

    Two texts are linked if their distinct shingles have a Jaccard similarity of `similarity` or more, which is computed
    exactly for every candidate (see similar_components). Null texts count as empty, and all texts without words are copies
    of each other. Texts are read whole, however long they are. Columns of any name stay; an empty df stays empty.
    """
    scratch = Scratch(df.sparkSession)
    rows, parts = similar_components(df, id, text, width, similarity, scratch)
    group = rows.join(parts, "node", "left").select(F.coalesce("component", "node").alias("group"), F.struct("key", "hash", "c").alias("row"))
    key, hashed = fresh(df, "_key", "_hash")
    stays = settle(group.groupBy("group").agg(F.min("row").alias("row")).select(F.col("row.key").alias(key), F.col("row.hash").alias(hashed), "row.c"), "simhash-stays")
    scratch.clear()
    keyed = df.withColumn(key, key_of(id)).withColumn(hashed, F.xxhash64(text))
    found = keyed.join(stays.where("c = 1").select(key, hashed), [key, hashed], "left_semi")
    if stays.where("c > 1").limit(1).count():  # only rows that occur more than once are exchanged to leave one
        found = found.union(keyed.join(stays.where("c > 1").select(key, hashed), [key, hashed], "left_semi").dropDuplicates([key, hashed]))
    return found.select(df.columns)
