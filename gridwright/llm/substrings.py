"""Incremental substring dedup over a log-structured index of window fingerprints.

A window is LENGTH consecutive words. Of the GRAM-word fingerprints in a window the smallest (the first of equals) is
its anchor; equal windows have equal anchors at the same place. The consecutive windows that share an anchor are its
domain, and the index holds a row for each: (anchor, hash of the domain, where it stood first). About one row comes to
eight words, and a passage that stands in many documents has one row, however many they are.

The new domains of a batch are one run: a table sorted by anchor that is never changed. A new batch's rows, of which
each piece of input keeps one a domain, meet the runs' in one exchange and merge there in the order of anchor, domain
and place. A domain that stood earlier is removed as a whole. Where an anchor has several domains, their first places
are looked up in the texts, and the windows themselves are compared by 128 bits (the verification). When there are more
than MOST_RUNS runs they are compacted into one.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwright.llm._shared import discard, key_of, release, settle, shared_dir, text_of

LENGTH, GRAM, MOST_RUNS = 20, 5, 4
REMEMBERED = 400_000
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
RUN = "anchor long, domain long, batch int, key long, salt int, place long, again boolean"
#: A place is start * PLACE + number of windows.
PLACE = 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Rolling:
    """Hashes of any run of words of one text."""

    def __init__(self, hashes: np.ndarray, which: int = 0):
        base = BASES[which]
        own = mix(hashes ^ base)
        inverse = np.uint64(pow(int(base), -1, 2**64))
        n = len(hashes)
        self.down = np.cumprod(np.append(np.uint64(1), np.full(n, inverse)))
        self.sums = np.append(np.uint64(0), np.cumsum(own * np.cumprod(np.append(np.uint64(1), np.full(max(0, n - 1), base)))[:n]))

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def word_hashes(text: str, memory: WordHashes) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


def anchors(roll: Rolling, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of n words: anchor, hash of the domain, first window and number of windows of each domain."""
    if n < LENGTH:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    at = np.arange(n - GRAM + 1)
    grams = roll.of(at, at + GRAM)
    least, span, width = at, 1, LENGTH - GRAM + 1
    while span < width:
        step = min(span, width - span)
        left, right = least[: len(least) - step], least[step:]
        least = np.where(grams[right] < grams[left], right, left)
        span += step
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    count = np.diff(np.append(first, len(least)))
    return grams[least[first]], roll.of(first, first + count - 1 + LENGTH) + count.astype(np.uint64), first, count


def _occurrences(docs: DataFrame, batch: int) -> DataFrame:
    def run(batches):
        memory = WordHashes()
        for part in batches:
            out, owner = [], []
            for text in part.column(2).to_pylist():
                hashes = word_hashes(text, memory)
                a, d, first, count = anchors(Rolling(hashes), len(hashes))
                out.append((a, d, first * PLACE + count))
                owner.append(len(a))
            owner = np.repeat(np.arange(len(owner)), owner)
            a, d, place = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64),) * 3
            place, key = place.astype(np.int64), part.column(0).to_numpy()[owner]
            # one row of each domain goes on; later ones of this piece are known to be repeats and need no exchange by anchor
            order = np.lexsort((place, key, d, a))
            head = np.append(True, (a[order][1:] != a[order][:-1]) | (d[order][1:] != d[order][:-1]))[: len(order)]
            first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else order
            again = np.zeros(len(order), bool)
            again[order] = (key[first] != key[order]) | (place[first] // PLACE != place[order] // PLACE)
            salts, fixed = part.column(1).take(pa.array(owner)), pa.array(np.full(len(owner), batch, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(d.view(np.int64)), fixed, pa.array(key), salts, pa.array(place), pa.array(again)], names=["anchor", "domain", "batch", "key", "salt", "place", "again"])

    return docs.mapInArrow(run, RUN)


def _windows(docs: DataFrame) -> DataFrame:
    """docs: key, salt, text, places (array of struct batch, place). Two hashes and the place of each window asked for."""

    def run(batches):
        memory = WordHashes()
        for part in batches:
            for key, salt, text, places in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                hashes = word_hashes(text, memory)
                starts = np.concatenate([np.arange(p["place"] // PLACE, p["place"] // PLACE + p["place"] % PLACE) for p in places])
                number = np.repeat([p["batch"] for p in places], [p["place"] % PLACE for p in places]).astype(np.int32)
                own = [Rolling(hashes, k).of(starts, starts + LENGTH).view(np.int64) for k in (0, 1)]
                fixed = [pa.array(np.full(len(starts), key, np.int64)), pa.array(np.full(len(starts), salt, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1]), pa.array(number), *fixed, pa.array(starts)], names=["h", "verify", "batch", "key", "salt", "start"])

    return docs.mapInArrow(run, "h long, verify long, batch int, key long, salt int, start long")


def _kept(text: str, ranges: list | None) -> tuple[int, int, str]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not ranges:
        return len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass")
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, [r["lo"] for r in ranges], 1)
    np.add.at(cover, [r["hi"] for r in ranges], -1)
    gone = np.cumsum(cover)[:-1] > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode("utf-8", "surrogatepass")


class SubstringIndex:
    """Runs of anchors in the shared folder, and the texts that they were taken from."""

    def __init__(self, spark: SparkSession, id: str = "doc_id", text: str = "text"):
        self.spark, self.id, self.text = spark, id, text
        self.home = f"{shared_dir(spark)}/substrings-{uuid.uuid4().hex}"
        self.runs: list[tuple[int, str]] = []
        self.texts: list[DataFrame] = []
        self.batches = 0

    def _keyed(self, docs: DataFrame) -> DataFrame:
        return docs.select(key_of(self.id).alias("key"), F.hash(self.text).alias("salt"), text_of(self.text).alias("text"))

    def add(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """Adds a batch, which comes after all earlier ones, and returns its key, salt and removed word ranges (array of
        struct lo, hi). last: no later batch will come, and the index is deleted."""
        batch, keyed = self.batches, self._keyed(docs)
        self.batches += 1
        self.texts.append(keyed)
        rows = _occurrences(keyed, batch)
        if self.runs:
            rows = rows.union(self._read())
        start = F.floor(F.col("place") / PLACE)
        dealt = rows.withColumn("deal", F.when(F.col("again"), F.xxhash64("key", "place")).otherwise(F.col("anchor"))).repartition("deal")
        place = Window.partitionBy("deal", "domain").orderBy("again", "batch", "key", start)
        anchor = Window.partitionBy("deal")
        ranked = dealt.withColumn("again", F.col("again") | (F.rank().over(place) > 1))
        bound = lambda f: f(F.when(~F.col("again"), F.col("domain"))).over(anchor)
        ranked = ranked.withColumns({"several": F.coalesce(bound(F.min) != bound(F.max), F.lit(False)) & ~F.col("again"), "latest": F.max("batch").over(anchor)})
        kept = ranked.where((F.col("batch") == batch) | (F.col("several") & (F.col("latest") == batch)))
        path = f"{self.home}/run-{uuid.uuid4().hex}"
        kept.drop("deal").sortWithinPartitions("anchor", "domain").write.parquet(path)
        merged = self.spark.read.schema(RUN + ", several boolean, latest int").parquet(path)
        end = lambda n: F.floor(F.col("place") / PLACE) + n + LENGTH
        whole = merged.where(F.col("again") & (F.col("batch") == batch)).select("key", "salt", start.alias("lo"), end(F.col("place") % PLACE - 1).alias("hi"))
        # domains that share their anchor with others are compared window by window
        asked = merged.where(F.col("several") & (F.col("latest") == batch)).groupBy("key", "salt").agg(F.collect_set(F.struct("batch", "place")).alias("places"))
        texts = reduce(DataFrame.union, self.texts)
        release(self.spark)
        compared = f"{self.home}/windows-{batch}"
        windows = _windows(texts.join(asked, ["key", "salt"]).select("key", "salt", "text", "places"))
        windows.write.parquet(compared)
        windows = self.spark.read.schema(windows.schema).parquet(compared)
        earliest = windows.groupBy("h", "verify").agg(F.min(F.struct("batch", "key", "start")).alias("least"), F.count("*").alias("n")).where("n > 1")
        own = windows.where(F.col("batch") == batch)
        single = own.join(earliest, ["h", "verify"]).where(F.col("least") < F.struct("batch", "key", "start")).select("key", "salt", F.col("start").alias("lo"), (F.col("start") + LENGTH).alias("hi"))
        release(self.spark)
        found = settle(whole.union(single).groupBy("key", "salt").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "substring-ranges")
        discard(self.spark, *([self.home] if last else [compared]))
        self.runs.append((batch, path))
        if len(self.runs) > MOST_RUNS and not last:
            self.compact()
        release(self.spark)
        return found

    def _read(self) -> DataFrame:
        """The first places of all domains known so far; a run's own are those of its batches."""
        parts = [self.spark.read.schema(RUN).parquet(path).where(~F.col("again") & ((F.col("batch") == batch) if batch >= 0 else F.lit(True))) for batch, path in self.runs]
        return reduce(DataFrame.union, parts)

    def compact(self) -> None:
        """Merges all runs into one, sorted by anchor."""
        if len(self.runs) > 1:
            path = f"{self.home}/run-{uuid.uuid4().hex}"
            self._read().repartition("anchor").sortWithinPartitions("anchor", "domain").write.parquet(path)
            discard(self.spark, *(old for _, old in self.runs))
            self.runs = [(-1, path)]

    def without(self, docs: DataFrame, ranges: DataFrame) -> DataFrame:
        """key, n_words, n_removed and the kept words, joined by one space, of each row."""
        joined = self._keyed(docs).join(ranges, ["key", "salt"], "left").select("key", "text", "ranges")

        def run(batches):
            for part in batches:
                out = [_kept(t, r) for t, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                columns = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["key", "n_words", "n_removed", "kept"])

        return joined.mapInArrow(run, "key long, n_words long, n_removed long, kept string")

    def cleaned(self, docs: DataFrame) -> DataFrame:
        """Adds the batch and returns its rows without what earlier ones hold."""
        return self.without(docs, self.add(docs))


def in_batches(docs: DataFrame, parts: int, id: str = "doc_id") -> list[DataFrame]:
    """docs in ranges of about equal size by document number; nulls come first."""
    edges = sorted(set(docs.approxQuantile(id, [k / parts for k in range(1, parts)], 0.01))) if parts > 1 else []
    key = key_of(id)
    bounds = [None, *map(int, edges), None]
    return [docs.where((F.lit(True) if lo is None else key > lo) & (F.lit(True) if hi is None else key <= hi)) for lo, hi in zip(bounds, bounds[1:], strict=False)]


def dedup(docs: DataFrame, parts: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (string) of every row: the words that no repeated window covers.

    A word goes if a window that covers it starts earlier elsewhere: in a smaller doc_id, or earlier in the same one.
    Null texts have no words; a null doc_id counts as smallest and comes out null. Rows that share a doc_id and a start
    are not earlier than one another. Texts of fewer than LENGTH words keep all. Extra columns take no part.
    """
    index = SubstringIndex(docs.sparkSession, id, text)
    own = docs.select(id, text)
    pieces = in_batches(own, parts, id)
    ranges = reduce(DataFrame.union, [index.add(p, last=i == len(pieces) - 1) for i, p in enumerate(pieces)])
    return index.without(own, ranges).select(F.expr("nullif(key, -9223372036854775808L)").alias("doc_id"), "n_words", "n_removed", "kept")
