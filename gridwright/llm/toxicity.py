"""Toxicity by noisy-channel deobfuscation.

A writer's word passes through a channel that swaps letters for look-alikes, repeats letters and puts separators or
blanks between them. All letters that a token may stand for form a lattice; a Viterbi search under a character trigram
model, counted over all documents, finds the likeliest reading, and the restored text has it in the token's place. Only
restored text is learned from and scored: with a decision list of words and stems, learned from labelled rows by greedy
cover: the next entry is the one that explains most toxic rows that are left, until an entry would explain too few.

Tokens of ASCII letters without a letter twice in a row have one path through their lattice and are taken as they are.
A worker remembers recent tokens; emptying that store changes the time taken and nothing else.
"""

from __future__ import annotations

import gc
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm._shared import bounded_sample, settle, small_batches, text_of, tidy

#: Labelled rows that the decision list is fitted on at most.
FIT_ROWS = 20_000
#: An entry must explain so many further toxic rows, and so large a share of the rows with it must be toxic.
LEAST_ROWS, LEAST_SHARE = 3, 0.8
#: The share of a row's weight that each entry takes away.
EXPLAINED = 0.2
STEMS = range(4, 9)
REMEMBERED = 100_000

#: Letters that a character may stand for.
LOOKALIKES = {
    "0": "ou", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ο": "o", "α": "a", "ι": "i",
}
SEPARATORS = ".-_*~'·"
#: Costs (in nats) of a swapped character, a dropped repetition, a space put in, a character that stays no letter.
SWAP, DROP, GAP, ODD = 0.7, 0.4, 3.0, 6.0

CLASSES = 28  # 0: no letter, 1-26: a-z, 27: any other letter
ODD_ONE = re.compile("[0-9@$!|+(€£¡*а-яіѕοαι]")
REPEATED = re.compile(r"([^\W\d_])\1")
SPELLED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
SEPARATED = re.compile(r"[.\-_*~'·]")
LETTERS = re.compile(r"[^\W\d_]+")

_TABLE = np.full(256, 0, np.uint8)
_TABLE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_TABLE[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_TABLE[0xC0:] = 27
_TABLE[0x80:0xC0] = 255  # the rest of a character


def class_of(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def trigram_counts(text: str) -> np.ndarray:
    raw = _TABLE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    raw = raw[raw != 255].astype(np.int32)
    raw = np.concatenate([[0, 0], raw, [0]])
    return np.bincount((raw[:-2] * CLASSES + raw[1:-1]) * CLASSES + raw[2:], minlength=CLASSES**3)


@dataclass
class ToxicityModel:
    """log_p: log-probabilities of a character class after two others. entries: word or stem -> share of toxic rows.
    base: share of toxic rows among those without any entry."""

    log_p: np.ndarray
    entries: dict[str, float] = field(default_factory=dict)
    base: float = 0.0

    def restore(self, raw: str) -> str:
        """The likeliest text behind a token, or behind a run of single characters with blanks between them. Separators
        and blanks are dropped, or end a word."""
        options: list[tuple[bool, list[tuple[str, float]]]] = []  # per character: whether a word may begin here, what it stands for at what cost
        last, apart = "", False
        for c in raw.lower():
            if c in SEPARATORS and c not in LOOKALIKES or c.isspace():
                apart = bool(options)
                continue
            if c.isalpha() and c not in LOOKALIKES:
                found = [(c, 0.0)]
            else:
                found = [(x, SWAP) for x in LOOKALIKES.get(c, "")] + [(c, ODD)]
                if c in SEPARATORS:
                    found.append(("", SWAP))
            if c == last:
                found.append(("", DROP))
            options.append((apart, found))
            last, apart = c, False
        # for each pair of the last two classes the cheapest way: its cost, its text, and the chain of its pieces from the last to the first
        beam: dict[tuple[int, int], tuple] = {(0, 0): (0.0, "", None)}
        for begins, found in options:
            after: dict[tuple[int, int], tuple] = {}
            for (a, b), (cost, _, chain) in beam.items():
                starts = [(a, b, cost, "")]
                if begins and b:
                    starts.append((b, 0, cost + GAP - self.log_p[a, b, 0], " "))
                for piece, price in found:
                    k = class_of(piece)
                    for x, y, paid, gap in starts if piece else starts[:1]:
                        into = (y, k) if piece else (x, y)
                        total = paid + price - (self.log_p[x, y, k] if piece else 0.0)
                        old = after.get(into)
                        if old is None or (total, piece) < old[:2]:
                            after[into] = (total, piece, (gap + piece, chain) if piece else chain)
            beam = after
        _, _, chain = min(((cost - self.log_p[a, b, 0], (a, b), chain) for (a, b), (cost, _, chain) in beam.items()), key=lambda way: way[:2])
        pieces = []
        while chain:
            pieces.append(chain[0])
            chain = chain[1]
        return "".join(reversed(pieces))

    def words(self, token: str) -> list[str]:
        """The words of a token without white space, restored where it looks odd."""
        bare = token.lower()
        if not bare.isalpha():
            lo, hi = 0, len(bare)
            while hi and not bare[hi - 1].isalnum():
                hi -= 1
            while lo < hi and not bare[lo].isalnum():
                lo += 1
            bare = bare[lo - 1 if 0 < lo < hi and bare[lo - 1] in "@$!|(" else lo : hi]
        if bare.isalpha() and not REPEATED.search(bare) and bare.isascii():
            return [bare]
        if not LETTERS.search(bare):  # numbers and marks
            return []
        if ODD_ONE.search(bare) or REPEATED.search(bare) or SEPARATED.search(bare):
            bare = self.restore(bare)
        return LETTERS.findall(bare)

    def apart(self, text: str) -> tuple[str, list[str]]:
        """The text without its runs of single characters, and the words of these."""
        runs = [run for run in set(SPELLED.findall(text)) if LETTERS.search(run)]
        return (SPELLED.sub(" ", text) if runs else text), [w for run in runs for w in LETTERS.findall(self.restore(run))]

    def all_words(self, text: str, known: dict[str, list[str]] | None = None) -> set[str]:
        """The words of the restored text. known: tokens read before, for who reads many texts."""
        rest, found = self.apart(text)
        found, known = set(found), {} if known is None else known
        for t in set(rest.split()):
            if t not in known:
                known[t] = self.words(t)
            found.update(known[t])
        return found

    def restored_text(self, text: str) -> str:
        """The text in lower case with odd-looking tokens and spelled words restored."""
        text = SPELLED.sub(lambda m: self.restore(m[0]) if LETTERS.search(m[0]) else m[0], text)
        return re.sub(r"\S+", lambda m: " ".join(self.words(m[0])) or m[0], text)


def features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in STEMS if n <= len(word))]


class Scorer(dict):
    """Entries hit by a token; remembers tokens."""

    def __init__(self, model: ToxicityModel):
        self.model = model

    def hits(self, words) -> tuple[str, ...]:
        return tuple({f for w in words for f in features(w) if f in self.model.entries})

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        self[token] = found = self.hits(self.model.words(token))
        return found

    def score(self, text: str) -> float:
        rest, spelled = self.model.apart(text)
        found = set().union(*set(map(self.__getitem__, rest.split())))
        found.update(self.hits(spelled))
        clean = 1.0 - self.model.base
        for f in sorted(found):
            clean *= 1.0 - self.model.entries[f]
        return 1.0 - clean


def held_out(id: str, folds: int) -> Column:
    """The remainder of crc32 of the document number as text; a null number counts as empty text."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % folds


def character_model(df: DataFrame, text: str = "text") -> np.ndarray:
    """Log-probabilities of character trigrams, counted over all rows. One row for each task and trigram is gathered."""

    def count(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += trigram_counts(t)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])
        tidy()

    rows = df.select(text_of(text).alias("text")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CLASSES**3)
    counts[rows["gram"].to_numpy(int)] = rows["n"].to_numpy(float)
    tri = counts.reshape(CLASSES, CLASSES, CLASSES)
    uni = (tri.sum((0, 1)) + 1) / (tri.sum() + CLASSES)
    bi = (tri.sum(0) + 8 * uni) / (tri.sum((0, 2))[:, None] + 8)
    return np.log((tri + 8 * bi[None]) / (tri.sum(2, keepdims=True) + 8))


def sketch(text: str) -> list[int]:
    """Three minima over hashes of the runs of four words, by which near copies in the sample are known."""
    words = text.lower().split()
    runs = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 3))], np.uint64)
    return [int((runs * np.uint64(odd)).min() >> np.uint64(1)) for odd in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def cover(rows: list[tuple[int, list[int], list[int]]], names: list[str]) -> tuple[dict[str, float], float]:
    """rows: (toxic, entries found, sketch). The entries, and the toxic share of the rows without any.

    A row counts as one over the number of its near copies, and less each time that an entry explains it.
    """
    copies = [Counter(own[k] for _, _, own in rows) for k in range(3)]
    left = [1.0 / max(copies[k][own[k]] for k in range(3)) for _, _, own in rows]
    toxic_of, clean_n = defaultdict(list), Counter()
    for i, (toxic, found, _) in enumerate(rows):
        for f in found:
            if toxic:
                toxic_of[f].append(i)
            else:
                clean_n[f] += 1
    entries: dict[str, float] = {}
    gain = {f: sum(left[i] for i in x) for f, x in toxic_of.items()}
    found_by = {i: found for i, (toxic, found, _) in enumerate(rows) if toxic}
    while gain:
        best = max(gain, key=lambda f: (round(gain[f] - 2 * clean_n[f], 6), len(names[f]), names[f]))
        if gain[best] < LEAST_ROWS or gain[best] <= 2 * clean_n[best]:
            break
        entries[names[best]] = (len(toxic_of[best]) + 0.5) / (len(toxic_of[best]) + clean_n[best] + 1)
        for i in toxic_of[best]:
            lost = left[i] * EXPLAINED
            left[i] -= lost
            for f in found_by[i]:
                if f in gain:
                    gain[f] -= lost
        word = names[best].rstrip("$")  # its longer and shorter forms say the same
        gain = {f: x for f, x in gain.items() if x >= LEAST_ROWS and not names[f].startswith(word) and not word.startswith(names[f])}
    free = [toxic for toxic, found, _ in rows if not any(names[f] in entries for f in found)]
    return entries, min(0.4, (sum(free) + 0.5) / (len(free) + 2)) if rows else 0.0


def fit(documents: DataFrame, labelled: DataFrame, rows: int = FIT_ROWS) -> ToxicityModel:
    """documents: doc_id, text (all, for the character model). labelled: doc_id, toxic of the rows to learn from; of
    more than `rows` of them those with the smallest hash of doc_id are taken. Several labels of a document: the
    largest; several texts: the largest; null labels don't count. Without labels the list is empty and every score is 0.
    What reaches the driver is bounded by `rows`: the words that three toxic ones of them share."""
    small_batches(documents.sparkSession)
    model = ToxicityModel(character_model(documents))
    known = labelled.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = bounded_sample(known, rows, "doc_id")
    texts = documents.select("doc_id", text_of("text").alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))

    def restored(batches):
        known: dict[str, list[str]] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if len(known) > REMEMBERED:
                known.clear()
            words = pa.array([sorted(model.all_words(t, known)) for t in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), words, pa.array([sketch(t) for t in texts], pa.list_(pa.int64()))], names=["toxic", "words", "sketch"])
        known.clear()
        tidy()

    read = settle(texts.repartition(64).select("toxic", "text").mapInArrow(restored, "toxic int, words array<string>, sketch array<long>"), "toxicity-sample")

    def count(batches):
        seen = [Counter(), Counter()]
        for batch in batches:
            for toxic, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic > 0].update({f for w in words for f in features(w)})
        names = list(seen[1])  # what stands in no toxic row can be no entry
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([0] * len(names), pa.int64())], names=["f", "toxic", "clean"])
        names = list(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())], names=["f", "toxic", "clean"])
        seen.clear()
        tidy()

    counts = read.select("toxic", "words").mapInArrow(count, "f string, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    good = counts.where((F.col("toxic") >= LEAST_ROWS) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean"))))
    names = [r["f"] for r in good.orderBy("f").select("f").collect()]
    number = {f: i for i, f in enumerate(names)}

    def match(batches):
        for batch in batches:
            found = [sorted({number[f] for w in words for f in features(w) if f in number}) for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2)], names=["toxic", "found", "sketch"])
        tidy()

    matched = read.mapInArrow(match, "toxic int, found array<int>, sketch array<long>").collect()
    model.entries, model.base = cover([(int(r["toxic"] > 0), r["found"], r["sketch"]) for r in matched], names)
    return model


def score_texts(df: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """df with the column score (0 to 1). Null and empty texts get the share of toxic rows without any entry."""
    if score in df.columns:
        raise ValueError(f"column {score} is there already; choose another output name")
    small_batches(df.sparkSession)
    schema = df.select("*", F.lit(0.0).alias(score)).schema
    source = df.withColumn(score, text_of(text))

    def run(batches):
        scorer = Scorer(model)
        gc.disable()
        try:
            for batch in batches:
                own = [scorer.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own, pa.float64())], names=schema.names)
        finally:
            scorer.clear()
            tidy()

    return source.mapInArrow(run, schema)


def restore_texts(df: DataFrame, model: ToxicityModel, text: str = "text", restored: str = "restored") -> DataFrame:
    """df with the column restored: the text as the channel's likeliest source, in lower case. Null stays null, and an
    empty df empty. A column of that name raises ValueError."""
    if restored in df.columns:
        raise ValueError(f"column {restored} is there already; choose another output name")
    schema = df.select("*", F.lit("").alias(restored)).schema
    schema[restored].nullable = True
    place = df.columns.index(text)

    def run(batches):
        for batch in batches:
            own = [None if t is None else model.restored_text(t) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def fit_outside_fold(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model learned from labels of rows whose crc32 remainder by 5 isn't 0."""
    return fit(documents, labels.select("doc_id", "toxic").where(held_out("doc_id", 5) != 0))
