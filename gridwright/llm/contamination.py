"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Words are lower-case runs of ASCII letters, digits and all other characters beyond ASCII. Passages are aligned with the
items: match +2, mismatch and gap -1, local. The score is the alignment's over 2 times the item's words: 1 for a full
copy. A passage is found if it scores LEAST_SCORE with the item or, however long the item is, with one of its pieces of
PIECE words, which overlap by half: PIECE / 2 copied words in a row always do.

Seeds are pairs of words that follow each other in the item, and in the text with at most one word between. An alignment
that scores half of n words holds at least n / 3 - 1 of their pairs so, whatever was edited, within 2 n words: u words
not matched and i put in break at most 2 u + i / 2 pairs, and 3 u + i <= n. A first pass counts the pairs in the whole
corpus. Of those that occur, all but the n / 3 - 2 most frequent are seeds, so a passage holds one; a second pass cuts
the passages around seeds out of the texts. One without enough pairs, or whose words, as a bag, cannot reach the least
score, is left out. None of these steps loses a passage.

Items are taken in blocks of at most BLOCK_WORDS words, so what is sent to the workers is bounded; a larger benchmark
takes more passes. Items of fewer than LEAST_WORDS words must stand in a text word by word.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm._shared import small_batches, text_of, tidy

LEAST_WORDS, PIECE, BLOCK_WORDS = 8, 40, 2_000_000
MATCH, OTHER = 2, -1
LEAST_SCORE = 0.5
#: Passages aligned at once, and places in all of them together, at most (one longer passage alone).
BATCH, CELLS = 256, 1_000_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def parts_of(n: int) -> list[tuple[int, int]]:
    """The parts of an item of n words that a passage may be a copy of: the whole, and pieces of a longer one."""
    starts = sorted({*range(0, n - PIECE, PIECE // 2), n - PIECE}) if n > PIECE else []
    return [(0, n), *((at, at + PIECE) for at in starts)]


def pairs_needed(n: int) -> int:
    """The pairs of a part of n words that stand in any passage which reaches the least score."""
    return n - 1 if n < LEAST_WORDS else (n + 2) // 3 - 1


class Items:
    """A block of items: the vocabulary, sorted pairs of words, and the parts and places where they stand."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words = {i: words_of(t) for i, t in items}
        self.vocabulary: dict[bytes, int] = {}
        for own in self.words.values():
            for w in own:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.size = len(self.vocabulary) + 1
        if self.size >= 2**31:
            raise ValueError("too many words in a block of items")
        self.names = list(self.words)
        self.ids = [np.array([self.vocabulary[w] for w in own], np.int64) for own in self.words.values()]
        #: (item, words) of each part, and the pairs in it. The pair of a single word is the word and 0.
        parts = [(k, lo, hi) for k, x in enumerate(self.ids) if len(x) for lo, hi in parts_of(len(x))]
        self.part_item = np.array([k for k, _, _ in parts], np.int64)
        self.part_words = np.array([hi - lo for _, lo, hi in parts], np.int64)
        pairs = [self.ids[k][lo : hi - 1] * self.size + self.ids[k][lo + 1 : hi] if hi - lo > 1 else self.ids[k] * self.size for k, lo, hi in parts]
        self.needed = np.array([max(1, pairs_needed(hi - lo)) for _, lo, hi in parts], np.int64)
        every = np.concatenate([np.zeros(0, np.int64), *pairs])
        of_part = np.repeat(np.arange(len(parts)), [len(x) for x in pairs])
        order = np.argsort(every, kind="stable")
        self.grams, self.first, self.times = np.unique(every[order], return_index=True, return_counts=True)
        #: The part of each entry, in the order of the pairs.
        self.entry_part = of_part[order]

    def ids_of(self, text: str) -> np.ndarray:
        own = words_of(text)
        return np.fromiter(map(self.vocabulary.get, own, repeat(0)), np.int64, len(own))

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ids at which one of the pairs starts, and which one."""
        known = np.flatnonzero(ids)
        if not len(known) or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = ids[known] * self.size
        padded = np.concatenate([ids, np.zeros(2, np.int64)])
        places, keys = [known], [own]
        for far in (1, 2):
            after = padded[known + far]
            places.append(known[after > 0])
            keys.append((own + after)[after > 0])
        places, keys = np.concatenate(places), np.concatenate(keys)
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        hit = self.grams[at] == keys
        return places[hit], at[hit]

    def seeds(self, counts: np.ndarray) -> np.ndarray:
        """Whether each entry is a seed: of a part's pairs that occur, all but the most frequent needed - 1."""
        rare = np.repeat(counts, self.times)
        order = np.lexsort((-rare, self.entry_part))
        sizes = np.bincount(self.entry_part, minlength=len(self.needed))
        place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found = np.zeros(len(order), bool)
        found[order] = place >= np.repeat(self.needed - 1, sizes)
        return found & (rare > 0)


def count_grams(docs: DataFrame, block: Items) -> np.ndarray:
    """How often each of the block's pairs stands in the corpus."""

    def run(batches):
        total = np.zeros(len(block.grams), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                _, which = block.find(block.ids_of(text))
                total += np.bincount(which, minlength=len(total)) if len(which) > 1000 else 0
                if len(which) <= 1000:
                    np.add.at(total, which, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])
        tidy()

    counts = np.zeros(len(block.grams), np.int64)
    for r in docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    return counts


def passages(docs: DataFrame, block: Items, counts: np.ndarray) -> DataFrame:
    """docs: doc_id, text. doc_id, item_id, start (word), ids (numbers of words, 0 for those of no item): passages that may
    reach the least score."""
    seeds = block.seeds(counts)
    bags = [dict(zip(*np.unique(x, return_counts=True), strict=True)) for x in block.ids]

    def windows(ids: np.ndarray) -> dict[int, list[list[int]]]:
        """Item -> stretches of the text that hold enough pairs of one of its parts, close enough together."""
        places, which = block.find(ids)
        times = block.times[which]
        entry = np.repeat(block.first[which] - np.cumsum(times) + times, times) + np.arange(times.sum())
        seeded = np.unique(block.entry_part[entry[seeds[entry]]])
        if not len(seeded):
            return {}
        part, n = np.unique(block.entry_part[np.unique(entry)], return_counts=True)  # each pair of a part counts once
        part = np.intersect1d(part[n >= block.needed[part]], seeded, assume_unique=True)
        if not len(part):
            return {}
        of_entry, at = block.entry_part[entry], np.repeat(places, times)
        found: dict[int, list[list[int]]] = {}
        for p in part.tolist():
            own, length, more = np.sort(at[of_entry == p]), int(block.part_words[p]), int(block.needed[p]) - 1
            last = own[more:]
            own = own[: len(last)]
            close = last - own <= 2 * length
            stretches = found.setdefault(int(block.part_item[p]), [])
            stretches += [[max(0, x - 2 * length), min(len(ids), y + 2 * length + 1)] for x, y in zip(own[close].tolist(), last[close].tolist(), strict=True)]
        for item, stretches in found.items():
            merged: list[list[int]] = []
            for lo, hi in sorted(stretches):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            found[item] = merged
        return found

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = block.ids_of(text)
                for item, stretches in windows(ids).items():
                    length, bag = len(block.ids[item]), bags[item]
                    for lo, hi in stretches:
                        there, n = np.unique(ids[lo:hi], return_counts=True)
                        shared = sum(min(c, bag.get(w, 0)) for w, c in zip(there.tolist(), n.tolist(), strict=True))
                        if shared >= LEAST_SCORE * min(length, PIECE):
                            out.append((doc, block.names[item], lo, ids[lo:hi]))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.int64()))], names=["doc_id", "item_id", "start", "ids"])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, start long, ids array<long>")


def smith_waterman(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of id arrays: the best local score, and the passage's part (first word, end) of the best alignment that
    ends first. Rows are the items' words; a row's gaps are solved by a running maximum."""
    n, rows, cols = len(items), max(map(len, items)), max(map(len, texts))
    a, b = np.full((n, rows), -1, np.int32), np.full((n, cols), -2, np.int32)
    for k in range(n):
        a[k, : len(items[k])], b[k, : len(texts[k])] = items[k], texts[k]
    place = np.arange(cols + 1, dtype=np.int32)
    scale = np.int64(cols + 2)  # the score and, against ties, the start are kept in one number: a higher score first, then a later start

    def pack(score, start):
        return score * scale + start

    fresh = np.broadcast_to(place.astype(np.int64), (n, cols + 1))  # score 0, starting here
    h = fresh.copy()
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(rows):
        step = np.where(a[:, i, None] == b, MATCH, OTHER).astype(np.int64) * scale
        t = np.maximum(fresh, h + OTHER * scale)
        t[:, 1:] = np.maximum(t[:, 1:], h[:, :-1] + step)
        lift = place * -OTHER * scale
        h = np.maximum(np.maximum.accumulate(t + lift, axis=1) - lift, fresh)
        top = h // scale
        j = top.argmax(1)
        value = h[np.arange(n), j]
        better = value // scale > best // scale
        best, end = np.where(better, value, best), np.where(better, j, end)
    return best // scale, best % scale, end


def scored(todo: list[tuple[np.ndarray, np.ndarray]]):
    """smith_waterman over pairs of any number and length: (score, first, end) of each, in the order of todo."""
    found: list = [None] * len(todo)
    order = sorted(range(len(todo)), key=lambda k: (len(todo[k][0]), len(todo[k][1])))
    at = 0
    while at < len(order):
        end, widest = at, 0
        while end < len(order) and end - at < BATCH:
            widest = max(widest, len(todo[order[end]][1]))
            if end > at and (end - at + 1) * widest > CELLS:
                break
            end += 1
        part, at = order[at:end], end
        for k, *got in zip(part, *smith_waterman([todo[k][0] for k in part], [todo[k][1] for k in part]), strict=True):
            found[k] = tuple(map(int, got))
    return found


def align(cut: DataFrame, block: Items, least: float) -> DataFrame:
    """cut: passages. Alignments with the block's items that are found with this least score; what stands before and after
    one is aligned again. The items are with the workers already, so there is no join and no exchange."""
    place = {name: k for k, name in enumerate(block.names)}

    def run(batches):
        for batch in batches:
            todo, out = [], []
            for r in batch.to_pylist():
                todo.append((r, block.ids[place[r["item_id"]]].astype(np.int32), r["start"], np.array(r["ids"], np.int32)))
            while todo:
                enough = [(least if len(x) >= LEAST_WORDS else 1.0) * MATCH * len(x) for _, x, _, _ in todo]
                hits = scored([(x, t) for _, x, _, t in todo])
                doubt = [k for k, (score, _, _) in enumerate(hits) if least * MATCH * PIECE <= score < enough[k]]
                pieces = [(k, lo, hi) for k in doubt for lo, hi in parts_of(len(todo[k][1]))[1:]]
                by_piece = scored([(todo[k][1][lo:hi], todo[k][3]) for k, lo, hi in pieces])
                copied = {k for (k, _, _), (score, _, _) in zip(pieces, by_piece, strict=True) if score >= least * MATCH * PIECE}
                more = []
                for k, ((r, item, start, text), (score, first, end)) in enumerate(zip(todo, hits, strict=True)):
                    if score >= enough[k] or k in copied:
                        out.append((r["doc_id"], r["item_id"], score / (MATCH * len(item)), start + first, start + end))
                        for at, rest in ((start, text[:first]), (start + end, text[end:])):
                            if np.count_nonzero(rest) * MATCH >= min(enough[k], least * MATCH * PIECE):
                                more.append((r, item, at, rest))
                todo = more
            columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "score", "first_word", "end_word"])

    return cut.mapInArrow(run, "doc_id long, item_id long, score double, first_word long, end_word long")


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS):
    """Items (id, text) in blocks of at most so many words (one larger item alone), one block at a time on the driver."""
    part, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), text_of("text").alias("text")).where("item_id is not null").groupBy("item_id").agg(F.max("text").alias("text")).orderBy("item_id")
    for r in rows.toLocalIterator():
        n = len(words_of(r["text"]))
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append((r["item_id"], r["text"]))
        size += n
    if part:
        yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", least: float = LEAST_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: every passage that aligns with an item, or with a piece of PIECE
    words of a longer one, at `least` or better. The score is the share of the whole item also where a piece decides.

    Null texts count as empty; a null doc_id passes through; items without a number don't count, and of several
    texts of one item_id the largest does. Repeated documents come out repeated. Extra columns take no part.
    An empty table on either side gives no rows. Texts and items are taken whole, however long they are.
    """
    if not LEAST_SCORE <= least <= 1:
        raise ValueError(f"least must be from {LEAST_SCORE} to 1")
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    found = own.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    for part in blocks(benchmark, block_words):
        block = Items(part)
        found = found.union(align(passages(own, block, count_grams(own, block)), block, least))
    return found
