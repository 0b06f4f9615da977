"""BPE encoding and decoding in batched numpy merge rounds.

The words of many documents lie in one flat array of symbols. A round looks all neighbouring pairs up by binary
search over the sorted pair keys, takes each word's lowest rank, merges that pair wherever it stands in the word
and drops the words that have no pair left. Words repeat, so a worker keeps the results of recent ones; that
store is emptied when it is full, which changes the time taken and nothing else.

Works for tokenizer files of the kind "BPE with word ends": NFC, white space folded, lower case, bytes as symbols.
Null texts count as empty and give no ids. Rows keep their order and number; other columns pass through.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.llm._shared import text_of, tidy

NO_RANK = np.int64(2**62)
#: Words that a worker remembers, and their symbols.
REMEMBERED_WORDS = 200_000
REMEMBERED_IDS = 4_000_000
WHITE = regex.compile(r"\p{White_Space}+")
#: Fixed value: the split pattern of the tokenizer.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: str.split() also cuts at these four, which aren't white space to the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class BpeModel:
    """A vocabulary and its merges as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.size = size
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int64)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has. No word may be empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            keys = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = (self.keys[at] == keys) & (owner[1:] == owner[:-1])
            rank = np.append(np.where(known, self.ranks[at], NO_RANK), NO_RANK)
            lowest = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(symbols)))
            lowest_here = np.repeat(lowest, counts)
            over = lowest_here == NO_RANK
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
            chosen = (rank == lowest_here) & ~over
            place = np.arange(len(symbols))
            run = place - np.maximum.accumulate(np.where(chosen, -1, place))  # 1, 2, ... in a row of chosen pairs
            chosen &= run % 2 == 1  # of overlapping ones the first, third, ...
            hit = np.flatnonzero(chosen)
            symbols[hit] = self.made[at[hit]]
            keep = ~over
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return np.zeros(0, np.int64), lengths
        all_owner = np.concatenate(done_owner)
        order = np.argsort(all_owner, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(all_owner, minlength=len(words))

    def pieces(self, chunk: str) -> list[str]:
        """The words of a chunk without white space."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
            if "\u03a3" in chunk:
                chunk = "".join(map(str.lower, chunk))  # letter by letter: no final sigma
        chunk = chunk.lower()
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return PIECES.findall(chunk)

    def chunks(self, text: str) -> list[str]:
        """What lies between white space; special tokens are chunks of their own."""
        if self.split_special and "<|" in text:
            return [x for i, part in enumerate(self.split_special.split(text)) for x in ([part] if i % 2 else self._split(part))]
        return self._split(text)

    @staticmethod
    def _split(text: str) -> list[str]:
        return [x for x in WHITE.split(text) if x] if SEPARATORS.search(text) else text.split()

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


class Numbers(dict):
    """Numbers new keys in the order in which they are looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Lists:
    """Numbered lists of integers, kept in one flat array."""

    def __init__(self):
        self.flat, self.counts, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        self.counts = np.concatenate([self.counts, counts])
        self.starts = np.cumsum(self.counts) - self.counts

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers one after the other, and their lengths."""
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        if not len(ends) or not ends[-1]:
            return self.flat[:0], counts
        return self.flat[np.repeat(self.starts[numbers] - ends + counts, counts) + np.arange(ends[-1])], counts


class Memory:
    """Chunks seen lately as lists of words, words as lists of ids and as decoded text."""

    def __init__(self, model: BpeModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.chunk_number, self.word_number = Numbers(), Numbers()
        self.chunk_words, self.word_ids = Lists(), Lists()
        self.decoded: list[str] = []

    def learn(self) -> None:
        """Gives the chunks that were numbered since the last time their words, and new words their ids."""
        new = list(islice(reversed(self.chunk_number), len(self.chunk_number) - len(self.chunk_words.counts)))[::-1]
        if not new:
            return
        model = self.model
        special = {c for c in new if c in model.special}
        pieces = [[c] if c in special else model.pieces(c) for c in new] if special else list(map(model.pieces, new))
        flat = list(chain.from_iterable(pieces))
        self.chunk_words.add(np.fromiter(map(self.word_number.__getitem__, flat), np.int64, len(flat)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        words = list(islice(reversed(self.word_number), len(self.word_number) - len(self.decoded)))[::-1]
        if not words:
            return
        ids, counts = model.encode_words([w.encode("utf-8", "surrogatepass") for w in words])
        if special:
            lists = [[model.special[w]] if w in special else x for w, x in zip(words, np.split(ids, np.cumsum(counts)[:-1]), strict=True)]
            ids, counts = np.concatenate(lists), np.array(list(map(len, lists)), np.int64)
        self.word_ids.add(ids, counts)
        listed, at = list(map(model.tokens.__getitem__, ids.tolist())), 0
        for n in counts.tolist():
            self.decoded.append(" ".join(listed[at : at + n]) if n > 1 else listed[at])
            at += n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Flat ids, ids of each text, decoded texts."""
        if len(self.chunk_number) > REMEMBERED_WORDS or len(self.word_ids.flat) > REMEMBERED_IDS:
            self.clear()
        number, numbers = self.chunk_number.__getitem__, []
        for text in texts:
            chunks = self.model.chunks(text)
            numbers.append(np.fromiter(map(number, chunks), np.int32, len(chunks)))
        self.learn()
        back, ids, counts, decoded = self.decoded.__getitem__, [self.word_ids.flat[:0]], [], []
        for own in numbers:
            words, _ = self.chunk_words.of(own)
            found, _ = self.word_ids.of(words)
            decoded.append(" ".join(map(back, words.tolist())))
            ids.append(found)
            counts.append(len(found))
        return np.concatenate(ids), np.array(counts, np.int64), decoded


_MEMORIES: dict[str, Memory] = {}


def memory_of(path: str) -> Memory:
    if path not in _MEMORIES:
        _MEMORIES[path] = Memory(BpeModel(path))
    return _MEMORIES[path]


#: Characters of text that are encoded at once.
SLICE_CHARS = 2_000_000


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about as much text each; one long text stays whole."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def fresh(df: DataFrame, *names: str) -> None:
    clash = set(names) & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already; choose other output names")


def bpe_encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with the column ids (array<int>), the token ids of each whole text; decoded: also the ids turned back into text.

    vocabulary: path of the tokenizer file, readable at the same place on every worker. Null texts give [].
    An output name that df already has raises ValueError.
    """
    fresh(df, ids, *([decoded] if decoded else []))
    source = df.withColumn(ids, text_of(text))
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.StringType(), False)] if decoded else [])])

    def encode(batches):
        memory = memory_of(vocabulary)
        gc.disable()  # large dictionaries of strings: looking through them for cycles takes longer than the work
        try:
            for batch in batches:
                texts = batch.column(batch.num_columns - 1).to_pylist()
                for lo, hi in slices(texts):
                    flat, counts, back = memory.encode(texts[lo:hi])
                    arrays = batch.slice(lo, hi - lo).columns[:-1]
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat, pa.int32())))
                    if decoded:
                        arrays.append(pa.array(back, pa.string()))
                    yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])
        finally:
            memory.clear()
            tidy()

    return source.mapInArrow(encode, schema)


def bpe_decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the column decoded: the tokens of ids, joined as the library does. Null ids give null."""
    fresh(df, decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType(), True)])
    place = df.columns.index(ids)

    def decode(batches):
        model = memory_of(vocabulary).model
        for batch in batches:
            back = [None if x is None else model.decode(x) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=[f.name for f in schema.fields])

    return df.mapInArrow(decode, schema)


def bpe_digest(df: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of df's doc_id and text."""
    coded = bpe_encode(df.select("doc_id", "text"), vocabulary, decoded="decoded").select("doc_id", "ids", "decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
