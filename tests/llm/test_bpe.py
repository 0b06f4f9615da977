import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridwright.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
MEMORY = bpe.Memory(bpe.BpeModel(PATH))


def same(texts):
    ids, counts, back = MEMORY.encode(texts)
    at = 0
    for text, n, own in zip(texts, counts.tolist(), back, strict=True):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert ids[at : at + n].tolist() == want, text
        assert own == LIBRARY.decode(want, skip_special_tokens=False)
        at += n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abehtin'sSTé́ΣσİıǅßÄ½Ⅷ5٣ \t\n\x1c\x85ﬁ<|>日😀‍.,!-_"), max_size=40), max_size=5))
def test_same_ids_as_library(texts):
    same(texts)


def test_hard_texts():
    same(["", " ", "a" * 3000, "ab" * 999, "it's <|endoftext|>x<|startoftext|>y", "ΑΣ ΑΣ", "x" * 20 + "。" * 50])


def test_digest(spark):
    rows = [(1, "Hello  world, it's"), (2, None), (3, ""), (3, "Hello"), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, bpe.bpe_digest(df, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)


def test_round_trip_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "Some text", "keep")], "doc_id long, text string, extra string")
    coded = bpe.bpe_encode(df, PATH)
    assert coded.columns == ["doc_id", "text", "extra", "ids"]
    assert bpe.bpe_decode(coded, PATH).first()["decoded"] == "some</w> text</w>"
    assert bpe.bpe_encode(df.limit(0), PATH).count() == 0
