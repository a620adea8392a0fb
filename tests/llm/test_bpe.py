import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, normalizers

from feedlake.llm import bpe
from feedlake.llm.registry import op6_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.Encoder(bpe.read_vocabulary(PATH))


def library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def check(text):
    ids, decoded = library(text)
    code = OWN.encode(text)
    assert np.frombuffer(code, "<u4").tolist() == ids
    assert OWN.decode(code) == decoded


@pytest.mark.parametrize("text", [
    "", " ", "İstanbul ΑΣ Σ", "é ﬁ ǅ", "it's IT'S 'LL we'Ll", "a\x1cb\x1fc\x85d e​f", "<|endoftext|>Ab<|startoftext|><|EndOfText|> <|x|>",
    "½ Ⅷ ٣ 12", "ẞß ͅ", "ꟋᲉ \U00010d50౜\U00033000", "x" * 3000, "ab " * 2000, "\U0001f600\U0001f600!?",
])
def test_odd_texts(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check(text)


def test_every_code_point():
    for start in range(0, 0x110000, 64):
        chars = [chr(c) for c in range(start, start + 64) if not 0xD800 <= c < 0xE000]
        check(" ".join(f"a{c}b1!{c}" for c in chars))


def test_every_mark_beside_others():
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    for m in marks:
        check(f"a\u0315{m} a{m}\u0316 a{m}\u0301 e\u0316{m}\u0315\u0301 {m}\u0301{m}\u0316 \u0915{m}\u093c")


def test_every_composite_taken_apart():
    normal = normalizers.NFC()
    for start in range(0, 0x110000, 64):
        text = "".join(unicodedata.normalize("NFD", chr(c)) + "\u0316" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert bpe.composed(text) == normal.normalize_str(text)


def test_random_texts_of_marks():
    """100,000 texts, many of them from letters and marks only."""
    rng = random.Random(9)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    letters = list("aeouAE ıß한ᄒ\U00011935\U00011930\u0915")
    for _ in range(100_000):
        pool = rng.choice([letters + rng.sample(marks, 4), rng.sample(every, 8)])
        check("".join(rng.choices(pool, k=rng.randrange(1, 9))))


def test_documents(spark):
    rows = [(1, "Hello <|endoftext|>", "x"), (None, None, "x"), (3, "", None), (3, "", None), (4, "mot é " * 40_000, "x")]
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), bpe.read_vocabulary(PATH)).collect()
    want = [(i, np.array(library(t or "")[0], "<u4").tobytes(), library(t or "")[1]) for i, t, _ in rows]
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id bigint, text string"), bpe.read_vocabulary(PATH)).collect() == []


def test_query_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = set()
    for r in docs:
        ids, decoded = library(r.text)
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert {tuple(r) for r in op6_bpe(spark, "/root/testdata/sf0.001").collect()} == want
