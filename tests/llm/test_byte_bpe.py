import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from feedlake.llm import byte_bpe
from feedlake.llm.registry import op12_byte_bpe

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
SPEC = byte_bpe.compiled(RANKS, PATTERN)
OWN = byte_bpe.Codec(SPEC)


def check(texts):
    raw = [t.encode() for t in texts]
    body, lengths = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
    ids, counts = OWN.encode(body, lengths)
    decoded, sizes = OWN.decode(ids, counts)
    assert decoded.tobytes() == body.tobytes() and sizes.tolist() == lengths.tolist()
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == LIBRARY.encode_ordinary(text), repr(text)


def test_hash_is_minimal_and_perfect():
    for n in (1, 2, 3, 50, 3000):
        hashes = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
        slots = byte_bpe.look_up(hashes, byte_bpe.minimal_perfect_hash(hashes), n)
        assert sorted(slots.tolist()) == list(range(n))
    assert sorted(SPEC["by_slot"].tolist()) == list(range(len(RANKS)))


@pytest.mark.parametrize("text", [
    "", " ", "it's IT'S we'll we'Ll 'x", "a\x1cb\x1fc\x85d e​f", "<|endoftext|>", "½ Ⅷ ٣ 12", "  two  blanks \n\n x \t", "  x", "x" * 3000,
    "ab" * 2000, "\U0001f600\U0001f600!?", " " * 2000, "\r\n a", "ʼn't", "౜\U00033000",
])
def test_odd_texts(text):
    check([text, "", text])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_texts(texts):
    check([*texts, "end"])


def test_every_code_point():
    texts = []
    for start in range(0, 0x110000, 64):
        chars = [chr(c) for c in range(start, start + 64) if not 0xD800 <= c < 0xE000]
        texts.append(" ".join(f"a{c}b1!{c}1{c}" for c in chars))
    check(texts)


def test_random_texts_and_a_full_store(monkeypatch):
    monkeypatch.setattr(byte_bpe, "STORE_WORDS", 50)
    rng = random.Random(5)
    pools = [[chr(c) for c in range(0x20, 0x3000)], list(" '\t\n strevmldaé!0"), [chr(c) for c in range(0x80, 0x11000) if not 0xD800 <= c < 0xE000]]
    for _ in range(40):
        check(["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60))) for _ in range(25)])


def test_other_vocabulary():
    """A small rank file whose ids have gaps, and a pattern that is not known."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 301, b"abc": 305, b"cc": 299}
    own = byte_bpe.Codec(byte_bpe.compiled(ranks, PATTERN))
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = b"abc aabbccc cccc bcbc"
    ids, counts = own.encode(np.frombuffer(text, np.uint8), np.array([len(text)]))
    assert ids.tolist() == library.encode_ordinary(text.decode())
    assert own.decode(ids, counts)[0].tobytes() == text
    with pytest.raises(ValueError):
        byte_bpe.compiled(ranks, r"\p{Lu}+|.")


def test_documents(spark):
    rows = [(1, "Hello <|endoftext|>", "x"), (None, None, "x"), (3, "", None), (3, "", None), (4, "mot é " * 40_000, "x"), (5, "ünïcode's", "y")]
    got = byte_bpe.encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), RANKS, PATTERN).collect()
    want = [(i, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows]
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got), key=repr) == sorted(want, key=repr)
    assert byte_bpe.encode_documents(spark.createDataFrame([], "doc_id bigint, text string"), RANKS, PATTERN).collect() == []


def test_query_against_the_library(spark):
    want = set()
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode_bytes(ids)).hexdigest()))
    assert {tuple(r) for r in op12_byte_bpe(spark, "/root/testdata/sf0.001").collect()} == want
