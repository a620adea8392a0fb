"""Byte-pair encoding with a published vocabulary, and decoding.

A word's symbols form a doubly linked list.  A priority queue holds the rank and place of every pair
that has one; the least rank, then the leftmost place, is merged first.  A merge does not search the
queue for the pairs it broke: an entry whose place is gone, or whose pair has another rank by now, is
skipped when it comes up.  Decoding concatenates the vocabulary's strings, a blank between tokens, as
a vocabulary file without a decoder asks for.

The vocabulary is a JSON file of the ``tokenizers`` library of the kind: NFC, white space to one blank,
lower case; words by a pattern; byte-level symbols; an end-of-word suffix.  The driver reads the file
and broadcasts it: a vocabulary is a few MB, whatever the corpus.

Every row is encoded whole: null and empty texts give no ids and an empty decoded text; repeated rows
and null ids are rows like any other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.shared import map_arrow

# --- fixed values: lower case of letters added in Unicode 16 and 17, which Python's tables do not have yet
LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
# Code points that newer tables call letters or digits and the library's tables do not
NOT_LETTERS = [
    (0x0558, 0x0558), (0x058B, 0x058C), (0x088F, 0x088F), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
# Combining marks of newer tables that the library's tables do not have: it neither reorders them nor moves others past them
LATER_MARKS = [
    (0x07FD, 0x07FD), (0x0898, 0x089F), (0x08CA, 0x08D3), (0x09FE, 0x09FE), (0x0C3C, 0x0C3C), (0x0D3B, 0x0D3C), (0x0EBA, 0x0EBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x1193D, 0x1193E), (0x11943, 0x11943),
    (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97),
    (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
# A pair that newer tables compose and the library does not
LATER_PAIR = ("\U00011935", "\U00011930")
# --- end of fixed values
APART = regex.compile("([%s]|(?<=%s)(?=%s))" % ("".join(f"{chr(a)}-{chr(b)}" for a, b in LATER_MARKS), *LATER_PAIR))
UNLIKE = "".join(f"{chr(a)}-{chr(b)}" for a, b in NOT_LETTERS)
ODD = regex.compile("[%s%s]" % (UNLIKE, "".join(map(chr, LATER_LOWER))))

MASK = (1 << 40) - 1
# Words kept with their ids, for each worker; a full store is emptied.
STORE_WORDS = 300_000
STORE_CHARS = 48
OUT_CHARS = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def composed(text: str) -> str:
    """NFC by the library's tables: a mark that they lack ends what is reordered and composed."""
    if APART.search(text):
        return "".join(unicodedata.normalize("NFC", part) for part in APART.split(text) if part)
    return unicodedata.normalize("NFC", text)


class Encoder(dict):
    """Ids by text.  As a mapping: the ids of a word as little-endian 32-bit integers."""

    def __init__(self, spec: bytes):
        super().__init__()
        spec = json.loads(spec)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + suffix) for s in symbols]
        self.pairs = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            # a pair stated twice has its last rank
            self.pairs[vocab[left] << 24 | vocab[right]] = rank << 24 | vocab[left + right]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {i: s for s, i in vocab.items()} | {i: s for s, i in added.items()}
        self.strings = [ids.get(i, "") for i in range(max(ids) + 1)]
        self.added = {s: np.uint32(i).tobytes() for s, i in added.items()}
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        strict = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{UNLIKE}])")
        self.odd_words = regex.compile(strict.replace(r"[\p{L}]", rf"(?:(?![{UNLIKE}])\p{{L}})").replace(r"[\p{N}]", rf"(?:(?![{UNLIKE}])\p{{N}})"))

    def merged(self, symbols: list[int]) -> list[int]:
        pairs = self.pairs
        n = len(symbols)
        queue = []
        for at, (left, right) in enumerate(pairwise(symbols)):
            found = pairs.get(left << 24 | right)
            if found is not None:
                queue.append((found >> 24) << 40 | at)
        if not queue:
            return symbols
        heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = heappop(queue)
            at = entry & MASK
            left, other = symbols[at], after[at]
            if left < 0 or other == n:
                continue
            found = pairs.get(left << 24 | symbols[other])
            if found is None or found >> 24 != entry >> 40:
                continue
            symbols[at] = new = found & 0xFFFFFF
            symbols[other] = -1
            after[at] = beyond = after[other]
            if beyond < n:
                before[beyond] = at
                found = pairs.get(new << 24 | symbols[beyond])
                if found is not None:
                    heappush(queue, (found >> 24) << 40 | at)
            back = before[at]
            if back >= 0:
                found = pairs.get(symbols[back] << 24 | new)
                if found is not None:
                    heappush(queue, (found >> 24) << 40 | back)
        return [s for s in symbols if s >= 0]

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        inner = self.inner
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        if None in symbols:
            symbols = [s for s in symbols if s is not None]
        ids = np.array(self.merged(symbols), "<u4").tobytes()
        if len(word) <= STORE_CHARS:
            if len(self) >= STORE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not text.isascii():
            text = composed(text)
            if "Σ" in text:  # lower case by character: no final form
                text = text.replace("Σ", "σ")
            if ODD.search(text):
                return b"".join(map(self.__getitem__, self.odd_words.findall(text.translate(LATER_LOWER).lower())))
        return b"".join(map(self.__getitem__, self.words.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        if not self.special or "<|" not in text:
            return self.plain(text)
        out, at = [], 0
        for found in self.special.finditer(text):
            out += [self.plain(text[at : found.start()]), self.added[found[0]]]
            at = found.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[int, Encoder] = {}


def encoder_of(key: int, vocabulary: Broadcast) -> Encoder:
    """The worker's encoder for a broadcast vocabulary, kept between tasks."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary.value)
    return _encoders[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (their text)."""
    sent, key = docs.sparkSession.sparkContext.broadcast(vocabulary), xxhash.xxh64_intdigest(vocabulary)

    def encode(batches):
        encoder = encoder_of(key, sent)

        def out(ids, codes, texts):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

        for batch in batches:
            ids, codes, texts, size = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                code = encoder.encode(text.as_py() or "")
                ids.append(doc_id)
                codes.append(code)
                texts.append(encoder.decode(code))
                size += len(texts[-1])
                if size > OUT_CHARS:
                    yield out(ids, codes, texts)
                    ids, codes, texts, size = [], [], [], 0
            yield out(ids, codes, texts)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).transform(map_arrow, encode, "doc_id bigint, ids binary, decoded string")
