"""Byte-level pair encoding with a published rank file, by two tiers of look-up, and decoding.

Tier one is a minimal perfect hash over the vocabulary: every entry has one of as many slots as there are
entries.  A bucket of the hash picks a displacement, the displacement and the hash pick the slot, and the
slot's bytes are compared with the pre-token's, so a foreign pre-token never passes.  Tier two takes what
is left: the bytes of a pre-token form a linked list, a heap holds the rank and place of every pair that
the vocabulary joins, and entries that a later merge has made stale are skipped.  Decoding concatenates
the vocabulary's byte strings.

The pattern tells letters, digits, white space and ASCII characters apart and nothing else, so it runs
over one byte for each character: ASCII as it is, other characters as one that stands for their class.

Every row is encoded whole: null and empty texts give no ids and no bytes; repeated rows and null ids are
rows like any other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.bpe import NOT_LETTERS
from feedlake.llm.hashing import Rolling, mix
from feedlake.llm.shared import map_arrow
from feedlake.llm.words import parts

# Mean number of keys in a bucket of the hash.
BUCKET = 4
# Text bytes that are encoded at once (a longer text alone), and pre-tokens kept with their ids for each worker.
CHUNK = 1 << 20
STORE_WORDS = 250_000
STORE_BYTES = 64
# A heap entry is a rank over a place; NONE stands above all ranks.
MASK = (1 << 40) - 1
NONE = (1 << 22) - 1
STEP = np.uint64(0xA0761D6478BD642F)


def slot_of(hashes: np.ndarray, displacement: np.ndarray, slots: int) -> np.ndarray:
    return (mix(hashes + displacement.astype(np.uint64) * STEP) % np.uint64(slots)).astype(np.int64)


def minimal_perfect_hash(hashes: np.ndarray) -> np.ndarray:
    """Displacements by bucket, so that all ``hashes`` (distinct) have slots 0 .. n - 1 of their own.

    Full buckets choose first.  A bucket of one key takes a free slot outright, kept as -1 - slot.
    """
    n = len(hashes)
    buckets = max(1, n // BUCKET)
    at = (hashes >> np.uint64(32)).astype(np.int64) % buckets
    order = np.argsort(at, kind="stable")
    sizes = np.bincount(at, minlength=buckets)
    firsts = np.cumsum(sizes) - sizes
    free = np.ones(n, bool)
    chosen = np.zeros(buckets, np.int64)
    for bucket in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[bucket])
        if size < 2:
            break
        keys = hashes[order[firsts[bucket] : firsts[bucket] + size]]
        tried = 0
        while True:
            some = np.arange(tried, tried + 64)
            places = np.sort(slot_of(keys[None, :], some[:, None], n), axis=1)
            good = free[places].all(axis=1) & (np.diff(places, axis=1) != 0).all(axis=1)
            if good.any():
                first = int(good.argmax())
                chosen[bucket] = tried + first
                free[places[first]] = False
                break
            tried += 64
    left = np.flatnonzero(free)
    single = np.flatnonzero(sizes == 1)
    chosen[single] = -1 - left[: len(single)]
    return chosen


def look_up(hashes: np.ndarray, displacements: np.ndarray, slots: int) -> np.ndarray:
    """The one slot that may hold each hash."""
    moved = displacements[(hashes >> np.uint64(32)).astype(np.int64) % len(displacements)]
    return np.where(moved < 0, -1 - moved, slot_of(hashes, np.maximum(moved, 0), slots))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def byte_pattern(pattern: str) -> str:
    """The pattern over one byte a character."""
    out = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    if r"\p" in out:
        raise ValueError(f"the pattern tells other classes apart than letters, digits and white space: {pattern}")
    return out


def character_classes() -> np.ndarray:
    """For every code point the byte that stands for it."""
    table = np.full(0x110000, ord("!"), np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, stands in ((r"\p{L}+", "a"), (r"\p{N}+", "0"), (r"\s+", "\t")):
        for run in regex.finditer(kind, every):
            table[[ord(c) for c in run[0]]] = ord(stands)
    for first, last in NOT_LETTERS:
        table[first : last + 1] = ord("!")
    table[:128] = np.arange(128)
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by byte string from a rank file: a base64 string and a rank on each line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} has no rank for some single byte")
    if min(ranks.values()) < 0 or max(ranks.values()) >= NONE:
        raise ValueError(f"{path} has a rank outside 0 .. {NONE - 1}")
    return ranks


def compiled(ranks: dict[bytes, int], pattern: str) -> dict:
    """What a worker needs, of a size fixed by the vocabulary."""
    words = sorted(ranks, key=ranks.get)
    lengths = np.array([len(w) for w in words], np.int64)
    body = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lengths)
    hashes = Rolling(body)(ends - lengths, ends)
    if len(np.unique(hashes)) < len(words):
        raise ValueError("two vocabulary entries share a hash")
    displacements = minimal_perfect_hash(hashes)
    slots = look_up(hashes, displacements, len(words))
    by_slot = np.empty(len(words), np.int64)
    by_slot[slots] = np.arange(len(words))
    pairs = {}
    for word, rank in ranks.items():
        for cut in range(1, len(word)):
            left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    return {
        "pattern": byte_pattern(pattern), "classes": character_classes(), "displacements": displacements,
        # by place in rank order: ids, and where their bytes lie; by_slot leads from a slot to the place
        "by_slot": by_slot, "ids": np.array([ranks[w] for w in words], np.int64), "lengths": lengths, "starts": ends - lengths, "body": body,
        "pairs": (np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)),
        "bytes": np.array([ranks[bytes([b])] for b in range(256)], np.int64),
    }


class Codec:
    """Ids of many texts at once, and their bytes."""

    def __init__(self, parts_: dict):
        self.__dict__ |= {k: v for k, v in parts_.items() if k not in ("pattern", "pairs")}
        self.find = re.compile(parts_["pattern"].encode()).findall
        self.pairs = dict(zip(*(x.tolist() for x in parts_["pairs"])))
        self.of_bytes = np.array([[self.pairs.get(a << 32 | b, NONE) for b in self.bytes.tolist()] for a in self.bytes.tolist()], np.int64)
        self.place = np.full(int(self.ids.max()) + 1, -1, np.int64)
        self.place[self.ids] = np.arange(len(self.ids))
        self.newer: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def merged(self, symbols: list[int], ranks: list[int], heap: list[int]) -> list[int]:
        """Ids of a pre-token outside the vocabulary.

        ``symbols`` are the ids of its bytes, ``ranks`` the rank of every byte and the next (NONE without), ``heap``
        those ranks with their places.
        """
        pairs = self.pairs.get
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            entry = heappop(heap)
            rank, at = entry >> 40, entry & MASK
            if rank == NONE:
                break
            if ranks[at] != rank:
                continue
            other = after[at]
            symbols[at], symbols[other], ranks[other], ranks[at] = rank, -1, NONE, NONE
            after[at] = beyond = after[other]
            if beyond < n:
                before[beyond] = at
                if (found := pairs(rank << 32 | symbols[beyond])) is not None:
                    ranks[at] = found
                    heappush(heap, found << 40 | at)
            back = before[at]
            if back >= 0:
                if (found := pairs(symbols[back] << 32 | rank)) is not None:
                    ranks[back] = found
                    heappush(heap, found << 40 | back)
                else:
                    ranks[back] = NONE
        return [s for s in symbols if s >= 0]

    def merged_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens outside the vocabulary, as little-endian 32-bit integers."""
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        body = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.bytes[body]
        ranks = np.append(self.of_bytes[body[:-1], body[1:]], NONE)
        ranks[ends - 1] = NONE
        heap = ranks << 40 | ranges(np.zeros(len(words), np.int64), lengths)
        out = []
        for a, b in zip((ends - lengths).tolist(), ends.tolist()):
            first = heap[a:b]
            first.sort()
            out.append(np.array(self.merged(symbols[a:b].tolist(), ranks[a:b].tolist(), first.tolist()), "<i4").tobytes())
        return out

    def missed(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word, from what is kept or anew.  The words kept have two generations: when the newer
        one is full it becomes the older, which goes; a word that is met again moves to the newer."""
        new = list({w for w in words if w not in self.newer and w not in self.older})
        for word in words:
            if word not in self.newer and (found := self.older.get(word)) is not None:
                self.newer[word] = found
        fresh = dict(zip(new, self.merged_all(new))) if new else {}
        out = [fresh.get(w) or self.newer[w] for w in words]
        self.newer.update((w, x) for w, x in fresh.items() if len(w) <= STORE_BYTES)
        if len(self.newer) > STORE_WORDS:
            self.newer, self.older = {}, self.newer
        return out

    def pre_tokens(self, body: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length in bytes of every pre-token, and the number of pre-tokens of every text."""
        sizes, counts = [], np.zeros(len(lengths), np.int64)
        if body.max(initial=0) < 128:
            shown, cuts, offsets = body.tobytes(), np.append(0, np.cumsum(lengths)), None
        else:
            points = np.frombuffer(body.tobytes().decode().encode("utf-32-le"), "<u4")
            shown = self.classes[points].tobytes()
            offsets = np.append(0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)))
            cuts = np.searchsorted(offsets, np.append(0, np.cumsum(lengths)))
        cuts = cuts.tolist()
        for row in range(len(lengths)):
            found = self.find(shown, cuts[row], cuts[row + 1])
            sizes.extend(map(len, found))
            counts[row] = len(found)
        sizes = np.array(sizes, np.int64)
        if offsets is None:
            return sizes, counts
        ends = offsets[np.cumsum(sizes)]
        return np.diff(ends, prepend=0), counts

    def encode(self, body: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts that lie one after the other in ``body``, and the number of ids of each."""
        if not len(body):
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        sizes, counts = self.pre_tokens(body, lengths)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        entry = self.by_slot[look_up(Rolling(body)(starts, ends), self.displacements, len(self.by_slot))]
        known = self.lengths[entry] == sizes
        own = np.flatnonzero(known)
        if len(own):
            same = self.body[ranges(self.starts[entry[own]], sizes[own])] == body[ranges(starts[own], sizes[own])]
            known[own] = np.logical_and.reduceat(same, np.cumsum(sizes[own]) - sizes[own])
        raw = body.tobytes()
        odd = np.flatnonzero(~known)
        missed = self.missed([raw[a:b] for a, b in zip(starts[odd].tolist(), ends[odd].tolist())])
        n_ids = np.ones(len(sizes), np.int64)
        n_ids[odd] = [len(x) // 4 for x in missed]
        last = np.cumsum(n_ids)
        out = np.empty(int(last[-1]), np.int32)
        out[last[known] - 1] = self.ids[entry[known]]
        out[ranges((last - n_ids)[odd], n_ids[odd])] = np.frombuffer(b"".join(missed), "<i4")
        upto = np.append(0, last)[np.append(0, np.cumsum(counts))]
        return out, np.diff(upto)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and the number of bytes of each text."""
        places = self.place[ids]
        lengths = self.lengths[places]
        upto = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
        return self.body[ranges(self.starts[places], lengths)], np.diff(upto)


_codecs: dict[int, Codec] = {}


def codec_of(key: int, sent: Broadcast) -> Codec:
    """The worker's codec for a broadcast vocabulary, kept between tasks."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(sent.value)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, ids, decoded (the bytes that the ids stand for)."""
    key = xxhash.xxh64_intdigest(repr((sorted(ranks.items(), key=lambda x: x[1]), pattern)).encode())
    sent = docs.sparkSession.sparkContext.broadcast(compiled(ranks, pattern))

    def encode(batches):
        codec = codec_of(key, sent)
        for batch in batches:
            for a, b, body, lengths in parts(batch, 1, CHUNK):
                ids, counts = codec.encode(body, lengths)
                decoded, n_bytes = codec.decode(ids, counts)
                bounds = lambda n: pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(bounds(counts), pa.array(ids)),
                    pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, bounds(n_bytes).buffers()[1], pa.py_buffer(decoded.tobytes())]),
                ], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).transform(map_arrow, encode, "doc_id bigint, ids array<int>, decoded binary")
