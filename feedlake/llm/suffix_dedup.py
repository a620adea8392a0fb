"""Repeated byte strings across documents, by a common-prefix-aware distributed merge sort.

A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller id.

1. Whole texts lie in blocks.  Every window of ``length`` bytes picks an anchor: the leftmost place in
   it whose ANCHOR bytes hash least.  Equal windows pick the same place, and neighbouring windows mostly
   share theirs.  Owners of hash ranges add up how often each anchor hash occurs; an anchor that
   occurs once can't repeat and goes no further.
2. The text around every other anchor, as far as the windows that picked it reach, is a suffix string:
   from the anchor on, then what lies before it.  A block sorts its strings, keeps each once with its
   least document, and sends the run front-coded (length of the prefix shared with the string before,
   and the rest) to the owner of the anchor.
3. An owner merges its runs with a loser tree that keeps, beside each loser, the prefix length it
   shares with what beat it: unequal lengths decide a match without looking at a byte, equal ones
   compare from there on.  Equal strings come out together, and so do strings of one anchor; among
   those each window is looked up.  Answers go back: is the block's document the least, and which
   windows of the least one start in a smaller document still.
4. An anchor that occurs more than ``hot`` times is not one owner's: its strings are dealt by a hash of
   the whole.  Windows that this leaves open and whose hash occurs twice go through the same sort,
   exchange and merge as strings of their own.

Within a block equal strings are told by 64-bit hashes, between blocks by their bytes.

Documents are judged on the input, not on what is left; equal ids don't count as smaller; a null id is
the largest; a null or empty text has no bytes; texts shorter than ``length`` stay whole; repeated rows
are rows of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm import hashing
from feedlake.llm.shared import NO_ID, bucketed, map_arrow, materialise, pack_blocks, partitions, with_replies

LENGTH = 50
ANCHOR = 20
# Strings of one anchor that one task may hold at a time
HOT = 20_000
BITS = 48
BLOCK_BYTES = 8 << 20
# Bytes hashed at a time, and strings of one anchor compared pair by pair
HASH_BYTES, FEW = 1 << 18, 12


def packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


# --- front-coded runs and their merge -----------------------------------------------------------


def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two strings known to agree up to ``start``."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (differ.bit_length() + 7) // 8


def merge_runs(runs: list[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Strings in ascending order, each with where it is: (run, place in the run)."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [None] * k
    place, offset, known = [-1] * k, [0] * k, [0] * k

    def advance(r: int) -> None:
        shared, rests, body = runs[r]
        i = place[r] = place[r] + 1
        if i == len(shared):
            heads[r] = None
            return
        at, known[r] = offset[r], shared[i]
        offset[r] = end = at + rests[i]
        heads[r] = (heads[r] or b"")[: shared[i]] + body[at:end]

    def beats(a: int, b: int) -> bool:
        """Whether head a goes before head b; the loser's known prefix then refers to the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        p, q = known[a], known[b]
        if p != q:
            return p > q
        if p < len(x) and p < len(y) and x[p] != y[p]:
            first = x[p] < y[p]
            known[b if first else a] = p
            return first
        h = shared_prefix(x, y, p)
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            known[b] = h
            return True
        known[a] = h
        return False

    for r in range(len(runs)):
        advance(r)
    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1] if k > 1 else 0
    last, group = None, []
    while heads[top] is not None:
        head = heads[top]
        if last is not None and len(head) == len(last) == known[top]:
            group.append((top, place[top]))
        else:
            if group:
                yield last, group
            group = [(top, place[top])]
        last = head
        advance(top)
        node = (top + k) // 2
        while node:
            if not beats(top, losers[node]):
                top, losers[node] = losers[node], top
            node //= 2
    if group:
        yield last, group


PIECE = "block_id bigint, owner int, hot boolean, shared binary, rests binary, body binary, ids binary, counts binary"
NONE = (1 << 32) - 1


def _matrix(body: np.ndarray, *ranges: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Strings by row, filled up with zeros, and their sizes: the byte ranges (start, end) one after another;
    with more than one, the size of the last follows as a byte."""
    sizes = sum(end - start for start, end in ranges) + (len(ranges) > 1)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.uint8)
    at = np.zeros(len(sizes), np.int64)
    for start, end in ranges:
        size = end - start
        for k in range(int(size.max(initial=0))):
            some = np.flatnonzero(size > k)
            out[some, at[some] + k] = body[start[some] + k]
        at = at + size
    if len(ranges) > 1:
        out[np.arange(len(at)), at] = ranges[-1][1] - ranges[-1][0]
    return out, sizes


def _pieces(block_id: int, rows: np.ndarray, sizes: np.ndarray, owner: np.ndarray, hot: np.ndarray, same: np.ndarray, ids: np.ndarray) -> tuple[dict, list[np.ndarray]]:
    """A block's sorted, front-coded runs for their owners, and the instances that each run stands for.

    ``rows`` are distinct strings of ``sizes`` bytes; instance i, of document ids[i], is rows[same[i]].
    """
    out = {c: [] for c in ("block_id", "owner", "hot", "shared", "rests", "body", "ids", "counts")}
    members = []
    if not len(rows):
        return out, members
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    order = np.lexsort((sizes, *wide.view(">u8").T[::-1], hot, owner))
    rows, sizes, owner, hot = rows[order], sizes[order], owner[order], hot[order]
    differ = rows[1:] != rows[:-1]
    known = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    shared = np.append(0, np.minimum(known, np.minimum(sizes[1:], sizes[:-1])))
    cuts = np.append(np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (hot[1:] != hot[:-1]))), len(rows))
    shared[cuts[:-1]] = 0
    column = np.arange(rows.shape[1])
    body = rows[(column >= shared[:, None]) & (column < sizes[:, None])]
    rests = sizes - shared
    at = np.append(0, np.cumsum(rests))
    by = np.argsort(same, kind="stable")
    counts = np.bincount(same, minlength=len(rows))
    ends = np.cumsum(counts)
    least = np.minimum.reduceat(ids[by], ends - counts)[order]
    starts, counts = (ends - counts)[order], counts[order]
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        n = counts[a:b]
        members.append(by[np.repeat(starts[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        values = (
            block_id, int(owner[a]), bool(hot[a]), shared[a:b].astype(np.uint8).tobytes(), rests[a:b].astype(np.uint8).tobytes(),
            body[at[a] : at[b]].tobytes(), packed(least[a:b]), packed(n.astype(np.uint32)),
        )
        for c, v in zip(out, values):
            out[c].append(v)
    return out, members


ANSWER = "block_id bigint, owner int, hot boolean, least binary, totals binary, masks binary"


def _windows_of(strings: list[tuple[bytes, int]], length: int) -> list[int]:
    """For distinct strings of one anchor with their least documents: a bit for each window, from the
    first on, that starts in a smaller document too."""
    masks = [0] * len(strings)
    cut = [(s[: -1 - s[-1]], s[-1 - s[-1] : -1]) for s, _ in strings]
    if len(strings) <= FEW:
        # two strings share the windows that begin within their common left part and end within the right
        for i, (right, left) in enumerate(cut):
            for j in range(i):
                if strings[i][1] == strings[j][1]:
                    continue
                most = shared_prefix(left[::-1], cut[j][1][::-1])
                least = length - shared_prefix(right, cut[j][0])
                if least <= most:
                    k = i if strings[i][1] > strings[j][1] else j
                    masks[k] |= ((1 << (most - max(least, 0) + 1)) - 1) << (len(cut[k][1]) - most)
        return masks
    for back in range(max(len(left) for _, left in cut) + 1):
        least: dict[bytes, int] = {}
        found = []
        for i, (right, left) in enumerate(cut):
            if back <= len(left) and len(right) >= length - back:
                window = left[len(left) - back :] + right[: length - back]
                found.append((i, window))
                doc = strings[i][1]
                if doc < least.get(window, NO_ID + 1):
                    least[window] = doc
        for i, window in found:
            if least[window] < strings[i][1]:
                masks[i] |= 1 << (len(cut[i][1]) - back)
    return masks


def _merge_answers(length: int):
    def answers(batches):
        """Merge an owner's runs; tell each whether its document is the least, how often a string is
        there, and which windows of it a smaller document has."""
        kept: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            for row in batch.to_pylist():
                kept[row["hot"]].append((
                    row["block_id"], row["owner"], (row["shared"], row["rests"], row["body"]),
                    unpacked(row["ids"], "<i8").tolist(), unpacked(row["counts"], "<u4").tolist(),
                ))
        for hot, rows in kept.items():
            if rows:
                yield from _answers_of(rows, hot, length)

    return answers


def _answers_of(rows: list, hot: bool, length: int) -> Iterator[pa.RecordBatch]:
    runs, ids, counts = [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows]
    least = [bytearray(len(x)) for x in ids]
    totals = [np.zeros(len(x), np.uint32) for x in ids]
    masks = [np.zeros(len(x), np.uint64) for x in ids]
    anchor, same = b"", []

    def look_up() -> None:
        if len(same) > 1:
            for mask, (_, doc, group) in zip(_windows_of([x[:2] for x in same], length), same):
                if mask:
                    for r, i in group:
                        if ids[r][i] == doc:
                            masks[r][i] = mask

    for head, group in merge_runs(runs):
        best, total = min(ids[r][i] for r, i in group), sum(counts[r][i] for r, i in group)
        for r, i in group:
            least[r][i] = ids[r][i] == best
            totals[r][i] = min(total, NONE)
        if not hot:
            if head[:ANCHOR] != anchor:
                look_up()
                anchor, same = head[:ANCHOR], []
            same.append((head, best, group))
    look_up()
    for row, a, b, c in zip(rows, least, totals, masks):
        yield pa.RecordBatch.from_pydict({
            "block_id": pa.array([row[0]], pa.int64()), "owner": pa.array([row[1]], pa.int32()), "hot": pa.array([hot]),
            "least": pa.array([bytes(a)], pa.binary()), "totals": pa.array([packed(b)], pa.binary()), "masks": pa.array([packed(c)], pa.binary()),
        })


# --- anchors -----------------------------------------------------------------------------------


class Anchors:
    """The anchors of a block: place, first and last window, document row, hash, hash of the string."""

    def __init__(self, body: np.ndarray, lengths: np.ndarray, length: int, at_once: int = HASH_BYTES):
        found = []
        ends = np.cumsum(lengths)
        a = 0
        while a < len(lengths):
            start = int(ends[a] - lengths[a])
            b = max(a + 1, int(np.searchsorted(ends, start + at_once, "right")))
            part = self._of(body[start : ends[b - 1]], lengths[a:b], length)
            found.append([part[0] + start, part[1] + start, part[2] + start, part[3] + a, *part[4:]])
            a = b
        none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
        self.place, self.first, self.last, self.row, self.hash, self.string = (np.concatenate(x) for x in zip(none, *found))

    @staticmethod
    def _of(body: np.ndarray, lengths: np.ndarray, length: int) -> list[np.ndarray]:
        ends = np.cumsum(lengths)
        starts = ends - lengths
        long = lengths >= length
        if not long.any():
            return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
        n, width = len(body), length - ANCHOR + 1
        roll = hashing.Rolling(body)
        h = hashing.mix((roll.sums[ANCHOR:] - roll.sums[:-ANCHOR]) * roll.back[: n - ANCHOR + 1])
        key = h & np.uint64(0xFFFFFFFF00000000)
        key |= np.arange(len(key), dtype=np.uint64)
        step = 1
        while 2 * step <= width:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if width > step:
            key = np.minimum(key[: step - width], key[width - step :])
        marks = np.zeros(n + 1, np.int8)
        marks[starts[long]] += 1
        marks[ends[long] - length + 1] -= 1
        window = np.flatnonzero(np.cumsum(marks[:-1], dtype=np.int8) > 0)
        place = (key[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.diff(place, prepend=-1))
        place, first = place[cut], window[cut]
        last = window[np.append(cut[1:], len(window)) - 1]
        string = hashing.mix(roll(place, last + length) + roll(first, place) * np.uint64(hashing.FACTOR))
        # empty documents share the start of the next one
        return [place, first, last, np.searchsorted(starts, first, "right") - 1, h[place] >> np.uint64(64 - BITS), string]


def _blocks(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i] for c in batch.schema.names}
        body = np.frombuffer(row["body"].as_buffer(), np.uint8) if len(row["body"].as_buffer()) else np.zeros(0, np.uint8)
        yield row, body, np.frombuffer(row["lengths"].as_py(), np.int64), np.frombuffer(row["ids"].as_py(), np.int64)


CODES = "block_id bigint, owner int, low bigint, code binary, counts binary"


def hash_codes(block_id: int, owners: int, found: np.ndarray) -> pa.RecordBatch:
    """A block's distinct hashes with their counts, Golomb-Rice coded for their owners."""
    hashes, counts = np.unique(found, return_counts=True)
    parts = hashing.split_by_owner(hashes, owners, BITS)
    return pa.RecordBatch.from_pydict({
        "block_id": pa.array([block_id] * len(parts), pa.int64()), "owner": pa.array([p[0] for p in parts], pa.int32()),
        "low": pa.array([p[3] for p in parts], pa.int64()),
        "code": pa.array([hashing.rice_encode(hashes[a:b], low) for _, a, b, low in parts], pa.binary()),
        "counts": pa.array([packed(counts[a:b].astype(np.uint32)) for _, a, b, _ in parts], pa.binary()),
    })


def _anchor_codes(owners: int, length: int):
    def codes(batches):
        for batch in batches:
            for row, body, lengths, _ in _blocks(batch):
                yield hash_codes(row["block_id"].as_py(), owners, Anchors(body, lengths, length).hash)

    return codes


def add_up(batches):
    """An owner's answer to each block: how often every hash of it occurs in all blocks."""
    keys, hashes, counts = [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            keys.append((row["block_id"], row["owner"]))
            hashes.append(hashing.rice_decode(row["code"], row["low"]))
            counts.append(unpacked(row["counts"], "<u4"))
    if not keys:
        return
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    new = np.flatnonzero(np.diff(ordered, prepend=ordered[0] ^ np.uint64(1)))
    sums = np.add.reduceat(np.concatenate(counts)[order].astype(np.uint64), new)
    totals = np.empty(len(every), np.uint32)
    totals[order] = np.minimum(np.repeat(sums, np.diff(np.append(new, len(every)))), 0xFFFFFFFF)
    at = 0
    for key, x in zip(keys, hashes):
        yield pa.RecordBatch.from_pydict({
            "block_id": pa.array([key[0]], pa.int64()), "owner": pa.array([key[1]], pa.int32()),
            "reply": pa.array([packed(totals[at : at + len(x)])], pa.binary()),
        })
        at += len(x)


def replies_of(row: dict, kind: str) -> np.ndarray:
    """A block's answers, in the order of its sorted hashes."""
    found = row["replies"].as_py() or []
    return np.concatenate([np.zeros(0, kind), *(unpacked(r["reply"], kind) for r in found)])


STRINGS = PIECE + ", first binary, reach binary, doc_row binary, later binary, hash_totals binary"


def _anchor_strings(owners: int, length: int, hot: int):
    def strings(batches):
        for batch in batches:
            for row, body, lengths, ids in _blocks(batch):
                anchors = Anchors(body, lengths, length)
                hashes, inverse = np.unique(anchors.hash, return_inverse=True)
                totals = replies_of(row, "<u4")[inverse]
                again = np.flatnonzero(totals > 1)
                first, last, doc = anchors.first[again], anchors.last[again], anchors.row[again]
                _, one, same = np.unique(anchors.string[again], return_index=True, return_inverse=True)
                place, many = anchors.place[again], totals[again][one] > hot
                found = _matrix(body, (place[one], last[one] + length), (first[one], place[one]))
                owner = np.where(many, anchors.string[again][one], anchors.hash[again][one]) % np.uint64(owners)
                out, members = _pieces(row["block_id"].as_py(), *found, owner.astype(np.int32), many, same, ids[doc])
                out |= {c: [] for c in ("first", "reach", "doc_row", "later", "hash_totals")}
                for at, least, counts in zip(members, out["ids"], out["counts"]):
                    own = np.repeat(unpacked(least, "<i8"), unpacked(counts, "<u4"))
                    out["first"].append(first[at].astype(np.uint32).tobytes())
                    out["reach"].append((last[at] - first[at]).astype(np.uint8).tobytes())
                    out["doc_row"].append(doc[at].astype(np.uint32).tobytes())
                    out["later"].append(np.packbits(ids[doc[at]] > own).tobytes())
                    out["hash_totals"].append(packed(totals[again][at]))
                yield _batch(out, STRINGS)

    return strings


def _batch(columns: dict, schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in fields], [n for n, _ in fields])


VERDICT = "block_id bigint, owner int, gone binary, open binary"


def _ranges(first: np.ndarray, masks: np.ndarray, length: int) -> np.ndarray:
    """Byte ranges of the windows whose bits are set, a range for each run of bits."""
    some = np.flatnonzero(masks)
    bits = np.unpackbits(masks[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8)
    edges = np.diff(bits, axis=1, prepend=0, append=0)
    row, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    at = first[some][row]
    return np.stack([at + start, at + end - 1 + length], 1)


def _anchor_verdicts(length: int):
    def verdicts(batches):
        """Byte ranges that go, and windows that need a look of their own: (first, last, document row)."""
        for batch in batches:
            out = {c: [] for c in ("block_id", "owner", "gone", "open")}
            for row in batch.to_pylist():
                counts = unpacked(row["counts"], "<u4")
                first, reach = np.frombuffer(row["first"], "<u4").astype(np.int64), np.frombuffer(row["reach"], np.uint8)
                doc, later = np.frombuffer(row["doc_row"], "<u4"), np.unpackbits(np.frombuffer(row["later"], np.uint8), count=len(first)).astype(bool)
                gone = later | ~np.repeat(np.frombuffer(row["least"], np.uint8).astype(bool), counts)
                masks = np.where(gone, np.uint64(0), np.repeat(unpacked(row["masks"], "<u8"), counts))
                unsure = ~gone & (np.repeat(unpacked(row["totals"], "<u4"), counts) != unpacked(row["hash_totals"], "<u4")) & row["hot"]
                whole = np.stack([first, first + reach + length], 1)[gone]
                out["block_id"].append(row["block_id"])
                out["owner"].append(row["owner"])
                out["gone"].append(np.concatenate([whole, _ranges(first, masks, length)]).astype(np.uint32).tobytes())
                out["open"].append(np.stack([first, first + reach, doc], 1)[unsure].astype(np.uint32).tobytes())
            yield _batch(out, VERDICT)

    return verdicts


WINDOWS = PIECE + ", first binary, later binary"


def _range_hashes(body: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows that start at ``first``."""
    order = np.argsort(first)
    out = np.empty(len(first), np.uint64)
    a = 0
    while a < len(order):
        start = int(first[order[a]])
        b = int(np.searchsorted(first[order], start + HASH_BYTES, "right"))
        some = first[order[a:b]] - start
        out[order[a:b]] = hashing.Rolling(body[start : start + int(some[-1]) + length])(some, some + length)
        a = b
    return out


def _open_windows(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Starts and document rows of a block's open windows."""
    ranges = np.concatenate([np.frombuffer(r["reply"], "<u4").astype(np.int64).reshape(-1, 3) for r in row["open"].as_py()])
    size = ranges[:, 1] - ranges[:, 0] + 1
    first = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ranges[:, 0], size)
    return first, np.repeat(ranges[:, 2], size)


def _window_codes(owners: int, length: int):
    def codes(batches):
        for batch in batches:
            for row, body, _, _ in _blocks(batch):
                first, _ = _open_windows(row)
                yield hash_codes(row["block_id"].as_py(), owners, _range_hashes(body, first, length) >> np.uint64(64 - BITS))

    return codes


def _window_strings(owners: int, length: int):
    def strings(batches):
        for batch in batches:
            for row, body, _, ids in _blocks(batch):
                first, doc = _open_windows(row)
                whole = _range_hashes(body, first, length)
                _, inverse = np.unique(whole >> np.uint64(64 - BITS), return_inverse=True)
                again = replies_of(row, "<u4")[inverse] > 1
                first, doc = first[again], doc[again]
                _, one, same = np.unique(whole[again], return_index=True, return_inverse=True)
                owner = (whole[again][one] % np.uint64(owners)).astype(np.int32)
                out, members = _pieces(row["block_id"].as_py(), *_matrix(body, (first[one], first[one] + length)), owner, np.ones(len(one), bool), same, ids[doc])
                out |= {"first": [], "later": []}
                for at, least, counts in zip(members, out["ids"], out["counts"]):
                    own = np.repeat(unpacked(least, "<i8"), unpacked(counts, "<u4"))
                    out["first"].append(first[at].astype(np.uint32).tobytes())
                    out["later"].append(np.packbits(ids[doc[at]] > own).tobytes())
                yield _batch(out, WINDOWS)

    return strings


def _window_verdicts(length: int):
    def verdicts(batches):
        for batch in batches:
            out = {c: [] for c in ("block_id", "owner", "gone")}
            for row in batch.to_pylist():
                first = np.frombuffer(row["first"], "<u4").astype(np.int64)
                later = np.unpackbits(np.frombuffer(row["later"], np.uint8), count=len(first)).astype(bool)
                gone = later | ~np.repeat(np.frombuffer(row["least"], np.uint8).astype(bool), unpacked(row["counts"], "<u4"))
                out["block_id"].append(row["block_id"])
                out["owner"].append(row["owner"])
                out["gone"].append(np.stack([first, first + length], 1)[gone].astype(np.uint32).tobytes())
            yield _batch(out, "block_id bigint, owner int, gone binary")

    return verdicts


SPANS = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _removals(batches):
    """Each document's maximal removed runs, in bytes of its text, and the bytes that stay."""
    for batch in batches:
        for row, body, lengths, ids in _blocks(batch):
            marks = np.zeros(len(body) + 1, np.int32)
            for r in row["replies"].as_py() or []:
                ranges = np.frombuffer(r["reply"], "<u4").reshape(-1, 2)
                np.add.at(marks, ranges[:, 0], 1)
                np.add.at(marks, ranges[:, 1], -1)
            gone = np.cumsum(marks, out=marks)[:-1] > 0
            spans, kept, removed = [], [], []
            end = 0
            for size in lengths.tolist():
                start, end = end, end + size
                mine = gone[start:end]
                kept.append(body[start:end][~mine].tobytes())
                removed.append(int(np.count_nonzero(mine)))
                edges = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).reshape(-1, 2) if removed[-1] else []
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges])
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if x == NO_ID else x for x in ids.tolist()], pa.int64()), pa.array(lengths, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end in bytes), kept (the bytes that stay) of every document."""
    if not ANCHOR + 1 < length <= ANCHOR + 63:
        raise ValueError(f"a string has from {ANCHOR + 2} to {ANCHOR + 63} bytes")
    n = partitions(docs.sparkSession)
    blocks = bucketed(pack_blocks(docs, block_bytes), "suffix_blocks")

    def totals(codes: DataFrame) -> DataFrame:
        return codes.repartitionById(n, "owner").transform(map_arrow, add_up, "block_id bigint, owner int, reply binary")

    def merged(runs: DataFrame) -> DataFrame:
        answers = runs.select("block_id", "owner", "hot", "shared", "rests", "body", "ids", "counts").repartitionById(n, "owner").transform(map_arrow, _merge_answers(length), ANSWER)
        return runs.drop("shared", "rests", "body", "ids").join(answers, ["block_id", "owner", "hot"])

    anchors = totals(blocks.select("block_id", "ids", "lengths", "body").transform(map_arrow, _anchor_codes(n, length), CODES))
    strings = materialise(with_replies(blocks, anchors).transform(map_arrow, _anchor_strings(n, length, hot), STRINGS), "suffix-strings")
    verdicts = materialise(merged(strings).transform(map_arrow, _anchor_verdicts(length), VERDICT), "suffix-verdicts")
    gone = verdicts.select("block_id", "owner", "gone")
    left = verdicts.where(F.octet_length("open") > 0).select("block_id", F.struct("owner", F.col("open").alias("reply")).alias("open"))
    if not left.isEmpty():
        opened = blocks.join(left.groupBy("block_id").agg(F.collect_list("open").alias("open")).hint("shuffle_hash"), "block_id")
        counted = totals(opened.transform(map_arrow, _window_codes(n, length), CODES))
        windows = materialise(with_replies(opened, counted).transform(map_arrow, _window_strings(n, length), WINDOWS), "suffix-windows")
        gone = gone.unionByName(merged(windows).transform(map_arrow, _window_verdicts(length), "block_id bigint, owner int, gone binary"))
    gone = gone.where(F.octet_length("gone") > 0).select("block_id", "owner", F.col("gone").alias("reply"))
    return with_replies(blocks, gone).transform(map_arrow, _removals, SPANS)
