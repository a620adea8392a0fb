import hashlib
import random
import zlib

import duckdb
import pyarrow as pa
import pytest

from feedlake.llm import oracle, prefix_trie
from feedlake.llm.registry import op11_prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, box string"


def reference(rows):
    """Nodes by every prefix of every rebuilt conversation."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    children, out = {}, {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        below = [out[q] for q in children.get(p, [])]
        n = len(members[p])
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out[p] = (
            min(members[p]), len(p), min(members[p[:-1]]) if p else None, n, len(below), sum(r[5] for r in below) or 1,
            sum(r[6] for r in below) + (n - 1) * (len(p[-1][1]) if p else 0), digest,
        )
    return sorted(out.values(), key=repr)


def answer(spark, rows, limit=prefix_trie.LIMIT):
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    got = prefix_trie.trie(frame, limit).collect()
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends.hex() if r.ends else empty) for r in got), key=repr)


def grown(seed, convs, shapes):
    """Conversations that share openings, with copies, gaps, absent bases and odd turns."""
    rng = random.Random(seed)
    words = [f"w{i}" * (i % 4) for i in range(shapes)]
    rows = []
    for c in rng.sample(range(0, 40 * convs), convs) + [0, 100]:
        length = rng.choice([1, 2, 3, 5, 9])
        for i in range(length):
            word = words[0] if rng.random() < 0.6 else rng.choice(words)
            rows.append((c, i, "ab"[i % 2], word))
    return rows


@pytest.mark.parametrize("limit", [1, 3, 256])
def test_against_every_prefix(spark, limit):
    rows = grown(1, 60, 5)
    assert answer(spark, rows, limit) == reference(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "nobody's"), (None, None, None, None), (1, None, "user", "first"), (1, 3, None, None), (1, 3, None, None), (1, -2, "", "é\U0001f600"), (1, 9, "user", None),
        (100, 0, "user", "base"), (101, 0, "x", "a"), (102, 0, "x", "a"), (102, 1, "y", "b" * 70_000), (103, 0, "x", "a"), (-5, 1, "user", "below nought"), (2**62, 0, "user", "large"),
        (7, 0, "1:", "x"), (8, 0, "", "1:x"), (9, 0, "1", ":x"),
    ]
    for limit in (1, 256):
        assert answer(spark, rows, limit) == reference([r for r in rows if r[0] is None or r[0] >= 0] + [r for r in rows if r[0] is not None and r[0] < 0])


def test_copies_and_a_long_opening(spark, monkeypatch):
    """Many copies end at one node, and many long conversations share all but their last turns."""
    monkeypatch.setattr(prefix_trie, "PACK", 7)
    rows = [(c * 100, i, "user", f"t{i}") for c in range(150) for i in range(3)]
    rows += [(50_000 + c * 100, i, "user", f"t{i}" if i < 30 else f"t{i}-{c // 2 ** (i - 30)}") for c in range(40) for i in range(34)]
    rows += [(90_000 + c * 100, i, "user", f"t{i}") for c in range(20) for i in range(31)]
    assert answer(spark, rows, 4) == reference(rows)


def test_one_conversation_and_none(spark):
    assert answer(spark, []) == [] and answer(spark, [(None, 1, "user", "x")]) == []
    for rows in ([(0, 0, "user", "x")], [(3, 0, "user", "x")], [(0, i, "user", "x") for i in range(2000)]):
        assert answer(spark, rows) == reference(rows)


def test_sweep_keeps_few_nodes_waiting():
    """Nodes of a closed subtree leave at once, whatever its depth."""
    state = prefix_trie.Sweep()
    turn = lambda i: hashlib.sha256(str(i).encode()).digest()[:16] + (1).to_bytes(4, "big")
    top = turn("top")
    strings = sorted(top + (b"".join(turn((c, i)) for i in range(500)) if c % 2 else turn(c)) for c in range(20))
    for c, seq in enumerate(strings):
        state.add(b"b", b"", 1, None, seq, c, 1, b"e")
        assert sum(len(n.closed) for n in state.stack) <= 20
    assert len(state.out) > 4000
    state.end_box()
    assert len(state.out) == 1 + 10 * 500 + 10


def test_query_against_sql(spark, tmp_path):
    rows = grown(2, 200, 9) + [(None, 1, "user", "x"), (5, None, None, None)]
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.register("conversations", pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))}))
    got = op11_prefix_trie(spark, str(tmp_path))
    rel = con.sql(oracle.SQL["op11_prefix_trie"]).select(*got.columns)
    want = sorted(rel.fetchall(), key=repr)
    mine = sorted(map(tuple, got.collect()), key=repr)
    assert mine == want == reference(rows)
