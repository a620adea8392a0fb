import hashlib
import os
import random

import numpy as np

from feedlake.llm import suffix_dedup as S
from feedlake.llm.registry import op2_suffix_dedup


def brute(rows, length=50):
    first = {}
    for doc_id, text in rows:
        b = (text or "").encode()
        key = float("inf") if doc_id is None else doc_id
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, key), key)
    out = []
    for doc_id, text in rows:
        b = (text or "").encode()
        key = float("inf") if doc_id is None else doc_id
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < key:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()), key=repr)


def front_code(strings):
    """Shared prefix lengths, lengths of the rests, and the rests of a sorted run."""
    shared, rests, last = [], [], b""
    for s in strings:
        shared.append(len(os.path.commonprefix([last, s])))
        rests.append(s[shared[-1] :])
        last = s
    return bytes(shared), bytes(map(len, rests)), b"".join(rests)


def test_pieces_are_front_coded_sorted_runs():
    rnd = random.Random(3)
    strings = sorted({bytes(rnd.choices(b"\0ab", k=rnd.randint(1, 12))) for _ in range(300)})
    rnd.shuffle(strings)
    rows = np.zeros((len(strings), 12), np.uint8)
    for row, s in zip(rows, strings):
        row[: len(s)] = list(s)
    owner = np.array([len(s) % 3 for s in strings], np.int32)
    same = np.array([i % len(strings) for i in range(450)])
    out, members = S._pieces(1, rows, np.array([len(s) for s in strings]), owner, owner == 1, same, np.arange(450) + 7)
    for k, o in enumerate(out["owner"]):
        run = sorted(s for s in strings if len(s) % 3 == o)
        assert (out["shared"][k], out["rests"][k], out["body"][k]) == front_code(run)
        assert S.unpacked(out["ids"][k], "<i8").tolist() == [strings.index(s) + 7 for s in run]
        assert [strings[same[i]] for i in members[k]] == [s for s, n in zip(run, S.unpacked(out["counts"][k], "<u4")) for _ in range(n)]


def test_merge_of_front_coded_runs():
    rnd = random.Random(5)
    for k in (1, 2, 3, 7, 20):
        runs = [sorted({bytes(rnd.choices(b"ab", k=rnd.randint(0, 9))) for _ in range(rnd.randint(0, 60))}) for _ in range(k)]
        got = list(S.merge_runs([front_code(r) for r in runs]))
        assert [s for s, _ in got] == sorted({s for r in runs for s in r})
        for s, places in got:
            assert sorted(places) == [(r, runs[r].index(s)) for r in range(k) if s in runs[r]]


def test_odd_rows_against_brute_force(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abcdeéß", k=rnd.randint(1, 8))) for _ in range(60)]
    passage = " ".join(rnd.choices(words, k=40))
    rows = []
    for i in range(120):
        text = " ".join(rnd.choices(words, k=rnd.randint(0, 60)))
        if i % 3 == 0:
            text += passage[rnd.randint(0, 30) : -rnd.randint(1, 30)] + " ".join(rnd.choices(words, k=9))
        if i % 10 == 1:
            text = rows[rnd.randrange(len(rows))][1] or ""
            cut = rnd.randint(0, len(text))
            text = text[:cut] + "x" + text[cut:]
        rows.append((i // 2 * 3 if i % 7 else i, text))
    rows += [(500, "a" * 300), (501, "a" * 49), (502, "a" * 50), (503, "ab" * 200), (504, "ba" * 200), (None, "a" * 70), (None, None), (505, ""), (506, None), (507, passage), (508, passage), (508, passage)]
    rows += [(600, passage * 300)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, body int, ids string")
    for block_bytes, hot in ((700, S.HOT), (3 << 20, S.HOT), (2000, 3), (3 << 20, 1)):
        assert digest(S.remove_repeats(df, block_bytes=block_bytes, hot=hot)) == brute(rows)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(os.path.join(sf, "documents.parquet")).collect()]
    assert sorted((tuple(r) for r in op2_suffix_dedup(spark, sf).collect()), key=repr) == brute(rows)
