import hashlib

import numpy as np
import pytest

from feedlake.llm import exact_dedup, hashing
from feedlake.llm.exact_dedup import exact_groups

SCHEMA = "doc_id bigint, text string, row_id int, sha string"


def brute(rows):
    strip = str.maketrans("", "", " \t\n\x0b\x0c\r")
    groups = {}
    for i, (doc_id, text, *_) in enumerate(rows):
        groups.setdefault((text or "").translate(strip), []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for normal, members in groups.items():
        keep = min(members)
        for m in members:
            out.append((None if m[1] else m[2], None if keep[1] else keep[2], len(members), m == keep, hashlib.sha256(normal.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_of_odd_rows(spark):
    rows = [
        (1, "a b", 9, "x"), (2, "ab", 9, "x"), (3, "a\x0bb ", 9, "x"), (4, None, 9, None), (5, "", 9, "x"), (6, " \r\n\t", 9, "x"),
        (None, "long " * 50_000, 9, "x"), (8, "long" * 50_000, 9, "x"), (9, "a b", 9, "x"), (10, "é A", 9, "x"), (10, "zz", 9, "x"),
    ]
    got = exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_repeated_rows_keep_one(spark):
    rows = [(7, "same", 1, "x")] * 40 + [(3, "other", 1, "x")]
    got = exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.kept for r in got if r.doc_id == 7) == 1
    assert {r.group_size for r in got if r.doc_id == 7} == {40}


def test_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n,bits", [(1, 64), (2, 8), (5000, 64), (5000, 48), (3000, 10)])
def test_rice_codes_round_trip(n, bits):
    values = np.sort(np.random.default_rng(n).integers(0, 2**bits, n, dtype=np.uint64, endpoint=False) if bits < 64 else np.random.default_rng(n).integers(0, 2**64 - 1, n, dtype=np.uint64))
    got = [hashing.rice_decode(hashing.rice_encode(values[a:b], low), low) for _, a, b, low in hashing.split_by_owner(values, 7, bits)]
    assert np.array_equal(np.concatenate(got), values)


def test_a_code_is_near_the_bound():
    values = np.sort(np.random.default_rng(1).integers(0, 2**48, 100_000, dtype=np.uint64))
    assert len(hashing.rice_encode(values, 0)) * 8 / 100_000 < 48 - np.log2(100_000) + 2.3


def test_only_suspects_texts_are_written(spark, monkeypatch):
    """Texts of rows without a twin stay where they are."""
    written = {}
    inside = exact_dedup.materialise

    def counted(df, label):
        out = inside(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(exact_dedup, "materialise", counted)
    rows = [(i, f"text number {i // 2 if i < 40 else i}", 1, "x") for i in range(2000)]
    got = exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    assert 40 <= written["exact-texts"] < 60
