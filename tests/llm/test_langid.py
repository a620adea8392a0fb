import zlib

import numpy as np
import pytest

from feedlake.llm import langid as L
from feedlake.llm.registry import op4_langid

SF = "/root/testdata/sf0.01"


def test_counts_against_a_plain_walk():
    texts = ["Ab c!", "", "éa", " x  y ", "?!"]
    bodies = [t.encode() for t in texts]
    got = L.counts(np.frombuffer(b"".join(bodies), np.uint8), np.array([len(b) for b in bodies]))
    for row, b in zip(got, bodies):
        shown = b" " + bytes(32 if L.NO_WORD[x] else int(L.LOWER[x]) for x in b) + b" "
        want = np.zeros(L.DIM, int)
        for i in range(1, len(shown) - 1):
            if shown[i] != 32:
                code = shown[i - 1] << 16 | shown[i] << 8 | shown[i + 1]
                want[(code * 2654435761 % 2**32) >> (32 - L.BITS)] += 1
        assert row.tolist() == want.tolist()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    stems = {"aa": ["kala", "talo", "vesi", "puu"], "bb": ["house", "water", "wood", "fishy"]}
    return [(i, " ".join(rng.choice(stems[lang], 20)), lang) for i in range(200) for lang in [("aa", "bb")[i % 2]]]


def test_odd_rows(spark, rows):
    extra = [(None, "kala talo", None), (900, None, "aa"), (901, "", "bb"), (902, "123 !!", "aa"), (903, "数", None), (904, "puu " * 60_000, None), (905, "house", None), (905, "house", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id bigint, text string, lang string, score string")
    got = L.languages(df).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert by[None].lang_pred == "aa" and by[904].lang_pred == "aa" and by[905].lang_pred == "bb"
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and [by[i].score for i in (900, 901, 902)] == [0.0] * 3
    assert by[903].lang_pred in ("aa", "bb") and by[903].rejected
    assert {r.doc_id: r.lang_pred for r in L.languages(df, reject=True).collect()}[903] == "und"
    assert all(by[i].lang_pred == lang for i, _, lang in rows)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "kala", None), (2, None, "aa")], "doc_id bigint, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.languages(df).collect()] == [("und", 0.0)] * 2
    assert L.languages(df.limit(0)).collect() == []


def test_several_centroids_per_language():
    rng = np.random.default_rng(3)
    points = np.concatenate([np.eye(5)[i] + rng.random((30, 5)) * 0.1 for i in range(3)]).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    found = L.k_means(points, 3)
    assert sorted(found.argmax(axis=1).tolist()) == [0, 1, 2]


def test_query_on_held_out_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op4_langid(spark, SF).collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]) > 0.97


def test_a_sample_under_a_millionth(spark):
    known = spark.range(1_000_001).selectExpr("id as doc_id", "'kala talo' as text", "'aa' as lang")
    assert L.learn(known, clusters=1, sample=1)["languages"] == ["aa"]


def test_the_least_hashes_of_each_language(spark):
    rows = [("aa", h) for h in (*range(50), *range(-50, 0), 7 << 40)] + [("bb", -5)] * 90 + [("cc", 3), ("cc", -1)]
    shift, top = L.least_hashes(spark.createDataFrame(rows, "lang string, hash bigint"), ["aa", "bb", "cc"], 10)
    up_to = {lang: sorted(h % 2**64 for x, h in rows if x == lang and (h % 2**64) >> shift <= top[lang]) for lang in top}
    assert up_to["aa"] == list(range(len(up_to["aa"]))) and 10 <= len(up_to["aa"]) <= 20
    assert len(up_to["bb"]) == 90 and len(up_to["cc"]) == 2
