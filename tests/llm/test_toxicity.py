import zlib

import numpy as np
import pytest

from feedlake.llm import toxicity as T
from feedlake.llm.registry import op1_toxicity

SF = "/root/testdata/sf0.01"


def sentences(rng, n, words):
    return " ".join(rng.choice(words, n))


@pytest.fixture(scope="module")
def toy():
    rng = np.random.default_rng(0)
    words = ["mild%d" % i for i in range(300)]
    clean = [sentences(rng, rng.integers(5, 200), words) for _ in range(120)]
    toxic = []
    for _ in range(120):
        w = sentences(rng, rng.integers(5, 200), words).split()
        for _ in range(3):
            w.insert(int(rng.integers(len(w) + 1)), rng.choice(["vileness", "vilely", "Vilest!"]))
        toxic.append(" ".join(w))
    return clean, toxic, T.train(clean + toxic, [0] * 120 + [1] * 120, rounds=6)


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    texts = ["alpha beta gamma alpha", "delta beta"]
    body = np.frombuffer("".join(texts).encode(), np.uint8)
    words = T.Words(body, np.array([len(t) for t in texts]))
    windows, _ = words.windows(2)
    seen, labels = words.matrix(windows), np.array([1, 0], np.float32)
    model = T.fresh(rng)
    model = {k: v.astype(np.float64) for k, v in model.items()}

    def loss():
        states = np.concatenate([T.unroll(model, T.gates(model, T.inputs(model, words), s), seen, s) for s in "fb"], axis=2)
        p = T.sigmoid(T.pooled(model, states, seen.T == len(words.word_row))[1] @ model["out"] + model["out_bias"])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grad = T.gradients(model, words, seen, labels, np.ones(2, np.float32))
    for k in ("in_f", "state_b", "bias_f", "attend", "out"):
        at = np.unravel_index(int(np.abs(grad[k]).argmax()), grad[k].shape)
        old = model[k][at]
        model[k][at] = old + 1e-2
        up = loss()
        model[k][at] = old - 1e-2
        down = loss()
        model[k][at] = old
        assert grad[k][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4)


def test_unseen_forms_of_a_stem(spark, toy):
    clean, toxic, model = toy
    rows = [(i, t, "x") for i, t in enumerate(["mild1 mild2 vilenesses mild3 " * 1, " ".join(clean[:50]) + " vilest " + " ".join(clean[50:100]), " ".join(clean), "", None, "!?", "mild9"])]
    rows.append((None, "mild7 vileness mild8", None))
    got = {r.doc_id: r for r in T.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string, score string"), model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].score >= 0.5 for i in (0, 1, 2, 6, None)] == [True, True, False, False, True]
    assert [got[i].score for i in (3, 4, 5)] == [0.0, 0.0, 0.0]
    assert "vilest" in rows[1][1][got[1].start : got[1].end]


def test_every_window_is_scored(toy):
    clean, _, model = toy
    body = " ".join(clean).encode()
    words = T.Words(np.frombuffer(body, np.uint8), np.array([len(body)]))
    windows, _ = words.windows(1)
    assert windows[0, 0] == 0 and windows[-1].sum() == len(words.word)
    assert (np.diff(windows[:, 0]) == T.STEP).all() and (windows[:-1, 1] == T.WINDOW).all()


def test_no_or_one_label(spark):
    docs = spark.createDataFrame([(i, "some words here", "x") for i in range(9)], "doc_id bigint, text string, toxic string")
    for labels, score in (([], 0.0), ([(i, 0) for i in range(9)], 0.0), ([(i, 1) for i in range(9)], 1.0), ([(1, None), (None, 1)], 0.0)):
        rows = T.toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
        assert len(rows) == 9 and {r.score for r in rows} == {score} and {r.predicted for r in rows} == {int(score)}
    assert T.toxicity(docs.limit(0), spark.createDataFrame([], "doc_id bigint, toxic int")).collect() == []


def test_query_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op1_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    kept = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in kept]) > 0.9
