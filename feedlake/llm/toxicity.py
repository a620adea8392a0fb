"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is its own vector beside the mean of its character trigrams' vectors, both from hashed
tables, so unseen spellings of a known stem are near it.  A gated recurrent unit reads each window of
``WINDOW`` words forwards and another backwards; attention weighs the states of all places; a logistic
unit scores what they add up to.  Windows overlap by half and cover the whole text.  A document scores
as its worst window.

The network is trained here, in numpy, on a bounded sample of labelled rows: at most ``sample`` rows of
each label, the least by a hash of doc_id, of texts of at most ``longest`` characters.  Scoring covers
all rows and whole texts.  Labels say nothing about places, so after a first round over windows of all
kinds only the two worst windows of a toxic document count as toxic, while every window of a clean one
is clean; clean windows that score high are shown again.  Last, the output's offset is set so that one
half lies between the sample's toxic and clean documents.

A text without a word scores 0.  Without a toxic label everything scores 0, without a clean one 1.  A
null text is empty; a null doc_id is held out as the empty text would be; repeated rows are scored each;
contradicting labels of an id count as toxic; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm import hashing
from feedlake.llm.shared import map_arrow
from feedlake.llm.words import LOWER, parts, spans

WINDOW, STEP = 24, 12
HIDDEN = 8
WORD_ROWS, WORD_DIM = 1 << 13, 6
CHAR_ROWS, CHAR_DIM = 1 << 13, 12
SAMPLE, LONGEST = 1000, 10_000
PART_BYTES = 1 << 20
WINDOWS_AT_ONCE = 2048
HELD_OUT_OF = 5


class Words:
    """The words of a block: for each distinct one its table rows, for each place its distinct word."""

    def __init__(self, body: np.ndarray, lengths: np.ndarray):
        low = LOWER[body]
        first, last, self.row = spans(low, lengths)
        self.first, self.last = first, last
        hashes, at, self.word = np.unique(hashing.Rolling(low)(first, last), return_index=True, return_inverse=True)
        self.word_row = (hashes % np.uint64(WORD_ROWS)).astype(np.int64)
        # trigrams of the word between two marks: as many as it has bytes
        size = (last - first)[at]
        start = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(start, size)
        here = np.repeat(first[at], size) + place
        end = np.repeat(size, size) - 1
        left = np.where(place > 0, low[np.maximum(here - 1, 0)], 1).astype(np.uint64)
        right = np.where(place < end, low[np.minimum(here + 1, max(len(low) - 1, 0))], 2).astype(np.uint64)
        gram = (left << np.uint64(16)) | (low[here].astype(np.uint64) << np.uint64(8)) | right
        self.gram_row = (hashing.mix(gram) % np.uint64(CHAR_ROWS)).astype(np.int64)
        self.gram_start, self.gram_count = start, size

    def windows(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of every window, and the document row of each."""
        cuts = np.searchsorted(self.row, np.arange(rows + 1))
        n = np.diff(cuts)
        count = np.where(n > WINDOW, -(-(n - WINDOW) // STEP) + 1, (n > 0).astype(np.int64))
        doc = np.repeat(np.arange(rows), count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        first = cuts[doc] + nth * STEP
        return np.stack([first, np.minimum(cuts[doc + 1] - first, WINDOW)], 1), doc

    def matrix(self, windows: np.ndarray) -> np.ndarray:
        """Distinct words of windows, by place; past a window's end the number of distinct words."""
        place = np.arange(WINDOW)
        at = windows[:, :1] + place
        inside = place < windows[:, 1:]
        return np.where(inside, self.word[np.minimum(at, len(self.word) - 1)], len(self.word_row))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


def inputs(model: dict, words: Words, chosen: np.ndarray | None = None) -> np.ndarray:
    """Input vectors of the distinct words."""
    rows, grams, start, count = words.word_row, words.gram_row, words.gram_start, words.gram_count
    if chosen is not None:
        rows, count = rows[chosen], count[chosen]
        grams = grams[np.repeat(start[chosen], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        start = np.cumsum(count) - count
    chars = np.add.reduceat(model["chars"][grams], start, axis=0) / count[:, None] if len(rows) else np.zeros((0, CHAR_DIM), np.float32)
    return np.concatenate([model["words"][rows], chars], axis=1, dtype=np.float32)


def gates(model: dict, x: np.ndarray, side: str) -> np.ndarray:
    """What the inputs add to the three gates; the last row, for no word, keeps the state."""
    out = np.empty((len(x) + 1, 3 * HIDDEN), np.float32)
    out[:-1] = x @ model[f"in_{side}"] + model[f"bias_{side}"]
    out[-1] = 0
    out[-1, :HIDDEN] = 40
    return out


def unroll(model: dict, table: np.ndarray, seen: np.ndarray, side: str, keep: bool = False):
    """States (place, window, unit) of one direction; with ``keep`` also what the way back needs."""
    n = len(seen)
    states = np.zeros((WINDOW, n, HIDDEN), np.float32)
    h, back = np.zeros((n, HIDDEN), np.float32), []
    weights = model[f"state_{side}"]
    for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
        given, own = table[seen[:, t]], h @ weights
        zr = sigmoid(given[:, : 2 * HIDDEN] + own[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(given[:, 2 * HIDDEN :] + r * own[:, 2 * HIDDEN :])
        if keep:
            back.append((t, h, z, r, new, own[:, 2 * HIDDEN :]))
        h = new + z * (h - new)
        states[t] = h
    return (states, back) if keep else states


def pooled(model: dict, states: np.ndarray, empty: np.ndarray):
    """Attention over the places of each window: weights and the pooled state."""
    score = np.where(empty, np.float32(-1e9), states @ model["attend"])
    score = np.exp(score - score.max(axis=0))
    weight = score / score.sum(axis=0)
    return weight, np.einsum("tn,tnh->nh", weight, states)


def window_scores(model: dict, words: Words, windows: np.ndarray) -> np.ndarray:
    x = inputs(model, words)
    tables = {side: gates(model, x, side) for side in "fb"}
    out = np.empty(len(windows), np.float32)
    for a in range(0, len(windows), WINDOWS_AT_ONCE):
        seen = words.matrix(windows[a : a + WINDOWS_AT_ONCE])
        states = np.concatenate([unroll(model, tables[side], seen, side) for side in "fb"], axis=2)
        _, pool = pooled(model, states, seen.T == len(words.word_row))
        out[a : a + len(seen)] = sigmoid(pool @ model["out"] + model["out_bias"])
    return out


def fresh(rng: np.random.Generator) -> dict:
    size = WORD_DIM + CHAR_DIM
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    model = {"words": draw(WORD_ROWS, WORD_DIM, by=0.1), "chars": draw(CHAR_ROWS, CHAR_DIM, by=0.5)}
    for side in "fb":
        model[f"in_{side}"] = draw(size, 3 * HIDDEN, by=size**-0.5)
        model[f"state_{side}"] = draw(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5)
        model[f"bias_{side}"] = np.zeros(3 * HIDDEN, np.float32)
    return model | {"attend": draw(2 * HIDDEN, by=0.3), "out": draw(2 * HIDDEN, by=0.3), "out_bias": np.zeros(1, np.float32)}


def summed(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the value rows by ``at``."""
    out = np.zeros((rows, values.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    new = np.flatnonzero(np.diff(at[order], prepend=-1))
    out[at[order][new]] = np.add.reduceat(values[order], new, axis=0)
    return out


def gradients(model: dict, words: Words, seen: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict:
    """Of the weighted log loss; for the two tables only of the rows in use, as (rows, gradient)."""
    none = len(words.word_row)
    chosen, local = np.unique(seen, return_inverse=True)
    local = local.reshape(seen.shape)
    if chosen[-1] == none:
        chosen = chosen[:-1]
    n_words = len(chosen)
    x = inputs(model, words, chosen)
    runs = {side: unroll(model, gates(model, x, side), local, side, keep=True) for side in "fb"}
    states = np.concatenate([runs[side][0] for side in "fb"], axis=2)
    weight, pool = pooled(model, states, local.T == n_words)
    p = sigmoid(pool @ model["out"] + model["out_bias"])
    d_logit = ((p - labels) * weights / weights.sum()).astype(np.float32)
    grad = {"out": pool.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
    d_pool = d_logit[:, None] * model["out"]
    d_weight = np.einsum("tnh,nh->tn", states, d_pool)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grad["attend"] = np.einsum("tn,tnh->h", d_score, states)
    d_states = weight[:, :, None] * d_pool + d_score[:, :, None] * model["attend"]
    d_x = np.zeros_like(x)
    for k, side in enumerate("fb"):
        d_state, u = np.zeros_like(model[f"state_{side}"]), model[f"state_{side}"]
        d_h = np.zeros((len(seen), HIDDEN), np.float32)
        d_gates = np.empty((WINDOW, len(seen), 3 * HIDDEN), np.float32)
        for t, h, z, r, new, own in reversed(runs[side][1]):
            d_h = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            d_new = d_h * (1 - z) * (1 - new * new)
            d_gates[t] = d_gate = np.concatenate([d_h * (h - new) * z * (1 - z), d_new * own * r * (1 - r), d_new], axis=1)
            d_own = np.concatenate([d_gate[:, : 2 * HIDDEN], d_new * r], axis=1)
            d_state += h.T @ d_own
            d_h = d_h * z + d_own @ u.T
        grad[f"state_{side}"] = d_state
        d_table = summed(local.T.ravel(), d_gates.reshape(-1, 3 * HIDDEN), n_words + 1)
        grad[f"in_{side}"], grad[f"bias_{side}"] = x.T @ d_table[:-1], d_table[:-1].sum(axis=0)
        d_x += d_table[:-1] @ model[f"in_{side}"].T
    grad["words"] = (words.word_row[chosen], d_x[:, :WORD_DIM])
    count, start = words.gram_count[chosen], words.gram_start[chosen]
    grams = words.gram_row[np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    grad["chars"] = (grams, np.repeat(d_x[:, WORD_DIM:] / count[:, None], count, axis=0))
    return grad


def two_worst(scores: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the two highest scores of every document; ``doc`` ascends."""
    order = np.lexsort((-scores, doc))
    nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return order[nth < 2]


def train(texts: list[str], toxic: list[int], seed: int = 7, rounds: int = 10, batch: int = 128, rate: float = 0.01) -> dict | None:
    """The network, or None where there is nothing to tell apart."""
    rng = np.random.default_rng(seed)
    bodies = [t.encode() for t in texts]
    words = Words(np.frombuffer(b"".join(bodies), np.uint8), np.array([len(b) for b in bodies], np.int64))
    windows, doc = words.windows(len(texts))
    label = np.array(toxic, np.int64)[doc]
    every_bad, every_good = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(every_bad) or not len(every_good):
        return None
    model = fresh(rng)
    first, second = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}
    steps = 0
    for nth in range(rounds):
        if nth:
            bad = every_bad[two_worst(window_scores(model, words, windows[every_bad]), doc[every_bad])]
            some = rng.choice(every_good, min(len(every_good), 16_000), replace=False)
            hard = some[window_scores(model, words, windows[some]) > 0.1]
        else:
            bad, hard = rng.choice(every_bad, min(len(every_bad), 6000), replace=False), every_good[:0]
        good = rng.choice(every_good, min(len(every_good), (1 if not nth else 2) * len(bad)), replace=False)
        order = rng.permutation(np.concatenate([bad, good, hard]))
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            grad = gradients(model, words, words.matrix(windows[part]), label[part].astype(np.float32), np.ones(len(part), np.float32))
            steps += 1
            pace = rate * (0.3 if nth >= rounds - 2 else 1) * (1 - 0.999**steps) ** 0.5 / (1 - 0.9**steps)
            for k, g in grad.items():
                if isinstance(g, tuple):
                    rows, at = np.unique(g[0], return_inverse=True)
                    change = summed(at, g[1], len(rows))
                    second[k][rows] = 0.99 * second[k][rows] + 0.01 * change**2
                    model[k][rows] -= rate * change / (np.sqrt(second[k][rows]) + 1e-6)
                else:
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    model[k] -= (pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    worst = np.zeros(len(texts))
    np.maximum.at(worst, doc, window_scores(model, words, windows).astype(np.float64))
    logit = np.log(np.clip(worst, 1e-7, 1 - 1e-7) / np.clip(1 - worst, 1e-7, 1))
    known = np.unique(doc)
    values, truth = logit[known], np.array(toxic)[known]
    order = np.argsort(values)
    wrong = np.cumsum(truth[order] == 1) / max(1, (truth == 1).sum()) + 1 - np.cumsum(truth[order] == 0) / max(1, (truth == 0).sum())
    k = int(np.argmin(wrong))
    model["out_bias"] = model["out_bias"] - np.float32((values[order[k]] + values[order[min(k + 1, len(order) - 1)]]) / 2)
    return model


def held_out(doc_id, of: int = HELD_OUT_OF, rest: int = 0):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of == rest


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, longest: int) -> tuple[list[str], list[int]]:
    """At most ``sample`` texts of each label that may be learned from."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("known_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    known = known.where(~held_out(F.col("known_id")))
    texts, labels = [], []
    for label in (0, 1):
        # twice the ids, as some have no text or a longer one
        ids = known.where(F.col("label") == label).select("known_id").orderBy(F.xxhash64("known_id"), "known_id").limit(2 * sample)
        rows = (
            docs.where(F.length("text") <= longest).select(F.col("doc_id").cast("bigint").alias("known_id"), "text")
            .join(F.broadcast(ids), "known_id").orderBy(F.xxhash64("known_id"), "known_id", "text").limit(sample).collect()
        )
        texts += [r.text for r in rows]
        labels += [label] * len(rows)
    return texts, labels


def _part_scores(model: dict | None, constant: float, body: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of every text of a part, and the bytes (start, end) of its worst window."""
    n = len(lengths)
    scores, start, end = np.full(n, constant), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if model is not None:
        words = Words(body, lengths)
        windows, doc = words.windows(n)
        if len(windows):
            found = window_scores(model, words, windows)
            order = np.lexsort((-np.arange(len(doc)), found, doc))
            best = order[np.append(np.diff(doc[order]) > 0, True)]
            scores = np.zeros(n)
            scores[doc[best]] = found[best]
            base = np.cumsum(lengths) - lengths
            start[doc[best]] = words.first[windows[best, 0]] - base[doc[best]]
            end[doc[best]] = words.last[windows[best].sum(axis=1) - 1] - base[doc[best]]
    return scores, start, end


def score_documents(docs: DataFrame, model: dict | None, constant: float = 0.0) -> DataFrame:
    """doc_id, score, and the bytes (start, end) of the worst window."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            for a, b, body, lengths in parts(batch, 1, PART_BYTES):
                scores, start, end = _part_scores(sent.value, constant, body, lengths)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores, pa.float64()), pa.array(start), pa.array(end)], ["doc_id", "score", "start", "end"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).transform(map_arrow, score, "doc_id bigint, score double, start bigint, end bigint")


def clean_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """The rows of ``docs`` that score below one half, all columns as they are; no row moves for it."""
    texts, known = labelled_sample(docs, labels, sample, longest)
    constant = float(bool(known) and min(known) == 1)
    sent = docs.sparkSession.sparkContext.broadcast(train(texts, known))
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            for a, b, body, lengths in parts(batch, at, PART_BYTES):
                scores, *_ = _part_scores(sent.value, constant, body, lengths)
                yield batch.slice(a, b - a).filter(pa.array(scores < 0.5))

    return docs.withColumn("text", F.col("text").cast("string")).transform(lambda df: map_arrow(df, keep, df.schema))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """doc_id, held_out, score, predicted, start, end of every document."""
    texts, known = labelled_sample(docs, labels, sample, longest)
    scored = score_documents(docs, train(texts, known), constant=float(bool(known) and min(known) == 1))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "start", "end"
    )
