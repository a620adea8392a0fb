"""Language by the nearest centroid of normalised TF-IDF trigram vectors.

A text's vector counts its byte trigrams in ``DIM`` hashed places, words set apart by one blank, as
log(1 + count) times the inverse document frequency, at length one.  Document frequencies cover every
row that may be learned from.  Each language has up to ``clusters`` centroids, found by spherical
k-means over the ``sample`` of its rows whose hashes of doc_id and text are least; repeated rows are one
there.  A text gets
the language of the centroid with the greatest cosine; ``score`` is that cosine.  It is ``rejected`` if
its distance, one less the cosine, is beyond the centroid's radius: the distance that holds
``REJECT_SHARE`` of the centroid's sample rows, and ``REJECT_SLACK`` more.  With ``reject`` a rejected
text is ``und``.

A null text, or one without a letter, is ``und`` with score 0, as is everything if nothing was learned.
Equal cosines go to the language that sorts first.  A null doc_id counts as the empty text where rows
are held out; repeated rows are predicted each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.shared import map_arrow
from feedlake.llm.words import LOWER, NO_WORD, parts

BITS = 12
DIM = 1 << BITS
CLUSTERS, SAMPLE = 3, 400
REJECT_SHARE, REJECT_SLACK = 0.995, 0.15
STEP = 12
ROWS_AT_ONCE, PART_BYTES = 256, 1 << 20
HELD_OUT_OF = 3
_shown = np.where(NO_WORD, np.uint8(32), LOWER)


def counts(body: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Trigrams of each document by place; a trigram has a letter or digit in the middle."""
    rows = len(lengths)
    if not len(body):
        return np.zeros((rows, DIM), np.int64)
    low = _shown[body]
    left, right = np.empty_like(low), np.empty_like(low)
    left[1:], right[:-1] = low[:-1], low[1:]
    ends = np.cumsum(lengths)
    some = lengths > 0
    left[(ends - lengths)[some]] = right[ends[some] - 1] = 32
    code = (left.astype(np.uint32) << 16) | (low.astype(np.uint32) << 8) | right
    place = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    place = place.astype(np.int64) + np.repeat(np.arange(rows, dtype=np.int64) * DIM, lengths)
    return np.bincount(place[low != 32], minlength=rows * DIM).reshape(rows, DIM)


def _counted(batch: pa.RecordBatch, column: int):
    for a, b, body, lengths in parts(batch, column, PART_BYTES):
        ends = np.cumsum(lengths)
        for x in range(0, b - a, ROWS_AT_ONCE):
            y = min(x + ROWS_AT_ONCE, b - a)
            yield a + x, a + y, counts(body[ends[x] - lengths[x] : ends[y - 1]], lengths[x:y])


def vectors(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counted).astype(np.float32) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _frequencies(batches):
    """In how many of a task's documents each place occurs, and how many documents there are (place -1)."""
    found, rows = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for _, _, counted in _counted(batch, 0):
            found += (counted > 0).sum(axis=0)
            rows += len(counted)
    yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(-1, DIM, dtype=np.int32)), "docs": pa.array(np.append(rows, found))})


def k_means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids by cosine, begun with points far from each other."""
    centre = points.mean(axis=0)
    chosen = [int((points @ centre).argmax())]
    while len(chosen) < min(k, len(points)):
        near = (points @ points[chosen].T).max(axis=1)
        if near.min() > 1 - 1e-6:
            break
        chosen.append(int(near.argmin()))
    centroids = points[chosen]
    for _ in range(rounds):
        nearest = (points @ centroids.T).argmax(axis=1)
        sums = np.stack([points[nearest == c].sum(axis=0) if (nearest == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def least_hashes(hashed: DataFrame, languages: list[str], sample: int) -> tuple[int, dict[str, int]]:
    """A shift, and each language's greatest ``hash >>> shift`` so that it has ``sample`` rows up to there.

    Twice as many at most, but for equal hashes; a language of fewer rows has all.  Every round counts
    the rows of one span of hashes for each language in 2 ** ``STEP`` shares.
    """
    shift, top, below = 64, {}, dict.fromkeys(languages, 0)
    while True:
        inside = hashed
        if top:
            inside = hashed.where(F.shiftrightunsigned("hash", shift) == F.create_map(*(F.lit(x) for pair in top.items() for x in pair))[F.col("lang")])
        shift -= STEP
        # at most 2 ** STEP rows a language
        shares: dict[str, list] = {}
        for r in inside.groupBy("lang", F.shiftrightunsigned("hash", shift).alias("share")).count().collect():
            shares.setdefault(r.lang, []).append((r.share, r["count"]))
        upto = dict(below)
        for lang, found in shares.items():
            for share, n in sorted(found):
                top[lang], below[lang], upto[lang] = share, upto[lang], upto[lang] + n
                if upto[lang] >= sample:
                    break
        if shift < STEP or all(n <= 2 * sample for n in upto.values()):
            return shift, top


def learn(known: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE) -> dict | None:
    """Centroids from rows of doc_id, text and lang, none of them null."""
    by_language = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not by_language:
        return None
    frequency = {r.place: r.docs for r in known.select("text").transform(map_arrow, _frequencies, "place int, docs bigint").groupBy("place").agg(F.sum("docs").alias("docs")).collect()}
    docs = np.array([frequency.get(i, 0) for i in range(DIM)])
    idf = (np.log((1 + frequency[-1]) / (1 + docs)) + 1).astype(np.float32)
    hashed = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("hash"))
    shift, top = least_hashes(hashed.select("lang", "hash"), sorted(by_language), sample)
    most = F.create_map(*(F.lit(x) for pair in top.items() for x in pair))[F.col("lang")]
    chosen = hashed.where(F.shiftrightunsigned("hash", shift) <= most).dropDuplicates(["lang", "hash"])

    def vectorise(batches):
        for batch in batches:
            for a, b, counted in _counted(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([v.tobytes() for v in vectors(counted, idf)], pa.binary())], ["lang", "hash", "vector"])

    rows = chosen.select("lang", "text", "hash").transform(map_arrow, vectorise, "lang string, hash bigint, vector binary").collect()
    rows.sort(key=lambda r: r.hash % 2**64)
    languages, centroids, radii = [], [], []
    for lang in sorted({r.lang for r in rows}):
        points = np.stack(sorted([np.frombuffer(r.vector, np.float32) for r in rows if r.lang == lang][:sample], key=lambda v: v.tobytes()))
        found = k_means(points, clusters)
        cosine = points @ found.T
        for c in range(len(found)):
            own = 1 - cosine[cosine.argmax(axis=1) == c, c]
            radii.append(float(np.quantile(own, REJECT_SHARE)) + REJECT_SLACK if len(own) else 0.0)
        languages += [lang] * len(found)
        centroids.append(found)
    return {"idf": idf, "languages": languages, "centroids": np.concatenate(centroids).T.astype(np.float32), "radii": np.array(radii)} if languages else None


def predict(docs: DataFrame, model: dict | None, reject: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def classify(batches):
        model = sent.value
        for batch in batches:
            for a, b, counted in _counted(batch, 1):
                if model is None:
                    best, score = [None] * (b - a), np.zeros(b - a)
                    far = np.ones(b - a, bool)
                else:
                    cosine = vectors(counted, model["idf"]) @ model["centroids"]
                    at = cosine.argmax(axis=1)
                    score = np.clip(cosine[np.arange(b - a), at], 0, 1).astype(np.float64)
                    best, far = [model["languages"][i] for i in at], 1 - score > model["radii"][at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(best, pa.string()), pa.array(score), pa.array(far)],
                    ["doc_id", "letters", "best", "cosine", "rejected"],
                )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), letters.alias("letters")).transform(map_arrow, 
        classify, "doc_id bigint, letters boolean, best string, cosine double, rejected boolean"
    )
    sure = F.col("letters") & F.col("best").isNotNull()
    return found.select(
        "doc_id", F.when(sure & (~F.col("rejected") | F.lit(not reject)), F.col("best")).otherwise("und").alias("lang_pred"),
        F.when(sure, F.col("cosine")).otherwise(0.0).alias("score"), (F.col("rejected") | ~sure).alias("rejected"),
    )


def held_out(doc_id, of: int = HELD_OUT_OF, rest: int = 1):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of == rest


def languages(docs: DataFrame, reject: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from the rows that aren't held out."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    model = learn(known.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang"))
    return predict(docs, model, reject).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
