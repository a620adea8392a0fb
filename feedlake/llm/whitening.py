"""Whitening of embeddings: principal components by contour integration, rows projected on them.

Entries become whole numbers, so counts, sums and sums of products are exact whatever the order of the
tasks: a first pass gives n and the sums S, a second the products of the entries less the nearest whole
number to their mean, and the covariance V follows in whole-number arithmetic and is rounded once.

Inertia counts (signs of the pivots of a symmetric factorisation of V less a shift) cut the upper part of
the spectrum into intervals of few eigenvalues.  Each interval is one task: a circle around it, complex
shifted solves at its quadrature nodes, their weighted sum as a projector onto the interval's
eigenvectors, Rayleigh-Ritz within what it lets pass, until the residuals are down.  An interval that
doesn't return as many eigenpairs as its ends' inertia counts say is an error, so none is missed.
A last Rayleigh-Ritz over all intervals makes the components orthogonal across the cuts.

What passes through the driver is V and the components: the square of a vector's width, at most WIDEST,
whatever the number of rows.

Rows whose vector is null, or holds null or non-finite entries, are dropped.  All vectors have the width
that most of the rest have (the larger of two equally common ones); rows of other widths are dropped as
well.  Entries beyond 2 ** 34 count as that.  Components whose eigenvalue is at most FLOOR of the largest
row sum of V have no meaning at double precision and are left out, so equal vectors and empty tables give
no rows.  Null and repeated ids are rows like any other; extra columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.shared import map_arrow, materialise

COMPONENTS = 32
WIDEST = 8192
FLOOR = 1e-11
# Eigenvalues looked for in one interval, quadrature nodes on the upper half of its circle, rounds at most.
IN_INTERVAL = 8
NODES = 12
ROUNDS = 40
# Whole numbers that stay exact in double arithmetic.
EXACT = 1 << 53
FURTHEST = float(1 << 40)
LARGEST = 10**38


def whole(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch that are kept, and the lengths of their vectors; with a ``width`` their entries as
    whole numbers instead."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    upto = np.append(0, np.cumsum(~np.isfinite(values)))
    ends = np.cumsum(lengths)
    good = column.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0) & (upto[ends] == upto[ends - lengths])
    if width is None:
        rows = np.flatnonzero(good)
        return rows, lengths[rows]
    rows = np.flatnonzero(good & (lengths == width))
    entries = values[(ends - lengths)[rows][:, None] + np.arange(width)]
    return rows, np.clip(np.floor(64 * entries), -FURTHEST, FURTHEST).astype(np.int64) + 1_000_000


def sums_of(x: np.ndarray) -> np.ndarray:
    """Exact column sums as Python's integers."""
    if not x.size or int(np.abs(x).max()) * len(x) < 1 << 62:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0)


def products_of(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns, upper triangle."""
    upper = np.triu_indices(y.shape[1])
    most = int(np.abs(y).max(initial=0))
    if most * most * max(1, len(y)) < EXACT:
        near = y.astype(np.float64)
        return (near.T @ near)[upper].astype(np.int64).astype(object)
    far = y.astype(object)
    return (far.T @ far)[upper]


def decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) if abs(v) < LARGEST else None for v in values], pa.decimal128(38, 0))


def counted(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """Width of the vectors, their number and the sum of every dimension."""

    def count(batches):
        totals = {}
        for batch in batches:
            rows, lengths = whole(batch.column(1))
            for width in np.unique(lengths).tolist():
                _, x = whole(batch.column(1), width)
                n, sums = totals.get(width, (0, 0))
                totals[width] = n + len(x), sums + sums_of(x)
        for width, (n, sums) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), decimals(sums)],
                ["width", "at", "n", "total"],
            )

    found = map_arrow(vectors, count, "width int, at int, n bigint, total decimal(38,0)")
    sums = materialise(found.groupBy("width", "at").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")), "whitening-sums")
    most = sums.where("at = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if most is None:
        return 0, 0, []
    if most.width > WIDEST:
        raise ValueError(f"vectors of {most.width} entries; the covariance of at most {WIDEST} is held in one place")
    return most.width, most.n, [int(r.total) for r in sums.where(F.col("width") == most.width).orderBy("at").collect()]


def covariance(vectors: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the whole-number entries, each element rounded once."""
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def multiply(batches):
        total = np.zeros(width * (width + 1) // 2, object)
        for batch in batches:
            total += products_of(whole(batch.column(1), width)[1] - middle)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), decimals(total)], ["at", "total"])

    found = map_arrow(vectors, multiply, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
    products = {r["at"]: int(r["total"]) for r in found.collect()}
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    out = np.empty((width, width))
    for at, (i, j) in enumerate(zip(*(x.tolist() for x in np.triu_indices(width)))):
        out[i, j] = out[j, i] = (n * products[at] - rest[i] * rest[j]) / (n * n)
    return out


def inertia_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie above ``shift``: positive pivots of a symmetric factorisation with complete
    pivoting, in blocks of one row or two."""
    m = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(m):
        sizes = np.abs(m)
        own = sizes.diagonal().copy()
        np.fill_diagonal(sizes, -1.0)
        far = int(sizes.argmax())
        r, c = divmod(far, len(m))
        most, p = float(sizes[r, c]), int(own.argmax())
        if max(most, own[p]) <= 0:
            break
        if own[p] >= 0.6403882032022076 * most:  # (1 + sqrt(17)) / 8 bounds the growth of the elements
            chosen = [p]
            above += m[p, p] > 0
        else:
            chosen = [r, c]
            above += 1
        rest = np.setdiff1d(np.arange(len(m)), chosen)
        side = m[np.ix_(rest, chosen)]
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(m[np.ix_(chosen, chosen)], side.T)
        m = (m + m.T) / 2
    return int(above)


def intervals(matrix: np.ndarray, floor: float, ceiling: float, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues) from the top down until ``wanted`` are covered."""
    cuts, out, covered = [(floor, ceiling, inertia_above(matrix, floor), 0)], [], 0
    while cuts and covered < wanted:
        low, high, upto, before = cuts.pop()
        inside = upto - before
        if not inside:
            continue
        if inside <= IN_INTERVAL or high - low < 1e-9 * ceiling:
            for _ in range(6):  # a low end amid the gap below lets the projector tell the two sides apart
                higher = (low * high) ** 0.5
                if higher > 0.9 * high or inertia_above(matrix, higher) != upto:
                    break
                low = higher
            out.append((low, high, inside))
            covered += inside
            continue
        middle = low + (high - low) * 0.5137  # not a round share: whole-number spectra have no eigenvalue there
        at = inertia_above(matrix, middle)
        cuts += [(low, middle, upto, at), (middle, high, at, before)]
    return out


def project(matrix: np.ndarray, low: float, high: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """All eigenpairs between ``low`` and ``high``, of which there are ``inside``."""
    width = len(matrix)
    size = min(width, 2 * inside + 10)
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(0.5j * np.pi * (1 + points))
    centre, radius = (low + high) / 2, (high - low) / 2
    scale = float(np.abs(matrix).sum(axis=1).max())
    basis = np.linalg.qr(np.random.default_rng(17).standard_normal((width, size)))[0]
    best = (np.inf, None, None)
    for step in range(ROUNDS):
        passed = np.zeros((width, size))
        for turn, weight in zip(turns, weights):
            passed += np.real(0.5 * weight * radius * turn * np.linalg.solve((centre + radius * turn) * np.eye(width) - matrix, basis))
        basis = np.linalg.qr(passed)[0]
        values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
        basis = basis @ turned
        own = (values > low) & (values <= high)
        if own.sum() == inside:
            left = float(np.linalg.norm(matrix @ basis[:, own] - basis[:, own] * values[own], axis=0).max())
            if left < best[0]:
                best = (left, values[own], basis[:, own])
            elif best[0] < 1e-12 * scale:
                break  # down to rounding
    if best[0] > 1e-11 * scale:
        raise ArithmeticError(f"{inside} eigenvalues lie in {low} .. {high}, residual {best[0]}")
    return best[1], best[2]


def components(spark: SparkSession, matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues in falling order and, as columns, the eigenvectors of the first ``most`` components."""
    scale = float(np.abs(matrix).sum(axis=1).max())
    if not scale:
        return np.zeros(0), np.zeros((len(matrix), 0))
    unit = matrix / scale
    wanted = min(most, inertia_above(unit, FLOOR))
    found = intervals(unit, FLOOR, 1.001, wanted)
    sent = spark.sparkContext.broadcast(unit)

    def solve(batches):
        for batch in batches:
            for low, high, inside in zip(*(batch.column(i).to_pylist() for i in range(3))):
                values, vectors = project(sent.value, low, high, inside)
                yield pa.RecordBatch.from_pydict({"low": [low] * inside, "value": values, "vector": pa.array(list(vectors.T), pa.list_(pa.float64()))})

    tasks = spark.createDataFrame(found, "low double, high double, inside int").repartition(max(1, len(found)))
    pairs = map_arrow(tasks, solve, "low double, value double, vector array<double>").collect()
    for low, high, inside in found:
        if sum(p.low == low for p in pairs) != inside:
            raise ArithmeticError(f"eigenvalues missed between {low} and {high}")
    if not pairs:
        return np.zeros(0), np.zeros((len(matrix), 0))
    basis = np.linalg.qr(np.array([p.vector for p in pairs]).T)[0]
    _, turned = np.linalg.eigh(basis.T @ unit @ basis)
    vectors = (basis @ turned)[:, ::-1][:, :wanted]
    return np.einsum("ij,ij->j", vectors, matrix @ vectors), vectors


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation decimal(38,0) (null if it has more digits), whitened array<double>, explained
    array<double>, identity_error; arrays by component.

    ``vectors`` has vec_id and embedding.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    width, n, sums = counted(rows)
    values, axes = np.zeros(0), np.zeros((0, 0))
    if n:
        matrix = covariance(rows, width, n, sums)
        values, axes = components(spark, matrix, most)
    k = len(values)
    if not k:
        schema = "vec_id bigint, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast((sums, axes / np.sqrt(values)))

    def centred(x):
        """n times the entries less the mean, exact."""
        totals = sent.value[0]
        if n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, totals)) < 1 << 62:
            return n * x - np.array(totals, np.int64)
        return n * x.astype(object) - np.array(totals, object)

    def projected(d):
        return (d.astype(np.float64) / n) @ sent.value[1]

    def squares(d):
        far = int(np.abs(d).max(initial=0))
        return (d * d).sum(axis=1) if width * far * far < 1 << 62 else (d.astype(object) ** 2).sum(axis=1)

    def moments(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = projected(centred(whole(batch.column(1), width)[1]))
            total += w.sum(axis=0)
            products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array(np.append(total, products.ravel()))], ["at", "total"])

    seen = map_arrow(rows, moments, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    flat = np.zeros(k + k * k)
    for r in seen:
        flat[r["at"]] = r["total"] / n
    error = float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())

    def project_rows(batches):
        for batch in batches:
            own, x = whole(batch.column(1), width)
            d = centred(x)
            w = projected(d)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(own)), decimals(squares(d)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * np.int32(k)), pa.array(w.ravel())),
            ], ["vec_id", "deviation", "whitened"])

    share = F.array(*[F.lit(float(v)) for v in values / np.trace(matrix)])
    return map_arrow(rows, project_rows, "vec_id bigint, deviation decimal(38,0), whitened array<double>").select(
        "vec_id", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error")
    )
