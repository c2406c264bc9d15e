"""Whitening of embeddings by a compensated covariance.

Entries become whole numbers x = floor(64 c) + 1000000; the fit list holds each
distinct vector once (a native distinct, which combines copies before its
shuffle). Sums are exact. Each task takes the fit list's vectors less their mean
as pairs of doubles (high and low part), forms their outer products by
error-free transformations and sums them in double-double; tasks' high and low
parts are merged in a tree of tasks, so the driver gets at most FAN matrices.
The covariance is reduced to tridiagonal form by Householder reflections and
solved by divide and conquer: the two halves' spectra are joined by the roots of
the secular equation, and eigenvectors are formed from recomputed weights, which
keeps them orthogonal. Only matrices of the vectors' dimension reach the driver.

Defined results: vectors that are null or empty, or hold a null or non-finite
entry or one above 2 ** 55, give no rows, nor do vectors of another length than
most have (ties: the shortest). Repeated rows, also under one id, give equal
rows and are one vector of the fit list. Rows with a null id are kept. A
component without variance (eigenvalue within rounding of zero, as with fewer
distinct vectors than dimensions) has whitened null and is left out of
identity_error. Equal eigenvalues have any orthogonal basis of their space.
deviation is null where it passes 64 bits, deviation_exact has it as text. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.durable import written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
FAN = 16  # matrices that are merged by one task, and that reach the driver at most
BLOCK = 200_000  # products held at a time

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a, b) -> Pair:
    """a + b and its rounding error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b) -> Pair:
    """a * b and its rounding error, exactly."""
    p = a * b
    c, d = 134217729.0 * a, 134217729.0 * b
    ah, bh = c - (c - a), d - (d - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a: Pair, b: Pair) -> Pair:
    """Sum of two double-double numbers."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    h = s + (e + t)
    low = (e + t) - (h - s) + f
    high = h + low
    return high, low - (high - h)


def product(a: Pair, b: Pair) -> Pair:
    p, e = two_product(a[0], b[0])
    e = e + (a[0] * b[1] + a[1] * b[0])
    high = p + e
    return high, e - (high - p)


def pair(value: Fraction) -> tuple[float, float]:
    high = float(value)
    return high, float(value - Fraction(high))


def column_sums(terms: Pair) -> Pair:
    """Double-double sums of the columns, by halving."""
    high, low = terms
    while len(high) > 1:
        half = len(high) // 2
        s, e = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        if len(high) % 2:
            s, e = np.concatenate([s, high[-1:]]), np.concatenate([e, low[-1:]])
        high, low = s, e
    return high[0], low[0]


def vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def totals(rows: DataFrame, terms: Callable[[np.ndarray], Pair], width: int) -> Pair:
    """Double-double sums over all rows of `width` terms made from blocks of vectors x, merged in a tree of tasks."""
    step = max(1, BLOCK // width)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (np.zeros(width), np.zeros(width))
        seen = False
        for batch in batches:
            x = vectors(batch.column(0))
            for begin in range(0, len(x), step):
                total, seen = add(total, column_sums(terms(x[begin : begin + step]))), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(total).tobytes()], pa.binary())], names=["sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                now = np.frombuffer(payload).reshape(2, width)
                total = (now[0], now[1]) if total is None else add(total, (now[0], now[1]))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(total).tobytes()], pa.binary())], names=["sums"])

    parts, n = rows.select("x").mapInArrow(own, "sums binary"), rows.rdd.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.repartition(n).mapInArrow(merge, "sums binary")
    total = (np.zeros(width), np.zeros(width))
    for (payload,) in parts.collect():
        now = np.frombuffer(payload).reshape(2, width)
        total = add(total, (now[0], now[1]))
    return total


def exact_sums(rows: DataFrame) -> list[int]:
    """Sum of each dimension of x, as whole numbers of any size; x is summed in halves of 32 bits."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(batch.column(0))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array((x >> 32).sum(0)), pa.array((x & 0xFFFFFFFF).sum(0))], names=["place", "high", "low"])

    wide = "decimal(38,0)"
    found = rows.select("x").mapInArrow(own, "place int, high long, low long").groupBy("place").agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    return [(int(r.high) << 32) + int(r.low) for r in sorted(found.collect(), key=lambda r: r.place)]


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, the one beside it, and the orthogonal q with a = q t q', by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.abs(v).max()
        if size == 0 or not v[1:].any():
            continue
        v /= size
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k:]
        rest -= 2 * np.outer(v, v @ rest)
        rest = a[k:, k + 1 :]
        rest -= 2 * np.outer(rest @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), (np.diag(a, 1) + np.diag(a, -1)) / 2, q


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + rho z z' for rising, distinct d, weights z that are not zero and rho > 0.

    Each root is sought as its distance from the pole next to it, by bisection
    down to neighbouring doubles, so differences from all poles are accurate.
    """
    k = len(d)
    last = d[-1] + rho * (z @ z)
    upper = np.append(d[1:], last)
    middle = d + (upper - d) / 2
    at_middle = 1 + rho * (z**2 / (d[None, :] - middle[:, None])).sum(1)
    left = at_middle >= 0  # the root lies in the left half
    left[-1] = True
    pole = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    gaps = d[None, :] - d[pole][:, None]
    low = np.where(left, 0.0, -(upper - d) / 2)
    high = np.where(left, (upper - d) / 2, 0.0)
    high[-1] = (last - d[-1]) * (1 + 1e-15)
    for _ in range(1100):
        mid = low + (high - low) / 2
        if not ((mid != low) & (mid != high)).any():
            break
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            value = 1 + rho * (z**2 / (gaps - mid[:, None])).sum(1)
        above = value > 0  # the function rises between poles
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    shift = np.where(left, high, low)  # never the pole itself
    off = gaps - shift[:, None]  # d_i less root j, by rows j
    weights = np.ones(k)
    for i in range(k):
        ratio = -off[:, i] / np.where(np.arange(k) == i, 1.0, d - d[i])
        weights[i] = np.prod(ratio) / rho
    z = np.copysign(np.sqrt(np.abs(weights)), z)
    u = z[None, :] / off
    u /= np.linalg.norm(u, axis=1)[:, None]
    return d[pole] + shift, u.T


def divide_and_conquer(diagonal: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and eigenvectors of a symmetric tridiagonal matrix."""
    n = len(diagonal)
    if n == 1:
        return diagonal.copy(), np.ones((1, 1))
    m = n // 2
    rho, sign = abs(beside[m - 1]), math.copysign(1.0, beside[m - 1])
    first, second = diagonal[:m].copy(), diagonal[m:].copy()
    first[-1] -= rho
    second[0] -= rho
    (d1, q1), (d2, q2) = divide_and_conquer(first, beside[: m - 1]), divide_and_conquer(second, beside[m:])
    d, z, q = np.concatenate([d1, d2]), np.concatenate([q1[-1], sign * q2[0]]), np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    order = np.argsort(d, kind="stable")
    d, z, q = d[order], z[order], q[:, order]
    least = 8 * np.finfo(float).eps * max(np.abs(d).max(), rho)
    kept: list[int] = []
    for i in range(n):  # deflation: weights that are nothing, and poles that are equal
        if rho * abs(z[i]) <= least:
            continue
        if kept and (d[i] - d[kept[-1]]) <= least:
            j = kept.pop()
            r = math.hypot(z[i], z[j])
            c, s = z[i] / r, z[j] / r
            q[:, [j, i]] = np.stack([c * q[:, j] - s * q[:, i], s * q[:, j] + c * q[:, i]], 1)
            z[i], z[j] = r, 0.0
        kept.append(i)
    if kept:
        d[kept], turn = secular(d[kept], z[kept], rho)
        q[:, kept] = q[:, kept] @ turn
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (as columns) of a symmetric matrix."""
    size = np.abs(a).max() or 1.0
    diagonal, beside, q = tridiagonal(a / size)
    values, turn = divide_and_conquer(diagonal, beside)
    found = q @ turn
    return values[::-1] * size, found[:, ::-1] / np.linalg.norm(found[:, ::-1], axis=0)


def whole_numbers(rows: DataFrame, vec_col: str) -> DataFrame:
    """Rows with a usable vector, and x, its entries as whole numbers."""
    given = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    usable = F.coalesce(F.forall(given, lambda c: c.isNotNull() & (F.abs(c) <= 2.0**55)), F.lit(False)) & (F.size(given) > 0)
    kept = rows.filter(usable)
    sizes = kept.groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return kept.filter(F.size(vec_col) == (sizes[0][0] if sizes else -1)).withColumn("x", F.transform(given, lambda c: F.floor(c * SCALE) + F.lit(SHIFT)))


def centred(x: np.ndarray, mean: Pair) -> Pair:
    """x less the mean, as high and low parts."""
    high = x.astype(np.float64)
    return add((high, (x - high.astype(np.int64)).astype(np.float64)), (-mean[0], -mean[1]))


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component, as the module says."""
    own = whole_numbers(rows.select(F.col(id_col), F.col(vec_col).alias("_v")), "_v").select(F.col(id_col).alias("id"), "x")
    fit = written(own.select("x").distinct(), "fit_list")
    n = fit.count()
    kind = rows.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    if not n:
        return rows.sparkSession.createDataFrame([], shape).withColumnRenamed("id", id_col)
    sums = exact_sums(fit)
    dim = len(sums)
    mean = tuple(np.array(p) for p in zip(*(pair(Fraction(s, n)) for s in sums)))
    a, b = np.triu_indices(dim)

    def products(x: np.ndarray) -> Pair:
        high, low = centred(x, mean)
        return product((high[:, a], low[:, a]), (high[:, b], low[:, b]))

    high, low = totals(fit, products, len(a))
    covariance = np.zeros((dim, dim))
    # The pair's sum is divided as one number, so the rounding is the last step.
    covariance[a, b] = covariance[b, a] = [float((Fraction(h) + Fraction(s)) / n) for h, s in zip(high.tolist(), low.tolist())]
    values, basis = eigen(covariance)
    trace = math.fsum(np.diag(covariance))
    k = min(components, dim)
    values, basis = values[:k], basis[:, :k]
    varied = values > dim * np.finfo(float).eps * max(values[0], 0.0)
    basis = basis / np.sqrt(np.where(varied, values, 1.0))

    def project(x: np.ndarray) -> np.ndarray:
        high, low = centred(x, mean)
        return high @ basis + low @ basis

    nothing = lambda t: (t, np.zeros_like(t))
    middle = np.add(*totals(fit, lambda x: nothing(project(x)), k)) / n
    c, d = np.triu_indices(k)

    def spread(x: np.ndarray) -> Pair:
        w = project(x) - middle
        return two_product(w[:, c], w[:, d])

    identity = np.add(*totals(fit, spread, len(c))) / n - (c == d)
    error = float(np.abs(identity[varied[c] & varied[d]]).max(initial=0.0))
    share = [float(v) / trace if trace else 0.0 for v in values]
    whole = np.array(sums, dtype=object)

    def deviations(x: np.ndarray) -> list[int]:
        if n * (int(np.abs(x).max()) + 1) < 1 << 62 and (far := int(np.abs(n * x - whole.astype(np.int64)).max())) ** 2 * dim < 1 << 62:
            return ((n * x - whole.astype(np.int64)) ** 2).sum(1).tolist() if far else [0] * len(x)
        return [sum(t * t for t in row) for row in (n * x.astype(object) - whole)]

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                piece = batch.slice(begin, 4096)
                x = vectors(piece.column(1))
                m = len(x)
                w = project(x)
                exact = deviations(x)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    piece.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array([t if t < 1 << 63 else None for t in exact], pa.int64()).take(pa.array(each)),
                    pa.array(w.reshape(-1), mask=np.tile(~varied, m)),
                    pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, error)),
                    pa.array(list(map(str, exact))).take(pa.array(each)),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return own.mapInArrow(rated, shape).withColumnRenamed("id", id_col)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every embedding on the first 16 components of all distinct ones."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
