"""Whitening of embeddings by a bidiagonal qd solver (operator 11).

Vectors become whole numbers x = floor(256 c); the fit list holds each distinct
x once.  Its covariance is never formed: blocks of centred rows are reduced to
triangular factors by QR in the tasks, and those by QR again in a tree of
tasks, until one d x d factor R is left (Rt R = n times the covariance).  Only
that factor, bounded by the dimension, comes to the driver.  There

- Householder reflections from both sides make R upper bidiagonal, R = U B Vt;
- ``dqds`` finds the squared singular values of B to high relative accuracy by
  differential quotient-difference steps with shifts (Fernando and Parlett, 1994);
- twisted factorisations of Bt B - s give a vector for every value from the
  place where the residual is least (Parlett and Dhillon, 1997); vectors of
  values that nearly coincide are made orthogonal.

The reflections take the vectors back; components are numbered by falling
eigenvalue.  A second pass over the rows projects them, a pass over the fit
list measures the covariance of the result against the identity.

Edge cases: rows whose vector is null, or holds null or non-finite entries, are
dropped; so are rows without entries and rows of another length than the most
frequent one (the longer, if two are as frequent).  Repeated rows and equal
vectors all get their rows, and count once in the fit.  A component that does
not vary (an eigenvalue of zero to working precision, as for a single vector or
fewer dimensions than components) has no rows.  ``deviation`` is null where the
exact value does not fit a long; entries beyond its range count as its ends.
An empty table gives no rows; rows without vec_id are kept with a null id."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, input_tasks

SCALE = 256
COMPONENTS = 4
FAN_IN = 16        # triangular factors that one task reduces to one
BLOCK = 4096       # rows reduced at a time

_EPS = np.finfo(float).eps


# ------------------------------------------------------------- bidiagonal solver

def bidiagonal(r: np.ndarray):
    """(diagonal, superdiagonal, V): r = U B Vt with B upper bidiagonal."""
    a, d = np.array(r, dtype=float), r.shape[1]
    v = np.eye(d)

    def reflector(x):
        """w with (I - 2 w wt) x on the first axis; None if it lies there."""
        size = np.abs(x).max(initial=0.0)
        if len(x) < 2 or size == 0 or not np.abs(x[1:]).max() > 0:
            return None
        w = x / size
        w[0] += math.copysign(np.linalg.norm(w), w[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        w = reflector(a[k:, k].copy())
        if w is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k + 2 < d:
            w = reflector(a[k, k + 1:].copy())
            if w is not None:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ w, w)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def dqds(diag: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling."""
    q, e = (diag * diag).tolist(), (upper * upper).tolist()
    top = max(q + e, default=0.0)
    if top == 0:
        return np.zeros(len(q))
    least = top * 1e-100    # stands for zero: far below any rounding of the values
    q, e = [max(x, least) for x in q], [x if x > least else 0.0 for x in e]
    blocks, found = [(q, e, 0.0)], []
    while blocks:
        q, e, shift = blocks.pop()
        failed = 0
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + shift)
                break
            # an entry that no longer changes a value in working precision parts the block
            cut_at = next((i for i in range(n - 2, -1, -1) if e[i] <= (0.01 * _EPS) ** 2 * (shift + q[i + 1])
                           or e[i] <= 1e-3 * _EPS * _EPS * min(q[i], q[i + 1])), None)
            if cut_at is not None:
                blocks.append((q[:cut_at + 1], e[:cut_at], shift))
                q, e = q[cut_at + 1:], e[cut_at + 1:]
                failed = 0
                continue
            if q[0] < q[-1] / 1.5:    # the large end first
                q, e = q[::-1], e[::-1]
            # lower eigenvalue of the last two rows as a first guess of the shift
            a, b, c = q[-2], q[-1], e[-1]
            half = 0.5 * (a + b + c)
            low = a * b / (half + math.sqrt(max(half * half - a * b, 0.0)))
            tau = low * (0.98 if failed == 0 else 0.25 if failed == 1 else 0.0)
            d, qq, ee, good = q[0] - tau, [], [], True
            for i in range(n - 1):
                if not d >= 0:
                    good = False
                    break
                s = d + e[i]
                if s <= 0:
                    s = least
                t = q[i + 1] / s
                qq.append(s)
                ee.append(e[i] * t)
                d = d * t - tau
            if good and d >= 0:
                qq.append(max(d, 0.0))
                q, e, shift, failed = [max(x, least) for x in qq], ee, shift + tau, 0
            else:
                failed += 1
    return np.array(sorted(found, reverse=True))


def twisted_vector(diag: np.ndarray, upper: np.ndarray, value: float, place: int | None = None) -> np.ndarray:
    """A unit vector z with (Bt B - value) z = gamma e_r: by the stationary
    transform from the top and the progressive one from the bottom, joined at
    the row r where |gamma| is least (or at ``place``)."""
    n = len(diag)
    if not (diag.any() or upper.any()):
        return np.eye(n)[0 if place is None else place]
    tiny = float(max(np.max(diag * diag), np.max(upper * upper, initial=0.0))) * _EPS * 1e-20
    d, l = diag * diag, np.where(diag[:-1] != 0, upper / np.where(diag[:-1] != 0, diag[:-1], 1), 0.0)
    ld, lld = diag[:-1] * upper, upper * upper
    s, lp = np.zeros(n), np.zeros(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        dp = s[i] + d[i]
        lp[i] = ld[i] / (dp if abs(dp) > tiny else math.copysign(tiny, dp))
        s[i + 1] = lp[i] * l[i] * s[i] - value
    p, um = np.zeros(n), np.zeros(max(n - 1, 0))
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        dm = lld[i] + p[i + 1]
        t = d[i] / (dm if abs(dm) > tiny else math.copysign(tiny, dm))
        um[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    r = int(np.argmin(np.abs(s + p + value))) if place is None else place
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -lp[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -um[i] * z[i]
    size = np.abs(z).max()
    if not np.isfinite(size):    # grew beyond doubles: the vector lies at the largest place
        z = np.where(np.isfinite(z), 0.0, 1.0)
        size = 1.0
    z /= size
    return z / np.linalg.norm(z)


def leading_vectors(r: np.ndarray, count: int):
    """(squared singular values, all, falling; right vectors of the first
    ``count`` as columns) of a square matrix."""
    diag, upper, v = bidiagonal(r)
    values = dqds(diag, upper)
    vectors = []
    for k in range(min(count, len(values))):
        near = [j for j in range(k) if values[j] - values[k] <= 1e-3 * values[0]]
        z = twisted_vector(diag, upper, values[k])
        rest = z
        for _ in range(2):
            for j in near:
                rest = rest - (vectors[j] @ rest) * vectors[j]
        if near and np.linalg.norm(rest) < 0.1:    # the same vector again: values coincide
            rest = _another(diag, upper, values[k], vectors)
        vectors.append(rest / np.linalg.norm(rest))
    z = np.array(vectors).T.reshape(len(diag), -1)
    if z.shape[1] > 1:    # within the span of the vectors: values and directions that agree with each other
        b = np.diag(diag) + np.diag(upper, 1) if len(diag) > 1 else np.diag(diag)
        z, _ = np.linalg.qr(z)
        y = b @ z
        d2, u2, v2 = bidiagonal(np.linalg.qr(y)[1])
        own = dqds(d2, u2)
        turn = np.column_stack([v2 @ twisted_vector(d2, u2, x) for x in own])
        if np.abs(turn.T @ turn - np.eye(len(own))).max() < 1e-13:
            z = z @ turn
    return values, v @ z


def _another(diag, upper, value, before) -> np.ndarray:
    """A vector of ``value`` orthogonal to ``before``: inverse iteration with
    twists at other places, made orthogonal each time."""
    best, least = None, math.inf
    b = np.diag(diag) + np.diag(upper, 1)
    for place in range(len(diag)):
        z = twisted_vector(diag, upper, value, place)
        for _ in range(2):
            for x in before:
                z = z - (x @ z) * x
        size = np.linalg.norm(z)
        if size < 1e-8:
            continue
        z = z / size
        for x in before:
            z = z - (x @ z) * x
        z /= np.linalg.norm(z)
        off = float(np.linalg.norm(b.T @ (b @ z) - value * z))
        if off < least:
            best, least = z, off
    if best is None:
        best = np.random.default_rng(0).normal(size=len(diag))
        for x in before:
            best = best - (x @ best) * x
    return best


# -------------------------------------------------------------------- Spark jobs

def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>): the rows whose vectors are whole, of one length."""
    v = rows[vec_col].cast("array<double>")
    whole = (rows.select(rows[id_col].cast("long").alias("vec_id"), v.alias("v"))
             .filter("v IS NOT NULL AND size(v) > 0")
             .filter(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
             .select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x")))
    rows = cut(input_tasks(whole))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows if sizes is None else rows.filter(F.size("x") == sizes.d)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches, name: str, rows: int = BLOCK):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield _matrix(b.slice(at, rows), name)


def column_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and their exact sum in every dimension."""
    def add(batches):
        n, total = 0, np.zeros(dim, dtype=object)
        for x in _blocks(batches, "x"):
            n += len(x)
            high = x >> 31    # two exact halves: neither sum can overflow in a block
            total += high.sum(axis=0).astype(object) * (1 << 31) + (x - (high << 31)).sum(axis=0).astype(object)
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([[str(t) for t in total]], pa.list_(pa.string()))],
                                  names=["n", "s"])

    part = fit.mapInArrow(add, "n long, s array<string>").select("n", F.posexplode("s").alias("d", "s"))
    sums = part.groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()    # one row a dimension
    return int(sums[0].n), [int(r.s) for r in sorted(sums, key=lambda r: r.d)]


def triangular_factor(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred fit list: QR of blocks in the tasks, then in a tree."""
    dim = len(sums)
    mean = np.array([s / n for s in sums])
    packed = "r binary"

    def emit(r):
        return pa.record_batch([pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["r"])

    def reduce_rows(batches):
        r = np.zeros((0, dim))
        for x in _blocks(batches, "x", max(BLOCK, 4 * dim)):
            r = np.linalg.qr(np.concatenate([r, x - mean]), mode="r")
        if len(r):
            yield emit(r)

    def reduce_factors(batches):
        r = np.zeros((0, dim))
        for b in batches:
            for raw in b.column(0):
                r = np.linalg.qr(np.concatenate([r, np.frombuffer(raw.as_py()).reshape(-1, dim)]), mode="r")
        if len(r):
            yield emit(r)

    level = cut(fit.mapInArrow(reduce_rows, packed))
    left = level.count()
    while left > FAN_IN:
        tasks = math.ceil(left / FAN_IN)
        level = cut(level.repartition(tasks).mapInArrow(reduce_factors, packed))
        left = level.count()
    r = np.concatenate([np.frombuffer(x.r).reshape(-1, dim) for x in level.collect()])    # at most FAN_IN d x d factors
    r = np.linalg.qr(r, mode="r")
    return np.concatenate([r, np.zeros((dim - len(r), dim))]) if len(r) < dim else r


def _exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list:
    """sum((n x - S)^2) of every row, exactly; None beyond a long."""
    reach = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums))
    if reach * reach * x.shape[1] < 2 ** 62:
        off = n * x - np.array(sums, dtype=np.int64)
        return (off * off).sum(axis=1).tolist()
    out = []
    for row in x.tolist():
        total = sum((n * c - s) ** 2 for c, s in zip(row, sums))
        out.append(total if total < 2 ** 63 else None)
    return out


def whitened(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error):
    one row per whole vector and component."""
    spark = rows.sparkSession
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    x = whole_vectors(rows, id_col, vec_col)
    fit = cut(x.select("x").distinct())
    first = fit.first()
    if first is None:
        return spark.createDataFrame([], schema)
    n, sums = column_sums(fit, len(first.x))
    r = triangular_factor(fit, n, sums)
    values, vectors = leading_vectors(r, components)
    trace = float((r * r).sum())
    rank = int((values[:vectors.shape[1]] > trace * (len(sums) * _EPS) ** 2).sum()) if trace > 0 else 0
    if rank == 0:
        return spark.createDataFrame([], schema)
    to = vectors[:, :rank] / np.sqrt(values[:rank] / n)
    explained = [float(v / trace) for v in values[:rank]]
    mean = np.array([s / n for s in sums])

    def moments(batches):
        s1, s2 = np.zeros(rank), np.zeros((rank, rank))
        for b in _blocks(batches, "x"):
            y = (b - mean) @ to
            s1 += y.sum(axis=0)
            s2 += y.T @ y
        yield pa.record_batch([pa.array([[*s1, *s2.ravel()]], pa.list_(pa.float64()))], names=["m"])

    m = (fit.mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("k", "v"))
         .groupBy("k").agg(F.sum("v").alias("v")).collect())    # rank + rank^2 rows
    m = np.array([v for _, v in sorted((r.k, r.v) for r in m)]) / n
    identity_error = float(np.abs(m[rank:].reshape(rank, rank) - np.outer(m[:rank], m[:rank]) - np.eye(rank)).max())

    def project(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                v = _matrix(part, "x")
                y = (v - mean) @ to
                deviation = _exact_deviation(v, n, sums)
                rows = len(v)
                each = pa.array(np.repeat(np.arange(rows), rank))    # every row once a component
                yield pa.record_batch([
                    part.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, rank + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * rank, n)),
                    pa.array(deviation, pa.int64()).take(each),
                    pa.array(np.ascontiguousarray(y).ravel()),
                    pa.array(np.tile(np.array(explained), rows)),
                    pa.array(np.full(rows * rank, identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(project, schema)
