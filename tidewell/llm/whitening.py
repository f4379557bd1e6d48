"""Whitening of embeddings on principal components, found by a bidiagonal qd solver.

Vectors become whole numbers, ``x = floor(64 * c) + 1000000``, so counts and sums are exact and centring loses nothing:
``(n * x - S) / n``. Every task reduces its centred rows block by block to one triangular factor (QR of the factor so far on
top of the next rows), factors are merged in a tree of bounded fan-in, and the last one, whose size depends on the number of
dimensions alone, is solved: Householder reflections make it bidiagonal, dqds sweeps find its singular values, and a
twisted factorisation at each of them gives the direction. The covariance itself is never formed, so small components keep
their digits.

Defined results: null vectors and vectors with a null, NaN or infinite entry are dropped. Of the others only those with the
commonest length count (ties: the greater length); empty vectors are dropped. Components whose deviation is zero to double
precision cannot be whitened and have no rows, so no rows at all come from an empty table, one vector, or equal vectors.
Repeated rows count as often as they occur, null and repeated ids stay as they are. An entry too large for exact sums is an
arithmetic error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = float(np.finfo(float).eps)
NEGLIGIBLE = (100 * EPS) ** 2  # of a square, for the square of an entry above the diagonal
SCALE, OFFSET = 64, 1_000_000
ROWS = 4096  # rows of one QR block
FAN = 32  # factors merged by one task
CLUSTER = 0.02  # relative distance below which values are treated as a group


# ---- the small solver: one matrix of dimensions x dimensions -------------------------------------------------------------


def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, beta, alpha) with (I - beta v v') x = (alpha, 0, ..., 0)."""
    scale = float(np.abs(x).max(initial=0.0))
    if scale == 0 or not np.abs(x[1:]).max(initial=0.0):
        return np.zeros_like(x), 0.0, float(x[0])
    v = x / scale
    norm = float(np.sqrt(v @ v))
    alpha = -norm if v[0] > 0 else norm
    v[0] -= alpha
    return v, 2.0 / float(v @ v), alpha * scale


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) of the upper bidiagonal B = U' R V; U is not needed."""
    a, m = r.astype(float).copy(), r.shape[1]
    v_all = np.eye(m)
    for k in range(m):
        v, beta, _ = reflector(a[k:, k])
        if beta:
            a[k:, k:] -= np.outer(beta * v, v @ a[k:, k:])
        if k < m - 2:
            v, beta, _ = reflector(a[k, k + 1 :])
            if beta:
                a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, beta * v)
                v_all[:, k + 1 :] -= np.outer(v_all[:, k + 1 :] @ v, beta * v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v_all


def sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One dqds transform: (q, e, d) of the shifted qd array; a negative d tells that the shift was too large."""
    d, new_q, new_e, ds = q[0] - shift, [], [], []
    for k in range(len(q) - 1):
        ds.append(d)
        total = d + e[k]
        new_q.append(total)
        if total <= 0:
            return new_q, new_e, [*ds, -1.0]
        ratio = q[k + 1] / total
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    ds.append(d)
    new_q.append(d)
    return new_q, new_e, ds


def squared_singular_values(diag: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix by dqds, the greatest first."""
    size = float(max(np.abs(diag).max(initial=0.0), np.abs(upper).max(initial=0.0)))
    if not size:
        return np.zeros(len(diag))
    least = 1e-40  # of the greatest square: keeps exact zeros from dividing
    todo = [([max(float(x), least) for x in (diag / size) ** 2], [float(x) for x in (upper / size) ** 2], 0.0)]
    found: list[float] = []
    while todo:
        q, e, shift = todo.pop()
        cut = next((k for k in range(len(e)) if e[k] <= NEGLIGIBLE * (shift + min(q[k], q[k + 1])) + least * 1e-5), None)
        if cut is not None:
            todo += [(q[: cut + 1], e[:cut], shift), (q[cut + 1 :], e[cut + 1 :], shift)]
            continue
        if len(q) == 1:
            found.append(shift + q[0])
            continue
        # Without a shift the d are the inverse diagonal of the inverse, so 1 / sum(1 / d) bounds the least value from below
        # and min(d) from above. The bold shift close to min(d) is taken back if it went too far.
        q0, e0, d0 = sweep(q, e, 0.0)
        low, high = 1.0 / sum(1.0 / max(x, least) for x in d0), min(d0)
        for step in (high - 1.5 * (high - low) ** 2 / high, low * (1 - 4 * len(q) * EPS), 0.0):
            if step <= 0 or shift + step == shift:
                q, e = q0, e0
                break
            q1, e1, d1 = sweep(q0, e0, step)
            if min(d1) >= 0 and len(q1) == len(q0):
                q, e, shift = q1, e1, shift + step
                break
        q = [max(x, least * least) for x in q]
        if 1.5 * q[0] < q[-1]:  # graded the wrong way round: a flipped array has the same values and falls apart sooner
            q, e = flipped(q, e)
        todo.append((q, e, shift))
    return np.sort(np.array(found))[::-1] * size * size


def flipped(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The qd array of the same matrix read from its end: entries in reverse order."""
    return q[::-1], e[::-1]


class Twisted:
    """Twisted factorisations of B'B - value for a bidiagonal B."""

    def __init__(self, diag: np.ndarray, upper: np.ndarray):
        size = float(np.abs(diag).max(initial=0.0)) or 1.0
        a = np.where(np.abs(diag) > 1e-20 * size, diag, 1e-20 * size)
        self.q, self.l = [float(x) for x in a * a], [float(x) for x in upper / a[:-1]]
        self.tiny = 1e-40 * size * size

    def _safe(self, x: float) -> float:
        return x if abs(x) > self.tiny else self.tiny

    def factors(self, value: float) -> tuple[list[float], list[float], list[float], list[float], list[float]]:
        """(multipliers from the top, pivots from the top, multipliers from the bottom, pivots from the bottom, gamma)."""
        n, s, p = len(self.q), -value, self.q[-1] - value
        top, top_d, tops = [], [], [s]
        for k in range(n - 1):
            pivot = self._safe(s + self.q[k])
            top_d.append(pivot)
            top.append(self.q[k] * self.l[k] / pivot)
            s = top[k] * self.l[k] * s - value
            tops.append(s)
        bottom, bottom_d, ends = [0.0] * (n - 1), [0.0] * (n - 1), [p] * n
        for k in range(n - 2, -1, -1):
            pivot = self._safe(self.q[k] * self.l[k] * self.l[k] + p)
            t = self.q[k] / pivot
            bottom[k], bottom_d[k] = self.l[k] * t, pivot
            p = p * t - value
            ends[k] = p
        return top, top_d, bottom, bottom_d, [a + b + value for a, b in zip(tops, ends)]

    def direction(self, value: float) -> np.ndarray:
        """Unit vector whose residual is least among all twists."""
        top, _, bottom, _, gamma = self.factors(value)
        k = min(range(len(gamma)), key=lambda i: abs(gamma[i]))
        z = np.zeros(len(gamma))
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -top[i] * z[i + 1]
        for i in range(k, len(gamma) - 1):
            z[i + 1] = -bottom[i] * z[i]
        return z / np.sqrt(z @ z)

    def solve(self, value: float, w: np.ndarray) -> np.ndarray:
        """z of (B'B - value) z = w, twisted where the pivot is least."""
        top, top_d, bottom, bottom_d, gamma = self.factors(value)
        n, k = len(gamma), min(range(len(gamma)), key=lambda i: abs(gamma[i]))
        y = w.astype(float).copy()
        for i in range(k):
            y[i + 1] -= top[i] * y[i]
        for i in range(n - 2, k - 1, -1):
            y[i] -= bottom[i] * y[i + 1]
        z = np.zeros(n)
        z[k] = y[k] / self._safe(gamma[k])
        for i in range(k - 1, -1, -1):
            z[i] = y[i] / top_d[i] - top[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = y[i + 1] / bottom_d[i] - bottom[i] * z[i]
        return z


def directions(diag: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal columns for falling values; members of a group of close values are kept apart by inverse iteration."""
    solver, size = Twisted(diag, upper), float(values.max(initial=0.0)) or 1.0
    rng, out, group = np.random.default_rng(7), [], 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * values[j - 1]:
            group = j
        z = solver.direction(float(value))
        if j > group:
            before = np.array(out[group:])
            z -= before.T @ (before @ z)
            if z @ z < 0.01:
                z = rng.standard_normal(len(diag))
            near = float(value) - (j - group) * EPS * size  # not the same shift again
            for _ in range(4):
                z -= before.T @ (before @ z)
                z = solver.solve(near, z / np.sqrt(z @ z))
                z /= np.abs(z).max()
            for _ in range(2):
                z -= before.T @ (before @ z)
                z /= np.sqrt(z @ z)
        out.append(z)
    return np.array(out).T if out else np.zeros((len(diag), 0))


def principal(r: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, directions as columns, trace) of R'R / n: at most ``components``, none that is zero to double precision."""
    diag, upper, v = bidiagonalise(r)
    squares = squared_singular_values(diag, upper)
    floor = (len(squares) * EPS) ** 2 * float(squares.max(initial=0.0))
    squares = squares[squares > floor][:components]
    return squares / n, v @ directions(diag, upper, squares), float((r * r).sum()) / n


# ---- over all rows -------------------------------------------------------------------------------------------------------


def lattice(df: DataFrame, vector: str = "embedding", others: Iterable[str] = ()) -> DataFrame:
    """(others..., x): the vectors that count, as whole numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
    # Guarded, because the optimizer may ask for a row's x before the row is dropped.
    whole = lambda c: F.when(finite(c), F.floor(c.cast("double") * SCALE) + OFFSET).cast("long")
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(F.forall(vector, finite))
    return rows.select(*others, F.transform(vector, whole).alias("x"))


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, per-dimension sums) of the vectors with the commonest length: one row a dimension reaches the driver."""
    places = rows.select(F.size("x").alias("dims"), F.posexplode("x").alias("k", "c"))
    totals = places.groupBy("dims", "k").agg(F.sum("c").alias("s"), F.count("*").alias("n"))
    best = totals.where("k = 0").orderBy(F.desc("n"), F.desc("dims")).select("dims").limit(1)
    got = sorted(totals.join(best, "dims").collect(), key=lambda r: r["k"])
    return (got[0]["n"], [r["s"] for r in got]) if got else (0, [])


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S, exactly."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(abs(v) for v in s)
    if most < 2**62:
        return n * x - np.array(s, dtype=np.int64)
    return n * x.astype(object) - np.array(s, dtype=object)


def blocks(batches: Iterable[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    """The x of every batch as one array of whole numbers, ROWS rows at a time."""
    for batch in batches:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        for k in range(0, len(x), ROWS):
            yield x[k : k + ROWS]


def merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """(part long, data binary) to one value: every task merges at most FAN of them, rounds follow until one is left."""
    count, df = parts.rdd.getNumPartitions(), parts

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // FAN], "data": [merge(list(frame["data"]))]})

    while count > 1:
        df = df.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(run, "part long, data binary")
        count = -(-count // FAN)
    got = df.collect()
    return merge([bytes(r["data"]) for r in got]) if got else None


def triangular_factor(rows: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """R of the QR factorisation of all centred rows: R'R / n is their covariance."""
    dims = len(s)

    def reduce(many: Iterable[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, dims))
        for x in many:
            r = np.linalg.qr(np.vstack([r, x]), mode="r")
        return r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = reduce((centred(x, n, s) / n).astype(float) for x in blocks(batches, dims))
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "data": [r.tobytes()]})

    def merge(data: list[bytes]) -> bytes:
        return reduce(np.frombuffer(d).reshape(-1, dims) for d in data).tobytes()

    got = merged(rows.select("x").mapInArrow(run, "part long, data binary"), merge)
    r = np.zeros((dims, dims))
    if got is not None:
        some = np.frombuffer(got).reshape(-1, dims)
        r[: len(some)] = some
    return r


def whitened_covariance(rows: DataFrame, n: int, s: list[int], weights: np.ndarray) -> np.ndarray:
    """Covariance of the whitened rows, measured over all of them, centred before multiplying."""
    dims, k = weights.shape

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows (count, mean, products about the mean) of two disjoint parts."""
        na, nb = a[0, 0], b[0, 0]
        if not na or not nb:
            return b if not na else a
        gap, out = b[1] - a[1], np.empty_like(a)
        out[0], out[1] = na + nb, a[1] + gap * (nb / (na + nb))
        out[2:] = a[2:] + b[2:] + np.outer(gap, gap) * (na * nb / (na + nb))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((k + 2, k))
        for x in blocks(batches, dims):
            w = (centred(x, n, s) / n).astype(float) @ weights
            mean = w.mean(axis=0)
            w -= mean
            total = add(total, np.vstack([np.full(k, len(w)), mean, w.T @ w]))
        if total[0, 0]:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "data": [total.tobytes()]})

    def merge(data: list[bytes]) -> bytes:
        total = np.zeros((k + 2, k))
        for d in data:
            total = add(total, np.frombuffer(d).reshape(k + 2, k))
        return total.tobytes()

    got = merged(rows.select("x").mapInArrow(run, "part long, data binary"), merge)
    return np.frombuffer(got).reshape(k + 2, k)[2:] / n


def whiten(df: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each vector that counts: (key, n, deviation decimal, whitened array, explained array, identity_error).

    ``deviation`` is the exact sum of ``(n * x - S) ^ 2`` over the dimensions; ``explained`` and ``identity_error`` (largest
    absolute entry of the whitened rows' covariance minus the identity, measured over all rows) are the same in every row.
    """
    kind = df.schema[key].dataType
    shape = "deviation decimal(38,0), whitened array<double>"
    rows = lattice(df, vector, [F.col(key).alias("key")])
    n, s = sums(rows)
    rows = rows.where(F.size("x") == len(s))
    values, vectors, trace = principal(triangular_factor(rows, n, s), n, components) if n else (np.zeros(0), np.zeros((0, 0)), 0.0)
    weights = vectors / np.sqrt(values)
    error = float(np.abs(whitened_covariance(rows, n, s, weights) - np.eye(len(values))).max()) if len(values) else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column("key"), 0
            for x in blocks([batch], len(s)):
                c = centred(x, n, s)
                most = int(max(c.max(initial=0), -c.min(initial=0)))
                square = c * c if len(s) * most * most < 2**63 else c.astype(object) ** 2
                white = (c / n).astype(float) @ weights
                ends = np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]
                deviation = pd.Series(square.sum(axis=1)).map(int).map(str)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(x)), pa.array(deviation).cast(pa.decimal128(38, 0)), pa.ListArray.from_arrays(ends, white.ravel())],
                    names=["key", "deviation", "whitened"],
                )
                at += len(x)

    if not len(values):
        rows = rows.where(F.lit(False))
    out = rows.select("key", "x").mapInArrow(run, f"key {kind.simpleString()}, {shape}")
    explained = F.array(*[F.lit(float(v / trace)) for v in values]).cast("array<double>")
    return out.select(F.col("key").alias(key), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def whitened_components(df: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation long, whitened, explained, identity_error): one row for each vector and component."""
    rows = whiten(df, components, key, vector)
    each = rows.select(F.col(key).alias("key"), "n", F.col("deviation").cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("k", "w"))
    return each.select(
        F.col("key").alias(key), (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.col("w").alias("whitened"), F.get("explained", F.col("k")).alias("explained"), "identity_error"
    )
