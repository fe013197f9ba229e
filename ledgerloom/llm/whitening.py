"""Whitening of embeddings: components of the covariance by contour integration (FEAST), applied to every row.

Vectors become whole numbers x = floor(64 * c) + 1000000. Three passes of Spark jobs over all rows give what the driver needs, each
of a size set by the number of dimensions d and not by rows: n and the sums S; the cross products of x - round(S/n), which are whole
numbers, so that they are exact in any order of rows and tasks; and, at the end, the covariance of the whitened rows themselves.

The components are found without a dense eigensolver of V. Inertia counts (signs of the pivots of V - s I, factored with symmetric
pivoting) bisect the spectrum until a slice point with just `top` eigenvalues above it is known, and cut what lies above it into
slices of at most ``per_slice`` eigenvalues. A Spark task for each slice integrates the resolvent over a circle
about it: Gauss-Legendre nodes on the upper half, a complex shifted solve for each, the real part applied to a block of vectors; a
Rayleigh-Ritz step extracts Ritz pairs and the block is filtered again until residuals are small. The number of
pairs in a slice has to equal its inertia count; where it does not, the block grows, at last to the whole space, and after that it is an error.
A last Rayleigh-Ritz step over the components of all slices makes them orthogonal to each other to rounding.

V goes to the tasks of slices, components to those of rows: d * d numbers, and d is at most ``MOST_DIMENSIONS`` (an error beyond).

Defined results: rows whose vector is null or holds null or non-finite entries take no part; nor do those with an entry beyond 2^55, whose x is
no safe long, nor those of another length than the most frequent one (of several, the longest), nor empty vectors. Equal and repeated rows count each time; a null id stays a null id. Components
without variance (eigenvalue at most 1e-10 of the trace) cannot be whitened and are not given, so fewer vectors than dimensions or
constant ones give fewer components, or no rows. Equal eigenvalues have any orthonormal basis of their space. The sign of a component makes its
largest entry positive. ``deviation`` is exact as decimal(38,0), and null where it has more digits. Columns of the table beside id and vector are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_DIMENSIONS = 4_096
BIAS, SCALE = 1_000_000, 64
#: Sums of whole numbers up to here are exact in doubles.
EXACT = 2**53


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, c) of the rows that take part, c as array<double>."""
    c = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(2**55))), F.lit(False)) & (F.size(c) > 0)
    rows = table.select(F.col(key).alias("id"), c.alias("c")).where(fine)
    width = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = width["d"] if width else 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; covariances of more than {MOST_DIMENSIONS} are not held")
    return rows.where(F.size("c") == d)


def whole(batch: pa.RecordBatch) -> np.ndarray:
    """x of a batch's vectors as int64, a row for each."""
    flat = batch.column("c").flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(batch.num_rows, -1) + BIAS


def gathered(rows: DataFrame) -> DataFrame:
    """rows in a few tasks for each core at most, so that what tasks hand on grows with cores, not with rows; nothing is shuffled."""
    return rows.coalesce(8 * rows.sparkSession.sparkContext.defaultParallelism)


def exact_sums(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Sums of whole numbers v (decimal) by place (i, j)."""
    return {(r["i"], r["j"]): int(r["v"]) for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator()}


PLACES = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.decimal128(38, 0))])


def placed(values: dict[tuple[int, int], int]) -> pa.RecordBatch:
    i, j = ([k[n] for k in values] for n in (0, 1))
    from decimal import Decimal

    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(v) for v in values.values()], pa.decimal128(38, 0))], schema=PLACES)


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """n and S."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, None
        for b in batches:
            if b.num_rows:
                x, n = whole(b), n + b.num_rows
                own = x.sum(axis=0).astype(object) if np.abs(x).max() < 2**62 // len(x) else x.astype(object).sum(axis=0)
                s = own if s is None else s + own
        if n:
            yield placed({(-1, -1): n} | {(0, j): int(v) for j, v in enumerate(s)})

    found = exact_sums(gathered(rows.select("c")).mapInArrow(add, "i int, j int, v decimal(38,0)"))
    return found.pop((-1, -1), 0), [found[0, j] for j in range(len(found))]


def products(rows: DataFrame, centre: list[int]) -> DataFrame:
    """Exact sums of (x - centre)(x - centre)' by tasks: (i, j, v) with i <= j."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, gram = np.array(centre, dtype=np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            y = whole(b) - middle
            most = int(np.abs(y).max())
            step = EXACT // max(1, most * most)
            for at in range(0, len(y), max(1, step)):
                part = y[at : at + max(1, step)]
                own = (part.T.astype(float) @ part.astype(float)).astype(np.int64) if step else part.T.astype(object) @ part.astype(object)
                if gram is None or gram.dtype == object or own.dtype == object or int(gram.diagonal().max()) + int(own.diagonal().max()) < 2**62:
                    gram = own if gram is None else gram + own
                else:
                    gram = gram.astype(object) + own
        if gram is not None:
            yield placed({(i, j): int(gram[i, j]) for i in range(len(gram)) for j in range(i, len(gram))})

    return gathered(rows.select("c")).mapInArrow(add, "i int, j int, v decimal(38,0)")


def covariance(rows: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """V: exact cross products about whole numbers next to the means, less what these are off by, each entry rounded once."""
    centre = [round(v / n) if abs(v) < EXACT else v // n for v in s]
    off = [v - n * c for v, c in zip(s, centre)]
    d = len(s)
    v = np.zeros((d, d))
    for (i, j), p in exact_sums(products(rows, centre)).items():
        v[i, j] = v[j, i] = (n * p - off[i] * off[j]) / (n * n)
    return v


def below(a: np.ndarray) -> int:
    """Negative eigenvalues of the symmetric matrix a: signs of the pivots of a symmetric factorisation with blocks of one or two
    (Bunch and Kaufman's choice of pivots keeps it stable)."""
    a, n, k, count, alpha = a.copy(), len(a), 0, 0, (1 + 17**0.5) / 8
    while k < n:
        col = np.abs(a[k + 1 :, k])
        most, r = (col.max(), k + 1 + int(col.argmax())) if len(col) else (0.0, k)
        if max(abs(a[k, k]), most) == 0:
            k += 1
            continue
        two = False
        if abs(a[k, k]) < alpha * most:
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < alpha * most * most:
                two = abs(a[r, r]) < alpha * row.max()
                q = k + 1 if two else k
                a[[q, r]] = a[[r, q]]
                a[:, [q, r]] = a[:, [r, q]]
        if two:
            pivot, rest = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(pivot, rest.T)
            count += 1  # such a block has one eigenvalue of each sign
            k += 2
        else:
            count += bool(a[k, k] < 0)
            rest = a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(rest / a[k, k], rest)
            k += 1
    return count


def above(v: np.ndarray, s: float) -> int:
    """Eigenvalues of v above s."""
    return below(s * np.eye(len(v)) - v)


def clear(v: np.ndarray, s: float) -> float:
    """s, or a point a little below it, that no eigenvalue is so near to that rounding could put it on either side."""
    near = 1e-12 * float(np.trace(v))
    for k in range(50):
        if above(v, s - 4 * k * near - near) == above(v, s - 4 * k * near + near):
            return s - 4 * k * near
    return s


def slices(v: np.ndarray, top: int, per_slice: int) -> list[tuple[float, float, int]]:
    """(low, high, inertia count) of slices that together hold the `top` largest eigenvalues above 1e-10 of the trace, and of
    equal ones at the end all."""
    trace = float(np.trace(v))
    high, floor = trace * (1 + 1e-9), trace * 1e-10
    have = above(v, floor)
    want = min(top, have)
    if not want:
        return []
    low, up = floor, high
    while above(v, low) > want and up - low > 1e-13 * trace:  # low: at least `want` above it; up: fewer
        mid = (low + up) / 2
        low, up = (mid, up) if above(v, mid) >= want else (low, mid)
    low = clear(v, low)
    todo, out = [(low, high, above(v, low))], []
    while todo:
        a, b, n = todo.pop()
        if n <= per_slice or b - a < 1e-10 * trace:
            out += [(a, b, n)] if n else []
            continue
        mid = clear(v, (a + b) / 2)
        right = above(v, mid)
        right -= sum(k for x, _, k in todo + out if x >= b)  # what lies above b has been counted
        todo += [(mid, b, right), (a, mid, n - right)]
    return sorted(out)


def feast(v: np.ndarray, low: float, high: float, count: int, nodes: int = 8, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high] and unit eigenvectors, count of them."""
    d, scale = len(v), float(np.trace(v))
    x, w = np.polynomial.legendre.leggauss(nodes)
    size = min(d, max(count + 4, -(-3 * count // 2)))
    middle, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(1j * np.pi / 2 * (1 + x))
    while True:
        block = np.random.default_rng(d).standard_normal((d, size))
        for _ in range(rounds):
            q = np.zeros_like(block)
            for t, weight in zip(turn, w):
                z = middle + radius * t
                q += weight / 2 * (radius * t * np.linalg.solve(z * np.eye(d) - v, block.astype(complex))).real
            q = np.linalg.qr(q)[0]
            e, u = np.linalg.eigh(q.T @ v @ q)  # of the small projected matrix: the Rayleigh-Ritz step
            block = q @ u
            inside = (e > low) & (e <= high)
            left = np.linalg.norm(v @ block - block * e, axis=0)
            if inside.sum() == count and left[inside].max() <= 2e-14 * scale:
                return e[inside], block[:, inside]
        if inside.sum() == count and left[inside].max() <= 1e-12 * scale:
            return e[inside], block[:, inside]
        if size == d:
            raise RuntimeError(f"{inside.sum()} eigenvalues found in ({low}, {high}], the inertia count is {count}")
        size = min(d, 2 * size)


def components(spark: SparkSession, v: np.ndarray, top: int = 32, per_slice: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; a Spark task for each slice of the spectrum."""
    if not len(v) or (todo := slices(v, top, per_slice)) == []:
        return np.zeros(0), np.zeros((len(v), 0))

    shared = spark.sparkContext.broadcast(v)  # d * d doubles, d is bounded

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                e, u = feast(shared.value, r["low"], r["high"], r["count"])
                yield pa.RecordBatch.from_pydict({"e": e.tolist(), "u": u.T.tolist()}, schema=pa.schema([("e", pa.float64()), ("u", pa.list_(pa.float64()))]))

    tasks = spark.createDataFrame(todo, "low double, high double, count long").repartition(len(todo))
    found = tasks.mapInArrow(solve, "e double, u array<double>").collect()
    q = np.linalg.qr(np.array([r["u"] for r in found]).T)[0]
    e, u = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(-e, kind="stable")[:top]
    u = q @ u[:, order]
    u = u / np.linalg.norm(u, axis=0)
    return e[order], u * np.where(u[np.abs(u).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """What is fitted: n, S, components as columns of u with eigenvalues e, the trace of V, and how far whitened rows are from
    unit covariance (`error`, set by `fit`)."""

    n: int
    s: list[int]
    e: np.ndarray
    u: np.ndarray
    trace: float
    error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(float) / self.n @ (self.u / np.sqrt(self.e))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: int64 where that holds it, else Python's whole numbers."""
        fits = self.n * max(1, int(np.abs(x).max(initial=0))) < 2**61
        kind = np.int64 if fits else object
        return x.astype(kind) * self.n - np.array(self.s, dtype=kind)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        off = self.scaled(x)
        most = int(np.abs(off).max(initial=0))
        out = (off * off).sum(axis=1).tolist() if most * most * max(1, off.shape[1]) < 2**63 else (off.astype(object) ** 2).sum(axis=1).tolist()
        return [v if v < 10**38 else None for v in out]


def whitened_covariance(rows: DataFrame, model: Whitening) -> np.ndarray:
    """Covariance (divisor n) of the whitened rows: tasks give their count, means and centred products, which are merged about the common mean."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                w = model.project(whole(b))
                own = w.mean(axis=0)
                total, step = n + len(w), own - mean
                m2 = m2 + (w - own).T @ (w - own) + np.outer(step, step) * (n * len(w) / total)
                mean, n = mean + step * (len(w) / total), total
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "m2": [m2.ravel().tolist()]}, schema=pa.schema([("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))]))

    k = len(model.e)
    n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
    for r in gathered(rows.select("c")).mapInArrow(add, "n long, mean array<double>, m2 array<double>").toLocalIterator():  # a row a task, of k * k numbers
        own = np.array(r["mean"])
        total, step = n + r["n"], own - mean
        m2 += np.array(r["m2"]).reshape(k, k) + np.outer(step, step) * (n * r["n"] / total)
        mean, n = mean + step * (r["n"] / total), total
    return m2 / n


def fit(rows: DataFrame, top: int = 32) -> Whitening:
    """rows: what usable() gives."""
    n, s = totals(rows)
    v = covariance(rows, n, s) if n else np.zeros((0, 0))
    e, u = components(rows.sparkSession, v, top)
    model = Whitening(n, s, e, u, float(np.trace(v)))
    if len(e):
        model.error = float(np.abs(whitened_covariance(rows, model) - np.eye(len(e))).max())
    return model


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened array<double>) of each row, components in order."""
    schema = pa.schema([("id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(b) if b.num_rows else np.zeros((0, len(model.s)), dtype=np.int64)
            w = model.project(x)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), pa.array(model.deviations(x), pa.decimal128(38, 0)), flat], schema=schema)

    return rows.mapInArrow(each, "id long, deviation decimal(38,0), whitened array<double>")


def whiten(rows: DataFrame, top: int = 32) -> DataFrame:
    """A row for each row and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    model = fit(rows, top)
    if not len(model.e):
        shown = rows.select("id", F.lit(0).alias("component"), F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("double").alias("whitened")).where("false")
        share = F.lit(None).cast("double")
    else:
        shown = apply(rows, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
        share = F.element_at(F.array(*[F.lit(float(x / model.trace)) for x in model.e]), F.col("component"))
    return shown.select("id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(model.error).cast("double").alias("identity_error"))
