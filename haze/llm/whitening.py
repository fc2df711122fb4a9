"""Whitening of embeddings by principal components found without a library eigensolver.

1. Each entry c becomes the integer ``x = floor(64 c) + 1000000``.  The fit list holds every distinct
   x vector once, so copies weigh nothing.
2. Its sums S and centred covariance are gathered as one small matrix per task and added up by Spark.
3. On the driver, on that d x d matrix alone: Householder reflections make it tridiagonal, counts of
   sign changes (Sturm) bisect the leading eigenvalues, inverse iteration gives their vectors, made
   orthogonal again inside clusters of close eigenvalues, and the reflections turn them back.
4. The projection (d x ``COMPONENTS`` numbers) is broadcast and applied to every row.

The driver holds d x d numbers whatever the number of rows; the broadcast d x ``COMPONENTS``.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries are left out, as are rows
whose vector is not of the table's commonest length; repeated rows and copies count once in the
fit and each get their own result; components whose variance is zero within rounding have no whitened
value and are left out, so a table with one distinct vector, or an empty one, gives no rows; equal
eigenvalues get any orthonormal vectors of their space; other columns, whatever their names, are not read.
Entries beyond 64-bit integers, and sums of squares beyond them, raise an overflow error instead of a wrong number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haze.llm._vectors import common_length, finite, matrix
from haze.session import ship_package, written

COMPONENTS = 16
CLUSTER = 1e-3  # eigenvalues closer than this share of the norm are made orthogonal to each other
ROUNDS = 5
EPS = np.finfo(float).eps


# The eigensolver: plain functions on one small matrix.

def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflection vectors that bring a symmetric matrix to tridiagonal form."""
    a = np.array(a, float)
    d = len(a)
    turns: list[np.ndarray] = []
    for k in range(d - 2):
        x = a[k + 1:, k]
        size = np.linalg.norm(x)
        v = x.copy()
        v[0] += size if x[0] >= 0 else -size
        length = np.linalg.norm(v)
        v = v / length if length > 0 else v
        turns.append(v)
        if length > 0:
            rest = a[k + 1:, k + 1:]
            p = 2.0 * (rest @ v)
            w = p - (p @ v) * v
            rest -= np.outer(v, w) + np.outer(w, v)
            a[k + 1, k] = a[k, k + 1] = x[0] - 2.0 * v[0] * (v @ x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), turns


def sturm_count(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are smaller than each of ``at``."""
    least = np.finfo(float).tiny * max(1.0, float(np.abs(off).max(initial=0.0)) ** 2)
    count = np.zeros(len(at), int)
    q = np.ones(len(at))
    for i, x in enumerate(diag):
        q = x - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until its interval has no inner double."""
    d = len(diag)
    beside = np.zeros(d)
    beside[:-1] += np.abs(off)
    beside[1:] += np.abs(off)
    wanted = np.arange(d, d - k, -1)  # the i-th smallest: at least i eigenvalues lie below its upper end
    low = np.full(k, (diag - beside).min() - 1.0)
    high = np.full(k, (diag + beside).max() + 1.0)
    while True:
        mid = (low + high) / 2
        if not np.any((mid > low) & (mid < high)):
            return mid
        up = sturm_count(diag, off, mid) >= wanted
        high, low = np.where(up, mid, high), np.where(up, low, mid)


def _solve(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """x of (T - shift) x = b by elimination with row exchanges."""
    d = len(diag)
    least = EPS * max(np.abs(diag).max(), np.abs(off).max(initial=0.0), 1e-300)
    main, up, up2, y = diag - shift, np.append(off, 0.0), np.zeros(d), b.copy()
    for i in range(d - 1):
        below = off[i]
        if abs(main[i]) >= abs(below):
            main[i] = main[i] if abs(main[i]) > least else least
            f = below / main[i]
            main[i + 1] -= f * up[i]
            y[i + 1] -= f * y[i]
        else:
            f = main[i] / below
            main[i], up_i, main_next = below, main[i + 1], up[i] - f * main[i + 1]
            up2[i] = up[i + 1]
            up[i + 1] = -f * up[i + 1]
            up[i], main[i + 1] = up_i, main_next
            y[i], y[i + 1] = y[i + 1], y[i] - f * y[i + 1]
    if abs(main[-1]) <= least:
        main[-1] = least
    x = np.zeros(d)
    for i in range(d - 1, -1, -1):
        s = y[i]
        if i + 1 < d:
            s -= up[i] * x[i + 1]
        if i + 2 < d:
            s -= up2[i] * x[i + 2]
        x[i] = s / main[i]
    return x


def inverse_iteration(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, one row per value; those of a cluster are kept orthogonal to each other."""
    norm = max(np.abs(diag).max(), np.abs(off).max(initial=0.0), 1e-300)
    rng = np.random.default_rng(7)  # start vectors only: any start with a part along the answer gives it
    out = np.zeros((len(values), len(diag)))
    begin, shift = 0, None
    for k, e in enumerate(values):
        if k and values[k - 1] - e > CLUSTER * norm:
            begin = k
        shift = min(e, shift - 10 * EPS * norm) if k > begin else e  # equal values are told apart a little
        x = rng.standard_normal(len(diag))
        for _ in range(ROUNDS):
            x /= np.linalg.norm(x)
            x = _solve(diag, off, shift, x)
            x /= np.abs(x).max()
            for _ in range(2):
                for j in range(begin, k):
                    x -= (out[j] @ x) * out[j]
        out[k] = x / np.linalg.norm(x)
    return out


def leading_components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as rows) of the ``k`` largest eigenvalues of a symmetric matrix."""
    diag, off, turns = householder(cov)
    values = leading_values(diag, off, k)
    vectors = inverse_iteration(diag, off, values)
    for i in range(len(turns) - 1, -1, -1):
        part = vectors[:, i + 1:]
        part -= 2.0 * np.outer(part @ turns[i], turns[i])
    return values, vectors


# The distributed part.

def integers(rows: DataFrame, vector: str, keep: list[str]) -> tuple[DataFrame, int]:
    """``keep`` and x (array of longs) of the rows that count, and the vector length."""
    good = rows.where(finite(vector))
    d = common_length(good, vector)
    x = F.transform(vector, lambda c: F.floor(64 * c.cast("double")) + F.lit(1_000_000))
    return good.where(F.size(vector) == d).select(*keep, x.cast("array<bigint>").alias("x")), d


def _totals(parts: DataFrame, d: int, kind: str) -> np.ndarray:
    """The sum of the rows (i, values) of all tasks, as a matrix with d columns."""
    cells = parts.select("i", F.posexplode("values").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((max((r["i"] for r in cells), default=0) + 1, d), kind)
    for r in cells:
        out[r["i"], r["j"]] = r["v"]
    return out


def sums(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Rows and per-dimension sums of the x vectors, exact."""
    def gather(batches):
        n, total = 0, np.zeros(d, np.int64)
        for b in batches:
            x = matrix(b.column("x"), d)
            n, total = n + len(x), total + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([total.tolist(), [n] + [0] * (d - 1)], pa.list_(pa.int64()))],
                                         ["i", "values"])

    found = _totals(fit.select("x").mapInArrow(gather, "i int, values array<bigint>"), d, "int64")
    return (int(found[1, 0]), found[0]) if len(found) > 1 else (0, np.zeros(d, np.int64))


def centred_covariance(rows: DataFrame, d: int, n: int, centred) -> np.ndarray:
    """Mean of the outer products of ``centred(x matrix)``, one small matrix from each task."""
    def gather(batches):
        total = None
        for b in batches:
            y = centred(matrix(b.column("x"), d))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))],
                                             ["i", "values"])

    k = centred(np.zeros((1, d), np.int64)).shape[1]
    found = _totals(rows.select("x").mapInArrow(gather, "i int, values array<double>"), k, "float64")
    return found / n


def whitened(rows: DataFrame, vector: str = "embedding", keep: list[str] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """``keep``, n, deviation, whitened (array, one entry a component), explained (likewise) and identity_error
    of every row that counts."""
    spark = rows.sparkSession
    ship_package(spark)
    keep = list(keep)
    x, d = integers(rows, vector, keep)
    x = written(x, "wh-rows")
    fit = written(x.select("x").distinct(), "wh-fit")
    n, total = sums(fit, d) if d else (0, np.zeros(0, np.int64))
    blank = x.limit(0).select(*keep, F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("deviation"),
                              *[F.lit(None).cast(t).alias(c) for c, t in (("whitened", "array<double>"), ("explained", "array<double>"),
                                                                          ("identity_error", "double"))])
    if not n:
        return blank

    def centre(m: np.ndarray) -> np.ndarray:
        return (n * m - total) / n  # the difference is exact

    cov = centred_covariance(fit, d, n, centre)
    trace = float(np.trace(cov))
    values, vectors = leading_components(cov, min(components, d))
    some = values > 8 * d * EPS * trace
    values, vectors = values[some], vectors[some]
    if not len(values):
        return blank
    shared = spark.sparkContext.broadcast((vectors / np.sqrt(values)[:, None]).T)

    def project(m: np.ndarray) -> np.ndarray:
        return centre(m) @ shared.value

    # the whitened fit list has mean zero but for rounding; it is taken off all the same
    def mean_gather(batches):
        s = np.zeros(len(values))
        for b in batches:
            s += project(matrix(b.column("x"), d)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([s.tolist()], pa.list_(pa.float64()))], ["i", "values"])

    mean = _totals(fit.select("x").mapInArrow(mean_gather, "i int, values array<double>"), len(values), "float64")[0] / n
    after = centred_covariance(fit, d, n, lambda m: project(m) - mean)
    error = float(np.abs(after - np.eye(len(values))).max())
    explained = (values / trace).tolist()
    limit = np.iinfo(np.int64).max

    def apply(batches):
        for b in batches:
            m = matrix(b.column("x"), d)
            far = n * m - total
            rough = (far.astype(float) ** 2).sum(axis=1)
            if len(rough) and rough.max() > 0.99 * limit:
                raise OverflowError("deviation is beyond 64-bit integers")
            w = project(m)
            lists = lambda a: pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * len(values), pa.array(a.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(np.full(len(m), n)), pa.array((far * far).sum(axis=1)), lists(w),
                 lists(np.tile(explained, (len(m), 1))), pa.array(np.full(len(m), error))],
                [*keep, "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(apply, blank.schema)


def long_form(rows: DataFrame, keep: list[str] = ("vec_id",)) -> DataFrame:
    """One row per row and component: ``keep``, component, n, deviation, whitened, explained, identity_error."""
    both = F.arrays_zip("whitened", "explained")
    return rows.select(*keep, "n", "deviation", "identity_error", F.posexplode(both).alias("at", "c")).select(
        *keep, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
