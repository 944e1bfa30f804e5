"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

1. Entries become integers, x = floor(64 c) + 1000000. Tasks add up their vectors; the sums of all tasks meet in one row
   a vector length.
2. Each task multiplies its vectors, centred by the whole number nearest the mean, and keeps one sum a pair of
   dimensions. The sums are exact: products run in doubles only where no sum can reach 2**53, and in Python's integers
   elsewhere. Row i of the scatter is added up in a group of its own, which gets one row a task. What the
   rounded centre leaves is taken off in integers, so the scatter n*sum(y y') - sum(y) sum(y)' has no rounding at all.
3. One task a vector length factors the scatter (d x d, bounded by the vectors' length, whatever the number of rows) into
   L L' with diagonal pivoting, which also finds the rank, and rotates pairs of L's columns until all are orthogonal. The
   squares of their lengths are the eigenvalues, the columns scaled to 1 the components.
4. Every vector is projected; the covariance of what comes out is added up in the same way and compared with the identity.

Rows whose vector is null or holds null or non-finite entries are dropped, empty vectors have no components. Vectors of
different lengths are lists of their own, each with its own fit. Directions without variance are no components, so a list
of equal vectors gives no rows. Equal rows count as often as they stand there. An empty table gives no rows. Extra columns
are not read. ``deviation`` is null where it does not fit a long. Entries beyond 2**56 count as 2**56.

Only the fitted model, at most ``most`` components of each vector length, passes the driver on its way to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common

# How entries become integers.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
_LARGEST = 2.0**56
_EXACT = 2.0**53


def usable_vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors as doubles) of each length in a batch, without unusable rows."""
    values = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(values.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        vectors = flat[first[rows, None] + np.arange(dim)]
        good = np.isfinite(vectors).all(axis=1)
        if good.any():
            yield dim, rows[good], vectors[good]


def whole(vectors: np.ndarray) -> np.ndarray:
    """x of every entry, as int64."""
    return np.clip(np.floor(SCALE * vectors), -_LARGEST, _LARGEST).astype(np.int64) + OFFSET


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y of whole numbers as Python integers, exact."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    most = float(np.abs(y).max(initial=0)) ** 2
    if most >= _EXACT:
        wide = y.astype(object)
        return wide.T @ wide
    step = max(1, int((_EXACT - 1) // max(most, 1)))
    for lo in range(0, len(y), step):
        part = y[lo : lo + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _strings(rows: np.ndarray) -> pa.Array:
    return pa.array([[str(v) for v in row] for row in rows], pa.list_(pa.string()))


_SUMS = "dim int, i int, n bigint, sums array<string>"


def _added(rows: DataFrame) -> DataFrame:
    """One row for each (dim, i): the sums of the tasks' whole numbers, as text, which knows no overflow."""

    def add(table: pa.Table) -> pa.Table:
        total = sum((np.array([int(v) for v in row], object) for row in table["sums"].to_pylist()), 0)
        n = sum(table["n"].to_pylist())
        return pa.table([table["dim"][:1], table["i"][:1], pa.array([n]), _strings([total])], ["dim", "i", "n", "sums"])

    return rows.groupBy("dim", "i").applyInArrow(add, _SUMS)


def totals(vectors: DataFrame) -> DataFrame:
    """(dim, i = -1, n, sums): the number of usable vectors of each length, and the sum of each x."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for dim, _, found in usable_vectors(batch.column(0)):
                of = total.setdefault(dim, [0, np.zeros(dim, object)])
                of[0] += len(found)
                # halves of 32 bits, so that no sum of a batch overflows
                x = whole(found)
                of[1] += ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        for dim, (n, sums) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([-1], pa.int32()), pa.array([n]), _strings([sums])], ["dim", "i", "n", "sums"])

    return _added(vectors.mapInArrow(task, _SUMS))


def scatter(vectors: DataFrame, centre: dict[int, np.ndarray]) -> DataFrame:
    """(dim, i, n, sums): row i of the sum of y y' over the usable vectors, y = x - centre; d rows a task and length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for dim, _, found in usable_vectors(batch.column(0)):
                of = total.setdefault(dim, [0, np.zeros((dim, dim), object)])
                of[0] += len(found)
                of[1] += exact_products(whole(found) - centre[dim])
        for dim, (n, sums) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array(np.arange(dim), pa.int32()), pa.array([n] * dim, pa.int64()), _strings(sums)], ["dim", "i", "n", "sums"]
            )

    return _added(vectors.mapInArrow(task, _SUMS))


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (d x rank) with L L' = a, rows in a's order; lower triangular once rows are put in the order of the pivots.

    Each step takes the largest remaining diagonal entry; it ends where that is rounding noise.
    """
    d = len(a)
    left = a.copy()
    scale = float(np.diag(a).max(initial=0.0))
    columns, live = [], np.ones(d, bool)
    for _ in range(d):
        diagonal = np.where(live, np.diag(left), -np.inf)
        p = int(diagonal.argmax())
        if not diagonal[p] > 4 * d * np.finfo(float).eps * scale:
            break
        column = np.where(live, left[:, p], 0.0) / np.sqrt(diagonal[p])
        columns.append(column)
        left -= np.outer(column, column)
        live[p] = False
    return np.stack(columns, axis=1) if columns else np.zeros((d, 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """``factor`` with its columns rotated until they are orthogonal: norms squared are eigenvalues of factor factor'.

    Columns meet in pairs as players in a round robin, so every round rotates disjoint pairs at once.
    """
    w = factor.copy()
    r = w.shape[1]
    if r < 2:
        return w
    seats = np.arange(r + r % 2)  # an odd number leaves one seat, `r`, empty
    tolerance = np.finfo(float).eps * np.sqrt(len(w))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = seats[:half], seats[half:][::-1]
            there = (p < r) & (q < r)
            p, q = p[there], q[there]
            a, b = w[:, p], w[:, q]
            alpha, beta, gamma = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            act = np.abs(gamma) > tolerance * np.sqrt(alpha * beta)
            if act.any():
                turned = True
                p, q, a, b = p[act], q[act], a[:, act], b[:, act]
                zeta = (beta[act] - alpha[act]) / (2 * gamma[act])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                c = 1 / np.sqrt(1 + t * t)
                w[:, p], w[:, q] = c * a - c * t * b, c * t * a + c * b
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    return w


def components(numerator: list[list[int]], n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(components in columns, eigenvalues falling, trace) of ``numerator`` / n**2, an exact covariance."""
    exact = np.array(numerator, object)
    size = max((abs(v) for v in np.diag(exact)), default=0)
    scaled = np.array([[v / size if size else 0.0 for v in row] for row in exact])
    w = one_sided_jacobi(pivoted_cholesky(scaled))
    value = (w * w).sum(axis=0)
    order = np.argsort(-value, kind="stable")[:most]
    unit = size / n**2
    return w[:, order] / np.sqrt(value[order]), value[order] * unit, float(sum(np.diag(exact)) / n**2)


class Model:
    """What the tasks need of one vector length: n, sums S, whole centre, components, eigenvalues, trace."""

    def __init__(self, n: int, sums: list[int], centre: list[int], directions: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.centre = n, np.array(sums, object), np.array(centre, np.int64)
        self.directions, self.values, self.trace = directions, values, trace
        self.rest = np.array([(s - n * c) / n for s, c in zip(sums, centre, strict=True)])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(np.float64) - self.rest) @ self.directions / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of (n x - S)**2, exact; null beyond a long."""
        y = x - self.centre
        rest = self.sums - self.n * self.centre.astype(object)
        bound = self.n * float(np.abs(y).max(initial=0)) + float(max(abs(v) for v in rest))
        if bound * bound * x.shape[1] < 2.0**62:
            z = self.n * y - rest.astype(np.int64)
            return pa.array((z * z).sum(axis=1), pa.int64())
        z = self.n * y.astype(object) - rest
        return pa.array([v if v < 2**63 else None for v in (z * z).sum(axis=1)], pa.int64())


def fit(vectors: DataFrame, most: int = COMPONENTS) -> dict[int, Model]:
    """The models by vector length of ``vectors`` (one array column)."""
    spark = common.ready(vectors.sparkSession)
    first = common.stage(totals(vectors), "vector-totals")
    found = {r.dim: (r.n, [int(v) for v in r.sums]) for r in first.toLocalIterator()}
    if not found:
        return {}
    centre = {dim: [round_half(s, n) for s in sums] for dim, (n, sums) in found.items()}
    sent = spark.sparkContext.broadcast({dim: np.array(c, np.int64) for dim, c in centre.items()})
    rows = scatter(vectors, _Sent(sent)).unionByName(first)

    def solve(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        sums = {i: [int(v) for v in row] for i, row in zip(table["i"].to_pylist(), table["sums"].to_pylist(), strict=True)}
        n = table["n"][0].as_py()
        left = [s - n * c for s, c in zip(sums[-1], sent.value[dim].tolist(), strict=True)]
        numerator = [[n * sums[i][j] - left[i] * left[j] for j in range(dim)] for i in range(dim)]
        directions, values, trace = components(numerator, n, most)
        lists = [pa.array([v], pa.list_(pa.float64())) for v in (directions.ravel().tolist(), values.tolist())]
        return pa.table([pa.array([dim], pa.int32()), *lists, pa.array([trace])], ["dim", "directions", "e", "trace"])

    solved = rows.groupBy("dim").applyInArrow(solve, "dim int, directions array<double>, e array<double>, trace double")
    models = {}
    for r in solved.toLocalIterator():
        n, sums = found[r.dim]
        models[r.dim] = Model(n, sums, centre[r.dim], np.array(r.directions).reshape(r.dim, len(r.e)), np.array(r.e), r.trace)
    return models


def round_half(s: int, n: int) -> int:
    return (2 * s + n) // (2 * n)


class _Sent:
    """A broadcast dictionary, read by key in the tasks."""

    def __init__(self, sent):
        self.sent = sent

    def __getitem__(self, key):
        return self.sent.value[key]


def identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """By vector length: the largest entry of (covariance of the whitened vectors - identity), as it comes out of the data."""
    if not models:
        return {}
    sent = vectors.sparkSession.sparkContext.broadcast(models)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, found in usable_vectors(batch.column(0)):
                w = sent.value[dim].whiten(whole(found))
                w = np.concatenate([np.ones((len(w), 1)), w], axis=1)
                total[dim] = total.get(dim, 0) + w.T @ w
        for dim, sums in total.items():
            i = np.arange(len(sums))
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(sums), pa.int32()), pa.array(i, pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], ["dim", "i", "sums"])

    each = vectors.mapInArrow(task, "dim int, i int, sums array<double>").select("dim", "i", F.posexplode("sums").alias("j", "s"))
    sums = each.groupBy("dim", "i", "j").agg(F.sum("s").alias("s"))
    mean = sums.where("i = 0 AND j > 0").select("dim", "j", F.col("s").alias("m"))
    pairs = sums.where("i > 0 AND j > 0").join(F.broadcast(mean), ["dim", "j"]).join(F.broadcast(mean.select("dim", F.col("j").alias("i"), F.col("m").alias("o"))), ["dim", "i"])
    n = F.element_at(F.create_map(*[F.lit(v) for dim, m in models.items() for v in (dim, m.n)]), F.col("dim"))
    off = F.abs(F.col("s") / n - F.col("m") / n * (F.col("o") / n) - (F.col("i") == F.col("j")).cast("double"))
    return {r.dim: r.e for r in pairs.groupBy("dim").agg(F.max(off).alias("e")).collect()}


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each usable vector and component."""
    spark = common.ready(rows.sparkSession)
    vectors = rows.select(F.col(vector_col).alias("v"))
    models = fit(vectors, most)
    errors = identity_errors(vectors, models)
    sent = spark.sparkContext.broadcast((models, errors))
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, errors = sent.value
        for batch in batches:
            for dim, at, found in usable_vectors(batch.column(1)):
                model = models[dim]
                x, k = whole(found), len(model.values)
                if not k:
                    continue
                each = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                        pa.array(np.full(k * len(at), model.n), pa.int64()),
                        model.deviation(x).take(each),
                        pa.array(model.whiten(x).ravel()),
                        pa.array(np.tile(model.values / model.trace, len(at))),
                        pa.array(np.full(k * len(at), errors[dim])),
                    ],
                    names,
                )

    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return rows.select(id_col, vector_col).mapInArrow(project, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings"))
