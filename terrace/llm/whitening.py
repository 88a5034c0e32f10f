"""Embedding whitening by spectral divide and conquer on polar decompositions.

Spark reduces the vectors to sums and to a centred covariance, both of the size of one
vector squared.  That small symmetric matrix is taken apart by QDWH: the polar factor of the
shifted matrix, found by dynamically weighted Halley iterations, is its matrix sign;
(sign + I) / 2 projects on the invariant subspace above the shift; orthonormal bases of it
and of its complement split the problem in two, until blocks are single components.
The components are then sent to all tasks, which whiten the vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import checkpoint

EPS = np.finfo(np.float64).eps
#: Tasks' partial matrices that one group adds up.
FAN_IN = 64
#: Scaled entries are held within plus or minus this, so that sums of them stay exact.
LARGEST = 1 << 40


class Fit(NamedTuple):
    """``n`` vectors with per-dimension ``sums`` of floor(scale * c); components as columns, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    scale: int
    components: np.ndarray
    values: np.ndarray
    trace: float

    def shares(self) -> np.ndarray:
        """Each component's share of the whole variance; 0 where there is none."""
        return self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))


def polar_factor(a: np.ndarray, least: float) -> np.ndarray:
    """Orthogonal polar factor of a square ``a`` by QDWH; ``least``: a lower bound of its singular values over its norm."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low, one = min(max(least, EPS), 1.0), np.eye(n)
    for _ in range(30):
        gamma = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + gamma)
        weight = root + np.sqrt(max(8 - 4 * gamma + 8 * (2 - low**2) / (low**2 * root), 0.0)) / 2
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, one]))
            new = b / c * x + (weight - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        else:
            new = b / c * x + (weight - b / c) * np.linalg.solve(one + c * x.T @ x, x.T).T
        moved, x = np.linalg.norm(new - x), new
        low = min(low * (weight + b * low**2) / (1 + c * low**2), 1.0)
        if moved <= np.cbrt(5 * EPS) and abs(1 - low) <= 10 * EPS:
            break
    return x


def _projector(a: np.ndarray, shift: float) -> tuple[np.ndarray, int] | None:
    """Projector on the invariant subspace of ``a`` above ``shift`` and its rank; None where the shift splits nothing."""
    moved = a - shift * np.eye(len(a))
    norm = np.linalg.norm(moved)
    try:
        inverse = np.linalg.norm(np.linalg.inv(moved), 1)
    except np.linalg.LinAlgError:
        return None
    if not np.isfinite(inverse) or inverse * norm > 1e14:
        return None  # an eigenvalue lies at the shift
    sign = polar_factor(moved, 1 / (inverse * np.sqrt(len(a)) * norm))
    above = (sign + sign.T) / 4 + np.eye(len(a)) / 2
    rank = int(round(np.trace(above)))
    whole = np.linalg.norm(above @ above - above) <= 1e-10 * len(a)
    return (above, rank) if whole and 0 < rank < len(a) else None


def _bases(above: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range of a projector and of its complement, by subspace iteration with QR."""
    start = np.random.default_rng(len(above)).standard_normal(above.shape)
    first, _ = np.linalg.qr(above @ start[:, :rank])
    q, _ = np.linalg.qr(np.hstack([above @ first, start[:, rank:] - above @ start[:, rank:]]))
    q, _ = np.linalg.qr(np.hstack([above @ q[:, :rank], q[:, rank:] - above @ q[:, rank:]]))
    return q[:, :rank], q[:, rank:]


def spectral_split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, eigenvalues falling."""
    whole = (a + a.T) / 2
    size = np.linalg.norm(whole)
    values, vectors = [], []
    todo = [(whole, np.eye(len(a)))]
    while todo:
        block, basis = todo.pop()
        n = len(block)
        middle = np.trace(block) / n
        spread = np.linalg.norm(block - middle * np.eye(n))
        if n == 1 or spread <= 4 * EPS * size:
            # one eigenvalue, whose subspace any basis spans
            values += np.diag(block).tolist()
            vectors.append(basis)
            continue
        # the mean always lies between eigenvalues; the median splits more evenly
        shifts = [np.median(np.diag(block)), middle, *(middle + spread / np.sqrt(n) * np.array([0.011, -0.013, 0.17, -0.19, 0.37, -0.41]))]
        split = next((s for s in (_projector(block, x) for x in shifts) if s is not None), None)
        if split is None:
            split = _rounded_split(block, middle)
        for part in _bases(*split):
            todo.append((_symmetric(part.T @ block @ part), basis @ part))
    found, columns = np.array(values), np.hstack(vectors)
    columns = _polished(whole, columns)
    found = np.einsum("ij,ij->j", columns, whole @ columns)
    order = np.argsort(-found, kind="stable")
    return found[order], columns[:, order]


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def _rounded_split(block: np.ndarray, middle: float) -> tuple[np.ndarray, int]:
    """The split at the mean where eigenvalues lie within rounding of every shift: they go to either side."""
    n = len(block)
    sign = polar_factor(block - middle * np.eye(n), EPS)
    rank = min(max(int(round((np.trace(sign) + n) / 2)), 1), n - 1)
    return _symmetric(sign) / 2 + np.eye(n) / 2, rank


def _polished(a: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """One step of refinement of nearly exact eigenvectors: off-diagonal rests are rotated away where values lie apart."""
    rest = columns.T @ a @ columns
    off = np.eye(len(a)) - columns.T @ columns
    value = np.diag(rest) / (1 - np.diag(off))
    gap = value[None, :] - value[:, None]
    near = np.abs(gap) <= 2 * (np.linalg.norm(rest - np.diag(value)) + np.linalg.norm(a) * np.linalg.norm(off))
    turn = np.where(near, off / 2, (rest + value[None, :] * off) / np.where(near, 1, gap))
    out, _ = np.linalg.qr(columns + columns @ turn)
    return out * np.sign(np.einsum("ij,ij->j", out, columns))


def _scaled(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, whole numbers floor(scale * c)) of the vectors of ``dims`` finite components."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    right = (sizes == dims) & ~np.asarray(lists.is_null())
    flat = lists.values
    entries = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    entries = np.where(np.asarray(flat.is_null()), np.nan, entries)
    rows = np.flatnonzero(right)
    starts = lists.offsets.to_numpy()[:-1][rows]
    taken = entries[starts[:, None] + np.arange(dims)[None, :]]
    finite = np.isfinite(taken).all(axis=1)
    return rows[finite], np.clip(np.floor(scale * taken[finite]), -LARGEST, LARGEST)


def _sums(scale: int):
    """(dims, n, sums): one row for each length of vectors of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            column = batch.column("v")
            for dims in np.unique(np.diff(column.offsets.to_numpy())).tolist():
                rows, y = _scaled(column, dims, scale) if dims else ([], None)
                if len(rows):
                    old = total.setdefault(dims, [0, np.zeros(dims, np.int64)])
                    old[0] += len(rows)
                    old[1] += y.astype(np.int64).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.int64()))],
            ["dims", "n", "sums"],
        )

    return run


def _products(dims: int, scale: int, rows_of: Callable[[np.ndarray], np.ndarray]):
    """(task, row, values): the rows of the sum of z z^T over a task's vectors, z = ``rows_of`` them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            _, y = _scaled(batch.column("v"), dims, scale)
            z = rows_of(y)
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            task = pa.array(np.full(len(total), TaskContext.get().partitionId()), pa.int32())
            yield pa.RecordBatch.from_arrays([task, pa.array(np.arange(len(total)), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], ["task", "row", "values"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in table.column("values").to_pylist())
    return pa.table({"task": table.column("task")[:1], "row": table.column("row")[:1], "values": pa.array([total.tobytes()], pa.binary())})


def _product_sum(vectors: DataFrame, dims: int, scale: int, rows_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum of z z^T over all vectors, added up in a tree whose groups hold FAN_IN rows of partial matrices at most."""
    schema = "task int, row int, values binary"
    parts = checkpoint(vectors.mapInArrow(_products(dims, scale, rows_of), schema))
    tasks = (parts.agg(F.max("task").alias("t")).first()["t"] or 0) + 1
    while tasks > 1:
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("row", "task").applyInArrow(_added, schema)
        tasks = -(-tasks // FAN_IN)
    out = np.zeros((width, width))
    for row in parts.collect():  # one row a dimension
        out[row["row"]] = np.frombuffer(row["values"])
    return out


def _vectors(table: DataFrame, vector: str, *more: str) -> DataFrame:
    return table.select(*more, F.col(f"`{vector}`").cast("array<double>").alias("v"))


def fit(table: DataFrame, vector: str = "embedding", scale: int = 64, most: int = 32) -> Fit | None:
    """Components of the covariance of floor(scale * c) over all vectors of ``table``, ``most`` at most; None without vectors.

    Vectors null or with null or non-finite entries, and those of another length than
    most vectors have (ties: the longer), take no part.
    """
    vectors = _vectors(table, vector)
    parts = checkpoint(vectors.mapInArrow(_sums(scale), "dims int, n long, sums array<long>"))
    sizes = parts.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if sizes is None:
        return None
    dims, n = sizes["dims"], sizes["n"]
    sums = np.zeros(dims, np.int64)
    placed = parts.filter(F.col("dims") == dims).select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"))
    for row in placed.collect():  # one row a dimension
        sums[row["at"]] = row["s"]
    mean = sums / n
    covariance = _product_sum(vectors, dims, scale, lambda y: y - mean, dims) / n
    values, components = spectral_split(covariance)
    keep = min(most, dims)
    return Fit(n, sums, scale, components[:, :keep], values[:keep], float(np.trace(covariance)))


def _weights(model: Fit) -> np.ndarray:
    """Components over the square root of their eigenvalue; NaN for those without variance."""
    dims = len(model.sums)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(model.values > dims * EPS * max(model.trace, 0.0), model.components / np.sqrt(model.values), np.nan)


def identity_error(table: DataFrame, model: Fit, vector: str = "embedding") -> float:
    """Largest absolute entry of (covariance of the whitened vectors - identity), measured over all vectors of ``table``."""
    weights = _weights(model)
    weights = weights[:, ~np.isnan(weights).any(axis=0)]
    if not weights.shape[1]:
        return 0.0
    mean = model.sums / model.n
    got = _product_sum(_vectors(table, vector), len(mean), model.scale, lambda y: (y - mean) @ weights, weights.shape[1]) / model.n
    return float(np.abs(got - np.eye(len(got))).max())


def _whitened(model: Fit, weights: np.ndarray):
    mean, sums, n, dims = model.sums / model.n, model.sums, model.n, len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, y = _scaled(batch.column("v"), dims, model.scale)
            z = (y - mean) @ weights
            apart = n * y.astype(np.int64) - sums
            # a sum beyond a long is unknown
            large = (apart.astype(np.float64) ** 2).sum(axis=1) >= 2.0**63
            deviation = pa.array((apart * apart).sum(axis=1), pa.int64(), mask=large)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), deviation, lists], ["id", "deviation", "whitened"])

    return run


def whitened(table: DataFrame, model: Fit | None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, deviation, whitened): the whitened components of each vector, as an array by falling eigenvalue.

    ``deviation`` is the exact sum over dimensions of (n * x - S)^2, null beyond a long.

    Defined cases: vectors that take no part in ``fit`` have no row, nor has any without a model or
    in an empty table; null and repeated ids are kept as they are; a component without variance is
    whitened to NaN; scaled entries beyond 2**40 count as that; equal eigenvalues have any
    orthonormal components; further columns are ignored, whatever their names.
    """
    rows = _vectors(table, vector, F.col(f"`{key}`").cast("long").alias("id"))
    schema = "id long, deviation long, whitened array<double>"
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_whitened(model, _weights(model)), schema)
