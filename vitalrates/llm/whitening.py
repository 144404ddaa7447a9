"""Whitening of embeddings by a covariance recovered from variances alone (polarisation), in exact whole numbers.

Entries c become x = floor(1024 c) + 100000. With n vectors and sums S, y = n x - S is centred and whole. One scan adds
up n and S, the next the squares of every y_i and of every sum y_i + y_j, without rounding: a square is split into limbs
whose products fit 64 bits, and a task emits its total of each pair once. Half of Var(i + j) - Var(i) - Var(j) is the
covariance, so the only rounding before the eigenvectors is one division per entry. The driver holds what the number of
dimensions fixes: the covariance and its eigenvectors, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: |floor(1024 c)| up to here is a whole number that doubles and longs hold; a larger entry counts as not finite.
LARGEST = 2.0**61
LIMB = 24
ROWS = 1 << 14
PART, PARTS = 40, 6


def whole_vectors(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow list column: the rows that count, their lengths, and their x one after the other."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    here = np.flatnonzero(np.asarray(pc.is_valid(column)))
    column = column.take(pa.array(here))
    lengths = np.asarray(pc.list_value_length(column)).astype(np.int64)
    flat = column.flatten()
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(flat.cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE)  # NULL entries become NaN
        good = np.abs(x) <= LARGEST
    owner = np.repeat(np.arange(len(here)), lengths)
    bad = np.zeros(len(here), bool)
    bad[owner[~good]] = True
    keep = ~bad[owner]
    return here[~bad], lengths[~bad], x[keep].astype(np.int64) + SHIFT


def _of_length(batch, dim: int, column: int) -> tuple[np.ndarray, np.ndarray]:
    rows, lengths, x = whole_vectors(batch.column(column))
    own = lengths == dim
    return rows[own], x[np.repeat(own, lengths)].reshape(-1, dim)


def vector_sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """(dimensions, n, sums) of the vectors that count; with several lengths, of the commonest (on a tie the longest)."""

    def added(batches) -> Iterator:
        import pyarrow as pa

        totals: dict[int, list] = {}
        for batch in batches:
            _, lengths, x = whole_vectors(batch.column(0))
            for dim in np.unique(lengths[lengths > 0]):
                own = x[np.repeat(lengths == dim, lengths)].reshape(-1, dim)
                total = totals.setdefault(int(dim), [0, [0] * int(dim)])
                total[0] += len(own)
                low, high = (own & 0xFFFFFFFF).sum(axis=0), (own >> 32).sum(axis=0)
                total[1] = [t + int(a) + (int(b) << 32) for t, a, b in zip(total[1], low, high)]
        for dim, (n, sums) in totals.items():
            # Position -1 counts the vectors; sums travel in two parts, which longs can add up over any number of tasks.
            at, values = [-1, *range(dim)], [n, *sums]
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([dim] * len(at), pa.int32()), "at": pa.array(at, pa.int32()),
                "low": pa.array([v & ((1 << PART) - 1) for v in values], pa.int64()),
                "high": pa.array([v >> PART for v in values], pa.int64()),
            })

    parts = vectors.mapInArrow(added, "dim int, at int, low long, high long")
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("dim", "at").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).collect():
        found.setdefault(r["dim"], {})[r["at"]] = r["low"] + (r["high"] << PART)
    if not found:
        return 0, 0, []
    dim = max(found, key=lambda d: (found[d][-1], d))
    return dim, found[dim][-1], [found[dim][i] for i in range(dim)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S exactly: longs when they hold it and a sum of two, else Python's whole numbers."""
    if x.size:
        low, high = x.min(axis=0), x.max(axis=0)
        most = max(max(abs(n * int(a) - s), abs(n * int(b) - s)) for a, b, s in zip(low, high, sums))
        if most >= 1 << 61:
            return x.astype(object) * n - np.array(sums, dtype=object)
    base = [s // n for s in sums]
    return (x - np.array(base, np.int64)) * n - np.array([s - n * b for s, b in zip(sums, base)], np.int64)


def square_sums(z: np.ndarray) -> list[int]:
    """Exact sum of squares of every column, for at most ROWS rows."""
    if z.dtype == object:
        return [int(v) for v in (z * z).sum(axis=0)] if len(z) else [0] * z.shape[1]
    z = np.abs(z)
    limbs = []
    rest = int(z.max(initial=0)).bit_length()
    while rest > 0:
        limbs.append(z & ((1 << LIMB) - 1))
        z, rest = z >> LIMB, rest - LIMB
    total = [0] * z.shape[1]
    for a in range(len(limbs)):
        for b in range(a, len(limbs)):
            products = np.einsum("ij,ij->j", limbs[a], limbs[b])
            shift = LIMB * (a + b) + (a != b)
            total = [t + (int(p) << shift) for t, p in zip(total, products)]
    return total


def _parts(values: list[int]) -> list[list[int]]:
    mask = (1 << PART) - 1
    return [[(v >> (PART * k)) & mask for v in values] for k in range(PARTS - 1)] + [[v >> (PART * (PARTS - 1)) for v in values]]


def polarised_covariance(vectors: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance (divisor n) from the exact sums of (y_i)^2 and (y_i + y_j)^2."""

    def squares(batches) -> Iterator:
        import pyarrow as pa

        total = [[0] * (dim - i) for i in range(dim)]
        held: list[np.ndarray] = []

        def add() -> None:
            y = centred(np.concatenate(held), n, sums)
            for i in range(dim):
                z = y[:, i:] + y[:, i : i + 1]
                z[:, 0] = y[:, i]  # the variance itself stands where a dimension would meet itself
                total[i] = [t + s for t, s in zip(total[i], square_sums(z))]
            held.clear()

        for batch in batches:
            _, x = _of_length(batch, dim, 0)
            for k in range(0, len(x), ROWS):
                piece = x[k : k + ROWS]
                if held and sum(map(len, held)) + len(piece) > ROWS:
                    add()
                held.append(piece)
        if held:
            add()
        for i in range(dim):
            parts = _parts(total[i])
            yield pa.RecordBatch.from_pydict({
                "i": pa.array([i] * (dim - i), pa.int32()), "j": pa.array(range(i, dim), pa.int32()),
                **{f"p{k}": pa.array(p, pa.int64()) for k, p in enumerate(parts)},
            })

    names = [f"p{k}" for k in range(PARTS)]
    parts = vectors.mapInArrow(squares, "i int, j int, " + ", ".join(f"{p} long" for p in names))
    summed = parts.groupBy("i", "j").agg(*[F.sum(p).alias(p) for p in names])
    squared = {(r["i"], r["j"]): sum(r[p] << (PART * k) for k, p in enumerate(names)) for r in summed.toLocalIterator()}
    out = np.zeros((dim, dim))
    for (i, j), s in squared.items():
        twice = 2 * s if i == j else s - squared[i, i] - squared[j, j]
        out[i, j] = out[j, i] = twice / (2 * n**3)  # whole numbers: rounded once
    return out


@dataclass
class Whitening:
    """What the fit found: n vectors with `sums`, and the leading eigenvectors (columns) with their eigenvalues."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def defined(self) -> np.ndarray:
        """Components with a variance above rounding; the others cannot be brought to unit variance."""
        return self.values > self.trace * 1e-13 * max(self.dim, 1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN for a component without variance."""
        scale = np.where(self.defined, np.sqrt(np.where(self.defined, self.values, 1.0)), np.nan)
        return (centred(x, self.n, self.sums).astype(float) / self.n) @ self.vectors / scale


def fit_whitening(embeddings: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding") -> Whitening | None:
    """Eigenvectors of the covariance of all vectors that count, or None when there is none (or only empty ones)."""
    vectors = embeddings.select(F.col(vector_col).cast("array<double>").alias("v"))
    dim, n, sums = vector_sums(vectors)
    if not dim:
        return None
    covariance = polarised_covariance(vectors, dim, n, sums)
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1][:components].copy(), columns[:, ::-1][:, :components].copy()
    columns *= np.where(columns[np.abs(columns).argmax(axis=0), np.arange(columns.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, sums, columns, values, float(np.trace(covariance)))


def identity_error(embeddings: DataFrame, fit: Whitening, vector_col: str = "embedding") -> float | None:
    """Largest absolute entry of (covariance of the whitened rows - identity), measured on the rows in one scan."""
    count = int(fit.defined.sum())
    if not count:
        return None

    def products(batches) -> Iterator:
        import pyarrow as pa

        total = np.zeros((count + 1, count + 1))
        for batch in batches:
            _, x = _of_length(batch, fit.dim, 0)
            w = np.column_stack([fit.projected(x)[:, fit.defined], np.ones(len(x))])
            total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "s": pa.array(total.ravel(), pa.float64()),
        })

    rows = embeddings.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(products, "i int, j int, s double")
    gram = np.zeros((count + 1, count + 1))
    for r in rows.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        gram[r["i"], r["j"]] = r["s"] / fit.n
    mean = gram[count, :count]
    return float(np.abs(gram[:count, :count] - np.outer(mean, mean) - np.eye(count)).max())


SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
    "deviation_digits string"
)


def whitened(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector that counts and component: vec_id, component, n, deviation, whitened, explained, identity_error,
    deviation_digits.

    Dropped: NULL vectors, vectors with NULL, NaN, infinite entries or entries beyond LARGEST / 1024, and, where lengths
    differ, vectors of another length than the commonest (on a tie the longest). Repeated rows and NULL ids count like
    others. `deviation` is NULL where no long holds it; `deviation_digits` always has it in decimal digits. A component
    without variance (equal vectors, fewer vectors than dimensions) has whitened NULL and does not enter identity_error.
    Empty vectors have no component and are not counted; empty tables give no rows. Vectors of fewer than `components` dimensions give fewer components.
    Other columns of the input are ignored. Equal eigenvalues leave their eigenvectors free within their plane.
    """
    spark = embeddings.sparkSession
    fit = fit_whitening(embeddings, components, vector_col)
    if fit is None:
        return spark.createDataFrame([], SCHEMA)
    error = identity_error(embeddings, fit, vector_col)
    explained = [None if fit.trace <= 0 else max(float(v), 0.0) / fit.trace for v in fit.values]

    def shown(batches) -> Iterator:
        import pyarrow as pa

        width = len(fit.values)
        for batch in batches:
            rows, x = _of_length(batch, fit.dim, 1)
            y = centred(x, fit.n, fit.sums)
            if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * fit.dim >= 1 << 63:
                y = y.astype(object)
            deviation = [int(d) for d in (y * y).sum(axis=1)] if len(y) else []
            w = fit.projected(x).ravel()
            ids = batch.column(0).take(pa.array(np.repeat(rows, width)))
            fitting = [d if d < 1 << 63 else None for d in deviation]
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(rows)), pa.int32()),
                pa.array(np.full(len(ids), fit.n), pa.int64()),
                pa.array([d for d in fitting for _ in range(width)], pa.int64()),
                pa.array(w, pa.float64(), from_pandas=True), pa.array(explained * len(rows), pa.float64()),
                pa.array([error] * len(ids), pa.float64()),
                pa.array([str(d) for d in deviation for _ in range(width)], pa.string()),
            ], names=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    both = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return both.mapInArrow(shown, SCHEMA)
