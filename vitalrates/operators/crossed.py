"""Logistic regression with crossed random intercepts of many levels, by conjugate gradients over the rows.

Factors need not be nested: a young may meet any observer. Eliminating levels would then fill the system, so nothing is
eliminated. A scan adds up products of the system with a block of vectors: tasks score their rows in Arrow batches and
emit one line per level they met. Newton steps solve by conjugate gradients, preconditioned by the fixed effects' block
and the diagonal, and the log-determinant is a Lanczos quadrature over seeded random signs, all of them in one block.
The driver holds vectors as long as the levels of all factors together, at most `LOOKUP_MAX_ROWS`; rows never leave the
executors. With more levels the largest factor is eliminated exactly: rows are dealt by its levels, so a task holds all
rows of a level and takes it out of every product on its own. The rows are stored once and a step stores the effects of the
eliminated factor alone; tasks add up many chunks before they emit lines, and each shuffle is removed with its query. The
driver then holds the other factors only, at most `KEPT_LEVELS`. Levels of the largest factor above 1 % of the rows are
kept on the driver as well, so their rows may lie in any task.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.operators.joins import attach_small, hot_keys
from vitalrates.session import LOOKUP_MAX_ROWS, StepTable, StepTables, bounded_rows

# Tasks carry the functions of this module, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROBES = 32
LANCZOS_STEPS = 60
SOLVE_STEPS = 500
#: How far the residual of a Newton step is reduced; the next step takes up the rest.
NEWTON_SOLVE = 1e-3
#: Decrement at which a mode is close enough to compare deviances.
SEARCH_TOLERANCE = 1e-4
#: Levels on the driver beside an eliminated factor: a block of all probes is at most 128 MB.
KEPT_LEVELS = 500_000
#: Rows a task holds at once when a factor is eliminated.
CHUNK_ROWS = 200_000
CHUNK = "chunk bigint, y binary, x binary, k binary, a binary, names array<string>"
EFFECTS = "chunk bigint, u binary"
#: Bound of the table that numbers the levels of a factor, which is sent to the tasks.
CODE_BYTES = 64 << 20
#: Lines a task emits at once.
LINES = 50_000


@dataclass
class Crossed:
    """Rows with the position of each of their levels; fixed effects come first in every vector."""

    rows: DataFrame
    x: list[str]
    factors: list[str]
    levels: list[list[str]]
    n: int
    passes: int = 0
    #: Position of the eliminated factor, whose `levels` are then only those kept on the driver; `rows` are then chunks.
    gone: int | None = None
    counts: list[int] = field(default_factory=list)
    #: The chunks and the effects of the steps in use, as stored tables.
    steps: StepTables | None = None
    stored: StepTable | None = None

    def close(self) -> None:
        self.rows.unpersist()
        if self.steps is not None:
            self.steps.close()

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum([len(self.x), *map(len, self.levels)])

    @property
    def size(self) -> int:
        return int(self.ends[-1])

    def scales(self, sds: Sequence[float]) -> np.ndarray:
        return np.repeat([1.0, *sds], [len(self.x), *map(len, self.levels)])


@dataclass
class Held:
    """Chunks with the effects of the eliminated factor, zero without a `table`; `move` (scale, sd, at, step, reach) and
    `ratio` are still to be applied."""

    rows: DataFrame
    move: tuple | None = None
    ratio: float = 1.0
    table: StepTable | None = None


@dataclass
class System:
    """The penalised system at one point: products with a block, and what the scan of that point gave."""

    at: np.ndarray
    likelihood: float
    gradient: np.ndarray
    diagonal: np.ndarray
    fixed: np.ndarray
    times: Callable[[np.ndarray], np.ndarray]
    #: Of an eliminated factor: its effects here, their squares, its log-determinant and its part of the decrement.
    held: Held | None = None
    squares: float = 0.0
    logdet: float = 0.0
    decrement: float = 0.0


def prepare_crossed(
    df: DataFrame, y: str, x: Sequence[str], groups: Sequence[str], driver_levels: int = LOOKUP_MAX_ROWS
) -> Crossed:
    """Number the levels of every factor and keep only what a scan needs; above `driver_levels` the largest is eliminated."""
    text = [F.col(g).cast("string").alias(f"__group_{g}") for g in groups]
    rows = df.select(F.col(y).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in x], *text)
    stored = rows = rows.persist()
    n, *counts = rows.agg(F.count("*"), *[F.countDistinct(f"__group_{g}") for g in groups]).first()
    gone = int(np.argmax(counts)) if sum(counts) + len(x) > driver_levels else None
    bound = LOOKUP_MAX_ROWS if gone is None else KEPT_LEVELS
    levels, start = [], len(x)
    for i, g in enumerate(groups):
        if i == gone:
            levels.append(_kept_levels(rows, f"__group_{g}"))
        else:
            found = bounded_rows(rows.select(f"__group_{g}").distinct(), bound - start, f"levels up to {g}")
            levels.append(sorted(r[0] for r in found))
        codes = [(v, start + k) for k, v in enumerate(levels[-1])]
        table = df.sparkSession.createDataFrame(codes, "__level string, __code int").withColumnRenamed("__code", f"__c{i}")
        rows = attach_small(rows, table, [(f"__group_{g}", "__level")], null_safe=False, max_bytes=CODE_BYTES)
        rows = rows if i == gone else rows.drop(f"__group_{g}")
        start += len(levels[-1])
    problem = Crossed(rows, list(x), list(groups), levels, n, gone=gone, counts=counts)
    if gone is None:
        problem.rows = rows.persist()
        problem.rows.count()
    else:
        _store_chunks(problem, f"__group_{groups[gone]}")
    stored.unpersist()
    return problem


def _kept_levels(rows: DataFrame, group: str) -> list[str]:
    """Levels above 1 % of the rows (and possibly some others), whose rows no single task should hold."""
    if not rows.filter(F.col(group).isNull()).isEmpty():
        raise ValueError(f"{group.removeprefix('__group_')} is missing in some rows; the fit takes complete cases")
    return sorted(hot_keys(rows, group))


def _store_chunks(problem: Crossed, group: str) -> None:
    """One record per task: its rows as arrays, with all rows of every eliminated level it meets.

    Positions point into the driver's vectors, `size` where a row has none; `a` numbers the eliminated levels of the chunk,
    the last number stands for rows of a kept level. A chunk is named by the value that dealt one of its rows.
    """
    rows, x, size, spark = problem.rows, problem.x, problem.size, problem.rows.sparkSession
    codes, own = [f"__c{i}" for i in range(len(problem.factors))], f"__c{problem.gone}"
    parts = max(spark.sparkContext.defaultParallelism, -(-problem.n // CHUNK_ROWS))
    by = F.when(F.col(own).isNull(), F.xxhash64(group)).otherwise(F.xxhash64("__y", *x, *codes))
    name = F.when(F.col(own).isNull(), F.col(group))
    dealt = rows.select("__y", *x, *[F.coalesce(c, F.lit(size)).alias(c) for c in codes], name.alias("__a"), by.alias("__by"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True)
        a, names = pd.factorize(pdf["__a"])
        a = np.where(a < 0, len(names), a).astype(np.int32)
        order = np.argsort(a, kind="stable")
        pdf, a = pdf.iloc[order], a[order]
        yield pd.DataFrame([{
            "chunk": pdf["__by"].iloc[0], "y": pdf["__y"].to_numpy(float).tobytes(), "x": pdf[x].to_numpy(float).tobytes(),
            "k": pdf[codes].to_numpy(np.int32).tobytes(), "a": a.tobytes(), "names": list(names),
        }])

    problem.steps = StepTables(spark, "chunk", parts)
    problem.stored = problem.steps.store(dealt.repartition(parts, "__by").mapInPandas(pack, CHUNK))
    problem.rows = problem.stored.rows


@dataclass(frozen=True)
class Point:
    """Where chunks are scored: scale of every position, deviation of the eliminated factor, and `spread_out` coefficients."""

    p: int
    scale: np.ndarray
    sd: float
    at: np.ndarray


def spread_out(block: np.ndarray, scale: np.ndarray, p: int) -> np.ndarray:
    """A block in units of the linear predictor, with a line of zeros for rows that have no position."""
    out = np.vstack([block, np.zeros((1, block.shape[1]))])
    out[p:-1] *= scale[p:, None]
    return out


class Chunk:
    """The arrays of a chunk, its effects and working weights at a point, and its products."""

    def __init__(self, row, point: Point):
        self.p, self.scale, self.size = point.p, point.scale, len(point.scale)
        self.y = np.frombuffer(row["y"])
        self.x = np.frombuffer(row["x"]).reshape(len(self.y), -1)
        self.k = np.frombuffer(row["k"], np.int32).reshape(len(self.y), -1)
        self.a = np.frombuffer(row["a"], np.int32)
        self.u = np.frombuffer(row["u"]) if "u" in row else np.zeros(len(row["names"]) + 1)
        self.own = np.where(np.arange(len(self.u)) < len(self.u) - 1, point.sd, 0.0)  # the last level stands for none
        self.first = np.flatnonzero(np.diff(self.a, prepend=-1))
        self.eta = (self.line(point.at) + self.spread(self.u[:, None]))[:, 0]
        self.mu = 1.0 / (1.0 + np.exp(-self.eta))
        self.w = self.mu * (1.0 - self.mu)

    def line(self, block: np.ndarray) -> np.ndarray:
        """Per row: its columns times a block that is spread out."""
        return self.x @ block[:self.p] + sum(block[k] for k in self.k.T)

    def by_level(self, values: np.ndarray) -> np.ndarray:
        """Sums over the rows of each eliminated level, in units of its effect."""
        out = np.zeros((len(self.u), values.shape[1]))
        out[self.a[self.first]] = np.add.reduceat(values, self.first, axis=0)
        return self.own[:, None] * out

    def spread(self, values: np.ndarray) -> np.ndarray:
        return (self.own[:, None] * values)[self.a]

    def pivots(self) -> np.ndarray:
        return 1.0 + self.own * self.by_level(self.w[:, None])[:, 0]

    def level_gradient(self) -> np.ndarray:
        return self.by_level((self.y - self.mu)[:, None])[:, 0] - self.u

    def reduced(self, values: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Weighted products per row, less what the eliminated levels take."""
        values = self.w[:, None] * values
        return values - self.w[:, None] * self.spread(self.by_level(values) / h[:, None])

    def back(self, total: np.ndarray, values: np.ndarray, power: int = 1) -> None:
        """Add the products of the columns with `values` to the driver's positions."""
        for k in self.k.T:
            order = np.argsort(k, kind="stable")
            found, first = np.unique(k[order], return_index=True)
            sums = np.add.reduceat(values[order], first, axis=0)
            inside = found < self.size
            total[found[inside]] += self.scale[found[inside], None] ** power * sums[inside]


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for pdf in batches:
        yield from pdf.to_dict("records")


def _lines(df: DataFrame, size: int, width: int, of: Callable[[dict, np.ndarray], None]) -> np.ndarray:
    """Sum over all chunks of what `of` adds to a table with a line per position.

    A task adds up its chunks, as many as there are for each core, so that lines do not multiply with the chunks.
    """
    names = [f"v{j}" for j in range(width)]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, width))
        for row in _records(batches):
            of(row, total)
        met = np.flatnonzero(total.any(axis=1))
        for some in np.array_split(met, -(-len(met) // LINES) or 1):
            yield pd.DataFrame(total[some], columns=names).assign(i=some)[["i", *names]]

    tasks = df.coalesce(df.sparkSession.sparkContext.defaultParallelism)
    lines = tasks.mapInPandas(add, "i int, " + ", ".join(f"{v} double" for v in names))
    found = lines.groupBy("i").agg(*[F.sum(v).alias(v) for v in names]).toPandas()
    out = np.zeros((size, width))
    out[found["i"].to_numpy(int)] = found[names].to_numpy(float)
    return out


def _reduced_system(problem: Crossed, sds: Sequence[float], at: np.ndarray, held: Held) -> System:
    """The system of the driver's positions once the largest factor is eliminated, at `at` and the effects of `held`."""
    p, size, ratio = len(problem.x), problem.size, held.ratio
    scale, sd = problem.scales(sds), sds[problem.gone]
    point, old = Point(p, scale, sd, spread_out(at[:, None], scale, p)), None
    if held.move is not None:
        old_scale, old_sd, old_at, step, reach = held.move
        old = Point(p, old_scale, old_sd, spread_out(old_at[:, None], old_scale, p)), spread_out(step[:, None], old_scale, p), reach
    context = problem.rows.sparkSession.sparkContext
    sent = context.broadcast((point, old))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        point, old = sent.value
        for row in _records(batches):
            if old is None:
                u = np.frombuffer(row["u"]) if "u" in row else np.zeros(len(row["names"]) + 1)
            else:
                at, step, reach = old
                c = Chunk(row, at)
                coupled = c.by_level(c.w[:, None] * c.line(step))[:, 0]
                u = c.u + reach * (c.level_gradient() - coupled) / c.pivots()
            yield pd.DataFrame([{"chunk": row["chunk"], "u": (u * ratio).tobytes()}])

    def scored(row: dict, total: np.ndarray) -> None:
        c = Chunk(row, sent.value[0])
        eta = c.eta
        h, g = c.pivots(), c.level_gradient()
        rest = (c.y - c.mu)[:, None] - c.w[:, None] * c.spread((g / h)[:, None])
        lost = c.by_level(c.w[:, None] * c.x)
        total[:p, 0] += (c.x.T @ rest)[:, 0]
        total[:p, 2:2 + p] += c.x.T @ (c.x * c.w[:, None]) - lost.T @ (lost / h[:, None])
        c.back(total[:, :1], rest)
        c.back(total[:, 1:2], c.w[:, None], 2)
        total[0, -4:] += (c.y @ eta - np.logaddexp(0.0, eta).sum(), c.u @ c.u, np.log(h).sum(), (g * g / h).sum())

    table = problem.steps.store(held.rows.mapInPandas(place, EFFECTS))
    stored = problem.steps.beside(problem.rows, table)
    scanned = stored.drop("names")
    lines = _lines(scanned, size, p + 6, scored)
    sent.destroy()
    problem.passes += 2
    ridge = np.r_[np.zeros(p), np.ones(size - p)]

    def times(block: np.ndarray) -> np.ndarray:
        told = context.broadcast((point, spread_out(block, scale, p)))

        def product(row: dict, total: np.ndarray) -> None:
            at, block = told.value
            c = Chunk(row, at)
            rest = c.reduced(c.line(block), c.pivots())
            total[:p] += c.x.T @ rest
            c.back(total, rest)

        out = _lines(scanned, size, block.shape[1], product)
        told.destroy()
        problem.passes += 1
        return out + ridge[:, None] * block

    likelihood, squares, logdet, decrement = lines[0, -4:]
    # The diagonal only scales; that of the whole system bounds the one that is left.
    return System(at, likelihood, lines[:, 0] - ridge * at, lines[:, 1] + ridge, lines[:p, 2:2 + p], times,
                  Held(stored, table=table), squares, logdet, decrement)


def gone_effects(problem: Crossed, system: System, sd: float) -> DataFrame:
    """Level and effect of the eliminated factor, without the levels kept on the driver."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _records(batches):
            yield pd.DataFrame({"level": list(row["names"]), "effect": sd * np.frombuffer(row["u"])[:-1]})

    return system.held.rows.mapInPandas(told, "level string, effect double")


def _scan(problem: Crossed, scale: np.ndarray, at: np.ndarray, block: np.ndarray | None) -> np.ndarray:
    """Lines (position, values) summed over the rows.

    Without a block: gradient, diagonal, row of the fixed effects' products, log-likelihood (in line 0). With one: the
    weighted products of the system with it.
    """
    p, size, x = len(problem.x), problem.size, problem.x
    codes = [f"__c{i}" for i in range(len(problem.factors))]
    width = p + 3 if block is None else block.shape[1]
    sent = problem.rows.sparkSession.sparkContext.broadcast((scale, at, block))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scale, at, block = sent.value
        total, met = np.zeros((size, width)), np.zeros(size, dtype=bool)
        met[:p] = True
        for pdf in batches:
            if not len(pdf):
                continue
            s, y = pdf[x].to_numpy(float), pdf["__y"].to_numpy(float)
            where = [pdf[c].to_numpy() for c in codes]
            eta = s @ at[:p] + sum(scale[k] * at[k] for k in where)
            mu = 1.0 / (1.0 + np.exp(-eta))
            w = mu * (1.0 - mu)
            if block is None:
                r = y - mu
                total[:p, 0] += s.T @ r
                total[:p, 1] += (s * s).T @ w
                total[:p, 2:2 + p] += s.T @ (s * w[:, None])
                total[0, -1] += y @ eta - np.logaddexp(0.0, eta).sum()
                rest = np.column_stack([r, w])
            else:
                rest = w[:, None] * (s @ block[:p] + sum(scale[k][:, None] * block[k] for k in where))
                total[:p] += s.T @ rest
            for k in where:
                order = np.argsort(k, kind="stable")
                found, first = np.unique(k[order], return_index=True)
                sums = np.add.reduceat(rest[order], first, axis=0)
                met[found] = True
                if block is None:
                    total[found, 0] += scale[found] * sums[:, 0]
                    total[found, 1] += scale[found]**2 * sums[:, 1]
                else:
                    total[found] += scale[found][:, None] * sums
        here = np.flatnonzero(met)
        yield pd.DataFrame(total[here], columns=[f"v{j}" for j in range(width)]).assign(i=here)[["i", *names]]

    names = [f"v{j}" for j in range(width)]
    lines = problem.rows.mapInPandas(add, "i int, " + ", ".join(f"{v} double" for v in names))
    found = lines.groupBy("i").agg(*[F.sum(v).alias(v) for v in names]).toPandas()
    sent.destroy()
    problem.passes += 1
    out = np.zeros((size, width))
    out[found["i"].to_numpy(int)] = found[names].to_numpy(float)
    return out


def system_at(problem: Crossed, sds: Sequence[float], at: np.ndarray, held: Held | None = None) -> System:
    """Scan the rows at `at`, whose level part is in units of the deviations."""
    if problem.gone is not None:
        return _reduced_system(problem, sds, at, held or Held(problem.rows))
    p, scale = len(problem.x), problem.scales(sds)
    ridge = np.r_[np.zeros(p), np.ones(problem.size - p)]
    lines = _scan(problem, scale, at, None)

    def times(block: np.ndarray) -> np.ndarray:
        return _scan(problem, scale, at, block) + ridge[:, None] * block

    return System(at, lines[0, -1], lines[:, 0] - ridge * at, lines[:, 1] + ridge, lines[:p, 2:2 + p], times)


def solve(system: System, right: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Solution for every column of `right` by preconditioned conjugate gradients, one scan a step."""
    p = len(system.fixed)

    def preconditioned(r: np.ndarray) -> np.ndarray:
        return np.vstack([np.linalg.solve(system.fixed, r[:p]), r[p:] / system.diagonal[p:, None]])

    found, r = np.zeros_like(right), right.copy()
    z = preconditioned(r)
    d, rz = z.copy(), (r * z).sum(0)
    first = np.maximum(rz, 1e-300)
    for _ in range(SOLVE_STEPS):
        if (rz <= tolerance**2 * first).all():
            return found
        moved = system.times(d)
        bend = (d * moved).sum(0)
        reach = np.where(bend > 0, rz / np.where(bend > 0, bend, 1.0), 0.0)
        found += reach * d
        r -= reach * moved
        z = preconditioned(r)
        new = (r * z).sum(0)
        d = z + np.where(rz > 0, new / np.where(rz > 0, rz, 1.0), 0.0) * d
        rz = new
    raise ArithmeticError(f"no solution in {SOLVE_STEPS} steps")


def log_determinant(system: System, seed: int = 1, probes: int = PROBES, tolerance: float = 1e-5) -> tuple[float, float]:
    """Log-determinant of the level block and its standard error over the probes, by Lanczos quadrature.

    The block is scaled to a unit diagonal first. With no more levels than probes, unit vectors make it exact.
    """
    p = len(system.fixed)
    root = np.sqrt(system.diagonal[p:])[:, None]
    q = len(root)
    if not q:
        return 0.0, 0.0
    exact = q <= probes
    v = np.eye(q) if exact else np.random.default_rng(seed).choice([-1.0, 1.0], (q, probes)) / math.sqrt(q)
    before, beta = np.zeros_like(v), np.zeros(v.shape[1])
    alphas, betas, values = [], [], None
    for step in range(min(q, LANCZOS_STEPS)):
        w = system.times(np.vstack([np.zeros((p, v.shape[1])), v / root]))[p:] / root - beta * before
        alpha = (v * w).sum(0)
        w -= alpha * v
        alphas.append(alpha)
        last, values = values, _quadrature(np.array(alphas), np.array(betas))
        beta = np.sqrt((w * w).sum(0))
        beta[beta < 1e-10] = 0.0
        if not beta.any() or (last is not None and np.abs(values - last).max() < tolerance):
            break
        betas.append(beta)
        before, v = v, np.where(beta > 0, w / np.where(beta > 0, beta, 1.0), 0.0)
    base = 2 * np.log(root).sum()
    if exact:
        return float(base + values.sum()), 0.0
    return float(base + q * values.mean()), float(q * values.std(ddof=1) / math.sqrt(probes))


def _quadrature(alphas: np.ndarray, betas: np.ndarray) -> np.ndarray:
    """First entry of the logarithm of each tridiagonal matrix; a zero off-diagonal ends a matrix."""
    out = []
    for j in range(alphas.shape[1]):
        off = betas[:, j] if len(betas) else np.zeros(0)
        stop = np.flatnonzero(off == 0)
        k = int(stop[0]) + 1 if len(stop) else len(alphas)
        t = np.diag(alphas[:k, j]) + np.diag(off[:k - 1], 1) + np.diag(off[:k - 1], -1)
        values, vectors = np.linalg.eigh(t)
        out.append(float(vectors[0]**2 @ np.log(np.maximum(values, 1e-12))))
    return np.array(out)


def mode(
    problem: Crossed, sds: Sequence[float], start: np.ndarray, tolerance: float, limit: int = 60, held: Held | None = None
) -> System:
    """The joint mode of fixed and random effects; a step that raises the penalised deviance is halved."""
    p = len(problem.x)
    system, at, step, reach, least = None, start, None, 1.0, math.inf
    for _ in range(limit):
        seen = system_at(problem, sds, at, held)
        value = -2 * seen.likelihood + float(at[p:] @ at[p:]) + seen.squares
        if not value <= least + 1e-9 * abs(least) and system is not None and reach > 1e-6:
            reach /= 2
        else:
            if not math.isfinite(value):
                raise ArithmeticError("the logistic fit diverged")
            system, least, reach = seen, value, 1.0
            step = solve(system, system.gradient[:, None], NEWTON_SOLVE)[:, 0]
            if system.gradient @ step + system.decrement < tolerance:
                return system
        at = system.at + reach * step
        if system.held is not None:
            held = Held(
                system.held.rows, (problem.scales(sds), sds[problem.gone], system.at, step, reach), table=system.held.table)
    raise ArithmeticError(f"no convergence in {limit} Newton steps")


def deviance(problem: Crossed, system: System) -> tuple[float, float]:
    """Laplace deviance at a mode, and its standard error from the probes."""
    effects = system.at[len(problem.x):]
    value, error = log_determinant(system)
    return -2 * system.likelihood + float(effects @ effects) + system.squares + value + system.logdet, error


def search(
    problem: Crossed, begin: Sequence[float], tolerance: float, stop: float, bounds: tuple[float, float], most: float
) -> tuple[np.ndarray, System]:
    """Deviations with the least Laplace deviance at the joint mode, by quasi-Newton steps with central differences.

    The probes stay the same throughout, so the deviance is a smooth function of the deviations.
    """
    known: dict[tuple, float] = {}
    near = np.zeros(problem.size)
    near_sds = np.array(begin, dtype=float)
    held = None

    def start(sds: np.ndarray) -> tuple[np.ndarray, Held | None]:
        moved = near * problem.scales(near_sds) / problem.scales(sds)
        return moved, held and Held(held.rows, ratio=near_sds[problem.gone] / sds[problem.gone], table=held.table)

    def value(logs: np.ndarray) -> float:
        nonlocal near, near_sds, held
        key = tuple(np.round(logs, 12))
        if key not in known:
            sds = np.exp(logs)
            begun, effects = start(sds)
            system = mode(problem, sds, begun, max(tolerance, SEARCH_TOLERANCE), held=effects)
            known[key] = deviance(problem, system)[0]
            near, near_sds, held = system.at, sds, system.held
        return known[key]

    def slope(logs: np.ndarray, h: float = 0.05) -> np.ndarray:
        return np.array([(value(logs + h * e) - value(logs - h * e)) / (2 * h) for e in np.eye(len(logs))])

    at = np.clip(np.log(near_sds), *bounds)
    inverse, gradient = np.eye(len(at)) * 0.1, slope(at)
    for _ in range(60):
        step = np.clip(-inverse @ gradient, -most, most)
        new = np.clip(at + step, *bounds)
        while value(new) > value(at) and np.abs(new - at).max() > 1e-3:
            new = (new + at) / 2
        if value(at) - value(new) < stop:
            at = new if value(new) < value(at) else at
            break
        s, after = new - at, slope(new)
        g = after - gradient
        if s @ g > 1e-10:
            left = np.eye(len(s)) - np.outer(s, g) / (s @ g)
            inverse = left @ inverse @ left.T + np.outer(s, s) / (s @ g)
        at, gradient = new, after
    else:
        raise ArithmeticError("the deviations still move after 60 steps")
    sds = np.exp(at)
    begun, effects = start(sds)
    return sds, mode(problem, sds, begun, tolerance, held=effects)
