"""The penalised least-squares system of a logistic model with random intercepts, by aggregates over the rows.

Every Newton step is one scan: rows are scored in Arrow batches, each task adds up its own weighted products, and the
shuffle carries one line per group level. Factors with few levels, such as the year, are solved together with the
fixed effects in one small dense system. Up to two factors may have any number of levels, as long as each level of
the first (inner) belongs to one level of the second (outer), as a litter has one dam: eliminating the inner and then
the outer levels leaves the small system, exactly, with nothing but group-wise sums.

The level lines are eliminated by the functions of `Elimination`. Up to `LOOKUP_MAX_ROWS` levels they run on the driver;
above it they run on the executors. There the rows are dealt by outer level, so that a task has all rows of its levels,
makes their lines itself and eliminates them without a shuffle. The rows are stored once; a step stores the effects alone,
beside the rows, and the effects of earlier steps are dropped. Only dense sums reach the driver. If an outer level has more than `LEVEL_ROWS` rows, no task holds it: the lines are
then shuffled and kept in the checkpoint folder. Other deviations, the leverage of the rows and the adjoint solve of a
gradient are answered from the same lines, on every side by the same functions.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.operators.joins import hot_keys, left_join
from vitalrates.session import LOOKUP_MAX_ROWS, StepTable, StepTables, bounded_rows, cut_lineage

# Tasks carry the functions of this module, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SMALL_LEVELS = 64
#: Rows of one outer level that a task may hold, and rows of a task's chunk of smaller levels.
LEVEL_ROWS = 1_000_000
CHUNK_ROWS = 50_000
CHUNK = "chunk string, y binary, x binary, codes binary, a binary, b_of binary, names_a binary, names_b binary"
#: Of a chunk at one step: effects, and what its lines take from the dense system.
NAMES = ("names_a", "names_b")
EFFECTS = "chunk string, ua binary, ub binary, block binary, raw binary"


class NotNested(ValueError):
    """Large factors whose levels cannot be eliminated one factor after the other."""


@dataclass
class State:
    """Where a Newton search stands: dense coefficients, level offsets, and the deviations they belong to; after a scan
    also what the scan gave: its level lines in `system`, the reduced dense matrix and the deviance."""

    sds: tuple[float, ...]
    dense: np.ndarray
    levels: DataFrame | pd.DataFrame | Placed | None = None
    objective: float = math.inf
    decrement: float = math.inf
    schur: np.ndarray | None = None
    outer: DataFrame | pd.DataFrame | Placed | None = None
    system: DriverLevels | ChunkLevels | SparkLevels | None = None
    step: np.ndarray | None = None
    penalised: float = math.inf


@dataclass
class Problem:
    rows: DataFrame
    x: list[str]
    small: list[str]
    small_levels: dict[str, list[str]]
    nested: list[str]
    counts: dict[str, int]
    n: int
    hot: list
    hot_outer: list
    driver_levels: bool
    stored: DataFrame
    #: Rows in chunks of whole outer levels, or None where the lines are on the driver or shuffled.
    chunks: DataFrame | None = None
    #: The chunks and the effects of the steps in use, as stored tables.
    steps: StepTables | None = None
    held: StepTable | None = None
    #: Rows as arrays sorted by inner level, for scans whose level lines the driver holds.
    packed: DataFrame | None = None
    passes: int = 0
    broadcasts: list[Broadcast] = field(default_factory=list)

    @property
    def factors(self) -> list[str]:
        return [*self.small, *self.nested]

    def release(self) -> None:
        """Give back the level tables sent out for the scan that is done."""
        while self.broadcasts:
            self.broadcasts.pop().destroy()

    def close(self) -> None:
        """Give back everything; level tables of a state are then gone."""
        self.release()
        self.stored.unpersist()
        if self.steps is not None:
            self.steps.close()

    @property
    def size(self) -> int:
        return len(self.x) + sum(len(v) for v in self.small_levels.values())


def prepare(
    df: DataFrame, y: str, x: Sequence[str], groups: Sequence[str], small_levels: int, driver_levels: int,
    level_rows: int = LEVEL_ROWS,
) -> Problem:
    """Sort the factors into small and large ones, check nesting, and keep only what a scan needs."""
    # Only what a scan needs is kept, once; every count below reads the kept columns.
    text = [F.col(g).cast("string").alias(f"__group_{g}") for g in groups]
    stored = df.select(F.col(y).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in x], *text).persist()
    first = stored.agg(F.count("*").alias("__n"), *[F.countDistinct(f"__group_{g}").alias(g) for g in groups]).first()
    counts = first.asDict()
    small = [g for g in groups if counts[g] <= small_levels]
    large = sorted((g for g in groups if g not in small), key=lambda g: -counts[g])
    if len(large) > 2:
        stored.unpersist()
        raise NotNested(f"at most two factors may have more than {small_levels} levels, got {large}")
    a, b = ([F.col(f"__group_{g}") for g in large] + [F.lit("")] * 2)[:2]
    if len(large) == 2 and not stored.groupBy(a).agg((F.min(b) != F.max(b)).alias("bad")).filter("bad").isEmpty():
        stored.unpersist()
        raise NotNested(f"a level of {large[0]} lies in several levels of {large[1]}")
    levels: dict[str, list[str]] = {}
    codes, start = [], len(x)
    for g in small:
        found = bounded_rows(stored.select(F.col(f"__group_{g}").alias("v")).distinct(), small_levels, g)
        levels[g] = sorted(r["v"] for r in found)
        code = F.array_position(F.array(*[F.lit(v) for v in levels[g]]), F.col(f"__group_{g}"))
        codes.append((code + (start - 1)).cast("int").alias(f"__code_{g}"))
        start += len(levels[g])
    rows = stored.select("__y", *x, *codes, a.alias("__a"), b.alias("__b"))
    hot = hot_keys(rows, "__a") if large else []
    hot_outer = hot_keys(rows, "__b") if len(large) == 2 else []
    on_driver = all(counts[g] <= driver_levels for g in large)
    problem = Problem(
        rows, list(x), small, levels, large, {g: counts[g] for g in groups}, counts["__n"], hot, hot_outer, on_driver, stored
    )
    if on_driver:
        problem.packed = rows.mapInPandas(_packer(problem), CHUNK).persist()
        problem.packed.select("a").write.format("noop").mode("overwrite").save()
        stored.unpersist()
        problem.stored = problem.packed
    else:
        whole = "__b" if len(large) == 2 else "__a"
        if rows.groupBy(whole).count().agg(F.max("count")).first()[0] <= level_rows:
            _store_chunks(problem, whole)
            stored.unpersist()
    return problem


def _numbered(keys: pd.Series) -> tuple[np.ndarray, list]:
    """The place of each key among the different ones, a missing one among them."""
    code, names = pd.factorize(keys, use_na_sentinel=False)
    return code, [None if pd.isna(v) else v for v in names]


def _told(names: list) -> bytes:
    """Level names as one value, which a scan passes on unread."""
    return json.dumps(names).encode()


def _store_chunks(problem: Problem, whole: str) -> None:
    """One record per task: rows as arrays, sorted by inner level, with all rows of each level.

    A chunk is named by one of its levels, whose bucket is the partition the level was dealt to.
    """
    spark = problem.rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-problem.n // CHUNK_ROWS))
    problem.steps = StepTables(spark, "chunk", parts)
    problem.held = problem.steps.store(problem.rows.repartition(parts, whole).mapInPandas(_packer(problem, None, whole), CHUNK))
    problem.chunks = problem.held.rows


def _packer(problem: Problem, most: int | None = CHUNK_ROWS, whole: str = "__a"):
    """Rows as arrays in records of about `most` rows, or one a task without it."""
    x, codes = problem.x, [f"__code_{g}" for g in problem.small]

    def record(held: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        a, names_a = _numbered(pdf["__a"])
        b, names_b = _numbered(pdf["__b"])
        order = np.argsort(a, kind="stable")
        first = order[np.searchsorted(a[order], np.arange(len(names_a)))]
        pdf = pdf.iloc[order]
        names = names_b if whole == "__b" else names_a
        return pd.DataFrame([{
            "chunk": next((v for v in names if v is not None), "\0"),
            "y": pdf["__y"].to_numpy(float).tobytes(), "x": pdf[x].to_numpy(float).tobytes(),
            "codes": pdf[codes].to_numpy(np.int32).tobytes(), "a": a[order].astype(np.int32).tobytes(),
            "b_of": b[first].astype(np.int32).tobytes(), "names_a": _told(names_a), "names_b": _told(names_b),
        }])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            if len(pdf):
                held.append(pdf)
                n += len(pdf)
            if most and n >= most:
                yield record(held)
                held, n = [], 0
        if held:
            yield record(held)

    return pack


def _values(count: int) -> list[str]:
    return [f"v{j}" for j in range(count)]


def _schema(count: int, head: str) -> str:
    return head + ", " + ", ".join(f"{v} double" for v in _values(count))


def _summed(df: DataFrame, keys: Sequence[str], carried: Sequence[str], count: int) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in carried], *[F.sum(v).alias(v) for v in _values(count)]
    )


def _block_lines(block: np.ndarray, **columns) -> pd.DataFrame:
    out = pd.DataFrame(block, columns=_values(block.shape[1]))
    return out.assign(i=np.arange(len(block)), **columns)


def _by_level(keys: pd.Series, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row sums per key, and the position of the first row of each key."""
    code, levels = pd.factorize(keys, use_na_sentinel=False)
    if not len(code):
        return np.zeros((0, sums.shape[1])), code
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(levels)))
    return np.add.reduceat(sums[order], starts, axis=0), order[starts]


def _scan(problem: Problem, state: State) -> DataFrame:
    """Weighted products at the current coefficients: one line per inner level (kind 1) and per dense row (kind 0).

    A level line holds the weight, the residual and the weighted dense columns; a dense row its products, its
    gradient and, in the first row, the log-likelihood.
    """
    p, size, x = len(problem.x), problem.size, problem.x
    codes = [f"__code_{g}" for g in problem.small]
    scale = {f"__code_{g}": sd for g, sd in zip(problem.small, state.sds)}
    dense, width = state.dense.copy(), size + 2
    columns = ["kind", "i", "a", "b", "ua", "ub", *_values(width)]
    shared = None
    if isinstance(state.levels, pd.DataFrame):
        shared = problem.rows.sparkSession.sparkContext.broadcast(state.levels.set_index("a")[["ua", "ub", "off"]])
        problem.broadcasts.append(shared)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = np.zeros((size, width))
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            if shared is None:
                ua, ub, off = (pdf[c].to_numpy(float) for c in ("ua", "ub", "off"))
            else:
                at = shared.value.index.get_indexer(pdf["__a"])
                ua, ub, off = shared.value.to_numpy()[at].T
            s = np.zeros((n, size))
            s[:, :p] = pdf[x].to_numpy(float)
            for c in codes:
                s[np.arange(n), pdf[c].to_numpy()] = scale[c]
            y = pdf["__y"].to_numpy(float)
            eta = s @ dense + off
            mu = 1.0 / (1.0 + np.exp(-eta))
            w, r = mu * (1.0 - mu), y - mu
            weighted = s * w[:, None]
            block[:, :size] += s.T @ weighted
            block[:, size] += s.T @ r
            block[0, size + 1] += y @ eta - np.logaddexp(0.0, eta).sum()
            if nested:
                sums, first = _by_level(pdf["__a"], np.column_stack([w, r, weighted]))
                yield pd.DataFrame(sums, columns=_values(width)).assign(
                    kind=1, i=0, a=pdf["__a"].to_numpy()[first], b=pdf["__b"].to_numpy()[first], ua=ua[first],
                    ub=ub[first],
                )[columns]
        yield _block_lines(block, kind=0, a=None, b=None, ua=0.0, ub=0.0)[columns]

    nested = bool(problem.nested)
    scored = problem.rows
    if state.levels is None:
        scored = scored.withColumns({c: F.lit(0.0) for c in ("off", "ua", "ub")})
    elif shared is None:
        levels = state.levels.withColumnRenamed("a", "__a")
        scored = left_join(
            scored, levels, ["__a"], null_safe=False, hot=problem.hot, spread_by=scored.columns
        )
    lines = scored.mapInPandas(score, _schema(width, "kind int, i int, a string, b string, ua double, ub double"))
    return _summed(lines, ["kind", "i", "a"], ["b", "ua", "ub"], width)


def _scales(problem: Problem, state: State) -> np.ndarray:
    """The scale of every dense column: 1 for the fixed effects, else the deviation."""
    sds = dict(zip(problem.factors, state.sds))
    return np.repeat([1.0, *[sds[g] for g in problem.small]], [len(problem.x), *[len(problem.small_levels[g]) for g in problem.small]])


def _columns(row: dict, p: int, scale: np.ndarray) -> np.ndarray:
    """The dense columns of packed rows."""
    n = len(row["a"]) // 4
    s = np.zeros((n, len(scale)))
    s[:, :p] = np.frombuffer(row["x"]).reshape(n, p)
    for k in np.frombuffer(row["codes"], np.int32).reshape(n, -1).T:
        s[np.arange(n), k] = scale[k]
    return s


def _first(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(a, prepend=-1))


def _packed_scan(problem: Problem, state: State) -> DataFrame:
    """The lines of `_scan` from packed rows, with the level offsets broadcast from the driver."""
    p, size, scale, dense = len(problem.x), problem.size, _scales(problem, state), state.dense.copy()
    columns, nested, shared = ["kind", "i", "a", "b", "ua", "ub", *_values(size + 2)], bool(problem.nested), None
    if state.levels is not None:
        shared = problem.rows.sparkSession.sparkContext.broadcast(state.levels.set_index("a")[["ua", "ub", "off"]])
        problem.broadcasts.append(shared)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = np.zeros((size, size + 2))
        for row in _records(batches):
            a, y, s = np.frombuffer(row["a"], np.int32), np.frombuffer(row["y"]), _columns(row, p, scale)
            names_a = json.loads(row["names_a"])
            told = np.zeros((len(names_a), 3))
            if shared is not None:
                told = shared.value.to_numpy()[shared.value.index.get_indexer(names_a)]
            eta = s @ dense + told[a, 2]
            mu = 1.0 / (1.0 + np.exp(-eta))
            w, r = mu * (1.0 - mu), y - mu
            weighted = s * w[:, None]
            block[:, :size] += s.T @ weighted
            block[:, size] += s.T @ r
            block[0, size + 1] += y @ eta - np.logaddexp(0.0, eta).sum()
            if nested:
                sums = np.add.reduceat(np.column_stack([w, r, weighted]), _first(a), axis=0)
                b = np.array(json.loads(row["names_b"]), object)[np.frombuffer(row["b_of"], np.int32)]
                yield pd.DataFrame(sums, columns=_values(size + 2)).assign(
                    kind=1, i=0, a=names_a, b=b, ua=told[:, 0], ub=told[:, 1])[columns]
        yield _block_lines(block, kind=0, a=None, b=None, ua=0.0, ub=0.0)[columns]

    lines = problem.packed.mapInPandas(score, _schema(size + 2, "kind int, i int, a string, b string, ua double, ub double"))
    return _summed(lines, ["kind", "i", "a"], ["b", "ua", "ub"], size + 2)


@dataclass(frozen=True)
class Elimination:
    """Removes level lines from the dense system. `size` dense columns; deviations of the inner and outer factor."""

    size: int
    sd_a: float
    sd_b: float

    @property
    def width(self) -> int:
        return max(self.size + 1, 4)

    def inner_parts(self, lines: pd.DataFrame) -> tuple:
        """Pivot, gradient, coupling to the outer level and couplings to the dense columns of each inner line."""
        v = lines[_values(self.size + 2)].to_numpy(float)
        w, r, s = v[:, 0], v[:, 1], v[:, 2:]
        h = self.sd_a**2 * w + 1.0
        g = self.sd_a * r - lines["ua"].to_numpy(float)
        return h, g, self.sd_a * self.sd_b * w, self.sd_a * s, w, r, s

    def outer_parts(self, lines: pd.DataFrame) -> tuple:
        """The same for outer lines, once their inner levels are gone."""
        size = self.size
        v = lines[_values(2 * size + 4)].to_numpy(float)
        h = self.sd_b**2 * v[:, 0] + 1.0 - v[:, 2]
        g = self.sd_b * v[:, 1] - lines["ub"].to_numpy(float) - v[:, 3]
        return h, g, self.sd_b * v[:, 4:4 + size] - v[:, 4 + size:4 + 2 * size]

    def removed(self, h: np.ndarray, g: np.ndarray, k: np.ndarray, u: np.ndarray) -> np.ndarray:
        """What the lines take from the dense system, then log-determinant, squared effects and decrement."""
        block = np.zeros((self.size + 1, self.width))
        scaled = k / h[:, None]
        block[:self.size, :self.size] = k.T @ scaled
        block[:self.size, self.size] = scaled.T @ g
        block[self.size, :3] = np.log(h).sum(), (u * u).sum(), (g * g / h).sum()
        return block

    def dense_rows(self, lines: pd.DataFrame) -> np.ndarray:
        """Dense rows of a scan, negated, so that they add up with what is removed from them."""
        block = np.zeros((self.size + 1, self.width))
        v = lines[_values(self.size + 2)].to_numpy(float)
        np.subtract.at(block, lines["i"].to_numpy(int), np.pad(
            v[:, :self.size + 1], ((0, 0), (0, self.width - self.size - 1))
        ))
        block[self.size, 3] = v[:, self.size + 1].sum()
        return block

    def inner_sums(self, lines: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        """Lines per outer level, and the block, of scan lines of both kinds."""
        block = self.dense_rows(lines[lines["kind"] == 0])
        lines = lines[lines["kind"] == 1]
        h, g, c, k, w, r, s = self.inner_parts(lines)
        block += self.removed(h, g, k, lines["ua"].to_numpy(float))
        ratio = c / h
        sums, first = _by_level(lines["b"], np.column_stack([w, r, c * ratio, g * ratio, s, k * ratio[:, None]]))
        outer = pd.DataFrame(sums, columns=_values(sums.shape[1])).assign(
            kind=1, i=0, b=lines["b"].to_numpy()[first], ub=lines["ub"].to_numpy(float)[first]
        )
        return outer, block

    def outer_block(self, outer: pd.DataFrame) -> np.ndarray:
        h, g, m = self.outer_parts(outer)
        return self.removed(h, g, m, outer["ub"].to_numpy(float))

    def move_outer(self, outer: pd.DataFrame, step: np.ndarray, reach: float) -> pd.DataFrame:
        """(b, ub, db): outer effects after `reach` of the step, and the whole move."""
        h, g, m = self.outer_parts(outer)
        move = (g - m @ step) / h
        return pd.DataFrame({"b": outer["b"], "ub": outer["ub"].to_numpy(float) + reach * move, "db": move})

    def move_inner(self, lines: pd.DataFrame, ub: np.ndarray, db: np.ndarray, step: np.ndarray, reach: float) -> pd.DataFrame:
        """(a, ua, ub, off): inner effects after `reach` of the step and the offset both factors give."""
        h, g, c, k, *_ = self.inner_parts(lines)
        ua = lines["ua"].to_numpy(float) + reach * (g - c * db - k @ step) / h
        return pd.DataFrame({"a": lines["a"], "ua": ua, "ub": ub, "off": self.sd_a * ua + self.sd_b * ub})


    def leverage(self, lines: pd.DataFrame, h_b: np.ndarray, m_b: np.ndarray, p: int, inverse: np.ndarray):
        """Per inner line what a row's leverage needs, (a, off, v0, q0, ...), and the trace of its inverse block.

        With small columns s, a row has the leverage v0 + (s - q)' inverse (s - q).
        """
        h, _, c, k, *_ = self.inner_parts(lines)
        couple = c / h
        own = (k[:, p:] - (c / h_b)[:, None] * m_b[:, p:]) / h[:, None]
        rest = self.sd_b - self.sd_a * couple
        q = self.sd_a * own + self.sd_b * m_b[:, p:] / h_b[:, None]
        out = pd.DataFrame(q, columns=[f"q{j}" for j in range(q.shape[1])]).assign(
            a=lines["a"].to_numpy(), off=self.sd_a * lines["ua"].to_numpy(float) + self.sd_b * lines["ub"].to_numpy(float),
            v0=self.sd_a**2 / h + rest**2 / h_b,
        )
        return out, float((1.0 / h + couple**2 / h_b + np.einsum("ij,jk,ik->i", own, inverse, own)).sum())

    def outer_trace(self, outer: pd.DataFrame, p: int, inverse: np.ndarray) -> float:
        h, _, m = self.outer_parts(outer)
        own = m[:, p:] / h[:, None]
        return float((1.0 / h + np.einsum("ij,jk,ik->i", own, inverse, own)).sum())

    def forward(self, lines: pd.DataFrame, r: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Of right-hand sides r per inner line: what reaches its outer level, and what the small system loses."""
        h, _, c, k, *_ = self.inner_parts(lines)
        g = self.sd_a * r
        return self.sd_b * r - c * g / h, k[:, p:].T @ (g / h)

    def outer_back(self, outer: pd.DataFrame, g: np.ndarray, small: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Solution per outer line, then (products with the fixed columns, with the effects, effects squared)."""
        h, _, m = self.outer_parts(outer)
        v = (g - m[:, p:] @ small) / h
        fixed = self.sd_b * outer[_values(4 + p)[4:]].to_numpy(float)
        u = outer["ub"].to_numpy(float)
        return v, np.concatenate([fixed.T @ v, [v @ u, u @ u]])

    def inner_back(self, lines: pd.DataFrame, r: np.ndarray, v_b: np.ndarray, small: np.ndarray, p: int) -> np.ndarray:
        h, _, c, k, *_ = self.inner_parts(lines)
        v = (self.sd_a * r - c * v_b - k[:, p:] @ small) / h
        u = lines["ua"].to_numpy(float)
        return np.concatenate([k[:, :p].T @ v, [v @ u, u @ u]])


def rescaled_lines(lines: pd.DataFrame, size: int, ratios: np.ndarray, first: float, second: float) -> pd.DataFrame:
    """Scanned lines under other deviations: effects on the scale of the outcome stay, so products only change scale."""
    lines = lines.copy()
    levels = lines["kind"].to_numpy() == 1
    values = lines[_values(size + 2)].to_numpy(float)
    values[levels, 2:] *= ratios
    rows = np.flatnonzero(~levels)
    own = ratios[lines["i"].to_numpy()[rows]]
    values[rows, :size] *= ratios * own[:, None]
    values[rows, size] *= own
    lines[_values(size + 2)] = values
    lines["ua"] *= first
    lines["ub"] *= second
    return lines


def _raw(lines: pd.DataFrame, size: int) -> np.ndarray:
    """The dense rows of a scan as it gave them: products, gradient and, in the first row, the log-likelihood."""
    out = np.zeros((size, size + 2))
    own = lines[lines["kind"] == 0]
    np.add.at(out, own["i"].to_numpy(int), own[_values(size + 2)].to_numpy(float))
    return out


#: One candidate of other deviations: its elimination, and what `rescaled_lines` takes.
Asked = tuple[Elimination, np.ndarray, float, float]


class DriverLevels:
    """Elimination with the level lines, of which `prepare` counted at most LOOKUP_MAX_ROWS, held on the driver."""

    def __init__(self, scanned: DataFrame | pd.DataFrame, rule: Elimination, bound: int):
        self.rule = rule
        self.lines = lines = scanned if isinstance(scanned, pd.DataFrame) else scanned.toArrow().to_pandas()
        if len(lines) > bound:
            raise ValueError("more levels than counted")
        self.raw = _raw(lines, rule.size)
        self.inner = lines[lines["kind"] == 1].reset_index(drop=True)
        self.outer, self.block = rule.inner_sums(lines)
        self.block += rule.outer_block(self.outer)

    def _outer_of(self, *columns: np.ndarray) -> list[np.ndarray]:
        """Values per outer line brought to the inner lines."""
        at = pd.Index(self.outer["b"]).get_indexer(self.inner["b"])
        return [c[at] for c in columns]

    def move(self, step: np.ndarray, reach: float = 1.0) -> tuple:
        moved = self.rule.move_outer(self.outer, step, reach)
        ub, db = self._outer_of(moved["ub"].to_numpy(), moved["db"].to_numpy())
        return self.rule.move_inner(self.inner, ub, db, step, reach), moved

    def near(self, asked: list[Asked]) -> list[np.ndarray]:
        """Blocks of many candidates. The inner lines depend on the inner deviation alone, so they are summed once for each."""
        by_inner: dict[tuple[float, float], tuple] = {}
        out = []
        for rule, ratios, first, second in asked:
            told = by_inner.get((rule.sd_a, first))
            if told is None:
                told = by_inner[rule.sd_a, first] = self._inner_near(rule.sd_a, first)
            out.append(self._block_near(rule, ratios, second, *told))
        return out

    @cached_property
    def _by_outer(self) -> tuple[np.ndarray, ...]:
        """Weight, residual, effect and dense columns of the inner lines by outer line, and the first inner line of each."""
        at = pd.Index(self.outer["b"]).get_indexer(self.inner["b"])
        lines = self.inner.iloc[np.argsort(at, kind="stable")]
        v = lines[_values(self.rule.size + 2)].to_numpy(float)
        return v[:, 0], v[:, 1], lines["ua"].to_numpy(float), np.ascontiguousarray(v[:, 2:]), _first(np.sort(at))

    @cached_property
    def _outer_near(self) -> tuple[np.ndarray, ...]:
        """Weight, residual, effect and dense columns of the outer lines."""
        v = self.outer[_values(4 + self.rule.size)].to_numpy(float)
        return v[:, 0], v[:, 1], self.outer["ub"].to_numpy(float), np.ascontiguousarray(v[:, 4:])

    def _inner_near(self, sd_a: float, first: float) -> tuple:
        """What the inner lines give at another inner deviation: their block, and sums per outer line, both unscaled."""
        size = self.rule.size
        w, r, ua, s, starts = self._by_outer
        u = ua * first
        h, g = sd_a**2 * w + 1.0, sd_a * r - u
        scaled = s / h[:, None]
        block = np.zeros((size + 1, self.rule.width))
        block[:size, :size] = sd_a**2 * (s.T @ scaled)
        block[:size, size] = sd_a * (scaled.T @ g)
        block[size, :3] = np.log(h).sum(), (u * u).sum(), (g * g / h).sum()
        if not len(w):
            return block, np.zeros((0, 2)), np.zeros((0, size))
        pivots = np.add.reduceat(np.column_stack([sd_a**2 * w * w / h, sd_a * w * g / h]), starts, axis=0)
        return block, pivots, sd_a**2 * np.add.reduceat(scaled * w[:, None], starts, axis=0)

    def _block_near(
        self, rule: Elimination, ratios: np.ndarray, second: float, inner: np.ndarray, pivots: np.ndarray, lost: np.ndarray
    ) -> np.ndarray:
        size, sd_b = rule.size, rule.sd_b
        both = np.outer(ratios, ratios)
        block = inner.copy()
        block[:size, :size] = both * (inner[:size, :size] - self.raw[:, :size])
        block[:size, size] = ratios * (inner[:size, size] - self.raw[:, size])
        block[size, 3] += self.raw[:, size + 1].sum()
        w, r, ub, s = self._outer_near
        u = ub * second
        h = sd_b**2 * (w - pivots[:, 0]) + 1.0
        g = sd_b * (r - pivots[:, 1]) - u
        return block + rule.removed(h, g, sd_b * ratios * (s - lost), u)

    def leverage(self, p: int, inverse: np.ndarray) -> tuple[pd.DataFrame, float, float]:
        h, _, m = self.rule.outer_parts(self.outer)
        table, inner = self.rule.leverage(self.inner, *self._outer_of(h, m), p, inverse)
        return table, inner, self.rule.outer_trace(self.outer, p, inverse)

    def forward(self, r: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Of right-hand sides r per inner line: what reaches each outer line, and what the small system loses."""
        reached, lost = self.rule.forward(self.inner, r, p)
        at = pd.Index(self.outer["b"]).get_indexer(self.inner["b"])
        g = np.bincount(at, weights=reached, minlength=len(self.outer))
        h, _, m = self.rule.outer_parts(self.outer)
        return g, lost + m[:, p:].T @ (g / h)

    def back(self, r: np.ndarray, g: np.ndarray, v_s: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        v_b, outer = self.rule.outer_back(self.outer, g, v_s, p)
        return self.rule.inner_back(self.inner, r, *self._outer_of(v_b), v_s, p), outer

    def adjoint(self, sums: pd.DataFrame, small: np.ndarray, p: int, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        told = sums.set_index("a")["value"]
        r = told.reindex(self.inner["a"]).to_numpy(float)
        g, lost = self.forward(r, p)
        v_s = inverse @ (small - lost)
        return v_s, *self.back(r, g, v_s, p)


@dataclass(frozen=True)
class Point:
    """Where a chunk is scored: elimination, coefficients, and the scale of every dense column."""

    rule: Elimination
    dense: np.ndarray
    scale: np.ndarray


class Chunk:
    """Rows of whole levels, scored at a point; `levels` are their lines."""

    def __init__(self, row: dict, p: int, at: Point):
        rule = at.rule
        self.y, self.a = np.frombuffer(row["y"]), np.frombuffer(row["a"], np.int32)
        b_of, ua, ub = np.frombuffer(row["b_of"], np.int32), np.frombuffer(row["ua"]), np.frombuffer(row["ub"])
        size = rule.size
        self.s = s = _columns(row, p, at.scale)
        eta = s @ at.dense + (rule.sd_a * ua + rule.sd_b * ub[b_of])[self.a]
        self.mu = 1.0 / (1.0 + np.exp(-eta))
        w, r = self.mu * (1.0 - self.mu), self.y - self.mu
        weighted = s * w[:, None]
        block = np.zeros((size, size + 2))
        block[:, :size], block[:, size] = s.T @ weighted, s.T @ r
        block[0, size + 1] = self.y @ eta - np.logaddexp(0.0, eta).sum()
        sums = self.by_level(np.column_stack([w, r, weighted]))
        own = pd.DataFrame(sums, columns=_values(size + 2)).assign(
            kind=1, i=0, a=np.arange(len(ua)), b=b_of, ua=ua, ub=ub[b_of])
        lines = pd.concat([own, _block_lines(block, kind=0, a=-1, b=-1, ua=0.0, ub=0.0)], ignore_index=True)
        self.levels = DriverLevels(lines, rule, len(lines))

    def by_level(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, _first(self.a), axis=0)

    def moved(self, row: dict, step: np.ndarray, reach: float) -> dict:
        inner, outer = self.levels.move(step, reach)
        ub = np.zeros(len(outer))
        ub[outer["b"].to_numpy(int)] = outer["ub"].to_numpy(float)
        return {**row, "ua": inner["ua"].to_numpy(float).tobytes(), "ub": ub.tobytes()}

    def leverage(self, p: int, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Leverage times the derivative of the working weight, by dense column and inner level, and the traces."""
        table, *traces = self.levels.leverage(p, inverse)
        told = table[["v0", *[f"q{j}" for j in range(self.s.shape[1] - p)]]].to_numpy(float)[self.a]
        apart = self.s[:, p:] - told[:, 1:]
        mu = self.mu
        r = (told[:, 0] + ((apart @ inverse) * apart).sum(1)) * mu * (1.0 - mu) * (1.0 - 2.0 * mu)
        return self.s.T @ r, self.by_level(r[:, None])[:, 0], *traces


@dataclass(frozen=True)
class Placed:
    """Effects that stay beside the rows: stored chunks, a move from the point they were scored at, and then a change of
    scale. Chunks without stored effects (`table`) start at zero."""

    rows: DataFrame | None
    p: int
    move: tuple[Point, np.ndarray, float] | None = None
    first: float = 1.0
    second: float = 1.0
    table: StepTable | None = None

    def apply(self, row: dict) -> dict:
        if "ua" not in row:
            b_of = np.frombuffer(row["b_of"], np.int32)
            row = {**row, "ua": np.zeros(len(b_of)).tobytes(), "ub": np.zeros(b_of.max() + 1).tobytes()}
        if self.move is not None:
            at, step, reach = self.move
            row = Chunk(row, self.p, at).moved(row, step, reach)
        return {**row, "ua": (np.frombuffer(row["ua"]) * self.first).tobytes(), "ub": (np.frombuffer(row["ub"]) * self.second).tobytes()}

    def here(self) -> Placed:
        """Without the table, as tasks need it."""
        return Placed(None, self.p, self.move, self.first, self.second)

    def scaled(self, first: float, second: float) -> Placed:
        return Placed(self.rows, self.p, self.move, self.first * first, self.second * second, self.table)

    def effects(self, key: str, value: str) -> DataFrame:
        here = self.here()

        def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row in _records(batches):
                yield pd.DataFrame({key: json.loads(row[f"names_{key}"]), value: np.frombuffer(here.apply(row)[value])})

        return self.rows.mapInPandas(told, f"{key} string, {value} double")


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for pdf in batches:
        yield from pdf.to_dict("records")


class ChunkLevels:
    """The same elimination with rows, lines and effects of whole levels in one task; only dense sums reach the driver.

    The rows stay as they were stored; `table` holds the effects at this point and nothing else of a row's length."""

    def __init__(self, problem: Problem, state: State, rule: Elimination):
        self.p, self.at = len(problem.x), Point(rule, state.dense.copy(), _scales(problem, state))
        begun = state.levels or Placed(problem.chunks, self.p)
        here, p, at, size = begun.here(), self.p, self.at, rule.size

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row in _records(batches):
                row = here.apply(row)
                levels = Chunk(row, p, at).levels
                yield pd.DataFrame([{"chunk": row["chunk"], "ua": row["ua"], "ub": row["ub"],
                                     "block": levels.block.tobytes(), "raw": levels.raw.tobytes()}])

        self.table = problem.steps.store(begun.rows.drop(*NAMES).mapInPandas(place, EFFECTS))
        self.rows = problem.steps.beside(problem.chunks, self.table).drop("block", "raw")
        found = self.table.rows.select("block", "raw").collect()
        self.block = sum(np.frombuffer(r["block"]).reshape(size + 1, -1) for r in found)
        self.raw = sum(np.frombuffer(r["raw"]).reshape(size, size + 2) for r in found)

    def _summed(self, of) -> np.ndarray:
        """The array that `of` gives for each chunk, summed over all."""
        p, at = self.p, self.at

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row in _records(batches):
                yield pd.DataFrame({"v": [of(Chunk(row, p, at)).tobytes()]})

        return sum(np.frombuffer(r["v"]) for r in self.rows.drop(*NAMES).mapInPandas(add, "v binary").collect())

    def near(self, asked: list[Asked]) -> list[np.ndarray]:
        rule = self.at.rule
        return list(self._summed(lambda c: np.stack(c.levels.near(asked))).reshape(len(asked), rule.size + 1, rule.width))

    def move(self, step: np.ndarray, reach: float = 1.0) -> tuple[Placed, Placed]:
        moved = Placed(self.rows, self.p, (self.at, step, reach), table=self.table)
        return moved, moved

    def leverage(self, p: int, inverse: np.ndarray) -> tuple[Leverage, float, float]:
        def told(c: Chunk) -> np.ndarray:
            total, r, *traces = c.leverage(p, inverse)
            return np.concatenate([total, c.levels.forward(r, 0)[1], traces])

        found, size = self._summed(told), self.at.rule.size
        return Leverage(p, inverse, found[:size], found[size:2 * size]), float(found[-2]), float(found[-1])

    def adjoint(self, told: Leverage, small: np.ndarray, p: int, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v_s = inverse @ (small - told.lost[p:])
        of, matrix = told.p, told.inverse

        def back(c: Chunk) -> np.ndarray:
            r = c.leverage(of, matrix)[1]
            return np.concatenate(c.levels.back(r, c.levels.forward(r, p)[0], v_s, p))

        inner, outer = self._summed(back).reshape(2, -1)
        return v_s, inner, outer


@dataclass(frozen=True)
class Leverage:
    """Sums of the leverage by dense column, and what the levels take of them from the dense system."""

    p: int
    inverse: np.ndarray
    total: np.ndarray
    lost: np.ndarray


class SparkLevels:
    """The same elimination with the level lines spread over the executors and kept in the checkpoint folder."""

    def __init__(self, scanned: DataFrame, rule: Elimination, problem: Problem):
        self.rule, self.problem = rule, problem
        self.lines = cut_lineage(scanned)
        self.inner = self.lines.filter("kind = 1")
        own = bounded_rows(self.lines.filter("kind = 0"), rule.size, "dense rows")
        self.raw = _raw(pd.DataFrame([r.asDict() for r in own], columns=self.lines.columns), rule.size)
        sums = self._sums([(rule, np.ones(rule.size), 1.0, 1.0)])
        self.outer = cut_lineage(sums.filter("kind = 1").drop("asked", "kind", "i"))
        self.block = self._blocks(sums, 1)[0]

    def _sums(self, asked: list[Asked]) -> DataFrame:
        """Outer lines and dense blocks of every candidate."""
        size = self.rule.size
        count = max(2 * size + 4, self.rule.width)
        columns = ["asked", "kind", "i", "b", "ub", *_values(count)]

        def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals = [np.zeros((size + 1, rule.width)) for rule, *_ in asked]
            for pdf in batches:
                for k, (rule, *scale) in enumerate(asked):
                    outer, block = rule.inner_sums(rescaled_lines(pdf, size, *scale))
                    totals[k] += block
                    yield outer.assign(asked=k).reindex(columns=columns, fill_value=0.0)
            for k, total in enumerate(totals):
                yield _block_lines(total, asked=k, kind=0, b=None, ub=0.0).reindex(columns=columns, fill_value=0.0)

        parts = self.lines.mapInPandas(inner, _schema(count, "asked int, kind int, i int, b string, ub double"))
        return _summed(parts, ["asked", "kind", "i", "b"], ["ub"], count)

    def _blocks(self, sums: DataFrame, count: int, rules: list[Elimination] | None = None) -> list[np.ndarray]:
        size, width = self.rule.size, self.rule.width
        rules = rules or [self.rule]

        def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals = np.zeros((count, size + 1, width))
            for pdf in batches:
                for k, own in pdf.groupby("asked"):
                    totals[k] += rules[k].outer_block(own[own["kind"] == 1])
                    rows = own[own["kind"] == 0]
                    np.add.at(totals[k], rows["i"].to_numpy(int), rows[_values(width)].to_numpy(float))
            for k in range(count):
                yield _block_lines(totals[k], asked=k)[["asked", "i", *_values(width)]]

        totals = _summed(sums.mapInPandas(outer, _schema(width, "asked int, i int")), ["asked", "i"], [], width)
        out = np.zeros((count, size + 1, width))
        for r in bounded_rows(totals, count * (size + 1), "dense systems"):
            out[r["asked"], r["i"]] = [r[v] for v in _values(width)]
        return list(out)

    def near(self, asked: list[Asked]) -> list[np.ndarray]:
        return self._blocks(self._sums(asked), len(asked), [rule for rule, *_ in asked])

    def _with_outer(self, outer: DataFrame) -> DataFrame:
        return left_join(
            self.inner, outer, ["b"], null_safe=False, hot=self.problem.hot_outer, spread_by=["a"], suffixes=("", "_outer"))

    def move(self, step: np.ndarray, reach: float = 1.0) -> tuple:
        rule = self.rule

        def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield rule.move_outer(pdf, step, reach)

        def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield rule.move_inner(pdf, pdf["ub_moved"].to_numpy(float), pdf["db"].to_numpy(float), step, reach)

        moved = self.outer.mapInPandas(outer, "b string, ub double, db double")
        both = self._with_outer(moved.withColumnRenamed("ub", "ub_moved"))
        return both.mapInPandas(inner, "a string, ua double, ub double, off double"), moved

    def leverage(self, p: int, inverse: np.ndarray) -> tuple[DataFrame, float, float]:
        rule, m_names = self.rule, [f"m{j}" for j in range(self.rule.size)]

        def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                h, _, m = rule.outer_parts(pdf)
                yield pd.DataFrame(m, columns=m_names).assign(b=pdf["b"], h_b=h)[["b", "h_b", *m_names]]

        def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out, trace = rule.leverage(pdf, pdf["h_b"].to_numpy(float), pdf[m_names].to_numpy(float), p, inverse)
                out["trace"] = 0.0
                out.loc[out.index[:1], "trace"] = trace
                yield out[["a", "off", "v0", *q_names, "trace"]]

        def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield pd.DataFrame({"trace": [sum(rule.outer_trace(pdf, p, inverse) for pdf in batches)]})

        q_names = [f"q{j}" for j in range(rule.size - p)]
        doubles = lambda names: "".join(f", {n} double" for n in names)
        outer = self.outer.mapInPandas(parts, "b string, h_b double" + doubles(m_names))
        table = cut_lineage(self._with_outer(outer).mapInPandas(
            inner, "a string, off double, v0 double" + doubles(q_names) + ", trace double"))
        own = table.agg(F.sum("trace")).first()[0] or 0.0
        return table.drop("trace"), own, self.outer.mapInPandas(trace, "trace double").agg(F.sum("trace")).first()[0] or 0.0

    def adjoint(self, sums: DataFrame, small: np.ndarray, p: int, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rule, problem = self.rule, self.problem
        told = cut_lineage(left_join(self.inner, sums, ["a"], null_safe=False))

        def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(rule.size - p)
            for pdf in batches:
                reached, lost = rule.forward(pdf, pdf["value"].to_numpy(float), p)
                total += lost
                yield pd.DataFrame({"kind": 1, "i": 0, "b": pdf["b"], "g": reached})
            yield pd.DataFrame({"kind": 0, "i": np.arange(len(total)), "b": None, "g": total})

        def outer_lost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(rule.size - p)
            for pdf in batches:
                h, _, m = rule.outer_parts(pdf)
                total += m[:, p:].T @ (pdf["g"].to_numpy(float) / h)
            yield pd.DataFrame({"i": np.arange(len(total)), "g": total})

        reached = cut_lineage(told.mapInPandas(forward, "kind int, i int, b string, g double").groupBy("kind", "i", "b").agg(
            F.sum("g").alias("g")))
        with_g = cut_lineage(left_join(
            self.outer, reached.filter("kind = 1").select("b", "g"), ["b"], null_safe=False))
        rest = small.copy()
        for r in bounded_rows(reached.filter("kind = 0"), rule.size, "dense sums"):
            rest[r["i"]] -= r["g"]
        lost = with_g.mapInPandas(outer_lost, "i int, g double").groupBy("i").agg(F.sum("g").alias("g"))
        for r in bounded_rows(lost, rule.size, "dense sums"):
            rest[r["i"]] -= r["g"]
        v_s = inverse @ rest

        def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(p + 2)
            for pdf in batches:
                v, sums_ = rule.outer_back(pdf, pdf["g"].to_numpy(float), v_s, p)
                total += sums_
                yield pd.DataFrame({"kind": 1, "i": 0, "b": pdf["b"], "v_b": v})
            yield pd.DataFrame({"kind": 0, "i": np.arange(p + 2), "b": None, "v_b": total})

        def inner_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(p + 2)
            for pdf in batches:
                total += rule.inner_back(pdf, pdf["value"].to_numpy(float), pdf["v_b"].to_numpy(float), v_s, p)
            yield pd.DataFrame({"i": np.arange(p + 2), "v_b": total})

        solved = cut_lineage(with_g.mapInPandas(back, "kind int, i int, b string, v_b double"))
        both = left_join(told, solved.filter("kind = 1").select("b", "v_b"), ["b"], null_safe=False,
                         hot=problem.hot_outer, spread_by=["a"])
        inner, outer = np.zeros(p + 2), np.zeros(p + 2)
        parts = solved.filter("kind = 0").groupBy("i").agg(F.sum("v_b").alias("v"))
        for r in bounded_rows(parts, p + 2, "dense sums"):
            outer[r["i"]] = r["v"]
        for r in bounded_rows(both.mapInPandas(inner_back, "i int, v_b double").groupBy("i").agg(F.sum("v_b").alias("v")), p + 2, "dense sums"):
            inner[r["i"]] = r["v"]
        return v_s, inner, outer


def rule_of(problem: Problem, sds: Sequence[float]) -> Elimination:
    chosen = dict(zip(problem.factors, sds))
    sd_a, sd_b = ([chosen[g] for g in problem.nested] + [0.0, 0.0])[:2]
    return Elimination(problem.size, sd_a, sd_b)


def solved(
    problem: Problem, dense: np.ndarray, block: np.ndarray, hold: bool = False
) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Dense system, Newton step, decrement and Laplace deviance that follow from an eliminated block.

    With `hold` the fixed effects stay where they are and only the random effects step.
    """
    p, size = len(problem.x), problem.size
    penalty = np.zeros(size)
    penalty[p:] = 1.0
    schur = np.diag(penalty) - block[:size, :size]
    gradient = -penalty * dense - block[:size, size]
    logdet, squares, decrement, loglik = block[size, :4]
    free = slice(p if hold else 0, size)
    step = np.zeros(size)
    step[free] = np.linalg.solve(schur[free, free], gradient[free])
    decrement = float(gradient @ step + decrement)
    small_logdet = np.linalg.slogdet(schur[p:, p:])[1] if size > p else 0.0
    squares += float(dense[p:] @ dense[p:])
    # The decrement is what the next step takes off the deviance.
    return schur, step, decrement, float(-2.0 * loglik + squares + logdet + small_logdet - decrement)


def newton(problem: Problem, state: State, hold: bool = False) -> None:
    """One scan at `state`: fills in what it gives and the Newton step from there."""
    problem.passes += 1
    rule = rule_of(problem, state.sds)
    if problem.chunks is not None:
        state.system = ChunkLevels(problem, state, rule)
        state.levels = Placed(state.system.rows, len(problem.x), table=state.system.table)  # no longer those of the step before
    elif problem.driver_levels:
        state.system = DriverLevels(_packed_scan(problem, state), rule, LOOKUP_MAX_ROWS + problem.size)
    else:
        state.system = SparkLevels(_scan(problem, state), rule, problem)
    problem.release()
    block, u = state.system.block, state.dense[len(problem.x) :]
    state.schur, state.step, state.decrement, state.objective = solved(problem, state.dense, block, hold)
    state.penalised = float(-2.0 * block[problem.size, 3] + block[problem.size, 1] + u @ u)


def following(problem: Problem, state: State, reach: float = 1.0) -> State:
    """The state after `reach` of the step from a scanned one."""
    levels = outer = None
    if problem.nested:
        levels, outer = state.system.move(state.step, reach)
    return State(state.sds, state.dense + reach * state.step, levels, outer=outer)


def leverage_sums(problem: Problem, state: State, table, inverse: np.ndarray) -> tuple[np.ndarray, DataFrame | pd.DataFrame]:
    """One scan at the settled `state`: leverage times the derivative of the working weight, summed by column and level."""
    problem.passes += 1
    if isinstance(table, Leverage):
        return table.total, table
    p, size, x, dense = len(problem.x), problem.size, problem.x, state.dense.copy()
    scale = {f"__code_{g}": sd for g, sd in zip(problem.small, state.sds)}
    names, nested, shared = ["off", "v0", *[f"q{j}" for j in range(size - p)]], bool(problem.nested), None
    rows = problem.rows
    if isinstance(table, pd.DataFrame):
        shared = rows.sparkSession.sparkContext.broadcast(table.set_index("a")[names])
        problem.broadcasts.append(shared)
    else:
        rows = left_join(rows, table.withColumnRenamed("a", "__a"), ["__a"], null_safe=False, hot=problem.hot, spread_by=rows.columns)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for row in _records(batches):
            a, s = np.frombuffer(row["a"], np.int32), _columns(row, p, scales)
            names_a = json.loads(row["names_a"])
            told = shared.value.to_numpy()[shared.value.index.get_indexer(names_a)][a]
            mu = 1.0 / (1.0 + np.exp(-(s @ dense + told[:, 0])))
            apart = s[:, p:] - told[:, 2:]
            r = (told[:, 1] + ((apart @ inverse) * apart).sum(1)) * mu * (1.0 - mu) * (1.0 - 2.0 * mu)
            total += s.T @ r
            if nested:
                yield pd.DataFrame({"kind": 1, "i": 0, "a": names_a, "value": np.add.reduceat(r, _first(a))})
        yield pd.DataFrame({"kind": 0, "i": np.arange(size), "a": None, "value": total})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            if shared is None:
                told = pdf[names].to_numpy(float)
            else:
                told = shared.value.to_numpy()[shared.value.index.get_indexer(pdf["__a"])]
            s = np.zeros((n, size))
            s[:, :p] = pdf[x].to_numpy(float)
            for c, sd in scale.items():
                s[np.arange(n), pdf[c].to_numpy()] = sd
            mu = 1.0 / (1.0 + np.exp(-(s @ dense + told[:, 0])))
            apart = s[:, p:] - told[:, 2:]
            r = (told[:, 1] + np.einsum("ij,jk,ik->i", apart, inverse, apart)) * mu * (1.0 - mu) * (1.0 - 2.0 * mu)
            total += s.T @ r
            if nested:
                sums, first = _by_level(pdf["__a"], r[:, None])
                yield pd.DataFrame({"kind": 1, "i": 0, "a": pdf["__a"].to_numpy()[first], "value": sums[:, 0]})
        yield pd.DataFrame({"kind": 0, "i": np.arange(size), "a": None, "value": total})

    scales = _scales(problem, state)
    lines = (rows if shared is None else problem.packed).mapInPandas(
        score if shared is None else packed, "kind int, i int, a string, value double")
    sums = lines.groupBy("kind", "i", "a").agg(F.sum("value").alias("value"))
    dense_sums = np.zeros(size)
    if shared is not None:
        told = sums.toArrow().to_pandas()
        problem.release()
        own = told[told["kind"] == 0]
        dense_sums[own["i"].to_numpy(int)] = own["value"].to_numpy(float)
        return dense_sums, told[told["kind"] == 1]
    sums = cut_lineage(sums)
    for r in bounded_rows(sums.filter("kind = 0"), size, "dense sums"):
        dense_sums[r["i"]] = r["value"]
    return dense_sums, sums.filter("kind = 1").select("a", "value")
