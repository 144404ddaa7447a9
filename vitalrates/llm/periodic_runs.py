"""Periodic runs: maximal stretches of words that repeat with a period at least four times over.

Blocks of B words, at every dyadic scale B, look for themselves at the distances q = B .. 2B - 1 ahead: the sum of squared
differences to every placement in the following window is a convolution, computed exactly by number-theoretic transforms
modulo a prime, and a sum of zero is an occurrence. A run of period q in [B, 2B) holds several neighbouring blocks that
occur at q, so a chain of such blocks is the seed; the words themselves then confirm and extend it. What the prime could
confuse is thus found out, and a true occurrence always gives zero, so nothing is missed. Blocks that hold a word without
a return within 2B, or that lie inside a run of a smaller period, cannot hold a seed and are not transformed.

Texts of an Arrow batch are laid one after the other with word numbers of their own, so no run spans two texts. No row
meets another one: the work is one scan without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.llm.common import mix, pieces

#: 15 * 2^27 + 1, a prime with transforms of up to 2^27 points, and a generator of its units.
PRIME, GENERATOR = 2_013_265_921, 31
FEWEST, TIMES = 6, 4
CELLS = 1 << 19
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_roots: dict[tuple[int, bool], np.ndarray] = {}


def _powers(half: int, inverse: bool) -> np.ndarray:
    """The first `half` powers of a root of unity of order 2 * half."""
    if (half, inverse) not in _roots:
        root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
        root = pow(root, -1, PRIME) if inverse else root
        out = np.ones(half, np.uint64)
        filled = 1
        while filled < half:
            out[filled : 2 * filled] = out[:filled] * np.uint64(pow(root, filled, PRIME)) % np.uint64(PRIME)
            filled *= 2
        _roots[half, inverse] = out
    return _roots[half, inverse]


def forward(a: np.ndarray) -> np.ndarray:
    """Transform of every row (a power of two long), in bit-reversed order."""
    p, (rows, size) = np.uint64(PRIME), a.shape
    half = size // 2
    while half:
        a = a.reshape(rows, -1, 2, half)
        u, v = a[:, :, 0], a[:, :, 1]
        out = np.empty_like(a)
        out[:, :, 0] = (u + v) % p
        out[:, :, 1] = (u + (p - v)) * _powers(half, False) % p
        a, half = out, half // 2
    return a.reshape(rows, size)


def backward(a: np.ndarray) -> np.ndarray:
    """Undoes `forward`."""
    p, (rows, size) = np.uint64(PRIME), a.shape
    half = 1
    while half < size:
        a = a.reshape(rows, -1, 2, half)
        u, v = a[:, :, 0], a[:, :, 1] * _powers(half, True) % p
        out = np.empty_like(a)
        out[:, :, 0] = (u + v) % p
        out[:, :, 1] = (u + (p - v)) % p
        a, half = out, 2 * half
    return a.reshape(rows, size) * np.uint64(pow(size, -1, PRIME)) % p


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sum of squared differences, modulo the prime, of each block with the B placements in its window of 2B - 1."""
    p, size = np.uint64(PRIME), blocks.shape[1]
    pad = np.zeros((len(blocks), 2 * size), np.uint64)
    pad[:, :size] = blocks[:, ::-1]
    other = np.zeros_like(pad)
    other[:, : 2 * size - 1] = windows
    # A cycle of 2B points suffices: what wraps around lands before the placements that are read.
    cross = backward(forward(pad) * forward(other) % p)[:, size - 1 : 2 * size - 1]
    squares = np.zeros((len(windows), 2 * size), np.uint64)
    np.cumsum(windows * windows % p, axis=1, out=squares[:, 1:])
    own = (blocks * blocks % p).sum(axis=1, keepdims=True)
    return (own + (squares[:, size:] - squares[:, :size]) + np.uint64(2) * (p - cross)) % p


def _chains(found: np.ndarray, least: int) -> np.ndarray:
    """Marks those of consecutive True entries that are at least `least` long."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], found, [False])).astype(np.int8)))
    first, after = edges[::2], edges[1::2]
    long = after - first >= least
    marks = np.zeros(len(found) + 1, np.int64)
    marks[first[long]] += 1
    marks[after[long]] -= 1
    return np.cumsum(marks[:-1]) > 0


def _extended(t: np.ndarray, a: int, b: int, q: int) -> tuple[int, int]:
    """The longest stretch around [a, b) in which words q apart are equal; [a, b) itself is known to match."""
    step = 64
    while a > 0:
        low = max(0, a - step)
        other = np.flatnonzero(t[low:a] != t[low + q : a + q])
        if len(other):
            a = low + int(other[-1]) + 1
            break
        a, step = low, 2 * step
    step, end = 64, len(t) - q
    while b < end:
        high = min(end, b + step)
        other = np.flatnonzero(t[b:high] != t[b + q : high + q])
        if len(other):
            b += int(other[0])
            break
        b, step = high, 2 * step
    return a, b


def least_length(q):
    return np.maximum(FEWEST, TIMES * q)


def periodic_runs(t: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of every run of word numbers `t`, ordered; no run is longer than `longest`."""
    n = len(t)
    if longest < FEWEST:
        return []
    order = np.argsort(t, kind="stable")
    back = np.full(n, n, np.int64)  # distance to the next equal word
    same = t[order[1:]] == t[order[:-1]]
    back[order[:-1][same]] = (order[1:] - order[:-1])[same]
    value = mix(t.astype(np.uint64)) % np.uint64(PRIME)
    runs: dict[tuple[int, int], int] = {}
    size, most = 1, back
    while max(FEWEST, TIMES * size) <= longest:
        if size > 1:
            most = np.maximum(most[0 : len(most) // 2 * 2 : 2], most[1::2])  # a block cut off by the end has no window
        good = _chains(most < 2 * size, _blocks_within(size, size))
        for (s, e), _ in runs.items():
            if e - s >= 3 * size:
                good[-(-s // size) : max(0, (e - 3 * size) // size + 1)] = False
        at = np.flatnonzero(good)
        if len(at):
            for s, e, q in _of_scale(t, value, at, size, runs):
                if q < runs.get((s, e), n):
                    runs[s, e] = q
        size *= 2
    return sorted((s, e, q) for (s, e), q in runs.items())


def _blocks_within(q: int, size: int) -> int:
    """How many whole blocks the matching positions of a run of period q hold at least."""
    return max(1, (max(FEWEST, TIMES * q) - q + 1) // size - 1)


def _of_scale(t, value, at: np.ndarray, size: int, runs: dict) -> Iterator[tuple[int, int, int]]:
    seeds, padded = [], np.concatenate((value, np.zeros(3 * size, np.uint64)))
    for k in range(0, len(at), max(1, CELLS // (2 * size))):
        own = at[k : k + max(1, CELLS // (2 * size))]
        starts = own[:, None] * size
        blocks, windows = padded[starts + np.arange(size)], padded[starts + np.arange(size, 3 * size - 1)]
        block, ahead = np.nonzero(mismatches(blocks, windows) == 0)
        seeds.append(np.stack((size + ahead, own[block])))
    q, block = np.concatenate(seeds, axis=1)
    order = np.lexsort((block, q))
    q, block = q[order], block[order]
    if not len(q):
        return
    first = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (block[1:] != block[:-1] + 1))))
    last = np.concatenate((first[1:], [len(q)])) - 1
    q, low, high = q[first], block[first] * size, (block[last] + 1) * size
    use = (high - low) // size >= np.maximum(1, (least_length(q) - q + 1) // size - 1)
    use &= high + q <= len(t)
    for (s, e), p in runs.items():  # a multiple of the period of a known run is no smallest period
        if e - s >= 2 * size:
            use &= ~((low >= s) & (high + q <= e) & (q % p == 0))
    for d, a, b in zip(q[use].tolist(), low[use].tolist(), high[use].tolist()):
        equal = t[a:b] == t[a + d : b + d]
        if not equal.all():  # equal only modulo the prime: go on from the longest true part
            edges = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).astype(np.int8)))
            if not len(edges):
                continue
            parts = [(a + int(x), a + int(y)) for x, y in zip(edges[::2], edges[1::2])]
        else:
            parts = [(a, b)]
        for a, b in parts:
            a, b = _extended(t, a, b, d)
            if b + d - a >= least_length(d):
                yield a, b + d, d


def replaced(words: list[str], doc_id: int | None) -> list[str]:
    """The words of a text, periodic from some word on when the document's number says so."""
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def run_rows(texts: list[str], ids: list[int | None] | None) -> Iterator[dict]:
    """For every text its runs (start, length, period) by start and period, and the text without the repeats."""
    import pandas as pd

    words = [_WORD.findall(t) for t in texts]
    if ids is not None:
        words = [replaced(w, i) for w, i in zip(words, ids)]
    sizes = np.array([len(w) for w in words], np.int64)
    every = [w for own in words for w in own]
    found: list[tuple[int, int, int]] = []
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if every:
        codes, uniques = pd.factorize(np.array(every, dtype=object))
        numbers = np.repeat(np.arange(len(words)), sizes) * len(uniques) + codes
        found = periodic_runs(numbers, int(sizes.max()))
    by_text: dict[int, list] = {}
    for s, e, q in found:
        row = int(np.searchsorted(ends, s, side="right"))
        by_text.setdefault(row, []).append((s - int(starts[row]), e - s, q))
    for row, own in enumerate(words):
        runs, kept = by_text.get(row, []), own
        if runs:
            drop = np.zeros(len(own), bool)
            for s, length, q in runs:
                drop[s + q : s + length] = True
            kept = [w for w, d in zip(own, drop) if not d]
        yield {"runs": runs, "collapsed": " ".join(kept)}


def _longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for s, length, q in runs:  # in order of start and period: an equal exponent does not replace
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    return best


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _applied(docs: DataFrame, plant: bool, schema: str, row_of, id_col: str, text_col: str) -> DataFrame:
    def scanned(batches) -> Iterator:
        import pyarrow as pa

        names = [c.split(" ")[0] for c in schema.split(", ")]
        for batch in batches:
            ids = batch.column(0)
            for a, b in pieces(batch.column(1)):
                own = ids.slice(a, b - a)
                found = run_rows(batch.column(1).slice(a, b - a).to_pylist(), own.to_pylist() if plant else None)
                rows = [row_of(r) for r in found]
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_types(schema))]
                yield pa.RecordBatch.from_arrays([own, *columns], names=names)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(scanned, schema)


def _types(schema: str):
    import pyarrow as pa

    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    known = {"long": pa.int64(), "string": pa.string(), "array<struct<start:long,length:long,period:long>>": pa.list_(run)}
    return [known[c.split(" ", 1)[1]] for c in schema.split(", ")[1:]]


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (start, length, period in words), collapsed (words joined by one space, of each run one period kept)."""
    schema = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    shown = lambda r: ([{"start": s, "length": n, "period": q} for s, n, q in r["runs"]], r["collapsed"])
    return _applied(docs, False, schema, shown, id_col, text_col)


def run_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_runs, start, length, period and exponent_milli of the run with the largest exponent,
    runs_sha256, collapsed_sha256; documents with crc32(doc_id) divisible by ten are made periodic first.

    NULL and word-less texts have no words, thus no run and the digests of the empty text. A NULL doc_id plants nothing.
    Repeated rows give repeated rows; other columns are ignored. Ties go to the smallest start, then period.
    """
    schema = (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
        "collapsed_sha256 string"
    )

    def digested(r: dict) -> tuple:
        best = _longest(r["runs"])
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in r["runs"])
        strongest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        return (len(r["runs"]), *strongest, _digest(listed), _digest(r["collapsed"]))

    return _applied(docs, True, schema, digested, id_col, text_col)
