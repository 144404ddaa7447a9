"""Input handling, hashing of words and connected components shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.session import cut_lineage

MASK = (1 << 64) - 1


def id_and_text(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `text` (NULL as empty) and the named extra columns; every other column of the input is ignored."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in more],
    )


# --- hashing ---------------------------------------------------------------------------------------------------------

def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_STEPS = mix(np.arange(101, 165, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; grown to the longest buffer seen."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [
            np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, dtype=np.uint64))), dtype=np.uint64)
            for b in (_BASE, inverse)
        ]
    return _powers


def utf8_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column, starting at zero."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each, so that work arrays stay small; a longer text is a range of its own."""
    _, offsets = utf8_buffers(column)
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased (A-Z) texts: 64-bit hash, start byte, end byte and row of each, in text order."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, np.uint64), empty, empty, empty
    inside = ~_SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    last = np.zeros(n, dtype=bool)
    last[:-1] = ~inside[1:]
    last[-1] = True
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    powers, inverse = _power_tables(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[_FOLD[data]] * powers[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return hashes, starts, ends, rows


def shingles_of(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row; fewer words give the whole sequence as one, no word none."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    runs = run_hashes(hashes, k)
    out = []
    for i in range(n_rows):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            whole = (hashes[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, by position of the first; runs over row borders are the caller's to skip."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    for j in range(k):
        total += hashes[j : len(hashes) - k + 1 + j] * _STEPS[j]
    return mix(total + np.uint64(k))


def set_key(values: np.ndarray) -> int:
    """A signed 64-bit key of a set of hashes, the same for equal sets."""
    if not len(values):
        return 0
    total = int(mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    key = int(mix(np.array([total ^ (len(values) * 0x9E3779B97F4A7C15 & MASK)], dtype=np.uint64))[0])
    return key - (1 << 64) if key >> 63 else key


# --- connected components --------------------------------------------------------------------------------------------

#: Edges that one task may connect by itself, 16 bytes each.
TASK_EDGES = 1_000_000


def connected(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges and the smallest node it is connected with: hooking onto smaller labels, then jumping."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    return nodes, nodes[label]


def _contracted(whole: bool, bound: int):
    """Edges of a partition, at most `bound` at a time, as stars; `whole` also lists the centres."""

    def stars(batches):
        import pyarrow as pa

        held, count = [], 0

        def flush():
            u, v = (np.concatenate(x) for x in zip(*held))
            nodes, roots = connected(u, v)
            show = np.ones(len(nodes), bool) if whole else (nodes != roots) | np.isin(nodes, u[u == v])
            return pa.RecordBatch.from_arrays([pa.array(nodes[show]), pa.array(roots[show])], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            count += batch.num_rows
            if count >= bound and not whole:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    return stars


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, bound: int = TASK_EDGES) -> DataFrame:
    """`node`, `root` (smallest node reachable) for every node of the edges; self loops keep their node.

    Each partition first connects its own edges and passes on stars. If at most `bound` edges are left, one task ends the
    work; else large and small stars alternate, two groupings and two joins a round with the edges checkpointed, until
    that holds or two rounds agree. A hub's edges are one key of a join, which adaptive execution splits. Too many rounds
    raise.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).dropna()
    stars = "u long, v long"
    first = now = cut_lineage(pairs.mapInArrow(_contracted(False, bound), stars))
    seen = _print_of(now)
    if seen[0] > bound:
        now = cut_lineage(now.where("u <> v").distinct())
    for _ in range(rounds):
        if seen[0] <= bound:
            done = cut_lineage(now.coalesce(1).mapInArrow(_contracted(True, bound), stars))
            if now is first:
                return done.select(F.col("u").alias("node"), F.col("v").alias("root"))
            now = done
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(now.join(least, "u").select("u", F.col("m").alias("v")))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        now = cut_lineage(small)
        found = _print_of(now)
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = first.select(F.col("u").alias("node")).union(first.select("v")).distinct()
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first())
