"""Near duplicates by SetSketch: registers of exponentially spaced, truncated minima, banded, jointly estimated, verified.

A document's set holds the hashes of its k-word shingles. Register i is floor(1 - log_b h) of the smallest exponential
variable h that hash i gives to a member, cut off to 16 bits: registers of parts merge by their maximum, and two documents
share a register with a probability of about their Jaccard similarity.

1. Equal sets are one class, whatever the number of documents. Only classes go on.
2. Bands of ROWS registers are bucket keys. In every bucket each class meets the bucket's smallest class.
3. Met classes whose registers, by the likelihood of both sets together, could have the wanted similarity are verified on
   their full sets; confirmed links make components.
4. In buckets that still hold several components, members outside the largest one meet the registers of all members, in
   tiles inside a task. A tile passes on one likely partner in another component for each member that has any, and a
   spanning forest: rows in proportion to its members, not to their pairs. What hangs together is a cluster.
5. A cluster's members of different components meet with their full sets, again in tiles: the overlaps of a whole tile are
   one exact product of 0/1 matrices, and only links that join components leave it.

A similarity of 0.8 misses all bands with a probability of 3e-6 and the likelihood bound with 4e-6. No group is gathered in
one task but in tiles, texts of candidates alone are read again, and hot classes are keys of joins that adaptive execution
splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.llm.common import components, id_and_text, mix, pieces, set_key, shingles_of, utf8_buffers, words_of
from vitalrates.session import cut_lineage, fits

WORDS, PERCENT = 4, 80
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Base of the registers and rate of the exponential variables; 16 bits then hold sets of up to 10^26 members.
BASE, RATE = 1.001, 20.0
TOP = (1 << 16) - 1
#: Log-likelihood that a pair may lack against its best similarity: 4.5 standard deviations.
SLACK = 10.0
TILE = 1_000
_ADD = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES = mix(np.arange(1001, 1001 + REGISTERS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
BYTES_AT_ONCE = 600_000


# --- sketches --------------------------------------------------------------------------------------------------------

def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets of 64-bit hashes, one row per set."""
    values, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((len(sets), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat((values ^ _ADD[i]) * _TIMES[i], starts)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1.0 - np.log(h) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets, or row by row of many."""
    return np.maximum(a, b)


def _log_likelihood(j, plus, minus, equal, u, v):
    """Of similarity j, given how many registers are larger, smaller and equal, and the shares u, v of the two sizes."""
    def larger(x):
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1.0) / BASE) / math.log(BASE)

    p, m = larger(u - v * j), larger(v - u * j)
    out = 0.0
    for count, chance in ((plus, p), (minus, m), (equal, 1.0 - p - m)):
        out = out + np.where(count > 0, count * np.log(np.maximum(chance, 1e-12)), 0.0)
    return out


def possible(plus, minus, n_a, n_b, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs may have the wanted similarity, and the likeliest similarity of each; sizes are known exactly."""
    equal = REGISTERS - plus - minus
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    grid = most[:, None] * np.linspace(0.0, 1.0, 65)[None, :]
    told = _log_likelihood(grid, *(x[:, None] for x in (plus, minus, equal, u, v)))
    best = told.argmax(axis=1)
    wanted = _log_likelihood(np.minimum(percent / 100.0, most), plus, minus, equal, u, v)
    estimate = grid[np.arange(len(grid)), best]
    fits_size = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return fits_size & ((estimate * 100 >= percent) | (told.max(axis=1) - wanted <= SLACK)), estimate


def _second_key(values: np.ndarray) -> int:
    return set_key(values * np.uint64(0xD6E8FEB86659FD93)) if len(values) else 0


def _sets(column, k: int) -> Iterator[list[np.ndarray]]:
    for a, b in pieces(column, BYTES_AT_ONCE):
        data, offsets = utf8_buffers(column.slice(a, b - a))
        hashes, _, _, rows = words_of(data, offsets)
        yield shingles_of(hashes, rows, b - a, k)


SKETCHED = "doc_id long, n_shingles long, key long, second long, bands array<long>"


def sketched_documents(docs: DataFrame, k: int = WORDS, **columns) -> DataFrame:
    """One row per input row: doc_id, n_shingles, two keys of the set, and its registers, ROWS to a long (NULL if empty)."""

    def scanned(batches):
        import pyarrow as pa

        for batch in batches:
            n, key, second, bands = [], [], [], []
            for sets in _sets(batch.column("text"), k):
                some = [s for s in sets if len(s)]
                rows = iter(sketches(some).view(np.int64).tolist() if some else [])
                n += [len(s) for s in sets]
                key += [set_key(s) for s in sets]
                second += [_second_key(s) for s in sets]
                bands += [next(rows) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(second, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
            ], names=["doc_id", "n_shingles", "key", "second", "bands"])

    return id_and_text(docs, **columns).mapInArrow(scanned, SKETCHED)


def classes_of(own: DataFrame) -> DataFrame:
    """One row per different set: node, key, second, n, first (smallest doc_id), bands. Clashes of `key` are told apart."""
    grouped = own.where("n_shingles > 0").groupBy("key", "second").agg(
        F.first("n_shingles").alias("n"), F.min("doc_id").alias("first"), F.first("bands").alias("bands"))
    grouped = cut_lineage(grouped)
    clashing = grouped.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("clash"))
    marked = grouped.join(clashing, "key", "left")
    node = F.when(F.col("clash"), F.xxhash64("key", "second")).otherwise(F.col("key"))
    return cut_lineage(marked.select(node.alias("node"), "key", "second", "n", "first", "bands"))


# --- candidates ------------------------------------------------------------------------------------------------------

def _registers(column) -> np.ndarray:
    """Rows of registers from an Arrow column of band lists."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)).view(np.uint16)


def _likely(percent: int):
    def chosen(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _registers(batch.column("bands_a")), _registers(batch.column("bands_b"))
            plus, minus = (x > y).sum(axis=1), (x < y).sum(axis=1)
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            keep, _ = possible(plus, minus, n_a, n_b, percent)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    return chosen


def _likely_pairs(met: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    a = classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bands").alias("bands_a"))
    b = classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bands").alias("bands_b"))
    both = met.join(a, "a").join(b, "b").where(
        100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "n_a", "n_b", "bands_a", "bands_b").mapInArrow(_likely(percent), "a long, b long")


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int, **columns) -> DataFrame:
    """node, n, members (hashes of the full set as bytes) of the wanted nodes, from their first documents' texts."""
    some = cut_lineage(classes.join(wanted, "node", "left_semi").select("node", "key", "second", "first"))
    firsts = some.select(F.col("first").alias("doc_id")).distinct()
    base = id_and_text(docs, **columns)
    firsts = F.broadcast(firsts) if fits(firsts) else firsts
    base = base.join(firsts.withColumnRenamed("doc_id", "wanted_id"), F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")

    def scanned(batches):
        import pyarrow as pa

        for batch in batches:
            for sets in _sets(batch.column("text"), k):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([set_key(s) for s in sets], pa.int64()), pa.array([_second_key(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ], names=["key", "second", "members"])

    told = base.select("text").mapInArrow(scanned, "key long, second long, members binary")
    return told.join(some, ["key", "second"]).dropDuplicates(["node"]).select("node", "members")


def _confirmed(percent: int):
    def checked(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("members_a", "members_b"))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    return checked


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, **columns) -> DataFrame:
    """The pairs of nodes whose full sets have the wanted similarity."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = cut_lineage(full_sets(docs, classes, wanted, k, **columns))
    a = sets.select(F.col("node").alias("a"), F.col("members").alias("members_a"))
    b = sets.select(F.col("node").alias("b"), F.col("members").alias("members_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "members_a", "members_b")
    return cut_lineage(both.mapInArrow(_confirmed(percent), "a long, b long"))


# --- buckets of several components -----------------------------------------------------------------------------------

def spanning(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the edges (a, b) that join components, at most one less than there are labels, and the new labels."""
    chosen, at = [], np.arange(len(a))
    while True:
        x, y = label[a[at]], label[b[at]]
        apart = x != y
        at, high, low = at[apart], np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        if not len(at):
            return np.concatenate([np.zeros(0, np.int64), *chosen]), label
        hooked, first = np.unique(high, return_index=True)  # every larger label hooks onto one smaller label
        chosen.append(at[first])
        to = np.arange(len(label))
        to[hooked] = low[first]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _tile_rows(batches, names: tuple[str, ...], read) -> Iterator[dict]:
    """The rows of one tile after the other, as columns; its rows are neighbours, about 2 TILE at most."""
    last, held = None, []

    def joined():
        return {c: np.concatenate([h[c] for h in held]) if isinstance(held[0][c], np.ndarray) else [v for h in held for v in h[c]]
                for c in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        part = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("side", "node", "root")} | read(batch)
        for a, b in zip(cuts, cuts[1:]):
            here = tuple(key[a])
            if held and here != last:
                yield joined()
                held = []
            last = here
            held.append({c: v[a:b] for c, v in part.items()})
    if held:
        yield joined()


def _two_sides(rows: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows of either side, and the components as small numbers."""
    _, label = np.unique(rows["root"], return_inverse=True)
    return np.flatnonzero(rows["side"] == 0), np.flatnonzero(rows["side"] == 1), label


def _edges(rows: dict, a: np.ndarray, b: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(rows["node"][a]), pa.array(rows["node"][b])], names=["a", "b"])


def _likely_tiles(percent: int):
    """Per tile of registers: for every member with a likely partner in another component one such, and a spanning forest."""

    def read(batch):
        return {"n": batch.column("n").to_numpy(zero_copy_only=False), "bands": _registers(batch.column("bands"))}

    def compared(batches):
        for rows in _tile_rows(batches, ("band", "bucket", "row", "column"), read):
            x, y, label = _two_sides(rows)
            n, bands, told, hanging = rows["n"], rows["bands"], np.zeros(len(label), bool), label
            for start in range(0, len(x), 100):
                own = x[start : start + 100]
                small, large = np.minimum.outer(n[own], n[y]), np.maximum.outer(n[own], n[y])
                i, j = np.nonzero((label[own][:, None] != label[y][None, :]) & (100 * small >= percent * large))
                p, q = own[i], y[j]
                plus, minus = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
                for r in range(REGISTERS):
                    a, b = bands[p, r], bands[q, r]
                    plus += a > b
                    minus += a < b
                near = np.flatnonzero((REGISTERS - plus - minus) * 200 >= percent * REGISTERS)  # else ten deviations away
                keep = near[possible(plus[near], minus[near], n[p[near]], n[q[near]], percent)[0]]
                p, q = p[keep], q[keep]
                joining, hanging = spanning(p, q, hanging)
                _, one = np.unique(p, return_index=True)
                _, two = np.unique(q, return_index=True)
                new = np.unique(np.concatenate((joining, one[~told[p[one]]], two[~told[q[two]]])))
                told[p] = told[q] = True
                yield _edges(rows, p[new], q[new])

    return compared


def overlaps(x: list[np.ndarray], y: list[np.ndarray], columns: int = 4_096) -> np.ndarray:
    """Exact sizes of the intersections of every set of `x` with every set of `y`, as products of 0/1 matrices."""
    every = np.concatenate([*x, *y])
    owner = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    _, member, holders = np.unique(every, return_inverse=True, return_counts=True)
    shared = holders > 1  # what a single set holds cannot be common
    number = np.cumsum(shared) - 1
    use = shared[member]
    member, owner = number[member[use]], owner[use]
    order = np.argsort(member, kind="stable")
    member, owner = member[order], owner[order]
    out = np.zeros((len(x), len(y)), np.float64)
    for start in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(member, (start, start + columns))
        matrix = np.zeros((len(x) + len(y), columns), np.float32)
        matrix[owner[a:b], member[a:b] - start] = 1.0
        out += matrix[: len(x)] @ matrix[len(x) :].T
    return out.astype(np.int64)


def _exact_tiles(percent: int):
    """Per tile of full sets: the links that join components."""

    def read(batch):
        column = batch.column("members")
        return {"members": [np.frombuffer(column[i].as_buffer(), np.uint64).copy() for i in range(len(column))]}

    def compared(batches):
        for rows in _tile_rows(batches, ("cluster", "row", "column"), read):
            x, y, label = _two_sides(rows)
            if not len(x) or not len(y):
                continue
            sizes = np.array([len(m) for m in rows["members"]])
            common = overlaps([rows["members"][i] for i in x], [rows["members"][j] for j in y])
            union = sizes[x][:, None] + sizes[y][None, :] - common
            i, j = np.nonzero((100 * common >= percent * union) & (label[x][:, None] != label[y][None, :]))
            joining, _ = spanning(x[i], y[j], label)
            yield _edges(rows, x[i][joining], y[j][joining])

    return compared


def tiled(members: DataFrame, group: list[str], tile: int) -> DataFrame:
    """Members (`group`, node, root) of the groups with several roots, dealt to tiles that bring every member outside its
    group's largest root together with every other member: plus row, column and side (0, 1)."""
    counts = members.groupBy(*group, "root").agg(F.count("*").alias("n"))
    mixed = counts.groupBy(*group).agg(
        F.count("*").alias("roots"), F.sum("n").alias("members"), F.max("n").alias("largest"), F.max_by("root", "n").alias("main"))
    mixed = mixed.where("roots > 1").select(
        *group, "main", F.ceil((F.col("members") - F.col("largest")) / F.lit(tile)).cast("int").alias("rows"),
        F.ceil(F.col("members") / F.lit(tile)).cast("int").alias("columns"))
    members = members.select(*group, "node", "root").join(mixed, group)
    slot = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    small = members.where("root <> main").select(
        *group, "node", "root", slot("rows").alias("row"), F.explode(every("columns")).alias("column"), F.lit(0).alias("side"))
    large = members.select(
        *group, "node", "root", F.explode(every("rows")).alias("row"), slot("columns").alias("column"), F.lit(1).alias("side"))
    return small.union(large)


def _by_tile(rows: DataFrame, group: list[str]) -> DataFrame:
    keys = [*group, "row", "column"]
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def likely_edges(buckets: DataFrame, classes: DataFrame, roots: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect whatever has a likely link across components; `buckets` has band, bucket, node."""
    group = ["band", "bucket"]
    rows = tiled(with_roots(buckets, roots), group, tile)
    rows = rows.join(classes.select("node", F.col("n").cast("long").alias("n"), "bands"), "node")
    return _by_tile(rows, group).mapInArrow(_likely_tiles(percent), "a long, b long").distinct()


def exact_edges(
    near: DataFrame, docs: DataFrame, classes: DataFrame, roots: DataFrame, k: int, percent: int, tile: int = TILE, **columns
) -> DataFrame:
    """Links between components among the nodes of the `near` edges, which are compared within what hangs together."""
    nodes = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    involved = cut_lineage(with_roots(nodes, roots))
    hanging = near.union(involved.select(F.col("node").alias("a"), F.col("root").alias("b")))
    cluster = components(hanging).select("node", F.col("root").alias("cluster"))
    rows = tiled(involved.join(cluster, "node"), ["cluster"], tile)
    sets = cut_lineage(full_sets(docs, classes, nodes, k, **columns))
    rows = _by_tile(rows.join(sets, "node"), ["cluster"])
    return cut_lineage(rows.mapInArrow(_exact_tiles(percent), "a long, b long"))


# --- the whole -------------------------------------------------------------------------------------------------------

def class_roots(docs: DataFrame, classes: DataFrame, k: int = WORDS, percent: int = PERCENT, tile: int = TILE, **columns) -> DataFrame:
    """node, root of the classes that are linked to another one."""
    banded = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    first = banded.groupBy("band", "bucket").agg(F.min("node").alias("a"), F.count("*").alias("members")).where("members > 1")
    shared = cut_lineage(banded.join(first.drop("members"), ["band", "bucket"]))
    stars = shared.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    pairs = cut_lineage(_likely_pairs(stars, classes, percent))
    links = verified(pairs, docs, classes, k, percent, **columns)
    buckets = shared.select("band", "bucket", "node")
    roots = cut_lineage(components(links))
    near = cut_lineage(likely_edges(buckets, classes, roots, percent, tile))
    if near.isEmpty():
        return roots
    return components(links.union(exact_edges(near, docs, classes, roots, k, percent, tile, **columns)))


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, tile: int = TILE, **columns) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    NULL, empty and word-less texts have no shingles, are linked with nothing and stay; texts of fewer than k words are one
    shingle. Repeated rows are one class and share their fate, so both rows of a smallest doc_id stay. A row without a doc_id
    can link others; it is kept only where its component has no doc_id at all, and its component_id is then NULL. Sets count
    as equal when two 64-bit keys agree. Extra columns are ignored.
    """
    own = cut_lineage(sketched_documents(docs, k, **columns))
    classes = classes_of(own)
    roots = class_roots(docs, classes, k, percent, tile, **columns)
    placed = cut_lineage(classes.select("node", "key", "second", "first").join(roots, "node", "left")
                         .select("key", "second", "first", F.coalesce("root", "node").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    final = placed.join(smallest, "root").select("key", "second", "component_id")
    some = own.where("n_shingles > 0").join(final, ["key", "second"]).select("doc_id", "n_shingles", "component_id")
    out = some.union(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.withColumn("kept", kept)
