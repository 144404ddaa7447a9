"""Similarity join on word shingles: which documents have a shingle Jaccard of at least a threshold, as components.

1. Texts with equal shingle sets are one class, whatever their number.
2. Shingles are dealt to ranges of their hash, packed, one entry per class and task. A range tells how many classes hold each
   shingle; only shared shingles (two classes at least) go back to their class. A class that shares fewer than
   ceil(t n) of its n shingles has no partner, which is exact, and leaves.
3. Ordered by (classes that hold it, hash), the first shared - ceil(t n) + 1 shingles of two linked classes meet (prefix
   filter; shingles of a single class come first and never meet). Classes that meet at comparable size form loose clusters.
4. Each cluster, in blocks, is a signature tree: leaves are shingle bitmaps, inner nodes OR their children's bitmaps and
   hold size ranges. A dual traversal drops node pairs whose largest possible overlap is too small or whose members are
   already connected, and verifies the rest on the shingles. The cluster's first class stands in every block, so blocks
   connect through it; members that it does not reach are compared with every block in a second round.

No pair list of a group is ever made, and no group is larger than a block. Hashes have 48 bits within a range; a wrong
overlap needs a collision between two compared documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalrates.llm.common import components, id_and_text, pieces, set_key, shingles_of, utf8_buffers, words_of
from vitalrates.session import cut_lineage

WORDS, PERCENT = 5, 75
BLOCK = 2_000
HELD = 3_000_000
BITS, FANOUT = 1024, 8
LOW48 = np.uint64((1 << 48) - 1)


def _sets(column, k: int) -> Iterator[np.ndarray]:
    for a, b in pieces(column):
        data, offsets = utf8_buffers(column.slice(a, b - a))
        hashes, _, _, rows = words_of(data, offsets)
        yield from shingles_of(hashes, rows, b - a, k)


def shingle_classes(docs: DataFrame, k: int = WORDS, **columns) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class (key of its shingle set)."""

    def keyed(batches):
        import pyarrow as pa

        for batch in batches:
            sets = list(_sets(batch.column("text"), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64())],
                names=["doc_id", "n_shingles", "class"],
            )

    return id_and_text(docs, **columns).mapInArrow(keyed, "doc_id long, n_shingles long, class long")


def _places(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions an integer that hash partitioning sends there."""
    rows = spark.range(n * 40 + 400).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
    found = {r.p: int(r.id) for r in rows.collect()}
    return [found.get(p, p) for p in range(n)]


def _pack(order_by: np.ndarray, owner: np.ndarray, keys: np.ndarray, sizes: np.ndarray, values: list[np.ndarray], places: list[int]):
    """Rows (place, keys, sizes, counts, values...) of postings dealt by `order_by`; postings of one owner are neighbours."""
    order = np.argsort(order_by, kind="stable")
    part, own = order_by[order], owner[order]
    values = [v[order] for v in values]
    bounds = np.searchsorted(part, np.arange(len(places) + 1))
    for p in range(len(places)):
        a, b = bounds[p], bounds[p + 1]
        if a == b:
            continue
        new = np.flatnonzero(np.concatenate(([True], own[a + 1 : b] != own[a : b - 1])))
        counts = np.diff(np.concatenate((new, [b - a]))).astype(np.uint32)
        ids = own[a:b][new]
        yield (places[p], keys[ids].tobytes(), sizes[ids].tobytes(), counts.tobytes(), *[v[a:b].tobytes() for v in values])


PACKED = "place int, keys binary, sizes binary, counts binary, low binary, high binary"


def _packed_batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["place", "keys", "sizes", "counts", "low", "high"]
    )


def _postings(k: int, places: list[int]):
    def dealt(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        keys: list[int] = []
        total = 0

        def flush():
            sizes = np.array([len(s) for s in held], np.uint32)
            owner = np.repeat(np.arange(len(held)), sizes)
            all_ = np.concatenate(held)
            ranges = ((all_ >> np.uint64(48)) % np.uint64(len(places))).astype(np.int64)
            low, high = (all_ & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((all_ & LOW48) >> np.uint64(32)).astype(np.uint16)
            return _packed_batch(list(_pack(ranges, owner, np.array(keys, np.int64), sizes, [low, high], places)))

        for batch in batches:
            for s in _sets(batch.column("text"), k):
                if not len(s):
                    continue
                key = set_key(s)
                if key in seen:
                    continue
                seen.add(key)
                held.append(s)
                keys.append(key)
                total += len(s)
                if total > HELD:
                    yield flush()
                    held, keys, total = [], [], 0
            if len(seen) > HELD:
                seen.clear()
        if held:
            yield flush()

    return dealt


def _gathered(batches, value_types):
    """All packed rows of a partition, one list of arrays per place."""
    by_place: dict[int, list] = {}
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for place, keys, sizes, counts, low, high in zip(*columns):
            own = by_place.setdefault(place, [[], [], [], [], []])
            for at, (raw, kind) in enumerate(zip((keys, sizes, counts, low, high), (np.int64, np.uint32, np.uint32, *value_types))):
                own[at].append(np.frombuffer(raw, kind))
    for place in list(by_place):
        yield place, [np.concatenate(x) for x in by_place.pop(place)]


def _shared(places: list[int]):
    """Per range: the shingles that several classes hold, packed by class."""
    range_of = {p: i for i, p in enumerate(places)}

    def shared(batches):
        for place, (keys, sizes, counts, low, high) in _gathered(batches, (np.uint32, np.uint16)):
            _, first = np.unique(keys, return_index=True)  # a class that several tasks met counts once
            once = np.zeros(len(keys), bool)
            once[first] = True
            owner = np.repeat(np.arange(len(keys)), counts)
            use = once[owner]
            owner = owner[use]
            value = low[use].astype(np.uint64) | (high[use].astype(np.uint64) << np.uint64(32))
            order = np.argsort(value, kind="stable")
            sorted_ = value[order]
            new = np.concatenate(([True], sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            holders = np.diff(np.concatenate((starts, [len(sorted_)])))
            each = np.repeat(holders, holders)
            some = each > 1
            if not some.any():
                continue
            kept, held = order[some], np.minimum(each[some], 65_535).astype(np.uint16)
            back = np.argsort(kept, kind="stable")  # neighbours of one class again
            kept, held = kept[back], held[back]
            own = owner[kept]
            full = value[kept] | (np.uint64(range_of[place]) << np.uint64(48))
            target = (keys[own] % len(places)).astype(np.int64)
            yield _packed_batch(list(_pack(target, own, keys, sizes, [full, held], places)))

    return shared


CANDIDATES = "class long, n int, shared binary, prefix array<long>"


def least_overlap(n, percent: int):
    return (n * percent + 99) // 100


def _candidates(percent: int):
    """Per class: drop it when it shares too little, else its shared shingles and its prefix."""

    def chosen(batches):
        import pyarrow as pa

        out: list[tuple] = []
        for _, (keys, sizes, counts, value, held) in _gathered(batches, (np.uint64, np.uint16)):
            owner = np.repeat(keys, counts)
            order = np.lexsort((value, held, owner))
            owner, value = owner[order], value[order]
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, int)
            by_key = dict(zip(keys.tolist(), sizes.tolist()))
            for a, b in zip(starts, np.concatenate((starts[1:], [len(owner)]))):
                key = int(owner[a])
                n = by_key[key]
                prefix = int(b - a) - least_overlap(n, percent) + 1
                if prefix >= 1:
                    own = value[a:b]
                    out.append((key, n, np.sort(own).tobytes(), own[:prefix].view(np.int64).tolist()))
        types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        for i in range(0, len(out), 500):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out[i : i + 500]), types)], names=["class", "n", "shared", "prefix"]
            )

    return chosen


# --- signature trees -------------------------------------------------------------------------------------------------

class SignatureTree:
    """Bitmaps and size ranges of sets, leaves in order of size, each node over FANOUT of the level below."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        bitmap = np.zeros((len(sets), BITS), bool)
        for i, s in enumerate(sets):
            bitmap[i, (s % np.uint64(BITS)).astype(np.int64)] = True
        words = np.packbits(bitmap, axis=1).view(np.uint64)
        shared = np.array([len(s) for s in sets])
        excess = shared - np.bitwise_count(words).sum(axis=1)
        self.levels = [(words, sizes, sizes, excess)]
        while len(self.levels[-1][0]) > 1:
            words, low, high, excess = self.levels[-1]
            at = np.arange(0, len(words), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(words, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                np.maximum.reduceat(excess, at),
            ))

    def labels(self, leaf: np.ndarray) -> list[np.ndarray]:
        """Of every node the component of all its leaves, or -1."""
        out = [leaf]
        for level in self.levels[1:]:
            at = np.arange(0, len(out[-1]), FANOUT)
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1)[: len(level[0])])
        return out


def _possible(a, b, p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Whether node pairs can hold a linked pair, by the size ranges and the largest possible overlap."""
    least_a, most_a, least_b, most_b = a[1][p], a[2][p], b[1][q], b[2][q]
    fits = (100 * most_a >= percent * least_b) & (100 * most_b >= percent * least_a)
    common = np.bitwise_count(a[0][p] & b[0][q]).sum(axis=1)
    most = common + np.minimum(a[3][p], b[3][q])
    return fits & (most >= least_overlap(np.maximum(least_a, least_b), percent))


def dual_traversal(a: SignatureTree, b: SignatureTree, labels_a, labels_b, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs that may be linked and are not yet connected, in portions; both trees must have as many levels."""
    self_join = a is b
    top = len(a.levels) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, p, q = stack.pop()
        if len(p) > 20_000:  # depth first, so that few pairs are held
            half = len(p) // 2
            stack += [(level, p[half:], q[half:]), (level, p[:half], q[:half])]
            continue
        apart = (labels_a[level][p] != labels_b[level][q]) | (labels_a[level][p] < 0)
        p, q = p[apart], q[apart]
        use = _possible(a.levels[level], b.levels[level], p, q, percent)
        p, q = p[use], q[use]
        if not len(p):
            continue
        if level == 0:
            yield (p[p < q], q[p < q]) if self_join else (p, q)
            continue
        step = np.arange(FANOUT)
        p = np.repeat(p[:, None] * FANOUT + step, FANOUT, axis=1).ravel()
        q = np.tile(q[:, None] * FANOUT + step, (1, FANOUT)).ravel()
        real = (p < len(a.levels[level - 1][0])) & (q < len(b.levels[level - 1][0]))
        if self_join:
            real &= p <= q
        stack.append((level - 1, p[real], q[real]))


class _Union:
    def __init__(self, labels: np.ndarray):
        self.labels = labels

    def join(self, x: int, y: int) -> None:
        a, b = self.labels[x], self.labels[y]
        if a != b:
            self.labels[self.labels == max(a, b)] = min(a, b)


def linked(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (n_x + n_y - common)


def _verify(pairs, union: _Union, sets, sizes, offset: int, percent: int) -> None:
    """Verify leaf pairs while their ends are not connected; `offset` is where the second tree's leaves start."""
    for p, q in pairs:
        q = q + offset
        while len(p):
            apart = union.labels[p] != union.labels[q]
            p, q = p[apart], q[apart]
            if not len(p):
                break
            # one candidate for each pair of components, then look again at what is still apart
            _, first = np.unique(np.stack((union.labels[p], union.labels[q])), axis=1, return_index=True)
            for i in first:
                x, y = int(p[i]), int(q[i])
                if union.labels[x] != union.labels[y] and linked(sets[x], sets[y], sizes[x], sizes[y], percent):
                    union.join(x, y)
            rest = np.ones(len(p), bool)
            rest[first] = False
            p, q = p[rest], q[rest]


def block_components(keys: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], pivot: int, percent: int) -> np.ndarray:
    """Smallest key of each member's component within a block; the pivot is compared with everyone first."""
    order = np.lexsort((keys, sizes))
    keys, sizes, sets = keys[order], sizes[order], [sets[i] for i in order]
    union = _Union(np.arange(len(keys)))
    star = int(np.flatnonzero(keys == pivot)[0]) if (keys == pivot).any() else 0
    for i in range(len(keys)):
        if i != star and linked(sets[star], sets[i], sizes[star], sizes[i], percent):
            union.join(star, i)
    if len(np.unique(union.labels)) > 1:
        tree = SignatureTree(sets, sizes)
        labels = tree.labels(union.labels.copy())
        _verify(dual_traversal(tree, tree, labels, labels, percent), union, sets, sizes, 0, percent)
    out = np.empty(len(keys), np.int64)
    for label in np.unique(union.labels):
        own = union.labels == label
        out[order[own]] = keys[own].min()
    return out


def cross_components(left, right, percent: int) -> list[tuple[int, int]]:
    """Edges between members of two blocks, each (keys, sizes, sets, components), that connect their components."""
    sides = []
    for keys, sizes, sets, comps in (left, right):
        order = np.lexsort((keys, sizes))
        sides.append((keys[order], sizes[order], [sets[i] for i in order], comps[order]))
    trees = [SignatureTree(s[2], s[1]) for s in sides]
    most = max(len(t.levels) for t in trees)
    for t in trees:
        while len(t.levels) < most:
            t.levels.append(t.levels[-1])
    comps = np.concatenate((sides[0][3], sides[1][3]))
    _, start = np.unique(comps, return_inverse=True)
    union, split = _Union(start.astype(np.int64)), len(sides[0][0])
    labels = [t.labels(x.copy()) for t, x in zip(trees, (start[:split], start[split:]))]
    sets, sizes = sides[0][2] + sides[1][2], np.concatenate((sides[0][1], sides[1][1]))
    _verify(dual_traversal(trees[0], trees[1], *labels, percent), union, sets, sizes, split, percent)
    keys, edges = np.concatenate((sides[0][0], sides[1][0])), []
    for label in np.unique(union.labels):
        own = np.flatnonzero(union.labels == label)
        edges += [(int(keys[own].min()), int(keys[i])) for i in own]
    return edges


def _runs(batches, names: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Neighbouring rows with equal `names`."""
    last, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[n] for n in names)
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(row)
    if held:
        yield last, held


def _arrays(rows: list[dict]):
    return (
        np.array([r["class"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64),
        [np.frombuffer(r["shared"], np.uint64) for r in rows],
    )


def _edge_batches(found: Iterator[tuple[int, int]]):
    import pyarrow as pa

    held: list[tuple[int, int]] = []
    for edge in found:
        held.append(edge)
        if len(held) == 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=["a", "b"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=["a", "b"])


def class_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, block: int = BLOCK, **columns) -> DataFrame:
    """node, root for the classes of equal shingle sets that are linked to another class."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = _places(spark, parts)
    base = id_and_text(docs, **columns)
    ranges = base.mapInArrow(_postings(k, places), PACKED).repartition(parts, "place")
    shared = ranges.mapInArrow(_shared(places), PACKED).repartition(parts, "place")
    known = cut_lineage(shared.mapInArrow(_candidates(percent), CANDIDATES))
    # Sizes of linked sets differ by a factor of at most 100 / percent: they fall in the same step or in neighbouring ones.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) - F.lit(1e-9)).cast("int")
    met = (
        known.select("class", step.alias("step"), F.explode("prefix").alias("shingle"))
        .select("class", "shingle", F.explode(F.array("step", F.col("step") + 1)).alias("step"))
    )
    least = met.groupBy("shingle", "step").agg(F.min("class").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = met.join(least, ["shingle", "step"]).where("class <> first").select(F.col("first").alias("a"), F.col("class").alias("b"))
    loose = cut_lineage(components(edges.distinct()))
    blocks = loose.groupBy("root").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    place = loose.join(blocks, "root").select("root", "blocks", F.col("node").alias("class"))
    numbers = F.when(F.col("class") == F.col("root"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    )
    members = place.select("root", "blocks", "class", F.explode(numbers).alias("block")).join(known.drop("prefix"), "class")

    def inside(batches):
        def found():
            for (root, _), rows in _runs(batches, ["root", "block"]):
                keys, sizes, sets = _arrays(rows)
                comps = block_components(keys, sizes, sets, root, percent)
                yield from zip(comps.tolist(), keys.tolist())

        yield from _edge_batches(found())

    tight = members.repartition("root", "block").sortWithinPartitions("root", "block").mapInArrow(inside, "a long, b long")
    tight = cut_lineage(tight)
    if not blocks.where("blocks > 1").isEmpty():
        tight = tight.union(_between_blocks(members.where("blocks > 1"), tight, block, percent))
    return components(tight)


def _between_blocks(members: DataFrame, tight: DataFrame, block: int, percent: int) -> DataFrame:
    """Edges between the blocks of a cluster: whoever its first class does not reach is compared with every block."""
    now = cut_lineage(components(tight)).select(F.col("node").alias("class"), F.col("root").alias("component"))
    own = members.join(now, "class")
    first = own.where(F.col("class") == F.col("root")).select("root", F.col("component").alias("reached")).distinct()
    own = cut_lineage(own.join(first, "root"))
    rest = own.where(F.col("component") != F.col("reached")).dropDuplicates(["root", "class"])
    chunks = rest.groupBy("root").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("chunks"))
    one_side = own.join(chunks, "root").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    other = rest.join(chunks, "root").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    other = other.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["root", "block", "chunk", "class", "n", "shared", "component"]
    both = one_side.select(*columns, F.lit(0).alias("side")).union(other.select(*columns, F.lit(1).alias("side")))

    def across(batches):
        def found():
            for _, rows in _runs(batches, ["root", "block", "chunk"]):
                sides = [[r for r in rows if r["side"] == s] for s in (0, 1)]
                if all(sides):
                    made = [(*_arrays(s), np.array([r["component"] for r in s], np.int64)) for s in sides]
                    yield from cross_components(*made, percent)

        yield from _edge_batches(found())

    keys = ["root", "block", "chunk"]
    return both.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(across, "a long, b long")


def similar_documents(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, block: int = BLOCK, **columns) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    NULL, empty and word-less texts have no shingles and are linked with nothing; texts of fewer than k words are one
    shingle. Repeated rows belong to one class. Extra columns are ignored.
    """
    own = cut_lineage(shingle_classes(docs, k, **columns))
    first = own.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("first"))
    roots = class_components(docs, k, percent, block, **columns).withColumnRenamed("node", "class")
    placed = cut_lineage(first.join(roots, "class", "left").select("class", "first", F.coalesce("root", "class").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    final = placed.join(smallest, "root").select("class", "component_id")
    out = own.where("n_shingles > 0").join(final, "class").select("doc_id", "n_shingles", "component_id")
    return out.union(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id")))
