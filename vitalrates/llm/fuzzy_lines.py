"""Fuzzy line deduplication: MinHash over character shingles, banding, exact verification, components of lines.

A line's set holds its SHINGLE-character shingles (a shorter line is one shingle). Signatures are minima of one shingle
hash xor-ed with BANDS * ROWS constants; bands of ROWS minima are bucket keys. In a bucket every line is compared with the
bucket's smallest line; after components, members of one bucket that are still apart are compared in tiles, whose overlaps are
one exact product of 0/1 matrices and from which only links that join components leave. Of every component the first line of the
smallest document stays.

The signatures run in numpy on the executors; the README gives the figures of the same in built-in functions. Everything after them is joins and groupings, and no group is gathered except the ids of one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.llm.common import _power_tables, components, id_and_text, mix
from vitalrates.llm.ngram_join import PACKED, _gathered, _pack, _packed_batch, _places
from vitalrates.llm.setsketch import TILE, _by_tile, _edges, _tile_rows, _two_sides, overlaps, spanning, tiled, with_roots
from vitalrates.session import cut_lineage

SHINGLE, BANDS, ROWS = 8, 12, 4
PERCENT = 75
HELD = 150_000
CHARS_AT_ONCE = 100_000
HASHES_AT_ONCE, PAIRS_AT_ONCE = 50_000, 500
_CONSTANTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).astype(np.uint32)


def _slices(sizes, most: int, count: int | None = None) -> Iterator[tuple[int, int]]:
    """Neighbours whose sizes add up to about `most`, at most `count` of them; one alone may be larger."""
    ends, a = np.cumsum(sizes), 0
    while a < len(ends):
        b = max(int(np.searchsorted(ends, most + (ends[a - 1] if a else 0), side="right")), a + 1)
        b = min(b, a + (count or b))
        yield a, b
        a = b


def lines_of(text: str) -> list[tuple[int, str]]:
    """(line number, line) of the lines that hold more than white space."""
    return [(i, line) for i, line in enumerate(text.split("\n")) if line and not line.isspace()]


class LineBatch:
    """Hashes of many lines at once: one buffer of code points, shingles by differences of running sums."""

    def __init__(self, lines: list[str]):
        self.sizes = np.array([len(x) for x in lines], np.int64)
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        powers, self.inverse = _power_tables(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0xA5A5A5A5)) * powers[: len(codes)], out=self.sums[1:])

    def ids(self) -> np.ndarray:
        """A signed 64-bit key of every line."""
        a, b = self.starts[:-1], self.starts[1:]
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a] + self.sizes.astype(np.uint64)).view(np.int64)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles and the place of each line's first; every line has one at least."""
        counts = np.maximum(self.sizes - size + 1, 1)
        first = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(first[-1]) - np.repeat(first[:-1] - self.starts[:-1], counts)
        end = np.minimum(at + size, np.repeat(self.starts[1:], counts))
        return mix((self.sums[end] - self.sums[at]) * self.inverse[at] + (end - at).astype(np.uint64)), first

    def bands(self) -> np.ndarray:
        """Bucket keys, one row per line and one column per band."""
        hashes, first = self.shingles(SHINGLE)
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.empty((len(first) - 1, BANDS * ROWS), np.uint64)
        for a, b in _slices(np.diff(first), HASHES_AT_ONCE):  # a slice stays in the processor's cache
            own, starts = low[first[a] : first[b]], first[a:b] - first[a]
            moved = np.empty_like(own)
            for r, c in enumerate(_CONSTANTS):
                least[a:b, r] = np.minimum.reduceat(np.bitwise_xor(own, c, out=moved), starts)
        key = np.zeros((len(least), BANDS), np.uint64)
        for r in range(ROWS):
            key = mix(key + least[:, r::ROWS] + np.uint64(r + 1))
        return mix(key + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _portions(batches) -> Iterator[list[tuple[int, int, str]]]:
    """(doc_id, line number, line) in portions of about CHARS_AT_ONCE characters."""
    held, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            for number, line in lines_of(text):
                held.append((doc, number, line))
                size += len(line)
                if size > CHARS_AT_ONCE:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _new_lines(batches) -> Iterator[tuple[list[str], np.ndarray]]:
    """Lines not met before in this task, and their ids."""
    seen: set[int] = set()
    for portion in _portions(batches):
        every = list({line for _, _, line in portion})
        ids = LineBatch(every).ids()
        new = [i for i, k in enumerate(ids.tolist()) if k not in seen]
        if len(seen) > 2_000_000:
            seen.clear()
        seen.update(ids[new].tolist())
        if new:
            yield [every[i] for i in new], ids[new]


def _bucket_postings(places: list[int]):
    def dealt(batches):
        held, keys, total = [], [], 0

        def flush():
            owners = np.concatenate(keys)
            values = np.concatenate(held)
            owner = np.repeat(np.arange(len(owners)), BANDS)
            flat = values.ravel()
            ranges = ((flat >> np.uint64(48)) % np.uint64(len(places))).astype(np.int64)
            low, high = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
            sizes = np.full(len(owners), BANDS, np.uint32)
            return _packed_batch(list(_pack(ranges, owner, owners, sizes, [low, high], places)))

        for lines, ids in _new_lines(batches):
            held.append(LineBatch(lines).bands())
            keys.append(ids)
            total += len(ids)
            if total > HELD:
                yield flush()
                held, keys, total = [], [], 0
        if held:
            yield flush()

    return dealt


MET = "bucket long, a long, b long"


def _stars(batches):
    """Per bucket of several lines: its smallest line with each other one."""
    import pyarrow as pa

    for _, (keys, _, counts, low, high) in _gathered(batches, (np.uint32, np.uint32)):
        value = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        line = np.repeat(keys, counts)
        order = np.lexsort((line, value))
        value, line = value[order], line[order]
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (line[1:] != line[:-1]))) if len(value) else np.zeros(0, bool)
        value, line = value[new], line[new]
        starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, int)
        sizes = np.diff(np.concatenate((starts, [len(value)])))
        first = np.repeat(line[starts], sizes) if len(value) else line
        other = np.ones(len(value), bool)
        other[starts] = False
        for a in range(0, int(other.sum()), 50_000):
            rows = np.flatnonzero(other)[a : a + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[rows].view(np.int64)), pa.array(first[rows]), pa.array(line[rows])], names=["bucket", "a", "b"]
            )


def line_texts(base: DataFrame) -> DataFrame:
    """line_id and line, at least once for every different line."""

    def told(batches):
        import pyarrow as pa

        for lines, ids in _new_lines(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lines, pa.string())], names=["line_id", "line"])

    return base.mapInArrow(told, "line_id long, line string")


def _entries(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of many lines: the place of the line and the hash, by line and hash."""
    hashes, first = LineBatch(lines).shingles(SHINGLE)
    owner = np.repeat(np.arange(len(lines)), np.diff(first))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], hashes[new]


def _similar(x: list[str], y: list[str], percent: int) -> np.ndarray:
    """Which pairs of lines share at least `percent` of their shingles, told apart by 54 bits of their hashes."""
    keep = [np.zeros(0, bool)]
    for a, b in _slices([len(v) + len(w) for v, w in zip(x, y)], CHARS_AT_ONCE, PAIRS_AT_ONCE):
        n = b - a
        hashes, first = LineBatch(x[a:b] + y[a:b]).shingles(SHINGLE)
        # One sort of pair (9 bits), hash (54) and side (1): equal neighbours are repeats, equal but for the side are common.
        head = np.concatenate((np.arange(n), np.arange(n))).astype(np.uint64) << np.uint64(55)
        head[n:] |= np.uint64(1)
        key = np.repeat(head, np.diff(first)) | (hashes >> np.uint64(10) << np.uint64(1))
        key.sort()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
        pair, key = (key >> np.uint64(55)).astype(np.int64), key >> np.uint64(1)
        common = np.bincount(pair[1:][key[1:] == key[:-1]], minlength=n)
        keep.append(100 * common >= percent * (np.bincount(pair, minlength=n) - common))
    return np.concatenate(keep)


def _alike(percent: int):
    def checked(batches):
        import pyarrow as pa

        for batch in batches:
            mask = pa.array(_similar(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist(), percent), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return checked


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    with_a = pairs.join(texts.select(F.col("line_id").alias("a"), F.col("line").alias("line_a")), "a")
    both = with_a.join(texts.select(F.col("line_id").alias("b"), F.col("line").alias("line_b")), "b")
    return both.select("a", "b", "line_a", "line_b").mapInArrow(_alike(percent), "a long, b long")


def _tile_links(percent: int):
    """Per tile of a bucket: the links that join components, from the exact overlaps of all its lines."""

    def read(batch):
        return {"line": batch.column("line").to_pylist()}

    def joined(small):
        """Links of many small tiles, whose pairs are compared together."""
        if not small:
            return
        both = _similar([rows["line"][i] for rows, x, _, _ in small for i in x], [rows["line"][j] for rows, _, y, _ in small for j in y], percent)
        for (rows, x, y, label), alike in zip(small, np.split(both, np.cumsum([len(x) for _, x, _, _ in small])[:-1])):
            if alike.any():
                i, j = x[alike], y[alike]
                joining, _ = spanning(i, j, label)
                yield _edges(rows, i[joining], j[joining])

    def compared(batches):
        small, held = [], 0
        for rows in _tile_rows(batches, ("bucket", "row", "column"), read):
            x, y, label = _two_sides(rows)
            if not len(x) or not len(y):
                continue
            i, j = np.nonzero(label[x][:, None] != label[y][None, :])
            if len(i) <= 2 * len(label):
                small.append((rows, x[i], y[j], label))
                held += len(i)
                if held >= PAIRS_AT_ONCE:
                    yield from joined(small)
                    small, held = [], 0
                continue
            owner, hashes = _entries(rows["line"])
            sizes = np.bincount(owner, minlength=len(label))
            sets = np.split(hashes, np.cumsum(sizes)[:-1])
            common = overlaps([sets[i] for i in x], [sets[j] for j in y])
            union = sizes[x][:, None] + sizes[y][None, :] - common
            i, j = np.nonzero((100 * common >= percent * union) & (label[x][:, None] != label[y][None, :]))
            joining, _ = spanning(x[i], y[j], label)
            yield _edges(rows, x[i][joining], y[j][joining])
        yield from joined(small)

    return compared


def line_components(docs: DataFrame, percent: int = PERCENT, **columns) -> DataFrame:
    """node, root for every line (by id) that is similar to another one."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = id_and_text(docs, **columns)
    places = _places(spark, parts)
    met = base.mapInArrow(_bucket_postings(places), PACKED).repartition(parts, "place").mapInArrow(_stars, MET)
    met = cut_lineage(met)
    ids = met.select(F.col("a").alias("line_id")).union(met.select("b")).distinct()
    texts = cut_lineage(line_texts(base).join(ids, "line_id", "left_semi").dropDuplicates(["line_id"]))
    links = cut_lineage(_verified(met.select("a", "b").distinct(), texts, percent))
    roots = cut_lineage(components(links))
    members = met.select("bucket", F.col("a").alias("line_id")).union(met.select("bucket", "b")).distinct()
    rows = tiled(with_roots(members.withColumnRenamed("line_id", "node"), roots), ["bucket"], TILE)
    rows = _by_tile(rows.join(texts.withColumnRenamed("line_id", "node"), "node"), ["bucket"])
    more = cut_lineage(rows.mapInArrow(_tile_links(percent), "a long, b long"))
    return components(links.union(more))


def deduplicated_lines(docs: DataFrame, percent: int = PERCENT, **columns) -> DataFrame:
    """One row per doc_id: doc_id, n_lines, n_kept, kept_lines (numbers of the lines that stay, from 0).

    Only lines with more than white space count; the others always stay. Of every component of similar lines the first line
    of the smallest doc_id stays. NULL and empty texts have no lines; repeated rows of a doc_id count their lines together.
    Extra columns are ignored.
    """
    base = id_and_text(docs, **columns)

    def placed(batches):
        import pyarrow as pa

        for portion in _portions(batches):
            docs_, numbers, lines = zip(*portion)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs_, pa.int64()), pa.array(numbers, pa.int32()), pa.array(LineBatch(list(lines)).ids())],
                names=["doc_id", "number", "line_id"],
            )

    rows = base.mapInArrow(placed, "doc_id long, number int, line_id long")
    roots = line_components(docs, percent, **columns).withColumnRenamed("node", "line_id")
    held = rows.join(roots, "line_id", "left").withColumn("root", F.coalesce("root", "line_id"))
    held = cut_lineage(held.groupBy("doc_id", "root").agg(F.min("number").alias("number"), F.count("*").alias("n")))
    first = held.groupBy("root").agg(F.min("doc_id").alias("owner"))
    marked = held.join(first, "root").withColumn("kept", F.when(F.col("doc_id") == F.col("owner"), F.col("number")))
    out = marked.groupBy("doc_id").agg(
        F.sum("n").alias("n_lines"), F.count("kept").alias("n_kept"), F.sort_array(F.collect_list("kept")).alias("kept_lines"),
    )
    none = F.array().cast("array<int>")
    every = base.select("doc_id").distinct().join(out, "doc_id", "left")
    return every.select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
        F.coalesce("kept_lines", none).alias("kept_lines"),
    )


def without_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and the text with only the kept and the blank lines, by built-in functions."""
    joined = id_and_text(docs).join(found, "doc_id")
    kept = F.filter(
        F.split("text", "\n", -1),
        lambda line, i: (F.regexp_replace(line, r"\s", "") == "") | F.array_contains(F.col("kept_lines"), i),
    )
    return joined.select("doc_id", F.array_join(kept, "\n").alias("text"))
