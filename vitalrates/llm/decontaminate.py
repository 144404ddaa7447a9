"""Benchmark passages in documents, found by greedy string tiling.

A document and a benchmark item that share a run of SEED words are compared: running Karp-Rabin hashes find the longest
common runs of unmarked words, which are marked on both sides as a tile, again and again until no run of SEED words is
left. The share of the item's words under tiles is its coverage, whatever the order of the passages.

The benchmark is the query set: it goes to the tasks in blocks of bounded size, and every block meets every document once.
No documents meet each other, so an item that fills a third of the table is work in place and not a group.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.llm.common import id_and_text, pieces, run_hashes, utf8_buffers, words_of

SEED = 5
COVERAGE = 0.5
BLOCK_BYTES = 16_000_000
MATCHES = "doc_id long, item_id long, coverage double, tiles int, longest int, item_words int"


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word sequences (hashes): (start in a, start in b, words), longest first, then by place.

    Each round seeds on runs of `least` unmarked words with equal running hash, extends every seed as far as words agree and
    are unmarked, marks the longest runs that do not overlap, and ends when no seed is left.
    """
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    out: list[tuple[int, int, int]] = []
    if min(len(a), len(b)) < least:
        return out
    runs_a, runs_b = run_hashes(a, least), run_hashes(b, least)
    places = defaultdict(list)
    for j, h in enumerate(runs_b.tolist()):
        places[h].append(j)
    known = np.flatnonzero(np.isin(runs_a, runs_b)).tolist()
    while True:
        best, found = 0, []
        for i in known:
            if not free_a[i : i + least].all():
                continue
            for j in places[int(runs_a[i])]:
                if i and j and a[i - 1] == b[j - 1] and free_a[i - 1] and free_b[j - 1]:
                    continue  # part of the run that starts one word earlier
                if not free_b[j : j + least].all():
                    continue
                most = min(len(a) - i, len(b) - j)
                same = (a[i : i + most] == b[j : j + most]) & free_a[i : i + most] & free_b[j : j + most]
                n = most if same.all() else int(np.argmin(same))
                if n > best:
                    best, found = n, []
                if n == best and n >= least:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in found:
            if free_a[i : i + best].all() and free_b[j : j + best].all():
                free_a[i : i + best] = False
                free_b[j : j + best] = False
                out.append((i, j, best))


class _Block:
    """Items of one block: their words, and a sorted list of seed hashes with the items that hold them."""

    def __init__(self, rows: list, seed: int):
        from pyarrow import array, string

        data, offsets = utf8_buffers(array([r.text or "" for r in rows], string()))
        hashes, _, _, owner = words_of(data, offsets)
        bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
        self.ids = [r.item_id for r in rows]
        self.words = [hashes[x:y] for x, y in zip(bounds, bounds[1:])]
        self.least = [min(seed, len(w)) for w in self.words]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in sorted({n for n in self.least if n}):
            own = [i for i, n in enumerate(self.least) if n == k]
            keys = np.concatenate([run_hashes(self.words[i], k) for i in own])
            items = np.concatenate([np.full(len(self.words[i]) - k + 1, i) for i in own])
            order = np.argsort(keys, kind="stable")
            self.seeds[k] = keys[order], items[order]

    def matches(self, data: np.ndarray, offsets: np.ndarray, least_coverage: float) -> Iterator[tuple]:
        """(row, item, coverage, tiles, longest, item words) of the texts' pairs at or above the coverage."""
        hashes, _, _, owner = words_of(data, offsets)
        bounds = np.searchsorted(owner, np.arange(len(offsets)))
        pairs: set[tuple[int, int]] = set()
        for k, (keys, items) in self.seeds.items():
            runs = run_hashes(hashes, k)
            if not len(runs):
                continue
            low = np.searchsorted(keys, runs)
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == runs)
            hit = hit[owner[hit] == owner[hit + k - 1]]
            high = np.searchsorted(keys, runs[hit], side="right")
            for at, x, y in zip(hit.tolist(), low[hit].tolist(), high.tolist()):
                pairs.update((int(owner[at]), int(i)) for i in items[x:y])
        for row, i in sorted(pairs):
            own = self.words[i]
            found = tiles(own, hashes[bounds[row] : bounds[row + 1]], self.least[i])
            share = sum(n for _, _, n in found) / len(own)
            if found and share >= least_coverage:
                yield row, self.ids[i], share, len(found), max(n for _, _, n in found), len(own)


def item_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list]:
    """Benchmark items in blocks of at most `most` bytes of text; an item longer than that is a block of its own."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if held and size + len(row.text) > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row.text)
    if held:
        yield held


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, *, seed: int = SEED, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
    **columns,
) -> DataFrame:
    """One row per document row and item covered at least by `coverage`: doc_id, item_id, coverage, tiles, longest, item_words.

    Items of fewer than `seed` words must occur whole; items and documents without words match nothing; an empty benchmark
    or table gives no rows. Repeated rows each give their matches. Extra columns are ignored.
    """
    base = id_and_text(docs, **columns)

    def against(block: list):
        rows = [r for r in block if r.text.strip()]

        def matched(batches):
            import pyarrow as pa

            known = _Block(rows, seed)
            for batch in batches:
                ids, out = batch.column("doc_id").to_pylist(), []
                for a, b in pieces(batch.column("text")):
                    found = known.matches(*utf8_buffers(batch.column("text").slice(a, b - a)), coverage)
                    out += [(ids[a + m[0]], *m[1:]) for m in found]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                columns = list(zip(*out)) if out else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)],
                    names=["doc_id", "item_id", "coverage", "tiles", "longest", "item_words"],
                )

        return base.mapInArrow(matched, MATCHES)

    parts = [against(block) for block in item_blocks(benchmark, block_bytes)]
    return reduce(DataFrame.union, parts) if parts else base.sparkSession.createDataFrame([], MATCHES)


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, *, seed: int = SEED, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
    text_col: str = "text",
) -> DataFrame:
    """The rows, with all their columns, that cover no item; judged where they lie, block after block of the benchmark."""

    def against(block: list):
        rows = [r for r in block if r.text.strip()]

        def kept(batches):
            import pyarrow as pa

            known = _Block(rows, seed)
            for batch in batches:
                column = batch.column(batch.schema.names.index(text_col)).fill_null("")
                clean = np.ones(batch.num_rows, bool)
                for a, b in pieces(column):
                    for match in known.matches(*utf8_buffers(column.slice(a, b - a)), coverage):
                        clean[a + match[0]] = False
                yield batch.filter(pa.array(clean))

        return kept

    for block in item_blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(against(block), docs.schema)
    return docs
