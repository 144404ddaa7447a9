"""Exact dedup, n-gram join, fuzzy lines and decontamination against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

from vitalrates.llm import decontaminate, exact_dedup, fuzzy_lines, ngram_join, queries
from vitalrates.llm.common import components

WORDS = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "mu", "nu", "xi", "pi", "rho"]


def documents(seed=3, n=120):
    """Random texts with near and exact copies, NULLs, blanks, a long text and repeated rows."""
    random_ = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and random_.random() < 0.6:
            words = (random_.choice(rows)[1] or "").split(" ")
            for _ in range(random_.choice([0, 0, 1, 1, 2, 4])):
                words[random_.randrange(len(words))] = random_.choice(WORDS)
        else:
            words = [random_.choice(WORDS) for _ in range(random_.choice([1, 3, 5, 20, 40, 60]))]
        rows.append((i, " ".join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "long " * 60_000 + "end"), (n + 4, "Grüße an 🙂 alle Leser hier"), (7, rows[7][1])]
    return rows


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(i, t, "x", 1, 2, "y", 3) for i, t in documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, class string, root long, block int, line string, keep_id long").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def similar(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("block", [2_000, 3])
def test_similar_documents_match_brute_force(messy, block):
    found = ngram_join.similar_documents(messy, block=block)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect())) == similar(documents())


def test_registered_join_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op9_ngram_join(spark, sf_dir).collect())) == similar(rows)


def test_empty_tables_give_no_rows(spark, empty):
    assert ngram_join.similar_documents(empty).count() == 0
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert fuzzy_lines.deduplicated_lines(empty).count() == 0
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.benchmark_matches(empty, items).count() == 0
    assert decontaminate.clean_documents(empty, items).count() == 0
    nothing = items.limit(0)
    assert decontaminate.benchmark_matches(items.withColumnRenamed("item_id", "doc_id"), nothing).count() == 0


@pytest.mark.parametrize("bound", [1_000_000, 20])
def test_components_of_paths_stars_and_loops(spark, bound):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 180)] + [(500, 500)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(3), bound=bound).collect()))
    assert found == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 180)}, 500: 500}


@pytest.mark.parametrize("spill", [64_000_000, 300])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates_match_brute_force(messy, keep, spill):
    groups = {}
    for i, t in documents():
        groups.setdefault(t or "", []).append(i)
    choose = min if keep == "smallest" else max
    expected = sorted(
        (i, choose(groups[t or ""]), len(groups[t or ""]), i == choose(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in documents()
    )
    assert sorted(map(tuple, exact_dedup.exact_duplicates(messy, keep, spill_bytes=spill).collect())) == expected


def test_exact_duplicates_without_ids(spark):
    rows = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(rows).collect()}
    assert found == {(None, 3, 2, False), (3, 3, 2, True), (None, None, 1, True)}


def test_registered_dedup_matches_sql(spark, sf_dir):
    own = queries.op3_exact_dedup(spark, sf_dir).toPandas()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
        other = db.execute(queries.EXACT_SQL).df()
    names = sorted(own.columns)
    own, other = (x[names].sort_values(names).reset_index(drop=True) for x in (own, other))
    pd.testing.assert_frame_equal(own, other, check_dtype=False)


def test_tiles_catch_reordered_passages(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    moved = "seven eight nine ten eleven twelve and then one two three four five six"
    docs = spark.createDataFrame(
        [(1, moved), (2, item), (3, "one two three four then nothing"), (4, None), (5, ""), (1, moved), (6, "x " * 50_000 + item)],
        "doc_id long, text string",
    ).selectExpr("doc_id", "text", "'c' AS item_id", "1.0 AS coverage")
    items = spark.createDataFrame([(9, item), (10, None), (11, "nothing"), (12, " ")], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.coverage, r.tiles) for r in decontaminate.benchmark_matches(docs, items).collect())
    assert found == [(1, 9, 1.0, 2), (1, 9, 1.0, 2), (2, 9, 1.0, 1), (3, 11, 1.0, 1), (6, 9, 1.0, 1)]
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5]
    blocks = decontaminate.benchmark_matches(docs, items, block_bytes=10)
    assert sorted((r.doc_id, r.item_id) for r in blocks.collect()) == [(d, i) for d, i, _, _ in found]


def plain_tiles(a, b, least):
    """Greedy tiling by trying every pair of starts."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best, found = 0, []
        for i, j in itertools.product(range(len(a)), range(len(b))):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                n += 1
            if n > best:
                best, found = n, []
            if n == best and n:
                found.append((i, j))
        if best < least:
            return out
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = [False] * best
                free_b[j : j + best] = [False] * best
                out.append((i, j, best))


def test_tiles_match_brute_force():
    import numpy as np

    random_ = random.Random(8)
    for _ in range(60):
        a, b = ([random_.randrange(4) for _ in range(random_.randrange(40))] for _ in range(2))
        own = decontaminate.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert own == plain_tiles(a, b, 3)


def line_pairs(count, seed=8):
    random_ = random.Random(seed)
    x = ["".join(random_.choice("abc de") for _ in range(random_.randrange(1, 120))) for _ in range(count)]
    y = ["".join(random_.choice("abc dez") if random_.random() < 0.02 else c for c in line) + random_.choice(["", "tail", line]) for line in x]
    return [*x, "ab" * 80_000, "a", "\U0001f600\u00e4 short"], [*y, "ab" * 70_000, "b", "\U0001f600\u00e4 short"]


def alike(a, b, percent=75):
    a, b = ({t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in (a, b))
    return 100 * len(a & b) >= percent * len(a | b)


def test_similar_lines_are_those_of_their_shingles():
    x, y = line_pairs(1_300)
    expected = [alike(a, b) for a, b in zip(x, y)]
    assert fuzzy_lines._similar(x, y, 75).tolist() == expected and 200 < sum(expected) < 1_100
    assert fuzzy_lines._similar([], [], 75).tolist() == []


def test_small_tiles_are_compared_together(monkeypatch):
    """A bucket of few lines costs no hashing of its own; links are those that join components."""
    x, y = line_pairs(1_200, seed=9)
    rows, expected = [], set()
    for t, (a, b) in enumerate(zip(x, y)):
        two = t % 3 == 0  # the main component has one line, or two that are linked already
        rows += [(t, 0, 0, 0, 10 * t + 1, 10 * t + 1, a), (t, 0, 0, 1, 10 * t + 1, 10 * t + 1, a), (t, 0, 0, 1, 10 * t, 10 * t, b)]
        rows += [(t, 0, 0, 1, 10 * t + 2, 10 * t, b)] * two
        expected |= {10 * t} if alike(a, b) else set()
    names = ["bucket", "row", "column", "side", "node", "root", "line"]
    table = pa.table({n: list(c) for n, c in zip(names, zip(*rows))})
    made, batch = [], fuzzy_lines.LineBatch
    monkeypatch.setattr(fuzzy_lines, "LineBatch", lambda lines: made.append(1) or batch(lines))
    found = pa.Table.from_batches(list(fuzzy_lines._tile_links(75)(table.to_batches(700))))
    links = list(zip(found["a"].to_pylist(), found["b"].to_pylist()))
    assert len(links) == len(expected) and {b - b % 10 for _, b in links} == expected == {a - 1 for a, _ in links}
    assert len(made) < len(x) / 50


def test_fuzzy_lines_match_brute_force(spark):
    random_ = random.Random(4)
    base = ["".join(random_.choice("abcdefgh ijklmn") for _ in range(90)) for _ in range(12)]
    texts = []
    for i in range(40):
        lines = []
        for _ in range(4):
            line = random_.choice(base)
            at = random_.randrange(80)
            lines.append(line[:at] + "#" + line[at + 1 :] if random_.random() < 0.5 else line)
        texts.append("\n".join([*lines, "", "short"]))
    rows = [(i, t) for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, "   \n\t"), (93, "z" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS root", "2 AS number", "3 AS line_id").repartition(4)

    def grams(line):
        return {line[i : i + 8] for i in range(max(1, len(line) - 7))}

    every = sorted({line for _, t in rows for line in (t or "").split("\n") if line.strip()})
    sets, parent = [grams(x) for x in every], list(range(len(every)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(every)), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    seen, expected = set(), {}
    for i, t in rows:
        kept = []
        lines = [(n, line) for n, line in enumerate((t or "").split("\n")) if line.strip()]
        for n, line in lines:
            root = find(every.index(line))
            if root not in seen:
                seen.add(root)
                kept.append(n)
        expected[i] = (len(lines), len(kept), kept)
    found = fuzzy_lines.deduplicated_lines(docs)
    assert {r.doc_id: (r.n_lines, r.n_kept, r.kept_lines) for r in found.collect()} == expected
    assert {r.doc_id: r.text for r in fuzzy_lines.without_lines(docs, found).collect()}[0].count("short") == 1
