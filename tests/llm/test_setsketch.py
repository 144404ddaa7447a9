"""SetSketch near duplicates against brute force, its registers against their theory, and edge cases."""

import itertools
import random
import re

import numpy as np
import pytest

from vitalrates.llm import queries, setsketch
from vitalrates.llm.common import connected, mix

WORDS = [f"w{i}" for i in range(400)]


def shingles(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def expected(rows):
    sets, members = {}, {}
    for i, t in rows:
        sets[frozenset(shingles(t))] = None
        members.setdefault(frozenset(shingles(t)), []).append(i)
    nodes = list(sets)
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = {}
    for x, s in enumerate(nodes):
        for g in s:
            by_shingle.setdefault(g, []).append(x)
    pairs = {p for own in by_shingle.values() for p in itertools.combinations(own, 2)}
    for x, y in pairs:
        a, b = nodes[x], nodes[y]
        if 100 * len(a & b) >= 80 * len(a | b):
            parent[find(x)] = find(y)
    least = {}
    for x, s in enumerate(nodes):
        least[find(x)] = min(least.get(find(x), 10**18), *members[s])
    at = {s: least[find(x)] for x, s in enumerate(nodes)}
    out = []
    for i, t in rows:
        s = frozenset(shingles(t))
        root = at[s] if s else i
        out.append((i, len(s), root, i == root))
    return sorted(out)


def families(seed=3, n=400, start=0):
    """Texts that drift away from others word by word, so that chains and half-similar families arise."""
    rng = random.Random(seed)
    rows = []
    for i in range(start, start + n):
        if rows and rng.random() < 0.85:
            words = rng.choice(rows[-60:])[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
        else:
            words = [rng.choice(WORDS) for _ in range(rng.choice([2, 4, 30, 80, 150]))]
        rows.append((i, " ".join(words)))
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame(
        [(i, t, "x", 1, 2, "b") for i, t in rows], "doc_id long, text string, node string, n int, key int, bands string"
    ).repartition(parts)


def sets_of(n, common, seed):
    values = mix(np.arange(seed * 1_000_000, seed * 1_000_000 + 2 * n - common, dtype=np.uint64))
    return np.sort(values[:n]), np.sort(values[n - common :])


def test_registers_are_local_and_mergeable():
    shares, errors = [], []
    for seed in range(1, 60):
        a, b = sets_of(900, 800, seed)  # 800 / 1000
        x, y, both = setsketch.sketches([a, b, np.union1d(a, b)])
        np.testing.assert_array_equal(setsketch.merged(x, y), both)
        plus, minus = np.array([(x > y).sum()]), np.array([(x < y).sum()])
        keep, estimate = setsketch.possible(plus, minus, np.array([900]), np.array([900]))
        assert keep.all()
        shares.append((x == y).mean())
        errors.append(estimate[0] - 0.8)
    assert np.mean(shares) == pytest.approx(0.8, abs=0.02)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    a, b = sets_of(900, 400, 77)  # 0.29: the likelihood refuses it
    x, y = setsketch.sketches([a, b])
    keep, _ = setsketch.possible(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([900]), np.array([900]))
    assert not keep.any()


@pytest.mark.parametrize("tile", [1_000, 7])
@pytest.mark.parametrize("seed", [3, 4])
def test_families_match_brute_force(spark, seed, tile):
    rows = families(seed)
    rows += [(rows[7][0], rows[7][1]), (1000, None), (1001, ""), (1002, " \n\t "), (1003, "long " * 50_000 + "end"),
             (1004, "Grüße an 🙂 alle"), (1005, "grüße AN 🙂 alle"), (1006, "one")]
    found = setsketch.near_duplicates(frame(spark, rows), tile=tile)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, found.collect())) == expected(rows)


def test_registered_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_near_dedup(spark, sf_dir).collect())) == expected(rows)


@pytest.mark.parametrize("tile", [1_000, 40])
def test_buckets_of_several_components_are_compared(spark, tile):
    """One bucket of everything and no link known yet: the tiles alone find all components, with few rows."""
    rows = families(11, 300)
    own = setsketch.sketched_documents(frame(spark, rows))
    classes = setsketch.classes_of(own)
    nodes = [r.node for r in classes.select("node").collect()]
    buckets = spark.createDataFrame([(0, 0, v) for v in nodes], "band int, bucket long, node long")
    roots = spark.createDataFrame([(v, v) for v in nodes], "node long, root long")
    near = setsketch.likely_edges(buckets, classes, roots, 80, tile)
    links = setsketch.exact_edges(near, frame(spark, rows), classes, roots, 4, 80, tile)
    first = {r.node: r.first for r in classes.select("node", "first").collect()}
    assert links.count() <= len(nodes) * (1 if tile == 1_000 else 12)
    found = {r.node: r.root for r in setsketch.components(links).collect()}
    groups = {}
    for v in nodes:
        groups.setdefault(found.get(v, v), []).append(first[v])
    got = {i: min(own) for own in groups.values() for i in own}
    want = {i: root for i, _, root, _ in expected(rows)}
    assert got == {i: want[i] for i in got} and len(set(got.values())) < len(got) - 50


def test_overlaps_and_spanning_edges():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(30)]
    got = setsketch.overlaps(sets[:12], sets[12:], columns=7)
    assert got.tolist() == [[len(set(x) & set(y)) for y in sets[12:]] for x in sets[:12]]
    a, b = rng.integers(0, 200, 400), rng.integers(0, 200, 400)
    chosen, label = setsketch.spanning(a, b, np.arange(200))
    nodes, roots = connected(a, b)
    assert len(chosen) == len(nodes) - len(set(roots)) and label[nodes].tolist() == roots.tolist()
    assert dict(zip(*connected(a[chosen], b[chosen]))) == {n: r for n, r in zip(nodes, roots) if n in {*a[chosen], *b[chosen]}}


def test_edges(spark):
    assert setsketch.near_duplicates(frame(spark, []).limit(0)).count() == 0
    rows = [(None, "a b c d e"), (3, "a b c d e"), (None, "x y"), (None, None), (5, "q"), (5, "r")]
    got = sorted(map(tuple, setsketch.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 2, 3, False), (3, 2, 3, True), (None, 1, None, True), (None, 0, None, True),
                          (5, 1, 5, True), (5, 1, 5, True)], key=repr)


def test_equal_first_keys_are_told_apart(spark, monkeypatch):
    own = spark.createDataFrame(
        [(1, 2, 9, 10, [0] * 24), (2, 2, 9, 11, [1] * 24), (3, 2, 8, 10, [2] * 24)],
        "doc_id long, n_shingles long, key long, second long, bands array<long>")
    nodes = {(r.key, r.second): r.node for r in setsketch.classes_of(own).collect()}
    assert len(set(nodes.values())) == 3 and nodes[8, 10] == 8
