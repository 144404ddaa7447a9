"""Periodic runs against brute force over all periods, the transforms against plain sums, and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from vitalrates.llm import periodic_runs as pr
from vitalrates.llm import queries


def brute(words):
    """Every maximal stretch of every period; of equal stretches the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - a >= max(6, 4 * q):
                best.setdefault((a, i + q), q)
    return sorted((a, e - a, q) for (a, e), q in best.items())


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def random_words(rng, n):
    """Pieces of random words, powers of random periods and powers of powers."""
    out = []
    while len(out) < n:
        kind = rng.random()
        piece = [rng.choice("abc") for _ in range(rng.randrange(1, 12))]
        if kind < 0.4:
            piece = piece * rng.randrange(2, 9)
        if kind < 0.15:
            piece = (piece + [rng.choice("abz")]) * rng.randrange(2, 6)
        out += piece + piece[: rng.randrange(0, 4)]
    return out[:n]


def test_transforms_are_exact():
    rng = np.random.default_rng(4)
    for size in (1, 2, 4, 16, 64):
        blocks = rng.integers(0, pr.PRIME, (5, size)).astype(np.uint64)
        windows = rng.integers(0, pr.PRIME, (5, 2 * size - 1)).astype(np.uint64)
        windows[1, size // 2 : size // 2 + size] = blocks[1]
        got = pr.mismatches(blocks, windows)
        for b, w, row in zip(blocks.tolist(), windows.tolist(), got.tolist()):
            assert row == [sum((x - y) ** 2 for x, y in zip(b, w[d : d + size])) % pr.PRIME for d in range(size)]
        assert got[1, size // 2] == 0
        np.testing.assert_array_equal(pr.backward(pr.forward(blocks)), blocks)


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    for n in [0, 1, 5, 6, 7, 8, 23, 64, 150, 700]:
        for _ in range(12):
            words = random_words(rng, n)
            codes = np.array([ord(w) for w in words], np.int64)
            assert [(s, e - s, q) for s, e, q in pr.periodic_runs(codes, n)] == brute(words), words


def test_hostile_words():
    for words in ("a" * 3000, "ab" * 1500, ("a" * 60 + "b") * 40, ("abcab" * 20 + "c") * 12, "abaababaabaab" * 50):
        codes = np.array([ord(w) for w in words], np.int64)
        assert [(s, e - s, q) for s, e, q in pr.periodic_runs(codes, len(codes))] == brute(words)
    n = 300_000
    assert pr.periodic_runs(np.zeros(n, np.int64), n) == [(0, n, 1)]


def test_values_that_only_the_prime_confuses(monkeypatch):
    monkeypatch.setattr(pr, "mix", lambda h: h % np.uint64(2))
    rng = random.Random(9)
    for _ in range(20):
        words = random_words(rng, 300)
        codes = np.array([ord(w) for w in words], np.int64)
        assert [(s, e - s, q) for s, e, q in pr.periodic_runs(codes, 300)] == brute(words)


def test_query_on_documents(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = queries.op12_periodic_runs(spark, sf_dir)
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = [(i, t) for i, t in zip(table["doc_id"], table["text"]) if t is None or len(t) < 12_000]
    rows = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(rows) == len(table["doc_id"]) and len(short) > 150
    assert any(rows[i][1] for i, _ in short)
    for i, t in short:
        assert rows[i] == expected(i, t)


def test_edges(spark):
    planted = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a a a a a a"), (5, "a a a a a"), (6, "x " * 50_000 + "end"),
            (7, "Ä ß Ä ß Ä ß Ä ß"), (7, "Ä ß Ä ß Ä ß Ä ß"), (None, "one two " * 4), (planted, "only"), (planted, None),
            (8, "b b b b b b c c c c c c"), (9, "A a A a a A a A")]
    frame = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, start int, runs string").repartition(2)
    got = sorted(map(tuple, pr.run_digest(frame).collect()), key=repr)
    assert got == sorted((expected(i, t) for i, t in rows), key=repr)
    assert pr.run_digest(frame.limit(0)).collect() == []
    collapsed = {r.doc_id: r for r in pr.collapse_runs(frame.where("doc_id in (4, 8)")).collect()}
    assert collapsed[4].collapsed == "a" and collapsed[8].collapsed == "b c" and len(collapsed[8].runs) == 2


def test_a_very_long_text(spark):
    words = [str(i % 977) for i in range(400_000)]
    frame = spark.createDataFrame([(3, " ".join(words))], "doc_id long, text string")
    (row,) = pr.run_digest(frame).collect()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 400_000, 977)
