"""Mixing against SQL, and the pipeline's stages on odd tables and against plain versions."""

import hashlib
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vitalrates.llm import mixing, queries


def same_rows(own, other):
    names = sorted(own.columns)
    assert names == sorted(other.columns)
    own, other = (x[names].sort_values(names).reset_index(drop=True) for x in (own, other))
    pd.testing.assert_frame_equal(own, other, check_dtype=False)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, f"w{i} " * (1 + i % 37), ["en", "de", None][i % 3], [f"src{i % 7}", None, "plain"][i % 5 % 3], 0) for i in range(400)]
    rows += [(900, None, "en", "src1", 1), (901, "", "en", "src1", 1), (902, "  \n", None, None, None), (903, "big " * 40_000, "fr", "src12", 5)]
    rows += [rows[3], (None, "no id", "en", "src0", 2)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return made.selectExpr("*", "'x' AS domain", "1 AS budget", "2 AS tokens", "3 AS kept", "4 AS class").repartition(4)


def test_mixture_matches_sql(odd, spark):
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    own = mixing.mixture(docs, weights=queries.WEIGHTS, max_epochs=queries.MAX_EPOCHS, seed=queries.SEED).toPandas()
    documents = docs.select("doc_id", "text", "lang", "source").toPandas()
    with duckdb.connect() as db:
        db.register("documents", documents.where(documents.notna(), None))
        same_rows(own, db.execute(queries.MIXING_SQL).df())


def test_registered_mixture_matches_sql(spark, sf_dir):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
        same_rows(queries.op1_mixing(spark, sf_dir).toPandas(), db.execute(queries.MIXING_SQL).df())


def test_shortages_go_to_siblings_first(spark):
    rows = [(1, "a " * 10, "en", "src0"), (2, "a " * 1000, "de", "src0"), (3, "a " * 1000, "en", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = mixing.mixture(docs, weights={"web/en": 100.0, "web/de": 1.0}, share=0.5, max_epochs=1, seed=1)
    taken = {r.doc_id: r.taken for r in found.collect()}
    assert taken[1] == 10  # all there is; its sibling takes the shortage before another domain does
    assert abs(taken[2] - 492) <= 1 and abs(taken[3] - 502) <= 1


def test_mixture_of_odd_rows(odd):
    found = mixing.mixture(odd, weights=queries.WEIGHTS)
    rows = found.collect()
    assert {900, 901, 902}.isdisjoint(r.doc_id for r in rows) and all(r.taken > 0 for r in rows)
    assert mixing.mixture(odd.limit(0), weights={}).count() == 0
    total = mixing.epochs(found).agg(F.sum("tokens")).first()[0]
    assert total == sum(r.taken for r in rows)


def test_mixture_attaches_leaves_without_moving_rows(odd, monkeypatch):
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    found = mixing.mixture(docs, weights=queries.WEIGHTS, max_epochs=queries.MAX_EPOCHS, seed=queries.SEED)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(mixing, "fits", lambda table: False)
    sliced = mixing.mixture(docs, weights=queries.WEIGHTS, max_epochs=queries.MAX_EPOCHS, seed=queries.SEED)
    same_rows(sliced.toPandas(), found.toPandas())


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "w7 " * 9), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_and_empty_tables(spark, odd, folder, stage):
    name, function = corpus_pipeline.STAGES[stage]
    for docs in (odd, odd.limit(0)):
        out = function(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns or stage == 4
        assert out.count() <= docs.count()


def test_exact_dedup_tells_rows_of_one_id_by_their_text(spark):
    rows = [(7, "a", 1), (7, "b", 2), (9, "a", 3), (8, None, 4), (8, "", 5), (5, None, 6), (9, "a", 7), (None, "c", 8), (None, "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_sha256 int")
    kept = corpus_pipeline.without_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(7, "b"), (8, ""), (9, "a")]


def test_pipeline_runs_over_odd_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_stages_match_plain_versions(spark, sf_dir):
    """Each stage on what its predecessor kept, against a plain version of the stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    kept = corpus_pipeline.without_copies(spark, docs, sf_dir)
    best = {}
    for r in docs.collect():
        key = hashlib.sha256((r.text or "").encode()).digest()
        best[key] = max(best.get(key, r.doc_id), r.doc_id)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(best.values())
    near = corpus_pipeline.without_near_copies(spark, kept, sf_dir)
    sets = {}
    for r in kept.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), r.text or ""))
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i in ids if root[i] == i)
    clean = corpus_pipeline.without_benchmark(spark, near, sf_dir)
    dirty = {r.doc_id for r in near.collect()} - {r.doc_id for r in clean.collect()}
    items = [re.findall(r"[^\x20\x09-\x0D]+", r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for r in near.collect():
        words = " ".join(re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower()))
        if any(f" {' '.join(w)} " in f" {words} " for w in items):
            assert r.doc_id in dirty
    assert len(dirty) < near.count() / 4
