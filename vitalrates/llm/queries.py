"""Registered queries of the text operators, each over its whole tables, and their results as SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.llm import (
    decontaminate, exact_dedup, fuzzy_lines, language_id, mixing, ngram_join, periodic_runs, personal_data, quality,
    secrets, setsketch, token_counts, whitening,
)

#: Target weights of the mixture: domains, then languages within a domain; sources weigh alike.
WEIGHTS = {
    "web": 4.0, "books": 3.0, "code": 2.0, "forum": 1.0,
    **{f"{d}/{lang}": w for d in ("web", "books", "code", "forum") for lang, w in (("en", 5.0), ("de", 2.0), ("fr", 2.0))},
}
MAX_EPOCHS, SEED = 4, 7


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents"), weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED)


def op2_secrets(spark, sf_dir):
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    size, digest = F.length("value").cast("long").alias("size"), F.sha2("value", 256).alias("value_sha256")
    return found.select("doc_id", "number", size, digest, "score", "is_secret")


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.predict_languages(docs, language_id.fit_language(docs))


def op6_personal_data(spark, sf_dir):
    return personal_data.digest(personal_data.personal_data(table(spark, sf_dir, "documents")))


def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op8_fuzzy_lines(spark, sf_dir):
    return fuzzy_lines.deduplicated_lines(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark, sf_dir):
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.run_digest(table(spark, sf_dir, "documents"))


def op13_near_dedup(spark, sf_dir):
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_secrets, op3_exact_dedup, op4_token_counts, op5_language_id, op6_personal_data, op7_quality,
    op8_fuzzy_lines, op9_ngram_join, op10_decontamination, op11_whitening,
    op12_periodic_runs, op13_near_dedup,
)}


def _weights_sql(path: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v:.1f}" for k, v in WEIGHTS.items())
    return f"CASE {path} {cases} ELSE 1.0 END::DOUBLE"


def _share_sql(source: str, parent: str, name: str) -> str:
    """The sharing of one level in SQL: `source` has given, capacity, weight and the columns of `parent` and `name`."""
    part = f"PARTITION BY {parent}" if parent else ""
    keys = f"{parent}, {name}" if parent else name
    return f"""
      SELECT {keys}, CASE WHEN level < ratio
                          THEN floor(weight * max(CASE WHEN level < ratio THEN level END) OVER ({part}))::BIGINT
                          ELSE capacity END AS budget
      FROM (SELECT *, capacity / weight AS ratio,
                   (given - coalesce(sum(capacity) OVER ({part} ORDER BY capacity / weight, {name}
                                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                   / sum(weight) OVER ({part} ORDER BY capacity / weight, {name}
                                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM ({source}) WHERE weight > 0 AND capacity > 0)"""


def _top_sql() -> str:
    return f"""SELECT domain, sum(capacity)::BIGINT AS capacity, {_weights_sql("domain")} AS weight,
                      (SELECT sum(n_tokens)::BIGINT FROM docs) AS given FROM leaf GROUP BY domain"""


def _middle_sql() -> str:
    path = _weights_sql("l.domain || '/' || l.lang")
    return f"""SELECT l.domain, l.lang, sum(l.capacity)::BIGINT AS capacity, {path} AS weight, max(t.budget) AS given
               FROM leaf l JOIN top t ON l.domain = t.domain GROUP BY l.domain, l.lang"""


MIXING_SQL = f"""
WITH named AS (
  SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, coalesce(text, '') AS text,
         regexp_extract(source, '([0-9]{{1,9}})$', 1) AS number
  FROM documents),
docs AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(text, '[^ \\x09-\\x0D]+'))::BIGINT AS n_tokens,
         CASE WHEN number IS NULL THEN 'none' WHEN number = '' THEN 'web'
              ELSE ['web', 'books', 'code', 'forum'][number::BIGINT % 4 + 1] END AS domain
  FROM named),
leaf AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, {MAX_EPOCHS} * sum(n_tokens)::BIGINT AS capacity
  FROM docs WHERE n_tokens > 0 GROUP BY domain, lang, source),
top AS ({_share_sql(_top_sql(), "", "domain")}),
middle AS ({_share_sql(_middle_sql(), "domain", "lang")}),
low AS ({_share_sql('''SELECT l.domain, l.lang, l.source, l.capacity, 1.0::DOUBLE AS weight, m.budget AS given
                       FROM leaf l JOIN middle m ON l.domain = m.domain AND l.lang = m.lang''', "domain, lang", "source")}),
budgets AS (
  SELECT w.domain, w.lang, w.source, w.budget // l.tokens AS epochs, w.budget % l.tokens AS rest
  FROM low w JOIN leaf l ON w.domain = l.domain AND w.lang = l.lang AND w.source = l.source WHERE w.budget > 0),
ordered AS (
  SELECT d.*, b.epochs, b.rest,
         sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source
                             ORDER BY md5('{SEED}:' || b.epochs || ':' || d.doc_id)[:15], d.doc_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - n_tokens AS before
  FROM docs d JOIN budgets b ON d.domain = b.domain AND d.lang = b.lang AND d.source = b.source WHERE n_tokens > 0),
parts AS (SELECT *, greatest(0, least(n_tokens, rest - before))::BIGINT AS part FROM ordered)
SELECT doc_id, domain, lang, source, n_tokens, epochs, part, epochs * n_tokens + part AS taken
FROM parts WHERE epochs * n_tokens + part > 0
"""

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

SQL = {"op1_mixing": MIXING_SQL, "op3_exact_dedup": EXACT_SQL}
