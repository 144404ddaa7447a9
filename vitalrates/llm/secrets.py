"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are runs of 16 or more letters, digits and + / _ = - signs. The forest sees a candidate's length and make-up, how
likely its character transitions are in the corpus, how much of it the corpus's frequent words cover, its path, and the
words around it. It is trained from labelled findings: a table of candidates with a label, or, where none is given, the
candidates that a rule can tell (`rule_labels`). The training sample is bounded by TRAIN_ROWS per label, taken by hash; the
words, the transitions and the scan cover all texts. Everything is DataFrame functions and Spark's forest in the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalrates.session import cut_lineage

CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
TRAIN_ROWS = 10_000
FREQUENT = 20
LEFT, RIGHT = 48, 32
BINS = 16
TREES, DEPTH = 40, 6
# What assigns a secret, and paths of sample material.
ASSIGNS = r"(?i)(token|secret|api_?key|access_?key|passwd|password)[\"' ]*[:=][\"' ]*$"
SAMPLES = r"(?i)(test|example|sample|mock|docs?)([^a-z]|$)"
CLASSES = ("abcdefghijklmnopqrstuvwxyz0123456789+/_=-", "abcdefghijklmnopqrstuvwxyz0000000000-----")
SIGNS = "abcdefghijklmnopqrstuvwxyz0-"  # what CLASSES leaves
UNSEEN = -8.0
OWN = ("size", "digits", "upper", "variety", "transition", "covered", "path_size", "path_depth", "path_sample")


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, number (from 0 in the text), value, left, right, path of every candidate. NULL texts have none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(path_col), F.lit("")).alias("path")
    ).where(F.col("text").rlike(CANDIDATE))
    found = base.select(
        "doc_id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("values"),
        F.split("text", CANDIDATE, -1).alias("between"),
    )
    # The pieces between candidates are their contexts: one pass over the text, however many candidates it has.
    each = F.transform("values", lambda v, i: F.struct(
        v.alias("value"), F.right(F.get("between", i), F.lit(LEFT)).alias("left"),
        F.left(F.get("between", i + 1), F.lit(RIGHT)).alias("right"),
    ))
    return found.select("doc_id", "path", F.posexplode(each).alias("number", "x")).select("doc_id", "path", "number", "x.*")


def corpus_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word and its number of occurrences, for all lower-case runs of letters and digits in all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def _pairs(column: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(column), *CLASSES), F.lit("(?=(.{2}))"), F.lit(1))


def transitions(words: DataFrame) -> DataFrame:
    """pair and the log chance of its second character after its first: at most 28 x 28 rows by construction."""
    pairs = words.select("n", F.explode(_pairs(F.col("word"))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    firsts = counts.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("total"))
    joined = counts.join(firsts, F.substring("pair", 1, 1) == F.col("first"))
    return joined.select("pair", F.log((F.col("n") + 1) / (F.col("total") + 28)).alias("chance"))


def _transition(value: Column, table: list[float]) -> Column:
    """Mean log chance of a value's character pairs, summed inside the row; -8 without pairs."""
    def place(c: Column) -> Column:
        return F.position(c, F.lit(SIGNS)) - 1

    chances = F.lit(table)
    total = F.aggregate(_pairs(value), F.lit(0.0), lambda s, p: s + F.coalesce(
        F.get(chances, place(F.left(p, F.lit(1))) * len(SIGNS) + place(F.right(p, F.lit(1)))), F.lit(UNSEEN)
    ))
    return F.when(F.length(value) > 1, total / (F.length(value) - 1)).otherwise(F.lit(UNSEEN))


def value_features(values: DataFrame, words: DataFrame) -> DataFrame:
    """value, size, digits, upper, variety, transition, covered of distinct values.

    Only a number of the value goes along with its words, so a candidate of any length costs in proportion to it.
    """
    size = F.length("value")

    def share(kind: str) -> Column:
        return F.regexp_count("value", F.lit(kind)) / size

    known = {r["pair"]: r["chance"] for r in transitions(words).collect()}  # at most 784 rows
    table = [float(known.get(a + b, UNSEEN)) for a in SIGNS for b in SIGNS]
    numbered = cut_lineage(values.withColumn("at", F.monotonically_increasing_id()))
    frequent = words.where((F.col("n") >= FREQUENT) & (F.length("word") >= 2)).select("word")
    parts = numbered.select("at", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word"))
    covered = parts.join(frequent, "word").groupBy("at").agg(F.sum(F.length("word")).alias("letters"))
    own = numbered.select(
        "at", "value", size.cast("double").alias("size"), share("[0-9]").alias("digits"), share("[A-Z]").alias("upper"),
        (F.size(F.array_distinct(F.split("value", ""))) / F.least(size, F.lit(64))).alias("variety"),
        _transition(F.col("value"), table).alias("transition"),
    )
    return own.join(covered, "at", "left").select(
        *[c for c in own.columns if c != "at"], (F.coalesce("letters", F.lit(0)) / F.col("size")).alias("covered")
    )


def with_context(found: DataFrame) -> DataFrame:
    """Add what the path and the neighbouring words say: counts of hashed words in BINS bins on the left and on the right."""
    out = found.select(
        "*", F.length("path").cast("double").alias("path_size"), F.regexp_count("path", F.lit("/")).cast("double").alias("path_depth"),
        F.col("path").rlike(SAMPLES).cast("double").alias("path_sample"),
    )

    def bins(side: str, words: Column) -> list[Column]:
        places = F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(BINS)))
        return [F.size(F.filter(places, _equals(b))).cast("double").alias(f"{side}_{b}") for b in range(BINS)]

    def near(column: str) -> Column:
        return F.filter(F.split(F.lower(F.col(column)), "[^\\p{L}]+"), lambda w: w != "")

    left, right = F.slice(F.reverse(near("left")), 1, 3), F.slice(near("right"), 1, 3)
    return out.select("*", *bins("left", left), *bins("right", right))


def _equals(b: int):
    return lambda x: x == b


def rule_labels() -> Column:
    """1: assigned to a name for secrets; 0: not assigned at all and only letters or only digits; else NULL."""
    plain = F.col("value").rlike("^([A-Za-z_-]+|[0-9]+)$") & ~F.col("left").rlike("[:=][\"' ]*$")
    return F.when(F.col("left").rlike(ASSIGNS), 1.0).when(plain, 0.0)


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, *, threshold: float = 0.5, **columns) -> DataFrame:
    """One row per candidate: doc_id, number, value, score, is_secret.

    `labelled` has value, left, right, path and label (0 or 1); without it the rule's labels are used. With no finding
    of either label there is nothing to train on and every score is 0. Repeated rows each give their candidates; extra
    columns are ignored.
    """
    words = cut_lineage(corpus_words(docs, columns.get("text_col", "text")))
    found = cut_lineage(candidates(docs, **columns))
    values = found.select("value").union(labelled.select("value")) if labelled is not None else found.select("value")
    own = cut_lineage(value_features(values.distinct(), words))
    known = labelled if labelled is not None else found.withColumn("label", rule_labels())
    known = known.where("label IS NOT NULL").select("value", "left", "right", "path", F.col("label").cast("double").alias("label"))
    order = [F.xxhash64("value", "left", "right"), F.col("value"), F.col("left")]
    parts = [known.where(F.col("label") == y).orderBy(*order).limit(TRAIN_ROWS) for y in (0.0, 1.0)]
    inputs = [*OWN, *[f"{side}_{b}" for side in ("left", "right") for b in range(BINS)]]
    vector = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    train = cut_lineage(with_context(parts[0].union(parts[1])).join(own, "value").select("label", *inputs))
    out = with_context(found).join(own, "value")
    if train.select("label").distinct().count() < 2:
        scored = out.withColumn("score", F.lit(0.0))
    else:
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, labelCol="label", featuresCol="features")
        model = forest.fit(vector.transform(train))
        scored = model.transform(vector.transform(out)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "number", "value", "score", (F.col("score") >= threshold).alias("is_secret"))
