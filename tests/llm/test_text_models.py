"""Token counts, language, personal data, quality and secrets: against libraries and brute force, held-out accuracy, edge cases."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitalrates.llm import language_id, personal_data, quality, queries, secrets, token_counts

ODD = [
    (1, None), (2, ""), (3, "  \n\n\t  x"), (4, "Grüße 🙂🙂 naïve 日本語 don't I'LL we've"), (5, "a" * 70_000), (6, ("ab cd  \n" * 30_000)),
    (7, "hello <|endoftext|> world<|endoftext|>"), (8, "12345 67.89 +49 (0)30 1234567 a@b.co"), (8, "12345 67.89 +49 (0)30 1234567 a@b.co"),
    (None, "no id here"), (9, " wide space \r\n end"), (10, " " * 5000 + "z" + " " * 5000),
]


@pytest.fixture(scope="module")
def odd(spark):
    made = spark.createDataFrame(ODD, "doc_id long, text string")
    return made.selectExpr("*", "'x' AS key", "1 AS chunk", "2.0 AS score", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source").repartition(3)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    return path, lambda text: len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk", [65_536, 50])
def test_token_counts_are_the_librarys(odd, tokenizer, chunk):
    path, count = tokenizer
    rows = [x for x in ODD if chunk > 1000 or len(x[1] or "") < 20_000]
    docs = odd if chunk > 1000 else odd.where("length(coalesce(text, '')) < 20000")
    found = token_counts.token_counts(docs, path, chunk_chars=chunk)
    expected = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 1024) for i, t in rows]
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, expected))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abthe ing\n\t.'sé日1 <|endoftext|>", max_size=60))
def test_transducer_counts_any_text(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    if not hasattr(test_transducer_counts_any_text, "library"):
        test_transducer_counts_any_text.library = Tokenizer.from_file(path)
    library = test_transducer_counts_any_text.library
    assert token_counts.transducer(path).count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_registered_token_counts(spark, sf_dir, tokenizer):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, sf_dir, "documents").collect()}
    found = {r.doc_id: r.n_tokens for r in queries.op4_token_counts(spark, sf_dir).collect()}
    assert found == {i: tokenizer[1](t) for i, t in texts.items()}


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        doubled = "".join(str(int(d) * 2) if i % 2 else d for i, d in enumerate(reversed(digits)))
        nines = sum(2 * int(d) - 9 * (int(d) > 4) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
        if doubled and 13 <= len(digits) <= 19 and nines % 10 == 0:
            out.append(("card", *m.span()))
    return out + [
        ("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15
    ]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@+- ()%09", max_size=50))
def test_base_spans_are_the_patterns(text):
    assert personal_data.base_spans(text) == plain_spans(text)


def test_base_spans_of_known_numbers():
    text = "card 4111 1111 1111 1111, 4111-1111-1111-1112; ip 10.0.0.256 10.0.0.25; +49 (30) 123-456.78 🙂 x.y%z@a-b.example.org."
    assert personal_data.base_spans(text) == plain_spans(text)
    assert [k for k, _, _ in plain_spans(text)] == ["email", "ip", "card", "phone"]
    assert personal_data.base_spans("9" * 300_000 + "@") == []


def test_registered_personal_data(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, sf_dir, "documents").collect()}
    rows = queries.op6_personal_data(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in personal_data.KINDS)


def test_disclosing_terms_are_removed(spark):
    rows = [(i, f"the surgeon Quillfeather writes from q{i % 2}@x.org today") for i in range(4)]
    rows += [(i, f"the clerk writes from other{i}@x.org today") for i in range(10, 30)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS term", "2 AS row", "3 AS base")
    found = personal_data.personal_data(docs, generalise_at=0.5, remove_at=0.7)
    clean = {r.doc_id: r.text for r in personal_data.sanitised(docs, found).collect()}
    assert "Quillfeather" not in clean[0] and "[EMAIL]" in clean[0] and "the" in clean[0]
    assert clean[10] == "the clerk writes from [EMAIL] today" and clean[90] == "" == clean[91]
    assert personal_data.personal_data(docs.limit(0)).count() == 0


def plain_terms(texts, window, min_support, generalise_at, remove_at):
    """The term spans of every text by plain counting."""
    free, holders, holding, both = [], Counter(), Counter(), Counter()
    for text in texts:
        base = plain_spans(text)
        words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{2,}", text)]
        holding.update({w for _, _, w in words})
        words = [x for x in words if all(x[1] <= a or x[0] >= b for _, a, b in base)]
        free.append(words)
        pairs = set()
        for k, a, b in base:
            near = [w for w in words if w[1] <= a][-window:] + [w for w in words if w[0] >= b][:window]
            pairs |= {(personal_data.entity(k, text[a:b]), w) for _, _, w in near}
        both.update(pairs)
        holders.update({personal_data.entity(k, text[a:b]) for k, a, b in base})
    n, best = len(texts), {}
    for (e, w), k in both.items():
        if k >= min_support and holders[e] < n:
            share = math.log(n * k / (holders[e] * holding[w])) / math.log(n / holders[e])
            best[w] = max(share, best.get(w, -9.0))
    kind = {w: "remove" if d >= remove_at else "generalise" for w, d in best.items() if d >= generalise_at}
    return [sorted((kind[w], a, b) for a, b, w in words if w in kind) for words in free]


def test_terms_equal_plain_counting(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = docs.collect()
    for limits in ((2, 0.6, 0.85), (1, 0.4, 0.7)):
        found = personal_data.personal_data(docs, min_support=limits[0], generalise_at=limits[1], remove_at=limits[2])
        own = {r.doc_id: [tuple(x) for x in r.terms] for r in found.collect()}
        plain = dict(zip([r.doc_id for r in rows], plain_terms([r.text or "" for r in rows], personal_data.WINDOW, *limits)))
        assert own == plain
    assert any(plain.values())


def test_terms_are_marked_in_every_text(spark):
    rows = [(i, f"the surgeon Quillfeather writes from q{i % 2}@x.org today") for i in range(4)]
    rows += [(i, f"the clerk writes from other{i}@x.org today") for i in range(10, 60)]
    rows += [(70, "a letter to Quillfeather and no address"), (71, "quillfeathers are many")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = personal_data.personal_data(docs, generalise_at=0.5, remove_at=0.7)
    clean = {r.doc_id: r.text for r in personal_data.sanitised(docs, found).collect()}
    assert clean[70] == "a letter to  and no address" and clean[71] == "quillfeathers are many"


def test_neighbours_are_words_however_far():
    spans = [("email", 500, 505)]
    text = "y" * 60 + " " + "1" * 400
    text = text.ljust(499) + " a@b.c " + "1" * 400 + " " + "z" * 60
    assert personal_data.base_spans(text) == [("email", 500, 505)]
    assert {t for _, t in personal_data.neighbours(text, spans, 1)} == {"y" * 60, "z" * 60}


def test_language_is_learned(spark):
    found = queries.op5_language_id(spark, "/root/testdata/sf0.01")
    truth = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang", F.rlike(F.coalesce("text", F.lit("")), F.lit("\\p{L}")).alias("some"))
    rows = found.join(truth, "doc_id").where("held_out AND lang IS NOT NULL AND some").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark, odd):
    nothing = language_id.predict_languages(odd, language_id.fit_language(odd)).collect()
    assert len(nothing) == len(ODD) and {r.lang_pred for r in nothing} == {"und"}
    train = spark.createDataFrame(
        [(i, "the cat and the dog are here" if i % 2 else "der Hund und die Katze sind da", "en" if i % 2 else "de") for i in range(60)],
        "doc_id long, text string, lang string",
    )
    model = language_id.fit_language(train)
    assert {(r.doc_id % 2, r.lang_pred) for r in language_id.predict_languages(train, model).collect()} == {(1, "en"), (0, "de")}
    found = {r.doc_id: r.lang_pred for r in language_id.predict_languages(odd, model).collect()}
    assert found[1] == found[2] == "und" and found[5] in ("en", "de")
    assert language_id.predict_languages(train.limit(0), model).count() == 0


def test_quality_is_learned(spark):
    sf = "/root/testdata/sf0.01"
    labels = queries.table(spark, sf, "labels").select("doc_id", "quality")
    rows = queries.op7_quality(spark, sf).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    score, label = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    ahead = (score[label == 1][:, None] > score[label == 0]).mean()
    assert ahead > 0.9 and ((score >= 0.3) == label).mean() > 0.85


def test_forward_backward_matches_enumeration():
    import itertools

    random_ = np.random.default_rng(2)
    score, moves = random_.normal(size=(1, 6)), random_.normal(size=(2, 2))
    total, chance, pairs = 0.0, np.zeros(6), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=6):
        w = np.exp(sum(score[0, t] * y[t] for t in range(6)) + sum(moves[y[t], y[t + 1]] for t in range(5)))
        total += w
        chance += w * np.array(y)
        for t in range(5):
            pairs[y[t], y[t + 1]] += w
    p, q = quality.forward_backward(score, np.ones((1, 6), bool), moves)
    assert np.allclose(p[0], chance / total) and np.allclose(q, pairs / total)


def test_quality_of_odd_texts(spark, odd):
    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id long, quality int")
    model = quality.fit_quality(odd, labels)
    rows = quality.quality_scores(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == 1 for r in rows)
    kept = quality.good_documents(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    empty = odd.limit(0)
    assert quality.quality_scores(empty, quality.fit_quality(empty, labels)).count() == 0


def test_features_of_values_equal_plain_ones(spark):
    random_ = np.random.default_rng(8)
    signs = np.array(list("abcdeXYZ0123+/_=-"))
    values = ["".join(random_.choice(signs, n)) for n in (16, 40, 200_000)] + ["z"]
    words = [("abc", 30), ("de", 25), ("c", 99), ("e0a", 3), ("y" * 50, 2)]
    table = spark.createDataFrame(words, "word string, n long")
    found = {r.value: r for r in secrets.value_features(spark.createDataFrame([(v,) for v in values], "value string"), table).collect()}
    counts, firsts = Counter(), Counter()
    for w, n in words:
        w = re.sub("[0-9]", "0", w)
        for a, b in zip(w, w[1:]):
            counts[a + b] += n
            firsts[a] += n
    for v in values:
        plain = re.sub("[+/_=-]", "-", re.sub("[0-9]", "0", v.lower()))
        pairs = [a + b for a, b in zip(plain, plain[1:])]
        chances = [math.log((counts[p] + 1) / (firsts[p[0]] + 28)) if p in counts else -8.0 for p in pairs]
        assert found[v].transition == pytest.approx(np.mean(chances) if pairs else -8.0)
        covered = sum(len(w) for w in re.findall("[a-z]{2,}", v.lower()) if w in ("abc", "de"))
        assert found[v].covered == pytest.approx(covered / len(v))
        assert found[v].size == len(v) and found[v].digits == pytest.approx(sum(c.isdigit() for c in v) / len(v))


def test_secrets_are_told_from_names(spark):
    random_ = np.random.default_rng(5)
    signs = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    rows = []
    for i in range(60):
        key = "".join(random_.choice(signs, 32))
        rows.append((i, f"config api_key = {key} for the internationalization_settings_page of users", "src/app.py"))
    rows += [(100, None, None), (101, "", "x"), (102, "short words only", None), (103, "Z" * 100_000, "y"), (0, rows[0][1], "src/app.py")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS value", "2 AS left", "3 AS number", "4 AS word")
    found = secrets.scan_secrets(docs).collect()
    assert sum(r.doc_id == 0 for r in found) == 4
    assert {r.is_secret for r in found if r.doc_id < 60 and r.number == 0} == {True}
    assert {r.is_secret for r in found if r.doc_id < 60 and r.number == 1} == {False}
    assert secrets.scan_secrets(docs.limit(0)).count() == 0
    assert {r.score for r in secrets.scan_secrets(docs.where("doc_id >= 102")).collect()} == {0.0}
    labelled = spark.createDataFrame(
        [("A1b2C3d4E5f6G7h8" * 2, "x = ", "", "p", 1), ("plainword_plainword", "of ", " in", "p", 0)],
        "value string, left string, right string, path string, label int",
    )
    assert secrets.scan_secrets(docs, labelled).count() == len(found)
