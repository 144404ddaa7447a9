"""Language identification by a string kernel.

The kernel of two texts counts the character n-grams of length 1 to 3 that both contain (presence, blended spectrum),
divided by the root of the product of the texts' own counts. Landmark texts of every language give each text a short
vector of kernel values, and the inverse root of the landmarks' own kernel matrix turns it into Nystroem coordinates.
One-versus-rest ridge regression on them needs only sums over all training texts; scoring is two matrix products per
batch. Characters are lower-cased and folded onto 64 symbols, so an n-gram is a number below 64^3.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalrates.llm.common import id_and_text

SYMBOLS = 64
TABLE = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
LANDMARKS, LANDMARK_CHARS = 16, (200, 20_000)
MAX_LANGUAGES = 300
RIDGE = 1e-3
ROWS_AT_ONCE = 64


def _symbols() -> np.ndarray:
    """Symbol of every code point: a space for all that is no letter, letters a-z their own, others by their low bits."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = 1 + c - 97 if 97 <= c <= 122 else 27 + c % 37
    return table


_table: list[np.ndarray] = []


def grams(text: str) -> np.ndarray:
    """Numbers of the n-grams at every place of the text, repeated as they occur; 1-, 2- and 3-grams have separate ranges."""
    if not _table:
        _table.append(_symbols())
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _table[0][codes].astype(np.int32)
    two = s[:-1] * SYMBOLS + s[1:]
    three = two[:-1] * SYMBOLS + s[2:]
    return np.concatenate((s, two + SYMBOLS, three + (SYMBOLS + SYMBOLS**2)))


class Landmarks:
    """The landmark texts' n-grams as columns of a presence matrix, and the map from n-grams to its rows."""

    def __init__(self, texts: list[str]):
        own = [np.unique(grams(t)) for t in texts]
        known = np.unique(np.concatenate(own))
        self.place = np.full(TABLE, len(known), np.int32)
        self.place[known] = np.arange(len(known), dtype=np.int32)
        self.columns = np.zeros((len(known), len(texts)), np.float32)
        for j, g in enumerate(own):
            self.columns[self.place[g], j] = 1
        self.sizes = np.sqrt(np.array([len(g) for g in own], np.float64))
        kernel = (self.columns.T @ self.columns).astype(np.float64) / np.outer(self.sizes, self.sizes)
        values, vectors = np.linalg.eigh(kernel)
        kept = values > 1e-8 * values.max()
        self.root = vectors[:, kept] / np.sqrt(values[kept])

    def coordinates(self, texts: list[str]) -> np.ndarray:
        """Nystroem coordinates, one row per text, from batched presence rows."""
        out = np.zeros((len(texts), self.root.shape[1]))
        for start in range(0, len(texts), ROWS_AT_ONCE):
            block = texts[start : start + ROWS_AT_ONCE]
            present = np.zeros((len(block), len(self.columns) + 1), np.float32)
            every = np.zeros(TABLE, bool)
            sizes = np.ones(len(block))
            for i, text in enumerate(block):
                g = grams(text)
                every[g] = True
                sizes[i] = max(1, np.count_nonzero(every))
                every[g] = False
                present[i, self.place[g]] = 1
            shared = present[:, :-1] @ self.columns
            out[start : start + len(block)] = (shared / np.outer(np.sqrt(sizes), self.sizes)) @ self.root
        return out


class LanguageModel:
    """Landmarks and ridge weights; its size is that of the landmarks, whatever was trained on. Without landmarks: `und`."""

    def __init__(self, landmarks: Landmarks | None, weights: np.ndarray | None, languages: list[str]):
        self.landmarks, self.weights, self.languages = landmarks, weights, languages

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score: the share of the best class among the classes' positive responses."""
        if self.landmarks is None:
            return ["und"] * len(texts), [0.0] * len(texts)
        response = self.landmarks.coordinates(texts) @ self.weights[:-1] + self.weights[-1]
        best = response.argmax(axis=1)
        positive = np.maximum(response, 0)
        score = positive.max(axis=1) / np.maximum(positive.sum(axis=1), 1e-9)
        return [self.languages[i] for i in best], score.tolist()


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string")) % 3 == 1


def fit_language(
    docs: DataFrame, *, landmarks: int = LANDMARKS, chars: tuple[int, int] = LANDMARK_CHARS, ridge: float = RIDGE, **columns
) -> LanguageModel:
    """Fit on every text with a language outside the fold crc32(doc_id) mod 3 = 1.

    Landmarks are, for each language, the `landmarks` texts with the smallest id hashes among those of `chars` characters
    (of any length where a language has none such); the regression sums over all training texts. Without any
    training text every prediction is `und`; above MAX_LANGUAGES languages it raises.
    """
    train = id_and_text(docs, "lang", **columns).where(F.col("lang").isNotNull() & ~held_out()).where(F.length("text") > 0)
    size = F.length("text")
    ranked = train.select("doc_id", "lang", (~size.between(*chars)).cast("int").alias("off"), F.xxhash64("text").alias("key"))
    order = Window.partitionBy("lang").orderBy("off", F.xxhash64("doc_id"), "doc_id", "key")
    picked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= landmarks)
    picked = picked.limit(landmarks * MAX_LANGUAGES + 1).collect()
    languages = sorted({r.lang for r in picked})
    if not picked:
        return LanguageModel(None, None, [])
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    keys = {(r.doc_id, r.key) for r in picked}
    rows = train.where(F.col("doc_id").isin([r.doc_id for r in picked])).select("doc_id", F.xxhash64("text").alias("key"), "text")
    texts = sorted({(r.doc_id, r.key): r.text for r in rows.collect() if (r.doc_id, r.key) in keys}.items())
    marks = Landmarks([t for _, t in texts])
    place = {lang: i for i, lang in enumerate(languages)}
    width = marks.root.shape[1] + 1

    def summed(batches):
        import pyarrow as pa

        total, target = np.zeros((width, width)), np.zeros((width, len(languages)))
        for batch in batches:
            x = np.column_stack((marks.coordinates(batch.column("text").to_pylist()), np.ones(batch.num_rows)))
            which = np.array([place[v] for v in batch.column("lang").to_pylist()], int)
            total += x.T @ x
            np.add.at(target.T, which, x)
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i in range(width)]), pa.array(np.column_stack((total, target)).tolist(), pa.list_(pa.float64()))],
            names=["at", "sums"],
        )

    sums = train.select("lang", "text").mapInArrow(summed, "at long, sums array<double>")
    sums = sums.select("at", F.posexplode("sums").alias("col", "value")).groupBy("at", "col").agg(F.sum("value").alias("value"))
    table = np.zeros((width, width + len(languages)))
    for r in sums.collect():  # width x (width + languages) numbers
        table[r["at"], r["col"]] = r["value"]
    total, target = table[:, :width], table[:, width:]
    n = max(total[-1, -1], 1)
    weights = np.linalg.solve(total / n + ridge * np.eye(width), target / n)
    return LanguageModel(marks, weights, languages)


def predict_languages(docs: DataFrame, model: LanguageModel, **columns) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score. NULL texts and texts without a letter are `und` with score 0."""

    def predicted(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = model.predict(texts) if texts else ([], [])
            some = [has_letter(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([v if s else "und" for v, s in zip(langs, some)], pa.string()),
                 pa.array([float(v) if s else 0.0 for v, s in zip(scores, some)], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    out = id_and_text(docs, **columns).mapInArrow(predicted, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
