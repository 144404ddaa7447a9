"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own surface measures and those of the lines before and after it;
neighbouring labels are tied by a transition matrix. Forward-backward gives each line's chance of being good, and the
chances weighted by line length make the document's quality, mapped to a probability by a logistic curve. Labels exist
for documents only, so training gives every line its document's label. The fit takes a bounded sample of labelled
documents, at most MAX_DOCS of at most MAX_LINES lines each (the smallest hashes of the id); scoring reads whole texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.llm.common import id_and_text, pieces, utf8_buffers, words_of

MAX_DOCS, MAX_LINES = 6_000, 128
ROUNDS, RATE, RIDGE = 250, 0.08, 1e-3
OWN = 15
WIDTH = 3 * OWN + 1

_CLASS = np.full(256, 5, np.uint8)  # 0 upper, 1 lower, 2 digit, 3 space, 4 punctuation, 5 other bytes
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13]] = 3
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, byte lengths and rows of all lines of the texts, in order; an empty text has one empty line."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    rows_of_breaks = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate((offsets[:-1], breaks + 1))
    rows = np.concatenate((np.arange(len(offsets) - 1), rows_of_breaks))
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    changes = np.flatnonzero(rows[1:] != rows[:-1])
    ends[changes] = offsets[rows[changes] + 1]
    if len(ends):
        ends[-1] = n
    length = (ends - starts).astype(np.float64)
    size = np.maximum(length, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[ends] - total[starts]) / size

    kinds = _CLASS[data]
    hashes, at, _, _ = words_of(data, offsets)
    line = np.searchsorted(starts, at, side="right") - 1
    words = np.bincount(line, minlength=len(starts)).astype(np.float64)
    some = np.maximum(words, 1)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    by = np.lexsort((hashes, line))
    distinct = np.ones(len(hashes), bool)
    distinct[1:] = (hashes[by][1:] != hashes[by][:-1]) | (line[by][1:] != line[by][:-1])
    different = np.bincount(line[by][distinct], minlength=len(starts))
    first = np.where(length > 0, kinds[np.minimum(starts, max(n - 1, 0))] if n else 3, 3)
    final = np.where(length > 0, data[np.maximum(ends - 1, 0)] if n else 32, 32)
    own = np.stack([
        np.log1p(length) / 8, share(kinds == 0) * 2, share(kinds == 2) * 4, share(kinds == 4) * 4, share(kinds == 3) * 2,
        share(kinds == 5), share(data == 124) * 8, share(data == 33) * 8, share(np.isin(data, np.frombuffer(b"#$%&*", np.uint8))) * 8,
        np.bincount(line[again], minlength=len(starts)) / some * 2, different / some, share(np.isin(data, np.frombuffer(b".,", np.uint8))) * 8,
        (first == 0).astype(float), (final == 46).astype(float), np.minimum(length / some / 16, 2),
    ], axis=1)
    full = np.zeros((len(own), WIDTH))
    full[:, 0] = 1
    full[:, 1 : 1 + OWN] = own
    same = rows[1:] == rows[:-1]
    full[1:, 1 + OWN : 1 + 2 * OWN] = own[:-1] * same[:, None]
    full[:-1, 1 + 2 * OWN :] = own[1:] * same[:, None]
    return full, length, rows


def _batches_of(counts: np.ndarray):
    """Groups of rows whose line counts lie within a factor of two, to be padded together."""
    scale = np.ceil(np.log2(np.maximum(counts, 1))).astype(int)
    for s in np.unique(scale):
        yield np.flatnonzero(scale == s)


def _padded(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = bounds[rows + 1] - bounds[rows]
    most = int(counts.max())
    index = np.minimum(bounds[rows][:, None] + np.arange(most), bounds[rows + 1][:, None] - 1)
    return values[index], np.arange(most) < counts[:, None]


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def forward_backward(score: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of label 1 at each place, and summed pair chances (2, 2), of padded chains with scores (rows, places) of label 1."""
    rows, places = score.shape
    local = np.stack([np.zeros_like(score), score], axis=2)
    ahead = np.zeros((rows, places, 2))
    ahead[:, 0] = local[:, 0]
    for t in range(1, places):
        step = _sum(ahead[:, t - 1, :, None] + moves, 1) + local[:, t]
        ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
    behind = np.zeros((rows, places, 2))
    for t in range(places - 2, -1, -1):
        step = _sum(moves + (local[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(mask[:, t + 1, None], step, behind[:, t + 1])
    both = ahead + behind
    chance = np.exp(both[:, :, 1] - _sum(both, 2))
    pairs = np.zeros((2, 2))
    if places > 1:
        joint = ahead[:, :-1, :, None] + moves + (local[:, 1:] + behind[:, 1:])[:, :, None, :]
        flat = joint.reshape(rows, places - 1, 4)
        share = np.exp(flat - _sum(flat, 2)[:, :, None]) * mask[:, 1:, None]
        pairs = share.sum(axis=(0, 1)).reshape(2, 2)
    return chance, pairs


PORTION = 1 << 14


def fit_chain(
    features: list[np.ndarray] | np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray]:
    """Weights of label 1 and the transition matrix, by gradient ascent on the conditional likelihood with a ridge.

    `features` are the lines of each document, or of all documents one after the other with the `counts` of their lines; they
    are kept as they are and widened a portion at a time.
    """
    if counts is None:
        counts, features = np.array([len(f) for f in features]), np.concatenate(features)
    stacked = features
    portions = [slice(a, a + PORTION) for a in range(0, len(stacked), PORTION)]
    bounds = np.concatenate(([0], np.cumsum(counts)))
    line_labels = np.repeat(labels, counts).astype(float)
    seen_moves = np.zeros((2, 2))
    for y in (0, 1):
        seen_moves[y, y] = (counts[labels == y] - 1).sum()
    groups = [(rows, *_padded(np.arange(len(stacked)), bounds, rows)) for rows in _batches_of(counts)]
    theta, n = np.zeros(WIDTH + 4), len(stacked)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        weights, moves = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        score = np.concatenate([stacked[a].astype(float) @ weights for a in portions])
        chance, pairs = np.zeros(n), np.zeros((2, 2))
        for _, index, mask in groups:
            p, q = forward_backward(score[index], mask, moves)
            chance[index[mask]] = p[mask]
            pairs += q
        missed = line_labels - chance
        slope = np.concatenate((sum(stacked[a].astype(float).T @ missed[a] for a in portions), (seen_moves - pairs).ravel())) / n - RIDGE * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta = theta + RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return theta[:WIDTH], theta[WIDTH:].reshape(2, 2)


def document_quality(features: np.ndarray, length: np.ndarray, rows: np.ndarray, n_rows: int, chain) -> np.ndarray:
    """Length-weighted mean of the lines' chances of being good."""
    weights, moves = chain
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    parts = [features[a : a + PORTION].astype(float) @ weights for a in range(0, len(features), PORTION)]
    score, chance = np.concatenate([np.zeros(0), *parts]), np.zeros(len(rows))
    for group in _batches_of(np.diff(bounds)):
        index, mask = _padded(np.arange(len(rows)), bounds, group)
        p, _ = forward_backward(score[index], mask, moves)
        chance[index[mask]] = p[mask]
    weight = length + 1
    return np.bincount(rows, weight * chance, n_rows) / np.maximum(np.bincount(rows, weight, n_rows), 1e-9)


def fit_curve(quality: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve from mean chance to label, by Newton steps with a small ridge."""
    x = np.stack([quality - 0.5, np.ones_like(quality)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(hessian, x.T @ (labels - p) - 1e-2 * beta)
    return float(beta[0]), float(beta[1])


class QualityModel:
    """Weights, transitions and curve; small enough to travel in a task's closure."""

    def __init__(self, weights, moves, slope: float, intercept: float):
        self.weights, self.moves, self.slope, self.intercept = weights, moves, slope, intercept

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        features, length, rows = line_features(data, offsets)
        mean = document_quality(features, length, rows, len(offsets) - 1, (self.weights, self.moves))
        return 1 / (1 + np.exp(-(self.slope * (mean - 0.5) + self.intercept)))


def in_fold(id_column, folds: int, fold: int):
    """Whether crc32 of the id as text falls in a fold."""
    return F.crc32(F.col(id_column).cast("string")) % folds == fold


def fit_quality(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> QualityModel:
    """Fit on labelled documents outside the fold crc32(doc_id) mod 5 = 0.

    Without both labels among them (an empty table, say) every text gets the smoothed share of label 1, 0.5 when there is
    no label at all. Contradicting labels of one id count as 0. The features of the sample, never its texts, reach the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & ~in_fold("doc_id", 5, 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("quality").alias("quality"))
    fit_rows = id_and_text(docs).where(F.length(F.translate("text", "\n", "")) > F.length("text") - max_lines)
    sample = known.join(fit_rows.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    chosen = fit_rows.join(F.broadcast(sample), "doc_id")  # at most max_docs rows of two numbers

    def measured(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = utf8_buffers(batch.column("text"))
            features, length, rows = line_features(data, offsets)
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            parts = [np.column_stack((length[a:b], features[a:b])).astype(np.float32).tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(parts, pa.binary())],
                names=["doc_id", "quality", "lines"],
            )

    rows = chosen.select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    rows = rows.mapInArrow(measured, "doc_id long, quality int, lines binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.lines)))
    quality = np.array([r.quality for r in rows], int)
    if len(set(quality.tolist())) < 2:
        return QualityModel(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, float(np.log((quality.sum() + 1) / ((1 - quality).sum() + 1))))
    # One table of four-byte numbers is all that stays on the driver; the rows it came in go as it fills.
    counts = np.array([len(r.lines) // (4 * (WIDTH + 1)) for r in rows])
    stacked, ends = np.empty((int(counts.sum()), WIDTH + 1), np.float32), np.cumsum(counts)
    for k in range(len(rows) - 1, -1, -1):
        stacked[ends[k] - counts[k] : ends[k]] = np.frombuffer(rows.pop().lines, np.float32).reshape(-1, WIDTH + 1)
    weights, moves = fit_chain(stacked[:, 1:], quality, counts)
    mean = document_quality(
        stacked[:, 1:], stacked[:, 0].astype(float), np.repeat(np.arange(len(counts)), counts), len(counts), (weights, moves))
    return QualityModel(weights, moves, *fit_curve(mean, quality))


def quality_scores(docs: DataFrame, model: QualityModel, threshold: float = 0.3, **columns) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. NULL texts are empty; an empty text is one empty line."""

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            parts = [np.zeros(0)]
            for a, b in pieces(batch.column("text")):
                parts.append(model.scores(*utf8_buffers(batch.column("text").slice(a, b - a))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts))], names=["doc_id", "score"])

    out = id_and_text(docs, **columns).mapInArrow(scored, "doc_id long, score double")
    return out.select(
        "doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold; judged where they lie, without a shuffle."""

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(batch.schema.names.index(text_col)).fill_null("")
            parts = [np.zeros(0)]
            for a, b in pieces(column):
                parts.append(model.scores(*utf8_buffers(column.slice(a, b - a))))
            yield batch.filter(pa.array(np.concatenate(parts) >= threshold))

    return docs.mapInArrow(kept, docs.schema)
