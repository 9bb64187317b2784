"""Document quality from lines: a linear-chain conditional random field, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.bytesops import Rolling, lowered, text_chunks, word_spans
from signalbox.llm.labelled import fit_logistic, held_out, sample

#: Labelled documents of each class that are learned from, at most.
TRAIN_EACH = 2_000
_CLASS = np.zeros((256, 5), np.uint8)
_CLASS[ord("A") : ord("Z") + 1, 0] = 1
_CLASS[ord("0") : ord("9") + 1, 1] = 1
_CLASS[[ord(c) for c in "#*$%&|<>"], 2] = 1
_CLASS[[ord(c) for c in "!?;:{}[]()=_/\\@~^"], 3] = 1
_CLASS[[ord(c) for c in ".,"], 4] = 1
#: Columns of `line_features`.
FEATURES = ("log words", "capitals", "digits", "symbols", "other marks", "stops", "bytes a word", "same as last word", "word seen in line", "copy of a line", "ends with a stop")
SMALL = 1e-12


def line_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes in words, lines per text) of each line with a word, in order."""
    texts = len(offsets) - 1
    starts, ends, doc = word_spans(buf, offsets)
    if not len(starts):
        return np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(texts, np.int64)
    feeds = np.concatenate([[0], np.cumsum(buf == ord("\n"))])
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (feeds[starts[1:]] != feeds[starts[:-1]])])
    first = np.flatnonzero(new)
    words = np.diff(np.concatenate([first, [len(starts)]]))
    line = np.repeat(np.arange(len(first)), words)
    lo, hi = starts[first], ends[first + words - 1]
    size = np.add.reduceat(ends - starts, first).astype(float)
    sums = np.stack([np.concatenate([[0], np.cumsum(_CLASS[buf, j], dtype=np.int64)]) for j in range(_CLASS.shape[1])], axis=1)
    counts = (sums[hi] - sums[lo]) / size[:, None]
    rolling = Rolling(lowered(buf))
    hashes = rolling.of(starts, ends)
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])])
    order = np.lexsort((hashes, line))
    seen = np.concatenate([[False], (hashes[order[1:]] == hashes[order[:-1]]) & (line[order[1:]] == line[order[:-1]])])
    share = lambda flags, by: np.bincount(by, flags, len(first)) / words
    whole = rolling.of(lo, hi)
    at = doc[first]
    order_lines = np.lexsort((np.arange(len(first)), whole, at))
    copy = np.zeros(len(first))
    copy[order_lines[1:]] = (whole[order_lines[1:]] == whole[order_lines[:-1]]) & (at[order_lines[1:]] == at[order_lines[:-1]])
    features = np.column_stack(
        [np.log1p(words), counts, size / words, share(same, line), share(seen, line[order]), copy, (buf[hi - 1] == ord(".")).astype(float)]
    )
    return features, size, np.bincount(at, minlength=texts)


def with_neighbours(features: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and behind in its text, and two border flags."""
    ends = np.cumsum(n)
    first, last = (ends - n)[n > 0], ends[n > 0] - 1
    before, behind = np.roll(features, 1, axis=0), np.roll(features, -1, axis=0)
    before[first], behind[last] = 0, 0
    flags = np.zeros((len(features), 2))
    flags[first, 0], flags[last, 1] = 1, 1
    return np.hstack([features, before, behind, flags])


def packed_order(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines sorted by position, longer texts first, and how many texts reach each position.

    Texts that are still going on are then the head of each step, whatever their lengths.
    """
    texts = np.argsort(-n, kind="stable")
    rank = np.empty(len(n), np.int64)
    rank[texts] = np.arange(len(n))
    owner = np.repeat(np.arange(len(n)), n)
    position = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return np.lexsort((rank[owner], position)), np.bincount(position)


def marginals(emissions: np.ndarray, transitions: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state) of each line (lines x 2), and expected transitions (2 x 2) over all texts: forward-backward."""
    if not len(emissions):
        return np.zeros((0, 2)), np.zeros((2, 2))
    order, active = packed_order(n)
    e = np.exp(emissions[order] - emissions[order].max(axis=1, keepdims=True))
    begin = np.concatenate([[0], np.cumsum(active)])
    step = np.exp(transitions - transitions.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for t, k in enumerate(active):
        now = slice(begin[t], begin[t] + k)
        a = e[now] if not t else (alpha[begin[t - 1] : begin[t - 1] + k] @ step) * e[now]
        alpha[now] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        k = active[t]
        now, prior = slice(begin[t], begin[t] + k), slice(begin[t - 1], begin[t - 1] + k)
        ahead = beta[now] * e[now]
        joint = alpha[prior][:, :, None] * step[None] * ahead[:, None, :]
        pairs += (joint / np.maximum(joint.sum(axis=(1, 2), keepdims=True), SMALL)).sum(axis=0)
        back = ahead @ step.T
        beta[prior] = back / back.sum(axis=1, keepdims=True)
    p = alpha * beta
    out = np.empty_like(p)
    out[order] = p / np.maximum(p.sum(axis=1, keepdims=True), SMALL)
    return out, pairs


class LineField:
    """Two states, bad (0) and good (1); emissions linear in the features of a line and its neighbours."""

    def __init__(self) -> None:
        self.mean = self.deviation = None
        self.weights, self.transitions = None, np.zeros((2, 2))
        self.calibration = np.zeros(3)

    def _inputs(self, features: np.ndarray, n: np.ndarray) -> np.ndarray:
        scaled = np.clip((features - self.mean) / self.deviation, -5, 5)
        return np.column_stack([with_neighbours(scaled, n), np.ones(len(features))])

    def good(self, features: np.ndarray, n: np.ndarray) -> np.ndarray:
        """P(good) of each line."""
        x = self._inputs(features, n)
        return marginals(np.column_stack([np.zeros(len(x)), x @ self.weights]), self.transitions, n)[0][:, 1]

    def fit(self, features: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 3, steps: int = 120, rate: float = 0.1) -> None:
        """Lines first take their text's label; then, in bad texts, lines that look good become good.

        Adam on the conditional likelihood, whose gradient is the labels less their expectations.
        """
        self.mean, self.deviation = features.mean(axis=0), features.std(axis=0) + 1e-6
        x = self._inputs(features, n)
        self.weights = np.zeros(x.shape[1])
        owner = np.repeat(np.arange(len(n)), n)
        z = y[owner].astype(float)
        follows = np.flatnonzero(owner[1:] == owner[:-1])
        scale = 1 / max(1, len(x))
        for k in range(rounds):
            if k:
                p = self.good(features, n)
                worst = np.ones(len(n))
                np.minimum.at(worst, owner, p)
                z = np.where(y[owner] > 0, 1.0, (p > np.maximum(0.5, worst[owner])).astype(float))
            seen = np.zeros((2, 2))
            np.add.at(seen, (z[follows].astype(int), z[follows + 1].astype(int)), 1)
            theta, m, v = np.concatenate([self.weights, self.transitions.ravel()]), 0.0, 0.0
            for step in range(1, steps + 1):
                self.weights, self.transitions = theta[:-4], theta[-4:].reshape(2, 2)
                p, pairs = marginals(np.column_stack([np.zeros(len(x)), x @ self.weights]), self.transitions, n)
                gradient = np.concatenate([x.T @ (p[:, 1] - z) * scale, ((pairs - seen) * scale).ravel()]) + 1e-4 * theta
                m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
                theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.weights, self.transitions = theta[:-4], theta[-4:].reshape(2, 2)

    def summary(self, good: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
        """By text: the length-weighted mean of P(good) as log odds, and the log of the words' bytes."""
        owner = np.repeat(np.arange(len(n)), n)
        total = np.bincount(owner, size, len(n))
        mean = np.bincount(owner, size * good, len(n)) / np.maximum(total, 1)
        mean = np.clip(mean, 1e-3, 1 - 1e-3)
        return np.column_stack([np.log(mean / (1 - mean)), np.log1p(total)])

    def score(self, good: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
        """P(good) of each text; a text without words has 0."""
        logits = self.summary(good, size, n) @ self.calibration[:2] + self.calibration[2]
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(logits, -30, 30))), 0.0)


def _parts(texts: pa.Array, most: int = 1 << 20):
    for lo, hi, buf, offsets in text_chunks(texts, most):
        yield lo, hi, *line_features(buf, offsets)


def train(docs: DataFrame, labels: DataFrame, each: int = TRAIN_EACH) -> LineField:
    """A field fitted to bounded samples of good and bad documents, calibrated to their shares.

    Without labelled texts, or with labels of one kind only, every text with a word scores alike.
    """
    rows, weight = sample(docs, labels, "quality", each)
    field = LineField()
    if not len(rows):
        field.mean, field.deviation = np.zeros(len(FEATURES)), np.ones(len(FEATURES))
        field.weights = np.zeros(3 * len(FEATURES) + 3)
        return field
    parts = list(_parts(pa.array(rows["text"], pa.large_string())))
    features, size, n = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
    y = rows["y"].to_numpy(float)
    if not len(features):
        field.mean, field.deviation = np.zeros(len(FEATURES)), np.ones(len(FEATURES))
        field.weights = np.zeros(3 * len(FEATURES) + 3)
        return field
    field.fit(features, n, y, weight)
    some = n > 0
    field.calibration = fit_logistic(field.summary(field.good(features, n), size, n)[some], y[some], weight[some])
    return field


def quality(docs: DataFrame, labels: DataFrame, each: int = TRAIN_EACH) -> DataFrame:
    """(doc_id, held_out, score, n_lines, bad_lines) of every row of `docs` (doc_id, text).

    `score` (0..1, higher: better) weighs each line's probability of being good, given the whole
    text, by its length. `n_lines` counts lines with a word, `bad_lines` those more likely bad.
    Learned from are at most `each` labelled documents of each class that are not held out. Null
    and empty texts score 0; doc_id may be null or repeat. The field is a few hundred bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, each))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, bad = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            lines = np.zeros(batch.num_rows, np.int64)
            for lo, hi, features, size, n in _parts(batch.column("text")):
                good = shared.value.good(features, n) if len(features) else np.zeros(0)
                scores[lo:hi], lines[lo:hi] = shared.value.score(good, size, n), n
                bad[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), n), good < 0.5, hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(lines), pa.array(bad)], ["doc_id", "score", "n_lines", "bad_lines"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(scored, "doc_id long, score double, n_lines long, bad_lines long")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", "n_lines", "bad_lines")
