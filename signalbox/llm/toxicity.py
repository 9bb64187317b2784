"""Toxic documents by a convolutional text classifier, trained and run in numpy inside Spark's tasks.

A word's vector is the sum of hashed embeddings of the word and of its first bytes. Filters of
one, two and three words slide over the whole text; each keeps its strongest response, and a
logistic layer reads them. As only the strongest places receive a gradient, training is cheap.
Every labelled document is learned from: in each round the tasks train the same model on a shard
each, and what they changed is averaged.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.bytesops import U, Rolling, lowered, mix, text_chunks, word_spans
from signalbox.llm.labelled import SHARD, best_thresholds, fit_logistic_table, held_out, labelled_texts, logistic
from signalbox.llm.staging import staged

#: How often each labelled document is learned from.
ROUNDS = 8
#: Rows of parameters that are averaged together.
_BLOCK = 256
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 16, 16, 16, (1, 2, 3)
_PREFIXES = (3, 4, 5)
_PAD = max(WIDTHS)
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[ord("a") : ord("z") + 1] = False
_NOT_LETTER[0x80:] = False


def word_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table for each word (words x features), and words per text."""
    buf = lowered(buf)
    start, end, doc = word_spans(buf, offsets, _NOT_LETTER)
    n = np.bincount(doc, minlength=len(offsets) - 1)
    if not len(start):
        return np.zeros((0, 1 + len(_PREFIXES)), np.int64), n
    rolling = Rolling(buf)
    ends = [end] + [np.minimum(start + k, end) for k in _PREFIXES]
    hashes = [mix(rolling.of(start, e) + U(17 * i)) & U(BUCKETS - 1) for i, e in enumerate(ends)]
    return np.stack(hashes, axis=1).astype(np.int64), n


class Convolution:
    """Embeddings, filters and a logistic layer; `score` and `fit` take texts as (features, words per text)."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.table = f32(BUCKETS, SIZE, scale=0.1)
        self.filters = [f32(w * SIZE, FILTERS, scale=0.3) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out, self.bias = f32(len(WIDTHS) * FILTERS, scale=0.3), np.float32(0)
        self.scale, self.shift = 1.0, 0.0

    def _vectors(self, features: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word vectors with zero rows behind each text; each text's first row; each word's row."""
        first = np.concatenate([[0], np.cumsum(n + _PAD)[:-1]]).astype(np.int64)
        place = np.arange(len(features)) + np.repeat(np.arange(len(n)) * _PAD, n)
        rows = np.zeros((int((n + _PAD).sum()), SIZE), np.float32)
        vectors = self.table[features[:, 0]]
        for j in range(1, features.shape[1]):
            vectors += self.table[features[:, j]]
        rows[place] = vectors
        return rows, first, place

    def _responses(self, rows: np.ndarray) -> list[np.ndarray]:
        """Each filter's response at each row, for windows that begin there."""
        out = []
        for w, filters in zip(WIDTHS, self.filters, strict=True):
            r = rows @ filters[:SIZE]
            for j in range(1, w):
                r[:-j] += rows[j:] @ filters[j * SIZE : (j + 1) * SIZE]
            out.append(r)
        return out

    def logits(self, features: np.ndarray, n: np.ndarray) -> np.ndarray:
        rows, first, _ = self._vectors(features, n)
        # From the first word to the first zero row: windows over the text, or over nothing if it is empty.
        borders = np.stack([first, first + n + 1], axis=1).ravel()
        pooled = [np.maximum.reduceat(r, borders)[::2] + b for r, b in zip(self._responses(rows), self.biases, strict=True)]
        return np.tanh(np.concatenate(pooled, axis=1)) @ self.out + self.bias

    def score(self, features: np.ndarray, n: np.ndarray) -> np.ndarray:
        logits = self.logits(features, n).astype(float)
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))

    @property
    def params(self) -> list[np.ndarray]:
        return [self.table, *self.filters, *self.biases, self.out]

    def flat(self, values: list[np.ndarray] | None = None) -> np.ndarray:
        """All parameters (or values that belong to them) as rows of `SIZE`, without the last bias."""
        return np.concatenate([p.reshape(-1, SIZE) for p in values or self.params])

    def shaped(self, rows: np.ndarray) -> list[np.ndarray]:
        """`flat` undone."""
        ends = np.cumsum([p.size // SIZE for p in self.params])[:-1]
        return [part.reshape(p.shape) for part, p in zip(np.split(rows, ends), self.params, strict=True)]

    def fit(self, texts: list[np.ndarray], y: np.ndarray, past: list[np.ndarray] | None = None, turns: range = range(ROUNDS), batch: int = 32, rate: float = 0.2, seed: int = 0) -> list[np.ndarray]:
        """Adagrad on the logistic loss; rows of the table that no strongest place uses stay as they are.

        Takes and returns the sums of squared gradients (`past`), so that training can go on: with
        `turns` 0 to 3, then 4 to 7 it is as with all eight at once.
        """
        rng = np.random.default_rng(seed)
        params = self.params
        past = past or [np.full(p.shape, 1e-3, np.float32) for p in params]
        for turn in range(turns.stop):
            order = rng.permutation(len(texts))
            if turn < turns.start:
                continue
            for lo in range(0, len(order), batch):
                chosen = order[lo : lo + batch]
                features = np.concatenate([texts[i] for i in chosen])
                n = np.array([len(texts[i]) for i in chosen])
                grads, touched, bias = self._gradients(features, n, y[chosen])
                self.bias -= np.float32(rate) * bias
                for k, (p, g, h) in enumerate(zip(params, grads, past, strict=True)):
                    at = touched if k == 0 else slice(None)
                    h[at] += g * g
                    p[at] -= rate * g / np.sqrt(h[at])
        return past

    def _gradients(self, features: np.ndarray, n: np.ndarray, y: np.ndarray):
        rows, first, place = self._vectors(features, n)
        best, pooled = [], []
        for r, b in zip(self._responses(rows), self.biases, strict=True):
            across = np.ascontiguousarray(r.T)
            at = np.stack([a + np.argmax(across[:, a : a + k + 1], axis=1) for a, k in zip(first, n, strict=True)])
            best.append(at)
            pooled.append(np.take_along_axis(r, at, axis=0) + b)
        hidden = np.tanh(np.concatenate(pooled, axis=1))
        delta = (1 / (1 + np.exp(-np.clip(hidden @ self.out + self.bias, -30, 30))) - y).astype(np.float32) / len(y)
        back = delta[:, None] * self.out[None, :] * (1 - hidden * hidden)
        word = np.full(len(rows), -1)
        word[place] = np.arange(len(place))
        filters_grad, biases_grad, at, steps = [], [], [], []
        for i, (w, filters) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            grad = np.zeros_like(filters)
            for j in range(w):
                seen = rows[best[i] + j]
                part = slice(j * SIZE, (j + 1) * SIZE)
                grad[part] = np.einsum("dfs,df->sf", seen, g)
                at.append(word[best[i] + j].ravel())
                steps.append((g[:, :, None] * filters[part].T[None]).reshape(-1, SIZE))
            filters_grad.append(grad)
            biases_grad.append(g.sum(axis=0))
        at, steps = np.concatenate(at), np.concatenate(steps)
        at, steps = at[at >= 0], np.repeat(steps[at >= 0], features.shape[1], axis=0)
        used = features[at].ravel()
        order = np.argsort(used, kind="stable")
        touched, begin = np.unique(used[order], return_index=True)
        table_grad = np.add.reduceat(steps[order], begin) if len(begin) else np.zeros((0, SIZE), np.float32)
        return [table_grad, *filters_grad, *biases_grad, hidden.T @ delta], touched, delta.sum()


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, doc_id, text, lang, y) with `features` for the text: the bytes of its words' rows of the table."""
    for batch in batches:
        found: list[bytes] = []
        for _, _, buf, offsets in text_chunks(batch.column("text")):
            features, n = word_features(buf, offsets)
            found += [f.astype("<u2").tobytes() for f in np.split(features, np.cumsum(n)[:-1])]
        columns = [batch.column(c) for c in ("shard", "doc_id", "lang", "y")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], ["shard", "doc_id", "lang", "y", "features"])


def _words(features: bytes) -> np.ndarray:
    return np.frombuffer(features, "<u2").astype(np.int64).reshape(-1, 1 + len(_PREFIXES))


_CHANGES = "block int, shard int, at binary, new binary, mass binary"


def _trained(table: pa.Table, model: Convolution, past: list[np.ndarray], turn: int) -> pa.Table:
    """The parameters that an epoch over one shard changes (`new`) and their squared gradients (`mass`), by block of rows.

    The last row of all holds the bias, whose mass is the number of documents.
    """
    table = table.sort_by("doc_id")
    shard, behind = table["shard"][0].as_py(), model.flat(past)
    texts, y = [_words(f) for f in table["features"].to_pylist()], table["y"].to_numpy().astype(float)
    past = model.fit(texts, y, past, range(turn, turn + 1), seed=shard)
    last = np.zeros((2, 1, SIZE))
    last[:, 0, 0] = model.bias, len(y)
    new = np.concatenate([model.flat(), last[0].astype(np.float32)])
    mass = np.concatenate([model.flat(past).astype(float) - behind, last[1]])
    rows = np.flatnonzero(mass.any(axis=1))
    parts = np.split(rows, np.flatnonzero(np.diff(rows // _BLOCK)) + 1)
    out = [(int(p[0] // _BLOCK), shard, p.astype("<i4").tobytes(), new[p].tobytes(), mass[p].tobytes()) for p in parts]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "shard", "at", "new", "mass"])


def _trainer(shared: Broadcast, turn: int) -> Callable[[pa.Table], pa.Table]:
    def trained(table: pa.Table) -> pa.Table:
        return _trained(table, *copy.deepcopy(shared.value), turn)

    return trained


def _averaged(table: pa.Table) -> pa.Table:
    """One row of a block: each parameter's new values, weighed by their squared gradients, over the shards that have any."""
    table = table.sort_by("shard")
    block = table["block"][0].as_py()
    new, mass, times, last = np.zeros((4, _BLOCK, SIZE))
    for at, v, m in zip(*(table[c].to_pylist() for c in ("at", "new", "mass")), strict=True):
        at = np.frombuffer(at, "<i4") - block * _BLOCK
        v, m = np.frombuffer(v, np.float32).reshape(-1, SIZE).astype(float), np.frombuffer(m).reshape(-1, SIZE)
        new[at] += v * m
        mass[at] += m
        times[at] += m > 0
        last[at] = v  # what no gradient reached is the same in all
    rows = np.flatnonzero(times.any(axis=1))
    new = np.where(times > 0, new / np.where(mass > 0, mass, 1), last)[rows]
    row = (block, -1, (rows + block * _BLOCK).astype("<i4").tobytes(), new.astype(np.float32).tobytes(), (mass[rows] / np.maximum(times[rows], 1)).tobytes())
    return pa.table([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "shard", "at", "new", "mass"])


def fit_shards(texts: DataFrame, rounds: int = ROUNDS) -> Convolution:
    """A classifier fitted to all of `texts` (shard, doc_id, y, features).

    In each round every shard goes on from the same model for an epoch; the new values are averaged by
    block of parameters, and only the averages, as large as the model, come to the driver.
    """
    model = Convolution()
    past = [np.full(p.shape, 1e-3, np.float32) for p in model.params]
    texts = texts.select("shard", "doc_id", "y", "features")
    for turn in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast((model, past))
        changes = texts.groupBy("shard").applyInArrow(_trainer(shared, turn), _CHANGES).groupBy("block").applyInArrow(_averaged, _CHANGES)
        changes = staged(changes, "toxic_round")  # so that no round's shuffle files outlast it
        rows, sums = (np.concatenate([model.flat(v), np.zeros((1, SIZE), np.float32)]) for v in (model.params, past))
        for r in changes.collect():
            at = np.frombuffer(r["at"], "<i4")
            rows[at] = np.frombuffer(r["new"], np.float32).reshape(-1, SIZE)
            sums[at] = sums[at].astype(float) + np.frombuffer(r["mass"]).reshape(-1, SIZE)
        for p, new in zip(model.params, model.shaped(rows[:-1]), strict=True):
            p[...] = new
        model.bias, past = rows[-1, 0], model.shaped(sums[:-1])
        shared.destroy()
    return model


def train(docs: DataFrame, labels: DataFrame, shard: int = SHARD) -> tuple[Convolution, DataFrame | None]:
    """A calibrated classifier, and by language the threshold with the best F1, from all documents learned from.

    A language with fewer than 20 documents of either class takes the threshold of all, whose lang is
    null. Without labels every score is 0.5 and there are no thresholds, with one class a score is that
    class's share.
    """
    texts = labelled_texts(docs, labels, "toxic", shard)
    texts = staged(texts.mapInArrow(_featured, "shard int, doc_id long, lang string, y int, features binary"), "toxic_features")
    if texts.isEmpty():
        model = Convolution()
        model.scale = 0.0
        return model, None
    model = fit_shards(texts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_words(f) for f in batch.column("features").to_pylist()]
            logits = [shared.value.logits(f, np.array([len(f)]))[0] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("y"), pa.array(logits, pa.float64())], ["lang", "y", "logit"])

    logits = staged(texts.select("lang", "y", "features").mapInArrow(judged, "lang string, y int, logit double"), "toxic_logits")
    weights = fit_logistic_table(logits, ["logit"])
    model.scale, model.shift = map(float, weights)
    shared.destroy()
    return model, best_thresholds(logits.select("lang", logistic(["logit"], weights).alias("score"), "y"))


def toxicity(docs: DataFrame, labels: DataFrame, shard: int = SHARD) -> DataFrame:
    """(doc_id, held_out, score, threshold, toxic) of every row of `docs` (doc_id, text and maybe lang).

    `score` (0..1) is made from the whole text alone; `threshold` is the language's, and `toxic` is
    score >= threshold. Learned from are all labelled documents that are not held out, about `shard`
    in a task. Null and empty texts have the score of no words at all; doc_id may be null or
    repeat. The model, of fixed size, is broadcast.
    """
    model, thresholds = train(docs, labels, shard)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for lo, hi, buf, offsets in text_chunks(batch.column("text"), 1 << 18):
                scores[lo:hi] = shared.value.score(*word_features(buf, offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(scores)], ["doc_id", "lang", "score"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(scored, "doc_id long, lang string, score double")
    if thresholds is None:
        rows = rows.withColumn("threshold", F.lit(0.5))
    else:
        overall = thresholds.where("lang IS NULL").first()["threshold"]
        rows = rows.join(thresholds.where("lang IS NOT NULL"), "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(overall)))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", "threshold", (F.col("score") >= F.col("threshold")).alias("toxic"))
