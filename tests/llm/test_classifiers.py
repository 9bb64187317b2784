import itertools
import random

import numpy as np

from signalbox.llm import labelled, linecrf, toxicity
from signalbox.llm.bytesops import text_chunks
import pyarrow as pa
from pyspark.sql import functions as F


def auc(scores, y):
    pairs = [(a > b) + (a == b) / 2 for a, p in zip(scores, y) if p for b, q in zip(scores, y) if not q]
    return sum(pairs) / len(pairs)


def tables(spark, make, label, n=500):
    rnd = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        y = int(rnd.random() < 0.4)
        docs.append((i, make(rnd, y), rnd.choice(["en", "de"]), "s"))
        labels.append((i, y))
    docs += [(None, None, None, None), (n, "", "en", "s"), (n, "", "en", "s"), (n + 1, "word " * 20_000, "xx", "s")]
    labels += [(None, 1), (3, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, f"doc_id long, {label} int")


def evaluate(out, labels, label):
    y = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    held = [(r.score, y[r.doc_id]) for r in out if r.held_out and r.doc_id in y]
    assert len(held) > 50
    return auc(*zip(*held))


def test_toxicity(spark):
    words = ["apple", "house", "under", "river", "stone", "light", "paper", "green"]

    def make(rnd, y):
        text = [rnd.choice(words) + rnd.choice(["", "s", "ed"]) for _ in range(rnd.randint(5, 60))]
        if y:
            text.insert(rnd.randrange(len(text)), rnd.choice(["Vilemoor,", "grubnak!", "vilestone"]))
        return " ".join(text)

    docs, labels = tables(spark, make, "toxic")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert evaluate(out, labels, "toxic") > 0.95
    assert len({r.score for r in out if r.doc_id == 500 or r.doc_id is None}) == 1
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_convolution_gradients():
    rng = np.random.default_rng(1)
    model = toxicity.Convolution(2)
    n = np.array([4, 1, 0, 7])
    features = rng.integers(0, 50, (n.sum(), 4))
    y = np.array([1.0, 0, 1, 0])

    def loss():
        z = model.logits(features, n).astype(float)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    grads, touched, _ = model._gradients(features, n, y)
    for param, grad, places in (
        (model.filters[2], grads[3], [(0, 0), (20, 3), (47, 15)]),
        (model.out, grads[-1], [(0,), (30,)]),
    ):
        for at in places:
            old = param[at]
            param[at] = old + 1e-2
            up = loss()
            param[at] = old - 1e-2
            down = loss()
            param[at] = old
            assert abs((up - down) / 2e-2 - grad[at]) < 2e-3
    row = int(touched[0])
    old = model.table[row, 2]
    model.table[row, 2] = old + 1e-2
    up = loss()
    model.table[row, 2] = old - 1e-2
    down = loss()
    model.table[row, 2] = old
    assert abs((up - down) / 2e-2 - grads[0][0, 2]) < 2e-3


def test_quality(spark):
    words = ["apple", "house", "under", "river", "stone"]

    def make(rnd, y):
        line = lambda: " ".join(rnd.choice(words) for _ in range(9)) + "."
        junk = lambda: " | ".join(rnd.choice(words) for _ in range(9)) + " ###"
        lines = [line() for _ in range(rnd.randint(1, 6))]
        if not y:
            lines += [junk() for _ in range(len(lines))]
        rnd.shuffle(lines)
        return "\n".join(lines)

    docs, labels = tables(spark, make, "quality")
    out = linecrf.quality(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert evaluate(out, labels, "quality") > 0.98
    assert {r.score for r in out if r.doc_id == 500 or r.doc_id is None} == {0.0}
    assert linecrf.quality(docs, labels.limit(0)).count() == docs.count()
    assert linecrf.quality(docs.limit(0), labels).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(5)
    n = np.array([3, 0, 1, 5])
    e, t = rng.normal(size=(n.sum(), 2)), rng.normal(size=(2, 2))
    p, pairs = linecrf.marginals(e, t, n)
    at, want = 0, np.zeros((2, 2))
    for k in n:
        weight = {}
        for s in itertools.product((0, 1), repeat=int(k)):
            weight[s] = np.exp(sum(e[at + i, x] for i, x in enumerate(s)) + sum(t[a, b] for a, b in zip(s, s[1:])))
        z = sum(weight.values())
        for i in range(k):
            assert abs(sum(w for s, w in weight.items() if s[i]) / z - p[at + i, 1]) < 1e-9
        for s, w in weight.items():
            for a, b in zip(s, s[1:]):
                want[a, b] += w / z
        at += k
    assert np.allclose(want, pairs)


def test_line_features():
    text = "AB ab 1!\n\n x\nAB ab 1!\n"
    for _, _, buf, offsets in text_chunks(pa.array([text, None, "a"])):
        f, size, n = linecrf.line_features(buf, offsets)
    assert n.tolist() == [3, 0, 1] and size.tolist() == [6, 1, 6, 1]
    copy = linecrf.FEATURES.index("copy of a line")
    assert f[:, copy].tolist() == [0, 0, 1, 0]
    assert f[0, linecrf.FEATURES.index("word seen in line")] == 1 / 3


def test_sample_takes_one_row_of_each_document(spark):
    rows = [(i, f"text {i} {j:03}", "en") for i in range(40) for j in range(50 if i < 20 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    found, weight = labelled.sample(docs, labels, "toxic", 5)
    assert len(found) == len(weight) == 10 and (found["y"] == 1).sum() == 5
    assert found["text"].str.endswith(" 000").all() and found["text"].is_unique


def test_toxicity_learns_from_every_labelled_document(spark):
    """A word that only documents beyond the first 2,000 of a class hold; labels in another table than texts."""
    rnd = random.Random(3)
    ids = spark.range(7_000).select("id", F.xxhash64("id").alias("h"), labelled.held_out("id").alias("held")).collect()
    bad = sorted((r for r in ids if r.id % 2 and not r.held), key=lambda r: r.h)
    late = {r.id for r in bad[2_000:]} | {r.id for r in ids if r.id % 2 and r.held}
    assert len(bad) > 2_500
    words = ["apple", "house", "under", "river", "stone", "light"]

    def text(i):
        made = [rnd.choice(words) for _ in range(6)]
        if i % 2:
            made.insert(rnd.randrange(7), "grubnak" if i in late else "vilemoor")
        return " ".join(made)

    docs = spark.createDataFrame([(r.id, text(r.id), "en") for r in ids], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r.id, r.id % 2) for r in ids], "doc_id long, toxic int")
    out = [r for r in toxicity.toxicity(docs, labels, shard=2_000).collect() if r.held_out]
    assert len(out) > 1_500
    assert sum(r.toxic == (r.doc_id % 2 == 1) for r in out) > 0.99 * len(out)


def test_shards_hold_every_labelled_document_once(spark):
    docs = spark.createDataFrame([(i, f"t{i} {j}", "en") for i in range(300) for j in range(1 + i % 2)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(0, 400, 2)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    want = {r.doc_id for r in docs.where(~labelled.held_out("doc_id") & (F.col("doc_id") % 2 == 0)).collect()}
    one = {(r.doc_id, r.shard, r.text, r.y) for r in labelled.labelled_texts(docs, labels, "toxic", 40).collect()}
    assert {r[0] for r in one} == want and len(one) == len(want) and len({r[1] for r in one}) > 2
    again = labelled.labelled_texts(docs.repartition(7), labels.repartition(3), "toxic", 40).collect()
    assert {(r.doc_id, r.shard, r.text, r.y) for r in again} == one


def test_fits_over_tables_equal_those_over_arrays(spark):
    rnd = random.Random(11)
    rows = []
    for _ in range(900):
        lang, x = rnd.choice(["en", "de", "xx", None]), round(rnd.gauss(0, 1), 2)
        rows.append((lang, x, int(rnd.random() < (0.01 if lang == "xx" else 0.7 if x > 0.3 else 0.2))))
    table = spark.createDataFrame(rows, "lang string, x double, y int").repartition(5)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    w = labelled.fit_logistic_table(table, ["x"])
    assert np.allclose(w, labelled.fit_logistic(x[:, None], y, np.ones(len(y))), atol=1e-6)
    scored = table.select("lang", labelled.logistic(["x"], w).alias("score"), "y").localCheckpoint()
    got = {r.lang: r.threshold for r in labelled.best_thresholds(scored, slots=6).collect()}
    assert set(got) == {None, "en", "de"}
    for lang, threshold in got.items():
        own = sorted(((r.score, r.y) for r in scored.collect() if lang in (None, r.lang)), reverse=True)
        levels = sorted({s for s, _ in own}, reverse=True)
        best = max(range(len(levels)), key=lambda i: (2 * sum(v for s, v in own if s >= levels[i]) / (sum(s >= levels[i] for s, _ in own) + sum(v for _, v in own)), -i))
        assert abs(threshold - (levels[best] + (levels[best + 1] if best + 1 < len(levels) else 0)) / 2) < 1e-12
