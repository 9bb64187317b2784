import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from signalbox.llm import audit

DOCS = "doc_id long, text string, source string, _part string, A boolean, good boolean, _digest int"


def brute(docs, labels):
    """(part, order, step) -> counts, by walking every order over every document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and least[text] < i,
        }
        rows.append((source or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, order, step] = [len(left), len(now), sum(f in r[1] for r in gone), sum(r[0] == part and r[1] == {f} for r in rows), sum(r[2] for r in now), sum(r[3] for r in now)]
                gone += now
                shapley[part, f] += len(now)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def corpus(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(60):
        n = rnd.choice([0, 1, 5, 150, 199, 200, 201, 400])
        words = [rnd.choice(["a", "b", "Caps", "x#", "é", "UPPER"]) if rnd.random() < 0.4 else f"w{rnd.randrange(400)}" for _ in range(n)]
        rows.append((rnd.randrange(80), rnd.choice([" ", "\n", "\t "]).join(words), rnd.choice(["hot", "hot", "s", "", None])))
    rows += [(i, rnd.choice(rows)[1], rnd.choice(["hot", "t"])) for i in range(70, 110)]
    rows += [(None, rows[3][1], "s"), (None, None, None), (5, None, "hot"), (500, "", "hot"), (0, " \x0b\n ", "s"), (900, "word " * 30_000, "hot")]
    rows += rows[:5] + [rows[7]] * 3
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 120, 2)]
    return rows, labels + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_order_walked(spark, seed):
    rows, labels = corpus(seed)
    docs = spark.createDataFrame([(*r, "clash", True, False, 3) for r in rows], DOCS).repartition(5)
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, good string")
    got = audit.audit_documents(docs, marks)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == brute(rows, labels)
    assert got.count() == 600 * len({s or "" for _, _, s in rows})


def test_ranges_add_up(spark):
    """Parts and lists cut over many small ranges give the same sizes."""
    rows, labels = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        got = audit.audit_documents(docs, marks).collect()
    finally:
        spark.conf.set(name, before)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute(rows, labels)


def test_merges_of_posting_lists():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, rng.integers(1, 3000), rng.integers(0, 400))) for _ in "ab")
        assert audit.places(a, b).tolist() == np.searchsorted(b, a).tolist()
        assert audit.minus(a, b).tolist() == np.setdiff1d(a, b).tolist()
        assert audit.union(a, b).tolist() == np.union1d(a, b).tolist()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_documents(docs, marks).count() == 0
    some = spark.createDataFrame([(1, "one", "s")], docs.schema)
    assert {r.removed for r in audit.audit_documents(some, marks).where("filter_order = 'BACDE' AND step = 2").collect()} == {1}


def test_other_filters(spark):
    rows = spark.createDataFrame([("p", 1, True, None), ("p", 2, True, True), ("q", 3, False, True)], "part string, id int, x boolean, y boolean")
    got = audit.audit(rows, "part", "id", {"X": "x", "Y": "y"}, "x", "y")
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in got.collect()} == {
        ("p", "XY", 1): (0, 2, 0, 3), ("p", "XY", 2): (0, 0, 1, 1), ("p", "YX", 1): (1, 1, 0, 1), ("p", "YX", 2): (0, 1, 1, 3),
        ("q", "XY", 1): (1, 0, 0, 0), ("q", "XY", 2): (0, 1, 0, 2), ("q", "YX", 1): (0, 1, 0, 2), ("q", "YX", 2): (0, 0, 0, 0),
    }
    with pytest.raises(ValueError):
        audit.audit(rows, "part", "id", {}, "x", "y")
