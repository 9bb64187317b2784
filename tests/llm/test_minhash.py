import random

import numpy as np
import pytest

import corpus_pipeline
from signalbox.llm import minhash
from signalbox.llm.bytesops import U, mix
from signalbox.llm.graph import components


def shingles(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((-1 if i is None else i, len(s), -1 if i is None else root(i), i is None or root(i) == i) for i, s in sets)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdéf") for _ in range(rnd.randint(1, 4)))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(8, 120))]
        for _ in range(rnd.randint(1, 14)):
            copy = list(base)
            for _ in range(rnd.randint(0, 5)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append(rnd.choice([" ", "\n", "\x0b "]).join(w.upper() if rnd.random() < 0.1 and w.isascii() else w for w in copy))
    rows += [None, "", " \n", "one", "One", "one two", "two one", "one two three four", "ONE two three four"]
    rows = [(7 * i + 3, t) for i, t in enumerate(rows)]
    return rows + rows[:3] + [(None, rows[0][1]), (rows[5][0], "a text of its own with the id of another row")]


@pytest.mark.parametrize("seed,dense", [(1, 32), (2, 2)])
def test_against_brute_force(spark, seed, dense, monkeypatch):
    monkeypatch.setattr(minhash, "DENSE", dense)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, u int")
    got = minhash.near_duplicates(df, k=4).collect()
    ours = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in got)
    assert ours == brute(rows, 4)
    kept = minhash.deduplicated(df, k=4)
    assert kept.columns == df.columns
    assert kept.count() == sum(r[3] for r in brute(rows, 4))


def test_signatures_equal_the_sequential_form():
    rng = np.random.default_rng(3)
    sizes, slots = np.array([5, 0, 1, 300]), 16
    h = rng.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64)
    got = minhash.signatures(h, sizes, slots, block=64)
    at = 0
    for row, n in zip(got, sizes):
        want = [int(minhash._FREE)] * slots
        for x in h[at : at + n]:
            p = list(range(slots))
            for j in range(slots):
                r = int(mix(np.array([x + U((j + 1) * minhash._STEP & 0xFFFFFFFFFFFFFFFF)], np.uint64))[0])
                k = j + ((r & 0xFFFFFFFF) * (slots - j) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], (j << 32) | (r >> 32))
        assert row.tolist() == want
        at += n


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randint(100, 400), rnd.randint(100, 400)) for _ in range(150)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    parent = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_a_repeated_id(spark):
    long = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(4)]
    rows = [(1, long[0], "a"), (1, long[0], "a"), (1, long[1], "b"), (2, long[2], "a"), (2, long[2], "a"), (3, long[2], "a")]
    rows += [(None, long[3], "a"), (None, long[3], "a"), (None, long[0], "a"), (None, None, "a"), (None, None, "a"), (4, None, "a"), (4, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    want = [rows[0], rows[3], rows[11], rows[6], rows[8], rows[9]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
