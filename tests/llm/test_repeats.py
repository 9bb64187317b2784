import hashlib
import random

import numpy as np
import pytest

from signalbox.llm import repeats


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    rows = []
    for raw in raws:
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        rows.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return rows


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdeé \n") for _ in range(n))
    shared = [text(n) for n in (30, 60, 90, 300)]
    docs = [None, "", "a", "a" * 400, "ab" * 100]
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) // 2)
            parts += [text(rnd.randint(0, 50)), s[a : rnd.randint(a, len(s))]]
        docs.append("".join(parts))
    return docs + docs[10:20] * 3


@pytest.mark.parametrize("seed,hot", [(1, 10_000), (2, 10_000), (3, 1)])
def test_against_brute_force(spark, seed, hot):
    texts = corpus(seed)
    df = spark.createDataFrame([(i if i != 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, body string")
    rows = repeats.remove_repeats(df, length=40, gram=12, hot=hot).collect()
    want = brute(texts, 40)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert len(rows) == len(texts)
    assert got == {(i if i != 7 else None): w for i, w in enumerate(want)}


def test_longest_matches():
    rnd = random.Random(5)
    for n in (1, 2, 3, 50, 300):
        raw = bytes(rnd.choice(b"ab") for _ in range(n))
        want = [max([0] + [next((k for k in range(n) if i + k >= n or j + k >= n or raw[i + k] != raw[j + k]), n) for j in range(n) if j != i]) for i in range(n)]
        assert repeats.longest_matches(np.frombuffer(raw, np.uint8)).tolist() == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(df).count() == 0
