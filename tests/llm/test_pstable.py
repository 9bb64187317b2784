import math

import numpy as np
import pytest

from signalbox.llm import pstable, vectors

ROWS = "vec_id long, embedding array<float>, lead int, ball string, id long"


def brute(rows, cosine=0.95, dtype="<f4"):
    """vec_id -> (links, component), one vector for each id."""
    sound = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        raw = np.array(v, dtype).tobytes()
        if i not in sound or raw < sound[i]:
            sound[i] = raw
    ids = sorted(sound)
    x = np.zeros((len(ids), max([len(r) // int(dtype[-1]) for r in sound.values()], default=1)))
    for row, i in zip(x, ids, strict=True):
        v = np.frombuffer(sound[i], dtype).astype(float)
        row[: len(v)] = v / np.abs(v).max()
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= cosine
    parent = {i: i for i, _ in rows}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = dict.fromkeys(parent, 0)
    for a, i in enumerate(ids):
        links[i] = int(near[a].sum()) - 1
        for b in np.flatnonzero(near[a]):
            low, high = sorted((root(i), root(ids[b])))
            parent[high] = low
    return sorted((-1, 0, -1, True) if i is None else (i, links[i], root(i), root(i) == i) for i, _ in rows)


def table(seed, dims=24):
    rng = np.random.default_rng(seed)
    rows = [(1000 + i, v) for i, v in enumerate(rng.normal(size=(60, dims)))]
    at = 2000
    # Tight groups become balls; wide ones are linked, or nearly so, without a common centre.
    for size, spread in ((80, 0.04), (40, 0.10), (40, 0.17), (40, 0.23), (30, 0.3)):
        base = rng.normal(size=dims)
        base /= np.linalg.norm(base)
        for v in base + rng.normal(size=(size, dims)) * spread / math.sqrt(dims):
            rows.append((at, v * rng.uniform(0.01, 100)))
            at += int(rng.integers(1, 4))
    chain = rng.normal(size=(2, dims))
    chain[1] -= chain[0] * (chain[0] @ chain[1]) / (chain[0] @ chain[0])
    chain /= np.linalg.norm(chain, axis=1)[:, None]
    rows += [(int(3000 - i), math.cos(i * 0.2) * chain[0] + math.sin(i * 0.2) * chain[1]) for i in range(15)]
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in rows]
    rows += [(4000 + i, rows[3][1]) for i in range(30)] + [(7 + i, [2 * x for x in rows[3][1]]) for i in range(3)]
    rows += [rows[5]] * 4 + [(rows[6][0], rows[7][1]), (rows[100][0], rows[101][1])]
    tiny, huge = [1e-30] + [0.0] * (dims - 1), [3e38] + [1e38] * (dims - 1)
    rows += [(5000, tiny), (5001, [1.0]), (5002, huge), (5003, [1.0, None]), (5004, [float("nan")] * dims), (5005, [float("inf")] + [0.0] * (dims - 1))]
    rows += [(5006, None), (5007, []), (5008, [0.0] * dims), (None, rows[3][1]), (None, None), (5008, [0.0] * dims)]
    return rows


@pytest.mark.parametrize("seed,mates", [(1, 16), (2, 0.5)])
def test_against_brute_force(spark, seed, mates):
    rows = table(seed)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], ROWS).repartition(6)
    got = pstable.near_vectors(df, mates=mates, miss=1e-10)
    ours = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in got.collect())
    assert ours == brute(rows)
    assert sum(r[1] for r in ours) > 5000


def test_another_threshold_and_doubles(spark):
    rows = table(3, dims=10)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = pstable.near_vectors(df, cosine=0.9, miss=1e-10)
    ours = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in got.collect())
    assert ours == brute(rows, 0.9, "<f8")


def test_recall_of_the_index_grows_no_worse_with_size():
    """Hashes and tables of a larger corpus still catch pairs at the threshold."""
    rng = np.random.default_rng(9)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= a * (a * b).sum(axis=1, keepdims=True)
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b
    for n in (10**3, 10**5):
        hashes, tables = pstable.tables_for(n, 0.95, miss=1e-2)
        hit = (pstable._keys(a, hashes, tables, pstable.WIDTH) == pstable._keys(b, hashes, tables, pstable.WIDTH)).any(axis=1)
        assert hit.mean() > 0.975
    assert pstable.tables_for(10**9, 0.95)[0] > pstable.tables_for(10**5, 0.95)[0]
    far = sum(np.unpackbits(x[:, None].view("u1"), axis=1).sum(axis=1) for x in (s ^ t for s, t in zip(pstable._signs(a), pstable._signs(b), strict=True)))
    assert far.max() <= pstable.apart(0.95)


def test_collision_probability():
    rng = np.random.default_rng(2)
    for distance in (0.316, 1.414):
        x = rng.normal(size=200_000) * distance
        shift = rng.uniform(0, 2, x.size)
        assert abs((np.floor((x + shift) / 2) == 0).mean() - pstable.collision(distance, 2.0)) < 0.005


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pstable.near_vectors(empty).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [0.0])], empty.schema)
    assert sorted(map(tuple, pstable.near_vectors(nothing).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    with pytest.raises(ValueError):
        pstable.near_vectors(empty, cosine=1.0)


def test_one_of_each(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, "c", 1), (None, "d", 1), (None, "d", 1)], "k int, s string, n int")
    got = vectors.one_of_each(df, "k", "s", "n").where("k IS NOT NULL").collect()
    assert sorted(map(tuple, got)) == [(1, "a", 9), (2, "c", 1)]
