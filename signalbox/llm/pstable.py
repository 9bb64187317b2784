"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosines and exact numbers of links.

A hash is floor((a . u + b) / width) of the normalised vector u, with a normal (2-stable) direction a:
close vectors mostly fall into the same step. Several hashes make the key of a table, several tables
the index; how many of each follows from the number of vectors, so that a bucket holds few vectors by
chance and a pair at the threshold is missed by all tables with a fixed small probability.

A group of copies can be of any size, so its pairs are not listed. Each bucket compares its vectors
with its first one; the linked ones have a common centre, and whatever lies within half the
threshold's angle of a centre is linked pair by pair (triangle inequality), which is counted without
looking at the pairs. Such a ball is one entry of its buckets from then on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from signalbox.llm.bytesops import U, mix
from signalbox.llm.graph import components
from signalbox.llm.staging import staged
from signalbox.llm.vectors import added, one_of_each, packed, sound, units

#: Steps of this width; so many vectors share a bucket by chance; a pair at the threshold is missed with this probability.
WIDTH, MATES, MISS = 2.0, 16, 1e-4
#: Signs of so many further projections go with each key.
SKETCH = 128
#: Angles are surer than this.
_SEED, _SLACK = 20240517, 1e-6


def collision(distance: float, width: float) -> float:
    """The probability that two vectors at a Euclidean distance share a step."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(n: int, cosine: float, width: float = WIDTH, mates: float = MATES, miss: float = MISS) -> tuple[int, int]:
    """(hashes of a table, tables) for `n` vectors: unrelated ones are taken to be at right angles."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    hashes = max(1, math.ceil(math.log(max(n / mates, 1)) / -math.log(far)))
    return hashes, max(1, math.ceil(math.log(miss) / math.log1p(-(near**hashes))))


def apart(cosine: float) -> int:
    """How many signs near vectors may differ in: pairs up to twice the threshold's angle apart (centres of balls; 0.95: 36.4
    degrees, 26 signs on average) differ in more with probability below 1e-4, vectors at right angles in 64."""
    p = min(0.5, 2 * math.acos(cosine) / math.pi)
    return math.ceil(SKETCH * p + 4 * math.sqrt(SKETCH * p * (1 - p)))


def _signs(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = np.random.default_rng(_SEED + 1).standard_normal((u.shape[1], SKETCH))
    words = np.packbits(u @ a > 0, axis=1).view("<i8")
    return words[:, 0].copy(), words[:, 1].copy()


def _keys(u: np.ndarray, hashes: int, tables: int, width: float) -> np.ndarray:
    """One 64-bit key per vector and table; the table's number is part of it."""
    rng = np.random.default_rng(_SEED)
    a = rng.standard_normal((u.shape[1], tables * hashes))
    b = np.random.default_rng(_SEED + 2).uniform(0, width, tables * hashes)
    keys = np.zeros((len(u), tables), np.uint64) + mix(np.arange(1, tables + 1, dtype=np.uint64))
    for start in range(0, len(u), 1024):
        some = slice(start, start + 1024)
        steps = np.floor((u[some] @ a + b) / width).astype(np.int64).reshape(-1, tables, hashes)
        for h in range(hashes):
            keys[some] = mix(keys[some] * U(0xD1342543DE82EF95) + steps[:, :, h].astype(np.uint64))
    return keys.view(np.int64)


def _hashed(batches: Iterator[pa.RecordBatch], dtype: str, dims: int, hashes: int, tables: int, width: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u = units(batch.column("v").to_pylist(), dtype, dims)
        s1, s2 = _signs(u)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * tables, pa.int32()), pa.array(_keys(u, hashes, tables, width).ravel()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n", "v")), keys, pa.array(s1), pa.array(s2)], ["id", "n", "v", "keys", "s1", "s2"])


def _linked(batches: Iterator[pa.RecordBatch], dtype: str, dims: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """The pairs that are linked, and for each lead of a batch the sum of the vectors linked to it."""
    for batch in batches:
        other = units(batch.column("v").to_pylist(), dtype, dims)
        cos = (units(batch.column("lead_v").to_pylist(), dtype, dims) * other).sum(axis=1)
        hit = np.flatnonzero(cos >= cosine)
        if not len(hit):
            continue
        lead, at = np.unique(batch.column("lead").to_numpy(zero_copy_only=False)[hit], return_inverse=True)
        sums = np.zeros((len(lead), dims))
        np.add.at(sums, at, other[hit])
        nothing = pa.nulls(len(hit), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(lead[at]), batch.column("id").take(pa.array(hit)), nothing], ["lead", "id", "total"])
        yield pa.RecordBatch.from_arrays([pa.array(lead), pa.nulls(len(lead), pa.int64()), pa.array([x.tobytes() for x in sums], pa.binary())], ["lead", "id", "total"])


def _angles(batches: Iterator[pa.RecordBatch], dtype: str, dims: int, most: float) -> Iterator[pa.RecordBatch]:
    """(lead, id, angle) of the vectors within an angle of a centre."""
    for batch in batches:
        cos = (units(batch.column("centre").to_pylist(), "<f8", dims) * units(batch.column("v").to_pylist(), dtype, dims)).sum(axis=1)
        angle = np.arccos(np.clip(cos, -1, 1))
        hit = pa.array(angle <= most)
        yield pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("id"), pa.array(angle)], ["lead", "id", "angle"]).filter(hit)


def _sketched(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s1, s2 = _signs(units(batch.column("centre").to_pylist(), "<f8", dims))
        yield pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("centre"), pa.array(s1), pa.array(s2)], ["ball", "centre", "b1", "b2"])


def _met(batches: Iterator[pa.RecordBatch], dtype: str, dims: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Pairs of balls of which all vectors are linked (every) or some can be; the others are dropped."""
    theta = math.acos(cosine)
    for batch in batches:
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        sides = []
        for s in "uv":
            centre, own = batch.column(f"centre_{s}").to_pylist(), batch.column(f"own_{s}").to_pylist()
            ball = np.array([x is not None for x in centre])
            u = np.empty((len(own), dims))
            if ball.any():
                u[ball] = units([x for x in centre if x is not None], "<f8", dims)
            if not ball.all():
                u[~ball] = units([x for x, b in zip(own, ball, strict=True) if not b], dtype, dims)
            sides.append(u)
        cos = (sides[0] * sides[1]).sum(axis=1)
        angle, reach = np.arccos(np.clip(cos, -1, 1)), column("r_u") + column("r_v")
        single = (column("size_u") == 1) & (column("size_v") == 1)
        every = np.where(single, cos >= cosine, angle + reach <= theta - _SLACK)
        some = np.where(single, every, angle - reach <= theta + _SLACK)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(every)], ["u", "v", "every"]).filter(pa.array(some))


def near_vectors(rows: DataFrame, cosine: float = 0.95, width: float = WIDTH, mates: float = MATES, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `rows` (vec_id, embedding).

    Two vectors are linked if their cosine, in double precision, is at least `cosine` and the index has found them: all
    tables miss a pair at the threshold with probability `miss`, a closer one more rarely. n_links counts other vectors linked
    directly, component_id is the smallest vec_id reachable, kept marks it. Steps:

    1. Equal vectors are one class, found with map-side aggregation. Each class gets one key per table and a sketch.
    2. In each bucket every class whose sketch is near enough is compared with the bucket's first class.
    3. The classes linked to a first one have a centre (summed up task by task); those within half the angle are a ball.
    4. Balls, and classes without a ball, that share a bucket and have near sketches are candidates: linked as a whole or not
       at all where centres and radii prove it, otherwise vector by vector.

    A vector that is null, empty, zero or holds a null or non-finite component has no links, its own component and is kept; with a
    null vec_id the component is null. Rows that repeat a vec_id are one vector, the smallest by its bytes standing for all, and
    get the same result. Missing components of a shorter vector count as zero. Other columns are not looked at, an
    empty table gives no rows. Vectors linked to each other but not to one centre (cosines to it below
    sqrt((1 + cosine) / 2)) are verified pair by pair, one row for each pair with near sketches.
    """
    if not 0 < cosine < 1:
        raise ValueError("a threshold between 0 and 1")
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    kind = plain.schema["v"].dataType
    dtype, element = ("<f4", "float") if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else ("<f8", "double")
    plain = plain.withColumn("v", F.col("v").cast(f"array<{element}>"))
    valid = plain.where(F.col("vec_id").isNotNull() & sound(F.col("v")) & F.exists("v", lambda x: x != 0))
    vectors = one_of_each(staged(packed(valid, dtype), "vectors"), "vec_id", "v")
    classes = staged(vectors.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    found = classes.select(F.count(F.lit(1)), F.max(F.length("v"))).first()
    hashes, tables = tables_for(found[0], cosine, width, mates, miss)
    dims = max(1, (found[1] or 0) // int(dtype[-1]))
    hashing = partial(_hashed, dtype=dtype, dims=dims, hashes=hashes, tables=tables, width=width)
    hashed = staged(classes.mapInArrow(hashing, "id long, n long, v binary, keys array<long>, s1 long, s2 long"), "hashed")
    of = hashed.select("id", "v")

    most = apart(cosine)
    near = lambda a, b: F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1]))) <= most
    entries = hashed.select("id", "s1", "s2", F.explode("keys").alias("key"))
    first = entries.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.min_by("s1", "id").alias("l1"), F.min_by("s2", "id").alias("l2"))
    first = staged(first.where("lead != last").drop("last"), "first_of_bucket")
    stars = entries.hint("merge").join(first, "key").where((F.col("id") != F.col("lead")) & near(("s1", "s2"), ("l1", "l2"))).select("lead", "id").distinct()
    stars = stars.hint("merge").join(of, "id").hint("merge").join(of.select(F.col("id").alias("lead"), F.col("v").alias("lead_v")), "lead")
    linked = staged(stars.mapInArrow(partial(_linked, dtype=dtype, dims=dims, cosine=cosine), "lead long, id long, total binary"), "linked")

    leads = linked.where("id IS NOT NULL").select("lead", "id")
    itself = leads.select("lead").distinct().select("lead", F.col("lead").alias("id"))
    centres = linked.where("total IS NOT NULL").groupBy("lead").applyInPandas(lambda g: added(g, "lead", "total"), "lead long, total binary")
    centres = staged(centres.select("lead", F.col("total").alias("centre")).mapInArrow(partial(_sketched, dims=dims), "ball long, centre binary, b1 long, b2 long"), "centres")
    by_centre = leads.union(itself).hint("merge").join(centres.select(F.col("ball").alias("lead"), "centre"), "lead").hint("merge").join(of, "id")
    half = math.acos(cosine) / 2 - _SLACK
    inside = by_centre.mapInArrow(partial(_angles, dtype=dtype, dims=dims, most=half), "lead long, id long, angle double")
    inside = staged(inside.groupBy("id").agg(F.min("lead").alias("lead"), F.min_by("angle", "lead").alias("angle")).join(hashed.select("id", "n"), "id"), "inside")
    # A ball goes by its smallest member: its lead need not lie in it.
    balls = inside.groupBy("lead").agg(F.min("id").alias("ball"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.max("angle").alias("r"))
    balls = staged(balls.where("size > 1"), "balls")
    members = inside.select("id", "lead").hint("merge").join(balls, "lead")
    placed = staged(
        hashed.select("id", "n").join(members, "id", "left").select(
            "id", "n", "lead", F.coalesce("ball", "id").alias("ball"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("weight", "n").alias("weight"), F.coalesce("r", F.lit(0.0)).alias("r")
        ),
        "placed",
    )

    centre_signs = centres.select(F.col("ball").alias("lead"), "b1", "b2")
    signed = placed.select("id", "lead", "ball").join(hashed.select("id", "keys", "s1", "s2"), "id").hint("merge").join(centre_signs, "lead", "left")
    signed = signed.select("ball", F.coalesce("b1", "s1").alias("s1"), F.coalesce("b2", "s2").alias("s2"), F.explode("keys").alias("key"))
    signed = staged(signed.distinct(), "ball_entries")
    other = signed.select(F.col("ball").alias("v"), "key", F.col("s1").alias("o1"), F.col("s2").alias("o2"))
    pairs = signed.hint("merge").join(other, "key").where((F.col("ball") < F.col("v")) & near(("s1", "s2"), ("o1", "o2"))).select(F.col("ball").alias("u"), "v").distinct()
    single = placed.where("size = 1").join(of, "id").select("ball", "size", "weight", "r", F.lit(None).cast("binary").alias("centre"), F.col("v").alias("own"))
    whole = balls.join(centres.select(F.col("ball").alias("lead"), "centre"), "lead").select("ball", "size", "weight", "r", "centre", F.lit(None).cast("binary").alias("own"))
    bodies = staged(single.union(whole), "ball_bodies")
    side = lambda s: bodies.select(F.col("ball").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("size", "r", "centre", "own")))
    met = pairs.hint("merge").join(side("u"), "u").hint("merge").join(side("v"), "v").select("u", "v", *(f"{c}_{s}" for s in "uv" for c in ("size", "r", "centre", "own")))
    met = staged(met.mapInArrow(partial(_met, dtype=dtype, dims=dims, cosine=cosine), "u long, v long, every boolean"), "met")

    every, rest = met.where("every").select("u", "v"), met.where("NOT every").select("u", "v")
    both = every.union(every.select(F.col("v").alias("u"), F.col("u").alias("v")))
    by_ball = both.join(bodies.select(F.col("ball").alias("v"), "weight"), "v").groupBy(F.col("u").alias("ball")).agg(F.sum("weight").alias("more"))
    left, right = (placed.select(F.col("ball").alias(b), F.col("id").alias(i)) for b, i in (("u", "lead"), ("v", "id")))
    checks = rest.hint("merge").join(left, "u").hint("merge").join(right, "v").select("lead", "id")
    checks = checks.hint("merge").join(of, "id").hint("merge").join(of.select(F.col("id").alias("lead"), F.col("v").alias("lead_v")), "lead")
    checked = checks.mapInArrow(partial(_linked, dtype=dtype, dims=dims, cosine=cosine), "lead long, id long, total binary")
    checked = staged(checked.where("id IS NOT NULL").select(F.col("lead").alias("u"), F.col("id").alias("v")), "checked")
    both = checked.union(checked.select(F.col("v").alias("u"), F.col("u").alias("v")))
    by_one = both.join(hashed.select(F.col("id").alias("v"), "n"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("ones"))

    copies = staged(vectors.join(classes.where("n > 1").select("v", "id"), "v").where("vec_id != id").select("vec_id", "id"), "copies")
    edges = placed.where("id != ball").select(F.col("id").alias("u"), F.col("ball").alias("v")).union(every).union(checked)
    whole = components(edges.union(copies.select(F.col("vec_id").alias("u"), F.col("id").alias("v"))))
    counts = placed.select("id", "ball", "weight").join(by_ball, "ball", "left").join(by_one, "id", "left")
    counts = staged(counts.select("id", (F.col("weight") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("ones", F.lit(0))).alias("n_links")), "counts")
    # Every row once more, also those whose vector took no part.
    out = plain.select("vec_id").join(copies, "vec_id", "left").withColumn("id", F.coalesce("id", "vec_id"))
    out = out.hint("merge").join(counts, "id", "left").hint("merge").join(whole, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM sound a, sound b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
counted AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.u LEFT JOIN counted ON e.vec_id = counted.u
"""
