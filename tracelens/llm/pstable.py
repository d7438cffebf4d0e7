"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

A normalised vector's Gaussian projections, shifted at random and cut into steps, are a bucket of a table; close vectors
share one in some of many tables.  Before that, vectors close around one of them become a ball: any two within
half the angle of each other's centre are linked for certain, so a dense group is a few balls and is never
expanded into its pairs.  Balls post themselves in the buckets of all their vectors.  Balls that share a bucket meet
by centre and radius, and their vectors one by one only where that leaves the link open.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, persist, slices, split_join
from .simhash import components

COSINE = 0.95
#: A projection's step, the chance to miss a pair just at the threshold, chance meetings per vector over all tables.
STEP, MISS, CHANCE = 2.0, 0.001, 4.0
#: Rounds in which balls are gathered, projections of their tables, and what angles may be off by rounding.
ROUNDS, NARROW, SLACK = 3, 12, 1e-6
#: A bucket of more balls than this is dealt into blocks of as many, which meet two by two.
BLOCK = 256
SEED = 29


def collision(distance: float, step: float) -> float:
    """The chance that a projection puts two vectors at this distance in one step."""
    r = step / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def shape(n: int, cosine: float = COSINE, step: float = STEP, miss: float = MISS, chance: float = CHANCE) -> tuple[int, int]:
    """Projections of a table and number of tables: a pair at the threshold is missed with probability ``miss``, and
    unrelated vectors (at right angles) meet a vector ``chance`` times over all tables, whatever their number."""
    near, far = collision(math.sqrt(2 - 2 * cosine), step), collision(math.sqrt(2), step)
    width, tables = 1, 1
    for width in range(1, 200):
        tables = math.ceil(math.log(miss) / math.log1p(-(near**width)))
        if n * tables * far**width <= chance:
            break
    return width, tables


def buckets(unit: np.ndarray, seed: int, width: int, tables: int, step: float) -> np.ndarray:
    """A row of 64-bit bucket numbers per vector, one for each table."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    out = np.empty((len(unit), tables), np.uint64)
    places = mix64(np.arange(1, width + 1) + (seed << 20)) | np.uint64(1)
    for t in range(tables):
        cells = np.floor((unit @ rng.standard_normal((unit.shape[1], width)) + rng.uniform(0, step, width)) / step).astype(np.int64)
        out[:, t] = mix64((mix64(cells.view(np.uint64)) * places).sum(1, dtype=np.uint64) + np.uint64(unit.shape[1]))
    return out


def units(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of a batch by length: their places in it and themselves, normalised."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    out = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        v = flat[(ends[at] - d)[:, None] + np.arange(d)]
        v = v / np.abs(v).max(1, keepdims=True)
        out[d] = at, v / np.sqrt((v * v).sum(1, keepdims=True))
    return out


def hashed(rows: DataFrame, keep: list[str], seed: int, width: int, tables: int, step: float) -> DataFrame:
    """``keep`` of ``rows`` with keys: the bucket of the vector ``v`` in each table."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in slices(batches, 2_048):
            keys = np.zeros((batch.num_rows, tables), np.int64)
            for at, unit in units(batch.column("v")).values():
                keys[at] = buckets(unit, seed, width, tables, step).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, "keys"])

    return rows.select(*dict.fromkeys([*keep, "v"])).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", keys array<long>")


def compared(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` of ``pairs`` with the cosine of their vectors va and vb; those of unequal length are left out."""
    kinds = dict(pairs.dtypes)

    def run(batches):
        for batch in slices(batches, 4_096):
            a, b = units(batch.column("va")), units(batch.column("vb"))
            for d, (at, u) in a.items():
                own = batch.take(pa.array(at))
                cosine = (u * b[d][1]).sum(1)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keep), pa.array(cosine)], names=[*keep, "cosine"])

    same = pairs.filter("size(va) = size(vb)").select(*keep, "va", "vb")
    return same.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", cosine double")


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (doubles; null where the vector takes no part)."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, v).alias("v"))


def gathered(classes: DataFrame, angle: float, step: float) -> DataFrame:
    """node, ball: every class with the class at the centre of its ball, and the balls' radius; in each round the centres that are left are dealt
    by a narrow table, and those close enough to one of their bucket join it."""
    balls = classes.select(F.col("node").alias("ball"), F.lit(0.0).alias("radius"), "v")
    owner = classes.select("node", F.col("node").alias("ball"))
    for turn in range(ROUNDS):
        keyed = persist(hashed(balls, ["ball", "radius", "v"], SEED + 1 + turn, NARROW, 1, step).select("ball", "radius", "v", F.col("keys")[0].alias("key")), "narrow")
        lead = F.min_by(F.struct(F.col("ball").alias("lead"), F.col("v").alias("vb")), F.xxhash64("ball", F.lit(turn)))
        leads = keyed.groupBy("key").agg(lead.alias("l"), F.count("*").alias("c")).filter("c > 1").select("key", "c", "l.lead", "l.vb")
        met = split_join(keyed.withColumnRenamed("v", "va"), persist(leads, "leads"), "key", "c").filter("ball <> lead")
        reach = F.acos(F.least(F.col("cosine"), F.lit(1.0))) + F.col("radius")
        joined = compared(met, ["ball", "radius", "lead"]).withColumn("reach", reach).filter(F.col("reach") <= angle / 2 - SLACK)
        joined = persist(joined.select("ball", "lead", "reach"), "joined")
        grown = joined.groupBy(F.col("lead").alias("ball")).agg(F.max("reach").alias("reach"))
        balls = balls.join(joined.select("ball"), "ball", "left_anti").join(grown, "ball", "left")
        balls = persist(balls.select("ball", F.greatest("radius", F.coalesce("reach", F.lit(0.0))).alias("radius"), "v"), "balls")
        # a ball that joins takes all its classes along: of a few balls, however many classes they have
        sizes = owner.groupBy("ball").agg(F.count("*").alias("c")).join(joined.select("ball", "lead"), "ball", "left")
        owner = split_join(owner, persist(sizes, "sizes"), "ball", "c").select("node", F.coalesce("lead", "ball").alias("ball"))
        owner = persist(owner, "owner")
    return owner.join(balls.select("ball", "radius"), "ball"), balls


def met_in_blocks(reach: float):
    """applyInArrow over the balls of two blocks of a bucket: a, b of those whose vectors may link."""

    def run(table: pa.Table) -> pa.Table:
        names, radius = table.column("ball").to_numpy(), table.column("radius").to_numpy()
        side = table.column("side").to_numpy()
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at, unit in units(table.column("v").combine_chunks()).values():
            # a block that meets itself has side 2
            left, right = np.flatnonzero(side[at] != 1), np.flatnonzero(side[at] != 0)
            far = np.cos(np.minimum(reach + radius[at][left][:, None] + radius[at][right][None, :] + SLACK, np.pi))
            i, j = np.nonzero(unit[left] @ unit[right].T >= far)
            a, b = names[at][left[i]], names[at][right[j]]
            out[0].append(np.minimum(a, b)[a != b])
            out[1].append(np.maximum(a, b)[a != b])
        return pa.table({"a": np.concatenate(out[0]), "b": np.concatenate(out[1])})

    return run


def candidates(members: DataFrame, balls: DataFrame, width: int, tables: int, angle: float, step: float, block: int) -> DataFrame:
    """a, b (a < b): balls that share a bucket in a table, every pair once."""
    keyed = hashed(members, ["ball"], SEED, width, tables, step).select("ball", F.posexplode("keys").alias("t", "key"))
    posts = persist(keyed.select("ball", F.xxhash64("t", "key").alias("key")).distinct(), "posts")
    counted = persist(posts.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "buckets")
    shared = persist(split_join(posts, counted.withColumn("blocks", F.ceil(F.col("c") / block).cast("long")), "key", "c"), "shared")
    small = shared.filter("blocks = 1").select("key", "ball")
    pairs = small.select("key", F.col("ball").alias("a")).join(small.select("key", F.col("ball").alias("b")), "key").filter("a < b").select("a", "b")
    own, other = F.pmod(F.xxhash64("ball"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    large = shared.filter("blocks > 1").select("key", "ball", own.alias("own"), other.alias("other")).join(balls.hint("merge"), "ball")
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    large = large.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "ball", "radius", "v")
    return pairs.unionByName(large.groupBy("key", "i", "j").applyInArrow(met_in_blocks(angle), "a long, b long")).distinct()


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, step: float = STEP, miss: float = MISS, chance: float = CHANCE, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    Vectors link at a cosine of at least ``cosine`` in double precision; a pair just there is missed with probability
    ``miss``, closer ones less often, and what is found is checked.  n_links counts the other rows linked to a row, component_id is
    the least vec_id reachable, kept whether that is the row's own.  Vectors that are null, empty, all zero
    or hold null or non-finite components link with nothing; nor do vectors of unequal length.  Rows of one id are rows each, a null
    id is less than no other and stays null if it is alone.  An empty table gives no rows.

    Equal vectors are one class and classes close together a ball; both are counted by their sizes.  The number
    of tables grows with a power of the rows below a quarter (``shape``); what meets is about ``chance`` pairs a row.
    """
    angle = math.acos(cosine)
    rows = valid(vectors, id_col, vec_col)
    classes = rows.filter("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = persist(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    owner, balls = gathered(classes, angle, step)
    members = persist(classes.hint("merge").join(owner, "node").select("node", "ball", "radius", "n", "least", "v"), "members")
    totals = members.groupBy("ball").agg(F.sum("n").alias("total"), F.min("least").alias("least"))
    balls = persist(balls.join(totals, "ball"), "balls")
    width, tables = shape(max(classes.count(), 2), cosine, step, miss, chance)
    pairs = candidates(members.select("ball", "v"), balls.select("ball", "radius", "v"), width, tables, angle, step, block)

    def side(name: str) -> DataFrame:
        # tables of vectors are merged: sent whole, they would stay with every executor until the driver's memory is cleaned
        return balls.select(F.col("ball").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("radius", "total")], F.col("v").alias(f"v{name}")).hint("merge")

    met = compared(pairs.join(side("a"), "a").join(side("b"), "b"), ["a", "b", "radius_a", "radius_b", "total_a", "total_b"])
    apart, reach = F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0))), F.col("radius_a") + F.col("radius_b")
    sure = F.when(reach == 0, F.col("cosine") >= cosine).otherwise(apart + reach <= angle - SLACK)
    far = F.when(reach == 0, F.col("cosine") < cosine).otherwise(apart - reach > angle + SLACK)
    met = persist(met.select("*", sure.alias("sure"), far.alias("far")).filter("not far"), "met")
    whole = met.filter("sure")
    # where a ball lies across the threshold, its vectors are held against the other ball, then against its vectors
    own = members.select("node", "n", F.col("v").alias("va"), F.col("ball").alias("a")).hint("merge")
    half = met.filter("not sure").select("a", "b", "radius_b", "total_b").join(own, "a").join(side("b").select("b", "vb"), "b")
    half = compared(half, ["a", "b", "node", "n", "radius_b", "total_b"]).select("*", (apart + F.col("radius_b") <= angle - SLACK).alias("sure"), (apart - F.col("radius_b") > angle + SLACK).alias("far"))
    half = persist(half.filter("not far"), "half")
    theirs = members.select(F.col("node").alias("node_b"), F.col("n").alias("n_b"), F.col("v").alias("vb"), F.col("ball").alias("b")).hint("merge")
    single = half.filter("not sure").select("a", "b", "node", "n").join(theirs, "b").join(own.select("node", "va").hint("merge"), "node")
    single = persist(compared(single, ["a", "b", "node", "n", "node_b", "n_b"]).filter(F.col("cosine") >= cosine), "single")
    split = half.filter("sure")

    pick = lambda df, k, n: df.select(F.col(k).alias("k"), F.col(n).alias("more"))
    to_balls = pick(whole, "a", "total_b").unionByName(pick(whole, "b", "total_a")).unionByName(pick(split, "b", "n"))
    to_nodes = pick(split, "node", "total_b").unionByName(pick(single, "node", "n_b")).unionByName(pick(single, "node_b", "n"))
    by_ball, by_node = (df.groupBy(F.col("k").alias(k)).agg(F.sum("more").alias(f"{k}_more")) for df, k in ((to_balls, "ball"), (to_nodes, "node")))
    edges = whole.select("a", "b").unionByName(split.select("a", "b")).unionByName(single.select("a", "b"))
    rooted = components(edges)
    placed = balls.select("ball", "total", "least").join(rooted, F.col("ball") == F.col("node"), "left").select("ball", "total", "least", F.coalesce("root", "ball").alias("root"))
    heads = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    per_ball = persist(placed.join(heads, "root").join(by_ball, "ball", "left").select("ball", "component_id", (F.col("total") - 1 + F.coalesce("ball_more", F.lit(0))).alias("links")), "answers")
    found = members.select("v", "n", "node", "ball").hint("merge").join(per_ball, "ball").join(by_node, "node", "left")
    found = persist(found.select("v", "n", (F.col("links") + F.coalesce("node_more", F.lit(0))).alias("n_links"), "component_id"), "found")
    linked = split_join(rows.filter("v is not null"), found, "v", "n").select("vec_id", "n_links", "component_id")
    alone = rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
