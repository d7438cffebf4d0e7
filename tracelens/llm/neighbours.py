"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order.  Every pivot has an inverted file of the vectors that
hold it and at which place, stored in parts by blocks of vectors, so that no file is unbounded.  Queries have
such files too: joined by pivot, the two give the footrule distances between a block of queries and a block of
vectors, and each query's best ranked vectors are compared by their true distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import persist, split_join

#: Pivots are drawn from a sample of at most PIVOTS * SAMPLE distinct vectors; every vector is indexed.
PIVOTS, SAMPLE, PREFIX = 512, 4, 128
#: Vectors and queries per block.
BLOCK, QUERY_BLOCK = 8_192, 1_024
#: Of a block of n vectors, n * SHARE + LEAST * (k + 1) are compared truly.
SHARE, LEAST = 0.125, 4

INDEX = "block long, pivot int, n int, a binary, b binary, c binary"


def valid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (doubles): without null or all-zero vectors and those with null, NaN or infinite components."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.coalesce(fine, F.lit(False)))


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """v, ids: every distinct vector with its k + 1 smallest ids; more of them can't be among k nearest.

    Spark limits the ranked rows per vector before the shuffle, so a vector that a third of all rows share
    sends k + 1 rows per task.
    """
    number = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(number)).filter(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def pick_pivots(sample: np.ndarray, pivots: int, seed: int = 7) -> np.ndarray:
    order = np.random.default_rng(seed).permutation(len(sample))
    return sample[order[:pivots]]


def nearest_pivots(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the ``prefix`` nearest pivots of every row, nearest first."""
    d = (pivots**2).sum(1)[None, :] - 2.0 * (v @ pivots.T)
    part = np.argpartition(d, prefix - 1, axis=1)[:, :prefix] if prefix < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(v), 1))
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)


def blocked(rows: DataFrame, column: str, pivots: np.ndarray, prefix: int, size: int) -> DataFrame:
    """The index of ``rows`` (v and the array of numbers ``column``) in blocks of about ``size``, dealt by hash: a
    row of pivot -1 with the block's vectors, how many numbers each has and the numbers, and a row per pivot
    with its inverted file, the rows that hold the pivot and its place in each."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, n = key[0].as_py(), table.num_rows
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        perms = nearest_pivots(v, pivots, prefix)
        flat = perms.ravel()
        order = np.argsort(flat, kind="stable")
        edges = np.searchsorted(flat[order], np.arange(len(pivots) + 1))
        owner, place = (order // prefix).astype("<u2"), (order % prefix).astype("<u2")
        numbers = table.column(column).combine_chunks()
        sizes, flat = np.diff(numbers.offsets.to_numpy()).astype("<u2"), numbers.flatten().to_numpy().astype("<i8")
        out = [(block, -1, n, v.astype("<f8").tobytes(), sizes.tobytes(), flat.tobytes())]
        out += [(block, p, n, owner[x:y].tobytes(), place[x:y].tobytes(), None) for p, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["block", "pivot", "n", "a", "b", "c"])

    blocks = max(1, -(-rows.count() // size))
    dealt = rows.select("v", column, F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("block"))
    return dealt.groupBy("block").applyInArrow(run, INDEX)


def footrule(queries: int, vectors: int, prefix: int, files) -> np.ndarray:
    """Footrule distances between a block of queries and a block of vectors, a pivot that is missing counting as
    place ``prefix``; ``files`` gives, pivot by pivot, query numbers and places, vector numbers and places.

    Every pair starts at the distance of sharing nothing; each shared pivot takes off what it costs when missing.
    """
    out = np.full((queries, vectors), prefix * (prefix + 1), np.int32)
    for q, at, x, place in files:
        place = place.astype(np.int32)[None, :]
        at = at.astype(np.int32)[:, None]
        out[q[:, None], x[None, :]] -= 2 * prefix - at - place - np.abs(at - place)
    return out


def rank(prefix: int, k: int, share: float, least: int):
    """applyInArrow over a block of queries and a block of vectors: each query's best ranked vectors."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        queries, vectors = table.column("qn")[0].as_py(), table.column("n")[0].as_py()
        files = [[np.frombuffer(x, "<u2") for x in row] for row in zip(*(table.column(c).to_pylist() for c in ("qa", "qb", "a", "b")))]
        most = min(vectors, int(np.ceil(vectors * share)) + least * (k + 1))
        best = np.empty((queries, most), "<u2")
        for low in range(0, queries, 128):
            high = min(low + 128, queries)
            part = []
            for q, at, x, place in files:
                i, j = np.searchsorted(q, [low, high])
                part.append((q[i:j] - low, at[i:j], x, place))
            ranks = footrule(high - low, vectors, prefix, part)
            best[low:high] = np.argpartition(ranks, most - 1, axis=1)[:, :most]
        return pa.table({"qblock": pa.array([key[0].as_py()]), "block": pa.array([key[1].as_py()]), "best": pa.array([best.tobytes()], pa.binary())})

    return run


def compare(k: int):
    """mapInArrow over ranked pairs of blocks with their vectors: each query's k + 1 nearest by true distance."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                queries = np.frombuffer(row["qa"], "<f8").reshape(row["qn"], -1)
                vectors = np.frombuffer(row["a"], "<f8").reshape(row["n"], -1)
                names, best = np.frombuffer(row["qc"], "<i8").tolist(), np.frombuffer(row["best"], "<u2").reshape(row["qn"], -1)
                sizes, ids = np.frombuffer(row["b"], "<u2").astype(np.int64), np.frombuffer(row["c"], "<i8")
                ends = np.cumsum(sizes)
                first = ids[ends - sizes]
                out = [[], [], []]
                for name, q, few in zip(names, queries, best.astype(np.int64)):
                    d = np.sqrt(((vectors[few] - q) ** 2).sum(1))
                    near = np.lexsort((first[few], d))[: k + 1]
                    for c in near.tolist():
                        x = few[c]
                        out[0].append(name)
                        out[1].append(ids[ends[x] - sizes[x] : ends[x]].tolist())
                        out[2].append(float(d[c]))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.float64())], names=["no", "ids", "score"])

    return run


def search(vectors: DataFrame, is_query, k: int = 10, pivots: int = PIVOTS, prefix: int = PREFIX, block: int = BLOCK, share: float = SHARE, least: int = LEAST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows where ``is_query`` (a Column over vec_id), their k nearest other rows.

    Nearness is the Euclidean distance in double precision, ties go to the smaller vec_id.  Vectors that are
    null, zero or hold null or non-finite components take no part, nor do those whose length differs from
    the most frequent one.  Copies of a vector are indexed once and keep their ids.  A table without valid
    vectors gives no rows.

    The index is a table in the shared folder.  Each block of queries meets each block of vectors, so work
    grows with queries times vectors: queries that are a fixed share of all rows ask for that.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vec_col)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == common["d"])
    classes = persist(distinct(rows, k), "vectors")
    asked = persist(rows.filter(is_query).groupBy("v").agg(F.count("*").alias("n")).select("v", F.monotonically_increasing_id().alias("no"), "n"), "queries")
    # the lowest hashes are a sample that no order of rows changes
    sample = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(pivots * SAMPLE)
    drawn = np.array([r.v for r in sample.collect()])
    chosen = pick_pivots(drawn, min(pivots, len(drawn)))
    length = min(prefix, len(chosen))

    files = persist(blocked(classes, "ids", chosen, length, block), "index")
    queries = persist(blocked(asked.select("v", F.array("no").alias("no")), "no", chosen, length, QUERY_BLOCK), "query-index")
    queries = queries.select(F.col("block").alias("qblock"), "pivot", F.col("n").alias("qn"), F.col("a").alias("qa"), F.col("b").alias("qb"), F.col("c").alias("qc"))
    met = queries.filter("pivot >= 0").drop("qc").join(files.filter("pivot >= 0").drop("c"), "pivot")
    ranked = persist(met.groupBy("qblock", "block").applyInArrow(rank(length, k, share, least), "qblock long, block long, best binary"), "ranked")
    pairs = ranked.join(queries.filter("pivot < 0").drop("pivot", "qb"), "qblock").join(files.filter("pivot < 0").drop("pivot"), "block")
    found = pairs.mapInArrow(compare(k), "no long, ids array<long>, score double")
    # a class holds up to k + 1 ids; of k + 1 classes at a distance the query's own id is one at most
    near = Window.partitionBy("no").orderBy("score", F.col("ids")[0])
    best = found.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1)
    # all queries of a class have the same candidates: at most (k + 1)**2 of them, in one row
    lists = best.groupBy("no").agg(F.collect_list(F.struct("score", "ids")).alias("c"))
    flat = F.sort_array(F.flatten(F.transform("c", lambda c: F.transform(c["ids"], lambda i: F.struct(c["score"].alias("score"), i.alias("vec_id"))))))
    lists = persist(lists.select("no", F.slice(flat, 1, k + 1).alias("c")), "candidates")
    owners = split_join(rows.filter(is_query), persist(asked.join(lists, "no").select("v", "n", "c"), "answers"), "v", "n")
    own = F.slice(F.filter("c", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    out = owners.select(F.col("vec_id").alias("query_id"), F.posexplode(own).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
