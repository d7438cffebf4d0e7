"""Downsampling: raw ranges, min/max, M4, slope and full statistics per time bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bucket
from ..model import Interval


#: More intervals than this are a table that points are joined with, not conditions in the plan.
CONDITIONS = 32


def raw_multi(series: DataFrame, asked: Sequence[tuple[str, Interval]]) -> DataFrame:
    """Points per asked (measure, interval), tagged by its number u_id: one scan, no union of scans.

    A point in two asked intervals is returned for both.
    """
    if len(asked) > CONDITIONS:
        cells, width = interval_cells(series, [(k, m, x) for k, (m, x) in enumerate(asked)])
        met = series.withColumn("_cell", F.floor(F.col("t") / width)).join(cells, ["measure", "_cell"])
        return met.filter("t >= s_from and t < s_to").select("u_id", "measure", "t", "v")
    tags = F.array(*[F.when((F.col("measure") == m) & (F.col("t") >= x.start) & (F.col("t") < x.end), F.lit(k)) for k, (m, x) in enumerate(asked)])
    return series.select(F.explode(F.array_compact(tags)).alias("u_id"), "measure", "t", "v")


def within_any(series: DataFrame, some: Sequence[Interval]) -> DataFrame:
    """Points in any of many disjoint intervals."""
    cells, width = interval_cells(series, [(k, "", x) for k, x in enumerate(some)])
    cells = cells.select(F.col("_cell").alias("_at"), "s_from", "s_to")
    return series.join(cells, (F.floor(F.col("t") / width) == F.col("_at")) & (F.col("t") >= F.col("s_from")) & (F.col("t") < F.col("s_to")), "left_semi")


def interval_cells(series: DataFrame, asked: Sequence[tuple[int, str, Interval]]) -> tuple[DataFrame, int]:
    """u_id, measure, s_from, s_to, _cell of intervals in every time cell that they reach, and the cells' width: the mean
    length, so that there are about two cells an interval."""
    width = max(1, sum(len(x) for _, _, x in asked) // len(asked))
    table = series.sparkSession.createDataFrame([(k, m, x.start, x.end) for k, m, x in asked if len(x)], "u_id int, measure string, s_from long, s_to long")
    return table.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("s_from") / width), F.floor((F.col("s_to") - 1) / width)))), width


def in_range(series: DataFrame, start: int, width: int, count: int) -> DataFrame:
    """Points in ``count`` buckets of ``width`` from ``start``, with their bucket k; the tail beyond is dropped."""
    inside = series.filter((F.col("t") >= start) & (F.col("t") < start + width * count))
    return inside.withColumn("k", bucket(F.col("t"), start, width))


def bounds(start: int, width: int, end: int) -> list[Column]:
    """g_from and g_to of bucket k, the last one clipped to ``end``."""
    return [(F.lit(start) + F.col("k") * width).alias("g_from"), F.least(F.lit(start) + (F.col("k") + 1) * width, F.lit(end)).alias("g_to")]


def min_max(series: DataFrame, within: Interval, width: int) -> DataFrame:
    """Count, sum, min and max per (measure, bucket) over [start, end): one hash aggregation, combined before its shuffle."""
    inside = series.filter((F.col("t") >= within.start) & (F.col("t") < within.end)).withColumn("k", bucket(F.col("t"), within.start, width))
    groups = inside.groupBy("measure", "k").agg(F.count("*").alias("cnt"), F.sum("v").alias("sum_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))
    return groups.select("measure", "k", *bounds(within.start, width, within.end), "cnt", "sum_v", "min_v", "max_v")


def part_groups(points: DataFrame, parts: Sequence[tuple[str, Interval]], width: int) -> DataFrame:
    """Min/max groups of each (measure, interval), on a grid from its start, tagged by its number u_id."""
    ends = points.sparkSession.createDataFrame([(k, x.start, x.end) for k, (_, x) in enumerate(parts)], "u_id int, s long, e long")
    keyed = raw_multi(points, parts).join(ends, "u_id").withColumn("k", F.call_function("div", F.col("t") - F.col("s"), F.lit(width)))
    groups = keyed.groupBy("u_id", "measure", "s", "e", "k").agg(F.count("*").alias("cnt"), F.sum("v").alias("sum_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))
    return groups.select("u_id", "measure", (F.col("s") + F.col("k") * width).alias("g_from"), F.least(F.col("s") + (F.col("k") + 1) * width, F.col("e")).alias("g_to"), "cnt", "sum_v", "min_v", "max_v")


def dense(groups: DataFrame, measures: DataFrame, within: Interval, width: int) -> DataFrame:
    """All buckets of every measure; empty ones have count 0 and nulls."""
    count = -(-len(within) // width)
    grid = measures.select("measure", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("k"))
    joined = grid.join(groups.drop("g_from", "g_to"), ["measure", "k"], "left")
    return joined.select("measure", "k", *bounds(within.start, width, within.end), F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"), "min_v", "max_v")


def synthesise(groups: DataFrame) -> DataFrame:
    """Timestamps that min/max groups don't have: extremes at the middle, first and last (min + max) / 2 at the ends."""
    middle = F.call_function("div", F.col("g_from") + F.col("g_to"), F.lit(2))
    value = (F.col("min_v") + F.col("max_v")) / 2
    return groups.select("*", middle.alias("min_t"), middle.alias("max_t"), value.alias("first_v"), (F.col("g_from") + 1).alias("first_t"), value.alias("last_v"), (F.col("g_to") - 1).alias("last_t"))


def _m4() -> list[Column]:
    first, last = F.min(F.struct("t", "v")), F.max(F.struct("t", "v"))
    low, high = F.min(F.struct(F.col("v"), (-F.col("t")).alias("t"))), F.max(F.struct("v", "t"))
    return [
        first["v"].alias("first_v"), first["t"].alias("first_t"), last["v"].alias("last_v"), last["t"].alias("last_t"),
        low["v"].alias("min_v"), (-low["t"]).alias("min_t"), high["v"].alias("max_v"), high["t"].alias("max_t"),
    ]


def m4(series: DataFrame, start: int, width: int, count: int) -> DataFrame:
    """First, last, min and max point per (measure, bucket) in one pass.

    Ties: first is the lowest (t, v), last the highest; min and max are at the latest time that attains them.
    """
    return in_range(series, start, width, count).groupBy("measure", "k").agg(F.count("*").alias("cnt"), *_m4())


def m4_hashed(series: DataFrame, start: int, width: int, count: int) -> DataFrame:
    """``m4`` by two hash aggregations: extremes first, then the points that attain them.

    Structs can't be kept in hash aggregation's buffers, so ``m4`` sorts its input; here the extremes, at most
    ``count`` rows a measure, meet the points again.  Worth it when scanning twice is cheaper than a sort.
    """
    rows = in_range(series, start, width, count)
    ends = rows.groupBy("measure", "k").agg(F.count("*").alias("cnt"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))
    at = rows.join(ends, ["measure", "k"]).filter("v = min_v or v = max_v or t = first_t or t = last_t")
    pick = lambda agg, what, on: agg(F.when(on, F.col(what)))
    return at.groupBy("measure", "k").agg(
        F.first("cnt").alias("cnt"),
        pick(F.min, "v", F.col("t") == F.col("first_t")).alias("first_v"), F.first("first_t").alias("first_t"),
        pick(F.max, "v", F.col("t") == F.col("last_t")).alias("last_v"), F.first("last_t").alias("last_t"),
        F.first("min_v").alias("min_v"), pick(F.max, "t", F.col("v") == F.col("min_v")).alias("min_t"),
        F.first("max_v").alias("max_v"), pick(F.max, "t", F.col("v") == F.col("max_v")).alias("max_t"),
    )


def extreme_points(series: DataFrame, start: int, width: int, count: int) -> DataFrame:
    """The join form: per (measure, bucket, extreme value) the first and last time of points that attain an
    extreme of value or time."""
    rows = in_range(series, start, width, count)
    ends = rows.groupBy("measure", "k").agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    at = rows.join(ends, ["measure", "k"]).filter("v = v_min or v = v_max or t = t_min or t = t_max")
    return at.groupBy("measure", "k", "v").agg(F.min("t").alias("first_at"), F.max("t").alias("last_at"))


def points(groups: DataFrame) -> DataFrame:
    """Four points per bucket: first, min, max, last."""
    role = lambda k, name: F.struct(F.lit(k).alias("role"), F.col(f"{name}_t").alias("t"), F.col(f"{name}_v").alias("v"))
    return groups.select("measure", "k", F.explode(F.array(*[role(k, n) for k, n in enumerate(("first", "min", "max", "last"))])).alias("p")).select("measure", "k", "p.role", "p.t", "p.v")


def slope(series: DataFrame, start: int, width: int, count: int) -> DataFrame:
    """First and last point per bucket and the slope between them per second; null for a single time."""
    ends = in_range(series, start, width, count).groupBy("measure", "k").agg(F.min(F.struct("t", "v")).alias("a"), F.max(F.struct("t", "v")).alias("b"))
    rise = F.try_divide((F.col("b.v") - F.col("a.v")) * 1000, (F.col("b.t") - F.col("a.t")).cast("double"))
    return ends.select("measure", "k", F.col("a.t").alias("first_t"), F.col("a.v").alias("first_v"), F.col("b.t").alias("last_t"), F.col("b.v").alias("last_v"), rise.alias("slope"))


def full_stats(series: DataFrame) -> DataFrame:
    """All statistics of every measure."""
    return series.groupBy("measure").agg(F.count("*").alias("cnt"), F.sum("v").alias("sum_v"), F.avg("v").alias("avg_v"), *_m4())


def roll_up(groups: DataFrame, factor: int) -> DataFrame:
    """Groups of ``factor`` buckets from full groups of one: what ``m4`` over wider buckets would give."""
    wide = groups.withColumn("k", F.call_function("div", F.col("k"), F.lit(factor)))
    first, last = F.min(F.struct("first_t", "first_v")), F.max(F.struct("last_t", "last_v"))
    low, high = F.min(F.struct(F.col("min_v"), (-F.col("min_t")).alias("t"))), F.max(F.struct("max_v", "max_t"))
    return wide.groupBy("measure", "k").agg(
        F.sum("cnt").alias("cnt"), first["first_v"].alias("first_v"), first["first_t"].alias("first_t"), last["last_v"].alias("last_v"), last["last_t"].alias("last_t"),
        low["min_v"].alias("min_v"), (-low["t"]).alias("min_t"), high["max_v"].alias("max_v"), high["max_t"].alias("max_t"),
    )
