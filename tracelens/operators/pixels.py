"""Pixel columns: which groups and points fall into which column, and the columns' statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket, overlaps, pixel_id


def columns(measures: DataFrame, start: int, step: int, width: int) -> DataFrame:
    """measure, i, px_from, px_to of all columns."""
    grid = measures.select("measure", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i"))
    return grid.select("measure", "i", (F.lit(start) + F.col("i").cast("long") * step).alias("px_from"), (F.lit(start) + (F.col("i").cast("long") + 1) * step).alias("px_to"))


def assign(groups: DataFrame, start: int, step: int, width: int) -> DataFrame:
    """Groups with every column they overlap, by index arithmetic: an equi-join later, never a range join."""
    end = start + step * width
    inside = groups.filter((F.col("g_to") > start) & (F.col("g_from") < end))
    first = F.greatest(bucket(F.greatest(F.col("g_from"), F.lit(start)), start, step), F.lit(0))
    last = F.least(bucket(F.least(F.col("g_to"), F.lit(end)) - 1, start, step), F.lit(width - 1))
    spread = inside.withColumn("i", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    at = F.lit(start) + F.col("i").cast("long") * step
    return spread.withColumn("px_from", at).withColumn("px_to", at + step)


def accepted(assigned: DataFrame) -> DataFrame:
    """Extreme points whose time lies in the column they were assigned to: measure, i, t, v."""
    both = F.array(F.struct(F.col("min_t").alias("t"), F.col("min_v").alias("v")), F.struct(F.col("max_t").alias("t"), F.col("max_v").alias("v")))
    rows = assigned.select("measure", "i", "px_from", "px_to", F.explode(both).alias("p"))
    return rows.filter((F.col("p.t") >= F.col("px_from")) & (F.col("p.t") < F.col("px_to"))).select("measure", "i", "p.t", "p.v")


def stats(points: DataFrame) -> DataFrame:
    """First, last, min and max of the accepted points per column."""
    first, last = F.min(F.struct("t", "v")), F.max(F.struct("t", "v"))
    return points.groupBy("measure", "i").agg(F.min("v").alias("min_v"), F.max("v").alias("max_v"), first["t"].alias("first_t"), first["v"].alias("first_v"), last["t"].alias("last_t"), last["v"].alias("last_v"))


def contained(assigned: DataFrame) -> DataFrame:
    """Min and max of the groups that lie wholly inside their column."""
    inside = assigned.filter("px_from <= g_from and g_to <= px_to")
    return inside.groupBy("measure", "i").agg(F.min("min_v").alias("enc_min"), F.max("max_v").alias("enc_max"), F.min("g_from").alias("enc_from"), F.max("g_to").alias("enc_to"), F.count("*").alias("n_groups"))


def partials(assigned: DataFrame, remainders: DataFrame) -> DataFrame:
    """Shortest groups that cover the left and right remainder of a column: left from px_from to left_end, right
    from right_start to px_to; ties go to the earlier group."""
    rows = assigned.join(remainders, ["measure", "i"])
    key = F.struct(F.col("g_to") - F.col("g_from"), F.col("g_from"))
    left = (F.col("g_from") <= F.col("px_from")) & (F.col("g_to") >= F.col("left_end")) & (F.col("left_end") > F.col("px_from"))
    right = (F.col("g_to") >= F.col("px_to")) & (F.col("g_from") <= F.col("right_start")) & (F.col("right_start") < F.col("px_to"))
    pick = lambda on: F.min(F.when(on, F.struct(key.alias("key"), F.col("min_v").alias("min_v"), F.col("max_v").alias("max_v"))))
    out = rows.groupBy("measure", "i").agg(pick(left).alias("l"), pick(right).alias("r"))
    return out.select("measure", "i", F.col("l.min_v").alias("left_min"), F.col("l.max_v").alias("left_max"), F.col("r.min_v").alias("right_min"), F.col("r.max_v").alias("right_max"))


def boundary(assigned: DataFrame) -> DataFrame:
    """Earliest group that starts at or before a column and earliest that ends at or after it."""
    key = F.struct("g_from", "g_to", "min_v", "max_v")
    out = assigned.groupBy("measure", "i").agg(F.min(F.when(F.col("g_from") <= F.col("px_from"), key)).alias("a"), F.min(F.when(F.col("g_to") >= F.col("px_to"), key)).alias("b"))
    return out.select("measure", "i", F.col("a.min_v").alias("a_min"), F.col("a.max_v").alias("a_max"), F.col("b.min_v").alias("b_min"), F.col("b.max_v").alias("b_max"))


def with_view(column_stats: DataFrame) -> DataFrame:
    """Adds the measure's scale: view_min and view_max over all columns."""
    everywhere = Window.partitionBy("measure")
    return column_stats.withColumn("view_min", F.min("min_v").over(everywhere)).withColumn("view_max", F.max("max_v").over(everywhere))


def with_pixels(column_stats: DataFrame, height: int) -> DataFrame:
    """Pixel rows of the columns' points on their measure's scale."""
    out = with_view(column_stats)
    for c in ("min", "max", "first", "last"):
        out = out.withColumn(f"{c}_px", pixel_id(F.col(f"{c}_v"), F.col("view_min"), F.col("view_max"), height))
    return out
