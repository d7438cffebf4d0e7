"""Time-varying curriculum: mix sources to target word counts along a schedule, in DataFrame operations only.

Each source has a target and a weight schedule over training time 0..1.  The schedule, integrated and scaled
to the target, is the source's cumulative demand; inverting it at the words that stand before a document
gives the document's position in training, and the mix is range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, persist, unused

#: Hex digits of the order that make a bucket: 3 give 4,096 buckets a source.
DIGITS = 3
#: Knots of the default schedules (time, relative weight), straight between them, dealt to the sources in turn.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)),
)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """doc_id, source, size in words (null text: 0), order (a hash of the id that any engine can repeat), row_col if given."""
    words = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE), lambda w: w != ""))
    # documents without an id are told apart by their texts
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.coalesce(F.col(text_col), F.lit("")))))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.cast("long").alias("size"), key.alias("order"), *_named(row_col))


def _named(row_col: str | None) -> list[str]:
    return [row_col] if row_col else []


def targets(per_source: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, ordinal, target: ``share`` of all sizes by weight, none above ``most`` of its source.

    Water filling in closed form: sources by (cap / weight); a source is full as long as the level that the
    rest would get reaches its cap.  The table has one row per source, the only rows that meet in one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.col("ordinal"), F.lit(len(weights))) + 1
    named = per_source.withColumn("ordinal", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    named = named.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "ordinal")
    everything = Window.partitionBy(F.lit(0))
    filled = (
        named.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
        # the level of the first source that isn't full holds for all after it
        .withColumn("open", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("ordinal"), F.col("level").alias("level")))).over(everything)["level"])
    )
    return filled.select("source", "source_size", "ordinal", F.when(F.col("full"), F.col("cap")).otherwise(F.col("open") * F.col("weight")).alias("target"))


def invert(schedule, demand: Column) -> Column:
    """The time at which the integral of a schedule, as a share of the whole, reaches ``demand`` (0..1)."""
    knots = [(float(t), float(w)) for t, w in schedule]
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, out, done = sum(areas), F.lit(knots[-1][0]), sum(areas)
    for (t0, w0), (t1, w1), area in reversed(list(zip(knots, knots[1:], areas))):
        done -= area
        need = demand * F.lit(whole) - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0)))
        span = F.lit(2.0) * need / (F.lit(w0) + root) if w0 or slope else F.lit(0.0)
        out = F.when(need < area, F.lit(t0) + F.greatest(span, F.lit(0.0))).otherwise(out)
    return out


def plan(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, schedules=SCHEDULES, digits: int = DIGITS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, positions.

    ``row_col``, a column that tells rows apart whose ids are null or the same, comes along where it is given.

    A source's documents stand in the order of a hash of their ids and are read again from the start until
    the target is met; a document is taken once for every reading in which its middle lies below the target,
    so no source misses its target by more than about half of its largest document, and none is taken more
    than ``most`` times.  Empty documents are never taken.  Equal rows keep the order of a second key.  Null
    sources are a source of their own; an empty table gives no rows.

    Words before a document come from sums per (source, bucket of the hash) plus a running sum inside the
    bucket, so a source with a third of all rows is spread over 16**``digits`` groups.
    """
    rows = persist(sizes(docs, id_col, text_col, source_col, row_col), "mix-sizes").withColumn("bucket", F.substring("order", 1, digits))
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("bucket_start"))
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    offsets = offsets.join(wanted.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", *_named(row_col)).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, placed["source"].eqNullSafe(F.col("_s")) & (placed["bucket"] == F.col("_b"))).withColumn("start", F.col("_in") + F.col("bucket_start"))
    reading = lambda k: F.col("start") + F.lit(k) * F.col("source_size")
    chosen = [(F.col("size") > 0) & (2 * reading(k) + F.col("size") < 2 * F.col("target")) for k in range(most)]
    copies = sum((c.cast("int") for c in chosen[1:]), chosen[0].cast("int"))

    def position(k: int) -> Column:
        at = F.least(reading(k) / F.col("target"), F.lit(1.0))
        turn = F.pmod(F.col("ordinal"), F.lit(len(schedules)))
        out = invert(schedules[-1], at)
        for j, s in enumerate(schedules[:-1]):
            out = F.when(turn == j, invert(s, at)).otherwise(out)
        return out

    positions = F.filter(F.array(*[F.when(c, position(k)) for k, c in enumerate(chosen)]), lambda p: p.isNotNull())
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), positions.alias("positions"), *_named(row_col))


def order(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", row_col: str | None = None, position_col: str | None = None) -> DataFrame:
    """The training order: rows of ``docs`` once per position, range-sorted by it, with their columns and the position,
    if it is given a name.

    Rows meet their positions by ``row_col``, which ``plan`` took along; without one ``docs`` must hold each id
    once and none may be null.  Documents that the mix doesn't take are left out.
    """
    own, position = unused(docs.columns, "_own", "_position")
    at = mixed.select(F.col(row_col or "doc_id").alias(own), F.explode("positions").alias(position))
    joined = docs.join(at, F.col(row_col or id_col).cast("long") == F.col(own))
    shown = [F.col(position).alias(position_col)] if position_col else []
    return joined.repartitionByRange(position, own).sortWithinPartitions(position, own).select(*docs.columns, *shown)


def taken(mixed: DataFrame, row_col: str) -> DataFrame:
    """The rows of a plan with what the training order holds of them: taken, positions (ascending); in the order of
    their first positions, those left out at the end."""
    rows = mixed.drop("copies", "taken", "positions")
    mix = order(rows.select(row_col, "size"), mixed, row_col=row_col, position_col="at")
    per_row = mix.groupBy(row_col).agg(F.sum("size").alias("taken"), F.sort_array(F.collect_list("at")).alias("positions"))
    out = rows.join(per_row, row_col, "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    first = F.get("positions", F.lit(0)).asc_nulls_last()
    return out.repartitionByRange(first, row_col).sortWithinPartitions(first, row_col)
