"""A bound on the pixels that cached groups may draw wrong, per column and in total."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pixels


def span_islands(cols: DataFrame, spans: DataFrame, start: int, step: int, width: int) -> DataFrame:
    """Per column, what whole groups of the spans lie in it: number of islands, their hull, and how far spans reach.

    A span's groups stand on a grid from its start, its last one clipped; raw spans (agg -1) count as groups
    of no width, so that their part of a column is enclosed.  The columns are the cells of an interval index: a span
    is posted to those it overlaps, so a column holds its own spans only, however many the measure has.
    """
    posted = pixels.assign(spans.withColumnsRenamed({"s_from": "g_from", "s_to": "g_to"}), start, step, width)
    lists = posted.groupBy("measure", "i").agg(F.sort_array(F.collect_list(F.struct(F.col("g_from").alias("s_from"), F.col("g_to").alias("s_to"), "agg"))).alias("_s"))
    grid = "greatest(s.agg, 1L)"
    low = f"s.s_from + ceil(greatest(px_from - s.s_from, 0L) / {grid}) * {grid}"
    high = f"case when px_to >= s.s_to then s.s_to else s.s_from + floor((px_to - s.s_from) / {grid}) * {grid} end"

    def fold(start: str, end: str) -> str:
        """Number and hull of the islands of one range per span."""
        ranges = f"sort_array(filter(transform(_s, s -> named_struct('f', {start}, 't', {end})), r -> r.f < r.t))"
        none = "named_struct('n', 0, 'f', cast(null as bigint), 't', cast(null as bigint))"
        return f"aggregate({ranges}, {none}, (x, r) -> named_struct('n', x.n + case when x.t is null or r.f > x.t then 1 else 0 end, 'f', coalesce(x.f, r.f), 't', greatest(x.t, r.t)))"

    joined = cols.join(lists, ["measure", "i"], "left").withColumn("_s", F.expr("coalesce(_s, cast(array() as array<struct<s_from:bigint,s_to:bigint,agg:bigint>>))"))
    own = ["measure", "i", "px_from", "px_to"]
    made = {
        "whole": fold(f"cast({low} as bigint)", f"least(cast({high} as bigint), px_to)"),
        "reach": fold("greatest(s.s_from, px_from)", "least(s.s_to, px_to)"),
        "exact": "exists(_s, s -> s.agg < 0 and s.s_from <= px_from and s.s_to >= px_to)",
    }
    flat = {"islands": "whole.n", "isl_from": "whole.f", "isl_to": "whole.t", "covered": "reach.n = 1 and reach.f = px_from and reach.t = px_to"}
    return _select(_select(joined, own, made), [*own, "exact"], flat)


def _ends(name: str, low: str, high: str, height: int, on: str = "true") -> dict[str, str]:
    """The pixel rows from one to another, in either order, as {name}_l and {name}_h; none, from ``height`` to -1, where one is null."""
    there = f"{on} and {low} is not null and {high} is not null"
    return {f"{name}_l": f"case when {there} then least({low}, {high}) else {height} end", f"{name}_h": f"case when {there} then greatest({low}, {high}) else -1 end"}


def _union_outside(names: list[str], low: str, high: str) -> str:
    """How many pixel rows below ``low`` or above ``high`` lie in any of a few ranges: those, clipped and in order, are
    counted from where the ones before end.  A ``low`` and ``high`` of the chart's height leave all."""
    clipped = [f"named_struct('l', {n}_l, 'h', least({n}_h, {low} - 1)), named_struct('l', greatest({n}_l, {high} + 1), 'h', {n}_h)" for n in names]
    return f"aggregate(array_sort(array({', '.join(clipped)})), named_struct('n', 0, 'at', -1), (x, r) -> named_struct('n', x.n + greatest(0, r.h - greatest(r.l - 1, x.at)), 'at', greatest(x.at, r.h)), x -> x.n)"


def _px(v: str, height: int) -> str:
    """As ``pixel_id``, null for null."""
    return f"case when {v} is not null then greatest(0, least({height - 1}, cast(coalesce(try_divide({height - 1} * ({v} - view_min), view_max - view_min), 0D) as int))) end"


def _line(t0: str, v0: str, t1: str, v1: str, at: str) -> str:
    """As ``on_line``."""
    return f"least(greatest({v0} + coalesce(try_divide({v1} - {v0}, cast({t1} - {t0} as double)), 0D) * ({at} - {t0}), view_min), view_max)"


def _select(df: DataFrame, keep: list[str], made: dict[str, str]) -> DataFrame:
    """One projection of parsed expressions: a plan this wide is slow to build from single columns."""
    return df.selectExpr(*keep, *[f"{e} as {n}" for n, e in made.items()])


def column_cells(cols: DataFrame, groups: DataFrame, raw: DataFrame | None, start: int, step: int, width: int) -> DataFrame:
    """``cols`` with all that their groups and points tell, in one join and one aggregation: min_v, max_v, first
    and last accepted point, enc_* (enclosed groups and raw points), left_* and right_* (the shortest groups
    that cover what the island leaves open), a_* and b_* (the groups at the column's edges)."""
    cells = pixels.assign(groups, start, step, width).select("measure", "i", "g_from", "g_to", "min_v", "max_v", "min_t", "max_t")
    if raw is not None:
        end = start + step * width
        own = raw.filter((F.col("t") >= start) & (F.col("t") < end)).withColumn("i", F.call_function("div", F.col("t") - start, F.lit(step)).cast("int"))
        point = F.struct("t", "v")
        seen = own.groupBy("measure", "i").agg(F.min(point).alias("raw_first"), F.max(point).alias("raw_last"), F.min("v").alias("raw_min"), F.max("v").alias("raw_max"))
        cells = cells.unionByName(seen, allowMissingColumns=True)

    def both(pick: str, fold: str, raw_column: str, form: str) -> str:
        """Over the accepted one of a group's two points, and the raw points."""
        parts = [f"{fold}(case when {c}_t >= px_from and {c}_t < px_to then {form.format(c)} end)" for c in ("min", "max")]
        return f"{pick}({', '.join(parts + [f'{fold}({raw_column})'] * (raw is not None))})"

    def enclosed(pick: str, fold: str) -> str:
        own_groups = f"{fold}(case when px_from <= g_from and g_to <= px_to then {fold}_v end)"
        return own_groups if raw is None else f"{pick}({own_groups}, {fold}(raw_{fold}))"

    point = "named_struct('t', {0}_t, 'v', {0}_v)"
    shortest = "named_struct('len', g_to - g_from, 'g_from', g_from, 'min', min_v, 'max', max_v)"
    earliest = "named_struct('g_from', g_from, 'g_to', g_to, 'min', min_v, 'max', max_v)"
    made = {
        "lowest": both("least", "min", "raw_min", "{0}_v"),
        "highest": both("greatest", "max", "raw_max", "{0}_v"),
        "first": both("least", "min", "raw_first", point),
        "last": both("greatest", "max", "raw_last", point),
        "enc_min": enclosed("least", "min"),
        "enc_max": enclosed("greatest", "max"),
        "lefts": f"min(case when islands = 1 and g_from <= px_from and g_to >= isl_from and isl_from > px_from then {shortest} end)",
        "rights": f"min(case when islands = 1 and g_to >= px_to and g_from <= isl_to and isl_to < px_to then {shortest} end)",
        "a": f"min(case when g_from <= px_from then {earliest} end)",
        "b": f"min(case when g_to >= px_to then {earliest} end)",
    }
    out = cols.join(cells, ["measure", "i"], "left").groupBy(*cols.columns).agg(*[F.expr(e).alias(n) for n, e in made.items()])
    flat = {"min_v": "lowest", "max_v": "highest"} | {f"{n}_{c}": f"{n}.{c}" for n in ("first", "last") for c in ("t", "v")} | {f"{n}_{c}": f"{s}.{c}" for n, s in (("left", "lefts"), ("right", "rights"), ("a", "a"), ("b", "b")) for c in ("min", "max")}
    return _select(out, [*cols.columns, "enc_min", "enc_max"], flat)


def column_errors(measures: DataFrame, groups: DataFrame, spans: DataFrame, start: int, step: int, width: int, height: int, raw: DataFrame | None = None, compat: bool = False, strict: bool = False) -> DataFrame:
    """measure, i, px_from, px_to, islands, err (null: undetermined), missing, false_px, missing_px.

    ``groups`` have min_v, max_v and their times; ``spans`` say what was fetched (measure, s_from, s_to, agg),
    so an empty group and a group never fetched differ.  A column that raw spans cover is exact; one that
    spans cover and that holds no point has error 0; one with no island of whole groups, more than one, or
    a part that no span covers is undetermined and missing.  ``compat`` leaves out the pixels of partial
    groups inside their own column and takes the left column's left partial between columns.  ``strict`` adds what else
    may be drawn wrong: lines between exact columns and others, and the strokes of groups that only partly lie in
    the column where their extremes stand.
    """
    cols = span_islands(pixels.columns(measures, start, step, width), spans, start, step, width)
    out = pixels.with_view(column_cells(cols, groups, raw, start, step, width))
    # a column's neighbours: their points, what covers their open parts and their edges
    there = ("first_t", "first_v", "last_t", "last_v", "exact", "left_min", "left_max", "right_min", "right_max", "a_min", "a_max", "b_min", "b_max")
    side = "over (partition by measure order by i)"
    made = {f"{p}{c}": f"{f}({c}) {side}" for p, f in (("p_", "lag"), ("n_", "lead")) for c in there}
    out = _select(out, out.columns, made | {"undetermined": "not exact and (not covered or (islands != 1 and first_t is not null))"})

    has_left, has_right = (f"{t} is not null and first_t is not null and not {f'({n}_exact and exact)' if strict else f'{n}_exact'}" for t, n in (("p_last_t", "p"), ("n_first_t", "n")))
    ends = {
        "left_0": _line("p_last_t", "p_last_v", "first_t", "first_v", "px_from"),
        "left_1": "first_v",
        "right_0": "last_v",
        "right_1": _line("last_t", "last_v", "n_first_t", "n_first_v", "px_to"),
    }
    ends = {n: f"(case when {has_left if n < 'm' else has_right} then {e} end)" for n, e in ends.items()}
    ends |= {"enc_0": "enc_min", "enc_1": "enc_max", "own_left_0": "left_min", "own_left_1": "left_max", "own_right_0": "right_min", "own_right_1": "right_max"}
    partial = "left" if compat else "right"
    # at the edge of an exact column stands a point, not a group
    edge = lambda side, point, group: f"case when {side}exact then {side}{point} else {side}{group} end"
    for name, l, r in (("before", "p_", ""), ("after", "", "n_")):
        ends |= {f"{name}_{k}": f"case when not {l}exact then {l}{partial}_{c} end" for k, c in ((0, "min"), (1, "max"))}
        ends |= {f"{name}_2": edge(r, "first_v", "a_min"), f"{name}_3": edge(l, "last_v", "b_max"), f"{name}_4": edge(r, "first_v", "a_max"), f"{name}_5": edge(l, "last_v", "b_min")}
    if strict:
        ends |= {"own_0": "min_v", "own_1": "max_v"}
    keep = ["measure", "i", "px_from", "px_to", "islands", "exact", "first_t", "undetermined"]
    flags = {"has_left": has_left, "has_right": has_right}
    out = _select(out, keep, flags | {n: _px(e, height) for n, e in ends.items()})

    # rows that are drawn (to the neighbours and by whole groups), and rows that may be missing: between columns what the
    # left one's partial group spans, or else what could cross between the groups at both edges, and partial groups
    rows = _ends("to_left", "left_0", "left_1", height) | _ends("to_right", "right_0", "right_1", height) | _ends("enc", "enc_0", "enc_1", height)
    gone = []
    for name, on in (("before", "has_left"), ("after", "has_right")):
        partial_there = f"{name}_0 is not null"
        rows |= _ends(f"{name}_p", f"{name}_0", f"{name}_1", height, f"{on} and {partial_there}")
        rows |= _ends(f"{name}_x", f"{name}_2", f"{name}_3", height, f"{on} and not ({partial_there})")
        rows |= _ends(f"{name}_y", f"{name}_4", f"{name}_5", height, f"{on} and not ({partial_there})")
        gone += [f"{name}_p", f"{name}_x", f"{name}_y"]
    if not compat:
        rows |= _ends("own_l", "own_left_0", "own_left_1", height) | _ends("own_r", "own_right_0", "own_right_1", height)
        gone += ["own_l", "own_r"]
    lines = ["to_left", "to_right"]
    if strict:
        rows |= _ends("own", "own_0", "own_1", height)
        lines.append("own")
    out = _select(out, keep, rows)
    # the hull of what is drawn; nothing drawn, and no whole group, hide nothing
    low, high = (f"{f}({', '.join(f'{n}_{e}' for n in [*lines, 'enc'])})" for f, e in (("least", "l"), ("greatest", "h")))
    hull = {"hull_l": low, "hull_h": f"case when {low} = {height} then {height} else {high} end"}
    false_px = _union_outside(lines, "enc_l", f"case when enc_l = {height} then {height} else enc_h end")
    out = _select(out, [*keep, *(f"{n}_{e}" for n in gone for e in "lh")], hull | {"false_px": false_px})
    out = _select(out, [*keep, "false_px"], {"missing_px": _union_outside(gone, "hull_l", "hull_h")})
    # false rows lie in the hull and missing ones don't
    err = f"cast(case when undetermined then null when {'exact or ' * (not strict)}first_t is null then 0D else (false_px + missing_px) / {height} end as double)"
    return _select(out, keep[:5], {"err": err, "missing": "undetermined", "false_px": "false_px", "missing_px": "missing_px"})


def verdicts(errors: DataFrame, gap: int) -> DataFrame:
    """Per measure a row with the sum and count of the column errors (s_from null), and a row per run of missing
    columns, those at most ``gap`` apart joined; one pass over the column errors."""
    order = Window.partitionBy("measure").orderBy("px_from")
    reach = F.max(F.when(F.col("missing"), F.col("px_to"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("missing"), F.coalesce((F.col("px_from") - reach > gap).cast("int"), F.lit(1))).otherwise(0)
    marked = errors.select("measure", "px_from", "px_to", "err", "missing").withColumn("_new", begins)
    marked = marked.withColumn("_no", F.when(F.col("missing"), F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    ends = [f(F.when(F.col("_no").isNotNull(), F.col(c))).alias(n) for f, c, n in ((F.min, "px_from", "s_from"), (F.max, "px_to", "s_to"))]
    return marked.groupBy("measure", "_no").agg(F.sum("err").alias("err"), F.count("err").alias("n"), *ends).drop("_no")


def total_errors(errors: DataFrame) -> DataFrame:
    """Mean error over determined columns and how many are missing; null when none is determined."""
    return errors.groupBy("measure").agg(F.avg("err").alias("error"), F.count("err").alias("n_valid"), F.sum(F.col("missing").cast("int")).alias("n_missing"))
