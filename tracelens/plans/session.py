"""A session answers chart queries from cached groups while their error bound allows it."""

from __future__ import annotations

import threading
import time
from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Interval, Query, Span
from ..operators import buckets, error, pixels
from ..sources.series import LongTable
from . import planner
from .catalog import SpanCatalog


@dataclass
class Answer:
    """points (measure, i, role, t, v), stats and column errors as DataFrames, and what was decided: the mean error of the cached
    groups before exact M4 took over, the measures that it answers, the groups per column of what was fetched, and
    the measures whose whole range was fetched anew because their cached groups were too wrong."""

    points: DataFrame
    stats: DataFrame
    errors: DataFrame | None
    error: dict[str, float | None]
    exact: list[str]
    interval: Interval
    io_count: int
    seconds: float
    query_seconds: float
    bound: dict[str, float | None] = field(default_factory=dict)
    factors: dict[str, int] = field(default_factory=dict)
    refetched: list[str] = field(default_factory=list)


class VizSession:
    """``query`` follows clamp, look up, bound, plan, fetch, bound again, fall back, emit, prefetch.

    Cached groups are read at the coarsest stored level that has ``initial_factor`` of them a column; where those are too
    wrong, at their finest.  A prefetch runs after the answer, as a job of its own in the scheduler's pool ``prefetch``;
    ``settle`` waits for it, and if it fails the session goes on without, with the reason in ``prefetch_error``; where the
    prefetched spans themselves are the result, ``settle(strict=True)`` raises that instead.
    ``strict`` is the bound that also covers what the documented one leaves out (``error.column_errors``).
    With a ``catalog`` name what is cached outlives the session and is shared with others of that name.
    """

    def __init__(self, source: LongTable, folder: str, initial_factor: int = 4, prefetch: float = 0.0, raw_ratio: float = 6.0, max_gap: int = 10, compat: bool = False, catalog: str | None = None, strict: bool = False):
        self.source, self.spark = source, source.table.sparkSession
        self.catalog = SpanCatalog(self.spark, folder, catalog)
        self.prefetching: threading.Thread | None = None
        self.prefetch_error: BaseException | None = None
        self.initial_factor, self.prefetch, self.raw_ratio, self.max_gap, self.compat, self.strict = initial_factor, prefetch, raw_ratio, max_gap, compat, strict
        self.extent, self.names, self.sampling = source.metadata()

    # -- parts

    def _spans(self, query: Query, measures: list[str], finest: Collection[str]) -> list[Span]:
        return [s for m in measures for s in self.catalog.lookup(m, query.interval, query.step, None if m in finest else self.initial_factor)]

    def _errors(self, query: Query, measures: list[str], spans: list[Span]) -> DataFrame:
        names = self.spark.createDataFrame([(m,) for m in measures], "measure string")
        raw = self.catalog.rows(spans, True) if any(s.agg < 0 for s in spans) else None
        return error.column_errors(names, self.catalog.rows(spans, False), self.catalog.frame(spans), query.start, query.step, query.width, query.height, raw, self.compat, self.strict)

    def _verdict(self, query: Query, measures: list[str], finest: Collection[str] = ()) -> tuple[dict[str, float | None], dict[str, list[Interval]], DataFrame | None]:
        """Mean error and missing intervals per measure, and the column errors that tell them (None while nothing
        is cached).  Only sums and gaps come to the driver."""
        spans = self._spans(query, measures, finest)
        if not spans:
            whole = Interval(query.start, query.start + query.step * query.width)
            return dict.fromkeys(measures), {m: [whole] for m in measures}, None
        means: dict[str, float | None] = dict.fromkeys(measures)
        gaps: dict[str, list[Interval]] = {m: [] for m in measures}
        errors = self._errors(query, measures, spans)
        for r in error.verdicts(errors, self.max_gap * query.step).collect():
            if r.s_from is not None:
                gaps[r.measure].append(Interval(r.s_from, r.s_to))
            elif r.n:
                means[r.measure] = r.err / r.n
        return means, {m: sorted(g) for m, g in gaps.items()}, errors

    def _fetch(self, query: Query, gaps: dict[str, list[Interval]], factors: dict[str, int]) -> int:
        """Fetch the gaps of all measures, raw or grouped by measure, and cache them."""
        io = 0
        raw, grouped = [], {}
        for m, g in gaps.items():
            if planner.wants_raw(g, query.width, factors[m], self.sampling, self.raw_ratio):
                raw += [(m, x, -1) for x in g]
            elif g:
                width = planner.group_width(query, factors[m])
                grouped.setdefault(width, []).extend((m, x, width) for x in g)
        if raw:
            rows = buckets.raw_multi(self.source.raw([x for _, x, _ in raw], [m for m, _, _ in raw]), [(m, x) for m, x, _ in raw])
            io += self._cache(raw, rows, True)
        for width, parts in grouped.items():
            asked = [(m, x) for m, x, _ in parts]
            points = sum(len(x) for _, x in asked) // max(self.sampling, 1)
            if planner.pushes(self.source.offers, "groups", points, sum(-(-len(x) // width) for _, x in asked)):
                groups = self.source.part_groups(asked, width)
            else:
                groups = LongTable.part_groups(self.source, asked, width)
            io += self._cache(parts, buckets.synthesise(groups), False)
        return io

    def _cache(self, parts, rows: DataFrame, raw: bool) -> int:
        return sum(s.rows for s in self.catalog.insert(parts, rows, raw))

    def _cached_stats(self, query: Query, measures: list[str], finest: Collection[str]) -> DataFrame:
        spans = self._spans(query, measures, finest)
        placed = pixels.assign(self.catalog.rows(spans, False), query.start, query.step, query.width)
        points = pixels.accepted(placed)
        raw = self.catalog.rows(spans, True)
        own = buckets.in_range(raw, query.start, query.step, query.width).select("measure", F.col("k").cast("int").alias("i"), "t", "v")
        rows = points.unionByName(own)
        found = rows.groupBy("measure", "i").agg(*buckets._m4())
        return found

    # -- the query

    def query(self, query: Query) -> Answer:
        began = time.time()
        self.catalog.refresh()
        query = planner.clamp(query, self.extent)
        measures = list(query.measures) or self.names
        io, fetched_s = 0, 0.0
        errors, bound, exact = None, dict.fromkeys(measures), []
        used: dict[str, int] = {}
        refetched: list[str] = []
        finest: set[str] = set()
        if query.step < 1:
            # fewer milliseconds than columns: the points themselves
            raw = self.source.raw([query.interval], measures)
            points = raw.select("measure", F.lit(None).cast("int").alias("i"), F.lit(0).alias("role"), "t", "v")
            return Answer(points, _stats(points), None, bound, measures, query.interval, raw.count(), time.time() - began, 0.0)
        if query.accuracy >= 1:
            exact = measures
        else:
            bound, gaps, errors = self._verdict(query, measures)
            # where a coarser level is too wrong, the groups it was made of are asked
            finest = {m for m in measures if bound[m] is not None and bound[m] > 1 - query.accuracy and any(s.level for s in self._spans(query, [m], ()))}
            if finest:
                bound, gaps, errors = self._verdict(query, measures, finest)
            failed = {m: bound[m] is not None and bound[m] > 1 - query.accuracy for m in measures}
            factors = {}
            for m in measures:
                factors[m] = planner.aggregation_factor(query, self._spans(query, [m], finest), gaps[m], self.initial_factor, failed[m])
                if failed[m]:
                    gaps[m] = [query.interval]
            if any(gaps.values()):
                used = {m: factors[m] for m in measures if gaps[m]}
                refetched = [m for m in measures if failed[m]]
                at = time.time()
                io += self._fetch(query, gaps, factors)
                fetched_s += time.time() - at
                bound, _, errors = self._verdict(query, measures, finest)
            exact = [m for m in measures if bound[m] is None or bound[m] > 1 - query.accuracy]
            if errors is None:
                errors = self._errors(query, measures, self._spans(query, measures, finest))
        parts = []
        cached = [m for m in measures if m not in exact]
        if cached:
            parts.append(self._cached_stats(query, cached, finest))
        if exact:
            io += 4 * query.width * len(exact)
            if planner.pushes(self.source.offers, "m4", len(query.interval) // max(self.sampling, 1), 4 * query.width):
                found = self.source.m4(query.interval, exact, query.step, query.width)
            else:
                found = LongTable.m4(self.source, query.interval, exact, query.step, query.width)
            parts.append(found.drop("cnt").withColumn("i", F.col("k").cast("int")).drop("k"))
        stats = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        points = buckets.points(stats.withColumnRenamed("i", "k")).withColumnRenamed("k", "i")
        answer = Answer(points, result_stats(stats), errors, bound | dict.fromkeys(exact, 0.0), exact, query.interval, io, time.time() - began, fetched_s, bound, used, refetched)
        if self.prefetch > 0 and query.accuracy < 1:
            self.prefetching = InheritableThread(target=self._prefetch, args=(query, measures, self.prefetching), session=self.spark)
            self.prefetching.start()
        return answer

    def _prefetch(self, query: Query, measures: list[str], before: threading.Thread | None) -> None:
        if before:
            before.join()
        try:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", "prefetch")
            wider = planner.prefetch_query(query, self.prefetch, self.extent)
            _, gaps, _ = self._verdict(wider, measures)
            if any(gaps.values()):
                self._fetch(wider, gaps, {m: self.initial_factor for m in measures})
        except BaseException as e:  # an answer was given; what a prefetch can't do the next query does
            self.prefetch_error = e

    def settle(self, strict: bool = False) -> None:
        """Wait for the prefetch that is under way; ``strict`` raises if it, or one before it, failed."""
        if self.prefetching:
            self.prefetching.join()
            self.prefetching = None
        if strict and self.prefetch_error:
            failed, self.prefetch_error = self.prefetch_error, None
            raise RuntimeError("a prefetch failed; what it had to cache is missing") from failed


def _stats(points: DataFrame) -> DataFrame:
    return points.groupBy("measure").agg(F.count("*").alias("n_columns"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.sum("v").alias("sum_v"))


def result_stats(column_stats: DataFrame) -> DataFrame:
    """Per measure: columns with points, least, greatest, and the sum of both over all columns."""
    return column_stats.groupBy("measure").agg(F.count("*").alias("n_columns"), F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v"), F.sum(F.col("max_v") + F.col("min_v")).alias("sum_v"))
