"""The span catalog: which interval of which measure is cached at which resolution, and where its rows are."""

from __future__ import annotations

import threading
import time
import uuid
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Interval, Span
from ..operators import buckets

GROUPS = "span_id long, measure string, g_from long, g_to long, cnt long, sum_v double, min_v double, max_v double, min_t long, max_t long, first_v double, first_t long, last_v double, last_t long"
RAW = "span_id long, measure string, t long, v double"
COMMITS = "op string, at long, span_id long, measure string, s_from long, s_to long, agg long, n long, batch string, levels int"
#: A coarser level's groups are so many finer ones, and the coarsest has at least LEAST.
FANOUT, LEAST = 4, 16


class SpanIndex:
    """Spans by measure and length: those of a level are at most 2**level long, so the ones that overlap an interval
    start within that distance before it.  A question costs a search per level and what it finds."""

    def __init__(self):
        self.levels: dict[str, dict[int, list[tuple[int, int, int, int]]]] = {}

    @staticmethod
    def _entry(s: Span) -> tuple[int, tuple[int, int, int, int]]:
        return max(len(s.interval) - 1, 0).bit_length(), (s.start, s.end, s.agg, s.span_id)

    def add(self, s: Span) -> None:
        level, entry = self._entry(s)
        insort(self.levels.setdefault(s.measure, {}).setdefault(level, []), entry)

    def remove(self, s: Span) -> None:
        level, entry = self._entry(s)
        self.levels[s.measure][level].remove(entry)

    def overlapping(self, measure: str, x: Interval) -> Iterator[tuple[str, int, int, int]]:
        """The keys (measure, start, end, resolution) of spans that overlap an interval."""
        for level, entries in self.levels.get(measure, {}).items():
            at = bisect_left(entries, (x.start - (1 << level),))
            while at < len(entries) and entries[at][0] < x.end:
                start, end, agg, _ = entries[at]
                if end > x.start:
                    yield measure, start, end, agg
                at += 1


class SpanCatalog:
    """Spans are few rows on the driver; their groups and points are Parquet tables, so lineage doesn't grow.

    A span is known by (measure, start, end, resolution): the same interval at a finer one is a new span.  A catalog with a
    ``name`` outlives its driver: after a span's rows its record is committed, a file of its own in the folder, so
    a record is there as a whole or not at all, several sessions commit side by side, and each reads the others' by
    ``refresh``.  Dropped spans of such a catalog keep their rows until ``vacuum``, for another session may be reading them.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str | None = None):
        self.spark, self.folder, self.durable = spark, f"{folder.rstrip('/')}/spans-{name or uuid.uuid4().hex}", name is not None
        self.spans: dict[tuple[str, int, int, int], Span] = {}
        self.index = SpanIndex()
        self.lock = threading.RLock()
        self.dropped: dict[int, Span] = {}
        if self.durable:
            self._commit([("open", None)])
            self.refresh()

    # -- what is known

    def _commit(self, changes: list[tuple[str, Span | None]]) -> None:
        at = time.time_ns()
        rows = [(op, at, *((s.span_id, s.measure, s.start, s.end, s.agg, s.rows, s.batch, s.levels) if s else (None,) * 8)) for op, s in changes]
        self.spark.createDataFrame(rows, COMMITS).coalesce(1).write.parquet(f"{self.folder}/commits/{uuid.uuid4().hex}")

    def refresh(self) -> None:
        """Take over what all sessions have committed.  Of two spans with one key the first stays."""
        if not self.durable:
            return
        rows = self.spark.read.schema(COMMITS).parquet(f"{self.folder}/commits/*").collect()
        gone = {r.span_id for r in rows if r.op == "drop"}
        with self.lock:
            for r in sorted((r for r in rows if r.op == "add"), key=lambda r: (r.at, r.span_id)):
                span = Span(r.span_id, r.measure, r.s_from, r.s_to, r.agg, r.n, r.batch, r.levels)
                known = self.spans.get(_key(span))
                if r.span_id in gone:
                    self.dropped[r.span_id] = span
                    if known and known.span_id == r.span_id:
                        self._forget(known)
                elif known is None:
                    self._know(span)

    def _know(self, span: Span) -> None:
        self.spans[_key(span)] = span
        self.index.add(span)

    def _forget(self, span: Span) -> None:
        del self.spans[_key(span)]
        self.index.remove(span)

    # -- rows

    def insert(self, parts: list[tuple[str, Interval, int]], rows: DataFrame, raw: bool) -> list[Span]:
        """Write the rows of new spans in one job, and their coarser levels in another; rows carry the number ``u_id`` of
        their part.  Spans that another thread has made meanwhile stay."""
        batch = uuid.uuid4().hex
        new: dict[int, Span] = {}
        with self.lock:
            for k, (measure, x, agg) in enumerate(parts):
                if (measure, x.start, x.end, agg) not in self.spans:
                    # a number is never used again, so rows of a dropped span can't come back under it
                    new[k] = Span(uuid.uuid4().int >> 65, measure, x.start, x.end, agg, batch=batch, levels=0 if raw else _levels(x, agg))
        if not new:
            return []
        ids = F.create_map(*[F.lit(c) for k, s in new.items() for c in (k, s.span_id)])
        named = rows.filter(F.col("u_id").isin(list(new))).withColumn("span_id", ids[F.col("u_id")].cast("long"))
        schema = RAW if raw else GROUPS
        kinds = [c.split() for c in schema.split(", ")]
        path = self.path(raw, batch)
        named.selectExpr(*[f"cast({c} as {t}) as {c}" for c, t in kinds]).write.partitionBy("span_id").parquet(f"{path}/level=0")
        counts = {r.span_id: r["count"] for r in self._read(raw, {batch: {0}}).groupBy("span_id").count().collect()}
        # a span without rows has no coarser ones
        done = [replace(s, rows=counts.get(s.span_id, 0), levels=s.levels if s.span_id in counts else 0) for s in new.values()]
        if any(s.levels for s in done):
            self._coarser(done, batch)
        if self.durable:
            self._commit([("add", s) for s in done])
        with self.lock:
            done = [s for s in done if _key(s) not in self.spans]
            for s in done:
                self._know(s)
        return done

    def _coarser(self, spans: list[Span], batch: str) -> None:
        """Groups of FANOUT, FANOUT**2, ... stored groups, all levels in one pass over them."""
        stored = self._read(False, {batch: {0}})
        known = self.spark.createDataFrame([(s.span_id, s.start, s.end, s.agg, s.levels) for s in spans if s.levels], "span_id long, s_from long, s_to long, agg long, levels int")
        level = F.explode(F.sequence(F.lit(1), F.col("levels"))).alias("level")
        rows = stored.join(F.broadcast(known), "span_id").select("*", level)
        rows = rows.withColumn("wide", F.col("agg") * F.expr(f"cast(power({FANOUT}, level) as bigint)")).withColumn("k", F.call_function("div", F.col("g_from") - F.col("s_from"), F.col("wide")))
        own = ["level", "span_id", "measure", "s_from", "s_to", "wide", "k"]
        groups = rows.groupBy(*own).agg(F.sum("cnt").alias("cnt"), F.sum("sum_v").alias("sum_v"), F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v"))
        groups = groups.withColumn("g_from", F.col("s_from") + F.col("k") * F.col("wide")).withColumn("g_to", F.least(F.col("g_from") + F.col("wide"), F.col("s_to")))
        made = buckets.synthesise(groups).select("level", *[c.split()[0] for c in GROUPS.split(", ")])
        made.write.mode("append").partitionBy("level", "span_id").parquet(self.path(False, batch))

    def path(self, raw: bool, batch: str) -> str:
        return f"{self.folder}/{'raw' if raw else 'groups'}/{batch}"

    def _read(self, raw: bool, levels: dict[str, set[int]]) -> DataFrame:
        """The rows of some levels of some batches; nothing else is listed."""
        schema = RAW if raw else GROUPS
        out: DataFrame | None = None
        for batch, some in levels.items():
            for level in sorted(some):
                part = self.spark.read.schema(schema).parquet(f"{self.path(raw, batch)}/level={level}")
                out = part if out is None else out.unionByName(part)
        return out

    def lookup(self, measure: str, x: Interval, step: int, least: int | None = None) -> list[Span]:
        """Spans of a measure that overlap an interval and are fine enough: at least two groups a pixel column.

        With ``least``, each is taken at its coarsest level that has as many groups a column.
        """
        with self.lock:
            found = [self.spans[k] for k in self.index.overlapping(measure, x)]
        found = [s for s in found if step >= 2 * s.agg]
        if least:
            found = [_coarsest(s, step, least) for s in found]
        return sorted(found, key=lambda s: (s.start, s.end, s.agg))

    def rows(self, spans: list[Span], raw: bool) -> DataFrame:
        """Groups or points of some spans, each at its level; only their folders are read."""
        wanted: dict[tuple[str, int], list[int]] = {}
        for s in spans:
            if (s.agg < 0) == raw:
                wanted.setdefault((s.batch, s.level), []).append(s.span_id)
        out: DataFrame | None = None
        for (batch, level), ids in wanted.items():
            part = self._read(raw, {batch: {level}}).filter(F.col("span_id").isin(ids))
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], RAW if raw else GROUPS) if out is None else out

    def frame(self, spans: list[Span] | None = None) -> DataFrame:
        some = list(self.spans.values()) if spans is None else spans
        return self.spark.createDataFrame([(s.measure, s.start, s.end, s.agg) for s in some], "measure string, s_from long, s_to long, agg long")

    # -- plain questions about the intervals, as an index would answer them

    def overlapping(self, measure: str, x: Interval) -> int:
        with self.lock:
            return sum(1 for _ in self.index.overlapping(measure, x))

    def first(self, measure: str) -> Span | None:
        return min((s for s in self.spans.values() if s.measure == measure), key=lambda s: (s.start, s.end), default=None)

    def last(self, measure: str) -> Span | None:
        return max((s for s in self.spans.values() if s.measure == measure), key=lambda s: (s.start, s.end), default=None)

    def successor(self, span: Span) -> Span | None:
        after = [s for s in self.spans.values() if s.measure == span.measure and (s.start, s.end) > (span.start, span.end)]
        return min(after, key=lambda s: (s.start, s.end), default=None)

    def predecessor(self, span: Span) -> Span | None:
        before = [s for s in self.spans.values() if s.measure == span.measure and (s.start, s.end) < (span.start, span.end)]
        return max(before, key=lambda s: (s.start, s.end), default=None)

    def first_overlapping(self, measure: str, x: Interval) -> Span | None:
        with self.lock:
            return min((self.spans[k] for k in self.index.overlapping(measure, x)), key=lambda s: (s.start, s.end), default=None)

    def drop(self, measure: str, x: Interval) -> int:
        """Forget the spans that overlap an interval, and delete their rows (those of a durable catalog by ``vacuum``)."""
        with self.lock:
            gone = [self.spans[k] for k in self.index.overlapping(measure, x)]
            for s in gone:
                self._forget(s)
                self.dropped[s.span_id] = s
        if self.durable and gone:
            self._commit([("drop", s) for s in gone])
        elif gone:
            self.vacuum()
        return len(gone)

    def vacuum(self) -> int:
        """Delete the rows of dropped spans; no session may be reading them any more."""
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        some, self.dropped = list(self.dropped.values()), {}
        for s in some:
            for level in range(s.levels + 1):
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path(s.agg < 0, s.batch)}/level={level}/span_id={s.span_id}")
                path.getFileSystem(hadoop).delete(path, True)
        return len(some)

    def memory_bytes(self, measure: str | None = None) -> int:
        """Bytes of the cached rows as packed numbers: 5 a group, 2 a point."""
        return sum(8 * (2 * s.rows if s.agg < 0 else 5 * -(-len(s.interval) // s.agg)) for s in list(self.spans.values()) if measure in (None, s.measure))


def _key(s: Span) -> tuple[str, int, int, int]:
    return s.measure, s.start, s.end, s.agg


def _levels(x: Interval, agg: int) -> int:
    """Coarser levels that a span is worth."""
    groups, out = -(-len(x) // agg), 0
    while groups >= LEAST * FANOUT:
        groups, out = -(-groups // FANOUT), out + 1
    return out


def _coarsest(s: Span, step: int, least: int) -> Span:
    level = 0
    while level < s.levels and step >= least * s.agg * FANOUT ** (level + 1):
        level += 1
    return replace(s, agg=s.agg * FANOUT**level, level=level)
