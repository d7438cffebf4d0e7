"""Catalogs and sessions: index, commits, levels, prefetch, decisions; intervals and pixel sets against plain Python."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tracelens import registry
from tracelens.model import Interval, Query, Span, merge, narrow
from tracelens.operators import buckets, error, intervals, pixels
from tracelens.plans import experiments
from tracelens.plans.catalog import SpanCatalog, SpanIndex
from tracelens.plans.session import VizSession
from tracelens.sources.series import LongTable

SECOND = 1000


@pytest.fixture(scope="module")
def walk(spark):
    """One point a second for two hours, two measures."""
    rng, rows = random.Random(1), []
    for m in ("a", "b"):
        v = 0.0
        for k in range(7200):
            v += rng.gauss(0, 1)
            rows.append((m, k * SECOND, v))
    return LongTable(spark.createDataFrame(rows, "measure string, t long, v double").coalesce(4), "measure", "t", "v")


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect())


def test_index_finds_what_overlaps():
    rng, index, spans = random.Random(0), SpanIndex(), []
    for k in range(3000):
        start = rng.randrange(100_000)
        s = Span(k, rng.choice("ab"), start, start + rng.choice((1, 7, 900, 40_000, rng.randrange(1, 3000))), -1)
        spans.append(s)
        index.add(s)
    for s in spans[::3]:
        index.remove(s)
    left = [s for k, s in enumerate(spans) if k % 3]
    for _ in range(200):
        a = rng.randrange(100_000)
        x = Interval(a, a + rng.choice((1, 50, 20_000)))
        assert sorted(index.overlapping("a", x)) == sorted((s.measure, s.start, s.end, s.agg) for s in left if s.measure == "a" and s.interval.overlaps(x))
    assert list(index.overlapping("c", Interval(0, 10))) == []


def test_lookup_among_many_spans(spark, tmp_path):
    """A hundred thousand spans of a measure: a question's cost is what it finds."""
    c = SpanCatalog(spark, str(tmp_path))
    for k in range(100_000):
        c._know(Span(k, "m", 10 * k, 10 * k + 10, 2))
    began = time.perf_counter()
    assert [s.span_id for s in c.lookup("m", Interval(500_005, 500_035), 4)] == [50_000, 50_001, 50_002, 50_003]
    assert time.perf_counter() - began < 0.05 and c.overlapping("m", Interval(0, 95)) == 10


def test_columns_meet_their_own_spans_only(spark):
    """100,000 spans a measure: a column's work is bounded by what overlaps it, and its bound is that of one long span."""
    end, step, width = 1_000_000, 10_000, 100
    names = spark.createDataFrame([("m",)], "measure string")
    many = spark.range(100_000).select(F.lit("m").alias("measure"), (F.col("id") * 10).alias("s_from"), (F.col("id") * 10 + 10).alias("s_to"), F.lit(10).cast("long").alias("agg"))
    one = spark.createDataFrame([("m", 0, end, 10)], "measure string, s_from long, s_to long, agg long")
    posted = pixels.assign(many.withColumnsRenamed({"s_from": "g_from", "s_to": "g_to"}), 0, step, width)
    assert posted.groupBy("i").count().agg(F.max("count")).first()[0] == 1000
    points = spark.range(0, end, 7).select(F.lit("m").alias("measure"), F.col("id").alias("t"), F.sin(F.col("id") / 3000).alias("v"))
    own = buckets.synthesise(buckets.min_max(points, Interval(0, end), 10))
    assert rows(error.column_errors(names, own, many, 0, step, width, 60)) == rows(error.column_errors(names, own, one, 0, step, width, 60))


@pytest.mark.parametrize(("cells", "gap"), [(1, 0), (7, 0), (64, 3), (4096, 50)])
def test_islands_are_merged_intervals(spark, cells, gap):
    rng, made = random.Random(cells), []
    for m, n in (("hot", 4000), ("b", 40), ("one", 1)):
        for _ in range(n):
            start = rng.randrange(20_000 if rng.random() < 0.9 else 100)
            made.append((m, start, start + rng.choice((0, 1, 2, rng.randrange(6), rng.randrange(3000) if rng.random() < 0.01 else 1))))
    table = spark.createDataFrame(made, "measure string, s_from long, s_to long")
    want = sorted((m, x.start, x.end) for m in ("hot", "b", "one") for x in merge([Interval(a, b) for k, a, b in made if k == m], gap))
    got = intervals.islands(table, ["measure"], gap, cells=cells)
    assert sorted((r.measure, r.s_from, r.s_to) for r in got.collect()) == want
    assert intervals.islands(table.limit(0), ["measure"]).collect() == []


def test_no_window_holds_a_measure(spark):
    """Rows are sorted by measure and cell; only heads of cells meet by measure alone."""
    table = spark.range(50_000).select(F.lit("hot").alias("measure"), (F.col("id") * 10).alias("s_from"), (F.col("id") * 10 + 3).alias("s_to"))
    cell = F.floor(F.col("s_from") / (500_000 / intervals.CELLS))
    assert table.groupBy(cell).count().agg(F.max("count")).first()[0] <= 14
    plan = intervals.islands(table, ["measure"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition" in line]
    by_measure = [w for w in windows if "_cell" not in w.split("windowspecdefinition", 1)[1].split(" ASC", 1)[0].rsplit(",", 1)[0]]
    assert windows and all("_reach" in w or "_last#" in w for w in by_measure)


def test_pixel_sets_by_arithmetic(spark):
    """What a hull leaves of a union, at 2,400 rows, against sets."""
    rng, height, made = random.Random(4), 2400, []
    names = ["a", "b", "c", "d"]
    for _ in range(300):
        ends = []
        for _ in names:
            x, y = sorted(rng.choices(range(height), k=2)) if rng.random() < 0.7 else sorted((p := rng.randrange(height), min(p + rng.randrange(3), height - 1)))
            ends += [x, y] if rng.random() < 0.8 else [height, -1]
        x, y = sorted(rng.choices(range(height), k=2))
        made.append((*ends, *((x, y) if rng.random() < 0.8 else (height, height))))
    table = spark.createDataFrame(made, ", ".join(f"{n}_l int, {n}_h int" for n in names) + ", low int, high int")
    got = table.selectExpr(f"{error._union_outside(names, 'low', 'high')} as outside").collect()
    for values, r in zip(made, got):
        sets = [set(range(x, y + 1)) for x, y in zip(values[:8:2], values[1:8:2])]
        hull = set(range(values[8], values[9] + 1)) if values[8] < height else set()
        assert r.outside == len(set.union(*sets) - hull)


def test_a_second_session_answers_warm(spark, walk, tmp_path):
    q = Query(0, 7_200_000, 60, 40, 0.5, ("a",))
    first = VizSession(walk, str(tmp_path), raw_ratio=0, catalog="walk")
    other = VizSession(walk, str(tmp_path), raw_ratio=0, catalog="walk")
    cold = first.query(q)
    for session in (other, VizSession(walk, str(tmp_path), raw_ratio=0, catalog="walk")):
        warm = session.query(q)
        assert warm.io_count == 0 and warm.factors == {} and rows(warm.points) == rows(cold.points)
    assert cold.io_count > 0 and VizSession(walk, str(tmp_path), raw_ratio=0).query(q).io_count == cold.io_count
    # a drop is seen by the others; the rows are there for who still reads them, until they are cleared away
    spans = list(other.catalog.spans.values())
    assert first.catalog.drop("a", Interval(0, 1)) == len(spans) and other.catalog.rows(spans, False).count() == cold.io_count
    other.catalog.refresh()
    assert other.catalog.spans == {} and other.catalog.vacuum() == len(spans) and other.catalog.rows(spans, False).count() == 0
    assert other.query(q).io_count == cold.io_count and first.query(q).io_count == 0


def test_a_span_is_committed_whole_or_not_at_all(spark, walk, tmp_path, monkeypatch):
    """Rows without a record are no span; two sessions that fetch the same agree on one."""
    x, part = Interval(0, 60_000), [("a", Interval(0, 60_000), -1)]
    points = lambda: walk.raw([x], ["a"]).withColumn("u_id", F.lit(0))
    a, b = (SpanCatalog(spark, str(tmp_path), "walk") for _ in "ab")

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(a, "_commit", fail)
        with pytest.raises(OSError):
            a.insert(part, points(), True)
    b.refresh()
    assert a.spans == {} and b.spans == {}
    (kept,), (late,) = a.insert(part, points(), True), b.insert(part, points(), True)
    c = SpanCatalog(spark, str(tmp_path), "walk")
    assert [s.span_id for s in c.spans.values()] == [kept.span_id] and kept.span_id != late.span_id and c.rows([*c.spans.values()], True).count() == 60


def test_zooming_out_reads_a_coarser_level(spark, walk, tmp_path):
    s = VizSession(walk, str(tmp_path), raw_ratio=0)
    fine = s.query(Query(0, 6_400_000, 320, 40, 0.2, ("a",)))
    assert fine.exact == [] and fine.io_count > 1000
    (span,) = s.catalog.spans.values()
    assert span.levels >= 2
    far = s.query(Query(0, 6_400_000, 20, 40, 0.2, ("a",)))
    (taken,) = s.catalog.lookup("a", Interval(0, 6_400_000), 320_000, 4)
    assert far.io_count == 0 and far.exact == [] and taken.level == 2 and taken.agg == 16 * span.agg
    stored = s.catalog.rows([taken], False)
    want = buckets.synthesise(buckets.min_max(walk.raw([Interval(0, 6_400_000)], ["a"]), Interval(0, 6_400_000), taken.agg))
    assert rows(stored.drop("span_id").withColumn("sum_v", F.round("sum_v", 6))) == rows(want.drop("k").withColumn("sum_v", F.round("sum_v", 6)).select(stored.drop("span_id").columns))
    # where the coarse level is too wrong the fine groups are asked before anything is fetched
    bound = far.bound["a"]
    finer = s.query(Query(0, 6_400_000, 20, 40, 1 - bound * 0.95, ("a",)))
    assert finer.io_count == 0 and finer.bound["a"] < bound and finer.exact == []


def test_prefetch_comes_after_the_answer(spark, walk, tmp_path, monkeypatch):
    s = VizSession(walk, str(tmp_path), raw_ratio=0, prefetch=1.0)
    go, seen, fetch = threading.Event(), [], s._fetch

    def slow(query, gaps, factors):
        if threading.current_thread() is not threading.main_thread():
            go.wait(60)
            seen.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        return fetch(query, gaps, factors)

    monkeypatch.setattr(s, "_fetch", slow)
    inner = Query(2_400_000, 3_600_000, 40, 30, 0.2, ("a",))
    s.query(inner)
    assert s.prefetching.is_alive() and len(s.catalog.spans) == 1 and seen == []
    # the session goes on answering meanwhile
    assert s.query(inner).io_count == 0
    go.set()
    s.settle()
    assert seen and set(seen) == {"prefetch"} and s.prefetch_error is None
    assert min(x.start for x in s.catalog.spans.values()) < 2_400_000 < 3_600_000 < max(x.end for x in s.catalog.spans.values())
    assert s.query(Query(2_100_000, 3_300_000, 40, 30, 0.2, ("a",))).io_count == 0
    s.settle()


def test_a_failed_prefetch_loses_nothing(spark, walk, tmp_path, monkeypatch):
    s = VizSession(walk, str(tmp_path), raw_ratio=0, prefetch=1.0)
    fetch = s._fetch

    def broken(query, gaps, factors):
        if threading.current_thread() is not threading.main_thread():
            raise RuntimeError("no source")
        return fetch(query, gaps, factors)

    monkeypatch.setattr(s, "_fetch", broken)
    inner = Query(2_400_000, 3_600_000, 40, 30, 0.2, ("a",))
    cold = s.query(inner)
    s.settle()
    assert "no source" in str(s.prefetch_error) and len(s.catalog.spans) == 1
    assert rows(s.query(inner).points) == rows(cold.points)
    s.settle()


def test_a_failed_prefetch_is_no_result(spark, walk, tmp_path, monkeypatch):
    """Queries and runs whose result depends on the prefetched spans raise what the prefetch raised, once."""
    fetch = VizSession._fetch

    def broken(self, query, gaps, factors):
        if threading.current_thread() is not threading.main_thread():
            raise RuntimeError("no source")
        return fetch(self, query, gaps, factors)

    monkeypatch.setattr(VizSession, "_fetch", broken)
    with pytest.raises(RuntimeError, match="prefetch failed") as told:
        registry.prefetch_extend(spark, "/root/testdata/sf0.001")
    assert "no source" in str(told.value.__cause__)
    s = VizSession(walk, str(tmp_path / "cache"), raw_ratio=0, prefetch=1.0)
    inner = Query(2_400_000, 3_600_000, 40, 30, 0.2, ("a",))
    with pytest.raises(RuntimeError, match="prefetch failed"):
        experiments.run(s, [inner], "walk", str(tmp_path / "log"))
    assert not (tmp_path / "log").exists()
    s.settle(strict=True)


def test_every_kind_of_decision_happens(spark):
    """On the rows that are compared with SQL: a fallback, a refetch, a doubled and a mixed factor, and an answer from the cache."""
    got = registry.session_decisions(spark, "/root/testdata/sf0.01").collect()
    assert {r.fallback for r in got} == {r.refetched for r in got} == {True, False}
    assert {r.factor for r in got} >= {4, 8, 12, None} and {r.io_count for r in got if r.k == 4} == {0}
    assert any(r.refetched and not r.fallback for r in got) and any(r.refetched and r.fallback for r in got)


def test_many_intervals_are_a_table(spark, walk):
    """A hundred gaps: the same points as of one after the other, and a plan that doesn't grow with them."""
    rng = random.Random(6)
    asked = [(rng.choice("ab"), Interval(a, a + rng.choice((1, 5_000, 60_000)))) for a in (rng.randrange(7_200_000) for _ in range(100))]
    asked.append(("a", Interval(10, 10)))
    xs = [x for _, x in asked]
    got = walk.raw(xs)
    whole = [tuple(r) for r in walk.raw().collect()]
    assert rows(got) == rows(spark.createDataFrame([r for r in whole if any(x.contains(r[1]) for x in xs)], "measure string, t long, v double"))
    tagged = sorted((r.u_id, r.t) for r in buckets.raw_multi(got, asked).collect())
    assert tagged == sorted((k, t) for k, (m, x) in enumerate(asked) for n, t, _ in whole if n == m and x.contains(t))
    size = lambda n: len(buckets.raw_multi(walk.raw(xs[:n]), asked[:n])._jdf.queryExecution().optimizedPlan().toString())
    assert size(100) < 1.5 * size(50)
    assert narrow([Interval(0, 1), Interval(5, 6), Interval(7, 9), Interval(20, 21)], 2) == [Interval(0, 9), Interval(20, 21)]
    assert narrow([Interval(0, 1)], 5) == [Interval(0, 1)] and narrow([], 3) == []
