"""Hand-computed cases: downsampling, intervals, planner, sources, sinks, sessions, streams."""

import pytest
from pyspark.sql import functions as F

from tracelens.functions import scalars
from tracelens.model import Interval, Query, Span, merge, subtract
from tracelens.operators import buckets, error, intervals, pixels
from tracelens.plans import experiments, planner, workload
from tracelens.plans.catalog import SpanCatalog
from tracelens.plans.session import VizSession
from tracelens.sources import sinks
from tracelens.sources.series import CsvConfig, FieldStoreConfig, JdbcConfig, LongTable, TableConfig, open_source
from tracelens.streaming import groups as stream

POINTS = [(0, 5.0), (3, 9.0), (7, 9.0), (9, 1.0), (10, 1.0), (15, 4.0), (19, 4.0), (20, 100.0)]


def series(spark, points=POINTS):
    return spark.createDataFrame([("m", t, float(v)) for t, v in points], "measure string, t long, v double")


@pytest.mark.parametrize("form", [buckets.m4, buckets.m4_hashed])
def test_m4_ties_and_tail(spark, form):
    got = {r.k: r for r in form(series(spark), 0, 10, 2).collect()}
    a, b = got[0], got[1]
    assert (a.first_t, a.first_v, a.min_t, a.min_v, a.max_t, a.max_v, a.last_t, a.last_v) == (0, 5, 9, 1, 7, 9, 9, 1)
    assert (b.first_t, b.min_t, b.max_t, b.max_v, b.last_t) == (10, 10, 19, 4, 19)


def test_min_max_and_synthetic_points(spark):
    got = buckets.synthesise(buckets.min_max(series(spark), Interval(0, 10), 4)).orderBy("k").collect()
    assert [(r.g_from, r.g_to, r.min_v, r.max_v) for r in got] == [(0, 4, 5, 9), (4, 8, 9, 9), (8, 10, 1, 1)]
    assert (got[0].min_t, got[0].first_t, got[0].first_v, got[0].last_t) == (2, 1, 7, 3)
    assert (got[2].min_t, got[2].max_t, got[2].last_t) == (9, 9, 9)


def test_straddling_group_falls_in_two_columns(spark):
    g = spark.createDataFrame([("m", 8, 12), ("m", 6, 10)], "measure string, g_from long, g_to long")
    assert sorted((r.g_from, r.i) for r in pixels.assign(g, 0, 10, 3).collect()) == [(6, 0), (8, 0), (8, 1)]


def test_pixel_rows(spark):
    px = lambda v, a, b: spark.range(1).select(scalars.pixel_id(F.lit(v), F.lit(a), F.lit(b), 11)).first()[0]
    assert [px(5.0, 1.0, 9.0), px(4.0, 1.0, 9.0), px(1.0, 1.0, 9.0), px(9.0, 1.0, 9.0), px(7.0, 7.0, 7.0)] == [5, 3, 0, 10, 0]


def test_intervals(spark):
    rows = spark.createDataFrame([("m", 0, 5), ("m", 3, 8), ("m", 8, 9), ("m", 10, 12)], "measure string, s_from long, s_to long")
    assert sorted(tuple(r)[1:] for r in intervals.islands(rows, ["measure"]).collect()) == [(0, 9), (10, 12)]
    assert planner.group_gaps([Interval(0, 10), Interval(110, 120), Interval(221, 231)], 10) == [Interval(0, 120), Interval(221, 231)]
    assert Interval(5, 15).share_of(Interval(0, 20)) == 0.5
    assert merge([Interval(0, 5), Interval(5, 6)]) == [Interval(0, 6)]
    assert subtract(Interval(0, 10), [Interval(2, 4), Interval(9, 12)]) == [Interval(0, 2), Interval(4, 9)]
    assert not Interval(0, 5).overlaps(Interval(5, 6)) and Interval(0, 5).adjacent(Interval(5, 6))


def test_planner():
    q = Query(0, 100, 10, 10)
    spans, gaps = [Span(0, "m", 0, 50, 2)], [Interval(50, 100)]
    assert planner.aggregation_factor(q, spans, gaps, 4, False) == 5
    assert planner.aggregation_factor(q, spans, gaps, 4, True) == 10
    assert planner.wants_raw([Interval(0, 1000)], 10, 4, 5, 6) and not planner.wants_raw([Interval(0, 1300)], 10, 4, 5, 6)
    assert planner.prefetch_query(Query(100, 200), 1, Interval(80, 220)).interval == Interval(80, 220)
    for bad in (lambda: Query(5, 5), lambda: Query(0, 1, 0), lambda: Query(0, 1, accuracy=2), lambda: Interval(2, 1)):
        with pytest.raises(ValueError):
            bad()


def test_workload_stays_in_the_data():
    extent = Interval(0, 1_000_000)
    made = list(workload.sequence(workload.first_query(extent, 0.1), extent, 60, add_measures=("a",)))
    assert len(made) == 60 and all(extent.encloses(q.interval) for _, q in made)
    assert made == list(workload.sequence(workload.first_query(extent, 0.1), extent, 60, add_measures=("a",)))
    assert made[-1][1].measures == ("a",)


def test_catalog_keeps_resolutions_apart(spark, tmp_path):
    c = SpanCatalog(spark, str(tmp_path))
    rows = series(spark).withColumn("u_id", F.lit(0))
    assert len(c.insert([("m", Interval(0, 21), -1)], rows, True)) == 1
    assert c.insert([("m", Interval(0, 21), -1)], rows, True) == []
    assert c.rows(c.lookup("m", Interval(0, 5), 1), True).count() == 8
    assert c.lookup("m", Interval(21, 30), 1) == [] and c.first("m") == c.last("m") and c.drop("m", Interval(0, 1)) == 1


def test_dropped_spans_stay_dropped(spark, tmp_path):
    c = SpanCatalog(spark, str(tmp_path))
    put = lambda x, v: c.insert([("m", x, -1)], series(spark, [(x.start, v)]).withColumn("u_id", F.lit(0)), True)[0]
    a, b = put(Interval(0, 10), 1), put(Interval(10, 20), 2)
    assert c.predecessor(b) == a and c.successor(a) == b and c.predecessor(a) is None and c.first_overlapping("m", Interval(5, 15)) == a
    assert a.residual(Interval(5, 15)) == [Interval(10, 15)] and a.residual(Interval(2, 8)) == []
    assert c.drop("m", Interval(0, 5)) == 1
    z = put(Interval(20, 30), 3)
    assert len({a.span_id, b.span_id, z.span_id}) == 3
    assert [r.v for r in c.rows([z], True).collect()] == [3.0] and [r.v for r in c.rows([b], True).collect()] == [2.0]


def test_csv_source_and_sinks(spark, tmp_path):
    folder = tmp_path / "wide"
    folder.mkdir()
    (folder / "a.csv").write_text("time,x,y\n2024-01-01 00:00:00.000,1,bad\n2024-01-01 00:00:01.000,2,3\n")
    (folder / "b.csv").write_text("time,x,y\n2024-01-01 00:00:02.000,-1,4\n2024-01-01 00:00:03.000,5,\n")
    s = open_source(spark, CsvConfig(str(folder), "time"))
    assert s.measures() == ["x", "y"] and s.sampling_interval() == 1000 and s.raw().count() == 6
    assert {r.sampling_ms for r in s.files().collect()} == {1000}
    wide = sinks.wide(s.raw(), ["x", "y"]).collect()
    assert [tuple(r)[1:] for r in wide] == [(1, None), (2, 3), (-1, 4), (5, None)]
    sinks.write_per_measure(s.raw(), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 6
    day = 1704067200000
    assert [f.rsplit("/", 1)[1] for f in s.reached([Interval(day + 2000, day + 9000)])] == ["b.csv"]
    assert {(r.measure, r.v) for r in s.raw([Interval(day + 1000, day + 3000)]).collect()} == {("x", 2.0), ("y", 3.0), ("x", -1.0), ("y", 4.0)}
    assert s.raw([Interval(day, day + 1000)]).inputFiles()[0].endswith("a.csv") and len(s.raw([Interval(day, day + 1000)]).inputFiles()) == 1
    assert s.raw([Interval(0, 5)]).count() == 0 and s.metadata() == (Interval(day, day + 3001), ["x", "y"], 1000)
    (folder / "c.csv").write_text("time,x,y\n2024-01-01 00:00:04.000,1,1\n2024-01-01 00:00:09.000,2,3\n")
    with pytest.raises(ValueError, match="sampling"):
        open_source(spark, CsvConfig(str(folder), "time"))
    for bad in (lambda: CsvConfig("", "t"), lambda: CsvConfig("p", "t", ";;"), lambda: JdbcConfig("u", "t", "", "p")):
        with pytest.raises(ValueError):
            bad()


def test_jdbc_source_on_an_embedded_store(spark, tmp_path):
    """Derby comes with Spark: ranges are read in parts, and groups are made by the store."""
    url = f"jdbc:derby:{tmp_path}/store;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    day = 1704067200000
    points = [("m", day + 250 * k, float(k % 7)) for k in range(40)] + [("n", day + 1000, 5.0), ("n", day + 2000, None)]
    frame = spark.createDataFrame(points, "ID string, t long, VALUE_ double").select("ID", F.timestamp_millis("t").alias("AT"), "VALUE_")
    frame.write.format("jdbc").options(url=url, dbtable="POINTS", driver=driver, createTableColumnTypes="ID varchar(20)").save()
    millis = "{{fn TIMESTAMPDIFF(SQL_TSI_FRAC_SECOND, TIMESTAMP('2024-01-01 00:00:00'), {time})}} / 1000000 + " + str(day)
    config = JdbcConfig(url, "POINTS", "app", "app", "ID", "AT", "VALUE_", driver, 4, millis)
    s = open_source(spark, config)
    x = Interval(day + 1000, day + 8000)
    got = s.raw([x], ["m"])
    assert got.rdd.getNumPartitions() == 4 and len(s.predicates([x], ["m"])) == 4
    assert sorted((r.t, r.v) for r in got.collect()) == sorted((t, v) for m, t, v in points if m == "m" and x.contains(t))
    assert s.raw().count() == 41 and s.measures() == ["m", "n"]
    groups = {(r.measure, r.k): tuple(r)[2:] for r in s.groups(x, 2000).collect()}
    own = {}
    for m, t, v in points:
        if v is not None and x.contains(t):
            own.setdefault((m, (t - x.start) // 2000), []).append(v)
    assert groups == {k: (len(v), sum(v), min(v), max(v)) for k, v in own.items()}


def test_field_store_in_files(spark, tmp_path):
    head = "#datatype,string,string,double,dateTime:RFC3339\n_measurement,_field,_value,_time\n"
    (tmp_path / "a.csv").write_text(head + "plant,x,1.5,2024-01-01T00:00:00Z\nother,x,9,2024-01-01T00:00:00Z\n")
    (tmp_path / "b.csv").write_text(head + "plant,y,2.5,2024-01-01T00:00:01Z\nplant,x,,2024-01-01T00:00:02Z\n")
    s = open_source(spark, FieldStoreConfig(f"{tmp_path}/a.csv,{tmp_path}/b.csv", "t", "o", "b", "plant", "fieldfiles"))
    day = 1704067200000
    assert sorted(tuple(r) for r in s.raw().collect()) == [("x", day, 1.5), ("y", day + 1000, 2.5)]
    assert [r.measure for r in s.raw([Interval(day + 500, day + 5000)]).collect()] == ["y"]


def test_range_filters_reach_the_scan(spark):
    plan = open_source(spark, TableConfig("/root/testdata/sf0.001/events.parquet")).raw([Interval(1704153600000, 1704240000000)])._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(ts" in plan


def cached_errors(spark, points, agg, step, width, height, spans):
    names = spark.createDataFrame([("m",)], "measure string")
    own = buckets.synthesise(buckets.min_max(series(spark, points), Interval(0, step * width), agg))
    frame = spark.createDataFrame(spans, "measure string, s_from long, s_to long, agg long")
    return error.column_errors(names, own, frame, 0, step, width, height).orderBy("i").collect()


def test_error_of_constant_and_missing_columns(spark):
    flat = [(t, 7.0) for t in range(40)]
    got = cached_errors(spark, flat, 2, 10, 4, 11, [("m", 0, 30, 2)])
    assert [r.err for r in got] == [0.0, 0.0, 0.0, None] and [r.missing for r in got] == [False, False, False, True]


WALKS, STEP, COLUMNS, ROWS = 100, 40, 10, 50


def random_walk(seed):
    import random

    rng, v, out = random.Random(seed), 0.0, []
    for t in range(STEP * COLUMNS):
        v += rng.gauss(0, 1)
        out.append((t, v))
    return out


def drawn(points, low, high):
    """Pixel rows that the line through the points touches, column by column; two points at one time are a vertical stroke."""
    px = lambda v: int((ROWS - 1) * (v - low) / (high - low))
    cells = [set() for _ in range(COLUMNS)]
    for (t0, a), (t1, b) in zip(points, points[1:]):
        for i in range(t0 // STEP, min(t1 // STEP, COLUMNS - 1) + 1):
            at = lambda t: a + (b - a) * (t - t0) / (t1 - t0)
            x, y = (px(a), px(b)) if t0 == t1 else (px(at(max(t0, i * STEP))), px(at(min(t1, (i + 1) * STEP))))
            cells[i] |= set(range(min(x, y), max(x, y) + 1))
    return cells


@pytest.mark.parametrize(("strict", "raw_to"), [(False, 0), (True, 0), (True, 160)])
@pytest.mark.parametrize("agg", [5, 7, 8, 12, 18, 20])
def test_bound_covers_the_true_error(spark, agg, strict, raw_to):
    """The share of pixels that the cached chart draws wrong doesn't exceed the bound: a hundred random walks, groups that end
    between columns or not, with and without a part that is cached as points.  Beside points only the strict bound covers
    it always, and it does so column by column."""
    walks = {f"w{k}": random_walk(k) for k in range(WALKS)}
    end = STEP * COLUMNS
    table = spark.createDataFrame([(m, t, v) for m, ps in walks.items() for t, v in ps], "measure string, t long, v double")
    names = spark.createDataFrame([(m,) for m in walks], "measure string")
    own = buckets.synthesise(buckets.min_max(table, Interval(raw_to, end), agg))
    spans = spark.createDataFrame([x for m in walks for x in [(m, 0, raw_to, -1)][: raw_to > 0] + [(m, raw_to, end, agg)]], "measure string, s_from long, s_to long, agg long")
    raw = table.filter(F.col("t") < raw_to) if raw_to else None
    bound = {m: [] for m in walks}
    for r in error.column_errors(names, own, spans, 0, STEP, COLUMNS, ROWS, raw, strict=strict).orderBy("i").collect():
        bound[r.measure].append(r.err)
    for m, points in walks.items():
        low, high = min(v for _, v in points), max(v for _, v in points)
        served = points[:raw_to]
        for k in range(raw_to, end, agg):
            part = [v for _, v in points[k : k + agg]]
            served += [((k + min(k + agg, end)) // 2, f(part)) for f in (min, max)]
        assert all(e is not None and 0 <= e <= 1 for e in bound[m])
        wrong = [len(a ^ b) / ROWS for a, b in zip(drawn(points, low, high), drawn(served, low, high))]
        assert sum(wrong) <= sum(bound[m]) + 1e-9
        assert not strict or all(w <= e + 1e-9 for w, e in zip(wrong, bound[m]))


def test_verdicts_are_sums_and_runs(spark):
    rows = [("m", i, 10 * i, 10 * i + 10, None if i in (2, 3, 7, 19) else i / 10, i in (2, 3, 7, 19)) for i in range(20)]
    errors = spark.createDataFrame(rows, "measure string, i int, px_from long, px_to long, err double, missing boolean")
    got = error.verdicts(errors, 30).collect()
    assert sorted((r.s_from, r.s_to) for r in got if r.s_from is not None) == [(20, 80), (190, 200)]
    (whole,) = [r for r in got if r.s_from is None]
    assert whole.n == 16 and abs(whole.err - sum(i / 10 for i in range(20) if i not in (2, 3, 7, 19))) < 1e-9


def test_experiment_writes_its_log(spark, tmp_path):
    arguments = ["--path", "/root/testdata/sf0.001/events.parquet", "--out", str(tmp_path / "log"), "--cache", str(tmp_path / "cache"), "--count", "3", "--width", "20", "--height", "10", "--accuracy", "0.5"]
    records = experiments.main(arguments)
    log = spark.read.option("header", True).csv(str(tmp_path / "log")).collect()
    assert len(log) == len(records) == 3 and log[0].asDict().keys() == records[0].keys()
    assert sum(int(r.io_count) for r in log) == sum(r["io_count"] for r in records) > 0
    (tmp_path / "asked.csv").write_text(f"{records[0]['t_from']},{records[0]['t_to']}\n")
    again = experiments.main([*arguments[:2], "--out", str(tmp_path / "log2"), *arguments[4:], "--queries", str(tmp_path / "asked.csv")])
    assert [(r["t_from"], r["t_to"]) for r in again] == [(records[0]["t_from"], records[0]["t_to"])]


def test_session_warm_and_exact(spark, tmp_path):
    table = LongTable(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "event_type", "ts", "value")
    s = VizSession(table, str(tmp_path), raw_ratio=0)
    x = s.extent
    cold = s.query(Query(x.start, x.end, 20, 10, 0.3, ("click",)))
    warm = s.query(Query(x.start, x.end, 20, 10, 0.3, ("click",)))
    assert warm.io_count <= cold.io_count and warm.points.count() == cold.points.count()
    exact = s.query(Query(x.start, x.end, 20, 10, 1.0, ("click",)))
    m4 = buckets.m4(table.raw(measures=["click"]), x.start, (x.end - x.start) // 20, 20)
    assert exact.points.count() == 4 * m4.count() and exact.io_count == 80


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([("m", t * 1000, float(t)) for t in range(100)], "measure string, t long, v double")
    rows.select("measure", F.timestamp_millis("t").alias("ts"), "v").write.parquet(str(source))
    q = stream.start(spark.readStream.schema("measure string, ts timestamp, v double").parquet(str(source)), 10_000, str(tmp_path / "out"), str(tmp_path / "ck"), "1 second")
    q.awaitTermination()
    got = {(r.g_from, r.cnt, r.min_v, r.max_v) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(k * 10_000, 10, k * 10.0, k * 10.0 + 9) for k in range(9)} <= got


def test_copies_of_intervals_meet_once(spark):
    """Files of the pairs of 3,000 equal intervals with 5,000 are runs, and no pair is lost; a null key meets nothing."""
    from pyspark.sql import functions as F

    from tracelens.operators import intervals

    row = lambda n, frm, to, k="'a'": spark.range(n).selectExpr(f"{k} as measure", f"{frm}L", f"{to}L")
    a = row(3_000, 10, 25).union(row(2, 12, 14)).union(row(3, 12, 14, "cast(null as string)")).union(row(4, 9, 9)).toDF("measure", "s_from", "s_to")
    b = row(5_000, 20, 40).union(row(3, 0, 13)).union(row(3, 0, 13, "cast(null as string)")).toDF("measure", "q_from", "q_to")
    got = intervals.overlap_join(a, b, ["measure"], 10, {"both": F.col("s_from") + F.col("q_to")})
    assert got.columns == ["measure", "s_from", "s_to", "q_from", "q_to", "both"]
    counted = {tuple(r)[:6]: r[6] for r in got.groupBy(*got.columns).count().collect()}
    assert counted == {("a", 10, 25, 20, 40, 50): 15_000_000, ("a", 10, 25, 0, 13, 23): 9_000, ("a", 12, 14, 0, 13, 25): 6}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # what meets are distinct rows
    assert plan.index("Generate") < plan.index("Join") < plan.index("Aggregate")
    assert intervals.overlap_join(a.limit(0), b, ["measure"], 10).collect() == []
