"""Sessions on an SQL store: what the planner lets the store aggregate equals what Spark makes of the points."""

import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

from tracelens.model import Interval, Query
from tracelens.operators import buckets
from tracelens.plans import planner
from tracelens.plans.session import VizSession
from tracelens.sources import fieldstore
from tracelens.sources.series import CsvConfig, FieldStoreConfig, JdbcConfig, LongTable, open_source

DAY = 1704067200000
DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
#: Derby's fractions of a second are nanoseconds.
MILLIS = "{{fn TIMESTAMPDIFF(SQL_TSI_FRAC_SECOND, TIMESTAMP('2024-01-01 00:00:00'), {time})}} / 1000000 + " + str(DAY)


@pytest.fixture(scope="module")
def points():
    """Two measures of 4,000 points, values and times that tie, and nulls."""
    rng = random.Random(3)
    out = []
    for m in ("it's", "n"):
        v = 0.0
        for k in range(4000):
            v = round(v + rng.gauss(0, 1), 1)
            out.append((m, DAY + 1000 * k, None if k % 97 == 0 else v))
        out += [(m, DAY + 1000 * k, float(rng.randint(-9, 9))) for k in range(0, 4000, 50)]
    return out


@pytest.fixture(scope="module")
def store(spark, points, tmp_path_factory):
    url = f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/store;create=true"
    frame = spark.createDataFrame(points, "ID string, t long, VALUE_ double").select("ID", F.timestamp_millis("t").alias("AT"), "VALUE_")
    frame.coalesce(2).write.format("jdbc").options(url=url, dbtable="POINTS", driver=DERBY, createTableColumnTypes="ID varchar(20)").save()
    return open_source(spark, JdbcConfig(url, "POINTS", "app", "app", "ID", "AT", "VALUE_", DERBY, 4, MILLIS))


@pytest.fixture(scope="module")
def table(spark, points):
    return LongTable(spark.createDataFrame(points, "measure string, t long, v double"), "measure", "t", "v")


def rows(df):
    names = sorted(df.columns)
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(names).collect())


def test_metadata_comes_from_the_store(store, table):
    assert store.metadata() == table.metadata()


def test_groups_of_the_store(store, table):
    parts = [("n", Interval(DAY + 1500, DAY + 900_700)), ("it's", Interval(DAY + 1500, DAY + 900_700)), ("n", Interval(DAY + 2_000_000, DAY + 2_000_001))]
    assert rows(store.part_groups(parts, 7_000)) == rows(table.part_groups(parts, 7_000))
    assert store.pieces(Interval(0, 100), 7) == [Interval(0, 28), Interval(28, 56), Interval(56, 84), Interval(84, 100)]


def test_m4_of_the_store(store, table):
    x = Interval(DAY + 500, DAY + 3_600_000)
    got = store.m4(x, ["it's", "n"], 36_000, 99)
    assert rows(got) == rows(table.m4(x, ["it's", "n"], 36_000, 99)) and got.count() == 198
    assert store.part_groups([("n", x)], 36_000).rdd.getNumPartitions() == 4


def test_planner_pushes_what_travels_less():
    offers = frozenset({"groups"})
    assert planner.pushes(offers, "groups", 1000, 400) and not planner.pushes(offers, "groups", 300, 400) and not planner.pushes(offers, "m4", 1000, 4)


def test_session_fetches_no_points(store, table, tmp_path, monkeypatch):
    """Cached groups, refetched ones, exact answers and counts are those of a session on the table itself."""
    queries = [Query(DAY, DAY + 3_600_000, 40, 30, a, ("it's", "n")) for a in (0.2, 0.9, 1.0)] + [Query(DAY + 1_800_000, DAY + 4_000_000, 20, 30, 0.3)]
    own = VizSession(table, str(tmp_path / "own"), raw_ratio=0)
    want = [own.query(q) for q in queries]
    want = [(rows(a.points), a.io_count, a.exact, a.error) for a in want]
    pushed = VizSession(store, str(tmp_path / "pushed"), raw_ratio=0)

    def refuse(*_, **__):
        raise AssertionError("points were asked for")

    monkeypatch.setattr(store, "raw", refuse)
    got = [pushed.query(q) for q in queries]
    for a, (points, io, exact, bound) in zip(got, want):
        assert rows(a.points) == points and a.io_count == io and a.exact == exact
        assert {m: e and round(e, 9) for m, e in a.error.items()} == {m: e and round(e, 9) for m, e in bound.items()}
    assert {s.agg for s in pushed.catalog.spans.values()} == {s.agg for s in own.catalog.spans.values()}
    assert any(not a.exact for a in got) and any(a.exact for a in got)


def test_few_points_travel_as_they_are(store, tmp_path):
    """A chart finer than the samples gets points, even from a store that aggregates."""
    s = VizSession(store, str(tmp_path))
    s.query(Query(DAY, DAY + 100_000, 50, 10, 0.5, ("n",)))
    assert [x.agg for x in s.catalog.spans.values()] == [-1]


def test_buckets_by_part_equal_min_max(table):
    x = Interval(DAY, DAY + 50_000)
    got = buckets.part_groups(table.raw([x], ["n"]), [("n", x)], 7_000).drop("u_id")
    assert rows(got) == rows(buckets.min_max(table.raw([x], ["n"]), x, 7_000).drop("k"))


def exported(path, names, start, seconds, note="#datatype,string,string,double,dateTime:RFC3339\n"):
    """One file of a field store: every measurement and field of ``names`` at each second."""
    rows = [f"{m},{f},{k % 11},{datetime.fromtimestamp(start / 1000 + k, timezone.utc):%Y-%m-%dT%H:%M:%S}{('Z', '', '+00:00')[k % 3]}\n" for k in seconds for m, f in names]
    half = len(rows) // 2
    path.write_text(note + "_measurement,_field,_value,_time,host\n" + "".join(r[:-1] + ",h\n" for r in rows[:half]) + "#note\n\n" + "".join(r[:-1] + ",h\n" for r in rows[half:]))
    return str(path)


def test_field_reader_takes_conditions(tmp_path):
    """What is asked for decides which parts are read, and which rows leave the reader."""
    parts = [fieldstore.Part(exported(tmp_path / f"{k}.csv", [("plant", "x"), ("plant", "y"), ("other", "x")], DAY + 100_000 * k, range(100)), 0, 1 << 20, (DAY + 100_000 * k) * 1000, (DAY + 100_000 * k + 99_000) * 1000, ["other", "plant"], ["x", "y"]) for k in range(5)]
    at = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc)
    reader = fieldstore.FieldReader(parts)
    odd = EqualTo(("_value",), 3.0)
    conditions = [GreaterThanOrEqual(("_time",), at(DAY + 150_000)), LessThan(("_time",), at(DAY + 210_000)), EqualTo(("_measurement",), "plant"), In(("_field",), ("x", "z")), IsNotNull(("_time",)), odd]
    assert list(reader.pushFilters(conditions)) == [odd]
    taken = reader.partitions()
    assert [p.file for p in taken] == [parts[1].file, parts[2].file]
    rows = [r for p in taken for b in reader.read(p) for r in b.to_pylist()]
    assert [r["_time"].timestamp() * 1000 for r in rows] == [DAY + 150_000 + 1000 * k for k in range(60)] and {r["_field"] for r in rows} == {"x"}
    other = fieldstore.FieldReader(parts)
    list(other.pushFilters([EqualTo(("_field",), "z")]))
    assert [p.file for p in other.partitions()] == [""] and list(other.read(other.partitions()[0])) == []


@pytest.mark.parametrize("size", [1, 7, 333, 1 << 20])
def test_parts_of_a_file_are_its_rows(tmp_path, size):
    path = exported(tmp_path / "a.csv", [("plant", "x"), ("plant", "y")], DAY, range(25))
    whole = [r for t in fieldstore.rows_of(path, 0, 1 << 30) for r in t.to_pylist()]
    length = (tmp_path / "a.csv").stat().st_size
    assert len(whole) == 50 and [r for a in range(0, length, size) for t in fieldstore.rows_of(path, a, min(a + size, length)) for r in t.to_pylist()] == whole


def test_a_range_reads_its_files_only(spark, tmp_path):
    files = [exported(tmp_path / f"{k}.csv", [("plant", "x"), ("plant", "y")], DAY + 100_000 * k, range(100)) for k in range(6)]
    s = open_source(spark, FieldStoreConfig(",".join(files), "t", "o", "b", "plant", fieldstore.FORMAT))
    x = Interval(DAY + 130_000, DAY + 230_500)
    got = s.raw([x], ["y"])
    assert sorted((r.t, r.v) for r in got.collect()) == [(DAY + 100_000 * k + 1000 * i, float(i % 11)) for k in (1, 2) for i in range(100) if x.contains(DAY + 100_000 * k + 1000 * i)]
    # the other four files could be gone
    for k in (0, 3, 4, 5):
        (tmp_path / f"{k}.csv").unlink()
    assert s.raw([x], ["y"]).count() == 101 and s.raw([x], ["y"]).rdd.getNumPartitions() == 2
    assert s.raw([Interval(0, 5)]).count() == 0


def test_reopening_csv_files_reads_none(spark, tmp_path):
    folder, at = tmp_path / "wide", lambda k: f"2024-01-01 00:00:{k:02d}.000"
    folder.mkdir()
    for name, first in (("a", 0), ("b", 10), ("c", 20)):
        (folder / f"{name}.csv").write_text("time;x;y\n" + "".join(f"{at(first + k)};{k};{k / 2}\n" for k in range(10)))
    config = CsvConfig(str(folder), "time", ";", str(tmp_path / "ranges"))
    opened = open_source(spark, config)
    assert opened.metadata() == (Interval(DAY, DAY + 29_001), ["x", "y"], 1000)
    # the same length and time of change, but nothing that could be read
    for f in folder.iterdir():
        stat = f.stat()
        f.write_bytes(b"?" * stat.st_size)
        os.utime(f, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    again = open_source(spark, config)
    assert again.metadata() == opened.metadata() and sorted(f.rsplit("/", 1)[1] for f in again.reached([Interval(DAY + 5000, DAY + 10_001)])) == ["a.csv", "b.csv"]
    assert len(list((tmp_path / "ranges").iterdir())) == 1
    # a changed file and a new one are read, the others aren't; a file that is gone is forgotten
    (folder / "b.csv").write_text("time;x;y\n" + "".join(f"{at(30 + k)};{k};{k}\n" for k in range(5)))
    (folder / "d.csv").write_text("time;x;y\n" + "".join(f"{at(40 + k)};7;\n" for k in range(5)))
    (folder / "c.csv").unlink()
    third = open_source(spark, config)
    assert sorted((r.file.rsplit("/", 1)[1], r.t_first - DAY, r.t_last - DAY) for r in third.files().collect()) == [("a.csv", 0, 9000), ("b.csv", 30_000, 34_000), ("d.csv", 40_000, 44_000)]
    got = third.raw([Interval(DAY + 33_000, DAY + 42_000)])
    assert sorted(tuple(r) for r in got.collect()) == [("x", DAY + 33_000, 3.0), ("x", DAY + 34_000, 4.0), ("x", DAY + 40_000, 7.0), ("x", DAY + 41_000, 7.0), ("y", DAY + 33_000, 3.0), ("y", DAY + 34_000, 4.0)]
    (folder / "e.csv").write_text("time;x;z\n" + f"{at(50)};1;1\n{at(51)};1;1\n")
    with pytest.raises(Exception, match="(?i)header"):
        open_source(spark, config)
