"""Sources of time series, all normalised to measure STRING, t BIGINT (epoch ms, UTC), v DOUBLE."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import millis, parse_time
from ..model import Interval, merge, narrow
from ..operators import buckets
from . import fieldstore


class TimeSeriesSource(Protocol):
    """What a source offers; every answer is a lazy DataFrame."""

    def measures(self) -> list[str]: ...
    def extent(self) -> Interval: ...
    def sampling_interval(self) -> int: ...
    def raw(self, intervals: Sequence[Interval] | None = None, measures: Sequence[str] = ()) -> DataFrame: ...

    #: What the store itself aggregates; a planner decides whether it shall.
    offers: frozenset[str]

    def part_groups(self, parts: Sequence[tuple[str, Interval]], width: int) -> DataFrame: ...
    def m4(self, interval: Interval, measures: Sequence[str], width: int, count: int) -> DataFrame: ...


@dataclass(frozen=True)
class TableConfig:
    """A long table by path (Parquet or ORC); roles left out are found from the schema."""

    path: str
    measure_col: str | None = None
    time_col: str | None = None
    value_col: str | None = None
    format: str = "parquet"


@dataclass(frozen=True)
class CsvConfig:
    """A wide CSV file or a folder of them with one header; ``ranges`` is a folder in which what is known of the files is kept."""

    path: str
    time_col: str
    delimiter: str = ","
    ranges: str | None = None

    def __post_init__(self):
        if not self.path or not self.time_col:
            raise ValueError("a CSV source needs path and time_col")
        if len(self.delimiter) != 1:
            raise ValueError("the delimiter is one character")


@dataclass(frozen=True)
class JdbcConfig:
    """A long table in an SQL store; ranges become predicates of parallel reads."""

    url: str
    table: str
    user: str
    password: str = field(repr=False)
    measure_col: str = "id"
    time_col: str = "timestamp"
    value_col: str = "value"
    driver: str = "org.postgresql.Driver"
    partitions: int = 8
    #: Epoch milliseconds of a timestamp, a whole number, in the store's SQL.
    millis_sql: str = "CAST(FLOOR(EXTRACT(EPOCH FROM {time}) * 1000) AS BIGINT)"
    #: Values that count; in a store with NaN, as PostgreSQL, add ``AND {value} <> 'NaN'``.
    valid_sql: str = "{value} IS NOT NULL"

    def __post_init__(self):
        for name in ("url", "table", "user", "password"):
            if not getattr(self, name):
                raise ValueError(f"a JDBC source needs {name}")


@dataclass(frozen=True)
class FieldStoreConfig:
    """A store of (_measurement, _field, _value, _time) rows behind a Spark data source of that name; with the
    format ``fieldfiles`` the store is its exported files, and ``url`` their paths."""

    url: str
    token: str = field(repr=False)
    org: str
    bucket: str
    measurement: str
    format: str = "influxdb"

    def __post_init__(self):
        for name in ("url", "token", "org", "bucket", "measurement"):
            if not getattr(self, name):
                raise ValueError(f"a field store source needs {name}")


def roles(schema: T.StructType) -> tuple[str, str, str]:
    """The first text, timestamp and numeric column: measure, time and value."""

    def first(*kinds: type) -> str:
        for f in schema:
            if isinstance(f.dataType, kinds):
                return f.name
        raise ValueError(f"no column of type {', '.join(k.__name__ for k in kinds)}")

    return first(T.StringType, T.VarcharType, T.CharType), first(T.TimestampType, T.TimestampNTZType), first(T.DoubleType, T.FloatType, T.DecimalType)


def time_literal(t: int, kind: T.DataType) -> Column:
    text = datetime.fromtimestamp(t / 1000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz" if isinstance(kind, T.TimestampNTZType) else "timestamp")


class LongTable:
    """A long DataFrame; ranges are filtered on the stored time column, so they reach the scan."""

    offers: frozenset[str] = frozenset()

    def __init__(self, table: DataFrame, measure: str | None = None, time: str | None = None, value: str | None = None):
        if not (measure and time and value):
            found = roles(table.schema)
            measure, time, value = measure or found[0], time or found[1], value or found[2]
        self.table, self.measure, self.time, self.value = table, measure, time, value
        self.kind = table.schema[time].dataType

    def within(self, x: Interval) -> Column:
        if isinstance(self.kind, (T.TimestampType, T.TimestampNTZType)):
            low, high = (time_literal(t, self.kind) for t in (x.start, x.end))
        else:
            low, high = F.lit(x.start), F.lit(x.end)
        return (F.col(self.time) >= low) & (F.col(self.time) < high)

    def raw(self, intervals: Sequence[Interval] | None = None, measures: Sequence[str] = ()) -> DataFrame:
        """Points of the measures in any of the intervals: one scan with one predicate; values that are null or
        not a number are left out."""
        rows, many = self.table, None
        if intervals is not None:
            some = merge(list(intervals))
            if len(some) > buckets.CONDITIONS:
                # the scan gets a few ranges around them
                many, some = some, narrow(some, buckets.CONDITIONS)
            wanted = F.lit(False)
            for x in some:
                wanted = self.within(x) if x is some[0] else wanted | self.within(x)
            rows = rows.filter(wanted)
        if measures:
            rows = rows.filter(F.col(self.measure).isin(list(measures)))
        t = millis(F.col(self.time)) if isinstance(self.kind, (T.TimestampType, T.TimestampNTZType)) else F.col(self.time).cast("long")
        out = rows.select(F.col(self.measure).cast("string").alias("measure"), t.alias("t"), F.col(self.value).cast("double").alias("v"))
        out = out.filter("v is not null and not isnan(v) and t is not null and measure is not null")
        return buckets.within_any(out, many) if many else out

    def part_groups(self, parts: Sequence[tuple[str, Interval]], width: int) -> DataFrame:
        """Min/max groups of ``width`` per (measure, interval), made from points: u_id (the part's number), measure, g_from,
        g_to, cnt, sum_v, min_v, max_v."""
        return buckets.part_groups(self.raw([x for _, x in parts], [m for m, _ in parts]), parts, width)

    def m4(self, interval: Interval, measures: Sequence[str], width: int, count: int) -> DataFrame:
        """First, last, least and greatest point of ``count`` buckets of ``width`` from the interval's start."""
        return buckets.m4(self.raw([interval], measures), interval.start, width, count)

    def measures_frame(self) -> DataFrame:
        return self.raw().select("measure").distinct().orderBy("measure")

    def measures(self) -> list[str]:
        return [r.measure for r in self.measures_frame().collect()]

    def extent_frame(self) -> DataFrame:
        return self.raw().agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"))

    def extent(self) -> Interval:
        r = self.extent_frame().first()
        if r.t_first is None:
            raise ValueError("the source is empty")
        return Interval(r.t_first, r.t_last + 1)

    def sampling_frame(self) -> DataFrame:
        """Second minus first timestamp of the first measure."""
        first = self.raw().agg(F.min("measure").alias("measure"))
        two = self.raw().join(F.broadcast(first), "measure").select("t").orderBy("t").limit(2)
        return two.agg((F.max("t") - F.min("t")).alias("sampling_ms"))

    def sampling_interval(self) -> int:
        return self.sampling_frame().first().sampling_ms or 0

    def metadata(self) -> tuple[Interval, list[str], int]:
        """Extent, measures and sampling interval: one aggregation, and the two first points of one measure."""
        ends = self.raw().groupBy("measure").agg(F.min("t").alias("t_first"), F.max("t").alias("t_last")).collect()
        if not ends:
            raise ValueError("the source is empty")
        names = sorted(r.measure for r in ends)
        two = [r.t for r in self.raw(measures=names[:1]).select("t").orderBy("t").limit(2).collect()]
        return Interval(min(r.t_first for r in ends), max(r.t_last for r in ends) + 1), names, two[-1] - two[0]


def wide_to_long(wide: DataFrame, time_col: str) -> DataFrame:
    """One row per numeric cell of a wide table; cells that are no number are skipped."""
    names = [c for c in wide.columns if c != time_col]
    cells = wide.select(F.col(time_col), *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in names])
    return cells.unpivot([time_col], names, "measure", "v")


class CsvSource(LongTable):
    """Wide CSV file or folder.  The files of a folder must have one header and one sampling interval, or opening
    fails; a range reads only the files whose times reach into it.

    What is known of the files (length, time of change, first and last time, sampling interval, header) is a table.  With a
    folder for it only new and changed files are read when a source is opened, and of the others nothing.
    """

    KNOWN = "file string, length long, modified timestamp, t_first long, t_last long, sampling_ms long, header string"

    def __init__(self, spark: SparkSession, config: CsvConfig):
        self.spark, self.config = spark, config
        listed = spark.read.format("binaryFile").load(config.path).select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))
        stored = spark.read.schema(self.KNOWN).parquet(f"{config.ranges}/*") if self._any_stored() else spark.createDataFrame([], self.KNOWN)
        fresh = [r.file for r in listed.join(stored, ["file", "length", "modified"], "left_anti").select("file").collect()]
        header = stored.select("header").first()
        # the first header is read from a file once, and holds for all
        self.header = header.header if header else config.delimiter.join(self._read(fresh[0]).columns if fresh else [])
        if config.time_col not in self.header.split(config.delimiter):
            raise ValueError(f"no column {config.time_col}")
        if fresh:
            found = self._scanned(fresh).join(listed, "file").selectExpr(*[c.split()[0] for c in self.KNOWN.split(", ")])
            if config.ranges:
                # a batch is a folder of its own, so that opening sources don't disturb each other
                batch = f"{config.ranges.rstrip('/')}/{uuid.uuid4().hex}"
                found.coalesce(1).write.parquet(batch)
                found = spark.read.schema(self.KNOWN).parquet(batch)
            else:
                found = spark.createDataFrame(found.collect(), self.KNOWN)
            stored = stored.unionByName(found)
        self.known = listed.join(stored.dropDuplicates(["file", "length", "modified"]), ["file", "length", "modified"])
        self.ends = self.known.agg(F.min("t_first").alias("first"), F.max("t_last").alias("last"), F.min("sampling_ms").alias("low"), F.max("sampling_ms").alias("high"), F.countDistinct("header").alias("headers")).first()
        if self.ends.headers > 1:
            raise ValueError("headers differ between files")
        if self.ends.low != self.ends.high:
            raise ValueError(f"sampling intervals differ between files: {self.ends.low} to {self.ends.high} ms")
        self.wide = self._read(config.path)
        super().__init__(self._long(self.wide), "measure", config.time_col, "v")

    def _any_stored(self) -> bool:
        if not self.config.ranges:
            return False
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.config.ranges}/*")
        return bool(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))

    def _read(self, path, pruned: bool = True) -> DataFrame:
        """Files by their header, which Spark compares with each file's own as it reads them: the columns asked for, or all."""
        reader = self.spark.read.option("header", True).option("sep", self.config.delimiter).option("enforceSchema", False).option("columnPruning", pruned)
        names = getattr(self, "header", None)
        if names:
            reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names.split(self.config.delimiter)]))
        return reader.csv(path)

    def _long(self, wide: DataFrame) -> DataFrame:
        return wide_to_long(wide.withColumn(self.config.time_col, parse_time(F.col(self.config.time_col))), self.config.time_col)

    def _scanned(self, files: list[str]) -> DataFrame:
        """file, t_first, t_last, sampling_ms, header, in one scan: a task hands on two least times and the last of each file."""
        rows = self._read(files, False).select(F.col("_metadata.file_path").alias("file"), parse_time(F.col(self.config.time_col)).alias("t")).filter("t is not null")

        def ends(batches):
            found: dict[str, list[int]] = {}
            for batch in batches:
                for file in batch.column("file").unique().to_pylist():
                    t = batch.column("t").filter(pc.equal(batch.column("file"), file)).unique().to_pylist()
                    found[file] = sorted({*found.get(file, []), *t})
                    found[file] = [*found[file][:2], *found[file][2:][-1:]]
            yield pa.RecordBatch.from_pydict({"file": pa.array(list(found), pa.string()), "ts": pa.array(list(found.values()), pa.list_(pa.int64()))})

        # the times of all tasks of a file, three a task
        ts = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ts"))))
        out = rows.mapInArrow(ends, "file string, ts array<long>").groupBy("file").agg(ts.alias("ts"))
        second = F.get("ts", F.lit(1)) - F.get("ts", F.lit(0))
        return out.select("file", F.get("ts", F.lit(0)).alias("t_first"), F.element_at("ts", -1).alias("t_last"), second.alias("sampling_ms"), F.lit(self.header).alias("header"))

    def files(self) -> DataFrame:
        """File, first and last time, sampling interval of every file."""
        return self.known.select("file", "t_first", "t_last", "sampling_ms")

    def reached(self, intervals: Sequence[Interval]) -> list[str]:
        """The files that hold times of the intervals."""
        wanted = F.lit(False)
        for x in merge(list(intervals)):
            wanted = wanted | ((F.col("t_first") < x.end) & (F.col("t_last") >= x.start))
        return [r.file for r in self.known.filter(wanted).select("file").collect()]

    def raw(self, intervals: Sequence[Interval] | None = None, measures: Sequence[str] = ()) -> DataFrame:
        if intervals is None:
            return super().raw(intervals, measures)
        files = self.reached(intervals)
        part = LongTable(self._long(self._read(files)) if files else self.table.limit(0), "measure", self.config.time_col, "v")
        return part.raw(intervals, measures)

    def metadata(self) -> tuple[Interval, list[str], int]:
        """From what is known of the files; a measure is a column, whether or not it holds numbers."""
        if self.ends.first is None:
            raise ValueError("the source is empty")
        return Interval(self.ends.first, self.ends.last + 1), sorted(n for n in self.header.split(self.config.delimiter) if n != self.config.time_col), self.ends.low or 0


class JdbcSource(LongTable):
    """A long table in an SQL store.  A range is read by ``partitions`` connections, each with its part of the
    range as predicate; min/max groups, M4 points and metadata are made by the store itself, part by part too."""

    offers = frozenset({"groups", "m4"})

    def __init__(self, spark: SparkSession, config: JdbcConfig):
        self.spark, self.config = spark, config
        self.options = {"url": config.url, "user": config.user, "password": config.password, "driver": config.driver}
        table = spark.read.format("jdbc").options(dbtable=config.table, **self.options).load()
        super().__init__(table, config.measure_col, config.time_col, config.value_col)

    def pieces(self, x: Interval, width: int = 1) -> list[Interval]:
        """The interval in at most ``partitions`` parts of about equal length, cut between buckets of ``width``."""
        length = -(-len(x) // (self.config.partitions * width)) * width
        return [Interval(a, min(a + length, x.end)) for a in range(x.start, x.end, max(length, 1))]

    def condition(self, x: Interval, measures: Sequence[str] = ()) -> str:
        names = ", ".join("'" + m.replace("'", "''") + "'" for m in measures)
        chosen = f" AND {_quoted(self.measure)} IN ({names})" if measures else ""
        return f"{_quoted(self.time)} >= {_stamp(x.start)} AND {_quoted(self.time)} < {_stamp(x.end)}{chosen}"

    def predicates(self, intervals: Sequence[Interval], measures: Sequence[str] = ()) -> list[str]:
        """Conditions that share out the intervals: each is cut in pieces of about equal length."""
        some = narrow(list(intervals), buckets.CONDITIONS)
        length = max(1, -(-sum(map(len, some)) // self.config.partitions))
        return [self.condition(Interval(a, min(a + length, x.end)), measures) for x in some for a in range(x.start, x.end, length)]

    def raw(self, intervals: Sequence[Interval] | None = None, measures: Sequence[str] = ()) -> DataFrame:
        if not intervals:
            return super().raw(intervals, measures)
        extra = {k: v for k, v in self.options.items() if k != "url"}
        part = self.spark.read.jdbc(self.config.url, self.config.table, predicates=self.predicates(intervals, measures), properties=extra)
        return LongTable(part, self.measure, self.time, self.value).raw(intervals, measures)

    def _points_sql(self, where: str, start: int, width: int) -> str:
        """measure, k, t, v of the valid points of a condition, with buckets from ``start``."""
        t = self.config.millis_sql.format(time=_quoted(self.time))
        valid = self.config.valid_sql.format(value=_quoted(self.value))
        inner = f"SELECT {_quoted(self.measure)} AS measure, {t} AS t, {_quoted(self.value)} AS v FROM {self.config.table} WHERE {where} AND {valid}"
        return f"SELECT measure, (t - {start}) / {width} AS k, t, v FROM ({inner}) r"

    def groups_query(self, x: Interval, within: Interval, width: int, measures: Sequence[str] = ()) -> str:
        """SQL for measure, k, cnt, sum_v, min_v, max_v of the points of ``within`` in groups from ``x.start`` on."""
        points = self._points_sql(self.condition(within, measures), x.start, width)
        return f"SELECT measure, k, COUNT(*) AS cnt, SUM(v) AS sum_v, MIN(v) AS min_v, MAX(v) AS max_v FROM ({points}) g GROUP BY measure, k"

    def m4_query(self, x: Interval, within: Interval, width: int, measures: Sequence[str] = ()) -> str:
        """SQL for M4 as every store can do it: extremes per bucket, joined to the points that attain them."""
        points = self._points_sql(self.condition(within, measures), x.start, width)
        ends = f"SELECT measure, k, COUNT(*) AS cnt, MIN(t) AS first_t, MAX(t) AS last_t, MIN(v) AS min_v, MAX(v) AS max_v FROM ({points}) g GROUP BY measure, k"
        picked = "MIN(CASE WHEN p.t = first_t THEN p.v END) AS first_v, MAX(CASE WHEN p.t = last_t THEN p.v END) AS last_v, MAX(CASE WHEN p.v = min_v THEN p.t END) AS min_t, MAX(CASE WHEN p.v = max_v THEN p.t END) AS max_t"
        at = "p.t = e.first_t OR p.t = e.last_t OR p.v = e.min_v OR p.v = e.max_v"
        kept = "cnt, first_t, last_t, min_v, max_v"
        return f"SELECT p.measure AS measure, p.k AS k, {kept}, {picked} FROM ({points}) p JOIN ({ends}) e ON p.measure = e.measure AND p.k = e.k AND ({at}) GROUP BY p.measure, p.k, {kept}"

    def _ask(self, queries: Sequence[str], kinds: dict[str, str]) -> DataFrame:
        """The rows of all queries; each is a partition with a connection of its own."""
        out: DataFrame | None = None
        for query in queries:
            table = self.spark.read.format("jdbc").options(query=query, **self.options).load()
            low = {c.lower(): c for c in table.columns}
            part = table.select(*[F.col(low[c]).cast(t).alias(c) for c, t in kinds.items()])
            out = part if out is None else out.union(part)
        return out

    def groups(self, x: Interval, width: int, measures: Sequence[str] = ()) -> DataFrame:
        """measure, k, cnt, sum_v, min_v, max_v of the groups from ``x.start`` on, made by the store: only groups travel."""
        kinds = {"measure": "string", "k": "long", "cnt": "long", "sum_v": "double", "min_v": "double", "max_v": "double"}
        return self._ask([self.groups_query(x, y, width, measures) for y in self.pieces(x, width)], kinds)

    def part_groups(self, parts: Sequence[tuple[str, Interval]], width: int) -> DataFrame:
        """As for a table, but made by the store."""
        alike: dict[Interval, dict[str, int]] = {}
        for u_id, (m, x) in enumerate(parts):
            alike.setdefault(x, {})[m] = u_id
        out: DataFrame | None = None
        for x, numbers in alike.items():
            found = self.groups(x, width, list(numbers))
            u_id = F.create_map(*[F.lit(c) for pair in numbers.items() for c in pair])[F.col("measure")]
            found = found.select(u_id.alias("u_id"), "measure", *buckets.bounds(x.start, width, x.end), "cnt", "sum_v", "min_v", "max_v")
            out = found if out is None else out.union(found)
        return out

    def m4(self, interval: Interval, measures: Sequence[str], width: int, count: int) -> DataFrame:
        """As for a table, but made by the store: only four points a bucket travel."""
        kinds = {"measure": "string", "k": "long", "cnt": "long"} | {f"{n}_{c}": k for n in ("first", "last", "min", "max") for c, k in (("v", "double"), ("t", "long"))}
        whole = Interval(interval.start, interval.start + width * count)
        return self._ask([self.m4_query(whole, y, width, measures) for y in self.pieces(whole, width)], kinds)

    def metadata(self) -> tuple[Interval, list[str], int]:
        """Extent, measures and sampling interval by two queries of a row a measure and of two rows."""
        points = self._points_sql(f"{_quoted(self.measure)} IS NOT NULL AND {_quoted(self.time)} IS NOT NULL", 0, 1)
        ends = self._ask([f"SELECT measure, MIN(t) AS t_first, MAX(t) AS t_last FROM ({points}) g GROUP BY measure"], {"measure": "string", "t_first": "long", "t_last": "long"}).collect()
        if not ends:
            raise ValueError("the source is empty")
        names = sorted(r.measure for r in ends)
        first = names[0].replace("'", "''")
        two = sorted(r.t for r in self._ask([f"SELECT t FROM ({points}) g WHERE measure = '{first}' ORDER BY t FETCH FIRST 2 ROWS ONLY"], {"t": "long"}).collect())
        return Interval(min(r.t_first for r in ends), max(r.t_last for r in ends) + 1), names, two[-1] - two[0]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _stamp(t: int) -> str:
    """The timestamp escape that every JDBC driver turns into its store's own."""
    return "{ts '" + datetime.fromtimestamp(t // 1000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S") + f".{t % 1000:03d}'" + "}"


def open_source(spark: SparkSession, config) -> LongTable:
    """The source for a configuration, by its class."""
    match config:
        case TableConfig():
            return LongTable(spark.read.format(config.format).load(config.path), config.measure_col, config.time_col, config.value_col)
        case CsvConfig():
            return CsvSource(spark, config)
        case JdbcConfig():
            return JdbcSource(spark, config)
        case FieldStoreConfig():
            if config.format == fieldstore.FORMAT:
                table = fieldstore.open_files(spark, config.url.split(","))
            else:
                table = spark.read.format(config.format).options(url=config.url, token=config.token, org=config.org, bucket=config.bucket).load()
            return LongTable(table.filter(F.col("_measurement") == config.measurement), "_field", "_time", "_value")
    raise ValueError(f"unknown source configuration {type(config).__name__}")


def from_parquet(spark: SparkSession, sf_dir: str, table: str, measure: str, time: str, value: str) -> LongTable:
    return LongTable(spark.read.parquet(f"{sf_dir}/{table}.parquet"), measure, time, value)
