"""A field store kept in files: a Spark data source of (_measurement, _field, _value, _time) rows.

Files are annotated CSV as such stores export it: lines that start with # are annotations, then a header with
at least those four columns, ``_time`` in RFC 3339 (UTC where no zone is named).  What the files hold is known by
part: a part is a piece of a file with its first and last time and its measurements and fields.  Filters on time,
measurement and field are pushed into the reader: it reads the parts that they reach, and hands over in Arrow
batches the rows that pass.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

FORMAT = "fieldfiles"
#: Bytes of a part at least, but for the last of a file; and of a batch.
PART, BATCH = 64 << 20, 8 << 20
#: Parts that have more than so many fields are read whatever field is asked for.
FIELDS = 64
NAMES = ("_measurement", "_field", "_value", "_time")
ROWS = pa.schema([("_measurement", pa.string()), ("_field", pa.string()), ("_value", pa.float64()), ("_time", pa.timestamp("us", "UTC"))])
PARTS = "file string, low long, high long, first_us long, last_us long, measurements array<string>, fields array<string>"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@dataclass
class Part(InputPartition):
    """The lines of a file that begin in [low, high); times are epoch microseconds; no names: too many."""

    file: str
    low: int
    high: int
    first_us: int
    last_us: int
    measurements: list[str] | None
    fields: list[str] | None


@dataclass
class Wanted:
    """The pushed conditions: times in [low, high] microseconds, and names (None: any)."""

    low: int = -(1 << 62)
    high: int = 1 << 62
    names: dict[str, set[str]] = field(default_factory=dict)

    def take(self, f: Filter) -> bool:
        """Note a condition; False if it isn't one that the reader can hold."""
        if isinstance(f, IsNotNull) and f.attribute[0] in ("_time", "_field", "_measurement"):
            # rows without these aren't handed over
            return True
        if isinstance(f, (EqualTo, In)) and f.attribute[0] in ("_field", "_measurement"):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            known = self.names.get(f.attribute[0])
            self.names[f.attribute[0]] = values if known is None else known & values
            return True
        if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("_time",) and isinstance(f.value, datetime):
            at = f.value if f.value.tzinfo else f.value.astimezone()
            us = (at - EPOCH) // timedelta(microseconds=1)
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, us + isinstance(f, GreaterThan))
            else:
                self.high = min(self.high, us - isinstance(f, LessThan))
            return True
        return False

    def reaches(self, part: Part) -> bool:
        named = (("_measurement", part.measurements), ("_field", part.fields))
        return part.first_us <= self.high and part.last_us >= self.low and all(have is None or name not in self.names or self.names[name] & set(have) for name, have in named)

    def of(self, rows: pa.Table) -> pa.Table:
        us = rows.column("_time").cast(pa.int64())
        keep = pc.and_(pc.greater_equal(us, self.low), pc.less_equal(us, self.high))
        for name, values in self.names.items():
            keep = pc.and_(keep, pc.is_in(rows.column(name), pa.array(sorted(values), pa.string())))
        return rows.filter(keep)


def lines(path: str, low: int, high: int) -> Iterator[bytes]:
    """The data lines of a part in chunks, each with the file's header before it."""
    with open(path, "rb") as f:
        header = b"#"
        while header.startswith(b"#") or not header.strip():
            header = f.readline()
            if not header:
                return
        # from the first line that begins in the part, behind the header
        f.seek(max(low, f.tell()) - 1)
        f.readline()
        at = f.tell()
        while at < high:
            chunk = f.read(min(BATCH, high - at))
            # a line that begins in the part is the part's
            chunk += f.readline() if not chunk.endswith(b"\n") else b""
            if not chunk:
                return
            at = f.tell()
            if chunk.startswith((b"#", b"\n", b"\r")) or b"\n#" in chunk or b"\n\n" in chunk or b"\n\r" in chunk:
                chunk = b"".join(x for x in chunk.splitlines(True) if x.strip() and not x.startswith(b"#"))
            if chunk:
                yield header + chunk


def rows_of(path: str, low: int, high: int) -> Iterator[pa.Table]:
    """The rows of a part that have a measurement, a field and a time, chunk by chunk."""
    convert = pa.csv.ConvertOptions(include_columns=list(NAMES), column_types={"_measurement": pa.string(), "_field": pa.string(), "_value": pa.float64(), "_time": pa.string()}, null_values=[""], strings_can_be_null=True)
    for chunk in lines(path, low, high):
        made = pa.csv.read_csv(io.BytesIO(chunk), read_options=pa.csv.ReadOptions(use_threads=False), convert_options=convert)
        text = made.column("_time")
        zoned = pc.if_else(pc.match_substring_regex(text, r"(?:[Zz]|[+-]\d\d:?\d\d)$"), text, pc.binary_join_element_wise(text, "Z", ""))
        times = zoned.cast(pa.timestamp("ns", "UTC")).cast(pa.timestamp("us", "UTC"), safe=False)
        table = made.set_column(made.schema.get_field_index("_time"), "_time", times).select(list(NAMES)).cast(ROWS)
        yield table.filter(pc.and_(pc.and_(table.column("_measurement").is_valid(), table.column("_field").is_valid()), table.column("_time").is_valid()))


class FieldFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "_measurement string, _field string, _value double, _time timestamp"

    def reader(self, schema) -> FieldReader:
        return FieldReader([Part(*p) for p in json.loads(self.options["parts"])])


class FieldReader(DataSourceReader):
    """Reads ``parts`` of files, whose paths all executors can open."""

    def __init__(self, parts: list[Part]):
        self.parts, self.wanted = parts, Wanted()

    def pushFilters(self, filters):
        return [f for f in filters if not self.wanted.take(f)]

    def partitions(self) -> list[Part]:
        return [p for p in self.parts if self.wanted.reaches(p)] or [Part("", 0, 0, 0, 0, None, None)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.file:
            for rows in rows_of(partition.file, partition.low, partition.high):
                yield from self.wanted.of(rows).to_batches()


def parts(spark: SparkSession, files: list[str], size: int = PART) -> DataFrame:
    """What the files hold, part by part, found by one task a part: the columns of ``PARTS``."""

    def pieces(batches):
        import os

        for batch in batches:
            for path in batch.column("file").to_pylist():
                whole = os.path.getsize(path)
                at = list(range(0, max(whole - size // 2, 1), size))
                yield pa.RecordBatch.from_pydict({"file": [path] * len(at), "low": at, "high": [*at[1:], whole]})

    def described(batches):
        for batch in batches:
            for p in batch.to_pylist():
                first = last = None
                have: dict[str, set[str]] = {"_measurement": set(), "_field": set()}
                for rows in rows_of(p["file"], p["low"], p["high"]):
                    if rows.num_rows:
                        ends = pc.min_max(rows.column("_time").cast(pa.int64())).as_py()
                        first, last = min(ends["min"], first if first is not None else ends["min"]), max(ends["max"], last if last is not None else ends["max"])
                        for name, known in have.items():
                            known |= set(rows.column(name).unique().to_pylist())
                if first is not None:
                    own = [sorted(x) if len(x) <= FIELDS else None for x in have.values()]
                    yield pa.RecordBatch.from_pydict({"file": [p["file"]], "low": [p["low"]], "high": [p["high"]], "first_us": [first], "last_us": [last], "measurements": pa.array([own[0]], pa.list_(pa.string())), "fields": pa.array([own[1]], pa.list_(pa.string()))})

    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), 1000))
    cut = listed.mapInArrow(pieces, "file string, low long, high long")
    return cut.repartition(spark.sparkContext.defaultParallelism, "file", "low").mapInArrow(described, PARTS)


def open_files(spark: SparkSession, files: list[str], size: int = PART) -> DataFrame:
    """The rows of the files.  A row a part comes to the driver, as Spark's own list of files does."""
    # filters reach a Python data source only with this setting
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FieldFiles)
    known = sorted([list(r) for r in parts(spark, files, size).collect()], key=lambda p: (p[3], p[0], p[1]))
    return spark.read.format(FORMAT).options(parts=json.dumps(known)).load()
