"""Run a sequence of chart queries on a session and write what each took.

    python -m tracelens.plans.experiments --path events.parquet --out results --count 50 --cache /shared/cache
"""

from __future__ import annotations

import argparse
import os
import time
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from ..model import Query
from ..sources import sinks
from ..sources.series import CsvConfig, TableConfig, open_source
from . import workload
from .session import VizSession

COLUMNS = [c.split()[0] for c in sinks.LOG.split(", ")]


def run(session: VizSession, queries: Iterable[Query], dataset: str, path: str | None = None) -> list[dict]:
    """One record per query, as the log has them; written below ``path`` if that is given.

    progressive_s is the time to the points, processing_s what of it wasn't fetching; results_size counts
    points and memory_bytes is what the session's cached rows take.  If a prefetch failed, its error is raised and no
    log is written, for the times would be those of another setting.
    """
    records = []
    for k, query in enumerate(queries):
        began = time.time()
        answer = session.query(query)
        size = answer.points.count()
        took = time.time() - began
        values = (dataset, k, query.width, query.height, query.start, query.end, _shown(query), size, answer.io_count, took, answer.seconds, answer.seconds - answer.query_seconds, answer.query_seconds, session.catalog.memory_bytes())
        records.append(dict(zip(COLUMNS, values)))
    session.settle(strict=True)
    if path:
        sinks.write_log(session.spark, [tuple(r.values()) for r in records], path)
    return records


def _shown(query: Query) -> str:
    return " - ".join(datetime.fromtimestamp(t // 1000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S") + f".{t % 1000:03d}" for t in (query.start, query.end))


def main(arguments: list[str] | None = None) -> list[dict]:
    p = argparse.ArgumentParser(description="Run chart queries and write their times.")
    p.add_argument("--path", required=True, help="a long Parquet table, or a wide CSV file or folder with --time-col")
    p.add_argument("--time-col")
    p.add_argument("--measure-col")
    p.add_argument("--value-col")
    p.add_argument("--out", required=True, help="folder of the log")
    p.add_argument("--cache", help="folder of the cached groups, shared by all executors; spark.checkpoint.dir if left out")
    p.add_argument("--catalog", help="a name under which what is cached outlives the run")
    p.add_argument("--ranges", help="with --time-col: a folder in which the times of CSV files are kept")
    p.add_argument("--strict", action="store_true", help="bound what the documented bound leaves out, too")
    p.add_argument("--queries", help="a file of from,to rows to replay instead of a generated sequence")
    p.add_argument("--measures", default="", help="names with commas between them; all if left out")
    for name, kind, default in (("--count", int, 50), ("--seed", int, 42), ("--width", int, 1000), ("--height", int, 600), ("--accuracy", float, 0.95), ("--share", float, 0.1), ("--prefetch", float, 0.0), ("--factor", int, 4), ("--zoom", float, 2.0)):
        p.add_argument(name, type=kind, default=default)
    a = p.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    is_csv = a.time_col and not a.measure_col
    source = open_source(spark, CsvConfig(a.path, a.time_col, ranges=a.ranges) if is_csv else TableConfig(a.path, a.measure_col, a.time_col, a.value_col))
    cache = a.cache or spark.conf.get("spark.checkpoint.dir", None)
    if not cache:
        p.error("name a --cache folder or set spark.checkpoint.dir")
    session = VizSession(source, cache, initial_factor=a.factor, prefetch=a.prefetch, catalog=a.catalog, strict=a.strict)
    settings = {"width": a.width, "height": a.height, "accuracy": a.accuracy, "measures": tuple(filter(None, a.measures.split(",")))}
    if a.queries:
        asked = workload.replay(a.queries, **settings)
    else:
        first = workload.first_query(session.extent, a.share, **settings)
        asked = [q for _, q in workload.sequence(first, session.extent, a.count, a.seed, zoom_factor=a.zoom)]
    return run(session, asked, os.path.basename(a.path.rstrip("/")), a.out)


if __name__ == "__main__":
    main()
