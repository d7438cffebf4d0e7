"""What the corpus operators share: the shared work folder, words, and joins that survive hot keys."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_written: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracelens-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def persist(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and lost executors lose nothing.

    The values of the columns ``folders`` get a folder each, so that one can be deleted before the others.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tracelens/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noted(paths: list[str]):
    """Add to ``paths`` what ``persist`` writes meanwhile."""
    at = len(_written)
    try:
        yield
    finally:
        paths += _written[at:]


def reclaim(spark: SparkSession, paths: list[str]) -> None:
    """Delete the tables at ``paths`` and empty the list; what still reads them must have been written before."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(hadoop).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what was written: it does when the driver's JVM collects their handles.

    The scheduler holds on to the last job's handles until the next one, so a job of one row goes before.
    """
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


def split_join(rows: DataFrame, side: DataFrame, key: str, weight: str, how: str = "inner", parts: int = 10_000) -> DataFrame:
    """Equi-join of ``rows`` with ``side`` (one row per key), where ``side[weight]`` is the key's row count.

    Keys with more than 1/parts of all counted rows are at most ``parts``, whatever the input: that bounded
    part of ``side`` is broadcast.  The other keys are shuffled, and none of them is hot.
    """
    total = side.agg(F.sum(weight)).first()[0] or 0
    limit = max(total // parts, 1)
    hot = side.filter(F.col(weight) > limit).withColumn("_hot", F.lit(True))
    cold = side.filter(F.col(weight) <= limit).drop(weight)
    marked = rows.join(F.broadcast(hot.drop(weight)), key, "left")
    extra = [c for c in side.columns if c not in (key, weight)]
    warm = marked.filter("_hot").drop("_hot")
    rest = marked.filter("_hot is null").drop("_hot", *extra).join(cold, key, how)
    return warm.unionByName(rest)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each lengthened until none of ``columns`` has it; column names know no case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null counts as empty."""
    return [t or b"" for t in batch.column(column).to_pylist()]


def slices(batches, rows: int = 256):
    """Batches in parts of at most ``rows`` rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordHash(dict):
    """64-bit hashes of words, kept for the most recent ones; ``bytes.split`` yields the contracts' words."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One cache per Python worker, reused by its later tasks.
WORDS = WordHash()


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python 1,000 at a time instead of 10,000, for those are up to 64 MB on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def as_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text as bytes travel to Python."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
