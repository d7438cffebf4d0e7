"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs; all but the last keep the columns of documents.  When a stage begins, what came before
has been written, so the work tables of the stage before it are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm import common, copies, cotraining, lines, mixing, packing, queries

_before: list[str] = []


def _stage(function):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.small_batches(spark)
        common.reclaim(spark, _before)
        with common.noted(_before):
            return function(spark, docs, sf_dir)

    run.__doc__, run.__name__ = function.__doc__, function.__name__
    return run


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written with a number that tells rows apart whose ids are null or the same, and its column's name."""
    (name,) = common.unused(docs.columns, "_row")
    return common.persist(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    labels = cotraining.labels_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotraining.keep_good(docs, labels)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; documents stay, if without text.

    Earlier means in a smaller id, null ids first; rows of one id are told apart, in the order they stand in.
    """
    (at,) = common.unused(docs.columns, "_at")
    order = [F.col("doc_id").cast("long"), F.col(at)]
    own = docs.withColumn(at, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows, name = _numbered(own.drop(at))
    return lines.remove_lines(rows, lines.duplicate_lines(rows, id_col=name), id_col=name, unique=True).drop(name)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles of similarity 0.8 the one with the least id stays."""
    rows, name = _numbered(docs)
    return rows.join(copies.heads(rows, name).withColumnRenamed("row", name), name, "left_semi").drop(name)


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum's order: documents as often as it takes them, those that it leaves out go."""
    rows, name = _numbered(docs)
    return mixing.order(rows, mixing.plan(rows, row_col=name), row_col=name).drop(name)


@_stage
def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequences and offsets."""
    return packing.pack(docs, queries.tokenizer())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mixing", source_mixing),
    ("sequence packing", sequence_packing),
]

#: Models and tokens are beyond SQL; near dedup is tested against all pairs, line dedup and mixing on rows with null
#: and repeated ids, and all stages in turn on a small table whose results are written down.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.persist(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
