"""Ranked search over an inverted file whose postings lie in windows of documents.

A window holds a fixed number of documents at most, numbered from 0.  For a block of queries its postings are
traversed window by window: each query scatter-adds its terms' parts into an array with a number per document of the
window, small enough for a processor's cache, notes in a bitset which documents it met, and harvests those into
the query's heap of the best.
"""

from __future__ import annotations

import heapq
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import persist, slices
from .terms import letters, tally

#: Documents of a window; its scores take 64 KiB.  A window ends early at so many postings.
WINDOW, POSTINGS = 8_192, 4_000_000
#: Queries that traverse a window together.
BLOCK = 256
#: Stands for a null id, which comes last.
NO_ID = (1 << 63) - 1
#: Terms are the matches of [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+.
LETTERS = letters(string.digits + string.ascii_lowercase)

POSTS = pa.schema([("window", pa.int64()), ("term", pa.binary()), ("n", pa.int32()), ("at", pa.binary()), ("tf", pa.binary())])


class Numbers(dict):
    """Numbers words from 0 in the order they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def inverted(docs: DataFrame, id_col: str, text_col: str, window: int, postings: int) -> DataFrame:
    """Rows window, term, n, at, tf: the ``n`` documents of a window that hold a term (2 bytes each) and how often (4
    bytes), and a row without term per window: its documents' numbers of terms (``at``) and ids (``tf``), 8 bytes each.

    Documents without terms are left out.
    """

    def run(batches):
        from pyspark import TaskContext

        made = 0
        task = TaskContext.get().partitionId()
        vocabulary, ids, lengths, found, times, sizes, held = Numbers(), [], [], [], [], [], 0

        def close():
            number = (task << 32) + made
            words, tf = np.concatenate(found), np.concatenate(times)
            at = np.repeat(np.arange(len(sizes), dtype="<u2"), sizes)
            order = np.argsort(words, kind="stable")
            edges = np.searchsorted(words[order], np.arange(len(vocabulary) + 1))
            at, tf = at[order], tf[order].astype("<u4")
            whole = lambda x, width: pa.Array.from_buffers(pa.binary(), len(vocabulary), [None, pa.py_buffer((edges * width).astype("<i4").tobytes()), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([None], pa.binary()), pa.array([len(ids)], pa.int32()), pa.array([np.array(lengths, "<i8").tobytes()], pa.binary()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary())], schema=POSTS)
            columns = [pa.array(np.full(len(vocabulary), number)), pa.array(vocabulary.keys(), pa.binary()), pa.array(np.diff(edges).astype(np.int32)), whole(at, 2), whole(tf, 4)]
            yield from slices([pa.RecordBatch.from_arrays(columns, schema=POSTS)], 10_000)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                own = tally(text.as_py() or b"", LETTERS)
                if not own:
                    continue
                ids.append(doc)
                lengths.append(own.total())
                found.append(np.fromiter(map(vocabulary.__getitem__, own), np.int64, len(own)))
                times.append(np.fromiter(own.values(), np.int64, len(own)))
                sizes.append(len(own))
                held += len(own)
                if len(ids) == window or held >= postings:
                    yield from close()
                    made += 1
                    vocabulary, ids, lengths, found, times, sizes, held = Numbers(), [], [], [], [], [], 0
        if ids:
            yield from close()

    taken = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return taken.mapInArrow(run, "window long, term binary, n int, at binary, tf binary")


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (a number of the query), item_id, term: every query's distinct terms."""

    def run(batches):
        for batch in slices(batches):
            own = [list(tally(t or b"", LETTERS)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item_id"), pa.array(own, pa.list_(pa.binary()))], names=["row", "item_id", "terms"])

    taken = queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text")).withColumn("row", F.monotonically_increasing_id())
    return taken.mapInArrow(run, "row long, item_id long, terms array<binary>").select("row", "item_id", F.explode("terms").alias("term"))


def parts(tf: np.ndarray, weight: int, m: np.ndarray) -> np.ndarray:
    """What a term adds to the documents it is in."""
    tf = tf.astype(np.int64)
    return weight * ((1_000_000_000 * tf) // (1_000 * tf + 20 * m))


class Best:
    """A query's ``k`` best documents: highest score first, then the least id."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def harvest(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.heap) == self.k:
            open_ = scores >= self.heap[0][0]
            scores, ids = scores[open_], ids[open_]
        if len(scores) > self.k:
            order = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[order], ids[order]
        for entry in zip(scores.tolist(), (~ids).tolist()):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def traverse(k: int, docs: int, terms: int):
    """mapInArrow over rows (block, window, weight, asked, at, tf) in order of block and window, a window's documents
    first: row, doc_id, score of each query's ``k`` best within the task."""

    def run(batches):
        best: dict[int, Best] = {}
        place = (None, None)
        wanted: dict[int, list] = {}
        ids = m = None

        def score():
            """The window's postings, query by query."""
            if not wanted:
                return
            total = np.zeros(len(ids), np.int64)
            for row, some in wanted.items():
                met = np.zeros_like(some[0][2])
                for at, add, bits in some:
                    total[at] += add
                    met |= bits
                here = np.flatnonzero(np.unpackbits(met, count=len(ids)))
                values = total[here]
                total[here] = 0
                if row not in best:
                    best[row] = Best(k)
                best[row].harvest(values[values > 0], ids[here[values > 0]])
            wanted.clear()

        def emit():
            rows = [(row, ~doc, value) for row, own in best.items() for value, doc in own.heap]
            best.clear()
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "doc_id", "score"])

        for batch in slices(batches):
            for r in batch.to_pylist():
                if (r["block"], r["window"]) != place:
                    score()
                    if r["block"] != place[0]:
                        yield from emit()
                    place = (r["block"], r["window"])
                if r["asked"] is None:
                    ids = np.frombuffer(r["tf"], "<i8")
                    m = 100 - 50 + (50 * np.frombuffer(r["at"], "<i8") * docs) // terms
                    continue
                at = np.frombuffer(r["at"], "<u2").astype(np.int64)
                flags = np.zeros(len(ids), np.uint8)
                flags[at] = 1
                found = (at, parts(np.frombuffer(r["tf"], "<u4"), r["weight"], m[at]), np.packbits(flags))
                for row in r["asked"]:
                    wanted.setdefault(row, []).append(found)
        score()
        yield from emit()

    return run


def _sizes(batches):
    for batch in batches:
        terms = [int(np.frombuffer(x, "<i8").sum()) for x in batch.column("at").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array(terms, pa.int64())], names=["docs", "terms"])


def search(docs: DataFrame, queries: DataFrame, k: int = 50, window: int = WINDOW, postings: int = POSTINGS, block: int = BLOCK, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: every query's ``k`` best documents with a score above 0.

    Terms are runs of A-Z (lower-cased), a-z, 0-9 and non-ASCII characters of whole texts.  N documents have terms, L of
    them in all, n of them in one document; df documents hold a term, tf times one.  A term weighs
    w = floor(1000 * ln((2 N + 2) / (2 df + 1))), and with m = 50 + (50 n N) div L a document's score is the sum of
    w * ((10**9 tf) div (1000 tf + 20 m)) over the query's distinct terms.  Equal scores go by the least doc_id, null last.

    Null texts have no terms.  Rows that share an id are documents each, and so are queries that share one.  Queries
    without terms, terms in no document and an empty table of either kind give no rows.  The inverted file is a
    table in the shared folder; every window meets every block of queries, once.
    """
    spark = docs.sparkSession
    index = persist(inverted(docs, doc_id, doc_text, window, postings), "postings")
    lengths = index.filter("term is null").select("window", "n", "at", "tf")
    size = lengths.mapInArrow(_sizes, "docs int, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    asked = persist(query_terms(queries, item_id, item_text), "query-terms")
    names = asked.select("row", "item_id").distinct()
    blocks = max(1, -(-names.count() // block))
    posts = index.filter("term is not null")
    # (2 N + 2) / (2 df + 1) in doubles
    weight = F.floor(1000 * F.log(F.lit(2.0 * (size.docs or 0) + 2) / (2 * F.sum("n") + 1)))
    weights = posts.select("term", "n").join(asked.select("term").distinct(), "term").groupBy("term").agg(weight.alias("weight"))
    wanted = asked.groupBy("term", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")).agg(F.collect_list("row").alias("asked"))
    wanted = persist(wanted.join(weights, "term"), "weights")
    met = posts.drop("n").join(wanted, "term").select("block", "window", "weight", "asked", "at", "tf")
    every = lengths.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "window", F.lit(None).cast("long").alias("weight"), F.lit(None).cast("array<long>").alias("asked"), "at", "tf")
    dealt = every.unionByName(met).repartition("block", "window").sortWithinPartitions("block", "window", F.col("asked").isNotNull())
    found = persist(dealt.mapInArrow(traverse(k, size.docs, size.terms), "row long, doc_id long, score long"), "found")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).join(names, "row")
    return ranked.select("item_id", "rank", F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), "score")
