"""Substring dedup by content-defined chunking: a gear rolling hash cuts, digests find repeated chunks.

A cut depends on the 16 bytes before it alone, so text that stands anywhere else, or moves by an insertion,
falls into the same chunks.  Passages are runs of chunks whose digests occurred earlier.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, persist, release, split_join, text_bytes, unused

#: log2 of the mean number of words in a chunk.
BITS = 2
MAX_BYTES = 4096
#: A repeated passage is removed from so many words in whole chunks on.  About 8 more words of it lie in the
#: chunks at its two ends, which hold foreign words too: 51 words are missed once in 120 times, 60 once in 1,000.
MIN_WORDS = 24

#: The gear table: 256 numbers by a rule.
GEAR = mix64(np.arange(1, 257)).astype(np.uint16)
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

CHUNKS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("start", pa.int32()), ("length", pa.int16()), ("words", pa.int16()), ("digest", pa.int64())])
CHUNKS_SQL = "row long, doc_id long, chunk int, start int, length short, words short, digest long"


def cuts(data: bytes, bits: int = BITS, longest: int = MAX_BYTES) -> np.ndarray:
    """Ends of the chunks of ``data``, the last one its length.

    The gear hash h = 2 h + gear[byte], kept to 16 bits, is the sum of the last 16 bytes' numbers shifted by
    their distance; four doublings give it at all places at once.  A chunk ends after a white-space byte
    where the top ``bits`` bits are 0, or after ``longest`` bytes without one.
    """
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    ends = np.flatnonzero(SPACES[raw] & (h >> np.uint16(16 - bits) == 0)) + 1
    ends = np.append(ends[ends < len(raw)], len(raw)) if len(raw) else np.empty(0, np.int64)
    gaps = np.diff(ends, prepend=0)
    if len(gaps) and gaps.max() > longest:
        forced = [np.arange(e - g + longest, e, longest) for e, g in zip(ends[gaps > longest], gaps[gaps > longest])]
        ends = np.sort(np.concatenate([ends, *forced]))
    return ends


def chunk(docs: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row, doc_id, chunk, start and length in bytes of UTF-8, words, 64-bit digest; none for empty or null texts.

    row is ``row_col`` or else a number that tells rows apart.  Chunks of blanks alone are left out, and the
    others are numbered without them.
    """

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for row, doc_id, data in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), text_bytes(batch)):
                at = k = 0
                for end in cuts(data, bits).tolist():
                    # blanks at the ends don't count, so a passage's last chunk may meet another blank
                    part = data[at:end].strip()
                    if part:
                        rows.append((row, doc_id, k, at, end - at, len(part.split()), xxhash.xxh3_64_intdigest(part) - (1 << 63)))
                        k += 1
                    at = end
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CHUNKS)], schema=CHUNKS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CHUNKS)], schema=CHUNKS)

    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    return docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, CHUNKS_SQL)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """The passages to remove: doc_id, span, start, end (bytes of UTF-8), n_words, n_chunks, first_doc_id, and
    row if ``row_col``, a number that tells rows apart, is given.

    A chunk is repeated if its digest occurred before, in a row of a smaller doc_id (null ids first, rows of one
    id in any order) or earlier in the same text; the first one stays.  Repeated chunks that follow one another
    form a span, and spans of ``min_words`` words or more are returned, with the document that holds the first
    occurrence of their first chunk.  Whole copies are one span.  Spans are numbered per row.  Rows without
    repeated passages have none; null and empty texts neither.
    """
    stored = persist(chunk(docs, bits, id_col, text_col, row_col), "chunks")
    # partial minima travel, one per digest and task
    seen = stored.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "chunk")).alias("first")).filter("n > 1")
    seen = persist(seen, "digests")
    release(docs.sparkSession)
    again = split_join(stored, seen, "digest", "n").filter((F.col("first.row") != F.col("row")) | (F.col("first.chunk") != F.col("chunk")))
    runs = again.withColumn("run", F.col("chunk") - F.row_number().over(Window.partitionBy("row").orderBy("chunk")))
    spans = runs.groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("start").cast("long").alias("start"),
        F.max(F.col("start") + F.col("length")).cast("long").alias("end"),
        F.sum("words").cast("int").alias("n_words"),
        F.count("*").cast("int").alias("n_chunks"),
        F.min(F.struct("chunk", F.col("first.doc_id").alias("doc"))).alias("source"),
    )
    number = Window.partitionBy("row").orderBy("start")
    out = spans.filter(F.col("n_words") >= min_words).withColumn("span", F.row_number().over(number) - 1)
    return out.select("doc_id", "span", "start", "end", "n_words", "n_chunks", F.col("source.doc").alias("first_doc_id"), *(["row"] if row_col else []))


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``docs`` with the bytes of their spans cut out of the text; other rows and columns as they were.

    With ``row_col`` rows meet the spans that ``repeated_spans`` found for them.  Without it they meet by id,
    which must tell them apart: an id on two rows cuts the spans of both out of each.
    """
    own, found = unused(docs.columns, "_own", "_spans")
    key = "row" if row_col else "doc_id"
    per_doc = spans.groupBy(F.col(key).alias(own)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(found))
    data = F.col(text_col).cast("binary")
    piece = lambda a, s: F.substring(data, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
    kept = F.aggregate(found, F.struct(F.lit(b"").alias("out"), F.lit(0).cast("long").alias("at")), lambda a, s: F.struct(F.concat(a["out"], piece(a, s)).alias("out"), F.greatest(a["at"], s["end"]).alias("at")))
    rest = F.concat(kept["out"], F.substring(data, (kept["at"] + 1).cast("int"), F.octet_length(data)))
    joined = docs.join(per_doc, F.col(row_col or id_col).cast("long").eqNullSafe(F.col(own)), "left")
    return joined.select(*[F.when(F.col(found).isNull(), F.col(c)).otherwise(rest.cast("string")).alias(c) if c == text_col else F.col(c) for c in docs.columns])
