"""Sum-of-squares packing of tokenised documents into sequences of fixed length.

Documents become pieces of at most ``capacity`` tokens.  A full piece is a sequence of its own; every other
one goes where the sum over residual gaps of the squared count of open sequences becomes smallest.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist

CAPACITY = 2048
#: Pieces that one task packs; what stays half full at its end is a few sequences in many thousands.
PIECES_PER_TASK = 40_000
KEPT_WORDS = 200_000

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@cache
def byte_letters() -> list[str]:
    """The byte-level alphabet of such vocabularies: visible Latin-1 characters stand for themselves, the other
    bytes for the characters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + rest.index(b)) for b in range(256)]


#: Words, digits and runs of other characters of a lower-cased Latin-1 text, as the vocabulary's splitter finds them.
LETTERS, DIGITS, BLANKS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\x09-\x0d\x20\x85\xa0"
TOKENS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{DIGITS}]|[^{BLANKS}{LETTERS}{DIGITS}]+")


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Kept(dict):
    """Values of ``make``, which are kept while they are among the last ``KEPT_WORDS`` new ones or were used since."""

    def __init__(self, make):
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


@cache
def encoder(path: str):
    """Ids of a text as little-endian 32-bit bytes, by words.

    All that the vocabulary's normaliser does to Latin-1 characters is lower-casing, and what its splitter finds
    in them is ``TOKENS``; so such a text is split into words at once, and the merge model encodes each
    once per worker while it is kept.  The normaliser and splitter never look across a blank, so the other texts,
    and those that spell out a special token, are taken by their blank-separated parts, and only parts beyond
    Latin-1 or with such a token go through the whole tokenizer.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(path), byte_letters()
    model = tokenizer.model
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def as_bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(token: str) -> bytes:
        spelled = token if token.isascii() and token.isalpha() else "".join([letters[b] for b in token.encode()])
        return as_bytes([t.id for t in model.tokenize(spelled)])

    def simple(text: str) -> bool:
        return latin(text) and not any(s in text for s in special)

    words = Kept(word)
    parts = Kept(lambda part: by_words(part) if simple(part) else as_bytes(tokenizer.encode(part, add_special_tokens=False).ids))

    def by_words(text: str) -> bytes:
        return b"".join(map(words.__getitem__, TOKENS.findall(text.lower())))

    def encode(text: str) -> bytes:
        return by_words(text) if simple(text) else b"".join(map(parts.__getitem__, text.replace("\n", " ").split(" ")))

    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's tokens and ``end_id``.

    A null or empty text is the end token alone.  Documents over ``capacity`` tokens are cut every
    ``capacity`` tokens.
    """
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(cut, PIECES_SQL)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum-of-squares placement of ``lengths`` in their order: (sequence, offset) of each.

    Moving a sequence from gap g to g - s changes the sum by 2 (N[g - s] - N[g]) + 2, filling it by
    1 - 2 N[g], opening one by 2 N[capacity - s] + 1; ties go to the smaller gap, and to an open sequence.
    """
    open_ = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = 0
    for i, s in enumerate(lengths.tolist()):
        rest = capacity - s
        gap, best = -1, 2 * int(open_[rest]) + 1 if rest else 0
        gaps = np.flatnonzero(open_[s:]) + s
        if len(gaps):
            change = 2 * (open_[gaps - s] - open_[gaps]) + 2
            if gaps[0] == s:
                change[0] = 1 - 2 * open_[s]
            k = int(change.argmin())
            if change[k] <= best:
                gap = int(gaps[k])
        if gap < 0:
            name, gap, count = count, capacity, count + 1
        else:
            name = stacks[gap].pop()
            open_[gap] -= 1
        sequence[i], offset[i] = name, capacity - gap
        if gap > s:
            stacks[gap - s].append(name)
            open_[gap - s] += 1
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, per_task: int = PIECES_PER_TASK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are dealt by a hash over as many tasks as ``per_task`` asks for and packed there longest first,
    ties by crc, id and piece, so that reruns agree however rows are split.  Repeated rows are packed as often
    as they occur: equal pieces are counted and dealt one by one, so that copies don't meet in one task.
    sequence_id is the task's number times 2**40 plus the sequence's in the task.  An empty table gives no rows.
    """
    stored = persist(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    tasks = max(1, -(-stored.filter(F.col("length") < capacity).count() // per_task))
    full = stored.filter(F.col("length") == capacity)
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    counted = stored.filter(F.col("length") < capacity).groupBy(*own).agg(F.count("*").alias("n"))
    single = counted.select(*own, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    dealt = single.withColumn("task", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "copy"), F.lit(tasks)).cast("int"))

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = place(table.column("length").to_numpy(), capacity)
        sequence += (key[0].as_py() + 1) << 40
        return table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    partial = dealt.groupBy("task").applyInArrow(fill, PACKED_SQL)
    alone = full.select(*own, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # ids of whole sequences are below those of packed ones as long as a table has under 2**31 partitions
    return alone.withColumn("sequence_id", -F.col("sequence_id") - 1).unionByName(partial)
