"""Line dedup by an exact set-similarity join.

A line is its set of words.  Words are ordered by rarity; two lines with Jaccard similarity t share a word
among the rarest n - ceil(t n) + 1 of each (prefix filter).  Shared words are posted in an inverted list where
a line only meets lines of fitting length (length filter) whose remaining words can still reach the overlap
(positional filter) and whose parity maps don't differ too much; the rest is verified exactly.  A line that
matches an earlier one is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, let, mix64, persist, slices, split_join, text_bytes, unused

SIMILARITY = 0.8
#: Word frequencies are kept in so many counters, words dealt to them by hash: any order of words that all
#: tasks share gives exact results, and a rare word's counter is seldom a frequent one's.
COUNTERS, SLICE = 1 << 20, 1 << 14
#: Bytes of text that are worked on at once.
CHUNK = 1 << 19
#: Partners that a line looks at per shared word in the first pass, and how many of them it proposes: those whose
#: parity maps differ least.
SCANNED, PROPOSALS = 32, 4
#: Of a line's proposed partners so many, those with the most shared words, are verified before the others.
FIRST = 2
#: Prefix words that a bucket holds on average: buckets grow in number with them, not in size.
BUCKET = 1 << 19
#: Prefix words that a task gathers, at least, before it deals them to buckets, and per bucket.
GATHERED, PER_ROW = 1 << 18, 64
#: Found partners that a task holds, beyond the proposals of every line, before it sorts out or hands on.
HELD = 1 << 20
#: Bits of the filter that sorts out, before a shuffle, lines in no proposed pair.
FILTER_BITS = 1 << 26
#: Lines with more words than this have parity maps of 128 bits, others of 64.
WIDE = 16
#: Bits of the filter for words that are posted again.
WORD_BITS = 1 << 20
#: A null id sorts before all others.
NO_ID = -(1 << 63)

LINES = "doc_id long, line int, sig long, n int, map long, map2 long, words binary"
LINES_ARROW = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("sig", pa.int64()), ("n", pa.int32()), ("map", pa.int64()), ("map2", pa.int64()), ("words", pa.binary())])
FIELDS = ("word", "doc", "line", "n", "place", "map", "sig", "wanted", "map2")
POSTS = "bucket int, " + ", ".join(f"{f} binary" for f in FIELDS)
PAIRS = "doc_id long, line int, match_doc_id long, match_line int, more boolean"

SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTER = mix64(np.arange(1000, 1256)) | np.uint64(1)
_powers = mix64(np.arange(5000, 5064)) | np.uint64(1)


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = mix64(np.arange(5000, 5000 + 2 * n)) | np.uint64(1)
    return _powers


def hashed_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in a byte array and where they start: letters weighted by place, scrambled."""
    blank = SPACES[raw]
    inside = ~blank
    begin = inside.copy()
    begin[1:] &= blank[:-1]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    at = np.flatnonzero(inside)
    first = np.flatnonzero(begin[at])
    place = at - np.repeat(starts, np.diff(np.append(first, len(at))))
    return mix64(np.add.reduceat(LETTER[raw[at]] * powers(int(place.max()) + 1)[place], first)), starts


def text_chunks(batches):
    """(ids, texts) of about CHUNK bytes; a longer text is a chunk of its own."""
    ids, texts, size = [], [], 0
    for batch in slices(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch)):
            ids.append(NO_ID if doc_id is None else doc_id)
            texts.append(text)
            size += len(text) + 1
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def frequencies(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """How often the words of each counter occur in the whole corpus (COUNTERS numbers, whatever its size)."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for _, texts in text_chunks(batches):
            h, _ = hashed_words(np.frombuffer(b"\n".join(texts), np.uint8))
            total += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        parts = np.minimum(total, 2**31 - 1).astype("<i4").reshape(-1, SLICE)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[k].tobytes() for k in some], pa.binary())], names=["slice", "counts"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for b in table.column("counts").to_pylist():
            total += np.frombuffer(b, "<i4")
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**31 - 1).astype("<i4").tobytes()], pa.binary())})

    rows = as_bytes(docs, id_col, text_col).mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()
    out = np.zeros(COUNTERS, np.int32)
    for r in rows:
        out[r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(r.counts, "<i4")
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """Classes of counts on a log scale; words of a class are ordered by their hash."""
    return np.minimum(np.log2(np.maximum(counts, 1)) * 100, 4095).astype(np.uint64)


def line_rows(docs: DataFrame, classes, id_col: str, text_col: str) -> DataFrame:
    """A row per line with a word: doc_id, line, sig (hash of its word set), n, map, map2, words.

    map is the parity of the words dealt to 64 places; longer lines also have the part of it in map2 that
    another bit of their words sets, which makes 128 places.

    words are 32-bit hashes in the shared order, rarest first.
    """

    def run(batches):
        seen = classes.value
        for ids, texts in text_chunks(batches):
            raw = np.frombuffer(b"\n".join(texts), np.uint8)
            h, starts = hashed_words(raw)
            if not len(h):
                continue
            breaks = np.flatnonzero(raw == 10)
            row = np.searchsorted(breaks, starts)
            begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
            first_row = np.searchsorted(breaks, begins)
            lines, row = np.unique(row, return_inverse=True)
            word = h >> np.uint64(32) | seen[(h & np.uint64(COUNTERS - 1)).astype(np.int64)] << np.uint64(32)
            for low in range(0, len(lines), 1 << 20):
                used = lines[low : low + (1 << 20)]
                x, y = np.searchsorted(row, [low, low + len(used)])
                # one key holds line, rarity and hash: sorting it orders the words of every line
                key = word[x:y] | (row[x:y] - low).astype(np.uint64) << np.uint64(44)
                key.sort()
                key = key[np.append(True, key[1:] != key[:-1])]
                n = np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=len(used))
                at = np.cumsum(n) - n
                words = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
                bit = mix64(words)
                flag = np.uint64(1) << (bit & np.uint64(63))
                parity = np.bitwise_xor.reduceat(flag, at)
                upper = np.where(n > WIDE, np.bitwise_xor.reduceat(np.where(bit & np.uint64(64) > 0, flag, np.uint64(0)), at), np.uint64(0))
                doc = np.searchsorted(first_row, used, "right") - 1
                own = words.tobytes()
                parts = [own[4 * a : 4 * (a + k)] for a, k in zip(at.tolist(), n.tolist())]
                sigs = [xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in parts]
                columns = [np.array(ids, np.int64)[doc], used - first_row[doc], sigs, n, parity.view(np.int64), upper.view(np.int64), parts]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, LINES_ARROW)], schema=LINES_ARROW)

    return as_bytes(docs, id_col, text_col).mapInArrow(run, LINES)


def prefix_length(n: np.ndarray, similarity: float) -> np.ndarray:
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def prefix_words(rows: DataFrame, similarity: float) -> int:
    """How many prefix words the lines have."""
    n = F.col("n")
    return rows.agg(F.sum(n - F.ceil(F.lit(similarity) * n - F.lit(1e-9)) + 1)).first()[0] or 0


def overlap_needed(total: np.ndarray, similarity: float) -> np.ndarray:
    return np.ceil(similarity / (1 + similarity) * total - 1e-9)


def slender(x: np.ndarray, types=("<u2", "<u4", "<i8")) -> np.ndarray:
    """``x`` in the narrowest of ``types`` that holds it; the reader tells by the number of bytes."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    return x.astype(next(t for t in types if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def widened(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, {2: "<u2", 4: "<u4", 8: "<i8"}[len(data) // count]).astype(np.int64)


def posts(rows: DataFrame, buckets: int, similarity: float, only=None) -> DataFrame:
    """Prefix words of the lines, dealt to buckets by word; ``wanted`` marks lines to find partners for.

    A task posts lines of an equal word set once, or again when an earlier one comes.  A row holds what many lines
    post to a bucket, so that rows don't shrink as buckets grow in number.  ``only`` is a broadcast array of flags
    by word hash, for the words that are to be posted.
    """

    def dealt(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        word, doc, line, n, place, parity, sig, wanted, upper = map(np.concatenate, zip(*held))
        bucket = (mix64(word) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        columns = [c[order] for c in (word, slender(doc, ("<u4", "<i8")), slender(line), slender(n), slender(place), parity, sig, wanted, upper)]
        out = [(b, *[c[x:y].tobytes() for c in columns]) for b, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), *[pa.binary()] * len(FIELDS)])], names=["bucket", *FIELDS])

    def run(batches):
        posted: dict[int, tuple[int, int]] = {}
        held, size = [], 0
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.int64)
            doc, line, sig = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "line", "sig"))
            if len(posted) > 300_000:
                posted = {}
            fresh = []
            for i, (s, d, k) in enumerate(zip(sig.tolist(), doc.tolist(), line.tolist())):
                if s not in posted or (d, k) < posted[s]:
                    posted[s] = (d, k)
                    fresh.append(i)
            some = np.array(fresh, np.int64)
            # at 0.8 and above, sets of fewer than 4 words match equal sets only
            some = some[n[some] >= 4] if similarity >= 0.8 else some
            if not len(some):
                continue
            prefix = prefix_length(n, similarity)[some]
            _, offsets, data = batch.column("words").buffers()
            starts = np.frombuffer(offsets, "<i4")[batch.column("words").offset :][some] // 4
            place = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
            word = np.frombuffer(data, "<u4", len(data) // 4)[np.repeat(starts, prefix) + place]
            owner = np.repeat(some, prefix)
            if only is not None:
                kept = only.value[word & np.uint32(WORD_BITS - 1)]
                word, place, owner = word[kept], place[kept], owner[kept]
                if not len(word):
                    continue
            parity, upper = (batch.column(c).to_numpy() for c in ("map", "map2"))
            wanted = batch.column("wanted").to_numpy().astype("u1")
            held.append((word, doc[owner], line[owner], n[owner], place, parity[owner], (sig[owner] & 0xFFFFFFFF).astype("<u4"), wanted[owner], upper[owner]))
            size += len(word)
            if size >= max(GATHERED, PER_ROW * buckets):
                yield dealt(held)
                held, size = [], 0
        if held:
            yield dealt(held)

    return rows.mapInArrow(run, POSTS)


def nearest(found: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
    """Of (x, y, bits apart) the ``most`` least of every x, in order; those found first come first."""
    x, y, apart = map(np.concatenate, zip(*found))
    order = np.lexsort((apart, x))
    x = x[order]
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    kept = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x)))) < most
    order = order[kept]
    return x[kept], y[order], apart[order]


def pairs_of(similarity: float, most: int | None):
    """applyInArrow over a bucket: a line, an earlier line that passes all filters, and whether there were more.

    Lists are sorted by length.  Each wanted line steps away from its place, one neighbour at a time on both
    sides, while the length filter holds; with ``most`` it stops once SCANNED earlier partners passed, and
    proposes the ``most`` nearest of them.  Whenever HELD partners are found, those that aren't among the nearest
    go, or without ``most`` all are handed on.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in FIELDS]
        for row in (row for batch in batches for row in zip(*(batch.column(f).to_pylist() for f in FIELDS))):
            count = len(row[0]) // 4
            for k, data in enumerate(row):
                parts[k].append(np.frombuffer(data, {0: "<u4", 5: "<u8", 6: "<u4", 7: "u1", 8: "<u8"}[k]) if k in (0, 5, 6, 7, 8) else widened(data, count))
        word, doc, line, n, place, parity, sig, wanted, upper = (np.concatenate(p) for p in parts)
        del parts
        alone = lambda key: np.append(True, key[1:] != key[:-1])
        # by word, length (beyond 16 bits the rest of it follows) and part of the set's hash
        key = word.astype(np.uint64) << np.uint64(32) | np.minimum(n, 65535).astype(np.uint64) << np.uint64(16) | (sig & np.uint32(65535)).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        lists = np.cumsum(alone(word[order])) - 1
        order = order[np.bincount(lists)[lists] > 1]
        # of equal word sets the earliest stays, whatever the others ask for
        k = key[order]
        again = np.append(False, k[1:] == k[:-1])[: len(k)]
        group = np.cumsum(~again) - 1
        many = np.bincount(group)[group] > 1 if len(group) else again
        some = order[many]
        some = some[np.lexsort((line[some], doc[some], parity[some], sig[some], n[some], word[some]))]
        twin = np.append(False, np.logical_and.reduce([c[some][1:] == c[some][:-1] for c in (word, n, sig, parity)])) if len(some) else np.empty(0, bool)
        stays = ~many
        order[many] = some
        stays[many] = ~twin
        order = order[stays]
        if len(n) and n.max() > 65535:
            order = order[np.lexsort((n[order], word[order]))]
        word, doc, line, n, place, parity, wanted, upper = (c[order] for c in (word, doc, line, n, place, parity, wanted, upper))
        total = len(word)
        got = np.zeros(total, np.int64)
        found, held = [], 0

        def told(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(x), HELD // 16):
                i, j = x[at : at + HELD // 16], y[at : at + HELD // 16]
                more = got[i] > most if most is not None else np.zeros(len(i), bool)
                columns = [doc[i], line[i].astype(np.int32), doc[j], line[j].astype(np.int32), more]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "line", "match_doc_id", "match_line", "more"])

        walking = {side: np.flatnonzero(wanted) for side in (-1, 1)}
        gap = 0
        while len(walking[-1]) or len(walking[1]):
            gap += 1
            for side in (-1, 1):
                x = walking[side]
                if most is not None:
                    x = x[got[x] < SCANNED]
                y = x + side * gap
                fits = (y >= 0) & (y < total)
                x, y = x[fits], y[fits]
                fits = (word[x] == word[y]) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9)
                x, y = x[fits], y[fits]
                walking[side] = x
                a, b = n[x], n[y]
                need = overlap_needed(a + b, similarity)
                fine = np.bitwise_count(parity[x] ^ parity[y]) <= a + b - 2 * need
                x, y, a, b, need = x[fine], y[fine], a[fine], b[fine], need[fine]
                both = (a > WIDE) & (b > WIDE)
                high = np.where(both, upper[x] ^ upper[y], np.uint64(0))
                apart = np.bitwise_count(parity[x] ^ parity[y] ^ high).astype(np.int64) + np.bitwise_count(high)
                fine = apart <= a + b - 2 * need
                x, y, a, b, need, apart = x[fine], y[fine], a[fine], b[fine], need[fine], apart[fine]
                p, q = place[x], place[y]
                fine = (np.minimum(a - p, b - q) >= need - np.minimum(p, q)) & ((doc[y] < doc[x]) | (doc[y] == doc[x]) & (line[y] < line[x]))
                x, y = x[fine], y[fine]
                got[x] += 1
                if len(x):
                    found.append((x.astype(np.int32), y.astype(np.int32), apart[fine].astype(np.uint8)))
                    held += len(x)
            if held >= HELD:
                if most is None:
                    yield from told(*map(np.concatenate, list(zip(*found))[:2]))
                    found = []
                else:
                    found = [nearest(found, most)]
                held = 0
        if found:
            yield from told(*(map(np.concatenate, list(zip(*found))[:2]) if most is None else nearest(found, most)[:2]))

    return run


def posted_words(rows: DataFrame, similarity: float) -> np.ndarray:
    """Flags by word hash of the prefix words of ``rows``: WORD_BITS / 8 bytes, however many rows."""

    def run(batches):
        flags = np.zeros(WORD_BITS, bool)
        for batch in batches:
            for n, words in zip(prefix_length(batch.column("n").to_numpy().astype(np.int64), similarity).tolist(), batch.column("words").to_pylist()):
                flags[np.frombuffer(words, "<u4", n) & np.uint32(WORD_BITS - 1)] = True
        slots = np.packbits(flags, bitorder="little").view("<i8")
        some = np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(slots[some])], names=["slot", "bits"])

    out = np.zeros(WORD_BITS // 64, np.int64)
    for r in rows.select("n", "words").mapInArrow(run, "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).collect():
        out[r.slot] = r.bits
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def filter_bits(pairs: DataFrame) -> DataFrame:
    """slot, bits: a bit map of the lines in ``pairs``, 64 bits a row, FILTER_BITS / 64 rows at most."""
    both = pairs.select("doc_id", "line").union(pairs.select("match_doc_id", "match_line"))
    at = both.select(F.pmod(F.xxhash64("doc_id", "line"), F.lit(FILTER_BITS)).alias("b"))
    return at.select((F.col("b") / 64).cast("int").alias("slot"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def verify(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose Jaccard similarity, of 32-bit word hashes, is at least ``similarity``."""
    key = F.struct("doc_id", "line").alias("key")
    names = pairs.select(key, F.struct(F.col("match_doc_id").alias("doc_id"), F.col("match_line").alias("line")).alias("other"), "more")
    uses = persist(names.select("key").union(names.select("other")).groupBy("key").agg(F.count("*").alias("c")), "uses")
    slots = filter_bits(pairs)
    hashed = rows.select("doc_id", "line", "words", F.pmod(F.xxhash64("doc_id", "line"), F.lit(FILTER_BITS)).alias("b"))
    # 2**20 rows of 16 bytes at most, whatever the input
    near = hashed.join(F.broadcast(slots), (F.col("b") / 64).cast("int") == F.col("slot")).filter(F.expr("(shiftright(bits, cast(b % 64 as int)) & 1L) = 1"))
    sets = persist(near.select(key, "words").join(uses, "key").groupBy("key").agg(F.first("words").alias("words"), F.first("c").alias("c")), "sets")
    first = split_join(names, sets.select("key", F.col("words").alias("mine"), "c"), "key", "c")
    both = split_join(first, sets.select(F.col("key").alias("other"), F.col("words").alias("theirs"), "c"), "other", "c")

    def run(batches):
        for batch in batches:
            fine = []
            for a, b in zip(batch.column("mine").to_pylist(), batch.column("theirs").to_pylist()):
                x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                merged = np.sort(np.concatenate([x, y]))
                shared = int((merged[1:] == merged[:-1]).sum())
                fine.append(shared >= similarity * (len(merged) - shared) - 1e-9)
            names_ = ["doc_id", "line", "match_doc_id", "match_line", "more"]
            yield batch.select(names_).filter(pa.array(fine, pa.bool_()))

    flat = both.select("key.doc_id", "key.line", F.col("other.doc_id").alias("match_doc_id"), F.col("other.line").alias("match_line"), "more", "mine", "theirs")
    return flat.mapInArrow(run, PAIRS)


def duplicate_lines(docs: DataFrame, similarity: float = SIMILARITY, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines to remove: doc_id, line (from 0), match_doc_id, match_line, an earlier line that it matches.

    Lines are what ``\\n`` separates; those without a word are never removed, and null or empty texts have
    none.  Earlier means a smaller (doc_id, line).  A line is removed if its word set has Jaccard similarity
    of at least ``similarity`` with that of any earlier line, removed or not; for lines with an equal set the
    match is the first of them.  Words are told apart by 32 bits of their hash and the class of their
    frequency.  A null doc_id comes before all others.  Repeated rows (an id twice) count as one document.
    """
    classes = docs.sparkSession.sparkContext.broadcast(rarity(frequencies(docs, id_col, text_col)))
    rows = persist(line_rows(docs, classes, id_col, text_col), "lines")
    buckets = buckets or max(min(max(24, docs.rdd.getNumPartitions()), 4096), -(-prefix_words(rows, similarity) // BUCKET))
    # equal sets: the first line of every set stands for it
    first = rows.groupBy("sig").agg(F.min(F.struct("doc_id", "line")).alias("f"), F.count("*").alias("c")).filter("c > 1")
    first = persist(first, "sets-first")
    here = F.struct("doc_id", "line")
    copies = split_join(rows.select("sig", "doc_id", "line"), first, "sig", "c").filter(here != F.col("f")).select("doc_id", "line", F.col("f.doc_id").alias("match_doc_id"), F.col("f.line").alias("match_line"))

    own, pair = ["doc_id", "line"], ["doc_id", "line", "match_doc_id", "match_line"]

    def propose(frame: DataFrame, most: int | None, only=None) -> DataFrame:
        made = posts(frame, buckets, similarity, only).groupBy("bucket").applyInArrow(pairs_of(similarity, most), PAIRS)
        return persist(made.groupBy(*pair).agg(F.max("more").alias("more"), F.count("*").alias("votes")), "pairs")

    pairs = propose(rows.withColumn("wanted", F.lit(1)), PROPOSALS)
    likely = Window.partitionBy(*own).orderBy(F.desc("votes"), "match_doc_id", "match_line")
    turns = persist(pairs.withColumn("turn", F.row_number().over(likely)), "turns")
    sure = persist(verify(turns.filter(F.col("turn") <= FIRST), rows, similarity), "sure")
    # lines that failed with these try their other partners, and all of them where a list held more
    failed = persist(turns.join(sure.select(*own).distinct(), own, "left_anti"), "failed")
    rest = failed.filter(F.col("turn") > FIRST).select(*pair, "more")
    open_ = persist(failed.filter("more").select(*own).distinct(), "open")
    if not open_.isEmpty():
        again = rows.join(open_.withColumn("w", F.lit(1)), own, "left").withColumn("wanted", F.coalesce("w", F.lit(0))).drop("w")
        words = docs.sparkSession.sparkContext.broadcast(posted_words(rows.join(open_, own, "left_semi"), similarity))
        rest = persist(rest.unionByName(propose(again, None, words).select(*pair, "more")).distinct(), "rest")
    if not rest.isEmpty():
        sure = persist(sure.unionByName(verify(rest, rows, similarity)), "sure")
    near = sure.groupBy("doc_id", "line").agg(F.min(F.struct("match_doc_id", "match_line")).alias("m")).select("doc_id", "line", "m.match_doc_id", "m.match_line")
    # a line may be both a copy and near an even earlier line: the copy's match is told
    near = near.join(copies.select(*own), own, "left_anti")
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return copies.unionByName(near).select(named("doc_id"), "line", named("match_doc_id"), "match_line").distinct()


def remove_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text", unique: bool = False) -> DataFrame:
    """``docs`` without the removed lines; rows and other columns stay, an emptied text becomes the empty string.

    ``removed`` names documents by id, so it says nothing sure of a row whose id is null or also on another
    row: such rows keep all their lines, unless the caller knows that ids are ``unique``.  Number the rows and
    take that number as the id to have them cleaned.
    """
    own, gone = unused(docs.columns, "_own", "_gone")
    per_doc = removed.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("line").alias(gone))
    if not unique:
        once = docs.groupBy(F.col(id_col).cast("long").alias(own)).count().filter("count = 1").select(own)
        per_doc = per_doc.join(once, own, "left_semi")
    joined = docs.join(per_doc, F.col(id_col).cast("long") == F.col(own), "left")
    # what is left of the numbers comes from a hash set, so long texts take time in proportion
    left = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda i: F.get(x, i))
    kept = F.array_join(let(F.split(F.col(text_col), "\n"), left), "\n")
    return joined.select(*[F.when(F.col(gone).isNull() | F.col(text_col).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns])
