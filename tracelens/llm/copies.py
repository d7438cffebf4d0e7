"""Near copies by SimHash with the generalised pigeonhole principle, verified by the Jaccard similarity of shingles.

Documents are sets of hashed word shingles.  Equal sets are one class; classes whose fingerprints differ in at
most RADIUS bits are candidates first, and a pair links only if its sets reach the similarity.  At 0.8 fingerprints
differ in about 10 of 64 bits, too many for parts of them that tell texts apart; so classes still in different
components that share a band of MinHash values are candidates next.  Bands of 4 in 25 miss a pair of similarity 0.8
with probability 2e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lines, simhash
from .common import WORDS, mix64, persist, slices, split_join, text_bytes
from .simhash import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, WIDTH = 25, 4
#: Bits in which fingerprints of candidates differ at most.
RADIUS = 3
#: Rounds in which a band's members meet one of them only; the pairs that are left meet after them.
STARS = 2

FACTORS = mix64(np.arange(7000, 7000 + BANDS * WIDTH)) | np.uint64(1)
OFFSETS = mix64(np.arange(8000, 8000 + BANDS * WIDTH))
PLACES = mix64(np.arange(9000, 9064)) | np.uint64(1)

SETS = "row long, doc_id long, sig long, fp long, n int, bands array<long>, words binary"
SETS_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("sig", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("bands", pa.list_(pa.int64())), ("words", pa.binary())])


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The set of 32-bit hashes of all runs of ``shingle`` words (A-Z lower-cased); a shorter text is one run."""
    words = WORDS.of(text.lower().split())
    if not len(words):
        return np.empty(0, "<u4")
    length = min(shingle, len(words))
    total = np.full(len(words) - length + 1, length, np.uint64)
    for k in range(length):
        total += mix64(words[k : k + len(total)]) * PLACES[k]
    return np.unique((mix64(total) >> np.uint64(32)).astype("<u4"))


def fingerprint(own: np.ndarray) -> np.int64:
    """Bits set in over half of the set's hashes, widened to 64 bits; 0 for the empty set."""
    return simhash.majority(mix64(own.astype(np.uint64) * PLACES[-1])).view(np.int64)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key per band; none for sets of fewer than 4, which at 0.8 match equal sets only."""
    if len(own) < 4:
        return np.empty(0, np.int64)
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):
        x = own[at : at + 2048].astype(np.uint64)
        least = np.minimum(least, (x[:, None] * FACTORS[None, :] + OFFSETS[None, :]).min(0))
    bands = (least.reshape(BANDS, WIDTH) * PLACES[:WIDTH]).sum(1, dtype=np.uint64)
    return mix64(bands + OFFSETS[:BANDS]).view(np.int64)


def sets(docs: DataFrame, row_col: str, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, sig (hash of the set), fp (its fingerprint), n (its size), bands, words (the set); null texts are empty."""

    def run(batches):
        for batch in slices(batches):
            made = [shingles(t, shingle) for t in text_bytes(batch)]
            columns = [
                batch.column("row"), batch.column("doc_id"), pa.array([xxhash.xxh3_64_intdigest(m.tobytes()) - (1 << 63) for m in made], pa.int64()),
                pa.array([fingerprint(m) for m in made], pa.int64()), pa.array([len(m) for m in made], pa.int32()), pa.array([band_keys(m) for m in made], pa.list_(pa.int64())), pa.array([m.tobytes() for m in made], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=SETS_ARROW)

    taken = docs.select(F.col(row_col).cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return taken.mapInArrow(run, SETS)


def close(classes: DataFrame) -> DataFrame:
    """a, b, each with its n: pairs of classes that connect all whose fingerprints differ in at most RADIUS bits: those of one
    fingerprint meet their first, and the first ones meet as the pigeonhole search over fingerprints pairs them."""
    firsts = persist(classes.groupBy("fp").agg(F.min_by(F.struct("sig", "n"), "sig").alias("first"), F.count("*").alias("c")), "firsts")
    same = split_join(classes.select("fp", "sig", "n"), firsts.select("fp", "first", "c"), "fp", "c").select("sig", "n", F.col("first.sig").alias("sig2"), F.col("first.n").alias("n2"))
    end = lambda fp, sig, n: firsts.select(F.col("fp").alias(fp), F.col("first.sig").alias(sig), F.col("first.n").alias(n))
    apart = simhash.links(firsts, RADIUS).join(end("a", "sig", "n"), "a").join(end("b", "sig2", "n2"), "b").select("sig", "n", "sig2", "n2")
    return same.filter("sig <> sig2").unionByName(apart)


def heads(docs: DataFrame, row_col: str, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row: of each group of linked rows the one with the least (doc_id, row), a null id coming last.

    ``row_col`` tells the rows apart.  Rows link when their shingle sets have a Jaccard similarity of at least
    ``similarity`` (0.8 or more), of 32-bit hashes; rows without words link with each other.
    """
    made = persist(sets(docs, row_col, shingle, id_col, text_col), "shingles")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = persist(made.groupBy("sig").agg(F.min(order).alias("head"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    posts = persist(classes.select("sig", "n", F.explode("bands").alias("key")), "bands")
    texts = made.select(F.col("sig").alias("doc_id"), F.lit(0).alias("line"), "words")
    near = lambda a, b: F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - F.lit(1e-9)
    tested = linked = rooted = None

    def banded(turn: int) -> DataFrame:
        # members of a band that are in one component already needn't meet
        if rooted is None:
            met = posts.withColumn("root", F.col("sig"))
        else:
            met = posts.join(rooted, posts["sig"] == rooted["node"], "left").select("key", "sig", "n", F.coalesce("root", "sig").alias("root"))
        lead = F.min_by(F.struct("sig", "n", "root"), F.xxhash64("sig", F.lit(turn)))
        leads = met.groupBy("key").agg(lead.alias("lead"), F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
        leads = persist(leads.filter("low <> high").select("key", "lead", "c"), "leads")
        if turn < STARS:
            return split_join(met, leads, "key", "c").select("sig", "n", "root", F.col("lead.sig").alias("sig2"), F.col("lead.n").alias("n2"), F.col("lead.root").alias("root2"))
        open_ = persist(split_join(met, leads.select("key", "c"), "key", "c"), "open")
        return open_.join(open_.select("key", F.col("sig").alias("sig2"), F.col("n").alias("n2"), F.col("root").alias("root2")), "key")

    for turn in range(-1, STARS + 1):
        found = banded(turn) if turn >= 0 else close(classes).withColumns({"root": F.col("sig"), "root2": F.col("sig2")})
        found = found.filter((F.col("root") != F.col("root2")) & near(F.col("n"), F.col("n2"))).select(F.greatest("sig", "sig2").alias("a"), F.least("sig", "sig2").alias("b")).distinct()
        if tested is not None:
            found = found.join(tested, ["a", "b"], "left_anti")
        found = persist(found, "candidates")
        if found.isEmpty():
            continue
        pairs = found.select(F.col("a").alias("doc_id"), F.lit(0).alias("line"), F.col("b").alias("match_doc_id"), F.lit(0).alias("match_line"), F.lit(False).alias("more"))
        sure = persist(lines.verify(pairs, texts, similarity).select(F.col("doc_id").alias("a"), F.col("match_doc_id").alias("b")), "near")
        tested = found if tested is None else tested.unionByName(found)
        linked = sure if linked is None else linked.unionByName(sure)
        rooted = components(linked)
    if rooted is None:
        return classes.select("head.row")
    joined = classes.join(rooted, classes["sig"] == rooted["node"], "left").withColumn("root", F.coalesce("root", "sig"))
    return joined.groupBy("root").agg(F.min("head").alias("head")).select("head.row")
