"""How the sources of a language differ in the terms they use, by deduplicated count columns.

Terms whose counts are the same in every source are one column: a sparse vector of (source, count), kept once with
the number of its terms.  A pair of sources is evaluated once per distinct vector that either of them is in and
multiplied by that number; the terms that neither holds are all alike and counted by subtraction.  Only the ranking
of terms goes back to the terms themselves, of which the ten least of a vector are enough.
"""

from __future__ import annotations

import string
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import persist, slices
from .terms import letters, tally

#: A kept term is in at least so many documents of its language; terms are ranked to TOP.
LEAST_DOCS, TOP = 10, 10
#: Shares are whole billionths.
SCALE = 1_000_000_000
#: Terms that a task counts before it sends the counts on.
HELD = 200_000
#: A language's entries meet its sources in so many parts, for there are few languages.
PARTS = 64

#: Terms are the matches of [^\x00-\x40\x5B-\x60\x7B-\x7F]+.
LETTERS = letters(string.ascii_lowercase)

COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("c", pa.int64()), ("docs", pa.int64())])


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences), docs (documents that hold it); every row of ``docs`` is a document."""

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out():
            for (lang, source), (found, rows) in held.items():
                n = len(found)
                columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64()), pa.array([rows[t] for t in found], pa.int64())]
                yield from slices([pa.RecordBatch.from_arrays(columns, schema=COUNTED)], 10_000)

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                found, rows = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(found)
                own = tally(text, LETTERS)
                found.update(own)
                rows.update(own.keys())
                size += len(found)
                if size > HELD:
                    yield from out()
                    held.clear()
                    size = 0
        yield from out()

    taken = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    made = taken.mapInArrow(run, "lang string, source string, term binary, c long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


def share(c: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (c + 2) / whole) in two steps of whole numbers, exact up to a ``whole`` of 9e13."""
    high = (c + 2) * 100_000
    return 1 + F.call_function("div", high, whole) * 10_000 + F.call_function("div", F.pmod(high, whole) * 10_000, whole)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(counted: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, counts: terms in enough documents of their language, with (source, c) of every source that has them."""
    found = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "c"))).alias("counts"))
    return found.filter(F.col("docs") >= least_docs).drop("docs")


def vectors(terms: DataFrame, top: int) -> DataFrame:
    """lang, counts, n (terms that have these counts), least (the ``top`` least of them, in order)."""
    number = Window.partitionBy("lang", "counts").orderBy("term")
    few = terms.withColumn("k", F.row_number().over(number)).filter(F.col("k") <= top)
    least = few.groupBy("lang", "counts").agg(F.sort_array(F.collect_list("term")).alias("least"))
    return terms.groupBy("lang", "counts").agg(F.count("*").alias("n")).join(least, ["lang", "counts"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Terms are maximal runs of letters A-Z (lower-cased), a-z and non-ASCII characters.  With c a kept term's count in a
    group, N the group's count of kept terms and V the language's number of them, its share is
    p = 1 + floor(SCALE * (c + 2) / (N + 2 * V)).  Two shares are floor((p - q)**2 / (p + q)) apart.  Part ``pair``: for every
    (lang, source) the other sources of the language by the sum of that over all kept terms (0 without any).
    Part ``term``: the group's own terms with a share above the language's, to rank ``top``.  Ties go to the item that
    is less in UTF-8.

    Null lang, source and text are empty strings; rows with one id or of equal text are documents each; an empty
    table gives no rows.  A vector has an entry per source at most, and lies in one row.
    """
    terms = persist(kept_terms(counts(docs), least_docs), "terms")
    columns = persist(vectors(terms, top).withColumn("vector", F.monotonically_increasing_id()), "vectors")
    # groups with their sizes, those without terms too
    entries = columns.select("lang", "vector", "n", F.explode("counts").alias("e")).select("lang", "vector", "n", "e.source", "e.c")
    sizes = entries.groupBy("lang", "source").agg(F.sum(F.col("c") * F.col("n")).alias("own"))
    held = columns.groupBy("lang").agg(F.sum("n").alias("terms"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(sizes, ["lang", "source"], "left").join(held, "lang", "left").na.fill(0, ["own", "terms"])
    groups = persist(groups.withColumn("whole", F.col("own") + 2 * F.col("terms")), "groups")

    # every vector's entries with their shares; an entry stands for n terms
    shared = entries.join(groups.select("lang", "source", "whole"), ["lang", "source"]).withColumn("p", share(F.col("c"), F.col("whole"))).drop("whole", "c")
    lists = shared.groupBy("lang", "vector", "n").agg(F.map_from_entries(F.collect_list(F.struct("source", "p"))).alias("shares"))
    lists = persist(lists.withColumn("part", F.pmod(F.col("vector"), F.lit(PARTS)).cast("int")), "shares")
    others = groups.select("lang", F.col("source").alias("other"), share(F.lit(0).cast("long"), F.nullif(F.col("whole"), F.lit(0))).alias("none"))
    parts = others.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = lists.join(parts, ["lang", "part"]).withColumn("q", F.try_element_at("shares", F.col("other")))
    # a pair in both of whose sources the terms are is met from the greater one only
    met = met.select("lang", "n", "other", F.coalesce("q", "none").alias("q"), F.col("q").isNotNull().alias("there"), F.explode("shares").alias("source", "p"))
    met = met.filter((F.col("source") > F.col("other")) | ((F.col("source") < F.col("other")) & ~F.col("there")))
    pairs = met.groupBy("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")).agg(F.sum(distance(F.col("p"), F.col("q")) * F.col("n")).alias("apart"), F.sum("n").alias("seen"))

    # all pairs of a language's groups, the answer's own rows
    left, right = (others.join(held, "lang", "left").select("lang", F.col("other").alias(c), F.coalesce("terms", F.lit(0)).alias("terms"), F.col("none").alias(f"{c}_none")) for c in "ab")
    every = left.join(right.drop("terms"), "lang").filter("a < b").join(pairs, ["lang", "a", "b"], "left").na.fill(0, ["apart", "seen"])
    value = F.col("apart") + F.coalesce((F.col("terms") - F.col("seen")) * distance(F.col("a_none"), F.col("b_none")), F.lit(0))
    every = every.withColumn("value", value)
    both = every.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(by_value))

    # the language's own share of a vector's terms, against each of its entries
    language = groups.groupBy("lang").agg((F.sum("own") + 2 * F.first("terms")).alias("lang_whole"))
    sums = columns.select("lang", "vector", "least", F.aggregate("counts", F.lit(0).cast("long"), lambda x, e: x + e["c"]).alias("c"))
    common = sums.join(language, "lang").select("lang", "vector", "least", share(F.col("c"), F.col("lang_whole")).alias("q"))
    above = lists.select("vector", F.explode("shares").alias("source", "p")).join(common, "vector").filter("p > q")
    ranked = above.select("lang", "source", F.explode("least").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    ranked = ranked.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    term = ranked.select("lang", "source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value", "rank")
    return pair.unionByName(term)
