"""One query per operator, over its whole table and with production settings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, cotraining, divergence, lines, mixing, neighbours, outliers, packing, pitman_yor, pstable, ranked, sharding, simhash
from .common import documents, persist, unused


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.robust_outliers(documents(spark, sf_dir))


def op2_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = cotraining.labels_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotraining.classify(documents(spark, sf_dir), labels)


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer())


def op4_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(documents(spark, sf_dir))


def op5_permutation_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(documents(spark, sf_dir))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    (row,) = unused(docs.columns, "_row")
    mixed = mixing.taken(persist(mixing.plan(docs.withColumn(row, F.monotonically_increasing_id()), row_col=row), "mix-plan"), row)
    at = lambda k: F.round(F.get("positions", F.lit(k)), 6)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", at(0).alias("position"), at(1).alias("position_again"))


def op9_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op10_duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicate_lines(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict:
    own = (
        op1_robust_outliers, op2_cotraining_quality, op3_sum_of_squares_packing, op4_pitman_yor_scores, op5_permutation_neighbours,
        op6_simhash_near_duplicates, op7_repeated_passages, op8_curriculum_mix, op9_slot_shards, op10_duplicate_lines,
        op11_source_divergence, op12_vector_near_duplicates, op13_ranked_search,
    )
    return {f.__name__: f for f in own}


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'text ' || coalesce(text, ''))) AS o
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS ordinal
  FROM d GROUP BY source),
weighed AS (
  SELECT *, CASE ordinal % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM named),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
open_level AS (
  SELECT arg_min(level, (cap / weight, ordinal)) AS level FROM levels WHERE cap > level * weight),
t AS (
  SELECT source, ordinal, source_size, CASE WHEN cap <= l.level * weight THEN cap ELSE o.level * weight END AS target
  FROM levels l CROSS JOIN open_level o),
placed AS (
  SELECT d.*, t.ordinal, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
readings AS (
  SELECT *, start AS r0, start + source_size AS r1, size > 0 AND 2 * start + size < 2 * target AS once,
         size > 0 AND 2 * (start + source_size) + size < 2 * target AS twice
  FROM placed),
demands AS (
  SELECT *, least(r0 / target, 1.0::DOUBLE) * CASE ordinal % 3 WHEN 0 THEN 1.0::DOUBLE ELSE 1.125::DOUBLE END AS n0,
         least(r1 / target, 1.0::DOUBLE) * CASE ordinal % 3 WHEN 0 THEN 1.0::DOUBLE ELSE 1.125::DOUBLE END AS n1
  FROM readings)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * (once::INT + twice::INT))::BIGINT AS taken,
       CASE WHEN once THEN round(POSITION0, 6) END AS position, CASE WHEN twice THEN round(POSITION1, 6) END AS position_again
FROM demands
"""


#: The inverse of each schedule's integral: constant; falling from 2 to 1 at half time and to 0.5; its mirror image.
INVERSE_SQL = """CASE ordinal % 3
         WHEN 0 THEN CASE WHEN n < 1.0 THEN n ELSE 1.0::DOUBLE END
         WHEN 1 THEN CASE WHEN n < 0.75 THEN 2 * n / (2 + sqrt(greatest(4 - 4 * n, 0)))
                          WHEN n < 1.125 THEN 0.5 + 2 * (n - 0.75) / (1 + sqrt(greatest(1 - 2 * (n - 0.75), 0))) ELSE 1.0::DOUBLE END
         ELSE CASE WHEN n < 0.375 THEN 2 * n / (0.5 + sqrt(greatest(0.25 + 2 * n, 0)))
                   WHEN n < 1.125 THEN 0.5 + 2 * (n - 0.375) / (1 + sqrt(greatest(1 + 4 * (n - 0.375), 0))) ELSE 1.0::DOUBLE END END"""


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every pair of sources is evaluated for every term here, without vectors of counts.
DIVERGENCE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({LOWER_SQL}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
words AS (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
counted AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counted GROUP BY ALL) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY ALL) USING (lang)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (n + 2 * v) AS p
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
langs AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 2)) // (sum(sum(c)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q
  FROM shares GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (
  SELECT s.lang, s.source, s.term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares s JOIN langs l ON s.lang = l.lang AND s.term = l.term WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM every
UNION ALL
SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, rank
FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= 10
"""

#: All pairs of vectors, and a walk over the links.
VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN roots r ON r.a = vec_id LEFT JOIN counted c ON c.a = vec_id
"""

RANKED_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
size AS (SELECT count(*) FILTER (WHERE len(words) > 0) AS docs, sum(len(words))::BIGINT AS terms FROM d),
posts AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM d) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM posts, size GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(words) * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN posts USING (term) JOIN d USING (id), size GROUP BY item_id, doc_id, id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, id))::INT AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    sql = MIX_SQL
    for k in "01":
        sql = sql.replace(f"POSITION{k}", re.sub(r"\bn\b", f"n{k}", INVERSE_SQL))
    return {"op8_curriculum_mix": sql, "op11_source_divergence": DIVERGENCE_SQL, "op12_vector_near_duplicates": VECTORS_SQL, "op13_ranked_search": RANKED_SQL}
