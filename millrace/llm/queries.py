"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table


def fold(folds: int, held_out: int) -> "F.Column":
    """Whether crc32 of the doc_id as text leaves the held-out remainder."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % folds == held_out, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.langid import identify, learn

    docs = table(spark, sf_dir, "documents")
    model = learn(docs, folds=4, held_out=2, sample_docs=3000)
    got = identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op2_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.lm import score

    return score(table(spark, sf_dir, "documents"), fold(7, 2))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import mix

    got = mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3.0)
    return got.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality import judge

    got = judge(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.neardup import classes

    return classes(table(spark, sf_dir, "documents"), threshold=0.8, words=5)


def op6_suffixdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.suffixdup import removed

    return removed(table(spark, sf_dir, "documents"), length=200)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2, with_ids=False)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=8).drop("source", "fraction")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mtree import top_k

    return top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.linedup import dedup_lines

    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3_mixing does before it draws: sizes and targets (in thousandths of a word)."""
    return op3_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round(F.col("target") * 1000).cast("long").alias("target"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op4_quality."""
    return op4_quality(spark, sf_dir).drop("kept", "posterior")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and slots of each shard of op8_sharding, and the sizes of all rows together."""
    got = op8_sharding(spark, sf_dir).groupBy("law", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots"), F.sum("size").alias("size"))
    return got.groupBy("law", "n", "first", "last", "slots").agg(F.count(F.lit(1)).alias("shards"))


QUERIES = {
    "op1_langid": op1_langid,
    "op2_lmscore": op2_lmscore,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_neardup": op5_neardup,
    "op6_suffixdup": op6_suffixdup,
    "op7_packing": op7_packing,
    "op8_sharding": op8_sharding,
    "op9_topk": op9_topk,
    "op10_linededup": op10_linededup,
    "mixing_targets": mixing_targets,
    "quality_counts": quality_counts,
    "shard_sizes": shard_sizes,
}

ORACLE_SQL: dict[str, str] = {
    "op5_neardup": r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM w),
b AS (SELECT doc_id, s, count(*) AS c FROM s GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM b GROUP BY ALL),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS k FROM b x JOIN b y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 10 * k >= 8 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
SELECT id AS doc_id, min(root) AS class_id FROM r GROUP BY id""",
    "mixing_targets": r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
c AS (SELECT *, 3 * n AS cap, 3 * n / w AS full_at FROM s),
l AS (SELECT *, (SELECT sum(n) FROM s) - coalesce((SELECT sum(x.cap) FROM c x WHERE x.full_at < c.full_at OR x.full_at = c.full_at AND (x.source < c.source OR c.source IS NULL AND x.source IS NOT NULL)), 0) AS rest,
  (SELECT sum(x.w) FROM c x WHERE NOT (x.full_at < c.full_at OR x.full_at = c.full_at AND (x.source < c.source OR c.source IS NULL AND x.source IS NOT NULL))) AS weights FROM c),
v AS (SELECT rest / weights AS level FROM l WHERE rest / weights <= full_at ORDER BY full_at, source ASC NULLS LAST LIMIT 1)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, round(1000 * least(cap, coalesce(level * w, cap)))::BIGINT AS target
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source CROSS JOIN v""",
    "quality_counts": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 2]) AS c FROM i),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE c > 1) GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM l LEFT JOIN r USING (doc_id)""",
    "shard_sizes": """
WITH t AS (SELECT count(*) AS n FROM documents), s AS (SELECT n // 8 + (i < n % 8)::BIGINT AS n FROM t CROSS JOIN range(8) r(i))
SELECT 'rows' AS law, n, 0::BIGINT AS first, n - 1 AS last, n AS slots, count(*) AS shards FROM s GROUP BY n""",
    "op9_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5""",
}
