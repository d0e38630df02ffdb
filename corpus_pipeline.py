"""The training-data pipeline: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

1. language_id: drops documents in no known language (null or without a letter,
   or with hardly a trigram of any language); fills in a missing lang.
2. line_dedup: deletes aligned common lines from the later of two documents, and
   drops documents of which no word is left.
3. near_dedup: keeps the document with the smallest doc_id of each class.
4. mixing: repeats or leaves out documents so that each source meets its target.
5. packing: tokenises and packs into windows of 4096; one row a piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored, table
from millrace.llm.langid import identify, learn
from millrace.llm.linedup import dedup_lines
from millrace.llm.mixing import mixed
from millrace.llm.neardup import one_of_each
from millrace.llm.packing import pack

#: Words that a worker of the packing stage remembers: workers of earlier stages still stand beside it.
CACHE_WORDS = 250_000
#: Below this score a text has next to no trigrams of the language it is closest to.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = identify(docs, learn(docs, folds=4, held_out=2, sample_docs=3000), prefix="_found_")
    kept = found.filter((F.col("_found_lang_pred") != "und") & (F.col("_found_score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "_found_lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    cut = dedup_lines(docs.select(*own, *(F.col(c).alias(f"_kept_{c}") for c in docs.columns if c not in own))).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    cut = cut.drop("n_lines", "n_removed").withColumnsRenamed({f"_kept_{c}": c for c in docs.columns if c not in own})
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, threshold=0.8, words=5).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs, weights=(1, 2, 3), most=3.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2, with_ids=True, cache_words=CACHE_WORDS)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Hashes, alignment and tokenisation have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
