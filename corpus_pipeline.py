"""A corpus from raw documents to packed sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written and
read again before the next stage. All but the last return the columns of `documents`.

1. `language_id` keeps documents whose language is recognised; a missing `lang` is filled.
2. `line_dedup` deletes later copies of line runs; a document left without a word goes.
3. `near_duplicates` keeps the document with the least id of each group of near copies.
4. `decontamination` drops documents that share a passage with the benchmark.
5. `packing` cuts and packs the tokens of what is left into sequences.

Documents are told apart by id and text, so repeated ids are safe; of rows that agree in both,
one is left after the third stage. A document with a null text has no language and goes in the
first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from monthloom.session import stage

LEAST_SCORE = 0.5
SHINGLE, SIMILAR = 5, (80, 100)
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_KEY = "key_"


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with a key of id and text; rows that agree in both are one document."""
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    return docs.select(*COLUMNS, key.alias(_KEY))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    keys = keys.select(F.col(f"{_KEY}.id").alias("gone_id"), F.col(f"{_KEY}.hash").alias("gone_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col(f"{_KEY}.hash") == F.col("gone_hash"))
    return docs.join(keys, same, "left_anti").select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs, language_id.vocabulary_file())
    judged = language_id.identify(docs.select(*COLUMNS), model, keep=COLUMNS)
    return judged.where(
        (F.col("lang_pred") != language_id.UNDEFINED) & (F.col("score") >= LEAST_SCORE)
    ).select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = (F.col("n_lines_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return found.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    groups = ngram_join.jaccard_groups(keyed, _KEY, "text", SHINGLE, *SIMILAR)
    groups = stage(groups.select(_KEY, "component_id"))
    copies = stage(groups.where(F.col(_KEY) != F.col("component_id")))
    kept = _without(keyed, copies)
    repeated = groups.groupBy(_KEY).count().where("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.withColumn("hash", F.xxhash64("text")).dropDuplicates(["doc_id", "hash"]).drop("hash")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.shared_passages(keyed, items, doc_id=_KEY)
    return _without(keyed, stage(found.where("n_hit > 0").select(_KEY)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.vocabulary_file())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The first stage fits a model and the last tokenises: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = function(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs
