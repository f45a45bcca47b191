"""Corpus pipeline: from raw documents to token shards, five stages that each call an operator of ``auditspark.llm``.

Every stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``, others that a
table has included, whatever their names.

Defined results, in every stage: an empty table gives an empty one; only doc_id, text and (in the mix) source are read,
and a null in another column changes nothing; rows that repeat are judged alike, each by itself where nothing is said.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditspark.llm import decontaminate, mixing, near_dedup, quality_rules, token_ids
from auditspark.llm.common import stored, table


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject, null and empty texts among them. A null id is kept or dropped by its text."""
    return quality_rules.keep_good(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id. Null and empty texts are near nothing; rows
    without an id all stay; rows that share an id stay or go together."""
    return near_dedup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents and cuts hit spans out of the others. Null and empty texts have no words and stay as they are."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: texts without words never, rows of one id, source and size equally often; null
    is a source of its own."""
    return mixing.mixed_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and reads them back: start, length and digest of each document's ids. Null is encoded as empty; null
    ids come first, equal ids in the order of their digests."""
    return token_ids.read_shards(spark, token_ids.tokenize(docs))


STAGES = [("quality_rules", rules_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("mix_sources", mix_stage), ("token_ids", tokens_stage)]

#: The quality model and the shuffled mix have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
