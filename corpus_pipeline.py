"""The corpus pipeline: five stages of haze.llm over ``documents``, each written as Parquet and reread.

quality rules drop rejected documents; near-duplicates (five-word shingles, similarity of at least 0.8) keep
one document of each group; benchmark spans leave the texts; personal data is replaced by its kind;
the last stage packs what is left into sequences.  All but the last return the columns of documents.
``n_chars`` is brought up to date wherever a stage changes a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.llm import decontaminate, neardup, packing, personal, quality
from haze.llm.catalog import table, tokenizer_file
from haze.session import written

ORACLE_SQL = None  # learned rules and tokenisers are beyond SQL; tests hold the stages against brute force


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(personal.redacted(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.tokenised_pieces(docs, tokenizer_file())
    return packing.packed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("decontamination", decontamination),
          ("personal data", personal_data), ("packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
