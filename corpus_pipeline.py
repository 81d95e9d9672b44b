"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engramma.llm.common import folder_for
from engramma.llm.exact_dedup import exact_dedup_stage
from engramma.llm.language_id import language_stage
from engramma.llm.mixing import mixing_stage
from engramma.llm.near_dedup import near_dedup_stage
from engramma.llm.packing import packing_stage

STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Language models, sketches and tokens are beyond SQL; tests/llm holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the corpus, from the documents table through all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = folder_for(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
