"""The corpus pipeline: language, exact copies, near copies, benchmark passages, tokens.

Each stage takes what the one before kept and is written before the next one
reads it. All but the last return the columns of ``documents``. Ids identify rows;
a row without id takes part, but is never linked with others by its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabweave.llm import bpe, decontaminate, exact_dedup, langid, near_dedup
from tabweave.llm.frames import documents, stored

STAGES = [
    ("language_id", langid.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("byte_bpe", bpe.stage),
]

#: SQL cannot express the first stage's model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
