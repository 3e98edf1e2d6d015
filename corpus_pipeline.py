"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark items, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm.common import drop_written, table, written
from lumenframe.llm.decontaminate import stage_decontaminate
from lumenframe.llm.minhash import stage_near_dedup
from lumenframe.llm.packing import stage_packing
from lumenframe.llm.substring_dedup import stage_substring_dedup
from lumenframe.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("near_dedup", stage_near_dedup),
    ("substring_dedup", stage_substring_dedup),
    ("decontamination", stage_decontaminate),
    ("packing", stage_packing),
]

#: Learned scores and integer programming are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        drop_written(before)
    return docs
