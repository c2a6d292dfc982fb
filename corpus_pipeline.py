"""A corpus from raw documents to packed sequences; each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import documents, stash
from tidemark.llm.minhash import keep_one_of_each_group
from tidemark.llm.mixing import mix_sources
from tidemark.llm.packing import pack_sequences
from tidemark.llm.quality import drop_low_quality
from tidemark.llm.toxicity import drop_toxic

STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near-duplicates", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The toxicity stage trains a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
