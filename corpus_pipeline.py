"""The training-text pipeline over ``documents``, stage by stage.

Every stage works on all that the one before has kept and is written as a table before the
next one reads it. All but the last return the columns of ``documents``.
"""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, gam, suffix_dedup
from corpusloom.llm.common import held_out
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.simhash_vp import one_of_each
from corpusloom.session import shared_folder

#: Documents with a quality score below this go.
QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality classifier accepts; it learns from the labels outside the held-out rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = gam.fit(docs, labels.filter(~held_out(2, 4)))
    return gam.accepted(docs, model, QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group."""
    return one_of_each(docs, shingle=3, max_bits=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out every byte string of 200 that occurs twice or more."""
    cut = suffix_dedup.deduplicate(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a benchmark passage."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]
#: Fingerprints, a boosted model and a tokenizer are beyond SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
