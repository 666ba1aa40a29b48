"""From raw documents to a training mixture, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns documents with their columns; the last adds topic, n_tokens and
probability.  Stages work on whatever the one before kept, so models and statistics follow it.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmask.functions.identifiers import column
from sparkmask.llm import decontam, mixing, neardup, quality, secrets
from sparkmask.llm.common import cut, stable_bucket, table
from sparkmask.llm.queries import QUALITY_CUT, mix_targets
from sparkmask.sources.shared import shared_folder

def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, each row by its own text, a null one as an empty one."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(F.coalesce(stable_bucket(F.col("doc_id"), 4) != 2, F.lit(False))), QUALITY_CUT)
    return quality.keep(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the row with the smallest id stays, a null id last;
    texts that are null or without words are in no group and stay."""
    return neardup.keep(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, each row by its own text; null texts hold none and stay."""
    row = F.struct(*[column(c).alias(f"_{i}") for i, c in enumerate(docs.columns)])
    found = decontam.contamination(docs.select(row.alias("_row"), "text"), table(spark, sf_dir, "benchmark"), id_col="_row")
    return found.where("n_hit = 0").select(*[F.col(f"_row._{i}").alias(c) for i, c in enumerate(docs.columns)])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars counts what is left.  Every row stays, and a null text stays null."""
    out = secrets.secrets(docs, redact="[secret]", found_col="_secrets").drop("_secrets")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that tokens of sources, languages and topics approach their targets."""
    return mixing.mix(docs, mix_targets(spark)).where("kept").drop("kept")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Trained models and MinHash have no SQL form; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again.

    The result is a checkpoint, so that the stages' files can go before it is read.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    docs = table(spark, sf_dir, "documents")
    try:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                files.delete(path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}"), True)
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        files.delete(path(folder), True)
