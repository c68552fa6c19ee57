"""A corpus pipeline: toxic documents go, one document of each near-duplicate
group stays, repeated passages and secrets are cut out, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before has kept; all but the last return the columns of ``documents``, further
columns included.  Defined results, of each stage: an empty table gives no rows;
null and empty texts stay as they are (packed, the end id alone); rows without a
doc_id are never dropped but for their own toxicity, and neither give nor lose
words as repeats; rows of one doc_id and different texts all stay where their
document does, rows of one doc_id and text once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from sparkhop.llm import near, packing, passages, secrets, toxicity
from sparkhop.llm.common import checkpoint_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below the limit."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.filter_rows(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component; of rows with its
    doc_id and one text, the first by the other columns."""
    kept = near.cluster(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    rank = "_rank" + "_" * max(map(len, docs.columns))  # no column has this name
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    same = Window.partitionBy("doc_id", "text").orderBy(*(others or ["doc_id"]))
    once = named.withColumn(rank, F.row_number().over(same)).where(F.col(rank) == 1)
    return once.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that a smaller document's windows cover."""
    return passages.remove(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret's span replaced."""
    return secrets.redact(docs, secrets.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; ids by the word tokenizer."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

#: SQL cannot express the trained stages; tests/llm holds brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet
    to the shared folder and read again by the next."""
    folder = f"{checkpoint_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
