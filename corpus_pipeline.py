"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last
the columns of documents. ``run`` writes each stage's result as Parquet to the
folder that the cluster shares and reads it again, so that a lost executor never
reaches back over a stage.

A stage that joins rows to what was found of them numbers the rows and writes
them with their numbers first; so rows that repeat an id are told apart, and no
number depends on how a later read splits the files, or on whether the frame
given is a file at all.

Defined cases, of every stage: an empty table gives no rows; other columns, of
whatever name, are kept as they are by all stages but the last; a row whose only
columns are null is a row like any other. What a stage does with null texts,
ties and repeated rows is said at the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm import op02_decontaminate, op04_pii, op05_packing, op07_toxicity, op09_simhash
from isohyet.llm.common import checkpointed, free_name, shared_dir, small_or_shuffled, table

#: A document at this probability is rejected.
TOXIC = 0.5
#: Kept or dropped rows that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000


def own(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever signs their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the noisy-or model holds to be toxic.

    A null or empty text has no sentence and stays; rows with one text have one
    score and go or stay together; a null id is never learned from; without
    labels of both kinds every row stays."""
    # Rows that go through Python as a whole can't have dots or backticks there.
    rows = docs.toDF(*[free_name(docs, f"column{i}") if set(c) & {".", "`"} else c for i, c in enumerate(docs.columns)])
    model = op07_toxicity.train(rows, table(spark, sf_dir, "labels"))
    name = free_name(rows, "toxicity")
    return op07_toxicity.score_toxicity(rows, model).where(F.col(name) < TOXIC).select(rows.columns).toDF(*docs.columns)


def _placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number a row, written once and read again, and the name
    of the new column."""
    name, spark = free_name(docs, "place"), docs.sparkSession
    path = f"{shared_dir(spark)}/placed-{uuid.uuid4().hex}"
    docs.withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path), name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the smallest id.

    Two documents are linked as op9's contract has it: fingerprints of three-word
    shingles at two bits or fewer. Null and empty texts are one group; repeated
    rows are one group; of a group's rows of the smallest id the first in the
    input stays, and a row with a null id only if the whole group has none."""
    rows, name = _placed(docs)
    kept = checkpointed(op09_simhash.representatives(rows, name).withColumnRenamed("place", name))
    return rows.join(small_or_shuffled(kept, MAX_BROADCAST_ROWS), name, "left_semi").select(*own(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more are benchmark text.

    A null or wordless text has no hit and stays; repeated rows go or stay
    together; null or wordless benchmark items find nothing."""
    rows, name = _placed(docs)
    found = op02_decontaminate.find_contamination(rows, table(spark, sf_dir, "benchmark"), place=name)
    dirty = found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(F.col("place").alias(name))
    # Written once: counting it and joining it would search all texts twice.
    return rows.join(small_or_shuffled(checkpointed(dirty), MAX_BROADCAST_ROWS), name, "left_anti").select(*own(docs))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; n_chars follows.

    A null text stays null, an empty one empty; overlapping spans are replaced
    once, by the kind of the first; repeated rows are changed alike."""
    name = free_name(docs, "pii")
    rows = op04_pii.find_pii(docs)
    text = F.when(F.col("text").isNotNull(), op04_pii.masked(F.col("text"), F.col(name))).alias("text")
    rows = rows.select(*[text if n == "text" else c for n, c in zip(docs.columns, own(docs), strict=True)])
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of equal length.

    A null or empty text is its end id; repeated rows are packed each; a null id
    stays null."""
    return op05_packing.with_digest(op05_packing.pack_documents(docs))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]
#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
