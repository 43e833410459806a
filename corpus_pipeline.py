"""From raw documents to a mixed training corpus: five stages, each one operator of evlog.llm.

A stage reads what the one before it kept, as a table. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlog.llm import minmax, mixing, quality, surrogates, wumanber
from evlog.llm.common import mark_possible, table
from evlog.session import materialize, work_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _whole(docs: DataFrame) -> DataFrame:
    """The rows as one value beside their text, so that an operator's decision stays on the row, whatever its doc_id."""
    return docs.select(F.struct(*COLUMNS).alias("row"), "text")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as label 1. Without labels of both classes all stay."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(_whole(docs), model, doc_id="row").filter("predicted = 1").select("doc_id.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group, once.

    Rows without an id are dropped if a row with one has an equal set. Of rows with one id and text the first by lang, source and n_chars
    stays; different texts that share an id each stay if no smaller id is near them. Only rows that may be dropped are shuffled with their texts.
    """
    keyed = docs.select(*COLUMNS, F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("_text"))
    found = minmax.near_duplicates(keyed, carry="_text").groupBy("doc_id", "_text").agg(F.min("kept").alias("kept"), F.count("*").alias("rows"))
    named = materialize(found.filter("NOT kept OR rows > 1 AND doc_id IS NOT NULL"))
    rows = mark_possible(keyed, ["doc_id", "_text"], named.select("doc_id", "_text"))
    gone = named.filter("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("_text").alias("_of"))
    kept = rows.filter("possible").join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")) & F.col("_text").eqNullSafe(F.col("_of")), "left_anti")
    first = F.min(F.struct("lang", "source", "n_chars", "text")).alias("first")
    once = kept.filter("doc_id IS NOT NULL").groupBy("doc_id", "_text").agg(first).select("doc_id", "first.*").select(*COLUMNS)
    return rows.filter("NOT possible").select(*COLUMNS).unionByName(once).unionByName(kept.filter("doc_id IS NULL").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = wumanber.find_windows(_whole(docs), table(spark, sf_dir, "benchmark"), doc_id="row")
    return found.filter("NOT contaminated").select("doc_id.*")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return surrogates.replace_entities(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The order in which documents are read, each at least once."""
    return mixing.mix_sources(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("personal_data", replace_personal_data), ("mixing", mix_to_weights)]

#: SQL can't express the quality classifier or the surrogates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every other stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = work_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
