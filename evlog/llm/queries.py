"""Registered queries of this subpackage, and the DuckDB twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evlog.llm import alignment, chat, codes, fingerprint, langid, lm, minmax, mixing, quality, secrets, surrogates, warc, wumanber
from evlog.llm.common import table
from evlog.session import work_path


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by a bigram model of the training fold."""
    return lm.score(table(spark, sf_dir, "documents"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order they're read, no source more than twice as often as the least repeated one."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted, and what is read back from the result."""
    control = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
                    F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
                    F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))
    turns = rows.unionByName(extra).select("conv_id", "turn", "role", F.array(part).alias("parts"))
    read = chat.read_chat(chat.format_chat(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
                       F.length("learned").cast("bigint").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))


def op4_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = wumanber.find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives in the shared folder and read back."""
    pages = table(spark, sf_dir, "pages")
    folder = work_path(spark, "warc")
    warc.write_archives(warc.mark_revisits(pages), folder, warc.train_dictionary(pages))
    kind = pages.schema["page_id"].dataType
    return warc.read_archives(spark, folder).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
                                                    "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data."""
    docs = table(spark, sf_dir, "documents")
    return surrogates.replace_entities(docs.select("doc_id", "text"))


def op8_minmax_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


def op9_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of an edited text of it."""
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code and error, and the codebooks' digest."""
    coded, history = codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.with_label_error(coded).select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                                                F.lit(codes.codebook_digest(history[-1])).alias("codebooks_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, aligned."""
    return alignment.align_documents(table(spark, sf_dir, "documents"))


def op13_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document. A source stands for an owner, its documents in one language for a repository."""
    found = secrets.scan(table(spark, sf_dir, "documents"), repository=F.struct("source", "lang"))

    def some(field: str, value: str) -> Column:
        return F.filter("findings", lambda f: f[field] == F.lit(value))

    counts = [F.size(some("kind", k)).cast("bigint").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    verdicts = [F.size(some("verdict", v)).cast("bigint").alias(f"n_{v}") for v in ("live", "example")]
    base = secrets.spans(F.filter("findings", lambda f: f["kind"] != "token"))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.spans(F.col("findings")).alias("spans"), *verdicts)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_deleted_interpolation, op2_temperature_mixing, op3_chat_parts, op4_wu_manber, op5_string_kernel,
                                   op6_warc_zstd, op7_surrogates, op8_minmax_near_dups, op9_attention_mil, op10_multiset_hash, op11_vector_codes, op12_token_alignment, op13_secret_ownership, pipeline)}
