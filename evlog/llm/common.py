"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A label column may have at most this many values in a training sample; the most frequent ones are taken.
MAX_CLASSES = 1000
# Bits of a set of keys that all tasks get: so many for a key, and at most so many in all (16 MB). A piece of it is what bitmap_construct_agg makes.
KEY_BITS = 16
MAX_BITS = 1 << 27
PIECE_BITS = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True for the held-out fold. A row without an id is in no fold: not held out, and never learned from."""
    return F.coalesce(id_remainder(doc_id, modulus) == remainder, F.lit(False))


def sample_per_class(df: DataFrame, by: str, key: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each value of ``by``: those with the smallest hash of ``key``.

    A count per class turns the bound into a hash threshold, so only about twice
    the wanted rows are ever shuffled, whatever the size of ``df``.
    """
    hashed = df.withColumn("_h", F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)))
    counts = df.groupBy(by).count().orderBy(F.desc("count"), by).limit(MAX_CLASSES).collect()
    near = F.lit(False)
    for value, n in counts:
        near = near | ((F.col(by) == F.lit(value)) & (F.col("_h") < int((1 << 30) * min(1.0, (2 * per_class + 64) / n)) + 1))
    first = Window.partitionBy(by).orderBy("_h", key)
    return (hashed.filter(near).withColumn("_r", F.row_number().over(first))
            .filter(F.col("_r") <= per_class).drop("_h", "_r"))


def mark_possible(rows: DataFrame, on: list[str], keys: DataFrame) -> DataFrame:
    """``rows`` with a column ``possible``: true wherever the columns ``on`` are a row of ``keys``, and for few other rows.

    Rows that can't match needn't be shuffled for a join then. Each key sets a bit of a bitmap, which is built by tasks
    and broadcast. Beyond MAX_BITS / KEY_BITS keys more other rows are marked, but no row of ``keys`` is ever missed. Nulls are equal.
    """
    bits = min(MAX_BITS, max(PIECE_BITS, 1 << (KEY_BITS * keys.count()).bit_length()))
    at = F.pmod(F.xxhash64(*on), F.lit(bits))
    piece, bit = F.shiftright(at, 15).alias("_piece"), at.bitwiseAND(F.lit(PIECE_BITS - 1)).alias("_bit")
    # Dealt out before it's grouped: a piece is 4 KB however few keys a task has for it.
    pieces = keys.toDF(*on).select(piece, bit).repartition("_piece").groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    octet = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 + 1 AS int), 1)")), 16, 10).cast("bigint")
    found = F.coalesce(F.getbit(octet, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
    return rows.select("*", piece, bit).join(F.broadcast(pieces), "_piece", "left").select(*rows.columns, found.alias("possible"))


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of ``work_path`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
