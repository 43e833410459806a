"""The read ledger as a catalog table, cleaned by dropping partitions.

A reader's batch is a partition of the table (``uid``, ``batch_ts``). Cleaning
reads the partition list from the catalog and drops old ones there, so it reads and rewrites no
ledger rows, and lookups that run beside it see a batch whole or not at all.
"""

from __future__ import annotations

from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlog.operators.ledger import ledger_retain
from evlog.schema import LEDGER_COLUMNS, LEDGER_SCHEMA

STORED = [*(c for c in LEDGER_COLUMNS if c not in ("uid", "batch_ts")), "uid", "batch_ts"]
OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"
DROPPED_AT_ONCE = 1000  # partitions in one statement


def ensure_ledger_table(spark: SparkSession, table: str) -> None:
    """A managed table, whose folders the catalog removes with their partitions."""
    columns = ", ".join(f"{c} {LEDGER_SCHEMA[c].dataType.simpleString()}" for c in STORED)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY (uid, batch_ts)")


def save_ledger_table(ledger: DataFrame, table: str) -> None:
    """Insert ledger rows. The readers' batches among them are replaced, others stay: the session's partition overwrite mode is ``dynamic``
    during the insert, as a table insert has no such option of its own."""
    spark = ledger.sparkSession
    ensure_ledger_table(spark, table)
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        ledger.select(*STORED).repartition("uid", "batch_ts").write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(OVERWRITE_MODE, before)


def load_ledger_table(spark: SparkSession, table: str) -> DataFrame:
    """The ledger; filters on ``uid`` and ``batch_ts`` read the partitions they leave."""
    return spark.table(table).select(*LEDGER_COLUMNS)


def ledger_batches(spark: SparkSession, table: str) -> DataFrame:
    """``(uid, batch_ts)`` of the stored batches, from the catalog's partition list."""
    names = spark.sql(f"SHOW PARTITIONS {table}").select(F.split("partition", "/").alias("p"))
    # Names are escaped like URLs, but for the plus sign, which stands for itself.
    uid = F.url_decode(F.replace(F.substring_index(F.col("p")[0], "uid=", -1), F.lit("+"), F.lit("%2B")))
    return names.select(uid.alias("uid"), F.substring_index(F.col("p")[1], "=", -1).cast("long").alias("batch_ts"))


def clean_ledger(spark: SparkSession, table: str, ts: int) -> int:
    """Remove what ``ledger_retain`` at ``ts`` leaves out: of each reader's batches at or before ``ts`` all but the newest. Returns the
    number of removed batches. ``ledger_as_of`` is the same as before for every time from ``ts`` on. Running it again, or going on after it
    was interrupted, removes what is left."""
    kind = spark.catalog.getTable(table).tableType
    if kind != "MANAGED":
        raise ValueError(f"{table} is {kind}: only a managed table's folders are removed with its partitions")
    stored = ledger_batches(spark, table)
    old = stored.join(ledger_retain(stored, ts), ["uid", "batch_ts"], "left_anti").orderBy("batch_ts", "uid")
    dropped = 0
    for some in batched(old.toLocalIterator(), DROPPED_AT_ONCE):
        parts = ", ".join(f"PARTITION (uid = {_literal(r['uid'])}, batch_ts = {r['batch_ts']})" for r in some)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {parts}")
        dropped += len(some)
    return dropped


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
