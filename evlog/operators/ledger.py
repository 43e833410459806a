"""Read ledger: how far each reader got in each partition, batch by batch.

The ledger is an ordinary table (``LEDGER_SCHEMA``), appended once per batch
and best stored partitioned by ``uid`` and ``batch_ts`` so that the point lookups below
prune whole folders. Readers number their batches independently of each other. Every question the reference answers from its progress
files (where to restart, is a batch complete, what to clean up) is a filter,
aggregate or join here. Single values such as "the newest batch at or before
T" are scalar subqueries: Spark runs them once and uses the result as a
literal, so no cross join and no single-task window is ever needed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evlog.operators.counts import end_positions
from evlog.operators.ordered import fill_forward, with_next, with_previous
from evlog.plans.joins import join_small
from evlog.schema import (LEDGER_COLUMNS, LEDGER_SCHEMA, LEDGER_TEXT_FORMAT, PARTITION_KEY, RANGE_DESCRIPTION_FORMAT,
                          START_OF_LOG)
from evlog.session import materialize
from evlog.sources.events import partition_name

POSITION_COLUMNS = ["end_offset", "end_seq"]
FILL_BLOCK = 4096  # batches filled at a time
_INTEGER_TEXT = r"^[+-]?[0-9]+$"


def ledger_rows(df: DataFrame, batch_col: str | Column, uid: str, batch_step: int = 1,
                fill: bool = True, expected: DataFrame | None = None) -> DataFrame:
    """One ledger row per partition per batch: end offset, end sequence number
    and the number of events read.

    Batches are numbered ``batch_col`` values (a batch id, an hour or day
    number, a batch time in ms with ``batch_step`` = the interval). With
    ``fill`` every batch between the first and the last one gets a row for
    every partition (``expected``, or every partition seen); a partition with
    no new data repeats its previous position (``-1, -1`` before its first
    event) with ``n = 0``. The fill works on aggregated cells, never on raw
    events, in blocks of batches (``operators.ordered``), so no task holds a
    partition's whole history.
    """
    return readers_ledger(df, {uid: (batch_col, batch_step)}, fill, expected)


def readers_ledger(df: DataFrame, readers: Mapping[str, tuple[str | Column, int]], fill: bool = True,
                   expected: DataFrame | None = None) -> DataFrame:
    """``ledger_rows`` of several readers, ``uid -> (batch column, batch step)``, with one pass over the events and one fill.
    ``expected`` (``hub, partition_id``) holds for all of them."""
    batches = {uid: (F.col(c) if isinstance(c, str) else c).cast("long") for uid, (c, _) in readers.items()}
    named = {uid: f"_batch{i}" for i, uid in enumerate(batches)}
    for uid, batch in batches.items():
        df = df.withColumn(named[uid], batch)
    cells = end_positions(df, by=[*PARTITION_KEY, *named.values()])
    # A row for each reader from the events' common cells, whose number doesn't depend on that of the events.
    each = F.inline(F.array(*[F.struct(F.lit(uid).alias("uid"), F.col(name).alias("batch_ts")) for uid, name in named.items()]))
    cells = cells.select(*PARTITION_KEY, *POSITION_COLUMNS, "n", each)
    if len(readers) > 1:
        cells = cells.groupBy("uid", *PARTITION_KEY, "batch_ts").agg(F.max_by("end_offset", "end_seq").alias("end_offset"),
                                                                     F.max("end_seq").alias("end_seq"), F.sum("n").alias("n"))
    if not fill:
        return cells.select(*LEDGER_COLUMNS)
    return _filled(materialize(cells.select(*LEDGER_COLUMNS)), {uid: step for uid, (_, step) in readers.items()}, expected)


def fill_cells(cells: DataFrame, uid: str, batch_step: int = 1, expected: DataFrame | None = None) -> DataFrame:
    """``ledger_rows`` from (materialised) rows that have ``end_offset, end_seq, n`` per partition and batch."""
    return _filled(cells.withColumn("uid", F.lit(uid)).select(*LEDGER_COLUMNS), {uid: batch_step}, expected)


def _filled(cells: DataFrame, steps: Mapping[str, int], expected: DataFrame | None) -> DataFrame:
    """A cell holds until its partition's next one: its position is repeated, with ``n = 0``, for the batches between.
    Before a partition's first cell its position is the start of the log."""
    if any(int(step) <= 0 for step in steps.values()):
        raise ValueError("batch_step must be positive")
    key = ["uid", *PARTITION_KEY]
    # First and last batches of the readers' partitions, and of the readers, which are named in the call: their values are literals.
    spans = materialize(cells.groupBy(*key).agg(F.min("batch_ts").alias("first"), F.max("batch_ts").alias("last")))
    ends = {uid: (lo, hi) for uid, lo, hi in spans.groupBy("uid").agg(F.min("first"), F.max("last")).collect()}
    if not ends:
        return cells.select(*LEDGER_COLUMNS)

    def of_reader(values: Mapping[str, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for uid, v in values.items() for x in (uid, int(v))]), F.col("uid")).cast("long")

    step, lo, hi = of_reader(steps), of_reader({u: e[0] for u, e in ends.items()}), of_reader({u: e[1] for u, e in ends.items()})
    wanted = spans
    if expected is not None:
        partitions = materialize(expected.select(*PARTITION_KEY).distinct())
        cells = join_small(cells, partitions, PARTITION_KEY, "left_semi")
        wanted = partitions.select(*PARTITION_KEY, F.explode(F.array(*map(F.lit, ends))).alias("uid")).join(spans, key, "left")
    start, zero = F.lit(START_OF_LOG).cast("long"), F.lit(0).cast("long")
    heads = wanted.select(*key, start.alias("end_offset"), start.alias("end_seq"), zero.alias("n"), lo.alias("batch_ts"),
                          F.coalesce("first", hi + step).alias("until"))
    tails = with_next(cells, key, "batch_ts", step).select(*key, *POSITION_COLUMNS, "n", "batch_ts", F.coalesce("next_batch_ts", hi + step).alias("until"))
    # In two steps, so that no array holds more than a block of batches.
    rows = heads.unionByName(tails).filter("batch_ts < until")
    span = step * FILL_BLOCK
    blocks = rows.select(*key, *POSITION_COLUMNS, "n", F.col("batch_ts").alias("_from"), "until",
                         F.explode(F.sequence("batch_ts", F.col("until") - 1, span)).alias("_block"))
    each = blocks.select("*", F.explode(F.sequence(F.col("_block"), F.least(F.col("_block") + span, F.col("until")) - 1, step)).alias("batch_ts"))
    return each.select("batch_ts", *key, *POSITION_COLUMNS, F.when(F.col("batch_ts") == F.col("_from"), F.col("n")).otherwise(zero).alias("n"))


def save_ledger(ledger: DataFrame, path: str) -> None:
    """Store ledger rows as Parquet partitioned by ``uid`` and ``batch_ts``. Only the
    readers' batches being written are replaced (dynamic partition overwrite), so
    writing a batch again is idempotent, and older batches and other readers stay untouched.
    Rows are first grouped by batch (a batch holds one row per partition,
    so no batch is large): one file per batch folder."""
    (ledger.select(*LEDGER_COLUMNS).repartition("uid", "batch_ts").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("uid", "batch_ts").parquet(path))


def load_ledger(spark, path: str) -> DataFrame:
    """A stored ledger; filters on ``uid`` and ``batch_ts`` prune whole batch folders."""
    return spark.read.schema(LEDGER_SCHEMA).parquet(path).select(*LEDGER_COLUMNS)


def format_ledger(ledger: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Ledger rows -> text lines ``<batch_ts> <uid> <hub> <partition> <offset> <seq>`` (and the columns ``keep``)."""
    return ledger.select(*(keep or []), F.format_string(LEDGER_TEXT_FORMAT, "batch_ts", "uid", "hub", "partition_id",
                                         "end_offset", "end_seq").alias("value"))


def parse_ledger(lines: DataFrame, col: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Text lines -> typed ledger records plus ``is_valid``.

    A line is valid when it splits on single spaces (trailing empty fields
    dropped) into exactly six fields whose 1st, 4th, 5th and 6th are integers
    that fit their type (partition: INT, the rest: BIGINT). Invalid lines keep
    null fields and ``is_valid = false``; nothing raises under ANSI mode.
    """
    parts = F.split(F.rtrim(F.col(col)), " ", -1)
    field = [F.get(parts, i) for i in range(6)]
    num = {0: "bigint", 3: "int", 4: "bigint", 5: "bigint"}
    typed = {i: F.when(field[i].rlike(_INTEGER_TEXT), field[i].try_cast(t)) for i, t in num.items()}
    valid = (F.size(parts) == 6)
    for i in num:
        valid = valid & typed[i].isNotNull()
    valid = F.coalesce(valid, F.lit(False))
    out = [
        F.when(valid, typed[0]).alias("batch_ts"),
        F.when(valid, field[1]).alias("uid"),
        F.when(valid, field[2]).alias("hub"),
        F.when(valid, typed[3]).alias("partition_id"),
        F.when(valid, typed[4]).alias("end_offset"),
        F.when(valid, typed[5]).alias("end_seq"),
        valid.alias("is_valid"),
    ]
    return lines.select(*(keep or []), *out)


def save_ledger_files(lines: DataFrame, path: str, file_col: str = "file_ts") -> None:
    """Ledger lines (``format_ledger``) as text files, one for each value of ``file_col``."""
    lines.select(F.col(file_col).alias("file_ts"), "value").repartition("file_ts").write.partitionBy("file_ts").text(path)


def read_ledger_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder of text ledgers, parsed (``parse_ledger``), with the ``file`` (its path) that each line stands in. Empty files have no rows."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_ledger(lines, keep=["file"])


def _newest_at_or_before(ledger: DataFrame, ts: int) -> Column:
    return ledger.filter(F.col("batch_ts") <= int(ts)).select(F.max("batch_ts")).scalar()


def ledger_as_of(ledger: DataFrame, uid: str, ts: int, exact: bool = False,
                 expected: DataFrame | None = None) -> DataFrame:
    """Positions of reader ``uid`` at batch ``ts``.

    ``exact=False``: the newest batch at or before ``ts``; ``exact=True``: batch
    ``ts`` only. Every expected partition (``expected``, or every partition the
    reader ever recorded) is returned; where no record is found its position
    is the start of the log ``(-1, -1)`` with ``batch_ts = -1``.
    """
    mine = ledger.filter(F.col("uid") == uid)
    target = F.lit(int(ts)).cast("long") if exact else _newest_at_or_before(mine, ts)
    found = mine.filter(F.col("batch_ts") == target).select(*PARTITION_KEY, "batch_ts", *POSITION_COLUMNS)
    wanted = (expected.select(*PARTITION_KEY) if expected is not None
              else mine.select(*PARTITION_KEY)).distinct()
    joined = join_small(wanted, found, PARTITION_KEY, "left")
    return joined.select(
        F.lit(uid).alias("uid"), *PARTITION_KEY,
        F.coalesce("batch_ts", F.lit(START_OF_LOG).cast("long")).alias("batch_ts"),
        *[F.coalesce(c, F.lit(START_OF_LOG).cast("long")).alias(c) for c in POSITION_COLUMNS],
    )


def ledger_as_of_many(ledger: DataFrame, requests: DataFrame, expected: DataFrame | None = None, step: int = 1) -> DataFrame:
    """``ledger_as_of`` for every ``(uid, ts)`` of ``requests`` at once: ``(uid, ts, hub, partition_id, batch_ts, end_offset, end_seq)``.

    Requests and the readers' batches are put in one order, and each request takes the last batch before it, in blocks
    of batches (``step`` apart), so that neither a reader's history nor its requests are in one task. A request
    of an unknown reader has no rows unless ``expected`` (``uid, hub, partition_id``) names partitions of it; repeated requests are one.
    """
    ledger = materialize(ledger.select("uid", "batch_ts", *PARTITION_KEY, *POSITION_COLUMNS))
    none = F.lit(None).cast("long")
    marks = ledger.select("uid", F.col("batch_ts").alias("ts"), F.col("batch_ts").alias("_batch"), F.lit(0).alias("_asked")).unionByName(
        requests.select("uid", F.col("ts").cast("long").alias("ts"), none.alias("_batch"), F.lit(1).alias("_asked")))
    # A batch and a request at one time are one row, so the batch counts for the request.
    merged = materialize(marks.groupBy("uid", "ts").agg(F.max("_batch").alias("_batch"), F.max("_asked").alias("_asked")))
    found = fill_forward(merged, ["uid"], "ts", ["_batch"], step=step).filter("_asked = 1").select("uid", "ts", "_batch")
    wanted = (ledger if expected is None else expected).select("uid", *PARTITION_KEY).distinct()
    grid = join_small(found, wanted, "uid")
    at = ledger.withColumnRenamed("batch_ts", "_batch").withColumn("_known", F.lit(True))
    joined = grid.join(at, ["uid", *PARTITION_KEY, "_batch"], "left")
    start = F.lit(START_OF_LOG).cast("long")
    return joined.select("uid", "ts", *PARTITION_KEY, F.when(F.col("_known"), F.col("_batch")).otherwise(start).alias("batch_ts"),
                         *[F.coalesce(c, start).alias(c) for c in POSITION_COLUMNS])


def ledger_merge(current: DataFrame, update: DataFrame) -> DataFrame:
    """Current positions overridden, per partition, by the update's.

    Both inputs carry ``uid, hub, partition_id, batch_ts, end_offset, end_seq``.
    One union and one aggregation (a single shuffle) instead of an outer join.
    """
    key = ["uid", *PARTITION_KEY]
    value = F.struct("batch_ts", *POSITION_COLUMNS)
    both = (current.select(*key, value.alias("_v"), F.lit(0).alias("_prio"))
            .unionByName(update.select(*key, value.alias("_v"), F.lit(1).alias("_prio"))))
    merged = both.groupBy(*key).agg(F.max_by("_v", "_prio").alias("_v"))
    return merged.select(*key, "_v.batch_ts", *[f"_v.{c}" for c in POSITION_COLUMNS])


def ledger_batch(ledger: DataFrame, ts: int) -> DataFrame:
    """All positions recorded in batch ``ts`` (a partition-pruned filter)."""
    return ledger.filter(F.col("batch_ts") == int(ts)).select("uid", *PARTITION_KEY, *POSITION_COLUMNS)


def ledger_retain(ledger: DataFrame, ts: int) -> DataFrame:
    """What survives cleaning at ``ts``: of each reader's batches at or before ``ts`` only
    the newest is kept, every batch after ``ts`` is kept. With no batch at or
    before ``ts`` nothing is dropped."""
    newest = ledger.filter(F.col("batch_ts") <= int(ts)).groupBy("uid").agg(F.max("batch_ts").alias("_keep"))
    return (join_small(ledger, newest, "uid", "left").filter((F.col("batch_ts") > int(ts)) | (F.col("batch_ts") == F.col("_keep")))
            .select(*ledger.columns))


def ledger_audit(records: DataFrame, expected: DataFrame, file_col: str | None = None) -> DataFrame:
    """Per reader and batch, ``(uid, batch_ts, ...)``, or per progress file ``file_col``: record count, malformed
    records, distinct record timestamps, expected partitions that are missing,
    and ``valid`` = no malformed record, one timestamp, nothing missing.

    ``records`` is a typed or parsed ledger (``is_valid`` optional);
    ``expected`` lists ``uid, hub, partition_id``. Readers number their batches on their own, so a batch is held against
    its reader's partitions, a file against all expected ones. Malformed records of no known reader are a group of their own (nulls).
    """
    key = ["uid", *PARTITION_KEY]
    group = [file_col] if file_col else ["uid", "batch_ts"]
    rec = records if "is_valid" in records.columns else records.withColumn("is_valid", F.lit(True))
    wanted = materialize(expected.select(*key).distinct())
    marked = join_small(rec, wanted.withColumn("_expected", F.lit(True)), key, "left")
    in_expected = F.col("is_valid") & F.coalesce(F.col("_expected"), F.lit(False))
    per = marked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(~F.col("is_valid")).alias("n_malformed"),
        F.count_distinct(F.when(F.col("is_valid"), F.col("batch_ts"))).alias("n_timestamps"),
        F.count_distinct(F.when(in_expected, F.struct(*key))).alias("_present"),
    )
    if file_col:
        per = per.withColumn("_wanted", wanted.select(F.count(F.lit(1))).scalar())
    else:
        per = join_small(per, wanted.groupBy("uid").agg(F.count(F.lit(1)).alias("_wanted")), "uid", "left").withColumn("_wanted", F.coalesce("_wanted", F.lit(0)))
    return per.select(
        *group, "n_records", "n_malformed", "n_timestamps",
        (F.col("_wanted") - F.col("_present")).alias("n_missing"),
        ((F.col("n_malformed") == 0) & (F.col("n_timestamps") == 1) & (F.col("_wanted") == F.col("_present"))).alias("valid"),
    )


def lost_partitions(ledger: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected partitions with no record in the newest batch of their reader."""
    newest = ledger.groupBy("uid").agg(F.max("batch_ts").alias("batch_ts"))
    latest = join_small(ledger, newest, ["uid", "batch_ts"], "left_semi").select("uid", *PARTITION_KEY)
    return expected.select("uid", *PARTITION_KEY).distinct().join(latest, ["uid", *PARTITION_KEY], "left_anti")


def batch_report(ledger: DataFrame, batch_step: int = 1) -> DataFrame:
    """Per reader and batch: input size = sum over partitions of
    ``end_seq - previous end_seq`` (previous = -1 before the first batch),
    ``valid = input_size >= 0``, and a one-line-per-partition description
    ordered by hub and partition. The previous batch of each partition is
    found in blocks of batches (``batch_step`` apart)."""
    prev = with_previous(ledger.select("uid", "batch_ts", *PARTITION_KEY, *POSITION_COLUMNS),
                         ["uid", *PARTITION_KEY], "batch_ts", POSITION_COLUMNS, step=batch_step)
    from_seq = F.coalesce(F.col("prev_end_seq"), F.lit(START_OF_LOG).cast("long"))
    from_offset = F.coalesce(F.col("prev_end_offset"), F.lit(START_OF_LOG).cast("long"))
    ranges = prev.select(
        "uid", "batch_ts", *PARTITION_KEY, (F.col("end_seq") - from_seq).alias("_size"),
        F.format_string(RANGE_DESCRIPTION_FORMAT, partition_name(), from_offset, from_seq,
                        F.col("end_seq")).alias("_line"),
    )
    per = ranges.groupBy("uid", "batch_ts").agg(
        F.sum("_size").alias("input_size"),
        F.sort_array(F.collect_list(F.struct(*PARTITION_KEY, "_line"))).alias("_lines"),
    )
    return per.select(
        "uid", "batch_ts", "input_size", (F.col("input_size") >= 0).alias("valid"),
        F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n").alias("description"),
    )


__all__ = ["ledger_rows", "readers_ledger", "fill_cells", "save_ledger_files", "read_ledger_files", "save_ledger", "load_ledger", "format_ledger", "parse_ledger", "ledger_as_of", "ledger_as_of_many", "ledger_merge", "ledger_batch",
           "ledger_retain", "ledger_audit", "lost_partitions", "batch_report", "LEDGER_COLUMNS"]
