"""Event sources: landed event tables, batch or streaming, as envelope rows.

A landed event table either already has the envelope columns (for example an
export of a Kafka or hub capture) or has the plain event layout of
``EVENTS_SCHEMA``; ``to_envelope`` maps the latter. The projection is declared
lazily, so Catalyst prunes every envelope column a query does not use and
pushes filters on the source columns into the Parquet scan.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evlog.functions.payload import enqueued_seconds
from evlog.functions.properties import PROPERTY_MAP_TYPE, property_columns
from evlog.schema import ENVELOPE_COLUMNS, ENVELOPE_SCHEMA, EVENTS_SCHEMA, PARTITION_KEY, PARTITION_NAME_FORMAT, START_OF_LOG

# Bytes per event in the synthetic offset (offset = event_id * OFFSET_STRIDE).
OFFSET_STRIDE = 64
DEFAULT_HUB = "hub1"
DEFAULT_PARTITIONS = 4
# Layouts of a stored log: plain events, or envelope rows (as ``save_log`` and the Parquet sink write them).
LANDED, ENVELOPE = "landed", "envelope"
KAFKA_EARLIEST = -2  # of the Kafka source's starting offsets
_EPOCH = datetime.datetime(1970, 1, 1)


def _partition_count(num_partitions: int | Mapping[str, int], hub: Column) -> Column:
    if isinstance(num_partitions, Mapping):
        if not num_partitions or any(int(v) <= 0 for v in num_partitions.values()):
            raise ValueError("every hub needs a positive partition count")
        pairs = [x for k, v in num_partitions.items() for x in (F.lit(k), F.lit(int(v)))]
        return F.element_at(F.create_map(*pairs), hub)
    if int(num_partitions) <= 0:
        raise ValueError("num_partitions must be positive")
    return F.lit(int(num_partitions))


def to_envelope(df: DataFrame, hub: str = DEFAULT_HUB, hub_col: str | None = None,
                num_partitions: int | Mapping[str, int] = DEFAULT_PARTITIONS,
                properties: bool | Sequence[str] = False) -> DataFrame:
    """Map a landed event table to envelope rows.

    ``hub``/``hub_col``: a constant hub name, or the column that names the hub.
    ``num_partitions``: partition count, one for all hubs or one per hub.
    ``properties``: ``True`` adds the ``properties`` map, a list of keys adds one
    string column per key (``""`` when absent).
    """
    if "seqNumber" in df.columns:  # already envelope rows
        out = df
        if "hub" not in out.columns:
            out = out.withColumn("hub", F.col(hub_col) if hub_col else F.lit(hub))
        return _stored_properties(out, properties) if properties else out
    hub_c = F.col(hub_col) if hub_col else F.lit(hub)
    cols = [
        hub_c.cast("string").alias("hub"),
        F.pmod(F.col("user_id"), _partition_count(num_partitions, hub_c)).cast("int").alias("partition_id"),
        F.to_json(F.struct("event_type", "value", "props")).cast("binary").alias("body"),
        (F.col("event_id") * OFFSET_STRIDE).alias("offset"),
        F.col("event_id").alias("seqNumber"),
        enqueued_seconds("ts").alias("enqueuedTime"),
        F.col("user_id").cast("string").alias("publisher"),
        F.col("event_type").alias("partitionKey"),
    ]
    if properties:
        cols += property_columns("props", None if properties is True else list(properties))
    return df.select(*cols)


def _stored_properties(df: DataFrame, properties: bool | Sequence[str]) -> DataFrame:
    """The properties of envelope rows: the stored map, or columns made from it or stored as such."""
    if properties is True:
        if "properties" not in df.columns:
            raise ValueError("the stored log has no properties column")
        return df
    lacking = [k for k in properties if k not in df.columns]
    if lacking and "properties" not in df.columns:
        raise ValueError(f"the stored log has neither a properties column nor the columns {lacking}")
    return df.select("*", *[F.coalesce(F.col("properties").getItem(k), F.lit("")).alias(k) for k in lacking]).drop("properties")


def raw_bounds(after_offset: int | None = None, after_time: int | None = None, layout: str = LANDED) -> Column | None:
    """Start bounds stated on the stored columns, so that Parquet can skip row
    groups. In the landed layout ``offset > X`` is ``event_id > floor(X / stride)``, and
    ``enqueuedTime > T`` (whole seconds) is ``ts >= T + 1 s``."""
    cond = None
    if after_offset is not None:
        cond = F.col("offset") > int(after_offset) if layout == ENVELOPE else F.col("event_id") > int(after_offset) // OFFSET_STRIDE
    if after_time is not None and layout == ENVELOPE:
        by_time = F.col("enqueuedTime") > int(after_time)
        cond = by_time if cond is None else cond & by_time
    elif after_time is not None:
        start = _EPOCH + datetime.timedelta(seconds=int(after_time) + 1)
        by_time = F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{start.isoformat(sep=' ')}'")
        cond = by_time if cond is None else cond & by_time
    return cond


def read_events(spark: SparkSession, path: str, streaming: bool = False, file_glob: str | None = None,
                max_files_per_trigger: int | None = None, after_offset: int | None = None,
                after_time: int | None = None, layout: str | None = None, max_bytes_per_trigger: int | None = None, **envelope) -> DataFrame:
    """Read a stored event log (Parquet) as envelope rows, batch or streaming.

    ``after_offset`` / ``after_time`` (epoch seconds) keep only events after
    that point, filtered on the stored columns and pushed into the scan.
    ``layout`` is ``landed`` or ``envelope``; a batch read sees it from the columns, a
    stream has to be told (default ``landed``). ``max_files_per_trigger`` or
    ``max_bytes_per_trigger`` caps what a stream's batch reads. ``properties`` of
    an envelope log are its stored map: a stream reads the log's ``properties`` column
    (null where there is none), a batch read of a log without one is an error.
    """
    if layout not in (None, LANDED, ENVELOPE):
        raise ValueError("layout is 'landed' or 'envelope'")
    caps = {"maxFilesPerTrigger": max_files_per_trigger, "maxBytesPerTrigger": max_bytes_per_trigger}
    given = {k: int(v) for k, v in caps.items() if v is not None}
    if any(v <= 0 for v in given.values()):
        raise ValueError("a read cap must be positive")
    if len(given) > 1:
        raise ValueError("give max_files_per_trigger or max_bytes_per_trigger, not both")
    if streaming:
        stored = T.StructType([*ENVELOPE_SCHEMA, T.StructField("properties", PROPERTY_MAP_TYPE)]) if envelope.get("properties") else ENVELOPE_SCHEMA
        reader = spark.readStream.schema(stored if layout == ENVELOPE else EVENTS_SCHEMA).options(**{k: str(v) for k, v in given.items()})
    elif given:
        raise ValueError("a read cap is for a stream")
    else:
        reader = spark.read
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    raw = reader.parquet(path)
    cond = raw_bounds(after_offset, after_time, layout or (ENVELOPE if "seqNumber" in raw.columns else LANDED))
    return to_envelope(raw if cond is None else raw.filter(cond), **envelope)


def kafka_envelope(df: DataFrame, properties: bool | Sequence[str] = False) -> DataFrame:
    """Map rows of Spark's Kafka source (``key, value, topic, partition,
    offset, timestamp[, headers]``) to envelope rows: the topic is the hub,
    the Kafka offset serves as both offset and sequence number, the record
    key is the partition key. Properties come from the record headers
    (``includeHeaders=true``); with repeated header keys the first one wins.
    """
    cols = [
        F.col("topic").alias("hub"),
        F.col("partition").cast("int").alias("partition_id"),
        F.col("value").alias("body"),
        F.col("offset").alias("offset"),
        F.col("offset").alias("seqNumber"),
        F.unix_seconds(F.col("timestamp")).alias("enqueuedTime"),
        F.lit(None).cast("string").alias("publisher"),
        F.col("key").cast("string").alias("partitionKey"),
    ]
    if properties:
        if "headers" not in df.columns:
            raise ValueError("properties need the Kafka headers (option includeHeaders=true)")
        names = F.transform("headers", lambda h: h["key"])
        first = F.filter("headers", lambda h, i: F.array_position(names, h["key"]) == i + 1)
        as_map = F.map_from_entries(F.transform(first, lambda h: F.struct(h["key"], h["value"].cast("string"))))
        if properties is True:
            cols.append(as_map.alias("properties"))
        else:
            cols += [F.coalesce(as_map.getItem(k), F.lit("")).alias(k) for k in properties]
    return df.select(*cols)


def read_kafka(spark: SparkSession, options: Mapping[str, str], max_offsets_per_trigger: int | None = None,
               properties: bool | Sequence[str] = False) -> DataFrame:
    """A stream of envelope rows from Spark's Kafka source (its package must be on the class path).

    ``options`` are the source's own (``kafka.bootstrap.servers``, ``subscribe``, ``startingOffsets``, ...);
    ``max_offsets_per_trigger`` caps the events of a batch.
    """
    return kafka_envelope(spark.readStream.format("kafka").options(**kafka_options(options, max_offsets_per_trigger, bool(properties))).load(),
                          properties)


def kafka_options(options: Mapping[str, str], max_offsets_per_trigger: int | None = None, headers: bool = False) -> dict[str, str]:
    out = {str(k): str(v) for k, v in options.items()}
    if max_offsets_per_trigger is not None:
        if int(max_offsets_per_trigger) <= 0:
            raise ValueError("max_offsets_per_trigger must be positive")
        out["maxOffsetsPerTrigger"] = str(int(max_offsets_per_trigger))
    if headers:
        out["includeHeaders"] = "true"
    return out


def kafka_start(positions: DataFrame) -> dict[str, str]:
    """The Kafka source's ``startingOffsets`` after saved positions (``hub, partition_id, end_offset``): the hub is the topic. A
    partition that is to be read and has no row is an error of the source; one at the start of the log begins there.
    The option is one string, so the positions (one row per partition) come to the driver."""
    starts: dict[str, dict[str, int]] = {}
    for hub, partition, offset in positions.select(*PARTITION_KEY, "end_offset").collect():
        starts.setdefault(hub, {})[str(partition)] = KAFKA_EARLIEST if offset in (None, START_OF_LOG) else offset + 1
    return {"startingOffsets": json.dumps(starts, sort_keys=True)}


def save_log(df: DataFrame, path: str, append: bool = False, max_records_per_file: int | None = None) -> None:
    """Store envelope rows in ``hub=/partition_id=`` folders, so that reading a partition or a hub reads only its folders.
    Smaller files (``max_records_per_file``) make the ranges of a zone map (``zones.index_log``) and a stream's read caps finer."""
    writer = df.write.mode("append" if append else "error").partitionBy(*PARTITION_KEY)
    if max_records_per_file is not None:
        writer = writer.option("maxRecordsPerFile", int(max_records_per_file))
    writer.parquet(path)


def load_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENVELOPE_SCHEMA).parquet(path)


def read_partition(df: DataFrame, partition_id: int, hub: str | None = None) -> DataFrame:
    """Only the events of one partition (and hub). On a log laid out by
    ``hub``/``partition_id`` folders the filter prunes whole folders."""
    cond = F.col("partition_id") == int(partition_id)
    if hub is not None:
        cond = cond & (F.col("hub") == hub)
    return df.filter(cond)


def union_partitions(parts: DataFrame | Iterable[DataFrame]) -> DataFrame:
    """Bag union of per-partition streams of one hub (duplicates kept)."""
    if isinstance(parts, DataFrame):
        return parts
    parts = list(parts)
    if not parts:
        raise ValueError("no partitions to union")
    return reduce(lambda a, b: a.unionByName(b), parts)


def union_hubs(hubs: Mapping[str, DataFrame]) -> DataFrame:
    """One stream over several named hubs; each input keeps its own partition
    count. The ``hub`` column is set from the mapping key."""
    if not hubs:
        raise ValueError("no hubs to union")
    frames = [df.withColumn("hub", F.lit(name)).select(*ENVELOPE_COLUMNS,
              *[c for c in df.columns if c not in ENVELOPE_COLUMNS])
              for name, df in hubs.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def partition_name(hub: str | Column = "hub", partition_id: str | Column = "partition_id") -> Column:
    """Text form ``<hub>-partition-<id>``."""
    h = F.col(hub) if isinstance(hub, str) else hub
    p = F.col(partition_id) if isinstance(partition_id, str) else partition_id
    return F.format_string(PARTITION_NAME_FORMAT, h, p)
