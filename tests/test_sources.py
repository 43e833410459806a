from __future__ import annotations

import pytest
from conftest import SMALL, envelope_rows
from pyspark.sql import functions as F

from evlog.schema import ENVELOPE_COLUMNS
from evlog.sources.events import (partition_name, read_events, read_partition, to_envelope, union_hubs,
                                  union_partitions)
from evlog.sources.positions import partition_lag, range_bounds, slice_ranges, start_from, total_lag


def test_envelope_schema_and_values(spark):
    env = read_events(spark, f"{SMALL}/events.parquet")
    assert env.columns == ENVELOPE_COLUMNS
    types = dict(env.dtypes)
    assert types["body"] == "binary" and types["enqueuedTime"] == "bigint" and types["partition_id"] == "int"
    first = env.filter(F.col("seqNumber") == 0).first()
    raw = spark.read.parquet(f"{SMALL}/events.parquet").filter("event_id = 0").first()
    assert first.offset == 0 and first.partition_id == raw.user_id % 4
    assert first.publisher == str(raw.user_id) and first.partitionKey == raw.event_type
    assert bytes(first.body).decode().startswith('{"event_type":"')


def test_envelope_time_is_zone_independent(spark):
    env = read_events(spark, f"{SMALL}/events.parquet").select("seqNumber", "enqueuedTime")
    before = dict(env.collect())
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        after = dict(read_events(spark, f"{SMALL}/events.parquet").select("seqNumber", "enqueuedTime").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert before == after


def test_properties_map_and_keys(spark):
    raw = spark.createDataFrame(
        [(1, '{"k": 5, "s": "x", "n": null}'), (2, '{}'), (3, None)], "event_id long, props string")
    raw = raw.select("event_id", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(7).cast("long").alias("user_id"),
                     F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), "props")
    as_map = to_envelope(raw, properties=True).orderBy("seqNumber").collect()
    assert as_map[0].properties == {"k": "5", "s": "x", "n": None}
    assert as_map[1].properties == {}
    keys = to_envelope(raw, properties=["k", "n", "absent"]).orderBy("seqNumber").collect()
    assert (keys[0].k, keys[0].n, keys[0].absent) == ("5", "", "")
    assert (keys[2].k, keys[2].absent) == ("", "")


def test_partition_and_unions(spark):
    env = read_events(spark, f"{SMALL}/events.parquet")
    parts = [read_partition(env, p) for p in range(4)]
    assert sum(p.count() for p in parts) == env.count()
    assert union_partitions(parts).count() == env.count()
    doubled = union_partitions([env, env])
    assert doubled.count() == 2 * env.count()  # bag union keeps duplicates
    hubs = union_hubs({"a": env.limit(3), "b": env.limit(2)})
    assert sorted(r.hub for r in hubs.collect()) == ["a", "a", "a", "b", "b"]
    with pytest.raises(ValueError):
        union_hubs({})


def test_per_hub_partition_counts(spark):
    raw = spark.read.parquet(f"{SMALL}/events.parquet")
    env = to_envelope(raw, hub_col="event_type", num_partitions={"click": 2, "view": 3, "purchase": 1,
                                                                  "signup": 5, "error": 4})
    got = {r.hub: r.m for r in env.groupBy("hub").agg(F.max("partition_id").alias("m")).collect()}
    assert got["purchase"] == 0 and got["click"] <= 1 and got["view"] <= 2
    assert partition_name(F.lit("h"), F.lit(3)) is not None
    assert spark.range(1).select(partition_name(F.lit("h"), F.lit(3)).alias("x")).first().x == "h-partition-3"


def test_start_from_precedence(spark):
    env = envelope_rows(spark, [("h", 0, "a", o * 10, o, 100 + o) for o in range(10)]
                        + [("h", 1, "b", o * 10, o, 100 + o) for o in range(10)])
    cp = spark.createDataFrame([("h", 0, 40, 4), ("h", 1, -1, -1)], "hub string, partition_id int, end_offset long, end_seq long")
    rows = start_from(env, checkpoint=cp, offset=70, enqueued=105).collect()
    p0 = sorted(r.seqNumber for r in rows if r.partition_id == 0)
    p1 = sorted(r.seqNumber for r in rows if r.partition_id == 1)
    assert p0 == [5, 6, 7, 8, 9]          # saved checkpoint, exclusive
    assert p1 == [8, 9]                   # checkpoint is -1: falls back to the offset
    assert sorted(r.seqNumber for r in start_from(env, enqueued=107).collect()) == [8, 8, 9, 9]
    assert start_from(env).count() == 20  # start of log


def test_slice_ranges_and_rates(spark):
    env = envelope_rows(spark, [("a", 0, "x", s * 8, s, s) for s in range(50)] + [("b", 0, "y", s * 8, s, s) for s in range(50)])
    pos = spark.createDataFrame([("a", 0, 10), ("b", 0, -1)], "hub string, partition_id int, end_seq long")
    got = slice_ranges(env, pos, max_rate={"a": 5, "b": 100})
    a = sorted(r.seqNumber for r in got.filter("hub = 'a'").collect())
    b = sorted(r.seqNumber for r in got.filter("hub = 'b'").collect())
    assert a == [11, 12, 13, 14, 15]
    assert b == list(range(50))           # capped by the latest event
    with pytest.raises(ValueError):
        slice_ranges(env, pos, max_rate=0)
    with pytest.raises(ValueError):
        range_bounds(pos, pos, max_rate={"a": -1})


def test_partition_lag(spark):
    env = envelope_rows(spark, [("h", p, "x", s, s, s) for p in range(3) for s in range(10)])
    pos = spark.createDataFrame([("h", 0, 9), ("h", 1, 4)], "hub string, partition_id int, end_seq long")
    lag = {r.partition_id: (r.current_seq, r.lag, r.caught_up) for r in partition_lag(env, pos).collect()}
    assert lag == {0: (9, 0, True), 1: (4, 5, False), 2: (-1, 10, False)}
    tot = total_lag(partition_lag(env, pos)).first()
    assert (tot.total_lag, tot.caught_up_partitions, tot.partitions) == (15, 1, 3)


def test_kafka_envelope(spark):
    import datetime

    from evlog.sources.events import kafka_envelope

    schema = ("key binary, value binary, topic string, partition int, offset long, timestamp timestamp, "
              "timestampType int, headers array<struct<key:string,value:binary>>")
    ts = datetime.datetime(2024, 1, 2, 3, 4, 5, tzinfo=datetime.timezone.utc)
    rows = [(bytearray(b"k1"), bytearray(b"payload"), "orders", 3, 42, ts, 0,
             [("a", bytearray(b"1")), ("b", bytearray(b"x")), ("a", bytearray(b"2"))]),
            (None, bytearray(b""), "orders", 0, 7, ts, 0, [])]
    df = spark.createDataFrame(rows, schema)
    env = kafka_envelope(df, properties=True).orderBy("seqNumber").collect()
    assert env[1].hub == "orders" and env[1].partition_id == 3 and env[1].offset == 42 == env[1].seqNumber
    assert env[1].enqueuedTime == int(ts.timestamp()) and env[1].partitionKey == "k1"
    assert bytes(env[1].body) == b"payload" and env[1].properties == {"a": "1", "b": "x"}
    assert env[0].properties == {} and env[0].partitionKey is None
    keyed = kafka_envelope(df, properties=["a", "zz"]).orderBy("seqNumber").collect()
    assert (keyed[1].a, keyed[1].zz, keyed[0].a) == ("1", "", "")
    assert kafka_envelope(df).columns == ENVELOPE_COLUMNS
