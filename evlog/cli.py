"""Launch the event jobs: ``spark-submit scripts/run_job.py <job> [options]`` or
``python -m evlog.cli <job> [options]``. Master, shuffle width and
``spark.checkpoint.dir`` come from spark-submit or spark-defaults.

Jobs: ``count``, ``json``, ``table``, ``jdbc``, ``parquet`` (see
``evlog.streaming.jobs``), and upkeep of what they leave: ``compact`` (batch folders or the
catalog table), ``index`` (zone map of a stored log), ``clean`` (ledger table).
Options are named; there are no positional values.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

from evlog.operators.ledger_table import clean_ledger
from evlog.schema import JDBC_PAYLOAD_TYPE
from evlog.session import get_session
from evlog.sources.zones import index_log
from evlog.streaming import jobs
from evlog.streaming.compaction import compact_batches, compact_table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evlog.cli", description=__doc__)
    sub = p.add_subparsers(dest="job", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--source", default=None, help="folder of the stored event log (Parquet)")
    common.add_argument("--hub-source", action="append", default=None, metavar="NAME:PARTITIONS[:FILES]:FOLDER",
                        help="one of several hubs, instead of --source, with its read cap in files per batch; repeat it")
    common.add_argument("--kafka", action="append", default=None, metavar="OPTION=VALUE",
                        help="option of Spark's Kafka source, instead of --source; repeat it")
    common.add_argument("--max-offsets-per-trigger", type=int, default=None, help="Kafka: events per batch")
    common.add_argument("--layout", choices=["landed", "envelope"], default=None, help="layout of the stored log")
    common.add_argument("--after-offset", type=int, default=None, help="start after this offset")
    common.add_argument("--after-time", type=int, default=None, help="start after this epoch second")
    common.add_argument("--ledger", default=None, help="start each partition after its position in this stored ledger")
    common.add_argument("--uid", default=None, help="reader whose positions in the ledger are meant")
    common.add_argument("--ledger-ts", type=int, default=None, help="batch of the ledger (default: the reader's newest)")
    common.add_argument("--properties", default=None, help="'all' for a map of properties, or a comma list of keys")
    common.add_argument("--watermark-seconds", type=int, default=None,
                        help="keep interval counts in state; later events than this may be lost (default: every event counts)")
    common.add_argument("--idle-zeros", action="store_true", help="with a watermark: write idle intervals as zeros while the job runs")
    common.add_argument("--checkpoint", required=True, help="job folder for state, progress and outputs")
    common.add_argument("--interval", type=int, default=10, help="batch interval and count window, seconds")
    common.add_argument("--timeout-minutes", type=float, default=None, help="stop after N minutes (default: run)")
    common.add_argument("--available-now", action="store_true", help="process what is there, then stop")
    common.add_argument("--max-files-per-trigger", type=int, default=None, help="read cap per batch")
    common.add_argument("--max-bytes-per-trigger", type=int, default=None, help="read cap per batch")
    common.add_argument("--file-glob", default=None, help="only files whose name matches")
    common.add_argument("--hub", default="hub1", help="hub name of the log")
    common.add_argument("--partitions", type=int, default=4, help="partition count of the log")
    common.add_argument("--console", action="store_true", help="also print the running total")
    counted = argparse.ArgumentParser(add_help=False)
    counted.add_argument("--total-prefix", required=True, help="running total text goes to <prefix>-<batch>")

    sub.add_parser("count", parents=[common, counted], help="events per interval and in total")
    js = sub.add_parser("json", parents=[common, counted], help="payload rows as JSON strings")
    js.add_argument("--out", required=True)
    js.add_argument("--mode", choices=["latest", "append"], default="latest")
    tb = sub.add_parser("table", parents=[common, counted], help="payload rows into a catalog table")
    tb.add_argument("--table", required=True)
    tb.add_argument("--location", default=None)
    tb.add_argument("--append-only", action="store_true", help="plain append, no batch partition")
    jd = sub.add_parser("jdbc", parents=[common, counted], help="payload rows into a JDBC table")
    jd.add_argument("--url", required=True)
    jd.add_argument("--jdbc-table", required=True)
    jd.add_argument("--user", default=os.environ.get("EVLOG_JDBC_USER"))
    jd.add_argument("--payload-type", default=JDBC_PAYLOAD_TYPE, help="type of the payload column of a new table")
    jd.add_argument("--dedupe-key", action="store_true", help="add hub, partition_id, seqNumber columns")
    pq = sub.add_parser("parquet", parents=[common], help="envelope rows to Parquet, partitioned by date")
    pq.add_argument("--out", required=True)
    cp = sub.add_parser("compact", help="move old batches into segments")
    cp.add_argument("--path", default=None, help="folder of batch folders")
    cp.add_argument("--table", default=None, help="or the table job's table ...")
    cp.add_argument("--view", default=None, help="... and the view that readers query")
    cp.add_argument("--keep", type=int, default=1, help="newest batches that stay as they are")
    ix = sub.add_parser("index", help="bring the zone map of a stored log up to date")
    ix.add_argument("--path", required=True)
    cl = sub.add_parser("clean", help="drop the batches of a ledger table that a restart at --ts or later doesn't need")
    cl.add_argument("--table", required=True)
    cl.add_argument("--ts", type=int, required=True)
    return p


def _hub(text: str) -> tuple[str, dict]:
    """``NAME:PARTITIONS:FOLDER`` or ``NAME:PARTITIONS:FILES:FOLDER``; a folder may hold colons."""
    name, partitions, rest = text.split(":", 2)
    cap, _, folder = rest.partition(":")
    if cap.isdigit() and folder:
        return name, {"source": folder, "num_partitions": int(partitions), "max_files_per_trigger": int(cap)}
    return name, {"source": rest, "num_partitions": int(partitions)}


def upkeep(args: argparse.Namespace, spark: SparkSession) -> int:
    """The number of batches moved or dropped, or of files indexed."""
    if args.job == "index":
        return index_log(spark, args.path)
    if args.job == "clean":
        return clean_ledger(spark, args.table, args.ts)
    if args.path is not None and args.table is None:
        return compact_batches(spark, args.path, args.keep)
    if args.path is None and args.table is not None and args.view is not None:
        return compact_table(spark, args.table, args.view, args.keep)
    raise SystemExit("compact needs --path, or --table and --view")


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> list | int:
    spark = spark or get_session()
    if args.job in ("compact", "index", "clean"):
        return upkeep(args, spark)
    hubs = dict(map(_hub, args.hub_source)) if args.hub_source else None
    kafka = dict(o.split("=", 1) for o in args.kafka) if args.kafka else None
    properties = False if not args.properties else True if args.properties == "all" else args.properties.split(",")
    cfg = jobs.JobConfig(source=args.source, hubs=hubs, kafka=kafka, max_offsets_per_trigger=args.max_offsets_per_trigger,
                         layout=args.layout, after_offset=args.after_offset, after_time=args.after_time, properties=properties,
                         ledger=args.ledger, uid=args.uid, ledger_ts=args.ledger_ts, idle_zeros=args.idle_zeros,
                         watermark_seconds=args.watermark_seconds, checkpoint=args.checkpoint, interval_seconds=args.interval,
                         timeout_minutes=args.timeout_minutes, available_now=args.available_now,
                         max_files_per_trigger=args.max_files_per_trigger, max_bytes_per_trigger=args.max_bytes_per_trigger, file_glob=args.file_glob,
                         envelope={} if kafka else {"hub": args.hub, "num_partitions": args.partitions}, console=args.console)
    if args.job == "count":
        return jobs.count_job(spark, cfg, args.total_prefix)
    if args.job == "json":
        return jobs.json_job(spark, cfg, args.out, args.total_prefix, mode=args.mode)
    if args.job == "table":
        return jobs.table_job(spark, cfg, args.table, args.total_prefix, location=args.location,
                              idempotent=not args.append_only)
    if args.job == "jdbc":
        props = {"user": args.user} if args.user else {}
        if os.environ.get("EVLOG_JDBC_PASSWORD"):
            props["password"] = os.environ["EVLOG_JDBC_PASSWORD"]
        return jobs.jdbc_job(spark, cfg, args.url, args.jdbc_table, args.total_prefix, props,
                             dedupe_key=args.dedupe_key, payload_type=args.payload_type)
    return jobs.parquet_job(spark, cfg, args.out)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> list | int:
    return run(parser().parse_args(argv), spark)


if __name__ == "__main__":
    main()
