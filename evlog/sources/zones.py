"""Zone map of a stored log: the partition and the lowest and highest sequence number of each file.

With it a bounded read opens only the files that can hold wanted events, and
the newest sequence number of each partition is known without reading the log. The map
is a small table beside the log, written as a whole under a new number each
time and never changed, so readers need no lock. Files that the map doesn't know
yet are always read: results don't depend on how fresh it is.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlog.operators.counts import end_positions
from evlog.plans.joins import join_small
from evlog.schema import DEFAULT_MAX_RATE, ENVELOPE_SCHEMA, PARTITION_KEY
from evlog.session import folder_names, path_exists, remove_folder
from evlog.sources.events import load_log
from evlog.sources.positions import range_bounds, slice_ranges

ZONES = "_zones"  # readers of the log ignore names with an underscore
ZONE_SCHEMA = "file string, hub string, partition_id int, min_seq long, max_seq long, n long"
# Beyond this many files a bounded read opens the log's folders instead of a list of files; the filters are the same.
MAX_FILES = 100_000


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete maps."""
    folder = f"{path.rstrip('/')}/{ZONES}"
    return sorted(int(v) for v in folder_names(spark, folder) if v.isdigit() and path_exists(spark, f"{folder}/{v}/_SUCCESS"))


def load_zones(spark: SparkSession, path: str) -> DataFrame:
    """``(file, hub, partition_id, min_seq, max_seq, n)`` of the newest map; no rows without one."""
    versions = _versions(spark, path)
    return spark.read.schema(ZONE_SCHEMA).parquet(f"{path.rstrip('/')}/{ZONES}/{versions[-1]}") if versions else spark.createDataFrame([], ZONE_SCHEMA)


def _listed(spark: SparkSession, path: str) -> set[str]:
    """The log's files as ``_metadata.file_path`` names them (a URL)."""
    return {re.sub("^file:/+", "file:/", f) for f in load_log(spark, path).inputFiles()}


def _files(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """Envelope rows of some files of the log; their hub and partition come from the folders' names."""
    if not files:
        return spark.createDataFrame([], ENVELOPE_SCHEMA)
    names = [unquote(f) for f in files]
    if any(set(n) & set("{}[]*?\\") for n in names):  # a reader would take such names for patterns
        return load_log(spark, path).filter(F.col("_metadata.file_path").isin(files))
    return spark.read.schema(ENVELOPE_SCHEMA).option("basePath", path).parquet(*names)


def _zones_of(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("_metadata.file_path").alias("file"), *PARTITION_KEY).agg(
        F.min("seqNumber").alias("min_seq"), F.max("seqNumber").alias("max_seq"), F.count(F.lit(1)).alias("n"))


def index_log(spark: SparkSession, path: str) -> int:
    """Bring the zone map of a log (``save_log``) up to date and return how many files are new in it.

    Reads the sequence numbers of the new files only, and forgets files that are gone. The listing of
    the log's files, which planning any scan needs too, is compared on the driver. The map before the newest one
    is kept for readers that have begun with it.
    """
    listed = _listed(spark, path)
    old = load_zones(spark, path)
    known = {r[0] for r in old.select("file").collect()}
    new = sorted(listed - known)
    versions = _versions(spark, path)
    if not new and known <= listed and versions:
        return 0
    fresh = _zones_of(load_log(spark, path) if not known else _files(spark, path, new)) if new else spark.createDataFrame([], ZONE_SCHEMA)
    gone = spark.createDataFrame([(f,) for f in sorted(known - listed)], "file string")
    rows = (join_small(old, gone, "file", "left_anti") if known - listed else old).unionByName(fresh)
    number = versions[-1] + 1 if versions else 0
    rows.coalesce(max(1, len(listed) // 100_000)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{ZONES}/{number}")
    for version in versions[:-1]:
        remove_folder(spark, f"{path.rstrip('/')}/{ZONES}/{version}")
    return len(new)


def _unknown(spark: SparkSession, path: str) -> list[str]:
    return sorted(_listed(spark, path) - {r[0] for r in load_zones(spark, path).select("file").collect()})


def latest_positions(spark: SparkSession, path: str) -> DataFrame:
    """``(hub, partition_id, end_seq)``: the newest sequence number of each partition, from the map and the files it doesn't know."""
    ends = load_zones(spark, path).groupBy(*PARTITION_KEY).agg(F.max("max_seq").alias("end_seq"))
    fresh = _unknown(spark, path)
    if fresh:
        more = end_positions(_files(spark, path, fresh)).select(*PARTITION_KEY, "end_seq")
        ends = ends.unionByName(more).groupBy(*PARTITION_KEY).agg(F.max("end_seq").alias("end_seq"))
    return ends


def load_range(spark: SparkSession, path: str, bounds: DataFrame) -> DataFrame:
    """The log's events in files that may hold some within ``bounds`` (``hub, partition_id, from_seq``, exclusive, ``until_seq``, inclusive;
    a row for each wanted partition). A superset of the wanted events: filter it as the whole log would be."""
    zones = join_small(load_zones(spark, path), bounds.select(*PARTITION_KEY, "from_seq", "until_seq"), PARTITION_KEY)
    wanted = zones.filter((F.col("max_seq") > F.col("from_seq")) & (F.col("min_seq") <= F.col("until_seq"))).select("file").distinct()
    found = [r[0] for r in wanted.limit(MAX_FILES + 1).collect()]
    if len(found) > MAX_FILES:
        return load_log(spark, path)
    return _files(spark, path, sorted(found) + _unknown(spark, path))


def stored_slices(spark: SparkSession, path: str, positions: DataFrame, max_rate: int | Mapping[str, int] = DEFAULT_MAX_RATE,
                  seq_col: str = "end_seq") -> DataFrame:
    """``slice_ranges`` of a stored log, by its zone map: the newest positions come from the map, and only files that reach into a
    partition's range are opened."""
    latest = latest_positions(spark, path)
    events = load_range(spark, path, range_bounds(positions, latest, max_rate, seq_col))
    return slice_ranges(events, positions, max_rate, latest, seq_col)
