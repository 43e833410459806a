"""Compaction of what batch writers leave: a folder for each batch becomes a few larger ones.

A writer (``sinks.batch_folder``) only ever writes its newest batch, so older
ones are final. Compaction copies these into a segment and then publishes a manifest:
which segments hold the batches up to which number. A manifest is written under a hidden
name, renamed to the next free number and never changed. Readers take
the newest one, and what it doesn't cover from the batch folders, so each
batch is read exactly once before, during and after a compaction, and beside a running
writer. Folders are removed one compaction after they were
replaced, for readers that had begun before.

Segments of equal level are merged when there are ``FAN_IN`` of them, so a row is
copied as often as the number of levels, which grows with the logarithm of the number of batches.
One compaction runs at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlog.session import folder_bytes, folder_names, move_file, read_text, remove_folder, write_text

MANIFESTS, SEGMENTS = "_manifest", "_segments"  # readers of the folder itself ignore names with an underscore
FAN_IN = 8
FILE_BYTES = 128 << 20  # wanted size of a segment's files
TABLE_ROWS = 1_000_000  # wanted rows of a file in a table's segment


@dataclass
class Segment:
    name: str
    first: int  # batches
    last: int
    level: int = 0


@dataclass
class Manifest:
    """Segments in the order of their batches; ``replaced`` are folders that the manifest before still names."""

    upto: int = -1
    segments: list[Segment] = field(default_factory=list)
    replaced: list[str] = field(default_factory=list)
    number: int = -1


def load_manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest manifest; an empty one before the first compaction."""
    numbers = [int(n.removesuffix(".json")) for n in folder_names(spark, f"{path}/{MANIFESTS}") if n.endswith(".json") and n[0].isdigit()]
    if not numbers:
        return Manifest()
    said = json.loads(read_text(spark, f"{path}/{MANIFESTS}/{max(numbers):010d}.json"))
    return Manifest(said["upto"], [Segment(**s) for s in said["segments"]], said["replaced"], max(numbers))


def _publish(spark: SparkSession, path: str, manifest: Manifest) -> None:
    said = json.dumps({"upto": manifest.upto, "segments": [asdict(s) for s in manifest.segments], "replaced": manifest.replaced})
    hidden = f"{path}/{MANIFESTS}/.{uuid.uuid4().hex}"
    write_text(spark, hidden, said)
    if not move_file(spark, hidden, f"{path}/{MANIFESTS}/{manifest.number:010d}.json"):
        raise RuntimeError(f"another compaction of {path} has published manifest {manifest.number}")


def _batches(spark: SparkSession, path: str) -> dict[int, str]:
    """Complete batch folders by batch."""
    found = {}
    for group in folder_names(spark, path):
        if group.startswith("batch_group="):
            for name in folder_names(spark, f"{path}/{group}"):
                if name.startswith("batch_id=") and "_SUCCESS" in folder_names(spark, f"{path}/{group}/{name}"):
                    found[int(name.removeprefix("batch_id="))] = f"{path}/{group}/{name}"
    return found


def _rows(spark: SparkSession, path: str, manifest: Manifest, folders: list[str] | None = None) -> DataFrame | None:
    """Rows with ``batch_id`` of the manifest's segments and of the batch folders behind it (or of the given ones)."""
    parts = [spark.read.parquet(*(f"{path}/{SEGMENTS}/{s.name}" for s in manifest.segments))] if manifest.segments else []
    if folders is None:
        # Groups whose batches are all covered aren't listed.
        groups = [g for g in folder_names(spark, path) if g.startswith("batch_group=")]
        folders = [f"{path}/{g}" for g in groups if any(n.startswith("batch_id=") and int(n.removeprefix("batch_id=")) > manifest.upto
                                                        for n in folder_names(spark, f"{path}/{g}"))]
    if folders:
        fresh = spark.read.option("basePath", path).parquet(*folders).drop("batch_group")
        parts.append(fresh.withColumn("batch_id", F.col("batch_id").cast("long")).filter(F.col("batch_id") > manifest.upto))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches, with ``batch_id``. Batch folders that a segment holds aren't opened."""
    path = path.rstrip("/")
    rows = _rows(spark, path, load_manifest(spark, path))
    return spark.read.parquet(path) if rows is None else rows  # Spark's own error for a folder without batches


def _write_segment(spark: SparkSession, path: str, rows: DataFrame, size: int) -> str:
    name = uuid.uuid4().hex
    files = max(1, -(-size // FILE_BYTES))
    # Sorted files, so that a filter on batches skips row groups.
    ordered = rows.repartitionByRange(files, "batch_id") if files > 1 else rows.coalesce(1)
    ordered.sortWithinPartitions("batch_id").write.parquet(f"{path}/{SEGMENTS}/{name}")
    return name


def compact_batches(spark: SparkSession, path: str, keep: int = 1, fan_in: int = FAN_IN) -> int:
    """Move the batches but for the newest ``keep`` (a restart may write the newest one again) into segments, and remove what the
    compaction before replaced. Returns how many batches were moved. Interrupted at any place, it leaves what readers see
    unchanged; what it had written without publishing is removed by the next one."""
    if keep < 1 or fan_in < 2:
        raise ValueError("the newest batch is kept, and at least two segments are merged")
    path = path.rstrip("/")
    old = load_manifest(spark, path)
    for folder in old.replaced:
        remove_folder(spark, f"{path}/{folder}")
    named = {s.name for s in old.segments}
    for name in folder_names(spark, f"{path}/{SEGMENTS}"):
        if name not in named:
            remove_folder(spark, f"{path}/{SEGMENTS}/{name}")
    batches = _batches(spark, path)
    # A batch folder that is still there below upto was replaced by a compaction that ended before it removed it.
    replaced = [f.removeprefix(f"{path}/") for b, f in sorted(batches.items()) if b <= old.upto]
    moving = sorted(b for b in batches if b > old.upto)[:-keep]
    if not moving:
        return 0
    segments = list(old.segments)
    folders = [batches[b] for b in moving]
    rows = _rows(spark, path, Manifest(old.upto), folders)
    segments.append(Segment(_write_segment(spark, path, rows, sum(folder_bytes(spark, f) for f in folders)), moving[0], moving[-1]))
    replaced += [f.removeprefix(f"{path}/") for f in folders]
    while len(segments) >= fan_in and len({s.level for s in segments[-fan_in:]}) == 1:
        last = segments[-fan_in:]
        size = sum(folder_bytes(spark, f"{path}/{SEGMENTS}/{s.name}") for s in last)
        name = _write_segment(spark, path, _rows(spark, path, Manifest(segments=last), []), size)
        replaced += [f"{SEGMENTS}/{s.name}" for s in last]
        segments[-fan_in:] = [Segment(name, last[0].first, last[-1].last, last[0].level + 1)]
    _publish(spark, path, Manifest(moving[-1], segments, replaced, old.number + 1))
    return len(moving)


# --- catalog tables ---------------------------------------------------------------------------------
PROPERTY = "evlog.manifest"


def _view_manifest(spark: SparkSession, view: str) -> Manifest:
    if not spark.catalog.tableExists(view):
        return Manifest()
    said = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {view}").collect()}.get(PROPERTY)
    if said is None:
        raise ValueError(f"{view} exists and isn't a view of compact_table")
    held = json.loads(said)
    return Manifest(held["upto"], [Segment(**s) for s in held["segments"]], held["replaced"], held["number"])


def _publish_view(spark: SparkSession, table: str, view: str, manifest: Manifest) -> None:
    """One catalog change: the view's text and the manifest in its properties."""
    columns = ", ".join(f"`{c}`" for c in spark.table(table).columns if c != "batch_id")
    said = json.dumps({"upto": manifest.upto, "segments": [asdict(s) for s in manifest.segments], "replaced": manifest.replaced, "number": manifest.number})
    wanted = " OR ".join([f"batch_id > {manifest.upto}", *(f"batch_id = {s.name}" for s in manifest.segments)])
    spark.sql(f"CREATE OR REPLACE VIEW {view} TBLPROPERTIES ('{PROPERTY}' = '{said}') AS SELECT {columns} FROM {table} WHERE {wanted}")


def compact_table(spark: SparkSession, table: str, view: str, keep: int = 1, fan_in: int = FAN_IN) -> int:
    """``compact_batches`` for a table of ``sinks.ensure_table`` (a partition for each batch). ``view`` is what readers query; the first
    call makes it. Old batches are copied into partitions of their own, with negative numbers, and the view, replaced in
    one catalog change, reads these and the batches behind them. The partitions that they replace are dropped by the next
    compaction. The table has as many partitions as segments and new batches, not one for each batch of all time."""
    if keep < 1 or fan_in < 2:
        raise ValueError("the newest batch is kept, and at least two segments are merged")
    old = _view_manifest(spark, view)
    present = {int(r["partition"].removeprefix("batch_id=")) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    named = {int(s.name) for s in old.segments}
    gone = sorted(p for p in present if (p < 0 and p not in named) or 0 <= p <= old.upto)
    for i in range(0, len(gone), 1000):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS " + ", ".join(f"PARTITION (batch_id = {p})" for p in gone[i:i + 1000]))
    moving = sorted(p for p in present if p > old.upto and p >= 0)[:-keep]
    if not moving:
        if old.number < 0:
            _publish_view(spark, table, view, Manifest(number=0))
        return 0
    free = min([0, *named, *(int(p) for p in old.replaced)]) - 1
    columns = [c for c in spark.table(table).columns if c != "batch_id"]

    def copy(batches: str, number: int) -> str:
        rows = spark.table(table).filter(batches).select(*columns, F.lit(number).cast("long").alias("batch_id"))
        rows.coalesce(max(1, -(-rows.count() // TABLE_ROWS))).write.insertInto(table)
        return str(number)

    segments = [*old.segments, Segment(copy(f"batch_id BETWEEN {moving[0]} AND {moving[-1]}", free), moving[0], moving[-1])]
    replaced = []
    while len(segments) >= fan_in and len({s.level for s in segments[-fan_in:]}) == 1:
        last, free = segments[-fan_in:], free - 1
        replaced += [s.name for s in last]
        segments[-fan_in:] = [Segment(copy(" OR ".join(f"batch_id = {s.name}" for s in last), free), last[0].first, last[-1].last, last[0].level + 1)]
    _publish_view(spark, table, view, Manifest(moving[-1], segments, replaced, old.number + 1))
    return len(moving)
