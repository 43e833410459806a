"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library assumes; all are plain Spark configuration.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints of small join sides are removed once no DataFrame uses them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Settings for a large cluster, applied by ``get_session`` off-local where the
# user gave none. Shuffle width is left to adaptive execution from a high
# initial number; scans use larger splits; streaming state lives in RocksDB
# instead of the executor heap.
CLUSTER_CONF = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def is_local(spark: SparkSession) -> bool:
    """True if driver and executors are one process, so a local folder is shared by all of them."""
    return bool(re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master))


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "evlog", **conf) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    Master and shuffle width are only set when given: a launcher's
    (``spark-submit --master ... --conf ...``) or an existing session's hold.
    """
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not is_local(spark):
        given = spark.sparkContext.getConf()
        for key, value in CLUSTER_CONF.items():
            if not given.contains(key) and key not in settings:
                spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only when it is unset
    and the master is local (a test or a laptop) is a fresh local folder created
    and registered; on a cluster executors would not share it, so that is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Spark Connect session has no SparkContext
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            raise RuntimeError("spark.checkpoint.dir must be set on a Spark Connect server") from None
        return base
    current = sc.getCheckpointDir()
    if current:
        return current
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="evlog-checkpoint-")
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/evlog-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared checkpoint folder: computed once,
    lineage cut, and recomputable from files if an executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Remove a folder that the library itself wrote, on whatever file system it's on. False if there was none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there's no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []


def folder_bytes(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, from the driver."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, on the driver."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def move_file(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file; False, with the source removed, if the target is there already."""
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    store = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(new) and store.rename(old, new):
        return True
    store.delete(old, False)
    return False
