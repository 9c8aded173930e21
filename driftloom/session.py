"""Session settings, the shared scratch folder, and reading of the input tables."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds that a write takes before the files of its shuffles are worth a run of the driver's collector.
LONG_WRITE = 2.0


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for; `conf` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Running counts keep one entry per term: more than a heap may hold.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # Trials that run side by side share the executors.
        "spark.scheduler.mode": "FAIR",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local session may go without one; it gets a temporary folder. On a
    cluster a machine-local folder would be lost with its machine, so a missing
    setting is an error there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="driftloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses, below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/driftloom/{uuid.uuid4().hex}/{name}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df`.

    Written as `stored` does it: the rows of a checkpoint are neither packed nor
    compressed, and take several times the room.
    """
    return stored(df, "settled")


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write `df` to the shared scratch folder, one folder a value of `by`, and read it back.

    As Parquet it is packed, columns not asked for are not read, and Spark knows
    its size. The shuffles that made it have ended: after a write that took long
    enough for them to have a size, their files are removed.
    """
    path, begun = scratch_path(df.sparkSession, name), time.monotonic()
    df.write.option("compression", "zstd").partitionBy(*([by] if by else [])).parquet(path)
    if time.monotonic() - begun >= LONG_WRITE:
        _collect(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def is_stored(df: DataFrame) -> bool:
    """Whether `df` is a table as `stored` gave it, so that keeping it again would only double it."""
    return getattr(df, "_scratch", None) is not None


def _collect(spark: SparkSession) -> None:
    """Let the driver's collector find the shuffles that nothing refers to: Spark then removes their files."""
    spark.sparkContext._jvm.System.gc()


def release(*tables: DataFrame | None) -> None:
    """Remove tables that `stored` wrote and nothing reads any more, and the files of shuffles that ended.

    Only the very DataFrame that `stored` gave has a path to remove; what was made from
    one, and any other table, stays. Spark removes the files of a shuffle when the
    driver's collector finds nothing that refers to it.
    """
    for table in tables:
        if table is not None and is_stored(table):
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(table._scratch)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
            _collect(table.sparkSession)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a scan that has fewer splits than the session has cores.

    A table stored as one row group is read by one task however many cores are
    free. Large inputs have more splits than cores and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
