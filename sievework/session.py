"""Session builder with the settings the engine expects."""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sievework", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE and Arrow on; a running session is reused."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",  # payloads cost much work a byte; large shuffles aren't concerned
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return b.config(map=settings | conf).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir; an own one only where it is unset and all runs in this process."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or own_folder(sc.master))


def own_folder(master: str) -> str:
    """A folder of this machine; no cluster may use one, as its executors see other disks."""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "sievework-checkpoints")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place below the shared folder; what is written there goes when the driver's process ends."""
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{os.urandom(8).hex()}"
    atexit.register(remove_folder, spark, at)
    return at


def remove_folder(spark: SparkSession, at: str) -> None:
    """Remove a place of shared_folder(); nothing is done once the session has ended."""
    if spark.sparkContext._jsc is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage is cut, and later reads take only the columns they need."""
    at = shared_folder(df.sparkSession, "table")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def cut(df: DataFrame) -> DataFrame:
    """df materialised in the checkpoint folder, with its lineage cut: it outlives lost executors and is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Inputs below this size aren't spread.
SPREAD_BYTES = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to as many partitions as there are cores if it comes in fewer, as small files with one row group do.

    Large inputs have more partitions than that and stay as they are; projections and filters still reach the scan.
    """
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, spread over the cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
