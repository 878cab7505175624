"""Session helpers shared by every operator: code shipping, shared folders, size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spanloom-")) / "spanloom_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; where that is unset, a folder of our own in local mode only, as
    executors on other machines could not read it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="spanloom-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, which survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of results that nothing refers to any more, before more are written."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe_broadcast(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Hint a broadcast only where a counted size proves it small; else leave the choice to Catalyst."""
    return F.broadcast(df) if rows <= limit else df


#: Scans of more than this are left as they are dealt.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Dealt over all cores, where a small scan has fewer partitions than there are cores (one file, say)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
