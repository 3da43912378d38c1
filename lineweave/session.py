"""Session helpers: table paths and checkpointing that work on a cluster and in tests."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer files than half the cores and few splits, dealt out to all cores; any other as it is read.

    Splits of one file may hold nothing, as a row group is never split. Regular expressions over text cost far more than
    moving it once, so one small file should not keep a cluster waiting.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() <= 4 * cores and len(df.inputFiles()) <= cores // 2
    return df.repartition(cores) if few else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder (``spark.checkpoint.dir``); set an own one only where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="lineweave-checkpoint-")
        atexit.register(shutil.rmtree, shared, True)
    sc.setCheckpointDir(shared)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lineweave-package-")
    atexit.register(shutil.rmtree, folder, True)
    target = Path(folder, "lineweave.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(target))
