"""What a cluster needs of the driver: a shared folder for checkpoints, and this package on its executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_storage(spark: SparkSession) -> str:
    """Make ``checkpoint()`` usable and return its folder: the cluster's shared one.

    Where none is set, a local run makes one of its own; on a cluster that is an error, since a folder of
    one machine is not seen by the others.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="promptloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for a table that is written and read again."""
    return f"{shared_storage(spark)}/{name}-{uuid.uuid4()}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever Spark keeps it; nothing happens where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_storage(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores: for rows that cost much work and few bytes.

    Only an input of fewer splits than cores is dealt anew; a large one is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Give executors this package, once a context, for the functions that run in their Python workers."""
    context = spark.sparkContext
    if getattr(context, "_promptloom_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="promptloom-package-")), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    context._promptloom_shipped = True
