"""Getting this package to the executors of a cluster that doesn't have it installed; cutting lineage."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds this package as an archive to the session's context, once an application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        name = os.path.join(tempfile.mkdtemp(), os.path.basename(package))
        context.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(context.applicationId)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written once to the folder that spark.checkpoint.dir names. A local session without one gets a temporary
    folder; on a cluster that is an error, as executors don't see each other's disks."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()
