"""What a session needs for this package: importable Python functions and a shared folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers of a local session import this package; on a cluster it is installed or passed with --py-files."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, paths]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where it is unset and the session is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="bookspark-"))
    return named or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df from the shared folder: computed once, safe from lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
