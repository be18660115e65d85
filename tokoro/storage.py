"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Where intermediate tables lie, if not in the session's checkpoint folder. Unlike that, it
#: can be set in a running session.
SETTING = "spark.tokoro.scratch"


def base_folder(spark: SparkSession) -> str | None:
    return spark.conf.get(SETTING, None) or spark.conf.get("spark.checkpoint.dir", None)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one; where none is set, a temporary one in local mode, and
    an error on a cluster."""
    base = base_folder(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tokoro-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
    return f"{_own(spark, base)}/{uuid.uuid4().hex}"


def _own(spark: SparkSession, base: str) -> str:
    """The folder of all that this application writes."""
    return f"{base.rstrip('/')}/tokoro/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder. Results that weren't stored
    elsewhere read from there, so this is for the end of a job; until then nothing is
    deleted. What an ended application left lies under its id."""
    base = base_folder(spark)
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark, base))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The table written once and read again: what several later steps share is computed
    once, and its plan ends here."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
