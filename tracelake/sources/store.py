"""Tables in the shared folder that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a temporary one in local mode; a cluster must name a shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracelake-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/t-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(*frames: DataFrame) -> list[DataFrame]:
    """Frames that several rules read, each written once, so that their joins and hashes are not made again for every rule."""
    base = shared_dir(frames[0].sparkSession)
    return [stored(df, f"{base}/{k}") for k, df in enumerate(frames)]
