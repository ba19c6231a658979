"""Tables that cut lineage: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new place in the folder that spark.checkpoint.dir names. Unset, a local session gets a folder of its own; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = _LOCAL.setdefault(spark.sparkContext.applicationId, "")
        if not named:
            named = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemark-", dir="/tmp")
    return f"{named.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once: a lost executor costs its own tasks, and what reads them twice works them out once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
