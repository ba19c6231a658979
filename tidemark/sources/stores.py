"""Documents, caches and logs on shared storage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str, version: int | None = None, field: str = "version") -> DataFrame:
    """JSON documents, one to a file, of a schema and (if given) a version; those that don't parse are left out."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    return rows if version is None else rows.where(F.col(field) == version)


def read_or_backup(spark: SparkSession, path: str, backup: str, schema: T.StructType | str) -> DataFrame:
    """The documents at ``path``; those at ``backup`` where the first are missing or don't parse at all."""
    try:
        rows = read_documents(spark, path, schema)
        if not rows.isEmpty():
            return rows
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return read_documents(spark, backup, schema)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def cached(spark: SparkSession, path: str, model_version: str, cache_key: str, make, rows_needed: bool = True) -> DataFrame:
    """What was stored for this model and key; made and stored where it is missing, or empty while rows are needed.

    The write commits whole or not at all, so a reader never sees half of it."""
    at = f"{path}/model={model_version}/key={cache_key}"
    try:
        held = spark.read.parquet(at)
        if not (rows_needed and held.isEmpty()):
            return held
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    made = make()
    made.write.mode("overwrite").parquet(at)
    return spark.read.schema(made.schema).parquet(at)


def fits(sizes: DataFrame, size: str, more: int, capacity: int) -> DataFrame:
    """``used, fits``: whether ``more`` bytes go beside what is stored."""
    return sizes.agg(F.coalesce(F.sum(size), F.lit(0)).alias("used")).withColumn("fits", F.col("used") + more <= capacity)


def thumbnail_time(start: Column, duration: Column) -> Column:
    """The second of a match that its picture is taken at."""
    return start + F.least(F.lit(35.0), F.greatest(F.lit(1.0), duration / 3))
