"""What the training-data operators share: reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of a local session, by application.
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of its own, as in tests; elsewhere that is an error, since what one
    machine writes to its own disk the others can't read."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = _LOCAL.setdefault(spark.sparkContext.applicationId, "")
        if not named:
            named = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemark-", dir="/tmp")
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back, so a lost executor costs no more than its own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table that durable() wrote and nothing reads any more."""
    if df is None:
        return
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidemark-" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under names that clash with none of an operator's own, and the new name of each column."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[docs[c].alias(n) for c, n in names.items()]), names


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder``. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
