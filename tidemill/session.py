"""What a session needs to run this package."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: The size of an Arrow batch; by rows alone a batch of long texts takes a great part of an executor's memory.
BATCH_BYTES = "8m"


def importable(spark: SparkSession) -> SparkSession:
    """Let local Python workers find this package where the driver found it (a cluster has it installed), and bound their batches by size."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only in local mode and where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidemill-')}")
        named = spark.sparkContext.getCheckpointDir()
    return named


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: all that read it see the same rows in the same partitions."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str, table: str | None = None) -> None:
    """Delete ``path``, and drop ``table`` if it is one, when the driver ends."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # noqa: BLE001 - the JVM may have gone before the interpreter ends
            pass

    atexit.register(remove)
