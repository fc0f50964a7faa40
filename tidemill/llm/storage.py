"""Intermediate tables in the folder that all executors share.

A written table cuts lineage and survives the loss of executors.  The folder is
the one that the cluster names in spark.checkpoint.dir; only on a local master
(a single machine, as in tests) a temporary folder is made where that is unset.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a slash at its end."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
        _made.append(folder[7:])
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@atexit.register
def _clean() -> None:
    for folder in _made:
        shutil.rmtree(folder, ignore_errors=True)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tidemill/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str, *folders: str) -> DataFrame:
    """df, written as Parquet to the shared folder (in folders by the values of some columns) and read back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.mode("overwrite").partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of staged tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for frame in frames:
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            if "/tidemill/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
