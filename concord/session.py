"""Session helpers shared by every operator: where shared intermediates live and how lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (unit tests, a single-JVM session) a temporary folder is made
    and recorded in the session, so that every later caller sees the same one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="concord-shared-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    The table survives the loss of any executor, unlike a local checkpoint or a cached frame.
    """
    path = f"{shared_dir(df.sparkSession)}/concord/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the table behind a frame made by ``cut`` that nothing lazy reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/concord/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
