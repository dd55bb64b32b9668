"""Intermediate tables in the folder that driver and executors share."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_temporary: dict[str, str] = {}  # by application: for sessions without the setting, which cannot be set later


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    A session of one machine that has none, as in tests, gets a temporary one; on a
    cluster, where executors would not see it, the setting is needed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _temporary.get(spark.sparkContext.applicationId)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _temporary[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    return f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of jobs in this block go when their job ends, not when the driver next collects garbage.

    For jobs whose result is written or taken at once: nothing reads their shuffles again.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: no lineage, real statistics."""
    spark = df.sparkSession
    path = work_dir(spark)
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Deletes what ``materialised`` wrote for frames that are no longer needed."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path
        for file in df.inputFiles()[:1]:
            folder = path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
