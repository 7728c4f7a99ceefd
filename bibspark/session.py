"""Sessions, and the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "bibspark", **conf) -> SparkSession:
    """A session with adaptive execution and UTC; everything else is the cluster's."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir.

    Only where driver and executors are one process (a local master, as in tests), a session without that setting gets a
    temporary folder; on a cluster executors couldn't read it, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="bibspark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/bibspark-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost executors, and gives
    Catalyst the true size."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Removes all that this application wrote on the way. Results that are not yet stored read it: call it after them."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
