"""Where tables go that are needed for a while."""

from __future__ import annotations

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one that spark.checkpoint.dir names; it is deleted when the driver ends. Where none is set, a local
    run gets one of its own; a cluster must name one, since executors don't see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/palimpsest-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder
