"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset.

    On a cluster a warehouse without a scheme or with file: may be a disk of each machine, and is refused. In local mode, as in
    tests, one machine does all, and a temporary folder of its own serves.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if ":" not in warehouse.split("/")[0] or warehouse.startswith("file:"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the warehouse {warehouse} may be each machine's own")
        return f"{warehouse.rstrip('/')}/corpusforge-scratch"
    found = getattr(spark.sparkContext, "_own_scratch", None)
    if not found:
        found = tempfile.mkdtemp(prefix="corpusforge-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext._own_scratch = found
    return found


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the application's own folder within the shared one. That folder is deleted when the application ends."""
    context, base = spark.sparkContext, scratch_dir(spark)
    folders = getattr(context, "_scratch_folders", {})
    if base not in folders:
        folders[base] = f"{base.rstrip('/')}/corpusforge-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(folders[base])
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(folder)  # what is to be deleted on exit must exist
        system.deleteOnExit(folder)
        context._scratch_folders = folders
    return f"{folders[base]}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to a new table in the shared folder and read it back.

    It cuts the lineage like checkpoint(), survives lost executors because the files are shared, is
    compressed, and gives the planner true sizes, so that later joins broadcast only what is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
