"""Tables that cut lineage, written below the shared checkpoint folder.

A stage that several later jobs read is written once as Parquet to the folder
the session names in ``spark.checkpoint.dir`` and read back, so that a lost
executor costs a re-read of a file and not a recomputation. Results are lazy
and read these files, so they stay until ``drop()`` or the end of the driver
process.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` names it.

    Where the session names none, a local folder serves a session whose executors
    are threads of the driver's own process; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session is gone, and its folder with it
        pass


class Scratch:
    """One operator run's folder of intermediate tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(_delete, spark, self.folder)

    def save(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` once and return the reread table."""
        self.count += 1
        path = f"{self.folder}/{self.count:02d}-{label}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the folder now; results that read it can no longer run."""
        _delete(self.spark, self.folder)
