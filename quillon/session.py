"""What every part of the engine needs from the session."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Whether a query's shuffle files go when it ends; else they go with the driver's garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # on the driver, which serves the file to executors that come later too
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            return got.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, found[7:], True)
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written in the shared folder: they cut lineage and survive the loss of an executor.

    A result may read the tables of its scratch until the application ends:
    `drop` removes those that nothing reads any more, and what is left goes
    when the driver ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, by: str | None = None, codec: str | None = None) -> DataFrame:
        """The table as written; the shuffle files it took are removed."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            w = df.write.mode("overwrite")
            w = w.option("compression", codec) if codec else w
            (w.partitionBy(by) if by else w).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        if self._n == 1:
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quillon_path = path
        return out

    def sweep(self, *tables: DataFrame, least: int = 64 << 20) -> None:
        """Lets the cluster remove the shuffle files of plans that ended, if these tables hold `least` bytes.

        Spark removes them when the driver's garbage is collected, which may be
        long after; the Python side gives up its references within a second.
        """
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        held = sum((p := path(t._quillon_path)).getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for t in tables)
        if held >= least:
            gc.collect()
            time.sleep(1.2)
            self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t._quillon_path)
