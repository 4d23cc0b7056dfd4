"""Steps of an operator as files in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is missing and Spark runs in one process (tests, one machine) a temporary folder of this
    machine is made, one for each application; on a cluster that is an error, since executors wouldn't see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="locusframe-")
    return _LOCAL_ROOTS[app]


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/locusframe/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path that is not needed again, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; an installed copy goes first."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="locusframe-"), "locusframe_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


class Steps:
    """The written steps of one operator, deleted when they aren't needed any more.

    A step is written and read again, which cuts the lineage: a lost executor costs a task of the next step, not
    this one again, and what a step is made from is worked out once.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stash(self, df: DataFrame, label: str) -> DataFrame:
        path = shared_path(self.spark, label)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete one step."""
        _, path = self.paths.pop(id(df))
        discard(self.spark, path)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write the result, and delete all steps before it."""
        before = list(self.paths)
        out = self.stash(df, label)
        for key in before:
            discard(self.spark, self.paths.pop(key)[1])
        return out
