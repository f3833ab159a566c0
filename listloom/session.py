"""Making the package known to a session's Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names. Where that is unset, a local session (tests) gets
    a temporary folder and any other session is refused, since no folder is known to be shared there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _folders:
            _folders[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="listloom-")
        base = _folders[context.applicationId]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables in the shared folder that cut the lineage of an iteration; those that a round replaces are deleted, the
    others at the end of the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def _path(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark, self.name)
        df.write.parquet(path)
        target, fs = self._path(path)
        fs.deleteOnExit(target)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (path, table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            target, fs = self._path(self.paths.pop(id(table))[0])
            fs.delete(target, True)

    def replace(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """``new``, which may read ``old``, in its place."""
        kept = self.keep(new)
        self.drop(old)
        return kept


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys to as many tasks as the session has shuffle partitions, or cores where those are more. A
    table of few bytes a row is read by one task, however much work its rows make; rows are dealt before that work."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once per application; workers need not have it installed.

    A Python function knows what was sent before it was made, so this comes first in what makes one.
    """
    context = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _shipped or not os.path.isdir(root):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="listloom-"), "listloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.join("listloom", os.path.relpath(path, root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
