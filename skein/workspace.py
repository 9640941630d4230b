"""Written tables in the folder that all executors share."""

from __future__ import annotations

import gc
import hashlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session may go without one: it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder; a cluster needs one that all executors share")
        root = tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application, wherever the driver was started."""
    if spark.sparkContext.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="skein-code-"), "skein.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(folder, name)
                out.write(file, os.path.relpath(file, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(spark.sparkContext.applicationId)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _files(spark: SparkSession, *paths: str) -> list[tuple[str, int, int]]:
    """Names, sizes and times of all files in the paths."""
    jvm, conf, seen = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(conf)
        status = system.getFileStatus(target)
        files = [status] if not status.isDirectory() else list(system.listStatus(target))
        seen += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    return seen


def fingerprint(spark: SparkSession, version: int, *paths: str) -> str:
    """A digest of a version and of the names, sizes and times of all files in the paths."""
    return hashlib.sha256(repr((version, _files(spark, *paths))).encode()).hexdigest()[:24]


def size_of(spark: SparkSession, *paths: str) -> int:
    """The bytes of all files in the paths."""
    return sum(size for _, size, _ in _files(spark, *paths))


def stored(spark: SparkSession, name: str, version: int, frame: DataFrame, *paths: str) -> DataFrame:
    """A table derived from the files in ``paths``: written when it is first asked for, read after that."""
    path = f"{shared_root(spark)}/skein-{name}-{fingerprint(spark, version, *paths)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def union(*frames: DataFrame) -> DataFrame:
    """The rows of all frames, by column name, for what groups, ranks or compares them afterwards.

    Spark 4.1 takes a union of frames that are dealt out alike for dealt out itself and leaves out the shuffle of the grouping
    above; when adaptive execution then joins partitions of each frame on its own, rows of one key are grouped apart. So the
    session is told not to.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


class Workspace:
    """Written tables that cut lineage and outlive lost executors.

    ``table`` writes a frame as Parquet in the shared folder and reads it back;
    ``drop`` deletes one that is no longer read; ``close`` deletes them all. A folder of its own naming is
    deleted when the application ends, so results that are still read from it stay until then.
    """

    def __init__(self, spark: SparkSession, label: str, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_root(spark)}/skein-{label}-{uuid.uuid4().hex[:12]}"
        if root is None:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            system.mkdirs(target)
            system.deleteOnExit(target)

    def table(self, frame: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = frame.schema
        writer = frame.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        delete(self.spark, self.root)

    def release(self) -> None:
        """Let Spark's cleaner delete shuffle files of plans nobody holds any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
