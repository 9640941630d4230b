"""Scans, keyset pages, blobs and snapshot commits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.workspace import union

#: Why a scanned file is left out, in the order in which reasons apply.
LARGE_BYTES = 2 * 1024 * 1024
BUILTIN = r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|poetry\.lock)$|\.min\.(js|css)$|\.map$"
SENSITIVE = r"(^|/)(\.env(\..*)?|id_rsa|id_ed25519|credentials(\..*)?|.*\.pem|.*\.key)$"
PRUNED = r"(^|/)(\.git|target|node_modules|\.venv|__pycache__)(/|$)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_repository(spark: SparkSession, root: str) -> DataFrame:
    """Files under a folder as (path, content, byte_count, mtime, language, skip_reason, content_hash, line_count).

    Spark's file sources pass over names that begin with a dot or an underscore.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), r"^[a-z]+:/+", "/")
    path = F.replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), base, F.lit(""))
    rows = raw.select(path.alias("path"), "content", F.col("length").alias("byte_count"), F.col("modificationTime").alias("mtime"))
    rows = rows.where(~F.col("path").rlike(PRUNED))
    rows = rows.withColumn("text", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")))
    rows = rows.withColumn("skip_reason", skip_reason(F.col("path"), F.col("byte_count"), F.col("text").isNull() | F.substring("text", 1, 8192).contains("\x00")))
    return rows.select(
        "path", "text", "byte_count", "mtime", T.language_for_path(F.col("path")).alias("language"), "skip_reason",
        F.sha2("content", 256).alias("content_hash"), T.line_count(F.col("text")).alias("line_count"),
    ).orderBy("path")


def skip_reason(path, byte_count, binary):
    return F.when(byte_count > LARGE_BYTES, "large").when(path.rlike(BUILTIN), "builtin").when(path.rlike(SENSITIVE), "sensitive").when(binary, "binary")


def changed_since(scanned: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose (path, size, mtime) the scan cache doesn't know."""
    return scanned.join(cache.select("path", "byte_count", "mtime"), ["path", "byte_count", "mtime"], "left_anti")


def keyset_page(table: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    """Up to ``limit`` rows (1 to 10 000) after the cursor, in key order."""
    rows = table if cursor is None else table.where(F.col(key) > cursor)
    return rows.orderBy(key).limit(max(1, min(10_000, limit)))


def blobs(table: DataFrame, column: str) -> DataFrame:
    """Distinct contents by digest, with their size."""
    found = table.where(F.col(column).isNotNull()).groupBy(F.sha2(column, 256).alias("digest"))
    return found.agg(F.max(F.octet_length(column)).cast("long").alias("size_bytes"), F.count("*").alias("uses"))


def missing_blobs(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    return manifest.select("digest").distinct().join(stored.select("digest"), "digest", "left_anti")


def commit_snapshot(table: DataFrame, path: str, pointer: str | None = None) -> None:
    """Replaces the snapshots that ``table`` holds, partition by partition; the serving pointer is moved last.

    Without ``pointer`` the snapshots are written but not served.
    """
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)
    if pointer:
        serve(table.select("snapshot_id").distinct(), pointer)


def serve(snapshots: DataFrame, pointer: str) -> None:
    """Moves a pointer: a new version is written beside it and then renamed into it, so readers see the old or the new one."""
    spark = snapshots.sparkSession
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    system = path(pointer).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path(pointer))
    known = [int(f.getPath().getName()[2:]) for f in system.listStatus(path(pointer)) if f.getPath().getName().startswith("v-")]
    version, draft = max(known, default=0) + 1, f"{pointer}-draft-{uuid.uuid4().hex}"
    snapshots.coalesce(1).write.parquet(draft)
    if not system.rename(path(draft), path(f"{pointer}/v-{version}")):
        raise RuntimeError(f"{pointer} was moved by another writer")
    for old in known:
        if old < version - 1:  # readers of the version before may still be at work
            system.delete(path(f"{pointer}/v-{old}"), True)


def served(spark: SparkSession, pointer: str) -> DataFrame:
    """The snapshots that a pointer names now."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pointer)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return spark.read.parquet(f"{pointer}/v-{max(int(f.getPath().getName()[2:]) for f in files)}")


def update_scan_cache(cache: DataFrame, scanned: DataFrame) -> DataFrame:
    """The cache after a scan: what was scanned, whatever was known before."""
    return scanned.select("path", "byte_count", "mtime", *[c for c in cache.columns if c not in ("path", "byte_count", "mtime")])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, that of the greatest version."""
    both = union(old, new)
    columns = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(version)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])
