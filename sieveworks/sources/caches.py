"""Caches of digests and perceptual hashes: appended tables, read by their last row, rewritten on demand.

A row's key says which state of which file it describes.  Appends are Parquet files with a growing
number, so the last row written wins whatever the order of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.review import FNV_BASIS, fnv1a
from ..storage import remove

KEY = ("volume", "inode", "size", "mtime_ns", "generation")
DIGEST_ROW = "volume BIGINT, inode BIGINT, size BIGINT, mtime_ns BIGINT, generation BIGINT, digest STRING, written BIGINT"
PERCEPTUAL_ROW = "volume BIGINT, inode BIGINT, size BIGINT, mtime_ns BIGINT, generation BIGINT, kind STRING, hashes ARRAY<BIGINT>, pipeline_salt STRING, written BIGINT"
#: Fixed value: frames of a video that a row holds at most.
MOST_FRAMES = 8


def pipeline_salt(*parameters: int) -> str:
    """16 hexadecimal digits that any parameter of the hash pipeline changes; each counts as eight bytes, the lowest first."""
    h = FNV_BASIS
    for x in parameters:
        h = fnv1a((x % 2**64).to_bytes(8, "little"), h)
    return f"{h:016x}"


def last_written(rows: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The row written last for each key; rows without a whole key describe no file and go."""
    rest = [c for c in rows.columns if c not in key]
    whole = rows.dropna(subset=list(key))
    return whole.groupBy(*key).agg(F.max_by(F.struct(*rest), "written").alias("__last")).select(*key, "__last.*")


def trusted_hashes(rows: DataFrame, salt: str) -> DataFrame:
    """Rows of this pipeline with at least one frame, and no more than a row may have."""
    return rows.where((F.col("pipeline_salt") == salt) & (F.size("hashes") > 0) & (F.size("hashes") <= MOST_FRAMES))


def perceptual_hashes(rows: DataFrame, salt: str) -> DataFrame:
    """What a perceptual cache knows: the last trusted row of each key."""
    return last_written(trusted_hashes(rows, salt))


def probe_hashes(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (KEY and kind) with hashes; null where the file or its kind is not the cached one."""
    found = cache.select(*KEY, "kind", "hashes")
    return files.join(found, [*KEY, "kind"], "left")


def append(rows: DataFrame, known: DataFrame | None, path: str) -> None:
    """Add rows that are new or differ from what is known; all columns but written are compared."""
    if known is not None:
        same = [c for c in rows.columns if c != "written"]
        both = [rows[c].eqNullSafe(known[c]) for c in same]
        rows = rows.join(known, [*both], "left_anti")
    rows.write.mode("append").parquet(path)


def compact(spark: SparkSession, path: str, schema: str, salt: str | None = None) -> None:
    """Rewrite a cache with one row per key, in key order.

    The new table is whole before the old one goes; the name changes hands by two renames.
    """
    rows = spark.read.schema(schema).parquet(path)
    live = last_written(rows) if salt is None else perceptual_hashes(rows, salt)
    fresh, old = f"{path.rstrip('/')}.compacting", f"{path.rstrip('/')}.old"
    live.repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.mode("overwrite").parquet(fresh)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    remove(spark, old)
    if not (files.rename(at(path), at(old)) and files.rename(at(fresh), at(path))):
        raise OSError(f"{path} was not replaced; {fresh} is whole")
    remove(spark, old)


def liveness(keys: DataFrame, inventory: DataFrame, mounted: DataFrame) -> DataFrame:
    """One row: how many cache keys are live, dead, superseded, unresolvable or on volumes that are not mounted, and the waste.

    inventory has volume, inode, size and readable of what is there now; a size that differs is an
    older version.  What cannot be read or is not mounted is never called dead.  The waste is the share of
    dead and superseded rows among those on mounted volumes, 0 where there is none.
    """
    now = inventory.groupBy("volume", "inode").agg(F.max("size").alias("__size"), F.bool_or("readable").alias("__readable"))
    there = mounted.select("volume").distinct().withColumn("__mounted", F.lit(True))
    state = (
        F.when(F.col("__mounted").isNull(), "unmounted")
        .when(F.col("__readable").isNull(), "dead")
        .when(~F.col("__readable"), "unresolvable")
        .when(F.col("size") != F.col("__size"), "superseded")
        .otherwise("live")
    )
    told = keys.join(there, "volume", "left").join(now, ["volume", "inode"], "left").select(state.alias("state"))
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    counted = told.agg(F.count(F.lit(1)).alias("rows"), *[n(s).alias(s) for s in ("live", "dead", "superseded", "unresolvable", "unmounted")])
    checkable = F.col("rows") - F.col("unmounted")
    return counted.withColumn("waste", F.when(checkable > 0, (F.col("dead") + F.col("superseded")) / checkable).otherwise(0.0))
