"""Exact deduplication as a stream with disk-backed keyed state.

The stream reads the table file by file and keeps, for every content digest, the largest stable
identifier, the locator of that row's content and the number of rows, in RocksDB state without
expiry.  Partial aggregation before the shuffle makes a hot digest one row per task.  A digest is
only a hint: wherever it was hit more than once, the full bytes are compared, by the least and the
greatest text of the digest, again combined before the shuffle.  Digests under which texts differ
are grouped by their full text.

Nulls: a null text counts as empty; a null identifier sorts below all others.  An empty table gives
no rows.  Repeated rows with equal identifier and text each get a row; equal identifiers are equal
to the one kept.  Columns other than the two named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, maybe_in

_STATE_CONF = {
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _as_glob(path: str) -> str:
    """A pattern that matches just this path: the file source takes a single file only so."""
    return f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else path


def digest_state(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest, files_per_batch: int = 4096, checkpoint: str | None = None) -> DataFrame:
    """Run the stream over what is in path and return its state: digest, keep_id, keep_file, group_size.

    With the same checkpoint, a later call reads only the files that are new.
    """
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    checkpoint = checkpoint or fresh_path(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        rows = (
            spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(_as_glob(path.rstrip("/")))
            .select(digest(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.struct(F.col(id_col).alias("id"), F.input_file_name().alias("file")).alias("row"))
        )
        query = (
            rows.groupBy("digest")
            .agg(F.max("row").alias("row"), F.count(F.lit(1)).alias("n"))
            .writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(checkpoint)
    kept, count = state.schema["value"].dataType.names
    value = F.col("value")
    return state.select(F.col("key").getField("digest").alias("digest"), value[kept]["id"].alias("keep_id"), value[kept]["file"].alias("keep_file"), value[count].alias("group_size"))


def streaming_exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest, files_per_batch: int = 4096) -> DataFrame:
    """One row per row of the Parquet table in path: id, keep_id, group_size, kept, text_sha256."""
    state = digest_state(spark, path, id_col, text_col, digest, files_per_batch)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = spark.read.parquet(path).select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    hits = state.where("group_size > 1").select(F.xxhash64("digest").alias("k"))
    differing = (
        maybe_in(docs.withColumn("k", F.xxhash64("digest")), "k", hits, "k")
        .groupBy("digest")
        .agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
        .where("lo <> hi")
        .select("digest")
    )
    result = ["doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256"]
    docs = docs.withColumn("text_sha256", F.sha2("text", 256))
    plain = docs.select("doc_id", "digest", "text_sha256").join(state.drop("keep_file"), "digest")
    if differing.isEmpty():
        return plain.select(*result)
    apart = docs.join(differing, "digest", "left_semi")
    groups = apart.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return plain.join(differing, "digest", "left_anti").select(*result).unionByName(apart.join(groups, ["digest", "text"]).select(*result))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming_exact_dedup(spark, f"{sf_dir}/documents.parquet")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
