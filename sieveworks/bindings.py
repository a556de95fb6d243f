"""Relations of the domain bound to the tables, as DataFrames and as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    out = d.select("doc_id", path.alias("path"), F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("digest"), *(["text"] if content else []))
    return out


FILES = """files AS (SELECT doc_id, '/corpus/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size,
 sha256(text) AS digest, text FROM documents)"""


def storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.withColumn("content_id", F.when(F.col("doc_id") % 5 != 0, F.concat(F.substring("digest", 1, 8), F.lit("-"), (F.col("doc_id") % 3).cast("string")))).withColumn("inode", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 1000))


STORAGE = FILES + """, storage AS (SELECT *, CASE WHEN doc_id % 5 <> 0 THEN substr(digest, 1, 8) || '-' || (doc_id % 3)::VARCHAR END AS content_id,
 CASE WHEN doc_id % 7 <> 0 THEN doc_id % 1000 END AS inode FROM files)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree and a planted copy of it that lacks some files and has others edited: path, digest."""
    d = table(spark, sf_dir, "documents")
    rel = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    digest = F.sha2("text", 256)
    orig = d.select(F.concat(F.lit("/r/orig/"), rel).alias("path"), digest.alias("digest"))
    edited = F.when(F.col("doc_id") % 33 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(digest)
    return orig.union(d.where("doc_id % 20 <> 0").select(F.concat(F.lit("/r/copy/"), rel), edited))


TREE = """tree AS (SELECT '/r/orig/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(text) AS digest FROM documents
 UNION ALL SELECT '/r/copy/' || source || '/' || lang || '/' || doc_id || '.txt', CASE WHEN doc_id % 33 = 0 THEN sha256(text || '!') ELSE sha256(text) END
 FROM documents WHERE doc_id % 20 <> 0)"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, hash: a hash per vector; copies with two bits flipped (b); of some of these ones four bits further, which are not alike to the first (c); and with one bit (d)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", values.median_bits(F.transform("embedding", lambda x: x.cast("double"))).alias("hash"))
    name = lambda p: F.concat(F.lit(p), F.lpad(F.col("vec_id").cast("string"), 9, "0"))
    flip = F.expr("shiftleft(1L, cast(vec_id % 31 as int)) | shiftleft(1L, cast(vec_id % 29 + 32 as int))")
    far, one = F.expr("shiftleft(1L, 31) | shiftleft(1L, 61) | shiftleft(1L, 62) | shiftleft(1L, 63)"), F.expr("shiftleft(1L, 31)")
    copies = [("vec_id % 5 = 0", "/img/b", flip), ("vec_id % 15 = 0", "/img/c", flip.bitwiseXOR(far)), ("vec_id % 25 = 0", "/img/d", one)]
    out = e.select("vec_id", name("/img/a").alias("path"), "hash")
    for some, p, bits in copies:
        out = out.union(e.where(some).select("vec_id", name(p), F.col("hash").bitwiseXOR(bits)))
    return out


HASHES = """h0 AS (SELECT vec_id, embedding::DOUBLE[] AS v, (list_sort(embedding::DOUBLE[])[32] + list_sort(embedding::DOUBLE[])[33]) / 2 AS m FROM embeddings),
h1 AS (SELECT vec_id, array_to_string(list_transform(v, lambda x: CASE WHEN x > m THEN '1' ELSE '0' END), '')::BIT AS hash FROM h0),
hashes AS (SELECT vec_id, '/img/a' || lpad(vec_id::VARCHAR, 9, '0') AS path, hash FROM h1
 UNION ALL SELECT vec_id, '/img/b' || lpad(vec_id::VARCHAR, 9, '0'),
 xor(hash, (repeat('0', (63 - (vec_id % 29 + 32))::INT) || '1' || repeat('0', (vec_id % 29 + 32 - vec_id % 31 - 1)::INT) || '1' || repeat('0', (vec_id % 31)::INT))::BIT)
 FROM h1 WHERE vec_id % 5 = 0
 UNION ALL SELECT vec_id, '/img/c' || lpad(vec_id::VARCHAR, 9, '0'),
 xor(xor(hash, (repeat('0', (63 - (vec_id % 29 + 32))::INT) || '1' || repeat('0', (vec_id % 29 + 32 - vec_id % 31 - 1)::INT) || '1' || repeat('0', (vec_id % 31)::INT))::BIT), ('111' || repeat('0', 29) || '1' || repeat('0', 31))::BIT)
 FROM h1 WHERE vec_id % 15 = 0
 UNION ALL SELECT vec_id, '/img/d' || lpad(vec_id::VARCHAR, 9, '0'), xor(hash, (repeat('0', 32) || '1' || repeat('0', 31))::BIT) FROM h1 WHERE vec_id % 25 = 0)"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves and, for errors, tombstones of a move of the same session: session, path, size, ts, undone."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), F.concat(F.lit("/m/"), (F.col("event_id") % 400).cast("string")).alias("path"), F.floor("value").cast("bigint").alias("size"), "ts",
        (F.col("event_type") == "error").alias("undone"), (F.col("event_id") % 97).alias("scan"), "event_id",
    )


JOURNAL = """journal AS (SELECT user_id AS session, '/m/' || (event_id % 400)::VARCHAR AS path, floor(value)::BIGINT AS size, ts,
 event_type = 'error' AS undone, event_id % 97 AS scan, event_id FROM events)"""
