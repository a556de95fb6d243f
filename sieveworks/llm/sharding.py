"""Reproducible shuffle and sharding: a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of (id, CRC of the text, size).  A keyed Feistel network
permutes the least even power of two that holds n; numbers that fall outside walk the cycle until
they are inside, so the result is a permutation of 0..n-1.  Shard and slot are the remainder and
the quotient of the permuted number: any row's place, and with the inverse walk any place's row,
follows from n, the key and the row number alone.

A null text has no bytes and CRC 0; null identifiers come first; repeated rows get a place each.
An empty table gives no rows.  Columns other than the two named ones are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import stored

ROUNDS = 4
MULTIPLIER = 2654435761
KEY = 20240229


def round_keys(key: int) -> list[int]:
    return [(key * (2 * i + 1) + 40503 * i * i) % 2**32 for i in range(1, ROUNDS + 1)]


def half_bits(n: int) -> int:
    """Bits of each half of the domain; the domain has 4**half_bits numbers, n at least."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _mix(x: np.ndarray, k: int, h: int) -> np.ndarray:
    return (((x * np.uint64(MULTIPLIER) + np.uint64(k)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - min(h, 32))) & np.uint64((1 << h) - 1)


def _feistel(x: np.ndarray, keys: list[int], h: int) -> np.ndarray:
    left, right = x >> np.uint64(h), x & np.uint64((1 << h) - 1)
    for k in keys:
        left, right = right, left ^ _mix(right, k, h)
    return (left << np.uint64(h)) | right


def _unfeistel(x: np.ndarray, keys: list[int], h: int) -> np.ndarray:
    left, right = x >> np.uint64(h), x & np.uint64((1 << h) - 1)
    for k in reversed(keys):
        left, right = right ^ _mix(left, k, h), left
    return (left << np.uint64(h)) | right


def permute(x: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n-1, or its inverse, at each x."""
    step, keys, h = _unfeistel if inverse else _feistel, round_keys(key), half_bits(n)
    y = step(x.astype(np.uint64), keys, h)
    while (out := y >= np.uint64(n)).any():
        y[out] = step(y[out], keys, h)
    return y.astype(np.int64)


def row_numbers(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with __row 0..n-1 in the order of the columns, and n; no task sees more than its range."""
    ranged, _ = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    # as many rows as ranges: bounded by the number of shuffle partitions
    numbered = ranged.withColumn("__in", inside).join(F.broadcast(starts), "__part").withColumn("__row", F.col("__start") + F.col("__in"))
    return numbered.drop("__part", "__in", "__start"), ranged.count()


def feistel_shards(docs: DataFrame, n_shards: int = 40, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, position; shard counts differ by one at most."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    numbered, n = row_numbers(narrow, ["doc_id", "text_crc32", "size"])

    @pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, key))

    return numbered.withColumn("position", place("__row")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("position") % n_shards).cast("int").alias("shard"),
        F.expr(f"position div {n_shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "position",
    )


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
