"""Shared pieces: tables in the cluster's shared folder, bounded bitmaps, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..storage import fresh_path, remove, shared_dir, stored

__all__ = ["components", "fresh_path", "in_bitmap", "maybe_in", "remove", "row_hash", "shared_dir", "stored", "unlike"]

#: Bits of the membership bitmap: sixteen for a key, up to 2**28 bits, which are 32 MB.
LEAST_BITS, MOST_BITS = 20, 28
_PAGE_BITS = 15  # one row of bitmap_construct_agg covers 32,768 positions


def in_bitmap(df: DataFrame, key: str, keys: DataFrame, key_of: str, flag: str) -> DataFrame:
    """df with a flag that is true where its 64-bit key is in keys, and perhaps elsewhere.

    keys may repeat; they are counted, about, and folded into a bitmap of 2**MOST_BITS bits at most, 32 MB, which is broadcast.
    A filled bitmap has all rows true, so callers stay exact at any size.
    """
    keys = keys.where(F.col(key_of).isNotNull())
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * keys.agg(F.approx_count_distinct(key_of).alias("n")).first()["n"]).bit_length()))
    mask, page = (1 << bits) - 1, 1 << _PAGE_BITS
    slot = lambda c: F.col(c).bitwiseAND(F.lit(mask))
    pages = keys.select(slot(key_of).alias("__slot")).groupBy(F.shiftright("__slot", _PAGE_BITS).alias("__page")).agg(F.expr(f"bitmap_construct_agg(__slot % {page})").alias("__bits"))
    # a page as 64-bit numbers, whose first byte is the highest: a look-up of a row then parses nothing
    pages = pages.select("__page", F.expr(f"transform(sequence(0, {page // 64 - 1}), i -> cast(conv(hex(substring(__bits, 8 * i + 1, 8)), 16, -10) as bigint))").alias("__bits"))
    found = F.coalesce(F.expr(f"getbit(__bits[cast((__at % {page}) div 64 as int)], cast((__at ^ 56) & 63 as int)) = 1"), F.lit(False))
    return df.withColumn("__at", slot(key)).withColumn("__page", F.shiftright("__at", _PAGE_BITS)).join(F.broadcast(pages), "__page", "left").withColumn(flag, found).drop("__page", "__at", "__bits")


def maybe_in(df: DataFrame, key: str, keys: DataFrame, key_of: str) -> DataFrame:
    """Rows of df whose 64-bit key is in keys, and perhaps others."""
    return in_bitmap(df, key, keys, key_of, "__in").where("__in").drop("__in")


def unlike(name: str, taken: list[str]) -> str:
    """name, or name with underscores before it, so that no column of taken has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def row_hash(df: DataFrame) -> Column:
    """64 bits of all columns of a row."""
    return F.xxhash64(*(F.col(f"`{c}`") if not t.startswith("map") else F.to_json(F.col(f"`{c}`")) for c, t in df.dtypes))
