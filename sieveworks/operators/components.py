"""Connected components of a pair list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import remove, stored


#: Links that one task may label: 16 MB of numbers.
ONE_TASK = 1_000_000


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links (i, j) reach."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(b.column("a").to_numpy(zero_copy_only=False), b.column("b").to_numpy(zero_copy_only=False)) for b in batches]
    if found:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = ids[least_labels(len(ids), at[: len(a)], at[len(a) :])]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label)], ["id", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) for every end of the links (a, b); component is the smallest id reachable.

    Up to ONE_TASK distinct links, counted first, are labelled by a single task, which saves the
    rounds; its memory is bounded by that number.  Beyond it: alternating large-star and small-star: every step is a distributed group-by, hot nodes are
    combined before the shuffle, links and labels never reach the driver.  The least neighbours are
    written before they are joined, so that a node with very many links is an ordinary skewed join,
    which Spark splits.  Tables written each round cut the lineage; the last round's go when it is over.
    """
    spark = edges.sparkSession
    paths: list[str] = []

    def table(df: DataFrame) -> DataFrame:
        out, path = stored(df, "links")
        paths.append(path)
        return out

    links = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if links.count() <= one_task:
        kind = links.schema["a"].dataType.simpleString()
        return table(links.coalesce(1).mapInArrow(_labelled, f"id {kind}, component {kind}"))
    while True:
        old = paths[:-1]
        del paths[:-1]
        for path in old:
            remove(spark, path)
        # large-star: neighbours above a node move to the least of its neighbourhood
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = table(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small-star: neighbours below a node, and itself, move to the least of them
        low = table(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b"))))
        links = table(large.join(low, "a").select(moved.alias("x")).select("x.a", "x.b").where("a <> b").distinct())
        # settled when every node has one link, and to a node that has none
        n = links.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("d")).first()
        if n["n"] == n["d"] and links.select(F.col("b").alias("a")).join(links.select("a"), "a", "left_semi").isEmpty():
            break
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
