"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are rotated onto the principal axes of a sample, so that the leading coordinates carry
most of a product.  Vectors of a label are sorted by the first coordinate and packed into tiles.
Tiles whose boxes of leading coordinates and suffix norms cannot hold a close pair are never
compared.  Within a pair of tiles, products are accumulated a few axes at a time; the rest of each
product is at most the product of the suffix norms, and a block stops when no pair in it can reach
the threshold.  Pairs that may reach it are decided by the cosine of the given vectors in double
precision.  A rotation changes no product, so the sample decides the order of work and no result.

Equal vectors of a label are compared once and counted as often as they occur.  A pair of tiles
returns a link count per vector and a spanning forest, never its pairs, so a large group of close
vectors costs rows in proportion to its size.

Vectors that are null, empty, zero or have null or non-finite components, and rows with a null
label or identifier, link with nothing: n_links 0, the row is its own component and kept.  Vectors
of different length do not link.  Rows with one identifier are one node.  An empty table gives no
rows.  Only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components, least_labels
from .common import stored

#: Rows of a tile that travels; rows of a block that is compared at once; axes after which a block may stop.
TILE_ROWS, BLOCK_ROWS, STOPS = 4096, 512, (4, 8, 16, 32)
BOX_AXES, SAMPLE_ROWS, SLACK = 8, 4096, 1e-9


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """Axes as columns, the one with the largest second moment first."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(unit.T @ unit)
    return np.ascontiguousarray(axes[:, ::-1])


def close_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of rows of x and y with cosine >= threshold; for same, each pair of rows once."""
    norms = [np.linalg.norm(v, axis=1) for v in (x, y)]
    p, q = (v / n[:, None] @ axes for v, n in zip((x, y), norms, strict=True))
    stops = [s for s in STOPS if s < p.shape[1]]
    rest = [[np.linalg.norm(v[:, s:], axis=1) for s in stops] for v in (p, q)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(x), BLOCK_ROWS):
        u = p[a : a + BLOCK_ROWS]
        for b in range(a if same else 0, len(y), BLOCK_ROWS):
            v = q[b : b + BLOCK_ROWS]
            dots, begin, sparse = np.zeros((len(u), len(v))), 0, None
            for k, stop in enumerate(stops):
                dots += u[:, begin:stop] @ v[:, begin:stop].T
                begin = stop
                may = dots + np.outer(rest[0][k][a : a + BLOCK_ROWS], rest[1][k][b : b + BLOCK_ROWS]) >= threshold - SLACK
                n = np.count_nonzero(may)
                if n * 50 < may.size:  # none, or so few that they are cheaper one by one
                    sparse = np.nonzero(may)
                    break
            i, j = sparse if sparse is not None else np.nonzero(dots + u[:, begin:] @ v[:, begin:].T >= threshold - SLACK)
            i, j = i + a, j + b
            if same:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 65536):
                s, t = i[at : at + 65536], j[at : at + 65536]
                cosine = np.einsum("ij,ij->i", x[s], y[t]) / (norms[0][s] * norms[1][t])
                ok = cosine >= threshold
                found.append((s[ok], t[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _box(axes_of: dict[int, np.ndarray], v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    p = v / np.linalg.norm(v, axis=1, keepdims=True) @ axes_of[v.shape[1]]
    lead = p[:, :BOX_AXES]
    return lead.min(axis=0), lead.max(axis=0), float(np.linalg.norm(p[:, BOX_AXES:], axis=1).max())


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile_rows: int = TILE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.transform(vector_col, lambda x: x.cast("double") + 0.0).alias("v"))
    # x - x is zero for finite numbers alone
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: F.coalesce(x - x == 0, F.lit(False))) & F.exists("v", lambda x: x != 0), F.lit(False))
    classes, _ = stored(rows.where(sound).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("v")), "classes")

    share = SAMPLE_ROWS / max(1, classes.count())
    sample = classes.where(F.pmod(F.xxhash64("rep", "v"), F.lit(1 << 20)) < share * (1 << 20)).select("v").limit(2 * SAMPLE_ROWS).collect()
    axes_of = {r["dim"]: np.eye(r["dim"]) for r in classes.select("dim").distinct().collect()}
    for dim in axes_of:
        if len(own := [r["v"] for r in sample if len(r["v"]) == dim]) > 1:
            axes_of[dim] = principal_axes(np.array(own))
    axes = spark.sparkContext.broadcast(axes_of)  # dim * dim numbers for each length of vector

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [float(np.dot(v, axes.value[len(v)][:, 0]) / np.linalg.norm(v)) for v in map(np.array, batch.column("v").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.float64())], [*batch.schema.names, "lead"])

    tile_type = "tile bigint, label string, dim int, size int, ids binary, ns binary, vs binary, lo array<double>, hi array<double>, rest double"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        at = None

        def tile() -> pa.RecordBatch:
            v = np.array([x[2] for x in kept])
            ids, ns = np.array([x[0] for x in kept], np.int64), np.array([x[1] for x in kept], np.int64)
            lo, hi, rest = _box(axes.value, v)
            # the least identifier of a tile is in no other tile of its label and length
            one = [int(ids.min()), at[0], at[1], len(kept), ids.tobytes(), ns.tobytes(), v.tobytes(), lo.tolist(), hi.tolist(), rest]
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, types, strict=True)], ["tile", "label", "dim", "size", "ids", "ns", "vs", "lo", "hi", "rest"])

        for batch in batches:
            for label, dim, rep, n, v in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "rep", "n", "v")), strict=True):
                if kept and (at != (label, dim) or len(kept) >= tile_rows):
                    yield tile()
                    kept.clear()
                at = (label, dim)
                kept.append((rep, n, v))
        if kept:
            yield tile()

    led = classes.select("label", "dim", "rep", "n", "v").mapInArrow(lead, "label string, dim int, rep bigint, n bigint, v array<double>, lead double")
    order = ["label", "dim", "lead", "rep"]
    tiles, _ = stored(led.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, tile_type), "tiles")

    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("tile", "lo", "hi", "rest")]
    ends = F.arrays_zip("lo_a", "hi_a", "lo_b", "hi_b")
    most = F.aggregate(ends, F.lit(0.0), lambda acc, e: acc + F.greatest(e["lo_a"] * e["lo_b"], e["lo_a"] * e["hi_b"], e["hi_a"] * e["lo_b"], e["hi_a"] * e["hi_b"]))
    meta_a, meta_b = (tiles.select("label", "dim", *side(s)) for s in "ab")
    pairs = (
        meta_a.join(meta_b, ["label", "dim"])
        .where((F.col("tile_a") == F.col("tile_b")) | (F.col("tile_a") < F.col("tile_b")) & (most + F.col("rest_a") * F.col("rest_b") >= threshold - SLACK))
        .select("label", "dim", "tile_a", "tile_b")
    )
    needed = pairs.withColumn("tile", F.explode(F.array_distinct(F.array("tile_a", "tile_b"))))
    shipped = needed.join(tiles.select("label", "dim", "tile", "ids", "ns", "vs"), ["label", "dim", "tile"])

    def compare(table: pa.Table) -> pa.Table:
        two = []
        for ids, ns, vs, dim in zip(*(table.column(c).to_pylist() for c in ("ids", "ns", "vs", "dim")), strict=True):
            two.append((np.frombuffer(ids, np.int64), np.frombuffer(ns, np.int64), np.frombuffer(vs, np.float64).reshape(-1, dim)))
        (ids, ns, x), (ids2, ns2, y) = two[0], two[-1]
        same = len(two) == 1
        i, j = close_pairs(x, y, axes.value[x.shape[1]], threshold, same)
        if not same:
            j, ids, ns = j + len(ids), np.concatenate([ids, ids2]), np.concatenate([ns, ns2])
        links = np.bincount(i, ns[j], len(ids)) + np.bincount(j, ns[i], len(ids))
        order = np.argsort(ids, kind="stable")  # so that the least label is the least identifier
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        least = ids[order][least_labels(len(ids), place[i], place[j])][place]
        at = np.flatnonzero(links)
        return pa.table({"a": pa.array(ids[at]), "b": pa.array(least[at]), "links": pa.array(links[at].astype(np.int64))})

    found, _ = stored(shipped.groupBy("label", "dim", "tile_a", "tile_b").applyInArrow(compare, "a bigint, b bigint, links bigint"), "found")
    reached = components(found.select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    node = (
        classes.select("label", "v", "rep", "n")
        .join(counts, F.col("rep") == counts["a"], "left")
        .join(reached, F.col("rep") == reached["id"], "left")
        .select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    node, _ = stored(node, "nodes")
    linked = rows.where(sound).join(node, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
 WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93),
reach(n, m) AS (SELECT a, a FROM links UNION SELECT r.n, l.b FROM reach r JOIN links l ON r.m = l.a),
c AS (SELECT n, min(m) AS component FROM reach GROUP BY n), k AS (SELECT a, count(*) AS links FROM links GROUP BY a)
SELECT vec_id, coalesce(k.links, 0)::BIGINT AS n_links, coalesce(c.component, vec_id) AS component_id, coalesce(c.component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON n = vec_id LEFT JOIN k ON a = vec_id"""
