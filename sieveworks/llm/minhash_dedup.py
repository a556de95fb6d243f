"""MinHash near-deduplication with odd sketches.

A document's set is its distinct shingles of words, A-Z lower-cased.  MinHash samples of the set are
cut into bands that propose candidates, and folded into a bitmap of parities, the odd sketch: the
population count of two sketches' XOR estimates how many samples differ, most precisely where few
do.  Candidates whose sketches differ by more than a pair at the threshold would, with six standard
deviations to spare, are dropped; the others are decided on their full sets.  With 32 bands of 4 a
pair at similarity 0.8 misses all bands with probability 5e-8.

Documents with equal sets form one class before anything is compared; components of classes come
from link_blocks(), which emits no group's pairs.  A class is known by a hash of its set, so rows of
one identifier with different texts are different nodes.

A null or empty text, or one without words, has an empty set and links with nothing.  A text of
fewer words than a shingle has one shingle, the whole.  Rows with a null identifier link with
nothing.  Repeated rows are copies of each other.  An empty table gives no rows.  Only the two
named columns are read, and the row key where one is named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import map_batches, mixed, slices, starts_of, texts_of, word_hashes
from .common import maybe_in, stored
from .linking import link_blocks

BANDS, ROWS, SKETCH_BITS = 32, 4, 512
_rng = np.random.default_rng(4)
_XOR = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)[:, None]
_ODD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_FACTORS = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    words, starts = word_hashes([t.encode("utf-8", "replace").lower() for t in texts])
    n = max(0, len(words) - width + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(width):
        runs += words[k : k + n] * _FACTORS[k]
    runs = mixed(runs, width)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64, keepdims=True), b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def samples(hashes: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for a in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[a : a + 2048][None, :] ^ _XOR) * _ODD).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    bands = least.reshape(BANDS, ROWS)
    return mixed((bands * _FACTORS[:ROWS]).sum(axis=1, dtype=np.uint64) + _FACTORS[ROWS : ROWS + BANDS]).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parities of the samples, each with its number, hashed to SKETCH_BITS places; as 64-bit numbers."""
    places = mixed(least + np.arange(BANDS * ROWS, dtype=np.uint64) * _FACTORS[60]) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def most_differing_bits(threshold: float) -> int:
    """Differing sketch bits that a pair at the threshold exceeds only beyond six standard deviations."""
    k = BANDS * ROWS
    differ = k * (1 - threshold) + 6 * (k * threshold * (1 - threshold)) ** 0.5
    p = (1 - (1 - 2 / SKETCH_BITS) ** min(2 * k, 2 * differ)) / 2
    return int(SKETCH_BITS * p + 6 * (SKETCH_BITS * p * (1 - p)) ** 0.5)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64()))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row, n, d1, d2 (digest of the set), bands, sketch; docs has doc_id, row and text."""
    schema = "doc_id bigint, row bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch array<bigint>"
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], width)
                least = [samples(s) if len(s) else None for s in sets]
                digest = [np.array([mixed(s, k).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in ("doc_id", "row")), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, digest), _lists([none if x is None else band_keys(x) for x in least]), _lists([none if x is None else odd_sketch(x) for x in least])],
                    ["doc_id", "row", "n", "d1", "d2", "bands", "sketch"],
                )

    return map_batches(docs, run, schema)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """id and the sorted distinct shingle hashes; docs has id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), _lists([s.view(np.int64) for s in shingle_sets(texts[a:b], width)])], ["id", "data"])

    return map_batches(docs, run, "id bigint, data array<bigint>")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; linked where 100 * intersection >= percent * union.

    row_col names a bigint that tells rows of one identifier apart; then row and stays follow, and stays is
    true for the rows with the least (doc_id, row) of their component, and for those that link with nothing.
    """
    row = F.col(row_col) if row_col else F.lit(0)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row.cast("bigint").alias("row"), F.col(text_col).alias("text"))
    signed, _ = stored(signatures(docs, width), "signatures")
    sets_of_rows = signed.where("n > 0 and doc_id is not null")
    # the least row of each set brings its text; sets of one d1, should there be two, are told apart by d2
    found = sets_of_rows.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "row")).alias("head"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes, _ = stored(found.withColumn("id", F.xxhash64("d1", "d2")), "classes")
    members = classes.select("id", F.array_distinct("bands").alias("keys"))
    sketches = classes.select("id", "n", "sketch")

    def sets_of(ids: DataFrame) -> DataFrame:
        """Full sets of the ids, once each; the bitmap may let other documents through, the joins do not."""
        heads, _ = stored(classes.join(ids, "id", "left_semi").select("id", F.col("head.doc_id").alias("__doc"), F.col("head.row").alias("__row"), "d1", "d2"), "heads")
        some = maybe_in(docs.where("doc_id is not null").withColumn("k", F.xxhash64("doc_id", "row")), "k", heads.select(F.xxhash64("__doc", "__row").alias("k")), "k")
        own = some.join(heads, (F.col("doc_id") == F.col("__doc")) & F.col("row").eqNullSafe(F.col("__row"))).select("id", "text")
        return stored(full_sets(own, width).groupBy("id").agg(F.first("data").alias("data")), "sets")[0]

    def close(pivots: pa.Array, others: pa.Array, label: np.ndarray, among: bool) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect all linked sets, as places in the two lists joined."""
        size = np.concatenate([x.value_lengths().to_numpy() for x in (pivots, others)]).astype(np.int64)
        every = np.concatenate([x.flatten().to_numpy() for x in (pivots, others)]).view(np.uint64)
        owner, starts = np.repeat(np.arange(len(size)), size), starts_of(size)
        label, place = label.copy(), np.arange(len(size))
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i in range(len(pivots)):
            own = every[starts[i] : starts[i + 1]]
            may = (place > (i if among else len(pivots) - 1)) & (label != label[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
            if not may.any():
                continue
            at = np.flatnonzero(may[owner])
            both = np.bincount(owner[at][own[np.minimum(np.searchsorted(own, every[at]), len(own) - 1)] == every[at]], minlength=len(size))
            j = np.flatnonzero(may & (100 * both >= percent * (size + size[i] - both)))
            label[np.isin(label, label[j])] = label[i]
            found.append((np.full(len(j), i), j))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def payload(ids: DataFrame) -> DataFrame:
        return sets_of(ids).select("id", "data", (8 * F.size("data")).cast("bigint").alias("size"))

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda s: sketches.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
        bits = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        near = pairs.join(side("a"), "a").join(side("b"), "b")
        near = near.where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (bits <= most_differing_bits(percent / 100))).select("a", "b")
        near, _ = stored(near, "candidates")
        ends = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
        sets = sets_of(ends)
        of = lambda s: sets.select(F.col("id").alias(s), F.col("data").alias(f"set_{s}"))
        same = F.size(F.array_intersect("set_a", "set_b"))
        return near.join(of("b"), "b").join(of("a"), "a").where(100 * same >= percent * (F.size("set_a") + F.size("set_b") - same)).select("a", "b")

    reached = link_blocks(members, verify, payload, close)
    joined, _ = stored(classes.select("d1", "d2", "head", "id").join(reached, "id", "left").select("d1", "d2", "head", F.coalesce("component", "id").alias("component")), "labels")
    heads, _ = stored(joined.groupBy("component").agg(F.min("head").alias("first")), "heads")
    labels, _ = stored(joined.join(heads, "component").select("d1", "d2", "first"), "labels")
    linked = sets_of_rows.join(labels, ["d1", "d2"]).select("doc_id", "row", "n", F.col("first.doc_id").alias("component_id"), F.col("first").eqNullSafe(F.struct("doc_id", "row")).alias("stays"))
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", "row", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    more = ["row", "stays"] if row_col else []
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *more)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
