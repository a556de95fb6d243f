"""Connecting the members of hash buckets without emitting all pairs of a bucket.

The links of a bucket are the pairs in it that verification accepts.  Components need fewer
comparisons than there are pairs: once two members are connected, their pair cannot change the
result.  Every member of a bucket is first held against one of them, the bucket's centre, which is a row per
member at most, whatever the size of the bucket.  A bucket whose members are then in one component is done.
In the others, members of different components are compared: in buckets of a few members pair by
pair; in larger ones all members outside the bucket's largest component, the pivots, are compared with all
members of another component.  Every pair of a bucket is thus either compared or already connected, so no
component differs from that of comparing all pairs.

Buckets are found on packed numbers: a task sends its keys, sorted, with their ids as bytes to the parts of
the range of keys, and a part sorts what it gets.  Of a key that a batch holds more than twice, two members go
to the key's part and the others, which are known to share it, to any part, so no key is a large part.
Where most keys are of one id alone, sifted() finds the others first: tasks send the first bits of keys only,
and a bitmap of those that came twice tells which keys, with their ids, travel at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, least_labels
from .batches import map_batches, release, starts_of
from .common import LEAST_BITS, MOST_BITS, maybe_in, stored

SMALL, ROWS_A_TASK, IDS_A_PART = 8, 100_000, 32_768
#: First bits of a key by which it is sifted, the bytes of these, and ids whose keys one part sifts.
SLOT_BITS, SLOT_BYTES, SIFTED_A_PART = 40, 5, 65_536
#: Members of a tile, bytes of a tile's data, and pivots that are compared with a tile at once.
TILE, TILE_BYTES, PIVOTS = 4096, 4_000_000, 512


def _packed(batches: Iterator[pa.RecordBatch], parts: int, info: list[str]) -> Iterator[pa.RecordBatch]:
    """part and data, sorted rows of a key, an id and perhaps its info; from number parts on, parts hold rows whose key is known to be shared.

    The first bytes of all numbers stand before the second ones, as the high bytes of sorted keys then are runs that compress.
    """
    for batch in batches:
        lists = batch.column("keys")
        key = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(key):
            continue
        order, times = np.argsort(key), lists.value_lengths().to_numpy()
        key = key[order]
        columns = [key.view(np.int64), *(np.repeat(batch.column(c).to_numpy(), times)[order] for c in ("id", *info))]
        at = np.arange(len(key))
        begins = np.append(True, key[1:] != key[:-1])
        known = at - np.maximum.accumulate(np.where(begins, at, 0)) >= 2
        part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        for some, number in ((~known, part[~known]), (known, np.full(int(known.sum()), parts + part[len(part) // 2]))):
            if len(number):
                data = np.stack([c[some] for c in columns], axis=1).view(np.uint8)
                cuts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
                chunks = [x.T.tobytes() for x in np.split(data, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(number[cuts].astype(np.int32)), pa.array(chunks, pa.binary())], ["part", "data"])


def as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, info and keys of a batch as bytes, a row for each batch; ids all have the same number of keys."""
    for batch in batches:
        if len(batch):
            columns = (batch.column("id"), batch.column("info"), batch.column("keys").flatten())
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in columns], ["id", "info", "keys"])


def _numbers(column: pa.Array) -> np.ndarray:
    """The 64-bit numbers of all rows of bytes."""
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in column)])


def sifted(rows: DataFrame, n_members: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes id, info and keys of batches of rows (those of as_rows()), with the keys alone that another row has, and perhaps a few more.

    The bitmap has sixteen bits for a key that is shared, 2**MOST_BITS at most, which are 32 MB; where it fills, more keys stay.
    """
    parts = n_members // SIFTED_A_PART + 1
    sc = rows.sparkSession.sparkContext

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.sort(_numbers(batch.column("keys")).view(np.uint64) >> np.uint64(64 - SLOT_BITS))
            if not len(slot):
                continue
            slot = slot[np.append([True, True], slot[2:] != slot[:-2])[: len(slot)]]  # two are enough to be shared
            number = ((slot >> np.uint64(SLOT_BITS - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            cuts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            data = slot.view(np.uint8).reshape(-1, 8)[:, :SLOT_BYTES]
            chunks = [np.ascontiguousarray(x.T).tobytes() for x in np.split(data, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(number[cuts]), pa.array(chunks, pa.binary())], ["part", "data"])

    def repeated(found: pa.Table) -> pa.Table:
        planes = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8).reshape(SLOT_BYTES, -1) for x in found.column("data")], axis=1)
        slot = np.zeros((planes.shape[1], 8), np.uint8)
        slot[:, :SLOT_BYTES] = planes.T
        slot = np.sort(slot.view(np.uint64).ravel())
        out = pa.table({"slots": pa.array([np.unique(slot[1:][slot[1:] == slot[:-1]]).tobytes()], pa.binary())})
        release()
        return out

    slots, _ = stored(map_batches(rows.select("keys"), sent, "part int, data binary").groupBy("part").applyInArrow(repeated, "slots binary"), "slots")
    n = slots.agg(F.coalesce(F.sum(F.octet_length("slots")), F.lit(0)).alias("n")).first()["n"] // 8
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("slots"):
                at = (np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(SLOT_BITS - bits)).astype(np.int64)
                if len(at):
                    low = int(at[0]) >> 3  # a part has a range of keys, so of the bitmap
                    piece = np.zeros(((int(at[-1]) >> 3) - low + 1) * 8, bool)
                    piece[at - 8 * low] = True
                    yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([np.packbits(piece, bitorder="little").tobytes()], pa.binary())], ["low", "piece"])

    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for low, piece in map_batches(slots, pieces, "low bigint, piece binary").collect():
        bitmap[low : low + len(piece)] |= np.frombuffer(piece, np.uint8)
    shared = sc.broadcast(bitmap.tobytes())

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, info, keys = (_numbers(batch.column(c)) for c in ("id", "info", "keys"))
            if not len(ids):
                continue
            keys = keys.reshape(len(ids), -1)
            at = keys.view(np.uint64) >> np.uint64(64 - bits)
            may = (known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            times = may.sum(axis=1)
            some = times > 0
            lists = pa.ListArray.from_arrays(pa.array(starts_of(times[some]).astype(np.int32)), pa.array(keys[may]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(info[some]), lists], ["id", "info", "keys"])

    return opened


def stars(members: DataFrame, parts: int | None = None, opened: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> DataFrame:
    """key, id, a and n of the keys of two ids or more: a is the key's centre, one of its ids, and n counts those that the key's part has.

    n is 0 for the others, whose centre another row has; their a is their own id.  Where members have info, so have the rows, and info_a of the centre.
    opened makes the members of batches of them, where these are packed.
    """
    parts = parts or members.count() // IDS_A_PART + 1
    info = [c for c in members.columns if c == "info"]

    def shared(number: tuple, rows: pa.Table) -> pa.Table:
        planes = [np.frombuffer(x.as_buffer(), np.uint8).reshape(8 * (2 + len(info)), -1) for x in rows.column("data")]
        all_rows = np.ascontiguousarray(np.concatenate(planes, axis=1).T).view(np.int64)
        own = number[0].as_py() < parts
        if own:
            all_rows = all_rows[np.argsort(all_rows[:, 0])]
            same = all_rows[1:, 0] == all_rows[:-1, 0]
            all_rows = all_rows[np.append(same, False) | np.append(False, same)]
            all_rows = all_rows[np.lexsort((all_rows[:, 1], all_rows[:, 0]))]
        columns = [np.ascontiguousarray(c) for c in all_rows.T]
        key, n, centre = columns[0], np.zeros(len(all_rows), np.int64), np.arange(len(all_rows))
        if own and len(key):
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            times = np.diff(np.append(first, len(key)))
            n, centre = np.repeat(times, times), np.repeat(first, times)
        out = [*columns[:2], columns[1][centre], n, *columns[2:], *(c[centre] for c in columns[2:])]
        release()
        return pa.table(dict(zip(names, out, strict=True)))

    names = ["key", "id", "a", "n", *info, *(f"{c}_a" for c in info)]
    packed = map_batches(members.select("id", "keys", *info), lambda batches: _packed(opened(batches), parts, info), "part int, data binary")
    return packed.groupBy("part").applyInArrow(shared, ", ".join(f"{c} bigint" for c in names))


def buckets(members: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct (key, id) of the keys of two ids or more; members has id and keys, an array of 64-bit hashes."""
    return stars(members, parts).select("key", "id")


def link_blocks(members: DataFrame, verify: Callable[[DataFrame], DataFrame], payload: Callable[[DataFrame], DataFrame], close: Callable[[pa.Array, pa.Array, np.ndarray, bool], tuple[np.ndarray, np.ndarray]], small: int = SMALL, tile: int = TILE, pivots: int = PIVOTS, near: Column | None = None, ready: Callable[[DataFrame], None] | None = None, n_members: int | None = None, opened: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> DataFrame:
    """(id, component) of all ids that have a link.

    members has id, keys (an array of distinct 64-bit hashes, no key in two rows of an id), and perhaps info, a bigint
    that the condition near on pairs reads, as info and info_b; it is scanned once where about n_members are said to be in it, else counted before.  verify takes and returns
    pairs (a, b).  opened is that of stars().  ready gets the ids, repeated ones too, that verify and payload may be asked for, before these are.

    Ids that the larger open buckets connect make a block, which is cut into tiles of bounded bytes.  The pivots of a
    block, in slices, travel to all its tiles; a task compares a slice with a tile and returns a spanning forest of the links.
    Two pivots meet in one task alone: those of a slice in one tile of their block, those of two slices where one
    of them, by turns, is a member of its tile.
    payload(ids) gives (id, data, size) for the ids asked for, size in bytes; close(pivots' data, members' data,
    labels, among) gives places, in the two lists joined, of linked pairs that connect all that are linked, where
    labels, numbers below the length of the lists, tell what is connected already; pivots are compared with each
    other only if among.
    """

    def table(df: DataFrame, what: str) -> DataFrame:
        return stored(df, what)[0]

    extra = [c for c in members.columns if c == "info"]
    condition = near if near is not None else F.lit(True)
    shared = table(stars(members, None if n_members is None else n_members // IDS_A_PART + 1, opened), "buckets")
    if ready is not None:
        ready(shared.select("id"))
    parts = shared.count() // ROWS_A_TASK + 8  # of tables of a row per member of a bucket
    far, other = shared.where("n = 0"), shared.where("id <> a")
    in_far = lambda rows: maybe_in(rows, "key", far.select(F.col("key").alias("k")), "k")
    own = other.select("a", F.col("id").alias("b"), *[F.col(f"{c}_a").alias(c) for c in extra], *[F.col(c).alias(f"{c}_b") for c in extra]).where(condition)
    centres = in_far(shared.where("n > 0 and id = a")).select("key", "a", *extra)
    others = centres.join(far.select("key", F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in extra]), "key").where(condition)
    linked = own.select("a", "b").union(others.select("a", "b")).distinct()
    links = table(verify(table(linked, "pairs")), "verified")
    found = components(links)

    def grown(new: DataFrame) -> DataFrame:
        return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(new))

    def unfinished(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        """left (key, id, ...) with the component of each, and the keys with two or more."""
        live = table(left.join(found, "id", "left").select(*left.columns, F.coalesce("component", "id").alias("comp")).coalesce(parts), "live")
        tally = live.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
        kinds = tally.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max_by("comp", F.struct("c", "comp")).alias("major"), F.sum("c").alias("rest"))
        return live, table(kinds.where("kinds > 1").select("key", "major", "rest").coalesce(parts), "open")

    # the centre has been compared with all others
    begin = other.where("n > 2").union(far).union(in_far(other.where("n = 2"))).select("key", "id", *extra)
    live, keys = unfinished(begin)
    if keys.isEmpty():
        return found
    few = live.join(keys.where(F.col("rest") <= small).select("key"), "key")
    one = few.select("key", F.col("id").alias("a"), F.col("comp"), *extra)
    two = few.select("key", F.col("id").alias("b"), F.col("comp").alias("comp_b"), *[F.col(c).alias(f"{c}_b") for c in extra])
    pairs = table(one.join(two, "key").where((F.col("a") < F.col("b")) & (F.col("comp") != F.col("comp_b")) & condition).select("a", "b").distinct(), "pairs")
    found = grown(table(verify(pairs), "verified"))

    def still_open(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        """left (id, keys) without the keys that are done, and whether an id is outside the largest component of a key; a row per id, whatever the number of its keys."""
        live = table(left.join(found, "id", "left").select("id", "keys", F.coalesce("component", "id").alias("comp")).coalesce(parts), "live")
        each = live.select("id", "comp", F.explode("keys").alias("key"))
        tally = each.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
        kinds = tally.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max_by("comp", F.struct("c", "comp")).alias("major"))
        keys = table(kinds.where("kinds > 1").select("key", "major").coalesce(parts), "open")
        active = each.join(keys, "key").groupBy("id").agg(F.collect_list("key").alias("keys"), F.bool_or(F.col("comp") != F.col("major")).alias("pivot"), F.first("comp").alias("comp"))
        return table(active.coalesce(parts), "active"), keys

    left = table(live.join(keys.where(F.col("rest") > small).select("key"), "key").groupBy("id").agg(F.collect_list("key").alias("keys")).coalesce(parts), "left")
    active, keys = still_open(left)
    if keys.isEmpty():
        return found

    member = active.select("id", F.explode("keys").alias("key"))
    low = table(member.groupBy("key").agg(F.min("id").alias("b")), "least")
    blocks = table(components(member.join(low, "key").where("id <> b").select(F.col("id").alias("a"), "b")).withColumnRenamed("component", "block"), "blocks")
    body = table(payload(blocks.select("id")).join(blocks.join(active.select("id", "pivot", "comp"), "id"), "id"), "bodies")
    # a slice of the pivots has no more bytes than a tile
    pieces = lambda n, size, most: F.greatest(F.lit(1), F.ceil(n / most), F.ceil(size / TILE_BYTES)).cast("int")
    of_pivots = lambda what: F.sum(F.when(F.col("pivot"), what).otherwise(0))
    cuts = body.groupBy("block").agg(pieces(F.count(F.lit(1)), F.sum("size"), tile).alias("tiles"), pieces(of_pivots(F.lit(1)), of_pivots(F.col("size")), pivots).alias("slices"))
    cuts = table(cuts.coalesce(parts), "tiles")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        chosen, rest = rows.filter(rows.column("chosen")), rows.filter(pa.compute.invert(rows.column("chosen")))
        among = len(chosen) > 0 and chosen.column("among")[0].as_py()
        ids, comps = (np.concatenate([x.column(c).to_numpy() for x in (chosen, rest)]) for c in ("id", "comp"))
        i, j = close(*(x.column("data").combine_chunks() for x in (chosen, rest)), np.unique(comps, return_inverse=True)[1], among)
        label = ids[least_labels(len(ids), i, j)] if len(i) else ids
        moved = np.flatnonzero(label != ids)
        out = pa.table({"a": pa.array(ids[moved]), "b": pa.array(label[moved])})
        release()
        return out

    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    placed = body.join(cuts, "block")
    here = placed.withColumn("tile", place("tiles")).withColumn("slice", each("slices")).withColumn("chosen", F.lit(False)).withColumn("among", F.lit(False))
    # a pivot of another slice is a member where that slice is less than half a turn behind its own
    turn = 2 * F.pmod(place("slices") - F.col("slice"), F.col("slices"))
    here = here.where(~F.col("pivot") | ((turn > 0) & (turn < F.col("slices"))) | ((turn == F.col("slices")) & (F.col("slice") < place("slices"))))
    sent = placed.where("pivot").withColumn("slice", place("slices")).withColumn("tile", each("tiles")).withColumn("chosen", F.lit(True)).withColumn("among", F.col("tile") == F.pmod("slice", "tiles"))
    columns = ["block", "tile", "slice", "id", "comp", "data", "chosen", "among"]
    new = table(here.select(columns).union(sent.select(columns)).groupBy("block", "tile", "slice").applyInArrow(compare, "a bigint, b bigint"), "verified")
    return found if new.isEmpty() else grown(new)
