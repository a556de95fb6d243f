"""Queries of the caches and the journal: trusted perceptual rows, probes by file and kind, liveness, first-seen scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as B
from ..sources import caches

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_SALTS = tuple(caches.pipeline_salt(32, 4, 256, 8, 256, 500, version) for version in (1, 2))


def q(name):
    def wrap(f):
        QUERIES[name] = f
        return f

    return wrap


def perceptual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A perceptual cache bound to the events: some rows of an older pipeline, some without frames."""
    k = F.col("event_id")
    none = F.array().cast("array<bigint>")
    return B.table(spark, sf_dir, "events").select(
        F.when(k % 37 != 0, k % 3).alias("volume"), (F.col("user_id") % 150).alias("inode"), (F.col("user_id") % 7 * 10).alias("size"), (k % 2).alias("mtime_ns"), F.lit(0).cast("bigint").alias("generation"),
        F.when(F.col("user_id") % 4 == 0, "video").otherwise("image").alias("kind"), F.when(k % 9 == 0, none).when(F.col("user_id") % 4 == 0, F.sequence(k, k + k % 8)).otherwise(F.array(k)).alias("hashes"),
        F.when(k % 5 == 0, _SALTS[0]).otherwise(_SALTS[1]).alias("pipeline_salt"), k.alias("written"),
    )


_ROWS = f"""r AS (SELECT CASE WHEN event_id % 37 <> 0 THEN event_id % 3 END AS volume, user_id % 150 AS inode, user_id % 7 * 10 AS size, event_id % 2 AS mtime_ns, 0 AS generation,
 CASE WHEN user_id % 4 = 0 THEN 'video' ELSE 'image' END AS kind, CASE WHEN event_id % 9 = 0 THEN [] WHEN user_id % 4 = 0 THEN range(event_id, event_id + event_id % 8 + 1) ELSE [event_id] END AS hashes,
 CASE WHEN event_id % 5 = 0 THEN '{_SALTS[0]}' ELSE '{_SALTS[1]}' END AS salt, event_id AS written FROM events),
p AS (SELECT volume, inode, size, mtime_ns, generation, arg_max(kind, written) AS kind, arg_max(hashes, written) AS hashes, max(written) AS written FROM r
 WHERE salt = '{_SALTS[1]}' AND len(hashes) BETWEEN 1 AND {caches.MOST_FRAMES} AND volume IS NOT NULL GROUP BY 1, 2, 3, 4, 5)"""


@q("perceptual_cache")
def _(s, d):
    known = caches.perceptual_hashes(perceptual_rows(s, d), _SALTS[1])
    return known.select("volume", "inode", "size", "mtime_ns", "kind", F.concat_ws("|", F.transform("hashes", lambda x: x.cast("string"))).alias("frames"), "written")


ORACLE_SQL["perceptual_cache"] = f"WITH {_ROWS} SELECT volume, inode, size, mtime_ns, kind, array_to_string(hashes, '|') AS frames, written FROM p"


@q("perceptual_probe")
def _(s, d):
    """Files bound to the parts; some changed their kind, some have no volume."""
    k = F.col("p_partkey")
    files = B.table(s, d, "part").select(
        k, F.when(k % 11 != 0, k % 3).alias("volume"), (k % 150).alias("inode"), (k % 7 * 10).alias("size"), (k % 2).alias("mtime_ns"), F.lit(0).cast("bigint").alias("generation"), F.when(k % 4 == 0, "video").otherwise("image").alias("kind"))
    found = caches.probe_hashes(files, caches.perceptual_hashes(perceptual_rows(s, d), _SALTS[1]))
    return found.select("p_partkey", F.col("hashes").isNotNull().alias("hit"), F.coalesce(F.size("hashes"), F.lit(0)).cast("bigint").alias("frames"))


ORACLE_SQL["perceptual_probe"] = f"""WITH {_ROWS} SELECT p_partkey, p.hashes IS NOT NULL AS hit, coalesce(len(p.hashes), 0)::BIGINT AS frames FROM part LEFT JOIN p
ON CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 3 END = p.volume AND p_partkey % 150 = p.inode AND p_partkey % 7 * 10 = p.size AND p_partkey % 2 = p.mtime_ns AND CASE WHEN p_partkey % 4 = 0 THEN 'video' ELSE 'image' END = p.kind"""


@q("cache_waste")
def _(s, d):
    keys = caches.last_written(perceptual_rows(s, d))
    k = F.col("user_id")
    inventory = B.table(s, d, "events").where(k % 150 % 10 != 3).select((F.col("event_id") % 3).alias("volume"), (k % 150).alias("inode"), (k % 5 * 10).alias("size"), (k % 150 % 13 != 0).alias("readable"))
    return caches.liveness(keys, inventory, s.range(2).select(F.col("id").alias("volume")))


ORACLE_SQL["cache_waste"] = f"""WITH {_ROWS}, k AS (SELECT DISTINCT volume, inode, size, mtime_ns FROM r WHERE volume IS NOT NULL),
i AS (SELECT event_id % 3 AS volume, user_id % 150 AS inode, max(user_id % 5 * 10) AS size, bool_or(user_id % 150 % 13 <> 0) AS readable FROM events WHERE user_id % 150 % 10 <> 3 GROUP BY 1, 2),
s AS (SELECT CASE WHEN k.volume > 1 THEN 'unmounted' WHEN i.inode IS NULL THEN 'dead' WHEN NOT i.readable THEN 'unresolvable' WHEN k.size <> i.size THEN 'superseded' ELSE 'live' END AS state FROM k LEFT JOIN i USING (volume, inode)),
c AS (SELECT count(*) AS rows, count_if(state = 'live')::BIGINT AS live, count_if(state = 'dead')::BIGINT AS dead, count_if(state = 'superseded')::BIGINT AS superseded, count_if(state = 'unresolvable')::BIGINT AS unresolvable, count_if(state = 'unmounted')::BIGINT AS unmounted FROM s)
SELECT *, CASE WHEN rows > unmounted THEN (dead + superseded)::DOUBLE / (rows - unmounted) ELSE 0.0 END AS waste FROM c"""


def scans_first_seen(journal: DataFrame) -> DataFrame:
    """The scans of each session's moves, in the order of their first move."""
    first = journal.where("not undone").groupBy("session", "scan").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    listed = first.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("at", "scan"))).alias("l"))
    return listed.select("session", F.concat_ws("|", F.transform("l", lambda x: x.scan.cast("string"))).alias("scans"))


@q("session_scans")
def _(s, d):
    return scans_first_seen(B.journal(s, d))


ORACLE_SQL["session_scans"] = f"""WITH {B.JOURNAL}, f AS (SELECT session, scan, min((ts, event_id)) AS first FROM journal WHERE NOT undone GROUP BY 1, 2)
SELECT session, string_agg(scan::VARCHAR, '|' ORDER BY first) AS scans FROM f GROUP BY 1"""
