"""Listings, caches, journals, libraries of scans, and plain value functions."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import paths, values
from .ordering import ranked

#: Names that a walk prunes or skips.
IGNORED_DIRECTORIES = ("node_modules", ".git", "__pycache__")
NOISE_FILES = (".DS_Store", "Thumbs.db", "desktop.ini")
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def q(name):
    def wrap(f):
        QUERIES[name] = f
        return f

    return wrap


def listing(spark, sf_dir) -> DataFrame:
    """Walk candidates bound to the pages."""
    k = F.col("page_id")
    name = F.when(k % 13 == 0, ".DS_Store").when(k % 11 == 0, F.concat(F.lit(".h"), k.cast("string"))).when(k % 17 == 0, "node_modules").otherwise(F.concat(F.lit("n"), k.cast("string")))
    return B.table(spark, sf_dir, "pages").select(
        "page_id", name.alias("name"), (k % 3 == 0).alias("is_directory"), (k % 19 == 0).alias("is_symlink"), (k % 23 != 0).alias("is_regular"), (k % 29 == 0).alias("is_package"),
        (k % 31 == 0).alias("foreign"), F.when(k % 7 != 0, k % 50).alias("inode"), (k % 5 * 100).alias("size"), F.lit(1).cast("bigint").alias("volume"),
    )


LISTING = """listing AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN '.DS_Store' WHEN page_id % 11 = 0 THEN '.h' || page_id WHEN page_id % 17 = 0 THEN 'node_modules' ELSE 'n' || page_id END AS name,
 page_id % 3 = 0 AS is_directory, page_id % 19 = 0 AS is_symlink, page_id % 23 <> 0 AS is_regular, page_id % 29 = 0 AS is_package, page_id % 31 = 0 AS foreign_volume,
 CASE WHEN page_id % 7 <> 0 THEN page_id % 50 END AS inode, page_id % 5 * 100 AS size FROM pages)"""


def prune_reason(excluded):
    """First reason wins; null is walked."""
    return (
        F.when(excluded, "excluded").when(F.col("is_symlink"), "symlink").when(F.col("foreign"), "foreign volume").when(F.col("name").isin(*IGNORED_DIRECTORIES), "ignored name")
        .when(F.col("is_package"), "package").when(F.startswith("name", F.lit(".")), "hidden")
    )


def skip_reason(least: int = 1):
    return (
        F.when(F.col("is_symlink"), "symlink").when(~F.col("is_regular"), "not regular").when(F.col("name").isin(*NOISE_FILES), "noise").when(F.startswith("name", F.lit(".")), "hidden")
        .when(F.col("size") < least, "below minimum")
    )


@q("walk_prune_reasons")
def _(s, d):
    return listing(s, d).where("is_directory").select("page_id", F.coalesce(prune_reason(F.coalesce(F.col("inode") == 9, F.lit(False))), F.lit("walked")).alias("reason"))


ORACLE_SQL["walk_prune_reasons"] = f"""WITH {LISTING} SELECT page_id, CASE WHEN coalesce(inode = 9, false) THEN 'excluded' WHEN is_symlink THEN 'symlink' WHEN foreign_volume THEN 'foreign volume'
WHEN name = 'node_modules' THEN 'ignored name' WHEN is_package THEN 'package' WHEN starts_with(name, '.') THEN 'hidden' ELSE 'walked' END AS reason FROM listing WHERE is_directory"""


@q("walk_skip_reasons")
def _(s, d):
    return listing(s, d).where("not is_directory").groupBy(F.coalesce(skip_reason(), F.lit("taken")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


ORACLE_SQL["walk_skip_reasons"] = f"""WITH {LISTING} SELECT CASE WHEN is_symlink THEN 'symlink' WHEN NOT is_regular THEN 'not regular' WHEN name = '.DS_Store' THEN 'noise' WHEN starts_with(name, '.') THEN 'hidden'
WHEN size < 1 THEN 'below minimum' ELSE 'taken' END AS reason, count(*) AS files FROM listing WHERE NOT is_directory GROUP BY 1"""


@q("exclude_by_identity")
def _(s, d):
    """Rows whose identity is excluded go; an unknown identity is not excluded."""
    f = listing(s, d)
    gone = f.where("page_id % 10 = 0 and inode is not null").select("volume", "inode").distinct()
    return f.join(gone, ["volume", "inode"], "left_anti").select("page_id", "name")


ORACLE_SQL["exclude_by_identity"] = f"WITH {LISTING} SELECT page_id, name FROM listing WHERE inode IS NULL OR inode NOT IN (SELECT inode FROM listing WHERE page_id % 10 = 0 AND inode IS NOT NULL)"


@q("luma")
def _(s, d):
    p = B.table(s, d, "part")
    r, g, b = (F.col("p_partkey") * k % 256 for k in (7, 11, 13))
    return p.select("p_partkey", values.luma(r, g, b).cast("bigint").alias("luma"))


ORACLE_SQL["luma"] = "SELECT p_partkey, (p_partkey * 7 % 256 * 19595 + p_partkey * 11 % 256 * 38470 + p_partkey * 13 % 256 * 7471 + 32768) >> 16 AS luma FROM part"


def cache_rows(spark, sf_dir) -> DataFrame:
    e = B.table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 200).alias("inode"), (F.col("event_id") % 3).alias("generation"), F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("digest"), F.col("event_id").alias("seq"))


CACHE = """cache AS (SELECT user_id % 200 AS inode, event_id % 3 AS generation, 'd' || event_id AS digest, event_id AS seq FROM events),
last AS (SELECT inode, generation, arg_max(digest, seq) AS digest FROM cache GROUP BY ALL)"""


def last_rows(cache: DataFrame) -> DataFrame:
    """The row written last for every key; max_by combines before the shuffle."""
    return cache.groupBy("inode", "generation").agg(F.max_by("digest", "seq").alias("digest"))


@q("cache_last_writer_wins")
def _(s, d):
    return last_rows(cache_rows(s, d))


ORACLE_SQL["cache_last_writer_wins"] = f"WITH {CACHE} SELECT * FROM last"


@q("cache_hit_miss")
def _(s, d):
    """A file without identity never hits."""
    f = listing(s, d).select("page_id", "inode", (F.col("page_id") % 3).alias("generation"))
    out = f.join(last_rows(cache_rows(s, d)), ["inode", "generation"], "left")
    return out.select("page_id", F.col("digest").isNotNull().alias("hit"), "digest")


ORACLE_SQL["cache_hit_miss"] = f"WITH {LISTING}, {CACHE} SELECT page_id, digest IS NOT NULL AS hit, digest FROM listing LEFT JOIN last ON last.inode = listing.inode AND generation = page_id % 3"


@q("cache_liveness")
def _(s, d):
    now = listing(s, d).where("inode is not null").select("inode").distinct().withColumn("here", F.lit(1))
    c = cache_rows(s, d)
    latest = c.groupBy("inode", "generation").agg(F.max("seq").alias("top"))
    state = F.when(F.col("inode") % 41 == 0, "unmounted").when(F.col("seq") < F.col("top"), "superseded").when(F.col("here").isNull(), "dead").otherwise("live")
    return c.join(latest, ["inode", "generation"]).join(now, "inode", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("rows"))


ORACLE_SQL["cache_liveness"] = f"""WITH {LISTING}, {CACHE}, t AS (SELECT inode, seq, max(seq) OVER (PARTITION BY inode, generation) AS top FROM cache)
SELECT CASE WHEN inode % 41 = 0 THEN 'unmounted' WHEN seq < top THEN 'superseded' WHEN inode NOT IN (SELECT inode FROM listing WHERE inode IS NOT NULL) THEN 'dead' ELSE 'live' END AS state, count(*) AS rows FROM t GROUP BY 1"""


def journal_state(journal: DataFrame) -> DataFrame:
    """The last move of every path of a session, and whether a later tombstone took it back."""
    last = journal.groupBy("session", "path").agg(F.max(F.when(~F.col("undone"), F.struct("ts", "event_id", "size", "scan"))).alias("m"), F.max(F.when(F.col("undone"), F.struct("ts", "event_id"))).alias("u"))
    restored = F.coalesce(F.struct("m.ts", "m.event_id") < F.col("u"), F.lit(False))
    return last.where("m is not null").select("session", "path", F.col("m.size").alias("size"), F.col("m.scan").alias("scan"), F.col("m.ts").alias("ts"), restored.alias("restored"))


_STATE = B.JOURNAL + """, js AS (SELECT session, path, arg_max(size, (ts, event_id)) FILTER (NOT undone) AS size, arg_max(scan, (ts, event_id)) FILTER (NOT undone) AS scan, max(ts) FILTER (NOT undone) AS ts,
 coalesce(max((ts, event_id)) FILTER (NOT undone) < max((ts, event_id)) FILTER (undone), false) AS restored FROM journal GROUP BY session, path HAVING count_if(NOT undone) > 0),
sh AS (SELECT session, count(*) AS moved, count_if(restored)::BIGINT AS restored, sum(size)::BIGINT AS bytes, count(DISTINCT scan) AS scans, min(ts) AS first_ts FROM js GROUP BY session)"""


def session_history(state: DataFrame) -> DataFrame:
    return state.groupBy("session").agg(F.count(F.lit(1)).alias("moved"), F.count_if("restored").alias("restored"), F.sum("size").alias("bytes"), F.count_distinct("scan").alias("scans"), F.min("ts").alias("first_ts"))


@q("journal_state")
def _(s, d):
    return journal_state(B.journal(s, d)).select("session", "path", "size", "scan", "restored")


ORACLE_SQL["journal_state"] = f"WITH {_STATE} SELECT session, path, size, scan, restored FROM js"


@q("session_history")
def _(s, d):
    return session_history(journal_state(B.journal(s, d))).drop("first_ts")


ORACLE_SQL["session_history"] = f"WITH {_STATE} SELECT session, moved, restored, bytes, scans FROM sh"


@q("latest_undoable")
def _(s, d):
    return session_history(journal_state(B.journal(s, d))).where("restored < moved").orderBy(F.desc("first_ts"), F.desc("session")).limit(1).select("session", "moved", "restored")


ORACLE_SQL["latest_undoable"] = f"WITH {_STATE} SELECT session, moved, restored FROM sh WHERE restored < moved ORDER BY first_ts DESC, session DESC LIMIT 1"


@q("prunable_sessions")
def _(s, d):
    return session_history(journal_state(B.journal(s, d))).where("moved > 0 and restored >= moved").select("session", "moved")


ORACLE_SQL["prunable_sessions"] = f"WITH {_STATE} SELECT session, moved FROM sh WHERE moved > 0 AND restored >= moved"


UNDO = "session bigint, seq bigint, step bigint, original string, state string"


def plan_undo(entries: DataFrame, environment: DataFrame) -> DataFrame:
    """session, seq, step, original, state for the moves of each session, in the order in which they would be undone.

    entries: session, seq, mechanism, original, resulting, digest, restored (a later record says so);
    environment: path, digest, is_directory of what exists now.  Renames come first, the newest first, each planned
    against the files that the ones before it leave; the others follow in their order, planned against what the
    renames leave.  state is restore, already restored, or what stands in the way.  A session's steps depend on each
    other, so a session is one Arrow call; it holds that session's entries and the facts of their paths alone.
    """
    above = F.regexp_extract("original", "^(.*)/[^/]*$", 1)
    named = entries.withColumn("above", above).select("session", F.explode(F.array("original", "resulting", "above")).alias("path")).distinct()
    facts = named.join(environment, "path").select(F.col("session").alias("of"), "path", "digest", "is_directory")

    def plan(rows: pa.Table, there: pa.Table) -> pa.Table:
        now = {r["path"]: (r["digest"], r["is_directory"]) for r in there.to_pylist()}
        ordered = sorted(rows.to_pylist(), key=lambda r: r["seq"])
        renames, rest = [r for r in reversed(ordered) if r["mechanism"] == "rename"], [r for r in ordered if r["mechanism"] != "rename"]
        out = []
        for r in renames + rest:
            state = _undo_state(r, now)
            out.append(state)
            if state == "restore" and r["mechanism"] == "rename":
                now[r["original"]] = (r["digest"], now.pop(r["resulting"])[1])
        done = renames + rest
        return pa.table([pa.array([r["session"] for r in done], pa.int64()), pa.array([r["seq"] for r in done], pa.int64()), pa.array(range(len(done)), pa.int64()), pa.array([r["original"] for r in done], pa.string()), pa.array(out, pa.string())], ["session", "seq", "step", "original", "state"])

    return entries.groupBy("session").cogroup(facts.groupBy("of")).applyInArrow(plan, UNDO)


def _undo_state(entry: dict, now: dict) -> str:
    """now: digest and whether it is a directory, by path."""
    original, resulting = entry["original"], entry["resulting"]
    if entry["restored"] and original in now:
        return "already restored"
    if original in now and original != resulting:
        if now[original][1]:
            return "original is a directory"
        return "already restored" if now[original][0] == entry["digest"] else "original occupied"
    if resulting not in now:
        return "moved file missing"
    above = original.rpartition("/")[0]
    if above and above not in now:
        return "parent missing"
    if now[resulting][0] is None:
        return "unverifiable"
    return "restore" if now[resulting][0] == entry["digest"] else "content changed"


def undo_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Moves of a session bound to a customer's orders, and what is there now: every obstacle occurs."""
    o = B.table(spark, sf_dir, "orders").where("o_custkey % 5 = 0")
    k = F.col("o_orderkey").cast("string")
    trash, digest = F.concat(F.lit("/t/"), k), F.concat(F.lit("d"), k)
    rename = F.col("o_orderkey") % 4 == 1
    folder = F.concat(F.lit("/c"), (F.col("o_custkey") % 50).cast("string"))
    # a renamed file took the name of one that went to the trash
    original = F.when(rename, F.concat(folder, F.lit("/n"), k)).otherwise(F.concat(folder, F.lit("/f"), k))
    moved = F.when(rename, F.concat(folder, F.lit("/f"), (F.col("o_orderkey") + 1).cast("string"))).otherwise(trash)
    e = o.select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("seq"), F.when(rename, "rename").otherwise("trash").alias("mechanism"), original.alias("original"), moved.alias("resulting"), digest.alias("digest"), (F.col("o_orderkey") % 10 == 0).alias("restored"))
    m = F.col("seq")
    here = e.where(m % 7 != 0).select(F.col("resulting").alias("path"), F.when(m % 11 == 0, "other").when(m % 13 == 0, F.lit(None)).otherwise(F.col("digest")).alias("digest"), F.lit(False).alias("is_directory"))
    taken = e.where((m % 17 == 0) | (m % 19 == 0) | (m % 20 == 0)).select(F.col("original").alias("path"), F.when(m % 17 == 0, "other").otherwise(F.col("digest")).alias("digest"), (m % 19 == 0).alias("is_directory"))
    folders = e.select(F.regexp_extract("original", "^(.*)/[^/]*$", 1).alias("path")).distinct().where("path not like '%9'").select("path", F.lit(None).cast("string").alias("digest"), F.lit(True).alias("is_directory"))
    every = here.union(taken).union(folders)
    return e, every.groupBy("path").agg(F.min(F.struct("digest", "is_directory")).alias("x")).select("path", "x.*")


@q("undo_plan")
def _(s, d):
    return plan_undo(*undo_inputs(s, d))


def scans(spark, sf_dir) -> DataFrame:
    """Saved scans bound to the orders: one per customer."""
    o = B.table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("scan")).agg(F.count(F.lit(1)).alias("groups"), F.sum(F.floor("o_totalprice").cast("bigint")).alias("reclaimable"), F.bool_and(F.col("o_orderstatus") == "F").alias("is_exact"), F.max("o_orderdate").alias("created")).withColumn("root", F.concat(F.lit("/Vólumes/"), (F.col("scan") % 9).cast("string")))


SCANS = """scans AS (SELECT o_custkey AS scan, count(*) AS groups, sum(floor(o_totalprice)::BIGINT)::BIGINT AS reclaimable, bool_and(o_orderstatus = 'F') AS is_exact, max(o_orderdate) AS created,
 '/Vólumes/' || (o_custkey % 9) AS root FROM orders GROUP BY o_custkey)"""


@q("library_sorted")
def _(s, d):
    """The whole list in each of its four orders; scans of equal rank in the order of their identifiers, newest first."""
    f = scans(s, d)
    orders = {"newest": F.desc("created"), "oldest": F.asc("created"), "groups": F.desc("groups"), "reclaimable": F.desc("reclaimable")}
    each = [ranked(f, by, F.desc("scan")).select(F.lit(name).alias("order"), "rank", "scan", "groups", "reclaimable") for name, by in orders.items()]
    return reduce(DataFrame.union, each)


ORACLE_SQL["library_sorted"] = f"WITH {SCANS} " + " UNION ALL ".join(f"SELECT '{n}' AS \"order\", row_number() OVER (ORDER BY {b}, scan DESC) AS rank, scan, groups, reclaimable FROM scans" for n, b in (("newest", "created DESC"), ("oldest", "created ASC"), ("groups", "groups DESC"), ("reclaimable", "reclaimable DESC")))


@q("library_filter")
def _(s, d):
    f = scans(s, d)
    return f.where(F.contains(F.collate("root", "UNICODE_CI_AI"), F.collate(F.lit("volumes/3"), "UNICODE_CI_AI")) | F.contains(F.col("scan").cast("string"), F.lit("77"))).select("scan", "root")


ORACLE_SQL["library_filter"] = f"WITH {SCANS} SELECT scan, root FROM scans WHERE contains(strip_accents(lower(root)), 'volumes/3') OR contains(scan::VARCHAR, '77')"


@q("library_totals")
def _(s, d):
    return scans(s, d).agg(F.count(F.lit(1)).alias("scans"), F.sum("groups").alias("groups"), F.sum("reclaimable").alias("reclaimable"), F.bool_and("is_exact").alias("all_exact"))


ORACLE_SQL["library_totals"] = f"WITH {SCANS} SELECT count(*) AS scans, sum(groups)::BIGINT AS groups, sum(reclaimable)::BIGINT AS reclaimable, bool_and(is_exact) AS all_exact FROM scans"


@q("recent_topk")
def _(s, d):
    e = B.table(s, d, "events").groupBy((F.col("user_id") % 60).alias("root")).agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return e.orderBy(F.desc("m")).limit(10).select("root", F.col("m.event_id").alias("last_used"))


ORACLE_SQL["recent_topk"] = "SELECT root, m.e AS last_used FROM (SELECT user_id % 60 AS root, max({'t': ts, 'e': event_id}) AS m FROM events GROUP BY 1) ORDER BY m DESC LIMIT 10"


@q("events_props_json")
def _(s, d):
    return B.table(s, d, "events").select("event_id", F.from_json("props", "k BIGINT").getField("k").alias("k"))


ORACLE_SQL["events_props_json"] = "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events"


@q("keyed_table_audit")
def _(s, d):
    """Keys missing from the second table, keys that only it has, and rows that are identical."""
    a = B.table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("x"))
    b = B.table(s, d, "supplier").select((F.col("s_suppkey") * 3).alias("key"), F.col("s_nationkey").alias("y"))
    kind = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "orphaned").when(F.col("x") == F.col("y"), "identical").otherwise("different")
    return a.join(b, "key", "full_outer").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("keys"))


ORACLE_SQL["keyed_table_audit"] = """SELECT CASE WHEN s_nationkey IS NULL THEN 'missing' WHEN c_nationkey IS NULL THEN 'orphaned' WHEN c_nationkey = s_nationkey THEN 'identical' ELSE 'different' END AS kind, count(*) AS keys
FROM customer FULL OUTER JOIN (SELECT s_suppkey * 3 AS k, s_nationkey FROM supplier) ON c_custkey = k GROUP BY 1"""


@q("byte_size_parse")
def _(s, d):
    p = B.table(s, d, "part")
    unit = F.element_at(F.array(*[F.lit(x) for x in ("", "b", " KB", "mb", "GB", "tb")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    text = F.concat(F.col("p_size").cast("string"), unit)
    return p.select("p_partkey", values.bytes_parsed(text).alias("bytes"))


ORACLE_SQL["byte_size_parse"] = "SELECT p_partkey, p_size::BIGINT * ([1, 1, 1024, 1048576, 1073741824, NULL]::BIGINT[])[p_partkey % 6 + 1] AS bytes FROM part"


@q("byte_size_format")
def _(s, d):
    p = B.table(s, d, "part")
    size = F.col("p_size").cast("bigint") * F.pow(F.lit(17), F.col("p_partkey") % 7).cast("bigint") - 3
    return p.select("p_partkey", values.bytes_shown(size).alias("shown"))


ORACLE_SQL["byte_size_format"] = """WITH x AS (SELECT p_partkey, greatest(p_size::BIGINT * pow(17, p_partkey % 7)::BIGINT - 3, 0) AS n FROM part),
t AS (SELECT *, CASE WHEN n >= 1073741824 THEN 1073741824 WHEN n >= 1048576 THEN 1048576 WHEN n >= 1024 THEN 1024 END AS u FROM x), k AS (SELECT *, floor(n / u * 10 + 0.5)::BIGINT AS t FROM t)
SELECT p_partkey, CASE WHEN u IS NULL THEN n || ' B' ELSE (t // 10) || '.' || (t % 10) || CASE u WHEN 1024 THEN ' KB' WHEN 1048576 THEN ' MB' ELSE ' GB' END END AS shown FROM k"""


@q("byte_order_probe")
def _(s, d):
    n = B.table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat("n_name", F.element_at(F.array(*[F.lit(x) for x in ("é", "é", "😀", "￮", "z")]), (F.col("n_nationkey") % 5 + 1).cast("int"))).alias("p"))
    a, b = n.select(F.col("k").alias("a"), F.col("p").alias("pa")), n.select(F.col("k").alias("b"), F.col("p").alias("pb"))
    return a.crossJoin(b).select("a", "b", (F.col("pa") < F.col("pb")).alias("less"), (F.col("pa") == F.col("pb")).alias("equal"))


ORACLE_SQL["byte_order_probe"] = """WITH n AS (SELECT n_nationkey AS k, n_name || (['é', 'e' || chr(769), '😀', chr(65518), 'z'])[n_nationkey % 5 + 1] AS p FROM nation) SELECT x.k AS a, y.k AS b, x.p < y.p AS less, x.p = y.p AS equal FROM n x, n y"""


@q("path_functions")
def _(s, d):
    p = B.table(s, d, "pages").select("page_id", F.concat(F.lit("//a/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, F.lit("/x//y/f.tar.GZ")).otherwise(F.lit("/.hidden")), F.when(F.col("page_id") % 3 == 0, F.lit("/")).otherwise(F.lit(""))).alias("raw"))
    c = F.col("c")
    return p.withColumn("c", paths.canonical(F.col("raw"))).select("page_id", c.alias("canonical"), paths.parent(c).alias("parent"), paths.stem(paths.base_name(c)).alias("stem"), paths.extension(paths.base_name(c)).alias("extension"), paths.relative(c, F.lit("/a")).alias("relative"), paths.elided(c).alias("elided"))


ORACLE_SQL["path_functions"] = """WITH c AS (SELECT page_id, '/a/' || page_id || CASE page_id % 2 WHEN 0 THEN '/x/y/f.tar.GZ' ELSE '/.hidden' END AS c FROM pages)
SELECT page_id, c AS canonical, regexp_replace(c, '/[^/]*$', '') AS parent, CASE page_id % 2 WHEN 0 THEN 'f.tar' ELSE '.hidden' END AS stem, CASE page_id % 2 WHEN 0 THEN 'gz' ELSE '' END AS extension,
substr(c, 4) AS relative, CASE page_id % 2 WHEN 0 THEN '/a/' || page_id || '/…/y/f.tar.GZ' ELSE c END AS elided FROM c"""


@q("identifier_valid")
def _(s, d):
    e = B.table(s, d, "events").select("event_id", values.scan_id(F.col("ts")).alias("i"))
    broken = F.when(F.col("event_id") % 4 == 1, F.substring("i", 1, 21)).when(F.col("event_id") % 4 == 2, F.concat("i", F.lit("\n"))).when(F.col("event_id") % 4 == 3, F.translate("i", "-", "_")).otherwise(F.col("i"))
    return e.select("event_id", values.is_scan_id(broken).alias("valid"))


ORACLE_SQL["identifier_valid"] = "SELECT event_id, event_id % 4 = 0 AS valid FROM events"


@q("scan_ids")
def _(s, d):
    e = B.table(s, d, "events")
    return e.select("event_id", values.scan_id(F.col("ts")).alias("scan_id"), values.iso(F.col("ts")).alias("iso"))


ORACLE_SQL["scan_ids"] = "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S-%f') AS scan_id, CASE WHEN strftime(ts, '%f') = '000000' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso FROM events"


@q("scan_id_instants")
def _(s, d):
    """Identifiers and ISO times read back; every fourth is broken."""
    e = B.table(s, d, "events")
    broken = F.col("event_id") % 4 == 0
    own = F.when(broken, F.concat(values.scan_id(F.col("ts")), F.lit("0"))).otherwise(values.scan_id(F.col("ts")))
    iso = F.concat(values.iso(F.col("ts")), F.when(broken, "").otherwise("Z"))
    return e.select("event_id", F.unix_micros(values.instant_of(own)).alias("micros"), F.unix_seconds(values.whole_second(iso)).alias("seconds"))


ORACLE_SQL["scan_id_instants"] = "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN epoch_us(ts) END AS micros, CASE WHEN event_id % 4 <> 0 THEN epoch_us(ts) // 1000000 END AS seconds FROM events"


@q("thumbnail_pixels")
def _(s, d):
    p = B.table(s, d, "part")
    return p.select("p_partkey", values.thumbnail_pixels(F.col("p_retailprice") / 7, (F.col("p_partkey") % 4).cast("double") / 2).alias("pixels"))


ORACLE_SQL["thumbnail_pixels"] = "SELECT p_partkey, least(512, greatest(32, floor((ceil(p_retailprice / 7 * greatest(1.0, (p_partkey % 4)::DOUBLE / 2)) + 31) / 32) * 32))::INT AS pixels FROM part"


@q("requested_paths")
def _(s, d):
    """Paths below a resolved root as they were asked for, trimmed, with the home folder written out."""
    c = B.table(s, d, "customer").select("c_custkey", F.concat(F.element_at(F.array(F.lit("/private/tmp/"), F.lit("~/"), F.lit("/data/")), (F.col("c_custkey") % 3 + 1).cast("int")), "c_name", F.when(F.col("c_custkey") % 2 == 0, "//").otherwise("")).alias("path"))
    return c.select("c_custkey", paths.tilde(paths.trimmed(paths.requested_prefix(F.col("path"), F.lit("/private/tmp"), F.lit("/tmp"))), F.lit("/home/u")).alias("path"))


ORACLE_SQL["requested_paths"] = "SELECT c_custkey, (['/tmp/', '/home/u/', '/data/'])[c_custkey % 3 + 1] || c_name AS path FROM customer"

