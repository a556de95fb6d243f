"""Exact duplicates: size buckets, probe narrowing, groups, storage classes, keepers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import paths, values
from .ordering import ranked

ROOT = "/corpus"
#: The probe threshold is a parameter; the tables hold small files.
PROBE_ABOVE, PROBE_WINDOW = 1024, 256


def size_buckets(files: DataFrame, least: int = 1) -> DataFrame:
    """Files that share their size with another; the size is combined before it is shuffled."""
    shared = files.where(F.col("size") >= least).groupBy("size").agg(F.count(F.lit(1)).alias("bucket")).where("bucket > 1")
    return files.join(shared, "size")


def probed(files: DataFrame, above: int = PROBE_ABOVE, window: int = PROBE_WINDOW) -> DataFrame:
    """Candidates that are left after probing larger ones; a file whose probe failed (null content) stays."""
    out = size_buckets(files).withColumn("probe", F.when(F.col("size") > above, values.probe_digest(F.encode("text", "UTF-8"), window)))
    n = out.where(F.col("probe").isNotNull()).groupBy("size", "probe").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    joined = out.join(n, ["size", "probe"], "left")
    return joined.where(F.col("probe").isNull() | F.col("__n").isNotNull()).drop("__n")


def group_stats(files: DataFrame) -> DataFrame:
    """One row per group of equal size and digest with two members or more."""
    return files.where(F.col("digest").isNotNull()).groupBy("size", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"), F.max("path").alias("last"), F.min("doc_id").alias("lo")).where("n > 1")


def group_members(files: DataFrame) -> DataFrame:
    return files.join(group_stats(files), ["size", "digest"]).withColumn("group_key", values.group_key(F.col("size"), F.col("digest")))


def storage_class(content_id: str = "content_id", inode: str = "inode", path: str = "path"):
    return F.when(F.col(content_id).isNotNull(), F.concat(F.lit("c:"), content_id)).when(F.col(inode).isNotNull(), F.concat(F.lit("i:"), F.col(inode).cast("string"))).otherwise(F.concat(F.lit("p:"), path))


def classes(stored: DataFrame) -> DataFrame:
    """Storage classes of every group: members that share storage are one class."""
    return group_members(stored).withColumn("class", storage_class()).groupBy("group_key", "size", "class").agg(F.count(F.lit(1)).alias("members"), F.min("path").alias("lowest"), F.bool_and(F.col("content_id").isNotNull()).alias("exact"))


def reclaimable(stored: DataFrame) -> DataFrame:
    return classes(stored).groupBy("group_key", "size").agg(F.count(F.lit(1)).alias("classes"), F.sum("members").alias("files"), F.bool_and("exact").alias("is_exact")).withColumns(
        {"reclaimable": F.col("size") * (F.col("classes") - 1), "upper_bound": F.col("size") * (F.col("files") - 1)}
    )


def keepers(files: DataFrame, root: str = ROOT) -> DataFrame:
    """Per group the member to keep: no copy name first, then the deeper one, then byte order."""
    rank = F.struct(paths.is_copy_name(F.col("path")).cast("int").alias("copy"), (-paths.depth_under(F.col("path"), F.lit(root))).alias("up"), F.col("path").alias("p"))
    return group_members(files).groupBy("group_key").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("files")).select("group_key", F.col("best.p").alias("keeper"), "files")


def decided(files: DataFrame) -> DataFrame:
    """Review state of each group, bound to the tables: undecided, skipped, keep the first, or discard all."""
    state = F.when(F.col("lo") % 4 == 0, "undecided").when(F.col("lo") % 4 == 1, "skipped").when(F.col("lo") % 4 == 2, "keep").otherwise("discard")
    return group_stats(files).withColumn("group_key", values.group_key(F.col("size"), F.col("digest"))).withColumn("state", state).withColumn("kept", F.when(F.col("state") == "keep", F.col("first")))


def presence(files: DataFrame) -> DataFrame:
    """What a later look at each member found."""
    return group_members(files).withColumn("found", F.when(F.col("doc_id") % 11 == 0, "missing").when(F.col("doc_id") % 13 == 0, "sizeChanged").otherwise("present"))


def removals(stored: DataFrame) -> DataFrame:
    """Of decided groups the first path of every storage class that holds no kept path; all files of discarded ones."""
    d = decided(stored).select("group_key", "state", "kept")
    m = group_members(stored).withColumn("class", storage_class()).join(d, "group_key")
    keep = m.where("state = 'keep'").groupBy("group_key", "size", "class").agg(F.min("path").alias("path"), F.bool_or(F.col("path") == F.col("kept")).alias("holds")).where("not holds")
    return keep.select("group_key", "size", "class", "path").union(m.where("state = 'discard'").select("group_key", "size", "class", "path"))


def q(name):
    def wrap(f):
        QUERIES[name] = f
        return f

    return wrap


QUERIES: dict = {}
ORACLE_SQL: dict = {}

_GROUPS = """g AS (SELECT size, digest, count(*) AS n, min(path) AS first, max(path) AS last, min(doc_id) AS lo, size::VARCHAR || ':' || digest AS group_key
 FROM {0} GROUP BY size, digest HAVING count(*) > 1), m AS (SELECT f.*, g.n, g.first, g.lo, g.group_key FROM {0} f JOIN g USING (size, digest))"""
_CLASS = "CASE WHEN content_id IS NOT NULL THEN 'c:' || content_id WHEN inode IS NOT NULL THEN 'i:' || inode::VARCHAR ELSE 'p:' || path END"
_STATE = "CASE lo % 4 WHEN 0 THEN 'undecided' WHEN 1 THEN 'skipped' WHEN 2 THEN 'keep' ELSE 'discard' END"


@q("size_candidates")
def _(s: SparkSession, d: str) -> DataFrame:
    return size_buckets(B.files(s, d), 100).groupBy("size").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first"))


ORACLE_SQL["size_candidates"] = f"WITH {B.FILES} SELECT size, count(*) AS files, min(path) AS first FROM files WHERE size >= 100 GROUP BY size HAVING count(*) > 1"


@q("prefix_narrow")
def _(s, d):
    return probed(B.files(s, d, content=True)).select("path", "size", "probe")


ORACLE_SQL["prefix_narrow"] = f"""WITH {B.FILES}, c AS (SELECT *, count(*) OVER (PARTITION BY size) AS b FROM files),
p AS (SELECT path, size, CASE WHEN size > {PROBE_ABOVE} THEN sha256(unhex(lpad(hex(size), 16, '0')) || encode(text)[1:{PROBE_WINDOW}] || encode(text)[size - {PROBE_WINDOW} + 1:size]) END AS probe FROM c WHERE b > 1)
SELECT path, size, probe FROM p QUALIFY probe IS NULL OR count(*) OVER (PARTITION BY size, probe) > 1"""


@q("exact_groups")
def exact_groups(s, d):
    return group_members(B.files(s, d)).select("group_key", "size", "digest", F.col("n").alias("files"), "path")


ORACLE_SQL["exact_groups"] = f"WITH {B.FILES}, {_GROUPS.format('files')} SELECT group_key, size, digest, n AS files, path FROM m"


@q("exact_groups_ordered")
def _(s, d):
    """Members of groups, the largest size first, then by digest and path."""
    return ranked(group_members(B.files(s, d)).select("size", "digest", "path"), F.desc("size"), F.asc("digest"), F.asc("path"))


ORACLE_SQL["exact_groups_ordered"] = f"WITH {B.FILES}, {_GROUPS.format('files')} SELECT size, digest, path, row_number() OVER (ORDER BY size DESC, digest, path) AS rank FROM m"


@q("scan_relative_paths")
def _(s, d):
    """Whether a scan's root or any path of its groups is relative; roots of every third source are written without the slash."""
    m = group_members(B.files(s, d)).select(F.element_at(F.split("path", "/"), 3).alias("scan"), "path")
    own = m.withColumn("path", F.when(F.pmod(F.octet_length("scan"), F.lit(5)) == 0, F.substr("path", F.lit(2))).otherwise(F.col("path")))
    return own.groupBy("scan").agg(F.bool_or(paths.is_relative(F.col("path"))).alias("relative"))


ORACLE_SQL["scan_relative_paths"] = f"WITH {B.FILES}, {_GROUPS.format('files')} SELECT split_part(path, '/', 3) AS scan, bool_or(strlen(split_part(path, '/', 3)) % 5 = 0) AS relative FROM m GROUP BY 1"


@q("digest_codec")
def _(s, d):
    f = B.files(s, d)
    return f.select("path", F.lower(F.hex(F.unhex(F.upper("digest")))).alias("digest"), F.octet_length(F.unhex("digest")).cast("bigint").alias("bytes"))


ORACLE_SQL["digest_codec"] = f"WITH {B.FILES} SELECT path, lower(hex(unhex(upper(digest)))) AS digest, octet_length(unhex(digest))::BIGINT AS bytes FROM files"


@q("storage_classes")
def _(s, d):
    return classes(B.storage(s, d))


_CLASSES = f"c AS (SELECT group_key, size, {_CLASS} AS class, count(*) AS members, min(path) AS lowest, bool_and(content_id IS NOT NULL) AS exact FROM m GROUP BY ALL)"
ORACLE_SQL["storage_classes"] = f"WITH {B.STORAGE}, {_GROUPS.format('storage')}, {_CLASSES} SELECT * FROM c"


@q("reclaimable_bytes")
def _(s, d):
    return reclaimable(B.storage(s, d))


_RECLAIM = """r AS (SELECT group_key, size, count(*) AS classes, sum(members)::BIGINT AS files, bool_and(exact) AS is_exact,
 size * (count(*) - 1) AS reclaimable, size * (sum(members)::BIGINT - 1) AS upper_bound FROM c GROUP BY group_key, size)"""
ORACLE_SQL["reclaimable_bytes"] = f"WITH {B.STORAGE}, {_GROUPS.format('storage')}, {_CLASSES}, {_RECLAIM} SELECT * FROM r"


@q("scan_summary")
def _(s, d):
    r = reclaimable(B.storage(s, d))
    return r.agg(F.count(F.lit(1)).alias("groups"), F.sum("files").alias("files"), F.sum("reclaimable").alias("reclaimable"), F.sum("upper_bound").alias("upper_bound"), F.bool_and("is_exact").alias("all_exact"), F.count_if(F.col("classes") < F.col("files")).alias("sharing"))


ORACLE_SQL["scan_summary"] = f"""WITH {B.STORAGE}, {_GROUPS.format('storage')}, {_CLASSES}, {_RECLAIM}
SELECT count(*) AS groups, sum(files)::BIGINT AS files, sum(reclaimable)::BIGINT AS reclaimable, sum(upper_bound)::BIGINT AS upper_bound, bool_and(is_exact) AS all_exact, count_if(classes < files)::BIGINT AS sharing FROM r"""


@q("keeper_choice")
def _(s, d):
    return keepers(B.files(s, d))


ORACLE_SQL["keeper_choice"] = f"""WITH {B.FILES}, {_GROUPS.format('files')},
k AS (SELECT group_key, path, n, row_number() OVER (PARTITION BY group_key ORDER BY regexp_matches(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1'), '{paths.COPY_NAME}')::INT,
 -len(list_filter(string_split(path[9:], '/'), lambda x: x <> '')), path) AS r FROM m) SELECT group_key, path AS keeper, n AS files FROM k WHERE r = 1"""


@q("copy_name_score")
def _(s, d):
    c = B.table(s, d, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, F.lit(" (2)")).when(F.col("p_partkey") % 5 == 1, F.lit(" - copy")).when(F.col("p_partkey") % 5 == 2, F.lit("_copia")).when(F.col("p_partkey") % 5 == 3, F.lit("x")).otherwise(F.lit("-7")), F.lit(".txt")).alias("name"))
    return c.select("p_partkey", "name", paths.is_copy_name(F.col("name")).cast("int").alias("score"))


ORACLE_SQL["copy_name_score"] = f"""WITH c AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' (2)' WHEN 1 THEN ' - copy' WHEN 2 THEN '_copia' WHEN 3 THEN 'x' ELSE '-7' END || '.txt' AS name FROM part)
SELECT p_partkey, name, regexp_matches(regexp_replace(name, '^(.+)\\.[^.]*$', '\\1'), '{paths.COPY_NAME}')::INT AS score FROM c"""


@q("group_common_parent")
def _(s, d):
    return group_stats(B.files(s, d)).select(values.group_key(F.col("size"), F.col("digest")).alias("group_key"), paths.common_parent(F.col("first"), F.col("last")).alias("parent"))


ORACLE_SQL["group_common_parent"] = f"""WITH {B.FILES}, {_GROUPS.format('files')}, p AS (SELECT group_key, string_split(first, '/') AS a, string_split(last, '/') AS b FROM g)
SELECT group_key, CASE WHEN a[3] <> b[3] THEN '/corpus' WHEN a[4] <> b[4] THEN '/corpus/' || a[3] ELSE '/corpus/' || a[3] || '/' || a[4] END AS parent FROM p"""


@q("removal_candidates")
def _(s, d):
    return removals(B.storage(s, d))


_REMOVALS = f"""d AS (SELECT *, {_CLASS} AS class, {_STATE} AS state FROM m),
x AS (SELECT group_key, size, class, min(path) AS path FROM d WHERE state = 'keep' GROUP BY ALL HAVING NOT bool_or(path = first)
 UNION ALL SELECT group_key, size, class, path FROM d WHERE state = 'discard')"""
ORACLE_SQL["removal_candidates"] = f"WITH {B.STORAGE}, {_GROUPS.format('storage')}, {_REMOVALS} SELECT * FROM x"


@q("exact_plan")
def _(s, d):
    r = removals(B.storage(s, d))
    return r.groupBy("group_key", "size").agg(F.count(F.lit(1)).alias("removals"), F.count_distinct("class").alias("classes")).withColumn("planned_bytes", F.col("size") * F.col("classes"))


ORACLE_SQL["exact_plan"] = f"""WITH {B.STORAGE}, {_GROUPS.format('storage')}, {_REMOVALS}
SELECT group_key, size, count(*) AS removals, count(DISTINCT class) AS classes, size * count(DISTINCT class) AS planned_bytes FROM x GROUP BY group_key, size"""


@q("group_presentation")
def _(s, d):
    st = B.storage(s, d)
    m = group_members(st).withColumn("class", storage_class())
    kept = m.where(F.col("path") == F.col("first")).select("group_key", F.col("class").alias("kept_class"))
    out = m.join(kept, "group_key")
    shares = F.col("class") == F.col("kept_class")
    return out.select("group_key", "path", (F.col("path") == F.col("first")).alias("kept"), (shares & (F.col("path") != F.col("first"))).alias("shares_storage"), (~shares).alias("removable"), paths.is_copy_name(F.col("path")).alias("looks_like_copy"))


ORACLE_SQL["group_presentation"] = f"""WITH {B.STORAGE}, {_GROUPS.format('storage')}, d AS (SELECT *, {_CLASS} AS class FROM m), k AS (SELECT group_key, class AS kept_class FROM d WHERE path = first)
SELECT group_key, path, path = first AS kept, class = kept_class AND path <> first AS shares_storage, class <> kept_class AS removable,
regexp_matches(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1'), '{paths.COPY_NAME}') AS looks_like_copy FROM d JOIN k USING (group_key)"""


@q("group_filter")
def _(s, d):
    f = B.files(s, d)
    still = presence(f).where(F.col("doc_id") % 2 == 0).groupBy("group_key").agg((F.count_if(F.col("found") == "present") >= 2).alias("still"))
    return decided(f).join(still, "group_key", "left").where((F.col("size") >= 200) & (F.col("state") == "undecided") & F.coalesce("still", F.lit(True))).select("group_key", "size", "n")


_FOUND = "CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'sizeChanged' ELSE 'present' END"
ORACLE_SQL["group_filter"] = f"""WITH {B.FILES}, {_GROUPS.format('files')}, s AS (SELECT group_key, count_if({_FOUND} = 'present') >= 2 AS still FROM m WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT group_key, size, n FROM g LEFT JOIN s USING (group_key) WHERE size >= 200 AND {_STATE} = 'undecided' AND coalesce(still, true)"""


@q("review_tally")
def _(s, d):
    return decided(B.files(s, d)).agg(*[F.count_if(c).alias(n) for n, c in (("decided", F.col("state").isin("keep", "discard")), ("skipped", F.col("state") == "skipped"), ("undecided", F.col("state") == "undecided"))])


ORACLE_SQL["review_tally"] = f"""WITH {B.FILES}, {_GROUPS.format('files')}, t AS (SELECT {_STATE} AS state FROM g)
SELECT count_if(state IN ('keep', 'discard'))::BIGINT AS decided, count_if(state = 'skipped')::BIGINT AS skipped, count_if(state = 'undecided')::BIGINT AS undecided FROM t"""


def saved_decisions(files: DataFrame) -> DataFrame:
    """Saved keys with kept paths, as of a scan with other files too: an empty list discards all."""
    m = group_members(files).where(F.col("lo") % 3 != 2)
    own = m.groupBy("group_key", "lo").agg(F.array_sort(F.collect_list(F.when((F.col("doc_id") % 2 == 0) & (F.col("lo") % 3 == 0), F.col("path")))).alias("kept"))
    return own.select(F.when(F.col("lo") % 6 == 1, F.concat(F.lit("0"), "group_key")).otherwise(F.col("group_key")).alias("group_key"), "kept")


@q("rehydrate_decisions")
def _(s, d):
    f = B.files(s, d)
    now = group_members(f).groupBy("group_key").agg(F.collect_list(F.when(F.col("doc_id") % 4 != 0, F.col("path"))).alias("paths"))
    left = F.array_sort(F.array_intersect("kept", "paths"))
    state = F.when(F.col("kept").isNull(), "undecided").when(F.size("kept") == 0, "discard").when(F.size(left) == 0, "undecided").otherwise("keep")
    return now.join(saved_decisions(f), "group_key", "left").select("group_key", state.alias("state"), F.coalesce(F.array_join(left, "|"), F.lit("")).alias("kept"))


_SAVED = """s AS (SELECT CASE WHEN lo % 6 = 1 THEN '0' ELSE '' END || group_key AS group_key, coalesce(list(path ORDER BY path) FILTER (doc_id % 2 = 0 AND lo % 3 = 0), []) AS kept
 FROM m WHERE lo % 3 <> 2 GROUP BY group_key, lo)"""
ORACLE_SQL["rehydrate_decisions"] = f"""WITH {B.FILES}, {_GROUPS.format('files')}, {_SAVED}, n AS (SELECT group_key, coalesce(list(path) FILTER (doc_id % 4 <> 0), []) AS paths FROM m GROUP BY 1),
j AS (SELECT group_key, kept, list_sort(list_intersect(kept, paths)) AS l FROM n LEFT JOIN s USING (group_key))
SELECT group_key, CASE WHEN kept IS NULL THEN 'undecided' WHEN len(kept) = 0 THEN 'discard' WHEN len(l) = 0 THEN 'undecided' ELSE 'keep' END AS state, coalesce(array_to_string(l, '|'), '') AS kept FROM j"""


#: Groups from which decisions that cover a whole scan are worth a warning.
WARN_FROM = 5


def provenance(matched: DataFrame) -> DataFrame:
    """matched, total with cover (none, partial, all) and warn: loaded decisions cover every group of a scan of some size."""
    none = (F.col("matched") == 0) | (F.col("total") == 0)
    cover = F.when(none, "none").when(F.col("matched") >= F.col("total"), "all").otherwise("partial")
    return matched.select("matched", "total", cover.alias("cover"), ((cover == "all") & (F.col("total") >= WARN_FROM)).alias("warn"))


@q("decisions_provenance")
def _(s, d):
    """All decisions of the scan, and of a second scan that has the decided groups alone."""
    f = B.files(s, d)
    saved, now = saved_decisions(f).select("group_key").withColumn("saved", F.lit(1)), decided(f).select("group_key")
    t = now.join(saved, "group_key", "left")
    count = lambda rows, name: provenance(rows.agg(F.count("saved").alias("matched"), F.count(F.lit(1)).alias("total"))).withColumn("scan", F.lit(name))
    return count(t, "whole").union(count(t.where("saved = 1"), "decided"))


ORACLE_SQL["decisions_provenance"] = f"""WITH {B.FILES}, {_GROUPS.format('files')}, {_SAVED}, t AS (SELECT g.group_key, s.group_key IS NOT NULL AS saved FROM g LEFT JOIN s USING (group_key)),
n AS (SELECT 'whole' AS scan, count_if(saved)::BIGINT AS matched, count(*) AS total FROM t UNION ALL SELECT 'decided', count_if(saved)::BIGINT, count_if(saved)::BIGINT FROM t)
SELECT matched, total, CASE WHEN matched = 0 OR total = 0 THEN 'none' WHEN matched >= total THEN 'all' ELSE 'partial' END AS cover, matched > 0 AND matched >= total AND total >= 5 AS warn, scan FROM n"""


@q("decisions_explode")
def _(s, d):
    return saved_decisions(B.files(s, d)).select("group_key", F.explode_outer("kept").alias("path"))


ORACLE_SQL["decisions_explode"] = f"WITH {B.FILES}, {_GROUPS.format('files')}, {_SAVED} SELECT group_key, unnest(CASE WHEN len(kept) = 0 THEN [NULL] ELSE kept END) AS path FROM s"


@q("presence_summary")
def _(s, d):
    g = presence(B.files(s, d)).groupBy("group_key").agg(*[F.count_if(F.col("found") == k).alias(k) for k in ("present", "missing", "sizeChanged")])
    return g.agg(F.sum("present").alias("present"), F.sum("missing").alias("missing"), F.sum("sizeChanged").alias("changed"), F.count_if(F.col("present") >= 2).alias("still"), F.count_if(F.col("present") == 0).alias("gone"), F.count_if((F.col("present") < 2) & (F.col("present") > 0)).alias("stale"))


ORACLE_SQL["presence_summary"] = f"""WITH {B.FILES}, {_GROUPS.format('files')}, p AS (SELECT group_key, count_if({_FOUND} = 'present') AS present, count_if({_FOUND} = 'missing') AS missing, count_if({_FOUND} = 'sizeChanged') AS changed FROM m GROUP BY 1)
SELECT sum(present)::BIGINT AS present, sum(missing)::BIGINT AS missing, sum(changed)::BIGINT AS changed, count_if(present >= 2)::BIGINT AS still, count_if(present = 0)::BIGINT AS gone, count_if(present < 2 AND present > 0)::BIGINT AS stale FROM p"""


@q("scan_roundtrip_groups")
def _(s, d):
    """Groups written as scan documents and read back with their schema."""
    from ..sources.documents import groups_as_json, groups_from_json

    return groups_from_json(groups_as_json(group_members(B.files(s, d)))).select("size", "sha256", "path")


ORACLE_SQL["scan_roundtrip_groups"] = f"WITH {B.FILES}, {_GROUPS.format('files')} SELECT size, digest AS sha256, path FROM m"
