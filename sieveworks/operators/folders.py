"""Folder similarity: Dice over relative paths and digests, differences, containment, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import values
from .ordering import ranked

ROOT, THRESHOLD, CLASS_CAP = "/r", 0.9, 512
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def q(name):
    def wrap(f):
        QUERIES[name] = f
        return f

    return wrap


def under_ancestors(tree: DataFrame, root: str = ROOT) -> DataFrame:
    """A row for each directory below the root that holds a file: dir, rel, digest; depth bounds the rows per file."""
    parts = F.split(F.substr("path", F.lit(len(root) + 2)), "/")
    n = F.size("parts")
    out = tree.withColumn("parts", parts).withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))))).where(n > 1)
    head = F.concat(F.lit(root + "/"), F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/"))
    return out.select(head.alias("dir"), F.array_join(F.slice("parts", F.col("k") + 1, n), "/").alias("rel"), "digest")


def sizes(tree: DataFrame, root: str = ROOT) -> DataFrame:
    return under_ancestors(tree, root).groupBy("dir").agg(F.count(F.lit(1)).alias("files"))


def truncated_classes(tree: DataFrame, cap: int = CLASS_CAP) -> DataFrame:
    """Classes of digest and name with more members than the cap: they propose no candidates and are reported."""
    return tree.groupBy("digest", F.regexp_extract("path", "([^/]*)$", 1).alias("name")).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > cap)


def candidates(tree: DataFrame, root: str = ROOT, cap: int = CLASS_CAP) -> DataFrame:
    """Pairs of folders that share a file at the same relative path, and how many; the cap bounds pairs per class."""
    big = truncated_classes(tree, cap).select("digest", "name")
    ups = under_ancestors(tree, root).withColumn("name", F.regexp_extract("rel", "([^/]*)$", 1)).join(big, ["digest", "name"], "left_anti")
    a, b = ups.select(F.col("dir").alias("a"), "rel", "digest"), ups.select(F.col("dir").alias("b"), "rel", "digest")
    return a.join(b, ["rel", "digest"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("matching"))


def nested(a: str = "a", b: str = "b"):
    return F.startswith(b, F.concat(F.col(a), F.lit("/"))) | F.startswith(a, F.concat(F.col(b), F.lit("/")))


def pairs(tree: DataFrame, threshold: float = THRESHOLD, root: str = ROOT, cap: int = CLASS_CAP) -> DataFrame:
    """Folder pairs with Dice similarity of threshold or more; candidates are compared in full."""
    n = sizes(tree, root)
    of = lambda s: n.select(F.col("dir").alias(s), F.col("files").alias(f"total_{s}"))
    near = candidates(tree, root, cap).where(~nested()).select("a", "b").join(of("a"), "a").join(of("b"), "b").where(values.dice_possible(F.col("total_a"), F.col("total_b"), threshold))
    ups = under_ancestors(tree, root)
    left, right = ups.select(F.col("dir").alias("a"), "rel", "digest"), ups.select(F.col("dir").alias("b"), "rel", "digest")
    same = near.join(left, "a").join(right, ["b", "rel", "digest"]).groupBy("a", "b", "total_a", "total_b").agg(F.count(F.lit(1)).alias("matching"))
    return same.withColumn("similarity", 2 * F.col("matching") / (F.col("total_a") + F.col("total_b"))).where(F.col("similarity") >= threshold)


def diff(tree: DataFrame, pair_list: DataFrame, root: str = ROOT) -> DataFrame:
    """For every pair and relative path whether it is matching, changed, or in one folder only."""
    ups = under_ancestors(tree, root)
    left = pair_list.select("a", "b").join(ups.select(F.col("dir").alias("a"), "rel", F.col("digest").alias("da")), "a")
    right = pair_list.select("a", "b").join(ups.select(F.col("dir").alias("b"), "rel", F.col("digest").alias("db")), "b")
    kind = F.when(F.col("db").isNull(), "only_a").when(F.col("da").isNull(), "only_b").when(F.col("da") == F.col("db"), "matching").otherwise("changed")
    return left.join(right, ["a", "b", "rel"], "full_outer").select("a", "b", "rel", kind.alias("kind"))


_UPS = B.TREE + """, sp AS (SELECT *, string_split(path[4:], '/') AS parts FROM tree), ks AS (SELECT *, unnest(range(1, len(parts))) AS k FROM sp),
ups AS (SELECT '/r/' || array_to_string(parts[1:k], '/') AS dir, array_to_string(parts[k + 1:], '/') AS rel, digest FROM ks),
sz AS (SELECT dir, count(*) AS files FROM ups GROUP BY dir)"""
_PAIRS = _UPS + f""", pr AS (SELECT x.dir AS a, y.dir AS b, count(*) AS matching FROM ups x JOIN ups y USING (rel, digest) WHERE x.dir < y.dir GROUP BY ALL),
fp AS (SELECT a, b, matching, sa.files AS total_a, sb.files AS total_b, 2 * matching / (sa.files + sb.files) AS similarity FROM pr JOIN sz sa ON sa.dir = a JOIN sz sb ON sb.dir = b
 WHERE NOT starts_with(b, a || '/') AND NOT starts_with(a, b || '/') AND 2 * matching / (sa.files + sb.files) >= {THRESHOLD})"""
_DIFF = _PAIRS + """, l AS (SELECT a, b, rel, digest AS da FROM fp JOIN ups ON dir = a), r AS (SELECT a, b, rel, digest AS db FROM fp JOIN ups ON dir = b),
df AS (SELECT a, b, rel, CASE WHEN db IS NULL THEN 'only_a' WHEN da IS NULL THEN 'only_b' WHEN da = db THEN 'matching' ELSE 'changed' END AS kind FROM l FULL OUTER JOIN r USING (a, b, rel))"""


@q("folder_sizes")
def _(s, d):
    return sizes(B.tree(s, d))


ORACLE_SQL["folder_sizes"] = f"WITH {_UPS} SELECT * FROM sz"


@q("folder_candidates")
def _(s, d):
    return candidates(B.tree(s, d))


ORACLE_SQL["folder_candidates"] = f"WITH {_PAIRS} SELECT * FROM pr"


@q("folder_truncated_classes")
def _(s, d):
    return truncated_classes(B.tree(s, d).withColumn("path", F.regexp_replace("path", "[0-9]+.txt$", "x.txt")), 2)


ORACLE_SQL["folder_truncated_classes"] = f"WITH {B.TREE} SELECT digest, 'x.txt' AS name, count(*) AS members FROM tree GROUP BY digest HAVING count(*) > 2"


@q("dice_bound")
def _(s, d):
    n = B.table(s, d, "nation").select(F.col("n_nationkey").alias("a"))
    return n.crossJoin(n.select(F.col("a").alias("b"))).select("a", "b", values.dice_possible(F.col("a"), F.col("b"), 0.8).alias("possible"))


ORACLE_SQL["dice_bound"] = "SELECT x.n_nationkey AS a, y.n_nationkey AS b, least(x.n_nationkey, y.n_nationkey) > 0 AND greatest(x.n_nationkey, y.n_nationkey) * 0.8::DOUBLE <= least(x.n_nationkey, y.n_nationkey) * 1.2::DOUBLE AS possible FROM nation x, nation y"


@q("folder_pairs")
def _(s, d):
    return pairs(B.tree(s, d))


ORACLE_SQL["folder_pairs"] = f"WITH {_PAIRS} SELECT * FROM fp"


@q("folder_pairs_ordered")
def _(s, d):
    """Pairs, the most alike first, then by their folders."""
    return ranked(pairs(B.tree(s, d)).select("a", "b", "similarity"), F.desc("similarity"), F.asc("a"), F.asc("b"))


ORACLE_SQL["folder_pairs_ordered"] = f"WITH {_PAIRS} SELECT a, b, similarity, row_number() OVER (ORDER BY similarity DESC, a, b) AS rank FROM fp"


@q("folder_diff")
def _(s, d):
    t = B.tree(s, d)
    return diff(t, pairs(t))


ORACLE_SQL["folder_diff"] = f"WITH {_DIFF} SELECT * FROM df"


@q("folder_containment")
def _(s, d):
    """Files that would be lost if the second folder of a pair left: how many, and the first five."""
    t = B.tree(s, d)
    lost = diff(t, pairs(t)).where(F.col("kind").isin("changed", "only_b"))
    return lost.groupBy("a", "b").agg(F.count(F.lit(1)).alias("missing"), F.array_join(F.slice(F.array_sort(F.collect_list("rel")), 1, 5), "|").alias("examples"))


ORACLE_SQL["folder_containment"] = f"WITH {_DIFF} SELECT a, b, count(*) AS missing, array_to_string((list(rel ORDER BY rel))[1:5], '|') AS examples FROM df WHERE kind IN ('changed', 'only_b') GROUP BY a, b"


@q("folder_manifest_digest")
def _(s, d):
    rows = under_ancestors(B.tree(s, d)).groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("rel", "digest"))).alias("m"))
    lines = F.array_join(F.transform("m", lambda x: F.concat(x["rel"], F.lit("\0"), x["digest"], F.lit("\n"))), "")
    return rows.select("dir", F.sha2(lines, 256).alias("manifest"))


ORACLE_SQL["folder_manifest_digest"] = f"WITH {_UPS} SELECT dir, sha256(string_agg(rel || chr(0) || digest || chr(10), '' ORDER BY rel)) AS manifest FROM ups GROUP BY dir"


@q("folder_plan")
def _(s, d):
    """Second folders of decided pairs leave, unless they are kept, hold a kept folder, or lie in one that leaves."""
    p = pairs(B.tree(s, d)).where(F.octet_length("a") % 2 == 0)
    out, kept = p.groupBy(F.col("b").alias("folder")).agg(F.min("a").alias("counterpart")), p.select(F.col("a").alias("k")).distinct()
    out = out.join(kept, (F.col("k") == F.col("folder")) | F.startswith("k", F.concat("folder", F.lit("/"))), "left_anti")
    above = out.select(F.col("folder").alias("top"))
    return out.join(above, F.startswith("folder", F.concat("top", F.lit("/"))), "left_anti")


ORACLE_SQL["folder_plan"] = f"""WITH {_PAIRS}, p AS (SELECT * FROM fp WHERE strlen(a) % 2 = 0), o AS (SELECT b AS folder, min(a) AS counterpart FROM p GROUP BY b),
k AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.a = o.folder OR starts_with(p.a, o.folder || '/')))
SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k t WHERE starts_with(k.folder, t.folder || '/'))"""
