"""Saved documents: scans, decisions, renames, journals.

Analytics read them with fixed schemas.  Where int and float, key order or repeated keys matter,
the strict parser reads one document on the driver.
"""

from __future__ import annotations

import json
import math
import os
import tempfile
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXACT_SCAN = "scan_id STRING, root STRING, created_at STRING, groups ARRAY<STRUCT<size: BIGINT, sha256: STRING, files: ARRAY<STRING>>>"
FOLDER_SCAN = """scan_id STRING, root STRING, created_at STRING, threshold DOUBLE, pairs ARRAY<STRUCT<folder_a: STRING, folder_b: STRING, similarity: DOUBLE, matching: INT,
 only_in_a: ARRAY<STRING>, only_in_b: ARRAY<STRING>, changed: ARRAY<STRING>, total_a: INT, total_b: INT>>"""
SIMILAR_SCAN = """scan_id STRING, root STRING, created_at STRING, img_threshold INT, vid_threshold DOUBLE,
 pairs ARRAY<STRUCT<file_a: STRING, file_b: STRING, similarity: DOUBLE, media_type: STRING>>"""
JOURNAL_LINE = """format_version INT, original_path STRING, resulting_path STRING, mechanism STRING, size BIGINT, sha256 STRING, group_key STRING,
 scan_id STRING, timestamp STRING, undone_at STRING, _corrupt STRING"""
MEDIA_TYPES = ("image", "video")
MECHANISMS = ("trash", "quarantine", "rename")


def read_exact_scans(spark: SparkSession, path: str) -> DataFrame:
    """A row per member of a group; documents that do not parse are left out, as in a listing."""
    return _scans(spark, path, EXACT_SCAN).select("scan_id", "root", "created_at", F.explode("groups").alias("g")).select("scan_id", "root", "created_at", "g.size", "g.sha256", F.explode("g.files").alias("path"))


def read_folder_scans(spark: SparkSession, path: str) -> DataFrame:
    return _scans(spark, path, FOLDER_SCAN).select("scan_id", "root", "created_at", "threshold", F.explode("pairs").alias("p")).select("scan_id", "root", "created_at", "threshold", "p.*")


def read_similar_scans(spark: SparkSession, path: str) -> DataFrame:
    """A row per pair; an unknown media type is an error."""
    out = _scans(spark, path, SIMILAR_SCAN).select("scan_id", "root", "created_at", "img_threshold", "vid_threshold", F.explode("pairs").alias("p")).select("scan_id", "root", "created_at", "img_threshold", "vid_threshold", "p.*")
    known = F.col("media_type").isin(*MEDIA_TYPES)
    return out.withColumn("media_type", F.when(known, F.col("media_type")).otherwise(F.raise_error(F.concat(F.lit("unknown media type "), F.coalesce("media_type", F.lit("null"))))))


def _scans(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema + ", _corrupt STRING").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt IS NULL")


def read_decisions(document: Any) -> list[tuple[str, list[str]]]:
    """(key, kept) of a decisions document, wrapped or bare; values of pair decisions are enum strings."""
    own = document.get("decisions", document) if isinstance(document, dict) else None
    if not isinstance(own, dict):
        raise ValueError("no map of decisions")
    return [(k, [v] if isinstance(v, str) else list(v)) for k, v in own.items()]


def read_renames(document: dict) -> list[str]:
    if document.get("format_version") != 1:
        raise ValueError("unknown format version of renames")
    return list(document["name_from"])


def read_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries that no record of the same file takes back, and malformed lines, with file and line number from 1.

    A line is malformed if it is no JSON, lacks a field of an entry, names another mechanism, has a digest that
    is not 32 bytes in hexadecimal or is of a later format.  A file is one session and is read as a whole.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "value"))
    lines = files.where(F.trim("value") != "").withColumn("line", F.col("at") + 1).withColumn("j", F.from_json("value", JOURNAL_LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    whole = F.col("j").isNotNull() & F.col("j._corrupt").isNull()
    undone = F.coalesce(whole & (F.col("j.undone_at") != "") & F.col("j.original_path").isNotNull(), F.lit(False))
    needed = [F.col(f"j.{c}").isNotNull() for c in ("original_path", "resulting_path", "size", "group_key", "scan_id", "timestamp")]
    sound = F.col("j.mechanism").isin(*MECHANISMS) & F.col("j.sha256").rlike("^[0-9A-Fa-f]{64}$") & (F.coalesce("j.format_version", F.lit(1)) == 1)
    entry = F.coalesce(reduce(Column.__and__, needed, whole & sound), F.lit(False))
    told = lines.withColumns({"__undone": undone, "__entry": entry})
    back = told.where("__undone").select("file", F.col("j.original_path").alias("original_path")).distinct()
    moves = told.where("__entry and not __undone").select("file", "line", "j.*").drop("undone_at", "_corrupt").join(back, ["file", "original_path"], "left_anti")
    return moves, told.where("not __entry and not __undone").select("file", "line", "value")


def groups_as_json(members: DataFrame) -> DataFrame:
    """A JSON document per group, as a scan holds it."""
    return members.groupBy("size", "digest").agg(F.array_sort(F.collect_list("path")).alias("files")).select(F.to_json(F.struct("size", F.col("digest").alias("sha256"), "files")).alias("value"))


def groups_from_json(documents: DataFrame) -> DataFrame:
    own = F.from_json("value", "size BIGINT, sha256 STRING, files ARRAY<STRING>", {"mode": "FAILFAST"})
    return documents.select(own.alias("g")).select("g.size", "g.sha256", F.explode("g.files").alias("path"))


def parse_strict(text: str) -> Any:
    """JSON with int apart from float, keys in order, the first of equal keys; no NaN, no Infinity."""

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is no JSON number")

    def pairs(items: list[tuple[str, Any]]) -> dict:
        out: dict = {}
        for k, v in items:
            out.setdefault(k, v)
        return out

    return json.loads(text, parse_constant=refuse, object_pairs_hook=pairs)


def dump_document(value: Any) -> str:
    """Indented JSON in ASCII with a final line feed; refuses numbers that are not finite."""
    return json.dumps(value, indent=2, allow_nan=False).replace("\x7f", "\\u007f") + "\n"


def save_document(folder: str, name: str, value: Any) -> str:
    """Atomic: a temporary file beside it, then a rename."""
    text = dump_document(value)
    os.makedirs(folder, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(tmp, os.path.join(folder, name))
    return os.path.join(folder, name)


def delete_document(folder: str, name: str) -> bool:
    try:
        os.remove(os.path.join(folder, name))
    except FileNotFoundError:
        return False
    return True


def as_int(value: Any) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError("no integer")
    return value


def as_double(value: Any) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError("no number")
    return float(value)
