"""Path and name expressions.  Paths compare as UTF-8 bytes, Spark's default; nothing is normalised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks the stem of a copied file, in English and Spanish.
COPY_NAME = (
    r"(?i)(?:^copia\s+de\s+|^copy\s+of\s+)"
    r"|(?:[\x20_-]?(?:\(\d+\)|\(?copy\)?|-\s*copy|\s+copy|_copy|\s+copia|_copia|[\x20_-]\d+)$)"
)
#: Extensions that are images and videos.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "heic", "heif", "webp")
VIDEO_EXTENSIONS = ("mp4", "mov", "m4v", "avi", "mkv", "webm", "mpg", "mpeg")


def canonical(path: Column) -> Column:
    """Without repeated or trailing slashes; the root stays."""
    one = F.regexp_replace(path, "/+", "/")
    return F.when(one == "/", one).otherwise(F.regexp_replace(one, "/$", ""))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def parent(path: Column) -> Column:
    """Up to the last slash; empty if there is none."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def relative(path: Column, root: Column) -> Column:
    """Below root without it, else unchanged; a root ends at a component."""
    head = F.concat(root, F.lit("/"))
    return F.when(F.startswith(path, head), F.substr(path, F.length(head) + 1)).otherwise(path)


def depth_under(path: Column, root: Column) -> Column:
    """Components below root, 0 outside it."""
    parts = F.size(F.filter(F.split(relative(path, root), "/"), lambda x: x != ""))
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), parts).otherwise(0)


def stem(name: Column) -> Column:
    """Without the last extension; a leading dot begins none."""
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def is_copy_name(path: Column) -> Column:
    return stem(base_name(path)).rlike(COPY_NAME)


def elided(path: Column) -> Column:
    """The first two and the last two components around an ellipsis, where there are more."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    both = F.concat(F.slice(parts, 1, 2), F.array(F.lit("…")), F.slice(parts, -2, 2))
    return F.when(F.size(parts) > 4, F.concat(F.lit("/"), F.array_join(both, "/"))).otherwise(path)


def common_parent(least: Column, greatest: Column) -> Column:
    """Shared leading components of a set's least and greatest path, which all of the set share; null if none."""
    a, b = F.split(parent(least), "/"), F.split(parent(greatest), "/")
    n = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda k, i: F.when((k == i) & (F.get(a, i) == F.get(b, i)), k + 1).otherwise(k))
    out = F.array_join(F.slice(a, 1, same), "/")
    return F.when(out != "", out)


def media_kind(path: Column) -> Column:
    own = extension(base_name(path))
    return F.when(own.isin(*IMAGE_EXTENSIONS), "image").when(own.isin(*VIDEO_EXTENSIONS), "video").otherwise("other")


def rename_target(kept: Column, named: Column) -> Column:
    """Folder and extension of the kept file, stem of the other."""
    ext = F.regexp_extract(base_name(kept), r"^.+(\.[^.]*)$", 1)
    return F.concat(parent(kept), F.lit("/"), stem(base_name(named)), ext)


def requested_prefix(path: Column, resolved: Column, requested: Column) -> Column:
    """A path below the resolved root as it reads below the root that was asked for."""
    return F.when(F.startswith(path, resolved), F.concat(requested, F.substr(path, F.length(resolved) + 1))).otherwise(path)


def trimmed(path: Column) -> Column:
    """Without slashes at the end; the root stays."""
    return F.regexp_replace(path, "(?<=.)/+$", "")


def tilde(path: Column, home: Column) -> Column:
    """~ and what begins with ~/ below home; other users' homes are left alone."""
    return F.when(path == "~", home).when(F.startswith(path, F.lit("~/")), F.concat(home, F.substr(path, F.lit(2)))).otherwise(path)


def is_relative(path: Column) -> Column:
    return ~F.startswith(path, F.lit("/"))
