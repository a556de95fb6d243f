"""Numbers, digests, hashes, identifiers and media scores as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative efficiency of codecs; any other counts as 1 and unknown.
CODEC_EFFICIENCY = {"av1": 3.0, "hevc": 2.0, "vp9": 1.8, "h264": 1.0, "mpeg4": 0.7, "mpeg2video": 0.5}
UNITS = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3}
PROBE_ABOVE, PROBE_WINDOW = 8 * 1024 * 1024, 4096
#: Four-character codes of codecs.
CODEC_CODES = {
    "h264": ("avc1", "avc3"),
    "hevc": ("hvc1", "hev1", "dvh1", "dvhe"),
    "av1": ("av01",),
    "vp9": ("vp09",),
    "mpeg4": ("mp4v",),
    "mpeg2video": ("m2v1", "mpg2"),
    "mjpeg": ("jpeg",),
}


def group_key(size: Column, digest: Column) -> Column:
    return F.concat_ws(":", size.cast("string"), digest)


def probe_digest(content: Column, window: int = PROBE_WINDOW) -> Column:
    """SHA-256 of the big-endian length, the head and, of what is longer than the window, the tail."""
    size = F.octet_length(content)
    head = F.unhex(F.lpad(F.hex(size.cast("bigint")), 16, "0"))
    tail = F.when(size > window, F.substring(content, -window, window)).otherwise(F.lit(b""))
    return F.sha2(F.concat(head, F.substring(content, 1, window), tail), 256)


def bytes_parsed(text: Column) -> Column:
    """Digits and b, kb, mb or gb, binary; null if malformed or beyond 64 bits."""
    number = F.regexp_extract(F.lower(F.trim(text)), r"^(\d{1,18}) ?(b|kb|mb|gb)?$", 1)
    unit = F.regexp_extract(F.lower(F.trim(text)), r"^(\d{1,18}) ?(b|kb|mb|gb)?$", 2)
    factor = F.when(unit == "kb", UNITS["kb"]).when(unit == "mb", UNITS["mb"]).when(unit == "gb", UNITS["gb"]).otherwise(1)
    exact = F.when(number != "", number.cast("decimal(38,0)") * factor)
    return F.when(exact <= F.lit(2**63 - 1), exact.cast("bigint"))


def bytes_shown(size: Column) -> Column:
    """N B below 1024, else one decimal, rounded half away from zero; negative is 0 B."""
    n = F.greatest(size, F.lit(0))
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, power in (("KB", 1024), ("MB", 1024**2), ("GB", 1024**3)):
        tenths = F.floor(n / power * 10 + 0.5)
        shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(n >= power, shown).otherwise(out)
    return out


def dice_possible(a: Column, b: Column, threshold: float) -> Column:
    """Whether two counts can reach the threshold: max / min <= (2 - t) / t."""
    if threshold <= 0:
        return (F.least(a, b) > 0)
    return (F.least(a, b) > 0) & (F.greatest(a, b) * threshold <= F.least(a, b) * (2 - threshold))


def codec_name(codec: Column) -> Column:
    """Lower case, and four-character codes by the codec they stand for."""
    low = F.lower(codec)
    out = low
    for name, codes in CODEC_CODES.items():
        out = F.when(low.isin(*codes), name).otherwise(out)
    return out


def codec_known(codec: Column) -> Column:
    return codec_name(codec).isin(*CODEC_EFFICIENCY)


def codec_efficiency(codec: Column) -> Column:
    name, out = codec_name(codec), F.lit(1.0)
    for known, value in CODEC_EFFICIENCY.items():
        out = F.when(name == known, value).otherwise(out)
    return out


def frame_times(duration: Column, count: int) -> Column:
    """Seconds at which frames are taken: evenly inside, a tenth apart at least; one apart where the length is unknown.

    Marks past the end of a video of known length are dropped.
    """
    known = F.coalesce(duration > 0, F.lit(False))
    step = F.when(known, F.greatest(duration / (count + 1), F.lit(0.1))).otherwise(1.0)
    return F.filter(F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: step * i), lambda t: ~known | (t < duration))


def instant_of(scan_id: Column) -> Column:
    """The instant of a scan identifier, null if it is malformed."""
    return F.when(is_scan_id(scan_id), F.try_to_timestamp(F.concat(F.substring(scan_id, 1, 15), F.lit("."), F.substring(scan_id, 17, 6)), F.lit("yyyyMMdd-HHmmss.SSSSSS")))


def whole_second(iso: Column) -> Column:
    """The instant of an ISO time that ends in Z, without its fraction; null if it is malformed."""
    return F.when(F.endswith(iso, F.lit("Z")) & (F.length(iso) > 19), F.try_to_timestamp(F.substring(iso, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def next_free_id(instant: Column, taken: Column, limit: int = 1000) -> Column:
    """The first identifier from an instant on, a microsecond apart, that is not in taken; null after limit tries."""
    tries = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda k: scan_id(F.timestamp_micros(F.unix_micros(instant) + k)))
    return F.get(F.filter(tries, lambda x: ~F.array_contains(taken, x)), 0)


def thumbnail_pixels(points: Column, scale: Column) -> Column:
    """Points times scale, up to a multiple of 32, between 32 and 512."""
    raw = F.ceil(points * F.greatest(F.lit(1.0), scale))
    return F.least(F.lit(512), F.greatest(F.lit(32), F.floor((raw + 31) / 32) * 32)).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)


def median_bits(values: Column) -> Column:
    """64 numbers to 64 bits: one where strictly above the median, the first number in the highest bit."""
    ordered = F.array_sort(values)
    median = (F.get(ordered, 31) + F.get(ordered, 32)) / 2
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(F.when(x > median, 1).otherwise(0).cast("bigint")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_layout(distance: int, bits: int = 64) -> list[tuple[int, int]]:
    """distance + 1 bands as (offset, width), wider ones first: two hashes within distance share one."""
    n = distance + 1
    out, at = [], 0
    for i in range(n):
        width = bits // n + (1 if i < bits % n else 0)
        out.append((at, width))
        at += width
    return out


def band_value(h: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(h, offset).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def scan_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss-SSSSSS")


def iso(ts: Column) -> Column:
    """ISO without a zero fraction."""
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.endswith(full, F.lit(".000000")), F.substring(full, 1, 19)).otherwise(full)


def is_scan_id(text: Column) -> Column:
    return (F.length(text) == 22) & text.rlike("^[0-9]{8}-[0-9]{6}-[0-9]{6}$")
