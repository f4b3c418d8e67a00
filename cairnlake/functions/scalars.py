"""Scalar expressions over names, sizes, times and types, all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlake.schema import DIRECTORY, FILE, HARDLINK_FLAG, SYMLINK

_UNITS = ("B", "KB", "MB", "GB", "TB")


def format_bytes(n: Column) -> Column:
    """Steps of 1024 up to TB; bytes without decimals, the others with two. The exact value is rounded, ties to even, as C and
    SQL print it; format_string would round ties up."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(_UNITS[1:], 1):
        out = F.when(n >= 1024**k, F.concat(F.call_function("format_number", n / float(1024**k), F.lit("0.00")), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_timestamp_utc(ns: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(F.floor(ns / 1_000_000_000)), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def to_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def entry_type_char(kind: Column, flags: Column, hardlink_to: Column) -> Column:
    """D, L, F, H (a file with the hard-link flag or a target) or O."""
    linked = (flags.bitwiseAND(HARDLINK_FLAG) != 0) | hardlink_to.isNotNull()
    return F.when(kind == DIRECTORY, "D").when(kind == SYMLINK, "L").when((kind == FILE) & linked, "H").when(kind == FILE, "F").otherwise("O")


def search_type_label(kind: Column) -> Column:
    return F.when(kind == FILE, "F").when(kind == DIRECTORY, "D").when(kind == SYMLINK, "L").otherwise("?")


def snapshot_name(label: Column, ns: Column, id_hex: Column) -> Column:
    """[label_]date_time_id8.snap in UTC; other characters of a label become underscores."""
    clean = F.regexp_replace(label, "[^A-Za-z0-9_-]", "_")
    stamp = F.date_format(F.timestamp_millis(F.floor(ns / 1_000_000)), "yyyy-MM-dd_HH-mm-ss-SSS")
    return F.concat(F.when(F.length(clean) > 0, F.concat(clean, F.lit("_"))).otherwise(""), stamp, F.lit("_"), F.substring(id_hex, 1, 8), F.lit(".snap"))


def parse_snapshot_timestamp(name: Column) -> Column:
    """Seconds since the epoch of the stamp before the last underscore of a name, with or without milliseconds; 0 for
    other names and dates that do not exist. A second of 60 counts as the next minute's first."""
    stem = F.regexp_extract(name, r"^(.*)_[^_.]*\.[^.]*$", 1)
    parts = r"(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})-(\d{2})(?:-\d{3})?$"
    pick = lambda k: F.regexp_extract(stem, parts, k)
    day = F.try_to_date(F.concat_ws("-", pick(1), pick(2), pick(3)), "yyyy-MM-dd")
    hour, minute, second = (pick(k).try_cast("int") for k in (4, 5, 6))
    ok = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 60)
    return F.coalesce(F.when(ok, F.unix_date(day).cast("long") * 86400 + hour * 3600 + minute * 60 + second), F.lit(0).cast("long"))


def is_safe_relative_path(path: Column) -> Column:
    return (F.length(path) > 0) & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def parse_id_from_name(name: Column) -> Column:
    return F.regexp_extract(name, r"^(\d+)\.[^.]*$", 1).try_cast("long")


def parse_uri(uri: Column) -> Column:
    """struct<scheme, user, host, port, path>; local paths have no scheme. Ports lie in 1..65535, else all is null."""
    rule = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^@/]*)@)?(\[[^\]]*\]|[^:/]*)(?::(\d+))?(/.*)?$"
    part = lambda k: F.nullif(F.regexp_extract(uri, rule, k), F.lit(""))
    remote, port = uri.rlike(rule), part(4).try_cast("int")
    path = F.when(remote, F.coalesce(part(5), F.lit("/"))).otherwise(uri)
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "(?<=.)/+$", "")).otherwise(path)
    good = ~remote | part(4).isNull() | port.between(1, 65535)
    return F.when(good, F.struct(part(1).alias("scheme"), part(2).alias("user"), part(3).alias("host"), port.alias("port"), path.alias("path")))


def parse_size(text: Column, low: int = 4 << 10, high: int = 1 << 30) -> Column:
    """Bytes of a number with an optional K or M; null outside of low..high."""
    n = F.regexp_extract(text, r"^(\d+)([KkMm]?)$", 1).try_cast("long")
    unit = F.upper(F.regexp_extract(text, r"^(\d+)([KkMm]?)$", 2))
    size = n * F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).otherwise(1)
    return F.when(size.between(low, high), size)
