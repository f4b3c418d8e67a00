"""Predicates over paths: substrings, prefixes and shell patterns translated to anchored regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str, pathname: bool = False, period: bool = False) -> str:
    """Anchored regular expression of a shell pattern; a backslash is an ordinary character. pathname: wildcards do not
    cross a slash. period: a dot that opens the string (or a segment, with pathname) is matched by a dot only."""
    out, i, opens = [], 0, True
    one = "[^/]" if pathname else "[\\s\\S]"
    while i < len(glob):
        c = glob[i]
        guard = r"(?!\.)" if period and opens else ""
        if c in "*?":
            out.append(guard + one + "*" * (c == "*"))
            i += 1
        elif c == "[" and (end := glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))) > 0 and not (pathname and "/" in glob[i:end]):
            body = glob[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]&~^])", r"\\\1", body[negated:])
            out.append(guard + (r"(?!/)" if pathname else "") + f"[{'^' * negated}{body}]")
            i = end + 1
        else:
            out.append(re.sub(r"([^\w/ -])", r"\\\1", c) if ord(c) < 128 else c)
            i += 1
        opens = pathname and c == "/"
    return f"^{''.join(out)}\\z"


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def _ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_ignoring_case(path: Column, needle: str) -> Column:
    """ASCII case is ignored; an empty needle is in every path."""
    return F.contains(_ascii_lower(path), _ascii_lower(F.lit(needle)))


def search_matches(path: Column, pattern: str, glob: bool | None = None) -> Column:
    """Case-sensitive substring, or a glob that keeps to path segments and explicit leading dots."""
    if is_glob(pattern) if glob is None else glob:
        return path.rlike(glob_to_regex(pattern, pathname=True, period=True))
    return F.contains(path, F.lit(pattern))


def extract_matches(path: Column, patterns: list[str], loose: bool = False) -> Column:
    """Any of the patterns. Strict: a glob (leading dot explicit), or the path itself or a directory above it; an empty pattern
    matches all. Loose: a glob without regard to dots, or a substring."""
    out = F.lit(False)
    for raw in patterns:
        if loose:
            one = path.rlike(glob_to_regex(raw)) | F.contains(path, F.lit(raw))
        else:
            p = raw.rstrip("/")
            one = F.lit(True) if not p else path.rlike(glob_to_regex(p, period=True)) if is_glob(p) else (path == p) | path.startswith(p + "/")
        out = out | one
    return out


def under(path: Column, prefix: str) -> Column:
    """Below a directory; slashes around the prefix do not matter."""
    p = prefix.strip("/")
    return path.startswith(p + "/") if p else F.lit(True)


def visible(name: Column, hidden: bool = False) -> Column:
    return F.lit(True) if hidden else ~name.startswith(".")
