"""Path and text expressions, all inside whole-stage codegen."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from fsaudit.schema import ROOT_PARTITION

#: CSI and OSC sequences, two-byte escapes, a bare escape at the end.
ANSI = r"\x1B(?:\[[^\x40-\x7E]*[\x40-\x7E]?|\][^\x07\x1B]*(?:\x07|\x1B\\?)?|[\s\S])?"


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def rest_after(path: Column, prefix: str) -> Column:
    """What follows a prefix, counted in characters."""
    return F.substr(path, F.lit(len(prefix) + 1))


def component(rest: Column) -> Column:
    return F.substring_index(rest, "/", 1)


def is_dir(rest: Column) -> Column:
    return F.instr(rest, "/") > 0


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def derive_partition(path: Column, top: str) -> Column:
    """First component under the top directory; the root partition for files directly in it."""
    rest = rest_after(path, top.rstrip("/") + "/")
    return F.when(is_dir(rest), component(rest)).otherwise(F.lit(ROOT_PARTITION))


def partition_of_file(file_path: Column) -> Column:
    """Name of the directory that holds a Parquet file; file paths are percent-encoded but for plus signs."""
    return F.url_decode(F.replace(F.regexp_extract(file_path, r".*/([^/]+)/[^/]+\.parquet$", 1), F.lit("+"), F.lit("%2B")))


def user_of(path: Column) -> Column:
    return F.regexp_extract(path, "/home/([^/]+)/", 1)


def java_pattern(pattern: str) -> str:
    """An RE2 pattern as Java reads it: named groups, and a last dollar that doesn't match before a line feed."""
    out = pattern.replace("(?P<", "(?<")
    stem = out.removesuffix("$")
    if stem != out and (len(stem) - len(stem.rstrip("\\"))) % 2 == 0:
        out = stem + r"\z"
    return out


def literal_edge(pattern: str) -> tuple[str, str] | None:
    """("startswith" or "endswith", text) if that is all a pattern says: such tests reach the Parquet reader, regular expressions don't."""
    plain = lambda s: "".join(s) if all(c not in r"\.^$*+?()[]{}|" for c in s) else None

    def unescape(s: str) -> str | None:
        out, k = [], 0
        while k < len(s):
            if s[k] == "\\":
                if k + 1 >= len(s) or s[k + 1].isalnum():
                    return None
                out.append(s[k + 1])
                k += 2
            elif plain(s[k]) is None:
                return None
            else:
                out.append(s[k])
                k += 1
        return "".join(out)

    if pattern.startswith("^") and (x := unescape(pattern[1:])):
        return "startswith", x
    if pattern.endswith("$") and (x := unescape(pattern[:-1])) and not pattern.endswith("\\$"):
        return "endswith", x
    return None


def safe_text(path: str | bytes) -> str:
    """A file name as UTF-8; bytes that aren't become replacement characters."""
    return os.fsencode(path).decode("utf-8", "replace")
