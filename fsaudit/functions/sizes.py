"""Sizes, counts, speeds and ages: parsing and display. Python forms for arguments and exact text, column forms for plans."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fsaudit.schema import DAY

_SUFFIXES = [("TIB", 40), ("T", 40), ("GIB", 30), ("G", 30), ("MIB", 20), ("M", 20), ("KIB", 10), ("K", 10), ("B", 0)]
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)(E[+-]?\d+)?")
_MAX = 2**63 - 1


def parse_size(text: str) -> int:
    """Bytes of a size such as 10K, 1.5GiB, 42. All suffixes are powers of 1024; a fraction of a byte is dropped."""
    s = text.strip().upper()
    bits = 0
    for suffix, k in _SUFFIXES:
        if s.endswith(suffix):
            s, bits = s[: -len(suffix)], k
            break
    s = s.strip()
    if not _NUMBER.fullmatch(s):
        raise ValueError(f"Invalid size: {text}")
    x = float(s) * (1 << bits)
    return max(-_MAX - 1, min(_MAX, math.trunc(x))) if math.isfinite(x) else (_MAX if x > 0 else -_MAX - 1)


def parse_size_col(text: Column) -> Column:
    """Column form of parse_size; null where that raises. One regular expression a row: what is used twice is outside of conditions, where Spark evaluates it once."""
    s = F.upper(F.trim(text))
    number = F.regexp_extract(s, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:E[+-]?\d+)?)\s*(?:TIB|T|GIB|G|MIB|M|KIB|K|B)?$", 1).try_cast("double")
    # Of a size nothing but the unit's first letter is left, if it isn't B.
    unit = F.translate(s, "+-.0123456789EIB \t\n\x0b\f\r\x85\u2028\u2029", "")
    x = number * F.pow(F.lit(1024.0), F.instr(F.lit("BKMGT"), unit) - 1)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(-_MAX - 1))), F.lit(float(_MAX))).cast("long"))


def round_to_block(size: Column | int, block: int) -> Column | int:
    """The size in whole blocks; itself if either is 0."""
    if isinstance(size, int):
        return size if block == 0 or size == 0 else -(-size // block) * block
    if block == 0:
        return size
    return size + F.pmod(-size, F.lit(block))  # integers throughout


@dataclass(frozen=True)
class SizeMode:
    """Which size of a file counts: what it takes on disk, its length, or its length in whole blocks."""

    kind: str = "disk"
    block: int = 0

    @classmethod
    def choose(cls, apparent: bool = False, block: str | int | None = None) -> SizeMode:
        """A block size wins over apparent size."""
        if block is not None:
            return cls("block", parse_size(block) if isinstance(block, str) else block)
        return cls("apparent") if apparent else cls()

    def calculate(self, disk: Column | int, length: Column | int) -> Column | int:
        if self.kind == "disk":
            return disk
        return length if self.kind == "apparent" else round_to_block(length, self.block)


def format_bytes(n: int) -> str:
    for unit, k in (("TiB", 40), ("GiB", 30), ("MiB", 20), ("KiB", 10)):
        if n >= 1 << k:
            return f"{n / (1 << k):.2f} {unit}"
    return f"{n} B"


def format_bytes_col(n: Column) -> Column:
    """Column form: halves go to even, as the exact binary value does."""
    out = None
    for unit, k in (("TiB", 40), ("GiB", 30), ("MiB", 20), ("KiB", 10)):
        text = F.format_string(f"%.2f {unit}", F.bround(n / F.lit(float(1 << k)), 2))
        out = F.when(n >= F.lit(1 << k), text) if out is None else out.when(n >= F.lit(1 << k), text)
    return out.otherwise(F.concat(n.cast("string"), F.lit(" B")))


def format_count(n: int) -> str:
    for unit, k in (("B", 10**9), ("M", 10**6), ("K", 10**3)):
        if n >= k:
            return f"{n / k:.1f}{unit}"
    return str(n)


def format_file_count(n: int) -> str:
    return "1 file" if n == 1 else f"{format_count(n)} files"


def format_speed(x: float) -> str:
    if x >= 1e6:
        return f"{x / 1e6:.1f}M files/s"
    return f"{x / 1e3:.1f}k files/s" if x >= 1e3 else f"{x:.0f} files/s"


@F.pandas_udf(StringType())
def format_count_col(n: pd.Series) -> pd.Series:
    """Arrow form of format_count: decimal divisors need the exact binary value, which format_string doesn't round by."""
    return n.map(format_count, na_action="ignore")


@F.pandas_udf(StringType())
def format_file_count_col(n: pd.Series) -> pd.Series:
    return n.map(format_file_count, na_action="ignore")


@F.pandas_udf(StringType())
def format_speed_col(x: pd.Series) -> pd.Series:
    return x.map(format_speed, na_action="ignore")


def format_atime(atime: int, now: int) -> str:
    if atime == 0:
        return ""
    if atime > now:
        return "future"
    days = (now - atime) // DAY
    if days == 0:
        return "today"
    if days < 30:
        return "1 day ago" if days == 1 else f"{days} days ago"
    n, unit = (days // 30, "month") if days < 365 else (days // 365, "year")
    return f"{n} {unit} ago" if n == 1 else f"{n} {unit}s ago"


def format_atime_col(atime: Column, now: int) -> Column:
    days = F.floor((F.lit(now) - atime) / F.lit(float(DAY))).cast("long")

    def ago(n: Column, unit: str) -> Column:
        return F.when(n == 1, F.lit(f"1 {unit} ago")).otherwise(F.concat(n.cast("string"), F.lit(f" {unit}s ago")))

    by = lambda k: F.floor(days / F.lit(float(k))).cast("long")
    return (
        F.when(atime == 0, "").when(atime > now, "future").when(days == 0, "today").when(days < 30, ago(days, "day"))
        .when(days < 365, ago(by(30), "month")).otherwise(ago(by(365), "year"))
    )
