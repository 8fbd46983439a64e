"""The filter algebra: a conjunction of path pattern, size bounds and age bounds, as column expressions that Catalyst can push down."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fsaudit.functions.paths import java_pattern, literal_edge
from fsaudit.functions.sizes import format_bytes, parse_size
from fsaudit.schema import DAY


@dataclass(frozen=True)
class FilterSpec:
    """older_than and newer_than are thresholds in epoch seconds: older is strictly before, newer is from then on."""

    pattern: str | None = None
    min_size: int | None = None
    max_size: int | None = None
    older_than: int | None = None
    newer_than: int | None = None

    @classmethod
    def of(cls, now: int, pattern: str | None = None, min_size: str | int | None = None, max_size: str | int | None = None, older_than_days: int | None = None, newer_than_days: int | None = None) -> FilterSpec:
        size = lambda x: parse_size(x) if isinstance(x, str) else x
        ago = lambda d: None if d is None else now - d * DAY
        return cls(pattern, size(min_size), size(max_size), ago(older_than_days), ago(newer_than_days))

    @property
    def is_active(self) -> bool:
        return self != FilterSpec()

    def clear(self) -> FilterSpec:
        return FilterSpec()

    def conditions(self) -> list[Column]:
        out = []
        if self.pattern is not None:
            edge = literal_edge(self.pattern)
            out.append(getattr(F.col("path"), edge[0])(edge[1]) if edge else F.col("path").rlike(java_pattern(self.pattern)))
        if self.min_size is not None:
            out.append(F.col("size") >= self.min_size)
        if self.max_size is not None:
            out.append(F.col("size") <= self.max_size)
        if self.older_than is not None:
            out.append(F.col("atime") < self.older_than)
        if self.newer_than is not None:
            out.append(F.col("atime") >= self.newer_than)
        return out

    def predicate(self) -> Column:
        return reduce(lambda a, b: a & b, self.conditions(), F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.predicate()) if self.is_active else df

    def format_display(self, now: int) -> str:
        parts = []
        if self.pattern is not None:
            parts.append(f"[/{self.pattern}]")
        for name, x in (("min", self.min_size), ("max", self.max_size)):
            if x is not None:
                parts.append(f"[{name}:{format_bytes(x)}]")
        for name, x in (("older", self.older_than), ("newer", self.newer_than)):
            if x is not None:
                parts.append(f"[{name}:{(now - x) // DAY}d]")
        return " ".join(parts)

    def with_input(self, field: str, text: str, now: int) -> tuple[FilterSpec, str | None]:
        """The filter after typing ``text`` for a field. Empty text clears the field; text that isn't valid leaves all as it was and gives a message."""
        text = text.strip()
        if not text:
            return replace(self, **{field: None}), None
        try:
            if field == "pattern":
                return replace(self, pattern=text), None
            if field in ("min_size", "max_size"):
                return replace(self, **{field: parse_size(text)}), None
            if not (text.isascii() and text.isdigit()):
                raise ValueError(f"Invalid number of days: {text}")
            return replace(self, **{field: now - int(text) * DAY}), None
        except ValueError as e:
            return self, str(e)
