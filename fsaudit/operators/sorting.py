"""Sort modes of listings."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class SortMode(Enum):
    NAME = "name"
    SIZE_DESC = "size-desc"
    SIZE_ASC = "size-asc"
    COUNT_DESC = "count-desc"
    COUNT_ASC = "count-asc"
    AGE_DESC = "age-desc"
    AGE_ASC = "age-asc"

    @classmethod
    def parse(cls, text: str) -> SortMode:
        s = text.lower()
        s = {"size": "size-desc", "count": "count-desc", "age": "age-desc", "oldest": "age-desc", "newest": "age-asc"}.get(s, s)
        try:
            return cls(s)
        except ValueError:
            raise ValueError(f"Invalid sort mode: {text}. Valid: {', '.join(m.value for m in cls)}") from None

    def next(self) -> SortMode:
        modes = list(SortMode)
        return modes[(modes.index(self) + 1) % len(modes)]

    def prev(self) -> SortMode:
        modes = list(SortMode)
        return modes[modes.index(self) - 1]

    def __str__(self) -> str:
        return self.value

    def _key(self) -> list[Column]:
        # The oldest first is the least access time first.
        return {
            SortMode.NAME: [], SortMode.SIZE_DESC: [F.desc("total_size")], SortMode.SIZE_ASC: [F.asc("total_size")], SortMode.COUNT_DESC: [F.desc("file_count")],
            SortMode.COUNT_ASC: [F.asc("file_count")], SortMode.AGE_DESC: [F.asc("latest_atime")], SortMode.AGE_ASC: [F.desc("latest_atime")],
        }[self]

    def directories(self) -> list[Column]:
        """Directories first by name; ties by name."""
        return [*(self._key() or [F.desc("is_dir")]), F.asc("name")]

    def partitions(self) -> list[Column]:
        return [*self._key(), F.asc("partition")]
