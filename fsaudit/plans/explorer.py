"""A walk through an index, level by level: each step is a state and gives a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fsaudit.functions.sizes import format_atime, format_bytes, format_file_count
from fsaudit.operators import rollup
from fsaudit.operators.filters import FilterSpec
from fsaudit.operators.sorting import SortMode


@dataclass(frozen=True)
class Explorer:
    """index: (path, size, atime, partition); cache it if it is walked much. The state is the partition and the directory; without a partition it is the partition list."""

    index: DataFrame = field(repr=False)
    spec: FilterSpec = FilterSpec()
    sort: SortMode = SortMode.NAME
    partition: str | None = None
    root: str | None = None
    path: str | None = None
    selected: int = 0
    #: "list" or "tree": one listing, or a column for every level down to here.
    mode: str = "list"
    #: The sort mode being chosen, if one is.
    pending: SortMode | None = None

    def listing(self, parent: bool = False) -> DataFrame:
        """The entries here; with ``parent``, below a partition, the row ".." first, as a list shows it."""
        if self.partition is None:
            return rollup.partition_listing(self.index, self.spec, self.sort)
        rows = rollup.directory_rollup(self.index, f"{self.path}/", self.spec, self.partition)
        if not parent:
            return rows.orderBy(*self.sort.directories())
        above = rows.sparkSession.range(1).select(F.lit("..").alias("name"), F.lit("..").alias("path"), F.lit(True).alias("is_dir"), *[F.lit(0).cast("long").alias(c) for c in ("total_size", "file_count", "latest_atime")])
        both = above.withColumn("level", F.lit(0)).unionByName(rows.withColumn("level", F.lit(1)))
        return both.orderBy("level", *self.sort.directories()).drop("level")

    def enter(self, name: str) -> Explorer:
        """Into a partition, a directory, or up for "..". A file is not entered."""
        if name == "..":
            return self.up()
        if self.partition is None:
            found = rollup.partition_root(self.index, name).first()
            if found is None:
                raise ValueError(f"No such partition: {name}")
            return replace(self, partition=name, root=found.root, path=found.root, selected=0)
        below = f"{self.path}/{name}/"
        if self.index.filter((F.col("partition") == self.partition) & F.col("path").startswith(below)).isEmpty():
            return self
        return replace(self, path=below[:-1], selected=0)

    def up(self) -> Explorer:
        if self.partition is None:
            return self
        if self.path == self.root:
            return replace(self, partition=None, root=None, path=None, selected=0)
        return replace(self, path=self.path.rpartition("/")[0], selected=0)

    def filtered(self, field_: str, text: str, now: int) -> tuple[Explorer, str | None]:
        """The same place under a changed filter, and a message if the text isn't valid."""
        spec, message = self.spec.with_input(field_, text, now)
        return replace(self, spec=spec), message

    def cleared(self) -> Explorer:
        return replace(self, spec=self.spec.clear())

    def sorted(self, sort: SortMode) -> Explorer:
        return replace(self, sort=sort)

    def toggled(self) -> Explorer:
        """From list to tree or back, at the same place."""
        return replace(self, mode="tree" if self.mode == "list" else "list")

    def start_sort(self) -> Explorer:
        return replace(self, pending=self.sort)

    def next_sort(self) -> Explorer:
        return replace(self, pending=(self.pending or self.sort).next())

    def prev_sort(self) -> Explorer:
        return replace(self, pending=(self.pending or self.sort).prev())

    def confirm_sort(self) -> Explorer:
        return replace(self, sort=self.pending or self.sort, pending=None)

    def cancel_sort(self) -> Explorer:
        return replace(self, pending=None)

    def move(self, step: int, size: int) -> Explorer:
        """The selection some rows on or back."""
        return self.select(self.selected + step, size)

    def first(self) -> Explorer:
        return replace(self, selected=0)

    def last(self, size: int) -> Explorer:
        return self.select(size - 1, size)

    def right(self, name: str) -> Explorer:
        """In the tree: into the selected entry, if it can be entered."""
        return self.enter(name)

    def left(self) -> Explorer:
        """In the tree: to the column before."""
        return self.up()

    def preview(self, name: str) -> DataFrame | None:
        """What the column after the selected entry shows; nothing for a file."""
        at = self.enter(name)
        return None if at == self else at.listing()

    def view(self) -> list[tuple[str, DataFrame]]:
        """(title, listing) of what the mode shows."""
        return self.columns() if self.mode == "tree" else [(self.path or "partitions", self.listing(parent=True))]

    def select(self, k: int, size: int) -> Explorer:
        """The selection, held inside a listing of ``size`` rows."""
        return replace(self, selected=max(0, min(k, size - 1)))

    def columns(self) -> list[tuple[str, DataFrame]]:
        """The tree form: (title, listing) of the partition list and of every directory from the partition's root down to here."""
        out = [("partitions", rollup.partition_listing(self.index, self.spec, self.sort))]
        if self.partition is not None:
            at, rest = self.root, self.path[len(self.root) :].strip("/")
            for name in [None, *(rest.split("/") if rest else [])]:
                at = at if name is None else f"{at}/{name}"
                out.append((at, rollup.directory_listing(self.index, f"{at}/", self.spec, self.partition, self.sort)))
        return out


def render_listing(listing: DataFrame, now: int) -> list[str]:
    """One line per entry. A listing is one level of a tree; its rows go to the terminal one partition at a time."""
    return [f"{r.name}{'/' if r.is_dir else ''}\t{format_bytes(r.total_size)}\t{format_file_count(r.file_count)}\t{format_atime(r.latest_atime, now)}" for r in listing.toLocalIterator()]
