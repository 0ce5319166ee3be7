"""One structure or many as objects: thin, immutable views of tables keyed by ``cell``.

A cell is a name and a resolution over a frame of its particles; many cells are
one frame with a column ``cell`` and an ordered list of names, never a list of
frames, so that whatever runs on one cell runs on all of them in one job.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.functions.coords import Region, resolution_name
from chromaloom.operators import features as ft
from chromaloom.sources import readers

#: Columns of a particle that are no features.
PLACE = ("cell", "chrom", "pos", "x", "y", "z")


@dataclass(frozen=True)
class Cell:
    """Particles of one cell (chrom, pos, x, y, z and features)."""

    data: DataFrame
    name: str
    resolution: int

    @property
    def features(self) -> list[str]:
        return [c for c in self.data.columns if c not in PLACE]

    def get_data(self, where: str | Region | tuple | None = None, query: str | None = None) -> DataFrame:
        """Particles of a region (all by default) that satisfy a predicate."""
        if where is not None:
            return ft.fetch(self.data, where, self.resolution, query)
        return self.data.where(query) if query else self.data

    def get_cluster(self, cluster: int | str, column: str) -> DataFrame:
        """Particles whose ``column`` equals ``cluster``."""
        return self.data.where(F.col(column) == F.lit(cluster))

    def feature_vector(self, features: list[str] | str, where: str | Region | tuple | None = None) -> DataFrame:
        """chrom, pos and the features."""
        names = [features] if isinstance(features, str) else list(features)
        if missing := [n for n in names if n not in self.data.columns]:
            raise ValueError(f"no feature {', '.join(missing)}")
        return self.get_data(where).select("chrom", "pos", *names)

    def with_data(self, data: DataFrame) -> Cell:
        """The same cell over other particles, for example with a feature attached."""
        return replace(self, data=data)

    def __len__(self) -> int:
        return self.data.count()

    def __repr__(self) -> str:
        return f"Cell {self.name!r} at {resolution_name(self.resolution)}, features: {', '.join(self.features) or 'none'}"


@dataclass(frozen=True)
class MultiCell:
    """Particles of many cells, their order, what is known of them (a frame with ``cell``) and named tables over them."""

    data: DataFrame
    names: tuple[str, ...]
    resolution: int
    about: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def of(cls, data: DataFrame, resolution: int, names: list[str] | None = None, about: DataFrame | None = None) -> MultiCell:
        """Over a frame; without ``names`` its cells in order (a job over the distinct names)."""
        found = [r["cell"] for r in data.select("cell").distinct().orderBy("cell").collect()] if names is None else names
        return cls(data, tuple(found), resolution, about)

    def __len__(self) -> int:
        return len(self.names)

    def __getitem__(self, key: int | slice) -> Cell | MultiCell:
        if isinstance(key, slice):
            return self.subset(list(self.names[key]))
        if isinstance(key, int):
            return self.get_cell(self.names[key])
        raise TypeError("cells are taken by place or slice")

    def get_cell(self, name: str) -> Cell:
        if name not in self.names:
            raise KeyError(name)
        return Cell(self.data.where(F.col("cell") == name), name, self.resolution)

    def subset(self, names: list[str]) -> MultiCell:
        """The named cells, in that order; tables keep the rows of these cells."""
        if missing := [n for n in names if n not in self.names]:
            raise KeyError(", ".join(missing))
        among = lambda df: df.where(F.col("cell").isin(names)) if "cell" in df.columns else df
        return replace(self, data=among(self.data), names=tuple(names), about=None if self.about is None else among(self.about), tables={k: among(t) for k, t in self.tables.items()})

    def get_data(self, where: str | Region | tuple | None = None, names: list[str] | None = None, query: str | None = None) -> DataFrame:
        """Particles of all or of the named cells in one frame."""
        some = self if names is None else self.subset(names)
        return Cell(some.data, "", self.resolution).get_data(where, query)

    @property
    def features(self) -> list[str]:
        return [c for c in self.data.columns if c not in PLACE]

    def metadata(self) -> DataFrame:
        """A row for each cell: cell, place in the order, particles, chromosomes and whatever else is known of it."""
        order = self.data.sparkSession.createDataFrame(list(enumerate(self.names)), "place bigint, cell string").select("cell", "place")
        counted = self.data.groupBy("cell").agg(F.count(F.lit(1)).alias("particles"), F.count_distinct("chrom").alias("chromosomes"))
        out = order.join(counted, "cell", "left").na.fill(0, ["particles", "chromosomes"])
        return out if self.about is None else out.join(self.about, "cell", "left")

    def with_table(self, name: str, table: DataFrame) -> MultiCell:
        """With a table registered; one of the same name gives way."""
        return replace(self, tables={**self.tables, name: table})

    def without_table(self, name: str) -> MultiCell:
        return replace(self, tables={k: t for k, t in self.tables.items() if k != name})

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no table {name!r}; there are: {', '.join(self.tables) or 'none'}")
        return self.tables[name]

    def table_names(self) -> list[str]:
        return sorted(self.tables)

    def annotated(self, name: str) -> DataFrame:
        """A table with the metadata of its cells."""
        return self.table(name).join(self.metadata(), "cell")


def load_cells(spark: SparkSession, paths: str | list[str], resolution: int, names: list[str] | None = None, alias: DataFrame | None = None) -> MultiCell:
    """Cells from structure files (a pattern or a list); a cell is named by its file.

    Files that are gone or broken are left out, as are the named cells that have no particle.
    """
    reader = "spark.sql.files.ignoreCorruptFiles", "spark.sql.files.ignoreMissingFiles"
    before = {k: spark.conf.get(k, None) for k in reader}
    for k in reader:
        spark.conf.set(k, "true")
    try:
        data = readers.read_structure(spark, paths, alias)
        data = data.where(F.col("chrom").isNotNull() & F.col("pos").isNotNull() & F.col("x").isNotNull())
        found = MultiCell.of(data, resolution)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return found if names is None else found.subset([n for n in names if n in found.names])


def load_profiled(cells: MultiCell, fragments: dict[str, DataFrame], tracks: dict[str, DataFrame] | None = None, peaks: dict[str, DataFrame] | None = None, flank: int = 200) -> MultiCell:
    """Cells with fragment counts (by feature name; within peaks where given) and tracks attached to their particles."""
    data = cells.data
    for name, track in (tracks or {}).items():
        data = ft.attach_bedgraph(data, track, name, cells.resolution)
    for name, rows in fragments.items():
        data = ft.attach_fragments(data, rows, name, cells.resolution, peaks=(peaks or {}).get(name), flank=flank)
    return replace(cells, data=data)


def template_names(df: DataFrame, column: str, reference: DataFrame, key: str, value: str, name: str = "value") -> DataFrame:
    """``df`` with the ``value`` that ``reference`` gives for ``column``; names that it lacks get null."""
    ref = reference.select(F.col(key).alias("_key"), F.col(value).alias(name)).dropDuplicates(["_key"])
    return df.join(ref, F.col(column) == F.col("_key"), "left").drop("_key")
