"""What is known of a grid before any data is read: names, sizes, staggering, boundaries, topology."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

TOPOLOGIES = ("latlon", "cartesian", "MOM-tripolar")


@dataclass(frozen=True)
class GridSpec:
    """A C-grid of ``nx`` by ``ny`` tracer cells, kept as long tables.

    Tables: centers (yh, xh), u faces (yh, xq), v faces (yq, xh) and corners (yq, xq), the names of the index columns as given.
    A symmetric grid has ``nx + 1`` by ``ny + 1`` corners, another one ``nx`` by ``ny``.
    """

    nx: int
    ny: int
    symmetric: bool = True
    periodic_x: bool = True
    periodic_y: bool = False
    topology: str = "latlon"
    xh: str = "xh"
    yh: str = "yh"
    xq: str = "xq"
    yq: str = "yq"

    def __post_init__(self):
        if self.topology not in TOPOLOGIES:
            raise ValueError(f"topology must be one of {TOPOLOGIES}")
        if self.nx < 1 or self.ny < 1:
            raise ValueError("a grid has a cell at least")

    @classmethod
    def from_positions(cls, nx: int, ny: int, x: dict[str, str], y: dict[str, str], boundary: dict[str, str] | None = None, topology: str = "latlon") -> GridSpec:
        """From the index names at each position of the axes, as ``{"center": "xh", "outer": "xq"}``."""
        boundary = boundary or {}
        symmetric = check_symmetric(x, y)
        at = "outer" if symmetric else "right"
        return cls(nx, ny, symmetric, boundary.get("X") == "periodic", boundary.get("Y") == "periodic", topology, x.get("center", "xh"), y.get("center", "yh"), x[at], y[at])

    @property
    def corners_x(self) -> int:
        return self.nx + self.symmetric

    @property
    def corners_y(self) -> int:
        return self.ny + self.symmetric

    @property
    def walk_x(self) -> int:
        """Columns of corners on which paths run: a periodic symmetric grid has its first column twice."""
        return self.nx if self.symmetric and self.periodic_x else self.corners_x

    def coords(self) -> dict[str, dict[str, str]]:
        """Index names by axis and position."""
        return {"X": {"center": self.xh, "corner": self.xq}, "Y": {"center": self.yh, "corner": self.yq}}

    def wrap(self, index: Column, axis: str) -> Column:
        """A centre index brought onto the grid: around a periodic axis, else to the nearest cell."""
        n, around = (self.nx, self.periodic_x) if axis == "X" else (self.ny, self.periodic_y)
        return F.pmod(index, F.lit(n)) if around else F.greatest(F.lit(0), F.least(index, F.lit(n - 1)))


def check_symmetric(x: dict[str, str], y: dict[str, str]) -> bool:
    """Whether corners are at the outer positions of both axes; at the right ones, not."""
    for position, symmetric in (("outer", True), ("right", False)):
        if position in x and position in y:
            return symmetric
    raise ValueError("corners must be at the outer or at the right positions of both axes")


def geo_columns(df: DataFrame, index: tuple[str, str]) -> tuple[str, str]:
    """The first columns named after longitude and latitude in a table with these index columns."""
    if missing := [c for c in index if c not in df.columns]:
        raise ValueError(f"no index column {missing}")
    found = [next((c for c in df.columns if part in c.lower()), None) for part in ("lon", "lat")]
    if None in found:
        raise ValueError("no longitude and latitude columns")
    return found[0], found[1]


def corner_table(df: DataFrame, spec: GridSpec) -> DataFrame:
    """``(j, i, lon, lat)`` of the corners; NaN is null."""
    lon, lat = geo_columns(df, (spec.yq, spec.xq))
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return df.select(F.col(spec.yq).cast("long").alias("j"), F.col(spec.xq).cast("long").alias("i"), number(lon).alias("lon"), number(lat).alias("lat"))


def check_mask(mask: DataFrame, spec: GridSpec, inside: str) -> None:
    for c in (spec.yh, spec.xh, inside):
        if c not in mask.columns:
            raise ValueError(f"a mask has a column {c}")
    if not isinstance(mask.schema[inside].dataType, BooleanType):
        raise ValueError("a mask is boolean")
