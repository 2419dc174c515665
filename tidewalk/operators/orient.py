"""Which side of a section is inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewalk.functions.geo import distance, stereographic
from tidewalk.plans.grid import GridSpec, check_mask

from .faces import sign

GEOMETRIES = ("spherical", "cartesian")


def counterclockwise(path: DataFrame, geometry: str = "spherical", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``(section_id, counterclockwise, is_closed)`` by the sign of the area that ``path(section_id, pt, lon, lat)`` encloses.

    Ends more than 10 m apart are joined; which way an open section turns is then a convention.  On a sphere the area is that of the
    polar stereographic picture.  With a missing coordinate it is null.
    """
    if geometry not in GEOMETRIES:
        raise ValueError(f"geometry must be one of {GEOMETRIES}")
    x, y = stereographic(lon, lat) if geometry == "spherical" else (F.col(lon), F.col(lat))
    by = W.partitionBy("section_id").orderBy("pt")
    whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = path.select("section_id", "pt", x.alias("x"), y.alias("y"), (distance(F.first(lon).over(whole), F.first(lat).over(whole), F.last(lon).over(whole), F.last(lat).over(whole)) <= 10).alias("closed"))
    nxt = lambda c: F.coalesce(F.lead(c).over(by), F.when(~F.col("closed"), F.first(c).over(by)))
    missing = F.isnan("x") | F.isnan("y") | F.col("x").isNull() | F.col("y").isNull()
    ends = ends.select("section_id", "closed", missing.alias("missing"), ((nxt("x") - F.col("x")) * (nxt("y") + F.col("y"))).alias("part"))
    return ends.groupBy("section_id").agg(F.when(~F.max("missing"), F.sum("part") < 0).alias("counterclockwise"), F.first("closed").alias("is_closed"))


def mask_inside(mask: DataFrame, found: DataFrame, spec: GridSpec, sect: int = 0, inside: str = "inside") -> DataFrame:
    """``(section_id, inside)``: the mask's value at the cell that face ``sect`` has on its positive side.

    One step off the grid it is the opposite of the nearest cell's value.
    """
    check_mask(mask, spec, inside)
    u = F.col("var") == "U"
    back, shift = F.when(sign() == -1, 1).otherwise(0), 0 if spec.symmetric else 1
    one = found.where(F.col("sect") == sect)
    one = one.select("section_id", u.alias("u"), F.when(u, F.col("i") - back + shift).otherwise(F.col("i")).alias("i"), F.when(u, F.col("j")).otherwise(F.col("j") - back + shift).alias("j"))
    off = F.when(F.col("u"), (F.col("i") < 0) | (F.col("i") > spec.nx - 1)).otherwise((F.col("j") < 0) | (F.col("j") > spec.ny - 1))
    near = lambda c, n: F.greatest(F.lit(0), F.least(F.col(c), F.lit(n - 1)))
    one = one.select("section_id", off.alias("off"), F.when(F.col("u"), near("i", spec.nx)).otherwise(spec.wrap(F.col("i"), "X")).alias("i"), F.when(F.col("u"), spec.wrap(F.col("j"), "Y")).otherwise(near("j", spec.ny)).alias("j"))
    cells = mask.select(F.col(spec.yh).alias("_j"), F.col(spec.xh).alias("_i"), F.col(inside).alias("_in"))
    held = one.join(cells, (F.col("j") == F.col("_j")) & (F.col("i") == F.col("_i")), "left")
    return held.select("section_id", F.when(F.col("off"), ~F.col("_in")).otherwise(F.col("_in")).alias("inside"))


def orientation(path: DataFrame, found: DataFrame, spec: GridSpec, geometry: str = "spherical", positive_in: bool | DataFrame = True) -> DataFrame:
    """``(section_id, positive_in, orient_fact)``: whether transports count as positive the way the faces' signs have it.

    A section whose inside is not known (its cell is missing from the mask, or a coordinate is missing) is an error.
    """
    if isinstance(positive_in, DataFrame):
        held = mask_inside(positive_in, found, spec).select("section_id", F.col("inside").alias("positive_in"))
    else:
        if geometry == "cartesian" and spec.periodic_x:
            raise ValueError("periodic cartesian domains have no inside")
        turn: Column = F.col("counterclockwise")
        held = counterclockwise(path, geometry).select("section_id", (turn if positive_in else ~turn).alias("positive_in"))
    unknown = F.raise_error(F.concat(F.lit("no inside is known of section "), F.col("section_id").cast("string"))).cast("int")
    return held.select("section_id", "positive_in", F.when(F.col("positive_in"), 1).when(~F.col("positive_in"), -1).otherwise(unknown).alias("orient_fact"))
