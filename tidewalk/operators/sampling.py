"""Fields sampled at faces: convergent transports and tracers.

Sections are a small table and fields a large one, so the plan is one pass over each field: the faces are counted
and bounded once, the bounds go to the scan as filters, and the faces are
broadcast if there are at most MOST_FACES of them (else the join shuffles).  Signs and orientation are one factor in the face table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewalk.plans.grid import GridSpec

from .faces import face_coords, faces, sampled, sign
from .orient import orientation

#: Some 100 bytes each.
MOST_FACES = 500_000


def number(name: str) -> Column:
    """A field's value; NaN is null."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def at_faces(held: DataFrame, field: DataFrame, index: tuple[str, str], value: str, out: str = "_value") -> DataFrame:
    """Inner join of faces ``(fj, fi, ...)`` with a field on its indices, all other columns of the field kept."""
    n, j0, j1, i0, i1 = held.agg(F.count(F.lit(1)), F.min("fj"), F.max("fj"), F.min("fi"), F.max("fi")).first()
    other = [c for c in field.columns if c not in (*index, value)]
    field = field.where(F.col(index[0]).between(j0, j1) & F.col(index[1]).between(i0, i1)).select(*other, F.col(index[0]).alias("fj"), F.col(index[1]).alias("fi"), number(value).alias(out))
    return field.join(F.broadcast(held) if n <= MOST_FACES else held, ["fj", "fi"])


def along(held: DataFrame) -> DataFrame:
    """Faces with the ``distance`` along the section to each one's end."""
    return held.withColumn("distance", F.sum("dl").over(W.partitionBy("section_id").orderBy("sect")))


def convergent_transport(
    path: DataFrame, spec: GridSpec, u: DataFrame, v: DataFrame, corners: DataFrame | None = None, centers: DataFrame | None = None,
    utr: str = "umo", vtr: str = "vmo", layer: str | None = "z_l", interface: str | None = "z_i", outname: str = "conv_mass_transport",
    geometry: str = "spherical", positive_in: bool | DataFrame = True, widths: tuple[DataFrame, DataFrame] | None = None, dense: bool = False, native: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Signed transports into a section at each of its faces, for all times and layers at once.

    ``path(section_id, pt, i, j, lon, lat)`` holds any number of sections; ``u(yh, xq, ..., utr)`` and
    ``v(yq, xh, ..., vtr)`` have the same further columns (time, layer).  ``positive_in`` is whether the inside counts as positive, or a boolean mask
    of cells.  ``widths`` are tables (yh, xq, width) and (yq, xh, width); both or none, and with them come ``dl`` per face and the ``distance`` along the section up to its end.
    Missing values are 0; ``dense`` gives a row for every face, time and layer that both fields have, where
    otherwise cells that the fields have no row of give none.
    """
    if layer is not None and interface is not None and layer.replace("l", "i") != interface:
        raise ValueError("layer and interface don't belong together")
    dims = [c for c in u.columns if c not in (spec.yh, spec.xq, utr)]
    if sorted(dims) != sorted(c for c in v.columns if c not in (spec.yq, spec.xh, vtr)):
        raise ValueError("u and v have different dimensions")
    found = faces(path, spec)
    held = found
    if native or (corners is not None and centers is not None):
        held = face_coords(found, spec, corners, centers, *(native or ()))
    held = sampled(held, spec).join(orientation(path, found, spec, geometry, positive_in), "section_id")
    held = held.withColumn("sign", sign() * F.col("orient_fact")).withColumnRenamed("var", "dir")
    if widths is not None:
        (wu, wv), isu = widths, F.col("dir") == "U"
        wu = wu.select(F.col(spec.yh).alias("fj"), F.col(spec.xq).alias("fi"), F.lit("U").alias("dir"), number("width").alias("dl"))
        wv = wv.select(F.col(spec.yq).alias("fj"), F.col(spec.xh).alias("fi"), F.lit("V").alias("dir"), number("width").alias("dl"))
        held = held.join(wu.unionByName(wv), ["dir", "fj", "fi"], "left").withColumn("dl", F.coalesce("dl", F.lit(0.0)))
        held = along(held)
    held = held.drop("nward", "eward", "i", "j").persist()
    parts = [at_faces(held.where(F.col("dir") == d), f, at, name) for d, f, at, name in (("U", u, (spec.yh, spec.xq), utr), ("V", v, (spec.yq, spec.xh), vtr))]
    both = parts[0].unionByName(parts[1])
    if dense:
        at = u.select(*dims).distinct().intersect(v.select(*dims).distinct()) if dims else None
        full = held if at is None else held.crossJoin(at)
        both = full.join(both.select("section_id", "sect", *dims, "_value"), ["section_id", "sect", *dims], "left")
    keep = [c for c in ("sign", "dir", "lon", "lat", "dl", "distance", "orient_fact", "positive_in") if c in both.columns]
    return both.select("section_id", *dims, "sect", (F.coalesce("_value", F.lit(0.0)) * F.col("sign")).alias(outname), *keep)


def tracer_sides(found: DataFrame, spec: GridSpec) -> DataFrame:
    """Two rows a face, ``(section_id, sect, fj, fi)``: the cells left and right of it, around both axes."""
    inc = 1 if spec.symmetric else 0
    u = F.col("var") == "U"
    held = found.select("section_id", "sect", "var", "i", "j", F.explode(F.array(F.lit(-inc), F.lit(1 - inc))).alias("d"))
    return held.select(
        "section_id", "sect", F.pmod(F.when(u, F.col("j")).otherwise(F.col("j") + F.col("d")), F.lit(spec.ny)).cast("long").alias("fj"),
        F.pmod(F.when(u, F.col("i") + F.col("d")).otherwise(F.col("i")), F.lit(spec.nx)).cast("long").alias("fi"),
    )


def extract_tracer(path: DataFrame, spec: GridSpec, field: DataFrame, name: str, zero_is_missing: bool = True) -> DataFrame:
    """``(section_id, dims..., sect, name)``: the mean of the cells on both sides of each face, or the one that is there.

    ``field(yh, xh, ..., name)``; faces with neither cell give no row.  A mean of 0 is missing, unless ``zero_is_missing`` is off.
    """
    dims = [c for c in field.columns if c not in (spec.yh, spec.xh, name)]
    sides = tracer_sides(faces(path, spec), spec).persist()
    out = at_faces(sides, field, (spec.yh, spec.xh), name).groupBy("section_id", *dims, "sect").agg(F.avg("_value").alias(name))
    if zero_is_missing:
        out = out.withColumn(name, F.nullif(F.col(name), F.lit(0.0)))
    return out
