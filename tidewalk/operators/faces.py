"""From a path of corners to the cell faces between them, and what is known of a face."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewalk.plans.grid import GridSpec, geo_columns


def faces(path: DataFrame, spec: GridSpec) -> DataFrame:
    """``(section_id, sect, var, i, j, nward, eward)``: one face less than ``path(section_id, pt, i, j)`` has points.

    A step along a row of corners crosses a V face, any other a U face.  A step of more than one column goes around the grid.
    """
    by = W.partitionBy("section_id").orderBy("pt")
    steps = path.select("section_id", "pt", "i", "j", F.lead("i").over(by).alias("i2"), F.lead("j").over(by).alias("j2")).where("i2 is not null")
    zonal, jump = F.col("j2") == F.col("j"), F.col("i2") - F.col("i")
    eward = F.when(jump > 1, False).when(jump < -1, True).otherwise(jump > 0)
    steps = steps.select("*", zonal.alias("zonal"), eward.alias("eward"), (F.col("j2") > F.col("j")).alias("nward"))
    shift = F.lit(0 if spec.symmetric else 1)
    i = F.when(F.col("zonal") & ~F.col("eward"), F.col("i2")).otherwise(F.col("i")) + F.when(F.col("zonal"), shift).otherwise(0)
    j = F.when(~F.col("zonal") & ~F.col("nward"), F.col("j2")).otherwise(F.col("j")) + F.when(F.col("zonal"), 0).otherwise(shift)
    number = F.row_number().over(by) - 1
    return steps.select("section_id", number.cast("long").alias("sect"), F.when(F.col("zonal"), "V").otherwise("U").alias("var"), i.cast("long").alias("i"), j.cast("long").alias("j"), "nward", "eward")


def sign() -> Column:
    """1 for a face that the path passes southward or eastward, else -1."""
    plus = F.when(F.col("var") == "U", ~F.col("nward")).otherwise(F.col("eward"))
    return F.when(plus, 1).otherwise(-1)


def sampled(found: DataFrame, spec: GridSpec) -> DataFrame:
    """Faces with the index pair ``(fj, fi)`` of the u or v table they are read from."""
    u = F.col("var") == "U"
    return found.withColumn("fi", F.when(u, F.col("i")).otherwise(spec.wrap(F.col("i"), "X")).cast("long")).withColumn("fj", F.when(u, spec.wrap(F.col("j"), "Y")).otherwise(F.col("j")).cast("long"))


def _looked_up(found: DataFrame, table: DataFrame, j: Column, i: Column, index: tuple[str, str], columns: dict[str, str]) -> DataFrame:
    right = table.select(F.col(index[0]).cast("long").alias("_j"), F.col(index[1]).cast("long").alias("_i"), *(F.col(c).cast("double").alias(name) for name, c in columns.items()))
    return found.join(right, (j == F.col("_j")) & (i == F.col("_i")), "left").drop("_j", "_i")


def face_coords(found: DataFrame, spec: GridSpec, corners: DataFrame | None = None, centers: DataFrame | None = None, u: DataFrame | None = None, v: DataFrame | None = None) -> DataFrame:
    """Faces with ``lon`` and ``lat``: those of the u and v tables where given, else a U face has its
    corner's longitude and its centre's latitude, a V face the reverse.  Which it is, is settled from the schemas."""
    at = {"corner": (spec.yq, spec.xq), "center": (spec.yh, spec.xh), "u": (spec.yh, spec.xq), "v": (spec.yq, spec.xh)}
    mixed = corners is not None and centers is not None
    if (u is None or v is None) and not mixed:
        raise ValueError("coordinates of u and v faces, or of corners and centers, are needed")
    held = sampled(found, spec)
    both = spec.wrap(F.col("j"), "Y"), spec.wrap(F.col("i"), "X")
    isu = F.col("var") == "U"
    if u is not None:
        lon, lat = geo_columns(u, at["u"])
        held = _looked_up(held, u, F.when(isu, F.col("fj")), F.when(isu, F.col("fi")), at["u"], {"_ulon": lon, "_ulat": lat})
    if v is not None:
        lon, lat = geo_columns(v, at["v"])
        held = _looked_up(held, v, F.when(~isu, F.col("fj")), F.when(~isu, F.col("fi")), at["v"], {"_vlon": lon, "_vlat": lat})
    if u is None or v is None:
        lon, lat = geo_columns(corners, at["corner"])
        turned = lambda c, n, many, around: F.when(F.col(c) >= many, F.pmod(F.col(c), F.lit(n))).otherwise(F.col(c)) if around else F.col(c)  # noqa: E731  past the last corner comes the first
        held = _looked_up(held, corners, turned("j", spec.ny, spec.corners_y, spec.periodic_y), turned("i", spec.nx, spec.corners_x, spec.periodic_x), at["corner"], {"_qlon": lon, "_qlat": lat})
        lon, lat = geo_columns(centers, at["center"])
        held = _looked_up(held, centers, both[0], both[1], at["center"], {"_hlon": lon, "_hlat": lat})
    ulon, ulat = ("_ulon", "_ulat") if u is not None else ("_qlon", "_hlat")
    vlon, vlat = ("_vlon", "_vlat") if v is not None else ("_hlon", "_qlat")
    return held.select(*found.columns, F.when(isu, F.col(ulon)).otherwise(F.col(vlon)).alias("lon"), F.when(isu, F.col(ulat)).otherwise(F.col(vlat)).alias("lat"))


def path_coords(path: DataFrame, spec: GridSpec, **tables) -> DataFrame:
    """Faces of a path with their coordinates."""
    return face_coords(faces(path, spec), spec, **tables)
