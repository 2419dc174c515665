"""The registered queries over the grid tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewalk.functions import geo
from tidewalk.operators import diagnostics as dg, faces as fc, orient, path as pt, sampling as sp
from tidewalk.plans.grid import GridSpec
from tidewalk.salesgrid import SalesGrid
from tidewalk.sources.fields import mesh, slice_from, split_supergrid

#: Vertices of the sections that the queries follow, on corners of the test grid.
SECTIONS = {
    "box": [(30, -40), (120, -40), (120, 20), (30, 20), (30, -40)],
    "open": [(15, -30), (150, 10)],
    "seam": [(300, 0), (60, 0)],
}
#: On corners of a grid of 2.5 by 2 degrees, and across the fold of a tripolar one.
REGIONAL_SECTIONS = {"box": [(205, -6), (240, -6), (240, 14), (205, 14), (205, -6)], "edge": [(200, -10), (260, 22)], "back": [(250, 10), (210, -8)]}
FAR_SECTIONS = {"fold": [(60, 60), (225, 60)], "side": [(30, 0), (150, 50)]}
LATITUDES = range(-60, 70, 10)
DIGITS = 6


def vertices(spark: SparkSession, *names: str, sections: dict = SECTIONS) -> DataFrame:
    rows = [(n, k, float(x), float(y)) for n in names or sections for k, (x, y) in enumerate(sections[n])]
    return spark.createDataFrame(rows, "section_id string, k long, lon double, lat double")


def section(g: SalesGrid, *names: str) -> DataFrame:
    return pt.grid_section(g.corners, vertices(g.spark, *names), g.spec, DIGITS)


def _points(g: SalesGrid) -> DataFrame:
    """Pairs of places from the customers."""
    c = g.spark.read.parquet(f"{g.sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    at = lambda m, n, o: (F.pmod(F.col("k") * m, F.lit(n)) + o).cast("double")
    return c.select("k", at(37, 360, 0).alias("lon1"), at(17, 161, -80).alias("lat1"), at(91, 360, 0).alias("lon2"), at(53, 161, -80).alias("lat2"), at(11, 360, 0).alias("lon3"), at(29, 161, -80).alias("lat3"))


def q_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(SalesGrid(spark, sf_dir))
    return p.select("k", *(F.round(geo.distance("lon1", "lat1", "lon2", "lat2", method=m) / 1000, 2).alias(m) for m in geo.METHODS))


def q_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(SalesGrid(spark, sf_dir))
    return p.select("k", F.round(geo.angle("lon1", "lat1", "lon2", "lat2", "lon3", "lat3"), 5).alias("angle"))


def q_stereographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.stereographic("lon1", "lat1")
    return _points(SalesGrid(spark, sf_dir)).select("k", F.round(x, 7).alias("x"), F.round(y, 7).alias("y"))


def q_arc_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pt.arc_path_range(_points(SalesGrid(spark, sf_dir)).select("k", "lon1", "lat1", "lon2", "lat2"), 5)
    return p.select("k", "r", (F.round("lon", 6) + 0.0).alias("lon"), (F.round("lat", 6) + 0.0).alias("lat"))


def q_nearest_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    p = _points(g).select("k", (F.col("lon1") + 0.25).alias("lon"), (F.col("lat1") + 0.25).alias("lat"))
    return pt.find_closest(p, g.corners, g.spec).select("k", "i", "j")


def q_grid_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section(SalesGrid(spark, sf_dir))


def q_index_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    ends = spark.createDataFrame([("a", 1, 5, 10, 9), ("b", 20, 8, 3, 12)], "section_id string, i1 long, j1 long, i2 long, j2 long")
    return pt.index_section(g.corners, ends, g.spec, DIGITS)


def q_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    return fc.faces(section(g), g.spec)


def q_face_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    return fc.path_coords(section(g), g.spec, corners=g.corners, centers=g.centers)


def q_path_without_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    return pt.grid_section(g.corners, vertices(spark, "open"), g.spec)


def _other(spark: SparkSession, sf_dir: str, kind: str) -> tuple[SalesGrid, DataFrame]:
    """Another grid and the paths on it."""
    specs = {"unsymmetric": GridSpec(24, 16, symmetric=False), "regional": GridSpec(24, 16, periodic_x=False), "tripolar": GridSpec(24, 16, topology="MOM-tripolar")}
    places = {"unsymmetric": (15.0, 15.0, -70.0, 10.0), "regional": (200.0, 2.5, -10.0, 2.0)}
    sections = {"unsymmetric": SECTIONS, "regional": REGIONAL_SECTIONS, "tripolar": FAR_SECTIONS}
    g = SalesGrid(spark, sf_dir, specs[kind], *places.get(kind, ()))
    return g, pt.grid_section(g.corners, vertices(spark, sections=sections[kind]), g.spec, DIGITS)


def _other_coords(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    g, path = _other(spark, sf_dir, kind)
    return fc.path_coords(path, g.spec, corners=g.corners, centers=g.centers)


def _other_transport(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    g, path = _other(spark, sf_dir, kind)
    return sp.convergent_transport(path, g.spec, g.umo, g.vmo, g.corners, g.centers)


def q_unsymmetric_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _other_coords(spark, sf_dir, "unsymmetric")


def q_unsymmetric_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _other_transport(spark, sf_dir, "unsymmetric")


def q_unsymmetric_tracer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, path = _other(spark, sf_dir, "unsymmetric")
    return sp.extract_tracer(path, g.spec, g.thetao, "thetao")


def q_regional_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _other_coords(spark, sf_dir, "regional")


def q_regional_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _other_transport(spark, sf_dir, "regional")


def q_tripolar_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _other(spark, sf_dir, "tripolar")[1]


def q_native_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces with the coordinates of the u and v tables themselves."""
    g = SalesGrid(spark, sf_dir)
    at = lambda j, i, names, lon, lat: mesh(spark, j, i, *names).withColumn("geolon", 15.0 * F.col(names[1]) + lon).withColumn("geolat", 10.0 * F.col(names[0]) + lat)
    return fc.path_coords(section(g), g.spec, u=at(16, 25, ("yh", "xq"), 0.25, -74.5), v=at(17, 24, ("yq", "xh"), 7.75, -79.5))


def _with_gaps(field: DataFrame, j: str, i: str, name: str) -> DataFrame:
    """NaN in every cell whose indices add up to a multiple of five."""
    return field.withColumn(name, F.when((F.col(j) + F.col(i)) % 5 == 0, F.lit(float("nan"))).otherwise(F.col(name).cast("double")))


def q_missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    out = sp.convergent_transport(section(g), g.spec, _with_gaps(g.umo, "yh", "xq", "umo"), _with_gaps(g.vmo, "yq", "xh", "vmo"), g.corners, g.centers)
    return out.select("section_id", "time", "z_l", "sect", "dir", (F.col("conv_mass_transport") + 0.0).alias("conv_mass_transport"))


def q_missing_tracer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    return sp.extract_tracer(section(g), g.spec, _with_gaps(g.thetao, "yh", "xh", "thetao"), "thetao")


def q_reverse_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.reverse(section(SalesGrid(spark, sf_dir)))


def q_closed_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    return pt.grid_section(g.corners, pt.close(vertices(spark)), g.spec, DIGITS)


def q_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    return spark.range(-3, 30).select(F.col("id").alias("idx"), g.spec.wrap(F.col("id"), "X").cast("long").alias("x"), g.spec.wrap(F.col("id"), "Y").cast("long").alias("y"))


def q_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orient.counterclockwise(section(SalesGrid(spark, sf_dir)))


def q_mask_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    return orient.mask_inside(g.mask(F.col("lat") < 0), fc.faces(section(g), g.spec), g.spec)


def _transport(spark: SparkSession, sf_dir: str, *names: str, **how) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    return sp.convergent_transport(section(g, *names), g.spec, g.umo, g.vmo, g.corners, g.centers, **how)


def q_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transport(spark, sf_dir)


def q_transport_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    out = _transport(spark, sf_dir, "box", dense=True, widths=g.widths)
    return out.withColumn("dl", F.round("dl", 3)).withColumn("distance", F.round("distance", 3))


def q_transport_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    mask = g.mask(F.col("lon").between(30, 120) & F.col("lat").between(-40, 20))
    return dg.totals(_transport(spark, sf_dir, "box", positive_in=mask), ["time", "z_l", "orient_fact"])


def q_transport_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dg.totals(_transport(spark, sf_dir), ["section_id", "time", "z_l"])


def q_time_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _transport(spark, sf_dir).select("section_id", "time", "z_l", "sect", "conv_mass_transport")
    return dg.time_mean(held, "conv_mass_transport", out="mean").withColumn("mean", F.round("mean", 9))


def q_cumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dg.cumulated(_transport(spark, sf_dir, dense=True))


def q_overturning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dg.overturning(_transport(spark, sf_dir))


def q_tracer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    return sp.extract_tracer(section(g), g.spec, g.thetao, "thetao")


def q_tracer_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    return sp.extract_tracer(section(g), g.spec, g.umo.withColumnRenamed("xq", "xh"), "umo")


def q_latitude_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overturning at many latitudes as one job: around the globe along each, in steps of 60 degrees."""
    g = SalesGrid(spark, sf_dir)
    lats = spark.range(len(LATITUDES)).select((F.col("id") * LATITUDES.step + LATITUDES.start).cast("string").alias("section_id"), (F.col("id") * LATITUDES.step + LATITUDES.start).cast("double").alias("lat"))
    around = lats.select("section_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("k"), "lat").select("section_id", "k", (15.0 * F.col("k")).alias("lon"), "lat")
    held = sp.convergent_transport(pt.grid_section(g.corners, around, g.spec, DIGITS), g.spec, g.umo, g.vmo)
    return dg.time_mean(dg.overturning(held), "psi", out="psi_mean").withColumn("psi_mean", F.round("psi_mean", 9))


def q_meridional_overturning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along the grid's own rows, no section needed."""
    g = SalesGrid(spark, sf_dir)
    rows = slice_from(g.vmo, "yq", 1)
    return dg.overturning(rows, "vmo", others=("time", "yq"))


def q_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transports per layer with the depths of its interfaces."""
    edges = [0.0, 10.0, 25.0, 50.0, 100.0, 250.0, 600.0, 1500.0]
    layers = dg.layer_table(spark, [float(n) for n in range(1, 8)], edges)
    return dg.with_layers(dg.totals(_transport(spark, sf_dir), ["section_id", "z_l"]), layers)


def q_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sections and the same ones walked backwards part; both ways round the globe count as one longitude."""
    path = section(SalesGrid(spark, sf_dir))
    return pt.differences(path, pt.reverse(path).withColumn("lon", F.col("lon") + 360))


def q_boundary_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    return dg.boundary_faces(g.mask(F.col("lat") < 0), g.spec)


def q_mask_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = SalesGrid(spark, sf_dir)
    return dg.mask_transport(g.mask(F.col("lon").between(30, 120) & F.col("lat").between(-40, 20)), g.spec, g.umo, g.vmo)


def q_supergrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = mesh(spark, 9, 13, "j", "i").withColumn("lon", 2.5 * F.col("i")).withColumn("lat", 5.0 * F.col("j") - 20)
    parts = [split_supergrid(whole, p, out=("y", "x")).select(F.lit(p).alias("position"), "y", "x", "lon", "lat") for p in ("corner", "u", "v", "center")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("q_")}
