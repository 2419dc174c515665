"""Goldens and invariants of the section operators."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewalk.functions import geo
from tidewalk.operators import diagnostics as dg, faces as fc, orient, path as pt, sampling as sp
from tidewalk.plans.grid import GridSpec, check_symmetric, corner_table, geo_columns
from tidewalk.sources import fields


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("a, b, want", [((0, 0), (1e-20, 0), 0), ((0, 0), (360, 0), 0), ((0, 45), (0, -45), math.pi / 2), ((0, 0), (180, 0), math.pi), ((180, 0), (90, 0), math.pi / 2), ((180, 45), (180, 0), math.pi / 4)])
def test_distance(spark, a, b, want):
    assert abs(value(spark, geo.distance(*a, *b, radius=1.0)) - want) < 1e-14
    for method in ("haversine", "cosines"):
        assert abs(value(spark, geo.distance(*a, *b, radius=1.0, method=method)) - want) < 1e-7


def test_geodesy_edges(spark):
    with pytest.raises(ValueError):
        geo.distance(0, 0, 1, 1, method="flat")
    assert value(spark, geo.distance(float("nan"), 0, 1, 1)) is None
    assert value(spark, geo.angle(0, 0, 0, 0, 0, 0)) is None
    assert abs(value(spark, geo.angle(0, 0, 90, 0, 0, 90)) - math.pi / 2) < 1e-12
    lon, lat = geo.arc_point(0, 0, 90, 0, 0.25)
    assert abs(value(spark, lon) - 22.5) < 1e-9 and abs(value(spark, lat)) < 1e-9
    x, y = geo.stereographic(0, 90)
    assert math.isfinite(value(spark, x)) and abs(value(spark, y)) < 1e-6


@pytest.fixture(scope="module")
def one_degree(spark):
    g = fields.mesh(spark, 161, 360, "yq", "xq").withColumn("lon", F.col("xq").cast("double")).withColumn("lat", F.col("yq") - 80.0)
    return g.cache(), GridSpec(360, 161, symmetric=False)


def test_nearest(spark, one_degree):
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 180.0, 80.0)], "k long, lon double, lat double")
    assert [(r.i, r.j) for r in pt.find_closest(points, *one_degree).orderBy("k").collect()] == [(0, 80), (180, 160)]


def test_paths(spark, one_degree):
    ends = [(0, 0, 80, 179, 80), (1, 0, 0, 0, 160), (2, 0, 0, 100, 100), (3, 0, 0, 50, 100), (4, 10, 10, 100, 50), (5, 7, 7, 7, 7)]
    path = pt.index_section(one_degree[0], spark.createDataFrame(ends, "section_id long, i1 long, j1 long, i2 long, j2 long"), one_degree[1]).cache()
    assert [r["count"] for r in path.groupBy("section_id").count().orderBy("section_id").collect()] == [180, 161, 201, 151, 131, 1]
    for s, i1, j1, i2, j2 in ends:
        points = [(r.i, r.j, r.lon, r.lat) for r in path.where(F.col("section_id") == s).orderBy("pt").collect()]
        assert points[0] == (i1, j1, i1, j1 - 80) and points[-1] == (i2, j2, i2, j2 - 80)
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(points, points[1:]))


def test_path_from_places(spark, one_degree):
    rows = [("e", 0, 0.0, 0.0), ("e", 1, 179.0, 0.0), ("m", 0, 180.0, -80.0), ("m", 1, 180.0, 80.0)]
    path = pt.grid_section(one_degree[0], spark.createDataFrame(rows, "section_id string, k long, lon double, lat double"), one_degree[1])
    assert {r.section_id: r["count"] for r in path.groupBy("section_id").count().collect()} == {"e": 180, "m": 161}


@pytest.fixture(scope="module")
def coarse(spark):
    return fields.mesh(spark, 5, 7, "yq", "xq").withColumn("lon", 60.0 * F.col("xq")).withColumn("lat", 40.0 * F.col("yq") - 80), GridSpec(6, 4)


def walked(spark, grid, places, **how):
    rows = [("s", k, float(x), float(y)) for k, (x, y) in enumerate(places)]
    found = pt.grid_section(grid[0], spark.createDataFrame(rows, "section_id string, k long, lon double, lat double"), grid[1], **how).orderBy("pt").collect()
    return [r.i for r in found], [r.j for r in found]


def test_composites(spark, coarse):
    box = [(0, -80), (120, -80), (120, 0), (0, 0)]
    assert walked(spark, coarse, box) == ([0, 1, 2, 2, 2, 1, 0], [0, 0, 0, 1, 2, 2, 2])
    assert walked(spark, coarse, [*box, box[0]]) == ([0, 1, 2, 2, 2, 1, 0, 0, 0], [0, 0, 0, 1, 2, 2, 2, 1, 0])
    assert walked(spark, coarse, [(300, 0), (60, 0)]) == ([5, 0, 1], [2, 2, 2])
    with pytest.raises(PySparkException):
        walked(spark, coarse, [(0, 0)])


def test_tripolar_fold(spark):
    # beyond the top row lies the row below it, seen backwards
    g = fields.mesh(spark, 7, 13, "yq", "xq").withColumn("lon", 30.0 * F.col("xq")).withColumn("lat", 10.0 * F.col("yq") + 20)
    i, j = walked(spark, (g, GridSpec(12, 6, topology="MOM-tripolar")), [(60, 70), (240, 70)], digits=6)
    assert (i[0], j[0]) == (2, 5) and (i[-1], j[-1]) == (8, 5)
    for a, b in zip(zip(i, j), zip(i[1:], j[1:])):
        side = a[1] == b[1] and (b[0] - a[0]) % 12 in (1, 11)
        up = a[0] == b[0] and abs(a[1] - b[1]) == 1
        fold = a[1] == 6 and b == (11 - a[0], 5)
        assert side or up or fold


def test_cartesian_square(spark):
    spec = GridSpec(1, 1, periodic_x=False, topology="cartesian")
    corners = fields.mesh(spark, 2, 2, "yq", "xq").withColumn("lon", F.col("xq").cast("double")).withColumn("lat", F.col("yq").cast("double"))
    centers = spark.createDataFrame([(0, 0, 0.5, 0.5)], "yh long, xh long, lon double, lat double")
    u = fields.from_arrays(spark, [[1.0, -math.sqrt(2)]], ["yh", "xq"], "umo")
    v = fields.from_arrays(spark, [[0.0], [math.pi]], ["yq", "xh"], "vmo")
    path = spark.createDataFrame([(0, k, i, j, float(i), float(j)) for k, (i, j) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])], "section_id long, pt long, i long, j long, lon double, lat double")
    for positive, sign in ((True, 1), (False, -1)):
        out = sp.convergent_transport(path, spec, u, v, corners, centers, layer=None, geometry="cartesian", positive_in=positive)
        total = dg.totals(out, ["section_id"]).first().total
        assert abs(total - sign * (1 + math.sqrt(2) - math.pi)) < 1e-14
    with pytest.raises(ValueError):
        sp.convergent_transport(path, GridSpec(1, 1), u, v, layer=None, geometry="cartesian")


def test_sign_convention_on_a_sphere(spark):
    spec = GridSpec(3, 2)
    u = fields.from_arrays(spark, [[0.0] * 4] * 2, ["yh", "xq"], "umo")
    v = fields.from_arrays(spark, [[1.0] * 3] * 3, ["yq", "xh"], "vmo")
    for way in ([0, 2, 1, 0], [0, 1, 2, 0]):
        path = spark.createDataFrame([(0, k, i, 1, 120.0 * i, 0.0) for k, i in enumerate(way)], "section_id long, pt long, i long, j long, lon double, lat double")
        assert dg.totals(sp.convergent_transport(path, spec, u, v, layer=None), ["section_id"]).first().total == -3


def random_fields(spark, spec, seed):
    rng = random.Random(seed)
    u = fields.from_arrays(spark, [[rng.uniform(-1, 1) for _ in range(spec.corners_x)] for _ in range(spec.ny)], ["yh", "xq"], "umo")
    v = fields.from_arrays(spark, [[rng.uniform(-1, 1) for _ in range(spec.nx)] for _ in range(spec.corners_y)], ["yq", "xh"], "vmo")
    return u, v


def test_closed_section_equals_divergence_inside(spark):
    spec = GridSpec(8, 6, periodic_x=False)
    corners = fields.mesh(spark, 7, 9, "yq", "xq").withColumn("lon", 10.0 * F.col("xq")).withColumn("lat", 10.0 * F.col("yq") - 30)
    u, v = random_fields(spark, spec, 1)
    ring = [(1, 1), (5, 1), (5, 4), (1, 4), (1, 1)]
    points = [ring[0]]
    for (i, j), (i2, j2) in zip(ring, ring[1:]):
        while (i, j) != (i2, j2):
            i, j = i + (i2 > i) - (i2 < i), j + (j2 > j) - (j2 < j)
            points.append((i, j))
    got = []
    for way in (points, points[::-1]):
        path = spark.createDataFrame([(0, k, i, j, 10.0 * i, 10.0 * j - 30) for k, (i, j) in enumerate(way)], "section_id long, pt long, i long, j long, lon double, lat double")
        got.append(dg.totals(sp.convergent_transport(path, spec, u, v, layer=None), ["section_id"]).first().total)
    mask = fields.mesh(spark, 6, 8, "yh", "xh").withColumn("inside", F.col("xh").between(1, 4) & F.col("yh").between(1, 3))
    got.append(dg.mask_transport(mask, spec, u, v).first().total)
    out = sp.convergent_transport(path, spec, u, v, layer=None, positive_in=mask)
    got.append(dg.totals(out, ["section_id"]).first().total)
    uu = {(r.yh, r.xq): r.umo for r in u.collect()}
    vv = {(r.yq, r.xh): r.vmo for r in v.collect()}
    want = sum(uu[j, i] - uu[j, i + 1] + vv[j, i] - vv[j + 1, i] for i in range(1, 5) for j in range(1, 4))
    assert all(abs(x - want) < 1e-12 for x in got)


def test_faces_of_an_unsymmetric_grid(spark):
    rows = [(0, k, i, j) for k, (i, j) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])]
    path = spark.createDataFrame(rows, "section_id long, pt long, i long, j long")
    got = [(r["var"], r.i, r.j, r.nward, r.eward) for r in fc.faces(path, GridSpec(4, 4, symmetric=False)).orderBy("sect").collect()]
    assert got == [("V", 1, 0, False, True), ("U", 1, 1, True, False), ("V", 1, 1, False, False), ("U", 0, 1, False, False)]


def test_missing_values_and_tracers(spark):
    spec = GridSpec(4, 2, periodic_x=False)
    nan = float("nan")
    field = fields.from_arrays(spark, [[1.0, 3.0, nan, 5.0], [2.0, -2.0, 7.0, nan]], ["yh", "xh"], "t")
    field = field.withColumn("t", F.coalesce("t", F.lit(nan)))
    path = spark.createDataFrame([(0, k, i, 1) for k, i in enumerate([0, 1, 2, 3, 4])] + [(1, 0, 1, 1), (1, 1, 1, 2)], "section_id long, pt long, i long, j long")
    got = {(r.section_id, r.sect): r.t for r in sp.extract_tracer(path, spec, field, "t").collect()}
    assert got == {(0, 0): 1.5, (0, 1): 0.5, (0, 2): 7.0, (0, 3): 5.0, (1, 0): None}
    assert sp.extract_tracer(path, spec, field, "t", zero_is_missing=False).where("section_id = 1").first().t == 0.0


def test_layer_names_and_dimensions_are_checked(spark, coarse):
    u, v = random_fields(spark, coarse[1], 3)
    path = spark.createDataFrame([(0, 0, 0, 0, 0.0, 0.0), (0, 1, 1, 0, 60.0, 0.0)], "section_id long, pt long, i long, j long, lon double, lat double")
    with pytest.raises(ValueError):
        sp.convergent_transport(path, coarse[1], u, v, layer="z_l", interface="rho_i")
    with pytest.raises(ValueError):
        sp.convergent_transport(path, coarse[1], u.withColumn("time", F.lit(1)), v)
    with pytest.raises(ValueError):
        orient.counterclockwise(path, "flat")
    with pytest.raises(ValueError):
        fc.face_coords(fc.faces(path, coarse[1]), coarse[1])


def test_grid_metadata(spark):
    assert check_symmetric({"outer": "a"}, {"outer": "b"}) and not check_symmetric({"right": "a"}, {"right": "b"})
    with pytest.raises(ValueError):
        check_symmetric({"outer": "a"}, {"right": "b"})
    spec = GridSpec.from_positions(3, 2, {"center": "x", "outer": "xo"}, {"center": "y", "outer": "yo"}, {"X": "periodic"})
    assert spec.coords() == {"X": {"center": "x", "corner": "xo"}, "Y": {"center": "y", "corner": "yo"}} and spec.walk_x == 3 and spec.corners_x == 4
    df = spark.createDataFrame([(0, 0, float("nan"), 1.0)], "yo long, xo long, geolon_c double, geolat_c double")
    assert geo_columns(df, ("yo", "xo")) == ("geolon_c", "geolat_c") and corner_table(df, spec).first().lon is None
    with pytest.raises(ValueError):
        geo_columns(df.drop("geolat_c"), ("yo", "xo"))
    with pytest.raises(ValueError):
        GridSpec(1, 1, topology="cube")


def test_fields_round_trip(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 2).alias("time"), F.floor(F.col("id") / 10).alias("yh"), (F.col("id") % 10).alias("xh"), F.col("id").cast("double").alias("t"))
    fields.write_fields(df, f"file://{tmp_path}/t", "yh")
    back = fields.read_fields(spark, f"file://{tmp_path}/t", "*.parquet", ["yh", "xh", "t"])
    assert sorted(back.collect()) == sorted(df.select("yh", "xh", "t").collect())


def test_streamed_totals(spark, tmp_path):
    from tidewalk.streaming.transports import stream_totals, stream_transports

    faces = spark.createDataFrame([("s", 0, 1, 1, 1), ("s", 1, 2, 1, -1)], "section_id string, sect long, fj long, fi long, sign int")
    rows = [(f"2020-01-0{1 + d} 00:00:00", j, 1, float(d + j)) for d in range(4) for j in range(3)]
    df = spark.createDataFrame(rows, "t string, yh long, xq long, umo double").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    out = stream_totals(stream_transports(stream, faces, ("yh", "xq"), "umo"), "t", "1 day", "1 hour")
    query = out.writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.total for r in spark.table("totals").orderBy("window").collect()] == [-1.0] * 4


def test_reverse_close_and_compare(spark, coarse):
    rows = [("o", 0, 0.0, -80.0), ("o", 1, 120.0, -80.0), ("o", 2, 120.0, 0.0), ("c", 0, 0.0, 0.0), ("c", 1, 60.0, 0.0), ("c", 2, 0.0, 0.0)]
    vertices = spark.createDataFrame(rows, "section_id string, k long, lon double, lat double")
    assert sorted(map(tuple, pt.close(vertices).collect())) == sorted([*rows, ("o", 3, 0.0, -80.0)])
    path = pt.grid_section(coarse[0], vertices, coarse[1])
    back = {(r.section_id, r.pt): (r.i, r.j) for r in pt.reverse(path).collect()}
    last = {r.section_id: r.n for r in path.groupBy("section_id").agg(F.max("pt").alias("n")).collect()}
    assert all(back[r.section_id, last[r.section_id] - r.pt] == (r.i, r.j) for r in path.collect())
    assert pt.differences(path, path.withColumn("lon", F.col("lon") - 360 + 1e-9)).count() == 0
    assert pt.differences(path, path.withColumn("lon", F.col("lon") + F.when(F.col("pt") == 1, 1e-3).otherwise(0))).count() == 2
    assert pt.differences(path, path.where("pt > 0")).count() == 2


def test_unknown_insides_are_errors(spark):
    spec = GridSpec(3, 2)
    u = fields.from_arrays(spark, [[0.0] * 4] * 2, ["yh", "xq"], "umo")
    v = fields.from_arrays(spark, [[1.0] * 3] * 3, ["yq", "xh"], "vmo")
    path = spark.createDataFrame([(0, k, i, 1, 120.0 * i, 0.0) for k, i in enumerate([0, 1, 2, 0])], "section_id long, pt long, i long, j long, lon double, lat double")
    mask = spark.createDataFrame([(0, 1, True)], "yh long, xh long, inside boolean")
    with pytest.raises(PySparkException):
        sp.convergent_transport(path, spec, u, v, layer=None, positive_in=mask).collect()
    with pytest.raises(PySparkException):
        sp.convergent_transport(path.withColumn("lon", F.lit(float("nan"))), spec, u, v, layer=None).collect()


def test_layers(spark):
    layers = dg.layer_table(spark, [1, 2], [0, 10, 30])
    got = dg.with_layers(spark.createDataFrame([(1, 5.0), (2, 6.0), (9, 7.0)], "z_l long, t double"), layers).orderBy("z_l").collect()
    assert [(r.top, r.bottom, r.thickness) for r in got] == [(0, 10, 10), (10, 30, 20), (None, None, None)]
    with pytest.raises(ValueError):
        dg.layer_table(spark, [1], [0])


def test_tiles_give_the_same_paths(spark, one_degree, monkeypatch):
    """Nearest corners and walks over tiles equal those over the grid's one row; legs that leave their tiles walk again."""
    grid = fields.mesh(spark, 40, 72, "yq", "xq").withColumn("lon", 5.0 * F.col("xq") + 0.01 * F.col("yq")).withColumn("lat", 4.0 * F.col("yq") - 78 + 0.02 * F.col("xq"))
    gaps = grid.withColumn("lon", F.when((F.col("xq") == 20) & F.col("yq").between(5, 30), F.lit(float("nan"))).otherwise(F.col("lon"))).where("not (xq > 60 and yq < 6)")
    rows = [("a", 0, 3.0, -60.0), ("a", 1, 80.0, 10.0), ("a", 2, 81.0, 11.0), ("b", 0, 350.0, 40.0), ("b", 1, 12.0, 52.0), ("c", 0, 33.0, 60.0), ("c", 1, 200.0, 66.0)]
    vertices = spark.createDataFrame(rows, "section_id string, k long, lon double, lat double")
    points = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 37 % 360).cast("double").alias("lon"), (F.col("id") * 17 % 160 - 80).cast("double").alias("lat"))
    one, around = vertices.where("section_id <> 'b'"), vertices
    cases = [(grid, GridSpec(72, 40, symmetric=False), around, ((-0.4, 0.1, None),)), (gaps, GridSpec(72, 40, symmetric=False, periodic_x=False), one, ((-0.4, None),))]
    for table, spec, places, some in cases:
        want = sorted(map(tuple, pt.find_closest(points, table, spec).collect()))
        path = sorted(map(tuple, pt.grid_section(table, places, spec, 6).collect()))
        with monkeypatch.context() as m:
            m.setattr(pt, "IN_A_ROW", 0)
            m.setattr(pt, "TILE", 7)
            assert sorted(map(tuple, pt.find_closest(points, table, spec).collect())) == want
            for margins in some:
                m.setattr(pt, "MARGINS", margins)
                assert sorted(map(tuple, pt.grid_section(table, places, spec, 6).collect())) == path
