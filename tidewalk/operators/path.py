"""Sections on a grid: from a list of vertices to a connected path of cell corners.

A path follows the great circle between two vertices from corner to corner.  Each step looks at the four
neighbours (right, left, down, up), keeps those nearer to the end, and takes the one that deviates least from
the arc, by the mean of the angles at both ends.  If none is nearer, or that would be a step back, it takes the neighbour that
is nearest to the end, other than the one it came from.

The whole walk of a segment is one native fold over an array state, so any number of segments is one narrow job:
segments are rows, and the grid's coordinates are one row of two arrays that every task gets.

A grid of more than IN_A_ROW corners is cut into tiles instead.  Each has a centre and a radius, so the nearest corner is looked for only in
tiles that can hold it, and a segment carries only the tiles near its arc; one that steps out of them walks again with more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewalk.functions.geo import EARTH_RADIUS, arc, arc_point, corner_angle, distance, let
from tidewalk.plans.grid import GridSpec, corner_table

#: Corners in the one row of arrays: 64 MB.  A larger grid is cut into tiles.
IN_A_ROW = 4_000_000
TILE = 64  # rows and columns of corners
#: How far from the arc tiles are taken, in radii of the largest tile; after that all are.
MARGINS = (1.0, 6.0, None)


def grid_row(corners: DataFrame, spec: GridSpec) -> DataFrame:
    """One row ``(glon, glat)``: coordinates row by row, null where there are none."""
    n = spec.walk_x * spec.corners_y
    cells = corner_table(corners, spec).where((F.col("i") < spec.walk_x) & (F.col("j") < spec.corners_y)).withColumn("k", F.col("j") * spec.walk_x + F.col("i"))
    held = cells.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.struct("lon", "lat").alias("p"))))).alias("m"), F.count(F.lit(1)).alias("n"))
    # a whole grid is sorted already; a grid with gaps is filled up
    whole = F.map_values("m")
    gaps = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda k: F.col("m")[k])
    held = held.select(F.when(F.col("n") == n, whole).otherwise(gaps).alias("p"))
    return held.select(F.col("p")["lon"].alias("glon"), F.col("p")["lat"].alias("glat"))


def nearest_corner(lon: Column, lat: Column, nx: int) -> Column:
    """``(j, i)`` of the corner of the row's grid nearest to a point; row by row, the first of equals."""
    all_of = F.transform("glon", lambda x, k: F.struct(distance(lon, lat, x, F.col("glat")[k]).alias("d"), k.cast("long").alias("k")))
    best = F.array_min(F.filter(all_of, lambda c: c.d.isNotNull()))
    return let(best.k, lambda k: F.struct(F.floor(k / nx).alias("j"), F.pmod(k, F.lit(nx)).alias("i")))


def snapped(vertices: DataFrame, corners: DataFrame, spec: GridSpec) -> DataFrame:
    """``vertices(section_id, k, lon, lat)`` with ``i`` and ``j`` of the nearest corner; each place is searched for once."""
    places = vertices.select("lon", "lat").distinct()
    return vertices.join(find_closest(places, corners, spec), ["lon", "lat"])


def reverse(path: DataFrame) -> DataFrame:
    """``path(section_id, pt, ...)`` the other way round: points are numbered from the other end."""
    last = F.max("pt").over(W.partitionBy("section_id"))
    return path.withColumn("pt", last - F.col("pt"))


def close(vertices: DataFrame) -> DataFrame:
    """``vertices(section_id, k, lon, lat)`` with each section's first vertex once more at its end, unless it ends there."""
    whole = W.partitionBy("section_id")
    at = lambda f, c: f(F.col(c), F.col("k")).over(whole)
    held = vertices.select("section_id", "k", "lon", "lat", F.max("k").over(whole).alias("_last"), F.min("k").over(whole).alias("_first"), at(F.max_by, "lon").alias("_lon"), at(F.max_by, "lat").alias("_lat"))
    again = held.where((F.col("k") == F.col("_first")) & (F.col("_last") > F.col("_first")) & ((F.col("lon") != F.col("_lon")) | (F.col("lat") != F.col("_lat"))))
    return vertices.select("section_id", "k", "lon", "lat").unionByName(again.select("section_id", (F.col("_last") + 1).alias("k"), "lon", "lat"))


def differences(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Points ``(section_id, pt)`` where two paths differ: one has no such point, another corner, or a place further off than ``tolerance`` degrees.

    Longitudes a whole turn apart are one.
    """
    turn = lambda x, y: F.abs(F.pmod(x - y + 180.0, F.lit(360.0)) - 180.0)
    held = a.alias("a").join(b.alias("b"), ["section_id", "pt"], "full")
    c = lambda n: (F.col(f"a.{n}"), F.col(f"b.{n}"))
    same = (c("i")[0] == c("i")[1]) & (c("j")[0] == c("j")[1]) & (turn(*c("lon")) <= tolerance) & (F.abs(c("lat")[0] - c("lat")[1]) <= tolerance)
    return held.where(~F.coalesce(same, F.lit(False))).select("section_id", "pt")


def in_tiles(spec: GridSpec) -> bool:
    return spec.walk_x * spec.corners_y > IN_A_ROW


def _tile(j: Column, i: Column, spec: GridSpec) -> tuple[Column, Column]:
    """The tile of a corner, and the corner's place in it."""
    across = -(-spec.walk_x // TILE)
    tj, ti = F.floor(j / TILE), F.floor(i / TILE)
    wide = F.least(F.lit(TILE), F.lit(spec.walk_x) - ti * TILE)
    return tj * across + ti, ((j - tj * TILE) * wide + (i - ti * TILE)).cast("int")


def tile_table(corners: DataFrame, spec: GridSpec) -> DataFrame:
    """``(tile, lon, lat, clon, clat, radius)``: coordinates of a tile's corners row by row, null where there are none, a centre and how far corners are from it."""
    tile, at = _tile(F.col("j"), F.col("i"), spec)
    cells = corner_table(corners, spec).where((F.col("i") < spec.walk_x) & (F.col("j") < spec.corners_y)).select(tile.alias("tile"), at.alias("at"), "lon", "lat")
    held = cells.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("at", "lon", "lat"))).alias("c"), F.max("at").alias("top"))
    gaps = let(F.map_from_entries(F.transform("c", lambda x: F.struct(x["at"], F.struct(x.lon.alias("lon"), x.lat.alias("lat"))))), lambda m: F.transform(F.sequence(F.lit(0), F.col("top")), lambda k: m[k]))
    whole = F.transform("c", lambda x: F.struct(x.lon.alias("lon"), x.lat.alias("lat")))
    held = held.withColumn("p", F.when(F.size("c") == F.col("top") + 1, whole).otherwise(gaps))
    there = F.filter("p", lambda x: x.lon.isNotNull() & x.lat.isNotNull())
    held = held.withColumn("there", there).withColumn("centre", F.try_element_at("there", (F.floor(F.size("there") / 2) + 1).cast("int")))
    far = F.array_max(F.transform("there", lambda x: arc(x.lon, x.lat, F.col("centre.lon"), F.col("centre.lat"))))
    return held.select("tile", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), F.col("centre.lon").alias("clon"), F.col("centre.lat").alias("clat"), far.alias("radius"))


def _closest_in_tiles(points: DataFrame, tiles: DataFrame, spec: GridSpec, lon: str, lat: str) -> DataFrame:
    """As ``find_closest``: tiles are left out whose centre is further, by more than their radius, than the nearest tile's furthest corner."""
    held = points.withColumn("_id", F.monotonically_increasing_id()).persist()
    about = tiles.where("radius is not null").select("tile", "clon", "clat", "radius")  # a row for 4,096 corners
    far = held.select("_id", F.col(lon).alias("_x"), F.col(lat).alias("_y")).crossJoin(F.broadcast(about)).withColumn("_d", arc("_x", "_y", "clon", "clat"))
    least = far.groupBy("_id").agg(F.min(F.col("_d") + F.col("radius")).alias("_most"))
    some = far.join(F.broadcast(least), "_id").where(F.col("_d") - F.col("radius") <= F.col("_most") + 1e-12).select("_id", "_x", "_y", "tile")
    across = -(-spec.walk_x // TILE)
    wide = F.least(F.lit(TILE), F.lit(spec.walk_x) - F.pmod("tile", F.lit(across)) * TILE)
    number = lambda k: (F.floor(F.col("tile") / across) * TILE + F.floor(k / wide)) * spec.walk_x + F.pmod("tile", F.lit(across)) * TILE + F.pmod(k, wide)
    each = F.transform("lon", lambda x, k: F.struct(distance("_x", "_y", x, F.col("lat")[k]).alias("d"), number(k).cast("long").alias("k")))
    best = some.join(tiles.select("tile", "lon", "lat"), "tile").select("_id", F.array_min(F.filter(each, lambda c: c.d.isNotNull())).alias("b")).groupBy("_id").agg(F.min("b").alias("b"))
    i, j = F.pmod(F.col("b.k"), F.lit(spec.walk_x)), F.floor(F.col("b.k") / spec.walk_x)
    return held.join(best, "_id", "left").select(*points.columns, i.alias("i"), j.alias("j"))


def find_closest(points: DataFrame, corners: DataFrame, spec: GridSpec, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``points`` with ``i`` and ``j`` of the nearest corner; of several the first, row by row."""
    if in_tiles(spec):
        return _closest_in_tiles(points, tile_table(corners, spec).persist(), spec, lon, lat)
    held = points.crossJoin(grid_row(corners, spec))
    return held.withColumn("_c", nearest_corner(F.col(lon), F.col(lat), spec.walk_x)).select(*points.columns, F.col("_c.i").alias("i"), F.col("_c.j").alias("j"))


def segments(vertices: DataFrame, *columns: str) -> DataFrame:
    """``(section_id, k, last)`` and each of ``columns`` as ``c1`` and ``c2``: each vertex with the next one of its section ``vertices(section_id, k, ...)``."""
    by = W.partitionBy("section_id").orderBy("k")
    pairs = [x for c in columns for x in (F.col(c).alias(f"{c}1"), F.lead(c).over(by).alias(f"{c}2"))]
    out = vertices.select("section_id", "k", *pairs, F.lead("k", 2).over(by).isNull().alias("last"), F.lead("k").over(by).isNull().alias("_end"), F.lag("k").over(by).isNull().alias("_only"))
    lone = F.when(F.col("_end") & F.col("_only"), F.raise_error(F.lit("a section has two vertices at least")))
    return out.where(F.coalesce(lone.cast("boolean"), ~F.col("_end"))).drop("_end", "_only")


def _neighbours(s: Column, spec: GridSpec) -> list[Column]:
    nx, ny = spec.walk_x, spec.corners_y
    side = (lambda x: F.pmod(x, F.lit(nx).cast("long"))) if spec.periodic_x else (lambda x: F.greatest(F.lit(0).cast("long"), F.least(F.lit(nx - 1).cast("long"), x)))
    up_j, up_i = F.least(s.j + 1, F.lit(ny - 1).cast("long")), s.i
    if spec.topology == "MOM-tripolar":  # the top row is folded: over it lies the row below, seen backwards
        fold = s.j == ny - 1
        up_j, up_i = F.when(fold, s.j - 1).otherwise(s.j + 1), F.when(fold, (nx - 1) - F.pmod(s.i, F.lit(nx))).otherwise(F.pmod(s.i, F.lit(nx)))
    at = [(s.j, side(s.i + 1)), (s.j, side(s.i - 1)), (F.greatest(s.j - 1, F.lit(0).cast("long")), s.i), (up_j, up_i)]
    return [F.struct(F.lit(n).alias("o"), j.cast("long").alias("j"), i.cast("long").alias("i")) for n, (j, i) in enumerate(at)]


class _Row:
    """Coordinates from the grid's one row."""

    def __init__(self, spec: GridSpec):
        self.nx = spec.walk_x

    def __call__(self, c: str, j: Column, i: Column) -> Column:
        return F.col(f"g{c}")[(j * self.nx + i).cast("int")]

    def there(self, j: Column, i: Column) -> Column:
        return F.lit(True)


class _Tiles:
    """Coordinates from the tiles that a leg has."""

    def __init__(self, spec: GridSpec):
        self.spec = spec

    def __call__(self, c: str, j: Column, i: Column) -> Column:
        tile, at = _tile(j, i, self.spec)
        return F.col("tiles")[tile][c][at]

    def there(self, j: Column, i: Column) -> Column:
        return F.col("tiles")[_tile(j, i, self.spec)[0]].isNotNull()


def _ends(legs: DataFrame, place) -> DataFrame:
    """Legs with the coordinates of both ends and the arc between them, which every step needs."""
    at = {f"_{c}{n}": place(c, F.col(f"j{n}"), F.col(f"i{n}")) for c in ("lon", "lat") for n in (1, 2)}
    return legs.withColumns(at).withColumn("_whole", arc("_lon1", "_lat1", "_lon2", "_lat2"))


def walk(spec: GridSpec, digits: int | None, place) -> Column:
    """Path from corner (j1, i1) to (j2, i2) of a leg as an array of (j, i), both ends included, over the coordinates that ``place`` gives.

    ``digits`` rounds the angles that are compared, so that equal ones are equal on any machine.  A leg that comes to a corner whose coordinates it hasn't got
    has a null path.
    """
    nx, ny = spec.walk_x, spec.corners_y
    i1, j1, i2, j2, whole = (F.col(c) for c in ("i1", "j1", "i2", "j2", "_whole"))
    lon, lat = (lambda j, i: place("lon", j, i)), (lambda j, i: place("lat", j, i))
    to_end = lambda j, i: arc(lon(j, i), lat(j, i), "_lon2", "_lat2")
    to_start = lambda j, i: arc(lon(j, i), lat(j, i), "_lon1", "_lat1")

    def deviation(c):
        mean = (corner_angle(c.e, c.d, whole) + corner_angle(c.d, c.e, whole)) / 2
        return F.when(c.d == 0, F.lit(-1.0)).otherwise(mean if digits is None else F.round(mean, digits))

    def step(s, _):
        around = F.transform(F.array(*_neighbours(s, spec)), lambda c: F.struct(c.o.alias("o"), c.j.alias("j"), c.i.alias("i"), to_end(c.j, c.i).alias("d"), to_start(c.j, c.i).alias("e"), place.there(c.j, c.i).alias("t")))

        def go(near, here):
            back = lambda c: (c.j == s.pj) & (c.i == s.pi)
            closer = F.transform(F.filter(near, lambda c: c.d < here), lambda c: F.struct(deviation(c).alias("a"), c.o.alias("o"), c.j.alias("j"), c.i.alias("i")))
            best = F.array_min(F.filter(closer, lambda c: c.a.isNotNull()))
            came = F.array_min(F.transform(F.filter(near, back), lambda c: c.o))  # of several the first
            rest = F.filter(near, lambda c: c.d.isNotNull() & (came.isNull() | (c.o != came)))
            other = F.array_min(F.transform(rest, lambda c: F.struct(c.d.alias("a"), c.o.alias("o"), c.j.alias("j"), c.i.alias("i"))))
            return let(best, lambda b: F.when(b.isNull() | back(b), other).otherwise(b))

        def move(c):
            done = (F.pmod(c.i, F.lit(nx)) == i2) & (c.j == j2)
            return F.struct(c.i.alias("i"), c.j.alias("j"), s.i.alias("pi"), s.j.alias("pj"), done.alias("done"), F.lit(False).alias("out"), F.array_append(s.path, F.struct(c.j.alias("j"), c.i.alias("i"))).alias("path"))

        here = to_end(s.j, s.i)
        stop = lambda out: F.struct(s.i.alias("i"), s.j.alias("j"), s.pi.alias("pi"), s.pj.alias("pj"), F.lit(True).alias("done"), F.lit(out).alias("out"), s.path.alias("path"))
        onward = let(F.struct(around.alias("near"), here.alias("here")), lambda x: F.when(F.exists(x.near, lambda c: ~c.t), stop(True)).otherwise(let(go(x.near, x.here), move)))
        return F.when(s.done, s).when(here * EARTH_RADIUS < 1e-12, stop(False)).otherwise(onward)

    def finish(s):
        lost = F.raise_error(F.concat(F.lit("walk not at its end after "), F.size(s.path).cast("string"), F.lit(" corners, at column "), s.i.cast("string"), F.lit(" of row "), s.j.cast("string"))).cast(path_type)
        return F.when(s.out, F.lit(None).cast(path_type)).when(s.done, s.path).otherwise(lost)

    path_type = "array<struct<j:bigint,i:bigint>>"
    start = F.struct(i1.alias("i"), j1.alias("j"), i1.alias("pi"), j1.alias("pj"), ((i1 == i2) & (j1 == j2)).alias("done"), F.lit(False).alias("out"), F.array(F.struct(j1.alias("j"), i1.alias("i"))).alias("path"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(nx + ny + 2)), start, step, finish)


def _walked(legs: DataFrame, spec: GridSpec, digits: int | None, place) -> DataFrame:
    """Legs ``(section_id, k, last, i1, j1, i2, j2)`` with coordinates -> with their ``path`` as an array of (j, i, lon, lat), null where coordinates were missing."""
    held = _ends(legs, place).withColumn("path", walk(spec, digits, place))
    point = lambda p: F.struct(p.j.alias("j"), p.i.alias("i"), place("lon", p.j, p.i).alias("lon"), place("lat", p.j, p.i).alias("lat"))
    return held.select("section_id", "k", "last", F.transform("path", point).alias("path"))


def _walked_on_tiles(legs: DataFrame, tiles: DataFrame, spec: GridSpec, digits: int | None) -> DataFrame:
    """As ``_walked``, each leg with the tiles near its arc; legs that left them again with more, at last with all."""
    tiles, legs = tiles.persist(), legs.persist()
    about = tiles.where("radius is not null").select("tile", "clon", "clat", "radius").persist()
    step = about.agg(F.max("radius")).first()[0] or 0.1
    ends = legs
    for n in (1, 2):
        tile, at = _tile(F.col(f"j{n}"), F.col(f"i{n}"), spec)
        ends = ends.withColumn("tile", tile).join(tiles.select("tile", F.col("lon").alias(f"_lon{n}"), F.col("lat").alias(f"_lat{n}")), "tile").drop("tile")
        ends = ends.withColumn(f"lon{n}", F.col(f"_lon{n}")[at]).withColumn(f"lat{n}", F.col(f"_lat{n}")[at]).drop(f"_lon{n}", f"_lat{n}")
    many = F.ceil(arc("lon1", "lat1", "lon2", "lat2") / step).cast("int") + 1  # points of the arc, a step apart at most
    on_arc = F.transform(F.sequence(F.lit(0), many), lambda n: F.struct(*(x.alias(c) for c, x in zip(("lon", "lat"), arc_point("lon1", "lat1", "lon2", "lat2", n / many)))))
    left, out = ends.withColumn("arc", on_arc).persist(), None
    for margin in MARGINS:
        reach = F.lit(True) if margin is None else F.exists("arc", lambda p: arc(p.lon, p.lat, F.col("clon"), F.col("clat")) <= F.col("radius") + step * (0.5 + margin))
        which = left.crossJoin(F.broadcast(about if margin is not None else tiles.select("tile", "clon", "clat", "radius"))).where(reach).select("section_id", "k", "tile")
        given = which.join(tiles.select("tile", "lon", "lat"), "tile").groupBy("section_id", "k").agg(F.map_from_entries(F.collect_list(F.struct("tile", F.struct("lon", "lat")))).alias("tiles"))
        found = _walked(left.select("section_id", "k", "last", "i1", "j1", "i2", "j2").join(given, ["section_id", "k"]), spec, digits, _Tiles(spec)).persist()
        whole = found.where("path is not null")
        out = whole if out is None else out.unionByName(whole)
        if margin is None or found.where("path is null").isEmpty():
            return out
        left = left.join(found.where("path is null").select("section_id", "k"), ["section_id", "k"])
    return out


def composite(legs: DataFrame, corners: DataFrame, spec: GridSpec, digits: int | None = None) -> DataFrame:
    """``(section_id, pt, i, j, lon, lat)`` from legs ``(section_id, k, last, i1, j1, i2, j2)``.

    Legs are joined end to end: each gives up its last corner to the next one's first.
    """
    if in_tiles(spec):
        held = _walked_on_tiles(legs, tile_table(corners, spec), spec, digits)
    else:
        held = _walked(legs.crossJoin(grid_row(corners, spec)), spec, digits, _Row(spec))
    held = held.withColumn("path", F.when(F.col("last"), F.col("path")).otherwise(F.slice("path", 1, F.size("path") - 1)))
    points = held.select("section_id", "k", F.posexplode("path").alias("n", "p"))
    number = F.row_number().over(W.partitionBy("section_id").orderBy("k", "n")) - 1
    return points.select("section_id", number.cast("long").alias("pt"), F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))


def grid_section(corners: DataFrame, vertices: DataFrame, spec: GridSpec, digits: int | None = None) -> DataFrame:
    """The path of each section ``vertices(section_id, k, lon, lat)``: ``(section_id, pt, i, j, lon, lat)``.

    Vertices are snapped to their nearest corners.  Any number of sections is one job, on a grid in tiles a few.
    """
    return composite(segments(snapped(vertices, corners, spec), "i", "j"), corners, spec, digits)


def index_section(corners: DataFrame, ends: DataFrame, spec: GridSpec, digits: int | None = None) -> DataFrame:
    """Paths between given corners, ``ends(section_id, i1, j1, i2, j2)``."""
    legs = ends.select("section_id", F.lit(0).alias("k"), F.lit(True).alias("last"), *(F.col(c).cast("long").alias(c) for c in ("i1", "j1", "i2", "j2")))
    return composite(legs, corners, spec, digits)


def arc_path_range(ends: DataFrame, n: int, start: float = 0.0, stop: float = 1.0) -> DataFrame:
    """``ends(lon1, lat1, lon2, lat2, ...)`` with ``n`` points ``(r, lon, lat)`` evenly spaced between two fractions of the arc."""
    at = ends.withColumn("r", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(start) + (stop - start) * k / max(n - 1, 1))))
    lon, lat = arc_point("lon1", "lat1", "lon2", "lat2", "r")
    return at.withColumn("lon", lon).withColumn("lat", lat)
