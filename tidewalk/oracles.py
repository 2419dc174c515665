"""The registered grid queries as SQL for DuckDB, over the same Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass

from tidewalk.queries import FAR_SECTIONS, LATITUDES, REGIONAL_SECTIONS, SECTIONS


def arc(a: str, b: str, c: str, d: str) -> str:
    """Central angle in radians between (lon a, lat b) and (lon c, lat d), in degrees."""
    turn, p, q = f"radians(({c}) - ({a}))", f"radians({b})", f"radians({d})"
    east = f"cos({q})*sin({turn})"
    north = f"(cos({p})*sin({q}) - sin({p})*cos({q})*cos({turn}))"
    return f"atan2(sqrt({east}*{east} + {north}*{north}), sin({p})*sin({q}) + cos({p})*cos({q})*cos({turn}))"


def corner_angle(a: str, b: str, c: str) -> str:
    above, below = f"(cos({a}) - cos({b})*cos({c}))", f"(sin({b})*sin({c}))"
    return f"case when {below} = 0 then (case when {above} > 0 then 0.0 when {above} < 0 then pi() end) else acos(greatest(-1.0, least(1.0, {above}/nullif({below}, 0)))) end"


def _points() -> str:
    at = lambda m, n, o: f"((c_custkey * {m}) % {n} + {o})::double"
    cols = [("lon1", 37, 360, 0), ("lat1", 17, 161, -80), ("lon2", 91, 360, 0), ("lat2", 53, 161, -80), ("lon3", 11, 360, 0), ("lat3", 29, 161, -80)]
    return "p as (select c_custkey as k, " + ", ".join(f"{at(m, n, o)} as {c}" for c, m, n, o in cols) + " from customer)"


@dataclass(frozen=True)
class Grid:
    """A regular grid in SQL: corner (j, i) is at (lon0 + dlon * i, lat0 + dlat * j); paths run on ``nx`` columns and ``ny`` rows of corners."""

    nx: int = 24
    ny: int = 17
    lon0: float = 0.0
    dlon: float = 15.0
    lat0: float = -80.0
    dlat: float = 10.0
    periodic: bool = True
    tripolar: bool = False

    def lon(self, i: str) -> str:
        return f"({self.lon0}::double + {self.dlon}::double*({i}))"

    def lat(self, j: str) -> str:
        return f"({self.lat0}::double + {self.dlat}::double*({j}))"

    def near(self) -> str:
        """The neighbours of (j, i): right, left, down, up."""
        n, top = self.nx, self.ny - 1
        right, left = (f"(i + 1) % {n}", f"(i + {n - 1}) % {n}") if self.periodic else (f"least(i + 1, {n - 1})", "greatest(i - 1, 0)")
        up = (f"case when j = {top} then j - 1 else j + 1 end", f"case when j = {top} then {n - 1} - i % {n} else i % {n} end") if self.tripolar else (f"least(j + 1, {top})", "i")
        return ", ".join(f"{{'o': {o}, 'j': {j}, 'i': {i}}}" for o, (j, i) in enumerate([("j", right), ("j", left), ("greatest(j - 1, 0)", "i"), up]))


GRID = Grid()
UNSYMMETRIC = Grid(ny=16, lon0=15.0, lat0=-70.0)
REGIONAL = Grid(nx=25, lon0=200.0, dlon=2.5, lat0=-10.0, dlat=2.0, periodic=False)
TRIPOLAR = Grid(tripolar=True)


def _walk(rows: str, g: Grid = GRID, digits: int | None = 6) -> str:
    """CTEs up to path(section_id, pt, i, j, lon, lat), from a list of (section_id, k, lon, lat) on corners."""
    to = lambda e: arc(g.lon("c.i"), g.lat("c.j"), g.lon(f"i{e}"), g.lat(f"j{e}"))
    whole = arc(g.lon("i1"), g.lat("j1"), g.lon("i2"), g.lat("j2"))
    here = arc(g.lon("i"), g.lat("j"), g.lon("i2"), g.lat("j2"))
    mean = f"(({corner_angle('c.e', 'c.d', 'whole')}) + ({corner_angle('c.d', 'c.e', 'whole')}))/2"
    mean = mean if digits is None else f"round({mean}, {digits})"
    column = f"(round((lon - {g.lon0})/{g.dlon})::bigint)" + (f" % {g.nx}" if g.periodic else "")
    return f"""
vertices(section_id, k, lon, lat) as (values {rows}),
snapped as (select section_id, k, {column} as i, round((lat - {g.lat0})/{g.dlat})::bigint as j from vertices),
legs as (select *, lead(i) over w as i2, lead(j) over w as j2, lead(k, 2) over w is null as fin from snapped window w as (partition by section_id order by k)),
leg as (select section_id, k, fin, i as i1, j as j1, i2, j2 from legs where i2 is not null),
walk as (
  select section_id, k, fin, i1, j1, i2, j2, 0::bigint as step, i1 as i, j1 as j, i1 as pi, j1 as pj, {whole} as whole from leg
  union all
  select section_id, k, fin, i1, j1, i2, j2, step + 1, n.i, n.j, i, j, whole from (
    select *, case when best is null or (best.i = pi and best.j = pj) then other else best end as n from (
      select *, list_min(list_transform(list_filter(closer, lambda c: c.a is not null), lambda c: c)) as best,
             list_min(list_transform(list_filter(near, lambda c: came is null or c.o <> came), lambda c: {{'a': c.d, 'o': c.o, 'j': c.j, 'i': c.i}})) as other from (
        select *, list_transform(list_filter(near, lambda c: c.d < here), lambda c: {{'a': case when c.d = 0 then -1.0 else {mean} end, 'o': c.o, 'j': c.j, 'i': c.i}}) as closer,
               list_min(list_transform(list_filter(near, lambda c: c.i = pi and c.j = pj), lambda c: c.o)) as came from (
          select *, {here} as here, list_transform([{g.near()}],
            lambda c: {{'o': c.o, 'j': c.j, 'i': c.i, 'd': {to(2)}, 'e': {to(1)}}}) as near
          from walk where i <> i2 or j <> j2)))) where step < {g.nx + g.ny + 1}),
path as (select section_id, row_number() over (partition by section_id order by k, step) - 1 as pt, i, j, {g.lon("i")} as lon, {g.lat("j")} as lat
         from (select *, max(step) over (partition by section_id, k) as top from walk) where fin or step < top)"""


def _rows(sections: dict, *names: str) -> str:
    return ", ".join(f"('{n}', {k}, {x}::double, {y}::double)" for n in names or sections for k, (x, y) in enumerate(sections[n]))


def _sections(*names: str) -> str:
    return _walk(_rows(SECTIONS, *names))


FACES = """,
steps as (select *, lead(i) over w as i_to, lead(j) over w as j_to from path window w as (partition by section_id order by pt)),
turns as (select section_id, pt as sect, i, j, i_to, j_to, j = j_to as zonal, case when i_to - i > 1 then false when i_to - i < -1 then true else i_to > i end as eward, j_to > j as nward from steps where i_to is not null),
faces as (select section_id, sect, case when zonal then 'V' else 'U' end as var, case when zonal and not eward then i_to else i end as i, case when not zonal and not nward then j_to else j end as j, nward, eward from turns)"""

ORIENT = """,
plane as (select *, sin(radians(90 - lat))/(1 - cos(radians(90 - lat)))*cos(-radians(lon)) as x, sin(radians(90 - lat))/(1 - cos(radians(90 - lat)))*sin(-radians(lon)) as y,
          first_value(lon) over w as lon0, first_value(lat) over w as lat0, last_value(lon) over w as lon9, last_value(lat) over w as lat9 from path
          window w as (partition by section_id order by pt rows between unbounded preceding and unbounded following)),
ring as (select section_id, pt, x, y, (lon0 = lon9 and lat0 = lat9) as closed, lead(x) over w as xn, lead(y) over w as yn, first_value(x) over w as x0, first_value(y) over w as y0 from plane window w as (partition by section_id order by pt)),
orient as (select section_id, sum((coalesce(xn, case when not closed then x0 end) - x)*(coalesce(yn, case when not closed then y0 end) + y)) < 0 as counterclockwise, bool_and(closed) as is_closed from ring group by section_id)"""

COORDS = """,
located as (select *, case when var = 'U' then 15.0*i else 15.0*(i % 24) + 7.5 end::double as lon, case when var = 'U' then 10.0*least(j, 15) - 75 else 10.0*j - 80 end::double as lat,
            case when var = 'U' then i else i % 24 end as fi, case when var = 'U' then least(j, 15) else j end as fj,
            case when (var = 'U' and not nward) or (var = 'V' and eward) then 1 else -1 end as s from faces)"""

FIELDS = """,
items as (select year(l_shipdate)::bigint as time, l_linenumber::bigint as z_l, l_orderkey as o, l_partkey as p, case when l_linestatus = 'O' then l_quantity else -l_quantity end as s, l_quantity as q from lineitem),
umo as (select time, z_l, o % 16 as yh, p % 24 as xq, sum(s) as umo from items group by all),
vmo as (select time, z_l, o % 17 as yq, (o + p) % 24 as xh, sum(s) as vmo from items group by all),
thetao as (select time, z_l, o % 16 as yh, p % 24 as xh, sum(q) as thetao from items group by all)"""

#: Faces with their factor; ``fact`` is 1 or -1.
_FACED = """,
faced as (select section_id, sect, var as dir, fi, fj, lon, lat, counterclockwise as positive_in, case when counterclockwise then 1 else -1 end as orient_fact, s*(case when counterclockwise then 1 else -1 end) as sign
          from located join orient using (section_id))"""

_CONV = """,
conv as (select f.section_id, d.time, d.z_l, f.sect, d.val*f.sign as conv_mass_transport, f.sign, f.dir, f.lon, f.lat, f.orient_fact, f.positive_in from faced f join (
           select 'U' as dir, time, z_l, yh as fj, xq as fi, umo as val from umo union all select 'V', time, z_l, yq, xh, vmo from vmo) d using (dir, fj, fi))"""

_DENSE = """,
dims as (select distinct time, z_l from umo intersect select distinct time, z_l from vmo),
conv_dense as (select f.section_id, t.time, t.z_l, f.sect, coalesce(d.val, 0.0)*f.sign as conv_mass_transport, f.sign, f.dir, f.lon, f.lat, f.orient_fact, f.positive_in, f.fj
  from faced f cross join dims t left join (select 'U' as dir, time, z_l, yh as fj, xq as fi, umo as val from umo union all select 'V', time, z_l, yq, xh, vmo from vmo) d
  on d.dir = f.dir and d.fj = f.fj and d.fi = f.fi and d.time = t.time and d.z_l = t.z_l)"""


#: Faces where corners are right of and above the cells' middles.
FACES_RIGHT = FACES.replace("end as i, case", "end + case when zonal then 1 else 0 end as i, case").replace("end as j, nward", "end + case when zonal then 0 else 1 end as j, nward")


def _located(g: Grid) -> str:
    """COORDS on another grid: the corner's coordinate along, the centre's across."""
    right = 1 if g.ny == 16 else 0
    fi, fj = ("i % 24" if g.periodic else "greatest(0, least(23, i))"), "greatest(0, least(15, j))"
    lon = f"case when var = 'U' then {g.lon('i')} else {g.lon(f'({fi}) + 0.5 - {right}')} end"
    lat = f"case when var = 'U' then {g.lat(f'({fj}) + 0.5 - {right}')} else {g.lat('j')} end"
    return f""",
located as (select *, {lon} as lon, {lat} as lat, case when var = 'U' then i else {fi} end as fi, case when var = 'U' then {fj} else j end as fj,
            case when (var = 'U' and not nward) or (var = 'V' and eward) then 1 else -1 end as s from faces)"""


def _faces(*names: str) -> str:
    return f"with recursive {_sections(*names)}{FACES}"


def _transports(*names: str) -> str:
    return f"{_faces(*names)}{ORIENT}{COORDS}{FIELDS}{_FACED}{_CONV}"


def _box(lon: str, lat: str) -> str:
    return f"({lon} between 30 and 120 and {lat} between -40 and 20)"


def _inside(mask: str) -> str:
    """CTE inside(section_id, inside) for face 0; ``mask`` is SQL over yh and xh."""
    return f""",
first as (select section_id, var, case when var = 'U' then i - (case when s = -1 then 1 else 0 end) else i % 24 end as ci, case when var = 'U' then least(j, 15) else j - (case when s = -1 then 1 else 0 end) end as cj from located where sect = 0),
inside as (select section_id, case when ci < 0 or ci > 23 or cj < 0 or cj > 15 then not m else m end as inside from (
  select *, ({mask.format(xh="greatest(0, least(23, ci))", yh="greatest(0, least(15, cj))")}) as m from first))"""


def _psi(source: str, others: str, value: str) -> str:
    return f"""layers as (select {others}, z_l, sum({value}) as v from {source} group by all),
psi as (select {others}, row_number() over w as interface, sum(v) over w as psi from layers window w as (partition by {others} order by z_l)),
full_psi as (select * from psi union all select distinct {others}, 0, 0.0 from layers)"""


def oracle_sql() -> dict[str, str]:
    hav = "sin(radians(lat2 - lat1)/2)*sin(radians(lat2 - lat1)/2) + cos(radians(lat1))*cos(radians(lat2))*sin(radians(lon2 - lon1)/2)*sin(radians(lon2 - lon1)/2)"
    cosines = "sin(radians(lat1))*sin(radians(lat2)) + cos(radians(lat1))*cos(radians(lat2))*cos(radians(lon2 - lon1))"
    whole = arc("lon1", "lat1", "lon2", "lat2")
    x, y, z = (f"(a*cos(radians(lat1))*{f}(radians(lon1)) + b*cos(radians(lat2))*{f}(radians(lon2)))" if f else "(a*sin(radians(lat1)) + b*sin(radians(lat2)))" for f in ("cos", "sin", ""))
    near = arc("lon", "lat", "15.0*i", "10.0*j - 80")
    tracer = """,
sides as (select section_id, sect, case when var = 'U' then j % 16 else (j + d + 16) % 16 end as fj, case when var = 'U' then (i + d + 24) % 24 else i % 24 end as fi from faces cross join (values (-1), (0)) t(d)),
"""
    sweep_rows = ", ".join(f"('{y}', {k}, {15 * k}::double, {y}::double)" for y in LATITUDES for k in range(25))
    wu, wv = "6371000.0*radians(10.0)", "6371000.0*radians(15.0)*cos(radians(10.0*fj - 80))"
    return {
        "q_distance": f"with {_points()} select k, round(6371.0*{whole}, 2) as vincenty, round(6371.0*2*asin(least(1.0, sqrt({hav}))), 2) as haversine, round(6371.0*acos(greatest(-1.0, least(1.0, {cosines}))), 2) as cosines from p",
        "q_angle": f"with {_points()}, t as (select k, {arc('lon2', 'lat2', 'lon3', 'lat3')} as a, {arc('lon1', 'lat1', 'lon3', 'lat3')} as b, {whole} as c from p) select k, round({corner_angle('a', 'b', 'c')}, 5) as angle from t",
        "q_stereographic": f"with {_points()}, t as (select k, lon1, radians(90 - greatest(-90 + 1e-3, least(90 - 1e-3, lat1))) as d from p) select k, round(sin(d)/(1 - cos(d))*cos(-radians(lon1)), 7) as x, round(sin(d)/(1 - cos(d))*sin(-radians(lon1)), 7) as y from t",
        "q_arc_path": f"""with {_points()}, t as (select *, n/4.0::double as r, {whole} as far, case when far < pi() - 1e-9 then far end as w from p cross join (values (0), (1), (2), (3), (4)) v(n)),
ab as (select *, case when sin(w) = 0 then 1.0 else sin((1 - r)*w)/nullif(sin(w), 0) end as a, case when sin(w) = 0 then 0.0 else sin(r*w)/nullif(sin(w), 0) end as b from t),
xyz as (select k, r, lon1, {x} as x, {y} as y, {z} as z, sqrt(x*x + y*y) as flat from ab),
ll as (select k, r, degrees(case when flat < 1e-12 then atan2(sin(radians(lon1)), cos(radians(lon1))) else atan2(y, x) end) as lon, degrees(atan2(z, flat)) as lat from xyz)
select k, r, round(case when lon < -180 + 1e-9 then 180.0 else lon end, 6) + 0.0::double as lon, round(lat, 6) + 0.0::double as lat from ll""",
        "q_nearest_corner": f"with {_points()}, q as (select k, lon1 + 0.25 as lon, lat1 + 0.25 as lat from p), g as (select a.range as j, b.range as i from range(17) a, range(24) b), m as (select k, min({{'d': {near}, 'j': j, 'i': i}}) as b from q cross join g group by k) select k, b.i as i, b.j as j from m",
        "q_grid_section": f"with recursive {_sections()} select section_id, pt, i, j, lon, lat from path",
        "q_index_section": "with recursive " + _walk("('a', 0, 15.0::double, -30.0::double), ('a', 1, 150.0::double, 10.0::double), ('b', 0, 300.0::double, 0.0::double), ('b', 1, 45.0::double, 40.0::double)") + " select section_id, pt, i, j, lon, lat from path",
        "q_faces": _faces() + " select section_id, sect, var, i, j, nward, eward from faces",
        "q_face_coords": _faces() + COORDS + " select section_id, sect, var, i, j, nward, eward, lon, lat from located",
        "q_path_without_rounding": f"with recursive {_walk(_rows(SECTIONS, 'open'), digits=None)} select section_id, pt, i, j, lon, lat from path",
        "q_unsymmetric_section": f"with recursive {_walk(_rows(SECTIONS), UNSYMMETRIC)}{FACES_RIGHT}{_located(UNSYMMETRIC)} select section_id, sect, var, i, j, nward, eward, lon, lat from located",
        "q_unsymmetric_transport": f"with recursive {_walk(_rows(SECTIONS), UNSYMMETRIC)}{FACES_RIGHT}{ORIENT}{_located(UNSYMMETRIC)}{FIELDS}{_FACED}{_CONV} select * from conv",
        "q_unsymmetric_tracer": f"with recursive {_walk(_rows(SECTIONS), UNSYMMETRIC)}{FACES_RIGHT}{FIELDS}" + tracer.replace("values (-1), (0)", "values (0), (1)") + "t as (select section_id, time, z_l, sect, nullif(avg(thetao), 0) as thetao from sides join thetao on fj = yh and fi = xh group by section_id, time, z_l, sect) select * from t",
        "q_regional_section": f"with recursive {_walk(_rows(REGIONAL_SECTIONS), REGIONAL)}{FACES}{_located(REGIONAL)} select section_id, sect, var, i, j, nward, eward, lon, lat from located",
        "q_regional_transport": f"with recursive {_walk(_rows(REGIONAL_SECTIONS), REGIONAL)}{FACES}{ORIENT}{_located(REGIONAL)}{FIELDS}{_FACED}{_CONV} select * from conv",
        "q_tripolar_section": f"with recursive {_walk(_rows(FAR_SECTIONS), TRIPOLAR)} select section_id, pt, i, j, lon, lat from path",
        "q_native_coords": _faces() + COORDS + " select section_id, sect, var, i, j, nward, eward, case when var = 'U' then 15.0*fi + 0.25 else 15.0*fi + 7.75 end::double as lon, case when var = 'U' then 10.0*fj - 74.5 else 10.0*fj - 79.5 end::double as lat from located",
        "q_missing_cells": _transports() + " select section_id, time, z_l, sect, dir, case when (fi + fj) % 5 = 0 then 0.0 else conv_mass_transport end as conv_mass_transport from (select c.*, f.fi, f.fj from conv c join faced f using (section_id, sect))",
        "q_missing_tracer": _faces() + FIELDS + tracer + "t as (select section_id, time, z_l, sect, nullif(avg(case when (xh + yh) % 5 <> 0 then thetao end), 0) as thetao from sides join thetao on fj = yh and fi = xh group by section_id, time, z_l, sect) select * from t",
        "q_reverse_section": f"with recursive {_sections()} select section_id, max(pt) over (partition by section_id) - pt as pt, i, j, lon, lat from path",
        "q_closed_section": f"with recursive {_walk(_rows({n: x if x[0] == x[-1] else [*x, x[0]] for n, x in SECTIONS.items()}))} select section_id, pt, i, j, lon, lat from path",
        "q_layers": _transports() + ", edges(z_l, top, bottom) as (values (1, 0.0::double, 10.0::double), (2, 10.0, 25.0), (3, 25.0, 50.0), (4, 50.0, 100.0), (5, 100.0, 250.0), (6, 250.0, 600.0), (7, 600.0, 1500.0)) select section_id, z_l, total, top, bottom, bottom - top as thickness from (select section_id, z_l, sum(conv_mass_transport) as total from conv group by all) left join edges using (z_l)",
        "q_differences": f"with recursive {_sections()}, back as (select section_id, max(pt) over (partition by section_id) - pt as pt, i, j from path) select section_id, pt from path a join back b using (section_id, pt) where a.i <> b.i or a.j <> b.j",
        "q_wrap": "select range - 3 as idx, ((range - 3) % 24 + 24) % 24 as x, greatest(0, least(15, range - 3)) as y from range(33)",
        "q_orientation": f"with recursive {_sections()}{ORIENT} select section_id, counterclockwise, is_closed from orient",
        "q_mask_inside": _faces() + COORDS + _inside("10.0*{yh} - 75 < 0 and {xh} is not null") + " select section_id, inside from inside",
        "q_transport": _transports() + " select * from conv",
        "q_transport_dense": f"{_transports('box')}{_DENSE}, d as (select *, case when dir = 'U' then {wu} else {wv} end as w from conv_dense) select section_id, time, z_l, sect, conv_mass_transport, sign, dir, lon, lat, orient_fact, positive_in, round(w, 3) as dl, round(sum(w) over (partition by section_id, time, z_l order by sect), 3) as distance from d",
        "q_transport_mask": f"{_transports('box')}{_inside(_box('15.0*{xh} + 7.5', '10.0*{yh} - 75'))} select time, z_l, case when inside then 1 else -1 end as orient_fact, sum(conv_mass_transport*orient_fact*(case when inside then 1 else -1 end)) as total from conv join inside using (section_id) group by time, z_l, inside",
        "q_transport_total": _transports() + " select section_id, time, z_l, sum(conv_mass_transport) as total from conv group by all",
        "q_time_mean": _transports() + " select section_id, z_l, sect, round(avg(conv_mass_transport), 9) as mean from conv group by all",
        "q_cumulated": _transports() + _DENSE + ", one as (select section_id, time, z_l, sect, sum(sum(conv_mass_transport)) over (partition by section_id, time, z_l order by sect) as v from conv_dense group by section_id, time, z_l, sect) select section_id, time, z_l, sect, sum(v) over (partition by section_id, time, sect order by z_l) as cumulated from one",
        "q_overturning": f"{_transports()}, {_psi('conv', 'section_id, time', 'conv_mass_transport')} select section_id, time, interface, psi from full_psi",
        "q_tracer": _faces() + FIELDS + tracer + "t as (select section_id, time, z_l, sect, nullif(avg(thetao), 0) as thetao from sides join thetao on fj = yh and fi = xh group by section_id, time, z_l, sect) select * from t",
        "q_tracer_zeros": _faces() + FIELDS + tracer + "t as (select section_id, time, z_l, sect, nullif(avg(umo), 0) as umo from sides join umo on fj = yh and fi = xq group by section_id, time, z_l, sect) select * from t",
        "q_latitude_sweep": f"with recursive {_walk(sweep_rows)}{FACES}{ORIENT}{COORDS}{FIELDS}{_FACED}{_CONV}, {_psi('conv', 'section_id, time', 'conv_mass_transport')} select section_id, interface, round(avg(psi), 9) as psi_mean from full_psi group by all",
        "q_meridional_overturning": "with items as (select year(l_shipdate)::bigint as time, l_linenumber::bigint as z_l, l_orderkey % 17 as row, case when l_linestatus = 'O' then l_quantity else -l_quantity end as s from lineitem), rows_ as (select time, row - 1 as yq, z_l, s from items where row >= 1), " + _psi("rows_", "time, yq", "s") + " select time, yq, interface, psi from full_psi",
        "q_boundary_faces": "select 'V' as var, range as i, 8::bigint as j, -1 as sign from range(24)",
        "q_mask_transport": "with " + FIELDS[2:] + f""",
cells as (select a.range as yh, b.range as xh, {_box('15.0*b.range + 7.5', '10.0*a.range - 75')} as m from range(16) a, range(24) b),
e as (select 'U' as dir, c.yh as fj, (c.xh + 1) % 24 as fi, case when n.m then 1 else -1 end as s from cells c join cells n on n.yh = c.yh and n.xh = (c.xh + 1) % 24 and n.m <> c.m
      union all select 'V', c.yh + 1, c.xh, case when n.m then 1 else -1 end from cells c join cells n on n.xh = c.xh and n.yh = c.yh + 1 and n.m <> c.m)
select time, z_l, sum(val*s) as total from e join (select 'U' as dir, time, z_l, yh as fj, xq as fi, umo as val from umo union all select 'V', time, z_l, yq, xh, vmo from vmo) d using (dir, fj, fi) group by time, z_l""",
        "q_supergrid": "select p.position, (j // 2) as y, (i // 2) as x, 2.5::double*i as lon, 5.0::double*j - 20 as lat from (select a.range as j, b.range as i from range(9) a, range(13) b) join (values ('corner', 0, 0), ('v', 0, 1), ('u', 1, 0), ('center', 1, 1)) p(position, r, c) on j % 2 = r and i % 2 = c",
    }
