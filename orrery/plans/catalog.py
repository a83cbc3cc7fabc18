"""Named queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, fresh_dir
from ..functions import quantity
from ..operators import bridge, filters, gravity, groups, hist, neighbours, profile, render, sph, structure, transform
from ..operators.profile import Profile
from ..snapshot import Snapshot, snapshot
from ..sources import cells, lattice, names, spatial
from ..units import as_unit
from .views import EVENTS_SQL, LINEITEM_SQL, events, items, plain_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

E = f"WITH e AS ({EVENTS_SQL})"
R = "sqrt(x * x + y * y + z * z)"
RXY = "sqrt(x * x + y * y)"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show; -0 becomes 0."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.round(c, digits) + F.lit(0.0)).alias(name) if kind == "double" else c)
    return df.select(*out)


def _round_sql(sql: str, cols: str, keys: str, source: str = "q") -> str:
    """SQL of keys and rounded columns of the last expression of a WITH."""
    parts = [k.strip() for k in keys.split(",") if k.strip()] + [f"round({c.strip()}, 6) + 0e0 AS {c.strip()}" for c in cols.split(",")]
    return f"{sql} SELECT {', '.join(parts)} FROM {source}"


# ---- derived columns

DERIVED = {
    "r": R,
    "rxy": RXY,
    "v2": "vx * vx + vy * vy + vz * vz",
    "ke": "5e-1 * (vx * vx + vy * vy + vz * vz)",
    "te": "5e-1 * (vx * vx + vy * vy + vz * vz) + phi",
    "vr": f"(x * vx + y * vy + z * vz) / nullif({R}, 0e0)",
    "vt": f"sqrt(greatest(vx * vx + vy * vy + vz * vz - power((x * vx + y * vy + z * vz) / nullif({R}, 0e0), 2), 0e0))",
    "j_x": "y * vz - z * vy",
    "j_y": "z * vx - x * vz",
    "j_z": "x * vy - y * vx",
    "j2": "power(y * vz - z * vy, 2) + power(z * vx - x * vz, 2) + power(x * vy - y * vx, 2)",
    "vrxy": f"(x * vx + y * vy) / nullif({RXY}, 0e0)",
    "vcxy": f"coalesce((x * vy - y * vx) / nullif({RXY}, 0e0), 0e0)",
    "theta": f"acos(least(greatest(z / nullif({R}, 0e0), -1e0), 1e0))",
    "alt": f"pi() / 2 - acos(least(greatest(z / nullif({R}, 0e0), -1e0), 1e0))",
    "az": "atan2(y, x)",
    "vtheta": f"cos(atan2(y, x)) * (z / nullif({R}, 0e0)) * vx + sin(atan2(y, x)) * (z / nullif({R}, 0e0)) * vy - sqrt(1e0 - power(z / nullif({R}, 0e0), 2)) * vz",
    "age": "13e0 - tform",
    "mu": "CASE WHEN temp < 1e4 THEN 4e0 / (4e0 - 3e0 * 0.245e0) ELSE 4e0 / (8e0 - 5e0 * 0.245e0) END",
    "hydrogen": "1e0 - metals - (236e-3 + 21e-1 * metals)",
    "hetot": "236e-3 + 21e-1 * metals",
}


def _derived(name: str) -> None:
    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = plain_events(spark, sf_dir)
        return _rounded(s.df.select("pidx", s.col(name).alias(name)))

    fn.__name__ = f"derived_{name}"
    query(f"{E} SELECT pidx, round({DERIVED[name]}, 6) + 0e0 AS {name} FROM e")(fn)


for _name in DERIVED:
    _derived(_name)

# ---- filters


def _wrap(d: str) -> str:
    return f"(CASE WHEN {d} > 250e0 THEN {d} - 500e0 WHEN {d} < -250e0 THEN {d} + 500e0 ELSE {d} END)"


_W = [_wrap(f"({c} - {v})") for c, v in zip("xyz", ("200e0", "-240e0", "100e0"), strict=True)]
FILTERS: dict[str, tuple[filters.Filter, str, bool]] = {
    "sphere": (filters.Sphere(100.0), "x * x + y * y + z * z < 1e4", False),
    "sphere_units": (filters.Sphere("0.1 Mpc", (10.0, 0.0, 0.0)), "(x - 1e1) * (x - 1e1) + y * y + z * z < 1e4", False),
    "sphere_periodic": (filters.Sphere(120.0, (200.0, -240.0, 100.0)), f"{_W[0]} * {_W[0]} + {_W[1]} * {_W[1]} + {_W[2]} * {_W[2]} < 144e2", True),
    "cuboid": (filters.Cuboid(-100.0, -50.0, -200.0, 150.0, 75.0, 10.0), "x > -1e2 AND x < 15e1 AND y > -5e1 AND y < 75e0 AND z > -2e2 AND z < 1e1", False),
    "disc": (filters.Disc(150.0, 40.0), "x * x + y * y < 225e2 AND abs(z) < 4e1", False),
    "band_pass": (filters.BandPass("temp", 5e3, 1e4), "temp > 5e3 AND temp < 1e4", False),
    "high_pass": (filters.HighPass("r", 200.0), f"{R} > 2e2", False),
    "low_pass": (filters.LowPass("r", "0.2 Mpc"), f"{R} < 2e2", False),
    "annulus": (filters.Annulus(100.0, 200.0), "x * x + y * y + z * z >= 1e4 AND x * x + y * y + z * z < 4e4", False),
    "solar_neighborhood": (filters.SolarNeighborhood(50.0, 150.0, 60.0), "NOT (x * x + y * y < 25e2 AND abs(z) < 6e1) AND x * x + y * y < 225e2 AND abs(z) < 6e1", False),
    "family": (filters.FamilyFilter("g"), "family = 'gas'", False),
    "and": (filters.Sphere(200.0) & filters.HighPass("temp", 1e4), "x * x + y * y + z * z < 4e4 AND temp > 1e4", False),
    "or": (filters.Sphere(50.0) | filters.LowPass("temp", 2e3), "x * x + y * y + z * z < 25e2 OR temp < 2e3", False),
    "not": (~filters.Sphere(200.0), "NOT (x * x + y * y + z * z < 4e4)", False),
}


def _filter(name: str) -> None:
    f, where, box = FILTERS[name]

    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return events(spark, sf_dir, box).where(f).df.select("pidx", "family")

    fn.__name__ = f"filter_{name}"
    query(f"{E} SELECT pidx, family FROM e WHERE {where}")(fn)


for _name in FILTERS:
    _filter(_name)

# ---- regions of stored snapshots


def _indexed(name: str) -> None:
    f, where, box = FILTERS[name]

    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = fresh_dir(spark, "store")
        spatial.write(events(spark, sf_dir, box), at, 2000)
        return spatial.open_store(spark, at).where(f).df.select("pidx", "family")

    fn.__name__ = f"filter_{name}_indexed"
    query(f"{E} SELECT pidx, family FROM e WHERE {where}")(fn)


for _name in ("sphere", "sphere_periodic", "cuboid", "annulus"):
    _indexed(_name)

_GRID_CELL = "cast(floor((x + 25e1) / 5e1) as bigint) + 10 * cast(floor((y + 25e1) / 5e1) as bigint) + 100 * cast(floor((z + 25e1) / 5e1) as bigint)"


@query(f"{E}, c AS (SELECT pidx, {_GRID_CELL} AS cell, x, y, z FROM e), k AS (SELECT DISTINCT cell, cell % 10 * 5e1 - 225e0 AS a, cell // 10 % 10 * 5e1 - 225e0 AS b, cell // 100 * 5e1 - 225e0 AS c FROM c) SELECT pidx FROM c JOIN k ON c.cell = k.cell WHERE power(greatest(abs(a - 1e1) - 25e0, 0e0), 2) + power(greatest(abs(b) - 25e0, 0e0), 2) + power(greatest(abs(k.c + 3e1) - 25e0, 0e0), 2) <= 49e2")
def region_cells(spark, sf_dir):
    """Events in the order of a grid's cells, and the whole cells that a sphere touches."""
    s = plain_events(spark, sf_dir)
    placed = s.df.withColumn("cell", F.expr(_GRID_CELL)).withColumnRenamed("pidx", "event")
    counts = checkpointed(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    at = cells.table(counts, ["cell"]).withColumns({"x": F.col("cell") % 10 * 50.0 - 225.0, "y": F.floor(F.col("cell") / 10) % 10 * 50.0 - 225.0, "z": F.floor(F.col("cell") / 100) * 50.0 - 225.0})
    order = F.row_number().over(Window.partitionBy("cell").orderBy("event")) - 1
    rows = placed.join(at.select("cell", "first"), "cell").withColumn("pidx", F.col("first") + order)
    path = fresh_dir(spark, "cells")
    rows.repartitionByRange("pidx").sortWithinPartitions("pidx").write.parquet(path)
    stored = snapshot(spark.read.parquet(path))
    return cells.take_region(stored, at, filters.Sphere(70.0, (10.0, 0.0, -30.0)), 50.0).df.select(F.col("event").alias("pidx"))


# ---- views and set operations


@query(f"{E} SELECT pidx FROM e WHERE pidx >= 100 AND pidx < 5000 AND (pidx - 100) % 3 = 0")
def view_slice(spark, sf_dir):
    return plain_events(spark, sf_dir).rows(100, 5000, 3).df.select("pidx")


@query(f"{E}, f AS (SELECT pidx, row_number() OVER (ORDER BY pidx) - 1 AS k FROM e WHERE pidx >= 100 AND (pidx - 100) % 3 = 0), r AS (SELECT pidx, row_number() OVER (ORDER BY k DESC) - 1 AS k FROM f) SELECT pidx, (k - 5) // 7 AS place FROM r WHERE k >= 5 AND k < 4000 AND (k - 5) % 7 = 0")
def view_slice_of_slices(spark, sf_dir):
    s = plain_events(spark, sf_dir).rows(100, None, 3).rows(None, None, -1).rows(5, 4000, 7)
    return s._placed()


@query(f"{E}, f AS (SELECT pidx, row_number() OVER (ORDER BY pidx) - 1 AS place FROM e WHERE family = 'gas') SELECT o_orderkey AS at, pidx FROM orders JOIN f ON place = o_custkey")
def view_take_in_order(spark, sf_dir):
    """Rows of gas at customers' places, for each order one and in the orders' order."""
    at = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    view = plain_events(spark, sf_dir).gas.take(at)
    return view.df.select(F.col(view.order).alias("at"), "pidx")


@query(f"{E} SELECT b.pidx AS pidx, a.pidx AS at FROM e a JOIN e b ON b.iord * 3 % 1000003 = a.iord WHERE a.pidx % 4 = 1")
def bridge_in_order(spark, sf_dir):
    """Partners under other ids, in the order of the rows that they are partners of."""
    a = plain_events(spark, sf_dir)
    b = plain_events(spark, sf_dir).with_column("iord", F.col("iord") * 3 % 1000003)
    got = bridge.order_bridge(a, b, allow_family_change=True)(a.rows(1, None, 4), ordered=True)
    return got.df.select("pidx", F.col(got.order).alias("at"))


@query(f"{E} SELECT pidx, mass FROM e WHERE iord IN (SELECT o_orderkey FROM orders)")
def view_ids(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return plain_events(spark, sf_dir).ids(ids).df.select("pidx", "mass")


def _views(spark, sf_dir):
    s = plain_events(spark, sf_dir)
    return s.where(filters.Sphere(150.0)), s.where(filters.HighPass("temp", 1e4))


_IN = "x * x + y * y + z * z < 225e2"


@query(f"{E} SELECT pidx FROM e WHERE {_IN} OR temp > 1e4")
def view_union(spark, sf_dir):
    a, b = _views(spark, sf_dir)
    return a.union(b).df.select("pidx")


@query(f"{E} SELECT pidx FROM e WHERE {_IN} AND temp > 1e4")
def view_intersect(spark, sf_dir):
    a, b = _views(spark, sf_dir)
    return a.intersect(b).df.select("pidx")


@query(f"{E} SELECT pidx FROM e WHERE {_IN} AND NOT temp > 1e4")
def view_setdiff(spark, sf_dir):
    a, b = _views(spark, sf_dir)
    return a.setdiff(b).df.select("pidx")


@query(f"{E} SELECT family, min(pidx) AS first, count(*) AS n FROM e GROUP BY family")
def view_families(spark, sf_dir):
    return plain_events(spark, sf_dir).families()


@query(f"{E}, k AS (SELECT pidx, row_number() OVER (ORDER BY pidx) - 1 AS place FROM e WHERE temp > 1e4) SELECT k.pidx, place FROM k JOIN e ON k.pidx = e.pidx WHERE {_IN}")
def view_index_list(spark, sf_dir):
    a, b = _views(spark, sf_dir)
    return a.intersect(b).index_in(b)


def _wrap_sql(c: str) -> str:
    return f"CASE WHEN {c} > 1e2 THEN {c} - 2e2 WHEN {c} <= -1e2 THEN {c} + 2e2 ELSE {c} END"


@query(f"{E} SELECT pidx, round({_wrap_sql('x')}, 6) + 0e0 AS x, round({_wrap_sql('y')}, 6) + 0e0 AS y, round({_wrap_sql('z')}, 6) + 0e0 AS z FROM e")
def wrap_center(spark, sf_dir):
    return _rounded(plain_events(spark, sf_dir).wrap(200.0).df.select("pidx", "x", "y", "z"))


@query(f"{E} SELECT pidx, CASE WHEN {_IN} THEN 0e0 ELSE temp END AS temp FROM e")
def view_write_through(spark, sf_dir):
    s = plain_events(spark, sf_dir)
    return s.set_where("temp", filters.Sphere(150.0).column(s), F.lit(0.0)).df.select("pidx", "temp")


# ---- reductions and profiles


@query(_round_sql(f"{E}, q AS (SELECT sum(mass * x) / sum(mass) AS x, sum(mass * y) / sum(mass) AS y, sum(mass * z) / sum(mass) AS z FROM e)", "x, y, z", ""))
def mean_by_mass(spark, sf_dir):
    return _rounded(plain_events(spark, sf_dir).mean_by_mass("pos"))


@query(_round_sql(f"{E}, q AS (SELECT sum(temp) AS sum, avg(temp) AS mean, min(temp) AS min, max(temp) AS max, max(temp) - min(temp) AS ptp, stddev_pop(temp) AS std, var_pop(temp) AS var FROM e)", "sum, mean, min, max, ptp, std, var", ""))
def reductions(spark, sf_dir):
    return _rounded(hist.reductions(plain_events(spark, sf_dir), "temp"))


@query(f"{E} SELECT sum(mass) AS total, sum(CASE WHEN temp > 1e4 THEN mass END) AS above, sum(CASE WHEN temp < 1e4 THEN mass END) AS below FROM e")
def conditional_sums(spark, sf_dir):
    return hist.sums(plain_events(spark, sf_dir), "mass", "temp", 1e4)


_EDGES = [0.0, 40.0, 80.0, 120.0, 160.0, 200.0, 240.0, 280.0, 320.0]


def _edges_sql(edges, x: str, extra: str = "") -> str:
    """b: bin, lo, hi, rbins; p: rows with bin, closed last edge, and `inside` half open."""
    vals = ", ".join(f"({i}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)))
    top = f"{edges[-1]!r}::DOUBLE"
    return (
        f"{E}, b(bin, lo, hi) AS (VALUES {vals}), x AS (SELECT *, {x} AS xx FROM e{extra}), "
        f"p AS (SELECT x.*, b.bin, xx < {top} AS inside FROM x JOIN b ON (xx >= lo AND xx < hi) OR (xx = {top} AND hi = {top}))"
    )


def _profile3(spark, sf_dir, **kw) -> Profile:
    return Profile(plain_events(spark, sf_dir), edges=_EDGES, ndim=3, **kw)


_P3 = _edges_sql(_EDGES, R)
_JOIN = "(SELECT bin, (lo + hi) / 2 AS rbins, hi, lo FROM b) c LEFT JOIN a USING (bin)"
_MEAN = lambda q: f"sum(mass * {q}) FILTER (inside) / sum(mass) FILTER (inside)"


@query(_round_sql(f"{_P3}, a AS (SELECT bin, count(*) AS n, sum(mass) FILTER (inside) AS mass, {_MEAN('temp')} AS temp FROM p GROUP BY bin), q AS (SELECT bin, rbins, coalesce(n, 0) AS n, coalesce(mass, 0e0) AS mass, temp, coalesce(mass, 0e0) / (4e0 / 3 * pi() * (hi * hi * hi - lo * lo * lo)) AS density, sum(coalesce(mass, 0e0)) OVER (ORDER BY bin) AS mass_enc FROM {_JOIN})", "rbins, mass, temp, density, mass_enc", "bin, n"))
def profile_linear(spark, sf_dir):
    return _rounded(_profile3(spark, sf_dir).table("n", "mass", "temp", "density", "mass_enc"))


@query(_round_sql(f"{_P3}, a AS (SELECT bin, {_MEAN('temp')} AS m, {_MEAN('temp * temp')} AS s FROM p GROUP BY bin), q AS (SELECT bin, rbins, CASE WHEN s IS NOT NULL THEN sqrt(greatest(s - m * m, 0e0)) END AS temp_disp, sqrt(s) AS temp_rms FROM {_JOIN})", "rbins, temp_disp, temp_rms", "bin"))
def profile_dispersion(spark, sf_dir):
    return _rounded(_profile3(spark, sf_dir).table("temp_disp", "temp_rms"))


@query(_round_sql(f"{_P3}, k AS (SELECT bin, temp, row_number() OVER (PARTITION BY bin ORDER BY temp) AS i, count(*) OVER (PARTITION BY bin) AS n FROM p WHERE inside), a AS (SELECT bin, temp AS temp_med FROM k WHERE i = n // 2 + 1), q AS (SELECT bin, rbins, temp_med FROM {_JOIN})", "rbins, temp_med", "bin"))
def profile_median(spark, sf_dir):
    return _rounded(_profile3(spark, sf_dir).table("temp_med"))


@query(_round_sql(f"{_P3}, q AS (SELECT bin, quantile_cont(temp, 0.16) AS q16, quantile_cont(temp, 0.5) AS q50, quantile_cont(temp, 0.84) AS q84 FROM p WHERE inside GROUP BY bin)", "q16, q50, q84", "bin"))
def profile_quantiles(spark, sf_dir):
    return _rounded(_profile3(spark, sf_dir).quantiles("temp"))


_ENC = "sum(coalesce(mass, 0e0)) OVER (ORDER BY bin)"


@query(_round_sql(f"{_P3}, a AS (SELECT bin, sum(mass) FILTER (inside) AS mass FROM p GROUP BY bin), q AS (SELECT bin, rbins, {_ENC} / (4 * pi() / 3 * rbins * rbins * rbins) AS density_enc, {_ENC} / (rbins * rbins) AS g_spherical, sqrt({_ENC} / rbins) AS rotation_curve_spherical, sqrt(rbins * rbins * rbins / (2 * nullif({_ENC}, 0e0))) AS dyntime FROM {_JOIN})", "rbins, density_enc, g_spherical, rotation_curve_spherical, dyntime", "bin"))
def profile_enclosed(spark, sf_dir):
    return _rounded(_profile3(spark, sf_dir).table("density_enc", "g_spherical", "rotation_curve_spherical", "dyntime"))


@query(_round_sql(f"{_P3}, a AS (SELECT bin, {_MEAN('temp')} AS t FROM p GROUP BY bin), w AS (SELECT bin, rbins, t, lag(t) OVER (ORDER BY bin) AS u, lead(t) OVER (ORDER BY bin) AS v FROM {_JOIN}), q AS (SELECT bin, rbins, CASE WHEN u IS NULL THEN (v - t) / 4e1 WHEN v IS NULL THEN (t - u) / 4e1 ELSE (v - u) / 8e1 END AS d_temp FROM w)", "rbins, d_temp", "bin"))
def profile_gradient(spark, sf_dir):
    return _rounded(_profile3(spark, sf_dir).table("d_temp"))


@query(_round_sql(f"{_P3}, a AS (SELECT bin, {_MEAN('(y * vz - z * vy)')} AS jx, {_MEAN('(z * vx - x * vz)')} AS jy, {_MEAN('(x * vy - y * vx)')} AS jz FROM p GROUP BY bin), q AS (SELECT bin, rbins, sqrt(jx * jx + jy * jy + jz * jz) AS jtot, acos(jz / nullif(sqrt(jx * jx + jy * jy + jz * jz), 0e0)) AS j_theta, atan2(jy, jx) AS j_phi FROM {_JOIN})", "rbins, jtot, j_theta, j_phi", "bin"))
def profile_angular_momentum(spark, sf_dir):
    return _rounded(_profile3(spark, sf_dir).table("jtot", "j_theta", "j_phi"))


def _disp2(q: str) -> str:
    return f"greatest({_MEAN(f'({q}) * ({q})')} - power({_MEAN(f'({q})')}, 2), 0e0)"


@query(_round_sql(f"{_P3}, a AS (SELECT bin, 15e-1 - ({_disp2('vx')} + {_disp2('vy')} + {_disp2('vz')}) / nullif(2 * {_disp2(DERIVED['vr'])}, 0e0) AS beta FROM p GROUP BY bin), q AS (SELECT bin, rbins, beta FROM {_JOIN})", "rbins, beta", "bin"))
def profile_beta(spark, sf_dir):
    return _rounded(_profile3(spark, sf_dir).table("beta"))


_LOG = profile.log_edges(10.0, 400.0, 12)


@query(_round_sql(f"{_edges_sql(_LOG, R)}, a AS (SELECT bin, count(*) AS n, sum(mass) FILTER (inside) AS mass FROM p GROUP BY bin), q AS (SELECT bin, rbins, coalesce(n, 0) AS n, coalesce(mass, 0e0) / (4e0 / 3 * pi() * (hi * hi * hi - lo * lo * lo)) AS density FROM {_JOIN})", "rbins, density", "bin, n"))
def profile_log(spark, sf_dir):
    p = Profile(plain_events(spark, sf_dir), type="log", nbins=12, ndim=3, least=10.0, most=400.0)
    return _rounded(p.table("n", "density"))


@query(f"{E}, o AS (SELECT {R} AS r, row_number() OVER (ORDER BY {R}) - 1 AS i, count(*) OVER () AS n FROM e), k AS (SELECT g AS edge, floor(g * (n - 1) / 10)::BIGINT AS i FROM (SELECT max(n) AS n FROM o), unnest(range(11)) AS u(g)) SELECT edge::INT AS edge, round(r, 6) AS r FROM k JOIN o USING (i)")
def profile_equal_edges(spark, sf_dir):
    s = plain_events(spark, sf_dir)
    p = Profile(s, type="equaln", nbins=10, ndim=3)
    return spark.createDataFrame([(i, round(e, 6)) for i, e in enumerate(p.edges)], "edge int, r double")


@query(_round_sql(f"{_edges_sql([0.0, 50.0, 100.0, 150.0, 200.0, 250.0], 'abs(z)')}, q AS (SELECT bin, count(*) AS n, {_MEAN('temp')} AS temp FROM p GROUP BY bin)", "temp", "bin, n"))
def profile_vertical(spark, sf_dir):
    p = Profile(plain_events(spark, sf_dir), edges=[0.0, 50.0, 100.0, 150.0, 200.0, 250.0], x=profile.vertical)
    return _rounded(p.table("n", "temp").drop("rbins").where("n > 0"))


@query(_round_sql(f"{_edges_sql([0.0, 60.0, 120.0, 180.0, 240.0], 'sqrt(x * x + power(y / cos(radians(60e0)), 2))')}, q AS (SELECT bin, count(*) AS n, {_MEAN('temp')} AS temp FROM p GROUP BY bin)", "temp", "bin, n"))
def profile_inclined(spark, sf_dir):
    p = Profile(plain_events(spark, sf_dir), edges=[0.0, 60.0, 120.0, 180.0, 240.0], x=profile.inclined(60.0))
    return _rounded(p.table("n", "temp").drop("rbins").where("n > 0"))


@query(_round_sql(f"{_edges_sql([0.0, 80.0, 160.0, 240.0], RXY)}, h AS (SELECT bin, least(floor((atan2(y, x) + pi()) / (2 * pi() / 100)), 99) AS k, sum(mass) AS w, count(*) AS c FROM p WHERE inside GROUP BY ALL), t AS (SELECT bin, sum(w) AS total FROM h GROUP BY bin HAVING sum(c) > 100), m AS (SELECT unnest(range(7))::INT AS m), q AS (SELECT h.bin, m, sum(w * cos(m * ((k + 5e-1) * 2 * pi() / 100 - pi())) / total) AS re, sum(-w * sin(m * ((k + 5e-1) * 2 * pi() / 100 - pi())) / total) AS im FROM h JOIN t ON h.bin = t.bin, m GROUP BY h.bin, m)", "re, im", "bin, m"))
def profile_fourier(spark, sf_dir):
    p = Profile(plain_events(spark, sf_dir), edges=[0.0, 80.0, 160.0, 240.0], ndim=2)
    return _rounded(p.fourier().select("bin", "m", "re", "im"))


@query(_round_sql(f"{_P3}, a AS (SELECT bin, (lo + hi) / 2 AS r0, m FROM b JOIN (SELECT bin, {_MEAN('temp')} AS m FROM p GROUP BY bin) USING (bin)), i AS (SELECT pidx, {R} AS r FROM e), j AS (SELECT pidx, r, (SELECT max(r0) FROM a WHERE r0 <= r) AS lo, (SELECT min(r0) FROM a WHERE r0 > r) AS hi FROM i), q AS (SELECT pidx, CASE WHEN lo IS NULL THEN h.m WHEN hi IS NULL THEN l.m ELSE l.m + (r - lo) * (h.m - l.m) / (hi - lo) END AS temp FROM j LEFT JOIN a l ON l.r0 = lo LEFT JOIN a h ON h.r0 = hi)", "temp", "pidx"))
def profile_to_rows(spark, sf_dir):
    p = _profile3(spark, sf_dir)
    return _rounded(p.to_rows(p.table("temp"), "temp", log_x=False, log_y=False))


# ---- histograms

_CELL = lambda c, lo, span, n: f"least(floor(({c} - {lo}) * ({n}e0 / {span})), {n - 1})::INT"


@query(_round_sql(f"{E}, q AS (SELECT {_CELL('x', '-2e2', '4e2', 20)} AS ix, {_CELL('y', '-2e2', '4e2', 20)} AS iy, sum(mass) AS h FROM e WHERE x > -2e2 AND x < 2e2 AND y > -2e2 AND y < 2e2 GROUP BY ALL)", "h", "ix, iy"))
def hist2d_weighted(spark, sf_dir):
    return _rounded(hist.hist2d(plain_events(spark, sf_dir), "x", "y", 20, 20, (-200, 200), (-200, 200), weights="mass"))


@query(_round_sql(f"{E}, q AS (SELECT {_CELL('x', '-2e2', '4e2', 20)} AS ix, {_CELL('y', '-2e2', '4e2', 20)} AS iy, sum(mass * temp) / sum(mass) AS h FROM e WHERE x > -2e2 AND x < 2e2 AND y > -2e2 AND y < 2e2 GROUP BY ALL)", "h", "ix, iy"))
def hist2d_mean(spark, sf_dir):
    return _rounded(hist.hist2d(plain_events(spark, sf_dir), "x", "y", 20, 20, (-200, 200), (-200, 200), weights="mass", values="temp"))


@query(_round_sql(f"{E}, h AS (SELECT {_CELL('x', '-2e2', '4e2', 8)} AS ix, {_CELL('y', '-2e2', '4e2', 8)} AS iy, count(*)::DOUBLE AS h FROM e WHERE x > -2e2 AND x < 2e2 AND y > -2e2 AND y < 2e2 GROUP BY ALL), q AS (SELECT ix, iy, h / sum(h) OVER (PARTITION BY ix) AS p FROM h)", "p", "ix, iy"))
def hist2d_conditional(spark, sf_dir):
    return _rounded(hist.conditional(hist.hist2d(plain_events(spark, sf_dir), "x", "y", 8, 8, (-200, 200), (-200, 200))))


@query(_round_sql(f"{E}, k AS (SELECT least(floor((tform - 0e0) * (20 / 1e1)), 19)::INT AS bin, sum(mass) AS t FROM e WHERE family = 'star' AND tform >= 0 AND tform <= 1e1 GROUP BY 1), q AS (SELECT bin, (bin + 5e-1) * 5e-1 AS mid, t / 5e-1 AS sfr FROM k)", "mid, sfr", "bin"))
def star_formation_history(spark, sf_dir):
    return _rounded(hist.star_formation(plain_events(spark, sf_dir).star, 0.0, 10.0, 20))


@query(_round_sql(f"{E}, g AS (SELECT floor({RXY} / 4e1)::INT AS bin, sum(mass) / (pi() * 16e2 * (2 * floor({RXY} / 4e1) + 1)) AS gas FROM e WHERE family = 'gas' AND abs(z) < 1e2 AND {RXY} < 2e2 GROUP BY floor({RXY} / 4e1)), s AS (SELECT floor({RXY} / 4e1)::INT AS bin, sum(mass) / (pi() * 16e2 * (2 * floor({RXY} / 4e1) + 1)) / 5e0 AS sfr FROM e WHERE family = 'star' AND abs(z) < 1e2 AND {RXY} < 2e2 AND tform > 5e0 GROUP BY floor({RXY} / 4e1)), q AS (SELECT bin, gas, sfr FROM g FULL JOIN s USING (bin))", "gas, sfr", "bin"))
def schmidt_law(spark, sf_dir):
    s = plain_events(spark, sf_dir)
    return _rounded(hist.schmidt_law(s.gas, s.star, 10.0, 5.0, 100.0, 200.0, 5))


# ---- joins: bridges and groups


def _ends(spark, sf_dir) -> tuple[Snapshot, Snapshot]:
    a = plain_events(spark, sf_dir)
    from dataclasses import replace

    b = replace(a, df=a.df.where("pidx % 10 <> 0").withColumn("pidx", F.col("pidx") * 2 + 1))
    return a, b


def _overlap(spark, sf_dir) -> DataFrame:
    a, b = _ends(spark, sf_dir)
    g1 = a.df.select(F.pmod("grp", F.lit(40)).alias("halo"), "pidx")
    g2 = b.df.select(F.floor(F.pmod("grp", F.lit(120)) / 3).alias("halo"), "pidx").where("halo < 35")
    return bridge.order_bridge(a, b, allow_family_change=True).overlap(g1, g2)


_OVER = f"{E}, o AS (SELECT grp % 40 AS g1, ((grp % 120) // 3)::BIGINT AS g2, count(*) AS n FROM e WHERE pidx % 10 <> 0 AND (grp % 120) // 3 < 35 GROUP BY ALL)"


@query(f"{E} SELECT iord, pidx * 2 + 1 AS end_row FROM e WHERE pidx % 10 <> 0 AND {_IN}")
def bridge_order(spark, sf_dir):
    a, b = _ends(spark, sf_dir)
    return bridge.order_bridge(a, b)(a.where(filters.Sphere(150.0))).df.select("iord", F.col("pidx").alias("end_row"))


@query(f"{_OVER} SELECT g1, g2, n FROM o")
def bridge_overlap(spark, sf_dir):
    return _overlap(spark, sf_dir)


@query(f"{_OVER}, w AS (SELECT *, sum(n) OVER (PARTITION BY g1) AS a, row_number() OVER (PARTITION BY g1 ORDER BY n DESC, g2) AS i FROM o) SELECT s.g1, CASE WHEN n / a >= 4e-1 THEN g2 ELSE -1 END AS g2 FROM (SELECT DISTINCT grp % 40 AS g1 FROM e) s LEFT JOIN (SELECT * FROM w WHERE i = 1) w ON s.g1 = w.g1")
def bridge_match(spark, sf_dir):
    a, _ = _ends(spark, sf_dir)
    return bridge.match(_overlap(spark, sf_dir), a.df.select(F.pmod("grp", F.lit(40)).alias("g1")), 0.4)


@query(_round_sql(f"{_OVER}, w AS (SELECT g1, g2, n / sum(n) OVER (PARTITION BY g1) AS share FROM o), q AS (SELECT g1, g2, share, row_number() OVER (PARTITION BY g1 ORDER BY share DESC, g2)::INT AS rank FROM w WHERE share > 2e-1)", "share", "g1, g2, rank"))
def bridge_fuzzy_match(spark, sf_dir):
    return _rounded(bridge.fuzzy_match(_overlap(spark, sf_dir), 0.2))


def _overlapping(s: Snapshot) -> groups.Catalogue:
    """Groups that overlap: by grp, and by every tenth id."""
    a = s.df.select(F.col("grp").alias("halo"), "pidx")
    b = s.df.where("pidx % 10 = 0").select((F.lit(1_000_000) + F.pmod("pidx", F.lit(70))).alias("halo"), "pidx")
    m = a.unionByName(b)
    return groups.Catalogue(s, m, m.select("halo").distinct())


_GR = f"{E}, m AS (SELECT grp AS halo, pidx FROM e UNION ALL SELECT 1000000 + pidx % 70, pidx FROM e WHERE pidx % 10 = 0), n AS (SELECT halo, count(*) AS n FROM m GROUP BY halo)"


@query(f"{_GR} SELECT pidx, arg_max(halo, (-n, halo)) AS grp FROM m JOIN n USING (halo) GROUP BY pidx")
def group_array(spark, sf_dir):
    return _overlapping(plain_events(spark, sf_dir)).group_array()


@query(f"{_GR} SELECT halo, n, row_number() OVER (ORDER BY n DESC, halo)::INT AS rank FROM n")
def group_sizes(spark, sf_dir):
    return _overlapping(plain_events(spark, sf_dir)).sizes()


@query(_round_sql(f"{E}, q AS (SELECT grp AS halo, sum(mass * x) / sum(mass) AS x, sum(mass * temp) / sum(mass) AS temp FROM e GROUP BY grp)", "x, temp", "halo"))
def group_means(spark, sf_dir):
    return _rounded(groups.from_column(plain_events(spark, sf_dir)).mean_by_mass("x", "temp"))


@query(f"{E}, m AS (SELECT grp, sum(mass) AS mass FROM e GROUP BY grp), k AS (SELECT floor((log10(mass) - 0e0) / 25e-2)::INT AS bin, count(*) AS n FROM m GROUP BY 1) SELECT bin, round((bin + 5e-1) * 25e-2, 6) AS mid, n, round(n / 25e2, 9) AS phi, round(sqrt(n) / 25e2, 9) AS err FROM k WHERE bin BETWEEN 0 AND 15")
def group_mass_function(spark, sf_dir):
    m = groups.from_column(plain_events(spark, sf_dir)).mass()
    return _rounded(groups.mass_function(m, 10000.0, 0.0, 4.0, 0.25), 9).withColumn("mid", F.round("mid", 6))


@query("SELECT r_regionkey AS halo, list_sort(list(n_nationkey))::VARCHAR AS children FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def group_children(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") + 100).alias("halo"), F.col("n_regionkey").cast("long").alias("parent"))
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("halo"), F.lit(None).cast("long").alias("parent"))
    s = plain_events(spark, sf_dir)
    c = groups.Catalogue(s, s.df.select(F.col("grp").alias("halo"), "pidx"), n.unionByName(r)).children().where("size(children) > 0")
    return c.select("halo", F.concat(F.lit("["), F.array_join(F.transform("children", lambda v: v - 100), ", "), F.lit("]")).alias("children"))


@query(f"{E} SELECT pidx FROM e WHERE grp = 7")
def group_view(spark, sf_dir):
    return groups.from_column(plain_events(spark, sf_dir)).halo(7).df.select("pidx")


# ---- neighbours and kernels


_F = E
_D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
# the 16 least of each row's pairs (distance, then number), without sorting all pairs
_NN = (
    f"{_F}, l AS (SELECT a.pidx, min(struct_pack(d2 := {_D2}, neighbour := b.pidx), 16) AS l FROM e a, e b GROUP BY a.pidx), "
    "k AS (SELECT pidx, l[i].neighbour AS neighbour, l[i].d2 AS d2, i::INT AS rank FROM (SELECT pidx, l, unnest(range(1, len(l) + 1)) AS i FROM l)), "
    "h AS (SELECT pidx, 5e-1 * sqrt(max(d2)) AS h FROM k GROUP BY pidx)"
)
_KW = "(CASE WHEN sqrt(d2) / h < 1 THEN 1 - 75e-2 * (2 - sqrt(d2) / h) * (sqrt(d2) / h) * (sqrt(d2) / h) WHEN sqrt(d2) / h < 2 THEN 25e-2 * power(2 - sqrt(d2) / h, 3) ELSE 0e0 END)"
_RHO = f"{_NN}, rho AS (SELECT k.pidx, sum(e.mass * {_KW} / (pi() * h * h * h)) AS rho FROM k JOIN h ON k.pidx = h.pidx JOIN e ON e.pidx = k.neighbour GROUP BY k.pidx)"
_SW = f"e.mass * {_KW} / (pi() * h * h * h) / rho.rho"
_SJ = "k JOIN h ON k.pidx = h.pidx JOIN e ON e.pidx = k.neighbour JOIN rho ON rho.pidx = k.neighbour"


@query(f"{_F} SELECT a.pidx, count(*) AS n FROM e a, e b WHERE {_D2} <= 36e2 GROUP BY a.pidx")
def ball_counts(spark, sf_dir):
    return neighbours.ball_counts(plain_events(spark, sf_dir), 60.0)


def _pw(d: str) -> str:
    return f"power(CASE WHEN {d} > 250e0 THEN {d} - 500e0 WHEN {d} < -250e0 THEN {d} + 500e0 ELSE {d} END, 2)"


@query(f"{_F} SELECT a.pidx, count(*) AS n FROM e a, e b WHERE {_pw('(b.x - a.x)')} + {_pw('(b.y - a.y)')} + {_pw('(b.z - a.z)')} <= 36e2 GROUP BY a.pidx")
def ball_counts_periodic(spark, sf_dir):
    return neighbours.ball_counts(events(spark, sf_dir, True), 60.0)


@query(f"{_NN} SELECT pidx, rank, round(d2, 6) AS d2 FROM k")
def nearest_neighbours(spark, sf_dir):
    return _rounded(neighbours.smoothing_neighbours(plain_events(spark, sf_dir), 16).select("pidx", "rank", "d2"))


@query(f"{_NN} SELECT pidx, round(h, 6) AS smooth FROM h")
def smoothing_length(spark, sf_dir):
    return _rounded(sph.smooth(plain_events(spark, sf_dir), 16))


@query(f"{_RHO} SELECT pidx, round(rho * 1e6, 6) AS rho FROM rho")
def sph_density(spark, sf_dir):
    d = sph.density(plain_events(spark, sf_dir), 16)
    return _rounded(d.select("pidx", (F.col("rho") * 1e6).alias("rho")))


@query(f"{_RHO} SELECT k.pidx, round(sum({_SW} * e.temp), 6) AS temp FROM {_SJ} GROUP BY k.pidx")
def sph_mean(spark, sf_dir):
    return _rounded(sph.sph_sum(plain_events(spark, sf_dir), "mean", "temp", 16))


@query(f"{_RHO}, t AS (SELECT k.pidx, {_SW} AS w, e.temp AS temp FROM {_SJ}), m AS (SELECT pidx, sum(w * temp) AS m FROM t GROUP BY pidx) SELECT pidx, round(sqrt(sum(w * (m - temp) * (m - temp))), 6) AS temp_disp FROM t JOIN m USING (pidx) GROUP BY pidx")
def sph_dispersion(spark, sf_dir):
    return _rounded(sph.sph_sum(plain_events(spark, sf_dir), "dispersion", "temp", 16))


_DK = "(CASE WHEN sqrt(d2) / h < 1 THEN -3 * sqrt(d2) / h + 225e-2 * d2 / (h * h) WHEN sqrt(d2) / h < 2 THEN -75e-2 * power(2 - sqrt(d2) / h, 2) ELSE 0e0 END)"
_SL = f"(CASE WHEN d2 > 0 THEN -e.mass / rho.rho * {_DK} / (pi() * h * h * h * h) / sqrt(d2) ELSE 0e0 END)"
_OWN = "JOIN e o ON o.pidx = k.pidx"


@query(f"{_RHO} SELECT k.pidx, round(sum({_SL} * ((e.x - o.x) * (e.vx - o.vx) + (e.y - o.y) * (e.vy - o.vy) + (e.z - o.z) * (e.vz - o.vz))), 6) + 0e0 AS vel_div FROM {_SJ} {_OWN} GROUP BY k.pidx")
def sph_divergence(spark, sf_dir):
    return _rounded(sph.sph_sum(plain_events(spark, sf_dir), "div", "vel", 16))


@query(f"{_RHO} SELECT k.pidx, round(sum({_SL} * ((e.y - o.y) * (e.vz - o.vz) - (e.z - o.z) * (e.vy - o.vy))), 6) + 0e0 AS vel_curl_x, round(sum({_SL} * ((e.z - o.z) * (e.vx - o.vx) - (e.x - o.x) * (e.vz - o.vz))), 6) + 0e0 AS vel_curl_y, round(sum({_SL} * ((e.x - o.x) * (e.vy - o.vy) - (e.y - o.y) * (e.vx - o.vx))), 6) + 0e0 AS vel_curl_z FROM {_SJ} {_OWN} GROUP BY k.pidx")
def sph_curl(spark, sf_dir):
    return _rounded(sph.sph_sum(plain_events(spark, sf_dir), "curl", "vel", 16))


# ---- gravity

_POINTS = [(float(i * 20 - 190), float(i * 13 - 100), float(i * 7 - 60)) for i in range(20)]
#: Rings of which the plane's gravity is asked: number, middle, width and area.
_RINGS = [(k, 40.0 + 80.0 * k, 80.0, math.pi * ((80.0 * k + 80.0) ** 2 - (80.0 * k) ** 2)) for k in range(3)]
_MID = (
    f"{E}, g(k, r, dr, area) AS (VALUES {', '.join(f'({k}, {r!r}::DOUBLE, {d!r}::DOUBLE, {a!r}::DOUBLE)' for k, r, d, a in _RINGS)}), c(cx, cy) AS (VALUES (1, 0), (0, 1), (-1, 0), (0, -1)), "
    "p AS (SELECT k, r, r * cx AS px, r * cy AS py FROM g, c), "
    "d AS (SELECT k, r, px, py, mass AS m, px - x AS dx, py - y AS dy, 1 / sqrt((px - x) * (px - x) + (py - y) * (py - y) + z * z) AS inv FROM p, e), "
    "a AS (SELECT k, r, px, py, sum(m * inv) AS s, sum(m * (px * dx + py * dy) * inv * inv * inv) AS f FROM d GROUP BY ALL), "
    "v AS (SELECT k, r, sqrt(greatest(avg(f), 0e0)) AS v, avg(-s) AS pot FROM a GROUP BY k, r), "
    f"i AS (SELECT floor({RXY} / 80e0)::INT AS k, sum(mass) AS mass, sum(mass * (x * vx + y * vy + z * vz) / {R}) / sum(mass) AS m1, sum(mass * power((x * vx + y * vy + z * vz) / {R}, 2)) / sum(mass) AS m2 FROM e WHERE {RXY} < 24e1 GROUP BY 1), "
    "o AS (SELECT k, r, v, pot, v / r AS omega, power(v / r, 2) AS o2, dr, mass / area AS density, sqrt(greatest(m2 - m1 * m1, 0e0)) AS vr_disp FROM v JOIN g USING (k, r) JOIN i USING (k)), "
    "w AS (SELECT *, r * coalesce((lead(o2) OVER t - lag(o2) OVER t) / 2 / dr, (lead(o2) OVER t - o2) / dr, (o2 - lag(o2) OVER t) / dr) + 4 * o2 AS k2 FROM o WINDOW t AS (ORDER BY k)), "
    "q AS (SELECT k AS bin, v AS v_circ, v AS v_circ_total, pot, omega, v * r AS j_circ, 5e-1 * v * v + pot AS E_circ, CASE WHEN k2 < 0 THEN 'nan'::DOUBLE ELSE sqrt(greatest(k2, 0e0)) END AS kappa, density, vr_disp, r FROM w)"
)


@query(_round_sql(f"{_MID}, z AS (SELECT *, vr_disp * kappa / (336e-2 * density) AS Q, kappa * kappa * r / (4 * pi() * density) AS X FROM q)", "v_circ, v_circ_total, pot, omega, j_circ, E_circ, kappa, Q, X", "bin", "z"))
def profile_midplane(spark, sf_dir):
    p = Profile(plain_events(spark, sf_dir), edges=[0.0, 80.0, 160.0, 240.0], ndim=2)
    return _rounded(p.table("v_circ", "v_circ_total", "pot", "omega", "j_circ", "E_circ", "kappa", "Q", "X").drop("rbins"))


@query(_round_sql(f"{E}, l AS (SELECT floor({RXY} / 80e0)::INT AS bin, -25e-1 * log10(sum(power(1e1, -4e-1 * (temp * 1e-3)))) AS m FROM e WHERE {RXY} < 24e1 GROUP BY 1), q AS (SELECT bin, m AS mag, m + 25e-1 * log10(pi() * (power(80e0 * bin + 80e0, 2) - power(80e0 * bin, 2)) * 1e6 / 2.3504430539466191e-9) AS sb FROM l)", "mag, sb", "bin"))
def profile_light(spark, sf_dir):
    s = plain_events(spark, sf_dir)
    p = Profile(s.with_column("b_mag", s.col("temp") * 1e-3), edges=[0.0, 80.0, 160.0, 240.0], ndim=2)
    return _rounded(p.table("magnitudes,b", "sb_b").select("bin", F.col("`magnitudes,b`").alias("mag"), F.col("sb_b").alias("sb")))


@query(f"{E}, g AS (SELECT pidx, row_number() OVER (ORDER BY pidx) - 1 AS i, count(*) OVER () AS n FROM e WHERE family = 'gas' AND temp > 5e3) SELECT pidx FROM g WHERE i >= 20 AND i < n - 30 AND (i - 20) % 4 = 0")
def view_slice_of_view(spark, sf_dir):
    return plain_events(spark, sf_dir).where(filters.HighPass("temp", 5e3)).gas[20:-30:4].df.select("pidx")


_PV = f"{E}, p(point, px, py, pz) AS (VALUES {', '.join(f'({i}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)' for i, (x, y, z) in enumerate(_POINTS))}), d AS (SELECT point, mass AS m, px - x AS dx, py - y AS dy, pz - z AS dz, 1 / sqrt((px - x) * (px - x) + (py - y) * (py - y) + (pz - z) * (pz - z) + 4e0) AS inv FROM p, e)"


@query(_round_sql(f"{_PV}, q AS (SELECT point, -sum(m * inv) AS phi, -sum(m * dx * inv * inv * inv) AS ax, -sum(m * dy * inv * inv * inv) AS ay, -sum(m * dz * inv * inv * inv) AS az FROM d GROUP BY point)", "phi, ax, ay, az", "point"))
def gravity_direct(spark, sf_dir):
    return _rounded(gravity.direct(plain_events(spark, sf_dir), _POINTS, 2.0))


_RADII = [20.0, 60.0, 100.0, 140.0, 180.0]
_RV = f"{E}, g(k, r) AS (VALUES {', '.join(f'({i}, {r!r}::DOUBLE)' for i, r in enumerate(_RADII))}), c(cx, cy) AS (VALUES (1, 0), (0, 1), (-1, 0), (0, -1)), p AS (SELECT k, r, r * cx AS px, r * cy AS py FROM g, c), d AS (SELECT k, r, px, py, mass AS m, px - x AS dx, py - y AS dy, 1 / sqrt((px - x) * (px - x) + (py - y) * (py - y) + z * z + 4e0) AS inv FROM p, e), a AS (SELECT k, r, px, py, sum(m * inv) AS s, sum(m * (px * dx + py * dy) * inv * inv * inv) AS f FROM d GROUP BY ALL)"


@query(_round_sql(f"{_RV}, q AS (SELECT k, r, sqrt(greatest(avg(f), 0e0)) AS v_circ FROM a GROUP BY k, r)", "r, v_circ", "k"))
def gravity_rotation_curve(spark, sf_dir):
    return _rounded(gravity.rotation_curve(plain_events(spark, sf_dir), _RADII, 2.0))


@query(_round_sql(f"{_RV}, q AS (SELECT k, r, avg(-s) AS pot FROM a GROUP BY k, r)", "r, pot", "k"))
def gravity_midplane_potential(spark, sf_dir):
    return _rounded(gravity.midplane_potential(plain_events(spark, sf_dir), _RADII, 2.0))


@query(_round_sql(f"{_F}, q AS (SELECT a.pidx, -sum(b.mass / sqrt({_D2} + 4e0)) AS phi FROM e a, e b GROUP BY a.pidx)", "phi", "pidx"))
def gravity_all(spark, sf_dir):
    return _rounded(gravity.all_direct(plain_events(spark, sf_dir), 2.0, force=False))


# ---- transformations and structure


@query(_round_sql(f"{E}, q AS (SELECT pidx, (x + 1e1) * cos(radians(30e0)) - (y - 2e1) * sin(radians(30e0)) AS x, (x + 1e1) * sin(radians(30e0)) + (y - 2e1) * cos(radians(30e0)) AS y, z + 5e0 AS z, vx * cos(radians(30e0)) - vy * sin(radians(30e0)) AS vx FROM e)", "x, y, z, vx", "pidx"))
def transform_rotate(spark, sf_dir):
    s = transform.rotate_z(transform.translate(plain_events(spark, sf_dir), (10, -20, 5)), 30)
    return _rounded(s.df.select("pidx", "x", "y", "z", "vx"))


@query(f"{E} SELECT pidx, round(x, 6) + 0e0 AS x, round(y, 6) + 0e0 AS y, round(z, 6) + 0e0 AS z FROM e")
def transform_revert(spark, sf_dir):
    s = transform.rotate_x(transform.translate(plain_events(spark, sf_dir), (10, -20, 5)), 75)
    return _rounded(transform.revert(transform.revert(s)).df.select("pidx", "x", "y", "z"))


@query(_round_sql(f"{E}, q AS (SELECT sum(mass * (y * vz - z * vy)) AS lx, sum(mass * (z * vx - x * vz)) AS ly, sum(mass * (x * vy - y * vx)) AS lz FROM e)", "lx, ly, lz", ""))
def angular_momentum(spark, sf_dir):
    s = plain_events(spark, sf_dir)
    v = structure.angular_momentum(s)
    return _rounded(spark.createDataFrame([tuple(map(float, v))], "lx double, ly double, lz double"))


@query(_round_sql(f"{E}, q AS (SELECT sqrt((power(sum(mass * (y * vz - z * vy)), 2) + power(sum(mass * (z * vx - x * vz)), 2) + power(sum(mass * (x * vy - y * vx)), 2)) / (2 * power(sum(mass), 3) * max({R}))) AS spin FROM e)", "spin", ""))
def spin(spark, sf_dir):
    return _rounded(spark.createDataFrame([(structure.spin_parameter(plain_events(spark, sf_dir)),)], "spin double"))


_MEAN = "sum(mass * x) / sum(mass) AS x, sum(mass * y) / sum(mass) AS y, sum(mass * z) / sum(mass) AS z"


@query(_round_sql(f"{E.replace('WITH', 'WITH RECURSIVE')}, s AS (SELECT 0 AS step, {_MEAN}, 5e-1 * (max(x) - min(x)) AS r FROM e UNION ALL SELECT s.step + 1, t.x, t.y, t.z, r * 0.7e0 FROM s, LATERAL (SELECT count(*) AS n, {_MEAN} FROM e WHERE (e.x - s.x) * (e.x - s.x) + (e.y - s.y) * (e.y - s.y) + (e.z - s.z) * (e.z - s.z) < s.r * s.r) t WHERE n >= 100), q AS (SELECT x, y, z FROM s ORDER BY step DESC LIMIT 1)", "x, y, z", ""))
def center_shrink_sphere(spark, sf_dir):
    c = structure.shrink_sphere(plain_events(spark, sf_dir))
    return _rounded(spark.createDataFrame([tuple(map(float, c))], "x double, y double, z double"))


@query(f"{E}, c AS (SELECT {R} AS r, sum(mass) OVER (ORDER BY {R}) AS m FROM e), k AS (SELECT r, power(m / (4 / 3e0 * pi() * 178e-6), 1 / 3e0) AS v, lead(r) OVER (ORDER BY r) AS next FROM c) SELECT round(min(greatest(v, r)), 4) AS r FROM k WHERE v < next OR next IS NULL")
def virial_radius(spark, sf_dir):
    return _rounded(spark.createDataFrame([(structure.virial_radius(plain_events(spark, sf_dir), 1e-6),)], "r double"), 4)


@query()
def shape_shells(spark, sf_dir):
    got = structure.shape(plain_events(spark, sf_dir), 4, bins="lin", least=20.0, most=220.0)
    return spark.createDataFrame([(float(t["inner"]), float(t["outer"]), t["n"], float(t["ba"]), float(t["ca"])) for t in got], "lo double, hi double, n long, ba double, ca double")


@query()
def decomposition(spark, sf_dir):
    s = structure.decompose(plain_events(spark, sf_dir), per_bin=200)
    return s.df.groupBy("decomp").agg(F.count(F.lit(1)).alias("n"))


_KDE = (
    f"{E}, c AS (SELECT least(floor((x + 2e2) / 2e1), 19)::INT AS ix, least(floor((y + 2e2) / 2e1), 19)::INT AS iy FROM e WHERE x >= -2e2 AND x <= 2e2 AND y >= -2e2 AND y <= 2e2), "
    "h AS (SELECT ix, iy, count(*) AS h FROM c GROUP BY ix, iy), "
    "m AS (SELECT count(*)::DOUBLE AS n, var_samp(ix) AS xx, var_samp(iy) AS yy, covar_samp(ix, iy) AS xy, power(count(*), -1 / 3e0) AS s FROM c), "
    "k AS (SELECT *, round(sqrt(s) * 2 * pi() * sqrt(xx))::INT // 2 AS rx, round(sqrt(s) * 2 * pi() * sqrt(yy))::INT // 2 AS ry, (xx * yy - xy * xy) * s AS d FROM m), "
    "g AS (SELECT unnest(range(20))::INT AS i), "
    "q AS (SELECT a.i AS ix, b.i AS iy, sum(h * exp(-(power(a.i - h.ix, 2) * yy - 2 * (a.i - h.ix) * (b.i - h.iy) * xy + power(b.i - h.iy, 2) * xx) / d / 2)) / (2 * pi() * sqrt(s * d)) AS value "
    "FROM g a, g b, h, k WHERE abs(a.i - h.ix) <= rx AND abs(b.i - h.iy) <= ry GROUP BY a.i, b.i, s, d)"
)


@query(_round_sql(_KDE, "value", "ix, iy"))
def kde_map(spark, sf_dir):
    return _rounded(hist.kde(plain_events(spark, sf_dir), "x", "y", 20, 20, (-200.0, 200.0, -200.0, 200.0)))


# ---- rendering


_PX = "WITH e0 AS (%s), e AS (SELECT * FROM e0), g AS (SELECT unnest(range(16))::INT AS i), p AS (SELECT a.i AS px, b.i AS py, a.i * 25e0 - 1875e-1 AS gx, b.i * 25e0 - 1875e-1 AS gy FROM g a, g b)" % EVENTS_SQL


def _kq(q: str) -> str:
    return f"(CASE WHEN {q} < 1 THEN 1 - 75e-2 * (2 - {q}) * {q} * {q} WHEN {q} < 2 THEN 25e-2 * power(2 - {q}, 3) ELSE 0e0 END)"


_Q = "(sqrt((gx - x) * (gx - x) + (gy - y) * (gy - y) + (z - 1e1) * (z - 1e1)) / smooth)"


@query(_round_sql(f"{_PX}, v AS (SELECT px, py, sum(temp * mass / rho * {_kq(_Q)} / (pi() * smooth * smooth * smooth)) AS value FROM p, e WHERE (gx - x) * (gx - x) + (gy - y) * (gy - y) + (z - 1e1) * (z - 1e1) < 4 * smooth * smooth GROUP BY px, py), q AS (SELECT * FROM v WHERE value <> 0)", "value", "px, py"))
def render_slice(spark, sf_dir):
    return _rounded(render.image(plain_events(spark, sf_dir), "temp", 400.0, 16, z=10.0))


_TABLE = "[" + ", ".join(f"{v!r}" for v in sph.projected(sph.CUBIC)) + "]"
_PH = "greatest(smooth, 125e-1)"
_PK = f"floor(201 * ((gx - x) * (gx - x) + (gy - y) * (gy - y)) / (4 * {_PH} * {_PH}))::INT"


def _projected(q: str, name: str) -> str:
    return f"{name} AS (SELECT px, py, sum({q} * mass / rho * ({_TABLE})[{_PK} + 1] / ({_PH} * {_PH})) AS value FROM p, e WHERE {_PK} < 201 GROUP BY px, py HAVING value <> 0)"


# of two levels: kernels under 75 wide on 16 pixels a side, the others on 4, enlarged
_LEVELS = (
    f"{_PX}, a AS (SELECT px, py, sum(temp * mass / rho * {_kq(_Q)} / (pi() * smooth * smooth * smooth)) AS value FROM p, (SELECT * REPLACE (smooth * 6 AS smooth) FROM e) e WHERE smooth < 1e2 GROUP BY px, py HAVING value <> 0), "
    f"c AS (SELECT px, py, px * 1e2 - 150e0 AS gx, py * 1e2 - 150e0 AS gy FROM (SELECT px, py FROM p WHERE px < 4 AND py < 4)), "
    f"b AS (SELECT px, py, sum(temp * mass / rho * {_kq(_Q)} / (pi() * smooth * smooth * smooth)) AS value FROM c, (SELECT * REPLACE (smooth * 6 AS smooth) FROM e) e WHERE smooth >= 1e2 GROUP BY px, py HAVING value <> 0), "
    "f AS (SELECT p.px, p.py, sum(b.value * greatest(0e0, 1 - abs((p.px + 5e-1) / 4 - 5e-1 - b.px)) * greatest(0e0, 1 - abs((p.py + 5e-1) / 4 - 5e-1 - b.py))) AS value FROM p, b GROUP BY ALL), "
    "q AS (SELECT px, py, sum(value) AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM f) GROUP BY px, py HAVING sum(value) <> 0)"
)


@query(_round_sql(_LEVELS, "value", "px, py"))
def render_levels(spark, sf_dir):
    """Kernels six times as wide, half of them on coarser pixels."""
    s = plain_events(spark, sf_dir)
    return _rounded(render.approximate(s.with_column("smooth", F.col("smooth") * 6), "temp", 400.0, 16, 2, 4, z=10.0))


@query(_round_sql(f"{_PX}, {_projected('temp', 'q')}", "value", "px, py"))
def render_projection(spark, sf_dir):
    return _rounded(render.image(plain_events(spark, sf_dir), "temp", 400.0, 16, project=True))


@query(_round_sql(f"{_PX}, {_projected('temp * rho', 'a')}, {_projected('rho', 'b')}, q AS (SELECT px, py, a.value / nullif(b.value, 0e0) AS value FROM a JOIN b USING (px, py))", "value", "px, py"))
def render_weighted(spark, sf_dir):
    return _rounded(render.image(plain_events(spark, sf_dir), "temp", 400.0, 16, weight="rho"))


_VOXELS = "g AS (SELECT unnest(range(8))::INT AS i), p AS (SELECT a.i AS px, b.i AS py, c.i AS pz, a.i * 5e1 - 175e0 AS gx, b.i * 5e1 - 175e0 AS gy, c.i * 5e1 - 175e0 AS gz FROM g a, g b, g c)"
_VQ = "(sqrt((gx - x) * (gx - x) + (gy - y) * (gy - y) + (gz - z) * (gz - z)) / smooth)"


@query(_round_sql(f"{E}, {_VOXELS}, q AS (SELECT px, py, pz, sum(temp * mass / rho * {_kq(_VQ)} / (pi() * smooth * smooth * smooth)) AS value FROM p, e WHERE (gx - x) * (gx - x) + (gy - y) * (gy - y) + (gz - z) * (gz - z) < 4 * smooth * smooth GROUP BY px, py, pz HAVING value <> 0)", "value", "px, py, pz"))
def render_grid(spark, sf_dir):
    return _rounded(render.grid(plain_events(spark, sf_dir), "temp", 400.0, 8))


# middles of the 768 pixels of 31 rings
_SKY = (
    "i AS (SELECT unnest(range(1, 32))::BIGINT AS i), "
    "j AS (SELECT CASE WHEN i < 8 THEN 4 * i WHEN i <= 24 THEN 32 ELSE 4 * (32 - i) END AS n, CASE WHEN i < 8 THEN 2 * i * (i - 1) WHEN i <= 24 THEN 112 + (i - 8) * 32 ELSE 768 - 2 * (32 - i) * (33 - i) END AS first, "
    "CASE WHEN i < 8 THEN 1 - i * i / 192e0 WHEN i <= 24 THEN (16 - i) / 12e0 ELSE (32 - i) * (32 - i) / 192e0 - 1 END AS pz, CASE WHEN i > 8 AND i < 24 AND i % 2 = 1 THEN 0e0 ELSE 5e-1 END AS place FROM i), "
    "k AS (SELECT first + k AS pix, pz, (k + place) * (2 * pi() / n) AS phi FROM (SELECT *, unnest(range(n)) AS k FROM j)), "
    "u AS (SELECT pix, sqrt(1 - pz * pz) * cos(phi) AS px, sqrt(1 - pz * pz) * sin(phi) AS py, pz FROM k), "
    f"d AS (SELECT pix, rho * mass / rho AS q, {R} AS r, smooth AS h, 2 * asin(least(sqrt(power(px - x / {R}, 2) + power(py - y / {R}, 2) + power(pz - z / {R}, 2)) / 2, 1e0)) AS angle FROM u, e WHERE {R} > 0), "
)


@query(_round_sql(f"{E}, {_SKY} q AS (SELECT pix, sum(q * ({_TABLE})[floor(201 * (r * angle / (2 * h)) * (r * angle / (2 * h)))::INT + 1] * (r / h) * (r / h)) AS value FROM d WHERE angle <= least(2 * h / r, pi()) AND 201 * (r * angle / (2 * h)) * (r * angle / (2 * h)) < 201 GROUP BY pix HAVING value <> 0)", "value", "pix"))
def render_sky(spark, sf_dir):
    return _rounded(render.sky(plain_events(spark, sf_dir), 8))


# ---- units, lattices, ids and offsets


@query(f"{E} SELECT pidx, round(x * 1e3, 6) + 0e0 AS x, round(vx * 1e3, 6) + 0e0 AS vx, round(temp, 6) + 0e0 AS temp FROM e")
def physical_units(spark, sf_dir):
    return _rounded(events(spark, sf_dir).physical_units("pc", "m s^-1", "Msol").df.select("pidx", "x", "vx", "temp"))


@query("SELECT event_id AS pidx, (event_id % 10) + 5e-1 AS x, ((event_id // 10) % 12) + 5e-1 AS y, (event_id // 120) + 5e-1 AS z, value * 1e-2 AS dx FROM events")
def lattice_places(spark, sf_dir):
    """Events as displacements of the places that their numbers have on a lattice."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_id", "pidx")
    x, y, z = lattice.places(F.col("pidx"), 10, 12, 5)
    return e.select("pidx", x.alias("x"), y.alias("y"), z.alias("z"), (F.col("value") * 1e-2).alias("dx"))


@query(f"{E}, h AS (SELECT c_custkey AS halo, (c_custkey - 1) * 7 AS o, 10 + c_custkey % 5 AS l FROM customer) SELECT halo, pidx FROM h JOIN e ON pidx >= o AND pidx < o + l")
def group_offsets(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    h = c.select(F.col("c_custkey").alias("halo"), ((F.col("c_custkey") - 1) * 7).alias("offset"), (F.lit(10) + F.col("c_custkey") % 5).alias("length"))
    return groups.from_offsets(plain_events(spark, sf_dir), h).members.select("halo", "pidx")


@query(f"{E}, k AS (SELECT pidx, iord * 9000001 AS i, mass AS m FROM e) SELECT pidx, (CASE WHEN i % 4294967296 >= 2147483648 THEN i % 4294967296 - 4294967296 ELSE i % 4294967296 END) + (1 + floor(log2(m)) - 2)::BIGINT * 4294967296 AS id FROM k")
def bridge_repaired_ids(spark, sf_dir):
    s = plain_events(spark, sf_dir)
    return s.df.select("pidx", bridge.repaired_id(F.col("iord") * 9000001, F.col("mass"), 2).alias("id"))


@query(f"{E} SELECT iord, pidx FROM e WHERE iord % 7 = 0 UNION ALL SELECT -1, NULL")
def ids_to_rows(spark, sf_dir):
    s = plain_events(spark, sf_dir)
    ids = s.df.where("iord % 7 = 0").select("iord").unionByName(spark.range(1).select((F.col("id") - 1).alias("iord")))
    return bridge.ids_to_rows(s, ids)


@query(_round_sql(f"{_P3}, k AS (SELECT bin, temp, sum(mass) OVER (PARTITION BY bin ORDER BY temp, mass ROWS UNBOUNDED PRECEDING) AS c FROM p WHERE inside), f AS (SELECT bin, temp, coalesce((c - min(c) OVER (PARTITION BY bin)) / nullif(max(c) OVER (PARTITION BY bin) - min(c) OVER (PARTITION BY bin), 0e0), 0e0) AS f FROM k), g AS (SELECT bin, max(f) FILTER (f <= 5e-1) AS f0, arg_max(temp, f) FILTER (f <= 5e-1) AS v0, min(f) FILTER (f > 5e-1) AS f1, arg_min(temp, f) FILTER (f > 5e-1) AS v1 FROM f GROUP BY bin), q AS (SELECT bin, v0 + coalesce((5e-1 - f0) * (v1 - v0) / nullif(f1 - f0, 0e0), 0e0) AS q50 FROM g)", "q50", "bin"))
def profile_weighted_median(spark, sf_dir):
    return _rounded(_profile3(spark, sf_dir).weighted_quantiles("temp", "mass", (0.5,)))


@query(f"{E} SELECT grp, min(pidx) AS first, count(*) AS n FROM e GROUP BY grp")
def group_boundaries(spark, sf_dir):
    return groups.boundaries(plain_events(spark, sf_dir).df, "grp")


@query(f"{_GR}, s AS (SELECT halo FROM n WHERE halo IN (1000001, 1000002, 5)) SELECT halo, n FROM n JOIN s USING (halo)")
def group_subset(spark, sf_dir):
    return _overlapping(plain_events(spark, sf_dir)).subset([1000001, 1000002, 5]).sizes().select("halo", "n")


@query(f"{E} SELECT pidx, round(x + 2e-2 * vx, 6) + 0e0 AS x, round(vx + 7e-2 * x, 6) + 0e0 AS vx FROM e")
def transform_hubble(spark, sf_dir):
    s = transform.add_hubble(plain_events(spark, sf_dir), 0.07)
    return _rounded(s.df.select("pidx", (F.col("x") + 0.02 * (F.col("vx") - 0.07 * F.col("x"))).alias("x"), "vx"))


@query(f"{E}, f AS (SELECT pidx, family, row_number() OVER (PARTITION BY family ORDER BY pidx) - 1 AS place FROM e), h AS (SELECT c_custkey AS halo, CASE WHEN c_custkey % 2 = 0 THEN 'gas' ELSE 'dm' END AS family, (c_custkey - 1) * 3 AS o, 5 + c_custkey % 4 AS l FROM customer) SELECT halo, pidx FROM h JOIN f ON h.family = f.family AND place >= o AND place < o + l")
def group_family_offsets(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    h = c.select(k.alias("halo"), F.when(k % 2 == 0, "gas").otherwise("dm").alias("family"), ((k - 1) * 3).alias("offset"), (F.lit(5) + k % 4).alias("length"))
    return groups.from_family_offsets(plain_events(spark, sf_dir), h).members.select("halo", "pidx")


@query(f"{E}, n AS (SELECT grp AS halo, count(*) AS n FROM e GROUP BY grp) SELECT halo, row_number() OVER (ORDER BY n DESC, halo) - 1 AS number FROM n")
def group_numbering(spark, sf_dir):
    s = plain_events(spark, sf_dir)
    return groups.numbering(groups.from_column(s).sizes().select("halo", "n"), "length-order")


@query(f"{E}, n AS (SELECT grp AS halo, count(*) AS n FROM e GROUP BY grp), k AS (SELECT halo, row_number() OVER (ORDER BY n DESC, halo) AS number FROM n) SELECT number AS halo, pidx FROM e JOIN k ON k.halo = e.grp")
def group_renumbered(spark, sf_dir):
    c = groups.from_column(plain_events(spark, sf_dir))
    return groups.renumbered(c, groups.numbering(c.sizes().select("halo", "n"), "length-order-v1")).members.select("halo", "pidx")


# ---- columns with units


@query(_round_sql(f"{E}, q AS (SELECT pidx, sqrt(vx * vx + vy * vy + vz * vz) * 1e3 AS speed, x + 1e3 AS shifted, 5e-1 * mass * (vx * vx + vy * vy + vz * vz) AS energy FROM e WHERE x > 1e-1)", "speed, shifted, energy", "pidx"))
def quantity_expressions(spark, sf_dir):
    s = events(spark, sf_dir)
    x, m = quantity.quantity(s, "x"), quantity.quantity(s, "mass")
    speed = quantity.norm(quantity.vector(s, "vel"))
    cols = {"speed": speed.in_units("m s^-1"), "shifted": x + as_unit("Mpc"), "energy": 0.5 * m * speed**2}
    return _rounded(s.where(x > "100 pc").df.select("pidx", *[q.column.alias(n) for n, q in cols.items()]))


@query(f"{E} SELECT pidx, round(sum(mass) OVER (ORDER BY pidx ROWS UNBOUNDED PRECEDING), 6) + 0e0 AS mass FROM e")
def quantity_cumsum(spark, sf_dir):
    return _rounded(quantity.cumsum(quantity.quantity(events(spark, sf_dir), "mass"), "mass"))


@query(f"{E}, w AS (SELECT pidx, x, lag(x) OVER (ORDER BY pidx) AS a, lead(x) OVER (ORDER BY pidx) AS b FROM e) SELECT pidx, round((coalesce(b, x) - coalesce(a, x)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) / 2e0, 6) + 0e0 AS gradient FROM w")
def quantity_gradient(spark, sf_dir):
    return _rounded(quantity.gradient(quantity.quantity(events(spark, sf_dir), "x"), 2.0)[0])


@query(f"{E}, w AS (SELECT pidx, lead(temp) OVER (ORDER BY pidx) - temp AS d FROM e) SELECT pidx, round(d, 6) + 0e0 AS diff FROM w WHERE d IS NOT NULL")
def row_differences(spark, sf_dir):
    return _rounded(quantity.difference(plain_events(spark, sf_dir), "temp"))


@query(f"{E}, g AS (SELECT log10(rho) AS r, log10(temp) AS t FROM e WHERE family = 'gas'), b AS (SELECT min(r) AS r0, max(r) AS r1, min(t) AS t0, max(t) AS t1 FROM g) SELECT least(floor((r - r0) * (13 / (r1 - r0))), 12)::INT AS ix, least(floor((t - t0) * (11 / (t1 - t0))), 10)::INT AS iy, count(*)::DOUBLE AS h FROM g, b GROUP BY ALL")
def density_temperature(spark, sf_dir):
    return hist.density_temperature(plain_events(spark, sf_dir), nx=13, ny=11)


@query(f"{E}, i AS (SELECT row_number() OVER (ORDER BY grp, pidx) - 1 AS place, pidx FROM e), h AS (SELECT row_number() OVER (ORDER BY pidx) - 1 AS place, pidx FROM e) SELECT h.pidx, i.pidx AS iord_argsort FROM h JOIN i USING (place)")
def row_order_of_ids(spark, sf_dir):
    # user ids, which many rows share, stand in for the ids
    s = plain_events(spark, sf_dir)
    return sph.row_order_of_ids(s.with_column("iord", F.col("grp")))


@query(f"{E}, t AS (SELECT CASE family WHEN 'gas' THEN 0 WHEN 'dm' THEN 1 ELSE 4 END AS t, family, iord, x, vy, mass, CASE WHEN family = 'star' THEN NULL ELSE rho END AS rho FROM e) SELECT row_number() OVER (ORDER BY t, iord) - 1 AS pidx, family, iord, round(x, 6) + 0e0 AS x, round(vy, 6) + 0e0 AS vy, mass, rho FROM t")
def code_tables(spark, sf_dir):
    """Events as the tables of a code, and back under the usual names."""
    e = plain_events(spark, sf_dir).df
    vec = lambda *c: F.array(*[F.col(k) for k in c])
    cols = [vec("x", "y", "z").alias("Coordinates"), vec("vx", "vy", "vz").alias("Velocities"), F.col("iord").alias("ParticleIDs"), F.col("mass").alias("Masses")]
    tables = {kind: e.where(F.col("family") == f).select(*cols, *([F.col("rho").alias("Densities")] if f != "star" else [])) for kind, f in (("PartType0", "gas"), ("PartType1", "dm"), ("PartType4", "star"))}
    return _rounded(names.from_tables(spark, tables, "swift").df.select("pidx", "family", "iord", "x", "vy", "mass", "rho"))


# ---- larger tables

_L = f"WITH e AS ({LINEITEM_SQL})"


@query(f"{_L} SELECT family, floor({R} / 5e0)::INT AS bin, count(*) AS n, round(sum(mass), 6) AS mass FROM e WHERE {R} < 5e1 GROUP BY ALL")
def items_family_profile(spark, sf_dir):
    s = items(spark, sf_dir).where(filters.LowPass("r", 50.0))
    k = F.floor(s.col("r") / 5).cast("int")
    return s.df.groupBy("family", k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mass"), 6).alias("mass"))


@query(f"{_L} SELECT family, bin, count(*) AS n, round(sum(mass), 6) AS mass FROM (SELECT family, floor({R} / 1e1)::INT AS bin, mass FROM e) GROUP BY ROLLUP (family, bin)")
def items_rollup(spark, sf_dir):
    s = items(spark, sf_dir)
    df = s.df.select("family", F.floor(s.col("r") / 10).cast("int").alias("bin"), "mass")
    return df.rollup("family", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mass"), 6).alias("mass"))


@query(f"{_L} SELECT halo, n, row_number() OVER (ORDER BY n DESC, halo)::INT AS rank FROM (SELECT grp AS halo, count(*) AS n FROM e GROUP BY grp)")
def items_group_ranks(spark, sf_dir):
    s = items(spark, sf_dir)
    return groups.ranked(s.df.groupBy(F.col("grp").alias("halo")).agg(F.count(F.lit(1)).alias("n")))


@query("SELECT label, count(*) AS n, round(avg(list_sum(list_transform(embedding, lambda a: a::DOUBLE * a::DOUBLE))), 6) AS norm2 FROM embeddings GROUP BY label")
def embedding_norms(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n2 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n2), 6).alias("norm2"))




__all__ = ["QUERIES", "SQL", "query"]
