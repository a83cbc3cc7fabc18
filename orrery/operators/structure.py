"""Centres, virial radius, angular momentum, shape and decomposition.

Iterations keep a handful of numbers on the driver and one aggregate in each pass."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..snapshot import ROW, Snapshot, at_most
from . import transform
from .filters import Disc
from .profile import Profile, bin_of, bin_quantiles, cumulated, equal_edges, gravity_constant, interpolated


#: Rows left in a bracket of radii that aren't worth another pass.
NEAR_ROWS = 100_000


def com(s: Snapshot) -> np.ndarray:
    """Centre of mass."""
    x, y, z = s.vector("pos")
    m = s.col("mass")
    return np.array(s.df.agg(*[F.sum(m * c) / F.sum(m) for c in (x, y, z)]).first(), float)


def shrink_sphere(s: Snapshot, r: float | None = None, shrink: float = 0.7, least: int = 100, with_velocity: int = 0, max_steps: int = 1000):
    """Centre of mass within a sphere that shrinks onto it until it has fewer than `least`
    rows; the last centre.  With `with_velocity` rows or more left, their mean velocity
    comes, too.  Each step is one aggregate over the rows that the last left."""
    x, y, z = s.vector("pos")
    vx, vy, vz = s.vector("vel")
    cols = [c.cast("double").alias(n) for c, n in zip((x, y, z, s.col("mass"), vx, vy, vz), ("x", "y", "z", "m", "vx", "vy", "vz"), strict=True)]
    rows = s.df.select(*cols).persist()
    try:
        lo, hi = rows.agg(F.min("x"), F.max("x")).first()
        radius = 0.5 * (hi - lo) if r is None else float(r)
        mean = [F.sum(F.col("m") * F.col(c)) / F.sum("m") for c in ("x", "y", "z", "vx", "vy", "vz")]
        got = rows.agg(F.count(F.lit(1)), *mean).first()
        centre, velocity = np.array(got[1:4], float), np.array(got[4:7], float)
        for _ in range(max_steps):
            d = [F.col(c) - F.lit(float(v)) for c, v in zip("xyz", centre, strict=True)]
            got = rows.where(sum(v * v for v in d) < radius * radius).agg(F.count(F.lit(1)), *mean).first()
            if got[0] < least or got[1] is None:
                break
            centre = np.array(got[1:4], float)
            if got[0] >= with_velocity:
                velocity = np.array(got[4:7], float)
            radius *= shrink
        return (centre, velocity) if with_velocity else centre
    finally:
        rows.unpersist()


def potential_minimum(s: Snapshot) -> np.ndarray:
    """Position of the row of least phi."""
    x, y, z = s.vector("pos")
    return np.array(s.df.agg(F.min_by(F.struct(x, y, z), F.struct(s.col("phi"), F.col(ROW)))).first()[0], float)


def hybrid_centre(s: Snapshot, r: float) -> np.ndarray:
    """A shrinking sphere's centre around the least potential, or around the centre of
    mass where there is no phi."""
    near = potential_minimum(s) if s.has_key("phi") else com(s)
    moved = transform.translate(s, -near)
    small = moved.where(moved.col("r") < float(r))
    return near + shrink_sphere(small, r)


def velocity_centre(s: Snapshot, size: float) -> np.ndarray | None:
    """Mean velocity within a sphere at the origin, of stars, else dark matter, else gas,
    whichever has five rows first."""
    vx, vy, vz = s.vector("vel")
    m = s.col("mass")
    near = s.df.where(s.col("r") < float(size)).groupBy("family").agg(F.count(F.lit(1)).alias("n"), *[(F.sum(m * c) / F.sum(m)).alias(k) for k, c in zip(("vx", "vy", "vz"), (vx, vy, vz), strict=True)])
    got = {r["family"]: r for r in near.where("family in ('star', 'dm', 'gas')").collect()}
    for f in ("star", "dm", "gas"):
        if f in got and got[f]["n"] >= 5:
            return np.array([got[f][k] for k in ("vx", "vy", "vz")], float)
    return None


def center(s: Snapshot, mode: str | Callable = "ssc", size: float = 1.0, with_velocity: bool = True, wrap: bool = False) -> Snapshot:
    """The snapshot moved so that its centre is the origin, and at rest there."""
    if wrap:
        s = s.wrap()
    if callable(mode):
        at = np.asarray(mode(s), float)
    else:
        at = {"pot": potential_minimum, "com": com, "ssc": shrink_sphere, "hyb": lambda t: hybrid_centre(t, 3.0)}[mode](s)
    out = transform.translate(s, -at)
    if with_velocity and (v := velocity_centre(out, size)) is not None:
        out = transform.offset_velocity(out, -v)
    return out


def virial_radius(s: Snapshot, mean_density: float, overdensity: float = 178.0, r_max: float | None = None, bins: int = 512, passes: int = 4) -> float:
    """Radius at which the mean density first falls to a multiple of a reference density, of
    radii from the innermost row on: between two rows where it crosses there, beyond the last
    row (but not beyond `r_max`) if it is above as far as that.

    A pass sums the mass in shells and narrows the bracket to those from the first in which
    the density may fall to the first by whose end it has; what is left is summed row by row,
    in ranges of the radius."""
    r, m = s.col("r"), s.col("mass")
    rows = s.df.select(r.cast("double").alias("r"), m.cast("double").alias("m")).where("r is not null")
    least, most = rows.agg(F.min("r"), F.max("r")).first()
    lo, hi, inner = 0.0, float(r_max) if r_max else float(np.nextafter(most, np.inf)), 0.0
    scale = 4 / 3 * math.pi * overdensity * mean_density
    if not scale > 0:
        return float(r_max or most)
    for _ in range(passes):
        edges = np.linspace(lo, hi, bins + 1)
        if not (np.diff(edges) > 0).all():
            break
        k = at_most(F.lit(edges[1:-1]), bins - 1, F.col("r"))
        got = {i: (n, v or 0.0) for i, n, v in rows.where((F.col("r") >= lo) & (F.col("r") < hi)).groupBy(k.alias("k")).agg(F.count(F.lit(1)), F.sum("m")).collect()}
        total, first, left = inner, None, 0
        for i, edge in enumerate(edges[1:].tolist()):
            n, mass = got.get(i, (0, 0.0))
            if first is None and edge > least and math.cbrt(total / scale) < edge:
                first, before = float(edges[i]), total
            total, left = total + mass, left + n if first is not None else 0
            if first is not None and math.cbrt(total / scale) < edge:
                break
        if first is None:
            return max(min(math.cbrt(total / scale), float(r_max or np.inf)), least)
        lo, hi, inner = first, edge, before
        if left <= NEAR_ROWS:
            break
    near = rows.where((F.col("r") >= lo) & (F.col("r") < hi)).groupBy("r").agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("m"))
    run = cumulated(near.select(F.lit(0).alias("one"), "r", "m").withColumn("__k", F.struct("one", "r")), "__k", "one", F.col("m"))
    before = F.col("upto") - F.col("m") + inner
    fallen = (F.col("r") > least) & (F.cbrt(before / scale) < F.col("r"))
    at, whole = run.agg(F.min(F.when(fallen, before)), F.sum("m")).first()
    radius = math.cbrt((inner + (whole or 0.0) if at is None else at) / scale)
    return max(min(radius, float(r_max or np.inf)), least)


def angular_momentum(s: Snapshot) -> np.ndarray:
    m = s.col("mass")
    return np.array(s.df.agg(*[F.sum(m * c) for c in s.vector("j")]).first(), float)


def spin_parameter(s: Snapshot) -> float:
    """sqrt(L^2 / (2 G M^3 R)) with R the outermost row's radius."""
    m = s.col("mass")
    lx, ly, lz, mass, r = s.df.agg(*[F.sum(m * c) for c in s.vector("j")], F.sum(m), F.max(s.col("r"))).first()
    return math.sqrt((lx * lx + ly * ly + lz * lz) / (2 * gravity_constant(s) * mass**3 * r))


def faceon_matrix(l: np.ndarray, up=(0.0, 1.0, 0.0)) -> np.ndarray:  # noqa: E741
    """Rotation that turns a vector onto z."""
    z = np.asarray(l, float) / np.linalg.norm(l)
    y = np.asarray(up, float)
    x = np.cross(y, z)
    x /= np.linalg.norm(x)
    return np.stack([x, np.cross(z, x), z])


def sideon_matrix(l: np.ndarray, along=(1.0, 0.0, 0.0)) -> np.ndarray:  # noqa: E741
    """Rotation that turns a vector onto y."""
    y = np.asarray(l, float) / np.linalg.norm(l)
    z = np.cross(np.asarray(along, float), y)
    z /= np.linalg.norm(z)
    return np.stack([np.cross(y, z), y, z])


def align(s: Snapshot, matrix: Callable = faceon_matrix, disc: float = 5.0, centred: bool = False) -> Snapshot:
    """Centred, and turned by the angular momentum of the gas (else stars, else all) near
    the centre."""
    out = s if centred else center(s)
    near = out.where(out.col("r") < float(disc))
    n = {r["family"]: r["n"] for r in near.df.groupBy("family").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = near.gas if n.get("gas", 0) > 5 else near.star if n.get("star", 0) > 5 else near
    return transform.rotate(out, matrix(angular_momentum(part)))


def shape(s: Snapshot, nbins: int = 10, least: float | None = None, most: float | None = None, bins: str = "equal", max_steps: int = 10, tol: float = 1e-3) -> list[dict]:
    """Axis lengths and axes of shells that take the shape of the mass in them.

    All shells are iterated together: a pass is one aggregate of the nine second moments
    in each shell that hasn't settled."""
    lo, hi = s.df.agg(F.min(s.col("r")), F.max(s.col("r"))).first()
    lo, hi = least if least is not None else max(lo, 1e-9), most if most is not None else hi
    view = s.where((s.col("r") >= lo) & (s.col("r") <= hi))
    if bins == "equal":
        edges = equal_edges(view.df.select(view.col("r").alias("r")), "r", nbins)
    else:
        edges = (np.linspace(lo, hi, nbins + 1) if bins == "lin" else np.geomspace(lo, hi, nbins + 1)).tolist()
    x, y, z = s.vector("pos")
    rows = s.df.select(x.alias("x"), y.alias("y"), z.alias("z"), s.col("mass").alias("m"))
    state = [{"inner": a, "outer": b, "axes": np.eye(3), "ratio": np.ones(3), "n": 0, "done": False} for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for _ in range(max_steps):
        work = [(i, t) for i, t in enumerate(state) if not t["done"]]
        if not work:
            break
        table = s.spark.createDataFrame([(i, t["inner"], t["outer"], *map(float, t["axes"].ravel()), *map(float, t["ratio"])) for i, t in work], "k int, a double, b double, " + ", ".join(f"e{j} double" for j in range(9)) + ", r0 double, r1 double, r2 double")
        pairs = rows.join(F.broadcast(table))
        along = [sum(F.col(f"e{3 * j + c}") * F.col(n) for c, n in enumerate("xyz")) / F.col(f"r{j}") for j in range(3)]
        rad = F.sqrt(sum(v * v for v in along))
        inside = pairs.where((rad >= F.col("a")) & (rad < F.col("b")))
        moments = [F.sum(F.col("m") * F.col(p) * F.col(q)) / F.sum("m") for p in "xyz" for q in "xyz"]
        got = {r[0]: r for r in inside.groupBy("k").agg(F.count(F.lit(1)), *moments).collect()}
        for i, t in work:
            if i not in got or got[i][1] < 4:
                t["done"] = True
                continue
            values, vectors = np.linalg.eigh(np.array(got[i][2:], float).reshape(3, 3))
            order = np.argsort(values)[::-1]
            lengths = np.sqrt(np.maximum(values[order], 1e-300))
            new = lengths / np.prod(lengths) ** (1 / 3)
            t["done"] = bool(np.all(np.abs(new / t["ratio"] - 1) < tol))
            t |= {"ratio": new, "axes": vectors[:, order].T, "n": int(got[i][1])}
    return [{"inner": t["inner"], "outer": t["outer"], "n": t["n"], "ba": t["ratio"][1] / t["ratio"][0], "ca": t["ratio"][2] / t["ratio"][0], "axes": t["axes"]} for t in state]


def bisect(f: Callable[[float], float], left: float, right: float, epsilon: float | None = None, steps: int = 200) -> float:
    """Root of an increasing function."""
    epsilon = 1e-7 * (right - left) if epsilon is None else epsilon
    for _ in range(steps):
        mid = (left + right) / 2
        if right - left < epsilon:
            break
        left, right = (mid, right) if f(mid) < 0 else (left, mid)
    return (left + right) / 2


#: Bins of a curve, however many rows there are.
MAX_BINS = 1000


def circular_j(s: Snapshot, per_bin: int = 1000, quantile: float = 0.99) -> Snapshot:
    """With j_circ: the upper quantile of j^2 in bins of equally many rows by energy (at most
    MAX_BINS), interpolated to each row's energy."""
    n = s.df.count()
    nbins = max(2, min(MAX_BINS, n // per_bin))
    energy = s.df.withColumn("te", s.col("te")).withColumn("j2", s.col("j2"))
    edges = equal_edges(energy.select("te"), "te", nbins)
    binned = energy.withColumn("bin", bin_of(F.col("te"), edges, closed=True)).where("bin is not null")
    upper = bin_quantiles(binned.select("bin", ROW, F.col("j2").alias("v")), (quantile,)).toDF("bin", "q")
    got = binned.groupBy("bin").agg(F.avg("te").alias("e")).join(upper, "bin").orderBy("e").collect()
    xs, ys = [r["e"] for r in got], [math.sqrt(max(r["q"], 0)) for r in got]
    return s.with_column("te", s.col("te")).with_column("j_circ", interpolated(s.col("te"), xs, ys))


def circular_j_by_curve(s: Snapshot, radius: float, height: float, per_bin: int = 1000) -> DataFrame:
    """pidx and j_circ: the mid-plane's circular angular momentum in rings of equally many
    rows of a disc (at most a tenth of MAX_BINS), interpolated to all rows by their cylindrical radius.  Meaningful
    where the rows lie in a thin disc."""
    disc = s.where(Disc(radius, height))
    p = Profile(disc, type="equaln", nbins=max(2, min(MAX_BINS // 10, disc.df.count() // per_bin)))
    return p.to_rows(p.table("j_circ"), "j_circ", s)


def decompose(s: Snapshot, j_least: float = 0.8, j_most: float = 1.1, e_cut: float | None = None, per_bin: int = 500) -> Snapshot:
    """With `decomp`: 1 thin disc, 2 halo, 3 bulge, 4 thick disc, 5 pseudo-bulge.

    Thin-disc rows have jz / j_circ within limits; of the rest a spheroid without mean
    rotation is cut off by jz / j_circ, and energy tells bulge from halo."""
    t = circular_j(s, per_bin)
    ratio = F.try_divide(t.col("jz"), F.col("j_circ"))
    t = t.with_column("jz_by_jc", ratio)
    disc = (F.col("jz_by_jc") > j_least) & (F.col("jz_by_jc") < j_most)
    # the greatest cut below which the mean rotation is not positive, from a fine histogram
    bins = 2000
    k = F.least(F.greatest(F.floor((F.col("jz_by_jc") + 1) * (bins / 2)), F.lit(0)), F.lit(bins - 1)).cast("int")
    rest = t.df.where(~disc & F.col("jz_by_jc").isNotNull())
    hist = {r[0]: (r[1], r[2]) for r in rest.groupBy(k.alias("k")).agg(F.sum("jz_by_jc"), F.count(F.lit(1))).collect()}
    total, cut = 0.0, 1.0
    for i in range(bins):
        total += hist.get(i, (0.0, 0))[0]
        if total > 0:
            cut = -1 + 2 * i / bins
            break
    if e_cut is None:
        e_cut = bin_quantiles(t.df.select(F.lit(0).alias("bin"), ROW, F.col("te").alias("v")), (0.5,)).first()["q50"]
    low = F.col("te") < F.lit(float(e_cut))
    spheroid = F.col("jz_by_jc") < F.lit(float(cut))
    part = F.when(disc, 1).when(spheroid, F.when(low, 3).otherwise(2)).otherwise(F.when(low, 5).otherwise(4))
    return t.with_column("decomp", part)


def half_light(s: Snapshot, band: str, cylindrical: bool = False, bins: int = 4096) -> float:
    """Radius that holds half of the light of a band's magnitudes."""
    r = s.col("rxy" if cylindrical else "r")
    light = F.pow(F.lit(10.0), s.col(f"{band}_mag") * -0.4)
    top = s.df.agg(F.max(r)).first()[0]
    k = F.least(F.floor(r / F.lit(top) * bins), F.lit(bins - 1)).cast("int")
    got = s.df.groupBy(k.alias("k")).agg(F.sum(light).alias("l"))
    run = got.withColumn("c", F.sum("l").over(Window.orderBy("k"))).withColumn("all", F.sum("l").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    k_half, c, l, whole = run.where(F.col("c") >= F.col("all") / 2).orderBy("k").select("k", "c", "l", "all").first()
    return float(top / bins * (k_half + 1 - (c - whole / 2) / l))


def total_magnitude(s: Snapshot, band: str) -> DataFrame:
    light = F.pow(F.lit(10.0), s.col(f"{band}_mag") * -0.4)
    return s.df.agg((-2.5 * F.log10(F.sum(light))).alias("mag"), F.sum(light).alias("lum"))
