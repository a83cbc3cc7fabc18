"""Profiles: quantities binned over a radius or any other column.

Edges are few numbers on the driver.  A row's bin is an expression for evenly or
logarithmically spaced edges and a binary search over a literal array else, so that all
quantities of a profile come from one partial aggregate, whose result has a row for each
bin.  Counts close the last bin, weighted sums leave it half open.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..snapshot import ROW, Snapshot, at_most, components, ranged
from ..units import G, as_unit

_registry: dict[str, Callable[[Profile], Column]] = {}


def profile_property(fn):
    """Registers a function of a profile as a column over its bins."""
    _registry[fn.__name__] = fn
    return fn


def lin_edges(lo: float, hi: float, n: int) -> list[float]:
    return np.linspace(lo, hi, n + 1).tolist()


def log_edges(lo: float, hi: float, n: int) -> list[float]:
    return np.logspace(math.log10(lo), math.log10(hi), n + 1).tolist()


def equal_edges(df: DataFrame, x: str, n: int) -> list[float]:
    """Edges with as many rows in each bin: values at even ranks, the ends moved outward
    by the least step.  Ranks are counted by range over the different values, no task sorts
    all rows and a value that many rows have is one."""
    values = df.select(F.lit(0).alias("bin"), F.col(x).alias("v")).where("v is not null").groupBy("bin", "v").agg(F.count(F.lit(1)).alias("n"))
    cum = cumulated(values.withColumn("__k", F.struct("bin", "v")), "__k", "bin", F.col("n"))
    total = df.where(F.col(x).isNotNull()).count()
    ranks = [int(v) for v in np.linspace(0, total - 1, n + 1)]
    marks = sorted(set(ranks))
    # a value is held if one of the ranks lies in its own
    below = lambda upto: at_most(F.array(*map(F.lit, marks)).cast("array<bigint>"), len(marks), upto - 1)
    held = below(F.col("upto")) > below(F.col("upto") - F.col("n"))
    got = sorted(cum.where(held).select("upto", "v").collect())
    e = [got[bisect_right([u for u, _ in got], r)][1] for r in ranks]
    e[0], e[-1] = np.nextafter(e[0], -np.inf).item(), np.nextafter(e[-1], np.inf).item()
    return e


def bin_of(x: Column, edges: Sequence[float], closed: bool = False) -> Column:
    """Number of the half-open bin of a value, null outside; `closed` closes the last."""
    n = len(edges) - 1
    arr = F.array(*[F.lit(float(e)) for e in edges])
    # edges at most x: a sum over the literal edges, which stays within generated code
    count = sum(F.when(x >= F.lit(float(e)), 1).otherwise(0) for e in edges) if n <= 32 else at_most(arr, n + 1, x)
    inside = (x >= F.lit(float(edges[0]))) & (x < F.lit(float(edges[-1])))
    b = F.when(inside, (count - 1).cast("int"))
    return F.when(x == F.lit(float(edges[-1])), F.lit(n - 1)).otherwise(b) if closed else b


def cumulated(rows: DataFrame, by: str, key: str, value: Column) -> DataFrame:
    """rows with `upto`, the running sum of a value in the order of `by` among rows of equal
    `key`, and `whole`, the sum of all of them.  `by` begins with the key.

    Rows are dealt to ranges of `by`; the sums of ranges, one number for each key in each,
    are carried on, so that no task sees all rows of a key."""
    dealt = ranged(rows, by).withColumn("__v", value)
    inside = F.sum("__v").over(Window.partitionBy("__p", key).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    w = Window.partitionBy(key)
    sums = dealt.groupBy("__p", key).agg(F.sum("__v").alias("__s"))
    before = F.coalesce(F.sum("__s").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__p", key, before.alias("__b"), F.sum("__s").over(w).alias("whole"))
    # as many rows as there are ranges and keys
    return dealt.withColumn("__i", inside).join(F.broadcast(sums), ["__p", key]).withColumn("upto", F.col("__b") + F.col("__i")).drop("__p", "__v", "__i", "__b")


def ranks(rows: DataFrame) -> DataFrame:
    """bin, v, rank (from 0, by value) and all, the values of the bin, of rows (bin, pidx, v)
    that have a value."""
    got = cumulated(rows.where("v is not null").withColumn("__k", F.struct("bin", "v", ROW)), "__k", "bin", F.lit(1))
    return got.select("bin", "v", (F.col("upto") - 1).alias("rank"), F.col("whole").alias("all"))


def bin_quantiles(rows: DataFrame, q: Sequence[float]) -> DataFrame:
    """bin and quantiles q16 and so on, linear between ranks, of rows (bin, pidx, v)."""
    got, out = ranks(rows), []
    for k, x in enumerate(q):
        at = F.lit(float(x)) * (F.col("all") - 1)
        out += [F.max(F.when(F.col("rank") == F.floor(at), F.col("v"))).alias(f"a{k}"), F.max(F.when(F.col("rank") == F.ceil(at), F.col("v"))).alias(f"b{k}"), F.max(at - F.floor(at)).alias(f"t{k}")]
    value = lambda k: F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * F.col(f"t{k}")
    return got.groupBy("bin").agg(*out).select("bin", *[value(k).alias(f"q{int(round(x * 100))}") for k, x in enumerate(q)])


@dataclass
class Profile:
    """Bins of `x` (default the radius, of two dimensions or three) over a snapshot."""

    s: Snapshot
    edges: Sequence[float] | None = None
    type: str = "lin"
    nbins: int = 100
    ndim: int = 2
    least: float | None = None
    most: float | None = None
    x: Callable[[Snapshot], Column] | None = None
    weight: str = "mass"
    _rows: DataFrame = field(init=False, repr=False)

    def __post_init__(self):
        value = self.x(self.s) if self.x else self.s.col("rxy" if self.ndim == 2 else "r")
        df = self.s.df.withColumn("__x", value.cast("double"))
        if self.edges is None:
            seen = df if self.least is None else df.where(F.col("__x") >= self.least)
            seen = seen if self.most is None else seen.where(F.col("__x") <= self.most)
            if self.type == "equaln":
                self.edges = equal_edges(seen, "__x", self.nbins)
            else:
                if self.least is None or self.most is None:
                    lo, pos, hi = df.agg(F.min("__x"), F.min(F.when(F.col("__x") > 0, F.col("__x"))), F.max("__x")).first()
                    lo = (pos if self.type == "log" else lo) if self.least is None else self.least
                    hi = hi if self.most is None else self.most
                else:
                    lo, hi = self.least, self.most
                self.edges = {"lin": lin_edges, "log": log_edges}[self.type](lo, hi, self.nbins)
        self.edges = [float(e) for e in self.edges]
        self._rows = df.withColumn("bin", bin_of(F.col("__x"), self.edges, closed=True)).where(F.col("bin").isNotNull())

    @property
    def n_bins(self) -> int:
        return len(self.edges) - 1

    def bins(self) -> DataFrame:
        """bin, rbins (middle), dr, binsize (ring area or shell volume) and edges."""
        e = np.array(self.edges)
        mid = (e[1:] + e[:-1]) / 2
        dr = np.gradient(mid) if len(mid) > 1 else e[1:] - e[:-1]
        size = math.pi * (e[1:] ** 2 - e[:-1] ** 2) if self.ndim == 2 else 4 / 3 * math.pi * (e[1:] ** 3 - e[:-1] ** 3)
        rows = [(i, float(a), float(b), float(c), float(lo), float(hi)) for i, (a, b, c, lo, hi) in enumerate(zip(mid, dr, size, e[:-1], e[1:], strict=True))]
        return self.s.spark.createDataFrame(rows, "bin int, rbins double, dr double, binsize double, lo double, hi double")

    def half_open(self, c: Column) -> Column:
        """A summand without the value on the last edge."""
        return F.when(F.col("__x") < F.lit(self.edges[-1]), c)

    def _sums(self, names: Sequence[str]) -> dict[str, Column]:
        """Aggregates that the named quantities need."""
        s, out = self.s, {}
        w = self.half_open(s.col(self.weight))
        for name in names:
            if name == "n":
                out["n"] = F.count(F.lit(1))
            elif name == "weight_fn":
                out["weight_fn"] = F.sum(w)
            elif name == "mass":
                out["mass"] = F.sum(self.half_open(s.col("mass")))
            elif name == CENTRAL:
                out[name] = F.max(self.half_open(s.col("r") == 0))
            elif name.endswith("_disp") and s.has_key(q := name[:-5]):
                c = s.col(q)
                mean = F.try_divide(F.sum(w * c), F.sum(w))
                square = F.try_divide(F.sum(w * c * c), F.sum(w))
                out[name] = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
            elif name.endswith("_rms") and s.has_key(q := name[:-4]):
                c = s.col(q)
                out[name] = F.sqrt(F.try_divide(F.sum(w * c * c), F.sum(w)))
            elif s.has_key(name):
                out[name] = F.try_divide(F.sum(w * s.col(name)), F.sum(w))
            elif s.is_vector(name):
                for part, c in zip(components(name), s.vector(name), strict=True):
                    out[part] = F.try_divide(F.sum(w * c), F.sum(w))
            else:
                raise KeyError(name)
        return out

    def table(self, *names: str) -> DataFrame:
        """bin, rbins and the named quantities: column means, `_disp`, `_rms`, `_med`,
        `d_` gradients, and registered properties.  One aggregate serves them all; the
        rest works on the bins."""
        bands = {n: m for n in names if n not in _registry and (m := _BAND.fullmatch(n))}
        registered = [n for n in names if n in _registry]
        gradients = [n for n in names if n.startswith("d_") and n not in _registry]
        medians = [n for n in names if n.endswith("_med")]
        plain = [n for n in names if n not in [*registered, *gradients, *medians, *bands]]
        need = dict.fromkeys(plain)
        for n in registered:
            need |= dict.fromkeys(getattr(_registry[n], "needs", ("mass",)))
        for n in gradients:
            base = n[2:]
            need |= dict.fromkeys(getattr(_registry[base], "needs", ("mass",)) if base in _registry else (base,))
        need = dict.fromkeys([*need, "n"])
        light = {f"__light_{m[2] or 'v'}": F.sum(self.half_open(F.pow(F.lit(10.0), -0.4 * self.s.col(f"{m[2] or 'v'}_mag")))) for m in bands.values()}
        sums = self._rows.groupBy("bin").agg(*[c.alias(k) for k, c in (self._sums(list(need)) | light).items()])
        out = self.bins().join(F.broadcast(sums), "bin", "left")
        asked = [*registered, *[n[2:] for n in gradients if n[2:] in _registry]]
        for source in dict.fromkeys(x for n in asked for x in getattr(_registry[n], "midplane", ())):
            out = out.join(F.broadcast(self._midplane(source)), "bin", "left")
        for n, m in bands.items():
            mag = -2.5 * F.log10(f"__light_{m[2] or 'v'}")
            out = out.withColumn(n, mag if m[1] == "magnitudes" else mag + 2.5 * F.log10(F.col("binsize") * self._square_arcseconds()))
        for k in ("n", "mass", "weight_fn"):
            if k in out.columns:
                out = out.withColumn(k, F.coalesce(k, F.lit(0)))
        for n in registered:
            out = out.withColumn(n, _registry[n](self))
        for n in gradients:
            if n[2:] in _registry and n[2:] not in out.columns:
                out = out.withColumn(n[2:], _registry[n[2:]](self))
            out = out.withColumn(n, gradient(F.col(n[2:]), F.first("dr").over(_all()), len(self.edges) - 1))
        for n in medians:
            out = out.join(F.broadcast(self.median(n[:-4])), "bin", "left")
        cols = []
        for n in names:
            cols += [c for c in components(n)] if n not in out.columns else [n]
        return out.select("bin", "rbins", *cols)

    def _midplane(self, source: str) -> DataFrame:
        """bin and a quantity of the gravity in the plane z = 0 at the bins' middles: the
        circular speed from the profile's rows or from all rows of its ancestor within three
        times the last middle, or the potential."""
        from . import gravity
        from .filters import Sphere

        mids = [(a + b) / 2 for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]
        if source == POTENTIAL:
            return gravity.midplane_potential(self.s, mids).select(F.col("k").alias("bin"), F.col("pot").alias(source))
        s = self.s if source == SPEED else self.s.ancestor().where(Sphere(3 * mids[-1]))
        return gravity.rotation_curve(s, mids).select(F.col("k").alias("bin"), F.col("v_circ").alias(source))

    def _square_arcseconds(self) -> float:
        """Square arcseconds at 10 pc in a unit of area; positions without a unit are in kpc."""
        pos = self.s.unit("pos")
        pc = 1e3 if pos.dimensionless else pos.ratio("pc", **self.s.context())
        return pc * pc / PC2_PER_ARCSEC2

    def median(self, name: str) -> DataFrame:
        """Upper median of each bin: the value of rank n // 2, without weights."""
        got = ranks(self._inside(name))
        return got.where(F.col("rank") == F.floor(F.col("all") / 2)).select("bin", F.col("v").alias(f"{name}_med"))

    def _inside(self, name: str, **more: Column) -> DataFrame:
        """bin, the row's number and v, the value of a column, of rows below the last edge."""
        rows = self._rows.where(F.col("__x") < F.lit(self.edges[-1]))
        return rows.select("bin", ROW, self.s.col(name).cast("double").alias("v"), *[c.alias(k) for k, c in more.items()])

    def quantiles(self, name: str, q: Sequence[float] = (0.16, 0.5, 0.84)) -> DataFrame:
        """Quantiles of each bin, linear between ranks."""
        return bin_quantiles(self._inside(name), q)

    def weighted_quantiles(self, name: str, weight: str, q: Sequence[float] = (0.16, 0.5, 0.84)) -> DataFrame:
        """Quantiles of each bin under weights: between the values next to q of the
        cumulative weight, counted from the first value's."""
        rows = self._inside(name, w=self.s.col(weight).cast("double")).where("v is not null")
        cum = cumulated(rows.withColumn("__k", F.struct("bin", "v", "w", ROW)), "__k", "bin", F.col("w"))
        # the first row of a bin has what it adds itself
        first = cum.groupBy("bin").agg(F.min("upto").alias("least"))
        cum = cum.join(F.broadcast(first), "bin")
        f = F.coalesce(F.try_divide(F.col("upto") - F.col("least"), F.col("whole") - F.col("least")), F.lit(0.0))
        at = cum.select("bin", F.struct(f.alias("f"), "v").alias("at"))
        sides = []
        for k, x in enumerate(q):
            sides += [F.max(F.when(F.col("at.f") <= x, F.col("at"))).alias(f"a{k}"), F.min(F.when(F.col("at.f") > x, F.col("at"))).alias(f"b{k}")]
        out = []
        for k, x in enumerate(q):
            a, b = F.col(f"a{k}"), F.col(f"b{k}")
            out.append((a.v + F.coalesce(F.try_divide((F.lit(float(x)) - a.f) * (b.v - a.v), b.f - a.f), F.lit(0.0))).alias(f"q{int(round(x * 100))}"))
        return at.groupBy("bin").agg(*sides).select("bin", *out)

    def fourier(self, m_max: int = 6, phi_bins: int = 100, least: int = 100, delta: float | None = None) -> DataFrame:
        """Coefficients c_m of the azimuthal mass distribution of bins with more than
        `least` rows: bin, m, re, im, amplitude, phase; with `delta`, a time in units of
        position by velocity, also dphi_dt: how fast phases turn as rows go on for so long."""
        step = 2 * math.pi / phi_bins
        rows = self._rows.where(F.col("__x") < F.lit(self.edges[-1]))
        place = lambda a: F.least(F.floor((a + math.pi) / step), F.lit(phi_bins - 1))
        at = [place(self.s.col("az"))]
        if delta is not None:
            (x, y, _), (vx, vy, _) = self.s.vector("pos"), self.s.vector("vel")
            at.append(place(F.atan2(y + vy * float(delta), x + vx * float(delta))))
        both = rows.select("bin", self.s.col("mass").alias("m"), F.posexplode(F.array(*at)).alias("late", "k"))
        hist = both.groupBy("bin", "late", "k").agg(F.sum("m").alias("w"), F.count(F.lit(1)).alias("c"))
        many = hist.where("late = 0").groupBy("bin").agg(F.sum("c").alias("all"), F.sum("w").alias("total")).where(F.col("all") > least)
        mid = (F.col("k") + 0.5) * step - math.pi
        ms = self.s.spark.range(m_max + 1).select(F.col("id").cast("int").alias("m"))
        hist = hist.join(F.broadcast(many), "bin").join(F.broadcast(ms))
        part = lambda late, wave: F.sum(F.when(F.col("late") == late, F.col("w") * wave / F.col("total")))
        wave = [F.cos(F.col("m") * mid), -F.sin(F.col("m") * mid)]
        out = hist.groupBy("bin", "m").agg(part(0, wave[0]).alias("re"), part(0, wave[1]).alias("im"), part(1, wave[0]).alias("re1"), part(1, wave[1]).alias("im1"))
        out = out.withColumn("amplitude", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).withColumn("phase", F.atan2("im", "re"))
        if delta is None:
            return out.drop("re1", "im1")
        turn = F.atan2("im1", "re1") - F.col("phase")
        turn = F.when(turn > math.pi, turn - 2 * math.pi).when(turn < -math.pi, turn + 2 * math.pi).otherwise(turn)
        return out.withColumn("dphi_dt", turn / float(delta)).drop("re1", "im1")

    def pattern_frequency(self, delta: float | str = "0.1 Myr", least: int = 100) -> DataFrame:
        """bin and the pattern speed: half of the rate at which the m = 2 phase turns.
        Phases are those of exp(-i m az), so that a turn towards larger az is negative."""
        pos, vel = self.s.unit("pos"), self.s.unit("vel")
        if isinstance(delta, str):
            time = as_unit(delta)
            # without units the number counts
            delta = float(delta.split()[0]) if pos.dimensionless or vel.dimensionless else time.ratio(pos / vel, **self.s.context())
        return self.fourier(2, least=least, delta=delta).where("m = 2").select("bin", (F.col("dphi_dt") / 2).alias("pattern_frequency"))

    def to_rows(self, table: DataFrame, name: str, target: Snapshot | None = None, log_x: bool = True, log_y: bool = True) -> DataFrame:
        """A profile's quantity interpolated onto rows (of the target or the profile's
        own snapshot): pidx and the value; flat beyond the first and last bin.  The bins
        go along as two literal arrays."""
        pts = [(float(a), float(b)) for a, b in table.orderBy("bin").select("rbins", name).collect() if b is not None and not math.isnan(b)]
        log_x &= all(a > 0 for a, _ in pts)
        log_y &= all(b > 0 for _, b in pts)
        xs = [math.log(a) if log_x else a for a, _ in pts]
        ys = [math.log(b) if log_y else b for _, b in pts]
        t = target or self.s
        value = self.x(t) if self.x else t.col("rxy" if self.ndim == 2 else "r")
        got = interpolated(F.log(F.nullif(value, F.lit(0.0))) if log_x else value, xs, ys)
        got = F.coalesce(got, F.lit(ys[0])) if log_x else got
        return t.df.select("pidx", (F.exp(got) if log_y else got).alias(name))


def interpolated(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Linear interpolation in a table of literals, flat beyond its ends."""
    ax, ay = (F.array(*[F.lit(float(v)) for v in a]) for a in (xs, ys))

    def between(k: Column) -> Column:
        lo, hi = F.greatest(k, F.lit(1)), F.least(F.greatest(k, F.lit(1)) + 1, F.lit(len(xs)))
        x0, x1, y0, y1 = F.element_at(ax, lo), F.element_at(ax, hi), F.element_at(ay, lo), F.element_at(ay, hi)
        return y0 + F.coalesce(F.try_divide((x - x0) * (y1 - y0), x1 - x0), F.lit(0.0))

    # the place is looked up once
    inner = F.get(F.transform(F.array(at_most(ax, len(xs), x)), between), 0)
    return F.when(x <= F.lit(float(xs[0])), F.lit(float(ys[0]))).when(x >= F.lit(float(xs[-1])), F.lit(float(ys[-1]))).otherwise(inner)


def _all():
    return Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def gradient(c: Column, step: Column, n: int) -> Column:
    """Central differences over bins with one spacing, one-sided at the ends."""
    w = Window.orderBy("bin")
    lo, hi = F.lag(c).over(w), F.lead(c).over(w)
    return F.when(lo.isNull(), (hi - c) / step).when(hi.isNull(), (c - lo) / step).otherwise((hi - lo) / (2 * step))


# ---- quantities over the bins; each has a row for each bin, so that windows are small


@profile_property
def density(p: Profile) -> Column:
    return F.col("mass") / F.col("binsize")


@profile_property
def mass_enc(p: Profile) -> Column:
    return F.sum("mass").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))


@profile_property
def density_enc(p: Profile) -> Column:
    return mass_enc(p) / (4 * math.pi / 3 * F.pow("rbins", F.lit(3)))


def gravity_constant(s: Snapshot) -> float:
    """G in the units of positions, velocities and masses; 1 if they have none."""
    pos, vel, mass = s.unit("pos"), s.unit("vel"), s.unit("mass")
    if pos.dimensionless or vel.dimensionless or mass.dimensionless:
        return 1.0
    return G.ratio(pos * vel**2 / mass, **s.context())


@profile_property
def g_spherical(p: Profile) -> Column:
    return gravity_constant(p.s) * mass_enc(p) / (F.col("rbins") * F.col("rbins"))


@profile_property
def rotation_curve_spherical(p: Profile) -> Column:
    return F.sqrt(gravity_constant(p.s) * mass_enc(p) / F.col("rbins"))


@profile_property
def dyntime(p: Profile) -> Column:
    return F.sqrt(F.try_divide(F.pow("rbins", F.lit(3)), 2 * gravity_constant(p.s) * mass_enc(p)))


@profile_property
def jtot(p: Profile) -> Column:
    return F.sqrt(F.col("j_x") * F.col("j_x") + F.col("j_y") * F.col("j_y") + F.col("j_z") * F.col("j_z"))


@profile_property
def j_theta(p: Profile) -> Column:
    return F.acos(F.try_divide(F.col("j_z"), jtot(p)))


@profile_property
def j_phi(p: Profile) -> Column:
    return F.atan2("j_y", "j_x")


jtot.needs = j_theta.needs = j_phi.needs = ("j",)


@profile_property
def beta(p: Profile) -> Column:
    square = lambda n: F.col(f"{n}_disp") * F.col(f"{n}_disp")
    return 1.5 - F.try_divide(square("vx") + square("vy") + square("vz"), 2 * square("vr"))


beta.needs = ("vx_disp", "vy_disp", "vz_disp", "vr_disp")


#: Whether a bin has a row at the very centre, which has no radial direction.
CENTRAL = "__central"
#: Columns that `_midplane` joins.
SPEED, TOTAL_SPEED, POTENTIAL = "__speed", "__total_speed", "__potential"
#: Square parsecs in a square arcsecond at 10 pc.
PC2_PER_ARCSEC2 = 2.3504430539466191e-09
_BAND = re.compile(r"(magnitudes|sb)(?:[,_](\w+))?")


def _from_midplane(*sources: str, needs: Sequence[str] = ("mass",)):
    """Registers a property that takes joined quantities of the plane's gravity."""

    def add(fn):
        fn.midplane, fn.needs = sources, tuple(needs)
        return profile_property(fn)

    return add


@_from_midplane(SPEED)
def v_circ(p: Profile) -> Column:
    """Circular speed of the profile's rows in the plane z = 0."""
    return F.col(SPEED)


@_from_midplane(TOTAL_SPEED)
def v_circ_total(p: Profile) -> Column:
    """Circular speed of all rows of the snapshot that the profile's is a view of."""
    return F.col(TOTAL_SPEED)


@_from_midplane(POTENTIAL)
def pot(p: Profile) -> Column:
    """Potential in the plane z = 0."""
    return F.col(POTENTIAL)


@_from_midplane(TOTAL_SPEED, POTENTIAL)
def E_circ(p: Profile) -> Column:  # noqa: N802
    """Energy of circular orbits."""
    return 0.5 * F.col(TOTAL_SPEED) * F.col(TOTAL_SPEED) + F.col(POTENTIAL)


@_from_midplane(SPEED)
def omega(p: Profile) -> Column:
    return F.col(SPEED) / F.col("rbins")


@_from_midplane(TOTAL_SPEED)
def j_circ(p: Profile) -> Column:
    return F.col(TOTAL_SPEED) * F.col("rbins")


def _kappa(p: Profile) -> Column:
    """Epicyclic frequency; NaN where orbits aren't stable."""
    o2 = omega(p) * omega(p)
    return F.sqrt(F.col("rbins") * gradient(o2, F.col("dr"), p.n_bins) + 4 * o2)


_kappa.__name__ = "kappa"
_from_midplane(SPEED)(_kappa)


@_from_midplane(SPEED, needs=("mass", "vr_disp", CENTRAL))
def Q(p: Profile) -> Column:  # noqa: N802
    """Toomre's stability; NaN in a bin with a row at the very centre."""
    spread = F.when(F.col(CENTRAL), F.lit(math.nan)).otherwise(F.col("vr_disp"))
    return F.try_divide(spread * _kappa(p), 3.36 * gravity_constant(p.s) * density(p))


@_from_midplane(SPEED)
def X(p: Profile) -> Column:  # noqa: N802
    """Stability to the second arm mode."""
    return F.try_divide(_kappa(p) * _kappa(p) * F.col("rbins"), 4 * math.pi * gravity_constant(p.s) * density(p))


def inclined(angle: float) -> Callable[[Snapshot], Column]:
    """Elliptical radius of a disc that is inclined by an angle in degrees."""
    c = math.cos(math.radians(angle))

    def x(s: Snapshot) -> Column:
        a, b, _ = s.vector("pos")
        return F.sqrt(a * a + (b / c) * (b / c))

    return x


def vertical(s: Snapshot) -> Column:
    """Height above the plane."""
    return F.abs(s.vector("pos")[2])


def kappa(table: DataFrame, n: int) -> DataFrame:
    """Epicyclic frequency from rbins, dr and omega."""
    o2 = F.col("omega") * F.col("omega")
    d = gradient(o2, F.first("dr").over(_all()), n)
    return table.withColumn("kappa", F.sqrt(F.greatest(F.col("rbins") * d + 4 * o2, F.lit(0.0))))
