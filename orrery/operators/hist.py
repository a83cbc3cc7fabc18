"""Histograms over one or two columns, star formation histories and phase diagrams."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..snapshot import Snapshot


def hist2d(s: Snapshot, x: str, y: str, nx: int = 100, ny: int = 100, x_range=None, y_range=None, weights: str | None = None, values: str | None = None, x_log: bool = False, y_log: bool = False) -> DataFrame:
    """ix, iy and h: the count, the sum of weights, or the (weighted) mean of values in
    each cell that has rows.  Rows on or outside a given range's ends are left out."""
    cx, cy = s.col(x), s.col(y)
    if x_log:
        cx = F.log10(F.when(cx > 0, cx))
    if y_log:
        cy = F.log10(F.when(cy > 0, cy))
    df = s.df.select(cx.alias("x"), cy.alias("y"), (s.col(weights) if weights else F.lit(1.0)).alias("w"), (s.col(values) if values else F.lit(1.0)).alias("v"))
    logs = lambda r, on: tuple(math.log10(v) for v in r) if on else tuple(map(float, r))
    if x_range is None or y_range is None:
        lo_x, hi_x, lo_y, hi_y = df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    (x0, x1) = logs(x_range, x_log) if x_range else (lo_x, hi_x)
    (y0, y1) = logs(y_range, y_log) if y_range else (lo_y, hi_y)
    inside = F.lit(True)
    if x_range:
        inside &= (F.col("x") > x0) & (F.col("x") < x1)
    if y_range:
        inside &= (F.col("y") > y0) & (F.col("y") < y1)
    cell = lambda c, lo, hi, n: F.least(F.floor((c - lo) * (n / (hi - lo))), F.lit(n - 1)).cast("int")
    got = df.where(inside).groupBy(cell(F.col("x"), x0, x1, nx).alias("ix"), cell(F.col("y"), y0, y1, ny).alias("iy"))
    h = F.sum(F.col("w") * F.col("v")) / F.sum("w") if values else F.sum("w")
    return got.agg(h.alias("h"))


def density_temperature(s: Snapshot, rho_unit=None, phases: str = "split", **kwargs) -> DataFrame:
    """ix, iy and h of the gas by the decades of density and temperature.

    Rows with a hot phase (`uHot`, `MassHot`) count once for each phase, at the density
    that its share of the energy gives (`split`), or once at `Tinc` (`merge`).  Other
    settings as for `hist2d`; rows whose density or temperature isn't positive and
    finite have no decade and are left out."""
    if phases not in ("split", "merge"):
        raise ValueError(f"no phases {phases!r}")
    g = s.family("gas")
    rho = g.col("rho") if rho_unit is None else g.in_units("rho", rho_unit)
    df = g.df.withColumn("__rho", rho.cast("double"))
    if phases == "merge" and "Tinc" in g.keys():
        df = df.withColumn("__t", F.col("Tinc").cast("double"))
    elif phases == "split" and {"uHot", "MassHot"} <= set(g.keys()):
        u, hot, t = g.col("u"), F.col("uHot"), g.col("temp")
        energy = hot * F.col("MassHot") + u * (g.col("mass") - F.col("MassHot"))
        two = [F.struct((F.col("__rho") * F.try_divide(energy, g.col("mass") * v)).alias("r"), w.alias("t")) for v, w in ((u, t), (hot, F.try_divide(t, u) * hot))]
        df = df.withColumn("__phase", F.explode(F.array(*two))).withColumn("__rho", F.col("__phase.r")).withColumn("__t", F.col("__phase.t")).drop("__phase")
    else:
        df = df.withColumn("__t", g.col("temp").cast("double"))
    good = [(F.col(c) > 0) & (F.col(c) < float("inf")) for c in ("__rho", "__t")]
    return hist2d(replace(g, df=df.where(good[0] & good[1])), "__rho", "__t", x_log=True, y_log=True, **kwargs)


def kde(s: Snapshot, x: str, y: str, nx: int = 100, ny: int = 100, extents: tuple[float, float, float, float] | None = None, weights: str | None = None, width: tuple[float, float] | None = None, correlated: bool = True, norm: bool = False, transposed: bool = False) -> DataFrame:
    """ix, iy and value of a map of densities: a histogram convolved with a Gaussian.

    The Gaussian's covariance is that of the rows' cells times n^(-1/3) (Scott's rule for
    two dimensions); it is cut off at `width` (in units of x and y, default about 2 pi
    standard deviations in all).  The map is over the kernel's norm, and with `norm` over
    rows and area, too, so that it is a probability density.  `extents` are the map's edges
    in x and y (default the rows' own; rows outside are left out).  `correlated=False` leaves
    the covariance's other diagonal out; `transposed` gives the kernel's axes each other's
    place, as some implementations do.

    Rows make one partial aggregate; cells, which the map bounds, spread over the kernel."""
    cx, cy = s.col(x).cast("double"), s.col(y).cast("double")
    df = s.df.select(cx.alias("x"), cy.alias("y"), (s.col(weights) if weights else F.lit(1.0)).alias("w")).where("x is not null and y is not null")
    x0, x1, y0, y1 = extents or df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if x0 is None:
        return df.select(F.lit(0).alias("ix"), F.lit(0).alias("iy"), F.lit(0.0).alias("value")).limit(0)
    dx, dy = (x1 - x0) / nx, (y1 - y0) / ny
    cell = lambda c, lo, d, n: F.least(F.floor((c - lo) / d), F.lit(n - 1)).cast("int")
    inside = (F.col("x") >= x0) & (F.col("x") <= x1) & (F.col("y") >= y0) & (F.col("y") <= y1)
    cells = df.where(inside).groupBy(cell(F.col("x"), x0, dx, nx).alias("ix"), cell(F.col("y"), y0, dy, ny).alias("iy")).agg(F.sum("w").alias("h"), F.count(F.lit(1)).alias("n"))
    cells = checkpointed(cells)
    # moments of the rows' cells, from the cells
    n, sx, sy, xx, yy, xy = cells.agg(*[F.sum(F.col("n") * v) for v in (F.lit(1.0), F.col("ix"), F.col("iy"), F.col("ix") * F.col("ix"), F.col("iy") * F.col("iy"), F.col("ix") * F.col("iy"))]).first()
    if not n or n < 2:
        raise ValueError("a covariance takes two rows")
    cov = np.array([[xx - sx * sx / n, xy - sx * sy / n], [xy - sx * sy / n, yy - sy * sy / n]]) / (n - 1)
    if not correlated:
        cov[0, 1] = cov[1, 0] = 0.0
    scott = n ** (-1 / 6)
    across = np.round(scott * 2 * math.pi * np.sqrt(np.diag(cov))) if width is None else np.round([width[0] / dx, width[1] / dy])
    reach = [int(k) // 2 for k in across]
    inverse = np.linalg.inv(cov * scott**2)
    if transposed:
        reach, inverse = reach[::-1], inverse[::-1, ::-1]
    scale = math.sqrt(np.linalg.det(2 * math.pi * cov * scott**2)) * (n * dx * dy if norm else 1.0)
    span = lambda c, r, m: F.explode(F.sequence(F.greatest(F.col(c) - r, F.lit(0)), F.least(F.col(c) + r, F.lit(m - 1))))
    spread = cells.withColumn("px", span("ix", reach[0], nx)).withColumn("py", span("iy", reach[1], ny))
    a, b = F.col("px") - F.col("ix"), F.col("py") - F.col("iy")
    form = a * a * float(inverse[0, 0]) + a * b * float(2 * inverse[0, 1]) + b * b * float(inverse[1, 1])
    return spread.groupBy(F.col("px").alias("ix"), F.col("py").alias("iy")).agg((F.sum(F.col("h") * F.exp(-form / 2)) / scale).alias("value"))


def conditional(h: DataFrame) -> DataFrame:
    """p(y | x): a histogram whose columns of equal ix sum to one."""
    total = h.groupBy("ix").agg(F.sum("h").alias("all"))
    return h.join(F.broadcast(total), "ix").select("ix", "iy", (F.col("h") / F.col("all")).alias("p"))


def binned_sum(df: DataFrame, x: Column, edges: Sequence[float], value: Column) -> DataFrame:
    """bin and sum of a value over evenly spaced edges (the last closed)."""
    n, lo, hi = len(edges) - 1, float(edges[0]), float(edges[-1])
    k = F.least(F.floor((x - lo) * (n / (hi - lo))), F.lit(n - 1)).cast("int")
    return df.where((x >= lo) & (x <= hi)).groupBy(k.alias("bin")).agg(F.sum(value).alias("total"))


def star_formation(s: Snapshot, least: float, most: float, bins: int = 100, formed: str = "massform") -> DataFrame:
    """Mass formed in each span of tform over the span's length: bin, mid, sfr.  Without
    a column of formation masses the present mass counts."""
    m = s.col(formed) if s.has_key(formed) else s.col("mass")
    step = (most - least) / bins
    edges = np.linspace(least, most, bins + 1)
    got = binned_sum(s.df, s.col("tform"), edges, m)
    return got.select("bin", (F.lit(least) + (F.col("bin") + 0.5) * step).alias("mid"), (F.col("total") / step).alias("sfr"))


def schmidt_law(gas: Snapshot, stars: Snapshot, now: float, span: float, height: float, rmax: float, bins: int = 10) -> DataFrame:
    """Surface densities in rings of a face-on disc: bin, gas and young stars' rate."""
    step = rmax / bins

    def rings(s: Snapshot, keep: Column, name: str) -> DataFrame:
        k = F.floor(s.col("rxy") / step).cast("int")
        area = math.pi * step * step * (2 * F.col("bin") + 1)
        flat = s.df.where(keep & (F.abs(s.vector("pos")[2]) < height) & (s.col("rxy") < rmax))
        return flat.groupBy(k.alias("bin")).agg(F.sum(s.col("mass")).alias("m")).select("bin", (F.col("m") / area).alias(name))

    young = rings(stars, stars.col("tform") > now - span, "sfr").withColumn("sfr", F.col("sfr") / span)
    return rings(gas, F.lit(True), "gas").join(young, "bin", "full")


def sums(s: Snapshot, value: str, other: str, limit: float) -> DataFrame:
    """Sum of a column, and of its rows where another is above and below a limit."""
    v, o = s.col(value), s.col(other)
    return s.df.agg(F.sum(v).alias("total"), F.sum(F.when(o > limit, v)).alias("above"), F.sum(F.when(o < limit, v)).alias("below"))


def reductions(s: Snapshot, name: str) -> DataFrame:
    """sum, mean, min, max, range, and the population's std and var of a column."""
    c = s.col(name)
    return s.df.agg(F.sum(c).alias("sum"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), (F.max(c) - F.min(c)).alias("ptp"), F.stddev_pop(c).alias("std"), F.var_pop(c).alias("var"))
