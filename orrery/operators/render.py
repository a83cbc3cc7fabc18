"""Images, grids and sky maps: each row spreads over the pixels that its kernel touches
(an explode of pixel numbers), and pixels are summed in a partial aggregate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..snapshot import Snapshot
from .sph import kernel, projected


def _pixels(c: Column, h: Column, lo: float, step: float, n: int) -> Column:
    """Numbers of the pixels whose middles may lie within 2h."""
    first = F.greatest(F.ceil((c - 2 * h - lo) / step - 0.5), F.lit(0)).cast("int")
    last = F.least(F.floor((c + 2 * h - lo) / step - 0.5), F.lit(n - 1)).cast("int")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _rows(s: Snapshot, quantity: Column, least_h: float) -> DataFrame:
    x, y, z = s.vector("pos")
    rows = s.df.select(x.alias("x"), y.alias("y"), z.alias("z"), F.greatest(s.col("smooth"), F.lit(least_h)).alias("h"), s.col("mass").alias("m"), s.col("rho").alias("rho"), quantity.alias("q"))
    return rows.where(F.col("q").isNotNull() & ~F.isnan("q") & (F.col("h") > 0))


def _copies(rows: DataFrame, box: float | None, width: float, axes: str) -> DataFrame:
    """Rows with their periodic images that can reach the picture."""
    if not box:
        return rows
    reach = int(math.ceil(width / box / 2)) + 1
    for c in axes:
        rows = rows.withColumn("o", F.explode(F.array(*[F.lit(float(k) * box) for k in range(-reach, reach + 1)]))).withColumn(c, F.col(c) + F.col("o")).drop("o")
        rows = rows.where(F.abs(F.col(c)) <= width / 2 + 2 * F.col("h"))
    return rows


def image(s: Snapshot, quantity: str | Column = "rho", width: float = 10.0, n: int = 128, project: bool = False, z: float = 0.0, kern="cubic_spline", weight: str | Column | None = None, camera: float | None = None, denoise: bool = False, smooth_range: tuple[float, float | None] = (0.0, None)) -> DataFrame:
    """px, py and value of the pixels that anything reaches.

    A slice at height z sums q m / rho W; a projection integrates along the line of
    sight.  `weight` gives the average of the quantity under a weight; `denoise` divides
    by the image of ones.  A camera at a height z makes a perspective view.  Only rows whose
    smoothing length, in pixels, is in `smooth_range` (its upper end excluded) take part."""
    q = s.col(quantity) if isinstance(quantity, str) else quantity
    if weight is not None:
        w = s.col(weight) if isinstance(weight, str) else weight
        top = image(s, q * w, width, n, True, z, kern, camera=camera, smooth_range=smooth_range)
        bottom = image(s, w, width, n, True, z, kern, camera=camera, smooth_range=smooth_range).withColumnRenamed("value", "w")
        return top.join(bottom, ["px", "py"]).select("px", "py", F.try_divide("value", "w").alias("value"))
    if denoise:
        top = image(s, q, width, n, project, z, kern, camera=camera, smooth_range=smooth_range)
        ones = image(s, F.lit(1.0), width, n, project, z, kern, camera=camera, smooth_range=smooth_range).withColumnRenamed("value", "w")
        return top.join(ones, ["px", "py"]).select("px", "py", F.try_divide("value", "w").alias("value"))
    step = width / n
    rows = _rows(s, q, step / 2 if project else 1e-300)
    least, most = smooth_range
    if least > 0:
        rows = rows.where(F.col("h") >= least * step)
    if most is not None:
        rows = rows.where(F.col("h") < most * step)
    rows = _copies(rows, s.properties.get("boxsize"), width, "xy")
    if camera is not None:
        scale = F.lit(camera) / (F.lit(camera) - F.col("z"))
        rows = rows.where(F.col("z") < camera).withColumns({"x": F.col("x") * scale, "y": F.col("y") * scale, "h": F.col("h") * scale})
    lo = -width / 2
    if not project:
        rows = rows.where(F.abs(F.col("z") - z) < 2 * F.col("h"))
    spread = rows.withColumn("px", F.explode(_pixels(F.col("x"), F.col("h"), lo, step, n))).withColumn("py", F.explode(_pixels(F.col("y"), F.col("h"), lo, step, n)))
    dx, dy = F.col("px") * step + (lo + step / 2) - F.col("x"), F.col("py") * step + (lo + step / 2) - F.col("y")
    d2 = dx * dx + dy * dy
    h = F.col("h")
    if project:
        table = F.array(*[F.lit(v) for v in projected(kernel(kern))])
        k = F.floor(F.lit(201) * d2 / (4 * h * h)).cast("int")
        value = F.when(k < 201, F.element_at(table, k + 1)).otherwise(0.0) / (h * h)
    else:
        dz = F.col("z") - z
        value = kernel(kern).w(F.sqrt(d2 + dz * dz) / h) / (math.pi * h * h * h)
    return spread.groupBy("px", "py").agg(F.sum(F.col("q") * F.col("m") / F.col("rho") * value).alias("value")).where("value <> 0")


def zoomed(img: DataFrame, m: int, n: int) -> DataFrame:
    """An image of m x m pixels on n x n finer ones, bilinearly between the pixels' middles;
    beyond the picture it is 0.  Each pixel spreads over the finer ones that it reaches."""
    f = n / m
    out, weight = img, F.col("value")
    for p in ("px", "py"):
        # places of finer middles in coarse pixels: (i + 0.5) / f - 0.5
        first = F.greatest(F.ceil((F.col(p) - 0.5) * f - 0.5), F.lit(0))
        last = F.least(F.floor((F.col(p) + 1.5) * f - 0.5), F.lit(n - 1))
        out = out.withColumn(f"f{p}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        weight = weight * F.greatest(F.lit(0.0), 1 - F.abs((F.col(f"f{p}") + 0.5) / f - 0.5 - F.col(p)))
    return out.groupBy(F.col("fpx").alias("px"), F.col("fpy").alias("py")).agg(F.sum(weight).alias("value"))


def approximate(s: Snapshot, quantity: str | Column = "rho", width: float = 10.0, n: int = 512, levels: int = 3, factor: int = 8, **kwargs) -> DataFrame:
    """px, py and value of an image that draws wide kernels on coarser grids.

    A level has `factor` times wider pixels than the one before and takes the rows whose
    smoothing length is less than `factor` of its pixels (the last takes all others); levels
    are enlarged bilinearly and added.  A row thus spreads over a bounded number of pixels,
    however wide its kernel is.  `kwargs` are those of `image`."""
    if levels < 1 or n % factor ** (levels - 1):
        raise ValueError("n must be a multiple of factor ** (levels - 1)")
    out = None
    for level in range(levels):
        m = n // factor**level
        part = image(s, quantity, width, m, smooth_range=(1.0 if level else 0.0, None if level == levels - 1 else float(factor)), **kwargs)
        part = zoomed(part, m, n) if level else part
        out = part if out is None else out.unionByName(part)
    return out.groupBy("px", "py").agg(F.sum("value").alias("value")).where("value <> 0")


def grid(s: Snapshot, quantity: str | Column = "rho", width: float = 10.0, n: int = 32, kern="cubic_spline") -> DataFrame:
    """px, py, pz and value on a cubic grid."""
    q = s.col(quantity) if isinstance(quantity, str) else quantity
    step, lo = width / n, -width / 2
    rows = _copies(_rows(s, q, 1e-300), s.properties.get("boxsize"), width, "xyz")
    out = rows
    for p, c in (("px", "x"), ("py", "y"), ("pz", "z")):
        out = out.withColumn(p, F.explode(_pixels(F.col(c), F.col("h"), lo, step, n)))
    d = [F.col(p) * step + (lo + step / 2) - F.col(c) for p, c in (("px", "x"), ("py", "y"), ("pz", "z"))]
    h = F.col("h")
    w = kernel(kern).w(F.sqrt(sum(v * v for v in d)) / h) / (math.pi * h * h * h)
    return out.groupBy("px", "py", "pz").agg(F.sum(F.col("q") * F.col("m") / F.col("rho") * w).alias("value")).where("value <> 0")


def velocity_image(s: Snapshot, quantity: str | Column = "rho", width: float = 10.0, n: int = 128, arrows: int = 40, vector: str = "vel", project: bool = False, **kwargs) -> tuple[DataFrame, DataFrame]:
    """The image of a quantity, and px, py, vx, vy of a coarser image of a vector's first
    two components; pixels that only one of them reaches have 0 for the other."""
    field = image(s, quantity, width, n, project, **kwargs)
    parts = [image(s, c, width, arrows, project, **kwargs).withColumnRenamed("value", k) for c, k in zip(s.vector(vector)[:2], ("vx", "vy"), strict=True)]
    both = parts[0].join(parts[1], ["px", "py"], "full")
    return field, both.select("px", "py", F.coalesce("vx", F.lit(0.0)).alias("vx"), F.coalesce("vy", F.lit(0.0)).alias("vy"))


def ring_pixel(theta: Column, phi: Column, nside: int) -> Column:
    """Number of the equal-area sky pixel (ring order) that holds a direction."""
    z, za = F.cos(theta), F.abs(F.cos(theta))
    tt = F.pmod(phi, F.lit(2 * math.pi)) / (math.pi / 2)
    npix, ncap = 12 * nside * nside, 2 * nside * (nside - 1)
    # the equatorial belt
    a, b = nside * (0.5 + tt), nside * z * 0.75
    jp, jm = F.floor(a - b), F.floor(a + b)
    ir = nside + 1 + jp - jm
    shift = 1 - F.pmod(ir, F.lit(2))
    ip = F.pmod(F.floor((jp + jm - nside + shift + 1) / 2), F.lit(4 * nside))
    belt = ncap + (ir - 1) * (4 * nside) + ip
    # the caps
    tp = tt - F.floor(tt)
    tmp = nside * F.sqrt(3 * (1 - za))
    jp2, jm2 = F.floor(tp * tmp), F.floor((1 - tp) * tmp)
    ir2 = jp2 + jm2 + 1
    ip2 = F.pmod(F.floor(tt * ir2), 4 * ir2)
    cap = F.when(z > 0, 2 * ir2 * (ir2 - 1) + ip2).otherwise(npix - 2 * ir2 * (ir2 + 1) + ip2)
    return F.when(za <= 2 / 3, belt).otherwise(cap).cast("long")


def _ring(i: Column, nside: int) -> tuple[Column, Column, Column, Column]:
    """Of a ring of sky pixels (from 1): pixels, first pixel, z of the middles, and the
    place of the first middle in steps along the ring."""
    south = 4 * nside - i
    n = F.when(i < nside, 4 * i).when(i <= 3 * nside, F.lit(4 * nside)).otherwise(4 * south)
    first = F.when(i < nside, 2 * i * (i - 1)).when(i <= 3 * nside, 2 * nside * (nside - 1) + (i - nside) * (4 * nside)).otherwise(12 * nside * nside - 2 * south * (south + 1))
    z = F.when(i < nside, 1 - i * i / (3 * nside * nside)).when(i <= 3 * nside, (2 * nside - i) / (1.5 * nside)).otherwise(south * south / (3 * nside * nside) - 1)
    place = F.when((i > nside) & (i < 3 * nside) & (F.pmod(i - nside, F.lit(2)) == 1), 0.0).otherwise(0.5)
    return n, first, z, place


def _disc(rows: DataFrame, nside: int) -> DataFrame:
    """A row for each sky pixel whose middle is at most `reach` (radians) from the
    direction (ux, uy, uz): pix and angle.

    Rings and places along them come from bounds a pixel wider; the angle decides."""
    theta, reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("uz")))), F.col("reach")
    ring_of = lambda z: F.when(z > 2 / 3, nside * F.sqrt(3 * (1 - z))).when(z >= -2 / 3, nside * (2 - 1.5 * z)).otherwise(4 * nside - nside * F.sqrt(3 * (1 + z)))
    first = F.greatest(F.floor(ring_of(F.cos(F.greatest(theta - reach, F.lit(0.0))))) - 1, F.lit(1))
    last = F.least(F.ceil(ring_of(F.cos(F.least(theta + reach, F.lit(math.pi))))) + 1, F.lit(4 * nside - 1))
    out = rows.withColumn("ring", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    out = out.withColumns(dict(zip(("n", "start", "pz", "place"), _ring(F.col("ring"), nside), strict=True)))
    ps = F.sqrt(1 - F.col("pz") * F.col("pz"))
    # over a pole or past a quarter turn the whole ring is tried
    c = (F.cos(reach) - F.col("pz") * F.col("uz")) / (ps * F.sqrt(F.greatest(1 - F.col("uz") * F.col("uz"), F.lit(1e-300))))
    half = F.when((reach >= math.pi / 2) | (c <= 0), math.pi).otherwise(F.acos(F.least(c, F.lit(1.0))))
    step = 2 * math.pi / F.col("n")
    middle = F.atan2("uy", "ux") / step - F.col("place")
    wide = F.floor(half / step) + 2
    along = F.when(2 * wide + 1 >= F.col("n"), F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.sequence(F.floor(middle) - wide + 1, F.floor(middle) + wide))
    out = out.withColumn("k", F.explode(along)).withColumn("k", F.pmod("k", "n"))
    phi = (F.col("k") + F.col("place")) * step
    d = (ps * F.cos(phi) - F.col("ux"), ps * F.sin(phi) - F.col("uy"), F.col("pz") - F.col("uz"))
    angle = 2 * F.asin(F.least(F.sqrt(sum(v * v for v in d)) / 2, F.lit(1.0)))
    return out.withColumns({"pix": F.col("start") + F.col("k"), "angle": angle}).where((F.col("angle") <= reach) | (reach >= math.pi))


def sky(s: Snapshot, nside: int = 16, shell: float | None = None, quantity: str | Column = "rho", kern="cubic_spline", weight: str | Column | None = None, denoise: bool = False) -> DataFrame:
    """pix and value of the equal-area sky pixels (ring order) that any kernel reaches.

    Without a shell the sum of q m / rho times the projected kernel, for each steradian;
    a row at the origin has no direction and is left out.  With one, the quantity on the
    sphere of that radius, by the 3-D kernel.  Pixels are sampled at their middles.
    `weight` and `denoise` are those of `image`."""
    if nside < 1 or nside & (nside - 1):
        raise ValueError("nside must be a power of 2")
    if shell is not None and shell <= 0:
        raise ValueError("a shell's radius must be positive")
    q = s.col(quantity) if isinstance(quantity, str) else quantity
    if weight is not None or denoise:
        w = F.lit(1.0) if weight is None else s.col(weight) if isinstance(weight, str) else weight
        bottom = sky(s, nside, shell, w, kern).withColumnRenamed("value", "w")
        return sky(s, nside, shell, q * w, kern).join(bottom, "pix").select("pix", F.try_divide("value", "w").alias("value"))
    h, r = F.col("h"), F.col("r")
    rows = _rows(s, q, 1e-300).withColumn("r", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    if shell is None:
        rows = rows.where("r > 0").withColumn("reach", F.least(2 * h / r, F.lit(math.pi)))
    else:
        near = F.try_divide(shell * shell + r * r - 4 * h * h, 2 * shell * r)
        rows = rows.where(F.abs(r - shell) < 2 * h).withColumn("reach", F.when((r == 0) | (near <= -1), math.pi).otherwise(F.acos(F.least(near, F.lit(1.0)))))
    # at the origin any direction does: the whole sphere is as far
    unit = {f"u{c}": F.when(r > 0, F.col(c) / r).otherwise(1.0 if c == "z" else 0.0) for c in "xyz"}
    spread = _disc(rows.withColumns(unit), nside)
    if shell is None:
        table = F.array(*[F.lit(v) for v in projected(kernel(kern))])
        k = F.floor(F.lit(201) * (r * F.col("angle") / (2 * h)) * (r * F.col("angle") / (2 * h))).cast("int")
        value = F.when(k < 201, F.element_at(table, k + 1)).otherwise(0.0) * (r / h) * (r / h)
    else:
        d2 = (r - shell) * (r - shell) + 4 * shell * r * F.sin(F.col("angle") / 2) * F.sin(F.col("angle") / 2)
        value = kernel(kern).w(F.sqrt(d2) / h) / (math.pi * h * h * h)
    return spread.groupBy("pix").agg(F.sum(F.col("q") * F.col("m") / F.col("rho") * value).alias("value")).where("value <> 0")


def magnitudes(img: DataFrame, width: float, n: int) -> DataFrame:
    """Surface brightness in magnitudes per square arcsecond at 10 pc from an image of
    luminosity per square kpc."""
    # square parsecs in a square arcsecond at 10 pc
    return img.select("px", "py", (-2.5 * F.log10(F.col("value") / 1e6 * 2.3504430539466191e-09)).alias("mag"))


def rgb(images: dict[str, DataFrame], scales: dict[str, float], dynamic_range: float = 2.0) -> DataFrame:
    """Three images of bands r, g and b as numbers from 0 to 1 on a logarithmic scale
    below the brightest."""
    out = None
    for band in ("r", "g", "b"):
        one = images[band].select("px", "py", F.log10(F.col("value") * scales[band]).alias(band))
        out = one if out is None else out.join(one, ["px", "py"], "full")
    top = out.agg(*[F.max(b) for b in ("r", "g", "b")]).first()
    most = max(v for v in top if v is not None)
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce(c, F.lit(-1e300)) - (most - dynamic_range)) / dynamic_range))
    return out.select("px", "py", *[unit(F.col(b)).alias(b) for b in ("r", "g", "b")])
