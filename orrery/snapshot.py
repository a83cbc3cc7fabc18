"""Snapshots: a DataFrame of particles with units, families and lazily derived columns.

A snapshot never changes.  Views, unit conversions and transformations are projections
and filters on the same plan, so that Catalyst sees one query, prunes its columns and
pushes its filters to the scan.  Rows have `pidx` (their place in the file), `family`,
and scalar columns; the vector `v` is v's components, `pos` is x, y, z and `vel` is vx,
vy, vz.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .units import NO_UNIT, Unit, as_unit

#: Families and their aliases.
FAMILIES: dict[str, tuple[str, ...]] = {
    "dm": ("d", "dark"),
    "star": ("stars", "st", "s"),
    "gas": ("g",),
    "neutrino": ("n", "neu"),
    "bh": (),
    "debris": (),
    "gas_tracer": (),
    "dm_tracer": (),
    "star_tracer": (),
    "cloud_tracer": (),
    "debris_tracer": (),
    "cloud": (),
}
VECTORS = {"pos": ("x", "y", "z"), "vel": ("vx", "vy", "vz")}
#: Cosmology that a snapshot without its own has.
COSMOLOGY = {"a": 1.0, "h": 0.6766, "omegaM0": 0.3111, "omegaL0": 0.6889, "omegaB0": 0.049, "sigma8": 0.8102, "ns": 0.9665, "running": 0.0}
ROW = "pidx"
#: The column of views whose rows are in an order of their own, and an end beyond any file.
PLACE = "__place"
_OPEN = 1 << 62


def family_name(name: str) -> str:
    """The family of a name or alias; names that are in no table stand for themselves."""
    low = name.lower()
    for f, aliases in FAMILIES.items():
        if low == f or low in aliases:
            return f
    return name


def add_family(name: str, aliases: Sequence[str] = ()) -> None:
    FAMILIES[name] = tuple(aliases)


def components(name: str) -> tuple[str, str, str]:
    return VECTORS.get(name, (f"{name}_x", f"{name}_y", f"{name}_z"))


def vector_of(name: str) -> str | None:
    """The vector that a component belongs to."""
    for v, parts in VECTORS.items():
        if name in parts:
            return v
    return name[:-2] if name[-2:] in ("_x", "_y", "_z") else None


class DependencyError(RuntimeError):
    """A derived column that depends on itself."""


#: Derived columns: name to (function of a snapshot, inputs that mark where it applies).
_derived: dict[str, Callable[[Snapshot], Column]] = {}
_derived_units: dict[str, Callable[[Snapshot], Unit] | Unit] = {}
_openers: list[Callable[[Snapshot], Snapshot]] = []


def derived(name: str | None = None, unit=None):
    """Registers a function of a snapshot as the column of its name."""

    def add(fn):
        _derived[name or fn.__name__] = fn
        if unit is not None:
            _derived_units[name or fn.__name__] = unit
        return fn

    return add


def on_open(fn: Callable[[Snapshot], Snapshot]):
    """Registers a function that each opened snapshot goes through."""
    _openers.append(fn)
    return fn


@dataclass(frozen=True)
class Snapshot:
    df: DataFrame
    units: dict[str, Unit] = field(default_factory=dict)
    properties: dict[str, float] = field(default_factory=dict)
    #: families that have a column which not all have
    ragged: dict[str, frozenset[str]] = field(default_factory=dict)
    base: Snapshot | None = None
    #: transformations applied so far, the last one last
    done: tuple = ()
    #: the rows of the file, in its order, if the view is a slice (of slices) of them all
    span: range | None = None
    #: the column that orders the rows, where that isn't the file's order; rows may repeat then
    order: str | None = None
    _stack: tuple[str, ...] = ()

    # ---- columns

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def keys(self) -> list[str]:
        return [c for c in self.df.columns if c not in (ROW, "family", PLACE)]

    def derivable_keys(self) -> list[str]:
        return sorted(_derived)

    def all_keys(self) -> list[str]:
        return sorted({*self.keys(), *_derived})

    def has_key(self, name: str) -> bool:
        return name in self.df.columns or name in _derived

    def prop(self, name: str, default: float | None = None) -> float:
        """A property; z follows from a, and cosmology has defaults."""
        if name in self.properties:
            return self.properties[name]
        if name == "z" and "a" in self.properties:
            return 1 / self.properties["a"] - 1
        if name == "a" and "z" in self.properties:
            return 1 / (1 + self.properties["z"])
        if name == "z":
            return 1 / COSMOLOGY["a"] - 1
        if name in COSMOLOGY:
            return COSMOLOGY[name]
        if default is None:
            raise KeyError(name)
        return default

    def is_derived(self, name: str) -> bool:
        return name not in self.df.columns and name in _derived

    def col(self, name: str) -> Column:
        """The column of a name: stored, else a vector, else derived; else KeyError."""
        if name in self.df.columns:
            if name in self.ragged and not self._families_within(self.ragged[name]):
                raise KeyError(f"{name} is there for {sorted(self.ragged[name])} only")
            return F.col(f"`{name}`")
        if name in _derived:
            if name in self._stack:
                raise DependencyError(" -> ".join([*self._stack, name]))
            return _derived[name](replace(self, _stack=(*self._stack, name)))
        if name in VECTORS or all(c in self.df.columns or c in _derived for c in components(name)):
            return F.array(*[self.col(c) for c in components(name)])
        v = vector_of(name)
        if v and v not in VECTORS and v in self.df.columns:
            return F.col(f"`{v}`")["xyz".index(name[-1])]
        raise KeyError(name)

    __getitem_column__ = col

    def vector(self, name: str) -> tuple[Column, Column, Column]:
        """The three components of a vector."""
        if name in self.df.columns:
            return tuple(F.col(f"`{name}`")[k] for k in range(3))
        return tuple(self.col(c) for c in components(name))

    def is_vector(self, name: str) -> bool:
        if name in self.df.columns:
            return dict(self.df.dtypes)[name].startswith("array")
        return name not in _derived and (name in VECTORS or all(self.has_key(c) for c in components(name)))

    def _families_within(self, families: frozenset[str]) -> bool:
        own = self.properties.get("__families")
        return own is not None and set(own) <= families

    def unit(self, name: str) -> Unit:
        if name in self.units:
            return self.units[name]
        v = vector_of(name)
        if v and v in self.units:
            return self.units[v]
        got = _derived_units.get(name, NO_UNIT)
        return got(self) if callable(got) else as_unit(got)

    def select(self, *names: str) -> DataFrame:
        """Named columns as a DataFrame."""
        return self.df.select(*[self.col(n).alias(n) for n in names])

    def with_column(self, name: str, value: Column, unit=None) -> Snapshot:
        """With a column added or replaced."""
        units = self.units | ({name: as_unit(unit)} if unit is not None else {})
        return replace(self, df=self.df.withColumn(name, value), units=units)

    def set_where(self, name: str, mask: Column, value: Column) -> Snapshot:
        """With a column changed in some rows: what writing through a view does."""
        old = self.col(name) if self.has_key(name) else F.lit(0.0)
        return self.with_column(name, F.when(mask, value).otherwise(old))

    def freeze(self, name: str) -> Snapshot:
        """A derived column made plain data."""
        return self.with_column(name, self.col(name), self.unit(name))

    def without(self, name: str) -> Snapshot:
        return replace(self, df=self.df.drop(name))

    # ---- units

    def context(self) -> dict[str, float]:
        return {"a": self.prop("a"), "h": self.prop("h")}

    def factor(self, name: str, to) -> float:
        return self.unit(name).ratio(to, **self.context())

    def in_units(self, name: str, to) -> Column:
        return self.col(name) * F.lit(self.factor(name, to))

    def value_in(self, quantity, name: str) -> float:
        """A threshold such as `3 kpc` as a number of the column's unit; plain numbers
        stay."""
        if isinstance(quantity, (str, Unit)):
            return as_unit(quantity).ratio(self.unit(name), **self.context())
        return float(quantity)

    def physical_units(self, distance="kpc", velocity="km s^-1", mass="Msol") -> Snapshot:
        """All columns with a unit converted to a system of units."""
        system = [as_unit(distance), as_unit(velocity), as_unit(mass), as_unit("K"), as_unit("a"), as_unit("h")]
        df, units = self.df, dict(self.units)
        for name, old in self.units.items():
            if old.dimensionless:
                continue
            plain = old.substituted(**self.context())
            try:
                powers = plain.dimensional_project(system)
            except ValueError:
                continue
            new = Unit()
            for u, p in zip(system, powers, strict=True):
                new = new * u**p
            ratio = old.ratio(new, **self.context())
            for c in components(name) if name in VECTORS or name not in df.columns else (name,):
                if c in df.columns and ratio != 1:
                    df = df.withColumn(c, F.col(f"`{c}`") * F.lit(ratio))
            units[name] = new
        return replace(self, df=df, units=units)

    # ---- views and set operations

    def where(self, what) -> Snapshot:
        """The rows of a filter or boolean column."""
        mask = what if isinstance(what, Column) else what.column(self)
        s = self.carried()
        return replace(s, df=s.df.where(mask), base=self, span=None)

    def family(self, *names: str) -> Snapshot:
        """The rows of families."""
        full = [family_name(n) for n in names]
        view = self.where(F.col("family").isin(*full))
        return replace(view, properties=view.properties | {"__families": tuple(full)})

    def families(self) -> DataFrame:
        """Families in the order of their first rows, with their sizes."""
        return self.df.groupBy("family").agg(F.min(ROW).alias("first"), F.count(F.lit(1)).alias("n"))

    def _placed(self) -> DataFrame:
        """The rows' numbers in the file (and order) and their places (from 0) in this
        snapshot.  In slices of the file a place follows from the row's number."""
        if self.order is not None:
            return numbered(self.df.select(ROW, self.order), self.order, "place")
        if self.base is None or self.span is not None:
            span = self.span or range(_OPEN)
            return self.df.select(ROW, F.expr(f"({ROW} - {span.start}L) div {span.step}L").alias("place"))
        return numbered(self.df.select(ROW), ROW, "place")

    def _at(self, places: DataFrame) -> Snapshot:
        on = [ROW] if self.order is None else [ROW, self.order]
        return replace(self, df=self.df.join(places.select(on), on, "left_semi"), base=self, span=None)

    def carried(self) -> Snapshot:
        """The same view; one whose rows run backwards gets a column that says so, which
        filters and joins keep."""
        if self.span is None or self.span.step > 0 or self.order is not None:
            return self
        place = F.expr(f"({ROW} - {self.span.start}L) div {self.span.step}L")
        return replace(self, df=self.df.withColumn(PLACE, place), order=PLACE, span=None)

    def ordered(self) -> DataFrame:
        """The rows as a frame, sorted in the view's order."""
        s = self.carried()
        return s.df.orderBy(s.order or ROW).drop(PLACE)

    def _span(self, clip: bool) -> range:
        """The rows of the file that a slice holds; open at its end unless it has to be known."""
        span = range(_OPEN) if self.span is None else self.span
        if clip and span.step > 0:
            span = range(span.start, min(span.stop, self.ancestor().df.count()), span.step)
        return span

    def rows(self, start: int | None = None, stop: int | None = None, step: int | None = None) -> Snapshot:
        """A slice of this snapshot's own row order, as of a sequence: negative numbers count
        from the end, negative steps run backwards, and a view's rows are numbered anew.

        A slice of a slice is one predicate on the rows' numbers, which counts the file if
        anything is said from its end.  Other views' rows are ranked first."""
        step = 1 if step is None else step
        if self.order is None and (self.base is None or self.span is not None):
            clip = step < 0 or any(v is not None and v < 0 for v in (start, stop))
            span = self._span(clip)[start:stop:step]
            row, first = F.col(ROW), span.start
            if not span:
                mask = F.lit(False)
            elif span.step > 0:
                mask = row >= first
                mask = mask & (row < span.stop) if span.stop < _OPEN else mask
            else:
                mask = (row <= first) & (row >= span[-1])
            if abs(span.step) != 1:
                mask &= F.pmod(row - first, F.lit(abs(span.step))) == 0
            return replace(self, df=self.df.where(mask), base=self, span=span)
        n = self.df.count() if step < 0 or start is not None and start < 0 or stop is not None and stop < 0 else _OPEN
        want, place = range(n)[start:stop:step], F.col("place")
        mask = F.lit(False) if not want else (place >= min(want[0], want[-1])) & (place <= max(want[0], want[-1])) & (F.pmod(place - want[0], F.lit(abs(step))) == 0)
        view = self._at(placed := self._placed().where(mask))
        if step > 0:
            return view
        on = [ROW] if self.order is None else [ROW, self.order]
        back = placed.select(*on, (-F.col("place")).alias("__back"))
        return replace(view, df=view.df.join(back, on).drop(PLACE).withColumnRenamed("__back", PLACE), order=PLACE)

    def take(self, places: Sequence[int] | DataFrame) -> Snapshot:
        """The rows at places of this snapshot, in the order of a list, as often as they are
        asked for.  Negative places of a list count from the end; a place outside is an
        error.  A frame of places gives its rows once, in this snapshot's order; with a
        second column, they come in that order, as often as they are in the frame."""
        if not isinstance(places, DataFrame):
            n, found = self.df.count(), [int(p) for p in places]
            if any(not -n <= p < n for p in found):
                raise IndexError(f"places are from {-n} to {n - 1}")
            found = [p % n for p in found]
            if all(a < b for a, b in zip(found, found[1:], strict=False)):
                places = self.spark.createDataFrame([(p,) for p in found], "place long")
            else:
                places = self.spark.createDataFrame(list(zip(found, range(len(found)), strict=True)), "place long, at long")
        if len(places.columns) == 1:
            return self._at(self._placed().join(places.toDF("place").distinct(), "place", "left_semi"))
        on = [ROW] if self.order is None else [ROW, self.order]
        asked = self._placed().join(places.toDF("place", "__at"), "place").select(*on, "__at")
        df = self.df.join(asked, on).drop(PLACE).withColumnRenamed("__at", PLACE)
        return replace(self, df=df, base=self, span=None, order=PLACE)

    def __getitem__(self, what):
        """A column or vector by name, or a view by slice, filter, boolean column, family or
        places."""
        if isinstance(what, str):
            if not self.has_key(what) and not self.is_vector(what) and family_name(what) in FAMILIES:
                return self.family(what)
            return self.vector(what) if self.is_vector(what) else self.col(what)
        if isinstance(what, slice):
            return self.rows(what.start, what.stop, what.step)
        if isinstance(what, Column) or hasattr(what, "column"):
            return self.where(what)
        if isinstance(what, int):
            return self.take([what])
        return self.take(what)

    def __getattr__(self, name: str):
        """Families by name or alias."""
        if not name.startswith("_") and family_name(name) in FAMILIES:
            return self.family(name)
        raise AttributeError(name)

    def ids(self, ids: DataFrame, column: str = "iord", missing: str = "ignore") -> Snapshot:
        """The rows whose id is in the only column of another frame.  Ids that no row has
        are left out; with missing="raise" they are a KeyError that names up to ten."""
        keys = ids.toDF(column).distinct()
        if missing == "raise" and (lost := [r[0] for r in keys.join(self.df, column, "left_anti").orderBy(column).limit(10).collect()]):
            raise KeyError(f"no rows of {column} {lost}")
        s = self.carried()
        return replace(s, df=s.df.join(keys, column, "left_semi"), base=self, span=None)

    def union(self, other: Snapshot) -> Snapshot:
        """Rows that are in either view of one snapshot, once and in the file's order."""
        plain = [c for c in self.df.columns if c != PLACE]
        return replace(self, df=self.df.select(plain).unionByName(other.df.select(plain)).dropDuplicates([ROW]), span=None, order=None)

    def intersect(self, other: Snapshot) -> Snapshot:
        s = self.carried()
        return replace(s, df=s.df.join(other.df.select(ROW), ROW, "left_semi"), span=None)

    def setdiff(self, other: Snapshot) -> Snapshot:
        s = self.carried()
        return replace(s, df=s.df.join(other.df.select(ROW), ROW, "left_anti"), span=None)

    def ancestor(self) -> Snapshot:
        s = self
        while s.base is not None:
            s = s.base
        return s

    def is_descendant(self, other: Snapshot) -> bool:
        s: Snapshot | None = self
        while s is not None:
            if s is other:
                return True
            s = s.base
        return False

    def same_rows(self, other: Snapshot) -> bool:
        """Whether two views hold the same rows of the file."""
        key = lambda s: s.df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(ROW)), F.sum(ROW)).first()
        return tuple(key(self)) == tuple(key(other))

    def index_in(self, other: Snapshot) -> DataFrame:
        """Places of this view's rows among another's, both in file order: pidx, place.
        Counts by range of rows keep the numbering from one task."""
        return numbered(other.df.select(ROW), ROW, "place").join(self.df.select(ROW), ROW, "left_semi")

    def wrap(self, boxsize: float | None = None, convention: str = "center") -> Snapshot:
        """Positions moved by one box length at most, into (-L/2, L/2] or [0, L)."""
        size = self.prop("boxsize") if boxsize is None else boxsize
        df = self.df
        for c in VECTORS["pos"]:
            x = F.col(c)
            if convention == "center":
                moved = F.when(x > size / 2, x - size).when(x <= -size / 2, x + size).otherwise(x)
            elif convention == "upper":
                moved = F.when(x >= size, x - size).when(x < 0, x + size).otherwise(x)
            else:
                raise ValueError(f"no convention {convention!r}")
            df = df.withColumn(c, moved)
        return replace(self, df=df)

    def mean_by_mass(self, name: str) -> DataFrame:
        """Mass-weighted mean of a column or vector, one row."""
        m = self.col("mass")
        if self.is_vector(name):
            cols = dict(zip(components(name), self.vector(name), strict=True))
        else:
            cols = {name: self.col(name)}
        return self.df.agg(*[(F.sum(m * c) / F.sum(m)).alias(k) for k, c in cols.items()])


def _literal(v) -> Column:
    return F.struct(*[_literal(x).alias(k) for k, x in v.asDict().items()]) if isinstance(v, Row) else F.lit(v)


def at_most(marks: Column, n: int, x: Column) -> Column:
    """How many of n ascending marks are at most x, by bisection; null x count as less."""
    steps = [F.lit(1 << k) for k in range(max(n, 1).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*steps), F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(marks, at + step - 1) <= x), at + step).otherwise(at))


def ranged(df: DataFrame, by: str, parts: int | None = None) -> DataFrame:
    """df with `__p`, the number of the range of `by` that a row lies in.

    The ranges' least values (one for each shuffle partition) are found once and are literals
    in the plan: a range is a function of the key alone, so that plans which use it twice, or
    tasks that run again, agree.  Nulls lie in the first range, equal keys in one."""
    n = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(by).where(F.col(by).isNotNull()).repartitionByRange(n, by).withColumn("__p", F.spark_partition_id())
    lows = keys.groupBy("__p").agg(F.min(by).alias("low")).orderBy("low").collect()[1:]
    if not lows:
        return df.withColumn("__p", F.lit(0))
    marks = F.array(*[_literal(r["low"]) for r in lows]).cast(f"array<{df.schema[by].dataType.simpleString()}>")
    return df.withColumn("__p", at_most(marks, len(lows), F.col(by)))


def numbered(df: DataFrame, by: str, name: str, parts: int | None = None) -> DataFrame:
    """df with the rank (from 0) of each row in the order of `by`.

    Rows are numbered within ranges; the ranges' sizes, one number each, give the offsets.
    No task sees all rows."""
    rows = ranged(df, by, parts)
    # one row for each range
    sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    at = rows.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(by)) - 1)
    return at.join(F.broadcast(before), "__p").withColumn(name, F.col("__i") + F.col("__b")).drop("__p", "__i", "__b")


def contiguous(df: DataFrame, name: str) -> DataFrame:
    """df with the place of each row in the order of its partitions, from 0 without gaps:
    its place in its partition behind the rows of the partitions before."""
    at = F.monotonically_increasing_id()
    rows = df.withColumn("__p", F.shiftright(at, 33)).withColumn("__i", at.bitwiseAND(F.lit((1 << 33) - 1)))
    # one row for each partition
    sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return rows.join(F.broadcast(before), "__p").withColumn(name, F.col("__i") + F.col("__b")).drop("__p", "__i", "__b")


def snapshot(df: DataFrame, units: dict | None = None, properties: dict | None = None, ragged: dict | None = None) -> Snapshot:
    """A snapshot of a DataFrame.  Rows without `pidx` get one in the order of the file's
    partitions, without gaps (of a file, or another source that gives its rows in one order); without `family` all are dark matter."""
    if ROW not in df.columns:
        df = contiguous(df, ROW)
    if "family" not in df.columns:
        df = df.withColumn("family", F.lit("dm"))
    s = Snapshot(df, {k: as_unit(v) for k, v in (units or {}).items()}, dict(properties or {}), {k: frozenset(v) for k, v in (ragged or {}).items()})
    for fn in _openers:
        s = fn(s)
    return s


def new(spark: SparkSession, units: dict | None = None, properties: dict | None = None, **sizes: int) -> Snapshot:
    """A blank snapshot of families' sizes, in their order: zero pos, vel and mass."""
    n = sum(sizes.values())
    df, at = spark.range(n).withColumnRenamed("id", ROW), 0
    fam = F.lit(None).cast("string")
    for name, k in sizes.items():
        fam = F.when((F.col(ROW) >= at) & (F.col(ROW) < at + k), family_name(name)).otherwise(fam)
        at += k
    df = df.withColumn("family", fam)
    for c in (*VECTORS["pos"], *VECTORS["vel"], "mass"):
        df = df.withColumn(c, F.lit(0.0))
    return snapshot(df, units, properties)


from .functions import derivations  # noqa: E402, F401  (registers the built-in columns)
