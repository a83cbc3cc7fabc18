"""Columns that carry their unit through expressions.

A quantity is a Column and a unit.  Arithmetic works out the unit when the plan is built;
where two units differ, one literal factor goes into the expression, so that Spark sees
plain columns.  Units that contain a or h convert by the context of the snapshot that a
quantity comes from; between two snapshots there is no context.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..snapshot import ROW, Snapshot, numbered, ranged
from ..units import NO_UNIT, Unit, UnitsError, as_unit

#: Functions of columns: name to (function, rule from the units of its arguments to its own).
_rules: dict[str, tuple[Callable, Callable]] = {}


def unit_rule(*names: str, fn: Callable | None = None):
    """Registers a rule, which takes the arguments' units and gives the result's, for
    functions of `pyspark.sql.functions` (or for `fn`) by name."""

    def add(rule):
        for n in names:
            _rules[n] = (fn or getattr(F, n), rule)
        return rule

    return add


@dataclass(frozen=True, eq=False)
class Quantity:
    """A column (or the three components of a vector) with a unit.  `unit` None means that
    no unit is known: it adopts the other side's in sums and counts as 1 in products."""

    column: Column
    unit: Unit | None = None
    s: Snapshot | None = field(default=None, repr=False)

    # ---- conversion

    def context(self, other: Quantity | None = None) -> dict[str, float]:
        owner = self.s
        if isinstance(other, Quantity) and other.s is not None:
            if owner is not None and other.s.ancestor() is not owner.ancestor():
                return {}
            owner = owner or other.s
        return owner.context() if owner is not None else {}

    def in_units(self, unit, **values: float) -> Quantity:
        """The same in another unit; a and h may be given."""
        if self.unit is None:
            raise UnitsError("no unit is known to convert from")
        unit = as_unit(unit)
        return Quantity(_scaled(self.column, self.unit.ratio(unit, **(self.context() | values))), unit, self.s)

    def with_unit(self, unit) -> Quantity:
        """The same numbers under another unit."""
        return Quantity(self.column, as_unit(unit), self.s)

    def _other(self, x) -> Quantity:
        """The other side of an operation: a quantity, a unit (one of it) or a number."""
        if isinstance(x, Quantity):
            return x
        if isinstance(x, Unit) or isinstance(x, str):
            return Quantity(F.lit(1.0), as_unit(x))
        return Quantity(x if isinstance(x, Column) else F.lit(x))

    def _alike(self, x) -> tuple[Column, Column, Unit | None]:
        """Both sides in the first known unit."""
        o = self._other(x)
        if self.unit is None or o.unit is None or self.unit == o.unit:
            return self.column, o.column, self.unit if self.unit is not None else o.unit
        return self.column, _scaled(o.column, o.unit.ratio(self.unit, **self.context(o))), self.unit

    def _compared(self, x) -> tuple[Column, Column]:
        o = self._other(x)
        if o.unit is not None and self.unit is None:
            raise UnitsError("one side of a comparison has a unit and the other has none")
        a, b, _ = self._alike(o)
        return a, b

    # ---- arithmetic

    def __add__(self, x) -> Quantity:
        a, b, u = self._alike(x)
        return Quantity(a + b, u, self.s)

    __radd__ = __add__

    def __sub__(self, x) -> Quantity:
        a, b, u = self._alike(x)
        return Quantity(a - b, u, self.s)

    def __rsub__(self, x) -> Quantity:
        return self._other(x).of(self.s) - self

    def __mul__(self, x) -> Quantity:
        o = self._other(x)
        return Quantity(self.column * o.column, _product(self.unit, o.unit), self.s or o.s)

    __rmul__ = __mul__

    def __truediv__(self, x) -> Quantity:
        o = self._other(x)
        return Quantity(self.column / o.column, _product(self.unit, None if o.unit is None else o.unit**-1), self.s or o.s)

    def __rtruediv__(self, x) -> Quantity:
        return self._other(x).of(self.s) / self

    def __pow__(self, p) -> Quantity:
        p = Fraction(*p) if isinstance(p, tuple) else Fraction(p).limit_denominator(1000)
        return Quantity(F.pow(self.column, F.lit(float(p))), None if self.unit is None else self.unit**p, self.s)

    def __neg__(self) -> Quantity:
        return Quantity(-self.column, self.unit, self.s)

    def __abs__(self) -> Quantity:
        return Quantity(F.abs(self.column), self.unit, self.s)

    def of(self, s: Snapshot | None) -> Quantity:
        return Quantity(self.column, self.unit, s)

    # ---- comparisons give plain boolean columns

    def __lt__(self, x) -> Column:
        a, b = self._compared(x)
        return a < b

    def __le__(self, x) -> Column:
        a, b = self._compared(x)
        return a <= b

    def __gt__(self, x) -> Column:
        a, b = self._compared(x)
        return a > b

    def __ge__(self, x) -> Column:
        a, b = self._compared(x)
        return a >= b

    def __eq__(self, x) -> Column:
        a, b = self._compared(x)
        return a == b

    def __ne__(self, x) -> Column:
        a, b = self._compared(x)
        return a != b

    __hash__ = None

    # ---- reductions, to use in an aggregate

    def sum(self) -> Quantity:
        return Quantity(F.sum(self.column), self.unit, self.s)

    def mean(self) -> Quantity:
        return Quantity(F.avg(self.column), self.unit, self.s)

    def min(self) -> Quantity:
        return Quantity(F.min(self.column), self.unit, self.s)

    def max(self) -> Quantity:
        return Quantity(F.max(self.column), self.unit, self.s)

    def ptp(self) -> Quantity:
        return Quantity(F.max(self.column) - F.min(self.column), self.unit, self.s)

    def std(self) -> Quantity:
        return Quantity(F.stddev_pop(self.column), self.unit, self.s)

    def var(self) -> Quantity:
        return Quantity(F.var_pop(self.column), None if self.unit is None else self.unit**2, self.s)

    def prod(self) -> Quantity:
        """The product; its unit depends on the number of rows and is left open."""
        return Quantity(F.product(self.column), None, self.s)


def _scaled(c: Column, ratio: float) -> Column:
    return c if ratio == 1 else c * F.lit(ratio)


def _product(a: Unit | None, b: Unit | None) -> Unit | None:
    return b if a is None else a if b is None else a * b


def quantity(s: Snapshot, name: str) -> Quantity:
    """A column of a snapshot with its unit."""
    return Quantity(s.col(name), s.unit(name), s)


def vector(s: Snapshot, name: str) -> tuple[Quantity, Quantity, Quantity]:
    return tuple(Quantity(c, s.unit(name), s) for c in s.vector(name))


def norm(parts) -> Quantity:
    """Length of a vector of quantities."""
    first, *rest = parts
    total = first * first
    for p in rest:
        total = total + p * p
    return apply("sqrt", total)


def apply(name: str, *args) -> Quantity:
    """A registered function of quantities, with the unit that its rule gives."""
    if name not in _rules:
        raise UnitsError(f"no unit rule for {name}")
    fn, rule = _rules[name]
    given = [a if isinstance(a, Quantity) else Quantity(a if isinstance(a, Column) else F.lit(a)) for a in args]
    owner = next((g.s for g in given if g.s is not None), None)
    return Quantity(fn(*[g.column for g in given]), rule(*[g.unit for g in given]), owner)


@unit_rule("sqrt")
def _root(u):
    return None if u is None else u ** (1, 2)


@unit_rule("square", fn=lambda c: c * c)
def _square(u):
    return None if u is None else u**2


@unit_rule("sin", "cos", "tan", "asin", "acos", "atan", "atan2", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh")
def _ratio(*_):
    return NO_UNIT


@unit_rule("exp", "log", "log10")
def _open(*_):
    return None


@unit_rule("abs", "negative", "greatest", "least")
def _same(*units):
    known = [u for u in units if u is not None]
    if any(u != known[0] for u in known):
        raise UnitsError("the arguments' units differ")
    return known[0] if known else None


def cumsum(q: Quantity, name: str = "cumsum", df: DataFrame | None = None) -> DataFrame:
    """pidx and the running sum over a snapshot's rows in order.

    Rows are split by ranges of pidx and summed within them; the sums of the ranges, one
    number each, are added up before.  No task sees all rows.  Nulls add nothing."""
    rows = (df or q.s.df).select(ROW, q.column.cast("double").alias("__v"))
    parts = ranged(rows, ROW)
    before = parts.groupBy("__p").agg(F.coalesce(F.sum("__v"), F.lit(0.0)).alias("__t"))
    before = before.select("__p", F.coalesce(F.sum("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__b"))
    run = F.sum("__v").over(Window.partitionBy("__p").orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn(name, F.coalesce(run, F.lit(0.0))).join(F.broadcast(before), "__p").select(ROW, (F.col(name) + F.col("__b")).alias(name))


def gradient(q: Quantity, spacing: Quantity | float = 1.0) -> tuple[DataFrame, Unit | None]:
    """pidx and the central difference over a snapshot's rows in order, one-sided at the
    two ends, for an even spacing; with its unit.  A row meets its neighbours by an
    equi-join on places.  Null if a neighbour is null; empty for fewer than two rows."""
    step = spacing if isinstance(spacing, Quantity) else Quantity(F.lit(float(spacing)))
    rows = numbered(q.s.df.select(ROW, q.column.alias("__v"), step.column.alias("__d")), ROW, "__k")
    prev = rows.select((F.col("__k") + 1).alias("__k"), F.col("__v").alias("__a"), F.lit(1).alias("__has_a"))
    after = rows.select((F.col("__k") - 1).alias("__k"), F.col("__v").alias("__b"), F.lit(1).alias("__has_b"))
    got = rows.join(prev, "__k", "left").join(after, "__k", "left").where("__has_a = 1 OR __has_b = 1")
    left = F.when(F.col("__has_a").isNull(), F.col("__v")).otherwise(F.col("__a"))
    right = F.when(F.col("__has_b").isNull(), F.col("__v")).otherwise(F.col("__b"))
    steps = F.coalesce("__has_a", F.lit(0)) + F.coalesce("__has_b", F.lit(0))
    unit = _product(q.unit, None if step.unit is None else step.unit**-1)
    return got.select(ROW, ((right - left) / (steps * F.col("__d"))).alias("gradient")), unit


def difference(s: Snapshot, name: str) -> DataFrame:
    """pidx and the next row's value less its own, without the last row."""
    rows = numbered(s.df.select(ROW, s.col(name).alias("__v")), ROW, "__k")
    after = rows.select((F.col("__k") - 1).alias("__k"), F.col("__v").alias("__b"))
    return rows.join(after, "__k").select(ROW, (F.col("__b") - F.col("__v")).alias("diff"))


def is_sorted(s: Snapshot, name: str) -> int:
    """1 if a column never falls along the rows' order, else -1 if it never rises, else 0.
    A constant column, no row or one count as sorted upwards; a pair with a null says
    nothing."""
    up, down = difference(s, name).agg(F.coalesce(F.max((F.col("diff") > 0).cast("int")), F.lit(0)), F.coalesce(F.max((F.col("diff") < 0).cast("int")), F.lit(0))).first()
    return 1 if not down else -1 if not up else 0


def takes_arg_in_units(context: str | None = None, **units):
    """A function whose named arguments are given as numbers of these units, whatever a
    caller passes: quantities and texts such as `3 kpc` are converted, numbers stay.
    `context` names the argument (a snapshot) that gives a and h."""

    def wrap(fn):
        sig = inspect.signature(fn)

        @functools.wraps(fn)
        def run(*args, **kwargs):
            bound = sig.bind(*args, **kwargs)
            owner = bound.arguments.get(context) if context else None
            values = owner.context() if owner is not None else {}
            for name, unit in units.items():
                got = bound.arguments.get(name)
                if isinstance(got, Quantity):
                    bound.arguments[name] = got.in_units(unit, **values).column
                elif isinstance(got, (str, Unit)):
                    bound.arguments[name] = as_unit(got).ratio(unit, **values)
            return fn(*bound.args, **bound.kwargs)

        return run

    return wrap


def with_quantity(s: Snapshot, name: str, q: Quantity) -> Snapshot:
    """A snapshot with a quantity as a column, under its unit."""
    return s.with_column(name, q.column, q.unit)


__all__ = ["Quantity", "apply", "cumsum", "difference", "gradient", "is_sorted", "norm", "quantity", "takes_arg_in_units", "unit_rule", "vector", "with_quantity"]
