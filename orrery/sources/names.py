"""Names, families and units of simulation codes' tables.

Codes write a table (an HDF5 group, or a Parquet file made of one) for each particle type
and name its columns in their own way.  An adapter gives each type its family and each
column its usual name, splits vectors, and reads units off a column's attributes.  All of
it is projections and a union, so that Catalyst still prunes columns and families."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..snapshot import ROW, Snapshot, components, numbered, snapshot
from ..units import Unit, as_unit

# The codes' particle types and the usual names of their columns.
TYPES = {"PartType0": "gas", "PartType1": "dm", "PartType2": "dm", "PartType3": "dm", "PartType4": "star", "PartType5": "bh"}
GADGET = {
    "Coordinates": "pos",
    "Velocity": "vel",
    "Velocities": "vel",
    "ParticleIDs": "iord",
    "Masses": "mass",
    "Mass": "mass",
    "InternalEnergy": "u",
    "Temperature": "temp",
    "GFM_Metallicity": "metals",
    "Metallicity": "metals",
    "SmoothedMetallicity": "smetals",
    "Density": "rho",
    "SmoothingLength": "smooth",
    "StellarFormationTime": "aform",
    "GFM_StellarFormationTime": "aform",
    "Potential": "phi",
    "ElementAbundance/Iron": "Fe",
    "ElementAbundance/Silicon": "Si",
    "ElementAbundance/Magnesium": "Mg",
    "ElementAbundance/Oxygen": "O",
    "ElementAbundance/Neon": "Ne",
    "ElementAbundance/Hydrogen": "H",
    "ElementAbundance/Helium": "He",
    "ElementAbundance/Carbon": "C",
    "ElementAbundance/Nitrogen": "N",
}
SWIFT = {
    "Coordinates": "pos",
    "Velocities": "vel",
    "Temperatures": "temp",
    "FOFGroupIDs": "grp",
    "Masses": "mass",
    "SubgridMasses": "mass",
    "Potentials": "phi",
    "Softenings": "eps",
    "ParticleIDs": "iord",
    "Densities": "rho",
    "InternalEnergies": "u",
    "Pressures": "p",
    "SmoothingLengths": "smooth",
    "MetalMassFractions": "metals",
    "Ages": "age",
}
GIZMO = {
    "Coordinates": "pos",
    "Masses": "mass",
    "ParticleIDs": "iord",
    "Velocities": "vel",
    "Density": "rho",
    "SmoothingLength": "smooth",
    "StellarFormationTime": "aform",
    "InternalEnergy": "u",
    "Metallicity": "metals_list",
    "Potential": "phi",
}
PKDGRAV = {
    "Coordinates": "pos",
    "Velocities": "vel",
    "ParticleIDs": "iord",
    "Masses": "mass",
    "InternalEnergy": "u",
    "Temperature": "temp",
    "Metallicity": "metals",
    "Density": "rho",
    "SmoothingLength": "smooth",
    "StellarFormationTime": "tform",
    "BHFormationTime": "tform",
    "Potential": "phi",
}
#: Elements of the Gizmo list of metals, in its order.
GIZMO_METALS = ("metals", "He", "C", "N", "O", "Ne", "Mg", "Si", "S", "Ca", "Fe")
#: Dimensions of columns in powers of length, mass and velocity.
DIMENSIONS = {"pos": (1, 0, 0), "smooth": (1, 0, 0), "eps": (1, 0, 0), "vel": (0, 0, 1), "mass": (0, 1, 0), "rho": (-3, 1, 0), "u": (0, 0, 2), "phi": (0, 0, 2), "p": (-3, 1, 2)}


@dataclass(frozen=True)
class Adapter:
    """How a code's tables become a snapshot.  `extra` gives more columns, each by a
    function of the present column names that gives a column or None."""

    names: dict[str, str]
    types: dict[str, str] = field(default_factory=lambda: dict(TYPES))
    extra: dict[str, Callable[[list[str]], Column | None]] = field(default_factory=dict)

    def name(self, raw: str) -> str:
        """The usual name of a code's column; other names stay, with / as _."""
        return self.names.get(raw, raw.replace("/", "_"))

    def raw(self, name: str, present: list[str] | None = None) -> list[str]:
        """The names that a code may have for a column, those first that are there."""
        got = [r for r, n in self.names.items() if n == name] or [name]
        return sorted(got, key=lambda r: present is not None and r not in present)

    def table(self, df: DataFrame, kind: str) -> DataFrame:
        """One type's table under the usual names, vectors of three split.  Of several
        columns of one usual name the first that isn't null counts."""
        groups: dict[str, list[str]] = {}
        for c in df.columns:
            groups.setdefault(self.name(c), []).append(c)
        types, out = dict(df.dtypes), []
        for name, raws in groups.items():
            value = F.coalesce(*[F.col(f"`{r}`") for r in raws]) if len(raws) > 1 else F.col(f"`{raws[0]}`")
            if name in ("pos", "vel") and types[raws[0]].startswith("array"):
                out += [value[k].alias(c) for k, c in enumerate(components(name))]
            else:
                out.append(value.alias(name))
        got = df.select(*out)
        for name, fn in self.extra.items():
            c = None if name in got.columns else fn(got.columns)
            got = got if c is None else got.withColumn(name, c)
        return got.withColumn("family", F.lit(self.types[kind]))


def _metal(k: int) -> Callable[[list[str]], Column | None]:
    return lambda cols: F.get("metals_list", F.lit(k)) if "metals_list" in cols else None


ADAPTERS = {
    "gadget": Adapter(GADGET),
    "arepo": Adapter(GADGET),
    "swift": Adapter(SWIFT, TYPES | {"PartType6": "neutrino"}),
    "gizmo": Adapter(GIZMO, extra={name: _metal(k) for k, name in enumerate(GIZMO_METALS)}),
    "pkdgrav": Adapter(PKDGRAV, {"PartType0": "gas", "PartType1": "dm", "PartType4": "star", "PartType5": "bh"}),
}


def from_tables(spark: SparkSession, tables: dict[str, DataFrame], code: str = "gadget", units: dict | None = None, properties: dict | None = None) -> Snapshot:
    """A snapshot of a code's tables by particle type; types that the code hasn't are an
    error.  Rows are numbered without gaps by type and then by the column `place` of their
    table if it has one, else by id."""
    adapter, parts = ADAPTERS[code], []
    unknown = sorted(set(tables) - set(adapter.types))
    if unknown:
        raise KeyError(f"{code} has no types {unknown}")
    for i, kind in enumerate(t for t in adapter.types if t in tables):
        t = adapter.table(tables[kind], kind)
        by = F.col("place") if "place" in t.columns else F.col("iord")
        parts.append(t.withColumn("__k", F.struct(F.lit(i).alias("t"), by.alias("b"))).drop("place"))
    if not parts:
        raise ValueError("no tables")
    df = parts[0]
    for t in parts[1:]:
        df = df.unionByName(t, allowMissingColumns=True)
    present = [(adapter.types[k], set(t.columns)) for k, t in zip((t for t in adapter.types if t in tables), parts, strict=True)]
    families = {f for f, _ in present}
    ragged = {c: {f for f, cols in present if c in cols} for c in df.columns if c not in ("__k", "family")}
    return snapshot(numbered(df, "__k", ROW).drop("__k"), units, properties, {c: fs for c, fs in ragged.items() if fs != families})


def to_tables(s: Snapshot, code: str = "gadget") -> dict[str, DataFrame]:
    """The reverse: a table for each family's first type under the code's names, with
    vectors joined and the row's `place`."""
    adapter, out = ADAPTERS[code], {}
    first: dict[str, str] = {}
    for kind, family in adapter.types.items():
        first.setdefault(family, kind)
    vectors = [v for v in ("pos", "vel") if all(c in s.df.columns for c in components(v))]
    inside = {c for v in vectors for c in components(v)}
    plain = [c for c in s.keys() if c not in inside]
    for family, kind in first.items():
        rows = s.df.where(F.col("family") == family)
        keep = [c for c in plain if c not in s.ragged or family in s.ragged[c]]
        out[kind] = rows.select(F.col(ROW).alias("place"), *[F.array(*components(v)).alias(adapter.raw(v)[0]) for v in vectors], *[F.col(f"`{c}`").alias(adapter.raw(c)[0]) for c in keep])
    return out


def _power(u: Unit, e) -> Unit:
    return u ** Fraction(float(e)).limit_denominator(1000)


def unit_of(name: str, attributes: dict, system: dict[str, str | Unit]) -> Unit | None:
    """The unit of a column from its attributes and the file's units (length, mass,
    velocity, and for the third kind time and temp); None if they say nothing.

    Known kinds: powers of a and h beside a usual dimension (`aexp-scale-exponent`,
    `h-scale-exponent`); powers of everything (`a_scaling`, `length_scaling`, ...); powers of
    base units (`U_L exponent`, ..., `a-scale exponent`)."""
    base = {k: as_unit(v) for k, v in system.items()}
    a, h = as_unit("a"), as_unit("h")
    if "length_scaling" in attributes:
        keys = {"length": "length_scaling", "mass": "mass_scaling", "velocity": "velocity_scaling"}
        out = _power(a, attributes.get("a_scaling", 0)) * _power(h, attributes.get("h_scaling", 0))
        for k, key in keys.items():
            out = out * _power(base[k], attributes.get(key, 0))
        return out
    if any(k.endswith(" exponent") for k in attributes):
        keys = {"U_L exponent": "length", "U_M exponent": "mass", "U_t exponent": "time", "U_T exponent": "temp"}
        out = _power(a, attributes.get("a-scale exponent", 0)) * _power(h, attributes.get("h-scale exponent", 0))
        for key, k in keys.items():
            if attributes.get(key, 0):
                out = out * _power(base[k], attributes[key])
        return out
    if "aexp-scale-exponent" in attributes and name in DIMENSIONS:
        powers = zip(("length", "mass", "velocity"), DIMENSIONS[name], strict=True)
        out = _power(a, attributes["aexp-scale-exponent"]) * _power(h, attributes.get("h-scale-exponent", 0))
        for k, e in powers:
            out = out * _power(base[k], e)
        return out
    return None


def original_unit(s: Snapshot, like) -> Unit:
    """The unit of some dimensions in a snapshot's own units of length, velocity and mass
    (a and h stay as they are in `like`)."""
    like = as_unit(like)
    system = [u for n in ("pos", "vel", "mass") if not (u := s.unit(n)).dimensionless]
    system = [Unit(u.scale, {b: e for b, e in u.dims.items() if b not in ("a", "h")}) for u in system]
    extra = [as_unit(b) for b in ("K", "a", "h")]
    out = Unit()
    for u, p in zip(system + extra, like.dimensional_project(system + extra), strict=True):
        out = out * u**p
    return out


def with_unit_like(s: Snapshot, name: str, like) -> Snapshot:
    """A column whose unit is named, not converted: that of the dimensions in the
    snapshot's own units."""
    return s.with_column(name, s.col(name), original_unit(s, like))
