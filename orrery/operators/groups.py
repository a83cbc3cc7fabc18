"""Group catalogues: membership (halo, pidx) and one row of properties for each group."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..snapshot import ROW, Snapshot, numbered


@dataclass(frozen=True)
class Catalogue:
    """Groups of a snapshot.  `members` has halo and pidx, many to many; `halos` has halo
    and whatever is known of it (number, parent, mass, ...)."""

    s: Snapshot
    members: DataFrame
    halos: DataFrame

    def halo(self, number: int) -> Snapshot:
        """The view of one group's rows."""
        rows = self.members.where(F.col("halo") == number).select(ROW)
        return replace(self.s, df=self.s.df.join(rows, ROW, "left_semi"), base=self.s, span=None)

    def sizes(self) -> DataFrame:
        """halo, n and rank by size (largest first, then by number)."""
        n = self.members.groupBy("halo").agg(F.count(F.lit(1)).alias("n"))
        return ranked(n)

    def group_array(self, missing: int = -1) -> DataFrame:
        """pidx and grp: of the groups that hold a row the smallest, of equally large
        ones the later; `missing` if none does."""
        n = self.members.groupBy("halo").agg(F.count(F.lit(1)).alias("n"))
        own = self.members.join(n, "halo").groupBy(ROW).agg(F.max_by("halo", F.struct(-F.col("n"), F.col("halo"))).alias("grp"))
        return self.s.df.select(ROW).join(own, ROW, "left").select(ROW, F.coalesce("grp", F.lit(missing)).alias("grp"))

    def subset(self, numbers) -> Catalogue:
        keep = F.col("halo").isin(*numbers)
        return Catalogue(self.s, self.members.where(keep), self.halos.where(keep))

    def children(self) -> DataFrame:
        """halo and the sorted numbers of the groups whose parent it is."""
        kids = self.halos.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("halo")).agg(F.sort_array(F.collect_list(F.col("halo"))).alias("children"))
        return self.halos.select("halo").join(kids, "halo", "left").select("halo", F.coalesce("children", F.array().cast("array<bigint>")).alias("children"))

    def subhalos(self, number: int) -> Catalogue:
        """The groups whose parent is a group."""
        kids = self.halos.where(F.col("parent") == number)
        return Catalogue(self.s, self.members.join(kids.select("halo"), "halo", "left_semi"), kids)

    def mass(self) -> DataFrame:
        """Total mass of each group."""
        rows = self.s.df.select(ROW, self.s.col("mass").alias("mass"))
        return self.members.join(rows, ROW).groupBy("halo").agg(F.sum("mass").alias("mass"))

    def mean_by_mass(self, *names: str) -> DataFrame:
        """Mass-weighted means of columns in each group."""
        rows = self.s.df.select(ROW, self.s.col("mass").alias("__m"), *[self.s.col(n).alias(n) for n in names])
        return self.members.join(rows, ROW).groupBy("halo").agg(*[(F.sum(F.col("__m") * F.col(n)) / F.sum("__m")).alias(n) for n in names])


def ranked(sizes: DataFrame) -> DataFrame:
    """halo, n and rank by n (from 1): the order of numbers that catalogues by length have.
    Ranks are counted by range, no task sorts all groups."""
    keyed = sizes.withColumn("__k", F.struct(-F.col("n"), F.col("halo")))
    return numbered(keyed, "__k", "rank").drop("__k").withColumn("rank", (F.col("rank") + 1).cast("int"))


def numbering(halos: DataFrame, how: str = "file-order", size: str = "n", own: str = "ID") -> DataFrame:
    """halo (the place in the file, from 0) and number: `file-order` is that place, `v1`
    counts from 1; `length-order` ranks by size, the largest first and equal ones in
    their order (from 0; `length-order-v1` from 1); `own` takes a column of numbers."""
    if how in ("file-order", "v1"):
        return halos.select("halo", (F.col("halo") + (1 if how == "v1" else 0)).cast("long").alias("number"))
    if how == "own":
        return halos.select("halo", F.col(own).cast("long").alias("number"))
    if how not in ("length-order", "length-order-v1"):
        raise ValueError(f"no numbering {how!r}")
    got = ranked(halos.select("halo", F.col(size).alias("n")))
    return got.select("halo", (F.col("rank") - (0 if how.endswith("v1") else 1)).cast("long").alias("number"))


def renumbered(c: Catalogue, numbers: DataFrame) -> Catalogue:
    """A catalogue under other numbers (halo, number); parents go along, and one that has
    no number becomes null.  Two groups of one number are an error."""
    if numbers.groupBy("number").count().where("count > 1").limit(1).count():
        raise ValueError("two groups have one number")
    swap = numbers.select("halo", F.col("number").alias("__to"))
    members = c.members.join(swap, "halo").select(F.col("__to").alias("halo"), ROW)
    halos = c.halos.join(swap, "halo").drop("halo").withColumnRenamed("__to", "halo")
    if "parent" in halos.columns:
        up = numbers.select(F.col("halo").alias("parent"), F.col("number").alias("__up"))
        halos = halos.join(up, "parent", "left").drop("parent").withColumnRenamed("__up", "parent")
    return Catalogue(c.s, members, halos)


def places(numbers: DataFrame, wanted: DataFrame) -> DataFrame:
    """number and halo (the place) of wanted numbers; a number that no group has is a
    KeyError that names up to ten."""
    keys = wanted.toDF("number").distinct()
    lost = [r[0] for r in keys.join(numbers, "number", "left_anti").orderBy("number").limit(10).collect()]
    if lost:
        raise KeyError(f"no such groups: {lost}")
    return keys.join(numbers.select("number", "halo"), "number")


def with_parents(c: Catalogue, own: str, parent: str, none: int = -1) -> Catalogue:
    """A catalogue whose groups name their parent by an id of their own, such as a track:
    `parent` is the number of the group that has the id, null for `none` and lost ones."""
    ids = c.halos.select(F.col(own).alias("__id"), F.col("halo").alias("parent"))
    kept = c.halos.drop("parent") if parent != "parent" else c.halos.withColumnRenamed("parent", "__named")
    named = F.when(F.col("__named" if parent == "parent" else parent) != none, F.col("__named" if parent == "parent" else parent))
    return Catalogue(c.s, c.members, kept.withColumn("__id", named).join(ids, "__id", "left").drop("__id", "__named"))


def hosted(subhalos: Catalogue, hosts: Catalogue, column: str = "HostHaloId") -> Catalogue:
    """Groups of one finder under the groups of another: the second's groups and, as
    their children, the first's, whose numbers move behind the hosts' greatest.  `from`
    has the number that a group had.  Groups that name no host (null or negative) stay
    without a parent; one that names a group that isn't there is an error."""
    named = F.when(F.col(column) >= 0, F.col(column).cast("long"))
    kids = subhalos.halos.select(F.col("halo").alias("from"), named.alias("parent"))
    if kids.where("parent IS NOT NULL").join(hosts.halos.select(F.col("halo").alias("parent")), "parent", "left_anti").limit(1).count():
        raise ValueError("a group names a host that isn't in the catalogue of hosts")
    base = (hosts.halos.agg(F.max("halo")).first()[0] or 0) + 1 - (subhalos.halos.agg(F.min("halo")).first()[0] or 0)
    shift = lambda c: (F.col(c) + F.lit(base)).cast("long")
    top = hosts.halos.select(F.col("halo").cast("long").alias("halo"), F.col("halo").cast("long").alias("from"), F.lit(None).cast("long").alias("parent"))
    halos = top.unionByName(kids.select(shift("from").alias("halo"), F.col("from").cast("long").alias("from"), "parent"))
    members = hosts.members.select(F.col("halo").cast("long").alias("halo"), ROW).unionByName(subhalos.members.select(shift("halo").alias("halo"), ROW))
    return Catalogue(hosts.s, members, halos)


def from_column(s: Snapshot, column: str = "grp", ignore: int | None = None) -> Catalogue:
    """Groups from an integer column of the rows; `ignore` is the value of no group."""
    rows = s.df.select(s.col(column).cast("long").alias("halo"), F.col(ROW)).where(F.col("halo").isNotNull())
    rows = rows if ignore is None else rows.where(F.col("halo") != ignore)
    return Catalogue(s, rows, rows.select("halo").distinct())


def from_ids(s: Snapshot, members: DataFrame, halos: DataFrame | None = None, key: str = "iord") -> Catalogue:
    """Groups from a frame of halo and particle ids."""
    rows = members.join(s.df.select(key, ROW), key).select("halo", ROW)
    return Catalogue(s, rows, members.select("halo").distinct() if halos is None else halos)


def from_offsets(s: Snapshot, halos: DataFrame) -> Catalogue:
    """Groups from the place of their first row and their length (halo, offset, length):
    a range join of which each row knows its coarse cell of rows."""
    hit = _within(s.df.select(ROW, F.col(ROW).alias("at")), halos.select("halo", "offset", "length"))
    return Catalogue(s, hit.select("halo", ROW), halos)


def _within(rows: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """Rows by their place `at` with the spans (offset, length) of equal keys that hold
    them.

    Spans are cut to the places that there are and into pieces of a bounded length, whose
    places are joined by equality: as many as there are members.  They are sorted and merged:
    their size is estimated from the spans, not from the places, so that a driver could be
    sent all members to broadcast."""
    lo, hi = rows.agg(F.min("at"), F.max("at")).first()
    first, end = F.greatest(F.col("offset"), F.lit(lo).cast("long")), F.least(F.col("offset") + F.col("length"), F.lit(hi).cast("long") + 1)
    cut = spans.withColumn("length", end - first).withColumn("offset", first)
    return _members(rows, cut, *keys)


def _members(rows: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """`_within` of spans that end with the rows."""
    piece = 1 << 12
    cut = spans.where("length > 0").withColumn("__a", F.col("offset").cast("long")).withColumn("__b", (F.col("offset") + F.col("length") - 1).cast("long")).drop("offset", "length")
    cut = cut.withColumn("__a", F.explode(F.sequence("__a", "__b", F.lit(piece).cast("long"))))
    each = cut.withColumn("at", F.explode(F.sequence("__a", F.least(F.col("__a") + piece - 1, F.col("__b"))))).drop("__a", "__b")
    return rows.withColumn("at", F.col("at").cast("long")).join(each.hint("merge"), [*keys, "at"])


def from_family_offsets(s: Snapshot, halos: DataFrame) -> Catalogue:
    """Groups from places and lengths for each family (halo, family, offset, length),
    where places count the rows of a family in order, wherever they lie in the file."""
    keyed = s.df.select(ROW, "family").withColumn("__k", F.struct("family", ROW))
    placed = numbered(keyed, "__k", "__all").drop("__k")
    # one row for each family; those before it in the order have so many rows
    sizes = s.df.groupBy("family").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("family").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("family", F.coalesce(before, F.lit(0)).alias("__first"), "__n")
    rows = placed.join(F.broadcast(first), "family").select(ROW, "family", (F.col("__all") - F.col("__first")).alias("at"))
    # spans end with their family's rows
    held = halos.join(F.broadcast(first.select("family", "__n")), "family").withColumn("__end", F.least(F.col("offset") + F.col("length"), F.col("__n")))
    held = held.withColumn("offset", F.greatest(F.col("offset"), F.lit(0))).select("halo", "family", "offset", (F.col("__end") - F.col("offset")).alias("length"))
    hit = _members(rows, held, "family")
    return Catalogue(s, hit.select("halo", ROW), halos.select("halo").distinct())


def from_id_runs(s: Snapshot, halos: DataFrame, bound: DataFrame, unbound: DataFrame | None = None, key: str = "iord") -> Catalogue:
    """Groups whose members stand one group after the other in lists of ids (at, id): a
    group's run is (offset, length), and in the list of unbound ones, which count if it is
    given, (offset_unbound, length_unbound).  Ids that no row has are left out."""
    hit = _within(bound, halos.select("halo", "offset", "length")).select("halo", "id")
    if unbound is not None:
        more = halos.select("halo", F.col("offset_unbound").alias("offset"), F.col("length_unbound").alias("length"))
        hit = hit.unionByName(_within(unbound, more).select("halo", "id")).distinct()
    return from_ids(s, hit.withColumnRenamed("id", key), halos, key)


def run_lengths(halos: DataFrame, total: int, offset: str = "offset", length: str = "length") -> DataFrame:
    """Groups (halo numbers without gaps, in file order) with the lengths of their runs: to
    the next group's offset, and to the list's end for the last."""
    after = halos.select((F.col("halo") - 1).alias("halo"), F.col(offset).alias("__next"))
    return halos.join(after, "halo", "left").withColumn(length, F.coalesce("__next", F.lit(total)) - F.col(offset)).drop("__next")


def mass_function(masses: DataFrame, volume: float, least: float = 8.0, most: float = 15.0, step: float = 0.1) -> DataFrame:
    """Groups by decade of mass: bin, mid (log mass), n, phi (per volume and dex), err."""
    nbins = int(round((most - least) / step))
    k = F.floor((F.log10("mass") - least) / step).cast("int")
    got = masses.where("mass > 0").withColumn("bin", k).where(F.col("bin").between(0, nbins - 1)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    scale = 1 / (volume * step)
    return got.select("bin", (F.lit(least) + (F.col("bin") + 0.5) * step).alias("mid"), "n", (F.col("n") * scale).alias("phi"), (F.sqrt("n") * scale).alias("err"))


def boundaries(df: DataFrame, column: str) -> DataFrame:
    """First row of each value of an integer column of rows in order."""
    return df.groupBy(column).agg(F.min(ROW).alias("first"), F.count(F.lit(1)).alias("n"))


def box_volume(s: Snapshot) -> float:
    return math.pow(s.prop("boxsize"), 3)
