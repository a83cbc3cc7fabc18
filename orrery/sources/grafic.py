"""Initial conditions on a grid: files of Fortran records, a header and then a plane of the
grid each."""

from __future__ import annotations

import os
import struct
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.cosmology import Cosmology
from ..snapshot import ROW, Snapshot, snapshot
from .column_files import Column, Family, frame
from .lattice import places

# Files that a folder may have beside the velocities, their columns and types.
OTHERS = {"ic_particle_ids": ("iord", "i8"), "ic_deltab": ("deltab", "f4"), "ic_refmap": ("refmap", "f4"), "ic_pvar_00001": ("pvar", "f4")}
_HEAD = struct.Struct("3i8f")
_KEYS = ("nx", "ny", "nz", "dx", "lx", "ly", "lz", "astart", "omegam", "omegal", "h0")


def _local(path: str) -> str:
    return path.removeprefix("file://").rstrip("/")


def header(path: str) -> tuple[dict[str, float], str]:
    """The header's values, and the order of bytes."""
    with open(path, "rb") as f:
        raw = f.read(4 + _HEAD.size + 4)
    for order in "<>":
        if len(raw) == 8 + _HEAD.size and struct.unpack(f"{order}i", raw[:4])[0] == _HEAD.size:
            return dict(zip(_KEYS, struct.unpack(f"{order}{_HEAD.format}", raw[4:-4]), strict=True)), order
    raise OSError(f"{path} has no header of a grid")


def can_read(spark: SparkSession, path: str) -> bool:
    return os.path.isfile(os.path.join(_local(path), "ic_velcx"))


def read(spark: SparkSession, path: str, units: dict | None = None, properties: dict | None = None, columns: Sequence[str] | None = None, runs: Sequence[tuple[int, int]] | None = None, displaced: bool = True) -> Snapshot:
    """Dark matter at the places of the grid, moved by the files of displacements (in Mpc/h)
    if there are such, else by the velocities over the growth rate (the linear displacement),
    with velocities, masses of mean density and, where there are such files, ids and others.

    Columns that aren't asked for open no file; places and masses come from rows' numbers."""
    path = _local(path)
    h, order = header(os.path.join(path, "ic_velcx"))
    nx, ny, nz = (int(h[k]) for k in ("nx", "ny", "nz"))
    wanted = lambda *names: columns is None or any(n in columns for n in names)
    files: list[Column] = []

    def plane(name: str, file: str, kind: str) -> None:
        width = int(kind[1:])
        files.append(Column((name,), os.path.join(path, file), f"{order}{kind}", 4 + _HEAD.size + 4 + 4, nx * ny, 8 if width else 0))

    moved = displaced and os.path.exists(os.path.join(path, "ic_poscx"))
    for c in "xyz":
        if wanted(c) and moved:
            plane(f"__d{c}", f"ic_posc{c}", "f4")
        if wanted(f"v{c}") or wanted(c) and displaced and not moved:
            plane(f"v{c}", f"ic_velc{c}", "f4")
    for file, (name, kind) in OTHERS.items():
        if wanted(name) and os.path.exists(os.path.join(path, file)):
            plane(name, file, kind)
    cosmology = Cosmology(h=h["h0"] / 100, omega_m=h["omegam"], omega_l=h["omegal"], a=h["astart"])
    df = frame(spark, [Family("dm", nx * ny * nz, tuple(files))], None, runs)
    for c, place in zip("xyz", places(F.col(ROW), nx, ny, nz), strict=True):
        if not wanted(c):
            continue
        at = place * h["dx"] + h[f"l{c}"]
        if moved:
            at = at + F.col(f"__d{c}") / cosmology.h
        elif displaced:
            z = 1 / cosmology.a - 1
            # the growth factor's rate in km/s/Mpc; velocities are peculiar, places comoving
            rate = cosmology.growth_rate(z) / cosmology.growth(z)
            at = at + F.col(f"v{c}") / F.lit(cosmology.a * rate)
        df = df.withColumn(c, at)
    if wanted("mass"):
        df = df.withColumn("mass", F.lit(cosmology.rho_matter(0.0) * (h["dx"] * 1e3) ** 3))
    keep = [c for c in df.columns if not c.startswith("__") and (columns is None or c in columns or c in (ROW, "family"))]
    props = {"a": h["astart"], "h": cosmology.h, "omegaM0": h["omegam"], "omegaL0": h["omegal"], "boxsize": h["dx"] * nx}
    return snapshot(df.select(keep), {"pos": "Mpc a", "vel": "km s^-1", "mass": "Msol"} | (units or {}), props | (properties or {}))
