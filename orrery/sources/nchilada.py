"""Snapshots as folders of XDR files, one for each attribute of each family, that a
description in XML lists."""

from __future__ import annotations

import os
import struct
from collections.abc import Sequence
from xml.etree import ElementTree

from pyspark.sql import SparkSession

from ..snapshot import Snapshot, components, family_name, snapshot
from .column_files import Column, Family, frame

# The number that files begin with, types by their codes, and names of columns.
MAGIC = 1062053
CODES = (None, ">i1", ">u1", ">i2", ">u2", ">i4", ">u4", ">i8", ">u8", ">f4", ">f8")
NAMES = {"position": "pos", "velocity": "vel", "density": "rho", "temperature": "temp", "potential": "phi", "softening": "eps", "formationtime": "tform", "metals": "metals", "iord": "iord", "smoothlength": "smooth", "GasDensity": "rho"}
_HEAD = struct.Struct(">idqii")


def header(path: str) -> tuple[float, int, int, str]:
    """Time, rows, values of a row and their type."""
    with open(path, "rb") as f:
        raw = f.read(_HEAD.size)
    if len(raw) < _HEAD.size:
        raise OSError(f"{path} has no header")
    magic, time, rows, width, code = _HEAD.unpack(raw)
    if magic != MAGIC or not 0 < code < len(CODES):
        raise OSError(f"{path} is no file of an attribute")
    return time, rows, width, CODES[code]


def _local(path: str) -> str:
    return path.removeprefix("file://").rstrip("/")


def described(path: str) -> tuple[float, list[Family]]:
    """The time, and the families with their files, by name."""
    root = ElementTree.parse(os.path.join(path, "description.xml")).getroot()
    out, time = [], 0.0
    for f in sorted(root.iter("family"), key=lambda e: family_name(e.get("name"))):
        columns, rows = [], None
        for a in f.iter("attribute"):
            file = os.path.join(path, a.get("link"))
            time, n, width, kind = header(file)
            if rows is not None and n != rows:
                raise OSError(f"{file} has {n} rows, others of its family have {rows}")
            rows, name = n, NAMES.get(a.get("name"), a.get("name"))
            names = (name,) if width == 1 else components(name) if width == 3 else tuple(f"{name}_{k}" for k in range(width))
            # the least and the greatest value come first
            columns.append(Column(names, file, kind, _HEAD.size + 2 * width * int(kind[2:])))
        out.append(Family(family_name(f.get("name")), rows or 0, tuple(columns)))
    return time, out


def can_read(spark: SparkSession, path: str) -> bool:
    return os.path.exists(os.path.join(_local(path), "description.xml"))


def read(spark: SparkSession, path: str, units: dict | None = None, properties: dict | None = None, columns: Sequence[str] | None = None, runs: Sequence[tuple[int, int]] | None = None) -> Snapshot:
    """A snapshot of a folder: of some columns (vectors by their components), or of runs of
    rows.  A column that not all families have is null elsewhere."""
    time, families = described(_local(path))
    df = frame(spark, families, columns, runs)
    everywhere = [{n for c in f.columns for n in c.names} for f in families]
    ragged = {n: frozenset(f.name for f, has in zip(families, everywhere, strict=True) if n in has) for n in df.columns if n not in ("pidx", "family") and not all(n in has for has in everywhere)}
    return snapshot(df, {"pos": "kpc a"} | (units or {}), {"a": time} | (properties or {}), ragged)
