"""Boxes of binary geometries, for batches of rows.

Binary geometry has no built-in decoder, so it is read in one Arrow-batched function over whole columns. Polygons of one
ring and the same number of corners, which is what a footprint lake mostly holds, are decoded together as one array;
everything else is walked geometry by geometry, the coordinates of each ring as one array.
"""

from __future__ import annotations

import struct
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .geometry import BBOX_FIELDS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the format: geometry types, and the bits of its extended form.
POINT, LINE, POLYGON, COLLECTIONS = 1, 2, 3, (4, 5, 6, 7)
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000
RING_HEADER = 13  # byte order, type, number of rings, number of points


def _parts(data: bytes):
    """Coordinate arrays (points, 2) of one geometry, whatever its nesting, byte order or dimensions."""
    at, open_geometries = 0, 1
    while open_geometries:
        order = "<" if data[at] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5 + (4 if kind & HAS_SRID else 0)
        plain = kind & 0x0FFFFFFF
        width = 2 + bool(kind & HAS_Z) + bool(kind & HAS_M) + (0, 1, 1, 2)[plain // 1000]
        base = plain % 1000
        open_geometries -= 1
        rings = 1
        if base in COLLECTIONS:
            (members,) = struct.unpack_from(order + "I", data, at)
            at, open_geometries, rings = at + 4, open_geometries + members, 0
        elif base == POLYGON:
            (rings,) = struct.unpack_from(order + "I", data, at)
            at += 4
        elif base not in (POINT, LINE):
            raise ValueError(f"geometry type {base}")
        for _ in range(rings):
            n = 1
            if base != POINT:
                (n,) = struct.unpack_from(order + "I", data, at)
                at += 4
            yield np.frombuffer(data, dtype=order + "f8", count=n * width, offset=at).reshape(n, width)[:, :2]
            at += n * width * 8


def box_of(data: bytes | None) -> tuple[float, float, float, float] | None:
    """(xmin, ymin, xmax, ymax); None for null, empty, unfinished or unknown geometries and for coordinates that are no numbers."""
    if not data:
        return None
    try:
        points = np.concatenate(list(_parts(data)) or [np.zeros((0, 2))])
    except (struct.error, ValueError, IndexError):
        return None
    if not len(points) or not np.isfinite(points).all():
        return None
    low, high = points.min(axis=0), points.max(axis=0)
    return float(low[0]), float(low[1]), float(high[0]), float(high[1])


def boxes_of(values: pd.Series) -> np.ndarray:
    """Boxes (rows, 4) of a column of geometries, NaN where there is none."""
    out = np.full((len(values), 4), np.nan)
    alike: dict[tuple[int, bytes], list[int]] = {}
    datas = [None if v is None else bytes(v) for v in values]
    for i, data in enumerate(datas):
        if data:
            alike.setdefault((len(data), data[:RING_HEADER]), []).append(i)
    for (length, head), rows in alike.items():
        plain = length > RING_HEADER and head[:9] == b"\x01\x03\x00\x00\x00\x01\x00\x00\x00"
        if plain and length == RING_HEADER + 16 * int.from_bytes(head[9:], "little"):
            body = np.frombuffer(b"".join(datas[i][RING_HEADER:] for i in rows), dtype="<f8").reshape(len(rows), -1, 2)
            good = np.isfinite(body).all(axis=(1, 2))
            out[rows] = np.where(good[:, None], np.concatenate([body.min(axis=1), body.max(axis=1)], axis=1), np.nan)
        else:
            for i in rows:
                found = box_of(datas[i])
                if found:
                    out[i] = found
    return out


@F.pandas_udf(StructType([StructField(e, DoubleType()) for e in BBOX_FIELDS]))
def _boxes(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(boxes_of(values), columns=list(BBOX_FIELDS))


def wkb_box(geometry: str) -> Column:
    """Box of a binary geometry as ``struct<xmin,ymin,xmax,ymax>``; its edges are null where there is none."""
    return _boxes(F.col(geometry))
