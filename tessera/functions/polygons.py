"""Area of unions of convex quadrilaterals, for batches of rows.

Clipping polygons has no built-in expression and is slow as nested array functions, so it runs as one
Arrow-batched function over whole columns. Only tiles whose class is still open have
members, at most four quadrilaterals each; for others the members are null.
"""

from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MAX_MEMBERS = 4

# Send the functions themselves to the workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _oriented(quads: np.ndarray) -> np.ndarray:
    """Quadrilaterals (..., 4, 2) with counter-clockwise corners."""
    q = quads - quads[..., :1, :]
    nxt = np.roll(q, -1, axis=-2)
    area = (q[..., 0] * nxt[..., 1] - nxt[..., 0] * q[..., 1]).sum(axis=-1)
    return np.where((area < 0)[..., None, None], quads[..., ::-1, :], quads)


def _clip(poly: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Part of each convex polygon (rows, corners, 2) left of the line start -> end.

    A convex polygon gains at most one corner per cut. Rows with fewer corners repeat their last one, which
    adds no area; a row with nothing left collapses to one repeated point.
    """
    d = (end - start)[:, None, :]
    side = d[..., 0] * (poly[..., 1] - start[:, None, 1]) - d[..., 1] * (poly[..., 0] - start[:, None, 0])
    nxt, side_nxt = np.roll(poly, -1, axis=1), np.roll(side, -1, axis=1)
    crosses = side * side_nxt < 0
    t = np.divide(side, side - side_nxt, out=np.zeros_like(side), where=crosses)
    cut = poly + t[..., None] * (nxt - poly)
    rows, corners, _ = poly.shape
    points = np.stack([poly, cut], axis=2).reshape(rows, 2 * corners, 2)
    valid = np.stack([side >= 0, crosses], axis=2).reshape(rows, 2 * corners)
    order = np.argsort(~valid, axis=1, kind="stable")[:, : corners + 1]
    kept = np.take_along_axis(points, order[..., None], axis=1)
    count = valid.sum(axis=1)
    index = np.minimum(np.arange(corners + 1)[None, :], np.maximum(count - 1, 0)[:, None])
    return np.take_along_axis(kept, index[..., None], axis=1)


def _areas(poly: np.ndarray) -> np.ndarray:
    q = poly - poly[:, :1, :]
    nxt = np.roll(q, -1, axis=1)
    return np.abs((q[..., 0] * nxt[..., 1] - nxt[..., 0] * q[..., 1]).sum(axis=1)) / 2.0


def union_share(target: np.ndarray, members: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Share of each target (rows, 4, 2) covered by the union of its first ``count`` members (rows, k, 4, 2)."""
    target, members = _oriented(target), _oriented(members)
    whole = _areas(target)
    # A member without area covers nothing, but its zero-length edges would not cut anything away either.
    solid = _areas(members.reshape(-1, 4, 2)).reshape(members.shape[:2]) > 0
    total = np.zeros(len(target))
    for size in range(1, MAX_MEMBERS + 1):
        for chosen in combinations(range(MAX_MEMBERS), size):
            rows = np.flatnonzero((count > chosen[-1]) & solid[:, chosen].all(axis=1))
            if not len(rows):
                continue
            poly = target[rows]
            for m in chosen:
                quad = members[rows, m]
                for i in range(4):
                    poly = _clip(poly, quad[:, i], quad[:, (i + 1) % 4])
            total[rows] += (1.0 if size % 2 else -1.0) * _areas(poly)
    return np.divide(total, whole, out=np.zeros_like(total), where=whole > 0)


@F.pandas_udf(DoubleType())
def _share(target: pd.Series, members: pd.Series) -> pd.Series:
    share = pd.Series([None] * len(members), dtype=object)
    known = np.flatnonzero(members.notna().to_numpy())
    if not len(known):
        return share
    flat = [members.iloc[i] for i in known]
    count = np.fromiter((len(f) // 8 for f in flat), dtype=int, count=len(flat))
    if count.max() > MAX_MEMBERS:
        raise ValueError(f"at most {MAX_MEMBERS} quadrilaterals, got {count.max()}")
    # one copy into fixed rows: the flat numbers go where the row has members
    quads = np.zeros((len(flat), MAX_MEMBERS * 8))
    quads[np.arange(MAX_MEMBERS * 8) < count[:, None] * 8] = np.concatenate(flat).astype(float)
    squares = np.stack([target.iloc[i] for i in known]).astype(float)
    share.iloc[known] = union_share(squares.reshape(-1, 4, 2), quads.reshape(-1, MAX_MEMBERS, 4, 2), count)
    return share


def quad_union_share(target: Column, members: Column) -> Column:
    """Covered share of a quadrilateral (eight numbers) by at most four others (eight numbers each, end to end); null for null."""
    return _share(target, members)
