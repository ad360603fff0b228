"""The area that convex quads share, for whole columns of corners at once: numbers and masks in Arrow batches, no arrays of structs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROWS = 4096


def _area(x: np.ndarray, y: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Signed areas of polygons, a row each, of which the first ``many`` corners count: positive if they go round to the left; summed in order."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        after = np.where(i + 1 < many, min(i + 1, x.shape[1] - 1), 0)[:, None]
        ax, ay = np.take_along_axis(x, after, 1)[:, 0], np.take_along_axis(y, after, 1)[:, 0]
        total += np.where(i < many, x[:, i] * ay - ax * y[:, i], 0.0)
    return total / 2


def _cut(x: np.ndarray, y: np.ndarray, many: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What of the polygons lies to the left of the lines from a to b: a corner gives the crossing if its edge goes over the line, then itself if it is inside."""
    at = np.arange(x.shape[1])
    live, before = at < many[:, None], np.where(at > 0, at - 1, np.maximum(many[:, None] - 1, 0))
    turn = (bx - ax)[:, None] * (y - ay[:, None]) - (by - ay)[:, None] * (x - ax[:, None])
    px, py, last = (np.take_along_axis(v, before, 1) for v in (x, y, turn))
    own = live & (turn >= 0)
    over = live & ((turn >= 0) != (last >= 0))
    share = last / np.where(over, last - turn, 1.0)
    stays = np.stack([over, own], 2).reshape(len(x), -1)
    row, column = np.nonzero(stays)
    many = stays.sum(1)
    place = (np.cumsum(stays, 1) - 1)[row, column]
    out = np.zeros((2, len(x), max(int(many.max(initial=0)), 1)))
    for o, v, p in zip(out, (x, y), (px, py), strict=True):
        o[row, place] = np.stack([p + share * (v - p), v], 2).reshape(len(x), -1)[row, column]
    return out[0], out[1], many


def overlaps(quads: np.ndarray) -> np.ndarray:
    """The area that the quads of each row share; quads: (quads, 4, 2, rows), convex, either way round. Nan where a corner is not known."""
    x, y = (np.ascontiguousarray(quads[0, :, k].T) for k in (0, 1))
    many = np.full(len(x), 4)
    for qx, qy in quads[1:].transpose(0, 2, 1, 3):
        right = _area(qx.T, qy.T, np.full(len(x), 4)) < 0  # turned so that the inside is to the left
        for i, j in ((0, 1), (1, 2), (2, 3), (3, 0)):
            x, y, many = _cut(x, y, many, *(np.where(right, v[b], v[a]) for a, b in ((i, j), (j, i)) for v in (qx, qy)))
    return np.where(np.isnan(quads).any((0, 1, 2)), np.nan, np.abs(_area(x, y, many)))


def shared_area(*quads: list[tuple[Column, Column]]) -> Column:
    """The area that convex quads share: the first is cut by the line of one side of another after the other. Null where a corner is."""
    many = len(quads)

    @F.pandas_udf("double")
    def shared(*corners: pd.Series) -> pd.Series:
        with np.errstate(invalid="ignore"):
            at = np.stack([c.to_numpy(float) for c in corners]).reshape(many, 4, 2, -1)
            return pd.Series(np.concatenate([overlaps(at[..., i : i + ROWS]) for i in range(0, max(at.shape[-1], 1), ROWS)]))

    return shared(*(c.cast("double") for quad in quads for point in quad for c in point))
