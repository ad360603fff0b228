"""Boxes and transforms under 3 x 3 transforms, for whole columns at once in Arrow batches: as expressions they are methods too long to be compiled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NEXT = [1, 2, 3, 0]


def moved(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points under transforms, nine numbers along the first axis of ``h``, by the same order of operations as ``geometry.warp_point``."""
    with np.errstate(invalid="ignore", divide="ignore"):
        w = h[6] * x + h[7] * y + h[8]
        return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def moved_boxes(h: np.ndarray, box: np.ndarray) -> np.ndarray:
    """The axis-aligned hulls of boxes (n, 4) under transforms (9, n)."""
    x, y = moved(h[..., None], box[:, [0, 2, 2, 0]], box[:, [1, 1, 3, 3]])
    return np.stack([x.min(1), y.min(1), x.max(1), y.max(1)], 1)


def in_frames(frame: np.ndarray, h: np.ndarray, box: np.ndarray, det: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Which boxes have their centre in ``frame`` (2, 4) under a transform of ``h`` (n, 9), or on its border; det, k: the pairs of a box and a transform to look at."""
    qx, qy = moved(h.T[..., None], *frame)
    sx, sy = qx[:, NEXT] - qx, qy[:, NEXT] - qy
    mx, my = (box[:, 0] + box[:, 2]) / 2, (box[:, 1] + box[:, 3]) / 2
    turn = sx[k] * (my[det, None] - qy[k]) - sy[k] * (mx[det, None] - qx[k])
    return np.bincount(det[(turn >= 0).all(1) | (turn <= 0).all(1)], minlength=len(box)) > 0


def _numbers(c: Column) -> list[Column]:
    return [c[i] for i in range(9)]


def moved_box(h: Column, box: tuple[Column, ...]) -> Column:
    """As ``geometry.warp_box``, a struct of the four numbers."""

    @F.pandas_udf("x0 double, y0 double, x1 double, y1 double")
    def hull(*cols: pd.Series) -> pd.DataFrame:
        at = np.stack([c.to_numpy(float) for c in cols])
        return pd.DataFrame(moved_boxes(at[:9], at[9:].T), columns=["x0", "y0", "x1", "y1"])

    return hull(*_numbers(h), *box)


def chained(later: Column, first: Column) -> Column:
    """The transform that applies ``first``, then ``later``; nine numbers in row order."""

    @F.pandas_udf("array<double>")
    def chain(*cols: pd.Series) -> pd.Series:
        m, k = np.stack([c.to_numpy(float) for c in cols]).reshape(2, 3, 3, -1)
        return pd.Series(list(np.stack([m[i, 0] * k[0, j] + m[i, 1] * k[1, j] + m[i, 2] * k[2, j] for i in range(3) for j in range(3)], 1)))

    return chain(*_numbers(later), *_numbers(first))
