"""Minima without derivatives of a few parameters, by Nelder and Mead's simplex; each step prices all the points that it may need in one aggregate over the data."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priced(rows: DataFrame, loss: Callable[[list[float]], Column], points: list[np.ndarray]) -> list[float]:
    """The loss of each point, summed over rows in one pass; loss gives a row's share as a column of it."""
    got = rows.agg(*(F.sum(loss([float(v) for v in p])).alias(f"p{i}") for i, p in enumerate(points))).first()
    return [float("inf") if x is None or np.isnan(x) else x for x in got]


def nelder_mead(rows: DataFrame, loss: Callable[[list[float]], Column], start: list[float], size: float = 0.2, steps: int = 80, x_close: float = 1e-5, f_close: float = 1e-9) -> tuple[list[float], float, int]:
    """(point, loss, passes). The simplex begins with `size` along each axis and ends when its corners are within x_close and their losses within f_close of the best one's (as a share)."""
    d = len(start)
    corners = [np.array(start, float)] + [np.array(start, float) + size * np.eye(d)[i] for i in range(d)]
    worth, passes = priced(rows, loss, corners), 1
    for passes in range(2, steps + 2):
        order = np.argsort(worth, kind="stable")
        corners, worth = [corners[i] for i in order], [worth[i] for i in order]
        best, worst = corners[0], corners[-1]
        if max(np.abs(c - best).max() for c in corners) <= x_close and worth[-1] - worth[0] <= f_close * abs(worth[0]):
            break
        middle = np.mean(corners[:-1], axis=0)
        along = [middle + t * (worst - middle) for t in (-1.0, -2.0, -0.5, 0.5)]  # reflected, further, and short of it on either side
        shrunk = [best + (c - best) / 2 for c in corners[1:]]
        found = priced(rows, loss, along + shrunk)
        reflected, further, outside, inside = found[:4]
        if reflected < worth[0]:
            pick = 1 if further < reflected else 0
        elif reflected < worth[-2]:
            pick = 0
        elif reflected < worth[-1]:
            pick = 2 if outside <= reflected else None
        else:
            pick = 3 if inside < worth[-1] else None
        if pick is None:
            corners, worth = [best, *shrunk], [worth[0], *found[4:]]
        else:
            corners[-1], worth[-1] = along[pick], found[pick]
    k = int(np.argmin(worth))
    return corners[k].tolist(), worth[k], passes
