"""Tails of weighted sums of chi-squares, P(sum_i w_i X_i >= q) with X_i chi-square of d_i degrees of freedom.

The tail is a contour integral of exp(K(s) - s q) / s over a path that crosses the real axis between 0 and the first
branch point 1 / (2 max w), K(s) = -sum d_i log(1 - 2 w_i s) / 2; where the other tail is the smaller one, the path
crosses below 0 and gives that. On a vertical line its terms fall off like a power of
s; here the path is the hyperbola s(u) = c + b (cosh u - 1 + i sinh u), which opens to where exp(-s q) vanishes (a negative
q is turned round with its weights), so that they fall off doubly exponentially, or exponentially where q is 0. c is the
saddle point, and b keeps the pole and the branch points away from the strip in which the trapezoid rule converges
geometrically. Beyond the last node at u the rest is at most

    exp(-q Re s(u)) prod_i (2 |w_i| Im s(u))**(-d_i / 2) 4 / (pi sum_i d_i);

nodes go on until that is below the tolerance. The rule's own error is taken from half the step. All rows are computed
together; a row that misses the tolerance has an error that says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Step of the rule, asked absolute error, rows times nodes that are held at once.
STEP, TOLERANCE, HELD = 0.125, 1e-11, 1 << 18


def _crossing(q: np.ndarray, w: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """c, where exp(K(s) - s q) / |s| is smallest on the side of 0 that the smaller tail asks for, by bisection; and b."""
    lower = q < (d * w).sum(axis=1)
    branch, left = 1 / (2 * w.max(axis=1)), np.minimum(w.min(axis=1), 0)
    far = np.where(left < 0, 1 / (2 * np.where(left < 0, left, -1)), -1.01 * (d.sum(axis=1) / 2 + 1) / np.where(q > 0, q, 1))
    low, high = np.where(lower, far, 0), np.where(lower, 0, branch)
    for _ in range(100):
        s = (low + high) / 2
        rises = (d * w / (1 - 2 * w * s[:, None])).sum(axis=1) - q - 1 / s > 0
        low, high = np.where(rises, low, s), np.where(rises, s, high)
    c = (low + high) / 2
    c = np.where(lower, np.minimum(np.where(left < 0, np.maximum(c, 0.999 * far), c), 1e-12 * far), np.clip(c, 1e-12 * branch, 0.999 * branch))
    return c, np.where(lower, np.minimum(np.where(left < 0, c - far, np.inf), -2 * c), np.minimum(c, 2 * (branch - c)))


def _upper(q: np.ndarray, w: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tails and their errors for q >= 0 and rows with a positive weight; the largest weight is 1 in size."""
    c, b = _crossing(q, w, d)
    held, count = w != 0, np.where(w != 0, d, 0).sum(axis=1)
    size = np.where(held, d * np.log(2 * np.abs(np.where(held, w, 1))), 0).sum(axis=1)

    def rest(u: np.ndarray) -> np.ndarray:
        return np.exp(np.minimum(700, -q * (c + b * (np.cosh(u) - 1)) - size / 2 - count / 2 * np.log(b * np.sinh(u)))) * 4 / (np.pi * count)

    u = np.full(len(q), 2.0)
    while True:
        more = (rest(u) > TOLERANCE / 4) & (u < 700)
        if not more.any():
            break
        u = np.where(more, u * 1.25, u)
    n = int(np.ceil(u.max() / STEP)) * 2
    nodes = np.arange(n + 1) * (STEP / 2)
    total = np.zeros((2, len(q)))
    for k in range(0, n + 1, max(1, HELD // max(1, w.size))):
        x = nodes[k : k + max(1, HELD // max(1, w.size))]
        inside = x[None, :] <= u[:, None] + STEP
        x = np.where(inside, x, 0.0)
        s = c[:, None] + b[:, None] * (np.cosh(x) - 1 + 1j * np.sinh(x))
        power = -0.5 * (d[:, None, :] * np.log(1 - 2 * w[:, None, :] * s[:, :, None])).sum(axis=2) - s * q[:, None]
        term = np.where(inside, (np.exp(power) / s * b[:, None] * (np.sinh(x) + 1j * np.cosh(x))).imag, 0)
        if k == 0:
            term[:, 0] /= 2
        total[1] += term.sum(axis=1)
        total[0] += term[:, (-k) % 2 :: 2].sum(axis=1)
    fine, coarse = total[1] * STEP / 2 / np.pi, total[0] * STEP / np.pi
    return fine + (c < 0), np.abs(fine - coarse) + rest(u) + 1e-15


def tails(q: np.ndarray, weights: np.ndarray, degrees: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tails and bounds of their absolute errors. weights, degrees: a row for each q, of equal length; weights of 0 don't
    count. nan where a number isn't finite or a degree isn't positive; without weights the sum is 0."""
    q, w = np.asarray(q, float), np.asarray(weights, float)
    d = np.ones_like(w) if degrees is None else np.asarray(degrees, float)
    p, error = np.full(len(q), np.nan), np.full(len(q), np.nan)
    good = np.isfinite(q) & np.isfinite(w).all(axis=1) & (np.isfinite(d) & (d > 0) | (w == 0)).all(axis=1)
    scale = np.abs(w).max(axis=1, initial=0)
    none = good & (scale == 0)
    p[none], error[none] = q[none] <= 0, 0
    some = good & (scale > 0)
    w, q = w / np.where(some, scale, 1)[:, None], q / np.where(some, scale, 1)
    d = np.where(w == 0, 0, d)
    turned = q < 0
    w, q = np.where(turned[:, None], -w, w), np.abs(q)
    never = some & ~(w > 0).any(axis=1)  # nothing above, but for a sum of 0
    p[never], error[never] = turned[never], 0
    sure = some & ~turned & (q == 0) & ~(w < 0).any(axis=1)
    p[sure], error[sure] = 1, 0
    at = np.flatnonzero(some & ~never & ~sure)
    step = max(1, HELD // (64 * max(1, w.shape[1])))
    for k in range(0, len(at), step):
        part = at[k : k + step]
        value, off = _upper(q[part], w[part], d[part])
        p[part], error[part] = np.clip(np.where(turned[part], 1 - value, value), 0, 1), off
    return p, error


def _padded(lists: pd.Series, fill: float) -> np.ndarray:
    width = max(1, max((len(x) for x in lists if x is not None), default=1))
    out = np.full((len(lists), width), fill)
    for row, x in zip(out, lists, strict=True):
        if x is None:
            row[:] = np.nan
        else:
            row[: len(x)] = [np.nan if v is None else v for v in x]
    return out


def with_tails(rows: DataFrame, q: Column | str, weights: Column | str, degrees: Column | str | None = None, p: str = "p", error: str = "p_error") -> DataFrame:
    """rows with the tail of q under the weights (an array) and the bound of its error. Nulls give nulls."""

    @F.pandas_udf("struct<p: double, error: double>")
    def of(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, w, d in parts:
            values = _padded(w, 0.0)
            free = _padded(d, 1.0)
            free = np.pad(free, ((0, 0), (0, max(0, values.shape[1] - free.shape[1]))), constant_values=1.0)[:, : values.shape[1]]
            made = tails(a.to_numpy(float, na_value=np.nan), values, free)
            yield pd.DataFrame({"p": made[0], "error": made[1]})

    ones = F.transform(weights, lambda x: F.lit(1.0)) if degrees is None else degrees
    made = rows.withColumn("_tail", of(F.col(q) if isinstance(q, str) else q, F.col(weights) if isinstance(weights, str) else weights, F.col(ones) if isinstance(ones, str) else ones))
    blank = lambda c: F.when(F.isnan(c), None).otherwise(c)
    return made.withColumns({p: blank(F.col("_tail.p")), error: blank(F.col("_tail.error"))}).drop("_tail")
