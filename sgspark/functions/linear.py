"""Small dense linear systems, one a row: as many as there are replicates, as large as there are components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def _solved(matrices: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solutions of all systems; of singular ones those of least norm."""
    try:
        return np.linalg.solve(matrices, rhs[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        return np.stack([np.linalg.lstsq(m, b, rcond=None)[0] for m, b in zip(matrices, rhs, strict=True)])


@F.pandas_udf(ArrayType(DoubleType()))
def _solve(matrix: pd.Series, rhs: pd.Series) -> pd.Series:
    if not len(rhs):
        return pd.Series([], dtype=object)
    b = np.stack(rhs.to_numpy()).astype(float)
    return pd.Series(list(_solved(np.stack(matrix.to_numpy()).astype(float).reshape(len(b), b.shape[1], -1), b)))


def solve(matrix: list[list[Column]], rhs: list[Column]) -> Column:
    """The solution, as an array, of the square system that each row holds."""
    return _solve(F.array(*[x.cast("double") for row in matrix for x in row]), F.array(*[x.cast("double") for x in rhs]))


def melted(rows, keys: list[str], values: dict[str, tuple[Column, Column]], size: str):
    """Long replicates (keys, quantity, size, value, full) of a wide table; values: quantity to (replicate, full). Rows of
    which either isn't defined are left out."""
    cells = F.array(*[F.struct(F.lit(q).alias("quantity"), v.cast("double").alias("value"), f.cast("double").alias("full")) for q, (v, f) in values.items()])
    return rows.select(*keys, size, F.explode(cells).alias("_c")).select(*keys, size, "_c.*").where("value is not null and full is not null")
