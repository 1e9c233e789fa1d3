"""Orthonormal bases of tall, narrow tables: a triangular factor from a tree of tasks, with the rank decided at its root."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Factors that a task of the tree joins.
FAN = 64


class Basis(NamedTuple):
    """rows: the table with an array q of ``rank`` orthonormal columns; turn: the matrix that makes q of the columns."""

    rows: DataFrame
    rank: int
    turn: np.ndarray


def _factor(rows: DataFrame, width: int) -> np.ndarray:
    """R of the rows' (column x) QR decomposition: within tasks, then FAN factors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, width))
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            held = np.linalg.qr(np.concatenate([held, flat.reshape(-1, width)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.list_(pa.float64()))], ["x"])

    parts, left = rows.mapInArrow(run, "x array<double>"), rows.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        parts = parts.repartition(left).mapInArrow(run, "x array<double>")
    made = parts.repartition(1).mapInArrow(run, "x array<double>").collect()  # at most width rows
    return np.array([r["x"] for r in made]).reshape(-1, width)


def orthonormal(table: DataFrame, columns: list[str], constant: bool = True, tolerance: float | None = None) -> Basis:
    """An orthonormal basis of the columns' span (with the constant, if asked for), as the array q of each row.

    Columns are scaled to norm 1; directions whose singular value is at most tolerance times the largest (by default the
    larger side of the table times the precision of a double) are left out. A second factor takes out what rounding has
    left of the first. Rows with a null raise nothing: they get a null q and take no part. No usable row, or only zeros,
    gives rank 0 and empty arrays."""
    cells = [F.col(c).cast("double") for c in columns] + ([F.lit(1.0)] if constant else [])
    width = len(cells)
    whole = table.withColumn("_x", F.array(*cells))
    usable = whole.where(F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x))).select(F.col("_x").alias("x"))
    scale = usable.agg(F.count("*").alias("n"), *[F.max(F.abs(F.col("x")[i])).alias(f"m{i}") for i in range(width)]).first()
    most = np.array([scale[f"m{i}"] or 0.0 for i in range(width)])
    turn = np.diag(np.where(most > 0, 1 / np.where(most > 0, most, 1), 0))

    def turned(by: np.ndarray, of: DataFrame, name: str):
        lines = [[F.lit(float(v)) for v in by[:, j]] for j in range(by.shape[1])]
        dot = [sum((F.col(name)[i] * v for i, v in enumerate(line)), F.lit(0.0)) for line in lines]
        return F.array(*dot).cast("array<double>") if dot else F.array().cast("array<double>")

    first = _factor(usable.select(turned(turn, usable, "x").alias("x")), width)
    norms = np.linalg.norm(first, axis=0)
    turn = turn @ np.diag(np.where(norms > 0, 1 / np.where(norms > 0, norms, 1), 0))
    _, values, right = np.linalg.svd(first @ np.diag(np.where(norms > 0, 1 / np.where(norms > 0, norms, 1), 0)), full_matrices=False)
    bar = (max(scale["n"], width) * np.finfo(float).eps if tolerance is None else tolerance) * (values[0] if len(values) else 0)
    some = values > bar
    turn = turn @ right[some].T / values[some]
    rank = int(some.sum())
    if rank:
        turn = turn @ np.linalg.inv(_factor(usable.select(turned(turn, usable, "x").alias("x")), rank))
    good = F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x))
    return Basis(whole.withColumn("q", F.when(good, turned(turn, whole, "_x"))).drop("_x"), rank, turn)
