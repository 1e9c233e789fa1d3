"""LD-score regression of any number of annotations with a fixed intercept, reweighted a few rounds, and refitted without
each jackknife unit.

A round is one pass over the variants. Weights depend on a replicate by its last estimate only, so a batch of variants
gives the equations of all replicates by one matrix product (replicates x variants, variants x products of the design);
tasks return sums of replicates x components, which is all that is shuffled and all that the driver holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sgspark.operators import axes
from sgspark.sources.shared import folder, forget, kept

LD_FLOOR, MEAN_FLOOR, VARIANCE_FLOOR = 1.0, 1e-3, 1e-12
State = dict[str, np.ndarray]


def _pass(rows: DataFrame, k: int, units: int, weigh: Callable[[str, np.ndarray], np.ndarray], ones: bool) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By key the matrices and right sides of all replicates, the full fit last. ones: the instrument is 1, not the design."""
    k2 = 1 if ones else k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array(batch.column(0).to_pylist())
            unit, q = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            x = batch.column(3).flatten().to_numpy().reshape(-1, k)
            extra = batch.column(4).flatten().to_numpy().reshape(len(q), -1)
            for key in np.unique(keys):
                at = keys == key
                w = weigh(str(key), extra[at])
                w = np.broadcast_to(w, (units + 1, int(at.sum()))).copy()
                w[unit[at], np.arange(int(at.sum()))] = 0.0
                left = np.ones((int(at.sum()), 1)) if ones else x[at]
                products = np.concatenate([(left[:, :, None] * x[at][:, None, :]).reshape(len(left), -1), left * q[at][:, None]], axis=1)
                sums[str(key)] = sums.get(str(key), 0.0) + w @ products
        for key, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(s)), pa.array(np.arange(len(s)), pa.int32()), pa.array(list(s), pa.list_(pa.float64()))], ["key", "rep", "s"])

    parts = rows.mapInArrow(run, "key string, rep int, s array<double>")
    size = k2 * k + k2
    got = parts.groupBy("key", "rep").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(size)]).alias("s")).collect()
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for key in {r["key"] for r in got}:
        s = np.array([r["s"] for r in sorted((r for r in got if r["key"] == key), key=lambda r: r["rep"])])
        out[key] = s[:, : k2 * k].reshape(-1, k2, k), s[:, k2 * k :]
    return out


def refitted(rows: DataFrame, k: int, units: int, weigh: Callable[[State], Callable[[str, np.ndarray], np.ndarray]], rounds: int) -> State:
    """By key the estimates (units + 1, k) of all replicates after ``rounds`` rounds. The start is the unweighted fit, or
    for one component sum(q) / sum(x)."""
    first = _pass(rows, k, units, lambda key, extra: np.ones((1, len(extra))), k == 1)
    state = {key: np.linalg.solve(a, b[:, :, None])[:, :, 0] for key, (a, b) in first.items()}
    for _ in range(rounds):
        state = {key: np.linalg.solve(a, b[:, :, None])[:, :, 0] for key, (a, b) in _pass(rows, k, units, weigh(state), False).items()}
    return state


def _masses(rows: DataFrame, annotations: list[str]) -> dict[str, np.ndarray]:
    got = rows.groupBy("trait").agg(*[F.sum(k).cast("double") for k in annotations]).collect()
    return {r[0]: np.array(r[1:], dtype=float) for r in got}


def _sizes(rows: DataFrame) -> list[tuple]:
    return [tuple(r) for r in rows.groupBy("trait", "unit").agg(F.count("*")).collect()]


def _total(annotations: list[str]) -> Column:
    return sum((F.col(f"l2_{k}") for k in annotations), F.lit(0.0))


def h2_replicates(rows: DataFrame, annotations: list[str], rounds: int = 3, weight: str | None = None) -> tuple[State, dict[str, np.ndarray], int]:
    """Estimates of all replicates by trait, the annotations' masses, and the number of units. rows: trait, unit (from 0),
    n_star, y, d, the annotations and l2_<annotation>; weight: a column of LD scores for the over-counting weights."""
    masses = _masses(rows, annotations)
    units = rows.agg(F.max("unit")).first()[0] + 1
    total = _total(annotations)
    extra = F.array("n_star", F.col("d").cast("double"), F.greatest(total, F.lit(LD_FLOOR)), F.greatest(F.col(weight) if weight else total, F.lit(LD_FLOOR)))
    table = F.create_map(*[x for t, m in masses.items() for x in (F.lit(t), F.array(*map(F.lit, m.tolist())))])
    x = F.array(*[F.col("n_star") * F.col(f"l2_{k}") / table[F.col("trait")][i] for i, k in enumerate(annotations)])
    narrow = rows.select(F.col("trait").alias("key"), F.col("unit").cast("int").alias("unit"), (F.col("y") - 1).alias("q"), x.alias("x"), extra.alias("extra"))
    mass = {t: float(m.sum()) for t, m in masses.items()}

    def weigh(state: State):
        clipped = {t: np.clip(h.sum(axis=1), 0.0, 1.0)[:, None] for t, h in state.items()}

        def weights(key: str, e: np.ndarray) -> np.ndarray:
            n, d, ld, over = e.T
            mean = np.maximum(d + clipped[key] * (n / mass[key] * ld), MEAN_FLOOR)
            return 1.0 / (2.0 * mean * mean * over)

        return weights

    return refitted(narrow, len(annotations), units, weigh, rounds), masses, units


def _summary(rows: DataFrame, sizes: list[tuple], values: dict[str, dict[str, np.ndarray]]) -> DataFrame:
    """Jackknife of replicates held as arrays (trait to quantity to units + 1 values), units and quantities being few."""
    spark = rows.sparkSession
    cells = [(t, q, int(u), int(m), float(v[int(u)]), float(v[-1])) for t, u, m in sizes for q, v in values[t].items() if np.isfinite(v[int(u)]) and np.isfinite(v[-1])]
    long = spark.createDataFrame(cells, "trait string, quantity string, unit int, m long, value double, full double")
    return axes.jackknife(long, "value", "full", "m", ["trait", "quantity"])


def _written(rows: DataFrame, annotations: list[str], others: list[str]) -> tuple[DataFrame, str]:
    """The columns that the rounds read, as a table: every round is a scan of it and not of what made the rows."""
    path = folder(rows.sparkSession, "ldsc")
    return kept(rows.select(*dict.fromkeys([*others, "unit", *annotations, *[f"l2_{k}" for k in annotations]])), path), path


def h2(rows: DataFrame, annotations: list[str], rounds: int = 3, weight: str | None = None) -> DataFrame:
    """(trait, quantity, n_units, estimate, se) for h2_<annotation> and total, every replicate refitted in full. The rows are
    made once."""
    rows, path = _written(rows, annotations, ["trait", "n_star", "y", "d", *([weight] if weight else [])])
    state, _, _ = h2_replicates(rows, annotations, rounds, weight)
    sizes = _sizes(rows)
    forget(rows.sparkSession, path)
    values = {t: {f"h2_{k}": h[:, i] for i, k in enumerate(annotations)} | {"total": h.sum(axis=1)} for t, h in state.items()}
    return _summary(rows, sizes, values)


def rg(rows: DataFrame, one: DataFrame, two: DataFrame, annotations: list[str], c: float, rounds: int = 3) -> DataFrame:
    """(quantity, n_units, estimate, se) for the covariances gamma_<annotation>, gamma and rg of two traits. Weights are
    1 / (l max(a b + c**2, floor)), a and b from the heritabilities of the same replicate. rows: unit, z1, z2, n1, n2, d1,
    d2, the annotations and l2_<annotation>; one, two: the traits' rows as for h2(); c: the covariance of their noise."""
    (one, path1), (two, path2) = (_written(x, annotations, ["trait", "n_star", "y", "d"]) for x in (one, two))
    rows, path = _written(rows, annotations, ["z1", "z2", "n1", "n2", "d1", "d2"])
    h1, masses, units = h2_replicates(one, annotations, rounds)
    h2_, _, _ = h2_replicates(two, annotations, rounds)
    (t1, m1), t2 = next(iter(masses.items())), next(iter(h2_))
    total = _total(annotations)
    noise = F.sqrt(F.col("d1") * F.col("d2"))
    n12 = F.sqrt(F.col("n1") * F.col("n2"))
    extra = F.array("n1", "n2", F.col("d1").cast("double"), F.col("d2").cast("double"), F.greatest(total, F.lit(LD_FLOOR)), F.greatest(total, F.lit(LD_FLOOR)))
    x = F.array(*[n12 * F.col(f"l2_{k}") / F.lit(float(m1[i])) for i, k in enumerate(annotations)])
    narrow = rows.select(F.lit("both").alias("key"), F.col("unit").cast("int").alias("unit"), (F.col("z1") * F.col("z2") - F.lit(c) * noise).alias("q"), x.alias("x"), extra.alias("extra"))
    clipped = [np.clip(h.sum(axis=1), 0.0, 1.0)[:, None] for h in (h1[t1], h2_[t2])]
    mass = float(m1.sum())

    def weigh(state: State):
        gamma = np.clip(state["both"].sum(axis=1), -1.0, 1.0)[:, None]

        def weights(key: str, e: np.ndarray) -> np.ndarray:
            n1, n2, d1, d2, ld, over = e.T
            a, b = d1 + clipped[0] * (n1 / mass * ld), d2 + clipped[1] * (n2 / mass * ld)
            own = c * np.sqrt(d1 * d2) + gamma * (np.sqrt(n1 * n2) / mass * ld)
            return 1.0 / (over * np.maximum(a * b + own * own, VARIANCE_FLOOR))

        return weights

    g = refitted(narrow, len(annotations), units, weigh, rounds)["both"]
    with np.errstate(invalid="ignore", divide="ignore"):
        product = h1[t1].sum(axis=1) * h2_[t2].sum(axis=1)
        ratio = np.where((h1[t1].sum(axis=1) > 0) & (h2_[t2].sum(axis=1) > 0), g.sum(axis=1) / np.sqrt(np.abs(product)), np.nan)
    values = {"both": {f"gamma_{k}": g[:, i] for i, k in enumerate(annotations)} | {"gamma": g.sum(axis=1), "rg": ratio}}
    sizes = [("both", u, m) for u, m in rows.groupBy("unit").agg(F.count("*")).collect()]
    for x in (path, path1, path2):
        forget(rows.sparkSession, x)
    return _summary(rows, sizes, values).drop("trait")
