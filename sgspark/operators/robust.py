"""Tests of sets of features on many traits whose variance may differ from person to person (HC3).

For features F, fixed effects with an orthonormal basis U, and a trait y: r = F - U U'F, H = r'r, s = r'y, b = H^+ s, and
residuals e = y - U U'y - r b. A person's leverage is |U_i|**2 + r_i' H^+ r_i, and the scores' covariance is
V = sum_i r_i r_i' e_i**2 / (1 - leverage_i)**2. Three passes over people: the basis, the products with it, and V; each is a
sum within tasks and then over them. What a trait's row needs is solved where its sums are.

Rows with a null or non-finite value in any named column take no part. Features that the fixed effects or other features
explain have no coefficient of their own (null), yet the set's tests hold on what is left; people whom the fixed effects
determine alone (leverage 1) don't count. A set without any variance has null tests. No usable rows give null tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sgspark.functions.quadratic import tails
from sgspark.operators.basis import orthonormal

#: Leverage from which a person is determined by the fixed effects; smallest share of an eigenvalue that counts.
DETERMINED, SMALLEST = 1 - 1e-10, 1e-10


def _numbers(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1 if len(flat) else 0)


def _cells(rows: DataFrame, make) -> np.ndarray:
    """Sums over people of the arrays that ``make(features, traits, basis)`` gives for a batch; as long as these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(*(_numbers(batch.column(i)) for i in range(3)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["x"])

    found = rows.mapInArrow(run, "x array<double>").select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(found))
    for r in found:
        out[r["k"]] = r["x"]
    return out


def inverse(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A generalised inverse of a positive semidefinite matrix, whether each coordinate is determined, and the rank."""
    scale = np.sqrt(np.maximum(np.diag(h), 0))
    scale[scale == 0] = 1
    values, vectors = np.linalg.eigh(h / scale[:, None] / scale[None, :])
    keep = values > SMALLEST * max(values[-1], 1e-300) if len(values) else np.zeros(0, bool)
    part = vectors[:, keep]
    fixed = (vectors[:, ~keep] ** 2).sum(axis=1) < 1e-8
    return part / values[keep] @ part.T / scale[:, None] / scale[None, :], fixed & (np.diag(h) > 0), int(keep.sum())


def scores(people: DataFrame, features: list[str], traits: list[str], fixed: list[str]) -> DataFrame:
    """A row a trait: trait, n, fixed_rank, max_leverage, s, h and v (matrices row by row)."""
    spark = people.sparkSession
    named = [*dict.fromkeys([*features, *traits, *fixed])]
    real = people.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(CAST(`{c}` AS DOUBLE)) AND abs(CAST(`{c}` AS DOUBLE)) < double('Infinity')" for c in named))
    base = orthonormal(real, fixed)
    cells = lambda names: F.array(*[F.col(f"`{c}`").cast("double") for c in names])
    rows = base.rows.select(cells(features).alias("f"), cells(traits).alias("y"), "q")
    p, t, k = len(features), len(traits), base.rank

    def products(f: np.ndarray, y: np.ndarray, u: np.ndarray) -> np.ndarray:
        u = u.reshape(len(f), k)
        return np.concatenate([x.ravel() for x in (u.T @ f, f.T @ f, u.T @ y, f.T @ y, np.array([len(f)]))])

    total = _cells(rows, products)
    if not len(total):
        total = np.zeros(k * p + p * p + k * t + p * t + 1)
    a, ff, c, fy, n = np.split(total, np.cumsum([k * p, p * p, k * t, p * t]))
    a, c = a.reshape(k, p), c.reshape(k, t)
    h, s = ff.reshape(p, p) - a.T @ a, fy.reshape(p, t) - a.T @ c
    none = np.diag(h) <= 1e-10 * np.diag(ff.reshape(p, p))  # what rounding has left of features that the fixed effects explain
    h[none], h[:, none], s[none] = 0, 0, 0
    bread, _, _ = inverse(h)
    coef = bread @ s

    def meat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = np.zeros((t, p * p)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            f, y, u = (_numbers(batch.column(i)) for i in range(3))
            u = u.reshape(len(f), k)
            r = np.where(none, 0, f - u @ a)
            own = (u * u).sum(axis=1)
            leverage = own + np.einsum("ij,jk,ik->i", r, bread, r)
            some = own < DETERMINED
            most = max(most, float(leverage[some].max(initial=0)))
            e = np.where(some[:, None], (y - u @ c - r @ coef) / (1 - np.where(some, leverage, 0))[:, None], 0)
            outer = (r[:, :, None] * r[:, None, :]).reshape(len(r), -1)
            total += (e**2).T @ outer
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(t), pa.int32()), pa.array(list(total), pa.list_(pa.float64())), pa.array(np.full(t, most))], ["t", "v", "top"])

    sums = rows.mapInArrow(meat, "t int, v array<double>, top double")
    added = sums.select("t", "top", F.posexplode("v").alias("i", "x")).groupBy("t", "i").agg(F.sum("x").alias("x"), F.max("top").alias("top"))
    v = added.groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("v"), F.max("top").alias("max_leverage"))
    fixed_cells = spark.createDataFrame([(j, name, int(n[0]), k, s[:, j].tolist(), h.ravel().tolist()) for j, name in enumerate(traits)], "t int, trait string, n long, fixed_rank int, s array<double>, h array<double>")
    return fixed_cells.join(v, "t").drop("t")


def _tail(q: float, w: np.ndarray) -> tuple[float | None, float | None]:
    p, error = tails(np.array([q]), w[None, :])
    return float(p[0]), float(error[0])


def tests(summary: DataFrame, features: list[str], weights: list[float] | None = None, burden: list[float] | None = None, contrasts: dict[str, list[float]] | None = None) -> DataFrame:
    """A row a trait: beta, se and p by feature (arrays); joint_wald, joint_df and joint_p; kernel_q = sum of weights times
    squared scores with kernel_p by the weighted chi-squares of its covariance, and kernel_p_error; burden_z and burden_p of
    the weighted sum of scores (equal weights unless given); least_p, Bonferroni's of the single ones; contrast_beta,
    contrast_se and contrast_p by name."""
    p = len(features)
    w, b = np.ones(p) if weights is None else np.asarray(weights, float), np.ones(p) if burden is None else np.asarray(burden, float)
    if len(w) != p or len(b) != p or (w < 0).any() or not w.any() or not b.any():
        raise ValueError("weights are as many as the features, not negative and not all 0")
    asked = {name: np.asarray(x, float) for name, x in (contrasts or {}).items()}

    def of(row: dict) -> dict:
        s, h, v = np.array(row["s"]), np.array(row["h"]).reshape(p, p), np.array(row["v"]).reshape(p, p)
        bread, known, _ = inverse(h)
        coef, cov = bread @ s, bread @ v @ bread
        out: dict = {c: row[c] for c in ("trait", "n", "fixed_rank", "max_leverage")}
        se = np.sqrt(np.maximum(np.diag(cov), 0))
        good = known & (se > 0)
        single = [_tail((coef[i] / se[i]) ** 2, np.ones(1))[0] if good[i] else None for i in range(p)]
        out |= {"beta": [float(coef[i]) if known[i] else None for i in range(p)], "se": [float(se[i]) if good[i] else None for i in range(p)], "p": single}
        values = np.linalg.eigvalsh(np.sqrt(w)[:, None] * v * np.sqrt(w)[None, :])
        back, _, rank = inverse(v) if values[-1] > 0 else (None, None, 0)
        out |= {"joint_wald": float(s @ back @ s) if rank else None, "joint_df": rank, "joint_p": _tail(float(s @ back @ s), np.ones(rank))[0] if rank else None}
        out["kernel_q"] = float(w @ s**2)
        out["kernel_p"], out["kernel_p_error"] = _tail(out["kernel_q"], values[values > 1e-12 * values[-1]]) if values[-1] > 0 else (None, None)
        spread = float(b @ v @ b)
        some = spread > 1e-12 * max(values[-1], 0) * float(b @ b)
        out["burden_z"] = float(b @ s / np.sqrt(spread)) if some else None
        out["burden_p"] = _tail(out["burden_z"] ** 2, np.ones(1))[0] if some else None
        found = [x for x in single if x is not None]
        out["least_p"] = min(1.0, p * min(found)) if found else None
        for part in ("beta", "se", "p"):
            out[f"contrast_{part}"] = {}
        for name, x in asked.items():
            size = np.sqrt(max(float(x @ cov @ x), 0))
            fits = np.linalg.norm(x - x @ bread @ h) <= 1e-8 * np.linalg.norm(x)
            out["contrast_beta"][name] = float(x @ coef) if fits else None
            out["contrast_se"][name] = size if fits and size > 0 else None
            out["contrast_p"][name] = _tail((x @ coef / size) ** 2, np.ones(1))[0] if fits and size > 0 else None
        return out

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = "trait string, n long, fixed_rank int, max_leverage double, beta array<double>, se array<double>, p array<double>, joint_wald double, joint_df int, joint_p double, kernel_q double, kernel_p double, kernel_p_error double, burden_z double, burden_p double, least_p double, contrast_beta map<string, double>, contrast_se map<string, double>, contrast_p map<string, double>"

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [of(r) for r in batch.to_pylist()]
            for m in made:
                for part in ("beta", "se", "p"):
                    m[f"contrast_{part}"] = list(m[f"contrast_{part}"].items())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([m[f.name] for m in made], f.type) for f in kinds], schema=kinds)

    return summary.mapInArrow(run, schema)


def combined(parts: DataFrame) -> DataFrame:
    """Scores of the same features in cohorts without people in common, added up by trait: s, h and v are sums."""
    cells = parts.select("trait", "n", "fixed_rank", "max_leverage", F.posexplode(F.arrays_zip(F.array("s", "h", "v"))).alias("which", "_z"))
    flat = cells.select("trait", "n", "fixed_rank", "max_leverage", "which", F.posexplode(F.col("_z")["0"]).alias("i", "x"))
    sums = flat.groupBy("trait", "which", "i").agg(F.sum("x").alias("x")).groupBy("trait", "which").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("a"))
    wide = sums.groupBy("trait").agg(*[F.max(F.when(F.col("which") == k, F.col("a"))).alias(c) for k, c in enumerate(("s", "h", "v"))])
    heads = parts.groupBy("trait").agg(F.sum("n").alias("n"), F.sum("fixed_rank").cast("int").alias("fixed_rank"), F.max("max_leverage").alias("max_leverage"))
    return heads.join(wide, "trait").select("trait", "n", "fixed_rank", "s", "h", "v", "max_leverage")
