"""Phenotype transformations and scalar functions of binary traits, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transformed(value: Column, kind: str, shift: float = 0.0, power: float | None = None) -> Column:
    """value, log(value + shift), or ((value + shift)**power - 1) / power (its logarithm at power 0). Values that the
    logarithm isn't defined for give null."""
    if kind == "identity":
        return value.cast("double")
    if kind not in ("log", "box_cox") or (kind == "box_cox") != (power is not None):
        raise ValueError(f"no transformation {kind} with power {power}")
    t = F.when(value + shift > 0, F.log(value + F.lit(float(shift))))
    return box_cox_derivatives(t, float(power), 0)[0] if power else t


#: Halvings that the rest of a series is through, at least, when it is cut.
HALVINGS = 60


def _moment(x: Column, k: int) -> Column:
    """The integral of u**k exp(x u) over [0, 1] by a series without subtractions: sum_j x**j / (j! (j + k + 1)) for x >= 0,
    and exp(x) sum_j (-x)**j / ((k + 1) ... (k + 1 + j)) below (Kummer's transformation). From j = 2 |x| on terms at least
    halve, so a row adds up that many and HALVINGS more."""
    size, up = F.abs(x), x >= 0
    first = F.when(up, 1.0).otherwise(1.0 / (k + 1))
    places = F.sequence(F.lit(1), (F.ceil(2 * size) + HALVINGS).cast("int"))

    def grown(s: Column, j: Column) -> Column:
        term = s["term"] * size / F.when(up, j).otherwise(j + (k + 1))
        return F.struct(term.alias("term"), (s["total"] + term / F.when(up, j + (k + 1)).otherwise(1.0)).alias("total"))

    total = F.aggregate(places, F.struct(first.alias("term"), F.lit(1.0 / (k + 1)).alias("total")), grown, lambda s: s["total"])
    return total * F.when(up, 1.0).otherwise(F.exp(x))


def box_cox_derivatives(t: Column, power: float, order: int = 3) -> list[Column]:
    """The Box-Cox transform of exp(t) and its first ``order`` derivatives by the power: t**(k+1) times the integral of
    u**k exp(power t u) over [0, 1]."""
    x = t * F.lit(float(power))
    return [F.pow(t, F.lit(float(k + 1))) * _moment(x, k) for k in range(order + 1)]


def standardised(rows: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Columns less their mean over their standard deviation (ddof 0); constant ones become null. Sums are made by group
    and joined back, so no group is ordered or held."""
    stats = rows.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = rows.join(F.broadcast(stats), list(by)) if by else rows.crossJoin(F.broadcast(stats))
    return joined.withColumns({c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}).drop(*[f"_{k}_{c}" for k in "ms" for c in columns])


def contexts(rows: DataFrame, terms: dict[str, list[tuple[str, int]]]) -> DataFrame:
    """Adds a column for each term, a product of powers of columns; an empty product is the intercept. A null factor makes
    the term null."""
    out = {}
    for name, factors in terms.items():
        value = F.lit(1.0)
        for column, power in factors:
            if power < 1:
                raise ValueError(f"{name}: power {power} of {column}")
            value = value * F.pow(F.col(column).cast("double"), F.lit(float(power)))
        out[name] = value
    return rows.withColumns(out)


def population_risk(risk: Column, population: float, sample: Column) -> Column:
    """The risk in the sample of one whose risk in the population is ``risk``, cases being sampled with their share
    ``sample`` instead of ``population``: k / (k + a (1 - k)), a = K (1 - P) / (P (1 - K))."""
    a = population * (1 - sample) / (sample * (1 - population))
    return risk / (risk + a * (1 - risk))


def liability(case: Column, risk: Column, threshold: Column, sample_risk: Column) -> tuple[Column, Column]:
    """The standardised residual z = (y - p) / sqrt(p (1 - p)) of a binary trait, and its sensitivity to the liability,
    d = density(threshold) sqrt(p (1 - p)) / (k (1 - k)); threshold is the normal quantile of the population risk."""
    spread = F.sqrt(sample_risk * (1 - sample_risk))
    density = F.exp(-0.5 * threshold * threshold) * F.lit(0.3989422804014327)
    return (case - sample_risk) / spread, density * spread / (risk * (1 - risk))

