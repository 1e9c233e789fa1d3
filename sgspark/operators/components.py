"""Variance components of any number of annotations from summary statistics, overlapping ones included, and genetic
correlations by component, with delete-block jackknife standard errors of everything reported.

Variants are read once, into sums by jackknife unit; replicates are totals less the unit; a replicate's equations are one
row and are solved there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sgspark.functions.linear import melted, solve
from sgspark.operators import axes


def _cells(annotations: list[str], responses: dict[str, Column]) -> list[Column]:
    out = [F.count("*").alias("m")]
    for k in annotations:
        out += [F.sum(k).cast("double").alias(f"a_{k}"), F.sum(F.col(k) * F.col(k)).cast("double").alias(f"q_{k}")]
        out += [F.sum(F.col(k) * y).alias(f"{name}_{k}") for name, y in responses.items()]
        out += [F.sum(F.col(k) * F.col(f"l2_{j}")).alias(f"al_{k}_{j}") for j in annotations]
        out += [F.sum(F.col(k) * F.col(j)).cast("double").alias(f"aa_{k}_{j}") for j in annotations]
    return out


def _replicates(rows: DataFrame, annotations: list[str], keys: list[str], responses: dict[str, Column], scales: list[str]) -> DataFrame:
    sums = rows.groupBy(*keys, "unit").agg(*_cells(annotations, responses), *[F.max(n).alias(n) for n in scales])
    return axes.replicate_sums(sums, [c for c in sums.columns if c not in (*keys, "unit", *scales)], keys)


def _traces(p: str, annotations: list[str], scale: Column) -> list[list[Column]]:
    """Traces less the noise part: scale sum(a_k l_j) / (A_k of the replicate, A_j of the source), both ways averaged."""
    t = lambda k, j: scale * F.col(f"{p}_al_{k}_{j}") / (F.col(f"{p}_a_{k}") * F.col(f"t_a_{j}"))
    return [[(t(k, j) + t(j, k)) / 2 for j in annotations] for k in annotations]


def h2(rows: DataFrame, annotations: list[str], keys: list[str] = ("trait",), allow_negative: bool = False) -> DataFrame:
    """Heritability by component: (keys, quantity, n_units, estimate, se) for sigma_<k>, sigma_e, total, tau_<k> (effect
    per unit of annotation), h2_<k> (variance of the category, with what overlapping annotations add to it),
    enrichment_<k> (share of h2 over share of the variants, of the category) and tau_star_<k>. rows: keys, unit, n_star,
    y, the annotations and l2_<annotation>. Enrichments of a total <= 0 are left out unless allow_negative."""
    keys, names = list(keys), annotations
    r = _replicates(rows, names, keys, {"ay": F.col("y")}, ["n_star"])
    n = F.col("n_star")
    for p in ("r", "t"):
        rhs = [n * F.col(f"{p}_ay_{k}") / F.col(f"{p}_a_{k}") - n for k in names]
        r = r.withColumn(f"{p}_s", solve(_traces(p, names, n * n), rhs))

    def quantities(p: str) -> dict[str, Column]:
        s = {k: F.col(f"{p}_s")[i] for i, k in enumerate(names)}
        a = {k: F.col(f"{p}_a_{k}") for k in names}
        m = F.col(f"{p}_m").cast("double")
        total = sum(s.values(), F.lit(0.0))
        usable = F.lit(True) if allow_negative else total > 0
        out = {f"sigma_{k}": s[k] for k in names} | {"sigma_e": 1 - total, "total": total}
        for k in names:
            tau = s[k] / a[k]
            category = sum((F.col(f"{p}_aa_{k}_{j}") * s[j] / a[j] for j in names), F.lit(0.0))
            sd = F.sqrt(F.greatest(F.col(f"{p}_q_{k}") / m - (a[k] / m) ** 2, F.lit(0.0)))
            out |= {f"tau_{k}": tau, f"h2_{k}": category, f"enrichment_{k}": F.when(usable, category / total / (a[k] / m)), f"tau_star_{k}": tau * sd / (total / m)}
        return out

    left, full = quantities("r"), quantities("t")
    long = melted(r, [*keys, "unit"], {q: (left[q], full[q]) for q in left}, "m")
    return axes.jackknife(long, "value", "full", "m", [*keys, "quantity"])


def rg(rows: DataFrame, annotations: list[str], overlap: DataFrame) -> DataFrame:
    """Genetic covariance and correlation by component: (quantity, n_units, estimate, se) for gamma_<k>, gamma, rg_<k>, rg
    and rg_delta, rg linearised about the full fit. Every replicate solves the covariance and both heritabilities. rows:
    unit, n1, n2, z1, z2, y1, y2, d1, d2 (noise scales), the annotations and l2_<annotation>; overlap: a one-row table
    with c, the covariance of the traits' noise. A correlation of which a variance isn't positive is left out."""
    names = annotations
    responses = {"xy": F.col("z1") * F.col("z2"), "ay1": F.col("y1"), "ay2": F.col("y2"), "ab": F.sqrt(F.col("d1") * F.col("d2"))}
    r = _replicates(rows, names, [], responses, ["n1", "n2"]).crossJoin(F.broadcast(overlap.select("c")))
    n1, n2 = F.col("n1"), F.col("n2")
    for p in ("r", "t"):
        cross = [(F.col(f"{p}_xy_{k}") - F.col("c") * F.col(f"{p}_ab_{k}")) * F.sqrt(n1 * n2) / F.col(f"{p}_a_{k}") for k in names]
        r = r.withColumn(f"{p}_g", solve(_traces(p, names, n1 * n2), cross))
        for t, n in (("1", n1), ("2", n2)):
            rhs = [n * F.col(f"{p}_ay{t}_{k}") / F.col(f"{p}_a_{k}") - n for k in names]
            r = r.withColumn(f"{p}_s{t}", solve(_traces(p, names, n * n), rhs))

    def share(g: Column, a: Column, b: Column) -> Column:
        return F.when((a > 0) & (b > 0), g / F.sqrt(a * b))

    def sums(p: str) -> tuple[Column, Column, Column]:
        return tuple(sum((F.col(f"{p}_{x}")[i] for i in range(len(names))), F.lit(0.0)) for x in ("g", "s1", "s2"))

    def quantities(p: str) -> dict[str, Column]:
        out = {f"gamma_{k}": F.col(f"{p}_g")[i] for i, k in enumerate(names)}
        out |= {f"rg_{k}": share(F.col(f"{p}_g")[i], F.col(f"{p}_s1")[i], F.col(f"{p}_s2")[i]) for i, k in enumerate(names)}
        return out | {"gamma": sums(p)[0], "rg": share(*sums(p))}

    left, full = quantities("r"), quantities("t")
    (g, a, b), (fg, fa, fb) = sums("r"), sums("t")
    whole = share(fg, fa, fb)
    linear = whole + (g - fg) / F.sqrt(fa * fb) - whole / 2 * ((a - fa) / fa + (b - fb) / fb)
    values = {q: (left[q], full[q]) for q in left} | {"rg_delta": (linear, whole)}
    return axes.jackknife(melted(r, ["unit"], values, "m"), "value", "full", "m", ["quantity"])


def unadjusted(fit: DataFrame, masses: DataFrame, keys: list[str]) -> DataFrame:
    """Components of a fit with variance-weighted annotations, on the genotypes before adjustment: G_k = sigma_k A_k / Av_k,
    shares of G + sigma_e, which is returned as variance. fit: keys, component, sigma and sigma_e; masses: component, a, av."""
    rows = fit.join(F.broadcast(masses), "component").withColumn("g", F.col("sigma") * F.col("a") / F.col("av"))
    total = rows.groupBy(*keys).agg((F.sum("g") + F.max("sigma_e")).alias("variance"))
    return rows.join(F.broadcast(total), keys).select(*keys, "component", (F.col("g") / F.col("variance")).alias("share"), (F.col("sigma_e") / F.col("variance")).alias("share_e"), "variance")


def long_range(rows: DataFrame) -> DataFrame:
    """Standard errors of total h2 corrected for long-range LD between jackknife units. rows: h2, se, n, rho_diag,
    rho_off (between-unit shares of the LD-score mass; negative ones count as 0) and f2, the units' sum of squared shares
    of the variants. Adds factor and se_long: var = se**2 / max(1 - rho_diag - rho_off (1 + 2 h), 0.2) + 4 h**2 (1 - f2) / n
    with h clipped to [0, 1]. A se that isn't positive stays."""
    h = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("h2")))
    return _corrected(rows, 1 + 2 * h, 4 * h * h)


def long_range_rg(rows: DataFrame) -> DataFrame:
    """The same for a genetic covariance: rows have h2_1, h2_2, rg, c and se (of the covariance). The off-diagonal share
    counts m12 = (w1 + 2 w2 + 3 w3) / (w1 + w2 + w3) times, within [1, 3], and the last term is 2 w3 (1 - f2) / n."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    both = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    a, b = unit(F.col("h2_1")), unit(F.col("h2_2"))
    g = both(F.coalesce("rg", F.lit(0.0))) * F.sqrt(a * b)
    e = both(F.col("c") - g)
    w1, w2, w3 = (1 - a) * (1 - b) + e * e, a * (1 - b) + b * (1 - a) + 2 * g * e, a * b + g * g
    total = w1 + w2 + w3
    m12 = F.when(total > 0, F.greatest(F.lit(1.0), F.least(F.lit(3.0), (w1 + 2 * w2 + 3 * w3) / total))).otherwise(1.0)
    return _corrected(rows, m12, 2 * w3)


def _corrected(rows: DataFrame, times: Column, signal: Column) -> DataFrame:
    share = lambda c: F.greatest(F.col(c), F.lit(0.0))
    left = F.greatest(1 - share("rho_diag") - share("rho_off") * times, F.lit(0.2))
    variance = F.col("se") ** 2 / left + signal * (1 - F.col("f2")) / F.col("n")
    fine = F.col("se") > 0
    return rows.withColumns({"factor": F.when(fine, variance / F.col("se") ** 2), "se_long": F.when(fine, F.sqrt(variance)).otherwise(F.col("se"))})
