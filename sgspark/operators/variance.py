"""Variance components from summary statistics: heritability and genetic correlation by moment equations over
annotations, with delete-block jackknife, and reweighted LD-score regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sgspark.functions.whole import spread
from sgspark.operators import axes
from sgspark.sources.shared import folder, kept


def unit_sums(rows: DataFrame, annotations: list[str], keys: list[str]) -> DataFrame:
    """Per key and unit: m, a_k, al_kl (annotation k times LD score l) and ay_k. One aggregate over the variants."""
    cells = [F.sum(F.col(k)).alias(f"a_{k}") for k in annotations] + [F.sum(F.col(k) * F.col("y")).alias(f"ay_{k}") for k in annotations]
    cells += [F.sum(F.col(k) * F.col(f"l2_{j}")).alias(f"al_{k}_{j}") for k in annotations for j in annotations]
    return rows.groupBy(*keys, "unit").agg(F.count("*").alias("m"), F.max("n_star").alias("n_star"), *cells)


def h2_single(rows: DataFrame, annotation: str = "base") -> DataFrame:
    """One component by trait, with jackknife SE: T = n**2 AL / (A M) + n, q = n Ay / A, h2 = (q - n) / (T - n). The mass
    M of the source stays the full one in every replicate. rows: trait, unit, n_star, y, annotation and l2_<annotation>."""
    k = annotation
    r = axes.replicate_sums(unit_sums(rows, [k], ["trait"]), ["m", f"a_{k}", f"ay_{k}", f"al_{k}_{k}"], ["trait"])
    n = F.col("n_star")

    def h2(p: str):
        a = F.col(f"{p}_a_{k}")
        return (n * F.col(f"{p}_ay_{k}") / a - n) / (n * n * F.col(f"{p}_al_{k}_{k}") / (a * F.col(f"t_a_{k}")))

    r = r.withColumn("_full", h2("t")).withColumn("_value", h2("r"))
    return axes.jackknife(r, "_value", "_full", "m", ["trait"])


def h2_pair(rows: DataFrame, one: str, two: str) -> DataFrame:
    """Two components by trait from the full sums, by Cramer's rule; off-diagonals are averaged. Returns sigma_1,
    sigma_2, total, and each component's enrichment (its share of the total over its share of the mass)."""
    s = unit_sums(rows, [one, two], ["trait"]).groupBy("trait").agg(*[F.sum(c).alias(c) for c in ("m", f"a_{one}", f"a_{two}", f"ay_{one}", f"ay_{two}", f"al_{one}_{one}", f"al_{one}_{two}", f"al_{two}_{one}", f"al_{two}_{two}")], F.max("n_star").alias("n"))
    n = F.col("n")
    t = lambda k, j: n * n * F.col(f"al_{k}_{j}") / (F.col(f"a_{k}") * F.col(f"a_{j}"))
    s = s.withColumns({"t11": t(one, one), "t22": t(two, two), "t12": (t(one, two) + t(two, one)) / 2, "b1": n * F.col(f"ay_{one}") / F.col(f"a_{one}") - n, "b2": n * F.col(f"ay_{two}") / F.col(f"a_{two}") - n})
    det = F.col("t11") * F.col("t22") - F.col("t12") * F.col("t12")
    s = s.withColumns({"sigma_1": (F.col("b1") * F.col("t22") - F.col("b2") * F.col("t12")) / det, "sigma_2": (F.col("b2") * F.col("t11") - F.col("b1") * F.col("t12")) / det})
    total = F.col("sigma_1") + F.col("sigma_2")
    share = lambda k, sigma: (F.col(sigma) / total) / (F.col(f"a_{k}") / F.col("m"))
    return s.select("trait", "m", "sigma_1", "sigma_2", total.alias("total"), share(one, "sigma_1").alias("enrichment_1"), share(two, "sigma_2").alias("enrichment_2"))


def rg_rows(moments: DataFrame, first: str, second: str) -> DataFrame:
    """The two traits side by side with y = z1 z2 and n_star = sqrt(n1 n2)."""
    one = moments.where(F.col("trait") == first).select("idx", F.col("z_star").alias("z1"), F.col("n_star").alias("n1"), F.col("y").alias("y1"))
    two = moments.where(F.col("trait") == second).select("idx", F.col("z_star").alias("z2"), F.col("n_star").alias("n2"), F.col("y").alias("y2"))
    return one.join(two, "idx")


def rg_single(rows: DataFrame, overlap: DataFrame) -> DataFrame:
    """Genetic covariance and correlation of two traits, with jackknife SE of the covariance. rows: idx, unit, base,
    l2_base, z1, z2, y1, y2, n1, n2; overlap: a one-row table with c, the covariance of the traits' noise."""
    sums = rows.groupBy("unit").agg(F.count("*").alias("m"), F.sum("l2_base").alias("al"), F.sum(F.col("z1") * F.col("z2")).alias("ay"), F.sum("y1").alias("ay1"), F.sum("y2").alias("ay2"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    r = axes.replicate_sums(sums.crossJoin(F.broadcast(overlap)), ["m", "al", "ay", "ay1", "ay2"])

    def covariance(p: str):
        m = F.col(f"{p}_m").cast("double")
        return (F.col(f"{p}_ay") / m - F.col("c")) * F.sqrt(F.col("n1") * F.col("n2")) / (F.col("n1") * F.col("n2") * F.col(f"{p}_al") / (m * F.col("t_m")))

    def h2(p: str, t: int):
        m = F.col(f"{p}_m").cast("double")
        return (F.col(f"{p}_ay{t}") / m - 1) * F.col(f"n{t}") / (F.col(f"n{t}") ** 2 * F.col(f"{p}_al") / (m * F.col("t_m")))

    r = r.withColumns({"_full": covariance("t"), "_value": covariance("r"), "h1": h2("t", 1), "h2": h2("t", 2), "_one": F.lit(1)})
    heads = r.groupBy("_one").agg(F.max("h1").alias("h1"), F.max("h2").alias("h2"))
    out = axes.jackknife(r, "_value", "_full", "m", ["_one"]).join(heads, "_one")
    product = F.col("h1") * F.col("h2")
    return out.select("n_units", F.col("estimate").alias("covariance"), "se", F.when(product > 0, F.col("estimate") / F.sqrt(product)).alias("rg"))


def overlap_covariance(samples: DataFrame, one: str, two: str) -> DataFrame:
    """Covariance of two traits' residuals (intercept only) over shared samples, as a share of their norms: c."""
    n = F.count("*")
    top, x, y = (spread(n, F.sum(F.col(a) * F.col(b)), F.sum(a), F.sum(b)) for a, b in ((one, two), (one, one), (two, two)))
    return samples.agg(n.alias("n"), (top / F.sqrt(x * y)).alias("c"))


def ldsc(rows: DataFrame, rounds: int = 3) -> DataFrame:
    """LD-score regression with a fixed intercept, reweighted ``rounds`` times: regress y - 1 on n l / M by trait with
    weights 1 / (2 (1 + clip(h, 0, 1) n / M max(l, 1))**2 max(l, 1)). The narrow rows are written once; each round is one
    aggregate over them, of which a row a trait goes back by a broadcast; nothing is collected. Returns trait, m, h2."""
    rows = kept(rows.select("trait", "n_star", "y", "l2_base"), folder(rows.sparkSession, "ldsc"))
    n, q, ld = F.col("n_star"), F.col("y") - 1, F.col("l2_base")
    state = rows.groupBy("trait").agg(F.count("*").cast("double").alias("_M"), (F.count("*") * F.sum(q) / (F.max("n_star") * F.sum(ld))).alias("_h"))
    floor = F.greatest(ld, F.lit(1.0))
    for _ in range(rounds):
        mean = 1 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_h"))) * n / F.col("_M") * floor
        w, x = 1 / (2 * F.greatest(mean, F.lit(1e-3)) ** 2 * floor), n * ld / F.col("_M")
        state = rows.join(F.broadcast(state), "trait").groupBy("trait", "_M").agg((F.sum(w * x * q) / F.sum(w * x * x)).alias("_h"))
    return state.select("trait", F.col("_M").cast("long").alias("m"), F.col("_h").alias("h2"))


def h2_tau(rows: DataFrame, one: str, two: str) -> DataFrame:
    """Per component of h2_pair its effect per unit of annotation, tau = sigma / mass, and tau* = tau sd(a) / (h2 / M)."""
    fit = h2_pair(rows, one, two)
    notes = rows.groupBy("trait").agg(F.sum(one).alias("m_1"), F.sum(two).alias("m_2"), F.stddev_pop(one).alias("sd_1"), F.stddev_pop(two).alias("sd_2"))
    out = fit.join(notes, "trait")
    star = lambda k: F.col(f"sigma_{k}") / F.col(f"m_{k}") * F.col(f"sd_{k}") / (F.col("total") / F.col("m"))
    return out.select("trait", *[(F.col(f"sigma_{k}") / F.col(f"m_{k}")).alias(f"tau_{k}") for k in (1, 2)], *[star(k).alias(f"tau_star_{k}") for k in (1, 2)])


def symmetrised_trace(rows: DataFrame, one: str, two: str) -> DataFrame:
    """The two off-diagonal traces of a pair of annotations and their combination of least jackknife variance:
    w = (v2 - c) / (v1 + v2 - 2 c), clipped to [0, 1], 0.5 where it isn't defined. One row a trait."""
    r = axes.replicate_sums(unit_sums(rows, [one, two], ["trait"]), [f"a_{one}", f"a_{two}", f"al_{one}_{two}", f"al_{two}_{one}"], ["trait"])
    n = F.col("n_star")
    t = lambda p, k, j: n * n * F.col(f"{p}_al_{k}_{j}") / (F.col(f"{p}_a_{k}") * F.col(f"t_a_{j}"))
    r = r.withColumns({"x": t("r", one, two), "y": t("r", two, one), "fx": t("t", one, two), "fy": t("t", two, one)})
    s = r.groupBy("trait").agg(F.max("fx").alias("t12"), F.max("fy").alias("t21"), F.var_pop("x").alias("v1"), F.var_pop("y").alias("v2"), F.covar_pop("x", "y").alias("c"))
    span = F.col("v1") + F.col("v2") - 2 * F.col("c")
    w = F.when(span > 0, F.least(F.greatest((F.col("v2") - F.col("c")) / span, F.lit(0.0)), F.lit(1.0))).otherwise(0.5)
    return s.withColumn("w", w).select("trait", "t12", "t21", "w", (F.col("w") * F.col("t12") + (1 - F.col("w")) * F.col("t21")).alias("t"))


def h2_delete_two(rows: DataFrame) -> DataFrame:
    """One component by trait with a delete-two jackknife: variance mean((M - m_S) / m_S (theta_S - theta)**2) over all
    pairs of units."""
    u = unit_sums(rows, ["base"], ["trait"]).select("trait", "unit", "n_star", F.col("m").cast("double").alias("m"), F.col("ay_base").alias("ay"), F.col("al_base_base").alias("al"))
    total = u.groupBy("trait").agg(F.sum("m").alias("tm"), F.sum("ay").alias("tay"), F.sum("al").alias("tal"))
    v = u.select("trait", F.col("unit").alias("other"), *[F.col(c).alias(f"o{c}") for c in ("m", "ay", "al")])
    # pairs of jackknife units are the replicates
    p = u.join(v, "trait").where("unit < other").join(F.broadcast(total), "trait")
    n, tm = F.col("n_star"), F.col("tm")
    h2 = lambda m, ay, al: (n * ay / m - n) / (n * n * al / (m * tm))
    left = F.col("m") + F.col("om")
    p = p.withColumns({"full": h2(tm, F.col("tay"), F.col("tal")), "x": h2(tm - left, F.col("tay") - F.col("ay") - F.col("oay"), F.col("tal") - F.col("al") - F.col("oal"))})
    return p.groupBy("trait").agg(F.count("*").alias("replicates"), F.max("full").alias("estimate"), F.sqrt(F.avg((tm - left) / left * (F.col("x") - F.col("full")) ** 2)).alias("se"))


def overlap_intercept(rows: DataFrame) -> DataFrame:
    """The noise covariance c of two traits, estimated with the genetic covariance held to its moment equation: with
    x = l - 1 (a variant's own term taken off), alpha = sum y / sum x and delta = m / sum x,
    c = sum w (1 - delta x)(y - alpha x) / sum w (1 - delta x)**2, weights 1 / max(l, 1). rows: y, l2_base."""
    w, x = 1 / F.greatest(F.col("l2_base"), F.lit(1.0)), F.col("l2_base") - 1
    s = rows.agg(F.count("*").alias("m"), F.sum(x).alias("s"), F.sum("y").alias("t"), F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"), F.sum(w * F.col("y")).alias("wy"), F.sum(w * x * F.col("y")).alias("wxy"))
    alpha, delta = F.col("t") / F.col("s"), F.col("m") / F.col("s")
    top = F.col("wy") - delta * F.col("wxy") - alpha * F.col("wx") + alpha * delta * F.col("wxx")
    bottom = F.col("w") - 2 * delta * F.col("wx") + delta * delta * F.col("wxx")
    return s.select("m", (top / bottom).alias("c"))
