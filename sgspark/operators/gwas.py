"""Association statistics from sparse dosages, and their quality control, alignment and moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sgspark.functions.linear import solve
from sgspark.functions.whole import spread
from sgspark.sources.tables import dealt


def variant_sums(dosage: DataFrame) -> DataFrame:
    """Per variant: sg, sg2 and carriers."""
    return dosage.groupBy("idx").agg(F.sum("g").alias("sg"), F.sum(F.col("g") * F.col("g")).alias("sg2"), F.count("*").alias("carriers"))


def ols(dosage: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """Exact per-variant least squares on an intercept and the dosage: trait, idx, n, beta, se. Monomorphic variants are
    left out. One shuffle by sample and one by (trait, variant); sums are whole numbers."""
    y = phenotypes.groupBy("trait").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("sy2"))
    xy = dosage.join(phenotypes, "sid").groupBy("trait", "idx").agg(F.sum(F.col("g") * F.col("y")).alias("sgy"), F.sum("g").alias("sg"), F.sum(F.col("g") * F.col("g")).alias("sg2"))
    rows = xy.join(F.broadcast(y), "trait")
    n, sg, sy = F.col("n"), F.col("sg"), F.col("sy")
    sxx, sxy, syy = spread(n, F.col("sg2"), sg, sg), spread(n, F.col("sgy"), sg, sy), spread(n, F.col("sy2"), sy, sy)
    rows = rows.withColumns({"sxx": sxx, "sxy": sxy, "syy": syy}).where("sxx > 0").withColumn("beta", F.col("sxy") / F.col("sxx"))
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("beta") * F.col("sxy")) / ((F.col("n") - 2) * F.col("sxx")))
    return rows.select("trait", "idx", "n", "beta", se.alias("se"))


def adjusted(dosage: DataFrame, phenotypes: DataFrame, covariates: DataFrame, names: list[str], columns: list[str] = ("g",), parts: int = 0) -> DataFrame:
    """Per trait and variant least squares on an intercept, covariates (sid, ...) and one or more columns of the sparse
    table ``dosage`` (idx, sid, ...; absent rows are 0), together: trait, idx, n, and beta_<c> and se_<c> for each column.
    The covariates' cross-products are one row a trait; a variant adds its own sums, and its equations are solved where
    they are. Variants of which a column has no variance beyond the others are left out. A task groups
    what it joins, so samples are dealt to ``parts`` partitions, if given."""
    base = phenotypes.join(covariates, "sid").withColumn("one", F.lit(1.0))
    z = ["one", *names]
    shared = base.groupBy("trait").agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).cast("double").alias("yy"), *[F.sum(F.col(a) * F.col(b)).cast("double").alias(f"{a}_{b}") for i, a in enumerate(z) for b in z[i:]], *[F.sum(F.col(a) * F.col("y")).cast("double").alias(f"{a}_y") for a in z])
    met = dealt(dosage, parts, "sid").join(dealt(base, parts, "sid"), "sid")
    cells = [F.sum(F.col(c) * F.col(a)).cast("double").alias(f"{c}__{a}") for c in columns for a in [*z, "y"]]
    cells += [F.sum(F.col(c) * F.col(e)).cast("double").alias(f"{c}__{e}") for i, c in enumerate(columns) for e in columns[i:]]
    rows = met.groupBy("trait", "idx").agg(*cells).join(F.broadcast(shared), "trait")
    whole = [*z, *columns]

    def cell(a: str, b: str) -> Column:
        i, j = sorted((whole.index(a), whole.index(b)))
        a, b = whole[i], whole[j]
        if j < len(z):
            return F.col(f"{a}_{b}")
        return F.col(f"{b}__{a}") if i < len(z) else F.col(f"{a}__{b}")

    gram = [[cell(a, b) for b in whole] for a in whole]
    right = [F.col(f"{a}_y") for a in z] + [F.col(f"{c}__y") for c in columns]
    k = len(whole)
    unit = lambda i: [F.lit(1.0 if j == i else 0.0) for j in range(k)]
    rows = rows.withColumn("_b", solve(gram, right)).withColumns({f"_i{c}": solve(gram, unit(len(z) + i))[len(z) + i] for i, c in enumerate(columns)})
    rss = F.col("yy") - sum((F.col("_b")[i] * right[i] for i in range(k)), F.lit(0.0))
    rows = rows.withColumn("_v", F.greatest(rss, F.lit(0.0)) / (F.col("n") - k))
    for c in columns:
        # what the others leave of the column's sum of squares is the inverse of its diagonal cell
        rows = rows.where((F.col(f"_i{c}") > 0) & (1 / F.col(f"_i{c}") > 1e-9 * F.col(f"{c}__{c}")))
    return rows.select("trait", "idx", "n", *[F.col("_b")[len(z) + i].alias(f"beta_{c}") for i, c in enumerate(columns)], *[F.sqrt(F.col("_v") * F.col(f"_i{c}")).alias(f"se_{c}") for c in columns])


def strand_check(rows: DataFrame, least: float = 0.2, margin: float = 0.05, variants: int = 50) -> DataFrame:
    """One row that tells whether ambiguous variants look strand-flipped against a reference of two ancestries. rows: freq,
    base, delta (the ancestries' difference) and ambiguous. The mean ancestry is fitted on the others that differ by
    ``least``; a variant is discordant if its frequency is closer, by ``margin``, to the flipped expectation; expectations
    near one half don't count. Columns: ancestry, and snps, discordant by kind, and fails: the ambiguous ones' rate
    exceeds 5% and three times the others' plus 1%."""
    fine = rows.where("freq is not null and base is not null").where(F.abs("delta") >= least)
    fit = fine.where("not ambiguous").agg(F.count("*").alias("_n"), (F.sum(F.col("delta") * (F.col("freq") - F.col("base"))) / F.sum(F.col("delta") * F.col("delta"))).alias("ancestry"))
    each = fine.crossJoin(F.broadcast(fit.where(F.col("_n") >= variants)))
    expected = F.least(F.greatest(F.col("base") + F.col("delta") * F.col("ancestry"), F.lit(0.0)), F.lit(1.0))
    each = each.withColumn("_e", expected).where(F.abs(2 * F.col("_e") - 1) > 0.2)
    wrong = (F.abs(F.col("freq") - (1 - F.col("_e"))) + margin < F.abs(F.col("freq") - F.col("_e"))).cast("double")
    out = each.groupBy("ancestry").agg(*[x for name, kind in (("ambiguous", F.col("ambiguous")), ("other", ~F.col("ambiguous"))) for x in (F.sum(kind.cast("long")).alias(f"{name}_snps"), F.avg(F.when(kind, wrong)).alias(f"{name}_discordant"))])
    rate = F.greatest(F.lit(0.05), 3 * F.coalesce("other_discordant", F.lit(0.0)) + 0.01)
    return out.withColumn("fails", F.coalesce((F.col("ambiguous_snps") >= variants) & (F.col("ambiguous_discordant") > rate), F.lit(False)))


def qc(stats: DataFrame, key: str = "snp") -> DataFrame:
    """Drops rows with a null, non-finite or non-positive n or se or a non-finite beta; of repeated keys the row of the
    largest n stays, ties by ``line``; adds z = beta / se * sqrt(n / max n)."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    beta, se, n = F.col("beta").cast("double"), F.col("se").cast("double"), F.col("n").cast("double")
    rows = stats.where(fine(beta) & fine(se) & fine(n) & (se > 0) & (n > 0))
    rows = rows.withColumn("_turn", F.row_number().over(W.partitionBy("trait", key).orderBy(F.desc("n"), "line"))).where("_turn = 1").drop("_turn")
    most = rows.groupBy("trait").agg(F.max("n").alias("n_max"))
    return rows.join(F.broadcast(most), "trait").withColumn("z", F.col("beta") / F.col("se") * F.sqrt(F.col("n") / F.col("n_max")))


def allele_code(allele: Column) -> Column:
    """A, C, G, T as 0..3 whatever the case, else -1."""
    return F.when(F.length(allele) == 1, F.instr(F.lit("ACGT"), F.upper(allele)) - 1).otherwise(-1)


def harmonised(rows: DataFrame, ref1: str, ref2: str, own1: str, own2: str, drop_ambiguous: bool = True) -> DataFrame:
    """Adds keep and flip: direct, swapped, strand-flipped or both; A/T and C/G pairs are dropped unless told otherwise,
    and a literal match is never a flip. Other alleles keep nothing."""
    a, b, c, d = (allele_code(F.col(x)) for x in (ref1, ref2, own1, own2))
    valid = (a >= 0) & (b >= 0) & (c >= 0) & (d >= 0) & (a != b) & (c != d)
    ambiguous = (a + b == 3) | (c + d == 3)
    direct, swapped = (a == c) & (b == d), (a == d) & (b == c)
    strand, both = (a == 3 - c) & (b == 3 - d), (a == 3 - d) & (b == 3 - c)
    usable = valid & ~ambiguous if drop_ambiguous else valid
    keep = usable & (direct | swapped | strand | both)
    return rows.withColumn("keep", F.coalesce(keep, F.lit(False))).withColumn("flip", F.coalesce(keep & ~direct & (swapped | (both & ~strand)), F.lit(False)))


def score_moments(stats: DataFrame, cov_rank: int = 0) -> DataFrame:
    """Adds z_star, d (noise scale) and y = z_star**2 - (d - 1), by trait: n* = max n - c - 1, nu = n - c - 2."""
    most = F.broadcast(stats.groupBy("trait").agg((F.max("n") - cov_rank - 1).cast("double").alias("n_star")))
    nu = F.col("n") - cov_rank - 2
    rows = stats.join(most, "trait").withColumn("z_star", F.sqrt("n_star") * F.col("beta") / F.sqrt(F.col("beta") ** 2 + nu * F.col("se") ** 2))
    return rows.withColumn("d", F.col("n_star") / (nu + 1)).withColumn("y", F.col("z_star") ** 2 - (F.col("d") - 1))


def chisq_threshold(n_max: Column) -> Column:
    return F.greatest(F.lit(80.0), n_max * 0.001)


def chisq_summary(stats: DataFrame) -> DataFrame:
    """Per trait: count, mean, median, max, lambda_gc and quantiles of z**2."""
    x = F.col("z") ** 2
    q = lambda p: F.percentile(x, F.lit(p))
    return stats.groupBy("trait").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), q(0.5).alias("median"), F.max(x).alias("max"), (q(0.5) / 0.4549364).alias("lambda_gc"), q(0.9).alias("p90"), q(0.99).alias("p99"), q(0.999).alias("p999"))


def top(stats: DataFrame, k: int) -> DataFrame:
    """The k variants of the largest z**2 of each trait, ties by idx."""
    w = W.partitionBy("trait").orderBy(F.desc("chisq"), "idx")
    return stats.withColumn("chisq", F.round(F.col("z") ** 2, 9)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def matched(target: DataFrame, ref: DataFrame, drop_ambiguous: bool = True) -> DataFrame:
    """Inner join by chr and bp of rows whose key is unique on both sides, with keep and flip."""
    once = lambda df: df.withColumn("_n", F.count("*").over(W.partitionBy("chr", "bp"))).where("_n = 1").drop("_n")
    r = once(ref).select("chr", "bp", F.col("a1").alias("ref_a1"), F.col("a2").alias("ref_a2"))
    return harmonised(once(target).join(r, ["chr", "bp"]), "ref_a1", "ref_a2", "a1", "a2", drop_ambiguous)
