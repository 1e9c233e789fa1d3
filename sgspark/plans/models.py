"""Named queries of the general estimators, the context moments, and the readers (each on files written from the tables)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sgspark.functions import quadratic, transforms
from sgspark.operators import axes, basis, blocks, components, contexts, gwas, ldsc, ldscore, longrange, mixture, ranks, robust, segments, sparse, variance
from sgspark.plans import queries as base
from sgspark.plans.queries import BLOCKS, WIDTH, query, rounded
from sgspark.session import checkpointed
from sgspark.sources import files, genotypes, inputs, tables
from sgspark.sources.shared import folder, kept


def _moments(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    """Score moments with units, annotations and their LD scores."""
    axis, dosage = tables.variants(spark, d), base._dosage(spark, d)
    notes = axis.select("idx", F.lit(1).alias("base"), "low", "high", "promo")
    scores = ldscore.window_scores(axis, dosage, gwas.variant_sums(dosage), base._n(spark, d), WIDTH, notes, names, tables.parts_of(spark, d))
    units = axes.equal_units(axis, BLOCKS).select("idx", "unit", F.lit(1).alias("base"), "low", "high", "promo")
    # estimators read the rows several times, as they are few
    return kept(gwas.score_moments(base._stats(spark, d, dosage)).join(units, "idx").join(scores, "idx"), folder(spark, "moments"))


def _both(rows: DataFrame) -> DataFrame:
    """The two traits' moments of a variant in one row."""
    shared = [c for c in rows.columns if c not in ("trait", "n", "beta", "se", "n_star", "z_star", "d", "y")]
    one = rows.where("trait = 'y1'").select(*shared, F.col("z_star").alias("z1"), F.col("n_star").alias("n1"), F.col("y").alias("y1"), F.col("d").alias("d1"))
    two = rows.where("trait = 'y2'").select("idx", F.col("z_star").alias("z2"), F.col("n_star").alias("n2"), F.col("y").alias("y2"), F.col("d").alias("d2"))
    return one.join(two, "idx")


def _digits(rows: DataFrame, most: int = 6) -> DataFrame:
    fine = F.col("quantity").startswith("tau_") & ~F.col("quantity").startswith("tau_star")
    return rows.withColumns({c: F.when(fine, F.round(c, most + 4)).otherwise(F.round(c, most)) + 0.0 for c in ("estimate", "se")})


@query
def h2_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Three overlapping annotations: components, categories, enrichments and effects with jackknife errors."""
    names = ["base", "low", "promo"]
    return _digits(components.h2(_moments(spark, d, names), names, allow_negative=True), 4)


@query
def rg_partitioned(spark: SparkSession, d: str) -> DataFrame:
    """Genetic covariances and correlations by component, with jackknife errors."""
    overlap = variance.overlap_covariance(tables.samples(spark, d), "y1", "y2")
    return rounded(components.rg(_both(_moments(spark, d, ["low", "high"])), ["low", "high"], overlap), 5, "estimate", "se")


@query
def ldsc_h2(spark: SparkSession, d: str) -> DataFrame:
    """LD-score regression of two annotations, refitted without each unit."""
    return rounded(ldsc.h2(_moments(spark, d, ["low", "high"]), ["low", "high"]), 6, "estimate", "se")


@query
def ldsc_rg(spark: SparkSession, d: str) -> DataFrame:
    """Covariance LD-score regression of the two traits, refitted without each unit."""
    rows = _moments(spark, d, ["base"])
    c = variance.overlap_covariance(tables.samples(spark, d), "y1", "y2").first()["c"]
    return rounded(ldsc.rg(_both(rows), rows.where("trait = 'y1'"), rows.where("trait = 'y2'"), ["base"], c), 5, "estimate", "se")


def _f2(spark: SparkSession, d: str) -> DataFrame:
    sizes = axes.equal_units(tables.variants(spark, d), BLOCKS).groupBy("unit").agg(F.count("*").cast("double").alias("m"))
    return F.broadcast(sizes.agg((F.sum(F.col("m") * F.col("m")) / F.sum("m") ** 2).alias("f2")))


def _between_units(spark: SparkSession, d: str, dosage: DataFrame | None = None) -> DataFrame:
    """The shares of the LD of all variants that lie between jackknife units; one row."""
    axis = axes.equal_units(tables.variants(spark, d), BLOCKS).select(F.col("idx").alias("vid"), "unit")
    calls, _, _, n = _sparse(spark, d, dosage)
    return longrange.shares(longrange.carried_traces(calls, axis, BLOCKS, n, 8, 4))


@query
def long_range_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of the variants' LD lies between jackknife units, with and without everyone's pair with themselves."""
    return rounded(_between_units(spark, d), 8, "rho_self", "rho_apart", "rho_diag", "rho_off")


@query
def h2_long_range(spark: SparkSession, d: str) -> DataFrame:
    """Errors of both heritabilities corrected for the shares of LD between units."""
    rows = base.h2_single(spark, d).select("trait", F.col("estimate").alias("h2"), "se").crossJoin(_f2(spark, d)).crossJoin(F.broadcast(base._n(spark, d)))
    out = components.long_range(rows.crossJoin(F.broadcast(_between_units(spark, d))))
    return rounded(out, 6, "factor", "se_long").select("trait", "factor", "se_long")


@query
def rg_long_range(spark: SparkSession, d: str) -> DataFrame:
    """The error of the genetic covariance corrected in the same way."""
    dosage = base._dosage(spark, d)
    scores = kept(base._base_scores(spark, d, dosage), folder(spark, "scores"))
    h = rounded(variance.h2_single(base._h2_rows(spark, d, dosage, scores)), 8, "estimate", "se").agg(F.max(F.when(F.col("trait") == "y1", F.col("estimate"))).alias("h2_1"), F.max(F.when(F.col("trait") == "y2", F.col("estimate"))).alias("h2_2"))
    rows = base._rg(spark, d, dosage, scores).select("se", "rg").crossJoin(h).crossJoin(variance.overlap_covariance(tables.samples(spark, d), "y1", "y2")).crossJoin(_f2(spark, d))
    out = components.long_range_rg(rows.crossJoin(F.broadcast(_between_units(spark, d, dosage))))
    return rounded(out, 5, "factor", "se_long").select("factor", "se_long")


def _panel_samples(spark: SparkSession, d: str) -> tuple[list[float], list[float]]:
    """Environments and values of the panel's 64 samples."""
    y = [float(r["y1"]) for r in tables.samples(spark, d).where("sid between 1 and 64").orderBy("sid").select("y1").collect()]
    return [float((k + 1) % 7 - 3) for k in range(64)], y


@query
def gxe_components(spark: SparkSession, d: str) -> DataFrame:
    """Genetic, gene-environment, noise-environment and residual components over the dense panel."""
    env, y = _panel_samples(spark, d)
    rows = contexts.gxe_panel(tables.dense(spark, d).withColumn("base", F.lit(1.0)), env, y, ["base"])
    totals = contexts.gxe_totals(env, y)
    one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in totals.items()])
    return rounded(contexts.gxe_fit(contexts.gxe_equations(rows, one, ["base"]), 4), 6, "estimate", "proportion")


BASIS = ["one", "env", "case"]


def _basis(spark: SparkSession, d: str) -> DataFrame:
    return tables.samples(spark, d).select("sid", F.lit(1).alias("one"), "env", "case")


@query
def context_second(spark: SparkSession, d: str) -> DataFrame:
    return contexts.second_moments(_basis(spark, d), BASIS)


@query
def context_fourth(spark: SparkSession, d: str) -> DataFrame:
    return contexts.fourth_moments(_basis(spark, d), BASIS)


@query
def context_exposure(spark: SparkSession, d: str) -> DataFrame:
    """What distinct pairs of people expose of each pair of context features."""
    return contexts.pair_exposure(context_second(spark, d), context_fourth(spark, d), len(BASIS))


@query
def context_transfer(spark: SparkSession, d: str) -> DataFrame:
    """The exposure's Gram carried from all samples to half as many, with the smaller cohort's own same-person part."""
    own = contexts.fourth_moments(_basis(spark, d).where("sid % 2 = 0"), BASIS)
    sizes = F.broadcast(_basis(spark, d).agg(F.count("*").alias("all"), F.count_if(F.col("sid") % 2 == 0).alias("half")))  # one row
    out = contexts.transferred(context_exposure(spark, d).crossJoin(sizes), context_fourth(spark, d), F.col("all"), F.col("half"), study_same=own)
    return rounded(out, 4, "value")


@query
def mixture_effects(spark: SparkSession, d: str) -> DataFrame:
    """Effects of all variants on both traits under two mixtures of two normals, after three sweeps."""
    samples = tables.samples(spark, d)
    calls, _, _, n = _sparse(spark, d)
    side = max(blocks.SAMPLES, -(-n // max(1, spark.sparkContext.defaultParallelism)))  # no more blocks than slots
    path = mixture.carried(calls, samples.select(F.col("sid").cast("int").alias("k"), "y1", "y2"), ["y1", "y2"], n, side)
    candidates = [mixture.Candidate("sparse", 0.05, 0.2, 0.4), mixture.Candidate("even", 0.5, 0.5, 0.4)]
    return rounded(mixture.fitted(spark, path, candidates, 3)[0], 9, "beta")


@query
def quadratic_tails(spark: SparkSession, d: str) -> DataFrame:
    """Tails of three weighted chi-squares of two degrees of freedom for each sample."""
    a = 1 + F.col("nation") / 10
    rows = tables.samples(spark, d).select("sid", (F.abs("y1") / 500.0).alias("q"), F.array(a, a + 1, a + 3).alias("w"), F.array(*[F.lit(2.0)] * 3).alias("df"))
    return rounded(quadratic.with_tails(rows, "q", "w", "df").select("sid", "p"), 10, "p")


@query
def robust_interactions(spark: SparkSession, d: str) -> DataFrame:
    """Two features' effects on the first trait with the second taken out: single, joint, kernel and burden tests that allow
    for unequal variances."""
    names = ["env", "case"]
    out = robust.tests(robust.scores(tables.samples(spark, d), names, ["y1"], ["y2"]), names)
    flat = [F.col(c)[i].alias(f"{c}_{n}") for c in ("beta", "se") for i, n in enumerate(names)]
    out = out.select("trait", "n", *flat, "joint_wald", "joint_df", "joint_p", "kernel_p", "burden_z", "burden_p")
    return rounded(out, 7, "beta_env", "beta_case", "se_env", "se_case", "joint_wald", "joint_p", "kernel_p", "burden_z", "burden_p")


def _sparse(spark: SparkSession, d: str, dosage: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Carriers' dosages, the variants' annotations, the samples' covariates by number, and how many samples there are."""
    people = tables.samples(spark, d).select(F.col("sid").cast("int").alias("k"), "nation", "y2", (2 * F.col("nation") - F.col("y2")).alias("both"))
    axis = tables.variants(spark, d).select(F.col("idx").alias("vid"), F.lit(1).alias("base"), "low", "promo")
    calls = (dosage or tables.dosage(spark, d)).select(F.col("idx").alias("vid"), F.col("sid").cast("int").alias("k"), "g")
    return calls, axis, people, people.agg(F.max("k")).first()[0] + 1


def _panel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All variants' dosages in all samples as dense rows, with annotations, and the samples' covariates by number."""
    calls, axis, people, n = _sparse(spark, d)
    return blocks.densified(calls, n).join(axis, "vid"), people


def _genomewide(spark: SparkSession, d: str) -> blocks.Scores:
    calls, notes, people, n = _sparse(spark, d)
    c = basis.orthonormal(people, ["nation", "y2", "both"])
    return sparse.genomewide(calls, notes, ["base", "low", "promo"], 8, c.rows, c.rank, n, weighted=True)


@query
def ld_genomewide(spark: SparkSession, d: str) -> DataFrame:
    """LD scores of all pairs of variants in all samples by probes: covariates out, three overlapping annotations, partners
    weighed by their share of variance."""
    out = _genomewide(spark, d).scores
    return rounded(out.select("vid", "v", "l2_base", "l2_low", "l2_promo", "var_base"), 7, "v", "l2_base", "l2_low", "l2_promo", "var_base")


@query
def ld_corrections(spark: SparkSession, d: str) -> DataFrame:
    """What the same scores say of each pair of annotations."""
    return rounded(_genomewide(spark, d).corrections, 8, "r2", "mu22", "rho2", "bias", "delta")


@query
def covariate_leverage(spark: SparkSession, d: str) -> DataFrame:
    """Leverages of the samples over three covariates, one of them a combination of the others, and the constant."""
    c = basis.orthonormal(_panel(spark, d)[1], ["nation", "y2", "both"])
    return c.rows.select("k", F.lit(c.rank).alias("rank"), F.round(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x), 10).alias("leverage"))


@query
def context_same_person(spark: SparkSession, d: str) -> DataFrame:
    """Same-person sums of three kernels' diagonals, given by sample."""
    rows = _basis(spark, d).select("sid", F.posexplode(F.array(F.lit(1.0), F.col("env").cast("double"), (F.col("case") + 1).cast("double"))).alias("p", "value"))
    return contexts.same_person(rows)


@query
def response_scales(spark: SparkSession, d: str) -> DataFrame:
    """A response covariance (the context moments) with its baseline doubled and its heterogeneity halved."""
    return rounded(contexts.separate_scales(context_second(spark, d), 2.0, 0.5), 6, "value")


@query
def gwas_adjusted(spark: SparkSession, d: str) -> DataFrame:
    covariate = tables.samples(spark, d).select("sid", "env")
    return rounded(gwas.adjusted(tables.dosage(spark, d), tables.phenotypes(spark, d), covariate, ["env"], parts=tables.parts_of(spark, d)), 5, "beta_g", "se_g")


@query
def gwas_by_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """Effects of an allele in two backgrounds, fitted together."""
    parts = tables.parts_of(spark, d)
    half = tables.dealt(tables.samples(spark, d).select("sid", (F.col("nation") % 2).alias("side")), parts, "sid")
    rows = tables.dealt(tables.dosage(spark, d), parts, "sid").join(half, "sid").select("idx", "sid", (F.col("g") * (1 - F.col("side"))).alias("g0"), (F.col("g") * F.col("side")).alias("g1"))
    none = tables.samples(spark, d).select("sid")
    return rounded(gwas.adjusted(rows, tables.phenotypes(spark, d), none, [], ["g0", "g1"], parts), 3, "beta_g0", "beta_g1", "se_g0", "se_g1")


@query
def residual_variance_two(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.samples(spark, d).select("sid", "nation", "y2")
    return rounded(ldscore.residual_variance_of(tables.dosage(spark, d), rows, ["nation", "y2"]), 9, "r2", "v")


@query
def strand_flips(spark: SparkSession, d: str) -> DataFrame:
    """Whether ambiguous variants of a cohort look flipped; a third of them are."""
    rows = tables.variants(spark, d).select("idx", F.concat("a1", "a2").isin("AT", "TA", "CG", "GC").alias("ambiguous"))
    rows = rows.withColumns({"base": 0.2 + F.col("idx") % 50 / 1000, "delta": F.when(F.col("idx") % 2 == 1, 0.25).otherwise(-0.15)})
    freq = F.col("base") + F.col("delta") * 0.4 + (F.col("idx") % 7 - 3) / 100
    return rounded(gwas.strand_check(rows.withColumn("freq", F.when(F.col("ambiguous") & (F.col("idx") % 3 == 0), 1 - freq).otherwise(freq))), 9, "ancestry", "ambiguous_discordant", "other_discordant")


@query
def auc_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """The curve's area over the strata: first against last, and its trend."""
    rows = base.auc_delong(spark, d).withColumn("turn", F.substring("stratum", 1, 1).cast("int"))
    return rounded(ranks.auc_contrasts(rows, "turn"), 6, "diff", "diff_z", "trend", "trend_z")


@query
def ld_curve_smooth(spark: SparkSession, d: str) -> DataFrame:
    rows = base.ld_curve_cells(spark, d).withColumn("panel", F.lit(1))
    return rounded(segments.smoothed(rows, "panel", "cell", "mean_r2", 1.5), 9, "smooth").select("cell", "smooth")


@query
def box_cox(spark: SparkSession, d: str) -> DataFrame:
    """The transform of the order totals and its derivatives by the power, at 1/2."""
    rows = tables.read(spark, d, "orders").select("o_orderkey", (F.log("o_totalprice") - 10).alias("t"))
    values = transforms.box_cox_derivatives(F.col("t"), 0.5, 2)
    return rows.select("o_orderkey", *[(F.round(v, 8) + 0.0).alias(f"b{k}") for k, v in enumerate(values)])


@query
def standardised_values(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.samples(spark, d).select("sid", "segment", "y1", "y2")
    return rounded(transforms.standardised(rows, ["y1", "y2"], ["segment"]), 8, "y1", "y2")


@query
def context_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.samples(spark, d).select("sid", "env", "case")
    return transforms.contexts(rows, {"one": [], "env2": [("env", 2)], "env_case": [("env", 1), ("case", 1)]}).withColumn("env_case", F.col("env_case") + 0.0)


# --- readers -------------------------------------------------------------------------------------------------------


def _put(rows: DataFrame, name: str, header: bool = True, sep: str = "\t", ordered: bool = False) -> str:
    """Writes a text file of the shared folder; null is NA. Only where lines have an order is it a single part, as one task
    would make all rows of it."""
    path = f"{checkpointed(rows.sparkSession).rstrip('/')}/texts/{name}-{uuid.uuid4().hex}"
    (rows.coalesce(1) if ordered else rows).write.csv(path, sep=sep, header=header, nullValue="NA")
    return path


def _put_lines(rows: DataFrame, name: str, head: str) -> str:
    """The same with a header that a table of quoted values can't have."""
    path = f"{checkpointed(rows.sparkSession).rstrip('/')}/texts/{name}-{uuid.uuid4().hex}"
    first = rows.sparkSession.createDataFrame([(head,)], "value string").coalesce(1)
    # the lines are made by many tasks; a single one copies them below the header
    lines = kept(rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value")), f"{path}-lines")
    first.unionAll(lines).coalesce(1).write.text(path)
    return path


def _people(spark: SparkSession, d: str) -> DataFrame:
    return tables.samples(spark, d).select(F.concat(F.lit("f"), F.col("nation")).alias("fid"), F.concat(F.lit("i"), F.col("sid")).alias("iid"), "sid", "env", "y1", "y2", "segment")


@query
def read_bim(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.variants(spark, d).orderBy("pos").select("chr", "snp", F.lit("0.5").alias("cm"), "bp", "a1", "a2")
    return files.bim(spark, _put(rows, "bim", False, ordered=True))


@query
def read_fam(spark: SparkSession, d: str) -> DataFrame:
    rows = _people(spark, d).orderBy("sid").select("fid", "iid", F.lit("0").alias("father"), F.lit("0").alias("mother"), (F.col("sid") % 2 + 1).alias("sex"), F.lit("-9").alias("pheno"))
    return files.fam(spark, _put(rows, "fam", False, " ", ordered=True))


@query
def read_pvar(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.variants(spark, d).select(F.concat(F.lit("chr"), F.col("chr")).alias("chr"), "bp", "snp", "a2", "a1")
    return files.pvar(spark, _put_lines(rows, "pvar", "#CHROM\tPOS\tID\tREF\tALT"))


@query
def read_psam(spark: SparkSession, d: str) -> DataFrame:
    return files.psam(spark, _put_lines(_people(spark, d).select("fid", "iid"), "psam", "#FID\tIID"))


@query
def read_pairs(spark: SparkSession, d: str) -> DataFrame:
    both = base._pairs(spark, d).select(F.concat(F.lit("i"), F.col("a")).alias("IID1"), F.concat(F.lit("i"), F.col("b")).alias("IID2"), (F.col("a") % 50 / 100).alias("KINSHIP"))
    return files.pairs(spark, _put(both.unionAll(both.select(F.col("IID2").alias("IID1"), F.col("IID1").alias("IID2"), "KINSHIP")), "pairs"), 0.05)


@query
def read_bed(spark: SparkSession, d: str) -> DataFrame:
    """Calls written in two bits and read again, by variant."""
    rows = tables.dense(spark, d).select(F.col("vid").alias("idx"), F.transform("e", lambda x: (F.pmod(x, F.lit(4)) - 1).cast("tinyint")).alias("calls"))
    path = f"{checkpointed(spark).rstrip('/')}/texts/bed-{uuid.uuid4().hex}.bed"
    files.write_bed(rows, path)
    got = files.bed(spark, path, 64)
    return got.select("idx", F.aggregate("calls", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size(F.filter("calls", lambda x: x < 0)).alias("missing"))


@query
def read_pgen(spark: SparkSession, d: str) -> DataFrame:
    """Dosages written as a variable-width file; every second sample is read again, in blocks of variants."""
    value = lambda x: F.when(F.pmod(x, F.lit(5)) == 0, F.lit(None)).when(F.pmod(x, F.lit(5)) < 4, F.pmod(x, F.lit(3)).cast("double")).otherwise(F.pmod(x, F.lit(257)) / 128)
    rows = tables.dense(spark, d).select(F.col("vid").alias("idx"), F.transform("e", value).alias("dosages"))
    path = f"{checkpointed(spark).rstrip('/')}/texts/pgen-{uuid.uuid4().hex}.pgen"
    genotypes.write_pgen(rows, path)
    got = genotypes.read(spark, path, samples=list(range(0, 64, 2)), block=64).where("idx >= 10")
    return got.select("idx", F.aggregate("dosages", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))).alias("total"), F.size(F.filter("dosages", lambda x: x.isNull())).alias("missing"))


@query
def read_ld_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.variants(spark, d).withColumns({"l2_base": F.col("price") / 1000, "l2_low": F.col("idx") % 8 / 8})
    path = f"{checkpointed(spark).rstrip('/')}/texts/ld-{uuid.uuid4().hex}"
    files.write_ld_scores(rows.select("chr", "snp", "bp", "l2_base", "l2_low"), path)
    return rounded(files.ld_scores(spark, path), 3, "l2_base", "l2_low")


@query
def read_sumstats(spark: SparkSession, d: str) -> DataFrame:
    rows = base.gwas_ols(spark, d).where("trait = 'y1'").select(F.concat(F.lit("rs"), F.col("idx")).alias("RSID"), F.col("n").alias("OBS_CT"), "BETA", F.when(F.col("idx") % 13 > 0, F.col("se")).alias("SE"))
    return rounded(files.sumstats(spark, _put(rows, "sumstats"), "y1").select("trait", "snp", "n", "beta", "se"), 6, "beta", "se")


@query
def read_phenotypes(spark: SparkSession, d: str) -> DataFrame:
    rows = _people(spark, d).select(F.col("fid").alias("FID"), F.col("iid").alias("IID"), F.when(F.col("sid") % 7 > 0, F.col("y1").cast("string")).otherwise("-9.0").alias("a"), F.when(F.col("sid") % 5 > 0, F.col("y2")).alias("b"))
    return inputs.phenotypes(spark, _put(rows, "pheno"))


@query
def read_covariates(spark: SparkSession, d: str) -> DataFrame:
    people = _people(spark, d)
    rows = people.select(F.col("fid").alias("FID"), F.col("iid").alias("IID"), F.when(F.col("sid") % 11 > 0, F.col("env")).alias("env"), F.lit(3).alias("same"), "segment")
    out = inputs.covariates(spark, _put(rows, "cov"), people.select("fid", "iid"), categorical=["segment"])
    return rounded(out, 7, *out.columns[2:])


@query
def read_environment(spark: SparkSession, d: str) -> DataFrame:
    people = _people(spark, d)
    return inputs.environment(spark, _put(people.select(F.col("fid").alias("FID"), F.col("iid").alias("IID"), F.when(F.col("sid") % 9 > 0, F.col("env")).alias("E")), "env"), people.where("sid % 2 = 0"))


@query
def read_kmoments(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.variants(spark, d).agg(F.count("*").alias("nsnps"), F.lit(3).alias("proj_rank"), F.sum("low").alias("t0_rank"), F.sum("high").alias("t1_rank"), F.sum("promo").alias("t2_rank"))
    return inputs.kmoments(spark, _put(rows, "kmoments", sep=" ", ordered=True))


@query
def read_annotation_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.variants(spark, d).agg(F.count("*").alias("base"), F.sum("low").alias("low"), F.sum("promo").alias("promo"))
    return inputs.annotation_sizes(spark, _put(rows, "m", False, ordered=True), 3)


@query
def read_weight_scores(spark: SparkSession, d: str) -> DataFrame:
    axis = tables.variants(spark, d)
    rows = axis.select(F.col("chr").alias("CHR"), F.col("snp").alias("SNP"), F.col("bp").alias("BP"), (F.col("price") / 100).alias("L2"))
    return rounded(inputs.weight_scores(spark, _put(rows, "weights"), axis.where("idx % 3 = 0")), 4, "w")


@query
def read_thin_annotations(spark: SparkSession, d: str) -> DataFrame:
    axis = tables.variants(spark, d)
    rows = axis.orderBy("pos").select(F.col("high").alias("first"), F.col("promo").alias("second"))
    return inputs.thin_annotations(spark, _put(rows, "thin", sep=" ", ordered=True), axis.select("idx", "pos"))


@query
def read_annotation_classes(spark: SparkSession, d: str) -> DataFrame:
    axis = tables.variants(spark, d)
    rows = axis.where("idx % 4 > 0").select(F.col("snp").alias("SNP"), F.col("bp").alias("BP"), F.col("low").alias("a"), F.col("high").alias("b"))
    return inputs.annotation_classes(spark, _put(rows, "classes"), axis.select("snp", "idx"))


@query
def read_population_scale(spark: SparkSession, d: str) -> DataFrame:
    axis = tables.variants(spark, d)
    rows = axis.select(F.col("snp").alias("SNP"), F.col("a1").alias("A1"), F.col("a2").alias("A2"), (F.col("idx") % 10 / 10).alias("MEAN"), F.lit(1.25).alias("INV_SD"))
    return inputs.population_scale(spark, _put(rows, "scale"), axis)


@query
def read_rg_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "nation").where("n_nationkey < 5").orderBy("n_nationkey").select(F.col("n_name").alias("phen1"), F.lit("other").alias("phen2"), F.concat(F.lit("/a/"), "n_nationkey").alias("sumstats1"), F.lit("/b").alias("sumstats2"), (F.col("n_nationkey") / 100).alias("intercept_rg"), F.col("n_regionkey").alias("cov_rank1"))
    return inputs.rg_manifest(spark, _put(rows, "manifest", ordered=True))


QUERIES = base.QUERIES
