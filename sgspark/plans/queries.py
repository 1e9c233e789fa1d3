"""Named queries over the star-schema tables: each applies an operator with fixed parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sgspark.operators import axes, gwas, ldscore, ranks, relatives, segments, solve, traits, variance
from sgspark.sources import tables
from sgspark.sources.shared import folder, kept
from sgspark.streaming import units as streaming

WIDTH, BLOCKS, PROBES = 20, 20, 16

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _n(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "customer").agg(F.count("*").alias("n"))


def _dosage(spark: SparkSession, d: str) -> DataFrame:
    """The dosages as a table of the shared folder, for queries that read them several times."""
    return kept(tables.dosage(spark, d), folder(spark, "dosage"))


def _stats(spark: SparkSession, d: str, dosage: DataFrame | None = None) -> DataFrame:
    return gwas.ols(dosage or tables.dosage(spark, d), tables.phenotypes(spark, d))


def _messy(spark: SparkSession, d: str) -> DataFrame:
    """Summary statistics with varying n, repeated variants and unusable rows."""
    s = _stats(spark, d)
    one = s.select("trait", "idx", F.col("idx").alias("line"), (F.col("n") - F.col("idx") % 7).alias("n"), "beta", F.when(F.col("idx") % 13 == 0, 0.0).otherwise(F.col("se")).alias("se"))
    two = s.where("idx % 10 = 0").select("trait", "idx", (F.col("idx") + 1000000).alias("line"), (F.col("n") - F.col("idx") % 3 * 5).alias("n"), (-F.col("beta")).alias("beta"), "se")
    return one.unionByName(two)


def _base_scores(spark: SparkSession, d: str, dosage: DataFrame | None = None) -> DataFrame:
    axis, dosage = tables.variants(spark, d), dosage or _dosage(spark, d)
    notes = axis.select("idx", F.lit(1).alias("base"), "low", "high")
    return ldscore.window_scores(axis, dosage, gwas.variant_sums(dosage), _n(spark, d), WIDTH, notes, ["base", "low", "high"], tables.parts_of(spark, d))


def _h2_rows(spark: SparkSession, d: str, dosage: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    axis = axes.equal_units(tables.variants(spark, d), BLOCKS).select("idx", "unit", "chr", F.lit(1).alias("base"), "low", "high")
    dosage = dosage or _dosage(spark, d)
    return gwas.score_moments(_stats(spark, d, dosage)).join(axis, "idx").join(scores or _base_scores(spark, d, dosage), "idx")


@query
def h2_single(spark: SparkSession, d: str) -> DataFrame:
    """Heritability of both traits from windowed LD scores, with 20-block jackknife."""
    return rounded(variance.h2_single(_h2_rows(spark, d)), 8, "estimate", "se")


@query
def v_variants(spark: SparkSession, d: str) -> DataFrame:
    return tables.variants(spark, d)


@query
def v_dosage(spark: SparkSession, d: str) -> DataFrame:
    return tables.dosage(spark, d)


@query
def gwas_ols(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_stats(spark, d), 9, "beta", "se")


@query
def chisq_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _stats(spark, d).withColumn("z", F.col("beta") / F.col("se"))
    return rounded(gwas.chisq_summary(rows), 7, "mean", "median", "max", "lambda_gc", "p90", "p99", "p999")


@query
def top_chisq(spark: SparkSession, d: str) -> DataFrame:
    rows = _stats(spark, d).withColumn("z", F.col("beta") / F.col("se"))
    return gwas.top(rows, 10).select("trait", "rank", "idx", F.round("chisq", 6).alias("chisq"))


@query
def jack_units(spark: SparkSession, d: str) -> DataFrame:
    axis = axes.equal_units(tables.variants(spark, d), 23)
    return axis.groupBy("unit").agg(F.count("*").alias("size"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query
def jack_mass_units(spark: SparkSession, d: str) -> DataFrame:
    axis = axes.mass_units(tables.variants(spark, d), "price", 23)
    return axis.groupBy("unit").agg(F.count("*").alias("size"), F.sum("price").alias("mass"), F.min("pos").alias("first"))


@query
def jack_delete2(spark: SparkSession, d: str) -> DataFrame:
    """Sizes left in each delete-two replicate."""
    units = axes.equal_units(tables.variants(spark, d), 12).groupBy("unit").agg(F.count("*").alias("m"))
    total = F.broadcast(units.agg(F.sum("m").alias("t")))
    return axes.delete_sets(units, 2).join(units, "unit").groupBy("rep").agg(F.sum("m").alias("left_out")).crossJoin(total).select("rep", "left_out", (F.col("t") - F.col("left_out")).alias("kept"))


@query
def sumstats_qc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gwas.qc(_messy(spark, d), "idx"), 7, "beta", "se", "z")


@query
def exact_moments(spark: SparkSession, d: str) -> DataFrame:
    rows = gwas.score_moments(gwas.qc(_messy(spark, d), "idx"), 3)
    return rounded(rows.select("trait", "idx", "z_star", "d", "y"), 7, "z_star", "d", "y")


@query
def align_left(spark: SparkSession, d: str) -> DataFrame:
    """Every variant with its row of summary statistics, if any."""
    ref = tables.variants(spark, d).select("idx", "snp", "pos")
    rows = gwas.qc(_messy(spark, d), "idx").where("trait = 'y1'").select("idx", "line", "n")
    return ref.join(rows, "idx", "left").select("idx", "snp", "pos", "line", F.col("line").isNotNull().alias("matched"))


@query
def coord_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Variants whose coordinates differ between two sources, by chromosome."""
    ref = tables.variants(spark, d).select("snp", "chr", "bp")
    other = ref.select("snp", F.col("chr").alias("chr2"), (F.col("bp") + F.when(F.col("bp") % 11000 == 0, 1).otherwise(0)).alias("bp2"))
    return ref.join(other, "snp").where("chr <> chr2 or bp <> bp2").groupBy("chr").agg(F.count("*").alias("n"), F.min("bp").alias("first"))


def _flipped(axis: DataFrame) -> DataFrame:
    """A second source: alleles as they are, swapped, on the other strand, or both, by idx % 4."""
    comp = lambda c: F.translate(c, "ACGT", "TGCA")
    k = F.col("idx") % 4
    b1 = F.when(k == 0, F.col("a1")).when(k == 1, F.col("a2")).when(k == 2, comp(F.col("a1"))).otherwise(comp(F.col("a2")))
    b2 = F.when(k == 0, F.col("a2")).when(k == 1, F.col("a1")).when(k == 2, comp(F.col("a2"))).otherwise(comp(F.col("a1")))
    return axis.withColumns({"b1": b1, "b2": b2})


@query
def allele_harmonize(spark: SparkSession, d: str) -> DataFrame:
    rows = _flipped(tables.variants(spark, d))
    strict = gwas.harmonised(rows, "a1", "a2", "b1", "b2")
    loose = gwas.harmonised(rows, "a1", "a2", "b1", "b2", False).select("idx", F.col("keep").alias("keep_all"), F.col("flip").alias("flip_all"))
    return strict.join(loose, "idx").select("idx", "a1", "a2", "b1", "b2", "keep", "flip", "keep_all", "flip_all")


@query
def match_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variants of two sources by position; positions that repeat in the target are left out."""
    rows = _flipped(tables.variants(spark, d)).select("idx", "chr", "bp", "b1", "b2")
    twice = rows.unionByName(rows.where("idx % 9 = 0"))
    out = gwas.matched(twice.withColumnsRenamed({"b1": "a1", "b2": "a2"}), tables.variants(spark, d))
    return out.select("idx", "chr", "bp", "keep", "flip")


@query
def chisq_filter_clip(spark: SparkSession, d: str) -> DataFrame:
    """Rows above a threshold of 6: dropped under one action, clipped under the other."""
    rows = _stats(spark, d).withColumn("chisq", (F.col("beta") / F.col("se")) ** 2)
    out = rows.groupBy("trait").agg(F.count("*").alias("n"), F.sum((F.col("chisq") <= 6).cast("long")).alias("kept"), F.sum(F.least(F.col("chisq"), F.lit(6.0))).alias("clipped"), gwas.chisq_threshold(F.max("n")).alias("auto"))
    return rounded(out, 6, "clipped", "auto")


@query
def maf(spark: SparkSession, d: str) -> DataFrame:
    rows = gwas.variant_sums(tables.dosage(spark, d)).crossJoin(F.broadcast(_n(spark, d)))
    p = F.col("sg").cast("double") / (2 * F.col("n"))
    return rows.select("idx", "carriers", F.round(F.least(p, 1 - p), 10).alias("maf"))


@query
def m_5_50(spark: SparkSession, d: str) -> DataFrame:
    """Annotation masses, over all variants and over the more common half."""
    rows = tables.variants(spark, d).join(maf(spark, d), "idx")
    cut = F.broadcast(rows.agg(F.percentile("maf", F.lit(0.5)).alias("cut")))
    long = rows.crossJoin(cut).selectExpr("maf", "cut", "stack(4, 'base', 1, 'low', low, 'high', high, 'promo', promo) as (annot, a)")
    return long.groupBy("annot").agg(F.sum("a").cast("long").alias("m"), F.sum(F.when(F.col("maf") > F.col("cut"), F.col("a")).otherwise(0)).cast("long").alias("m_common"))


@query
def ld_window_r2(spark: SparkSession, d: str) -> DataFrame:
    dosage = tables.dosage(spark, d)
    rows = ldscore.window_r2(tables.variants(spark, d), dosage, gwas.variant_sums(dosage), _n(spark, d), 5, tables.parts_of(spark, d))
    return rounded(rows, 10, "r2", "adj")


@query
def ld_score_window(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_base_scores(spark, d), 8, "l2_base", "l2_low", "l2_high")


@query
def ld_score_allpairs(spark: SparkSession, d: str) -> DataFrame:
    """Exact LD scores of the dense panel against all of it, corrected for sample size."""
    raw = ldscore.gram_scores(tables.dense(spark, d))
    m = F.broadcast(raw.agg(F.count("*").alias("m")))
    return raw.crossJoin(m).select("vid", F.round(F.col("raw") - (F.col("m") - F.col("raw")) / (F.col("n") - 2), 6).alias("l2"))


@query
def ld_sketch_variance(spark: SparkSession, d: str) -> DataFrame:
    """Sketched LD scores by sign probes and their Monte Carlo variance, as shares of the largest."""
    out = ldscore.probe_variance(ldscore.sketch(tables.dense(spark, d), PROBES))
    top = F.broadcast(out.agg(F.max("mean").alias("t")))
    return out.crossJoin(top).select("vid", "probes", F.round(F.col("mean") / F.col("t"), 8).alias("mean"), F.round(F.col("variance") / F.col("t") ** 2, 8).alias("variance"))


@query
def residual_variance_v(spark: SparkSession, d: str) -> DataFrame:
    covariate = tables.samples(spark, d).select("sid", F.col("nation").alias("c"))
    return rounded(ldscore.residual_variance(tables.dosage(spark, d), covariate), 10, "r2", "v")


@query
def h2_partitioned(spark: SparkSession, d: str) -> DataFrame:
    out = variance.h2_pair(_h2_rows(spark, d), "low", "high")
    return rounded(out, 6, "sigma_1", "sigma_2", "total", "enrichment_1", "enrichment_2")


@query
def h2_chr_jackknife(spark: SparkSession, d: str) -> DataFrame:
    """The same with chromosomes as the units."""
    return rounded(variance.h2_single(_h2_rows(spark, d).withColumn("unit", F.col("chr"))), 8, "estimate", "se")


@query
def ldsc_irwls(spark: SparkSession, d: str) -> DataFrame:
    return rounded(variance.ldsc(_h2_rows(spark, d)), 7, "h2")


@query
def overlap_cov(spark: SparkSession, d: str) -> DataFrame:
    return rounded(variance.overlap_covariance(tables.samples(spark, d), "y1", "y2"), 10, "c")


def _rg(spark: SparkSession, d: str, dosage: DataFrame, scores: DataFrame) -> DataFrame:
    rows = variance.rg_rows(gwas.score_moments(_stats(spark, d, dosage)), "y1", "y2")
    axis = axes.equal_units(tables.variants(spark, d), BLOCKS).select("idx", "unit")
    rows = rows.join(axis, "idx").join(scores, "idx")
    return rounded(variance.rg_single(rows, variance.overlap_covariance(tables.samples(spark, d), "y1", "y2").select("c")), 7, "covariance", "se", "rg")


@query
def rg_supplied_c(spark: SparkSession, d: str) -> DataFrame:
    dosage = _dosage(spark, d)
    return _rg(spark, d, dosage, _base_scores(spark, d, dosage))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring samples of one nation, as related pairs."""
    s = tables.samples(spark, d).select(F.col("sid").alias("a"), F.col("nation").alias("na"))
    t = s.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("na").alias("nb"))
    return s.join(t, "a").where("na = nb").select("a", "b")


@query
def family_components(spark: SparkSession, d: str) -> DataFrame:
    return relatives.families(_pairs(spark, d))


@query
def pair_closure(spark: SparkSession, d: str) -> DataFrame:
    return relatives.closure(relatives.families(_pairs(spark, d)))


@query
def rel_m_per_snp(spark: SparkSession, d: str) -> DataFrame:
    out = relatives.pair_moments(tables.dosage(spark, d), _pairs(spark, d), tables.samples(spark, d).select("sid", F.col("y1").alias("y")), _n(spark, d))
    return rounded(out, 8, "rel_m")


@query
def sib_centering(spark: SparkSession, d: str) -> DataFrame:
    fam = relatives.families(_pairs(spark, d)).select(F.col("id").alias("sid"), "family")
    rows = tables.samples(spark, d).join(fam, "sid")
    return rounded(relatives.centred(rows, "family", ["y1", "env"]), 8, "y1_centred", "env_centred")


@query
def env_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(traits.environment_moments(tables.samples(spark, d), "env", "y1"), 6, "m2", "m4", "cov")


@query
def gxe_scores(spark: SparkSession, d: str) -> DataFrame:
    return traits.interaction_scores(tables.dosage(spark, d), tables.samples(spark, d), "env", "y1")


#: Microseconds of a timestamp without a time zone.
_MICROS_SQL = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS timestamp_ntz))"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    calls = tables.read(spark, d, "events").select("user_id", "event_id", F.expr(_MICROS_SQL).alias("t"), "event_type")
    return segments.runs(calls, "user_id", ["t", "event_id"], "t", "event_type")


@query
def segments_from_runs(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


@query
def global_ancestry(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.shares(_segments(spark, d), "user_id", "code"), 9, "share")


@query
def asof_segment(spark: SparkSession, d: str) -> DataFrame:
    """For each purchase the user's last view before or at it."""
    events = tables.read(spark, d, "events").select("user_id", "event_id", F.expr(_MICROS_SQL).alias("t"), "event_type")
    low, high = events.agg(F.min("event_type").alias("lo")), events.agg(F.max("event_type").alias("hi"))
    points = events.join(F.broadcast(low), F.col("event_type") == F.col("lo")).select("user_id", "event_id", "t")
    seen = events.join(F.broadcast(high), F.col("event_type") == F.col("hi")).groupBy("user_id", "t").agg(F.max("event_id").alias("ref"))
    return segments.as_of(points, seen, "user_id", "t", "t", "ref")


@query
def genetic_map_interp(spark: SparkSession, d: str) -> DataFrame:
    """Map positions of all variants from the map's knots at every seventh."""
    axis = tables.variants(spark, d).select("idx", "chr", F.col("bp").cast("double").alias("bp"), F.lit(None).cast("double").alias("spare")).drop("spare")
    knots = axis.where("idx % 7 = 3").select("chr", "bp", (F.col("bp") / 1e6 * 1.3 + F.sqrt("bp") / 1e3).alias("cm"))
    return rounded(segments.interpolated(axis, knots, "chr", "bp", "cm"), 8, "cm")


@query
def marker_grid(spark: SparkSession, d: str) -> DataFrame:
    return segments.grid(tables.variants(spark, d), 2500)


@query
def merge_interleave(spark: SparkSession, d: str) -> DataFrame:
    axis = tables.variants(spark, d)
    return segments.interleaved(axis, segments.grid(axis, 2500))


@query
def ld_curve_cells(spark: SparkSession, d: str) -> DataFrame:
    axis, dosage = tables.variants(spark, d), tables.dosage(spark, d)
    pairs = ldscore.window_r2(axis, dosage, gwas.variant_sums(dosage), _n(spark, d), 10, tables.parts_of(spark, d)).where("i < j")
    pos = axis.select("idx", "pos")
    pairs = pairs.join(pos.withColumnsRenamed({"idx": "i", "pos": "pi"}), "i").join(pos.withColumnsRenamed({"idx": "j", "pos": "pj"}), "j")
    return rounded(segments.distance_cells(pairs, 2), 9, "mean_r2")


@query
def pair_tests(spark: SparkSession, d: str) -> DataFrame:
    """Interaction scores of neighbouring variants."""
    axis = tables.variants(spark, d)
    near = ldscore.band_pairs(axis, 3).where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"))
    out = traits.pair_features(tables.dosage(spark, d), near, tables.samples(spark, d), "y1")
    return rounded(out, 6, "score", "information", "z", "p")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("stratum"), F.floor("o_totalprice").cast("long").alias("value"), (F.col("o_orderstatus") == "F").cast("long").alias("case"))


@query
def blom_ranks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranks.blom(_orders(spark, d), "value", ["stratum"]), 7, "z").select("o_orderkey", "stratum", "rank", "n", "z")


@query
def rank_bins(spark: SparkSession, d: str) -> DataFrame:
    return ranks.rank_bins(_orders(spark, d), "value", ["stratum"], 8).select("o_orderkey", "stratum", "bin")


@query
def auc_delong(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranks.auc(_orders(spark, d), "value", "case", ["stratum"]), 8, "auc", "se")


@query
def class_kernels(spark: SparkSession, d: str) -> DataFrame:
    """U-statistic of the classes' mean vectors of the dense panel."""
    panel = tables.dense(spark, d).select("label", F.posexplode("e").alias("a", "x"))
    means = panel.groupBy("label", "a").agg(F.sum("x").alias("x"))
    left, right = means.select("a", F.col("label").alias("p"), F.col("x").alias("u")), means.select("a", F.col("label").alias("q"), F.col("x").alias("v"))
    kernel = left.join(right, "a").where("p <> q").groupBy(F.col("p").alias("a"), F.col("q").alias("b")).agg((F.sum(F.col("u") * F.col("v")).cast("double") / 1e6).alias("t"))
    return rounded(traits.u_statistics(kernel), 3, "theta", "variance", "null_variance")


@query
def risk_z_d(spark: SparkSession, d: str) -> DataFrame:
    return rounded(traits.risk_table(tables.samples(spark, d), "case", 0.1), 6, "share", "spread", "d", "pair_factor")


@query
def pcgc_scores(spark: SparkSession, d: str) -> DataFrame:
    return traits.binary_scores(tables.dosage(spark, d), tables.samples(spark, d), "case")


def _score(spark: SparkSession, d: str) -> DataFrame:
    dosage = tables.dosage(spark, d)
    axis = _flipped(tables.variants(spark, d))
    model = axis.select("idx", F.col("b1").alias("a1"), F.col("b2").alias("a2"), ((F.col("idx") % 5 - 2).cast("double") / 100).alias("w"))
    weights = traits.aligned_weights(model, axis).join(traits.scale(gwas.variant_sums(dosage), _n(spark, d)), "idx")
    return traits.polygenic_scores(dosage, weights, tables.samples(spark, d))


@query
def pgs_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_score(spark, d), 8, "score")


@query
def ridge_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Five-fold calibration of a score on whole numbers, and its gain over each fold's mean."""
    rows = tables.samples(spark, d).select("sid", F.col("y2").alias("x"), F.col("y1").alias("y"))
    out = traits.calibrated(traits.folds(rows, "sid", 5), "x", "y", 0.1)
    return rounded(out, 6, "pred").select("sid", "fold", "pred")


@query
def r2_gain(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.samples(spark, d).select("sid", F.col("y2").alias("x"), F.col("y1").alias("y"))
    out = traits.calibrated(traits.folds(rows, "sid", 5), "x", "y", 0.1)
    mean = F.broadcast(rows.agg(F.avg("y").alias("base")))
    return rounded(traits.r2_gain(out.crossJoin(mean), "y", "base", "pred"), 8, "gain", "se")


@query
def h2_tau_star(spark: SparkSession, d: str) -> DataFrame:
    out = variance.h2_tau(_h2_rows(spark, d), "low", "high")
    return rounded(out, 8, "tau_1", "tau_2", "tau_star_1", "tau_star_2")


@query
def trace_symmetrised(spark: SparkSession, d: str) -> DataFrame:
    return rounded(variance.symmetrised_trace(_h2_rows(spark, d), "low", "high"), 5, "t12", "t21", "w", "t")


@query
def h2_delete_two(spark: SparkSession, d: str) -> DataFrame:
    return rounded(variance.h2_delete_two(_h2_rows(spark, d)), 8, "estimate", "se")


@query
def h2_rel_m(spark: SparkSession, d: str) -> DataFrame:
    """Heritability of the first trait after related pairs' share is taken off the moments."""
    pairs = relatives.pair_moments(tables.dosage(spark, d), _pairs(spark, d), tables.samples(spark, d).select("sid", F.col("y1").alias("y")), _n(spark, d))
    norm = F.broadcast(tables.samples(spark, d).agg(F.sum(F.col("y1") * F.col("y1")).cast("double").alias("yy")))
    share = pairs.crossJoin(norm).select("idx", (F.col("rel_m") / F.col("yy")).alias("share"))
    rows = _h2_rows(spark, d).where("trait = 'y1'").join(share, "idx", "left").withColumn("y", F.col("y") - F.coalesce("share", F.lit(0.0)))
    return rounded(variance.h2_single(rows), 8, "estimate", "se")


@query
def h2_v_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Heritability with annotations weighted by the variance that a covariate leaves."""
    axis, dosage = tables.variants(spark, d), _dosage(spark, d)
    v = ldscore.residual_variance(dosage, tables.samples(spark, d).select("sid", F.col("nation").alias("c"))).select("idx", "v")
    v = kept(v, folder(spark, "v"))
    l2 = ldscore.window_scores(axis, dosage, gwas.variant_sums(dosage), _n(spark, d), WIDTH, v, ["v"], tables.parts_of(spark, d))
    units = axes.equal_units(axis, BLOCKS).select("idx", "unit")
    rows = gwas.score_moments(_stats(spark, d, dosage)).join(units, "idx").join(v, "idx").join(l2, "idx")
    return rounded(variance.h2_single(rows, "v"), 7, "estimate", "se")


@query
def pcgc_fit(spark: SparkSession, d: str) -> DataFrame:
    """Liability variance of the binary trait at a prevalence of 0.1."""
    dosage, samples = tables.dosage(spark, d), tables.samples(spark, d)
    scale = traits.scale(gwas.variant_sums(dosage), _n(spark, d))
    risk = traits.risk_table(samples, "case", 0.1).select("n", "d")
    out = traits.pcgc(traits.binary_sums(dosage, samples, "case"), scale, _base_scores(spark, d).select("idx", "l2_base"), risk)
    return rounded(out, 6, "b", "h", "estimate")


@query
def combine_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Interaction scores of two independent cohorts, combined."""
    near = ldscore.band_pairs(tables.variants(spark, d), 3).where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"))
    dosage, samples = tables.dosage(spark, d), tables.samples(spark, d)
    one, two = (traits.pair_features(dosage, near, samples.where(F.col("sid") % 2 == k), "y1") for k in (0, 1))
    return rounded(traits.combined_pairs(one.unionByName(two)), 6, "score", "information", "z", "p")


@query
def hc3_wald(spark: SparkSession, d: str) -> DataFrame:
    return rounded(traits.hc3(_orders(spark, d), "case", "value", ["stratum"]), 5, "slope", "se", "z")


@query
def background_axis(spark: SparkSession, d: str) -> DataFrame:
    rows = traits.background_blocks(tables.variants(spark, d), 60)
    return rows.groupBy("chr", "block").agg(F.count("*").alias("size"), F.min("pos").alias("first"))


@query
def maf_ld_partition(spark: SparkSession, d: str) -> DataFrame:
    rows = maf(spark, d).join(_base_scores(spark, d), "idx").withColumn("l2", F.round("l2_base", 8))
    out = traits.crossed_bins(rows, "maf", "l2", [0.005, 0.01, 0.02], [0.9, 1.0, 1.1])
    return out.groupBy("bin").agg(F.count("*").alias("variants"), F.sum("carriers").alias("carriers"))


@query
def ld_decay_fit(spark: SparkSession, d: str) -> DataFrame:
    """An exponential through the curve of mean r2 by distance."""
    out = segments.exponential_fit(ld_curve_cells(spark, d), "cell", "mean_r2", [k / 20 for k in range(1, 61)])
    return rounded(out, 9, "a", "h").select("rate", "a", "h")


@query
def rg_intercept(spark: SparkSession, d: str) -> DataFrame:
    rows = variance.rg_rows(gwas.score_moments(_stats(spark, d)), "y1", "y2").join(_base_scores(spark, d), "idx")
    return rounded(variance.overlap_intercept(rows.withColumn("y", F.col("z1") * F.col("z2"))), 7, "c")


@query
def pgs_solve(spark: SparkSession, d: str) -> DataFrame:
    """Best linear predictors of the first trait by conjugate gradients on the genetic kernel, to a relative residual of
    1e-10, which the six digits given need."""
    dosage = _dosage(spark, d)
    scale = traits.scale(gwas.variant_sums(dosage), _n(spark, d))
    samples = tables.samples(spark, d)
    mean = F.broadcast(samples.agg(F.avg("y1").alias("m")))
    y = samples.crossJoin(mean).select("sid", ((F.col("y1") - F.col("m")) / 1000).alias("y"))
    return rounded(solve.conjugate_gradients(dosage, scale, y, 1.0, tolerance=1e-10, parts=tables.parts_of(spark, d)), 6, "u")


@query
def setops_samples(spark: SparkSession, d: str) -> DataFrame:
    """Two cohorts' shared, own and all samples."""
    s = tables.samples(spark, d)
    one, two = s.where("y2 > 0").select("sid"), s.where("nation < 15").select("sid")
    count = lambda df, name: df.agg(F.count("*").alias("n"), F.sum("sid").alias("ids")).withColumn("part", F.lit(name))
    return count(one.intersect(two), "both").union(count(one.exceptAll(two), "first")).union(count(two.exceptAll(one), "second")).union(count(one.union(two).distinct(), "any"))


@query
def rollup_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Masses by chromosome and class, rolled up."""
    rows = tables.variants(spark, d)
    return rows.rollup("chr", "brand").agg(F.count("*").alias("m"), F.sum("price").alias("mass"))


@query
def trait_order(spark: SparkSession, d: str) -> DataFrame:
    """Samples on one axis for all traits, and how many of each trait's values rank above the trait's median."""
    middle = tables.phenotypes(spark, d).groupBy("trait").agg(F.percentile("y", F.lit(0.5)).alias("middle"))
    rows = tables.phenotypes(spark, d).join(F.broadcast(middle), "trait").withColumn("above", F.col("y") > F.col("middle"))
    return rows.groupBy("trait").agg(F.count("*").alias("n"), F.sum(F.col("above").cast("long")).alias("above"), F.min("sid").alias("first"))


@query
def stream_unit_stats(spark: SparkSession, d: str) -> DataFrame:
    """Unit sums of the event stream, folded in incrementally."""
    return streaming.unit_stats(spark, d)
