"""LD scores: exact within a window of positions, exact over all pairs of dense panels, and sketched by sign probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sgspark.functions.linear import solve
from sgspark.operators import blocks


def band_pairs(axis: DataFrame, width: int, place: str = "pos") -> DataFrame:
    """All ordered pairs (i, j), i = j included, of one chromosome with |place_i - place_j| <= width.

    A bucketed range join: each left row looks into its own bucket of ``width`` places and the two beside it, so the
    join is an equi-join on (chr, bucket) and no row meets more than three buckets."""
    bucket = F.floor(F.col(place) / width)
    left = axis.select("chr", F.col("idx").alias("i"), F.col(place).alias("pi"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    right = axis.select("chr", F.col("idx").alias("j"), F.col(place).alias("pj"), bucket.alias("b"))
    return left.join(right, ["chr", "b"]).where(F.abs(F.col("pi") - F.col("pj")) <= width).select("chr", "i", "j")


def band_products(axis: DataFrame, dosage: DataFrame, width: int, parts: int = 0) -> DataFrame:
    """(i, j, sgg): sums of g_i * g_j over samples that carry both, for pairs of the band with i before j. A sample's dosages
    stand in the order of positions in one task (of ``parts``, if given), which adds them to those after them as far as the
    band goes; what is shuffled is a row a dosage, and the pairs."""
    rows = dosage.where("sid is not null and g is not null").join(axis.select("idx", "chr", "pos"), "idx").select("sid", "chr", "pos", "idx", "g")
    dealt = rows.repartition(parts, "sid") if parts else rows.repartition("sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            sid, chr_, pos, idx, g = columns
            lag, at = 1, np.arange(len(sid))
            while len(at := at[at + lag < len(sid)]):
                to = at + lag
                at = at[(sid[at] == sid[to]) & (chr_[at] == chr_[to]) & (pos[to] - pos[at] <= width)]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(idx[at]), pa.array(idx[at + lag]), pa.array(g[at] * g[at + lag])], ["i", "j", "gg"])
                lag += 1

        held = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            both = [np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
            end = int(np.searchsorted(both[0], both[0][-1])) if len(both[0]) else 0  # the last sample may go on
            yield from met([c[:end] for c in both])
            held = [c[end:] for c in both]
        yield from met(held)

    whole = [F.col(c).cast("long").alias(c) for c in ("sid", "chr", "pos", "idx", "g")]
    near = dealt.select(*whole).sortWithinPartitions("sid", "chr", "pos", "idx").mapInArrow(run, "i long, j long, gg long")
    return near.groupBy("i", "j").agg(F.sum("gg").alias("sgg"))


def _half_band(axis: DataFrame, dosage: DataFrame, sums: DataFrame, n: DataFrame, width: int, notes: DataFrame | None, parts: int) -> DataFrame:
    """(i, j, r2, adj, and i_<note>, j_<note>) of every pair of the band of polymorphic variants, i before j or the same. The
    variants' facts are joined before there are pairs."""
    stats = sums.crossJoin(F.broadcast(n)).withColumn("nsxx", F.col("n") * F.col("sg2") - F.col("sg") * F.col("sg")).where("nsxx > 0").select("idx", "sg", "sg2", "nsxx")
    known = axis.select("idx", "chr", "pos").join(stats, "idx")
    extra = []
    if notes is not None:
        known, extra = known.join(notes, "idx"), [c for c in notes.columns if c != "idx"]
    bucket = F.floor(F.col("pos") / width)
    left = known.select("chr", F.col("idx").alias("i"), F.col("pos").alias("pi"), F.col("sg").alias("sgi"), "sg2", F.col("nsxx").alias("xi"), *[F.col(c).alias(f"i_{c}") for c in extra], F.explode(F.array(bucket, bucket + 1)).alias("b"))
    right = known.select("chr", F.col("idx").alias("j"), F.col("pos").alias("pj"), F.col("sg").alias("sgj"), F.col("nsxx").alias("xj"), *[F.col(c).alias(f"j_{c}") for c in extra], bucket.alias("b"))
    after = (F.col("pi") < F.col("pj")) | ((F.col("pi") == F.col("pj")) & (F.col("i") <= F.col("j")))
    rows = left.join(right, ["chr", "b"]).where(after & (F.col("pj") - F.col("pi") <= width)).drop("chr", "b", "pi", "pj")
    rows = rows.join(band_products(axis, dosage, width, parts), ["i", "j"], "left").crossJoin(F.broadcast(n))
    sgg = F.when(F.col("i") == F.col("j"), F.col("sg2")).otherwise(F.coalesce("sgg", F.lit(0)))
    top = (F.col("n") * sgg - F.col("sgi") * F.col("sgj")).cast("double")
    r2 = top * top / (F.col("xi").cast("double") * F.col("xj").cast("double"))
    return rows.withColumn("r2", r2).withColumn("adj", F.col("r2") - (1 - F.col("r2")) / (F.col("n") - 2)).select("i", "j", "r2", "adj", *[f"{e}_{c}" for c in extra for e in "ij"])


def _either_way(rows: DataFrame, one: list, other: list) -> DataFrame:
    """A row of ``one`` of each pair, and one of ``other`` if its variants differ."""
    return rows.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(*one))).otherwise(F.array(F.struct(*one), F.struct(*other)))).alias("_p")).select("_p.*")


def window_r2(axis: DataFrame, dosage: DataFrame, sums: DataFrame, n: DataFrame, width: int, parts: int = 0) -> DataFrame:
    """(i, j, r2, adj) of every ordered pair of the band of polymorphic variants; adj = r2 - (1 - r2) / (n - 2). Pairs without a
    common carrier count with a product of 0. n: a one-row table with n."""
    both = [F.col("r2"), F.col("adj")]
    return _either_way(_half_band(axis, dosage, sums, n, width, None, parts), [F.col("i"), F.col("j"), *both], [F.col("j").alias("i"), F.col("i").alias("j"), *both])


def window_scores(axis: DataFrame, dosage: DataFrame, sums: DataFrame, n: DataFrame, width: int, notes: DataFrame, columns: list[str], parts: int = 0) -> DataFrame:
    """scores() of window_r2(): a pair is made once, and goes to its two variants as sums."""
    rows = _half_band(axis, dosage, sums, n, width, notes.select("idx", *columns), parts)
    way = lambda v, of: [F.col(v).alias("idx"), *[(F.col(f"{of}_{c}") * F.col("adj")).alias(f"l2_{c}") for c in columns]]
    return _either_way(rows, way("i", "j"), way("j", "i")).groupBy("idx").agg(*[F.sum(f"l2_{c}").alias(f"l2_{c}") for c in columns])


def scores(pairs: DataFrame, annotations: DataFrame, columns: list[str]) -> DataFrame:
    """Per variant i: l2_<column> = sum over partners j of the annotation of j times adj."""
    by = pairs.join(annotations.select(F.col("idx").alias("j"), *columns), "j")
    return by.groupBy(F.col("i").alias("idx")).agg(*[F.sum(F.col(c) * F.col("adj")).alias(f"l2_{c}") for c in columns])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def dense_moments(panel: DataFrame) -> DataFrame:
    """vid, label, e, n, s, nsxx of dense whole-number genotypes; monomorphic variants are left out."""
    total = F.aggregate("e", F.lit(0).cast("long"), lambda s, x: s + x)
    rows = panel.withColumns({"n": F.size("e").cast("long"), "s": total, "q": _dot(F.col("e"), F.col("e"))})
    return rows.withColumn("nsxx", F.col("n") * F.col("q") - F.col("s") * F.col("s")).where("nsxx > 0").drop("q")


#: Samples of a block of samples, and numbers of a matrix that a task sums at once.
TILE, CELLS = blocks.SAMPLES, blocks.SAMPLES * blocks.COLUMNS


def gram_scores(panel: DataFrame) -> DataFrame:
    """(vid, raw, n): exact LD scores against all variants of a dense panel; see blocks.exact."""
    rows = dense_moments(panel).select("vid", "e", "n")
    return blocks.exact(rows, side=TILE).join(rows.select("vid", "n"), "vid")


def sketch(panel: DataFrame, probes: int) -> DataFrame:
    """Probe values (vid, probe, y): y = (x_i' sum_j x_j sign_jv)**2 with rows x = n e - s, scaled by the variant's own
    norm, so that partners weigh by their own. See blocks."""
    rows = dense_moments(panel).withColumn("weight", (F.col("n") * F.col("nsxx")).cast("double"))
    return blocks.probe_values(rows, probes, "weight", TILE, max(1, CELLS // TILE))


def probe_variance(values: DataFrame) -> DataFrame:
    """Per variant the mean over probes and its Monte Carlo variance, (sum y**2 - (sum y)**2 / B) / (B (B - 1))."""
    b = F.count("*")
    return values.groupBy("vid").agg(b.alias("probes"), F.avg("y").alias("mean"), ((F.sum(F.col("y") ** 2) - F.sum("y") ** 2 / b) / (b * (b - 1))).alias("variance"))


def residual_variance(dosage: DataFrame, covariate: DataFrame) -> DataFrame:
    """Per variant the share of variance that a covariate (sid, c; whole numbers) leaves: r2 and
    v = (1 - r2)(n - 1) / (n - 2). Monomorphic variants have v = 0."""
    c = covariate.agg(F.count("*").alias("n"), F.sum("c").alias("sc"), F.sum(F.col("c") * F.col("c")).alias("sc2"))
    rows = dosage.join(covariate, "sid").groupBy("idx").agg(F.sum("g").alias("sg"), F.sum(F.col("g") * F.col("g")).alias("sg2"), F.sum(F.col("g") * F.col("c")).alias("sgc")).crossJoin(F.broadcast(c))
    xx = (F.col("n") * F.col("sg2") - F.col("sg") * F.col("sg")).cast("double")
    cc = (F.col("n") * F.col("sc2") - F.col("sc") * F.col("sc")).cast("double")
    xc = (F.col("n") * F.col("sgc") - F.col("sg") * F.col("sc")).cast("double")
    r2 = F.when((xx > 0) & (cc > 0), xc * xc / (xx * cc)).otherwise(0.0)
    return rows.withColumn("r2", r2).withColumn("v", F.when(xx > 0, (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 2)).otherwise(0.0)).select("idx", "r2", "v")


def residual_variance_of(dosage: DataFrame, covariates: DataFrame, names: list[str]) -> DataFrame:
    """residual_variance() for several covariates (sid, ...) with an intercept: r2 = c' S^-1 c / xx for each variant, S the
    covariates' own products, and v = (1 - r2)(n - 1) / (n - p - 1)."""
    p = len(names)
    own = covariates.agg(F.count("*").alias("n"), *[F.sum(c).cast("double").alias(f"s_{c}") for c in names], *[F.sum(F.col(a) * F.col(b)).cast("double").alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]])
    rows = dosage.join(covariates, "sid").groupBy("idx").agg(F.sum("g").cast("double").alias("sg"), F.sum(F.col("g") * F.col("g")).cast("double").alias("sg2"), *[F.sum(F.col("g") * F.col(c)).cast("double").alias(f"g_{c}") for c in names]).crossJoin(F.broadcast(own))
    n = F.col("n")
    cross = [F.col(f"g_{c}") - F.col("sg") * F.col(f"s_{c}") / n for c in names]
    cell = lambda i, j: F.col(f"{names[min(i, j)]}_{names[max(i, j)]}") - F.col(f"s_{names[i]}") * F.col(f"s_{names[j]}") / n
    rows = rows.withColumn("_b", solve([[cell(i, j) for j in range(p)] for i in range(p)], cross)).withColumn("_xx", F.col("sg2") - F.col("sg") ** 2 / n)
    explained = sum((F.col("_b")[i] * cross[i] for i in range(p)), F.lit(0.0))
    rows = rows.withColumn("r2", F.when(F.col("_xx") > 0, explained / F.col("_xx")).otherwise(0.0))
    return rows.select("idx", "r2", F.when(F.col("_xx") > 0, (1 - F.col("r2")) * (n - 1) / (n - p - 1)).otherwise(0.0).alias("v"))
