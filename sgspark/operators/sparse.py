"""Probes over sparse dosages: what blocks.genomewide gives for a dense panel, from carriers only.

calls: (vid, k, g) of carriers, every absent pair being 0; basis: (k, q) of all samples, orthonormal columns that span the
constant (see basis.orthonormal). With w = C'x, s = 1 / |x - C w| and b a variant's weight, u = s (x - C w), so sums over
variants such as sum_j b_j u_jk are a sum over the sample's carried variants less q_k' sum_j b_j s_j w_j, and u'S is
s x'S wherever S is free of C. Every pass is a join and an aggregate over the carriers, so work and memory grow with them
and not with variants times samples; what absent pairs add is one row of constants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sgspark.operators import blocks
from sgspark.sources.shared import folder, kept


def _dot(one: list[Column], two: list[Column]) -> Column:
    return sum((a * b for a, b in zip(one, two, strict=True)), F.lit(0.0))


def facts(calls: DataFrame, basis: DataFrame, rank: int, samples: int) -> DataFrame:
    """vid, scale = 1 / |x - C w| (0 where nothing is left), share of variance that is left, and w_0, w_1, ..."""
    q = [F.col("q")[i] for i in range(rank)]
    met = calls.join(basis.select("k", "q"), "k").groupBy("vid").agg(F.sum("g").alias("_s"), F.sum(F.col("g") * F.col("g")).cast("double").alias("_gg"), *[F.sum(F.col("g") * x).alias(f"w_{i}") for i, x in enumerate(q)])
    w = [F.col(f"w_{i}") for i in range(rank)]
    raw = F.col("_gg") - F.col("_s").cast("double") * F.col("_s") / samples
    rows = met.withColumn("_raw", raw).withColumn("_left", F.col("_gg") - _dot(w, w))
    some = (F.col("_raw") > 0) & (F.col("_left") > 1e-10 * F.col("_raw")) & F.lit(samples > 1)
    return rows.select("vid", F.when(some, 1 / F.sqrt("_left")).otherwise(0.0).alias("scale"), F.when(some, F.least(F.lit(1.0), F.try_divide("_left", "_raw"))).otherwise(0.0).alias("share"), *w)


def genomewide(calls: DataFrame, notes: DataFrame, annotations: list[str], probes: int, basis: DataFrame, rank: int, samples: int, weighted: bool = False) -> blocks.Scores:
    """blocks.genomewide() from carriers. notes: vid and the annotations, of all variants that count; variants without a
    carrier have no row. The carriers, each variant's facts and each sample's sums are written once."""
    spark = calls.sparkSession
    path = folder(spark, "sparse")
    k, d = len(annotations), samples - rank
    known = notes.select("vid", *[F.when(F.col(a) >= 0, F.col(a).cast("double")).otherwise(F.raise_error(F.lit("weights of variants can't be negative"))).alias(f"a_{i}") for i, a in enumerate(annotations)])
    calls = kept(calls.select("vid", "k", F.col("g").cast("double").alias("g")), f"{path}/calls")
    basis = kept(basis.select("k", "q"), f"{path}/basis")
    each = facts(calls, basis, rank, samples).join(known, "vid").withColumn("z", blocks.probe_signs(F.col("vid"), probes))
    each = kept(each, f"{path}/facts")
    q, w = [F.col("q")[i] for i in range(rank)], [F.col(f"w_{i}") for i in range(rank)]
    cells = [(i, p) for i in range(k) for p in range(probes)]
    upper = [(i, a, b) for i in range(k) for a in range(rank) for b in range(a, rank)]

    share = (samples - 1) / d if weighted else None
    weight = [F.col(f"a_{i}") * (F.col("share") * share if weighted else F.lit(1.0)) for i in range(k)]
    # a variant's weights: b for the probes' sums, o for the sums of squares
    slim = each.select("vid", "z", *w, *[(F.sqrt(x) * F.col("scale")).alias(f"b_{i}") for i, x in enumerate(weight)], *[(x * F.col("scale") * F.col("scale")).alias(f"o_{i}") for i, x in enumerate(weight)])
    rest = slim.agg(
        *[F.sum(F.col(f"b_{i}") * F.col("z")[p] * x).alias(f"r_{i}_{p}_{a}") for i, p in cells for a, x in enumerate(w)],
        *[F.sum(F.col(f"o_{i}") * w[a] * w[b] * (1 if a == b else 2)).alias(f"m_{i}_{a}_{b}") for i, a, b in upper],
    )  # one row
    g = F.col("g")
    # narrow rows go to their sample, where they are added up
    met = calls.join(slim, "vid").repartition("k").groupBy("k").agg(
        *[F.sum(g * F.col(f"b_{i}") * F.col("z")[p]).alias(f"s_{i}_{p}") for i, p in cells],
        *[F.sum(g * g * F.col(f"o_{i}")).alias(f"g_{i}") for i in range(k)],
        *[F.sum(g * F.col(f"o_{i}") * x).alias(f"l_{i}_{a}") for i in range(k) for a, x in enumerate(w)],
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    sums = basis.join(met, "k", "left").crossJoin(F.broadcast(rest)).select(
        "k",
        *[(zero(f"s_{i}_{p}") - _dot(q, [zero(f"r_{i}_{p}_{a}") for a in range(rank)])).alias(f"s_{i}_{p}") for i, p in cells],
        *[(zero(f"g_{i}") - 2 * _dot(q, [zero(f"l_{i}_{a}") for a in range(rank)]) + sum((zero(f"m_{i}_{a}_{b}") * q[a] * q[b] for _, a, b in upper if _ == i), F.lit(0.0))).alias(f"o_{i}") for i in range(k)],
    )
    sums = kept(sums, f"{path}/sums")
    pairs = [(i, j) for i in range(k) for j in range(k)]
    own = sums.agg(*[(F.sum(F.col(f"o_{i}") * F.col(f"o_{j}")) * samples).alias(f"v_{i}_{j}") for i, j in pairs])
    squares = own.select(F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col(f"v_{i}_{j}").alias("value")) for i, j in pairs])).alias("_c")).select("_c.*")
    back = calls.join(sums.select("k", *[f"s_{i}_{p}" for i, p in cells]), "k").groupBy("vid").agg(*[F.sum(g * F.col(f"s_{i}_{p}")).alias(f"s_{i}_{p}") for i, p in cells])
    y = back.join(each, "vid").select("vid", "share", F.array(*[(F.col("scale") * F.col(f"s_{i}_{p}")) ** 2 for i, p in cells]).alias("y"), F.array(*[F.col(f"a_{i}") for i in range(k)]).alias("a"))
    return blocks.scored(y, squares, path, samples, rank, annotations, probes, weighted)
