"""Rank transforms and rank tests within strata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sgspark.functions.special import normal_quantile


def average_ranks(rows: DataFrame, value: str, strata: list[str]) -> DataFrame:
    """Adds rank (ties share their mean rank) and n, by stratum. Values are counted before they are ordered, so a stratum
    that holds most rows orders its distinct values only."""
    counts = rows.groupBy(*strata, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*strata).orderBy(value)
    counts = counts.withColumns({"_b": F.sum("_c").over(w) - F.col("_c"), "n": F.sum("_c").over(W.partitionBy(*strata))})
    counts = counts.withColumn("rank", F.col("_b") + (F.col("_c") + 1) / 2).drop("_b", "_c")
    return rows.join(counts, [*strata, value])


def blom(rows: DataFrame, value: str, strata: list[str]) -> DataFrame:
    """Adds z, the normal quantile of (rank - 3/8) / (n + 1/4)."""
    ranked = average_ranks(rows, value, strata).withColumn("_p", (F.col("rank") - 0.375) / (F.col("n") + 0.25))
    return ranked.withColumn("z", F.expr(normal_quantile("_p"))).drop("_p")


def auc(rows: DataFrame, value: str, case: str, strata: list[str]) -> DataFrame:
    """By stratum: the area under the curve of a 0/1 case by value, and its DeLong standard error, from the ranks within
    all rows and within cases and controls. Strata without both kinds are left out."""
    all_ranks = average_ranks(rows, value, strata).withColumnRenamed("rank", "r").drop("n")
    own = average_ranks(all_ranks, value, [*strata, case]).withColumnRenamed("n", "n_own")
    # one row a stratum, joined back: no stratum is held by a task
    sizes = rows.groupBy(*strata).agg(F.sum(case).alias("n1"), F.sum(1 - F.col(case)).alias("n0")).where("n1 > 1 and n0 > 1")
    own = own.join(sizes, strata)
    place = F.when(F.col(case) == 1, (F.col("r") - F.col("rank")) / F.col("n0")).otherwise(1 - (F.col("r") - F.col("rank")) / F.col("n1"))
    own = own.withColumn("v", place)
    mean1, var1 = F.avg(F.when(F.col(case) == 1, F.col("v"))), F.var_samp(F.when(F.col(case) == 1, F.col("v")))
    var0 = F.var_samp(F.when(F.col(case) == 0, F.col("v")))
    return own.groupBy(*strata).agg(F.max("n1").alias("cases"), F.max("n0").alias("controls"), mean1.alias("auc"), F.sqrt(var1 / F.max("n1") + var0 / F.max("n0")).alias("se"))


def rank_bins(rows: DataFrame, value: str, strata: list[str], bins: int) -> DataFrame:
    """Adds bin: how many of the stratum's inner quantile edges (linear interpolation, distinct) are at or below the value."""
    points = [i / bins for i in range(1, bins)]
    edges = rows.groupBy(*strata).agg(F.array_distinct(F.percentile(value, F.array(*map(F.lit, points)))).alias("_edges"))
    out = rows.join(F.broadcast(edges) if not strata else edges, strata) if strata else rows.crossJoin(F.broadcast(edges))
    return out.withColumn("bin", F.size(F.filter("_edges", lambda e: e <= F.col(value)))).drop("_edges")


def auc_contrasts(strata: DataFrame, order: str) -> DataFrame:
    """Over strata with an order, auc and se (a row each): the difference between the first and the last, its z, and the
    trend by inverse-variance weights with its z. Fewer than two strata give no row."""
    s = strata.select(F.col(order).cast("double").alias("o"), "auc", "se").withColumn("w", 1 / F.col("se") ** 2)
    t = s.agg(F.count("*").alias("strata"), F.min(F.struct("o", "auc", "se")).alias("a"), F.max(F.struct("o", "auc", "se")).alias("b"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("o")).alias("wo"), F.sum(F.col("w") * F.col("auc")).alias("wa"), F.sum(F.col("w") * F.col("o") * F.col("o")).alias("woo"), F.sum(F.col("w") * F.col("o") * F.col("auc")).alias("woa"))
    spread = F.col("woo") - F.col("wo") ** 2 / F.col("w")
    trend = (F.col("woa") - F.col("wo") * F.col("wa") / F.col("w")) / spread
    diff = F.col("a.auc") - F.col("b.auc")
    out = t.where("strata > 1").select("strata", diff.alias("diff"), (diff / F.sqrt(F.col("a.se") ** 2 + F.col("b.se") ** 2)).alias("diff_z"), trend.alias("trend"), (trend * F.sqrt(spread)).alias("trend_z"))
    return out
