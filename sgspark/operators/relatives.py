"""Related pairs: families, closures, and their corrections to moments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sgspark.session import checkpointed


def families(pairs: DataFrame) -> DataFrame:
    """Connected components of the undirected pairs (a, b): id, family (its smallest member). Rounds of minimum labels
    with pointer jumping; each round is written to the checkpoint folder, so lineage stays short. Self-pairs and nulls
    make no family."""
    checkpointed(pairs.sparkSession)
    edges = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    edges = edges.union(edges.select("b", "a")).distinct().checkpoint()
    label = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("family")).checkpoint()
    before = None
    while True:
        state = label.agg(F.sum("family"), F.count("*")).first()
        if state == before or not state[1]:
            return label
        before = state
        near = edges.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("family").alias("low"))
        label = label.join(near, "id").select("id", F.least("family", "low").alias("family"))
        up = label.select(F.col("id").alias("family"), F.col("family").alias("top"))
        label = label.join(up, "family").select("id", F.least("family", "top").alias("family")).checkpoint()


def closure(families_: DataFrame) -> DataFrame:
    """All pairs a < b of one family, which is the operator's output: (family, a, b)."""
    left = families_.select("family", F.col("id").alias("a"))
    right = families_.select("family", F.col("id").alias("b"))
    return left.join(right, "family").where("a < b").select("family", "a", "b")


def within(pairs: DataFrame, samples: DataFrame, key: str = "sid") -> DataFrame:
    """Pairs of which both members are in the sample."""
    ids = samples.select(key)
    return pairs.join(ids.withColumnRenamed(key, "a"), "a", "left_semi").join(ids.withColumnRenamed(key, "b"), "b", "left_semi")


def pair_moments(dosage: DataFrame, pairs: DataFrame, values: DataFrame, n: DataFrame) -> DataFrame:
    """Per variant: the sum over ordered related pairs of g_a g_b y_a y_b, over the sample size. values: sid, y (whole
    numbers). Dosages of carriers only: pairs of which a member has none add nothing."""
    y = values.select("sid", "y")
    left = dosage.join(y, "sid").select("idx", F.col("sid").alias("a"), (F.col("g") * F.col("y")).alias("u"))
    right = dosage.join(y, "sid").select("idx", F.col("sid").alias("b"), (F.col("g") * F.col("y")).alias("v"))
    met = left.join(pairs.select("a", "b"), "a").join(right, ["idx", "b"])
    sums = met.groupBy("idx").agg((2 * F.sum(F.col("u") * F.col("v"))).alias("s"), F.count("*").alias("pairs"))
    return sums.crossJoin(F.broadcast(n)).select("idx", "pairs", (F.col("s").cast("double") / F.col("n")).alias("rel_m"))


def centred(samples: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Values less their group's mean, with the group's size."""
    means = samples.groupBy(group).agg(F.count("*").alias("size"), *[F.avg(c).alias(f"_{c}") for c in columns])
    return samples.join(means, group).select("sid", group, "size", *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_centred") for c in columns])
