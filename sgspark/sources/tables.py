"""The engine's long tables (variants, dosages, phenotypes, annotations, ...) over the star-schema inputs.

One row per variant, per non-zero dosage, per sample and trait. Sums of dosages and phenotypes are exact integers, so
that results don't depend on the order of additions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sgspark.operators.axes import positions

#: Rows of a partition of the dosages.
PART = 1 << 18


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_of(df: DataFrame, name: str) -> DataFrame:
    """A one-row table with the number of rows, to be broadcast."""
    return F.broadcast(df.agg(F.count("*").alias(name)))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, snp, chr, bp, a1, a2, pos (place on the ordered axis) and the annotations low, high, promo, price, brand."""
    part = read(spark, sf_dir, "part")
    pair = F.col("idx") % 12
    first = F.floor(pair / 3).cast("int")
    second = (pair % 3).cast("int")
    second = F.when(second >= first, second + 1).otherwise(second)
    rows = part.crossJoin(size_of(part, "m")).select(
        F.col("p_partkey").alias("idx"),
        F.concat(F.lit("rs"), F.col("p_partkey")).alias("snp"),
        (F.lit(1) + F.floor(F.col("p_partkey") * 22 / F.col("m"))).cast("int").alias("chr"),
        (F.col("p_partkey") * 1000).alias("bp"),
        (F.col("p_size") <= 25).cast("int").alias("low"),
        (F.col("p_size") > 25).cast("int").alias("high"),
        F.col("p_type").startswith("PROMO").cast("int").alias("promo"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("price"),
        F.col("p_brand").alias("brand"),
    )
    rows = rows.withColumns({"a1": F.substring(F.lit("ACGT"), first + 1, F.lit(1)), "a2": F.substring(F.lit("ACGT"), second + 1, F.lit(1))})
    return positions(rows)


def parts_of(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the dosages, of some PART rows each; 0 where no more are needed than there are cores. Adaptive planning
    joins partitions until there are as many as cores, so that what a task sorts and groups would grow with the table."""
    parts = -(-read(spark, sf_dir, "lineitem").count() // PART)
    return parts if parts > spark.sparkContext.defaultParallelism else 0


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df in ``parts`` partitions by its keys; as it is, if 0."""
    return df.repartition(parts, *keys) if parts else df


def dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse genotypes: idx (variant), sid (sample), g in {1, 2}; absent pairs are 0."""
    parts = parts_of(spark, sf_dir)
    items = dealt(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), parts, "l_orderkey")
    orders = dealt(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), parts, "o_orderkey")
    pairs = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("idx"), F.col("o_custkey").alias("sid"))
    return dealt(pairs, parts, "idx", "sid").groupBy("idx", "sid").agg(F.least(F.lit(2), F.count("*")).cast("long").alias("g"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, nation, segment, y1 (balance, whole units), y2 (order total in thousands), case (binary trait), env."""
    customer = read(spark, sf_dir, "customer")
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))).alias("cents"))
    rows = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(
        F.col("c_custkey").alias("sid"),
        F.col("c_nationkey").cast("long").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.round("c_acctbal").cast("long").alias("y1"),
        F.floor(F.coalesce("cents", F.lit(0)) / 100000).cast("long").alias("y2"),
        (F.col("c_mktsegment") == "BUILDING").cast("long").alias("case"),
        (F.col("c_nationkey").cast("long") - 12).alias("env"),
    )


def phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long traits: trait, sid, y."""
    return samples(spark, sf_dir).selectExpr("sid", "stack(2, 'y1', y1, 'y2', y2) as (trait, y)").select("trait", "sid", "y")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense genotypes: vid (variant), label (class), e (array of 64 whole thousandths)."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vid"), F.col("label").cast("int").alias("label"), F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("e"))
