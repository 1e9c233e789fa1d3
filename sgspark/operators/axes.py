"""Ordered axes: positions, jackknife units and replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def positions(variants: DataFrame) -> DataFrame:
    """Adds pos, the place from 0 in the order (chr, bp, snp). Ordered chromosome by chromosome; the offsets of the
    chromosomes are a small table, so no task orders the whole axis."""
    sizes = variants.groupBy("chr").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(W.orderBy("chr").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(W.partitionBy("chr").orderBy("bp", "snp")) - 1
    return variants.withColumn("_own", own).join(F.broadcast(starts), "chr").withColumn("pos", (F.col("_own") + F.col("start")).cast("long")).drop("_own", "start")


def unit_of(pos: Column, m: Column, blocks: int) -> Column:
    """The block of a position when 0..m is cut at floor(b * (m / blocks)); no join with the edges is needed."""
    edge = lambda b: F.floor(b * (m.cast("double") / F.lit(blocks)))
    guess = F.least(F.floor(pos * F.lit(float(blocks)) / m), F.lit(blocks - 1))
    return (guess + F.when((guess < blocks - 1) & (edge(guess + 1) <= pos), 1).when(edge(guess) > pos, -1).otherwise(0)).cast("int")


def equal_units(axis: DataFrame, blocks: int) -> DataFrame:
    """Adds unit, of ``blocks`` runs of positions of nearly equal count."""
    size = F.broadcast(axis.agg(F.count("*").alias("_m")))
    return axis.crossJoin(size).withColumn("unit", unit_of(F.col("pos"), F.col("_m"), blocks)).drop("_m")


def mass_units(axis: DataFrame, mass: str, blocks: int) -> DataFrame:
    """Adds unit, of ``blocks`` runs of positions of nearly equal mass: ceil(cumulative * blocks / total) - 1.

    The running mass is summed by chromosome first, so only one chromosome is ordered in a task."""
    sums = axis.groupBy("chr").agg(F.sum(mass).alias("_s"))
    every = W.orderBy("chr").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("chr", F.coalesce(F.sum("_s").over(every), F.lit(0)).alias("_start"), F.sum("_s").over(W.partitionBy()).alias("_all"))
    own = F.sum(mass).over(W.partitionBy("chr").orderBy("pos"))
    rows = axis.withColumn("_own", own).join(F.broadcast(starts), "chr")
    cum = F.col("_own") + F.col("_start")
    unit = F.least(F.greatest(F.ceil(cum * blocks / F.col("_all")) - 1, F.lit(0)), F.lit(blocks - 1))
    return rows.withColumn("unit", unit.cast("int")).drop("_own", "_start", "_all")


def delete_sets(units: DataFrame, d: int) -> DataFrame:
    """Replicates that leave out d units each: (rep, unit). d is 1 or 2; all combinations, ordered."""
    u = units.select("unit").distinct()
    if d == 1:
        return u.select(F.col("unit").cast("string").alias("rep"), "unit")
    v = u.select(F.col("unit").alias("other"))
    # combinations of jackknife units (a few hundred) are the operator's output
    pairs = u.join(F.broadcast(v), F.col("unit") < F.col("other")).withColumn("rep", F.concat_ws("-", "unit", "other"))
    return pairs.select("rep", F.explode(F.array("unit", "other")).alias("unit"))


def replicate_sums(unit_sums: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """Delete-one replicates by subtraction: for each unit the totals (t_*) and the totals without the unit (r_*)."""
    w = W.partitionBy(*keys)
    totals = {f"t_{c}": F.sum(c).over(w) for c in columns}
    return unit_sums.withColumns(totals).withColumns({f"r_{c}": F.col(f"t_{c}") - F.col(c) for c in columns})


def jackknife(replicates: DataFrame, value: str, full: str, size: str, keys: list[str]) -> DataFrame:
    """Delete-one SE for units of unequal size: pseudovalues ((M*full - (M-m)*value) / m), weights w = m/M,
    variance sum(w**2/(1-w) * (pv - centre)**2) about the weighted centre. Units of size 0 don't count; of one unit there is
    no error (null)."""
    w = W.partitionBy(*keys)
    rows = replicates.where(F.col(size) > 0).withColumn("_M", F.sum(size).over(w).cast("double"))
    rows = rows.withColumn("_w", F.col(size) / F.col("_M")).withColumn("_pv", (F.col("_M") * F.col(full) - (F.col("_M") - F.col(size)) * F.col(value)) / F.col(size))
    rows = rows.withColumn("_c", F.sum(F.col("_w") * F.col("_pv")).over(w))
    variance = F.sum(F.try_divide(F.col("_w") * F.col("_w"), 1 - F.col("_w")) * (F.col("_pv") - F.col("_c")) ** 2)
    return rows.groupBy(*keys).agg(F.count("*").alias("n_units"), F.max(full).alias("estimate"), F.sqrt(variance).alias("se"))
