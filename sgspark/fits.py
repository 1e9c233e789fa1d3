"""Fits from files: summary statistics and LD scores to heritabilities and genetic correlations, one trait or a batch.

Results are published whole: written beside their place and renamed, never over what is there. A batch that was stopped
goes on with the traits that have no result yet."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sgspark.operators import axes, components, gwas, ldsc
from sgspark.sources import files, inputs


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def published(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def publish(results: DataFrame, path: str, text: bool = False) -> None:
    """Writes a result, Parquet or one headed table of text, so that a reader sees all of it or nothing; a result that is
    there is an error."""
    spark = results.sparkSession
    if published(spark, path):
        raise FileExistsError(path)
    part = f"{path}.part-{uuid.uuid4().hex}"
    if text:
        results.coalesce(1).write.csv(part, sep="\t", header=True)
    else:
        results.write.parquet(part)
    (source, fs), (target, _) = _path(spark, part), _path(spark, path)
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        raise FileExistsError(path)


def reference(spark: SparkSession, ld: str, annot: str | None, blocks: int) -> tuple[DataFrame, list[str]]:
    """The axis (snp, unit, annotations, l2_<annotation>) of an LD-score table, and the annotations' names. Its columns are
    L2_<name>; without an annotation table there has to be one, of all variants."""
    table = files.ld_scores(spark, ld)
    data = [c for c in table.columns if c not in ("chr", "snp", "bp", "cm")]
    names = [c[3:] if c.upper().startswith("L2_") else c for c in data]
    axis = axes.equal_units(axes.positions(table.select("chr", "bp", "snp", *[F.col(f"`{c}`").alias(f"l2_{n}") for c, n in zip(data, names, strict=True)])), blocks)
    if annot is None:
        if len(names) != 1:
            raise ValueError(f"{ld} has {len(names)} LD scores; they need an annotation table")
        return axis.withColumn(names[0], F.lit(1.0)), names
    notes = files.annotations(spark, annot, axis.select("snp"))
    if absent := [n for n in names if n not in notes.columns]:
        raise ValueError(f"{annot} has no annotation {', '.join(absent)}")
    return axis.join(notes.select("snp", *names), "snp"), names


def moments(spark: SparkSession, path: str, trait: str, axis: DataFrame, chisq_max: float | None = None, cov_rank: int = 0) -> DataFrame:
    """The score moments of a file's variants on the axis, after quality control; above chisq_max they are left out."""
    stats = files.sumstats(spark, path, trait)
    if "cov_rank" in stats.columns:
        cov_rank = int(stats.select("cov_rank").first()[0])
    rows = gwas.qc(stats, "snp").where(F.lit(True) if chisq_max is None else F.col("z") ** 2 <= chisq_max)
    return gwas.score_moments(rows, cov_rank).join(axis, "snp")


def h2(spark: SparkSession, sumstats: str, ld: str, annot: str | None = None, blocks: int = 200, method: str = "he", trait: str = "trait", chisq_max: float | None = None) -> DataFrame:
    """Heritability of a file's trait: (trait, quantity, n_units, estimate, se)."""
    axis, names = reference(spark, ld, annot, blocks)
    rows = moments(spark, sumstats, trait, axis, chisq_max)
    if method not in ("he", "ldsc"):
        raise ValueError(f"no method {method}")
    return components.h2(rows, names) if method == "he" else ldsc.h2(rows, names)


def rg(spark: SparkSession, one: str, two: str, ld: str, overlap: float, annot: str | None = None, blocks: int = 200, method: str = "he") -> DataFrame:
    """Genetic correlation of two files' traits: (quantity, n_units, estimate, se). The variants are those of both."""
    axis, names = reference(spark, ld, annot, blocks)
    a, b = (moments(spark, path, t, axis) for path, t in ((one, "one"), (two, "two")))
    side = lambda rows, k: rows.select("snp", F.col("z_star").alias(f"z{k}"), F.col("n_star").alias(f"n{k}"), F.col("y").alias(f"y{k}"), F.col("d").alias(f"d{k}"))
    both = side(a, 1).join(side(b, 2), "snp").join(axis, "snp")
    if method == "he":
        return components.rg(both, names, spark.range(1).select(F.lit(float(overlap)).alias("c")))
    return ldsc.rg(both, a.join(both.select("snp"), "snp"), b.join(both.select("snp"), "snp"), names, float(overlap))


def batch(spark: SparkSession, jobs: list[tuple[str, Callable[[], DataFrame]]], out: str) -> list[str]:
    """Publishes each job's result as out/<name>; jobs whose result is there are skipped. The names of those that ran."""
    if len({name for name, _ in jobs}) < len(jobs) or any("/" in name or not name for name, _ in jobs):
        raise ValueError("jobs need names of their own, without slashes")
    ran = []
    for name, job in jobs:
        if not published(spark, f"{out}/{name}"):
            publish(job(), f"{out}/{name}")
            ran.append(name)
    return ran


def h2_batch(spark: SparkSession, manifest: str, out: str) -> list[str]:
    """A batch of heritabilities: JSON with the kind h2_batch, schema_version 1, ldscores, optional annot, blocks and method,
    and traits of name and sumstats."""
    spec = inputs.batch_manifest(manifest, "h2_batch", ("name", "sumstats"))
    args = {"annot": spec.get("annot"), "blocks": int(spec.get("blocks", 200)), "method": spec.get("method", "he")}
    return batch(spark, [(t["name"], lambda t=t: h2(spark, t["sumstats"], spec["ldscores"], trait=t["name"], **args)) for t in spec["traits"]], out)


def rg_batch(spark: SparkSession, manifest: str, ld: str, out: str, annot: str | None = None, blocks: int = 200, method: str = "he") -> list[str]:
    """A batch of genetic correlations from a table of trait pairs; results are named <phen1>.<phen2>."""
    pairs = inputs.rg_manifest(spark, manifest).orderBy("row").collect()  # as many rows as a user lists
    job = lambda r: lambda: rg(spark, r["sumstats1"], r["sumstats2"], ld, r["overlap_covariance"], annot, blocks, method)
    return batch(spark, [(f"{r['phen1']}.{r['phen2']}", job(r)) for r in pairs], out)
