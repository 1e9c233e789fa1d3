"""Readers of sample, reference and batch inputs. Like files.py: everything is read as strings and cast column by column;
what a file must hold is checked before anything is returned."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sgspark.sources import files

#: What counts as a missing phenotype.
MISSING = ("-9", "NA", "NaN", "nan", ".", "None", "NONE", "null", "NULL")
_FINITE = float("inf")


def _one(df: DataFrame, condition: Column, message: str) -> None:
    if (row := df.where(condition).first()) is not None:
        raise ValueError(f"{message}: {row.asDict()}")


def _finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _FINITE), F.lit(False))


def sample_rows(spark: SparkSession, path: str) -> DataFrame:
    """A headed sample table of strings with fid and iid; other columns keep their names."""
    raw = files.table(spark, path)
    upper = {c.upper(): c for c in raw.columns}
    if not {"FID", "IID"} <= set(upper):
        raise ValueError(f"{path} has no FID and IID")
    rest = [c for c in raw.columns if c.upper() not in ("FID", "IID")]
    out = raw.select(F.col(upper["FID"]).alias("fid"), F.col(upper["IID"]).alias("iid"), *rest)
    _one(out.groupBy("fid", "iid").count(), F.col("count") > 1, f"{path} lists a sample twice")
    return out


def missing_tokens(raw: str | None = None) -> list[str]:
    """The tokens of a comma-separated list; the usual ones if none is given."""
    return [t.strip() for t in raw.split(",") if t.strip()] if raw is not None else list(MISSING)


def phenotypes(spark: SparkSession, path: str, tokens: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Long phenotypes (fid, iid, trait, y) without missing values. A token that is a number is missing however it is
    written (-9, -9.0); what isn't a number or a token is an error."""
    rows = sample_rows(spark, path)
    traits = columns or rows.columns[2:]
    if absent := [t for t in traits if t not in rows.columns]:
        raise ValueError(f"{path} has no phenotype {', '.join(absent)}")
    long = rows.select("fid", "iid", F.explode(F.array(*[F.struct(F.lit(t).alias("trait"), F.trim(F.col(f"`{t}`")).alias("raw")) for t in traits])).alias("c")).select("fid", "iid", "c.*")
    tokens_ = missing_tokens(tokens)
    numbers = []
    for t in tokens_:
        try:
            numbers.append(float(t))
        except ValueError:
            continue
    numbers = [x for x in numbers if math.isfinite(x)]
    y = F.col("raw").try_cast("double")
    gone = F.col("raw").isNull() | (F.col("raw") == "") | F.col("raw").isin(tokens_) | F.coalesce(y.isin(numbers), F.lit(False))
    long = long.where(~gone).withColumn("y", y)
    _one(long, ~_finite(F.col("y")), f"{path} holds what is no number")
    return long.select("fid", "iid", "trait", "y")


def covariates(spark: SparkSession, path: str, samples: DataFrame, impute: bool = False, categorical: list[str] = ()) -> DataFrame:
    """Covariates of the samples (fid, iid): numeric columns, categorical ones as indicators of all levels but the first.
    A sample that the file lacks is an error; incomplete rows go, or get the column's mean with impute; constant columns
    go; the others are standardised (ddof 1)."""
    rows = sample_rows(spark, path)
    _one(samples.select("fid", "iid").join(rows, ["fid", "iid"], "left_anti"), F.lit(True), f"{path} lacks a sample")
    rows = rows.join(samples.select("fid", "iid"), ["fid", "iid"])
    columns = {}
    for c in rows.columns[2:]:
        value = F.trim(F.col(f"`{c}`"))
        if c not in categorical:
            columns[c] = value.try_cast("double")
            continue
        known = F.when(~value.isin(*MISSING, ""), value)
        levels = sorted(r[0] for r in rows.select(known).distinct().collect() if r[0] is not None)  # the levels of a category
        for level in levels[1:]:
            columns[f"{c}_{level}"] = F.when(known.isNotNull(), (known == level).cast("double"))
    out = rows.select("fid", "iid", *[F.when(_finite(v), v).alias(c) for c, v in columns.items()])
    names = list(columns)
    if impute:
        means = F.broadcast(out.agg(*[F.avg(f"`{c}`").alias(f"_{c}") for c in names]))
        out = out.crossJoin(means).select("fid", "iid", *[F.coalesce(F.col(f"`{c}`"), F.col(f"`_{c}`")).alias(c) for c in names])
    else:
        out = out.dropna(subset=names)
    stats = out.agg(*[F.stddev_samp(f"`{c}`").alias(c) for c in names]).first()
    varied = [c for c in names if stats[c]]
    if not varied:
        raise ValueError(f"{path} has no covariate that varies")
    moments = F.broadcast(out.agg(*[F.avg(f"`{c}`").alias(f"_m{i}") for i, c in enumerate(varied)], *[F.stddev_samp(f"`{c}`").alias(f"_s{i}") for i, c in enumerate(varied)]))
    return out.crossJoin(moments).select("fid", "iid", *[((F.col(f"`{c}`") - F.col(f"_m{i}")) / F.col(f"_s{i}")).alias(c) for i, c in enumerate(varied)])


def environment(spark: SparkSession, path: str, samples: DataFrame, column: str | None = None) -> DataFrame:
    """(fid, iid, env) of complete samples: the named column, or the only one."""
    rows = sample_rows(spark, path)
    names = rows.columns[2:]
    if column is None and len(names) != 1:
        raise ValueError(f"{path} has {len(names)} environments; name one")
    if (column or names[0]) not in names:
        raise ValueError(f"{path} has no environment {column}")
    out = rows.join(samples.select("fid", "iid"), ["fid", "iid"], "left_semi").select("fid", "iid", F.col(f"`{column or names[0]}`").try_cast("double").alias("env"))
    return out.where(_finite(F.col("env")))


def kmoments(spark: SparkSession, path: str) -> DataFrame:
    """One row of reference moments: nsnps, proj_rank, t0_rank, t1_rank and t2_rank, all finite."""
    raw = files.table(spark, path)
    names = ("nsnps", "proj_rank", "t0_rank", "t1_rank", "t2_rank")
    if absent := [n for n in names if n not in raw.columns]:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    out = raw.select(*[F.col(n).try_cast("double").alias(n) for n in names])
    if (count := out.count()) != 1:
        raise ValueError(f"{path} has {count} rows instead of one")
    for n in names:
        _one(out, ~_finite(F.col(n)), f"{path}: {n} isn't finite")
    return out


def annotation_sizes(spark: SparkSession, path: str, bins: int) -> DataFrame:
    """(bin, m): numbers of variants by annotation, added up over the chromosomes' files."""
    numbers = spark.read.text(files.paths(path)).withColumn("path", F.input_file_name()).where(F.trim("value") != "")
    long = numbers.select("path", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("bin", "raw")).withColumn("m", F.col("raw").try_cast("double"))
    _one(long, ~_finite(F.col("m")) | (F.col("m") < 0), f"{path} holds no number of variants")
    _one(long.groupBy("path").agg(F.count("*").alias("values")), F.col("values") != bins, f"{path} has another number of values than {bins}")
    out = long.groupBy("bin").agg(F.sum("m").alias("m"))
    _one(out, F.col("m") <= 0, f"{path}: an annotation without variants")
    return out


def weight_scores(spark: SparkSession, path: str, axis: DataFrame) -> DataFrame:
    """(snp, w) for every variant of the axis from a table of one LD score column; one that lacks it is an error."""
    raw = files.ld_scores(spark, path)
    data = [c for c in raw.columns if c not in ("chr", "snp", "bp", "cm")]
    if len(data) != 1:
        raise ValueError(f"{path} has {len(data)} LD score columns instead of one")
    _one(raw.groupBy("snp").count(), F.col("count") > 1, f"{path} lists a variant twice")
    out = axis.select("snp").join(raw.select("snp", F.col(f"`{data[0]}`").alias("w")), "snp", "left")
    _one(out, F.col("w").isNull(), f"{path} lacks a variant")
    return out


def thin_annotations(spark: SparkSession, path: str, axis: DataFrame, order: str = "pos") -> DataFrame:
    """Annotations without identifiers: line i, after a header if there is one, is the variant of place i from 0."""
    head = spark.read.text(path).limit(1).first()[0].split()
    try:
        [float(x) for x in head]
        names = [f"bin{i + 1}" for i in range(len(head))]
        lines = files._plain(spark, path, ", ".join(f"{n} double" for n in names))
    except ValueError:
        names = head
        whole = files._plain(spark, path, ", ".join(f"{n} string" for n in names)).where("idx > 0")
        lines = whole.select(*[F.col(f"`{n}`").try_cast("double").alias(n) for n in names], (F.col("idx") - 1).alias("idx"))
    counts = (lines.count(), axis.count())
    if counts[0] != counts[1]:
        raise ValueError(f"{path} has {counts[0]} lines for {counts[1]} variants")
    for n in names:
        _one(lines, ~_finite(F.col(f"`{n}`")), f"{path}: {n} isn't a number")
    return axis.join(lines.withColumnRenamed("idx", order), order)


def annotation_classes(spark: SparkSession, path: str, axis: DataFrame) -> DataFrame:
    """The axis with a 0/1 column for each class of a partition; variants that the file lacks are in none."""
    raw = files.table(spark, path)
    snp = next((c for c in raw.columns if c.upper() == "SNP"), None)
    classes = [c for c in raw.columns if c.upper() not in files.META]
    if snp is None or not classes:
        raise ValueError(f"{path} has no SNP column or no classes")
    rows = raw.select(F.col(snp).alias("snp"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in classes])
    one = F.lit(True)
    for c in classes:
        one &= F.coalesce(F.col(f"`{c}`").isin(0.0, 1.0), F.lit(False))
    _one(rows, ~one | (sum((F.col(f"`{c}`") for c in classes), F.lit(0.0)) != 1), f"{path} isn't a partition")
    _one(rows.groupBy("snp").count(), F.col("count") > 1, f"{path} lists a variant twice")
    out = axis.join(rows, "snp", "left")
    return out.fillna(0.0, classes)


def population_scale(spark: SparkSession, path: str, variants: DataFrame) -> DataFrame:
    """(snp, a1, a2, mean, inv_sd) for exactly the variants (snp, a1, a2), alleles as there."""
    raw = files.table(spark, path)
    if set(raw.columns) != {"SNP", "A1", "A2", "MEAN", "INV_SD"}:
        raise ValueError(f"{path} has to have the columns SNP, A1, A2, MEAN, INV_SD")
    rows = raw.select(F.col("SNP").alias("snp"), F.col("A1").alias("a1"), F.col("A2").alias("a2"), F.col("MEAN").try_cast("double").alias("mean"), F.col("INV_SD").try_cast("double").alias("inv_sd"))
    _one(rows.groupBy("snp").count(), F.col("count") > 1, f"{path} lists a variant twice")
    both = rows.join(variants.select("snp", F.col("a1").alias("_1"), F.col("a2").alias("_2")), "snp", "full")
    _one(both, ~(F.col("a1").eqNullSafe(F.col("_1")) & F.col("a2").eqNullSafe(F.col("_2"))), f"{path} differs from the variants")
    _one(both, ~(_finite(F.col("mean")) & _finite(F.col("inv_sd"))), f"{path} holds what is no number")
    return both.drop("_1", "_2")


def rg_manifest(spark: SparkSession, path: str, need_overlap: bool = True) -> DataFrame:
    """(row, phen1, phen2, sumstats1, sumstats2, overlap_covariance, cov_rank1, cov_rank2, rel_m12) of a table of trait
    pairs; the overlap may go by its older name intercept_rg, but not by both."""
    raw = files.table(spark, path)
    upper = {c.strip().lower(): c for c in raw.columns}
    text = ("phen1", "phen2", "sumstats1", "sumstats2")
    if absent := [c for c in text if c not in upper]:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    if {"overlap_covariance", "intercept_rg"} <= set(upper):
        raise ValueError(f"{path} has both overlap_covariance and intercept_rg")
    overlap = upper.get("overlap_covariance", upper.get("intercept_rg"))
    if overlap is None and need_overlap:
        raise ValueError(f"{path} has no column overlap_covariance")
    number = lambda c: F.col(f"`{c}`").try_cast("double") if c else F.lit(None).cast("double")
    out = raw.select(
        (F.row_number().over(files.W.orderBy(F.monotonically_increasing_id()))).alias("row"),  # a list of pairs, as long as a user writes it
        *[F.trim(F.col(f"`{upper[c]}`")).alias(c) for c in text], number(overlap).alias("overlap_covariance"),
        number(upper.get("cov_rank1")).alias("cov_rank1"), number(upper.get("cov_rank2")).alias("cov_rank2"),
        (F.trim(F.col(f"`{upper['rel_m12']}`")) if "rel_m12" in upper else F.lit(None).cast("string")).alias("rel_m12"),
    )
    if out.limit(1).count() == 0:
        raise ValueError(f"{path} has no rows")
    empty = F.lit(False)
    for c in text:
        empty |= F.coalesce(F.col(c) == "", F.lit(True))
    _one(out, empty, f"{path}: an empty name or path")
    if need_overlap:
        _one(out, ~_finite(F.col("overlap_covariance")), f"{path}: overlap_covariance isn't finite")
    for c in ("cov_rank1", "cov_rank2"):
        _one(out, F.col(c).isNotNull() & ((F.col(c) < 0) | (F.col(c) != F.round(c))), f"{path}: {c} isn't a whole number")
    return out


def batch_manifest(path: str, kind: str, fields: tuple[str, ...]) -> dict:
    """A batch in JSON: its kind and version are checked, and that every trait has the fields and a name of its own."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("kind") != kind or spec.get("schema_version") != 1:
        raise ValueError(f"{path} isn't a {kind} of version 1")
    traits = spec.get("traits") or []
    if not traits or any(set(fields) - set(t) for t in traits):
        raise ValueError(f"{path}: every trait needs {', '.join(fields)}")
    names = [t["name"] for t in traits]
    if len(set(names)) < len(names):
        raise ValueError(f"{path} names a trait twice")
    return spec


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """The names of a list, one a line, without comments and blanks, each once."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' and not startswith(name, '#')").distinct()
