"""Readers and writers of the engine's text and binary formats.

Text tables are tab- or space-separated, gzipped or not, with named columns that may go by other names; ``@`` in a path
stands for the chromosomes 1 to 22. Everything is read as strings and cast column by column, so that identifiers such as
"NA" stay what they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sgspark.sources import genotypes

#: Names that a column may go by, in order of preference.
ALIASES = {
    "snp": ("SNP", "ID", "RSID", "MARKERNAME"),
    "a1": ("A1", "ALT", "EFFECT_ALLELE"),
    "a2": ("A2", "REF", "OTHER_ALLELE"),
    "n": ("N", "OBS_CT"),
    "beta": ("BETA", "EFFECT"),
    "se": ("SE", "STDERR"),
    "cov_rank": ("COV_RANK", "P_EFF"),
}
META = ("CHR", "SNP", "BP", "CM")


def paths(path: str) -> list[str]:
    return [path.replace("@", str(c)) for c in range(1, 23)] if "@" in path else [path]


def table(spark: SparkSession, path: str) -> DataFrame:
    """A headed table of strings. Runs of blanks separate columns where there are no tabs."""
    head = spark.read.text(paths(path)[0]).limit(1).first()
    if head is None:
        raise ValueError(f"{path} is empty")
    if "\t" in head[0]:
        return spark.read.csv(paths(path), sep="\t", header=True, inferSchema=False)
    names = head[0].split()
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(paths(path)).where(F.trim("value") != "").where(F.col("value") != F.lit(head[0]))
    return lines.select(*[parts[i].alias(n) for i, n in enumerate(names)])


def _named(df: DataFrame, name: str) -> str | None:
    upper = {c.upper(): c for c in df.columns}
    return next((upper[a] for a in ALIASES[name] if a in upper), None)


def sumstats(spark: SparkSession, path: str, trait: str) -> DataFrame:
    """Summary statistics as (trait, snp, a1, a2, n, beta, se, line); what isn't a number becomes null. Files have to name
    the identifier, n, beta and se; cov_rank must be one whole number if it is there."""
    raw = table(spark, path)
    found = {k: _named(raw, k) for k in ALIASES}
    if missing := [k for k in ("snp", "n", "beta", "se") if not found[k]]:
        raise ValueError(f"{path} has no column for {', '.join(missing)}")
    text = lambda k: F.trim(F.col(found[k])).alias(k) if found[k] else F.lit(None).cast("string").alias(k)
    number = lambda k: F.col(found[k]).try_cast("double").alias(k)
    out = raw.select(F.lit(trait).alias("trait"), text("snp"), text("a1"), text("a2"), number("n"), number("beta"), number("se"), F.monotonically_increasing_id().alias("line"), *([number("cov_rank")] if found["cov_rank"] else []))
    if found["cov_rank"]:
        ranks = [r[0] for r in out.select("cov_rank").distinct().limit(2).collect()]
        if len(ranks) > 1 or any(r is None or r != int(r) for r in ranks):
            raise ValueError(f"{path}: cov_rank isn't one whole number")
    return out


def split_columns(columns: list[str]) -> tuple[list[str], list[str]]:
    """The leading metadata columns (chr, snp, bp, cm in any order) and the data columns after them; metadata after data,
    twice, or without chr, snp or bp is an error."""
    upper = [c.upper() for c in columns]
    k = next((i for i, c in enumerate(upper) if c not in META), len(upper))
    if set(upper[k:]) & set(META) or len(set(upper[:k])) < k or not {"CHR", "SNP", "BP"} <= set(upper[:k]):
        raise ValueError(f"metadata columns out of place: {columns}")
    return columns[:k], columns[k:]


def ld_scores(spark: SparkSession, path: str) -> DataFrame:
    """LD scores: chr, snp, bp and the data columns as doubles; rows with a non-finite value are dropped."""
    raw = table(spark, path)
    meta, data = split_columns(raw.columns)
    kinds = {"CHR": "int", "BP": "long", "CM": "double", "SNP": "string"}
    out = raw.select(*[F.col(c).try_cast(kinds[c.upper()]).alias(c.lower()) for c in meta], *[F.col(c).try_cast("double").alias(c) for c in data])
    for c in data:
        out = out.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return out


def annotations(spark: SparkSession, path: str, axis: DataFrame) -> DataFrame:
    """A full annotation table on the axis (snp, ...): one row an axis variant, all of them present once."""
    raw = table(spark, path)
    meta, data = split_columns(raw.columns)
    snp = next(c for c in meta if c.upper() == "SNP")
    out = axis.join(raw.select(F.col(snp).alias("snp"), *[F.col(c).try_cast("double").alias(c) for c in data]), "snp", "left")
    bad = out.groupBy("snp").agg(F.count("*").alias("c"), *[F.max(F.col(c).isNull().cast("int")).alias(c) for c in data])
    wrong = F.col("c") > 1
    for c in data:
        wrong |= F.col(c) == 1
    if (first := bad.where(wrong).first()) is not None:
        raise ValueError(f"{path}: {first['snp']} is missing, repeated or not a number")
    return out


def bim(spark: SparkSession, path: str) -> DataFrame:
    """chr, snp, cm, bp, a1, a2 of a headerless variant file, with line numbers (idx)."""
    return _plain(spark, path, "chr string, snp string, cm double, bp long, a1 string, a2 string")


def fam(spark: SparkSession, path: str) -> DataFrame:
    """fid, iid, father, mother, sex, pheno of a headerless sample file, with line numbers (idx); pairs must be unique."""
    out = _plain(spark, path, "fid string, iid string, father string, mother string, sex int, pheno string")
    if (twice := out.groupBy("fid", "iid").count().where("count > 1").first()) is not None:
        raise ValueError(f"{path}: {twice['fid']} {twice['iid']} is there twice")
    return out


def _plain(spark: SparkSession, path: str, schema: str) -> DataFrame:
    names = [x.split() for x in schema.split(", ")]
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("_id", F.monotonically_increasing_id())
    parts = F.split(F.trim("value"), r"\s+")
    out = lines.select("_id", *[parts[i].try_cast(kind).alias(n) for i, (n, kind) in enumerate(names)])
    # ids grow along the file; numbering them needs the counts of the earlier partitions only
    part = F.shiftright("_id", 33)
    sizes = out.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy("_p").orderBy("_id")) - 1
    return out.withColumn("_p", part).withColumn("_o", own).join(F.broadcast(sizes), "_p").withColumn("idx", F.col("_s") + F.col("_o")).drop("_p", "_s", "_o", "_id")


def pvar(spark: SparkSession, path: str) -> DataFrame:
    """chr, bp, snp, a2 (reference) and a1 (alternative) of a variant file with ## comments; several alternatives are an error."""
    lines = spark.read.text(path).where(~F.col("value").startswith("##"))
    head = lines.where(F.col("value").startswith("#")).first()
    names = (head[0].lstrip("#") if head else "CHROM POS ID REF ALT").split()
    parts = F.split(F.trim("value"), r"\s+")
    at = {n.upper(): parts[i] for i, n in enumerate(names)}
    out = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.regexp_replace(F.upper(at["CHROM"]), "^CHR", "").alias("chr"), at["POS"].try_cast("long").alias("bp"), at["ID"].alias("snp"), at["REF"].alias("a2"), at["ALT"].alias("a1"))
    if (many := out.where(F.col("a1").contains(",")).first()) is not None:
        raise ValueError(f"{path}: {many['snp']} has several alternative alleles")
    return out


def psam(spark: SparkSession, path: str) -> DataFrame:
    """fid and iid of a sample file headed by #FID or #IID."""
    lines = spark.read.text(path).where(~F.col("value").startswith("##"))
    head = lines.where(F.col("value").startswith("#")).first()
    if head is None:
        raise ValueError(f"{path} has no header")
    names = [n.upper() for n in head[0].lstrip("#").split()]
    parts = F.split(F.trim("value"), r"\s+")
    iid = parts[names.index("IID")]
    fid = parts[names.index("FID")] if "FID" in names else F.lit("0")
    return lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(fid.alias("fid"), iid.alias("iid"))


def bed(spark: SparkSession, path: str, samples: int) -> DataFrame:
    """Dosages (path, idx, calls) of two-bit genotype files in variant-major order: counts of the first allele, -1 for
    missing. A partition is a block of variants; see genotypes."""
    rows = [genotypes.read(spark, p, samples) for p in paths(path)]
    calls = F.transform("dosages", lambda x: F.coalesce(x.cast("tinyint"), F.lit(-1).cast("tinyint")))
    return reduce(DataFrame.unionAll, rows).select("path", "idx", calls.alias("calls"))


def write_bed(rows: DataFrame, path: str) -> None:
    """Writes dosages (idx, calls: counts of the first allele, -1 for missing) as one two-bit file in the order of idx, by
    one task and a batch at a time. ``path`` is one that executors can write to."""
    code = np.array([3, 2, 0, 1], dtype=np.uint8)  # of 0, 1, 2 and, last, missing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place = pa.fs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (pa.fs.LocalFileSystem(), path)
        at.create_dir(place.rsplit("/", 1)[0])
        with at.open_output_stream(place) as f:
            f.write(bytes([0x6C, 0x1B, 0x01]))
            for batch in batches:
                if batch.num_rows:
                    calls = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
                    two = np.zeros((len(calls), -(-calls.shape[1] // 4) * 4), dtype=np.uint8)
                    two[:, : calls.shape[1]] = code[calls]
                    f.write((two.reshape(len(calls), -1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=2, dtype=np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([1])], ["done"])

    rows.select("idx", "calls").repartition(1).sortWithinPartitions("idx").mapInArrow(run, "done long").collect()


def pairs(spark: SparkSession, path: str, least: float | None = None) -> DataFrame:
    """Related pairs (iid1, iid2, kinship), unordered and distinct, without self-pairs, of at least a kinship if given."""
    raw = table(spark, path)
    upper = {c.upper(): c for c in raw.columns}
    kinship = F.col(upper["KINSHIP"]).try_cast("double") if "KINSHIP" in upper else F.lit(None).cast("double")
    a, b = F.col(upper["IID1"]), F.col(upper["IID2"])
    out = raw.select(F.least(a, b).alias("iid1"), F.greatest(a, b).alias("iid2"), kinship.alias("kinship")).where("iid1 <> iid2")
    if least is not None:
        out = out.where(F.col("kinship") >= least)
    return out.groupBy("iid1", "iid2").agg(F.max("kinship").alias("kinship"))


def write_ld_scores(scores: DataFrame, path: str) -> None:
    """Tab-separated chr, snp, bp and scores of six decimals, gzipped, sorted by chromosome and position."""
    keys = [c for c in scores.columns if c.lower() in ("chr", "snp", "bp")]
    data = [F.format_string("%.6f", F.col(c).cast("double")).alias(c) for c in scores.columns if c not in keys]
    scores.orderBy("chr", "bp", "snp").select(*[F.col(c).alias(c.upper()) for c in keys], *data).write.mode("errorifexists").csv(path, sep="\t", header=True, compression="gzip")


def write_results(results: DataFrame, path: str) -> None:
    """A tidy result table as Parquet; what is there is never overwritten, and a reader sees all of it or nothing."""
    results.write.mode("errorifexists").parquet(path)
