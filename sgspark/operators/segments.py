"""Interval data: ancestry segments from run lengths, point lookups, genetic maps, marker grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(calls: DataFrame, owner: str, order: list[str], place: str, code: str) -> DataFrame:
    """Maximal runs of equal codes along an owner's ordered calls: owner, seg, start, stop, code, n."""
    w = W.partitionBy(owner).orderBy(*order)
    new = F.coalesce((F.lag(code).over(w) != F.col(code)).cast("int"), F.lit(1))
    rows = calls.withColumn("_new", new).withColumn("seg", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(owner, "seg").agg(F.min(place).alias("start"), F.max(place).alias("stop"), F.min(code).alias("code"), F.count("*").alias("n"))


def as_of(points: DataFrame, segments: DataFrame, owner: str, at: str, start: str, value: str) -> DataFrame:
    """For each point the value of the owner's last segment that starts at or before it (null before the first).

    One sorted union instead of a range join: segments and points of an owner are ordered together and the last segment's
    value is carried along. Points tie after segments."""
    left = points.withColumns({"_at": F.col(at), "_kind": F.lit(1), "_value": F.lit(None).cast(segments.schema[value].dataType)})
    right = segments.select(owner, F.col(start).alias("_at"), F.col(value).alias("_value")).withColumn("_kind", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    w = W.partitionBy(owner).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("found", F.last("_value", ignorenulls=True).over(w)).where("_kind = 1")
    return out.drop("_at", "_kind", "_value")


def interpolated(points: DataFrame, knots: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Linear interpolation of (x, y) knots of a group at the points' x; beyond the ends the line of the group's mean rate
    goes on; the result never falls along x (running maximum). Adds ``cm``."""
    left = points.withColumn("_kind", F.lit(1))
    right = knots.select(group, x, F.col(y).alias("_y"), F.col(x).alias("_x")).withColumn("_kind", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    back = W.partitionBy(group).orderBy(F.col(x), F.col("_kind")).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(group).orderBy(F.col(x).desc(), F.col("_kind")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(group)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    both = both.withColumns({"x0": last("_x", back), "y0": last("_y", back), "x1": last("_x", ahead), "y1": last("_y", ahead), "xa": F.min("_x").over(whole), "xb": F.max("_x").over(whole), "ya": F.min("_y").over(whole), "yb": F.max("_y").over(whole)})
    rate = F.coalesce(F.try_divide(F.col("yb") - F.col("ya"), F.col("xb") - F.col("xa")), F.lit(0.0))  # one knot: no slope
    cm = F.when(F.col("x0").isNull(), F.col("ya") - rate * (F.col("xa") - F.col(x))).when(F.col("x1").isNull(), F.col("yb") + rate * (F.col(x) - F.col("xb"))).when(F.col("x1") == F.col("x0"), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col(x) - F.col("x0")) / (F.col("x1") - F.col("x0")))
    rows = both.withColumn("cm", cm).where("_kind = 1")
    rows = rows.withColumn("cm", F.max("cm").over(W.partitionBy(group).orderBy(x)))
    return rows.drop("_kind", "_y", "_x", "x0", "y0", "x1", "y1", "xa", "xb", "ya", "yb")


def shares(segments: DataFrame, owner: str, code: str) -> DataFrame:
    """Each owner's share of length in each code: owner, code, length, share."""
    rows = segments.withColumn("_l", F.col("stop") - F.col("start")).groupBy(owner, code).agg(F.sum("_l").alias("length"))
    return rows.withColumn("share", F.try_divide(F.col("length").cast("double"), F.sum("length").over(W.partitionBy(owner))))


def grid(variants: DataFrame, spacing: int) -> DataFrame:
    """Marker positions every ``spacing`` bases from a chromosome's first to its last variant: chr, bp, marker."""
    span = variants.groupBy("chr").agg(F.min("bp").alias("lo"), F.max("bp").alias("hi"))
    return span.select("chr", F.posexplode(F.sequence("lo", "hi", F.lit(spacing).cast("long"))).alias("marker", "bp"))


def interleaved(variants: DataFrame, markers: DataFrame) -> DataFrame:
    """Variants and markers in one order (chr, bp, variants first at ties): chr, bp, name, kind, place in chromosome."""
    both = variants.select("chr", "bp", F.col("snp").alias("name"), F.lit(0).alias("kind")).unionByName(markers.select("chr", "bp", F.concat(F.lit("m"), F.col("chr"), F.lit("_"), F.col("marker")).alias("name"), F.lit(1).alias("kind")))
    return both.withColumn("place", F.row_number().over(W.partitionBy("chr").orderBy("bp", "kind", "name")))


def distance_cells(pairs: DataFrame, width: int) -> DataFrame:
    """Mean r2 by distance cell: cell, pairs, mean_r2."""
    return pairs.groupBy(F.floor(F.abs(F.col("pi") - F.col("pj")) / width).alias("cell")).agg(F.count("*").alias("pairs"), F.avg("r2").alias("mean_r2"))


def smoothed(curve: DataFrame, owner: str, d: str, k: str, half_width: float = 0.75, rel_width: float = 0.1) -> DataFrame:
    """Adds smooth, the mean of k over the owner's points with |d' - d| <= max(half_width, rel_width d). Prefix sums looked
    up at both ends of each point's window: points and ends are ordered together, no point meets another."""
    w = F.greatest(F.lit(float(half_width)), F.lit(float(rel_width)) * F.col(d))
    along = W.partitionBy(owner).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    point = curve.select(owner, F.col(d).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.col(k).cast("double").alias("_k"), F.lit(1).alias("_n"), F.lit(None).cast("double").alias("_d"))
    none = [F.lit(0.0).alias("_k"), F.lit(0).alias("_n")]
    low = curve.select(owner, (F.col(d) - w).cast("double").alias("_at"), F.lit(0).alias("_kind"), *none, F.col(d).cast("double").alias("_d"))
    high = curve.select(owner, (F.col(d) + w).cast("double").alias("_at"), F.lit(2).alias("_kind"), *none, F.col(d).cast("double").alias("_d"))
    run = point.union(low).union(high).withColumns({"_s": F.sum("_k").over(along), "_c": F.sum("_n").over(along)}).where("_kind <> 1")
    sign = F.when(F.col("_kind") == 2, 1).otherwise(-1)
    ends = run.groupBy(owner, "_d").agg((F.sum(sign * F.col("_s")) / F.sum(sign * F.col("_c"))).alias("smooth"))
    return curve.withColumn("_d", F.col(d).cast("double")).join(ends, [owner, "_d"]).drop("_d")


def exponential_fit(curve: DataFrame, d: str, k: str, rates: list[float]) -> DataFrame:
    """Least squares of k = a + h exp(-rate d) over a grid of rates, closed form for each rate: the row of the smallest
    residual, ties by the smaller rate: rate, a, h, sse. Rates at which the curve is constant are left out."""
    rows = curve.select(F.col(d).cast("double").alias("d"), F.col(k).alias("k")).withColumn("rate", F.explode(F.array(*map(F.lit, rates)))).withColumn("x", F.exp(-F.col("rate") * F.col("d")))
    s = rows.groupBy("rate").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("k").alias("mk"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("k")).alias("xk"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    sxx, sxk, skk = (F.col(c) - F.col("n") * F.col(p) * F.col(q) for c, p, q in (("xx", "mx", "mx"), ("xk", "mx", "mk"), ("kk", "mk", "mk")))
    s = s.withColumns({"sxx": sxx, "sxk": sxk, "skk": skk}).where("sxx > 1e-12").withColumn("h", F.col("sxk") / F.col("sxx"))
    s = s.select("rate", (F.col("mk") - F.col("h") * F.col("mx")).alias("a"), "h", (F.col("skk") - F.col("h") * F.col("sxk")).alias("sse"))
    best = s.agg(F.min(F.struct(F.round("sse", 15).alias("sse"), "rate", "a", "h")).alias("b"))
    return best.select("b.rate", "b.a", "b.h", "b.sse")


def ancestry_runs(lines: DataFrame) -> DataFrame:
    """Segments of run-length ancestry lines (iid, line), a line being ``stop:ab stop:ab ...`` with rising stops and two
    one-digit codes: iid, start, stop, anc0, anc1. A token of another form is an error."""
    token = r"^\d+:\d\d$"
    rows = lines.select("iid", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("i", "token"))
    ok = F.when(F.col("token").rlike(token), F.col("token")).otherwise(F.raise_error(F.concat(F.lit("not a run: "), F.col("token"))))
    rows = rows.withColumn("token", ok).withColumn("stop", F.split("token", ":")[0].cast("long")).withColumn("ab", F.split("token", ":")[1])
    w = W.partitionBy("iid").orderBy("i")
    rows = rows.withColumn("start", F.coalesce(F.lag("stop").over(w), F.lit(0)))
    return rows.select("iid", "start", "stop", F.substring("ab", 1, 1).cast("int").alias("anc0"), F.substring("ab", 2, 1).cast("int").alias("anc1"))


def ancestry_dosage(segments_: DataFrame, sites: DataFrame, code: int, width: int = 1 << 16) -> DataFrame:
    """Copies (0, 1, 2) of an ancestry that each sample carries at the sites (site) of its segments: start <= site < stop.
    A bucketed interval join: segments are dealt to the buckets of ``width`` sites that they reach into."""
    copies = (F.col("anc0") == code).cast("int") + (F.col("anc1") == code).cast("int")
    seg = segments_.where("stop > start").select("iid", "start", "stop", copies.alias("copies"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))).alias("b"))
    at = sites.select("site", F.floor(F.col("site") / width).alias("b"))
    return seg.join(at, "b").where("start <= site and site < stop").select("iid", "site", "copies")
