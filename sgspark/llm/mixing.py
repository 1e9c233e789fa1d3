"""Mixing sources to target weights by a time-varying curriculum.

1. Sizes. A document's size is its number of words [^\\x20\\x09-\\x0D]+ (null: 0).
2. Targets. Sources by code point, null last, have the weights WEIGHTS in turn and share ``share`` times all sizes; a
   target stops at ``most`` times its source's size, and the excess is shared again by weight. The fixed point has a
   closed form: in ascending order of cap / weight, sources are full as long as the level of the rest reaches theirs.
3. Stream. Within a source, documents stand in the order of a hash of id and text, epoch after epoch; the mix takes the
   first floor(target) words of that stream.
4. Positions. Each source's weight changes over training time t in [0, 1] along the knots of its schedule. Its integral,
   scaled to the target, is the source's cumulative demand; inverting that at the place of a copy in the stream gives the
   copy's training position. Copies are range-sorted by position.

Prefix sums are made in two levels: documents are summed in BUCKETS hash buckets a source, buckets are summed along the
source, and only documents of one bucket are ordered together. So a source with a third of all rows is spread over as
many tasks as there are buckets. Nothing is collected; what is one row a source stays a table.

Nulls: a null text has size 0 and is taken 0 times; a null source is a source of its own; null ids only tie. Rows equal
in id, text and source share places in either order. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sgspark.llm.runtime import Guarded, written

WEIGHTS = (5, 2, 1)
#: Schedules of the weights, in turn: (time, weight) knots. Early, constant, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order key that name a bucket.
BUCKET_DIGITS = 3


def _turn(rank: Column, values) -> Column:
    out = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(rank % len(values) == i, F.lit(values[i])).otherwise(out)
    return out


def sizes(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs with _size, _source, _name (the source as a key) and _key, the order within a source."""
    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))
    name = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))  # never null, so it can be joined on
    return docs.withColumns({"_name": name, "_size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"), "_source": F.col(source).cast("string"), "_key": key})


def targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """One row a source: _name, _source_size, _rank (from 0), _weight, _target."""
    by = sized.groupBy("_name", "_source").agg(F.sum("_size").alias("_source_size"))
    everything = W.partitionBy()
    by = by.withColumn("_rank", F.row_number().over(everything.orderBy(F.col("_source").asc_nulls_last())) - 1)
    by = by.withColumn("_weight", _turn(F.col("_rank"), weights).cast("double")).withColumn("_cap", F.col("_source_size") * F.lit(float(most)))
    order = everything.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    by = by.withColumns({
        "_place": F.row_number().over(order),
        "_before": F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "_rest": F.sum("_weight").over(order.rowsBetween(0, W.unboundedFollowing)),
        "_all": F.sum("_source_size").over(everything) * F.lit(float(share)),
    })
    by = by.withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_rest"))
    by = by.withColumn("_open", F.min(F.when(F.col("_cap") > F.col("_weight") * F.col("_level"), F.struct("_place", "_level"))).over(everything))
    target = F.when(F.col("_open").isNull() | (F.col("_place") < F.col("_open._place")), F.col("_cap")).otherwise(F.col("_weight") * F.col("_open._level"))
    return by.select("_name", "_source_size", "_rank", "_weight", target.alias("_target"))


def placed(sized: DataFrame, by: DataFrame, slim: DataFrame) -> DataFrame:
    """Rows of sized (of which slim has _name, _size and _key, as a table) with _source_size, _rank, _target, and _at: the words that stand before the row in its source's stream."""
    bucket = F.substring("_key", 1, BUCKET_DIGITS)
    sized = sized.withColumn("_bucket", bucket)
    buckets = slim.withColumn("_bucket", bucket).groupBy("_name", "_bucket").agg(F.sum("_size").alias("_sum"))
    along = W.partitionBy("_name").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("_start", F.coalesce(F.sum("_sum").over(along), F.lit(0))).drop("_sum").join(by, "_name")
    inside = W.partitionBy("_name", "_bucket").orderBy("_key").rowsBetween(W.unboundedPreceding, -1)
    out = sized.withColumn("_within", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(buckets, ["_name", "_bucket"])
    return out.withColumn("_at", F.col("_start") + F.col("_within")).drop("_start", "_within", "_bucket")


def overlap(at: Column, size: Column, until: Column) -> Column:
    """Words of [at, at + size) that are below ``until``."""
    return F.greatest(F.lit(0), F.least(size, until - at))


def taken(most: int = 2) -> Column:
    """Words that the mix takes of a placed row, over its copies."""
    until = F.floor("_target")
    return sum((overlap(F.col("_at") + e * F.col("_source_size"), F.col("_size"), until) for e in range(1, most)), overlap(F.col("_at"), F.col("_size"), until))


def position(offset: Column, schedules=SCHEDULES) -> Column:
    """Training position in [0, 1] of the word at ``offset`` of its source's stream: where the integral of the source's
    schedule, scaled to its target, reaches the offset. Schedules are linear between their knots."""
    out = None
    for turn, knots in reversed(list(enumerate(schedules))):
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        demand = offset / F.col("_target") * F.lit(sum(areas))
        t = None
        for k in reversed(range(len(areas))):
            (t0, w0), (t1, w1) = knots[k], knots[k + 1]
            slope = (w1 - w0) / (t1 - t0)
            u = demand - F.lit(sum(areas[:k]))
            here = F.lit(t0) + F.lit(2.0) * u / (F.lit(w0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2.0 * slope) * u)))
            t = here if t is None else F.when(demand < sum(areas[: k + 1]), here).otherwise(t)
        out = t if out is None else F.when(F.col("_rank") % len(schedules) == turn, t).otherwise(out)
    return out


def mixture(docs: DataFrame, share: float = 1.5, most: int = 2, weights=WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken and first_at, second_at, ... (``most`` columns): the
    training positions of its copies, null for a copy of which the mix takes nothing. Range-sorted by the first position;
    documents that the mix doesn't take come last."""
    own = docs.select("doc_id", "text", "source")
    slim = written(sizes(own).select("doc_id", "_name", "_source", "_size", "_key"), "sizes")
    rows = placed(slim, targets(slim, share, most, weights), slim).withColumn("taken", taken(most).cast("long"))
    until = F.floor("_target")
    at = [F.col("_at") + e * F.col("_source_size") for e in range(most)]
    copies = [F.round(F.when(overlap(x, F.col("_size"), until) > 0, position(x.cast("double"), schedules)), 6).alias(name) for x, name in zip(at, _places(most), strict=True)]
    out = rows.select("doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), "taken", *copies)
    return out.orderBy(F.col("first_at").asc_nulls_last(), "doc_id")


def _places(most: int) -> list[str]:
    return [*("first_at", "second_at", "third_at")[:most], *(f"at_{e + 1}" for e in range(3, most))]


def materialised(docs: DataFrame, share: float = 1.5, most: int = 2, weights=WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """The mixed corpus: the columns of docs, a row for each copy of a document of which the mix takes at least half,
    range-sorted by training position. Copies are whole texts. Documents without words have no place and are left out."""
    own = Guarded(docs)
    sized = sizes(own.rows, own["text"], own["source"], own["doc_id"])
    slim = written(sized.select("_name", "_source", "_size", "_key"), "sizes")
    rows = placed(sized, targets(slim, share, most, weights), slim)
    until = F.floor("_target")
    copies = F.filter(F.array(*[F.struct((F.col("_at") + e * F.col("_source_size")).alias("_from")) for e in range(most)]), lambda c: (overlap(c["_from"], F.col("_size"), until) * 2 >= F.col("_size")) & (F.col("_size") > 0))
    rows = rows.withColumn("_copy", F.explode(copies)).withColumn("_at", F.col("_copy._from").cast("double"))
    return own.restored(rows.withColumn("_t", position(F.col("_at"), schedules)).orderBy("_t", "_key"))
