"""Near-duplicate documents: the forest join on five-word shingles."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sgspark.llm import setjoin
from sgspark.llm.runtime import Guarded, written

SHINGLE, THRESHOLD = 5, Fraction(4, 5)


def _joined(docs: DataFrame, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """The places (id, key, order) of the documents, and the table of the join."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), F.col("doc_id").cast("long").alias("order"), text.alias("text"))
    places = written(rows.select("id", "key", "order"), "places")
    return places, setjoin.joined(rows.select("id", "text"), places, setjoin.word_shingles(SHINGLE), threshold)


def classes(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, class_id (the smallest doc_id of its connected component), n_links (documents with a
    Jaccard coefficient >= threshold, copies included) and n_copies (documents of the same text, itself included).

    docs has to be deterministic from read to read (files, or a written table). Null ids are the class's id only if it has
    no other. Null and empty texts, and texts without words, link with
    nothing; equal ones of them still share a class, as copies. No rows give no rows."""
    places, table = _joined(docs, threshold)
    out = places.select("key", F.col("order").alias("doc_id")).join(table, "key")
    return out.select("doc_id", F.col("class_first").alias("class_id"), "n_links", F.col("mult").alias("n_copies"))


def deduplicated(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The rows and columns of docs, one row of each class: the smallest doc_id's. Of rows that tie in doc_id, the one with
    the smallest hash of its text stays, and of equal rows one. Texts without words, null ones too, all stay."""
    _, table = _joined(docs, threshold)
    winners = table.where("n > 0 and first <=> class_first").groupBy("root", "class_first").agg(F.min("key").alias("_key"))
    winners = winners.select("_key", F.coalesce("class_first", F.lit(0)).alias("_id"), F.col("class_first").isNull().alias("_no_id"))
    own = Guarded(docs)
    doc_id, text = F.col(own["doc_id"]), F.col(own["text"])
    words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) > 0
    # the id is part of the join, so copies of one text are spread out and only those of the class's id meet
    tagged = own.rows.where(words).withColumns({"_key": F.unhex(F.md5(text.cast("binary"))), "_id": F.coalesce(doc_id.cast("long"), F.lit(0)), "_no_id": doc_id.isNull()})
    met = tagged.join(winners, ["_key", "_id", "_no_id"])
    turn = F.row_number().over(W.partitionBy("_key", "_id", "_no_id").orderBy("_id"))
    return own.restored(own.rows.where(~words)).unionAll(own.restored(met.withColumn("_turn", turn).where("_turn = 1")))
