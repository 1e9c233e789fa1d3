"""How the sources of a language differ in their words: an inverted index that corrects a baseline.

A term is a maximal run of letters and characters beyond ASCII, of which only A-Z are lower-cased. A language keeps the
terms that ``least`` of its documents hold. With c the number of a term's occurrences in a group (a source of a language,
or the whole language), n the sum of c over the kept terms and v their number, the group gives the term
p(c) = 1 + floor(10**9 (c + 1) / (n + v)), and a term in which p meets q weighs f(p, q) = floor((p - q)**2 / q).

The divergence of source a from source b is the sum of f over all kept terms, most of which neither of them holds:

    v f(p_a(0), p_b(0))                                                          the baseline, from three numbers
    + sum over a's terms of f(p_a(c), p_b(0)) - f(p_a(0), p_b(0))                by a's numbers of occurrences
    + sum over b's terms of f(p_a(0), p_b(c)) - f(p_a(0), p_b(0))                by b's
    + sum over terms of both of f(p_a, p_b) - f(p_a, p_b(0)) - f(p_a(0), p_b) + f(p_a(0), p_b(0))    by postings

Terms of a source with the same number of occurrences are corrected at once, and so are terms whose whole posting lists
are alike. A posting list has at most as many rows as the language has sources, so work follows the postings and the
result, which has a row for each two sources of a language, and not the product of sources and vocabulary. Words are
counted before they are shuffled. All numbers are whole: p is a quotient of decimals, f and sums are longs.

Null texts, languages and sources are empty strings. A group without words is a group with n = 0; a language that keeps
no term has divergences of 0 and no terms. Repeated rows count as often as they occur, texts count whole, ties rank by
the item's bytes, no rows give no rows, and other columns of the input aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sgspark.llm.runtime import written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST, TOP = 3, 200


def postings(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The inverted index, a row a kept term of a language: lang, term, n_docs, total and held, an array of (source, count)
    by source; written to the shared folder."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)).alias("words"))
    # each word, then each distinct word once more for the number of documents
    words = rows.select("lang", "source", F.size("words").alias("n"), F.posexplode(F.concat("words", F.array_distinct("words"))).alias("k", "term"))
    counts = words.groupBy("lang", "source", "term").agg(F.count_if(F.col("k") < F.col("n")).alias("count"), F.count_if(F.col("k") >= F.col("n")).alias("docs"))
    index = counts.groupBy("lang", "term").agg(F.sum("docs").alias("n_docs"), F.sum("count").alias("total"), F.sort_array(F.collect_list(F.struct("source", "count"))).alias("held"))
    return written(index.where(F.col("n_docs") >= least), "postings")


def groups(docs: DataFrame, index: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """A row for each source of a language in docs: lang, source, n, and its language's n_all and v; written."""
    occurring = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    own = index.select("lang", F.inline("held")).groupBy("lang", "source").agg(F.sum("count").alias("n"))
    whole = index.groupBy("lang").agg(F.sum("total").alias("n_all"), F.count("*").alias("v"))
    out = occurring.join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    return written(out.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "n_all", "v"))), "groups")


def share(count: str, n: str, v: str) -> Column:
    """1 + floor(10**9 (count + 1) / (n + v)); null where n + v is 0."""
    return F.expr(f"1 + CAST(1000000000 AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0)) div nullif(CAST({n} + {v} AS DECIMAL(20,0)), 0)")


def weight(p: str, q: str) -> str:
    """floor((p - q)**2 / q) of two expressions of whole numbers from 1 to 10**9 + 1."""
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def terms(index: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the ``top`` terms of each source that it uses more than its language does."""
    held = index.select("lang", "term", "total", F.inline("held")).join(groups, ["lang", "source"])
    held = held.withColumns({"p": share("count", "n", "v"), "q": share("total", "n_all", "v")}).where("p > q")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return held.select("lang", "source", F.col("term").alias("item"), F.expr(weight("p", "q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def pairs(index: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): the divergence of each source from each other one (item) of its language."""
    zero = groups.select("lang", "source", "n", "v", share("0", "n", "v").alias("p0"))
    base = zero.alias("a").join(zero.alias("b"), F.expr("a.lang = b.lang AND a.source <> b.source"))
    base = base.select("a.lang", "a.source", F.col("b.source").alias("item"), F.expr(f"CASE WHEN a.v = 0 THEN 0 ELSE a.v * ({weight('a.p0', 'b.p0')}) END").alias("value"))

    # one side alone: a source's numbers of occurrences against the zeros of every other source
    counts = index.select("lang", F.inline("held")).groupBy("lang", "source", "count").agg(F.count("*").alias("m"))
    counts = counts.join(zero, ["lang", "source"]).withColumn("p", share("count", "n", "v"))
    alone = counts.alias("a").join(zero.alias("b"), F.expr("a.lang = b.lang AND a.source <> b.source"))
    first = F.expr(f"a.m * ({weight('a.p', 'b.p0')} - {weight('a.p0', 'b.p0')})")
    second = F.expr(f"a.m * ({weight('b.p0', 'a.p')} - {weight('b.p0', 'a.p0')})")
    alone = alone.select("a.lang", F.inline(F.array(F.struct(F.col("a.source").alias("source"), F.col("b.source").alias("item"), first.alias("value")), F.struct(F.col("b.source").alias("source"), F.col("a.source").alias("item"), second.alias("value")))))

    # both sides: posting lists that are alike once, with their number
    alike = written(index.where(F.size("held") > 1).groupBy("lang", "held").agg(F.count("*").alias("m")).withColumn("id", F.monotonically_increasing_id()), "alike")
    side = alike.select("id", "m", "lang", F.inline("held")).join(zero, ["lang", "source"]).select("id", "m", "lang", "source", "p0", share("count", "n", "v").alias("p"))
    both = side.alias("a").join(side.alias("b"), F.expr("a.id = b.id AND a.source < b.source"))
    over = lambda a, b: F.expr(f"a.m * ({weight(f'{a}.p', f'{b}.p')} - {weight(f'{a}.p', f'{b}.p0')} - {weight(f'{a}.p0', f'{b}.p')} + {weight(f'{a}.p0', f'{b}.p0')})")
    both = both.groupBy("a.lang", F.col("a.source").alias("one"), F.col("b.source").alias("other")).agg(F.sum(over("a", "b")).alias("there"), F.sum(over("b", "a")).alias("back"))
    both = both.select("lang", F.inline(F.expr("array(struct(one AS source, other AS item, there AS value), struct(other AS source, one AS item, back AS value))")))

    summed = base.union(alone.where("value <> 0")).union(both.where("value <> 0")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return summed.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audited(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """pairs() and terms() of docs in one table: lang, source, part ('pair' or 'term'), item, value, rank."""
    index = postings(docs, least)
    of = groups(docs, index)
    parts = [made.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, made in (("pair", pairs(index, of)), ("term", terms(index, of, top)))]
    return parts[0].union(parts[1])
