"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sgspark.llm import classifiers, decontaminate, divergence, embeddings, html_extract, lines, mixing, near_documents, negatives, pieces, substrings, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column, of: int):
    """crc32 of the id as text, modulo ``of``; null ids have none."""
    return F.crc32(column.cast("string")) % of


#: Hash bits and the bound on labelled rows of the classifiers.
QUALITY_BITS, TOXICITY_BITS, MAX_TRAIN = 18, 20, 20_000


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    return classifiers.fit(docs, table(spark, sf_dir, "labels"), "toxic", "noisy-or", lambda i: fold(i, 3) != 1, TOXICITY_BITS, MAX_TRAIN)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document. A null doc_id counts as not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classifiers.toxicity_scored(docs, toxicity_model(spark, docs, sf_dir), TOXICITY_BITS)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "offending")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document. A null doc_id counts as not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifiers.fit(docs, table(spark, sf_dir, "labels"), "quality", "ngram", lambda i: fold(i, 5) != 0, QUALITY_BITS, MAX_TRAIN)
    scored = classifiers.quality_scored(docs, model, QUALITY_BITS)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim benchmark windows in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matched(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM bi),
ms AS (SELECT DISTINCT m FROM bw),
di AS (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m),
hit AS (SELECT di.rid, di.i, di.m, bw.item_id FROM di JOIN bw ON di.m = bw.m AND array_to_string(di.w[di.i:di.i + di.m - 1], ' ') = bw.k),
places AS (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM hit)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM places GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(covered.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.items, '')) AS items_sha256,
  coalesce(covered.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN its USING (rid)
"""

def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, with the training position of each copy, in the order of the first."""
    return mixing.mixture(table(spark, sf_dir, "documents")).drop("source")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM s0),
s2 AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, row_number() OVER o AS place, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, 1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM s2 WINDOW o AS (ORDER BY cap / w, r)),
s4 AS (SELECT *, (total - before) / rest AS level FROM s3),
op AS (SELECT min(place) AS p FROM s4 WHERE cap > w * level),
lv AS (SELECT level AS l FROM s4 WHERE place = (SELECT p FROM op)),
s5 AS (SELECT *, CASE WHEN (SELECT p FROM op) IS NULL OR place < (SELECT p FROM op) THEN cap ELSE w * (SELECT l FROM lv) END AS target FROM s4),
e AS (SELECT row_number() OVER () AS k, d.doc_id, d.size, s5.source_size, s5.target, s5.r,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
f AS (SELECT *, greatest(0, least(size, floor(target) - a)) AS t1, greatest(0, least(size, floor(target) - a - source_size)) AS t2, a / target AS u1, (a + source_size) / target AS u2 FROM e),
g AS (SELECT doc_id, size, source_size, target, t1, t2, r, unnest([1, 2]) AS copy, unnest([t1, t2]) AS words, unnest([u1, u2]) AS u, k AS row FROM f),
h AS (SELECT *, CASE WHEN words > 0 THEN round(CASE r % 3
    WHEN 0 THEN 2.0 * u / (1.5 + sqrt(greatest(0.0, 2.25 - 2.0 * u)))
    WHEN 1 THEN 2.0 * u / (1.0 + sqrt(1.0))
    ELSE 2.0 * u / (0.5 + sqrt(greatest(0.0, 0.25 + 2.0 * u))) END, 6) END AS place FROM g)
SELECT doc_id, size, source_size, target, CAST(t1 + t2 AS BIGINT) AS taken, max(place) FILTER (copy = 1) AS first_at, max(place) FILTER (copy = 2) AS second_at
FROM h GROUP BY row, doc_id, size, source_size, target, t1, t2
"""

def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extracted(pages).select("page_id", "url", "text", "n_chars")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus as sequences in training order, read from the shards."""
    return tokens.stored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def piece_model() -> str:
    """The public merge-type model's file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, with an end id, and what they decode to."""
    docs, model = table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model()
    coded = pieces.encoded(docs, model, decoded="decoded")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ from each other, and each one's terms."""
    return divergence.audited(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all({_LOWER.replace('text', "coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, rid, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
vs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
ns AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (coalesce(ns.n, 0) + vs.v) AS HUGEINT) AS p,
  CAST(1 + 1000000000::HUGEINT * (k.total + 1) // (vs.n + vs.v) AS HUGEINT) AS q
  FROM g JOIN kept k USING (lang) JOIN vs USING (lang) LEFT JOIN ns ON ns.lang = g.lang AND ns.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tm AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pr UNION ALL FROM tm))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector's positives among all vectors."""
    vectors, moved = table(spark, sf_dir, "embeddings"), (F.col("label") + 1) % 10
    vectors = vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label")).alias("label"))
    return negatives.mined(vectors, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(256 * CAST(x AS DOUBLE)))) = 0),
s AS (SELECT a.rid AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.rid AS b, b.vec_id AS id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.rid <> b.rid AND len(a.q) = len(b.q)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id, s.b) AS INTEGER) AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM n WHERE rank <= 5
"""


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that repeat in the corpus."""
    cut = substrings.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
i AS (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
win AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM i),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (k))),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document by five-word shingles at a Jaccard coefficient of 0.8."""
    return near_documents.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
u AS (SELECT min(rid) AS uid, t, any_value(w) AS w, count(*) AS mult, min(doc_id) AS first FROM d GROUP BY t),
sh AS (SELECT DISTINCT uid, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT uid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM u WHERE len(w) > 0)),
sz AS (SELECT uid, count(*) AS n FROM sh GROUP BY uid),
it AS (SELECT a.uid AS a, b.uid AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.uid < b.uid GROUP BY 1, 2),
lk AS (SELECT a, b FROM it JOIN sz x ON x.uid = a JOIN sz y ON y.uid = b WHERE c * 5 >= 4 * (x.n + y.n - c)),
e AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
r AS (SELECT uid, uid AS root FROM u UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.uid),
cl AS (SELECT uid, min(root) AS root FROM r GROUP BY uid),
cf AS (SELECT root, min(first) AS class_id FROM cl JOIN u USING (uid) GROUP BY root),
nl AS (SELECT e.a AS uid, sum(u.mult) AS k FROM e JOIN u ON u.uid = e.b GROUP BY e.a)
SELECT d.doc_id, cf.class_id, CAST(CASE WHEN len(d.w) > 0 THEN u.mult - 1 + coalesce(nl.k, 0) ELSE 0 END AS BIGINT) AS n_links, u.mult AS n_copies
FROM d JOIN u ON u.t = d.t JOIN cl ON cl.uid = u.uid JOIN cf ON cf.root = cl.root LEFT JOIN nl ON nl.uid = u.uid
"""


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that are copies or near copies of earlier ones."""
    found = lines.report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
l0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM d WHERE text IS NOT NULL),
l AS (SELECT *, row_number() OVER (ORDER BY rid, k) AS id FROM l0 WHERE regexp_matches(t, '[^\x20\x09-\x0D]')),
u AS (SELECT min(id) AS uid, t FROM l GROUP BY t),
sh AS (SELECT DISTINCT uid, substr(t, i, 8) AS s FROM (SELECT uid, t, unnest(range(1, greatest(length(t) - 7, 1) + 1)) AS i FROM u)),
sz AS (SELECT uid, count(*) AS n FROM sh GROUP BY uid),
it AS (SELECT a.uid AS a, b.uid AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.uid < b.uid GROUP BY 1, 2),
lk AS (SELECT a, b FROM it JOIN sz x ON x.uid = a JOIN sz y ON y.uid = b WHERE c * 5 >= 4 * (x.n + y.n - c)),
e AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
r AS (SELECT uid, uid AS root FROM u UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.uid),
cl AS (SELECT uid, min(root) AS root FROM r GROUP BY uid),
gone AS (SELECT l.rid, string_agg(CAST(l.k AS VARCHAR), ',' ORDER BY l.k) AS ks, count(*) AS n FROM l JOIN u ON u.t = l.t JOIN cl ON cl.uid = u.uid WHERE l.id <> cl.root GROUP BY l.rid)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, coalesce(ks, '') AS removed_lines
FROM d LEFT JOIN gone USING (rid)
"""


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9."""
    return embeddings.classes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS (SELECT a.rid AS a, b.rid AS b FROM v a JOIN v b ON a.rid <> b.rid AND len(a.x) = len(b.x)
  WHERE isfinite(list_dot_product(a.x, a.x)) AND isfinite(list_dot_product(b.x, b.x)) AND list_dot_product(a.x, a.x) > 0 AND list_dot_product(b.x, b.x) > 0
  AND list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.9),
r AS (SELECT rid, rid AS root FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.rid),
c AS (SELECT r.rid, min(v.vec_id) AS component_id FROM r JOIN v ON v.rid = r.root GROUP BY r.rid),
n AS (SELECT a AS rid, count(*) AS k FROM e GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


QUERIES = {"op6_embeddings": op6_embeddings, "op10_lines": op10_lines, "op2_ngram_join": op2_ngram_join, "op7_substrings": op7_substrings, "op3_tokens": op3_tokens, "op5_html": op5_html, "op4_mixing": op4_mixing, "op9_decontaminate": op9_decontaminate, "op1_toxicity": op1_toxicity, "op8_quality": op8_quality, "op11_sentencepiece": op11_sentencepiece, "op12_divergence": op12_divergence, "op13_negatives": op13_negatives}

ORACLE_SQL: dict[str, str] = {"op2_ngram_join": OP2_SQL, "op4_mixing": OP4_SQL, "op6_embeddings": OP6_SQL, "op10_lines": OP10_SQL, "op7_substrings": OP7_SQL, "op9_decontaminate": OP9_SQL, "op12_divergence": OP12_SQL, "op13_negatives": OP13_SQL}
