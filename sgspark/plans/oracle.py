"""SQL for the named queries, composed of common table expressions over the same tables."""

from __future__ import annotations

import re

from sgspark.functions.special import normal_density, normal_quantile, two_sided_p

WIDTH, BLOCKS, PROBES = 20, 20, 16

CTES = {
    "n": "SELECT count(*) AS n FROM customer",
    "v0": """SELECT p_partkey AS idx, 'rs' || p_partkey AS snp, CAST(1 + floor(p_partkey * 22 / (SELECT count(*) FROM part)) AS INTEGER) AS chr, p_partkey * 1000 AS bp,
      CAST(p_size <= 25 AS INTEGER) AS low, CAST(p_size > 25 AS INTEGER) AS high, CAST(starts_with(p_type, 'PROMO') AS INTEGER) AS promo, CAST(round(p_retailprice * 100) AS BIGINT) AS price,
      p_brand AS brand, CAST((p_partkey % 12) // 3 AS INTEGER) AS f, CAST((p_partkey % 12) % 3 AS INTEGER) AS s FROM part""",
    "v": """SELECT idx, snp, chr, bp, low, high, promo, price, brand, substr('ACGT', f + 1, 1) AS a1, substr('ACGT', CASE WHEN s >= f THEN s + 2 ELSE s + 1 END, 1) AS a2,
      row_number() OVER (ORDER BY chr, bp, snp) - 1 AS pos FROM v0""",
    "d": "SELECT l_partkey AS idx, o_custkey AS sid, least(2, count(*)) AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "oc": "SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1",
    "s": """SELECT c_custkey AS sid, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment, CAST(round(c_acctbal) AS BIGINT) AS y1,
      CAST(coalesce(cents, 0) // 100000 AS BIGINT) AS y2, CAST(c_mktsegment = 'BUILDING' AS BIGINT) AS "case", CAST(c_nationkey AS BIGINT) - 12 AS env FROM customer LEFT JOIN oc ON c_custkey = o_custkey""",
    "p": "SELECT 'y1' AS trait, sid, y1 AS y FROM s UNION ALL SELECT 'y2', sid, y2 FROM s",
    "ys": "SELECT trait, count(*) AS n, sum(y) AS sy, sum(y * y) AS sy2 FROM p GROUP BY trait",
    "xy": "SELECT trait, idx, sum(g * y) AS sgy, sum(g) AS sg, sum(g * g) AS sg2 FROM d JOIN p USING (sid) GROUP BY trait, idx",
    "gw": """SELECT trait, idx, n, sxy / sxx AS beta, sqrt(greatest(0.0, syy - sxy / sxx * sxy) / ((n - 2) * sxx)) AS se FROM (SELECT trait, idx, n, CAST(n * sg2 - sg * sg AS DOUBLE) AS sxx,
      CAST(n * sgy - sg * sy AS DOUBLE) AS sxy, CAST(n * sy2 - sy * sy AS DOUBLE) AS syy FROM xy JOIN ys USING (trait)) WHERE sxx > 0""",
    "messy": """SELECT trait, idx, idx AS line, n - idx % 7 AS n, beta, CASE WHEN idx % 13 = 0 THEN 0.0 ELSE se END AS se FROM gw
      UNION ALL SELECT trait, idx, idx + 1000000, n - idx % 3 * 5, -beta, se FROM gw WHERE idx % 10 = 0""",
    "qc0": "SELECT *, row_number() OVER (PARTITION BY trait, idx ORDER BY n DESC, line) AS t FROM messy WHERE se > 0 AND n > 0",
    "qc": "SELECT trait, idx, line, n, beta, se, max(n) OVER (PARTITION BY trait) AS n_max FROM qc0 WHERE t = 1",
    "vs": "SELECT idx, sum(g) AS sg, sum(g * g) AS sg2, count(*) AS carriers FROM d GROUP BY idx",
    "vx": "SELECT idx, sg, sg2, n, n * sg2 - sg * sg AS nsxx FROM vs CROSS JOIN n WHERE n * sg2 - sg * sg > 0",
    "r2": """SELECT i, j, r2, r2 - (1 - r2) / (n - 2) AS adj FROM (SELECT pr.i, pr.j, a.n, CAST(a.n * coalesce(sgg, 0) - a.sg * b.sg AS DOUBLE) * CAST(a.n * coalesce(sgg, 0) - a.sg * b.sg AS DOUBLE)
      / (CAST(a.nsxx AS DOUBLE) * CAST(b.nsxx AS DOUBLE)) AS r2 FROM pr JOIN vx a ON a.idx = pr.i JOIN vx b ON b.idx = pr.j LEFT JOIN pg USING (i, j))""",
    "l2": """SELECT r2.i AS idx, sum(adj) AS l2_base, sum(low * adj) AS l2_low, sum(high * adj) AS l2_high FROM r2 JOIN v ON v.idx = r2.j GROUP BY 1""",
    "mo": """SELECT trait, idx, n_star, sqrt(n_star) * beta / sqrt(beta * beta + (n - 2) * se * se) AS z_star, n_star / (n - 1) AS d0 FROM (SELECT *, CAST(max(n) OVER (PARTITION BY trait) - 1 AS DOUBLE) AS n_star FROM gw)""",
    "my": "SELECT trait, idx, n_star, z_star, z_star * z_star - (d0 - 1) AS y FROM mo",
    "pair": "SELECT a.sid AS a, b.sid AS b FROM s a JOIN s b ON b.sid = a.sid + 1 AND a.nation = b.nation",
    "fm": "SELECT sid, nation, y1, env, sid - row_number() OVER (PARTITION BY nation ORDER BY sid) AS run FROM s",
    "fam": "SELECT sid, y1, env, min(sid) OVER (PARTITION BY nation, run) AS family, count(*) OVER (PARTITION BY nation, run) AS size FROM fm",
    "ev": "SELECT user_id, event_id, epoch_us(ts) AS t, event_type FROM events",
    "sg0": "SELECT *, coalesce(CAST(lag(event_type) OVER w <> event_type AS INTEGER), 1) AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)",
    "sg1": "SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM sg0",
    "sg": 'SELECT user_id, CAST(seg AS BIGINT) AS seg, min(t) AS "start", max(t) AS stop, min(event_type) AS code, count(*) AS n FROM sg1 GROUP BY 1, 2',
    "grid": "SELECT chr, CAST(k AS INTEGER) AS marker, lo + k * 2500 AS bp FROM (SELECT chr, lo, unnest(range(0, (hi - lo) // 2500 + 1)) AS k FROM (SELECT chr, min(bp) AS lo, max(bp) AS hi FROM v GROUP BY chr))",
    "od": """SELECT o_orderkey, o_orderpriority AS stratum, CAST(floor(o_totalprice) AS BIGINT) AS value, CAST(o_orderstatus = 'F' AS BIGINT) AS "case" FROM orders""",
    "fl": """SELECT *, CASE idx % 4 WHEN 0 THEN a1 WHEN 1 THEN a2 WHEN 2 THEN translate(a1, 'ACGT', 'TGCA') ELSE translate(a2, 'ACGT', 'TGCA') END AS b1,
      CASE idx % 4 WHEN 0 THEN a2 WHEN 1 THEN a1 WHEN 2 THEN translate(a2, 'ACGT', 'TGCA') ELSE translate(a1, 'ACGT', 'TGCA') END AS b2 FROM v""",
    "code": "SELECT *, instr('ACGT', a1) - 1 AS a, instr('ACGT', a2) - 1 AS b, instr('ACGT', b1) - 1 AS c, instr('ACGT', b2) - 1 AS dd FROM fl",
    "hm": """SELECT *, (a = c AND b = dd) OR (a = dd AND b = c) OR (a = 3 - c AND b = 3 - dd) OR (a = 3 - dd AND b = 3 - c) AS k, NOT (a = c AND b = dd)
      AND ((a = dd AND b = c) OR ((a = 3 - dd AND b = 3 - c) AND NOT (a = 3 - c AND b = 3 - dd))) AS x, a + b = 3 OR c + dd = 3 AS amb FROM code""",
    "e": "SELECT vec_id AS vid, CAST(label AS INTEGER) AS label, k, CAST(round(CAST(embedding[k] AS DOUBLE) * 1000) AS BIGINT) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)",
    "es": "SELECT vid, count(*) AS n, sum(x) AS s, count(*) * sum(x * x) - sum(x) * sum(x) AS nsxx FROM e GROUP BY vid HAVING count(*) * sum(x * x) - sum(x) * sum(x) > 0",
    "ez": "SELECT vid, k, n, CAST(n * x - s AS DOUBLE) / sqrt(CAST(n * nsxx AS DOUBLE)) AS z FROM e JOIN es USING (vid)",
    "eg": "SELECT p.k AS a, q.k AS b, sum(p.z * q.z) AS g FROM ez p JOIN ez q USING (vid) GROUP BY 1, 2",
    "eq": "SELECT p.vid, max(p.n) AS n, sum(p.z * q.z * eg.g) AS raw FROM ez p JOIN ez q USING (vid) JOIN eg ON eg.a = p.k AND eg.b = q.k GROUP BY p.vid",
    "sgn": f"SELECT vid, v AS probe, CASE WHEN substr(md5(vid || ':' || v), 1, 1) < '8' THEN 1 ELSE -1 END AS sign FROM (SELECT vid, unnest(range(0, {PROBES})) AS v FROM es)",
    "et": "SELECT probe, k, sum((n * x - s) * sign) AS t FROM e JOIN es USING (vid) JOIN sgn USING (vid) GROUP BY 1, 2",
    "ey": "SELECT vid, probe, power(CAST(sum((n * x - s) * t) AS DOUBLE) / sqrt(CAST(max(nsxx) AS DOUBLE) * max(n)), 2) AS y FROM e JOIN es USING (vid) JOIN et USING (k) GROUP BY 1, 2",
    "em": "SELECT vid, count(*) AS probes, avg(y) AS mean, (sum(y * y) - sum(y) * sum(y) / count(*)) / (count(*) * (count(*) - 1)) AS variance FROM ey GROUP BY vid",
    "fd": "SELECT sid, y2 AS x, y1 AS y, CAST((row_number() OVER (ORDER BY md5(CAST(sid AS VARCHAR))) - 1) % 5 AS INTEGER) AS fold FROM s",
    "fs": "SELECT fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM fd GROUP BY fold",
    "fr": """SELECT fold, CAST(sum(n) OVER () - n AS DOUBLE) AS n, CAST(sum(sx) OVER () - sx AS DOUBLE) AS sx, CAST(sum(sy) OVER () - sy AS DOUBLE) AS sy, CAST(sum(sxx) OVER () - sxx AS DOUBLE) AS sxx,
      CAST(sum(sxy) OVER () - sxy AS DOUBLE) AS sxy FROM fs""",
    "ff": "SELECT fold, sx / n AS mx, sy / n AS my, CASE WHEN sxx / n - sx / n * (sx / n) > 0 THEN (sxy / n - sx / n * (sy / n)) / (sxx / n - sx / n * (sx / n)) / 1.1 ELSE 0.0 END AS slope FROM fr",
    "fp": "SELECT sid, fold, y, my + slope * (x - mx) AS pred FROM fd JOIN ff USING (fold)",
}


def units(blocks: int) -> str:
    return f"SELECT v.*, b.unit FROM v JOIN (SELECT u AS unit, CAST(floor(u * (m / {blocks})) AS BIGINT) AS lo, CASE WHEN u = {blocks} - 1 THEN m ELSE CAST(floor((u + 1) * (m / {blocks})) AS BIGINT) END AS hi FROM (SELECT CAST(count(*) AS DOUBLE) AS m FROM v), (SELECT unnest(range(0, {blocks})) AS u)) b ON v.pos >= b.lo AND v.pos < b.hi"


def band(width: int) -> dict[str, str]:
    return {
        "pr": f"SELECT a.chr, a.idx AS i, b.idx AS j FROM v a JOIN v b ON a.chr = b.chr AND b.pos >= a.pos - {width} AND b.pos <= a.pos + {width}",
        "pg": f"SELECT x.idx AS i, y.idx AS j, sum(x.g * y.g) AS sgg FROM d x JOIN d y USING (sid) JOIN v a ON a.idx = x.idx JOIN v b ON b.idx = y.idx WHERE a.chr = b.chr AND abs(a.pos - b.pos) <= {width} GROUP BY 1, 2",
    }


def sql(final: str, **own: str) -> str:
    """final with the tables it names, and those that they name, in front."""
    known = CTES | own
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in seen and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                seen.add(name)
                visit(known[name])
                order.append(name)

    visit(final)
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" + final


def _jackknife(keys: str, value: str, full: str) -> str:
    """Delete-one jackknife over rows jr (keys, m, and the expressions of the replicate and the full value)."""
    by = f"PARTITION BY {keys}" if keys else ""
    return f"""SELECT {keys + ', ' if keys else ''}count(*) AS n_units, max(f) AS estimate, sqrt(sum(w * w / (1 - w) * (pv - c) * (pv - c))) AS se FROM (
      SELECT *, sum(w * pv) OVER ({by}) AS c FROM (SELECT *, m / mm AS w, (mm * f - (mm - m) * x) / m AS pv FROM (
      SELECT *, CAST(sum(m) OVER ({by}) AS DOUBLE) AS mm, {value} AS x, {full} AS f FROM jr))) {'GROUP BY ' + keys if keys else ''}"""


def _h2(unit: str) -> str:
    rows = "SELECT my.*, u.unit, l2.l2_base FROM my JOIN u USING (idx) JOIN l2 USING (idx)"
    jr = """SELECT *, sum(m) OVER w AS tm, sum(ay) OVER w AS tay, sum(al) OVER w AS tal, sum(m) OVER w - m AS rm, sum(ay) OVER w - ay AS ray, sum(al) OVER w - al AS ral FROM (
      SELECT trait, unit, count(*) AS m, max(n_star) AS n, sum(y) AS ay, sum(l2_base) AS al FROM hr GROUP BY trait, unit) WINDOW w AS (PARTITION BY trait)"""
    h2 = lambda p: f"(n * {p}ay / {p}m - n) / (n * n * {p}al / ({p}m * tm))"
    jk = _jackknife("trait", h2("r"), h2("t"))
    return sql("SELECT trait, n_units, round(estimate, 8) AS estimate, round(se, 8) AS se FROM jk", u=unit, hr=rows, jr=jr, jk=jk, **band(WIDTH))


_RG_H = lambda p, t: f"({p}ay{t} / CAST({p}m AS DOUBLE) - 1) * n{t} / (n{t} * n{t} * {p}al / ({p}m * tm))"
_RG_C = lambda p: f"({p}ay / CAST({p}m AS DOUBLE) - cc) * sqrt(n1 * n2) / (n1 * n2 * {p}al / ({p}m * tm))"
_OVERLAP = "SELECT count(*) AS n, CAST(count(*) * sum(y1 * y2) - sum(y1) * sum(y2) AS DOUBLE) / sqrt(CAST(count(*) * sum(y1 * y1) - sum(y1) * sum(y1) AS DOUBLE) * CAST(count(*) * sum(y2 * y2) - sum(y2) * sum(y2) AS DOUBLE)) AS c FROM s"
_RANK = "SELECT *, min(b) OVER (PARTITION BY stratum, value) + (count(*) OVER (PARTITION BY stratum, value) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY value) AS b FROM od)"
_LDSC = """SELECT trait, idx, n_star, y - 1 AS q, l2_base AS l, count(*) OVER (PARTITION BY trait) AS m, greatest(l2_base, 1.0) AS ll FROM my JOIN l2 USING (idx)"""
_LDSC_W = "(1 / (2 * power(greatest(1 + greatest(0.0, least(1.0, h)) * n_star / m * ll, 0.001), 2) * ll))"


def _ldsc_round(source: str) -> str:
    return f"SELECT * REPLACE (sum(w * x * q) OVER (PARTITION BY trait) / sum(w * x * x) OVER (PARTITION BY trait) AS h) FROM (SELECT *, {_LDSC_W} AS w, n_star * l / m AS x FROM {source})"


ORACLE_SQL = {
    "v_variants": sql("SELECT chr, idx, snp, bp, low, high, promo, price, brand, a1, a2, pos FROM v"),
    "v_dosage": sql("SELECT idx, sid, CAST(g AS BIGINT) AS g FROM d"),
    "gwas_ols": sql("SELECT trait, idx, n, round(beta, 9) AS beta, round(se, 9) AS se FROM gw"),
    "h2_single": _h2(units(BLOCKS)),
    "h2_chr_jackknife": _h2("SELECT idx, chr AS unit FROM v"),
    "chisq_summary": sql(
        """SELECT trait, count(*) AS n, round(avg(x), 7) AS mean, round(quantile_cont(x, 0.5), 7) AS median, round(max(x), 7) AS max, round(quantile_cont(x, 0.5) / 0.4549364, 7) AS lambda_gc,
        round(quantile_cont(x, 0.9), 7) AS p90, round(quantile_cont(x, 0.99), 7) AS p99, round(quantile_cont(x, 0.999), 7) AS p999 FROM (SELECT trait, power(beta / se, 2) AS x FROM gw) GROUP BY trait"""
    ),
    "top_chisq": sql("SELECT trait, CAST(rank AS INTEGER) AS rank, idx, round(chisq, 6) AS chisq FROM (SELECT trait, idx, chisq, row_number() OVER (PARTITION BY trait ORDER BY chisq DESC, idx) AS rank FROM (SELECT trait, idx, round(power(beta / se, 2), 9) AS chisq FROM gw)) WHERE rank <= 10"),
    "jack_units": sql("SELECT CAST(unit AS INTEGER) AS unit, count(*) AS size, min(pos) AS first, max(pos) AS last FROM u GROUP BY unit", u=units(23)),
    "jack_mass_units": sql(
        """SELECT unit, count(*) AS size, CAST(sum(price) AS BIGINT) AS mass, min(pos) AS first FROM (SELECT *, CAST(least(greatest(ceil(cum * 23 / CAST(total AS DOUBLE)) - 1, 0), 22) AS INTEGER) AS unit FROM (
        SELECT *, sum(price) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(price) OVER () AS total FROM v)) GROUP BY unit"""
    ),
    "jack_delete2": sql("SELECT a.unit || '-' || b.unit AS rep, a.m + b.m AS left_out, CAST((SELECT count(*) FROM v) - a.m - b.m AS BIGINT) AS kept FROM us a JOIN us b ON a.unit < b.unit", u=units(12), us="SELECT unit, count(*) AS m FROM u GROUP BY unit"),
    "sumstats_qc": sql("SELECT trait, idx, line, n, round(beta, 7) AS beta, round(se, 7) AS se, n_max, round(beta / se * sqrt(n / n_max), 7) AS z FROM qc"),
    "exact_moments": sql(
        """SELECT trait, idx, round(z, 7) AS z_star, round(dd, 7) AS d, round(z * z - (dd - 1), 7) AS y FROM (SELECT trait, idx, sqrt(ns) * beta / sqrt(beta * beta + (n - 5) * se * se) AS z, ns / (n - 4) AS dd
        FROM (SELECT *, CAST(n_max - 4 AS DOUBLE) AS ns FROM qc))"""
    ),
    "align_left": sql("SELECT v.idx, snp, pos, line, line IS NOT NULL AS matched FROM v LEFT JOIN (SELECT idx, line FROM qc WHERE trait = 'y1') q ON q.idx = v.idx"),
    "coord_mismatch": sql("SELECT chr, count(*) AS n, min(bp) AS first FROM v WHERE bp % 11000 = 0 GROUP BY chr"),
    "allele_harmonize": sql("SELECT idx, a1, a2, b1, b2, k AND NOT amb AS keep, k AND NOT amb AND x AS flip, k AS keep_all, k AND x AS flip_all FROM hm"),
    "match_variants": sql("SELECT idx, chr, bp, k AND NOT amb AS keep, k AND NOT amb AND x AS flip FROM hm WHERE idx % 9 <> 0"),
    "chisq_filter_clip": sql("SELECT trait, count(*) AS n, CAST(count(*) FILTER (x <= 6) AS BIGINT) AS kept, round(sum(least(x, 6.0)), 6) AS clipped, round(greatest(80.0, max(n) * 0.001), 6) AS auto FROM (SELECT trait, n, power(beta / se, 2) AS x FROM gw) GROUP BY trait"),
    "maf": sql("SELECT idx, carriers, round(least(sg / (2.0 * n), 1 - sg / (2.0 * n)), 10) AS maf FROM vs CROSS JOIN n"),
    "m_5_50": sql(
        """SELECT annot, CAST(sum(a) AS BIGINT) AS m, CAST(sum(CASE WHEN maf > cut THEN a ELSE 0 END) AS BIGINT) AS m_common FROM (SELECT maf, (SELECT quantile_cont(maf, 0.5) FROM mf) AS cut, unnest(['base', 'low', 'high', 'promo']) AS annot,
        unnest([1, low, high, promo]) AS a FROM v JOIN mf USING (idx)) GROUP BY annot""",
        mf="SELECT idx, round(least(sg / (2.0 * n), 1 - sg / (2.0 * n)), 10) AS maf FROM vs CROSS JOIN n",
    ),
    "ld_window_r2": sql("SELECT i, j, round(r2, 10) AS r2, round(adj, 10) AS adj FROM r2", **band(5)),
    "ld_score_window": sql("SELECT idx, round(l2_base, 8) AS l2_base, round(l2_low, 8) AS l2_low, round(l2_high, 8) AS l2_high FROM l2", **band(WIDTH)),
    "ld_score_allpairs": sql("SELECT vid, round(raw - ((SELECT count(*) FROM eq) - raw) / (n - 2), 6) AS l2 FROM eq"),
    "ld_sketch_variance": sql("SELECT vid, probes, round(mean / (SELECT max(mean) FROM em), 8) AS mean, round(variance / power((SELECT max(mean) FROM em), 2), 8) AS variance FROM em"),
    "residual_variance_v": sql(
        """SELECT idx, round(r2, 10) AS r2, round(CASE WHEN xx > 0 THEN (1 - r2) * (n - 1) / (n - 2) ELSE 0.0 END, 10) AS v FROM (SELECT idx, n, xx, CASE WHEN xx > 0 AND cc > 0 THEN xc * xc / (xx * cc) ELSE 0.0 END AS r2 FROM (
        SELECT idx, n, CAST(n * sg2 - sg * sg AS DOUBLE) AS xx, CAST(n * sc2 - sc * sc AS DOUBLE) AS cc, CAST(n * sgc - sg * sc AS DOUBLE) AS xc FROM (SELECT idx, sum(g) AS sg, sum(g * g) AS sg2, sum(g * nation) AS sgc FROM d JOIN s USING (sid) GROUP BY idx),
        (SELECT count(*) AS n, sum(nation) AS sc, sum(nation * nation) AS sc2 FROM s)))"""
    ),
    "h2_partitioned": sql(
        """SELECT trait, m, round(s1, 6) AS sigma_1, round(s2, 6) AS sigma_2, round(s1 + s2, 6) AS total, round((s1 / (s1 + s2)) / (a1 / m), 6) AS enrichment_1, round((s2 / (s1 + s2)) / (a2 / m), 6) AS enrichment_2 FROM (
        SELECT *, (b1 * t22 - b2 * t12) / (t11 * t22 - t12 * t12) AS s1, (b2 * t11 - b1 * t12) / (t11 * t22 - t12 * t12) AS s2 FROM (SELECT trait, m, a1, a2, n * n * l11 / (a1 * a1) AS t11, n * n * l22 / (a2 * a2) AS t22,
        (n * n * l12 / (a1 * a2) + n * n * l21 / (a2 * a1)) / 2 AS t12, n * y1 / a1 - n AS b1, n * y2 / a2 - n AS b2 FROM hs))""",
        hs="""SELECT trait, count(*) AS m, max(n_star) AS n, CAST(sum(low) AS DOUBLE) AS a1, CAST(sum(high) AS DOUBLE) AS a2, sum(low * y) AS y1, sum(high * y) AS y2, sum(low * l2_low) AS l11, sum(low * l2_high) AS l12, sum(high * l2_low) AS l21,
        sum(high * l2_high) AS l22 FROM my JOIN v USING (idx) JOIN l2 USING (idx) GROUP BY trait""",
        **band(WIDTH),
    ),
    "ldsc_irwls": sql(
        "SELECT trait, max(m) AS m, round(max(h), 7) AS h2 FROM q3 GROUP BY trait",
        lr=_LDSC,
        q0="SELECT *, m * sum(q) OVER (PARTITION BY trait) / (n_star * sum(l) OVER (PARTITION BY trait)) AS h FROM lr",
        q1=_ldsc_round("q0"),
        q2=_ldsc_round("(SELECT trait, idx, n_star, q, l, m, ll, h FROM q1)"),
        q3=_ldsc_round("(SELECT trait, idx, n_star, q, l, m, ll, h FROM q2)"),
        **band(WIDTH),
    ),
    "overlap_cov": sql("SELECT n, round(c, 10) AS c FROM ov", ov=_OVERLAP),
    "rg_supplied_c": sql(
        "SELECT n_units, round(estimate, 7) AS covariance, round(se, 7) AS se, round(CASE WHEN h1 * h2 > 0 THEN estimate / sqrt(h1 * h2) END, 7) AS rg FROM jk CROSS JOIN hh",
        u=units(BLOCKS),
        ov=_OVERLAP,
        t1="SELECT * FROM my WHERE trait = 'y1'",
        t2="SELECT * FROM my WHERE trait = 'y2'",
        ru="SELECT unit, count(*) AS m, sum(l2_base) AS al, sum(t1.z_star * t2.z_star) AS ay, sum(t1.y) AS ay1, sum(t2.y) AS ay2, max(t1.n_star) AS n1, max(t2.n_star) AS n2 FROM t1 JOIN t2 USING (idx) JOIN u USING (idx) JOIN l2 USING (idx) GROUP BY unit",
        jr="SELECT *, (SELECT c FROM ov) AS cc, " + ", ".join(f"sum({c}) OVER () AS t{c}, sum({c}) OVER () - {c} AS r{c}" for c in ("m", "al", "ay", "ay1", "ay2")) + " FROM ru",
        jk=_jackknife("", _RG_C("r"), _RG_C("t")),
        hh=f"SELECT max({_RG_H('t', 1)}) AS h1, max({_RG_H('t', 2)}) AS h2 FROM jr",
        **band(WIDTH),
    ),
    "family_components": sql("SELECT sid AS id, family FROM fam WHERE size > 1"),
    "pair_closure": sql("SELECT a.family, a.sid AS a, b.sid AS b FROM fam a JOIN fam b ON a.family = b.family AND a.sid < b.sid"),
    "rel_m_per_snp": sql(
        "SELECT x.idx, count(*) AS pairs, round(CAST(2 * sum(x.g * p.y1 * y.g * q.y1) AS DOUBLE) / (SELECT n FROM n), 8) AS rel_m FROM pair JOIN d x ON x.sid = pair.a JOIN d y ON y.sid = pair.b AND y.idx = x.idx JOIN s p ON p.sid = pair.a JOIN s q ON q.sid = pair.b GROUP BY x.idx"
    ),
    "sib_centering": sql("SELECT sid, family, size, round(y1 - avg(y1) OVER (PARTITION BY family), 8) AS y1_centred, round(env - avg(env) OVER (PARTITION BY family), 8) AS env_centred FROM fam WHERE size > 1"),
    "env_moments": sql("SELECT count(*) AS n, round(avg(power(env - m, 2)), 6) AS m2, round(avg(power(env - m, 4)), 6) AS m4, round(avg((env - m) * (y1 - y)), 6) AS cov FROM s, (SELECT avg(env) AS m, avg(y1) AS y FROM s)"),
    "gxe_scores": sql("SELECT idx, CAST(sum(g * y1) AS BIGINT) AS s_x, CAST(sum(g * env * y1) AS BIGINT) AS s_w, CAST(sum(g * g) AS BIGINT) AS xx, CAST(sum(g * env * g * env) AS BIGINT) AS ww, CAST(sum(g * g * env) AS BIGINT) AS xw FROM d JOIN s USING (sid) GROUP BY idx"),
    "segments_from_runs": sql('SELECT user_id, seg, "start", stop, code, n FROM sg'),
    "global_ancestry": sql('SELECT user_id, code, length, round(CASE WHEN sum(length) OVER (PARTITION BY user_id) > 0 THEN length / CAST(sum(length) OVER (PARTITION BY user_id) AS DOUBLE) END, 9) AS share FROM (SELECT user_id, code, CAST(sum(stop - "start") AS BIGINT) AS length FROM sg GROUP BY 1, 2)'),
    "asof_segment": sql(
        "SELECT p.user_id, p.event_id, p.t, s.ref AS found FROM pt p ASOF LEFT JOIN sn s ON p.user_id = s.user_id AND p.t >= s.t",
        pt="SELECT * FROM ev WHERE event_type = (SELECT min(event_type) FROM events)",
        sn="SELECT user_id, t, max(event_id) AS ref FROM ev WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY 1, 2",
    ),
    "genetic_map_interp": sql(
        "SELECT chr, idx, bp, round(max(c) OVER (PARTITION BY chr ORDER BY bp), 8) AS cm FROM gi",
        gb="SELECT idx, chr, CAST(bp AS DOUBLE) AS bp FROM v",
        gk="SELECT chr, bp, bp / 1e6 * 1.3 + sqrt(bp) / 1e3 AS y FROM gb WHERE idx % 7 = 3",
        gr="SELECT chr, min(bp) AS xa, max(bp) AS xb, arg_min(y, bp) AS ya, arg_max(y, bp) AS yb FROM gk GROUP BY chr",
        g0="SELECT gb.*, gk.bp AS x0, gk.y AS y0 FROM gb ASOF LEFT JOIN gk ON gb.chr = gk.chr AND gb.bp >= gk.bp",
        g1="SELECT g0.*, gk.bp AS x1, gk.y AS y1 FROM g0 ASOF LEFT JOIN gk ON g0.chr = gk.chr AND g0.bp <= gk.bp",
        gi="""SELECT chr, idx, bp, CASE WHEN x0 IS NULL THEN ya - coalesce((yb - ya) / nullif(xb - xa, 0), 0) * (xa - bp) WHEN x1 IS NULL THEN yb + coalesce((yb - ya) / nullif(xb - xa, 0), 0) * (bp - xb) WHEN x0 = x1 THEN y0
        ELSE y0 + (y1 - y0) * (bp - x0) / (x1 - x0) END AS c FROM g1 JOIN gr USING (chr)""",
    ),
    "marker_grid": sql("SELECT chr, marker, bp FROM grid"),
    "merge_interleave": sql(
        "SELECT chr, bp, name, kind, CAST(row_number() OVER (PARTITION BY chr ORDER BY bp, kind, name) AS INTEGER) AS place FROM bo",
        bo="SELECT chr, bp, snp AS name, 0 AS kind FROM v UNION ALL SELECT chr, bp, 'm' || chr || '_' || marker, 1 FROM grid",
    ),
    "ld_curve_cells": sql("SELECT CAST(floor(abs(a.pos - b.pos) / 2) AS BIGINT) AS cell, count(*) AS pairs, round(avg(r2), 9) AS mean_r2 FROM r2 JOIN v a ON a.idx = r2.i JOIN v b ON b.idx = r2.j WHERE i < j GROUP BY 1", **band(10)),
    "pair_tests": sql(
        f"SELECT a, b, carriers, round(score, 6) AS score, round(information, 6) AS information, round(z, 6) AS z, round({two_sided_p('z')}, 6) AS p FROM (SELECT *, score / sqrt(information) AS z FROM pi WHERE information > 0)",
        ps="SELECT i AS a, j AS b, count(*) AS carriers, sum(x.g * y.g) AS sf, sum(x.g * y.g * x.g * y.g) AS sf2, sum(x.g * y.g * s.y1) AS sfy FROM pr JOIN d x ON x.idx = pr.i JOIN d y ON y.idx = pr.j AND y.sid = x.sid JOIN s ON s.sid = x.sid WHERE i < j GROUP BY 1, 2",
        pt="SELECT count(*) AS n, sum(y1) AS sy, sum(y1 * y1) AS sy2 FROM s",
        pi="SELECT a, b, carriers, CAST(n * sfy - sf * sy AS DOUBLE) / n AS score, CAST(n * sf2 - sf * sf AS DOUBLE) / n * (CAST(n * sy2 - sy * sy AS DOUBLE) / n / (n - 1)) AS information FROM ps CROSS JOIN pt",
        **band(3),
    ),
    "blom_ranks": sql(f"SELECT o_orderkey, stratum, rank, n, round({normal_quantile('((rank - 0.375) / (n + 0.25))')}, 7) AS z FROM rk", rk="SELECT * REPLACE (CAST(rank AS DOUBLE) AS rank) FROM (" + _RANK + ")"),
    "rank_bins": sql(
        "SELECT o_orderkey, stratum, CAST(len(list_filter(edges, lambda x: x <= value)) AS INTEGER) AS bin FROM od JOIN eb USING (stratum)",
        eb="SELECT stratum, list_distinct(quantile_cont(value, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS edges FROM od GROUP BY stratum",
    ),
    "auc_delong": sql(
        """SELECT stratum, n1 AS cases, n0 AS controls, round(avg(v) FILTER ("case" = 1), 8) AS auc, round(sqrt(var_samp(v) FILTER ("case" = 1) / n1 + var_samp(v) FILTER ("case" = 0) / n0), 8) AS se FROM (
        SELECT *, CASE WHEN "case" = 1 THEN (rank - ro) / n0 ELSE 1 - (rank - ro) / n1 END AS v FROM ro) GROUP BY stratum, n1, n0 HAVING n1 > 1 AND n0 > 1""",
        rk=_RANK,
        ro="""SELECT *, min(b2) OVER (PARTITION BY stratum, "case", value) + (count(*) OVER (PARTITION BY stratum, "case", value) - 1) / 2.0 AS ro, CAST(sum("case") OVER (PARTITION BY stratum) AS BIGINT) AS n1,
        CAST(sum(1 - "case") OVER (PARTITION BY stratum) AS BIGINT) AS n0 FROM (SELECT *, row_number() OVER (PARTITION BY stratum, "case" ORDER BY value) AS b2 FROM rk)""",
    ),
    "class_kernels": sql(
        """SELECT CAST(g AS BIGINT) AS groups, round(t / (g * (g - 1)), 3) AS theta, round(4 * (g - 2) / (g * (g - 1)) * ((rr - tt) / (g * (g - 1) * (g - 2)) - mm) + 2 / (g * (g - 1)) * (tt / (g * (g - 1)) - mm), 3) AS variance,
        round(2 * tt / power(g * (g - 1), 2), 3) AS null_variance FROM (SELECT *, (t * t - 4 * rr + 2 * tt) / (g * (g - 1) * (g - 2) * (g - 3)) AS mm FROM ks)""",
        km="SELECT label, k, sum(x) AS x FROM e GROUP BY 1, 2",
        kk="SELECT p.label AS a, q.label AS b, CAST(sum(p.x * q.x) AS DOUBLE) / 1e6 AS t FROM km p JOIN km q USING (k) WHERE p.label <> q.label GROUP BY 1, 2",
        kr="SELECT a, sum(t) AS r, sum(t * t) AS q FROM kk GROUP BY a",
        ks="SELECT CAST(count(*) AS DOUBLE) AS g, sum(r) AS t, sum(r * r) AS rr, sum(q) AS tt FROM kr",
    ),
    "risk_z_d": sql(
        f"""SELECT n, round(share, 6) AS share, round(spread, 6) AS spread, round(d, 6) AS d, round((power(n * d * d, 2) - n * power(d, 4)) / (n * (n - 1)), 6) AS pair_factor FROM (SELECT n, share, sqrt(share * (1 - share)) AS spread,
        {normal_density('(' + normal_quantile('CAST(0.1 AS DOUBLE)') + ')')} * sqrt(share * (1 - share)) / (0.1 * (1 - 0.1)) AS d FROM (SELECT count(*) AS n, avg("case") AS share FROM s))"""
    ),
    "pcgc_scores": sql(
        """SELECT idx, CAST(sum(v) AS BIGINT) AS s, CAST(sum(v * v) AS BIGINT) AS own, CAST(sum(v) * sum(v) - sum(v * v) AS BIGINT) AS rhs FROM (SELECT idx, g * (t.n * "case" - k) AS v FROM d JOIN s USING (sid), (SELECT count(*) AS n, sum("case") AS k FROM s) t) GROUP BY idx"""
    ),
    "pgs_score": sql(
        "SELECT s.sid, coalesce(carried, 0) AS carried, round((SELECT -sum(w * mean * inv) FROM wt) + coalesce(part, 0), 8) AS score FROM s LEFT JOIN cp ON cp.sid = s.sid",
        sc="SELECT idx, CAST(sg AS DOUBLE) / n AS mean, sqrt(n * (n - 1) / CAST(nsxx AS DOUBLE)) AS inv FROM vx",
        wt="SELECT idx, CASE WHEN a1 = b1 AND a2 = b2 THEN (idx % 5 - 2) / 100.0::DOUBLE ELSE -(idx % 5 - 2) / 100.0::DOUBLE END AS w, mean, inv FROM fl JOIN sc USING (idx) WHERE (a1 = b1 AND a2 = b2) OR (a1 = b2 AND a2 = b1)",
        cp="SELECT sid, sum(g * w * inv) AS part, count(*) AS carried FROM d JOIN wt USING (idx) GROUP BY sid",
    ),
    "ridge_calibration": sql("SELECT sid, fold, round(pred, 6) AS pred FROM fp"),
    "r2_gain": sql("SELECT count(*) AS n, round(avg(dd) / var_pop(y), 8) AS gain, round(stddev_samp(dd) / sqrt(count(*)) / var_pop(y), 8) AS se FROM (SELECT y, power(y - (SELECT avg(y) FROM fd), 2) - power(y - pred, 2) AS dd FROM fp)"),
    "setops_samples": sql(
        """SELECT 'both' AS part, count(*) AS n, CAST(sum(sid) AS BIGINT) AS ids FROM (SELECT sid FROM s WHERE y2 > 0 INTERSECT SELECT sid FROM s WHERE nation < 15)
        UNION ALL SELECT 'first', count(*), CAST(sum(sid) AS BIGINT) FROM (SELECT sid FROM s WHERE y2 > 0 EXCEPT ALL SELECT sid FROM s WHERE nation < 15)
        UNION ALL SELECT 'second', count(*), CAST(sum(sid) AS BIGINT) FROM (SELECT sid FROM s WHERE nation < 15 EXCEPT ALL SELECT sid FROM s WHERE y2 > 0)
        UNION ALL SELECT 'any', count(*), CAST(sum(sid) AS BIGINT) FROM (SELECT sid FROM s WHERE y2 > 0 UNION SELECT sid FROM s WHERE nation < 15)"""
    ),
    "rollup_annotations": sql("SELECT chr, brand, count(*) AS m, CAST(sum(price) AS BIGINT) AS mass FROM v GROUP BY ROLLUP (chr, brand)"),
    "trait_order": sql("SELECT trait, count(*) AS n, CAST(count(*) FILTER (y > md) AS BIGINT) AS above, min(sid) AS first FROM p JOIN (SELECT trait, quantile_cont(y, 0.5) AS md FROM p GROUP BY trait) USING (trait) GROUP BY trait"),
    "stream_unit_stats": "SELECT user_id % 16 AS unit, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS hundredths FROM events GROUP BY 1, 2",
}

_HS = """SELECT trait, count(*) AS m, max(n_star) AS n, CAST(sum(low) AS DOUBLE) AS a1, CAST(sum(high) AS DOUBLE) AS a2, sum(low * y) AS y1, sum(high * y) AS y2, sum(low * l2_low) AS l11, sum(low * l2_high) AS l12, sum(high * l2_low) AS l21,
  sum(high * l2_high) AS l22, stddev_pop(low) AS sd1, stddev_pop(high) AS sd2 FROM my JOIN v USING (idx) JOIN l2 USING (idx) GROUP BY trait"""
_SIGMA = """SELECT *, (b1 * t22 - b2 * t12) / (t11 * t22 - t12 * t12) AS s1, (b2 * t11 - b1 * t12) / (t11 * t22 - t12 * t12) AS s2 FROM (SELECT trait, m, a1, a2, sd1, sd2, n * n * l11 / (a1 * a1) AS t11, n * n * l22 / (a2 * a2) AS t22,
  (n * n * l12 / (a1 * a2) + n * n * l21 / (a2 * a1)) / 2 AS t12, n * y1 / a1 - n AS b1, n * y2 / a2 - n AS b2 FROM hs)"""
_TRACE = "SELECT trait, unit, max(n_star) AS n, CAST(sum(low) AS DOUBLE) AS a1, CAST(sum(high) AS DOUBLE) AS a2, sum(low * l2_high) AS l12, sum(high * l2_low) AS l21 FROM my JOIN u USING (idx) JOIN l2 USING (idx) GROUP BY trait, unit"
_SHIFTED = "SELECT my.trait, my.idx, n_star, y - coalesce(rel, 0) AS y, u.unit, l2.l2_base FROM my JOIN u USING (idx) JOIN l2 USING (idx) LEFT JOIN rl USING (idx) WHERE my.trait = 'y1'"
_JR = """SELECT *, sum(m) OVER w AS tm, sum(a) OVER w AS ta, sum(ay) OVER w AS tay, sum(al) OVER w AS tal, sum(a) OVER w - a AS ra, sum(ay) OVER w - ay AS ray, sum(al) OVER w - al AS ral FROM hu WINDOW w AS (PARTITION BY trait)"""
_H2 = lambda p: f"(n * {p}ay / {p}a - n) / (n * n * {p}al / ({p}a * ta))"
_H2_OUT = "SELECT trait, n_units, round(estimate, {0}) AS estimate, round(se, {0}) AS se FROM jk"


def _cohort(k: int) -> str:
    return f"""SELECT a, b, CAST(n * sfy - sf * sy AS DOUBLE) / n AS score, CAST(n * sf2 - sf * sf AS DOUBLE) / n * (CAST(n * sy2 - sy * sy AS DOUBLE) / n / (n - 1)) AS information FROM (
      SELECT i AS a, j AS b, count(*) AS carriers, sum(x.g * y.g) AS sf, sum(x.g * y.g * x.g * y.g) AS sf2, sum(x.g * y.g * s.y1) AS sfy FROM pr JOIN d x ON x.idx = pr.i JOIN d y ON y.idx = pr.j AND y.sid = x.sid JOIN s ON s.sid = x.sid
      WHERE i < j AND s.sid % 2 = {k} GROUP BY 1, 2), (SELECT count(*) AS n, sum(y1) AS sy, sum(y1 * y1) AS sy2 FROM s WHERE sid % 2 = {k})"""


ORACLE_SQL |= {
    "h2_tau_star": sql(
        "SELECT trait, round(s1 / a1, 8) AS tau_1, round(s2 / a2, 8) AS tau_2, round(s1 / a1 * sd1 / ((s1 + s2) / m), 8) AS tau_star_1, round(s2 / a2 * sd2 / ((s1 + s2) / m), 8) AS tau_star_2 FROM sgm",
        hs=_HS,
        sgm=_SIGMA,
        **band(WIDTH),
    ),
    "trace_symmetrised": sql(
        "SELECT trait, round(t12, 5) AS t12, round(t21, 5) AS t21, round(w, 5) AS w, round(w * t12 + (1 - w) * t21, 5) AS t FROM (SELECT *, CASE WHEN v1 + v2 - 2 * c > 0 THEN least(greatest((v2 - c) / (v1 + v2 - 2 * c), 0.0), 1.0) ELSE 0.5 END AS w FROM tv)",
        u=units(BLOCKS),
        tu=_TRACE,
        tr="SELECT *, sum(a1) OVER w AS ta1, sum(a2) OVER w AS ta2, sum(l12) OVER w AS tl12, sum(l21) OVER w AS tl21 FROM tu WINDOW w AS (PARTITION BY trait)",
        tx="SELECT trait, n * n * (tl12 - l12) / ((ta1 - a1) * ta2) AS x, n * n * (tl21 - l21) / ((ta2 - a2) * ta1) AS y, n * n * tl12 / (ta1 * ta2) AS fx, n * n * tl21 / (ta2 * ta1) AS fy FROM tr",
        tv="SELECT trait, max(fx) AS t12, max(fy) AS t21, var_pop(x) AS v1, var_pop(y) AS v2, covar_pop(x, y) AS c FROM tx GROUP BY trait",
        **band(WIDTH),
    ),
    "h2_delete_two": sql(
        "SELECT trait, count(*) AS replicates, round(max(full_), 8) AS estimate, round(sqrt(avg((tm - l) / l * (x - full_) * (x - full_))), 8) AS se FROM dp GROUP BY trait",
        u=units(BLOCKS),
        hu="SELECT trait, unit, max(n_star) AS n, CAST(count(*) AS DOUBLE) AS m, sum(y) AS ay, sum(l2_base) AS al FROM my JOIN u USING (idx) JOIN l2 USING (idx) GROUP BY trait, unit",
        ht="SELECT trait, sum(m) AS tm, sum(ay) AS tay, sum(al) AS tal FROM hu GROUP BY trait",
        dp="""SELECT a.trait, ht.tm, a.m + b.m AS l, (a.n * tay / tm - a.n) / (a.n * a.n * tal / (tm * tm)) AS full_,
        (a.n * (tay - a.ay - b.ay) / (tm - a.m - b.m) - a.n) / (a.n * a.n * (tal - a.al - b.al) / ((tm - a.m - b.m) * tm)) AS x FROM hu a JOIN hu b ON a.trait = b.trait AND a.unit < b.unit JOIN ht ON ht.trait = a.trait""",
        **band(WIDTH),
    ),
    "h2_rel_m": sql(
        _H2_OUT.format(8),
        u=units(BLOCKS),
        rl="SELECT x.idx, CAST(2 * sum(x.g * p.y1 * y.g * q.y1) AS DOUBLE) / (SELECT n FROM n) / (SELECT CAST(sum(y1 * y1) AS DOUBLE) FROM s) AS rel FROM pair JOIN d x ON x.sid = pair.a JOIN d y ON y.sid = pair.b AND y.idx = x.idx JOIN s p ON p.sid = pair.a JOIN s q ON q.sid = pair.b GROUP BY x.idx",
        hr=_SHIFTED,
        hu="SELECT trait, unit, count(*) AS m, CAST(count(*) AS DOUBLE) AS a, max(n_star) AS n, sum(y) AS ay, sum(l2_base) AS al FROM hr GROUP BY trait, unit",
        jr=_JR,
        jk=_jackknife("trait", _H2("r"), _H2("t")),
        **band(WIDTH),
    ),
    "h2_v_weighted": sql(
        _H2_OUT.format(7),
        u=units(BLOCKS),
        vv="""SELECT idx, CASE WHEN xx > 0 THEN (1 - CASE WHEN xx > 0 AND cc > 0 THEN xc * xc / (xx * cc) ELSE 0.0 END) * (n - 1) / (n - 2) ELSE 0.0 END AS v FROM (
        SELECT idx, n, CAST(n * sg2 - sg * sg AS DOUBLE) AS xx, CAST(n * sc2 - sc * sc AS DOUBLE) AS cc, CAST(n * sgc - sg * sc AS DOUBLE) AS xc FROM (SELECT idx, sum(g) AS sg, sum(g * g) AS sg2, sum(g * nation) AS sgc FROM d JOIN s USING (sid) GROUP BY idx),
        (SELECT count(*) AS n, sum(nation) AS sc, sum(nation * nation) AS sc2 FROM s))""",
        lv="SELECT r2.i AS idx, sum(vv.v * adj) AS l FROM r2 JOIN vv ON vv.idx = r2.j GROUP BY 1",
        hu="SELECT trait, unit, count(*) AS m, sum(vv.v) AS a, max(n_star) AS n, sum(vv.v * y) AS ay, sum(vv.v * l) AS al FROM my JOIN u USING (idx) JOIN vv USING (idx) JOIN lv USING (idx) GROUP BY trait, unit",
        jr=_JR,
        jk=_jackknife("trait", _H2("r"), _H2("t")),
        **band(WIDTH),
    ),
    "pcgc_fit": sql(
        "SELECT CAST(m AS BIGINT) AS m, round(b / m, 6) AS b, round(n * n * l / (m * m) * dd * dd, 6) AS h, round(b / m / (n * n * l / (m * m) * dd * dd), 6) AS estimate FROM pf",
        pc='SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum("case") AS DOUBLE) / count(*) AS share FROM s',
        pv='SELECT sid, ("case" - share) / sqrt(share * (1 - share)) AS v FROM s CROSS JOIN pc',
        pb="SELECT idx, sum(g * v) AS gv, sum(g * v * v) AS gv2, sum(g * v * g * v) AS g2v2 FROM d JOIN pv USING (sid) GROUP BY idx",
        pf=f"""SELECT CAST(count(*) AS DOUBLE) AS m, max(pc.n) AS n, sum(l2_base) AS l, sum(inv2 * (gv * gv - (g2v2 - 2 * mean * gv2 + mean * mean * pc.n))) AS b, max({normal_density('(' + normal_quantile('CAST(0.1 AS DOUBLE)') + ')')} * sqrt(share * (1 - share)) / (0.1 * (1 - 0.1))) AS dd
        FROM pb JOIN (SELECT idx, CAST(sg AS DOUBLE) / n AS mean, n * (n - 1) / CAST(nsxx AS DOUBLE) AS inv2 FROM vx) USING (idx) JOIN l2 USING (idx) CROSS JOIN pc""",
        **band(WIDTH),
    ),
    "combine_cohorts": sql(
        f"SELECT a, b, cohorts, round(score, 6) AS score, round(information, 6) AS information, round(z, 6) AS z, round({two_sided_p('z')}, 6) AS p FROM (SELECT *, score / sqrt(information) AS z FROM cz)",
        c0=_cohort(0),
        c1=_cohort(1),
        cz="SELECT a, b, count(*) AS cohorts, sum(score) AS score, sum(information) AS information FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1) WHERE information > 0 GROUP BY a, b",
        **band(3),
    ),
    "hc3_wald": sql(
        """SELECT stratum, max(n) AS n, round(max(b), 5) AS slope, round(sqrt(sum(CASE WHEN h < 1 THEN power(x * (y - b * x) / (1 - h), 2) ELSE 0.0 END)) / max(xx), 5) AS se,
        round(max(b) / nullif(sqrt(sum(CASE WHEN h < 1 THEN power(x * (y - b * x) / (1 - h), 2) ELSE 0.0 END)) / max(xx), 0), 5) AS z FROM h2 GROUP BY stratum""",
        h0='SELECT stratum, count(*) OVER w AS n, "case" - avg("case") OVER w AS x, value - avg(value) OVER w AS y FROM od WINDOW w AS (PARTITION BY stratum)',
        h1="SELECT *, sum(x * x) OVER (PARTITION BY stratum) AS xx, sum(x * y) OVER (PARTITION BY stratum) AS xy FROM h0",
        h2="SELECT *, xy / xx AS b, 1 / CAST(n AS DOUBLE) + x * x / xx AS h FROM h1 WHERE xx > 0",
    ),
    "background_axis": sql(
        "SELECT chr, CAST(floor(i * k / CAST(size AS DOUBLE)) AS INTEGER) AS block, count(*) AS size, min(pos) AS first FROM bk GROUP BY 1, 2",
        bc="SELECT chr, count(*) AS size, CAST(least(greatest(round(count(*) / ((SELECT count(*) FROM v) / 60.0::DOUBLE)), 1), count(*)) AS BIGINT) AS k FROM v GROUP BY chr",
        bk="SELECT v.chr, v.pos, bc.size, bc.k, row_number() OVER (PARTITION BY v.chr ORDER BY v.pos) - 1 AS i FROM v JOIN bc ON bc.chr = v.chr",
    ),
    "maf_ld_partition": sql(
        """SELECT CAST((maf >= 0.005)::INTEGER + (maf >= 0.01)::INTEGER + (maf >= 0.02)::INTEGER AS INTEGER) * 4 + CAST((l >= 0.9)::INTEGER + (l >= 1.0)::INTEGER + (l >= 1.1)::INTEGER AS INTEGER) AS bin, count(*) AS variants, CAST(sum(carriers) AS BIGINT) AS carriers
        FROM (SELECT mf.idx, maf, carriers, round(l2_base, 8) AS l FROM mf JOIN l2 USING (idx)) GROUP BY 1""",
        mf="SELECT idx, carriers, round(least(sg / (2.0 * n), 1 - sg / (2.0 * n)), 10) AS maf FROM vs CROSS JOIN n",
        **band(WIDTH),
    ),
    "ld_decay_fit": sql(
        "SELECT CAST(rate AS DOUBLE) AS rate, round(mk - h * mx, 9) AS a, round(h, 9) AS h FROM (SELECT *, sxk / sxx AS h, row_number() OVER (ORDER BY round(skk - sxk / sxx * sxk, 15), rate) AS i FROM xf WHERE sxx > 1e-12) WHERE i = 1",
        cv="SELECT CAST(floor(abs(a.pos - b.pos) / 2) AS BIGINT) AS cell, round(avg(r2), 9) AS k FROM r2 JOIN v a ON a.idx = r2.i JOIN v b ON b.idx = r2.j WHERE i < j GROUP BY 1",
        xr="SELECT g / 20.0::DOUBLE AS rate, k, exp(-(g / 20.0::DOUBLE) * cell) AS x FROM cv CROSS JOIN (SELECT unnest(range(1, 61)) AS g)",
        xf="SELECT rate, avg(x) AS mx, avg(k) AS mk, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx, sum(x * k) - count(*) * avg(x) * avg(k) AS sxk, sum(k * k) - count(*) * avg(k) * avg(k) AS skk FROM xr GROUP BY rate",
        **band(10),
    ),
    "rg_intercept": sql(
        """SELECT m, round((wy - m / s * wxy - t / s * wx + t / s * m / s * wxx) / (w - 2 * m / s * wx + m / s * m / s * wxx), 7) AS c FROM (SELECT count(*) AS m, sum(x) AS s, sum(y) AS t, sum(w) AS w, sum(w * x) AS wx, sum(w * x * x) AS wxx, sum(w * y) AS wy,
        sum(w * x * y) AS wxy FROM (SELECT a.z_star * b.z_star AS y, l2_base - 1 AS x, 1 / greatest(l2_base, 1.0) AS w FROM t1 a JOIN t2 b USING (idx) JOIN l2 USING (idx)))""",
        t1="SELECT * FROM my WHERE trait = 'y1'",
        t2="SELECT * FROM my WHERE trait = 'y2'",
        **band(WIDTH),
    ),
}
