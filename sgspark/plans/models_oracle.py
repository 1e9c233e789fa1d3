"""SQL for the queries of models.py, over the same table expressions."""

from __future__ import annotations

from sgspark.plans.oracle import _OVERLAP, BLOCKS, ORACLE_SQL as FIRST, WIDTH, _jackknife, band, sql, units

_L2 = "SELECT r2.i AS idx, sum(adj) AS l2_base, sum(low * adj) AS l2_low, sum(high * adj) AS l2_high, sum(promo * adj) AS l2_promo FROM r2 JOIN v ON v.idx = r2.j GROUP BY 1"
_NOTES = {"base": "1", "low": "low", "high": "high", "promo": "promo"}


def _det(rows: list[list[str]]) -> str:
    if len(rows) == 1:
        return rows[0][0]
    minors = (f"{rows[0][j]} * ({_det([r[:j] + r[j + 1 :] for r in rows[1:]])})" for j in range(len(rows)))
    return " ".join(f"{'-' if j % 2 else '+'} {m}" for j, m in enumerate(minors))


def _cramer(matrix: list[list[str]], rhs: list[str]) -> list[str]:
    whole = _det(matrix)
    return [f"({_det([[*r[:j], b, *r[j + 1 :]] for r, b in zip(matrix, rhs)])}) / ({whole})" for j in range(len(rhs))]


def _long(keys: str, values: dict[str, tuple[str, str]], source: str) -> str:
    """Replicates (vr) and full values (vf) of the quantities, as rows."""
    names = ", ".join(f"'{q}'" for q in values)
    left, full = (", ".join(f"CAST({v[i]} AS DOUBLE)" for v in values.values()) for i in (0, 1))
    return f"SELECT * FROM (SELECT {keys}unit, m, unnest([{names}]) AS quantity, unnest([{left}]) AS vr, unnest([{full}]) AS vf FROM {source}) WHERE vr IS NOT NULL AND vf IS NOT NULL"


def _cells(names: list[str], responses: dict[str, str]) -> dict[str, str]:
    out = {"m": "count(*)"}
    for k in names:
        a = _NOTES[k]
        out |= {f"a_{k}": f"CAST(sum({a}) AS DOUBLE)", f"q_{k}": f"CAST(sum({a} * {a}) AS DOUBLE)"} | {f"{r}_{k}": f"sum({a} * {y})" for r, y in responses.items()}
        out |= {f"al_{k}_{j}": f"sum({a} * l2_{j})" for j in names} | {f"aa_{k}_{j}": f"CAST(sum({a} * {_NOTES[j]}) AS DOUBLE)" for j in names}
    return out


def _sums(names: list[str], responses: dict[str, str], source: str, keys: str, scales: list[str]) -> tuple[str, str]:
    """Unit sums, and those with totals and retained sums beside them."""
    cells = _cells(names, responses)
    ju = f"SELECT {keys}unit, {', '.join(f'{e} AS {c}' for c, e in cells.items())}, {', '.join(f'max({n}) AS {n}' for n in scales)} FROM {source} GROUP BY {keys}unit"
    by = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    jw = f"SELECT *, {', '.join(f'sum({c}) OVER ({by}) AS t_{c}, sum({c}) OVER ({by}) - {c} AS r_{c}' for c in cells)} FROM ju"
    return ju, jw


def _traces(p: str, names: list[str], scale: str) -> list[list[str]]:
    t = lambda k, j: f"{scale} * {p}_al_{k}_{j} / ({p}_a_{k} * t_a_{j})"
    return [[f"(({t(k, j)} + {t(j, k)}) / 2)" for j in names] for k in names]


def _h2_sql(names: list[str]) -> str:
    ju, jw = _sums(names, {"ay": "y"}, "hr", "trait, ", ["n_star"])
    # the matrix and right side are named before they are solved
    cells, solved = [], []
    for p in "rt":
        t = _traces(p, names, "n_star * n_star")
        cells += [f"{t[i][j]} AS {p}{i}{j}" for i in range(len(names)) for j in range(len(names))]
        cells += [f"n_star * {p}_ay_{k} / {p}_a_{k} - n_star AS {p}b{i}" for i, k in enumerate(names)]
        solved += [f"{s} AS {p}s_{k}" for s, k in zip(_cramer([[f"{p}{i}{j}" for j in range(len(names))] for i in range(len(names))], [f"{p}b{i}" for i in range(len(names))]), names)]

    def quantities(p: str) -> dict[str, str]:
        total = "(" + " + ".join(f"{p}s_{k}" for k in names) + ")"
        out = {f"sigma_{k}": f"{p}s_{k}" for k in names} | {"sigma_e": f"1 - {total}", "total": total}
        for k in names:
            category = "(" + " + ".join(f"{p}_aa_{k}_{j} * {p}s_{j} / {p}_a_{j}" for j in names) + ")"
            a, m = f"{p}_a_{k}", f"CAST({p}_m AS DOUBLE)"
            sd = f"sqrt(greatest({p}_q_{k} / {m} - power({a} / {m}, 2), 0.0))"
            out |= {f"tau_{k}": f"{p}s_{k} / {a}", f"h2_{k}": category, f"enrichment_{k}": f"{category} / {total} / ({a} / {m})", f"tau_star_{k}": f"{p}s_{k} / {a} * {sd} / ({total} / {m})"}
        return out

    left, full = quantities("r"), quantities("t")
    digits = "CASE WHEN starts_with(quantity, 'tau_') AND NOT starts_with(quantity, 'tau_star') THEN round({0}, 8) ELSE round({0}, 4) END + 0.0"
    return sql(
        f"SELECT trait, quantity, n_units, {digits.format('estimate')} AS estimate, {digits.format('se')} AS se FROM jk",
        l2=_L2, u=units(BLOCKS), hr="SELECT my.*, u.unit, u.low, u.high, u.promo, l2.* EXCLUDE (idx) FROM my JOIN u USING (idx) JOIN l2 USING (idx)",
        ju=ju, jw=jw, jm=f"SELECT *, {', '.join(cells)} FROM jw", js=f"SELECT *, {', '.join(solved)} FROM jm",
        jr=_long("trait, ", {q: (left[q], full[q]) for q in left}, "js"), jk=_jackknife("trait, quantity", "vr", "vf"), **band(WIDTH),
    )


_T12 = """SELECT a.idx, a.z_star AS z1, b.z_star AS z2, a.y AS y1, b.y AS y2, a.n_star AS n1, b.n_star AS n2, u.unit, u.low, u.high, u.promo, l2.* EXCLUDE (idx)
  FROM (SELECT * FROM my WHERE trait = 'y1') a JOIN (SELECT * FROM my WHERE trait = 'y2') b USING (idx) JOIN u USING (idx) JOIN l2 USING (idx)"""


def _rg_sql(names: list[str]) -> str:
    ju, jw = _sums(names, {"xy": "z1 * z2", "ay1": "y1", "ay2": "y2", "ab": "1"}, "hr", "", ["n1", "n2"])
    k = range(len(names))
    cells, solved = [], []
    for p in "rt":
        for name, scale, rhs in (("g", "n1 * n2", [f"({p}_xy_{a} - c * {p}_ab_{a}) * sqrt(n1 * n2) / {p}_a_{a}" for a in names]), ("x", "n1 * n1", [f"n1 * {p}_ay1_{a} / {p}_a_{a} - n1" for a in names]), ("w", "n2 * n2", [f"n2 * {p}_ay2_{a} / {p}_a_{a} - n2" for a in names])):
            t = _traces(p, names, scale)
            cells += [f"{t[i][j]} AS {p}{name}{i}{j}" for i in k for j in k] + [f"{b} AS {p}{name}b{i}" for i, b in enumerate(rhs)]
            solved += [f"{s} AS {p}{name}{i}" for i, s in enumerate(_cramer([[f"{p}{name}{i}{j}" for j in k] for i in k], [f"{p}{name}b{i}" for i in k]))]
    share = lambda g, a, b: f"CASE WHEN {a} > 0 AND {b} > 0 THEN {g} / sqrt({a} * {b}) END"
    total = lambda p, x: "(" + " + ".join(f"{p}{x}{i}" for i in k) + ")"

    def quantities(p: str) -> dict[str, str]:
        out = {f"gamma_{a}": f"{p}g{i}" for i, a in enumerate(names)} | {f"rg_{a}": share(f"{p}g{i}", f"{p}x{i}", f"{p}w{i}") for i, a in enumerate(names)}
        return out | {"gamma": total(p, "g"), "rg": share(total(p, "g"), total(p, "x"), total(p, "w"))}

    left, full = quantities("r"), quantities("t")
    (g, a, b), (fg, fa, fb) = ([total(p, x) for x in "gxw"] for p in "rt")
    whole = share(fg, fa, fb)
    linear = f"CASE WHEN {fa} > 0 AND {fb} > 0 THEN {fg} / sqrt({fa} * {fb}) + ({g} - {fg}) / sqrt({fa} * {fb}) - {fg} / sqrt({fa} * {fb}) / 2 * (({a} - {fa}) / {fa} + ({b} - {fb}) / {fb}) END"
    return sql(
        "SELECT quantity, n_units, round(estimate, 5) AS estimate, round(se, 5) AS se FROM jk",
        l2=_L2, u=units(BLOCKS), ov=_OVERLAP, hr=_T12, ju=ju, jw=jw, jm=f"SELECT *, {', '.join(cells)} FROM (SELECT *, (SELECT c FROM ov) AS c FROM jw)", js=f"SELECT *, {', '.join(solved)} FROM jm",
        jr=_long("", {q: (left[q], full[q]) for q in left} | {"rg_delta": (linear, whole)}, "js"), jk=_jackknife("quantity", "vr", "vf"), **band(WIDTH),
    )


_REPS = "SELECT DISTINCT unit AS rep FROM u UNION ALL SELECT -1"
_W2 = "1 / (2 * power(greatest(1 + greatest(0.0, least(1.0, h1 + h2)) * n / (m1 + m2) * ll, 0.001), 2) * ll)"


def _two(weight: str, source: str) -> str:
    """A weighted fit of q on x1 and x2 for each trait and replicate; source: the rows with the last estimates."""
    inner = f"SELECT trait, rep, sum(w * x1 * x1) AS a, sum(w * x1 * x2) AS b, sum(w * x2 * x2) AS d, sum(w * x1 * q) AS e, sum(w * x2 * q) AS f FROM (SELECT *, {weight} AS w FROM {source}) GROUP BY trait, rep"
    return f"SELECT trait, rep, (e * d - b * f) / (a * d - b * b) AS h1, (a * f - b * e) / (a * d - b * b) AS h2 FROM ({inner})"


def _one(weight: str, source: str, key: str = "trait, ") -> str:
    return f"SELECT {key}rep, sum(w * x * q) / sum(w * x * x) AS h FROM (SELECT *, {weight} AS w FROM {source}) GROUP BY {key}rep"


_LR2 = """SELECT trait, unit, n_star AS n, y - 1 AS q, m1, m2, n_star * l2_low / m1 AS x1, n_star * l2_high / m2 AS x2, greatest(l2_low + l2_high, 1.0) AS ll
  FROM (SELECT my.*, u.unit, l2.*  EXCLUDE (idx), CAST(sum(u.low) OVER (PARTITION BY trait) AS DOUBLE) AS m1, CAST(sum(u.high) OVER (PARTITION BY trait) AS DOUBLE) AS m2 FROM my JOIN u USING (idx) JOIN l2 USING (idx))"""
_AT = "(SELECT lr.*, {0}.* EXCLUDE (trait) FROM lr JOIN {0} ON lr.trait = {0}.trait WHERE lr.unit <> {0}.rep)"
_LDSC_H2 = sql(
    "SELECT trait, quantity, n_units, round(estimate, 6) AS estimate, round(se, 6) AS se FROM jk",
    l2=_L2, u=units(BLOCKS), lr=_LR2, reps=_REPS, s0=_two("1", "(SELECT * FROM lr JOIN reps ON unit <> rep)"), s1=_two(_W2, _AT.format("s0")), s2=_two(_W2, _AT.format("s1")), s3=_two(_W2, _AT.format("s2")),
    sz="SELECT trait, unit, count(*) AS m FROM lr GROUP BY 1, 2",
    sx="SELECT sz.trait, sz.unit, sz.m, r.h1 AS r1, r.h2 AS r2_, t.h1 AS t1, t.h2 AS t2 FROM sz JOIN s3 r ON r.trait = sz.trait AND r.rep = sz.unit JOIN s3 t ON t.trait = sz.trait AND t.rep = -1",
    jr=_long("trait, ", {"h2_low": ("r1", "t1"), "h2_high": ("r2_", "t2"), "total": ("r1 + r2_", "t1 + t2")}, "sx"), jk=_jackknife("trait, quantity", "vr", "vf"), **band(WIDTH),
)

_LR1 = """SELECT trait, unit, n_star AS n, y - 1 AS q, m, n_star * l2_base / m AS x, greatest(l2_base, 1.0) AS ll FROM (SELECT my.*, u.unit, l2.l2_base, CAST(count(*) OVER (PARTITION BY trait) AS DOUBLE) AS m FROM my JOIN u USING (idx) JOIN l2 USING (idx))"""
_W1 = "1 / (2 * power(greatest(1 + greatest(0.0, least(1.0, h)) * n / m * ll, 0.001), 2) * ll)"
_GX = "SELECT unit, n1, n2, m, ll, z1 * z2 - c AS q, sqrt(n1 * n2) * l2_base / m AS x, c FROM (SELECT *, CAST(count(*) OVER () AS DOUBLE) AS m, greatest(l2_base, 1.0) AS ll, (SELECT c FROM ov) AS c FROM hr)"
_GAT = "(SELECT gx.*, {0}.rep, {0}.h AS g, p.h AS ha, o.h AS hb FROM gx JOIN {0} ON gx.unit <> {0}.rep JOIN h3 p ON p.rep = {0}.rep AND p.trait = 'y1' JOIN h3 o ON o.rep = {0}.rep AND o.trait = 'y2')"
_WG = """1 / (ll * greatest((1 + greatest(0.0, least(1.0, ha)) * n1 / m * ll) * (1 + greatest(0.0, least(1.0, hb)) * n2 / m * ll) + power(c + greatest(-1.0, least(1.0, g)) * sqrt(n1 * n2) / m * ll, 2), 1e-12))"""
_LDSC_RG = sql(
    "SELECT quantity, n_units, round(estimate, 5) AS estimate, round(se, 5) AS se FROM jk",
    l2=_L2, u=units(BLOCKS), ov=_OVERLAP, hr=_T12, lr=_LR1, reps=_REPS,
    h0="SELECT trait, rep, sum(q) / sum(x) AS h FROM lr JOIN reps ON unit <> rep GROUP BY trait, rep", h1=_one(_W1, _AT.format("h0")), h2=_one(_W1, _AT.format("h1")), h3=_one(_W1, _AT.format("h2")),
    gx=_GX, g0="SELECT rep, sum(q) / sum(x) AS h FROM gx JOIN reps ON unit <> rep GROUP BY rep", g1=_one(_WG, _GAT.format("g0"), ""), g2=_one(_WG, _GAT.format("g1"), ""), g3=_one(_WG, _GAT.format("g2"), ""),
    gr="SELECT g.rep, g.h AS g, CASE WHEN p.h > 0 AND o.h > 0 THEN g.h / sqrt(p.h * o.h) END AS r FROM g3 g JOIN h3 p ON p.rep = g.rep AND p.trait = 'y1' JOIN h3 o ON o.rep = g.rep AND o.trait = 'y2'",
    sx="SELECT s.unit, s.m, a.g AS ga, a.r AS ra, t.g AS gt, t.r AS rt FROM (SELECT unit, count(*) AS m FROM gx GROUP BY unit) s JOIN gr a ON a.rep = s.unit JOIN gr t ON t.rep = -1",
    jr=_long("", {"gamma_base": ("ga", "gt"), "gamma": ("ga", "gt"), "rg": ("ra", "rt")}, "sx"), jk=_jackknife("quantity", "vr", "vf"), **band(WIDTH),
)

_F2 = "SELECT sum(m * m) / power(sum(m), 2) AS f2 FROM (SELECT CAST(count(*) AS DOUBLE) AS m FROM u GROUP BY unit)"
_BASIS = {0: "1", 1: "env", 2: '"case"'}
_PAIRS = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]


def _feature(p: int) -> str:
    a, b = _PAIRS[p]
    return f"{1 if a == b else 2} * {_BASIS[a]} * {_BASIS[b]}"




def _unpivoted(first: str, second: str, cells: dict[tuple[int, int], str], source: str) -> str:
    """One aggregate of all cells, as rows (first, second, value)."""
    names = {k: f"c{k[0]}_{k[1]}" for k in cells}
    made = ", ".join(f"CAST(sum({x}) AS DOUBLE) AS {names[k]}" for k, x in cells.items())
    rows = [", ".join(map(str, x)) for x in ([k[0] for k in cells], [k[1] for k in cells], names.values())]
    return f"SELECT unnest([{rows[0]}]) AS {first}, unnest([{rows[1]}]) AS {second}, unnest([{rows[2]}]) AS value FROM (SELECT {made} FROM {source})"


_SECOND = _unpivoted("a", "b", {(a, b): f"{_BASIS[a]} * {_BASIS[b]}" for a in range(3) for b in range(3)}, "s")
_FOURTH = lambda where="": _unpivoted("p", "s", {(p, q): f"{_feature(p)} * {_feature(q)}" for p in range(6) for q in range(6)}, f"s{where}")
_TURNS = ", ".join(f"({p}, {x}, {y})" for p, (a, b) in enumerate(_PAIRS) for x, y in {(a, b), (b, a)})
_EXPOSURE = f"""SELECT o.p, i.p AS s, sum(x.value * y.value) - max(f4.value) AS value FROM (VALUES {_TURNS}) o(p, a, b) CROSS JOIN (VALUES {_TURNS}) i(p, c, d)
  JOIN m2 x ON x.a = o.a AND x.b = i.c JOIN m2 y ON y.a = o.b AND y.b = i.d JOIN f4 ON f4.p = o.p AND f4.s = i.p GROUP BY 1, 2"""

# LD between units: one set of signs of samples, through the variants and back.
_LONG = {
    "u": units(BLOCKS),
    "nn": "SELECT CAST(count(*) AS DOUBLE) AS n FROM s",
    "lw": "SELECT idx, unit, sg / n AS mean, gg - sg * sg / n AS x FROM (SELECT idx, sum(g) AS sg, CAST(sum(g * g) AS DOUBLE) AS gg FROM d GROUP BY idx) JOIN u USING (idx) CROSS JOIN nn",
    "lx": "SELECT idx, unit, mean, 1 / sqrt(x) AS sc FROM lw WHERE x > 1e-9",
    "lz": "SELECT sid, p, z, z - avg(z) OVER (PARTITION BY p) AS pz, sum(z) OVER (PARTITION BY p) AS zs FROM (SELECT sid, p, CASE WHEN substr(md5(CAST(sid AS VARCHAR) || ':' || CAST(p AS VARCHAR)), 1, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS z FROM (SELECT sid, unnest(range(8)) AS p FROM s))",
    "lc": "SELECT idx, unit, p, mean, sc * sc * (sum(g * z) - mean * max(zs)) AS c FROM d JOIN lz USING (sid) JOIN lx USING (idx) GROUP BY idx, unit, p, mean, sc",
    "lk": "SELECT (n - 1) / (SELECT count(*) FROM lx) AS k, n - 1 AS nu FROM nn",
    "ly": "SELECT unit, sid, p, sum(c * g) AS y FROM lc JOIN d USING (idx) GROUP BY 1, 2, 3",
    "lo": "SELECT unit, p, sum(c * mean) AS y0 FROM lc GROUP BY 1, 2",
    "ld": "SELECT unit, sid, sum(sc * sc * (g * g - 2 * g * mean)) AS x FROM lx JOIN d USING (idx) GROUP BY 1, 2",
    "le": "SELECT unit, sum(sc * sc * mean * mean) AS x0, CAST(count(*) AS DOUBLE) AS m FROM lx GROUP BY 1",
    "lg": "SELECT le.unit, lz.sid, p, pz, k * (coalesce(y, 0.0) - y0) AS y, k * (coalesce(ld.x, 0.0) + x0) AS own, k * m / nu AS share FROM le CROSS JOIN lz CROSS JOIN lk JOIN lo USING (unit, p) LEFT JOIN ly ON ly.unit = le.unit AND ly.sid = lz.sid AND ly.p = lz.p LEFT JOIN ld ON ld.unit = le.unit AND ld.sid = lz.sid",
    "lh": "SELECT unit, sid, p, y - share * pz AS a, y - own * pz + avg(own * pz) OVER w - avg(own) OVER w / nu * pz AS b FROM lg CROSS JOIN lk WINDOW w AS (PARTITION BY unit, p)",
    "li": "SELECT sum(a * a) AS wa, sum(b * b) AS wb FROM lh",
    "lj": "SELECT sum(a * a) AS la, sum(b * b) AS lb FROM (SELECT sid, p, sum(a) AS a, sum(b) AS b FROM lh GROUP BY 1, 2)",
    "lr": "SELECT rs, rp, greatest(rs - rp, 0.0) AS rd, greatest(rs - greatest(rs - rp, 0.0), 0.0) AS ro FROM (SELECT 1 - wa / la AS rs, 1 - wb / lb AS rp FROM li CROSS JOIN lj)",
}

# The panel of all variants and samples: covariates are taken out by one orthonormal vector after the other.
_WIDE = {
    "k0": "SELECT sid AS k, CAST(nation AS DOUBLE) AS c1, CAST(y2 AS DOUBLE) AS c2, 1 / sqrt(count(*) OVER ()) AS q0 FROM s",
    "k1": "SELECT k, q0, c1 - avg(c1) OVER () AS d1, c2 - avg(c2) OVER () AS d2 FROM k0",
    "k2": "SELECT k, q0, d1 / sqrt(sum(d1 * d1) OVER ()) AS q1, d2 FROM k1",
    "k3": "SELECT k, q0, q1, d2 - q1 * sum(q1 * d2) OVER () AS e2 FROM k2",
    "kq": "SELECT k, q0, q1, e2 / sqrt(sum(e2 * e2) OVER ()) AS q2 FROM k3",
}
_PROBED = _WIDE | {
    "w0": "SELECT idx, sum(g * q0) AS w0, sum(g * q1) AS w1, sum(g * q2) AS w2, CAST(sum(g * g) AS DOUBLE) AS gg FROM d JOIN kq ON kq.k = d.sid GROUP BY idx",
    "w1": "SELECT *, gg - w0 * w0 AS raw, gg - w0 * w0 - w1 * w1 - w2 * w2 AS rest FROM w0",
    "nn": "SELECT CAST(count(*) AS DOUBLE) AS n FROM s",
    "w": "SELECT w1.idx, w0, w1, w2, CASE WHEN rest > 1e-10 * raw THEN 1 / sqrt(rest) ELSE 0.0 END AS sc, CASE WHEN rest > 1e-10 * raw THEN least(1.0, rest / raw) ELSE 0.0 END * (n - 1) / (n - 3) AS v FROM w1 CROSS JOIN (SELECT n FROM nn)",
    "an": "SELECT w.idx, w.v, unnest(['base', 'low', 'promo']) AS a, unnest([1, low, promo]) AS x FROM w JOIN v USING (idx)",
    "u": "SELECT w.idx, kq.k, (coalesce(d.g, 0) - w0 * q0 - w1 * q1 - w2 * q2) * sc AS u FROM w CROSS JOIN kq LEFT JOIN d ON d.idx = w.idx AND d.sid = kq.k",
    "z": "SELECT idx, p, CASE WHEN substr(md5(CAST(idx AS VARCHAR) || ':' || CAST(p AS VARCHAR)), 1, 1) < '8' THEN 1 ELSE -1 END AS z FROM (SELECT idx, unnest(range(8)) AS p FROM w)",
    "sk": "SELECT a, p, k, sum(sqrt(x * v) * z * u) AS t FROM an JOIN z USING (idx) JOIN u USING (idx) WHERE x > 0 GROUP BY 1, 2, 3",
    "y": "SELECT idx, a, p, power(sum(u * t), 2) AS y FROM u JOIN sk USING (k) GROUP BY 1, 2, 3",
    "ms": "SELECT idx, a, avg(y) AS raw, var_samp(y) / 8 AS mc FROM y GROUP BY 1, 2",
    "mm": "SELECT a, sum(x * v) AS m, CAST(sum(x) AS DOUBLE) AS c FROM an GROUP BY a",
}
_ROBUST = {
    "ra": 'SELECT sid, 1.0::DOUBLE / count(*) OVER () AS u0, y2 - avg(y2) OVER () AS c, env - avg(env) OVER () AS e0, "case" - avg("case") OVER () AS k0, y1 - avg(y1) OVER () AS y0 FROM s',
    "rb": "SELECT *, c / sqrt(sum(c * c) OVER ()) AS q FROM ra",
    "rc": "SELECT u0 + q * q AS own, e0 - q * sum(q * e0) OVER () AS r1, k0 - q * sum(q * k0) OVER () AS r2, y0 - q * sum(q * y0) OVER () AS py FROM rb",
    "rd": "SELECT count(*) AS n, sum(r1 * r1) AS h1, sum(r1 * r2) AS h12, sum(r2 * r2) AS h2, sum(r1 * py) AS s1, sum(r2 * py) AS s2 FROM rc",
    "re": "SELECT *, h1 * h2 - h12 * h12 AS dh, (s1 * h2 - s2 * h12) / (h1 * h2 - h12 * h12) AS b1, (s2 * h1 - s1 * h12) / (h1 * h2 - h12 * h12) AS b2 FROM rd",
    "rf": "SELECT r1, r2, power((py - r1 * b1 - r2 * b2) / (1 - own - (r1 * r1 * h2 - 2 * r1 * r2 * h12 + r2 * r2 * h1) / dh), 2) AS e2 FROM rc CROSS JOIN re",
    "rg": "SELECT sum(r1 * r1 * e2) AS v1, sum(r1 * r2 * e2) AS v12, sum(r2 * r2 * e2) AS v2 FROM rf",
    "rh": """SELECT n, b1, b2, sqrt((h2 * h2 * v1 - 2 * h2 * h12 * v12 + h12 * h12 * v2) / (dh * dh)) AS se1, sqrt((h12 * h12 * v1 - 2 * h12 * h1 * v12 + h1 * h1 * v2) / (dh * dh)) AS se2,
      (s1 * s1 * v2 - 2 * s1 * s2 * v12 + s2 * s2 * v1) / (v1 * v2 - v12 * v12) AS wald, s1 * s1 + s2 * s2 AS kq, (v1 + v2) / 2 AS tr, sqrt(power((v1 - v2) / 2, 2) + v12 * v12) AS gap, (s1 + s2) / sqrt(v1 + 2 * v12 + v2) AS bz FROM re CROSS JOIN rg""",
    # two weights: the angle of the two normals is uniform, and their squared length exponential
    "ri": "SELECT avg(exp(-kq / (2 * (tr + gap * cos(2 * t))))) AS kp, avg(exp(-bz * bz / (2 * power(sin(t), 2)))) AS bp FROM rh CROSS JOIN (SELECT (unnest(range(20000)) + 0.5) * pi() / 40000 AS t)",
}
_CORRECTED = _PROBED | {
    "sq": "SELECT a, k, n * sum(x * v * u * u) / max(m) AS q FROM an JOIN u USING (idx) JOIN mm USING (a) CROSS JOIN nn GROUP BY a, k, n",
    "mu": "SELECT i.a, j.a AS b, avg(i.q * j.q) AS mu22 FROM sq i JOIN sq j USING (k) GROUP BY 1, 2",
    "ss": "SELECT an.a, ms.a AS b, sum(raw) AS s FROM an JOIN ms USING (idx) WHERE x > 0 GROUP BY 1, 2",
    "co": "SELECT ss.a, ss.b, i.c AS m_a, j.c AS m_b, s, s / (i.c * j.c) AS r2, mu22, (power(n - 2, 2) * s / (i.c * j.c) - n * mu22) / (n * (n - 1)) AS rho2 FROM ss JOIN mm i ON i.a = ss.a JOIN mm j ON j.a = ss.b JOIN mu ON mu.a = ss.a AND mu.b = ss.b CROSS JOIN nn",
}

_GXE = {
    "px": "SELECT vid, k, z * sqrt(n - 1) AS x, CAST(k % 7 - 3 AS DOUBLE) AS e FROM ez",
    "pw": "SELECT vid, k, x, e, x * e - avg(x * e) OVER (PARTITION BY vid) AS w FROM px",
    "py": "SELECT sid AS k, (y1 - avg(y1) OVER ()) AS y FROM s WHERE sid BETWEEN 1 AND 64",
    "pz": "SELECT k, y * sqrt(63 / (SELECT sum(y * y) FROM py)) AS y FROM py",
    "pb": "SELECT count(*) AS m, sum(bx * bx) AS bx, sum(bw * bw) AS bw, sum(tw) AS tw, sum(dx) AS dx, sum(dw) AS dw FROM (SELECT vid, sum(x * y) AS bx, sum(w * y) AS bw, sum(w * w) AS tw, sum(x * x * e * e) AS dx, sum(w * w * e * e) AS dw FROM pw JOIN pz USING (k) GROUP BY vid)",
    "pk": "SELECT a.k AS i, b.k AS j, sum(a.x * b.x) AS gx, sum(a.w * b.w) AS gw FROM pw a JOIN pw b USING (vid) GROUP BY 1, 2",
    "pt": "SELECT sum(gx * gx) AS xx, sum(gx * gw) AS xw, sum(gw * gw) AS ww FROM pk",
    "pe": "SELECT sum(e * e * y * y) AS q, sum(e * e) * (1 - 1 / 64.0) AS t, sum(power(e, 4)) * (1 - 2 / 64.0) + power(sum(e * e) / 64.0, 2) AS t2 FROM (SELECT CAST(k % 7 - 3 AS DOUBLE) AS e, y FROM pz)",
    "pm": """SELECT xx / (m * m) - 63 AS a11, xw / (m * m) - tw / m AS a12, dx / m - t AS a13, ww / (m * m) - tw / m * (tw / m) / 63 AS a22, dw / m - tw / m * t / 63 AS a23, t2 - t * t / 63 AS a33,
      bx / m - 63 AS b1, bw / m - tw / m AS b2, q - t AS b3, CAST(63 AS DOUBLE) AS u1, tw / m AS u2, t AS u3 FROM pb CROSS JOIN pt CROSS JOIN pe""",
}
_GS = _cramer([["a11", "a12", "a13"], ["a12", "a22", "a23"], ["a13", "a23", "a33"]], ["b1", "b2", "b3"])
_GXE["ps"] = f"SELECT *, {', '.join(f'{s} AS s{i + 1}' for i, s in enumerate(_GS))} FROM pm"
_GXE["pq"] = "SELECT *, (63 - s1 * u1 - s2 * u2 - s3 * u3) / 63 AS s4 FROM ps"

_ADJ = {
    "ax": "SELECT trait, idx, sum(g) AS sg, sum(g * g) AS sgg, sum(g * y) AS sgy, sum(g * env) AS sgc FROM d JOIN p USING (sid) JOIN (SELECT sid, env FROM s) USING (sid) GROUP BY 1, 2",
    "ay": "SELECT trait, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(y * y) AS DOUBLE) AS syy, CAST(sum(env) AS DOUBLE) AS sc, CAST(sum(env * env) AS DOUBLE) AS scc, CAST(sum(env * y) AS DOUBLE) AS scy FROM p JOIN (SELECT sid, env FROM s) USING (sid) GROUP BY 1",
    "az": """SELECT trait, idx, n, sgg, sgg - sg * sg / n - power(sgc - sg * sc / n, 2) / (scc - sc * sc / n) AS vg, sgy - sg * sy / n - (sgc - sg * sc / n) * (scy - sc * sy / n) / (scc - sc * sc / n) AS vgy,
      syy - sy * sy / n - power(scy - sc * sy / n, 2) / (scc - sc * sc / n) AS vy FROM ax JOIN ay USING (trait)""",
    "bx": "SELECT trait, idx, CAST(sum(g * (1 - h)) AS DOUBLE) AS s0, CAST(sum(g * h) AS DOUBLE) AS s1, CAST(sum(g * g * (1 - h)) AS DOUBLE) AS q0, CAST(sum(g * g * h) AS DOUBLE) AS q1, CAST(sum(g * (1 - h) * y) AS DOUBLE) AS y0, CAST(sum(g * h * y) AS DOUBLE) AS y1 FROM d JOIN p USING (sid) JOIN (SELECT sid, nation % 2 AS h FROM s) USING (sid) GROUP BY 1, 2",
    "bz": "SELECT trait, idx, n, q0, q1, q0 - s0 * s0 / n AS a, -s0 * s1 / n AS b, q1 - s1 * s1 / n AS e, y0 - s0 * sy / n AS u, y1 - s1 * sy / n AS w, syy - sy * sy / n AS vy FROM bx JOIN ay USING (trait)",
    "bw": "SELECT *, (u * e - b * w) / (a * e - b * b) AS b0, (a * w - b * u) / (a * e - b * b) AS b1, e / (a * e - b * b) AS i0, a / (a * e - b * b) AS i1 FROM bz WHERE q0 > 0 AND q1 > 0 AND a * e - b * b > 0",
}

_SERIES = lambda k: f"list_sum(list_transform(range(0, 18), lambda j: power(x, j) / (CAST(factorial(CAST(j AS INTEGER)) AS DOUBLE) * (j + {k} + 1))))"
_I0 = f"CASE WHEN abs(x) <= 0.5 THEN {_SERIES(0)} ELSE (exp(x) - 1) / x END"

_STRAND = "SELECT idx, (a1 || a2) IN ('AT', 'TA', 'CG', 'GC') AS amb, 0.2::DOUBLE + (idx % 50) / 1000.0::DOUBLE AS base, CASE WHEN idx % 2 = 1 THEN 0.25::DOUBLE ELSE -0.15::DOUBLE END AS delta FROM v"


ORACLE_SQL = {
    "h2_overlapping": _h2_sql(["base", "low", "promo"]),
    "rg_partitioned": _rg_sql(["low", "high"]),
    "ldsc_h2": _LDSC_H2,
    "ldsc_rg": _LDSC_RG,
    "long_range_shares": sql("SELECT round(rs, 8) AS rho_self, round(rp, 8) AS rho_apart, round(rd, 8) AS rho_diag, round(ro, 8) AS rho_off FROM lr", **_LONG),
    "h2_long_range": sql(
        "SELECT trait, round(CASE WHEN se > 0 THEN va / (se * se) END, 6) AS factor, round(CASE WHEN se > 0 THEN sqrt(va) ELSE se END, 6) AS se_long FROM lv",
        **_LONG, f2=_F2, hh=f"SELECT trait, se, greatest(0.0, least(1.0, estimate)) AS h FROM ({FIRST['h2_single']})",
        lv="SELECT *, se * se / greatest(1 - (SELECT rd FROM lr) - (SELECT ro FROM lr) * (1 + 2 * h), 0.2) + 4 * h * h * (1 - (SELECT f2 FROM f2)) / (SELECT n FROM n) AS va FROM hh",
    ),
    "rg_long_range": sql(
        "SELECT round(CASE WHEN se > 0 THEN va / (se * se) END, 5) AS factor, round(CASE WHEN se > 0 THEN sqrt(va) ELSE se END, 5) AS se_long FROM lv",
        **_LONG, f2=_F2, ov=_OVERLAP, hh=f"SELECT greatest(0.0, least(1.0, max(estimate) FILTER (trait = 'y1'))) AS a, greatest(0.0, least(1.0, max(estimate) FILTER (trait = 'y2'))) AS b FROM ({FIRST['h2_single']})",
        l0=f"SELECT a, b, se, (SELECT c FROM ov) AS c, (SELECT n FROM ov) AS n, greatest(-1.0, least(1.0, coalesce(rg, 0.0))) * sqrt(a * b) AS g FROM hh, ({FIRST['rg_supplied_c']})",
        l1="SELECT *, greatest(-1.0, least(1.0, c - g)) AS e FROM l0",
        l2_="SELECT *, (1 - a) * (1 - b) + e * e AS w1, a * (1 - b) + b * (1 - a) + 2 * g * e AS w2, a * b + g * g AS w3 FROM l1",
        lv="SELECT se, se * se / greatest(1 - (SELECT rd FROM lr) - (SELECT ro FROM lr) * CASE WHEN w1 + w2 + w3 > 0 THEN greatest(1.0, least(3.0, (w1 + 2 * w2 + 3 * w3) / (w1 + w2 + w3))) ELSE 1.0 END, 0.2) + 2 * w3 * (1 - (SELECT f2 FROM f2)) / n AS va FROM l2_",
    ),
    "gxe_components": sql(
        "SELECT component, round(s, 6) AS estimate, round(s * u / tot, 6) AS proportion FROM (SELECT unnest(['G_base', 'GxE_base', 'NxE', 'residual']) AS component, unnest([s1, s2, s3, s4]) AS s, unnest([u1, u2, u3, 63.0]) AS u, s1 * u1 + s2 * u2 + s3 * u3 + s4 * 63 AS tot FROM pq)",
        **_GXE,
    ),
    "context_second": sql("SELECT a, b, value FROM m2", m2=_SECOND),
    "context_fourth": sql("SELECT p, s, value FROM f4", f4=_FOURTH()),
    "context_exposure": sql("SELECT p, s, value FROM ex", m2=_SECOND, f4=_FOURTH(), ex=_EXPOSURE),
    "context_transfer": sql(
        "SELECT p, s, round(o.value + h * (h - 1) / (n * (n - 1)) * (ex.value - f4.value), 4) AS value FROM ex JOIN f4 USING (p, s) JOIN fo o USING (p, s) CROSS JOIN nh",
        nh="SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (sid % 2 = 0) AS DOUBLE) AS h FROM s",
        m2=_SECOND, f4=_FOURTH(), fo=_FOURTH(" WHERE sid % 2 = 0"), ex=_EXPOSURE,
    ),
    "quadratic_tails": sql(
        "SELECT sid, round(power(a, 2) / ((a - b) * (a - c)) * exp(-q / (2 * a)) + power(b, 2) / ((b - a) * (b - c)) * exp(-q / (2 * b)) + power(c, 2) / ((c - a) * (c - b)) * exp(-q / (2 * c)), 10) AS p FROM qt",
        qt="SELECT sid, abs(y1) / 500.0::DOUBLE AS q, 1 + nation / 10.0::DOUBLE AS a, 2 + nation / 10.0::DOUBLE AS b, 4 + nation / 10.0::DOUBLE AS c FROM s",
    ),
    "robust_interactions": sql(
        "SELECT 'y1' AS trait, n, round(b1, 7) AS beta_env, round(b2, 7) AS beta_case, round(se1, 7) AS se_env, round(se2, 7) AS se_case, round(wald, 7) AS joint_wald, 2 AS joint_df, round(exp(-wald / 2), 7) AS joint_p, round(kp, 7) AS kernel_p, round(bz, 7) AS burden_z, round(bp, 7) AS burden_p FROM rh CROSS JOIN ri",
        **_ROBUST,
    ),
    "ld_genomewide": sql(
        """SELECT idx AS vid, round(v, 7) AS v, round(max(l2) FILTER (a = 'base'), 7) AS l2_base, round(max(l2) FILTER (a = 'low'), 7) AS l2_low, round(max(l2) FILTER (a = 'promo'), 7) AS l2_promo, round(max(mc) FILTER (a = 'base'), 7) AS var_base
        FROM (SELECT ms.idx, w.v, ms.a, raw - m / (n - 3) AS l2, mc FROM ms JOIN w USING (idx) JOIN mm USING (a) CROSS JOIN nn) GROUP BY idx, v""",
        **_PROBED,
    ),
    "ld_corrections": sql("SELECT a, b, m_a, m_b, round(r2, 8) AS r2, round(mu22, 8) AS mu22, round(rho2, 8) AS rho2, round(s - m_a * m_b * rho2, 8) AS bias, round(mu22 - 1 - 2 * rho2, 8) AS delta FROM co", **_CORRECTED),
    "covariate_leverage": sql("SELECT CAST(k AS INTEGER) AS k, 3 AS rank, round(q0 * q0 + q1 * q1 + q2 * q2, 10) AS leverage FROM kq", **_WIDE),
    "context_same_person": sql(
        "SELECT a.p, b.p AS s, sum(a.x * b.x) AS value FROM dg a JOIN dg b USING (sid) GROUP BY 1, 2",
        dg="SELECT sid, unnest([0, 1, 2]) AS p, unnest([1.0::DOUBLE, CAST(env AS DOUBLE), CAST(\"case\" + 1 AS DOUBLE)]) AS x FROM s",
    ),
    "response_scales": sql(
        "SELECT o.a, o.b, round(2 * r.value * c.value / z.value + 0.5 * (o.value - r.value * c.value / z.value), 6) AS value FROM m2 o JOIN m2 r ON r.a = o.a AND r.b = 0 JOIN m2 c ON c.b = o.b AND c.a = 0 JOIN m2 z ON z.a = 0 AND z.b = 0",
        m2=_SECOND,
    ),
    "gwas_adjusted": sql("SELECT trait, idx, CAST(n AS BIGINT) AS n, round(vgy / vg, 5) AS beta_g, round(sqrt(greatest(vy - vgy * vgy / vg, 0.0) / (n - 3) / vg), 5) AS se_g FROM az WHERE vg > 1e-9 * sgg", **_ADJ),
    "gwas_by_ancestry": sql(
        """SELECT trait, idx, CAST(n AS BIGINT) AS n, round(b0, 3) AS beta_g0, round(b1, 3) AS beta_g1, round(sqrt(greatest(vy - b0 * u - b1 * w, 0.0) / (n - 3) * i0), 3) AS se_g0, round(sqrt(greatest(vy - b0 * u - b1 * w, 0.0) / (n - 3) * i1), 3) AS se_g1
        FROM bw WHERE 1 / i0 > 1e-9 * q0 AND 1 / i1 > 1e-9 * q1""",
        **_ADJ,
    ),
    "residual_variance_two": sql(
        "SELECT idx, round(r2, 9) AS r2, round(CASE WHEN xx > 0 THEN (1 - r2) * (n - 1) / (n - 3) ELSE 0.0 END, 9) AS v FROM vv",
        va="SELECT CAST(count(*) AS DOUBLE) AS n, sum(nation) AS s1, sum(y2) AS s2, CAST(sum(nation * nation) AS DOUBLE) AS q1, CAST(sum(y2 * y2) AS DOUBLE) AS q2, CAST(sum(nation * y2) AS DOUBLE) AS q12 FROM s",
        vb="SELECT idx, sum(g) AS sg, sum(g * g) AS sgg, sum(g * nation) AS g1, sum(g * y2) AS g2 FROM d JOIN s USING (sid) GROUP BY idx",
        vc="SELECT idx, n, sgg - sg * sg / n AS xx, g1 - sg * s1 / n AS c1, g2 - sg * s2 / n AS c2, q1 - s1 * s1 / n AS a, q12 - s1 * s2 / n AS b, q2 - s2 * s2 / n AS e FROM vb CROSS JOIN va",
        vv="SELECT idx, n, xx, CASE WHEN xx > 0 THEN (c1 * (c1 * e - b * c2) + c2 * (a * c2 - b * c1)) / (a * e - b * b) / xx ELSE 0.0 END AS r2 FROM vc",
    ),
    "strand_flips": sql(
        """SELECT round(anc, 9) AS ancestry, CAST(count(*) FILTER (amb) AS BIGINT) AS ambiguous_snps, round(avg(wrong) FILTER (amb), 9) AS ambiguous_discordant, CAST(count(*) FILTER (NOT amb) AS BIGINT) AS other_snps, round(avg(wrong) FILTER (NOT amb), 9) AS other_discordant,
        coalesce(count(*) FILTER (amb) >= 50 AND avg(wrong) FILTER (amb) > greatest(0.05, 3 * coalesce(avg(wrong) FILTER (NOT amb), 0.0) + 0.01), false) AS fails FROM sw GROUP BY anc""",
        sa=_STRAND, sb="SELECT *, base + delta * 0.4 + (idx % 7 - 3) / 100.0::DOUBLE AS f FROM sa", sc="SELECT idx, amb, base, delta, CASE WHEN amb AND idx % 3 = 0 THEN 1 - f ELSE f END AS freq FROM sb WHERE abs(delta) >= 0.2",
        sf="SELECT count(*) AS n, sum(delta * (freq - base)) / sum(delta * delta) AS anc FROM sc WHERE NOT amb",
        se_="SELECT sc.*, anc, least(greatest(base + delta * anc, 0.0), 1.0) AS e FROM sc CROSS JOIN sf WHERE sf.n >= 50",
        sw="SELECT *, CAST(abs(freq - (1 - e)) + 0.05 < abs(freq - e) AS DOUBLE) AS wrong FROM se_ WHERE abs(2 * e - 1) > 0.2",
    ),
    "auc_contrasts": sql(
        "SELECT n AS strata, round(a.auc - b.auc, 6) AS diff, round((a.auc - b.auc) / sqrt(a.se * a.se + b.se * b.se), 6) AS diff_z, round(top / sp, 6) AS trend, round(top / sp * sqrt(sp), 6) AS trend_z FROM ct CROSS JOIN cs a CROSS JOIN cs b WHERE n > 1 AND a.o = lo AND b.o = hi",
        cs=f"SELECT CAST(substr(stratum, 1, 1) AS DOUBLE) AS o, auc, se, 1 / (se * se) AS w FROM ({FIRST['auc_delong']})",
        ct="SELECT count(*) AS n, min(o) AS lo, max(o) AS hi, sum(w * o * auc) - sum(w * o) * sum(w * auc) / sum(w) AS top, sum(w * o * o) - power(sum(w * o), 2) / sum(w) AS sp FROM cs",
    ),
    "ld_curve_smooth": sql("SELECT a.cell, round(avg(b.mean_r2), 9) AS smooth FROM lc a JOIN lc b ON abs(a.cell - b.cell) <= greatest(1.5, 0.1 * a.cell) GROUP BY a.cell", lc=f"SELECT * FROM ({FIRST['ld_curve_cells']})"),
    "box_cox": sql(
        "SELECT o_orderkey, round(t * i0, 8) + 0.0 AS b0, round(power(t, 2) * i1, 8) + 0.0 AS b1, round(power(t, 3) * i2, 8) + 0.0 AS b2 FROM b3",
        b0="SELECT o_orderkey, ln(o_totalprice) - 10 AS t, (ln(o_totalprice) - 10) * 0.5 AS x FROM orders",
        b1=f"SELECT *, {_I0} AS i0 FROM b0",
        b2=f"SELECT *, CASE WHEN abs(x) <= 0.5 THEN {_SERIES(1)} ELSE (exp(x) - i0) / x END AS i1 FROM b1",
        b3=f"SELECT *, CASE WHEN abs(x) <= 0.5 THEN {_SERIES(2)} ELSE (exp(x) - 2 * i1) / x END AS i2 FROM b2",
    ),
    "standardised_values": sql("SELECT sid, segment, " + ", ".join(f"round(CASE WHEN stddev_pop({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END, 8) AS {c}" for c in ("y1", "y2")) + " FROM s WINDOW w AS (PARTITION BY segment)"),
    "context_terms": sql('SELECT sid, env, "case", 1.0::DOUBLE AS one, CAST(env * env AS DOUBLE) AS env2, CAST(env * "case" AS DOUBLE) AS env_case FROM s'),
    "read_bim": sql("SELECT CAST(chr AS VARCHAR) AS chr, snp, 0.5::DOUBLE AS cm, bp, a1, a2, pos AS idx FROM v"),
    "read_fam": sql("SELECT 'f' || nation AS fid, 'i' || sid AS iid, '0' AS father, '0' AS mother, CAST(sid % 2 + 1 AS INTEGER) AS sex, '-9' AS pheno, row_number() OVER (ORDER BY sid) - 1 AS idx FROM s"),
    "read_pvar": sql("SELECT CAST(chr AS VARCHAR) AS chr, bp, snp, a2, a1 FROM v"),
    "read_psam": sql("SELECT 'f' || nation AS fid, 'i' || sid AS iid FROM s"),
    "read_pairs": sql("SELECT least('i' || a, 'i' || b) AS iid1, greatest('i' || a, 'i' || b) AS iid2, (a % 50) / 100.0::DOUBLE AS kinship FROM pair WHERE a % 50 >= 5"),
    "read_bed": sql("SELECT row_number() OVER (ORDER BY vid) - 1 AS idx, CAST(sum(((x % 4) + 4) % 4 - 1) AS BIGINT) AS total, CAST(count(*) FILTER (((x % 4) + 4) % 4 = 0) AS INTEGER) AS missing FROM e GROUP BY vid"),
    "read_pgen": sql(
        "SELECT idx, sum(coalesce(x, 0.0)) AS total, CAST(count(*) FILTER (x IS NULL) AS INTEGER) AS missing FROM pg WHERE k % 2 = 1 AND idx >= 10 GROUP BY idx",
        pg="SELECT dense_rank() OVER (ORDER BY vid) - 1 AS idx, k, CASE WHEN x % 5 = 0 THEN NULL WHEN ((x % 5) + 5) % 5 < 4 THEN CAST(((x % 3) + 3) % 3 AS DOUBLE) ELSE (((x % 257) + 257) % 257) / 128.0::DOUBLE END AS x FROM e",
    ),
    "read_ld_scores": sql("SELECT CAST(chr AS INTEGER) AS chr, snp, bp, round(price / 1000.0::DOUBLE, 3) AS l2_base, round((idx % 8) / 8.0::DOUBLE, 3) AS l2_low FROM v"),
    "read_sumstats": sql("SELECT trait, 'rs' || idx AS snp, CAST(n AS DOUBLE) AS n, round(beta, 6) AS beta, CASE WHEN idx % 13 > 0 THEN round(se, 6) END AS se FROM gw WHERE trait = 'y1'"),
    "read_phenotypes": sql("SELECT 'f' || nation AS fid, 'i' || sid AS iid, 'a' AS trait, CAST(y1 AS DOUBLE) AS y FROM s WHERE sid % 7 > 0 AND y1 <> -9 UNION ALL SELECT 'f' || nation, 'i' || sid, 'b', CAST(y2 AS DOUBLE) FROM s WHERE sid % 5 > 0 AND y2 <> -9"),
    "read_covariates": sql(
        "SELECT fid, iid, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 7) AS {c}" for c in ("env", "segment_BUILDING", "segment_FURNITURE", "segment_HOUSEHOLD", "segment_MACHINERY")) + " FROM cv",
        cv="SELECT 'f' || nation AS fid, 'i' || sid AS iid, CAST(env AS DOUBLE) AS env, " + ", ".join(f"CAST(segment = '{x}' AS DOUBLE) AS segment_{x}" for x in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM s WHERE sid % 11 > 0",
    ),
    "read_environment": sql("SELECT 'f' || nation AS fid, 'i' || sid AS iid, CAST(env AS DOUBLE) AS env FROM s WHERE sid % 2 = 0 AND sid % 9 > 0"),
    "read_kmoments": sql("SELECT CAST(count(*) AS DOUBLE) AS nsnps, 3.0::DOUBLE AS proj_rank, CAST(sum(low) AS DOUBLE) AS t0_rank, CAST(sum(high) AS DOUBLE) AS t1_rank, CAST(sum(promo) AS DOUBLE) AS t2_rank FROM v"),
    "read_annotation_sizes": sql("SELECT unnest([0, 1, 2]) AS bin, unnest([CAST(count(*) AS DOUBLE), CAST(sum(low) AS DOUBLE), CAST(sum(promo) AS DOUBLE)]) AS m FROM v"),
    "read_weight_scores": sql("SELECT snp, round(price / 100.0::DOUBLE, 4) AS w FROM v WHERE idx % 3 = 0"),
    "read_thin_annotations": sql("SELECT idx, pos, CAST(high AS DOUBLE) AS first, CAST(promo AS DOUBLE) AS second FROM v"),
    "read_annotation_classes": sql("SELECT snp, idx, CAST(CASE WHEN idx % 4 > 0 THEN low ELSE 0 END AS DOUBLE) AS a, CAST(CASE WHEN idx % 4 > 0 THEN high ELSE 0 END AS DOUBLE) AS b FROM v"),
    "read_population_scale": sql("SELECT snp, a1, a2, (idx % 10) / 10.0::DOUBLE AS mean, 1.25::DOUBLE AS inv_sd FROM v"),
    "read_rg_manifest": "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS row, n_name AS phen1, 'other' AS phen2, '/a/' || n_nationkey AS sumstats1, '/b' AS sumstats2, n_nationkey / 100.0::DOUBLE AS overlap_covariance, CAST(n_regionkey AS DOUBLE) AS cov_rank1, CAST(NULL AS DOUBLE) AS cov_rank2, CAST(NULL AS VARCHAR) AS rel_m12 FROM nation WHERE n_nationkey < 5",
}
