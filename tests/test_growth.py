"""What keeps a task's share small."""

import re
from pathlib import Path

import numpy as np

from pyspark.sql import functions as F

from compare import assert_same
from sgspark.operators import gwas, ldscore, solve, traits
from sgspark.plans import models, queries
from sgspark.plans.registry import ORACLE_SQL, QUERIES
from sgspark.sources import files, tables


def test_tables_without_an_order_are_written_by_many_tasks(spark):
    rows = spark.range(0, 100, 1, 4).select(F.concat(F.lit("i"), "id").alias("IID1"), F.concat(F.lit("j"), "id").alias("IID2"), (F.col("id") / 100).alias("KINSHIP"))
    path = models._put(rows, "pairs")
    assert len(list(Path(path.removeprefix("file:")).glob("part-*"))) == 4
    got = files.pairs(spark, path, 0.05).collect()
    assert sorted(r["iid1"] for r in got) == sorted(f"i{k}" for k in range(5, 100))


def test_heritability_makes_the_dosages_once(spark, sf_dir):
    plan = queries._h2_rows(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "y1" in plan


def test_dosages_of_large_tables_are_dealt_to_more_partitions(spark, sf_dir, duck, monkeypatch):
    monkeypatch.setattr(tables, "PART", 500)
    parts = -(-duck.execute("SELECT count(*) FROM lineitem").fetchone()[0] // 500)
    assert tables.parts_of(spark, sf_dir) == parts > 4
    assert tables.dosage(spark, sf_dir).rdd.getNumPartitions() == parts
    for name in ("v_dosage", "gwas_ols", "gwas_adjusted", "gwas_by_ancestry"):
        rows = QUERIES[name](spark, sf_dir)
        assert_same(rows.toPandas(), duck.execute(ORACLE_SQL[name]).df())
        if name in ("gwas_adjusted", "gwas_by_ancestry"):  # the join by sample, of which a task groups what it joins
            plan = rows._jdf.queryExecution().optimizedPlan().toString()
            assert len(re.findall(rf"RepartitionByExpression \[sid#\d+L?\], {parts}\b", plan)) >= 2


def test_solver_shuffles_the_dosages_before_its_rounds_only(spark, monkeypatch):
    rng = np.random.default_rng(5)
    g, y = rng.integers(0, 3, (23, 31)), rng.normal(size=23)
    g[7] = 0  # a sample that carries nothing
    dosage = spark.createDataFrame([(int(j) * 10**12, int(i) - 9, int(g[i, j])) for i in range(23) for j in range(31) if g[i, j]], "idx long, sid long, g long")
    scale = traits.scale(gwas.variant_sums(dosage), spark.createDataFrame([(23,)], "n long"))
    plans, product = [], solve._products
    monkeypatch.setattr(solve, "_products", lambda calls, vector: (plans.append(calls._jdf.queryExecution().executedPlan().toString()), product(calls, vector))[1])
    people = spark.createDataFrame([(i - 9, float(v)) for i, v in enumerate(y)] + [(99, None)], "sid long, y double")
    got = solve.conjugate_gradients(dosage, scale, people, 0.5, 60, parts=3, side=4).orderBy("sid").toPandas()["u"].to_numpy()
    x = (g - g.mean(0)) / g.std(0, ddof=1)
    assert np.allclose(got[:-1], np.linalg.solve(x @ x.T / 31 + 0.5 * np.eye(23), y), atol=1e-6) and np.isnan(got[-1])
    assert plans and not any("Exchange" in p or "Join" in p for p in plans)


def test_window_ld_makes_dosages_and_pairs_once(spark, sf_dir, duck):
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    for name in ("h2_v_weighted", "h2_tau_star", "rg_partitioned", "rg_supplied_c", "rg_long_range"):
        assert "l_partkey" not in plan(QUERIES[name](spark, sf_dir)), name
    axis, dosage, n = tables.variants(spark, sf_dir), tables.dosage(spark, sf_dir), queries._n(spark, sf_dir)
    made = plan(ldscore.window_scores(axis, dosage, gwas.variant_sums(dosage), n, 20, axis.select("idx", "low"), ["low"], 7))
    # two explodes: of a variant to its buckets and of a pair to its two variants; dosages are sorted by sample instead
    assert made.count("Generate explode") == 2 and re.search(r"RepartitionByExpression \[sid#\d+L?\], 7\b", made)


def test_band_products_across_batches(spark, monkeypatch):
    rng = np.random.default_rng(4)
    cells = [(int(i), int(k), int(g)) for i in range(60) for k in range(40) if (g := rng.integers(0, 3)) and rng.random() < 0.5]
    axis = spark.createDataFrame([(i, 1 + i // 25, (i * 7) % 60) for i in range(60)], "idx long, chr int, pos long")
    dosage = spark.createDataFrame(cells, "idx long, sid long, g long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "17")
    try:
        got = {(r["i"], r["j"]): r["sgg"] for r in ldscore.band_products(axis, dosage, 9, 3).collect()}
    finally:
        spark.conf.set(key, before)
    g = np.zeros((60, 40), int)
    for i, k, x in cells:
        g[i, k] = x
    place = {i: (1 + i // 25, (i * 7) % 60) for i in range(60)}
    want = {(i, j): int(g[i] @ g[j]) for i in range(60) for j in range(60) if place[i][0] == place[j][0] and 0 < place[j][1] - place[i][1] <= 9 and g[i] @ g[j]}
    assert got == want
