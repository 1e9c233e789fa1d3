"""Operators on carriers against the same on dense rows."""

import numpy as np
import pandas as pd
import pytest

from sgspark.operators import basis, blocks, longrange, sparse

N, M = 60, 40


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    g = rng.choice(3, (M, N), p=[0.8, 0.15, 0.05])
    g[3], g[4] = 2, 0  # the same in all samples; no carrier
    return g


@pytest.fixture(scope="module")
def calls(spark, table):
    j, k = np.nonzero(table)
    return spark.createDataFrame(pd.DataFrame({"vid": j, "k": k, "g": table[j, k]})).cache()


@pytest.mark.parametrize("weighted", [False, True])
def test_genomewide_equals_dense(spark, table, calls, weighted, monkeypatch):
    notes = spark.createDataFrame([(j, 1.0, float(j % 3 == 0), j % 4 / 2) for j in range(M)], "vid long, base double, third double, part double")
    people = spark.createDataFrame([(k, float(k % 5), float(k * k % 7)) for k in range(N)], "k int, c double, e double")
    q = basis.orthonormal(people, ["c", "e"])
    carried = [j for j in range(M) if table[j].any()]
    panel = spark.createDataFrame([(j, table[j].astype(float).tolist()) for j in carried], "vid long, e array<double>").join(notes, "vid")
    names = ["base", "third", "part"]
    want = blocks.genomewide(panel, names, 5, q.rows.select("k", "q"), q.rank, weighted)
    monkeypatch.setattr(blocks, "densified", None)
    got = sparse.genomewide(calls, notes, names, 5, q.rows, q.rank, N, weighted)
    for a, b, key in ((got.scores, want.scores, ["vid"]), (got.corrections, want.corrections, ["a", "b"])):
        a, b = (x.toPandas().sort_values(key).reset_index(drop=True) for x in (a, b))
        assert list(a.columns) == list(b.columns) and len(a) == len(b) > 0
        for c in a.columns:
            if a[c].dtype.kind == "f":
                assert np.allclose(a[c], b[c], rtol=1e-9, atol=1e-9), c
            else:
                assert (a[c] == b[c]).all(), c


def test_negative_weights_raise(spark, calls):
    q = basis.orthonormal(spark.range(N).selectExpr("cast(id AS int) AS k"), [])
    with pytest.raises(Exception, match="negative"):
        sparse.genomewide(calls, spark.range(M).selectExpr("id AS vid", "-1.0D AS base"), ["base"], 2, q.rows, q.rank, N).scores.collect()


@pytest.mark.parametrize("side", [16, 2048])
def test_traces_equal_dense(spark, table, calls, side):
    unit = spark.createDataFrame([(j, j % 4) for j in range(M)], "vid long, unit int")
    panel = spark.createDataFrame([(j, table[j].astype(float).tolist()) for j in range(M)], "vid long, e array<double>").join(unit, "vid")
    want = longrange.unit_traces(panel, "unit", 5, 10, 4, side=side).orderBy("g", "h").toPandas()
    got = longrange.carried_traces(calls, unit, 5, N, 10, 4, side=side).orderBy("g", "h").toPandas()
    assert len(want) == 25 and np.allclose(got, want, rtol=1e-9, atol=1e-9)
