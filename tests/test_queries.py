import numpy as np
import pytest

from compare import assert_same
from sgspark.plans.registry import ORACLE_SQL, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"pgs_solve", "mixture_effects"}  # iterative: tested against numpy


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark, sf_dir, duck):
    assert_same(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df())


def test_pgs_solve_against_numpy(spark, sf_dir, duck):
    y = duck.execute("SELECT c_custkey AS sid, round(c_acctbal) AS y FROM customer ORDER BY 1").df()
    pairs = duck.execute("SELECT l_partkey AS idx, o_custkey AS sid, least(2, count(*)) AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2").df()
    g = pairs.pivot(index="sid", columns="idx", values="g").reindex(y["sid"]).fillna(0).to_numpy(dtype=float)
    x = g[:, g.std(0) > 0]
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    want = np.linalg.solve(x @ x.T / x.shape[1] + np.eye(len(y)), (y["y"] - y["y"].mean()) / 1000)
    got = QUERIES["pgs_solve"](spark, sf_dir).toPandas().sort_values("sid")
    assert list(got["sid"]) == list(y["sid"]) and abs(got["u"] - want).max() < 6e-7


def test_mixture_effects_against_numpy(spark, sf_dir, duck):
    y = duck.execute("SELECT c_custkey AS sid, round(c_acctbal) AS y FROM customer ORDER BY 1").df()
    pairs = duck.execute("SELECT l_partkey AS idx, o_custkey AS sid, least(2, count(*)) AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2").df()
    g = pairs.pivot(index="sid", columns="idx", values="g").reindex(y["sid"]).fillna(0)
    x = g.to_numpy(dtype=float)
    x = ((x - x.mean(0)) / x.std(0, ddof=1)).T
    r = ((y["y"] - y["y"].mean()) / y["y"].std()).to_numpy()
    got = QUERIES["mixture_effects"](spark, sf_dir).where("trait = 'y1' AND candidate = 'even'").toPandas().set_index("vid")["beta"]
    # equal components are one normal, whose fixed point is a ridge regression; three sweeps come near it from below
    ridge = np.linalg.solve(x @ x.T / 0.6 + np.eye(len(x)) * len(x) / 0.4, x @ r / 0.6)
    near = got.loc[g.columns].to_numpy()
    assert np.corrcoef(near, ridge)[0, 1] > 0.95 and np.sum((r - near @ x) ** 2) < np.sum(r**2)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
