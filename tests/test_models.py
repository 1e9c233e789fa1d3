"""The general estimators against numpy, the readers' refusals, and fits from files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sgspark import fits
from sgspark.__main__ import main
from sgspark.functions import linear, transforms
from sgspark.operators import components, contexts, gwas, ldsc
from sgspark.sources import files, inputs

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def summary(spark):
    """300 variants in 6 units with three overlapping annotations, as a table and as arrays."""
    rng = np.random.default_rng(4)
    m = 300
    notes = np.column_stack([np.ones(m), rng.integers(0, 2, m), rng.integers(0, 2, m)]).astype(float)
    ld = rng.uniform(1, 4, (m, 3)) * [1, 0.5, 0.4]
    unit = np.repeat(np.arange(6), [40, 60, 50, 50, 70, 30])
    z = rng.normal(size=(2, m)) * np.sqrt(1 + ld @ [0.4, 0.3, 0.2])
    rows = [(t, int(unit[j]), 5000.0, float(z[i, j] ** 2), 1.0, *map(float, notes[j]), *map(float, ld[j])) for i, t in enumerate(("one", "two")) for j in range(m)]
    table = spark.createDataFrame(rows, "trait string, unit int, n_star double, y double, d double, a double, b double, c double, l2_a double, l2_b double, l2_c double")
    pair = [(int(unit[j]), float(z[0, j]), float(z[1, j]), 5000.0, 5000.0, float(z[0, j] ** 2), float(z[1, j] ** 2), 1.0, 1.0, *map(float, notes[j]), *map(float, ld[j])) for j in range(m)]
    both = spark.createDataFrame(pair, "unit int, z1 double, z2 double, n1 double, n2 double, y1 double, y2 double, d1 double, d2 double, a double, b double, c double, l2_a double, l2_b double, l2_c double")
    return table, both, notes, ld, unit, z


def he(notes, ld, y, keep, n=5000.0, noise=1.0):
    a = notes[keep]
    t = n * n * (a.T @ ld[keep]) / np.outer(a.sum(0), notes.sum(0))
    return np.linalg.solve((t + t.T) / 2, n * (a.T @ (y[keep] - noise)) / a.sum(0))


def jackknifed(values, full, sizes):
    sizes = np.asarray(sizes, float)[np.isfinite(values)]
    values = values[np.isfinite(values)]
    total = sizes.sum()
    pseudo = (total * full - (total - sizes) * values) / sizes
    w = sizes / total
    return np.sqrt((w**2 / (1 - w) * (pseudo - (w * pseudo).sum()) ** 2).sum())


def test_components(summary):
    table, _, notes, ld, unit, z = summary
    got = {(r["trait"], r["quantity"]): r for r in components.h2(table, NAMES, allow_negative=True).collect()}
    sizes = np.bincount(unit)
    for i, trait in enumerate(("one", "two")):
        y = z[i] ** 2
        every = np.ones(len(y), bool)
        full, left = he(notes, ld, y, every), np.array([he(notes, ld, y, unit != u) for u in range(6)])
        for k, name in enumerate(NAMES):
            assert np.isclose(got[trait, f"sigma_{name}"]["estimate"], full[k])
            assert np.isclose(got[trait, f"sigma_{name}"]["se"], jackknifed(left[:, k], full[k], sizes))
        tau = full / notes.sum(0)
        category = (notes.T @ notes) @ tau
        assert np.isclose(got[trait, "h2_b"]["estimate"], category[1])
        assert np.isclose(got[trait, "enrichment_c"]["estimate"], category[2] / full.sum() / (notes[:, 2].sum() / len(y)))
        assert np.isclose(got[trait, "tau_star_b"]["estimate"], tau[1] * notes[:, 1].std() / (full.sum() / len(y)))


def test_correlations(spark, summary):
    _, both, notes, ld, unit, z = summary
    got = {r["quantity"]: r for r in components.rg(both, NAMES, spark.createDataFrame([(0.1,)], "c double")).collect()}

    def fit(keep):  # a correlation isn't defined where a variance isn't positive
        g = he(notes, ld, z[0] * z[1], keep, noise=0.1)
        a, b = (he(notes, ld, z[i] ** 2, keep).sum() for i in (0, 1))
        return g.sum(), g.sum() / np.sqrt(a * b) if min(a, b) > 0 else np.nan

    every = np.ones(len(unit), bool)
    left = np.array([fit(unit != u) for u in range(6)])
    for k, name in enumerate(("gamma", "rg")):
        assert np.isclose(got[name]["estimate"], fit(every)[k]) and np.isclose(got[name]["se"], jackknifed(left[:, k], fit(every)[k], np.bincount(unit)))


def test_ldsc_refits(summary):
    table, _, notes, ld, unit, z = summary
    got = {(r["trait"], r["quantity"]): r for r in ldsc.h2(table, NAMES).collect()}

    def fit(y, keep):
        x, q, total = 5000 * ld[keep] / notes.sum(0), y[keep] - 1, np.maximum(ld[keep].sum(1), 1)
        h = np.linalg.lstsq(x, q, rcond=None)[0]
        for _ in range(3):
            mean = np.maximum(1 + np.clip(h.sum(), 0, 1) * 5000 / notes.sum() * total, 1e-3)
            w = 1 / (2 * mean**2 * total)
            h = np.linalg.solve((x * w[:, None]).T @ x, x.T @ (w * q))
        return h

    full = fit(z[1] ** 2, np.ones(len(unit), bool))
    left = np.array([fit(z[1] ** 2, unit != u) for u in range(6)])
    assert np.allclose([got["two", f"h2_{k}"]["estimate"] for k in NAMES], full)
    assert np.isclose(got["two", "total"]["se"], jackknifed(left.sum(1), full.sum(), np.bincount(unit)))


def test_singular_systems_get_the_solution_of_least_norm(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, y double")
    out = rows.select(linear.solve([[F.col("x"), F.col("x")], [F.col("x"), F.col("x")]], [F.col("y"), F.col("y")]).alias("s")).collect()
    assert np.allclose([r["s"] for r in out], [[1, 1], [1, 1]])


def test_adjusted_regression(spark):
    rng = np.random.default_rng(2)
    g, c, y = rng.integers(0, 3, (5, 80)), rng.normal(size=(80, 2)), rng.normal(size=80)
    g[4] = 0
    dosage = spark.createDataFrame([(i, s, int(x)) for i in range(5) for s, x in enumerate(g[i]) if x], "idx int, sid int, g int")
    out = gwas.adjusted(dosage, spark.createDataFrame([("t", s, float(v)) for s, v in enumerate(y)], "trait string, sid int, y double"), spark.createDataFrame([(s, *map(float, r)) for s, r in enumerate(c)], "sid int, c1 double, c2 double"), ["c1", "c2"])
    got = {r["idx"]: r for r in out.collect()}
    assert set(got) == {0, 1, 2, 3}
    for i in range(4):
        x = np.column_stack([np.ones(80), c, g[i]])
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        v = ((y - x @ b) ** 2).sum() / 76 * np.linalg.inv(x.T @ x)[3, 3]
        assert np.allclose([got[i]["beta_g"], got[i]["se_g"]], [b[3], np.sqrt(v)])


def test_gene_environment_equations_for_two_annotations(spark):
    rng = np.random.default_rng(3)
    e = rng.integers(0, 3, (40, 12))
    a = np.column_stack([np.ones(40), rng.integers(0, 2, 40)]).astype(float)
    env, y = rng.normal(size=12), rng.normal(size=12)
    panel = spark.createDataFrame([(i, [int(x) for x in e[i]], *map(float, a[i])) for i in range(40)], "vid long, e array<long>, all double, some double")
    totals = contexts.gxe_totals(env.tolist(), y.tolist())
    got = contexts.gxe_equations(contexts.gxe_panel(panel, env.tolist(), y.tolist(), ["all", "some"]), spark.createDataFrame([totals]), ["all", "some"])
    lhs, rhs = np.array(got.first()["lhs"]), np.array(got.first()["rhs"])
    p = np.eye(12) - 1 / 12
    x = (e @ p) / np.sqrt((e @ p @ e.T).diagonal() / 11)[:, None]
    w = (x * env) @ p
    t = y @ p
    t *= np.sqrt(11 / (t @ t))
    kernels = [(f * a[:, [k]]).T @ f / a[:, k].sum() for f in (x, w) for k in (0, 1)] + [p @ np.diag(env**2) @ p, p]
    assert np.allclose(lhs, [[np.trace(i @ j) for j in kernels] for i in kernels]) and np.allclose(rhs, [t @ k @ t for k in kernels])
    fit = {r["component"]: r for r in contexts.gxe_fit(got, 6).collect()}
    want = np.linalg.solve(lhs, rhs)
    assert np.allclose([fit[n]["estimate"] for n in got.first()["names"]], want) and np.isclose(sum(r["proportion"] for r in fit.values()), 1)


def test_transforms(spark):
    rows = spark.createDataFrame([(0.5, "x"), (-2.0, "x"), (8.0, "y")], "v double, k string")
    out = rows.select(transforms.transformed(F.col("v"), "log", 1.0).alias("l"), transforms.transformed(F.col("v"), "box_cox", 3.0, 0.5).alias("b"), *[d.alias(f"d{k}") for k, d in enumerate(transforms.box_cox_derivatives(F.col("v"), 0.4, 2))]).collect()
    assert np.isclose(out[0]["l"], np.log(1.5)) and out[1]["l"] is None and np.isclose(out[2]["b"], (np.sqrt(11) - 1) / 0.5)
    step = 1e-4
    f = lambda t, p: (np.exp(p * t) - 1) / p
    for r, t in zip(out, (0.5, -2.0, 8.0)):
        assert np.isclose(r["d0"], f(t, 0.4)) and np.isclose(r["d1"], (f(t, 0.4 + step) - f(t, 0.4 - step)) / (2 * step), rtol=1e-4)
    with pytest.raises(ValueError):
        transforms.transformed(F.col("v"), "log", 1.0, 0.5)
    constant = transforms.standardised(rows, ["v"], ["k"]).where("k = 'y'").first()
    assert constant["v"] is None


def put(path, text):
    path.write_text(text)
    return str(path)


def test_readers_refuse(spark, tmp_path):
    people = spark.createDataFrame([("f", "a"), ("f", "b")], "fid string, iid string")
    axis = spark.createDataFrame([("r1", 0, "A", "C"), ("r2", 1, "G", "T")], "snp string, pos int, a1 string, a2 string")
    bad = {
        "twice": lambda p: inputs.sample_rows(spark, put(p, "FID\tIID\tx\nf\ta\t1\nf\ta\t2\n")),
        "no number": lambda p: inputs.phenotypes(spark, put(p, "FID\tIID\tx\nf\ta\tword\n")).count(),
        "lacks a sample": lambda p: inputs.covariates(spark, put(p, "FID\tIID\tx\nf\ta\t1\n"), people),
        "that varies": lambda p: inputs.covariates(spark, put(p, "FID\tIID\tx\nf\ta\t1\nf\tb\t1\n"), people),
        "name one": lambda p: inputs.environment(spark, put(p, "FID\tIID\tx\ty\nf\ta\t1\t2\n"), people),
        "no column": lambda p: inputs.kmoments(spark, put(p, "nsnps proj_rank\n1 2\n")),
        "instead of one": lambda p: inputs.kmoments(spark, put(p, "nsnps proj_rank t0_rank t1_rank t2_rank\n1 2 3 4 5\n1 2 3 4 6\n")),
        "another number": lambda p: inputs.annotation_sizes(spark, put(p, "1 2\n"), 3),
        "without variants": lambda p: inputs.annotation_sizes(spark, put(p, "1 0\n"), 2),
        "lacks a variant": lambda p: inputs.weight_scores(spark, put(p, "CHR\tSNP\tBP\tL2\n1\tr1\t1\t2\n"), axis),
        "lines for": lambda p: inputs.thin_annotations(spark, put(p, "1 0\n"), axis),
        "partition": lambda p: inputs.annotation_classes(spark, put(p, "SNP\ta\tb\nr1\t1\t1\n"), axis),
        "differs": lambda p: inputs.population_scale(spark, put(p, "SNP\tA1\tA2\tMEAN\tINV_SD\nr1\tA\tC\t1\t1\nr2\tT\tG\t1\t1\n"), axis),
        "has both": lambda p: inputs.rg_manifest(spark, put(p, "phen1\tphen2\tsumstats1\tsumstats2\toverlap_covariance\tintercept_rg\na\tb\tc\td\t0\t0\n")),
        "whole number": lambda p: inputs.rg_manifest(spark, put(p, "phen1\tphen2\tsumstats1\tsumstats2\toverlap_covariance\tcov_rank1\na\tb\tc\td\t0\t1.5\n")),
        "isn't a fit": lambda p: inputs.batch_manifest(put(p, '{"kind": "other"}'), "fit", ("name",)),
        "every trait": lambda p: inputs.batch_manifest(put(p, '{"kind": "fit", "schema_version": 1, "traits": [{}]}'), "fit", ("name",)),
    }
    for i, (message, read) in enumerate(bad.items()):
        with pytest.raises(ValueError, match=message):
            read(tmp_path / f"{i}.txt")
    assert inputs.missing_tokens("x, ,y") == ["x", "y"]
    assert [r["name"] for r in inputs.name_list(spark, put(tmp_path / "n.txt", "# c\na\n\na\n")).collect()] == ["a"]
    imputed = inputs.covariates(spark, put(tmp_path / "i.txt", "FID\tIID\tx\tk\nf\ta\t1\tp\nf\tb\tNA\tq\n"), people, impute=True, categorical=["k"])
    assert imputed.columns[2:] == ["k_q"] and imputed.count() == 2


def test_bed_round_trip(spark, tmp_path):
    calls = np.random.default_rng(1).integers(-1, 3, (7, 5))
    files.write_bed(spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(calls)], "idx long, calls array<tinyint>"), str(tmp_path / "x.bed"))
    assert [r["calls"] for r in files.bed(spark, str(tmp_path / "x.bed"), 5).orderBy("idx").collect()] == calls.tolist()


@pytest.fixture(scope="module")
def inputs_on_disk(tmp_path_factory):
    rng = np.random.default_rng(5)
    at = tmp_path_factory.mktemp("fits")
    m = 200
    ld = rng.uniform(1, 5, m)
    (at / "ld.txt").write_text("CHR\tSNP\tBP\tL2_base\n" + "".join(f"1\tr{j}\t{j}\t{ld[j]:.6f}\n" for j in range(m)))
    for t in ("x", "y"):
        z = rng.normal(size=m) * np.sqrt(1 + ld)
        (at / f"{t}.txt").write_text("SNP\tN\tBETA\tSE\n" + "".join(f"r{j}\t4000\t{z[j] / 60:.6f}\t{1 / 60:.6f}\n" for j in range(m)))
    return at


def test_command_line(spark, inputs_on_disk, sf_dir, capsys):
    at = inputs_on_disk
    common = ["--ldscores", str(at / "ld.txt"), "--blocks", "10"]
    assert main(["h2", "--sumstats", str(at / "x.txt"), "--trait", "x", *common, "--out", str(at / "h2")]) == 0
    rows = {r["quantity"]: r for r in spark.read.parquet(str(at / "h2")).collect()}
    assert rows["total"]["estimate"] > 0 and rows["total"]["se"] > 0 and rows["total"]["n_units"] == 10
    with pytest.raises(FileExistsError):
        main(["h2", "--sumstats", str(at / "x.txt"), *common, "--out", str(at / "h2")])
    for method in ("he", "ldsc"):
        assert main(["rg", "--sumstats", str(at / "x.txt"), str(at / "y.txt"), "--overlap-covariance", "0", *common, "--method", method, "--out", str(at / f"rg-{method}"), "--text"]) == 0
        assert files.table(spark, str(at / f"rg-{method}")).where("quantity = 'gamma'").count() == 1
    assert main(["run", "no_such", "--tables", sf_dir, "--out", str(at / "q")]) == 2
    assert main(["run", "v_variants", "--tables", sf_dir, "--out", str(at / "q")]) == 0
    capsys.readouterr()
    assert main(["queries"]) == 0 and "h2_overlapping" in capsys.readouterr().out.split()


def test_batches_go_on(spark, inputs_on_disk):
    at = inputs_on_disk
    spec = {"kind": "h2_batch", "schema_version": 1, "ldscores": str(at / "ld.txt"), "blocks": 10, "traits": [{"name": t, "sumstats": str(at / f"{t}.txt")} for t in ("x", "y")]}
    path = put(at / "batch.json", json.dumps(spec))
    fits.publish(fits.h2(spark, str(at / "x.txt"), str(at / "ld.txt"), blocks=10, trait="x"), str(at / "batch/x"))
    assert fits.h2_batch(spark, path, str(at / "batch")) == ["y"] and fits.h2_batch(spark, path, str(at / "batch")) == []
    table = put(at / "pairs.tsv", f"phen1\tphen2\tsumstats1\tsumstats2\toverlap_covariance\nx\ty\t{at}/x.txt\t{at}/y.txt\t0.0\n")
    assert fits.rg_batch(spark, table, str(at / "ld.txt"), str(at / "pairs"), blocks=10) == ["x.y"]
    with pytest.raises(ValueError, match="names"):
        fits.batch(spark, [("a", None), ("a", None)], str(at / "no"))
