import gzip

import numpy as np
import pytest

from sgspark.sources import files


def put(path, text):
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(text)
    return str(path)


def test_sumstats(spark, tmp_path):
    at = put(tmp_path / "a.txt.gz", "ID\tA1\tREF\tOBS_CT\tBETA\tSE\tP_EFF\nrs1\tA\tC\t100\t0.5\t0.1\t3\nNA\tA\tC\tx\t.\t0.1\t3\n")
    rows = files.sumstats(spark, at, "t").orderBy("line").collect()
    assert [(r["snp"], r["a2"], r["n"], r["beta"], r["cov_rank"]) for r in rows] == [("rs1", "C", 100.0, 0.5, 3.0), ("NA", "C", None, None, 3.0)]
    blank = put(tmp_path / "b.txt", "SNP  N BETA SE\n rs1 5  1 2\nrs2 6 1 2\n")
    assert files.sumstats(spark, blank, "t").count() == 2
    with pytest.raises(ValueError, match="no column"):
        files.sumstats(spark, put(tmp_path / "c.txt", "SNP\tN\trs\n1\t2\t3\n"), "t")
    with pytest.raises(ValueError, match="whole number"):
        files.sumstats(spark, put(tmp_path / "d.txt", "SNP\tN\tBETA\tSE\tCOV_RANK\na\t1\t1\t1\t2\nb\t1\t1\t1\t3\n"), "t")


def test_ld_scores_by_chromosome(spark, tmp_path):
    for c in range(1, 23):
        put(tmp_path / f"ld.{c}.txt", f"CHR\tSNP\tBP\tL2_a\tL2_b\n{c}\trs{c}\t10\t1.5\t2\n{c}\tbad{c}\t11\tnan\t2\n")
    out = files.ld_scores(spark, str(tmp_path / "ld.@.txt"))
    assert out.count() == 22 and out.columns == ["chr", "snp", "bp", "L2_a", "L2_b"]
    files.write_ld_scores(out, str(tmp_path / "out"))
    assert files.table(spark, str(tmp_path / "out")).count() == 22
    with pytest.raises(Exception):
        files.write_ld_scores(out, str(tmp_path / "out"))


@pytest.mark.parametrize("columns", [["SNP", "BP", "L2"], ["CHR", "SNP", "BP", "L2", "CM"], ["CHR", "SNP", "BP", "BP", "L2"]])
def test_metadata_out_of_place(columns):
    with pytest.raises(ValueError):
        files.split_columns(columns)


def test_annotations(spark, tmp_path):
    axis = spark.createDataFrame([("a", 0), ("b", 1)], "snp string, pos int")
    ok = put(tmp_path / "ok.txt", "CHR\tBP\tSNP\tbin1\tbin2\n1\t1\tb\t0\t1\n1\t2\ta\t1\t0\n1\t3\tc\t1\t0\n")
    assert {r["snp"]: (r["bin1"], r["bin2"]) for r in files.annotations(spark, ok, axis).collect()} == {"a": (1, 0), "b": (0, 1)}
    for body in ("1\t1\tb\t0\t1\n", "1\t1\tb\t0\t1\n1\t2\ta\t1\t0\n1\t2\ta\t1\t0\n", "1\t1\tb\t0\t1\n1\t2\ta\tx\t0\n"):
        with pytest.raises(ValueError):
            files.annotations(spark, put(tmp_path / "bad.txt", "CHR\tBP\tSNP\tbin1\tbin2\n" + body), axis)


def test_plain_files(spark, tmp_path):
    got = files.bim(spark, put(tmp_path / "x.bim", "1 rs1 0.5 100 A C\n1\trs2\t0\t200\tG\tT\n")).orderBy("idx").collect()
    assert [(r["idx"], r["snp"], r["bp"], r["a2"]) for r in got] == [(0, "rs1", 100, "C"), (1, "rs2", 200, "T")]
    assert files.fam(spark, put(tmp_path / "x.fam", "f NA 0 0 1 -9\nf b 0 0 2 1\n")).count() == 2
    with pytest.raises(ValueError, match="twice"):
        files.fam(spark, put(tmp_path / "y.fam", "f a 0 0 1 -9\nf a 0 0 2 1\n"))
    pv = files.pvar(spark, put(tmp_path / "x.pvar", "##c\n#CHROM\tPOS\tID\tREF\tALT\nchr1\t5\trs1\tA\tC\n")).collect()
    assert [(r["chr"], r["bp"], r["a1"], r["a2"]) for r in pv] == [("1", 5, "C", "A")]
    with pytest.raises(ValueError, match="several"):
        files.pvar(spark, put(tmp_path / "y.pvar", "#CHROM\tPOS\tID\tREF\tALT\n1\t5\trs1\tA\tC,T\n"))
    assert [r["iid"] for r in files.psam(spark, put(tmp_path / "x.psam", "#IID SEX\na 1\nb 2\n")).collect()] == ["a", "b"]


def test_bed(spark, tmp_path):
    rng = np.random.default_rng(1)
    calls = rng.integers(-1, 3, (9, 6))
    code = {2: 0, -1: 1, 1: 2, 0: 3}
    body = bytearray([0x6C, 0x1B, 0x01])
    for row in calls:
        for k in range(0, 6, 4):
            body.append(sum(code[int(g)] << (2 * i) for i, g in enumerate(row[k : k + 4])))
    (tmp_path / "x.bed").write_bytes(bytes(body))
    got = files.bed(spark, str(tmp_path / "x.bed"), 6).orderBy("idx").collect()
    assert [r["calls"] for r in got] == calls.tolist()


def test_pairs(spark, tmp_path):
    at = put(tmp_path / "p.txt", "IID1\tIID2\tKINSHIP\na\tb\t0.3\nb\ta\t0.2\nc\tc\t0.5\nd\tc\t0.01\n")
    assert files.pairs(spark, at, 0.05).collect() == [("a", "b", 0.3)]
