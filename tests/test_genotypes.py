"""The genotype source against what was written, and against records put together by hand."""

import struct

import numpy as np
import pytest

from sgspark.sources import genotypes


def variants():
    """Dosages of the first allele of every kind of record."""
    rng = np.random.default_rng(8)
    n = 301
    rows = []
    for j in range(160):
        p = [0.002, 0.05, 0.5, 0.97, 0.999][j % 5]
        x = 2.0 - rng.binomial(2, p, n)
        if j % 7 == 3 and j:
            x = np.array(rows[-1], float)  # all but equal to the last
            x[rng.integers(0, n, 2)] = 1
        if j % 7 == 5:
            x = 2 - np.nan_to_num(np.array(rows[-1], float))
        if j % 11 == 4:
            x = np.where(rng.random(n) < 0.5, 1.0, 2.0)
        x = x.astype(object)
        x[rng.random(n) < (0.98 if j % 40 == 17 else 0.01)] = np.nan
        if j % 13 == 2:
            x[3] = round(0.37 * 16384) / 16384
        if j % 13 == 6:
            some = rng.random(n) < 0.3
            x[some] = np.round(rng.random(some.sum()) * 2 * 16384) / 16384
        if j % 13 == 9:
            x = np.round(rng.random(n) * 2 * 16384) / 16384
        rows.append([None if v != v else float(v) for v in x])
    return rows


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rows = variants()
    path = str(tmp_path_factory.mktemp("geno") / "a.pgen")
    genotypes.write_pgen(spark.createDataFrame(list(enumerate(rows)), "idx long, dosages array<double>").repartition(3), path)
    return path, rows


def test_kinds_of_records(written):
    kinds, base = set(), None
    for x in written[1]:
        kind, _, geno = genotypes.encoded(2 - np.array([np.nan if v is None else v for v in x]), base)
        base = base if kind & 7 in (2, 3) else geno
        kinds.add(kind)
    assert {k & 7 for k in kinds} == {0, 1, 2, 3, 4, 6, 7} and {k & 0x60 for k in kinds} == {0, 0x20, 0x40, 0x60}


def test_round_trip(spark, written):
    path, rows = written
    df = genotypes.read(spark, path, block=16)
    assert df.rdd.getNumPartitions() == 10
    assert [r["dosages"] for r in df.orderBy("idx").collect()] == rows


def test_ranges_and_samples(spark, written):
    path, rows = written
    df = genotypes.read(spark, path, samples=[0, 7, 300], block=16).where("idx >= 37 and idx < 61")
    assert df.rdd.getNumPartitions() == 2
    assert {r["idx"]: r["dosages"] for r in df.collect()} == {k: [rows[k][i] for i in (0, 7, 300)] for k in range(37, 61)}
    assert [r["dosages"] for r in genotypes.read(spark, path).where("idx = 159 and size(dosages) > 0").collect()] == [rows[159]]
    assert genotypes.read(spark, path).where("idx > 159").count() == 0


def test_a_range_opens_only_its_blocks(written, tmp_path):
    path, rows = written
    data = bytearray(open(path, "rb").read())
    data[-40:] = b"\xff" * 40
    torn = str(tmp_path / "torn.pgen")
    open(torn, "wb").write(bytes(data))
    spec = genotypes.layout(torn, 301)
    for k, x in enumerate(genotypes.read_range(torn, spec, 90, 110), 90):
        assert [None if v != v else v for v in x] == rows[k]


def test_records_by_hand(tmp_path):
    """Two samples' bits per byte pair as the descriptions have them: five samples, an index of 4-bit kinds."""
    two = lambda *g: bytes([sum(x << 2 * i for i, x in enumerate(g[:4])), g[4]])
    records = [
        (0, two(0, 1, 2, 3, 1)),
        (1, bytes([0 * 4 + 2, 0b10010]) + bytes([1, 0, 3])),  # 0 or 2; sample 0 is missing
        (2, bytes([1, 4, 2])),  # the last own variant but for sample 4
        (3, bytes([0])),  # and turned
        (4, bytes([2, 1, 0b0110, 2])),  # all 0 but for samples 1 and 3
        (7, bytes([1, 2, 0])),  # all missing but for sample 2
        (6, bytes([0])),
    ]
    body = b"".join(b for _, b in records)
    kinds = bytes(sum(k << 4 * i for i, (k, _) in enumerate(records[j : j + 2])) for j in range(0, len(records), 2))
    head = b"\x6c\x1b\x10" + struct.pack("<IIB", len(records), 5, 0 | 1 << 6)
    place = 12 + 8 + len(kinds) + len(records)
    path = str(tmp_path / "hand.pgen")
    open(path, "wb").write(head + struct.pack("<Q", place) + kinds + bytes(len(b) for _, b in records) + body)
    got = np.stack(list(genotypes.read_range(path, genotypes.layout(path, 5), 0, 7)))
    nan = np.nan
    want = [[0, 1, 2, nan, 1], [nan, 2, 0, 0, 2], [nan, 2, 0, 0, 2], [nan, 0, 2, 2, 0], [0, 2, 0, 1, 0], [nan, nan, 0, nan, nan], [2] * 5]
    assert np.array_equal(got, 2 - np.array(want), equal_nan=True)
    assert np.array_equal(np.stack(list(genotypes.read_range(path, genotypes.layout(path, 5), 3, 4))), 2 - np.array(want[3:4]), equal_nan=True)
    # phases are skipped: three heterozygous calls, two of them phased, then a list of one dosage
    phased = two(1, 1, 0, 1, 2) + bytes([0b1011, 0b01]) + bytes([1, 2]) + struct.pack("<H", 4096)
    record = genotypes.Record(phased, 5)
    assert record.dosages(0x30, record.genotypes(0x30, None)).tolist() == [1, 1, 0.25, 1, 2]
    unphased = two(1, 1, 0, 1, 2) + bytes([0b0110]) + struct.pack("<5H", 0, 1, 2, 65535, 16384)
    record = genotypes.Record(unphased, 5)
    assert np.array_equal(record.dosages(0x50, record.genotypes(0x50, None)), [0, 1 / 16384, 2 / 16384, nan, 1], equal_nan=True)


def test_fixed_widths(spark, tmp_path):
    path = str(tmp_path / "two.pgen")
    open(path, "wb").write(b"\x6c\x1b\x02" + struct.pack("<IIB", 2, 5, 64) + bytes([0b11100100, 1, 0, 2]))
    assert [r["dosages"] for r in genotypes.read(spark, path).orderBy("idx").collect()] == [[2, 1, 0, None, 1], [2, 2, 2, 2, 0]]
    path = str(tmp_path / "three.pgen")
    open(path, "wb").write(b"\x6c\x1b\x03" + struct.pack("<IIB", 1, 3, 64) + bytes([0b110100]) + struct.pack("<3H", 0, 20480, 65535))
    assert [r["dosages"] for r in genotypes.read(spark, path).collect()] == [[2, 0.75, None]]


def test_foreign_and_broken_files(spark, written, tmp_path):
    for name, data, message in (("a.pgen", b"text of some kind", "isn't a genotype file"), ("b.pgen", b"\x6c\x1b\x11" + bytes(20), "storage mode"), ("c.pgen", open(written[0], "rb").read()[:40], "truncated"), ("d.bed", b"\x6c\x1b\x01" + bytes(5), "variant-major")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match=message):
            genotypes.read(spark, str(tmp_path / name), n=9 if name == "d.bed" else 0).count()
    with pytest.raises(Exception, match="holds 301 samples"):
        genotypes.read(spark, written[0], n=300).count()
    with pytest.raises(Exception, match="increasing order"):
        genotypes.read(spark, written[0], samples=[3, 1]).count()
    with pytest.raises(ValueError, match="two alleles"):
        genotypes.Record(bytes(9), 5).genotypes(8, None)
    empty = str(tmp_path / "empty.pgen")
    genotypes.write_pgen(spark.createDataFrame([], "idx long, dosages array<double>"), empty)
    assert genotypes.read(spark, empty).count() == 0
