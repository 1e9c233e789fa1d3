"""Genotype panels as block matrices: LD scores of all pairs, exact or by probes, with covariates and overlapping bins.

A panel is a row a variant: vid, e (an array with a number or null for each sample, in one order) and annotations. It is
cut once into tiles of some VARIANTS by SAMPLES values, which stand in the shared folder by block of samples, each with its
variants' means, scales and products with the covariates, so that a tile alone gives its part of the standardised rows
u = (x - C C'x) / |x - C C'x|: missing values are means, C holds orthonormal covariates with the constant, and u = 0 where
nothing is left. u_i'u_j is the (partial) correlation of two variants.

* Probes: with signs z, S = sum_j sqrt(a_j) u_j z_j' is added up by (block of samples, group of columns), first in the task
  that reads the tiles, then over tasks by a sort; u_i'S squared has the mean sum_j a_j r_ij**2. One pass each way.
* Exact: sum_j u_j u_j' is added up by pairs of blocks of samples, and u_i'(...)u_i is its quadratic form.

Sums stand in the shared folder and are loaded by the tasks of the second pass, one at a time. No task holds more than
COLUMNS columns of a block of samples for each group, nothing passes through the driver but sizes, and every pass starts
from written tables. Rows of other lengths than the first raise; variants without two values, or constant ones, have
scores of 0 against everything; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sgspark.sources.shared import folder, kept, load, save

#: Samples and variants of a tile, columns of a group of sums, and cells of a task's products (8 bytes each).
SAMPLES, VARIANTS, COLUMNS, CELLS = 2048, 1024, 1024, 1 << 24
#: Values that a task cuts at once.
CUT = 1 << 23


class Panel(NamedTuple):
    """Tiles (vc, sb, vid, values, facts) in a table by block of samples; facts: mean, 1 / norm, share of variance that the
    covariates leave, products with them, weights and signs of the tile's variants."""

    tiles: DataFrame | None
    path: str
    samples: int
    rank: int
    names: list[str]
    probes: int
    side: int
    columns: int

    @property
    def width(self) -> int:
        return 3 + self.rank + len(self.names) + self.probes


def _values(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1 if len(flat) else 0)


def _smallest(x: np.ndarray) -> bytes:
    """Values in the narrowest type that holds them exactly, its code first."""
    for kind in ("i1", "i2", "i4"):
        info = np.iinfo(kind)
        whole = np.where(np.isnan(x), info.min, x)
        if (np.abs(whole) <= -float(info.min)).all() and (whole == np.floor(whole)).all() and (np.isnan(x) | (x > info.min)).all():
            return kind.encode() + whole.astype(kind).tobytes()
    return b"f8" + x.tobytes()


def _widened(data: bytes, rows: int) -> np.ndarray:
    kind = data[:2].decode()
    x = np.frombuffer(data, f"<{kind}", offset=2).reshape(rows, -1)
    return x if kind == "f8" else np.where(x == np.iinfo(kind).min, np.nan, x.astype(np.float64))


def densified(calls: DataFrame, samples: int) -> DataFrame:
    """Rows (vid, e) of sparse dosages (vid, k, g): g of sample k, from 0 to samples - 1, and 0 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(0, batch.num_rows, step):
                part = batch.slice(n, step)
                e = np.zeros((part.num_rows, samples))
                row = np.repeat(np.arange(part.num_rows), np.diff(part.column(1).offsets.to_numpy()))
                k = part.column(1).flatten().to_numpy()
                if len(k) and (k.min() < 0 or k.max() >= samples):
                    raise ValueError(f"samples are numbered from 0 to {samples - 1}")
                e[row, k] = part.column(2).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(e) + 1) * samples, pa.int32()), pa.array(e.ravel()))], ["vid", "e"])

    step = max(1, CUT // max(samples, 1))
    held = calls.groupBy("vid").agg(F.collect_list("k").alias("k"), F.collect_list(F.col("g").cast("double")).alias("g"))
    return held.mapInArrow(run, "vid long, e array<double>")


def probe_signs(variant: Column, probes: int) -> Column:
    """An array of signs that depend on the variant's and the probe's number only, the same on every machine."""
    one = lambda p: F.when(F.substring(F.md5(F.concat(variant.cast("string"), F.lit(":"), p.cast("string")).cast("binary")), 1, 1) < "8", 1).otherwise(-1)
    return F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda p: one(p).cast("tinyint"))


def tiled(panel: DataFrame, weights: list[str], probes: int = 0, covariates: DataFrame | None = None, rank: int = 0, side: int = SAMPLES, columns: int = COLUMNS) -> Panel:
    """Cuts a panel into tiles. covariates: (k, q), orthonormal rows by sample number (see basis.orthonormal), of so many
    columns (rank); without any, the constant alone is taken out. side: samples of a tile; columns: of a group of sums."""
    spark = panel.sparkSession
    path = folder(spark, "panel")
    samples = panel.select(F.size("e").alias("n")).limit(1).first()
    samples = samples["n"] if samples else 0
    rank = rank if covariates is not None else 0
    if rank:
        block = covariates.select((F.floor(F.col("k") / side)).cast("int").alias("sb"), "k", "q")

        def keep(table: pa.Table) -> pa.Table:
            table = table.combine_chunks().sort_by("k")
            save(f"{path}/covariates-{table['sb'][0].as_py()}", _values(table["q"].combine_chunks()).tobytes())
            return table.select(["sb"]).slice(0, 1)

        held = sorted((r["sb"], r["n"]) for r in block.groupBy("sb").count().withColumnRenamed("count", "n").collect())  # two numbers a block of samples
        if held != [(sb, min(side, samples - sb * side)) for sb in range(-(-samples // side))]:
            raise ValueError(f"covariates aren't those of samples 0 to {samples - 1}")
        block.groupBy("sb").applyInArrow(keep, "sb int").count()
    signs = probe_signs(F.col("vid"), probes) if probes else F.array().cast("array<tinyint>")
    rows = panel.select("vid", F.col("e").cast("array<double>").alias("e"), F.array(*[F.col(w).cast("double") for w in weights]).alias("a"), signs.alias("z"))
    step = max(1, min(VARIANTS, CUT // max(samples, 1)))

    def of_covariates(sb: int) -> np.ndarray:
        return np.frombuffer(load(f"{path}/covariates-{sb}")).reshape(-1, rank)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                e = _values(part.column(1))
                if e.shape[1] != samples or part.column(1).null_count:
                    raise ValueError(f"a variant of {e.shape[1]} samples in a panel of {samples}")
                held = ~np.isnan(e)
                count = held.sum(axis=1)
                mean = np.where(held, e, 0).sum(axis=1) / np.maximum(count, 1)
                x = np.where(held, e - mean[:, None], 0)
                blocks = range(-(-samples // side))
                w = sum((x[:, sb * side : (sb + 1) * side] @ of_covariates(sb) for sb in blocks), np.zeros((len(x), rank))) if rank else np.zeros((len(x), 0))
                raw = np.einsum("ij,ij->i", x, x)
                left = raw - np.einsum("ij,ij->i", w, w)
                some = (count > 1) & (left > 1e-10 * raw) & (raw > 0)
                scale = np.where(some, 1 / np.sqrt(np.where(some, left, 1)), 0)
                share = np.where(some, np.minimum(1, left / np.where(raw > 0, raw, 1)), 0)
                a, z = _values(part.column(2)), _values(part.column(3))
                if (a < 0).any():
                    raise ValueError("weights of variants can't be negative")
                facts = np.column_stack([mean, scale, share, w, a.reshape(len(x), -1), z.reshape(len(x), -1)])
                tiles = [_smallest(e[:, sb * side : (sb + 1) * side]) for sb in blocks]
                size = len(tiles)
                vids = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * size, pa.int64()), pa.array(list(blocks), pa.int32()), pa.array([vids] * size, pa.list_(pa.int64())), pa.array(tiles, pa.binary()), pa.array([facts.tobytes()] * size, pa.binary())],
                    ["vc", "sb", "vid", "values", "facts"],
                )
                number += 1

    made = rows.mapInArrow(cut, "vc long, sb int, vid array<long>, values binary, facts binary")
    if samples > side:  # tiles of a block of samples side by side, in as many files as are needed
        made = made.repartitionByRange("sb", "vc").sortWithinPartitions("sb", "vc")
    return Panel(kept(made, f"{path}/tiles"), path, samples, rank, weights, probes, side, columns)


class Tile:
    """A tile's standardised rows u and what its facts say."""

    def __init__(self, panel: Panel, covariates: dict[int, np.ndarray], sb: int, vid: list[int], values: bytes, facts: bytes):
        self.vid = np.array(vid, dtype=np.int64)
        f = np.frombuffer(facts).reshape(len(self.vid), panel.width)
        e = _widened(values, len(self.vid))
        x = np.where(np.isnan(e), 0, e - f[:, :1])
        if panel.rank:
            if sb not in covariates:
                covariates.clear()
                covariates[sb] = np.frombuffer(load(f"{panel.path}/covariates-{sb}")).reshape(-1, panel.rank)
            x = x - f[:, 3 : 3 + panel.rank] @ covariates[sb].T
        self.u, self.share = x * f[:, 1:2], f[:, 2]
        at = 3 + panel.rank
        self.a, self.z = f[:, at : at + len(panel.names)], f[:, at + len(panel.names) :]


def _tiles(panel: Panel, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Tile]]:
    covariates: dict[int, np.ndarray] = {}
    for batch in batches:
        for vc, sb, vid, values, facts in zip(*(batch.column(c) for c in ("vc", "sb", "vid", "values", "facts")), strict=True):
            yield vc.as_py(), sb.as_py(), Tile(panel, covariates, sb.as_py(), vid.as_py(), values.as_py(), facts.as_py())


def _added(parts: DataFrame, key: list[str], path: str, after=None) -> DataFrame:
    """Adds up the matrices (rows, body) of each key, one at a time, and leaves the sum at path-key; rows of
    ``after(key, matrix)``, arrays of numbers, or of the keys."""
    schema = ", ".join(f"{c} int" for c in key) + ", value array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def closed() -> pa.RecordBatch:
            save(f"{path}-{'-'.join(map(str, now))}", total.tobytes())
            value = after(now, total) if after else np.zeros(0)
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in now), pa.array([value.tolist()], pa.list_(pa.float64()))], [*key, "value"])

        for batch in batches:
            for n in range(batch.num_rows):
                of = tuple(batch.column(c)[n].as_py() for c in key)
                body = np.frombuffer(batch.column("body")[n].as_buffer()).reshape(batch.column("rows")[n].as_py(), -1)
                if of != now:
                    if now is not None:
                        yield closed()
                    now, total = of, body.copy()
                else:
                    total += body
        if now is not None:
            yield closed()

    return parts.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def _weighted(tile: Tile, by_share: float | None) -> np.ndarray:
    return tile.a if by_share is None else tile.a * (tile.share * by_share)[:, None]


def probed(panel: Panel, by_share: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(vid, share, y, a) and (a, b, value): y holds, weight by weight, (u' S)**2 of each probe; value is the mean over samples
    of the products of the weighted sums of N u**2, for pairs of weights. by_share: weights are multiplied by each
    variant's share of variance times this."""
    k, v = len(panel.names), panel.probes
    columns, step = k * v + k, panel.columns
    groups = range(-(-columns // step))
    path = f"{panel.path}/sums"
    layout = panel._replace(tiles=None)  # what tasks need

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def closed() -> pa.RecordBatch:
            bodies = [np.ascontiguousarray(total[:, g * step : (g + 1) * step]).tobytes() for g in groups]
            size = len(bodies)
            return pa.RecordBatch.from_arrays([pa.array([now] * size, pa.int32()), pa.array(list(groups), pa.int32()), pa.array([len(total)] * size, pa.int32()), pa.array(bodies, pa.binary())], ["sb", "g", "rows", "body"])

        for _, sb, tile in _tiles(layout, batches):
            if sb != now:
                if now is not None:
                    yield closed()
                now, total = sb, np.zeros((tile.u.shape[1], columns))
            a = _weighted(tile, by_share)
            for i in range(k):
                total[:, i * v : (i + 1) * v] += tile.u.T @ (np.sqrt(a[:, i : i + 1]) * tile.z)
            total[:, k * v :] += (tile.u**2).T @ a
        if now is not None:
            yield closed()

    sums = _added(panel.tiles.mapInArrow(up, "sb int, g int, rows int, body binary"), ["sb", "g"], path)
    blocks = sorted({r["sb"] for r in sums.select("sb").collect()})  # a number a block of samples

    def load_block(sb: int) -> np.ndarray:
        parts = [np.frombuffer(load(f"{path}-{sb}-{g}")) for g in groups]
        width = [min(step, columns - g * step) for g in groups]
        return np.concatenate([p.reshape(-1, w) for p, w in zip(parts, width, strict=True)], axis=1)

    spark = panel.tiles.sparkSession
    n = panel.samples

    def kurtosis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sb in batch.column(0).to_pylist():
                q = load_block(sb)[:, k * v :] * n
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k), pa.int32()), pa.array(np.tile(np.arange(k), k), pa.int32()), pa.array((q.T @ q / n).ravel())], ["a", "b", "value"])

    squares = spark.createDataFrame([(b,) for b in blocks], "sb int").mapInArrow(kurtosis, "a int, b int, value double").groupBy("a", "b").agg(F.sum("value").alias("value"))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums_of: dict[int, np.ndarray] = {}
        out: dict[int, list] = {}
        for vc, sb, tile in _tiles(layout, batches):
            if sb not in sums_of:
                sums_of.clear()
                sums_of[sb] = load_block(sb)[:, : k * v]
            y = tile.u @ sums_of[sb]
            if vc in out:
                out[vc][2] += y
            else:
                out[vc] = [tile.vid, tile.share, y, tile.a]
        for vid, share, y, a in out.values():
            yield pa.RecordBatch.from_arrays([pa.array(vid), pa.array(share), pa.array(list(y**2), pa.list_(pa.float64())), pa.array(list(a), pa.list_(pa.float64()))], ["vid", "share", "y", "a"])

    tiles = panel.tiles
    if panel.samples > panel.side:  # all blocks of some variants in one task, block by block
        chunks = tiles.agg(F.count_distinct("vc")).first()[0]
        some = max(1, -(-chunks * VARIANTS * max(1, k * v) // CELLS))
        tiles = tiles.repartition(max(some, int(spark.conf.get("spark.sql.shuffle.partitions"))), "vc").sortWithinPartitions("sb", "vc")
    return tiles.mapInArrow(back, "vid long, share double, y array<double>, a array<double>"), squares


class Scores(NamedTuple):
    """scores: vid, share, and l2_<name>, raw_<name> and var_<name> for each annotation; corrections: a row a pair of
    annotations (a, b) with the numbers m_a, m_b, r2, mu22, rho2, bias and delta."""

    scores: DataFrame
    corrections: DataFrame


def genomewide(panel: DataFrame, annotations: list[str], probes: int, covariates: DataFrame | None = None, rank: int = 1, weighted: bool = False, side: int = SAMPLES, columns: int = COLUMNS) -> Scores:
    """LD scores of all pairs by ``probes`` sign probes: the mean of a probe's squares less M / d, M being the sum of the
    annotation and d = samples - rank of the covariates with the constant; var is the probes' own variance of the mean.
    weighted: partners count by their adjusted share of variance, share * (samples - 1) / d.

    corrections, with b's mean square summed over the variants of a as s: r2 = s / (m_a m_b), mu22 the mean over samples of
    both annotations' mean squares, rho2 = ((d + 1)**2 r2 - n mu22) / (n (n - 1)), bias = s - m_a m_b rho2 and
    delta = mu22 - 1 - 2 rho2."""
    tiles = tiled(panel, annotations, probes, covariates, rank, side, columns)
    y, squares = probed(tiles, (tiles.samples - 1) / (tiles.samples - rank) if weighted else None)
    return scored(y, squares, tiles.path, tiles.samples, rank, annotations, probes, weighted)


def scored(y: DataFrame, squares: DataFrame, path: str, n: int, rank: int, annotations: list[str], probes: int, weighted: bool) -> Scores:
    """Scores and corrections from what probed() returns, over n samples; the rows are written once, below path."""
    d, k = n - rank, len(annotations)
    rows = y.withColumns({"v": F.col("share") * ((n - 1) / d)} | {f"a_{i}": F.col("a")[i] for i in range(k)})
    for i in range(k):
        part = F.slice("y", i * probes + 1, probes)
        total = F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
        square = F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x)
        rows = rows.withColumns({f"raw_{i}": total / probes, f"var_{i}": (square - total * total / probes) / (probes * (probes - 1)) if probes > 1 else F.lit(None).cast("double")})
        if weighted:
            rows = rows.withColumn(f"w_{i}", F.col(f"a_{i}") * F.col("v"))
    rows = kept(rows.drop("y", "a"), f"{path}/scores")
    mass = [F.sum(f"w_{i}" if weighted else f"a_{i}").alias(f"m_{i}") for i in range(k)]
    sizes = F.broadcast(rows.agg(*mass))  # one row
    out = rows.crossJoin(sizes).select("vid", "v", *[x for i, a in enumerate(annotations) for x in ((F.col(f"raw_{i}") - F.col(f"m_{i}") / d).alias(f"l2_{a}"), F.col(f"raw_{i}").alias(f"raw_{a}"), F.col(f"var_{i}").alias(f"var_{a}"))])
    pairs = [(i, j) for i in range(k) for j in range(k)]
    sums = rows.agg(*mass, *[F.sum((F.col(f"a_{i}") != 0).cast("double")).alias(f"n_{i}") for i in range(k)], *[F.sum(F.when(F.col(f"a_{i}") != 0, F.col(f"raw_{j}"))).alias(f"s_{i}_{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col(f"n_{i}").alias("m_a"), F.col(f"n_{j}").alias("m_b"), (F.col(f"m_{i}") * F.col(f"m_{j}")).alias("_w"), F.col(f"s_{i}_{j}").alias("s")) for i, j in pairs])
    table = sums.select(F.explode(cells).alias("_c")).select("_c.*").join(squares, ["a", "b"])
    table = table.withColumns({"r2": F.col("s") / (F.col("m_a") * F.col("m_b")), "mu22": F.col("value") / F.col("_w")})
    table = table.withColumn("rho2", ((d + 1.0) ** 2 * F.col("r2") - n * F.col("mu22")) / (n * (n - 1.0)))
    table = table.withColumns({"bias": F.col("s") - F.col("m_a") * F.col("m_b") * F.col("rho2"), "delta": F.col("mu22") - 1 - 2 * F.col("rho2")})
    names = F.array(*map(F.lit, annotations))
    return Scores(out, table.select(names[F.col("a")].alias("a"), names[F.col("b")].alias("b"), "m_a", "m_b", "r2", "mu22", "rho2", "bias", "delta"))


def probe_values(panel: DataFrame, probes: int, weight: str, side: int = SAMPLES, columns: int = COLUMNS) -> DataFrame:
    """(vid, probe, y): each probe's square for one weight."""
    tiles = tiled(panel, [weight], probes, side=side, columns=columns)
    return probed(tiles)[0].select("vid", F.posexplode("y").alias("probe", "y"))


def exact(panel: DataFrame, weight: str | None = None, side: int = SAMPLES) -> DataFrame:
    """(vid, raw): sum_j a_j r_ij**2 over all variants, i included, without a pair of variants ever being a row."""
    rows = panel if weight else panel.withColumn("_one", F.lit(1.0))
    tiles = tiled(rows, [weight or "_one"], side=side)
    path, layout = f"{tiles.path}/products", tiles._replace(tiles=None)
    left = tiles.tiles.select("vc", "vid", *[F.col(c).alias(f"{c}_1") for c in ("sb", "values", "facts")])
    right = tiles.tiles.select("vc", *[F.col(c).alias(f"{c}_2") for c in ("sb", "values", "facts")])
    both = left.join(right, "vc").where("sb_1 <= sb_2") if tiles.samples > tiles.side else left.select("*", F.col("sb_1").alias("sb_2"), F.lit(None).cast("binary").alias("values_2"), F.lit(None).cast("binary").alias("facts_2"))
    pairs = both.repartition("sb_1", "sb_2", "vc").sortWithinPartitions("sb_1", "sb_2", "vc") if tiles.samples > tiles.side else both

    def two(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Tile, Tile]]:
        first: dict[int, np.ndarray] = {}
        second: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                a = Tile(layout, first, r["sb_1"], r["vid"], r["values_1"], r["facts_1"])
                b = a if r["values_2"] is None else Tile(layout, second, r["sb_2"], r["vid"], r["values_2"], r["facts_2"])
                yield r["sb_1"], r["sb_2"], a, b

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([len(total)], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["sb", "sc", "rows", "body"])

        for i, j, a, b in two(batches):
            if (i, j) != now:
                if now is not None:
                    yield closed()
                now, total = (i, j), np.zeros((a.u.shape[1], b.u.shape[1]))
            total += (a.u * a.a).T @ b.u
        if now is not None:
            yield closed()

    _added(pairs.mapInArrow(up, "sb int, sc int, rows int, body binary"), ["sb", "sc"], path).count()

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for i, j, a, b in two(batches):
            if (i, j) not in held:
                held.clear()
                held[i, j] = np.frombuffer(load(f"{path}-{i}-{j}")).reshape(a.u.shape[1], -1)
            yield pa.RecordBatch.from_arrays([pa.array(a.vid), pa.array((1 if i == j else 2) * np.einsum("ij,ij->i", a.u @ held[i, j], b.u))], ["vid", "raw"])

    out = pairs.mapInArrow(forms, "vid long, raw double")
    return out.groupBy("vid").agg(F.sum("raw").alias("raw")) if tiles.samples > tiles.side else out
