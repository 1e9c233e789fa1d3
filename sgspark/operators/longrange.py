"""LD between units of variants: traces of products of all pairs of units' kernels, from one set of probes.

With standardised genotypes that covariates have been taken out of (u of norm 1, and the share v of variance that is left;
see blocks), nu = samples - rank and P the projection, unit g has the kernel K_g = nu sum_{j in g} v_j u_j u_j' / sum_j v_j,
and the matrices

    self:   A_g = K_g - (tr K_g / nu) P
    apart:  A_g = P (K_g - diag K_g) P - (lambda_g / nu) P,   lambda_g the trace of the first term,

with and without everyone's pair with themselves. tr(A_g A_h) is the mean of (A_g z)'(A_h z) over sign probes z. The
probes go through the variants once and back (u'z by tile, then sums by unit), all units together; blocks of samples and
groups of probes stand in the shared folder between passes, and sums of products are as large as units times units.
Groups of probes are replicates, from which the errors come.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sgspark.operators.blocks import COLUMNS, SAMPLES, Panel, _added, _tiles, probe_signs, tiled
from sgspark.sources.shared import folder, kept, load, save


def signs(first: int, count: int, probes: range) -> np.ndarray:
    """Signs of the samples from first on, the same on every machine."""
    return np.array([[1.0 if hashlib.md5(f"{k}:{p}".encode()).hexdigest()[0] < "8" else -1.0 for p in probes] for k in range(first, first + count)]).reshape(count, len(probes))


def _fixed(layout: Panel, sb: int, count: int) -> np.ndarray:
    """Orthonormal rows of a block of samples; the constant alone where there are no covariates."""
    if not layout.rank:
        return np.full((count, 1), 1 / np.sqrt(layout.samples))
    return np.frombuffer(load(f"{layout.path}/covariates-{sb}")).reshape(count, layout.rank)


def unit_traces(panel: DataFrame, unit: str, units: int, probes: int, per_group: int = 8, covariates: DataFrame | None = None, rank: int = 1, side: int = SAMPLES) -> DataFrame:
    """(g, h, self, self_se, apart, apart_se) for all ordered pairs of units: the mean over groups of ``per_group`` probes of
    the traces, and its error (null with a single group). panel: vid, e and ``unit``, from 0 to units - 1, by which variants
    go; covariates: (k, q) of so many columns (rank). Units without variants have traces of 0; no rows give no rows."""
    spark = panel.sparkSession
    tiles = tiled(panel, [unit], 0, covariates, rank, side)
    layout, n = tiles._replace(tiles=None), tiles.samples
    nu = n - rank
    if not n:
        return spark.createDataFrame([], "g int, h int, self double, self_se double, apart double, apart_se double")
    of = [range(k, min(k + per_group, probes)) for k in range(0, probes, per_group)]
    blocks = [(sb, min(side, n - sb * side)) for sb in range(-(-n // side))]
    path = f"{layout.path}/long"

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z: dict[int, np.ndarray] = {}
        for vc, sb, tile in _tiles(layout, batches):
            if sb not in z:
                z.clear()
                z[sb] = signs(sb * side, tile.u.shape[1], range(probes))
            body = np.column_stack([tile.u @ z[sb], tile.share / len(blocks)])
            yield pa.RecordBatch.from_arrays([pa.array([vc]), pa.array([len(body)], pa.int32()), pa.array([body.tobytes()], pa.binary())], ["vc", "rows", "body"])

    products = tiles.tiles.mapInArrow(down, "vc long, rows int, body binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def closed() -> pa.RecordBatch:
            save(f"{path}/z-{now}", total[:, :probes].tobytes())
            return pa.RecordBatch.from_arrays([pa.array([float(total[:, probes].sum())])], ["share"])

        for batch in batches:
            for vc, rows, body in zip(*(batch.column(c) for c in ("vc", "rows", "body")), strict=True):
                part = np.frombuffer(body.as_buffer()).reshape(rows.as_py(), -1)
                if vc.as_py() != now:
                    if now is not None:
                        yield closed()
                    now, total = vc.as_py(), part.copy()
                else:
                    total += part
        if now is not None:
            yield closed()

    if len(blocks) > 1:
        products = products.repartition("vc").sortWithinPartitions("vc")
    whole = products.mapInArrow(add, "share double").agg(F.sum("share")).first()[0] or 0.0
    scale = nu / whole if whole else 0.0

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def closed() -> pa.RecordBatch:
            y, own = total[:, :, :probes], total[:, :, probes]
            bodies = [np.concatenate([y[:, :, p.start : p.stop].reshape(len(total), -1), own], axis=1).tobytes() for p in of]
            size = len(bodies)
            return pa.RecordBatch.from_arrays([pa.array([now] * size, pa.int32()), pa.array(list(range(size)), pa.int32()), pa.array([len(total)] * size, pa.int32()), pa.array(bodies, pa.binary())], ["sb", "r", "rows", "body"])

        for vc, sb, tile in _tiles(layout, batches):
            if sb != now:
                if now is not None:
                    yield closed()
                now, total = sb, np.zeros((tile.u.shape[1], units, probes + 1))
            c = np.frombuffer(load(f"{path}/z-{vc}")).reshape(len(tile.vid), probes)
            which = tile.a[:, 0].astype(int)
            for g in np.unique(which):
                at = which == g
                weighed = scale * tile.share[at, None] * tile.u[at]
                total[:, g, :probes] += weighed.T @ c[at]
                total[:, g, probes] += (weighed * tile.u[at]).sum(axis=0)
        if now is not None:
            yield closed()

    sums = lambda across: _added(tiles.tiles.mapInArrow(up, "sb int, r int, rows int, body binary"), ["sb", "r"], path, across)
    return _traced(spark, layout, units, of, nu, path, sums)


def _traced(spark: SparkSession, layout: Panel, units: int, of: list[range], nu: int, path: str, added: Callable[[Callable], DataFrame]) -> DataFrame:
    """The traces, once each unit's sums by sample are made. added(across) leaves them at path-<block of samples>-<group of
    probes>, (samples, units x probes and then units) each, and gives a row (sb, r, value) of what ``across`` says of them."""
    side, n = layout.side, layout.samples
    blocks = [(sb, min(side, n - sb * side)) for sb in range(-(-n // side))]
    sizes = dict(blocks)

    def parts(sb: int, r: int, matrix: np.ndarray) -> tuple[np.ndarray, ...]:
        p = of[r]
        y = matrix[:, : units * len(p)].reshape(len(matrix), units, len(p))
        return y, matrix[:, units * len(p) :], signs(sb * side, sizes[sb], p), _fixed(layout, sb, sizes[sb])

    def across(key: tuple[int, int], matrix: np.ndarray) -> np.ndarray:
        """What projections and lambda need of all samples: C'z, C'(D z) and C'D C by unit, sums of D and of D times leverages."""
        _, own, z, c = parts(*key, matrix)
        return np.concatenate([(c.T @ z).ravel(), np.einsum("ic,ig,ip->cgp", c, own, z).ravel(), np.einsum("ic,ig,id->cgd", c, own, c).ravel(), own.sum(axis=0), own.T @ (c**2).sum(axis=1)])

    sums = added(across)
    small = sums.select("r", F.posexplode("value").alias("i", "x")).groupBy("r", "i").agg(F.sum("x").alias("x")).collect()  # numbers of covariates times units times probes
    shared = {r: np.array([x["x"] for x in sorted(small, key=lambda x: x["i"]) if x["r"] == r]) for r in range(len(of))}

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sb, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y, own, z, c = parts(sb, r, np.frombuffer(load(f"{path}-{sb}-{r}")).reshape(sizes[sb], -1))
                k, m = c.shape[1], z.shape[1]
                cz, cdz, cdc, traces, lam = np.split(shared[r], np.cumsum([k * m, k * units * m, k * k * units, units]))
                cz = cz.reshape(k, m)
                pz = z - c @ cz
                cdz = cdz.reshape(k, units, m) - cdc.reshape(k, units, k) @ cz
                one = y - (traces / nu)[None, :, None] * pz[:, None, :]
                other = y - own[:, :, None] * pz[:, None, :] + np.einsum("ic,cgp->igp", c, cdz) - (lam / nu)[None, :, None] * pz[:, None, :]
                cells = [np.einsum("igp,ihp->gh", a, a, optimize=True).ravel() / m for a in (one, other)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(units**2, r, np.int32)), pa.array(np.repeat(np.arange(units, dtype=np.int32), units)), pa.array(np.tile(np.arange(units, dtype=np.int32), units)), *map(pa.array, cells)], ["r", "g", "h", "self", "apart"])

    keys = spark.createDataFrame([(sb, r) for sb, _ in blocks for r in range(len(of))], "sb int, r int").repartition(len(blocks) * len(of))
    made = keys.mapInArrow(squares, "r int, g int, h int, self double, apart double").groupBy("r", "g", "h").agg(F.sum("self").alias("self"), F.sum("apart").alias("apart"))
    error = lambda c: (F.stddev_samp(c) / F.sqrt(F.count("*"))).alias(f"{c}_se")
    return made.groupBy("g", "h").agg(F.avg("self").alias("self"), error("self"), F.avg("apart").alias("apart"), error("apart"))


def carried_traces(calls: DataFrame, of_unit: DataFrame, units: int, samples: int, probes: int, per_group: int = 8, side: int = SAMPLES) -> DataFrame:
    """unit_traces() without covariates, from sparse dosages (vid, k, g) of ``samples`` samples numbered from 0, absent ones
    being 0; of_unit: vid and unit. With w = sum(x) / sqrt(n), a variant's u'z is s (x'z - w q'z), q the constant, and a
    sample's sums by unit are those over its carried variants and a constant a unit for all the others. Work and memory
    grow with the carriers."""
    spark = calls.sparkSession
    path = folder(spark, "carried")
    nu, root = samples - 1, float(np.sqrt(samples))
    calls = kept(calls.select("vid", F.col("k").cast("int").alias("k"), F.col("g").cast("double").alias("g")), f"{path}/calls")
    z = spark.range(samples).select(F.col("id").cast("int").alias("k"), probe_signs(F.col("id"), probes).alias("z"))
    total = F.broadcast(z.agg(*[(F.sum(F.col("z")[p]) / root).alias(f"q_{p}") for p in range(probes)]))  # one row
    met = calls.join(z, "k").repartition("vid").groupBy("vid").agg(F.sum("g").alias("_s"), F.sum(F.col("g") * F.col("g")).alias("_gg"), *[F.sum(F.col("g") * F.col("z")[p]).alias(f"z_{p}") for p in range(probes)])
    met = met.withColumns({"w": F.col("_s") / root, "_raw": F.col("_gg") - F.col("_s") * F.col("_s") / samples}).where("_raw > 1e-10 * _gg").join(of_unit, "vid").crossJoin(total)
    each = kept(met.select("vid", F.col("unit").cast("int").alias("unit"), "w", (1 / F.col("_raw")).alias("o"), F.array(*[(F.col(f"z_{p}") - F.col("w") * F.col(f"q_{p}")) / F.col("_raw") for p in range(probes)]).alias("c")), f"{path}/facts")
    m = each.count()
    scale = nu / m if m else 0.0
    layout = Panel(None, path, samples, 0, [], 0, side, COLUMNS)
    groups = [range(k, min(k + per_group, probes)) for k in range(0, probes, per_group)]

    # what absent dosages give all samples, by unit: -w c / sqrt(n) of each probe, and o w**2 / n
    got = each.groupBy("unit").agg(F.sum(F.col("o") * F.col("w") * F.col("w") / samples), *[F.sum(F.col("w") * F.col("c")[p] / -root) for p in range(probes)]).collect()  # numbers of units times probes
    flat = np.zeros((units, probes + 1))
    for r in got:
        flat[r[0], probes], flat[r[0], :probes] = r[1], r[2:]

    def added(across: Callable[[tuple[int, int], np.ndarray], np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, sums = None, None

            def closed() -> pa.RecordBatch:
                values = []
                for r, p in enumerate(groups):
                    body = np.concatenate([sums[:, :, p.start : p.stop].reshape(len(sums), -1), sums[:, :, probes]], axis=1) * scale
                    save(f"{path}-{now}-{r}", body.tobytes())
                    values.append(across((now, r), body).tolist())
                return pa.RecordBatch.from_arrays([pa.array([now] * len(groups), pa.int32()), pa.array(range(len(groups)), pa.int32()), pa.array(values, pa.list_(pa.float64()))], ["sb", "r", "value"])

            for batch in batches:
                sb, k, unit, g, own, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sb", "k", "unit", "g", "o", "w"))
                c = batch.column("c").flatten().to_numpy().reshape(len(sb), probes)
                for b in np.unique(sb):
                    if b != now:
                        if now is not None:
                            yield closed()
                        now, sums = int(b), np.repeat(flat[None], min(side, samples - int(b) * side), axis=0)
                    at = (sb == b) & (k >= 0)
                    x = np.column_stack([g[at, None] * c[at], own[at] * g[at] * (g[at] - 2 * w[at] / root)])
                    np.add.at(sums, (k[at] - now * side, unit[at]), x)
            if now is not None:
                yield closed()

        rows = calls.join(each, "vid").select(F.floor(F.col("k") / side).cast("int").alias("sb"), "k", "unit", "g", "o", "w", "c")
        # a row that carries nothing, so that every block of samples has its sums
        every = spark.range(-(-samples // side)).select(F.col("id").cast("int").alias("sb"), F.lit(-1).alias("k"), F.lit(0).alias("unit"), *[F.lit(0.0).alias(x) for x in ("g", "o", "w")], F.array_repeat(F.lit(0.0), probes).alias("c"))
        made = rows.unionByName(every).repartition("sb").sortWithinPartitions("sb").mapInArrow(run, "sb int, r int, value array<double>")
        return kept(made, f"{path}/across")

    return _traced(spark, layout, units, groups, nu, path, added)


def shares(traces: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row: rho_self and rho_apart, the shares of the summed traces that lie between groups of units (g, grp; each unit
    by itself unless given), and what corrections take: rho_diag = max(rho_self - rho_apart, 0) and
    rho_off = max(rho_self - rho_diag, 0)."""
    if groups is None:
        rows = traces.withColumn("_in", F.col("g") == F.col("h"))
    else:
        one, other = (groups.select(F.col("g").alias(c), F.col("grp").alias(f"_{c}")) for c in ("g", "h"))
        rows = traces.join(one, "g").join(other, "h").withColumn("_in", F.col("_g") == F.col("_h"))
    share = lambda c: (1 - F.sum(F.when(F.col("_in"), F.col(c)).otherwise(0.0)) / F.sum(c)).alias(f"rho_{c}")
    out = rows.agg(share("self"), share("apart")).withColumn("rho_diag", F.greatest(F.col("rho_self") - F.col("rho_apart"), F.lit(0.0)))
    return out.withColumn("rho_off", F.greatest(F.col("rho_self") - F.col("rho_diag"), F.lit(0.0)))
