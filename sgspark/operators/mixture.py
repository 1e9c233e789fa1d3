"""Effects of all variants on many traits under mixtures of two normals, by variational coordinate ascent.

A trait with mean 0 and variance 1 is y = sum_j x_j b_j + e, x_j the standardised genotypes (see blocks), e of variance
1 - h2, and each effect is drawn from p N(0, (1 - f) / p w) + (1 - p) N(0, f / (1 - p) w), w = h2 over the number of
variants that vary: p of them carry 1 - f of the variance. Under a posterior that factors over variants, variant j's update
has for each component, with g = x_j'x_j and t = x_j'(residual + x_j b_j),

    s = 1 / (g / (1 - h2) + 1 / v),  m = s t / (1 - h2),  weight proportional to prior * sqrt(s / v) exp(m**2 / 2 s),

and the new effect is the weighted mean of m. Updates in sequence never lower the bound of the evidence.

A sweep is one barrier job with a task for each block of samples, which holds the residuals of its samples for all traits
and candidates. Tasks read their tiles chunk of variants by chunk, give each other their parts of x'residual, and update
the chunk's effects, all in the same way, from its Gram matrix, before they take the change out of their residuals. As such
an exchange takes a second whatever its size, chunks of carried variants are large, and their Gram matrix is a row of constants
and the products of variants that some sample carries both of. The
sweep's effects and residuals are written to the prepared folder, so a fit that is cut off goes on after its last whole
sweep, with the same numbers. There have to be at least as many slots as blocks of samples: choose ``side`` so.
"""

from __future__ import annotations

import base64
import itertools
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sgspark.operators import blocks
from sgspark.operators.blocks import SAMPLES, Panel, _tiles, tiled
from sgspark.sources.shared import folder, kept, load, save


#: Products of a chunk's carried variants, carriers that a task cuts into chunks, and sums that the tasks exchange at once.
PAIRS, HELD, SUMS = 1 << 22, 1 << 21, 1 << 21


class Candidate(NamedTuple):
    """p: share of the variants in the wide component; f: share of the variance in the narrow one; h2."""

    name: str
    p: float
    f: float
    h2: float


def _text(x: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(x).tobytes()).decode()


def _sum(parts: list[str], shape: tuple[int, ...]) -> np.ndarray:
    total = np.zeros(shape)
    for part in parts:  # in the tasks' order
        total += np.frombuffer(base64.b64decode(part)).reshape(shape)
    return total


def prepared(panel: DataFrame, traits: DataFrame, names: list[str], side: int = SAMPLES) -> str:
    """Tiles, Gram matrices and standardised traits in a folder, whose path is the result. panel: vid and e; traits: k (the
    sample's number, all of them) and the named columns without nulls. A trait that doesn't vary raises."""
    layout = tiled(panel.withColumn("_one", F.lit(1.0)), ["_one"], side=side)
    path, n = layout.path, layout.samples
    _residuals(traits, names, path, n, side)
    slim = layout._replace(tiles=None)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vc, _, tile in _tiles(slim, batches):
            yield pa.RecordBatch.from_arrays([pa.array([vc]), pa.array([len(tile.vid)], pa.int32()), pa.array([tile.vid.tobytes()], pa.binary()), pa.array([(tile.u @ tile.u.T * (n - 1)).tobytes()], pa.binary())], ["vc", "rows", "vid", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, vid = None, None, b""

        def closed() -> pa.RecordBatch:
            save(f"{path}/gram-{now}", total.tobytes())
            save(f"{path}/vid-{now}", vid)
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([int((np.diag(total) > 0).sum())])], ["vc", "m"])

        for batch in batches:
            for r in batch.to_pylist():
                part = np.frombuffer(r["body"]).reshape(r["rows"], -1)
                if r["vc"] != now:
                    if now is not None:
                        yield closed()
                    now, total, vid = r["vc"], part.copy(), r["vid"]
                else:
                    total += part
        if now is not None:
            yield closed()

    grams = layout.tiles.mapInArrow(squares, "vc long, rows int, vid binary, body binary").repartition("vc").sortWithinPartitions("vc")
    chunks = sorted((r["vc"], r["m"]) for r in grams.mapInArrow(add, "vc long, m long").collect())  # two numbers a chunk
    meta = {"samples": n, "side": side, "columns": layout.columns, "traits": names, "chunks": [c for c, _ in chunks], "variants": sum(m for _, m in chunks)}
    save(f"{path}/meta", json.dumps(meta).encode())
    return path


def _residuals(traits: DataFrame, names: list[str], path: str, n: int, side: int) -> None:
    """The standardised traits by block of samples."""
    stats = traits.agg(F.count("*").alias("n"), *[x for i, c in enumerate(names) for x in (F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"), F.count(c).alias(f"c{i}"))]).first()
    if stats["n"] != n or any(stats[f"c{i}"] != n or not stats[f"s{i}"] > 0 for i in range(len(names))):
        raise ValueError(f"traits are numbers of all {n} samples, and vary")
    y = F.array(*[((F.col(c) - stats[f"m{i}"]) / stats[f"s{i}"]).cast("double") for i, c in enumerate(names)])

    def keep(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("k")
        flat = table["y"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        save(f"{path}/residual-0-{table['sb'][0].as_py()}", flat.astype(np.float64).tobytes())
        return table.select(["sb"]).slice(0, 1)

    traits.select(F.floor(F.col("k") / side).cast("int").alias("sb"), "k", y.alias("y")).groupBy("sb").applyInArrow(keep, "sb int").count()


def carried(calls: DataFrame, traits: DataFrame, names: list[str], samples: int, side: int = SAMPLES) -> str:
    """prepared() from sparse dosages (vid, k, g) of ``samples`` samples numbered from 0, absent ones being 0. Variants go in
    the order of vid, in chunks of at most PAIRS products of two variants that a sample carries both of (or of VARIANTS
    variants, where that is more); a tile holds its carriers only, so what is written and held grows with the carriers, the
    samples, and the chunks' products."""
    path, n = folder(calls.sparkSession, "carried"), samples
    _residuals(traits, names, path, n, side)
    square = blocks.VARIANTS
    most = max(square, SUMS // (-(-n // side) * len(names)))
    calls = kept(calls.select("vid", F.col("k").cast("long").alias("k"), F.col("g").cast("double").alias("g")), f"{path}/calls")
    each = calls.groupBy("vid").agg(F.count("*").alias("size"), (F.sum("g") / n).alias("mean"), (F.sum(F.col("g") * F.col("g")) - F.sum("g") * F.sum("g") / n).alias("xx"))
    each = kept(each, f"{path}/each")
    size = each.agg(F.count("*").alias("rows"), F.sum("size").alias("held")).first()
    parts = max(1, -(-size["rows"] // most), -(-2 * (size["held"] or 0) // HELD))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vc, rows, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            out = np.empty((batch.num_rows, 2), np.int64)
            for i, size in enumerate(batch.column("size").to_pylist()):
                if rows and (rows == most or held + size > HELD):
                    vc, rows, held = vc + 1, 0, 0
                out[i] = vc, rows
                rows, held = rows + 1, held + size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vid", "mean", "xx")), pa.array(out[:, 0]), pa.array(out[:, 1].astype(np.int32))], ["vid", "mean", "xx", "vc", "j"])

    placed = kept(each.repartitionByRange(parts, "vid").sortWithinPartitions("vid").mapInArrow(place, "vid long, mean double, xx double, vc long, j int"), f"{path}/placed")
    met = calls.join(placed, "vid").repartition("vc").sortWithinPartitions("vc")

    def products(j: np.ndarray, k: np.ndarray, g: np.ndarray, rows: int) -> bytes:
        """Sums of g_i g_j of each variant j with those before it, by j: where each begins, the sums, and their i. Carriers are
        in the order of sample and variant."""
        found, lag, at = [], 1, np.arange(len(k))
        total = np.zeros((rows, rows)) if rows <= square else None
        while len(at := at[at + lag < len(k)]) and len(at := at[k[at] == k[at + lag]]):  # carriers of one sample stand side by side
            if total is not None:
                np.add.at(total, (j[at + lag], j[at]), g[at] * g[at + lag])
            else:
                found.append((j[at + lag] * rows + j[at], g[at] * g[at + lag]))
            lag += 1
        if total is not None:
            one, two = np.nonzero(total)
            value = total[one, two]
        else:
            code, of = np.unique(np.concatenate([np.zeros(0, np.int64), *(c for c, _ in found)]), return_inverse=True)
            value = np.bincount(of, weights=np.concatenate([np.zeros(0), *(v for _, v in found)]), minlength=len(code))
            one, two = code // rows, code % rows
        return np.searchsorted(one, np.arange(rows + 1)).astype(np.int64).tobytes() + value.tobytes() + two.astype(np.int32).tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, table in _chunks(batches):
            j, k, g, vid, mean, xx = (table[c].to_numpy() for c in ("j", "k", "g", "vid", "mean", "xx"))
            j = j.astype(np.int64)
            facts, ids = np.zeros((j.max() + 1, 2)), np.zeros(j.max() + 1, np.int64)
            some = xx > 1e-10 * (xx + n * mean**2)
            facts[j], ids[j] = np.column_stack([mean, np.where(some, np.sqrt((n - 1) / np.where(some, xx, 1)), 0)]), vid
            order = np.lexsort([j, k])
            j, k, g = j[order], k[order], g[order]
            first, turn = 0, 0
            while first < len(ids):
                # how many products variants from ``first`` on have with those before them, and so where the chunk ends
                place = np.arange(len(k))
                rank = place - np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), place, 0))
                met = np.cumsum(np.bincount(j - first, weights=rank, minlength=len(ids) - first))
                last = min(len(ids), first + max(square, int(np.searchsorted(met, PAIRS, side="right"))))
                now = j < last
                vc, jj, kk, gg, own = (whole << 14) + turn, j[now] - first, k[now], g[now], facts[first:last]
                save(f"{path}/gram-{vc}", products(jj, kk, gg, last - first))
                save(f"{path}/vid-{vc}", ids[first:last].tobytes())
                save(f"{path}/facts-{vc}", own.tobytes())
                m = int((own[:, 1] > 0).sum())
                edges = [0, *(np.flatnonzero(np.diff(kk // side)) + 1), len(kk)]
                for a, b in itertools.pairwise(edges):
                    sb = int(kk[a]) // side
                    body = jj[a:b].astype(np.int32).tobytes() + (kk[a:b] - sb * side).astype(np.int32).tobytes() + gg[a:b].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([vc]), pa.array([m]), pa.array([sb], pa.int32()), pa.array([b - a], pa.int32()), pa.array([body], pa.binary())], ["vc", "m", "sb", "size", "body"])
                j, k, g = j[~now], k[~now], g[~now]
                first, turn = last, turn + 1

    tiles = kept(met.mapInArrow(cut_up, "vc long, m long, sb int, size int, body binary"), f"{path}/tiles")
    chunks = sorted((r["vc"], r["m"]) for r in tiles.select("vc", "m").distinct().collect())  # two numbers a chunk
    meta = {"samples": n, "side": side, "columns": 0, "traits": names, "chunks": [c for c, _ in chunks], "variants": sum(m for _, m in chunks), "carried": True}
    save(f"{path}/meta", json.dumps(meta).encode())
    return path


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each vc, which stand together."""
    now, held = None, []
    for batch in batches:
        vc = batch.column("vc").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(vc)) + 1), len(vc)] if len(vc) else [0]
        for a, b in itertools.pairwise(edges):
            if held and vc[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(vc[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


class _Dense:
    """Standardised genotypes x of a tile, as a matrix."""

    def __init__(self, x: np.ndarray):
        self.x, self.rows = x, len(x)

    def times(self, residual: np.ndarray) -> np.ndarray:
        return self.x @ residual

    def back(self, moved: np.ndarray, samples: int) -> np.ndarray:
        return self.x.T @ moved


class _Carried:
    """The same from the carriers (row j, sample k, dosage g) of variants with a mean and a factor."""

    def __init__(self, facts: np.ndarray, parts: list[tuple[int, bytes]]):
        self.mean, self.by, self.rows = facts[:, :1], facts[:, 1:], len(facts)
        body = [(np.frombuffer(b, np.int32, s), np.frombuffer(b, np.int32, s, 4 * s), np.frombuffer(b, np.float64, s, 8 * s)) for s, b in parts]
        self.j, self.k, self.g = (np.concatenate(x) for x in zip(*body, strict=True)) if body else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))

    def times(self, residual: np.ndarray) -> np.ndarray:
        out = self._sums(self.j, residual[self.k], self.rows)
        return self.by * (out - self.mean * residual.sum(axis=0))

    def back(self, moved: np.ndarray, samples: int) -> np.ndarray:
        moved = self.by * moved
        return self._sums(self.k, moved[self.j], samples) - (self.mean * moved).sum(axis=0)

    def _sums(self, at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.column_stack([np.bincount(at, weights=self.g * v, minlength=size) for v in values.T])


def _carried(path: str, chunks: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Carried]]:
    """Every chunk, in order, whether the task's samples carry anything of it or not."""
    made = _chunks(batches)
    now = next(made, None)
    for vc in chunks:
        parts = []
        if now is not None and now[0] == vc:
            parts = list(zip(now[1]["size"].to_pylist(), now[1]["body"].to_pylist(), strict=True))
            now = next(made, None)
        yield vc, _Carried(np.frombuffer(load(f"{path}/facts-{vc}")).reshape(-1, 2), parts)


def _updated(c: np.ndarray, gram: np.ndarray, beta: np.ndarray, prior: np.ndarray, variance: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Effects (variants, columns) of a chunk after a sweep over it, given c = x'residual, and each column's part of the bound
    (without the residuals' squares): prior and variance are (2, columns), noise is (columns)."""
    beta, c, bound = beta.copy(), c.copy(), np.zeros(len(noise))
    for j in range(len(beta)):
        g = gram[j, j]
        if g <= 0:
            continue
        s = 1 / (g / noise + 1 / variance)
        m = s * (c[j] + g * beta[j]) / noise
        score = np.log(prior) + 0.5 * np.log(s / variance) + m * m / (2 * s)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        new = (weight * m).sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = np.where(weight > 0, weight * (np.log(prior) - np.log(weight)), 0).sum(axis=0)
        bound += entropy + (weight * (0.5 * np.log(s / variance) + 0.5 - (m * m + s) / (2 * variance))).sum(axis=0) - g * ((weight * (s + m * m)).sum(axis=0) - new * new) / (2 * noise)
        c -= np.outer(gram[:, j], new - beta[j])
        beta[j] = new
    return beta, bound


def _updated_carried(c: np.ndarray, gram: bytes, x: _Carried, beta: np.ndarray, n: int, prior: np.ndarray, variance: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_updated() where the Gram matrix is by_i by_j (p_ij - n mean_i mean_j), p the products of carried(), and n - 1 on the
    diagonal of variants that vary."""
    rows, g = len(beta), n - 1.0
    start = np.frombuffer(gram, np.int64, rows + 1).tolist()
    value = np.frombuffer(gram, np.float64, start[-1], 8 * (rows + 1))
    to = np.frombuffer(gram, np.int32, start[-1], 8 * (rows + 1 + start[-1]))
    s = 1 / (g / noise + 1 / variance)
    level = np.log(prior) + 0.5 * np.log(s / variance)
    lean, bend = level[1] - level[0], (s[1] - s[0]) / (2 * noise * noise)
    narrow, wider = s[1] / noise, (s[0] - s[1]) / noise
    t, new, moved, shift = c + g * beta, beta.copy(), np.zeros_like(beta), np.zeros(len(noise))
    with np.errstate(over="ignore"):
        for j, (mean, by) in enumerate(zip(x.mean[:, 0].tolist(), x.by[:, 0].tolist(), strict=True)):
            if by <= 0:
                continue
            now, a, b = t[j], start[j], start[j + 1]
            now += (n * mean * by) * shift
            if b > a:
                now -= by * value[a:b].dot(moved.take(to[a:b], axis=0))
            weight = 1 / (1 + np.exp(now * now * bend + lean))
            new[j] = now * (narrow + weight * wider)
            change = by * (new[j] - beta[j])
            moved[j] = change
            shift += mean * change
    some = x.by[:, 0] > 0
    m = s[:, None] * t[some] / noise
    score = level[:, None] + m * m / (2 * s[:, None])
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.where(weight > 0, weight * (np.log(prior)[:, None] - np.log(weight)), 0).sum(axis=(0, 1))
    own = (weight * (0.5 * np.log(s / variance)[:, None] + 0.5 - (m * m + s[:, None]) / (2 * variance[:, None]))).sum(axis=(0, 1))
    return new, entropy + own - (g * ((weight * (s[:, None] + m * m)).sum(axis=0) - new[some] ** 2) / (2 * noise)).sum(axis=0)


def fitted(spark: SparkSession, path: str, candidates: list[Candidate], sweeps: int = 50, tolerance: float = 1e-6) -> tuple[DataFrame, list[list[float]]]:
    """(vid, trait, candidate, beta) of standardised genotypes and traits, and the bounds of each sweep so far by column
    (traits, and within them candidates). Goes on from the folder's last whole sweep; ends after ``sweeps`` in all, or when
    no effect has moved by more than tolerance / sqrt(variants)."""
    meta = json.loads(load(f"{path}/meta"))
    if any(not (0 < c.p < 1 and 0 < c.f < 1 and 0 < c.h2 < 1) for c in candidates):
        raise ValueError("p, f and h2 lie between 0 and 1")
    n, side, chunks, names = meta["samples"], meta["side"], meta["chunks"], meta["traits"]
    layout, sparse = Panel(None, path, n, 0, ["_one"], 0, side, meta["columns"]), meta.get("carried", False)
    tiles = spark.read.parquet(f"{path}/tiles")
    every = [c for _ in names for c in candidates]
    columns, blocks_ = len(every), -(-n // side)
    slab = max(meta["variants"], 1)
    p, f, h2 = (np.array([getattr(c, x) for c in every]) for x in ("p", "f", "h2"))
    prior, variance, noise = np.stack([p, 1 - p]), np.stack([(1 - f) / p, f / (1 - p)]) * h2 / slab, 1 - h2
    asked = json.dumps([list(c) for c in candidates])
    try:
        state = json.loads(load(f"{path}/state"))
    except FileNotFoundError:
        state = {"sweep": 0, "bounds": [], "moved": None, "candidates": asked}
    if state["candidates"] != asked:
        raise ValueError("the folder holds a fit of other candidates")

    def sweep(done: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import BarrierTaskContext

            context = BarrierTaskContext.get()
            residual, sb, bound, moved = None, context.partitionId() if sparse else -1, np.zeros(columns), 0.0
            made = ((vc, sb, x) for vc, x in _carried(path, chunks, batches)) if sparse else ((vc, b, _Dense(tile.u * np.sqrt(n - 1))) for vc, b, tile in _tiles(layout, batches))
            for vc, sb, x in made:
                if residual is None:
                    residual = np.frombuffer(load(f"{path}/residual-{done}-{sb}")).reshape(-1, columns if done else len(names)).copy()
                    if not done:
                        residual = np.repeat(residual, len(candidates), axis=1)
                c = _sum(context.allGather(_text(x.times(residual))), (x.rows, columns))
                before = np.frombuffer(load(f"{path}/beta-{done}-{vc}")).reshape(-1, columns) if done else np.zeros((x.rows, columns))
                gram = load(f"{path}/gram-{vc}")
                beta, part = _updated_carried(c, gram, x, before, n, prior, variance, noise) if sparse else _updated(c, np.frombuffer(gram).reshape(x.rows, -1), before, prior, variance, noise)
                residual += x.back(before - beta, len(residual))
                bound, moved = bound + part, max(moved, float(np.abs(beta - before).max(initial=0)))
                if sb == 0:
                    save(f"{path}/beta-{done + 1}-{vc}", beta.tobytes())
            squares = _sum(context.allGather(_text((residual**2).sum(axis=0) if residual is not None else np.zeros(columns))), (columns,))
            if residual is not None:
                save(f"{path}/residual-{done + 1}-{sb}", residual.tobytes())
            if sb == 0:
                bound = bound - squares / (2 * noise) - n / 2 * np.log(2 * np.pi * noise)
                yield pa.RecordBatch.from_arrays([pa.array([bound.tolist()], pa.list_(pa.float64())), pa.array([moved])], ["bound", "moved"])

        ordered = tiles.repartitionById(blocks_, "sb").sortWithinPartitions("vc")
        return ordered.mapInArrow(run, "bound array<double>, moved double", barrier=True).collect()

    bar = tolerance / np.sqrt(slab)
    while state["sweep"] < sweeps and chunks and (state["moved"] is None or state["moved"] > bar):
        made = sweep(state["sweep"])[0]
        state |= {"sweep": state["sweep"] + 1, "bounds": [*state["bounds"], list(made["bound"])], "moved": made["moved"]}
        save(f"{path}/state", json.dumps(state).encode())
    last = state["sweep"]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vc in batch.column(0).to_pylist():
                vid = np.frombuffer(load(f"{path}/vid-{vc}"), np.int64)
                beta = np.frombuffer(load(f"{path}/beta-{last}-{vc}")).reshape(len(vid), columns) if last else np.zeros((len(vid), columns))
                label = [(t, c.name) for t in names for c in candidates]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(vid, columns)), pa.array([t for t, _ in label] * len(vid)), pa.array([c for _, c in label] * len(vid)), pa.array(beta.ravel())], ["vid", "trait", "candidate", "beta"])

    made = spark.createDataFrame([(c,) for c in chunks], "vc long").repartition(max(1, min(len(chunks), 200)))
    return made.mapInArrow(out, "vid long, trait string, candidate string, beta double"), state["bounds"]
