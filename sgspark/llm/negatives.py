"""Hard negatives: exact search among rotated vectors, whose leading components rule most pairs out.

Components become whole numbers, floor(scale * x); a pair's score is the inner product of these. An anchor's positives
are its ``positives`` best other rows of its label, and each positive's negatives are the ``negatives`` best rows of other
labels whose score is from ``least`` percent of the positive's to the positive's.

1. Rows are dealt at random into blocks of some megabytes; a task sorts a block by label and writes it to the shared
   folder with its leading components under an orthogonal rotation, and the norms of what these leave. The rotation holds
   the principal axes of a sample of at most about SAMPLE rows; it decides how much is ruled out and never what is found.
2. A task takes the anchors of some blocks through a run of blocks, loaded one by one. It adds up products of leading
   components; the rest of a score is at most the product of the two residual norms, and rounding is bounded by a share
   of the two norms. Pairs that can't be among an anchor's best, or can't meet a positive's range, are dropped after an
   eighth, a quarter or half of the components; what is left is verified by whole-number products. Best rows so far
   raise the bar for the next blocks.
3. Each run's best rows, a few for an anchor, are ranked by windows; positives go to the shared folder for the second pass.

Anchors are compared with all rows, in blocks, so work grows with their product, and what is shuffled with anchors times
runs. Rows without an id, a label, a vector, or with a null or non-finite component (as it is or scaled) take no part.
Vectors of different lengths have no score. Vectors whose products could pass 2**60 are multiplied as Python's whole
numbers; scores beyond 2**62 count as 2**62. Rows that share an id are separate rows, ties go by the smaller id, no rows
and no anchors give no rows. Only the named columns are read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sgspark.llm.runtime import _tables, got, map_arrow, partitions, put, removed, written
from sgspark.llm.textcore import spread

#: Rows and bytes of components of a block, anchors that a task takes at once, blocks of a run at most, rows of a sample.
ROWS, BLOCK_BYTES, ANCHORS, RUN, SAMPLE = 8192, 16 << 20, 1024, 256, 8192
#: Rows of a block that are compared at once; pairs that are verified at once; share of pairs up to which they go one by one.
STRIP, PAIRS, SPARSE = 2048, 1 << 16, 0.1
#: No score, and the largest one.
NONE, MOST = -(1 << 62), (1 << 62) - 1


class Vectors:
    """Some vectors of one length: whole components q, leading rotated components y, and norms."""

    FIELDS = ("pos", "block", "id", "label", "q", "y", "norm", "rest", "wide")

    def __init__(self, **fields: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, fields[name])

    def __len__(self) -> int:
        return len(self.id)

    def take(self, rows: np.ndarray) -> Vectors:
        return Vectors(**{f: getattr(self, f)[rows] for f in self.FIELDS})

    @classmethod
    def made(cls, block: int, ids: np.ndarray, label: np.ndarray, q: np.ndarray, rotation: np.ndarray) -> Vectors:
        dim = q.shape[1]
        wide = np.abs(q).max(axis=1, initial=0) > 2.0 ** (30 - np.log2(max(dim, 1)) / 2)
        narrow = np.where(wide[:, None], 0.0, q)
        y = narrow @ rotation
        norm2 = np.einsum("ij,ij->i", narrow, narrow)
        norm = np.sqrt(norm2)
        rest = np.stack([np.sqrt(np.maximum(norm2 - np.einsum("ij,ij->i", y[:, :m], y[:, :m]), 0)) + 1e-6 * norm for m in steps(dim)], axis=1)
        whole = q if wide.any() else q.astype(np.int32)
        return cls(pos=np.arange(len(ids), dtype=np.int32), block=np.full(len(ids), block, np.int32), id=ids, label=label, q=whole, y=y.astype(np.float32), norm=norm.astype(np.float32), rest=rest.astype(np.float32), wide=wide)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def read(cls, at: str) -> Vectors:
        with np.load(io.BytesIO(got(at))) as z:
            return cls(**{f: z[f] for f in cls.FIELDS})

    @staticmethod
    def joined(parts: list[Vectors]) -> Vectors:
        return Vectors(**{f: np.concatenate([getattr(p, f) for p in parts]) for f in Vectors.FIELDS})


def steps(dim: int) -> list[int]:
    """Numbers of leading components after which pairs are judged."""
    return sorted({max(1, dim // 8), max(1, dim // 4), max(1, dim // 2)}) if dim else [0]


def slack(m: int) -> float:
    """Share of the product of two norms by which a sum of m products, its bounds and a bar in single precision may be off."""
    return (m + 8) * 2.0**-23


def products(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray) -> np.ndarray:
    """Whole inner products of the pairs (a[i], b[j])."""
    out = np.empty(len(i), dtype=np.int64)
    for k in range(0, len(i), PAIRS):
        x, y = i[k : k + PAIRS], j[k : k + PAIRS]
        rough = a.wide[x] | b.wide[y]
        part = np.zeros(len(x), dtype=np.int64)
        if not rough.all():
            x0, y0 = x[~rough], y[~rough]
            part[~rough] = np.einsum("ij,ij->i", a.q[x0].astype(np.int64), b.q[y0].astype(np.int64))
        for n in np.flatnonzero(rough):
            score = sum(int(u) * int(v) for u, v in zip(a.q[x[n]], b.q[y[n]], strict=True))
            part[n] = max(-MOST, min(MOST, score))
        out[k : k + PAIRS] = part
    return out


def met(a: Vectors, b: Vectors, wanted) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that ``wanted(rows of a, rows of b, lower, upper)`` doesn't rule out by the bounds of their
    scores; the rows are ranges for a whole matrix of bounds, or those of pairs."""
    rough_a, rough_b = a.wide.any(), b.wide.any()
    s, done = None, 0
    every = np.arange(len(a)), np.arange(len(b))
    for k, m in enumerate(steps(a.q.shape[1])):
        more = a.y[:, done:m] @ b.y[:, done:m].T
        s = more if s is None else s + more
        done = m
        margin = a.rest[:, k, None] * b.rest[None, :, k] + np.float32(slack(m)) * a.norm[:, None] * b.norm[None, :]
        low, high = s - margin, s + margin
        if rough_a:
            low[a.wide], high[a.wide] = -np.inf, np.inf
        if rough_b:
            low[:, b.wide], high[:, b.wide] = -np.inf, np.inf
        alive = wanted(*every, low, high)
        if np.count_nonzero(alive) <= SPARSE * alive.size:
            break
    i, j = np.nonzero(alive)
    s = s[i, j]
    for k, m in enumerate(steps(a.q.shape[1])):
        if m <= done or not len(i):
            continue
        s = s + np.einsum("ij,ij->i", a.y[i, done:m], b.y[j, done:m])
        done = m
        margin = a.rest[i, k] * b.rest[j, k] + np.float32(slack(m)) * a.norm[i] * b.norm[j]
        low, high = s - margin, s + margin
        rough = a.wide[i] | b.wide[j]
        low[rough], high[rough] = -np.inf, np.inf
        alive = wanted(i, j, low, high)
        i, j, s = i[alive], j[alive], s[alive]
    return i, j


class Best:
    """The best (score, id) of each of some rows, in order."""

    def __init__(self, rows: int, k: int):
        self.score = np.full((rows, k), NONE, dtype=np.int64)
        self.id = np.zeros((rows, k), dtype=np.int64)

    def add(self, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of candidates ``ids`` for the rows i."""
        k = self.score.shape[1]
        good = score >= self.score[i, -1]
        i, score, ids = i[good], score[good], ids[good]
        if not len(i):
            return
        rows = np.unique(i)
        i = np.concatenate([np.repeat(rows, k), i])
        score, ids = np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.id[rows].ravel(), ids])
        order = np.lexsort([ids, -score, i])
        i, score, ids = i[order], score[order], ids[order]
        _, rank = spread(np.unique(i, return_counts=True)[1])
        keep = rank < k
        self.score[i[keep], rank[keep]], self.id[i[keep], rank[keep]] = score[keep], ids[keep]


def _strips(lo: int, hi: int) -> Iterator[np.ndarray]:
    """Rows lo to hi in strips that grow: the first ones raise the bar for the others."""
    size = STRIP // 8
    while lo < hi:
        yield np.arange(lo, min(hi, lo + size))
        lo, size = lo + size, min(STRIP, 2 * size)


def _labels(a: Vectors, b: Vectors) -> Iterator[tuple[np.ndarray, int, int]]:
    """For each label of a: its rows of a, in parts of ANCHORS, and the range of its rows in b. Both are sorted by label."""
    for label in np.unique(a.label):
        first, last = np.searchsorted(a.label, [label, label + 1])
        lo, hi = np.searchsorted(b.label, [label, label + 1])
        for k in range(first, last, ANCHORS):
            yield np.arange(k, min(last, k + ANCHORS)), int(lo), int(hi)


def nearest(a: Vectors, b: Vectors, best: Best) -> None:
    """Adds the rows of b to the best ones of the same label of each row of a, but for itself."""
    k = best.score.shape[1]
    for rows, lo, hi in _labels(a, b):
        x = a.take(rows)
        for strip in _strips(lo, hi):
            y = b.take(strip)
            own = np.full(len(x), -1)
            same = np.flatnonzero(x.block == y.block[0])
            own[same] = np.where((x.pos[same] >= strip[0]) & (x.pos[same] <= strip[-1]), x.pos[same] - strip[0], -1)
            has = np.flatnonzero(own >= 0)
            bar = best.score[rows, -1].astype(np.float32)

            def wanted(i, j, low, high, own=own, has=has, bar=bar):
                if low.ndim == 1:
                    return high >= bar[i]
                low[has, own[has]], high[has, own[has]] = -np.inf, -np.inf
                if low.shape[1] >= k:  # so many pairs reach this at least
                    np.maximum(bar, np.partition(low, -k, axis=1)[:, -k], out=bar)
                return (high >= bar[:, None]) & (high > -np.inf)

            i, j = met(x, y, wanted)
            other = own[i] != j
            i, j = i[other], j[other]
            best.add(rows[i], products(x, i, y, j), y.id[j])


def within(a: Vectors, b: Vectors, scores: np.ndarray, best: list[Best], least: int) -> None:
    """Adds the rows of b of other labels than a's rows to the best ones in range of each positive; scores: the positives'
    scores for each row of a (NONE: there is none)."""
    for rows, lo, hi in _labels(a, b):
        x, top = a.take(rows), scores[rows]
        if (top < 0).all():
            continue
        for strip in (*_strips(0, lo), *_strips(hi, len(b))):
            y = b.take(strip)
            upper = np.where(top < 0, -np.inf, top).astype(np.float32)
            lower = np.where(top < 0, np.inf, np.maximum(top * (least / 100), np.stack([x.score[rows, -1] for x in best], axis=1))).astype(np.float32)

            def wanted(i, j, low, high, upper=upper, lower=lower):
                if low.ndim == 1:
                    return ((high[:, None] >= lower[i]) & (low[:, None] <= upper[i])).any(axis=1)
                alive = np.zeros(low.shape, dtype=bool)
                for k in range(upper.shape[1]):
                    alive |= (high >= lower[:, k, None]) & (low <= upper[:, k, None])
                return alive

            i, j = met(x, y, wanted)
            got = products(x, i, y, j)
            for k, its in enumerate(best):
                bound = top[i, k]
                fits = (bound >= 0) & (got <= bound) & (got >= bound // 100 * least - -(bound % 100) * least // 100)
                its.add(rows[i[fits]], got[fits], y.id[j[fits]])


def _numbers(column: pa.Array, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat.reshape(len(column), -1 if len(flat) else 0))


def mined(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the rows that ``anchor`` holds for."""
    spark = vectors.sparkSession
    parts = partitions(spark)
    kind = "array<float>" if dict(vectors.dtypes)[embedding] == "array<float>" else "array<double>"
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast(kind).alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("dim", F.size("vec"))
    sizes = {r["dim"]: (r["n"], r["m"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("anchor").alias("m")).collect()}  # two numbers a length of vectors
    folder = f"{_tables(spark)}/negatives-{uuid.uuid4().hex}"
    blocks = {d: -(-n // min(ROWS, max(256, BLOCK_BYTES // (8 * max(d, 1))))) for d, (n, m) in sizes.items() if m}
    plan = []  # (length, anchor blocks together, runs)
    for d, n_blocks in blocks.items():
        together = max(1, min(n_blocks, ANCHORS * n_blocks // sizes[d][1]))
        sets = -(-n_blocks // together)
        plan.append((d, n_blocks, together, max(-(-n_blocks // RUN), min(n_blocks, -(-2 * parts // sets)))))
    lengths = spark.createDataFrame([(d, n, g, r, min(1.0, min(SAMPLE, max(256, BLOCK_BYTES // (2 * max(d, 1)))) / sizes[d][0])) for d, n, g, r in plan], "dim int, blocks int, together int, runs int, share double")
    rows = rows.join(F.broadcast(lengths), "dim")  # a row a length of vectors

    def fit(table: pa.Table) -> pa.Table:
        q = _numbers(table["vec"].combine_chunks(), scale)
        with np.errstate(over="ignore", invalid="ignore"):
            q = q / np.maximum(np.abs(q).max(axis=1, initial=0), 1)[:, None]
        axes = np.linalg.eigh(q.T @ q)[1][:, ::-1] if q.shape[1] else q[:0]
        put(f"{folder}/axes-{table['dim'][0].as_py()}", np.ascontiguousarray(axes[:, : steps(q.shape[1])[-1]]).tobytes())
        return table.select(["dim"]).slice(0, 1)

    rows.where(F.rand(11) < F.col("share")).select("dim", "vec").groupBy("dim").applyInArrow(fit, "dim int").collect()

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim, block = table["dim"][0].as_py(), table["block"][0].as_py()
        ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
        order = np.lexsort([ids, labels])
        q = _numbers(table["vec"].combine_chunks(), scale)
        try:
            axes = np.frombuffer(got(f"{folder}/axes-{dim}")).reshape(dim, -1) if dim else np.zeros((0, 0))
        except FileNotFoundError:  # the sample has no row of this length
            axes = np.eye(dim)[:, : steps(dim)[-1]]
        made = Vectors.made(block, ids[order], labels[order], q[order], axes)
        chosen = np.flatnonzero(table["anchor"].to_numpy()[order])
        put(f"{folder}/rows-{dim}-{block}", made.packed())
        put(f"{folder}/anchors-{dim}-{block}", made.take(chosen).packed())
        return table.select(["dim", "block"]).slice(0, 1)

    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("blocks")).cast("int"))
    present = dealt.select("dim", "block", "id", "label", "vec", "anchor").groupBy("dim", "block").applyInArrow(build, "dim int, block int")
    present = written(present, "blocks")
    full: dict[int, list[int]] = {}
    for r in present.collect():  # two numbers a block
        full.setdefault(r["dim"], []).append(r["block"])
    full = {d: sorted(x) for d, x in full.items()}
    together = {d: g for d, _, g, _ in plan}
    runs = {d: r for d, _, _, r in plan}
    tasks = lengths.select("dim", "runs", F.explode(F.expr("sequence(0, (blocks - 1) div together)")).alias("set")).select("dim", "set", F.explode(F.expr("sequence(0, runs - 1)")).alias("run"))
    count = sum(-(-n // g) * r for _, n, g, r in plan)
    tasks = tasks.repartition(max(1, min(count, 100 * parts)))

    def jobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Vectors, Iterator[Vectors]]]:
        for batch in batches:
            for dim, number, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                its = full.get(dim, [])
                mine = its[number * together[dim] : (number + 1) * together[dim]]
                anchors = Vectors.joined([Vectors.read(f"{folder}/anchors-{dim}-{b}") for b in mine]) if mine else None
                if anchors is None or not len(anchors):
                    continue
                anchors = anchors.take(np.argsort(anchors.label, kind="stable"))
                yield dim, anchors, (Vectors.read(f"{folder}/rows-{dim}-{b}") for b in its[len(its) * run // runs[dim] : len(its) * (run + 1) // runs[dim]])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, anchors, others in jobs(batches):
            best = Best(len(anchors), positives)
            for other in others:
                nearest(anchors, other, best)
            i, k = np.nonzero(best.score > NONE)
            columns = [np.full(len(i), dim, np.int32), anchors.block[i], anchors.pos[i], best.id[i, k], best.score[i, k]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "block", "pos", "id", "score"])

    def ranked(df: DataFrame, by: list[str], most: int) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= most)

    found = ranked(map_arrow(tasks, first, "dim int, block int, pos int, id long, score long"), ["dim", "block", "pos"], positives)

    def keep(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        np.savez(out, **{c: table[c].to_numpy() for c in ("pos", "rank", "id", "score")})
        put(f"{folder}/positives-{table['dim'][0].as_py()}-{table['block'][0].as_py()}", out.getvalue())
        return table.select(["dim", "block"]).slice(0, 1)

    has = {(r["dim"], r["block"]) for r in found.groupBy("dim", "block").applyInArrow(keep, "dim int, block int").collect()}  # two numbers a block

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, anchors, others in jobs(batches):
            ids, scores = np.zeros((len(anchors), positives), np.int64), np.full((len(anchors), positives), NONE, np.int64)
            for block in np.unique(anchors.block).tolist():
                if (dim, block) not in has:
                    continue
                at = np.flatnonzero(anchors.block == block)
                at = at[np.argsort(anchors.pos[at])]
                with np.load(io.BytesIO(got(f"{folder}/positives-{dim}-{block}"))) as z:
                    row = at[np.searchsorted(anchors.pos[at], z["pos"])]
                    ids[row, z["rank"] - 1], scores[row, z["rank"] - 1] = z["id"], z["score"]
            best = [Best(len(anchors), negatives) for _ in range(positives)]
            for other in others:
                within(anchors, other, scores, best, least)
            for n, its in enumerate(best):
                i, k = np.nonzero(its.score > NONE)
                columns = [np.full(len(i), dim, np.int32), anchors.block[i], anchors.pos[i], np.full(len(i), n, np.int32), anchors.id[i], ids[i, n], scores[i, n], its.id[i, k], its.score[i, k]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "block", "pos", "n", "anchor_id", "positive_id", "positive_score", "id", "score"])

    out = map_arrow(tasks, second, "dim int, block int, pos int, n int, anchor_id long, positive_id long, positive_score long, id long, score long")
    out = ranked(out, ["dim", "block", "pos", "n"], negatives)
    out = written(out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    removed(spark, folder)
    return out
