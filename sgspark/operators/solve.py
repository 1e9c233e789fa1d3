"""Iterative solves over distributed matrices. The sparse dosages are numbered and written once for either direction of a
product; a round moves vectors only, which lie in the shared folder in chunks."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sgspark.sources.shared import folder, forget, kept, load, save

#: Numbers of a vector's chunk.
SIDE = 1 << 16


def _numbered(rows: DataFrame, key: str, side: int, path: str) -> DataFrame:
    """rows with c and i, chunk and place in it by the order of ``key``: counted within a task, then over the tasks."""
    rows = kept(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id()), path)
    rows = rows.withColumns({"_part": F.shiftright("_m", 33), "_m": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    k = F.col("_start") + F.col("_m")
    return rows.join(F.broadcast(starts), "_part").withColumns({"c": F.floor(k / side).cast("int"), "i": (k % side).cast("int")}).drop("_m", "_part", "_start")


def _sorted(calls: DataFrame, to: str, of: str, parts: int, path: str) -> DataFrame:
    """The dosages for sums by ``to`` over ``of``: those of a pair of chunks stand together, in as many tasks as they need."""
    keys = [f"{to}c", f"{of}c", f"{to}i"]
    rows = calls.repartitionByRange(parts, *keys) if parts else calls.repartitionByRange(*keys)
    return kept(rows.sortWithinPartitions(*keys[:2]).select(F.col(f"{to}c").alias("c"), F.col(f"{to}i").alias("i"), F.col(f"{of}c").alias("oc"), F.col(f"{of}i").alias("oi"), "g"), path)


def _products(calls: DataFrame, vector: str) -> DataFrame:
    """(c, i, total): sums of g times the vector's numbers, as far as a task has them. It holds one chunk of either side."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = held = x = total = met = None

        def made() -> pa.RecordBatch:
            at = np.flatnonzero(met)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["c", "i", "total"])

        for batch in batches:
            c, i, oc, oi, g = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("c", "i", "oc", "oi", "g"))
            edges = [0, *(np.flatnonzero((np.diff(c) != 0) | (np.diff(oc) != 0)) + 1), len(c)]
            for a, b in itertools.pairwise(edges if len(c) else []):
                if c[a] != now:
                    if now is not None:
                        yield made()
                    now, total, met = c[a], np.zeros(i[a:b].max() + 1), np.zeros(i[a:b].max() + 1, bool)
                if (size := i[a:b].max() + 1) > len(total):
                    total, met = (np.concatenate([v, np.zeros(size - len(v), v.dtype)]) for v in (total, met))
                if oc[a] != held:
                    held, x = oc[a], np.frombuffer(load(f"{vector}/{oc[a]}"))
                np.add.at(total, i[a:b], g[a:b] * x[oi[a:b]])
                met[i[a:b]] = True
        if now is not None:
            yield made()

    return calls.mapInArrow(add, "c int, i int, total double")


def _each(rows: DataFrame, f: Callable[[int, pa.Table], tuple[float, float]]) -> tuple[float, float]:
    """Sums of the two numbers that f gives for each chunk c of rows."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        a, b = f(key[0].as_py(), table)
        return pa.table({"a": [float(a)], "b": [float(b)]})

    a, b = rows.groupBy("c").applyInArrow(one, "a double, b double").agg(F.sum("a"), F.sum("b")).first()
    return a or 0.0, b or 0.0


def _placed(table: pa.Table, name: str, size: int | None = None) -> np.ndarray:
    """A chunk of a vector from rows (i, name), of which those of one place are added."""
    return np.bincount(table["i"].to_numpy(), table[name].to_numpy(), size or 0)


def conjugate_gradients(dosage: DataFrame, scale: DataFrame, y: DataFrame, ridge: float, rounds: int = 500, tolerance: float = 1e-8, parts: int = 0, side: int = SIDE) -> DataFrame:
    """u with (X X' / m + ridge) u = y for y (sid, y). Runs until the recurrence's residual is at most tolerance * |y|; if
    ``rounds`` don't reach it, that is an error. Absent dosages are two constants. The dosages are shuffled before the first
    round only, to ``parts`` partitions if given; a round shuffles sums of a number a variant and a sample, tasks read the
    chunks (of ``side`` numbers) that they meet, and the driver holds a few numbers. Samples of a null y stay null."""
    spark, path = y.sparkSession, folder(y.sparkSession, "solve")
    people = _numbered(kept(y.select("sid", F.col("y").cast("double").alias("y")).where("y is not null"), f"{path}/y"), "sid", side, f"{path}/people")
    variants = _numbered(kept(scale, f"{path}/scale"), "idx", side, f"{path}/variants")
    m, n = variants.count(), people.count()
    deal = lambda df, key: df.repartition(parts, key) if parts else df
    calls = deal(dosage, "idx").join(deal(variants.select("idx", F.col("c").alias("vc"), F.col("i").alias("vi")), "idx"), "idx")
    calls = deal(calls, "sid").join(deal(people.select("sid", F.col("c").alias("sc"), F.col("i").alias("si")), "sid"), "sid")
    calls = kept(calls.select("vc", "vi", "sc", "si", F.col("g").cast("double").alias("g")), f"{path}/calls")
    by_variant, by_sample = _sorted(calls, "v", "s", parts, f"{path}/by-variant"), _sorted(calls, "s", "v", parts, f"{path}/by-sample")

    def vector(name: str, done: int, c: int) -> np.ndarray:
        return np.frombuffer(load(f"{path}/{done}/{name}/{c}"))

    def put(name: str, done: int, c: int, x: np.ndarray) -> None:
        save(f"{path}/{done}/{name}/{c}", np.ascontiguousarray(x).tobytes())

    def facts(c: int, table: pa.Table) -> tuple[float, float]:
        save(f"{path}/facts/{c}", np.stack([_placed(table, "mean"), _placed(table, "inv_sd")]).tobytes())
        return 0.0, 0.0

    def start(c: int, table: pa.Table) -> tuple[float, float]:
        own = _placed(table, "y")
        for name, x in (("u", np.zeros(len(own))), ("r", own), ("p", own)):
            put(name, 0, c, x)
        return own @ own, own.sum()

    _each(variants.select("c", "i", "mean", "inv_sd"), facts)
    rr, sv = _each(people.select("c", "i", "y"), start)
    # chunks that no dosage meets have their place in the sums
    every = lambda size: spark.range(-(-size // side)).select(F.col("id").cast("int").alias("c"), F.lit(0).alias("i"), F.lit(0.0).alias("total"))
    norm, done = rr, 0
    while not rr <= tolerance**2 * norm:
        if done == rounds:
            raise RuntimeError(f"conjugate gradients: relative residual {(rr / norm) ** 0.5:.2g} after {rounds} rounds, not {tolerance:.2g}")

        def weigh(c: int, table: pa.Table) -> tuple[float, float]:
            mean, inv_sd = np.frombuffer(load(f"{path}/facts/{c}")).reshape(2, -1)
            w = inv_sd * (_placed(table, "total", len(mean)) - mean * sv)
            put("w", done, c, inv_sd * w)
            return (mean * inv_sd * w).sum(), 0.0

        shift, _ = _each(_products(by_variant, f"{path}/{done}/p").unionByName(every(m)), weigh)

        def multiply(c: int, table: pa.Table) -> tuple[float, float]:
            p = vector("p", done, c)
            ap = (_placed(table, "total", len(p)) - shift) / max(m, 1) + ridge * p
            put("ap", done, c, ap)
            return p @ ap, 0.0

        alpha = rr / _each(_products(by_sample, f"{path}/{done}/w").unionByName(every(n)), multiply)[0]

        def step(c: int, _: pa.Table) -> tuple[float, float]:
            r = vector("r", done, c) - alpha * vector("ap", done, c)
            put("u", done + 1, c, vector("u", done, c) + alpha * vector("p", done, c))
            put("r", done + 1, c, r)
            return r @ r, 0.0

        new, _ = _each(every(n), step)
        beta = new / rr

        def turn(c: int, _: pa.Table) -> tuple[float, float]:
            p = vector("r", done + 1, c) + beta * vector("p", done, c)
            put("p", done + 1, c, p)
            return p.sum(), 0.0

        sv, _ = _each(every(n), turn)
        forget(spark, f"{path}/{done}")
        rr = new
        done += 1

    def solution(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = x = None
        for batch in batches:
            c, i = batch.column("c").to_numpy(), batch.column("i").to_numpy()
            u = np.empty(len(c))
            for one in np.unique(c):
                if one != held:
                    held, x = one, vector("u", done, one)
                u[c == one] = x[i[c == one]]
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(u)], ["sid", "u"])

    found = people.select("sid", "c", "i").mapInArrow(solution, StructType([people.schema["sid"], StructField("u", DoubleType())]))
    return y.select("sid").join(found, "sid", "left")
