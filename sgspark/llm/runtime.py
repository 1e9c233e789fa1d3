"""Shared-folder tables and connected components for the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local master gets one of our
    own; a cluster has to name one, as its machines share no temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cleanup(spark: SparkSession) -> None:
    """Deletes this application's tables in the shared folder; for when all results that read them have been written."""
    removed(spark, _tables(spark))


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table that written() made and that nothing reads any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        removed(df.sparkSession, path)


def _file(at: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(at) if at.startswith("file:") or "://" in at else (pa.fs.LocalFileSystem(), at)


def put(at: str, data: bytes) -> None:
    """Writes a file of the shared folder from a task; a repeated task replaces it whole."""
    files, path = _file(at)
    files.create_dir(path.rsplit("/", 1)[0])
    mine = f"{path}-{uuid.uuid4().hex}"
    with files.open_output_stream(mine) as f:
        f.write(data)
    files.move(mine, path)


def got(at: str) -> bytes:
    files, path = _file(at)
    with files.open_input_stream(path) as f:
        return f.read()


#: Bytes of a batch of rows on its way to a worker.
BATCH_BYTES = 4 << 20


def release() -> None:
    """Gives memory that a task is done with back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) whose tasks leave no memory behind in their worker, and whose batches hold at most
    BATCH_BYTES, unless the session has a limit of its own: a thousand long texts at once don't fit beside a JVM."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) in ("67108864", "67108864b"):
        conf.set(key, str(BATCH_BYTES))

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(lean, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) of the connected components of the edges a-b; the root is the smallest node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of a partition by a forest of them, block by block."""
    a, b, held = [], [], 0
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        if batch.num_rows:
            a.append(batch.column(0).to_numpy(zero_copy_only=False))
            b.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += batch.num_rows
        if held >= 2 * LOCAL_EDGES:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], len(x)
            if held >= LOCAL_EDGES:
                yield pa.record_batch([pa.array(x), pa.array(y)], schema=schema)
                a, b, held = [], [], 0
    if held:
        x, y = forest(np.concatenate(a), np.concatenate(b))
        yield pa.record_batch([pa.array(x), pa.array(y)], schema=schema)


#: Edges that one task contracts alone (16 bytes each, some copies of them in memory).
LOCAL_EDGES = 2_000_000


def contracted(make):
    """``make(batches)``, which yields arrays (a, b) of edges, as a function for map_arrow whose rows are a forest of them:
    making and contracting share one worker."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _contract(pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema) for a, b in make(batches))

    return run


def components(edges: DataFrame, contract: bool = True) -> DataFrame:
    """Connected components of the long pairs (a, b) as rows (node, root), root being the smallest node; roots and lone nodes have no row.

    Edges are contracted to forests inside the partitions, then in rounds of large-star and small-star: a star is a join
    with the per-node minimum, which is a partial aggregate, so no task ever holds a neighbour list. Once at most
    LOCAL_EDGES are left, one task finishes them; with more, rounds go on until nothing changes. Every round is written to
    the shared folder. Nulls and self-loops are ignored; no edges give no rows. contract=False: the edges come from
    contracted() and are free of both.
    """
    if contract:
        edges = edges.select(F.col(edges.columns[0]).cast("long").alias("a"), F.col(edges.columns[1]).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
        edges = map_arrow(edges, _contract, "a long, b long")
    edges = written(edges, "edges")
    before = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.count_distinct("b")).first())
        if state[0] <= LOCAL_EDGES:
            done = written(map_arrow(edges.repartition(1), _contract, "a long, b long"), "edges")
            dropped(edges)
            edges = done
            break
        if state == before:
            break
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours above the node link to the smallest neighbour
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: on edges that now point downwards, all lower neighbours and the node link to the smallest
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b")).where("a <> b")
        new = written(map_arrow(small.distinct(), _contract, "a long, b long").distinct(), "edges")
        dropped(edges)
        edges = new
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._shared_path = edges._shared_path
    return out


#: Rows (some 30 bytes each) up to which a table that has been counted is broadcast.
BROADCAST_ROWS = 1_000_000
#: Salts of a key in looked_up() beyond that.
SALTS = 32


def looked_up(rows: DataFrame, facts: DataFrame, key: str, salted_by: str) -> DataFrame:
    """rows left joined with facts (thin, at most one row a key), however many rows share a key: facts are broadcast if they
    are few by count, else each key is split by a hash of ``salted_by`` over SALTS copies of its fact."""
    if facts.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), key, "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salted_by), F.lit(SALTS)).cast("int"))
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


class Guarded:
    """A table whose columns go by names of their own (c0_, c1_, ...), so that no column that an operator adds can clash
    with them; of repeated names the first one counts. restored() gives the rows their names back."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.inner = [f"c{i}_" for i in range(len(self.names))]
        self.rows = df.toDF(*self.inner)

    def __getitem__(self, name: str) -> str:
        return self.inner[self.names.index(name)]

    def restored(self, df: DataFrame) -> DataFrame:
        return df.select(*self.inner).toDF(*self.names)


def appended(df: DataFrame, text: str, make, fields: str, slice_bytes: int = 250_000) -> DataFrame:
    """df with columns that ``make(slice) -> list of arrays`` computes from the text column, in one pass of Arrow batches.

    fields: DDL of the new columns; columns of df with these names are replaced. Texts come as textcore slices of about slice_bytes.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields)
    names = [f.name for f in new]
    at = df.columns.index(text)
    kept = [i for i, c in enumerate(df.columns) if c not in names]
    schema = StructType([df.schema[i] for i in kept] + new.fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        from sgspark.llm import textcore

        out = to_arrow_schema(schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [make(s) for s in textcore.slices(batch.column(at), slice_bytes)]
            made = [pa.concat_arrays([pa.array(p[i], type=out.field(len(kept) + i).type) for p in parts]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + made, schema=out)

    return map_arrow(df, run, schema)
