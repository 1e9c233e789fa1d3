"""Training-order materialisation of a tokenised corpus.

Documents (text tokens and an end mark; texts without tokens give nothing) stand end to end in the order in which the
input's partitions hold them, and the stream is cut into sequences of ``length`` tokens, the last one filled with end marks. Sequence k gets
the slot feistel(k): a keyed permutation of [0, n) for any n, by a Feistel network on the next even number of bits, walked
until the value is below n. Slots are dense, so a shard is ``per_shard`` slots in a row, and every slot's place follows
by division: shard slot // per_shard, row slot % per_shard, length * 2 (or 4) bytes. A reader resumes at any slot.
Shards are raw files (the last one ends with the last slot) in a folder that all executors have mounted.

Tokens are written once to the shared folder, which fixes that order. Offsets are prefix sums in two levels: within a
task while it tokenises, then over the tasks' totals. Pieces of documents then go straight to the range of their slot: one
shuffle of the token bytes, into equal shards whatever the sizes of documents or sources. A task packs the pieces of some
megabytes of tokens by their ranges and compresses each pack; a range is PART slots, which is what the writer of a shard
holds at a time. The driver holds two numbers. A shard is one partition: choose ``per_shard`` so that there are not too
many of them.

Null texts and texts without tokens are in no sequence. Repeated rows are in the stream as often as they occur, and no
rows give no sequence. A null id is a null in doc_ids. The
vocabulary file is read by the driver and broadcast (its size is checked).
"""

from __future__ import annotations

import base64
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sgspark.llm import textcore as tc
from sgspark.llm.runtime import _tables, map_arrow, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's byte-level BPE cuts texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_MB = 64
LENGTH, PER_SHARD, KEY, ROUNDS = 1024, 16384, 20240607, 8
#: Texts that a task tokenises at once; slots that a writer holds; bytes of tokens that are packed together.
BATCH, PART, PACK_BYTES = 256, 16384, 16 << 20
_CODEC = "zstd"

_encoders: dict[int, object] = {}


def vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file; one that is too large to broadcast is refused."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_MB * 2**20 + 1)
    if len(data) > MAX_VOCABULARY_MB * 2**20:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_MB} MB")
    return data


def encoder(data: bytes):
    """A tiktoken encoding and its end mark, the first id that is free; kept for the life of a worker."""
    import tiktoken

    at = hash(data)
    if at not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _encoders[at] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1
    return _encoders[at]


def feistel(k: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots of the numbers k in [0, n): a permutation of [0, n) that depends on the key."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    low, keys = np.uint64((1 << half) - 1), tc.keys(key, ROUNDS)
    x = np.asarray(k, dtype=np.uint64).copy()
    walking = np.arange(len(x))
    while len(walking):
        a, b = x[walking] >> np.uint64(half), x[walking] & low
        for r in keys:
            a, b = b, a ^ (tc.mix(b + r) & low)
        x[walking] = (a << np.uint64(half)) | b
        walking = walking[x[walking] >= n]
    return x.astype(np.int64)


def tokenised(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, task, local, tokens, n): little-endian 2-byte ids (4-byte for larger vocabularies) with the end mark, and
    where they stand: the task's number, and the tokens that the task has made before."""
    data = vocabulary(path)
    _, end = encoder(data)
    shared = docs.sparkSession.sparkContext.broadcast(data)
    kind = np.dtype("<u2" if end < 1 << 16 else "<u4")
    rows = docs.where("text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoding, mark = encoder(shared.value)
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                ids = [np.array([*encoding.encode_ordinary(t.as_py()), mark], dtype=kind) for t in part.column(1)]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                local = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(n), task, np.int32)), pa.array(local), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(n)], ["doc_id", "task", "local", "tokens", "n"])

    return map_arrow(rows, run, "doc_id long, task int, local long, tokens binary, n long")


def _packed(slot: np.ndarray, seq: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, known: np.ndarray, tokens: np.ndarray) -> bytes:
    """Pieces of sequences as one compressed body."""
    raw = b"".join([np.array([len(slot)], "<i8").tobytes(), slot.astype("<i8").tobytes(), seq.astype("<i8").tobytes(), doc.astype("<i8").tobytes(), start.astype("<i4").tobytes(), size.astype("<i4").tobytes(), known.astype("u1").tobytes(), tokens.tobytes()])
    return len(raw).to_bytes(8, "little") + pa.Codec(_CODEC, compression_level=3).compress(raw, asbytes=True)


def _unpacked(body: bytes, kind: np.dtype) -> tuple[np.ndarray, ...]:
    raw = pa.Codec(_CODEC).decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for name, count in (("<i8", n), ("<i8", n), ("<i8", n), ("<i4", n), ("<i4", n), ("u1", n), (kind, -1)):
        out.append(np.frombuffer(raw, name, count, at))
        at += out[-1].nbytes
    slot, seq, doc, start, size, known, tokens = out
    return slot, seq, start, size, doc, known.astype(bool), tokens


def _dealt(docs: DataFrame, path: str, length: int, per_shard: int, key: int) -> tuple[DataFrame, int, np.dtype, int]:
    """Packs (shard, part, body) of pieces, partition p holding shard p in the order of its parts; the number of sequences,
    the kind of ids, and the end mark."""
    spark = docs.sparkSession
    rows = written(tokenised(docs, path), "tokens", compression="zstd")
    _, end = encoder(vocabulary(path))
    kind = np.dtype("<u2" if end < 1 << 16 else "<u4")
    total = rows.agg(F.sum("n")).first()[0] or 0
    n = -(-total // length)
    shards = max(1, -(-n // per_shard))

    # one row a task that has written tokens, as many as the input has partitions
    starts = rows.groupBy("task").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("m")
    rows = rows.join(F.broadcast(starts), "task").select("doc_id", (F.col("before") + F.col("local")).alias("at"), "tokens", "n")

    def packs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        at, m = (np.concatenate([x.column(i).to_numpy() for x in parts]) for i in (1, 3))
        known = np.concatenate([x.column(0).is_valid().to_numpy(zero_copy_only=False) for x in parts])
        ids = np.concatenate([x.column(0).fill_null(0).to_numpy() for x in parts])
        flat = np.concatenate([s.data for x in parts for s in tc.slices(x.column(2), 1 << 62)]).view(kind)
        base = np.cumsum(m) - m
        first = at // length
        doc, rank = tc.spread((at + m - 1) // length - first + 1)
        seq = first[doc] + rank
        a = np.maximum(seq * length, at[doc])
        size = np.minimum((seq + 1) * length, (at + m)[doc]) - a
        source = base[doc] + a - at[doc]
        slot = feistel(seq, n, key)
        shard, part = slot // per_shard, slot % per_shard // PART
        order = np.lexsort([part, shard])
        shard, part = shard[order], part[order]
        cuts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])]))
        bodies = []
        for x, y in zip(cuts, [*cuts[1:], len(order)], strict=True):
            o = order[x:y]
            group, rank = tc.spread(size[o])
            bodies.append(_packed(slot[o], seq[o], a[o] - seq[o] * length, size[o], ids[doc[o]], known[doc[o]], flat[source[o][group] + rank]))
        return pa.RecordBatch.from_arrays([pa.array(shard[cuts], pa.int32()), pa.array(part[cuts], pa.int32()), pa.array(bodies, pa.binary())], ["shard", "part", "body"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PACK_BYTES:
                yield packs(held)
                held, size = [], 0
        if held:
            yield packs(held)

    dealt = map_arrow(rows, cut, "shard int, part int, body binary").repartitionById(shards, "shard").sortWithinPartitions("shard", "part")
    return dealt, n, kind, end


def _parts(batches: Iterator[pa.RecordBatch], n: int, kind: np.dtype, end: int, length: int, per_shard: int, slots: int) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """For each part (of so many ``slots``) of a shard its number, the tokens of its slots, a row each, and their index."""

    def closed(now: tuple[int, int], bodies: list[bytes]) -> tuple[int, np.ndarray, pa.RecordBatch]:
        first = now[0] * per_shard + now[1] * slots
        count = min(n, (now[0] + 1) * per_shard, first + slots) - first
        out = np.full(count * length, end, dtype=kind)
        fields: list[tuple] = []
        for body in bodies:
            slot, seq, start, size, doc, known, tokens = _unpacked(body, kind)
            group, rank = tc.spread(size)
            out[((slot - first) * length + start)[group] + rank] = tokens
            fields.append((slot, seq, start, doc, known))
        slot, seq, start, doc, known = (np.concatenate(x) for x in zip(*fields, strict=True))
        order = np.lexsort([start, slot])
        slot, seq, start, doc, known = (x[order] for x in (slot, seq, start, doc, known))
        heads = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        if len(heads) != count:
            raise RuntimeError(f"shard {now[0]} lacks {count - len(heads)} of its sequences")
        offsets = pa.array(np.append(heads, len(slot)), pa.int32())
        index = [
            pa.array(slot[heads]), pa.array(np.full(count, now[0], np.int32)), pa.array((slot[heads] - now[0] * per_shard).astype(np.int32)), pa.array(seq[heads]),
            pa.ListArray.from_arrays(offsets, pa.array(doc, pa.int64(), mask=~known)), pa.ListArray.from_arrays(offsets, pa.array(start, pa.int32())),
        ]
        return now[0], out.reshape(count, length), pa.RecordBatch.from_arrays(index, ["slot", "shard", "row", "sequence", "doc_ids", "starts"])

    now, held = None, []
    for batch in batches:
        for shard, part, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if held and (shard, part) != now:
                yield closed(now, held)
                held = []
            now = (shard, part)
            held.append(body)
    if held:
        yield closed(now, held)


_INDEX = "slot long, shard int, row int, sequence long, doc_ids array<long>, starts array<int>"


def materialised(docs: DataFrame, path: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """The corpus in training order, a row a sequence: slot, shard, row, sequence, doc_ids and the tokens (starts) at which
    each one's piece begins, and tokens, always ``length`` ids. Partition p holds shard p, sorted by slot."""
    dealt, n, kind, end = _dealt(docs, path, length, per_shard, key)
    slots = PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, index in _parts(batches, n, kind, end, length, per_shard, slots):
            for k in range(0, len(rows), 1024):
                some = index.slice(k, 1024)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([r.tobytes() for r in rows[k : k + 1024]], pa.binary())], [*index.schema.names, "tokens"])

    return map_arrow(dealt, run, f"{_INDEX}, tokens binary")


def write_shards(docs: DataFrame, to: str, path: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> None:
    """One raw little-endian file a shard in ``to``/shards, tokens in the order of their slots and nothing else, so that
    slot s is at byte (s % per_shard) * stride of shard s // per_shard; the last shard ends with the last slot. What
    materialised() gives beside them goes with the stride to a table, ``to``/index. A shard is written under a name of its
    own and renamed, so a repeated task replaces it. ``to`` is mounted by all executors."""
    dealt, n, kind, end = _dealt(docs, path, length, per_shard, key)
    folder, stride, slots = _local(to), length * kind.itemsize, PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(f"{folder}/shards", exist_ok=True)
        shard, temporary, out = None, "", None
        try:
            for number, rows, index in _parts(batches, n, kind, end, length, per_shard, slots):
                if number != shard:
                    if out is not None:
                        out.close()
                        os.replace(temporary, _shard(folder, shard))
                    shard, temporary = number, f"{folder}/shards/.{number}-{uuid.uuid4().hex}"
                    out = open(temporary, "wb")  # noqa: SIM115
                out.write(rows.data)
                yield pa.RecordBatch.from_arrays([*index.columns, pa.array(np.full(len(rows), stride, np.int32))], [*index.schema.names, "stride"])
            if out is not None:
                out.close()
                os.replace(temporary, _shard(folder, shard))
                out = None
        finally:
            if out is not None:
                out.close()
                os.unlink(temporary)

    map_arrow(dealt, run, f"{_INDEX}, stride int").write.parquet(f"{to}/index")


def _local(path: str) -> str:
    """The folder as executors open it; raw files need a mounted one."""
    folder = re.sub("^file:(//(?=/))?", "", path)
    if not folder.startswith("/"):
        raise ValueError(f"{path} isn't a mounted folder, which raw shards need")
    return folder


def _shard(folder: str, shard: int) -> str:
    return f"{folder}/shards/{shard:06d}.bin"


def _with_tokens(index: DataFrame, path: str) -> DataFrame:
    """Rows of the index with the tokens of their slots, read from the shards."""
    folder = _local(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, rows, strides = (batch.column(k).to_pylist() for k in (1, 2, 6))
            bodies: list[bytes] = []
            opened, file = None, None
            try:
                for shard, row, stride in zip(shards, rows, strides, strict=True):
                    if shard != opened:
                        if file is not None:
                            file.close()
                        opened, file = shard, open(_shard(folder, shard), "rb")  # noqa: SIM115
                    file.seek(row * stride)
                    bodies.append(file.read(stride))
                    if len(bodies[-1]) != stride:
                        raise OSError(f"{_shard(folder, shard)} is shorter than its index")
            finally:
                if file is not None:
                    file.close()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), pa.array(bodies, pa.binary())], ["slot", "shard", "row", "sequence", "doc_ids", "starts", "tokens"])

    return map_arrow(index, run, "slot long, shard int, row int, sequence long, doc_ids array<long>, starts array<int>, tokens binary")


def stored(docs: DataFrame, **options) -> DataFrame:
    """materialised(docs), written as shards to the shared folder and read from them."""
    spark = docs.sparkSession
    path = f"{_tables(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, **options)
    return _with_tokens(spark.read.parquet(f"{path}/index"), path)


def read_from(spark: SparkSession, path: str, slot: int, per_shard: int = PER_SHARD, until: int | None = None) -> DataFrame:
    """Sequences from ``slot`` on (below ``until``), in order; earlier shards aren't opened, other slots are skipped."""
    rows = spark.read.parquet(f"{path}/index").where((F.col("shard") >= slot // per_shard) & (F.col("slot") >= slot))
    if until is not None:
        rows = rows.where((F.col("shard") <= (until - 1) // per_shard) & (F.col("slot") < until))
    return _with_tokens(rows, path).orderBy("slot")
