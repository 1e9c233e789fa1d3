"""Removal of passages that repeat anywhere in the corpus, whatever the documents' borders.

A window is ``window`` consecutive words of one document; a word goes if a window that covers it starts anywhere else
too. Every window is judged on the input.

How: each slice of some megabytes of text fingerprints its windows (64 bits), keeps each fingerprint once, sorted, and
sends it to the bucket of its leading bits as one packed row a bucket. A bucket finds the fingerprints that more than one
slice has sent and answers each slice with a bit string. The slice, shipped once to where the answers meet, makes its
fingerprints anew, reads off which are repeated (those that repeat within it, it knows itself), and joins the windows to
maximal spans. Rows of the shuffle are 8 bytes a distinct window of a slice; a passage that a third of all documents
share is one fingerprint a slice, so no bucket grows with the size of a group of copies.

Two different windows with equal fingerprints would be taken for repeats; that has probability n / 2**64 for each of n
windows. Input has to be deterministic from read to read (files, or a written table): slices are matched by their
content, and one that isn't found again stops the run.

A null text has no words. Repeated rows count as separate places: a text that occurs twice is removed whole if it has a
window. Shorter texts are never touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from sgspark.llm import textcore as tc
from sgspark.llm.runtime import map_arrow, partitions

WINDOW = 35
SLICE_BYTES = 2_000_000
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def _windows(s: tc.Slice, window: int):
    """Starts and ends of words, first words of texts, places of windows, and their distinct fingerprints (with inverse
    and counts)."""
    a, b, first = s.words(tc.NOT_SPACE)
    h = tc.ngram_hashes(tc.word_hashes(s.data, a, b), window)
    doc = np.repeat(np.arange(len(s)), np.diff(first))
    at = np.flatnonzero(doc[: len(h)] == doc[window - 1 : window - 1 + len(h)]) if len(h) else np.zeros(0, np.int64)
    return a, b, first, at, *np.unique(h[at], return_inverse=True, return_counts=True)


def _edges(distinct: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(distinct >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _name(s: tc.Slice) -> bytes:
    return hashlib.blake2b(s.data.tobytes() + s.offsets.tobytes(), digest_size=16).digest()


def _kept(s: tc.Slice, a: np.ndarray, b: np.ndarray, first: np.ndarray, gone: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space, for each text."""
    stay = np.flatnonzero(~gone)
    doc = np.searchsorted(first, stay, side="right") - 1
    lead = np.ones(len(stay), dtype=np.int64)
    lead[:1] = 0
    lead[1:][doc[1:] != doc[:-1]] = 0
    size = b[stay] - a[stay] + lead
    word, rank = tc.spread(size)
    from_ = a[stay][word] + rank - lead[word]
    flat = s.data[np.maximum(from_, 0)] if len(word) else np.zeros(0, np.uint8)
    flat[rank < lead[word]] = 0x20
    offsets = np.zeros(len(s) + 1, dtype=np.int64)
    np.add.at(offsets, doc + 1, size)
    return pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(np.cumsum(offsets).tobytes()), pa.py_buffer(flat.tobytes()))


def deduplicated(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed, removed (maximal spans of words) and kept (the other words, joined by one space).
    Columns of docs with these names are replaced; all rows and other columns stay."""
    parts = partitions(docs.sparkSession)
    bits = max(6, (4 * parts - 1).bit_length())
    made = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("removed", SPANS), StructField("kept", StringType())])
    fields = [f for f in docs.schema if f.name not in made.names]
    docs = docs.select(*[f"`{f.name}`" for f in fields])
    at_text = docs.columns.index(text)
    out_schema = StructType(fields + made.fields)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tc.slices(batch.column(at_text), SLICE_BYTES):
                name = _name(s)
                distinct = _windows(s, window)[4]
                edges = _edges(distinct, bits)
                full = np.flatnonzero(np.diff(edges))
                flat = memoryview(distinct.tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.append(full, name[0] % (1 << bits)).astype(np.int32)),
                    pa.array([name] * (len(full) + 1), pa.binary()),
                    pa.array([bytes(flat[8 * edges[i] : 8 * edges[i + 1]]) for i in full] + [None], pa.binary()),
                ], ["bucket", "name", "body"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each slice's fingerprints in a bucket a bit string, if any is repeated; bucket -1 says that a slice was there."""
        held: list[tuple[bytes, np.ndarray]] = []
        now = -1

        def close() -> list[tuple[int, bytes, bytes | None]]:
            every = np.sort(np.concatenate([x for _, x in held])) if held else np.zeros(0, np.uint64)
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            out = []
            for name, x in held if len(twice) else ():
                hit = twice[np.minimum(np.searchsorted(twice, x), len(twice) - 1)] == x
                if hit.any():
                    out.append((now, name, np.packbits(hit).tobytes()))
            held.clear()
            return out

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "name", "body"])

        for b in batches:
            rows: list[tuple[int, bytes, bytes | None]] = []
            for bucket, name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if bucket != now:
                    rows += close()
                    now = bucket
                if body.is_valid:
                    held.append((name, np.frombuffer(body.as_buffer(), dtype=np.uint64)))
                else:
                    rows.append((-1, name, None))
            if rows:
                yield batch(rows)
        if rows := close():
            yield batch(rows)

    def shipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))
        for batch in batches:
            for s in tc.slices(batch.column(at_text), SLICE_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch.slice(s.first, len(s)))
                yield pa.RecordBatch.from_arrays([pa.array([1 << bits], pa.int32()), pa.array([_name(s)], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "name", "body"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out_schema)
        now, known, answers = b"", False, {}
        for b in batches:
            for i in range(b.num_rows):
                bucket, name = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if name != now:
                    now, known, answers = name, False, {}
                if bucket == -1:
                    known = True
                    continue
                body = b.column(2)[i].as_buffer()
                if bucket < 1 << bits:
                    answers[bucket] = body
                    continue
                if not known:
                    raise RuntimeError("a slice of the input differs from read to read; write the input as a table first")
                table = pa.ipc.open_stream(body).read_all().combine_chunks()
                rows = table.to_batches()[0]
                s = next(tc.slices(rows.column(at_text), 1 << 62))
                a, e, first, at, distinct, inverse, counts = _windows(s, window)
                hit = counts > 1
                edges = _edges(distinct, bits)
                for k, x in answers.items():
                    size = edges[k + 1] - edges[k]
                    hit[edges[k] : edges[k + 1]] |= np.unpackbits(np.frombuffer(x, np.uint8), count=size).astype(bool)
                change = np.zeros(len(a) + 1, dtype=np.int64)
                repeated = at[hit[inverse.ravel()]]
                np.add.at(change, repeated, 1)
                np.add.at(change, repeated + window, -1)
                gone = np.cumsum(change)[:-1] > 0
                doc = np.repeat(np.arange(len(s)), np.diff(first))
                edge = np.ones(len(gone), dtype=bool)
                edge[1:] = (gone[1:] != gone[:-1]) | (doc[1:] != doc[:-1])
                heads = np.flatnonzero(edge)
                tails = np.append(heads[1:], len(gone)) if len(heads) else heads
                mine = gone[heads]
                heads, tails = heads[mine], tails[mine]
                of = doc[heads]
                base = first[of]
                n_spans = np.searchsorted(of, np.arange(len(s) + 1))
                spans = pa.ListArray.from_arrays(pa.array(n_spans, pa.int32()), pa.StructArray.from_arrays([pa.array(heads - base, pa.int32()), pa.array(tails - base, pa.int32())], ["start", "end"]))
                removed = np.zeros(len(gone) + 1, dtype=np.int64)
                np.cumsum(gone, out=removed[1:])
                columns = [*rows.columns, pa.array(np.diff(first)), pa.array(removed[first[1:]] - removed[first[:-1]]), spans, _kept(s, a, e, first, gone)]
                done = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                yield from (done.slice(k, 500) for k in range(0, done.num_rows, 500))

    fields3 = "bucket int, name binary, body binary"
    fingerprints = map_arrow(docs, sent, fields3).repartition(parts, "bucket").sortWithinPartitions("bucket")
    both = map_arrow(fingerprints, answered, fields3).unionAll(map_arrow(docs, shipped, fields3))
    return map_arrow(both.repartition(parts, "name").sortWithinPartitions("name", "bucket"), cut, out_schema)
