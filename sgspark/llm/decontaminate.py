"""Benchmark decontamination: suffix arrays of training shards, searched for every suffix of the benchmark.

A shard is some megabytes of consecutive texts of one Arrow batch. Its suffixes (word positions, ordered by the words
that follow, as deep as a window is long) are sorted once; every suffix of a benchmark item is then found by binary
search on its first words, which gives all places of its windows at once. Windows of one item that follow each other
on both sides are joined to the longest verbatim matches. Suffixes that don't begin with words that begin a
benchmark suffix can't be found by any search, so the array leaves them out (a bit table of n-gram hashes; it has no
false negatives).

The benchmark is dealt by a hash into blocks of about BLOCK_WORDS words. Tasks sort each block's suffixes and write them
to the shared folder; a worker that searches its shards loads one block at a time, so neither it nor the driver holds
more of the benchmark, whatever its size. Texts aren't shuffled.

Nulls have no words; items without words match nothing; an item with a null id can hit words but isn't listed.
Repeated ids of items count once. An empty benchmark hits nothing, an empty table gives no rows. Repeated and tied documents are judged each for itself.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sgspark.llm import textcore as tc
from sgspark.llm.runtime import Guarded, _tables, got, map_arrow, put

WINDOW = 10
#: Words of the benchmark that a block may hold (about 250 bytes each).
BLOCK_WORDS = 200_000
SHARD_BYTES = 4_000_000
MATCH = "array<struct<item:string,start:int,length:int,item_start:int>>"


class Block:
    """The suffixes of some items: their first ``window`` words (fewer for short items), sorted and distinct."""

    def __init__(self, ids: list[str | None], texts: pa.Array, window: int):
        rows, item, start, size = [np.zeros((0, window), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in tc.slices(texts):
            data = tc.LOWER[s.data]
            a, b, first = s.words(tc.ALNUM, data)
            h = tc.word_hashes(data, a, b)
            m = np.minimum(np.diff(first), window)
            of, rank = tc.spread(np.where(m > 0, np.diff(first) - m + 1, 0))
            places = (first[of] + rank)[:, None] + np.arange(window)
            inside = np.arange(window) < m[of][:, None]
            rows.append(np.where(inside, h[np.minimum(places, max(0, len(h) - 1))], np.uint64(0)) if len(h) else rows[0])
            item.append(s.first + of)
            start.append(rank)
            size.append(m[of])
        self.ids = ids
        keyed = np.column_stack([np.concatenate(rows), np.concatenate(size).astype(np.uint64)])
        distinct, inverse = np.unique(keyed, axis=0, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        self.rows, self.size = distinct[:, :window], distinct[:, window].astype(np.int64)
        self.first = np.searchsorted(inverse.ravel()[order], np.arange(len(distinct) + 1))
        self.item, self.start = np.concatenate(item)[order], np.concatenate(start)[order]
        self.gram = int(self.size.min(initial=3)) if len(self.size) else 0
        self.bits = np.zeros(1 << 20, dtype=bool)
        if self.gram:
            self.bits[_row_grams(self.rows, self.gram)] = True


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    return (tc.ngram_hashes(words, n) >> np.uint64(44)).astype(np.int64)


def _row_grams(rows: np.ndarray, n: int) -> np.ndarray:
    """_grams of the first n words of each row."""
    every = _grams(np.ascontiguousarray(rows).ravel(), n)
    return every[np.arange(len(rows)) * rows.shape[1]]


def _bounds(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """Vectorised binary search for each value within its own sorted part column[lo:hi]."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        live = lo < hi
        if not live.any():
            return lo
        mid = (lo + hi) >> 1
        at = column[np.minimum(mid, len(column) - 1)]
        up = live & ((at <= value) if right else (at < value))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(live & ~up, mid, hi)


def shard_matches(s: tc.Slice, block: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longest matches (text, word, length, item, word in item), and the numbers of each text's first words."""
    data = tc.LOWER[s.data]
    a, b, first = s.words(tc.ALNUM, data)
    none = np.zeros(0, np.int64)
    if not block.gram or len(a) < block.gram:
        return none, none, none, none, none, first
    w = tc.word_hashes(data, a, b)
    at = np.flatnonzero(block.bits[_grams(w, block.gram)])
    if not len(at):
        return none, none, none, none, none, first
    doc = np.repeat(np.arange(len(s)), np.diff(first))
    end = first[1:][doc[at]]
    places = at[:, None] + np.arange(window)
    keys = np.where(places < end[:, None], w[np.minimum(places, len(w) - 1)], np.uint64(0))
    order = np.lexsort(keys.T[::-1])  # the suffix array
    keys, at = keys[order], at[order]
    lo, hi = np.zeros(len(block.rows), np.int64), np.full(len(block.rows), len(at))
    live = np.arange(len(block.rows))
    for j in range(window):
        live = live[(lo[live] < hi[live]) & (block.size[live] > j)]
        if not len(live):
            break
        column, value = np.ascontiguousarray(keys[:, j]), block.rows[live, j]
        left = _bounds(column, lo[live], hi[live], value, False)
        hi[live] = _bounds(column, left, hi[live], value, True)
        lo[live] = left
    found = np.flatnonzero(lo < hi)
    group, rank = tc.spread(hi[found] - lo[found])
    row, place = found[group], at[lo[found][group] + rank]
    fits = place + block.size[row] <= first[1:][doc[place]]
    row, place = row[fits], place[fits]
    group, rank = tc.spread(block.first[row + 1] - block.first[row])
    of = block.first[row][group] + rank
    d, p, item, q, m = doc[place[group]], place[group] - first[doc[place[group]]], block.item[of], block.start[of], block.size[row[group]]
    order = np.lexsort([p, p - q, item, d])
    d, p, item, q, m = d[order], p[order], item[order], q[order], m[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | ((p - q)[1:] != (p - q)[:-1]) | (p[1:] != p[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(d)) - 1 if len(heads) else heads
    return d[heads], p[heads], p[tails] + m[tails] - p[heads], item[heads], q[heads], first


def _covered(doc: np.ndarray, start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the number of words inside any of its spans."""
    out = np.zeros(n, dtype=np.int64)
    if len(doc):
        far = int((start + length).max()) + 1
        order = np.lexsort([start, doc])
        doc, a, b = doc[order], (doc * far + start)[order], (doc * far + start + length)[order]
        before = np.concatenate([[0], np.maximum.accumulate(b)[:-1]])
        np.add.at(out, doc, np.maximum(0, b - np.maximum(a, before)))
    return out


class Blocks:
    """The benchmark in files of the shared folder, of which a worker holds one at a time."""

    def __init__(self, folder: str, count: int):
        self.folder, self.count = folder, count

    def __iter__(self) -> Iterator[Block]:
        for i in range(self.count):
            at = f"{self.folder}/{i}"
            if at not in _loaded:
                _loaded.clear()
                _loaded[at] = pickle.loads(got(at))
            yield _loaded[at]


#: The block that a worker holds.
_loaded: dict[str, Block] = {}


def blocks_of(benchmark: DataFrame, window: int) -> Blocks:
    """Written blocks of about BLOCK_WORDS words (or one item), each made by a task; items are dealt by a hash."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-(words // 2) // BLOCK_WORDS))
    at = f"{_tables(spark)}/benchmark-{uuid.uuid4().hex}"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [b for b in batches if b.num_rows]
        ids = [x for b in rows for x in b.column(0).to_pylist()]
        texts = pa.concat_arrays([b.column(1) for b in rows]) if rows else pa.array([], pa.string())
        number = TaskContext.get().partitionId()
        put(f"{at}/{number}", pickle.dumps(Block(ids, texts, window), protocol=5))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32())], ["block"])

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count)).cast("int")).repartitionById(count, "block").sortWithinPartitions("item", "text")
    map_arrow(dealt, build, "block int").count()
    return Blocks(at, count)


def _joined(docs: DataFrame, benchmark: DataFrame, text: str, window: int, made: StructType, make) -> DataFrame:
    """docs with the columns ``made`` that make(slice, matches of all blocks) computes. Some slices are held at a time, more
    of them if there are many blocks, as each block is loaded once for all of them."""
    blocks = blocks_of(benchmark, window)
    at = docs.columns.index(text)
    kept = [i for i, c in enumerate(docs.columns) if c not in made.names]
    schema = StructType([docs.schema[i] for i in kept] + made.fields)
    hold = SHARD_BYTES * min(8, blocks.count)

    def found(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        slices = [(k, s) for k, b in enumerate(batches) for s in tc.slices(b.column(at), SHARD_BYTES)]
        hits: list[list[tuple]] = [[] for _ in slices]
        for block in blocks:
            for k, (_, s) in enumerate(slices):
                d, p, n, item, q, first = shard_matches(s, block, window)
                hits[k].append((d, p, n, pa.array(block.ids, pa.string()).take(pa.array(item)), q, first))
        for k, batch in enumerate(batches):
            parts = [make(s, hits[i]) for i, (of, s) in enumerate(slices) if of == k]
            if parts:
                new = [pa.concat_arrays([x[i].cast(out.field(len(kept) + i).type) for x in parts]) for i in range(len(made))]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + new, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= hold:
                yield from found(held)
                held, size = [], 0
        yield from found(held)

    return map_arrow(docs, run, schema)


def matched(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit (words inside any match) and matches: the longest verbatim matches with the benchmark,
    as (item, start, length, item_start) in words. Columns of docs with these names are replaced."""

    def make(s: tc.Slice, hits: list[tuple]) -> list[pa.Array]:
        d, p, n, q = (np.concatenate([h[i] for h in hits]) for i in (0, 1, 2, 4))
        item = pa.concat_arrays([h[3] for h in hits])
        order = np.argsort(d, kind="stable")
        spans = pa.StructArray.from_arrays([item.take(pa.array(order)), *(pa.array(x[order], pa.int32()) for x in (p, n, q))], ["item", "start", "length", "item_start"])
        offsets = pa.array(np.searchsorted(d[order], np.arange(len(s) + 1)), pa.int32())
        return [pa.array(np.diff(hits[0][5])), pa.array(_covered(d, p, n, len(s))), pa.ListArray.from_arrays(offsets, spans)]

    return _joined(docs, benchmark, text, window, StructType.fromDDL(f"n_words long, n_hit long, matches {MATCH}"), make)


def report(found: DataFrame) -> DataFrame:
    """matched() with n_items, items_sha256 and contaminated in place of the matches."""
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"]), lambda i: i.isNotNull())))
    return found.withColumns({"n_items": F.size(items).cast("long"), "items_sha256": F.sha2(F.concat_ws(",", items), 256), "contaminated": F.col("n_hit") > 0}).drop("matches")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows and columns of docs in which no window of the benchmark occurs."""
    own = Guarded(docs)

    def make(s: tc.Slice, hits: list[tuple]) -> list[pa.Array]:
        hit = np.zeros(len(s), dtype=bool)
        for h in hits:
            hit[h[0]] = True
        return [pa.array(hit)]

    return own.restored(_joined(own.rows, benchmark, own[text], window, StructType.fromDDL("hit boolean"), make).where("not hit"))
