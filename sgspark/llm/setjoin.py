"""Similarity self-join of texts by the Jaccard coefficient of their shingles: MinHash LSH forest, exact verification.

1. Equal texts are one unit, with their number, the smallest id and the smallest ``order`` among them; a unit has a
   signature of trees x deepest minima. Only hashes of texts are grouped; texts themselves are fetched by id, later and
   for candidates only.
2. Forest. Each tree is the sorted list of its part of the signatures. Texts that share a prefix become candidates. The
   matched prefix starts at its full length and is shortened as long as a pair at the threshold would be found with
   probability 1 - (1 - t**depth)**trees < ``recall``, and, with ``audit``, as long as the recall that an audit measures
   is below it: while signatures are made, AUDITED texts (the smallest keys) meet every text exactly, and
   each true link is counted under the longest prefix that its two texts share in any tree. Within a map task, texts of a
   prefix are chained and only one of them is sent on, so a prefix that a third of all texts share is one row a task.
3. Candidates that hang together make a group; a group is dealt out in blocks, and every two blocks meet in one tile, as
   large as a task can hold. Texts of one group meet whatever the group's size, and no pair of texts is ever a row. Which
   block a text is in is worked out on thin rows; texts go straight to their tiles.
4. A tile makes the intersections: shingles that few texts hold by counting, the others by products of 0/1
   matrices. Shingles are compared by 64-bit hashes, of which a tile uses all but the bits that number its texts (11 at
   most), so two of a million different shingles of a tile are taken for one with probability 1e-4 or less. It gives each text the number of its
   partners (counted with copies) and a spanning forest of the links.

Texts of no shingle link with nothing, not even with their copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sgspark.llm import textcore as tc
from sgspark.llm import runtime
from sgspark.llm.runtime import appended, components, contracted, dropped, forest, looked_up, map_arrow, partitions, written

#: A block of a group holds about so many texts or shingles.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 250_000
#: Shingles of at most so many texts of a tile are counted pair by pair; columns of a matrix product.
RARE, COLUMNS = 8, 2048
#: Groups of at most so many texts are compared together, as many groups as make so many bytes.
SMALL, SMALL_BYTES = 8, 500_000
#: Bytes of a text's row beside the text.
ROW_BYTES = 40
#: Texts that an audit compares with all others: the smallest keys among those of at most so many shingles.
AUDITED, AUDIT_SHINGLES = 256, 8192


def word_shingles(n: int) -> Callable:
    """Hashes of n words [^\\x20\\x09-\\x0D]+ in a row (all words of a shorter text, if any), and each text's first."""

    def make(s: tc.Slice) -> tuple[np.ndarray, np.ndarray]:
        a, b, first = s.words(tc.NOT_SPACE)
        return _runs(lambda k: tc.ngram_hashes(tc.word_hashes(s.data, a, b), k), first, n)

    return make


def char_shingles(n: int) -> Callable:
    """Hashes of n characters in a row (all of a shorter text, if any), and each text's first."""

    def make(s: tc.Slice) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(s.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        heads = np.zeros(len(s.data) + 1, dtype=np.int32)
        np.cumsum((s.data & 0xC0) != 0x80, out=heads[1:])
        return _runs(lambda k: tc.mix(_folded(points, k) + np.uint64(k)), heads[s.offsets].astype(np.int64), n)

    return make


def _folded(values: np.ndarray, n: int) -> np.ndarray:
    """A polynomial of each n values in a row, by halves."""
    if n == 1:
        return values
    half = n // 2
    left = _folded(values, half)
    right = left if n == 2 * half else _folded(values, n - half)
    count = max(0, len(values) - n + 1)
    return left[:count] * np.uint64(0xD1342543DE82EF95 + 2 * n) + right[half : half + count]


def _runs(hashes: Callable, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(first)
    few = (counts > 0) & (counts < n)
    size = np.where(counts >= n, counts - n + 1, few)
    offsets = np.concatenate([[0], np.cumsum(size)])
    starts = np.ones(first[-1], dtype=bool)
    for k in range(1, n):  # the last n - 1 places of a text start no run
        at = first[1:] - k
        starts[at[at >= first[:-1]]] = False
    h = hashes(n)
    h = h[starts[: len(h)]]
    if not few.any():
        return h, offsets
    out, whole = np.empty(offsets[-1], np.uint64), np.ones(offsets[-1], dtype=bool)
    whole[offsets[:-1][few]] = False
    out[whole] = h
    for m in np.unique(counts[few]):
        at = few & (counts == m)
        out[offsets[:-1][at]] = hashes(int(m))[first[:-1][at]]
    return out, offsets


def signatures(shingles: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """k minima of 32 bits for each text; texts without shingles get zeros."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, k), dtype=np.uint32)
    if len(full):
        h = (shingles >> np.uint64(32)).astype(np.uint32)
        starts = offsets[full]
        multipliers = (tc.keys(31, k) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        shifts = tc.keys(37, k).astype(np.uint32)
        x = np.empty_like(h)
        for i in range(k):
            np.bitwise_xor(h, shifts[i], out=x)
            np.multiply(x, multipliers[i], out=x)
            out[full, i] = np.minimum.reduceat(x, starts)
    return out


def found_share(similarity: np.ndarray, depth: int, trees: int) -> np.ndarray:
    return 1 - (1 - similarity**depth) ** trees


def depth_for(threshold: float, trees: int, deepest: int, recall: float, met: np.ndarray) -> int:
    """The longest prefix at which a pair at the threshold is found with probability ``recall``, and with which the audit
    finds that share of its links; met: how many of them share no longer prefix than 0, 1, ... in any tree."""
    depth = deepest
    while depth > 1 and (found_share(np.float64(threshold), depth, trees) < recall or met[depth:].sum() < recall * met.sum()):
        depth -= 1
    return depth


class Audit:
    """A few texts by their shingles, to be compared exactly with every text of the join."""

    def __init__(self, rows: list[tuple[bytes, bytes, bytes]], trees: int, deepest: int):
        """rows: digest, shingles and signature of each text."""
        self.trees, self.deepest = trees, deepest
        self.names = [r[0] for r in rows]
        sets = [np.unique(np.frombuffer(r[1], np.uint64)) for r in rows]
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        self.sig = np.array([np.frombuffer(r[2], np.uint32) for r in rows], dtype=np.uint32).reshape(len(rows), trees, deepest)
        every = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(every, kind="stable")
        self.of = np.repeat(np.arange(len(rows)), self.size)[order]
        self.known, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self.known >> np.uint64(44)] = True

    def met(self, s: tc.Slice, shingles: np.ndarray, offsets: np.ndarray, sig: np.ndarray, threshold: Fraction) -> list[list[int] | None]:
        """For each text of a slice how many of its links with audited texts share at most 0, 1, ... minima in any tree."""
        out: list[list[int] | None] = [None] * len(s)
        at = np.flatnonzero(self.bits[shingles >> np.uint64(44)])
        place = np.searchsorted(self.known, shingles[at]) if len(self.known) else at[:0]
        same = self.known[np.minimum(place, len(self.known) - 1)] == shingles[at] if len(place) else np.zeros(0, bool)
        text = np.searchsorted(offsets, at[: len(place)][same], side="right") - 1
        code = np.unique(text * max(1, len(self.known)) + place[same])
        text, place = code // max(1, len(self.known)), code % max(1, len(self.known))
        group, rank = tc.spread(self.count[place])
        pair, inter = np.unique(text[group] * max(1, len(self.size)) + self.of[self.first[place][group] + rank], return_counts=True)
        text, audited = pair // max(1, len(self.size)), pair % max(1, len(self.size))
        able = inter * threshold.denominator >= self.size[audited] * threshold.numerator
        sizes: dict[int, int] = {}
        for t, a, both in zip(text[able].tolist(), audited[able].tolist(), inter[able].tolist(), strict=True):
            if t not in sizes:
                sizes[t] = len(np.unique(shingles[offsets[t] : offsets[t + 1]]))
            union = int(self.size[a]) + sizes[t] - both
            if both * threshold.denominator < union * threshold.numerator or (both == union and _digest(s, t) == self.names[a]):
                continue
            prefix = np.cumprod(sig[t].reshape(self.trees, self.deepest) == self.sig[a], axis=1).sum(axis=1).max()
            out[t] = out[t] or [0] * (self.deepest + 1)
            out[t][int(prefix)] += 1
        return out


def _digest(s: tc.Slice, i: int) -> bytes:
    return hashlib.blake2b(s.data[s.offsets[i] : s.offsets[i + 1]].tobytes(), digest_size=16).digest()


def sample(rows: DataFrame, places: DataFrame, shingler: Callable, trees: int, deepest: int) -> Audit:
    """The texts to audit. Longer ones than AUDIT_SHINGLES aren't sampled (they are audited as partners)."""
    few = places.groupBy("key").agg(F.min("id").alias("id")).orderBy("key").limit(AUDITED).select("id")

    def make(s: tc.Slice):
        h, offsets = shingler(s)
        sig = signatures(h, offsets, trees * deepest)
        some = [0 < offsets[i + 1] - offsets[i] <= AUDIT_SHINGLES for i in range(len(s))]
        return [
            [_digest(s, i) if ok else None for i, ok in enumerate(some)],
            [h[offsets[i] : offsets[i + 1]].tobytes() if ok else None for i, ok in enumerate(some)],
            [sig[i].tobytes() if ok else None for i, ok in enumerate(some)],
        ]

    got = appended(rows.join(F.broadcast(few), "id").select("text"), "text", make, "name binary, shingles binary, sig binary").where("name is not null").select("name", "shingles", "sig")
    return Audit([(bytes(r[0]), bytes(r[1]), bytes(r[2])) for r in got.collect()], trees, deepest)


def prefixes(sig: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the first ``depth`` minima of each tree; sig: (texts, trees, minima)."""
    p = np.broadcast_to(tc.keys(41, sig.shape[1]), sig.shape[:2]).copy()
    for d in range(depth):
        p = tc.mix(p ^ sig[:, :, d].astype(np.uint64))
    return p


def units(rows: DataFrame, places: DataFrame, shingler: Callable, trees: int, deepest: int, threshold: Fraction, audit: Audit | None = None, depth: int = 0) -> DataFrame:
    """Written table of the distinct texts: uid (the smallest id of a row of the text), key, mult, first, n, sig, met. Where
    the depth is known, sig holds the prefixes' hashes in place of the minima."""
    shared = rows.sparkSession.sparkContext.broadcast(audit) if audit else None
    k = trees * deepest

    def make(s: tc.Slice):
        h, offsets = shingler(s)
        sig = signatures(h, offsets, k)
        met = shared.value.met(s, h, offsets, sig, threshold) if shared else [None] * len(s)
        flat = prefixes(sig.reshape(len(s), trees, deepest), depth).tobytes() if depth else sig.tobytes()
        size = len(flat) // len(s)
        return [np.diff(offsets), [flat[i * size : (i + 1) * size] for i in range(len(s))], met]

    signed = appended(rows.select("id", "text"), "text", make, "n long, sig binary, met array<int>").select(F.col("id").alias("uid"), "n", "sig", "met")
    texts = places.groupBy("key").agg(F.count("*").alias("mult"), F.min("order").alias("first"), F.min("id").alias("uid"))
    return written(texts.join(signed, "uid"), "units")


def audited(table: DataFrame, deepest: int) -> np.ndarray:
    """Links of the audited texts by the longest prefix that they share in any tree, over all units."""
    sums = table.where("met is not null").agg(*[F.sum(F.col("met")[i].cast("long")) for i in range(deepest + 1)]).first()
    return np.array([x or 0 for x in sums], dtype=np.int64)


def candidates(table: DataFrame, trees: int, deepest: int, depth: int, hashed: bool = False) -> DataFrame:
    """A forest of edges (a, b) that connects all units sharing a prefix of ``depth`` in any tree. hashed: sig holds the
    prefixes' hashes."""

    def heads_of(sigs: pa.Array) -> np.ndarray:
        raw = b"".join(sigs.to_pylist())
        if hashed:
            return np.frombuffer(raw, dtype=np.uint64).reshape(len(sigs), trees)
        return prefixes(np.frombuffer(raw, dtype=np.uint32).reshape(len(sigs), trees, deepest), depth)

    def chained(p: np.ndarray, uid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The sorted trie: neighbours that share the prefix, and the first unit of each prefix."""
        order = np.lexsort([uid, p])
        p, uid = p[order], uid[order]
        same = p[1:] == p[:-1]
        heads = np.concatenate([[True], ~same])
        return uid[:-1][same], uid[1:][same], p[heads], uid[heads]

    parts = partitions(table.sparkSession)
    bits = max(6, (4 * parts - 1).bit_length())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the units at hand, edges inside prefixes (bucket -1), and a packed row (prefix, first unit) a bucket."""
        for batch in batches:
            if not batch.num_rows:
                continue
            p = heads_of(batch.column(1))
            a, b, heads, first = chained(p.ravel(), np.repeat(batch.column(0).to_numpy(), trees))
            cuts = np.searchsorted(heads >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cuts))
            flat = memoryview(np.column_stack([heads, first.astype(np.uint64)]).tobytes())
            buckets, bodies = full.tolist(), [bytes(flat[16 * cuts[i] : 16 * cuts[i + 1]]) for i in full]
            if len(a):
                buckets.append(-1)
                bodies.append(np.column_stack(forest(a, b)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(bodies, pa.binary())], ["bucket", "body"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[np.ndarray] = []
        now = -1

        def close() -> tuple[np.ndarray, np.ndarray]:
            both = np.concatenate(held)
            return chained(both[:, 0], both[:, 1].astype(np.int64))[:2]

        for batch in batches:
            for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket == -1:
                    edges = np.frombuffer(body.as_buffer(), dtype=np.int64).reshape(-1, 2)
                    yield edges[:, 0], edges[:, 1]
                    continue
                if bucket != now and held:
                    yield close()
                    held = []
                now = bucket
                held.append(np.frombuffer(body.as_buffer(), dtype=np.uint64).reshape(-1, 2))
        if held:
            yield close()

    rows = map_arrow(table.where("n > 0").select("uid", "sig"), local, "bucket int, body binary")
    spot = F.when(F.col("bucket") < 0, F.xxhash64("body")).otherwise(F.col("bucket"))  # edges go anywhere
    dealt = rows.withColumn("spot", spot).repartition(parts, "spot").select("bucket", "body").sortWithinPartitions("bucket")
    return map_arrow(dealt, contracted(across), "a long, b long")


def _held(shingles: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, text) pairs in order: their texts, where each shingle's run starts, its length, and the number of
    distinct shingles of each text. One sort of packed words; the low bits of a hash make room for the text's number."""
    bits = np.uint64(max(1, int(n).bit_length()))
    packed = np.sort(((shingles >> bits) << bits) | text.astype(np.uint64))
    if len(packed):
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    t = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    h = packed >> bits
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return t, starts, np.diff(np.append(starts, len(h))), np.bincount(t, minlength=n)


def small_links(shingles: np.ndarray, offsets: np.ndarray, group: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, similarity), i < j, of texts of one group with Jaccard >= threshold; for groups of a few texts each."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    t, starts, freq, size = _held(tc.mix(shingles ^ tc.mix(group.astype(np.uint64))[text]), text, n)
    # a pair is a cell of its group's square of the texts' ranks in it
    of = np.argsort(group, kind="stable")
    sizes_of = np.unique(group, return_counts=True)[1]
    w = int(sizes_of.max(initial=1))
    cell = np.empty((len(sizes_of), w), np.int64)
    which, rank = np.empty(n, np.int64), np.empty(n, np.int64)
    which[of], rank[of] = tc.spread(sizes_of)
    cell[which, rank] = np.arange(n)
    inter = np.zeros(len(sizes_of) * w * w, np.int64)
    for f in range(2, int(freq.max(initial=1)) + 1):
        at = starts[freq == f]
        if len(at):
            x, y = np.triu_indices(f, 1)
            members = t[at[:, None] + np.arange(f)]
            one, two = members[:, x].ravel(), members[:, y].ravel()
            inter += np.bincount((which[one] * w + rank[one]) * w + rank[two], minlength=len(inter))
    code = np.flatnonzero(inter)
    inter, pair = inter[code], code // w
    i, j = cell[pair // w, pair % w], cell[pair // w, code % w]
    both = size[i] + size[j] - inter
    hit = inter * threshold.denominator >= both * threshold.numerator
    return i[hit], j[hit], inter[hit] / both[hit]


def tile_links(shingles: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, similarity) of texts with Jaccard >= threshold, i in ``left``, j in ``right``, both text numbers."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    t, starts, freq, size = _held(shingles, text, n)
    row_of, col_of = np.full(n, -1), np.full(n, -1)
    row_of[left], col_of[right] = np.arange(len(left)), np.arange(len(right))
    inter = np.zeros((len(left), len(right)), dtype=np.int64)
    flat = inter.ravel()
    for f in range(2, RARE + 1):
        at = starts[freq == f]
        for x in range(f if len(at) else 0):
            for y in range(f):
                if x != y:
                    r, c = row_of[t[at + x]], col_of[t[at + y]]
                    ok = (r >= 0) & (c >= 0)
                    np.add.at(flat, r[ok] * len(right) + c[ok], 1)
    common = np.flatnonzero(freq > RARE)
    for k in range(0, len(common), COLUMNS):
        cols = common[k : k + COLUMNS]
        group, rank = tc.spread(freq[cols])
        at = t[starts[cols][group] + rank]
        one = np.zeros((n, len(cols)), dtype=np.float32)
        one[at, group] = 1
        inter += np.rint(one[left] @ one[right].T).astype(np.int64)
    both = size[left][:, None] + size[right][None, :] - inter
    hit = inter * threshold.denominator >= both * threshold.numerator
    hit &= (left[:, None] != right[None, :]) & (inter > 0)
    i, j = np.nonzero(hit)
    return left[i], right[j], inter[i, j] / both[i, j]


def verified(members: DataFrame, shingler: Callable, threshold: Fraction) -> DataFrame:
    """Rows (kind, a, b, w) of the tiles of ``members`` (gid, ti, tj, block, uid, mult, text): kind 0 unit a has w
    partners, kind 1 units a and b are connected."""
    names = ["kind", "a", "b", "w"]

    def tile(parts: list[pa.RecordBatch], small: bool) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(parts)  # of all parts at once, as most hold a few short texts
        gid, block, uid, mult = (rows.column(i).to_numpy() for i in (0, 3, 4, 5))
        shingle, sizes = [], []
        for s in tc.slices(rows.column(6)):
            h, offsets = shingler(s)
            shingle.append(h)
            sizes.append(np.diff(offsets))
        every, offsets = np.concatenate(shingle), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        first, second = parts[0].column(1)[0].as_py(), parts[0].column(2)[0].as_py()
        if small:
            i, j, _ = small_links(every, offsets, gid, threshold)
        else:
            i, j, _ = tile_links(every, offsets, np.flatnonzero(block == first), np.flatnonzero(block == second), threshold)
        if not len(i):
            return None
        w = np.zeros(len(uid), dtype=np.int64)
        np.add.at(w, i, mult[j])
        if small or first != second:
            np.add.at(w, j, mult[i])
        has = np.flatnonzero(w)
        a, b = forest(uid[i], uid[j])
        z = np.zeros(len(has), np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([z, np.ones(len(a), np.int64)]).astype(np.int32)),
            pa.array(np.concatenate([uid[has], a])),
            pa.array(np.concatenate([z, b])),
            pa.array(np.concatenate([w[has], np.zeros(len(a), np.int64)])),
        ], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        few: list[pa.RecordBatch] = []
        now, length, size = None, 0, 0

        def close() -> pa.RecordBatch | None:
            """Files the group at hand, or compares it if it is large."""
            nonlocal held, few, length, size
            rows, group, bytes_ = sum(p.num_rows for p in held), held, length
            held, length = [], 0
            if rows < 2:
                return None
            if rows > SMALL or now[1] != now[2]:
                return tile(group, False)
            few += group
            size += bytes_
            if size < SMALL_BYTES:
                return None
            group, few, size = few, [], 0
            return tile(group, True)

        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(6)).to_numpy(zero_copy_only=False) + ROW_BYTES)]).tolist()
            for k, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if k == end:
                    continue
                key = tuple(keys[k].tolist())
                if held and key != now and (made := close()) is not None:
                    yield made
                now = key
                held.append(batch.slice(k, end - k))
                length += ends[end] - ends[k]
        if held and (made := close()) is not None:
            yield made
        if few and (made := tile(few, True)) is not None:
            yield made

    dealt = members.repartition(partitions(members.sparkSession), "gid", "ti", "tj").sortWithinPartitions("gid", "ti", "tj")
    return map_arrow(dealt, run, "kind int, a long, b long, w long")


def joined(rows: DataFrame, places: DataFrame, shingler: Callable, threshold: Fraction = Fraction(4, 5), trees: int = 24, deepest: int = 6, recall: float = 0.999, audit: bool = True) -> DataFrame:
    """The self-join of rows (id, text), of which places (id, key, order) is a written table: ids are unique and the same
    from read to read, rows of equal key have equal text. audit=False: prefixes of ``deepest``, shortened by the formula
    alone. A table of the distinct texts: key, mult, n, n_links (partners of
    one such row, copies included), uid (its smallest id), root (the smallest uid of its connected component), first (the
    smallest order of the text, nulls aside) and class_first (that of the component)."""
    depth = 0 if audit else depth_for(float(threshold), trees, deepest, recall, np.zeros(deepest + 1))
    table = units(rows, places, shingler, trees, deepest, threshold, sample(rows, places, shingler, trees, deepest) if audit else None, depth)
    if audit:
        depth = depth_for(float(threshold), trees, deepest, recall, audited(table, deepest))
    found = components(candidates(table, trees, deepest, depth, hashed=not audit), contract=False)
    groups = found.select(F.col("node").alias("uid"), F.col("root").alias("gid"))
    groups = groups.union(groups.select(F.col("gid").alias("uid"), "gid").distinct())
    mine = written(table.select("uid", "mult", "n").join(groups, "uid"), "members")
    dropped(found)
    large = mine.groupBy("gid").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb")).where("nb > 1")
    placed = looked_up(mine, large, "gid", "uid").withColumn("nb", F.coalesce("nb", F.lit(1)))
    block = F.when(F.col("nb") == 1, 0).otherwise(F.pmod(F.xxhash64("uid"), F.col("nb"))).cast("int")
    placed = placed.select("uid", "gid", "mult", "nb", block.alias("block"))
    # one row a text: copies have other ids; few candidates go to the texts, else both sides are shuffled
    sought = F.broadcast(placed) if mine.count() <= runtime.BROADCAST_ROWS else placed
    tiles = rows.select(F.col("id").alias("uid"), "text").join(sought, "uid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    tiles = tiles.select("gid", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"), "block", "uid", "mult", "text")
    links = written(verified(tiles, shingler, threshold), "links")
    dropped(mine)
    roots = components(links.where("kind = 1").select("a", "b"))
    counts = links.where("kind = 0").groupBy(F.col("a").alias("uid")).agg(F.sum("w").alias("w"))
    done = table.drop("sig", "met").join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").join(counts, "uid", "left")
    done = done.withColumn("root", F.coalesce("root", "uid"))
    # classes of one text are their own
    least = done.groupBy("root").agg(F.count("*").alias("_k"), F.min("first").alias("_least")).where("_k > 1").drop("_k")
    done = looked_up(done, least.withColumn("_met", F.lit(True)), "root", "uid").withColumn("class_first", F.when(F.col("_met"), F.col("_least")).otherwise(F.col("first")))
    links_of = F.when(F.col("n") > 0, F.col("mult") - 1 + F.coalesce("w", F.lit(0))).otherwise(0)
    out = written(done.select("key", "mult", "n", links_of.cast("long").alias("n_links"), "uid", "root", "first", "class_first"), "classes")
    for x in (table, links, roots):
        dropped(x)
    return out
