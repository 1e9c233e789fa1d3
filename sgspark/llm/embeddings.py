"""Near-duplicate embeddings: hierarchical navigable small-world graphs per shard, exact cosines, components.

1. Equal vectors are one unit, with their number and smallest id. Units are dealt by hash into shards of about
   SHARD_BYTES of vectors, or SHARD_NODES of them; a task builds a shard's graph (batches of insertions against the graph
   so far, neighbours half by diversity and half by closeness) and writes it to the shared folder.
2. Every unit queries every shard, in blocks: a task holds some thousand queries and loads one graph after the other, so
   vectors are shuffled once and graphs not at all. The beam starts narrow and doubles for queries whose whole beam is linked, and for the block as long as an audit
   finds less than ``recall`` of the links that AUDITED queries, or as many more as have LINKS links (all, if need be),
   have among all vectors of the shard; beyond WIDEST the exact scan of the shard takes over.
3. Every link found is verified by its cosine in double precision; a task gives a spanning forest of its links, and
   components are the forests' union.
4. Members of a component are all compared with each other in double precision, in tiles of two blocks, so the number of
   links (with copies) doesn't depend on which side of a link was found. Which tiles a vector goes to is worked out on
   thin rows. No pair is ever a row.

Vectors are scaled by their largest component before anything is squared, so tiny and huge ones link by their cosine
too. Vectors that are null, zero, empty or hold null or non-finite components link with nothing; vectors of different
lengths don't link with each other. Rows that share a vec_id are separate vectors; a null vec_id is a component's id only
if it has no other. No rows give no rows.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sgspark.llm.runtime import _tables, components, contracted, dropped, forest, got, looked_up, map_arrow, partitions, put, removed, written
from sgspark.llm.textcore import spread

THRESHOLD = 0.9
SHARD_BYTES, SHARD_NODES = 16 << 20, 32768
#: Neighbours of a node, share of nodes that the next layer keeps, beam while building, first and widest beam of a query.
NEIGHBOURS, LAYER, BUILD_BEAM, BEAM, WIDEST = 24, 16, 48, 32, 512
BLOCK, AUDITED, RECALL = 512, 32, 0.99
#: Links that an audit judges at least: with fewer, RECALL can't be told from a lost link.
LINKS = 100
#: Queries that a task holds at most while it loads the graphs, and that make a task of its own at least.
HELD_ROWS, TASK_ROWS = 16384, 2048
#: Vectors of a block of a component.
TILE = 2048
#: Float32 similarities this far below the threshold are still verified.
SLACK = 1e-3


class Graph:
    """A navigable small-world graph of unit vectors, numbered so that each layer is a prefix of the one below."""

    def __init__(self, vectors: np.ndarray, seed: int = 3):
        self.n = len(vectors)
        self.order = np.random.default_rng(seed).permutation(self.n)
        self.v = np.ascontiguousarray(vectors[self.order], dtype=np.float32)
        sizes = [self.n]
        while sizes[-1] > 4 * LAYER:
            sizes.append(sizes[-1] // LAYER)
        self.near = np.full((self.n, NEIGHBOURS), -1, dtype=np.int32)
        count = sizes[-1]
        sims = self.v[:count] @ self.v[:count].T
        np.fill_diagonal(sims, -np.inf)
        self.near[:count] = self._chosen(np.broadcast_to(np.arange(count, dtype=np.int32), (count, count)).copy(), sims)
        self.layers: list[np.ndarray] = []
        for size in sizes[::-1]:
            while count < size:
                b = min(count, BLOCK, size - count)
                self._insert(count, b)
                count += b
            if size < self.n:
                self.layers.append(self.near[:size].copy())

    def _chosen(self, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """NEIGHBOURS of each row's candidates (-1: none): the closest that are closer to the row than to any chosen so far,
        for half of the places, then the closest of the rest."""
        wide = min(ids.shape[1], 2 * NEIGHBOURS)
        rows = np.arange(len(ids))[:, None]
        top = np.argsort(-sims, axis=1, kind="stable")[:, :wide]
        ids, sims = ids[rows, top], sims[rows, top]
        ids[sims == -np.inf] = -1
        out = np.full((len(ids), NEIGHBOURS), -1, dtype=np.int32)
        for k in range(0, len(ids), 512):
            part, sim = ids[k : k + 512], sims[k : k + 512]
            vec = self.v[part]
            cross = vec @ vec.transpose(0, 2, 1)
            taken = np.zeros(part.shape, dtype=bool)
            blocked = part < 0
            number = np.zeros(len(part), dtype=np.int64)
            for j in range(wide):
                ok = ~blocked[:, j] & (number < NEIGHBOURS // 2)
                taken[ok, j] = True
                number += ok
                blocked |= ok[:, None] & (cross[:, j, :] > sim)
            rank = np.where(taken, 0, np.where(part >= 0, 1, 2)) * wide + np.arange(wide)
            best = np.argsort(rank, axis=1, kind="stable")[:, :NEIGHBOURS]
            out[k : k + 512, : best.shape[1]] = np.take_along_axis(part, best, axis=1)
        return out

    def _insert(self, count: int, b: int) -> None:
        new = np.arange(count, count + b)
        x = self.v[new]
        found, sims = self.search(x, BUILD_BEAM, self.near[:count])
        inner = x @ x.T
        np.fill_diagonal(inner, -np.inf)
        few = min(b, NEIGHBOURS)
        mates = np.argpartition(-inner, few - 1, axis=1)[:, :few]
        ids = np.concatenate([found, (mates + count).astype(np.int32)], axis=1)
        sims = np.concatenate([sims, np.take_along_axis(inner, mates, axis=1)], axis=1)
        self.near[new] = self._chosen(ids, sims)
        # the other way: each old or new neighbour may take the new node among its own
        source = np.repeat(new, NEIGHBOURS)
        target = self.near[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        sim = np.einsum("ij,ij->i", self.v[source], self.v[target])
        order = np.lexsort([-sim, target])
        source, target, sim = source[order], target[order], sim[order]
        nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
        group, rank = spread(counts)
        keep = rank < NEIGHBOURS
        wide = np.full((len(nodes), NEIGHBOURS), -1, dtype=np.int32)
        wide[group[keep], rank[keep]] = source[keep]
        for k in range(0, len(nodes), 2048):
            at = nodes[k : k + 2048]
            ids = np.concatenate([self.near[at], wide[k : k + 2048]], axis=1)
            ids = np.sort(ids, axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("icd,id->ic", self.v[ids], self.v[at])
            sims[ids < 0] = -np.inf
            self.near[at] = self._chosen(ids, sims)

    def search(self, x: np.ndarray, beam: int, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Node numbers and similarities of the ``beam`` best nodes found for each row of x; -1 and -inf where fewer are."""
        start = np.zeros((len(x), 1), dtype=np.int32)
        for layer in self.layers:
            start, _ = self._beam(layer, x, start, 4)
        return self._beam(self.near if base is None else base, x, start, beam)

    def _beam(self, near: np.ndarray, x: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q = len(x)
        rows = np.arange(q)
        seen = np.zeros((q, len(near) + 1), dtype=bool)  # the last column is for -1
        seen[:, -1] = True
        ids = np.full((q, beam), -1, dtype=np.int32)
        sims = np.full((q, beam), -np.inf, dtype=np.float32)
        done = np.ones((q, beam), dtype=bool)
        k = min(start.shape[1], beam)
        first = start[:, :k]
        ids[:, :k] = first
        sims[:, :k] = np.where(first >= 0, np.einsum("icd,id->ic", self.v[first], x), -np.inf)
        done[:, :k] = first < 0
        seen[rows[:, None], first] = True
        live = rows
        while len(live):
            open_sims = np.where(done[live], -np.inf, sims[live])
            step = min(2, beam)
            pick = np.argpartition(-open_sims, step - 1, axis=1)[:, :step]
            good = np.take_along_axis(open_sims, pick, axis=1) > -np.inf
            busy = good.any(axis=1)
            live, pick, good = live[busy], pick[busy], good[busy]
            if not len(live):
                break
            done[live[:, None], pick] |= good
            nodes = np.where(good, ids[live[:, None], pick], -1)
            new = near[nodes]
            new[nodes < 0] = -1
            new = new.reshape(len(live), -1)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            fresh = ~seen[live[:, None], new]
            seen[live[:, None], new] = True
            r, c = np.nonzero(fresh)
            value = np.full(new.shape, -np.inf, dtype=np.float32)
            value[r, c] = np.einsum("id,id->i", self.v[new[r, c]], x[live[r]])
            all_sims = np.concatenate([sims[live], value], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[live] = np.take_along_axis(all_sims, top, axis=1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, new, -1)], axis=1), top, axis=1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), top, axis=1)
        return ids, sims


def hits(graph: Graph, x: np.ndarray, threshold: float, recall: float, seed: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (row of x, node) of similarity >= threshold by beams that widen until the audit passes; the last beam. Beams
    wider than WIDEST, or than the shard, are exact scans, which cost less then. An audit takes AUDITED rows at a time until
    they have LINKS true links; rows without any in the shard can't pass it for the others. own: each row's own node, -1
    for none; an audit doesn't count it."""
    x = x.astype(np.float32)
    dealt = np.random.default_rng(seed).permutation(len(x))
    sought: list[np.ndarray] = []  # true links as row * graph.n + node
    count, links = 0, 0
    while count < len(x) and links < LINKS:
        part = dealt[count : count + AUDITED]
        r, c = np.nonzero(x[part] @ graph.v.T >= threshold)
        r = part[r]
        if own is not None:
            r, c = r[own[r] != c], c[own[r] != c]
        sought.append(r * graph.n + c)
        count += len(part)
        links += len(c)
    truth = np.concatenate(sought) if sought else np.zeros(0, np.int64)
    rows, nodes = np.zeros(0, np.int64), np.zeros(0, np.int64)
    beam, todo = BEAM, np.arange(len(x))
    while True:
        if beam >= graph.n or beam > WIDEST:
            r, c = np.nonzero(x[todo] @ graph.v.T >= threshold)
            return np.concatenate([rows, todo[r]]), np.concatenate([nodes, c]), beam
        ids, sims = graph.search(x[todo], beam)
        linked = (sims >= threshold) & (ids >= 0)
        full = linked.all(axis=1)
        r, c = np.nonzero(linked & ~full[:, None])
        rows, nodes = np.concatenate([rows, todo[r]]), np.concatenate([nodes, ids[r, c]])
        todo = todo[full]
        if not len(todo):
            if np.isin(truth, rows * graph.n + nodes).sum() >= recall * len(truth):
                return rows, nodes, beam
            todo, rows, nodes = np.arange(len(x)), rows[:0], nodes[:0]
        beam *= 2


def _block_links(graph: Graph, exact: np.ndarray, uid: np.ndarray, q: np.ndarray, q_uid: np.ndarray, threshold: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (uid, uid) of the links, verified in double precision, of the queries q with a shard."""
    norm_q = np.linalg.norm(q, axis=1)
    place = np.argsort(graph.order)  # uid is sorted; the node of each of its vectors
    at = np.minimum(np.searchsorted(uid, q_uid), len(uid) - 1)
    own = np.where(uid[at] == q_uid, place[at], -1)
    rows, nodes, _ = hits(graph, q / norm_q[:, None], threshold - SLACK, RECALL, seed, own)
    at = graph.order[nodes]
    cosine = np.einsum("id,id->i", q[rows], exact[at]) / (norm_q[rows] * np.linalg.norm(exact, axis=1)[at])
    good = (cosine >= threshold) & (q_uid[rows] != uid[at])
    return forest(q_uid[rows[good]], uid[at[good]])


def _tile(uid: np.ndarray, mult: np.ndarray, vec: np.ndarray, block: np.ndarray, first: int, second: int, threshold: float) -> np.ndarray:
    """For each vector of a tile the number of those, with copies, that it links with across the tile's two blocks."""
    norm = np.linalg.norm(vec, axis=1)
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    count = np.zeros(len(uid), dtype=np.int64)
    for k in range(0, len(left), 1024):
        part = left[k : k + 1024]
        link = (vec[part] @ vec[right].T / (norm[part][:, None] * norm[right][None, :]) >= threshold) & (uid[part][:, None] != uid[right][None, :])
        count[part] += link @ mult[right]
        if first != second:
            count[right] += mult[part] @ link
    return count


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, each scaled so that its largest component is 1 or -1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return flat / np.abs(flat).max(axis=1)[:, None]


def _loaded(at: str) -> tuple[Graph, np.ndarray, np.ndarray]:
    """A shard's graph, its vectors and their units."""
    with np.load(io.BytesIO(got(at))) as z:
        graph, exact = Graph.__new__(Graph), z["exact"]
        graph.n, graph.order, graph.near = len(exact), z["order"], z["near"]
        graph.layers = [z[f"layer{i}"] for i in range(sum(k.startswith("layer") for k in z.files))]
        graph.v = np.ascontiguousarray((exact / np.linalg.norm(exact, axis=1)[:, None])[graph.order], dtype=np.float32)
        return graph, exact, z["uid"]


def classes(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row per vector: vec_id, n_links, component_id and kept."""
    spark = vectors.sparkSession
    parts = partitions(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumns({"valid": valid, "h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    units = rows.where("valid").groupBy("h1", "h2", "vec").agg(F.count("*").alias("mult"), F.min("vec_id").alias("first"))
    units = written(units.withColumns({"uid": F.monotonically_increasing_id(), "dim": F.size("vec")}), "vectors")
    most = units.agg(F.count("*"), F.max("dim")).first()
    n, dim = most[0], most[1] or 1
    shards = max(1, -(-n // min(SHARD_NODES, max(1024, SHARD_BYTES // (8 * dim)))))
    shard = F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(shards)).cast("int")
    folder = f"{_tables(spark)}/graphs-{uuid.uuid4().hex}"

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        exact = _matrix(table["vec"].combine_chunks() if isinstance(table["vec"], pa.ChunkedArray) else table["vec"])
        order = np.argsort(table["uid"].to_numpy())
        exact, uid = exact[order], table["uid"].to_numpy()[order]
        graph = Graph(exact / np.linalg.norm(exact, axis=1)[:, None])
        out = io.BytesIO()
        np.savez(out, exact=exact, uid=uid, order=graph.order, near=graph.near, **{f"layer{i}": x for i, x in enumerate(graph.layers)})
        put(f"{folder}/{table['dim'][0].as_py()}-{table['shard'][0].as_py()}", out.getvalue())
        return pa.table({"dim": table["dim"].slice(0, 1), "shard": table["shard"].slice(0, 1)})

    made = units.withColumn("shard", shard).select("dim", "shard", "uid", "vec").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int")
    graphs = sorted((r["dim"], r["shard"]) for r in made.collect())  # two numbers a shard

    def linked(uid: np.ndarray, vec: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.diff(vec.offsets.to_numpy())
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            q, q_uid = _matrix(vec.take(pa.array(at))), uid[at]
            for _, number in (g for g in graphs if g[0] == size):
                graph, exact, its = _loaded(f"{folder}/{size}-{number}")
                for k in range(0, len(q), BLOCK):
                    yield _block_links(graph, exact, its, q[k : k + BLOCK], q_uid[k : k + BLOCK], threshold, int(q_uid[k]) & 0xFFFF)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        uid, vec, held = [], [], 0
        for batch in batches:
            uid.append(batch.column(0).to_numpy())
            vec.append(batch.column(1))
            held += batch.num_rows
            if held >= HELD_ROWS:
                yield from linked(np.concatenate(uid), pa.concat_arrays(vec))
                uid, vec, held = [], [], 0
        if held:
            yield from linked(np.concatenate(uid), pa.concat_arrays(vec))

    asked = units.select("uid", "vec").repartition(max(1, min(2 * parts, -(-n // TASK_ROWS)), -(-n // HELD_ROWS)), "uid").sortWithinPartitions("uid")
    roots = components(map_arrow(asked, contracted(answer), "a long, b long"), contract=False).select(F.col("node").alias("uid"), "root")
    roots = written(roots.union(roots.select(F.col("root").alias("uid"), "root").distinct()), "roots")
    large = roots.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("int").alias("nb")).where("nb > 1")
    placed = looked_up(roots, large, "root", "uid").withColumn("nb", F.coalesce("nb", F.lit(1)))
    block = F.when(F.col("nb") == 1, 0).otherwise(F.pmod(F.xxhash64("uid", F.lit(9)), F.col("nb"))).cast("int")
    tiles = units.select("uid", "mult", "vec").join(placed.withColumn("block", block), "uid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    tiles = tiles.select("root", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"), "block", "uid", "mult", "vec")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def close() -> pa.RecordBatch | None:
            if sum(h.num_rows for h in held) < 2:
                return None
            column = lambda i: np.concatenate([h.column(i).to_numpy() for h in held])
            uid = column(4)
            w = _tile(uid, column(5), np.concatenate([_matrix(h.column(6)) for h in held]), column(3), now[1], now[2], threshold)
            has = np.flatnonzero(w)
            return pa.RecordBatch.from_arrays([pa.array(uid[has]), pa.array(w[has])], ["a", "w"])

        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for k, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if k == end:
                    continue
                key = tuple(keys[k].tolist())
                if now is not None and key != now:
                    if (made := close()) is not None:
                        yield made
                    held = []
                now = key
                held.append(batch.slice(k, end - k))
        if held and (made := close()) is not None:
            yield made

    counts = map_arrow(tiles.repartition(parts, "root", "ti", "tj").sortWithinPartitions("root", "ti", "tj"), count, "a long, w long")
    counts = counts.groupBy(F.col("a").alias("uid")).agg(F.sum("w").alias("w"))
    slim = units.drop("vec").join(roots, "uid", "left").join(counts, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    least = slim.groupBy("root").agg(F.count("*").alias("_k"), F.min("first").alias("least")).where("_k > 1").drop("_k").withColumn("met", F.lit(True))
    slim = looked_up(slim, least, "root", "uid").withColumn("component", F.when(F.col("met"), F.col("least")).otherwise(F.col("first")))
    slim = written(slim.select("h1", "h2", "component", (F.col("mult") - 1 + F.coalesce("w", F.lit(0))).alias("links"), F.lit(True).alias("valid")), "classes")
    for x in (units, roots):
        dropped(x)
    removed(spark, folder)
    # copies of one vector are counted, and thin, but may be many: the plan splits such a key
    out = rows.select("vec_id", "h1", "h2", "valid").join(slim, ["h1", "h2", "valid"], "left")
    component = F.when(F.col("valid"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
