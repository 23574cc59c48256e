"""Embedding near-dedup by hierarchical navigable small-world graphs.

Distinct vectors are dealt to shards of bounded size by a hash of their id. A task builds the graph of a shard, and
graphs are written to a table once. All vectors are queries, in blocks; every block is asked of every shard, each such
pair a piece of work of its own that reads one row of either table. A query's beam is doubled until its worst result
lies under the threshold, so that a dense group is found whole; a block's starting beam is doubled until audited
queries, compared with all vectors of the shard, reach the recall asked for. Found links are verified by cosine in
double precision and joined up into components. Equal vectors are one node with a number of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, components, dropped, numbers, saved, setting, table

COSINE = 0.9
#: Vectors of a shard, about, and shards at least.
SHARD_ROWS = 1 << 15
LEAST_SHARDS = 8
#: Links of a node on an upper layer; the lowest has twice as many.
DEGREE = 16
#: Beams: while building, and a query's first.
BUILD_BEAM = 48
BEAM = 32
#: Queries of a block, which is asked of one shard at a time.
BLOCK_ROWS = 1 << 12
#: Queries at a time, those of them that are audited, and the part of their links that has to be found.
BLOCK = 256
AUDITED = 32
RECALL = 0.98
#: Nodes of a beam that are expanded at a time, at least.
STEP = 4
#: Rows that are added to a layer at a time at most; they are compared with each other outright.
BATCH = 2048
#: Rows whose links are chosen at a time.
PORTION = 64


class Graph:
    """A layered graph over the rows of ``x``, unit vectors in single precision.

    Rows are renumbered by falling level, so that a layer holds the rows below its size and is built after those above.
    """

    def __init__(self, x: np.ndarray, degree: int = DEGREE, seed: int = 0, made: tuple[np.ndarray, list[np.ndarray]] | None = None):
        if made:
            self.order, self.layers = made
            self.x = np.ascontiguousarray(x[self.order])
            return
        n = len(x)
        draw = np.random.default_rng(seed).random(n)
        level = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(degree)), 8).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.x = np.ascontiguousarray(x[self.order])
        top = int(level.max()) if n else 0
        self.layers: list[np.ndarray] = []  # from the top: neighbours of each row, -1 for none
        for at in range(top, -1, -1):
            self._layer(int((level >= at).sum()), 2 * degree if at == 0 else degree)

    def _layer(self, size: int, degree: int) -> None:
        links = np.full((size, degree), -1, np.int32)
        above = len(self.layers)
        self.layers.append(links)
        done = min(size, 2 * degree)
        self._link(links, np.arange(done), np.tile(np.arange(done), (done, 1)))
        while done < size:
            new = np.arange(done, min(size, 2 * done, done + BATCH))
            x, near = self.x[new], []
            for i in range(0, len(new), BLOCK):
                part = x[i : i + BLOCK]
                old, _ = self._beam(part, links[:done], self._descend(part, above), BUILD_BEAM)
                beside = part @ x.T
                k = min(BUILD_BEAM // 2, len(new) - 1)
                near.append(np.concatenate([old, np.argpartition(-beside, k, axis=1)[:, : k + 1] + done], axis=1))
            self._link(links, new, np.concatenate(near))
            done = int(new[-1]) + 1

    def _chosen(self, rows: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
        """Of each row's candidates, those nearer to it than to one chosen before, then the nearest others; -1 for none."""
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[near == rows[:, None]] = -1
        sims = np.matmul(self.x[near], self.x[rows][:, :, None])[:, :, 0]
        sims[near < 0] = -2
        best = np.argsort(-sims, axis=1)[:, : 2 * degree]
        near, sims = np.take_along_axis(near, best, 1), np.take_along_axis(sims, best, 1)
        own = self.x[near]
        among = np.matmul(own, own.transpose(0, 2, 1))
        taken = np.zeros(near.shape, bool)
        for c in range(near.shape[1]):
            closer = (taken[:, :c] & (among[:, c, :c] > sims[:, c : c + 1])).any(axis=1)
            taken[:, c] = ~closer & (near[:, c] >= 0) & (taken.sum(axis=1) < degree)
        rank = np.argsort(np.where(near < 0, 2, ~taken), axis=1, kind="stable")[:, :degree]
        out = np.take_along_axis(near, rank, 1)
        if out.shape[1] < degree:
            out = np.concatenate([out, np.full((len(out), degree - out.shape[1]), -1)], axis=1)
        return out

    def _link(self, links: np.ndarray, new: np.ndarray, near: np.ndarray) -> None:
        degree = links.shape[1]
        if not len(new):
            return
        near = near.astype(np.int64)
        for i in range(0, len(new), PORTION):
            links[new[i : i + PORTION]] = self._chosen(new[i : i + PORTION], near[i : i + PORTION], degree)
        back = np.repeat(new, degree)
        to = links[new].ravel()
        back, to = back[to >= 0], to[to >= 0]
        if not len(to):
            return
        sims = self._sims(self.x, back, to)
        by = np.lexsort((-sims, to))
        back, to = back[by], to[by]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(first, count)
        keep = rank < degree
        more = np.full((len(nodes), degree), -1, np.int64)
        more[np.repeat(np.arange(len(nodes)), count)[keep], rank[keep]] = back[keep]
        for i in range(0, len(nodes), PORTION):
            part = nodes[i : i + PORTION]
            links[part] = self._chosen(part, np.concatenate([links[part].astype(np.int64), more[i : i + PORTION]], axis=1), degree)

    def _descend(self, q: np.ndarray, layers: int) -> np.ndarray:
        """Rows from which to enter the layer below the first ``layers``."""
        start = np.zeros((len(q), 1), np.int64)
        for links in self.layers[:layers]:
            start = self._beam(q, links, start, 4)[0]
        return start

    def _sims(self, q: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The cosines of queries ``at`` with ``rows``, pair by pair, in portions that stay in cache."""
        out = np.empty(len(at), np.float32)
        for i in range(0, len(at), 2048):
            part = slice(i, i + 2048)
            np.einsum("bd,bd->b", q[at[part]], self.x[rows[part]], out=out[part])
        return out

    def _beam(self, q: np.ndarray, links: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best rows found for each query, -1 for none, and their cosines, in falling order.

        A beam's entries are integers that sort by falling cosine: the cosine in 32 bits, the row, and whether it has
        been expanded.
        """
        n, size = len(q), len(links)
        width = min(width, size)
        step = max(STEP, width // 16)
        none = np.uint64((1 << 64) - 1)
        beam = np.full((n, width), none)
        seen = np.zeros((n, size + 1), bool)
        seen[:, size] = True
        active, new = np.arange(n), start
        while True:
            new = np.sort(np.where((new < 0) | (new >= size), size, new), axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = size
            row, col = np.nonzero(~seen[active[:, None], new])
            nodes = new[row, col]
            seen[active[row], nodes] = True
            far = ((2 - self._sims(q, active[row], nodes).astype(np.float64)) * (1 << 30)).astype(np.uint64)
            found = np.full((len(active), int(np.bincount(row, minlength=1).max()) if len(row) else 0), none)
            count = np.bincount(row, minlength=len(active))
            found[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = far << np.uint64(32) | nodes.astype(np.uint64) << np.uint64(1)
            merged = np.sort(np.concatenate([beam[active], found], axis=1), axis=1)[:, :width]
            fresh = (merged & np.uint64(1)) == 0
            rank = np.cumsum(fresh, axis=1)
            row, col = np.nonzero(fresh & (rank <= step))
            nodes = np.full((len(active), step), -1, np.int64)
            nodes[row, rank[row, col] - 1] = (merged[row, col] & np.uint64((1 << 32) - 1)) >> np.uint64(1)
            merged[row, col] |= np.uint64(1)
            beam[active] = merged
            more = fresh.any(axis=1)
            if not more.any():
                ids = np.where(beam == none, -1, ((beam & np.uint64((1 << 32) - 1)) >> np.uint64(1)).astype(np.int64))
                return ids, np.where(beam == none, -2, 2 - (beam >> np.uint64(32)) / (1 << 30))
            active, nodes = active[more], nodes[more]
            new = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1).astype(np.int64)

    def within(self, q: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """``(query, row)`` pairs of cosine ``least`` or more that the beams reach, rows numbered as given."""
        queries, rows = [], []
        left, start, width = np.arange(len(q)), self._descend(q, len(self.layers) - 1), beam
        while len(left):
            ids, sims = self._beam(q[left], self.layers[-1], start, width)
            full = (sims[:, -1] >= least) & (ids.shape[1] < len(self.x))
            at, col = np.nonzero((sims >= least) & (ids >= 0) & ~full[:, None])
            queries.append(left[at])
            rows.append(self.order[ids[at, col]])
            left, start, width = left[full], ids[full], 2 * width
        return (np.concatenate(queries), np.concatenate(rows)) if queries else (np.zeros(0, int), np.zeros(0, int))

    def audited(self, q: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, int]:
        """``within``, and the beam that passed: it is doubled until enough of what sampled queries link with is found."""
        while True:
            at, row = self.within(q, least, beam)
            count = np.bincount(at, minlength=len(q))
            linked, rest = np.flatnonzero(count), np.flatnonzero(count == 0)
            half = AUDITED // 2
            sample = np.concatenate([linked[:: max(1, len(linked) // half)][:half], rest[:: max(1, len(rest) // half)][:half]])
            true = int((q[sample] @ self.x.T >= least).sum())
            if count[sample].sum() >= RECALL * true or beam >= len(self.x):
                return at, row, beam
            beam *= 2


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


class _Groups:
    """Which rows of a shard are known to be connected."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Connect pairs; gives the places of pairs that connected what wasn't, enough to do so for all."""
        x, y = self.label[a], self.label[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return apart
        _, first = np.unique(np.stack([x[apart], y[apart]]), axis=1, return_index=True)
        root: dict[int, int] = {}
        used = []

        def find(k: int) -> int:
            while root.get(k, k) != k:
                k = root[k]
            return k

        for k in apart[first].tolist():
            m, n = sorted((find(int(x[k])), find(int(y[k]))))
            if m != n:
                root[n] = m
                used.append(k)
        to = np.arange(len(self.label))
        for k in root:
            to[k] = find(k)
        self.label = to[self.label]
        return np.array(used)


_BLOCKS = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("units", pa.binary())])
_GRAPHS = pa.schema([*_BLOCKS, ("rows_of", pa.binary()), ("degrees", pa.binary()), ("neighbours", pa.binary())])
_LINKS = "u long, v long, links long"


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
    return numbers(batch.column("rep")), numbers(batch.column("copies")), _unit(flat.reshape(batch.num_rows, -1))


def _row(schema: pa.Schema, dim: int, *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], schema=schema)


def _blocks(size: int):
    """Vectors to blocks of one length, ``size`` vectors at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            dims = numbers(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                of = held.setdefault(dim, [])
                of.append(_vectors(batch.filter(pa.array(dims == dim))))
                while sum(len(x[0]) for x in of) >= size:
                    whole = [np.concatenate(x) for x in zip(*of)]
                    yield _row(_BLOCKS, dim, *(x[:size] for x in whole))
                    of[:] = [tuple(x[size:] for x in whole)]
        for dim, of in held.items():
            whole = [np.concatenate(x) for x in zip(*of)]
            if len(whole[0]):
                yield _row(_BLOCKS, dim, *whole)

    return run


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors sorted by shard to a graph for each."""
    key: tuple[int, int] | None = None
    held: list[tuple[np.ndarray, ...]] = []

    def made() -> pa.RecordBatch:
        ids, copies, units = map(np.concatenate, zip(*held))
        graph = Graph(units.astype(np.float32))
        shape = np.array([x.shape for x in graph.layers], np.int64)
        return _row(_GRAPHS, key[0], ids, copies, units, graph.order.astype(np.int64), shape, np.concatenate([x.ravel() for x in graph.layers]))

    for batch in batches:
        dims, shards = numbers(batch.column("dim")), numbers(batch.column("shard"))
        cut = np.flatnonzero((dims[1:] != dims[:-1]) | (shards[1:] != shards[:-1])) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows]):
            if a == b:
                continue
            if held and key != (int(dims[a]), int(shards[a])):
                yield made()
                held = []
            key = int(dims[a]), int(shards[a])
            held.append(_vectors(batch.slice(a, b - a)))
    if held:
        yield made()


def _search(least: float):
    """Rows of a block beside a graph to verified links.

    A query gives one row for a shard with links: the smallest as ``v``, and the copies of all of them as ``links``. What
    else it connects comes as rows without links, and only if the block hasn't connected the shard's rows yet: the rows
    are linear in the vectors however many links there are.
    """

    def links(u, v, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (u, v, n)], names=["u", "v", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: np.frombuffer(batch.column(n)[row].as_buffer(), k) for n, k in (("ids", np.int64), ("copies", np.int64), ("rows_of", np.int64), ("degrees", np.int64), ("neighbours", np.int32), ("q_ids", np.int64))}
                ids, copies = one["ids"], one["copies"]
                units, asked = (np.frombuffer(batch.column(n)[row].as_buffer(), np.float64).reshape(k, -1) for n, k in (("units", len(ids)), ("q_units", len(one["q_ids"]))))
                shape = one["degrees"].reshape(-1, 2)
                layers = [x.reshape(s) for x, s in zip(np.split(one["neighbours"], np.cumsum(shape.prod(axis=1))[:-1]), shape)]
                graph, groups, beam = Graph(units.astype(np.float32), made=(one["rows_of"], layers)), _Groups(len(ids)), BEAM
                for i in range(0, len(asked), BLOCK):
                    q_ids, q = one["q_ids"][i : i + BLOCK], asked[i : i + BLOCK]
                    at, near, beam = graph.audited(q.astype(np.float32), least - 1e-4, beam)
                    sure = (np.einsum("bd,bd->b", q[at], units[near]) >= least) & (q_ids[at] != ids[near])
                    at, near = at[sure], near[sure]
                    if not len(at):
                        continue
                    by = np.lexsort((ids[near], at))
                    at, near = at[by], near[by]
                    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    yield links(q_ids[at[first]], ids[near[first]], np.add.reduceat(copies[near], first))
                    beside = np.flatnonzero(at[1:] == at[:-1])
                    new = beside[groups.join(near[beside], near[beside + 1])] if len(beside) else beside
                    if len(new):
                        yield links(ids[near[new]], ids[near[new + 1]], np.zeros(len(new)))

    return run


def _kinds(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def graph_links(reps: DataFrame, least: float, shard_rows: int, shards: int, block_rows: int) -> DataFrame:
    """``(u, v, links)`` of the vectors ``reps(rep, copies, embedding, dim)``, a saved table; see ``_search``."""
    spark = reps.sparkSession
    shards = max(shards, math.ceil(reps.count() / shard_rows))
    shard = F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard")
    members = reps.select("rep", "copies", "embedding", "dim", shard).repartition("dim", "shard").sortWithinPartitions("dim", "shard")
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):  # a task for each shard, however small
        graphs = saved(members.mapInArrow(_graphs, _kinds(_GRAPHS)), "vector-graphs")
    blocks = saved(reps.select("rep", "copies", "embedding", "dim").mapInArrow(_blocks(block_rows), _kinds(_BLOCKS)), "vector-blocks")
    # Every block meets every graph of its length; both are read where they are, and neither is shuffled or broadcast.
    asked = blocks.select("dim", F.col("ids").alias("q_ids"), F.col("units").alias("q_units")).hint("shuffle_replicate_nl")
    pairs = asked.join(graphs.hint("shuffle_replicate_nl"), "dim").drop("dim")
    with arrow_rows(spark, 1):  # a row is megabytes
        out = saved(pairs.mapInArrow(_search(least), _LINKS), "vector-links")
    dropped(graphs)
    dropped(blocks)
    return out


def near_vectors(rows: DataFrame, least: float = COSINE, shard_rows: int = SHARD_ROWS, shards: int = LEAST_SHARDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of each row of ``rows(vec_id, embedding, ...)``.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing, nor do vectors of
    different lengths link. Equal vectors under different ids are linked. Rows that repeat a vec_id are one node with each
    of their different vectors: each row shows the links of them all, a link for each vector. A row without vec_id is
    alone: no link, no component, not kept. Other columns are not read.
    """
    value = F.col("embedding")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    keys = (F.xxhash64(F.lit(1), value).alias("k1"), F.xxhash64(F.lit(2), value).alias("k2"))
    rows = rows.select(F.col("vec_id").cast("long"), "embedding")
    usable = F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
    distinct = rows.where(usable).select("vec_id", "embedding", *keys).dropDuplicates(["vec_id", "k1", "k2"])
    reps = distinct.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min_by("embedding", "vec_id").alias("embedding"))
    reps = saved(reps.withColumn("dim", F.size("embedding")), "vectors")
    links = graph_links(reps, least, shard_rows, shards, block_rows)
    degrees = links.groupBy("u").agg(F.sum("links").alias("n"))
    joined = components(links.select("u", "v"))
    of = reps.join(degrees, reps["rep"] == degrees["u"], "left").join(joined, reps["rep"] == joined["node"], "left")
    n_links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("_n")
    of = of.select("k1", "k2", n_links, F.coalesce("component", "rep").alias("_component"))
    named = rows.select("vec_id", F.when(usable, keys[0]).alias("k1"), F.when(usable, keys[1]).alias("k2")).join(of, ["k1", "k2"], "left")
    component = F.coalesce("_component", "vec_id")
    return named.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
#: All pairs outright.
ORACLES = {
    "op4_embedding_dedup": f"""
with recursive e as (select vec_id, embedding::double[] as v from embeddings where embedding is not null),
l as (select a.vec_id as u, b.vec_id as w from e a join e b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= {COSINE}),
c as (select vec_id as n, vec_id as m from embeddings union select c.n, l.w from c join l on c.m = l.u),
d as (select u, count(*) as k from l group by u), g as (select n, min(m) as least from c group by n)
select vec_id, coalesce(k, 0)::bigint as n_links, least as component_id, vec_id = least as kept
from embeddings left join d on vec_id = u join g on vec_id = n"""
}
