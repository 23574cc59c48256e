"""SimHash near-dedup by segment-popcount embedding.

A document's fingerprint has 64 bits. It is embedded in a grid by the popcounts of its 32 two-bit segments. The
Manhattan distance of two embeddings is a lower bound of the Hamming distance of the fingerprints, so that a pair
within 3 bits differs on at most 3 of 6 groups of axes and shares the coordinates of 3 others. Each choice of 3 axis
groups is a grid whose cells hold the fingerprints with the same coordinates there. Within a cell, pairs pass the
Manhattan bound on all axes first and are then verified by exact Hamming distance.

Only distinct fingerprints enter the cells. A cell gives no pairs but, for each group that its links make, the smallest
document with each of the others: components are the same. Cells over ``BLOCK`` fingerprints are cut into blocks and
each pair of blocks becomes a cell of its own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, numbers, saved, spread_join, table, utf8

SHINGLE = 3
SEED = 42
MOST_BITS = 3
#: First segments of the axis groups; there are 32 segments of two bits.
AXIS_BOUNDS = (0, 5, 10, 15, 20, 26, 32)
#: Most fingerprints that are compared within one cell by one task.
BLOCK = 4096


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a UTF-8 text; 0 where it has no word."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n < SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[: n - SHINGLE] + 1]).tolist()
        slices = map(joined.__getitem__, map(slice, starts, ends[SHINGLE - 1 :].tolist()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(SEED)), np.uint64, n - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _fingerprints(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        prints = np.fromiter(map(fingerprint, utf8(batch.column("text"))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], schema=_PRINTS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of each row; ``fp`` holds the 64 bits as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Popcounts of the two-bit segments in unary (0: 00, 1: 01, 2: 11), so that Manhattan distance is popcount of xor."""
    odd = F.lit(0x5555555555555555)
    next_bit = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(next_bit).bitwiseAND(odd)
    both = fp.bitwiseAND(next_bit).bitwiseAND(odd)
    return some.bitwiseOR(F.shiftleft(both, 1))


def grids() -> list[int]:
    """Bit masks, as signed longs, of the axes of each grid."""
    groups = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in zip(AXIS_BOUNDS, AXIS_BOUNDS[1:])]
    masks = [sum(c) for c in combinations(groups, len(groups) - MOST_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _unary(fp: np.ndarray) -> np.ndarray:
    """``embedding`` of unsigned fingerprints."""
    odd = np.uint64(0x5555555555555555)
    one = np.uint64(1)
    return ((fp | fp >> one) & odd) | ((fp & fp >> one) & odd) << one


def _near(fp: np.ndarray, grid: np.ndarray, i: int, among: np.ndarray) -> np.ndarray:
    """Those of ``among`` within MOST_BITS of row ``i``: first by the Manhattan bound, then exactly."""
    among = among[np.bitwise_count(grid[among] ^ grid[i]) <= MOST_BITS]
    return among[np.bitwise_count(fp[among] ^ fp[i]) <= MOST_BITS]


def _forest(fp: np.ndarray, grid: np.ndarray) -> tuple[list[int], list[int]]:
    """The groups that links make among the rows of one cell: the first row of each with each of its others."""
    rest, us, vs = np.arange(len(fp)), [], []
    while len(rest) > 1:
        first, rest = int(rest[0]), rest[1:]
        queue = deque([first])
        while queue and len(rest):
            found = _near(fp, grid, queue.popleft(), rest)
            if len(found):
                us += [first] * len(found)
                vs += found.tolist()
                queue += found.tolist()
                rest = np.setdiff1d(rest, found, assume_unique=True)
    return us, vs


def _links(fp: np.ndarray, rep: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run; ``first`` holds where the runs start, and the end."""
    grid, size = _unary(fp), np.diff(first)
    us, vs = [], []
    small = np.repeat(size <= 8, size)
    run = np.repeat(np.arange(len(size)), size)
    for d in range(1, min(8, len(fp))):
        at = np.flatnonzero((run[:-d] == run[d:]) & small[d:])
        if not len(at):
            break
        at = at[np.bitwise_count(grid[at] ^ grid[at + d]) <= MOST_BITS]
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= MOST_BITS]
        us.append(at)
        vs.append(at + d)
    for k in np.flatnonzero(size > 8):
        # The smallest document stands for its group, so that no document has many smaller ones in the component rounds.
        by = first[k] + np.argsort(rep[first[k] : first[k + 1]], kind="stable")
        u, v = _forest(fp[by], grid[by])
        us.append(by[u])
        vs.append(by[v])
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    return rep[u], rep[v]


_CELLS = ("grid", "cell", "i", "j")
_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("grid", pa.int32()), ("cell", pa.int64()), ("block", pa.int32())])


def _found(u, v, grid=None, cell=None, block=None) -> pa.RecordBatch:
    rest = (np.full(len(u), -1) if x is None else x for x in (grid, cell, block))
    kinds = (np.int64, np.int64, np.int32, np.int64, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(k)) for x, k in zip((u, v, *rest), kinds)], schema=_FOUND)


class _Cells:
    """Reads rows sorted by cell and holds those of one unfinished cell, ``limit`` at most, besides the batch."""

    def __init__(self, limit: int):
        self.limit = limit
        self.kept: list[np.ndarray] | None = None
        self.large: tuple | None = None  # the cell that is being dealt into blocks
        self.given = 0  # its rows so far

    def read(self, cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        if self.kept is not None:
            cols = [np.concatenate(x) for x in zip(self.kept, cols)]
        n = len(cols[0])
        if not n:
            return
        change = np.zeros(n - 1, bool)
        for c in cols[:4]:
            change |= c[1:] != c[:-1]
        first = np.concatenate([[0], np.flatnonzero(change) + 1, [n]])
        size = np.diff(first)
        large = size > self.limit
        large[0] |= tuple(int(c[0]) for c in cols[:4]) == self.large
        for k in np.flatnonzero(large):
            a, b = first[k], first[k + 1]
            cell = tuple(int(c[a]) for c in cols[:4])
            self.given = self.given if self.large == cell else 0
            yield _found(cols[4][a:b], cols[5][a:b], cols[0][a:b], cols[1][a:b], (self.given + np.arange(b - a)) // self.limit)
            self.large, self.given = cell, self.given + int(b - a)
        end = n if last or large[-1] else first[-2]
        whole = (size > 1) & ~large & (first[1:] <= end)
        if whole.any():
            at = np.flatnonzero(np.repeat(whole, size))
            u, v = _links(cols[4][at].view(np.uint64), cols[5][at], np.concatenate([[0], np.cumsum(size[whole])]))
            if len(u):
                yield _found(u, v)
        self.kept = [c[end:] for c in cols]


def _verify(limit: int):
    """Rows sorted by cell to links (``block`` -1); the rows of a cell over ``limit`` come back dealt into blocks."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(limit)
        for batch in rows:
            yield from cells.read([numbers(batch.column(c)) for c in (*_CELLS, "fp", "rep")], last=False)
        yield from cells.read([np.zeros(0, np.int64)] * 6, last=True)

    return run


def _in_cells(rows: DataFrame, limit: int) -> DataFrame:
    dealt = rows.repartition(*_CELLS).sortWithinPartitions(*_CELLS, "fp")
    return dealt.select(*_CELLS, "fp", "rep").mapInArrow(_verify(limit), "u long, v long, grid int, cell long, block int")


def fingerprint_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs ``(u, v)`` of ``rep`` values that connect just what links of the distinct ``prints(fp, rep)`` connect.

    A link is a pair within MOST_BITS. Small cells give their links, others each group of theirs by its smallest rep.
    """
    masks = F.explode(F.array(*[F.struct(F.lit(i).alias("grid"), F.lit(m).alias("mask")) for i, m in enumerate(grids())]))
    rows = prints.withColumn("point", embedding(F.col("fp"))).select("fp", "rep", "point", masks.alias("g"))
    rows = rows.select("g.grid", F.col("point").bitwiseAND(F.col("g.mask")).alias("cell"), F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "rep")
    found = saved(_in_cells(rows, block), "simhash-links")
    links, large = found.where("block < 0").select("u", "v"), found.where("block >= 0")
    if not large.isEmpty():
        count = large.groupBy("grid", "cell").agg((F.max("block") + 1).alias("blocks"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        pairs = large.join(count, ["grid", "cell"]).select("grid", "cell", "block", other, F.col("u").alias("fp"), F.col("v").alias("rep"))
        pairs = pairs.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        links = links.unionByName(_in_cells(pairs, 2 * block).select("u", "v"))
    return links


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of each row of ``docs(doc_id, text, ...)``.

    A null or wordless text has fingerprint zero and is linked like any other; one or two words are one shingle.
    Rows that repeat a doc_id are one node with each of their fingerprints. A row without doc_id keeps its fingerprint
    and takes the component of the documents that share it, null if there is none. Other columns are not read.
    """
    rows = saved(fingerprints(docs), "simhash-prints")
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    linked = components(fingerprint_links(reps.where("rep is not null"), block))
    named = reps.join(linked, reps.rep == linked.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return spread_join(rows, named, "fp", "doc_id").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component; rows without doc_id stay."""
    dropped = near_duplicates(docs).where("doc_id != component_id").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict = {}
