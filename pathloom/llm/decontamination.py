"""Benchmark decontamination by greedy string tiling.

Texts are sequences of words in lower case. A seed is the hash of TILE consecutive words of a benchmark item. The scan
of the documents keeps only the seeds that pass a bit filter, sized by the number of seeds; these are joined to the
items' seeds. A document and an item that share too few seeds to tile enough are dropped by their count. For the others,
tiling marks the longest match of unmarked words on both sides, found by running Karp-Rabin hashes of the longest length
that both sides have in common, again and again until none has TILE words. As the tiles may lie in any order, their
coverage of the item also catches reordered passages. A document is contaminated if its tiles cover COVERAGE of an item,
or PASSAGE words of it, whatever the item's length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, saved, spread_join, table
from .rolling import Powers, Rolled, sequence_hashes

TILE = 5
COVERAGE = 0.8
#: Words of an item, in one tile or several, that count as a leak even where they are a small part of it.
PASSAGE = 13
#: Bits of the filter for each seed, about, and bits at least and at most, as powers of two: 16 MB are broadcast at
#: most. A larger benchmark fills the filter and lets more documents through to the join; none is lost.
SEED_BITS = 16
LEAST_FILTER, MOST_FILTER = 16, 27

#: Documents, each with an item, that Python gets at a time.
BATCH_ROWS = 256

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[bytes]:
    return " ".join(_WORD.findall(text.lower())).encode().split(b" ") if text and _WORD.search(text) else []


class _Free:
    """The starts on one side from which TILE free words may match, and the hashes of longer windows of such starts."""

    def __init__(self, words: list[bytes], ids: np.ndarray, least: int, powers: Powers):
        self.ids, self.least, self.rolled = ids, least, Rolled(words, powers)
        self.taken = np.zeros(len(ids), bool)
        self.open = np.ones(len(ids) - least + 1, bool)

    def keep(self, hashes: np.ndarray) -> None:
        """Only starts whose seed is one of these."""
        self.open &= np.isin(self.rolled.grams(self.least), hashes)

    def take(self, at: int, n: int) -> None:
        self.taken[at : at + n] = True
        self.open[max(0, at - self.least + 1) : at + n] = False

    def measure(self) -> int:
        """Look at the starts as they are now; gives the most words of a window."""
        self.starts = np.flatnonzero(self.open)
        if not len(self.starts):
            return 0
        # Windows of consecutive starts: how many follow each.
        last = np.flatnonzero(np.append(np.diff(self.starts) != 1, True))
        self.words = self.starts[last[np.searchsorted(last, np.arange(len(self.starts)))]] - self.starts + self.least
        return int(self.words.max())

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The starts of windows of ``n`` words, and their hashes."""
        at = self.starts[self.words >= n]
        return at, self.rolled.windows(at, n)


def tiles(doc: list[bytes], item: list[bytes], least: int = TILE, powers: Powers | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(start in doc, start in item, words)``: the longest first, of equals the first in item, then doc.

    Memory is linear in both texts. Each length of a tile costs a search by halving, and there are few lengths, as
    tiles do not overlap in the item.
    """
    if min(len(doc), len(item)) < least:
        return []
    powers, names = powers or Powers(), {}
    i_ids = np.array([names.setdefault(w, len(names)) for w in item])
    d_ids = np.fromiter(map(names.get, doc, repeat(-1)), np.int64, len(doc))
    d, i = _Free(doc, d_ids, least, powers), _Free(item, i_ids, least, powers)
    d.keep(i.rolled.grams(least))
    i.keep(d.rolled.grams(least)[d.open])
    found, top = [], len(item)

    def common(n: int) -> bool:
        return bool(np.isin(i.windows(n)[1], d.windows(n)[1]).any())

    while True:
        top = min(top, d.measure(), i.measure())
        if top < least or not common(least):
            return found
        low, high = least, top + 1  # low has a common window, high none
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if common(middle) else (low, middle)
        at_doc, h_doc = d.windows(low)
        by = np.lexsort((at_doc, h_doc))
        at_doc, h_doc = at_doc[by], h_doc[by]
        at_item, h_item = i.windows(low)
        begin, end = np.searchsorted(h_doc, h_item, "left"), np.searchsorted(h_doc, h_item, "right")
        next_of: dict[int, int] = {}  # where a run of equal hashes is still free
        for b, first, stop in zip(at_item[begin < end].tolist(), begin[begin < end].tolist(), end[begin < end].tolist()):
            if i.taken[b : b + low].any():
                continue
            k = next_of.get(first, first)
            while k < stop and d.taken[at_doc[k] : at_doc[k] + low].any():
                k += 1
            next_of[first] = k
            while k < stop and (d.taken[at_doc[k] : at_doc[k] + low].any() or (d_ids[at_doc[k] : at_doc[k] + low] != i_ids[b : b + low]).any()):
                k += 1  # another sequence of the same hash
            if k < stop:
                a = int(at_doc[k])
                found.append((a, b, low))
                d.take(a, low)
                i.take(b, low)
                if next_of[first] == k:
                    next_of[first] = first + int(np.searchsorted(at_doc[first:stop], a + low))
        top = low - 1


_SEEDS = pa.schema([("item_id", pa.int64()), ("words", pa.string()), ("size", pa.int64()), ("seed", pa.int64()), ("n", pa.int64())])


def _item_seeds(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in rows:
        out = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            own = words(text)
            seeds, n = np.unique(sequence_hashes(own, TILE, powers).view(np.int64), return_counts=True)
            joined = b" ".join(own).decode()
            out += [(item, joined, len(own), *x) for x in zip(seeds.tolist(), n.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out) if out else [[]] * 5, _SEEDS)], schema=_SEEDS)


def filter_bits(seeds: int) -> int:
    return min(MOST_FILTER, max(LEAST_FILTER, (SEED_BITS * seeds).bit_length()))


def _places(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return (seeds & mask).astype(np.int64), (seeds >> np.uint64(32) & mask).astype(np.int64)


def seed_filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """The bits that the seeds set, as bytes; the driver gets at most ``2 ** bits / 64`` words, however many seeds."""
    mask = F.lit((1 << bits) - 1)
    places = F.explode(F.array(F.col("seed").bitwiseAND(mask), F.shiftrightunsigned("seed", 32).bitwiseAND(mask)))
    part = seeds.select(places.alias("p")).selectExpr("shiftright(p, 6) AS word", "shiftleft(1L, CAST(p & 63 AS INT)) AS bit")
    found = part.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    held = np.zeros(1 << bits - 6, np.uint64)
    held[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return held.view(np.uint8)


_HITS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("seeds", pa.list_(pa.int64()))])


def _scan(held: np.ndarray, bits: int, least: int):
    """The seeds of each text that pass the filter, where they are ``least`` or more."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in rows:
            ids, keys, seeds = [], [], []
            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))):
                own = words(text)
                hashes = sequence_hashes(own, TILE, powers)
                keep = np.ones(len(hashes), bool)
                for place in _places(hashes, bits):
                    keep &= (held[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
                held_seeds = np.unique(hashes[keep].view(np.int64))
                if len(held_seeds) >= least:
                    ids.append(doc)
                    keys.append(key)
                    seeds.append(held_seeds)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(seeds, pa.list_(pa.int64()))], schema=_HITS)

    return run


_TILED = "doc_id long, item_id long, n_tiles long, covered long, item_words long, coverage double"


def _tile(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in rows:
        out = []
        for doc, item, text, other in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "item_words"))):
            other = other.encode().split(b" ")
            found = tiles(words(text), other, TILE, powers)
            covered = sum(n for _, _, n in found)
            out.append((doc, item, len(found), covered, len(other), covered / len(other)))
        columns = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64()] * 5 + [pa.float64()]
        names = [x.split()[0] for x in _TILED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, bits: int | None = None, passage: int | None = None) -> DataFrame:
    """``(doc_id, item_id, n_tiles, covered, item_words, coverage)`` of documents that tile enough of an item.

    Enough is ``coverage`` of its words, or ``passage`` of them if that is given. A tile of ``n`` words holds ``n - 4``
    seeds, so that ``m`` seeds of an item, counted where they stand in it, cover ``TILE * m`` words at most. Texts come to
    the pairs that this bound leaves, from ``docs``, which is read twice.

    ``docs(doc_id, text, ...)``, ``benchmark(item_id, text, ...)``. Items under TILE words have no seed and match
    nothing, nor do null and empty texts. Repeated rows of a document are tiled each, those of an item once for each
    different text, and the best counts; of ties the one of more covered words, then of more tiles. A long text is tiled whole, in
    memory linear in its words. Rows without doc_id are not looked at. Other columns are not read.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    seeds = saved(items.mapInArrow(_item_seeds, "item_id long, words string, size long, seed long, n long"), "benchmark-seeds")
    known = seeds.agg(F.count(F.lit(1)).alias("seeds"), F.min("size").alias("size"), F.max("n").alias("n")).first()
    bits = filter_bits(known.seeds) if bits is None else bits
    # What the easiest item needs, over what a seed can cover where it stands most often.
    need = coverage * (known.size or 0) if passage is None else min(coverage * (known.size or 0), passage)
    scan = _scan(seed_filter(seeds, bits), bits, max(1, math.ceil(need / (TILE * (known.n or 1)))))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    hits = saved(rows.mapInArrow(scan, "doc_id long, text_key long, seeds array<long>"), "benchmark-hits")
    named = seeds.select("seed", "item_id", F.xxhash64("words").alias("item_key"), "size", "n").distinct()
    own = hits.select("doc_id", "text_key", F.explode("seeds").alias("seed"))
    held = spread_join(own, named, "seed", "doc_id").groupBy("doc_id", "text_key", "item_id", "item_key", "size").agg((TILE * F.sum("n")).alias("most"))
    may = F.col("most") >= coverage * F.col("size")
    pairs = held.where(may if passage is None else may | (F.col("most") >= passage))
    texts = seeds.select("item_id", F.xxhash64("words").alias("item_key"), F.col("words").alias("item_words")).distinct()
    # Saved, so that their size is known when the join with the documents is planned.
    pairs = saved(pairs.join(texts, ["item_id", "item_key"]).select("doc_id", "text_key", "item_id", "item_words"), "benchmark-pairs")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        whole = rows.join(pairs, ["doc_id", "text_key"])
        tiled = saved(whole.select("doc_id", "item_id", "text", "item_words").mapInArrow(_tile, _TILED), "benchmark-tiles")
    enough = F.col("coverage") >= coverage
    enough = enough if passage is None else enough | (F.col("covered") >= passage)
    best = tiled.where(enough).groupBy("doc_id", "item_id")
    of = F.max(F.struct("coverage", "covered", "n_tiles", "item_words")).alias("b")
    return best.agg(of).select("doc_id", "item_id", "b.n_tiles", "b.covered", "b.item_words", "b.coverage")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated."""
    leaked = contaminated(docs, benchmark, passage=PASSAGE).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, docs["doc_id"] == leaked["_leaked"], "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), passage=PASSAGE)


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES: dict = {}
