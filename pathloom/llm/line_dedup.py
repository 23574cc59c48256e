"""Line dedup by a sharded minimal perfect hash.

The 128-bit hashes of the lines that two or more documents hold are dealt to shards of bounded size. Each shard gets a
minimal perfect hash in levels of bit arrays (keys that collide on a level go to the next; a key's rank among the set
bits is its index), which indexes arrays of fingerprints, document counts and smallest documents. Documents probe the
arrays: their line hashes meet a copy of the shard's arrays, streamed past them, and the lines themselves are never
joined. A shard has as many copies as its probes need, so that those of a line in very many documents are dealt out. A line of one document alone is in no shard and its fingerprint matches nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHARES, fresh, numbers, saved, table, utf8

LEAST_CHARS = 10
#: Line hashes in a shard, about.
SHARD_KEYS = 1 << 16
#: Probes, about, for each copy of a shard: a frequent line's are dealt over as many copies as it takes.
COPY_PROBES = 1 << 16
#: Bits of a level for each key.
LOAD = 2


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _digest(key: bytes) -> bytes | None:
    """The hash of a key that is long enough to be dropped."""
    if len(key) < LEAST_CHARS or len(key) < 4 * LEAST_CHARS and len(key.decode()) < LEAST_CHARS:
        return None
    return xxhash.xxh3_128_digest(key)


_HASHES = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])


def _line_hashes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        ids, keys = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
            if doc is not None and text:
                own = {_digest(line_key(x)) for x in text.split(b"\n")} - {None}
                ids += [doc] * len(own)
                keys += own
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], schema=_HASHES)


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(32)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct uint64 keys: level sizes, set bits as bytes, and each key's index."""
    sizes, levels, index = [], [], np.full(len(keys), -1, np.int64)
    rest, before = np.arange(len(keys)), 0
    while len(rest):
        size = max(8, LOAD * len(rest))
        at = (_mix(keys[rest], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        held = alone[at]
        index[rest[held]] = before + rank[at[held]]
        before += int(held.sum())
        rest = rest[~held]
        sizes.append(size)
        levels.append(alone)
    return np.array(sizes, np.int64), np.packbits(np.concatenate(levels) if levels else np.zeros(0, bool)), index


class Shard:
    """The arrays of a shard, probed by key halves."""

    def __init__(self, sizes: bytes, bits: bytes, prints: bytes, counts: bytes, least: bytes):
        self.sizes = np.frombuffer(sizes, np.int64)
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(self.sizes.sum())).astype(bool)
        self.rank = np.cumsum(self.bits) - 1
        self.prints, self.counts, self.least = (np.frombuffer(x, k) for x, k in ((prints, np.uint64), (counts, np.int64), (least, np.int64)))

    def probe(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the shard, and the index of each."""
        index, rest, start = np.full(len(low), -1, np.int64), np.arange(len(low)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = start + (_mix(low[rest], level) % np.uint64(size)).astype(np.int64)
            held = self.bits[at]
            index[rest[held]] = self.rank[at[held]]
            rest, start = rest[~held], start + size
        known = index >= 0
        known[known] = self.prints[index[known]] == high[known]
        return known, index


def _halves(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(utf8(column)), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


_SHARD = "shard int, sizes binary, bits binary, prints binary, counts binary, least binary"


def _build(rows: pa.Table) -> pa.Table:
    low, high = _halves(rows.column("key").combine_chunks())
    sizes, bits, index = build_index(low)
    prints, counts, least = np.zeros(len(low), np.uint64), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
    prints[index], counts[index], least[index] = high, rows.column("n").to_numpy(), rows.column("least").to_numpy()
    arrays = (sizes, bits, prints, counts, least)
    return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32())} | {n: pa.array([a.tobytes()], pa.binary()) for n, a in zip(("sizes", "bits", "prints", "counts", "least"), arrays)})


def shared_lines(hashes: DataFrame) -> DataFrame:
    """``(key, n, least)`` of the lines in two or more documents: how many rows hold it, and its smallest doc_id."""
    of = hashes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return of.where("least < most").select("key", "n", "least")


def _probe(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that a shard's arrays come before its probes; gives the probes whose line is to be dropped."""
    shard = None
    for batch in rows:
        held = np.flatnonzero(batch.column("sizes").is_valid().to_numpy(zero_copy_only=False)).tolist()
        for a, b in zip([-1, *held], [*held, batch.num_rows]):
            if a >= 0:
                shard = Shard(*(batch.column(c)[a].as_py() for c in ("sizes", "bits", "prints", "counts", "least")))
            if b > a + 1 and shard is not None:
                part = batch.slice(a + 1, b - a - 1)
                known, index = shard.probe(*_halves(part.column("key")))
                known[known] = (shard.least[index] < numbers(part.column("doc_id")))[known] & (shard.counts[index] > 1)[known]
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(known)) for c in ("doc_id", "key")], schema=_HASHES)


def copies_of(probes: DataFrame, shards: int, copy_probes: int = COPY_PROBES) -> tuple[int, DataFrame]:
    """How many copies a shard has, and ``(shard, _copies)`` of those that have more for the probes of frequent lines.

    More is for shards with over 1 / SHARES of all probes and twice the mean; there are SHARES of them at most.
    """
    total = probes.count()
    usual = max(1, math.ceil(total / shards / copy_probes))
    limit = max(2 * usual * copy_probes, total // SHARES)
    n = probes.groupBy("shard").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    return usual, n.select("shard", F.ceil(F.col("_n") / copy_probes).cast("int").alias("_copies"))


def lines_to_drop(docs: DataFrame, shard_keys: int = SHARD_KEYS, copy_probes: int = COPY_PROBES) -> DataFrame:
    """``(_doc, _keys)``: the hashes of the lines that a document loses."""
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hashes = saved(text.mapInArrow(_line_hashes, "doc_id long, key binary"), "line-hashes")
    shared = saved(shared_lines(hashes), "shared-lines")
    shards = max(1, math.ceil(shared.count() / shard_keys))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    probes = hashes.select(shard, "doc_id", "key")
    usual, more = copies_of(probes, shards, copy_probes)
    more, copies = F.broadcast(saved(more, "shard-copies")), F.coalesce("_copies", F.lit(usual))
    index = shared.select(shard, "key", "n", "least").groupBy("shard").applyInArrow(_build, _SHARD).join(more, "shard", "left")
    index = index.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    probes = probes.join(more, "shard", "left").withColumn("copy", F.pmod(F.xxhash64("doc_id"), copies).cast("int")).drop("_copies")
    both = probes.unionByName(index, allowMissingColumns=True).repartition("shard", "copy")
    both = both.withColumn("kind", F.col("sizes").isNull()).sortWithinPartitions("shard", "copy", "kind")
    found = both.select("doc_id", "key", "sizes", "bits", "prints", "counts", "least").mapInArrow(_probe, "doc_id long, key binary")
    return found.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("key").alias("_keys"))


def _strip(keys_name: str, kept_names: list[str]):
    """The kept text in place of each text, and how many lines there were and were lost."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            kept, total, lost = [], [], []
            for text, keys in zip(utf8(batch.column("text")), batch.column(keys_name).to_pylist()):
                lines = (text or b"").split(b"\n")
                total.append(len(lines))
                if keys:
                    drop = set(keys)
                    lines = [x for x in lines if _digest(line_key(x)) not in drop]
                    text = b"\n".join(lines)
                lost.append(total[-1] - len(lines))
                kept.append(text or b"")
            columns = {n: batch.column(n) for n in batch.schema.names if n != keys_name}
            columns["text"] = pa.array(kept, pa.binary()).cast(pa.string())
            columns |= zip(kept_names, (pa.array(total, pa.int64()), pa.array(lost, pa.int64())))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def dedup_lines(docs: DataFrame, shard_keys: int = SHARD_KEYS, copy_probes: int = COPY_PROBES) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the kept text, and two columns at the end: lines before, and lines lost.

    They are named ``_lines`` and ``_lost``, with more underscores if docs has such columns. A line's key is the line
    stripped of ASCII white space with A-Z in lower case. A line whose key has LEAST_CHARS code points or more and
    stands in several documents stays only in the one with the smallest doc_id, there each time. A null or empty text
    is one empty line and comes back empty. A row without doc_id loses nothing and counts for nothing; rows that repeat
    a doc_id are one document. Other columns pass unchanged.
    """
    doc, keys, *ends = fresh(docs.columns, "_doc", "_keys", "_lines", "_lost")
    drops = lines_to_drop(docs, shard_keys, copy_probes).withColumnsRenamed({"_doc": doc, "_keys": keys})
    rows = docs.withColumn("text", F.col("text").cast("string"))
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{n} long" for n in ends])
    return rows.join(drops, rows["doc_id"] == drops[doc], "left").drop(doc).mapInArrow(_strip(keys, ends), kinds)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("_lines").alias("n_lines"), F.col("_lost").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


_WS = r"\x20\x09-\x0D"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES = {
    "op10_line_dedup": f"""
with lines as (
  select doc_id, l.line as line, l.i as i,
         translate(regexp_replace(regexp_replace(l.line, '^[{_WS}]+', ''), '[{_WS}]+$', ''), '{_UPPER}', '{_LOWER}') as k
  from (select doc_id, unnest(list_transform(range(1, len(s) + 1), lambda j: {{'line': s[j], 'i': j}})) as l
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents))),
firsts as (select k, min(doc_id) as least from lines where length(k) >= {LEAST_CHARS} group by k having count(distinct doc_id) >= 2),
marked as (select lines.*, coalesce(doc_id > least, false) as lost from lines left join firsts using (k))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where lost)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not lost), '')) as kept_sha256
from marked group by doc_id"""
}
