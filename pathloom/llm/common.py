"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on one machine, as in tests, it may be unset."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


#: Paths handed out inside each open ``scratch`` block, the innermost last.
_open: list[list[str]] = []


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    for paths in _open[-1:]:
        paths.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators keep meanwhile are removed at the end of the block; write results that need them inside."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write to a table in the shared folder and read it again.

    The shuffles behind the table are dropped once it is written, as nothing reads them again.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table that ``saved`` gave, when nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(spark, folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small intermediate; Spark's cleaner removes the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside hand rows to Python in batches of ``rows`` at most, as for rows of large records."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    with setting(spark, key, str(min(rows, before) if before > 0 else rows)):
        yield


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names with as many more leading underscores as they need to differ from the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each string of an Arrow column, without a round trip over ``str``."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from utf8(chunk)
        return
    if column.null_count == len(column):
        yield from (None for _ in range(len(column)))
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield None if valid and not valid[i] else bytes(data[ends[i] : ends[i + 1]])


def numbers(column: pa.Array, kind: type = np.int64, null: int = 0) -> np.ndarray:
    """An integer column as numpy, nulls replaced."""
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(kind, copy=False)


#: Rows of one key from which on they may be dealt to several tasks, and the share of all rows that a key needs for it.
HEAVY = 256
SHARES = 1 << 16


def heavy_keys(rows: DataFrame, key: str, heavy: int = HEAVY) -> DataFrame:
    """``(key, _copies)`` of the keys over the limit, and over how many tasks to deal each.

    The limit is ``heavy`` rows, or 1 / SHARES of all if that is more: there are SHARES such keys at most.
    """
    limit = max(heavy, rows.count() // SHARES)
    count = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    return count.select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_copies"))


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """``rows.join(table, key)`` where keys of many rows are dealt by a hash of ``by`` and met by copies of the table's.

    ``rows`` is read several times. The broadcast keys are SHARES at most, however many rows there are.
    """
    many = checkpointed(heavy_keys(rows, key, heavy))
    if many.isEmpty():
        return rows.join(table, key, how)
    many, copies = F.broadcast(many), F.coalesce("_copies", F.lit(1))
    dealt = rows.join(many, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), copies).cast("int")).drop("_copies")
    copied = table.join(many, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")


#: Links that one task contracts.
CHUNK = 1 << 20


def _contract(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[numbers(batch.column(c)) for c in ("a", "b")] for batch in rows]
    if not parts:
        return
    names, flat = np.unique(np.concatenate([np.concatenate(x) for x in zip(*parts)]), return_inverse=True)
    u, v = flat.reshape(2, -1)
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[u], label[v])
        now = label.copy()
        for at in (u, v, label[u], label[v]):
            np.minimum.at(now, at, least)
        now = now[now]
        if (now == label).all():
            break
        label = now
    other = np.flatnonzero(label != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[label[other]]), pa.array(names[other])], names=["a", "b"])


def contracted(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Saved edges ``(a, b)`` that connect the same nodes: tasks of about ``chunk`` edges each give a star for each of their groups."""
    edges = saved(edges, "links")
    tasks = max(1, -(-edges.count() // chunk))
    stars = edges.repartition(tasks).mapInArrow(_contract, "a long, b long")
    out = saved(stars.distinct() if tasks > 1 else stars, "links")
    dropped(edges)
    return out


def components(edges: DataFrame, chunk: int = CHUNK, heavy: int = HEAVY) -> DataFrame:
    """Connected components of ``edges(u, v)`` as ``(node, component)``, component being the smallest node.

    Rounds of contraction within tasks and, while tasks disagree, of alternating large-star and small-star steps; these
    are grouped minimums and joins that deal out the edges of a hub, so that no neighbourhood meets in one task. Nodes
    without an edge do not appear.
    """
    e = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a < b").distinct()
    while True:
        e = contracted(e, chunk)
        ends = e.select(F.col("b").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(
            e.select(F.col("a").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("root"))
        )
        roles = ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
        if roles.where("leaf > 1 or (leaf > 0 and root > 0)").isEmpty():
            break
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(e.select(F.col("b").alias("x"), F.col("a").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = spread_join(both, least, "x", "y", heavy=heavy).where("y > x").select(F.col("m").alias("a"), F.col("y").alias("b"))
        large = checkpointed(large.distinct())
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = spread_join(large, least, "b", "a", heavy=heavy).where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        e = small.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()
    roots = e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
