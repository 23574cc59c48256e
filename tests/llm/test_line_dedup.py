import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from pathloom.llm import line_dedup


def expected(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\r\x0b\x0c"))
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 10:
                held[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(held[key(x)]) < 2 or d == min(held[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


ROWS = [
    (3, "Shared line of text\nown line number 3\nshort\n  SHARED line of text \t"),
    (1, "shared LINE of text\nshared line of text\nown\n"),
    (2, None),
    (4, ""),
    (5, "shared line of text"),
    (6, "éééééééééé\nééééééééé\n shared line of text"),
    (7, "éééééééééé\nééééééééé\nshort\n" + "long " * 40_000),
    (8, "\n".join(f"line number {k:05d}" for k in range(3000))),
    (9, "\n".join(f"LINE number {k:05d} " for k in range(0, 6000, 2))),
    (None, "shared line of text\nshort"),
    (9, "shared line of text\nrepeated doc_id"),
]
KIND = "doc_id long, text string, lang string, key string, least long"


def result(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "en", "k", 1) for d, t in rows], KIND)
    got = line_dedup.dedup_lines(df, **more)
    assert got.columns == [*df.columns, "_lines", "_lost"]
    return sorted(((r.doc_id, r._lines, r._lost, r.text) for r in got.collect()), key=str)


def test_brute_force(spark):
    assert result(spark, ROWS) == expected(ROWS)


def test_many_shards_and_copies(spark):
    frequent = [(100 + k, f"a very frequent line\nline of document {k}") for k in range(400)]
    assert result(spark, ROWS + frequent, shard_keys=200, copy_probes=50) == expected(ROWS + frequent)


def test_frequent_lines_get_more_copies(spark):
    probes = spark.createDataFrame([(k % 8, k) for k in range(800)] + [(3, k) for k in range(5000)], "shard int, doc_id long")
    usual, more = line_dedup.copies_of(probes, 8, 200)
    assert usual == 4 and [tuple(r) for r in more.collect()] == [(3, 26)]


def test_empty(spark):
    assert result(spark, []) == []


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 62, 20_000, dtype=np.uint64))
    sizes, bits, index = line_dedup.build_index(keys)
    assert sorted(index.tolist()) == list(range(len(keys)))
    prints, counts = np.zeros_like(keys), np.full(len(keys), 2)
    prints[index] = keys
    shard = line_dedup.Shard(*(x.tobytes() for x in (sizes, bits, prints, counts, counts)))
    known, at = shard.probe(keys, keys)
    assert known.all() and (at == index).all()
    other = keys + np.uint64(1 << 63)
    assert not shard.probe(other, other)[0].any()


def test_query_digest(spark):
    df = spark.createDataFrame([(1, "only line here")], "doc_id long, text string")
    row = line_dedup.dedup_lines(df).select(F.sha2("text", 256)).first()
    assert row[0] == hashlib.sha256(b"only line here").hexdigest()
