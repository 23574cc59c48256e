import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pathloom.llm import simhash

DOCS = "doc_id long, text string, lang string, u long, component_id long"


def plain_fingerprint(text):
    words, now = [], ""
    for c in text or "":
        if c == " " or "\x09" <= c <= "\x0d":
            words, now = words + [now] if now else words, ""
        else:
            now += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    words += [now] if now else []
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def expected(rows):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    links = [(a, b) for a, x in prints for b, y in prints if (x ^ y).bit_count() <= 3]
    of = plain_components({d for d, _ in prints}, links)
    return sorted((d, f"{x:016x}", of[d]) for d, x in prints)


def texts():
    rng = random.Random(7)
    base = [" ".join(rng.choice(["Alpha", "beta", "gamma", "Été", "d", "e\tf"]) + str(rng.randrange(40)) for _ in range(120)) for _ in range(6)]
    out = [None, "", " \n\t", "one", "ONE", "one two", "one two three", "one  two\nthree", "x" * 50_000, "a b c d"]
    for b in base:
        for k in range(12):
            w = b.split(" ")
            for _ in range(k // 3):
                w[rng.randrange(len(w))] = f"new{k}"
            out.append(" ".join(w))
    return list(enumerate(out)) + [(3, "one")]


def result(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "en", 1, 2) for d, t in rows], DOCS)
    return sorted(map(tuple, simhash.near_duplicates(df, **more).select("doc_id", "fingerprint", "component_id").collect()))


def test_brute_force(spark):
    assert result(spark, texts()) == expected(texts())


def test_large_cells_are_cut_into_blocks(spark):
    rng = random.Random(3)
    prints, now = [], rng.getrandbits(64)
    for k in range(300):
        if k % 60 == 0:
            now = rng.getrandbits(64)
        prints.append((now ^ (1 << rng.randrange(64)), k))
        now = prints[-1][0] if k % 3 == 0 else now
    prints = list({p: i for p, i in prints}.items())
    links = [(i, j) for p, i in prints for q, j in prints if (p ^ q).bit_count() <= 3]
    want = plain_components([i for _, i in prints], links)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for p, i in prints], "fp long, rep long")
    for block in (2, 7, 4096):
        found = [tuple(r) for r in simhash.fingerprint_links(df, block).select("u", "v").collect()]
        assert plain_components([i for _, i in prints], found) == want
        assert all(want[u] == want[v] for u, v in found) and len(found) < 40 * len(prints)


def test_embedding_is_a_lower_bound(spark):
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) for _ in range(2))
    low = np.bitwise_count(simhash._unary(x) ^ simhash._unary(y))
    assert (low <= np.bitwise_count(x ^ y)).all()
    rows = spark.createDataFrame([(int(v.view(np.int64)),) for v in x[:50]], "fp long")
    got = [r[0] for r in rows.select(simhash.embedding(F.col("fp"))).collect()]
    assert got == simhash._unary(x[:50]).view(np.int64).tolist()


def test_empty_and_keep_one(spark):
    assert result(spark, []) == []
    df = spark.createDataFrame([(5, "a b c d", "x"), (9, "A b  c d", "y"), (1, "other words here now", None), (None, "a b c d", "z")], "doc_id long, text string, lang string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 5]
    groups = defaultdict(list)
    for r in simhash.near_duplicates(df).collect():
        groups[r.component_id].append(r.doc_id)
    assert sorted(groups[5], key=str) == [5, 9, None]
