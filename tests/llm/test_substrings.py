import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import substrings as ss


def plain(rows):
    holders = defaultdict(set)
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 12):
            if d is not None:
                holders[tuple(w[i : i + 13])].add(d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and min(holders[tuple(w[i : i + 13])]) < d:
                gone.update(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((d, kept, len(w), len(gone)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(8)
    word = lambda: rng.choice(["Ab", "é", "x", "the", "of"]) + str(rng.randrange(30))
    passage = [word() for _ in range(40)]
    out = [(3, None), (4, ""), (5, " \n "), (6, " ".join(passage[:12])), (7, " ".join(passage[:13])), (8, " ".join(passage))]
    for k in range(10, 60):
        w = [word() for _ in range(rng.randrange(5, 60))]
        a = rng.randrange(40)
        w[rng.randrange(len(w)) : 0] = passage[a : a + rng.randrange(5, 40)] * rng.randrange(1, 3)
        out.append((k, rng.choice([" ", "\n", " \t "]).join(w)))
    out += [(100 + k, out[20][1]) for k in range(30)]  # copies
    out += [(200, "same " * 40_000), (201, "same " * 100), (10, " ".join(passage)), (None, " ".join(passage)), (2, "q " + " ".join(passage[5:30]).upper())]
    return out


@pytest.mark.parametrize("group,together", [(1, 7), (8, 1 << 16), (1 << 16, 100)])
def test_brute_force(spark, group, together):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows()], "doc_id long, text string, doc long, prefix string").repartition(3)
    out = ss.dedup_substrings(df, group, together).collect()
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in out), key=str) == plain(rows())
    for r in out:
        assert sum(b - a for a, b in r.repeats) == r.n_removed and all(b - a >= 13 for a, b in r.repeats)
        assert all(x[1] < y[0] for x, y in zip(r.repeats, r.repeats[1:]))


def test_words_whose_polynomial_hashes_collide(spark):
    thue = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    tail = " ".join(f"w{k}" for k in range(12))
    other = thue.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{thue} {tail}"), (2, f"{other} {tail}"), (3, f"x {thue} {tail} y")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in ss.dedup_substrings(docs).collect()} == {1: 0, 2: 0, 3: 13}


@pytest.mark.parametrize("group", [3, 20])
def test_no_group_exceeds_its_bound(spark, group):
    rng = random.Random(3)
    made = [["a", "b", "c", "d", "e", "f", *rng.choices("xyz", k=3), *rng.choices("pq", k=4)] for _ in range(300)] + [["same"] * 13] * 60
    every = spark.createDataFrame([(" ".join(w) + " ", k) for k, w in enumerate(made)], "suffix string, doc long")
    few, many = ss.grouped(every, ss.LENGTHS, group)
    held = few.collect()
    count = Counter(r.prefix for r in held)
    assert max(count.values()) <= group and len({r.suffix.split(" ")[0] for r in held}) == 1
    assert "same " * 13 in {r.suffix for r in many.collect()} and len(held) + many.count() == len(made)
    size = Counter(tuple(w[:n]) for w in made for n in ss.LENGTHS)
    want, got = defaultdict(set), defaultdict(set)
    for k, w in enumerate(made):
        for prefix in [tuple(w[:n]) for n in ss.LENGTHS if size[tuple(w[:n])] <= group][:1]:
            want[prefix].add(k)
    for r in held:
        got[r.prefix].add(r.doc)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_the_tree_of_a_group():
    rng = random.Random(1)
    made = sorted([" ".join(rng.choices(["a", "b", "é"], k=13)) + " " for _ in range(500)] + ["z " * 13] * 3 + ["z " * 12, "a "])
    split = [x.split() for x in made]
    want = [0] + [next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b))) for a, b in zip(split, split[1:])]
    codes = ss._codes(pa.array([x[:-1] for x in made]), 13, False, {})
    got = ss.shared_words(codes)
    assert got.tolist() == want
    for depth in (1, 4, 12):
        names = [tuple(w[:depth]) for w in split]
        runs = [0] + [int(a != b) for a, b in zip(names, names[1:])]
        whole = [k for k, w in enumerate(split) if len(w) >= depth]
        assert [ss.nodes(got, depth)[k] == ss.nodes(got, depth)[k - 1] for k in whole if k and k - 1 in whole] == [not runs[k] for k in whole if k and k - 1 in whole]


def test_empty(spark):
    assert ss.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shared_anchors_over_batches():
    rng = np.random.default_rng(6)
    anchor = np.sort(rng.integers(0, 200, 300))
    known = rng.random(300) < 0.1
    count = np.bincount(anchor, minlength=200)
    for size in (1, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in (anchor, np.arange(300), np.where(known, ss._COMPARED_SHARED, ss._COMPARED).astype(np.int8))], schema=ss._ANCHORS) for i in range(0, 300, size)]
        got = []
        for b in ss._shared(iter(batches)):
            for doc, packed in zip(b.column("doc").to_pylist(), b.column("anchors").to_pylist()):
                got += [(int(a), doc) for a in np.frombuffer(packed, np.int64)]
        assert sorted(got) == [(int(a), i) for i, a in enumerate(anchor) if count[a] > 1 or known[i]]


def test_anchors_of_sketches(spark):
    """Anchors of several documents, within a batch and between batches, and none of one document's own repeats."""
    rng = np.random.default_rng(7)
    held = [(k // 2, np.unique(rng.integers(0, 400, rng.integers(0, 30)))) for k in range(80)]
    docs = defaultdict(set)
    for doc, anchors in held:
        for a in anchors.tolist():
            docs[a].add(doc)
    for size in (1, 9, 80):
        batches = []
        for i in range(0, 80, size):
            own = held[i : i + size]
            batches.append(pa.RecordBatch.from_arrays([pa.array([d for d, _ in own], pa.int64()), pa.array([a.astype(np.uint64).tobytes() for _, a in own], pa.binary())], names=["doc", "anchors"]))
        rows = [r for b in ss._all_anchors(iter(batches)) for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["state"] == ss._FURTHER, r["anchor"], r["doc"], r["state"]))
        got = set()
        for b in ss._shared(iter([pa.RecordBatch.from_pylist(rows, schema=ss._ANCHORS)])):
            for doc, packed in zip(b.column("doc").to_pylist(), b.column("anchors").to_pylist()):
                got |= {(int(a), doc) for a in np.frombuffer(packed, np.int64)}
        shared = {(a, d) for a, of in docs.items() if len(of) > 1 for d in of}
        assert shared <= got and all(sum(r["anchor"] == a for r in rows) > 1 for a, _ in got)
