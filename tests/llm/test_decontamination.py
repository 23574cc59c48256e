import random
import time

import numpy as np

from pathloom.llm import decontamination as dc
from pathloom.llm.rolling import Powers, sequence_hashes


def plain_tiles(doc, item, least):
    """Greedy string tiling word by word."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for b in range(len(item)):
            for a in range(len(doc)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and free_d[a + n] and free_i[b + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (a, b, n)
        if best is None:
            return out
        out.append(best)
        a, b, n = best
        free_d[a : a + n] = free_i[b : b + n] = [False] * n


def test_tiles_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        item = [rng.choice("abcd").encode() for _ in range(rng.randrange(4, 25))]
        doc = [rng.choice("abcd").encode() for _ in range(rng.randrange(0, 40))]
        at = rng.randrange(len(item))
        doc += item[at:] + [b"x"] + item[:at]
        for least in (2, 3, 5):
            assert dc.tiles(doc, item, least) == plain_tiles(doc, item, least)


def test_tiles_of_long_repetitive_texts():
    same, thue = [b"same"] * 200_000, [b"ab"[k.bit_count() % 2 :][:1] for k in range(4096)]
    began = time.process_time()
    assert dc.tiles(same, same[:500]) == [(0, 0, 500)]
    assert dc.tiles(same, [b"same", b"x"] * 200) == []
    assert dc.tiles(thue * 20, thue[100:700]) == [(100, 0, 600)]
    got = dc.tiles(same[:1000] + [b"x"], same[:300] + [b"x"] + same[:300])
    assert got == [(0, 301, 300), (700, 0, 301)][::-1]
    assert time.process_time() - began < 60


def test_pairs_with_few_common_seeds_are_not_tiled(spark, monkeypatch):
    seen = []
    saved = dc.saved

    def count(df, what):
        out = saved(df, what)
        seen.append((what, out.count()))
        return out

    monkeypatch.setattr(dc, "saved", count)
    phrase = "at the end of the day"
    docs = [(k, f"document {k} says {phrase} and no more") for k in range(50)] + [(99, f"{phrase} we counted all the sheep in the green field again")]
    items = [(k, f"{phrase} item {k} has {k} other words that nothing repeats") for k in range(40)] + [(77, docs[-1][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in dc.contaminated(d, b, passage=13).collect()]
    assert got == [(99, 77)] and dict(seen)["benchmark-tiles"] == 1


def test_filter_grows_with_the_seeds():
    assert [dc.filter_bits(n) for n in (0, 10, 100_000, 1 << 40)] == [16, 16, 21, 27]


def test_hashes_depend_on_the_words_alone():
    powers = Powers()
    x, y = [b"q", b"some", b"words", b"here"], [b"\xc3\xa9t\xc3\xa9", b"more", b"some", b"words", b"here"]
    assert sequence_hashes(x, 3, powers)[-1] == sequence_hashes(y, 3, powers)[-1]
    assert len(set(sequence_hashes([b"a", b"aa", b"aaa", b"aa", b"a", b"a"], 2, powers).tolist())) == 5
    assert len(sequence_hashes([b"a"], 2, powers)) == 0


ITEM = "The quick brown fox jumps over the lazy dog near the old river bank at night while seven owls are watching"


def test_documents(spark):
    w = ITEM.split()
    moved = " ".join(w[10:]) + " . between , " + " ".join(w[:10])
    docs = [
        (1, f"before {ITEM} after"), (2, ITEM.upper().replace(" ", ",\n")), (3, moved), (4, " ".join(w[:9])), (5, None), (6, ""),
        (7, " ".join(reversed(w))), (8, ("filler words " * 20_000) + ITEM), (9, "clean text"), (9, ITEM), (None, ITEM), (10, ITEM), (10, ITEM),
    ]
    items = [(1, ITEM), (2, None), (3, ""), (4, "three short words"), (1, ITEM), (5, "five words are long enough")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, words string, item_id long")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    for bits in (None, 24, 8):
        got = {r.doc_id: r for r in dc.contaminated(d, b, bits=bits).collect()}
        assert sorted(got) == [1, 2, 3, 8, 9, 10]
        assert {r.item_id for r in got.values()} == {1}
        assert got[3].n_tiles == 2 and got[3].coverage == 1.0 and got[1].covered == len(w)
    kept = dc.keep_clean(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [4, 5, 6, 7]


def test_empty(spark):
    none_d, none_b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some_d, some_b = spark.createDataFrame([(1, ITEM)], none_d.schema), spark.createDataFrame([(1, ITEM)], none_b.schema)
    assert dc.contaminated(none_d, some_b).collect() == dc.contaminated(some_d, none_b).collect() == []


def test_against_all_pairs(spark):
    rng = random.Random(5)
    item = lambda: [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(6, 30))]
    items = [(k, " ".join(item())) for k in range(20)]
    docs = []
    for k in range(60):
        own = item()
        if k % 2:
            w = items[rng.randrange(20)][1].split()
            cut = rng.randrange(len(w))
            own += w[cut:] + item() + w[: max(0, cut - k % 5)]
        docs.append((k, " ".join(own)))
    want = set()
    for d, t in docs:
        for i, s in items:
            n = sum(x[2] for x in plain_tiles(dc.words(t), dc.words(s), 5))
            if n >= 0.8 * len(s.split()):
                want.add((d, i, n))
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.covered) for r in got.collect()} == want and len(want) > 10
    assert np.all([0.8 <= r.coverage <= 1 for r in got.collect()])


def test_a_long_passage_counts_whatever_the_length_of_the_item(spark):
    w = [f"w{k}" for k in range(100)]
    docs = [(1, "a b " + " ".join(w[20:33])), (2, " ".join(w[20:32])), (3, " ".join(w[:7] + ["x"] + w[50:56])), (4, "clean text of six more words")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    got = {r.doc_id: (r.n_tiles, r.covered) for r in dc.contaminated(d, b, passage=dc.PASSAGE).collect()}
    assert got == {1: (1, 13), 3: (2, 13)}
    assert sorted(r.doc_id for r in dc.keep_clean(d, b).collect()) == [2, 4]
