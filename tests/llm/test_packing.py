import zlib
from collections import defaultdict

import numpy as np
import pytest

from pathloom.llm import packing

TOKENIZER = packing.word_tokenizer()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


TEXTS = [
    (1, "Hello  World's\tend, it's 1234!"), (2, None), (3, ""), (4, " \n "), (5, "<|endoftext|> x<|startoftext|>y"), (6, "word " * 9000),
    (7, "ÉTÉ ΣΑΣ ΟΔΟΣ é  a b\x1cc \x85 ﬁ İstanbul"), (8, "a" * 5000), (9, "once"), (9, "again"), (None, "no id"),
] + [(100 + k, " ".join(f"w{k}x{j}" for j in range(k * 7 % 300))) for k in range(120)]


def test_round_trip(spark, tokenizer):
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in TEXTS], "doc_id long, text string, length long, sequence_id string").repartition(3)
    rows = packing.pack(df, TOKENIZER).collect()
    want = {}
    for d, t in TEXTS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(d, []).append(np.array(ids, "<u4").tobytes())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for d, texts in want.items():
        if len(texts) > 1:
            assert sorted(r.ids_crc32 for r in pieces[d]) == sorted(map(zlib.crc32, texts))
            continue
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(texts[0]) // 4
            assert r.ids_crc32 == zlib.crc32(texts[0][4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(texts[0]) // 4
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)


def test_ids_are_the_tokenizers(tokenizer):
    import pyarrow.parquet as pq

    tokens = packing.Tokens(TOKENIZER)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    texts += ["".join(chr(c) for c in range(a, a + 16)) for a in range(0, 0x3000, 16)] + [f"{chr(c)} a{chr(c)}b {chr(c)}{chr(c)}'s" for c in range(0x20, 0x3000)]
    texts += ["I'LL they'd''s '' 's't o'r x'revel don't", "snake_case __init__ a_1_b ___", "x²y³ ¼½¾ ª º µ ß ŉ Ǆ", "<|endoftext|>", "<|Endoftext|> < |", "e\u0301 \u0301"]
    for t in texts:
        assert tokens.ids(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t[:60])


def test_least_sum_of_squares():
    rng = np.random.default_rng(2)
    packer, levels = packing.Packer(0, window=16, most_open=10_000), [0] * 17
    for k in range(400):
        n = int(rng.integers(1, 16))
        def cost(h):
            after = levels[:]
            if h:
                after[h] -= 1
            if h + n < 16:
                after[h + n] += 1
            return sum(x * x for x in after)
        best = min(cost(h) for h in range(16 - n + 1) if not h or levels[h])
        packer.add(k, b"\0" * 4 * n)
        levels = packer.level.tolist()
        assert sum(x * x for x in levels) == best
        assert packer.windows == sum(levels)


def test_open_windows_are_bounded():
    packer = packing.Packer(0, window=16, most_open=3)
    for k in range(100):
        packer.add(k, b"\0" * 4 * (9 + k % 6))
        assert packer.windows <= 3
        assert packer.windows == packer.level.sum() == sum(map(len, packer.open.values()))
    packer.flush()
    assert sum(r[2] for r in packer.out) == sum(9 + k % 6 for k in range(100))


def test_only_the_fullest_windows_close_early():
    packer = packing.Packer(0, window=64, most_open=16)
    for k in range(16):
        packer.add(k, b"\0" * 4 * (33 + k))
    assert packer.windows == 16 and not packer.out
    packer.add(16, b"\0" * 4 * 50)
    assert {r[0] for r in packer.out} <= {13, 14, 15, 16} and sum(r[2] for r in packer.out) == 64 * len({r[5] for r in packer.out})
    assert set(range(13)) <= {p[0] for ws in packer.open.values() for w in ws for p in w}


def test_another_tokenizer(spark):
    import glob
    import os

    from tokenizers import Tokenizer

    others = []
    for path in sorted(glob.glob(os.path.join(os.path.dirname(TOKENIZER), "**", "*.json"), recursive=True)):
        try:
            others.append((path, Tokenizer.from_file(path)))
        except Exception:
            continue
    assert others
    for path, tokenizer in others:
        tokens = packing.Tokens(path)
        for t in [x for _, x in TEXTS[:9]] + ["e\u0301 Ünïcode \U0001f600 x"]:
            assert tokens.ids(t) == np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), (path, t)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).collect() == []
