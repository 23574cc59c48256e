"""The pipeline against plain versions of its stages."""

import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from pathloom.llm import decontamination, langid, line_dedup, packing

from .test_decontamination import plain_tiles
from .test_line_dedup import expected as plain_lines
from .test_simhash import expected as plain_simhash

DATA = "/root/testdata/sf0.001"


def plain_leaked(rows, items):
    seeds = defaultdict(set)
    split = {i: decontamination.words(t) for i, t in items}
    for i, w in split.items():
        for k in range(len(w) - 4):
            seeds[tuple(w[k : k + 5])].add(i)
    out = set()
    for d, t in rows:
        w = decontamination.words(t)
        for i in set().union(*[seeds.get(tuple(w[k : k + 5]), ()) for k in range(len(w) - 4)]):
            if sum(n for _, _, n in plain_tiles(w, split[i], 5)) >= 0.8 * len(split[i]):
                out.add(d)
    return out


def test_against_plain_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    profiles = langid.fit(langid.training_rows(docs))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    least = {r._name: r._least for r in langid.least_scores(langid.training_rows(docs), profiles).collect()}
    found = {t: profiles.predict(t) for _, t in rows}
    rows = [(d, t) for d, t in rows if found[t][0] != "und" and found[t][1] >= least[found[t][0]]]
    rows = [(d, t) for d, _, _, t in plain_lines(rows)]
    one = {d for d, _, c in plain_simhash(rows) if d == c}
    rows = [(d, t) for d, t in rows if d in one]
    leaked = plain_leaked(rows, items)
    assert leaked
    rows = [(d, t) for d, t in rows if d not in leaked]
    tokenizer = Tokenizer.from_file(packing.word_tokenizer())
    want = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for d, t in rows}
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, DATA).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(want)
    for d, ids in want.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).schema.simpleString() == docs.schema.simpleString()
    lines = corpus_pipeline.lines(spark, docs, DATA).selectExpr("n_chars = length(text) as same").distinct().collect()
    assert [r.same for r in lines] == [True]
    assert line_dedup.LEAST_CHARS == 10


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
