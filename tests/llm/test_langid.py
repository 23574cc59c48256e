import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.llm import langid

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain_top(text, length):
    line = " " + "".join(c if c.isalnum() and not c.isdecimal() else " " for c in text.lower())
    line = " " + " ".join(line.split()) + " "
    grams = Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1))
    del grams[" "]
    key = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return [key(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], key(x[0])))[:length]]


def test_profile_brute_force(monkeypatch):
    text = "Été à la plage: 12 enfants jouaient_au ballon; l'été dure, ß Ünd" * 3
    want = plain_top(text, 400)
    assert langid.top(*langid.gram_counts(text)).tolist() == want
    monkeypatch.setattr(langid, "CHUNK", 10)
    assert langid.top(*langid.gram_counts(text)).tolist() == want


def test_out_of_place_distance():
    rank = {"en": plain_top("the cat and the hat", 50), "fr": plain_top("le chat et le chapeau", 50)}
    profiles = langid.Profiles(rank, 50)
    own = plain_top("the mat", 50)
    away = {k: sum(abs(v.index(g) - i) if g in v else 50 for i, g in enumerate(own)) for k, v in rank.items()}
    name, score = profiles.predict("the mat")
    assert name == min(away, key=away.get) == "en" and score == pytest.approx(1 - away["en"] / (50 * len(own)))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    got = langid.predict(docs, langid.fit(langid.training_rows(docs))).where(langid.held_out(F.col("doc_id"))).select("lang", "_lang", "_score").collect()
    assert len(got) > 200
    assert sum(r.lang == r._lang for r in got) / len(got) > 0.97
    assert all(0 <= r._score <= 1 for r in got)


def test_edges(spark):
    kind = "doc_id long, text string, lang string, rank long, gram long"
    rows = [(1, "the cat sat on the mat and the hat", "en"), (3, "le chat est sur la table et le chapeau", "fr"), (4, None, "en"), (5, "", "fr"), (6, "12 345 __ ²", "en"),
            (7, "the word " * 30_000, None), (None, "the hat", "zz"), (7, "le chapeau", None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], kind)
    training = docs.where("doc_id is not null")
    out = langid.predict(docs, langid.fit(training.select("doc_id", "text", "lang")))
    assert out.columns == [*docs.columns, "_lang", "_score"]
    got = sorted(((r.doc_id, r._lang, r._score > 0) for r in out.collect()), key=str)
    assert got == sorted([(1, "en", True), (3, "fr", True), (4, "und", False), (5, "und", False), (6, "und", False), (7, "en", True), (None, "en", True), (7, "fr", True)], key=str)
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns


def test_more_languages_than_a_pass_takes(spark):
    rng = random.Random(3)
    letters = [rng.sample("abcdefghijklmnopqrstuvwxyzàéîõüßøåçñ", 7) for _ in range(1200)]
    word = lambda k: "".join(rng.choices(letters[k], k=4))
    rows = [(k, " ".join(word(k) for _ in range(30)), f"l{k:04d}") for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.fit(docs, length=60)
    assert len(profiles.names) == 1200
    some = docs.where("doc_id % 20 = 0")
    whole = {r.doc_id: (r._lang, r._score) for r in langid.predict(some, profiles).collect()}
    dealt = {r.doc_id: (r._lang, r._score) for r in langid.predict(some, profiles, at_once=500).collect()}
    assert whole == dealt and all(whole[k][0] == f"l{k:04d}" for k in whole)


def test_what_resembles_no_language_is_rejected(spark):
    rng = random.Random(7)
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(n)) for n in (20, 200, 2000)]
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować"
    docs = spark.read.parquet(DATA).select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate([*junk, polish, "12 34"])], docs.schema)
    kept = {r.doc_id for r in langid.keep_known(docs.unionByName(more)).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.where("text rlike '[A-Za-z]'").select("doc_id").collect()}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    profiles = langid.fit(langid.training_rows(docs))
    assert langid.predict(docs, profiles).first()._lang == "und"
    assert langid.predict(docs.limit(0), profiles).count() == 0
