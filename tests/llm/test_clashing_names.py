"""Operators on tables that have columns with the operators' own names."""

from pyspark.sql import functions as F

from pathloom.llm import decontamination, embeddings, langid, line_dedup, packing, secrets, simhash, substrings

EXTRA = ["_doc", "_keys", "_lines", "_lost", "_lang", "_score", "_dropped", "_leaked", "fp", "rep", "node", "component", "key", "value", "base", "more", "owner", "words", "seeds",
         "item_id", "prefix", "anchor", "doc", "windows", "_anchors", "_windows", "k1", "k2", "dim", "shard", "query", "copies", "u", "v", "n", "kept", "length", "_live"]


def table(spark, rows, kind):
    return spark.createDataFrame(rows, kind).withColumns({c: F.lit(c) for c in EXTRA if c not in kind.split()})


def test_documents(spark):
    docs = table(spark, [(1, "one shared line of text\nown line here", "en", "a"), (2, "one shared line of text", "en", "b"), (3, None, None, None)], "doc_id long, text string, lang string, source string")
    items = table(spark, [(1, "one shared line of text")], "item_id long, text string")
    lines = line_dedup.dedup_lines(docs)
    assert lines.columns == [*docs.columns, "__lines", "__lost"]
    assert sorted(r["__lost"] for r in lines.collect()) == [0, 0, 1]
    assert [r["_keys"] for r in lines.select("_keys").distinct().collect()] == ["_keys"]
    known = langid.keep_known(docs)
    assert known.columns == docs.columns and known.count() == 2
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(docs).count() == 3
    assert simhash.near_duplicates(docs).count() == 3
    assert decontamination.contaminated(docs, items).count() == 2
    clean = decontamination.keep_clean(docs, items)
    assert clean.columns == docs.columns and [r.doc_id for r in clean.collect()] == [3]
    assert substrings.dedup_substrings(docs).count() == 3
    assert secrets.scan(docs).count() == 3
    assert packing.pack(docs, packing.word_tokenizer()).select("doc_id").distinct().count() == 3


def test_vectors(spark):
    rows = table(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None)], "vec_id long, embedding array<float>")
    assert sorted(r.n_links for r in embeddings.near_vectors(rows).collect()) == [0, 1, 1]
