"""Language ID by rank-order profiles of character n-grams.

A language's profile ranks its most frequent n-grams of one to three characters, counted over a bounded sample of
labelled rows. A document's own most frequent n-grams, counted over its whole text, are compared with each profile by
the out-of-place distance: the sum of the differences in rank, with the profile's length for an n-gram that it lacks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, saved, table

ORDERS = 3
#: Length of a language's profile, and of a document's.
PROFILE = 400
#: Labelled rows, about, from which the profile of each language is counted.
SAMPLE = 2000
#: Profiles that documents are compared with in one pass.
LANGUAGES_AT_ONCE = 1000
UNKNOWN = "und"
#: The pipeline rejects a document that scores less than this part of a low quantile of its language's labelled rows.
PART, QUANTILE = 0.7, 0.01
#: Characters that are counted at a time.
CHUNK = 1 << 20

_NO_LETTERS = re.compile(r"[\W\d_]+")


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the text's letters, in lower case with a space for all between, as code points in 21 bits each."""
    text = text or ""
    parts = []
    if any(c.isalpha() for c in text):
        line = " " + _NO_LETTERS.sub(" ", text.lower()).strip() + " "
        for i in range(0, len(line), CHUNK):
            codes = np.frombuffer(line[i : i + CHUNK + ORDERS - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
            here, grams, gram = min(CHUNK, len(line) - i), [], codes
            for n in range(1, ORDERS + 1):
                if n > 1:
                    gram = gram[:-1] << np.uint64(21) | codes[n - 1 :]
                grams.append(gram[:here])
            grams = np.sort(np.concatenate(grams))
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            parts.append((grams[first], np.diff(np.append(first, len(grams)))))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = parts[0] if len(parts) == 1 else _merge(*map(np.concatenate, zip(*parts)))
    lettered = keys != 32
    return keys[lettered], counts[lettered]


def top(keys: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The most frequent keys, the smaller first of equals."""
    return keys[np.argsort(-counts, kind="stable")[:n]]


class Profiles:
    """Ranks of n-grams by language: for each n-gram the languages that have it, one after the other."""

    def __init__(self, ranked: dict[str, list[int]], length: int = PROFILE):
        self.names, self.length, self.ranked = sorted(ranked), length, ranked
        grams = [np.array(ranked[n], np.uint64) for n in self.names]
        every = np.concatenate([np.zeros(0, np.uint64), *grams])
        by = np.argsort(every, kind="stable")
        self.lang = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[by]
        self.rank = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])[by]
        self.keys, first = np.unique(every[by], return_index=True)
        self.first = np.append(first, len(every))

    def parts(self, languages: int) -> Iterator[Profiles]:
        """The same in profiles of so many languages, in order."""
        for i in range(0, max(1, len(self.names)), languages):
            yield Profiles({n: self.ranked[n] for n in self.names[i : i + languages]}, self.length)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, the first by name of equals, and one less its part of the largest distance."""
        grams = top(*gram_counts(text), self.length)
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, grams)
        place = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == grams) if len(self.keys) else at[:0]
        begin = self.first[at[place]]
        count = self.first[at[place] + 1] - begin
        held = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        # What an n-gram takes off the largest distance, which it adds where a profile lacks it.
        near = self.length - np.abs(self.rank[held] - np.repeat(place, count))
        near = np.bincount(self.lang[held], near, len(self.names))
        best = int(near.argmax())
        return self.names[best], float(near[best] / (self.length * len(grams)))


_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        of: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            held = of.setdefault(lang, [])
            held.append(gram_counts(text))
            if len(held) == 64:
                of[lang] = [_merge(*map(np.concatenate, zip(*held)))]
        for lang, held in of.items():
            keys, counts = _merge(*map(np.concatenate, zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], schema=_COUNTS)


def chosen(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(text, lang)`` of about ``sample`` rows of each language of ``rows(doc_id, text, lang)``, by a hash of doc_id."""
    rows = rows.where("lang is not null and text is not null").select(F.col("doc_id").cast("long"), "text", "lang")
    sizes = saved(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "languages")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("profile")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.join(sizes, "lang").where(draw < sample / F.col("_n")).select("text", "lang")


def fit(rows: DataFrame, sample: int = SAMPLE, length: int = PROFILE) -> Profiles:
    """Profiles from ``rows(doc_id, text, lang)``, of each language from about ``sample`` rows chosen by a hash of doc_id.

    The driver gets ``length`` n-grams for each language, and nothing of the documents.
    """
    counts = chosen(rows, sample).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")).alias("rank")
    ranked = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).select("lang", "gram", rank).where(F.col("rank") <= length)
    found = ranked.toArrow().sort_by("rank")
    out: dict[str, list] = {}
    for lang, gram in zip(found.column("lang").to_pylist(), found.column("gram").to_pylist()):
        out.setdefault(lang, []).append(gram)
    return Profiles(out, length)


def predict(docs: DataFrame, profiles: Profiles, at_once: int = LANGUAGES_AT_ONCE) -> DataFrame:
    """``docs`` with two columns at the end, ``_lang`` and ``_score``, with more underscores if docs has such columns.

    A null text and one without a letter are ``und`` with score 0. Whole texts count, however long; of languages that
    are as near, the first by name is taken. Rows that repeat a doc_id are predicted each for itself. There is a pass
    over the documents for each ``at_once`` languages. Other columns pass unchanged.
    """
    ends = fresh(docs.columns, "_lang", "_score")
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"{ends[0]} string", f"{ends[1]} double"])

    def within(part: Profiles):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                found = [part.predict(t) for t in batch.column("text").to_pylist()]
                if ends[0] in batch.schema.names:
                    before = zip(batch.column(ends[0]).to_pylist(), batch.column(ends[1]).to_pylist())
                    found = [new if new[1] > old[1] else old for new, old in zip(found, before)]
                    batch = batch.drop_columns(ends)
                own = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, *ends])

        return run

    for part in profiles.parts(at_once):
        docs = docs.mapInArrow(within(part), kinds)
    return docs


def least_scores(rows: DataFrame, profiles: Profiles, sample: int = SAMPLE, part: float = PART, quantile: float = QUANTILE) -> DataFrame:
    """``(_name, _least)``: the score from which on a document is taken for a language, from the rows that ``fit`` reads."""
    scored = predict(chosen(rows, sample).select("text", F.col("lang").alias("label")), profiles)
    of = scored.where(F.col("label") == F.col("_lang")).groupBy(F.col("_lang").alias("_name"))
    return of.agg((part * F.percentile("_score", quantile)).alias("_least"))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; false for a row without doc_id, which isn't learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a language: not ``und``, and not below the least score of the language.

    A language none of whose own labelled rows is predicted as it has no least score.
    """
    training = training_rows(docs)
    profiles = fit(training)
    known = predict(docs, profiles)
    lang, score = known.columns[-2:]
    name, least = fresh(known.columns, "_name", "_least")
    limits = saved(least_scores(training, profiles).withColumnsRenamed({"_name": name, "_least": least}), "least-scores")
    rows = known.where(F.col(lang) != UNKNOWN).join(limits, F.col(lang) == F.col(name), "left")
    return rows.where(F.col(score) >= F.coalesce(F.col(least), F.lit(0.0))).select(*docs.columns)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = fit(training_rows(docs))
    out = predict(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict = {}
