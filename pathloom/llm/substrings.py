"""Substring dedup by prefix-partitioned suffix trees.

A suffix starts at a word of a document; two documents share a passage if windows of WINDOW words agree. Documents of
the same words in the same order are one document, the smallest. Suffixes are sampled: each window has an anchor, the
least hash of its six-word sequences and the first of equals, so that equal windows have equal anchors at the same
place. Only suffixes that start at an anchor are kept, each with the words before it that a window around the anchor
may hold, and only if a second document has the anchor. Hashes sample, filter and deal; what repeats is decided by the
words themselves.

The suffixes left are counted by their first words. A prefix names a group that fits in memory: GROUP suffixes at most.
A group's suffixes in order, with the number of words that each shares with the one before, are its suffix tree: a run
of them that share ``d`` words is an internal node of depth ``d``. The leaves of a node that also share ``WINDOW - d``
words before the anchor hold one repeated window; those beyond the smallest document lose it, and the runs of what a
document loses are its maximal repeats. Under a prefix of more than GROUP suffixes, all windows become suffixes of their
own and their prefixes longer, again and again; a whole window that more than GROUP of them hold is one node already
and needs a grouped minimum only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, numbers, saved, spread_join, table, utf8
from .rolling import Powers, Rolled

#: Words of a window and of an anchor.
WINDOW = 13
ANCHOR = 6
#: Words of the prefix of a group of windows, the shortest first; the last is a whole window.
LENGTHS = (ANCHOR + 1, 10, WINDOW)
#: Suffixes of a group at most.
GROUP = 1 << 16
#: Suffixes of neighbouring documents from which a task makes leaves together, about.
TOGETHER = 1 << 16


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _row_of(digest: bytes) -> int:
    """Tells the rows of one doc_id apart."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _anchors(grams: np.ndarray) -> np.ndarray:
    """The anchor of each window, from the hashes of the sequences of ANCHOR words."""
    least, wide, whole = grams, 1, WINDOW - ANCHOR + 1
    while 2 * wide <= whole:
        least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
    if wide < whole:
        least = np.minimum(least[: len(least) - (whole - wide)], least[whole - wide :])
    return least


def _places(grams: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Where the anchor of each window first stands."""
    at = np.zeros(len(least), np.int64)
    for k in range(WINDOW - ANCHOR, -1, -1):
        at[grams[k : k + len(least)] == least] = k
    return at + np.arange(len(least))


def _runs(x: np.ndarray) -> np.ndarray:
    """Whether each element differs from the one before."""
    return np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)


_SKETCH = "doc long, digest binary, anchors binary"


def _sketches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in rows:
        ids, digests, anchors = [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
            words = (text or b"").split()
            if len(words) >= WINDOW:
                ids.append(doc)
                digests.append(_digest(words))
                anchors.append(np.unique(_anchors(Rolled(words, powers).grams(ANCHOR))).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(anchors, pa.binary())], names=["doc", "digest", "anchors"])


def sketches(rows: DataFrame) -> DataFrame:
    """``(doc, digest, anchors)`` of each row of a window's words or more: the hash of its words and its distinct anchors,
    packed; a saved table."""
    return saved(rows.mapInArrow(_sketches, _SKETCH), "word-sketches")


def copies(every: DataFrame) -> DataFrame:
    """``(doc, digests)``, a row a document: the sequences of words that a smaller document has too, from the sketches."""
    every = every.select("doc", "digest")
    least = every.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    later = spread_join(every, least.select("digest", "least"), "digest", "doc").where("doc > least")
    return saved(later.groupBy("doc").agg(F.collect_set("digest").alias("digests")), "word-copies")


#: A row of an anchor is compared with those of other batches, and may be known to be shared; further ones of a batch are
#: known to be shared and go anywhere.
_COMPARED, _COMPARED_SHARED, _FURTHER = range(3)
_ANCHORS = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("state", pa.int8())])


def _all_anchors(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches to a row for each anchor of a batch, and one for each of its documents where there are several."""
    for batch in rows:
        packed = [np.frombuffer(x, np.uint64) for x in utf8(batch.column("anchors"))]
        anchor = np.concatenate([np.zeros(0, np.uint64), *packed])
        doc = np.repeat(numbers(batch.column("doc")), [len(x) for x in packed])
        by = np.lexsort((doc, anchor))
        anchor, doc = anchor[by], doc[by]
        first = _runs(anchor)
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(anchor)))
        several = np.repeat(doc[start + size - 1] != doc[start], size)
        state = np.where(first, np.where(several, _COMPARED_SHARED, _COMPARED), _FURTHER).astype(np.int8)
        keep = first | several
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (anchor.view(np.int64), doc, state)], schema=_ANCHORS)


_SHARED = pa.schema([("doc", pa.int64()), ("anchors", pa.binary())])


def _packed(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The values of each document, one after the other."""
    by = np.argsort(doc, kind="stable")
    doc, values = doc[by], values[by]
    first = np.flatnonzero(_runs(doc))
    return doc[first], [x.tobytes() for x in np.split(values, first[1:])] if len(doc) else []


def _shared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that the compared ones of an anchor follow each other, to those whose anchor is shared, the anchors of
    a document together.

    Only the first row of an anchor can be waiting for a second one.
    """
    last, least = None, None  # the anchor of the row before; its document while it waits
    for batch in rows:
        anchor, doc, state = (numbers(batch.column(c)) for c in _ANCHORS.names)
        own, known = state != _FURTHER, state != _COMPARED
        out_doc, out_anchor = [], []
        if len(anchor):
            if least is not None and own[0] and anchor[0] == last:
                out_doc.append([least])
                out_anchor.append([last])
            before = np.concatenate([[last == anchor[0] and bool(own[0])], (anchor[1:] == anchor[:-1]) & own[1:] & own[:-1]])
            after = np.concatenate([before[1:], [False]])
            keep = known | before | after
            out_doc.append(doc[keep])
            out_anchor.append(anchor[keep])
            last = int(anchor[-1]) if own[-1] else None
            least = int(doc[-1]) if own[-1] and not keep[-1] else None
        docs, packed = _packed(np.concatenate(out_doc).astype(np.int64), np.concatenate(out_anchor).astype(np.int64)) if out_doc else (np.zeros(0, np.int64), [])
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(packed, pa.binary())], schema=_SHARED)


#: Words before an anchor that a window around it may hold.
BEFORE = WINDOW - ANCHOR
#: A leaf: the words of a suffix, with a space after each, and those before it; its document and row, and where it
#: starts there, as 32-bit numbers. Without words: where windows start that a smaller document of the same task has.
_LEAVES = pa.schema([("suffix", pa.string()), ("left", pa.string()), ("doc", pa.int64()), ("row", pa.int64()), ("at", pa.binary())])
_LEAF = "suffix string, left string, doc long, row long, at binary"
_LOST = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("at", pa.binary())])


def _by_row(doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The starts of each row of a document, one after the other."""
    by = np.lexsort((at, row, doc))
    doc, row, at = doc[by], row[by], at[by]
    first = np.flatnonzero(_runs(doc) | _runs(row))
    return doc[first], row[first], [x.astype(np.int32).tobytes() for x in np.split(at, first[1:])] if len(first) else []


class _Together:
    """The suffixes of neighbouring documents, from which their leaves are made."""

    def __init__(self):
        self.words: list[bytes] = []  # of a suffix, with those before it
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, doc: int, row: int, joined: bytes, rolled: Rolled, at: np.ndarray) -> None:
        n = len(rolled.ends)
        before, after = np.minimum(at, BEFORE), np.minimum(n - at, WINDOW)
        begin, cut, end = rolled.starts[at - before], rolled.starts[at], rolled.ends[at + after - 1]
        self.words += map(joined.__getitem__, map(slice, begin.tolist(), end.tolist()))
        same = np.full(len(at), 1, np.int64)
        self.parts.append((doc * same, row * same, at, before, after, cut - begin))

    def given(self) -> pa.RecordBatch:
        """Of suffixes with equal words all around, those of the smallest document are a leaf for each of its rows."""
        doc, row, at, before, after, cut = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else [np.zeros(0, np.int64)] * 6
        seen: dict[tuple[int, bytes], int] = {}
        name = np.fromiter(map(seen.setdefault, zip(before.tolist(), self.words), range(len(at))), np.int64, len(at))
        by = np.lexsort((at, row, doc, name))
        name, doc, row, at, before, after = name[by], doc[by], row[by], at[by], before[by], after[by]
        first = _runs(name)
        leaf = doc == doc[np.maximum.accumulate(np.where(first, np.arange(len(name)), 0))]
        start = (first | _runs(row) | _runs(doc))[leaf]
        own = np.flatnonzero(leaf)[start]
        cuts = np.split(at[leaf].astype(np.int32), np.flatnonzero(start)[1:]) if len(own) else []
        # In the order of the documents, so that a table of leaves holds overlapping texts side by side.
        by = np.lexsort((at[own], doc[own]))
        own, cuts = own[by], [cuts[k].tobytes() for k in by]
        texts = [self.words[k] for k in name[own]]
        ends = cut[name[own]].tolist()
        lost = [np.zeros((3, 0), np.int64)]
        for l in range(BEFORE + 1):
            hit = ~leaf & (before >= l) & (after >= WINDOW - l)
            lost.append(np.stack([doc[hit], row[hit], at[hit] - l]))
        docs, rows, rest = _by_row(*np.concatenate(lost, axis=1))
        none = pa.nulls(len(docs), pa.string())
        columns = [
            pa.concat_arrays([pa.array([t[e:] + b" " for t, e in zip(texts, ends)], pa.binary()).cast(pa.string()), none]),
            pa.concat_arrays([pa.array([t[: max(0, e - 1)] for t, e in zip(texts, ends)], pa.binary()).cast(pa.string()), none]),
            pa.array(np.concatenate([doc[own], docs])), pa.array(np.concatenate([row[own], rows])), pa.array(cuts + rest, pa.binary()),
        ]
        self.words, self.parts = [], []
        return pa.RecordBatch.from_arrays(columns, schema=_LEAVES)


def _leaves(together: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held = Powers(), _Together()
        for batch in rows:
            for doc, text, anchors, drop in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("_anchors").to_pylist(), batch.column("digests").to_pylist()):
                words = (text or b"").split() if anchors else []
                digest = _digest(words)
                if len(words) < WINDOW or drop and digest in drop:
                    continue
                rolled = Rolled(words, powers)
                grams = rolled.grams(ANCHOR)
                own, shared = _anchors(grams), np.sort(np.frombuffer(b"".join(anchors), np.uint64))
                is_shared = shared[np.minimum(np.searchsorted(shared, own), len(shared) - 1)] == own
                places, joined = np.unique(_places(grams, own)[is_shared]), b" ".join(words)
                for i in range(0, len(places), together):
                    held.add(doc, _row_of(digest), joined, rolled, places[i : i + together])
                    if len(held.words) >= together:
                        yield held.given()
        yield held.given()

    return run


def leaves(docs: DataFrame, sketched: DataFrame, copied: DataFrame, together: int = TOGETHER) -> DataFrame:
    """The sampled suffixes of ``docs(doc_id, text)`` that may repeat, as a saved table of leaves; the sketches go."""
    single = sketched.join(copied, "doc", "left").where("not coalesce(array_contains(digests, digest), false)").select("doc", "anchors")
    # The key isn't a column, as it would be shuffled with the rows.
    key = F.when(F.col("state") == _FURTHER, F.xxhash64("doc")).otherwise(F.col("anchor"))
    dealt = single.mapInArrow(_all_anchors, "anchor long, doc long, state byte").repartition(key).sortWithinPartitions(key, "anchor", "state")
    shared = saved(dealt.mapInArrow(_shared, "doc long, anchors binary"), "shared-anchors")
    dropped(sketched)
    rows = docs.where("doc_id is not null").join(copied, F.col("doc_id") == copied["doc"], "left").select("doc_id", "text", "digests")
    held = shared.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("anchors").alias("_anchors"))
    both = rows.join(held, rows["doc_id"] == held["_doc"])
    out = saved(both.mapInArrow(_leaves(together), _LEAF), "suffixes")
    dropped(shared)
    return out


def _prefix(length: int) -> Column:
    return F.xxhash64(F.lit(length), F.substring_index("suffix", " ", length))


def grouped(suffixes: DataFrame, lengths: tuple[int, ...], group: int = GROUP) -> tuple[DataFrame, DataFrame | None]:
    """The suffixes with the ``prefix`` that names their group, and those under the last length that more than ``group`` have.

    The first word counts that a prefix may have are ``lengths``; the shortest with ``group`` suffixes at most is taken.
    """
    prefix, rest, out, many = _prefix(lengths[0]), suffixes, suffixes, None
    for length, longer in zip(lengths, (*lengths[1:], None)):
        counts = rest.groupBy(_prefix(length).alias("_p")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group)
        many = saved(counts.select("_p"), "prefixes")
        if many.isEmpty():
            dropped(many)
            return out.withColumn("prefix", prefix).drop("_over"), None
        # Of the suffixes under such a prefix, the next longer one counts.
        out = out.drop("_over").withColumn("_p", _prefix(length)).join(many.withColumn("_over", F.lit(True)), "_p", "left").drop("_p")
        if longer is not None:
            prefix, rest = F.when(F.col("_over"), _prefix(longer)).otherwise(prefix), out.where("_over")
            out = out.withColumn("_next", prefix)
            prefix = F.col("_next")
    over = out.where("_over").drop("_over", "_next")
    return out.where("_over is null").withColumn("prefix", prefix).drop("_over", "_next"), over


def _codes(texts: pa.Array, width: int, backwards: bool, words: dict) -> np.ndarray:
    """A number for each word of each text, up to ``width``, from the first or from the last; other than all for none."""
    split = pc.split_pattern(texts, " ")
    flat = split.flatten().dictionary_encode()
    ids = np.array([words.setdefault(w, len(words)) for w in flat.dictionary.to_pylist()], np.int64)
    flat = ids[flat.indices.to_numpy(zero_copy_only=False)] if len(ids) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
    out = np.repeat(-1 - np.arange(len(texts), dtype=np.int64)[:, None], width, axis=1)
    for k in range(width):
        at = ends[1:] - 1 - k if backwards else ends[:-1] + k
        held = (at >= ends[:-1]) & (at < ends[1:])
        out[held, k] = flat[at[held]]
    return out


def shared_words(codes: np.ndarray) -> np.ndarray:
    """How many words each of some sorted suffixes shares with the one before, from the start."""
    differ = codes[1:] != codes[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), codes.shape[1]) if len(codes) else np.zeros(0, int)
    return np.concatenate([[0], lcp])[: len(codes)]


def nodes(lcp: np.ndarray, depth: int) -> np.ndarray:
    """The number of the node of ``depth`` that each suffix is under: a run of those that share so many words."""
    return np.cumsum(lcp < depth) - 1


def _tree(suffix: pa.Array, left: pa.Array, doc: np.ndarray) -> list[np.ndarray]:
    """For 0 to BEFORE words before the anchor, whether each leaf's window from there on is in a smaller document.

    Suffixes come in order, whole groups of them.
    """
    words: dict[str, int] = {"": -(1 << 40)}
    right = _codes(suffix, WINDOW, False, words)
    right = np.where(right == words[""], -1 - np.arange(len(doc))[:, None], right)  # what follows the last space
    back = _codes(left, BEFORE, True, words)
    back = np.where(back == words[""], -1 - np.arange(len(doc))[:, None], back)  # of no words at all
    lcp, name, lost = shared_words(right), np.zeros(len(doc), np.int64), []
    for l in range(BEFORE + 1):
        depth = WINDOW - l
        if l:
            _, word = np.unique(back[:, l - 1], return_inverse=True)
            _, name = np.unique(name * (int(word.max()) + 1) + word, return_inverse=True)
        fits = np.flatnonzero((right[:, depth - 1] >= 0) & (back[:, l - 1] >= 0 if l else True))
        window = nodes(lcp, depth)[fits] * (int(name.max()) + 1) + name[fits] if len(fits) else fits
        _, window = np.unique(window, return_inverse=True)
        least = np.full(len(fits), np.iinfo(np.int64).max)
        np.minimum.at(least, window, doc[fits])
        out = np.zeros(len(doc), bool)
        out[fits] = doc[fits] > least[window]
        lost.append(out)
    return lost


def _trees(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves sorted by prefix and words to the starts of windows that documents lose; a group is held until it is whole."""
    held: list[pa.RecordBatch] = []

    def given(group: pa.Table) -> pa.RecordBatch:
        doc, row = numbers(group.column("doc").combine_chunks()), numbers(group.column("row").combine_chunks())
        lost = _tree(group.column("suffix").combine_chunks(), group.column("left").combine_chunks(), doc)
        at = list(utf8(group.column("at")))
        count = np.array([len(x) // 4 for x in at], np.int64)
        flat = np.frombuffer(b"".join(at), np.int32)
        parts = [np.zeros((3, 0), np.int64)]
        for l, gone in enumerate(lost):
            gone = np.repeat(gone, count)
            parts.append(np.stack([np.repeat(doc, count)[gone], np.repeat(row, count)[gone], flat[gone] - l]))
        docs, rows, starts = _by_row(*np.concatenate(parts, axis=1))
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(rows), pa.array(starts, pa.binary())], schema=_LOST)

    for batch in rows:
        prefix = numbers(batch.column("prefix"))
        if not len(prefix):
            continue
        last = numbers(held[-1].column("prefix"))[-1] if held else None
        change = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
        if held and prefix[0] != last:
            yield given(pa.Table.from_batches(held))
            held = []
        if len(change):
            yield given(pa.Table.from_batches([*held, batch.slice(0, change[-1])]))
            held = []
        held.append(batch.slice(change[-1] if len(change) else 0))
    if held:
        yield given(pa.Table.from_batches(held))


def _windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves to all windows around their anchors, each a suffix without words before it."""
    for batch in rows:
        for suffix, left, doc, row, at in zip(*(batch.column(c).to_pylist() for c in _LEAVES.names)):
            before, words = left.split(" ") if left else [], suffix.split(" ")[:-1]
            starts, texts, cuts = np.frombuffer(at, np.int32), [], []
            for l in range(len(before) + 1):
                if len(words) >= WINDOW - l:
                    texts.append(" ".join(before[len(before) - l :] + words[: WINDOW - l]) + " ")
                    cuts.append((starts - l).tobytes())
            n = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([""] * n, pa.string()), pa.array([doc] * n, pa.int64()), pa.array([row] * n, pa.int64()), pa.array(cuts, pa.binary())], schema=_LEAVES)


_LOSS = "doc long, row long, at binary"


def _in_groups(leaves: DataFrame) -> DataFrame:
    dealt = leaves.repartition("prefix").sortWithinPartitions("prefix", "suffix").select("prefix", *_LEAVES.names)
    return dealt.mapInArrow(_trees, _LOSS)


def lost_starts(docs: DataFrame, sketched: DataFrame, copied: DataFrame, group: int = GROUP, together: int = TOGETHER) -> DataFrame:
    """``(doc, row, at)``: where windows of a row start that a smaller document has too, in pieces; a saved table."""
    every = leaves(docs, sketched, copied, together)
    sampled, over = grouped(every.where("suffix is not null"), (ANCHOR,), group)
    lost = _in_groups(sampled).unionByName(every.where("suffix is null").select("doc", "row", "at"))
    if over is not None:
        windows = saved(over.mapInArrow(_windows, _LEAF), "windows")
        few, many = grouped(windows, LENGTHS, group)
        lost = lost.unionByName(_in_groups(few))
        if many is not None:
            many = saved(many, "frequent-windows")
            least = many.groupBy("suffix").agg(F.min("doc").alias("least"))
            lost = lost.unionByName(spread_join(many, least, "suffix", "doc").where("doc > least").select("doc", "row", "at"))
    out = saved(lost, "lost-windows")
    dropped(every)
    return out


def _cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        kept, total, lost, spans = [], [], [], []
        for text, own, drop in zip(utf8(batch.column("text")), batch.column("_lost"), batch.column("digests").to_pylist()):
            words = (text or b"").split()
            total.append(len(words))
            gone = np.zeros(0, np.int64)
            if len(words) >= WINDOW and (own.is_valid or drop):
                digest = _digest(words)
                if drop and digest in drop:
                    gone = np.arange(len(words) - WINDOW + 1)
                elif own.is_valid:
                    row = _row_of(digest)
                    parts = [p["at"] for p in own.as_py() if p["row"] == row]
                    gone = np.frombuffer(b"".join(parts), np.int32)
            found = []
            if len(gone):
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + WINDOW, -1)
                covered = np.cumsum(edge[:-1]) > 0
                bounds = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]])))
                found = [{"start": int(a), "end": int(b)} for a, b in bounds.reshape(-1, 2)]
                words = [w for w, x in zip(words, covered.tolist()) if not x]
            lost.append(total[-1] - len(words))
            kept.append(b" ".join(words))
            spans.append(found)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        own = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, span)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *own], names=["doc_id", "text", "n_words", "n_removed", "repeats"])


def dedup_substrings(docs: DataFrame, group: int = GROUP, together: int = TOGETHER) -> DataFrame:
    """``(doc_id, text, n_words, n_removed, repeats)`` of each row of ``docs(doc_id, text, ...)``.

    ``text`` is the kept words, one space between, and ``repeats`` the maximal runs of words that went, as word numbers
    ``(start, end)``, end exclusive. A word goes if a window of WINDOW words that covers it also starts in a document
    with a smaller doc_id, as given. A null, empty or blank text has no words; shorter ones than a window stay. A row
    without doc_id loses nothing and takes nothing away; rows that repeat a doc_id are one document, and are told apart
    by 64 bits of their words' hash, as are the texts of copies by 128. Long texts are looked at in pieces of
    ``together`` suffixes. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketched = sketches(docs.where("doc_id is not null"))
    copied = copies(sketched)
    lost = lost_starts(docs, sketched, copied, group, together)
    of = lost.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("row", "at")).alias("_lost"))
    rows = docs.join(copied, docs["doc_id"] == copied["doc"], "left").join(of, docs["doc_id"] == of["_doc"], "left").select("doc_id", "text", "digests", "_lost")
    return rows.mapInArrow(_cut, "doc_id long, text string, n_words long, n_removed long, repeats array<struct<start: long, end: long>>")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


_WS = r"\x20\x09-\x0D"
QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES = {
    "op6_substring_dedup": rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^{_WS}]+') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') as x
        from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w where len(ws) >= {WINDOW})),
firsts as (select x, min(doc_id) as least from win group by x having count(distinct doc_id) > 1),
lost as (select distinct doc_id, unnest(range(i, i + {WINDOW})) as p from win join firsts using (x) where doc_id > least),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from words anti join lost using (doc_id, p) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)"""
}
