"""Sum-of-squares online packing of token documents into fixed windows.

Each task packs the documents of its partition in order. A level array counts the partially filled windows at each
fill level; a document goes to the level, or to a new window, for which the sum of the squared counts grows least.
Documents over a window fill whole windows first. When too many windows are open, the fullest are closed by cutting:
their pieces run on into full windows, and what is left over is an open window again. At the end all are closed like
that, and the last remainder is cut at powers of two.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table

WINDOW = 4096
END = 2
#: Partially filled windows that a task holds at most.
MOST_OPEN = 2048
#: Words whose ids a worker remembers, about.
CACHE = 300_000


#: Texts with one of these go through the whole tokenizer: beyond Latin letters, where Unicode tables and forms matter,
#: white space on which engines differ, and the start of a special token.
_UNUSUAL = re.compile("[\x85\xa0\u0130\u0250-\U0010ffff]")
_UNUSUAL_ASCII = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: The tokenizer's own split, for other texts in lower case; superscripts and fractions are numbers.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")


def _byte_letters() -> list[str]:
    """The letter that a byte-level model has for each byte: itself where printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


#: What a tokenizers file says of texts if ``Tokens`` may take it word by word.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def _is_by_word(spec: dict) -> bool:
    special = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    return special and spec["model"]["type"] == "BPE" and all(spec[k] == v for k, v in _BY_WORD.items())


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    A tokenizer whose file says that it takes lower-case words, split as above, never joins across white space nor
    across its own split, so that a text's ids are those of its words, which are remembered, and a new word's those of
    its parts. In texts with unusual characters, a word goes through it whole. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = _is_by_word(json.loads(self.tokenizer.to_str()))
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.usual: dict[str, bytes] = {}
        self.unusual: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.model.tokenize(part if part.isascii() and part.isprintable() else "".join([self.letters[b] for b in part.encode()]))
        return b"".join([t.id.to_bytes(4, "little") for t in found])

    def _word(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _usual_word(self, word: str) -> bytes:
        out = []
        for part in _PARTS.findall(word):
            if part not in self.parts:
                self.parts[part] = self._part(part)
            out.append(self.parts[part])
        return b"".join(out)

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if not self.by_word:
            return self._word(text)
        if any(map(text.__contains__, _UNUSUAL_ASCII)) or not text.isascii() and _UNUSUAL.search(text):
            known, make, words = self.unusual, self._word, re.split(r"[\x20\x09-\x0d]+", text)
        else:
            known, make, words = self.usual, self._usual_word, text.lower().split()
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        for held in (self.usual, self.parts, self.unusual):
            if len(held) > CACHE:
                held.clear()
        for word in set(words).difference(known):
            known[word] = make(word)
        return b"".join(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def tokens_of(path: str) -> Tokens:
    """One for each worker, so that tasks after the first find its words known."""
    return Tokens(path)


class Packer:
    """Gives ``(doc_id, start, length, crc32, doc_tokens, sequence, offset)`` for each piece once its window is closed."""

    def __init__(self, first: int, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open, self.next = window, most_open, first
        self.level = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.windows = 0
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, size = len(ids) // 4, 4 * self.window
        whole = total // self.window * size
        for i in range(0, whole, size):
            self._close([(doc, i // 4, ids[i : i + size], total)])
        if whole < len(ids):
            self._place((doc, whole // 4, ids[whole:], total))

    def _place(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        room = self.window - n  # levels from 1 to room can take it
        grow = np.where(self.level[1 : room + 1] > 0, 2 * (self.level[n + 1 :] - self.level[1 : room + 1]) + 2, 1 << 60)
        grow[-1] -= 1  # a full window is counted on no level
        at = room - int(grow[::-1].argmin())  # the fullest of equals
        if grow[at - 1] <= 2 * self.level[n] + 1:
            pieces = self.open[at].pop()
            self.level[at] -= 1
        else:
            at, pieces = 0, []
            self.windows += 1
        pieces.append(piece)
        if at + n == self.window:
            self.windows -= 1
            self._close(pieces)
        else:
            self.level[at + n] += 1
            self.open.setdefault(at + n, []).append(pieces)
        if self.windows > self.most_open:
            self._close_fullest(2 + self.most_open // 8)

    def _close_fullest(self, n: int) -> None:
        """Close the ``n`` fullest windows; a rest that fills no window stays open."""
        held: list[tuple] = []
        while n:
            at = int(np.flatnonzero(self.level)[-1])
            taken = self.open[at][-n:]
            del self.open[at][-n:]
            self.level[at] -= len(taken)
            self.windows -= len(taken)
            held += [p for w in taken for p in w]
            n -= len(taken)
        self._run_on(held, self.window)

    def flush(self) -> None:
        """Close all open windows, the fullest first."""
        held = [p for at in sorted(self.open, reverse=True) for w in self.open[at] for p in w]
        self.level[:], self.open, self.windows = 0, {}, 0
        self._run_on(held, None)

    def _run_on(self, held: list[tuple], size: int | None) -> None:
        """Pieces into windows of ``size``, the last of which stays open; into full ones and powers of two for None."""
        left = sum(len(p[2]) for p in held) // 4
        pieces, room = [], size or self._next_size(left)
        for doc, start, ids, total in held:
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room :]
                pieces.append((doc, start, part, total))
                n = len(part) // 4
                start, room, left = start + n, room - n, left - n
                if not room:
                    self._close(pieces)
                    pieces, room = [], size or self._next_size(left)
        if pieces:
            at = self.window - room
            self.level[at] += 1
            self.windows += 1
            self.open.setdefault(at, []).append(pieces)

    def _next_size(self, left: int) -> int:
        return self.window if left >= self.window else 1 << (left.bit_length() - 1) if left else self.window


_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, most_open: int = MOST_OPEN) -> DataFrame:
    """One row for each piece of each row of ``docs(doc_id, text, ...)``.

    ``tokenizer`` is the path, on every machine, of a tokenizers file. Each row is a document of its own, also where a
    doc_id is null or repeated; a null or empty text has the id ``end`` alone. A long text is cut into whole windows and
    a rest. Of windows that fit as well, the fullest is taken. Sequence ids are unique: the task's partition and a
    number. Other columns are not read.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = tokens_of(tokenizer), Packer(TaskContext.get().partitionId() << 40, window, most_open)
        last = np.array([end], "<u4").tobytes()

        def taken() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], schema=_PIECES)

        for batch in rows:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                packer.add(doc, tokens.ids(text) + last)
            yield taken()
        packer.flush()
        yield taken()

    kinds = ", ".join(f"`{f.name}` long" for f in _PIECES)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, kinds)


def word_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_tokenizer())


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict = {}
