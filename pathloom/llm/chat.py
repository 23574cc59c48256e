"""Chat formatting by a template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python closures that yield the
rendered text piece by piece, each with a flag that says whether it lies in a generation block. The language is closed:
it reads the keys of given records and nothing else; there are no calls and no attributes of Python objects.

    text   {{ expression }}   {% if e %} {% elif e %} {% else %} {% endif %}
    {% for name in messages %} ... {% endfor %}   {% generation %} ... {% endgeneration %}   {% set name = e %}

A ``-`` next to a tag's braces strips the blanks on that side. In a loop, ``loop`` has the keys ``index``, ``index0``,
``first`` and ``last``; what is set in a round of a loop holds for that round.
Expressions: strings, integers, ``true``, ``false``, ``none``, names, ``name.key``, ``name['key']``, ``==``, ``!=``, ``~`` (joins texts), ``not``, ``and``, ``or``,
brackets and the filters ``escape``, ``trim``, ``upper`` and ``lower``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A turn ends with ``\n</turn>\n``; no ``<`` or ``>`` of a role or a text stays unescaped.
TEMPLATE = (
    "{% for m in messages %}<turn {{ m.role | escape }}>\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}\n</turn>\n{% endfor %}"
)
_CONTROL = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\<>]++|\\.)*+)>\n((?:[^\\<>]++|\\.)*+)(?<=\n)</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """A template that isn't of the language, or a name or key that isn't there."""


_STRING = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
#: A tag ends at the first end of it that stands in no string.
_TAG = re.compile(rf"\{{\{{((?:{_STRING}|(?!\}}\}})[^'\"])*)\}}\}}|\{{%((?:{_STRING}|(?!%\}})[^'\"])*)%\}}", re.S)
_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[=.~|()\[\]]))""", re.S)
_WORDS = {"not", "and", "or", "in", "for", "if", "elif", "else", "endif", "endfor", "generation", "endgeneration", "set"}
_CONSTANTS = {"true": True, "false": False, "none": None}


def _tokens(code: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while code[at:].strip():
        m = _TOKEN.match(code, at)
        if not m:
            raise TemplateError(f"unexpected {code[at:].strip()[:20]!r}")
        string, number, name, sign = m.groups()
        if string is not None:
            plain = {"n": "\n", "t": "\t"}
            out.append(("const", re.sub(r"\\(.)", lambda e: plain.get(e[1], e[1]), string[1:-1], flags=re.S)))
        elif number is not None:
            out.append(("const", int(number)))
        elif name in _CONSTANTS and out[-1:] != [("sign", ".")]:
            out.append(("const", _CONSTANTS[name]))
        else:
            out.append(("sign" if sign or name in _WORDS else "name", sign or name))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one tag. Nodes are tuples: a kind and its parts."""

    def __init__(self, code: str):
        self.rest = _tokens(code)

    def take(self, *signs: str) -> str | None:
        if self.rest and self.rest[0][0] == "sign" and self.rest[0][1] in signs:
            return str(self.rest.pop(0)[1])
        return None

    def name(self) -> str:
        if not self.rest or self.rest[0][0] != "name":
            raise TemplateError("a name is missing")
        return str(self.rest.pop(0)[1])

    def end(self) -> None:
        if self.rest:
            raise TemplateError(f"unexpected {self.rest[0][1]!r}")

    def whole(self) -> tuple:
        node = self.either()
        self.end()
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.denied()
        while self.take("and"):
            node = ("and", node, self.denied())
        return node

    def denied(self) -> tuple:
        return ("not", self.denied()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        while sign := self.take("==", "!="):
            node = (sign, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.take("~"):
            node = ("~", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket isn't closed")
            return node
        if self.rest and self.rest[0][0] == "const":
            return ("const", self.rest.pop(0)[1])
        node: tuple = ("name", self.name())
        while sign := self.take(".", "["):
            if sign == ".":
                node = ("key", node, self.name())
                continue
            kind, key = self.rest.pop(0) if self.rest else ("", "")
            if kind != "const" or not self.take("]"):
                raise TemplateError("a key in brackets has to be a string")
            node = ("key", node, key)
        return node


def parse(template: str) -> tuple:
    """The syntax tree: ``("block", nodes)`` of text, show, if, for and generation nodes."""
    parts: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _TAG.finditer(template):
        kind, code = ("show", m[1]) if m[1] is not None else ("tag", m[2])
        text = template[at : m.start()].lstrip() if strip else template[at : m.start()]
        begin, strip = code.startswith("-"), len(code) > 1 and code.endswith("-")
        parts += [("text", text.rstrip() if begin else text), (kind, code[begin : len(code) - strip])]
        at = m.end()
    parts.append(("text", template[at:].lstrip() if strip else template[at:]))
    parts.reverse()

    def block(ends: tuple[str, ...]) -> tuple[tuple, str, _Expression | None]:
        nodes: list[tuple] = []
        while parts:
            kind, code = parts.pop()
            if kind == "text":
                nodes.append(("text", code))
                continue
            e = _Expression(code)
            if kind == "show":
                nodes.append(("show", e.whole()))
            elif word := e.take(*ends):
                return ("block", nodes), word, e
            elif e.take("generation"):
                e.end()
                inner, _, tail = block(("endgeneration",))
                tail.end()
                nodes.append(("generation", inner))
            elif e.take("for"):
                name = e.name()
                if not e.take("in"):
                    raise TemplateError("'in' is missing")
                source = e.whole()
                inner, _, tail = block(("endfor",))
                tail.end()
                nodes.append(("for", name, source, inner))
            elif e.take("set"):
                name = e.name()
                if not e.take("="):
                    raise TemplateError("'=' is missing")
                nodes.append(("set", name, e.whole()))
            elif e.take("if"):
                nodes.append(branches(e))
            else:
                raise TemplateError(f"unexpected tag {code.strip()!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return ("block", nodes), "", None

    def branches(e: _Expression) -> tuple:
        test = e.whole()
        then, word, tail = block(("elif", "else", "endif"))
        if word == "elif":
            return ("if", test, then, ("block", [branches(tail)]))
        tail.end()
        other: tuple = ("block", [])
        if word == "else":
            other, _, tail = block(("endif",))
            tail.end()
        return ("if", test, then, other)

    return block(())[0]


def _text(value: object) -> str:
    return "" if value is None else str(value)


_PURE: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "~": lambda a, b: _text(a) + _text(b), "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a}


def fold(node: tuple) -> tuple:
    """The same tree with constant expressions computed, constant branches chosen and neighbouring texts joined."""
    kind = node[0]
    if kind in _PURE:
        parts = [fold(x) for x in node[1:]]
        return ("const", _PURE[kind](*(p[1] for p in parts))) if all(p[0] == "const" for p in parts) else (kind, *parts)
    if kind == "filter":
        inner = fold(node[2])
        return ("const", FILTERS[node[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", node[1], inner)
    if kind == "show":
        inner = fold(node[1])
        return ("text", _text(inner[1])) if inner[0] == "const" else ("show", inner)
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "if":
        test, then, other = map(fold, node[1:])
        return (then if test[1] else other) if test[0] == "const" else ("if", test, then, other)
    if kind == "block":
        nodes: list[tuple] = []
        for x in map(fold, node[1]):
            for y in x[1] if x[0] == "block" else [x]:
                if y[0] == "text" and nodes and nodes[-1][0] == "text":
                    nodes[-1] = ("text", nodes[-1][1] + y[1])
                elif y != ("text", ""):
                    nodes.append(y)
        return ("block", nodes)
    return node


def _value(node: tuple) -> Callable[[dict], object]:
    """The closure of an expression."""
    kind = node[0]
    if kind == "const":
        return lambda env, value=node[1]: value
    if kind == "name":

        def look(env: dict, name: str = node[1]) -> object:
            if name not in env:
                raise TemplateError(f"no name {name!r}")
            return env[name]

        return look
    if kind == "key":

        def get(env: dict, of: Callable = _value(node[1]), key: str = node[2]) -> object:
            held = of(env)
            if type(held) is not dict or key not in held:
                raise TemplateError(f"no key {key!r}")
            return held[key]

        return get
    if kind == "filter":
        return lambda env, f=FILTERS[node[1]], of=_value(node[2]): f(_text(of(env)))
    if kind == "not":
        return lambda env, of=_value(node[1]): not of(env)
    a, b = map(_value, node[1:])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    return lambda env, f=_PURE[kind]: f(a(env), b(env))


#: A piece of output and whether it is generated; None ends a round of a loop.
Piece = tuple[str, bool] | None


def _holds(node: object, part: tuple) -> bool:
    return node == part or isinstance(node, (tuple, list)) and any(_holds(x, part) for x in node)


def _rounds(items: Iterable, ahead: bool) -> Iterator[tuple[object, dict[str, object]]]:
    """Items with what ``loop`` says of them. Only to know the last one is an item read ahead."""
    items, end = iter(items), object()
    item, k = next(items, end), 0
    while item is not end:
        held = {"index": k + 1, "index0": k, "first": k == 0}
        after = next(items, end) if ahead else None
        yield item, held | ({"last": after is end} if ahead else {})
        item, k = after if ahead else next(items, end), k + 1


def _yielding(node: tuple, generated: bool = False) -> Callable[[dict], Iterator[Piece]]:
    """The closure of a statement."""
    kind = node[0]
    if kind == "text":
        return lambda env, piece=(node[1], generated): iter((piece,))
    if kind == "show":
        return lambda env, of=_value(node[1]): iter(((_text(of(env)), generated),))
    if kind == "generation":
        return _yielding(node[1], True)
    if kind == "if":
        test, then, other = _value(node[1]), _yielding(node[2], generated), _yielding(node[3], generated)
        return lambda env: then(env) if test(env) else other(env)
    if kind == "for":

        ahead = _holds(node[3], ("key", ("name", "loop"), "last"))

        def loop(env: dict, name: str = node[1], of: Callable = _value(node[2]), body: Callable = _yielding(node[3], generated)) -> Iterator[Piece]:
            for item, held in _rounds(of(env), ahead):
                yield from body({**env, "loop": held, name: item})
                yield None

        return loop
    if kind == "set":

        def put(env: dict, name: str = node[1], of: Callable = _value(node[2])) -> Iterator[Piece]:
            env[name] = of(env)
            return iter(())

        return put
    steps = [_yielding(x, generated) for x in node[1]]

    def block(env: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)

    return block


def compiled(template: str, values: dict[str, object] | None = None) -> Callable[[Iterable[dict]], Iterator[tuple[str, list[tuple[int, int]]]]]:
    """A function from messages to the rendered text, in parts: one for each round of a loop and what lies between.

    Each part comes with the ranges of it that are generated, in code points. Messages may be an iterator: a part is
    given before the next message is read, or the one after it where the template asks for ``loop.last``. ``values``
    are further names, such as ``add_generation_prompt``.
    """
    body = _yielding(fold(parse(template)))

    def render(messages: Iterable[dict]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        texts, spans, size = [], [], 0
        for piece in body({**(values or {}), "messages": messages}):
            if piece is not None:
                texts.append(piece[0])
                if piece[1]:
                    spans.append((size, size + len(piece[0])))
                size += len(piece[0])
            elif texts:
                yield "".join(texts), spans
                texts, spans, size = [], [], 0
        if texts:
            yield "".join(texts), spans

    return render


def _records(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _dealt(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 12) -> Iterator[pa.RecordBatch]:
    """Batches of rows, cut by number and by size of text."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(out) >= most or size >= 1 << 23:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    columns = zip(*out) if out else [[]] * len(schema)
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema)], schema=schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", _SPANS)])


def format_conversations(turns: DataFrame, template: str = TEMPLATE, values: dict[str, object] | None = None) -> DataFrame:
    """``(conv_id, part, formatted, loss)``: the rendered conversations in parts, one for each turn, in order.

    ``turns(conv_id, turn, role, text, ...)``; rows go by turn, of equals by role and text. Null roles and texts are
    empty, and rows without conv_id are one conversation. Repeated rows are turns of their own. ``loss`` holds the generated ranges of the part. A partition
    holds whole conversations with their parts in order. A conversation is streamed, however long. Other columns are
    not read. ``values`` are further names of the template.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template, values)

        def rows() -> Iterator[tuple]:
            for conv, own in groupby(_records(batches, ("conv_id", "role", "text")), itemgetter(0)):
                messages = ({"role": r or "", "text": t or ""} for _, r, t in own)
                for part, (text, spans) in enumerate(render(messages)):
                    yield conv, part, text, [{"start": a, "end": b} for a, b in spans]

        return _dealt(rows(), _FORMATTED)

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, "conv_id long, part long, formatted string, loss array<struct<start: bigint, end: bigint>>")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """``(role, text)`` of the turns in text of the standard template."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2][:-1])
        at = m.end()


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from the text and ranges that ``format_conversations`` gave, with its template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv, own in groupby(_records(batches, ("conv_id", "formatted", "loss")), itemgetter(0)):
                turns, loss, n, lost, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, text, spans in own:
                    size += len(text)
                    for role, said in turns_of(text):
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    for s in spans:
                        said = unescape(text[s["start"] : s["end"]])
                        loss.update(said.encode())
                        lost += len(said)
                yield conv, n, turns.hexdigest(), lost, loss.hexdigest(), size

        return _dealt(rows(), _DIGEST)

    return formatted.mapInArrow(run, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in _DIGEST))


#: A conversation whose texts look like markers.
PROBE = (-7, (("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE[0], k, role, text) for k, (role, text) in enumerate(PROBE[1])], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(probe)))


_ESC = r"length({0}) + length(regexp_replace({0}, '[^\\<>]', '', 'g'))"
QUERIES = {"op9_chat_format": op9_chat_format}
ORACLES = {
    "op9_chat_format": rf"""
with t as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations
           union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x)) as turns_sha256,
       coalesce(sum(length(x)) filter (where r = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(x, '' order by turn, r, x) filter (where r = 'assistant'), '')) as loss_sha256,
       sum({_ESC.format("r")} + {_ESC.format("x")} + 17)::bigint as formatted_chars
from t group by conv_id"""
}
