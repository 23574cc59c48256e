"""Secret scan with corpus-wide ownership frequency, in DataFrame functions alone.

Positions come from marks: a regular expression puts a mark around each match, the marked text is split there, and the
lengths of the pieces add up to code points. The value of each candidate is hashed and the hashes are aggregated by
distinct owners and repositories: a value that one owner alone holds, in few repositories, looks live; one that several
owners hold, or very many repositories of one, is a copied example. Long mixed tokens without a telling name count as
secrets only if they look live; they are the ``owned`` spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, spread_join, table

#: Kinds of spans in order; the first three are the base.
KINDS = ("assign", "access", "hex", "owned")
#: Owners that may share a value that looks live.
MOST_OWNERS = 1
#: Repositories, each a document, that may share a value that looks live.
MOST_REPOSITORIES = 10
#: Code points of a token that is a candidate without a name.
LEAST_TOKEN = 24

_MARK, _INNER = "\u0001", "\u0002"
#: In place of marks that a text has itself: another code point that is in no pattern.
_STAND_IN = "\u2028"
#: Pattern, replacement and least length by kind. A run that is too short for access or hex holds no longer one, so
#: that those may ask for the length at once; an assignment that is too short takes its text with it.
_PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", f"{_MARK}$1{_INNER}$2{_MARK}", 8),
    "access": (r"(AKIA[A-Z0-9]{12,})", f"{_MARK}{_INNER}$1{_MARK}", 16),
    "hex": (r"(?<![0-9a-f])([0-9a-f]{32,})", f"{_MARK}{_INNER}$1{_MARK}", 32),
    "owned": (rf"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{{{LEAST_TOKEN},}})", f"{_MARK}{_INNER}$1{_MARK}", LEAST_TOKEN),
}
_CHUNK = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _folded(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(values, zero, join)


def _before(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each value the fold of those before it, by way of folds of chunks."""
    chunks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int"))
    folds = F.transform(chunks, lambda c: _folded(F.slice(values, c * _CHUNK + 1, _CHUNK), zero, join))

    def at(offsets: Column) -> Column:
        def own(_: Column, i: Column) -> Column:
            c = F.floor(i / _CHUNK).cast("int")
            return join(F.get(offsets, c), _folded(F.slice(values, c * _CHUNK + 1, i % _CHUNK), zero, join))

        return F.transform(values, own)

    return _let(folds, lambda s: _let(F.transform(s, lambda _, c: _folded(F.slice(s, F.lit(1), c), zero, join)), at))


_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:binary>>"


def _spans(text: Column, kind: str) -> Column:
    """``(start, kind, end, value)`` of the matches of one kind; ``value`` is a hash."""
    pattern, marked, least = _PATTERNS[kind]
    number = F.lit(KINDS.index(kind))

    def of(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p, i: F.char_length(p).cast("long") - (i % 2))

        def spans(starts: Column) -> Column:
            parts = F.transform(pieces, lambda p, i: F.struct(F.get(starts, i).alias("start"), p.alias("p"), (i % 2).alias("odd")))
            value = lambda x: F.substring_index(x["p"], _INNER, -1)
            fit = lambda x: (x["odd"] == 1) & (F.char_length(value(x)) >= least)
            if kind == "owned":
                mixed = lambda x: value(x).rlike("[a-z]") & value(x).rlike("[A-Z]") & value(x).rlike("[0-9]")
                whole = lambda x: fit(x) & mixed(x)
            else:
                whole = fit
            span = lambda x: F.struct(x["start"].alias("start"), number.alias("kind"), (x["start"] + F.char_length(x["p"]) - 1).alias("end"), F.unhex(F.sha2(value(x), 256)).alias("value"))
            return F.transform(F.filter(parts, whole), span)

        return _let(_let(lengths, lambda n: _before(n, F.lit(0).cast("long"), lambda a, b: a + b)), spans)

    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(marked)), _MARK)
    return _let(pieces, lambda p: F.when(F.size(p) > 1, of(p)).otherwise(F.array().cast(_SPAN)))


def _apart(base: Column, more: Column) -> Column:
    """Those of the sorted spans ``more``, which don't overlap each other, that overlap none of ``base``: one pass over both."""
    far = F.lit(1 << 62)

    def of(both: Column) -> Column:
        is_base = lambda s: s["kind"] < len(KINDS) - 1
        ends = F.transform(both, lambda s: F.when(is_base(s), s["end"]).otherwise(F.lit(0).cast("long")))
        starts = F.reverse(F.transform(both, lambda s: F.when(is_base(s), s["start"]).otherwise(far)))
        reach = lambda e: _before(e, F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))
        following = lambda t: F.reverse(_before(t, far, lambda a, b: F.least(a, b)))
        free = lambda r, n: F.filter(both, lambda s, i: ~is_base(s) & (F.get(r, i) <= s["start"]) & (F.get(n, i) >= s["end"]))
        return _let(_let(ends, reach), lambda r: _let(_let(starts, following), lambda n: free(r, n)))

    return F.when((F.size(base) > 0) & (F.size(more) > 0), _let(F.array_sort(F.concat(base, more)), of)).otherwise(more)


def candidates(docs: DataFrame, owner: str) -> DataFrame:
    """``(doc_id, owner, base, more)``: the base spans of each row and the tokens beside them, each in order."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _MARK + _INNER, 2 * _STAND_IN)
    rows = docs.select(F.col("doc_id").cast("long"), F.col(owner).cast("string").alias("owner"), text.alias("text"))
    base = F.array_sort(F.concat(*[_spans(F.col("text"), k) for k in KINDS[:3]]))
    rows = rows.select("doc_id", "owner", base.alias("base"), _spans(F.col("text"), "owned").alias("more"))
    return rows.withColumn("more", _apart(F.col("base"), F.col("more")))


def ownership(found: DataFrame) -> DataFrame:
    """``(value, owners, repositories)`` of each candidate value; a document is a repository, a null owner or doc_id one."""
    held = found.select("doc_id", "owner", F.explode(F.concat("base", "more")).alias("s")).select("doc_id", "owner", "s.value").distinct()
    by_owner = held.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, owner: str = "source") -> DataFrame:
    """Spans of each row of ``docs(doc_id, text, <owner>, ...)``.

    Columns: doc_id; ``base``, the base spans, and ``added``, those of the method (start, kind, end, hash of the value;
    code points, end exclusive); ``n_live`` spans whose value looks live and ``n_copied`` others. A null text is empty.
    Rows that repeat a doc_id are scanned each for itself, are one repository and share what looks live. Of a row without
    doc_id nothing looks live. A long text of many spans takes time in proportion. Other columns are not read.
    """
    found = saved(candidates(docs, owner).withColumn("_row", F.monotonically_increasing_id()), "secret-spans")
    looks = (F.col("owners") <= MOST_OWNERS) & (F.col("repositories") <= MOST_REPOSITORIES)
    live = ownership(found).where(looks).select("value", F.lit(True).alias("live"))
    spans = found.where("doc_id is not null").select("_row", F.explode(F.concat("base", "more")).alias("s")).select("_row", "s.*")
    marked = spread_join(spans, live, "value", "_row", "left").where("live or kind < 3")
    span = F.struct("start", "kind", "end", "value", F.coalesce("live", F.lit(False)).alias("live"))
    of = marked.groupBy(F.col("_row").alias("_of")).agg(F.array_sort(F.collect_list(span)).alias("_marked"))
    rows = found.join(of, found["_row"] == of["_of"], "left")
    plain = lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"])
    added = F.transform(F.filter("_marked", lambda s: s["kind"] == 3), plain)
    n_live = F.coalesce(F.size(F.filter("_marked", lambda s: s["live"])), F.lit(0))
    rows = rows.select("doc_id", "base", F.coalesce(added, F.array().cast(_SPAN)).alias("added"), F.when(F.col("_marked").isNull(), 0).otherwise(n_live).cast("long").alias("n_live"))
    return rows.withColumn("n_copied", (F.size("base") + F.size("added") - F.col("n_live")).cast("long"))


def _line(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_line(F.col("base")), 256).alias("base_sha256"),
        _line(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_live", "n_copied",
    )


def _oracle() -> str:
    """The same from marks and window sums; a run's first match needs no look at what stands before it there."""
    texts = "t as (select doc_id, coalesce(source, chr(0)) as owner, translate(coalesce(text, ''), chr(1) || chr(2), chr(8232) || chr(8232)) as x from documents)"
    kinds = []
    for no, kind in enumerate(KINDS):
        pattern, _, least = _PATTERNS[kind]
        pattern = pattern[pattern.index(")") + 1 :] if pattern.startswith("(?<!") else pattern
        put = r"chr(1) || '\1' || chr(2) || '\2' || chr(1)" if kind == "assign" else r"chr(1) || chr(2) || '\1' || chr(1)"
        quoted = pattern.replace("'", "''")
        kinds.append(f"select doc_id, owner, {no} as no, '{kind}' as kind, {least} as least, string_split(regexp_replace(x, '{quoted}', {put}, 'g'), chr(1)) as p from t")
    mixed = " and ".join(f"regexp_matches(value, '[{c}]')" for c in ("a-z", "A-Z", "0-9"))
    return f"""
with {texts}, k as ({" union all ".join(kinds)}),
u as (select doc_id, owner, no, kind, least, unnest(p) as piece, unnest(range(0, len(p))) as i from k where len(p) > 1),
w as (select *, coalesce(sum(length(piece) - i % 2) over (partition by doc_id, no order by i rows between unbounded preceding and 1 preceding), 0)::bigint as b from u),
s as (select doc_id, owner, no, kind, b, b + length(piece) - 1 as e, string_split(piece, chr(2))[2] as value, least from w where i % 2 = 1),
f as (select * from s where length(value) >= least and (no < 3 or ({mixed}))),
c as (select * from f where no < 3 or not exists (select 1 from f g where g.doc_id = f.doc_id and g.no < 3 and g.b < f.e and f.b < g.e)),
o as (select value, count(distinct owner) <= {MOST_OWNERS} and count(distinct doc_id) <= {MOST_REPOSITORIES} as live from c group by value),
r as (select c.*, live, c.kind || ':' || b || ':' || e as line from c join o using (value) where no < 3 or live)
select t.doc_id, count(*) filter (where no = 0)::bigint as n_assign, count(*) filter (where no = 1)::bigint as n_access, count(*) filter (where no = 2)::bigint as n_hex,
       sha256(coalesce(string_agg(line, ',' order by b, no) filter (where no < 3), '')) as base_sha256,
       coalesce(string_agg(line, ',' order by b, no), '') as spans, count(*) filter (where live)::bigint as n_live, count(*) filter (where not live)::bigint as n_copied
from t left join r using (doc_id) group by t.doc_id"""


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLES = {"op5_secret_scan": _oracle()}
