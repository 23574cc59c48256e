"""Spaces: finite sets of paths, as DataFrames, and the operators on them.

A space has a column ``path`` (array of items) and no row twice. Inside ``iterate`` a space also has key columns: its
rows belong to groups, and every operator acts on each group for itself by adding the keys to its joins and groupings.
The body of an iteration is a Python function that is called once, with the group's head as a path over a key column
and the group's tails as a keyed space; no loop runs over groups. What a body doesn't key by group stays one relation
and is joined late. The live groups are a relation too: it decides whether anything happens at all for an empty source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import after, first, is_variable, parse, postfixes, prefixes, text_of

ITEMS = "array<string>"


@dataclass(frozen=True)
class Path:
    """A path of known length: a column for each item, the keys that they use, and those that are items as they are."""

    items: tuple[Column, ...]
    keys: frozenset[str] = frozenset()
    plain: frozenset[str] = frozenset()

    @staticmethod
    def of(value: Path | str | Iterable[str]) -> Path:
        """A literal: dotted text, or items."""
        if isinstance(value, Path):
            return value
        items = parse(value) if isinstance(value, str) else tuple(value)
        return Path(tuple(F.lit(x) for x in items))

    def __add__(self, other: Path | str) -> Path:
        other = Path.of(other)
        return Path(self.items + other.items, self.keys | other.keys, self.plain | other.plain)

    def __radd__(self, other: str) -> Path:
        return Path.of(other) + self

    def apply(self, function: Callable[..., Column | Iterable[Column]]) -> Path:
        """The path of the columns that a function makes of the items."""
        made = function(*self.items)
        return Path((made,) if isinstance(made, Column) else tuple(made), self.keys)

    @property
    def column(self) -> Column:
        return F.array(*self.items).cast(ITEMS)


@dataclass(frozen=True)
class _Loop:
    """The live groups; no frame at the top, where there is one group without keys."""

    frame: DataFrame | None = None
    keys: tuple[str, ...] = ()


_loops = [_Loop()]
_names = count()


@contextmanager
def _inside(loop: _Loop):
    _loops.append(loop)
    try:
        yield
    finally:
        _loops.pop()


def _joined(a: DataFrame, b: DataFrame, on: Iterable[str], how: str = "inner") -> DataFrame:
    on = list(on)
    if on:
        return a.join(b, on, how)
    return a.crossJoin(b) if how == "inner" else a.join(b, F.lit(True), how)


def _live(keys: Iterable[str]) -> DataFrame:
    return _loops[-1].frame.select(*sorted(keys)).distinct()


class Space:
    """A set of paths. ``lengths`` holds the lengths that its paths may have, if known.

    ``pinned`` are keys that stand at a fixed place of each path, so that the paths of different groups differ.
    """

    def __init__(self, frame: DataFrame, keys: Iterable[str] = (), lengths: Iterable[int] | None = None, pinned: Iterable[str] = ()):
        self.keys = frozenset(keys)
        self.pinned = frozenset(pinned) & self.keys
        self.frame = frame.select(*sorted(self.keys), "path")
        self.lengths = None if lengths is None else frozenset(lengths)

    # Sources

    @staticmethod
    def empty(spark: SparkSession) -> Space:
        return Space(spark.range(0).select(F.array().cast(ITEMS).alias("path")), lengths=())

    @staticmethod
    def literal(spark: SparkSession, *paths: str | Iterable[str]) -> Space:
        """A constant set of paths, as dotted texts or items."""
        rows = {parse(p) if isinstance(p, str) else tuple(p) for p in paths}
        frame = spark.createDataFrame([(list(p),) for p in sorted(rows)], f"path {ITEMS}")
        return Space(frame, lengths={len(p) for p in rows})

    @staticmethod
    def single(spark: SparkSession, path: Path | str) -> Space:
        """The set of one path; in an iteration, one for each group, if the path differs by group."""
        path = Path.of(path)
        if path.keys:
            return Space(_live(path.keys).select(*sorted(path.keys), path.column.alias("path")), path.keys, {len(path.items)})
        return Space(spark.range(1).select(path.column.alias("path")), lengths={len(path.items)})

    # Sinks

    def lines(self) -> list[str]:
        """The paths as sorted dotted texts, for a small result."""
        return sorted(r[0] for r in self.frame.select(text_of(F.col("path"))).collect())

    def columns(self, *names: str) -> DataFrame:
        """A column for each of the first items."""
        return self.frame.select(*[F.get("path", F.lit(i)).alias(n) for i, n in enumerate(names)])

    # Groups

    def _over(self, keys: Iterable[str]) -> DataFrame:
        """This space for each live group of the keys, which include its own."""
        keys = frozenset(keys)
        return self.frame if keys == self.keys else _joined(_live(keys), self.frame, sorted(self.keys))

    def _made(self, frame: DataFrame, other: Space, lengths: Iterable[int] | None) -> Space:
        """A space joined from two; only live groups stay where neither had all keys."""
        keys = self.keys | other.keys
        if keys not in (self.keys, other.keys):
            frame = frame.join(_live(keys), sorted(keys), "left_semi")
        return Space(frame, keys, lengths)

    def _with(self, frame: DataFrame, lengths: Iterable[int] | None = None) -> Space:
        return Space(frame, self.keys, lengths)

    @property
    def _by(self) -> list[str]:
        return sorted(self.keys)

    # Sets

    def union(self, *others: Space) -> Space:
        spaces = (self, *others)
        keys = frozenset().union(*[s.keys for s in spaces])
        frame = reduce(DataFrame.unionByName, [s._over(keys) for s in spaces]).distinct()
        known = all(s.lengths is not None for s in spaces)
        return Space(frame, keys, frozenset().union(*[s.lengths for s in spaces]) if known else None)

    def intersection(self, other: Space) -> Space:
        if other.keys <= self.keys:
            return self._with(self.frame.join(other.frame, [*other._by, "path"], "left_semi"), self.lengths)
        if self.keys <= other.keys:
            return other.intersection(self)
        return self._made(self.frame.join(other.frame, [*sorted(self.keys & other.keys), "path"]), other, self.lengths)

    def subtraction(self, other: Space) -> Space:
        keys = self.keys | other.keys
        return Space(self._over(keys).join(other.frame, [*other._by, "path"], "left_anti"), keys, self.lengths)

    # Prefixes

    def _prefixed(self, lengths: frozenset[int] | None) -> DataFrame:
        """A row for each prefix of a length that may matter, in ``_prefix``."""
        path = F.col("path")
        if lengths is None:
            cut = F.explode(F.concat(F.array(F.array().cast(ITEMS)), prefixes(path)))
        elif len(lengths) == 1:
            (n,) = lengths
            return self.frame.where(F.size(path) >= n).withColumn("_prefix", first(path, n))
        else:
            cuts = F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>")
            cut = F.explode(F.transform(F.filter(cuts, lambda n: n <= F.size(path)), lambda n: F.slice(path, F.lit(1), n)))
        return self.frame.withColumn("_prefix", cut)

    def restriction(self, other: Space) -> Space:
        """The paths that start with some path of ``other``."""
        keys = self.keys | other.keys
        of = other.frame.withColumnRenamed("path", "_prefix")
        rows = self._prefixed(other.lengths)
        if other.keys <= self.keys:
            rows = rows.join(of, [*other._by, "_prefix"], "left_semi").drop("_prefix")
            one = other.lengths is not None and len(other.lengths) == 1
            return self._with(rows if one else rows.distinct(), self.lengths)
        rows = rows.join(of, [*sorted(self.keys & other.keys), "_prefix"]).select(*sorted(keys), "path").distinct()
        return self._made(rows, other, self.lengths)

    def raffination(self, other: Space) -> Space:
        """The paths that start with no path of ``other``."""
        keys = self.keys | other.keys
        whole = Space(self._over(keys), keys, self.lengths)
        if other.lengths is not None and len(other.lengths) == 1:
            (n,) = other.lengths
            of = other.frame.withColumnRenamed("path", "_prefix")
            return whole._with(whole.frame.withColumn("_prefix", first(F.col("path"), n)).join(of, [*other._by, "_prefix"], "left_anti").drop("_prefix"), self.lengths)
        return whole.subtraction(whole.restriction(other))

    def unwrap(self, path: Path | str) -> Space:
        """What follows ``path`` in the paths that start with it."""
        path = Path.of(path)
        n, keys = len(path.items), self.keys | path.keys
        lengths = None if self.lengths is None else {k - n for k in self.lengths if k >= n}
        starts = [(F.get("path", F.lit(i)), item) for i, item in enumerate(path.items)]
        rest = after(F.col("path"), n).alias("path")
        if path.keys <= self.keys:
            rows = self.frame.where(F.size("path") >= n)
            return self._with(reduce(lambda f, p: f.where(p[0] == p[1]), starts, rows).select(*self._by, rest), lengths)
        # The groups look their paths up: an equi-join on the leading items.
        asked = _live(keys).select("*", *[item.alias(f"_i{i}") for i, (_, item) in enumerate(starts)])
        rows = self.frame.select("*", *[own.alias(f"_i{i}") for i, (own, _) in enumerate(starts)])
        return Space(_joined(asked, rows, [*self._by, *[f"_i{i}" for i in range(n)]]).select(*sorted(keys), rest), keys, lengths)

    def wrap(self, path: Path | str) -> Space:
        """``path`` before each path."""
        path = Path.of(path)
        keys = self.keys | path.keys
        lengths = None if self.lengths is None else {k + len(path.items) for k in self.lengths}
        return Space(self._over(keys).select(*sorted(keys), F.concat(path.column, "path").alias("path")), keys, lengths, self.pinned | path.plain)

    def transformation(self, pattern: str | Iterable[str], template: str | Iterable[str]) -> Space:
        """Paths rewritten position by position; those that don't match are dropped.

        Items are compared as far as both go. A variable of the pattern captures the item, a variable of the path the
        pattern's item, as one more capture; a variable of the template stands for its first capture. A repeated
        variable need not repeat its item. Paths that are too short for a capture of the template are dropped.
        """
        pattern, template = (parse(x) if isinstance(x, str) else tuple(x) for x in (pattern, template))
        fit, captures = [], []
        for i, item in enumerate(pattern):
            own = F.get("path", F.lit(i))
            none = F.array().cast(ITEMS)
            if is_variable(item):
                captures.append(F.when(own.isNotNull(), F.array(own)).otherwise(none))
            else:
                fit.append(own.isNull() | (own == item) | own.startswith("$"))
                captures.append(F.when((own != item) & own.startswith("$"), F.array(F.lit(item))).otherwise(none))
        variables = [x for x in pattern if is_variable(x)]
        if missing := {x for x in template if is_variable(x)} - set(variables):
            raise ValueError(f"the pattern lacks {sorted(missing)}")
        rows = self.frame.where(reduce(Column.__and__, fit, F.lit(True))).withColumn("_got", F.concat(F.array().cast(ITEMS), *captures))
        made = F.array(*[F.get("_got", F.lit(variables.index(x))) if is_variable(x) else F.lit(x) for x in template]).cast(ITEMS)
        rows = rows.select(*self._by, made.alias("path")).where(~F.exists("path", lambda x: x.isNull()))
        return self._with(rows.distinct(), {len(template)})

    # Products

    def composition(self, other: Space) -> Space:
        """Each path of this space followed by each of the other."""
        keys = self.keys | other.keys
        rows = _joined(self.frame, other.frame.withColumnRenamed("path", "_after"), sorted(self.keys & other.keys))
        rows = rows.select(*sorted(keys), F.concat("path", "_after").alias("path"))
        known = self.lengths is not None and other.lengths is not None
        if not known or min(len(self.lengths), len(other.lengths)) > 1:
            rows = rows.distinct()  # of one length on either side, no two pairs make the same path
        return self._made(rows, other, {a + b for a in self.lengths for b in other.lengths} if known else None)

    def relation(self, other: Space) -> Space:
        """``a.c`` for the pairs ``a.b`` here and ``b.c`` there."""
        keys = self.keys | other.keys
        left = self.frame.where(F.size("path") == 2).select(*self._by, F.get("path", F.lit(0)).alias("_a"), F.get("path", F.lit(1)).alias("_b"))
        right = other.frame.where(F.size("path") == 2).select(*other._by, F.get("path", F.lit(0)).alias("_b"), F.get("path", F.lit(1)).alias("_c"))
        rows = left.join(right, [*sorted(self.keys & other.keys), "_b"]).select(*sorted(keys), F.array("_a", "_c").alias("path"))
        return self._made(rows.distinct(), other, {2})

    def ending_in(self, other: Space) -> Space:
        """The paths whose last item is a path of ``other``."""
        keys = self.keys | other.keys
        of = other.frame.withColumnRenamed("path", "_last")
        rows = Space(self._over(keys), keys).frame.withColumn("_last", F.slice("path", F.greatest(F.size("path"), F.lit(1)), F.lit(1)))
        return Space(rows.join(of, [*other._by, "_last"], "left_semi"), keys, self.lengths)

    # Projections

    def heads(self, k: int = 1) -> Space:
        """The first ``k`` items of the paths that have so many."""
        return self._with(self.frame.where(F.size("path") >= k).select(*self._by, first(F.col("path"), k).alias("path")).distinct(), {k})

    def tails_union(self) -> Space:
        """What follows the first item in any path."""
        rows = self.frame.where(F.size("path") > 0).select(*self._by, after(F.col("path"), 1).alias("path"))
        return self._with(rows.distinct(), self._shorter(1))

    def tails_intersection(self) -> Space:
        """What follows every first item; nothing of an empty space."""
        rows = self.frame.where(F.size("path") > 0).select(*self._by, F.get("path", F.lit(0)).alias("_h"), after(F.col("path"), 1).alias("path"))
        heads = rows.groupBy(*self._by).agg(F.countDistinct("_h").alias("_all"))
        held = rows.groupBy(*self._by, "path").agg(F.count(F.lit(1)).alias("_n"))
        return self._with(_joined(held, heads, self._by).where("_n = _all"), self._shorter(1))

    def _shorter(self, k: int) -> set[int] | None:
        return None if self.lengths is None else {n - k for n in self.lengths if n >= k}

    # Iteration

    def iterate(self, body: Callable[..., Space], k: int = 1) -> Space:
        """The union of ``body(head, ..., tails)`` over the groups of paths with the same first ``k`` items.

        The body gets ``k`` heads of one item and the tails. Paths with fewer items belong to no group.
        """
        names = [f"k{next(_names)}" for _ in range(k)]
        rows = self.frame.where(F.size("path") >= k).select(*self._by, *[F.get("path", F.lit(i)).alias(n) for i, n in enumerate(names)], after(F.col("path"), k).alias("path"))
        tails = Space(rows, self.keys | set(names), self._shorter(k))
        outer, groups = _loops[-1], rows.select(*self._by, *names).distinct()
        frame = groups if outer.frame is None else _joined(outer.frame, groups, self._by)
        with _inside(_Loop(frame, (*outer.keys, *names))):
            out = body(*[Path((F.col(n),), frozenset([n]), frozenset([n])) for n in names], tails)
            kept = (out.keys | self.keys) - set(names)
            # A result that isn't keyed by the groups holds if there are any.
            whole = out._over(out.keys | self.keys | set(names))
            rows = whole.select(*sorted(kept), "path")
            return Space(rows if out.pinned.issuperset(names) else rows.distinct(), kept, out.lengths, out.pinned)

    def iterate_heads(self, body: Callable[[Path], Space]) -> Space:
        return self.iterate(lambda head, _: body(head))

    def iterate_tails(self, body: Callable[[Space], Space]) -> Space:
        return self.iterate(lambda _, tails: body(tails))

    def iterate_first(self, k: int, body: Callable[[Path, Space], Space]) -> Space:
        """Iteration over the first ``k`` items as one path; for 0, the body of the space itself."""
        if k == 0:
            return body(Path(()), self)
        return self.iterate(lambda *args: body(reduce(Path.__add__, args[:-1]), args[-1]), k)

    def tee(self, todo: Space) -> Space:
        """``todo`` where this space isn't empty."""
        keys = self.keys | todo.keys
        some = self.frame.select(*self._by).distinct() if self.keys else self.frame.select(F.lit(1).alias("_one")).limit(1)
        return Space(Space(todo._over(keys), keys).frame.join(some, self._by, "left_semi") if self.keys else todo.frame.join(some, F.lit(True), "left_semi"), keys, todo.lengths)

    def on_empty(self, todo: Space) -> Space:
        """``todo`` where this space is empty."""
        keys = self.keys | todo.keys
        if self.keys:
            return Space(todo._over(keys).join(self.frame.select(*self._by).distinct(), self._by, "left_anti"), keys, todo.lengths)
        return Space(todo.frame.join(self.frame.select(F.lit(1).alias("_one")).limit(1), F.lit(True), "left_anti"), keys, todo.lengths)

    def or_else(self, backup: Space) -> Space:
        """This space, or the backup where it is empty."""
        return self.union(self.on_empty(backup))

    # Order

    def first(self, n: int) -> Space:
        """The ``n`` smallest paths, compared item by item."""
        return self._extreme(F.min("path")) if n == 1 else self._ordered(n, F.col("path").asc())

    def last(self, n: int) -> Space:
        return self._extreme(F.max("path")) if n == 1 else self._ordered(n, F.col("path").desc())

    def _extreme(self, path: Column) -> Space:
        return self._with(self.frame.groupBy(*self._by).agg(path.alias("path")).where("path is not null"), self.lengths)

    def _ordered(self, n: int, order: Column) -> Space:
        if not self.keys:
            return self._with(self.frame.orderBy(order).limit(n), self.lengths)
        rank = F.row_number().over(Window.partitionBy(*self._by).orderBy(order))
        return self._with(self.frame.withColumn("_rank", rank).where(F.col("_rank") <= n), self.lengths)

    # Residuals

    def left_residual(self, other: Space) -> Space:
        """The non-empty prefixes of paths here that, followed by any path of ``other``, are paths here."""
        path = F.col("path")
        cuts = F.transform(prefixes(path), lambda p: F.struct(p.alias("kept"), F.slice(path, F.size(p) + 1, F.size(path)).alias("asked")))
        return self._residual(other, cuts)

    def right_residual(self, other: Space) -> Space:
        """The non-empty suffixes of paths here that, after any path of ``other``, are paths here."""
        path = F.col("path")
        cuts = F.transform(postfixes(path), lambda p: F.struct(p.alias("kept"), F.slice(path, F.lit(1), F.size(path) - F.size(p)).alias("asked")))
        return self._residual(other, cuts)

    def _residual(self, other: Space, cuts: Column) -> Space:
        keys = self.keys | other.keys
        by = sorted(keys)
        rows = self._over(keys).select(*by, F.explode(cuts).alias("_c")).select(*by, F.col("_c.kept").alias("path"), F.col("_c.asked").alias("_asked"))
        size = other.frame.groupBy(*other._by).agg(F.count(F.lit(1)).alias("_all"))
        held = rows.join(other.frame.withColumnRenamed("path", "_asked"), [*other._by, "_asked"], "left_semi")
        held = held.groupBy(*by, "path").agg(F.count(F.lit(1)).alias("_n"))
        every = _joined(held, size, other._by).where("_n = _all").select(*by, "path")
        # Of an empty divisor, every cut does.
        free = rows.join(other.frame.select(*other._by).distinct(), other._by, "left_anti") if other.keys else rows.join(other.frame.select(F.lit(1).alias("_one")).limit(1), F.lit(True), "left_anti")
        return Space(every.unionByName(free.select(*by, "path").distinct()), keys)

    # Functions of sets

    def aggregate(self, value: Column, otherwise: str | None = None) -> Space:
        """One path of one item for each live group: an aggregate over its paths.

        ``otherwise`` is the item for an empty group; without one, empty groups have no path.
        """
        rows = self.frame.groupBy(*self._by).agg(value.cast("string").alias("_v"))
        if otherwise is not None:
            rows = rows.join(_live(self.keys), self._by, "right") if self.keys else rows
            rows = rows.withColumn("_v", F.coalesce("_v", F.lit(otherwise)))
        return self._with(rows.where(F.col("_v").isNotNull()).select(*self._by, F.array("_v").alias("path")), {1})

    def card(self) -> Space:
        """The number of paths."""
        return self.aggregate(F.count(F.lit(1)), "0")

    def highest(self, otherwise: str | None = None) -> Space:
        return self.aggregate(F.max(F.get("path", F.lit(0))), otherwise)

    def lowest(self, otherwise: str | None = None) -> Space:
        return self.aggregate(F.min(F.get("path", F.lit(0))), otherwise)

    def map_paths(self, function: Callable[[Column], Column]) -> Space:
        """Each path through a column function from items to items."""
        return self._with(self.frame.select(*self._by, function(F.col("path")).cast(ITEMS).alias("path")).where("path is not null").distinct())

    def flat_map(self, function: Callable[[Column], Column]) -> Space:
        """Each path through a column function to an array of paths."""
        return self._with(self.frame.select(*self._by, F.explode(function(F.col("path"))).alias("path")).select(*self._by, F.col("path").cast(ITEMS)).distinct())

    def map_frame(self, function: Callable[[DataFrame], DataFrame]) -> Space:
        """The whole relation, keys and ``path``, through a DataFrame function that acts within groups."""
        return self._with(function(self.frame).distinct())

    __or__ = union
    __and__ = intersection
    __sub__ = subtraction
    __matmul__ = composition
