"""Pattern queries: paths matched by items and variables, as filters and joins of variable columns.

A pattern matches the start of a path; a variable that is repeated, in one pattern or over several, has to repeat its
item. What follows the match is the remainder.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import after, is_variable, parse
from .space import ITEMS, Space

Pattern = str | Iterable[str]


def _items(pattern: Pattern) -> tuple[str, ...]:
    return parse(pattern) if isinstance(pattern, str) else tuple(pattern)


def _matches(pattern: tuple[str, ...]) -> Column:
    fit = [F.size("path") >= len(pattern)]
    for i, item in enumerate(pattern):
        first = pattern.index(item)
        if not is_variable(item):
            fit.append(F.get("path", F.lit(i)) == item)
        elif first < i:
            fit.append(F.get("path", F.lit(i)) == F.get("path", F.lit(first)))
    return reduce(Column.__and__, fit)


def bindings(space: Space, pattern: Pattern) -> DataFrame:
    """A column for each variable, named as it is, and the remainder in ``_rest``."""
    items = _items(pattern)
    own = [F.get("path", F.lit(items.index(v))).alias(v) for v in dict.fromkeys(items) if is_variable(v)]
    return space.frame.where(_matches(items)).select(*sorted(space.keys), *own, after(F.col("path"), len(items)).alias("_rest"))


def _made(template: Pattern) -> Column:
    return F.array(*[F.col(f"`{x}`") if is_variable(x) else F.lit(x) for x in _items(template)]).cast(ITEMS)


def select(space: Space, pattern: Pattern) -> Space:
    """The paths that match."""
    return Space(space.frame.where(_matches(_items(pattern))), space.keys, space.lengths)


def rewrite(space: Space, pattern: Pattern, template: Pattern) -> Space:
    """The template and the remainder for each match."""
    return rewrite_all(space, [pattern], template)


def _whole(space: Space, pattern: Pattern) -> bool:
    """Whether the pattern leaves no remainder, so that no two paths have the same bindings."""
    return space.lengths == {len(_items(pattern))}


def join(space: Space | Sequence[Space], patterns: Iterable[Pattern]) -> DataFrame:
    """The bindings under which every pattern matches, with the remainder of the last one in ``_rest``.

    Patterns are joined to those before that they share a variable with, where there are such. Each matches the space,
    or one of its own where there is a space for each.
    """
    left = list(patterns)
    spaces = [space] * len(left) if isinstance(space, Space) else list(space)
    keys = frozenset().union(*[x.keys for x in spaces])
    parts = [bindings(x, p) for x, p in zip(spaces, left, strict=True)]
    for i in range(len(parts) - 1):
        bound = parts[i].drop("_rest")
        parts[i] = bound if _whole(spaces[i], left[i]) else bound.distinct()
    out = parts.pop(0)
    while parts:
        at = next((i for i, p in enumerate(parts) if (set(p.columns) & set(out.columns)) - keys), 0)
        part = parts.pop(at)
        shared = [c for c in part.columns if c in out.columns]
        out = out.join(part, shared) if shared else out.crossJoin(part)
    return out


def rewrite_all(space: Space | Sequence[Space], patterns: Iterable[Pattern], template: Pattern) -> Space:
    """The template and the last pattern's remainder for each match of all the patterns."""
    patterns = list(patterns)
    spaces = [space] if isinstance(space, Space) else list(space)
    keys = frozenset().union(*[x.keys for x in spaces])
    rows = join(space, patterns)
    if _whole(spaces[-1], patterns[-1]):
        return Space(rows.select(*sorted(keys), _made(template).alias("path")).distinct(), keys, {len(_items(template))})
    return Space(rows.select(*sorted(keys), F.concat(_made(template), "_rest").alias("path")).distinct(), keys)


def rewrite_each(space: Space, patterns: Iterable[Pattern], templates: Iterable[Pattern]) -> Space:
    """Each template for each match of all the patterns, without remainders."""
    templates = [_items(t) for t in templates]
    rows = join(space, patterns).select(*sorted(space.keys), F.explode(F.array(*map(_made, templates))).alias("path"))
    return Space(rows.distinct(), space.keys, {len(t) for t in templates})
