"""Paths: text form and functions on their items.

A path is a sequence of text items, a variable being an item that starts with ``$``. In text, items are joined by dots.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slices to the end of a path.
REST = 2147483647


def parse(text: str) -> tuple[str, ...]:
    """The items of a dotted text: empty items at the end are dropped, and the empty text is one empty item."""
    if text == "":
        return ("",)
    items = text.split(".")
    while items and items[-1] == "":
        items.pop()
    return tuple(items)


def show(path: tuple[str, ...]) -> str:
    return ".".join(path)


def is_variable(item: str) -> bool:
    return item.startswith("$")


def text_of(path: Column) -> Column:
    return F.array_join(path, ".")


def first(path: Column, n: int) -> Column:
    return F.slice(path, 1, n)


def after(path: Column, n: int) -> Column:
    return F.slice(path, n + 1, REST)


def _cuts(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.sequence(F.lit(1), F.size(path))).otherwise(F.array().cast("array<int>"))


def prefixes(path: Column) -> Column:
    """All non-empty prefixes, the shortest first."""
    return F.transform(_cuts(path), lambda n: F.slice(path, F.lit(1), n))


def postfixes(path: Column) -> Column:
    """All non-empty suffixes, the longest first."""
    return F.transform(_cuts(path), lambda n: F.slice(path, n, F.size(path) - n + 1))


def most_specific(a: Column, b: Column) -> Column:
    """The longer of two non-empty paths of which one is a prefix of the other, else null; null too beside an empty one."""
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both & (F.slice(a, F.lit(1), F.size(b)) == b), a).when(both & (F.slice(b, F.lit(1), F.size(a)) == a), b)


def rename_from(left: tuple[str, ...], right: tuple[str, ...]) -> tuple[str, ...]:
    """The left pattern with the names that the right one has for its variables, position by position.

    A name that stands for another left variable already leaves the left name in place; past the end of the right
    pattern, names that are known are used.
    """
    names: dict[str, str] = {}
    out = []
    for k, item in enumerate(left):
        if is_variable(item) and item not in names and k < len(right) and is_variable(right[k]):
            names[item] = item if right[k] in names.values() else right[k]
        out.append(names.get(item, item))
    return tuple(out)


def interval(start: int, end: int, height: int) -> list[tuple[str, ...]]:
    """The fewest binary prefixes, one item for each bit, that cover the numbers from start to end of ``height`` bits.

    The whole range is the empty path.
    """
    if not 0 <= start <= end < 1 << height:
        raise ValueError("the interval does not lie in the range")
    out = []
    while start <= end:
        free = 0
        while free < height and start % (2 << free) == 0 and start + (2 << free) - 1 <= end:
            free += 1
        out.append(tuple(format(start >> free, f"0{height - free}b")) if free < height else ())
        start += 1 << free
    return out
