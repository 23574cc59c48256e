"""Host functions on paths and sets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.space import ITEMS, Space
from .paths import text_of


def path_hash(path: Column) -> Column:
    """A path of one item, the MD5 of the dotted text."""
    return F.array(F.md5(text_of(path)))


def space_hash(space: Space) -> Space:
    """One item for the set, the same in any order: of the count and the exclusive or of the starts of the paths' MD5."""
    bits = F.bit_xor(F.conv(F.substring(F.md5(text_of(F.col("path"))), 1, 15), 16, 10).cast("bigint"))
    return space.aggregate(F.md5(F.concat_ws(":", F.count(F.lit(1)), bits)), "")


def numbers_in(path: Column) -> Column:
    """The paths of one number in ``stop`` or ``start.stop.step``, half open; of other shapes, none."""
    at = lambda i: F.get(path, F.lit(i)).try_cast("bigint")
    three = F.size(path) == 3
    start, stop, step = F.when(three, at(0)).otherwise(0), F.when(three, at(1)).otherwise(at(0)), F.when(three, at(2)).otherwise(1)
    last = stop - F.signum(step).cast("bigint")
    some = ((step > 0) & (start < stop)) | ((step < 0) & (start > stop))
    fits = (F.size(path).isin(1, 3)) & some
    made = F.when(fits, F.transform(F.sequence(F.when(fits, start), F.when(fits, last), F.when(fits, step)), lambda n: F.array(n.cast("string"))))
    return F.coalesce(made, F.array().cast(f"array<{ITEMS}>"))


def add(a: Column, b: Column) -> Column:
    return (a.cast("bigint") + b.cast("bigint")).cast("string")


def sub(a: Column, b: Column) -> Column:
    return (a.cast("bigint") - b.cast("bigint")).cast("string")


def arithmetic(space: Space) -> Space:
    """The sums of the rows ``+.x.y``, and of ``+₂.x0.x1.y0.y1`` by component; other rows are dropped."""

    path = F.col("path")
    at = lambda i: F.get(path, F.lit(i)).try_cast("bigint")
    one = (F.get(path, F.lit(0)) == "+") & (F.size(path) == 3)
    two = (F.get(path, F.lit(0)) == "+₂") & (F.size(path) == 5)
    sums = F.when(one, at(1) + at(2)).when(two, at(1) + at(3)).alias("a"), F.when(two, at(2) + at(4)).alias("b")
    rows = space.frame.where(one | two).select(*space.keys, two.alias("two"), *sums).where("a is not null and (b is not null or not two)").distinct()
    made = F.when(F.col("two"), F.array(F.col("a").cast("string"), F.col("b").cast("string"))).otherwise(F.array(F.col("a").cast("string")))
    return Space(rows.select(*space.keys, made.alias("path")), space.keys)


def sample(space: Space, seed: str, n: int) -> Space:
    """``n`` paths, those whose text has the least hash with the seed."""
    order = F.md5(F.concat(F.lit(seed), F.lit(":"), text_of(F.col("path"))))
    return space._ordered(n, order.asc())
