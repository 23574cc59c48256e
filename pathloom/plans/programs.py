"""Worked programs over spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import REST
from ..operators.space import ITEMS, Space
from .fixpoint import NotSettled, _rounds, converge, least_fixpoint, recursive
from .lineage import checkpointed

# Families


def children(family: Space) -> Space:
    """``child.c.p`` for each ``parent.p.c``."""
    return family.unwrap("parent").iterate(lambda p, cs: cs.iterate(lambda c, rest: rest.wrap("child" + c + p)))


def indexed(family: Space) -> Space:
    """The facts with children, and a person for each man and woman."""
    people = family.unwrap("female").union(family.unwrap("male")).wrap("person")
    return family.union(children(family), people)


def parents(family: Space, people: Space) -> Space:
    """``person.parent`` for each of the people."""
    return family.unwrap("child").restriction(people)


def mothers(family: Space, people: Space) -> Space:
    """``person.mother``: the parents who are women."""
    return parents(family, people).ending_in(family.unwrap("female"))


def sisters(family: Space, people: Space) -> Space:
    """``person.sister``: women with a parent in common."""
    near = parents(family, people).relation(family.unwrap("parent")).ending_in(family.unwrap("female"))
    return Space(near.frame.where(F.get("path", F.lit(0)) != F.get("path", F.lit(1))), near.keys, near.lengths)


def aunts(family: Space, people: Space) -> Space:
    """``person.aunt``: the women with a parent in common with a parent, parents aside."""
    up = parents(family, people)
    near = up.relation(family.unwrap("child")).relation(family.unwrap("parent"))
    return near.ending_in(family.unwrap("female")).subtraction(up)


def ancestors(family: Space, start: Space) -> Space:
    """All who can be reached over ``child.c.p`` from those of ``start``, themselves not."""
    up = family.unwrap("child")
    direct = up.restriction(start).tails_union()
    return least_fixpoint(direct, lambda _, new: up.restriction(new).tails_union())


# Sets and relations


def tagged_union(first: Space, second: Space, one: str, two: str) -> Space:
    """``key.one.rest`` and ``key.two.rest`` of two keyed spaces."""
    return first.iterate(lambda k, t: t.wrap(k + one)).union(second.iterate(lambda k, t: t.wrap(k + two)))


def division(dividend: Space, divisor: Space) -> Space:
    """The heads of the dividend that stand with every path of the divisor; all of them if it is empty."""
    some = dividend.iterate(lambda head, rest: rest.intersection(divisor).card().wrap(head))
    rows = some.frame.select(F.slice("path", 1, 1).alias("path"), F.get("path", F.lit(1)).alias("n"))
    total = divisor.card().columns("n")
    return Space(rows.join(total, "n").select("path"), lengths={1})


def polynomial_product(a: Space, b: Space) -> Space:
    """``degree.degree.index.index.factors`` of the products of all terms ``degree.index.factors`` of two polynomials."""
    return a.iterate(lambda da, ia, fa: b.iterate(lambda db, ib, fb: fa.composition(fb).wrap(da + db + ia + ib), 2), 2)


# Sequences


def suffix_index(sequences: Space, depth: int | None = 5, width: int | None = None) -> Space:
    """``item... .id`` for each ``id.item...`` and each of its first ``depth`` suffixes, all for None.

    ``width`` is the number of items that are kept of a suffix, all for None; phrases of more aren't found.
    """
    path = F.col("path")
    last = F.size(path) if depth is None else F.least(F.lit(depth + 1), F.size(path))
    rows = sequences.frame.where(F.size(path) > 1)
    if width is None:
        rows = rows.select("path", F.explode(F.sequence(F.lit(2), last)).alias("at"))
        rows = rows.select(F.get("path", F.lit(0)).alias("id"), F.slice(path, F.col("at"), F.size(path)).alias("s"))
    else:
        # Cut before the rows are made, so that no row carries a whole sequence.
        cuts = F.transform(F.sequence(F.lit(2), last), lambda n: F.slice(path, n, F.lit(width)))
        rows = rows.select(F.get("path", F.lit(0)).alias("id"), F.explode(cuts).alias("s"))
    return Space(rows.select(F.concat("s", F.array("id")).alias("path")).distinct())


def containing(index: Space, phrase: str | tuple[str, ...]) -> Space:
    """The ids of the sequences in which the phrase starts within the depth of the index."""
    rest = index.unwrap(phrase).frame.where(F.size("path") > 0)
    return Space(rest.select(F.array(F.element_at("path", -1)).alias("path")).distinct(), lengths={1})


# Game of life


def neighbours(cells: Space) -> Space:
    """``x.y.n`` for each place beside a living cell ``x.y``, with the number of living cells beside it."""
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    rows = cells.columns("x", "y").withColumn("d", F.explode(near))
    at = rows.select((F.col("x").cast("bigint") + F.col("d.i")).alias("x"), (F.col("y").cast("bigint") + F.col("d.j")).alias("y"))
    held = at.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    return Space(held.select(F.array(*[F.col(c).cast("string") for c in ("x", "y", "n")]).alias("path")), lengths={3})


def life_step(cells: Space, inside: Space | None = None) -> Space:
    """The cells alive next: those with three neighbours, and the living with two; of ``inside`` for both if given."""
    place = [F.col(c).cast("bigint") for c in "xy"]
    # Each cell also tells its own place, where it counts as no neighbour; all in one grouping.
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    rows = cells.columns("x", "y").select(*[p.alias(c) for p, c in zip(place, "xy")], *[(F.col(c) == p.cast("string")).alias("own" + c) for p, c in zip(place, "xy")])
    rows = rows.select("*", F.explode(near).alias("d"))
    here = (F.col("d.i") == 0) & (F.col("d.j") == 0)
    at = rows.select((F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"), F.when(here, 0).otherwise(1).alias("n"), (here & F.col("ownx") & F.col("owny")).cast("int").alias("own"))
    held = at.groupBy("x", "y").agg(F.sum("n").alias("n"), F.max("own").alias("own")).where("n = 3 or n = 2 and own = 1")
    out = Space(held.select(F.array(F.col("x").cast("string"), F.col("y").cast("string")).alias("path")), lengths={2})
    return out if inside is None else out.intersection(inside.composition(inside))


# Puzzles


def queens(spark: SparkSession, n: int) -> Space:
    """The placements of ``n`` queens, a column for each row in turn; placed row by row by joining safe squares."""
    columns = spark.range(1, n + 1).selectExpr("cast(id as int) c")
    placed = columns.selectExpr("array(c) p")
    for row in range(1, n):
        hit = F.exists(F.sequence(F.lit(0), F.lit(row - 1)), lambda i: (F.get("p", i) == F.col("c")) | (F.abs(F.get("p", i) - F.col("c")) == row - i))
        placed = checkpointed(placed.crossJoin(columns).where(~hit).select(F.concat("p", F.array("c")).alias("p")))
    return Space(placed.select(F.col("p").cast(ITEMS).alias("path")), lengths={n})


def sliding_states(start: Space, moves: Space) -> Space:
    """The states of a sliding puzzle that moves lead to; a state lists the tile at each place, ``_`` being free.

    ``moves`` has ``from.to`` for the places between which a tile may slide; places count from 0.
    """
    steps = moves.columns("f", "t").select(F.col("f").cast("int").alias("f"), F.col("t").cast("int").alias("t"))

    def next_to(_: Space, new: Space) -> Space:
        rows = new.frame.withColumn("t", (F.array_position("path", F.lit("_")) - 1).cast("int")).join(steps, "t")
        moved = F.transform("path", lambda x, i: F.when(i == F.col("t"), F.get("path", F.col("f"))).when(i == F.col("f"), F.lit("_")).otherwise(x))
        return Space(rows.select(moved.alias("path")).distinct())

    return least_fixpoint(start, next_to)


def sudoku_candidates(given: Space, size: int, box: int) -> Space:
    """``c.r.v`` for the values that no given ``c.r.v`` in the column, row or box rules out of a free cell."""
    spark = given.frame.sparkSession
    line = Space.literal(spark, *[(str(i),) for i in range(1, size + 1)])
    cells = line.composition(line).raffination(given.heads(2))
    known = given.columns("c", "r", "v").select(F.col("c").cast("int").alias("c"), F.col("r").cast("int").alias("r"), "v")
    block = lambda x: F.floor((x - 1) / box)
    options = cells.composition(line)
    rows = options.columns("c", "r", "v")
    own = rows.select(F.col("c").cast("int").alias("c"), F.col("r").cast("int").alias("r"), "v")
    groups = [("c", F.col("c")), ("r", F.col("r")), ("b", F.concat_ws("/", block(F.col("c")), block(F.col("r"))))]
    for _, group in groups:
        out = known.select(group.alias("g"), "v").distinct()
        own = own.withColumn("g", group).join(out, ["g", "v"], "left_anti").drop("g")
    return Space(own.select(F.array(F.col("c").cast("string"), F.col("r").cast("string"), "v").alias("path")), lengths={3})


def sudoku_deductions(given: Space, size: int, box: int) -> Space:
    """The cells with one candidate."""
    options = sudoku_candidates(given, size, box)
    return options.iterate(lambda c, r, vs: vs.first(1).intersection(vs.last(1)).wrap(c + r), 2)


def solved(given: Space, size: int, box: int) -> Space:
    """The given cells with all that single candidates lead to."""
    return converge((given,), lambda known: known, lambda known: (known.union(sudoku_deductions(known, size, box)),))


# Terms


def _split(term: Space) -> DataFrame:
    """Leaves as position and symbol."""
    size = F.size("path")
    return term.frame.select(F.slice("path", F.lit(1), size - 1).alias("at"), F.element_at("path", -1).alias("s"))


def _below(term: Space) -> DataFrame:
    """What stands below each position, the leaf's own included."""
    cuts = F.explode(F.sequence(F.lit(0), F.size("path") - 1)).alias("n")
    rows = term.frame.select("path", cuts)
    return rows.select(F.slice("path", F.lit(1), F.col("n")).alias("at"), F.slice("path", F.col("n") + 1, F.size("path")).alias("rest"))


def differences(x: Space, y: Space) -> Space:
    """``bind.$v.position-text.rest...`` for variables that face another term, ``conflict.symbol.rest...`` for symbols that do.

    A term is the set of ``position... .symbol`` of its leaves; a symbol that starts with ``$`` is a variable.
    """
    parts = []
    for own, other in ((x, y), (y, x)):
        variables = _split(own).where(F.col("s").startswith("$"))
        faced = variables.join(_below(other), "at").where(F.col("rest") != F.array("s"))
        parts.append(faced.select(F.concat(F.array(F.lit("bind"), "s", F.array_join("at", ".")), "rest").alias("path")))
    symbols = _split(x).where(~F.col("s").startswith("$"))
    faced = symbols.join(_below(y), "at").where((F.col("rest") != F.array("s")) & ~((F.size("rest") == 1) & F.get("rest", F.lit(0)).startswith("$")))
    parts.append(faced.select(F.concat(F.array(F.lit("conflict"), "s"), "rest").alias("path")))
    return Space(parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct())


def substituted(term: Space, by: DataFrame) -> Space:
    """The term with the terms ``by(variable, rest)``, a row a leaf, in place of the leaves of their variables."""
    leaves = term.frame.withColumn("variable", F.element_at("path", -1)).join(by, "variable", "left")
    put = F.concat(F.slice("path", F.lit(1), F.size("path") - 1), "rest")
    return Space(leaves.select(F.when(F.col("rest").isNull(), F.col("path")).otherwise(put).alias("path")).distinct())


def unified(x: Space, y: Space, rounds: int | None = None) -> Space:
    """The most general common instance of two terms, or what conflicts, a variable that faces a term with itself in it included.

    A round binds, in both terms, all variables that face another term, each at one position, where no bound term has
    the variable in it; a variable faces a symbol before it faces a variable. If each is in another's term, the least
    is bound.
    """
    for _ in _rounds(rounds):
        x, y = Space(checkpointed(x.frame)), Space(checkpointed(y.frame))
        found = Space(checkpointed(differences(x, y).frame))
        conflict = found.restriction(Space.literal(x.frame.sparkSession, "conflict"))
        faced = found.unwrap("bind").frame.select(F.get("path", F.lit(0)).alias("variable"), F.get("path", F.lit(1)).alias("at"), F.slice("path", 3, REST).alias("rest"))
        last = F.element_at("rest", -1)
        occurs = faced.where((F.size("rest") > 1) & (last == F.col("variable"))).select(F.concat(F.array(F.lit("conflict"), "variable"), "rest").alias("path"))
        conflict = Space(checkpointed(conflict.frame.unionByName(occurs).distinct()))
        if not conflict.frame.isEmpty():
            return conflict
        if faced.isEmpty():
            return x
        where = faced.groupBy("variable", "at").agg(F.max(last.startswith("$") & (F.size("rest") == 1)).alias("plain"))
        one = where.groupBy("variable").agg(F.min(F.struct("plain", "at")).alias("w")).select("variable", "w.at")
        bound = checkpointed(faced.join(one, ["variable", "at"]).select("variable", "rest"))
        free = bound.join(bound.select(last.alias("variable")).distinct(), "variable", "left_anti")
        if free.isEmpty():
            free = bound.join(bound.agg(F.min("variable").alias("variable")), "variable", "left_semi")
        x, y = substituted(x, free), substituted(y, free)
    raise NotSettled("unified")


# Sets of sets


def representatives(parents: Space, items: Space) -> Space:
    """``item.root`` for each of the items: where the way up over ``item.parent`` ends.

    The way of an item is that of its parent; asked for all items at once.
    """
    up = checkpointed(parents.columns("item", "next"))

    def find(call, asked: Space) -> Space:
        own = asked.columns("item").join(up, "item", "left")
        top = own.where(F.col("next").isNull() | (F.col("next") == F.col("item"))).select(F.array("item", "item").alias("path"))
        more = own.where(F.col("next").isNotNull() & (F.col("next") != F.col("item")))
        above = call(Space(more.select(F.array("next").alias("path")).distinct(), lengths={1}))
        known = more.join(above.columns("next", "root"), "next").select(F.array("item", "root").alias("path"))
        return Space(top.unionByName(known).distinct(), lengths={2})

    found = recursive(find, Space(items.frame, lengths={1}))
    return found.restriction(items)
