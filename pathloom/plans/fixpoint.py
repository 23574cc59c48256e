"""Recursion as loops of Spark jobs: each round is checkpointed, and the driver sees only whether anything is new."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.space import Space
from .lineage import checkpointed


class NotSettled(RuntimeError):
    """A recursion that was still changing after the rounds that it was given."""


def _rounds(rounds: int | None):
    return count() if rounds is None else range(rounds)


def _kept(space: Space) -> Space:
    return Space(checkpointed(space.frame), space.keys, space.lengths)


class _Parts:
    """A growing set as disjoint parts that are written once; parts of one size class are joined, so that they stay few."""

    def __init__(self, start: Space):
        self.space, self.parts = start, [(0, start.frame)]

    def add(self, new: Space) -> None:
        size, frame = 0, new.frame
        while len(self.parts) > 8 and self.parts[-1][0] <= size:
            last, more = self.parts.pop()
            size, frame = last + 1, checkpointed(frame.unionByName(more))
        self.parts.append((size, frame))
        known = self.space.lengths is not None and new.lengths is not None
        lengths = self.space.lengths | new.lengths if known else None
        self.space = Space(reduce(DataFrame.unionByName, [f for _, f in self.parts]), self.space.keys, lengths)


def least_fixpoint(start: Space, step: Callable[[Space, Space], Space], rounds: int | None = None) -> Space:
    """The least set that holds ``start`` and is closed under ``step(all, new)``.

    ``step`` gives what follows from the paths of the last round, ``new``, with any of ``all``; steps of old paths
    alone aren't asked for again. A round writes its new paths only. It ends by itself if the set is finite; ``rounds``
    may bound it.
    """
    new = _kept(start)
    every = _Parts(new)
    for _ in _rounds(rounds):
        new = _kept(step(every.space, new).subtraction(every.space))
        if new.frame.isEmpty():
            return every.space
        every.add(new)
    raise NotSettled("least_fixpoint")


def inflationary(start: Space, step: Callable[[Space], Space], rounds: int | None = None) -> Space:
    """``start``, then what ``step`` of all so far adds, until it adds nothing; ``step`` may be any function of sets."""
    return least_fixpoint(start, lambda every, _: step(every), rounds)


def converge(state: tuple[Space, ...], emit: Callable[..., Space], step: Callable[..., tuple[Space, ...]], rounds: int | None = None) -> Space:
    """The union of ``emit`` over the states that ``step`` goes through until one repeats itself."""
    state = tuple(map(_kept, state))
    out = _kept(emit(*state))
    for _ in _rounds(rounds):
        after = tuple(map(_kept, step(*state)))
        out = _kept(out.union(emit(*after)))
        if all(_same(a, b) for a, b in zip(state, after)):
            return out
        state = after
    raise NotSettled("converge")


def recursive(function: Callable[[Callable[[Space], Space], Space], Space], argument: Space, rounds: int | None = None) -> Space:
    """The least result of ``f(argument)`` for a function whose body may ask for itself: ``function(f, argument)``.

    A call is known by the name of its argument, a set that the recursion keeps: all that any call was asked for in a
    round is one argument of the next, and its answer grows until nothing is added. The body has to be a function that
    gives more for more, of the argument and of what calls answer; a call answers with all that is known so far.
    """
    asked = answer = None
    for _ in _rounds(rounds):
        now = argument if asked is None else asked
        wanted: list[Space] = []

        def call(of: Space) -> Space:
            wanted.append(of)
            return answer if answer is not None else Space(of.frame.limit(0), lengths=())

        got = function(call, now)
        more = _kept(reduce(Space.union, [got] if answer is None else [answer, got]))
        ask = _kept(reduce(Space.union, [now, *wanted]))
        done = answer is not None and more.subtraction(answer).frame.isEmpty() and ask.subtraction(now).frame.isEmpty()
        asked, answer = ask, more
        if done:
            return answer
    raise NotSettled("recursive")


def _same(a: Space, b: Space) -> bool:
    return a.subtraction(b).frame.isEmpty() and b.subtraction(a).frame.isEmpty()


def doubling(edges: Space, then: Callable[[Space, Space], Space]) -> Space:
    """The pairs ``a.b`` between which there is a way over ``edges``; ``then`` gives ``a.c`` for its ``a.b`` and ``b.c``.

    A pair is known by its shortest way. A round knows the pairs up to ``n`` edges apart and asks for what lies just ``n``
    edges after any of them: the pairs up to ``2 n`` apart, so that no way is cut at each of its edges, as it is where
    new pairs meet all. Where no pair is ``n`` edges apart none is farther.
    """
    far = _kept(Space(edges.frame, lengths={2}))
    every, near = _Parts(far), None
    while not far.frame.isEmpty():
        between = None if near is None else _kept(then(near, far).subtraction(every.space))
        ahead = then(far, far).subtraction(every.space)
        ahead = _kept(ahead if between is None else ahead.subtraction(between))
        if between is not None:
            every.add(between)
        near, far = every.space, ahead
        every.add(far)
    return every.space


def closure(edges: Space) -> Space:
    """The transitive closure of pairs."""
    return doubling(edges, Space.relation)


def reachable(edges: Space, start: Space, within: Space | None = None) -> Space:
    """The items of ``start`` and those that can be reached from them over edges whose ends lie ``within``.

    A round goes one edge on from the items of the last.
    """
    pairs = edges.columns("_a", "_b")
    if within is not None:
        inside = within.columns("_b")
        pairs = pairs.join(inside, "_b", "left_semi").join(inside.withColumnRenamed("_b", "_a"), "_a", "left_semi")
    pairs = checkpointed(pairs.select("_a", "_b").distinct())

    def next_to(_: Space, new: Space) -> Space:
        rows = new.columns("_a").join(pairs, "_a").select(F.array("_b").alias("path"))
        return Space(rows.distinct(), lengths={1})

    return least_fixpoint(Space(start.frame, lengths={1}), next_to)


def _spread(pairs: DataFrame) -> DataFrame:
    """``(n, l)`` with the least node that reaches each node over ``pairs(a, b)``.

    What reaches a node's label reaches the node, so that a round also takes the label of its label: ways double.
    """
    label = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct().select("n", F.col("n").alias("l")))
    while True:
        own = label.select("n", "l", F.col("l").alias("before"))
        come = label.join(pairs, label["n"] == pairs["a"]).select(F.col("b").alias("n"), "l", F.lit(None).cast("string").alias("before"))
        jump = label.join(label.select(F.col("n").alias("l"), F.col("l").alias("_far")), "l").select("n", F.col("_far").alias("l"), F.lit(None).cast("string").alias("before"))
        after = checkpointed(own.unionByName(come).unionByName(jump).groupBy("n").agg(F.min("l").alias("l"), F.max("before").alias("before")))
        label = after.select("n", "l")
        if after.where("l != before").isEmpty():
            return label


def strong_components(edges: Space) -> Space:
    """``representative.member`` for the members of each strong component of two nodes or more.

    The representative is the least member. Each round gives every node the least node that reaches it and the least
    that it reaches. Where these are one node, the node is in its component and leaves; edges stay between nodes that
    have both in common.
    """
    pairs = checkpointed(edges.columns("a", "b").distinct()).where("a != b")
    parts = []
    while not pairs.isEmpty():
        down, up = _spread(pairs), _spread(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = checkpointed(down.join(up.withColumnRenamed("l", "r"), "n"))
        parts.append(both.where("l = r and n != l").select(F.array("l", "n").alias("path")))
        left = both.where("l != r")
        of = [left.select(F.col("n").alias(x), F.col("l").alias("l" + x), F.col("r").alias("r" + x)) for x in "ab"]
        pairs = checkpointed(pairs.join(of[0], "a").join(of[1], "b").where("la = lb and ra = rb").select("a", "b"))
    out = reduce(DataFrame.unionByName, parts) if parts else edges.frame.limit(0).select("path")
    return Space(checkpointed(out), lengths={2})
