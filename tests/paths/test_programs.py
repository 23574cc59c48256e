import random

import pytest

from pathloom.functions.paths import parse
from pathloom.operators import patterns
from pathloom.operators.space import Space
from pathloom.plans import fixpoint, programs


@pytest.fixture
def s(spark):
    return lambda *paths: Space.literal(spark, *paths)


def same(space, *texts):
    got = space.frame.collect()
    assert {tuple(r.path) for r in got} == {parse(t) for t in texts} and len(got) == len(set(texts))


def relatives(seed=4):
    """Three generations, each child with two parents of the one before."""
    rng = random.Random(seed)
    people = [[f"g{g}p{k}" for k in range(6)] for g in range(3)]
    parent = {(p, c) for g in (1, 2) for c in people[g] for p in rng.sample(people[g - 1], 2)}
    everyone = [p for g in people for p in g]
    return everyone, parent, {p for p in everyone if rng.random() < 0.6}


def test_family(s, spark):
    everyone, parent, women = relatives()
    men = set(everyone) - women
    base = [f"parent.{p}.{c}" for p, c in parent] + [f"female.{w}" for w in women] + [f"male.{m}" for m in men]
    whole = base + [f"child.{c}.{p}" for p, c in parent] + [f"person.{p}" for p in everyone]
    same(programs.indexed(s(*base)), *whole)
    family, people = s(*whole), s(*everyone)
    same(programs.parents(family, people), *{f"{c}.{p}" for p, c in parent})
    same(programs.mothers(family, people), *{f"{c}.{p}" for p, c in parent if p in women})
    same(programs.sisters(family, people), *{f"{c}.{d}" for p, c in parent for q, d in parent if p == q and c != d and d in women})
    up = {(c, p) for p, c in parent}
    near = {(c, a) for c, p in up for d, g in up if d == p for h, a in parent if h == g and a in women}
    same(programs.aunts(family, people), *{f"{c}.{a}" for c, a in near - up})
    far = closed(up)
    same(people.iterate_heads(lambda p: programs.ancestors(family, Space.single(spark, p)).wrap(p)), *{f"{c}.{a}" for c, a in far})


def closed(pairs):
    out = set(pairs)
    while True:
        more = {(a, d) for a, b in out for c, d in pairs if b == c} - out
        if not more:
            return out
        out |= more


def graph(seed, nodes, edges):
    rng = random.Random(seed)
    return {(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(edges)}


def dotted(pairs):
    return [f"{a}.{b}" for a, b in pairs]


@pytest.mark.parametrize("seed", [1, 2])
def test_closures(s, seed):
    edges = graph(seed, 14, 16)
    same(fixpoint.closure(s(*dotted(edges))), *dotted(closed(edges)))
    naive = fixpoint.inflationary(s(*dotted(edges)), lambda last: patterns.rewrite_all(last, ["$a.$b", "$b.$c"], "$a.$c"))
    same(naive, *dotted(closed(edges)))


def test_the_closure_of_a_long_chain(spark):
    n = 300
    edges = Space(spark.range(n).selectExpr("array(cast(id as string), cast(id + 1 as string)) path"), lengths={2})
    assert fixpoint.closure(edges).frame.count() == n * (n + 1) // 2


def test_a_closure_makes_pairs_once(spark):
    """Not once for each edge at which its way may be cut."""
    n, made = 300, []
    edges = Space(spark.range(n).selectExpr("array(cast(id as string), cast(id + 1 as string)) path"), lengths={2})

    def then(x, y):
        made.append(x.columns("a", "b").join(y.columns("b", "c"), "b").count())
        return x.relation(y)

    pairs = n * (n + 1) // 2
    assert fixpoint.doubling(edges, then).frame.count() == pairs
    assert sum(made) < 1.1 * pairs


@pytest.mark.parametrize("seed", range(3))
def test_doubling_by_patterns(s, seed):
    """Loops and chords included: what a round makes may be nearer already."""
    edges = graph(seed, 9, 14) | {("n0", "n0"), ("m0", "m1"), ("m1", "m2"), ("m2", "m3"), ("m3", "m4"), ("m4", "m0"), ("m1", "m3")}
    found = fixpoint.doubling(s(*dotted(edges)), lambda *ways: patterns.rewrite_all(ways, ["$a.$b", "$b.$c"], "$a.$c"))
    same(found, *dotted(closed(edges)))
    assert found.frame.count() == len(closed(edges))


def test_reachable(s):
    edges = graph(3, 20, 24)
    nodes = {x for e in edges for x in e}
    start, inside = sorted(nodes)[:2], set(sorted(nodes)[2:-3])
    far = closed(edges)
    same(fixpoint.reachable(s(*dotted(edges)), s(*start)), *set(start) | {b for a, b in far if a in start})
    kept = closed({(a, b) for a, b in edges if {a, b} <= inside | set(start)})
    within = s(*inside | set(start))
    same(fixpoint.reachable(s(*dotted(edges)), s(*start), within), *set(start) | {b for a, b in kept if a in start})


@pytest.mark.parametrize("seed,nodes,edges", [(5, 16, 26), (6, 12, 14)])
def test_strong_components(s, seed, nodes, edges):
    pairs = graph(seed, nodes, edges)
    far = closed(pairs)
    of = {a: min([a, *(b for x, b in far if x == a and (b, a) in far)]) for a, _ in far}
    same(fixpoint.strong_components(s(*dotted(pairs))), *{f"{r}.{a}" for a, r in of.items() if r != a})


def test_no_strong_components(s, spark):
    same(fixpoint.strong_components(s("k.m", "m.o", "k.o", "o.o")))
    same(fixpoint.strong_components(Space.empty(spark)))


def test_sets(s, spark):
    rng = random.Random(9)
    held = {(f"cook{rng.randrange(8)}", f"dish{rng.randrange(4)}") for _ in range(22)}
    asked = {"dish0", "dish1"}
    same(programs.division(s(*dotted(held)), s(*asked)), *{c for c, _ in held if all((c, d) in held for d in asked)})
    same(programs.division(s(*dotted(held)), Space.empty(spark)), *{c for c, _ in held})
    same(programs.tagged_union(s("ink.4", "pen"), s("ink.4", "cup.of.tea"), "here", "there"), "ink.here.4", "pen.here", "ink.there.4", "cup.there.of.tea")
    p, q = ["2.a.u.u", "1.b.u", "0.c"], ["3.d.v.v.v", "0.e"]
    want = {".".join([x[0], y[0], x[1], y[1], *x[2:], *y[2:]]) for x in map(parse, p) for y in map(parse, q)}
    same(programs.polynomial_product(s(*p), s(*q)), *want)


def test_sequences(s):
    rng = random.Random(2)
    rows = {f"id{k}": [str(rng.randrange(4)) for _ in range(rng.randrange(1, 9))] for k in range(12)}
    space = s(*[".".join([k, *v]) for k, v in rows.items()])
    for depth, width in ((5, None), (None, 2), (3, 2)):
        index = programs.suffix_index(space, depth=depth, width=width)
        for phrase in ("1", "0.2", "3.3"):
            w = phrase.split(".")
            starts = lambda v: range(len(v) if depth is None else min(depth, len(v)))
            same(programs.containing(index, phrase), *{k for k, v in rows.items() if any(v[i : i + len(w)] == w for i in starts(v))})


def test_life(s):
    rng = random.Random(6)
    cells = {(rng.randrange(6), rng.randrange(6)) for _ in range(14)}

    def after(cells, inside):
        near = lambda x, y: sum((x + i, y + j) in cells for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)
        return {(x, y) for x in range(-1, 8) for y in range(-1, 8) if (near(x, y) == 3 or near(x, y) == 2 and (x, y) in cells) and (inside is None or {x, y} <= inside)}

    for inside in (None, set(range(5))):
        got = programs.life_step(s(*[f"{x}.{y}" for x, y in cells]), None if inside is None else s(*map(str, inside)))
        same(got, *[f"{x}.{y}" for x, y in after(cells, inside)])


def test_life_groups_once(s):
    """One shuffle of places; the cells were joined again and the places made twice before."""
    cells = programs.life_step(s("1.1", "1.2", "1.3"))
    same(cells, "0.2", "1.2", "2.2")
    plan = cells.frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_heads_in_the_path_keep_groups_apart(s):
    """No grouping where a path names its group, and one where it doesn't."""
    pairs = s("a.x", "a.y", "b.x")
    turned = pairs.iterate(lambda a, bs: bs.iterate(lambda b, rest: rest.wrap(b + a)))
    same(turned, "x.a", "y.a", "x.b")
    assert "Aggregate" not in turned.frame._jdf.queryExecution().optimizedPlan().toString()
    same(pairs.iterate(lambda a, bs: bs.wrap("t")), "t.x", "t.y")
    same(pairs.iterate(lambda a, bs: bs.iterate(lambda b, rest: rest.wrap("t" + a))), "t.a", "t.b")


def test_puzzles(s, spark):
    def placements(n, rows=()):
        if len(rows) == n:
            return 1
        return sum(placements(n, (*rows, c)) for c in range(n) if all(c != d and abs(c - d) != len(rows) - k for k, d in enumerate(rows)))

    assert [programs.queens(spark, n).frame.count() for n in (1, 4, 6)] == [placements(n) for n in (1, 4, 6)]
    line = s("0.1", "1.0", "1.2", "2.1")  # tiles in a row keep their order
    same(programs.sliding_states(s("k._.m"), line), "k._.m", "_.k.m", "k.m._")


def test_sudoku(s):
    given = {(1, 1): 3, (2, 2): 1, (3, 1): 4, (4, 3): 2, (2, 4): 2}

    def free(known):
        box = lambda c, r: ((c - 1) // 2, (r - 1) // 2)
        return {(c, r, v) for c in range(1, 5) for r in range(1, 5) for v in range(1, 5) if (c, r) not in known
                and not any(w == v and (d == c or q == r or box(d, q) == box(c, r)) for (d, q), w in known.items())}

    known = dict(given)
    space = s(*[f"{c}.{r}.{v}" for (c, r), v in given.items()])
    same(programs.sudoku_candidates(space, 4, 2), *[f"{c}.{r}.{v}" for c, r, v in free(given)])
    while True:
        of = {}
        for c, r, v in free(known):
            of.setdefault((c, r), []).append(v)
        sure = {k: v[0] for k, v in of.items() if len(v) == 1}
        if not sure:
            break
        known |= sure
    assert len(known) > len(given)
    same(programs.solved(space, 4, 2), *[f"{c}.{r}.{v}" for (c, r), v in known.items()])


def test_a_recursion_that_does_not_settle(s):
    with pytest.raises(fixpoint.NotSettled):
        fixpoint.least_fixpoint(s("q"), lambda _, new: new.wrap("q"), rounds=3)


def test_converge_unions_the_states(s):
    after = {"red": "amber", "amber": "green", "green": "green"}
    out = fixpoint.converge((s("red"),), lambda x: x, lambda x: (s(*[after[r.path[0]] for r in x.frame.collect()]),))
    same(out, "red", "amber", "green")


def test_representatives(s):
    rng = random.Random(11)
    parent = {k: rng.randrange(k) for k in range(1, 25) if rng.random() < 0.8}

    def root(k):
        return root(parent[k]) if k in parent else k

    space = s(*[f"{k}.{p}" for k, p in parent.items()])
    same(programs.representatives(space, s(*map(str, range(25)))), *[f"{k}.{root(k)}" for k in range(25)])


def test_unification(s):
    # A house of rooms: shared unknowns are found through either side, in any order.
    x = s("hall.$h", "kitchen.floor.$f", "kitchen.wall.red", "attic.$h", "yard.$y")
    y = s("hall.oak", "kitchen.floor.tile", "kitchen.wall.$w", "attic.$a", "yard.gate.$w", "yard.path.$f")
    same(programs.unified(x, y), "hall.oak", "kitchen.floor.tile", "kitchen.wall.red", "attic.oak", "yard.gate.red", "yard.path.tile")
    x, y = s("p.$k", "q.$m", "r.$k"), s("p.$m", "q.$n", "r.$n")
    assert len({r.path[1] for r in programs.unified(x, y).frame.collect()}) == 1
    same(programs.unified(s("p.ink", "q.pen"), s("p.ink", "q.cup")), "conflict.pen.cup")
    same(programs.unified(s("p.$k"), s("p.more.$k", "p.less.cup")), "conflict.$k.more.$k")
