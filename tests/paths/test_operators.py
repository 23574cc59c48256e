import random

import pytest

from pathloom.functions import grounded
from pathloom.functions.paths import interval, parse, rename_from
from pathloom.operators import patterns
from pathloom.operators.space import Path, Space
from pathloom.sources.tables import from_texts

from .model import SetSpace


@pytest.fixture
def s(spark):
    return lambda *paths: Space.literal(spark, *paths)


def rows(space):
    return {tuple(r.path) for r in space.frame.collect()}


def same(space, *texts):
    got = space.frame.collect()
    assert {tuple(r.path) for r in got} == {parse(t) for t in texts} and len(got) == len(set(texts))


def both(spark, run, **given):
    """The same program on spaces and on plain sets."""
    got = run(**{k: Space.literal(spark, *v) for k, v in given.items()}).frame.collect()
    want = run(**{k: SetSpace(v) for k, v in given.items()}).paths
    assert {tuple(r.path) for r in got} == set(want) and len(got) == len(want)
    return want


#: A harbour: quays with berths, ships and cargo, of different depth.
PORT = ["north.b1.ship.ore", "north.b1.ship.coal", "north.b2.crane", "north.b3", "south.b1.ship.ore", "south.b4.crane.old", "south", "east.b2.crane", "east.b9.ship.salt"]


def test_sets(spark):
    given = {"x": PORT, "y": [PORT[0], PORT[3], "west"], "z": ["west", "south"]}
    assert len(both(spark, lambda x, y, z: x.union(y, z), **given)) == 10
    assert len(both(spark, lambda x, y, z: x.intersection(y), **given)) == 2
    assert len(both(spark, lambda x, y, z: x.subtraction(z), **given)) == 8


def test_prefixes(s, spark):
    for prefixes in (["north.b1", "east"], ["south"], ["north.b1", "north.b1.ship", "west"], ["east.b2.crane.more"]):
        for op in ("restriction", "raffination"):
            both(spark, lambda x, y, op=op: getattr(x, op)(y), x=PORT, y=prefixes)
    both(spark, lambda x: x.unwrap("north.b1"), x=PORT)
    both(spark, lambda x: x.unwrap("south"), x=PORT)  # the empty path is left
    both(spark, lambda x: x.wrap("port.of"), x=PORT)
    same(s(*PORT).restriction(Space.literal(spark, ())), *PORT)
    same(s(*PORT).restriction(Space.empty(spark)))
    same(s(*PORT).raffination(Space.empty(spark)), *PORT)


def test_products_and_projections(spark):
    both(spark, lambda x, y: x.composition(y), x=PORT[:4], y=["u", "v.w"])
    assert len(both(spark, lambda x, y: x.composition(y), x=["p", "p.q"], y=["q.r", "r"])) == 3  # two pairs make one path
    both(spark, lambda x: x.tails_union(), x=PORT)
    assert both(spark, lambda x: x.tails_intersection(), x=["m.7", "m.8", "n.8", "n.9.9", "o.8"]) == {("8",)}
    for k in (1, 2, 3):
        both(spark, lambda x, k=k: x.heads(k), x=PORT)


def test_transformation(s, spark):
    moves = [("$quay.b1.$what", "$what.at.$quay"), ("$a.$b.crane", "$b"), ("south.$b", "$b.south"), ("$x.$y.$z.ore", "$z.$z")]
    for pattern, template in moves:
        both(spark, lambda x, p=pattern, t=template: x.transformation(p, t), x=[*PORT, "$any.b1.raft", "north.$b.crane"])
    with pytest.raises(ValueError):
        s("south").transformation("$x", "$y")


def test_residuals(s, spark):
    rows = [f"{q}.{b}.{c}" for q in ("north", "south") for b in ("b1", "b2") for c in ("tea", "rum")] + ["east.b1.tea", "east.b1.oil"]
    assert len(both(spark, lambda x, y: x.left_residual(y), x=rows, y=["tea", "rum"])) == 4
    both(spark, lambda x, y: x.right_residual(y), x=rows, y=["north.b1", "south.b2"])
    both(spark, lambda x, y: x.right_residual(y), x=rows, y=["north", "south"])
    same(s("u.v").left_residual(Space.empty(spark)), "u", "u.v")
    same(s("u.v").right_residual(Space.empty(spark)), "v", "u.v")


def test_order_and_guards(s, spark):
    x = s("b", "a.z", "c.d")
    same(x.first(2), "a.z", "b")
    same(x.last(1), "c.d")
    same(x.tee(s("t")), "t")
    same(x.on_empty(s("t")))
    same(Space.empty(spark).or_else(s("t")), "t")
    same(Space.empty(spark).tee(s("t")))


def test_iteration(s, spark):
    x = s("a.1", "a.2", "b.3")
    same(x.iterate(lambda h, t: t.wrap("q" + h)), "q.a.1", "q.a.2", "q.b.3")
    same(x.iterate(lambda h, t: t.card().wrap(h)), "a.2", "b.1")
    same(x.iterate_heads(lambda h: Space.single(spark, h + "x")), "a.x", "b.x")
    same(x.iterate_tails(lambda t: t), "1", "2", "3")
    same(x.iterate_tails(lambda t: s("k")), "k")
    same(Space.empty(spark).iterate_tails(lambda t: s("k")))
    same(x.iterate_first(2, lambda p, t: Space.single(spark, p)), "a.1", "a.2", "b.3")
    same(x.iterate_first(0, lambda p, t: t), "a.1", "a.2", "b.3")
    same(x.iterate(lambda h, k, t: Space.single(spark, k + h), 2), "1.a", "2.a", "3.b")


def test_text_form(spark):
    texts = ["a.b", "a.b..", "a..b", "", "...", "$x.y"]
    assert rows(from_texts(spark.createDataFrame([(t,) for t in texts] + [(None,)], "value string"))) == {parse(t) for t in texts}
    assert parse("a.b..") == ("a", "b") and parse("a..b") == ("a", "", "b") and parse("") == ("",)


def plain_names(left, right):
    """Names of the left variables, position by position, each taken once at most."""
    names, taken, out = {}, set(), []
    for k, item in enumerate(left):
        if item.startswith("$") and item not in names and k < len(right) and right[k].startswith("$"):
            names[item] = item if right[k] in taken else right[k]
            taken.add(names[item])
        out.append(names.get(item, item))
    return tuple(out)


def test_renamed_patterns():
    rng = random.Random(12)
    for _ in range(300):
        left, right = (tuple(rng.choice(["$p", "$q", "$r", "k", "m"]) for _ in range(rng.randrange(1, 6))) for _ in range(2))
        right = tuple(x.replace("$", "$n") for x in right)
        assert rename_from(left, right) == plain_names(left, right)
    assert rename_from(("k", "$p", "$q", "$p"), ("k", "$n", "$n")) == ("k", "$n", "$q", "$n")


def bound(pattern, path):
    """The variables of a pattern that the start of a path fits, and what follows as ``rest``; None if it doesn't."""
    names = {}
    fits = len(path) >= len(pattern) and all(names.setdefault(x, own) == own if x.startswith("$") else x == own for x, own in zip(pattern, path))
    return {**names, "rest": path[len(pattern) :]} if fits else None


def filled(template, names):
    return tuple(names[x] if x.startswith("$") else x for x in template)


def words():
    rng = random.Random(21)
    return [".".join(rng.choices("uvw", k=n)) for n in (3, 4, 5, 6) for _ in range(9)]


@pytest.mark.parametrize("pattern", ["$x.$y.$z", "$x.v.$x", "$x.$y.$x.$y", "u.$x.$x.$y", "$x.$x.$x", "w.$r"])
def test_patterns(s, pattern):
    rows = words()
    fit = [(parse(r), bound(parse(pattern), parse(r))) for r in rows]
    same(patterns.select(s(*rows), pattern), *{".".join(r) for r, n in fit if n})
    template = ("t", *dict.fromkeys(x for x in reversed(parse(pattern)) if x.startswith("$")))
    same(patterns.rewrite(s(*rows), pattern, template), *{".".join(filled(template, n) + n["rest"]) for _, n in fit if n})


def test_several_patterns(s):
    rows = words()
    several = ["u.$x.$y", "v.$x.$z"]
    first, second = ([bound(parse(p), parse(r)) for r in rows] for p in several)
    pairs = [{**a, **b} for a in first for b in second if a and b and a["$x"] == b["$x"]]
    assert pairs
    same(patterns.rewrite_all(s(*rows), several, "$y.$z"), *{".".join(filled(("$y", "$z"), n) + n["rest"]) for n in pairs})
    want = {".".join(filled(t, n)) for n in pairs for t in (("k", "$x"), ("l", "$z"))}
    same(patterns.rewrite_each(s(*rows), several, ["k.$x", "l.$z"]), *want)


def test_functions(s, spark):
    same(s("4", "2.9.3", "6.6.1", "7.0.-3", "n.m").flat_map(grounded.numbers_in), *{str(n) for r in (range(4), range(2, 9, 3), range(7, 0, -3)) for n in r})
    same(grounded.arithmetic(s("+.1.2", "+₂.1.2.10.20", "-.1.2", "+.a.b")), "3", "11.22")
    assert rows(grounded.space_hash(s("a", "b"))) == rows(grounded.space_hash(s("b", "a"))) != rows(grounded.space_hash(s("a")))
    assert len(rows(grounded.sample(s(*words()), "7", 2))) == 2
    same(s("2.3").iterate(lambda a, b: b.iterate_heads(lambda c: Space.single(spark, (a + c).apply(grounded.add)))), "5")
    same(s("b", "a.x", "c").highest("-"), "c")
    same(Space.empty(spark).lowest("-"), "-")
    same(s("a", "b").iterate_tails(lambda t: t.card()), "1")


@pytest.mark.parametrize("a,b", [(0, 0), (5, 11), (16, 47), (1, 62), (0, 63), (33, 33)])
def test_intervals(s, a, b):
    rng = random.Random(8)
    points = {n: ".".join(format(n, "06b")) + f".p{n}" for n in rng.sample(range(64), 30)}
    same(s(*points.values()).restriction(s(*interval(a, b, 6))), *[t for n, t in points.items() if a <= n <= b])


def _program(rng, depth, heads, sets):
    """A random program: a function of a literal maker, given paths and spaces in scope."""
    pick = rng.randrange
    if depth == 0 or pick(6) == 0:
        k = pick(3)
        if k == 0 and sets:
            name = rng.choice(sets)
            return lambda lit, env: env[name]
        if k == 1 and heads:
            name = rng.choice(heads)
            return lambda lit, env: lit.single(env[name])
        paths = [tuple(rng.choice("ab") for _ in range(pick(4))) for _ in range(pick(4))]
        return lambda lit, env: lit.space(paths)
    op = rng.choice(["union", "intersection", "subtraction", "restriction", "raffination", "composition", "iterate", "iterate", "iterate2", "unwrap", "wrap", "tails_union", "tails_intersection", "card", "first", "last", "heads", "left_residual", "right_residual", "on_empty", "tee", "or_else"])
    sub = lambda h=heads, t=sets: _program(rng, depth - 1, h, t)
    if op.startswith("iterate"):
        k = 2 if op == "iterate2" else 1
        names, tail, source = [f"h{depth}{i}{pick(99)}" for i in range(k)], f"t{depth}{pick(99)}", sub()
        body = sub([*heads, *names], [*sets, tail])
        return lambda lit, env: source(lit, env).iterate(lambda *a: body(lit, {**env, **dict(zip([*names, tail], a))}), k)
    if op in ("unwrap", "wrap"):
        a, name = sub(), rng.choice([*heads, None])
        return lambda lit, env: getattr(a(lit, env), op)(env[name] if name else "b")
    if op in ("tails_union", "tails_intersection", "card"):
        a = sub()
        return lambda lit, env: getattr(a(lit, env), op)()
    if op in ("first", "last", "heads"):
        a, n = sub(), 1 + pick(2)
        return lambda lit, env: getattr(a(lit, env), op)(n)
    a, b = sub(), sub()
    return lambda lit, env: getattr(a(lit, env), op)(b(lit, env))


class _Spark:
    def __init__(self, spark):
        self.spark = spark

    def space(self, paths):
        return Space.literal(self.spark, *paths)

    def single(self, path):
        return Space.single(self.spark, path)


class _Plain:
    def space(self, paths):
        return SetSpace(paths)

    def single(self, path):
        return SetSpace([path])


@pytest.mark.parametrize("seed", range(40))
def test_random_programs(spark, seed):
    rng = random.Random(seed)
    for _ in range(40):
        program = _program(rng, 3, [], ["x", "y"])
        given = {k: [tuple(rng.choice("abc") for _ in range(1 + rng.randrange(3))) for _ in range(6)] for k in "xy"}
        want = program(_Plain(), {k: SetSpace(v) for k, v in given.items()}).paths
        if want:
            break
    got = program(_Spark(spark), {k: Space.literal(spark, *v) for k, v in given.items()}).frame.collect()
    assert {tuple(r.path) for r in got} == set(want)
    assert len(got) == len(want)


def test_relations(s):
    same(s("a.b", "b.c", "a.c", "x").relation(s("b.d", "c.d", "c.e")), "a.d", "a.e", "b.d", "b.e")
    same(s("a.b", "b", "c.d.b", "b.a").ending_in(s("b", "q")), "a.b", "b", "c.d.b")
    x = s("k.a.b", "l.b.c")
    same(x.iterate(lambda k, t: t.relation(s("b.z", "c.z")).wrap(k)), "k.a.z", "l.b.z")
