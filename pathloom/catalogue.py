"""Registered queries of the path-set language and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import grounded
from .functions.paths import interval, prefixes, text_of
from .operators import patterns
from .operators.space import ITEMS, Path, Space
from .plans import fixpoint, programs
from .sources.tables import facts, from_texts, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


# Spaces of the tables


def _nations(spark, sf):
    return facts(table(spark, sf, "nation"), "nation", "n_regionkey", "n_nationkey", distinct=False)


def _customers(spark, sf):
    return facts(table(spark, sf, "customer"), "cust", "c_nationkey", "c_custkey", distinct=False)


def _orders(spark, sf):
    return facts(table(spark, sf, "orders"), None, "o_custkey", "o_orderkey", distinct=False)


def _sells(spark, sf):
    return facts(table(spark, sf, "lineitem"), None, "l_suppkey", "l_partkey")


def _did(spark, sf):
    return facts(table(spark, sf, "events"), None, "user_id", "event_type")


def _lines(spark, sf):
    return facts(table(spark, sf, "lineitem"), None, "l_linestatus", "l_returnflag", "l_suppkey")


def _priorities(spark, sf):
    return facts(table(spark, sf, "orders"), None, "o_custkey", "o_orderpriority")


#: From each customer to the one with the last order of a part: the least of the customer's first order.
_GRAPH = """select distinct a::varchar as a, o_custkey::varchar as b from (select o_custkey as a, min(o_orderkey) as k from orders group by 1)
 join (select l_orderkey as k, min(l_partkey) as p from lineitem group by 1) using (k)
 join (select l_partkey as p, max(l_orderkey) as last from lineitem group by 1) using (p) join orders on o_orderkey = last"""


def _graph(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    first = orders.groupBy(F.col("o_custkey").alias("a")).agg(F.min("o_orderkey").alias("k"))
    part = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_partkey").alias("p"))
    last = lines.groupBy(F.col("l_partkey").alias("p")).agg(F.max("l_orderkey").alias("o_orderkey"))
    return facts(first.join(part, "k").join(last, "p").join(orders, "o_orderkey"), None, "a", "o_custkey")


_CLOSURE = f"with recursive e as ({_GRAPH}), c as (select a, b from e union select c.a, e.b from c join e on c.b = e.a)"


@_query("select 'nation' as tag, n_regionkey::varchar as regionkey, n_nationkey::varchar as nationkey from nation where n_regionkey = 1")
def q01_unwrap_wrap(spark, sf):
    return _nations(spark, sf).unwrap("nation.1").wrap("nation.1").columns("tag", "regionkey", "nationkey")


@_query("select c_nationkey::varchar as nationkey from customer union select s_nationkey::varchar from supplier")
def q02_union(spark, sf):
    return facts(table(spark, sf, "customer"), None, "c_nationkey").union(facts(table(spark, sf, "supplier"), None, "s_nationkey")).columns("nationkey")


@_query("select c_nationkey::varchar as nationkey from customer intersect select s_nationkey::varchar from supplier")
def q03_intersect(spark, sf):
    return facts(table(spark, sf, "customer"), None, "c_nationkey").intersection(facts(table(spark, sf, "supplier"), None, "s_nationkey")).columns("nationkey")


@_query("""select c_custkey::varchar as custkey, p as priority from customer, (select distinct o_orderpriority as p from orders)
 except select o_custkey::varchar, o_orderpriority from orders""")
def q04_subtract(spark, sf):
    priorities = facts(table(spark, sf, "orders"), None, "o_orderpriority")
    every = facts(table(spark, sf, "customer"), None, "c_custkey", distinct=False).composition(priorities)
    return every.subtraction(_priorities(spark, sf)).columns("custkey", "priority")


def _building(spark, sf):
    """Customers of a segment, as prefixes of one item, and orders of a priority, as prefixes of two."""
    customers = facts(table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), None, "c_custkey", distinct=False)
    return customers.union(facts(table(spark, sf, "orders").where("o_orderpriority = '5-LOW'"), None, "o_custkey", "o_orderkey", distinct=False))


_BUILDING = "(o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') or o_orderpriority = '5-LOW')"


@_query(f"select o_custkey::varchar as custkey, o_orderkey::varchar as orderkey from orders where {_BUILDING}")
def q05_restrict(spark, sf):
    return _orders(spark, sf).restriction(_building(spark, sf)).columns("custkey", "orderkey")


@_query(f"select o_custkey::varchar as custkey, o_orderkey::varchar as orderkey from orders where not {_BUILDING}")
def q06_raffinate(spark, sf):
    return _orders(spark, sf).raffination(_building(spark, sf)).columns("custkey", "orderkey")


@_query("select distinct r_name as region, o_orderpriority as priority from region cross join (select distinct o_orderpriority from orders)")
def q07_compose(spark, sf):
    return facts(table(spark, sf, "region"), None, "r_name").composition(facts(table(spark, sf, "orders"), None, "o_orderpriority")).columns("region", "priority")


@_query("select distinct l_partkey::varchar as partkey from lineitem")
def q08_tails_union(spark, sf):
    return _sells(spark, sf).tails_union().columns("partkey")


@_query("""select l_partkey::varchar as partkey from lineitem group by 1
 having count(distinct l_returnflag) = (select count(distinct l_returnflag) from lineitem)""")
def q09_tails_intersection(spark, sf):
    return facts(table(spark, sf, "lineitem"), None, "l_returnflag", "l_partkey").tails_intersection().columns("partkey")


@_query("""select distinct n_regionkey::varchar as regionkey, o_orderpriority as priority from nation join customer on c_nationkey = n_nationkey
 join orders on o_custkey = c_custkey""")
def q10_iter_join(spark, sf):
    nations = facts(table(spark, sf, "nation"), None, "n_regionkey", "n_nationkey", distinct=False)
    customers, orders = _customers(spark, sf).unwrap("cust"), _priorities(spark, sf)

    def of_region(region: Path, own: Space) -> Space:
        held = own.iterate_heads(lambda nation: customers.unwrap(nation).iterate_heads(lambda customer: orders.unwrap(customer)))
        return held.wrap(region)

    return nations.iterate(of_region).columns("regionkey", "priority")


@_query("select distinct l_partkey::varchar as partkey, l_orderkey::varchar as orderkey from lineitem")
def q11_iter_invert(spark, sf):
    orders = facts(table(spark, sf, "lineitem"), None, "l_orderkey", "l_partkey")
    return orders.iterate(lambda order, parts: parts.iterate(lambda part, rest: rest.wrap(part + order))).columns("partkey", "orderkey")


@_query("select l_linestatus as linestatus, l_returnflag as returnflag, count(distinct l_suppkey)::varchar as suppliers from lineitem group by 1, 2")
def q12_iterk(spark, sf):
    return _lines(spark, sf).iterate_first(2, lambda both, suppliers: suppliers.card().wrap(both)).columns("linestatus", "returnflag", "suppliers")


@_query("select distinct l_linestatus as linestatus, l_returnflag as returnflag from lineitem")
def q13_headk(spark, sf):
    return _lines(spark, sf).heads(2).columns("linestatus", "returnflag")


_URGENT = "select o_custkey, count(distinct o_orderkey) as n from orders where o_orderpriority = '1-URGENT' group by 1"


def _urgent(spark, sf):
    return facts(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'"), None, "o_custkey", "o_orderkey", distinct=False)


@_query(f"select c_custkey::varchar as custkey, coalesce(n, 0)::varchar as urgent from customer left join ({_URGENT}) on c_custkey = o_custkey")
def q14_card(spark, sf):
    urgent = _urgent(spark, sf)
    customers = facts(table(spark, sf, "customer"), None, "c_custkey", distinct=False)
    return customers.iterate_heads(lambda c: urgent.unwrap(c).card().wrap(c)).columns("custkey", "urgent")


@_query(f"select c_custkey::varchar as custkey from customer where c_custkey not in (select o_custkey from ({_URGENT}))")
def q15_on_empty(spark, sf):
    urgent = _urgent(spark, sf)
    customers = facts(table(spark, sf, "customer"), None, "c_custkey", distinct=False)
    return customers.iterate_heads(lambda c: urgent.unwrap(c).on_empty(Space.single(spark, c))).columns("custkey")


@_query(f"select c_custkey::varchar as custkey from customer where c_custkey in (select o_custkey from ({_URGENT}))")
def q16_tee(spark, sf):
    urgent = _urgent(spark, sf)
    customers = facts(table(spark, sf, "customer"), None, "c_custkey", distinct=False)
    return customers.iterate_heads(lambda c: urgent.unwrap(c).tee(Space.single(spark, c))).columns("custkey")


@_query("select o_custkey::varchar as custkey, min(o_orderkey::varchar) as orderkey from orders group by 1")
def q17_first(spark, sf):
    return _orders(spark, sf).iterate(lambda c, own: own.first(1).wrap(c)).columns("custkey", "orderkey")


@_query("select o_custkey::varchar as custkey, max(o_orderkey::varchar) as orderkey from orders group by 1")
def q18_last(spark, sf):
    return _orders(spark, sf).iterate(lambda c, own: own.last(1).wrap(c)).columns("custkey", "orderkey")


@_query("""select user_id::varchar as user_id from events group by 1
 having count(distinct event_type) = (select count(distinct event_type) from events)""")
def q19_left_residual(spark, sf):
    did = _did(spark, sf)
    return did.left_residual(did.tails_union()).columns("user_id")


@_query("""select l_returnflag as returnflag from lineitem group by 1
 having count(distinct l_linestatus) = (select count(distinct l_linestatus) from lineitem)""")
def q20_right_residual(spark, sf):
    flags = facts(table(spark, sf, "lineitem"), None, "l_linestatus", "l_returnflag")
    return flags.right_residual(flags.heads()).columns("returnflag")


@_query("select o_custkey::varchar as custkey from orders group by 1 having count(distinct o_orderpriority) = (select count(distinct o_orderpriority) from orders)")
def q21_division(spark, sf):
    held = _priorities(spark, sf)
    return programs.division(held, held.tails_union()).columns("custkey")


@_query("select distinct 'by' as tag, user_id::varchar as user_id, event_type from events")
def q22_transformation(spark, sf):
    events = facts(table(spark, sf, "events"), "event", "event_type", "user_id")
    return events.transformation("event.$type.$user", "by.$user.$type").columns("tag", "user_id", "event_type")


def _statuses(spark, sf):
    both = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return facts(both, None, "l_linestatus", "l_returnflag", "o_orderstatus")


_STATUSES = "select distinct l_linestatus as a, l_returnflag as b, o_orderstatus as c from lineitem join orders on l_orderkey = o_orderkey"


@_query(f"select a, b, c from ({_STATUSES}) where a = c")
def q23_pattern_q(spark, sf):
    return patterns.select(_statuses(spark, sf), "$a.$b.$a").columns("a", "b", "c")


@_query(f"select distinct 'flag' as tag, b, a from ({_STATUSES}) where a = c")
def q24_pattern_t(spark, sf):
    return patterns.rewrite(_statuses(spark, sf), "$a.$b.$a", "flag.$b.$a").columns("tag", "b", "a")


def _places(spark, sf):
    region = facts(table(spark, sf, "nation"), "region", "n_regionkey", "n_nationkey", distinct=False)
    segments = facts(table(spark, sf, "customer"), "segment", "c_mktsegment", "c_custkey", distinct=False)
    return region.union(_customers(spark, sf), segments)


@_query("select distinct 'in' as tag, n_regionkey::varchar as regionkey, c_custkey::varchar as custkey from nation join customer on c_nationkey = n_nationkey")
def q25_mqt(spark, sf):
    return patterns.rewrite_all(_places(spark, sf), ["region.$r.$n", "cust.$n"], "in.$r").columns("tag", "regionkey", "custkey")


@_query("""with j as (select n_regionkey::varchar as r, c_mktsegment as s, c_nationkey::varchar as n from nation join customer on c_nationkey = n_nationkey)
 select 'rs' as tag, r as x, s as y from j union select 'sn', s, n from j""")
def q26_mqmt(spark, sf):
    made = patterns.rewrite_each(_places(spark, sf), ["region.$r.$n", "cust.$n.$c", "segment.$s.$c"], ["rs.$r.$s", "sn.$s.$n"])
    return made.columns("tag", "x", "y")


@_query(f"{_CLOSURE} select a, b from c")
def q27_transitive(spark, sf):
    return fixpoint.doubling(_graph(spark, sf), lambda *ways: patterns.rewrite_all(ways, ["$a.$b", "$b.$c"], "$a.$c")).columns("a", "b")


@_query(f"{_CLOSURE} select a, b from c")
def q28_semi_naive(spark, sf):
    return fixpoint.closure(_graph(spark, sf)).columns("a", "b")


@_query(f"""with recursive e as ({_GRAPH}), w as (select c_custkey::varchar as n from customer where c_acctbal >= 0),
 i as (select a, b from e where a in (select n from w) and b in (select n from w)),
 c as (select c_custkey::varchar as n from customer where c_mktsegment = 'BUILDING' union select i.b from c join i on c.n = i.a) select n from c""")
def q29_reachable_masked(spark, sf):
    customers = table(spark, sf, "customer")
    start = facts(customers.where("c_mktsegment = 'BUILDING'"), None, "c_custkey", distinct=False)
    within = facts(customers.where("c_acctbal >= 0"), None, "c_custkey", distinct=False)
    return fixpoint.reachable(_graph(spark, sf), start, within).columns("n")


#: Within a nation and segment, from each customer to the least, from there to the greatest, and from the greatest
#: customer of the nation to all that are least.
_MARKETS = """g as (select c_nationkey as n, min(c_custkey) as low, max(c_custkey) as high from customer group by c_nationkey, c_mktsegment),
 e as (select c_custkey::varchar as a, min(c_custkey) over (partition by c_nationkey, c_mktsegment)::varchar as b from customer
 union select low::varchar, high::varchar from g union select max(high) over (partition by n)::varchar, low::varchar from g)"""


@_query(f"""with recursive {_MARKETS}, c as (select a, b from e union select c.a, e.b from c join e on c.b = e.a),
 m as (select x.a, x.b from c x join c y on x.a = y.b and x.b = y.a), r as (select a, min(b) as rep from m group by a)
 select rep, a as member from r where rep <> a""")
def q30_scc(spark, sf):
    customers = table(spark, sf, "customer")
    groups = customers.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))
    highest = customers.groupBy("c_nationkey").agg(F.max("c_custkey").alias("top"))
    edges = facts(customers.join(groups, ["c_nationkey", "c_mktsegment"]), None, "c_custkey", "low")
    edges = edges.union(facts(groups, None, "low", "high"), facts(groups.join(highest, "c_nationkey"), None, "top", "low"))
    return fixpoint.strong_components(edges).columns("rep", "member")


def _hierarchy(spark, sf):
    nations = facts(table(spark, sf, "nation"), "child", F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), distinct=False)
    customers = facts(table(spark, sf, "customer"), "child", F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), distinct=False)
    return nations.union(customers)


@_query("""with recursive e as (select 'n' || n_nationkey as a, 'r' || n_regionkey as b from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
 c as (select a, b from e union select c.a, e.b from c join e on c.b = e.a) select a as person, b as ancestor from c""")
def q31_predecessors(spark, sf):
    family = _hierarchy(spark, sf)
    people = family.unwrap("child").heads()
    return people.iterate_heads(lambda p: programs.ancestors(family, Space.single(spark, p)).wrap(p)).columns("person", "ancestor")


@_query("select p_partkey::varchar as partkey from part where p_size between 18 and 37")
def q32_interval(spark, sf):
    bits = [F.substring(F.lpad(F.bin("p_size"), 6, "0"), i + 1, 1) for i in range(6)]
    parts = facts(table(spark, sf, "part"), None, *bits, "p_partkey", distinct=False)
    return parts.restriction(Space.literal(spark, *interval(18, 37, 6))).iterate_first(6, lambda _, own: own).columns("partkey")


@_query("select distinct unnest(range(0, l_linenumber))::varchar as n from lineitem")
def q33_range(spark, sf):
    return facts(table(spark, sf, "lineitem"), None, "l_linenumber").flat_map(grounded.numbers_in).columns("n")


_CELLS = "select distinct l_suppkey as x, l_partkey as y from lineitem"


def _cells(spark, sf):
    return facts(table(spark, sf, "lineitem"), None, "l_suppkey", "l_partkey")


@_query(f"select distinct (x + y)::varchar as total from ({_CELLS})")
def q34_arith(spark, sf):
    return grounded.arithmetic(_cells(spark, sf).wrap("+")).columns("total")


@_query(f"""with c as ({_CELLS}), n as (select x + i as x, y + j as y, count(*) as n from c, (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(j)
 where i <> 0 or j <> 0 group by 1, 2)
 select x::varchar as x, y::varchar as y from n where n = 3 or (n = 2 and exists (select 1 from c where c.x = n.x and c.y = n.y))""")
def q35_life(spark, sf):
    return programs.life_step(_cells(spark, sf)).columns("x", "y")


@_query("select md5('nation.' || n_regionkey || '.' || n_nationkey) as hash from nation")
def q36_hash(spark, sf):
    return _nations(spark, sf).map_paths(grounded.path_hash).columns("hash")


@_query("""with recursive q as (select 0 as k, []::int[] as p union all
 select k + 1, list_append(p, c) from q, (select unnest(range(1, 9))::int as c) where k < 8
 and len(list_filter(range(1, k + 1), lambda i: p[i] = c or abs(p[i] - c) = k + 1 - i)) = 0)
 select p[1]::varchar as a, p[2]::varchar as b, p[3]::varchar as c, p[4]::varchar as d, p[5]::varchar as e, p[6]::varchar as f, p[7]::varchar as g, p[8]::varchar as h
 from q where k = 8""")
def q37_queens(spark, sf):
    return programs.queens(spark, 8).columns(*"abcdefgh")


@_query("""with recursive m(f, t) as (values (1, 2), (2, 1), (1, 3), (3, 1), (2, 4), (4, 2), (3, 4), (4, 3)),
 s as (select ['1', '2', '3', '_'] as p union
 select list_transform(range(1, 5), lambda i: case when i = m.t then p[m.f] when i = m.f then '_' else p[i] end) from s join m on list_position(p, '_') = m.t)
 select p[1] as a, p[2] as b, p[3] as c, p[4] as d from s""")
def q38_puzzle(spark, sf):
    moves = Space.literal(spark, "0.1", "1.0", "0.2", "2.0", "1.3", "3.1", "2.3", "3.2")
    return programs.sliding_states(Space.literal(spark, "1.2.3._"), moves).columns(*"abcd")


@_query("select doc_id::varchar as doc_id from documents where ' ' || text || ' ' like '% of the %'")
def q39_suffix_index(spark, sf):
    docs = table(spark, sf, "documents").select(F.array_insert(F.split("text", " "), 1, F.col("doc_id").cast("string")).cast(ITEMS).alias("path"))
    return programs.containing(programs.suffix_index(Space(docs), depth=None, width=2), "of.the").columns("doc_id")


def _family(spark, sf):
    """Regions are parents of nations and nations of customers; some names and segments make women."""
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    r, n, c = (F.concat(F.lit(k), x) for k, x in (("r", "n_regionkey"), ("n", "n_nationkey"), ("c", "c_custkey")))
    of = F.concat(F.lit("n"), "c_nationkey")
    parent = facts(nation, "parent", r, n, distinct=False).union(facts(customer, "parent", of, c, distinct=False))
    child = facts(nation, "child", n, r, distinct=False).union(facts(customer, "child", c, of, distinct=False))
    women = facts(nation.where("n_name rlike '[1348]$'"), "female", n, distinct=False).union(facts(customer.where("c_mktsegment in ('BUILDING', 'HOUSEHOLD')"), "female", c, distinct=False))
    return parent.union(child, women)


_FAMILY = """with p as (select 'r' || n_regionkey as a, 'n' || n_nationkey as b from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer),
 f as (select 'n' || n_nationkey as w from nation where regexp_matches(n_name, '[1348]$') union all select 'c' || c_custkey from customer where c_mktsegment in ('BUILDING', 'HOUSEHOLD'))"""


@_query(f"{_FAMILY} select distinct b as person, a as mother from p join f on a = w")
def q40_mother(spark, sf):
    family = _family(spark, sf)
    return programs.mothers(family, family.unwrap("child").heads()).columns("person", "mother")


@_query(f"{_FAMILY} select distinct x.b as person, y.b as sister from p x join p y on x.a = y.a and x.b <> y.b join f on y.b = w where x.b like 'n%'")
def q41_sister(spark, sf):
    family = _family(spark, sf)
    nations = facts(table(spark, sf, "nation"), None, F.concat(F.lit("n"), "n_nationkey"), distinct=False)
    return programs.sisters(family, nations).columns("person", "sister")


@_query(f"""{_FAMILY} select distinct x.b as person, s.b as aunt from p x join p g on x.a = g.b join p s on s.a = g.a and s.b <> x.a join f on s.b = w""")
def q42_aunt(spark, sf):
    family = _family(spark, sf)
    return programs.aunts(family, family.unwrap("child").heads()).columns("person", "aunt")


@_query("select n_regionkey::varchar as regionkey, max(n_name) as last, min(n_name) as first from nation group by 1")
def q43_highest_lowest(spark, sf):
    names = facts(table(spark, sf, "nation"), None, "n_regionkey", "n_name", distinct=False)
    return names.iterate(lambda r, own: own.highest("-").composition(own.lowest("-")).wrap(r)).columns("regionkey", "last", "first")


@_query("""select s as seed, custkey from (select '7' as s, c_custkey::varchar as custkey, row_number() over (order by md5('7:' || c_custkey)) as k from customer) where k <= 5""")
def q44_sample(spark, sf):
    return grounded.sample(facts(table(spark, sf, "customer"), None, "c_custkey", distinct=False), "7", 5).wrap("7").columns("seed", "custkey")


@_query("select r_name as key, 'left' as side, r_regionkey::varchar as value from region union select n_name, 'right', n_nationkey::varchar from nation")
def q45_tagged_union(spark, sf):
    left = facts(table(spark, sf, "region"), None, "r_name", "r_regionkey", distinct=False)
    right = facts(table(spark, sf, "nation"), None, "n_name", "n_nationkey", distinct=False)
    return programs.tagged_union(left, right, "left", "right").columns("key", "side", "value")


@_query("select r_name as name from region where not exists (select 1 from nation where n_name = 'NOWHERE')")
def q46_or_else(spark, sf):
    nowhere = facts(table(spark, sf, "nation").where("n_name = 'NOWHERE'"), None, "n_name")
    return nowhere.or_else(facts(table(spark, sf, "region"), None, "r_name")).columns("name")


@_query("""select distinct l_linestatus || '.' || l_returnflag as text from lineitem union select distinct l_linestatus from lineitem""")
def q47_prefixes(spark, sf):
    both = facts(table(spark, sf, "lineitem"), None, "l_linestatus", "l_returnflag")
    return both.flat_map(prefixes).frame.select(text_of(F.col("path")).alias("text"))


#: For each customer, one term says that its place is what the customer's nation is called and gives its name; in the
#: other, the least customer of a nation names it, the places of the others are unknown, and all names are.
_TERMS = "customer join nation on c_nationkey = n_nationkey join (select c_nationkey as k, min(c_custkey) as least from customer group by 1) on k = c_nationkey"


@_query(f"select c_custkey || '.in.' || n_name as leaf from {_TERMS} union all select c_custkey || '.named.' || c_name from {_TERMS}")
def q48_unify(spark, sf):
    customers = table(spark, sf, "customer")
    named = customers.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    least = customers.groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_custkey").alias("least"))
    rows = named.join(least, F.col("k") == F.col("c_nationkey"))
    unknown = F.concat(F.lit("$of"), F.col("c_custkey").cast("string"))
    place = F.when(F.col("least") == F.col("c_custkey"), F.col("n_name")).otherwise(unknown)
    leaf = lambda where, what: facts(rows, None, "c_custkey", F.lit(where), what, distinct=False)
    x = leaf("in", F.concat(F.lit("$nation"), F.col("n_nationkey").cast("string"))).union(leaf("named", F.col("c_name")))
    y = leaf("in", place).union(leaf("named", F.concat(F.lit("$name"), F.col("c_custkey").cast("string"))))
    return programs.unified(x, y).frame.select(text_of(F.col("path")).alias("leaf"))


_SIZE, _BOX = 25, 5
_GIVEN = f"select s_suppkey % {_SIZE} + 1 as c, s_nationkey + 1 as r, min(s_suppkey // {_SIZE} % {_SIZE} + 1) as v from supplier group by 1, 2"
_BOX_OF = f"(({{0}}.c - 1) // {_BOX}) * {_BOX} + ({{0}}.r - 1) // {_BOX}"


def _given(spark, sf):
    """A grid whose columns, rows and values come from the suppliers; of several in a cell, the least value."""
    c, v = F.col("s_suppkey") % _SIZE + 1, F.floor(F.col("s_suppkey") / _SIZE) % _SIZE + 1
    rows = table(spark, sf, "supplier").groupBy(c.alias("c"), (F.col("s_nationkey") + 1).alias("r")).agg(F.min(v).alias("v"))
    return facts(rows, None, "c", "r", "v", distinct=False)


@_query(f"""with g as ({_GIVEN}), n as (select unnest(range(1, {_SIZE + 1})) as i),
 o as (select a.i as c, b.i as r, x.i as v from n a, n b, n x where not exists (select 1 from g where g.c = a.i and g.r = b.i))
 select o.c::varchar as c, o.r::varchar as r, o.v::varchar as v from o where not exists
 (select 1 from g where g.v = o.v and (g.c = o.c or g.r = o.r or {_BOX_OF.format("g")} = {_BOX_OF.format("o")}))""")
def q49_sudoku(spark, sf):
    return programs.sudoku_candidates(_given(spark, sf), _SIZE, _BOX).columns("c", "r", "v")


@_query("""with recursive s as (select distinct l_linenumber * l_suppkey as n from lineitem union select n // 2 from s) select n::varchar as n from s""")
def q50_converge(spark, sf):
    """Numbers halved, all at once, until nothing changes any more."""
    numbers = facts(table(spark, sf, "lineitem"), None, F.col("l_linenumber") * F.col("l_suppkey"))
    half = lambda x: x.map_paths(lambda p: F.array(F.floor(F.get(p, F.lit(0)).cast("bigint") / 2).cast("string")))
    return fixpoint.converge((numbers,), lambda x: x, lambda x: (half(x),)).columns("n")


def q51_solved(spark, sf):
    """All that single candidates lead to; which of them come first matters to no set, but is beyond one SQL query."""
    return programs.solved(_given(spark, sf), _SIZE, _BOX).columns("c", "r", "v")


QUERIES["q51_solved"] = q51_solved


@_query("""select n_regionkey::varchar as da, r_regionkey::varchar as db, n_nationkey::varchar as ia, r_name as ib, n_name as fa, r_name as fb from nation, region""")
def q52_polynomial_product(spark, sf):
    a = facts(table(spark, sf, "nation"), None, "n_regionkey", "n_nationkey", "n_name", distinct=False)
    b = facts(table(spark, sf, "region"), None, "r_regionkey", "r_name", "r_name", distinct=False)
    return programs.polynomial_product(a, b).columns("da", "db", "ia", "ib", "fa", "fb")


@_query(f"{_FAMILY} select 'child' as kind, b as x, a as y from p union all select 'parent', a, b from p union all select 'female', w, null from f union all select 'person', w, null from f")
def q53_indexed(spark, sf):
    family = _family(spark, sf)
    base = family.restriction(Space.literal(spark, "parent", "female"))
    return programs.indexed(base).columns("kind", "x", "y")


@_query("""select o_orderpriority as priority, md5(count(*) || ':' || bit_xor(('0x' || substr(md5(o_custkey || '.' || o_orderkey), 1, 15))::bigint)) as hash
 from orders group by 1""")
def q54_space_hash(spark, sf):
    held = facts(table(spark, sf, "orders"), None, "o_orderpriority", "o_custkey", "o_orderkey", distinct=False)
    return held.iterate(lambda priority, own: grounded.space_hash(own).wrap(priority)).columns("priority", "hash")


@_query("select distinct l_partkey::varchar as part, l_suppkey::varchar as supp, (l_partkey + l_suppkey)::varchar as plus, (l_partkey - l_suppkey)::varchar as less from lineitem")
def q55_add_sub(spark, sf):
    pairs = facts(table(spark, sf, "lineitem"), None, "l_partkey", "l_suppkey")
    made = pairs.iterate(lambda p, s, _: Space.single(spark, p + s + (p + s).apply(grounded.add) + (p + s).apply(grounded.sub)), 2)
    return made.columns("part", "supp", "plus", "less")


@_query("""with t as (select distinct n_name || '.' || repeat('.', n_regionkey) || r_name || repeat('.', n_nationkey % 3) as t from nation, region
 union all select '' union all select '..'), p as (select t, case when t = '' then [''] else string_split(regexp_replace(t, '[.]+$', ''), '.') end as p from t)
 select distinct case when t = '..' then 0 else len(p) end::bigint as items, case when t = '..' then '' else array_to_string(p, '|') end as path from p""")
def q56_from_texts(spark, sf):
    both = table(spark, sf, "nation").crossJoin(table(spark, sf, "region"))
    dots = lambda n: F.expr(f"repeat('.', cast({n} as int))")
    texts = both.select(F.concat("n_name", F.lit("."), dots("n_regionkey"), "r_name", dots("n_nationkey % 3")).alias("value")).distinct()
    texts = texts.unionByName(spark.createDataFrame([("",), ("..",)], "value string"))
    return from_texts(texts).frame.select(F.size("path").cast("bigint").alias("items"), F.array_join("path", "|").alias("path"))


@_query("select l_returnflag as flag, l_suppkey::varchar as suppkey, count(distinct l_partkey)::varchar as parts from lineitem group by 1, 2 having count(distinct l_partkey) > 2")
def q57_map_frame(spark, sf):
    """A host function on whole sets: within each flag, suppliers with how many parts, if more than two."""

    def counted(frame: DataFrame) -> DataFrame:
        keys = [c for c in frame.columns if c != "path"]
        n = frame.groupBy(*keys, F.get("path", F.lit(0)).alias("s")).agg(F.count(F.lit(1)).alias("n")).where("n > 2")
        return n.select(*keys, F.array("s", F.col("n").cast("string")).alias("path"))

    held = facts(table(spark, sf, "lineitem"), None, "l_returnflag", "l_suppkey", "l_partkey")
    return held.iterate(lambda flag, own: own.map_frame(counted).wrap(flag)).columns("flag", "suppkey", "parts")


@_query("select custkey, orderkey from (select o_custkey::varchar as custkey, o_orderkey::varchar as orderkey, row_number() over (partition by o_custkey order by o_orderkey::varchar) as k from orders) where k <= 3")
def q58_first_three(spark, sf):
    return _orders(spark, sf).iterate(lambda c, own: own.first(3).wrap(c)).columns("custkey", "orderkey")


@_query("select custkey, orderkey from (select o_custkey::varchar as custkey, o_orderkey::varchar as orderkey, row_number() over (partition by o_custkey order by o_orderkey::varchar desc) as k from orders) where k <= 2")
def q59_last_two(spark, sf):
    return _orders(spark, sf).iterate(lambda c, own: own.last(2).wrap(c)).columns("custkey", "orderkey")


@_query(f"""with recursive e as (select a, min(b) as b from ({_GRAPH}) where b < a group by a),
 w as (select c_custkey::varchar as n, c_custkey::varchar as r from customer union select w.n, e.b from w join e on w.r = e.a)
 select n as item, r as root from w where r not in (select a from e)""")
def q60_representatives(spark, sf):
    """Where the ways of customers to smaller ones end, for all customers: a function that asks for itself."""
    down = _graph(spark, sf)
    up = Space(down.frame.where(F.get("path", F.lit(1)) < F.get("path", F.lit(0))).groupBy(F.get("path", F.lit(0)).alias("a")).agg(F.min(F.get("path", F.lit(1))).alias("b")).select(F.array("a", "b").alias("path")), lengths={2})
    customers = facts(table(spark, sf, "customer"), None, "c_custkey", distinct=False)
    return programs.representatives(up, customers).columns("item", "root")


@_query("select distinct 'kept' as tag, o_orderpriority as second, o_orderstatus as first from orders union select distinct 'kept', o_orderpriority, 'F' from orders where o_orderstatus = '$any'")
def q61_transformation_literals(spark, sf):
    """Literals of the pattern are compared, and a variable captures; the template turns the captures around."""
    orders = facts(table(spark, sf, "orders"), "order", "o_orderstatus", "o_orderpriority").union(facts(table(spark, sf, "nation"), "nation", "n_name", "n_regionkey", distinct=False))
    return orders.transformation("order.$status.$priority", "kept.$priority.$status").columns("tag", "second", "first")
