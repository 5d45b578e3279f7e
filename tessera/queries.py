"""The operators over the Parquet tables: one query each, and the SQL that checks it."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import novelty as nov
from .operators.analysis import argument_candidates
from .operators.datalog import Heuristic, Relaxation
from .operators.search import PLAN_FOUND, Search, solve, validate
from .operators.states import ATOM, ATOMS, StateSpace
from .plans import conjunctive as cq
from .plans.ir import Atom, Comparison, Const, Query, Var
from .scratch import Tables
from .session import table
from .sources import catalog
from .sources.pddl import parse_task

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


REGION, NATION, CUSTOMER, ORDER, SUPPLIER, PART = (Var(k) for k in range(6))


def _scan(spark, d, name, terms) -> cq.Input:
    """terms: column -> variable or constant."""
    columns = list(terms)
    rows = table(spark, d, name).select(*[F.col(c).cast("long").alias(c) for c in columns])
    return cq.Input(cq.scan(rows, tuple(terms.values()), columns), frozenset(t for t in terms.values() if isinstance(t, Var)))


def _chain(spark, d) -> list[cq.Input]:
    return [
        _scan(spark, d, "nation", {"n_nationkey": NATION, "n_regionkey": REGION}),
        _scan(spark, d, "customer", {"c_custkey": CUSTOMER, "c_nationkey": NATION}),
        _scan(spark, d, "orders", {"o_orderkey": ORDER, "o_custkey": CUSTOMER}),
        _scan(spark, d, "lineitem", {"l_orderkey": ORDER, "l_suppkey": SUPPLIER}),
    ]


def _named(frame: DataFrame) -> DataFrame:
    names = {"v0": "regionkey", "v1": "nationkey", "v2": "custkey", "v3": "orderkey", "v4": "suppkey", "v5": "partkey"}
    return frame.select(*[F.col(c).alias(names[c]) for c in sorted(frame.columns)])


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 7")
def select_const(spark, d):
    return table(spark, d, "customer").where("c_nationkey = 7").select("c_custkey", "c_name", "c_nationkey")


@query("SELECT n_regionkey AS regionkey, r_name, n_nationkey AS nationkey, n_name, c_custkey AS custkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey")
def natural_join(spark, d):
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("regionkey"), "r_name")
    nation = table(spark, d, "nation").select(F.col("n_regionkey").alias("regionkey"), F.col("n_nationkey").alias("nationkey"), "n_name")
    customer = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_custkey").alias("custkey"))
    return cq.natural_join(cq.natural_join(region, nation), customer)


@query("SELECT a.r_regionkey AS r1, b.r_regionkey AS r2 FROM region a CROSS JOIN region b")
def cartesian(spark, d):
    region = table(spark, d, "region")
    return cq.natural_join(region.select(F.col("r_regionkey").alias("r1")), region.select(F.col("r_regionkey").alias("r2")))


@query("SELECT c_custkey AS custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(spark, d):
    return cq.semi_join(table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_name"), table(spark, d, "orders").select(F.col("o_custkey").alias("custkey")))


_THREE = "SELECT CAST(n_regionkey AS BIGINT) AS regionkey, CAST(n_nationkey AS BIGINT) AS nationkey, c_custkey AS custkey, o_orderkey AS orderkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey"


def _three(spark, d, generator):
    inputs = _chain(spark, d)[:3]
    everything = frozenset().union(*(i.variables for i in inputs))
    return _named(cq.evaluate(Query((), (), everything), inputs, generator))


@query(_THREE)
def join_stated_order(spark, d):
    return _three(spark, d, "join")


@query(_THREE)
def join_ordered(spark, d):
    return _three(spark, d, "ordered_join")


@query(_THREE)
def join_inverse_ordered(spark, d):
    return _three(spark, d, "inverse_ordered_join")


@query(_THREE)
def join_random(spark, d):
    return _three(spark, d, "random_join")


_CHAIN = "SELECT CAST(n_regionkey AS BIGINT) AS regionkey, CAST(n_nationkey AS BIGINT) AS nationkey, c_custkey AS custkey, o_orderkey AS orderkey, l_suppkey AS suppkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey"


@query(_CHAIN)
def full_reducer_chain(spark, d):
    return _named(cq.evaluate(Query(()), _chain(spark, d), "full_reducer", tables=Tables(spark, "reduce")))


@query(f"SELECT DISTINCT custkey FROM ({_CHAIN})")
def yannakakis_distinct(spark, d):
    return _named(cq.evaluate(Query((), (), frozenset({CUSTOMER})), _chain(spark, d), "yannakakis", tables=Tables(spark, "reduce")).select("v2"))


@query("SELECT DISTINCT o_custkey AS custkey, o_orderkey AS orderkey, s_suppkey AS suppkey, CAST(s_nationkey AS BIGINT) AS nationkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey")
def cyclic_join(spark, d):
    inputs = _chain(spark, d)[1:] + [_scan(spark, d, "supplier", {"s_suppkey": SUPPLIER, "s_nationkey": NATION})]
    return _named(cq.evaluate(Query((), (), frozenset({CUSTOMER, ORDER, SUPPLIER, NATION})), inputs, "yannakakis").distinct())


@query("SELECT a.s_suppkey AS s1, b.s_suppkey AS s2, CAST(a.s_nationkey AS BIGINT) AS nationkey FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey <> b.s_suppkey AND a.s_nationkey <> 3")
def neq_filter(spark, d):
    a, b, n = Var(0), Var(1), Var(2)
    inputs = [_scan(spark, d, "supplier", {"s_suppkey": v, "s_nationkey": n}) for v in (a, b)]
    apart = (Comparison(a, b, False), Comparison(n, Const(3), False))
    return cq.evaluate(Query((), apart, frozenset({a, b, n})), inputs, "join").select(F.col("v0").alias("s1"), F.col("v1").alias("s2"), F.col("v2").alias("nationkey"))


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1")
def witness_project(spark, d):
    return cq.witness(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), ["l_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM events WHERE event_type = 'purchase') AND NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'refund')")
def nullary_guard(spark, d):
    events = table(spark, d, "events")
    orders = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.lit("purchase").alias("need"), F.lit("refund").alias("absent"))
    kinds = events.where(F.col("event_type").isin("purchase", "refund")).select("event_type").distinct()
    return orders.join(kinds, orders.need == kinds.event_type, "left_semi").join(kinds, orders.absent == kinds.event_type, "left_anti").select("o_orderkey")


def _fact(pred: int, *columns):
    """A fact whose arguments are columns."""
    return F.struct(F.lit(pred).alias("p"), F.array(*[F.col(c).cast("int") for c in columns]).cast("array<int>").alias("a")).cast(ATOM)


def _states(rows: DataFrame, key: str, atoms, n_objects=None) -> DataFrame:
    """One state per key with the atoms of its rows, nulls left out."""
    packed = F.array_sort(F.collect_set(atoms)).cast(ATOMS).alias("atoms")
    return rows.groupBy(F.col(key).cast("long").alias("state")).agg(packed, (n_objects if n_objects is not None else F.lit(0)).cast("int").alias("n_objects"))


SHIP = parse_task(
    "(define (domain ship) (:predicates (open ?o) (large ?o) (closed ?o)) (:action ship :parameters (?o) :precondition (and (open ?o) (large ?o)) :effect (and (not (open ?o)) (closed ?o))))",
    "(define (problem p) (:domain ship) (:objects none) (:init) (:goal (closed none)))",
)


@query("WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_totalprice > 200000 AS large FROM orders WHERE o_orderstatus = 'O') SELECT x.c AS custkey, x.k AS orderkey, string_agg(CASE WHEN y.k = x.k THEN '2:' ELSE '0:' END || y.k, ',' ORDER BY CASE WHEN y.k = x.k THEN 2 ELSE 0 END, y.k) AS after FROM o x JOIN o y ON y.c = x.c WHERE x.large GROUP BY x.c, x.k")
def effects_update(spark, d):
    """Successors of one state per customer, whose facts are the open orders: each large one can be shipped."""
    orders = table(spark, d, "orders")
    large = orders.where("o_totalprice > 200000").select(_fact(SHIP.number("large"), "o_orderkey").alias("x")).select("x.p", "x.a")
    states = _states(orders.where("o_orderstatus = 'O'"), "o_custkey", _fact(SHIP.number("open"), "o_orderkey"))
    after = StateSpace(spark, SHIP, static=large).successors(states)
    text = F.array_join(F.transform("atoms", lambda x: F.concat_ws(":", x["p"].cast("string"), x["a"][0].cast("string"))), ",")
    return after.select(F.col("parent").alias("custkey"), F.col("binding")[0].cast("long").alias("orderkey"), text.alias("after"))


BUY = parse_task(
    "(define (domain buy) (:predicates (had ?p) (sold ?p)) (:action buy :parameters (?p) :precondition (sold ?p) :effect (had ?p)))",
    "(define (problem p) (:domain buy) (:objects urgent high low) (:init) (:goal (and (had urgent) (had high) (had low))))",
)


@query("WITH goal(p) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW')), have AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) SELECT c_custkey, CAST(count(*) FILTER (WHERE o_custkey IS NULL) AS BIGINT) AS unsatisfied FROM customer CROSS JOIN goal LEFT JOIN have ON o_custkey = c_custkey AND o_orderpriority = p GROUP BY c_custkey")
def goal_count(spark, d):
    """Unsatisfied goals of one state per customer."""
    number = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "5-LOW", 2)
    bought = table(spark, d, "orders").withColumn("number", number)
    rows = table(spark, d, "customer").select("c_custkey").join(bought.where("number is not null"), F.col("c_custkey") == F.col("o_custkey"), "left")
    states = _states(rows, "c_custkey", F.when(F.col("number").isNotNull(), _fact(BUY.number("had"), "number")))
    return states.select(F.col("state").alias("c_custkey"), StateSpace(spark, BUY).goal_count().cast("long").alias("unsatisfied"))


@query("SELECT event_id, event_id = min(event_id) OVER (PARTITION BY user_id, event_type) AS is_new FROM events")
def novelty1(spark, d):
    return nov.first_occurrence(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id").select("event_id", "is_new")


@query("WITH e AS (SELECT event_id, user_id, event_type AS t, lag(event_type) OVER w AS l1, lag(event_type, 2) OVER w AS l2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), one AS (SELECT event_id, event_id = min(event_id) OVER (PARTITION BY user_id, t) AS n1 FROM e), p AS (SELECT event_id, user_id, least(t, o) AS x, greatest(t, o) AS y FROM (SELECT event_id, user_id, t, unnest([l1, l2]) AS o FROM e) WHERE o <> t), two AS (SELECT event_id, bool_or(event_id = f) AS n2 FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, x, y) AS f FROM p) GROUP BY event_id) SELECT event_id, CASE WHEN n1 THEN 1 WHEN n2 THEN 2 ELSE 3 END AS w FROM one LEFT JOIN two USING (event_id)")
def novelty2(spark, d):
    """Novelty of width 2 of one state per event, within its user: its atoms are the types of the user's last three events, its own is added."""
    last = Window.partitionBy("user_id").orderBy("event_id")
    events = table(spark, d, "events").select("event_id", "user_id", F.struct(F.lit(0).alias("p"), F.array(F.hash("event_type")).alias("a")).cast(ATOM).alias("x"))
    atoms = F.array_distinct(F.array_compact(F.array("x", F.lag("x").over(last), F.lag("x", 2).over(last))))
    states = events.select(F.col("event_id").alias("state"), F.col("event_id").alias("seq"), F.col("user_id").alias("r"), F.lit(0).alias("g"), atoms.alias("atoms"), F.array("x").alias("added"), F.lit(False).alias("done"), F.lit(True).alias("same"))
    return nov.Novelty(Tables(spark, "novelty"), 2, 2**31 - 1).novelty(states).select(F.col("state").alias("event_id"), "w")


@query("SELECT event_id, event_id = min(event_id) OVER (PARTITION BY CAST(ts AS DATE), user_id, event_type) AS is_new FROM events")
def novelty_partitioned(spark, d):
    return nov.first_occurrence(table(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day")), ["user_id", "event_type"], "event_id", ("day",)).select("event_id", "is_new")


#: Each part is made of the parts of half its number and a seventh of it, at the cost of 1 + its number modulo 3. Part 0 is at hand.
MAKE = parse_task(
    "(define (domain make) (:predicates (have ?x) (shown ?x) (of1 ?x ?a ?b) (of2 ?x ?a ?b) (of3 ?x ?a ?b)) (:functions (total-cost) - number) "
    + " ".join(f"(:action make{c} :parameters (?x ?a ?b) :precondition (and (of{c} ?x ?a ?b) (have ?a) (have ?b)) :effect (and (have ?x) (shown ?x) (increase (total-cost) {c})))" for c in (1, 2, 3))
    + ")",
    "(define (problem p) (:domain make) (:objects none) (:init) (:goal (have none)))",
)


def _making(spark, d, goal: int | None = None) -> tuple[StateSpace, DataFrame]:
    """The task over all parts and its one state; goal: the part to have and to show."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("x"), F.floor(F.col("p_partkey") / 2).alias("a"), F.floor(F.col("p_partkey") / 7).alias("b"))
    pred = F.element_at(F.array(*[F.lit(MAKE.number(f"of{c}")) for c in (1, 2, 3)]), (F.col("x") % 3 + 1).cast("int"))
    recipes = part.where("x > 0").select(pred.alias("p"), F.array("x", "a", "b").cast("array<int>").alias("a"))
    task = _with_goal(MAKE, goal) if goal is not None else MAKE
    space = StateSpace(spark, task, static=recipes)
    return space, spark.range(1).select(F.col("id").alias("state"), F.array(F.struct(F.lit(MAKE.number("have")).alias("p"), F.array(F.lit(0)).alias("a"))).cast(ATOMS).alias("atoms"), F.lit(0).alias("n_objects"))


def _with_goal(task, goal: int):
    """The task with the goal to have and to show one part."""
    return replace(task, goal=[Atom(task.number(p), (Const(goal),)) for p in ("have", "shown")])


_WAYS = "WITH RECURSIVE r AS (SELECT p_partkey AS top, p_partkey AS x, CAST(1 + p_partkey % 3 AS BIGINT) AS w, CAST(1 + p_partkey % 3 AS BIGINT) AS path FROM part WHERE p_partkey > 0 {} UNION ALL SELECT top, y, CAST(CASE WHEN y = 0 THEN 0 ELSE 1 + y % 3 END AS BIGINT), path + CASE WHEN y = 0 THEN 0 ELSE 1 + y % 3 END FROM (SELECT top, path, unnest([x // 2, x // 7]) AS y FROM r WHERE x > 0))"


def _costs(spark, d, combine) -> DataFrame:
    space, state = _making(spark, d)
    reached = Relaxation(space, combine).fixpoint(state)
    return reached.where((F.col("p") == MAKE.number("have")) & (F.col("a")[0] > 0)).select(F.col("a")[0].cast("long").alias("part"), F.col("why.cost").cast("long").alias("cost"))


@query(_WAYS.format("") + " SELECT top AS part, CAST(sum(w) AS BIGINT) AS cost FROM r GROUP BY top")
def hadd_fixpoint(spark, d):
    """Least costs of all parts where those of a body are added."""
    return _costs(spark, d, "sum")


@query(_WAYS.format("") + " SELECT top AS part, CAST(max(path) AS BIGINT) AS cost FROM r GROUP BY top")
def hmax_fixpoint(spark, d):
    """Least costs of all parts where the dearest of a body counts."""
    return _costs(spark, d, "max")


def _last_part(spark, d) -> int:
    return table(spark, d, "part").agg(F.max("p_partkey")).first()[0]


_LAST = "AND p_partkey = (SELECT max(p_partkey) FROM part)"


@query(_WAYS.format(_LAST) + " SELECT DISTINCT x AS part FROM r")
def backchain_useful(spark, d):
    """Parts on the derivation of the last one."""
    space, state = _making(spark, d, _last_part(spark, d))
    relaxed = Relaxation(space)
    return relaxed.backchain(state, relaxed.fixpoint(state)).select(F.col("a")[0].cast("long").alias("part")).distinct()


@query(_WAYS.format(_LAST) + ", f AS (SELECT CAST(sum(w) AS BIGINT) AS h FROM (SELECT DISTINCT x, w FROM r)) SELECT evaluator, CAST(h AS BIGINT) AS h FROM (SELECT 'ff' AS evaluator, h FROM f UNION ALL SELECT 'rff', h + (SELECT 1 + max(p_partkey) % 3 FROM part) FROM f UNION ALL SELECT 'add', 2 * sum(w) FROM r UNION ALL SELECT 'hmax', max(path) FROM r UNION ALL SELECT 'goalcount', 2 UNION ALL SELECT 'blind', 1)")
def evaluators(spark, d):
    """The value of the state under each evaluator, the goal being to have and to show the last part: the action that makes it adds both facts."""
    space, state = _making(spark, d, _last_part(spark, d))
    values = [Heuristic(space, name).evaluate(state).select(F.lit(name).alias("evaluator"), F.col("h").cast("long").alias("h")) for name in Heuristic.NAMES]
    return reduce(DataFrame.unionByName, values)


#: Edges over parts, from half and a seventh of a number to it.
_EDGES = "SELECT p_partkey // 2 AS a, p_partkey AS b FROM part WHERE p_partkey > 0 UNION SELECT p_partkey // 7, p_partkey FROM part WHERE p_partkey > 0"


@query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT 0::BIGINT AS a UNION SELECT e.b FROM r JOIN e ON e.a = r.a) SELECT a AS node FROM r")
def reachability(spark, d):
    """All nodes that 0 leads to."""
    part, tables = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("b")), Tables(spark, "reach")
    edges = part.select(F.floor(F.col("b") / 2).alias("a"), "b").unionByName(part.select(F.floor(F.col("b") / 7).alias("a"), "b")).distinct()
    new = tables.keep(spark.range(1).select(F.col("id").alias("node")))
    found, turn = tables.append("found", new, 0), 0
    while True:
        turn += 1
        new = tables.keep(edges.join(new, edges.a == new.node, "left_semi").select(F.col("b").alias("node")).distinct().join(found, "node", "left_anti"))
        if new.isEmpty():
            return found
        found = tables.append("found", new, turn)


@query("WITH RECURSIVE e AS (SELECT n_nationkey // 2 AS a, n_nationkey AS b FROM nation WHERE n_nationkey > 0 UNION SELECT n_nationkey // 5, n_nationkey FROM nation WHERE n_nationkey > 0), r AS (SELECT 0 AS x, 0 AS cost, 0 AS steps UNION SELECT e.b, r.cost + 1 + e.b % 3, r.steps + 1 FROM r JOIN e ON e.a = r.x) SELECT search, CAST(n AS BIGINT) AS n FROM (SELECT min(cost) AS cost, min(steps) AS steps FROM r WHERE x = (SELECT max(n_nationkey) FROM nation)), LATERAL (VALUES ('astar', cost), ('bfs', steps)) v(search, n)")
def search_costs(spark, d):
    """Ways from nation 0 to the last one: the cost of A*'s plan and the steps of breadth-first search's."""
    keys = sorted(r[0] for r in table(spark, d, "nation").select("n_nationkey").collect())
    edges = sorted({(b // k, b, 1 + b % 3) for b in keys if b > 0 for k in (2, 5)})
    acts = "".join(f"(:action go{c} :parameters (?a ?b) :precondition (and (at ?a) (road{c} ?a ?b)) :effect (and (not (at ?a)) (at ?b) (increase (total-cost) {c})))" for c in (1, 2, 3))
    domain = f"(define (domain roads) (:predicates (at ?x) (road1 ?a ?b) (road2 ?a ?b) (road3 ?a ?b)) (:functions (total-cost) - number) {acts})"
    facts = " ".join(f"(road{c} n{a} n{b})" for a, b, c in edges)
    task = parse_task(domain, f"(define (problem way) (:domain roads) (:objects {' '.join(f'n{k}' for k in keys)}) (:init (at n0) {facts}) (:goal (at n{keys[-1]})))")
    found = {name: solve(spark, task, search=name, evaluator="blind", generator="join") for name in ("astar", "bfs")}
    assert all(x.code == PLAN_FOUND for x in found.values())
    return spark.createDataFrame([("astar", found["astar"].cost), ("bfs", len(found["bfs"].plan))], "search string, n long")


#: Searches that expand by different queues, with an evaluator each.
TREE_SEARCHES = {"gbfs": "goalcount", "lazy": "goalcount", "bfws1": "blind", "iw1": "blind", "dq-bfws1-rx": "blind", "alt-bfws1": "add"}


@query("WITH RECURSIVE r AS (SELECT max(n_nationkey) AS x, 0 AS cost, 0 AS steps FROM nation UNION ALL SELECT x // 5, cost + 1 + x % 3, steps + 1 FROM r WHERE x > 0) SELECT s.search, CAST(max(cost) AS BIGINT) AS cost, CAST(max(steps) AS BIGINT) AS steps, TRUE AS valid FROM r, (VALUES " + ", ".join(f"('{n}')" for n in TREE_SEARCHES) + ") s(search) GROUP BY s.search")
def tree_searches(spark, d):
    """The way from nation 0 to the last one in a tree, where each search must find the only one, and whether the plan holds step by step."""
    keys = sorted(r[0] for r in table(spark, d, "nation").select("n_nationkey").collect())
    acts = "".join(f"(:action go{c} :parameters (?a ?b) :precondition (and (at ?a) (road{c} ?a ?b)) :effect (and (not (at ?a)) (at ?b) (increase (total-cost) {c})))" for c in (1, 2, 3))
    domain = f"(define (domain tree) (:predicates (at ?x) (road1 ?a ?b) (road2 ?a ?b) (road3 ?a ?b)) (:functions (total-cost) - number) {acts})"
    facts = " ".join(f"(road{1 + b % 3} n{b // 5} n{b})" for b in keys if b > 0)
    task = parse_task(domain, f"(define (problem way) (:domain tree) (:objects {' '.join(f'n{k}' for k in keys)}) (:init (at n0) {facts}) (:goal (at n{keys[-1]})))")
    rows = []
    for name, evaluator in TREE_SEARCHES.items():
        found = solve(spark, task, search=name, evaluator=evaluator, generator="join")
        rows.append((name, found.cost, len(found.plan), found.code == PLAN_FOUND and validate(spark, task, found.steps)))
    return spark.createDataFrame(rows, "search string, cost long, steps long, valid boolean")


def _geography(spark, d):
    """A typed task written from the nations and regions, through the front end: an envoy travels within a region and may move to the next."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()
    regions = sorted({r[1] for r in rows})
    domain = """(define (domain geography) (:requirements :typing) (:types place envoy - object nation region - place)
(:predicates (within ?n - nation ?r - region) (after ?a ?b - region) (at ?e - envoy ?n - nation) (seen ?p - place))
(:action tour :parameters (?e - envoy ?a ?b - nation ?r - region) :precondition (and (at ?e ?a) (within ?a ?r) (within ?b ?r)) :effect (and (not (at ?e ?a)) (at ?e ?b) (seen ?r)))
(:action cross :parameters (?e - envoy ?a ?b - nation ?r ?s - region) :precondition (and (at ?e ?a) (within ?a ?r) (after ?r ?s) (within ?b ?s)) :effect (and (not (at ?e ?a)) (at ?e ?b) (seen ?b))))"""
    objects = f"{' '.join(f'n{n}' for n, _ in rows)} - nation {' '.join(f'r{r}' for r in regions)} - region ann - envoy"
    facts = " ".join(f"(within n{n} r{r})" for n, r in rows) + " " + " ".join(f"(after r{r} r{r + 1})" for r in regions[:-1])
    return parse_task(domain, f"(define (problem visit) (:domain geography) (:objects {objects}) (:init (at ann n0) {facts}) (:goal (seen r{regions[-1]})))")


@query("SELECT p AS predicate, a AS facts_of, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'within' AS p, 'r' || n_regionkey AS a FROM nation UNION ALL SELECT 'after', 'r' || (r_regionkey + 1) FROM region WHERE r_regionkey < (SELECT max(r_regionkey) FROM region) UNION ALL SELECT 'at', 'n0') GROUP BY p, a")
def stored_task(spark, d):
    """The task's facts after it was parsed, stored as tables and read again: how many of each predicate name each last argument."""
    path = Tables(spark, "task").root
    catalog.save(spark, _geography(spark, d), path)
    tables = catalog.task_tables(spark, catalog.load(spark, path))
    facts = tables["facts"].join(tables["predicates"].select("p", F.col("name").alias("predicate")), "p").where("predicate in ('within', 'after', 'at')")
    last = facts.select("predicate", F.element_at("a", -1).alias("o")).join(tables["objects"].select("o", F.col("name").alias("facts_of")), "o")
    return last.groupBy("predicate", "facts_of").agg(F.count("*").alias("n"))


@query("SELECT 'at' AS predicate, 'ann n' || n_nationkey AS fact, n_nationkey = 0 AS holds FROM nation UNION ALL SELECT 'seen', 'n' || n_nationkey, FALSE FROM nation UNION ALL SELECT 'seen', 'r' || r_regionkey, FALSE FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def ground_facts(spark, d):
    """The facts that the arguments' candidates allow in the first state, with those that hold. Candidates are found place by place, so that a nation of the
    first region counts as one that may be crossed to."""
    task = _geography(spark, d)
    rows = catalog.ground_state(spark, task, argument_candidates(spark, task))
    tables = catalog.task_tables(spark, task)
    named = rows.select("p", "holds", "a", F.posexplode("a").alias("k", "o")).join(tables["objects"].select("o", "name"), "o")
    fact = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), " ")
    return named.groupBy("a", "p", "holds").agg(fact.alias("fact")).join(tables["predicates"].select("p", F.col("name").alias("predicate")), "p").select("predicate", "fact", "holds")


@query("SELECT n_regionkey AS region, CAST(min(n_nationkey) AS BIGINT) AS least, CAST(count(*) AS BIGINT) AS moves FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey = 0) OR n_regionkey = 1 + (SELECT n_regionkey FROM nation WHERE n_nationkey = 0) GROUP BY n_regionkey")
def first_moves(spark, d):
    """The moves of the first state by every kind of generator, which agree: per region that is reached the least nation and the number of moves."""
    task = _geography(spark, d)
    found = None
    for generator in {f: name for name, f in cq.GENERATORS.items()}.values():  # names of one function once
        space = StateSpace(spark, task, generator)
        moves = space.transitions(space.initial()).select(F.filter("adds", lambda x: x["p"] == task.number("at"))[0]["a"][1].alias("o")).distinct()
        found = moves if found is None else found.intersect(moves)
    number = F.substring("name", 2, 9).try_cast("long").alias("n_nationkey")
    nations = found.join(catalog.task_tables(spark, task)["objects"].select("o", number), "o").join(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    return nations.groupBy(F.col("n_regionkey").alias("region")).agg(F.min("n_nationkey").cast("long").alias("least"), F.count("*").alias("moves"))


@query("SELECT o_orderkey FROM orders ORDER BY CAST(floor(o_totalprice / 1000) AS BIGINT), o_custkey, o_orderkey LIMIT 100")
def top_k_open(spark, d):
    """The 100 rows that a greedy search takes from an open list of all orders: by h, then g, then place."""
    search = Search(spark, SHIP, search="gbfs", batch=100)
    opened = table(spark, d, "orders").select(F.floor(F.col("o_totalprice") / 1000).alias("h"), F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("seq"))
    return search._taken(opened).select(F.col("seq").alias("o_orderkey"))


@query("WITH p AS (SELECT o_custkey AS c, list_sort(list(DISTINCT o_orderpriority)) AS x FROM orders GROUP BY o_custkey), f AS (SELECT o_custkey AS c, list_sort(list(DISTINCT o_orderpriority)) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), k AS (SELECT x, min(c) AS old FROM f GROUP BY x) SELECT array_to_string(x, ',') AS packed, min(c) AS first_customer, CAST(count(*) AS BIGINT) AS n, coalesce(min(old), -1) AS old FROM p LEFT JOIN k USING (x) GROUP BY x")
def dedup_visited(spark, d):
    """All customers' sets of priorities as databases, looked up among the databases known: those of the finished orders alone."""
    orders = table(spark, d, "orders")
    atom = F.struct(F.lit(0).alias("p"), F.array(F.substring("o_orderpriority", 1, 1).cast("int")).alias("a")).cast(ATOM)
    names = _states(orders, "o_custkey", atom).join(orders.groupBy(F.col("o_custkey").alias("state")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("packed")), "state")
    moves = names.groupBy("atoms", "n_objects", "packed").agg(F.min("state").alias("first_customer"), F.count("*").alias("n"))
    known = _states(orders.where("o_orderstatus = 'F'"), "o_custkey", atom).select("atoms", "n_objects", "state", F.lit(0).alias("g"))
    return Search(spark, SHIP, search="bfs")._looked_up(moves, known).select("packed", "first_customer", "n", F.coalesce("old", F.lit(-1)).alias("old"))


@query("SELECT user_id, event_type, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS atom FROM (SELECT DISTINCT user_id, event_type FROM events)")
def atom_dictionary(spark, d):
    """Numbers within a predicate (here the user), so that no task holds all atoms."""
    atoms = table(spark, d, "events").select("user_id", "event_type").distinct()
    return atoms.withColumn("atom", F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).cast("long"))


@query("WITH RECURSIVE up(t, s) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'object' FROM region), c AS (SELECT t, s FROM up UNION SELECT c.t, up.s FROM c JOIN up ON up.t = c.s) SELECT t, s FROM c")
def type_closure(spark, d):
    up = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("t"), F.concat(F.lit("r"), "n_regionkey").alias("s")).unionByName(table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("t"), F.lit("object").alias("s"))).distinct()
    tables = Tables(spark, "types")
    new = tables.keep(up)
    closure, turn = tables.append("closure", new, 0), 0
    while True:
        turn += 1
        step = new.alias("a").join(up.alias("b"), F.col("a.s") == F.col("b.t")).select("a.t", "b.s").distinct()
        new = tables.keep(step.join(closure, ["t", "s"], "left_anti"))
        if new.isEmpty():
            return closure
        closure = tables.append("closure", new, turn)


@query("SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
def static_detect(spark, d):
    changed = table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, d, "nation").select("n_nationkey").join(changed, "n_nationkey", "left_anti")


_PAIRS = "SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey < c_nationkey"


@query(f"WITH p AS ({_PAIRS}) SELECT x.a, x.b, y.b AS c FROM p x JOIN p y ON y.a = x.b JOIN p z ON z.a = x.a AND z.b = y.b")
def pair_clique(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("b"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    pairs = line.join(supplier, "l_suppkey").join(orders, "l_orderkey").join(customer, "o_custkey").where("a < b").select("a", "b").distinct()
    x, y, z = Var(0), Var(1), Var(2)
    inputs = [cq.Input(pairs.select(F.col("a").alias(p.column), F.col("b").alias(q.column)), frozenset({p, q})) for p, q in ((x, y), (y, z), (x, z))]
    return cq.evaluate(Query(()), inputs, "clique_kckp").select(F.col("v0").alias("a"), F.col("v1").alias("b"), F.col("v2").alias("c"))


def _least_linked(tables: Tables, links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b): the least node that each is linked to, in either direction and over any number of links."""
    both = tables.keep(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = tables.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hop = label.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = label.join(near, "node").join(hop, "component", "left").select("node", F.least("component", "near", "far").alias("component"), F.col("component").alias("was"))
        step = tables.keep(step)
        label = step.drop("was")
        if step.where("component <> was").isEmpty():
            return label


@query("WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey // 3 AS b FROM supplier), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, m) AS (SELECT a, a FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.n) SELECT n AS node, min(m) AS component FROM r GROUP BY n")
def components(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.floor(F.col("s_suppkey") / 3).alias("b"))
    return _least_linked(Tables(spark, "components"), s)


@query("WITH RECURSIVE e AS (SELECT c_custkey AS a, CAST(-1 - c_nationkey AS BIGINT) AS b FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, m) AS (SELECT a, a FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.n) SELECT n AS node, min(m) AS component FROM r GROUP BY n")
def components_customers(spark, d):
    """Over the links of all customers to their nations; nation n is node -1 - n."""
    links = table(spark, d, "customer").select(F.col("c_custkey").alias("a"), (-1 - F.col("c_nationkey").cast("long")).alias("b"))
    return _least_linked(Tables(spark, "components"), links)


OPEN_ACCOUNT = parse_task(
    "(define (domain account) (:types ledger) (:predicates (waiting ?o) (booked ?o ?l)) (:action book :parameters (?o) :precondition (waiting ?o) :effect (and (not (waiting ?o)) (:new (?l - ledger) (booked ?o ?l)))))",
    "(define (problem p) (:domain account) (:objects none) (:init) (:goal (booked none none)))",
)


@query("SELECT o_custkey AS custkey, o_orderkey AS orderkey, n AS fresh, n + 1 AS n_objects FROM orders JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey) USING (o_custkey) WHERE o_orderstatus = 'P'")
def fresh_objects(spark, d):
    """Each pending order can be booked with a ledger that did not exist: its number is that of the objects of the customer's state so far."""
    pending = F.when(F.col("o_orderstatus") == "P", _fact(OPEN_ACCOUNT.number("waiting"), "o_orderkey"))
    states = _states(table(spark, d, "orders"), "o_custkey", pending, F.count("*"))
    after = StateSpace(spark, OPEN_ACCOUNT, "join").successors(states)
    booked = F.filter("added", lambda x: x["p"] == OPEN_ACCOUNT.number("booked"))[0]["a"]
    return after.select(F.col("parent").alias("custkey"), booked[0].cast("long").alias("orderkey"), booked[1].cast("long").alias("fresh"), F.col("n_objects").cast("long").alias("n_objects"))


@query("WITH RECURSIVE p AS (SELECT o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders), goal AS (SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1), r AS (SELECT p.k, p.parent, 0 AS back FROM p JOIN goal USING (k) UNION ALL SELECT p.k, p.parent, r.back + 1 FROM r JOIN p ON p.k = r.parent) SELECT k, CAST(back AS BIGINT) AS back FROM r")
def plan_lineage(spark, d):
    orders = table(spark, d, "orders")
    tables = Tables(spark, "lineage")
    parent = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    goal = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select("o_orderkey", "o_custkey")
    links = tables.keep(orders.join(goal.select("o_custkey"), "o_custkey", "left_semi").select(F.col("o_orderkey").alias("k"), parent.alias("parent")))
    found = at = tables.keep(links.join(goal.select(F.col("o_orderkey").alias("k")), "k", "left_semi").select("k", "parent", F.lit(0).cast("long").alias("back")))
    while True:
        up = at.where("parent is not null").select(F.col("parent").alias("k"), (F.col("back") + 1).alias("back"))
        at = tables.keep(links.join(up, "k").select("k", "parent", "back"))
        if at.isEmpty():
            return found.select("k", "back")
        found = found.unionByName(at)


@query("SELECT s_nationkey, CAST(sum(CAST('0x' || substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT) AS digest, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT s_nationkey, s_suppkey FROM supplier) GROUP BY s_nationkey")
def relation_digest(spark, d):
    """Order-independent digest of a relation: the sum of its rows' hashes."""
    rows = table(spark, d, "supplier").select("s_nationkey", "s_suppkey").distinct()
    of_row = F.conv(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 8), 16, 10).cast("long")
    return rows.groupBy("s_nationkey").agg(F.sum(of_row).alias("digest"), F.count("*").alias("n"))


@query("SELECT o_custkey, CAST(sum(DISTINCT o_orderkey) AS BIGINT) AS distinct_sum, CAST(sum(o_orderkey) AS BIGINT) AS plain_sum, CAST(count(*) AS BIGINT) AS length FROM orders GROUP BY o_custkey")
def plan_sums(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sum_distinct("o_orderkey").alias("distinct_sum"), F.sum("o_orderkey").alias("plain_sum"), F.count("*").alias("length"))


@query("SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation EXCEPT SELECT n_regionkey, n_nationkey FROM nation")
def complement(spark, d):
    possible = table(spark, d, "region").select("r_regionkey").crossJoin(table(spark, d, "nation").select("n_nationkey"))
    return possible.join(table(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey"), ["r_regionkey", "n_nationkey"], "left_anti")
