"""Conjunctive queries, relaxations, searches and novelty on small tasks and random queries."""

from random import Random

import pytest
from pyspark.sql import functions as F

from tessera.operators.datalog import Heuristic
from tessera.operators.novelty import first_occurrence
from tessera.operators.search import INCOMPLETE, OUT_OF_TIME, PLAN_FOUND, SEARCHES, UNSOLVABLE, UNSUPPORTED, Search, portfolio, solve, validate
from tessera.operators.states import StateSpace
from tessera.plans import conjunctive as cq
from tessera.plans.ir import Comparison, Const, Query, Var
from tessera.sources import pddl

from .domains import CHORES, COUNTERS, DETOUR, DOORS, FERRY, HIRE, MINT, SUPPER, least_cost, plan_cost, roads


def _frame(spark, names, rows):
    return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))


def test_witness_and_products(spark):
    r = _frame(spark, ["v0", "v1"], [(1, 10), (1, 11), (2, 10)])
    s = _frame(spark, ["v1", "v2"], [(10, 5), (10, 6)])
    joined = cq.natural_join(r, s)
    assert joined.count() == 4
    assert sorted(map(tuple, cq.witness(joined.select("v0", "v1", "v2"), ["v0"]).collect())) == [(1, 10, 5), (2, 10, 5)]
    t = _frame(spark, ["v9"], [])
    assert cq.natural_join(r, t).count() == 0 and cq.semi_join(r, t).count() == 3
    assert cq.witness(r, []).count() == 1 and cq.witness(r.limit(0), []).count() == 0


def test_scan_repeated_variables_and_constants(spark):
    p = _frame(spark, ["a", "b"], [(1, 1), (1, 2)])
    assert [tuple(x) for x in cq.scan(p, (Var(0), Var(0)), ["a", "b"]).collect()] == [(1,)]
    assert [tuple(x) for x in cq.scan(p, (Const(1), Var(3)), ["a", "b"]).orderBy("v3").collect()] == [(1,), (2,)]


def test_full_reducer_removes_dangling_rows(spark):
    x, y, z, w = (Var(k) for k in range(4))
    inputs = [cq.Input(_frame(spark, names, rows), frozenset(v)) for names, rows, v in ((["v0", "v1"], [(1, 1), (2, 9)], (x, y)), (["v1", "v2"], [(1, 1), (7, 1)], (y, z)), (["v2", "v3"], [(1, 1), (8, 8)], (z, w)))]
    assert [i.frame.count() for i in cq.reduced(inputs)[0]] == [1, 1, 1]


@pytest.mark.parametrize("seed", range(3))
def test_strategies_agree_on_random_queries(spark, seed):
    r = Random(seed)
    n = r.randint(3, 4)
    inputs = []
    for k in range(n):
        v = sorted(r.sample(range(n), 2)) if seed else [k, k + 1]
        rows = sorted({(s, r.randint(0, 3), r.randint(0, 3)) for s in (0, 1) for _ in range(8)})
        keyed = k % 2 == 0
        frame = _frame(spark, ["state", *(f"v{i}" for i in v)], rows) if keyed else _frame(spark, [f"v{i}" for i in v], sorted({x[1:] for x in rows}))
        inputs.append(cq.Input(frame, frozenset(map(Var, v))))
    used = sorted(frozenset().union(*(i.variables for i in inputs)))
    query = Query((), (Comparison(used[0], used[-1], False),), frozenset(used[:2]))
    keep = ["state", *(v.column for v in used[:2])]
    want = None
    for name in cq.GENERATORS:
        got = sorted(map(tuple, cq.evaluate(query, inputs, name).select(*keep).distinct().collect()))
        want = got if want is None else want
        assert got == want, name


def test_reducer_scans_each_table_a_few_times(spark, tmp_path):
    """A chain of six inputs: the plan grows with the chain only, the rows are those of the plain join."""
    from tessera.scratch import Tables

    r, inputs = Random(2), []
    for k in range(6):
        rows = sorted({(r.randint(0, 9), r.randint(0, 9)) for _ in range(30)})
        _frame(spark, [f"v{k}", f"v{k + 1}"], rows).write.parquet(str(tmp_path / str(k)))
        inputs.append(cq.Input(spark.read.parquet(str(tmp_path / str(k))), frozenset({Var(k), Var(k + 1)})))
    query = Query((), (), frozenset({Var(0), Var(6)}))
    want = sorted(map(tuple, cq.evaluate(query, inputs, "join").select("v0", "v6").distinct().collect()))
    for name in ("full_reducer", "yannakakis"):
        frame = cq.evaluate(query, inputs, name, tables=Tables(spark, "reduce"))
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= 6 + 2 * 5, name  # the inputs and the keys up and down
        assert sorted(map(tuple, frame.select("v0", "v6").distinct().collect())) == want


def _relaxed(task, fold):
    """The goal's relaxed cost in the first state by a plain fixpoint over ground actions."""
    from .domains import _ground

    cost = dict.fromkeys(task.init, 0)
    ground, changed = _ground(task), True
    while changed:
        changed = False
        for c, need, _, adds, _ in ground:
            if all(x in cost for x in need):
                total = fold([cost[x] for x in need] or [0]) + c
                for x in adds:
                    if total < cost.get(x, total + 1):
                        cost[x], changed = total, True
    goals = [(g.pred, tuple(t.value for t in g.args)) for g in task.goal if not g.negated]
    return fold([cost[g] for g in goals]) if all(g in cost for g in goals) else None


@pytest.mark.parametrize("name", ["FERRY", "DOORS", "HIRE"])
def test_values_of_the_first_state(spark, name):
    task = pddl.parse_task(*{"FERRY": FERRY, "DOORS": DOORS, "HIRE": HIRE}[name])
    space = StateSpace(spark, task)
    got = {h: Heuristic(space, h).evaluate(space.initial()).first()["h"] for h in ("goalcount", "hmax", "add")}
    assert got == {"goalcount": len(task.goal), "hmax": _relaxed(task, max), "add": _relaxed(task, sum)}


def test_disjunction_values(spark):
    space = StateSpace(spark, pddl.parse_task(*SUPPER))
    assert Heuristic(space, "hmax").evaluate(space.initial()).first()["h"] == 1
    assert Heuristic(space, "rff").evaluate(space.initial()).first()["h"] == 2


def test_dead_end_has_no_value(spark):
    domain, problem = SUPPER
    space = StateSpace(spark, pddl.parse_task(domain, problem.replace("(rice lou)", "")))
    assert Heuristic(space, "add").evaluate(space.initial()).first()["h"] is None
    assert solve(spark, space.task, search="bfs").code == UNSOLVABLE


#: Costs of the tasks, which the plain planner finds as well.
COSTS = {"FERRY": (FERRY, 11), "DOORS": (DOORS, 6), "CHORES": (CHORES, 7), "HIRE": (HIRE, 2), "SUPPER": (SUPPER, 2), "COUNTERS": (COUNTERS, 4)}


@pytest.mark.parametrize("name,search,evaluator,generator", [("FERRY", "bfs", "blind", "join"), ("DOORS", "bfs", "blind", "full_reducer"), ("CHORES", "bfs", "blind", "yannakakis"), ("HIRE", "astar", "blind", "ordered_join"), ("SUPPER", "gbfs", "rff", "full_reducer"), ("COUNTERS", "bfs", "blind", "clique_kckp")])
def test_golden_costs(spark, name, search, evaluator, generator):
    text, cost = COSTS[name]
    task = pddl.parse_task(*text)
    assert least_cost(task) == cost
    result = solve(spark, task, search=search, evaluator=evaluator, generator=generator)
    assert (result.code, result.cost, plan_cost(task, result.lines)) == (PLAN_FOUND, cost, cost)
    assert result.lines[-1] == f"; cost = {cost}"
    if name == "COUNTERS":
        assert validate(spark, task, result.steps) and not validate(spark, task, result.steps[:-1])


@pytest.mark.parametrize("batch", [1, 64])
def test_cheaper_paths_reopen(spark, batch):
    task = pddl.parse_task(*roads(DETOUR, "s", "g"))
    result = solve(spark, task, search="astar", evaluator="blind", batch=batch)
    assert result.cost == least_cost(task) == plan_cost(task, result.lines) == 3 and result.statistics["reopened"] >= 1
    assert solve(spark, task, search="bfs").cost == 6  # the fewest steps


@pytest.mark.parametrize("seed", range(1))
def test_astar_equals_dijkstra_on_random_roads(spark, seed):
    r = Random(seed)
    nodes = "abcdef"
    edges = sorted({(a, b): (a, b, r.choice((1, 2, 7))) for a, b in (r.sample(nodes, 2) for _ in range(14))}.values())
    task = pddl.parse_task(*roads([*edges, ("a", "f", 20)], "a", "f"))
    result = solve(spark, task, search="astar", evaluator="goalcount", batch=4)
    assert result.cost == least_cost(task) == plan_cost(task, result.lines)


@pytest.mark.parametrize("search,evaluator", [("lazy", "goalcount"), ("lazy-po", "ff"), ("bfws2", "blind"), ("dq-bfws1-rx", "blind"), ("alt-bfws1", "ff")])
def test_searches_find_plans(spark, search, evaluator):
    task = pddl.parse_task(*COUNTERS)
    result = solve(spark, task, search=search, evaluator=evaluator, generator="join", batch=4)
    assert result.code == PLAN_FOUND and plan_cost(task, result.lines) == result.cost


def test_pruning_ends_incomplete(spark):
    """Width 1 can't hold two facts that must both stay."""
    domain = "(define (domain d) (:predicates (a) (b) (c) (g)) (:action x :parameters () :precondition () :effect (a)) (:action y :parameters () :precondition () :effect (b)) (:action z :parameters () :precondition (and (a) (b)) :effect (g)))"
    task = pddl.parse_task(domain, "(define (problem p) (:domain d) (:init) (:goal (g)))")
    assert solve(spark, task, search="iw1").code == INCOMPLETE and solve(spark, task, search="iw2").code == PLAN_FOUND


def test_novelty_by_a_plain_version(spark):
    """Whether only added atoms or all are looked at, state by state."""
    from tessera.operators.novelty import Novelty
    from tessera.scratch import Tables

    r, seen, states, want = Random(3), {1: set(), 2: set()}, [], {}
    for k in range(60):
        atoms = sorted({r.randint(0, 6) for _ in range(3)})
        added, part, same = [x for x in atoms if r.random() < 0.5], r.randint(0, 1), r.random() < 0.6
        own = added if same else atoms
        one = {(part, x) for x in own} - seen[1]
        two = {(part, min(x, y), max(x, y)) for x in own for y in atoms if x != y} - seen[2]
        seen[1] |= one
        seen[2] |= two
        want[k] = 1 if one else 2 if two else 3
        states.append((k, k, part, 0, [(0, [x]) for x in atoms], [(0, [x]) for x in added], False, same))
    novelty, got = Novelty(Tables(spark, "novelty"), 2, 100), {}
    for lo in (0, 25):  # two batches
        frame = spark.createDataFrame(states[lo : 25 if lo == 0 else 60], "state long, seq long, r int, g int, atoms array<struct<p: int, a: array<int>>>, added array<struct<p: int, a: array<int>>>, done boolean, same boolean")
        got |= {x.state: x.w for x in novelty.novelty(frame).collect()}
    assert got == want


def test_portfolio_hands_time_on(spark):
    task = pddl.parse_task(*SUPPER)
    result = portfolio(spark, task, [({"search": "iw1", "generator": "join"}, 1), ({"search": "bfs", "generator": "join"}, 1)])
    assert (result.code, result.cost) == (PLAN_FOUND, 2) and result.statistics["configuration"] in (1, 2)
    assert portfolio(spark, task, [({"search": "bfs"}, 1)], time_limit=0).code == OUT_OF_TIME


def test_object_creation(spark):
    task = pddl.parse_task(*MINT)
    assert solve(spark, task, search="bfs", generator="full_reducer").cost == 2
    assert Search(spark, task, search="gbfs", evaluator="ff").run().code == UNSUPPORTED
    space = StateSpace(spark, task)
    after = space.successors(space.initial()).first()
    assert after["n_objects"] == 2 and [1] in [list(x["a"]) for x in after["atoms"]]


def test_adds_win_over_deletes(spark):
    domain = "(define (domain d) (:predicates (p ?x) (q)) (:action a :parameters (?x) :precondition (p ?x) :effect (and (not (p ?x)) (p ?x) (q))))"
    space = StateSpace(spark, pddl.parse_task(domain, "(define (problem x) (:domain d) (:objects o) (:init (p o)) (:goal (q)))"))
    row = space.successors(space.initial()).first()
    assert len(row["atoms"]) == 2 and len(row["added"]) == 1


def test_first_occurrence(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "x"), (4, "a", "x")], "seq int, atom string, part string")
    out = {x.seq: x.is_new for x in first_occurrence(rows, ["atom"], "seq", ("part",)).collect()}
    assert out == {1: True, 2: False, 3: True, 4: True}


def test_every_search_name_is_known(spark):
    assert len(SEARCHES) == 18
    with pytest.raises(ValueError):
        solve(spark, pddl.parse_task(*SUPPER), search="nothing")
