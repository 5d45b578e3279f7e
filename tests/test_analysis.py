"""Stored tasks and analyses of rules against plain versions."""

from random import Random

from tessera.operators import analysis
from tessera.plans.ir import Const, Var
from tessera.scratch import Tables
from tessera.sources import catalog, pddl

from .domains import COUNTERS, FERRY, HIRE, MINT, SUPPER


def test_stored_tasks_come_back(spark, tmp_path):
    for k, text in enumerate((FERRY, HIRE, MINT, SUPPER)):
        task = pddl.parse_task(*text)
        catalog.save(spark, task, str(tmp_path / str(k)))
        assert catalog.load(spark, str(tmp_path / str(k))) == task


def _candidates(task):
    found, grown = {(p, k, o) for p, a in task.init for k, o in enumerate(a)} | {(p, None, None) for p, a in task.init if not a}, True
    while grown:
        there, before = {p for p, _, _ in found}, len(found)
        for a in task.actions:
            if all(x.pred in there for x in a.atoms):
                for e in a.adds:
                    if not e.args:
                        found.add((e.pred, None, None))
                    for k, t in enumerate(e.args):
                        if isinstance(t, Const):
                            found.add((e.pred, k, t.value))
                        else:
                            own = [{o for p, j, o in found if (p, j) == (x.pred, i)} for x in a.atoms for i, v in enumerate(x.args) if v == t]
                            found |= {(e.pred, k, o) for o in (set.intersection(*own) if own else ())}
        grown = len(found) > before
    return found


def test_argument_candidates_and_ground_state(spark):
    for text in (FERRY, HIRE):
        task = pddl.parse_task(*text)
        candidates = analysis.argument_candidates(spark, task)
        assert {tuple(r) for r in candidates.collect()} == _candidates(task)
        rows = {(r.p, tuple(r.a)): r.holds for r in catalog.ground_state(spark, task, candidates).collect()}
        assert {x for x, holds in rows.items() if holds} == {x for x in task.init if x[0] not in task.static} and not all(rows.values())


def test_abstract_costs_and_counts():
    task = pddl.parse_task(*COUNTERS)
    inside, outside = analysis.abstract_costs(task)
    assert inside[task.number("done")] == 0 and outside[task.number("done")] == 0 and outside[task.number("at")] == 0
    hire = pddl.parse_task(*HIRE)
    inside, outside = analysis.abstract_costs(hire)
    assert inside[hire.number("hired")] == 1 == inside[hire.number("done")] and outside[hire.number("level")] == 1
    assert analysis.defining_rules(hire)[hire.number("done")] == 2 and analysis.reachable_predicates(hire) >= {hire.number("hired"), hire.number("done")}
    inc = next(a for a in task.actions if a.name == "inc")
    assert analysis.occurrences(inc)[Var(0)] >= 2


def test_degree_pruning(spark):
    r = Random(7)
    edges = {tuple(sorted(r.sample(range(20), 2))) for _ in range(45)} | {(100, 101), (101, 102)}
    left = set(edges)
    while True:
        degree = {x: sum(x in e for e in left) for e in left for x in e}
        kept = {e for e in left if all(degree[x] >= 3 for x in e)}
        if kept == left:
            break
        left = kept
    got = analysis.pruned_by_degree(spark.createDataFrame(sorted(edges), "a int, b int"), 3, Tables(spark, "degree"))
    assert {tuple(x) for x in got.collect()} == left and left
