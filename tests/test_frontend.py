import pytest

from tessera.plans import conjunctive as cq
from tessera.plans.ir import Const, Var
from tessera.sources import pddl

from .domains import CHORES, COUNTERS, FERRY, MINT, SUPPER


def test_tokens_and_nesting():
    assert pddl.tokens("(A ?X-b) ; café\n(c)") == ["(", "a", "?x-b", ")", "(", "c", ")"]
    assert pddl.nested("(a (b c) ())") == ["a", ["b", "c"], []]
    for bad in ("(a", "a)", "(a))", "(a) (b)", "(é)"):
        with pytest.raises(pddl.PddlError):
            pddl.nested(bad)


def test_typed_lists():
    assert pddl.typed("a b - t c".split()) == [("a", "t"), ("b", "t"), ("c", "object")]


def test_normal_form():
    cond = pddl.nested("(and (p ?x) (or (q) (not (r))))")
    assert pddl.dnf(cond) == [[(False, "p", ("?x",)), (False, "q", ())], [(False, "p", ("?x",)), (True, "r", ())]]
    assert pddl.dnf(pddl.nested("(not (or (q) (r)))")) == [[(True, "q", ()), (True, "r", ())]]


def test_untyped_task():
    task = pddl.parse_task(*FERRY)
    assert [a.name for a in task.actions] == ["load", "sail", "unload"]
    assert {a.cost for a in task.actions} == {1} and len(task.objects) == 5
    assert {task.predicates[p] for p in range(len(task.predicates)) if p not in task.static} == {"docked", "parked", "aboard", "empty"}
    assert sum(x[0] not in task.static for x in task.init) == 5 and len(task.goal) == 3


def test_facts_without_arguments():
    task = pddl.parse_task(*CHORES)
    assert {a.name: a.absent for a in task.actions}["dust"] == (task.number("swept"),) and all(not a.arity for a in task.actions)


def test_disjunction_splits_under_one_name():
    task = pddl.parse_task(*SUPPER)
    assert [a.name for a in task.actions] == ["eat"] * 3


def test_costs_and_types():
    task = pddl.parse_task(*COUNTERS)
    assert {a.name: a.cost for a in task.actions} == {"inc": 2, "mark": 0}
    assert {a.cost for a in pddl.parse_task(*COUNTERS, unit_cost=True).actions} == {1}
    item = task.type_predicates["item"]
    assert (task.type_predicates["object"], (0,)) in task.init or item in task.static


def test_creation_types_each_new_object_with_its_own_chain():
    action = next(a for a in pddl.parse_task(*MINT).actions if a.fresh)
    task = pddl.parse_task(*MINT)
    assert len(action.fresh) == 2
    chains = {v: {task.predicates[e.pred] for e in action.adds if e.args == (v,) and "@" in task.predicates[e.pred]} for v in action.fresh}
    assert sorted(map(sorted, chains.values())) == [["type@coin", "type@metal", "type@object"], ["type@object", "type@seal"]]


@pytest.mark.parametrize("change", ["(nowhere ?c)", "(docked ?l ?l)", "(not (parked ?c ?l))", "(forall (?z) (shore ?z))", "(docked ?zz)"])
def test_errors(change):
    domain, problem = FERRY
    assert "(aboard ?c) (docked ?l)" in domain
    with pytest.raises(pddl.PddlError):
        pddl.parse_task(domain.replace("(aboard ?c) (docked ?l)", f"(aboard ?c) {change}"), problem)


def test_ears():
    x, y, z, w = (Var(k) for k in range(4))
    removed, alive = cq.ears([frozenset({x, y}), frozenset({y, z}), frozenset({z, w})])
    assert len(alive) == 1 and len(removed) == 2
    removed, alive = cq.ears([frozenset({x, y}), frozenset({y, z}), frozenset({x, z})])
    assert not removed and len(alive) == 3


def test_constants_are_ordered_terms():
    assert Const(1) < Const(2) and Var(0).column == "v0"
