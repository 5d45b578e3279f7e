"""Small tasks written for the tests, and a plain planner that finds their costs by trying every binding."""

import heapq
from itertools import count, product

from tessera.plans.ir import Const

#: Moves with a carrier that holds one car; untyped; (empty) has no argument.
FERRY = (
    """(define (domain ferry) (:predicates (shore ?l) (car ?c) (docked ?l) (parked ?c ?l) (aboard ?c) (empty))
(:action sail :parameters (?from ?to) :precondition (and (docked ?from) (shore ?to) (not (= ?from ?to))) :effect (and (docked ?to) (not (docked ?from))))
(:action load :parameters (?c ?l) :precondition (and (car ?c) (parked ?c ?l) (docked ?l) (empty)) :effect (and (aboard ?c) (not (parked ?c ?l)) (not (empty))))
(:action unload :parameters (?c ?l) :precondition (and (aboard ?c) (docked ?l)) :effect (and (parked ?c ?l) (empty) (not (aboard ?c)))))""",
    """(define (problem crossing) (:domain ferry) (:objects west east van taxi truck)
(:init (shore west) (shore east) (car van) (car taxi) (car truck) (docked west) (empty) (parked van west) (parked taxi west) (parked truck west))
(:goal (and (parked van east) (parked taxi east) (parked truck east))))""",
)

#: A walk with keys that open doors of their colour; a loop with distinct ends.
DOORS = (
    """(define (domain doors) (:requirements :typing) (:types room colour) (:predicates (in ?r - room) (door ?a ?b - room ?k - colour) (open ?a ?b - room) (key ?k - colour ?r - room) (has ?k - colour))
(:action take :parameters (?k - colour ?r - room) :precondition (and (in ?r) (key ?k ?r)) :effect (and (has ?k) (not (key ?k ?r))))
(:action unlock :parameters (?a ?b - room ?k - colour) :precondition (and (in ?a) (door ?a ?b ?k) (has ?k)) :effect (open ?a ?b))
(:action walk :parameters (?a ?b - room) :precondition (and (in ?a) (open ?a ?b) (not (= ?a ?b))) :effect (and (in ?b) (not (in ?a)))))""",
    """(define (problem out) (:domain doors) (:objects hall attic yard - room red blue - colour)
(:init (in hall) (door hall attic red) (door attic yard blue) (door yard hall red) (key red hall) (key blue attic)) (:goal (in yard)))""",
)

#: Facts without arguments only, and one that undoes another.
CHORES = (
    """(define (domain chores) (:predicates (swept) (mopped) (dusted) (fed) (watered) (locked) (lit) (tired))
(:action sweep :parameters () :precondition () :effect (swept)) (:action mop :parameters () :precondition (swept) :effect (mopped))
(:action dust :parameters () :precondition (not (swept)) :effect (dusted)) (:action feed :parameters () :precondition () :effect (fed))
(:action water :parameters () :precondition () :effect (watered)) (:action lock :parameters () :precondition () :effect (locked))
(:action light :parameters () :precondition (not (locked)) :effect (and (lit) (not (tired)))))""",
    "(define (problem day) (:domain chores) (:init (tired)) (:goal (and (swept) (mopped) (dusted) (fed) (watered) (locked) (lit))))",
)

#: Only hiring costs; chains of free steps; constants in schemas.
HIRE = (
    """(define (domain hire) (:requirements :typing :action-costs) (:types crew job rank) (:constants boss - crew) (:predicates (hired ?c - crew) (next ?a ?b - rank) (level ?r - rank) (done ?j - job ?c - crew) (able ?c - crew ?j - job)) (:functions (total-cost) - number)
(:action recruit :parameters (?c - crew ?a ?b - rank) :precondition (and (level ?a) (next ?a ?b)) :effect (and (hired ?c) (level ?b) (not (level ?a)) (increase (total-cost) 1)))
(:action work :parameters (?c - crew ?j - job) :precondition (and (hired ?c) (able ?c ?j)) :effect (done ?j ?c))
(:action sign :parameters (?j - job ?c - crew) :precondition (and (done ?j ?c) (hired ?c)) :effect (done ?j boss)))""",
    """(define (problem team) (:domain hire) (:objects ann bob - crew dig saw - job r0 r1 r2 r3 - rank)
(:init (= (total-cost) 0) (level r0) (next r0 r1) (next r1 r2) (next r2 r3) (able ann dig) (able bob saw)) (:goal (and (done dig boss) (done saw boss))) (:metric minimize (total-cost)))""",
)

#: One condition of three alternatives.
SUPPER = (
    "(define (domain supper) (:predicates (rice ?x) (bread ?x) (soup ?x) (full ?x)) (:action eat :parameters (?who) :precondition (or (rice ?who) (soup ?who) (bread ?who)) :effect (and (full ?who) (not (rice ?who)))))",
    "(define (problem two) (:domain supper) (:objects kim lou max) (:init (soup kim) (rice lou) (bread max) (full max)) (:goal (and (full kim) (full lou))))",
)

COUNTERS = (
    """(define (domain counters) (:requirements :typing :action-costs) (:types item) (:predicates (at ?x - item) (next ?x ?y - item) (done ?x - item)) (:functions (total-cost) - number)
(:action inc :parameters (?x ?y - item) :precondition (and (at ?x) (next ?x ?y)) :effect (and (not (at ?x)) (at ?y) (increase (total-cost) 2)))
(:action mark :parameters (?x ?y) :precondition (and (at ?x) (not (= ?x ?y)) (next ?y ?x)) :effect (done ?x)))""",
    """(define (problem three) (:domain counters) (:objects a b c - item) (:init (= (total-cost) 0) (at a) (next a b) (next b c)) (:goal (done c)) (:metric minimize (total-cost)))""",
)

#: Two new objects of different types at once, and one more with each turn of the press.
MINT = (
    """(define (domain mint) (:types metal - object coin - metal seal) (:predicates (warm) (stamped) (marked ?m - metal ?s - seal))
(:action press :parameters () :precondition (warm) :effect (and (not (warm)) (:new (?c - coin ?s - seal) (marked ?c ?s))))
(:action stamp :parameters (?c - coin ?s - seal) :precondition (marked ?c ?s) :effect (stamped)))""",
    "(define (problem first) (:domain mint) (:objects) (:init (warm)) (:goal (stamped)))",
)

#: A short dear way found first and a long cheap one: edges as (from, to, cost).
DETOUR = (("s", "b", 5), ("s", "a", 1), ("a", "b", 1), ("b", "g", 1))


def roads(edges, start, goal):
    """A task of moves over edges, one schema for each cost."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    costs = sorted({c for _, _, c in edges})
    acts = "".join(f"(:action go{c} :parameters (?a ?b) :precondition (and (at ?a) (road{c} ?a ?b)) :effect (and (not (at ?a)) (at ?b) (increase (total-cost) {c})))" for c in costs)
    domain = f"(define (domain roads) (:predicates (at ?x) {' '.join(f'(road{c} ?a ?b)' for c in costs)}) (:functions (total-cost) - number) {acts})"
    facts = " ".join(f"(road{c} {a} {b})" for a, b, c in edges)
    return domain, f"(define (problem way) (:domain roads) (:objects {' '.join(nodes)}) (:init (at {start}) {facts}) (:goal (at {goal})))"


def _ground(task):
    """(cost, preconditions, absent predicates, adds, deletes) of every action and binding that its comparisons allow."""
    out = []
    for a in task.actions:
        for values in product(range(len(task.objects)), repeat=a.arity):
            value = lambda t: t.value if isinstance(t, Const) else values[t.index]
            if all((value(c.left) == value(c.right)) == c.equal for c in a.comparisons):
                facts = lambda atoms: frozenset((x.pred, tuple(map(value, x.args))) for x in atoms)
                out.append((a.cost, facts(a.atoms), a.absent, facts(a.adds), facts(a.deletes)))
    return out


def least_cost(task, unit: bool = False):
    """Cost of the cheapest plan (of the fewest steps with unit) by Dijkstra; None if there is none. No object creation."""
    ground, order = _ground(task), count()
    goal = [((g.pred, tuple(t.value for t in g.args)), g.negated) for g in task.goal]
    start = frozenset(task.init)
    best, queue = {start: 0}, [(0, next(order), start)]
    while queue:
        g, _, state = heapq.heappop(queue)
        if g > best[state]:
            continue
        if all((fact in state) != negated for fact, negated in goal):
            return g
        for cost, need, absent, adds, deletes in ground:
            if need <= state and not any((p, ()) in state for p in absent):
                after, total = (state - deletes) | adds, g + (1 if unit else cost)
                if total < best.get(after, total + 1):
                    best[after] = total
                    heapq.heappush(queue, (total, next(order), after))
    return None


def plan_cost(task, lines):
    """The cost of plan lines `k: (name a b)` if each step applies and the goal holds at the end, else None."""
    state, number, total = frozenset(task.init), {n: k for k, n in enumerate(task.objects)}, 0
    for line in lines[:-1]:
        name, *names = line.partition(": ")[2].strip("()").split()
        values = [number[n] for n in names]
        for a in (a for a in task.actions if a.name == name):
            value = lambda t: t.value if isinstance(t, Const) else values[t.index]
            facts = lambda atoms: frozenset((x.pred, tuple(map(value, x.args))) for x in atoms)
            if facts(a.atoms) <= state and not any((p, ()) in state for p in a.absent) and all((value(c.left) == value(c.right)) == c.equal for c in a.comparisons):
                state, total = (state - facts(a.deletes)) | facts(a.adds), total + a.cost
                break
        else:
            return None
    return total if all(((g.pred, tuple(t.value for t in g.args)) in state) != g.negated for g in task.goal) else None
