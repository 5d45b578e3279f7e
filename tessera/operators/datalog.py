"""Weighted Datalog over a batch of states: delete-relaxed reachability, least costs, provenance.

Rules come from actions: each add effect follows from the positive preconditions at the action's cost; negated and
comparison conditions are relaxed away. Costs combine by sum or maximum over a body and by minimum over derivations. The least
fixpoint is found in rounds for all states of a batch at once; only facts whose cost fell take part in a round as the
changed input of a rule, and provenance changes on strict decrease only, so that it has no cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ir import Const, Var
from ..scratch import Tables
from .states import StateSpace, literal_atom

#: How the costs of a body combine in SQL, by name.
COMBINE = {"sum": " + ".join, "max": lambda costs: f"greatest({', '.join(costs)})" if len(costs) > 1 else costs[0]}
#: (cost, op, binding, body): how a fact was reached; op is -1 for facts of the state itself.
BODY = "array<struct<p: int, a: array<int>>>"
WHY = f"struct<cost: int, op: int, binding: array<int>, body: {BODY}>"


def _ints(terms: list[str]) -> str:
    return f"array({', '.join(terms)})" if terms else "cast(array() AS array<int>)"


class Relaxation:
    """The rules are SQL text, made once; a round is one statement over the facts known and the static facts.

    The static facts, which no rule derives, are written once, a folder for each predicate, and every rule reads those of its predicates."""

    def __init__(self, space: StateSpace, combine: str = "sum", tables: Tables | None = None):
        self.space, self.task, self.combine = space, space.task, combine
        self.tables = tables or Tables(space.spark, "relaxation")
        self.static, self.chains = None, 0
        relevant = self._relevant()
        #: (predicate of the atom that takes the changed facts; None where all of the body is static, SQL of the heads)
        self.rules = [rule for op, action in enumerate(space.actions) for rule in self._statements(op, action, relevant)]

    def _relevant(self) -> set[int]:
        """Predicates from which a goal predicate can be reached backwards; rules for others are dropped."""
        wanted = {g.pred for g in self.task.goal}
        grown = True
        while grown:
            grown = False
            for a in self.space.actions:
                if any(e.pred in wanted for e in a.adds):
                    more = {x.pred for x in a.atoms} - wanted
                    grown |= bool(more)
                    wanted |= more
        return wanted

    def _rows(self, atom, changed: bool) -> str:
        """SELECT of an atom's rows: a column per variable, with the state and the cost of a fluent one."""
        fluent = atom.pred not in self.task.static
        place = {t: k for k, t in reversed(list(enumerate(atom.args)))}
        tests = [f"p = {atom.pred}"] + ["fell"] * changed
        tests += [f"get(a, {k}) = {t.value}" if isinstance(t, Const) else f"get(a, {k}) = get(a, {place[t]})" for k, t in enumerate(atom.args) if isinstance(t, Const) or place[t] != k]
        columns = ["state", "why.cost AS cost"] * fluent + [f"get(a, {place[v]}) AS {v.column}" for v in sorted(atom.variables)]
        return f"SELECT {'' if fluent else 'DISTINCT '}{', '.join(columns)} FROM {'{known}' if fluent else '{static}'} WHERE {' AND '.join(tests)}"

    def _statements(self, op: int, action, relevant: set[int]):
        """One SELECT (state, p, a, why) per fluent atom of the body, that atom's facts being the changed ones."""
        adds = [e for e in action.adds if e.pred in relevant and not e.variables & set(action.fresh)]
        if not adds:
            return
        fluent = [a for a in action.atoms if a.pred not in self.task.static]
        static = [a for a in action.atoms if a.pred in self.task.static and a.variables]
        for start in fluent or [None]:
            left = [a for a in fluent if a is not start] + static
            frm, at = (f"({self._rows(start, True)}) t0", {v: f"t0.{v.column}" for v in start.variables}) if start else ("{states} t0", {})
            costs, n = ["t0.cost"] if start else ["0"], 0
            while left:  # those that share most with what is bound; static ones first among equals
                atom = max(left, key=lambda a: (len(a.variables & at.keys()) + (a.pred not in self.task.static), a.pred in self.task.static))
                left.remove(atom)
                n += 1
                on = [f"{at[v]} = t{n}.{v.column}" for v in sorted(atom.variables & at.keys())]
                if atom.pred not in self.task.static:
                    on.append(f"t0.state = t{n}.state")
                    costs.append(f"t{n}.cost")
                frm += f" JOIN ({self._rows(atom, False)}) t{n} ON {' AND '.join(on)}" if on else f" CROSS JOIN ({self._rows(atom, False)}) t{n}"
                at.update({v: f"t{n}.{v.column}" for v in atom.variables - at.keys()})
            fact = lambda x: f"named_struct('p', {x.pred}, 'a', {_ints([str(t.value) if isinstance(t, Const) else at[t] for t in x.args])})"
            binding = _ints([at[Var(k)] for k in range(action.arity)])
            body = f"array({', '.join(map(fact, fluent))})" if fluent else f"cast(array() AS {BODY})"
            why = f"named_struct('cost', cast({COMBINE[self.combine](costs)} + {action.cost} AS int), 'op', {op}, 'binding', {binding}, 'body', {body})"
            yield start.pred if start else None, f"SELECT state, x.p, x.a, why FROM (SELECT t0.state, {why} AS why, explode(array({', '.join(map(fact, adds))})) AS x FROM {frm})"

    def fixpoint(self, states: DataFrame) -> DataFrame:
        """(state, p, a, why): all relaxed-reachable fluent facts with their least cost and its derivation."""
        if self.static is None:
            self.static = self.tables.by_predicate(self.space.static)
        why = F.expr(f"cast(named_struct('cost', 0, 'op', -1, 'binding', array(), 'body', array()) AS {WHY})")
        known = self.tables.keep(self.space.facts(states).select("state", "p", "a", why.alias("why"), F.lit(True).alias("fell")))
        moved, spent = None, None
        while True:
            heads = [sql for pred, sql in self.rules if moved is None or pred in moved]
            if not heads:
                return known.drop("fell")
            better = "new IS NOT NULL AND (why IS NULL OR new.cost < why.cost)"
            best = f"SELECT state, p, a, min(why) AS new FROM ({' UNION ALL '.join(heads)}) GROUP BY state, p, a"
            merged = f"SELECT state, p, a, if({better}, new, why) AS why, {better} AS fell FROM (SELECT state, p, a, why FROM {{known}}) FULL JOIN ({best}) USING (state, p, a)"
            known, spent = self.tables.keep(self.space.spark.sql(merged, known=known, static=self.static, states=states)), known
            self.tables.drop(spent)
            moved = {r.p for r in known.where("fell").select("p").distinct().collect()}  # predicates: as many as the task names
            if not moved:
                return known.drop("fell")

    def goal_costs(self, states: DataFrame, reached: DataFrame) -> DataFrame:
        """(state, h): the goal's cost per state; null where it can't be reached. Negated goals are relaxed away."""
        goals = [g for g in self.task.goal if not g.negated and g.pred not in self.task.static]
        if not goals:
            return states.select("state", F.lit(0).alias("h"))
        table = F.array(*[literal_atom(g) for g in goals])
        wanted = states.select("state", F.explode(table).alias("x")).select("state", F.col("x.p").alias("p"), F.col("x.a").alias("a"))
        costs = wanted.join(reached.select("state", "p", "a", F.col("why.cost").alias("c")), ["state", "p", "a"], "left")
        fold = F.sum("c") if self.combine == "sum" else F.max("c")
        return costs.groupBy("state").agg(F.when(F.count("c") == F.count("*"), fold).cast("int").alias("h"))

    def backchain(self, states: DataFrame, reached: DataFrame) -> DataFrame:
        """(state, p, a, why): the facts on the chosen derivations of the goal."""
        goals = [g for g in self.task.goal if not g.negated and g.pred not in self.task.static]
        if not goals:
            return reached.limit(0)
        table = F.array(*[literal_atom(g) for g in goals])
        wanted = states.select("state", F.explode(table).alias("x"))
        self.chains += 1
        name, turn, found = f"chain{self.chains}", 0, None
        while True:
            step = reached.join(wanted.select("state", "x.p", "x.a").distinct(), ["state", "p", "a"], "left_semi")
            if found is not None:
                step = step.join(found, ["state", "p", "a"], "left_anti")
            found = self.tables.append(name, step, turn)
            last, turn = self.tables.part(name, turn), turn + 1
            if last.isEmpty():
                return found
            wanted = last.selectExpr("state", "explode(why.body) AS x")


class Heuristic:
    """evaluate(states) -> (state, h); h is null for a dead end."""

    NAMES = ("blind", "goalcount", "add", "hmax", "ff", "rff")

    def __init__(self, space: StateSpace, name: str):
        self.name = name.lower()
        if self.name not in self.NAMES:
            raise ValueError(f"unknown evaluator {name}")
        self.space = space
        self.relaxed = Relaxation(space, "max" if self.name == "hmax" else "sum") if self.name in ("add", "hmax", "ff", "rff") else None

    def evaluate(self, states: DataFrame) -> DataFrame:
        return self.evaluate_with_useful(states)[0]

    def evaluate_with_useful(self, states: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Also the facts (state, p, a, why) on the goal's derivations, for ff and rff."""
        if self.name == "blind":
            return states.select("state", F.when(self.space.is_goal(), 0).otherwise(1).alias("h")), None
        if self.name == "goalcount":
            return states.select("state", self.space.goal_count().alias("h")), None
        reached = self.relaxed.fixpoint(states)
        base = self.relaxed.goal_costs(states, reached)
        goal = states.select("state", self.space.is_goal().alias("done"))
        if self.name in ("add", "hmax"):
            return base.join(goal, "state").select("state", F.when(F.col("done"), 0).otherwise(F.col("h")).alias("h")), None
        useful = self.relaxed.backchain(states, reached)
        costs = F.element_at(F.array(*[F.lit(a.cost) for a in self.space.actions]), F.col("why.op") + 1)
        acts = useful.where("why.op >= 0").select("state", F.col("why.op").alias("op"), F.col("why.binding").alias("binding"), costs.alias("cost"))
        if self.name == "ff":
            acts = acts.distinct()
        sums = acts.groupBy("state").agg(F.sum("cost").cast("int").alias("total"))
        out = base.join(goal, "state").join(sums, "state", "left")
        return out.select("state", F.when(F.col("done"), 0).when(F.col("h").isNotNull(), F.coalesce("total", F.lit(0))).alias("h")), useful
