"""States as rows, and their expansion a whole frontier at a time.

A state is one row (state, atoms, n_objects): atoms is the sorted array of its fluent facts (p, a), so that equal databases are equal
values. Static facts live in small tables without a state. A fact without arguments is an atom with an empty array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import conjunctive as cq
from ..plans.ir import Action, Atom, Const, Task

ATOM = "struct<p: int, a: array<int>>"
ATOMS = f"array<{ATOM}>"
FACTS = "p int, a array<int>"


def literal_atom(atom, offset: Column | None = None, fresh: dict | None = None) -> Column:
    """A fact built from a binding's columns, constants, and new objects counted from the state's number of objects."""
    fresh = fresh or {}
    terms = [F.lit(t.value) if isinstance(t, Const) else (offset + fresh[t]).cast("int") if t in fresh else F.col(t.column) for t in atom.args]
    args = F.array(*terms).cast("array<int>") if terms else F.array().cast("array<int>")
    return F.struct(F.lit(atom.pred).alias("p"), args.alias("a"))


class StateSpace:
    def __init__(self, spark: SparkSession, task: Task, generator: str = "yannakakis", seed: int = 1, static: DataFrame | None = None):
        """static: facts (p, a) besides those of the task, as a table of any size; no action is then found inapplicable beforehand."""
        if generator not in cq.GENERATORS:
            raise ValueError(f"unknown generator {generator}")
        self.spark, self.task, self.generator = spark, task, generator
        self.options = {"seed": seed} if generator == "random_join" else {}
        facts: dict[int, list] = {}
        for p, a in task.init:
            if p in task.static:
                facts.setdefault(p, []).append(list(a))
        self.static = spark.createDataFrame([(p, a) for p, rows in facts.items() for a in rows], FACTS)
        if static is not None:
            self.static = static if not facts else self.static.unionByName(static)
        # Compile-time emptiness: a schema whose static atom has no match at all is never applicable.
        self.actions = [a for a in task.actions if static is not None or self._can_apply(a, facts)]

    def _can_apply(self, action: Action, facts: dict[int, list]) -> bool:
        for atom in action.atoms:
            if atom.pred in self.task.static and not any(all(not isinstance(t, Const) or t.value == x for t, x in zip(atom.args, args)) for args in facts.get(atom.pred, ())):
                return False
        return not any(p in facts for p in action.absent)

    def initial(self) -> DataFrame:
        atoms = sorted({(p, tuple(a)) for p, a in self.task.init if p not in self.task.static})
        row = (0, [(p, list(a)) for p, a in atoms], len(self.task.objects))
        return self.spark.createDataFrame([row], f"state long, atoms {ATOMS}, n_objects int").withColumn("atoms", F.array_sort("atoms"))

    # --- goals ---------------------------------------------------------------------------------------------------

    def static_goal_holds(self) -> bool:
        facts = {(p, tuple(a)) for p, a in self.task.init}
        return all(((g.pred, tuple(t.value for t in g.args)) in facts) != g.negated for g in self.task.goal if g.pred in self.task.static)

    def unsatisfied(self) -> list[Column]:
        """One boolean column per fluent goal literal, true where it doesn't hold."""
        out = []
        for g in self.task.goal:
            if g.pred not in self.task.static:
                holds = F.array_contains("atoms", literal_atom(g))
                out.append(holds if g.negated else ~holds)
        return out

    def goal_count(self) -> Column:
        return sum((c.cast("int") for c in self.unsatisfied()), F.lit(0))

    def is_goal(self) -> Column:
        return ~reduce(Column.__or__, self.unsatisfied(), F.lit(False))

    # --- applicable actions --------------------------------------------------------------------------------------

    def facts(self, states: DataFrame) -> DataFrame:
        return states.select("state", F.explode("atoms").alias("x")).select("state", F.col("x.p").alias("p"), F.col("x.a").alias("a"))

    def _scan(self, facts: DataFrame, atom, key) -> cq.Input:
        rows = facts.where(F.col("p") == atom.pred).select(*([key] if key else []), *[F.get("a", F.lit(k)).alias(f"x{k}") for k in range(len(atom.args))])
        frame = cq.scan(rows, atom.args, [f"x{k}" for k in range(len(atom.args))], key)
        return cq.Input(frame.distinct() if len(atom.variables) < len(atom.args) else frame, atom.variables)

    def bindings(self, action: Action, states: DataFrame, facts: DataFrame) -> DataFrame:
        """(state, v0..): the bindings of one action in all states."""
        guard = F.lit(True)
        inputs = []
        for atom in action.atoms:
            fluent = atom.pred not in self.task.static
            if not atom.variables:
                if fluent:  # a membership test; static ones held when compiled
                    guard = guard & F.array_contains("atoms", literal_atom(atom))
            else:
                inputs.append(self._scan(facts if fluent else self.static, atom, cq.STATE if fluent else None))
        for p in action.absent:
            guard = guard & ~F.array_contains("atoms", literal_atom(Atom(p, ())))
        open_states = states.where(guard).select("state")
        if not inputs:
            frame, _ = cq.filtered(open_states, action.comparisons)
            return frame
        keyed = any(i.keyed for i in inputs)
        frame = cq.evaluate(action.query(), inputs, self.generator, **self.options)
        return frame.join(open_states, "state", "left_semi") if keyed else open_states.crossJoin(frame)

    def transitions(self, states: DataFrame) -> DataFrame:
        """(state, op, binding, cost, adds, deletes, n_new): every applicable action of every state. One row per distinct effect under yannakakis."""
        facts = self.facts(states)
        sizes = states.select("state", "n_objects")
        parts = []
        for k, action in enumerate(self.actions):
            frame = self.bindings(action, states, facts)
            if action.fresh:
                frame = frame.join(sizes, "state")
            fresh = {v: n for n, v in enumerate(action.fresh)}
            offset = F.col("n_objects") if action.fresh else None
            binding = F.array(*[F.col(f"v{i}") for i in range(action.arity)]).cast("array<int>") if action.arity else F.array().cast("array<int>")
            effects = [F.array(*[literal_atom(e, offset, fresh) for e in es]).cast(ATOMS) if es else F.array().cast(ATOMS) for es in (action.adds, action.deletes)]
            parts.append(frame.select("state", F.lit(k).alias("op"), binding.alias("binding"), F.lit(action.cost).alias("cost"), effects[0].alias("adds"), effects[1].alias("deletes"), F.lit(len(action.fresh)).alias("n_new")))
        if not parts:
            return self.spark.createDataFrame([], f"state long, op int, binding array<int>, cost int, adds {ATOMS}, deletes {ATOMS}, n_new int")
        return reduce(DataFrame.unionByName, parts)

    def successors(self, states: DataFrame) -> DataFrame:
        """(parent, op, binding, cost, atoms, n_objects, added): deletes first, then adds; added has the atoms that are new."""
        moves = self.transitions(states).join(states.select("state", "atoms", "n_objects"), "state")
        after = F.array_sort(F.array_union(F.array_except("atoms", "deletes"), "adds"))
        return moves.select(F.col("state").alias("parent"), "op", "binding", "cost", after.alias("atoms"), (F.col("n_objects") + F.col("n_new")).alias("n_objects"), F.array_except("adds", "atoms").alias("added"))

    def describe(self, op: int, binding: list[int]) -> str:
        """(name objects), and after a semicolon the new objects that the action makes, if any."""
        action = self.actions[op]
        names = [self.task.objects[b] if b is not None and b < len(self.task.objects) else f"@new-obj-{b}" for b in binding]
        made = f" ;[created objects: {', '.join(f'v{v.index} -> @new-obj' for v in action.fresh)}]" if action.fresh else ""
        return f"({' '.join([action.name, *names])}){made}"
