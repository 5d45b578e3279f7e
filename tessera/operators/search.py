"""Iterated queries over a growing table of states: breadth-first, best-first, lazy, width-based.

One round takes the best open rows (all of a layer for bfs, up to `batch` otherwise; 1 gives the node-by-node order),
expands them in one query, looks the successors up among the states known so far, evaluates what is new as a batch and appends it.
Known states and the open rows live in the shared folder, one partition a round under one path, so that plans don't grow with the
rounds; the driver sees counts, the best keys and the plan. A state reached again by a cheaper path gets a second row with that
path and, in gbfs and astar, is opened again: its least row counts.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ir import Task
from ..scratch import Tables
from .datalog import Heuristic
from .novelty import NOT_NOVEL, Novelty
from .states import ATOMS, StateSpace

#: Exit codes of a search.
PLAN_FOUND, UNSOLVABLE, INCOMPLETE, OUT_OF_TIME, BAD_INPUT, UNSUPPORTED = 0, 11, 12, 23, 33, 34
#: What a queue of preferred states gains when the search makes progress.
BOOST = 1000

#: The names of the searches. name -> (kind, options).
SEARCHES = {
    "bfs": ("bfs", {}), "gbfs": ("best", {"key": "gbfs", "reopen": True}), "astar": ("best", {"key": "astar", "reopen": True}),
    "lazy": ("lazy", {}), "lazy-po": ("lazy", {"preferred": "order"}), "lazy-prune": ("lazy", {"preferred": "prune"}),
    "bfws1": ("width", {"width": 1}), "bfws2": ("width", {"width": 2}), "bfws1-rx": ("width", {"width": 1, "relevant": True}), "bfws2-rx": ("width", {"width": 2, "relevant": True}),
    "iw1": ("width", {"width": 1, "prune": True, "goals": False}), "iw2": ("width", {"width": 2, "prune": True, "goals": False}), "iw1gc": ("width", {"width": 1, "prune": True}), "iw2gc": ("width", {"width": 2, "prune": True}),
    "dq-bfws1-rx": ("width", {"width": 1, "relevant": True, "preferred": "init"}), "dq-bfws2-rx": ("width", {"width": 2, "relevant": True, "preferred": "init"}),
    "alt-bfws1": ("width", {"width": 1, "relevant": True, "alternate": True}), "alt-bfws2": ("width", {"width": 2, "relevant": True, "alternate": True}),
}
#: What goes with object creation.
CREATION = {"search": {"astar", "bfs", "bfws1", "bfws2", "iw1", "iw2", "gbfs", "lazy"}, "evaluator": {"blind", "goalcount"}, "generator": {"full_reducer", "join", "ordered_join", "random_join", "yannakakis"}}


def _none() -> Column:
    return F.array().cast(ATOMS)


@dataclass
class Result:
    code: int
    plan: list[str] = field(default_factory=list)
    steps: list[tuple[int, list[int]]] = field(default_factory=list)
    cost: int | None = None
    statistics: dict = field(default_factory=dict)

    @property
    def lines(self) -> list[str]:
        return [f"{k}: {s}" for k, s in enumerate(self.plan)] + [f"; cost = {self.cost}"]


class Search:
    def __init__(self, spark: SparkSession, task: Task, search: str = "bfs", evaluator: str = "blind", generator: str = "yannakakis", batch: int = 64, seed: int = 1, time_limit: float = 1800):
        if search not in SEARCHES:
            raise ValueError(f"unknown search {search}")
        self.spark, self.task, self.name, self.batch, self.deadline = spark, task, search, batch, time.time() + time_limit
        self.kind, self.options = SEARCHES[search]
        self.unsupported = any(a.fresh for a in task.actions) and not (search in CREATION["search"] and evaluator in CREATION["evaluator"] and generator in CREATION["generator"])
        self.space = StateSpace(spark, task, generator, seed)
        self.tables = Tables(spark, "search")
        if self.options.get("alternate") and evaluator in ("blind", "goalcount"):
            raise ValueError("this search needs add, hmax, ff or rff")
        self.heuristic = Heuristic(self.space, evaluator) if self.kind in ("best", "lazy") or self.options.get("alternate") else None
        self.counts = {"expanded": 0, "reopened": 0, "generated": 0, "evaluated": 0, "dead_ends": 0, "pruned": 0, "jumps": []}
        self.best, self.turn, self.priority = None, 0, {True: BOOST if self.options.get("preferred") == "init" else 0, False: 0}

    # --- shared steps --------------------------------------------------------------------------------------------

    def _root(self) -> DataFrame:
        return self.space.initial().select("*", F.lit(-1).cast("long").alias("parent"), F.lit(-1).alias("op"), F.array().cast("array<int>").alias("binding"), F.lit(0).alias("g"), F.col("atoms").alias("added"), F.lit(0).cast("long").alias("seq"))

    def _known(self, rows: DataFrame) -> DataFrame:
        """Append rows to the states known; all of them are returned, a state's cheaper paths as further rows."""
        return self.tables.append("known", rows.select("state", "atoms", "n_objects", "parent", "op", "binding", "g"), self.turn)

    def _moves(self, states: DataFrame, *extra: str) -> DataFrame:
        """Successors, one row per database: of the cheapest, then least (parent's place, action, binding). extra: columns taken over from the parent."""
        carried = states.select(F.col("state").alias("parent"), F.col("g").alias("pg"), F.col("seq").alias("pseq"), *extra)
        moves = self.space.successors(states).join(carried, "parent").withColumn("g", (F.col("pg") + F.col("cost")).cast("int"))
        least = F.struct(*(["g"] if self.kind != "bfs" else []), "pseq", "op", "binding", "parent", *(["g"] if self.kind == "bfs" else []), "added", *extra)
        return moves.groupBy("atoms", "n_objects").agg(F.min(least).alias("m")).select("atoms", "n_objects", "m.*")

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """rows with a state number each: numbers grow with the round, then the range partition of a sort, then the place within it."""
        numbered = rows.orderBy("pseq", "op", "binding").withColumn("state", F.lit(self.turn).cast("long") * (1 << 50) + F.monotonically_increasing_id())
        return numbered.withColumn("seq", F.col("state"))

    def _looked_up(self, moves: DataFrame, known: DataFrame) -> DataFrame:
        """moves with the number and the least g so far of the state that they lead to; null if it is new."""
        met = known.select("atoms", "n_objects", F.col("state").alias("old"), F.col("g").alias("old_g"))
        least = moves.select("atoms", "n_objects").join(met, ["atoms", "n_objects"]).groupBy("atoms", "n_objects").agg(F.min("old").alias("old"), F.min("old_g").alias("old_g"))
        return moves.join(least, ["atoms", "n_objects"], "left")

    def _plan(self, goal_state: int) -> Result:
        """Parents back to the root, each state by its cheapest row; a step reads the rows of one state."""
        known = self.tables.appended("known")
        steps, at = [], goal_state
        while at:
            row = known.where(F.col("state") == at).orderBy("g").select("parent", "op", "binding").first()
            steps.append((row["op"], list(row["binding"])))
            at = row["parent"]
        steps.reverse()
        return Result(PLAN_FOUND, [self.space.describe(*s) for s in steps], steps, sum(self.space.actions[op].cost for op, _ in steps), self.counts)

    def run(self) -> Result:
        if self.unsupported:
            return Result(UNSUPPORTED)
        if not self.space.static_goal_holds():
            return Result(UNSOLVABLE)
        first = self.tables.keep(self._root())
        if not first.where(self.space.is_goal()).isEmpty():
            return Result(PLAN_FOUND, cost=0, statistics=self.counts)
        return {"bfs": self._breadth, "lazy": self._lazy}.get(self.kind, self._best_first)(first)

    def _late(self) -> bool:
        return time.time() > self.deadline

    def _progress(self, value) -> bool:
        """Whether value is the best so far; each such jump is listed."""
        if value is None or (self.best is not None and value >= self.best):
            return False
        self.best = value
        self.counts["jumps"].append((value, self.counts["expanded"], self.counts["evaluated"], self.counts["generated"]))
        return True

    # --- breadth-first ---------------------------------------------------------------------------------------------

    def _breadth(self, layer: DataFrame) -> Result:
        known, size = self._known(layer), 1
        while True:
            if self._late():
                return Result(OUT_OF_TIME, statistics=self.counts)
            self.turn += 1
            new = self._looked_up(self._moves(layer), known).where("old is null").drop("old", "old_g")
            new = self.tables.keep(self._numbered(new))
            n, goal = new.agg(F.count("*"), F.min(F.when(self.space.is_goal(), F.col("state")))).first()
            self.counts["expanded"] += size
            self.counts["generated"] += n
            known = self._known(new)
            if goal is not None:
                return self._plan(goal)
            if not n:
                return Result(UNSOLVABLE, statistics=self.counts)
            layer, size = new, n

    # --- best-first ------------------------------------------------------------------------------------------------

    def _useful(self, states: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(state, h) and (state, useful): the atoms that the actions on each state's relaxed plan add."""
        heuristic = self.heuristic if self.heuristic is not None and self.heuristic.name in ("ff", "rff") else Heuristic(self.space, "ff")
        h, facts = heuristic.evaluate_with_useful(states)
        if heuristic is not self.heuristic and self.heuristic is not None:
            h = self.heuristic.evaluate(states)
        return h, facts.where("why.op >= 0").groupBy("state").agg(F.collect_set(F.struct("p", "a")).cast(ATOMS).alias("useful"))

    def _of_root(self, first: DataFrame) -> Column:
        """The useful atoms of the first state as a literal: bounded by one plan."""
        row = self._useful(first)[1].first()
        if row is None:
            return _none()
        return F.array(*[F.expr(f"named_struct('p', {x.p}, 'a', cast(array({', '.join(map(str, x.a))}) as array<int>))") for x in sorted(row.useful)]).cast(ATOMS)

    def _judged(self, states: DataFrame) -> DataFrame:
        """states (with pr, pgc of their parents) with gc, r, done, h, w, preferred."""
        o = self.options
        out = states.withColumn("gc", self.space.goal_count() if o.get("goals", True) else F.lit(0)).withColumn("done", self.space.is_goal())
        out = out.withColumn("r", F.size(F.array_except(self.relevant, F.col("atoms"))) if o.get("relevant") else F.lit(0))
        if o.get("preferred") == "init":
            out = out.withColumn("preferred", F.arrays_overlap(self.relevant, F.col("atoms")))
        elif "preferred" not in out.columns:
            out = out.withColumn("preferred", F.lit(False))
        if self.kind == "width":
            kept = self.tables.keep(out)
            same = F.coalesce((F.col("r") == F.col("pr")) & (F.col("gc") == F.col("pgc")), F.lit(False))
            w = self.novelty.novelty(kept.select("state", "seq", "r", F.col("gc").alias("g"), "atoms", "added", "done", same.alias("same")))
            return (kept if "h" in kept.columns else kept.withColumn("h", F.lit(0))).join(w, "state")
        return out.join(self.heuristic.evaluate(states), "state").withColumn("w", F.lit(0))

    def _keys(self, by_h: bool) -> list:
        key = self.options.get("key")
        if key == "astar":
            return [F.col("h") + F.col("g"), "h", "seq"]
        return ["h", "g", "seq"] if key == "gbfs" or by_h else ["w", "gc", "g", "seq"]

    def _taken(self, opened: DataFrame) -> DataFrame:
        """The best rows of the queue whose turn it is."""
        by_h = bool(self.options.get("alternate")) and self.turn % 2 == 0
        dual = self.options.get("alternate") or self.options.get("preferred") in ("init", "order")
        ahead = self.priority[True] > self.priority[False] if self.kind == "width" else self.priority[True] >= self.priority[False]
        keys = ["ph", "g", "seq"] if self.kind == "lazy" else self._keys(by_h)
        for preferred in ((True, False) if dual and ahead else (False,)):
            take = self.tables.keep((opened.where("preferred") if preferred else opened).orderBy(*keys).limit(self.batch))
            n = take.count()
            if n:
                self.priority[preferred] -= n if dual else 0
                return take
        return take

    def _best_first(self, first: DataFrame) -> Result:
        o = self.options
        self.novelty = Novelty(self.tables, o.get("width", 1), len(self.task.objects))
        self.relevant = self._of_root(first) if o.get("relevant") else _none()
        known = self._known(first)
        judged = self._judged(first.select("*", F.lit(-1).alias("pr"), F.lit(-1).alias("pgc")))
        opened, pruned, goal = self.tables.keep(judged.where("h is not null")), False, None
        self.counts["evaluated"] += 1
        while True:
            if self._late():
                return Result(OUT_OF_TIME, statistics=self.counts)
            self.turn += 1
            take = self._taken(opened)
            done, n, least_f, least = take.agg(F.min(F.when(F.col("done"), F.struct("g", "seq", "state"))), F.count("*"), F.min(F.col("g") + F.col("h")), F.min("h" if self.kind == "best" else "gc")).first()
            if not n:
                return self._plan(goal[1]) if goal else Result(INCOMPLETE if pruned else UNSOLVABLE, statistics=self.counts)
            if o.get("key") == "astar":
                if goal and goal[0] <= least_f:  # no open state has a smaller f
                    return self._plan(goal[1])
            elif done is not None:
                return self._plan(done["state"])
            self.counts["expanded"] += n
            progress = self._progress(least)
            rest = opened.join(take.select("state"), "state", "left_anti")
            carried = ["r", "gc"]
            if o.get("alternate"):  # h and the useful atoms are computed on expansion, and the children take them over
                h, useful = self._useful(take)
                take = self.tables.keep(take.drop("h").join(h, "state").join(useful, "state", "left").withColumn("useful", F.coalesce("useful", _none())).where("h is not null"))
                alive, least = take.agg(F.count("*"), F.min("h")).first()
                self.counts["evaluated"] += n
                self.counts["dead_ends"] += n - alive
                progress = self._progress(least)
                carried += ["h", "useful"]
            if progress and (o.get("alternate") or o.get("preferred")):
                self.priority[True] += BOOST
            moves = self._looked_up(self._moves(take, *carried), known).withColumnsRenamed({"r": "pr", "gc": "pgc"})
            if o.get("alternate"):
                moves = moves.withColumn("preferred", F.arrays_overlap("useful", "atoms")).drop("useful")
            moves = self.tables.keep(moves)
            new = self.tables.keep(self._numbered(moves.where("old is null").drop("old", "old_g")))
            made = new.count()
            self.counts["generated"] += made
            if made:
                self._known(new)
                judged = self.tables.keep(self._judged(new))
                if self.kind == "best":
                    self.tables.append("values", judged.select("state", "h", "done", "gc"), self.turn)
                live = judged.where("h is not null")
                if o.get("prune"):
                    live = live.where(F.col("w") != NOT_NOVEL)
                alive = live.count()
                lost = made - alive
                pruned |= bool(lost and o.get("prune"))
                self.counts["pruned" if o.get("prune") else "dead_ends"] += lost
                self.counts["evaluated"] += made
                rest = rest.unionByName(live.select(*rest.columns))
            if o.get("reopen"):
                cheaper = self.tables.keep(moves.where("g < old_g").withColumn("state", F.col("old")))
                again = cheaper.count()
                if again:
                    self._known(cheaper)
                    self.counts["reopened"] += again
                    values = self.tables.appended("values")  # of all but the first state, which no path improves
                    back = cheaper.join(values, "state").where("h is not null").withColumns({"seq": F.col("state"), "r": F.lit(0), "preferred": F.lit(False), "w": F.lit(0)})
                    rest = rest.join(cheaper.select("state"), "state", "left_anti").unionByName(back.select(*rest.columns))
            known = self.tables.appended("known")
            opened = self.tables.keep(rest)
            if o.get("key") == "astar":
                found = opened.where("done").agg(F.min(F.struct("g", "state"))).first()[0]
                goal = (found["g"], found["state"]) if found is not None and (goal is None or found["g"] < goal[0]) else goal

    # --- lazy ------------------------------------------------------------------------------------------------------

    def _lazy(self, first: DataFrame) -> Result:
        """Open rows are moves, ordered by the h of the state that they leave; a state is evaluated when it is taken."""
        preferred = self.options.get("preferred")
        opened = self.tables.keep(first.drop("state").select("*", F.lit(0).alias("ph"), F.lit(True).alias("preferred")))
        known, pruned = None, False
        while True:
            if self._late():
                return Result(OUT_OF_TIME, statistics=self.counts)
            take = self._taken(opened)
            if take.isEmpty():
                return Result(INCOMPLETE if pruned else UNSOLVABLE, statistics=self.counts)
            rest = opened.join(take.select("seq"), "seq", "left_anti")
            fresh = take.groupBy("atoms", "n_objects").agg(F.min(F.struct("ph", "g", "seq", "parent", "op", "binding", "added")).alias("m")).select("atoms", "n_objects", "m.*")
            if known is not None:
                fresh = fresh.join(known, ["atoms", "n_objects"], "left_anti")
            # The root is state 0, any other state's number is that of the move that led to it.
            fresh = self.tables.keep(fresh.withColumn("state", F.col("seq")))
            n = fresh.count()
            if n:
                known = self._known(fresh)
                if preferred:
                    h, useful = self._useful(fresh)
                    judged = fresh.join(h, "state").join(useful, "state", "left").withColumn("useful", F.coalesce("useful", _none()))
                else:
                    judged = fresh.join(self.heuristic.evaluate(fresh), "state").withColumn("useful", _none())
                judged = self.tables.keep(judged.withColumn("done", self.space.is_goal()).where("h is not null"))
                alive, least, goal = judged.agg(F.count("*"), F.min("h"), F.min(F.when(F.col("done"), F.struct("ph", "g", "seq")))).first()
                self.counts["evaluated"] += n
                self.counts["dead_ends"] += n - alive
                if goal is not None:
                    return self._plan(goal["seq"])
                self.counts["expanded"] += alive
                if self._progress(least):
                    self.priority[True] += BOOST
                self.turn += 1
                moves = self._moves(judged, "h", "useful").withColumnRenamed("h", "ph")
                moves = moves.withColumn("preferred", F.arrays_overlap("useful", "atoms") if preferred else F.lit(True)).drop("useful")
                moves = self.tables.keep(self._numbered(moves).drop("state", "pseq"))
                made = moves.count()
                self.counts["generated"] += made
                if preferred == "prune":
                    live = moves.where("preferred")
                    lost = made - live.count()
                    self.counts["pruned"] += lost
                    pruned |= bool(lost)
                    moves = live
                rest = rest.unionByName(moves.select(*rest.columns))
            opened = self.tables.keep(rest)


def solve(spark: SparkSession, task: Task, **options) -> Result:
    return Search(spark, task, **options).run()


def validate(spark: SparkSession, task: Task, steps: list[tuple[int, list[int]]], generator: str = "join") -> bool:
    """Apply a plan's steps one by one and test the goal."""
    space = StateSpace(spark, task, generator)
    state = space.initial()
    for op, binding in steps:
        nxt = space.successors(state).where((F.col("op") == op) & (F.col("binding") == F.array(*map(F.lit, binding)).cast("array<int>"))).limit(1)
        rows = nxt.select("atoms", "n_objects").collect()
        if not rows:
            return False
        state = spark.createDataFrame([(0, rows[0]["atoms"], rows[0]["n_objects"])], state.schema)
    return not state.where(space.is_goal()).isEmpty()


def portfolio(spark: SparkSession, task: Task, configurations: list[tuple[dict, float]], time_limit: float = 1800) -> Result:
    """Configurations in turn; the first plan wins. Each has its share of what is left, so that time not used goes to the later ones."""
    until, result = time.time() + time_limit, Result(UNSOLVABLE)
    for k, (options, share) in enumerate(configurations):
        left = until - time.time()
        result = solve(spark, task, **options, time_limit=left * share / sum(s for _, s in configurations[k:]))
        result.statistics["configuration"] = k + 1
        if result.code == PLAN_FOUND or left <= 0:
            break
    return result
