"""A normalised task as tables, the lifted form to store and read again.

save() writes types, predicates, objects, facts, goal and actions as Parquet; load() gives the same task back. Terms are (kind, value)
pairs: a variable's index, an object's number. The facts are a table of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ir import Action, Atom, Comparison, Const, Task, Var

TERM = "struct<var: boolean, value: int>"
ATOM = f"struct<p: int, args: array<{TERM}>, negated: boolean>"
SCHEMAS = {
    "types": "type string, parent string, predicate int",
    "predicates": "p int, name string, arity int, static boolean",
    "objects": "o int, name string, type string",
    "facts": "k long, p int, a array<int>",
    "goal": f"k int, atom {ATOM}",
    "actions": f"k int, name string, arity int, atoms array<{ATOM}>, absent array<int>, comparisons array<struct<left: {TERM}, right: {TERM}, equal: boolean>>, adds array<{ATOM}>, deletes array<{ATOM}>, cost int, fresh array<int>",
}


def _term(t) -> tuple:
    return (True, t.index) if isinstance(t, Var) else (False, t.value)


def _atom(x: Atom) -> tuple:
    return x.pred, [_term(t) for t in x.args], x.negated


def task_tables(spark: SparkSession, task: Task) -> dict[str, DataFrame]:
    rows = {
        "types": [(t, parent, task.type_predicates.get(t)) for t, parent in task.types.items()],
        "predicates": [(p, name, n, p in task.static) for p, (name, n) in enumerate(zip(task.predicates, task.arities))],
        "objects": [(k, name, task.object_types.get(name)) for k, name in enumerate(task.objects)],
        "facts": [(k, p, list(a)) for k, (p, a) in enumerate(task.init)],
        "goal": [(k, _atom(x)) for k, x in enumerate(task.goal)],
        "actions": [
            (k, a.name, a.arity, [_atom(x) for x in a.atoms], list(a.absent), [(_term(c.left), _term(c.right), c.equal) for c in a.comparisons], [_atom(x) for x in a.adds], [_atom(x) for x in a.deletes], a.cost, [v.index for v in a.fresh])
            for k, a in enumerate(task.actions)
        ],
    }
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()}


def save(spark: SparkSession, task: Task, path: str) -> None:
    for name, frame in task_tables(spark, task).items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Task:
    """The task that save() wrote; facts are read in their order, as a task holds them."""
    read = lambda name, key=None: (lambda f: f.orderBy(key) if key else f)(spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")).collect()
    term = lambda t: Var(t["value"]) if t["var"] else Const(t["value"])
    atom = lambda x: Atom(x["p"], tuple(map(term, x["args"])), x["negated"])
    types, preds, objects = read("types"), read("predicates", "p"), read("objects", "o")
    actions = [
        Action(
            r["name"], r["arity"], tuple(map(atom, r["atoms"])), tuple(r["absent"]), tuple(Comparison(term(c["left"]), term(c["right"]), c["equal"]) for c in r["comparisons"]),
            tuple(map(atom, r["adds"])), tuple(map(atom, r["deletes"])), r["cost"], tuple(map(Var, r["fresh"])),
        )
        for r in read("actions", "k")
    ]
    return Task(
        [r["name"] for r in preds], [r["arity"] for r in preds], [r["name"] for r in objects], {r["type"]: r["parent"] for r in types}, {r["name"]: r["type"] for r in objects},
        {r["p"] for r in preds if r["static"]}, [(r["p"], tuple(r["a"])) for r in read("facts", "k")], [atom(r["atom"]) for r in read("goal", "k")], actions, {r["type"]: r["predicate"] for r in types if r["predicate"] is not None},
    )


def ground_state(spark: SparkSession, task: Task, candidates: DataFrame) -> DataFrame:
    """(p, a, holds): every fact that the candidates (p, place, o) of each argument allow, and whether it holds at first. Predicates of arity
    two at most stay small by this; a wider one is the product of its places' candidates."""
    facts = task_tables(spark, task)["facts"].select("p", "a").distinct()
    out = None
    for p, n in enumerate(task.arities):
        if p in task.static:
            continue
        rows = spark.range(1).select(F.array().cast("array<int>").alias("a"))
        for k in range(n):
            place = candidates.where((F.col("p") == p) & (F.col("place") == k)).select("o")
            rows = rows.crossJoin(place).select(F.concat("a", F.array("o")).alias("a"))
        if n == 0 and candidates.where((F.col("p") == p) & F.col("place").isNull()).isEmpty():
            rows = rows.limit(0)
        rows = rows.select(F.lit(p).alias("p"), "a")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return facts.limit(0).withColumn("holds", F.lit(True))
    return out.join(facts.withColumn("held", F.lit(True)), ["p", "a"], "left").select("p", "a", F.col("held").isNotNull().alias("holds"))
