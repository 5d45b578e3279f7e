"""Conjunctive queries as DataFrame expressions: ear removal, full reducer, join trees with early witness projection.

Inputs are DataFrames, one per atom, whose columns are variables (v0, v1, ...) and, for facts that depend on a state, the
key column `state`. Ears are found on the query without the state; the state then is one more join column between inputs that both carry
it. Catalyst picks the physical joins; what is planned here is what it has no rule for.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ir import Comparison, Const, Query, Var

STATE = "state"


@dataclass
class Input:
    """A scanned atom."""

    frame: DataFrame
    variables: frozenset

    @property
    def keyed(self) -> bool:
        return STATE in self.frame.columns


def shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def natural_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on all shared columns; a product where there is none."""
    on = shared(a, b)
    return a.join(b, on) if on else a.crossJoin(b)


def semi_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a with a partner in b; a as it is where no column is shared."""
    on = shared(a, b)
    return a.join(b.select(*on), on, "left_semi") if on else a


def witness(frame: DataFrame, over: list[str]) -> DataFrame:
    """One row per distinct key over `over`: the least of the others. All columns stay. An empty key keeps one row."""
    rest = [c for c in frame.columns if c not in over]
    if not rest:
        return frame.distinct()
    least = F.min(F.struct(*rest)).alias("w")
    grouped = frame.groupBy(*over).agg(least) if over else frame.agg(least).where("w is not null")
    return grouped.select(*over, *[F.col("w")[c].alias(c) for c in rest]).select(*frame.columns)


def scan(facts: DataFrame, terms: tuple, columns: list[str], key: str | None = None) -> DataFrame:
    """Select rows whose constants match and repeated variables agree; project to one column per variable."""
    first: dict[Var, str] = {}
    tests: list[Column] = []
    for t, c in zip(terms, columns):
        if isinstance(t, Const):
            tests.append(F.col(c) == t.value)
        elif t in first:
            tests.append(F.col(c) == F.col(first[t]))
        else:
            first[t] = c
    if tests:
        facts = facts.where(reduce(Column.__and__, tests))
    return facts.select(*([key] if key else []), *[F.col(c).alias(v.column) for v, c in first.items()])


def compare(c: Comparison) -> Column:
    left, right = (F.col(x.column) if isinstance(x, Var) else F.lit(x.value) for x in (c.left, c.right))
    return left == right if c.equal else left != right


def filtered(frame: DataFrame, comparisons) -> tuple[DataFrame, tuple]:
    """Apply the comparisons whose variables are all bound; return the rest."""
    bound = set(frame.columns)
    now = [c for c in comparisons if all(v.column in bound for v in c.variables)]
    for c in now:
        frame = frame.where(compare(c))
    return frame, tuple(c for c in comparisons if c not in now)


def _join_all(inputs: list[Input], comparisons) -> DataFrame:
    frame, left = filtered(inputs[0].frame, comparisons)
    for nxt in inputs[1:]:
        frame, left = filtered(natural_join(frame, nxt.frame), left)
    return frame


def ears(edges: list[frozenset]) -> tuple[list[tuple[int, int]], list[int]]:
    """Ear removal: (ear, its witness edge) in order of removal, and the edges that are left. One left: acyclic."""
    alive, removed = list(range(len(edges))), []
    changed = True
    while changed and len(alive) > 1:
        changed = False
        for i in alive:
            others = frozenset().union(*(edges[k] for k in alive if k != i))
            outer = edges[i] & others
            host = next((j for j in alive if j != i and outer <= edges[j]), None)
            if host is not None:
                removed.append((i, host))
                alive.remove(i)
                changed = True
                break
    return removed, alive


def stated_order(inputs, comparisons, query):
    return _join_all(inputs, comparisons)


def by_arity(inputs, comparisons, query):
    return _join_all(sorted(inputs, key=lambda i: len(i.variables)), comparisons)


def by_arity_descending(inputs, comparisons, query):
    return _join_all(sorted(inputs, key=lambda i: -len(i.variables)), comparisons)


def random_order(inputs, comparisons, query, seed: int = 1):
    inputs = list(inputs)
    random.Random(seed).shuffle(inputs)
    return _join_all(inputs, comparisons)


def reduced(inputs: list[Input], tables=None) -> tuple[list[Input], list[tuple[int, int]], list[int]]:
    """Semi-join programme up the ears and down again: no dangling rows are left in an acyclic query.

    With tables (a scratch.Tables) the distinct keys of each semi-join are written and read back: an input then is its own scan filtered by
    key tables, whatever the length of the chain, and is scanned three times at most. Without, plans nest; for small inputs."""
    removed, alive = ears([i.variables for i in inputs])
    out = [i.frame for i in inputs]

    def filtered_by(frame: DataFrame, other: DataFrame) -> DataFrame:
        on = shared(frame, other)
        if tables is None or not on:
            return semi_join(frame, other)
        return semi_join(frame, tables.keep(other.select(*on).distinct()))

    for ear, host in removed:
        out[host] = filtered_by(out[host], out[ear])
    for ear, host in reversed(removed):
        out[ear] = filtered_by(out[ear], out[host])
    return [Input(f, i.variables) for f, i in zip(out, inputs)], removed, alive


def full_reducer(inputs, comparisons, query, tables=None):
    """Reduce, then join from the root (or the cyclic rest, widest first) outwards, so that no products arise."""
    inputs, removed, alive = reduced(inputs, tables)
    order = sorted(alive, key=lambda k: -len(inputs[k].variables)) + [ear for ear, _ in reversed(removed)]
    return _join_all([inputs[k] for k in order], comparisons)


def yannakakis(inputs, comparisons, query: Query, tables=None):
    """Reduce, join bottom-up along the join tree and keep a witness of what the parent and the head need."""
    inputs, removed, alive = reduced(inputs, tables)
    frames, left = [i.frame for i in inputs], comparisons
    needed = query.distinguished | frozenset().union(frozenset(), *(c.variables for c in comparisons))
    wanted = {v.column for v in needed} | {STATE}
    for ear, host in removed:
        parent = set(frames[host].columns)
        joined, left = filtered(natural_join(frames[host], frames[ear]), left)
        over = [c for c in joined.columns if c in parent or c in wanted]
        frames[host] = witness(joined, over) if len(over) < len(joined.columns) else joined
    frame = _join_all([Input(frames[k], frozenset()) for k in sorted(alive, key=lambda k: -len(frames[k].columns))], left)
    over = [c for c in frame.columns if c in wanted]
    return witness(frame, over) if len(over) < len(frame.columns) else frame


def clique(inputs, comparisons, query: Query):
    """Bindings as k-cliques: per pair of variables the pairs that all atoms over both allow, joined, then the atoms verified."""
    variables = sorted(frozenset().union(*(i.variables for i in inputs)))
    tables: list[DataFrame] = []
    for k, v in enumerate(variables):
        for w in [None, *variables[k + 1 :]]:
            names = [v.column] + ([w.column] if w else [])
            over = [i for i in inputs if set(names) <= {x.column for x in i.variables}]
            if not over or (w is None and any({v} < i.variables for i in inputs)):
                continue
            pair = [i.frame.select(*([STATE] if i.keyed else []), *names).distinct() for i in over]
            tables.append(reduce(lambda a, b: semi_join(a, b) if STATE in a.columns or STATE not in b.columns else semi_join(b, a), pair))
    order, todo = [], tables
    while todo:  # connected ones first
        bound = set().union(*(t.columns for t in order)) if order else set()
        todo = sorted(todo, key=lambda t: -len(bound & set(t.columns)))
        order.append(todo.pop(0))
    frame = _join_all([Input(t, frozenset()) for t in order], comparisons)
    for i in inputs:  # the state comes from the first input that has it
        frame = natural_join(frame, i.frame) if i.keyed and STATE not in frame.columns else semi_join(frame, i.frame)
    return frame


GENERATORS = {
    "join": stated_order,
    "naive": stated_order,
    "ordered_join": by_arity,
    "inverse_ordered_join": by_arity_descending,
    "random_join": random_order,
    "full_reducer": full_reducer,
    "yannakakis": yannakakis,
    "clique_bk": clique,
    "clique_kckp": clique,
}


def evaluate(query: Query, inputs: list[Input], generator: str = "yannakakis", **options) -> DataFrame:
    """Rows over the query's variables (a witness each for those that don't matter, under yannakakis) and the state."""
    return GENERATORS[generator](inputs, query.comparisons, query, **options)
