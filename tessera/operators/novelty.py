"""First-occurrence analytics: is an atom, or a pair of atoms, new within its partition?

Order is given by a sequence column. Within one batch the first occurrence is a grouped minimum, which combines before its
shuffle; across batches a table of what was seen so far is anti-joined and extended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GOAL, NEW_ATOM, NEW_PAIR, NOT_NOVEL = 0, 1, 2, 3


def first_occurrence(rows: DataFrame, atom: list[str], seq: str, partition: tuple[str, ...] = ()) -> DataFrame:
    """rows with is_new: whether the row is the first of its atom in its partition."""
    keys = [*partition, *atom]
    first = rows.groupBy(*keys).agg(F.min(seq).alias("first_seq")).alias("f")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return rows.alias("o").join(first, same).select("o.*", (F.col(f"o.{seq}") == F.col("f.first_seq")).alias("is_new"))


def atoms_of(states: DataFrame, n_objects: int | None = None, column: str = "atoms") -> DataFrame:
    """(state, seq, r, g, x): a state's atoms; those that mention objects created later are left out."""
    out = states.select("state", "seq", "r", "g", F.explode(column).alias("x"))
    return out if n_objects is None else out.where(F.forall("x.a", lambda v: v < n_objects))


def pairs_of(atoms: DataFrame, with_atoms: DataFrame) -> DataFrame:
    """(state, seq, r, g, x): unordered pairs of an atom of `atoms` and one of `with_atoms` of the same state."""
    a, b = atoms.select("state", "seq", "r", "g", F.col("x").alias("x1")), with_atoms.select("state", F.col("x").alias("x2"))
    met = a.join(b, "state").where(F.col("x1") != F.col("x2"))
    return met.select("state", "seq", "r", "g", F.array_sort(F.array("x1", "x2")).alias("x")).distinct()


class Novelty:
    """novelty(states) in batches; states: (state, seq, r, g, atoms, added, done, same). Width 1 or 2.

    Where `same` holds, r and g are those of the parent, all of whose atoms were seen in this partition: only the added ones can
    be new. Elsewhere all atoms of the state are looked at."""

    def __init__(self, tables, width: int, n_objects: int):
        self.tables, self.width, self.n_objects = tables, width, n_objects
        self.seen: dict[int, DataFrame | None] = {1: None, 2: None}
        self.turn = 0

    def _new(self, items: DataFrame, width: int) -> DataFrame:
        """States that hold an item first; the items seen are extended."""
        firsts = items.groupBy("r", "g", "x").agg(F.min(F.struct("seq", "state")).alias("by"))
        if self.seen[width] is not None:
            firsts = firsts.join(self.seen[width], ["r", "g", "x"], "left_anti")
        firsts = self.tables.keep(firsts)
        self.seen[width] = self.tables.append(f"seen{width}", firsts.select("r", "g", "x"), self.turn)
        return firsts.select(F.col("by.state").alias("state")).distinct()

    def novelty(self, states: DataFrame) -> DataFrame:
        """(state, w): 0 for goals, 1 with a new atom, 2 with a new pair (width 2), else 3."""
        everything = atoms_of(states, self.n_objects)
        self.turn += 1
        atoms = atoms_of(states.withColumn("atoms", F.when(F.col("same"), F.col("added")).otherwise(F.col("atoms"))), self.n_objects)
        out = states.select("state", "done").join(self._new(atoms, 1).withColumn("n1", F.lit(True)), "state", "left")
        if self.width == 2:
            out = out.join(self._new(pairs_of(atoms, everything), 2).withColumn("n2", F.lit(True)), "state", "left")
        else:
            out = out.withColumn("n2", F.lit(None).cast("boolean"))
        return out.select("state", F.when(F.col("done"), GOAL).when(F.col("n1"), NEW_ATOM).when(F.col("n2"), NEW_PAIR).otherwise(NOT_NOVEL).alias("w"))
