"""Logical objects: atoms, conjunctive queries, actions, tasks. All live on the driver; facts live in DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True, order=True)
class Var:
    """A query variable; its column is v<index>."""

    index: int

    @property
    def column(self) -> str:
        return f"v{self.index}"


@dataclass(frozen=True, order=True)
class Const:
    """An object by number."""

    value: int


@dataclass(frozen=True)
class Atom:
    pred: int
    args: tuple  # of Var and Const
    negated: bool = False

    @property
    def variables(self) -> frozenset:
        return frozenset(a for a in self.args if isinstance(a, Var))


@dataclass(frozen=True)
class Comparison:
    """left = right or left != right."""

    left: object
    right: object
    equal: bool

    @property
    def variables(self) -> frozenset:
        return frozenset(a for a in (self.left, self.right) if isinstance(a, Var))


@dataclass(frozen=True)
class Query:
    """Positive atoms with arguments, comparisons, and the variables whose values matter."""

    atoms: tuple
    comparisons: tuple = ()
    distinguished: frozenset = frozenset()

    @property
    def variables(self) -> frozenset:
        return frozenset().union(*(a.variables for a in self.atoms)) if self.atoms else frozenset()


@dataclass(frozen=True)
class Action:
    name: str
    arity: int
    atoms: tuple  # positive preconditions, without or with arguments
    absent: tuple  # negated preconditions without arguments: predicate numbers
    comparisons: tuple
    adds: tuple
    deletes: tuple
    cost: int
    fresh: tuple = ()  # variables that stand for new objects, in order

    def query(self) -> Query:
        used = frozenset().union(frozenset(), *(a.variables for a in self.adds + self.deletes)) - frozenset(self.fresh)
        unequal = frozenset().union(frozenset(), *(c.variables for c in self.comparisons))
        return Query(tuple(a for a in self.atoms if a.args), self.comparisons, used | unequal)


@dataclass
class Task:
    predicates: list[str]
    arities: list[int]
    objects: list[str]
    types: dict[str, str]  # type -> parent; object is the root
    object_types: dict[str, str]
    static: set[int]  # predicates that no action changes
    init: list[tuple]  # (predicate, arguments)
    goal: list[Atom]
    actions: list[Action]
    type_predicates: dict[str, int] = field(default_factory=dict)

    def number(self, name: str) -> int:
        return self.predicates.index(name)
