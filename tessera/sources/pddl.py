"""PDDL front end: text to a normalised Task.

Supported: STRIPS, typing, constants, equality, disjunctive preconditions, negated preconditions without arguments,
action costs and object creation (`:new`). Names are folded to lower case. Not supported, with a clear error: derived
predicates, quantifiers, conditional effects, negated preconditions with arguments, disjunctive goals.
"""

from __future__ import annotations

import re
from itertools import product
from pathlib import Path

from ..plans.ir import Action, Atom, Comparison, Const, Task, Var


class PddlError(ValueError):
    pass


# --- text to nested lists -----------------------------------------------------------------------------------------


def tokens(text: str) -> list[str]:
    out = []
    for line in text.splitlines():
        line = line.split(";", 1)[0]
        if not line.isascii():
            raise PddlError(f"non-ASCII text outside a comment: {line.strip()!r}")
        out += re.findall(r"[()]|\?[^\s()?]*|[^\s()?]+", line.lower())
    return out


def nested(text: str):
    stack: list[list] = [[]]
    for t in tokens(text):
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) == 1:
                raise PddlError("a closing parenthesis too many")
            done = stack.pop()
            stack[-1].append(done)
        else:
            if len(stack) == 1:
                raise PddlError(f"text outside parentheses: {t}")
            stack[-1].append(t)
    if len(stack) > 1:
        raise PddlError("a closing parenthesis is missing")
    if len(stack[0]) != 1:
        raise PddlError("one definition per file is expected")
    return stack[0][0]


def read_file(path) -> list:
    try:
        return nested(Path(path).read_text(encoding="latin-1"))
    except OSError as e:
        raise PddlError(f"cannot read {path}: {e}") from e


def typed(items: list) -> list[tuple[str, str]]:
    """`a b - t c` -> [(a, t), (b, t), (c, object)]."""
    out, waiting, k = [], [], 0
    while k < len(items):
        if items[k] == "-":
            if k + 1 == len(items):
                raise PddlError("a type is missing after '-'")
            kind = items[k + 1]
            if isinstance(kind, list):
                raise PddlError("alternative types are not supported")
            out += [(n, kind) for n in waiting]
            waiting, k = [], k + 2
        else:
            waiting.append(items[k])
            k += 1
    return out + [(n, "object") for n in waiting]


# --- conditions ---------------------------------------------------------------------------------------------------


def dnf(cond, negated: bool = False) -> list[list[tuple]]:
    """Disjunctive normal form: a list of conjunctions of (negated, head, arguments)."""
    if not cond:
        return [] if negated else [[]]
    head = cond[0]
    if head in ("and", "or"):
        parts = [dnf(c, negated) for c in cond[1:]]
        if (head == "and") != negated:
            return [sum(choice, []) for choice in product(*parts)]
        return [c for p in parts for c in p]
    if head == "not":
        if len(cond) != 2:
            raise PddlError("'not' takes one condition")
        return dnf(cond[1], not negated)
    if head in ("forall", "exists", "imply", "when"):
        raise PddlError(f"'{head}' is not supported")
    return [[(negated, head, tuple(cond[1:]))]]


class _Reader:
    def __init__(self, domain, problem):
        self.domain, self.problem = self._sections(domain, "domain"), self._sections(problem, "problem")
        self.types = {"object": None}
        for name, parent in typed(self._one(self.domain, ":types")):
            if name != "object":
                self.types[name] = parent
        for parent in set(self.types.values()) - {None} - set(self.types):
            self.types[parent] = "object"
        named = typed(self._one(self.domain, ":constants")) + typed(self._one(self.problem, ":objects"))
        self.objects = {}
        for name, kind in named:
            if name in self.objects:
                raise PddlError(f"object {name} is declared twice")
            self._known_type(kind)
            self.objects[name] = kind
        self.predicates: dict[str, list[str]] = {}
        for p in self._one(self.domain, ":predicates"):
            if p[0] in self.predicates:
                raise PddlError(f"predicate {p[0]} is declared twice")
            self.predicates[p[0]] = [k for _, k in typed(p[1:])]
            for k in self.predicates[p[0]]:
                self._known_type(k)
        self.raw_actions = [self._action(a) for key, a in self.domain if key == ":action"]

    def _known_type(self, kind):
        if kind not in self.types:
            raise PddlError(f"type {kind} is not declared")

    @staticmethod
    def _sections(definition, what):
        if definition[0] != "define" or definition[1][0] != what:
            raise PddlError(f"a {what} definition is expected")
        out = []
        for s in definition[2:]:
            if s[0] in (":derived", ":axiom"):
                raise PddlError("derived predicates are not supported")
            out.append((s[0], s[1:]))
        return out

    @staticmethod
    def _one(sections, key):
        found = [s for k, s in sections if k == key]
        if len(found) > 1:
            raise PddlError(f"section {key} occurs twice")
        return found[0] if found else []

    def _check(self, head, args):
        if head == "=":
            if len(args) != 2:
                raise PddlError("'=' takes two arguments")
        elif head not in self.predicates:
            raise PddlError(f"predicate {head} is not declared")
        elif len(self.predicates[head]) != len(args):
            raise PddlError(f"predicate {head} takes {len(self.predicates[head])} arguments, not {len(args)}")

    def _action(self, body):
        parts = dict(zip(body[1::2], body[2::2]))
        params = typed(parts.get(":parameters", []))
        if len({n for n, _ in params}) < len(params):
            raise PddlError(f"action {body[0]} repeats a parameter")
        effects: list[tuple] = []
        fresh: list[tuple[str, str]] = []
        cost: list[int] = []

        def effect(e, names):
            if not e:
                return
            if e[0] == "and":
                for x in e[1:]:
                    effect(x, names)
            elif e[0] == ":new":
                own = {}
                for n, k in typed(e[1]):
                    own[n] = f"{n}.{len(fresh)}"
                    fresh.append((own[n], k))
                for x in e[2:]:
                    effect(x, names | own)
            elif e[0] == "increase":
                if e[1] != ["total-cost"] or not str(e[2]).isdigit():
                    raise PddlError("only total-cost grows, by a whole number")
                cost.append(int(e[2]))
            elif e[0] in ("when", "forall"):
                raise PddlError(f"'{e[0]}' is not supported in an effect")
            else:
                gone = e[0] == "not"
                head, *args = e[1] if gone else e
                self._check(head, args)
                effects.append((gone, head, tuple(names.get(a, a) for a in args)))

        effect(parts.get(":effect", []), {})
        return {"name": body[0], "params": params, "cond": parts.get(":precondition", []), "effects": effects, "fresh": fresh, "cost": sum(cost) if cost else None}

    # --- compilation --------------------------------------------------------------------------------------------

    def supertypes(self, kind):
        out = []
        while kind is not None:
            out.append(kind)
            kind = self.types[kind]
        return out

    def task(self, unit_cost: bool = False) -> Task:
        names = list(self.objects)
        number = {n: k for k, n in enumerate(names)}
        preds = list(self.predicates)
        type_pred = {}
        for t in self.types:
            type_pred[t] = len(preds)
            preds.append(f"type@{t}")
        arity = [len(self.predicates.get(p, ("x",))) for p in preds]
        index = {p: k for k, p in enumerate(preds)}
        created = {k for a in self.raw_actions for _, kind in a["fresh"] for k in self.supertypes(kind)}
        populated = {t for kind in self.objects.values() for t in self.supertypes(kind)} | created
        any_cost = any(a["cost"] is not None for a in self.raw_actions)

        init = [(type_pred[t], (number[n],)) for n, kind in self.objects.items() for t in self.supertypes(kind)]
        seen = set()
        for fact in self._one(self.problem, ":init"):
            if fact[0] == "=":
                continue  # the start value of total-cost, or a constant function
            if fact[0] == "not":
                continue  # closed world
            self._check(fact[0], fact[1:])
            missing = [a for a in fact[1:] if a not in number]
            if missing:
                raise PddlError(f"object {missing[0]} is not declared")
            row = (index[fact[0]], tuple(number[a] for a in fact[1:]))
            if row not in seen:
                seen.add(row)
                init.append(row)

        actions = []
        for a in sorted(self.raw_actions, key=lambda a: a["name"]):
            if any(kind not in populated for _, kind in a["params"]):
                continue
            place = {n: Var(k) for k, (n, _) in enumerate(a["params"])}
            fresh = {n: Var(len(place) + k) for k, (n, _) in enumerate(a["fresh"])}

            def term(x):
                if x in place or x in fresh:
                    return place.get(x) or fresh[x]
                if x not in number:
                    raise PddlError(f"action {a['name']}: {x} is neither a parameter nor an object")
                return Const(number[x])

            adds = {Atom(index[h], tuple(map(term, args))) for gone, h, args in a["effects"] if not gone}
            adds |= {Atom(type_pred[t], (fresh[n],)) for n, kind in a["fresh"] for t in self.supertypes(kind)}
            deletes = {Atom(index[h], tuple(map(term, args))) for gone, h, args in a["effects"] if gone} - adds
            cost = 1 if unit_cost or not any_cost else a["cost"] or 0
            typed_atoms = [Atom(type_pred[kind], (place[n],)) for n, kind in a["params"]]
            for conjunction in dnf(a["cond"]):
                atoms, absent, comparisons = set(typed_atoms), set(), set()
                for negated, head, args in conjunction:
                    self._check(head, args)
                    if head == "=":
                        comparisons.add(Comparison(term(args[0]), term(args[1]), not negated))
                    elif not negated:
                        atoms.add(Atom(index[head], tuple(map(term, args))))
                    elif args:
                        raise PddlError(f"action {a['name']}: negated preconditions with arguments are not supported")
                    else:
                        absent.add(index[head])
                # Everything is an object; the atom is needed only where nothing else binds the parameter.
                bound = frozenset().union(frozenset(), *(x.variables for x in atoms if x.pred != type_pred["object"]))
                atoms = {x for x in atoms if x.pred != type_pred["object"] or not x.variables <= bound}
                key = lambda x: (x.pred, repr(x.args))
                actions.append(Action(a["name"], len(place), tuple(sorted(atoms, key=key)), tuple(sorted(absent)), tuple(sorted(comparisons, key=repr)), tuple(sorted(adds, key=key)), tuple(sorted(deletes, key=key)), cost, tuple(fresh.values())))

        goals = dnf(self._one(self.problem, ":goal")[0] if self._one(self.problem, ":goal") else [])
        if len(goals) != 1:
            raise PddlError("a goal must be one conjunction")
        goal = []
        for negated, head, args in goals[0]:
            self._check(head, args)
            if any(x not in number for x in args):
                raise PddlError("a goal names an object that is not declared")
            goal.append(Atom(index[head], tuple(Const(number[x]) for x in args), negated))
        changed = {e.pred for a in actions for e in a.adds + a.deletes}
        used = {x.pred for a in actions for x in a.atoms} | {p for a in actions for p in a.absent} | {g.pred for g in goal} | changed
        static = set(range(len(preds))) - changed
        init = [(p, args) for p, args in init if p in used]
        return Task(preds, arity, names, {t: p for t, p in self.types.items()}, dict(self.objects), static, init, goal, actions, type_pred)


def parse_task(domain: str, problem: str, unit_cost: bool = False) -> Task:
    return _Reader(nested(domain), nested(problem)).task(unit_cost)


def load_task(problem_path, domain_path=None, unit_cost: bool = False) -> Task:
    """Without a domain path: domain.pddl beside the problem, or <problem>-domain.pddl, or domain_<problem>.pddl."""
    problem_path = Path(problem_path)
    if domain_path is None:
        stem = problem_path.stem
        tried = [problem_path.with_name(n) for n in ("domain.pddl", f"{stem}-domain.pddl", f"domain_{stem}.pddl", f"{stem}_domain.pddl")]
        domain_path = next((p for p in tried if p.exists()), None)
        if domain_path is None:
            raise PddlError(f"no domain file found beside {problem_path}")
    return _Reader(read_file(domain_path), read_file(problem_path)).task(unit_cost)
