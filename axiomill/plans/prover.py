"""A small resolution prover on the driver, for conjectures over a selected set of axioms.

Clauses come from negation normal form by Skolem names; the given-clause loop takes the lightest clause, factors it,
resolves it with the active ones, and keeps what no older clause subsumes.
"""

from __future__ import annotations

import heapq
import itertools
import math
from dataclasses import dataclass, field

from axiomill.sources.kif import Node, normal_form, op, substitute, variables

Term = tuple  # ("?x",) for a variable, (name, arg, ...) otherwise


@dataclass(frozen=True)
class Clause:
    literals: tuple[tuple[bool, Term], ...]
    parents: tuple[int, ...] = ()
    rule: str = "input"

    @property
    def weight(self) -> int:
        return sum(_size(t) for _, t in self.literals)


@dataclass
class Result:
    status: str
    steps: list[Clause] = field(default_factory=list)
    made: int = 0


class TooManyClauses(ValueError):
    pass


def _size(t: Term) -> int:
    return 1 + sum(_size(x) for x in t[1:])


def _term(n: Node) -> Term:
    if n.kind in ("variable", "row"):
        return (n.val,)
    if n.kind == "list":
        head = _term(n.items[0])
        return (head[0] if len(head) == 1 else repr(head), *map(_term, n.items[1:]))
    return (n.val,)


def free_variables(n: Node, bound: frozenset[str] = frozenset()) -> list[str]:
    """Variables that no quantifier of the formula binds, in order of first place."""
    if n.kind in ("variable", "row"):
        return [] if n.val in bound else [n.val]
    if n.head in ("forall", "exists") and len(n.items) == 3:
        return free_variables(n.items[2], bound | {v.val for v in n.items[1].items})
    return list(dict.fromkeys(v for x in n.items for v in free_variables(x, bound)))


def clausify(n: Node, names: itertools.count | None = None, most: int = 128) -> list[Clause]:
    """Clauses of a formula: implications away, negations inside, existentials by Skolem terms, then distributed.

    Free variables are universal. A disjunction that would spread into more than ``most`` clauses has its conjunctions
    named by new predicates first; still more raise TooManyClauses.
    """
    names = names or itertools.count(1)

    def plain(x: Node) -> Node:
        if x.kind != "list" or not x.items:
            return x
        if x.head == "=>":
            return op("or", op("not", plain(x.items[1])), plain(x.items[2]))
        if x.head == "<=>":
            a, b = plain(x.items[1]), plain(x.items[2])
            return op("and", op("or", op("not", a), b), op("or", op("not", b), a))
        if x.head in ("and", "or", "not"):
            return op(x.head, *map(plain, x.items[1:]))
        if x.head in ("forall", "exists"):
            return op(x.head, x.items[1], plain(x.items[2]))
        return x

    def skolem(x: Node, scope: tuple[str, ...]) -> Node:
        if x.head in ("and", "or"):
            return op(x.head, *[skolem(y, scope) for y in x.items[1:]])
        if x.head == "forall":
            fresh = {v.val: Node("variable", f"{v.val}_{next(names)}") for v in x.items[1].items}
            return skolem(substitute(x.items[2], fresh), (*scope, *(v.val for v in fresh.values())))
        if x.head == "exists":
            made = {}
            for v in x.items[1].items:
                name = Node("symbol", f"sk{next(names)}")
                made[v.val] = Node("list", "", (name, *(Node("variable", s) for s in scope))) if scope else name
            return skolem(substitute(x.items[2], made), scope)
        return x

    extra: list[tuple[tuple[bool, Term], ...]] = []

    def named(x: Node) -> Node:
        """A new atom over the free variables, which implies ``x``."""
        atom = Node("list", "", (Node("symbol", f"def{next(names)}"), *(Node("variable", v) for v in free_variables(x))))
        extra.extend(spread(op("or", op("not", atom), x)))
        return atom

    def spread(x: Node) -> list[tuple[tuple[bool, Term], ...]]:
        if x.head == "and":
            return [c for y in x.items[1:] for c in spread(y)]
        if x.head == "or":
            parts = [spread(y) for y in x.items[1:]]
            if math.prod(map(len, parts)) > most:
                parts = [spread(named(y)) if len(p) > 1 else p for y, p in zip(x.items[1:], parts)]
            return [sum(c, ()) for c in itertools.product(*parts)]
        if x.head == "not":
            return [((False, _term(x.items[1])),)]
        return [((True, _term(x)),)]

    flat = skolem(normal_form(plain(n)), tuple(free_variables(n)))
    out = []
    for c in [*spread(flat), *extra]:
        lits = tuple(dict.fromkeys(c))
        if not any((not s, t) in lits for s, t in lits):
            out.append(Clause(lits))
    if len(out) > most:
        raise TooManyClauses(len(out))
    return out


def _var(t: Term) -> bool:
    return len(t) == 1 and t[0][:1] in "?@"


def _walk(t: Term, s: dict) -> Term:
    while _var(t) and t[0] in s:
        t = s[t[0]]
    return t


def unify(a: Term, b: Term, s: dict) -> dict | None:
    """A most general unifier that extends ``s``, or None."""
    todo, s = [(a, b)], dict(s)
    while todo:
        x, y = todo.pop()
        x, y = _walk(x, s), _walk(y, s)
        if x == y:
            continue
        if _var(x) or _var(y):
            if not _var(x):
                x, y = y, x
            if _occurs(x[0], y, s):
                return None
            s[x[0]] = y
        elif x[0] != y[0] or len(x) != len(y):
            return None
        else:
            todo.extend(zip(x[1:], y[1:]))
    return s


def _occurs(v: str, t: Term, s: dict) -> bool:
    t = _walk(t, s)
    return t[0] == v if _var(t) else any(_occurs(v, x, s) for x in t[1:])


def _apply(t: Term, s: dict) -> Term:
    t = _walk(t, s)
    return t if len(t) == 1 else (t[0], *(_apply(x, s) for x in t[1:]))


def _rename(lits, mark: str):
    def go(t: Term) -> Term:
        return (t[0] + mark,) if _var(t) else (t[0], *map(go, t[1:]))

    return tuple((p, go(t)) for p, t in lits)


def _canonical(lits) -> tuple[tuple[bool, Term], ...]:
    names: dict[str, str] = {}

    def go(t: Term) -> Term:
        return (names.setdefault(t[0], f"?{len(names)}"),) if _var(t) else (t[0], *map(go, t[1:]))

    return tuple((p, go(t)) for p, t in sorted(set(lits), key=lambda x: (x[0], _shape(x[1]))))


def _shape(t: Term) -> str:
    return "?" if _var(t) else f"{t[0]}({','.join(map(_shape, t[1:]))})"


def subsumes(a: tuple, b: tuple) -> bool:
    """Whether an instance of clause ``a`` is part of clause ``b``."""

    def match(x: Term, y: Term, s: dict) -> dict | None:
        if _var(x):
            if x[0] in s:
                return s if s[x[0]] == y else None
            return s | {x[0]: y}
        if x[0] != y[0] or len(x) != len(y):
            return None
        for p, q in zip(x[1:], y[1:]):
            s = match(p, q, s)
            if s is None:
                return None
        return s

    def go(i: int, s: dict) -> bool:
        if i == len(a):
            return True
        return any(p == a[i][0] and (m := match(a[i][1], t, s)) is not None and go(i + 1, m) for p, t in b)

    return len(a) <= len(b) and go(0, {})


# --- equality ---------------------------------------------------------------------------------------------------------


def _count_vars(t: Term, out: dict | None = None) -> dict:
    out = {} if out is None else out
    if _var(t):
        out[t[0]] = out.get(t[0], 0) + 1
    for x in t[1:]:
        _count_vars(x, out)
    return out


def greater(a: Term, b: Term) -> bool:
    """Knuth-Bendix order with weight one per symbol and precedence by name."""
    if a == b or _var(a):
        return False
    va, vb = _count_vars(a), _count_vars(b)
    if any(va.get(v, 0) < n for v, n in vb.items()):
        return False
    if _size(a) != _size(b):
        return _size(a) > _size(b)
    if _var(b):
        return True
    if a[0] != b[0]:
        return a[0] > b[0]
    for x, y in zip(a[1:], b[1:]):
        if x != y:
            return greater(x, y)
    return len(a) > len(b)


def _match(x: Term, y: Term, s: dict) -> dict | None:
    if _var(x):
        return (s if s[x[0]] == y else None) if x[0] in s else s | {x[0]: y}
    if x[0] != y[0] or len(x) != len(y):
        return None
    for p, q in zip(x[1:], y[1:]):
        s = _match(p, q, s)
        if s is None:
            return None
    return s


def _fill(t: Term, s: dict) -> Term:
    return s.get(t[0], t) if len(t) == 1 else (t[0], *(_fill(x, s) for x in t[1:]))


def demodulate(t: Term, units: list[tuple[Term, Term]]) -> Term:
    """Normal form of a term under unit equations, applied only where they make it smaller."""
    for _ in range(1000):
        if len(t) > 1:
            t = (t[0], *(demodulate(x, units) for x in t[1:]))
        for left, right in units:
            s = _match(left, t, {})
            if s is not None and greater(t, new := _fill(right, s)):
                t = new
                break
        else:
            return t
    return t


def _subterms(t: Term, path: tuple[int, ...] = ()):
    if not _var(t):
        yield path, t
        for i, x in enumerate(t[1:], 1):
            yield from _subterms(x, (*path, i))


def _put(t: Term, path: tuple[int, ...], new: Term) -> Term:
    return new if not path else (*t[: path[0]], _put(t[path[0]], path[1:], new), *t[path[0] + 1 :])


def paramodulants(a: tuple, b: tuple):
    """Clauses from using a positive equation of clause ``a`` inside clause ``b``, larger side first."""
    for i, (p, e) in enumerate(a):
        if not p or e[0] != "equal" or len(e) != 3:
            continue
        for left, right in ((e[1], e[2]), (e[2], e[1])):
            if _var(left) or greater(right, left):
                continue
            for j, (q, t) in enumerate(b):
                for path, sub in _subterms(t):
                    if path and (s := unify(left, sub, {})) is not None and not greater(_apply(right, s), _apply(left, s)):
                        rest = [x for k, x in enumerate(a) if k != i] + [x for k, x in enumerate(b) if k != j]
                        yield [(q, _apply(_put(t, path, right), s)), *((r, _apply(x, s)) for r, x in rest)]


def equality_resolvents(lits: tuple):
    """Clauses without one inequation whose sides unify."""
    for i, (p, t) in enumerate(lits):
        if not p and t[0] == "equal" and len(t) == 3 and (s := unify(t[1], t[2], {})) is not None:
            yield [(q, _apply(x, s)) for k, (q, x) in enumerate(lits) if k != i]


def equality_factors(lits: tuple):
    """Clauses that make one of two positive equations with unifiable sides out of both: (s = t), (s' = t') give
    (s = t), (t /= t') under the unifier of s and s'."""
    eqs = [(i, t) for i, (p, t) in enumerate(lits) if p and t[0] == "equal" and len(t) == 3]
    for (i, e), (j, f) in itertools.permutations(eqs, 2):
        for (s, t), (u, v) in itertools.product(((e[1], e[2]), (e[2], e[1])), ((f[1], f[2]), (f[2], f[1]))):
            if not _var(s) and (m := unify(s, u, {})) is not None and not greater(_apply(t, m), _apply(s, m)):
                rest = [(p, _apply(x, m)) for k, (p, x) in enumerate(lits) if k != j]
                yield [*rest, (False, ("equal", _apply(t, m), _apply(v, m)))]


def prove(axioms: list[Node], conjecture: Node | None, max_steps: int = 4000, max_literals: int = 8) -> Result:
    """Proved when the axioms and the denied conjecture contradict each other; Disproved when nothing more follows;
    Unknown when the steps run out or a clause had to be left out. The steps of a proof come in order."""
    names = itertools.count(1)
    clauses = [c for n in axioms for c in clausify(n, names)]
    if conjecture is not None:
        free = variables(conjecture)
        closed = op("exists", Node("list", "", tuple(Node("variable", v) for v in free)), conjecture) if free else conjecture
        clauses += [Clause(c.literals, (), "denied conjecture") for c in clausify(op("not", closed), names)]
    store: list[Clause] = []
    queue: list[tuple[int, int]] = []
    known: set = set()
    units: list[tuple[Term, Term]] = []
    lost = False

    def add(lits, parents, rule) -> int | None:
        nonlocal lost
        if units:
            lits = [(p, (t[0], *(demodulate(x, units) for x in t[1:]))) for p, t in lits]
        lits = _canonical(lits)
        if any((not p, t) in lits for p, t in lits) or lits in known:
            return None
        # (equal x x) is true
        lits = tuple(x for x in lits if not (not x[0] and x[1][0] == "equal" and len(x[1]) == 3 and x[1][1] == x[1][2]))
        if any(p and t[0] == "equal" and len(t) == 3 and t[1] == t[2] for p, t in lits):
            return None
        if len(lits) > max_literals:
            lost = True
            return None
        known.add(lits)
        store.append(Clause(lits, parents, rule))
        heapq.heappush(queue, (store[-1].weight, len(store) - 1))
        return len(store) - 1 if not lits else None

    def proof(k: int) -> list[Clause]:
        need, todo = set(), [k]
        while todo:
            i = todo.pop()
            if i not in need:
                need.add(i)
                todo += store[i].parents
        return [store[i] for i in sorted(need)]

    for c in clauses:
        k = add(c.literals, (), c.rule)
        if k is not None:
            return Result("Proved", proof(k), len(store))
    active: list[int] = []
    for _ in range(max_steps):
        if not queue:
            return Result("Unknown" if lost else "Disproved", [], len(store))
        _, g = heapq.heappop(queue)
        given = store[g].literals
        if any(subsumes(store[i].literals, given) for i in active):
            continue
        for i, j in itertools.combinations(range(len(given)), 2):
            if given[i][0] == given[j][0] and (s := unify(given[i][1], given[j][1], {})) is not None:
                add([(p, _apply(t, s)) for n, (p, t) in enumerate(given) if n != j], (g,), "factor")
        for new in equality_resolvents(given):
            if (k := add(new, (g,), "equality resolution")) is not None:
                return Result("Proved", proof(k), len(store))
        for new in equality_factors(given):
            add(new, (g,), "equality factoring")
        active.append(g)
        left = _rename(given, "'")
        if len(given) == 1 and given[0][0] and given[0][1][0] == "equal" and len(given[0][1]) == 3:
            fresh = [(x, y) for x, y in (given[0][1][1:], given[0][1][:0:-1]) if greater(x, y)]
            units += fresh
            # what is active already gives way to its normal form under the new equation
            for i in [i for i in active if i != g and fresh]:
                if any((t[0], *(demodulate(x, fresh) for x in t[1:])) != t for _, t in store[i].literals):
                    active.remove(i)
                    if (k := add(store[i].literals, (i, g), "backward demodulation")) is not None:
                        return Result("Proved", proof(k), len(store))
        for i in active:
            for new in itertools.chain(paramodulants(left, store[i].literals), paramodulants(store[i].literals, left) if i != g else ()):
                if (k := add(new, (g, i), "paramodulation")) is not None:
                    return Result("Proved", proof(k), len(store))
        for i in active:
            for (m, (p, a)), (n, (q, b)) in itertools.product(enumerate(left), enumerate(store[i].literals)):
                if p != q and a[0] == b[0] and (s := unify(a, b, {})) is not None:
                    rest = [x for k, x in enumerate(left) if k != m] + [x for k, x in enumerate(store[i].literals) if k != n]
                    k = add([(r, _apply(t, s)) for r, t in rest], (g, i), "resolve")
                    if k is not None:
                        return Result("Proved", proof(k), len(store))
    return Result("Unknown", [], len(store))


# --- clauses of their own kind ----------------------------------------------------------------------------------------


def split(c: Clause, names: itertools.count | None = None) -> list[Clause]:
    """A clause whose literals fall into groups without a shared variable, as one clause a group: all but the first are
    named by a new atom, which the first then lists. A clause in one piece stays as it is."""
    names = names or itertools.count(1)
    groups: list[tuple[set[str], list]] = []
    for lit in c.literals:
        own, lits, at = set(_count_vars(lit[1])), [lit], len(groups)
        for g in [g for g in groups[::-1] if g[0] & own]:
            at = groups.index(g)
            groups.remove(g)
            own |= g[0]
            lits = g[1] + lits
        groups.insert(at, (own, lits))
    if len(groups) < 2:
        return [c]
    heads = [(f"split{next(names)}",) for _ in groups[1:]]
    rest = [Clause(((False, h), *lits), c.parents, "split") for h, (_, lits) in zip(heads, groups[1:])]
    return [Clause((*groups[0][1], *((True, h) for h in heads)), c.parents, "split"), *rest]


def quote(n: Node, depth: int = 0) -> Node:
    """The formula with every formula that stands as an argument of a relation turned into a term: its operators become
    functions of the same name with ``_q``."""
    if n.kind != "list" or not n.items:
        return n
    is_op = n.items[0].kind == "op"
    head = Node("symbol", f"{n.items[0].val}_q") if is_op and depth else n.items[0]
    inside = depth + (0 if is_op and not depth else 1)
    return Node("list", "", (head, *(quote(x, inside) for x in n.items[1:])), n.span)


def modal_clauses(relation: str) -> list[Clause]:
    """Who stands in the relation to a quoted conjunction stands in it to both parts."""
    a, p, q = ("?A",), ("?P",), ("?Q",)
    both = (relation, a, ("and_q", p, q))
    return [Clause(((False, both), (True, (relation, a, x))), (), "modal") for x in (p, q)]


def lift_classes(n: Node, names: itertools.count | None = None, operator: str = "KappaFn") -> tuple[Node, list[Node]]:
    """The formula with its class terms ``(KappaFn ?X formula)`` named, and for each name the axiom of its members."""
    names = names or itertools.count(1)
    made: list[Node] = []

    def go(x: Node) -> Node:
        if x.kind != "list":
            return x
        if x.items and x.items[0].val == operator and len(x.items) == 3:
            inner, free = go(x.items[2]), [v for v in free_variables(x.items[2]) if v != x.items[1].val]
            name = Node("symbol", f"kappa{next(names)}")
            term = Node("list", "", (name, *(Node("variable", v) for v in free))) if free else name
            made.append(op("<=>", Node("list", "", (Node("symbol", "instance"), x.items[1], term)), inner))
            return term
        return Node("list", "", tuple(map(go, x.items)), x.span)

    return go(n), made


def backward(rules: list[tuple[Term, list[Term]]], goal: Term, max_depth: int = 12) -> dict[str, Term] | None:
    """A binding of the goal's variables under which it follows from Horn ``rules`` (head, body), facts having no body;
    None without one. Searched depth first to a bound that grows by one, so that the shortest proof is found."""
    fresh = itertools.count()

    def solve(goals: list[Term], s: dict, left: int):
        if not goals:
            yield s
            return
        if left:
            for head, body in rules:
                mark = f"_{next(fresh)}"
                (_, h), *b = _rename([(True, head), *((True, x) for x in body)], mark)
                if h[0] == goals[0][0] and (m := unify(goals[0], h, s)) is not None:
                    yield from solve([*(x for _, x in b), *goals[1:]], m, left - 1)

    for bound in range(1, max_depth + 1):
        for s in solve([goal], {}, bound):
            return {v: _apply((v,), s) for v in _count_vars(goal)}
    return None
