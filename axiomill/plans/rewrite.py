"""Rewritings of axioms before they go to a prover: guards from declared classes, predicate variables, number variants."""

from __future__ import annotations

from axiomill.sources.kif import Node, op, substitute, variables

#: Instances made of one formula with a predicate variable.
MAX_INSTANCES = 32


def domain_guards(n: Node, sorts: dict[tuple[str, int], str], above: dict[str, set[str]], root: str = "Entity") -> Node:
    """A formula under the condition that its free variables are instances of the classes their places ask for.

    ``sorts`` gives the class of (relation, place), ``above`` the strict superclasses of a class. Of several classes only
    the most specific are kept; the root class asks for nothing.
    """
    want: dict[str, set[str]] = {}
    bound: set[str] = set()

    def walk(x: Node) -> None:
        if x.kind != "list" or not x.items:
            return
        if x.head in ("forall", "exists"):
            bound.update(v.val for v in x.items[1].items)
            walk(x.items[2])
            return
        for i, y in enumerate(x.items[1:], 1):
            cls = sorts.get((x.items[0].val, i))
            if y.kind == "variable" and cls and cls != root:
                want.setdefault(y.val, set()).add(cls)
            walk(y)

    walk(n)
    guards = []
    for v in variables(n):
        classes = want.get(v, set()) if v not in bound else set()
        for c in sorted(classes):
            if not any(c in above.get(o, set()) for o in classes if o != c):
                guards.append(Node("list", "", (Node("symbol", "instance"), Node("variable", v), Node("symbol", c))))
    if not guards:
        return n
    left = guards[0] if len(guards) == 1 else op("and", *guards)
    if n.head == "=>":
        parts = n.items[1].items[1:] if n.items[1].head == "and" else (n.items[1],)
        fresh = [g for g in guards if g not in parts]
        return op("=>", op("and", *fresh, *parts), n.items[2]) if fresh else n
    return op("=>", left, n)


def predicate_variables(n: Node) -> list[str]:
    """Variables that stand as a head somewhere."""
    if n.kind != "list" or not n.items:
        return []
    own = [n.items[0].val] if n.items[0].kind == "variable" and len(n.items) > 1 else []
    if n.head in ("forall", "exists"):
        return predicate_variables(n.items[2])
    return list(dict.fromkeys(own + [v for x in n.items for v in predicate_variables(x)]))


class Instances(list):
    """Formulas; ``cut`` tells that there were more."""

    cut = False


def instantiate(n: Node, relations: dict[int, list[str]], most: int = MAX_INSTANCES) -> Instances:
    """The formula with its predicate variables replaced by relations of the number of arguments used, by name; at most
    ``most`` instances, and ``cut`` says whether that left some out. Without predicate variables it stays alone; without
    fitting relations nothing is left."""
    out = Instances([n])
    for v in predicate_variables(n):
        k = _width(n, v)
        made = [substitute(f, {v: Node("symbol", r)}) for f in out for r in sorted(relations.get(k, []))]
        more = out.cut or len(made) > most
        out = Instances(made[:most])
        out.cut = more
    return out


def _width(n: Node, v: str) -> int:
    if n.kind != "list" or not n.items:
        return 0
    if n.items[0].val == v:
        return len(n.items) - 1
    return max((_width(x, v) for x in n.items), default=0)


def augment(n: Node, implied: dict[str, list[Node]], rounds: int = 16) -> Node:
    """An implication with what its conditions imply added to them, until nothing new comes.

    ``implied`` gives for a relation the atoms that follow from one of its atoms, over ?1, ?2, ... for its arguments.
    """
    if n.head != "=>" or len(n.items) != 3:
        return n
    parts = list(n.items[1].items[1:]) if n.items[1].head == "and" else [n.items[1]]
    for _ in range(rounds):
        made = [substitute(t, {f"?{i}": y for i, y in enumerate(x.items[1:], 1)}) for x in parts if x.kind == "list" for t in implied.get(x.head or "", [])]
        fresh = [m for m in dict.fromkeys(made) if m not in parts]
        if not fresh:
            return op("=>", parts[0] if len(parts) == 1 else op("and", *parts), n.items[2])
        parts += fresh
    raise ValueError(f"conditions still grow after {rounds} rounds")
