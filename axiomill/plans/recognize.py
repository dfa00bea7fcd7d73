"""Reading structure out of axioms by their shape: the roles of relations, and event narratives."""

from __future__ import annotations

from dataclasses import dataclass, field

from axiomill.sources.kif import Node


def _sides(n: Node) -> tuple[list[Node], Node] | None:
    """Antecedent atoms and consequent of an implication, a leading forall taken off."""
    while n.head == "forall" and len(n.items) == 3:
        n = n.items[2]
    if n.head != "=>" or len(n.items) != 3:
        return None
    left = list(n.items[1].items[1:]) if n.items[1].head == "and" else [n.items[1]]
    return left, n.items[2]


def _args(n: Node) -> list[str] | None:
    """Head and arguments of an atom of leaves."""
    return [x.val for x in n.items] if n.kind == "list" and n.items and all(x.kind != "list" for x in n.items) else None


def _var(x: str) -> bool:
    return x.startswith("?")


def roles(nodes: list[Node], counts: dict[str, int]) -> dict[str, str]:
    """Which relations play instance, subclass, subrelation, transitive and symmetric, by the axioms that define them.

    instance and subclass: members of a class are members of what lies above it. subrelation: what holds below holds
    above. transitive and symmetric: classes of relations for whose members a chain, or the turned pair, holds too. Where
    several fit, the more frequent heads of ``counts`` win, then the smaller name.
    """
    found: dict[str, list[tuple[int, tuple[str, ...]]]] = {}

    def offer(role: str, *names: str) -> None:
        found.setdefault(role, []).append((-sum(counts.get(x, 0) for x in names), names))

    for n in nodes:
        s = _sides(n)
        if s is None:
            continue
        atoms, head = [_args(x) for x in s[0]], _args(s[1])
        if head is None or any(a is None for a in atoms):
            continue
        if len(atoms) == 2 and len(head) == 3 and all(len(a) == 3 and not _var(a[0]) for a in atoms) and not _var(head[0]):
            for p, q in (atoms, atoms[::-1]):
                if p[0] == head[0] != q[0] and all(map(_var, (*p[1:], *q[1:]))) and p[1] == head[1] and p[2] == q[1] and q[2] == head[2]:
                    offer("bridge", p[0], q[0])
        if len(atoms) == 2 and _var(head[0]):
            for p, q in (atoms, atoms[::-1]):
                if len(p) == 3 and not _var(p[0]) and _var(q[0]) and p[1] == q[0] and p[2] == head[0] and q[1:] == head[1:]:
                    offer("subrelation", p[0])
                if len(p) == 3 and not _var(p[2]) and p[1] == q[0] == head[0] and len(q) == len(head) == 3 and q[1:] == head[:0:-1]:
                    offer("symmetric", p[2])
        if len(atoms) == 3 and _var(head[0]) and len(head) == 3:
            declared = [a for a in atoms if not _var(a[0])]
            links = [a for a in atoms if a[0] == head[0] and len(a) == 3]
            if len(declared) == 1 and len(links) == 2 and len(declared[0]) == 3 and declared[0][1] == head[0] and not _var(declared[0][2]):
                if any(a[1] == head[1] and b[2] == head[2] and a[2] == b[1] for a, b in (links, links[::-1])):
                    offer("transitive", declared[0][2])
    out: dict[str, str] = {}
    for role, options in found.items():
        best = min(options)[1]
        out |= dict(zip(("instance", "subclass"), best)) if role == "bridge" else {role: best[0]}
    return out


@dataclass
class Narrative:
    """happens (time, event), effects (kind, event, fluent, with, without) and, at the start, initial (fluent, holds)."""

    happens: list[tuple[str, str]] = field(default_factory=list)
    effects: list[tuple[str, str, str, str | None, str | None]] = field(default_factory=list)
    initial: list[tuple[str, bool]] = field(default_factory=list)


def narrative(nodes: list[Node]) -> Narrative | None:
    """The tables of an event narrative from the axioms that say when things happen, start and end only.

    These have the form (=> (happens ?E ?T) (or cases...)), each case a conjunction of equations and of what does or does
    not happen at the same time. Ground holdsAt statements give the start. None where trajectories, releases, conditions
    of another form or several companions of one effect leave what the tables can say.
    """
    out = Narrative()
    for n in nodes:
        if any(x in ("trajectory", "releases") for x in _names(n)):
            return None
        if (a := _args(n)) and a[0] == "holdsAt" and len(a) == 3:
            out.initial.append((a[1], True))
        if n.head == "not" and (a := _args(n.items[1])) and a[0] == "holdsAt":
            out.initial.append((a[1], False))
        s = _sides(n)
        top = _args(s[0][0]) if s and len(s[0]) == 1 else None
        if top is None or top[0] not in ("happens", "initiates", "terminates"):
            continue
        for case in s[1].items[1:] if s[1].head == "or" else [s[1]]:
            value: dict[str, str] = {}
            with_, without = [], []
            for x in case.items[1:] if case.head == "and" else [case]:
                inner = x.items[1] if x.head == "not" else x
                a = _args(inner)
                if a is None:
                    return None
                if a[0] == "equal" and x.head != "not":
                    v, c = (a[1], a[2]) if _var(a[1]) else (a[2], a[1])
                    value[v] = c
                elif a[0] == "happens" and top[0] != "happens":
                    (without if x.head == "not" else with_).append(a[1])
                else:
                    return None
            got = [value.get(x, x) for x in top[1:]]
            if any(_var(x) for x in got[:2]) or len(with_) > 1 or len(without) > 1:
                return None
            if top[0] == "happens":
                out.happens.append((got[1], got[0]))
            else:
                out.effects.append((top[0], got[0], got[1], with_[0] if with_ else None, without[0] if without else None))
    return out


def _names(n: Node) -> list[str]:
    return [n.val] if n.kind == "symbol" else [y for x in n.items for y in _names(x)]
