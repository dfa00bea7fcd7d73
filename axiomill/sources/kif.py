"""Knowledge files in the parenthesised logic syntax: tokens, trees, diagnostics, rewriting, rows and text again.

Parsing is per file and runs in Arrow batches on the workers; what reaches Spark are flat rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# The logical operators and their numbers of arguments (None: any).
OPERATORS: dict[str, int | None] = {"and": None, "or": None, "not": 1, "=>": 2, "<=>": 2, "equal": 2, "forall": 2, "exists": 2}

_TOKEN = re.compile(
    r"""(?P<blank>\s+)|(?P<comment>;[^\n]*)|(?P<open>\()|(?P<close>\))|(?P<string>"(?:[^"\\]|\\.)*")|(?P<broken>")"""
    r"""|(?P<row>@[^\s()";]+)|(?P<variable>\?[^\s()";]*)|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?=[\s()";]|$))|(?P<symbol>[^\s()";]+)"""
)


@dataclass(frozen=True)
class Span:
    line: int
    col: int
    start: int
    end: int


@dataclass(frozen=True)
class Node:
    """kind: list, symbol, variable, row, string, number or op. ``items`` holds a list's members, ``val`` a leaf's text."""

    kind: str
    val: str = ""
    items: tuple[Node, ...] = ()
    span: Span | None = field(default=None, compare=False)

    @property
    def head(self) -> str | None:
        return self.items[0].val if self.items and self.items[0].kind in ("symbol", "op") else None


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    span: Span
    severity: str = "error"


def tokens(text: str) -> Iterator[tuple[str, str, Span]]:
    """(kind, text, span); a quote without end is one ``broken`` token."""
    line, begin = 1, 0
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind not in ("blank", "comment"):
            yield kind, m[0], Span(line, m.start() - begin + 1, m.start(), m.end())
        n = m[0].count("\n")
        if n:
            line += n
            begin = m.start() + m[0].rindex("\n") + 1


def leaf(kind: str, text: str, span: Span | None = None) -> Node:
    if kind == "symbol" and text in OPERATORS:
        kind = "op"
    return Node(kind, text, (), span)


def parse(text: str) -> tuple[list[Node], list[Diagnostic]]:
    """Top-level statements and what was wrong. A new ``(`` at the start of a line closes an unfinished statement."""
    roots: list[Node] = []
    found: list[Diagnostic] = []
    stack: list[tuple[Span, list[Node]]] = []
    for kind, val, span in tokens(text):
        if kind == "open":
            if stack and span.col == 1:
                found.append(Diagnostic("kif/unbalanced-parens", "statement without end", stack[0][0]))
                stack.clear()
            stack.append((span, []))
            continue
        if kind == "close":
            if not stack:
                found.append(Diagnostic("kif/unbalanced-parens", "nothing to close", span))
                continue
            at, items = stack.pop()
            node = Node("list", "", tuple(items), Span(at.line, at.col, at.start, span.end))
            if not items:
                found.append(Diagnostic("kif/empty-list", "empty list", node.span))
            elif items[0].kind == "op" and (n := OPERATORS[items[0].val]) is not None and len(items) - 1 != n:
                found.append(Diagnostic("kif/operator-arity", f"{items[0].val} takes {n}", node.span))
            (stack[-1][1] if stack else roots).append(node)
            continue
        if kind == "broken":
            found.append(Diagnostic("kif/unterminated-string", "quote without end", span))
            continue
        if not stack:
            found.append(Diagnostic("kif/stray-token", f"{val} outside of a statement", span))
            continue
        stack[-1][1].append(leaf(kind, val, span))
    if stack:
        found.append(Diagnostic("kif/unbalanced-parens", "statement without end", stack[0][0]))
    return roots, found


def emit(n: Node) -> str:
    """The text of a tree on one line."""
    return "(" + " ".join(map(emit, n.items)) + ")" if n.kind == "list" else n.val


def pretty(n: Node, width: int = 72, indent: int = 0) -> str:
    """The text of a tree, broken where a line would be longer than ``width``."""
    flat = emit(n)
    if n.kind != "list" or len(flat) + indent <= width:
        return flat
    lead = 1 if n.items[0].kind != "list" else 0
    first = "(" + " ".join(map(emit, n.items[:lead]))
    rest = [" " * (indent + 2) + pretty(x, width, indent + 2) for x in n.items[lead:]]
    return "\n".join([first, *rest]) + ")"


def variables(n: Node) -> list[str]:
    """Distinct variables in order of first place."""
    if n.kind in ("variable", "row"):
        return [n.val]
    return list(dict.fromkeys(v for x in n.items for v in variables(x)))


def substitute(n: Node, by: dict[str, Node | list[Node]]) -> Node:
    """Replace variables; a list in place of a row variable is spliced."""
    if n.kind in ("variable", "row"):
        got = by.get(n.val, n)
        return got if isinstance(got, Node) else n
    out: list[Node] = []
    for x in n.items:
        got = by.get(x.val) if x.kind in ("variable", "row") else None
        out.extend(got if isinstance(got, list) else [substitute(x, by)])
    return replace(n, items=tuple(out)) if n.kind == "list" else n


def op(name: str, *items: Node) -> Node:
    return Node("list", "", (Node("op", name), *items))


# --- rewriting --------------------------------------------------------------------------------------------------------


def expand_rows(n: Node, most: int = 5) -> list[Node]:
    """One formula per number 1 to ``most`` of arguments of each row variable: ``@ROW`` becomes ``?ROW2 ...``."""
    rows = [v for v in variables(n) if v.startswith("@")]
    out = [n]
    for r in rows:
        out = [substitute(f, {r: [Node("variable", f"?{r[1:]}{i}") for i in range(2, k + 2)]}) for f in out for k in range(1, most + 1)]
    return out


def normal_form(n: Node) -> Node:
    """Negations pushed down to atoms, through and, or, => , <=> and quantifiers."""
    if n.kind != "list" or n.head not in OPERATORS:
        return n
    h, a = n.head, n.items[1:]
    if h == "not" and len(a) == 1 and a[0].kind == "list":
        x = a[0]
        b = x.items[1:]
        if x.head == "not" and len(b) == 1:
            return normal_form(b[0])
        if x.head in ("and", "or"):
            return op("or" if x.head == "and" else "and", *[normal_form(op("not", y)) for y in b])
        if x.head == "=>" and len(b) == 2:
            return op("and", normal_form(b[0]), normal_form(op("not", b[1])))
        if x.head in ("forall", "exists") and len(b) == 2:
            return op("exists" if x.head == "forall" else "forall", b[0], normal_form(op("not", b[1])))
    if h in ("forall", "exists") and len(a) == 2:
        return op(h, a[0], normal_form(a[1]))
    return op(h, *map(normal_form, a))


def axioms(n: Node) -> list[Node]:
    """Rewrite a statement into axioms: a leading forall goes, an equivalence becomes two implications, a top-level
    conjunction falls apart, nested implications are curried, an or on the left splits, nested and/or are flattened."""
    n = _flat(n)
    h, a = n.head, n.items[1:]
    if h == "forall" and len(a) == 2:
        return axioms(a[1])
    if h == "and":
        return [y for x in a for y in axioms(x)]
    if h == "<=>" and len(a) == 2:
        return axioms(op("=>", a[0], a[1])) + axioms(op("=>", a[1], a[0]))
    if h == "=>" and len(a) == 2:
        left, right = a
        if right.head == "=>" and len(right.items) == 3:
            return axioms(op("=>", op("and", left, right.items[1]), right.items[2]))
        if right.head == "and" and len(right.items) > 1:
            return [y for x in right.items[1:] for y in axioms(op("=>", left, x))]
        if left.head == "or" and len(left.items) > 1:
            return [y for x in left.items[1:] for y in axioms(op("=>", x, right))]
    return [n]


def _flat(n: Node) -> Node:
    if n.kind != "list":
        return n
    items = [_flat(x) for x in n.items]
    if n.head in ("and", "or"):
        out = [items[0]]
        for x in items[1:]:
            out.extend(x.items[1:] if x.head == n.head else [x])
        return out[1] if len(out) == 2 else replace(n, items=tuple(out))
    if n.head in ("forall", "exists") and len(items) == 3 and items[2].head == n.head:
        inner = items[2].items
        return _flat(op(n.head, Node("list", "", items[1].items + inner[1].items), inner[2]))
    return replace(n, items=tuple(items))


def fold_arithmetic(n: Node) -> Node:
    """Ground binary arithmetic worked out; division by zero and what isn't finite stay as they are."""
    if n.kind != "list":
        return n
    n = replace(n, items=tuple(map(fold_arithmetic, n.items)))
    if len(n.items) == 3 and n.items[1].kind == n.items[2].kind == "number":
        x, y = float(n.items[1].val), float(n.items[2].val)
        do = {"AdditionFn": lambda: x + y, "SubtractionFn": lambda: x - y, "MultiplicationFn": lambda: x * y, "DivisionFn": lambda: x / y if y else None}
        v = do[n.head]() if n.head in do else None
        if v is not None and v - v == 0:
            return Node("number", number_text(v))
    return n


def number_text(v: float) -> str:
    if v == int(v) and abs(v) < 1e15:
        return str(int(v))
    return f"{v:.10f}".rstrip("0").rstrip(".")


def canonical(n: Node, names: dict[str, str] | None = None) -> str:
    """Text in which formulas that differ only in variable names and spelling of numbers are the same."""
    names = {} if names is None else names
    if n.kind in ("variable", "row"):
        return names.setdefault(n.val, f"{n.val[0]}{len(names)}")
    if n.kind == "number":
        return number_text(float(n.val))
    return "(" + " ".join(canonical(x, names) for x in n.items) + ")" if n.kind == "list" else n.val


def fingerprint(text: str) -> int:
    """64 bits of a text, signed."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


# --- rows -------------------------------------------------------------------------------------------------------------

SENTENCES = "sid bigint, parent array<bigint>, elements array<struct<kind:string,val:string>>, file string, line int, kif string, fingerprint bigint"
FINDINGS = "file string, code string, severity string, message string, line int, col int"
_KIND = {"symbol": "symbol", "op": "op", "variable": "variable", "row": "variable", "string": "literal", "number": "literal"}


def flatten(n: Node, file: str, parent: int | None = None) -> list[dict]:
    """Rows of a statement and those nested in it; a sid is the hash of the content, so equal statements share one."""
    sid = fingerprint(emit(n))
    elements, rows = [], []
    for x in n.items:
        if x.kind == "list":
            inner = flatten(x, file, sid)
            rows += inner
            elements.append({"kind": "sub", "val": str(inner[0]["sid"])})
        else:
            val = number_text(float(x.val)) if x.kind == "number" else x.val
            elements.append({"kind": _KIND[x.kind], "val": val})
    own = {
        "sid": sid, "parent": None if parent is None else [parent], "elements": elements, "file": file, "line": n.span.line if n.span else None,
        "kif": emit(n), "fingerprint": fingerprint(canonical(n)),
    }
    return [own, *rows]


def read(spark: SparkSession, path: str | list[str], normalise: bool = False) -> DataFrame:
    """Statements of the files under ``path``, with ``normalise`` rewritten to axioms first. One task parses whole files."""
    files = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as file", "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, text in zip(b["file"], b["value"]):
                roots, _ = parse(text)
                made = [y for x in roots for r in expand_rows(x) for y in axioms(fold_arithmetic(r))] if normalise else roots
                rows = [r for n in made if n.kind == "list" for r in flatten(n, file)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SENTENCES.split(", ")])

    return files.mapInPandas(run, SENTENCES)


def diagnose(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """What is wrong with the files' syntax."""
    files = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as file", "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, d.code, d.severity, d.message, d.span.line, d.span.col) for f, t in zip(b["file"], b["value"]) for d in parse(t)[1]]
            yield pd.DataFrame(rows, columns=["file", "code", "severity", "message", "line", "col"])

    return files.mapInPandas(run, FINDINGS)
