"""The TPTP exchange format: reading fof and cnf formulas, telling dialects apart, writing statements as fof."""

from __future__ import annotations

import itertools
import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from axiomill.plans.cut import cut
from axiomill.plans.prefix import running_sum
from axiomill.sources.kif import Node, op

_TOKEN = re.compile(
    r"\s+|%[^\n]*|/\*.*?\*/|(?P<t><=>|=>|<=|<~>|~\||~&|!=|[()\[\],.:!?~&|=]|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\$?\$?[A-Za-z_]\w*|[+-]?\d+(?:/\d+|\.\d+)?(?:[eE][+-]?\d+)?)", re.S
)


@dataclass(frozen=True)
class Formula:
    name: str
    role: str
    tree: Node
    language: str = "fof"


class TptpError(ValueError):
    pass


def language(text: Column) -> Column:
    """thf, tff, fof, cnf or null, by the first annotated formula that decides."""
    at = lambda k: text.rlike(rf"(?m)^\s*{k}\(")
    return F.when(at("thf"), "thf").when(at("tff"), "tff").when(at("fof"), "fof").when(at("cnf"), "cnf")


def dispatch(name: Column, text: Column) -> Column:
    """Which parser a file is for, by its name, else by what it holds: kif, tq, tptp, szs or null."""
    by_name = F.when(name.endswith(".kif.tq") | name.endswith(".tq"), "tq").when(name.endswith(".kif"), "kif").when(name.rlike(r"\.(p|tptp|ax)$"), "tptp").when(name.rlike(r"\.(szs|out)$"), "szs")
    by_text = F.when(text.contains("SZS status"), "szs").when(language(text).isNotNull(), "tptp").when(text.rlike(r"(?m)^\s*\((note|query|time|answer)\s"), "tq").when(text.rlike(r"(?m)^\s*\("), "kif")
    return F.coalesce(by_name, by_text)


def header(text: str) -> dict[str, str]:
    """``% Key : value`` lines at the top of a problem."""
    return {k.strip(): v.strip() for k, v in re.findall(r"(?m)^%\s*([A-Z][\w ]*?)\s*:\s*(.+)$", text)}


class _Reader:
    def __init__(self, text: str):
        self.t = [m["t"] for m in _TOKEN.finditer(text) if m["t"]]
        self.i = 0

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def next(self, want: str | None = None) -> str:
        t = self.peek()
        if not t or want is not None and t != want:
            raise TptpError(f"expected {want or 'a token'}, found {t or 'the end'}")
        self.i += 1
        return t

    def formula(self) -> Node:
        left = self.unit()
        t = self.peek()
        if t in ("&", "|"):
            items = [left]
            while self.peek() == t:
                self.next()
                items.append(self.unit())
            left = op("and" if t == "&" else "or", *items)
            t = self.peek()
        if t == "=>":
            self.next()
            return op("=>", left, self.formula_unit())
        if t == "<=":
            self.next()
            return op("=>", self.formula_unit(), left)
        if t in ("<=>", "<~>"):
            self.next()
            both = op("<=>", left, self.formula_unit())
            return op("not", both) if t == "<~>" else both
        return left

    def formula_unit(self) -> Node:
        left = self.unit()
        t = self.peek()
        if t in ("&", "|"):
            items = [left]
            while self.peek() == t:
                self.next()
                items.append(self.unit())
            return op("and" if t == "&" else "or", *items)
        return left

    def unit(self) -> Node:
        t = self.peek()
        if t == "~":
            self.next()
            return op("not", self.unit())
        if t in ("!", "?"):
            self.next()
            self.next("[")
            names = []
            while self.peek() != "]":
                v = self.next()
                names.append(Node("variable", "?" + v))
                if self.peek() == ":":
                    self.next()
                    self.next()
                if self.peek() == ",":
                    self.next()
            self.next("]")
            self.next(":")
            return op("forall" if t == "!" else "exists", Node("list", "", tuple(names)), self.unit())
        if t == "(":
            self.next()
            f = self.formula()
            self.next(")")
            return self._equality(f)
        return self._equality(self.term())

    def _equality(self, left: Node) -> Node:
        if self.peek() == "=":
            self.next()
            return op("equal", left, self.term())
        if self.peek() == "!=":
            self.next()
            return op("not", op("equal", left, self.term()))
        return left

    def term(self) -> Node:
        t = self.next()
        if re.match(r"[+-]?\d", t):
            return Node("number", t)
        if t[0] == '"':
            return Node("string", t)
        if t[0].isupper() or t[0] == "_":
            return Node("variable", "?" + t)
        name = Node("symbol", demangle(t.strip("'")))
        if self.peek() != "(":
            return name
        self.next()
        args = []
        while self.peek() != ")":
            args.append(self.formula())
            if self.peek() == ",":
                self.next()
        self.next(")")
        return Node("list", "", (name, *args))

    def skip(self) -> None:
        """To the dot that ends an annotated formula."""
        while self.peek() and self.peek() != ".":
            self.next()
        if self.peek():
            self.next()


def demangle(name: str) -> str:
    """Names as they were before they were made safe: ``s__`` and ``n__`` prefixes go, with their escapes."""
    m = re.match(r"^[sn]__(.*)$", name)
    return re.sub(r"_x([0-9a-f]{2})", lambda x: chr(int(x[1], 16)), m[1].removesuffix("__m")).replace("_d", ".") if m else name


def mangle(name: str) -> str:
    """A symbol as a lower-case word."""
    return "s__" + re.sub(r"[^A-Za-z0-9_]", lambda x: f"_x{ord(x[0]):02x}", name)


def parse(text: str, keep_conjectures: bool = True, includes: str | None = None, _seen: frozenset[str] = frozenset()) -> list[Formula]:
    """Annotated fof and cnf formulas. ``include(...)`` is read from the folder ``includes``, each file once; others are
    left out. A formula that can't be read raises TptpError."""
    out: list[Formula] = []
    r = _Reader(text)
    while r.peek():
        kind = r.next()
        if kind == "include":
            r.next("(")
            name = r.next().strip("'")
            r.skip()
            if includes is not None and name not in _seen:
                _seen = _seen | {name}
                with open(os.path.join(includes, name), encoding="utf-8") as f:
                    out += parse(f.read(), keep_conjectures, includes, _seen)
            continue
        r.next("(")
        name = r.next()
        r.next(",")
        role = r.next()
        r.next(",")
        if kind not in ("fof", "cnf") or role == "type":
            r.skip()
            continue
        tree = r.formula()
        r.skip()
        if keep_conjectures or role not in ("conjecture", "negated_conjecture"):
            out.append(Formula(name, role, tree, kind))
    return out


def write(n: Node) -> str:
    """A formula as fof text; free variables are left free."""
    if n.kind == "variable":
        return "V__" + re.sub(r"\W", "_", n.val[1:]).upper()
    if n.kind == "row":
        raise TptpError("a row variable has no fof form")
    if n.kind == "number":
        return n.val
    if n.kind == "string":
        return '"' + n.val.strip('"').replace("\\", "\\\\").replace('"', '\\"') + '"'
    if n.kind in ("symbol", "op"):
        return {"True": "$true", "False": "$false"}.get(n.val, mangle(n.val))
    a = n.items[1:]
    h = n.head if n.items[0].kind == "op" else None
    if h in ("and", "or"):
        return "(" + (" & " if h == "and" else " | ").join(map(write, a)) + ")"
    if h == "not":
        return f"~ {write(a[0])}"
    if h in ("=>", "<=>"):
        return f"({write(a[0])} {h} {write(a[1])})"
    if h == "equal":
        return f"({write(a[0])} = {write(a[1])})"
    if h in ("forall", "exists"):
        return f"({'!' if h == 'forall' else '?'} [{', '.join(map(write, a[0].items))}] : {write(a[1])})"
    if not a:
        return write(n.items[0])
    if n.items[0].kind != "symbol":
        return "s__holds(" + ", ".join(map(write, n.items)) + ")"
    return f"{mangle(n.items[0].val)}({', '.join(map(write, a))})"


def annotated(name: str, role: str, n: Node) -> str:
    """One annotated formula, its free variables bound by a universal quantifier."""
    from axiomill.sources.kif import variables

    bound: set[str] = set()

    def walk(x: Node) -> None:
        if x.head in ("forall", "exists"):
            bound.update(v.val for v in x.items[1].items)
        for y in x.items:
            walk(y)

    walk(n)
    free = [v for v in variables(n) if v not in bound]
    body = write(n)
    if free:
        body = f"! [{', '.join(write(Node('variable', v)) for v in free)}] : {body}"
    return f"fof({name},{role},{body})."


def export(kif: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``sid, line, dropped``: statements (sid, head, kif) as annotated axioms ``kb_<sid>``; what has no fof form is kept
    with its reason in ``dropped``. Rows are independent; ``line.write.text`` is the file."""
    import pandas as pd

    from axiomill.sources.kif import parse as read_kif

    def run(batches):
        for b in batches:
            rows = []
            for sid, text in zip(b["sid"], b["kif"]):
                try:
                    rows.append((sid, annotated(f"kb_{sid % 2**64}", "axiom", read_kif(text)[0][0]), None))
                except (TptpError, IndexError) as e:
                    rows.append((sid, None, str(e) or "unreadable"))
            yield pd.DataFrame(rows, columns=["sid", "line", "dropped"])

    rows = kif.where(~F.col("head").isin(*exclude)) if exclude else kif
    return rows.select("sid", "kif").mapInPandas(run, "sid bigint, line string, dropped string")


def indexed(lines: DataFrame, bucket_rows: int = 1_000_000) -> DataFrame:
    """``line_no, sid, line``: exported lines in order of sid, numbered from 1, and so which statement each is.

    Numbers run over ranges of sids, so that no task numbers them all.
    """
    kept = cut(lines.where("line is not null").select("sid", "line"), "lines", n=F.count("*"), low=F.min("sid"), high=F.max("sid"))
    n, low, high = (kept.seen[k] or 0 for k in ("n", "low", "high"))
    step = max(1, (high - low + 1) // (n // bucket_rows + 1))
    rows = kept.df.withColumn("bucket", F.floor((F.col("sid").cast("decimal(20,0)") - low) / step).cast("bigint")).withColumn("one", F.lit(1))
    return running_sum(rows, [], "bucket", ["sid", "line"], "one", "line_no").select("line_no", "sid", "line")


def export_selected(kif: DataFrame, chosen: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``export`` of the statements among ``chosen`` (sid), such as a relevance selection."""
    return export(kif.join(chosen.select("sid").distinct(), "sid", "left_semi"), exclude)


def problem(axioms: list[str], query: str | None, name: str = "test") -> tuple[str, list[str]]:
    """The text of a whole problem: axioms as hypotheses, the query as conjecture; and what has no fof form."""
    from axiomill.sources.kif import parse as read_kif

    lines, dropped = [f"% {name}"], []
    for k, (role, text) in enumerate([*(("hypothesis", a) for a in axioms), *([("conjecture", query)] if query else [])]):
        try:
            lines.append(annotated(f"kb_{k}", role, read_kif(text)[0][0]))
        except (TptpError, IndexError):
            dropped.append(text)
    return "\n".join(lines), dropped


def export_problems(tests: DataFrame) -> DataFrame:
    """``item_id, problem, dropped`` of test cases (item_id, file, axioms, query_kif), each by itself."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [(i, *problem(list(a) if a is not None else [], q, f or "test")) for i, f, a, q in zip(b["item_id"], b["file"], b["axioms"], b["query_kif"])]
            yield pd.DataFrame(rows, columns=["item_id", "problem", "dropped"])

    return tests.select("item_id", "file", "axioms", "query_kif").mapInPandas(run, "item_id bigint, problem string, dropped array<string>")


# --- typed and higher-order forms -------------------------------------------------------------------------------------

SORTS = {"Integer": "$int", "Rational": "$rat", "Real": "$real"}


def typed(name: str, n: Node, sorts: dict[tuple[str, int], str] | None = None) -> list[str]:
    """A formula as tff lines: the types of its symbols, then the formula with typed variables.

    ``sorts`` gives the class of (relation, place), 0 for a function's value; the number classes become number types, all
    else is ``$i``. A variable has the narrowest number type of its places. Heads in the place of a formula are relations.
    """
    sorts = sorts or {}
    order = ["$i", "$real", "$rat", "$int"]
    of = lambda rel, i: SORTS.get(sorts.get((rel, i), ""), "$i")
    types: dict[str, str] = {}
    variables: dict[str, str] = {}

    def walk(x: Node, formula: bool, want: str = "$i") -> None:
        if x.kind in ("variable", "row"):
            have = variables.get(x.val, "$i")
            variables[x.val] = max(have, want, key=order.index)
        elif x.kind == "symbol":
            types.setdefault(mangle(x.val), "$o" if formula else want)
        elif x.kind == "list" and x.items:
            if x.items[0].kind == "op":
                body = x.items[2:] if x.head in ("forall", "exists") else x.items[1:]
                for y in body:
                    walk(y, x.head != "equal")
                return
            rel, args = x.items[0].val, x.items[1:]
            places = [of(rel, i) for i in range(1, len(args) + 1)]
            for y, t in zip(args, places):
                walk(y, False, t)
            value = "$o" if formula else of(rel, 0)
            types[mangle(rel)] = f"({' * '.join(places)}) > {value}" if len(places) > 1 else f"{places[0]} > {value}" if places else value

    walk(n, True)
    mark = lambda v: f"{write(Node('variable', v))}: {variables.get(v, '$i')}"
    text = annotated(name, "axiom", n)
    for v in variables:
        plain = write(Node("variable", v))
        text = re.sub(rf"(?<=[\[ ]){plain}(?=[,\]])(?=[^\[\]]*\] :)", mark(v), text)
    lines = [f"tff({k}_type,type,{k}: {t})." for k, t in types.items()]
    return [*lines, "tff" + text[3:]]


def numeric_variants(n: Node, flexible: dict[tuple[str, int], list[str]], most: int = 9) -> tuple[list[dict[str, str]], bool]:
    """Assignments of number classes to the variables that stand in ``flexible`` places (relation, place): each a variant of
    the formula beside the untyped one; and whether more than ``most`` were left out."""
    options: dict[str, set[str]] = {}

    def walk(x: Node) -> None:
        if x.kind == "list" and x.items:
            for i, y in enumerate(x.items[1:], 1):
                if y.kind == "variable" and (x.items[0].val, i) in flexible:
                    options.setdefault(y.val, set()).update(flexible[x.items[0].val, i])
                walk(y)

    walk(n)
    made = [dict(zip(sorted(options), c)) for c in itertools.product(*(sorted(options[v]) for v in sorted(options)))] if options else []
    return made[:most], len(made) > most


def higher_order(name: str, role: str, n: Node) -> str:
    """A formula as thf: application by ``@``, so that formulas and relations may stand as arguments."""
    from axiomill.plans.prover import free_variables

    def go(x: Node) -> str:
        if x.kind != "list":
            return write(x)
        a = x.items[1:]
        h = x.head if x.items and x.items[0].kind == "op" else None
        if h in ("and", "or"):
            return "(" + (" & " if h == "and" else " | ").join(map(go, a)) + ")"
        if h == "not":
            return f"~ {go(a[0])}"
        if h in ("=>", "<=>", "equal"):
            return f"({go(a[0])} {'=' if h == 'equal' else h} {go(a[1])})"
        if h in ("forall", "exists"):
            return f"({'!' if h == 'forall' else '?'} [{', '.join(write(v) + ': $i' for v in a[0].items)}] : {go(a[1])})"
        return "(" + " @ ".join(map(go, x.items)) + ")"

    free = free_variables(n)
    body = go(n)
    if free:
        body = f"! [{', '.join(write(Node('variable', v)) + ': $i' for v in free)}] : {body}"
    return f"thf({name},{role},{body})."
