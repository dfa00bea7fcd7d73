"""Validation rules over statements. Every rule is one frame of findings ``code, sid, pos, symbol``; a run is their union.

``st`` are statements (operators.store), ``e`` taxonomy edges (child, parent, rel), ``facts`` flat facts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from axiomill.operators import store, taxonomy
from axiomill.plans.cut import cut
from axiomill.plans.skew import union_all
from axiomill.sources.kif import OPERATORS

SEVERITY = {"E": "error", "W": "warning", "H": "hint"}


@dataclass
class Base:
    """What the rules look at; shared frames are made once.

    A rule about one sentence looks at every statement; a rule about a formula, or about each symbol of a formula, looks at
    the statements that stand by themselves with all that is nested in them, and reports under their sid.
    """

    st: DataFrame
    e: DataFrame
    names: taxonomy.Names = field(default_factory=taxonomy.Names)

    def __post_init__(self) -> None:
        self.elements = store.elements(self.st)
        self.facts = store.facts(self.st)
        symbols = self.elements.where("kind = 'symbol' and val is not null").select(F.col("val").alias("node"))
        self.nodes = cut(symbols.union(self.e.select("child")).union(self.e.select("parent")).distinct(), "nodes").df
        marked = taxonomy.marks(self.e, self.names)
        self.kinds = cut(taxonomy.kinds(self.e, self.nodes, self.names, marked), "kinds").df
        self.rooted = marked.where(F.array_contains("tops", self.names.root)).select("node")
        self.arity = cut(taxonomy.arity(self.e, self.nodes, self.names, marked), "arity").df
        self.sorts = cut(taxonomy.argument_sorts(self.facts), "sorts").df

    @cached_property
    def inside(self) -> DataFrame:
        """``top, arg, depth, sid``: what is nested in each root and each statement headed by an operator, and under which
        argument; one join per level."""
        sub = cut(self.elements.where("kind = 'sub'").select("sid", "pos", F.col("val").try_cast("bigint").alias("inner")).dropna(), "subs").df
        tops = self.st.where(F.col("is_root") | (F.col("head_kind") == "op")).select("sid")
        first = sub.join(tops, "sid", "left_semi").select(F.col("sid").alias("top"), F.col("pos").alias("arg"), F.lit(1).alias("depth"), F.col("inner").alias("sid"))
        level = cut(first, "inside", n=F.count("*"), own=store.in_itself())
        out = [level.df]
        while level.seen["n"]:
            if level.seen["own"]:
                raise ValueError("a statement is nested in itself")
            level = level.df.join(sub.select("sid", "inner"), "sid").select("top", "arg", F.lit(len(out) + 1).alias("depth"), F.col("inner").alias("sid"))
            level = cut(level.distinct(), "inside", n=F.count("*"), own=store.in_itself())
            out.append(level.df)
        return cut(union_all(out), "inside").df

    @cached_property
    def symbols(self) -> DataFrame:
        """``sid, symbol, pos``: the symbols of each root with all that is nested in it, and the root's argument under which
        each comes first; 0 is the head."""
        tok = self.elements.where("kind = 'symbol' and val is not null").select("sid", "pos", F.col("val").alias("symbol"))
        roots = self.st.where("is_root").select("sid")
        own = tok.join(roots, "sid", "left_semi")
        nested = self.inside.select("top", "arg", "sid").join(roots.select(F.col("sid").alias("top")), "top", "left_semi").join(tok.select("sid", "symbol"), "sid")
        rows = own.unionByName(nested.select(F.col("top").alias("sid"), F.col("arg").alias("pos"), "symbol"))
        return cut(rows.groupBy("sid", "symbol").agg(F.min("pos").alias("pos")), "symbols").df

    @cached_property
    def variables(self) -> DataFrame:
        """``top, arg, sid, var, listed``: variable tokens in and under each root and operator; listed in a quantifier's list."""
        tok = self.elements.where("kind = 'variable' and val is not null and not startswith(val, '@')").select("sid", "pos", F.col("val").alias("var"))
        q = self.st.where(F.col("head").isin("forall", "exists") & (F.col("head_kind") == "op")).select("sid")
        lists = self.elements.where("pos = 1 and kind = 'sub'").join(q, "sid", "left_semi").select(F.col("val").try_cast("bigint").alias("sid")).distinct()
        tok = tok.join(lists.withColumn("listed", F.lit(True)), "sid", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
        own = tok.select(F.col("sid").alias("top"), F.col("pos").alias("arg"), "sid", "var", "listed")
        return own.unionByName(self.inside.select("top", "arg", "sid").distinct().join(tok.select("sid", "var", "listed"), "sid"))

    @cached_property
    def bindings(self) -> DataFrame:
        """``top, var, bound, free``: of each root, whether a variable stands in an antecedent, in either side of an equivalence
        or in a quantifier's list anywhere in it, and whether in a consequent."""
        two = self.elements.where("pos in (1, 2) and kind = 'sub'").groupBy("sid").agg(F.count("*").alias("k")).where("k = 2").select("sid")
        rules = self.st.where(F.col("head").isin("=>", "<=>") & (F.col("head_kind") == "op")).join(two, "sid", "left_semi").select(F.col("sid").alias("rule"), F.col("head").alias("kind"))
        roots = self.st.where("is_root").select(F.col("sid").alias("top"))
        member = roots.select("top", F.col("top").alias("rule")).unionByName(self.inside.join(roots, "top", "left_semi").select("top", F.col("sid").alias("rule"))).distinct().join(rules, "rule")
        sides = self.variables.where("arg in (1, 2)").select(F.col("top").alias("rule"), "arg", "var").distinct()
        got = member.join(sides, "rule").select("top", "var", ((F.col("kind") == "<=>") | (F.col("arg") == 1)).alias("bound"), ((F.col("kind") == "=>") & (F.col("arg") == 2)).alias("free"))
        listed = self.variables.where("listed").join(roots, "top", "left_semi").select("top", "var", F.lit(True).alias("bound"), F.lit(False).alias("free"))
        return got.unionByName(listed).groupBy("top", "var").agg(F.bool_or("bound").alias("bound"), F.bool_or("free").alias("free"))

    @cached_property
    def existential(self) -> DataFrame:
        """``sid``: statements that are, or hold at any depth, an ``exists``; walked upwards from those, each met once."""
        up = cut(self.elements.where("kind = 'sub'").select(F.col("val").try_cast("bigint").alias("at"), "sid").dropna().distinct(), "up").df
        met = store.Met(["sid"])
        front = cut(self.st.where((F.col("head") == "exists") & (F.col("head_kind") == "op")).select("sid"), "front", n=F.count("*"))
        while True:
            met.add(front.df)
            if not front.seen["n"]:
                return met.all()
            front = cut(met.new(front.df.select(F.col("sid").alias("at")).join(up, "at").select("sid").distinct()), "front", n=F.count("*"))


RULES: dict[str, Callable[[Base], DataFrame]] = {}


def rule(code: str):
    def add(f: Callable[[Base], DataFrame]):
        RULES[code] = f
        return f

    return add


def _rows(df: DataFrame, code: str, sid="sid", pos=None, symbol=None) -> DataFrame:
    col = lambda x, t: F.lit(None).cast(t) if x is None else (F.col(x) if isinstance(x, str) else x).cast(t)
    return df.select(F.lit(code).alias("code"), col(sid, "bigint").alias("sid"), col(pos, "int").alias("pos"), col(symbol, "string").alias("symbol"))


@rule("E001")
def no_path_to_root(b: Base) -> DataFrame:
    """A symbol without a path to the root class, once per formula."""
    return _rows(b.symbols.join(b.rooted.withColumnRenamed("node", "symbol"), "symbol", "left_anti"), "E001", pos="pos", symbol="symbol")


@rule("E002")
def head_is_no_relation(b: Base) -> DataFrame:
    ok = b.kinds.where("is_relation").select(F.col("node").alias("head"))
    return _rows(b.st.where("head_kind = 'symbol' and head is not null").join(ok, "head", "left_anti"), "E002", pos=F.lit(0), symbol="head")


@rule("E004")
def operator_argument_is_no_sentence(b: Base) -> DataFrame:
    """A nested argument of an operator that is a term: headed by a declared function, or by neither a symbol, a variable nor
    an operator, or missing. ``equal`` relates terms; a quantifier's list of variables is no argument. The place counts the
    nested arguments."""
    ops = b.st.where((F.col("head_kind") == "op") & (F.col("head") != "equal"))
    nested = F.filter(F.slice("elements", F.when(F.col("head").isin("forall", "exists"), 3).otherwise(2), 10_000_000), lambda e: e["kind"] == "sub")
    args = ops.where(F.size("elements") > 1).select("sid", F.posexplode(F.transform(nested, lambda e: e["val"].try_cast("bigint"))).alias("i", "inner"))
    inner = b.st.select(F.col("sid").alias("inner"), F.col("head").alias("node"), "head_kind")
    rows = args.join(inner, "inner", "left").join(b.kinds.select("node", "is_function"), "node", "left")
    logical = (F.col("head_kind").isin("op", "variable")) | ((F.col("head_kind") == "symbol") & ~F.coalesce("is_function", F.lit(False)))
    return _rows(rows.where(~F.coalesce(logical, F.lit(False))), "E004", pos=F.col("i") + 1, symbol="node")


@rule("E005")
def wrong_arity(b: Base) -> DataFrame:
    """Declared arities of relations above 0, and the operators' own."""
    rel = b.st.where("head_kind = 'symbol'").join(b.arity.where("arity > 0").withColumnRenamed("node", "head"), "head").where("n_args <> arity")
    fixed = F.create_map(*[F.lit(x) for k, n in OPERATORS.items() if n is not None for x in (k, n)])
    ops = b.st.where("head_kind = 'op'").withColumn("arity", F.try_element_at(fixed, F.col("head"))).where("n_args <> arity")
    return _rows(rel, "E005", symbol="head").unionByName(_rows(ops, "E005", symbol="head"))


@rule("E006")
def outside_domain(b: Base) -> DataFrame:
    """An argument that can't be of the class declared for its place. Variables and literals pass, and so does everything
    where the class is the root.

    An instance must lie at or below the class; a class fits where ``Class`` does; domainSubclass asks for a class at or
    below. A nested sentence fits only the class of formulas, a function's term by the function's range: of a range the
    value is an instance, of a rangeSubclass a class. Only the pairs asked for are looked up in the taxonomy.
    """
    n = b.names
    want = b.sorts.where(F.col("pos") > 0).where(F.col("class").isNotNull() & (F.col("class") != n.root)).select(F.col("rel").alias("head"), "pos", "class", "is_subclass")
    args = b.elements.where("pos > 0 and kind in ('symbol', 'sub', 'op')").join(b.st.where("head_kind = 'symbol'").select("sid", "head"), "sid").join(want, ["head", "pos"])
    range_ = b.sorts.where("pos = 0 and class is not null").select(F.col("rel").alias("fn"), F.col("class").alias("value"), F.col("is_subclass").alias("of_class"))
    inner = b.st.where("head_kind = 'symbol'").select(F.col("sid").alias("inner"), F.col("head").alias("fn"))
    sub = args.where("kind = 'sub'").withColumn("inner", F.col("val").try_cast("bigint")).join(inner, "inner", "left").join(range_, "fn", "left")
    sub = sub.join(b.kinds.select(F.col("node").alias("fn"), "is_predicate", "is_function"), "fn", "left")
    sym = args.where("kind = 'symbol'").join(b.kinds.select(F.col("node").alias("val"), "is_class"), "val", "left")
    both = sym.unionByName(sub, allowMissingColumns=True).unionByName(args.where("kind = 'op'"), allowMissingColumns=True)
    both = cut(both.withColumn("asked", F.when(F.col("kind") == "symbol", F.col("val")).otherwise(F.col("value"))), "arguments").df
    pairs = both.select(F.col("asked").alias("x"), F.col("class").alias("y")).union(both.select(F.lit(n.cls), "class"))
    met = cut(taxonomy.reaches(b.e, pairs), "reached").df
    high = met.where(F.col("x") == n.cls).select(F.col("y").alias("class"), F.lit(True).alias("fits_class"))
    rows = both.join(met.select(F.col("x").alias("asked"), F.col("y").alias("class"), F.lit(True).alias("under")), ["asked", "class"], "left").join(high, "class", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    symbol = F.when(F.col("is_subclass"), yes("is_class") & (yes("under") | (F.col("class") == n.cls))).otherwise((yes("is_class") & yes("fits_class")) | (~yes("is_class") & yes("under")))
    term = F.when(F.col("is_subclass"), yes("is_function") & yes("of_class") & yes("under")).otherwise(
        F.when(F.col("fn").isNull(), False).when(yes("is_predicate"), F.col("class") == n.formula).when(F.col("class") == n.formula, False)
        .when(F.col("value").isNull(), False).when(yes("of_class"), yes("fits_class")).otherwise(yes("under"))
    )
    ok = F.when(F.col("kind") == "symbol", symbol).when(F.col("kind") == "sub", term).otherwise(False)
    return _rows(rows.where(~ok), "E006", pos="pos", symbol="val")


@rule("E007")
def range_declared_twice(b: Base) -> DataFrame:
    r = b.facts.where(F.col("rel").isin("range", "rangeSubclass") & (F.size("args") == 2)).groupBy(F.get("args", F.lit(0)).alias("node")).agg(F.count("*").alias("n"), F.max("sid").alias("sid"))
    return _rows(r.where("n > 1"), "E007", symbol="node")


def _heads(b: Base) -> DataFrame:
    """Every statement headed by a relation."""
    return b.st.where("head_kind = 'symbol' and head is not null").select(F.col("head").alias("node"), "sid").join(b.kinds.where("is_relation"), "node")


@rule("E008")
def function_without_range(b: Base) -> DataFrame:
    have = b.sorts.where("pos = 0").select(F.col("rel").alias("node"), "class")
    return _rows(_heads(b).where("is_function").join(have.where("class is not null").select("node"), "node", "left_anti"), "E008", pos=F.lit(0), symbol="node")


@rule("W009")
def relation_without_arity(b: Base) -> DataFrame:
    return _rows(_heads(b).join(b.arity.where("arity is not null").select("node"), "node", "left_anti"), "W009", pos=F.lit(0), symbol="node")


@rule("E010")
def gap_in_domain(b: Base) -> DataFrame:
    """A place before the last declared one that has no class; the place is counted from 0."""
    d = b.sorts.where("pos > 0 and class is not null").groupBy(F.col("rel").alias("node")).agg(F.max("pos").alias("last"), F.collect_set("pos").alias("have"))
    gaps = d.select("node", F.explode(F.array_except(F.sequence(F.lit(1), F.col("last")), "have")).alias("gap"))
    return _rows(_heads(b).join(gaps, "node"), "E010", pos=F.col("gap") - 1, symbol="node")


@rule("E016")
def nested_sentence_is_missing(b: Base) -> DataFrame:
    sub = b.elements.where("kind = 'sub'").select("sid", "pos", "val", F.col("val").try_cast("bigint").alias("inner"))
    return _rows(sub.join(b.st.select(F.col("sid").alias("inner")), "inner", "left_anti"), "E016", pos="pos", symbol="val")


@rule("E017")
def single_argument_connective(b: Base) -> DataFrame:
    return _rows(b.st.where(F.col("head").isin("and", "or") & (F.col("head_kind") == "op") & (F.col("n_args") == 1)), "E017", symbol="head")


@rule("W020")
def variable_used_once(b: Base) -> DataFrame:
    """A variable whose only use in a formula is in a consequent."""
    once = b.variables.join(b.st.where("is_root").select(F.col("sid").alias("top")), "top", "left_semi").groupBy("top", "var").agg(F.count("*").alias("n")).where("n = 1")
    return _rows(once.join(b.bindings.where("free"), ["top", "var"], "left_semi"), "W020", sid="top", symbol="var")


@rule("W021")
def free_variable_in_consequent(b: Base) -> DataFrame:
    """A variable of a consequent that no antecedent of the formula, enclosing or nested, no side of an equivalence and no
    quantifier binds."""
    return _rows(b.bindings.where("free and not bound"), "W021", sid="top", symbol="var")


def _sides(b: Base, head: str, *places: int) -> DataFrame:
    """Arguments at ``places`` of an operator that hold an ``exists``, reported under their own sid."""
    ops = b.st.where((F.col("head") == head) & (F.col("head_kind") == "op")).select("sid")
    half = b.elements.where(F.col("pos").isin(*places) & (F.col("kind") == "sub")).join(ops, "sid", "left_semi").select(F.col("val").try_cast("bigint").alias("sid"))
    return half.join(b.existential, "sid", "left_semi").distinct()


@rule("W022")
def exists_in_antecedent(b: Base) -> DataFrame:
    return _rows(_sides(b, "=>", 1), "W022", pos=F.lit(0))


@rule("W030")
def exists_under_equivalence(b: Base) -> DataFrame:
    """Once per side of the equivalence."""
    return _rows(_sides(b, "<=>", 1, 2), "W030", pos=F.lit(0))


@rule("E023")
def quantified_variable_unused(b: Base) -> DataFrame:
    q = b.st.where(F.col("head").isin("forall", "exists") & (F.col("head_kind") == "op")).select(F.col("sid").alias("top"))
    v = b.variables.join(q, "top", "left_semi")
    named = v.where("listed and arg = 1").select("top", "var").distinct()
    return _rows(named.join(v.where("arg > 1").select("top", "var").distinct(), ["top", "var"], "left_anti"), "E023", sid="top", symbol="var")


def _symbols(b: Base) -> DataFrame:
    return b.symbols.join(b.kinds.withColumnRenamed("node", "symbol"), "symbol")


@rule("W011")
def function_name(b: Base) -> DataFrame:
    return _rows(_symbols(b).where("is_function").where(~F.col("symbol").rlike(r"^[A-Z].*Fn$")), "W011", pos="pos", symbol="symbol")


@rule("W012")
def predicate_name(b: Base) -> DataFrame:
    return _rows(_symbols(b).where("is_predicate and not is_function").where(F.col("symbol").rlike(r"^[A-Z]")), "W012", pos="pos", symbol="symbol")


@rule("W031")
def other_name(b: Base) -> DataFrame:
    """Only of symbols with a path to the root class: of others it isn't known what they are."""
    rooted = b.rooted.withColumnRenamed("node", "symbol")
    return _rows(_symbols(b).where("not is_predicate and not is_function").where(~F.col("symbol").rlike(r"^[A-Z]")).join(rooted, "symbol", "left_semi"), "W031", pos="pos", symbol="symbol")


@rule("W032")
def no_camel_case(b: Base) -> DataFrame:
    return _rows(b.symbols.where(F.col("symbol").rlike("[_-]")), "W032", pos="pos", symbol="symbol")


@rule("E033")
def neither_predicate_nor_function(b: Base) -> DataFrame:
    return _rows(_symbols(b).where("is_relation and not is_predicate and not is_function"), "E033", pos="pos", symbol="symbol")


def validate(b: Base, codes: list[str] | None = None, sids: DataFrame | None = None, files: list[str] | None = None, severity: dict[str, str] | None = None, scope: str | None = None) -> DataFrame:
    """Findings ``code, severity, sid, pos, symbol`` of the rules named by ``codes`` (all). ``sids``, ``files`` or ``scope`` keep
    those of some statements, whatever the others hold; ``severity`` overrides a code's severity, ``off`` drops it."""
    over = severity or {}
    out = union_all([RULES[c](b) for c in codes or RULES if over.get(c) != "off"])
    level = F.lit(None).cast("string")
    for c in codes or RULES:
        level = F.when(F.col("code") == c, over.get(c, SEVERITY[c[0]])).otherwise(level)
    out = out.withColumn("severity", level)
    if files is not None:
        out = out.join(b.st.where(F.col("file").isin(*files)).select("sid"), "sid", "left_semi")
    if scope is not None:
        out = out.join(b.st.where(F.col("scope") == scope).select("sid"), "sid", "left_semi")
    if sids is not None:
        out = out.join(sids.select("sid").distinct(), "sid", "left_semi")
    return out.select("code", "severity", "sid", "pos", "symbol")


def in_session(st: DataFrame, tax_edges: DataFrame, session: str, names: taxonomy.Names | None = None) -> Base:
    """What a session sees: its own statements and links laid over the base's. ``validate`` with its ``scope`` then reports on
    the session's statements, with the base's declarations in force."""
    scope = f"session:{session}"
    return Base(store.in_scope(st, scope), taxonomy.edges(tax_edges, "base", scope), names or taxonomy.Names())


def doxastic_conflicts(beliefs: DataFrame) -> DataFrame:
    """``agent, kif``: an agent believes something and its negation. ``beliefs`` is (agent, kif) with normalised text."""
    plain = beliefs.select("agent", "kif").distinct()
    inner = F.regexp_extract("kif", r"^\(not (.*)\)$", 1)
    denied = plain.where(F.col("kif").startswith("(not ")).select("agent", inner.alias("kif"))
    return plain.join(denied, ["agent", "kif"], "left_semi")
