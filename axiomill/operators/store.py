"""The statement store as frames: statements, elements, occurrences, facts, and the scans over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from axiomill.functions.text import clean
from axiomill.plans.cut import cut
from axiomill.plans.skew import union_all

# Bookkeeping heads that say nothing to a prover.
EXCLUDED_HEADS = (
    "domain", "domainSubclass", "range", "rangeSubclass", "documentation", "format", "termFormat", "externalImage", "relatedExternalConcept", "relatedInternalConcept", "formerName",
    "abbreviation", "conventionalShortName", "conventionalLongName",
)

TAXONOMY = ("subclass", "instance", "subrelation", "subAttribute")


ELEMENTS = "array<struct<kind:string,val:string>>"


def statements(sentences: DataFrame) -> DataFrame:
    """One row per distinct non-null sid: ``sid, parent, is_root, elements, head, head_kind, subject, n_args, file, line, scope``.

    Values are trimmed; null elements become an empty array, whose head is null. ``subject`` is the first argument where
    it is a symbol. Deliveries of a sid agree in content; should they differ, the least row stands for it. A statement told
    by itself and within others is a root and has all their sids as ``parent``. Rows of a repeated sid are combined before
    the shuffle. Take in a table once, with ``store``, and query that: every scan of this frame shuffles.
    """
    trimmed = F.transform("elements", lambda e: F.struct(e["kind"].alias("kind"), clean(e["val"]).alias("val")))
    alone = F.col("parent").isNull() | (F.size("parent") == 0)
    rows = sentences.where("sid is not null").select(
        "sid", alone.alias("alone"), F.when(~alone, F.col("parent")).alias("p"),
        F.struct(F.coalesce(trimmed, F.array().cast(ELEMENTS)).alias("elements"), "file", "line", F.col("kb_scope").alias("scope")).alias("s"),
    )
    one = rows.groupBy("sid").agg(F.bool_or("alone").alias("is_root"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("p")))).alias("parent"), F.min("s").alias("s")).select("sid", "is_root", "parent", "s.*")
    first, second = F.try_element_at("elements", F.lit(1)), F.try_element_at("elements", F.lit(2))
    return one.select(
        "sid", F.when(F.size("parent") > 0, F.col("parent")).alias("parent"), "is_root", "elements", first["val"].alias("head"), first["kind"].alias("head_kind"),
        F.when(second["kind"] == "symbol", second["val"]).alias("subject"), F.greatest(F.size("elements") - 1, F.lit(0)).alias("n_args"), "file", "line", "scope",
    )


def store(sentences: DataFrame) -> DataFrame:
    """``statements`` written once, in order of head and subject, hot heads over several files.

    What a query asks of head, subject, scope or place reaches the scan, which skips the files and row groups that lack
    it; no query shuffles the statements again.
    """
    rows = statements(sentences).repartitionByRange("head", "subject", "sid").sortWithinPartitions("head", "subject", "sid")
    return cut(rows, "store").df


_TAKEN: dict[tuple, DataFrame] = {}


def stored(sentences: DataFrame, path: str) -> DataFrame:
    """The ``store`` of a table read from ``path``, taken in once per application and state of its files."""
    spark = sentences.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    seen, held = fs.getFileStatus(p), fs.getContentSummary(p)
    key = (spark.sparkContext.applicationId, path, seen.getModificationTime(), held.getLength(), held.getFileCount())
    if key not in _TAKEN:
        _TAKEN[key] = store(sentences)
    return _TAKEN[key]


def is_root() -> Column:
    """Whether a statement stands by itself."""
    return F.col("is_root")


def elements(st: DataFrame) -> DataFrame:
    """``sid, pos, kind, val`` with pos 0 for the head."""
    return st.select("sid", F.posexplode("elements").alias("pos", "e")).select("sid", "pos", "e.kind", "e.val")


def occurrences(st: DataFrame) -> DataFrame:
    """Every symbol token: ``symbol, sid, pos, role, file, line``."""
    rows = st.select("sid", "file", "line", F.posexplode("elements").alias("pos", "e")).where("e.kind = 'symbol' and e.val is not null")
    return rows.select(F.col("e.val").alias("symbol"), "sid", "pos", F.when(F.col("pos") == 0, "head").otherwise("arg").alias("role"), "file", "line")


def facts(st: DataFrame) -> DataFrame:
    """Flat ground statements headed by a symbol, at the top level: ``rel, args, sid, scope``."""
    flat = F.forall("elements", lambda e: e["kind"].isin("symbol", "literal") & e["val"].isNotNull())
    rows = st.where(is_root() & (F.col("head_kind") == "symbol") & (F.col("n_args") > 0) & flat)
    args = F.transform(F.slice("elements", 2, 10_000_000), lambda e: e["val"])
    return rows.select(F.col("head").alias("rel"), args.alias("args"), "sid", "scope")


def binary_facts(st: DataFrame, rel: str) -> DataFrame:
    """``x, y`` of the two-place facts of a relation; the filter on the head reaches the scan's rows first."""
    return facts(st.where(F.col("head") == rel)).where(F.size("args") == 2).select(F.get("args", F.lit(0)).alias("x"), F.get("args", F.lit(1)).alias("y"), "sid", "scope")


def in_itself(top: str = "top", sid: str = "sid") -> Column:
    """Counts the rows of a level of nesting in which a statement lies in itself; then levels would never end."""
    return F.count_if(F.col(top) == F.col(sid))


def in_scope(df: DataFrame, session: str | None = None, tombstones: DataFrame | None = None, scope: str = "scope") -> DataFrame:
    """The rows of the base, and of one session laid over it, without removed sids."""
    view = df.where(F.col(scope).isin("base", *([session] if session else [])))
    return view if tombstones is None else view.join(tombstones.select("sid").distinct(), "sid", "left_anti")


def real_symbol(c: Column) -> Column:
    """Neither a variable, nor a scoped variable's key, nor a Skolem name."""
    return ~(c.rlike(r"^[?@]") | c.rlike(r"^.+__[0-9]+$") | c.rlike(r"^sk_?[0-9]+$"))


class Met:
    """Rows met by a loop of written steps. Every FOLD steps the frames are written as one, so plans stay small."""

    FOLD = 16

    def __init__(self, columns: list[str]):
        self.columns, self.frames = columns, []

    def add(self, df: DataFrame) -> None:
        self.frames.append(df)
        if len(self.frames) > self.FOLD:
            self.frames = [cut(self.all(), "met").df]

    def all(self) -> DataFrame:
        return union_all(self.frames)

    def new(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose ``columns`` weren't met."""
        return df.join(self.all().select(*self.columns), self.columns, "left_anti")


def roots_of(st: DataFrame, found: DataFrame) -> DataFrame:
    """``sid, root``: the top-level statement around each of ``found`` (sid); one equi-join per level of nesting.

    A statement nested in several gets a row for each, and one told by itself as well is its own; one whose parents can't
    be found stands for itself. Levels are followed however deep they go; what a statement was already followed to is not
    followed again, so cycles end.
    """
    up = cut(st.select(F.col("sid").alias("at"), F.explode("parent").alias("up")).where("up is not null"), "parents").df
    # those that stand by themselves though they have parents too
    both = st.where("is_root and parent is not null").select(F.col("sid").alias("at"))
    front = cut(found.select("sid", F.col("sid").alias("at")).distinct(), "roots", n=F.count("*"))
    met = Met(["sid", "at"])
    done = Met(["sid", "root"])
    while front.seen["n"]:
        met.add(front.df)
        done.add(front.df.join(up, "at", "left_anti").unionByName(front.df.join(both, "at", "left_semi")).select("sid", F.col("at").alias("root")))
        front = cut(met.new(front.df.join(up, "at").select("sid", F.col("up").alias("at")).distinct()), "roots", n=F.count("*"))
    return done.all().distinct() if done.frames else found.select("sid", F.col("sid").alias("root"))


def texts(st: DataFrame) -> DataFrame:
    """``sid, kif``: each statement as text with all that is nested in it, made from the inside out, one join per level.

    A statement with a nested one that isn't there, or with nothing in it, has no text.
    """
    own = st.where(F.size("elements") > 0).select("sid", "elements")
    nested = F.filter("elements", lambda e: e["kind"] == "sub")
    plain = F.forall("elements", lambda e: (e["kind"] != "sub") & e["val"].isNotNull())
    done = Met(["sid"])
    done.add(cut(own.where(plain).select("sid", F.concat(F.lit("("), F.array_join(F.transform("elements", lambda e: e["val"]), " "), F.lit(")")).alias("kif")), "texts").df)
    left = cut(own.where((F.size(nested) > 0) & F.forall("elements", lambda e: e["val"].isNotNull())), "left", n=F.count("*"))
    while left.seen["n"]:
        places = left.df.select("sid", F.posexplode("elements").alias("i", "e")).select("sid", "i", "e.val", F.when(F.col("e.kind") == "sub", F.col("e.val").try_cast("bigint")).alias("inner"), (F.col("e.kind") == "sub").alias("s"))
        known = done.all().select(F.col("sid").alias("inner"), "kif")
        filled = places.join(known, "inner", "left").groupBy("sid").agg(
            F.bool_and(~F.col("s") | F.col("kif").isNotNull()).alias("whole"), F.array_sort(F.collect_list(F.struct("i", F.coalesce("kif", "val").alias("t")))).getField("t").alias("ts")
        )
        fresh = cut(filled.where("whole").select("sid", F.concat(F.lit("("), F.array_join("ts", " "), F.lit(")")).alias("kif")), "texts", n=F.count("*"))
        if not fresh.seen["n"]:
            break
        done.add(fresh.df)
        left = cut(left.df.join(fresh.df, "sid", "left_anti"), "left", n=F.count("*"))
    return done.all()


def defining_sentence(st: DataFrame) -> DataFrame:
    """``symbol, sid``: where a symbol is introduced, by subclass, instance, subrelation, subAttribute, documentation,
    in this order, else by any other statement it heads or opens; then by the smallest file, line and sid.

    A minimum over structs, so hot symbols are combined before the shuffle.
    """
    order = {"subclass": 0, "instance": 1, "subrelation": 2, "subAttribute": 3, "documentation": 4}
    first_arg = F.try_element_at("elements", F.lit(2))
    tier = F.lit(5)
    for head, n in order.items():
        tier = F.when(F.col("head") == head, n).otherwise(tier)
    rows = st.where(is_root() & (first_arg["kind"] == "symbol") & F.col("head").isin(*order)).select(first_arg["val"].alias("symbol"), tier.alias("tier"), "file", "line", "sid")
    own = st.where(is_root() & (F.col("head_kind") == "symbol")).select(F.col("head").alias("symbol"), F.lit(6).alias("tier"), "file", "line", "sid")
    best = F.min(F.struct("tier", F.col("file").isNull().alias("unplaced"), "file", "line", "sid"))
    return rows.unionByName(own).where("symbol is not null").groupBy("symbol").agg(best.alias("b")).select("symbol", "b.sid", "b.tier")
