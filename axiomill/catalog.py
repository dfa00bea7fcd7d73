"""Queries of the knowledge-base operators over the data folders, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from axiomill.functions import numeric
from axiomill.functions.text import clean
from axiomill.operators import closure, events, introspect, patterns, search, sine, store, taxonomy
from axiomill.plans import datalog
from axiomill.plans.prefix import running_last
from axiomill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"

#: Statements, their elements and the flat facts, as the oracle sees them.
ST = """st AS (SELECT sid, first(parent) AS parent, coalesce(first(elements), []) AS el, first(file) AS file, first(line) AS line, first(kb_scope) AS scope
  FROM sentences WHERE sid IS NOT NULL GROUP BY sid),
sh AS (SELECT *, trim(el[1].val, {ws}) AS head, el[1].kind AS head_kind, (parent IS NULL OR len(parent) = 0) AS is_root FROM st),
x AS (SELECT sid, unnest(el).kind AS kind, trim(unnest(el).val, {ws}) AS val, generate_subscripts(el, 1) - 1 AS pos FROM st),
fl AS (SELECT sid, bool_and(kind IN ('symbol', 'literal') AND val IS NOT NULL) AS flat, list(val ORDER BY pos) AS vals FROM x GROUP BY sid),
fa AS (SELECT sid, head AS rel, vals[2:] AS args, scope FROM sh JOIN fl USING (sid) WHERE is_root AND head_kind = 'symbol' AND flat AND len(el) > 1)"""
#: Symbols by axiom.
USE = ST + """, us AS (SELECT DISTINCT sid, val AS symbol FROM x JOIN sh USING (sid) WHERE kind = 'symbol' AND val IS NOT NULL AND is_root),
oc AS (SELECT symbol, count(*) AS occ FROM us GROUP BY symbol),
gm AS (SELECT sid, min(occ) AS g_min FROM us JOIN oc USING (symbol) GROUP BY sid)"""
TAX = """te AS (SELECT DISTINCT nullif(trim(to_sym, {ws}), '') AS child, nullif(trim(from_sym, {ws}), '') AS parent, nullif(trim(rel, {ws}), '') AS rel FROM tax_edges),
ed AS (SELECT * FROM te WHERE child IS NOT NULL AND parent IS NOT NULL)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{ws}", WS)
        return f

    return add


def _st(spark: SparkSession, d: str) -> DataFrame:
    return store.stored(table(spark, d, "sentences"), f"{d}/sentences.parquet")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return store.facts(_st(spark, d))


def _use(spark: SparkSession, d: str) -> DataFrame:
    return store.occurrences(_st(spark, d).where(store.is_root())).select("sid", "symbol").distinct()


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.edges(table(spark, d, "tax_edges"))


def _one(spark: SparkSession, column: str, *values: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


# --- store scans ------------------------------------------------------------------------------------------------------


@query(f"WITH {ST} SELECT head, count(*) AS n FROM sh WHERE is_root AND head_kind = 'symbol' AND head IS NOT NULL GROUP BY head")
def kb_head_index(spark, d):
    """Distinct heads with their top-level statements."""
    return _st(spark, d).where(store.is_root() & (F.col("head_kind") == "symbol") & F.col("head").isNotNull()).groupBy("head").agg(F.count("*").alias("n"))


@query(f"""WITH {ST} SELECT head, trim(el[2].val, {{ws}}) AS subject, count(*) AS n FROM sh
WHERE is_root AND head_kind = 'symbol' AND head IS NOT NULL AND el[2].kind = 'symbol' AND el[2].val IS NOT NULL GROUP BY 1, 2""")
def kb_subject_index(spark, d):
    """Statements by head and first argument."""
    rows = _st(spark, d).where(store.is_root() & (F.col("head_kind") == "symbol") & F.col("head").isNotNull() & F.col("subject").isNotNull())
    return rows.groupBy("head", "subject").agg(F.count("*").alias("n"))


@query(f"WITH {ST} SELECT val AS symbol, count(*) AS n, sum(CAST(pos = 0 AS BIGINT))::BIGINT AS as_head, count(DISTINCT sid) AS sentences FROM x WHERE kind = 'symbol' AND val IS NOT NULL GROUP BY val")
def kb_occurrences(spark, d):
    """Occurrences of every symbol, as head and in all."""
    o = store.occurrences(_st(spark, d)).groupBy("symbol", "sid").agg(F.count("*").alias("k"), F.count_if(F.col("role") == "head").alias("h"))
    return o.groupBy("symbol").agg(F.sum("k").alias("n"), F.sum("h").alias("as_head"), F.count("*").alias("sentences"))


@query(f"WITH {ST} SELECT rel, len(args) AS arity, count(*) AS n FROM fa GROUP BY ALL")
def kb_facts_by_arity(spark, d):
    """Flat ground facts per relation and number of arguments."""
    return _facts(spark, d).groupBy("rel", F.size("args").cast("long").alias("arity")).agg(F.count("*").alias("n"))


@query(f"WITH {ST} SELECT file, count(*) AS roots, sum(CAST(head_kind = 'op' AND head IN ('=>', '<=>') AS BIGINT))::BIGINT AS rules FROM sh WHERE is_root GROUP BY file")
def kb_file_stats(spark, d):
    """Statements and rules per file."""
    rule = (F.col("head_kind") == "op") & F.col("head").isin("=>", "<=>")
    return _st(spark, d).where(store.is_root()).groupBy("file").agg(F.count("*").alias("roots"), F.sum(F.coalesce(rule, F.lit(None)).cast("long")).alias("rules"))


@query(f"""WITH {ST}, b AS (SELECT trim(el[2].val, {{ws}}) AS symbol, CASE head WHEN 'subclass' THEN 0 WHEN 'instance' THEN 1 WHEN 'subrelation' THEN 2 WHEN 'subAttribute' THEN 3 ELSE 4 END AS tier,
  file, line, sid FROM sh WHERE is_root AND el[2].kind = 'symbol' AND head IN ('subclass', 'instance', 'subrelation', 'subAttribute', 'documentation')
  UNION ALL SELECT head, 6, file, line, sid FROM sh WHERE is_root AND head_kind = 'symbol')
SELECT symbol, sid, tier FROM b WHERE symbol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY tier, file IS NULL, file, line NULLS FIRST, sid) = 1""")
def kb_defining_sentence(spark, d):
    """The statement that introduces each symbol."""
    return store.defining_sentence(_st(spark, d))


@query(f"WITH {ST} SELECT sid, head FROM sh WHERE is_root AND scope IN ('base', 'session:19') AND head IS NOT NULL AND head NOT IN ('domain', 'domainSubclass', 'range', 'rangeSubclass', 'documentation', 'format', 'termFormat', 'externalImage', 'relatedExternalConcept', 'relatedInternalConcept', 'formerName', 'abbreviation', 'conventionalShortName', 'conventionalLongName')")
def kb_axioms_in_session(spark, d):
    """Axioms of the base and one session, without bookkeeping heads."""
    rows = store.in_scope(_st(spark, d), "session:19").where(store.is_root() & F.col("head").isNotNull())
    return rows.where(~F.col("head").isin(*store.EXCLUDED_HEADS)).select("sid", "head")


@query(f"WITH {ST} SELECT sid, bool_or(kind = 'variable') AS has_variable, bool_or(kind = 'literal' AND TRY_CAST(val AS DOUBLE) IS NOT NULL) AS has_numeral FROM x WHERE val IS NOT NULL GROUP BY sid")
def kb_term_facts(spark, d):
    """Whether a statement holds variables and numerals among its own elements."""
    e = store.elements(_st(spark, d)).where("val is not null")
    return e.groupBy("sid").agg(F.bool_or(F.col("kind") == "variable").alias("has_variable"), F.bool_or((F.col("kind") == "literal") & numeric.parse_number(F.col("val")).isNotNull()).alias("has_numeral"))


@query(f"WITH RECURSIVE {ST}, up AS (SELECT sid, unnest(parent) AS p FROM st), r AS (SELECT sid, sid AS root FROM st UNION SELECT r.sid, up.p FROM r JOIN up ON up.sid = r.root) SELECT sid, root FROM r WHERE root NOT IN (SELECT sid FROM up)")
def kb_roots(spark, d):
    """The top-level statement around every statement."""
    st = _st(spark, d)
    return store.roots_of(st, st.select("sid"))


@query(f"""WITH RECURSIVE {ST}, i AS (SELECT sid AS top, 0 AS depth, sid FROM st UNION SELECT i.top, i.depth + 1, TRY_CAST(x.val AS BIGINT) FROM i JOIN x ON x.sid = i.sid AND x.kind = 'sub' WHERE TRY_CAST(x.val AS BIGINT) IS NOT NULL)
SELECT top AS sid, max(depth) AS depth, count(x.pos) FILTER (x.kind <> 'sub') AS size, count(*) FILTER (x.kind = 'variable') = 0 AS is_ground FROM i LEFT JOIN x ON x.sid = i.sid GROUP BY top""")
def kb_term_sizes(spark, d):
    """Depth, size and groundness of every statement with all that is nested in it."""
    return introspect.term_facts(_st(spark, d)).select("sid", "depth", "size", "is_ground")


@query(f"WITH {ST} SELECT args[1] AS node, rel AS class_evidence, count(*) AS n FROM fa WHERE len(args) >= 2 GROUP BY ALL")
def kb_usage_evidence(spark, d):
    """In which relations a symbol stands first, the raw evidence for its class."""
    f = _facts(spark, d).where(F.size("args") >= 2)
    return f.groupBy(F.get("args", F.lit(0)).alias("node"), F.col("rel").alias("class_evidence")).agg(F.count("*").alias("n"))


@query(f"""WITH {USE}, gone AS (SELECT sid FROM sh WHERE file = 'kb/midlevel_core.kif'), u AS (SELECT symbol, count(*) AS occ FROM us WHERE sid NOT IN (SELECT sid FROM gone) GROUP BY symbol) SELECT symbol, occ FROM u""")
def sine_generality_after_removal(spark, d):
    """Generality kept up incrementally when one file's statements go."""
    st = _st(spark, d)
    use = store.occurrences(st.where(store.is_root())).select("sid", "symbol").distinct()
    gone = use.join(st.where("file = 'kb/midlevel_core.kif'").select("sid"), "sid", "left_semi")
    return sine.update_generality(sine.generality(use), removed=gone)


@query(f"""WITH RECURSIVE {ST}, i AS (SELECT sid AS top, sid FROM st UNION SELECT i.top, TRY_CAST(x.val AS BIGINT) FROM i JOIN x ON x.sid = i.sid AND x.kind = 'sub' WHERE TRY_CAST(x.val AS BIGINT) IS NOT NULL)
SELECT top AS sid, count(DISTINCT val) FILTER (kind = 'symbol') AS n_symbols, count(DISTINCT val) FILTER (kind = 'variable') AS n_variables, coalesce(bool_or(kind = 'literal' AND TRY_CAST(val AS DOUBLE) IS NOT NULL), false) AS has_numeral
FROM i LEFT JOIN x ON x.sid = i.sid GROUP BY top""")
def kb_symbols_of(spark, d):
    """Distinct symbols and variables of every statement with all that is nested in it, and whether a number is among it."""
    t = introspect.term_facts(_st(spark, d))
    return t.select("sid", F.size("symbols").cast("long").alias("n_symbols"), F.size("variables").cast("long").alias("n_variables"), "has_numeral")


@query(f"WITH {ST} SELECT sid, val AS var, count(*) AS n FROM x WHERE kind = 'variable' AND val IS NOT NULL GROUP BY sid, val")
def kb_variable_uses(spark, d):
    """How often each variable stands among a statement's own elements."""
    e = store.elements(_st(spark, d)).where("kind = 'variable' and val is not null")
    return e.groupBy("sid", F.col("val").alias("var")).agg(F.count("*").alias("n"))


@query(f"WITH {ST} SELECT f.sid, '(' || f.rel || ' ' || array_to_string(f.args, ' ') || ')' AS kif FROM fa f")
def kb_texts(spark, d):
    """Statements as text; here those of the facts, whose text SQL can make."""
    st = _st(spark, d)
    return store.texts(st).join(store.facts(st).select("sid"), "sid", "left_semi")


@query(f"WITH {ST} SELECT rel, args, min(file) AS file, count(*) AS n FROM fa JOIN st USING (sid) GROUP BY rel, args HAVING count(*) > 1")
def axiom_source_index(spark, d):
    """Facts that stand in the base more than once, with the first file that has them."""
    st = _st(spark, d)
    f = store.facts(st).join(st.select("sid", "file"), "sid")
    return f.groupBy("rel", "args").agg(F.min("file").alias("file"), F.count("*").alias("n")).where("n > 1")


@query(f"WITH {ST} SELECT DISTINCT val AS name, 's__' || replace(replace(val, '-', '_x2d'), '.', '_x2e') AS safe, val AS back FROM x WHERE kind = 'symbol' AND val IS NOT NULL")
def tptp_symbol_names(spark, d):
    """Every symbol as a name other provers take, and back."""
    import pandas as pd

    from axiomill.sources.tptp import demangle, mangle

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "safe": [mangle(n) for n in b["name"]], "back": [demangle(mangle(n)) for n in b["name"]]})

    names = store.elements(_st(spark, d)).where("kind = 'symbol' and val is not null").select(F.col("val").alias("name")).distinct()
    return names.mapInPandas(run, "name string, safe string, back string")


def _kif(spark, d):
    st = _st(spark, d)
    return store.texts(st).join(st.where("is_root").select("sid", "head"), "sid")


@query(f"WITH {ST} SELECT sid, 'fof(kb_' || sid || ',axiom,s__' || replace(rel, '-', '_x2d') || '(' || array_to_string(list_transform(args, lambda a: 's__' || replace(a, '-', '_x2d')), ', ') || ')).' AS line FROM fa WHERE rel IN ('heldBy', 'boundTo', 'observedDuring', 'instance', 'subclass') AND len(list_filter(args, lambda a: NOT regexp_matches(a, '^[A-Za-z][A-Za-z0-9-]*$'))) = 0")
def tptp_export_facts(spark, d):
    """The facts of five relations over plain names in the exchange format."""
    from axiomill.sources.tptp import export

    f = store.facts(_st(spark, d)).where(F.col("rel").isin("heldBy", "boundTo", "observedDuring", "instance", "subclass")).where(F.forall("args", lambda a: a.rlike("^[A-Za-z][A-Za-z0-9-]*$")))
    return export(_kif(spark, d).join(f.select("sid"), "sid", "left_semi")).select("sid", "line")


@query(f"WITH {ST} SELECT row_number() OVER (ORDER BY sid) AS line_no, sid FROM fa")
def tptp_export_indexed(spark, d):
    """The exported facts with their line numbers, and so which statement each line is."""
    from axiomill.sources.tptp import export, indexed

    st = _st(spark, d)
    return indexed(export(_kif(spark, d).join(store.facts(st).select("sid"), "sid", "left_semi"))).select("line_no", "sid")


@query("SELECT item_id, len(axioms) + 2 AS n_lines, query_kif IS NOT NULL AS asks FROM testcase")
def tptp_export_tests(spark, d):
    """Every test as a problem of its own: a title, its axioms and the conjecture."""
    from axiomill.sources.tptp import export_problems

    p = export_problems(table(spark, d, "testcase"))
    return p.select("item_id", F.size(F.split("problem", "\n")).cast("long").alias("n_lines"), F.col("problem").contains(",conjecture,").alias("asks"))


@query(r"SELECT item_id, len(regexp_extract_all(query_kif, '\(')) AS lists, len(regexp_extract_all(query_kif, '\?[A-Za-z0-9]+')) AS variables, regexp_extract(query_kif, '^\(([^ ()]+)', 1) AS head, query_kif AS again FROM testcase WHERE query_kif IS NOT NULL")
def kif_queries_read(spark, d):
    """The tests' queries as trees: lists, variable tokens, head, and the text again."""
    import pandas as pd

    from axiomill.sources.kif import emit, parse, tokens

    def run(batches):
        for b in batches:
            rows = [(i, sum(k == "open" for k, _, _ in tokens(t)), sum(k == "variable" for k, _, _ in tokens(t)), parse(t)[0][0].head, emit(parse(t)[0][0])) for i, t in zip(b["item_id"], b["query_kif"])]
            yield pd.DataFrame(rows, columns=["item_id", "lists", "variables", "head", "again"])

    t = table(spark, d, "testcase").where("query_kif is not null").select("item_id", "query_kif")
    return t.mapInPandas(run, "item_id bigint, lists bigint, variables bigint, head string, again string")


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '&%([A-Za-z][A-Za-z0-9_-]*)', 1)) AS name FROM documents")
def doc_term_links(spark, d):
    """The terms that texts link."""
    return table(spark, d, "documents").select("doc_id", F.explode(search.doc_spans(F.col("text"))).alias("name"))


# --- patterns ---------------------------------------------------------------------------------------------------------


@query(f"WITH {ST} SELECT sid, trim(el[2].val, {{ws}}) AS X, trim(el[3].val, {{ws}}) AS Y FROM sh WHERE head = 'heldBy' AND len(el) = 3")
def pattern_wildcard(spark, d):
    return patterns.lookup(_st(spark, d), "(heldBy ?X ?Y)")


@query(f"WITH {ST} SELECT sid, head AS P, trim(el[2].val, {{ws}}) AS X FROM sh WHERE head IS NOT NULL AND len(el) = 3 AND trim(el[2].val, {{ws}}) = trim(el[3].val, {{ws}}) AND el[2].kind = el[3].kind")
def pattern_repeat_var(spark, d):
    """Statements that relate something to itself."""
    return patterns.lookup(_st(spark, d), "(?P ?X ?X)")


@query(f"""WITH {ST} SELECT a.sid, trim(b.el[1].val, {{ws}}) AS P, trim(b.el[2].val, {{ws}}) AS X, trim(b.el[3].val, {{ws}}) AS Y, trim(c.el[1].val, {{ws}}) AS Q FROM sh a
JOIN sh b ON b.sid = TRY_CAST(a.el[2].val AS BIGINT) JOIN sh c ON c.sid = TRY_CAST(a.el[3].val AS BIGINT)
WHERE a.head = '=>' AND len(a.el) = 3 AND a.el[2].kind = 'sub' AND a.el[3].kind = 'sub' AND len(b.el) = 3 AND len(c.el) = 3 AND c.el[2].kind = b.el[3].kind AND trim(c.el[2].val, {{ws}}) = trim(b.el[3].val, {{ws}})""")
def pattern_nested(spark, d):
    """Rules that chain: the left side's last argument opens the right side."""
    return patterns.lookup(_st(spark, d), "(=> (?P ?X ?Y) (?Q ?Y ?_))")


@query(f"WITH {ST} SELECT sid, len(el) - 3 AS MORE, trim(el[2].val, {{ws}}) AS X, trim(el[len(el)].val, {{ws}}) AS LAST FROM sh WHERE head = 'groupedUnder' AND len(el) >= 3")
def pattern_glob(spark, d):
    return patterns.lookup(_st(spark, d), "(groupedUnder ?X @MORE ?LAST)").select("sid", F.col("MORE").cast("long").alias("MORE"), "X", "LAST")


# --- taxonomy ---------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {TAX}, s AS (SELECT child AS x, parent AS y FROM ed WHERE rel = 'subclass' UNION SELECT s.x, e.parent FROM s JOIN ed e ON e.child = s.y AND e.rel = 'subclass') SELECT x AS node, count(*) AS n_ancestors FROM s GROUP BY x")
def tax_ancestor_counts(spark, d):
    """Strict superclasses of every class."""
    return taxonomy.ancestor_counts(_edges(spark, d))


@query(f"WITH RECURSIVE {TAX}, s AS (SELECT 'PortableDevice' AS c UNION SELECT e.child FROM s JOIN ed e ON e.parent = s.c AND e.rel = 'subclass') SELECT DISTINCT child AS instance FROM ed WHERE rel = 'instance' AND parent IN (SELECT c FROM s)")
def tax_instances_of(spark, d):
    """Instances of one top class or any subclass."""
    return taxonomy.instances_of(_edges(spark, d), "PortableDevice")


@query(f"WITH {TAX}, n AS (SELECT child AS node FROM ed UNION SELECT parent FROM ed), c AS (SELECT child AS node, bool_and(coalesce(rel, '') = 'subclass') AS c FROM ed GROUP BY child) SELECT node, coalesce(c, true) AS is_class, NOT coalesce(c, true) AS is_instance FROM n LEFT JOIN c USING (node)")
def tax_is_class(spark, d):
    e = _edges(spark, d)
    return taxonomy.is_class(e, e.select(F.col("child").alias("node")).union(e.select("parent")))


@query(f"""WITH RECURSIVE {TAX}, k AS (SELECT DISTINCT parent AS node FROM ed GROUP BY parent HAVING count(*) >= 2),
u AS (SELECT child AS seed, child AS node, 0 AS hops FROM (SELECT DISTINCT child FROM ed WHERE rel = 'subAttribute') UNION SELECT u.seed, e.parent, u.hops + 1 FROM u JOIN ed e ON e.child = u.node WHERE u.hops < 1000)
SELECT seed AS node, node AS ancestor, hops FROM u WHERE node IN (SELECT node FROM k) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hops, node) = 1""")
def tax_nearest_ancestor(spark, d):
    """The nearest symbol with several links below it above each attribute."""
    e = _edges(spark, d)
    wide = e.groupBy(F.col("parent").alias("node")).count().where("count >= 2").select("node")
    return taxonomy.nearest_ancestor(e, e.where("rel = 'subAttribute'").select(F.col("child").alias("node")), wide)


@query(f"WITH RECURSIVE {TAX}, s AS (SELECT 'PortableDevice' AS node UNION SELECT e.child FROM s JOIN ed e ON e.parent = s.node) SELECT node FROM s")
def tax_has_ancestor(spark, d):
    """All at or below one class over any link."""
    return taxonomy.has_ancestor(_edges(spark, d), "PortableDevice")


@query(f"WITH {TAX} SELECT child AS node, 'parent' AS side, parent AS other, rel FROM ed UNION ALL SELECT parent, 'child', child, rel FROM ed")
def tax_links(spark, d):
    """Direct links of every symbol, both ways."""
    return taxonomy.ranked_parents(_edges(spark, d))


@query(f"""WITH RECURSIVE {TAX}, m AS (SELECT DISTINCT child AS node, parent AS class FROM ed WHERE rel = 'instance'),
s AS (SELECT child AS x, parent AS y FROM ed WHERE rel = 'subclass' UNION SELECT s.x, e.parent FROM s JOIN ed e ON e.child = s.y AND e.rel = 'subclass'),
k AS (SELECT node, class FROM m WHERE NOT EXISTS (SELECT 1 FROM m o JOIN s ON s.x = o.class AND s.y = m.class WHERE o.node = m.node))
SELECT node, CASE count(k.class) WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Single' ELSE 'Multiple' END AS kind, count(k.class) AS n FROM (SELECT DISTINCT node FROM m) LEFT JOIN k USING (node) GROUP BY node""")
def tax_inferred_class(spark, d):
    """How many most specific classes each instance has."""
    e = _edges(spark, d)
    got = taxonomy.most_specific(e, e.where("rel = 'instance'").select(F.col("child").alias("node"), F.col("parent").alias("class")))
    return got.select("node", "kind", F.size("classes").cast("long").alias("n"))


# --- search and vocabulary --------------------------------------------------------------------------------------------

_DOCS = ST + """, dc AS (SELECT CASE WHEN rel = 'documentation' THEN args[1] ELSE args[2] END AS symbol, rel, CASE WHEN rel = 'documentation' THEN args[2] ELSE args[1] END AS language,
  CASE WHEN len(args[3]) >= 2 AND args[3] LIKE '"%"' THEN args[3][2:-2] ELSE args[3] END AS text, sid FROM fa WHERE rel IN ('documentation', 'termFormat', 'format') AND len(args) = 3)"""


@query(f"""WITH {_DOCS}, h AS (SELECT symbol, sid, strlen(substr(lower(text), 1, strpos(lower(text), 'relay') - 1)) AS off FROM dc WHERE strpos(lower(text), 'relay') > 0),
r AS (SELECT symbol, sid, CASE WHEN lower(symbol) = 'relay' THEN 100 WHEN starts_with(lower(symbol), 'relay') THEN 60 WHEN contains(lower(symbol), 'relay') THEN 40 ELSE 0 END + 6.0 + CASE WHEN off = 0 THEN 4.0 ELSE 2.0 / (1.0 + off) END AS rank FROM h)
SELECT symbol, sid, round(rank, 4) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rank DESC, sid) = 1""")
def search_documentation(spark, d):
    """Ranked hits of a word in the documentation."""
    return search.search(search.docs(_facts(spark, d)), "Relay").select("symbol", "sid", F.round("rank", 4).alias("rank"))


@query(f"""WITH {USE} SELECT symbol, CASE WHEN lower(symbol) = 'reactor' THEN 100.0 WHEN starts_with(lower(symbol), 'reactor') THEN 60.0 ELSE 40.0 END::DOUBLE + 4.0 AS rank FROM oc WHERE contains(lower(symbol), 'reactor')""")
def search_name_match(spark, d):
    """Symbols whose name holds a word, in a base without documentation."""
    none = spark.createDataFrame([], "symbol string, rel string, language string, text string, sid bigint")
    return search.search(none, "reactor", symbols=_use(spark, d).select("symbol").distinct()).select("symbol", "rank")


@query("""WITH h AS (SELECT doc_id, lang, strlen(substr(lower(text), 1, strpos(lower(text), 'validator') - 1)) AS off FROM documents WHERE strpos(lower(text), 'validator') > 0)
SELECT CAST(doc_id AS VARCHAR) AS symbol, round(6.0 + CASE WHEN off = 0 THEN 4.0 ELSE 2.0 / (1.0 + off) END, 4) AS rank FROM h""")
def search_documents_ranked(spark, d):
    """The same ranking over the corpus, a document as its own subject."""
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("symbol"), F.lit("documentation").alias("rel"), F.col("lang").alias("language"), "text", F.col("doc_id").alias("sid"))
    return search.search(t, "validator").select("symbol", F.round("rank", 4).alias("rank"))


@query(f"WITH {_DOCS} SELECT language, count(DISTINCT symbol) AS subjects FROM dc WHERE rel = 'documentation' AND language IS NOT NULL GROUP BY language")
def vocab_language_coverage(spark, d):
    return search.coverage(search.docs(_facts(spark, d)))


@query(f"WITH {_DOCS} SELECT symbol, language, count(*) AS n FROM dc WHERE rel = 'documentation' GROUP BY symbol, language HAVING count(*) > 1")
def completeness_duplicate_doc(spark, d):
    """H002: documented more than once in a language."""
    docs = search.docs(_facts(spark, d))
    return docs.where("rel = 'documentation'").groupBy("symbol", "language").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {TAX}, {_DOCS} SELECT DISTINCT parent AS symbol FROM ed WHERE rel = 'subclass' AND parent NOT IN (SELECT symbol FROM dc WHERE rel = 'documentation')")
def completeness_missing_doc(spark, d):
    """H001: classes with subclasses but without documentation."""
    nodes = _edges(spark, d).where("rel = 'subclass'").select(F.col("parent").alias("node")).distinct()
    return search.completeness(nodes, search.docs(_facts(spark, d))).where("code = 'H001'").select("symbol")


@query(f"""WITH {TAX}, {_DOCS}, n AS (SELECT child AS node FROM ed UNION SELECT parent FROM ed), c AS (SELECT child AS node, bool_and(coalesce(rel, '') = 'subclass') AS c FROM ed GROUP BY child)
SELECT count(*) FILTER (coalesce(c, true)) AS classes, count(*) FILTER (NOT coalesce(c, true)) AS instances, count(*) FILTER (node IN (SELECT symbol FROM dc WHERE rel = 'documentation')) AS documented FROM n LEFT JOIN c USING (node)""")
def vocab_stats(spark, d):
    return vocab_figures(spark, d).select("classes", "instances", "documented")


@query()
def vocab_figures(spark, d):
    """All seven figures of the vocabulary: classes, instances, relations, predicates, functions, documented, labelled."""
    e = _edges(spark, d)
    nodes = e.select(F.col("child").alias("node")).union(e.select("parent")).distinct()
    return search.vocabulary(taxonomy.kinds(e, nodes), search.docs(_facts(spark, d)))


# --- relevance --------------------------------------------------------------------------------------------------------


@query(f"WITH {USE} SELECT symbol, occ FROM oc")
def sine_generality(spark, d):
    return sine.generality(_use(spark, d))


@query(f"WITH {USE} SELECT sid, g_min FROM gm")
def sine_gmin(spark, d):
    return sine.least_generality(_use(spark, d))


_SINE = """, tr AS (SELECT sid, symbol, greatest(1.0, (occ - 0.001) / g_min) AS cost FROM us JOIN oc USING (symbol) JOIN gm USING (sid)),
sd AS (SELECT symbol FROM us JOIN fa USING (sid) WHERE rel = 'subrelation')"""
_SINE_SEEDS = "rel = 'subrelation'"


def _seeds(spark, d):
    return _use(spark, d).join(_facts(spark, d).where(_SINE_SEEDS).select("sid"), "sid", "left_semi").select("symbol").distinct()


@query(f"""WITH RECURSIVE {USE}{_SINE}, ok AS (SELECT sid, symbol FROM tr WHERE cost <= 2),
w AS (SELECT DISTINCT sid FROM ok WHERE symbol IN (SELECT symbol FROM sd) UNION SELECT b.sid FROM w JOIN us a ON a.sid = w.sid JOIN ok b ON b.symbol = a.symbol)
SELECT sid FROM w""")
def sine_select_t2(spark, d):
    """Axioms selected with tolerance 2 from the symbols of the subrelation statements, to any depth."""
    return sine.select(_use(spark, d), _seeds(spark, d), 2.0).select("sid")


@query()
def sine_budget(spark, d):
    """The largest selection of at most 2000 axioms."""
    return sine.within_budget(_use(spark, d), _seeds(spark, d), 2000)


@query(f"WITH {USE}{_SINE} SELECT sid, round(sum(1.0 / occ), 6) AS score FROM us JOIN oc USING (symbol) WHERE occ <= 1500 AND symbol IN (SELECT symbol FROM sd) GROUP BY sid")
def structural_scores(spark, d):
    """Overlap of every axiom with the seeds, rare symbols counting most."""
    return sine.structural_scores(_use(spark, d), _seeds(spark, d)).select("sid", F.round("score", 6).alias("score"))


# --- rule programs ----------------------------------------------------------------------------------------------------


def _pairs(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(f"a{i}") for i, c in enumerate(cols)]).dropna().distinct()


def _geo(spark, d) -> dict[str, DataFrame]:
    n, r, c, s = (table(spark, d, t) for t in ("nation", "region", "customer", "supplier"))
    e = n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name")
    e = e.union(c.join(n, c.c_nationkey == n.n_nationkey).select("c_name", "n_name")).union(s.join(n, s.s_nationkey == n.n_nationkey).select("s_name", "n_name"))
    return {"edge": e.toDF("a0", "a1")}


_GEO = """g AS (SELECT n_name AS x, r_name AS y FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
CLOSURE = "anc(?X, ?Y) :- edge(?X, ?Y). anc(?X, ?Z) :- edge(?X, ?Y), anc(?Y, ?Z)."


@query(f"WITH RECURSIVE {_GEO}, a AS (SELECT x, y FROM g UNION SELECT g.x, a.y FROM g JOIN a ON a.x = g.y) SELECT x AS a0, y AS a1 FROM a")
def closure_customer_geo(spark, d):
    """All ancestors by a recursive program."""
    return datalog.evaluate(spark, datalog.parse(CLOSURE), _geo(spark, d))["anc"]


@query(f"WITH RECURSIVE {_GEO}, a AS (SELECT x, y FROM g WHERE y = (SELECT min(r_name) FROM region) UNION SELECT g.x, a.y FROM g JOIN a ON a.x = g.y) SELECT x FROM a")
def datalog_magic_point(spark, d):
    """What lies below one region, goal-directed."""
    region = table(spark, d, "region").agg(F.min("r_name")).first()[0]
    return datalog.answer(spark, datalog.parse(CLOSURE), _geo(spark, d), datalog.Atom("anc", ("?x", region))).select(F.col("?x").alias("x"))


@query("SELECT DISTINCT c_name AS a0 FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 49 AND o_orderpriority IS NOT NULL")
def datalog_join_chain(spark, d):
    """A chain of joins with a comparison."""
    f = {
        "customer": _pairs(table(spark, d, "customer"), "c_custkey", "c_name"), "orders": _pairs(table(spark, d, "orders").where("o_orderpriority is not null"), "o_orderkey", "o_custkey"),
        "line": _pairs(table(spark, d, "lineitem"), "l_orderkey", "l_quantity"),
    }
    p = datalog.parse("big(?N) :- line(?O, ?Q), orders(?O, ?C), customer(?C, ?N), greaterThanOrEqualTo(?Q, 49).")
    return datalog.evaluate(spark, p, f)["big"]


@query("SELECT c_name AS a0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')")
def datalog_stratified_neg(spark, d):
    """Customers without an urgent order in work."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    f = {"customer": _pairs(table(spark, d, "customer"), "c_custkey", "c_name"), "orders": _pairs(urgent, "o_orderkey", "o_custkey")}
    p = datalog.parse("has(?C) :- orders(?O, ?C). idle(?N) :- customer(?C, ?N), not has(?C).")
    return datalog.evaluate(spark, p, f)["idle"]


@query("SELECT r_name AS a0, n_name AS a1 FROM region, nation")
def datalog_product(spark, d):
    """Literals without a shared variable, within a budget."""
    f = {"region": _pairs(table(spark, d, "region"), "r_name"), "nation": _pairs(table(spark, d, "nation"), "n_name")}
    return datalog.evaluate(spark, datalog.parse("pair(?R, ?N) :- region(?R), nation(?N)."), f, max_tuples=1000)["pair"]


@query("""SELECT CAST(c_custkey AS VARCHAR) AS a0, '_wr0_O_' || c_custkey AS a1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)
UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT'""")
def chase_customers(spark, d):
    """Everyone is promised an urgent order: witnesses for the customers without one."""
    from axiomill.plans import extract
    from axiomill.sources.kif import parse

    x = extract.extract(parse("(=> (customer ?C) (exists (?O) (urgent ?C ?O)))")[0])
    f = {"customer": _pairs(table(spark, d, "customer"), "c_custkey"), "urgent": _pairs(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), "o_custkey", "o_orderkey")}
    return extract.chase(spark, x, f, rounds=1)["urgent"]


@query("""SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS a0 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 49""")
def datalog_discharge(spark, d):
    """Forward closure of a rule whose head has no stored facts, over all orders and lines."""
    f = {"orders": _pairs(table(spark, d, "orders"), "o_orderkey", "o_custkey"), "line": _pairs(table(spark, d, "lineitem"), "l_orderkey", "l_quantity")}
    p = datalog.parse("buys(?C) :- line(?O, ?Q), orders(?O, ?C), greaterThanOrEqualTo(?Q, 49).")
    return datalog.discharge(spark, p, f)[0]["buys"]


@query(f"WITH {ST}, e AS (SELECT args[1] AS a, args[2] AS b FROM fa WHERE rel = 'heldBy' AND len(args) = 2) SELECT a AS a0, b AS a1 FROM e UNION SELECT b, a FROM e")
def datalog_symmetric_schema(spark, d):
    """The symmetric rule template over one relation."""
    f = {"heldBy": _pairs(store.binary_facts(_st(spark, d), "heldBy"), "x", "y")}
    return datalog.evaluate(spark, datalog.parse("s(?X, ?Y) :- heldBy(?X, ?Y). s(?X, ?Y) :- s(?Y, ?X)."), f)["s"]


@query(f"WITH {ST} SELECT DISTINCT args[1] AS a0, args[2] AS a1 FROM fa WHERE rel IN ('heldBy', 'boundTo') AND len(args) = 2")
def datalog_subrelation_schema(spark, d):
    """The subrelation rule template: what holds below holds above."""
    st = _st(spark, d)
    f = {r: _pairs(store.binary_facts(st, r), "x", "y") for r in ("heldBy", "boundTo")}
    return datalog.evaluate(spark, datalog.parse("up(?X, ?Y) :- heldBy(?X, ?Y). up(?X, ?Y) :- boundTo(?X, ?Y)."), f)["up"]


@query(f"""WITH RECURSIVE {ST}, e AS (SELECT DISTINCT args[1] AS x, args[2] AS y FROM fa WHERE rel = 'observedDuring' AND len(args) = 2),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), c AS (SELECT x AS n, x AS m FROM b UNION SELECT c.n, b.y FROM c JOIN b ON b.x = c.m) SELECT n AS node, min(m) AS component FROM c GROUP BY n""")
def egd_components(spark, d):
    """Classes of symbols made equal by one relation; the least name stands for a class."""
    return closure.components(store.binary_facts(_st(spark, d), "observedDuring").select("x", "y"))


@query(f"""WITH RECURSIVE {TAX}, top AS (SELECT parent AS a FROM ed WHERE rel = 'subclass' GROUP BY parent ORDER BY count(*) DESC, parent LIMIT 6),
p AS (SELECT x.a, y.a AS b FROM top x JOIN top y ON x.a < y.a), u AS (SELECT a AS seed, a AS node FROM top UNION SELECT u.seed, e.child FROM u JOIN ed e ON e.parent = u.node)
SELECT l.node, p.a, p.b FROM p JOIN u l ON l.seed = p.a JOIN u r ON r.seed = p.b AND r.node = l.node""")
def denial_violations(spark, d):
    """Symbols at or below two of the six widest classes, taken as disjoint."""
    e = _edges(spark, d)
    top = e.where("rel = 'subclass'").groupBy("parent").count().orderBy(F.desc("count"), "parent").limit(6).agg(F.sort_array(F.collect_list("parent")).alias("m"))
    one = top.select(F.lit("disjointDecomposition").alias("rel"), F.concat(F.array(F.lit("all")), "m").alias("args"))
    return taxonomy.denial_violations(e, taxonomy.disjoint_pairs(one))


# --- time -------------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN true WHEN event_type = 'error' THEN false END AS t FROM events)
SELECT event_id, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS holds FROM e""")
def ec_holds_state(spark, d):
    """Inertia: whether a user's state, begun by a signup and ended by an error, holds at each of their events."""
    e = table(spark, d, "events").withColumn("t", F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "error", False))
    # days are the buckets, so that a user with very many events takes one task a day
    e = e.select("user_id", "ts", "event_id", "t", F.coalesce(F.date_trunc("day", "ts"), F.lit("1970-01-01").cast("timestamp")).alias("day"))
    return running_last(e, ["user_id"], "day", ["ts", "event_id"], "t", "on").select("event_id", F.coalesce("on", F.lit(False)).alias("holds"))


@query("""WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS c, o_orderkey AS k, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders)
SELECT 'E:' || a.k AS x, 'B:' || b.k AS y FROM o a JOIN o b ON a.c = b.c AND a.i < b.i""")
def temporal_before_closure(spark, d):
    """Orders of a customer as intervals, each earlier than the next: which ends lie strictly before which beginnings."""
    o = table(spark, d, "orders").where("o_custkey is not null")
    w = W.partitionBy("o_custkey").orderBy(F.asc_nulls_last("o_orderdate"), F.asc_nulls_last("o_orderkey"))
    rel = o.select("o_custkey", F.lit("earlier").alias("rel"), F.col("o_orderkey").cast("string").alias("i"), F.lead("o_orderkey").over(w).cast("string").alias("j")).where("j is not null")
    c = events.closure_within(rel, ["o_custkey"], events.steps(), "E:", "B:")
    return c.where("strict").select("x", "y")


# --- scalar functions -------------------------------------------------------------------------------------------------


@query(f"WITH {ST} SELECT val, CASE WHEN contains(val, '/') THEN 'Rational' WHEN contains(val, '.') OR contains(lower(val), 'e') THEN 'Real' ELSE 'Integer' END AS sort, count(*) AS n FROM x WHERE kind = 'literal' AND regexp_matches(val, '^[-+0-9]') GROUP BY val")
def num_sort_class(spark, d):
    """Sorts of the numeric literals."""
    e = store.elements(_st(spark, d)).where("kind = 'literal'").where(F.col("val").rlike("^[-+0-9]"))
    return e.groupBy("val").agg(F.count("*").alias("n")).select("val", numeric.literal_sort(F.col("val")).alias("sort"), "n")


@query("""SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_retailprice / (p_size % 5) END AS v, p_retailprice > p_size * 40 AS gt FROM part""")
def num_arith_fold(spark, d):
    """Ground arithmetic; division by zero stays symbolic."""
    p = table(spark, d, "part")
    v = numeric.arithmetic(F.lit("DivisionFn"), F.col("p_retailprice"), (F.col("p_size") % 5).cast("double"))
    return p.select("p_partkey", v.alias("v"), numeric.comparison(F.lit("greaterThan"), F.col("p_retailprice"), F.col("p_size") * 40.0).alias("gt"))


@query("SELECT p_partkey, floor(p_retailprice) AS low, ceil(p_retailprice) AS high, CAST(p_size AS DOUBLE) % 7 AS rest FROM part")
def num_round_prices(spark, d):
    """Rounding down and up, and remainders."""
    p = table(spark, d, "part")
    v = lambda n, x, y=None: numeric.rounding(F.lit(n), x, y)
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    return p.select("p_partkey", v("FloorFn", price).alias("low"), v("CeilingFn", price).alias("high"), v("RemainderFn", size, F.lit(7.0)).alias("rest"))


@query("WITH t AS (SELECT DISTINCT CAST(o_orderdate AS DATE)::VARCHAR AS time FROM orders) SELECT time, lead(time) OVER (ORDER BY time) AS next FROM t")
def temporal_days_in_order(spark, d):
    """The days on which something was ordered, each with the next."""
    return events.order_chain(table(spark, d, "orders").select(F.to_date("o_orderdate").cast("string").alias("time")), 7)


@query("SELECT md5(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) AS fp, count(*) AS n, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dedup_fingerprint(spark, d):
    """Texts delivered more than once, by the digest of their normalised form."""
    body = F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(body).alias("fp"))
    return rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n > 1")


# --- ingest and runs --------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT DISTINCT snap_no, file, elements::VARCHAR AS fp FROM axiom_snapshots WHERE file IS NOT NULL AND snap_no IS NOT NULL),
s AS (SELECT snap_no, lead(snap_no) OVER (ORDER BY snap_no) AS later FROM (SELECT DISTINCT snap_no FROM axiom_snapshots WHERE snap_no IS NOT NULL)),
a AS (SELECT later AS snap_no, file, fp FROM t JOIN s USING (snap_no) WHERE later IS NOT NULL), b AS (SELECT * FROM t WHERE snap_no > (SELECT min(snap_no) FROM s))
SELECT coalesce(a.snap_no, b.snap_no) AS snap_no, coalesce(a.file, b.file) AS file, count(*) FILTER (a.file IS NULL) AS added, count(*) FILTER (b.file IS NULL) AS removed, count(*) FILTER (a.file IS NOT NULL AND b.file IS NOT NULL) AS unchanged
FROM a FULL JOIN b ON a.snap_no = b.snap_no AND a.file = b.file AND a.fp IS NOT DISTINCT FROM b.fp GROUP BY 1, 2""")
def source_diff(spark, d):
    """Statements added, removed and unchanged per file, by fingerprint, between every two consecutive deliveries; snap_no is the later."""
    from axiomill.streaming.ingest import diff

    t = table(spark, d, "axiom_snapshots").where("snap_no is not null")
    # deliveries are few: one row each
    snaps = sorted(r[0] for r in t.select("snap_no").distinct().collect())
    t = t.where("file is not null").select("snap_no", "file", F.coalesce(F.xxhash64("elements"), F.lit(0)).alias("fp"))
    pairs = spark.createDataFrame(list(zip(snaps, snaps[1:])), "snap_no int, later int")
    old = t.join(F.broadcast(pairs), "snap_no").select(F.struct(F.col("later").alias("snap_no"), "file").alias("file"), "fp")
    new = t.join(F.broadcast(pairs.select(F.col("later").alias("snap_no"))), "snap_no").select(F.struct("snap_no", "file").alias("file"), "fp")
    got = diff(old, new)
    return got.groupBy("file.snap_no", "file.file").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "unchanged")])


@query("SELECT file, origin, CASE WHEN s.file IS NULL THEN 'unused' WHEN mtime IS NULL AND content_hash IS NULL THEN 'unknown' WHEN last_in > mtime THEN 'fresh' ELSE 'stale' END AS state FROM kb_sources LEFT JOIN (SELECT file, max(ingested_at) AS last_in FROM sentences GROUP BY file) s USING (file)")
def source_freshness(spark, d):
    """Files against what was taken in from them."""
    s = table(spark, d, "sentences").groupBy("file").agg(F.max("ingested_at").alias("last_in"), F.lit(True).alias("used"))
    k = table(spark, d, "kb_sources").join(s, "file", "left")
    state = F.when(F.col("used").isNull(), "unused").when(F.col("mtime").isNull() & F.col("content_hash").isNull(), "unknown").when(F.col("last_in") > F.col("mtime"), "fresh").otherwise("stale")
    return k.select("file", "origin", state.alias("state"))


@query("""WITH r AS (SELECT DISTINCT * FROM sweep WHERE config IS NOT NULL)
SELECT config, count(*) AS runs, count(*) FILTER (solved) AS solved, sum(ms) FILTER (solved) AS ms_solved, count(DISTINCT problem) FILTER (solved) AS problems FROM r GROUP BY config""")
def sweep_summary(spark, d):
    """Fitness of each configuration: solved runs, and time over them."""
    r = table(spark, d, "sweep").where("config is not null").distinct()
    ok = F.coalesce("solved", F.lit(False))
    per = r.groupBy("config", "problem").agg(F.count("*").alias("k"), F.count_if(ok).alias("s"), F.sum(F.when(ok, F.col("ms"))).alias("m"))
    return per.groupBy("config").agg(F.sum("k").alias("runs"), F.sum("s").alias("solved"), F.sum("m").alias("ms_solved"), F.count_if((F.col("s") > 0) & F.col("problem").isNotNull()).alias("problems"))


@query("SELECT upper(trim(status)) AS status, CASE upper(trim(status)) WHEN 'THEOREM' THEN 'Proved' WHEN 'SATISFIABLE' THEN 'Disproved' WHEN 'TIMEOUT' THEN 'Timeout' WHEN 'RESOURCEOUT' THEN 'Timeout' WHEN 'GAVEUP' THEN 'Unknown' ELSE 'InputError' END AS verdict, count(*) AS n FROM sweep GROUP BY 1, 2")
def szs_status(spark, d):
    """Prover statuses mapped to verdicts."""
    from axiomill.sources.szs import verdict

    s = F.upper(F.trim("status"))
    return table(spark, d, "sweep").select(s.alias("status")).groupBy("status").agg(F.count("*").alias("n")).select("status", verdict(F.col("status")).alias("verdict"), "n")


@query()
def sweep_portfolio(spark, d):
    """Configurations in the order in which each adds most solved problems."""
    from axiomill.operators.runs import greedy_portfolio

    r = table(spark, d, "sweep").where("solved").select("config", "problem").dropna().distinct()
    return greedy_portfolio(r, 5)


# --- validation -------------------------------------------------------------------------------------------------------

_INSIDE = ST + """, ins AS (SELECT sid AS top, pos AS arg, TRY_CAST(val AS BIGINT) AS sid FROM x WHERE kind = 'sub' UNION SELECT ins.top, ins.arg, TRY_CAST(x.val AS BIGINT) FROM ins JOIN x ON x.sid = ins.sid AND x.kind = 'sub'),
va AS (SELECT sid AS top, pos AS arg, val AS var FROM x WHERE kind = 'variable' AND val IS NOT NULL UNION ALL SELECT ins.top, ins.arg, x.val FROM (SELECT DISTINCT * FROM ins) ins JOIN x ON x.sid = ins.sid WHERE x.kind = 'variable' AND x.val IS NOT NULL)"""


def _findings(spark: SparkSession, d: str, code: str) -> DataFrame:
    from axiomill.operators import validate

    return validate.validate(validate.Base(_st(spark, d), _edges(spark, d)), [code]).select("sid", "symbol")


@query()
def valid_arity(spark, d):
    """E005: a relation or operator with another number of arguments than declared."""
    return _findings(spark, d, "E005")


@query()
def valid_domain(spark, d):
    """E006: an argument outside the class declared for its place."""
    return _findings(spark, d, "E006")


@query()
def valid_all(spark, d):
    """Every validation rule over the whole tables."""
    from axiomill.operators import validate

    return validate.validate(validate.Base(_st(spark, d), _edges(spark, d)))


@query(f"WITH {ST} SELECT sid, val AS symbol FROM x WHERE kind = 'sub' AND TRY_CAST(val AS BIGINT) IS NOT NULL AND TRY_CAST(val AS BIGINT) NOT IN (SELECT sid FROM st)")
def valid_missing_sentence(spark, d):
    """E016: a nested statement that isn't there."""
    return _findings(spark, d, "E016")


_FORMULA = """, fo AS (SELECT sid AS top, sid FROM sh WHERE is_root UNION SELECT fo.top, TRY_CAST(x.val AS BIGINT) FROM fo JOIN x ON x.sid = fo.sid AND x.kind = 'sub' WHERE TRY_CAST(x.val AS BIGINT) IS NOT NULL)"""


@query(f"WITH RECURSIVE {ST}{_FORMULA} SELECT DISTINCT top AS sid, val AS symbol FROM fo JOIN x ON x.sid = fo.sid WHERE kind = 'symbol' AND regexp_matches(val, '[_-]')")
def valid_camel_case(spark, d):
    """W032: names with underscores or hyphens, once per formula."""
    return _findings(spark, d, "W032")


@query(f"""WITH RECURSIVE {_INSIDE}{_FORMULA}, im AS (SELECT sid, head FROM sh WHERE head IN ('=>', '<=>') AND head_kind = 'op' AND el[2].kind = 'sub' AND el[3].kind = 'sub'),
bi AS (SELECT fo.top, va.var, bool_or(head = '<=>' OR arg = 1) AS bound, bool_or(head = '=>' AND arg = 2) AS free FROM fo JOIN im ON im.sid = fo.sid JOIN va ON va.top = im.sid WHERE arg IN (1, 2) AND NOT starts_with(var, '@') GROUP BY fo.top, va.var),
ql AS (SELECT DISTINCT fo.top, x.val AS var FROM fo JOIN sh ON sh.sid = fo.sid JOIN x ON x.sid = TRY_CAST(sh.el[2].val AS BIGINT) WHERE sh.head IN ('forall', 'exists') AND sh.head_kind = 'op' AND sh.el[2].kind = 'sub' AND x.kind = 'variable')
SELECT top AS sid, var AS symbol FROM bi WHERE free AND NOT bound AND NOT EXISTS (SELECT 1 FROM ql WHERE ql.top = bi.top AND ql.var = bi.var)""")
def valid_free_variable(spark, d):
    """W021: a variable of a consequent that nothing in the formula binds."""
    return _findings(spark, d, "W021")
