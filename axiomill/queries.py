"""The library's own queries over the data folders, and the SQL that states the same for an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from axiomill.functions.text import clean
from axiomill.operators import hierarchy as hier, hotkeys, snapshots
from axiomill.plans.skew import union_all
from axiomill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The blanks that TRIM takes off in the oracle's SQL.
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{ws}", WS)
        return f

    return add


# --- 1: hierarchies ---------------------------------------------------------------------------------------------------

_LINKS = """e AS (SELECT DISTINCT nullif(trim(to_sym, {ws}), '') AS node, nullif(trim(from_sym, {ws}), '') AS up FROM tax_edges),
l AS (SELECT * FROM e WHERE node IS NOT NULL AND up IS NOT NULL),
n AS (SELECT node FROM l UNION SELECT up FROM l),
t AS (SELECT node, node AS root, 0 AS hops, node AS path FROM n WHERE node NOT IN (SELECT node FROM l)
  UNION ALL SELECT l.node, t.root, t.hops + 1, t.path || '/' || l.node FROM t JOIN l ON l.up = t.node)"""
_RING = """, x AS (SELECT * FROM l WHERE node NOT IN (SELECT node FROM t)),
w AS (SELECT node AS a, up AS b FROM x UNION SELECT w.a, x.up FROM w JOIN x ON x.node = w.b)"""


@query(f"""WITH RECURSIVE {_LINKS}{_RING}
SELECT node, root AS root_sym, CAST(hops AS INTEGER) AS hops FROM t
UNION ALL SELECT DISTINCT node, '', CAST(CASE WHEN node IN (SELECT a FROM w WHERE a = b) THEN -1 ELSE -2 END AS INTEGER) FROM x""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of each symbol; ('', -1) on a cycle, ('', -2) below one."""
    h = hier.hierarchy(table(spark, d, "tax_edges"), "to_sym", "from_sym")
    return h.select(
        "node",
        F.coalesce("root", F.lit("")).alias("root_sym"),
        F.when(F.col("state") == "tree", F.col("depth")).when(F.col("state") == "cycle", -1).otherwise(-2).cast("int").alias("hops"),
    )


@query(f"""WITH RECURSIVE {_LINKS} SELECT node, path FROM t""")
def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full path from the root down to each symbol, as text."""
    h = hier.hierarchy(table(spark, d, "tax_edges"), "to_sym", "from_sym")
    return hier.paths(h).select("node", F.array_join("path", "/").alias("path"))


@query(f"""WITH RECURSIVE {_LINKS}, a AS (SELECT node, up FROM l WHERE node IN (SELECT node FROM t) UNION ALL SELECT a.node, l.up FROM a JOIN l ON l.node = a.up)
SELECT t.node, t.root AS root_sym, count(a.node) AS n_descendants FROM t LEFT JOIN a ON a.up = t.node GROUP BY t.node, t.root""")
def p1_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many symbols lie below each, from its subtree size."""
    h = hier.hierarchy(table(spark, d, "tax_edges"), "to_sym", "from_sym")
    return h.where("state = 'tree'").select("node", F.col("root").alias("root_sym"), "n_descendants")


@query(f"""WITH RECURSIVE {_LINKS}, a AS (SELECT node AS descendant, up AS node, 1 AS hops FROM l WHERE node IN (SELECT node FROM t)
  UNION ALL SELECT a.descendant, l.up, a.hops + 1 FROM a JOIN l ON l.node = a.node)
SELECT node, descendant, CAST(hops AS BIGINT) AS hops FROM a""")
def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every symbol that stands in a tree, from chain intervals."""
    h = hier.hierarchy(table(spark, d, "tax_edges"), "to_sym", "from_sym")
    return hier.descendants(h, h.where("n_descendants > 0").select("node"))


# --- 2: changes between snapshots -------------------------------------------------------------------------------------

_CHANGES = """u AS (SELECT *, row_number() OVER () AS rid FROM (SELECT DISTINCT snap_no, axiom_id, loaded_at, file, elements FROM axiom_snapshots)),
x AS (SELECT rid, unnest(elements).kind AS kind, trim(unnest(elements).val, {ws}) AS val, generate_subscripts(elements, 1) AS i FROM u),
y AS (SELECT *, min(i) OVER (PARTITION BY rid, kind, val) AS nth FROM x),
z AS (SELECT rid, string_agg(kind || ':' || coalesce(CASE WHEN kind = 'variable' THEN CAST(nth AS VARCHAR)
    WHEN kind = 'literal' AND left(val, 1) <> '"' THEN coalesce(CAST(TRY_CAST(val AS DOUBLE) AS VARCHAR), val) ELSE val END, '~'), chr(1) ORDER BY i) AS body FROM y GROUP BY rid),
v AS (SELECT snap_no, axiom_id, coalesce(file, '~') || chr(2) || CASE WHEN elements IS NULL THEN '~' ELSE coalesce(body, '') END AS body
  FROM u LEFT JOIN z USING (rid) QUALIFY row_number() OVER (PARTITION BY snap_no, axiom_id ORDER BY loaded_at DESC NULLS LAST) = 1),
s AS (SELECT snap_no AS was, lead(snap_no) OVER (ORDER BY snap_no) AS snap_no FROM (SELECT DISTINCT snap_no FROM axiom_snapshots)),
c AS (SELECT s.snap_no, v.axiom_id, 'new' AS side, v.body FROM s JOIN v ON v.snap_no = s.snap_no
  UNION ALL SELECT s.snap_no, v.axiom_id, 'old', v.body FROM s JOIN v ON v.snap_no = s.was WHERE s.snap_no IS NOT NULL),
k AS (SELECT snap_no, axiom_id, max(body) FILTER (side = 'new') AS b, max(body) FILTER (side = 'old') AS a FROM c GROUP BY snap_no, axiom_id),
r AS (SELECT snap_no, axiom_id, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a <> b THEN 'changed' END AS delta_kind FROM k)"""


def _axiom_changes(spark: SparkSession, d: str) -> DataFrame:
    content = snapshots.digest(F.col("file"), snapshots.canonical_elements(F.col("elements")))
    return snapshots.snapshot_changes(table(spark, d, "axiom_snapshots"), "snap_no", "axiom_id", "loaded_at", content)


@query(f"WITH {_CHANGES} SELECT snap_no, axiom_id, delta_kind FROM r WHERE delta_kind IS NOT NULL")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Axioms added, removed or changed in each delivery after the first."""
    return _axiom_changes(spark, d)


@query(f"WITH {_CHANGES} SELECT snap_no, delta_kind, count(*) AS n FROM r WHERE delta_kind IS NOT NULL GROUP BY snap_no, delta_kind")
def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    """How many axioms each delivery added, removed or changed."""
    return _axiom_changes(spark, d).groupBy("snap_no", "delta_kind").agg(F.count("*").alias("n"))


# --- 3: hot keys ------------------------------------------------------------------------------------------------------

HOT_SHARE = 1 / 20


@query("""SELECT 'sentences' AS tbl, trim(elements[1].val, {ws}) AS hot FROM sentences GROUP BY 2
HAVING hot IS NOT NULL AND count(*) > (SELECT count(*) FROM sentences) / 20
UNION ALL SELECT 'tax_edges', trim(rel, {ws}) AS r FROM tax_edges GROUP BY 2
HAVING r IS NOT NULL AND count(*) > (SELECT count(*) FROM tax_edges) / 20""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Heads and rels that own more than a twentieth of their table."""
    parts = [("sentences", hotkeys.head()), ("tax_edges", clean("rel"))]
    return union_all(
        [hotkeys.hot_keys(table(spark, d, t), key, HOT_SHARE).select(F.lit(t).alias("tbl"), F.col("key").alias("hot")) for t, key in parts]
    )


@query("""SELECT trim(elements[1].val, {ws}) AS head, count(*) AS n_rows, sum(len(elements)) AS n_elements, max(len(elements)) AS longest,
min(line) AS first_line, max(ingested_at) AS last_in FROM sentences GROUP BY 1""")
def p3_heads(spark: SparkSession, d: str) -> DataFrame:
    """Figures per head of all sentences."""
    n = F.when(F.col("elements").isNotNull(), F.size("elements")).cast("long")
    measures = {"n_elements": (n, "sum"), "longest": (n, "max"), "first_line": (F.col("line"), "min"), "last_in": (F.col("ingested_at"), "max")}
    return hotkeys.key_statistics(table(spark, d, "sentences"), hotkeys.head(), measures).withColumnRenamed("key", "head")


@query("""SELECT trim(rel, {ws}) AS rel, count(*) AS n_rows, sum(len(scopes)) AS n_scopes, min(recorded_at) AS first_at, max(recorded_at) AS last_at
FROM tax_edges GROUP BY 1""")
def p3_rels(spark: SparkSession, d: str) -> DataFrame:
    """Figures per rel of all taxonomy links."""
    n = F.when(F.col("scopes").isNotNull(), F.size("scopes")).cast("long")
    measures = {"n_scopes": (n, "sum"), "first_at": (F.col("recorded_at"), "min"), "last_at": (F.col("recorded_at"), "max")}
    return hotkeys.key_statistics(table(spark, d, "tax_edges"), clean("rel"), measures).withColumnRenamed("key", "rel")
