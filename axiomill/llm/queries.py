"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from axiomill.llm import leaks as leak, mixing, quality, tokens
from axiomill.llm.burst import term_frequencies
from axiomill.llm.distinctive import distinctive_terms
from axiomill.llm.records import bags, symbols
from axiomill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"

_TERMS = """d AS (SELECT sid, any_value(elements) AS elements FROM sentences WHERE sid IS NOT NULL GROUP BY sid),
x AS (SELECT sid, unnest(elements).kind AS kind, nullif(trim(unnest(elements).val, {ws}), '') AS term FROM d),
o AS (SELECT sid, term, count(*) AS tf FROM x WHERE kind = 'symbol' AND term IS NOT NULL GROUP BY sid, term),
s AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM o GROUP BY term),
n AS (SELECT sid, sum(tf) AS n_terms FROM o GROUP BY sid)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{ws}", WS)
        return f

    return add


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return bags(table(spark, d, "sentences"), "sid", symbols(F.col("elements")))


# --- 4: distinctive terms ---------------------------------------------------------------------------------------------

MIN_TERMS = 8
MIN_RATIO = 0.47


@query(f"WITH {_TERMS} SELECT sid, term FROM o JOIN s USING (term) JOIN n USING (sid) WHERE n_terms >= 8 AND df >= 2 AND tf / df > 0.47")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Scarce shared symbols that mark their sentence.

    The exact ratio alone decides; the most characteristic (by z) come first.
    """
    scored = distinctive_terms(_sentences(spark, d), MIN_TERMS)
    found = scored.where((F.col("df") >= 2) & (F.col("tf") / F.col("df") > MIN_RATIO)).orderBy(F.desc("z"), "record", "term")
    return found.select(F.col("record").alias("sid"), "term")


@query(f"""WITH {_TERMS}, t AS (SELECT sum(tf) AS n FROM o),
a AS (SELECT sid, term, tf, cf, df, n_terms, 100.0 * cf / n AS a, n FROM o JOIN s USING (term) JOIN n USING (sid), t WHERE n_terms >= 8)
SELECT sid, term, tf, cf::BIGINT AS cf, df, round((ln((tf + a) / (n_terms + 100.0 - tf - a)) - ln((cf - tf + a) / (n - n_terms + 100.0 - cf + tf - a)))
/ sqrt(1 / (tf + a) + 1 / (cf - tf + a)), 6) AS z FROM a""")
def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    """z-scores of all symbols of the sentences with at least eight."""
    scored = distinctive_terms(_sentences(spark, d), MIN_TERMS)
    return scored.select(F.col("record").alias("sid"), "term", "tf", "cf", "df", F.round("z", 6).alias("z"))


# --- 5: term frequencies ----------------------------------------------------------------------------------------------

_MARKS = f"""{_TERMS}, c AS (SELECT count(*) AS n_records FROM d),
m AS (SELECT term, cf::BIGINT AS occurrences, df AS records, CASE WHEN df <= 2 THEN 'rare' WHEN df > n_records / 20 THEN 'common' END AS mark FROM s, c)"""


@query(f"WITH {_MARKS} SELECT term, mark FROM m WHERE mark IS NOT NULL")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Symbols too scarce or too widespread to be useful."""
    return term_frequencies(_sentences(spark, d)).where("mark is not null").select("term", "mark")


@query(f"WITH {_MARKS} SELECT * FROM m")
def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and sentences of every symbol, with its mark."""
    return term_frequencies(_sentences(spark, d)).select("term", "occurrences", "records", "mark")


# --- 6: leaked tests --------------------------------------------------------------------------------------------------

MIN_RUN = 12


def _leaks(spark: SparkSession, d: str, seed: int | None = None) -> DataFrame:
    return leak.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "testcase"), "item_id", "note", seed=seed, min_run=MIN_RUN)


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents),
v AS (SELECT item_id, regexp_extract_all(lower(note), '[\\p{L}\\p{N}]+') AS t FROM testcase),
g AS (SELECT DISTINCT item_id, array_to_string(t[i : i + 11], ' ') AS s FROM (SELECT item_id, t, unnest(range(1, len(t) - 10)) AS i FROM v WHERE len(t) >= 12)),
h AS (SELECT DISTINCT doc_id, array_to_string(t[i : i + 11], ' ') AS s FROM (SELECT doc_id, t, unnest(range(1, len(t) - 10)) AS i FROM w WHERE len(t) >= 12))
SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (s)""")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least twelve consecutive words of a test item's note; every such run holds a seed of eight."""
    return _leaks(spark, d, seed=8).where(F.col("longest") >= MIN_RUN).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


@query()
def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Per test item: the documents that give it away and its best coverage by one of them."""
    rows = _leaks(spark, d).where("leaked")
    return rows.groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("n_docs"), F.max("longest").alias("longest"), F.max("coverage").alias("coverage"))


# --- 7: mixture -------------------------------------------------------------------------------------------------------


def mixture(spark: SparkSession, d: str, ranks: str = tokens.RANKS) -> mixing.Mixture:
    counts = tokens.token_counts(table(spark, d, "documents"), "doc_id", "source", "text", ranks)
    return mixing.Mixture(counts, table(spark, d, "mix_targets"), "source_name", "target_weight", "max_repeats")


@query("""WITH t AS (SELECT source_name, target_weight AS w, max_repeats AS r FROM mix_targets WHERE target_weight > 0 AND NOT isnan(target_weight)),
s AS (SELECT lower(trim(source, {ws})) AS source_name, sum(length(text)) AS size FROM documents WHERE trim(text, {ws}) <> '' GROUP BY 1)
SELECT source_name FROM t LEFT JOIN s USING (source_name)
WHERE coalesce(size, 0) * r < w / (SELECT sum(w) FROM t) * (SELECT sum(size) FROM s)""")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Wanted sources that fall short of their target share even when used as often as allowed."""
    return mixture(spark, d).report().where("short").select(F.col("source").alias("source_name"))


@query()
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each wanted source in the mixture."""
    return mixture(spark, d).report()


@query()
def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: one row per used copy of a document, with its place in the queue."""
    return mixture(spark, d).rows


# the same queue with sizes in characters, which SQL can count
_QUEUE = """t AS (SELECT lower(trim(regexp_replace(source_name, '\\s+', ' ', 'g'))) AS source, sum(target_weight) AS w, max(coalesce(max_repeats, 1)) AS r
  FROM mix_targets WHERE target_weight > 0 AND NOT isnan(target_weight) AND source_name IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id AS doc, lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS source, length(text) AS tokens, ('0x' || substr(md5('17:' || doc_id), 1, 15))::BIGINT AS slot
  FROM documents WHERE regexp_matches(text, '\\S')),
n AS (SELECT sum(tokens)::BIGINT AS total FROM d),
q AS (SELECT d.*, w, r, sum(tokens) OVER (PARTITION BY source ORDER BY slot, doc) AS done, sum(tokens) OVER (PARTITION BY source) AS size FROM d JOIN t USING (source)),
c AS (SELECT *, unnest(range(1, r + 1)) AS copy FROM q),
f AS (SELECT doc, source, copy, tokens, ((copy - 1) * size + done)::DOUBLE / w AS finish FROM c),
p AS (SELECT *, sum(tokens) OVER (ORDER BY finish, source, copy, doc)::BIGINT AS position FROM f)"""


def _by_length(spark: SparkSession, d: str) -> mixing.Mixture:
    t = table(spark, d, "documents").where(F.col("text").rlike(r"\S"))
    counts = t.select(F.col("doc_id").alias("doc"), tokens.source_name("source").alias("source"), F.length("text").cast("long").alias("tokens"))
    return mixing.Mixture(counts, table(spark, d, "mix_targets"), "source_name", "target_weight", "max_repeats")


@query(f"WITH {_QUEUE} SELECT doc, source, copy, tokens, finish, position FROM p, n WHERE position <= total")
def p7_mixture_by_length(spark: SparkSession, d: str) -> DataFrame:
    """The mixture with sizes in characters."""
    return _by_length(spark, d).rows


@query(f"""WITH {_QUEUE}, s AS (SELECT source, sum(tokens)::BIGINT AS size FROM d GROUP BY source),
g AS (SELECT source, sum(tokens) FILTER (position <= total)::BIGINT AS used, count(*) FILTER (position <= total) AS used_docs FROM p, n GROUP BY source),
a AS (SELECT t.source, w, r, coalesce(size, 0) AS size, coalesce(used, 0) AS used, coalesce(used_docs, 0) AS used_docs FROM t LEFT JOIN s USING (source) LEFT JOIN g USING (source))
SELECT source, round(w / sum(w) OVER (), 9) AS target_share, round(used / sum(used) OVER (), 9) AS share, used, used_docs, size, size * r AS cap, size * r < w / sum(w) OVER () * total AS short FROM a, n""")
def p7_shares_by_length(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each wanted source, in characters."""
    r = _by_length(spark, d).report()
    return r.select("source", F.round("target_share", 9).alias("target_share"), F.round("share", 9).alias("share"), "used", "used_docs", "size", "cap", "short")


# --- 8: text quality --------------------------------------------------------------------------------------------------


def _quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = quality.fit(docs, "doc_id", "text", table(spark, d, "labels"), "doc_id", "kind")
    return quality.text_quality(docs, "doc_id", "text", model)


@query()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which more than half, by characters, is not natural prose."""
    return _quality(spark, d).where("prose_share < 0.5").select(F.col("doc").alias("doc_id"))


@query()
def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """All figures of every document with text."""
    return _quality(spark, d).withColumnRenamed("doc", "doc_id")


_WORD_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in quality.VOCABULARY) + "]"


@query(f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w, regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]', '', 'g') AS solid,
  list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]'), lambda l: regexp_replace(l, '[\\s\\p{{Z}}]+$', '')), lambda l: l <> '') AS ls FROM documents),
n AS (SELECT *, length(array_to_string(w, '')) AS letters FROM t WHERE solid <> '')
SELECT doc_id, len(w) AS n_words, round(CASE WHEN len(w) > 0 THEN letters / len(w) ELSE 0 END, 6) AS mean_word_length, round((length(solid) - letters) / length(solid), 6) AS symbol_ratio,
round(len(list_filter(ls, lambda l: contains('.!?:;…', right(l, 1)))) / len(ls), 6) AS punctuated_lines,
round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains({_WORD_LIST}, lower(x)))) / len(w) ELSE 0 END, 6) AS common_words FROM n""")
def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """The basic counts of every document with text."""
    rows = _quality(spark, d)
    shares = ("mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")
    return rows.select(F.col("doc").alias("doc_id"), "n_words", *[F.round(c, 6).alias(c) for c in shares])
