"""How distinctive a term is of its record: log-odds with an informative Dirichlet prior, as z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from axiomill.plans.cut import cut
from axiomill.plans.skew import salted_join, salts_of


def distinctive_terms(bags: DataFrame, min_terms: int = 1, prior: float = 100.0) -> DataFrame:
    """Scores of the terms of each record with at least ``min_terms`` occurrences, against the whole collection.

    ``bags`` is (record, terms array<string>), one row a record. Gives ``record, term, tf, n_terms, cf, df, z``: the term's
    occurrences in the record, the record's size, the term's occurrences and records in the collection, and

        z = (log odds in the record - log odds in the rest) / sqrt(1/(tf + a) + 1/(cf - tf + a)),  a = prior * cf / N

    where ``prior`` is the weight, in occurrences, of the collection's frequencies as prior. All records enter the
    collection's counts, whatever their size. z is null only where the record is the whole collection.
    Records without terms give no rows. Hot terms are salted; only their list (at most 1000) is broadcast.
    """
    kept = cut(bags, "bags", n=F.sum(F.size("terms")))
    n = float(kept.seen["n"] or 0)
    rows = kept.df.select("record", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    per = rows.groupBy("record", "n_terms", "term").agg(F.count("*").alias("tf"))
    stats = cut(per.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")), "terms")
    scored = kept.df.where(F.size("terms") >= min_terms).select("record", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    scored = scored.groupBy("record", "n_terms", "term").agg(F.count("*").alias("tf"))
    hot = salts_of(stats.df, "term", "cf", n)
    both = salted_join(scored, stats.df, "term", hot)
    a = F.lit(prior) * F.col("cf") / F.lit(n)

    def odds(count, size):
        return F.log((count + a) / (size + prior - count - a))

    rest = F.col("cf") - F.col("tf")
    gap = odds(F.col("tf"), F.col("n_terms")) - odds(rest, F.lit(n) - F.col("n_terms"))
    z = F.when(F.col("n_terms") < n, gap / F.sqrt(1 / (F.col("tf") + a) + 1 / (rest + a)))
    return both.select("record", "term", "tf", "n_terms", "cf", "df", z.alias("z"))
