"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document has a virtual finish time: the tokens of its source up to and with it, in shuffled order and
counting earlier passes over the source, divided by the source's weight. Taken in that order, the sources advance in
proportion to their weights; a source whose allowed passes are used up falls out and the others go on. The queue is cut
where the tokens reach the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from axiomill.llm.tokens import source_name
from axiomill.plans.cut import cut
from axiomill.plans.prefix import running_sum

#: Rows of one bucket of a running sum.
BUCKET_ROWS = 100_000
#: Sources in a table of targets; it is a table of settings.
MAX_SOURCES = 100_000


def _level(plan: list[dict], budget: float) -> float:
    """The virtual time at which the sources have given ``budget`` tokens, each up to its cap; inf if they never do."""
    left, total = sorted(plan, key=lambda p: p["cap"] / p["weight"]), 0.0
    weights = sum(p["weight"] for p in left)
    for p in left:
        end = p["cap"] / p["weight"]
        if total + end * weights >= budget:
            return (budget - total) / weights
        total += p["cap"]
        weights -= p["weight"]
    return math.inf


class Mixture:
    """A mixture: ``rows`` (doc, source, copy, tokens, finish, position) and ``report``, one row a wanted source.

    ``queue`` holds all copies up to the virtual time at which the queue can end, each with its range of the order.
    """

    def __init__(self, counts: DataFrame, targets: DataFrame, source: str, weight: str, repeats: str, budget: int | None = None, seed: int = 17):
        """``counts`` is (doc, source, tokens); ``targets`` names, weighs and caps the sources.

        A weight that is null, NaN or not positive means not wanted; a null cap means one use; targets named twice are
        added up under the larger cap. Without a ``budget`` the size of all of ``counts`` is the budget.
        """
        spark = counts.sparkSession
        kept = cut(counts, "counts", total=F.sum("tokens"))
        self.total = kept.seen["total"] or 0
        self.budget = self.total if budget is None else budget
        wanted = targets.select(source_name(source).alias("source"), F.col(weight).alias("weight"), F.coalesce(F.col(repeats), F.lit(1)).cast("long").alias("repeats"))
        wanted = wanted.where("source is not null and weight > 0 and not isnan(weight)").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("repeats").alias("repeats"))
        sizes = kept.df.groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("n_docs"), F.max("tokens").alias("longest"))
        held = wanted.join(sizes, "source", "left").na.fill(0, ["size", "n_docs", "longest"]).limit(MAX_SOURCES + 1).collect()
        if len(held) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} target sources")
        plan = [r.asDict() | {"cap": max(0, r["repeats"]) * r["size"]} for r in held]
        weights = sum(p["weight"] for p in plan)
        # the queue goes on until both the budget and the size of all of ``counts`` are given; at any time a source lags
        # behind its flow by less than its longest document, so past ``end`` nothing can be within either
        end = _level(plan, max(self.budget, self.total) + sum(p["longest"] for p in plan))
        nominal = self.total / weights if weights else 0.0
        for p in plan:
            passes = math.ceil(end * p["weight"] / p["size"]) if p["size"] and end < math.inf else p["repeats"]
            p["passes"] = max(0, min(p["repeats"], passes)) if p["size"] else 0
            p["buckets"] = p["n_docs"] // BUCKET_ROWS + 1
            # in whole tokens, without the rounding of the queue's finish times
            p["below"] = p["cap"] * weights < p["weight"] * self.total
            p["target_share"] = p["weight"] / weights
        schema = "source string, weight double, size bigint, n_docs bigint, cap bigint, passes bigint, buckets bigint, below boolean, target_share double, repeats bigint"
        columns = [c.split()[0] for c in schema.split(", ")]
        plans = spark.createDataFrame([tuple(p[c] for c in columns) for p in plan], schema)
        queue = kept.df.join(F.broadcast(plans.select("source", "weight", "size", "passes", "buckets")), "source")
        # 60 bits of a digest every system can work out
        slot = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc").cast("string"))), 1, 15), 16, 10).cast("bigint")
        queue = queue.withColumn("shuffle", slot).withColumn("bucket", F.pmod(F.shiftright("shuffle", 20), F.col("buckets")))
        queue = running_sum(queue, ["source"], "bucket", ["shuffle", "doc"], "tokens", "done")
        copies = queue.where("passes > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes"))))
        copies = copies.withColumn("finish", ((F.col("copy") - 1) * F.col("size") + F.col("done")) / F.col("weight"))
        if end < math.inf:
            copies = copies.where(F.col("finish") <= end * (1 + 1e-9))
        # a range sort whose bounds come from Spark's sample of the queue; written, so that all who read it see the same ranges
        ranges = sum(p["n_docs"] * p["passes"] for p in plan) // BUCKET_ROWS + 1
        copies = copies.select("doc", "source", "copy", "tokens", "finish").repartitionByRange(ranges, "finish", "source", "copy", "doc")
        self.queue = cut(copies.withColumn("range", F.spark_partition_id()), "queue").df
        placed = running_sum(self.queue, [], "range", ["finish", "source", "copy", "doc"], "tokens", "position")
        self.rows = placed.where(F.col("position") <= self.budget).select("doc", "source", "copy", "tokens", "finish", "position")
        mixed, nominally = F.col("position") <= self.budget, F.col("position") <= self.total
        used = placed.groupBy("source").agg(
            F.coalesce(F.sum(F.when(mixed, F.col("tokens"))), F.lit(0)).alias("used"), F.count_if(mixed).alias("used_docs"),
            F.coalesce(F.sum(F.when(nominally, F.col("tokens"))), F.lit(0)).alias("given"), F.max("finish").alias("finish"),
        )
        reached = _level(plan, self.budget)
        self.nominal, self.expected = nominal, sum(min(p["cap"], reached * p["weight"]) for p in plan)
        self._plans, self._used = plans, used

    def report(self) -> DataFrame:
        """``source, target_share, share, used, used_docs, size, cap, passes_used, last_finish, short`` per wanted source.

        ``share`` is the share of the tokens in the mixture; ``short`` holds where all allowed copies end before the
        virtual time at which the source would have its target share of all tokens: the queue, cut at the size of all
        of ``counts``, holds all of them, and ``last_finish``, the largest finish time among them, is not past that time.
        A tie within the rounding of finish times is settled in whole tokens. Where the queue ends before a source's last
        allowed copy, ``last_finish`` is the time that copy would have, the cap over the weight.
        """
        both = self._plans.join(F.broadcast(self._used), "source", "left").na.fill(0, ["used", "used_docs", "given", "finish"])
        both = both.withColumn("last_finish", F.when(F.col("given") == F.col("cap"), F.col("finish")).otherwise(F.col("cap") / F.col("weight")))
        mixed = F.sum("used").over(_everything())
        short = (F.col("given") == F.col("cap")) & (F.col("last_finish") <= self.nominal * (1 + 1e-9)) & F.col("below")
        return both.select(
            "source", "target_share", F.when(mixed > 0, F.col("used") / mixed).otherwise(0.0).alias("share"), "used", "used_docs", "size", "cap",
            F.when(F.col("size") > 0, F.col("used") / F.col("size")).otherwise(0.0).alias("passes_used"), "last_finish", short.alias("short"),
        )


def _everything():
    """A window over the report's rows, of which there are at most MAX_SOURCES."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))
