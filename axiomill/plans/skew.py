"""Joins and aggregates that stay even when one key owns a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from axiomill.plans.cut import cut

#: Rows are split into pieces of 1/HOT_KEYS of all of them; a key with more rows than one piece is hot, so there can
#: never be more than HOT_KEYS hot keys, and never more than 2 * HOT_KEYS pieces of them. Their list is all that is broadcast.
HOT_KEYS = 1000
#: A piece of fewer rows than this isn't worth a task.
PIECE_ROWS = 10_000
#: Pieces of a hot key whose number of rows isn't known.
SALTS = 32


def salts_of(counts: DataFrame, key: str, rows: str, total: float, least: int = PIECE_ROWS) -> DataFrame:
    """``key, salts``: the hot keys of ``counts`` (key, rows), each with the number of pieces it is split into."""
    piece = max(least, total / HOT_KEYS)
    return counts.where(F.col(rows) > piece).select(key, F.ceil(F.col(rows) / piece).cast("int").alias("salts"))


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, the rows of hot keys in pieces that go to tasks of their own.

    ``hot`` has one column ``key`` with at most HOT_KEYS rows, and may say ``salts``, how many pieces a key has. Only hot keys'
    rows of ``small`` are repeated, once a piece. Rows of ``big`` without a key match nothing and are spread as well.
    """
    n = F.col("salts") if "salts" in hot.columns else F.lit(SALTS)
    mark = F.broadcast(hot.select(key, n.alias("_salts")).dropDuplicates([key]))
    slot = F.xxhash64(*big.columns)
    spread = F.when(F.col("_salts").isNotNull(), F.pmod(slot, F.col("_salts"))).when(F.col(key).isNull(), F.pmod(slot, F.lit(HOT_KEYS))).otherwise(0).cast("int")
    copies = F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
    left = big.join(mark, key, "left").withColumn("_salt", spread).drop("_salts")
    right = small.join(mark, key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def tree_aggregate(df: DataFrame, keys: list[str], first: dict[str, Column], merge: dict[str, str], chunk_rows: int = 100_000, fan_in: int = 16) -> DataFrame:
    """Per-key aggregates by a tree of merges, so that no reducer receives all partial states of a key.

    ``first`` makes a state from rows (``name: aggregate``), ``merge`` names the function that merges two states
    (``sum``, ``min``, ``max``, ``bool_or``, ...). Rows are combined where they lie in chunks of ``chunk_rows``; these states are
    written, which tells how many there are, and the states of ``fan_in`` neighbours are merged in each round until one is
    left per key, in log(chunks) rounds to the base ``fan_in``: first the chunks of a partition, then the partitions. A
    reducer thus holds at most ``fan_in`` states of a key, however hot the key is. Null keys form their own group.
    """
    at = F.monotonically_increasing_id()
    # the id holds the partition above bit 33 and the row's place in it below
    chunked = df.withColumns({"_span": F.shiftright(at, 33), "_piece": F.floor(at.bitwiseAND((1 << 33) - 1) / chunk_rows)})
    states = chunked.groupBy("_span", "_piece", *keys).agg(*[c.alias(n) for n, c in first.items()])
    held = cut(states, "states", spans=F.max("_span"), pieces=F.max("_piece"))
    again = [F.expr(f"{f}({n})").alias(n) for n, f in merge.items()]
    state, pieces, spans = held.df, (held.seen["pieces"] or 0) + 1, (held.seen["spans"] or 0) + 1
    while pieces > 1:
        pieces = -(-pieces // fan_in)
        state = state.groupBy("_span", F.floor(F.col("_piece") / fan_in).alias("_piece"), *keys).agg(*again)
    while spans > fan_in:
        spans = -(-spans // fan_in)
        state = state.groupBy(F.floor(F.col("_span") / fan_in).alias("_span"), *keys).agg(*again)
    return state.groupBy(*keys).agg(*again)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
