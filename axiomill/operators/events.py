"""Event calculus and temporal order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from axiomill.plans.cut import cut
from axiomill.plans.prefix import running_last

#: Pairs of points that a task of ``closure_within`` has under way at once, links it follows at once, rows of a batch it gives.
CELLS = 1_000_000
LINKS = 1_000_000
OUT_ROWS = 50_000


def toggles(happens: DataFrame, effects: DataFrame) -> DataFrame:
    """``fluent, time, on``: what starts or ends when. ``happens`` is (time, event), ``effects`` (kind, event, fluent,
    with, without): an effect holds back unless ``with`` happens at the same time, and if ``without`` does.

    Starting and ending at once leaves the fluent on.
    """
    h = happens.select("time", "event").distinct()
    hit = h.join(effects, "event")
    at = h.select("time", F.col("event").alias("other"))
    ok = hit.join(at.select("time", F.col("other").alias("with"), F.lit(True).alias("a")), ["time", "with"], "left")
    ok = ok.join(at.select("time", F.col("other").alias("without"), F.lit(True).alias("b")), ["time", "without"], "left")
    ok = ok.where((F.col("with").isNull() | F.col("a")) & F.col("b").isNull())
    return ok.groupBy("fluent", "time").agg(F.max((F.col("kind") == "initiates").cast("int")).cast("boolean").alias("on"))


def holds_at(happens: DataFrame, effects: DataFrame, cells: DataFrame, days: Column | None = None) -> DataFrame:
    """``fluent, time, holds`` for the asked ``cells`` (fluent, time): the last toggle before the time, else false.

    Toggles and asked times are merged per fluent and order, so no product of fluents and times is ever built. ``days``
    may give a coarser time in the same order (of the column ``time``); a hot fluent is then worked through in pieces.
    """
    t = toggles(happens, effects).select("fluent", "time", "on", F.lit(False).alias("asked"))
    c = cells.select("fluent", "time").distinct().select("fluent", "time", F.lit(None).cast("boolean").alias("on"), F.lit(True).alias("asked"))
    # at one time the question comes first: what is toggled now holds from the next time on
    rows = t.unionByName(c).withColumn("piece", F.coalesce(days if days is not None else F.lit("").cast("string"), F.lit("").cast("string")))
    got = running_last(rows.withColumn("later", ~F.col("asked")), ["fluent"], "piece", ["time", "later"], "on", "held")
    return got.where("asked").select("fluent", "time", F.coalesce("held", F.lit(False)).alias("holds"))


def order_chain(points: DataFrame, lead: int = 2) -> DataFrame:
    """``time, next`` in lexical order, where no order axioms are given.

    Times are taken in buckets by their first ``lead`` letters; the last of a bucket is followed by the first of the next.
    """
    t = points.select("time").where("time is not null").distinct().withColumn("b", F.left("time", F.lit(lead)))
    firsts = t.groupBy("b").agg(F.min("time").alias("first")).select("b", F.lead("first").over(W.orderBy("b")).alias("after"))
    within = t.select("b", "time", F.lead("time").over(W.partitionBy("b").orderBy("time")).alias("n"))
    return within.join(firsts, "b").select("time", F.coalesce("n", "after").alias("next"))


def steps() -> Column:
    """Steps of the point order, an array of (x, y, strict), that an interval relation (columns rel, i, j) states."""
    b = lambda c: F.concat(F.lit("B:"), F.col(c))
    e = lambda c: F.concat(F.lit("E:"), F.col(c))
    lt = lambda x, y: F.array(F.struct(x.alias("x"), y.alias("y"), F.lit(True).alias("strict")))
    le = lambda x, y: F.array(F.struct(x.alias("x"), y.alias("y"), F.lit(False).alias("strict")))
    eq = lambda x, y: F.concat(le(x, y), le(y, x))
    of = {
        "before": lt(F.col("i"), F.col("j")),
        "earlier": lt(e("i"), b("j")),
        "meetsTemporally": eq(e("i"), b("j")),
        "during": F.concat(lt(b("j"), b("i")), lt(e("i"), e("j"))),
        "starts": F.concat(eq(b("i"), b("j")), lt(e("i"), e("j"))),
        "finishes": F.concat(eq(e("i"), e("j")), lt(b("j"), b("i"))),
        "temporalPart": F.concat(le(b("j"), b("i")), le(e("i"), e("j"))),
    }
    made = F.array().cast("array<struct<x:string,y:string,strict:boolean>>")
    for name, edges in of.items():
        made = F.when(F.col("rel") == name, edges).otherwise(made)
    inner = F.when(F.col("rel") != "before", F.concat(lt(b("i"), e("i")), lt(b("j"), e("j"))))
    return F.concat(made, F.coalesce(inner, F.array()))


def network(rel: DataFrame) -> DataFrame:
    """Point order ``(x, y, strict)`` of interval relations (rel, i, j); equality goes both ways. Points are B:i and E:i."""
    return rel.select(F.explode(steps()).alias("p")).select("p.*").distinct()


def temporal_closure(points: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(x, y, strict)`` over all paths: strict if some path has a strict step.

    By squaring, so log rounds; only pairs that are new or became strict in the last round are joined again. Rounds that
    don't suffice are an error.
    """
    best = lambda d: d.groupBy("x", "y").agg(F.bool_or("strict").alias("strict"))
    now = cut(best(points.dropna()), "order", n=F.count("*"))
    delta, left, last = now.df, now.seen["n"], None
    for _ in range(max_rounds):
        if not left:
            return now.df
        a = now.df
        after = a.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("strict").alias("s"))
        grown = delta.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("strict").alias("s"))
        two = delta.join(after, "y").unionByName(a.join(grown, "y")).select("x", F.col("z").alias("y"), (F.col("strict") | F.col("s")).alias("strict"))
        had = a.select("x", "y", F.col("strict").alias("had"))
        fresh = cut(best(two).join(had, ["x", "y"], "left").where("had is null or (strict and not had)").drop("had"), "grown", n=F.count("*"))
        both = cut(best(a.unionByName(fresh.df)), "order")
        now.drop()
        if last:
            last.drop()
        now, delta, left, last = both, fresh.df, fresh.seen["n"], fresh
    raise ValueError(f"the order isn't closed after {max_rounds} rounds")


def closure_within(rows: DataFrame, by: Sequence[str], stated: Column, x: str = "", y: str = "") -> DataFrame:
    """``(*by, x, y, strict)``: the closure, as ``temporal_closure`` has it, of each group ``by`` of ``rows`` as a network
    of its own. ``stated`` gives a row's steps, as ``steps`` does; only pairs that begin with ``x`` and ``y`` come out.

    A task gathers the stated steps of a group and walks them from each x; the pairs go straight on to whatever reads
    them, so no step is written and only ``rows`` are shuffled, not even those where they lie by group.
    """
    # made in a step of their own: inside the aggregate they'd be evaluated without compiled code
    groups = rows.select(*by, stated.alias("steps")).groupBy(*by).agg(F.flatten(F.collect_list("steps")).alias("steps"))
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "x string, y string, strict boolean"])
    return groups.mapInArrow(_walked(len(by), x, y), schema)


def _walked(keys: int, x: str, y: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _walk(b, keys, x, y)

    return run


def _walk(batch: pa.RecordBatch, keys: int, x: str, y: str) -> Iterator[pa.RecordBatch]:
    """All pairs of the groups of ``batch``: ``keys`` columns and the list of the steps."""
    lists = batch.column(keys)
    links = pa.table([pc.list_parent_indices(lists), *lists.flatten().flatten()], ["owner", "x", "y", "strict"]).drop_null()
    if not len(links):
        return
    owner, strict = (links[k].to_numpy().astype(np.int64) for k in ("owner", "strict"))
    coded = pa.chunked_array([*links["x"].chunks, *links["y"].chunks]).combine_chunks().dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # a node is a point of a group; those of a group are neighbours
    nodes, of = np.unique(np.concatenate([owner, owner]) * len(names) + codes, return_inverse=True)
    group, name = nodes // len(names), nodes % len(names)
    starts = np.searchsorted(group, np.arange(len(batch) + 1))
    # each link once, by its first node; 2 is strict, 1 isn't
    once = np.unique((of[: len(owner)] * len(nodes) + of[len(owner) :]) * 2 + strict)
    weight, to, source = (once % 2 + 1).astype(np.uint8), once // 2 % len(nodes), once // 2 // len(nodes)
    first = np.searchsorted(source, np.arange(len(nodes) + 1))
    begins = lambda p: pc.starts_with(names, p).to_numpy(zero_copy_only=False)[name]
    rows, wanted = np.flatnonzero(begins(x) & (np.diff(first) > 0)), begins(y)
    width = np.diff(starts)[group[rows]]
    ends = np.cumsum(width)
    at = 0
    while at < len(rows):
        # as many rows as CELLS holds, at least one
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
        own, wide = rows[at:upto], width[at:upto]
        offset = np.cumsum(wide) - wide - starts[group[own]]
        known = _reached(own, offset, int(wide.sum()), first, to, weight)
        found = np.flatnonzero(known)
        row = np.repeat(np.arange(len(own)), wide)[found]
        node = found - offset[row]
        keep = wanted[node]
        found, row, node = found[keep], row[keep], node[keep]
        for k in range(0, len(found), OUT_ROWS):
            f, r, n = found[k : k + OUT_ROWS], own[row[k : k + OUT_ROWS]], node[k : k + OUT_ROWS]
            held = [batch.column(i).take(pa.array(group[r])) for i in range(keys)]
            pairs = [names.take(pa.array(name[r])), names.take(pa.array(name[n])), pa.array(known[f] == 2)]
            yield pa.RecordBatch.from_arrays([*held, *pairs], [*batch.schema.names[:keys], "x", "y", "strict"])
        at = upto


def _reached(rows: np.ndarray, offset: np.ndarray, cells: int, first: np.ndarray, to: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Per row (its node in ``rows``) and node of its group, at ``offset`` + node: 0 not reached, 1 reached, 2 by a strict way.

    One link further each time; only what was reached anew, or became strict, goes on.
    """
    known, mark = np.zeros(cells, np.uint8), np.empty(cells, np.int32)
    front = (np.arange(len(rows)), rows, np.zeros(len(rows), np.uint8))
    while len(front[0]):
        # as many links at once as LINKS holds, those of a node together
        many = np.cumsum(first[front[1] + 1] - first[front[1]])
        pieces = np.flatnonzero(np.diff(many // LINKS)) + 1
        parts = [_step(*part, known, mark, offset, first, to, weight) for part in zip(*(np.split(c, pieces) for c in front))]
        front = tuple(np.concatenate(c) for c in zip(*parts))
    return known


def _step(row: np.ndarray, node: np.ndarray, had: np.ndarray, known: np.ndarray, mark: np.ndarray, offset: np.ndarray, first: np.ndarray, to: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Follow the links of each node; what of it is new is set in ``known`` and returned. ``mark`` is scratch space."""
    many = first[node + 1] - first[node]
    by = np.repeat(np.arange(len(row)), many)
    link = np.arange(len(by)) + (first[node] - np.cumsum(many) + many)[by]
    node, row, had = to[link], row[by], np.maximum(had[by], weight[link])
    cell = offset[row] + node
    fresh = np.flatnonzero(had > known[cell])
    # of several ways to a node one goes on, a strict one before others
    fresh = np.concatenate([fresh[had[fresh] == 1], fresh[had[fresh] == 2]])
    cell, order = cell[fresh], np.arange(len(fresh), dtype=np.int32)
    mark[cell] = order
    last = mark[cell] == order
    fresh, cell = fresh[last], cell[last]
    known[cell] = had[fresh]
    return row[fresh], node[fresh], had[fresh]


def consistent(order: DataFrame) -> bool:
    """Whether no point lies strictly before itself."""
    return order.where("x = y and strict").isEmpty()


def entails(order: DataFrame, asked: DataFrame) -> DataFrame:
    """``x, y, holds``: for each ``asked`` (x, y, strict) whether the closed ``order`` says it; unknown points say nothing."""
    got = order.select("x", "y", F.col("strict").alias("is_strict"))
    rows = asked.join(got, ["x", "y"], "left")
    return rows.select("x", "y", F.col("strict"), (F.col("is_strict").isNotNull() & (~F.col("strict") | F.col("is_strict"))).alias("holds"))


def witness(points: DataFrame, x: str, y: str) -> list[tuple[str, str]]:
    """The steps of a shortest way from x to y over the stated ``points`` (x, y, strict), none where there is no way."""
    from axiomill.operators.introspect import witness_path

    return [(a, b) for a, b, _ in witness_path(points.select("x", "y", F.lit(None).cast("bigint").alias("sid")), x, y)]
