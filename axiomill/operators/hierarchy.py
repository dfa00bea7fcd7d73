"""Parent-child links to full hierarchies, by heavy-path decomposition.

Every loop below doubles the distance it has covered, so the number of rounds is the logarithm of the depth: a chain
of a million links takes twenty rounds. A node leaves a loop as soon as its own result is known, so a round handles the
nodes that are deep enough to need it and not the whole table; once no more than TAIL_ROWS are under way, one task runs
the rest of the same doubling over them. Nodes without children, usually most of them and the
whole of a hot parent's fan, take no part in the loops: they join their parent's result once at the end. No step holds
the children of one parent together; sums per parent are combined before they are shuffled, joins with a hot parent,
root or chain are split into pieces.

1. Cycle separation and subtree sizes. With ``jump_k(v)`` the ancestor 2^k links up, a node has run off its root once
   ``jump_k`` is null. The sizes double along: S_{k+1}(v) = S_k(v) + sum of S_k(u) over jump_k(u) = v. Depths in a tree
   have no gaps, so a round in which no further node runs off proves that all that are left lie on or below a cycle;
   those on the cycle are the ones still hit by ``jump_k`` once the set of hit nodes stops shrinking.
2. The child with the largest subtree is the heavy one. Maximal runs of heavy links are the chains; doubling along
   them gives each node its chain (named by its top node) and its place in it.
3. A path crosses at most log2(n) chains. Doubling over the far smaller tree of chains gives each chain the list of
   chain segments from it up to the root; a node's path is those segments concatenated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from axiomill.functions.text import name_or_null
from axiomill.plans.cut import Cut, cut
from axiomill.plans.skew import salted_join, salts_of, union_all

SEGMENT = "array<struct<chain:bigint,upto:bigint>>"
#: Places of a chain that are handled as one row when paths and descendants are written out.
BLOCK = 64
#: So few rows of two or three numbers (2.4 MB) are finished by one task, without a shuffle a round.
TAIL_ROWS = 50_000


def parent_links(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """One row ``(node, parent)`` per child. Rows with a null or blank endpoint are ignored, repeats fold together.

    A child with several parents keeps the first by name, except that a link to itself always wins: it is a cycle.
    """
    e = edges.select(name_or_null(child).alias("node"), name_or_null(parent).alias("up")).dropna()
    # a minimum of a plain text per node stays a hash aggregate
    best = F.coalesce(F.min(F.when(F.col("node") == F.col("up"), F.col("up"))), F.min("up"))
    return e.groupBy("node").agg(best.alias("parent"))


def _column(batches: Iterator[pa.RecordBatch], kinds: tuple) -> list[np.ndarray]:
    held = list(batches)
    return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held] or [np.empty(0)]).astype(k) for i, k in enumerate(kinds)]


def _places(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The place of each of ``of`` in ``ids``, -1 where it isn't there."""
    order = np.argsort(ids, kind="stable")
    at = np.searchsorted(ids, of, sorter=order)
    at[at == len(ids)] = 0
    at = order[at]
    return np.where(ids[at] == of, at, -1)


def _finish_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rounds of ``_sizes`` over a bounded rest (id, jump, size), all under way."""
    ids, jump, size = _column(batches, (np.int64, np.int64, np.float64))
    if not len(ids):
        return
    to, out = _places(ids, jump), []
    going = np.ones(len(ids), bool)
    while going.any():
        away = going & (to < 0)
        out.append((jump[away], size[away]))
        near = np.flatnonzero(going & (to >= 0))
        more = np.bincount(to[near], size[near], len(ids))
        after = np.zeros(len(ids), bool)
        after[near] = going[to[near]]
        nxt_to, nxt_jump = to.copy(), jump.copy()
        nxt_to[near], nxt_jump[near] = to[to[near]], jump[to[near]]
        size = size + more
        if after.sum() == going.sum():
            break
        to, jump, going = nxt_to, nxt_jump, after
    out.append((ids[~going], size[~going]))
    for some, null in ((out, True), ([(ids[going], size[going])], False)):
        i, v = (np.concatenate(x) for x in zip(*some))
        j = pa.nulls(len(i), pa.int64()) if null else pa.array(jump[going])
        yield pa.RecordBatch.from_arrays([pa.array(i), j, pa.array(v)], names=["id", "jump", "size"])


def _finish_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, chain, pos) under way, each led on to the first node that isn't among them."""
    ids, chain, pos = _column(batches, (np.int64, np.int64, np.int64))
    if not len(ids):
        return
    to = _places(ids, chain)
    while (near := np.flatnonzero(to >= 0)).size:
        over = to[near]
        chain[near], pos[near], to[near] = chain[over], pos[near] + pos[over], to[over]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(chain), pa.array(pos)], names=["id", "chain", "pos"])


def _sizes(start: Cut) -> tuple[list[Cut], Cut | None]:
    """Step 1 over the nodes with children, from (id, jump, size): the parts (id, size) whose sums are the numbers of nodes
    below each, and the nodes (id, jump) on or below a cycle, if there are any.

    A node with a jump is under way; one without has run off its root and is only given what others still add.
    """
    parts, now = [start], start
    while now.seen["left"]:
        a = now.df.where("jump is not null")
        if now.seen["left"] <= TAIL_ROWS:
            parts.append(cut(a.coalesce(1).mapInArrow(_finish_sizes, "id bigint, jump bigint, size double"), "sizes", left=F.count("jump")))
            return parts, parts[-1] if parts[-1].seen["left"] else None
        far = a.select(F.col("id").alias("jump"), F.col("jump").alias("next"))
        given = a.groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("more"))
        step = a.join(far, "jump", "left").select("id", "next", "size").join(given, "id", "full")
        size = F.coalesce("size", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))
        after = cut(step.select("id", F.col("next").alias("jump"), size.alias("size")), "sizes", left=F.count("jump"))
        parts.append(after)
        if after.seen["left"] == now.seen["left"]:
            return parts, after
        now = after
    return parts, None


def _finish_cycle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, jump = _column(batches, (np.int64, np.int64))
    if not len(ids):
        return
    to = _places(ids, jump)
    hit = np.unique(to)
    while len(nxt := np.unique(to[hit])) < len(hit):
        hit = nxt
    yield pa.RecordBatch.from_arrays([pa.array(ids[hit])], names=["id"])


def _on_cycle(stuck: DataFrame, n: int) -> Cut:
    """Nodes on a cycle among the ``n`` of ``stuck`` (id, jump), all of which lie on or below one."""
    if n <= TAIL_ROWS:
        return cut(stuck.coalesce(1).mapInArrow(_finish_cycle, "id bigint"), "cycle")
    now = cut(stuck, "stuck")
    hit = now.df.select("jump").distinct().count()
    while True:
        s = now.df
        far = s.select(F.col("id").alias("jump"), F.col("jump").alias("next"))
        after = cut(s.join(far, "jump").select("id", F.col("next").alias("jump")), "stuck")
        now.drop()
        now, before = after, hit
        hit = now.df.select("jump").distinct().count()
        if hit == before:
            found = cut(now.df.select(F.col("jump").alias("id")).distinct(), "cycle")
            now.drop()
            return found


def _chains(tree: DataFrame) -> list[Cut]:
    """Chain and place of the heavy nodes of ``tree`` (id, up, size): the frames' rows with ``done``, columns id, chain, pos.

    A node that isn't the heaviest child of its parent is the top of its own chain and gets no row.
    """
    best = F.max(F.struct("size", F.col("id").alias("heavy"))).getField("heavy")
    heavy = tree.where("up is not null").groupBy("up").agg(best.alias("id")).select("id", F.col("up").alias("chain"))
    # the walk goes on where the parent is heavy too, else the parent is the top
    over = heavy.select(F.col("id").alias("chain"), F.lit(False).alias("d"))
    state = heavy.join(over, "chain", "left").select("id", "chain", F.lit(1).cast("bigint").alias("pos"), F.coalesce("d", F.lit(True)).alias("done"))
    now = cut(state, "chains", left=F.count_if(~F.col("done")))
    parts = [now]
    while now.seen["left"]:
        a = now.df.where("not done")
        known = union_all([p.df.where("done") for p in parts])
        if now.seen["left"] <= TAIL_ROWS:
            a = a.select("id", "chain", "pos").coalesce(1).mapInArrow(_finish_chains, "id bigint, chain bigint, pos bigint")
        else:
            known = known.unionByName(a)
        far = known.select(F.col("id").alias("chain"), F.col("chain").alias("next"), F.col("pos").alias("more"), F.col("done").alias("d"))
        step = a.join(far, "chain").select("id", F.col("next").alias("chain"), (F.col("pos") + F.col("more")).alias("pos"), F.col("d").alias("done"))
        now = cut(step, "chains", left=F.count_if(~F.col("done")))
        parts.append(now)
    return parts


_SEGMENTS = pa.schema([("chain", pa.int64()), ("over", pa.int64()), ("segs", pa.list_(pa.struct([("chain", pa.int64()), ("upto", pa.int64())])))])


def _finish_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of chains (chain, over, upto) that hang, all but the roots' own being among the rows."""
    chain, over, upto = _column(batches, (np.int64, np.int64, np.int64))
    if not len(chain):
        return
    to, segs = _places(chain, over).tolist(), [None] * len(chain)
    hang = [{"chain": c, "upto": u} for c, u in zip(over.tolist(), upto.tolist())]
    for i in range(len(chain)):
        way = []
        while i >= 0 and segs[i] is None:
            way.append(i)
            i = to[i]
        for k in reversed(way):
            segs[k] = [hang[k], *(segs[to[k]] if to[k] >= 0 else ())]
    for k in range(0, len(chain), 10_000):
        part = slice(k, k + 10_000)
        yield pa.RecordBatch.from_arrays([pa.array(chain[part]), pa.nulls(len(chain[part]), pa.int64()), pa.array(segs[part], _SEGMENTS.field("segs").type)], schema=_SEGMENTS)


def _segments(chains: DataFrame) -> list[Cut]:
    """Segments above each chain, nearest first, from (chain, over, upto): the frames' rows without ``over``, columns chain, segs."""
    segs = F.when(F.col("over").isNull(), F.array().cast(SEGMENT)).otherwise(F.array(F.struct(F.col("over").alias("chain"), F.col("upto").alias("upto"))).cast(SEGMENT))
    now = cut(chains.select("chain", "over", segs.alias("segs")), "segments", left=F.count("over"))
    parts = [now]
    if 0 < now.seen["left"] <= TAIL_ROWS:
        hung = now.df.where("over is not null").select("chain", "over", F.element_at("segs", 1).getField("upto").alias("upto"))
        parts.append(cut(hung.coalesce(1).mapInArrow(_finish_segments, f"chain bigint, over bigint, segs {SEGMENT}"), "segments"))
        return parts
    while now.seen["left"]:
        a = now.df.where("over is not null")
        known = union_all([*[p.df.where("over is null") for p in parts], a])
        far = known.select(F.col("chain").alias("over"), F.col("over").alias("next"), F.col("segs").alias("more"))
        step = a.join(far, "over").select("chain", F.col("next").alias("over"), F.concat("segs", "more").alias("segs"))
        now = cut(step, "segments", left=F.count("over"))
        parts.append(now)
    return parts


def hierarchy(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """The full hierarchy of the links, one row per node:

    ``node, parent, state, root, depth, n_descendants, chain, pos, segs``

    ``state`` is ``tree``, ``cycle`` (on one; a self-link is one) or ``below_cycle``; outside trees all later columns are
    null. ``depth`` counts the links up to ``root`` (0 for the root itself). The node is the ``pos``-th (from 0) of
    ``chain``; above it the path runs through ``segs``, nearest first: the nodes 0 to ``upto`` of each chain. Chains are
    numbered within one result.

    Null or blank endpoints are ignored, repeats and other columns have no effect, an empty table gives no rows.
    """
    links = cut(parent_links(edges, child, parent), "links", n=F.count("*"))
    n = links.seen["n"]
    fans = links.df.groupBy(F.col("parent").alias("node")).agg(F.count("*").cast("double").alias("kids"))
    # the loops run on the numbers of nodes with children: names come back once, at the end
    inner = cut(fans.withColumn("id", F.monotonically_increasing_id()), "inner")
    hot = salts_of(inner.df, "id", "kids", n).join(inner.df.select("id", "node"), "id")
    above = inner.df.select(F.col("node").alias("parent"), F.col("id").alias("up"))
    placed = salted_join(links.df, above, "parent", hot.select(F.col("node").alias("parent"), "salts")).join(inner.df, "node", "left")
    # a leaf's number lies below zero
    nodes = cut(placed.select("node", "parent", "up", "kids", F.coalesce("id", -1 - F.monotonically_increasing_id()).alias("id")), "nodes")
    leaves = nodes.df.where("kids is null").select("node", "parent", "id", "up")
    hung = nodes.df.where("kids is not null").select("id", F.col("up").alias("jump"), F.col("kids").alias("size"))
    # the roots were children of nobody
    tops = inner.df.join(hung.select("id"), "id", "left_anti").select("id", F.lit(None).cast("bigint").alias("jump"), F.col("kids").alias("size"))
    start = cut(hung.unionByName(tops), "sizes", left=F.count("jump"))

    parts, stuck = _sizes(start)
    sums = union_all([p.df.where("jump is null").select("id", "size") for p in parts]).groupBy("id").agg(F.sum("size").alias("size"))
    loop = None
    if stuck:
        loop = _on_cycle(stuck.df.where("jump is not null").select("id", "jump"), stuck.seen["left"])
        sums = sums.join(stuck.df.where("jump is not null").select("id"), "id", "left_anti")
    up_of = start.df.select("id", F.col("jump").alias("up"))
    tree = cut(sums.join(up_of, "id"), "tree")
    chains = _chains(tree.df)
    heavy = union_all([c.df.where("done") for c in chains]).select("id", "chain", "pos")
    spot = cut(tree.df.join(heavy, "id", "left").select("id", "up", "size", F.coalesce("chain", "id").alias("chain"), F.coalesce("pos", F.lit(0)).alias("pos")), "spots", n=F.count("*"))
    # a chain's top node knows the node above it, whose chain and place are where the chain hangs
    lead = spot.df.where("pos = 0").select(F.col("id").alias("top"), "up")
    over = spot.df.select(F.col("id").alias("up"), F.col("chain").alias("over"), F.col("pos").alias("upto"))
    at_root = lead.where("up is null").select(F.col("top").alias("chain"), F.lit(None).cast("bigint").alias("over"), F.lit(None).cast("bigint").alias("upto"))
    segs = _segments(lead.where("up is not null").join(over, "up").select(F.col("top").alias("chain"), "over", "upto").unionByName(at_root))

    total = spot.seen["n"] or 0
    long = salts_of(spot.df.groupBy("chain").agg(F.count("*").alias("k")), "chain", "k", total)
    above_chain = union_all([s.df.where("over is null").select("chain", "segs") for s in segs])
    whole = (
        salted_join(spot.df, above_chain, "chain", long)
        .withColumn("top", F.coalesce(F.try_element_at("segs", F.lit(-1)).getField("chain"), "chain"))
        .withColumn("depth", F.aggregate("segs", F.col("pos"), lambda a, s: a + s["upto"] + 1))
        .select("id", F.lit("tree").alias("state"), "top", "depth", F.col("size").cast("long").alias("n_descendants"), "chain", "pos", "segs")
    )
    if stuck:
        ring = loop.df.select("id", F.lit(True).alias("ring"))
        nothing = {"top": "bigint", "depth": "bigint", "n_descendants": "bigint", "chain": "bigint", "pos": "bigint", "segs": SEGMENT}
        off = stuck.df.where("jump is not null").select("id").join(ring, "id", "left").select(
            "id", F.when(F.col("ring"), "cycle").otherwise("below_cycle").alias("state"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()]
        )
        whole = whole.unionByName(off)
    inside = cut(whole, "inside")
    # names: a root's is its own; a child's parent stands beside it
    top = inside.df.where("id = top").select("top", "n_descendants").join(inner.df.select(F.col("id").alias("top"), F.col("node").alias("root")), "top")
    few = salts_of(top, "top", "n_descendants", n)
    rooted = salted_join(inside.df, top.select("top", "root"), "top", few, "left")
    named = inner.df.select("id", "node").join(nodes.df.where("kids is not null").select("id", "parent"), "id", "left")
    done = cut(rooted.join(named, "id"), "done")
    up = done.df.select(F.col("id").alias("up"), F.col("state").alias("s"), "root", F.col("depth").alias("d"), F.col("chain").alias("c"), F.col("pos").alias("p"), F.col("segs").alias("g"))
    good = F.col("s") == "tree"
    own = F.array(F.struct(F.col("c").alias("chain"), F.col("p").alias("upto"))).cast(SEGMENT)
    ends = salted_join(leaves, up, "up", hot.select(F.col("id").alias("up"), "salts")).select(
        "node", "parent", F.when(good, "tree").otherwise("below_cycle").alias("state"), "root", (F.col("d") + 1).alias("depth"),
        F.when(good, 0).cast("long").alias("n_descendants"), F.when(good, F.col("id")).alias("chain"),
        F.when(good, 0).cast("long").alias("pos"), F.when(good, F.concat(own, "g")).alias("segs"),
    )
    for c in (links, *parts, tree, *chains, spot, *segs, inside, *([loop] if loop else [])):
        c.drop()
    columns = ["node", "parent", "state", "root", "depth", "n_descendants", "chain", "pos", "segs"]
    return done.df.select(*columns).unionByName(ends.select(*columns))


def _pieces(rows: Cut, keys: list[str]) -> DataFrame:
    """``k, salts`` of the hot values of ``keys`` together among written rows."""
    counts = rows.df.groupBy(F.struct(*keys).alias("k")).agg(F.count("*").alias("n"))
    return salts_of(counts, "k", "n", rows.seen["n"] or 0)


def paths(h: DataFrame) -> DataFrame:
    """``(node, path)`` from the root down to the node, its chain segments concatenated; null outside trees.

    A chain is taken in blocks of BLOCK places, so a node gathers one row a block of its path; the blocks that very many
    nodes ask for, those of a root's chain, are split into pieces. No group is larger than one path.
    """
    tree = h.where("state = 'tree'")
    block = F.floor(F.col("pos") / BLOCK)
    names = tree.groupBy(F.struct(F.col("chain").alias("c"), block.alias("b")).alias("k")).agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).getField("node").alias("names"))
    own = F.array(F.struct("chain", F.col("pos").alias("upto"))).cast(SEGMENT)
    parts = tree.select("node", F.posexplode(F.concat(own, "segs")).alias("nth", "seg"))
    parts = parts.select("node", "nth", F.col("seg.chain").alias("c"), F.col("seg.upto").alias("upto"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("seg.upto") / BLOCK))).alias("b"))
    asked = cut(parts, "asked", n=F.count("*"))
    rows = salted_join(asked.df.withColumn("k", F.struct("c", "b")).drop("c"), names, "k", _pieces(asked, ["c", "b"]))
    rows = rows.select("node", (-F.col("nth")).alias("a"), "b", F.slice("names", F.lit(1), F.least(F.col("upto") - F.col("b") * BLOCK + 1, F.lit(BLOCK)).cast("int")).alias("names"))
    got = rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("a", "b", "names"))).alias("all"))
    return got.select("node", F.flatten("all.names").alias("path"))


def descendants(h: DataFrame, of: DataFrame) -> DataFrame:
    """``(node, descendant, hops)`` for the nodes of the one-column frame ``of``, from chain intervals.

    A node's descendants are the rest of its own chain and every chain hung at or after its place, each an interval. A
    place belongs to one block of BLOCK places; a node asks for its own block and those after it, so that it meets no more
    than one block's rows that aren't below it. Blocks under which very many nodes hang are split into pieces.
    """
    t = h.where("state = 'tree'")
    ends = t.groupBy(F.col("chain").alias("c")).agg(F.max("pos").alias("last"))
    want = of.toDF("node").distinct().join(t.select("node", F.col("chain").alias("c"), F.col("pos").alias("p"), F.col("depth").alias("d")), "node").join(ends, "c")
    # what hangs at the last place lies one place further
    want = want.withColumn("b", F.explode(F.sequence(F.floor((F.col("p") + 1) / BLOCK), F.floor((F.col("last") + 1) / BLOCK))))
    own = t.select(F.col("chain").alias("c"), F.col("pos").alias("at"), F.col("node").alias("descendant"), "depth")
    hung = t.select(F.explode("segs").alias("s"), F.col("node").alias("descendant"), "depth").select(F.col("s.chain").alias("c"), (F.col("s.upto") + 1).alias("at"), "descendant", "depth")
    below = cut(own.unionByName(hung).withColumn("b", F.floor(F.col("at") / BLOCK)), "below", n=F.count("*"))
    key = F.struct("c", "b")
    rows = salted_join(below.df.withColumn("k", key).drop("c", "b"), want.select(key.alias("k"), "node", "p", "d"), "k", _pieces(below, ["c", "b"]))
    return rows.where("at > p").select("node", "descendant", (F.col("depth") - F.col("d")).alias("hops"))
