"""Counting every distinct term with burst tries.

A worker reads its records in Arrow batches, counts a batch's terms with vector operations and adds the counts to a trie
whose leaves are small tables; a leaf that outgrows its limit bursts into one leaf per next letter. The compact leaves
(prefix, suffixes, counts) are all that leaves the worker. A prefix under which too many entries lie in all is split by
longer prefixes until none is too heavy, so that a merging task holds one matching subtree of bounded size at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from axiomill.plans.cut import cut

#: Entries of a leaf before it bursts.
LEAF = 4096
#: An entry share below 1/ROUTES of all is never split, so at most ROUTES prefixes of one length are.
ROUTES = 4096
#: Prefix lengths tried in turn; beyond the last a heavy prefix is split by hash.
LEVELS = (1, 2, 4, 8, 16, 32)

LEAVES = "prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"
_ARROW = pa.schema(
    [("prefix", pa.string()), ("suffixes", pa.list_(pa.string())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64()))]
)


class BurstTrie:
    """Terms with two counters. A node is a dict of letters to nodes; a leaf is a ``_Leaf`` of suffixes to counts."""

    def __init__(self, limit: int = LEAF):
        self.limit = limit
        self.root: _Leaf | dict = _Leaf()

    def add(self, term: str, occurrences: int, records: int) -> None:
        over, letter, node, at = None, "", self.root, 0
        while type(node) is dict:
            letter = term[at : at + 1]
            over = node
            at += 1
            node = over.get(letter)
            if node is None:
                node = over[letter] = _Leaf()
        key = term[at:]
        held = node.get(key)
        if held is not None:
            held[0] += occurrences
            held[1] += records
            return
        node[key] = [occurrences, records]
        # a leaf under the end of a term holds just the empty suffix and never grows
        if len(node) > self.limit:
            self._burst(over, letter, node)

    def _burst(self, over: dict | None, letter: str, leaf: _Leaf) -> None:
        split: dict = {}
        for key, counts in leaf.items():
            split.setdefault(key[:1], _Leaf())[key[1:]] = counts
        if over is None:
            self.root = split
        else:
            over[letter] = split

    def leaves(self) -> Iterator[tuple[str, _Leaf]]:
        stack: list = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if type(node) is dict:
                stack.extend((prefix + c, x) for c, x in node.items())
            elif node:
                yield prefix, node


class _Leaf(dict):
    pass


def _batch(leaves: list[tuple[str, list[str], list[int], list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*leaves), _ARROW)], schema=_ARROW)


def _grouped(leaves: Iterator[tuple[str, list[str], list[int], list[int]]], size: int = 16 * LEAF) -> Iterator[pa.RecordBatch]:
    """Leaves in batches of about ``size`` entries."""
    held, n = [], 0
    for x in leaves:
        held.append(x)
        n += len(x[1])
        if n >= size:
            yield _batch(held)
            held, n = [], 0
    if held:
        yield _batch(held)


def _packed(trie: BurstTrie) -> Iterator[tuple[str, list[str], list[int], list[int]]]:
    for prefix, leaf in trie.leaves():
        yield prefix, list(leaf), [c[0] for c in leaf.values()], [c[1] for c in leaf.values()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of one worker's trie over its records (terms), and a row without prefix that counts the records."""
    trie, seen = BurstTrie(), 0
    for b in batches:
        lists = b.column(0)
        seen += len(lists)
        values = lists.flatten()
        if not len(values):
            continue
        owner = pc.list_parent_indices(lists).to_numpy()
        coded = values.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        terms = coded.dictionary.to_pylist()
        occurrences = np.bincount(codes, minlength=len(terms)).tolist()
        pairs = np.unique(owner.astype(np.int64) * len(terms) + codes)
        records = np.bincount(pairs % len(terms), minlength=len(terms)).tolist()
        for t, o, r in zip(terms, occurrences, records):
            trie.add(t, o, r)
    yield _batch([(None, [], [], [seen])])
    yield from _grouped(_packed(trie))


def _router(tries: DataFrame, limit: float) -> dict[str, int]:
    """Prefixes under which more than ``limit`` entries lie, with their number: at most total / limit per level."""
    heavy: dict[str, int] = {}
    terms = tries.where("prefix is not null").select(F.explode(F.transform("suffixes", lambda s: F.concat("prefix", s))).alias("t"))
    held = terms
    for k, level in enumerate(LEVELS):
        cut_off = F.substring("t", 1, level)
        part = held.where(F.length("t") >= level).groupBy(cut_off.alias("p")).count().where(F.col("count") > limit)
        found = {r["p"]: r["count"] for r in part.collect()}
        if not found:
            break
        heavy |= found
        if k + 1 < len(LEVELS):
            held = held.where(cut_off.isin(list(found)))
    return heavy


def _route(term: str, heavy: dict[str, int], limit: float) -> str:
    """The shortest tried prefix of ``term`` that isn't heavy."""
    for level in LEVELS:
        p = term[:level]
        if p not in heavy or len(term) <= level:
            return p
    parts = int(heavy[p] // limit) + 1
    return f"{p}\x00{zlib.crc32(term.encode()) % parts}"


def _routed(heavy: dict[str, int], limit: float):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _ARROW.insert(0, pa.field("route", pa.string()))
        for b in batches:
            out: list = []
            for prefix, suffixes, occ, rec in zip(*[c.to_pylist() for c in b.columns]):
                # a leaf whose own prefix, cut to a tried length, isn't heavy goes as a whole
                whole = next((prefix[:n] for n in LEVELS if len(prefix) >= n and prefix[:n] not in heavy), None)
                if whole is not None:
                    out.append((whole, prefix, suffixes, occ, rec))
                    continue
                by: dict[str, list] = {}
                for s, o, r in zip(suffixes, occ, rec):
                    by.setdefault(_route(prefix + s, heavy, limit), []).append((s, o, r))
                out.extend((route, prefix, *map(list, zip(*rows))) for route, rows in by.items())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return split


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the subtrees of each route; routes come one after the other, one is held at a time."""

    def rows(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
        for prefix, leaf in trie.leaves():
            yield pa.RecordBatch.from_arrays(
                [pa.array([prefix + s for s in leaf], pa.string()), pa.array([c[0] for c in leaf.values()], pa.int64()), pa.array([c[1] for c in leaf.values()], pa.int64())],
                names=["term", "occurrences", "records"],
            )

    at, trie = None, BurstTrie()
    for b in batches:
        for route, prefix, suffixes, occ, rec in zip(*[c.to_pylist() for c in b.columns]):
            if route != at:
                yield from rows(trie)
                at, trie = route, BurstTrie()
            for s, o, r in zip(suffixes, occ, rec):
                trie.add(prefix + s, o, r)
    yield from rows(trie)


def term_frequencies(bags: DataFrame, rare: int = 2, common: float = 1 / 20) -> DataFrame:
    """Every distinct term of the collection: ``term, occurrences, records, n_records, mark``.

    ``bags`` is (record, terms array<string>), one row a record; ``n_records`` counts all of them, those without terms too.
    ``mark`` is ``rare`` if at most ``rare`` records hold the term, else ``common`` if more than the share ``common`` of all
    records does, else null. Null terms are ignored; an empty collection gives no rows.
    """
    terms = bags.select(F.array_compact("terms").alias("terms"))
    tries = cut(terms.mapInArrow(_count, LEAVES), "tries", entries=F.sum(F.size("suffixes")), n=F.sum(F.when(F.col("prefix").isNull(), F.col("records")[0])))
    entries, n = tries.seen["entries"] or 0, tries.seen["n"] or 0
    limit = max(LEAF, entries / ROUTES)
    heavy = _router(tries.df, limit)
    leaves = tries.df.where("prefix is not null").mapInArrow(_routed(heavy, limit), "route string, " + LEAVES)
    merged = leaves.repartition("route").sortWithinPartitions("route").mapInArrow(_merge, "term string, occurrences bigint, records bigint")
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(n) * common, "common")
    return merged.withColumns({"n_records": F.lit(n).cast("long"), "mark": mark})
