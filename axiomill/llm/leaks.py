"""Evaluation texts leaking into training text: greedy string tiling with running Karp-Rabin.

The test texts are a query set stated beforehand: they go to the workers in blocks of bounded size and every document is
read once per block, whole, with no shuffle. Document words that no test item of the block uses break the runs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from axiomill.plans.cut import cut
from axiomill.plans.skew import union_all

#: Maximal runs of letters and digits.
WORDS = re.compile(r"[^\W_]+")
#: Characters of test texts sent to the workers at once; a larger test set is taken in several blocks.
BLOCK_CHARS = 16_000_000
#: Documents' characters per step inside a worker.
STEP_CHARS = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``k`` ids, modulo 2^64."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    v = ids.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * _BASE + v[j : j + n]
    return h


def _hits(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of the hashes that are among ``keys``, which are sorted."""
    if not len(keys) or not len(hashes):
        return np.empty(0, np.int64)
    at = np.searchsorted(keys, hashes)
    at[at == len(keys)] = 0
    return np.flatnonzero(keys[at] == hashes)


def _whole(test: np.ndarray, zone: np.ndarray) -> int:
    """The first place in the test where it has the whole zone, or -1."""
    a, b, at = test.tobytes(), zone.tobytes(), -1
    while (at := a.find(b, at + 1)) >= 0:
        if at % test.itemsize == 0:
            return at // test.itemsize
    return -1


def _common(text: np.ndarray, hit: np.ndarray, shortest: int, most: int) -> tuple[list[int], list[int], int]:
    """The text's words under its windows of ``shortest`` words at the places ``hit``, with their places; zones end in 0.

    Of zones that read the same the first ``most`` are given. Third comes the longest zone's length.
    """
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + shortest, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    if len(gaps) >= most:
        zones, met = np.split(at, gaps), defaultdict(int)
        kept = []
        for z in zones:
            key = text[z].tobytes()
            met[key] += 1
            if met[key] <= most:
                kept.append(z)
        if len(kept) < len(zones):
            at = np.concatenate(kept)
            gaps = np.cumsum([len(z) for z in kept])[:-1]
    longest = int(np.diff(np.concatenate([[0], gaps, [len(at)]])).max())
    return np.append(np.insert(text[at], gaps, 0), 0).tolist(), np.append(np.insert(at, gaps, -1), -1).tolist(), longest


def tile(test: np.ndarray, text: np.ndarray, shortest: int, hashes: np.ndarray | None = None, keys: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping common runs (length, place in test, place in text), longest first.

    The search length starts high and falls to ``shortest``; at each length all runs found by hash are extended over
    unmarked words and marked in order of length, so that the first tile is the longest common run. Id 0 matches nothing.
    Only the zones of the text that share a window with the test are tiled: no tile can lie elsewhere. ``hashes`` may
    hold the text's window hashes of length ``shortest``, ``keys`` the test's, sorted.
    """
    keys = np.sort(window_hashes(test, shortest)) if keys is None else keys
    hit = _hits(window_hashes(text, shortest) if hashes is None else hashes, keys)
    if not len(hit):
        return []
    first, stop = int(hit[0]), int(hit[-1]) + shortest
    if stop - first == len(hit) + shortest - 1 and text[first:stop].all() and (p := _whole(test, text[first:stop])) >= 0:
        # the only zone lies in the test as a whole: it is the one tile
        return [(stop - first, p, first)]
    # each tile takes ``shortest`` words of the test, so of many equal zones only so many can be used, the first ones
    t_ids, places, longest = _common(text, hit, shortest, len(test) // shortest + 1)
    p_ids = test.tolist()
    free_p, free_t = [x != 0 for x in p_ids], [x != 0 for x in t_ids]
    tiles: list[tuple[int, int, int]] = []
    length = max(shortest, min(len(p_ids), longest))
    while t_ids:
        by: dict[int, list[int]] = defaultdict(list)
        for p, h in _windows(p_ids, free_p, length):
            by[h].append(p)
        runs: list[tuple[int, int, int]] = []
        end: dict[int, int] = {}
        for t, h in _windows(t_ids, free_t, length) if by else ():
            for p in by.get(h, ()):
                # inside a run that was already extended from further left
                if end.get(t - p, -1) > t:
                    continue
                n = 0
                while p + n < len(p_ids) and p_ids[p + n] == t_ids[t + n] and free_p[p + n] and free_t[t + n]:
                    n += 1
                if n >= length:
                    runs.append((n, p, t))
                    end[t - p] = t + n
        marked = False
        for n, p, t in sorted(runs, key=lambda r: (-r[0], r[1], r[2])):
            if all(free_p[p : p + n]) and all(free_t[t : t + n]):
                free_p[p : p + n] = free_t[t : t + n] = [False] * n
                tiles.append((n, p, places[t]))
                marked = True
        # what was partly covered may still leave a shorter run of this length
        if marked and len(runs) > 1:
            continue
        if length == shortest:
            break
        length = max(shortest, length // 2)
    return sorted(tiles, key=lambda r: (-r[0], r[1], r[2]))


_MODULUS, _FACTOR = (1 << 61) - 1, 1_000_003


def _windows(ids: list[int], free: list[bool], k: int) -> Iterator[tuple[int, int]]:
    """(place, running Karp-Rabin hash) of each window of ``k`` free words."""
    drop = pow(_FACTOR, k, _MODULUS)
    h = n = 0
    for i, x in enumerate(ids):
        if not free[i]:
            h = n = 0
            continue
        h = h * _FACTOR + x
        n += 1
        if n > k:
            h -= ids[i - k] * drop
        h %= _MODULUS
        if n >= k:
            yield i - k + 1, h


def _open(free: np.ndarray, k: int) -> np.ndarray:
    """Which windows of ``k`` lie wholly on free places."""
    if len(free) < k:
        return np.zeros(0, bool)
    c = np.concatenate([[0], np.cumsum(free)])
    return (c[k:] - c[:-k]) == k


class ItemBlock:
    """One block of test items, ready to be looked up: word ids, and the items of each seed."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.ids, self.names, self.item = {}, [], []
        for name, text in items:
            got = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            if got:
                self.names.append(name)
                self.item.append(np.array(got, np.int64))
        # an item shorter than the seed is its own seed, so there are at most ``seed`` lengths: (length, hashes, owners)
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, ids in enumerate(self.item):
            k = min(seed, len(ids))
            by[k] += [(h, i) for h in np.unique(window_hashes(ids, k)).tolist()]
        self.seeds = [(k, np.array([h for h, _ in v], np.uint64), np.array([i for _, i in v], np.int64)) for k, v in sorted((k, sorted(v)) for k, v in by.items())]

    def pairs(self, docs: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(place of the document, place of the item, the document's word ids) for all that share a seed, by document."""
        if not self.seeds or not docs:
            return
        get, parts, ends, at = self.ids.get, [], [], 0
        for text in docs:
            found = words(text)
            parts.append(np.fromiter((get(w, 0) for w in found), np.int64, len(found)))
            parts.append(np.zeros(1, np.int64))
            at += len(found) + 1
            ends.append(at)
        ids, ends = np.concatenate(parts), np.array(ends)
        # per document: the owners of each seed found in it, each seed once
        owners: dict[int, list[np.ndarray]] = defaultdict(list)
        for k, keys, owner in self.seeds:
            known = np.flatnonzero(_open(ids != 0, k))
            if not len(known):
                continue
            hashes = window_hashes(ids, k)[known]
            low, high = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
            hit = np.flatnonzero(high > low)
            doc = np.searchsorted(ends, known[hit], "right")
            for d, a, b in np.unique(np.stack([doc, low[hit], high[hit]], 1), axis=0).tolist():
                owners[d].append(owner[a:b])
        for d in sorted(owners):
            for i in np.unique(np.concatenate(owners.pop(d))).tolist():
                yield d, i, parts[2 * d]


_OUT = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("longest", pa.int32()), ("covered", pa.int32()), ("n_words", pa.int32()), ("tiles", pa.int32())])


def _search(handle, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: ItemBlock = handle.value
        keys: dict[int, np.ndarray] = {}
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows, start = [], 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (size == 0 or size < STEP_CHARS):
                    size += len(texts[stop])
                    stop += 1
                at, hashes = -1, None
                for d, i, ids in tests.pairs(texts[start:stop]):
                    if d != at:
                        at, hashes = d, window_hashes(ids, shortest)
                    # an item of fewer words than the shortest tile counts where it is copied whole
                    n = len(tests.item[i])
                    k = min(shortest, n)
                    if i not in keys:
                        keys[i] = np.sort(window_hashes(tests.item[i], k))
                    tiles = tile(tests.item[i], ids, k, hashes if k == shortest else None, keys[i])
                    if tiles:
                        rows.append((names[start + d], tests.names[i], tiles[0][0], sum(t[0] for t in tiles), n, len(tiles)))
                start = stop
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    return run


def leaks(
    docs: DataFrame, doc: str, text: str, tests: DataFrame, item: str, passage: str, seed: int | None = None, shortest: int = 5, min_run: int = 12, min_coverage: float = 0.5,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Documents that give away test items: ``doc, item, longest, covered, n_words, tiles, coverage, leaked``.

    One row per pair of a document and an item that share ``seed`` consecutive words (any letters and digits, lower
    case), or all words of an item that has fewer. Without ``seed`` it is ``shortest``, so that every pair with a tile is
    there; a longer seed is faster and loses pairs whose runs are all shorter. ``longest`` is the longest common run of words, ``covered`` the item's words under tiles of at least
    ``shortest`` words, which also catches passages in another order. ``leaked`` holds where the longest run has ``min_run`` words or
    the coverage reaches ``min_coverage``. Null texts and ids give no rows; an id that occurs twice may give rows twice.
    """
    spark = docs.sparkSession
    t = tests.select(F.col(item).cast("long").alias("i"), F.col(passage).alias("p")).dropna()
    chars = t.agg(F.sum(F.length("p"))).first()[0] or 0
    blocks = int(chars // block_chars) + 1
    d = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).dropna()
    found = []
    for k in range(blocks):
        # one block at a time, its size bounded by block_chars, whatever the test set holds
        part = t if blocks == 1 else t.where(F.pmod(F.xxhash64("i", "p"), F.lit(blocks)) == k)
        handle = spark.sparkContext.broadcast(ItemBlock([(r["i"], r["p"]) for r in part.collect()], shortest if seed is None else seed))
        rows = d.mapInArrow(_search(handle, shortest), "doc bigint, item bigint, longest int, covered int, n_words int, tiles int")
        if blocks > 1:
            rows = cut(rows, "leaks").df
            handle.destroy()
        found.append(rows)
    out = union_all(found)
    coverage = F.col("covered") / F.col("n_words")
    return out.withColumns({"coverage": coverage, "leaked": (F.col("longest") >= min_run) | (coverage >= min_coverage)})
