import random

import pytest

from axiomill.operators import hierarchy as module
from axiomill.operators.hierarchy import descendants, hierarchy, paths
from axiomill.plans import skew


def frame(spark, links):
    """Links (child, parent) beside columns whose names clash with the operator's own."""
    rows = [(c, p, "x", 7) for c, p in links]
    return spark.createDataFrame(rows, "kid string, up string, node string, size int")


def brute(links):
    up = {}
    for c, p in links:
        c, p = (None if x is None else x.strip() for x in (c, p))
        if c and p and (c not in up or p < up[c] and up[c] != c or p == c):
            up[c] = p
    out = {}
    for n in set(up) | set(up.values()):
        seen, x = [], n
        while x in up and x not in seen:
            seen.append(x)
            x = up[x]
        if x not in up:
            out[n] = ("tree", x, [*seen, x][::-1])
        else:
            out[n] = ("cycle" if x == n else "below_cycle", None, None)
    return out


def check(spark, links):
    h = hierarchy(frame(spark, links), "kid", "up").cache()
    want = brute(links)
    got = {r["node"]: r for r in h.collect()}
    assert len(got) == h.count() == len(want)
    for n, (state, root, path) in want.items():
        assert (got[n]["state"], got[n]["root"]) == (state, root), n
        if path:
            assert got[n]["depth"] == len(path) - 1
    whole = {n: p for n, (_, _, p) in want.items() if p}
    assert {r["node"]: r["path"] for r in paths(h).collect()} == whole
    below = {(p[i], p[-1], len(p) - 1 - i) for p in whole.values() for i in range(len(p) - 1)}
    assert {tuple(r) for r in descendants(h, h.select("node")).collect()} == below
    for n in whole:
        assert got[n]["n_descendants"] == sum(a == n for a, _, _ in below)


@pytest.mark.parametrize("tail", [0, 50_000])
def test_trees_cycles_chains_and_dirt(spark, tail, monkeypatch):
    """One frame of everything, since a call takes as many rounds for one tree as for all; with and without a last task."""
    monkeypatch.setattr(module, "TAIL_ROWS", tail)
    if tail < 50_000:
        monkeypatch.setattr(module, "BLOCK", 4)
        monkeypatch.setattr(module, "salts_of", lambda c, k, r, n: skew.salts_of(c, k, r, n, 5))
    links = [
        ("b", "a"), (" b ", "a\t"), ("c", "b"), ("d", "b"), ("e", "d"), ("f", "a"), ("s", "s"), ("t", "s"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("v", "w"),
        (None, "a"), ("q", None), (None, None), ("", "a"), ("g", " "), ("c", "b"),
    ]
    # a long chain with a hot parent in it, and a cycle with a tail
    links += [(f"n{i}", f"n{i - 1}") for i in range(1, 24)] + [(f"leaf{i}", "n12") for i in range(60)]
    links += [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [("tail1", "c3"), ("tail2", "tail1")]
    r = random.Random(4)
    links += [(f"k{i}", f"k{r.randrange(max(1, i))}") for i in range(1, 80)]
    # several parents: the first by name
    links += [("mc", "mb"), ("mc", "ma"), ("md", "mc")]
    check(spark, links)


def test_empty(spark):
    h = hierarchy(frame(spark, [(None, None)]), "kid", "up")
    assert h.count() == 0 and paths(h).count() == 0 and descendants(h, h.select("node")).count() == 0
