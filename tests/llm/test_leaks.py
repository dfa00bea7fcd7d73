import random

import numpy as np

from axiomill.llm.leaks import ItemBlock, leaks, tile, window_hashes, words

NOTE = "Suppose further that Tevquas trusts Ulmjas only about ribbons, never about a single crooked plume numbered 376. Nobody has recorded whether the other crew ever came back from the harbor."
DOCS = "doc_id bigint, text string, doc int, item int"
ITEMS = "item_id bigint, note string"


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], DOCS)
    out = leaks(d, "doc_id", "text", spark.createDataFrame(items, ITEMS), "item_id", "note", **kw)
    return {(r["doc"], r["item"]): r for r in out.collect()}


def test_words():
    assert words("Don't_stop, Ärger-3.5!") == ["don", "t", "stop", "ärger", "3", "5"]


def test_hashes_tell_windows_apart():
    ids = np.array([1, 2, 3, 1, 2, 3, 2])
    h = window_hashes(ids, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4
    assert len(window_hashes(ids, 8)) == 0


def test_found_whole_part_reordered_and_reformatted(spark):
    w = NOTE.split()
    docs = [
        (1, "intro " + NOTE + " outro"), (2, "## " + "\n> ".join(w).upper()), (3, " ".join(w[:12])), (4, " ".join(w[:11]) + " x"), (5, " ".join(w[15:] + ["zzz"] + w[:15])),
        (6, "nothing at all"), (7, ""), (8, None), (9, "a " * 50_000 + NOTE), (None, NOTE),
    ]
    got = run(spark, docs, [(10, NOTE), (11, None), (12, "too short"), (13, "")])
    longest = {d: r["longest"] for (d, i), r in got.items()}
    n = len(words(NOTE))
    assert longest[1] == longest[2] == longest[9] == n and longest[3] == 12 and longest[4] == 11
    assert got[5, 10]["coverage"] == 1.0 and got[5, 10]["tiles"] == 2 and got[5, 10]["leaked"]
    assert not got[4, 10]["leaked"] and 6 not in longest and 7 not in longest and 8 not in longest


def test_blocks_give_the_same(spark):
    r = random.Random(2)
    vocab = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(30))) for i in range(12)]
    docs = [(k, " ".join(r.choice(vocab) for _ in range(10)) + " " + " ".join(items[k % 12][1].split()[k % 9 : k % 9 + 14])) for k in range(30)]
    a = run(spark, docs, items)
    b = run(spark, docs, items, block_chars=300)
    assert {k: tuple(v) for k, v in a.items()} == {k: tuple(v) for k, v in b.items()} and len(a) >= 30


def test_tiling_against_brute_force():
    r = random.Random(7)
    for _ in range(150):
        p = np.array([r.randrange(0, 5) for _ in range(r.randrange(1, 25))])
        t = np.array([r.randrange(0, 5) for _ in range(r.randrange(1, 40))])
        best = max((n for i in range(len(p)) for j in range(len(t)) for n in [_run(p, t, i, j)]), default=0)
        tiles = tile(p, t, 3)
        assert (tiles[0][0] if tiles else 0) == (best if best >= 3 else 0)
        used_p, used_t = np.zeros(len(p), int), np.zeros(len(t), int)
        for n, i, j in tiles:
            assert n >= 3 and (p[i : i + n] == t[j : j + n]).all()
            used_p[i : i + n] += 1
            used_t[j : j + n] += 1
        assert used_p.max(initial=0) <= 1 and used_t.max(initial=0) <= 1


def _run(p, t, i, j):
    n = 0
    while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] != 0:
        n += 1
    return n


def test_empty(spark):
    assert run(spark, [], [(1, NOTE)]) == {} and run(spark, [(1, NOTE)], []) == {}
    assert list(ItemBlock([], 8).pairs(["a b c"])) == []


def test_altered_every_seventh_word(spark):
    """Six words in a row at most: no common run of eight, yet most of the item is there."""
    w = words(NOTE)
    altered = " ".join("zzz" if i % 7 == 6 else x for i, x in enumerate(w))
    got = run(spark, [(1, "intro " + altered + " outro"), (2, " ".join(w[:6]) + " zzz")], [(10, NOTE)])
    assert got[1, 10]["longest"] == 6 and got[1, 10]["covered"] == len(w) // 7 * 6 and got[1, 10]["leaked"]
    assert got[2, 10]["longest"] == 6 and not got[2, 10]["leaked"]
    assert run(spark, [(1, altered)], [(10, NOTE)], seed=8) == {}


def test_items_shorter_than_the_seed(spark):
    items = [(1, "one two three four five six"), (2, "Alpha, beta!"), (3, "--")]
    docs = [(1, "x one two three four five six y"), (2, "x alpha beta y alpha"), (3, "beta alpha"), (4, "one two three four x")]
    for seed in (None, 8):
        got = run(spark, docs, items, seed=seed)
        assert {k: (r["longest"], r["covered"], r["n_words"], r["leaked"]) for k, r in got.items()} == {(1, 1): (6, 6, 6, True), (2, 2): (2, 2, 2, True)}
