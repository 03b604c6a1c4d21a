import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tideline.llm import nearest as N


@given(st.sets(st.integers(0, 2**20), min_size=1, max_size=60), st.lists(st.integers(0, 2**20), min_size=1, max_size=60))
def test_trie_finds_neighbours(keys, queries):
    k = np.array(sorted(keys), np.int64) + (3 << 31)
    q = np.array(queries, np.int64) + (3 << 31)
    pred, succ = N.XFastTrie(k, 31).neighbours(q)
    right = np.searchsorted(k, q, "right") - 1
    left = np.searchsorted(k, q, "left")
    assert pred.tolist() == right.tolist()
    assert succ.tolist() == [x if x < len(k) else -1 for x in left.tolist()]


def test_groups_do_not_mix():
    trie = N.XFastTrie(np.array([(1 << 31) + 5, (3 << 31) + 5], np.int64), 31)
    pred, succ = trie.neighbours(np.array([(2 << 31) + 5, (1 << 31) + 9], np.int64))
    assert pred.tolist() == [-1, 0] and succ.tolist() == [-1, -1]


def _pairs(spark, q, r, tol):
    a = spark.createDataFrame(q, "query_id bigint, entity string, at bigint")
    b = spark.createDataFrame(r, "record_id bigint, entity string, at bigint")
    return {tuple(x) for x in N.nearest(a, b, tol).collect()}


def _brute(q, r, tol):
    out = set()
    for i, e, t in q:
        best = min(((abs(t - u), u, j) for j, f, u in r if f == e and e is not None and t is not None and u is not None and abs(t - u) <= tol), default=None)
        if best:
            out.add((i, best[2]))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 50)
    rng = random.Random(2)
    base = 1_700_000_000_000_000
    edge = (base >> N.BLOCK_BITS) << N.BLOCK_BITS
    when = lambda: rng.choice([base + rng.randrange(10**10), edge + rng.randrange(-3, 4) * 10**6, base])
    q = [(i, rng.choice(["A", "A", "B", None]), rng.choice([when(), when(), None])) for i in range(600)]
    r = [(i, rng.choice(["A", "B"]), when()) for i in range(300)]
    r += [(1000 + i, *x[1:]) for i, x in enumerate(r[:40])]
    tol = 90_000_000
    assert _pairs(spark, q, r, tol) == _brute(q, r, tol)


def test_ties_tolerance_and_empty(spark):
    q = [(1, "A", 100), (2, "A", 1000)]
    r = [(7, "A", 90), (5, "A", 110), (4, "A", 90)]
    assert _pairs(spark, q, r, 10) == {(1, 4)}
    assert _pairs(spark, q, r, 890) == {(1, 4), (2, 5)}
    day = 86_400_000_000
    assert _pairs(spark, [(1, "A", 0), (2, "A", 40 * day)], [(3, "A", 9 * day), (4, "A", 51 * day + day // 2), (5, "A", -8 * day)], 10 * day) == {(1, 5)}
    with pytest.raises(ValueError):
        N.nearest(spark.createDataFrame([], "query_id bigint, entity string, at bigint"), spark.createDataFrame([], "record_id bigint, entity string, at bigint"), -1)
    assert _pairs(spark, [], r, 10) == set() and _pairs(spark, q, [], 10) == set()
