import random
import time

import numpy as np
import pytest

from tideline.llm import leakage as L
from tideline.llm.fold import fold


def _frames(spark, docs, items):
    d = spark.createDataFrame([(*x, "i") for x in docs], "doc_id bigint, text string, item_id string")
    return d, spark.createDataFrame([(*x, "c") for x in items], "item_id bigint, text string, lang string, doc_id string")


def _brute(docs, items):
    out = set()
    for i, t, lang in items:
        f, n = fold(t or ""), L.NEED.get(lang, L.DEFAULT_NEED)
        w = {f[k : k + n] for k in range(len(f) - n + 1)}
        for d, x in docs:
            g = fold(x or "")
            if any(g[k : k + n] in w for k in range(len(g) - n + 1)):
                out.add((d, i))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(6)
    en = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    zh = lambda n: "".join(rng.choice("金银铜铁市场价格上下，") for _ in range(n))
    items = [(i, en(150), "en") for i in range(8)] + [(20 + i, zh(70), "zh") for i in range(8)] + [(40, None, "en"), (41, "", "zh"), (42, "short", "en"), (43, en(120), None)]
    docs = [(900, None), (901, ""), (902, "a" * 100_000)]
    for k in range(300):
        i, t, lang = rng.choice(items[:16])
        n = L.NEED[lang] + rng.choice([-1, 0, 1, 5]) + rng.randrange(6)
        s = rng.randrange(max(1, len(t) - n - 12))
        piece = t[s : s + n + 8]
        if rng.random() < 0.3:
            piece = piece.upper().replace(" ", "<br/> ")
        docs.append((k, (en(rng.randrange(40)) if lang == "en" else zh(rng.randrange(40))) + piece + zh(rng.randrange(30))))
    return docs, items


def test_against_brute_force(spark, case):
    d, it = _frames(spark, *case)
    want = _brute(*case)
    assert {(r.doc_id, r.item_id) for r in L.leaks(d, it).where("exact").collect()} == want and want
    assert {(r.doc_id, r.item_id) for r in L.leaks(d, it, max_shipped=0).where("exact").collect()} == want


def test_substitutions_are_reported(spark):
    t = "".join(chr(0x4E01 + i) for i in range(60))
    broken = "".join(c if i % 20 else "一" for i, c in enumerate(t))
    d, it = _frames(spark, [(1, broken)], [(1, t, "zh")])
    assert L.leaks(d, it).where("exact").count() == 0
    r = L.leaks(d, it).first()
    assert r.longest_run == 19 and r.tolerant >= 50


def test_empty(spark, case):
    d, it = _frames(spark, *case)
    assert L.leaks(d.limit(0), it).count() == 0 and L.leaks(d, it.limit(0)).count() == 0


def _tolerant(f, g):
    """Longest stretch around any window of f and g that a mask bears, by trying all of them."""
    best = 0
    for i in range(len(f) - L.SPAN + 1):
        for j in range(len(g) - L.SPAN + 1):
            if any(all(u == "0" or f[i + k] == g[j + k] for k, u in enumerate(m)) for m in L.MASKS):
                sides = [list(zip(f[i:], g[j:], strict=False)), list(zip(f[:i][::-1], g[:j][::-1], strict=False))]
                reach = [max((n for n in range(1, len(s) + 1) if s[n - 1][0] == s[n - 1][1] and sum(x != y for x, y in s[:n]) * 10 <= n), default=0) for s in sides]
                best = max(best, sum(reach))
    return best


def test_report_against_brute_force(spark):
    rng = random.Random(3)
    zh = lambda n: "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(n))
    items = [(i, zh(60), "zh") for i in range(4)]
    docs = []
    for k in range(60):
        piece = list(items[k % 4][1][k % 7 : k % 7 + 24 + k % 5])
        for i in rng.sample(range(len(piece)), 2):
            piece[i] = "一"
        docs.append((k, zh(rng.randrange(20)) + "".join(piece) + zh(rng.randrange(20))))
    want = {(d, i, n) for d, t in docs for i, x, _ in items if (n := _tolerant(fold(t), fold(x))) >= L.NEED["zh"]}
    d, it = _frames(spark, docs, items)
    assert len(want) > 30
    for most in (L.MAX_SHIPPED, 0):
        assert {(r.doc_id, r.item_id, r.tolerant) for r in L.leaks(d, it, max_shipped=most).collect()} == want


def test_hot_seeds():
    items = L.Items([(7, "a" * 60, "en"), (8, "b" * 400 + "c" * 60, "en")])
    t = time.time()
    assert sorted(L.scan(items, np.array([1, 2]), ["a" * 100_000, "xb" * 3 + "b" * 70])) == [(1, 7, 60, 60, True), (2, 8, 71, 75, True)]
    assert time.time() - t < 5  # a second on an idle machine


def test_hot_rows_are_salted(spark):
    """A third of all documents hold one and the same passage, and the items' seeds meet them in a join."""
    rng = random.Random(1)
    en = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    t = en(80)
    d, it = _frames(spark, [(k, t if k % 3 == 0 else en(60)) for k in range(600)], [(1, t, "en"), (2, en(90), "en")])
    assert {r.doc_id for r in L.leaks(d, it, max_shipped=0).where("exact").collect()} == set(range(0, 600, 3))


def test_recall_with_substitutions():
    """One character in twelve of a passage is another: found by the two masks at every position."""
    rng = random.Random(9)
    en = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    texts = [(i, en(200), "en") for i in range(50)]
    items, hit = L.Items(texts), 0
    for i, t, _ in texts:
        piece = list(t[20:92])
        for k in rng.sample(range(72), 6):
            piece[k] = "z"
        hit += any(r[1] == i for r in L.scan(items, np.array([0]), [en(30) + "".join(piece) + en(30)]))
    assert hit >= 45
