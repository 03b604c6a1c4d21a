import random
from datetime import datetime

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tideline.operators import delivery as D

FLASH = "row_id bigint, batch_id bigint, id string, surplus string, key string"


@given(st.lists(st.integers(0, 60), max_size=120), st.integers(1, 7))
def test_ranges_accept_each_number_once(numbers, step):
    seen, known, got, want = D.SeenRanges(), set(), [], []
    for i in range(0, len(numbers), step):
        got += seen.offer(np.array(numbers[i : i + step], np.int64)).tolist()
    for n in numbers:
        want.append(n not in known)
        known.add(n)
    assert got == want
    covered = {x for a, b in zip(seen.lo, seen.hi, strict=True) for x in range(a, b + 1)}
    assert covered == known
    assert all(b + 1 < a for a, b in zip(seen.lo[1:], seen.hi[:-1], strict=True))


def _flash(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], FLASH)


def test_surplus_messages(spark):
    a, b = "20250101000000000000001", "20250101000000000000002"
    rows = [(1, 5, a), (2, 4, f" {a}\n"), (3, 4, a), (4, 1, b), (5, None, b), (6, 1, None), (7, 1, " "), (8, 1, "NaN"), (9, 2, "None"), (10, 1, "AbC"), (11, 1, "abc "), (12, 0, a + "0")]
    assert sorted(r[0] for r in D.surplus_messages(_flash(spark, rows)).collect()) == [1, 3, 4, 11]


def test_hot_message_and_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        n = 7 if rng.random() < 0.35 else rng.randrange(900)
        rows.append((i, rng.randrange(50), f"2025010{rng.randrange(1, 4)}{n:015d}" if n != 7 else f"20250101{7:015d}"))
    best = {}
    for r, b, k in rows:
        best[k] = min(best.get(k, (b, r)), (b, r))
    want = sorted(r for r, b, k in rows if best[k] != (b, r))
    got = D.surplus_messages(_flash(spark, rows).repartition(5)).collect()
    assert sorted(r[0] for r in got) == want


def test_surplus_articles(spark):
    t = datetime(2025, 1, 1)
    rows = [(1, "A", "ff", t), (2, "a ", "FF", datetime(2024, 1, 1)), (3, "b", "ff", t), (4, "a", None, t), (5, "a", "null", t), (6, None, "ff", t), (7, None, "ff", t)]
    d = spark.createDataFrame(rows, "id bigint, site string, hash string, created_at timestamp_ntz")
    assert sorted(r[0] for r in D.surplus_articles(d).collect()) == [1, 7]


def test_ranges_cross_blocks(spark):
    numbers = [D.BLOCK - 2, D.BLOCK - 1, D.BLOCK, D.BLOCK + 1, D.BLOCK + 5, 2 * D.BLOCK - 1]
    d = _flash(spark, [(i, 1, f"20250101{n:015d}") for i, n in enumerate(numbers)])
    got = sorted((r.lo, r.hi, r.n) for r in D.seen_ranges(d).collect())
    assert got == [(D.BLOCK - 2, D.BLOCK + 1, 4), (D.BLOCK + 5, D.BLOCK + 5, 1), (2 * D.BLOCK - 1, 2 * D.BLOCK - 1, 1)]


def test_empty(spark):
    assert D.surplus_messages(spark.createDataFrame([], FLASH)).count() == 0
    assert D.surplus_articles(spark.createDataFrame([], "id bigint, site string, hash string, created_at timestamp_ntz")).count() == 0
    assert D.seen_ranges(spark.createDataFrame([], FLASH)).count() == 0


def test_stream_keeps_ranges_between_batches(spark, tmp_path):
    from tideline.streaming.deliveries import accepted

    rng = random.Random(8)
    schema = "row_id bigint, batch_id bigint, id string"
    want, n = set(), 0
    for part in range(3):
        rows = [(n + i, part, f"2025010{rng.randrange(1, 3)}{rng.randrange(60):015d}") for i in range(80)] + [(n + 80, part, None), (n + 81, part, "abc")]
        n += 100
        for r in rows[:80]:
            want.add(r[2])
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = accepted(stream).writeStream.format("memory").queryName("first_by_range").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [f"{r.producer}{r.number:015d}" for r in spark.table("first_by_range").collect()]
    assert sorted(got) == sorted(want)


def test_open_range():
    """Batches of any size, cut anywhere, give what one batch gives; only one range is held."""
    rng = np.random.default_rng(3)
    rows = np.sort(rng.integers(0, 3, 500) * 10_000 + rng.integers(0, 150, 500))
    producer, number = rows // 10_000, rows % 10_000
    want = np.append(True, rows[1:] != rows[:-1])
    for size in (1, 2, 7, 500):
        r = D.OpenRange()
        got = np.concatenate([r.offer(producer[i : i + size], number[i : i + size]) for i in range(0, 500, size)])
        assert got.tolist() == want.tolist()
        last = [n for p, n in zip(producer, number, strict=True) if p == producer[-1]]
        lo = last[-1]
        while lo - 1 in last:
            lo -= 1
        assert (r.producer, r.lo, r.hi) == (producer[-1], lo, last[-1])
