"""Evaluation texts inside training texts, by spaced seeds.

A seed is a window of SPAN characters of the folded text of which a fixed mask
ignores some positions; an equal seed of an item and a document starts a
comparison along their diagonal, which bears substitutions. Items and documents
are seeded at every position with every mask, so no run of SPAN equal characters
is missed, and a substituted overlap is met wherever the substitutions of one
window fall on ignored positions of one of the masks. All diagonals that were hit
are measured together: the longest run of equal characters, and the longest
stretch around a seed whose share of substitutions stays within TOLERANCE.
What a caller asks of an overlap is decided after that measurement.

The items' seeds are shipped to the tasks while they are at most MAX_SHIPPED
characters, which is checked; each worker sorts them once. Beyond that they meet
the documents' seeds in a join salted on both sides and only the hits travel.

Defined results: null and empty texts contain nothing; rows without an id take no part; repeated documents are
all reported; items shorter than their required run are never found; an item
without a known language needs the longer run; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.fold import fold
from tideline.session import cut, salted_join, spread

#: Fixed masks; 0: the position is ignored.
MASKS = ("1110110100110111", "1101011011011011")
SPAN = 16
NEED = {"en": 50, "zh": 24}
DEFAULT_NEED = 50
TOLERANCE = 0.1
#: Characters of folded items that are shipped to every task.
MAX_SHIPPED = 4_000_000
#: Hits, and characters on diagonals, that are held at once.
HELD = 1 << 20
_ROLL = np.random.default_rng(20240229).integers(1, 2**63, SPAN, dtype=np.uint64) | np.uint64(1)


def _codes(folded: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each text begins (one more at the end)."""
    flat = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.append(0, np.cumsum(np.fromiter(map(len, folded), np.int64, len(folded))))


def seeds(flat: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where the windows of all texts begin, and their hashes by each mask."""
    n = max(0, len(flat) - SPAN + 1)
    sums = [np.zeros(n, np.uint64) for _ in MASKS]
    wide = flat.astype(np.uint64)
    for i in range(SPAN):
        part = wide[i : i + n] * _ROLL[i]
        for s, mask in zip(sums, MASKS, strict=True):
            if mask[i] == "1":
                s += part
    left = np.repeat(begins[1:], np.diff(begins))[:n] - np.arange(n)  # characters left in the text
    at = np.flatnonzero(left >= SPAN)
    out = []
    for s in sums:
        h = s[at]
        h ^= h >> np.uint64(29)
        out.append(h * np.uint64(0x9E3779B97F4A7C15))
    return at, out


def _reach(equal: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How far each of the places reaches to the right, to an equal character."""
    surplus = np.append(0, np.cumsum(~equal)) - TOLERANCE * np.arange(len(equal) + 1)
    # the farthest end whose surplus is not above the place's own: least values from the right only grow
    ends = np.append(np.inf, np.where(equal, surplus[1:], np.inf))
    least = np.minimum.accumulate(ends[::-1])[::-1]
    return np.maximum(np.searchsorted(least, surplus[at] + 1e-6, "right") - 1 - at, 0)


def tolerant(equal: np.ndarray) -> int:
    """Longest tolerant stretch of a diagonal around any window a mask bears."""
    n = len(equal)
    hit = np.zeros(max(0, n - SPAN + 1), bool)
    for mask in MASKS:
        hit |= np.logical_and.reduce([equal[k : k + len(hit)] for k, used in enumerate(mask) if used == "1"])
    at = np.flatnonzero(hit)
    return int((_reach(equal, at) + _reach(equal[::-1], n - at)).max(initial=0))


class Items:
    """The items' folded texts and sorted seeds, one table a mask."""

    def __init__(self, rows: list[tuple[int, str, str | None]]) -> None:
        """rows: (item_id, folded text, lang)."""
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.need = np.array([NEED.get(r[2], DEFAULT_NEED) for r in rows], np.int64)
        self.flat, self.begins = _codes([r[1] for r in rows])
        at, hashes = seeds(self.flat, self.begins)
        self.tables = []
        for h in hashes:
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 22, bool)
            seen[h >> np.uint64(42)] = True
            self.tables.append((h[order], at[order], seen))


_BUILT: dict[str, Items] = {}


def _built(key: str, rows: list[tuple[int, str, str | None]]) -> Items:
    """The table of a broadcast, built once a worker; only the last one is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Items(rows)
    return _BUILT[key]


def _diagonals(items: Items, flat: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, item, shift) that a seed of any mask hits; shift: place in the document less place in the item."""
    at, hashes = seeds(flat, begins)
    wide = int(max(np.diff(begins).max(initial=0), np.diff(items.begins).max(initial=0))) + 1
    found: list[np.ndarray] = []
    held = 0
    for dh, (h, where, seen) in zip(hashes, items.tables, strict=True):
        some = np.flatnonzero(seen[dh >> np.uint64(42)])
        lo = np.searchsorted(h, dh[some], "left")
        n = np.searchsorted(h, dh[some], "right") - lo
        some, lo, n = some[n > 0], lo[n > 0], n[n > 0]
        total = np.cumsum(n)
        i = 0
        while i < len(some):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + HELD, "right")))
            k = np.repeat(np.arange(i, j), n[i:j])
            item_at = where[lo[k] + np.arange(len(k)) - np.repeat(np.append(0, np.cumsum(n[i:j])[:-1]), n[i:j])]
            doc_at = at[some[k]]
            d = np.searchsorted(begins, doc_at, "right") - 1
            it = np.searchsorted(items.begins, item_at, "right") - 1
            shift = (doc_at - begins[d]) - (item_at - items.begins[it]) + wide
            # document, item and shift as one number where they fit, as they nearly always do
            found.append(np.unique((d * len(items.ids) + it) * (2 * wide) + shift))
            held += len(found[-1])
            if held > 4 * HELD:
                found = [np.unique(np.concatenate(found))]
                held = len(found[0])
            i = j
    key = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    pair, shift = key // (2 * wide), key % (2 * wide) - wide
    return pair // max(1, len(items.ids)), pair % max(1, len(items.ids)), shift


def scan(items: Items, keys: np.ndarray, folded: list[str]) -> list[tuple[int, int, int, int, bool]]:
    """(key, item id, longest run, tolerant stretch, exact) of each document and item of which either has the item's required length."""
    flat, begins = _codes(folded)
    doc, item, shift = _diagonals(items, flat, begins)
    if not len(doc):
        return []
    i, j = np.maximum(shift, 0), np.maximum(-shift, 0)
    n = np.minimum(begins[doc + 1] - begins[doc] - i, items.begins[item + 1] - items.begins[item] - j)
    a, b = begins[doc] + i, items.begins[item] + j
    run, most = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    total = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + HELD, "right")))
        m = n[lo:hi]
        first = np.cumsum(m) - m
        step = np.arange(m.sum()) - np.repeat(first, m)
        equal = flat[np.repeat(a[lo:hi], m) + step] == items.flat[np.repeat(b[lo:hi], m) + step]
        # runs end at a difference or at the end of a diagonal
        wrong = np.cumsum(~equal)
        back = np.maximum.accumulate(np.where(equal, -1, np.arange(len(equal))))
        back = np.maximum(back, np.repeat(first, m) - 1)
        run[lo:hi] = np.maximum.reduceat(np.arange(len(equal)) - back, first)
        ends = wrong[first + m - 1]
        most[lo:hi] = m - np.diff(np.append(0, ends))
        lo = hi
    # a stretch has at least so many equal characters, so this is the most it can be
    most = np.where(most == n, n, np.minimum(n, np.floor(most / (1 - TOLERANCE) + 1e-6).astype(np.int64)))
    need = items.need[item]
    out = []
    some = np.flatnonzero(np.maximum(run, most) >= need)
    some = some[np.lexsort((-most[some], item[some], doc[some]))]
    heads = np.flatnonzero(np.append(True, (doc[some][1:] != doc[some][:-1]) | (item[some][1:] != item[some][:-1]))) if len(some) else some
    for g in np.split(some, heads[1:]) if len(some) else ():
        longest, near = int(run[g].max()), 0
        for x in g:
            if most[x] <= near:
                break
            equal = flat[a[x] : a[x] + n[x]] == items.flat[b[x] : b[x] + n[x]]
            near = max(near, int(n[x]) if run[x] == n[x] else tolerant(equal))
        x = g[0]
        if max(longest, near) >= need[x]:
            out.append((int(keys[doc[x]]), int(items.ids[item[x]]), longest, near, bool(longest >= need[x])))
    return out


_OUT = "doc_id bigint, item_id bigint, longest_run int, tolerant int, exact boolean"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "longest_run", "tolerant", "exact"])


def _parts(b: pa.RecordBatch, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text, so that long texts do not meet in memory."""
    size = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + chars, "right")))
        yield b.slice(at, end - at)
        at = end


def leaks(docs: DataFrame, items: DataFrame, max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """(doc_id, item_id, longest_run, tolerant, exact), one row a document and item.

    ``exact``: a run of equal characters has the item's required length; where it
    is false only the stretch with substitutions has.
    """
    spark = docs.sparkSession
    it = items.where("text is not null and item_id is not null").select("item_id", "text", "lang")
    size = it.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    d = spread(docs.where("length(text) > 0 and doc_id is not null").select("doc_id", "text"), "doc_id")
    if size <= max_shipped:
        shipped = spark.sparkContext.broadcast([(r.item_id, fold(r.text), r.lang) for r in it.toLocalIterator()])
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = _built(key, shipped.value)
            for whole in batches:
                for b in _parts(whole):
                    yield _batch(scan(table, b.column("doc_id").to_numpy(), [fold(t) for t in b.column("text").to_pylist()]))

        return d.mapInArrow(run, _OUT)
    return _by_join(d, it)


def _by_join(d: DataFrame, it: DataFrame) -> DataFrame:
    """The same for items of any number: distinct seeds meet in a join salted on both sides."""

    def emit(key: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in _parts(whole):
                    flat, begins = _codes([fold(t) for t in b.column("text").to_pylist()])
                    keys = b.column(key).to_numpy()
                    at, hashes = seeds(flat, begins)
                    text = np.searchsorted(begins, at, "right") - 1
                    for n, h in enumerate(hashes):
                        once = np.unique(np.stack([h.view(np.int64), text]), axis=1)  # a seed once a text
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(once[0]), pa.array(keys[once[1]]), pa.array(np.full(once.shape[1], n, np.int32))], ["h", key, "mask"])

        return run

    ds = d.mapInArrow(emit("doc_id"), "h bigint, doc_id bigint, mask int")
    its = it.select("item_id", "text").mapInArrow(emit("item_id"), "h bigint, item_id bigint, mask int").distinct()
    # seeds without a partner go before anything is counted
    ds = ds.join(its.select("h", "mask").distinct(), ["h", "mask"], "left_semi")
    hits = cut(salted_join(ds, its, ["h", "mask"], F.xxhash64("doc_id"), F.xxhash64("item_id")).select("doc_id", "item_id").distinct())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, item_id, item, lang in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "item", "lang")), strict=True):
                out += scan(Items([(item_id, fold(item), lang)]), np.array([doc_id]), [fold(text)])
            yield _batch(out)

    both = salted_join(hits, d, ["doc_id"], F.xxhash64("item_id"))
    both = salted_join(both, it.withColumnRenamed("text", "item"), ["item_id"], F.xxhash64("doc_id"))
    return both.select("doc_id", "text", "item_id", "item", "lang").mapInArrow(check, _OUT)
