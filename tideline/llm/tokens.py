"""Encoding of a corpus with a public byte-level BPE vocabulary, exactly.

An Aho-Corasick automaton of the reversed tokens runs over a word from its end:
its failure links give the longest token that starts at each place in one pass.
A word is then encoded by backtracking: at each place the longest token is tried
first; it may follow the token before it only if the pair is compatible, that is
if merging the two tokens' bytes by rank could not have joined them otherwise; if
no prefix token fits, the place is marked as dead and the step before is taken
back. Each place dies at most once, so the work is linear, and the result is what
merging by rank gives. Which pairs are compatible is kept in a table.

The short words of a batch go through both searches together, as arrays; words
of more than LONG bytes go one by one. A word that was encoded before is looked
up. Decoding gathers the tokens' bytes through an offset table.

Defined results: an empty and a null text give the empty list; special tokens'
strings are ordinary text; texts of any length are encoded whole; other columns
are not looked at.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tideline.session import spread

#: Folder of the vocabulary files; a parameter of every operator here.
VOCABULARIES = "/opt/tokenizers"
#: Words kept from batch to batch; beyond that the table is begun anew.
KEPT_WORDS = 300_000
#: Bytes of a word from which it is encoded by itself.
LONG = 64
#: Cells of the table of compatible pairs, and pairs kept for long words.
PAIR_CELLS, KEPT_PAIRS = 1 << 20, 1_000_000


LETTER, NUMBER, SPACE, OTHER = range(4)


@functools.cache
def _kinds() -> np.ndarray:
    """Kind of each code point, by its Unicode category."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def word_starts(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pre-tokeniser's words begin; ``first`` marks each text's first place.

    Words are runs of letters, of numbers or of other signs, each with one blank
    before it; the contractions s t re ve m ll d after an apostrophe that begins
    a word; and white space, of which the last sign before a word stands apart.
    """
    kind = _kinds()[code]
    n = len(code)
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    last = np.empty(n, bool)  # last place of a text
    last[:-1], last[-1] = first[1:], True
    run_end = np.empty(n, bool)
    run_end[:-1], run_end[-1] = run[1:], True
    space = kind == SPACE
    apart = np.flatnonzero(space & run_end & ~last)
    start[apart] = True
    start[apart[code[apart] == 32] + 1] = False
    quote = np.flatnonzero((code == 39) & run & ~last)
    quote = quote[kind[quote + 1] == LETTER]
    quote = quote[first[quote] | (code[quote - 1] != 32)]
    c1 = code[quote + 1]
    two = np.where(last[quote + 1] | (quote + 2 >= n), 0, code[np.minimum(quote + 2, n - 1)])
    short = np.isin(c1, [ord(c) for c in "stmd"])
    long_ = ((c1 == ord("r")) | (c1 == ord("v"))) & (two == ord("e")) | (c1 == ord("l")) & (two == ord("l"))
    start[quote[short | long_] + 1] = False
    after = np.concatenate((quote[short] + 2, quote[long_] + 3))
    start[after[after < n]] = True
    return start


def split_words(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Words of all texts in a row, and their number in each text."""
    whole = "".join(t for t in texts if t)
    size = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    if not whole:
        return [], np.zeros(len(texts), np.int64)
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(size) - size
    first = np.zeros(len(code), bool)
    first[begin[size > 0]] = True
    start = word_starts(code, first)
    at = np.append(np.flatnonzero(start), len(code))
    cuts = at.tolist()
    words = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
    total = np.searchsorted(at[:-1], begin + size) - np.searchsorted(at[:-1], begin)
    return words, total


class Vocabulary:
    """Tokens as bytes, their automaton, how each token was merged, and the pairs that may stand side by side."""

    def __init__(self, folder: str, name: str) -> None:
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        n = max(rank.values()) + 1
        self.bytes: list[bytes] = [b""] * n
        for t, i in rank.items():
            self.bytes[i] = t
        self.size = np.array([len(t) for t in self.bytes], np.int64)
        self.offset = np.append(0, np.cumsum(self.size))
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        # longest shorter token that is a prefix
        self.shorter = np.full(n, -1, np.int64)
        for t, i in rank.items():
            for k in range(len(t) - 1, 0, -1):
                if (p := rank.get(t[:k])) is not None:
                    self.shorter[i] = p
                    break
        self.size_of, self.shorter_of = self.size.tolist(), self.shorter.tolist()
        self.pair_key, self.pair_fits = np.full(PAIR_CELLS, -1, np.int64), np.zeros(PAIR_CELLS, bool)
        self.pairs: dict[int, bool] = {}
        self._merges(rank, folder, name)
        self._automaton()

    def _merges(self, rank: dict[bytes, int], folder: str, name: str) -> None:
        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        # printable stand-ins of the 256 bytes: printable bytes stand for themselves, the rest follow from 256 on
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        stand = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        n = len(self.bytes)
        self.left, self.right = np.arange(n), np.arange(n)
        keys, made = [], []
        for m in merges:
            a, b = (bytes(stand[c] for c in part) for part in (m.split(" ") if isinstance(m, str) else m))
            x, y, z = rank[a], rank[b], rank[a + b]
            self.left[z], self.right[z] = x, y
            keys.append(x << 17 | y)
            made.append(z)
        self.left_of, self.right_of, self.made_of = self.left.tolist(), self.right.tolist(), dict(zip(keys, made, strict=True))
        order = np.argsort(np.array(keys))
        self.pair, self.made = np.array(keys)[order], np.array(made)[order]

    def _automaton(self) -> None:
        """States of the reversed tokens' trie: edges (state, byte) -> state, failure links, longest token that ends a state's path."""
        edge: dict[int, int] = {}
        accept, parent, byte, depth = [-1], [0], [0], [0]
        for i, t in enumerate(self.bytes):
            s = 0
            for b in reversed(t):
                k = s << 8 | b
                if (nxt := edge.get(k)) is None:
                    nxt = edge[k] = len(accept)
                    accept.append(-1)
                    parent.append(s)
                    byte.append(b)
                    depth.append(depth[s] + 1)
                s = nxt
            if t:
                accept[s] = i
        self.edge = np.array(sorted(edge), np.int64)
        self.target = np.array([edge[k] for k in self.edge.tolist()], np.int64)
        self.fail, self.out = np.zeros(len(accept), np.int64), np.array(accept, np.int64)
        up, by, deep = np.array(parent), np.array(byte), np.array(depth)
        for d in range(2, int(deep.max()) + 1):
            at = np.flatnonzero(deep == d)
            self.fail[at] = self._step(self.fail[up[at]], by[at])
            self.out[at] = np.where(self.out[at] >= 0, self.out[at], self.out[self.fail[at]])
        # the same for one word at a time
        self.edge_of, self.fail_of, self.out_of = edge, self.fail.tolist(), self.out.tolist()

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The automaton's next states: failure links are followed until one has the byte, or to the root."""
        state, out = state.copy(), np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo] << 8 | byte[todo]
            i = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            on = self.edge[i] == key
            out[todo[on]] = self.target[i[on]]
            todo = todo[~on & (state[todo] > 0)]
            state[todo] = self.fail[state[todo]]
        return out

    def longest(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Longest token at each place of ``text`` that ends inside its word; the words go side by side, from their ends."""
        best = np.full(len(text), -1, np.int64)
        w = np.flatnonzero(size > 0)
        at, state = begin[w] + size[w] - 1, np.zeros(len(w), np.int64)
        while len(w):
            state = self._step(state, text[at])
            best[at] = self.out[state]
            on = at > begin[w]
            w, at, state = w[on], at[on] - 1, state[on]
        return best

    def _merged(self, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        key = a << 17 | b
        i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[i] == key, self.made[i], none)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging by rank can leave a border between tokens a and b.

        The merges are undone from the last one, always on the side that was
        merged later; a pair across the border that merges before the token that
        was undone would have been joined, so the border cannot stand.
        """
        out = np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        far = np.iinfo(np.int64).max
        while len(at):
            joined = self._merged(a, b, far) < limit
            out[at[joined]] = False
            at, a, b, limit = (x[~joined] for x in (at, a, b, limit))
            # ties of rank are decided from the left, so undoing b bars its own rank too
            undo_a = a > b
            whole_a, whole_b = self.right[a] == a, self.left[b] == b
            undo_a = np.where(undo_a, ~whole_a, whole_b & ~whole_a)
            end = whole_a & whole_b
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            at, a, b, limit = (x[~end] for x in (at, a, b, limit))
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`compatible` through the table; a cell holds the pair that asked last."""
        key = a << 17 | b
        cell = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        miss = np.flatnonzero(self.pair_key[cell] != key)
        out = self.pair_fits[cell]
        if len(miss):
            out[miss] = self.compatible(a[miss], b[miss])
            # equal cells: the last one wins in both arrays
            self.pair_key[cell[miss]] = key[miss]
            self.pair_fits[cell[miss]] = out[miss]
        return out

    def _fits_one(self, a: int, b: int) -> bool:
        key = a << 17 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self._compatible_one(a, b)
        return got

    def _compatible_one(self, a: int, b: int) -> bool:
        """`compatible` of one pair."""
        left, right, made, limit = self.left_of, self.right_of, self.made_of, len(self.bytes)
        while True:
            if made.get(a << 17 | b, limit) < limit:
                return False
            whole_a, whole_b = right[a] == a, left[b] == b
            if whole_a and whole_b:
                return True
            if not whole_a and (a > b or whole_b):
                a, limit = right[a], a
            else:
                b, limit = left[b], b + 1

    def encode_long(self, word: bytes) -> list[int]:
        """Tokens of one word, place by place."""
        edge, fail, out = self.edge_of, self.fail_of, self.out_of
        best, state = [0] * len(word), 0
        for i in range(len(word) - 1, -1, -1):
            b = word[i]
            while (nxt := edge.get(state << 8 | b)) is None and state:
                state = fail[state]
            state = nxt or 0
            best[i] = out[state]
        alive, stack, pos, token = bytearray(b"\x01") * (len(word) + 1), [], 0, best[0]
        size, shorter = self.size_of, self.shorter_of
        while pos < len(word):
            end = pos + size[token]
            if alive[end] and (not stack or self._fits_one(stack[-1], token)):
                stack.append(token)
                pos = end
                if pos < len(word):
                    token = best[pos]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:  # nothing fits: the place is dead, the token before is taken back
                alive[pos] = 0
                token = stack.pop()
                pos -= size[token]
        return stack

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in a row, and their number in each word."""
        long_ = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long_:
            return self._encode_short(words)
        parts = {i: np.array(self.encode_long(words[i]), np.int32) for i in long_}
        short = np.array([i for i in range(len(words)) if i not in parts], np.int64)
        ids, n = self._encode_short([words[i] for i in short])
        count = np.zeros(len(words), np.int64)
        count[short] = n
        count[long_] = [len(parts[i]) for i in long_]
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        out[np.repeat(begin[short] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        for i, p in parts.items():
            out[begin[i] : begin[i] + len(p)] = p
        return out, count

    def _encode_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(size) - size
        best = self.longest(text, begin, size)
        # places, one more a word for its end
        alive = np.ones(len(text) + len(words), bool)
        base = begin + np.arange(len(words))
        stack = np.zeros(len(text), np.int64)
        depth, pos = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        token = np.full(len(words), -1, np.int64)
        w = np.flatnonzero(size > 0)
        token[w] = best[begin[w]]
        while len(w):
            t, p = token[w], pos[w]
            end = p + self.size[t]
            ok = alive[base[w] + end]
            again = ok & (depth[w] > 0)
            if again.any():
                v = w[again]
                ok[again] = self._fits(stack[begin[v] + depth[v] - 1], t[again])
            v, tv, ev = w[ok], t[ok], end[ok]
            stack[begin[v] + depth[v]] = tv
            depth[v] += 1
            pos[v] = ev
            go = ev < size[v]
            token[v[go]] = best[begin[v[go]] + ev[go]]
            v, s = w[~ok], self.shorter[t[~ok]]
            token[v[s >= 0]] = s[s >= 0]
            v = v[s < 0]
            if len(v):  # nothing fits: the place is dead, the token before is taken back
                alive[base[v] + pos[v]] = False
                depth[v] -= 1
                last = stack[begin[v] + depth[v]]
                pos[v] -= self.size[last]
                token[v] = last
            w = w[pos[w] < size[w]]
        keep = np.arange(len(text)) - np.repeat(begin, size) < np.repeat(depth, size)
        return stack[keep].astype(np.int32), depth


class Encoder:
    """Texts to token ids, with the words seen so far."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.count, self.begin = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        if len(self.known) > KEPT_WORDS:
            self.forget()
        known = self.known
        words, number = split_words(texts)
        fresh = [x for x in dict.fromkeys(words) if x not in known]
        if fresh:
            ids, count = self.vocabulary.encode_words([x.encode("utf-8", "surrogatepass") for x in fresh])
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self.ids, self.count = np.append(self.ids, ids), np.append(self.count, count)
            self.begin = np.cumsum(self.count) - self.count
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        n = self.count[at]
        total = np.append(0, np.cumsum(n))
        # positions of all tokens: each word's run, one after the other
        where = np.arange(total[-1]) + np.repeat(self.begin[at] - total[:-1], n)
        offsets = total[np.append(0, np.cumsum(number))]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(self.ids[where]))


@functools.cache
def _vocabulary(folder: str, name: str) -> Vocabulary:
    return Vocabulary(folder, name)


@functools.cache
def _encoder(folder: str, name: str) -> Encoder:
    return Encoder(_vocabulary(folder, name))


def slices(b: pa.RecordBatch, column: str, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text, so that long texts do not meet in memory."""
    total = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + size, "right")))
        yield b.slice(at, end - at)
        at = end


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, ids) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(folder, name)
        for whole in batches:
            for b in slices(whole, text):
                yield pa.RecordBatch.from_arrays([b.column(key), enc.encode(b.column(text).to_pylist())], [key, "ids"])

    d = spread(docs.select(key, text), key)
    return d.mapInArrow(run, f"{key} {dict(d.dtypes)[key]}, ids array<int>")


def decoded(ids: DataFrame, key: str = "doc_id", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, text) from (key, ids), by gathering bytes through the offset table; broken UTF-8 becomes U+FFFD, null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(folder, name)
        for b in batches:
            out = []
            for x in b.column("ids"):
                if not x.is_valid:
                    out.append(None)
                    continue
                t = x.values.to_numpy(zero_copy_only=False)
                n = v.size[t] if len(t) else np.empty(0, np.int64)
                at = np.arange(n.sum()) + np.repeat(v.offset[t] - (np.cumsum(n) - n), n) if len(t) else np.empty(0, np.int64)
                out.append(v.flat[at].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.string())], [key, "text"])

    d = ids.select(key, "ids")
    return d.mapInArrow(run, f"{key} {dict(d.dtypes)[key]}, text string")
