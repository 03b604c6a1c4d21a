import random
import time

import numpy as np
import pytest

from tideline.llm import tokens as T

tokenizers = pytest.importorskip("tokenizers")
VOCAB = f"{T.VOCABULARIES}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def both():
    t = tokenizers.Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    return T._encoder(T.VOCABULARIES, "byte_bpe_50k"), lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


def test_equals_the_library(both):
    enc, want = both
    rng = random.Random(1)
    bits = ["a" * 50, "the ", "ааааа", "--" * 30, "=====", "  \n\n \t", "1234567890", "zzqz", "中文字符", "é́", " 　 x", "½Ⅳ", "don't've", "'s", "''re", " 'll", "<|endoftext|>", "🙂🙃", "\x00\x1c", "_a_1"]
    xs = ["".join(rng.choice(bits)[: rng.randrange(1, 40)] for _ in range(rng.randrange(12))) for _ in range(3000)]
    xs += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 0x3000), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert enc.encode(xs).to_pylist() == want(xs)


def test_long_text_and_forgetting(both, monkeypatch):
    enc, want = both
    monkeypatch.setattr(T, "KEPT_WORDS", 2)
    xs = ["a" * 20_000 + "中" * 5_000 + " the end" * 2_000]
    assert enc.encode(xs).to_pylist() == want(xs)
    assert enc.encode(["x y z"]).to_pylist() == want(["x y z"])


def test_long_words(both):
    """Words of more than LONG bytes go place by place; the work stays linear."""
    enc, want = both
    rng = random.Random(3)
    xs = ["".join(rng.choice(al) for _ in range(n)) for n in (63, 64, 65, 200, 3000) for al in ("abcdefghijklmnopqrstuvwxyz", "ab", "the andig", "中文字符市场", "e\u0301\u0300", "-=_")]
    assert enc.encode(xs).to_pylist() == want(xs)
    t = time.time()
    enc.encode(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))])
    enc.encode(["".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(300_000))])
    assert time.time() - t < 10  # two seconds on an idle machine


def test_pairs(both):
    v = both[0].vocabulary
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 3000, 4000), rng.integers(0, 3000, 4000)
    want = v.compatible(a, b)
    assert v._fits(a, b).tolist() == v._fits(a, b).tolist() == want.tolist() == [v._compatible_one(int(x), int(y)) for x, y in zip(a, b, strict=True)]


def test_defined_cases_and_round_trip(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "hello <|endoftext|> 世界\n", 0), (4, " ", 0), (4, "again", 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    ids = T.encoded(d)
    assert ids.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = sorted((r.doc_id, r.ids) for r in ids.collect())
    assert got[0] == (1, []) and got[1] == (2, []) and len(got) == 5
    assert sorted(r.text for r in T.decoded(ids).collect()) == sorted((t or "") for _, t, _ in rows)
    assert T.encoded(d.limit(0)).count() == 0
