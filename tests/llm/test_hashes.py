"""Words and stretches that sums of powers modulo 2 ** 64 can't tell apart."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_near_duplicates import brute
from test_repeats import brute as brute_repeats

from lexispark.llm import near_duplicates, ngram, packing, repeats, textops

SWAP = str.maketrans("ab", "ba")


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(SWAP)
    return s[:n]


@pytest.fixture(scope="module")
def texts():
    out = []
    for n in (256, 1024, 2048, 4096):
        a = thue_morse(n)
        b = a.translate(SWAP)
        out += [f"one {a} two three", f"one {b} two three", f"{a} {b} {a}", f"{b} {a} {b} {a}", a + b, b + a]
    return out


def test_word_hashes_differ(texts):
    words = sorted({w for t in texts for w in t.split(" ")})
    h, _ = textops.word_hashes(*textops.column_bytes(pa.array(words)))
    assert len(set(h.tolist())) == len(words)


def test_stretches_of_all_sizes():
    r = np.random.default_rng(5)
    data = r.integers(0, 2, 5000).astype(np.uint8)
    start, size = r.integers(0, 2500, 3000), r.integers(1, 2400, 3000)
    h = textops.span_hashes(data, start, size)
    named = {}
    for a, n, x in zip(start.tolist(), size.tolist(), h.tolist(), strict=True):
        assert named.setdefault(x, data[a : a + n].tobytes()) == data[a : a + n].tobytes()
    again = textops.span_hashes(np.concatenate([np.ones(3, np.uint8), data]), start + 3, size)
    assert (again == h).all()


def test_operators(spark, texts):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(repr(tuple(r)) for r in near_duplicates.near_duplicates(df, 3, 85).collect())
    assert got == brute(rows, 3, 85)
    model = ngram.learn(df)
    assert model.vocabulary == len({w for t in texts for w in t.split(" ")}) + 1
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    want = [np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.encode(pa.array(texts)) == want
    found = sorted(repr(tuple(r)) for r in repeats.summary(df, repeats.find_repeats(df, 200)).collect())
    assert found == brute_repeats(rows, 200)
