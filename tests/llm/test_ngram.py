import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexispark.llm import language, ngram

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    tokens = [(i, WORDS.findall((t or "").translate(LOWER)) + ["</s>"]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in tokens]
    train = [t for (_, t), h in zip(tokens, held, strict=True) if not h]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    k = Counter(w for _, w in pairs)
    dp, dw = ngram.discounts([sum(x == j for x in pairs.values()) for j in (1, 2, 3, 4)]), ngram.discounts([sum(x == j for x in k.values()) for j in (1, 2, 3, 4)])
    after = defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), m in pairs.items():
        after[a][0] += m
        after[a][min(m, 3)] += 1
    spare = sum(dw[min(x, 3)] for x in k.values()) / len(pairs) if pairs else 1.0

    def p(a, w):
        low = max(k[w] - dw[min(k[w], 3)], 0) / max(len(pairs), 1) + spare / (v + 1)
        if a not in after:
            return low
        s, m = after[a], pairs[a, w]
        return max(m - dp[min(m, 3)], 0) / s[0] + sum(dp[j] * s[j] for j in (1, 2, 3)) / s[0] * low

    out = []
    for (i, t), h in zip(tokens, held, strict=True):
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out.append((i, h, len(t), sum(c[w] > 0 for w in t), n, base, sum(math.log10(p(a, w)) for a, w in zip(["<s>", *t], t, strict=False))))
    return out, p, c


def run(df, buckets=None):
    held = language.remainder("doc_id", 10) == 0
    return ngram.score(df, ngram.learn(df.where(~held), buckets=buckets), held)


@pytest.mark.parametrize("flush", [4_000_000, 50])
def test_matches_brute_force(odd, documents, monkeypatch, flush):
    monkeypatch.setattr(ngram, "FLUSH", flush)
    monkeypatch.setattr(ngram, "HOT_SAMPLE", 1)
    for df in (odd, documents):
        want, p, c = brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
        got = [tuple(r) for r in run(df, buckets=5).collect()]
        key = lambda x: (repr(x[:5]), round(x[5], 6), round(x[6], 6))
        for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)
        for context in ("the", "<s>", "never seen"):
            assert sum(p(context, w) for w in c) + p(context, "\0 unknown") == pytest.approx(1)


def test_better_than_frequencies_on_held_out_rows(documents):
    rows = run(documents).where("held_out").agg(F.sum("score").alias("a"), F.sum("base_score").alias("b")).first()
    assert rows["a"] > rows["b"]


def test_empty_table_and_nothing_to_learn(spark, empty):
    assert run(empty).count() == 0
    only = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert {(r["train_tokens"], r["n_known"], r["score"]) for r in run(only).collect()} == {(0, 0, 0.0)}
