import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexispark.llm import induced, repeats


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("hot", [4096, 2])
def test_matches_brute_force(odd, documents, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    for df in (odd, documents):
        got = sorted(repr(tuple(r)) for r in repeats.summary(df, repeats.find_repeats(df, 200)).collect())
        assert got == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], 200)


def test_other_lengths_and_small_blocks(odd, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 1000)
    got = sorted(repr(tuple(r)) for r in repeats.summary(odd, repeats.find_repeats(odd, 70)).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()], 70)


def test_empty_table(empty):
    assert repeats.summary(empty, repeats.find_repeats(empty)).count() == 0


def test_without_repeats_keeps_rows_columns_and_whole_characters(odd):
    out = repeats.without_repeats(odd, repeats.find_repeats(odd, 200))
    assert out.columns == odd.columns and out.count() == odd.count()
    for r in out.collect():
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    data = np.frombuffer("aé日b".encode(), np.uint8)
    assert repeats.whole_characters(data, np.array([[2, 5]])).tolist() == []
    assert repeats.whole_characters(data, np.array([[1, 6]])).tolist() == [[1, 6]]


def suffixes(t, depth):
    order = sorted(range(len(t)), key=lambda i: t[i:])

    def common(a, b):
        k = 0
        while k < depth and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        return k

    return order, [0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)]


@pytest.mark.parametrize("base", [None, 0, 4])
def test_induced_sorting_with_recursion_and_spilled_queues(monkeypatch, base):
    r = random.Random(5)
    for _ in range(60):
        monkeypatch.setattr(induced, "STEP", r.choice([1, 3, 16, 1 << 15]))
        monkeypatch.setattr(induced, "HELD", r.choice([10, 200, 1 << 20]))
        t = [r.randint(1, r.choice([1, 2, 3, 50])) for _ in range(r.choice([0, 1, 2, 5, 30, 120]))] * r.randint(1, 3) + [0]
        for kind in (np.uint8, np.int64):
            found = list(induced.sorted_suffixes(np.array(t, kind), 1000, base=base))
            at = np.concatenate([a for a, _ in found])[::-1].tolist()
            lcp = np.concatenate([v for _, v in found])
            assert (at, [0] + lcp[1:][::-1].tolist()) == suffixes(t, 1000)


def test_depth_caps_order_and_values():
    t = [1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 2, 0]
    found = list(induced.sorted_suffixes(np.array(t, np.uint8), 4))
    at = np.concatenate([a for a, _ in found])[::-1].tolist()
    assert [t[i : i + 4] for i in at] == sorted(t[i : i + 4] for i in range(len(t)))
    assert np.concatenate([v for _, v in found]).max() == 4
