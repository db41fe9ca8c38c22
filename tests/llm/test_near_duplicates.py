import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lexispark.llm import near_duplicates as n

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k):
    words = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k, percent):
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted(repr((i, len(s), find(i) if i is not None else None, i is None or find(i) == i)) for i, s in sets)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_matches_brute_force(odd, documents, k, percent):
    for df in (odd, documents):
        got = sorted(repr(tuple(r)) for r in n.near_duplicates(df, k, percent).select("doc_id", "n_shingles", "component_id", "kept").collect())
        assert got == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], k, percent)


def test_empty_table(empty):
    assert n.near_duplicates(empty).count() == 0


def test_ladder_of_edits_over_several_tiles(spark, monkeypatch):
    """A family in which neighbours are alike but ends are not, in tiles of four."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[r.randrange(120)] = f"e{i}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(n.verified_links, "__defaults__", (4,))
    got = sorted(repr(tuple(x)) for x in n.near_duplicates(df, 3, 90).collect())
    assert got == brute(rows, 3, 90)


def test_no_index_key_is_missed():
    assert n.chunks_for(0.85) < n.chunks_for(0.8) and n.chunks_for(1.0) == 1


def test_documents_with_two_texts(spark):
    rows = [(1, "a b c d"), (1, "e f g h"), (2, "a b c d"), (3, "e f g h"), (4, "x y z")]
    got = {(r["doc_id"], r["component_id"]) for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_template_pages(spark):
    """Pages that share half of their text chain into one candidate family; few of its pairs are compared on their sets."""
    r = random.Random(8)
    template = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(template + [f"w{r.randrange(10**6)}" for _ in range(r.randrange(40, 90))])) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(repr(tuple(x)) for x in n.near_duplicates(df, 3, 85).collect())
    assert got == brute(rows, 3, 85)
    chunks = n.chunks_for(0.85)
    factors = n._factors(chunks * n.ROWS)
    signed = np.stack([n.signature(s, factors) for s in n.shingle_sets(pa.array([t for _, t in rows]), 3)])
    equal = (signed[:, None] == signed[None]).sum(axis=2)
    close = int((np.triu(equal, 1) >= n.least_equal(chunks * n.ROWS, 0.85)).sum())
    assert 20 <= close < 0.1 * len(rows) ** 2 / 2  # 587 of 9,730 as measured


def test_least_equal_values():
    assert n.least_equal(45, 1.0) == 45 and n.least_equal(45, 0.85) < 0.85 * 45
    r = np.random.default_rng(2)
    assert (r.random((20_000, 45)) < 0.85).sum(axis=1).min() >= n.least_equal(45, 0.85)
