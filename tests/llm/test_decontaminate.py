import random
import re

import numpy as np
import pyarrow as pa

from lexispark.llm import decontaminate as d


def norm(text):
    return re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", text.lower() if text.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), text)).strip()


def test_all_planted_passages_are_found(spark, sf_dir, documents):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in d.contaminated(documents, benchmark).collect()}
    texts = [(r["doc_id"], f" {norm(r['text'])} ") for r in documents.collect()]
    want = {(i, b["item_id"]) for i, t in texts for b in benchmark.collect() if f" {norm(b['text'])} " in t}
    assert want and want <= found
    assert len(found - want) <= 0.05 * len(want) + 1  # some hold an edited copy
    clean = {r["doc_id"] for r in d.clean(documents, benchmark).select("doc_id").collect()}
    assert clean == {i for i, _ in texts} - {i for i, _ in found}


def test_search_equals_scoring_every_passage(monkeypatch):
    """Batched block-max evaluation finds the passages and scores that scoring all items finds."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(r.choice(words) for _ in range(r.randrange(1, 15))) for _ in range(30)]
    docs = [" ".join(r.choice(words) for _ in range(r.randrange(0, 90))) for _ in range(20)] + items[:5] + ["", " "]
    h, o = d.words(pa.array(items))
    own = [(i, h[o[i] : o[i + 1]]) for i in range(len(items))]
    df = {}
    for _, x in own:
        for t in set(x.tolist()):
            df[t] = df.get(t, 0) + 1
    index = d.build(own, df, len(items), len(h) / len(items))
    impact = np.zeros((len(index.terms), len(items)))
    for t in range(len(index.terms)):
        own_postings = slice(index.first[t], index.first[t + 1])
        impact[t, index.item[own_postings]] = index.impact[own_postings]
    assert np.allclose(impact.sum(axis=0), 1, atol=1e-5) and np.allclose(impact.max(axis=1), index.most)
    for threshold, windows in ((0.3, 4096), (0.6, 4096), (0.3, 3)):
        monkeypatch.setattr(d, "WINDOWS", windows)
        monkeypatch.setattr(d, "THRESHOLD", threshold)
        hd, od = d.words(pa.array(docs))
        got = {(row, start, item): score for row, start, _, item, score in d.search(index, hd, od)}
        want = {}
        step = index.longest
        for row in range(len(docs)):
            x = hd[od[row] : od[row + 1]]
            for start in range(0, max(1, len(x)), step):
                terms = {t for t in x[start : start + 2 * step].tolist()}
                at = [i for i, t in enumerate(index.terms.tolist()) if t in terms]
                for item, score in enumerate(impact[at].sum(axis=0).tolist()):
                    if score >= threshold - 1e-5 and at:
                        want[row, start, item] = score
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_rounds_and_shards_give_the_same_rows(spark, sf_dir, documents, monkeypatch):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = lambda: sorted((r["doc_id"], r["item_id"]) for r in d.contaminated(documents, benchmark).collect())
    whole = rows()
    monkeypatch.setattr(d, "SHARD", 7)
    monkeypatch.setattr(d, "ROUND", 13)
    assert rows() == whole


def test_odd_rows_and_empty_tables(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "one"), (4, "one"), (5, "the1 of2"), (6, "-- !!")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in d.contaminated(odd, benchmark).collect()}
    assert {(4, 3), (4, 4)} <= found
    assert d.clean(odd, benchmark).columns == odd.columns
    assert d.contaminated(empty, benchmark).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(odd, nothing).count() == 0 and d.clean(odd, nothing).count() == odd.count()


def test_edited_and_truncated_copies_are_found(spark):
    """A passage with 0.6 of an item's three-word sequences holds it, whichever part of the item is missing."""
    r = random.Random(6)
    fresh = lambda n: [f"x{r.randrange(10**9)}" for _ in range(n)]
    common = [f"c{i}" for i in range(40)]
    items = [[r.choice(common) if r.random() < 0.6 else w for w in fresh(r.randrange(12, 60))] for _ in range(40)]
    docs, want = [], set()
    for item, w in enumerate(items):
        triples = lambda x: set(zip(x, x[1:], x[2:], strict=False))
        copies = [w[: -len(w) // 5], w[: round(0.65 * len(w))], w[-round(0.65 * len(w)) :], w[: len(w) // 3]]
        copies += [w[:p] + ["edited"] + w[p + 1 :] for p in range(len(w))]
        copies += [["edited" if p in some else x for p, x in enumerate(w)] for some in (r.sample(range(len(w)), 3) for _ in range(20))]
        for x in copies:
            if len(triples(w) & triples(x)) >= 0.6 * len(triples(w)):
                want.add((len(docs), item))
            docs.append((len(docs), " ".join(fresh(30) + x + fresh(30))))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in d.contaminated(rows, benchmark).collect()}
    assert len(want) > 1000 and found == want
    assert {x["doc_id"] for x in d.clean(rows, benchmark).collect()} == {i for i, _ in docs} - {i for i, _ in found}
