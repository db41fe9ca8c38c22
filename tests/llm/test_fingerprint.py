import hashlib
import random

from lexispark.llm import fingerprint as f


def brute(rows):
    """The contract, row by row: rows in descending doc_id, nulls last, ties by text."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    out = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed = f.fingerprint(text.encode()), f.fingerprint(edited.encode())
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, f.likeness(own, changed), f.likeness(own, f.fingerprint(after.encode()))))
    return sorted(map(repr, out))


def test_matches_brute_force(odd, documents):
    for df in (odd, documents):
        got = [tuple(r) for r in f.fingerprint_neighbours(df).collect()]
        assert sorted(map(repr, got)) == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_empty_table(empty):
    assert f.fingerprint_neighbours(empty).count() == 0


def test_one_row_follows_itself(spark):
    row = f.fingerprint_neighbours(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert f.common_subsequence(a, b) == table[-1][-1]


def test_edits_stay_near_and_others_far(documents):
    texts = [r["text"] for r in documents.select("text").collect() if len(r["text"]) > 300]
    near, far = [], []
    for a, b in zip(texts, texts[1:], strict=False):
        mark = f.fingerprint(a.encode())
        near.append(f.likeness(mark, f.fingerprint((a[: len(a) // 3] + "XYZ" + a[len(a) // 3 :]).encode())))
        far.append(f.likeness(mark, f.fingerprint(b.encode())) if a != b else 0)
    assert sum(x > 0.8 for x in near) > 0.95 * len(near) and sum(x < 0.2 for x in far) > 0.97 * len(far)


def test_signatures_are_bounded():
    for text in (b"", b"a", b"a" * 100_000, bytes(range(256)) * 50):
        assert all(len(s) <= f.MOST_CHUNKS for s in f.fingerprint(text).split(":")[1:])
