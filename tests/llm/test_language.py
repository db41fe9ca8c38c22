import numpy as np
from pyspark.sql import functions as F

from lexispark.llm import language as L


def test_held_out_accuracy(documents):
    held = L.remainder("doc_id", 4) == 2
    found = L.identify(documents.where(held), L.fit(documents.where(~held)))
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_odd_rows(odd):
    model = L.fit(odd)
    rows = L.identify(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    kept = L.keep(odd, model, 0.25)
    assert kept.columns == odd.columns and kept.where("text IS NULL").count() == 0


def test_empty_table_and_nothing_to_learn(odd, empty):
    assert L.identify(empty, L.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in L.identify(odd, L.fit(empty)).collect()} == {"und"}


def test_presence_covers_whole_texts_in_blocks(monkeypatch):
    text = "abc déf " * 50 + "zq"
    whole, parts = np.zeros(L.GRAMS, np.uint8), np.zeros(L.GRAMS, np.uint8)
    assert L.presence(text, whole)
    monkeypatch.setattr(L, "_STEP", 7)
    assert L.presence(text, parts)
    assert (whole == parts).all()


def test_one_matrix_product_equals_the_kernel():
    r = np.random.default_rng(1)
    rows = (r.random((30, L.GRAMS)) < 0.01).astype(np.uint8)
    labels = ["ab"[i % 2] for i in range(30)]
    model = L.train(rows, labels, landmarks=30, ridge=1e-6)
    unit = rows / np.sqrt(rows.sum(axis=1))[:, None]
    kernel = unit @ unit.T
    dual = np.linalg.solve(kernel @ kernel + 1e-6 * kernel, kernel @ np.where(np.array(labels)[:, None] == np.array(["a", "b"]), 1.0, -1.0))
    assert np.allclose(unit @ model.weights, kernel @ dual, atol=1e-2)
