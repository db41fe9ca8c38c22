import public_tokenizers
import pytest
from test_near_duplicates import brute as near_brute
from test_repeats import brute as repeats_brute
from tokenizers import Tokenizer

from lexispark.llm import decontaminate, language

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, sf_dir, documents):
    stages, docs, tokens = dict(corpus_pipeline.STAGES), documents, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert list(stages) == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    for name, stage in stages.items():
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), None if name == "packing" else documents.schema)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == documents.columns
        ids = {r["doc_id"] for r in after}
        if name == "language_id":
            model = language.fit(documents.where(language.remainder("doc_id", 4) != 2))
            names, scores = model.predict([r["text"] for r in before])
            assert ids == {r["doc_id"] for r, n, s in zip(before, names, scores, strict=True) if n != "und" and s >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
            assert len(ids) > 0.97 * len(before)
        elif name == "near_dedup":
            kept = near_brute([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert ids == {eval(x)[0] for x in kept if eval(x)[3]}
        elif name == "suffix_dedup":
            removed = sum(eval(x)[2] for x in repeats_brute([(r["doc_id"], r["text"]) for r in before], 200))
            lost = sum(len(r["text"].encode()) for r in before) - sum(len(r["text"].encode()) for r in after)
            assert ids == {r["doc_id"] for r in before} and removed - 8 * len(before) <= lost <= removed
        elif name == "decontamination":
            bad = decontaminate.contaminated(spark.createDataFrame(before, documents.schema), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
            assert ids == {r["doc_id"] for r in before} - {r["doc_id"] for r in bad.collect()}
        else:
            assert sum(p["length"] for p in after) == sum(len(tokens.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before)


def test_odd_and_empty_tables(spark, sf_dir, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_short_texts_of_a_right_language_stay(spark, documents):
    """Two words of a document whose language the model tells rightly are no reject."""
    model = language.fit(documents.where(language.remainder("doc_id", 4) != 2))
    words = [(r["lang"], (r["text"] or "").split()[:40]) for r in documents.collect()]
    texts = [(lang, " ".join(w[i : i + 2])) for lang, w in words for i in range(0, len(w), 2)]
    names, _ = model.predict([t for _, t in texts])
    right = sorted(t for (lang, t), name in zip(texts, names, strict=True) if lang == name)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(right)], "doc_id long, text string")
    assert len(right) > 1000 and language.keep(rows, model, corpus_pipeline.LEAST_LANGUAGE_SCORE).count() == len(right)
