"""Language identification with string kernels.

Kernel: the blended spectrum presence kernel, i.e. the number of character n-grams (n = 1, 2, 3, hashed to GRAMS
buckets) that two texts share, divided by the root of the product of their numbers of n-grams. Training: Nystroem
features from landmark texts and one-versus-rest kernel ridge regression on targets of -1 and 1. Scoring: presence
rows of a batch times the landmarks' presence times the dual weights; the last two matrices don't depend on the batch
and are multiplied once, so that scoring is one matrix product per batch.

The learner sees a bounded sample of labelled rows: at most SAMPLE rows, drawn evenly over the languages by a hash of
doc_id. Everything else covers all rows and whole texts. lang, source and doc_id are no inputs of a prediction.

Defined results: a null text or one without a letter is "und" with score 0; so is every text if nothing can be learned.
The score is the winning regression value moved from [-1, 1] to [0, 1]; ties go to the first language in order. Every
input row gives one row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import arrow

GRAMS, ORDERS = 1 << 15, (1, 2, 3)
#: Rows learned from at most, and landmarks among them.
SAMPLE, LANDMARKS, RIDGE = 2048, 192, 0.1
_STEP = 1 << 18
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Of each code point its lower-case letter, or a space where it is none."""
    if not _LETTERS:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            if not 0xD800 <= i < 0xE000 and (c := chr(i)).isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _LETTERS.append(table)
    return _LETTERS[0]


def presence(text: str | None, row: np.ndarray) -> bool:
    """Mark in row the n-grams of a whole text; whether it has a letter."""
    found, overlap = False, max(ORDERS) - 1
    for at in range(0, len(text or ""), _STEP):
        codes = _letters()[np.frombuffer(text[max(0, at - overlap) : at + _STEP].encode("utf-32-le", "replace"), np.uint32)].astype(np.uint64)
        found = found or bool((codes != 32).any())
        gram = np.zeros(len(codes), np.uint64)
        for n in ORDERS:
            if len(codes) < n:
                break
            gram = gram[: len(codes) - n + 1] * np.uint64(0x110000) + codes[n - 1 :]
            row[((gram + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAMS.bit_length() + 1)] = 1
    return found


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # GRAMS x languages

    def predict(self, texts: list[str | None], batch: int = 128) -> tuple[list[str], list[float]]:
        """Language and score of each whole text."""
        names, scores = [], []
        for at in range(0, len(texts), batch):
            part = texts[at : at + batch]
            rows = np.zeros((len(part), GRAMS), np.float32)
            known = np.array([presence(t, r) for t, r in zip(part, rows, strict=True)])
            if not self.languages:
                known[:] = False
            value = rows @ self.weights / np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None] if self.languages else np.zeros((len(part), 1))
            best = value.argmax(axis=1)
            top = np.clip((value[np.arange(len(part)), best] + 1) / 2, 0, 1)
            names += [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            scores += [float(s) if k else 0.0 for s, k in zip(top, known, strict=True)]
        return names, scores


def train(rows: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """rows: presence of n-grams, texts x GRAMS; the first rows become landmarks, in turn by language."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((GRAMS, 0), np.float32))
    size = np.sqrt(np.maximum(rows.sum(axis=1, dtype=np.int64), 1)).astype(np.float32)
    turn: dict[str, int] = {}
    place = [(turn.setdefault(x, 0), i) for i, x in enumerate(labels) if turn.update({x: turn.get(x, -1) + 1}) is None]
    chosen = [i for _, i in sorted(place)[:landmarks]]
    marks = rows[chosen] / size[chosen][:, None]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(float))
    use = value > 1e-6 * value.max()
    back = vector[:, use] / np.sqrt(value[use])
    kernel = np.concatenate([rows[i : i + 128].astype(np.float32) @ marks.T / size[i : i + 128][:, None] for i in range(0, len(rows), 128)])
    features = kernel.astype(float) @ back
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    dual = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ target)
    return Model(languages, marks.T @ (back @ dual).astype(np.float32))


def remainder(column: str, modulus: int):
    """crc32 of a column as text, modulo; -1 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from doc_id, text and lang; rows without text or lang are left out."""
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return train(np.zeros((0, GRAMS)), [])
    each = max(1, sample // len(counts))
    rates = labelled.sparkSession.createDataFrame([(k, min(1.0, 2 * each / n)) for k, n in counts.items()], "lang string, rate double")
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.withColumn("place", order).join(F.broadcast(rates), "lang").where("place < rate").withColumn("place", F.col("place") / F.col("rate"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                row = np.zeros(GRAMS, np.uint8)
                out.append(np.packbits(row).tobytes() if presence(text.as_py(), row) else None)
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("lang"), pa.array(out, pa.binary())], names=["place", "lang", "bits"])

    found = drawn.select("place", "lang", "text").transform(arrow(bits, "place double, lang string, bits binary")).where("bits IS NOT NULL").orderBy("place", "lang", "bits").limit(2 * sample).collect()
    kept, seen = [], {}
    for r in found:
        if seen.setdefault(r["lang"], 0) < each:
            seen[r["lang"]] += 1
            kept.append(r)
    return train(np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in kept]).reshape(len(kept), GRAMS), [r["lang"] for r in kept])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score in place of columns of these names."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rest = docs.select([c for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    at = next(i for i, c in enumerate(rest.columns) if c.lower() == "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return rest.transform(arrow(work, T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])))


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Rows of docs, unchanged, whose language is known with a score of at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.transform(arrow(work, T.StructType(docs.schema.fields)))
