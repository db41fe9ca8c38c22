import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexispark.llm import packing, token_counts

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def strange(n):
    r = random.Random(3)
    letters = " ▁  abcdehtinorsl\t\n.,<s>/€é日本語ß%$#\x00\U0001f600 ́İΣ'1290\x1c\x85 ̱H|"
    made = ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 5, 30, 300]))) for _ in range(n)]
    return made + ["a" * 900, "the" * 700, " " * 900, "x ", " a ", "▁", "a <|endoftext|> b<|startoftext|>c", "<|ENDOFTEXT|>", "it 's don't 's \"'%\"", "foo, bar; Baz!? ÀB x."]


@pytest.mark.parametrize("long", [256, 3])
def test_counts_equal_the_library(documents, monkeypatch, long):
    monkeypatch.setattr(token_counts, "LONG", long)
    texts = strange(1500) + [r["text"] for r in documents.select("text").limit(60).collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_counts.PieceCounter(PIECES).count(texts) == [len(x) for x in library.encode(texts, num_threads=1)]


def test_count_query(odd, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(repr((r["doc_id"], len((r["text"] or "").encode()), n, n > 40)) for r in odd.collect() for n in [len(library.encode(r["text"] or ""))])
    assert sorted(repr(tuple(r)) for r in token_counts.count_tokens(odd, PIECES, limit=40).collect()) == want
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def test_ids_equal_the_library(documents, monkeypatch):
    library = Tokenizer.from_file(WORDS)
    texts = strange(1500) + [r["text"] for r in documents.select("text").limit(60).collect()]
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    words = packing.WordIds(WORDS)
    assert words.encode(pa.array([*texts, None])) == [*want, b""]
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    assert [x for t in texts for x in words.encode(pa.array([t]))] == want


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_packing(odd, documents, block):
    library = Tokenizer.from_file(WORDS)
    for df, capacity in ((odd, 64), (documents, 4096)):
        rows = df.select("doc_id", "text").collect()
        pieces = packing.pack(df, WORDS, 2, capacity=capacity, block=block).collect()
        want = defaultdict(int)
        ids = {}
        for r in rows:
            own = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            ids.setdefault(r["doc_id"], []).append(own)
            want[r["doc_id"]] += len(own)
        got, sequences = defaultdict(int), defaultdict(list)
        for p in pieces:
            got[p["doc_id"]] += p["length"]
            sequences[p["sequence_id"]].append(p)
            parts = {zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for x in ids[p["doc_id"]] if len(x) == p["doc_tokens"]}
            assert p["ids_crc32"] in parts and p["length"] > 0
        assert got == want
        for parts in sequences.values():
            at = 0
            for p in sorted(parts, key=lambda p: p["offset"]):
                assert p["offset"] == at
                at += p["length"]
            assert at == capacity or at < capacity and at & (at - 1) == 0
        for doc, texts in ids.items():  # pieces tile their document
            if len(texts) == 1:
                spans = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == doc)
                assert [s for s, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]


def test_packing_an_empty_table(empty):
    assert packing.pack(empty, WORDS, 2).count() == 0
    assert packing.pack(empty, WORDS, 2, whole=True).count() == 0


def test_whole_remainders(documents):
    """Without cutting, a document has its full windows and one more piece, and no window exceeds the capacity."""
    rows = packing.pack(documents, WORDS, 2, capacity=512, block=1 << 14, whole=True).collect()
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
    assert all(r["length"] == (512 if r["start"] + 512 <= r["doc_tokens"] else r["doc_tokens"] % 512) for r in rows)
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 512 and sum(filled.values()) > 0.7 * 512 * len(filled)


def test_differencing_and_whole_windows():
    r = random.Random(2)
    for _ in range(100):
        sizes = [r.randint(1, 50) for _ in range(r.randrange(0, 60))]
        k = r.randint(1, 9)
        lists = packing.differencing(sizes, k)
        assert len(lists) == k and sorted(i for w in lists for i in w) == list(range(len(sizes)))
        if len(sizes) > 4 * k:
            sums = [sum(sizes[i] for i in w) for w in lists]
            assert max(sums) - min(sums) <= 50
        if sizes:
            whole = packing.windows_whole(sizes, 60)
            assert max(sum(sizes[i] for i in w) for w in whole) <= 60 and sorted(i for w in whole for i in w) == list(range(len(sizes)))
    with pytest.raises(ValueError):
        packing.windows_whole([61], 60)
