import random
import struct

import pytest
from pyspark.sql import functions as F

from lexispark.functions import bits
from lexispark.operators import alphabet, gather, ranking, stringsets
from lexispark.sources import store, text
from lexispark.streaming.patterns import stream_occurrences


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_bits(spark):
    x = lambda v: F.lit(v).cast("long")
    assert [value(spark, bits.trailing_zeros(x(v))) for v in (0x8, 0xFFFFFF40, 0xBEEF0132032E00, 0, 1)] == [3, 6, 9, 64, 0]
    assert value(spark, bits.leading_zeros(x(0xEFC), 32)) == 20 and value(spark, bits.leading_zeros(x(0xEFC))) == 52
    assert value(spark, bits.leading_zeros(x(0), 32)) == 32
    assert value(spark, bits.floor_log2(x(0x321))) == 9 and value(spark, bits.ceil_log2(x(0x321))) == 10
    assert [value(spark, bits.ceil_log2(x(v))) for v in (1, 2, 3, 4)] == [0, 1, 2, 2]
    assert value(spark, bits.lcp_bitwise(x(0xFECF0123), x(0xFECDCCCE), 16, 2)) == 7
    assert value(spark, bits.lcp_bitwise(x(0x01234567), x(0x01234566), 10, 3)) == 9
    assert value(spark, bits.lcp_bitwise(x(0x1234), x(0x2234), 4, 4)) == 0
    assert value(spark, bits.lcp_bitwise(x(0x1200), x(0x1200), 4, 4)) == 4 and value(spark, bits.lcp_bitwise_no0(x(0x1200), x(0x1200), 4, 4)) == 2
    assert value(spark, bits.packed_symbol(x(0x1B), 1, 3, 2)) == 2


def test_ranking_over_many_partitions(spark):
    r = random.Random(1)
    values = [r.randrange(50) for _ in range(3000)] + [7] * 2000
    df = spark.createDataFrame([(i, v, v % 3) for i, v in enumerate(values)], "id long, v long, w long").repartition(7)
    rows = ranking.ranked(df, ["v", "id"], add="w").orderBy("idx").collect()
    want = sorted((v, i) for i, v in enumerate(values))
    assert [(x["v"], x["id"]) for x in rows] == want and [x["idx"] for x in rows] == list(range(len(values)))
    total = 0
    for x in rows:
        assert x["before"] == total
        total += x["w"]
    ordered = sorted(values)
    for x in ranking.ranked(df, ["v"]).collect():
        assert x["bucket"] == ordered.index(x["v"]) and x["single"] == (values.count(x["v"]) == 1)
    assert ranking.active(ranking.ranked(df.where("v < 60"), ["v"])).count() == sum(values.count(v) > 1 for v in values)


def test_fill_forward(spark):
    r = random.Random(2)
    marks = [r.choice([0, 0, 0, i + 1]) for i in range(500)]
    df = spark.createDataFrame(list(enumerate(marks)), "idx long, m long").repartition(5)
    held, want = 0, []
    for m in marks:
        held = m or held
        want.append(held)
    assert [x["filled"] for x in ranking.fill_forward(df, "idx", "m").orderBy("idx").collect()] == want


def test_gathers_and_shifts(spark):
    vector = spark.createDataFrame([(i, i * i) for i in range(10)], "idx long, value long")
    queries = spark.createDataFrame([(0, 3), (1, 3), (2, 99)], "qid long, idx long")
    assert {(x["qid"], x["value"]) for x in gather.bulk_gather(queries, vector).collect()} == {(0, 9), (1, 9), (2, None)}
    assert {(x["qid"], x["result"]) for x in gather.bulk_query(queries, vector, lambda d: d["value"] + d["qid"]).collect()} == {(0, 9), (1, 10), (2, None)}
    few = gather.replicated_gather(queries, vector)
    assert {(x["qid"], x["value"]) for x in few.collect()} == {(0, 9), (1, 9), (2, None)}
    inner = spark.createDataFrame([(s, i, 10 * s + i) for s in (1, 2) for i in range(3)], "str_id long, idx long, value long")
    asked = spark.createDataFrame([(0, 2, 1), (1, 1, 2), (2, 1, 3)], "qid long, str_id long, idx long")
    for found in (gather.bulk_gather(asked, inner, keys=("str_id",)), gather.replicated_gather(asked, inner, keys=("str_id",)), gather.bulk_query(asked, inner, lambda d: d["value"], keys=("str_id",)).withColumnRenamed("result", "x")):
        assert {(x["qid"], x["value"]) for x in found.collect()} == {(0, 21), (1, 12), (2, None)}
    assert [x["shifted"] for x in gather.shift(vector, 8).orderBy("idx").collect()] == [64, 81] + [0] * 8
    assert [(x["b1"], x["b2"]) for x in gather.multi_shift(vector, 2, 2).orderBy("idx").collect()][:2] == [(4, 16), (9, 25)]
    turned = gather.bulk_permute(vector.withColumn("to", 9 - F.col("idx")), "to")
    assert [x["value"] for x in turned.orderBy("idx").collect()] == [i * i for i in range(9, -1, -1)]
    assert all(x["place"] == x["idx"] for x in gather.bucketed(vector.repartition(4), "value", 3).collect())
    assert gather.partition_sizes(gather.redistribute(vector, 3)).agg(F.sum("n")).first()[0] == 10


def test_string_sets(spark):
    texts = spark.createDataFrame([(1, "$a$$bc$"), (2, ""), (3, "$$")], "text_id long, text string")
    rows = stringsets.parse(texts, "$")
    assert [tuple(x) for x in rows.orderBy("text_id", "str_no").collect()] == [(1, 0, "a"), (1, 1, "bc")]
    assert [tuple(x) for x in stringsets.flatten(rows, "$").collect()] == [(1, "a$bc$")]
    offsets = stringsets.offsets(spark.createDataFrame([(5, "abc"), (7, ""), (9, "de")], "str_id long, text string"))
    assert [tuple(x) for x in offsets.orderBy("str_id").collect()] == [(5, 0, 3), (9, 3, 5)]
    runs = [0, 0, 1, 1, 1, 1, 5, 3, 3, 3]
    found = stringsets.equal_runs(spark.createDataFrame(list(enumerate(runs)), "idx long, value long"))
    assert sorted(tuple(x) for x in found.select("begin", "end", "value").collect()) == [(0, 2, 0), (2, 6, 1), (6, 7, 5), (7, 10, 3)]


def test_alphabets(spark):
    df = spark.createDataFrame([(0, "mississippi"), (1, "")], "str_id long, text string")
    codes = alphabet.codes(df)
    assert {x["ch"]: x["code"] for x in codes.collect()} == {"i": 1, "m": 2, "p": 3, "s": 4}
    assert tuple(alphabet.stats(df).first()) == (4, 3, 21, "imps")
    coded = alphabet.encode(spark.createDataFrame([("s",), ("z",)], "ch string"), codes)
    assert {(x["ch"], x["code"]) for x in coded.collect()} == {("s", 4), ("z", None)}
    assert alphabet.same_alphabet(codes, codes) and not alphabet.same_alphabet(codes, codes.where("ch != 's'"))
    numbers = alphabet.integer_encode(spark.createDataFrame([(-5,), (3,)], "v long"), "v")
    assert {(x["v"], x["code"]) for x in numbers.collect()} == {(-5, 1), (3, 9)}
    assert value(spark, alphabet.integer_decode(F.lit(9), -5)) == 3


def test_sources(spark, tmp_path):
    (tmp_path / "lines").write_text("abc\n\nde\nlast")
    assert sorted(x["text"] for x in text.line_strings(spark, f"file://{tmp_path}/lines").collect()) == ["abc", "de", "last"]
    assert text.whole_texts(spark, f"file://{tmp_path}/lines").first()["text"] == "abc\n\nde\nlast"
    for data in ("abc\n\nde\nlast", "é\r\n\U0001f600\n", "\n", ""):
        (tmp_path / "whole").write_bytes(data.encode())
        pieces = text.text_pieces(spark, f"file://{tmp_path}/whole").orderBy("pos").collect()
        assert "".join(x["text"] for x in pieces) == data
        assert [x["pos"] for x in pieces] == [sum(len(y["text"]) for y in pieces[:i]) for i in range(len(pieces))]
    assert text.patterns(spark, f"file://{tmp_path}/lines").count() == 3
    assert [x["pattern"] for x in text.patterns_parsed(spark, "a\n\nb").orderBy("pattern_id").collect()] == ["a", "b"]
    assert text.patterns_from(spark, ["x", "", "y"]).count() == 2
    dna = text.random_dna(spark, 1000, 3)
    assert {x["ch"] for x in dna.collect()} == set("ACGT") and dna.exceptAll(text.random_dna(spark, 1000, 3)).isEmpty()
    for kind in ("uniform", "peaks", "bitonic"):
        assert text.sequence(spark, kind, 50).count() == 50


def test_stored_indexes(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    sa = spark.createDataFrame([(0, 1), (1, 0)], "rank long, pos long")
    store.write_index(path, sa=sa, lcp=sa.select("rank", F.lit(0).alias("lcp")))
    assert store.read_index(spark, path, "sa", "lcp")["sa"].count() == 2
    store.write_index(path, lcp=sa.limit(1))
    with pytest.raises(ValueError):
        store.read_index(spark, path, "sa", "lcp")
    with pytest.raises(ValueError):
        store.write_index(path, other=sa)


def test_native_arrays(spark, tmp_path, monkeypatch):
    values = spark.createDataFrame([(i, i * 3) for i in range(100)], "idx long, v long")
    signed = values.withColumn("v", F.col("v") - 150)
    store.write_native(signed, f"file://{tmp_path}/native")
    assert sorted(tuple(x) for x in store.read_native(spark, f"file://{tmp_path}/native").collect()) == [(i, i * 3 - 150) for i in range(100)]
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "native").glob("part-*")))
    assert data == struct.pack("=100q", *(i * 3 - 150 for i in range(100)))
    monkeypatch.setattr(store, "CHUNK", 24)
    assert sorted(tuple(x) for x in store.read_native(spark, f"file://{tmp_path}/native").collect()) == [(i, i * 3 - 150) for i in range(100)]
    store.write_native(values.limit(0), f"file://{tmp_path}/none")
    assert store.read_native(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "raw").write_bytes(struct.pack("=5I", *range(5)))
    assert sorted(tuple(x) for x in store.read_native(spark, f"file://{tmp_path}/raw", width=4).collect()) == [(i, i) for i in range(5)]
    with pytest.raises(Exception, match="no multiple"):
        store.read_native(spark, f"file://{tmp_path}/raw", width=8).collect()
    store.decimal_dump(values, f"file://{tmp_path}/dump")
    assert sorted(int(x["value"]) for x in spark.read.text(f"file://{tmp_path}/dump").collect()) == [i * 3 for i in range(100)]


def test_streamed_patterns(spark, tmp_path):
    strings = spark.createDataFrame([(0, "abracadabra")], "str_id long, text string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"pattern_id": 1, "pattern": "abra"}\n{"pattern_id": 2, "pattern": "zzzz"}\n{"pattern_id": 3, "pattern": "ca"}\n')
    stream = spark.readStream.schema("pattern_id long, pattern string").json(f"file://{tmp_path}/in")
    run = stream_occurrences(stream, strings, q=3).writeStream.format("memory").queryName("found").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(tuple(x) for x in spark.sql("SELECT pattern_id, pos FROM found").collect()) == [(1, 0), (1, 7), (3, 4)]
