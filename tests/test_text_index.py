import random
from dataclasses import replace

import pytest
from brute import ansv as brute_ansv
from brute import lcp, lcp_list, suffix_rows, tree_edges
from pyspark.sql import functions as F

from lexispark.operators import alphabet, checks, kmers, local_suffix, locate, rmq, suffix_tree, toplevel
from lexispark.operators import suffix_array as S
from lexispark.operators.ansv import KINDS, ansv
from lexispark.session import settle

# The suffix array and the child table of "mississippi", and the ranges of its substrings further below.
MISSISSIPPI = [10, 7, 4, 1, 0, 9, 8, 6, 3, 5, 2]
TABLE = {0: [0, 1, 15, 6, 9], 1: [11, 0, 0, 12, 3], 3: [0, 0, 0, 13, 14], 6: [0, 16, 0, 17, 0], 8: [0, 0, 0, 18, 19], 9: [0, 8, 0, 0, 10], 10: [0, 0, 0, 20, 21]}


def strings(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "str_id long, text string")


def order(df):
    return [(r["str_id"], r["pos"], r["gidx"]) for r in df.orderBy("rank").collect()]


def test_mississippi(spark):
    text = strings(spark, ["mississippi"])
    index = S.suffix_array(text, k=2)
    shared = settle(S.lcp_array(index), "lcp")
    assert [r["pos"] for r in index.sa.orderBy("rank").collect()] == MISSISSIPPI
    assert [r["rank"] for r in S.inverse(index).orderBy("pos").collect()] == [4, 3, 10, 8, 2, 9, 7, 1, 6, 5, 0]
    assert [r["lcp"] for r in shared.orderBy("rank").collect()] == [0, 1, 1, 4, 0, 0, 1, 0, 2, 1, 3]
    chars = alphabet.characters(text)
    assert [r["lc"] for r in S.lc_array(shared, chars).orderBy("rank").collect()][1:] == "$ p p i m i p p i p".split()
    edges = settle(suffix_tree.suffix_tree(index, shared, chars, alphabet.codes(text)), "edges")
    assert edges.count() == 17
    assert {r["parent"]: [r[f"c{i}"] for i in range(5)] for r in suffix_tree.node_table(edges, 4).collect()} == TABLE
    assert checks.check_suffix_tree(edges, 11).first().asDict() == {"missing_leaves": 0, "several_parents": 0, "loose": 0, "single_child": 0}
    damaged = {"missing_leaves": edges.where("child != 14"), "several_parents": edges.union(edges.where("child = 14")), "loose": edges.where("child != 8"), "single_child": edges.where("child != 18")}
    assert all(checks.check_suffix_tree(df, 11).first()[name] > 0 for name, df in damaged.items())


@pytest.mark.parametrize("times", [2, 3, 4])
def test_integers(spark, times):
    values = [128, 3, 12345678, 12345678, 3, 12345678, 12345678, 3, 66000, 66000, 3]
    df = spark.createDataFrame(list(enumerate(values)), "pos long, v long")
    assert [r["pos"] for r in S.suffix_array_int(df, times).sa.orderBy("rank").collect()] == MISSISSIPPI


def repeats(x, reps):
    return [x * i for i in range(1, reps + 1)]


SETS = [["xyxy", "yxyx", "xyxy"], repeats("no", 4), repeats("q", 17), ["", "x", "", "x", "yx"], ["a$b", "日本\U0001f600日", "é\ne"], ["tea", "eat", "tttt", "a", "e", "teat", "at"]]


@pytest.mark.parametrize("texts", SETS)
def test_string_sets(spark, texts):
    df = strings(spark, texts)
    rows = suffix_rows([(i, t) for i, t in enumerate(texts)])
    index = S.suffix_array(df, k=2)
    shared = settle(S.lcp_array(index), "lcp")
    assert order(index.sa) == [r[:3] for r in rows]
    assert [r["lcp"] for r in shared.orderBy("rank").collect()] == lcp_list(rows)
    local = local_suffix.local_suffix_array(df).orderBy("rank").collect()
    assert [(r["str_id"], r["pos"], r["gidx"], r["lcp"]) for r in local] == [(*r[:3], v) for r, v in zip(rows, lcp_list(rows), strict=True)]
    assert checks.check_sa(index, df).first().asDict() == {"missing_ranks": 0, "missing_places": 0, "repeated": 0, "unordered": 0}
    assert checks.check_lcp(index, shared, df).first()["wrong"] == 0


def test_both_strategies_on_random_and_repetitive_sets(spark):
    r = random.Random(3)
    words = ["anabasis", "banana", "anab", "asisban", "sis", "ana"]
    texts = ["".join(r.choice("ACGT") for _ in range(700)), "".join(r.choice(words) for _ in range(60)), "abc" * 60, "a" * 90]
    df = strings(spark, texts)
    rows = suffix_rows(list(enumerate(texts)))
    assert order(S.suffix_array(df, k=3, times=3).sa) == [x[:3] for x in rows]
    local = local_suffix.local_suffix_array(df).orderBy("rank").collect()
    assert [(x["str_id"], x["pos"], x["gidx"], x["lcp"]) for x in local] == [(*x[:3], v) for x, v in zip(rows, lcp_list(rows), strict=True)]


def test_more_symbols_than_sixteen_bits(spark):
    """Common prefixes where codes of symbols have 17 bits."""
    every = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every), every[65539] + every[3] + every[8], every[3] + every[3] + every[8]]
    rows = suffix_rows(list(enumerate(texts[1:])))
    df = strings(spark, texts)
    found = local_suffix.local_suffix_array(df).where("str_id > 0").select("str_id", "pos", "rank", "lcp").collect()
    again = S.lcp_array(S.suffix_array(df)).where("str_id > 0").select("str_id", "pos", "rank", "lcp").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    assert [(x["str_id"] - 1, x["pos"]) for x in sorted(found, key=lambda x: x["rank"])] == [x[:2] for x in rows]


def test_documents_by_both_strategies(spark, sf_dir):
    """Whole documents: both constructions agree in every row, and the short ones with brute force."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("str_id"), "text")
    index = S.suffix_array(df, times=4)
    both = S.lcp_array(index).select("rank", "str_id", "pos", "gidx", "lcp"), local_suffix.local_suffix_array(df).select("rank", "str_id", "pos", "gidx", "lcp")
    marks = [x.agg(F.count("*"), F.sum(F.xxhash64("rank", "str_id", "pos", "gidx", "lcp") % (1 << 40))).first() for x in both]
    assert tuple(marks[0]) == tuple(marks[1]) and marks[0][0] > 100_000
    short = df.where(F.length("text") < 800)
    rows = suffix_rows([(r["str_id"], r["text"]) for r in short.collect()])
    index = S.suffix_array(short, k=16, times=3)
    assert order(index.sa) == [x[:3] for x in rows]
    assert [r["lcp"] for r in S.lcp_array(index).orderBy("rank").collect()] == lcp_list(rows)


def test_checks_find_damage(spark):
    df = strings(spark, ["mississippi"])
    index = S.suffix_array(df, k=2)
    shared = settle(S.lcp_array(index), "lcp")
    swapped = index.sa.withColumn("rank", F.when(F.col("rank") == 3, 4).when(F.col("rank") == 4, 3).otherwise(F.col("rank")).cast("long"))
    assert checks.check_sa(replace(index, sa=swapped), df).first()["unordered"] > 0
    assert checks.check_sa(replace(index, sa=index.sa.where("rank != 5")), df).first()["missing_ranks"] == 1
    for wrong in (-1, 1):
        bad = shared.withColumn("lcp", F.col("lcp") + F.when(F.col("rank") == 3, wrong).otherwise(0))
        assert checks.check_lcp(index, bad, df).first()["wrong"] > 0


def test_transform_and_back(spark):
    for text in ("mississippi", "a", "abcabcabc", "zyx"):
        df = strings(spark, [text])
        index = S.suffix_array(df, k=2)
        rows = S.bwt(index, alphabet.characters(df)).select((F.col("rank") + 1).alias("rank"), "ch").union(spark.createDataFrame([(0, text[-1])], "rank long, ch string"))
        assert "".join(r["ch"] for r in S.inverse_bwt(rows).orderBy("pos").collect()) == text


@pytest.mark.parametrize("side", ["left", "right"])
@pytest.mark.parametrize("kind", KINDS)
def test_nearest_smaller_values(spark, side, kind):
    r = random.Random(1)
    shapes = [[r.randrange(100) for _ in range(137)], r.sample(range(100), 100), list(range(40)), list(range(40, 0, -1)), [5] * 30, [1, *[9] * 20, *range(30, 0, -1)], [3], [2, 1, 2, 1, 2, 2, 0, 2, 1, 2]]
    for values in shapes:
        df = spark.createDataFrame(list(enumerate(values)), "idx long, v long")
        got = [x["match"] for x in ansv(df, side, kind, -7, block=8).orderBy("idx").collect()]
        assert got == brute_ansv(values, side, kind, -7), (values, side, kind)


def test_range_minima(spark):
    r = random.Random(2)
    for n, top in ((1, 5), (73, 1000), (233, 3)):
        values = [r.randrange(-top, top) for _ in range(n)]
        df = spark.createDataFrame([(i, v, f"p{i}") for i, v in enumerate(values)], "idx long, v long, p string")
        ranges = [(l, z) for l in range(0, n, 3) for z in range(l, n + 1, 5)]
        queries = spark.createDataFrame([(i, *x) for i, x in enumerate(ranges)], "qid long, l long, r long")
        for row in rmq.bulk_rmq(queries, df, payload="p", block=8).collect():
            part = values[row["l"] : row["r"]]
            want = row["l"] + part.index(min(part)) if part else None
            assert (row["argmin"], row["vmin"], row["p"]) == (want, min(part) if part else None, f"p{want}" if part else None)


@pytest.mark.parametrize("texts", [["mississippi"], ["abab", "baba"], ["a"], ["aaaa"], ["abcabcab", "bca", "x"]])
def test_suffix_trees(spark, texts):
    df = strings(spark, texts)
    rows = suffix_rows(list(enumerate(texts)))
    index = S.suffix_array(df, k=2)
    shared = settle(S.lcp_array(index), "lcp")
    got = {(r["parent"], r["child"], r["depth"]) for r in suffix_tree.parents(shared).collect()}
    assert got == {(a, b, d) for a, b, d, _ in tree_edges(rows, lcp_list(rows))}
    codes = {c: i + 1 for i, c in enumerate(sorted(set("".join(texts))))}
    edges = suffix_tree.suffix_tree(index, shared, alphabet.characters(df), alphabet.codes(df))
    want = sorted((a, codes.get(rows[k][3][d : d + 1], 0), b) for a, b, d, k in tree_edges(rows, lcp_list(rows)))
    assert sorted((r["parent"], r["code"], r["child"]) for r in edges.collect()) == want
    grouped = {}
    for a, c, b in want:
        grouped.setdefault((a, c), []).append(b)
    assert {(r["parent"], r["code"], r["child_lo"], r["child_hi"]) for r in suffix_tree.generalized_edges(edges).collect()} == {(*k, min(v), max(v)) for k, v in grouped.items()}


HITS = {"i": (0, 4), "m": (4, 5), "p": (5, 7), "s": (7, 11), "is": (2, 4), "miss": (4, 5), "pi": (5, 6), "ss": (9, 11), "ip": (1, 2), "mississip": (4, 5), "pp": (6, 7), "si": (7, 9), "ississippi": (3, 4), "mississippi": (4, 5), "ppi": (6, 7), "ssi": (9, 11)}


@pytest.mark.parametrize("q", [1, 2, 4, 20])
def test_locate(spark, q):
    absent = ["misx", "ississippii", "issississi", "mippi", "piss", "iz", "z", "a", "é", "mississippia"]
    patterns = spark.createDataFrame(list(enumerate([*HITS, *absent])), "pattern_id long, pattern string")
    got = {r["pattern_id"]: (r["l"], r["r"]) for r in locate.locate(strings(spark, ["mississippi"]), patterns, q).collect()}
    rows = suffix_rows([(0, "mississippi")])
    for i, p in enumerate([*HITS, *absent]):
        less = sum(x[3] < p for x in rows)
        assert got[i] == HITS.get(p, (less, less))
    counts = {r["pattern_id"]: r["n"] for r in locate.count_occurrences(strings(spark, ["mississippi"]), patterns, q).collect()}
    assert counts == {i: got[i][1] - got[i][0] for i in got}


def test_occurrences_and_lookup_table(spark):
    texts = ["abracadabra", "cad", "", "abr"]
    df = strings(spark, texts)
    patterns = spark.createDataFrame([(0, "abr"), (1, "cad"), (2, "bra"), (3, "xxx")], "pattern_id long, pattern string")
    got = {(r["pattern_id"], r["str_id"], r["pos"]) for r in locate.occurrences(df, patterns, q=3).collect()}
    assert got == {(0, 0, 0), (0, 0, 7), (0, 3, 0), (1, 0, 4), (1, 1, 0), (2, 0, 1), (2, 0, 8)}
    rows = suffix_rows(list(enumerate(texts)))
    for r in locate.qmer_table(df, 2).collect():
        at = [i for i, x in enumerate(rows) if x[3][:2] == r["qmer"]]
        assert (r["l"], r["r"]) == (at[0], at[-1] + 1)


@pytest.mark.parametrize("most", [1, 5, 78])
def test_sampled_common_prefixes(spark, most):
    r = random.Random(5)
    rows = suffix_rows([(0, "".join(r.choice("ACGT") for _ in range(300)))])
    values = lcp_list(rows)
    df = spark.createDataFrame(list(enumerate(values)), "rank long, lcp long")
    n = len(values)
    left, right = brute_ansv(values, "left", "nearest_sm", 0), brute_ansv(values, "right", "nearest_sm", n)
    want = {i for i in range(n) if values[i] == 0 or right[i] - left[i] > most}
    assert {x["idx"] for x in toplevel.sample_lcp(df, most).collect()} == want


def recursive_parts(sums, low, high, parts):
    """First bins of the parts but the first, by the definition."""
    if parts == 1:
        return []
    if low == high:
        return [low] * (parts - 1)
    before = sums[low - 1] if low else 0
    left = -(-parts // 2)
    goal = before + (sums[high - 1] - before) * left // parts
    best = min(range(low, high), key=lambda i: (abs(sums[i] - goal), -sums[i], i))
    return [*recursive_parts(sums, low, best + 1, left), best + 1, *recursive_parts(sums, best + 1, high, parts - left)]


def test_bisection(spark):
    r = random.Random(6)
    for parts in (1, 2, 3, 8, 13):
        sizes = [r.choice([0, 1, 1, 5, 30]) for _ in range(r.randrange(1, 60))]
        sums = [sum(sizes[: i + 1]) for i in range(len(sizes))]
        starts = [0, *recursive_parts(sums, 0, len(sums), parts)]
        rows = toplevel.partition_bins(spark.createDataFrame([(2 * i, n) for i, n in enumerate(sizes)], "bin long, n long"), parts).orderBy("part").collect()
        assert [x["first_bin"] for x in rows] == starts
        assert [x["rows"] for x in rows] == [max(0, sum(sizes[a:z])) for a, z in zip(starts, [*starts[1:], len(sizes)], strict=True)]
    nothing = toplevel.partition_bins(spark.createDataFrame([], "bin long, n long"), 3).collect()
    assert [(x["first_bin"], x["rows"]) for x in nothing] == [(0, 0)] * 3
    bins = spark.createDataFrame([(i, n) for i, n in enumerate([5, 1, 1, 9, 2, 2])], "bin long, n long")
    found = toplevel.partition_bins(bins, 4)
    assert found.agg(F.sum("rows")).first()[0] == 20
    row = toplevel.imbalance(found).first()
    assert (row["parts"], row["most"]) == (4, 9) and row["percent"] == pytest.approx(80.0)


def test_packed_kmers(spark):
    texts = ["tea", "eat", "tttt", "a", "", "teat", "et"]
    df = strings(spark, texts)
    codes = settle(alphabet.codes(df), "codes")
    rows = kmers.packed_kmers(df, codes, 3, 2).orderBy("str_id", "pos")
    want = [sum(("aet".index(c) + 1) << 2 * (2 - j) for j, c in enumerate(t[p : p + 3])) for t in texts for p in range(len(t))]
    assert [r["packed"] for r in rows.collect()] == want
    text = {(r["str_id"], r["pos"]): r["kmer"] for r in kmers.decode_kmers(rows, codes, 3, 2).collect()}
    assert text == {(i, p): (t[p : p + 3] + "000")[:3] for i, t in enumerate(texts) for p in range(len(t))}
    with pytest.raises(ValueError):
        kmers.packed_kmers(df, codes, 32, 2)
    assert kmers.optimal_k(0, 7, 100) == 9 and kmers.optimal_k(5, 7, 3) == 3


def test_common_prefix_expression(spark):
    pairs = [("", ""), ("a", ""), ("abc", "abd"), ("abc", "abc"), ("日本", "日x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(S.string_lcp(F.col("a"), F.col("b"))).collect()] == [lcp(*p) for p in pairs]


def test_empty_sets(spark):
    df = spark.createDataFrame([], "str_id long, text string")
    assert S.suffix_array(df).sa.count() == 0 and local_suffix.local_suffix_array(df).count() == 0
    patterns = spark.createDataFrame([(0, "abcde"), (1, "a")], "pattern_id long, pattern string")
    assert {(r["pattern_id"], r["l"], r["r"]) for r in locate.locate(df, patterns).collect()} == {(0, 0, 0), (1, 0, 0)}
