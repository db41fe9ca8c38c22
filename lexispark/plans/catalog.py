"""Queries of the text-index operators over the driver's tables, with their SQL equivalents.

Bindings: the nation text joins all nation names by key, the customer text all customer names; the part set holds all
part names (many equal ones), the document set all texts; the event sequence holds whole values of all events by event_id.
Every query reads its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import alphabet, checks, gather, kmers, local_suffix, locate, ranking, rmq, stringsets, suffix_tree, toplevel
from ..operators import suffix_array as S
from ..operators.ansv import ansv
from ..session import exchanged, scratch, settle, table
from ..sources import store, text
from .index import TextIndex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def nation_text(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "nation").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("s"))
    return names.select(F.lit(0).cast("long").alias("str_id"), F.array_join(F.transform("s", lambda x: x["n_name"]), "").alias("text"))


def customer_text(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces (str_id, pos, text) of one string: customer names by key, none of them with the others in one row."""
    names = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("str_id"), F.col("c_name").alias("text"))
    places = stringsets.offsets(names).select("str_id", F.col("begin").alias("pos"))
    return names.join(exchanged(places), "str_id").select(F.lit(0).cast("long").alias("str_id"), "pos", "text")


def part_set(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("str_id"), F.col("p_name").alias("text"))


def document_set(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("str_id"), "text")


def event_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").cast("long").alias("idx"), F.floor("value").cast("long").alias("v"))


NATION = "t AS (SELECT string_agg(n_name, '' ORDER BY n_nationkey) AS s FROM nation)"
NATION_SUFFIXES = f"{NATION}, x AS (SELECT CAST(i AS BIGINT) AS pos, substr(s, i + 1) AS suf, substr(s, i + 1, 1) AS ch, length(s) AS n FROM t, range(0, (SELECT length(s) FROM t)) r(i))"
LCP = "coalesce(list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda k: left(a, k) = left(b, k))), 0)"
NATION_SA = f"{NATION_SUFFIXES}, o AS (SELECT CAST(row_number() OVER (ORDER BY suf) - 1 AS BIGINT) AS rank, pos, suf FROM x), c AS (SELECT rank, pos, suf, lag(suf) OVER (ORDER BY rank) AS b, suf AS a, lag(pos) OVER (ORDER BY rank) AS p_pos FROM o), l AS (SELECT rank, pos, p_pos, suf, CAST(CASE WHEN b IS NULL THEN 0 ELSE {LCP} END AS BIGINT) AS lcp FROM c)"
# customer names are numbered, so 60 symbols tell all suffixes apart
CUSTOMER_SUFFIXES = "t AS (SELECT string_agg(c_name, '' ORDER BY c_custkey) AS s FROM customer), x AS (SELECT CAST(i AS BIGINT) AS pos, substr(s, i + 1, 60) AS suf, substr(s, i + 1, 1) AS ch FROM t, range(0, (SELECT length(s) FROM t)) r(i))"
CUSTOMER_SA = f"{CUSTOMER_SUFFIXES}, o AS (SELECT CAST(row_number() OVER (ORDER BY suf) - 1 AS BIGINT) AS rank, pos, ch, suf FROM x), c AS (SELECT rank, pos, suf AS a, lag(suf) OVER (ORDER BY rank) AS b, lag(pos) OVER (ORDER BY rank) AS p_pos FROM o), l AS (SELECT rank, pos, p_pos, CAST(CASE WHEN b IS NULL THEN 0 ELSE {LCP} END AS BIGINT) AS lcp FROM c)"
PART = "p AS (SELECT CAST(p_partkey AS BIGINT) AS str_id, p_name AS s, CAST(coalesce(sum(length(p_name)) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS beg FROM part)"
PART_SUFFIXES = f"{PART}, x AS (SELECT str_id, CAST(i AS BIGINT) AS pos, beg + i AS gidx, substr(s, i + 1) AS suf, length(s) AS n FROM (SELECT str_id, s, beg, unnest(range(0, length(s))) AS i FROM p))"
PART_SA = f"{PART_SUFFIXES}, o AS (SELECT CAST(row_number() OVER (ORDER BY suf, gidx) - 1 AS BIGINT) AS rank, str_id, pos, gidx, suf FROM x)"
PART_LCP = f"{PART_SA}, c AS (SELECT rank, str_id, pos, suf AS a, lag(suf) OVER w AS b, lag(str_id) OVER w AS p_str, lag(pos) OVER w AS p_pos FROM o WINDOW w AS (ORDER BY rank)), l AS (SELECT rank, str_id, pos, p_str, p_pos, CAST(CASE WHEN b IS NULL THEN 0 ELSE {LCP} END AS BIGINT) AS lcp FROM c)"
EVENTS = "e AS (SELECT CAST(event_id AS BIGINT) AS idx, CAST(floor(value) AS BIGINT) AS v FROM events)"


def nation_index(spark: SparkSession, sf: str, times: int = 2) -> S.SuffixArray:
    return S.suffix_array(nation_text(spark, sf), times=times)


# alphabets


@query("SELECT ch, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch")
def alphabet_histogram(spark, sf):
    return alphabet.histogram(document_set(spark, sf))


@query("SELECT ch, CAST(row_number() OVER (ORDER BY ch) AS BIGINT) AS code FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> ''")
def alphabet_codes(spark, sf):
    return alphabet.codes(document_set(spark, sf))


@query("""WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents), d AS (SELECT count(*) AS sigma, string_agg(ch, '' ORDER BY ch) AS u FROM c WHERE ch <> '')
    SELECT CAST(sigma AS BIGINT) AS sigma, CAST(ceil(log2(sigma + 1)) AS BIGINT) AS bits_per_char, CAST(floor(63 / ceil(log2(sigma + 1))) AS BIGINT) AS chars_per_word, u AS unique_chars FROM d""")
def alphabet_stats(spark, sf):
    return alphabet.stats(document_set(spark, sf))


@query("""WITH c AS (SELECT CAST(n_nationkey AS BIGINT) AS str_id, CAST(i AS BIGINT) AS pos, substr(n_name, CAST(i + 1 AS BIGINT), 1) AS ch FROM (SELECT n_nationkey, n_name, unnest(range(0, length(n_name))) AS i FROM nation)),
    a AS (SELECT ch, CAST(row_number() OVER (ORDER BY ch) AS BIGINT) AS code FROM (SELECT DISTINCT ch FROM c)) SELECT str_id, pos, c.ch, code FROM c JOIN a ON c.ch = a.ch""")
def alphabet_encode(spark, sf):
    strings = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("str_id"), F.col("n_name").alias("text"))
    coded = alphabet.encode(alphabet.characters(strings), alphabet.codes(strings))
    return alphabet.decode(coded.drop("ch"), alphabet.codes(strings)).select("str_id", "pos", "ch", "code")


@query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) - (SELECT CAST(min(l_quantity) AS BIGINT) FROM lineitem) + 1 AS code FROM lineitem")
def int_alphabet_encode(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long").alias("q"))
    return alphabet.integer_encode(rows, "q").select("l_orderkey", "l_linenumber", "code")


# k-mers


@query(f"WITH {PART} SELECT str_id, CAST(i AS BIGINT) AS pos, substr(s, CAST(i + 1 AS BIGINT), 5) AS kmer FROM (SELECT str_id, s, unnest(range(0, length(s))) AS i FROM p)")
def kmer_generate(spark, sf):
    return kmers.kmers(part_set(spark, sf), 5)


@query("SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM (SELECT substr(text, CAST(i + 1 AS BIGINT), 4) AS kmer FROM (SELECT text, unnest(range(0, length(text))) AS i FROM documents)) GROUP BY kmer")
def kmer_histogram(spark, sf):
    return kmers.kmer_histogram(document_set(spark, sf), 4)


KMER_CODES = f"""{PART}, c AS (SELECT str_id, CAST(i AS BIGINT) AS pos, substr(s, CAST(i + 1 AS BIGINT), 1) AS ch FROM (SELECT str_id, s, unnest(range(0, length(s))) AS i FROM p)),
    a AS (SELECT ch, CAST(row_number() OVER (ORDER BY ch) AS BIGINT) AS code FROM (SELECT DISTINCT ch FROM c)),
    d AS (SELECT str_id, pos, c.ch, code, lead(code, 1, 0) OVER w AS c1, lead(code, 2, 0) OVER w AS c2, lead(c.ch, 1, '0') OVER w AS h1, lead(c.ch, 2, '0') OVER w AS h2, (SELECT CAST(ceil(log2(count(*) + 1)) AS INT) FROM a) AS bits FROM c JOIN a ON c.ch = a.ch WINDOW w AS (PARTITION BY str_id ORDER BY pos))"""


def _packed(spark, sf):
    codes = settle(alphabet.codes(part_set(spark, sf)), "codes")
    width = alphabet.bits_for(codes.count())
    return kmers.packed_kmers(part_set(spark, sf), codes, 3, width), codes, width


@query(f"WITH {KMER_CODES} SELECT str_id, pos, CAST(code * (1 << (2 * bits)) + c1 * (1 << bits) + c2 AS BIGINT) AS packed FROM d")
def kmer_packed(spark, sf):
    return _packed(spark, sf)[0]


@query(f"WITH {KMER_CODES} SELECT str_id, pos, ch || h1 || h2 AS kmer FROM d")
def kmer_decode(spark, sf):
    packed, codes, width = _packed(spark, sf)
    return kmers.decode_kmers(packed, codes, 3, width).select("str_id", "pos", "kmer")


# bits


@query("""SELECT CAST(o_orderkey AS BIGINT) AS x, CAST(CASE WHEN o_orderkey = 0 THEN 64 ELSE length(bin(o_orderkey)) - length(rtrim(bin(o_orderkey), '0')) END AS BIGINT) AS tz,
    CAST(CASE WHEN o_orderkey = 0 THEN 64 ELSE 64 - length(bin(o_orderkey)) END AS BIGINT) AS lz, CAST(CASE WHEN o_orderkey = 0 THEN 32 ELSE 32 - length(bin(o_orderkey)) END AS BIGINT) AS lz32,
    CAST(length(bin(o_orderkey + 1)) - 1 AS BIGINT) AS floorlog2, CAST(ceil(log2(o_orderkey + 1)) AS BIGINT) AS ceillog2 FROM orders""")
def bit_ops(spark, sf):
    x = F.col("x")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("x"))
    return rows.select("x", bits.trailing_zeros(x).alias("tz"), bits.leading_zeros(x).alias("lz"), bits.leading_zeros(x, 32).alias("lz32"), bits.floor_log2(x + 1).alias("floorlog2"), bits.ceil_log2(x + 1).alias("ceillog2"))


@query("""WITH z AS (SELECT CAST(l_orderkey AS BIGINT) AS x, CAST(l_partkey AS BIGINT) AS y, xor(CAST(l_orderkey AS BIGINT), CAST(l_partkey AS BIGINT)) AS d FROM lineitem)
    SELECT x, y, CAST(CASE WHEN d = 0 THEN 16 ELSE (48 - length(bin(d))) // 3 END AS BIGINT) AS lcp,
    CAST(least(CASE WHEN d = 0 THEN 16 ELSE (48 - length(bin(d))) // 3 END, CASE WHEN x = 0 THEN 0 ELSE 16 - (length(bin(x)) - length(rtrim(bin(x), '0'))) // 3 END) AS BIGINT) AS lcp_no0 FROM z""")
def lcp_bitwise(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long").alias("x"), F.col("l_partkey").cast("long").alias("y"))
    return rows.select("x", "y", bits.lcp_bitwise(F.col("x"), F.col("y"), 16, 3).alias("lcp"), bits.lcp_bitwise_no0(F.col("x"), F.col("y"), 16, 3).alias("lcp_no0"))


# gathers and shifts


@query(f"WITH {EVENTS} SELECT idx, v, CAST(coalesce(lead(v, 100) OVER (ORDER BY idx), 0) AS BIGINT) AS shifted FROM e")
def shift_vector(spark, sf):
    return gather.shift(event_values(spark, sf), 100, "v")


@query(f"WITH {EVENTS} SELECT idx, v, " + ", ".join(f"CAST(coalesce(lead(v, {7 * j}) OVER (ORDER BY idx), 0) AS BIGINT) AS b{j}" for j in (1, 2, 3)) + " FROM e")
def multi_shift(spark, sf):
    return gather.multi_shift(event_values(spark, sf), 7, 3, "v")


@query(f"WITH {KMER_CODES} SELECT str_id, pos, code, CAST(coalesce(lead(code, 3) OVER (PARTITION BY str_id ORDER BY pos), 0) AS BIGINT) AS shifted FROM d")
def shift_within_string(spark, sf):
    strings = part_set(spark, sf)
    coded = alphabet.encode(alphabet.characters(strings), alphabet.codes(strings)).select("str_id", "pos", "code")
    return gather.shift(coded, 3, "code", keys=("str_id",), index="pos")


@query(f"WITH {EVENTS}, n AS (SELECT count(*) AS n FROM e) SELECT q.idx AS qid, CAST((q.idx * 7919 + 13) % n AS BIGINT) AS idx, e.v AS v FROM e q, n JOIN e ON e.idx = (q.idx * 7919 + 13) % n")
def bulk_gather(spark, sf):
    values = event_values(spark, sf)
    n = values.count()
    return gather.bulk_gather(values.select(F.col("idx").alias("qid"), F.pmod(F.col("idx") * 7919 + 13, F.lit(n)).alias("idx")), values, value="v").select("qid", "idx", "v")


@query(f"WITH {EVENTS}, n AS (SELECT count(*) AS n FROM e) SELECT CAST(n - 1 - idx AS BIGINT) AS idx, v FROM e, n")
def bulk_permute(spark, sf):
    values = event_values(spark, sf)
    n = values.count()
    return gather.bulk_permute(values.withColumn("target", F.lit(n - 1) - F.col("idx")), "target").select("idx", "v")


# ranking


@query(f"WITH {EVENTS} SELECT idx, v, CAST(rank() OVER (ORDER BY v) - 1 AS BIGINT) AS bucket FROM e")
def rebucket_rank(spark, sf):
    return ranking.ranked(event_values(spark, sf).withColumnRenamed("idx", "event"), ["v"]).select(F.col("event").alias("idx"), "v", "bucket")


@query(f"WITH {EVENTS}, b AS (SELECT idx, v, CAST(rank() OVER (ORDER BY v, idx % 2) - 1 AS BIGINT) AS bucket FROM e) SELECT idx, v, bucket FROM (SELECT *, count(*) OVER (PARTITION BY bucket) AS n FROM b) WHERE n > 1")
def active_elements(spark, sf):
    rows = event_values(spark, sf).select(F.col("idx").alias("event"), "v", (F.col("idx") % 2).alias("parity"))
    return ranking.active(ranking.ranked(rows, ["v", "parity"])).select(F.col("event").alias("idx"), "v", "bucket")


@query(f"WITH {EVENTS}, m AS (SELECT idx, CASE WHEN v % 5 = 0 THEN idx + 1 ELSE 0 END AS m FROM e) SELECT idx, CAST(max(m) OVER (ORDER BY idx) AS BIGINT) AS filled FROM m")
def fill_forward(spark, sf):
    marked = event_values(spark, sf).select("idx", F.when(F.col("v") % 5 == 0, F.col("idx") + 1).otherwise(F.lit(0).cast("long")).alias("m"))
    return ranking.fill_forward(marked, "idx", "m").select("idx", "filled")


# suffix arrays of one text


@query(f"WITH {CUSTOMER_SA} SELECT rank, pos, lcp FROM l")
def suffix_array(spark, sf):
    return S.lcp_array(S.suffix_array(customer_text(spark, sf))).select("rank", "pos", "lcp")


@query(f"WITH {CUSTOMER_SA} SELECT pos, rank FROM l")
def inverse_suffix_array(spark, sf):
    return S.inverse(S.suffix_array(customer_text(spark, sf))).select("pos", "rank")


@query(f"WITH {CUSTOMER_SA} SELECT rank, pos FROM l")
def suffix_array_tripling(spark, sf):
    return S.suffix_array(customer_text(spark, sf), k=2, times=3).sa.select("rank", "pos")


@query(f"WITH {CUSTOMER_SA} SELECT rank, lcp, CASE WHEN p_pos IS NOT NULL THEN coalesce(nullif(substr((SELECT s FROM t), CAST(p_pos + lcp + 1 AS BIGINT), 1), ''), '$') END AS lc FROM l")
def lc_array(spark, sf):
    pieces = customer_text(spark, sf)
    return S.lc_array(settle(S.lcp_array(S.suffix_array(pieces)), "lcp"), alphabet.characters(pieces))


@query(f"WITH {PART_LCP} SELECT rank, lcp, CASE WHEN p_str IS NOT NULL THEN coalesce(nullif(substr(p.s, CAST(p_pos + lcp + 1 AS BIGINT), 1), ''), '$') END AS lc FROM l LEFT JOIN p ON p.str_id = l.p_str")
def generalized_lc(spark, sf):
    return S.lc_array(settle(S.lcp_array(S.suffix_array(part_set(spark, sf))), "lcp"), alphabet.characters(part_set(spark, sf)))


@query(f"WITH {PART_SA} SELECT rank, CASE WHEN pos = 0 THEN '$' ELSE substr(s, pos, 1) END AS ch FROM o JOIN p ON p.str_id = o.str_id")
def bwt(spark, sf):
    return S.bwt(S.suffix_array(part_set(spark, sf)), alphabet.characters(part_set(spark, sf)))


@query(f"WITH {CUSTOMER_SUFFIXES} SELECT pos, ch FROM x")
def inverse_bwt(spark, sf):
    pieces = customer_text(spark, sf)
    found = S.bwt(S.suffix_array(pieces), alphabet.characters(pieces))
    end = pieces.select(F.lit(-1).cast("long").alias("rank"), F.struct("pos", F.substring("text", -1, 1).alias("ch")).alias("x"))
    last = end.groupBy("rank").agg(F.max("x").alias("x")).select("rank", "x.ch")  # the suffix that is the end alone
    return S.inverse_bwt(found.unionByName(last).withColumn("rank", F.col("rank") + 1))


@query("""WITH a AS (SELECT list(CAST(floor(value) AS BIGINT) ORDER BY event_id) AS s FROM events), x AS (SELECT i AS pos, s[i + 1 : i + 40] AS suf FROM a, range(0, (SELECT len(s) FROM a)) r(i))
    SELECT CAST(row_number() OVER (ORDER BY suf) - 1 AS BIGINT) AS rank, CAST(pos AS BIGINT) AS pos FROM x""")
def suffix_array_int(spark, sf):
    return S.suffix_array_int(event_values(spark, sf).select(F.col("idx").alias("pos"), "v")).sa.select("rank", "pos")


# string sets


@query(f"WITH {PART_SA} SELECT rank, str_id, pos, gidx FROM o")
def generalized_suffix_array(spark, sf):
    return S.suffix_array(part_set(spark, sf)).sa


@query(f"WITH {PART_LCP} SELECT rank, lcp FROM l")
def generalized_lcp(spark, sf):
    return S.lcp_array(S.suffix_array(part_set(spark, sf))).select("rank", "lcp")


@query(f"WITH {PART_LCP}, g AS (SELECT l.*, o.gidx FROM l JOIN o ON o.rank = l.rank) SELECT rank, str_id, pos, gidx, lcp FROM g")
def suffix_array_one_task(spark, sf):
    """The strategy for sets that fit one task."""
    return local_suffix.local_suffix_array(part_set(spark, sf))


def _doubling_sql(start: int, levels: int) -> str:
    """Suffix order of all documents: by their first `start` symbols, then by four times as many, `levels` times."""
    text = f"""d AS (SELECT CAST(doc_id AS BIGINT) AS str_id, text, length(text) AS size, CAST(coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS beg FROM documents WHERE length(text) > 0),
    k AS MATERIALIZED (SELECT str_id, pos, beg + pos AS gidx, beg + size - 1 AS last, rank() OVER (ORDER BY substr(text, CAST(pos + 1 AS BIGINT), {start})) AS b FROM (SELECT str_id, text, beg, size, unnest(range(0, size)) AS pos FROM d))"""
    h, last = start, "k"
    for i in range(levels):
        ahead = ", ".join(f"CASE WHEN gidx + {j * h} <= last THEN lead(b, {j * h}) OVER w ELSE 0 END AS b{j}" for j in (1, 2, 3))
        text += f""",
    k{i} AS MATERIALIZED (SELECT str_id, pos, gidx, last, rank() OVER (ORDER BY b, b1, b2, b3) AS b FROM (SELECT str_id, pos, gidx, last, b, {ahead} FROM {last} WINDOW w AS (ORDER BY gidx)))"""
        h, last = 4 * h, f"k{i}"
    return f"WITH {text} SELECT CAST(row_number() OVER (ORDER BY b, gidx) - 1 AS BIGINT) AS rank, str_id, CAST(pos AS BIGINT) AS pos, CAST(gidx AS BIGINT) AS gidx FROM {last}"


@query(_doubling_sql(64, 6))
def documents_suffix_array(spark, sf):
    """Generalized suffix array of all whole documents."""
    return S.suffix_array(document_set(spark, sf)).sa


@query()
def documents_lcp(spark, sf):
    """Common prefixes of neighbours among all suffixes of all whole documents; held against brute force in the tests."""
    return S.lcp_array(S.suffix_array(document_set(spark, sf))).select("rank", "lcp")


# nearest smaller values

LEFT = {
    "nearest_sm": "SELECT a.idx, a.v, CAST(coalesce(max(b.idx), -1) AS BIGINT) AS match FROM e a LEFT JOIN e b ON b.idx < a.idx AND b.v < a.v GROUP BY a.idx, a.v",
    "nearest_eq": "SELECT a.idx, a.v, CAST(coalesce(max(b.idx), -1) AS BIGINT) AS match FROM e a LEFT JOIN e b ON b.idx < a.idx AND b.v <= a.v GROUP BY a.idx, a.v",
}
RIGHT = {k: v.replace("max(b.idx)", "min(b.idx)").replace("b.idx < a.idx", "b.idx > a.idx") for k, v in LEFT.items()}
FURTHEST = """, q AS ({eq}), s AS ({sm}), g AS (SELECT v, match AS s, {pick}(idx) AS first FROM s GROUP BY v, match)
    SELECT q.idx, q.v, CASE WHEN q.match = -1 THEN -1 ELSE g.first END AS match FROM q LEFT JOIN s ON s.idx = q.match LEFT JOIN g ON g.v = s.v AND g.s = s.match"""


def _ansv(side: str, kind: str) -> None:
    table_ = LEFT if side == "left" else RIGHT
    tail = FURTHEST.format(eq=table_["nearest_eq"], sm=table_["nearest_sm"], pick="min" if side == "left" else "max") if kind == "furthest_eq" else " " + table_[kind]
    name = f"ansv_{side}_{kind}"
    QUERIES[name] = lambda spark, sf: ansv(event_values(spark, sf), side, kind, -1)
    ORACLES[name] = f"WITH {EVENTS}{tail}"


for _side in ("left", "right"):
    for _kind in ("nearest_sm", "nearest_eq", "furthest_eq"):
        _ansv(_side, _kind)


# range minima

RANGES = f"{EVENTS}, n AS (SELECT count(*) AS n FROM e), q AS (SELECT idx AS qid, idx AS l, least(idx + 1 + (idx * 31) % 500, n) AS r FROM e, n)"


def _ranges(spark, sf):
    values = event_values(spark, sf)
    n = values.count()
    i = F.col("idx")
    return values.select(i.alias("qid"), i.alias("l"), F.least(i + 1 + F.pmod(i * 31, F.lit(500)), F.lit(n)).alias("r")), values


@query(f"WITH {RANGES}, j AS (SELECT qid, l, r, v, idx FROM q JOIN e ON idx >= l AND idx < r), m AS (SELECT qid, l, r, min(v) AS vmin FROM j GROUP BY qid, l, r) SELECT m.qid, m.l, CAST(m.r AS BIGINT) AS r, min(j.idx) AS argmin, vmin FROM m JOIN j ON m.qid = j.qid AND j.v = vmin GROUP BY m.qid, m.l, m.r, vmin")
def rmq_bulk(spark, sf):
    queries, values = _ranges(spark, sf)
    return rmq.bulk_rmq(queries, values)


@query(f"WITH {RANGES}, j AS (SELECT qid, v, idx FROM q JOIN e ON idx >= l AND idx < r), m AS (SELECT qid, min(v) AS vmin FROM j GROUP BY qid), f AS (SELECT m.qid, min(j.idx) AS argmin, vmin FROM m JOIN j ON m.qid = j.qid AND j.v = vmin GROUP BY m.qid, vmin) SELECT qid, vmin, CAST(user_id AS BIGINT) AS user_id FROM f JOIN events ON event_id = argmin")
def rmq_payload(spark, sf):
    queries, values = _ranges(spark, sf)
    users = table(spark, sf, "events").select(F.col("event_id").cast("long").alias("idx"), F.col("user_id").cast("long"))
    return rmq.bulk_rmq(queries, values.join(users, "idx"), payload="user_id").select("qid", "vmin", "user_id")


# suffix trees

TREE = f"""{NATION_SA}, n AS (SELECT count(*) AS n FROM l), v AS (SELECT rank AS i, lcp, pos FROM l),
    ls AS (SELECT a.i, max(b.i) AS s FROM v a LEFT JOIN v b ON b.i < a.i AND b.lcp < a.lcp GROUP BY a.i),
    le AS (SELECT a.i, max(b.i) AS e FROM v a LEFT JOIN v b ON b.i < a.i AND b.lcp <= a.lcp GROUP BY a.i),
    g AS (SELECT v.lcp, ls.s, min(v.i) AS first FROM v JOIN ls ON ls.i = v.i GROUP BY v.lcp, ls.s),
    f AS (SELECT le.i, g.first AS f, g.lcp AS lf FROM le JOIN v ON v.i = le.e JOIN ls ON ls.i = le.e JOIN g ON g.lcp = v.lcp AND g.s IS NOT DISTINCT FROM ls.s),
    rs AS (SELECT a.i, min(b.i) AS r FROM v a JOIN v b ON b.i > a.i AND b.lcp < a.lcp GROUP BY a.i),
    w AS (SELECT v.i, v.lcp, v.pos, lead(v.lcp, 1, 0) OVER (ORDER BY v.i) AS after, f.f, f.lf, rs.r, vr.lcp AS lr FROM v LEFT JOIN f ON f.i = v.i LEFT JOIN rs ON rs.i = v.i LEFT JOIN v vr ON vr.i = rs.r),
    edges AS (
        SELECT CASE WHEN after > lcp THEN i + 1 WHEN lf = lcp THEN f ELSE i END AS parent, i + n AS child, greatest(lcp, after) AS depth, pos FROM w, n
        UNION ALL SELECT CASE WHEN lr IS NULL OR lf >= lr THEN f ELSE r END, i, CASE WHEN lr IS NULL OR lf >= lr THEN lf ELSE lr END, pos FROM w WHERE lcp > 0 AND lf < lcp),
    alpha AS (SELECT ch, row_number() OVER (ORDER BY ch) AS code FROM (SELECT DISTINCT ch FROM x)),
    tree AS (SELECT CAST(parent AS BIGINT) AS parent, CAST(coalesce(code, 0) AS BIGINT) AS code, CAST(child AS BIGINT) AS child FROM edges LEFT JOIN x ON x.pos = edges.pos + depth LEFT JOIN alpha ON alpha.ch = x.ch)"""


def _tree(spark, strings):
    index = S.suffix_array(strings)
    lcp = settle(S.lcp_array(index), "lcp")
    return suffix_tree.suffix_tree(index, lcp, alphabet.characters(strings), alphabet.codes(strings)), lcp


@query(f"WITH {TREE} SELECT parent, code, child FROM tree")
def suffix_tree_edges(spark, sf):
    return _tree(spark, nation_text(spark, sf))[0]


@query(f"WITH {TREE} SELECT parent, CAST(count(*) AS BIGINT) AS children, CAST(coalesce(max(CASE WHEN code = 0 THEN child END), 0) AS BIGINT) AS c0, CAST(coalesce(max(CASE WHEN code = 1 THEN child END), 0) AS BIGINT) AS c1 FROM tree GROUP BY parent")
def suffix_tree_nodes(spark, sf):
    edges = settle(_tree(spark, nation_text(spark, sf))[0], "edges")
    counts = edges.groupBy("parent").agg(F.count("*").alias("children"))
    return suffix_tree.node_table(edges, 1).join(counts, "parent").select("parent", "children", "c0", "c1")


@query()
def gst_edges(spark, sf):
    """Generalized suffix tree of all part names; held against brute force in the tests."""
    return suffix_tree.generalized_edges(_tree(spark, part_set(spark, sf))[0])


# locating patterns

PATTERNS = """w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS s FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT left(p_name, 2) FROM part
    UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT p_name || 'x' FROM part), pat AS (SELECT CAST(row_number() OVER (ORDER BY s) AS BIGINT) AS pattern_id, s AS pattern FROM w)"""


def _patterns(spark, sf):
    part = table(spark, sf, "part")
    names = part.select(F.col("p_name").alias("s"))
    words = part.select(F.explode(F.split("p_name", " ")).alias("s"))
    found = words.union(names).union(names.select(F.substring("s", 1, 2))).union(part.select("p_type")).union(names.select(F.concat("s", F.lit("x")))).distinct()
    return settle(ranking.ranked(found, ["s"]).select((F.col("idx") + 1).alias("pattern_id"), F.col("s").alias("pattern")), "patterns")


LOCATED = f"{PART_SUFFIXES}, {PATTERNS}, r AS (SELECT pattern_id, CAST(sum(CASE WHEN suf < pattern THEN 1 ELSE 0 END) AS BIGINT) AS l, CAST(sum(CASE WHEN starts_with(suf, pattern) THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM pat, x GROUP BY pattern_id)"


@query(f"WITH {LOCATED} SELECT pattern_id, l, l + hits AS r FROM r")
def locate_patterns(spark, sf):
    """Through an index of the part set: q-mer table, then search in the suffix array."""
    return TextIndex.build(part_set(spark, sf), budget=1 << 12).locate(_patterns(spark, sf))


@query(f"WITH {LOCATED} SELECT pattern_id, l, l + hits AS r FROM r")
def locate_stored(spark, sf):
    """The same through an index that was written and read back."""
    path = scratch(spark, "stored")
    TextIndex.build(part_set(spark, sf), budget=1 << 12).save(path)
    return TextIndex.load(spark, path).locate(_patterns(spark, sf))


@query(f"WITH {LOCATED} SELECT pattern_id, l, l + hits AS r FROM r")
def locate_by_qmers(spark, sf):
    """The same without an index, where patterns and suffixes meet on q-mers."""
    return locate.locate(part_set(spark, sf), _patterns(spark, sf), q=4)


@query(f"WITH {LOCATED} SELECT pattern_id, hits AS n FROM r")
def count_occurrences(spark, sf):
    return locate.count_occurrences(part_set(spark, sf), _patterns(spark, sf), q=3)


@query(f"WITH {LOCATED} SELECT pattern_id, l FROM r WHERE hits = 0")
def locate_missing(spark, sf):
    return locate.locate(part_set(spark, sf), _patterns(spark, sf), q=2).where("l = r").select("pattern_id", "l")


@query("SELECT CAST(item_id AS BIGINT) AS pattern_id, CAST(doc_id AS BIGINT) AS str_id, CAST(instr(d.text, b.text) - 1 AS BIGINT) AS pos FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def benchmark_occurrences(spark, sf):
    """First place of every benchmark item in every document that holds it."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("pattern_id"), F.col("text").alias("pattern"))
    found = locate.occurrences(document_set(spark, sf), items, q=12)
    return found.groupBy("pattern_id", "str_id").agg(F.min("pos").alias("pos"))


@query(f"WITH {PART_SUFFIXES}, c AS (SELECT left(suf, 3) AS qmer, count(*) AS n FROM x GROUP BY 1) SELECT qmer, CAST(sum(n) OVER (ORDER BY qmer) - n AS BIGINT) AS l, CAST(sum(n) OVER (ORDER BY qmer) AS BIGINT) AS r FROM c")
def qmer_lookup_table(spark, sf):
    return locate.qmer_table(part_set(spark, sf), 3)


@query(f"WITH {LOCATED} SELECT r.pattern_id, l, l + hits AS r FROM r JOIN pat ON pat.pattern_id = r.pattern_id WHERE length(pattern) <= 4")
def qmer_lookup(spark, sf):
    return locate.qmer_ranges(part_set(spark, sf), _patterns(spark, sf).where(F.length("pattern") <= 4), 4)


# top-level indexes

@query(f"""WITH {NATION_SA}, n AS (SELECT count(*) AS n FROM l), z AS (SELECT a.rank AS idx, a.lcp, coalesce((SELECT max(b.rank) FROM l b WHERE b.rank < a.rank AND b.lcp < a.lcp), 0) AS a, coalesce((SELECT min(b.rank) FROM l b WHERE b.rank > a.rank AND b.lcp < a.lcp), (SELECT n FROM n)) AS z FROM l a)
    SELECT idx, lcp FROM z WHERE lcp = 0 OR z - a > 20""")
def sample_lcp(spark, sf):
    return toplevel.sample_lcp(S.lcp_array(nation_index(spark, sf)), 20)


def _bins(spark, sf):
    counts = kmers.kmer_histogram(document_set(spark, sf), 2)
    return settle(ranking.ranked(counts, ["kmer"]).select(F.col("idx").alias("bin"), "n"), "bins")


BINS = """b AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY kmer) - 1 AS BIGINT) AS i, CAST(sum(n) OVER (ORDER BY kmer) AS BIGINT) AS s FROM
    (SELECT kmer, count(*) AS n FROM (SELECT substr(text, CAST(i + 1 AS BIGINT), 2) AS kmer FROM (SELECT text, unnest(range(0, length(text))) AS i FROM documents)) GROUP BY kmer))"""


def _bisection_sql(levels: int) -> str:
    """Tables l{levels}_0 ... and p{levels}: the parts of all bins after so many halvings."""
    name = f"l{levels}"
    text = f"{name}_0 AS (SELECT CAST(0 AS BIGINT) AS low, count(*) AS high, CAST(0 AS BIGINT) AS before, max(s) AS after, CAST(0 AS BIGINT) AS part, {1 << levels} AS k FROM b)"
    for j in range(levels):
        text += f""", {name}_c{j} AS MATERIALIZED (SELECT * FROM (SELECT l.*, i, s, row_number() OVER (PARTITION BY part ORDER BY abs(s - (before + (after - before) // 2)), s DESC, i) AS o FROM {name}_{j} l LEFT JOIN b ON i >= low AND i < high) WHERE o = 1),
    {name}_{j + 1} AS MATERIALIZED (SELECT low, coalesce(i + 1, low) AS high, before, coalesce(s, before) AS after, part, k // 2 AS k FROM {name}_c{j}
        UNION ALL SELECT coalesce(i + 1, low), high, coalesce(s, before), after, part + k // 2, k // 2 FROM {name}_c{j})"""
    return text + f", p{levels} AS (SELECT part, low AS first_bin, CAST(greatest(0, lead(before, 1, (SELECT max(s) FROM b)) OVER (ORDER BY part) - before) AS BIGINT) AS rows FROM {name}_{levels})"


@query(f"WITH {BINS}, {_bisection_sql(4)} SELECT part, first_bin, rows FROM p4")
def partition_bisection(spark, sf):
    """Parts of all q-mer bins of the documents."""
    return toplevel.partition_bins(_bins(spark, sf), 16)


@query(f"WITH {BINS}, {', '.join(map(_bisection_sql, range(1, 11)))}, u AS (" + " UNION ALL ".join(f"SELECT {p} AS p, rows FROM p{p}" for p in range(1, 11)) + """), m AS (SELECT count(*) AS parts, max(rows) AS most, min(rows) AS least, CAST(floor(sum(rows) / count(*)) AS BIGINT) AS mean FROM u GROUP BY p)
    SELECT parts, most, least, CAST(most - mean AS DOUBLE) * CAST(100 AS DOUBLE) / nullif(mean, 0) AS percent FROM m""")
def partition_imbalance(spark, sf):
    """Load imbalance of 2 to 1024 parts."""
    found = [toplevel.imbalance(x) for x in toplevel.partitions(_bins(spark, sf), [1 << p for p in range(1, 11)])]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# checks


@query("SELECT CAST(0 AS BIGINT) AS missing_ranks, CAST(0 AS BIGINT) AS missing_places, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS unordered")
def check_sa(spark, sf):
    return checks.check_sa(S.suffix_array(part_set(spark, sf)), part_set(spark, sf))


@query("SELECT CAST(0 AS BIGINT) AS wrong")
def check_lcp(spark, sf):
    index = S.suffix_array(part_set(spark, sf))
    return checks.check_lcp(index, settle(S.lcp_array(index), "lcp"), part_set(spark, sf))


@query("SELECT CAST(0 AS BIGINT) AS missing_leaves, CAST(0 AS BIGINT) AS several_parents, CAST(0 AS BIGINT) AS loose, CAST(0 AS BIGINT) AS single_child")
def check_suffix_tree(spark, sf):
    edges, lcp = _tree(spark, nation_text(spark, sf))
    return checks.check_suffix_tree(settle(edges, "edges"), lcp.count())


# string sets, sources and sinks


@query("SELECT CAST(doc_id AS BIGINT) AS text_id, CAST(i - 1 AS BIGINT) AS str_no, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: s <> '') AS p FROM documents))")
def parse_stringset(spark, sf):
    return stringsets.parse(table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("text_id"), "text"), "\n")


@query("SELECT CAST(n_regionkey AS BIGINT) AS text_id, string_agg(n_name || '$', '' ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def flatten_strings(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("text_id"), F.col("n_nationkey").cast("long").alias("str_no"), F.col("n_name").alias("text"))
    return stringsets.flatten(rows, "$")


@query("""SELECT str_id, "end" - size AS "begin", "end" FROM (SELECT CAST(doc_id AS BIGINT) AS str_id, CAST(length(text) AS BIGINT) AS size, CAST(sum(length(text)) OVER (ORDER BY doc_id) AS BIGINT) AS "end" FROM documents WHERE length(text) > 0)""")
def string_offsets(spark, sf):
    return stringsets.offsets(document_set(spark, sf))


@query(f"""WITH {EVENTS}, b AS (SELECT idx, v // 10 AS value, lag(v // 10) OVER (ORDER BY idx) AS p FROM e), g AS (SELECT idx, value, sum(CASE WHEN p IS DISTINCT FROM value THEN 1 ELSE 0 END) OVER (ORDER BY idx) AS g FROM b)
    SELECT CAST(value AS BIGINT) AS value, min(idx) AS "begin", max(idx) + 1 AS "end" FROM g GROUP BY g, value""")
def equal_runs(spark, sf):
    return stringsets.equal_runs(event_values(spark, sf).select("idx", F.floor(F.col("v") / 10).cast("long").alias("value")))


@query("""SELECT CAST(p_partkey * 3 + i AS BIGINT) AS pattern_id, CAST(p_partkey AS BIGINT) AS str_id, substr(p_name, CAST((p_partkey * 7919 + i * 104729) % (length(p_name) - 3) + 1 AS BIGINT), 4) AS pattern FROM part, range(0, 3) r(i) WHERE length(p_name) >= 4""")
def mk_patterns(spark, sf):
    return text.substring_patterns(part_set(spark, sf), 3, 4)


@query(f"WITH {PART_LCP} SELECT rank, str_id, pos, lcp FROM l")
def index_round_trip(spark, sf):
    """Suffix array and common prefixes of the part set, written, read back with the size check, and joined."""
    index = S.suffix_array(part_set(spark, sf))
    lcp = settle(S.lcp_array(index), "lcp")
    path = scratch(spark, "index")
    store.write_index(path, sa=index.sa, lcp=lcp.select("rank", "lcp"))
    back = store.read_index(spark, path, "sa", "lcp")
    return back["sa"].join(back["lcp"], "rank").select("rank", "str_id", "pos", "lcp")


@query(f"WITH {EVENTS} SELECT idx, v FROM e")
def native_array_round_trip(spark, sf):
    path = scratch(spark, "native")
    store.write_native(event_values(spark, sf), path)
    return store.read_native(spark, path)
