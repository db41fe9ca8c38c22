import random
import struct

import pytest
from brute import suffix_rows

from lexispark.__main__ import main
from lexispark.operators import search
from lexispark.plans.index import TextIndex
from lexispark.sources import text


def test_stored_index(spark, tmp_path):
    strings = spark.createDataFrame([(0, "mississippi"), (1, "miss")], "str_id long, text string")
    TextIndex.build(strings, k=2, budget=20).save(f"file://{tmp_path}/i")
    index = TextIndex.load(spark, f"file://{tmp_path}/i")
    assert index.q == 2
    patterns = text.patterns_from(spark, ["miss", "ss", "zz"])
    assert {(r["pattern_id"], r["str_id"], r["pos"]) for r in index.places(patterns).collect()} == {(0, 0, 0), (0, 1, 0), (1, 0, 2), (1, 0, 5), (1, 1, 2)}


@pytest.mark.parametrize("budget", [1, 1 << 20])
def test_search_equals_brute_force(spark, monkeypatch, budget):
    """Patterns within and beyond blocks, present and absent, against a direct count; few probes, so that there are rounds."""
    monkeypatch.setattr(search, "FAN", 8)
    r = random.Random(9)
    texts = ["".join(r.choice("abc") for _ in range(900)), "ab" * 300, "", "é" * 70 + "\U0001f600x", "cab"]
    index = TextIndex.build(spark.createDataFrame(list(enumerate(texts)), "str_id long, text string"), budget=budget)
    assert index.text.size < 600
    rows = suffix_rows([(i, t) for i, t in enumerate(texts)])
    wanted = ["a", "ab", "abab" * 40, "ab" * 300, "ab" * 300 + "c", "zz", "é" * 70 + "\U0001f600", "é\U0001f600y", "\U0001f600", texts[0][100:700], texts[0][5:69], texts[0][50:80] + "z", "cabb", "b" * 30]
    patterns = spark.createDataFrame(list(enumerate(wanted)), "pattern_id long, pattern string")
    got = {x["pattern_id"]: (x["l"], x["r"]) for x in index.locate(patterns).collect()}
    for i, p in enumerate(wanted):
        less, hits = sum(x[3] < p for x in rows), sum(x[3].startswith(p) for x in rows)
        assert got[i] == (less, less + hits), p
    if budget == 1:
        return
    whole = {x["pattern_id"]: (x["l"], x["r"]) for x in search.locate_sa(index.text, index.order, patterns).collect()}
    assert whole == got
    loose = {x["pattern_id"]: (x["l"], x["r"]) for x in index.locate_possible(patterns).collect()}
    assert all(loose[i][0] <= got[i][0] <= got[i][1] <= loose[i][1] for i in got)


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "t").write_text("abracadabra")
    (tmp_path / "p").write_text("abra\nxyz\n")
    (tmp_path / "n").write_bytes(struct.pack("=3Q", 5, 6, 7))
    at = f"file://{tmp_path}"
    main(["build", "-f", f"{at}/t", "-k", "2", "-l", "-t", "-c", "-o", f"{at}/index"], spark)
    main(["locate", "-l", f"{at}/index", "-q", f"{at}/p"], spark)
    main(["kmer-stats", "-r", "500", "-k", "2"], spark)
    main(["make-patterns", "-f", f"{at}/t", "3", "4", f"{at}/made"], spark)
    main(["dump", "-f", f"{at}/n"], spark)
    out = capsys.readouterr().out
    assert "suffix array of 11 symbols" in out and "2 patterns, 1 found" in out and "5\n6\n7" in out
    assert spark.read.text(f"{at}/made").count() == 3
