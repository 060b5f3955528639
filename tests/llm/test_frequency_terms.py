import math
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from platlens.llm import frequency
from platlens.llm.distinct_terms import term_distinctiveness, top_terms
from platlens.llm.frequency import term_frequencies

SCHEMA = "doc_id string, tokens string, term string, df int"


def brute(rows):
    tf, docs = Counter(), defaultdict(set)
    for d, t in {(r[0], r[1]) for r in rows if r[1] is not None}:
        for w in unicodedata.normalize("NFC", t).lower().split():
            if w != "eos":
                tf[w] += 1
                docs[w].add(d)
    return {w: (n, len(docs[w])) for w, n in tf.items()}


@pytest.mark.parametrize("heavy", [0.5, 0.0005])
def test_counts_are_exact_whatever_is_heavy(spark, heavy):
    rows = [(f"d{i}", "a b eos A " + " ".join(f"w{i}_{j}" for j in range(5)), "x", 1) for i in range(40)]
    rows += [("d1", "é é a", "x", 1), ("d1", "é é a", "x", 2), (None, "a z", "x", 1), ("d9", None, "x", 1), ("d8", "  \t ", "x", 1), ("d7", "long " * 20000, "x", 1)]
    got = {r.term: (r.tf, r.df) for r in term_frequencies(spark.createDataFrame(rows, SCHEMA), heavy_share=heavy).collect()}
    assert got == brute(rows)


def test_marks_and_hot_document(spark):
    rows = [("hot", f"eos common x{i}", None, None) for i in range(300)] + [(f"d{i}", "common mid", None, None) for i in range(10)] + [("e", "mid", None, None)]
    got = {r.term: (r.mark, r.docs) for r in term_frequencies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["common"] == ("common", 12) and got["mid"][0] == "common" and got["x5"][0] == "rare" and "eos" not in got


def test_empty_table(spark):
    assert term_frequencies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_more_heavy_terms_than_places(spark, monkeypatch):
    monkeypatch.setattr(frequency, "HEAVY_MOST", 3)
    rows = [(f"d{i}", "a b c d e f", None, None) for i in range(5)]
    got = {r.term: (r.tf, r.df) for r in term_frequencies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {w: (5, 5) for w in "abcdef"}


def test_distinctiveness_against_arithmetic(spark):
    rows = [(1, "d1", "Taxes taxes and roads", 1), (1, "d2", "roads", 1), (2, "d3", "rivers and roads", 1), (2, "d3", "rivers", 2), (None, "d4", "roads", 1), (2, None, "roads", 1), (2, "d5", None, 1), (2, "d6", "", 1), (1, "d1", "Taxes taxes and roads", 9)]
    out = {(r.topic, r.term): r for r in term_distinctiveness(spark.createDataFrame(rows, "topic int, doc_id string, chunk_text string, term int")).collect()}
    assert out[1, "taxes"].documents == 1 and out[1, "taxes"].documents_total == 4 and out[2, "rivers"].documents_all == 1
    assert out[1, "taxes"].weight == round(math.log(4), 6)
    e = 2 * 3 / 4
    assert out[1, "roads"].residual == pytest.approx((2 - e) / math.sqrt(e))
    assert out[1, "roads"].adjusted == pytest.approx((2 - e) / math.sqrt(e * (1 - 2 / 4) * (1 - 3 / 4)))


def test_top_terms_ties_and_empty(spark):
    rows = [(1, f"d{i}", "bb aaa ccc ddd eee fff ggg") for i in range(2)] + [(2, "x", "zzz")]
    s = term_distinctiveness(spark.createDataFrame(rows, "topic int, doc_id string, chunk_text string"))
    assert [r.term for r in top_terms(s).where("topic = 1").orderBy("rank").collect()] == ["aaa", "ccc", "ddd", "eee", "fff"]
    empty = term_distinctiveness(spark.createDataFrame([], "topic int, doc_id string, chunk_text string"))
    assert top_terms(empty).count() == 0


def test_terms_are_longest_runs_of_letters():
    assert [w for w in re.findall(r"[^\W\d_]+", "ab1cde") if len(w) > 2] == ["cde"]
