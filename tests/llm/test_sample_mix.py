import random
from collections import Counter

import pytest
from platlens.llm import queries
from platlens.llm.mixing import SourceMix, TokenCounter
from platlens.llm.quota_sample import TargetSample, seats

POOL = "sid string, dimension string, stance string, k int, rank string"
TARGETS = "dimension string, stance string, target_permille int, min_rows int"


def by_priority(cells, size):
    """Seats by writing every priority down."""
    order = []
    for i, (n, floor, target) in enumerate(cells):
        for rank in range(1, n + 1):
            order.append(((0, 0) if rank <= floor else (1, (rank - 0.5) / target if target else float("inf")), i, rank))
    order = [o for o in sorted(order) if o[0][1] != float("inf")]
    got = Counter(i for _, i, _ in order[:size])
    return [got[i] for i in range(len(cells))]


@pytest.mark.parametrize("seed", range(25))
def test_seats_equal_the_smallest_priorities(seed):
    r = random.Random(seed)
    cells = [(r.randint(0, 60), r.randint(0, 4), float(r.choice([0, 10, 20, 20, 70, 300]))) for _ in range(r.randint(1, 12))]
    size = r.randint(sum(min(n, f) for n, f, _ in cells), 200)
    assert seats(cells, size) == by_priority(cells, size)


def test_seats_below_the_floors():
    assert sum(seats([(10, 5, 1.0), (10, 5, 1.0)], 6)) == 6


def test_sample_and_report(spark):
    rows = [(f"s{i:04}", " Economy\t" if i % 2 else "economy", ["Left", "right "][i % 3 == 0], i, "x") for i in range(400)]
    rows += [rows[0], ("n1", None, "left", 1, ""), ("n2", "economy", None, 1, ""), (None, "economy", "left", 1, ""), ("o1", "other", "left", 1, "")]
    targets = [("Economy", "Left", 700, 2), ("Economy", "Right", 200, 5), ("Order", "Left", 100, 3), ("Economy", None, 5, 5)]
    s = TargetSample(spark.createDataFrame(rows, POOL), spark.createDataFrame(targets, TARGETS))
    rep = {(r.dimension, r.stance): r for r in s.report().collect()}
    got = s.rows().collect()
    assert s.size == 401 // 4 == len(got) == len({r.sid for r in got})
    assert Counter((r.dimension, r.stance) for r in got) == {k: r.drawn for k, r in rep.items() if r.drawn}
    assert rep["Order", "Left"].short and rep["Order", "Left"].required == 10 and not rep["Economy", "Left"].short
    assert sorted(r["rank"] for r in got if r.stance == "Right") == list(range(1, rep["Economy", "Right"].drawn + 1))
    assert [r.sid for r in s.rows().orderBy("sid").collect()] == sorted(r.sid for r in got)


def test_sample_of_nothing(spark):
    s = TargetSample(spark.createDataFrame([], POOL), spark.createDataFrame([("a", "b", 10, 1)], TARGETS))
    assert s.rows().count() == 0 and s.report().first().short
    assert TargetSample(spark.createDataFrame([], POOL), spark.createDataFrame([], TARGETS)).report().count() == 0


DOCS = "doc_id bigint, text string, source string, slot int"


def docs(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["word"] * r.randint(1, 60)), r.choice(["Big ", "big", "BIG", "small"]) if i % 20 else "tiny", 1) for i in range(400)]
    rows += [(1000, None, "big", 1), (1001, " ", "big", 1), (1002, "word", None, 1), (1003, "word", "unlisted", 1), (7, "word word", "tiny", 1), (2000, "word " * 30_000, "small", 1)]
    return spark.createDataFrame(rows, DOCS)


MIX = [("Big", 500, 3), ("small", 300, 1), ("tiny", 150, 2), ("absent", 50, 5)]


def test_mix_fills_slots_with_whole_streams(spark):
    m = SourceMix(docs(spark), spark.createDataFrame(MIX, "source string, target_permille int, max_repeat int"), tokenizer=None, block=64)
    rep = {r.source: r for r in m.report().collect()}
    rows = m.mix().collect()
    assert rep["absent"].short and rep["tiny"].short and not rep["small"].short
    for s, r in rep.items():
        own = [x for x in rows if x.source == s]
        assert sum(x.to_token - x.from_token for x in own) == r.reached_size <= r.available * r.max_repeat
        assert len({x.slot for x in own}) == r.filled_slots
        assert all((x["pass"] < r.max_repeat) for x in own)
    total = sum(r.available for r in rep.values())
    assert abs(rep["small"].slots * 64 - 0.3 * total) <= 3 * 64
    first = Counter(x.source for x in rows if x.slot < 100)
    assert first["small"] and abs(len({x.slot for x in rows if x.slot < 100 and x.source == "small"}) - 30) <= 2
    once = [x for x in rows if x.source == "tiny" and x["pass"] == 0]
    assert sum(x.to_token - x.from_token for x in once) == rep["tiny"].available


def test_mix_of_nothing(spark):
    t = spark.createDataFrame(MIX, "source string, target_permille int, max_repeat int")
    m = SourceMix(spark.createDataFrame([], DOCS), t, tokenizer=None)
    assert m.mix().count() == 0 and m.report().count() == 4
    assert SourceMix(docs(spark), t.limit(0), tokenizer=None).report().count() == 0


def test_token_counter_without_file(spark):
    assert TokenCounter(None)("two words") == 2 and TokenCounter(None)("") == 0
    with pytest.raises(FileNotFoundError):  # never some texts in tokens and others in pieces between white space
        SourceMix(docs(spark), spark.createDataFrame(MIX, "source string, target_permille int, max_repeat int"), tokenizer="/nowhere")


def test_mix_queries_without_vocabulary(spark, sf_dir, monkeypatch):
    """A missing vocabulary is an error, pieces are counted only on demand, and a name that is empty is no demand."""
    monkeypatch.setattr(queries, "TOKENIZER", "/nowhere")
    for query in (queries.p9_found, queries.p9_report, queries.p9_mix):
        with pytest.raises(FileNotFoundError):
            query(spark, sf_dir)
    try:
        spark.conf.set("spark.platlens.tokenizer", "")
        with pytest.raises(FileNotFoundError):
            queries.p9_found(spark, sf_dir)
        spark.conf.set("spark.platlens.tokenizer", "none")
        pieces = queries.p9_report_pieces(spark, sf_dir)
        assert queries.p9_report(spark, sf_dir).select(pieces.columns).collect() == pieces.collect()
        assert queries.p9_found(spark, sf_dir).collect() == pieces.where("short").select("source").collect()
    finally:
        spark.conf.unset("spark.platlens.tokenizer")
