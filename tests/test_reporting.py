import math

import numpy as np
import pytest
from platlens.functions import scalars as fn
from platlens.operators import classify, embedding, frames, sampling, tokens, vectors
from platlens.plans import lineage
from platlens.sources import io
from pyspark.sql import functions as F


def test_places_in_a_total_order(spark):
    df = spark.createDataFrame([(i * 7 % 101, i % 3, "x") for i in range(101)] + [(None, 1, "y")], "k int, n bigint, __range string")
    got = {r.k: r.place for r in lineage.numbered(df.drop("__range"), [F.col("k").isNull(), "k"], "place").collect()}
    assert got == {**{k: k for k in range(101)}, None: 101}
    sums = {r.k: r.before for r in lineage.numbered(df.drop("__range").where("k is not null"), ["k"], "before", "n").collect()}
    n = {i * 7 % 101: i % 3 for i in range(101)}
    assert sums == {k: sum(n[j] for j in range(k)) for k in range(101)}
    assert lineage.numbered(df.drop("__range").limit(0), ["k"], "place").count() == 0


def test_oversampling_of_a_hot_class(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(90)] + [(i, "cold") for i in range(100, 107)], "id int, c string")
    got = sampling.oversample(df, "c", "id").groupBy("c").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.max("copy").alias("m")).collect()
    assert {r.c: (r.n, r.d) for r in got} == {"hot": (90, 90), "cold": (90, 7)} and max(r.m for r in got) == 12


def test_small_tables(spark):
    df = spark.createDataFrame([(" a ", "1"), ("b", None), (None, None)], " topic string, `code ` string")
    got = io.with_required(df, ["topic", "code"], "topic")
    assert got.columns == ["topic", "code"] and {tuple(r) for r in got.collect()} == {("a", "1"), ("b", None)}
    with pytest.raises(ValueError, match="missing columns: label"):
        io.with_required(df, ["label"])
    with pytest.raises(ValueError, match="repeated topic: a"):
        io.with_required(spark.createDataFrame([("a",), (" a",)], "topic string"), [], "topic")


def test_matrix_there_and_back(spark):
    df = spark.createDataFrame([(1, [0.0, 2.0, 0.0]), (2, [1.0, 0.0, 3.0])], "k int, v array<double>")
    back = {r.k: r.vector for r in io.rows_to_vectors(io.vectors_to_rows(df, "k", "v"), "k", 3).collect()}
    assert back == {1: [0, 2, 0], 2: [1, 0, 3]}


def test_register_of_times(spark, tmp_path):
    for s in (1.5, 2.0):
        io.register_time(spark, str(tmp_path / "times"), "fit", "us", "all", s, n_docs=3)
    assert [tuple(r) for r in io.read_times(spark, str(tmp_path / "times")).collect()] == [("fit", "us", 2, 3.5, 3)]


def test_renderers(spark):
    df = spark.createDataFrame([("a|b & c_d", 1.5), (None, None)], "name string, value double")
    assert frames.markdown(df) == "| name | value |\n| --- | --- |\n| a\\|b & c_d | 1.5 |\n|  |  |"
    assert frames.latex(df) == "name & value \\\\\na|b \\& c\\_d & 1.5 \\\\\n &  \\\\"
    assert frames.macros(df.limit(1), "name", "value", "x") == "\\newcommand{\\xABCD}{1.5}"
    with pytest.raises(ValueError):
        frames.markdown(spark.range(5), most=3)


def test_coverage_and_frames_without_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    with pytest.raises(ValueError, match="rows without a match: 2"):
        frames.assert_covered(df, df.where("k = 1"), "k")
    assert frames.assert_covered(df, df, "k") is df
    none = spark.createDataFrame([], "g string, x double")
    assert frames.within_between(none, "g", "x").first().within is None and frames.imbalance(none, "g").first().ratio is None
    assert frames.residual_sd_of_square(none, "x").first().n == 0 and frames.notable(none.withColumn("k", F.lit(1)), "k", "x").count() == 0


def test_residual_deviation(spark):
    x = np.random.default_rng(1).normal(size=500)
    a = np.c_[np.ones(500), x]
    left = x**2 - a @ np.linalg.lstsq(a, x**2, rcond=None)[0]
    assert frames.residual_sd_of_square(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first().sd == pytest.approx(left.std())


def test_bessel_and_hms(spark):
    r = spark.createDataFrame([(0.0, 59.9), (3.0, 3661.0), (-12.0, 0.0)], "x double, s double").select(fn.bessel_i0(F.col("x")).alias("b"), fn.hms(F.col("s")).alias("t")).collect()
    assert [x.b for x in r] == pytest.approx([float(np.i0(v)) for v in (0, 3, 12)], rel=1e-9) and [x.t for x in r] == ["0:00:59", "1:01:01", "0:00:00"]
    e = spark.createDataFrame([("x", 1), (None, 2)], "e string, i int")
    assert [x.c for x in e.orderBy("i").select(fn.failure_class(F.col("e")).alias("c")).collect()] == ["other", None]


def test_calls_are_tried_again_and_lost_batches_stay_pending(spark):
    c = spark.createDataFrame([(f"k{i:02}", f"text {i}") for i in range(30)], "chunk_id string, chunk_text string")
    m = classify.manifest(c, "chunk_id", "chunk_text", size=10).cache()

    def shaky(texts):
        import random

        if "text 0" in texts:
            raise RuntimeError("always")
        if random.random() < 0.3:
            raise RuntimeError("now and then")
        return classify.fake_client(texts)

    log = classify.read_log(lineage.cut(classify.answer(m, shaky, "p", workers=3, tries=12, wait=0.0)), "p")
    assert log.count() == 2 and [r.batch_id for r in classify.pending(m, log).collect()] == ["r000"]
    short = classify.answer(m, lambda texts: classify.fake_client(texts)[1:], "p", tries=1)
    assert short.count() == 0


def test_encoding_goes_on_where_it_stopped(spark, tmp_path):
    df = spark.createDataFrame([(i, f"w{i % 5} some words") for i in range(40)] + [(99, None), (98, " ")], "id int, text string")
    calls = spark.sparkContext.accumulator(0)

    def encoder(texts):
        calls.add(len(texts))
        return embedding.hashing_encoder(texts)

    at = str(tmp_path / "v")
    assert embedding.embed_in_blocks(df, "id", "text", at, encoder, blocks=4).count() == 40
    first = calls.value
    assert embedding.embed_in_blocks(df, "id", "text", at, encoder, blocks=4).count() == 40 and calls.value == first
    v = {r.id: r.vector for r in spark.read.parquet(at).collect()}
    assert v[0] == v[5] and v[0] != v[1] and math.isclose(sum(x * x for x in v[0]), 1, rel_tol=1e-5)


def test_topic_names_that_collide(spark):
    k = spark.createDataFrame([(1, ["tax", "rate"]), (2, ["tax", "cut"]), (3, ["Tax ", "law"]), (4, ["road"])], "topic int, keywords array<string>")
    named = {t: n for t, n, _ in embedding.name_topics(k, lambda t, words, taken: words[0])}
    assert named == {1: "tax", 2: "tax cut", 3: "Tax law", 4: "road"}
    asked = {t: n for t, n, _ in embedding.name_topics(k, lambda t, words, taken: words[1] if words[0] in taken and len(words) > 1 else words[0])}
    assert asked[2] == "cut" and len({n.casefold() for n in asked.values()}) == 4


def test_nearest_rows_break_ties_by_key(spark):
    rows = [(i, [1.0, 0.0]) for i in range(20)] + [(i, [0.0, 1.0]) for i in range(20, 30)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(5)
    got = vectors.knn(df.where("id = 7"), df, "id", "v", 5).orderBy("rank").collect()
    assert [r.neighbour for r in got] == [0, 1, 2, 3, 4]


def test_negations_stay(spark):
    r = spark.createDataFrame([("Sem o povo não há nada",)], "t string").select(tokens.tokenise(F.col("t"), ["sem", "não", "povo"]).alias("w")).first()
    assert r.w == ["sem", "não", "há", "nada"]


def test_meta_columns_of_chunks(spark):
    from platlens.operators import segment

    df = spark.createDataFrame([("d", "One sentence of five words. Another sentence of five words.", "north", 3), ("e", " ", "south", 4)], "doc_id string, text string, region string, n int")
    got = segment.chunk_documents(df, meta=("region", "n")).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.region, r.n) for r in got] == [("d#s0", "north", 3), ("d#s1", "north", 3)]
