import pytest
from platlens.sources import io


def test_csv_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("007", 'say "so"\nand go'), ("8", " ")], "id string, text string")
    io.write_csv(df, f"{tmp_path}/c")
    assert [tuple(r) for r in io.read_csv(spark, f"{tmp_path}/c", "id string, text string", ["id", "text"], "text").collect()] == [("007", 'say "so"\nand go')]
    log = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "schema_version int, k string")
    io.append_jsonl(log, f"{tmp_path}/l", "k")
    io.append_jsonl(log, f"{tmp_path}/l", "k")
    (tmp_path / "l" / "part-x.json").write_text('{"schema_version": 1, "k": "tru')
    assert sorted(r.k for r in io.read_jsonl(spark, f"{tmp_path}/l", "schema_version int, k string", 1).collect()) == ["a", "b"]


def test_cache_upsert_and_register(spark, tmp_path):
    df = spark.createDataFrame([("us", 1), ("br", 2)], "corpus string, v int")
    calls = []
    build = lambda: calls.append(1) or df
    assert io.cached(spark, f"{tmp_path}/p", build).count() == 2 and io.cached(spark, f"{tmp_path}/p", build).count() == 2 and len(calls) == 1
    io.upsert_table(df, f"{tmp_path}/u", ["corpus"])
    io.upsert_table(spark.createDataFrame([("br", 5), ("xx", 6)], "corpus string, v int"), f"{tmp_path}/u", ["corpus"])
    assert {r.corpus: r.v for r in spark.read.parquet(f"{tmp_path}/u").collect()} == {"us": 1, "br": 5, "xx": 6}
    assert io.content_key(df, "corpus") == io.content_key(df.orderBy("v"), "corpus") != io.content_key(df.limit(1), "corpus")
    io.register_time(spark, f"{tmp_path}/r", "fit", "us", "sweep", 1.5, n_docs=3)
    io.register_time(spark, f"{tmp_path}/r", "fit", "br", "sweep", 2.5)
    assert spark.read.parquet(f"{tmp_path}/r").count() == 2
    m = spark.createDataFrame([("a", [0.0, 2.0])], "k string, v array<double>")
    assert [tuple(r) for r in io.vectors_to_rows(m, "k", "v").collect()] == [("a", 1, 2.0)]


def test_feather_files_by_column(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import feather

    for k in range(3):
        feather.write_feather(pa.table({"id": [10 * k, 10 * k + 1], "text": ["a", None], "other": [1.0, 2.0], **({"n": pa.array([1, 2], pa.int32())} if k else {})}), f"{tmp_path}/{k}.feather", compression="uncompressed")
    got = io.read_feather(spark, [f"{tmp_path}/{k}.feather" for k in range(3)], "id bigint, text string, n bigint, other double", ["id", "n", "text"])
    assert got.columns == ["id", "text", "n"] and sorted(map(tuple, got.collect())) == [(0, "a", None), (1, None, None), (10, "a", 1), (11, None, 2), (20, "a", 1), (21, None, 2)]


def test_an_unfinished_bundle_is_none(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    df.write.parquet(f"{tmp_path}/b/cells")
    with pytest.raises(FileNotFoundError):
        io.read_bundle(spark, f"{tmp_path}/b")
    io.write_bundle(f"{tmp_path}/b", {"cells": df}, level="micro", documents=1)
    tables, meta = io.read_bundle(spark, f"{tmp_path}/b")
    assert tables["cells"].count() == 1 and meta == {"level": "micro", "documents": "1"}
