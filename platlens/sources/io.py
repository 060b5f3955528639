"""Sources and sinks: explicit schemas, tolerant logs, cached and upserted tables, a register of run times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import upsert
from ..plans.lineage import exists


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, text: str | None = None) -> DataFrame:
    """A CSV with header and quoted line breaks under a given schema (ids stay text); rows whose `text` is blank are left out."""
    df = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', quote='"').csv(path)
    if text:
        df = df.where(F.col(text).rlike(r"[^\s\p{Z}]"))
    return df.select(*columns) if columns else df


def with_required(df: DataFrame, required: list[str], key: str | None = None) -> DataFrame:
    """A small table (crosswalk, codebook) under its trimmed column names, of which `required` must be there and `key` must
    not repeat; texts are trimmed, rows without any value left out. What is wrong is an error that names it."""
    named = df.select(*(F.trim(F.col(f"`{c}`")).alias(c.strip()) if t == "string" else F.col(f"`{c}`").alias(c.strip()) for c, t in df.dtypes))
    missing = [c for c in required if c not in named.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    named = named.na.drop("all")
    if key and (twice := named.groupBy(key).count().where("count > 1").limit(5).collect()):
        raise ValueError(f"repeated {key}: {', '.join(str(r[key]) for r in twice)}")
    return named


def read_columns(spark: SparkSession, path: str, columns: list[str], form: str = "parquet") -> DataFrame:
    """Some columns of a parquet or ORC table; only they are read."""
    return spark.read.format(form).load(path).select(*columns)


def read_feather(spark: SparkSession, paths: list[str], schema: str, columns: list[str] | None = None) -> DataFrame:
    """Some columns of Arrow (feather) files that all executors see: one task a file, batch by batch, other columns unread.
    A column that a file lacks is null; one of another type is cast."""
    wanted = T.StructType([f for f in T.StructType.fromDDL(schema) if columns is None or f.name in columns])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(wanted)
        for b in batches:
            for path in b.column(0).to_pylist():
                with pa.memory_map(path) as f:
                    reader = pa.ipc.open_file(f)
                    here = [reader.schema.get_field_index(n) for n in arrow.names]
                    reader = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=sorted(i for i in here if i >= 0)))
                    for k in range(reader.num_record_batches):
                        own = reader.get_batch(k)
                        cells = [own.column(n).cast(t) if n in own.schema.names else pa.nulls(own.num_rows, t) for n, t in zip(arrow.names, arrow.types)]
                        yield pa.RecordBatch.from_arrays(cells, schema=arrow)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(run, wanted)


def write_bundle(path: str, tables: dict[str, DataFrame], **meta) -> None:
    """Tables that belong together, with a row of what is to be known of them, written last: without it there is no bundle."""
    first = next(iter(tables.values()))
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    rows = [(k, str(v)) for k, v in sorted({**meta, "tables": ",".join(sorted(tables))}.items())]
    first.sparkSession.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta_of_bundle")


def read_bundle(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    if not exists(spark, f"{path}/meta_of_bundle"):
        raise FileNotFoundError(f"no complete bundle at {path}")
    meta = {r.key: r.value for r in spark.read.parquet(f"{path}/meta_of_bundle").limit(10_000).collect()}
    return {n: spark.read.parquet(f"{path}/{n}") for n in meta.pop("tables").split(",")}, meta


def read_jsonl(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """Records of a JSON-lines log; a truncated line is skipped, as are records of another schema version."""
    fields = T.StructType.fromDDL(schema)
    df = spark.read.schema(fields.add("_broken", T.StringType())).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    first = [f for f in fields.fieldNames() if f != "_broken"]
    df = df.select(*first, "_broken").where("_broken is null").drop("_broken")
    return df if version is None else df.where(F.col("schema_version") == version)


def append_jsonl(df: DataFrame, path: str, key: str) -> None:
    """Rows appended to a JSON-lines log, without those whose key it already has: repeating an append changes nothing."""
    if exists(df.sparkSession, path):
        df = df.join(df.sparkSession.read.schema(df.schema).json(path).select(key).distinct(), key, "left_anti")
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """A CSV with one header a file."""
    df.write.mode("append" if append else "overwrite").options(header=True, quoteAll=True, escape='"').csv(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path, built and written first if it isn't there yet or `force` is set."""
    if force or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def content_key(df: DataFrame, column: str) -> str:
    """A key of a column's set of values, in any order: a cache under it is found again only for the same set."""
    r = df.select(column).distinct().agg(F.count("*").alias("n"), F.sum(F.xxhash64(column).cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(column, F.lit(1))).alias("b")).first()
    return f"{r.n:x}-{int(r.a or 0) % 2**64:016x}-{(r.b or 0) % 2**64:016x}"


def upsert_table(new: DataFrame, path: str, key: list[str]) -> None:
    """The table at path with the rows of re-run keys replaced. The new version is written beside the old one and takes its
    place when it is complete, so a failure leaves the old one."""
    spark = new.sparkSession
    if not exists(spark, path):
        new.write.parquet(path)
        return
    upsert(spark.read.parquet(path), new, key).write.mode("overwrite").parquet(path + ".new")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.rename(p(path), p(path + ".old"))
    fs.rename(p(path + ".new"), p(path))
    fs.delete(p(path + ".old"), True)


def register_time(spark: SparkSession, path: str, stage: str, corpus: str, step: str, seconds: float, n_docs: int | None = None, n_chunks: int | None = None, note: str = "") -> None:
    """One more row in the register of run times."""
    row = [(stage, corpus, step, float(seconds), n_docs, n_chunks, note)]
    df = spark.createDataFrame(row, "stage string, corpus string, step string, seconds double, n_docs bigint, n_chunks bigint, note string")
    df.withColumn("run_started", F.current_timestamp()).write.mode("append").parquet(path)


def rows_to_vectors(cells: DataFrame, key: str, size: int) -> DataFrame:
    """(key, vector) of cells (key, i, value): zeros where there is none. The way back from vectors_to_rows."""
    m = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("m"))
    return m.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector"))


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """Total seconds and runs by stage and corpus of a register of run times."""
    return spark.read.parquet(path).groupBy("stage", "corpus").agg(F.count("*").alias("runs"), F.round(F.sum("seconds"), 3).alias("seconds"), F.max("n_docs").alias("n_docs"))


def vectors_to_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """A matrix as (key, i, value) cells without its zeros, the sparse form of all matrices here."""
    return df.select(key, F.posexplode(vector).alias("i", "value")).where("value <> 0")
