"""External classification of batches: manifest, checkpoint log, resume, validation, cost.

The client is any function from a list of texts to a list of answers; tests use a deterministic one. Batches are
identified by the hash of what is in them, so a batch that was answered is never sent again, and a run can stop anywhere.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import exists
from .sampling import batches

SCHEMA_VERSION = 1


def manifest(df: DataFrame, key: str, text: str, size: int = 50) -> DataFrame:
    """batch_id, chunk_sha256, keys, texts: batches of `size` consecutive keys with the hash of keys and texts."""
    b = batches(df.select(key, text).distinct(), key, size)
    g = b.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")))).alias("items"))
    joined = F.array_join(F.transform("items", lambda i: F.concat_ws("\x1f", i["k"].cast("string"), i["t"])), "\x1e")
    return g.select(F.format_string("r%03d", "batch").alias("batch_id"), F.sha2(joined, 256).alias("chunk_sha256"), F.col("items.k").alias("keys"), F.col("items.t").alias("texts"))


def read_log(lines: DataFrame, prompt_sha256: str, value: str = "value") -> DataFrame:
    """Valid records of a JSON-lines checkpoint: truncated lines, other schema versions and other prompts are skipped; of
    several records of a batch the last created counts."""
    schema = "schema_version int, batch_id string, prompt_sha256 string, chunk_sha256 string, items array<struct<id:bigint,score:int,political:boolean>>, created_at string"
    r = lines.select(F.from_json(value, schema, {"mode": "PERMISSIVE"}).alias("r")).where("r.batch_id is not null and r.items is not null").select("r.*")
    r = r.where((F.col("schema_version") == SCHEMA_VERSION) & (F.col("prompt_sha256") == prompt_sha256))
    return r.groupBy("batch_id", "chunk_sha256").agg(F.max_by("items", F.struct("created_at", F.to_json("items"))).alias("items"), F.max("created_at").alias("created_at"))


def pending(batch_table: DataFrame, log: DataFrame) -> DataFrame:
    """Batches of which the log has no answer for the same content."""
    return batch_table.join(log.select("batch_id", "chunk_sha256"), ["batch_id", "chunk_sha256"], "left_anti")


def record(batch_id: str, sha: str, prompt_sha256: str, answers: list[dict], at: str | None = None) -> str:
    """One line of the checkpoint."""
    items = [{"id": i, **a} for i, a in enumerate(answers)]
    return json.dumps({"schema_version": SCHEMA_VERSION, "batch_id": batch_id, "prompt_sha256": prompt_sha256, "chunk_sha256": sha, "items": items, "created_at": at or datetime.now(UTC).isoformat()})


def answer(batch_table: DataFrame, client: Callable[[list[str]], list[dict]], prompt_sha256: str, workers: int = 4, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """Checkpoint lines (value) of batches sent to the client, one call a batch, on the executors; each task has `workers`
    calls under way. A call that fails is tried again, after waits that double; a batch that fails `tries` times gives no
    line and stays pending. A client's answers that do not match its texts in number count as a failure."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def call(batch_id: str, sha: str, texts: list[str]) -> str | None:
            for k in range(tries):
                try:
                    answers = client(list(texts))
                    if len(answers) == len(texts):
                        return record(batch_id, sha, prompt_sha256, answers)
                except Exception as e:  # noqa: BLE001  (any failure of a service is one of the batch)
                    logging.getLogger(__name__).warning("batch %s, try %d: %s", batch_id, k + 1, e)
                if k + 1 < tries:
                    time.sleep(wait * 2**k)
            return None

        with ThreadPoolExecutor(workers) as pool:
            for p in parts:
                lines = pool.map(call, p["batch_id"], p["chunk_sha256"], p["texts"])
                yield pd.DataFrame({"value": [x for x in lines if x is not None]}, dtype=object)

    return batch_table.select("batch_id", "chunk_sha256", "texts").mapInPandas(run, "value string")


class Queue:
    """Batches sent to a service that answers within a day, with a ledger that outlives the driver.

    The client has submit(list of (batch_id, texts)) -> job, state(job) -> "running", "done" or "failed", and
    results(job) -> {batch_id: answers}. Jobs are bounded in size, so that what the driver holds is one job. The ledger is
    an append-only table of (job, batch_id, chunk_sha256, state, at); a batch is sent again only if its last job failed.
    """

    def __init__(self, spark: SparkSession, client, ledger: str, log: str, prompt_sha256: str, job_size: int = 100) -> None:
        self.spark, self.client, self.path, self.log_path, self.prompt, self.job_size = spark, client, ledger, log, prompt_sha256, job_size

    def ledger(self) -> DataFrame:
        """The last state of every batch that was ever sent."""
        schema = "job string, batch_id string, chunk_sha256 string, state string, at string"
        rows = self.spark.read.schema(schema).json(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], schema)
        return rows.groupBy("batch_id", "chunk_sha256").agg(F.max_by(F.struct("job", "state"), F.struct("at", "state")).alias("l")).select("batch_id", "chunk_sha256", "l.job", "l.state")

    def log(self) -> DataFrame:
        lines = self.spark.read.text(self.log_path) if exists(self.spark, self.log_path) else self.spark.createDataFrame([], "value string")
        return read_log(lines, self.prompt)

    def _note(self, job: str, batches_of: list[tuple[str, str]], state: str) -> None:
        at = datetime.now(UTC).isoformat()
        rows = [(job, b, h, state, at) for b, h in batches_of]
        self.spark.createDataFrame(rows, "job string, batch_id string, chunk_sha256 string, state string, at string").coalesce(1).write.mode("append").json(self.path)

    def submit(self, batch_table: DataFrame) -> int:
        """Sends what is neither answered nor under way; gives the number of batches sent. What is to be sent is noted before
        it is, so that a driver that dies between the two leaves batches to be looked after, not sent twice."""
        open_ = self.ledger().where("state <> 'failed'").select("batch_id", "chunk_sha256")
        todo = pending(batch_table, self.log()).join(open_, ["batch_id", "chunk_sha256"], "left_anti").orderBy("batch_id")
        sent, held = 0, []
        rows = todo.select("batch_id", "chunk_sha256", "texts").toLocalIterator()
        for r in [*rows, None]:
            if r is not None:
                held.append(r)
            if held and (r is None or len(held) == self.job_size):
                own = [(x.batch_id, x.chunk_sha256) for x in held]
                job = self.client.submit([(x.batch_id, list(x.texts)) for x in held])
                self._note(job, own, "sent")
                sent, held = sent + len(own), []
        return sent

    def harvest(self) -> int:
        """Asks after all jobs under way and writes the answers of those that are done; gives the number of batches answered."""
        under_way = self.ledger().where("state = 'sent'").groupBy("job").agg(F.collect_list(F.struct("batch_id", "chunk_sha256")).alias("own")).orderBy("job")
        got = 0
        for r in under_way.toLocalIterator():  # a job has at most job_size batches
            own = [(x.batch_id, x.chunk_sha256) for x in r.own]
            state = self.client.state(r.job)
            if state == "done":
                answers = self.client.results(r.job)
                lines = [record(b, h, self.prompt, answers[b]) for b, h in own if b in answers]
                self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(self.log_path)
                self._note(r.job, [x for x in own if x[0] in answers], "answered")
                self._note(r.job, [x for x in own if x[0] not in answers], "failed")
                got += len(lines)
            elif state == "failed":
                self._note(r.job, own, "failed")
        return got


class FakeQueue:
    """A service for tests and dry runs: a job is done when it is asked after the second time; the first job fails once."""

    def __init__(self) -> None:
        self.jobs: dict[str, list] = {}
        self.asked: dict[str, int] = {}
        self.sent: list[str] = []

    def submit(self, batches_of: list[tuple[str, list[str]]]) -> str:
        job = f"job{len(self.jobs)}"
        self.jobs[job] = batches_of
        self.sent += [b for b, _ in batches_of]
        return job

    def state(self, job: str) -> str:
        self.asked[job] = self.asked.get(job, 0) + 1
        if job == "job0":
            return "failed"
        return "done" if self.asked[job] > 1 else "running"

    def results(self, job: str) -> dict[str, list[dict]]:
        return {b: fake_client(texts) for b, texts in self.jobs[job]}


def fake_client(texts: list[str]) -> list[dict]:
    """Answers that depend on the text alone, for tests and dry runs."""
    out = []
    for t in texts:
        n = int(hashlib.sha256(t.encode()).hexdigest()[:8], 16)
        out.append({"score": n % 101 if n % 5 else None, "political": bool(n % 5)})
    return out


def run_flags(scores: DataFrame, expected: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row of counts that must all be 0: missing, unknown, repeated, out of range, scored though not political."""
    s, e = scores.distinct(), expected.select(key).distinct()
    repeated = s.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated"))
    missing = e.join(s, key, "left_anti").agg(F.count("*").alias("missing"))
    unknown = s.join(e, key, "left_anti").agg(F.count("*").alias("unknown"))
    rest = s.agg(F.count_if((F.col("score") < 0) | (F.col("score") > 100)).alias("out_of_range"), F.count_if(~F.col("political") & F.col("score").isNotNull()).alias("scored_not_political"))
    return rest.select(missing.scalar().alias("missing"), unknown.scalar().alias("unknown"), repeated.scalar().alias("repeated"), "out_of_range", "scored_not_political")


def cost(tokens_in: Column, tokens_cached: Column, tokens_out: Column, price_in: float, price_cached: float, price_out: float, queued: bool = False) -> Column:
    """Price of token counts at prices per million; the queue costs half."""
    whole = ((tokens_in - tokens_cached) * price_in + tokens_cached * price_cached + tokens_out * price_out) / 1e6
    return whole * (0.5 if queued else 1.0)
