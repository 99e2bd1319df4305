"""Model calls over partitions: concurrent, retried, kept as they arrive, and never failing the job."""

import json
import operator
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from functools import partial
from threading import Lock
from typing import Any
from uuid import uuid4

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from ..functions.fixed import (
    DEFAULT_CONCURRENCY,
    ERROR_PREFIX,
    MAX_CONCURRENCY,
    RETRY_ATTEMPTS,
    RETRY_DELAY_SECONDS,
    SYSTEM_FILE,
)
from ..functions.prompting import estimate_tokens
from ..session import short_batches
from ..sources import storage

# A client takes one row as a dict (with its ``prompt`` and a ``system`` message) and gives the answer's text, or a
# dict with ``text`` and the counts the model reports.
Client = Callable[[dict[str, Any]], "str | dict[str, Any]"]
COUNTS = ["prompt_tokens", "completion_tokens", "reported_tokens"]
ANSWER = ["text", "error", "attempts", *COUNTS]
JOURNAL = "request string, text string, error string, attempts int, prompt_tokens long, completion_tokens long, reported_tokens long"


def with_retry(call: Callable[[], Any], attempts: int = RETRY_ATTEMPTS, delay: float = RETRY_DELAY_SECONDS, sleep=time.sleep) -> tuple[Any, int]:
    """The call's result and the number of tries: one, plus up to ``attempts`` more with doubled waits."""
    tries = 0
    while True:
        tries += 1
        try:
            return call(), tries
        except Exception:
            if tries > attempts:
                raise
            sleep(delay)
            delay *= 2


class TokenBucket:
    """Lets ``rate`` calls a second pass, shared by all threads of a partition; unused time gives at most ``burst`` calls at once."""

    def __init__(self, rate: float, burst: int = 1, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.filled, self.lock = float(burst), clock(), Lock()

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            self.tokens = min(self.burst, self.tokens + (now - self.filled) * self.rate) - 1
            self.filled = now
            wait = -self.tokens / self.rate
        if wait > 0:
            self.sleep(wait)


def _whole(value: Any) -> int | None:
    """A count as the model reports it; None for anything that is not a whole number of 64 bits."""
    try:
        number = operator.index(value)
    except TypeError:
        return None
    return number if not isinstance(value, bool) and -(2**63) <= number < 2**63 else None


def _plain(text: str) -> str:
    """Text that Arrow can carry: lone surrogates become question marks."""
    return text.encode("utf-8", "replace").decode("utf-8")


def read_reply(reply: Any) -> dict[str, Any]:
    """The text and counts of a client's reply; a reply without a text is an error."""
    fields = {"text": reply} if isinstance(reply, str) else reply
    if not isinstance(fields, dict) or not isinstance(fields.get("text"), str):
        raise TypeError(f"the reply has no text: {type(reply).__name__}")
    counts = {"prompt_tokens": "prompt_tokens", "completion_tokens": "completion_tokens", "reported_tokens": "total_tokens"}
    return {"text": _plain(fields["text"]), **{ours: _whole(fields.get(theirs)) for ours, theirs in counts.items()}}


def ask(client: Client, bucket: TokenBucket | None, attempts: int, delay: float, row: dict[str, Any]) -> dict[str, Any]:
    """One row's answer, or its error after the last try."""
    tries = 0

    def call():
        nonlocal tries
        tries += 1
        if bucket is not None:
            bucket.take()
        return read_reply(client(row))

    answer = dict.fromkeys(ANSWER)
    try:
        reply, _ = with_retry(call, attempts, delay)
        answer |= reply
    except Exception as error:
        answer["error"] = _plain(str(error)) or type(error).__name__
    return answer | {"attempts": tries}


class Journal:
    """Answers of one partition, written to files of a shared folder as they arrive.

    A task that runs again reads what the attempts before it have written. Files are only added,
    each is seen whole or not at all.
    """

    def __init__(self, folder: str):
        self.folder, self.known, self.written = folder, {}, 0
        self.attempt = uuid4().hex
        for entry in list(storage.entries(folder)):
            if entry.name.endswith(".json"):
                for line in storage.read_bytes(f"{folder}/{entry.name}").decode("utf-8").splitlines():
                    record = json.loads(line)
                    self.known[record["request"]] = record

    def add(self, records: list[dict[str, Any]]) -> None:
        lines = "\n".join(json.dumps(record) for record in records)
        storage.write_bytes(f"{self.folder}/{self.attempt}-{self.written:06d}.json", lines.encode("utf-8"))
        self.written += 1
        self.known |= {record["request"]: record for record in records}


def _client(factory: Callable[[], Client]) -> Client:
    """The client; when it cannot be built, one that tells why for every row."""
    try:
        return factory()
    except Exception as error:
        told = f"no client: {error}"

        def broken(row: dict[str, Any]) -> str:
            raise RuntimeError(told)

        return broken


def answer_rows(
    batches: Iterator[pd.DataFrame], factory: Callable[[], Client], threads: int, attempts: int, delay: float, system: str, rate: float | None, journal: Journal | None
) -> Iterator[tuple[pd.DataFrame, list[dict[str, Any]]]]:
    """Each batch of rows with its answers, in order; what the journal knows is not asked again."""
    client, bucket = _client(factory), TokenBucket(rate, threads) if rate else None
    call = partial(ask, client, bucket, attempts, delay)
    with ThreadPoolExecutor(threads) as pool:
        for rows in batches:
            requests = rows["_request"].tolist() if journal is not None else [None] * len(rows)
            asked = [{**row, "system": system} for row in rows.drop(columns="_request", errors="ignore").to_dict("records")]
            known = journal.known if journal is not None else {}
            answers = [known.get(request) for request in requests]
            todo = [n for n, answer in enumerate(answers) if answer is None]
            fresh = []
            waiting = {pool.submit(call, asked[n]): n for n in todo}
            for done in as_completed(waiting):
                n = waiting[done]
                answers[n] = {"request": requests[n], **done.result()}
                fresh.append(answers[n])
                if journal is not None and len(fresh) >= threads:  # little is lost with the task
                    journal.add(fresh)
                    fresh = []
            if journal is not None and fresh:
                journal.add(fresh)
            yield rows, answers


def request_id(prompts: DataFrame, system: str):
    """What tells one request from another: the whole row and the system message."""
    return F.sha2(F.concat(F.to_json(F.struct(*[F.col(f"`{c}`") for c in prompts.columns])), F.lit(system)), 256)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """One successful answer per request of all runs below a journal's folder."""
    answers = spark.read.schema(JOURNAL).json(path).filter("error is null and text is not null")
    return answers.groupBy("request").agg(F.max(F.struct(*ANSWER)).alias("answer"))


def infer(
    prompts: DataFrame,
    client_factory: Callable[[], Client],
    batch: int = DEFAULT_CONCURRENCY,
    attempts: int = RETRY_ATTEMPTS,
    delay: float = RETRY_DELAY_SECONDS,
    system: str = SYSTEM_FILE,
    error_prefix: str = ERROR_PREFIX,
    rate: float | None = None,
    journal: str | None = None,
) -> DataFrame:
    """Answer the ``prompt`` of every row.

    The client is built once per partition and called by up to ``batch`` threads, at most
    ten, and at most ``rate`` times a second. A row whose call fails for good gets an error text and the reason
    in ``error``; so does a row whose reply has no text, and every row when the client cannot be built.
    Give only the columns worth sending to Python, and spread the rows over as many
    partitions as calls should run at once.

    With ``journal``, a folder on shared storage, answers are written there as they arrive and looked up before the model is
    asked: a task that runs again asks for the rest only, and so does a later run over
    the same rows, which asks again what had failed. Clear the folder when the results are safe.
    Without one, compute the result once (write it or ``materialize`` it) before using it
    twice, or the model is called twice.
    """
    short_batches(prompts.sparkSession)
    threads = min(batch, MAX_CONCURRENCY)
    schema = StructType(list(prompts.schema.fields))
    for name, kind in (("explanation", StringType()), ("error", StringType()), ("attempts", IntegerType()), *[(c, LongType()) for c in COUNTS]):
        schema = schema.add(name, kind)
    run_folder = f"{journal.rstrip('/')}/run={uuid4().hex}" if journal else None

    def shown(answer: dict[str, Any]) -> dict[str, Any]:
        text = answer["text"] if answer["error"] is None else f"{error_prefix}{answer['error']}"
        return {"explanation": text, **{c: answer[c] for c in ("error", "attempts", *COUNTS)}}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = Journal(f"{run_folder}/part={TaskContext.get().partitionId()}") if run_folder else None
        for rows, answers in answer_rows(batches, client_factory, threads, attempts, delay, system, rate, kept):
            found = pd.DataFrame([shown(answer) for answer in answers], index=rows.index)
            yield pd.concat([rows.drop(columns="_request", errors="ignore"), found.reindex(columns=schema.names[-3 - len(COUNTS):])], axis=1).astype(
                {"attempts": "Int32", **{c: "Int64" for c in COUNTS}}
            )

    if journal is None:
        answered = prompts.mapInPandas(run, schema)
    else:
        asked = prompts.withColumn("_request", request_id(prompts, system))
        if storage.entry(journal) is None:
            answered = asked.mapInPandas(run, schema)
        else:
            earlier = read_journal(prompts.sparkSession, journal).withColumnRenamed("request", "_request")
            columns = [F.col(f"`{c}`") for c in prompts.columns]
            reused = asked.join(earlier, "_request").select(
                *columns, F.col("answer.text").alias("explanation"), *[F.col(f"answer.{c}").alias(c) for c in ("error", "attempts", *COUNTS)]
            )
            rest = asked.join(earlier.select("_request"), "_request", "left_anti").select(*columns, "_request")
            answered = rest.mapInPandas(run, schema).unionByName(reused)
    # only tokens of the answer count as output; the prompt was counted before the call
    guess = estimate_tokens(F.col("explanation"))
    return answered.withColumn(
        "output_tokens", F.when(F.col("error").isNotNull(), 0).otherwise(F.coalesce("completion_tokens", "reported_tokens", guess)).cast("long")
    )


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """A user's own function over batches of rows, in the place of the model call."""
    short_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield fn(rows)

    return df.mapInPandas(run, schema)


def observe_progress(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """Count rows, failures and cached answers while the frame is written for real."""
    observation = Observation(name)
    failed = F.col("error").isNotNull() if "error" in df.columns else F.lit(False)
    cached = F.col("cached") if "cached" in df.columns else F.lit(False)
    counted = df.observe(
        observation, F.count("*").alias("completed"), F.count_if(failed).alias("failed"), F.count_if(cached).alias("cached")
    )
    return counted, observation


def drop_failed(results: DataFrame) -> DataFrame:
    return results.filter(F.col("error").isNull() & F.col("explanation").isNotNull())
