"""The per-file job: look up, render prompts for the misses, call the model, keep the answers."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import (
    DEFAULT_CONCURRENCY,
    ERROR_PREFIX,
    MODE_ALIASES,
    PROJECT_ERROR_PREFIX,
    PROJECT_MODES,
    RETRY_ATTEMPTS,
    RETRY_DELAY_SECONDS,
    SYSTEM_FILE,
    SYSTEM_PROJECT,
)
from ..operators import cache as caching
from ..operators.corpus import detect_language
from ..operators.infer import Client, infer
from ..operators.prompts import build_prompts
from ..session import materialize


@dataclass(frozen=True)
class RunConfig:
    mode: str = "explain"
    level: str = "beginner"
    provider: str = "stub"
    model: str = "stub-1"
    use_cache: bool = True
    concurrency: int = DEFAULT_CONCURRENCY
    attempts: int = RETRY_ATTEMPTS
    delay: float = RETRY_DELAY_SECONDS
    partitions: int | None = None
    #: Calls a second of one partition, and the folder where answers are kept as they arrive (see ``infer``).
    rate: float | None = None
    journal: str | None = None

    def key_parts(self) -> dict[str, str]:
        return {"mode": self.mode, "level": self.level, "provider": self.provider, "model": self.model}


ID = ["project", "file_id"]


def spread_calls(prompts: DataFrame, config: RunConfig) -> DataFrame:
    """Deal the calls out to ``partitions`` tasks, if the run asks for a number.

    Few rows with slow calls want more tasks than their bytes would get; without a number
    the prompts stay where they are, and their texts are not shuffled again.
    """
    return prompts.repartition(config.partitions, *ID) if config.partitions else prompts


def call_model(rows: DataFrame, templates: DataFrame, client_factory: Callable[[], Client], config: RunConfig) -> DataFrame:
    """Prompt and answer each row once; the answers are kept in the shared folder."""
    prompts = build_prompts(rows.withColumn("mode", F.lit(config.mode)), templates, F.lit(config.level))
    sent = prompts.select(*ID, "relative_path", "language", "file_hash", "input_tokens", "prompt")
    of_project = MODE_ALIASES.get(config.mode, config.mode) in PROJECT_MODES
    answered = infer(
        spread_calls(sent, config), client_factory, config.concurrency, config.attempts, config.delay,
        SYSTEM_PROJECT if of_project else SYSTEM_FILE,
        PROJECT_ERROR_PREFIX.format(mode=config.mode) if of_project else ERROR_PREFIX,
        config.rate, config.journal,
    )
    return materialize(answered.drop("prompt"))


def cache_rows(answered: DataFrame, looked_up: DataFrame, config: RunConfig) -> DataFrame:
    """Cache rows of the successful answers."""
    parts = F.struct(*[F.lit(v).alias(k) for k, v in config.key_parts().items()])
    keys = looked_up.select(*ID, "cache_key", "file_size", "mtime_ms")
    return (
        answered.filter(F.col("error").isNull())
        .select(*ID, "file_hash", "explanation")
        .join(keys, ID)
        .select("cache_key", "file_hash", "file_size", "mtime_ms", "explanation", F.current_timestamp().alias("created_at"), parts.alias("config"))
    )


def unanswered(keyed: DataFrame, looked_up: DataFrame) -> DataFrame:
    """The rows the cache cannot answer, with the hash of their content.

    The one join that meets the texts; they are hashed where they are read for the prompt.
    """
    missed = keyed.join(looked_up.filter("cache_status = 'miss'").select(*ID), ID, "left_semi")
    return missed if "file_hash" in missed.columns else missed.withColumn("file_hash", F.sha2("content", 256))


def answer_with_cache(
    keyed: DataFrame, cache: DataFrame, templates: DataFrame, client_factory: Callable[[], Client], config: RunConfig
) -> tuple[DataFrame, DataFrame]:
    """Answers for all rows, calling the model only for those the cache cannot answer.

    ``keyed`` needs (project, file_id, relative_path, language, cache_key, file_size,
    mtime_ms), its ``content`` or ``file_hash``, and what its template asks for. A run over
    an unchanged corpus is answered from metadata; no content is read.
    """
    looked_up = materialize(caching.cache_lookup(keyed, cache, config.use_cache, metadata_first=config.use_cache))
    answered = call_model(unanswered(keyed, looked_up), templates, client_factory, config)

    known = looked_up.filter("cache_status <> 'miss'").select(*ID, F.col("cached_explanation").alias("explanation"))
    reused = keyed.select(*ID, "relative_path", "language").join(known, ID).withColumn("cached", F.lit(True))
    results = answered.drop("file_hash").withColumn("cached", F.lit(False)).unionByName(reused, allowMissingColumns=True)
    fresh = cache_rows(answered, looked_up, config)
    return results, fresh.unionByName(caching.refreshed(looked_up, cache), allowMissingColumns=True)


def explain_corpus(
    files: DataFrame,
    cache: DataFrame,
    templates: DataFrame,
    client_factory: Callable[[], Client],
    config: RunConfig = RunConfig(),
    key_path: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answers for all files, and the cache rows to upsert.

    ``files`` needs (project, file_id, relative_path, content, file_size, mtime_ms), with
    ``file_id`` unique in its project. Only files whose content is not answered yet reach the
    model. Answers are kept under the full path, or project and relative path where there is none.
    """
    path = caching.full_path(files) if key_path is None else key_path
    keyed = caching.with_cache_key(detect_language(files), path, config.key_parts())
    return answer_with_cache(keyed, cache, templates, client_factory, config)
