"""Reading, keeping and slicing that the operators share."""

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows an Arrow batch holds at most; texts are long, so batches are short.
BATCH_ROWS = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def short_batches(spark: SparkSession) -> None:
    """Keep the batches that carry whole texts to Python small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once, as a zstd table in the shared folder, and go on from that table.

    Every later stage reads the same rows whatever executor is lost. The tables go with
    the checkpoint folder of the run.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    values = batch.column(column)
    if pa.types.is_null(values.type):
        return [b""] * batch.num_rows
    return [v or b"" for v in values.cast(pa.binary()).to_pylist()]


def gathered(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches put together until the column has about ``limit`` bytes."""
    waiting, size = [], 0

    def whole():
        return pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.column(column).nbytes
            if size >= limit:
                yield whole()
                waiting, size = [], 0
    if waiting:
        yield whole()


def slices(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together, one text at least."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def held_out(remainder: int, modulus: int):
    """True for rows whose crc32 of the id, as text, has this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def thinned(df: DataFrame, column: str, share) -> DataFrame:
    """About ``share`` of the rows, chosen by a hash of the column; the same ones on every run."""
    place = F.pmod(F.xxhash64(column, F.lit("sample")), F.lit(1_000_000_000))
    return df.filter(place < share * 1_000_000_000)


def bounded_sample(df: DataFrame, column: str, rows: int, total: int | None = None) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of the column.

    Of a large frame four times as many are taken first, so that the ordering sees few rows
    however many tasks there are. ``df`` is read twice unless its ``total`` is given.
    """
    total = df.count() if total is None else total
    return thinned(df, column, min(1.0, 4 * rows / max(1, total))).orderBy(F.xxhash64(column), column).limit(rows)


def row_key():
    """What tells one row of ``documents`` from another: the id and the text, of a row with a null id the text alone."""
    return F.xxhash64("doc_id", "text")


def labelled_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, label): at most ``rows`` different rows whose id is labelled, those with the smallest hashes.

    Rows equal in id and text count once; of an id with several labels an arbitrary one holds, the same on every run.
    Only ids and hashes are ordered; texts are fetched for the rows that were chosen.
    """
    known = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min(F.col("label").cast("int")).alias("label"))
    ids = bounded_sample(known, "doc_id", rows).select(F.col("doc_id").alias("_labelled"), "label")
    # ``rows`` rows at most, here and below
    found = docs.select("doc_id", "text", row_key().alias("_key")).join(F.broadcast(ids), F.col("doc_id") == F.col("_labelled"))
    picked = found.select(F.col("_key").alias("_picked")).distinct().orderBy(F.xxhash64("_picked"), "_picked").limit(rows)
    return found.join(F.broadcast(picked), F.col("_key") == F.col("_picked")).dropDuplicates(["_key"]).select("doc_id", "text", "label")


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of every range, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))
