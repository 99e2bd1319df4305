"""Token ids as canonical length-limited Huffman codes, in blocks that decode on their own.

Ids are counted over all documents; the counts, at most one per vocabulary entry, go to the
driver, where package-merge gives the best code lengths of at most ``max_bits``. The codes
follow from the lengths (canonical order: length, then id). Documents are range-partitioned
and sorted by ``doc_id``; each task writes whole documents into blocks of about
``block_ids`` ids. A block is one binary value:

======================  =====================================================
bytes                   meaning (little-endian)
======================  =====================================================
4s H H I I Q Q          magic ``CLH1``, max_bits, 0, documents, ids between checkpoints, ids, bits
q x documents           doc_id (0 where null)
B x documents           1 where doc_id is null
I x documents           ids of the document, end id included
Q x checkpoints         bit offset of every ``checkpoint``-th id
payload                 codes, highest bit first, padded with 8 zero bytes
======================  =====================================================

The blocks are rows (part, block, start, n_ids, data) of a table, ``start`` being the ids of
earlier blocks of the part, and the code lengths are one row of a second table, so Spark's
committer makes them whole on any shared store. ``part`` and ``block`` give ascending ``doc_id`` order. Decoding reads ``max_bits`` bits at a time from all
checkpoints of a block together and looks code and length up in one table.

Null and empty texts are the end id alone; null ids come first; rows that share a ``doc_id``
stay together as documents of their own; an empty table gives no blocks; other columns are
not carried.
"""

import struct
import zlib
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import expand, gathered, keep, short_batches, slices, text_bytes
from .tokens import TOGETHER, default_tokenizer, encoder, with_end

HEADER = "<4sHHIIQQ"
MAGIC = b"CLH1"
MAX_BITS = 20
BLOCK_IDS = 1 << 18
CHECKPOINT = 256
BLOCK_SCHEMA = "part int, block int, start long, n_ids long, data binary"
BLOCK_COLUMNS = ["part", "block", "start", "n_ids", "data"]


def token_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """(doc_id, ids) with the ids of each whole text and the end id as little-endian 16-bit, or 32-bit, integers."""
    short_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def encode(batches):
        words = encoder(path)
        kind = id_type(words.size)
        for batch in gathered(batches, TOGETHER):
            texts, doc_ids = text_bytes(batch), batch.column("doc_id")
            for a, b in slices(texts, TOGETHER):
                ids, counts = with_end(*words.encode(texts[a:b]), end_id)
                data, ends = ids.astype(kind).tobytes(), np.cumsum(counts) * np.dtype(kind).itemsize
                cuts = [0, *ends.tolist()]
                values = pa.array([data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), values], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids binary")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def vocabulary_size(tokenizer: str | None = None) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer or default_tokenizer()).get_vocab_size(with_added_tokens=True)


def id_counts(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """(id, n) over all documents; each task sends one row per id at most."""
    kind = id_type(vocabulary)

    def count(batches):
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=vocabulary)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """The best code lengths of at most ``max_bits`` by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids cannot have codes of {max_bits} bits")
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    # per level: the sorted weights, and how many of the first k are single ids
    levels, packages = [], np.zeros(0)
    for _ in range(max_bits):
        both = np.concatenate([weights, packages])
        merged = np.argsort(both, kind="stable")
        levels.append(np.concatenate([[0], np.cumsum(merged < len(weights))]))
        both = both[merged]
        pairs = len(both) // 2 * 2
        packages = both[0:pairs:2] + both[1:pairs:2]
    chosen = 2 * len(order) - 2
    result = np.zeros(len(order), dtype=np.uint8)
    for singles in reversed(levels):
        first = int(singles[chosen])
        result[:first] += 1
        chosen = 2 * (chosen - first)
    lengths[order] = result
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, before = np.zeros(len(lengths), dtype=np.uint64), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        same = order[lengths[order] == n]
        code <<= n - before
        codes[same] = code + np.arange(len(same), dtype=np.uint64)
        code, before = code + len(same), n
    return codes


def encode_block(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, max_bits: int) -> bytes:
    size = lengths[ids].astype(np.uint64)
    ends = np.cumsum(size)
    begin = ends - size
    bits = int(ends[-1]) if len(ids) else 0
    word, shift = (begin >> np.uint64(5)).astype(np.int64), begin & np.uint64(31)
    value = codes[ids] << (np.uint64(64) - size - shift)
    words = np.zeros(bits // 32 + 4, dtype=np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))  # codes that begin in the same word do not overlap, so sums join them
        at = word[first]
        words[at] += np.add.reduceat(value >> np.uint64(32), first)
        words[at + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    header = struct.pack(HEADER, MAGIC, max_bits, 0, len(doc_ids), CHECKPOINT, len(ids), bits)
    return b"".join(
        (
            header,
            np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
            np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
            counts.astype("<u4").tobytes(),
            begin[::CHECKPOINT].astype("<u8").tobytes(),
            words.astype(">u4").tobytes()[: (bits + 7) // 8 + 8],
        )
    )


def decode_table(lengths: np.ndarray, max_bits: int) -> np.ndarray:
    """For every value of the next ``max_bits`` bits: id * 32 + code length."""
    table = np.zeros(1 << max_bits, dtype=np.uint32)
    ids = np.flatnonzero(lengths)
    span = np.left_shift(1, max_bits - lengths[ids].astype(np.int64))
    start = (canonical_codes(lengths)[ids] << (max_bits - lengths[ids].astype(np.int64)).astype(np.uint64)).astype(np.int64)
    table[expand(start, span)] = np.repeat((ids * 32 + lengths[ids]).astype(np.uint32), span)
    return table


def decode_block(data: bytes, table: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids per document and all ids of a block."""
    magic, max_bits, _, documents, every, n, _ = struct.unpack_from(HEADER, data)
    if magic != MAGIC or len(table) != 1 << max_bits:
        raise ValueError("not a block of this code")
    at = struct.calcsize(HEADER)
    doc_ids = np.frombuffer(data, "<i8", documents, at)
    nulls = np.frombuffer(data, np.uint8, documents, at + 8 * documents)
    counts = np.frombuffer(data, "<u4", documents, at + 9 * documents).astype(np.int64)
    at += 13 * documents
    checkpoints = -(-n // every)
    position = np.frombuffer(data, "<u8", checkpoints, at).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, offset=at + 8 * checkpoints).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    out = np.zeros((every, checkpoints), dtype=np.uint32)
    last = n - (checkpoints - 1) * every  # ids behind the last checkpoint
    for step in range(every if checkpoints else 0):
        if step == last:
            position = position[:-1]
        if not len(position):
            break
        bits = (window[position >> 3] >> (32 - max_bits - (position & 7)).astype(np.uint32)) & np.uint32((1 << max_bits) - 1)
        found = table[bits]
        out[step, : len(position)] = found >> 5
        position = position + (found & 31)
    known = [None if z else d for d, z in zip(doc_ids.tolist(), nulls.tolist(), strict=True)]
    return known, counts, out.T.reshape(-1)[:n]


def write_ids(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 1, max_bits: int = MAX_BITS) -> str:
    """Write the ids of ``docs`` in ascending ``doc_id`` order below ``folder`` and return it."""
    if max_bits > 24:
        raise ValueError("max_bits is at most 24")
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/ids-{uuid4().hex}"
    vocabulary = vocabulary_size(tokenizer)
    tokens = keep(token_table(docs, tokenizer, end_id))
    counts = np.zeros(vocabulary, dtype=np.int64)
    for i, n in id_counts(tokens, vocabulary).collect():  # one row per vocabulary entry at most
        counts[i] = n
    lengths = code_lengths(counts, max_bits)
    spark.createDataFrame([(max_bits, vocabulary, bytes(lengths))], "max_bits int, vocabulary int, lengths binary").coalesce(1).write.parquet(f"{folder}/code")
    kind = id_type(vocabulary)

    def blocks(batches):
        codes, part = canonical_codes(lengths), TaskContext.get().partitionId()
        waiting, number, start = [], 0, 0

        def block():
            ids = [np.frombuffer(v, kind) for _, v in waiting]
            sizes = np.array([len(v) for v in ids])
            data = encode_block([d for d, _ in waiting], sizes, np.concatenate(ids), lengths, codes, max_bits)
            values = [part, number, start, int(sizes.sum()), data]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=BLOCK_COLUMNS)

        size = 0
        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                waiting.append(row)
                size += len(row[1])
                if size >= BLOCK_IDS * np.dtype(kind).itemsize:
                    yield block()
                    waiting, number, start, size = [], number + 1, start + size // np.dtype(kind).itemsize, 0
        if waiting:
            yield block()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id"), F.xxhash64("ids")]  # rows of one id, or of none, are spread by what they hold
    ordered = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{folder}/blocks")
    return folder


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the written blocks."""
    max_bits, _, lengths = spark.read.parquet(f"{folder}/code").first()
    lengths = np.frombuffer(bytes(lengths), np.uint8)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    # one row per written part, as many as the writer had shuffle partitions
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_earlier"))

    def decode(batches):
        table = decode_table(lengths, max_bits)
        for batch in batches:
            for begin, data in zip(batch.column("start").to_pylist(), batch.column("data").to_pylist(), strict=True):
                doc_ids, counts, ids = decode_block(data, table)
                ends = np.cumsum(counts)
                starts = ends - counts
                parts = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                arrays = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(begin + starts),
                    pa.array(counts),
                    pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                ]
                if with_ids:
                    arrays.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in schema.split(", ")])

    return blocks.join(F.broadcast(parts), "part").select((F.col("start") + F.col("_earlier")).alias("start"), "data").mapInArrow(decode, schema)
