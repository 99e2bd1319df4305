"""Token ids in files and packed sequences against the tokenizer itself."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import packing, queries
from corpusloom.llm.common import documents
from corpusloom.llm.huffman_ids import canonical_codes, code_lengths, decode_block, decode_table, encode_block, read_ids, write_ids
from corpusloom.llm.tokens import WordEncoder, default_tokenizer

ODD = ["a", "B", "é", "É", "'s", "'re", "'", "it's", " ", "\n", "́", "=", "̸", "<|endoftext|>", "<", "|", ">", "1", "²", "…", ",", "!!", "-", "_", "İ", "I"]
ODD += ["ß", "中", "\x1c", "\x00", "'LL", "Σ", "ſ", "🙂", "‍", "#", "`", "\x85", " ", "K"]


@pytest.fixture(scope="module")
def encoded(spark, sf_dir):
    tokenizer = Tokenizer.from_file(default_tokenizer())
    rows = sorted((r.doc_id, r.text or "") for r in documents(spark, sf_dir).select("doc_id", "text").collect())
    return {d: e.ids + [1] for (d, _), e in zip(rows, tokenizer.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_encode_as_whole_texts():
    chance = random.Random(5)
    texts = ["".join(chance.choice(ODD) for _ in range(chance.randint(0, 30))) for _ in range(20_000)]
    encoder = WordEncoder(default_tokenizer(), most=9_000)  # forgets a few times
    whole = Tokenizer.from_file(default_tokenizer())
    for first in range(0, len(texts), 1000):
        part = texts[first : first + 1000]
        ids, counts = encoder.encode([t.encode() for t in part])
        expected = [e.ids for e in whole.encode_batch(part, add_special_tokens=False)]
        assert counts.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]


def test_code_lengths_are_limited_and_complete():
    counts = np.zeros(300, dtype=np.int64)
    counts[:30] = [2**k for k in range(30)]  # unlimited codes would need 29 bits
    lengths = code_lengths(counts, 8)
    assert lengths.max() == 8 and (lengths[30:] == 0).all()
    assert sum(2.0 ** -int(n) for n in lengths[:30]) == 1
    assert code_lengths(np.array([0, 5]), 8).tolist() == [0, 1]
    with pytest.raises(ValueError):
        code_lengths(np.ones(300, dtype=np.int64), 8)


@pytest.mark.parametrize("sizes", [[1], [256], [257], [0, 255, 1, 1000, 3], []])
def test_block_round_trip(sizes):
    ids = np.random.default_rng(1).zipf(1.3, sum(sizes)) % 500
    lengths = code_lengths(np.bincount(ids, minlength=500) + 1, 16)
    names = [None, *range(len(sizes))][: len(sizes)]
    data = encode_block(names, np.array(sizes, dtype=np.int64), ids, lengths, canonical_codes(lengths), 16)
    found, counts, back = decode_block(data, decode_table(lengths, 16))
    assert (found, counts.tolist(), back.tolist()) == (names, sizes, ids.tolist())


def test_written_ids_equal_the_tokenizer(spark, sf_dir, encoded):
    expected, start = {}, 0
    for doc_id, ids in encoded.items():
        expected[doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    rows = queries.QUERIES["op7_huffman_ids"](spark, sf_dir).collect()
    assert len(rows) == len(expected)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == expected


def test_written_ids_of_odd_rows(spark):
    rows = [(2, None, "x"), (1, "", "x"), (3, "long " * 200_000, "x"), (4, "same", "x"), (4, "same", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    found = read_ids(spark, write_ids(docs)).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 1, 2, 3, 4, 4]
    assert [r.n_tokens for r in found] == [3, 1, 1, 200_001, 2, 2]
    assert found[1].ids == found[2].ids == [1] and found[4].ids == found[5].ids
    assert read_ids(spark, write_ids(docs.limit(0))).count() == 0


def check_packed(rows, encoded, capacity):
    sequences, total = defaultdict(list), Counter()
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        total[r.doc_id] += r.length
        part = encoded[r.doc_id][r.start : r.start + r.length]
        assert (r.start, r.ids_crc32) == (r.piece * capacity, crc(part))
        assert len(part) == r.length
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert total == {d: len(ids) for d, ids in encoded.items()}
    return len(sequences)


def test_packing_is_whole_and_tight(spark, sf_dir, encoded):
    rows = queries.QUERIES["op8_packing"](spark, sf_dir).collect()
    least = -(-sum(map(len, encoded.values())) // 4096)
    assert check_packed(rows, encoded, 4096) == least


def test_packing_with_a_small_capacity_and_ids(spark, sf_dir, encoded):
    packed = packing.pack_documents(documents(spark, sf_dir), capacity=300, with_ids=True).persist()
    check_packed(packed.collect(), encoded, 300)
    whole = {r.sequence_id: r.ids for r in packing.assemble(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    packed.unpersist()


def test_packing_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "a b", 7), (3, "a b", 7), (None, "a", 7)], "doc_id long, text string, length int")
    rows = packing.pack_documents(docs).collect()
    assert sorted(r.length for r in rows) == [1, 1, 2, 3, 3]
    assert sorted(r.offset for r in rows) == [0, 3, 6, 8, 9]
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("groups", packing.GROUPS)
def test_plan_places_every_piece_once(groups):
    chance = random.Random(groups)
    for capacity in (1, 7, 100, 4096):
        histogram = {n: chance.randint(1, 400) for n in chance.sample(range(1, capacity + 1), min(capacity, 60))}
        bins = packing.plan(histogram, capacity, groups)
        placed, load = Counter(), defaultdict(list)
        for run in bins.runs:
            assert run.first == placed[run.length]
            placed[run.length] += run.pieces
            for k in range(run.pieces):
                load[run.sequence + k // run.each].append((run.offset + k % run.each * run.length, run.length))
        assert placed == histogram and len(load) == bins.next
        for places in load.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= capacity


def test_linear_program_beats_single_sizes():
    columns = packing.configurations([60, 40, 30], 100)
    solution = packing.fewest(columns, np.array([10.0, 10.0, 30.0]))
    assert sum(solution.values()) == pytest.approx(20)
