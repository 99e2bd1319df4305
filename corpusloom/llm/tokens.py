"""Token ids of whole texts with a public tokenizer of the ``tokenizers`` library.

Invented and rare words make the library's merge loop the dearest step, so texts are cut into
units, each distinct unit is encoded once per worker process, and its ids are looked up. That
equals encoding the whole text because the tokenizer used here never joins characters across
ASCII white space, nor across the border of an ASCII letter and the punctuation in ``PUNCTUATION``.
"""

import os
import sys
from itertools import chain
from types import ModuleType

import numpy as np
import public_tokenizers
import pyarrow as pa

from .common import expand

#: At a border of an ASCII letter and one of these the tokenizer's own word pattern always ends one
#: piece and starts the next. The apostrophe (contractions) and < | > (special tokens) are left out on purpose.
PUNCTUATION = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
SPACE, LETTER, MARK, OTHER = 0, 1, 2, 3
JOINED = 512
#: Bytes of text that are cut and looked up together.
TOGETHER = 8_000_000


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, dtype=np.uint8)
    table[list(b" \t\n\r\x0b\x0c")] = SPACE
    table[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = LETTER
    table[list(PUNCTUATION)] = MARK
    return table


def lower_case() -> np.ndarray:
    return np.frombuffer(bytes(range(256)).lower(), np.uint8)


class WordEncoder:
    """Encodes batches of texts; at most ``most`` distinct units are remembered."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.size, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        self.classes, self.lower = byte_classes(), lower_case()
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)

    def _learn(self, units: list[bytes]) -> None:
        """Units of letters only are one piece each, so they are encoded many at once and cut at word ends."""
        letters, others, order, found = [], [], [], []
        for unit in units:
            text = unit.decode("utf-8", "replace")
            (letters if text.isalpha() else others).append((unit, text))
        for first in range(0, len(letters), JOINED):
            part = letters[first : first + JOINED]
            ids = np.array(self.tokenizer.encode(" ".join(t for _, t in part), add_special_tokens=False).ids, dtype=np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, dtype=np.int64)
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                others.extend(part)
                continue
            order.extend(u for u, _ in part)
            found.append((ids, np.diff(cuts, prepend=0)))
        for first in range(0, len(others), JOINED):
            part = others[first : first + JOINED]
            each = [e.ids for e in self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False)]
            order.extend(u for u, _ in part)
            found.append((np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))))
        lengths = np.concatenate([n for _, n in found])
        first = len(self.rows)
        self.rows.update(zip(order, range(first, first + len(order)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, *[ids for ids, _ in found]])

    def _cut(self, texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
        """The units of all texts without white space, and where each text's units begin."""
        joined = b" ".join([b"", *texts])
        data = np.frombuffer(joined, np.uint8)
        kind = self.classes[data]
        before, here = kind[:-1], kind[1:]
        begin = np.zeros(len(data), dtype=bool)
        begin[1:] = (before == SPACE) | ((before | here == LETTER | MARK) & (before != here) & (before != OTHER) & (here != OTHER))
        solid = kind != SPACE
        data = (data if b"<" in joined else self.lower[data])[solid]
        starts = np.flatnonzero(begin[solid])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        texts_begin = np.concatenate([[0], np.cumsum(solid)])[np.concatenate([[0], np.cumsum(sizes)])]
        offsets = np.append(starts, len(data)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        return units, np.searchsorted(starts, texts_begin)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each text."""
        units, borders = self._cut(texts)
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [u for u in distinct if u not in self.rows]
        if new:
            if len(self.rows) + len(new) > self.most:
                self.forget()
                new = distinct
            self._learn(new)
        rows = np.fromiter(map(self.rows.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        lengths = self.lengths[rows]
        ids = self.flat[expand(self.starts[rows], lengths)]
        return ids, np.diff(np.concatenate([[0], np.cumsum(lengths)])[borders])


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process; tasks that run in it one after the other share what it has learnt."""
    known = sys.modules.setdefault("_word_encoders", ModuleType("_word_encoders"))
    if path not in known.__dict__:
        setattr(known, path, WordEncoder(path))
    return getattr(known, path)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` behind those of each text."""
    out = np.full(len(ids) + len(counts), end_id, dtype=np.uint32)
    starts = np.cumsum(counts + 1) - (counts + 1)
    out[expand(starts, counts)] = ids
    return out, counts + 1
