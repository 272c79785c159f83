"""Packing by power-of-two decomposition: no padding, and no sequence crosses documents.

A document of n tokens becomes floor(n / most) pieces of ``most`` tokens and then one piece for each binary digit of
the rest, longest first. Each piece is a sequence of its own; sequences of one length form a bucket, so that a
training batch is drawn from one bucket and needs no padding.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.llm.common import text_or_empty

#: Words whose ids a Python worker remembers, half of them looked up since the other half was full.
REMEMBERED = 1_200_000
WORD = re.compile(r"[^ \n\t\r]+")
#: Runs of letters that lower-casing and normalizing leave as they are, and words of such letters, digits and signs.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
SIMPLE = re.compile("[!-@\\[-`{-~a-zß-öø-ÿ]+")
#: Pieces of such a word, as the tokenizer's own pattern has them.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Texts with letters beyond these, which go to the tokenizer as they stand, or with what is white space to Python alone.
WIDE = re.compile("[\x1c-\x1f\u0250-\U0010ffff]")


class WordIds(dict):
    """Ids of a white-space separated word as little-endian bytes; the tokenizer drops white space and never joins across it.

    The tokenizer lower-cases, and cuts words into runs of letters, digits and runs of signs: a simple word is put
    together of its pieces' ids, and a piece goes straight to the tokenizer's model. When half of REMEMBERED is full, it
    becomes the older half, whose words come back when they are met again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.pieces = self.tokenizer.model.tokenize, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.packed = [struct.pack("<I", k) for k in range(1 + max(self.tokenizer.get_vocab().values()))]
        self.spelled = {k: self.pieces(chr(k))[0][0] for k in range(0xDF, 0x100) if LETTERS.fullmatch(chr(k))}
        self.added = {t.content: self.packed[k] for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        data = self.older.get(word)
        if data is None:
            if word.isascii() and word.isalpha() and word.islower() and len(word) <= 64:
                packed = self.packed
                data = b"".join([packed[t.id] for t in self.model(word)])
            else:
                data = self.made(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[word] = data
        return data

    def made(self, word: str) -> bytes:
        if len(word) <= 64 and SIMPLE.fullmatch(word):
            pieces = PIECES.findall(word)
            return self.piece(word.translate(self.spelled)) if len(pieces) == 1 else b"".join([self[piece] for piece in pieces])
        if any(t in word for t in self.added):
            return b"".join([self.piece(piece) for piece, _ in self.pieces(self.tokenizer.normalizer.normalize_str(word))])
        return b"".join([self.packed[k] for k in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def piece(self, spelled: str) -> bytes:
        return b"".join([self.packed[t.id] for t in self.model(spelled)])

    def of(self, text: str) -> bytes:
        if self.parts is not None and any(t in text for t in self.added):
            return b"".join(self.added.get(part) or self.plain(part) for part in self.parts.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        words = WORD.findall(text) if WIDE.search(text) else text.lower().split()
        return b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(path)


def piece_lengths(n: int, most: int) -> list[int]:
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(path: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, made, part = word_ids(path), Counter(), TaskContext.get().partitionId()
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            docs, out, ids = batch.column(0), [], []
            held = 0
            for row, text in enumerate(batch.column(1).to_pylist()):
                data = words.of(text) + end
                n, start = len(data) // 4, 0
                for length in piece_lengths(n, most):
                    piece = data[start * 4 : (start + length) * 4]
                    bucket = length.bit_length() - 1
                    sequence = bucket << 56 | part << 32 | made[bucket]
                    made[bucket] += 1
                    out.append((row, start, length, zlib.crc32(piece), n, bucket, sequence))
                    ids.append(piece)
                    start += length
                held += len(data)
                if held > 1 << 24:
                    yield _batch(docs, out, ids)
                    out, ids, held = [], [], 0
            if out:
                yield _batch(docs, out, ids)

    return run


def _batch(docs: pa.Array, out: list[tuple], ids: list[bytes]) -> pa.RecordBatch:
    row, start, length, crc, n, bucket, sequence = (np.fromiter(x, np.int64, len(out)) for x in zip(*out))
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
    lists = pa.ListArray.from_arrays(pa.array(offsets), values)
    zero = np.zeros(len(out), np.int64)
    return pa.RecordBatch.from_arrays(
        [docs.take(pa.array(row)), *(pa.array(x) for x in (start, length, crc, n)), pa.array(bucket.astype(np.int32)), pa.array(sequence), pa.array(zero), lists],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "sequence_id", "offset", "ids"],
    )


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, sequence_id long, offset long, ids array<int>"


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, most: int = 4096) -> DataFrame:
    """One row for each piece, with its token ids.

    ``most`` is a power of two. ``sequence_id`` holds the bucket (log2 of the length) in its high bits, then the
    partition and a running number in it: sorted by it, equal lengths stand together. ``offset`` is 0, as a sequence
    is one piece. Every document ends with ``end_id``; a null or empty text is that one token. Rows with equal or
    null doc_id are packed one by one; other columns are ignored. The job is one narrow pass, without a shuffle.
    """
    if most & (most - 1):
        raise ValueError("most must be a power of two")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_pieces(tokenizer_path, end_id, most), SCHEMA)
