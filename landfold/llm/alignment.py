"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes; groups end where tokens of both end. With the index shift between the two arrays of
token ends held fixed, stretches in which every token of one is a token of the other are jumped over by probing
twice as far each time, and then half as far, comparing the arrays as bytes. Where the ends differ, the group is resolved token by
token, which links the tokens that overlap, and its lengths change the shift.

Pairs of linked ids are counted by documents over the whole corpus. Tasks make chunks of documents: only each chunk's
distinct pairs are counted and get their counts back; a document holds its pairs as places in its chunk's list.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from landfold.llm.common import coded, decoded, ragged, written

#: Documents of about so many bytes are aligned in one go, and make a chunk.
RUN_BYTES, CHUNK_BYTES = 1 << 20, 8 << 20


class Tokenizers:
    """A: byte-level ranks (with the pattern that parts words). B: pieces of a sentencepiece model, which adds a space before the text."""

    def __init__(self, ranks_path: str, pattern: str, pieces_path: str):
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.a_bytes[rank] = word
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        whole = lambda k, p: bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
        self.b_bytes = [whole(k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(w) for w in words]) for words in (self.a_bytes, self.b_bytes))
        texts = lambda n, ends: np.array([f"{k}{end}" for k in range(n) for end in ends], object)
        self.a_text, self.b_text = texts(len(self.a_bytes), ",|"), texts(len(self.b_bytes), ",;")

    def encode(self, texts: list[str | None]) -> tuple[list, list]:
        """Ids of both for each text; none for a text that is null, empty or that the tokens don't spell."""
        none: list[int] = []
        b = iter(self.b.encode([t for t in texts if t], num_threads=1))
        ours, theirs = [], []
        for t in texts:
            x, y = (self.a.encode_ordinary(" " + t), next(b)) if t else (none, none)
            if t:
                spelled = (" " + t).encode()
                if b"".join(map(self.a_bytes.__getitem__, x)) != spelled or b"".join(map(self.b_bytes.__getitem__, y)) != spelled:
                    x, y = none, none
            ours.append(x)
            theirs.append(y)
        return ours, theirs


@lru_cache(maxsize=2)
def tokenizers(ranks_path: str, pattern: str, pieces_path: str) -> Tokenizers:
    """A worker loads them once."""
    return Tokenizers(ranks_path, pattern, pieces_path)


def irregular_groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two rising arrays with the same last entry the groups that are not one to one, as rows (first and end in a, in b), and their links."""
    ends_a, ends_b, raw_a, raw_b = a.tolist(), b.tolist(), a.astype("<i8").tobytes(), b.astype("<i8").tobytes()
    i = j = 0
    n = len(ends_a)
    groups, link_a, link_b = array("q"), array("q"), array("q")
    while i < n:
        if ends_a[i] == ends_b[j]:  # one to one: skip along the diagonal
            i, j, far = i + 1, j + 1, 1
            while i + far <= n and raw_a[8 * i : 8 * (i + far)] == raw_b[8 * j : 8 * (j + far)]:
                i, j, far = i + far, j + far, far * 2
            while far > 1:
                far //= 2
                if i + far <= n and raw_a[8 * i : 8 * (i + far)] == raw_b[8 * j : 8 * (j + far)]:
                    i, j = i + far, j + far
            if i == n:
                break
        first_a, first_b = i, j
        x, y = ends_a[i], ends_b[j]
        link_a.append(i)
        link_b.append(j)
        while x != y:
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
            link_a.append(i)
            link_b.append(j)
        i, j = i + 1, j + 1
        groups.extend((first_a, i, first_b, j))
    return np.frombuffer(groups, np.int64).reshape(-1, 4), np.frombuffer(link_a, np.int64), np.frombuffer(link_b, np.int64)


class Aligned:
    """Some documents, aligned together: their token ends go on from one to the next, and every document ends a group."""

    def __init__(self, t: Tokenizers, texts: list[str | None]):
        ours, theirs = t.encode(texts)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ours, theirs))
        a, b = (np.fromiter((k for ids in all_ids for k in ids), np.int64, int(n.sum())) for all_ids, n in ((ours, self.n_a), (theirs, self.n_b)))
        groups, link_a, link_b = irregular_groups(np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b]))
        last_a, last_b = np.ones(len(a), bool), np.ones(len(b), bool)
        single_a, single_b = last_a.copy(), last_b.copy()
        for last, single, first, end in ((last_a, single_a, groups[:, 0], groups[:, 1]), (last_b, single_b, groups[:, 2], groups[:, 3])):
            inside = ragged(first, end - first)
            last[inside] = single[inside] = False
            last[end - 1] = True
        link_a, link_b = np.append(np.flatnonzero(single_a), link_a), np.append(np.flatnonzero(single_b), link_b)
        many = len(texts)
        doc = np.repeat(np.arange(many), self.n_a)
        self.n_groups, self.n_links = np.bincount(doc[last_a], minlength=many), np.bincount(doc[link_a], minlength=many)
        #: Document, pair of ids as one number, and how often it is linked there.
        pairs = len(t.b_bytes)
        key, self.times = np.unique((doc[link_a] * len(t.a_bytes) + a[link_a]) * pairs + b[link_b], return_counts=True)
        self.doc, self.pair = key // (len(t.a_bytes) * pairs), key % (len(t.a_bytes) * pairs)
        # a group's tokens of A stand before its tokens of B
        before_a, before_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        ends_a, ends_b = np.append(0, np.flatnonzero(last_a) + 1), np.append(0, np.flatnonzero(last_b) + 1)
        words = np.empty(len(a) + len(b), object)
        words[np.arange(len(a)) + ends_b[before_a]] = t.a_text[2 * a + last_a]
        words[np.arange(len(b)) + ends_a[before_b + 1]] = t.b_text[2 * b + last_b]
        edges = np.append(0, np.cumsum(self.n_a + self.n_b)).tolist()
        words = words.tolist()
        self.groups = ["".join(words[p:q])[:-1] for p, q in zip(edges, edges[1:])]


def aligned_chunks(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, groups_as: Callable[[str], str] | None = None, run_bytes: int = RUN_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The written table of docs(doc_id, text) in chunks: a row for each document, and one for each pair of ids of a chunk.

    Document rows: doc_id, n_a, n_b, n_groups, n_links, groups (through ``groups_as``), links: its pairs as places in the
    chunk's list and how often. Pair rows: pair (id of A times the pieces of B, and the id of B), at: its place, n: documents.
    """
    kind = to_arrow_schema(docs.select("doc_id").schema).field(0).type
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    names = ["chunk", "doc_id", *counts, "groups", "links", "pair", "at", "n"]
    types = [pa.int64(), kind, *[pa.int64()] * 4, pa.string(), pa.binary(), *[pa.int64()] * 3]

    def rows(chunk: int, ids: list[pa.Array], parts: list[Aligned]) -> Iterator[pa.RecordBatch]:
        moved = np.cumsum([0] + [len(p.n_a) for p in parts])
        doc = np.concatenate([p.doc + m for p, m in zip(parts, moved)])
        pair, at, n = np.unique(np.concatenate([p.pair for p in parts]), return_inverse=True, return_counts=True)
        times = np.concatenate([p.times for p in parts])
        step = np.diff(at, prepend=0)
        heads = np.flatnonzero(np.diff(doc, prepend=-1))
        step[heads] = at[heads]
        data, ends = coded(np.stack([step, times], axis=1).ravel())
        size = np.bincount(doc, minlength=moved[-1])
        offsets = np.append(0, ends)[2 * np.append(0, np.cumsum(size))]
        links = pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(moved[-1]), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
        groups = [groups_as(g) if groups_as else g for p in parts for g in p.groups]
        own = [pa.concat_arrays(ids), *(pa.array(np.concatenate([getattr(p, c) for p in parts])) for c in counts), pa.array(groups, pa.string()), links]
        none = lambda cs, k: [pa.nulls(k, types[names.index(c)]) for c in cs]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(moved[-1], chunk)), *own, *none(names[8:], int(moved[-1]))], names=names)
        for a in range(0, len(pair), 50_000):
            part = slice(a, a + 50_000)
            k = len(pair[part])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, chunk)), *none(names[1:8], k), pa.array(pair[part]), pa.array(np.arange(a, a + k)), pa.array(n[part])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(ranks_path, pattern, pieces_path)
        chunk = TaskContext.get().partitionId() << 32
        ids, parts, texts, size, whole = [], [], [], 0, 0
        for b in batches:
            ids.append(b.column(0))
            for k, text in enumerate(b.column(1).to_pylist()):
                texts.append(text)
                size += len(text or "") + 64
                if size >= run_bytes:
                    parts.append(Aligned(t, texts))
                    whole, texts, size = whole + size, [], 0
                    if whole >= chunk_bytes:
                        last = ids.pop()
                        ends = k + 1 - (len(b) - len(last))
                        yield from rows(chunk, [*ids, last.slice(0, ends)], parts)
                        chunk, ids, parts, whole = chunk + 1, [last.slice(ends)], [], 0
        if texts:
            parts.append(Aligned(t, texts))
        if parts:
            yield from rows(chunk, ids, parts)

    schema = f"chunk long, doc_id {dict(docs.dtypes)['doc_id']}, {', '.join(f'{c} long' for c in counts)}, groups string, links binary, pair long, at long, n long"
    return written(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema), "aligned")


def pair_counts(chunks: DataFrame, b_size: int) -> DataFrame:
    """(pair, a, b, n, best): how many documents hold a pair of ids linked, and whether no pair of the same id of A has more."""
    n = chunks.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
    n = written(n.withColumns({"a": F.expr(f"pair div {b_size}"), "b": F.expr(f"pair % {b_size}")}), "pairs")
    return n.join(n.groupBy("a").agg(F.max("n").alias("_most")), "a").select("pair", "a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def align(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, b_size: int, groups_as: Callable[[str], str] | None = None, run_bytes: int = RUN_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row of docs(doc_id, text).

    groups: ``a1,a2|b1;a3|b2,b3`` in ids, or what ``groups_as`` makes of it. A link is a pair of tokens whose bytes
    overlap; n_best counts the links whose pair is linked in most documents among those of its id of A, ties included; count_sum sums
    that number of documents over the links. b_size: pieces of B. Texts that are null, empty, or that the
    tokens of A or B don't spell have no tokens: zeros and ''. Rows that repeat are documents of their own, a null doc_id
    is kept, columns of other names are not read. No documents give no rows.
    """
    chunks = aligned_chunks(docs, ranks_path, pattern, pieces_path, groups_as, run_bytes, chunk_bytes)
    counts = pair_counts(chunks, b_size).withColumnRenamed("n", "docs")
    ours = chunks.where("pair is null").drop("pair", "at", "n")
    pairs = chunks.where("pair is not null").select(F.col("chunk").alias("of"), "pair", "at").join(counts.select("pair", "docs", "best"), "pair").drop("pair")
    kind = to_arrow_schema(docs.select("doc_id").schema).field(0)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def run(own: pa.Table, its: pa.Table) -> pa.Table:
        at = its.column("at").to_numpy()
        docs_of, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        docs_of[at], best[at] = its.column("docs").to_numpy(), its.column("best").to_numpy()
        n_best, total = [], []
        for data in own.column("links").to_pylist():
            step, times = decoded(np.frombuffer(data, np.uint8)).reshape(-1, 2).T
            place = np.cumsum(step)
            n_best.append(int(times[best[place]].sum()))
            total.append(int((times * docs_of[place]).sum()))
        made = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.Table.from_arrays([made[c] if c in made else own.column(c) for c in names], names=names)

    schema = ", ".join(f"{c} {dict(docs.dtypes)['doc_id'] if c == kind.name else 'string' if c == 'groups' else 'long'}" for c in names)
    return ours.groupBy("chunk").cogroup(pairs.groupBy("of")).applyInArrow(run, schema)


def sha256_or_empty(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""
