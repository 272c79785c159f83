"""Ranked lexical search: an inverted index in blocks, searched by Block-Max MaxScore, shard by shard.

Tasks that read documents make segments of the index: for each term a list of (document, occurrences), coded in blocks of
64 with the highest impact of each block beside it. Segments meet in shards of bounded size. In a shard the lists of an
item are taken by falling bound. Lists are essential as long as a document that is in none of those before could still
enter the best k; after that no new document can, and the blocks of the other lists are decoded only for candidates that the block's
maximum and the bounds of the lists left could lift to the k-th score. The best k of each shard are merged at the end.

A score sums w * ((10^9 * tf) div (1000 * tf + 8 * m)) over the terms of an item, repeats included; all is integer.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landfold.llm.common import coded, decoded, ragged, words_of, written

BLOCK = 64
#: A segment ends with the document that brings it to so many bytes of text.
SEGMENT_BYTES = 8 << 20
#: About so many terms, repeats included, and documents make a shard; so many items are searched together in one.
SHARD_TERMS, SHARD_DOCS, ITEMS = 4_000_000, 16_384, 256


def corpus_counts(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(words_of(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"docs": pa.array([sum(k > 0 for k in n)], pa.int64()), "terms": pa.array([sum(n)], pa.int64())})

    counts = docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return counts[0] or 0, counts[1] or 0


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 25 + 75 * n * n_docs // max(n_terms, 1)


def _parted(kind: pa.DataType, values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))


def _segment(segment: int, ids: pa.Array, texts: list[bytes | None], n_docs: int, n_terms: int) -> pa.RecordBatch:
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    flat, n = array("q"), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = words_of(text)
        n[k] = len(words)
        flat.extend(map(numbers.__getitem__, words))
    flat = np.frombuffer(flat, np.int64)
    key, tf = np.unique(flat * len(texts) + np.repeat(np.arange(len(texts)), n), return_counts=True)
    term, doc = key // len(texts), key % len(texts)
    df = np.bincount(term, minlength=len(numbers))
    at = np.arange(len(term)) - np.repeat(np.cumsum(df) - df, df)
    starts = np.flatnonzero(at % BLOCK == 0)
    gap = np.diff(doc, prepend=0)
    gap[starts] = 0
    data, ends = coded(np.stack([gap, tf], axis=1).ravel())
    best = np.maximum.reduceat(impact(tf, length_norm(n, n_docs, n_terms)[doc]), starts) if len(starts) else starts
    stops = np.append(starts[1:], len(term))[: len(starts)]
    blocks = np.append(0, np.cumsum(-(-df // BLOCK)))
    offsets = np.append(0, ends[2 * np.cumsum(df) - 1]) if len(df) else np.zeros(1, np.int64)
    payload = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(df), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
    none = pa.nulls
    rows = len(df)
    columns = {
        "segment": pa.array(np.full(rows + 1, segment)),
        "term": pa.concat_arrays([pa.array(list(numbers), pa.binary()), none(1, pa.binary())]),
        "df": pa.concat_arrays([pa.array(df, pa.int64()), none(1, pa.int64())]),
        "payload": pa.concat_arrays([payload, none(1, pa.binary())]),
        "sizes": pa.concat_arrays([_parted(pa.int32(), np.diff(ends[2 * stops - 1], prepend=0), blocks), none(1, pa.list_(pa.int32()))]),
        "first": pa.concat_arrays([_parted(pa.int32(), doc[starts], blocks), none(1, pa.list_(pa.int32()))]),
        "last": pa.concat_arrays([_parted(pa.int32(), doc[stops - 1], blocks), none(1, pa.list_(pa.int32()))]),
        "best": pa.concat_arrays([_parted(pa.int32(), best, blocks), none(1, pa.list_(pa.int32()))]),
        "doc_ids": pa.concat_arrays([none(rows, pa.list_(ids.type)), _parted(ids.type, ids, np.array([0, len(ids)]))]),
        "lengths": pa.concat_arrays([none(rows, pa.list_(pa.int64())), _parted(pa.int64(), n, np.array([0, len(n)]))]),
    }
    return pa.RecordBatch.from_pydict(columns)


def build_index(docs: DataFrame, n_docs: int, n_terms: int, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The written index of docs(doc_id, text): for each segment one row a term, and one without term that lists its documents.

    term rows: df, payload (all blocks), and for each block its bytes (sizes), first and last document and the highest
    impact (best); documents are numbered inside the segment. The row without a term: doc_ids and lengths in terms.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for b in batches:
            whole = b.column(1).to_pylist()
            a = 0
            for k, text in enumerate(whole):
                size += len(text or b"") + 64
                if size >= segment_bytes:
                    ids.append(b.column(0).slice(a, k + 1 - a))
                    yield _segment(segment, pa.concat_arrays(ids), [*texts, *whole[a : k + 1]], n_docs, n_terms)
                    segment, ids, texts, size, a = segment + 1, [], [], 0, k + 1
            ids.append(b.column(0).slice(a))
            texts += whole[a:]
        if texts:
            yield _segment(segment, pa.concat_arrays(ids), texts, n_docs, n_terms)

    lists = "sizes array<int>, first array<int>, last array<int>, best array<int>"
    schema = f"segment long, term binary, df long, payload binary, {lists}, doc_ids array<{kind}>, lengths array<long>"
    return written(docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(run, schema), "index")


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, q): each term of each item and how often it stands there. item numbers rows; equal rows are one."""
    kind = dict(items.dtypes)["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, t, q) for k, text in enumerate(b.column(2).to_pylist()) for t, q in Counter(words_of(text)).items()]
            at = pa.array([k for k, _, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([t for _, t, _ in rows], pa.binary()), pa.array([q for *_, q in rows], pa.int64())], ["item", "item_id", "term", "q"])

    one = written(items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()), "items")  # numbers are fixed once written
    return one.select("item", "item_id", F.col("text").cast("binary")).mapInArrow(run, f"item long, item_id {kind}, term binary, q long")


def _lists(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().flatten().to_numpy().astype(np.int64)


class Shard:
    """The lists of one shard: blocks of a term stand together, documents are numbered over all segments."""

    def __init__(self, t: pa.Table, n_docs: int, n_terms: int):
        about = t.filter(pa.compute.is_null(t.column("term"))).sort_by("segment")
        self.doc_ids = about.column("doc_ids").combine_chunks().flatten()
        lengths = _lists(about, "lengths")
        self.m = length_norm(lengths, n_docs, n_terms)
        sizes = pa.compute.list_value_length(about.column("lengths")).to_numpy()
        base = dict(zip(about.column("segment").to_pylist(), (np.cumsum(sizes) - sizes).tolist()))
        t = t.filter(pa.compute.is_valid(t.column("term"))).sort_by([("term", "ascending"), ("segment", "ascending")])
        many = pa.compute.list_value_length(t.column("sizes")).to_numpy().astype(np.int64)
        move = np.repeat(np.array([base[s] for s in t.column("segment").to_pylist()], np.int64), many)
        self.first, self.last, self.best = _lists(t, "first") + move, _lists(t, "last") + move, _lists(t, "best")
        self.stop = np.cumsum(_lists(t, "sizes"))
        self.data = np.frombuffer(b"".join(t.column("payload").to_pylist()), np.uint8)
        terms = t.column("term").to_pylist()
        heads = [k for k in range(len(terms)) if not k or terms[k] != terms[k - 1]]
        edges = np.append(0, np.cumsum(many))
        self.blocks = [(int(edges[a]), int(edges[b])) for a, b in zip(heads, [*heads[1:], len(terms)])]
        self.weight = [t.column("w")[k].as_py() for k in heads]
        self.uses = [t.column("uses")[k].as_py() for k in heads]
        self.top = [int(self.best[a:b].max()) for a, b in self.blocks]
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def decode(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some blocks, given in order."""
        start = np.where(blocks > 0, self.stop[blocks - 1], 0)
        size = self.stop[blocks] - start
        data = self.data[start[0] : self.stop[blocks[-1]]] if blocks[-1] - blocks[0] + 1 == len(blocks) else self.data[ragged(start, size)]
        gap, tf = decoded(data).reshape(-1, 2).T
        ends = np.cumsum(data < 128)[np.cumsum(size) - 1] // 2  # postings up to each block's end
        head = np.append(0, ends[:-1])
        run = np.cumsum(gap)
        docs = run + np.repeat(self.first[blocks] - run[head], ends - head)
        return docs, impact(tf, self.m[docs])

    def full(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        if term not in self.whole:
            self.whole[term] = self.decode(np.arange(*self.blocks[term]))
        return self.whole[term]

    def search(self, wanted: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the best k, ties at the k-th score included, and their scores; wanted: (term, factor)."""
        wanted = sorted(((self.top[t] * f, t, f) for t, f in wanted if f > 0), reverse=True)
        left = np.append(np.cumsum([b for b, _, _ in wanted][::-1])[::-1], 0)
        score = np.zeros(len(self.m), np.int64)
        least, at = 1, 0
        while at < len(wanted) and left[at] >= least:  # essential lists
            _, term, factor = wanted[at]
            docs, gain = self.full(term)
            score[docs] += factor * gain
            if len(score) >= k:
                least = max(least, int(np.partition(score, -k)[-k]))
            at += 1
        found = np.flatnonzero(score)
        have = score[found]
        for j in range(at, len(wanted)):
            _, term, factor = wanted[j]
            a, b = self.blocks[term]
            block = a + np.searchsorted(self.last[a:b], found)
            inside = block < b
            inside[inside] = self.first[block[inside]] <= found[inside]
            most = np.zeros(len(found), np.int64)
            most[inside] = factor * self.best[block[inside]]
            keep = have + most + left[j + 1] >= least
            found, have, block, inside = found[keep], have[keep], block[keep], inside[keep]
            if inside.any():
                docs, gain = self.whole[term] if term in self.whole else self.decode(np.unique(block[inside]))
                place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                have = have + np.where(docs[place] == found, factor * gain[place], 0)
            if len(have) >= k:
                least = max(least, int(np.partition(have, -k)[-k]))
        keep = have >= least
        return found[keep], have[keep]


def search(docs: DataFrame, items: DataFrame, k: int = 10, segment_bytes: int = SEGMENT_BYTES, shard_docs: int = SHARD_DOCS, items_together: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of docs(doc_id, text) for each of items(item_id, text).

    Scores are above 0; equal scores go by ascending doc_id, a null one last. Null and empty texts have no terms: such
    documents are never found, such items have no rows. A document row that repeats is found as often; item rows that
    are equal count once, items of equal id and other texts are searched each by itself. Columns of other names are
    not read. Without documents or items there are no rows.
    """
    spark, kinds = docs.sparkSession, {**dict(docs.select("doc_id").dtypes), **dict(items.select("item_id").dtypes)}
    n_docs, n_terms = corpus_counts(docs)
    index = build_index(docs, n_docs, n_terms, segment_bytes)
    terms = written(item_terms(items), "terms")
    n_items = terms.agg(F.countDistinct("item")).first()[0]
    groups, shards = max(1, math.ceil(n_items / items_together)), max(1, math.ceil(n_docs / shard_docs), math.ceil(n_terms / SHARD_TERMS))
    df = index.select("term", "df").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    batch = F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int")
    uses = terms.withColumn("batch", batch).groupBy("batch", "term").agg(F.collect_list(F.struct("item", "item_id", "q")).alias("uses"))
    uses = written(uses.join(df.select("term", weight.alias("w")), "term"), "uses")
    shard = F.pmod(F.xxhash64("segment"), F.lit(shards)).cast("int").alias("shard")
    lists = index.where("term is not null").join(uses, "term").drop("df")
    about = index.where("term is null").drop("df").withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = lists.unionByName(about, allowMissingColumns=True).select(shard, "*")

    def run(t: pa.Table) -> pa.Table:
        s = Shard(t, n_docs, n_terms)
        wanted: dict[int, list] = {}
        names = {}
        for term, uses in enumerate(s.uses):
            for use in uses:
                wanted.setdefault(use["item"], []).append((term, use["q"] * s.weight[term]))
                names[use["item"]] = use["item_id"]
        rows = []
        for item, its in wanted.items():
            found, score = s.search(its, k)
            ids = s.doc_ids.take(pa.array(found)).to_pylist()
            best = sorted(zip(score.tolist(), ids), key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]
            rows += [(item, names[item], i, v) for v, i in best]
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=["item", "item_id", "doc_id", "score"])

    types = [pa.int64(), *(f.type for f in _arrow_types(docs, items)), pa.int64()]
    best = dealt.groupBy("shard", "batch").applyInArrow(run, f"item long, item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _arrow_types(docs: DataFrame, items: DataFrame) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [to_arrow_schema(items.select("item_id").schema).field(0), to_arrow_schema(docs.select("doc_id").schema).field(0)]
