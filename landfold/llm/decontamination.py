"""Benchmark decontamination: suffix arrays over shards of the training text, in which every test suffix is searched.

Words are numbered by the test items' vocabulary; a word that no item has is 0 and matches nothing, and a 0 stands between
documents. A task takes its documents as shards of bounded size, sorts the suffixes that start at a known word by their
first ten words at least (ranks of longer and longer prefixes), and finds every test suffix by binary search, all at once.
Neighbouring hits on a diagonal are parts of one verbatim match.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from landfold.llm.common import ragged, words_of

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: A shard ends with the document that brings it to so many bytes of text.
SHARD_BYTES = 8 << 20
#: Items are searched in batches of about so many bytes of text, each sent to the tasks; more batches pass over the documents again.
BATCH_BYTES = 8 << 20


class Windows:
    """The distinct windows of a batch of items, the items that hold each and where."""

    def __init__(self, items: list[tuple[str | None, bytes | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name or "" for name, _ in items})
        place = {name: k for k, name in enumerate(self.names)}
        seen: dict[tuple, int] = {}
        which, item, at = [], [], []
        for name, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for a in range(max(len(words) - WINDOW, 0) + 1 if words else 0):
                which.append(seen.setdefault(tuple(words[a : a + WINDOW]), len(seen)))
                item.append(place[name or ""])
                at.append(a)
        self.length = np.array([len(w) for w in seen], np.int64)
        self.words = np.zeros((len(seen), WINDOW), np.int64)
        for k, w in enumerate(seen):
            self.words[k, : len(w)] = w
        order = np.argsort(which, kind="stable")
        self.item, self.at = np.array(item, np.int64)[order], np.array(at, np.int64)[order]
        self.edges = np.append(0, np.cumsum(np.bincount(np.array(which, np.int64), minlength=len(seen))))


def suffix_array(words: np.ndarray, known: int) -> np.ndarray:
    """Starts of the suffixes whose first word is not 0, in the order of their first WINDOW words, up to the first 0, or more."""
    at = np.flatnonzero(words)
    depth = max(1, min(WINDOW, 62 // max(known.bit_length(), 1)))
    rank = np.zeros(len(words) + 64, np.int64)
    key = np.zeros(len(at), np.int64)
    padded = np.append(words, np.zeros(64, np.int64))
    for k in range(depth):
        key = key * (known + 1) + padded[at + k]
    while True:
        values, inverse = np.unique(key, return_inverse=True)
        if depth >= WINDOW or len(values) == len(at):
            return at[np.argsort(inverse, kind="stable")]
        rank[at] = inverse + 1
        key = rank[at] * (len(values) + 1) + rank[at + depth]
        depth *= 2


def found(words: np.ndarray, suffixes: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """For each window the range of the suffix array whose suffixes begin with it."""
    padded = np.append(words, np.zeros(WINDOW, np.int64))
    inside = np.arange(WINDOW) < windows.length[:, None]
    wanted = windows.words
    ends = []
    for right in (False, True):  # the first suffix not before the window; the first one after it
        lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(suffixes))
        while (lo < hi).any():
            mid = (lo + hi) // 2
            have = padded[suffixes[np.minimum(mid, len(suffixes) - 1)][:, None] + np.arange(WINDOW)]
            other = (have != wanted) & inside
            first = other.argmax(axis=1)
            row = np.arange(len(wanted))
            less = np.where(other.any(axis=1), have[row, first] < wanted[row, first], right)
            go = lo < hi
            lo, hi = np.where(go & less, mid + 1, lo), np.where(go & ~less, mid, hi)
        ends.append(lo)
    return ends[0], ends[1]


def _shard(texts: list[bytes | None], windows: Windows) -> tuple[np.ndarray, list[list], list[list]]:
    """Words of each document, its spans of hit words, and for each item its longest match (item, start, length)."""
    flat, n = array("q"), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = words_of(text)
        n[k] = len(words)
        flat.extend(map(windows.vocabulary.get, words, repeat(0)))
        flat.append(0)
    words = np.frombuffer(flat, np.int64)
    starts = np.cumsum(n + 1) - (n + 1)
    suffixes = suffix_array(words, len(windows.vocabulary))
    lo, hi = found(words, suffixes, windows)
    many = hi - lo
    place, which = suffixes[ragged(lo, many)], np.repeat(np.arange(len(many)), many)
    step = np.bincount(place, minlength=len(words) + 1) - np.bincount(place + windows.length[which], minlength=len(words) + 1)
    hit = np.diff((np.cumsum(step) > 0).astype(np.int8), prepend=0)
    a, b = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
    of = np.searchsorted(starts, a, "right") - 1
    spans: list[list] = [[] for _ in texts]
    for doc, first, last in zip(of.tolist(), (a - starts[of]).tolist(), (b - starts[of]).tolist()):
        spans[doc].append((first, last))
    # one row for each place, item and place in the item; runs on a diagonal are one match
    each = (windows.edges[1:] - windows.edges[:-1])[which]
    held = ragged(windows.edges[:-1][which], each)
    place, item, at, length = np.repeat(place, each), windows.item[held], windows.at[held], np.repeat(windows.length[which], each)
    order = np.lexsort((place, place - at, item))
    place, item, at, length = place[order], item[order], at[order], length[order]
    new = np.ones(len(place), bool)
    new[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(place))) - 1 + length[first] if len(first) else first
    first, item = place[first], item[first]
    doc = np.searchsorted(starts, first, "right") - 1
    order = np.lexsort((first, -size, item, doc))
    doc, item, first, size = doc[order], item[order], first[order], size[order]
    best = np.ones(len(doc), bool)
    best[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    matches: list[list] = [[] for _ in texts]
    for d, i, p, s in zip(*(v[best].tolist() for v in (doc, item, first - starts[doc], size))):
        matches[d].append((windows.names[i], p, s))
    return n, spans, matches


def _joined(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """Two sorted lists of spans as one, spans that touch or overlap united."""
    out: list[tuple] = []
    for first, last in sorted([*a, *b]):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _longest(a: list[tuple], b: list[tuple]) -> list[tuple]:
    best: dict[str, tuple] = {}
    for name, start, length in [*a, *b]:
        if name not in best or (-length, start) < (-best[name][2], best[name][1]):
            best[name] = (name, start, length)
    return [best[name] for name in sorted(best)]


OUT = "n_words long, hits array<struct<start:int,end:int>>, matches array<struct<item_id:string,start:int,length:int>>"


def find_leaks(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """docs, all columns kept, with n_words, hits and matches against items(item_id, text).

    hits: spans of words (end exclusive) inside any occurrence of a window: 10 consecutive words of an item, or all words
    of a shorter one. matches: for each item with an occurring window its longest verbatim match, the first of equal
    ones, by item_id as a string. Null and empty texts have no words, in docs and in items. A null item_id is the item ''; rows
    of one item_id are one item with the windows of all. Document rows that repeat each get their own result. Columns
    of docs named as the results are replaced; without items nothing is hit, without documents there are no rows.

    Documents are not shuffled. Items go to the tasks in batches whose size is counted first.
    """
    spark = docs.sparkSession
    size = F.length(F.coalesce(F.col("text"), F.lit("")).cast("binary")) + 64
    batches = max(1, math.ceil((items.agg(F.sum(size)).first()[0] or 0) / batch_bytes))
    kept = [c for c in docs.columns if c not in ("n_words", "hits", "matches")]
    out = docs.select(*kept)
    schema = StructType([*out.schema.fields, *StructType.fromDDL(OUT).fields])
    types = to_arrow_schema(StructType.fromDDL(OUT))

    def passed(df: DataFrame, windows) -> DataFrame:
        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = windows.value

            def done(held: list[pa.RecordBatch], texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
                n, spans, matches = _shard(texts, own)
                t = pa.Table.from_batches(held)
                if "hits" in t.column_names:
                    spans = [_joined([(s["start"], s["end"]) for s in a], b) for a, b in zip(t.column("hits").to_pylist(), spans)]
                    matches = [_longest([tuple(m.values()) for m in a], b) for a, b in zip(t.column("matches").to_pylist(), matches)]
                columns = [*(t.column(c) for c in kept), pa.array(n), pa.array(spans, types.field("hits").type), pa.array(matches, types.field("matches").type)]
                yield from pa.Table.from_arrays(columns, names=[*kept, *types.names]).to_batches()

            held, texts, size = [], [], 0
            for b in frames:
                whole, a = b.column(b.num_columns - 1).to_pylist(), 0
                for k, text in enumerate(whole):
                    size += len(text or b"") + 64
                    if size >= shard_bytes:
                        yield from done([*held, b.slice(a, k + 1 - a)], [*texts, *whole[a : k + 1]])
                        held, texts, size, a = [], [], 0, k + 1
                if a < len(whole):
                    held.append(b.slice(a))
                    texts += whole[a:]
            if texts:
                yield from done(held, texts)

        return df.withColumn("_bytes", F.col("text").cast("binary")).mapInArrow(run, schema)

    dealt = items.select(F.col("item_id").cast("string"), F.col("text").cast("binary"), F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)).alias("_batch"))
    for k in range(batches):
        mine = [(r[0], bytes(r[1]) if r[1] is not None else None) for r in dealt.where(F.col("_batch") == k).collect()]  # about batch_bytes
        out = passed(out, spark.sparkContext.broadcast(Windows(mine)))
    return out


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents none of whose words are hit, as they are."""
    return find_leaks(docs, items).where("size(hits) = 0").drop("n_words", "hits", "matches")
