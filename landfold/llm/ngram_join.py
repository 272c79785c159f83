"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Each distinct text gets minima of its word shingles under many hash functions. A tree of the forest orders texts by
the minima in its own order; texts that share a prefix are a node of its trie. The descent begins with the longest
prefixes, whose nodes are taken as groups. Prefixes are then shortened to the depth at which all trees together find a
pair just at the threshold with the target recall; a node whose texts are one group by then is not looked at again.
In the others, sorted by their paths, neighbours are compared first and then what is still apart; texts whose
signatures agree enough are grouped. Inside each group every pair is verified on the whole shingle sets, in bounded
blocks, so that links inside a group are exact.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.llm.common import forget, labels_of_pairs, runs, shuffle_partitions, text_key, text_or_empty, with_block_pairs, written
from landfold.llm.components import connected_components
from landfold.tables import joined_by_hot_key

WORD = re.compile(r"\w+")
#: A tree's path begins with STEP minima of its own and goes on with those of the trees after it, in a ring, to DEPTH.
TREES, STEP, DEPTH = 24, 6, 18
#: Texts on one side of a block of pairs: by signatures, by whole shingle sets; and characters there.
ROUGH, EXACT, EXACT_CHARS = 512, 512, 1 << 22
REMEMBERED = 1_000_000
MIX = np.random.default_rng(20).integers(1, 2**63, (3, TREES * STEP), dtype=np.uint64) | np.uint64(1)


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def shingles(text: str, width: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` lower-cased words; a shorter text is one run; no word, none."""
    words = WORD.findall(text.lower())
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    take = min(width, len(h))
    out = np.full(len(h) - take + 1, len(h) if len(h) < width else width, np.uint64)
    for k in range(take):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - take + 1 + k]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(sh: np.ndarray) -> np.ndarray:
    """TREES * STEP minima of 32 bits, in slices of bounded size."""
    low = np.full(TREES * STEP, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(sh), 1024):
        low = np.minimum(low, (sh[a : a + 1024, None] * MIX[0] + MIX[1]).min(axis=0))
    return ((low ^ (low >> np.uint64(31))) >> np.uint64(8)).astype(">u4")


def depth_for(threshold: float, recall: float) -> int:
    """The longest prefix, of a tree's own minima, at which a pair just at the threshold shares one in some tree with the target recall."""
    for depth in range(STEP, 0, -1):
        if 1 - (1 - threshold**depth) ** TREES >= recall:
            return depth
    raise ValueError(f"{TREES} trees cannot reach a recall of {recall} at a similarity of {threshold}")


def least_agreement(threshold: float, miss: float = 1e-6) -> float:
    """The share of equal minima that a pair at the threshold falls below with probability ``miss`` at most (binomial tail)."""
    n, tail = TREES * STEP, 0.0
    for k in range(n + 1):
        tail += math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k)
        if tail > miss:
            return k / n
    return 1.0


def _signatures(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for frame in frames:
            keys, sigs = [], []
            for key, text in zip(frame["key"], frame["text"]):
                sh = shingles(text, width, hashes)
                if len(sh):
                    keys.append(key)
                    sigs.append(signature(sh).tobytes())
            yield pd.DataFrame({"key": keys, "sig": sigs})

    return run


def _rough(least: float):
    """Pairs that join what is apart in a node of a trie: ``group`` tells what is together already."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for g in runs(frames, ["bucket", "i", "j"]):
            key, chunk, across = g["key"], g["chunk"], g["i"][0] != g["j"][0]
            n = len(key)
            sig = np.frombuffer(b"".join(g["brief"]), np.uint8).reshape(n, -1)
            label = np.unique(g["group"], return_inverse=True)[1]
            # neighbours in the sorted trie share the longest prefixes: most texts of one group are joined here
            close = np.flatnonzero((sig[1:] == sig[:-1]).mean(axis=1) >= least)
            a, b = [close], [close + 1]
            whole = labels_of_pairs(label.max() + 1, label[close], label[close + 1])
            label = whole[label]
            order = np.argsort(label, kind="stable")
            edges = np.flatnonzero(np.diff(label[order])) + 1
            if len(edges):
                for part in np.split(order, edges):
                    later = np.flatnonzero(label > label[part[0]])
                    for row in part if len(later) else ():
                        other = later[chunk[later] != chunk[row]] if across else later
                        near = other[(sig[other] == sig[row]).mean(axis=1) >= least]
                        a.append(np.full(len(near), row))
                        b.append(near)
            out.extend(zip(key[np.concatenate(a)], key[np.concatenate(b)]))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def near_matrix(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of at least the threshold, from whole shingle sets."""
    ids, where = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = [len(s) for s in (*left, *right)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    often = np.bincount(where, minlength=len(ids)) > 1
    column = np.cumsum(often) - 1
    keep = often[where]
    owner, column = owner[keep], column[where[keep]]
    shared = np.zeros((len(left), len(right)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        a, b = np.searchsorted(column, [first, first + 8192])
        block = np.zeros((len(sizes), 8192 if column[-1] - first >= 8192 else int(column[-1]) - first + 1), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        shared += block[: len(left)] @ block[len(left) :].T
    n, m = np.array(sizes[: len(left)])[:, None], np.array(sizes[len(left) :])[None, :]
    return shared >= threshold * (n + m - shared) - 1e-9


def _verified(width: int, threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        out: list[tuple] = []
        for g in runs(frames, ["component", "i", "j"]):
            _, once = np.unique(g["key"], return_index=True)  # a repeated row stands for the same text
            key, chunk, many, i, j = g["key"][once], g["chunk"][once], g["copies"][once], g["i"][0], g["j"][0]
            sets = [shingles(t, width, hashes) for t in g["text"][once]]
            left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
            near = near_matrix([sets[k] for k in left], [sets[k] for k in right], threshold)
            if i == j:
                np.fill_diagonal(near, False)
            links = np.zeros(len(key), np.int64)
            links[left] += near @ many[right]
            if i != j:
                links[right] += many[left] @ near
            a, b = np.nonzero(near)
            label = labels_of_pairs(len(key), left[a], right[b])
            out.extend(zip(key, links.tolist(), key[label]))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["key", "links", "root"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["key", "links", "root"])

    return run


def similar_texts(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """(key, copies, first_id, links, class_id, keep_key), one row for each distinct text of docs(doc_id, text).

    Texts link if the Jaccard similarity of their sets of ``width``-word shingles (lower-cased words of letters,
    digits and underscores) is at least the threshold. ``copies``: rows with this text; ``first_id``: their smallest
    doc_id; ``links``: rows with other texts that link to it; ``class_id``: the smallest doc_id reachable by links;
    ``keep_key``: key of the text that holds it. Null text counts as empty; a text without words links only to equal
    texts; one of fewer than ``width`` words is one shingle. Null doc_id: smallest only if there is no other.
    """
    spark, parts = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    keyed = docs.select("doc_id", text_key().alias("key"), text_or_empty().alias("text"))
    # every copy is signed where it is read; equal texts then meet as small rows, one a task
    signed = keyed.select("key", "text").mapInPandas(_signatures(width), "key binary, sig binary")
    texts = written(signed.dropDuplicates(["key"]), "signatures")
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    paths = texts.select("key", "sig", tree.alias("tree")).select("key", "tree", F.expr(f"substring(concat(sig, sig), tree * {4 * STEP} + 1, {4 * DEPTH})").alias("path"))

    # the longest prefixes: texts that share one are a group
    nodes = paths.select("key", F.xxhash64("tree", "path").alias("node"))
    heads = nodes.groupBy("node").agg(F.min("key").alias("b"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n")).where("b <> last")
    heads = written(heads.select("node", "b", "n"), "nodes")
    deep = written(connected_components(joined_by_hot_key(nodes, heads.select("node", "b"), "node", F.col("key"), heads).select(F.col("key").alias("a"), "b").where("a <> b")), "deep")

    # the shortened prefixes: only nodes that hold more than one group
    depth = depth_for(threshold, recall)
    group = F.xxhash64(F.coalesce("component", "key"))
    grouped = texts.join(deep, texts["key"] == deep["node"], "left").select("key", "sig", group.alias("group"), tree.alias("tree"))
    short = F.xxhash64("tree", F.expr(f"substring(sig, tree * {4 * STEP} + 1, {4 * depth})"))
    buckets = grouped.select("key", "group", "tree", short.alias("bucket"))
    shared = written(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("_low"), F.max("group").alias("_high")).where("_low <> _high").select("bucket", "n"), "mixed")
    together = joined_by_hot_key(buckets, shared.withColumn("size", F.col("n")), "bucket", F.col("key"), shared)
    brief = F.expr("unhex(array_join(transform(sequence(1, {0}), k -> hex(substring(sig, 4 * k, 1))), ''))".format(TREES * STEP))
    path = F.expr(f"substring(concat(sig, sig), tree * {4 * STEP} + 1, {4 * DEPTH})")
    edges = (
        with_block_pairs(together, "size", "key", ROUGH)
        .join(texts.select("key", "sig"), "key")
        .select("bucket", "i", "j", "chunk", "key", "group", path.alias("path"), brief.alias("brief"))
        .repartition(parts, "bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j", "path")
        .drop("path")
        .mapInPandas(_rough(least_agreement(threshold)), "a binary, b binary")
    )
    groups = written(connected_components(edges.union(deep.select("node", "component"))), "groups")
    counts = written(keyed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first(F.length("text")).alias("chars")), "texts")
    members = groups.join(counts, groups["node"] == counts["key"]).select("component", "key", "copies", "first_id", "chars")
    sizes = written(members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")), "sizes")
    # so many rows as make blocks of bounded number and length
    size = F.greatest(F.col("n"), F.expr(f"cast(ceil(chars * {EXACT} / {EXACT_CHARS}) as long)"))
    members = joined_by_hot_key(members.drop("chars"), sizes.select("component", size.alias("size")), "component", F.col("key"), sizes)
    bodies = keyed.withColumnRenamed("doc_id", "_id").withColumnRenamed("key", "_key")
    first = (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("first_id"))
    checked = written(
        with_block_pairs(members.join(bodies, first).select("component", "size", "key", "copies", "text"), "size", "key", EXACT)
        .repartition(parts, "component", "i", "j")
        .sortWithinPartitions("component", "i", "j")
        .mapInPandas(_verified(width, threshold), "key binary, links long, root binary"),
        "verified",
    )
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    joined = connected_components(checked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = written(joined.join(counts.select("key", "first_id"), joined["node"] == F.col("key")).select("component", "key", "first_id"), "named")
    lowest = F.min_by(F.struct(F.col("first_id").alias("class_id"), F.col("key").alias("keep_key")), F.struct(F.col("first_id").isNull(), "first_id", "key"))
    best = written(named.groupBy("component").agg(lowest.alias("best"), F.count(F.lit(1)).alias("n")), "best")
    chosen = joined_by_hot_key(named.drop("first_id"), best.drop("n"), "component", F.col("key"), best).select("key", "best.*")
    about = written(
        counts.join(links, "key", "left")
        .join(chosen, "key", "left")
        .select("key", "copies", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("keep_key", "key").alias("keep_key")),
        "classes",
    )
    for done in (texts, heads, deep, shared, groups, counts, sizes, checked, named, best):
        forget(done)
    return about


def ngram_jaccard_join(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """(doc_id, class_id, n_links, kept), one row for each row of docs.

    ``class_id``: the smallest doc_id reachable over links, copies included; ``n_links``: other rows linked directly,
    copies included; ``kept``: the row holds the class's smallest doc_id (rows that repeat it are all kept; a class
    without any doc_id keeps its rows). See ``similar_texts`` for nulls, empty and short texts.
    """
    about = similar_texts(docs, width, threshold, recall)
    rows = docs.select("doc_id", text_key().alias("key"))
    return joined_by_hot_key(rows, about.drop("first_id"), "key", F.col("doc_id"), about.withColumnRenamed("copies", "n")).select(
        "doc_id",
        "class_id",
        (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("keep_key"))).alias("kept"),
    )


def one_of_each(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """docs with one row of each class of near copies, all columns kept; rows that repeat an id and text count as copies."""
    about = similar_texts(docs, width, threshold, recall)
    keep = about.where(F.col("key") == F.col("keep_key")).select(F.col("key").alias("_keep"), F.col("class_id").alias("_first"))
    rows = docs.withColumn("_key", text_key())
    kept = rows.join(keep, (F.col("_key") == F.col("_keep")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    repeated = docs.select("doc_id", text_key().alias("_key")).groupBy("doc_id", "_key").count().where("count > 1")
    if repeated.take(1):  # else a shuffle of whole texts for nothing
        kept = kept.dropDuplicates(["doc_id", "_key"])
    return kept.select(*docs.columns)
