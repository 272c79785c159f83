"""Mixing sources to target weights by Pfair scheduling.

A source with weight w gives its k-th block the release time floor(k / w) and the deadline ceil((k + 1) / w).
Earliest deadline first among the released blocks puts every block inside its window, so that at any time each
source is less than one block away from its share. Weights are taken as the exact fractions that they are, so that no
rounding adds up. The walk over the blocks (not the documents) runs on the driver.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landfold.llm.common import numbered, shuffle_partitions, text_or_empty

#: Sources that the driver holds a weight for, and blocks that it walks over.
MOST_SOURCES, MOST_BLOCKS = 100_000, 1 << 20


def whole_shares(weights: Mapping[str, float], cycle: int) -> dict[str, int]:
    """Weights as whole shares that sum to the cycle; at least one each; largest remainders are rounded up."""
    total = float(sum(weights.values()))
    exact = {s: w / total * cycle for s, w in weights.items()}
    shares = {s: max(1, int(x)) for s, x in exact.items()}
    names = sorted(weights, key=lambda s: (shares[s] - exact[s], s))
    while (gap := cycle - sum(shares.values())) != 0:
        for s in names if gap > 0 else reversed(names):
            if gap and (gap > 0 or shares[s] > 1):
                shares[s] += 1 if gap > 0 else -1
                gap += -1 if gap > 0 else 1
    return shares


def block_table(weights: Mapping[str, float], blocks: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) by slot: earliest deadline first over the blocks of each source.

    Blocks beyond a source's last are not walked: the slots that would be theirs are left to others inside their
    windows, or stay empty.
    """
    if any(not 0 < w < math.inf for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    common = math.gcd(*whole.values())
    whole = {s: w // common for s, w in whole.items()}
    total, out, slot = sum(whole.values()), [], 0
    waiting = [(0, s, 0) for s in sorted(whole) if blocks[s]]
    ready: list[tuple[int, str, int, int]] = []
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // whole[s]), s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        out.append((s, k, release, deadline, slot))
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // whole[s], s, k + 1))
        slot += 1
    return out


def cycle_table(shares: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """(source, block in cycle, slot in cycle): one cycle of whole shares, after which the schedule repeats."""
    return [(s, k, slot) for s, k, _, _, slot in block_table(shares, shares)]


def source_chars(docs: DataFrame) -> dict[str, int]:
    """A source's characters, one more for each row. One row a source reaches the driver; more than MOST_SOURCES are an error."""
    sums = docs.groupBy(source_name().alias("s")).agg(F.sum(F.length(text_or_empty()) + 1).alias("c")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources: a source of the mix is a name with a target weight, group finer ones first")
    return {r["s"]: r["c"] for r in sums}


def block_size(chars: Mapping[str, int], least: int, most: int | None = None) -> int:
    """``least`` doubled until all sources together make at most ``most`` (MOST_BLOCKS) blocks, so that the driver's walk is bounded."""
    size, bound = least, max(MOST_BLOCKS if most is None else most, 2 * len(chars))
    while sum(-(-c // size) for c in chars.values()) > bound:
        size *= 2
    return size


def tempered_weights(chars: Mapping[str, int], power: float = 0.5) -> dict[str, float]:
    """A target weight for each source: its characters to the given power."""
    return {s: float(c) ** power for s, c in chars.items()}


def source_name() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def mixed_schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, block_chars: int = 1 << 16, cycle: int | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, source, key, n_rows, block_no, release, deadline, slot) for every distinct document.

    A source's documents stand in an order drawn from ``seed`` and are cut into blocks of ``block_chars`` characters
    (a document belongs to the block where it begins, each counts one character more than its text). ``slot`` is the
    block's place in the interleaving. Sources without a weight (weights given) get the smallest given one, none is
    dropped; default weights are ``tempered_weights``. When a source has run out its slots go to blocks that are
    released, or stay empty, so that the others keep their ratios. Weights are not rounded; only if a ``cycle`` is
    given, they become whole shares of so many slots. One row a source and one a block are on the driver: at most
    MOST_SOURCES and MOST_BLOCKS, as blocks double in size beyond (64 KB up to some 60 GB of text, then 128 KB ...).
    Null text counts as empty, null source as the source ''. Equal rows are one row with ``n_rows`` of them, which
    share a block; rows with a null doc_id are told apart by text and source. No documents give no rows.
    """
    spark = docs.sparkSession
    chars = source_chars(docs) or {"": 0}
    found = tempered_weights(chars) if any(chars.values()) else {"": 1.0}
    if weights:
        least = min(weights.values())
        found = {s: weights.get(s, least) for s in found}
    if cycle is not None:
        if cycle < len(found):
            raise ValueError(f"{len(found)} sources do not fit a cycle of {cycle} slots")
        found = whole_shares(found, cycle)
    block_chars = block_size(chars, block_chars)
    placed = block_table(found, {s: -(-c // block_chars) for s, c in chars.items()})
    names = ["source", "block_no", "release", "deadline", "slot"]
    columns = zip(*placed) if placed else [[]] * 5
    table = spark.createDataFrame(pa.table([pa.array(list(c), t) for c, t in zip(columns, [pa.string()] + [pa.int64()] * 4)], names))

    narrow = docs.select("doc_id", source_name().alias("source"), F.length(text_or_empty()).alias("chars"), row_key().alias("key"))
    narrow = narrow.groupBy("doc_id", "source", "chars", "key").agg(F.count(F.lit(1)).alias("n_rows"))
    narrow = narrow.withColumn("draw", F.xxhash64("doc_id", "key", F.lit(seed)))
    rows = numbered(narrow, "source", ["draw", "key"], "mix")
    inside = Window.partitionBy("source", "_part")
    rows = rows.withColumn("_size", (F.col("chars") + 1) * F.col("n_rows"))
    rows = rows.withColumn("_sum", F.sum("_size").over(inside.orderBy("_at")) - F.col("_size"))
    parts = rows.groupBy("source", "_part").agg(F.sum("_size").alias("_all"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "_part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(parts, ["source", "_part"]).withColumn("block_no", F.expr(f"(_before + _sum) div {block_chars}"))
    return rows.join(table, ["source", "block_no"]).select("doc_id", "source", "key", "n_rows", "block_no", "release", "deadline", "slot")


def row_key() -> Column:
    return F.xxhash64(source_name(), text_or_empty())


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, all rows and columns as given, laid out in the schedule's order: written files follow the mix."""
    spark = docs.sparkSession
    plan = mixed_schedule(docs, **options).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("slot").alias("_slot"))
    rows = docs.withColumn("_row", row_key())
    rows = rows.join(plan, (F.col("_row") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return rows.repartitionByRange(shuffle_partitions(spark), "_slot", "_row").sortWithinPartitions("_slot", "_row").select(*docs.columns)
