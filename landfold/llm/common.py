"""Shared pieces of the training-data operators: numbering, blocks of pairs, keys of texts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landfold.tables import forget, new_path, runs, shared_dir, written

__all__ = ["coded", "decoded", "forget", "labels_of_pairs", "new_path", "numbered", "passes_for", "ragged", "runs", "shared_dir", "shuffle_partitions", "text_key", "text_or_empty", "with_block_pairs", "words_of", "written"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(name: str = "text") -> Column:
    """16 bytes that stand for the whole text; equal texts have equal keys."""
    return F.unhex(F.md5(text_or_empty(name).cast("binary")))


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with ``n``: 0, 1, 2 ... within each value of group (not null) in the given order.

    Rows are range-partitioned and sorted, so that one hot group spreads over many partitions; only one count
    for each group and partition is gathered. The sorted rows are written first, so that both reads agree.
    """
    spark = df.sparkSession
    rows = written(
        df.repartitionByRange(shuffle_partitions(spark), group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("_at", F.monotonically_increasing_id()),
        name,
    ).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return rows.join(parts, [group, "_part"]).withColumn("n", F.col("_before") + F.col("_at") - F.col("_first")).drop("_before", "_first")


def with_block_pairs(df: DataFrame, size: str, member: str, most: int) -> DataFrame:
    """Deal a group's rows to chunks of about ``most`` and send each row to every pair of chunks it is part of.

    Adds ``chunk, i, j``. A group of ``size`` rows makes c = ceil(size / most) chunks and c (c + 1) / 2 pairs, so
    that one huge group is compared in many bounded tasks. Most groups have one chunk and one pair.
    """
    chunks = F.ceil(F.col(size) / F.lit(most)).cast("int")
    return (
        df.withColumn("_chunks", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64(member), F.col("_chunks")).cast("int"))
        .withColumn("_other", F.explode(F.expr("sequence(0, _chunks - 1)")))
        .withColumn("i", F.least("chunk", "_other"))
        .withColumn("j", F.greatest("chunk", "_other"))
        .drop("_chunks", "_other")
    )


def labels_of_pairs(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the pairs a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    return label


def passes_for(target: float, hit: float) -> int:
    """Independent tries that find a pair with probability target, if one try finds it with probability hit."""
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - min(hit, 1 - 1e-9))))


#: What parts words, as a table of bytes: all ASCII but digits and letters becomes a space, A-Z become lower case, other bytes stay.
_PARTING = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text: runs of ASCII digits, letters (A-Z lower-cased) and all characters beyond ASCII."""
    return text.translate(_PARTING).split() if text else []


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 ... for as many as lengths[0], then the same from starts[1], and so on."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the lowest first, all but a number's last marked; and where each one ends."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 9):
        sizes += values >= 1 << 7 * k
    ends = np.cumsum(sizes)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[ends[has] - sizes[has] + k] = values[has] >> 7 * k & 127 | np.where(sizes[has] > k + 1, 128, 0)
    return out, ends


def decoded(data: np.ndarray) -> np.ndarray:
    """The numbers of ``coded``."""
    last = np.flatnonzero(data < 128)
    first = np.append(0, last[:-1] + 1)
    sizes = last - first + 1 if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[has] |= (data[first[has] + k] & 127).astype(np.int64) << 7 * k
    return out
