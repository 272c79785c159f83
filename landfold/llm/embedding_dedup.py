"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors of a label lexicographically by the signs of random projections and compares every vector
with a window of neighbours: the blocks of rows before, at and after its own place, and all of its run, the rows with
equal leading signs, where that reaches farther. Verified pairs of all passes are united. A pair's chance to share a
run depends on its own angle only, so that the recall holds however the other vectors lie; windows add to it. Equal
vectors are first made one. Inside the united groups every pair is then compared, so that numbers of links are exact there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.llm.common import labels_of_pairs, numbered, passes_for, runs, shuffle_partitions, with_block_pairs, written
from landfold.llm.components import connected_components
from landfold.tables import joined_by_hot_key

#: Signs that a pass orders by.
BITS = 48
#: Rows of one side of a block of pairs, in the passes (what a window reaches at least) and inside groups.
RUN, CHUNK = 2048, 1024
#: Vectors of a label that its number of signs is chosen by, and comparisons that cost as much as one more row in a pass.
DRAWN, ROW_COST = 512, 2500


def _unit(values: np.ndarray) -> np.ndarray:
    x = np.array(values.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _plan(least: float, recall: float, row_cost: float, window: int):
    """The cheapest number of signs for a space, by the angles of a few of its vectors, and the passes that it takes."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        u, size = _unit(g["embedding"].to_numpy()), int(g["size"].iloc[0])
        same = 1 - np.arccos(np.clip(u @ u.T, -1, 1)) / np.pi
        same = same[~np.eye(len(u), dtype=bool)] if len(u) > 1 else np.ones(1)
        tries = [passes_for(recall, (1 - np.arccos(least) / np.pi) ** b) for b in range(BITS + 1)]
        met = [max(size * (same**b).mean(), min(size, 1.5 * window)) for b in range(BITS + 1)]
        bits = int(np.argmin([n * (row_cost + m) for n, m in zip(tries, met)]))
        return pd.DataFrame({"space": [g["space"].iloc[0]], "bits": [bits], "passes": [tries[bits]]})

    return run


def _keys(seed: int, window: int):
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for frame in frames:
            for space, part in frame.groupby("space"):
                x, bits, size = _unit(part["embedding"].to_numpy()), int(part["bits"].iloc[0]), int(part["size"].iloc[0])
                for turn in range(part["passes"].iloc[0]):
                    at = (x.shape[1], turn)
                    if at not in planes:
                        planes[at] = np.random.default_rng([seed, *at]).standard_normal((x.shape[1], BITS))
                    code = ((x @ planes[at]) > 0) @ weights
                    yield pd.DataFrame({"key": part["key"].to_numpy(), "space": space, "turn": np.int32(turn), "code": code, "lead": code >> BITS - bits, "last": (size - 1) // window})

    return run


def window_blocks(codes: DataFrame, window: int) -> DataFrame:
    """(space, turn, key, chunk, i, j): each row of a pass in every block of pairs of its window.

    codes: space, turn, code, lead, key, last (the pass's last chunk). Rows stand in the order of their codes and make
    chunks of ``window``; a row meets its own chunk, the one before and the one after, and in a run of equal leading signs that
    reaches farther all chunks of that run.
    """
    rows = numbered(codes.withColumn("_pass", F.struct("space", "turn")), "_pass", ["code", "key"], "passes").withColumn("chunk", F.expr(f"n div {window}"))
    rows = rows.withColumn("_run", F.struct("space", "turn", "lead"))
    far = rows.groupBy("_run").agg(F.min("chunk").alias("_a"), F.max("chunk").alias("_b"), F.count(F.lit(1)).alias("n")).where("_b - _a > 1")
    far = written(far, "runs")
    rows = joined_by_hot_key(rows.select("_run", "key", "chunk", "last"), far.select("_run", "_a", "_b"), "_run", F.col("key"), far, "left")
    other = F.explode(F.expr("sequence(least(coalesce(_a, chunk), greatest(chunk - 1, 0)), greatest(coalesce(_b, chunk), least(chunk + 1, last)))"))
    rows = rows.select(F.col("_run.space").alias("space"), F.col("_run.turn").alias("turn"), "key", "chunk", other.alias("_other"))
    return rows.withColumns({"i": F.least("chunk", "_other"), "j": F.greatest("chunk", "_other")}).drop("_other")


def _linked(least: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(frames, ["space", "turn", "i", "j"]):
            if len(g["key"]) < 2:
                continue
            i, j, chunk, key = g["i"][0], g["j"][0], g["chunk"], g["key"]
            u = _unit(g["embedding"])
            left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
            a, b = np.nonzero(u[left] @ u[right].T >= least)
            label = labels_of_pairs(len(key), left[a], right[b])
            moved = np.flatnonzero(label != np.arange(len(key)))
            if len(moved):
                yield pd.DataFrame({"a": key[moved], "b": key[label[moved]]})

    return run


def _count_links(least: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(frames, ["component", "i", "j"]):
            i, j, chunk = g["i"][0], g["j"][0], g["chunk"]
            u, many, key = _unit(g["embedding"]), g["copies"], g["key"]
            left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
            near = (u[left] @ u[right].T) >= least
            if i == j:
                np.fill_diagonal(near, False)
                yield pd.DataFrame({"key": key[left], "links": near @ many[right]})
            else:
                yield pd.DataFrame({"key": key[left], "links": near @ many[right]})
                yield pd.DataFrame({"key": key[right], "links": many[left] @ near})

    return run


def embedding_near_duplicates(vectors: DataFrame, least: float = 0.93, recall: float = 0.999, seed: int = 7, row_cost: float = ROW_COST, window: int = RUN) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors(vec_id, embedding, label).

    Two vectors are linked if their labels are equal and their cosine in double precision is at least ``least``.
    A pair just at ``least`` shares a pass's leading signs with a known probability, from which the number of passes
    follows so that it is compared with probability ``recall`` or more, whatever the other vectors are. The number
    of leading signs only weighs costs (``row_cost``: comparisons that cost as much as a row in one more pass); with
    none, as in dense cones, the window is the whole label. A label of at most ``window`` vectors lies in one window of its
    one pass. No pass is skipped and no partner is dropped.
    A vector that is null, empty, zero, or holds null or non-finite components, one with a null label, and one with
    a null vec_id link with nothing (0 links, own component, kept). Vectors of different length never link. Equal
    rows count as separate vectors linked to each other; an id given to several vectors joins their groups. Columns
    other than the three are ignored.
    """
    spark = vectors.sparkSession
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(good & ~broken & F.exists("embedding", lambda x: x != 0), F.lit(False))
    key = F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), F.transform("embedding", lambda x: x.cast("string"))).cast("binary")))
    rows = vectors.select("vec_id", "label", "embedding", F.when(good, key).alias("key"))
    space = F.xxhash64("label", F.size("embedding"))
    classes = written(
        rows.where("key is not null").groupBy("key", "label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).withColumn("space", space),
        "vectors",
    )
    sizes = classes.groupBy("space").agg(F.count(F.lit(1)).alias("size"))
    drawn = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) * F.col("size") < F.lit(DRAWN << 30)
    plans = classes.join(sizes, "space").where(drawn).select("space", "size", "embedding").groupBy("space")
    plans = sizes.select("space").join(written(plans.applyInPandas(_plan(least, recall, row_cost, window), "space long, bits int, passes int"), "plans"), "space", "left")
    plans = plans.na.fill({"bits": 0, "passes": 1}).join(sizes, "space")
    codes = classes.select("key", "space", "embedding").join(plans, "space").mapInPandas(_keys(seed, window), "key binary, space long, turn int, code long, lead long, last long")
    pairs = (
        window_blocks(codes, window)
        .join(classes.select("key", "embedding"), "key")
        .select("space", "turn", "i", "j", "chunk", "key", "embedding")
        .repartition(shuffle_partitions(spark), "space", "turn", "i", "j")
        .sortWithinPartitions("space", "turn", "i", "j")
        .mapInPandas(_linked(least), "a binary, b binary")
    )
    same_id = classes.groupBy("first_id").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("many")).where("many > 1")
    same_id = classes.join(same_id, "first_id").select(F.col("key").alias("a"), "b")
    groups = written(connected_components(pairs.union(same_id)), "groups")
    about = groups.join(classes.select("key", "first_id"), groups["node"] == F.col("key")).groupBy("component")
    about = written(about.agg(F.count(F.lit(1)).alias("n"), F.min("first_id").alias("lowest")), "sizes")
    # a component with many members is dealt over many tasks
    members = joined_by_hot_key(groups, about.select("component", F.col("n").alias("size"), "lowest"), "component", F.col("node"), about)
    members = members.join(classes, F.col("node") == classes["key"])
    links = (
        with_block_pairs(members.select("component", "size", "key", "copies", "embedding"), "size", "key", CHUNK)
        .repartition(shuffle_partitions(spark), "component", "i", "j")
        .sortWithinPartitions("component", "i", "j")
        .mapInPandas(_count_links(least), "key binary, links long")
        .groupBy("key")
        .agg(F.sum("links").alias("links"))
    )
    about = (
        classes.select("key", "first_id", "copies")
        .join(members.select("key", "lowest"), "key", "left")
        .join(links, "key", "left")
        .select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lowest", "first_id").alias("component_id"))
    )
    # rows without a key meet nothing; a stand-in for it keeps them from one task
    alone = F.concat(F.lit("without key "), F.xxhash64("vec_id", "label", "embedding").cast("string")).cast("binary")
    joined = joined_by_hot_key(rows.select("vec_id", F.coalesce("key", alone).alias("key")), about, "key", F.col("vec_id"), classes.select("key", F.col("copies").alias("n")), "left")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").cast("long").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )
