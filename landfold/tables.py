"""Written intermediate tables, runs of sorted rows, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Graphs of at most so many edges are solved in one task, with the same result as by rounds.
SMALL_GRAPH = 300_000
#: A key with more rows than the first number may be dealt over many tasks; at most the second number of keys are.
HOT_ROWS, HOT_KEYS = 1500, 256


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where unset on one machine (tests) a local one is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="landfold-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/landfold/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def runs(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Each run of rows with equal keys, as one array a column, from frames sorted by the keys."""
    held: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for frame in frames:
        if not len(frame):
            continue
        columns = {c: frame[c].to_numpy() for c in frame.columns}
        new = np.zeros(len(frame), bool)
        for k in keys:
            new[1:] |= columns[k][1:] != columns[k][:-1]
        if held and any(held[-1][k][-1] != columns[k][0] for k in keys):
            yield joined()
            held = []
        edges = [0, *np.flatnonzero(new).tolist(), len(frame)]
        for a, b in zip(edges, edges[1:]):
            if a:
                yield joined()
                held = []
            held.append({c: v[a:b] for c, v in columns.items()})
    if held:
        yield joined()


def joined_by_hot_key(big: DataFrame, small: DataFrame, key: str, spread: Column, counts: DataFrame, how: str = "inner") -> DataFrame:
    """big joined with small, which holds each value of ``key`` once, so that no value gathers a large part of big.

    counts: (key, n), the rows of big for each value. The at most HOT_KEYS largest values of more than HOT_ROWS rows
    are dealt over as many salts as there are shuffle partitions, by a hash of ``spread``, and their rows of small
    repeated as often; any other value has less than 1/HOT_KEYS of the rows. Rows come out as from a plain join.
    HOT_KEYS numbers reach the driver, hashes of the values.
    """
    mark = F.xxhash64(key)
    top = [r[0] for r in counts.where(F.col("n") > HOT_ROWS).select("n", mark.alias("_mark")).orderBy(F.desc("n"), "_mark").limit(HOT_KEYS).select("_mark").collect()]
    if not top:
        return big.join(small, key, how)
    salts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = mark.isin(top)
    left = big.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int"))
    right = small.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) of a small graph to (node, component)."""
    table = list(batches)
    if not table:
        return
    kind = table[0].schema.field("u").type
    plain = (lambda v: tuple(v.values())) if pa.types.is_struct(kind) else (lambda v: v)
    place: dict = {}
    nodes: list = []
    parent: list[int] = []

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for batch in table:
        for ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at = []
            for v in ends:
                k = place.setdefault(plain(v), len(nodes))
                if k == len(nodes):
                    nodes.append(v)
                    parent.append(k)
                at.append(root(k))
            parent[at[0]] = at[1]
    least: dict[int, int] = {}
    keys = list(place)
    for k in range(len(nodes)):
        r = root(k)
        if r not in least or keys[k] < keys[least[r]]:
            least[r] = k
    for a in range(0, len(nodes), 50_000):
        part = range(a, min(a + 50_000, len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in part], kind), pa.array([nodes[least[root(k)]] for k in part], kind)], names=["node", "component"])


def components(edges: DataFrame, small_graph: int | None = None) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node reachable.

    A graph of at most ``small_graph`` (SMALL_GRAPH) edges, counted after repeats are dropped, is solved in one task.
    Beyond: alternating large-star and small-star rounds (Kiveris et al. 2014), minima with map-side aggregation and
    equi-joins in which hot nodes are dealt out, each round's edges written to the shared folder, until nothing changes.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    last = mark(now)
    if last[0] <= (SMALL_GRAPH if small_graph is None else small_graph):
        schema = now.select(F.col("u").alias("node"), F.col("v").alias("component")).schema
        return now.coalesce(1).mapInArrow(_solved, schema)
    seen = None
    while last != seen and last[0]:
        seen = last
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        large = joined_by_hot_key(both, low.select("u", F.least("u", "m").alias("m")), "u", F.col("v"), low).where("v > u")
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        forget(low)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = joined_by_hot_key(large, low.select("u", "m"), "u", F.col("v"), low).where("v <> m")
        new = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct(), "edges")
        forget(now)
        forget(large)
        now, last = new, mark(new)
    return now.toDF("node", "component").union(now.select("v", "v").distinct())
