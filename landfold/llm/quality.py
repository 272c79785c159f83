"""Quality classifier: histogram gradient-boosted trees over statistics of the text, kept as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfold.llm.common import text_or_empty

SYMBOLS = np.frombuffer(b"#$%&*+<=>@\\^_`{|}~", np.uint8)
FEATURES = 20


def statistics(text: str) -> np.ndarray:
    """Numbers about a whole text; also of an empty one."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n = max(1, int(raw.sum()))
    words, lines = text.split(), text.split("\n")
    nw, nl = max(1, len(words)), len(lines)
    letters = max(1, int(raw[65:91].sum() + raw[97:123].sum()))
    ended = sum(line.endswith((".", "!", "?", "…", '"')) for line in lines)
    distinct = set(lines)
    return np.array(
        [
            np.log1p(len(text)),
            np.log1p(len(words)),
            (len(text) - raw[32] - raw[10]) / nw,
            len(set(words)) / nw,
            len(set(zip(words, words[1:]))) / nw,
            raw[65:91].sum() / letters,
            raw[48:58].sum() / n,
            raw[32] / n,
            raw[46] / nw,
            raw[44] / nw,
            raw[SYMBOLS].sum() / nw,
            raw[33] / nw,
            raw[124] / nw,
            raw[128:].sum() / n,
            raw[35:39].sum() / nw,
            np.log1p(nl),
            len(distinct) / nl,
            sum(map(len, distinct)) / max(1, len(text)),
            len(text) / nl,
            ended / nl,
        ]
    )


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: node v has children 2v+1 and 2v+2. ``base`` is the log-odds before them."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; all trees step down together."""
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        if trees:
            at = np.zeros((len(x), trees), np.int64)
            tree, rows = np.arange(trees), np.arange(len(x))[:, None]
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.cut[tree, at])
            total = total + self.leaf[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on binned columns. One label only, or no row: no tree, just the base rate."""
    inner = 2**depth - 1
    rate_1 = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(rate_1 / (1 - rate_1)))
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if len(y) == 0 or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
    width = x.shape[1]
    feature, cut, leaf = [], [], []
    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            slot = ((at - first)[:, None] * width + np.arange(width)) * bins + binned
            g = np.bincount(slot.ravel(), np.repeat(grad, width), many * width * bins).reshape(many, width, bins).cumsum(2)
            h = np.bincount(slot.ravel(), np.repeat(hess, width), many * width * bins).reshape(many, width, bins).cumsum(2)
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < least) | (all_h - h < least)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                col, edge = divmod(int(best[k]), bins)
                if gain[k, col, edge] > 1e-9 and edge < len(cuts[col]):
                    f[first + k], c[first + k] = col, cuts[col][edge]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > c[at])
        g, h = np.bincount(at - inner, grad, inner + 1), np.bincount(at - inner, hess, inner + 1)
        v = -rate * g / (h + ridge)
        margin = margin + v[at - inner]
        feature.append(f)
        cut.append(c)
        leaf.append(v)
    return Trees(np.array(feature), np.array(cut), np.array(leaf), base)


def held_out() -> Column:
    """Rows that no label is learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Trees:
    """Trees fitted to at most ``sample`` labelled documents, chosen by a hash of doc_id among those not held out.

    Only this fit is bounded; statistics of the sampled texts are taken on the executors, and rows of ``FEATURES``
    numbers reach the driver. Labels other than 0 and 1 are ignored; of several labels of one id the smallest holds, of
    several texts of one id the first in order, so that the trees do not hang on how rows arrive.
    """
    chosen = (
        labels.where(~held_out() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"label": frame["label"].to_numpy(), "x": [statistics(t).tolist() for t in frame["text"]]})

    rows = (
        docs.select("doc_id", text_or_empty().alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
        .groupBy("doc_id")
        .agg(F.min(F.col("_label").cast("int")).alias("label"), F.min("text").alias("text"))
        .select("label", "text")
        .mapInPandas(run, "label int, x array<double>")
        .toPandas()
    )
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), FEATURES)
    order = np.lexsort([*x.T, rows["label"]])  # the same trees however the rows arrive
    return fit_trees(x[order], rows["label"].to_numpy(float)[order])


def score_quality(docs: DataFrame, model: Trees) -> DataFrame:
    """docs with ``score`` (0 to 1, higher: label 1 likelier) of the whole text; null text counts as empty.

    Every row gets a score, repeated rows equal ones. Other columns are kept; a column named score is replaced.
    """
    docs = docs.drop("score")
    # the text goes to Python alone, as the last column of a struct would cost a copy of the rest
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.score(np.array([statistics(t) for t in part]).reshape(len(part), FEATURES)))

    return docs.withColumn("score", score(text_or_empty()))
