"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

Paragraphs are lines; a section ends at an empty line or at a paragraph whose hash says so; a paragraph's leaves are
runs of words that end where a word's hash says so. As all bounds come from content, an edit changes the nodes above
it and leaves the others alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.llm.common import shuffle_partitions, text_or_empty

#: A leaf has so many words on average, a section so many paragraphs.
LEAF, SECTION = 4, 8


class Closes(dict):
    """Whether a word ends a leaf."""

    def __missing__(self, word: str) -> bool:
        value = zlib.crc32(word.encode("utf-8", "replace")) % LEAF == 0
        if len(self) < 500_000:
            self[word] = value
        return value


def _hash(data: bytes, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def merkle_tree(text: str, closes: Closes | None = None) -> tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]:
    """(root, [(section, [(paragraph, [leaf, ...]), ...]), ...]) as lowercase hex; an empty text is one empty leaf."""
    ends = (Closes() if closes is None else closes).__getitem__
    sections, paragraphs, whole = [], [], []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        words = line.split(" ")
        cuts = [i + 1 for i, hit in enumerate(map(ends, words)) if hit]
        if not cuts or cuts[-1] != len(words):
            cuts.append(len(words))
        leaves, a = [], 0
        for b in cuts:
            leaves.append(_hash(" ".join(words[a:b]).encode("utf-8", "replace"), 8))
            a = b
        node = _hash(b"p" + b"".join(leaves), 8)
        paragraphs.append((node, leaves))
        if not line or node[0] % SECTION == 0 or k == len(lines) - 1:
            whole.append(_hash(b"s" + b"".join(p for p, _ in paragraphs), 8))
            sections.append((whole[-1].hex(), [(p.hex(), [x.hex()[:8] for x in xs]) for p, xs in paragraphs]))
            paragraphs = []
    return _hash(b"r" + b"".join(whole), 16).hex(), sections


def fingerprint(text: str, closes: Closes | None = None) -> str:
    """``root:section=leaf.leaf,leaf/section=...``: paragraphs are parted by commas. Equal texts, equal fingerprints."""
    root, sections = merkle_tree(text, closes)
    return root + ":" + "/".join(s[:8] + "=" + ",".join(".".join(leaves) for _, leaves in ps) for s, ps in sections)


def _tree(print_: str) -> list[str]:
    return print_.partition(":")[2].split("/")


def _apart(ours: list[str], theirs: list[str]) -> tuple[list[int], list[int]]:
    """Places of the branches of each side that the other does not hold, a branch as often as it is there."""
    left, right = Counter(ours), Counter(theirs)
    only_a, only_b = left - right, right - left

    def places(branches: list[str], only: Counter) -> list[int]:
        out = []
        for k, x in enumerate(branches):
            if only[x] > 0:
                only[x] -= 1
                out.append(k)
        return out

    return places(ours, only_a), places(theirs, only_b)


def _paragraphs(sections: list[str], places: list[int]) -> tuple[list[tuple[int, int]], list[str]]:
    found = [((i, k), p) for i in places for k, p in enumerate(sections[i].partition("=")[2].split(","))]
    return [at for at, _ in found], [p for _, p in found]


def compared(a: str, b: str) -> tuple[float, list[tuple[int, int]]]:
    """The likeness of two fingerprints and the (section, paragraph) numbers of a that b's tree does not hold.

    Equal roots have the likeness 1. Else the trees are walked down: sections that both hold are matched whole, then
    paragraphs of the other sections, then leaves of the other paragraphs; the likeness is the share of matched leaves
    (Dice, below 1). It is the share of leaves in common over both multisets, whatever branches they stand in.
    """
    if a.partition(":")[0] == b.partition(":")[0]:
        return 1.0, []
    x, y = _tree(a), _tree(b)
    all_a, all_b = (len(t) + sum(s.count(".") + s.count(",") for s in t) for t in (x, y))
    p, q = _apart(x, y)
    at, ours = _paragraphs(x, p)
    _, theirs = _paragraphs(y, q)
    p, q = _apart(ours, theirs)
    left, right = (Counter(leaf for k in places for leaf in branches[k].split(".")) for places, branches in ((p, ours), (q, theirs)))
    matched = all_a - left.total() + (left & right).total()
    return min(2 * matched / (all_a + all_b), 1 - 1e-9), [at[k] for k in p]


def likeness(a: str, b: str) -> float:
    return compared(a, b)[0]


def differing_branches(a: str, b: str) -> list[tuple[int, int]]:
    return compared(a, b)[1]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """docs with ``fingerprint`` of each whole text; null text counts as empty. Other columns are kept."""

    @F.pandas_udf("string")
    def prints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        closes = Closes()
        for part in parts:
            yield pd.Series([fingerprint(t, closes) for t in part], dtype=object)

    return docs.drop("fingerprint").withColumn("fingerprint", prints(text_or_empty()))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (bucket, rank, doc_id, text, only_next) sorted so that each row's successor follows in its partition.

    Documents stand by descending doc_id (null last; equal ids by a hash of the text) in buckets of about equal
    size; an id that many rows share is cut at even steps of that hash (rows equal in id and text stay together). The first document of a bucket is sent to the
    bucket before too, the very first to the last bucket, as rows with ``only_next``. The driver holds one bound and
    one id for each bucket.
    """
    low = -(2**63)
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.coalesce(F.col("doc_id"), F.lit(low)).cast("long").alias("_order"))
    ids = rows.select((-F.col("_order").cast("double")).alias("x"))
    asked = ids.approxQuantile("x", [k / parts for k in range(1, parts)], 0.2 / parts)
    bounds = sorted(set(asked))
    # an id at several quantiles has that many buckets' rows: its own bucket, between its bound and the next, is cut again
    often = {x: n for x, n in Counter(asked).items() if n > 1}
    steps = max(often.values(), default=1)
    splits = [-float("inf"), *(bounds or [0.0]), float("inf")]
    rows = rows.withColumn("x", -F.col("_order").cast("double"))
    rows = Bucketizer(splits=splits, inputCol="x", outputCol="bucket").transform(rows).withColumn("_tie", F.xxhash64("text"))
    step = F.least(F.floor((F.lit(float(2**63)) - F.col("_tie").cast("double")) / F.lit(2.0**64) * steps), F.lit(steps - 1))
    rows = rows.withColumn("bucket", (F.col("bucket") * steps + F.when(F.col("x").isin(list(often)), step).otherwise(F.lit(steps - 1))).cast("int")).drop("x")
    keys = rows.groupBy("bucket").agg(F.max(F.struct("_order", "_tie")).alias("m")).collect()
    heads = sorted((r["bucket"], r["m"][0], r["m"][1]) for r in keys)
    if not heads:
        return rows.select("bucket", "doc_id", "text", F.lit(False).alias("only_next"))
    spark = docs.sparkSession
    sent = spark.createDataFrame([(h[0], h[1], h[2], heads[k - 1][0]) for k, h in enumerate(heads)], "bucket int, _order long, _tie long, _to int")
    heads_rows = rows.join(F.broadcast(sent), ["bucket", "_order", "_tie"], "left")  # one small row for each bucket
    targets = F.when(F.col("_to").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("o")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("o")), F.struct(F.col("_to").alias("b"), F.lit(True).alias("o")))
    )
    dealt = heads_rows.withColumn("_t", F.explode(targets))
    return (
        dealt.select(F.col("_t.b").alias("bucket"), F.col("_t.o").alias("only_next"), "doc_id", "text", "_order", "_tie")
        .repartitionByRange(shuffle_partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "only_next", F.desc("_order"), F.desc("_tie"))
        .select("bucket", "doc_id", "text", "only_next")
    )


def edited_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, changed) for each row of docs.

    The edited text is the text with its last floor(n / 3) code points replaced by the first as many (or all) of the
    next document's by descending doc_id, after the last the first. A sole document is its own next. Equal ids
    follow each other, null ids come last; null text counts as empty; other columns are ignored. ``changed`` names the
    branches of the edited text's tree that the text's tree lacks, as section.paragraph, comma-joined.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        closes = Closes()
        held = None  # (bucket, doc_id, text, fingerprint): the row that waits for its next
        for frame in frames:
            out = []
            for bucket, doc_id, text, only_next in zip(frame["bucket"], frame["doc_id"], frame["text"], frame["only_next"]):
                own = fingerprint(text, closes)
                if held is not None and held[0] == bucket:
                    _, its_id, its, its_print = held
                    cut = len(its) // 3
                    edited = its[: len(its) - cut] + text[:cut]
                    new = fingerprint(edited, closes)
                    sha = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
                    near, changed = compared(new, its_print)
                    out.append((its_id, len(its), sha, its_print, new, near, likeness(its_print, own), ",".join(f"{i}.{k}" for i, k in changed)))
                held = None if only_next else (bucket, doc_id, text, own)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "changed"])

    rows = with_next(docs, 2 * shuffle_partitions(docs.sparkSession))
    # ids as text: a null among numbers would turn them to floats
    made = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, changed string"
    )
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))
