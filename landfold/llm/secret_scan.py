"""Secret scan with an incremental blob ledger. Only DataFrame functions.

Every version of a text is addressed by its content. The ledger holds one row for each (blob, rule version) that has
been scanned, with its findings; only pairs that it lacks are scanned, and findings are joined back to every path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfold.llm.common import written
from landfold.tables import joined_by_hot_key

#: Fixed patterns: kind, expression (empty matches can't occur), group whose length counts, least length.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}+", 0, 32),
]
#: Raise it when a pattern changes, so that all blobs are scanned anew.
RULE_VERSION = 1
SPAN = "struct<start:int,rank:int,kind:string,end:int>"
#: Findings of a text that are added to one array; longer arrays are put together of such.
STEPS = 256


def _found(text: Column, rank: int) -> Column:
    """Spans of one kind, leftmost and not overlapping: lengths of the parts between matches give the places."""
    kind, pattern, group, least = KINDS[rank]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), counted.alias("counted"))
    empty = F.array().cast(f"array<{SPAN}>")

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["whole"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        more = F.concat(acc["spans"], F.array(span))
        return F.struct(end.alias("at"), F.when(F.length(x["counted"]) >= least, more).otherwise(acc["spans"]).alias("spans"))

    def some(first: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
        return F.aggregate(F.slice(steps, first + 1, F.least(F.lit(STEPS), F.size(whole) - first)), zero, add)

    def put(acc: Column, x: Column) -> Column:
        shift = lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end"))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["spans"], F.array(F.transform(x["spans"], shift))).alias("spans"))

    parts = F.transform(F.sequence(F.lit(0), F.size(whole) - 1, F.lit(STEPS)), some)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("spans"))
    spans = F.aggregate(parts, zero, put, lambda acc: F.flatten(acc["spans"]))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def secret_spans(text: Column) -> Column:
    """All spans of a whole text by start, then kind; code points, end exclusive."""
    return F.array_sort(F.concat(*[_found(text, k) for k in range(len(KINDS))]))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: int = RULE_VERSION) -> DataFrame:
    """Ledger rows (blob, rules, spans) of the blobs of versions that the given ledger lacks under these rules.

    One copy of each blob is scanned, however many rows hold it: copies are dropped before and after the shuffle, so
    that a hot blob costs one row a task. Append the rows to the ledger after the job.
    """
    blobs = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    blobs = blobs.dropDuplicates(["blob"])
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    return blobs.select("blob", F.lit(rules).alias("rules"), secret_spans(F.col("text")).alias("spans"))


def grown_ledger(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: int = RULE_VERSION) -> DataFrame:
    """The ledger with a row for every blob of versions under these rules; new rows are scanned once and written."""
    new = written(scan_blobs(versions, ledger, text, rules), "ledger")
    return new if ledger is None else ledger.select(*new.columns).unionByName(new)


def find_secrets(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: int = RULE_VERSION) -> DataFrame:
    """versions with ``spans``, the findings in each row's whole text (empty array: none).

    The ledger grows by the blobs that it lacks, and its findings are joined back to every row; the rows of a blob
    that many hold are dealt over many tasks. Null text counts as empty. Rows that repeat a text get equal findings;
    other columns are kept and a column named spans is replaced. No rows give no rows.
    """
    known = grown_ledger(versions, ledger, text, rules).where((F.col("rules") == rules) & (F.size("spans") > 0))
    known = known.select(F.col("blob").alias("_blob"), "spans")
    rows = versions.drop("spans").withColumn("_blob", blob_of(F.col(text)))
    counts = rows.groupBy("_blob").agg(F.count(F.lit(1)).alias("n"))
    others = [c for c, kind in rows.dtypes if c not in (text, "_blob") and "map<" not in kind]
    joined = joined_by_hot_key(rows, known, "_blob", F.xxhash64(F.lit(0), *others), counts, "left")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))).drop("_blob").select(*rows.drop("_blob").columns, "spans")


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by the mask."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.when(s["start"] >= acc["at"], F.lit(mask)).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), kept.alias("out"))

    return F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
