"""The pipeline's stages on the smallest tables: each takes effect on what the one before it kept."""

import collections
import re

import corpus_pipeline
import duckdb
import pandas as pd
from pyspark.sql import functions as F

from landfold.llm import mixing, ngram_join, queries, secret_scan

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = queries.table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality classifier"](spark, docs, SF).cache()
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    bad = docs.join(queries.table(spark, SF, "labels").where("quality = 0"), "doc_id")
    assert bad.join(good, "doc_id", "left_semi").count() <= 0.1 * bad.count()
    once = stage["n-gram Jaccard join"](spark, good, SF).cache()
    assert once.columns == docs.columns and ngram_join.ngram_jaccard_join(once).agg(F.max("n_links")).first()[0] == 0
    assert {r.class_id for r in ngram_join.ngram_jaccard_join(good).collect()} == {r.doc_id for r in once.collect()}
    clean = stage["secret scans"](spark, once, SF).cache()
    assert clean.columns == docs.columns and clean.count() == once.count()
    assert secret_scan.find_secrets(clean).where(F.size("spans") > 0).count() == 0
    assert all(r.n_chars == len(r.text) or r.text is None for r in clean.where(F.col("text").contains("[SECRET]")).collect())
    mixed = stage["mixing"](spark, clean, SF)
    assert mixed.columns == docs.columns and sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in clean.collect())
    packed = stage["packing"](spark, mixed, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.collect()}


def test_run_equals_the_stages(spark):
    docs = queries.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    cut = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, docs.select(cut).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).select(cut).collect()))


def test_sequences_follow_the_mix_over_many_files(spark, tmp_path):
    docs = queries.table(spark, SF, "documents").where("doc_id is not null").dropDuplicates(["doc_id"])
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    mixed.repartition(7).write.parquet(str(tmp_path / "mixed"))
    slot = {r.doc_id: r.slot for r in mixing.mixed_schedule(docs, block_chars=1 << 16).collect()}
    packed = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "mixed")), SF)
    rows = sorted((r.sequence_id, slot[r.doc_id], r.bucket) for r in packed.select("sequence_id", "doc_id", "bucket").collect())
    assert len(set(slot.values())) > 3 and len({s for s, _, _ in rows}) == len(rows)
    for bucket in {b for _, _, b in rows}:
        slots = [t for _, t, b in rows if b == bucket]
        assert slots == sorted(slots)


def test_stages_take_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "token=abcdefgh12 and words", "en", None, 26)], queries.table(spark, SF, "documents").schema)
    rows = lambda df: collections.Counter(tuple(r) for r in df.collect())
    given = rows(odd)
    good = rows(corpus_pipeline.keep_good(spark, odd, SF))
    assert not good - given and all(good[r] in (0, given[r]) for r in given)
    one = rows(corpus_pipeline.keep_one_copy(spark, odd, SF))
    assert one == {(1, "", "en", "a", 0): 1, (2, "token=abcdefgh12 and words", "en", None, 26): 1}
    masked = rows(corpus_pipeline.mask_secrets(spark, odd, SF))
    plain, changed = masked & given, masked - given
    assert plain == given - collections.Counter([(2, "token=abcdefgh12 and words", "en", None, 26)])
    ((doc_id, text, _, _, n_chars),) = changed
    assert doc_id == 2 and "abcdefgh12" not in text and text.endswith(" and words") and n_chars == len(text)
    assert rows(corpus_pipeline.mix_sources(spark, odd, SF)) == given
    packed = corpus_pipeline.pack(spark, odd, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in packed if r.doc_id != 2) == [(False, 1, 1), (False, 1, 1), (True, 0, 1)]
    assert len({r.sequence_id for r in packed}) == len(packed)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_sql_of_the_operators(spark):
    c = duckdb.connect()
    for t in ("pages", "documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda f: sorted(str(tuple(None if pd.isna(v) else (v.item() if hasattr(v, "item") else v) for v in r)) for r in f[sorted(f.columns)].itertuples(index=False))
    made = queries.queries()
    for name, sql in queries.oracle_sql().items():
        assert plain(made[name](spark, SF).toPandas()) == plain(c.execute(sql).fetchdf()), name
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in made if n != "pipeline") == list(range(1, 14))
