"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landfold.llm import alignment, decontamination, embedding_dedup, html_extract, lexical_search, merkle, mixing, ngram_join, packing, quality, secret_scan, url_filters, warc

#: Rules of the URL filter: action, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_filters.judge_urls(pages.select("page_id", "url"), url_filters.page_links(pages), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_schedule(table(spark, sf_dir, "documents")).drop("key")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(table(spark, sf_dir, "pages"), least_bytes=0)
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every row. The table holds no history, so its rows are taken as two commits, parted by a hash of doc_id, over a ledger that starts empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # two commits: about half of the rows come first, then all; of these only the blobs that are not in the ledger are scanned
    ledger = secret_scan.grown_ledger(docs.where(F.xxhash64("doc_id") < 0))
    found = secret_scan.find_secrets(docs, ledger)
    many = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = secret_scan.span_text(F.col("spans"))
    return found.select("doc_id", many("assign"), many("access"), many("hex"), F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_prints(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_join(F.transform("matches", lambda m: m["item_id"]), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("matches").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    ranks, pieces = p.path("byte_bpe_50k.tiktoken"), p.path("piece_bpe_32k.model")  # the ranks are the vocabulary of byte_bpe_50k.json
    done = alignment.align(table(spark, sf_dir, "documents"), ranks, p.PATTERN, pieces, 32_000, alignment.sha256_or_empty)
    return done.withColumnRenamed("groups", "groups_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    made = (
        op1_url_filters, op2_embedding_near_dedup, op3_mixing, op4_packing, op5_warc, op6_quality_classifier,
        op7_secret_scans, op8_ngram_jaccard_join, op9_document_fingerprints, op10_html_extraction, op11_lexical_search, op12_decontamination, op13_tokenizer_alignment, pipeline,
    )
    return {f.__name__: f for f in made}


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(action, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT p.page_id, p.url, max_by(h || pre, length(h || pre)) AS rule, max_by(action, length(h || pre)) AS action
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY p.page_id, p.url),
alias AS (
  SELECT p.*, f.rule, f.action,
    CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') ||
      coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(p.url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), '&'),
        lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')), '&'), ''), '') END AS key
  FROM p LEFT JOIN fit f ON p.page_id = f.page_id AND p.url = f.url),
hit AS (SELECT DISTINCT key FROM alias WHERE action = 'block' AND key IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN hit.key IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM alias LEFT JOIN hit ON alias.key = hit.key
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, t, kind, rank, least,
    regexp_extract_all(t, pattern, 0) AS w, regexp_extract_all(t, pattern, grp) AS c, regexp_split_to_array(t, pattern) AS g
  FROM d, (VALUES
    ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
    ('access', 1, 'AKIA[A-Z0-9]+', 0, 16),
    ('hex', 2, '[0-9a-f]{32,}', 0, 32)) k(kind, rank, pattern, grp, least)),
s AS (
  SELECT doc_id, kind, rank, unnest(range(1, len(w) + 1)) AS n, w, c, g, least FROM m WHERE len(w) > 0),
places AS (
  SELECT doc_id, kind, rank,
    coalesce(list_sum(list_transform(g[1:n], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:n - 1], lambda x: length(x))), 0) AS a,
    length(w[n]) AS size
  FROM s WHERE length(c[n]) >= least),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || a::BIGINT || ':' || (a + size)::BIGINT, ',' ORDER BY a, rank) AS spans
  FROM places GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""

OP2_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.a
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
c AS (SELECT count(*) FILTER (len(words) > 0) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(words) AS n, unnest(words) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term, n_docs),
i AS (
  SELECT item_id, text, term, count(*) AS q
  FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
s AS (
  SELECT item_id, text, row, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN tf USING (term), c GROUP BY item_id, text, row, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[a:a + least(len(words), 10) - 1], ' ') AS part
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS a FROM i WHERE len(words) > 0)),
p AS (
  SELECT row, size, a, array_to_string(words[a:a + size - 1], ' ') AS part
  FROM (SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS a FROM d, (SELECT DISTINCT size FROM w))),
hits AS (SELECT row, item_id, a, size FROM p JOIN w USING (size, part)),
n AS (SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(a, a + size)) AS at FROM hits) GROUP BY row),
t AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS item_id FROM hits) GROUP BY row)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN t USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_decontamination": OP12_SQL, "op11_lexical_search": OP11_SQL, "op1_url_filters": OP1_SQL, "op2_embedding_near_dedup": OP2_SQL, "op7_secret_scans": OP7_SQL}
