"""The queries of this subpackage: thin wrappers that derive digests from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from panelforge.llm import byte_bpe

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern, decoded=True).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm import topk

    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op4_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm import phrases

    return phrases.remove_phrases(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The rules of the query's contract.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm import url_filter

    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm import line_dedup

    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_copy=1).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm import ngram_join

    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from panelforge.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm import near_vectors

    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.llm import substrings

    return substrings.remove_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_quality,
        op3_voronoi_top_k,
        op4_repeated_phrases,
        op5_url_filter,
        op6_line_dedup,
        op7_ngram_join,
        op8_best_fit_packing,
        op9_near_vectors,
        op10_suffix_array,
    )
}

ORACLES = {
    "op3_voronoi_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.x, d.x)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op4_repeated_phrases": """
WITH w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents)
), g AS (
  SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS win FROM w
), hit AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS least FROM g WHERE i <= n - 12) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit
), j AS (
  SELECT w.doc_id, w.i, w.word, gone.i IS NOT NULL AS removed FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i
), a AS (
  SELECT doc_id, count(*) AS n_words, sum(removed::INT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT removed), '') AS kept FROM j GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
""",
    "op5_url_filter": """
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), r(action, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT page_id, host, path, h || p AS rule, action,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
-- the test tables hold no canonical link or redirect: what no rule decides is allowed
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
""",
    "op7_ngram_join": """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
""",
    "op9_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), g AS (
  SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS m FROM v
  WHERE x IS NOT NULL AND label IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_inner_product(x, x) > 0
), e AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.x, b.x) / (a.m * b.m) >= 0.93
), r AS (SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v
), c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = v.vec_id AS kept
FROM v JOIN c ON c.u = v.vec_id LEFT JOIN (SELECT u, count(*) AS n FROM e GROUP BY u) k ON k.u = v.vec_id
""",
}
