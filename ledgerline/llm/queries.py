"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    conversation_queries,
    decontaminate,
    jaccard_join,
    language_id,
    secrets,
    sentencepiece_codec,
    sharding,
    token_counts,
    token_files,
    topk,
    url_filter,
)
from ledgerline.session import table

#: Bytes of text that one shard holds at most.
SHARD_LIMIT = 1 << 20


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source`` owns a document; the document is the repository."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), "text", "source", "doc_id", {"doc_id": "doc_id"})
    n = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *n, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
                        secrets.joined(F.col("spans")).alias("spans"), "n_copied", "n_live")


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def tokenizer_file(name: str) -> str:
    """The place of a vocabulary file; the operators take paths."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "text", tokenizer_file("byte_bpe_50k.json"),
                                     {"doc_id": "doc_id"})


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(table(spark, sf_dir, "documents"), "doc_id", "text", 4, 85).withColumnRenamed(
        "id", "doc_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out("doc_id"))
    model = language_id.train(docs.where(~F.col("held_out")), "doc_id", "text", "lang")
    return language_id.identify(docs, "text", model, {"doc_id": "doc_id", "held_out": "held_out"})


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.token_files_in_shared_dir(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), "doc_id", "text",
                                  tokenizer_file("word_bpe_49k.json"), 2, path)
    return token_files.read_token_files(spark, path, with_ids=False)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_pieces(table(spark, sf_dir, "documents"), "text",
                                             tokenizer_file("piece_bpe_32k.model"), {"doc_id": "doc_id"},
                                             with_ids=False)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), "text", table(spark, sf_dir, "benchmark"),
                               "item_id", "text", {"doc_id": "doc_id"})
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        decontaminate.contaminated().alias("contaminated"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    return (url_filter.judge_urls(table(spark, sf_dir, "pages"), "page_id", "url", model)
            .withColumnRenamed("id", "page_id"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sharding.assign_shards(table(spark, sf_dir, "documents"), "doc_id",
                                   F.octet_length("text"), SHARD_LIMIT)
            .withColumnRenamed("key", "doc_id"))


def _secret_sql() -> str:
    def places(kind: int, pattern: str, keep: str) -> str:
        p = pattern.replace("'", "''").replace('\\"', '"')
        return f"""
  SELECT doc_id, source, {kind} AS kind, ms[i] AS m,
         coalesce(list_sum([length(x) for x in gs[1:i]]), 0)
         + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) AS start
  FROM (SELECT doc_id, source, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '{p}') AS ms,
           string_split_regex(coalesce(text, ''), '{p}') AS gs FROM documents))
  WHERE {keep}"""
    assign = secrets.ASSIGN.replace("'", "''")
    value = f"CASE kind WHEN 0 THEN regexp_extract(m, '{assign}', 2) ELSE m END"
    live = ("regexp_matches(ms[i], '[A-Z]') AND regexp_matches(ms[i], '[a-z]') "
            "AND regexp_matches(ms[i], '[0-9][^0-9]*[0-9]') "
            "AND NOT regexp_matches(ms[i], '(?i)example|placeholder|changeme|xxxx')")
    parts = [(0, secrets.ASSIGN, f"length(regexp_extract(ms[i], '{assign}', 2)) >= {secrets.ASSIGN_VALUE}"),
             (1, secrets.ACCESS, "true"), (2, secrets.HEX, "true")]
    one = "kinds[kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT"
    return f"""
WITH base AS ({" UNION ALL ".join(places(*x) for x in parts)}),
tokens AS ({places(3, secrets.TOKEN, live)}),
added AS (SELECT * FROM tokens t WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.start < t.start + length(t.m)
  AND t.start < b.start + length(b.m))),
held AS (SELECT doc_id, source, kind, start, start + length(m) AS stop, sha256({value}) AS hash
         FROM (FROM base UNION ALL FROM added)),
totals AS (SELECT coalesce(source, '') AS owner, count(DISTINCT doc_id) AS total FROM documents GROUP BY 1),
freq AS (
  SELECT hash, count(*) AS owners, bool_or(repos > {secrets.MAX_REPOS} AND repos > {secrets.MAX_SHARE} * total) AS spread
  FROM (SELECT hash, coalesce(source, '') AS owner, count(DISTINCT doc_id) AS repos FROM held GROUP BY 1, 2)
  JOIN totals USING (owner) GROUP BY hash),
judged AS (SELECT *, {list(secrets.KINDS)} AS kinds FROM held JOIN freq USING (hash)
           WHERE kind < 3 OR (owners <= 1 AND NOT spread)),
per AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1,
  count(*) FILTER (kind = 2) AS n2,
  coalesce(string_agg({one}, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base,
  string_agg({one}, ',' ORDER BY start, kind) AS spans,
  count(*) FILTER (kind < 3 AND (owners >= 2 OR spread)) AS copied,
  count(*) FILTER (kind < 3 AND owners < 2 AND NOT spread) AS live
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(copied, 0) AS n_copied, coalesce(live, 0) AS n_live
FROM documents d LEFT JOIN per USING (doc_id)
"""


WINDOW_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
       FROM bw WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bs),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
       FROM dw JOIN (SELECT DISTINCT n FROM bwin) ON len(w) >= n),
hit AS (SELECT doc_id, item_id, i, n
        FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM ds) JOIN bwin USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' '), least(len(w), 4)) AS f
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y USING (f)
                           WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
          JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
deg AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
LEFT JOIN deg ON deg.a = d.doc_id
"""

TOP_K_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

SHARDING_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS size,
         lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UBIGINT), 32, '0')
         || lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 9, 8))::UBIGINT), 32, '0') AS bits
  FROM documents),
sums AS (
  SELECT substr(bits, 1, d) AS prefix, sum(size)::BIGINT AS bytes, count(*) AS n
  FROM sized, range(0, 33) AS depths(d) GROUP BY 1),
depth AS (
  SELECT doc_id, min(d) AS d FROM sized, range(0, 33) AS depths(d)
  JOIN sums ON prefix = substr(bits, 1, d) WHERE bytes <= {SHARD_LIMIT} OR n = 1 GROUP BY doc_id)
SELECT sized.doc_id, size, substr(bits, 1, d) AS shard, d::INT AS depth, bytes AS shard_bytes,
       n AS shard_rows, bytes > {SHARD_LIMIT} AS oversized
FROM sized JOIN depth USING (doc_id) JOIN sums ON prefix = substr(bits, 1, d)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_token_counts": op3_token_counts,
    "op4_language_id": op4_language_id,
    "op5_token_files": op5_token_files,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_decontaminate": op7_decontaminate,
    "op8_url_filter": op8_url_filter,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_sharding": op10_sharding,
    **conversation_queries.QUERIES,
}

ORACLE: dict[str, str] = {
    "op1_secret_scan": _secret_sql(),
    "op2_jaccard_join": JACCARD_SQL,
    "op7_decontaminate": WINDOW_SQL,
    "op9_exact_top_k": TOP_K_SQL,
    "op10_sharding": SHARDING_SQL,
    **conversation_queries.ORACLE,
}
