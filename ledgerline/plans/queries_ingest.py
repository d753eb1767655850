"""Registered ingest queries over the inbound mailbox (see ``plans.inbound``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerline.operators import ingest as G
from ledgerline.operators import staged as ST
from ledgerline.plans import inbound as B
from ledgerline.plans import oracle_x12 as OX
from ledgerline.plans.queries import register
from ledgerline.session import checkpoint_dir
from ledgerline.sources.files import EXTENSION_FORMATS


def _case(col: str, mapping: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(mapping.items())) + f" ELSE {default} END"


_FILES = OX.segments_sql() + f""",
edi AS (SELECT 'inbound/edi/' || regexp_extract(doc_id, '([^/]*)$', 1) AS path,
               string_agg(array_to_string(elements, '*'), '~' ORDER BY block, sub) || '~' AS content
        FROM bx_rows GROUP BY doc_id),
raw AS (
  SELECT 'inbound/' || source || '/doc_' || doc_id || '.' || coalesce({_case("lang", B.LANG_EXT)}, 'bin') AS path,
         text AS content FROM documents
  UNION ALL SELECT 'inbound/web/page_' || page_id || '.html', html FROM pages
  UNION ALL SELECT path, content FROM edi),
files AS (
  SELECT path, content, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name,
         lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '\\.([^.]*)$', 1)) AS ext FROM raw),
files2 AS (
  SELECT *, CASE WHEN ext = '' THEN name ELSE regexp_extract(name, '^(.*)\\.[^.]*$', 1) END AS stem,
    CASE WHEN ext IN ('xml', 'cxml') AND regexp_matches(content, '^[^\\w]*(?:<[?!][^>]*>\\s*)*<cXML\\b') THEN 'cxml'
         ELSE coalesce({_case("ext", EXTENSION_FORMATS)},
                       CASE WHEN regexp_matches(content, '^\\s*(?:ISA|ST)[^A-Za-z0-9\\s]') THEN 'x12'
                            WHEN regexp_matches(content, '^\\s*<') THEN 'xml' END) END AS format,
    nullif(regexp_extract(name, '(\\d{{3}})', 1), '') AS code,
    sha256(content) AS content_hash FROM files),
firsts AS (SELECT content_hash, min(path) AS first_path FROM files2 GROUP BY content_hash),
lay AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in sorted(B.LAYOUTS.items()))}) t(dir, layout)),
reg AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in sorted(B.MAPS.items()))}) t(key, map)),
routed AS (
  SELECT f.*, l.layout,
         coalesce(r1.map, r2.map, {"'" + B.MAPS["_default_x12"] + "'" if "_default_x12" in B.MAPS else "NULL"}) AS map0
  FROM files2 f LEFT JOIN lay l USING (dir)
  LEFT JOIN reg r1 ON r1.key = f.code LEFT JOIN reg r2 ON r2.key = f.stem),
faulted AS (
  SELECT *, CASE WHEN format IS NULL OR (format = 'csv' AND layout IS NULL) OR (format = 'x12' AND map0 IS NULL) THEN 'DETECTION'
                 WHEN (format = 'x12' AND NOT (length(content) >= 106 AND starts_with(content, 'ISA')))
                   OR (format IN ('xml', 'cxml') AND (NOT starts_with(trim(content), '<') OR content ILIKE '<!doctype html%')) THEN 'TRANSFORMATION' END AS fault
  FROM routed),
passing AS (SELECT content_hash, min(path) AS first_path FROM faulted WHERE fault IS NULL GROUP BY content_hash),
judged AS (SELECT f.*, CASE WHEN fault IS NULL AND path <> first_path THEN 'batch' END AS dup
           FROM faulted f LEFT JOIN passing USING (content_hash)),
results AS (
  SELECT path, dir, name, ext, content_hash, format, code, layout,
    CASE WHEN format = 'x12' THEN map0 END AS map,
    CASE WHEN dup IS NOT NULL THEN 'SKIPPED' WHEN fault IS NOT NULL THEN 'FAILED' ELSE 'SUCCESS' END AS status,
    fault AS stage,
    CASE WHEN dup IS NOT NULL THEN 'Duplicate file'
         WHEN format IS NULL THEN 'Unknown file format'
         WHEN format = 'csv' AND layout IS NULL THEN 'No layout registered for directory'
         WHEN format = 'x12' AND map0 IS NULL THEN 'No map for transaction'
         WHEN format = 'x12' AND NOT (length(content) >= 106 AND starts_with(content, 'ISA'))
           THEN 'PARSE_FAIL: not an X12 interchange (missing ISA header)'
         WHEN fault IS NOT NULL THEN 'XML parse error: not well-formed' END AS reason,
    sha256(path || '|' || content_hash) AS correlation_id
  FROM judged),
rerun AS (
  SELECT r.path, CASE WHEN m.content_hash IS NOT NULL THEN 'SKIPPED' ELSE r.status END AS status,
         CASE WHEN m.content_hash IS NOT NULL THEN NULL ELSE r.stage END AS stage
  FROM results r LEFT JOIN (SELECT DISTINCT content_hash FROM results WHERE status = 'SUCCESS') m USING (content_hash))
"""


def _run1(spark, sf):
    return G.outcomes(spark, B.inbound_files(spark, sf), None, B.LAYOUTS, B.MAPS, B.MAP_TYPES)


@register("files_detect_format", _FILES + "SELECT path, ext, format, code FROM files2")
def files_detect_format(spark, sf):
    """Format by extension or content sniff, transaction code from the name."""
    from ledgerline.sources.files import detect_format, transaction_code
    f = B.inbound_files(spark, sf)
    return f.select("path", "ext", detect_format(F.col("ext"), F.col("content")).alias("format"),
                    transaction_code(F.col("name")).alias("code"))


@register("files_dedup_content", _FILES + """SELECT path, content_hash, CASE WHEN path <> first_path THEN 'batch' END AS dup
FROM files2 JOIN firsts USING (content_hash)""")
def files_dedup_content(spark, sf):
    """Content-hash duplicates inside the batch (first path wins)."""
    return G.classify_duplicates(B.inbound_files(spark, sf), None).select("path", "content_hash", "dup")


@register("ingest_results", _FILES + "SELECT path, format, code, layout, map, status, stage, reason, correlation_id FROM results")
def ingest_results(spark, sf):
    """One outcome per file of the batch."""
    return _run1(spark, sf).select("path", "format", "code", "layout", "map", "status", "stage", "reason",
                                   "correlation_id")


@register("manifest_stats", _FILES + """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'SUCCESS') AS success,
  count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'SKIPPED') AS skipped FROM results""")
def manifest_stats(spark, sf):
    """Manifest rows of the run, totals by status."""
    return G.status_totals(G.manifest_rows(_run1(spark, sf), 1))


@register("ingest_rerun", _FILES + "SELECT path, status, stage FROM rerun")
def ingest_rerun(spark, sf):
    """J2 against the manifest: ingesting the same mailbox again adds nothing new."""
    manifest = G.manifest_rows(_run1(spark, sf), 1)
    return G.outcomes(spark, B.inbound_files(spark, sf), manifest, B.LAYOUTS, B.MAPS, B.MAP_TYPES) \
            .select("path", "status", "stage")


@register("files_dedup_name", _FILES + """SELECT path, name, TRUE AS duplicate FROM files""")
def files_dedup_name(spark, sf):
    """Dry-run duplicate check by name against the manifest (no content read)."""
    manifest = G.manifest_rows(_run1(spark, sf), 1)
    return G.duplicates_by_name(B.inbound_files(spark, sf), manifest)


@register("dead_letters", _FILES + "SELECT path, name, content_hash, stage, reason, correlation_id FROM results WHERE status = 'FAILED'")
def dead_letters(spark, sf):
    """Failed files with stage and reason."""
    return G.dead_letters(_run1(spark, sf))


@register("retry_queue", _FILES + """SELECT path, name, content_hash, stage, reason, correlation_id FROM results r
WHERE status = 'FAILED' AND NOT EXISTS (SELECT 1 FROM results s WHERE s.status = 'SUCCESS' AND s.content_hash = r.content_hash)""")
def retry_queue(spark, sf):
    """Dead letters not superseded by a later success of the same content."""
    res = _run1(spark, sf)
    return G.retry_queue(G.dead_letters(res), G.manifest_rows(res, 1))


_WS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)"
_STAGED = _FILES.rstrip() + f""",
flat AS (
  SELECT path, r.layout, r.format, r.name, r.status, r.stage, r.reason, f.content FROM results r JOIN files2 f USING (path)
  WHERE path NOT LIKE 'inbound/edi/%'),
flat_lines AS (
  SELECT path, i, regexp_replace(parts[i], chr(13) || '$', '') AS line FROM (
    SELECT path, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT path, string_split(content, chr(10)) AS parts FROM flat
      WHERE status = 'SUCCESS' AND format = 'csv' AND layout = 'invoice_lines_csv'))),
flat_rows AS (
  SELECT path, i, list_filter([CASE WHEN coalesce(trim(c[1], {_WS}), '') = '' THEN 'first: required' END,
                               CASE WHEN coalesce(trim(c[2], {_WS}), '') = '' THEN 'second: required' END], lambda e: e IS NOT NULL) AS errors
  FROM (SELECT path, i, string_split(line, ',') AS c FROM flat_lines WHERE line <> '')),
flat_files AS (
  SELECT path, count(*) AS n, count(*) FILTER (len(errors) > 0) AS broken,
         arg_min(errors, i) FILTER (len(errors) > 0) AS first_errors FROM flat_rows GROUP BY path),
flat_done AS (
  SELECT f.path, CASE WHEN f.status = 'SUCCESS' AND fault IS NOT NULL THEN 'FAILED' ELSE f.status END AS status,
         CASE WHEN f.status = 'SUCCESS' THEN fault ELSE f.stage END AS stage,
         CASE WHEN f.status = 'SUCCESS' THEN why ELSE f.reason END AS reason,
         CASE WHEN f.status = 'SUCCESS' AND fault IS NULL THEN coalesce(layout, format) || '/' || regexp_replace(name, '[.][^.]*$', '') || '.json' END AS output,
         CASE WHEN f.status = 'SUCCESS' AND fault IS NULL THEN coalesce(n, 0) ELSE 0 END AS n_documents
  FROM (SELECT f.*, n,
          CASE WHEN format <> 'csv' THEN NULL WHEN layout <> 'invoice_lines_csv' THEN 'VALIDATION'
               WHEN n IS NULL THEN 'TRANSFORMATION' WHEN broken > 0 THEN 'VALIDATION' END AS fault,
          CASE WHEN format <> 'csv' THEN NULL WHEN layout <> 'invoice_lines_csv' THEN 'Layout is not declared: ' || layout
               WHEN n IS NULL THEN 'No rows' WHEN broken > 0 THEN array_to_string(first_errors, '; ') END AS why
        FROM flat f LEFT JOIN flat_files USING (path)) f),
tx_files AS (
  SELECT o_orderkey AS k, o_orderkey % 40 = 4 AS untyped, count(l_orderkey) AS n,
         CASE o_orderkey % 5 WHEN 1 THEN '850' WHEN 2 THEN '997' ELSE '810' END AS kind
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
tx_done AS (
  SELECT 'inbound/edi/810_' || k || '.edi' AS path, CASE WHEN untyped THEN 'FAILED' ELSE 'SUCCESS' END AS status,
         CASE WHEN untyped THEN 'VALIDATION' END AS stage, CASE WHEN untyped THEN 'No transaction type in ST' END AS reason,
         CASE WHEN NOT untyped THEN kind || '/810_' || k || '.json' END AS output,
         CASE WHEN untyped THEN 0 WHEN k % 5 = 3 THEN 2 * (n + 1) ELSE n + 1 END AS n_documents FROM tx_files
  UNION ALL
  SELECT 'inbound/edi_again/810_' || k || '.edi', 'FAILED', 'WRITE', 'Output path is taken: ' || kind || '/810_' || k || '.json', NULL, 0
  FROM tx_files WHERE k % 50 = 0)
"""


@register("ingest_staged", _STAGED + "SELECT * FROM flat_done UNION ALL SELECT * FROM tx_done")
def ingest_staged(spark, sf):
    """Files parsed, checked and mapped before they count as a success; the
    run's documents, dead letters, results and manifest are written, and counted as written."""
    out = f"{checkpoint_dir(spark).rstrip('/')}/ledgerline-staged-{uuid.uuid4().hex}"
    ST.commit(spark, ST.process(spark, B.staged_files(spark, sf), None, B.staged_config()), out, 1)
    results, documents = (spark.read.parquet(f"{out}/{n}") for n in ("results", "documents"))
    counts = documents.groupBy("path").agg(F.count(F.lit(1)).alias("n_documents"))
    return results.join(counts, "path", "left").select(
        "path", "status", "stage", "reason", "output", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


@register("results_listing", _FILES + """SELECT path, run_id, status, stage FROM (
  SELECT path, CASE WHEN path LIKE 'inbound/web/%' THEN 2 ELSE 1 END AS run_id, status, stage FROM results WHERE path NOT LIKE 'inbound/edi/%')
ORDER BY run_id DESC, path LIMIT 50 OFFSET 5""")
def results_listing(spark, sf):
    """O2: results of two runs under two folders, the run written last first, paged."""
    out = f"{checkpoint_dir(spark).rstrip('/')}/ledgerline-results-{uuid.uuid4().hex}"
    files = B.inbound_files(spark, sf).where(~F.col("dir").eqNullSafe("inbound/edi"))
    web = F.col("dir") == "inbound/web"
    for name, run, part in (("docs", 1, files.where(~web)), ("web", 2, files.where(web))):
        G.outcomes(spark, part, None, B.LAYOUTS, B.MAPS, B.MAP_TYPES).select("path", "status", "stage").write.parquet(
            f"{out}/{name}/run_id={run}")
    page = G.results_by_time(spark, [f"{out}/docs", f"{out}/web"], "path string, status string, stage string, run_id int", 5, 50)
    return page.select("path", "run_id", "status", "stage")
