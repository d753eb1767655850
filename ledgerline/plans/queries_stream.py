"""Registered streaming queries: each runs a Structured Streaming query with
``availableNow`` into a sink under the shared checkpoint folder, then returns
the sink read back as a DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import reconcile as RC
from ledgerline.plans import inbound as B
from ledgerline.plans import invoices as I
from ledgerline.plans import oracle_invoices as OI
from ledgerline.plans.queries import register
from ledgerline.plans.queries_ingest import _FILES
from ledgerline.session import store, table
from ledgerline.sources.files import with_names
from ledgerline.streaming import ingest as S


@register("stream_ingest", _FILES + """SELECT path, status, stage, reason FROM results
WHERE path NOT LIKE 'inbound/web/%' AND path NOT LIKE 'inbound/edi/%'""")
def stream_ingest(spark, sf):
    """Documents arriving with the rest of the mailbox, ingested exactly once per content by foreachBatch."""
    return _streamed_mailbox(spark, sf).where(~F.col("path").rlike("^inbound/(web|edi)/"))


@register("stream_mailbox", _FILES + "SELECT path, status, stage, reason FROM results")
def stream_mailbox(spark, sf):
    """Every file of the mailbox (documents, pages, X12 invoices), ingested as a stream."""
    return _streamed_mailbox(spark, sf)


def _streamed_mailbox(spark, sf):
    out = _stream_mailbox(spark, sf)
    return spark.read.parquet(f"{out}/results").select("path", "status", "stage", "reason")


def _stream_mailbox(spark, sf):
    """Ingest the mailbox as a stream; the folder of its results."""
    out = S.scratch(spark, "stream-ingest")
    drop = f"{out}/inbox"
    B.inbound_files(spark, sf).select("path", "content").write.parquet(drop)
    files = S.table_stream(spark, drop, "*.parquet", "path string, content string")
    S.start_ingest(with_names(files), out, B.LAYOUTS, B.MAPS, B.MAP_TYPES).awaitTermination()
    return out


@register("stream_rate", """WITH w AS (
  SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT window_start, window_start + INTERVAL '1 minute' AS window_end, event_type, n FROM w
WHERE window_start + INTERVAL '1 minute' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""")
def stream_rate(spark, sf):
    """Events per minute and type with a 10-minute watermark (open windows are not emitted)."""
    out = S.scratch(spark, "stream-rate")
    ev = S.table_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema)
    S.start_rate(ev, out).awaitTermination()
    return spark.read.parquet(f"{out}/rate")


@register("stream_reconcile", OI.base_sql(1) + "SELECT * FROM diffs")
def stream_reconcile(spark, sf):
    """Target records arriving in a drop folder, each batch compared with the source documents it touches."""
    out = S.scratch(spark, "stream-reconcile")
    drop = f"{out}/inbox"
    lines = store(I.order_lines(spark, sf))
    I.invoice_records(spark, sf, "target", lines).write.parquet(drop, compression="zstd")
    src = I.invoice_records(spark, sf, "source", lines)
    skeys = RC.match_values_flat(src, I.MATCH_KEY)
    stream = spark.readStream.schema(spark.read.parquet(drop).schema).parquet(drop)
    S.start_reconcile(stream, src, skeys, I.MATCH_KEY, I.profile_rules(1), out).awaitTermination()
    return S.read_reconciled(spark, out)


# Every tenth event comes a second time, another tenth comes late.
_LATE = "ts > date_trunc('millisecond', (SELECT max(ts) FROM events WHERE event_id % 10 <> 1)) - INTERVAL '1 day'"


@register("stream_dedup", f"""SELECT event_id, ts, user_id, event_type FROM events
WHERE event_id % 10 <> 1 OR {_LATE}""")
def stream_dedup(spark, sf):
    """R2: events arriving in three batches, the second of copies, the third of late events; each
    event once, those behind the watermark of one day not at all."""
    out = S.scratch(spark, "stream-dedup")
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    late = F.col("event_id") % 10 == 1
    for i, rows in enumerate((events.where(~late), events.where(F.col("event_id") % 10 == 2), events.where(late))):
        rows.coalesce(1).write.parquet(f"{out}/inbox/part={i}")  # a file each, in this order
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(f"{out}/inbox"))
    S.start_dedup(stream, out, ["event_id"], "ts", "1 day").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{out}/rows").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("stream_failure_rate", _FILES + """, arrived AS (
  SELECT TIMESTAMP '2025-01-01 00:00:00' + to_seconds(('0x' || substr(md5(path), 1, 4))::BIGINT % 3600) AS ts, status FROM results),
per AS (SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, count(*) AS n_files,
               count(*) FILTER (status = 'FAILED') AS n_failed FROM arrived GROUP BY 1)
SELECT window_start, n_files, n_failed, n_failed / n_files AS failure_rate FROM per
WHERE window_start + INTERVAL '1 minute' <= (SELECT max(ts) FROM arrived) - INTERVAL '10 minutes'""")
def stream_failure_rate(spark, sf):
    """Files a minute and their failure rate, a stream chained on the results of the streamed ingest."""
    out = _stream_mailbox(spark, sf)
    results = (spark.readStream.schema(f"{S.RESULTS}, batch_id int").parquet(f"{out}/results"))
    second = F.conv(F.substring(F.md5(F.col("path").cast("binary")), 1, 4), 16, 10).cast("long") % 3600
    timed = results.withColumn("arrived", F.timestamp_seconds(F.lit(1735689600) + second))  # 2025-01-01 UTC
    S.start_failure_rate(timed, out, "arrived").awaitTermination()
    return spark.read.parquet(f"{out}/failure_rate")
