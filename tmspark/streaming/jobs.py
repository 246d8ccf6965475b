"""Streams: key usage, layout sessions, log statistics, enrichment, reuse counts. The memory's fold and exact bursts of
layout changes are in ``stateful``.

Each takes a streaming DataFrame (or a batch one, for its twin) and returns one. Jobs over windows of time take the
watermark as a parameter, and Spark drops rows older than it; enrichment and reuse counts have no window and drop none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmspark.functions import text
from tmspark.operators import glossary, memory
from tmspark.operators import logs as batch_logs


def key_usage_by_day(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Requests of each key and model by quota day: windows of a day over the provider's own clock, Pacific for one
    provider (summer time included), UTC for the others. The watermark must exceed the clocks' distance of 8 hours."""
    local = events.withColumn("local", text.quota_time(F.col("at"), F.col("provider"))).withWatermark("local", watermark)
    return local.where("kind = 'success'").groupBy("provider", "key_id", "model", F.window("local", "1 day")).agg(F.count(F.lit(1)).alias("requests"))


def key_usage_by_minute(events: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """Requests in sliding minutes, every ten seconds."""
    return events.withWatermark("at", watermark).where("kind = 'success'").groupBy("key_id", "model", F.window("at", "1 minute", "10 seconds")).agg(F.count(F.lit(1)).alias("requests"))


def layout_sessions(ops: DataFrame, gap: str = "60 seconds", watermark: str = "10 minutes") -> DataFrame:
    """Bursts of layout changes of one bubble; unlike the batch operator they aren't parted by other operations."""
    rows = ops.withWatermark("at", watermark).where("op in ('layout', 'layout_bulk')")
    return rows.groupBy("page_id", "op", "bubble", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n"))


def translation_stats(logs: DataFrame, watermark: str = "1 hour", width: str = "1 hour") -> DataFrame:
    return logs.withWatermark("created_at", watermark).groupBy(F.window("created_at", width), F.coalesce("key_label", F.lit("unknown")).alias("key_label"), F.coalesce("model_used", F.lit("unknown")).alias("model"), "variant").agg(F.count(F.lit(1)).alias("requests"))


def enrich(bubbles: DataFrame, corrections: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """New bubbles with the exact hit of the memory as it stands (a stream joined with a table), and, where a glossary is
    given, the ``terms`` that occur. Those are joined by words, so a stream takes them a batch at a time: see
    ``enrich_batches``."""
    held = memory.latest_per_source(corrections).select("project_id", "phrase_key", F.col("id").alias("correction_id"), "final_translation")
    keyed = bubbles.withColumn("phrase_key", F.when(text.is_short_phrase(F.col("text")), text.normalize_phrase(F.col("text"))))
    out = keyed.join(held, ["project_id", "phrase_key"], "left").drop("phrase_key")
    return out if terms is None else glossary.match_glossary(out, terms).withColumnRenamed("matches", "terms")


def enrich_batches(bubbles: DataFrame, corrections: DataFrame, terms: DataFrame, path: str, checkpoint: str, **fuzzy):
    """A stream of bubbles with exact hits and glossary terms; returns the writer. Bubbles that come with a ``query_id``
    and an ``embedding`` also get ``examples``, what ``tm_fuzzy`` finds for longer lines (rank, correction_id, similarity,
    overlap, final_translation; settings are passed on).

    A batch is written to a folder of its own number and replaces what is there, so a batch that is run again after a
    failure isn't doubled: reading ``path`` gives the rows of each batch once."""

    def put(batch: DataFrame, number: int) -> None:
        out = enrich(batch, corrections, terms)
        if {"query_id", "embedding"} <= set(batch.columns):
            found = memory.tm_fuzzy(batch, corrections, **fuzzy)
            row = F.struct("rank", "correction_id", "similarity", "overlap", "final_translation")
            out = out.join(found.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("examples")), "query_id", "left")
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return bubbles.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def reuse_counts(logs: DataFrame) -> DataFrame:
    """Times each entry was injected, over all entries that a log names (update or complete mode)."""
    return batch_logs.reuse_counts(logs)


def run_available(df: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Runs a stream over what is there, to a memory table; for tests and small jobs."""
    df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
