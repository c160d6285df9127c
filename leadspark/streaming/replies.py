"""Reply streams: dedup, counters, sequence stops (ST1-ST5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.operators import lifecycle as L

c = F.col


def distinct_messages(stream: DataFrame, late: str = "1 hour", key: str = "external_message_id") -> DataFrame:
    """One row for each external id within the watermark; rows without an id pass."""
    marked = stream.withWatermark("sent_at", late)
    named = marked.where(c(key).isNotNull()).dropDuplicatesWithinWatermark([key])
    return named.unionByName(marked.where(c(key).isNull()))


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Messages by day and direction."""
    rows = stream.withWatermark("sent_at", late).groupBy(F.window("sent_at", "1 day").alias("w"), "direction").agg(F.count("*").alias("messages"))
    return rows.select(F.to_date("w.start").alias("day"), "direction", "messages")


def thread_counters(messages: DataFrame) -> DataFrame:
    """By lead: count, first reply, last time and its direction; the same in any order of arrival."""
    inbound = F.when(c("direction") == "inbound", c("sent_at"))
    return messages.groupBy("lead_id").agg(
        F.count("*").alias("message_count"),
        F.min(inbound).alias("replied_at"),
        F.max("sent_at").alias("last_message_at"),
        F.max_by("event_id", F.struct("sent_at", "event_id")).alias("last_event_id"),
        F.max_by("direction", F.struct("sent_at", "event_id")).alias("last_direction"),
    )


def merge_counters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counters of two sets of messages together; of messages at one time the last by event id stands."""
    both = old.unionByName(new)
    return both.groupBy("lead_id").agg(
        F.sum("message_count").alias("message_count"),
        F.min("replied_at").alias("replied_at"),
        F.max("last_message_at").alias("last_message_at"),
        F.max_by("last_event_id", F.struct("last_message_at", "last_event_id")).alias("last_event_id"),
        F.max_by("last_direction", F.struct("last_message_at", "last_event_id")).alias("last_direction"),
    )


def stop_sequences(replies: DataFrame, followups: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that, batch by batch, cancels the follow-ups of leads that replied.
    Cancelling twice changes nothing, so a repeated batch is harmless."""

    def batch(rows: DataFrame, number: int) -> None:
        first = rows.where(c("direction") == "inbound").groupBy("lead_id").agg(F.min("sent_at").alias("replied_at"))
        leads = first.withColumns({"status": F.lit("REPLIED"), "stage": F.lit("REPLIED")})
        mine = followups().join(leads.select("lead_id"), "lead_id", "left_semi")
        save(L.cancel(mine, leads).where(c("state") == "CANCELLED"), number)

    return replies.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
