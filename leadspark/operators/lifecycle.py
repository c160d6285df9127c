"""State changes of leads as set-based jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.config import rules as R
from leadspark.functions import scalars as S

c = F.col


def advance(leads: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (lead_id, to_stage, to_status, at, seq). A stage never goes back; the last
    status stands; requests of one lead are taken in order of seq."""
    want = requests.withColumn("to_position", S.stage_position(c("to_stage")))
    folded = want.groupBy("lead_id").agg(
        F.max_by("to_stage", F.struct("to_position", "seq")).alias("to_stage"),
        F.max("to_position").alias("to_position"),
        F.max_by("to_status", "seq").alias("to_status"),
        F.max("at").alias("at"),
    )
    rows = leads.join(folded, "lead_id", "left")
    forward = c("to_position") >= S.stage_position(c("stage"))
    return rows.withColumns(
        {"stage": F.when(forward, c("to_stage")).otherwise(c("stage")), "status": F.coalesce("to_status", "status"), "updated_at": F.coalesce("at", "updated_at")}
    ).drop("to_stage", "to_position", "to_status", "at")


def next_slot(ts: Column, start: int = 9, end: int = 18, days: tuple[int, ...] = (1, 2, 3, 4, 5)) -> Column:
    """The first moment at or after ts inside the sending hours of a sending day (0 is Sunday; UTC)."""
    day = F.date_trunc("day", ts)
    allowed = F.array(*(F.lit(d) for d in days))
    plus = lambda k: day + F.make_interval(days=k)
    today = F.array_contains(allowed, (F.dayofweek(ts) - 1).cast("int"))
    hour = F.hour(ts)
    later = F.filter(F.sequence(F.lit(1), F.lit(13)), lambda k: F.array_contains(allowed, (F.dayofweek(plus(k)) - 1).cast("int")))
    opening = plus(F.get(later, F.lit(0))) + F.make_interval(hours=F.lit(start))
    return F.when(today & (hour < start), day + F.make_interval(hours=F.lit(start))).when(today & (hour < end), ts).otherwise(opening)


def schedule(sent: DataFrame, offsets: list[int] | None = None, window: dict | None = None) -> DataFrame:
    """sent: (lead_id, sent_at). Up to three follow-ups for each lead."""
    days = F.array(*(F.lit(d) for d in (offsets or R.DAY_OFFSETS)[: len(R.FOLLOWUP_KINDS)]))
    rows = sent.select("lead_id", "sent_at", F.posexplode(days).alias("i", "day_offset"))
    due = c("sent_at") + F.make_interval(days=c("day_offset"))
    kinds = F.array(*(F.lit(k) for k in R.FOLLOWUP_KINDS))
    return rows.select("lead_id", (c("i") + 1).alias("step"), F.get(kinds, c("i")).alias("kind"), (due if window is None else next_slot(due, **window)).alias("due_at"))


def new_followups(planned: DataFrame, existing: DataFrame) -> DataFrame:
    return planned.join(existing.select("lead_id", "step"), ["lead_id", "step"], "left_anti")


def stop_reason(replied_at: Column, status: Column, stage: Column) -> Column:
    return (
        F.when(replied_at.isNotNull(), "reply_received")
        .when(status.isin(R.STOP_STATUSES), F.concat(F.lit("status_"), F.lower(status)))
        .when(stage.isin(R.STOP_STAGES), F.concat(F.lit("stage_"), F.lower(stage)))
    )


def cancel(followups: DataFrame, leads: DataFrame) -> DataFrame:
    """followups: (lead_id, step, state, cancel_reason and more). Those of stopped leads that did
    not go out yet (PENDING, SCHEDULED) become CANCELLED with the reason; all others stay."""
    why = leads.select("lead_id", stop_reason(c("replied_at"), c("status"), c("stage")).alias("_why"))
    rows = followups.join(why, "lead_id", "left")
    stop = c("_why").isNotNull() & c("state").isin("PENDING", "SCHEDULED")
    return rows.withColumns({"state": F.when(stop, "CANCELLED").otherwise(c("state")), "cancel_reason": F.when(stop, c("_why")).otherwise(c("cancel_reason"))}).drop("_why")


def reject_drafts(outreach: DataFrame, leads: DataFrame) -> DataFrame:
    """Drafts of follow-ups that were not sent yet are rejected once their lead is stopped."""
    stopped = leads.where(stop_reason(c("replied_at"), c("status"), c("stage")).isNotNull()).select("lead_id", F.lit(True).alias("_stop"))
    rows = outreach.join(stopped, "lead_id", "left")
    out = c("_stop") & c("status").isin("DRAFT", "PENDING_REVIEW", "APPROVED") & c("sent_at").isNull() & (c("kind") != "initial")
    return rows.withColumn("status", F.when(out, "REJECTED").otherwise(c("status"))).drop("_stop")
