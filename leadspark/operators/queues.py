"""Ordered work: batches, latest rows, daily limits, send lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.config import rules as R
from leadspark.operators.ranking import with_place

c = F.col


def work_batch(leads: DataFrame, stage: str, now: str, per_campaign: int, stale_minutes: int = 20, max_retries: int = 3) -> DataFrame:
    """The next leads of a stage in each campaign."""
    stale = (c("status") == "PROCESSING") & (c("updated_at") < F.lit(now).cast("timestamp") - F.make_interval(mins=F.lit(stale_minutes)))
    ready = leads.where((c("stage") == stage) & (c("status").isin("NEW", "ERROR") | stale) & (c("retry_count") <= max_retries))
    order = Window.partitionBy("campaign_id").orderBy(c("icp_score").desc_nulls_last(), "discovered_at", "lead_id")
    return ready.withColumn("rank", F.row_number().over(order)).where(c("rank") <= per_campaign)


def latest(history: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key; the order must be total."""
    last = history.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r"))
    return last.select("r.*")


def daily_release(approved: DataFrame, sent_today: DataFrame, limit: int) -> DataFrame:
    """approved: (campaign_id, is_initial, ready_at, item); sent_today: (campaign_id, is_initial, sent). Adds `released`."""
    rows = approved.join(sent_today, ["campaign_id", "is_initial"], "left")
    room = F.greatest(F.lit(0), F.lit(limit) - F.coalesce("sent", F.lit(0)))
    rows = with_place(rows, ["campaign_id", "is_initial"], [c("ready_at").asc(), c("item").asc()], "rank")
    return rows.withColumn("released", c("rank") <= room).drop("sent")


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "high", 0).when(priority == "medium", 1).when(priority == "low", 2).otherwise(3)


def send_queue(outreach: DataFrame, leads: DataFrame, companies: DataFrame) -> DataFrame:
    """Approved messages that were not sent, with what the sender needs."""
    ready = outreach.where((c("status") == "APPROVED") & c("sent_at").isNull())
    rows = ready.join(leads.select("lead_id", "company_id", "campaign_id", "icp_score"), "lead_id")
    return rows.join(companies.select("company_id", "name", "website_domain"), "company_id").select("lead_id", "line", "part", "kind", "campaign_id", "icp_score", "name", "website_domain", "created_at")


def followups_due(followups: DataFrame, leads: DataFrame, now: str) -> DataFrame:
    open_leads = leads.where(c("replied_at").isNull() & ~c("status").isin(R.STOP_STATUSES)).select("lead_id", "stage", "icp_score")
    return followups.where(c("due_at") <= F.lit(now).cast("timestamp")).join(open_leads, "lead_id")


def next_batch(leads: DataFrame, offset: int, size: int) -> DataFrame:
    """A page of leads: with a website first, then by score, then by key; the order is total."""
    return leads.orderBy(c("website_domain").isNull(), c("icp_score").desc_nulls_last(), "lead_id").offset(offset).limit(size)


def send_list(rows: DataFrame, min_score: int) -> DataFrame:
    """Rows with a message and enough score, best first; a missing handle is marked."""
    ready = rows.where(c("message").isNotNull() & (c("icp_score") >= min_score))
    return ready.withColumn("handle", F.coalesce("instagram_handle", F.lit("(missing)"))).orderBy(c("icp_score").desc(), "lead_id")
