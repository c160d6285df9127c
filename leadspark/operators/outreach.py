"""Failures, replies and companies as tables applied to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.operators import identity as ID

c = F.col


def retry_after_seconds(retries: Column) -> Column:
    """Capped at an hour: 2 ** min(retries, 11) seconds."""
    return F.least(F.lit(3600), F.pow(F.lit(2), F.least(retries, F.lit(11)))).cast("int")


def fail_leads(leads: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """failures: (lead_id, message, error_type, at). (leads, error rows with next_retry_at)."""
    n = failures.groupBy("lead_id").agg(F.count("*").alias("n"), F.max_by("message", F.struct("at", "message")).alias("message"), F.max("at").alias("at"))
    rows = leads.join(n, "lead_id", "left")
    failed = c("n").isNotNull()
    out = rows.withColumns(
        {
            "retry_count": c("retry_count") + F.coalesce("n", F.lit(0)).cast("int"),
            "status": F.when(failed, "ERROR").otherwise(c("status")),
            "last_error": F.when(failed, F.substring("message", 1, 500)).otherwise(c("last_error")),
            "updated_at": F.coalesce("at", "updated_at"),
        }
    ).drop("n", "message", "at")
    errors = failures.join(out.select("lead_id", "retry_count"), "lead_id")
    return out, errors.withColumn("next_retry_at", c("at") + F.make_interval(secs=retry_after_seconds(c("retry_count"))))


def after_last_step(leads: DataFrame, followups: DataFrame, days: int = 90) -> DataFrame:
    """Leads whose last follow-up went out without a reply: to NURTURE, to be looked at again."""
    last = followups.where((c("kind") == "followup_3_final") & (c("state") == "SENT")).select("lead_id", c("due_at").alias("_last"))
    rows = leads.join(last.groupBy("lead_id").agg(F.max("_last").alias("_last")), "lead_id", "left")
    quiet = c("_last").isNotNull() & c("replied_at").isNull()
    return rows.withColumns({"stage": F.when(quiet, "NURTURE").otherwise(c("stage")), "status": F.when(quiet, "NO_RESPONSE").otherwise(c("status")), "recheck_at": F.when(quiet, F.date_add("_last", days)).otherwise(c("recheck_at"))}).drop("_last")


def match_replies(replies: DataFrame, leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By the given lead id, else by handle; (matched, orphans)."""
    by_id = leads.select(c("lead_id").alias("given_lead"), c("lead_id").alias("_a"))
    by_handle = leads.where(c("instagram_handle").isNotNull()).groupBy(c("instagram_handle").alias("handle")).agg(F.min("lead_id").alias("_b"))
    rows = replies.join(by_id, "given_lead", "left").join(by_handle, "handle", "left").withColumn("lead_id", F.coalesce("_a", "_b")).drop("_a", "_b")
    return rows.where(c("lead_id").isNotNull()), rows.where(c("lead_id").isNull()).drop("lead_id")


def resolve_companies(incoming: DataFrame, known_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """incoming: canonical rows with seq; known_keys: (key_type, key_value, company_id). (seq with
    the company of its strongest known key, or null; keys that nobody owns yet, by first row)."""
    keys = ID.identity_keys(incoming, "seq")
    hit = keys.join(known_keys, ["key_type", "key_value"])
    best = hit.groupBy("seq").agg(F.min_by("company_id", "priority").alias("company_id"))
    resolved = incoming.select("seq").join(best, "seq", "left")
    fresh = keys.join(known_keys.select("key_type", "key_value"), ["key_type", "key_value"], "left_anti").groupBy("key_type", "key_value").agg(F.min("seq").alias("seq"))
    return resolved, fresh.join(resolved, "seq", "left")


# Where a class of reply leads, and which classes a person always answers.
ROUTES = {"opt_out": "opt_out", "not_interested": "NOT_INTERESTED", "maybe_later": "NURTURE", "auto_reply": "none"}
SENSITIVE = ["pricing", "objection", "opt_out", "wrong_person", "not_interested"]
UNUSABLE = {
    "classification": "unclear", "intent": "could not classify automatically", "sentiment": "neutral", "urgency": "medium",
    "recommended_action": "route_to_human", "suggested_stage": "REPLIED",
}


def route_replies(replies: DataFrame) -> DataFrame:
    """L10. replies: usable (the classifier's output passed its checks), the fields of that output, and
    needs_review (of the drafted answer). A reply without usable output is unclear and goes to a person."""
    ok = F.coalesce(c("usable"), F.lit(False))
    rows = replies.withColumns({k: F.when(ok, c(k)).otherwise(v) for k, v in UNUSABLE.items()} | {k: F.when(ok, c(k)).otherwise(True) for k in ("requires_human", "stop_followups")})
    routes = F.create_map(*(F.lit(x) for pair in ROUTES.items() for x in pair))
    return rows.withColumns(
        {
            "fallback": ~ok,
            "route": F.coalesce(F.try_element_at(routes, c("classification")), F.lit("assistant")),
            "requires_human_review": F.coalesce(c("needs_review"), F.lit(True)) | F.coalesce(c("classification").isin(SENSITIVE), F.lit(False)),
        }
    )


def apply_messages(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """L12. threads: conv_id, message_count, last_message_at, last_direction, state; messages: conv_id, id,
    sent_at, direction. A message in makes the thread wait for us; a message out ends such a wait.
    Messages count in the order (sent_at, id), so the result is the same however they arrive."""
    order = F.struct("sent_at", "id")
    new = messages.groupBy("conv_id").agg(
        F.count("*").alias("_n"), F.max("sent_at").alias("_at"), F.max_by("direction", order).alias("_last"), F.max(c("direction") == "inbound").alias("_in")
    )
    rows = threads.join(new, "conv_id", "left")
    waited = c("_in") | F.coalesce(c("state") == "AWAITING_US", F.lit(False))
    state = F.when(c("_last") == "inbound", "AWAITING_US").when((c("_last") == "outbound") & waited, "AWAITING_PROSPECT").otherwise(c("state"))
    return rows.withColumns(
        {
            "message_count": c("message_count") + F.coalesce("_n", F.lit(0)),
            "last_message_at": F.coalesce("_at", "last_message_at"),
            "last_direction": F.coalesce("_last", "last_direction"),
            "state": state,
        }
    ).drop("_n", "_at", "_last", "_in")
