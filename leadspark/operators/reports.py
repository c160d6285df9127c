"""Counting reports over leads, outreach and messages (Q3-Q10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.config import rules as R
from leadspark.functions import scalars as S

c = F.col


def n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def rate(a: Column, b: Column) -> Column:
    """Percent with one decimal, half away from zero; null over nothing."""
    return F.round((100 * a).cast("decimal(20,4)") / F.nullif(b, F.lit(0)), 1).cast("double")


def _rates(rows: DataFrame, **pairs: tuple[str, str]) -> DataFrame:
    return rows.withColumns({k: rate(c(a), c(b)) for k, (a, b) in pairs.items()})


def campaign_funnel(leads: DataFrame) -> DataFrame:
    out = leads.groupBy("campaign_id").agg(
        F.count("*").alias("leads_discovered"),
        *(F.count(col).alias(name) for name, col in (("leads_cleaned", "cleaned_at"), ("leads_enriched", "enriched_at"), ("leads_evaluated", "qualified_at"))),
        n(c("qualified")).alias("leads_qualified"),
        n(c("stage") == "DISQUALIFIED").alias("leads_disqualified"),
        *(F.count(col).alias(name) for name, col in (("messages_generated", "message_generated_at"), ("messages_approved", "approved_at"), ("messages_sent", "first_sent_at"), ("replies", "replied_at"))),
        *(n(c("stage") == s).alias(s.lower()) for s in ("INTERESTED", "NURTURE", "NOT_INTERESTED")),
    )
    return _rates(out, qualification_rate=("leads_qualified", "leads_evaluated"), reply_rate=("replies", "messages_sent"))


def performance(leads: DataFrame, companies: DataFrame, by: str) -> DataFrame:
    """Sent, replies and rates by a company column and campaign."""
    rows = leads.join(companies.select("company_id", by), "company_id")
    out = rows.groupBy(by, "campaign_id").agg(F.count("first_sent_at").alias("sent"), F.count("replied_at").alias("replies"), n(c("stage") == "INTERESTED").alias("interested"))
    return _rates(out, reply_rate=("replies", "sent"), positive_reply_rate=("interested", "sent"))


def outreach_performance(outreach: DataFrame, leads: DataFrame, by: list[str]) -> DataFrame:
    rows = outreach.join(leads.select("lead_id", "campaign_id", "replied_at"), "lead_id")
    out = rows.groupBy(*by, "campaign_id").agg(F.count("sent_at").alias("sent"), F.count("replied_at").alias("replies"))
    return _rates(out, reply_rate=("replies", "sent"))


def reply_counts(messages: DataFrame, leads: DataFrame, companies: DataFrame, what: str) -> DataFrame:
    """Inbound messages by classification or objection, campaign and niche, with the last time."""
    rows = messages.where((c("direction") == "inbound") & c(what).isNotNull()).select("lead_id", what, "sent_at")
    rows = rows.join(leads.select("lead_id", "campaign_id", "company_id"), "lead_id").join(companies.select("company_id", "niche"), "company_id")
    return rows.groupBy(what, "campaign_id", "niche").agg(F.count("*").alias("n"), F.max("sent_at").alias("last_seen"))


def daily_activity(leads: DataFrame) -> DataFrame:
    return leads.groupBy(F.to_date("discovered_at").alias("day"), "campaign_id").agg(F.count("*").alias("leads_discovered"))


def lead_progress(leads: DataFrame) -> DataFrame:
    steps = {"cleaned": "cleaned_at", "enriched": "enriched_at", "evaluated": "qualified_at", "researched": "researched_at", "generated": "message_generated_at", "approved": "approved_at", "sent": "first_sent_at", "replied": "replied_at"}
    return leads.select("lead_id", "stage", S.stage_position(c("stage")).alias("position"), *(c(col).isNotNull().alias(k) for k, col in steps.items()))


#: Counters of the daily report, in its order.
COUNTERS = [
    "leads_discovered", "leads_enriched", "leads_evaluated", "leads_qualified", "messages_generated", "messages_approved", "messages_sent", "replies", "positive_replies",
    "followups_due", "interested_total", "nurture_total", "not_interested_total", "errors_open",
]


def daily_report(campaigns: DataFrame, leads: DataFrame, outreach: DataFrame, messages: DataFrame, followups: DataFrame, errors: DataFrame, day: str) -> DataFrame:
    """Q9: the counters of a day for each active campaign, with or without leads. followups: lead_id, state and
    due_at; errors: lead_id, created_at and resolved. One grouped sum for each table, joined by campaign."""
    at = F.lit(day).cast("date")
    on = lambda col: F.to_date(col) == at
    camp = leads.select("lead_id", "campaign_id")
    # Rows are summed by lead before they meet the leads, so a campaign's rows never travel twice.
    by_lead = lambda rows, **k: rows.groupBy("lead_id").agg(*(n(v).alias(name) for name, v in k.items()))
    o = by_lead(outreach.where(on("created_at") | on("approved_at") | on("sent_at")), messages_generated=on("created_at"), messages_approved=on("approved_at"), messages_sent=on("sent_at"))
    m = by_lead(messages.where((c("direction") == "inbound") & on("sent_at")), replies=F.lit(True), positive_replies=c("classification").isin(R.POSITIVE_REPLIES))
    f = by_lead(followups.where((c("state") == "SCHEDULED") & (F.to_date("due_at") <= at)), followups_due=F.lit(True))
    e = by_lead(errors.where(~c("resolved") & on("created_at")), errors_open=F.lit(True))
    out = campaigns.where("status = 'active'").select("campaign_id")
    own = leads.groupBy("campaign_id").agg(
        n(on("discovered_at")).alias("leads_discovered"),
        n(on("enriched_at")).alias("leads_enriched"),
        n(on("qualified_at")).alias("leads_evaluated"),
        n(on("qualified_at") & c("qualified")).alias("leads_qualified"),
        *(n(c("stage") == s).alias(f"{s.lower()}_total") for s in ("INTERESTED", "NURTURE", "NOT_INTERESTED")),
    )
    out = out.join(own, "campaign_id", "left")
    for part in (o, m, f, e):
        names = part.columns[1:]
        sums = part.join(camp, "lead_id").groupBy("campaign_id").agg(*(F.sum(k).alias(k) for k in names))
        out = out.join(sums, "campaign_id", "left")
    return out.select(F.lit(day).cast("date").alias("day"), "campaign_id", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in COUNTERS))


def daily_objects(report: DataFrame, breakdowns: dict[str, DataFrame]) -> DataFrame:
    """Q9 as objects: for each campaign and, with a null campaign_id, for all of them, the counters and each
    breakdown (rows with a campaign_id) as a JSON list in the order of its columns. The totals are a
    grouping set, so each table is summed once."""
    out = report.groupingSets([["day", "campaign_id"], ["day"]], "day", "campaign_id").agg(*(F.sum(k).alias(k) for k in COUNTERS))
    for name, rows in breakdowns.items():
        item = F.struct(*rows.columns)
        listed = rows.withColumn("item", item).groupingSets([["campaign_id"], []], "campaign_id").agg(F.to_json(F.sort_array(F.collect_list("item")), {"ignoreNullFields": "false"}).alias(name))
        out = out.withColumnRenamed("campaign_id", "_id").join(listed, c("_id").eqNullSafe(c("campaign_id")), "left").drop("campaign_id").withColumnRenamed("_id", "campaign_id")
    return out.select("day", "campaign_id", *COUNTERS, *(F.coalesce(k, F.lit("[]")).alias(k) for k in breakdowns))


def usage_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, mean latency and cost by provider and day; prices is a small table of list prices."""
    rows = calls.join(prices, "kind")
    return rows.groupBy("kind", F.to_date("sent_at").alias("day")).agg(F.count("*").alias("calls"), F.round(F.avg("value"), 6).alias("latency"), F.round(F.sum(c("value") * c("price")), 4).alias("cost"))


def sent_twice(outreach: DataFrame) -> DataFrame:
    """Leads with more than one sent message of a kind."""
    return outreach.where(c("sent_at").isNotNull()).groupBy("lead_id", "kind").agg(F.count("*").alias("sent")).where("sent > 1")


def stuck(leads: DataFrame, now: str, hours: int = 24) -> DataFrame:
    old = c("updated_at") < F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    return leads.where(c("status").isin("PROCESSING", "ERROR") & old).groupBy("stage", "status").agg(F.count("*").alias("n"), F.min("updated_at").alias("oldest"))


def companies_in_campaigns(leads: DataFrame) -> DataFrame:
    return leads.groupBy("company_id").agg(F.countDistinct("campaign_id").alias("campaigns")).where("campaigns > 1")


def small_samples(performance: DataFrame, least: int = 20) -> DataFrame:
    return performance.withColumn("small_sample", c("sent") < least)


def leads_full(leads: DataFrame, companies: DataFrame, campaigns: DataFrame, niches: DataFrame, contacts: DataFrame, qualifications: DataFrame, research: DataFrame, outreach: DataFrame) -> DataFrame:
    """Q1: each lead with its campaign and company (both must exist), niche, contact and the latest qualification,
    research and draft. The three histories have lead_id, created_at and seq, which breaks ties; each is one
    grouped maximum, so a lead's history never meets in a list. Leads travel whole once, by their id: companies and
    contacts come to them by pairs of ids, so leads without a contact, or of one company, don't fill one task."""

    def last(rows: DataFrame, *names: str) -> DataFrame:
        return rows.groupBy("lead_id").agg(F.max(F.struct("created_at", "seq", *names)).alias("x")).select("lead_id", *(f"x.{k}" for k in names))

    def of_leads(rows: DataFrame, key: str) -> DataFrame:
        """The rows by lead, with the lead's key as _key."""
        pairs = leads.where(c(key).isNotNull()).select("lead_id", key).repartition(key).distinct()
        return pairs.join(rows, key).withColumnsRenamed({"lead_id": "_lead", key: "_key"})

    def with_own(own: DataFrame, rows: DataFrame, key: str, how: str) -> DataFrame:
        # Two comparisons, not one equality: the join stays dealt by the lead alone, as all others are.
        same = (c("lead_id") == c("_lead")) & (c(key) <= c("_key")) & (c(key) >= c("_key"))
        return own.join(of_leads(rows, key), same, how).drop("_lead", "_key")

    q = last(qualifications.withColumnRenamed("reason", "qualification_reason"), "qualification_reason", "potential_pain_points")
    r = last(research, "business_summary", "why_relevant")
    o = last(outreach.select("lead_id", "created_at", "seq", c("message").alias("latest_message"), c("variation").alias("latest_variation"), c("status").alias("message_status"), c("sent_at").alias("last_message_sent_at")),
             "latest_message", "latest_variation", "message_status", "last_message_sent_at")
    co = companies.select(
        "company_id", c("name").alias("business_name"), "instagram_handle", "instagram_url", "website", "website_domain", "niche_id", "state", "city", "ig_followers", "ig_posts", "products_count", "products_services",
        c("email").alias("company_email"), c("phone").alias("company_phone"), "ig_last_post_at",
    )
    ct = contacts.select(
        "contact_id", c("full_name").alias("decision_maker"), c("title").alias("decision_maker_title"), c("role_category").alias("decision_maker_role"), c("email").alias("decision_maker_email"),
        c("linkedin_url").alias("decision_maker_linkedin"), c("target_reason").alias("decision_maker_reason"),
    )
    own = leads
    for rows in (q, r, o):
        own = own.join(rows, "lead_id", "left")
    co = co.join(niches.select("niche_id", c("name").alias("niche_name")), "niche_id", "left")
    own = with_own(with_own(own.where(c("lead_id").isNotNull()), co, "company_id", "inner"), ct, "contact_id", "left")
    nameless = leads.where(c("lead_id").isNull()).join(co, "company_id").join(ct, "contact_id", "left")
    own = own.unionByName(nameless, allowMissingColumns=True)
    return own.join(campaigns.select("campaign_id", c("name").alias("campaign_name")), "campaign_id")


def export(full: DataFrame) -> DataFrame:
    """Q11: the columns of the shared sheet, qualified leads only."""
    return full.where("qualified").select(
        c("public_ref").alias("Lead ID"), c("business_name").alias("Business Name"), c("instagram_handle").alias("Instagram"), c("website").alias("Website"), c("niche_name").alias("Niche"), c("state").alias("State"), c("city").alias("City"),
        c("ig_followers").alias("Followers"), c("products_count").alias("Products/Services"), c("decision_maker").alias("Founder / Decision Maker"), c("decision_maker_title").alias("Decision Maker Role"),
        F.coalesce("decision_maker_email", "company_email").alias("Email"), c("company_phone").alias("Phone"), c("icp_score").alias("ICP Score"), c("icp_band").alias("Qualification"),
        F.get("potential_pain_points", F.lit(0)).alias("Pain Point"), c("recommended_service").alias("Recommended Service"), c("outreach_angle").alias("Outreach Angle"), c("latest_message").alias("Generated Message"),
        c("message_status").alias("Message Status"), c("status").alias("Response Status"), c("next_followup_at").alias("Follow-up Date"), c("notes").alias("Notes"), c("campaign_id").alias("Campaign"), c("lead_id").alias("_lead_uuid"),
    )


def many_keys(keys: DataFrame, companies: DataFrame, most: int = 2) -> DataFrame:
    """Company names that more identity keys than `most` lead to. Keys are summed by company before the names."""
    rows = keys.groupBy("company_id").agg(F.count("*").alias("keys")).join(companies.select("company_id", "name"), "company_id")
    return rows.groupBy("name").agg(F.sum("keys").alias("keys")).where(c("keys") > most)


def waiting_after_reply(followups: DataFrame, leads: DataFrame) -> DataFrame:
    """Steps still scheduled although the lead has replied; there should be none."""
    replied = leads.where(c("replied_at").isNotNull()).select("lead_id", "replied_at")
    return followups.where("state = 'SCHEDULED'").join(replied, "lead_id").select("lead_id", "replied_at", "step", "due_at")


def open_errors(errors: DataFrame, by: list[str], now: str | None = None, hours: int = 24) -> DataFrame:
    """Unresolved errors by columns, those of the last hours if `now` is given."""
    rows = errors.where(~c("resolved"))
    if now:
        rows = rows.where(c("created_at") > F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours)))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))


def failing_stages(leads: DataFrame) -> DataFrame:
    return leads.where("status = 'ERROR'").groupBy("stage").agg(F.count("*").alias("n"), F.max("retry_count").alias("worst"))


def stage_status(leads: DataFrame) -> DataFrame:
    return leads.groupBy("stage", "status").agg(F.count("*").alias("n"))


def approval_backlog(outreach: DataFrame, leads: DataFrame) -> DataFrame:
    """Drafts that wait for review by campaign; drafts are summed by lead before they meet the leads."""
    waiting = outreach.where("status = 'PENDING_REVIEW'").groupBy("lead_id").agg(F.count("*").alias("waiting"))
    return waiting.join(leads.select("lead_id", "campaign_id"), "lead_id").groupBy("campaign_id").agg(F.sum("waiting").alias("waiting"))


def recent_runs(runs: DataFrame, now: str, hours: int = 24) -> DataFrame:
    return runs.where(c("started_at") > F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours)))


def steps_before_reply(leads: DataFrame) -> DataFrame:
    return leads.where(c("replied_at").isNotNull()).groupBy("followup_step").agg(F.count("*").alias("n"))


def run_summary(leads: DataFrame) -> DataFrame:
    """One row: leads by band, with a score, and whether all wait for approval."""
    s = c("icp_score")
    return leads.agg(
        F.count("*").alias("n"), n(s >= 80).alias("best"), n((s >= 65) & (s < 80)).alias("good"), n((s >= 50) & (s < 65)).alias("review"), n(s < 50).alias("bad"),
        n(s.isNull()).alias("unscored"), F.bool_and(c("approved_at").isNull()).alias("all_pending"),
    )
