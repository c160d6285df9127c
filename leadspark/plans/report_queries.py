"""Reports, queues and state changes over the derived lead tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.config import rules as R
from leadspark.functions import scalars as S
from leadspark.operators import lifecycle as L
from leadspark.operators import outreach as O
from leadspark.operators import queues as T
from leadspark.operators import reports as Q
from leadspark.plans.inputs import table, with_sql
from leadspark.streaming import replies as ST

c = F.col
DAY = "1996-03-13"
NOW = "1998-01-01 00:00:00"


def _q(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(lambda name: table(spark, sf_dir, name))

    return run


def _rate(a: str, b: str) -> str:
    return f"cast(round(cast(100 * {a} as decimal(20,4)) / nullif({b}, 0), 1) as double)"


def _list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def _prices(t) -> DataFrame:
    kinds = t("messages").select("kind").distinct()
    return kinds.withColumn("price", F.length("kind") / 100)


def _followups(t) -> DataFrame:
    sent = t("leads").where(c("first_sent_at").isNotNull()).select("lead_id", c("first_sent_at").alias("sent_at"))
    return L.schedule(sent)


def _release(t) -> DataFrame:
    camp = t("leads").select("lead_id", "campaign_id")
    rows = t("outreach").join(camp, "lead_id").withColumn("is_initial", c("kind") == "initial")
    approved = rows.where(c("status") == "APPROVED").select("campaign_id", "is_initial", c("created_at").alias("ready_at"), F.struct("lead_id", "line", "part").alias("item"))
    sent = rows.where(F.to_date("sent_at") == F.lit(DAY).cast("date")).groupBy("campaign_id", "is_initial").agg(F.count("*").alias("sent"))
    out = T.daily_release(approved, sent, 30)
    return out.groupBy("campaign_id", "is_initial").agg(F.count(F.when(c("released"), 1)).alias("released"), F.count(F.when(~c("released"), 1)).alias("held"))


def _advance(t) -> DataFrame:
    requests = t("messages").where(c("direction") == "inbound").select(
        "lead_id",
        F.when(c("classification") == "interested", "INTERESTED").when(c("classification") == "unclear", "CLEANED").otherwise("REPLIED").alias("to_stage"),
        F.lit("REPLIED").alias("to_status"),
        c("sent_at").alias("at"),
        c("event_id").alias("seq"),
    )
    return L.advance(t("leads"), requests).select("lead_id", "stage", "status", "updated_at")


def _slots(t) -> DataFrame:
    return t("messages").select("event_id", L.next_slot(c("sent_at")).alias("slot"))


_STATE = "case when (lead_id + step) % 4 = 0 then 'SENT' when (lead_id + step) % 4 = 1 then 'PENDING' when (lead_id + step) % 9 = 2 then 'CANCELLED' else 'SCHEDULED' end"


def _in_progress(t) -> DataFrame:
    """Follow-ups of which some went out or were cancelled before."""
    rows = _followups(t).withColumn("state", F.expr(_STATE))
    return rows.withColumn("cancel_reason", F.when(c("state") == "CANCELLED", "by_hand"))


def _failed(t) -> DataFrame:
    leads = t("leads").withColumn("last_error", F.when(c("lead_id") % 3 == 0, "earlier"))
    bad = t("messages").where("event_id % 3 = 1").select("lead_id", c("kind").alias("message"), F.lit("timeout").alias("error_type"), c("sent_at").alias("at"))
    return O.fail_leads(leads, bad)[0].select("lead_id", "retry_count", "status", "last_error", "updated_at")


def _nurture(t) -> DataFrame:
    leads = t("leads").withColumn("recheck_at", F.when(c("lead_id") % 2 == 0, F.lit("2020-01-01").cast("date")))
    return O.after_last_step(leads, _in_progress(t)).select("lead_id", "stage", "status", "recheck_at")


def _counters(t) -> DataFrame:
    """Counters of two halves of the messages, put together."""
    halves = [ST.thread_counters(t("messages").where(f"event_id % 2 = {i}")) for i in (0, 1)]
    return ST.merge_counters(*halves)


#: Messages moved to the days of the leads, drafts with a day of approval, errors from messages.
_MOVED = "sent_at - interval '10164' day"
_APPROVED = "case when status <> 'PENDING_REVIEW' then created_at + interval '1' day end"
_ERRORS = {"created_at": _MOVED, "resolved": "event_id % 2 = 0"}


def _report(t) -> DataFrame:
    campaigns = t("quiet").unionByName(t("leads").select("campaign_id").distinct().withColumn("status", F.lit("active")))
    messages = t("messages")
    errors = messages.where("event_id % 3 = 1").select("lead_id", *(F.expr(e).alias(k) for k, e in _ERRORS.items()))
    outreach = t("outreach").withColumn("approved_at", F.expr(_APPROVED))
    return Q.daily_report(campaigns, t("leads"), outreach, messages.withColumn("sent_at", F.expr(_MOVED)), _in_progress(t), errors, DAY)


def _objects(t) -> DataFrame:
    leads, companies = t("leads"), t("companies")
    replies = lambda what: Q.reply_counts(t("messages"), leads, companies, what).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))
    parts = {
        "by_niche": Q.performance(leads, companies, "niche"), "by_state": Q.performance(leads, companies, "state"), "by_angle": Q.outreach_performance(t("outreach"), leads, ["angle", "kind"]),
        "reply_categories": replies("classification"), "objections": replies("objection"),
    }
    return Q.daily_objects(_report(t), parts)


#: The view's columns in its order.
_VIEW = [
    "lead_id", "public_ref", "campaign_id", "campaign_name", "company_id", "business_name", "instagram_handle", "instagram_url", "website", "website_domain", "niche_id", "niche_name", "state", "city", "ig_followers", "ig_posts",
    "products_count", "products_services", "company_email", "company_phone", "decision_maker", "decision_maker_title", "decision_maker_role", "decision_maker_email", "decision_maker_linkedin", "decision_maker_reason", "stage", "status",
    "icp_score", "icp_band", "priority", "qualified", "disqualified_reason", "recommended_service", "outreach_angle", "qualification_reason", "first_pain", "business_summary", "why_relevant", "latest_message", "latest_variation",
    "message_status", "last_message_sent_at", "replied_at", "next_followup_at", "followup_step", "retry_count", "last_error", "cleaning_flags", "ig_last_post_at", "discovered_at", "notes", "sheets_synced_at", "updated_at",
]


def _full(t) -> DataFrame:
    leads, companies = t("full_leads"), t("full_companies")
    campaigns = leads.where("campaign_id not like '5%'").select("campaign_id", F.concat(F.lit("Campaign "), "campaign_id").alias("name")).distinct()
    niches = companies.where("niche_id <> 'machinery'").select("niche_id", F.initcap("niche_id").alias("name")).distinct()
    pains = F.array_compact(F.array("first_pain", F.lit("last pain")))
    return Q.leads_full(leads, companies, campaigns, niches, t("contact_rows"), t("verdicts").where("odd = 1").withColumn("potential_pain_points", pains), t("briefs").where("odd = 1"), t("drafts"))


def _keys(t) -> DataFrame:
    rows = t("companies")
    return rows.select("company_id", F.explode(F.array_compact(F.array("website_domain", "phone", "name"))).alias("key_value"))


def _typed_errors(t) -> DataFrame:
    return t("messages").where("event_id % 3 = 1").select(c("kind").alias("workflow"), c("classification").alias("provider"), c("objection").alias("error_type"), *(F.expr(e).alias(k) for k, e in _ERRORS.items()))


def _batch(t) -> DataFrame:
    rows = t("leads").join(t("companies").select("company_id", "website_domain"), "company_id")
    return T.next_batch(rows, 10, 40).select("lead_id", "icp_score", "website_domain")


QUERIES = {
    "q01_leads_full": _q(lambda t: _full(t).withColumn("first_pain", F.get("potential_pain_points", F.lit(0))).select(*_VIEW)),
    "q11_export": _q(lambda t: Q.export(_full(t))),
    "q06_many_keys": _q(lambda t: Q.many_keys(_keys(t), t("companies"))),
    "q06_waiting_after_reply": _q(lambda t: Q.waiting_after_reply(_in_progress(t), t("leads"))),
    "q06_recent_errors": _q(lambda t: Q.open_errors(_typed_errors(t), ["workflow", "provider", "error_type"], f"{DAY} 00:00:00", 24 * 90)),
    "q06_open_errors": _q(lambda t: Q.open_errors(_typed_errors(t), ["provider", "error_type"])),
    "q06_failing_stages": _q(lambda t: Q.failing_stages(t("leads"))),
    "q06_stage_status": _q(lambda t: Q.stage_status(t("leads"))),
    "q06_approval_backlog": _q(lambda t: Q.approval_backlog(t("outreach"), t("leads"))),
    "q06_recent_runs": _q(lambda t: Q.recent_runs(t("run_rows"), f"{DAY} 12:00:00", 24 * 30)),
    "q06_steps_before_reply": _q(lambda t: Q.steps_before_reply(t("full_leads"))),
    "q12_run_summary": _q(lambda t: Q.run_summary(t("leads"))),
    "t01_next_batch": _q(_batch),
    "q03_lead_progress": _q(lambda t: Q.lead_progress(t("leads"))),
    "q04_campaign_funnel": _q(lambda t: Q.campaign_funnel(t("leads"))),
    "q05_performance_by_niche": _q(lambda t: Q.performance(t("leads"), t("companies"), "niche")),
    "q05_performance_by_state": _q(lambda t: Q.performance(t("leads"), t("companies"), "state")),
    "q05_performance_by_angle": _q(lambda t: Q.outreach_performance(t("outreach"), t("leads"), ["angle", "kind"])),
    "q05_performance_by_variation": _q(lambda t: Q.outreach_performance(t("outreach"), t("leads"), ["variation"])),
    "q06_sent_twice": _q(lambda t: Q.sent_twice(t("outreach"))),
    "q06_stuck_leads": _q(lambda t: Q.stuck(t("leads"), NOW)),
    "q06_companies_in_campaigns": _q(lambda t: Q.companies_in_campaigns(t("leads"))),
    "q07_reply_categories": _q(lambda t: Q.reply_counts(t("messages"), t("leads"), t("companies"), "classification")),
    "q07_objections": _q(lambda t: Q.reply_counts(t("messages"), t("leads"), t("companies"), "objection")),
    "q08_daily_activity": _q(lambda t: Q.daily_activity(t("leads"))),
    "q09_daily_report": _q(_report),
    "q09_daily_objects": _q(_objects),
    "q10_small_samples": _q(lambda t: Q.small_samples(Q.performance(t("leads"), t("companies"), "niche"))),
    "q13_usage_cost": _q(lambda t: Q.usage_cost(t("messages"), _prices(t))),
    "t02_work_batch": _q(lambda t: T.work_batch(t("leads"), "REPLIED", NOW, 25).select("campaign_id", "lead_id", "rank")),
    "t03_latest_outreach": _q(lambda t: T.latest(t("outreach"), "lead_id", c("created_at"), c("line"), c("part"), c("cost")).select("lead_id", "created_at", "line", "part")),
    "t04_daily_release": _q(_release),
    "q02_send_queue": _q(lambda t: T.send_queue(t("outreach"), t("leads"), t("companies"))),
    "q02_followups_due": _q(lambda t: T.followups_due(_followups(t), t("leads"), NOW).select("lead_id", "step", "kind", "due_at", "stage", "icp_score")),
    "l01_advance": _q(_advance),
    "l03_schedule": _q(_followups),
    "l04_next_slot": _q(_slots),
    "l05_cancel": _q(lambda t: L.cancel(_in_progress(t), t("leads")).select("lead_id", "step", "state", "cancel_reason")),
    "l05_reject_drafts": _q(lambda t: L.reject_drafts(t("outreach"), t("leads")).select("lead_id", "line", "part", "kind", "status")),
    "l02_failures": _q(_failed),
    "l11_nurture": _q(_nurture),
    "st3_counters": _q(_counters),
}

_PERF = """select {by}, campaign_id, count(first_sent_at) as sent, count(replied_at) as replies, count(*) filter (where stage = 'INTERESTED') as interested,
  {r1} as reply_rate, {r2} as positive_reply_rate from leads join companies using (company_id) group by all"""
_OUT = "select {by}, campaign_id, count(sent_at) as sent, count(replied_at) as replies, {r} as reply_rate from outreach join leads using (lead_id) group by all"


def _perf(by: str, more: str = "") -> str:
    body = _PERF.format(by=by, r1=_rate("count(replied_at)", "count(first_sent_at)"), r2=_rate("count(*) filter (where stage = 'INTERESTED')", "count(first_sent_at)"))
    return with_sql(body.replace(" from leads", f"{more} from leads"))


def _out(by: str) -> str:
    body = _OUT.format(by=by, r=_rate("count(replied_at)", "count(sent_at)"))
    return with_sql(body).replace("count(sent_at)", "count(outreach.sent_at)")


def _replies(what: str) -> str:
    return with_sql(
        f"select {what}, campaign_id, niche, count(*) as n, max(sent_at) as last_seen from messages join leads using (lead_id) join companies using (company_id)"
        f" where direction = 'inbound' and {what} is not null group by all"
    )


_POSITION = "case stage " + " ".join(f"when '{s}' then {p}" for s, p, _ in S.STAGES) + " else -1 end"
_PLAN = (
    "plan as (select lead_id, i as step, ['followup_1', 'followup_2', 'followup_3_final'][i] as kind, first_sent_at + to_days([2, 5, 9][i]) as due_at"
    " from leads, (values (1), (2), (3)) s(i) where first_sent_at is not null)"
)
_STOP = (
    f"case when replied_at is not null then 'reply_received' when status in {_list(R.STOP_STATUSES)} then 'status_' || lower(status)"
    f" when stage in {_list(R.STOP_STAGES)} then 'stage_' || lower(stage) end"
)


def _planned(body: str) -> str:
    head = with_sql("select 1 from leads")
    return head.replace(" select 1 from leads", f", {_PLAN} {body}")


_LATEST = "(select * from (select *, row_number() over (partition by lead_id order by created_at desc, seq desc) as place from {rows}) t where place = 1)"
_VIEW_SQL = f"""select l.lead_id, l.public_ref, l.campaign_id, c.name as campaign_name, co.company_id, co.name as business_name, co.instagram_handle, co.instagram_url, co.website, co.website_domain, co.niche_id, n.name as niche_name,
  co.state, co.city, co.ig_followers, co.ig_posts, co.products_count, co.products_services, co.email as company_email, co.phone as company_phone, ct.full_name as decision_maker, ct.title as decision_maker_title,
  ct.role_category as decision_maker_role, ct.email as decision_maker_email, ct.linkedin_url as decision_maker_linkedin, ct.target_reason as decision_maker_reason, l.stage, l.status, l.icp_score, l.icp_band, l.priority, l.qualified,
  l.disqualified_reason, l.recommended_service, l.outreach_angle, q.reason as qualification_reason, case when q.lead_id is not null then coalesce(q.first_pain, 'last pain') end as first_pain, r.business_summary, r.why_relevant,
  o.message as latest_message, o.variation as latest_variation, o.status as message_status, o.sent_at as last_message_sent_at, l.replied_at, l.next_followup_at, l.followup_step, l.retry_count, l.last_error, l.cleaning_flags,
  co.ig_last_post_at, l.discovered_at, l.notes, l.sheets_synced_at, l.updated_at
  from full_leads l join (select distinct campaign_id, 'Campaign ' || campaign_id as name from full_leads where campaign_id not like '5%') c on c.campaign_id = l.campaign_id
  join full_companies co on co.company_id = l.company_id
  left join (select distinct niche_id, upper(niche_id[1]) || niche_id[2:] as name from full_companies where niche_id <> 'machinery') n on n.niche_id = co.niche_id
  left join contact_rows ct on ct.contact_id = l.contact_id left join {_LATEST.format(rows="verdicts where odd = 1")} q on q.lead_id = l.lead_id
  left join {_LATEST.format(rows="briefs where odd = 1")} r on r.lead_id = l.lead_id left join {_LATEST.format(rows="drafts")} o on o.lead_id = l.lead_id"""
_SHEET = """select public_ref as "Lead ID", business_name as "Business Name", instagram_handle as "Instagram", website as "Website", niche_name as "Niche", state as "State", city as "City", ig_followers as "Followers",
  products_count as "Products/Services", decision_maker as "Founder / Decision Maker", decision_maker_title as "Decision Maker Role", coalesce(decision_maker_email, company_email) as "Email", company_phone as "Phone", icp_score as "ICP Score",
  icp_band as "Qualification", first_pain as "Pain Point", recommended_service as "Recommended Service", outreach_angle as "Outreach Angle", latest_message as "Generated Message", message_status as "Message Status", status as "Response Status",
  next_followup_at as "Follow-up Date", notes as "Notes", campaign_id as "Campaign", lead_id as "_lead_uuid" from"""
_ERROR_ROWS = f"(select kind as workflow, classification as provider, objection as error_type, {_MOVED} as created_at from messages where event_id % 3 = 1 and event_id % 2 <> 0)"

_COUNTED = f"""select date '{DAY}' as day, campaign_id,
  (select count(*) from leads l where l.campaign_id = k.campaign_id and discovered_at::date = date '{DAY}') as leads_discovered,
  (select count(*) from leads l where l.campaign_id = k.campaign_id and enriched_at::date = date '{DAY}') as leads_enriched,
  (select count(*) from leads l where l.campaign_id = k.campaign_id and qualified_at::date = date '{DAY}') as leads_evaluated,
  (select count(*) from leads l where l.campaign_id = k.campaign_id and qualified_at::date = date '{DAY}' and qualified) as leads_qualified,
  (select count(*) from outreach o join leads l using (lead_id) where l.campaign_id = k.campaign_id and created_at::date = date '{DAY}') as messages_generated,
  (select count(*) from (select *, {_APPROVED} as approved_at from outreach) o join (select lead_id, campaign_id from leads) l using (lead_id)
     where l.campaign_id = k.campaign_id and approved_at::date = date '{DAY}') as messages_approved,
  (select count(*) from outreach o join leads l using (lead_id) where l.campaign_id = k.campaign_id and sent_at::date = date '{DAY}') as messages_sent,
  (select count(*) from messages m join leads l using (lead_id) where l.campaign_id = k.campaign_id and direction = 'inbound' and ({_MOVED})::date = date '{DAY}') as replies,
  (select count(*) from messages m join leads l using (lead_id) where l.campaign_id = k.campaign_id and direction = 'inbound' and ({_MOVED})::date = date '{DAY}'
     and classification in ('interested', 'curious', 'positive', 'wants_details', 'pricing', 'question')) as positive_replies,
  (select count(*) from (select *, {_STATE} as state from plan) p join leads l using (lead_id) where l.campaign_id = k.campaign_id and state = 'SCHEDULED' and due_at::date <= date '{DAY}') as followups_due,
  (select count(*) from leads l where l.campaign_id = k.campaign_id and stage = 'INTERESTED') as interested_total,
  (select count(*) from leads l where l.campaign_id = k.campaign_id and stage = 'NURTURE') as nurture_total,
  (select count(*) from leads l where l.campaign_id = k.campaign_id and stage = 'NOT_INTERESTED') as not_interested_total,
  (select count(*) from messages m join leads l using (lead_id) where l.campaign_id = k.campaign_id and event_id % 3 = 1 and event_id % 2 <> 0 and ({_MOVED})::date = date '{DAY}') as errors_open
  from (select campaign_id from quiet where status = 'active' union select campaign_id from leads) k"""
_BASE = "with " + ", ".join(with_sql(f"select 1 from {name}").removeprefix("with ").removesuffix(f" select 1 from {name}") for name in ("leads", "outreach", "messages", "quiet", "companies")) + f", {_PLAN}"
_REPORT = f"{_BASE} {_COUNTED}"
_PARTS = {
    "by_niche": (_PERF.format(by="niche", r1=_rate("count(replied_at)", "count(first_sent_at)"), r2=_rate("count(*) filter (where stage = 'INTERESTED')", "count(first_sent_at)")), "niche, campaign_id, sent, replies, interested, reply_rate, positive_reply_rate"),
    "by_state": (_PERF.format(by="state", r1=_rate("count(replied_at)", "count(first_sent_at)"), r2=_rate("count(*) filter (where stage = 'INTERESTED')", "count(first_sent_at)")), "state, campaign_id, sent, replies, interested, reply_rate, positive_reply_rate"),
    "by_angle": (_OUT.format(by="angle, kind", r=_rate("count(replied_at)", "count(sent_at)")), "angle, kind, campaign_id, sent, replies, reply_rate"),
} | {
    name: (
        f"select {what}, campaign_id, niche, count(*) as n, strftime(max(sent_at), '%Y-%m-%d %H:%M:%S') as last_seen from messages join leads using (lead_id) join companies using (company_id)"
        f" where direction = 'inbound' and {what} is not null group by all",
        f"{what}, campaign_id, niche, n, last_seen",
    )
    for name, what in (("reply_categories", "classification"), ("objections", "objection"))
}


def _part(name: str) -> str:
    rows, columns = _PARTS[name]
    names = columns.split(", ")
    item = "{" + ", ".join(f"'{k}': {k}" for k in names) + "}"
    order = ", ".join(f"{k} nulls first" for k in names)
    return f"coalesce((select to_json(list({item} order by {order}))::varchar from ({rows}) x where r.campaign_id is null or x.campaign_id = r.campaign_id), '[]') as {name}"


_OBJECTS = f"""{_BASE}, report as ({_COUNTED}), r as (select * from report union all select day, null, {", ".join(f"sum({k})" for k in Q.COUNTERS)} from report group by day)
  select r.*, {", ".join(_part(k) for k in _PARTS)} from r"""

ORACLES = {
    "q01_leads_full": with_sql(_VIEW_SQL),
    "q11_export": with_sql(f"{_SHEET} ({_VIEW_SQL}) v where qualified"),
    "q06_many_keys": with_sql("select name, count(*) as keys from (select company_id, unnest([website_domain, phone, name]) as key_value from companies) k join companies using (company_id) where key_value is not null group by name having count(*) > 2"),
    "q06_waiting_after_reply": _planned(f"select lead_id, replied_at, step, due_at from (select *, {_STATE} as state from plan) p join leads using (lead_id) where state = 'SCHEDULED' and replied_at is not null"),
    "q06_recent_errors": with_sql(f"select workflow, provider, error_type, count(*) as n, max(created_at) as last_at from {_ERROR_ROWS} e where created_at > timestamp '{DAY} 00:00:00' - interval 2160 hour group by all"),
    "q06_open_errors": with_sql(f"select provider, error_type, count(*) as n, max(created_at) as last_at from {_ERROR_ROWS} e group by all"),
    "q06_failing_stages": with_sql("select stage, count(*) as n, max(retry_count) as worst from leads where status = 'ERROR' group by stage"),
    "q06_stage_status": with_sql("select stage, status, count(*) as n from leads group by all"),
    "q06_approval_backlog": with_sql("select campaign_id, count(*) as waiting from outreach o join leads l using (lead_id) where o.status = 'PENDING_REVIEW' group by 1"),
    "q06_recent_runs": with_sql(f"select workflow, status, items_ok, items_failed, started_at from run_rows where started_at > timestamp '{DAY} 12:00:00' - interval 720 hour"),
    "q06_steps_before_reply": with_sql("select followup_step, count(*) as n from full_leads where replied_at is not null group by 1"),
    "q12_run_summary": with_sql(
        "select count(*) as n, count(*) filter (where icp_score >= 80) as best, count(*) filter (where icp_score >= 65 and icp_score < 80) as good, count(*) filter (where icp_score >= 50 and icp_score < 65) as review,"
        " count(*) filter (where icp_score < 50) as bad, count(*) filter (where icp_score is null) as unscored, bool_and(approved_at is null) as all_pending from leads"
    ),
    "t01_next_batch": with_sql(
        "select lead_id, icp_score, website_domain from leads join companies using (company_id) order by (website_domain is null), icp_score desc nulls last, lead_id limit 40 offset 10"
    ),
    "q03_lead_progress": with_sql(
        f"select lead_id, stage, {_POSITION} as position, cleaned_at is not null as cleaned, enriched_at is not null as enriched, qualified_at is not null as evaluated, researched_at is not null as researched,"
        " message_generated_at is not null as generated, approved_at is not null as approved, first_sent_at is not null as sent, replied_at is not null as replied from leads"
    ),
    "q04_campaign_funnel": with_sql(
        "select campaign_id, count(*) as leads_discovered, count(cleaned_at) as leads_cleaned, count(enriched_at) as leads_enriched, count(qualified_at) as leads_evaluated,"
        " count(*) filter (where qualified) as leads_qualified, count(*) filter (where stage = 'DISQUALIFIED') as leads_disqualified, count(message_generated_at) as messages_generated,"
        " count(approved_at) as messages_approved, count(first_sent_at) as messages_sent, count(replied_at) as replies, count(*) filter (where stage = 'INTERESTED') as interested,"
        " count(*) filter (where stage = 'NURTURE') as nurture, count(*) filter (where stage = 'NOT_INTERESTED') as not_interested,"
        f" {_rate('count(*) filter (where qualified)', 'count(qualified_at)')} as qualification_rate, {_rate('count(replied_at)', 'count(first_sent_at)')} as reply_rate from leads group by campaign_id"
    ),
    "q05_performance_by_niche": _perf("niche"),
    "q05_performance_by_state": _perf("state"),
    "q05_performance_by_angle": _out("angle, kind"),
    "q05_performance_by_variation": _out("variation"),
    "q06_sent_twice": with_sql("select lead_id, kind, count(*) as sent from outreach where sent_at is not null group by all having count(*) > 1"),
    "q06_stuck_leads": with_sql(
        f"select stage, status, count(*) as n, min(updated_at) as oldest from leads where status in ('PROCESSING', 'ERROR') and updated_at < timestamp '{NOW}' - interval 24 hour group by all"
    ),
    "q06_companies_in_campaigns": with_sql("select company_id, count(distinct campaign_id) as campaigns from leads group by 1 having count(distinct campaign_id) > 1"),
    "q07_reply_categories": _replies("classification"),
    "q07_objections": _replies("objection"),
    "q08_daily_activity": with_sql("select cast(discovered_at as date) as day, campaign_id, count(*) as leads_discovered from leads group by all"),
    "q09_daily_report": _REPORT,
    "q09_daily_objects": _OBJECTS,
    "q10_small_samples": _perf("niche", ", count(first_sent_at) < 20 as small_sample"),
    "q13_usage_cost": with_sql(
        "select kind, cast(sent_at as date) as day, count(*) as calls, round(avg(value), 6) as latency, round(sum(value * (length(kind) / 100)), 4) as cost from messages group by all"
    ),
    "t02_work_batch": with_sql(
        f"""select campaign_id, lead_id, rank from (select *, row_number() over (partition by campaign_id order by icp_score desc nulls last, discovered_at, lead_id) as rank from leads
  where stage = 'REPLIED' and (status in ('NEW', 'ERROR') or status = 'PROCESSING' and updated_at < timestamp '{NOW}' - interval 20 minute) and retry_count <= 3) t where rank <= 25"""
    ),
    "t03_latest_outreach": with_sql(
        "select lead_id, created_at, line, part from (select *, row_number() over (partition by lead_id order by created_at desc, line desc, part desc, cost desc) as r from outreach) t where r = 1"
    ),
    "t04_daily_release": with_sql(
        f"""select campaign_id, is_initial, count(*) filter (where r <= greatest(0, 30 - coalesce(sent, 0))) as released, count(*) filter (where r > greatest(0, 30 - coalesce(sent, 0))) as held
  from (select campaign_id, kind = 'initial' as is_initial, row_number() over (partition by campaign_id, kind = 'initial' order by created_at, lead_id, line, part) as r
        from outreach join leads using (lead_id) where outreach.status = 'APPROVED') a
  left join (select campaign_id, kind = 'initial' as is_initial, count(*) as sent from outreach join leads using (lead_id) where cast(sent_at as date) = date '{DAY}' group by all) s using (campaign_id, is_initial)
  group by all"""
    ),
    "q02_send_queue": with_sql(
        "select o.lead_id, line, part, kind, campaign_id, icp_score, name, website_domain, created_at from outreach o join leads l on l.lead_id = o.lead_id join companies co on co.company_id = l.company_id"
        " where o.status = 'APPROVED' and o.sent_at is null"
    ),
    "q02_followups_due": _planned(
        f"select lead_id, step, kind, due_at, stage, icp_score from plan join leads using (lead_id) where due_at <= timestamp '{NOW}' and replied_at is null and status not in {_list(R.STOP_STATUSES)}"
    ),
    "l01_advance": with_sql(
        f"""select lead_id, case when p >= {_POSITION} then to_stage else stage end as stage, coalesce(to_status, status) as status, coalesce(t_at, updated_at) as updated_at from leads left join
  (select lead_id, max(p) as p, arg_max(to_stage, p) as to_stage, 'REPLIED' as to_status, max(sent_at) as t_at from (select *, case classification when 'interested' then 'INTERESTED' when 'unclear' then 'CLEANED' else 'REPLIED' end as to_stage,
     case classification when 'interested' then 120 when 'unclear' then 20 else 100 end as p from messages where direction = 'inbound') t group by 1) r using (lead_id)"""
    ),
    "l03_schedule": _planned("select lead_id, step, kind, due_at from plan"),
    "l04_next_slot": with_sql(
        """select event_id, case when dayofweek(sent_at) between 1 and 5 and hour(sent_at) < 9 then date_trunc('day', sent_at) + interval 9 hour
  when dayofweek(sent_at) between 1 and 5 and hour(sent_at) < 18 then sent_at
  else date_trunc('day', sent_at) + to_days(case dayofweek(sent_at) when 5 then 3 when 6 then 2 else 1 end) + interval 9 hour end as slot from messages"""
    ),
    "l05_cancel": _planned(
        f"""select lead_id, step, case when why is not null and state in ('PENDING', 'SCHEDULED') then 'CANCELLED' else state end as state,
  case when why is not null and state in ('PENDING', 'SCHEDULED') then why when state = 'CANCELLED' then 'by_hand' end as cancel_reason
  from (select lead_id, step, {_STATE} as state, {_STOP} as why from plan join leads using (lead_id)) t"""
    ),
    "l05_reject_drafts": with_sql(
        f"""select o.lead_id, line, part, kind, case when {_STOP.replace('status', 'l.status')} is not null and o.status in ('PENDING_REVIEW', 'APPROVED') and o.sent_at is null and kind <> 'initial' then 'REJECTED' else o.status end as status
  from outreach o join leads l on l.lead_id = o.lead_id"""
    ),
    "l02_failures": with_sql(
        """select lead_id, retry_count + coalesce(n, 0) as retry_count, case when n is null then status else 'ERROR' end as status,
  case when n is null then case when lead_id % 3 = 0 then 'earlier' end else message end as last_error, coalesce(failed_at, updated_at) as updated_at
  from leads left join (select lead_id, count(*) as n, last(kind order by sent_at, kind) as message, max(sent_at) as failed_at from messages where event_id % 3 = 1 group by 1) f using (lead_id)"""
    ),
    "l11_nurture": _planned(
        f"""select lead_id, case when due is not null and replied_at is null then 'NURTURE' else stage end as stage, case when due is not null and replied_at is null then 'NO_RESPONSE' else status end as status,
  case when due is not null and replied_at is null then cast(due as date) + 90 when lead_id % 2 = 0 then date '2020-01-01' end as recheck_at
  from leads left join (select lead_id, max(due_at) as due from (select *, {_STATE} as state from plan) p where kind = 'followup_3_final' and state = 'SENT' group by 1) f using (lead_id)"""
    ),
    "st3_counters": with_sql(
        """select lead_id, count(*) as message_count, min(sent_at) filter (where direction = 'inbound') as replied_at, max(sent_at) as last_message_at,
  last(event_id order by sent_at, event_id) as last_event_id, last(direction order by sent_at, event_id) as last_direction from messages group by 1"""
    ),
}
