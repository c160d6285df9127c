"""The event fold over tables derived from the given ones. The SQL takes one event of each lead at
a time in a recursion, as the actions are specified, not by minima as the Spark code does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.components import stored
from leadspark.operators import events as E
from leadspark.plans.inputs import table, with_sql

c = F.col

_DRAFTS = "select lead_id, line, min(created_at) as created_at from outreach group by lead_id, line"
_KIND = "case least(line, 4) when 1 then 'initial' when 2 then 'followup_1' when 3 then 'followup_2' else 'followup_3_final' end"
_STEP = "cast(least(line, 4) - 1 as int)"
_DRAFT_STATUS = "case (lead_id + line) % 5 when 0 then 'DRAFT' when 3 then 'APPROVED' when 4 then 'SENT' else 'PENDING_REVIEW' end"
_STEP_STATUS = "case (lead_id + line) % 6 when 0 then 'PENDING_REVIEW' when 1 then 'APPROVED' when 2 then 'GENERATING' when 3 then 'SENT' when 4 then 'CANCELLED' else 'SCHEDULED' end"
_EVENT = "(lead_id * 7 + line * 3 + j * 5) % 8"

#: The tables before the events: name -> (expression by column, source).
BEFORE = {
    "e_leads": (
        {
            "lead_id": "lead_id", "campaign_id": "campaign_id", "company_id": "company_id",
            "stage": "case lead_id % 5 when 0 then 'MESSAGE_GENERATED' when 1 then 'PENDING_APPROVAL' when 2 then 'READY_FOR_OUTREACH' else stage end",
            "status": "status", "notes": "case when lead_id % 2 = 0 then 'old' end",
            "first_sent_at": "cast(case when lead_id % 4 = 0 then discovered_at end as timestamp)", "last_sent_at": "cast(case when lead_id % 4 = 0 then discovered_at end as timestamp)",
            "followup_step": "cast(lead_id % 2 as int)", "next_followup_at": "cast(case when lead_id % 7 = 0 then discovered_at end as timestamp)",
            "approved_at": "cast(approved_at as timestamp)", "message_generated_at": "cast(message_generated_at as timestamp)",
        }, "leads",
    ),
    "e_outreach": (
        {
            "outreach_id": "cast(lead_id * 10 + line as bigint)", "lead_id": "lead_id", "channel": "'instagram'", "kind": _KIND, "followup_step": _STEP, "status": _DRAFT_STATUS,
            "message": "concat('m', cast(line as string))", "message_edited": "case when line % 3 = 0 then 'mine' end", "final_message": "cast(null as string)", "variation": "'a'",
            "approved_by": "cast(null as string)", "approved_at": "cast(null as timestamp)", "rejected_reason": "cast(null as string)",
            "sent_at": f"cast(case when {_DRAFT_STATUS} = 'SENT' then created_at end as timestamp)", "sent_by": "cast(null as string)", "send_mode": "cast(null as string)",
        }, f"({_DRAFTS}) d",
    ),
    "e_followups": (
        {
            "lead_id": "lead_id", "step": _STEP, "kind": _KIND, "status": _STEP_STATUS, "due_at": "cast(created_at + interval '9' day as timestamp)", "sent_at": "cast(null as timestamp)",
            "outreach_id": "cast(null as bigint)", "cancelled_reason": "cast(null as string)",
        }, f"(select * from ({_DRAFTS}) d where line between 2 and 4 and lead_id % 3 = 0) d",
    ),
    "e_talks": (
        {
            "lead_id": "lead_id", "channel": "'instagram'", "state": "case when lead_id % 8 = 0 then 'AWAITING_US' else 'AWAITING_PROSPECT' end",
            "last_message_at": "cast(discovered_at as timestamp)", "last_direction": "'inbound'", "message_count": "cast(1 as bigint)",
        }, "(select * from leads where lead_id % 4 = 0) d",
    ),
    "e_firms": (
        {"company_id": "company_id", "instagram_handle": "case when company_id % 3 = 0 then concat('h', cast(company_id % 500 as string)) end", "suppressed": "false", "suppressed_reason": "cast(null as string)"}, "companies",
    ),
    "e_events": (
        {
            "event_id": "cast((lead_id * 10 + line) * 10 + j as bigint)", "happened": "cast(created_at + j * interval '1' day as timestamp)",
            "kind": f"case {_EVENT} when 0 then 'approve' when 1 then 'approve' when 4 then 'reject' when 5 then 'reject' when 6 then 'outcome' when 7 then case when lead_id % 3 = 0 then 'opt_out' else 'send' end else 'send' end",
            "draft": "cast(lead_id * 10 + line as bigint)", "lead_id": "lead_id", "who": "concat('p', cast(j as string))", "edited": "case when (lead_id + line) % 5 = 0 then 'better' end",
            "reason": "case when line % 4 > 0 then concat('r', cast(line as string)) end", "regenerate": f"{_EVENT} <> 5",
            "outcome": "case (lead_id + line + j) % 6 when 0 then 'CONVERSATION' when 1 then 'INTERESTED' when 2 then 'NURTURE' when 3 then 'NOT_INTERESTED' when 4 then 'CLOSED' else 'REPLIED' end",
            "note": "case when line % 2 = 0 then concat('n', cast(j as string)) end", "send_mode": "'manual'",
        }, f"(select d.*, j from ({_DRAFTS}) d cross join (select 1 as j union all select 2) js) d",
    ),
}


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "outreach").groupBy("lead_id", "line").agg(F.min("created_at").alias("created_at"))


def _frame(spark: SparkSession, sf_dir: str, name: str, drafts: DataFrame) -> DataFrame:
    t = lambda x: table(spark, sf_dir, x)
    source = {
        "e_leads": lambda: t("leads"), "e_outreach": lambda: drafts, "e_followups": lambda: drafts.where("line between 2 and 4 and lead_id % 3 = 0"),
        "e_talks": lambda: t("leads").where("lead_id % 4 = 0"), "e_firms": lambda: t("companies"), "e_events": lambda: drafts.withColumn("j", F.explode(F.array(F.lit(1), F.lit(2)))),
    }[name]()
    return source.selectExpr(*(f"{e} as {n}" for n, e in BEFORE[name][0].items()))


def state_and_events(spark: SparkSession, sf_dir: str) -> tuple[E.State, DataFrame]:
    drafts = stored(_drafts(spark, sf_dir))
    f = lambda n: _frame(spark, sf_dir, n, drafts)
    empty = lambda schema: spark.createDataFrame([], schema)
    state = {
        "leads": f("e_leads"), "outreach": f("e_outreach"), "followups": f("e_followups"), "conversations": f("e_talks"), "companies": f("e_firms"),
        "messages": empty("lead_id long, channel string, outreach_id long, direction string, body string, sent_at timestamp"),
        "suppressions": empty("key_type string, key_value string, reason string"), "applied": empty("event_id long"),
    }
    on_draft = c("kind").isin("approve", "reject", "send")
    events = f("e_events").withColumns({"outreach_id": F.when(on_draft, c("draft")), "lead_id": F.when(~on_draft, c("lead_id"))}).drop("draft").withColumnsRenamed({"happened": "at", "who": "by"})
    return state, events


#: What each query shows of the tables after the events.
SHOWN = {
    "l06_decisions": ("outreach", ["outreach_id", "status", "message_edited", "final_message", "variation", "approved_by", "approved_at", "rejected_reason", "sent_at", "sent_by", "send_mode"]),
    "l07_sent": ("conversations", ["lead_id", "channel", "state", "last_message_at", "last_direction", "message_count"]),
    "l07_messages": ("messages", ["lead_id", "outreach_id", "body", "sent_at"]),
    "l07_sequence": ("followups", ["lead_id", "step", "kind", "status", "due_at", "sent_at", "outreach_id", "cancelled_reason"]),
    "l08_outcomes": ("leads", ["lead_id", "stage", "status", "notes", "first_sent_at", "last_sent_at", "followup_step", "next_followup_at", "approved_at", "message_generated_at"]),
    "l09_opt_out": ("suppressions", ["key_type", "key_value", "reason"]),
    "l09_companies": ("companies", ["company_id", "suppressed", "suppressed_reason"]),
}


def _after(name: str):
    what, columns = SHOWN[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.apply_events(*state_and_events(spark, sf_dir), [what])[0][what].select(*columns)

    return run


QUERIES = {name: _after(name) for name in SHOWN}

_CASES = """
fold as (
 select l.*, 0 as k, coalesce(o.outs, []) as outs, coalesce(f.fups, []) as fups, t.state as t_state, t.last_message_at as t_at, t.last_direction as t_dir, t.message_count as t_n,
   cast(null as varchar) as out_why, cast(null as timestamp) as out_at, cast(null as bigint) as out_id, cast([] as struct(id bigint, body varchar, sent timestamp)[]) as said
 from e_leads l left join e_talks t using (lead_id)
 left join (select lead_id, list({'id': outreach_id, 'kind': kind, 'step': followup_step, 'message': message, 'status': status, 'edited': message_edited, 'final': final_message, 'variation': variation,
   'who': approved_by, 'ok_at': approved_at, 'why': rejected_reason, 'sent_at': sent_at, 'sent_by': sent_by, 'mode': send_mode}) as outs from e_outreach group by 1) o using (lead_id)
 left join (select lead_id, list({'step': step, 'kind': kind, 'status': status, 'due': due_at, 'sent_at': sent_at, 'oid': outreach_id, 'why': cancelled_reason}) as fups from e_followups group by 1) f using (lead_id)
 union all
 select lead_id, campaign_id, company_id,
   case when did = 'approve' and stage in ('MESSAGE_GENERATED', 'PENDING_APPROVAL') then 'READY_FOR_OUTREACH' when did = 'reject' and e_again and d.kind = 'initial' then 'RESEARCHED'
     when did = 'send' and stage in ('READY_FOR_OUTREACH', 'PENDING_APPROVAL', 'MESSAGE_GENERATED') then 'DM_SENT' when did = 'outcome' then e_outcome when did = 'opt_out' then 'NOT_INTERESTED' else stage end,
   case when did = 'approve' then 'APPROVED' when did = 'reject' then case when e_again then 'NEW' else 'REJECTED' end when did = 'send' then 'SENT'
     when did = 'outcome' and e_outcome <> 'CONVERSATION' then e_outcome when did = 'opt_out' then 'OPTED_OUT' else status end,
   case when did = 'outcome' and e_note is not null then coalesce(notes || chr(10), '') || e_note else notes end,
   case when did = 'send' then coalesce(first_sent_at, e_at) else first_sent_at end, case when did = 'send' then e_at else last_sent_at end,
   case when did = 'send' then greatest(followup_step, d.step) else followup_step end,
   case when stops then null when did = 'send' then list_min(list_transform(list_filter(fups2, lambda x: x.status = 'SCHEDULED'), lambda x: x.due)) else next_followup_at end,
   case when did = 'approve' then coalesce(approved_at, e_at) else approved_at end, case when did = 'reject' and e_again then null else message_generated_at end,
   k, outs2, fups2,
   case when did = 'send' then case when t_n is null or t_state = 'AWAITING_US' then 'AWAITING_PROSPECT' else t_state end when did = 'outcome' and e_outcome <> 'CONVERSATION' and t_n is not null then e_outcome else t_state end,
   case when did = 'send' then e_at else t_at end, case when did = 'send' then 'outbound' else t_dir end, case when did = 'send' then coalesce(t_n, 0) + 1 else t_n end,
   case when did = 'opt_out' then e_reason else out_why end, case when did = 'opt_out' then e_at else out_at end, case when did = 'opt_out' then e_id else out_id end,
   case when did = 'send' then list_append(said, {'id': e_draft, 'body': coalesce(d.edited, d.message), 'sent': e_at}) else said end
 from (
  select *,
   list_transform(outs, lambda o: {'id': o.id, 'kind': o.kind, 'step': o.step, 'message': o.message,
     'status': case when o.id = e_draft and did = 'approve' then 'APPROVED' when o.id = e_draft and did = 'reject' then 'REJECTED' when o.id = e_draft and did = 'send' then 'SENT'
        when stops and o.kind <> 'initial' and o.status in ('DRAFT', 'PENDING_REVIEW', 'APPROVED') and o.sent_at is null then 'REJECTED' else o.status end,
     'edited': case when o.id = e_draft and did = 'approve' then coalesce(e_edited, o.edited) else o.edited end,
     'final': case when o.id = e_draft and did = 'approve' then coalesce(e_edited, o.edited, o.message) when o.id = e_draft and did = 'send' then coalesce(o.edited, o.message) else o.final end,
     'variation': case when o.id = e_draft and did = 'approve' and e_edited is not null then 'custom' else o.variation end,
     'who': case when o.id = e_draft and did = 'approve' then e_by else o.who end, 'ok_at': case when o.id = e_draft and did = 'approve' then e_at else o.ok_at end,
     'why': case when o.id = e_draft and did = 'reject' then e_reason when stops and o.kind <> 'initial' and o.status in ('DRAFT', 'PENDING_REVIEW', 'APPROVED') and o.sent_at is null then stop_why else o.why end,
     'sent_at': case when o.id = e_draft and did = 'send' then e_at else o.sent_at end, 'sent_by': case when o.id = e_draft and did = 'send' then e_by else o.sent_by end,
     'mode': case when o.id = e_draft and did = 'send' then e_mode else o.mode end}) as outs2,
   case when did = 'send' and d.kind = 'initial' and first_sent_at is null then
     list_concat(fups, list_filter([{'step': 1, 'kind': 'followup_1', 'status': 'SCHEDULED', 'due': e_at + interval 2 day, 'sent_at': cast(null as timestamp), 'oid': cast(null as bigint), 'why': cast(null as varchar)},
       {'step': 2, 'kind': 'followup_2', 'status': 'SCHEDULED', 'due': e_at + interval 5 day, 'sent_at': cast(null as timestamp), 'oid': cast(null as bigint), 'why': cast(null as varchar)},
       {'step': 3, 'kind': 'followup_3_final', 'status': 'SCHEDULED', 'due': e_at + interval 9 day, 'sent_at': cast(null as timestamp), 'oid': cast(null as bigint), 'why': cast(null as varchar)}],
       lambda x: not list_contains(list_transform(fups, lambda y: y.step), x.step)))
   else list_transform(fups, lambda x: {'step': x.step, 'kind': x.kind,
     'status': case when did = 'send' and x.step = d.step and x.status <> 'SENT' then 'SENT' when did = 'approve' and x.step = d.step and x.status = 'PENDING_REVIEW' then 'APPROVED'
        when did = 'reject' and not e_again and x.status in ('SCHEDULED', 'PENDING_REVIEW') then 'CANCELLED' when stops and x.status in ('SCHEDULED', 'GENERATING', 'PENDING_REVIEW', 'APPROVED') then 'CANCELLED' else x.status end,
     'due': x.due, 'sent_at': case when did = 'send' and x.step = d.step and x.status <> 'SENT' then e_at else x.sent_at end,
     'oid': case when did = 'send' and x.step = d.step and x.status <> 'SENT' then e_draft else x.oid end,
     'why': case when did = 'reject' and not e_again and x.status in ('SCHEDULED', 'PENDING_REVIEW') then 'message_rejected' when stops and x.status in ('SCHEDULED', 'GENERATING', 'PENDING_REVIEW', 'APPROVED') then stop_why else x.why end}) end as fups2
  from (
   select *, coalesce(did = 'opt_out' or (did = 'outcome' and e_outcome in ('NOT_INTERESTED', 'CLOSED')), false) as stops, case when did = 'opt_out' then 'opted_out' else lower(e_outcome) end as stop_why
   from (
    select f.* exclude (k), e.k, e.event_id as e_id, e.happened as e_at, e.who as e_by, e.draft as e_draft, e.edited as e_edited, e.reason as e_reason, e.regenerate as e_again, e.outcome as e_outcome, e.note as e_note, e.send_mode as e_mode,
     list_filter(f.outs, lambda o: o.id = e.draft)[1] as d,
     case e.kind when 'approve' then case when list_filter(f.outs, lambda o: o.id = e.draft)[1].status in ('DRAFT', 'PENDING_REVIEW') then 'approve' end
       when 'send' then case when list_filter(f.outs, lambda o: o.id = e.draft)[1].sent_at is null then 'send' end
       when 'outcome' then case when e.outcome <> 'REPLIED' then 'outcome' end else e.kind end as did
    from fold f join ordered e on e.lead_id = f.lead_id and e.k = f.k + 1
   ) a
  ) b
 ) g
),
ended as (select * from fold qualify row_number() over (partition by lead_id order by k desc) = 1),
gone as (select company_id, out_why as reason, out_at, out_id from ended where out_id is not null),
asked as (select company_id, e.reason, e.happened, e.event_id from e_events e join e_leads using (lead_id) where kind = 'opt_out'),
first_asked as (select key_type, key_value, arg_min({'reason': reason}, (happened, event_id)).reason as reason from
  (select 'company_id' as key_type, cast(company_id as varchar) as key_value, reason, happened, event_id from asked union all select 'instagram_handle', instagram_handle, reason, happened, event_id from asked join e_firms using (company_id) where instagram_handle is not null) a group by all)
"""

_SELECTS = {
    "l06_decisions": "select o.id as outreach_id, o.status as status, o.edited as message_edited, o.final as final_message, o.variation as variation, o.who as approved_by, o.ok_at as approved_at, o.why as rejected_reason, o.sent_at as sent_at, o.sent_by as sent_by, o.mode as send_mode from (select unnest(outs) as o from ended) x",
    "l07_sent": "select lead_id, 'instagram' as channel, t_state as state, t_at as last_message_at, t_dir as last_direction, t_n as message_count from ended where t_n is not null",
    "l07_messages": "select lead_id, m.id as outreach_id, m.body as body, m.sent as sent_at from (select lead_id, unnest(said) as m from ended) x",
    "l07_sequence": "select lead_id, x.step as step, x.kind as kind, x.status as status, x.due as due_at, x.sent_at as sent_at, x.oid as outreach_id, x.why as cancelled_reason from (select lead_id, unnest(fups) as x from ended) y",
    "l08_outcomes": "select lead_id, stage, status, notes, first_sent_at, last_sent_at, followup_step, next_followup_at, approved_at, message_generated_at from ended",
    "l09_opt_out": "select key_type, key_value, reason from first_asked",
    "l09_companies": "select company_id, g.company_id is not null as suppressed, g.reason as suppressed_reason from e_firms left join (select company_id, arg_max({'reason': reason}, (out_at, out_id)).reason as reason from gone group by 1) g using (company_id)",
}


def _sql(name: str) -> str:
    import re

    body = ", ".join(f"{n} as (select {', '.join(f'{e} as {x}' for x, e in columns.items())} from {source})" for n, (columns, source) in BEFORE.items())
    body = re.sub(r"as string\)", "as varchar)", body)
    ordered = "ordered as (select *, row_number() over (partition by lead_id order by happened, event_id) as k from e_events)"
    sql = with_sql(f"select 1 from leads, outreach, companies where /*{name}*/ true")
    head = sql[: sql.index(" select 1 from leads, outreach, companies")]
    return f"{head.replace('with ', 'with recursive ', 1)}, {body}, {ordered}, {_CASES.strip()} {_SELECTS[name]}"


ORACLES = {name: _sql(name) for name in SHOWN}
