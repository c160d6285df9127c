"""Decisions, sends, outcomes and opt-outs as one fold of events over all tables.

An event changes several tables at once, and what it does depends on the events before it:
an approval counts only while a draft waits for review, a message goes out once, an
outcome cancels what has not gone out. Each table's state machine needs only the first or
last event of a kind for each of its rows, so the fold is grouped minima and maxima joined
to the rows; no lead's events are gathered. The events that count are settled once and
applied to every table from there, so all tables see the same ones. Events are told apart by
event_id: those in `applied` do nothing, and so a run can be repeated.

events: event_id, at, kind (approve, reject, send, outcome, opt_out), outreach_id (for the first
three) or lead_id, by, edited, reason, regenerate (null: yes), outcome, note, send_mode. They count
in order of (at, event_id).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.components import settle as settle
from leadspark.components import stored
from leadspark.config import rules as R

c = F.col
State = dict[str, DataFrame]

# Outcomes, and the states that the actions look for.
OUTCOMES = ["CONVERSATION", "INTERESTED", "NURTURE", "NOT_INTERESTED", "CLOSED"]
ENDING = ["NOT_INTERESTED", "CLOSED"]
IN_REVIEW = ["DRAFT", "PENDING_REVIEW"]
UNSENT_DRAFT = ["DRAFT", "PENDING_REVIEW", "APPROVED"]
BEFORE_APPROVAL = ["MESSAGE_GENERATED", "PENDING_APPROVAL"]
BEFORE_SENDING = ["READY_FOR_OUTREACH", "PENDING_APPROVAL", "MESSAGE_GENERATED"]
UNSENT_STEP = ["SCHEDULED", "GENERATING", "PENDING_REVIEW", "APPROVED"]


def _order() -> Column:
    return F.struct("at", "event_id")


def _before(a: Column, b: Column) -> Column:
    """a happened, and b did not happen before it."""
    return a.isNotNull() & (b.isNull() | (a < b))


def _at(order: str) -> Column:
    return c(f"{order}.at")


def _is(kind: str) -> Column:
    return c("kind") == kind


def _cancels() -> Column:
    return _is("opt_out") | (_is("outcome") & c("outcome").isin(ENDING))


def _why_cancelled() -> Column:
    return F.when(_is("opt_out"), "opted_out").otherwise(F.lower("outcome"))


def _fresh(events: DataFrame, applied: DataFrame) -> DataFrame:
    """Events not applied yet, each id once. Ids that repeat or are applied are found first, on ids
    alone: where they are few, whole events are not dealt by their ids."""
    done = applied.select("event_id").distinct().withColumn("_done", F.lit(True))
    ids = events.groupBy("event_id").agg(F.count("*").alias("_n")).join(done, "event_id", "left")
    odd = stored(ids.where("_n > 1 or _done").select(c("event_id").alias("_id"), "_n", "_done"))
    if not odd.limit(1).count():
        return events
    marked = events.join(odd, c("event_id").eqNullSafe(c("_id")), "left")
    again = marked.where("_n > 1 and _done is null").dropDuplicates(["event_id"])
    return marked.where("_n is null").unionByName(again).select(events.columns)


def weigh(state: State, events: DataFrame) -> DataFrame:
    """Every new event with its lead and draft, and `why` it does not count (null where it counts).

    Events of a draft are dealt by it alone, others by their lead alone: what an event of a
    draft must know of the lead comes with the draft."""
    new = _fresh(events, state["applied"])
    on_draft = c("kind").isin("approve", "reject", "send")
    of_draft = F.coalesce(on_draft & c("outreach_id").isNotNull(), F.lit(False))
    firms = state["companies"].select("company_id", F.lit(True).alias("_firm"))
    known = state["leads"].select("lead_id", "company_id", F.lit(True).alias("_known")).join(firms, "company_id", "left")
    others = new.where(~of_draft).withColumn("lead_id", F.when(on_draft, None).otherwise(c("lead_id")))
    others = stored(others.join(known, "lead_id", "left"))
    reaches = c("_known") & (~_is("opt_out") | c("_firm").isNotNull())
    stops = others.where(_cancels() & reaches).groupBy("lead_id").agg(F.min(_order()).alias("stop"))
    drafts = state["outreach"].select(
        "outreach_id", "lead_id", "channel", c("kind").alias("draft_kind"), c("followup_step").alias("step"), c("status").alias("_was"), c("sent_at").alias("_sent"),
    ).join(known, "lead_id", "left").join(stops, "lead_id", "left")
    own = new.where(of_draft).drop("lead_id").join(drafts, "outreach_id", "left")
    draft = Window.partitionBy("outreach_id")
    own = own.withColumns(
        {"any": F.min(F.when(~_is("send") | c("_sent").isNull(), _order())).over(draft), "send": F.min(F.when(_is("send"), _order())).over(draft)}
    )
    rows = own.unionByName(others, allowMissingColumns=True)
    stopped = (c("draft_kind") != "initial") & c("stop").isNotNull() & (c("stop") < _order())
    why = (
        F.when(on_draft & c("_was").isNull(), "unknown outreach")
        .when(~on_draft & c("_known").isNull(), "unknown lead")
        .when(_is("opt_out") & c("_firm").isNull(), "unknown company")
        .when(_is("approve") & (~c("_was").isin(IN_REVIEW) | (c("any") < _order()) | F.coalesce(stopped, F.lit(False))), "not awaiting review")
        .when(_is("send") & (c("_sent").isNotNull() | (c("send") < _order())), "sent before")
        .when(_is("outcome") & ~F.coalesce(c("outcome").isin(OUTCOMES), F.lit(False)), "invalid outcome")
        .when(~c("kind").isin("approve", "reject", "send", "outcome", "opt_out"), "invalid kind")
    )
    return rows.withColumns({"why": why, "regenerate": F.coalesce("regenerate", F.lit(True))}).drop("_was", "_sent", "_known", "_firm", "any", "send", "stop")


def _last(value: Column, when: Column) -> Column:
    """The value at the last event for which `when` holds, as struct(o, v)."""
    return F.max(F.when(when, F.struct(_order().alias("o"), value.alias("v"))))


def _outreach(rows: DataFrame, delta: DataFrame) -> DataFrame:
    own = delta.where(c("outreach_id").isNotNull()).groupBy("outreach_id").agg(
        F.max(F.when(_is("approve"), F.struct(_order().alias("o"), c("by").alias("by"), c("edited").alias("edited")))).alias("_yes"),
        F.max(F.when(_is("reject"), F.struct(_order().alias("o"), c("reason").alias("reason")))).alias("_no"),
        F.min(F.when(_is("reject"), _order())).alias("_first_no"),
        F.min(F.when(_is("send"), F.struct(_order().alias("o"), c("by").alias("by"), c("send_mode").alias("mode")))).alias("_out"),
    )
    stop = delta.where(_cancels()).groupBy("lead_id").agg(F.min(F.struct(_order().alias("o"), _why_cancelled().alias("reason"))).alias("_stop"))
    all_ = rows.join(own, "outreach_id", "left").join(stop, "lead_id", "left")
    stopped = (c("kind") != "initial") & c("sent_at").isNull() & c("status").isin(UNSENT_DRAFT) & _before(c("_stop.o"), c("_out.o")) & _before(c("_stop.o"), c("_first_no"))
    all_ = all_.withColumn("_cut", F.when(stopped, c("_stop")))
    step = lambda o, status, reason: F.struct(o.alias("o"), F.lit(status).alias("status"), reason.alias("reason"))
    kept = lambda o, status: F.when(o.isNotNull(), step(o, status, c("rejected_reason")))
    last = F.greatest(
        kept(c("_yes.o"), "APPROVED"), F.when(c("_no").isNotNull(), step(c("_no.o"), "REJECTED", c("_no.reason"))), kept(c("_out.o"), "SENT"), F.when(c("_cut").isNotNull(), step(c("_cut.o"), "REJECTED", c("_cut.reason"))),
    )
    refused = F.greatest(F.when(c("_no").isNotNull(), step(c("_no.o"), "", c("_no.reason"))), F.when(c("_cut").isNotNull(), step(c("_cut.o"), "", c("_cut.reason"))))
    edited = F.coalesce("_yes.edited", "message_edited")
    return all_.withColumns(
        {
            "status": F.coalesce(last["status"], "status"),
            "rejected_reason": F.when(refused.isNotNull(), refused["reason"]).otherwise(c("rejected_reason")),
            "final_message": F.when(c("_yes").isNotNull() | c("_out").isNotNull(), F.coalesce(edited, "message")).otherwise(c("final_message")),
            "message_edited": edited,
            "variation": F.when(c("_yes.edited").isNotNull(), "custom").otherwise(c("variation")),
            "approved_by": F.when(c("_yes").isNotNull(), c("_yes.by")).otherwise(c("approved_by")),
            "approved_at": F.coalesce("_yes.o.at", "approved_at"),
            "sent_at": F.coalesce("_out.o.at", "sent_at"),
            "sent_by": F.when(c("_out").isNotNull(), c("_out.by")).otherwise(c("sent_by")),
            "send_mode": F.when(c("_out").isNotNull(), c("_out.mode")).otherwise(c("send_mode")),
        }
    ).select(rows.columns)


def _started(delta: DataFrame, leads: DataFrame) -> DataFrame:
    """(lead_id, _born): the first message of a lead, if it begins the sequence."""
    first = delta.where(_is("send")).groupBy("lead_id").agg(F.min(F.struct(_order().alias("o"), c("draft_kind").alias("kind"))).alias("s"))
    fresh = leads.where(c("first_sent_at").isNull()).select("lead_id", "campaign_id")
    return first.where(c("s.kind") == "initial").join(fresh, "lead_id").select("lead_id", "campaign_id", c("s.o").alias("_born"))


def _followups(rows: DataFrame, delta: DataFrame, started: DataFrame, plans: DataFrame | None) -> DataFrame:
    """The follow-ups with _was (status at the start), _cut, _out: orders of the events that counted."""
    default = F.array(*(F.lit(d) for d in R.DAY_OFFSETS))
    begun = started.withColumns({"day_offsets": F.lit(None).cast("array<int>"), "enabled": F.lit(True)}) if plans is None else started.join(plans, "campaign_id", "left")
    begun = begun.where(F.coalesce("enabled", F.lit(True))).select("lead_id", "_born", F.posexplode(F.slice(F.coalesce("day_offsets", default), 1, len(R.FOLLOWUP_KINDS))).alias("i", "days"))
    kinds = F.array(*(F.lit(k) for k in R.FOLLOWUP_KINDS))
    values = {"lead_id": c("lead_id"), "step": c("i") + 1, "kind": F.get(kinds, c("i")), "status": F.lit("SCHEDULED"), "due_at": c("_born.at") + F.make_interval(days=c("days")), "_born": c("_born")}
    new = begun.select(*(values.get(n, F.lit(None)).cast(t).alias(n) for n, t in rows.dtypes), "_born").join(rows.select("lead_id", "step"), ["lead_id", "step"], "left_anti")
    both = stored(rows.withColumn("_born", F.lit(None).cast(new.schema["_born"].dataType)).unionByName(new.select(*rows.columns, "_born")))
    begins = started.select("lead_id", c("_born").alias("_starts"))
    said = delta.join(begins, "lead_id", "left").where(_cancels() | c("kind").isin("approve", "reject", "send")).select(
        "lead_id", _order().alias("o"), "kind", c("step").alias("_step"), c("outreach_id").alias("_draft"), _cancels().alias("stops"), F.when(_cancels(), _why_cancelled()).alias("_why"), "regenerate",
        F.coalesce(_order() == c("_starts"), F.lit(False)).alias("starts"),
    )
    here = c("_step") == c("step")
    met = both.select("lead_id", "step", "_born").join(said.withColumnRenamed("kind", "did"), "lead_id").where(c("_born").isNull() | (c("o") > c("_born")))
    by = met.groupBy("lead_id", "step").agg(
        F.min(F.when((c("did") == "approve") & here, c("o"))).alias("_yes"),
        F.min(F.when(c("stops"), F.struct("o", "_why"))).alias("_stop"),
        F.min(F.when((c("did") == "reject") & ~c("regenerate"), F.struct("o", F.lit("message_rejected").alias("_why")))).alias("_no"),
        F.min(F.when((c("did") == "send") & here & ~c("starts"), F.struct("o", "_draft"))).alias("_out"),
    )
    all_ = both.join(by, ["lead_id", "step"], "left").withColumn("_was", c("status"))
    either = F.least("_stop", "_no")
    sure = (c("_was") == "PENDING_REVIEW") & _before(c("_yes"), either["o"]) & _before(c("_yes"), c("_out.o"))
    cut = F.when(c("_was").isin("SCHEDULED", "PENDING_REVIEW") & ~sure, either).when(c("_was").isin(UNSENT_STEP), c("_stop"))
    all_ = all_.withColumns({"_sure": sure, "_out": F.when(c("_was") != "SENT", c("_out"))})
    all_ = all_.withColumn("_cut", F.when(_before(cut["o"], c("_out.o")), cut))
    return all_.withColumns(
        {
            "status": F.when(c("_out").isNotNull(), "SENT").when(c("_cut").isNotNull(), "CANCELLED").when(c("_sure"), "APPROVED").otherwise(c("status")),
            "cancelled_reason": F.coalesce("_cut._why", "cancelled_reason"),
            "sent_at": F.coalesce("_out.o.at", "sent_at"),
            "outreach_id": F.coalesce("_out._draft", "outreach_id"),
        }
    )


def _leads(rows: DataFrame, delta: DataFrame, followups: DataFrame) -> DataFrame:
    again = _is("reject") & c("regenerate")
    fixed = _is("opt_out") | _is("outcome") | (again & (c("draft_kind") == "initial"))
    stage = F.when(_is("opt_out"), "NOT_INTERESTED").when(_is("outcome"), c("outcome")).otherwise("RESEARCHED")
    status = F.when(_is("approve"), "APPROVED").when(again, "NEW").when(_is("reject"), "REJECTED").when(_is("send"), "SENT").when(_is("opt_out"), "OPTED_OUT").otherwise(c("outcome"))
    by = delta.groupBy("lead_id").agg(
        _last(stage, fixed).alias("_stage"), _last(status, ~(_is("outcome") & (c("outcome") == "CONVERSATION"))).alias("_status"),
        F.max(F.when(_is("approve"), _order())).alias("_yes"), F.min(F.when(_is("approve"), _order())).alias("_first_yes"),
        F.max(F.when(_is("send"), _order())).alias("_out"), F.min(F.when(_is("send"), _order())).alias("_first_out"), F.max(F.when(_is("send"), c("step"))).alias("_step"),
        F.max(F.when(_cancels(), _order())).alias("_stop"), F.max(again).alias("_again"),
        F.array_sort(F.collect_list(F.when(_is("outcome") & c("note").isNotNull(), F.struct(_order().alias("o"), c("note").alias("note"))))).alias("_notes"),
    )
    all_ = rows.join(by, "lead_id", "left")
    # When the last message went out: the earliest step that was still to come.
    due = followups.join(by.select("lead_id", "_out").where("_out is not null").withColumnRenamed("_out", "_sent"), "lead_id")
    waits = (c("_was") == "SCHEDULED") & (c("_cut").isNull() | (c("_cut.o") > c("_sent"))) & (c("_out").isNull() | (c("_out.o") > c("_sent"))) & (c("_born").isNull() | (c("_born") <= c("_sent")))
    all_ = all_.join(due.where(waits).groupBy("lead_id").agg(F.min("due_at").alias("_due")), "lead_id", "left")
    since = lambda o: c(o).isNotNull() & (c("_stage").isNull() | (c(o) > c("_stage.o")))
    start = F.coalesce("_stage.v", "stage")
    moved = F.when(start.isin(BEFORE_SENDING) & since("_out"), "DM_SENT").when(start.isin(BEFORE_APPROVAL) & since("_yes"), "READY_FOR_OUTREACH").otherwise(start)
    noted = F.concat_ws("\n", "notes", F.array_join(F.transform("_notes", lambda x: x["note"]), "\n"))
    return all_.withColumns(
        {
            "stage": moved,
            "status": F.coalesce("_status.v", "status"),
            "notes": F.when(F.size("_notes") > 0, noted).otherwise(c("notes")),
            "approved_at": F.coalesce("approved_at", _at("_first_yes")),
            "first_sent_at": F.coalesce("first_sent_at", _at("_first_out")),
            "last_sent_at": F.coalesce(_at("_out"), "last_sent_at"),
            "followup_step": F.greatest("followup_step", "_step"),
            "message_generated_at": F.when(~F.coalesce("_again", F.lit(False)), c("message_generated_at")),
            "next_followup_at": F.when(_before(c("_stop"), c("_out")) & c("_out").isNull(), None).when(c("_stop") > c("_out"), None).when(c("_out").isNotNull(), c("_due")).otherwise(c("next_followup_at")),
        }
    ).select(rows.columns)


def _conversations(rows: DataFrame, delta: DataFrame) -> DataFrame:
    sent = delta.where(_is("send")).groupBy("lead_id", "channel").agg(F.count("*").alias("_n"), F.max("at").alias("_at_max"), F.max(_order()).alias("_last"), F.min(_order()).alias("_first"))
    all_ = rows.withColumn("_old", F.lit(True)).join(sent, ["lead_id", "channel"], "full")
    ended = delta.where(_is("outcome") & (c("outcome") != "CONVERSATION")).select("lead_id", _order().alias("o"), "outcome")
    told = all_.select("lead_id", "channel", F.when(c("_old").isNull(), c("_first")).alias("_born")).join(ended, "lead_id").where(c("_born").isNull() | (c("o") > c("_born")))
    told = told.groupBy("lead_id", "channel").agg(F.max_by("outcome", "o").alias("_told"))
    all_ = all_.join(told, ["lead_id", "channel"], "left")
    waits = F.when(c("_old").isNull() | (c("_n").isNotNull() & (c("state") == "AWAITING_US")), "AWAITING_PROSPECT").otherwise(c("state"))
    out = all_.withColumns(
        {
            "state": F.coalesce("_told", waits),
            "message_count": F.coalesce("message_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
            "last_message_at": F.coalesce(_at("_last"), "last_message_at"),
            "last_direction": F.when(c("_n").isNotNull(), "outbound").otherwise(c("last_direction")),
        }
    )
    return out.select(rows.columns)


def apply_events(state: State, events: DataFrame, wanted: Iterable[str] | None = None) -> tuple[State, DataFrame]:
    """state: leads, outreach, followups, conversations, messages, companies, suppressions, applied
    (event_id), and if wanted plans (campaign_id, day_offsets, enabled). (the tables after the events,
    the events that did not count with the reason). wanted: names of tables; the others stay as they were."""
    weighed = stored(weigh(state, events))
    delta = weighed.where("why is null")
    out = dict(state)
    asked = set(state if wanted is None else wanted)
    if "outreach" in asked:
        out["outreach"] = _outreach(state["outreach"], delta)
    if asked & {"followups", "leads"}:
        steps = stored(_followups(state["followups"], delta, _started(delta, state["leads"]), state.get("plans")))
        if "followups" in asked:
            out["followups"] = steps.select(state["followups"].columns)
        if "leads" in asked:
            out["leads"] = _leads(state["leads"], delta, steps)
    if "conversations" in asked:
        out["conversations"] = _conversations(state["conversations"], delta)
    if "messages" in asked:
        yes = delta.where(_is("approve")).select("outreach_id", "edited")
        texts = state["outreach"].select("outreach_id", "message", "message_edited")
        body = F.coalesce("edited", "message_edited", "message")
        said = delta.where(_is("send")).drop("edited").join(yes, "outreach_id", "left").join(texts, "outreach_id", "left")
        said = said.select("lead_id", "channel", "outreach_id", F.lit("outbound").alias("direction"), body.alias("body"), c("at").alias("sent_at"))
        out["messages"] = state["messages"].unionByName(said.select(state["messages"].columns))
    if asked & {"companies", "suppressions"}:
        gone = delta.where(_is("opt_out")).groupBy("company_id").agg(F.max_by("reason", _order()).alias("_reason"), F.min(F.struct(_order().alias("o"), "reason")).alias("_first"))
        firms = stored(state["companies"].join(gone.withColumn("_gone", F.lit(True)), "company_id", "left"))
        if "companies" in asked:
            mark = F.coalesce("_gone", F.lit(False))
            out["companies"] = firms.withColumns({"suppressed": mark | F.coalesce("suppressed", F.lit(False)), "suppressed_reason": F.when(mark, c("_reason")).otherwise(c("suppressed_reason"))}).select(state["companies"].columns)
        if "suppressions" in asked:
            out["suppressions"] = state["suppressions"].unionByName(_barred(firms, state["suppressions"]))
    if "applied" in asked:
        out["applied"] = state["applied"].select("event_id").unionByName(weighed.select("event_id"))
    return out, weighed.where("why is not null").select("event_id", "at", "kind", "outreach_id", "lead_id", "why")


def _barred(firms: DataFrame, before: DataFrame) -> DataFrame:
    """The keys of companies that are gone, where they are not suppressed yet."""
    keys = F.array(F.struct(F.lit("company_id").alias("key_type"), c("company_id").cast("string").alias("key_value")), F.struct(F.lit("instagram_handle").alias("key_type"), c("instagram_handle").alias("key_value")))
    rows = firms.where("_gone").select(F.explode(keys).alias("k"), c("_first").alias("reason")).select("k.*", "reason").where("key_value is not null")
    rows = rows.groupBy("key_type", "key_value").agg(F.min("reason").alias("first")).select("key_type", "key_value", c("first.reason").alias("reason"))
    return rows.join(before.select("key_type", "key_value"), ["key_type", "key_value"], "left_anti")
