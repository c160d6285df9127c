"""The event fold against a sequential simulation of the actions, one event at a time."""

import datetime as dt
import random

from leadspark.operators import events as E

DAY = dt.datetime(2026, 1, 1)
at = lambda n: DAY + dt.timedelta(hours=n)
SCHEMAS = {
    "leads": "lead_id int, campaign_id string, company_id int, stage string, status string, notes string, first_sent_at timestamp, last_sent_at timestamp, followup_step int, next_followup_at timestamp, approved_at timestamp, message_generated_at timestamp",
    "outreach": "outreach_id int, lead_id int, channel string, kind string, followup_step int, status string, message string, message_edited string, final_message string, variation string, approved_by string, approved_at timestamp, rejected_reason string, sent_at timestamp, sent_by string, send_mode string",
    "followups": "lead_id int, step int, kind string, status string, due_at timestamp, sent_at timestamp, outreach_id int, cancelled_reason string",
    "conversations": "lead_id int, channel string, state string, last_message_at timestamp, last_direction string, message_count long",
    "messages": "lead_id int, channel string, outreach_id int, direction string, body string, sent_at timestamp",
    "companies": "company_id int, instagram_handle string, suppressed boolean, suppressed_reason string",
    "suppressions": "key_type string, key_value string, reason string",
    "applied": "event_id int",
    "plans": "campaign_id string, day_offsets array<int>, enabled boolean",
}
EVENTS = "event_id int, at timestamp, kind string, outreach_id int, lead_id int, by string, edited string, reason string, regenerate boolean, outcome string, note string, send_mode string"
names = lambda schema: [x.strip().split()[0] for x in schema.split(",")]


def simulate(state, events):
    """One event after the other on plain rows, as the actions are specified."""
    leads = {r["lead_id"]: r for r in state["leads"]}
    drafts = {r["outreach_id"]: r for r in state["outreach"]}
    steps = {(r["lead_id"], r["step"]): r for r in state["followups"]}
    talks = {(r["lead_id"], r["channel"]): r for r in state["conversations"]}
    firms = {r["company_id"]: r for r in state["companies"]}
    barred = {(r["key_type"], r["key_value"]): r for r in state["suppressions"]}
    plans = {r["campaign_id"]: r for r in state["plans"]}
    done, refused = {r["event_id"] for r in state["applied"]}, set()
    of = lambda lead: [s for (k, _), s in steps.items() if k == lead]
    waiting = lambda lead: min((s["due_at"] for s in of(lead) if s["status"] == "SCHEDULED"), default=None)

    def cancel(lead, reason):
        for s in of(lead):
            if s["status"] in ("SCHEDULED", "GENERATING", "PENDING_REVIEW", "APPROVED"):
                s.update(status="CANCELLED", cancelled_reason=reason)
        for d in drafts.values():
            if d["lead_id"] == lead and d["kind"] != "initial" and d["status"] in ("DRAFT", "PENDING_REVIEW", "APPROVED") and d["sent_at"] is None:
                d.update(status="REJECTED", rejected_reason=reason)
        leads[lead]["next_followup_at"] = None

    for e in sorted(events, key=lambda e: (e["at"], e["event_id"])):
        if e["event_id"] in done:
            continue
        done.add(e["event_id"])
        d, lead = drafts.get(e["outreach_id"]), leads.get(e["lead_id"])
        if e["kind"] in ("approve", "reject", "send"):
            if d is None:
                refused.add(e["event_id"])
                continue
            lead = leads[d["lead_id"]]
        elif lead is None:
            refused.add(e["event_id"])
            continue
        if e["kind"] == "approve":
            if d["status"] not in ("DRAFT", "PENDING_REVIEW"):
                refused.add(e["event_id"])
                continue
            d["message_edited"] = e["edited"] or d["message_edited"]
            d.update(status="APPROVED", final_message=d["message_edited"] or d["message"], variation="custom" if e["edited"] else d["variation"], approved_by=e["by"], approved_at=e["at"])
            if lead["stage"] in ("MESSAGE_GENERATED", "PENDING_APPROVAL"):
                lead["stage"] = "READY_FOR_OUTREACH"
            lead.update(status="APPROVED", approved_at=lead["approved_at"] or e["at"])
            s = steps.get((lead["lead_id"], d["followup_step"]))
            if s and s["status"] == "PENDING_REVIEW":
                s["status"] = "APPROVED"
        elif e["kind"] == "reject":
            d.update(status="REJECTED", rejected_reason=e["reason"])
            if e["regenerate"] is not False:
                if d["kind"] == "initial":
                    lead["stage"] = "RESEARCHED"
                lead.update(status="NEW", message_generated_at=None)
            else:
                lead["status"] = "REJECTED"
                for s in of(lead["lead_id"]):
                    if s["status"] in ("SCHEDULED", "PENDING_REVIEW"):
                        s.update(status="CANCELLED", cancelled_reason="message_rejected")
        elif e["kind"] == "send":
            if d["sent_at"] is not None:
                refused.add(e["event_id"])
                continue
            key = (lead["lead_id"], d["channel"])
            talk = talks.setdefault(key, dict(lead_id=key[0], channel=key[1], state="AWAITING_PROSPECT", message_count=0))
            d.update(status="SENT", sent_at=e["at"], sent_by=e["by"], send_mode=e["send_mode"], final_message=d["message_edited"] or d["message"])
            state["messages"].append(dict(lead_id=key[0], channel=key[1], outreach_id=d["outreach_id"], direction="outbound", body=d["final_message"], sent_at=e["at"]))
            talk.update(last_message_at=e["at"], last_direction="outbound", message_count=talk["message_count"] + 1, state="AWAITING_PROSPECT" if talk["state"] == "AWAITING_US" else talk["state"])
            first = lead["first_sent_at"] is None
            if lead["stage"] in ("READY_FOR_OUTREACH", "PENDING_APPROVAL", "MESSAGE_GENERATED"):
                lead["stage"] = "DM_SENT"
            lead.update(status="SENT", first_sent_at=lead["first_sent_at"] or e["at"], last_sent_at=e["at"], followup_step=max(lead["followup_step"], d["followup_step"]))
            if d["kind"] == "initial" and first:
                plan = plans.get(lead["campaign_id"], {})
                if plan.get("enabled") is not False:
                    for i, days in enumerate((plan.get("day_offsets") or [2, 5, 9])[:3]):
                        steps.setdefault((key[0], i + 1), dict(lead_id=key[0], step=i + 1, kind=["followup_1", "followup_2", "followup_3_final"][i], status="SCHEDULED", due_at=e["at"] + dt.timedelta(days=days)))
                    lead["next_followup_at"] = waiting(key[0])
            else:
                s = steps.get((key[0], d["followup_step"]))
                if s and s["status"] != "SENT":
                    s.update(status="SENT", sent_at=e["at"], outreach_id=d["outreach_id"])
                lead["next_followup_at"] = waiting(key[0])
        elif e["kind"] == "outcome":
            if e["outcome"] not in ("CONVERSATION", "INTERESTED", "NURTURE", "NOT_INTERESTED", "CLOSED"):
                refused.add(e["event_id"])
                continue
            lead["stage"] = e["outcome"]
            if e["outcome"] != "CONVERSATION":
                lead["status"] = e["outcome"]
                for (k, _), t in talks.items():
                    if k == lead["lead_id"]:
                        t["state"] = e["outcome"]
            if e["note"] is not None:
                lead["notes"] = (lead["notes"] + "\n" if lead["notes"] is not None else "") + e["note"]
            if e["outcome"] in ("NOT_INTERESTED", "CLOSED"):
                cancel(lead["lead_id"], e["outcome"].lower())
        else:
            firm = firms.get(lead["company_id"])
            if firm is None:
                refused.add(e["event_id"])
                continue
            firm.update(suppressed=True, suppressed_reason=e["reason"])
            for k, v in (("company_id", str(firm["company_id"])), ("instagram_handle", firm["instagram_handle"])):
                if v is not None:
                    barred.setdefault((k, v), dict(key_type=k, key_value=v, reason=e["reason"]))
            cancel(lead["lead_id"], "opted_out")
            lead.update(stage="NOT_INTERESTED", status="OPTED_OUT")
    state.update(followups=list(steps.values()), conversations=list(talks.values()), suppressions=list(barred.values()), applied=[{"event_id": x} for x in done])
    return state, refused


def made(seed, leads=220):
    r = random.Random(seed)
    s = {k: [] for k in SCHEMAS}
    s["plans"] = [dict(campaign_id="a", day_offsets=[1, 4], enabled=True), dict(campaign_id="b", day_offsets=None, enabled=None)]
    events = []
    for i in range(leads):
        sent = r.choice([None, None, at(-40)])
        s["leads"].append(dict(lead_id=i, campaign_id=r.choice("abc"), company_id=i // 2, stage=r.choice(["MESSAGE_GENERATED", "PENDING_APPROVAL", "READY_FOR_OUTREACH", "DM_SENT", "REPLIED"]), status="PROCESSING", notes=r.choice([None, "old"]), first_sent_at=sent, last_sent_at=sent, followup_step=r.choice([0, 2]), next_followup_at=r.choice([None, at(9)]), approved_at=r.choice([None, at(-9)]), message_generated_at=at(-50)))
        if i % 2 == 0 and i % 9:
            s["companies"].append(dict(company_id=i // 2, instagram_handle=r.choice([None, f"h{i // 8}"]), suppressed=None))
        for step, kind in enumerate(["initial", "followup_1", "followup_2", "followup_3_final"]):
            if r.random() < 0.8:
                status = r.choice(["DRAFT", "PENDING_REVIEW", "PENDING_REVIEW", "APPROVED", "REJECTED", "SENT"])
                s["outreach"].append(dict(outreach_id=10 * i + step, lead_id=i, channel=r.choice(["instagram", "instagram", "email"]), kind=kind, followup_step=step, status=status, message=f"m{i}", message_edited=r.choice([None, "mine"]), variation="a", rejected_reason="r" if status == "REJECTED" else None, sent_at=at(-30) if status == "SENT" else None))
            if step and r.random() < 0.5:
                s["followups"].append(dict(lead_id=i, step=step, kind=kind, status=r.choice(["SCHEDULED", "SCHEDULED", "GENERATING", "PENDING_REVIEW", "PENDING_REVIEW", "APPROVED", "SENT", "CANCELLED"]), due_at=at(r.randint(0, 99))))
        if r.random() < 0.4:
            s["conversations"].append(dict(lead_id=i, channel="instagram", state=r.choice(["AWAITING_US", "AWAITING_PROSPECT", "INTERESTED"]), message_count=2))
        for _ in range(r.randint(0, 9)):
            kind = r.choice(["approve", "approve", "send", "send", "reject", "outcome", "opt_out"] if r.random() < 0.6 else ["approve", "send"])
            lead = i if r.random() < 0.97 else 99999
            on = kind in ("approve", "reject", "send")
            events.append(dict(event_id=len(events), at=at(r.randint(0, 30)), kind=kind, outreach_id=10 * lead + r.randint(0, 3) if on else None, lead_id=None if on else lead, by=r.choice(["x", "y"]), edited=r.choice([None, None, "better"]) if kind == "approve" else None, reason=r.choice(["no", "why", None]), regenerate=r.choice([None, True, False]), outcome=r.choice(["CONVERSATION", "INTERESTED", "NURTURE", "NOT_INTERESTED", "CLOSED", "REPLIED"]) if kind == "outcome" else None, note=r.choice([None, "n"]), send_mode="manual"))
    return s, events


def frames(spark, s):
    return {k: spark.createDataFrame([tuple(r.get(n) for n in names(SCHEMAS[k])) for r in s[k]], SCHEMAS[k]) for k in SCHEMAS}


def rows(df, k):
    return sorted((tuple(r[n] for n in names(SCHEMAS[k])) for r in df.collect()), key=repr)


def test_against_a_simulation_and_again(spark):
    s, events = made(3)
    half = [e for e in events if e["at"] < at(15)]
    ev = lambda es: spark.createDataFrame([tuple(e[n] for n in names(EVENTS)) for e in es], EVENTS)
    state, late = E.apply_events(frames(spark, s), ev(events))
    want, refused = simulate({k: [dict(r) for r in v] for k, v in s.items()}, events)
    assert {r.event_id for r in late.collect()} == refused and len(refused) > 100
    for k in SCHEMAS:
        assert rows(state[k], k) == sorted((tuple(r.get(n) if (k, n) != ("companies", "suppressed") else bool(r.get(n)) for n in names(SCHEMAS[k])) for r in want[k]), key=repr), k
    # The same events once more change nothing; two batches give what one gives.
    settled = {k: E.settle(v) for k, v in state.items()}
    again, late = E.apply_events(settled, ev(events))
    assert late.count() == 0 and all(rows(again[k], k) == rows(settled[k], k) for k in SCHEMAS)
    one, _ = E.apply_events(frames(spark, s), ev(half))
    two, _ = E.apply_events({k: E.settle(v) for k, v in one.items()}, ev(events))
    for k in SCHEMAS:
        assert rows(two[k], k) == rows(settled[k], k), k


def test_no_events(spark):
    s, _ = made(4, 5)
    start = frames(spark, s)
    state, late = E.apply_events(start, spark.createDataFrame([], EVENTS))
    assert late.count() == 0
    for k in ("leads", "outreach", "followups", "conversations"):
        assert rows(state[k], k) == rows(start[k], k), k


def test_what_is_kept_on_disk_is_small(spark):
    """Rows between the steps stay on disk in compressed columns; one table asked for needs few of them."""
    import os

    from leadspark.components import shared_folder

    size = lambda: sum(os.path.getsize(os.path.join(f, n)) for f, _, ns in os.walk(shared_folder(spark).removeprefix("file:")) for n in ns if n.startswith("part-"))
    n = 200_000
    null = lambda schema: [f"cast(null as {x.strip().split()[1]}) as {x.strip().split()[0]}" for x in schema.split(",")]
    with_ids = lambda schema, **ids: spark.range(n).selectExpr(*(f"cast({ids[x.split()[-1]]} as int) as {x.split()[-1]}" if x.split()[-1] in ids else x for x in null(schema)))
    state = {k: spark.createDataFrame([], v) for k, v in SCHEMAS.items() if k != "plans"}
    state["leads"] = with_ids(SCHEMAS["leads"], lead_id="id", company_id="id % 10")
    state["outreach"] = with_ids(SCHEMAS["outreach"], outreach_id="id", lead_id="id").withColumns({"channel": E.F.lit("instagram"), "status": E.F.lit("APPROVED")})
    events = with_ids(EVENTS, event_id="id", outreach_id="id").withColumns({"at": E.F.lit(at(1)), "kind": E.F.lit("send"), "send_mode": E.F.lit("manual")})
    before = size()
    state, late = E.apply_events(state, events, ["conversations"])
    assert late.count() == 0 and state["conversations"].count() == n
    assert size() - before < 40 * n


def test_repeated_and_applied_events_count_once(spark):
    s, events = made(5, 12)
    ev = lambda es: spark.createDataFrame([tuple(e[n] for n in names(EVENTS)) for e in es], EVENTS)
    s["applied"] = [{"event_id": e["event_id"]} for e in events[::4]]
    once, late = E.apply_events(frames(spark, s), ev(events))
    twice, late2 = E.apply_events(frames(spark, s), ev(events + events[::3]), ["conversations", "messages", "applied"])
    assert sorted(r.event_id for r in late.collect()) == sorted(r.event_id for r in late2.collect())
    for k in ("conversations", "messages", "applied"):
        assert rows(twice[k], k) == rows(once[k], k), k
    assert len(rows(once["applied"], "applied")) == len(events)
