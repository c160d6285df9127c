"""Signals, scores and offers over leads derived from `customer`, and ranked queues, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.config import rules as R
from leadspark.operators import v1 as V
from leadspark.plans.inputs import table, with_sql

c = F.col
SIGNALS = list(dict.fromkeys([*R.SUPPORT_POINTS, *R.VOICE_POINTS, *R.CAVEATS]))
#: Columns of a lead, by expressions that both engines read.
COLUMNS = {
    "lead_id": "c_custkey",
    "domain": "case when c_custkey % 6 <> 0 then concat('shop', cast(c_custkey as string), '.com') end",
    "phone_e164": "case when c_custkey % 4 <> 0 then concat('+1', cast(2000000000 + c_custkey as string)) end",
    "email": "case when c_custkey % 3 = 0 then 'a@b.co' end",
    "contact_name": "case when c_custkey % 5 = 0 then c_name end",
    "instagram_confidence": "case c_custkey % 4 when 0 then 'HIGH' when 1 then 'MEDIUM' when 2 then 'LOW' end",
    "review_count": "case when c_custkey % 7 <> 0 then cast(c_custkey * 13 % 400 as int) end",
    "rating": "case when c_custkey % 8 <> 0 then cast(c_custkey % 10 as double) / 2 end",
    "website_reachable": "c_custkey % 5 <> 2",
}
# A lead has signal i if this holds; its confidence follows.
_HAS = "(k * 7 + i * 5 + k % 11 * i) % 3 <> 0 and k % 9 <> 1"
_CONFIDENCE = "case (k + i) % 4 when 0 then 'LOW' when 1 then 'MEDIUM' else 'HIGH' end"


def v1_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as k", *(f"{e} as {n}" for n, e in COLUMNS.items()))
    every = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("signal")) for i, n in enumerate(SIGNALS)))
    rows = rows.withColumn("every", every)
    signals = F.expr(f"transform(filter(every, s -> {_HAS.replace('i * 5', 's.i * 5').replace('11 * i', '11 * s.i')}), s -> struct(s.signal as signal, {_CONFIDENCE.replace('+ i', '+ s.i')} as confidence, concat('seen: ', s.signal) as evidence))")
    return rows.withColumn("signals", signals).drop("every", "k")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v1_leads(spark, sf_dir)
    names = lambda s: F.array_join(F.transform(s, lambda x: x["signal"]), "|")
    return rows.select("lead_id", *(names(s).alias(k) for k, s in V.split_signals(c("signals")).items()))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.draft_gate(V.recommend_offer(V.score_leads(v1_leads(spark, sf_dir))))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return rows.select("lead_id", "customer_support_score", "ai_voice_score", "overall_score", F.size("caps_applied").alias("caps"))


def _angles(spark: SparkSession) -> DataFrame:
    rows = [(s, *a) for s in ("AUTOMOBILE", "BUILDING", "MACHINERY") for a in ANGLES]
    return spark.createDataFrame(rows, "niche string, position int, angle_id string, words array<string>, pattern string, bonus int")


#: position, id, words, pattern, bonus
ANGLES = [
    (0, "order_questions", ["ironic", "packages"], "order|shipping|tracking|delivery", 3),
    (1, "returns", ["deposits", "theodolites"], "return|exchange|refund", 3),
    (2, "growth_support", ["requests", "accounts"], "growing|scal|launch|drop|sold out|restock", 2),
]
_PROFILE = "concat(c_name, ' ', case c_custkey % 5 when 0 then 'fast SHIPPING, ironic' when 1 then 'requests and deposits' when 2 then 'easy refund' else 'none' end)"
_OVERRIDE = "case when c_custkey % 13 = 0 then 'returns' when c_custkey % 13 = 1 then 'unknown' end"
_AI = "case when c_custkey % 11 = 0 then 'growth_support' when c_custkey % 11 = 1 then 'made_up' end"


def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as lead_id", "c_mktsegment as niche", f"{_PROFILE} as profile", f"{_OVERRIDE} as angle_override", f"{_AI} as ai_angle")
    return V.pick_angles(leads, _angles(spark))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "leads").selectExpr(
        "lead_id", "lead_id % 10 = 0 as ai_disqualify", "case when lead_id % 10 = 0 then 'franchise' end as ai_reason", "coalesce(qualified, false) as qualified_by_score",
        "case when lead_id % 7 = 0 then array('followers', 'niche') else cast(array() as array<string>) end as gates", "icp_score", "case when icp_score >= 85 then 'HIGH_PRIORITY' when icp_score >= 70 then 'QUALIFIED' else 'REVIEW' end as icp_band",
    )
    return V.verdict(rows).select("lead_id", "decision", "disqualify_reason", "research")


_PRIORITY = "case when icp_score >= 85 then 'high' when icp_score >= 70 then 'medium' when icp_score >= 55 then 'low' end"


def _approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = table(spark, sf_dir, "leads").selectExpr("lead_id", "campaign_id", "icp_score", f"{_PRIORITY} as priority")
    open_ = table(spark, sf_dir, "outreach").where(c("status") == "PENDING_REVIEW").select("lead_id", "line", "part", "kind", "created_at")
    return V.ranked(open_.join(leads, "lead_id")).select("campaign_id", "place", "lead_id", "line", "part", "kind", "priority", "icp_score")


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that wait for us: the last inbound message of each lead's thread, if it is open."""
    m = table(spark, sf_dir, "messages")
    inbound = c("direction") == "inbound"
    last = F.struct("sent_at", "event_id")
    rows = m.groupBy("lead_id").agg(
        F.count("*").alias("message_count"), F.max("sent_at").alias("last_message_at"), F.max_by("direction", last).alias("last_direction"),
        F.max_by("classification", F.when(inbound, last)).alias("classification"),
    )
    return rows.where("classification is null or classification <> 'not_now'")


QUERIES = {
    "e08_split_signals": _split,
    "r09_v1_scores": _scores,
    "r10_v1_classes": lambda s, d: _scored(s, d).select("lead_id", "classification"),
    "r11_v1_offers": lambda s, d: _scored(s, d).select("lead_id", "recommended_offer", "offer_reason", "draft"),
    "r12_angles": _picked,
    "r08_verdicts": _verdicts,
    "t05_approval_queue": _approvals,
    "q02_open_conversations": _talks,
}


def _values(points: dict[str, int]) -> str:
    return ", ".join(f"('{n}', {p})" for n, p in points.items())


_LONG = f"""v1 as (select c_custkey as k, {', '.join(f'{e} as {n}' for n, e in COLUMNS.items())} from customer),
names as (select i - 1 as i, n as signal from (select unnest({SIGNALS!r}) as n, unnest(range(1, {len(SIGNALS) + 1})) as i)),
sig as (select lead_id, i, signal, {_CONFIDENCE} as confidence from v1, names where {_HAS}),
sp(signal, p) as (values {_values(R.SUPPORT_POINTS)}), vp(signal, p) as (values {_values(R.VOICE_POINTS)}),
w as (select *, case confidence when 'HIGH' then 1.0::double when 'MEDIUM' then 0.7::double else 0.4::double end as wt, signal = '{V.VOLUME}' as vol from sig),
cs as (select lead_id, sum(p * wt order by vol, i) as t, count(*) filter (where not vol and confidence <> 'LOW') as strong,
  string_agg(lower(signal), ' and ' order by i) filter (where rs <= 2 and not vol and confidence <> 'LOW') as cite from
  (select *, row_number() over (partition by lead_id, vol or confidence = 'LOW' order by i) as rs from w join sp using (signal)) group by 1),
av as (select lead_id, sum(p * wt order by vol, i) as t, count(*) filter (where not vol and confidence <> 'LOW') as strong,
  string_agg(lower(signal), ' and ' order by i) filter (where rs <= 2 and not vol and confidence <> 'LOW') as cite from
  (select *, row_number() over (partition by lead_id, vol or confidence = 'LOW' order by i) as rs from w join vp using (signal)) group by 1),
cav as (select lead_id, concat('seen: ', arg_min(signal, i)) as e from sig where signal in {tuple(R.CAVEATS)!r} group by 1),
fit as (select v1.*, coalesce(cs.strong, 0) as ss, coalesce(av.strong, 0) as vs, cs.cite as sc, av.cite as vc, cav.e as caveat,
  cast(least(100, floor(coalesce(cs.t, 0) + 0.5)) as int) as s0, cast(least(100, floor(coalesce(av.t, 0) + 0.5)) as int) as v0,
  case when domain is null then {R.NO_WEBSITE_CAP} when not website_reachable then {R.UNREADABLE_SITE_CAP} else 1000 end as cap,
  least(100, case when domain is null then 0 else 25 end + case when phone_e164 is null then 0 else 20 end + case instagram_confidence when 'HIGH' then 40 when 'MEDIUM' then 25 when 'LOW' then 5 else 0 end
    + case when email is null then 0 else 10 end + case when contact_name is null then 0 else 5 end) as reach,
  least(100, 40 + case when review_count is null then 0 when review_count >= 200 then 30 when review_count >= 50 then 20 when review_count >= 10 then 10 else -10 end
    + case when rating is null then 0 when rating >= 4 then 15 when rating < 3 then -10 else 0 end + case when website_reachable then 15 else 0 end) as legit
  from v1 left join cs using (lead_id) left join av using (lead_id) left join cav using (lead_id)),
scored as (select *, least(s0, cap) as s, least(v0, cap) as v, (s0 > cap)::int + (v0 > cap)::int as caps,
  cast(least(100, floor(greatest(least(s0, cap), least(v0, cap)) * 0.6::double + reach * 0.22::double + legit * 0.18::double + 0.5)) as int) as overall from fit),
offers as (select *, case when overall >= 80 then 'BEST' when overall >= 65 then 'GOOD' when overall >= 50 then 'REVIEW' else 'BAD' end as classification,
  case when s >= {R.BOTH_MIN} and v >= {R.BOTH_MIN} and ss >= 2 and vs >= 2 then 'BOTH' when s >= {R.MIN_FIT} and s > v then 'CUSTOMER_SUPPORT' when v >= {R.MIN_FIT} and v >= s then 'AI_VOICE' else 'NONE' end as offer from scored)"""


def _joined(names) -> str:
    return f"coalesce(string_agg(signal, '|' order by i) filter (where signal in {tuple(names)!r}), '')"


_ANGLE_ROWS = ", ".join(f"('{s}', {p}, '{a}', {w!r}, '{r}', {b})" for s in ("AUTOMOBILE", "BUILDING", "MACHINERY") for p, a, w, r, b in ANGLES)
ORACLES = {
    "e08_split_signals": f"with {_LONG} select v1.lead_id, {_joined([n for n in R.VOICE_POINTS if n != V.VOLUME])} as voice, {_joined([n for n in R.SUPPORT_POINTS if n != V.VOLUME])} as support, {_joined(R.CAVEATS)} as caveats from v1 left join sig using (lead_id) group by 1",
    "r09_v1_scores": f"with {_LONG} select lead_id, s as customer_support_score, v as ai_voice_score, overall as overall_score, caps from scored",
    "r10_v1_classes": f"with {_LONG} select lead_id, classification from offers",
    "r11_v1_offers": f"""with {_LONG} select lead_id, offer as recommended_offer, case
  when offer = 'BOTH' then concat('Independent evidence for each service: ', sc, ' point to support volume (', s, '/100), while ', vc, ' point to phone and appointment workload (', v, '/100).')
  when offer = 'CUSTOMER_SUPPORT' and ss > 0 then concat(sc, ' indicate customer-support volume (', s, '/100 vs ', v, '/100 for AI voice).')
  when offer = 'CUSTOMER_SUPPORT' then concat('Customer support scores higher (', s, '/100 vs ', v, '/100), though the supporting evidence is low confidence.')
  when offer = 'AI_VOICE' and vs > 0 then concat(vc, ' indicate a phone and appointment led operation (', v, '/100 vs ', s, '/100 for customer support).')
  when offer = 'AI_VOICE' then concat('AI voice scores higher (', v, '/100 vs ', s, '/100), though the supporting evidence is low confidence.')
  else concat('No service recommended: ', coalesce(caveat, concat('neither service clears the 45/100 evidence threshold (customer support ', s, ', AI voice ', v, ')')), '. Nothing here justifies an approach yet.') end as offer_reason,
  classification in ('BEST', 'GOOD') and offer <> 'NONE' and instagram_confidence in ('HIGH', 'MEDIUM') as draft from offers""",
    "r12_angles": f"""with angles(niche, position, angle_id, words, pattern, bonus) as (values {_ANGLE_ROWS}),
l as (select c_custkey as lead_id, c_mktsegment as niche, lower({_PROFILE}) as profile, {_OVERRIDE} as own, {_AI} as ai from customer),
r as (select l.*, angle_id, position, len(list_filter(words, lambda w: contains(profile, w))) + case when regexp_matches(profile, pattern) then bonus else 0 end as score from l left join angles using (niche)),
e as (select lead_id, any_value(own) as own, any_value(ai) as ai, bool_or(angle_id = ai) as has_ai, bool_or(angle_id = own) as has_own, max(score) as best, arg_min(angle_id, -score * 100 + position) as pick, count(angle_id) as n from r group by 1)
select lead_id, case when has_ai then ai when has_own then own else pick end as angle_id, coalesce(case when n > 0 then best end, 0) as score,
  case when has_ai then 'ai' when ai is not null then 'fallback_unknown_ai_angle' when has_own then 'campaign' when n = 0 then 'none' when best = 0 then 'default' else 'signals' end as source from e""",
    "r08_verdicts": with_sql(
        """select lead_id, case when lead_id % 10 = 0 or not coalesce(qualified, false) then 'DISQUALIFIED' else 'QUALIFIED' end as decision,
  case when lead_id % 10 = 0 then 'franchise' when lead_id % 7 = 0 then 'followers' when icp_score < 70 then 'below_min_icp_score' end as disqualify_reason,
  not (lead_id % 10 = 0 or not coalesce(qualified, false)) and coalesce(icp_score, 0) >= 70 as research from leads"""
    ),
    "t05_approval_queue": with_sql(
        f"""select campaign_id, row_number() over (partition by campaign_id order by case priority when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end, icp_score desc nulls last, created_at, lead_id, line, part) as place,
  lead_id, line, part, kind, priority, icp_score from (select outreach.*, campaign_id, icp_score, {_PRIORITY} as priority from outreach join leads using (lead_id) where outreach.status = 'PENDING_REVIEW') t"""
    ),
    "q02_open_conversations": with_sql(
        """select * from (select lead_id, count(*) as message_count, max(sent_at) as last_message_at, last(direction order by sent_at, event_id) as last_direction,
  last(classification order by sent_at, event_id) filter (where direction = 'inbound') as classification from messages group by 1) t where classification is null or classification <> 'not_now'"""
    ),
}
