"""Service fit of leads from named signals: scores, bands, offers, angles, verdicts.

A lead carries `signals`, an array of struct(signal, confidence, evidence) in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.config import rules as R
from leadspark.operators.ranking import with_place

c = F.col
VOLUME = "High public review volume"


def _named(signals: Column, names) -> Column:
    return F.filter(signals, lambda s: s["signal"].isin(*names))


def split_signals(signals: Column) -> dict[str, Column]:
    """The signals for each service, and those that say why there is little to go by."""
    return {
        "voice": _named(signals, [n for n in R.VOICE_POINTS if n != VOLUME]),
        "support": _named(signals, [n for n in R.SUPPORT_POINTS if n != VOLUME]),
        "caveats": _named(signals, R.CAVEATS),
    }


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def _clamped(x: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), _half_up(x)))


def _award(s: Column, points: dict[str, int]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in points.items() for x in pair))
    weight = F.when(s["confidence"] == "HIGH", 1.0).when(s["confidence"] == "MEDIUM", 0.7).otherwise(0.4)
    return F.element_at(table, s["signal"]) * weight


def _fit(signals: Column, points: dict[str, int]) -> tuple[Column, Column]:
    """Points of the signals in their order (review volume last), and the reasons."""
    mine = F.concat(_named(signals, [n for n in points if n != VOLUME]), _named(signals, [VOLUME]))
    total = F.aggregate(mine, F.lit(0.0), lambda acc, s: acc + _award(s, points))
    reason = lambda s: F.concat(s["signal"], F.lit(" (+"), _half_up(_award(s, points)).cast("string"), F.lit(", "), F.lower(s["confidence"]), F.lit(" confidence)"))
    return total, F.transform(mine, reason)


def _parts(*parts: tuple[Column, int, Column]) -> tuple[Column, Column]:
    """Sum of the points whose condition holds, and their texts."""
    total = F.lit(0)
    for cond, points, _ in parts:
        total = total + F.when(cond, points).otherwise(0)
    return total, F.array_compact(F.array(*(F.when(cond, text) for cond, _, text in parts)))


def _number(x: Column) -> Column:
    """A number as text, without a fraction of zero."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def classify(score: Column, bands: list[tuple[str, int]] | None = None) -> Column:
    """The label of the highest band that the score reaches."""
    out = F.lit("BAD")
    for label, least in sorted(bands or R.V1_BANDS, key=lambda b: b[1]):
        out = F.when(score >= least, label).otherwise(out)
    return out


def reachability() -> tuple[Column, Column]:
    found = c("instagram_confidence")
    return _parts(
        (c("domain").isNotNull(), 25, F.lit("website on file (+25)")),
        (c("phone_e164").isNotNull(), 20, F.lit("valid phone number (+20)")),
        (found == "HIGH", 40, F.lit("Instagram confirmed on the company website (+40)")),
        (found == "MEDIUM", 25, F.lit("Instagram found but unconfirmed (+25)")),
        (found == "LOW", 5, F.lit("Instagram is only a guess (+5)")),
        (found.isNull() | ~found.isin("HIGH", "MEDIUM", "LOW"), 0, F.lit("no Instagram account found (+0) - this lead cannot be reached on Instagram")),
        (c("email").isNotNull(), 10, F.lit("email on file (+10)")),
        (c("contact_name").isNotNull(), 5, F.lit("named contact on file (+5)")),
    )


def legitimacy() -> tuple[Column, Column]:
    n, stars = c("review_count"), c("rating")
    count = lambda text: F.concat(n.cast("string"), F.lit(text))
    total, texts = _parts(
        (n >= 200, 30, count(" reviews (+30)")),
        ((n >= 50) & (n < 200), 20, count(" reviews (+20)")),
        ((n >= 10) & (n < 50), 10, count(" reviews (+10)")),
        (n < 10, -10, F.concat(F.lit("only "), n.cast("string"), F.lit(" reviews (-10)"))),
        (stars >= 4.0, 15, F.concat(_number(stars), F.lit(" star rating (+15)"))),
        (stars < 3.0, -10, F.concat(_number(stars), F.lit(" star rating (-10)"))),
        (c("website_reachable"), 15, F.lit("website serves a readable page (+15)")),
    )
    return total + 40, texts


def score_leads(leads: DataFrame) -> DataFrame:
    """R9. Adds the two service scores, overall_score, classification, score_reasons, caps_applied."""
    support, why_support = _fit(c("signals"), R.SUPPORT_POINTS)
    voice, why_voice = _fit(c("signals"), R.VOICE_POINTS)
    reach, why_reach = reachability()
    legit, why_legit = legitimacy()
    rows = leads.withColumns({"_cs": _clamped(support), "_av": _clamped(voice), "_reach": _clamped(reach), "_legit": _clamped(legit)})
    cap = F.when(c("domain").isNull(), R.NO_WEBSITE_CAP).when(~F.coalesce("website_reachable", F.lit(False)), R.UNREADABLE_SITE_CAP)
    because = F.when(c("domain").isNull(), "no website to verify anything against").otherwise("the website could not be read")
    said = lambda name, score: F.when(score > cap, F.concat(F.lit(f"{name} capped at "), cap.cast("string"), F.lit(": "), because))
    rows = rows.withColumn("caps_applied", F.array_compact(F.array(said("customer support", c("_cs")), said("AI voice", c("_av")))))
    rows = rows.withColumns({"customer_support_score": F.least("_cs", cap), "ai_voice_score": F.least("_av", cap)})
    cs, av = c("customer_support_score"), c("ai_voice_score")
    best = F.greatest(cs, av)
    rows = rows.withColumn("overall_score", _clamped(best * 0.60 + c("_reach") * 0.22 + c("_legit") * 0.18))
    text = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in x))
    reasons = F.array(
        text("Best service fit: ", F.when(cs >= av, "customer support").otherwise("AI voice"), " at ", best, "/100 (60% of overall)."),
        F.when(F.size(why_support) > 0, text("Customer support ", cs, "/100 from: ", F.array_join(why_support, "; "), ".")).otherwise("Customer support 0/100: no e-commerce, multi-channel or support-hiring evidence found."),
        F.when(F.size(why_voice) > 0, text("AI voice ", av, "/100 from: ", F.array_join(why_voice, "; "), ".")).otherwise("AI voice 0/100: no phone, booking or appointment evidence found."),
        text("Reachability ", c("_reach"), "/100 (22% of overall): ", F.array_join(why_reach, "; "), "."),
        text("Legitimacy ", c("_legit"), "/100 (18% of overall): ", F.when(F.size(why_legit) > 0, F.array_join(why_legit, "; ")).otherwise("no rating or review data"), "."),
    )
    rows = rows.withColumns({"classification": classify(c("overall_score")), "score_reasons": F.concat(reasons, c("caps_applied"))})
    return rows.drop("_cs", "_av", "_reach", "_legit")


def recommend_offer(scored: DataFrame) -> DataFrame:
    """R11. Adds recommended_offer and offer_reason."""
    cs, av = c("customer_support_score"), c("ai_voice_score")
    split = split_signals(c("signals"))
    strong = {k: F.filter(split[k], lambda s: s["confidence"].isin("HIGH", "MEDIUM")) for k in ("voice", "support")}
    cite = lambda k: F.array_join(F.transform(F.slice(strong[k], 1, 2), lambda s: F.lower(s["signal"])), " and ")
    text = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in x))
    enough = (F.size(strong["support"]) >= R.BOTH_MIN_SIGNALS) & (F.size(strong["voice"]) >= R.BOTH_MIN_SIGNALS)
    offer = F.when((cs >= R.BOTH_MIN) & (av >= R.BOTH_MIN) & enough, "BOTH").when((cs >= R.MIN_FIT) & (cs > av), "CUSTOMER_SUPPORT").when((av >= R.MIN_FIT) & (av >= cs), "AI_VOICE").otherwise("NONE")
    why = F.coalesce(
        F.get(split["caveats"], F.lit(0))["evidence"],
        text(f"neither service clears the {R.MIN_FIT}/100 evidence threshold (customer support ", cs, ", AI voice ", av, ")"),
    )
    reason = (
        F.when(c("recommended_offer") == "BOTH", text("Independent evidence for each service: ", cite("support"), " point to support volume (", cs, "/100), while ", cite("voice"), " point to phone and appointment workload (", av, "/100)."))
        .when((c("recommended_offer") == "CUSTOMER_SUPPORT") & (F.size(strong["support"]) > 0), text(cite("support"), " indicate customer-support volume (", cs, "/100 vs ", av, "/100 for AI voice)."))
        .when(c("recommended_offer") == "CUSTOMER_SUPPORT", text("Customer support scores higher (", cs, "/100 vs ", av, "/100), though the supporting evidence is low confidence."))
        .when((c("recommended_offer") == "AI_VOICE") & (F.size(strong["voice"]) > 0), text(cite("voice"), " indicate a phone and appointment led operation (", av, "/100 vs ", cs, "/100 for customer support)."))
        .when(c("recommended_offer") == "AI_VOICE", text("AI voice scores higher (", av, "/100 vs ", cs, "/100), though the supporting evidence is low confidence."))
        .otherwise(text("No service recommended: ", why, ". Nothing here justifies an approach yet."))
    )
    return scored.withColumn("recommended_offer", offer).withColumn("offer_reason", reason)


def pick_angles(leads: DataFrame, angles: DataFrame) -> DataFrame:
    """R12. leads: (lead_id, niche, profile, angle_override, ai_angle); angles: (niche, position,
    angle_id, words, pattern, bonus), a configuration table. (lead_id, angle_id, score, source): the
    model's angle if the niche has it, else the campaign's, else the best by words of the profile
    and the angle's own pattern, the first of equals."""
    rows = leads.join(F.broadcast(angles), "niche", "left")  # a list of angles for each niche, kept by hand
    text = F.lower(F.coalesce("profile", F.lit("")))
    hits = F.size(F.filter(F.array_distinct("words"), lambda w: F.contains(text, w)))
    bonus = F.when(F.regexp_like(text, c("pattern")), c("bonus")).otherwise(0)
    rows = rows.withColumn("score", F.when(c("angle_id").isNotNull(), F.coalesce(hits, F.lit(0)) + bonus))
    first = F.struct((-c("score")).alias("s"), c("position").alias("p"))
    each = rows.groupBy("lead_id").agg(
        F.bool_or(c("angle_id") == c("ai_angle")).alias("has_ai"),
        F.bool_or(c("angle_id") == c("angle_override")).alias("has_own"),
        F.max("ai_angle").alias("ai"),
        F.max("angle_override").alias("own"),
        F.max("score").alias("best"),
        F.min_by("angle_id", first).alias("by_score"),
        F.count("angle_id").alias("n"),
    )
    source = F.when(c("has_ai"), "ai").when(c("ai").isNotNull(), "fallback_unknown_ai_angle").when(c("has_own"), "campaign").when(c("n") == 0, "none").when(c("best") == 0, "default").otherwise("signals")
    angle = F.when(c("has_ai"), c("ai")).when(c("has_own"), c("own")).otherwise(c("by_score"))
    return each.select("lead_id", angle.alias("angle_id"), F.coalesce("best", F.lit(0)).alias("score"), source.alias("source"))


def explain(components: Column, score: Column, band: Column, penalties: Column, gates: Column) -> Column:
    """R7. components: array of struct(name, weight, score, note) in order; heaviest share first,
    equal ones in order. penalties: array of struct(id, amount); gates: array of names."""
    place = F.transform(components, lambda x, i: F.struct((-(x["weight"] * x["score"])).alias("k"), i.alias("i"), x.alias("x")))
    note = lambda x: F.when(x["note"].isNotNull(), F.concat(F.lit(", "), x["note"])).otherwise("")
    said = lambda p: F.concat(p["x"]["name"], F.lit(" "), p["x"]["score"].cast("string"), F.lit("/100 (weight "), p["x"]["weight"].cast("string"), note(p["x"]), F.lit(")"))
    parts = F.array_join(F.transform(F.array_sort(place), said), "; ")
    lost = F.array_join(F.transform(penalties, lambda p: F.concat(p["id"], F.lit(" -"), p["amount"].cast("string"))), ", ")
    return F.concat(
        F.lit("ICP "), score.cast("string"), F.lit("/100 ("), band, F.lit("). "), parts, F.lit("."),
        F.when(F.size(penalties) > 0, F.concat(F.lit(" Penalties: "), lost, F.lit("."))).otherwise(""),
        F.when(F.size(gates) > 0, F.concat(F.lit(" Hard gate failures: "), F.array_join(gates, ", "), F.lit("."))).otherwise(""),
    )


def verdict(rows: DataFrame, min_score: int = 70, researched: tuple[str, ...] = ("HIGH_PRIORITY", "QUALIFIED")) -> DataFrame:
    """R8. rows: (ai_disqualify, ai_reason, qualified_by_score, gates, icp_score, icp_band). Adds
    decision, disqualify_reason, and research: whether the band is researched without being asked."""
    out = c("ai_disqualify") | ~c("qualified_by_score")
    why = F.when(c("ai_disqualify"), c("ai_reason")).otherwise(F.coalesce(F.get("gates", F.lit(0)), F.when(c("icp_score") < min_score, "below_min_icp_score")))
    return rows.withColumns({"decision": F.when(out, "DISQUALIFIED").otherwise("QUALIFIED"), "disqualify_reason": why, "research": ~out & c("icp_band").isin(*researched)})


def draft_gate(rows: DataFrame) -> DataFrame:
    """Which leads get a message: a band and an offer that call for one, and a handle to send it to."""
    wanted = c("classification").isin("BEST", "GOOD") & (c("recommended_offer") != "NONE")
    return rows.withColumn("draft", wanted & c("instagram_confidence").isin("HIGH", "MEDIUM"))


def ranked(rows: DataFrame, by: str = "campaign_id") -> DataFrame:
    """T5: place in the queue of each campaign: priority, score (none last), age, key."""
    urgency = F.when(c("priority") == "high", 0).when(c("priority") == "medium", 1).when(c("priority") == "low", 2).otherwise(3)
    return with_place(rows, [by], [urgency.asc(), c("icp_score").desc_nulls_last(), *(c(x).asc() for x in ("created_at", "lead_id", "line", "part"))])
