from leadspark.operators import v1 as V

SCHEMA = (
    "lead_id int, domain string, phone_e164 string, email string, contact_name string, instagram_confidence string, review_count int, rating double, website_reachable boolean,"
    " signals array<struct<signal:string,confidence:string,evidence:string>>"
)


def scored(spark, *rows):
    return {r.lead_id: r for r in V.recommend_offer(V.score_leads(spark.createDataFrame(rows, SCHEMA))).collect()}


def test_scores_have_reasons(spark):
    sells = [("Sells online", "HIGH", "cart"), ("Customer-facing hiring", "HIGH", "job"), ("Live chat already in place", "MEDIUM", "chat"), ("High public review volume", "HIGH", "300")]
    got = scored(spark, (1, "a.com", "+1", "x@a.com", None, "HIGH", 300, 4.5, True, sells), (2, None, None, None, None, None, None, None, None, []))
    a, b = got[1], got[2]
    assert (a.customer_support_score, a.ai_voice_score, a.overall_score, a.classification) == (70, 10, 81, "BEST")
    assert a.recommended_offer == "CUSTOMER_SUPPORT" and a.offer_reason == "sells online and customer-facing hiring indicate customer-support volume (70/100 vs 10/100 for AI voice)."
    assert a.score_reasons[1] == "Customer support 70/100 from: Sells online (+30, high confidence); Customer-facing hiring (+20, high confidence); Live chat already in place (+10, medium confidence); High public review volume (+10, high confidence)."
    assert a.score_reasons[4] == "Legitimacy 100/100 (18% of overall): 300 reviews (+30); 4.5 star rating (+15); website serves a readable page (+15)."
    assert (b.overall_score, b.classification, b.recommended_offer, len(b.score_reasons)) == (7, "BAD", "NONE", 5)
    assert b.score_reasons[4].endswith("no rating or review data.")


def test_caps_hold_unverified_leads_down(spark):
    voice = [(n, "HIGH", "x") for n in ("Appointment booking in use", "Phone is a prominent contact channel", "After-hours availability advertised", "Phone number published")]
    got = scored(spark, (1, None, "+1", None, None, "HIGH", 500, 5.0, None, voice), (2, "a.com", "+1", None, None, "HIGH", 500, 5.0, False, voice))
    assert [got[i].ai_voice_score for i in (1, 2)] == [45, 55]
    assert got[1].caps_applied == ["AI voice capped at 45: no website to verify anything against"]
    assert got[2].score_reasons[-1] == "AI voice capped at 55: the website could not be read"


def test_explanation_names_the_heaviest_share_first(spark):
    df = spark.createDataFrame(
        [([("a", 10, 50, None), ("b", 20, 40, "few"), ("c", 8, 100, None)], [("late", 5)], ["niche"])],
        "k array<struct<name:string,weight:int,score:int,note:string>>, p array<struct<id:string,amount:int>>, g array<string>",
    ).selectExpr("*", "61 as s", "'REVIEW' as b")
    got = df.select(V.explain(df.k, df.s, df.b, df.p, df.g).alias("t")).first().t
    assert got == "ICP 61/100 (REVIEW). b 40/100 (weight 20, few); c 100/100 (weight 8); a 50/100 (weight 10). Penalties: late -5. Hard gate failures: niche."
