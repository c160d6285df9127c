import re

from leadspark.config import openers as O
from leadspark.operators import compose as CO

SCHEMA = "k string, company_name string, business_instagram string, category string, owner_name string, recommended_offer string, signals array<struct<signal:string,evidence:string,interpretation:string,confidence:string,source:string>>"
CALL = "Call-to-action asks customers to phone"


def run(spark, cases):
    """cases: name -> changes of a lead."""
    rows = []
    for k, more in cases.items():
        lead = dict(k=k, company_name="Glow Medspa", business_instagram="glowmedspa", category="Medical spa", owner_name=None, recommended_offer="AI_VOICE", signals=[(CALL, 'Website text includes: "Call us today to book"')]) | more
        lead["signals"] = lead["signals"] and [(s[0], s[1], "never said", s[2] if len(s) > 2 else "HIGH", "https://example.com") for s in lead["signals"]]
        rows.append(tuple(lead[x.split()[0]] for x in SCHEMA.split(", ")[:7]))
    return {r.k: r for r in CO.compose(spark.createDataFrame(rows, SCHEMA), "Sam", "North Desk").collect()}


def test_cases(spark):
    booking = ("Appointment booking in use", "Booking platform detected: Boulevard.")
    channels = lambda said: [("Multiple customer contact channels", f"Channels present on the website: {said}.", "MEDIUM")]
    junk = ["...glow.co@gmail.com Facebook-f Instagram Call", 'Website text includes: "Skip to content Menu Home About Call"', 'Website text includes: "Call 512-555-0199"', 'Website text includes: "Book | Shop | Call"']
    names = ["Glow Medspa", "Radiance Aesthetics", "Lumen Skin Bar", "Ember Med Spa", "Vivid Aesthetics", "Halo Skin Clinic", "Nova Medspa", "Saga Aesthetics"]
    got = run(spark, {
        "plain": {}, "asked": {"signals": [(CALL, 'Website text includes: "Ready to book? Call us"')]}, "hours": {"signals": [("After-hours availability advertised", 'Website text includes: "open until 9pm"')]},
        "booking": {"signals": [booking]}, "chat": {"signals": [("Live chat already in place", "Intercom chat widget detected.")]},
        "low": {"signals": [("Phone-heavy business category", 'Category "Medical spa".', "LOW")]}, "none": {"recommended_offer": "NONE"}, "null": {"recommended_offer": None}, "both": {"recommended_offer": "BOTH"},
        "owner": {"owner_name": "Dana Whitfield"}, **{f"odd{i}": {"owner_name": o} for i, o in enumerate(["", None, "   ", "1234"])}, **{f"junk{i}": {"signals": [(CALL, e), booking]} for i, e in enumerate(junk)},
        "ways": {"recommended_offer": "CUSTOMER_SUPPORT", "signals": channels("returns/refunds policy, email, phone, contact form")},
        "noway": {"recommended_offer": "CUSTOMER_SUPPORT", "signals": channels("returns/refunds policy, help centre or customer service page")},
        "one call": {"signals": [("Phone is a prominent contact channel", "1 click-to-call link across the 2 page(s) read.")]}, "no signals": {"signals": None, "category": None}, "no evidence": {"signals": [(CALL, None)]},
        "long": {"signals": [(CALL, 'x "' + "please call us now and " * 5 + '"')]}, **{n: {"company_name": n} for n in names},
    })
    for k, r in got.items():
        if k in ("none", "null"):
            assert r.message == "" and r.self_check is None and "does not support an approach" in r.why_this_message
            continue
        assert r.message.endswith("?") and r.message.count("?") == 1 and not re.search(r"[.!,;:]\?", r.message) and 60 < len(r.message) <= 500
        assert all(v for n, v in r.self_check.asDict().items() if n != "opens_with_verified_observation"), r
        assert "never said" not in r.message and not any(p in r.message.lower() for p in O.BANNED) and not re.search(r"\b(he|him|his|she|her|hers)\b", r.message.lower())
    assert "Call us today to book" in got["plain"].message and got["plain"].observation_used.endswith('book"')
    assert all(got[f"junk{i}"].message.count("Boulevard") and "@" not in got[f"junk{i}"].message and not re.search("Facebook|Instagram|Skip|512-555", got[f"junk{i}"].message) for i in range(4))
    for k in ("low", "noway", "one call", "no signals", "no evidence"):
        assert not got[k].self_check.opens_with_verified_observation and "No medium or high confidence signal" in got[k].why_this_message and got[k].observation_used is None, k
    assert "medical spa" in got["low"].message and "clinic" in got["no signals"].message and 'Category "' not in got["low"].message
    assert got["both"].capability_mentioned == "AI voice receptionist" and "email, phone and contact form" in got["ways"].message and "returns/refunds" not in got["ways"].message
    assert got["owner"].message.startswith("Dana - ") and not any(got[f"odd{i}"].message.startswith((" -", "-")) for i in range(4))
    assert "please call us now and please call us now and please call us" in got["long"].message
    assert len({got[n].message.split(" -")[0] for n in names}) >= 2 and len({got[n].message for n in names}) >= 4


def test_plan_has_no_shuffle(spark):
    df = CO.compose(spark.createDataFrame([], SCHEMA), "Sam", "North Desk")
    assert df.count() == 0 and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
