import datetime as dt

from pyspark.sql import functions as F

from leadspark.functions import contract as K
from leadspark.functions import texts as X
from leadspark.operators import lifecycle as L
from leadspark.operators import outreach as O

T = lambda d: dt.datetime(2026, 1, d)


def test_failures_and_backoff(spark):
    leads = spark.createDataFrame([(1, 2, "NEW", T(1), None), (2, 0, "NEW", T(1), "before")], "lead_id int, retry_count int, status string, updated_at timestamp, last_error string")
    bad = spark.createDataFrame([(1, "x", "timeout", T(2)), (1, "y" * 900, "timeout", T(3))], "lead_id int, message string, error_type string, at timestamp")
    out, errors = O.fail_leads(leads, bad)
    got = {r.lead_id: (r.retry_count, r.status, r.last_error and len(r.last_error)) for r in out.collect()}
    assert got == {1: (4, "ERROR", 500), 2: (0, "NEW", 6)}
    assert {(r.next_retry_at - r.at).seconds for r in errors.collect()} == {16}


def test_nurture(spark):
    leads = spark.createDataFrame([(1, 7, "h", "NEW", "DM_SENT", None, None, None), (2, 8, None, "NEW", "DM_SENT", "old", T(1), T(4))], "lead_id int, company_id int, instagram_handle string, status string, stage string, notes string, replied_at timestamp, recheck_at timestamp")
    f = spark.createDataFrame([(1, "followup_3_final", "SENT", T(9)), (2, "followup_3_final", "SENT", T(9))], "lead_id int, kind string, state string, due_at timestamp")
    got = {r.lead_id: (r.stage, str(r.recheck_at)) for r in O.after_last_step(leads, f).collect()}
    assert got == {1: ("NURTURE", "2026-04-09 00:00:00"), 2: ("DM_SENT", "2026-01-04 00:00:00")}


def test_replies_and_companies(spark):
    leads = spark.createDataFrame([(1, "h"), (2, "g"), (3, "h")], "lead_id int, instagram_handle string")
    r = spark.createDataFrame([("h", None), ("x", 2), ("zz", None)], "handle string, given_lead int")
    ok, orphans = O.match_replies(r, leads)
    assert sorted(x.lead_id for x in ok.collect()) == [1, 2] and [x.handle for x in orphans.collect()] == ["zz"]
    rows = spark.createDataFrame([(0, "h", "a.com", "glow", None, None), (1, None, "b.com", "glow", None, None)], "seq int, instagram_handle string, website_domain string, name_normalized string, city string, state string")
    known = spark.createDataFrame([("website_domain", "a.com", 5), ("instagram_handle", "h", 6)], "key_type string, key_value string, company_id int")
    res, fresh = O.resolve_companies(rows, known)
    assert {r.seq: r.company_id for r in res.collect()} == {0: 6, 1: None}
    assert sorted((r.key_type, r.seq) for r in fresh.collect()) == [("name_city", 0), ("website_domain", 1)]


def test_texts(spark):
    page = "<style>p{}</style><p>A &amp; B&#8217;s <b>shop</b></p><script>x<y</script><!-- no -->end"
    df = spark.createDataFrame([(page, 'Sure: {"a": "}{", "b": {"c": 1}} ok', "word " * 80)], "p string, j string, t string")
    r = df.select(X.visible_text(F.col("p")).alias("v"), K.extract_json(F.col("j")).alias("j"), X.snippet(F.col("t"), F.lit(200), 40).alias("s"), X.snippet(F.col("p"), F.lit(1), 300).alias("whole")).first()
    assert r.v == "A & B’s shop end" and r.j == '{"a": "}{", "b": {"c": 1}}'
    assert r.s.startswith("...word") and r.s.endswith("word...") and r.whole == page
    sig = spark.sql("select array(named_struct('signal', 's', 'evidence', 'e', 'confidence', 'HIGH')) as x").select(X.numbered_signals(F.col("x")).alias("n")).first().n
    assert sig == "1. s [HIGH]: e"


def test_sent_followups_stay_sent(spark):
    f = spark.createDataFrame([(1, 1, "SENT", None), (1, 2, "SCHEDULED", None), (2, 1, "SENT", None), (2, 2, "PENDING", None), (3, 1, "SCHEDULED", None)], "lead_id int, step int, state string, cancel_reason string")
    leads = spark.createDataFrame([(1, None, "NEW", "DM_SENT"), (2, T(3), "REPLIED", "REPLIED"), (3, None, "OPTED_OUT", "DM_SENT")], "lead_id int, replied_at timestamp, status string, stage string")
    got = {(r.lead_id, r.step): (r.state, r.cancel_reason) for r in L.cancel(f, leads).collect()}
    assert got == {(1, 1): ("SENT", None), (1, 2): ("SCHEDULED", None), (2, 1): ("SENT", None), (2, 2): ("CANCELLED", "reply_received"), (3, 1): ("CANCELLED", "status_opted_out")}
