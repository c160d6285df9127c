import json

import pytest
from pyspark.sql import functions as F

from leadspark.operators import lifecycle as L
from leadspark.plans.inputs import table
from leadspark.sources import files as IO
from leadspark.streaming import replies as ST

CSV = '''business_name , instagram,Website,City,State,Phone,Notes
"Glow, Med Spa",@glow.spa,glowspa.com,los angeles,CA,(310) 555-0199,"two
lines"
,,,,,,
,@nobody,,,,,x
Bright Skin,not ok!,https://linktr.ee/b,,Calif.,5555555555,
'''


def test_lead_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    rows = IO.read_lead_file(spark, str(tmp_path / "a.csv"))
    assert rows.count() == 3
    leads, skipped = IO.map_rows(rows, "test")
    a, b = sorted(leads.collect(), key=lambda r: r.original_row)
    assert (a.company_name, a.domain, a.phone_e164, a.city, a.state, a.instagram_handle) == ("Glow, Med Spa", "glowspa.com", "+13105550199", "Los Angeles", "CA", "glow.spa")
    assert a.original_record["Notes"] == "two\nlines" and a.original_row == 2
    assert (b.domain, b.phone_e164, b.state, b.instagram_handle) == (None, None, "CA", None)
    assert [r.reason for r in skipped.collect()] == ["no company name"]
    with pytest.raises(ValueError):
        IO.map_rows(rows.select("City", "source_file", "original_row"), "x")
    assert IO.profile(leads, ["domain", "phone_e164"]).first().asDict() == {"n_rows": 2, "with_domain": 1, "with_phone_e164": 1}


def test_inbound_payload(spark):
    body = {"entry": [{"messaging": [{"sender": {"id": "9"}, "timestamp": 1700000000000, "message": {"mid": "m1", "text": "hi"}}, {"sender": {"id": "9"}, "timestamp": 1, "message": {"mid": "m2", "text": "x", "is_echo": True}}, {"sender": {"id": "9"}, "timestamp": 1, "message": {"mid": "m3", "text": " "}}]}]}
    got = IO.inbound_messages(spark.createDataFrame([(json.dumps(body),), ("broken",), (None,)], "body string")).collect()
    assert [(r.sender, r.text, r.external_message_id) for r in got] == [("9", "hi", "m1")]


def test_sheet_and_mirror(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=1+1", ["a", "b"]), (2, 'say "x"', None)], "id int, t string, l array<string>")
    IO.write_sheet(rows, str(tmp_path / "s"))
    text = "".join(p.read_text() for p in (tmp_path / "s").glob("*.csv"))
    assert "'=1+1" in text and "a | b" in text and '"say ""x"""' in text
    old = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "k int, x string, y string")
    new = spark.createDataFrame([(2, None, "n"), (3, "z", None)], "k int, x string, y string")
    got = sorted(tuple(r) for r in IO.mirror(old, new, "k").collect())
    assert got == [(1, "a", "b", "kept"), (2, "c", "n", "updated"), (3, "z", None, "appended")]
    up = IO.daily_upsert(spark.createDataFrame([("d", None, 1), ("d", "x", 2)], "day string, c string, n int"), spark.createDataFrame([("d", None, 5)], "day string, c string, n int"), ["day", "c"])
    assert sorted(r.n for r in up.collect()) == [2, 5]


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_stream_dedup_and_days(spark, tmp_path):
    schema = "external_message_id string, sent_at timestamp_ltz, lead_id long, direction string, event_id long"
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    import datetime as dt

    at = lambda h: dt.datetime(2026, 1, 1, h)
    rows = [("a", at(1), 1, "inbound", 1), ("a", at(1), 1, "inbound", 2), (None, at(2), 1, "inbound", 3), (None, at(2), 1, "inbound", 4), ("b", at(3), 2, "outbound", 5)]
    s = _stream(spark, tmp_path, rows, schema)
    q = ST.distinct_messages(s).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 4
    q = ST.daily_counts(s).writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.direction, r.messages) for r in spark.table("days").collect()) == [("inbound", 4), ("outbound", 1)]


def test_reply_stops_the_sequence(spark, tmp_path):
    import datetime as dt

    sent = spark.createDataFrame([(1, dt.datetime(2026, 1, 1)), (2, dt.datetime(2026, 1, 1))], "lead_id long, sent_at timestamp")
    plan = L.schedule(sent)
    assert plan.count() == 6 and L.new_followups(plan, plan.where("step = 1")).count() == 4
    schema = "lead_id long, sent_at timestamp, direction string"
    s = _stream(spark, tmp_path, [(1, dt.datetime(2026, 1, 2), "inbound"), (2, dt.datetime(2026, 1, 2), "outbound")], schema)
    out = str(tmp_path / "cancelled")
    plan = plan.withColumns({"state": F.when(F.col("step") == 1, "SENT").otherwise("SCHEDULED"), "cancel_reason": F.lit(None).cast("string")})
    q = ST.stop_sequences(s, lambda: plan, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "c"))
    q.awaitTermination(120)
    got = spark.read.parquet(f"{out}/0").collect()
    assert {(r.lead_id, r.step, r.cancel_reason) for r in got} == {(1, k, "reply_received") for k in (2, 3)}


def test_counters_do_not_depend_on_batches(spark):
    rows = table(spark, "/root/testdata/sf0.001", "messages")
    whole = ST.thread_counters(rows)
    parts = ST.merge_counters(ST.thread_counters(rows.where("event_id % 2 = 0")), ST.thread_counters(rows.where("event_id % 2 = 1")))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.select(*whole.columns).collect()))


def test_schedule_with_window(spark):
    import datetime as dt

    sent = spark.createDataFrame([(1, dt.datetime(2026, 9, 22, 17))], "lead_id long, sent_at timestamp")
    got = L.schedule(sent, [2, 5, 9], {"start": 9, "end": 18, "days": (1, 2, 3, 4, 5)}).orderBy("step").collect()
    assert [r.due_at for r in got] == [dt.datetime(2026, 9, 24, 17), dt.datetime(2026, 9, 28, 9), dt.datetime(2026, 10, 1, 17)]
