import datetime as dt
import time

from leadspark.streaming import sequences as SQ

T = lambda d, y=2026: dt.datetime(y, 1, d)


def run(spark, tmp_path, messages, plans, want):
    """One more delivery to both streams, taken up where the last run stopped. With timers on the clock
    a query asks for batches for ever, so it is stopped once it wrote what is wanted."""
    for name, rows, schema in (("m", messages, "lead_id long, sent_at timestamp, direction string"), ("p", plans, "lead_id long, step int, due_at timestamp")):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
    df = SQ.sequences(read("m", "lead_id long, sent_at timestamp, direction string"), read("p", "lead_id long, step int, due_at timestamp"), 30)
    out = str(tmp_path / "out")
    q = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", out).trigger(processingTime="1 second").start()
    got, end, more = [], time.time() + 40, None
    while q.isActive and time.time() < end and (more is None or q.lastProgress.batchId < more):
        time.sleep(0.5)
        if more is None and (tmp_path / "out" / "_spark_metadata").exists():
            schema = "lead_id long, what string, step int, at timestamp"
            got = sorted(((r.lead_id, r.what, r.step, r.at) for r in spark.read.schema(schema).parquet(out).collect()), key=str)
            # Two batches more show that nothing is sent again.
            more = q.lastProgress.batchId + 2 if got == want and q.lastProgress else None
    assert q.exception() is None
    q.stop()
    return sorted(((r.lead_id, r.what, r.step, r.at) for r in spark.read.parquet(out).collect()), key=str)


def test_reply_silence_restart_and_late_reply(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SQ.PROVIDER)
    try:
        far = 2100
        plans = [(1, 1, T(5, far)), (1, 2, T(9, far)), (2, 1, T(5, far)), (3, 1, T(5)), (None, 1, T(5))]
        silent = (3, "nurture", None, T(5) + dt.timedelta(days=30))
        want = sorted([(1, "cancelled", 1, T(5, far)), (1, "cancelled", 2, T(9, far)), (1, "replied", None, T(3)), silent], key=str)
        assert run(spark, tmp_path, [(1, T(3), "inbound"), (1, T(2), "outbound"), (2, T(3), "outbound")], plans, want) == want
        # After a restart: an earlier reply arrives late, and a step is planned after the reply.
        want = sorted([*want, (1, "cancelled", 3, T(12, far))], key=str)
        assert run(spark, tmp_path, [(1, T(1), "inbound"), (1, None, "inbound")], [(1, 3, T(12, far))], want) == want
        # A reply after the end of the sequence still counts, once.
        want = sorted([*want, (3, "replied", None, T(20))], key=str)
        assert run(spark, tmp_path, [(3, T(20), "inbound"), (3, T(21), "inbound"), (2, T(20), "outbound")], [], want) == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
