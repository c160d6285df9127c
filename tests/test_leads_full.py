import contextlib

from pyspark.sql import functions as F

from leadspark.operators import reports as Q

CO = "name instagram_handle instagram_url website website_domain state city ig_followers ig_posts products_count products_services email phone ig_last_post_at".split()
CT = "full_name title role_category email linkedin_url target_reason".split()


@contextlib.contextmanager
def shuffled_joins(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    was = {k: spark.conf.get(k, None) for k in names}
    for k, v in zip(names, ("-1", "-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def view(spark, leads):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    filled = lambda df, names: df.withColumns({k: F.concat(F.lit(f"{k} "), df.columns[0]) for k in names})
    companies = filled(table([(1, "n1"), (2, "n2"), (3, None)], "company_id long, niche_id string"), CO)
    contacts = filled(table([(7,), (8,)], "contact_id long"), CT)
    at = "lead_id long, created_at int, seq string"
    old = table([(1, 1, "a", "old", ["x"]), (1, 2, "a", "second", None), (1, 2, "b", None, ["y"]), (9, 1, "a", "none", [])], at + ", reason string, potential_pain_points array<string>")
    briefs = table([(2, 1, "a", "sells", "asks")], at + ", business_summary string, why_relevant string")
    drafts = table([(1, 5, "a", "Hi", "A", "SENT", 3)], at + ", message string, variation string, status string, sent_at int")
    campaigns = F.broadcast(table([("c", "C")], "campaign_id string, name string"))
    return Q.leads_full(leads, companies, campaigns, table([("n1", "N1")], "niche_id string, name string"), contacts, old, briefs, drafts)


def test_missing_keys_repeated_leads_and_latest_rows(spark):
    rows = [(1, 1, 7, "c"), (2, 2, None, "c"), (2, 1, 8, "c"), (2, 1, 8, "c"), (3, 4, 7, "c"), (4, None, 7, "c"), (5, 1, 7, "d"), (6, 3, 9, "c"), (None, 1, 7, "c")]
    leads = spark.createDataFrame(rows, "lead_id long, company_id long, contact_id long, campaign_id string")
    with shuffled_joins(spark):
        got = view(spark, leads).select("lead_id", "business_name", "niche_name", "decision_maker", "qualification_reason", "potential_pain_points", "business_summary", "latest_message", "campaign_name").collect()
    want = [
        (1, "name 1", "N1", "full_name 7", None, ["y"], None, "Hi", "C"),
        (2, "name 2", None, None, None, None, "sells", None, "C"),
        (2, "name 1", "N1", "full_name 8", None, None, "sells", None, "C"),
        (2, "name 1", "N1", "full_name 8", None, None, "sells", None, "C"),
        (None, "name 1", "N1", "full_name 7", None, None, None, None, "C"),
        (6, "name 3", None, None, None, None, None, None, "C"),
    ]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_leads_without_contact_and_of_one_company_are_not_one_tasks(spark):
    leads = spark.range(2000).select(F.col("id").alias("lead_id"), F.lit(1).cast("long").alias("company_id"), F.lit(None).cast("long").alias("contact_id"), F.lit("c").alias("campaign_id"))
    with shuffled_joins(spark):
        sizes = [r["count"] for r in view(spark, leads).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 1500
