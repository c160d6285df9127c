"""Cases of page evidence: quotes, entities, unreadable pages, running hiring, limits of lists."""

from pyspark.sql import functions as F

from leadspark.functions import texts as X
from leadspark.operators import research as E

PAGES = "lead_id long, page_no long, url string, label string, html string, ok boolean, status int, error string"


def test_quotes_and_entities(spark):
    text = "one two three four five six seven eight please call us now " + "word " * 40
    df = spark.createDataFrame([(text, "<p>A&#38;lt; &#x41;&AMP;B &middot; &rsquo;</p>"), (None, None)], "t string, p string")
    r = df.select(X.snippet(F.col("t"), X.place(F.col("t"), "call us")).alias("s"), X.page_text(F.col("p")).alias("p")).collect()
    # The place 25 before lies inside "five", so the quote begins with that word.
    assert r[0].s.startswith("...five six seven eight please call us now word") and r[0].s.endswith("word...")
    assert r[0].p == "A< A&B &middot; '" and r[1].s is None and r[1].p is None


def test_evidence(spark):
    rows = [
        (1, 0, "u0", "homepage", "<title> Glow </title> a receptionist is here", True, 200, None),
        (1, 1, "u1", "about", '<a href="/careers">c</a> our dispatcher', True, 200, None),
        (1, 2, "u2", "faq", None, True, None, None),
        (2, 0, "v0", "homepage", "<p>x</p>", False, 403, None),
        (2, 1, "v1", "contact", None, None, None, "timeout"),
        (3, 0, "w0", "homepage", " ".join(f"mailto:m{i}@x.co" for i in [1, 1, 2, 3, 4, 5, 6, 7]), True, 200, None),
    ]
    df = spark.createDataFrame(rows, PAGES)
    got = {r.lead_id: r for r in E.lead_evidence(E.page_facts(df)).collect()}
    # The first page names a role before any sign of hiring; the second one has both.
    assert got[1].support_roles and got[1].hiring == ["c our dispatcher"] and got[1].title == "Glow"
    assert (got[1].pages_read, got[1].pages_failed, got[1].first_url) == (2, 1, "u0")
    assert not got[2].website_reachable and got[2].first_failure == "403" and "(403)" in got[2].notes
    assert got[3].email == [f"m{i}@x.co" for i in range(1, 6)] and got[3].mailto_count == 8
    assert E.lead_evidence(E.page_facts(df.limit(0))).count() == 0


def test_facts_of_a_page_are_made_once(spark):
    """Sums and lists read the same facts; pages are not parsed for each of them."""
    from pyspark.sql import functions as F

    from leadspark.operators import research as E

    seen = spark.sparkContext.accumulator(0)

    def told(url):
        seen.add(1)
        return url

    pages = spark.range(40).selectExpr(
        "id % 8 as lead_id", "id as page_no", "concat('https://s.co/', id) as url", "'homepage' as label", "'<a href=\"/cart\">add to cart</a> cdn.shopify.com' as html",
        "true as ok", "cast(null as int) as status", "cast(null as string) as error",
    )
    facts = E.page_facts(pages).withColumn("url", F.udf(told, "string")("url"))
    rows = E.lead_evidence(facts).select("lead_id", "pages_read", "first_url", "shop").collect()
    assert len(rows) == 8 and all(r.pages_read == 5 and r.first_url and r.shop for r in rows)
    assert seen.value == 40


def test_pages_of_one_file_reach_many_tasks(spark):
    from leadspark.plans import research_queries as Q

    sizes = Q.pages(spark, "/root/testdata/sf0.001").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(n > 0 for n in sizes) >= spark.sparkContext.defaultParallelism
