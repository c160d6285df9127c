from pyspark.sql import functions as F

from leadspark.operators import contacts as CT
from leadspark.operators import search as SR


def test_decision_maker(spark):
    rows = [
        (1, 0, "A", "Barista", None, None, 0.9, True), (1, 1, "B", "Co-Founder", "b@x.co", None, None, True), (1, 2, "C", "Practice Owner", None, None, 0.5, True),
        (2, 0, "D", "Founder", None, None, 0.7, False), (2, 1, "E", "Customer Service Manager", None, None, 0.7, False), (3, 0, None, None, "x", None, 0.9, True), (4, 0, "F", None, None, None, 0.9, True),
    ]
    df = spark.createDataFrame(rows, "company_id int, seq int, full_name string, title string, email string, phone string, source_confidence double, small boolean")
    got = {r.company_id: (r.full_name, r.role, r.confidence) for r in CT.decision_makers(df).collect()}
    assert got == {1: ("C", "owner", 0.5), 2: ("E", "support_manager", 0.7), 4: ("F", "unknown", 0.54)}


def test_drafts(spark):
    df = spark.createDataFrame([("just checking in? ok?",), ("fine?",)], "t string")
    got = [r.i for r in df.select(CT.draft_issues(F.col("t"), ["just checking in"], 10).alias("i")).collect()]
    assert got == [["banned:just checking in", "too_long", "too_many_questions"], []]
    df = spark.sql("select array(named_struct('name', 'a', 'text', 'x', 'issues', array('z')), named_struct('name', 'b', 'text', 'y', 'issues', cast(array() as array<string>))) as v")
    assert df.select(CT.recommended(F.col("v"), "a").alias("r")).first().r.name == "b"


def test_terms_and_templates(spark):
    df = spark.createDataFrame([("k", ["{city} medspa", "medspa {state}", "{CITY} x", "{city} Medspa"], ["Los Angeles", "Irvine"], ["CA", "TX"])], "campaign_id string, templates array<string>, cities array<string>, states array<string>")
    got = [(r.query, r.location) for r in SR.search_terms(df).orderBy("i", "j").collect()]
    assert got == [("Los Angeles medspa", "Los Angeles, CA"), ("Irvine medspa", "Irvine, CA"), ("medspa CA", "CA"), ("medspa TX", "TX"), ("{CITY} x", "CA"), ("{CITY} x", "TX")]
    text, missing = SR.rendered("Hi {{name}}, {{list:items}} {{json:items}} {{note?}}.")
    df = spark.createDataFrame([("Jo", ["a", "b"], None), (None, None, "n")], "name string, items array<string>, note string").select(text.alias("t"), missing.alias("m"))
    a, b = df.collect()
    assert (a.t, a.m) == ('Hi Jo, - a\n- b ["a","b"] .', []) and b.m == ["name", "items", "items"]
