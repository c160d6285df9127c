import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leadspark.config import rules as R
from leadspark.operators import cleaning as CL
from leadspark.operators import niches as N

TEXT = st.text(alphabet="ab1 -.#é|", max_size=14)
TERM = st.text(alphabet="ab1 -.#é", max_size=5)


def held(text, term):
    term = term.strip(" ").lower()
    return bool(term) and re.search(rf"(^|[^a-z0-9]){re.escape(term)}([^a-z0-9]|$)", text.lower()) is not None


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXT, min_size=20, max_size=40), st.lists(TERM, min_size=1, max_size=30))
def test_terms_are_those_of_one_pattern_each(spark, texts, words):
    rows = spark.createDataFrame([(i, "n" if i % 5 else None, t.lower()) for i, t in enumerate(texts)], "id long, niche string, text string")
    terms = spark.createDataFrame([("n", "keywords", i, t) for i, t in enumerate(words)], "niche string, kind string, at int, term string")
    got = sorted((r.id, r.at) for r in N.match_terms(rows, terms).collect())
    assert got == sorted((i, k) for i, t in enumerate(texts) for k, w in enumerate(words) if i % 5 and held(t, w))


def test_edges_of_terms(spark):
    rows = spark.createDataFrame([(1, "n", "c++ code"), (2, "n", "xc++"), (3, "n", "c code"), (4, "n", "a \\e.b"), (5, "n", "!!"), (6, "n", None), (7, None, "c++"), (8, "n", "")], "id long, niche string, text string")
    terms = spark.createDataFrame([("n", "keywords", 0, "C++ "), ("n", "keywords", 1, "!!"), ("n", "negative", 2, "\\E.b"), ("n", "keywords", 3, None), ("n", "keywords", 4, "  ")], "niche string, kind string, at int, term string")
    assert sorted((r.id, r.kind, r.term) for r in N.match_terms(rows, terms).collect()) == [(1, "keywords", "c++"), (4, "negative", "\\e.b"), (5, "keywords", "!!")]
    assert N.match_terms(rows, terms.limit(0)).count() == 0


def test_categories_and_order(spark):
    rows = [(1, "fashion_brands", "streetwear, a boutique and fashion brand", None), (2, "fashion_brands", "nothing", "BOUTIQUES of Rome"), (3, "fashion_brands", "boutique styling course", "Boutiques"), (4, "other", "boutique", "boutique"), (5, "tech_products", "best it services provider", None)]
    got = {r.id: (r.niche_hits, r.niche_negatives) for r in N.match_niches(spark.createDataFrame(rows, "id long, niche string, text string, category string"), N.term_table(spark, R.NICHES)).collect()}
    assert got == {1: (["fashion brand", "streetwear", "boutique"], []), 2: (["boutiques of rome"], []), 3: (["boutique"], ["styling course"]), 4: ([], []), 5: ([], ["it services provider"])}


def test_terms_of_a_file(spark, tmp_path):
    (tmp_path / "niches.json").write_text(json.dumps({"version": 1, "niches": [{"id": k, "keywords": r["keywords"], "negative_keywords": r["negative"]} for k, r in R.NICHES.items()]}))
    read = N.read_terms(spark, str(tmp_path / "niches.json"))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, N.term_table(spark, R.NICHES).collect()))
    assert len(R.NICHES) == 15


def test_flags(spark):
    schema = "id long, business_name string, bio string, category string, website_description string, products_services array<string>, website_domain string, instagram_handle string, niche string, ig_followers long, ig_following long, ig_posts int, city string, state string"
    row = lambda i, niche, followers, following, city: (i, "Glow", "botox", "x", None, ["a"], "g.com", "g", niche, followers, following, 10, city, "CA")
    got = {r.id: r for r in CL.clean_leads(spark.createDataFrame([row(1, "medspas", 1000, 3001, "los angeles"), row(2, None, 1000, 3000, "Fresno"), row(3, "lingerie", 0, 5, None), row(4, "medspas", None, 5, None)], schema)).collect()}
    assert [got[i].follow_ratio_suspicious for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert [got[i].city_outside_list for i in (1, 2, 3, 4)] == [False, True, False, False]
    assert got[1].keep and got[2].keep and got[3].reasons == ["below_absolute_min_followers", "outside_target_niche"]
