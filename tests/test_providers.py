import json

from leadspark.sources import providers as P


def leads(spark, provider, bodies):
    df = spark.createDataFrame([(b if isinstance(b, str) or b is None else json.dumps(b),) for b in bodies], "body string")
    good, bad = P.provider_leads(df, provider)
    return good.collect(), sorted((r.reason, r.raw) for r in bad.select("reason", "raw").fillna("-").collect())


def test_paths_gaps_and_unknown_fields(spark):
    rows = [
        {"name": "", "title": "Glow  Spa", "address": {"state": "calif.", "city": "los angeles"}, "emails": ["A@b.co"], "location": {"lat": "34.5", "lng": "x"}, "menu": "Botox, Filler; botox", "odd": {"deep": [1]}, "private": "false", "followers": "12.3k"},
        {"business_name": None, "username": "@glow.spa", "services": [{"title": "Peel"}, "Laser", {"label": "peel"}, 5, None], "zip": 90001, "isBusinessAccount": True},
        {"city": "nowhere"}, "[1]", "broken", None,
    ]
    good, bad = leads(spark, "import", rows)
    a, b = sorted(good, key=lambda r: r.business_name or "")[::-1]
    assert (a.business_name, a.state, a.city, a.email, a.latitude, a.longitude, a.products_services, a.products_count) == ("Glow Spa", "CA", "Los Angeles", "a@b.co", 34.5, None, ["Botox", "Filler"], 2)
    assert a.ig_is_private is False and a.ig_followers == 12300 and json.loads(a.raw)["odd"] == {"deep": [1]} and a.country == "US" and a.source == "import"
    assert (b.instagram_handle, b.products_services, b.postal_code, b.ig_is_business) == ("glow.spa", ["Peel", "Laser"], "90001", True)
    assert bad == [("neither a name nor a handle", '{"city":"nowhere"}'), ("not a JSON object", "-"), ("not a JSON object", "[1]"), ("not a JSON object", "broken")]


def test_providers_and_their_union(spark):
    maps = [{"title": "Glow", "name": "other", "fid": 7, "categoryName": "Spa", "categories": ["Spa", "Skin"], "socialProfiles": ["https://x.com/a", "https://www.instagram.com/glow/"]}, {"title": "Bright", "socialMedia": {"ig": "instagram.com/bright"}}]
    accounts = [{"fullName": None, "username": "solo", "somethingNew": 1}]
    frame = lambda xs: spark.createDataFrame([(json.dumps(x),) for x in xs], "body string")
    good, bad = P.discovered({"google_maps": frame(maps), "instagram_search": frame(accounts)})
    got = {r.business_name: (r.instagram_handle, r.place_id, r.category, r.products_services, r.source) for r in good.collect()}
    assert got == {"Glow": ("glow", "7", "Spa", ["Spa", "Skin"], "google_maps"), "Bright": ("bright", None, None, [], "google_maps"), "solo": ("solo", None, None, [], "instagram_search")}
    assert bad.count() == 0 and P.provider_leads(frame([]), "x")[0].count() == 0
