import random

from pyspark.sql import functions as F

from leadspark.operators import dedup as D
from leadspark.operators import identity as ID
from leadspark.operators import ordered_merge as OM
from leadspark.plans.lead_queries import _v1_rows, leads

from .ordered_pass import merge_by_verdict, merge_in_order, similarity

SCHEMA = "seq long, instagram_handle string, website_domain string, phone_e164 string, email string, name_normalized string, city string, state string, ig_followers long, products_services array<string>, products_count long"


def rows(n, seed):
    r = random.Random(seed)
    pick = lambda xs: r.choice([None, *xs])
    names = ["glow medspa", "glow medspa la", "bright skin", "one two three four five six seven", "two one three four five six seven", "one two three four five six seven x"]
    out = []
    for i in range(n):
        out.append((i, pick(["a", "b", "c", "d"]) if r.random() < 0.3 else None, pick(["x.com", "y.com"]) if r.random() < 0.3 else None, pick(["+1", "+2"]) if r.random() < 0.2 else None, None,
                    r.choice(names) if r.random() < 0.9 else None, pick(["LA", "SF"]), pick(["CA"]), pick([5, 9]), r.choice([[], ["Botox"], ["botox", "Filler"]]), None))
    return out


def same_as_ordered(spark, data, threshold=0.92):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    want = merge_in_order([dict(zip(names, x)) for x in data], threshold)
    got = OM.dedupe_batch(spark.createDataFrame(data, SCHEMA).repartition(5), threshold).collect()
    assert sorted((r.seq, r.duplicate_of, r.matched_on) for r in got) == sorted(((r["seq"], to, kind) for r, to, kind in want), key=lambda x: x[0])
    listed = lambda v: None if v is None else list(v)
    mine = {r.seq: tuple(listed(r[n]) if n == "products_services" else r[n] for n in names) for r in got if r.duplicate_of is None}
    assert mine == {r["seq"]: tuple(r[n] for n in names) for r, to, _ in want if to is None}
    return got


def test_equal_to_the_ordered_pass(spark):
    for seed in (1, 2, 3):
        same_as_ordered(spark, rows(60, seed))


def test_equal_on_a_thousand_inputs(spark):
    """Each input has values of its own, so that one run holds them all."""
    data = []
    for k in range(1000):
        for i, handle, site, phone, email, name, city, state, *rest in rows(9, 1000 + k):
            own = lambda v, k=k: v and f"{v}{k}"
            data.append((9 * k + i, own(handle), own(site), own(phone), email, name and f"n{k} {name}", own(city), state, *rest))
    got = same_as_ordered(spark, data)
    kinds = {r.matched_on for r in got}
    assert {"instagram_handle", "website_domain", "phone_e164", "name_city", None} <= kinds


def test_a_place_won_by_a_merge_is_compared(spark):
    """A survivor gets its city from a row that shares its handle, then a near name of 16 words meets it there."""
    long = "a1 a2 a3 a4 a5 a6 a7 a8 a9 b1 b2 b3 b4 b5 b6"
    row = lambda seq, handle, name, city, state: (seq, handle, None, None, None, name, city, state, None, [], None)
    data = [row(0, "h", f"{long} c1", None, None), row(1, "h", "else", "Austin", "TX"), row(2, None, f"{long} c2", "Austin", "TX"), row(3, "i", f"{long} c3", "Austin", "TX")]
    got = {r.seq: (r.duplicate_of, r.matched_on) for r in same_as_ordered(spark, data)}
    assert got == {0: (None, None), 1: (0, "instagram_handle"), 2: (0, "name_city"), 3: (None, None)}


def test_chains_and_ties(spark):
    """Each row shares a key with the one before: the first owns them one after the other."""
    data = []
    for i in range(40):
        data.append((i, f"h{i // 2}" if i % 4 < 2 else None, f"s{(i + 1) // 2}" if i % 4 in (1, 2) else None, f"+{i // 4}" if i % 4 > 1 else None, f"m{(i + 2) // 4}" if i % 4 in (2, 3, 0) and i % 8 else None, f"n {i}", None, None, i, [f"P{i % 3}", "p1"], None))
    same_as_ordered(spark, data)
    same_as_ordered(spark, [(i, None, None, None, None, None, None, None, None, None, None) for i in range(5)])


def test_blocks_hold_all_near_names(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    names = []
    for _ in range(60):
        base = r.sample(words, r.randint(1, 18))
        for _ in range(4):
            near = list(base)
            for _ in range(r.randint(0, 2)):
                near[r.randrange(len(near))] = r.choice(words)
            r.random() < 0.3 and r.shuffle(near)
            names.append(" ".join(near))
    names = sorted(set(names))
    for threshold in (0.92, 0.8):
        blocks = {x.name_normalized: set(x.blocks) for x in OM.name_blocks(spark.createDataFrame([(n,) for n in names], "name_normalized string"), threshold).collect()}
        pairs = [(a, b) for i, a in enumerate(names) for b in names[:i] if similarity(a, b) >= threshold]
        assert len(pairs) >= 10 and all(blocks[a] & blocks[b] for a, b in pairs)


def test_merged_rows_merge_no_more(spark):
    data = [x for x in rows(40, 3)]
    once = OM.dedupe_batch(spark.createDataFrame(data, SCHEMA)).where("duplicate_of is null").drop("duplicate_of", "matched_on")
    names = once.columns
    again = merge_in_order([{k: (list(v) if isinstance(v, list) else v) for k, v in zip(names, r)} for r in sorted(once.collect(), key=lambda r: r.seq)], 0.92)
    assert sum(to is not None for _, to, _ in again) <= 2  # a merged row may have won a new key


def test_compare_and_likely_same(spark):
    lead = "struct<domain:string,website:string,name_normalized:string,city:string,state:string,phone_e164:string,email:string,instagram_handle:string,website_domain:string,place_id:string>"
    base = dict(domain="a.com", website="https://a.com", name_normalized="glow", city="LA", state="CA", phone_e164="+1", email="m", instagram_handle="g", website_domain="a.com", place_id=None)
    other = lambda **k: {**base, **k}
    pairs = [
        (other(), other(), "website"), (other(), other(website="x"), "domain+name"), (other(), other(website="x", name_normalized="zzz"), "domain+city"),
        (other(), other(website="x", name_normalized="zzz", city="SF"), "domain"), (other(), other(domain=None), "company+city"), (other(), other(domain="b", city="SF"), "company+phone"),
        (other(), other(domain="b", city=None, name_normalized="zzz"), "phone"), (other(), other(domain="b", city=None, phone_e164=None), "company+email"), (other(), other(domain="b", city=None, phone_e164=None, email=None), None),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], f"a {lead}, b {lead}")
    assert [r.v.matched_on for r in df.select(D.compare("a", "b").alias("v")).collect()] == [m for _, _, m in pairs]
    more = [(other(), other(instagram_handle="h")), (other(), other(instagram_handle=None, website_domain="z")), (other(instagram_handle=None, website_domain=None, phone_e164=None, email=None), other(phone_e164=None, email=None))]
    df = spark.createDataFrame(more, f"a {lead}, b {lead}")
    got = [tuple(r.v) for r in df.select(ID.likely_same("a", "b").alias("v")).collect()]
    assert got == [(False, None, "instagram_handle"), (False, None, "website_domain"), (True, "name_city", None)]


def test_on_derived_leads(spark):
    rows = leads(spark, "/root/testdata/sf0.001").withColumnRenamed("id", "seq").withColumn("products_count", F.size("products_services").cast("long"))
    got = OM.dedupe_batch(rows)
    assert got.count() == rows.count() and got.where("duplicate_of is not null").count() > 0


def test_v1_components_change_nothing(spark):
    rows = _v1_rows(spark, "/root/testdata/sf0.001")
    names = rows.columns
    want = merge_by_verdict([r.asDict() for r in rows.orderBy("seq").collect()])
    got = D.dedupe_leads(rows.repartition(5)).collect()
    by_seq = lambda rows: sorted(rows, key=lambda r: r[0])
    assert by_seq([(r.seq, r.duplicate_of, r.matched_on) for r in got]) == by_seq([(r["seq"], to, on) for r, to, on in want])
    merged = lambda rows: by_seq([tuple(r[n] for n in names) for r in rows])
    assert merged(r for r in got if r.duplicate_of is None) == merged(r for r, to, _ in want if to is None)
    assert any(r.duplicate_of is not None for r in got)


def v1_rows(n, seed):
    r = random.Random(seed)
    maybe = lambda p, xs: r.choice(xs) if r.random() < p else r.choice([None, ""])
    names = ["glow medspa", "glow spa", "bright skin clinic of old town west", "bright skin clinic of old town wesx", "zed"]
    return [(i, maybe(0.6, ["a.com", "b.com"]), maybe(0.5, ["https://A.com/", "https://a.com", "https://b.com"]), maybe(0.8, names), maybe(0.7, ["LA", "la", "SF"]), maybe(0.8, ["CA", "ca", "TX"]),
             maybe(0.5, ["+1", "+2", "+3"]), maybe(0.5, ["m", "n"]), r.choice([None, 0.0, 4.5]), r.choice([None, 0, 7]), maybe(0.4, ["street"]), r.choice([None, [], ["x"]])) for i in range(n)]


V1_SCHEMA = "seq long, domain string, website string, name_normalized string, city string, state string, phone_e164 string, email string, rating double, review_count int, address string, tags array<string>"


def same_by_verdict(spark, data):
    names = [x.split()[0] for x in V1_SCHEMA.split(", ")]
    want = merge_by_verdict([dict(zip(names, x)) for x in data])
    got = D.dedupe_leads(spark.createDataFrame(data, V1_SCHEMA).repartition(5)).collect()
    key = lambda rows: sorted(rows, key=lambda x: x[0])
    assert key((r.seq, r.duplicate_of, r.matched_on) for r in got) == key((r["seq"], to, on) for r, to, on in want)
    value = lambda v, k: (tuple(v) if isinstance(v, list) else v if v != "" else None)
    rowed = lambda r: tuple(value(r[k], k) for k in names)
    assert key(rowed(r) for r in got) == key(rowed(r) for r, _, _ in want)
    return got


def test_v1_merge_equals_the_ordered_pass(spark):
    for seed in (1, 2):
        same_by_verdict(spark, v1_rows(70, seed))


def test_v1_places_of_one_domain(spark):
    """10,000 rows of one domain in some hundred cities, each led by a fuller row later on."""
    data = [(i, "a.com", None, None, f"city {i % 100}", "CA", None, "m" if i > 9000 else None, None, None, None, None) for i in range(10_000)]
    got = same_by_verdict(spark, data)
    assert sum(r.duplicate_of is None for r in got) == 100 and {r.duplicate_of for r in got if r.duplicate_of} == set(range(9001, 9101))


def test_v1_merge(spark):
    row = lambda seq, **k: dict(dict.fromkeys(V1), seq=seq, **k)
    data = [
        row(1, domain="a.com", website="https://a.com", name_normalized="glow", city="LA", state="CA"),
        row(2, domain="a.com", website="https://a.com/", name_normalized="glow", city="LA", state="CA", email="m@a.com", phone_e164="+1"),  # fuller: survives
        row(3, domain="a.com", name_normalized="bright", city="SF", state="CA"),  # another place of one site
        row(4, name_normalized="Zed", phone_e164="+9"),
        row(5, name_normalized="other", phone_e164="+9"),  # a switchboard
        row(6, name_normalized="glow", city="la", state="ca"),
        row(7),
    ]
    schema = "seq long, domain string, website string, name_normalized string, city string, state string, phone_e164 string, email string"
    df = D.dedupe_leads(spark.createDataFrame([tuple(r[k] for k in ["seq", *V1]) for r in data], schema))
    got = {r.seq: (r.duplicate_of, r.matched_on) for r in df.collect()}
    assert got == {1: (2, "website"), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None), 6: (2, "company+city"), 7: (None, None)}
    links = D.related_locations(df.where("duplicate_of is null")).collect()
    assert sorted((r.seq, r["first"], r.matched_on, r.members) for r in links) == [(3, 2, "domain", 2), (5, 4, "phone", 2)]
    assert D.dedupe_leads(df.limit(0).drop("duplicate_of", "matched_on")).count() == 0


V1 = "domain website name_normalized city state phone_e164 email".split()
