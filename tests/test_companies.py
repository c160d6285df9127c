import random

from leadspark.operators import companies as CO
from leadspark.operators import identity as ID

SCHEMA = "seq long, instagram_handle string, website_domain string, phone_e164 string, email string, name_normalized string, city string, state string, bio string, products_services array<string>, products_count int, ig_followers int"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def in_order(rows, companies, keys):
    """One row at a time."""
    companies, keys = {k: dict(v) for k, v in companies.items()}, dict(keys)
    into, new = {}, {}
    for row in rows:
        r = dict(row)
        for k in ("instagram_handle", "website_domain", "email"):
            r[k] = r[k].lower() if r[k] else r[k]
        r["state"] = r["state"].upper() if r["state"] else r["state"]
        mine = [(k, r.get(k)) for k in ID.PRIORITY[:-1]]
        if r["name_normalized"] is not None:
            mine.append(("name_city", f"{r['name_normalized']}|{(r['city'] or '').lower()}|{r['state'] or ''}"))
        mine = [(k, v) for k, v in mine if v not in (None, "")]
        to = next((keys[k] for k in mine if k in keys), None)
        if to is None:
            filed = [(ID.PRIORITY.index(k), i) for i, x in companies.items() for k in CO.COLUMNS if r[k] not in (None, "") and x[k] == r[k]]
            to = min(filed)[1] if filed else None
        if to is None:
            to = max(companies, default=0) + 1
            companies[to] = {k: v for k, v in r.items() if k != "seq"}
        else:
            x = companies[to]
            for k in CO.GAPS:
                if k in x and x[k] is None:
                    x[k] = r[k]
            for k in CO.NEWEST:
                if k in x and r[k] is not None:
                    x[k] = r[k]
            if len(r["products_services"] or []) > len(x["products_services"] or []):
                x["products_services"] = r["products_services"]
            x["products_count"] = max(x["products_count"] or 0, r["products_count"] or 0)
        into[r["seq"]] = to
        for k in mine:
            if k not in keys:
                keys[k] = new[k] = to
    return into, companies, new


def some(n, seed):
    r = random.Random(seed)
    maybe = lambda p, xs: r.choice(xs) if r.random() < p else None
    return [(i, maybe(0.3, ["A", "b", "c", ""]), maybe(0.3, ["x.com", "Y.com", "z.com"]), maybe(0.3, ["+1", "+2", "+3", "+4"]), maybe(0.3, ["m", "N"]), maybe(0.8, [f"name {k}" for k in range(n)]),
             maybe(0.5, ["LA"]), maybe(0.5, ["ca", "TX"]), maybe(0.5, ["p", "q"]), maybe(0.7, [[], ["a"], ["b", "c"], ["d", "e"]]), maybe(0.5, [0, 3, 8]), maybe(0.5, [10, 20])) for i in range(n)]


def check(spark, data, companies, keys):
    into, want, new = in_order([dict(zip(NAMES, x)) for x in data], companies, keys)
    old = spark.createDataFrame([(k, *(v[n] for n in NAMES[1:])) for k, v in companies.items()], "company_id long, " + SCHEMA.split(", ", 1)[1])
    known = spark.createDataFrame([(*k, v) for k, v in keys.items()], "key_type string, key_value string, company_id long")
    a, b, k = CO.resolve(spark.createDataFrame(data, SCHEMA).repartition(5), old, known)
    assert {r.seq: r.company_id for r in a.collect()} == into
    assert {r.company_id: tuple(r[n] for n in NAMES[1:]) for r in b.collect()} == {i: tuple(x[n] for n in NAMES[1:]) for i, x in want.items()}
    assert {(r.key_type, r.key_value): r.company_id for r in k.collect()} == new


def test_equal_to_one_row_at_a_time(spark):
    blank = dict.fromkeys(NAMES[1:])
    old = {5: blank | {"website_domain": "x.com", "products_services": ["k"]}, 7: blank | {"instagram_handle": "a", "bio": "old"}}
    check(spark, some(60, 1), old, {("phone_e164", "+1"): 7, ("email", "m"): 5})
    check(spark, some(60, 2), {}, {})


def test_chains_and_nothing(spark):
    """Each row is known by a key of the row before alone; no rows, no companies."""
    chain = [(i, f"h{i}", None, f"+{i // 2}", f"e{(i + 1) // 2}", None, None, None, None, None, None, None) for i in range(200)]
    check(spark, chain, {}, {})
    check(spark, [], {}, {})
