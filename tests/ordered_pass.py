"""The sequential merge of D3 and D4 in plain Python, which the distributed one must equal."""

from bisect import insort
from functools import lru_cache

from leadspark.operators import identity as ID
from leadspark.operators.dedup import FULL
from leadspark.operators.ordered_merge import COUNTS


def _keys(row: dict) -> list[tuple[str, str]]:
    out = [(k, str(row[k])) for k in ID.PRIORITY[:-1] if not _blank(row.get(k))]
    if not _blank(row.get("name_normalized")):
        place = [row.get(k) if not _blank(row.get(k)) else "" for k in ("city", "state")]
        out.append(("name_city", f"{row['name_normalized']}|{place[0].lower()}|{place[1].upper()}"))
    return out


def fill(base: dict, more: dict) -> dict:
    """Gaps filled, lists joined in order without repeats in any case, counts at their largest."""
    out = dict(base)
    for k, v in more.items():
        if isinstance(v, list) and not _blank(out.get(k)):
            have = list(out.get(k) or [])
            low = {str(x).lower() for x in have}
            for x in v:
                if str(x).lower() not in low:
                    low.add(str(x).lower())
                    have.append(x)
            out[k] = have
        elif _blank(v):
            continue
        elif _blank(out.get(k)):
            out[k] = v
        elif k in COUNTS:
            out[k] = max(out[k], v)
    if "products_count" in out:
        out["products_count"] = len(out.get("products_services") or []) or out["products_count"] or None
    return out


def _place(row: dict) -> tuple[str, str]:
    return (row.get("city") or "").lower(), (row.get("state") or "").upper()


def _near(a: dict, b: dict, threshold: float) -> bool:
    for k in ("instagram_handle", "website_domain"):
        if not _blank(a.get(k)) and not _blank(b.get(k)) and a[k] != b[k]:
            return False
    if any(_blank(a.get(k)) or _blank(b.get(k)) for k in ("city", "state")):
        return False
    same = a["city"].lower() == b["city"].lower() and a["state"].upper() == b["state"].upper()
    return same and similarity(a.get("name_normalized"), b.get("name_normalized")) >= threshold


def merge_in_order(rows: list[dict], threshold: float) -> list[tuple[dict, int | None, str | None]]:
    """(row, seq of the survivor it went into, key kind) of each row; survivors come merged."""
    kept: list[dict] = []
    owner: dict[tuple[str, str], int] = {}
    there: dict[tuple[str, str], list[int]] = {}
    gone = []
    for row in rows:
        keys = _keys(row)
        to, kind = next(((owner[k], k[0]) for k in keys if k in owner), (None, None))
        if to is None:
            to = next((i for i in there.get(_place(row), ()) if _near(kept[i], row, threshold)), None)
            kind = "name_city"
        if to is None:
            kept.append(dict(row))
            to = len(kept) - 1
            there.setdefault(_place(row), []).append(to)
            for k in keys:
                owner[k] = to
        else:
            gone.append((row, kept[to]["seq"], kind))
            was = _place(kept[to])
            kept[to] = fill(kept[to], {k: v for k, v in row.items() if k != "seq"})
            if _place(kept[to]) != was:
                insort(there.setdefault(_place(kept[to]), []), to)
            for k in _keys(kept[to]):
                owner.setdefault(k, to)
    return [(r, None, None) for r in kept] + gone


@lru_cache(100_000)
def _edit(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def similarity(a: str | None, b: str | None) -> float:
    """As scalars.name_similarity, for one pair of name keys."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = set(a.split(" ")), set(b.split(" "))
    return 0.5 * (1 - _edit(a, b) / max(len(a), len(b))) + 0.5 * len(x & y) / len(x | y)


def _blank(v) -> bool:
    return v is None or (isinstance(v, float) and v != v) or (isinstance(v, str) and v == "")


def verdict(a: dict, b: dict) -> tuple[str, str | None]:
    """As compare, for two rows in a worker."""
    same = lambda k: not _blank(a.get(k)) and a[k] == b.get(k)
    low = lambda r, k: (r.get(k) or "").lower()
    name = same("name_normalized") or similarity(a.get("name_normalized"), b.get("name_normalized")) >= 0.90
    city = low(a, "city") != "" and low(a, "city") == low(b, "city") and low(a, "state") == low(b, "state")
    site = low(a, "website") != "" and low(a, "website").rstrip("/") == low(b, "website").rstrip("/")
    rules = [
        (same("domain") and site and (name or city), "duplicate", "website"),
        (same("domain") and name, "duplicate", "domain+name"),
        (same("domain") and city, "duplicate", "domain+city"),
        (same("domain"), "related_location", "domain"),
        (name and city, "duplicate", "company+city"),
        (name and same("phone_e164"), "duplicate", "company+phone"),
        (same("phone_e164"), "related_location", "phone"),
        (name and same("email"), "duplicate", "company+email"),
    ]
    return next(((v, on) for holds, v, on in rules if holds), ("distinct", None))


def merge_by_verdict(rows: list[dict]) -> list[tuple[dict, int | None, str | None]]:
    """The V1 pass: a row joins the first kept row of its domain, its name and city, or its phone that
    it is a duplicate of; the fuller of the two survives, and the other fills its gaps."""
    kept: list[dict] = []
    blocks: dict[tuple[str, str], list[int]] = {}
    members: list[list[tuple[dict, str]]] = []
    for row in rows:
        keys = [(k, row[k]) for k in ("domain", "name_city", "phone_e164") if not _blank(row.get(k))]
        if not _blank(row.get("name_normalized")) and not _blank(row.get("city")):
            keys.insert(len([k for k, _ in keys if k == "domain"]), ("name_city", f"{row['name_normalized']}|{row['city'].lower()}"))
        near = dict.fromkeys(i for k in keys for i in blocks.get(k, ()))
        to, on = next(((i, on) for i in near for v, on in [verdict(kept[i], row)] if v == "duplicate"), (None, None))
        if to is None:
            kept.append(dict(row))
            members.append([])
            for k in keys:
                blocks.setdefault(k, []).append(len(kept) - 1)
            continue
        full = lambda r: sum(not _blank(r.get(k)) and r[k] != 0 for k in FULL)
        best, other = (dict(row), kept[to]) if full(row) > full(kept[to]) else (kept[to], row)
        members[to].append((other, on))
        kept[to] = {k: other.get(k) if _blank(v) and not isinstance(v, list) else v for k, v in best.items()}
    return [(r, None, None) for r in kept] + [(r, kept[i]["seq"], on) for i, m in enumerate(members) for r, on in m]
