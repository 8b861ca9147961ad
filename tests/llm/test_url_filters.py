"""Temporal list joins against a plain version: many entries on one key, all in one hour or over years, ties and odd rows."""

import random

import pytest

from siteflow.llm import url_filters

E = "list string, key string, action string, effective_at long"
C = "page_id long, url string, fetched_at long"


def brute(captures, entries):
    """page_id -> (flags, since), by going through a list's sorted moments."""
    moments = {}
    for name, key, action, at in entries:
        if key and at is not None:
            m = moments.setdefault((name, key), {})
            m[at] = m.get(at, False) or action == "add"
    out = []
    for page, keys, t in captures:
        starts = {}
        for name, key in keys.items():
            on = None
            for at, listed in sorted(moments.get((name, key), {}).items()):
                if t is None or at > t:
                    break
                on = (on if on is not None else at) if listed else None
            starts[name] = on
        found = [x for x in starts.values() if x is not None]
        out.append((page, *[starts[n] is not None for n in url_filters.LISTS], bool(found), min(found, default=None)))
    return sorted(out, key=str)


def got(spark, captures, entries):
    rows = url_filters.blocked(spark.createDataFrame(captures, C), spark.createDataFrame(entries, E)).collect()
    return sorted(((r["page_id"], r["host_listed"], r["site_listed"], r["prefix_listed"], r["blocked"], r["since"]) for r in rows), key=str)


def keyed(captures):
    out = []
    for page, url, t in captures:
        host = url.split("//")[1].split("/")[0] if url else ""
        parts = url.split("//")[1].split("/") if url else []
        first = parts[1] if len(parts) > 2 or len(parts) == 2 and parts[1] else ""
        out.append((page, {"host": host, "site": ".".join(host.split(".")[-2:]) if host else "", "prefix": f"{host}/{first}" if first else ""}, t))
    return out


@pytest.mark.parametrize("span", [3000, 90_000, 50_000_000])
def test_as_of(spark, span):
    draw = random.Random(span)
    hosts = ["a.hot.com", "b.hot.com", "c.cold.org"]
    entries = []
    for _ in range(400):
        host = draw.choice(hosts[:2] * 4 + hosts)
        key = draw.choice([("host", host), ("site", ".".join(host.split(".")[1:])), ("prefix", f"{host}/{draw.randint(0, 3)}")])
        entries.append((*key, draw.choice(["add", "remove"]), draw.randint(-span, span)))
    entries += [("host", "", "add", 0), ("host", None, "add", 0), ("site", "hot.com", "add", None)]
    captures = [(k, f"http://{draw.choice(hosts)}/{draw.randint(0, 3)}/x", draw.randint(-span, 2 * span)) for k in range(500)]
    captures += [(900, "http://a.hot.com/1/x", at) for _, _, _, at in entries if at is not None][:50] + [(901, None, 5), (902, "http://a.hot.com/1/x", None)]
    assert got(spark, captures, entries) == brute(keyed(captures), entries)


def test_very_many_entries_on_one_key(spark):
    """A hundred thousand moments of one host over years: no row holds more than an hour's."""
    n, step = 100_000, 977
    entries = [("host", "hot.example.com", "add" if k % 3 else "remove", k * step) for k in range(n)]
    captures = [(k, "http://hot.example.com/p", (k * 7919 * 13) % (n * step + 5000)) for k in range(3000)]

    def state(t):
        k = min(t // step, n - 1)
        return None if k % 3 == 0 else (k // 3 * 3 + 1) * step

    want = sorted(((k, state(t) is not None, False, False, state(t) is not None, state(t)) for k, _, t in captures), key=str)
    assert got(spark, captures, entries) == want
    changed = url_filters.changes(spark.createDataFrame(entries, E))
    most = url_filters.states(changed, changed.select("key", "hour").limit(0)).selectExpr("max(size(moments)) AS n").first()["n"]
    assert most <= url_filters.HOUR / step + 1


def test_sites(spark):
    urls = {"http://www.example.co.uk/x": "example.co.uk", "http://a.b.example.com": "example.com", "http://example.org/": "example.org", "http://10.1.2.3/": "", "http://localhost/": "", "http://co.uk/": "co.uk"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    keys = url_filters.keys_of(df["url"])
    assert {r[0]: r[1] for r in df.select("url", keys["site"]).collect()} == urls
