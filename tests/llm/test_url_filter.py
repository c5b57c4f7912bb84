import datetime as dt

from loamstack.llm import url_filter as U

D = dt.date
ENTRIES = [
    ("ads", "track.example.com", "add", D(2024, 1, 10)),
    ("ads", "track.example.com", "remove", D(2024, 2, 10)),
    ("ads", "track.example.com", "add", D(2024, 3, 10)),
    ("spam", "example.com", "add", D(2024, 1, 15)),
    ("spam", "example.com/Deep/", "add", D(2024, 1, 1)),
    ("spam", "other.org", "add", D(2024, 1, 1)),
    ("spam", "other.org", "remove", D(2024, 1, 1)),
    ("mixed", "Other.ORG.", "add", D(2024, 1, 5)),
    ("mixed", "other.org", "remove", D(2024, 2, 1)),
    ("mixed", "OTHER.org", "remove", D(2024, 2, 1)),
    ("mixed", "example.com/Dee", "add", D(2024, 1, 2)),
    ("mixed", "EXAMPLE.com/Dee", "add", D(2024, 1, 2)),
    ("odd", None, "add", D(2024, 1, 1)),
    ("odd", "example.com", "add", None),
    ("odd", "example.com", "touch", D(2024, 1, 1)),
]
CAPTURES = [(i, u, d) for i, (u, d) in enumerate((u, d) for u in ["https://A.track.EXAMPLE.com:80/x?y#z", "http://track.example.com", "http://u@example.com./Deep/a", "http://notexample.com/Deep/", "http://other.org/", None, "", "no url", "http:///x"] for d in [D(2024, 1, 1), D(2024, 1, 10), D(2024, 2, 9), D(2024, 2, 10), D(2025, 1, 1), None])]


def host(u):
    if not u or "://" not in u:
        return ""
    return u.split("://")[1].split("/")[0].split("?")[0].split("@")[-1].split(":")[0].lower().rstrip(".")


def normal(pattern):
    domain, slash, rest = pattern.partition("/")
    return domain.lower().removesuffix("."), slash + rest


def brute(entries, url, day):
    h, path = host(url), "/" + url.split("://")[1].partition("/")[2].split("?")[0] if url and "://" in url and "/" in url.split("://")[1] else ""
    known = {(n, *normal(p), a, d) for n, p, a, d in entries if p and d and a in ("add", "remove")}
    active = []
    for name, domain, prefix, action, start in known:
        if action != "add" or not day or not h:
            continue
        later = sorted((d, a) for n, x, y, a, d in known if (n, x, y) == (name, domain, prefix) and (d, a) > (start, action))
        if start <= day and (not later or day < later[0][0]) and (h == domain or h.endswith("." + domain)) and path.startswith(prefix):
            active.append((name, start))
    return (h, len(active), ",".join(sorted({n for n, _ in active})), max((s for _, s in active), default=None), bool(active))


def test_against_brute_force(spark):
    entries = spark.createDataFrame(ENTRIES, "list_name string, pattern string, action string, effective_on date")
    captures = spark.createDataFrame([(i, u, d, "clash") for i, u, d in CAPTURES + CAPTURES[:2]], "page_id long, url string, fetched_on date, host string").selectExpr("*", "'x' AS path", "'y' AS domain", "1 AS met", "2 AS keys")
    got = [(r.page_id, r.host, r.n_active, r.lists, r.since, r.blocked) for r in U.judge(captures, entries).collect()]
    assert sorted(got, key=str) == sorted(((i, *brute(ENTRIES, u, d)) for i, u, d in CAPTURES + CAPTURES[:2]), key=str)


def test_empty_tables(spark):
    entries = spark.createDataFrame([], "list_name string, pattern string, action string, effective_on date")
    captures = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_on date")
    assert U.judge(captures, entries).where("blocked").count() == 0
    assert U.judge(captures.limit(0), entries).count() == 0


def test_one_host_with_many_entries_and_captures(spark):
    entries = spark.range(100_000).selectExpr("'many' AS list_name", "'Hot.example.net/p' || id || '/' AS pattern", "'add' AS action", "DATE '2024-01-01' + CAST(id % 300 AS INT) AS effective_on")
    captures = spark.range(3000).selectExpr("id AS page_id", "'http://www.hot.example.net/p' || (id * 37) || '/page' || repeat('x', CAST(id % 9 AS INT)) AS url", "DATE '2024-06-01' AS fetched_on")
    got = {r.page_id: (r.n_active, r.since) for r in U.judge(captures, entries).collect()}
    start = lambda i: D(2024, 1, 1) + dt.timedelta(days=i % 300)
    want = {i: (1, start(i * 37)) if i * 37 < 100_000 and start(i * 37) <= D(2024, 6, 1) else (0, None) for i in range(3000)}
    assert got == want


def test_very_long_url(spark):
    entries = spark.createDataFrame([("a", "example.com/x", "add", D(2024, 1, 1))], "list_name string, pattern string, action string, effective_on date")
    captures = spark.createDataFrame([(1, "http://example.com/" + "x" * 300_000, D(2024, 2, 1)), (2, "http://example.com/", D(2024, 2, 1))], "page_id long, url string, fetched_on date")
    assert {r.page_id: r.blocked for r in U.judge(captures, entries).collect()} == {1: True, 2: False}
