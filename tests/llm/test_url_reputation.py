import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vecspark.llm import url_reputation as U

SCHEMA = "page_id long, url string, outcome int, host string, mean string"


@pytest.mark.parametrize(
    ("url", "host", "domain", "suffix"),
    [
        ("https://Blog.Shop.example.CO.UK:8080/x?y#z", "blog.shop.example.co.uk", "example.co.uk", "co.uk"),
        ("http://user:pw@www.example.com./a", "www.example.com", "example.com", "com"),
        ("http://co.uk/", "co.uk", "co.uk", "co.uk"),
        ("ftp://10.0.0.1/a", "10.0.0.1", "10.0.0.1", "10.0.0.1"),
        ("http://localhost", "localhost", "localhost", "localhost"),
        ("no url", None, None, None),
        ("http:///path", None, None, None),
        ("http://[2001:DB8::1]/x", "[2001:db8::1]", "[2001:db8::1]", "[2001:db8::1]"),
        ("http://u@[2001:ffff::9]:80/y", "[2001:ffff::9]", "[2001:ffff::9]", "[2001:ffff::9]"),
        ("//a.example.com/p", "a.example.com", "example.com", "com"),
        ("mailto:a@b.com", None, None, None),
    ],
)
def test_hosts(spark, url, host, domain, suffix):
    df = spark.createDataFrame([(url,)], "u string").select(U.host_of(F.col("u")).alias("h"))
    r = df.select("h", U.suffix_of(F.col("h")).alias("s")).select("h", U.domain_of(F.col("h"), F.col("s")).alias("d"), "s").first()
    assert tuple(r) == (host, domain, suffix)


@pytest.mark.parametrize(
    ("host", "suffix"),
    [("a.b.github.io", "github.io"), ("github.io", "github.io"), ("x.y.ck", "y.ck"), ("z.x.y.ck", "y.ck"), ("ck", "ck"), ("a.www.ck", "ck"), ("www.ck", "ck"), ("q.s3.dual.example.net", "s3.dual.example.net"), ("a.co.uk", "uk")],
)
def test_given_suffixes(spark, host, suffix):
    rules = U.read_suffixes(["// a list", "github.io", "*.ck  // all", "!www.ck", "", "s3.dual.example.net"])
    assert spark.createDataFrame([(host,)], "h string").select(U.suffix_of(F.col("h"), rules)).first()[0] == suffix


def test_suffixes_part_domains(spark):
    rows = [(i, f"http://{h}.github.io/", o) for i, (h, o) in enumerate([("a", 1)] * 5 + [("b", 0)] * 5)]
    said = U.url_reputation(spark.createDataFrame(rows, "page_id long, url string, outcome int"), suffixes=("github.io",)).collect()
    assert {r.domain for r in said} == {"a.github.io", "b.github.io"}


def prior(members):
    seen = [(n, g) for n, g in members if n]
    t, g, k = sum(n for n, _ in seen), sum(g for _, g in seen), len(seen)
    if not t:
        return 0.5, U.STRENGTHS[1]
    mu = g / t
    room = mu * (1 - mu) * (t - sum(n * n for n, _ in seen) / t - (k - 1))
    if room <= 1e-9:
        return mu, U.STRENGTHS[1]
    phi = (sum(n * (x / n - mu) ** 2 for n, x in seen) - mu * (1 - mu) * (k - 1)) / room
    return mu, min(U.STRENGTHS[1], max(U.STRENGTHS[0], 1 / phi - 1)) if phi > 1e-9 else U.STRENGTHS[1]


def test_matches_direct_computation(spark):
    rows = []
    for h in range(30):
        for i in range(h % 7 + 1):
            rows.append((len(rows), f"https://h{h}.d{h % 5}.{'com' if h % 2 else 'org'}/p/{i}", None if i % 3 == 2 else int((h * 7 + i * 3) % 5 < 1 + h % 5)))
    rows += [(None, None, 1), (900, "nonsense", None), (3, *rows[3][1:]), (901, "http://new.d1.com/" + "x" * 100_000, None)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = {(r.page_id, r.host): r for r in U.url_reputation(df).collect()}
    count = [defaultdict(lambda: [0, 0]) for _ in range(3)]
    parents = {}
    for _, url, o in rows:
        if url and "://" in url:
            host = url.split("/")[2]
            keys = (host, host.split(".", 1)[1], host.rsplit(".", 1)[1])
            parents[host] = keys
            for c, k in zip(count, keys, strict=True):
                c[k][0] += o is not None
                c[k][1] += o or 0
    (mu, ms), (_, md), (_, mh) = (prior(c.values()) for c in reversed(count))
    for host, (h, d, s) in parents.items():
        up = (count[2][s][1] + ms * mu) / (count[2][s][0] + ms)
        up = (count[1][d][1] + md * up) / (count[1][d][0] + md)
        a, b = count[0][h][1] + mh * up, count[0][h][0] - count[0][h][1] + mh * (1 - up)
        low = max(0, a / (a + b) - U.Z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))))
        for r in (x for (_, y), x in got.items() if y == host):
            assert math.isclose(r["mean"], a / (a + b), rel_tol=1e-9) and math.isclose(r.lower, low, rel_tol=1e-9, abs_tol=1e-12) and r.keep == (low >= U.THRESHOLD)
    assert got[None, None].keep and got[900, None].keep and got[None, None]["mean"] is None
    assert U.url_reputation(df).count() == len(rows)


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.b.com/", None, "x", "x")], SCHEMA)
    r = U.url_reputation(df).first()
    assert (r["mean"], r.n_labelled) == (0.5, 0)
    assert U.url_reputation(df.limit(0)).count() == 0
