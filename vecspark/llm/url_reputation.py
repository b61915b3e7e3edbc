"""Operator 10: URL filters by empirical-Bayes host reputation.

Labelled pages give good and bad counts of hosts, of their registered domains and of public suffixes.
At each level the counts of its members follow a beta-binomial law, whose strength (prior pseudo-counts)
is estimated by moments from all members. A suffix is shrunk to the overall rate, a domain to its
suffix, a host to its domain. A page stays where the lower bound of its host's posterior good rate,
mean less ``Z`` standard deviations, reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.plans.session import cut, prepare, release, small_or_hashed

THRESHOLD = 0.5
Z = 1.645
#: Limits of a level's prior pseudo-counts.
STRENGTHS = (1.0, 10_000.0)
#: Public suffixes of several labels that are known without a list; other hosts end in a suffix of one.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "edu.au", "co.jp", "ne.jp", "or.jp", "ac.jp", "com.br", "org.br", "co.in", "co.nz", "co.za", "com.cn", "com.mx", "com.tr", "com.ar", "co.kr")
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:@]+)"
ADDRESS = r"^[0-9.]+$|^\["


def host_of(url: Column) -> Column:
    """The host in lower case without dots at its end; null where the URL has none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def read_suffixes(lines: Iterable[str]) -> tuple[str, ...]:
    """The rules of a public suffix list, one in a line: a suffix, ``*.`` and a suffix, or ``!`` and an exception."""
    rules = (line.split("//")[0].split() for line in lines)
    return tuple(dict.fromkeys(r[0].lower().strip(".") for r in rules if r))


def suffix_of(host: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    """The public suffix, the longest that a rule gives; without a rule the last label; of an address the address itself."""
    rules = set(suffixes)
    exceptions, wild = {r[1:] for r in rules if r[0] == "!"}, {r[2:] for r in rules if r[:2] == "*."}
    plain = {r for r in rules if r[0] not in "!*"}
    labels = max([1, *(r.count(".") + 1 for r in plain | exceptions), *(r.count(".") + 2 for r in wild)])
    last = lambda k: F.substring_index(host, ".", -k)
    out = F.when(host.rlike(ADDRESS), host)
    of = lambda names, k: [n for n in names if n.count(".") == k - 1]
    for k in range(labels, 1, -1):
        if own := of(exceptions, k):
            out = out.when(last(k).isin(*own), last(k - 1))
    for k in range(labels, 1, -1):
        if own := of(plain, k):
            out = out.when(last(k).isin(*own), last(k))
        if own := of(wild, k - 1):
            out = out.when(last(k - 1).isin(*own) & (last(k) != last(k - 1)), last(k))
    return out.otherwise(last(1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label more; the host itself where there is none."""
    rest = host.substr(F.lit(1), F.length(host) - F.length(suffix) - 1)
    return F.when(F.length(host) > F.length(suffix) + 1, F.concat(F.regexp_extract(rest, r"([^.]+)$", 1), F.lit("."), suffix)).otherwise(host)


def strength(level: DataFrame) -> Column:
    """One row: the overall rate ``mu`` and the prior pseudo-counts ``m`` of a level with columns ``n`` and ``good``."""
    seen = level.where("n > 0")
    s = seen.agg(F.sum("n").cast("double").alias("t"), F.sum("good").cast("double").alias("g"), F.sum(F.col("n").cast("double") * F.col("n")).alias("t2"), F.sum(F.col("good").cast("double") * F.col("good") / F.col("n")).alias("q"), F.count("*").alias("k"))
    mu = F.when(F.col("t") > 0, F.col("g") / F.col("t")).otherwise(F.lit(0.5))
    spread = F.col("q") - F.col("g") * F.col("g") / F.col("t") - mu * (1 - mu) * (F.col("k") - 1)
    room = mu * (1 - mu) * (F.col("t") - F.col("t2") / F.col("t") - (F.col("k") - 1))
    low, high = map(F.lit, STRENGTHS)
    phi = F.when((F.col("t") > 0) & (room > 1e-9), spread / room)
    m = F.when(phi > 1e-9, F.least(high, F.greatest(low, 1 / phi - 1))).otherwise(high)
    return s.select(mu.alias("mu"), m.alias("m"))


def host_table(keyed: DataFrame, rules: Iterable[str] = SUFFIXES) -> DataFrame:
    """Rows (``host``, ``domain``, ``suffix``, ``n``, ``good``, ``mean``, ``lower``) from pages with ``host`` and
    ``outcome``, written to the shared folder."""
    hosts = keyed.where("host is not null").groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("long").alias("good"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), rules)).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    hosts = cut(hosts, "hosts")
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "domains")
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "suffixes")
    (mu, ms), (_, md), (_, mh) = (tuple(strength(x).first()) for x in (suffixes, domains, hosts))
    s = cut(suffixes.select("suffix", ((F.col("good") + ms * mu) / (F.col("n") + ms)).alias("above")), "suffixes")
    d = cut(domains.join(small_or_hashed(s), "suffix").select("domain", ((F.col("good") + F.lit(md) * F.col("above")) / (F.col("n") + md)).alias("above")), "domains")
    out = hosts.join(small_or_hashed(d), "domain")
    a, b = F.col("good") + F.lit(mh) * F.col("above"), F.col("n") - F.col("good") + F.lit(mh) * (1 - F.col("above"))
    out = out.withColumn("a", a).withColumn("b", b)
    mean, sd = F.col("a") / (F.col("a") + F.col("b")), F.sqrt(F.col("a") * F.col("b") / (F.col("a") + F.col("b") + 1)) / (F.col("a") + F.col("b"))
    out = cut(out.select("host", "domain", "suffix", "n", "good", mean.alias("mean"), F.greatest(F.lit(0.0), mean - F.lit(Z) * sd).alias("lower")), "reputation")
    release(hosts, domains, suffixes, s, d)
    return out


def url_reputation(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", outcome_col: str = "outcome", threshold: float = THRESHOLD, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """Rows (``id_col``, ``host``, ``domain``, ``suffix``, ``n_labelled``, ``n_good``, ``mean``, ``lower``, ``keep``), one for each row of ``pages``.

    ``outcome_col`` is 1 for a good page, 0 for a bad one and null for one without label. ``suffixes``
    are the public suffixes, as :func:`read_suffixes` reads them from the public list; the default is a
    short list of common ones. An address is a host, a domain and a suffix of its own. Repeated rows
    count each; other columns are not read, whatever their names. Very long URLs are read whole. Hosts without labels have their domain's prior. A null URL, or one without a host,
    has null in all columns but the id and ``keep``: nothing speaks against it, so it stays. Without any
    label the overall rate is one half. An empty table gives an empty one.
    """
    prepare(pages.sparkSession)
    keyed = pages.select(pages[id_col].alias("__id"), host_of(pages[url_col]).alias("host"), pages[outcome_col].cast("int").alias("outcome"))
    hosts = host_table(keyed, suffixes)
    joined = keyed.join(small_or_hashed(hosts), keyed["host"] == hosts["host"], "left")
    keep = keyed["host"].isNull() | (hosts["lower"] >= threshold)
    return joined.select(F.col("__id").alias(id_col), keyed["host"], "domain", "suffix", F.col("n").alias("n_labelled"), F.col("good").alias("n_good"), "mean", "lower", keep.alias("keep"))
