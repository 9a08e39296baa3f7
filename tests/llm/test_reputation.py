"""Host reputation recomputed in plain Python, and what the given formula says about hosts that do not differ."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from seqloom.llm import urls


def brute(outcomes, z=1.64):
    """(rate, low) by host from (host, bad) pairs; hosts have two or three labels here."""
    hosts = defaultdict(lambda: [0, 0])
    for host, bad in outcomes:
        n, b = hosts[host]
        hosts[host] = [n + (bad is not None), b + bool(bad)]
    domain = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: h.split(".")[-1]

    def sums(key):
        found = defaultdict(lambda: [0, 0])
        for h, (n, b) in hosts.items():
            found[key(h)] = [found[key(h)][0] + n, found[key(h)][1] + b]
        return found

    def strength(rows):
        more = sum(n * (b / n - m) ** 2 - m * (1 - m) for n, b, m in rows if n)
        room = sum(m * (1 - m) * (n - 1) for n, b, m in rows if n)
        low, high = urls.STRENGTH_RANGE
        return high if not room or more <= 0 else min(max(room / more - 1, low), high)

    total, bad = sum(n for n, _ in hosts.values()), sum(b for _, b in hosts.values())
    overall = bad / total if total else 0.0
    suffixes, domains = sums(suffix), sums(domain)
    by_suffix = strength([(n, b, overall) for n, b in suffixes.values()])
    means = {}
    for d, (n, b) in domains.items():
        sn, sb = suffixes[suffix(d)]
        means[d] = (sb - b + by_suffix * overall) / (sn - n + by_suffix)
    by_domain = strength([(n, b, means[d]) for d, (n, b) in domains.items()])
    prior = {}
    for h, (n, b) in hosts.items():
        dn, db = domains[domain(h)]
        prior[h] = (db - b + by_domain * means[domain(h)]) / (dn - n + by_domain)
    by_host = strength([(n, b, prior[h]) for h, (n, b) in hosts.items()])
    made = {}
    for h, (n, b) in hosts.items():
        rate = (b + by_host * prior[h]) / (n + by_host)
        made[h] = rate, rate - z * (rate * (1 - rate) / (n + by_host + 1)) ** 0.5
    return made, overall


def test_posterior_against_brute_force(spark):
    rng = random.Random(8)
    outcomes = []
    for d in range(25):
        base = rng.choice([0.02, 0.05, 0.4])
        name = f"d{d}.{rng.choice(['com', 'org', 'net'])}"
        for h in range(rng.randint(1, 5)):
            rate = min(1.0, base * rng.choice([0.5, 1, 2]))
            for _ in range(rng.choice([0, 1, 3, 40, 200])):
                outcomes.append((f"h{h}.{name}", rng.choice([None, rng.random() < rate, rng.random() < rate])))
    df = spark.createDataFrame(outcomes, "host string, bad boolean")
    want, overall = brute(outcomes)
    got = {r.host: r for r in urls.host_reputation(df).collect()}
    assert set(got) == set(want)
    for host, (rate, low) in want.items():
        assert abs(got[host].rate - rate) < 1e-9 and abs(got[host].low - low) < 1e-9, host
        assert abs(got[host].overall - overall) < 1e-12
    pages = df.select(F.monotonically_increasing_id().alias("page_id"), F.concat(F.lit("http://"), "host", F.lit("/x")).alias("url"), "bad")
    verdicts = {r.host: r.verdict for r in urls.url_filter(pages, bad=F.col("bad"), rules=()).collect()}
    limit = min(0.5, 1.5 * overall)
    assert verdicts == {h: "block" if low > limit else "allow" for h, (_, low) in want.items()}
    assert len(set(verdicts.values())) == 2


def test_hosts_that_differ_by_chance_only_are_not_blocked(spark):
    """Every host has the same true rate: the spread between them is chance, and is shrunk away."""
    rng = random.Random(9)
    outcomes = [(f"h{i % 60}.d{i % 20}.com", rng.random() < 0.07) for i in range(3000)]
    rows = urls.host_reputation(spark.createDataFrame(outcomes, "host string, bad boolean")).collect()
    raw = [r.bad / r.n for r in rows]
    assert max(raw) > 1.8 * 0.07 and max(r.rate for r in rows) < 1.5 * 0.07
    assert not any(r.low > 1.5 * r.overall for r in rows)
