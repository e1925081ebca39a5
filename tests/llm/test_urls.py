import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from tillroll.llm import urls
from tillroll.llm.registry import op10_urls

RULES = urls.RULES


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max(
        (
            (len(h + p), h + p, v)
            for v, h, p in RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ),
        default=(0, None, None),
    )
    return host, path, best[1], best[2]


def test_query_over_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()
    found = {r.page_id: r for r in op10_urls(spark, "/root/testdata/sf0.1").collect()}
    assert len(found) == len(pages)
    for page in pages:
        host, path, rule, verdict = by_hand(page.url)
        row = found[page.page_id]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == (verdict or ("block" if row.mined_confidence else "allow"))


def test_odd_urls(spark):
    odd = [
        None, "", "no scheme", "://", "http://", "x://A.COM", "http://a.com/?q", "http://com/",
        "HTTP://WWW.Example.Com/en/x#y", "http://notexample.com/en/", "http://b.net/fr/?a=://c",
        "http://a.net?x=/es/", "a://b://c/d", "http://É.com/Ä", "http://a.com/b\nc?d", "http://a.com:80/",
        "x" * 50_000 + "://com/",
    ]
    pages = spark.createDataFrame(list(enumerate(odd * 2)), "page_id long, url string")
    mined = urls.mine(spark.createDataFrame([], "url string, bad boolean"))
    for r in urls.judge(pages, mined).collect():
        host, path, rule, verdict = by_hand(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), r.url
    assert urls.judge(pages.limit(0), mined).count() == 0
    clash = urls.judge(pages.withColumnRenamed("page_id", "Verdict"), mined)
    assert clash.columns == ["url", "host", "path", "rule", "verdict", "mined_confidence"]
    assert set(clash.select("verdict").distinct().toPandas()["verdict"]) == {"allow", "block"}


def wilson(bad, seen, z=1.96):
    """The share at which ``bad`` of ``seen`` is just z standard errors above what one expects."""
    low, high = 0.0, bad / seen
    for _ in range(80):
        share = (low + high) / 2
        if bad / seen - share > z * (share * (1 - share) / seen) ** 0.5:
            low = share
        else:
            high = share
    return low


def test_few_urls_prove_little_and_one_law_holds_at_all_sizes(spark):
    def mined(n_bad, n_good=0, others=0):
        rows = [(f"http://spam{i}.org/trap/", True) for i in range(n_bad)]
        rows += [(f"http://spam.org/trap/{'x' * i}", False) for i in range(n_good)]
        rows += [(f"http://h{i}.net/p{'y' * i}", True) for i in range(others)]
        found = urls.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()
        return {t for r in found for t in r.rule_tokens}

    assert wilson(5, 5) < 0.6 < wilson(6, 6)
    assert mined(5) == set()
    assert mined(6) == {"h:org", "p:trap"}
    assert mined(6, others=60) == {"h:org", "p:trap", "h:net"}
    assert wilson(9, 11) < 0.6 and mined(9, 2) == set()
    assert wilson(12, 13) > 0.6 and mined(12, 1) == {"h:org", "p:trap"}


def test_mined_rules_match_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(1500):
        name, section = rng.choice(["spam", "news", "blog"]), rng.choice(["a", "b"])
        top, query = rng.choice(["org", "net"]), rng.choice(["", "?ref=1"])
        bad = rng.random() < (0.9 if name == "spam" and section == "a" else 0.1)
        rows.append((f"http://{name}.{top}/{section}/{rng.randint(1, 99)}{query}", bad))
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    split = labelled.select("bad", urls.tokens(F.col("url")).alias("t")).collect()
    sets = [(r.bad, frozenset(r.t)) for r in split]
    every = sorted({t for _, s in sets for t in s})
    n_bad = sum(b for b, _ in sets)
    good = {}
    for n in (1, 2, 3, 4, 5):
        for combo in map(frozenset, combinations(every, n)):
            bad = sum(b and combo <= s for b, s in sets)
            seen = sum(combo <= s for _, s in sets)
            if bad >= 0.05 * n_bad and wilson(bad, seen) >= 0.7:
                good[combo] = (bad, bad / seen)
    expected = {c: v for c, v in good.items() if not any(d < c for d in good)}
    found = urls.mine(labelled, 0.05, 0.7).collect()
    assert expected and {frozenset(r.rule_tokens): (r.support, r.confidence) for r in found} == expected
    assert all(r.key in r.rule_tokens for r in found)
    judged = urls.judge(labelled, urls.mine(labelled, 0.05, 0.7)).collect()
    for r in judged:
        have = any(c <= dict_tokens for c in expected for dict_tokens in [tokens_of(r.url)])
        assert (r.mined_confidence is not None) == have
        assert r.verdict == (by_hand(r.url)[3] or ("block" if have else "allow"))


def tokens_of(url):
    host, path, _, _ = by_hand(url)
    out = {f"h:{x}" for x in host.split(".")}
    out |= {"p:" + re.sub(r"\d+", "#", x) for x in path.split("/") if x}
    return frozenset(out | ({"q:ref"} if "?ref" in url else set()))
