"""URL filters by association rules.

Spark's FP-growth finds token combinations that are frequent among the URLs labelled bad. A
combination whose share of bad among all labelled URLs that have it (its confidence) is surely
high enough, and that has no shorter rule inside it, becomes a rule. URLs are matched through an
inverted index: each rule is listed under its rarest token, and a URL's tokens look it up.
Rules given by hand come first; the longest that fits decides.

Defined results: a null URL or one without ``://`` has an empty host and path, no tokens, and
is allowed unless a rule fits; repeated URLs are judged alike; without labels there are no mined
rules; an empty table gives no rows; extra columns are kept, but for those that have the
name of an added one: it replaces them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.frames import without
from tillroll.session import staged

MIN_SHARE, MIN_CONFIDENCE, Z = 0.005, 0.6, 1.96
#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, ASCII letters lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Host labels, path segments (digits as one sign), query names, and a fragment's presence."""
    after = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(after, "&"), lambda x: F.substring_index(x, "=", 1))
    parts = F.transform(F.split(path(url), "/"), lambda x: F.regexp_replace(x, r"\d+", "#"))
    none = F.array().cast("array<string>")
    marked = F.concat(
        F.transform(F.split(host(url), r"\."), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(parts, lambda x: F.concat(F.lit("p:"), x)),
        F.transform(names, lambda x: F.concat(F.lit("q:"), x)),
        F.when(F.locate("#", url) > 0, F.array(F.lit("f:#"))).otherwise(none),
    )
    kept = F.array_distinct(F.filter(marked, lambda x: F.length(x) > 2))
    return F.coalesce(kept, none)


def _matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule columns) of the rules whose tokens a URL (url, tokens) has all of."""
    looked_up = urls.select("url", "tokens", F.explode("tokens").alias("key"))
    joined = looked_up.join(rules, "key")
    return joined.filter(F.size(F.array_except("rule_tokens", "tokens")) == 0).drop("tokens")


def surely(bad: Column, seen: Column, z: float) -> Column:
    """The share of bad that ``bad`` of ``seen`` prove: the lower end of Wilson's interval."""
    share, spread = bad / seen, z * z / seen
    error = z * F.sqrt(share * (1 - share) / seen + spread / (4 * seen))
    return (share + spread / 2 - error) / (1 + spread)


def mine(
    labelled: DataFrame,
    min_share: float = MIN_SHARE,
    min_confidence: float = MIN_CONFIDENCE,
    z: float = Z,
) -> DataFrame:
    """Rules (key, rule_tokens, support, confidence) of labelled URLs (url, bad boolean).

    ``key`` is the rule's rarest token among the labelled URLs. Combinations are frequent if
    at least ``min_share`` of the bad URLs have them; the lower end of their confidence, ``z``
    standard errors down, must reach ``min_confidence``, so that few URLs prove little at any
    size of the table.
    """
    if not 0 < min_confidence < 1:
        raise ValueError("min_confidence must be between 0 and 1")
    spark = labelled.sparkSession
    rows = staged(
        labelled.filter(F.col("url").isNotNull() & F.col("bad").isNotNull())
        .select("url", "bad", tokens(F.col("url")).alias("tokens"))
        .filter(F.size("tokens") > 0),
        "labelled",
    )
    empty = spark.createDataFrame(
        [], "key string, rule_tokens array<string>, support long, confidence double"
    )
    bad = rows.filter("bad")
    n_bad = bad.count()
    # fewer bad URLs than these would not prove the confidence if all that is seen were bad
    proving = z * z * min_confidence / (1 - min_confidence)
    least = max(1, math.ceil(min_share * n_bad), math.ceil(proving - 1e-9))
    if n_bad < least:
        return empty
    growth = FPGrowth(itemsCol="tokens", minSupport=(least - 0.5) / n_bad, minConfidence=1.0)
    frequent = growth.fit(bad.select("tokens")).freqItemsets
    # each token's frequency, and each combination under its rarest token
    known = rows.select(F.explode("tokens").alias("key")).groupBy("key").count()
    sets = staged(frequent.select(F.array_sort("items").alias("rule_tokens"), "freq"), "frequent")
    rarest = (
        sets.select("rule_tokens", "freq", F.explode("rule_tokens").alias("key"))
        .join(known, "key")
        .groupBy("rule_tokens", "freq")
        .agg(F.min_by("key", F.struct("count", "key")).alias("key"))
    )
    counted = (
        _matches(rows.select("url", "tokens"), rarest)
        .groupBy("key", "rule_tokens", "freq")
        .agg(F.count("*").alias("seen"))
    )
    proven = surely(F.col("freq"), F.col("seen"), z) >= min_confidence
    confident = staged(
        counted.filter(proven).select(
            "key",
            "rule_tokens",
            F.col("freq").alias("support"),
            (F.col("freq") / F.col("seen")).alias("confidence"),
        ),
        "confident",
    )
    # a longer rule around a shorter one says nothing new
    inner = confident.select("key", F.col("rule_tokens").alias("inside"))
    longer = confident.select("rule_tokens", F.explode("rule_tokens").alias("key"))
    around = (
        longer.join(inner, "key")
        .filter(F.size("rule_tokens") > F.size("inside"))
        .filter(F.size(F.array_except("inside", "rule_tokens")) == 0)
        .select("rule_tokens")
        .distinct()
    )
    return confident.join(around, "rule_tokens", "left_anti").select(*empty.columns)


def by_hand(rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits columns ``host`` and ``path``, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = (
            (F.col("host") == name) | F.col("host").endswith(f".{name}")
        ) & F.col("path").startswith(start)
        pair = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, pair).otherwise(found)
    return found


def judge(
    pages: DataFrame, mined: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES
) -> DataFrame:
    """Add host, path, rule, verdict and the confidence of the mined rule that fits best."""
    added = ("host", "path", "rule", "verdict", "mined_confidence")
    pages = without(pages, *added, "_given")
    urls = (
        pages.select("url")
        .filter(F.col("url").isNotNull())
        .distinct()
        .withColumn("tokens", tokens(F.col("url")))
    )
    hits = _matches(urls, mined).groupBy("url").agg(F.max("confidence").alias("mined_confidence"))
    url = F.col("url")
    return (
        pages.join(hits, "url", "left")
        .withColumn("host", host(url))
        .withColumn("path", path(url))
        .withColumn("_given", by_hand(rules))
        .withColumn("rule", F.col("_given")["rule"])
        .withColumn(
            "verdict",
            F.coalesce(
                F.col("_given")["verdict"],
                F.when(F.col("mined_confidence").isNotNull(), "block").otherwise("allow"),
            ),
        )
        .drop("_given")
        .select(*pages.columns, *added)
    )
