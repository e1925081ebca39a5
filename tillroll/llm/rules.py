"""Quality rules by weak supervision. DataFrame operations only.

Each rule votes good, bad or abstains on a document. Votes are counted by pattern (a number of
patterns bounded by 3 ** rules), expectation-maximisation over the counts estimates how each
rule votes on good and on bad documents, and the posterior probability of being good decides.

Defined results: a null text counts as an empty one; an empty text has no words and fails the
base rules; a rule whose measure is undefined abstains; repeated rows are judged each; an empty
table gives no rows; further columns are not carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.session import staged

SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, REPEAT_PERCENT = 10, 20
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_EXTRA = ("n_lines", "n_upper", "n_shouts", "n_marks")
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """When the rule votes good and when bad; SQL conditions over the measures."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("length", "n_words >= 30", "n_words < 10"),
    Rule("repeats", "100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols <= 2 * n_words", "100 * n_symbols > 10 * n_words"),
    Rule("lines", "10 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(
        "word_length",
        "word_chars between 3 * n_words and 9 * n_words",
        "word_chars < 2 * n_words or word_chars > 14 * n_words",
    ),
    Rule("capitals", "100 * n_upper <= 15 * word_chars", "100 * n_upper > 30 * word_chars"),
    Rule("marks", "100 * n_marks <= 6 * word_chars", "100 * n_marks > 9 * word_chars"),
    Rule("shouting", "n_shouts = 0", "100 * n_shouts > 5 * n_words"),
)


def _repeat_words() -> Column:
    """Words in windows found twice or more: of sorted (window, place) pairs those equal to a
    neighbour, in the order of their places, each covering up to the next."""
    repeated = F.filter(
        F.sequence(F.lit(0), F.size("sorted") - 1),
        lambda j: (F.get("sorted", j)["h"] == F.get("sorted", j - 1)["h"])
        | (F.get("sorted", j)["h"] == F.get("sorted", j + 1)["h"]),
    )
    return F.sort_array(F.transform(repeated, lambda j: F.get("sorted", j)["p"]))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the measures of each whole text."""
    others = ["doc_id"]
    whole = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        *others,
        whole.alias("_text"),
        F.array_remove(F.split(whole, SPACE), "").alias("_words"),
        F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    grams = F.when(
        F.size("_words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size("_words") - WINDOW),
            lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        *others,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("_text", F.lit("!!")).cast("long").alias("n_shouts"),
        F.char_length(F.regexp_replace(F.array_join("_words", ""), r"[\p{L}\p{N}]+", ""))
        .cast("long")
        .alias("n_marks"),
        grams.alias("_grams"),
    )
    pairs = F.sort_array(
        F.transform("_grams", lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    )
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    with_pairs = counted.withColumn("sorted", F.when(repeats, pairs).otherwise(none)).drop("_grams")
    placed = with_pairs.withColumn(
        "_places",
        F.when(F.size("sorted") > 0, _repeat_words()).otherwise(F.array().cast("array<int>")),
    ).drop("sorted")
    gaps = F.zip_with(
        F.slice("_places", 2, F.greatest(F.size("_places"), F.lit(1))),
        F.slice("_places", 1, F.greatest(F.size("_places") - 1, F.lit(0))),
        lambda b, a: F.least(b - a, F.lit(WINDOW)),
    )
    covered = F.when(F.size("_places") == 0, F.lit(0)).otherwise(
        F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)
    )
    return placed.select(
        *others,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        covered.cast("long").alias("n_repeat_words"),
        *_EXTRA,
    )


def pattern(rules: tuple[Rule, ...] = RULES) -> Column:
    """The votes as one number, a digit of base 3 each: 0 abstains, 1 bad, 2 good."""
    code = F.lit(0)
    for rule in rules:
        vote = F.when(F.expr(rule.bad), 1).when(F.expr(rule.good), 2).otherwise(0)
        code = code * 3 + vote
    return code


def digits(code: int, n: int) -> list[int]:
    return [code // 3 ** (n - 1 - k) % 3 for k in range(n)]


def posteriors(counts: dict[int, int], n_rules: int, rounds: int = 50) -> dict[int, float]:
    """Probability of being good for each pattern, by expectation-maximisation.

    It starts from good where no rule votes bad and ever less with each bad vote, so that good
    means what no rule objects to; a rule's vote frequencies are smoothed by one count.
    """
    votes = {code: digits(code, n_rules) for code in counts}
    good = {}
    for code, v in votes.items():
        good[code] = 0.9 if 1 not in v else 0.3 ** v.count(1)
    for _ in range(rounds):
        n_good = sum(counts[c] * good[c] for c in sorted(counts))
        n_bad = sum(counts[c] * (1 - good[c]) for c in sorted(counts))
        table = [[[1.0] * n_rules for _ in range(3)] for _ in range(2)]
        for code in sorted(counts):
            for k, vote in enumerate(votes[code]):
                table[1][vote][k] += counts[code] * good[code]
                table[0][vote][k] += counts[code] * (1 - good[code])
        log_prior = math.log(n_good + 1) - math.log(n_bad + 1)
        for code in counts:
            odds = log_prior
            for k, vote in enumerate(votes[code]):
                odds += math.log(table[1][vote][k] / (n_good + 3))
                odds -= math.log(table[0][vote][k] / (n_bad + 3))
            good[code] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return good


def judge(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text"
) -> DataFrame:
    """doc_id, the measures, votes, base_failed, p_good and kept."""
    measured = staged(measure(docs, text).withColumn("votes", pattern(rules)), "measured")
    counts = dict(measured.groupBy("votes").count().collect())  # at most 3 ** rules
    spark = docs.sparkSession
    known = spark.createDataFrame(
        sorted(posteriors(counts, len(rules)).items()), "votes int, p_good double"
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )
    return (
        measured.join(F.broadcast(known), "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("p_good") >= 0.5))
    )
