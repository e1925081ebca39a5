"""Names of products: lists to choose from, and matching of new names to known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.text import NAME_COLLATION, clean_name

_STEM = 3


def product_options(products: DataFrame, purchases: DataFrame | None = None) -> DataFrame:
    """Names by number of purchases; from the lines where there are no statistics yet."""
    if purchases is not None and products.isEmpty():
        products = purchases.groupBy("product_id").agg(F.count("*").alias("total_purchases"))
    return products.select("product_id", "total_purchases").orderBy(
        F.desc("total_purchases"), "product_id"
    )


def known_products(products: DataFrame, template: list[str] | None = None) -> DataFrame:
    """Distinct non-empty names in order; the template's names when there are none."""
    if template is not None and products.isEmpty():
        spark = products.sparkSession
        products = spark.createDataFrame([(n,) for n in template], "product_id string")
    return (
        products.where(F.length("product_id") > 0)
        .select("product_id")
        .distinct()
        .orderBy("product_id")
    )


def match_known_products(
    lines: DataFrame, known: DataFrame, collation: str = NAME_COLLATION
) -> DataFrame:
    """Replace each product name by the known spelling of it, if there is one.

    Names are matched once per distinct spelling, not per line, and the catalogue may
    grow with the data, so no side is forced to be broadcast. The join back to the
    lines is on plain text; a product with a large share of the lines is one catalogue
    row against a splittable side, which adaptive execution divides.
    """
    def same(col: Column | str) -> Column:
        return F.collate(col, collation)

    spellings = lines.select("product_id").distinct()
    catalogue = known.groupBy(same("product_id").alias("same_name")).agg(
        F.min("product_id").alias("known_name")
    )
    matched = (
        spellings.withColumn("cleaned", clean_name("product_id"))
        .join(catalogue, same("cleaned") == F.col("same_name"), "left")
        .select("product_id", F.coalesce("known_name", "cleaned").alias("matched_name"))
    )
    return lines.join(matched, "product_id", "left")


def _made_once(names: DataFrame) -> DataFrame:
    """The same rows, out of a generator. No filter passes it, so all uses of the names have what
    comes before in common and share its exchanges: it is neither read nor broadcast once a use."""
    return names.select(F.inline(F.array(F.struct(*names.columns))))


def _plain(name: Column) -> Column:
    """Small letters, words one space apart, without the dots of abbreviations."""
    return F.trim(F.regexp_replace(F.lower(name), r"[\s.]+", " "))


def _shortened(plain: Column, max_edits: int) -> Column:
    """The text and all that is left of it after up to so many single characters are taken out."""
    every = F.array(plain)
    for _ in range(max_edits):
        less = F.transform(
            every,
            lambda text: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
                lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substr(text, i + 1)),
            ),
        )
        every = F.array_distinct(F.concat(every, F.flatten(less)))
    return every


def similar_names(names: DataFrame, known: DataFrame, max_edits: int = 1) -> DataFrame:
    """(plain, known_plain, edits) of names (plain) and known names at most so many edits apart.

    Names within ``max_edits`` have a text in common that each becomes when up to so many of its
    characters are taken out. Names meet by the hash of these texts and are then compared: what
    meets is at most twice as many edits apart, however many names share most of their characters.
    A name of n characters has about n texts for one edit, n * n / 2 for two. Names as short as
    ``3 * max_edits - 2`` characters or less are left out.
    """
    least = 3 * max_edits - 1

    def texts(df: DataFrame, name: str) -> DataFrame:
        kept = df.where(F.length("plain") >= least).select(F.col("plain").alias(name)).distinct()
        left = F.explode(_shortened(F.col(name), max_edits)).alias("left")
        return kept.select(name, left).select(name, F.xxhash64("left").alias("left"))

    edits = F.levenshtein("plain", "known_plain", max_edits)
    return (
        texts(names, "plain")
        .join(texts(known, "known_plain").hint("merge"), "left")
        .where(F.abs(F.length("plain") - F.length("known_plain")) <= max_edits)
        .select("plain", "known_plain", edits.alias("edits"))
        .where("edits >= 0")
        .distinct()
    )


def _stems(words: Column) -> Column:
    return F.concat_ws(" ", F.transform(words, lambda w: F.substring(w, 1, _STEM)))


def abbreviated_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """(plain, known_plain) where each word of a name begins the word in its place of a known
    name; a word shorter than _STEM letters has to be the whole word.

    Names meet by the first letters of all words and the whole of the name's longest word, the
    last of several: a known name stands there with every beginning of each of its words.
    """

    def split(df: DataFrame, name: str, words: str) -> DataFrame:
        split = df.select(F.col("plain").alias(name), F.split("plain", " ").alias(words)).distinct()
        return split.withColumn("stems", _stems(F.col(words)))

    longest = F.array_max(
        F.transform("short", lambda w, i: F.struct(F.length(w).alias("size"), i.alias("at"), w.alias("word")))
    )
    beginnings = F.flatten(
        F.transform(
            "long",
            lambda w, i: F.transform(
                F.sequence(F.least(F.length(w), F.lit(_STEM)), F.length(w)),
                lambda n: F.struct(i.alias("at"), F.substring(w, F.lit(1), n).alias("word")),
            ),
        )
    )
    mine = split(names, "plain", "short").withColumn("long_word", longest)
    theirs = split(known, "known_plain", "long").select("*", F.inline(beginnings))
    begins = F.zip_with(
        "short",
        "long",
        lambda a, b: (a == b) | ((F.length(a) >= _STEM) & F.startswith(b, a)),
    )
    return (
        mine.select("plain", "short", "stems", "long_word.at", "long_word.word")
        .join(theirs.hint("merge"), ["stems", "at", "word"])
        .where((F.size("short") == F.size("long")) & F.forall(begins, lambda x: x))
        .select("plain", "known_plain")
    )


def match_similar_products(
    lines: DataFrame,
    known: DataFrame,
    max_edits: int = 1,
    collation: str = NAME_COLLATION,
) -> DataFrame:
    """``matched_name`` and ``matched_by`` for each line: the known name (product_id,
    total_purchases) that is the same but for case, accents and spaces (``same``), else one
    that the name abbreviates word by word (``short``), else one at most ``max_edits`` edits away
    (``edited``), else the cleaned name itself (``new``).

    Of several the one with fewest edits counts, then the most purchased, then the first by
    name. All is done on distinct spellings; a line without a name gets neither. Candidates are
    found and chosen by sort and merge, so that the driver holds no table of them at any size.
    """
    spellings = _made_once(lines.select("product_id").distinct())
    names = _made_once(known.groupBy("product_id").agg(F.max("total_purchases").alias("bought")))
    exact = match_known_products(spellings, names, collation)
    named = names.withColumn("plain", _plain(F.col("product_id")))
    spelled = exact.withColumn("plain", _plain(F.col("matched_name")))
    unknown = spelled.join(
        names.hint("merge"), F.col("matched_name") == names["product_id"], "left_anti"
    )
    candidates = (
        abbreviated_names(unknown, named)
        .withColumns({"how": F.lit("short"), "edits": F.lit(0)})
        .unionByName(similar_names(unknown, named, max_edits).withColumn("how", F.lit("edited")))
    )
    order = F.struct(
        F.when(F.col("how") == "short", 0).otherwise(1), "edits", -F.col("bought"), "product_id"
    )
    best = (
        candidates.join(named.withColumnRenamed("plain", "known_plain").hint("merge"), "known_plain")
        .groupBy("plain")
        .agg(F.min_by(F.struct("product_id", "how"), order).alias("best"))
    )
    same = names.select(F.col("product_id").alias("matched_name"), F.lit("same").alias("same"))
    chosen = (
        spelled.join(same.hint("merge"), "matched_name", "left")
        .join(best.hint("merge"), "plain", "left")
        .select(
            "product_id",
            F.when(F.col("same").isNull(), F.coalesce(F.col("best.product_id"), "matched_name"))
            .otherwise(F.col("matched_name"))
            .alias("matched_name"),
            F.coalesce("same", F.col("best.how"), F.lit("new")).alias("matched_by"),
        )
    )
    return lines.join(chosen, "product_id", "left")
