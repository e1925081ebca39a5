"""The registered query of each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (
    bpe,
    contain,
    lattice,
    licences,
    near,
    ordinal,
    repeats,
    resample,
    rules,
    sharding,
    suffixes,
    urls,
    whiten,
)

RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_sum(spans: str) -> Column:
    lengths = F.transform(spans, lambda s: (s["end"] - s["start"]).cast("long"))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda total, n: total + n)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    return bpe.digests(bpe.decode(coded, ranks)).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.train(docs, ordinal.ratings(table(spark, sf_dir, "labels")))
    return ordinal.classify(docs, model).drop("text")


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contain.find(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_items", F.array_join("item_ids", ",").alias("item_ids"), "contaminated"
    )


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove(docs).select(
        "doc_id",
        "n_bytes",
        span_sum("spans").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, *licences.train(docs))


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(table(spark, sf_dir, "documents"), n=3, percent=85)


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.judge(docs).select("doc_id", *rules.MEASURES, "base_failed", "kept", "p_good")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove(docs).select(
        "doc_id", "n_words", span_sum("spans").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by the row of ``labels`` of the same id: toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = ordinal.ratings(table(spark, sf_dir, "labels")).select(
        F.col("doc_id").alias("page_id"), (F.col("grade") < 2).alias("bad")
    )
    mined = urls.mine(pages.join(bad, "page_id"))
    return urls.judge(pages, mined).drop("url")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resample.draw(docs, table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op13_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.groups(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_shards": op3_shards,
    "op4_decontaminate": op4_decontaminate,
    "op5_suffixes": op5_suffixes,
    "op6_licences": op6_licences,
    "op7_near": op7_near,
    "op8_rules": op8_rules,
    "op9_repeats": op9_repeats,
    "op10_urls": op10_urls,
    "op11_resample": op11_resample,
    "op12_whiten": op12_whiten,
    "op13_lattice": op13_lattice,
}

#: CRC-32 of the hexadecimal digits of a text's bytes, byte by byte
_CRC32 = """
bits AS (SELECT list(CASE WHEN i IS NULL THEN 0 ELSE c END ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
  FROM range(256) t(i)))"""

ORACLES = {
    "op3_shards": f"""
WITH {_CRC32},
docs AS (
  SELECT doc_id, md5(coalesce(text, '')) AS g, strlen(coalesce(text, '')) + 1 AS size,
    hex(encode(coalesce(text, ''))) AS digits FROM documents),
sums AS (
  SELECT doc_id, CAST(xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(digits, '..'),
        lambda d: CAST('0x' || d AS BIGINT))),
      lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) AS BIGINT) AS crc
  FROM docs, bits),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY g, doc_id ROWS UNBOUNDED PRECEDING) - size AS b,
    row_number() OVER (ORDER BY g, doc_id) AS r, sum(size) OVER () AS total,
    sum(size) OVER (PARTITION BY g) AS gs FROM docs),
grouped AS (SELECT *, min(b) OVER (PARTITION BY g) AS gb FROM placed),
assigned AS (
  SELECT doc_id, size, r, least(15, (CASE WHEN gs <= floor({sharding.TOLERANCE} * total / 16)
    THEN 2 * gb + gs ELSE 2 * b + size END) * 16 // (2 * total)) AS shard FROM grouped)
SELECT a.doc_id, CAST(a.size AS BIGINT) AS size, s.crc AS text_crc32, 'bytes' AS law,
  CAST(a.shard AS INTEGER) AS shard,
  CAST(a.r - min(a.r) OVER (PARTITION BY a.shard) AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM assigned a JOIN sums s USING (doc_id)""",
    "op4_decontaminate": f"""
WITH item_words AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'),
    lambda w: w <> '') AS w FROM benchmark),
items AS (
  SELECT item_id, least(len(w), {contain.SHINGLE}) AS n, list_distinct(list_transform(
      range(1, greatest(len(w) - {contain.SHINGLE}, 0) + 2),
      lambda i: array_to_string(w[i : i + least(len(w), {contain.SHINGLE}) - 1], ' '))) AS g
  FROM item_words WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM items),
doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'),
    lambda w: w <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - n + 2),
      lambda i: array_to_string(w[i : i + n - 1], ' '))) AS g
    FROM doc_words, lengths WHERE len(w) >= n)),
held AS (
  SELECT doc_id, item_id, count(*) AS c, any_value(q) AS q
  FROM grams JOIN (SELECT item_id, unnest(g) AS g, len(g) AS q FROM items) USING (g)
  GROUP BY doc_id, item_id),
found AS (SELECT doc_id, item_id FROM held WHERE 100 * c >= {contain.PERCENT} * q)
SELECT d.doc_id, count(f.item_id) AS n_items,
  coalesce(string_agg(f.item_id, ',' ORDER BY f.item_id), '') AS item_ids,
  count(f.item_id) > 0 AS contaminated
FROM documents d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id""",
    "op5_suffixes": f"""
WITH docs AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), {2 * suffixes.LENGTH}) AS k
  FROM (SELECT doc_id, h, unnest(range(n - {suffixes.LENGTH} + 1)) AS i FROM docs
        WHERE n >= {suffixes.LENGTH})),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM windows)
  WHERE first < doc_id),
begun AS (
  SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {suffixes.LENGTH}
    THEN 0 ELSE 1 END AS begins FROM repeated),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM begun),
spans AS (
  SELECT doc_id, run, min(i) AS s, max(i) + {suffixes.LENGTH} AS e FROM numbered
  GROUP BY doc_id, run),
between AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM spans),
joined AS (
  SELECT b.doc_id, sum(e - s) AS removed, count(*) AS spans, max(e) AS last,
    string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (s - p) AS BIGINT)), '' ORDER BY s) AS head
  FROM between b JOIN docs USING (doc_id) GROUP BY b.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM docs d LEFT JOIN joined j USING (doc_id)""",
    "op7_near": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1),
      lambda i: array_to_string(w[i : i + 2], ' ')))) END AS g FROM words),
sized AS (SELECT doc_id, g, len(g) AS n, min(doc_id) OVER (PARTITION BY g) AS node FROM sets),
grams AS (SELECT doc_id AS node, n, unnest(g) AS k FROM sized WHERE node = doc_id),
links AS (
  SELECT a.node AS u, b.node AS v FROM grams a JOIN grams b ON a.k = b.k AND a.node <> b.node
  GROUP BY a.node, b.node
  HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reached AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u),
least AS (SELECT u AS node, min(v) AS m FROM reached GROUP BY u)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles,
  CASE WHEN s.n = 0 THEN s.doc_id ELSE least(s.node, coalesce(l.m, s.node)) END AS component_id,
  s.doc_id = CASE WHEN s.n = 0 THEN s.doc_id ELSE least(s.node, coalesce(l.m, s.node)) END AS kept
FROM sized s LEFT JOIN least l USING (node)""",
    "op9_repeats": rf"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + {repeats.WINDOW - 1}], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {repeats.WINDOW - 2})) AS i FROM words
        WHERE len(w) >= {repeats.WINDOW})),
repeated AS (
  SELECT doc_id, i FROM
    (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows)
  WHERE r > 1),
gone AS (
  SELECT doc_id, list_distinct(list(i + o)) AS p
  FROM repeated, (SELECT unnest(range({repeats.WINDOW})) AS o) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: p IS NULL OR NOT list_contains(p, i)), ' '))
    AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)""",
    "op11_resample": rf"""
WITH {_CRC32},
texts AS (
  SELECT 0 AS side, doc_id, text FROM documents
  UNION ALL SELECT 1, NULL, text FROM benchmark),
words AS (
  SELECT side, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts),
grams AS (
  SELECT side, doc_id, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: array_to_string(w[i : i + 1], ' ')),
    list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')))) AS g
  FROM words),
counted AS (SELECT side, doc_id, g, count(*) AS c FROM grams GROUP BY side, doc_id, g),
hashed AS (
  SELECT g, CAST(xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(g)), '..'),
        lambda d: CAST('0x' || d AS BIGINT))),
      lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) AS BIGINT)
    % {resample.BUCKETS} AS bucket
  FROM (SELECT DISTINCT g FROM counted), bits),
placed AS (SELECT side, doc_id, bucket, c FROM counted JOIN hashed USING (g)),
sums AS (SELECT side, bucket, sum(c) AS c FROM placed GROUP BY side, bucket),
wholes AS (
  SELECT coalesce(sum(c) FILTER (side = 0), 0) AS s, coalesce(sum(c) FILTER (side = 1), 0) AS t
  FROM sums),
gain AS (
  SELECT a.bucket, CAST(floor(1000 * ln(CAST(coalesce(b.c, 0) + 1 AS DOUBLE)
      * CAST(w.s + {resample.BUCKETS} AS DOUBLE)
      / (CAST(a.c + 1 AS DOUBLE) * CAST(w.t + {resample.BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT * FROM sums WHERE side = 0) a
  LEFT JOIN (SELECT * FROM sums WHERE side = 1) b USING (bucket), wholes w),
weighed AS (
  SELECT doc_id, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c * gain) AS BIGINT) AS weight
  FROM placed JOIN gain USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((
      CAST('0x' || substr(sha256('42:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
      / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM (SELECT * FROM words WHERE side = 0) d LEFT JOIN weighed USING (doc_id)),
ordered AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n
  FROM scored WHERE n_words >= {resample.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ordered USING (doc_id)""",
}
