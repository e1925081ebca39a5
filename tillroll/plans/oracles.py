"""The same results in plain SQL, for a second engine to compute from the same tables.

Where a value can be told from the order tables directly, the SQL does that instead of
repeating the cleaning steps: the expected date is the order's date, not a parse of it.
"""

from __future__ import annotations

from tillroll.plans.registry import PRODUCT
from tillroll.plans.testbed import AS_OF

_LINES = """
purchases AS (
  SELECT (CAST(l_orderkey AS HUGEINT) * 10 + l_linenumber) * 100000000000
           + CAST(round(l_extendedprice * 100) AS BIGINT) AS id,
         CAST(o_orderdate AS DATE) AS purchase_date,
         p_name || ' ' || p_partkey AS product_id,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS product_price,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         CAST(l_quantity AS DECIMAL(10,3)) AS quantity,
         round_even(l_extendedprice / l_quantity * 100, 0) / 100 AS unit_price,
         s_name AS market_id,
         lpad(CAST(l_orderkey AS VARCHAR), 44, '0') AS access_key,
         'https://example.org/nfce?p=' || l_orderkey AS nfce_url,
         l_linenumber, l_returnflag, l_linestatus, l_discount, l_tax, l_quantity,
         l_extendedprice, p_name, p_partkey, p_size, s_name, l_orderkey
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
)"""


def _ratio(total: str, count: str) -> str:
    """total / count for whole numbers, rounded half up, as a double of hundredths."""
    return (
        f"CAST((2 * CAST({total} AS HUGEINT) + ({count})) // nullif(2 * ({count}), 0) AS DOUBLE)"
        " / 100"
    )


_SILVER = f"""
gaps AS (
  SELECT *, date_diff('day', lag(purchase_date) OVER (
             PARTITION BY product_id ORDER BY purchase_date), purchase_date) AS days_between
  FROM purchases
),
products AS (
  SELECT product_id, max(purchase_date) AS last_purchase_date,
         {_ratio("sum(days_between) * 100", "count(days_between)")} AS avg_days_purchase,
         {_ratio("sum(cents)", "count(*)")} AS avg_product_price,
         CAST(min(cents) AS DOUBLE) / 100 AS min_product_price,
         CAST(max(cents) AS DOUBLE) / 100 AS max_product_price,
         count(*) AS total_purchases,
         CAST(date_diff('day', max(purchase_date), DATE '{AS_OF}') AS DOUBLE) AS days_last_purchase
  FROM gaps GROUP BY product_id
),
flagged AS (
  SELECT *, coalesce(days_last_purchase > avg_days_purchase, false) AS buy FROM products
),
markets AS (
  SELECT market_id, CAST(sum(cents) AS DOUBLE) / 100 AS total_spent,
         {_ratio("sum(cents)", "count(DISTINCT purchase_date)")} AS avg_ticket,
         count(DISTINCT purchase_date) AS visit_count, max(purchase_date) AS last_visit
  FROM purchases GROUP BY market_id
),
monthly AS (
  SELECT strftime(purchase_date, '%Y-%m') AS year_month,
         CAST(sum(cents) AS BIGINT) AS month_cents,
         CAST(sum(cents) AS DOUBLE) / 100 AS total_spent, count(*) AS item_count,
         {_ratio("sum(cents)", "count(*)")} AS avg_price
  FROM purchases GROUP BY 1
),
changes AS (
  SELECT year_month, total_spent, item_count, avg_price,
         (total_spent - lag(total_spent) OVER m) / lag(total_spent) OVER m AS total_spent_change,
         (item_count - lag(item_count) OVER m) / CAST(lag(item_count) OVER m AS DOUBLE)
           AS item_count_change,
         (avg_price - lag(avg_price) OVER m) / lag(avg_price) OVER m AS avg_price_change
  FROM monthly WINDOW m AS (ORDER BY year_month)
),
toned AS (
  SELECT *, CASE WHEN total_spent_change IS NULL OR abs(total_spent_change) < 0.02 THEN 'neutral'
                 WHEN total_spent_change > 0 THEN 'bad' ELSE 'good' END AS tone
  FROM changes
),
due AS (
  SELECT product_id, CAST(last_purchase_date AS VARCHAR) AS last_purchase_date,
         days_last_purchase, avg_days_purchase,
         days_last_purchase - avg_days_purchase AS overdue_days, avg_product_price, total_purchases
  FROM flagged WHERE buy AND avg_days_purchase > 0
),
progress AS (
  SELECT product_id, days_last_purchase, avg_days_purchase, avg_product_price, total_purchases,
         CAST(last_purchase_date AS VARCHAR) AS last_purchase_date,
         CASE WHEN avg_days_purchase IS NULL OR avg_days_purchase = 0 THEN 0.0
              ELSE least(days_last_purchase / avg_days_purchase * 100, 150.0)
         END AS purchase_progress
  FROM flagged
)"""

_RECURRENCE = """
market_gaps AS (
  SELECT market_id, product_id, date_diff('day', lag(purchase_date) OVER (
           PARTITION BY market_id, product_id ORDER BY purchase_date), purchase_date) AS gap
  FROM purchases
),
total_gaps AS (
  SELECT date_diff('day', lag(purchase_date) OVER (
           PARTITION BY product_id ORDER BY purchase_date), purchase_date) AS gap
  FROM purchases
),
scoped AS (
  SELECT 'Total' AS scope, gap FROM total_gaps WHERE gap IS NOT NULL
  UNION ALL
  SELECT market_id, gap FROM market_gaps WHERE gap IS NOT NULL
),
bars AS (SELECT scope, gap, count(*) AS n FROM scoped GROUP BY ALL),
sizes AS (SELECT scope, sum(n) AS total FROM bars GROUP BY scope),
curve AS (
  SELECT s.scope, d.days,
         CAST(coalesce(sum(b.n) FILTER (b.gap <= d.days), 0) AS DOUBLE)
           / CAST(any_value(s.total) AS DOUBLE) AS cumulative_pct
  FROM sizes s CROSS JOIN (SELECT unnest(range(61)) AS days) d JOIN bars b ON b.scope = s.scope
  GROUP BY s.scope, d.days
)"""

_ALERTS = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY purchase_date DESC, id DESC) AS rn
  FROM purchases
),
priors AS (
  SELECT product_id, CAST(max(cents) FILTER (rn = 1) AS DOUBLE) / 100 AS last_price,
         CAST(sum(cents) FILTER (rn > 1) AS DOUBLE) / 100 / (count(*) - 1) AS prior_avg_price,
         CAST(max(purchase_date) AS VARCHAR) AS last_purchase_date
  FROM ranked GROUP BY product_id HAVING count(*) >= 2
),
alerts AS (
  SELECT product_id, last_price, prior_avg_price,
         (last_price - prior_avg_price) / prior_avg_price AS variation_pct, last_purchase_date
  FROM priors WHERE (last_price - prior_avg_price) / prior_avg_price > 0.15
)"""

_TITLE = (
    "array_to_string(list_transform(regexp_extract_all({0}, '[a-zA-Z]+|[^a-zA-Z]+'),"
    " lambda w: upper(w[1]) || lower(w[2:])), '')"
)

_RAW = f"""
spoiled AS (
  SELECT id, CAST(purchase_date AS VARCHAR) AS day, l_tax = 0.08 AND l_returnflag = 'A' AS bad_date,
         l_discount = 0.1 AND l_tax = 0.0 AS no_product,
         CASE WHEN l_discount = 0.1 AND l_tax = 0.0 THEN ''
              WHEN l_linestatus = 'O' THEN upper(p_name) || '-' || p_partkey || 'kg'
              ELSE product_id END AS name,
         s_name, p_name, p_partkey, l_linenumber, l_tax, l_returnflag, l_orderkey,
         CASE WHEN (l_returnflag = 'N' AND l_tax = 0.01) OR l_tax = 0.02 THEN NULL
              ELSE CAST(cents AS DOUBLE) / 100 END AS price,
         CASE WHEN l_linenumber = 6 THEN NULL WHEN l_discount = 0.03 THEN -2.0
              ELSE l_quantity END AS qty,
         CASE WHEN l_linestatus = 'F' THEN NULL ELSE unit_price END AS unit,
         CASE WHEN l_linenumber = 1 THEN access_key END AS key,
         CASE WHEN l_returnflag = 'R' THEN nfce_url END AS url
  FROM purchases
),
amounts AS (
  SELECT *, CASE WHEN qty > 0 THEN qty ELSE 1.0 END AS q FROM spoiled
),
settled AS (
  SELECT *, round_even(q * 1000, 0) / 1000 AS quantity,
         round_even(coalesce(unit, price / q) * 100, 0) / 100 AS unit_price,
         round_even(coalesce(price, unit * q) * 100, 0) / 100 AS product_price
  FROM amounts
),
judged AS (
  SELECT id, CASE WHEN bad_date THEN NULL ELSE day END AS purchase_date,
         {_TITLE.format("name")} AS product_id, {_TITLE.format("s_name")} AS market_id,
         quantity, unit_price, product_price, key AS access_key, url AS nfce_url,
         CASE WHEN bad_date THEN 'date' WHEN no_product THEN 'product'
              WHEN product_price IS NULL THEN 'price' END AS reason
  FROM settled
),
bronze AS (SELECT * FROM judged WHERE reason IS NULL)"""

_RAW_TEXT = """
raw_text AS (
  SELECT CASE WHEN l_tax = 0.08 AND l_returnflag = 'A' THEN 'not a date'
              WHEN l_linenumber = 2 THEN strftime(purchase_date, '%m/%d/%Y')
              WHEN l_linenumber = 3 THEN strftime(purchase_date, '%Y-%m-%d') || ' 10:30:00'
              WHEN l_linenumber = 4 THEN strftime(purchase_date, '%b %-d, %Y')
              WHEN l_linenumber = 5 THEN strftime(purchase_date, '%Y%m%d')
              ELSE strftime(purchase_date, '%Y-%m-%d') END AS purchase_date,
         CASE WHEN l_discount = 0.1 AND l_tax = 0.0 THEN '  '
              WHEN l_linestatus = 'O'
                THEN chr(9) || ' ' || upper(p_name) || '-' || p_partkey || 'kg '
              ELSE product_id END AS product_id,
         CASE WHEN l_returnflag = 'N' AND l_tax = 0.01 THEN 'abc' WHEN l_tax = 0.02 THEN ''
              ELSE CAST(product_price AS VARCHAR) END AS product_price,
         CASE WHEN l_linenumber = 6 THEN '' WHEN l_discount = 0.03 THEN '-2'
              ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS quantity,
         CASE WHEN l_linestatus = 'F' THEN 'nan'
              ELSE CAST(CAST(unit_price AS DECIMAL(10,2)) AS VARCHAR) END AS unit_price,
         chr(10) || lower(s_name) || ' ' AS market_id,
         CASE l_linenumber WHEN 1 THEN ' ' || access_key WHEN 2 THEN 'nan' WHEN 3 THEN ''
              ELSE 'None' END AS access_key,
         CASE WHEN l_returnflag = 'R' THEN nfce_url ELSE ' ' END AS nfce_url
  FROM purchases
)"""

_BRONZE_SILVER = f"""
gaps AS (
  SELECT *, CAST(round(product_price * 100) AS BIGINT) AS cents,
         date_diff('day', lag(CAST(purchase_date AS DATE)) OVER (
           PARTITION BY product_id ORDER BY purchase_date), CAST(purchase_date AS DATE)) AS between
  FROM bronze
),
products AS (
  SELECT product_id, max(purchase_date) AS last_purchase_date,
         {_ratio("sum(between) * 100", "count(between)")} AS avg_days_purchase,
         {_ratio("sum(cents)", "count(*)")} AS avg_product_price,
         CAST(min(cents) AS DOUBLE) / 100 AS min_product_price,
         CAST(max(cents) AS DOUBLE) / 100 AS max_product_price,
         count(*) AS total_purchases,
         CAST(date_diff('day', CAST(max(purchase_date) AS DATE), DATE '{AS_OF}') AS DOUBLE)
           AS days_last_purchase
  FROM gaps GROUP BY product_id
),
markets AS (
  SELECT market_id, CAST(sum(cents) AS DOUBLE) / 100 AS total_spent,
         {_ratio("sum(cents)", "count(DISTINCT purchase_date)")} AS avg_ticket,
         count(DISTINCT purchase_date) AS visit_count, max(purchase_date) AS last_visit
  FROM gaps GROUP BY market_id
),
monthly AS (
  SELECT substr(purchase_date, 1, 7) AS year_month, CAST(sum(cents) AS DOUBLE) / 100 AS total_spent,
         count(*) AS item_count, {_ratio("sum(cents)", "count(*)")} AS avg_price
  FROM gaps GROUP BY 1
)"""

_EDITS = """
marked AS (
  SELECT *, l_returnflag = 'R' AND l_discount = 0.1 AS removed,
         l_tax = 0.08 AS repriced, l_tax = 0.07 AS blanked
  FROM purchases
),
diff AS (
  SELECT CASE WHEN removed THEN 'deleted' WHEN repriced THEN 'updated' ELSE 'unchanged' END AS op,
         CAST(id AS VARCHAR) AS id, CASE WHEN NOT removed THEN product_id END AS product_id,
         CASE WHEN removed THEN NULL WHEN repriced THEN CAST(cents + 100 AS DOUBLE) / 100
              ELSE CAST(cents AS DOUBLE) / 100 END AS product_price
  FROM marked
  UNION ALL
  SELECT 'inserted', NULL, ' new ' || product_id || ' pão ', CAST(cents AS DOUBLE) / 100
  FROM marked WHERE l_quantity = 50
)"""

_LAYER_COLUMNS = (
    "purchase_date, product_id, product_price, quantity, unit_price, market_id, "
    "access_key, nfce_url"
)


def _with(*parts: str) -> str:
    return "WITH " + ",".join((_LINES, *parts)) + "\n"


def _silver(select: str) -> str:
    return _with(_SILVER) + select


def _curve(select: str) -> str:
    return _with(_RECURRENCE) + select


def _raw(select: str) -> str:
    return _with(_RAW) + select


def _layered(select: str) -> str:
    return _with(_RAW, _BRONZE_SILVER) + select


_DAY = "CAST(purchase_date AS VARCHAR) AS purchase_date"
_ID = "CAST(id AS VARCHAR) AS id"
_PRICE = "CAST(cents AS DOUBLE) / 100 AS product_price"
_STATS = (
    "product_id, CAST(last_purchase_date AS VARCHAR) AS last_purchase_date, avg_days_purchase, "
    "avg_product_price, min_product_price, max_product_price, total_purchases, days_last_purchase"
)
_MARKETS = (
    "market_id, total_spent, avg_ticket, visit_count, CAST(last_visit AS VARCHAR) AS last_visit"
)
_MONTHS = "year_month, total_spent, item_count, avg_price"
# crc32 of an ASCII text, byte by byte and bit by bit.
_CRC = (
    "xor(list_reduce(list_transform(range(1, length({0}) + 1), "
    "lambda i: CAST(ascii({0}[i]) AS BIGINT)), lambda acc, byte: list_reduce(range(8), "
    "lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, "
    "xor(acc, byte)), CAST(4294967295 AS BIGINT)), 4294967295)"
)

ORACLES: dict[str, str] = {
    "product_stats": _silver(f"SELECT {_STATS} FROM products"),
    "market_stats": _silver(f"SELECT {_MARKETS} FROM markets"),
    "monthly_spending": _silver(f"SELECT {_MONTHS} FROM monthly"),
    "buy_flag": _silver("SELECT product_id, buy FROM flagged"),
    "due_list": _silver("SELECT * FROM due"),
    "upcoming": _silver(
        "SELECT product_id, avg_days_purchase - days_last_purchase AS due_in_days FROM flagged "
        "WHERE NOT buy AND avg_days_purchase - days_last_purchase BETWEEN 0 AND 7"
    ),
    "restock_progress": _silver("SELECT * FROM progress WHERE days_last_purchase <= 90"),
    "restock_progress_all": _silver("SELECT * FROM progress"),
    "due_count": _silver(
        "SELECT count(*) FILTER (buy) AS due, count(*) AS products FROM flagged"
    ),
    "price_spread": _silver(
        "SELECT product_id, avg_product_price, min_product_price, max_product_price, "
        "total_purchases, CAST(round((max_product_price - min_product_price) * 100) AS DOUBLE) "
        "/ 100 AS spread FROM products"
    ),
    "price_summary": _silver(f"SELECT {_STATS} FROM products WHERE product_id = '{PRODUCT}'"),
    "product_options": _silver("SELECT product_id, total_purchases FROM products"),
    "known_products": _silver("SELECT product_id FROM products"),
    "market_share": _silver(
        f"SELECT {_MARKETS}, total_spent / (SELECT CAST(sum(cents) AS DOUBLE) / 100 "
        "FROM purchases) AS share FROM markets"
    ),
    "market_tickets": _silver(f"SELECT {_MARKETS} FROM markets"),
    "market_totals": _silver(
        "SELECT (SELECT CAST(sum(cents) AS DOUBLE) / 100 FROM purchases) AS total_spent, "
        "CAST(sum(visit_count) AS BIGINT) AS visits, "
        "(SELECT CAST(sum(cents) AS DOUBLE) / 100 FROM purchases) / sum(visit_count) "
        "AS avg_ticket, "
        "(SELECT market_id FROM markets ORDER BY visit_count DESC, market_id LIMIT 1) "
        "AS most_visited FROM markets"
    ),
    "market_buckets": _silver(
        "SELECT market_id, lower(market_id) AS market_key, "
        f"CAST({_CRC.format('lower(market_id)')} % 5 AS VARCHAR) AS bucket FROM markets"
    ),
    "monthly_trend": _silver(
        f"SELECT {_MONTHS}, CAST(sum(month_cents) OVER w AS DOUBLE) / 100 / count(*) OVER w "
        "AS rolling_avg FROM monthly "
        "WINDOW w AS (ORDER BY year_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    ),
    "monthly_detail": _silver(f"SELECT {_MONTHS} FROM monthly"),
    "month_changes": _silver("SELECT * FROM toned"),
    "month_over_month": _silver("SELECT * FROM toned ORDER BY year_month DESC LIMIT 1"),
    "latest_and_previous": _silver(
        f"SELECT {_MONTHS} FROM monthly ORDER BY year_month DESC LIMIT 2"
    ),
    "kpi_summary": _silver(
        """SELECT t.year_month AS latest_month, t.total_spent AS latest_spent,
  t.total_spent_change AS change, t.tone,
  (SELECT CAST(sum(cents) AS DOUBLE) / 100 FROM purchases) AS total_spent,
  (SELECT count(*) FROM monthly) AS months,
  (SELECT CAST(sum(visit_count) AS BIGINT) FROM markets) AS visits,
  (SELECT CAST(sum(cents) AS DOUBLE) / 100 FROM purchases)
    / (SELECT sum(visit_count) FROM markets) AS avg_ticket,
  (SELECT count(*) FROM flagged WHERE buy) AS due,
  (SELECT count(*) FROM flagged) AS products
FROM toned t ORDER BY t.year_month DESC LIMIT 1"""
    ),
    "kpi_header": _silver(
        """SELECT (SELECT CAST(sum(cents) AS DOUBLE) / 100 FROM purchases) AS total_spent,
  (SELECT total_spent_change FROM toned ORDER BY year_month DESC LIMIT 1) AS change,
  (SELECT string_agg(year_month || '=' || CAST(CAST(CAST(month_cents AS DECIMAL(20,0)) / 100
     AS DECIMAL(20,2)) AS VARCHAR), ',' ORDER BY year_month) FROM monthly) AS series,
  (SELECT product_id FROM products ORDER BY total_purchases DESC, product_id LIMIT 1)
    AS most_bought,
  (SELECT max(total_purchases) FROM products) AS purchases,
  (SELECT min(days_last_purchase) FROM products) AS days_since_purchase,
  (SELECT market_id FROM markets ORDER BY visit_count DESC, market_id LIMIT 1)
    AS favourite_market,
  (SELECT max(visit_count) FROM markets) AS visits"""
    ),
    "ranked_overdue": _silver(
        "SELECT product_id, overdue_days FROM due ORDER BY overdue_days DESC, product_id LIMIT 12"
    ),
    "ranked_spend": _silver(
        "SELECT market_id, total_spent, total_spent / (SELECT CAST(sum(cents) AS DOUBLE) / 100 "
        "FROM purchases) AS share FROM markets ORDER BY total_spent DESC, market_id LIMIT 12"
    ),
    "ranked_ticket": _silver(
        "SELECT market_id, avg_ticket FROM markets ORDER BY avg_ticket DESC, market_id LIMIT 12"
    ),
    "table_page": _silver(
        "SELECT *, (SELECT count(*) FROM due) AS total_rows FROM due "
        "ORDER BY days_last_purchase / avg_days_purchase DESC, product_id LIMIT 15"
    ),
    "latest_purchase": _with()
    + "SELECT CAST(max(purchase_date) AS VARCHAR) AS latest_purchase FROM purchases",
    "price_history": _with()
    + f"SELECT {_ID}, {_DAY}, product_id, {_PRICE}, market_id FROM purchases "
    f"WHERE product_id = '{PRODUCT}'",
    "price_evolution": _with()
    + f"SELECT {_ID}, {_DAY}, product_id, {_PRICE}, market_id FROM purchases WHERE product_id IN "
    "(SELECT DISTINCT product_id FROM purchases ORDER BY product_id LIMIT 3)",
    "last_and_prior": _with(_ALERTS) + "SELECT * FROM priors",
    "price_alerts": _with(_ALERTS)
    + "SELECT * FROM alerts ORDER BY variation_pct DESC, product_id LIMIT 15",
    "price_alerts_all": _with(_ALERTS) + "SELECT * FROM alerts",
    "purchase_gaps": _silver(
        f"SELECT product_id, {_DAY}, days_between, count(*) AS n FROM gaps GROUP BY ALL"
    ),
    "recurrence_gaps": _curve(
        "SELECT market_id, product_id, gap, count(*) AS n FROM market_gaps "
        "WHERE gap IS NOT NULL GROUP BY ALL"
    ),
    "recurrence_curve": _curve("SELECT * FROM curve"),
    "curve_with_market_total": _curve(
        "SELECT CASE WHEN scope = 'Supplier#000000001' THEN 'Total' ELSE scope END AS scope, "
        "scope = 'Total' AS is_whole, days, cumulative_pct FROM curve"
    ),
    "curve_for_scopes": _curve(
        "SELECT * FROM curve WHERE scope = 'Total' OR scope IN (SELECT market_id FROM purchases "
        "WHERE market_id IN (SELECT scope FROM sizes) GROUP BY market_id "
        "ORDER BY count(*) DESC, market_id LIMIT 3)"
    ),
    "scope_list": _curve("SELECT scope FROM sizes"),
    "median_repurchase_days": _curve(
        "SELECT CAST(min(days) AS DOUBLE) AS median_days FROM curve "
        "WHERE scope = 'Total' AND cumulative_pct >= 0.5"
    ),
    "market_frequency": _with()
    + "SELECT market_id, count(*) AS lines FROM purchases GROUP BY market_id",
    "raw_to_bronze": _raw(
        f"SELECT CAST(id AS VARCHAR) AS raw_id, {_LAYER_COLUMNS} FROM bronze"
    ),
    "drop_invalid_price": _raw(
        "SELECT CAST(id AS VARCHAR) AS raw_id, reason FROM judged WHERE reason IS NOT NULL"
    ),
    "clean_name": _raw(f"SELECT {_ID}, product_id FROM judged"),
    "parse_purchase_date": _raw(f"SELECT {_ID}, purchase_date FROM judged"),
    "coerce_number": _raw(
        f"SELECT {_ID}, price AS product_price, qty AS quantity, unit AS unit_price FROM spoiled"
    ),
    "reconcile_amounts": _raw(f"SELECT {_ID}, quantity, unit_price, product_price FROM settled"),
    "clean_receipt_meta": _raw(f"SELECT {_ID}, access_key, nfce_url FROM judged"),
    "derive_total_on_ingest": _with()
    + f"SELECT {_ID}, l_quantity * unit_price AS product_price FROM purchases",
    "is_blank_purchase": _with(_EDITS)
    + "SELECT blank, count(*) AS n FROM (SELECT blanked AS blank FROM marked WHERE NOT removed "
    "UNION ALL SELECT false FROM marked WHERE l_quantity = 50) GROUP BY blank",
    "conform_receipt_columns": _raw(
        f"SELECT {_ID}, CASE WHEN bad_date THEN NULL ELSE day END AS purchase_date, "
        "price AS product_price, qty AS quantity, unit AS unit_price, "
        "CAST(NULL AS VARCHAR) AS access_key, CAST(NULL AS VARCHAR) AS nfce_url FROM spoiled"
    ),
    "unprocessed_raw": _raw(f"SELECT {_ID} FROM judged WHERE reason IS NOT NULL"),
    "distinct_processed_ids": _raw("SELECT CAST(id AS VARCHAR) AS raw_id FROM bronze"),
    "raw_row_count": _with() + "SELECT count(*) AS n FROM purchases",
    "match_known_products": _raw(
        f"SELECT {_ID}, CASE WHEN no_product THEN '' ELSE p_name || ' ' || p_partkey END "
        "AS matched_name FROM spoiled"
    ),
    "match_similar_products": _with(
        f"""
known AS (
  SELECT {_TITLE.format("product_id")} AS known, lower(product_id) AS k, count(*) AS bought
  FROM purchases GROUP BY ALL),
printed AS (
  SELECT id, CASE l_linenumber WHEN 1 THEN regexp_replace(product_id, '^(.)(.)', '\\1')
    WHEN 2 THEN regexp_replace(upper(product_id), '([A-Z]{{4}})[A-Z]*', '\\1.', 'g')
    WHEN 3 THEN 'x' || product_id || 'y' ELSE ' ' || upper(product_id) END AS name
  FROM purchases),
spelled AS (
  SELECT name, lower(trim(name)) AS same, trim(regexp_replace(lower(name), '[ .]+', ' ', 'g')) AS p
  FROM (SELECT DISTINCT name FROM printed)),
exact AS (SELECT name, known FROM spelled JOIN known ON same = k),
rest AS (
  SELECT DISTINCT p, string_split(p, ' ') AS w FROM spelled
  WHERE name NOT IN (SELECT name FROM exact)),
words AS (SELECT *, string_split(k, ' ') AS v FROM known),
short AS (
  SELECT p, 0 AS rank, 0 AS edits, bought, known FROM rest JOIN words
    ON len(w) = len(v) AND left(w[1], 3) = left(v[1], 3)
  WHERE len(list_filter(w, lambda x, i: NOT (x = v[i] OR (length(x) >= 3 AND starts_with(v[i], x)))))
    = 0),
edited AS (
  SELECT p, 1 AS rank, levenshtein(p, k) AS edits, bought, known FROM rest JOIN known
    ON abs(length(p) - length(k)) <= 1 AND levenshtein(p, k) <= 1),
best AS (
  SELECT p, known, rank FROM (SELECT * FROM short UNION ALL SELECT * FROM edited)
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY rank, edits, bought DESC, known) = 1)"""
    )
    + f"""SELECT {_ID}, s.name AS product_id,
  coalesce(e.known, b.known, {_TITLE.format("trim(s.name)")}) AS matched_name,
  CASE WHEN e.known IS NOT NULL THEN 'same' WHEN b.rank = 0 THEN 'short' WHEN b.rank = 1 THEN 'edited'
    ELSE 'new' END AS matched_by
FROM printed d JOIN spelled s USING (name) LEFT JOIN exact e USING (name)
LEFT JOIN best b ON b.p = s.p""",
    "diff_purchases": _with(_EDITS) + "SELECT * FROM diff",
    "edit_counts": _with(_EDITS) + "SELECT op, count(*) AS n FROM diff GROUP BY op",
    "deleted_ids": _with(_EDITS) + "SELECT id FROM diff WHERE op = 'deleted'",
    "apply_purchase_edits": _with(_EDITS)
    + f"""SELECT {_ID}, {_DAY},
  CASE WHEN repriced THEN {_TITLE.format("product_id")} ELSE product_id END AS product_id,
  CAST(quantity AS DOUBLE) AS quantity, unit_price,
  CAST(cents + CASE WHEN repriced THEN 100 ELSE 0 END AS DOUBLE) / 100 AS product_price,
  CASE WHEN repriced THEN {_TITLE.format("market_id")} ELSE market_id END AS market_id,
  access_key, nfce_url
FROM marked WHERE NOT removed
UNION ALL
SELECT NULL, {_DAY}, 'New ' || {_TITLE.format("product_id")} || ' Pão', CAST(1 AS DOUBLE),
  CAST(cents AS DOUBLE) / 100, CAST(cents AS DOUBLE) / 100, {_TITLE.format("market_id")},
  access_key, nfce_url
FROM marked WHERE l_quantity = 50""",
    "scan_purchases_csv": _with()
    + f"""SELECT {_ID}, {_DAY}, product_id || ' "extra", grande' AS product_id,
  CAST(product_price AS VARCHAR) AS product_price, CAST(quantity AS VARCHAR) AS quantity,
  CAST(CAST(unit_price AS DECIMAL(10,2)) AS VARCHAR) AS unit_price, market_id,
  CASE WHEN quantity > 25 THEN access_key END AS access_key,
  CASE WHEN quantity <> 1 THEN nfce_url END AS nfce_url
FROM purchases""",
    "receipt_rejects": _with()
    + """SELECT 'unreadable ' || product_id AS text, 'receipt' AS reason, count(*) AS n
FROM purchases WHERE quantity % 7 = 0 GROUP BY product_id""",
    "oversized_amounts": _with()
    + f"SELECT {_ID}, 'amount' AS reason FROM purchases WHERE quantity IN (7, 9)",
    "scan_receipt_json": _with()
    + f"""SELECT {_DAY}, product_id, CAST(quantity AS DOUBLE) AS quantity, unit_price, {_PRICE},
  market_id, access_key, nfce_url FROM purchases""",
    "export_due_csv": _silver(
        "SELECT product_id, last_purchase_date, overdue_days, total_purchases FROM due"
    ),
    "scan_raw": _with(_RAW_TEXT) + f"SELECT {_LAYER_COLUMNS}, 'csv' AS source_type FROM raw_text",
    "ingest_to_raw": _with(_RAW_TEXT)
    + """SELECT 'csv' AS source_type, count(*) AS n, count(*) AS ids, count(*) AS id_span,
  CAST(sum(TRY_CAST(product_price AS DECIMAL(10,2))) AS DOUBLE) AS spent FROM raw_text
UNION ALL
SELECT 'ocr', count(*), count(*), count(*),
  CAST(sum(CAST(CAST(l_quantity * unit_price AS VARCHAR) AS DECIMAL(10,2))) AS DOUBLE)
FROM purchases""",
    "scan_bronze": _raw("SELECT purchase_date, product_id, product_price, market_id FROM bronze"),
    "scan_bronze_editable": _raw(f"SELECT {_LAYER_COLUMNS} FROM bronze"),
    "append_bronze": _raw(f"SELECT {_LAYER_COLUMNS} FROM bronze"),
    "raw_to_bronze_stream": _raw(
        f"SELECT {_LAYER_COLUMNS} FROM bronze UNION ALL SELECT {_LAYER_COLUMNS} FROM bronze"
    ),
    "refresh_layers": _layered(f"SELECT {_STATS} FROM products"),
    "scan_product_stats": _layered(
        f"SELECT {_STATS}, coalesce(days_last_purchase > avg_days_purchase, false) AS buy "
        "FROM products"
    ),
    "scan_market_stats": _layered(f"SELECT {_MARKETS} FROM markets"),
    "scan_monthly_spending": _layered(f"SELECT {_MONTHS} FROM monthly"),
    "refresh_silver": _layered(f"SELECT {_MARKETS} FROM markets"),
    "silver_after_changes": _with(
        _RAW.replace("\nbronze AS", "\nonce AS"),
        """
bronze AS (
  SELECT * FROM once UNION ALL SELECT * FROM once WHERE NOT starts_with(product_id, 'Old'))""",
        _BRONZE_SILVER,
    )
    + f"SELECT {_STATS} FROM products",
    "apply_edits_to_layers": _raw(
        f"""SELECT purchase_date, product_id, CASE WHEN starts_with(product_id, 'New')
  THEN round((product_price + 1) * 100) / 100 ELSE product_price END AS product_price,
  quantity, unit_price, market_id, access_key, nfce_url
FROM bronze WHERE NOT starts_with(product_id, 'Old')
UNION ALL
SELECT {_LAYER_COLUMNS} FROM bronze, range(2) WHERE quantity = 50"""
    ),
    "evolve_tables": _with()
    + f"""SELECT {_DAY}, product_id, {_PRICE}, CAST(1 AS DOUBLE) AS quantity,
  CAST(cents AS DOUBLE) / 100 AS unit_price, market_id, CAST(NULL AS VARCHAR) AS access_key,
  CAST(NULL AS VARCHAR) AS nfce_url FROM purchases""",
    "evolve_schema": _with()
    + f"""SELECT {_ID}, {_DAY}, product_id, {_PRICE}, market_id, CAST(1 AS DOUBLE) AS quantity,
  CAST(cents AS DOUBLE) / 100 AS unit_price, CAST(NULL AS VARCHAR) AS access_key,
  CAST(NULL AS VARCHAR) AS nfce_url FROM purchases""",
    "migrate_legacy": _with()
    + f"""SELECT {_DAY}, product_id, CAST(product_price AS VARCHAR) AS product_price,
  '' AS quantity, '' AS unit_price, market_id, '' AS access_key, '' AS nfce_url,
  'migration' AS source_type FROM purchases""",
    "receipt_items": _with()
    + f"""SELECT {_ID}, CAST(l_quantity AS DOUBLE) AS quantity, unit_price, upper(p_name) AS name,
  CASE WHEN l_returnflag = 'A' THEN CAST(CAST(round(unit_price * 100) AS BIGINT)
    * CAST(l_quantity AS BIGINT) AS DOUBLE) / 100 END AS total,
  {_DAY}, CASE WHEN l_linestatus = 'F' THEN access_key END AS access_key,
  l_returnflag = 'R' AS url_ok FROM purchases""",
    "whole_receipts": _with()
    + f"""SELECT CAST(l_orderkey AS VARCHAR) AS receipt_id, {_DAY},
  {_TITLE.format("p_name")} AS product_id, CAST(l_quantity AS DOUBLE) AS quantity, unit_price,
  CAST(paid AS DOUBLE) / 100 AS product_price, 'Mercado ' || l_orderkey % 50 || 'A' AS market_id,
  CASE WHEN l_orderkey % 4 <> 0 THEN access_key END AS access_key, nfce_url,
  CAST(sum(paid) OVER r + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS DOUBLE) / 100
    AS receipt_total,
  CAST(sum(paid) OVER r AS DOUBLE) / 100 AS items_total, l_orderkey % 10 <> 0 AS adds_up
FROM (SELECT *, CAST(round(unit_price * 100) AS BIGINT) * CAST(l_quantity AS BIGINT) AS paid
  FROM purchases)
WINDOW r AS (PARTITION BY l_orderkey)""",
}
