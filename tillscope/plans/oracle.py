"""DuckDB oracle SQL for every registered query.

Written apart from the Spark plans: windows with ``row_number`` where
Spark uses ``max(struct)``, direct range predicates where Spark rewrites a
band or window condition into an equi-join, and correlated ``EXISTS`` where
Spark uses semi/anti joins. Only the driver tables are visible, so each
statement starts with the fixture derivations (same as
``tillscope.sources.fixtures``).
"""

from __future__ import annotations

TZ = "Australia/Sydney"
TEST = "user7@example.com"
REPLAY = "https://replay.example.com/replay/"
CRM = "https://crm.example.com/contacts/"


def loc(x: str) -> str:
    """UTC wall time -> Sydney wall time."""
    return f"timezone('{TZ}', timezone('UTC', {x}))"


def ldate(x: str) -> str:
    return f"CAST({loc(x)} AS DATE)"


def norm(e: str) -> str:
    return f"trim(replace(lower({e}), '[at]', '@'))"


def not_test(e: str) -> str:
    return f"{norm(e)} IS DISTINCT FROM '{TEST}'"


PAID = "(payment_status IS NOT DISTINCT FROM 'FULLY_CHARGED')"
SHOP = (
    "((host = 'care.example.com' AND starts_with(pathname, '/patient')) "
    "OR host = 'shop.example.com' OR host = 'pay.example.com')"
)

MASKED = "concat(CASE WHEN k % 5 = 0 THEN 'User' ELSE 'user' END, CAST(user_id AS VARCHAR), '[at]example.com')"

FIXTURES = f"""
ev AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
logins AS (
  SELECT event_id AS login_id, {MASKED} AS email,
         CASE WHEN k % 11 = 0 THEN NULL ELSE k - 40 END AS allowance, ts AS created_at
  FROM ev WHERE event_type = 'view'),
carts AS (
  SELECT event_id AS cart_id, {MASKED} AS email,
         CASE WHEN k % 7 = 0 THEN NULL ELSE k % 2 = 0 END AS is_converted, ts AS created_at
  FROM ev WHERE event_type = 'click'),
treatment_plans AS (
  SELECT concat('user', CAST(o_custkey AS VARCHAR), '@example.com') AS email, o_orderdate AS created_at
  FROM orders),
shop_orders AS (
  SELECT CAST(event_id AS VARCHAR) AS number, concat('user', CAST(user_id AS VARCHAR), '@example.com') AS email,
         CASE WHEN k % 4 < 2 THEN 'NOT_CHARGED' ELSE 'FULLY_CHARGED' END AS payment_status,
         CASE WHEN k % 3 = 0 THEN 'UNFULFILLED' ELSE 'FULFILLED' END AS status,
         CAST(value AS DECIMAL(18,2)) AS total,
         CASE WHEN k % 13 = 0 THEN 'NZD' WHEN k % 17 = 0 THEN 'USD' ELSE 'AUD' END AS currency, ts AS created
  FROM ev WHERE event_type = 'purchase'),
activity0 AS (
  SELECT event_id, ts,
         CASE event_type
           WHEN 'view' THEN 'cart_added'
           WHEN 'click' THEN 'checkout_initiated'
           WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'payment_page_visit' ELSE 'payment_initiated' END
           WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'payment_success' ELSE 'purchase_completed' END
           WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'payment_error' ELSE '$exception' END
         END AS event,
         user_id AS person_id, concat('user', CAST(user_id AS VARCHAR), '@example.com') AS email,
         concat_ws('-', CAST(user_id AS VARCHAR), strftime(ts, '%Y%m%d'), CAST(hour(ts) // 6 AS VARCHAR)) AS session_id,
         CASE WHEN k % 4 = 2 THEN 'shop.example.com' WHEN k % 4 = 3 THEN 'pay.example.com'
              ELSE 'care.example.com' END AS host,
         CASE WHEN k % 4 = 0 THEN concat('/patient/', CAST(k AS VARCHAR)) WHEN k % 4 = 1 THEN '/other'
              ELSE '/' END AS pathname
  FROM ev),
activity AS (SELECT *, 'https://' || host || pathname AS current_url FROM activity0),
customers AS (
  SELECT concat('user', CAST(c_custkey AS VARCHAR), '@example.com') AS email,
         CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'Customer' END AS first_name,
         CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS last_name
  FROM customer),
contacts AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS full_name,
         CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'Customer' END AS first_name,
         CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS last_name,
         concat('user', CAST(c_custkey AS VARCHAR), '@example.com') AS email,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('0400', CAST(c_custkey AS VARCHAR)) END AS phone
  FROM customer)"""

# A4: purchases of every local day, test account removed, one row per number.
PURCHASES = f"""
p AS (
  SELECT {ldate('created')} AS local_date, number, email, payment_status, total, currency, status,
         created AS purchase_time
  FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY created DESC) AS rn
        FROM shop_orders WHERE {not_test('email')})
  WHERE rn = 1)"""


def latest_logins(with_allowance: bool = False) -> str:
    cond = "WHERE allowance > 0" if with_allowance else ""
    return f"""
lg AS (
  SELECT local_date, email, allowance, created_at, login_id FROM (
    SELECT *, row_number() OVER (PARTITION BY local_date, email
                                 ORDER BY created_at DESC NULLS LAST, login_id DESC) AS rn
    FROM (SELECT *, {ldate('created_at')} AS local_date FROM logins {cond}))
  WHERE rn = 1 AND {not_test('email')})"""


def login_audit(with_allowance: bool = False) -> str:
    return f"""{latest_logins(with_allowance)},
os AS (SELECT {norm('email')} AS email_key, count(*) AS order_count, max(created_at) AS last_order_utc
       FROM carts WHERE is_converted = true GROUP BY 1),
tp AS (SELECT {norm('email')} AS email_key, max(created_at) AS tp_utc FROM treatment_plans GROUP BY 1),
audit AS (
  SELECT lg.local_date, lg.email, lg.allowance, {loc('lg.created_at')} AS login_time,
         {loc('os.last_order_utc')} AS last_order_at, coalesce(os.order_count, 0) AS order_count,
         {loc('tp.tp_utc')} AS tp_date
  FROM lg LEFT JOIN os ON {norm('lg.email')} = os.email_key
          LEFT JOIN tp ON {norm('lg.email')} = tp.email_key)"""


FLAGS = f"""
f AS (SELECT local_date, {norm('email')} AS email_key, bool_or({PAID}) AS paid, bool_or(NOT {PAID}) AS pending
      FROM p WHERE email IS NOT NULL AND email <> '' GROUP BY 1, 2),
flagged AS (
  SELECT audit.*, coalesce(f.paid, false) AS has_purchased,
         coalesce(f.pending, false) AND NOT coalesce(f.paid, false) AS has_unpaid
  FROM audit LEFT JOIN f ON audit.local_date = f.local_date AND {norm('audit.email')} = f.email_key)"""


def spine(src: str) -> str:
    """Dense date spine from min to max local_date of ``src`` (a SELECT)."""
    return f"""
spine AS (
  SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE)
         AS local_date
  FROM (SELECT min(local_date) AS lo, max(local_date) AS hi FROM ({src})))"""


#: The last copies of ``amended_orders_from``.
AMENDED = """SELECT CAST(event_id AS VARCHAR) AS number, email, status, currency, created,
             CASE WHEN k % 10 = 0 THEN 'FULLY_REFUNDED' WHEN k % 5 = 0 THEN 'FULLY_CHARGED' ELSE payment_status END AS payment_status,
             CAST(CASE WHEN k % 5 = 0 THEN total + 1 ELSE total END AS DECIMAL(18,2)) AS total
      FROM shop_orders JOIN (SELECT event_id, k FROM ev) ON number = CAST(event_id AS VARCHAR)"""


def w(*ctes: str) -> str:
    return "WITH " + ",".join((FIXTURES,) + ctes) + "\n"


def _back(alias: str, days: int) -> str:
    return (
        f"LEFT JOIN h {alias} ON {alias}.local_date = CAST(sh.local_date - {days} AS DATE) "
        f"AND {alias}.hour = sh.hour AND {alias}.currency = sh.currency"
    )


HISTORY = f"""
h AS (SELECT local_date, CAST(hour({loc('purchase_time')}) AS INTEGER) AS hour, currency, sum(total) AS gross
      FROM p WHERE {PAID} GROUP BY 1, 2, 3),
sh AS (SELECT spine.local_date, CAST(hr AS INTEGER) AS hour, coalesce(c.currency, 'AUD') AS currency
       FROM spine LEFT JOIN (SELECT DISTINCT CAST(h.local_date + s.days AS DATE) AS local_date, currency
                             FROM h, (VALUES (0), (1), (7), (28)) s(days)) c USING (local_date), range(24) t(hr)),
hist AS (
  SELECT sh.local_date, sh.hour, CAST(sh.hour AS VARCHAR) || ':00' AS hour_label, sh.currency,
         CAST(coalesce(a.gross, 0) AS DECIMAL(18,2)) AS today,
         CAST(coalesce(b.gross, 0) AS DECIMAL(18,2)) AS yesterday,
         CAST(coalesce(c.gross, 0) AS DECIMAL(18,2)) AS ago7d,
         CAST(coalesce(d.gross, 0) AS DECIMAL(18,2)) AS ago28d
  FROM sh {_back('a', 0)} {_back('b', 1)} {_back('c', 7)} {_back('d', 28)})"""

FUNNEL = f"""{latest_logins()},
act AS (
  SELECT CAST(ts AS DATE) AS act_date, {norm('email')} AS email_key, session_id, event, ts
  FROM activity
  WHERE event IN ('cart_added', 'checkout_initiated', 'payment_page_visit', 'payment_initiated',
                  'payment_success', 'payment_error', 'purchase_completed', '$exception')
    AND {SHOP} AND email IS NOT NULL),
roll AS (
  SELECT act_date, email_key, session_id,
         max(ts) FILTER (WHERE event = 'cart_added') AS t_cart_added,
         max(ts) FILTER (WHERE event = 'checkout_initiated') AS t_checkout_initiated,
         max(ts) FILTER (WHERE event = 'payment_page_visit') AS t_payment_page_visit,
         max(ts) FILTER (WHERE event = 'payment_initiated') AS t_payment_initiated,
         max(ts) FILTER (WHERE event = 'payment_error') AS t_payment_error,
         max(ts) FILTER (WHERE event = 'payment_success') AS t_payment_success,
         max(ts) FILTER (WHERE event = 'purchase_completed') AS t_purchase_completed,
         count(*) FILTER (WHERE event = 'payment_error') AS payment_error_count,
         count(*) FILTER (WHERE event = '$exception') AS exception_count,
         max(ts) AS last_activity
  FROM act
  WHERE EXISTS (SELECT 1 FROM lg WHERE lg.local_date = act.act_date AND {norm('lg.email')} = act.email_key)
  GROUP BY 1, 2, 3),
best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY act_date, email_key
                                 ORDER BY last_activity DESC NULLS LAST, session_id DESC NULLS LAST) AS rn
    FROM roll) WHERE rn = 1),
fj AS (
  SELECT lg.local_date, lg.email, lg.created_at AS login_time,
         CASE WHEN b.session_id <> '' THEN b.session_id END AS session_id,
         b.t_cart_added IS NOT NULL AS cart_added,
         b.t_checkout_initiated IS NOT NULL AS checkout_initiated,
         b.t_payment_page_visit IS NOT NULL AS payment_page_visit,
         b.t_payment_initiated IS NOT NULL AS payment_initiated,
         b.t_payment_error IS NOT NULL AS payment_error,
         b.t_payment_success IS NOT NULL AS payment_success,
         b.t_purchase_completed IS NOT NULL AS purchase_completed,
         coalesce(b.payment_error_count + b.exception_count, 0) AS error_count,
         coalesce(b.last_activity, lg.created_at) AS last_activity
  FROM lg LEFT JOIN best b ON b.act_date = lg.local_date AND b.email_key = {norm('lg.email')}),
funnel AS (
  SELECT local_date, email, login_time, session_id,
         CASE WHEN purchase_completed THEN 'purchase_completed' WHEN payment_success THEN 'payment_success'
              WHEN payment_error THEN 'payment_error' WHEN payment_initiated THEN 'payment_initiated'
              WHEN payment_page_visit THEN 'payment_page_visit' WHEN checkout_initiated THEN 'checkout_initiated'
              WHEN cart_added THEN 'cart_added' END AS furthest_stage,
         cart_added, checkout_initiated, payment_page_visit, payment_initiated, payment_error, payment_success,
         purchase_completed, error_count > 0 AS has_error, error_count,
         '{REPLAY}' || session_id AS replay_url, last_activity
  FROM fj)"""

ABANDONED_BASE = f"""
la AS (SELECT email_key, allowance FROM (
         SELECT lower(email) AS email_key, allowance,
                row_number() OVER (PARTITION BY lower(email) ORDER BY created_at DESC NULLS FIRST, login_id DESC) AS rn
         FROM logins) WHERE rn = 1),
cj AS (SELECT c.*, {ldate('c.created_at')} AS local_date, la.allowance
       FROM carts c LEFT JOIN la ON lower(c.email) = la.email_key
       WHERE c.is_converted = false)"""


def abandoned(with_allowance: bool) -> str:
    cond = "WHERE allowance > 0" if with_allowance else ""
    return f"""{ABANDONED_BASE},
ab AS (
  SELECT local_date, email, allowance AS days_allowance_remaining, created_at AS cart_created,
         {loc('created_at')} AS cart_created_local
  FROM (SELECT *, row_number() OVER (PARTITION BY local_date, email ORDER BY created_at DESC, cart_id DESC) AS rn
        FROM cj {cond})
  WHERE rn = 1 AND {not_test('email')})"""


def pct(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN CAST(round(({num} / {den}) * 100.0) AS BIGINT) ELSE 0 END"


INTENT = f"""{latest_logins()},
{PURCHASES.strip()},
{spine("SELECT local_date FROM lg UNION ALL SELECT local_date FROM p").strip()},
ls AS (SELECT local_date, count(*) AS total_logins,
              count(*) FILTER (WHERE allowance > 0) AS total_logins_with_allowance FROM lg GROUP BY 1),
ost AS (SELECT local_date, count(*) AS total_orders FROM p WHERE {PAID} GROUP BY 1),
uo AS (SELECT DISTINCT local_date AS order_date, {norm('email')} AS email_key FROM p
       WHERE status IS DISTINCT FROM 'FULFILLED' AND email IS NOT NULL AND email <> ''),
ul AS (SELECT lg.* FROM lg WHERE EXISTS (
         SELECT 1 FROM uo WHERE uo.email_key = {norm('lg.email')}
                          AND lg.local_date - uo.order_date BETWEEN 0 AND 7)),
uc AS (SELECT local_date, count(*) AS n FROM ul GROUP BY 1),
d0 AS (SELECT spine.local_date, coalesce(ost.total_orders, 0) AS total_orders,
              coalesce(ls.total_logins, 0) AS total_logins,
              coalesce(ls.total_logins_with_allowance, 0) AS total_logins_with_allowance,
              coalesce(uc.n, 0) AS logins_with_unfulfilled_orders
       FROM spine LEFT JOIN ls USING (local_date) LEFT JOIN ost USING (local_date) LEFT JOIN uc USING (local_date)),
daily AS (
  SELECT local_date, total_orders, total_logins, total_logins_with_allowance,
         greatest(0, total_logins_with_allowance - total_orders) AS did_not_buy,
         {pct('greatest(0, total_logins_with_allowance - total_orders)', 'total_logins_with_allowance')}
           AS non_conversion_percent,
         logins_with_unfulfilled_orders
  FROM d0)"""

EXPORT_DT = "'%Y-%m-%d %H:%M:%S'"


def yn(c: str) -> str:
    return f"CASE WHEN {c} THEN 'YES' ELSE 'NO' END"


ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["login_audit"] = w(login_audit().strip()) + "SELECT * FROM audit"
ORACLE_SQL["login_audit_allowance"] = w(login_audit(True).strip()) + "SELECT * FROM audit"
ORACLE_SQL["login_purchase_flags"] = w(login_audit().strip(), PURCHASES.strip(), FLAGS.strip()) + "SELECT * FROM flagged"
ORACLE_SQL["login_labels"] = w(login_audit().strip()) + """
SELECT local_date, email, coalesce(order_count, 0) AS orders_text,
       coalesce(strftime(last_order_at, '%d %b %Y'), 'No Orders') AS last_order_text,
       coalesce(strftime(tp_date, '%d %b %Y'), 'No TP Found') AS tp_text,
       strftime(login_time, '%d %b, %H:%M:%S') AS login_time_text
FROM audit"""
ORACLE_SQL["login_no_orders"] = (
    w(login_audit().strip()) + "SELECT * FROM audit WHERE last_order_at IS NULL AND allowance > 0"
)

ORACLE_SQL["purchases"] = w(PURCHASES.strip()) + "SELECT * FROM p"
ORACLE_SQL["purchases_paid"] = w(PURCHASES.strip()) + f"SELECT * FROM p WHERE {PAID}"
ORACLE_SQL["purchases_unpaid"] = w(PURCHASES.strip()) + f"""
SELECT * FROM p
WHERE NOT {PAID}
  AND NOT EXISTS (SELECT 1 FROM p q WHERE q.payment_status = 'FULLY_CHARGED'
                  AND q.local_date = p.local_date AND q.email IS NOT DISTINCT FROM p.email)"""

ORACLE_SQL["purchase_kpis"] = w(
    PURCHASES.strip(),
    spine("SELECT local_date FROM p").strip(),
    f"""
s AS (
  SELECT local_date, currency,
         CAST(coalesce(sum(total) FILTER (WHERE paid), 0) AS DECIMAL(18,2)) AS total_paid,
         count(*) FILTER (WHERE paid) AS paid_count,
         CAST(coalesce(sum(total) FILTER (WHERE NOT paid AND NOT email_paid), 0) AS DECIMAL(18,2))
           AS true_unpaid_total,
         count(*) AS n_orders
  FROM (SELECT *, {PAID} AS paid,
               bool_or({PAID}) OVER (PARTITION BY local_date, email) AS email_paid FROM p)
  GROUP BY 1, 2),
keys AS (SELECT local_date, currency FROM s UNION SELECT CAST(local_date + 1 AS DATE), currency FROM s),
cur AS (
  SELECT spine.local_date, coalesce(keys.currency, 'AUD') AS currency,
         coalesce(s.total_paid, CAST(0 AS DECIMAL(18,2))) AS total_paid,
         coalesce(s.paid_count, 0) AS paid_count,
         coalesce(s.true_unpaid_total, CAST(0 AS DECIMAL(18,2))) AS true_unpaid_total,
         coalesce(s.n_orders, 0) AS n_orders
  FROM spine LEFT JOIN keys USING (local_date)
  LEFT JOIN s ON s.local_date = spine.local_date AND s.currency = keys.currency),
prev AS (
  SELECT CAST(local_date + 1 AS DATE) AS local_date, currency, total_paid AS prev_total_paid,
         CASE WHEN paid_count > 0 THEN CAST(total_paid AS DOUBLE) / paid_count ELSE 0.0 END AS prev_aov
  FROM s)""".strip(),
) + """
SELECT cur.local_date, currency, total_paid, paid_count,
       CASE WHEN paid_count > 0 THEN CAST(total_paid AS DOUBLE) / paid_count ELSE 0.0 END AS aov,
       true_unpaid_total, n_orders,
       coalesce(prev_total_paid, CAST(0 AS DECIMAL(18,2))) AS prev_total_paid, prev_aov,
       CAST(total_paid - coalesce(prev_total_paid, 0) AS DECIMAL(18,2)) AS total_delta,
       CASE WHEN paid_count > 0 THEN CAST(total_paid AS DOUBLE) / paid_count ELSE 0.0 END - prev_aov AS aov_delta
FROM cur LEFT JOIN prev USING (local_date, currency)"""

ORACLE_SQL["hourly_sales_history"] = (
    w(PURCHASES.strip(), spine("SELECT local_date FROM p").strip(), HISTORY.strip()) + "SELECT * FROM hist"
)
ORACLE_SQL["hourly_cumulative_sales"] = w(
    PURCHASES.strip(), spine("SELECT local_date FROM p").strip(), HISTORY.strip()
) + "SELECT local_date, hour, hour_label, currency, " + ", ".join(
    f"CAST(sum({c}) OVER (PARTITION BY local_date, currency ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    f" AS DECIMAL(18,2)) AS {c}"
    for c in ("today", "yesterday", "ago7d", "ago28d")
) + " FROM hist"

ORACLE_SQL["hourly_traffic"] = w(
    PURCHASES.strip(),
    spine("SELECT local_date FROM p").strip(),
    f"""
h AS (SELECT local_date, CAST(hour({loc('purchase_time')}) AS INTEGER) AS hour, count(*) AS n FROM p GROUP BY 1, 2)""".strip(),
) + """
SELECT sh.local_date, sh.hour, CAST(sh.hour AS VARCHAR) || ':00' AS hour_label,
       coalesce(t.n, 0) AS today, coalesce(y.n, 0) AS yesterday
FROM (SELECT local_date, CAST(hr AS INTEGER) AS hour FROM spine, range(24) r(hr)) sh
LEFT JOIN h t ON t.local_date = sh.local_date AND t.hour = sh.hour
LEFT JOIN h y ON y.local_date = CAST(sh.local_date - 1 AS DATE) AND y.hour = sh.hour"""

ORACLE_SQL["weekday_comparison"] = w(
    PURCHASES.strip(),
    spine("SELECT local_date FROM p").strip(),
    f"""
d AS (SELECT local_date, CAST(sum(total) AS DECIMAL(18,2)) AS gross_sales, count(*) AS order_count,
             arg_max(currency, struct_pack(t := purchase_time, n := number)) AS currency
      FROM p WHERE {PAID} AND hour({loc('purchase_time')}) <= 19 GROUP BY 1),
pairs AS (SELECT local_date AS ref_date, CAST(local_date - CAST(7 * k AS INTEGER) AS DATE) AS local_date
          FROM spine, range(5) t(k))""".strip(),
) + """
SELECT ref_date, pairs.local_date,
       CASE WHEN pairs.local_date = ref_date THEN 'Today (' || strftime(pairs.local_date, '%A %-d %b') || ')'
            ELSE strftime(pairs.local_date, '%A %-d %b') END AS day_label,
       pairs.local_date = ref_date AS is_today,
       '00:00–19:59' AS hour_label,
       coalesce(gross_sales, CAST(0 AS DECIMAL(18,2))) AS gross_sales,
       coalesce(currency, 'AUD') AS currency,
       coalesce(order_count, 0) AS order_count
FROM pairs LEFT JOIN d ON pairs.local_date = d.local_date"""

ORACLE_SQL["login_funnel"] = w(FUNNEL.strip()) + "SELECT * FROM funnel"
ORACLE_SQL["funnel_stage_counts"] = w(FUNNEL.strip()) + """
SELECT local_date, count(*) AS records, count(*) FILTER (WHERE cart_added) AS cart_added,
       count(*) FILTER (WHERE checkout_initiated) AS checkout_initiated,
       count(*) FILTER (WHERE purchase_completed) AS purchase_completed
FROM funnel GROUP BY 1"""
ORACLE_SQL["funnel_stage_breakdown"] = w(FUNNEL.strip()) + """
SELECT local_date, coalesce(furthest_stage, 'none') AS furthest_stage, count(*) AS records FROM funnel GROUP BY 1, 2"""
ORACLE_SQL["funnel_outcome"] = w(FUNNEL.strip()) + """
SELECT local_date, email, furthest_stage,
       CASE WHEN purchase_completed OR payment_success THEN 'success' WHEN payment_error THEN 'error'
            ELSE 'none' END AS outcome
FROM funnel"""
ORACLE_SQL["session_stage_rollup"] = w(FUNNEL.strip()) + "SELECT * FROM roll"

ORACLE_SQL["live_visitors"] = w() + f"""
SELECT person_id, email, max(ts) AS last_seen,
       arg_max(current_url, struct_pack(t := ts, i := event_id)) AS current_url,
       arg_max(host, struct_pack(t := ts, i := event_id)) AS host
FROM activity
WHERE ts >= (SELECT max(ts) FROM activity) - INTERVAL 60 MINUTE
  AND ts <= (SELECT max(ts) FROM activity)
  AND {SHOP} AND email IS NOT NULL AND email <> ''
GROUP BY 1, 2"""

ORACLE_SQL["live_visitor_count"] = w() + f"""
SELECT count(*) AS count FROM (
  SELECT DISTINCT person_id, email FROM activity
  WHERE ts >= (SELECT max(ts) FROM activity) - INTERVAL 60 MINUTE
    AND ts <= (SELECT max(ts) FROM activity)
    AND {SHOP} AND email IS NOT NULL AND email <> '')"""

ORACLE_SQL["live_visitors_sliding"] = w(
    f"""
aw AS (SELECT a.*, date_trunc('minute', ts) - k * INTERVAL 1 MINUTE AS window_start
       FROM activity a, range(5) r(k)
       WHERE {SHOP} AND email IS NOT NULL AND email <> '')""".strip()
) + """
SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, person_id, email, max(ts) AS last_seen,
       arg_max(current_url, struct_pack(t := ts, i := event_id)) AS current_url,
       arg_max(host, struct_pack(t := ts, i := event_id)) AS host
FROM aw GROUP BY 1, 2, 3, 4"""

ORACLE_SQL["abandoned_carts"] = w(abandoned(False).strip()) + "SELECT * FROM ab"
ORACLE_SQL["abandoned_carts_allowance"] = w(abandoned(True).strip()) + "SELECT * FROM ab"

ORACLE_SQL["daily_intent_audit"] = w(INTENT.strip()) + "SELECT * FROM daily"
ORACLE_SQL["unfulfilled_lookups"] = w(INTENT.strip()) + "SELECT * FROM ul"
ORACLE_SQL["intent_rolling_rate"] = w(INTENT.strip()) + f"""
SELECT d.local_date, d.non_conversion_percent AS rate_day,
       {pct('(SELECT sum(did_not_buy) FROM daily x WHERE x.local_date BETWEEN d.local_date - 6 AND d.local_date)',
            '(SELECT sum(total_logins_with_allowance) FROM daily x WHERE x.local_date BETWEEN d.local_date - 6 AND d.local_date)')}
         AS rate_7d,
       {pct('(SELECT sum(did_not_buy) FROM daily x WHERE x.local_date BETWEEN d.local_date - 27 AND d.local_date)',
            '(SELECT sum(total_logins_with_allowance) FROM daily x WHERE x.local_date BETWEEN d.local_date - 27 AND d.local_date)')}
         AS rate_28d
FROM daily d"""

ORACLE_SQL["customer_order_history"] = w(
    f"""
cu AS (SELECT * FROM (
         SELECT *, {norm('email')} AS email_key,
                row_number() OVER (PARTITION BY {norm('email')}
                                   ORDER BY email DESC, first_name DESC NULLS LAST, last_name DESC NULLS LAST) AS rn
         FROM customers) WHERE rn = 1),
top AS (SELECT * FROM (
          SELECT {norm('email')} AS email_key, number, created AS date, total, currency, payment_status, status,
                 CAST(row_number() OVER (PARTITION BY {norm('email')} ORDER BY created DESC, number DESC) AS INTEGER)
                   AS order_rank
          FROM shop_orders) WHERE order_rank <= 10)""".strip()
) + """
SELECT cu.email, coalesce(nullif(trim(concat_ws(' ', first_name, last_name)), ''), 'Anonymous') AS name,
       order_rank, number, date, total, currency, payment_status, status
FROM cu LEFT JOIN top USING (email_key)"""

ORACLE_SQL["contact_profile"] = w(
    f"""
req AS (SELECT DISTINCT replace(email, '[at]', '@') AS requested FROM logins),
ct AS (SELECT * FROM (SELECT *, {norm('email')} AS email_key,
                             row_number() OVER (PARTITION BY {norm('email')} ORDER BY id) AS rn
                      FROM contacts) WHERE rn = 1)""".strip()
) + f"""
SELECT req.requested, ct.id,
       coalesce(nullif(ct.full_name, ''),
                nullif(trim(coalesce(ct.first_name, '') || ' ' || coalesce(ct.last_name, '')), ''),
                'Not Found') AS name,
       coalesce(nullif(ct.email, ''), req.requested) AS email,
       coalesce(nullif(ct.phone, ''), 'N/A') AS phone,
       CASE WHEN ct.id IS NOT NULL THEN '{CRM}' || ct.id END AS crm_url
FROM req LEFT JOIN ct ON {norm('req.requested')} = ct.email_key"""

ORACLE_SQL["session_replays"] = w(latest_logins().strip()) + f"""
SELECT r.local_date, r.email_key AS email, a.session_id, min(a.ts) AS start_time,
       '{REPLAY}' || a.session_id AS url
FROM (SELECT DISTINCT local_date, {norm('email')} AS email_key FROM lg) r
JOIN activity a
  ON {norm('a.email')} = r.email_key
 AND a.ts >= CAST(r.local_date - 1 AS TIMESTAMP) + INTERVAL 12 HOUR
 AND a.ts < CAST(r.local_date + 1 AS TIMESTAMP) + INTERVAL 12 HOUR
WHERE a.session_id IS NOT NULL
GROUP BY r.local_date, r.email_key, a.session_id"""

ORACLE_SQL["audit_search"] = w(PURCHASES.strip()) + """
SELECT * FROM p WHERE coalesce(contains(lower(email), 'user1') OR contains(CAST(number AS VARCHAR), 'user1'), false)"""
ORACLE_SQL["audit_sort"] = w(PURCHASES.strip()) + "SELECT * FROM p ORDER BY purchase_time DESC NULLS LAST, number"

ORACLE_SQL["export_logins"] = w(login_audit().strip(), PURCHASES.strip(), FLAGS.strip()) + f"""
SELECT local_date, email AS "Email", allowance AS "Allowance Remaining", coalesce(order_count, 0) AS "# of Orders",
       coalesce(strftime(last_order_at, '%Y-%m-%d'), 'N/A') AS "Last Order",
       coalesce(strftime(tp_date, '%Y-%m-%d'), 'N/A') AS "TP Date",
       strftime(login_time, {EXPORT_DT}) AS "Login Time", {yn('has_purchased')} AS "Purchased Today"
FROM flagged"""
ORACLE_SQL["export_purchases"] = w(PURCHASES.strip()) + f"""
SELECT local_date, number AS "Order Number", email AS "Email", total AS "Total", currency AS "Currency",
       status AS "Status", strftime(purchase_time AT TIME ZONE 'UTC' AT TIME ZONE '{TZ}', {EXPORT_DT}) AS "Purchase Time"
FROM p"""
ORACLE_SQL["export_funnel"] = w(FUNNEL.strip()) + f"""
SELECT local_date, email AS "Email", coalesce(furthest_stage, 'none') AS "Furthest Stage",
       {yn('cart_added')} AS "Cart Added", {yn('checkout_initiated')} AS "Checkout",
       {yn('payment_initiated')} AS "Payment Init",
       CASE WHEN purchase_completed OR payment_success THEN 'success' WHEN payment_error THEN 'error'
            ELSE 'none' END AS "Outcome",
       coalesce(error_count, 0) AS "Error Count", coalesce(replay_url, '') AS "Replay URL",
       coalesce(strftime(last_activity AT TIME ZONE 'UTC' AT TIME ZONE '{TZ}', {EXPORT_DT}), '') AS "Last Activity"
FROM funnel"""
ORACLE_SQL["export_abandoned"] = w(abandoned(False).strip()) + f"""
SELECT local_date, email AS "Email", days_allowance_remaining AS "Allowance Remaining",
       strftime(cart_created_local, {EXPORT_DT}) AS "Cart Created (Sydney)"
FROM ab"""
ORACLE_SQL["export_intent"] = w(INTENT.strip()) + """
SELECT local_date, strftime(local_date, '%Y-%m-%d') AS "Date", total_logins AS "Total Logins",
       total_logins_with_allowance AS "Logins With Allowance", total_orders AS "Total Orders",
       did_not_buy AS "Did Not Buy", non_conversion_percent AS "Non-Conversion %",
       logins_with_unfulfilled_orders AS "Unfulfilled Lookups"
FROM daily"""
def display(ts: str) -> str:
    return f"coalesce(strftime({loc(ts)}, '%d %b, %H:%M:%S'), 'N/A')"


ORACLE_SQL["purchase_labels"] = w(PURCHASES.strip()) + f"""
SELECT *, CASE WHEN {PAID} THEN 'PAID' ELSE 'UNPAID' END AS paid_label,
       replace(status, '_', ' ') AS status_text,
       printf('%s $%.2f', currency, CAST(total AS DOUBLE)) AS total_text,
       {display('purchase_time')} AS time_text
FROM p"""
ORACLE_SQL["funnel_labels"] = w(FUNNEL.strip()) + f"""
SELECT local_date, email,
       CASE furthest_stage WHEN 'cart_added' THEN 'Cart Added' WHEN 'checkout_initiated' THEN 'Checkout'
            WHEN 'payment_page_visit' THEN 'Payment Page' WHEN 'payment_initiated' THEN 'Payment Init'
            WHEN 'payment_error' THEN 'Payment Error' WHEN 'payment_success' THEN 'Payment Success'
            WHEN 'purchase_completed' THEN 'Purchased' ELSE 'none' END AS stage_label,
       CASE WHEN purchase_completed OR payment_success THEN 'success' WHEN payment_error THEN 'error'
            ELSE 'none' END AS outcome,
       {display('login_time')} AS login_time_text,
       {display('last_activity')} AS last_activity_text
FROM funnel"""
ORACLE_SQL["history_labels"] = (
    ORACLE_SQL["customer_order_history"].replace(
        "SELECT cu.email, coalesce(nullif(trim(concat_ws(' ', first_name, last_name)), ''), 'Anonymous') AS name,\n"
        "       order_rank, number, date, total, currency, payment_status, status\nFROM cu LEFT JOIN top USING (email_key)",
        f"""SELECT cu.email, order_rank, '#' || number AS number_text, {display('date')} AS date_text,
       printf('%s %.2f', currency, CAST(total AS DOUBLE)) AS total_text,
       CASE WHEN payment_status IS NOT DISTINCT FROM 'FULLY_CHARGED' THEN 'Paid' ELSE 'Unpaid' END AS paid_text,
       replace(status, '_', ' ') AS status_text
FROM cu JOIN top USING (email_key)""",
    )
)
ORACLE_SQL["intent_labels"] = w(INTENT.strip()) + "SELECT *, non_conversion_percent > 70 AS high_non_conversion FROM daily"

ORACLE_SQL["weekday_labels"] = ORACLE_SQL["weekday_comparison"].replace(
    "SELECT ref_date, pairs.local_date,",
    "SELECT ref_date, local_date, day_label, CASE WHEN order_count > 0 THEN printf('%s $%.2f', currency, "
    "CAST(gross_sales AS DOUBLE)) ELSE '—' END AS gross_text, CASE WHEN order_count > 0 THEN "
    "CAST(order_count AS VARCHAR) || ' order' || CASE WHEN order_count <> 1 THEN 's' ELSE '' END ELSE '—' END "
    "AS orders_text FROM (SELECT ref_date, pairs.local_date,",
) + ")"
ORACLE_SQL["sink_json_purchases"] = ORACLE_SQL["purchases"]
ORACLE_SQL["sink_csv_purchases"] = ORACLE_SQL["export_purchases"]

ORACLE_SQL["order_feed_flatten"] = w() + "SELECT * FROM shop_orders"
ORACLE_SQL["treatment_plan_peek"] = w() + "SELECT * FROM treatment_plans ORDER BY created_at DESC, email LIMIT 5"

ORACLE_SQL["purchase_kpi_labels"] = f"""
SELECT local_date,
       CASE WHEN total_paid >= prev_total_paid THEN 'up' ELSE 'down' END AS total_trend,
       abs(total_delta) AS total_delta_abs,
       CASE WHEN prev_aov IS NULL THEN NULL WHEN aov >= prev_aov THEN 'up' ELSE 'down' END AS aov_trend,
       abs(aov_delta) AS aov_delta_abs,
       printf('%s $%.2f', currency, CAST(total_paid AS DOUBLE)) AS total_paid_text
FROM ({ORACLE_SQL["purchase_kpis"]})"""


# --- day ranges and single requests ------------------------------------------
#: The registered day range (as in ``tillscope.plans.catalog``).
DAYS = "BETWEEN DATE '2024-01-10' AND DATE '2024-01-16'"
ORACLE_SQL["login_audit_days"] = ORACLE_SQL["login_audit"] + f" WHERE local_date {DAYS}"
ORACLE_SQL["purchases_days"] = ORACLE_SQL["purchases"] + f" WHERE local_date {DAYS}"
ORACLE_SQL["login_funnel_days"] = ORACLE_SQL["login_funnel"] + f" WHERE local_date {DAYS}"
ORACLE_SQL["abandoned_carts_days"] = ORACLE_SQL["abandoned_carts"] + f" WHERE local_date {DAYS}"
RANGE_SPINE = """
spine AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-16', INTERVAL 1 DAY)) AS DATE)
          AS local_date)"""
ORACLE_SQL["hourly_sales_history_days"] = w(PURCHASES.strip(), RANGE_SPINE.strip(), HISTORY.strip()) + "SELECT * FROM hist"


def _trailing(column: str, days: int) -> str:
    return f"(SELECT sum({column}) FROM daily x WHERE x.local_date BETWEEN d.local_date - {days - 1} AND d.local_date)"


ORACLE_SQL["daily_intent_days"] = w(INTENT.strip()) + f"""
SELECT d.*, {pct(_trailing('did_not_buy', 7), _trailing('total_logins_with_allowance', 7))} AS rate_7d,
       {pct(_trailing('did_not_buy', 28), _trailing('total_logins_with_allowance', 28))} AS rate_28d
FROM daily d WHERE d.local_date {DAYS}"""
ORACLE_SQL["order_feed_folders"] = ORACLE_SQL["order_feed_flatten"]
ORACLE_SQL["login_funnel_landed"] = ORACLE_SQL["login_funnel"]
ORACLE_SQL["login_audit_by_email"] = ORACLE_SQL["login_audit"]
ORACLE_SQL["audit_search_indexed"] = ORACLE_SQL["audit_search"]
ORACLE_SQL["audit_sort_page"] = ORACLE_SQL["audit_sort"] + " LIMIT 100 OFFSET 200"
ORACLE_SQL["intent_rates_stored"] = ORACLE_SQL["intent_rolling_rate"]
ORACLE_SQL["orders_table_upserts"] = w() + AMENDED
ORACLE_SQL["session_replays_day"] = w() + f"""
SELECT DATE '2024-01-10' AS local_date, {norm('a.email')} AS email, session_id, min(ts) AS start_time,
       '{REPLAY}' || session_id AS url
FROM activity a
WHERE ts >= TIMESTAMP '2024-01-09 12:00:00' AND ts < TIMESTAMP '2024-01-11 12:00:00' AND session_id IS NOT NULL
  AND {norm('a.email')} IN (SELECT {norm('email')} FROM logins)
GROUP BY 2, 3"""
ORACLE_SQL["live_visitors_hosts"] = ORACLE_SQL["live_visitors"].replace(SHOP, "host IN ('shop.example.com', 'pay.example.com')")
ORACLE_SQL["orders_masked"] = w() + "SELECT number, replace(email, '@', '[at]') AS masked FROM shop_orders"
ORACLE_SQL["customer_profile_numbers"] = f"""
SELECT email, name, count(number) AS orders, coalesce(string_agg(number, ',' ORDER BY order_rank), '') AS numbers
FROM ({ORACLE_SQL["customer_order_history"]}) GROUP BY 1, 2"""
