"""Reference SQL (DuckDB dialect) for the registered queries.

Runs on the raw test tables (region nation customer supplier part orders
lineitem ...) and restates each operator's semantics independently: window
functions and exact ``quantile_cont`` instead of the distributed plans.
Doubles are rounded to 6 decimals like ``catalog.r6``.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from cartlytics.catalog import BOOT_BLOCKS, BOOT_RESAMPLES, BOOT_SEED

_normal = NormalDist()

AS_OF = "DATE '2001-08-02'"
PERIOD = 1095
PAID = "order_status IS DISTINCT FROM 'P'"

CO = """co AS (
  SELECT o.o_custkey AS customer_id, o.o_orderkey AS order_id, o.o_orderstatus AS order_status,
         o.o_orderdate AS order_purchase_timestamp, c.c_custkey AS customer_unique_id
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

ITEMS = """items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_extendedprice AS price FROM lineitem)"""

AB = """users AS (
  SELECT o_custkey AS user_id, o_orderkey AS order_id, 'create_order' AS action,
         CAST(o_orderdate AS DATE) AS date, CAST(o_custkey % 2 AS INTEGER) AS grp FROM orders
  UNION ALL
  SELECT o_custkey, o_orderkey, 'cancel_order', CAST(o_orderdate AS DATE),
         CAST(o_custkey % 2 AS INTEGER) FROM orders WHERE o_orderstatus = 'P'),
ab_orders AS (
  SELECT l_orderkey AS order_id,
         '{' || string_agg(CAST(l_partkey AS VARCHAR), ', ' ORDER BY l_partkey) || '}' AS product_ids
  FROM lineitem GROUP BY l_orderkey),
op AS (
  SELECT order_id, TRY_CAST(p AS BIGINT) AS product_id FROM (
    SELECT order_id, unnest(string_split(regexp_replace(product_ids, '[{}]', '', 'g'), ', ')) AS p
    FROM ab_orders)),
lines AS (
  SELECT u.user_id, u.grp, u.order_id, u.date, op.product_id, p.p_retailprice AS price
  FROM users u JOIN op ON u.order_id = op.order_id JOIN part p ON p.p_partkey = op.product_id
  WHERE u.action = 'create_order'),
om AS (
  SELECT user_id, grp, order_id, date, count(product_id) AS number_of_products,
         round(coalesce(sum(price), 0), 6) AS sum_price
  FROM lines GROUP BY user_id, grp, order_id, date),
uo AS (
  SELECT user_id, grp, count(DISTINCT order_id) AS orders FROM lines GROUP BY user_id, grp),
long AS (
  SELECT 'sum_price' AS metric, grp, user_id, order_id AS unit_id, CAST(sum_price AS DOUBLE) AS value FROM om
  UNION ALL SELECT 'number_of_products', grp, user_id, order_id, CAST(number_of_products AS DOUBLE) FROM om
  UNION ALL SELECT 'orders', grp, user_id, user_id, CAST(orders AS DOUBLE) FROM uo)"""

LOGS = """logs AS (
  SELECT metric || '_log' AS metric, grp, user_id, unit_id, ln(value) AS value FROM long WHERE value > 0)"""

RFM_BASE = f"""ov AS (
  SELECT co.order_id, co.order_purchase_timestamp AS ts, co.customer_unique_id,
         coalesce(sum(l.l_extendedprice), 0) AS price
  FROM co JOIN lineitem l ON l.l_orderkey = co.order_id
  WHERE {PAID} GROUP BY co.order_id, co.order_purchase_timestamp, co.customer_unique_id),
base AS (
  SELECT customer_unique_id,
         CAST(min(datediff('day', CAST(ts AS DATE), {AS_OF})) AS INTEGER) AS recency,
         count(*) FILTER (WHERE CAST(ts AS DATE) >= {AS_OF} - {PERIOD}) AS frequency,
         round(sum(price), 6) AS monetary
  FROM ov WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id),
th AS (
  SELECT quantile_cont(recency, [0.2, 0.4, 0.6, 0.8]) AS rq,
         quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS mq,
         CAST(min(frequency) AS DOUBLE) AS fmin, CAST(max(frequency) AS DOUBLE) AS fmax FROM base),
scores AS (
  SELECT b.*,
    CASE WHEN recency <= rq[1] THEN 5 WHEN recency <= rq[2] THEN 4 WHEN recency <= rq[3] THEN 3
         WHEN recency <= rq[4] THEN 2 ELSE 1 END AS r,
    CASE WHEN fmin = fmax THEN 3
         WHEN frequency <= fmin + 1 * ((fmax - fmin) / 5) THEN 1
         WHEN frequency <= fmin + 2 * ((fmax - fmin) / 5) THEN 2
         WHEN frequency <= fmin + 3 * ((fmax - fmin) / 5) THEN 3
         WHEN frequency <= fmin + 4 * ((fmax - fmin) / 5) THEN 4 ELSE 5 END AS f,
    CASE WHEN monetary <= mq[1] THEN 1 WHEN monetary <= mq[2] THEN 2 WHEN monetary <= mq[3] THEN 3
         WHEN monetary <= mq[4] THEN 4 ELSE 5 END AS m
  FROM base b CROSS JOIN th),
segs AS (
  -- fixed values: the segment patterns and labels, as in functions/columns.py
  SELECT *, CASE
      WHEN regexp_matches(code, '[4-5][4-5][3-5]') THEN 'the_best'
      WHEN regexp_matches(code, '[4-5][1-3][3-5]') THEN 'valuable'
      WHEN regexp_matches(code, '[4-5][1-3][1-2]') THEN 'almost_new_common'
      WHEN regexp_matches(code, '[1-3][1-3][3-5]') THEN 'regular_common'
      WHEN regexp_matches(code, '[1-3][1-3][1-2]') THEN 'elder_common'
      ELSE code END AS segment
  FROM (SELECT *, CAST(r AS VARCHAR) || CAST(f AS VARCHAR) || CAST(m AS VARCHAR) AS code FROM scores))"""

RETENTION = f"""pm AS (
  SELECT DISTINCT customer_unique_id, CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS ym
  FROM co WHERE {PAID} AND customer_unique_id IS NOT NULL),
pc AS (SELECT *, min(ym) OVER (PARTITION BY customer_unique_id) AS cohort FROM pm),
cnt AS (SELECT cohort, ym AS year_month, count(*) AS customers_quantity FROM pc GROUP BY cohort, ym),
ret AS (
  SELECT cohort, year_month, customers_quantity,
         CAST(datediff('month', cohort, year_month) AS INTEGER) AS month_offset,
         round_even(CAST(customers_quantity AS DOUBLE) * 100
                    / max(CASE WHEN year_month = cohort THEN customers_quantity END)
                      OVER (PARTITION BY cohort), 2) AS percentage
  FROM cnt)"""


def _hist(source: str, value: str, keys: list[str], auto: bool, nbins: int = 10) -> str:
    """numpy-style equal-width histogram, restated in SQL."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    join = ("JOIN b USING (" + k + ")") if keys else "CROSS JOIN b"
    grp = ("GROUP BY " + k) if keys else ""
    if auto:
        width = f"""s AS (
  SELECT {kc}count(*) AS n, min(x) AS mn, max(x) AS mx,
         quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75 FROM v {grp}),
w AS (
  SELECT *, CAST(2 AS DOUBLE) * (q75 - q25) * pow(CAST(n AS DOUBLE), CAST(-1 AS DOUBLE) / 3) AS fd,
         (mx - mn) / (log2(CAST(n AS DOUBLE)) + 1) AS st FROM s),
e AS (
  SELECT {kc}CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
         CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi,
         CASE WHEN fd > 0 THEN least(fd, st) ELSE st END AS wd FROM w),
b AS (
  SELECT {kc}lo, hi, CASE WHEN wd > 0 THEN CAST(ceil((hi - lo) / wd) AS BIGINT) ELSE 1 END AS nb FROM e)"""
    else:
        width = f"""s AS (SELECT {kc}min(x) AS mn, max(x) AS mx FROM v {grp}),
b AS (
  SELECT {kc}CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
         CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi, CAST({nbins} AS BIGINT) AS nb FROM s)"""
    edge = "(CASE WHEN {i} = nb THEN hi ELSE {i} * ((hi - lo) / nb) + lo END)"
    return f"""WITH {source},
v AS (SELECT {kc}CAST({value} AS DOUBLE) AS x FROM src WHERE {value} IS NOT NULL),
{width},
a0 AS (
  SELECT {kc}x, lo, hi, nb,
         CAST(floor(((x - lo) / (hi - lo)) * nb) AS BIGINT) AS i0 FROM v {join}),
a1 AS (SELECT *, CASE WHEN i0 = nb THEN i0 - 1 ELSE i0 END AS i1 FROM a0),
a2 AS (SELECT *, CASE WHEN x < {edge.format(i='i1')} THEN i1 - 1 ELSE i1 END AS i2 FROM a1),
a3 AS (SELECT *, CASE WHEN x >= {edge.format(i='(i2 + 1)')} AND i2 <> nb - 1 THEN i2 + 1 ELSE i2 END AS bin FROM a2)
SELECT {kc}bin, round({edge.format(i='bin')}, 6) AS lower, round({edge.format(i='(bin + 1)')}, 6) AS upper,
       count(*) AS "count"
FROM a3 GROUP BY {kc}bin, lo, hi, nb"""


def _normality(src: str) -> str:
    n = "CAST(n AS DOUBLE)"
    return f"""m AS (
  SELECT metric, grp, count(value) AS n,
         skewness(value) * (count(value) - 2) / sqrt(CAST(count(value) AS DOUBLE) * (count(value) - 1)) AS g1,
         kurtosis_pop(value) AS ek
  FROM {src} WHERE value IS NOT NULL GROUP BY metric, grp),
z AS (
  SELECT *,
    g1 * sqrt(({n} + 1) * ({n} + 3) / (6 * ({n} - 2))) AS y,
    3 * ({n} * {n} + 27 * {n} - 70) * ({n} + 1) * ({n} + 3)
      / (({n} - 2) * ({n} + 5) * ({n} + 7) * ({n} + 9)) AS beta2,
    (ek + 3 - 3 * ({n} - 1) / ({n} + 1))
      / sqrt(24 * {n} * ({n} - 2) * ({n} - 3) / (({n} + 1) * ({n} + 1) * ({n} + 3) * ({n} + 5))) AS xk,
    6 * ({n} * {n} - 5 * {n} + 2) / (({n} + 7) * ({n} + 9))
      * sqrt(6 * ({n} + 3) * ({n} + 5) / ({n} * ({n} - 2) * ({n} - 3))) AS sb1
  FROM m),
z2 AS (
  SELECT *, -1 + sqrt(2 * (beta2 - 1)) AS w2,
         6 + 8 / sb1 * (2 / sb1 + sqrt(1 + 4 / (sb1 * sb1))) AS a FROM z),
z3 AS (
  SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z_skew,
         1 + xk * sqrt(2 / (a - 4)) AS d FROM z2),
z4 AS (
  SELECT *, (1 - 2 / (9 * a) - sign(d) * cbrt((1 - 2 / a) / abs(d))) / sqrt(2 / (9 * a)) AS z_kurt FROM z3),
z5 AS (SELECT *, z_skew * z_skew + z_kurt * z_kurt AS k2 FROM z4)
SELECT metric, grp AS "group", n, round(g1, 6) AS skew, round(ek, 6) AS kurt,
       CASE WHEN n >= 8 THEN round(z_skew, 6) END AS z_skew, CASE WHEN n >= 8 THEN round(z_kurt, 6) END AS z_kurt,
       CASE WHEN n >= 8 THEN round(k2, 6) END AS k2,
       CASE WHEN n >= 8 THEN round(exp(-k2 / 2), 6) END AS p_value,
       CASE WHEN n >= 8 THEN exp(-k2 / 2) > 0.05 END AS normal
FROM z5"""


TAIL_NODES = 40_000


def _tail(v: str, k: str, c: str) -> str:
    """Upper tail of the t, F, normal and chi-square laws by the midpoint rule over u in (0, 1),
    s = sqrt(v) + u / (1 - u): the integral of s^(k-1) (1 + c s^2)^(-(1 + k c) / (2 c)) above
    sqrt(v), by that above 0."""
    def integral(start: str) -> str:
        u = f"((i + 0.5) / {TAIL_NODES})"
        x = f"({start} + {u} / (1 - {u}))"
        power = f"(CASE WHEN {c} * {x} * {x} < 1e-6 THEN {x} * {x} * (1 - {c} * {x} * {x} / 2) ELSE ln(1 + {c} * {x} * {x}) / {c} END)"
        return f"list_sum([exp(({k} - 1) * ln({x}) - 0.5 * (1 + {k} * {c}) * {power}) / ((1 - {u}) * (1 - {u})) for i in range({TAIL_NODES})])"
    return f"(CASE WHEN {v} <= 0 THEN 1.0 ELSE {integral(f'sqrt({v})')} / {integral('0.0')} END)"


def _t_test(equal_var: bool) -> str:
    if equal_var:
        stat = """(mean_a - mean_b) / sqrt(((na - 1) * var_a + (nb - 1) * var_b) / (na + nb - 2)
                * (1 / na + 1 / nb)) AS t, na + nb - 2 AS df"""
    else:
        stat = """(mean_a - mean_b) / sqrt(var_a / na + var_b / nb) AS t,
        (var_a / na + var_b / nb) * (var_a / na + var_b / nb)
        / ((var_a / na) * (var_a / na) / (na - 1) + (var_b / nb) * (var_b / nb) / (nb - 1)) AS df"""
    return f"""WITH {AB},
g AS (
  SELECT metric,
         count(value) FILTER (WHERE grp = 0) AS n_a, avg(value) FILTER (WHERE grp = 0) AS mean_a,
         var_samp(value) FILTER (WHERE grp = 0) AS var_a,
         count(value) FILTER (WHERE grp = 1) AS n_b, avg(value) FILTER (WHERE grp = 1) AS mean_b,
         var_samp(value) FILTER (WHERE grp = 1) AS var_b
  FROM long WHERE value IS NOT NULL GROUP BY metric),
s AS (SELECT *, CAST(n_a AS DOUBLE) AS na, CAST(n_b AS DOUBLE) AS nb FROM g),
r AS (SELECT metric, n_a, n_b, mean_a, mean_b, {stat} FROM s),
p AS (SELECT *, {_tail('t * t', '1', '(1 / df)')} AS p FROM r)
SELECT metric, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
       round(t, 6) AS t, round(df, 6) AS df, round(p, 6) AS p_value, p < 0.05 AS differ FROM p"""


def _poisson_case(u: str) -> str:
    """How many of the probabilities P(X <= k), X ~ Poisson(1), are at most u."""
    upto = [math.fsum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) for k in range(20)]
    return "CASE " + " ".join(f"WHEN {u} < CAST('{c!r}' AS DOUBLE) THEN {k}" for k, c in enumerate(upto)) + f" ELSE {len(upto)} END"


def _normal_cdf(x: str) -> str:
    """Phi(x) by its series 1/2 + phi(x) (x + x^3 / 3 + x^5 / 15 + ...), the denominators being odd factorials."""
    series = f"list_sum(list_transform(range(0, 120), lambda n: {x} * pow({x} * {x}, n) / exp(lgamma(n + 1.5) - lgamma(1.5) + n * ln(2))))"
    return f"(CASE WHEN {x} > 8 THEN 1.0::DOUBLE WHEN {x} < -8 THEN 0.0::DOUBLE ELSE 0.5 + exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {series} END)"


def _normal_quantile(p: str) -> str:
    """The x with Phi(x) = p, by 64 halvings of [-9, 9]; NULL outside (0, 1)."""
    middle = "((a.lo + a.hi) / 2)"
    half = f"CASE WHEN {_normal_cdf(middle)} < {p} THEN {{'lo': {middle}, 'hi': a.hi}} ELSE {{'lo': a.lo, 'hi': {middle}}} END"
    halved = f"list_reduce(list_transform(range(0, 65), lambda i: {{'lo': -9.0::DOUBLE, 'hi': 9.0::DOUBLE}}), lambda a, b: {half})"
    return f"(CASE WHEN {p} > 0 AND {p} < 1 THEN ({halved}).lo END)"


def _md5_int(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 13)) AS BIGINT)"


BOOT = f"""blk AS (
  SELECT metric, grp, {_md5_int(f"'{BOOT_SEED}:' || CAST(unit_id AS VARCHAR)")} % {BOOT_BLOCKS} AS u,
         sum(value) AS s, CAST(count(*) AS DOUBLE) AS c
  FROM long WHERE value IS NOT NULL GROUP BY metric, grp, u),
rep AS (SELECT blk.*, r.range AS replicate FROM blk CROSS JOIN range(0, {BOOT_RESAMPLES}) r),
wt AS (
  SELECT *, {_poisson_case(f"CAST({_md5_int(f"'{BOOT_SEED}:' || CAST(u AS VARCHAR) || ':' || CAST(replicate AS VARCHAR)")} AS DOUBLE) / CAST(4503599627370496 AS DOUBLE)")} AS w
  FROM rep),
reps AS (SELECT metric, grp, replicate, sum(w * s) / sum(w * c) AS mean FROM wt GROUP BY metric, grp, replicate)"""

# the same expressions as bootstrap_mean_ci(confidence=0.95)
_ZA = _normal.inv_cdf((1.0 - 0.95) / 2.0)
_ZB = _normal.inv_cdf(1.0 - (1.0 - 0.95) / 2.0)


# the columns that the library wants of the given tables
_WANTED = [("customer", "c_custkey", "bigint"), ("customer", "c_name", "string"), ("customer", "c_nationkey", "int"), ("customer", "c_acctbal", "double"),
           ("customer", "c_mktsegment", "string"), ("orders", "o_orderkey", "bigint"), ("orders", "o_custkey", "bigint"), ("orders", "o_orderstatus", "string"),
           ("orders", "o_totalprice", "double"), ("orders", "o_orderdate", "timestamp_ntz"), ("orders", "o_orderpriority", "string"), ("lineitem", "l_orderkey", "bigint"),
           ("lineitem", "l_partkey", "bigint"), ("lineitem", "l_suppkey", "bigint"), ("lineitem", "l_linenumber", "int"), ("lineitem", "l_extendedprice", "double"),
           ("lineitem", "l_shipdate", "timestamp_ntz"), ("part", "p_partkey", "bigint"), ("part", "p_retailprice", "double")]

SQL: dict[str, str] = {
    "csv_items": """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS order_item_id, CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_suppkey AS VARCHAR) AS seller_id,
       l_shipdate AS shipping_limit_date, CASE WHEN l_orderkey % 100 <> 9 THEN round(l_extendedprice, 6) END AS price, CAST(NULL AS DOUBLE) AS freight_value
FROM lineitem WHERE l_orderkey % 100 NOT IN (7, 13)""",

    "csv_quarantine": """
SELECT concat_ws(',', l_linenumber, CASE WHEN l_orderkey % 100 = 7 THEN 'free,x' ELSE 'NA,a,b' END, l_partkey, l_linenumber,
                 strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), l_suppkey, l_orderkey) AS line,
       CASE WHEN l_orderkey % 100 = 7 THEN 'price' ELSE '_cells' END AS faults
FROM lineitem WHERE l_orderkey % 100 IN (7, 13)""",

    "csv_counts": """
SELECT c AS "column", count(*) FILTER (WHERE c = '_rows' OR (c = 'price' AND l_orderkey % 100 = 7) OR (c = '_cells' AND l_orderkey % 100 = 13)
                                       OR (c = '_bad_rows' AND l_orderkey % 100 IN (7, 13))) AS bad_cells
FROM lineitem, unnest(['_rows', '_bad_rows', '_cells', 'order_id', 'order_item_id', 'product_id', 'seller_id', 'shipping_limit_date', 'price', 'freight_value']) u(c)
GROUP BY c""",

    "schema_report": f"""
WITH wanted("table", "column", wanted) AS (VALUES {", ".join(map(str, _WANTED))}),
found AS ({" UNION ALL ".join(f"SELECT '{t}' AS t, column_name AS c, column_type AS d FROM (DESCRIBE SELECT * FROM {t})" for t in ("customer", "orders", "lineitem", "part"))}),
named AS (SELECT t, c, CASE d WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(d) END AS found FROM found)
SELECT coalesce("table", t) AS "table", coalesce("column", c) AS "column", wanted, found, 1::BIGINT AS files,
       CASE WHEN wanted IS NULL THEN 'extra' WHEN found IS NULL THEN 'missing' WHEN wanted = found THEN 'ok' ELSE 'wrong type' END AS verdict
FROM wanted FULL JOIN named ON t = "table" AND c = \"column\"""",

    "null_profile": "\nUNION ALL ".join(
        f"SELECT '{t}' AS \"table\", name AS \"column\", value AS null_count FROM "
        f"(UNPIVOT (SELECT count(*) - count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME name VALUE value)"
        for t in ("customer", "orders", "lineitem")),

    "describe_lineitem": "\nUNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS "count", round(avg(CAST({c} AS DOUBLE)), 6) AS mean,
       round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, round(CAST(max({c}) AS DOUBLE), 6) AS max
FROM lineitem""" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")),

    "contingency": f"""
WITH {AB},
r AS (SELECT grp, count(*) AS n FROM users GROUP BY grp), c AS (SELECT action, count(*) AS n FROM users GROUP BY action)
SELECT r.grp AS "group", c.action, (SELECT count(*) FROM users u WHERE u.grp = r.grp AND u.action = c.action) AS observed,
       round(CAST(r.n AS DOUBLE) * c.n / (SELECT count(*) FROM users), 6) AS expected
FROM r CROSS JOIN c""",

    "cohort_retention_range": f"""
WITH {CO}, {RETENTION},
numbered AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY year_month) AS nth FROM ret
             WHERE cohort BETWEEN DATE '1995-02-01' AND DATE '1995-09-30'),
kept AS (SELECT * FROM numbered WHERE nth <= CASE strftime(cohort, '%Y-%m') WHEN '1995-02' THEN 3 WHEN '1995-03' THEN 5 WHEN '1995-04' THEN 4
                                                  ELSE nth END)
SELECT cohort, year_month, month_offset, customers_quantity, round(percentage, 6) AS percentage,
       strftime(cohort, '%Y-%m') AS cohort_label FROM kept""",

    "histogram_cumulative_orders": _hist(f"""{AB},
daily AS (SELECT grp, date, count(DISTINCT order_id) AS n FROM om GROUP BY grp, date),
src AS (SELECT grp, sum(n) OVER (PARTITION BY grp ORDER BY date) AS total FROM daily)""", "total", ["grp"], True)
    .replace("ELSE st END AS wd FROM w", "ELSE st END AS wd0, CASE WHEN wd0 > 0 AND wd0 < 1 THEN 1.0 ELSE wd0 END AS wd FROM w")
    .replace("SELECT grp, bin, round", 'SELECT grp AS "group", bin, round'),

    "describe_price": """
SELECT 'price' AS "column", count(l_extendedprice) AS "count", round(avg(l_extendedprice), 6) AS mean,
       round(stddev_samp(l_extendedprice), 6) AS std, round(min(l_extendedprice), 6) AS min,
       round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
       round(quantile_cont(l_extendedprice, 0.75), 6) AS q75, round(max(l_extendedprice), 6) AS max
FROM lineitem""",

    "quantile_p95": """
SELECT round(quantile_cont(l_extendedprice, 0.95), 6) AS quantile FROM lineitem""",

    "price_tail": """
WITH p AS (SELECT quantile_cont(l_extendedprice, 0.95) AS p FROM lineitem)
SELECT round(any_value(p.p), 6) AS p_quantile, round(max(l_extendedprice), 6) AS max,
       round(avg(CASE WHEN l_extendedprice > p.p THEN 1.0 ELSE 0.0 END), 6) AS share_above,
       count(*) FILTER (WHERE l_extendedprice > p.p) AS n_above
FROM lineitem CROSS JOIN p""",

    "order_value_profile": """
WITH ov AS (SELECT l_orderkey, coalesce(sum(l_extendedprice), 0) AS v FROM lineitem GROUP BY l_orderkey),
long AS (SELECT 'item_price' AS col, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem
         UNION ALL SELECT 'order_value', v FROM ov)
SELECT col AS "column", count(v) AS "count", round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
       round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
       round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS max,
       round(quantile_cont(v, 0.95), 6) AS p95
FROM long GROUP BY col""",

    "value_counts_status": """
SELECT o_orderstatus AS order_status, count(*) AS "count" FROM orders
WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus""",

    "inner_join_customer_orders": f"WITH {CO} SELECT * FROM co",

    "orders_shape": "SELECT count(*) AS \"rows\", (SELECT count(*) FROM (DESCRIBE SELECT * FROM orders)) AS \"columns\" FROM orders",

    "status_shares": """
WITH c AS (SELECT o_orderstatus AS order_status, count(*) AS n FROM orders
           WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus)
SELECT order_status, n AS "count", round(round_even(CAST(n AS DOUBLE) * 100 / sum(n) OVER (), 3), 6) AS percentage
FROM c""",

    "items_join": f"""
WITH {ITEMS}
SELECT o.o_orderkey AS order_id, o.o_orderstatus AS order_status, o.o_orderdate AS order_purchase_timestamp,
       i.order_item_id, i.product_id, i.price
FROM orders o JOIN items i ON i.order_id = o.o_orderkey""",

    "explode_product_sets": f"WITH {AB} SELECT order_id, product_id FROM op",

    "one_time_buyers": f"""
WITH {CO},
per AS (SELECT customer_unique_id, count(order_id) AS n FROM co
        WHERE {PAID} AND customer_unique_id IS NOT NULL GROUP BY customer_unique_id)
SELECT count(*) FILTER (WHERE n = 1) AS one_time_buyers FROM per""",

    "undelivered_by_reason": f"""
WITH {CO},
pm AS (SELECT CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS ym, order_status,
              count(order_id) AS n FROM co WHERE order_status IN ('O', 'P') GROUP BY ym, order_status)
SELECT order_status, round(round_even(avg(n), 2), 6) AS avg_canceled FROM pm GROUP BY order_status""",

    "top_weekday_per_product": f"""
WITH x AS (
  SELECT l.l_partkey AS product_id, dayname(o.o_orderdate) AS weekday, count(*) AS quantity
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
  WHERE o.o_orderstatus IS DISTINCT FROM 'P' GROUP BY l.l_partkey, dayname(o.o_orderdate))
SELECT product_id, weekday, quantity FROM x
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY quantity DESC, weekday ASC) = 1""",

    "purchases_per_week": f"""
WITH {CO},
per AS (SELECT CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS year_month, customer_unique_id,
               count(order_id) AS quantity
        FROM co WHERE {PAID} AND customer_unique_id IS NOT NULL GROUP BY year_month, customer_unique_id),
w AS (SELECT *, CAST(day(last_day(year_month)) AS DOUBLE) / 7 AS weeks FROM per)
SELECT year_month, customer_unique_id, quantity, round(weeks, 6) AS weeks,
       round(quantity / weeks, 6) AS avg_purchases_per_week FROM w""",

    "cohort_retention": f"""
WITH {CO}, {RETENTION}
SELECT cohort, year_month, customers_quantity, month_offset, round(percentage, 6) AS percentage FROM ret""",

    "cohort_retention_compat": f"""
WITH {CO},
cohorts AS (
  SELECT customer_unique_id, CAST(date_trunc('month', min(order_purchase_timestamp)) AS DATE) AS cohort
  FROM co WHERE {PAID} AND customer_unique_id IS NOT NULL GROUP BY customer_unique_id),
act AS (
  SELECT customer_unique_id, CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS year_month,
         count(customer_unique_id) AS n
  FROM co WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id, year_month),
cnt AS (
  SELECT cohort, year_month, CAST(sum(n) AS BIGINT) AS customers_quantity
  FROM act JOIN cohorts USING (customer_unique_id) GROUP BY cohort, year_month)
SELECT cohort, year_month, customers_quantity,
       CAST(datediff('month', cohort, year_month) AS INTEGER) AS month_offset,
       round(round_even(CAST(customers_quantity AS DOUBLE) * 100
             / max(customers_quantity) OVER (PARTITION BY cohort), 2), 6) AS percentage
FROM cnt""",

    "best_cohort": f"""
WITH {CO}, {RETENTION},
third AS (SELECT cohort, percentage, customers_quantity FROM ret WHERE month_offset = 2)
SELECT cohort, round(percentage, 6) AS percentage, customers_quantity FROM third
WHERE percentage = (SELECT max(percentage) FROM third)""",

    "best_cohort_compat": f"""
WITH {CO},
cohorts AS (
  SELECT customer_unique_id, CAST(date_trunc('month', min(order_purchase_timestamp)) AS DATE) AS cohort
  FROM co WHERE {PAID} AND customer_unique_id IS NOT NULL GROUP BY customer_unique_id),
act AS (
  SELECT customer_unique_id, CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS year_month,
         count(customer_unique_id) AS n
  FROM co WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id, year_month),
cnt AS (
  SELECT cohort, year_month, CAST(sum(n) AS BIGINT) AS customers_quantity
  FROM act JOIN cohorts USING (customer_unique_id) GROUP BY cohort, year_month),
ret AS (
  SELECT cohort, year_month, customers_quantity,
         round_even(CAST(customers_quantity AS DOUBLE) * 100
                    / max(customers_quantity) OVER (PARTITION BY cohort), 2) AS percentage,
         row_number() OVER (PARTITION BY cohort ORDER BY year_month) AS rn
  FROM cnt),
third AS (SELECT cohort, percentage, customers_quantity FROM ret WHERE rn = 3)
SELECT cohort, round(percentage, 6) AS percentage, customers_quantity FROM third
WHERE percentage = (SELECT max(percentage) FROM third)""",

    "rfm_base": f"WITH {CO}, {RFM_BASE} SELECT customer_unique_id, recency, frequency, round(monetary, 6) AS monetary FROM base",

    "rfm_scores": f"""
WITH {CO}, {RFM_BASE}
SELECT customer_unique_id, recency, frequency, round(monetary, 6) AS monetary, r, f, m FROM scores""",

    "rfm_segments": f"""
WITH {CO}, {RFM_BASE}
SELECT customer_unique_id, recency, frequency, round(monetary, 6) AS monetary, r, f, m,
       code AS rfm_code, segment, segment = code AS unmapped FROM segs""",

    "segment_shares": f"""
WITH {CO}, {RFM_BASE},
c AS (SELECT segment, count(*) AS customers FROM segs GROUP BY segment)
SELECT segment, customers,
       round(round_even(CAST(customers AS DOUBLE) * 100 / sum(customers) OVER (), 3), 6) AS percentage FROM c""",

    "histogram_price_auto": _hist("src AS (SELECT l_extendedprice AS price FROM lineitem)", "price", [], True),

    "histogram_order_value_auto": _hist(
        "src AS (SELECT l_orderkey, coalesce(sum(l_extendedprice), 0) AS price FROM lineitem GROUP BY l_orderkey)",
        "price", [], True),

    "histogram_user_totals": _hist(
        f"""{AB}, {LOGS},
allm AS (SELECT * FROM long UNION ALL SELECT * FROM logs),
src AS (SELECT metric, grp AS "group", user_id, sum(value) AS value FROM allm GROUP BY metric, grp, user_id)""",
        "value", ["metric", '"group"'], False, 10),

    "ab_order_lines": f"""
WITH {AB}
SELECT product_id, user_id, order_id, 'create_order' AS action, date, grp AS "group", round(price, 6) AS price
FROM lines""",

    "ab_order_metrics": f"""
WITH {AB}
SELECT user_id, grp AS "group", order_id, date, number_of_products, round(sum_price, 6) AS sum_price FROM om""",

    "ab_user_orders": f'WITH {AB} SELECT user_id, grp AS "group", orders FROM uo',

    "split_check": f'WITH {AB} SELECT grp AS "group", count(DISTINCT user_id) AS users FROM om GROUP BY grp',

    "group_summary": f"""
WITH {AB},
s AS (SELECT grp, sum(sum_price) AS revenue, round_even(avg(sum_price), 2) AS mean_check,
             count(DISTINCT order_id) AS orders, round_even(avg(number_of_products), 2) AS mean_products
      FROM om GROUP BY grp)
SELECT grp AS "group", round(revenue, 6) AS revenue, round(mean_check, 6) AS mean_check, orders,
       round(mean_products, 6) AS mean_products,
       round(revenue * 100 / (SELECT max(revenue) FROM s WHERE grp = 0) - 100, 6) AS uplift_pct
FROM s""",

    "cumulative_orders": f"""
WITH {AB},
d AS (SELECT grp, date, count(DISTINCT order_id) AS orders FROM om GROUP BY grp, date)
SELECT grp AS "group", date, orders,
       CAST(sum(orders) OVER (PARTITION BY grp ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS BIGINT) AS cumulative_orders
FROM d""",

    "group_summary_excl_cancelled": f"""
WITH {AB},
kept AS (SELECT * FROM users u WHERE action = 'create_order'
         AND NOT EXISTS (SELECT 1 FROM users x WHERE x.action = 'cancel_order' AND x.order_id = u.order_id)),
l2 AS (SELECT k.user_id, k.grp, k.order_id, k.date, op.product_id, p.p_retailprice AS price
       FROM kept k JOIN op ON k.order_id = op.order_id JOIN part p ON p.p_partkey = op.product_id),
om2 AS (SELECT user_id, grp, order_id, date, count(product_id) AS number_of_products,
               round(coalesce(sum(price), 0), 6) AS sum_price FROM l2 GROUP BY user_id, grp, order_id, date),
s AS (SELECT grp, sum(sum_price) AS revenue, round_even(avg(sum_price), 2) AS mean_check,
             count(DISTINCT order_id) AS orders, round_even(avg(number_of_products), 2) AS mean_products
      FROM om2 GROUP BY grp)
SELECT grp AS "group", round(revenue, 6) AS revenue, round(mean_check, 6) AS mean_check, orders,
       round(mean_products, 6) AS mean_products,
       round(revenue * 100 / (SELECT max(revenue) FROM s WHERE grp = 0) - 100, 6) AS uplift_pct
FROM s""",

    "log_dropped": f"""
WITH {AB}
SELECT metric, grp AS "group", count(*) FILTER (WHERE value IS NULL OR value <= 0) AS dropped
FROM long GROUP BY metric, grp""",

    "cancel_rate": f"""
WITH {AB},
c AS (SELECT grp, count(*) FILTER (WHERE action = 'create_order') AS created,
             count(*) FILTER (WHERE action = 'cancel_order') AS cancelled FROM users GROUP BY grp)
SELECT grp AS "group", created, cancelled,
       round(CAST(cancelled AS DOUBLE) * 100 / created, 6) AS cancel_rate_pct FROM c""",

    "normality_k2": f"WITH {AB}, {_normality('long')}",

    "log_normality_k2": f"WITH {AB}, {LOGS}, {_normality('logs')}",

    "t_test_pooled": _t_test(True),

    "t_test_welch": _t_test(False),

    "levene": f"""
WITH {AB},
med AS (SELECT metric, grp, quantile_cont(value, 0.5) AS med FROM long WHERE value IS NOT NULL GROUP BY metric, grp),
z AS (SELECT l.metric, l.grp, abs(l.value - m.med) AS z FROM long l JOIN med m USING (metric, grp)
      WHERE l.value IS NOT NULL),
g AS (SELECT metric, grp, count(z) AS n, avg(z) AS zbar, coalesce(var_samp(z), 0) * (count(z) - 1) AS ss
      FROM z GROUP BY metric, grp),
g2 AS (SELECT *, sum(n * zbar) OVER (PARTITION BY metric) / sum(n) OVER (PARTITION BY metric) AS zall FROM g),
s AS (SELECT metric, CAST(sum(n) AS BIGINT) AS n, count(*) AS k,
             sum(n * (zbar - zall) * (zbar - zall)) AS between_ss, sum(ss) AS within_ss
      FROM g2 GROUP BY metric),
w AS (SELECT *, CAST(n - k AS DOUBLE) / (k - 1) * between_ss / within_ss AS w, CAST(k - 1 AS DOUBLE) AS above,
             1 / CAST(n - k AS DOUBLE) AS below FROM s),
p AS (SELECT *, {_tail('(w * above)', 'above', 'below')} AS p FROM w)
SELECT metric, n, k, round(w, 6) AS w, k - 1 AS df1, n - k AS df2, round(p, 6) AS p_value, p > 0.05 AS equal_var FROM p""",

    "mann_whitney": f"""
WITH {AB},
d AS (SELECT metric, value, count(*) AS t, count(*) FILTER (WHERE grp = 0) AS ca,
             count(*) FILTER (WHERE grp = 1) AS cb
      FROM long WHERE grp IN (0, 1) AND value IS NOT NULL GROUP BY metric, value),
r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY metric ORDER BY value
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
s AS (SELECT metric, sum(ca * (before + (CAST(t AS DOUBLE) + 1) / 2)) AS ra,
             CAST(sum(ca) AS BIGINT) AS n_a, CAST(sum(cb) AS BIGINT) AS n_b,
             sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM r GROUP BY metric),
u AS (SELECT *, ra - CAST(n_a AS DOUBLE) * (n_a + 1) / 2 AS u_a,
             CAST(n_a AS DOUBLE) * n_b / 2 AS mu,
             sqrt(CAST(n_a AS DOUBLE) * n_b / 12 * ((n_a + n_b + 1)
                  - ties / (CAST(n_a + n_b AS DOUBLE) * (n_a + n_b - 1)))) AS sd FROM s),
zs AS (SELECT *, (greatest(u_a, CAST(n_a AS DOUBLE) * n_b - u_a) - mu - 0.5) / sd AS z FROM u),
p AS (SELECT *, CASE WHEN z <= 0 THEN 1.0 ELSE {_tail('z * z', '1', '0.0')} END AS p FROM zs)
SELECT metric, n_a, n_b, round(u_a, 6) AS u_a, round(z, 6) AS z, round(p, 6) AS p_value, p < 0.05 AS differ FROM p""",

    "chi2_yates": f"""
WITH {AB},
obs AS (SELECT grp, action, count(*) AS o FROM users GROUP BY grp, action),
rt AS (SELECT grp, sum(o) AS rt FROM obs GROUP BY grp),
ct AS (SELECT action, sum(o) AS ct FROM obs GROUP BY action),
tot AS (SELECT sum(o) AS n FROM obs),
cells AS (
  SELECT rt.grp, ct.action, coalesce(obs.o, 0) AS o, CAST(rt.rt AS DOUBLE) * ct.ct / tot.n AS e
  FROM rt CROSS JOIN ct CROSS JOIN tot LEFT JOIN obs ON obs.grp = rt.grp AND obs.action = ct.action),
dof AS (SELECT (count(DISTINCT grp) - 1) * (count(DISTINCT action) - 1) AS dof FROM cells),
st AS (SELECT sum(CASE WHEN dof.dof = 1 THEN (abs(o - e) - least(0.5, abs(o - e))) * (abs(o - e) - least(0.5, abs(o - e)))
                      ELSE (o - e) * (o - e) END / e) AS statistic,
       any_value(dof.dof) AS dof
FROM cells CROSS JOIN dof),
p AS (SELECT *, {_tail('statistic', 'CAST(dof AS DOUBLE)', '0.0')} AS p FROM st)
SELECT round(statistic, 6) AS statistic, dof, round(p, 6) AS p_value, p < 0.05 AS dependent FROM p""",

    "bootstrap_replicates": f"""
WITH {AB}, {BOOT}
SELECT metric, grp AS "group", CAST(replicate AS INTEGER) AS replicate, round(mean, 6) AS mean FROM reps""",

    "bootstrap_mean_ci": f"""
WITH {AB}, {BOOT},
est AS (SELECT metric, grp, avg(value) AS est FROM long WHERE value IS NOT NULL GROUP BY metric, grp),
sh AS (
  SELECT r.metric, r.grp,
         avg(CASE WHEN r.mean < e.est THEN 1.0 ELSE 0.0 END)
           + avg(CASE WHEN r.mean = e.est THEN 1.0 ELSE 0.0 END) / 2 AS share,
         count(*) AS nr
  FROM reps r JOIN est e USING (metric, grp) WHERE r.mean IS NOT NULL GROUP BY r.metric, r.grp),
z AS (SELECT *, {_normal_quantile('CAST(share AS DOUBLE)')} AS z0 FROM sh),
lim AS (
  SELECT metric, grp, nr,
         {_normal_cdf(f"(2.0 * z0 + CAST('{_ZA!r}' AS DOUBLE))")} AS a1,
         {_normal_cdf(f"(2.0 * z0 + CAST('{_ZB!r}' AS DOUBLE))")} AS a2 FROM z),
pos AS (SELECT metric, grp, 'lo' AS side, (nr - 1) * a1 AS p FROM lim
        UNION ALL SELECT metric, grp, 'hi', (nr - 1) * a2 FROM lim),
ranked AS (SELECT metric, grp, mean, row_number() OVER (PARTITION BY metric, grp ORDER BY mean) - 1 AS i
           FROM reps WHERE mean IS NOT NULL),
picked AS (
  SELECT p.metric, p.grp, p.side, p.p,
         max(CASE WHEN r.i = floor(p.p) THEN r.mean END) AS lo,
         max(CASE WHEN r.i = ceil(p.p) THEN r.mean END) AS hi
  FROM pos p JOIN ranked r ON r.metric = p.metric AND r.grp = p.grp
   AND (r.i = floor(p.p) OR r.i = ceil(p.p))
  GROUP BY p.metric, p.grp, p.side, p.p),
ci AS (
  SELECT metric, grp,
         max(CASE WHEN side = 'lo' THEN lo + (hi - lo) * (p - floor(p)) END) AS ci_low,
         max(CASE WHEN side = 'hi' THEN lo + (hi - lo) * (p - floor(p)) END) AS ci_high
  FROM picked GROUP BY metric, grp)
SELECT e.metric, e.grp AS "group", round(e.est, 6) AS mean,
       round(round_even(c.ci_low, 2), 6) AS ci_low, round(round_even(c.ci_high, 2), 6) AS ci_high
FROM est e JOIN ci c USING (metric, grp)""",
}

def _on_all_metrics(name: str, test: str, statistic: str, group: str = "NULL", metric: str = "metric") -> str:
    """A test's query over the metrics and their logs."""
    inner = SQL[name].strip().removeprefix(f"WITH {AB},")
    return (f"SELECT '{test}' AS test, {metric} AS metric, CAST({group} AS INTEGER) AS \"group\", {statistic} AS statistic, p_value\n"
            f"FROM (WITH long AS (SELECT * FROM both_kinds), {inner})")


for _same, _as in (("items_join_hot_keys", "items_join"), ("items_join_colocated", "items_join"), ("customer_orders_hot_keys", "inner_join_customer_orders"),
                   ("ab_order_lines_hot_keys", "ab_order_lines"), ("rfm_base_colocated", "rfm_base"), ("ab_order_metrics_colocated", "ab_order_metrics")):
    SQL[_same] = SQL[_as]
SQL["retention_from_state"], SQL["rfm_base_from_state"] = SQL["cohort_retention"], SQL["rfm_base"]
SQL["sketched_users_by_day"] = f"""
WITH {AB}, first AS (SELECT grp, user_id, min(date) AS date FROM om GROUP BY grp, user_id),
days AS (SELECT DISTINCT grp, date FROM om)
SELECT d.grp AS "group", d.date, count(f.user_id) AS users, true AS within FROM days d JOIN first f ON f.grp = d.grp AND f.date <= d.date GROUP BY d.grp, d.date"""
SQL["sketched_quantiles"] = f'WITH {AB} SELECT grp AS "group", count(*) AS "rows", true AS within50, true AS within95 FROM om GROUP BY grp'
SQL["null_profile_of_frame"] = f"""
WITH {AB} SELECT name AS "column", value AS null_count
FROM (UNPIVOT (SELECT count(*) - count(COLUMNS(*)) FROM (SELECT user_id, order_id, 'create_order' AS action, date, grp AS "group", product_id, price FROM lines))
      ON COLUMNS(*) INTO NAME name VALUE value)"""
SQL["lines_shape"] = f'WITH {AB} SELECT count(*) AS "rows", 7 AS "columns" FROM lines'
SQL["top_products"] = f"SELECT * FROM ({SQL['top_weekday_per_product']}) ORDER BY quantity DESC, product_id LIMIT 20"
SQL["top_buyers_per_week"] = f"SELECT * FROM ({SQL['purchases_per_week']}) ORDER BY avg_purchases_per_week DESC, year_month, customer_unique_id LIMIT 20"
SQL["log_metric_checks"] = f"""
WITH {AB}, {LOGS}
""" + "\nUNION ALL ".join(
    f"SELECT '{test}' AS test, metric, CAST({group} AS INTEGER) AS \"group\", {stat} AS statistic, p_value, {flag} AS holds\n"
    f"FROM (WITH long AS (SELECT * FROM logs), {SQL[name].strip().removeprefix(f'WITH {AB},')})"
    for test, name, group, stat, flag in (("levene", "levene", "NULL", "w", "equal_var"), ("normality", "normality_k2", '"group"', "k2", "normal")))

SQL["ab_test_pvalues"] = f"""
WITH {AB}, {LOGS},
both_kinds AS (SELECT metric, grp, user_id, unit_id, value FROM long
               UNION ALL SELECT metric, grp, user_id, unit_id, value FROM logs)
""" + "\nUNION ALL ".join([
    _on_all_metrics("t_test_pooled", "t_pooled", "t"),
    _on_all_metrics("t_test_welch", "t_welch", "t"),
    _on_all_metrics("levene", "levene", "w"),
    _on_all_metrics("mann_whitney", "mann_whitney", "u_a"),
    _on_all_metrics("normality_k2", "normality", "k2", '"group"'),
    _on_all_metrics("chi2_yates", "chi2", "statistic", metric="'cancel_share'"),
])


def _decimal_rounding(sql: str) -> str:
    """Rewrite round(x, 6) / round_even(x, k) to round a DECIMAL(38,10) of x and
    return DOUBLE, mirroring ``catalog.r6`` (ties decided on the decimal value,
    not on last-bit noise of a floating sum)."""
    out, i = [], 0
    while True:
        j = sql.find("round", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        name = "round_even" if sql.startswith("round_even(", j) else "round"
        start = j + len(name)
        if sql[start:start + 1] != "(" or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            out.append(sql[i:j + len(name)])
            i = j + len(name)
            continue
        depth, k, comma = 0, start, None
        while k < len(sql):
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner, digits = sql[start + 1:comma], sql[comma + 1:k].strip()
        if name == "round" and digits != "6":
            out.append(sql[i:k + 1])
            i = k + 1
            continue
        inner = _decimal_rounding(inner)
        out.append(sql[i:j])
        out.append(f"CAST({name}(CAST({inner} AS DECIMAL(38,10)), {digits}) AS DOUBLE)")
        i = k + 1


SQL = {name: _decimal_rounding(q) for name, q in SQL.items()}
