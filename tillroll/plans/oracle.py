"""Independent SQL for every catalog query, runnable by DuckDB on the driver's tables
(views customer, nation, part, orders, lineitem). Written straight from the question each
analysis answers (plain joins, window functions, self-joins), not from the Spark plans.

Each query is a list of named common table expressions plus a final SELECT; ``sql(name)``
assembles the WITH clause, pulling in the CTEs it depends on.
"""

from __future__ import annotations

from itertools import product

from tillroll.plans.catalog import P

Y0, Y1 = f"DATE '{P.year}-01-01'", f"DATE '{P.year + 1}-01-01'"
GAP_DAYS = P.gap_months * 30

_CTE: dict[str, tuple[list[str], str]] = {}


def _cte(name: str, deps: list[str], body: str) -> None:
    _CTE[name] = (deps, body)


# ---- the panel on the driver's tables ----
_cte("households", [], """
  SELECT c.c_custkey AS hh_id,
         CAST(FLOOR((c.c_acctbal + 1000) / 440) + 3 AS INTEGER) AS hh_income,
         n.n_name AS hh_state
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
_cte("products", [], """
  SELECT p_partkey AS prod_id, p_type AS department_at_prod_id,
         split_part(p_name, ' ', 2) AS group_at_prod_id, p_name AS module_at_prod_id,
         p_brand AS brand_at_prod_id
  FROM part""")
_cte("trips", [], """
  SELECT o_orderkey AS tc_id, o_custkey AS hh_id, CAST(o_orderdate AS DATE) AS tc_date,
         o_orderpriority AS tc_retailer_code, CAST(o_totalprice AS DECIMAL(18,2)) AS tc_total_spent
  FROM orders""")
_cte("purchases", [], """
  SELECT l_orderkey AS tc_id, l_partkey AS prod_id,
         CAST(l_quantity AS INTEGER) AS quantity_at_tc_prod_id,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS total_price_paid_at_tc_prod_id,
         CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS deal_flag_at_tc_prod_id
  FROM lineitem""")
_cte("trips_y", ["trips"], f"SELECT * FROM trips WHERE tc_date >= {Y0} AND tc_date < {Y1}")

# ---- loyalty chain ----
_cte("active", ["trips"], f"""
  SELECT hh_id, COUNT(*) AS months
  FROM (SELECT DISTINCT hh_id, month(tc_date) AS m FROM trips
        WHERE hh_id IS NOT NULL AND tc_date IS NOT NULL) hm
  GROUP BY hh_id HAVING COUNT(*) >= {P.min_months}""")
_cte("active_trips", ["trips", "active"], "SELECT * FROM trips WHERE hh_id IN (SELECT hh_id FROM active)")
_cte("share", ["active_trips"], f"""
  SELECT r.hh_id, r.tc_retailer_code, r.avg_spent_per_retailer, h.avg_spent,
         r.avg_spent_per_retailer / NULLIF(h.avg_spent, 0) * 100 AS percentage_of_spent
  FROM (SELECT hh_id, tc_retailer_code, CAST(SUM(tc_total_spent) AS DOUBLE) / {P.months} AS avg_spent_per_retailer
        FROM active_trips GROUP BY hh_id, tc_retailer_code) r
  LEFT JOIN (SELECT hh_id, CAST(SUM(tc_total_spent) AS DOUBLE) / {P.months} AS avg_spent
             FROM active_trips GROUP BY hh_id) h
  ON r.hh_id = h.hh_id""")
_cte("single", ["share"], f"SELECT * FROM share WHERE percentage_of_spent >= {P.single_threshold}")
_cte("pair", ["share"], f"""
  SELECT a.hh_id, a.tc_retailer_code AS retailer_1, b.tc_retailer_code AS retailer_2,
         a.avg_spent_per_retailer AS avg_spent_1, b.avg_spent_per_retailer AS avg_spent_2,
         a.avg_spent_per_retailer + b.avg_spent_per_retailer AS avg_spent_both,
         (a.avg_spent_per_retailer + b.avg_spent_per_retailer) / NULLIF(a.avg_spent, 0) * 100 AS percentage_of_spent
  FROM share a JOIN share b ON a.hh_id = b.hh_id AND a.tc_retailer_code < b.tc_retailer_code
  WHERE (a.avg_spent_per_retailer + b.avg_spent_per_retailer) / NULLIF(a.avg_spent, 0) * 100 > {P.pair_threshold}""")
_cte("loyal", ["single", "pair"], """
  SELECT 'single' AS kind, hh_id FROM single
  UNION
  SELECT 'pair' AS kind, hh_id FROM pair""")
_cte("loyal_state", ["loyal", "households"], """
  SELECT l.kind, l.hh_id, h.hh_state FROM loyal l LEFT JOIN households h ON l.hh_id = h.hh_id""")

# ---- gaps ----
_cte("pairs", ["trips_y"], """
  SELECT hh_id_0, tc_date_0, tc_id_0, hh_id_1, tc_date_1, tc_id_1,
         CAST(date_diff('day', tc_date_0, tc_date_1) AS INTEGER) AS time_window
  FROM (SELECT hh_id AS hh_id_0, tc_date AS tc_date_0, tc_id AS tc_id_0,
               lead(hh_id) OVER w AS hh_id_1, lead(tc_date) OVER w AS tc_date_1, lead(tc_id) OVER w AS tc_id_1
        FROM trips_y WHERE hh_id IS NOT NULL AND tc_date IS NOT NULL
        WINDOW w AS (PARTITION BY hh_id ORDER BY tc_date, tc_id)) l
  WHERE tc_id_1 IS NOT NULL""")

# ---- monthly ----
_cte("items", ["trips_y", "households", "purchases"], """
  SELECT month, CAST(SUM(CAST(number AS DECIMAL(28,12))) AS DOUBLE) / NULLIF(COUNT(number), 0) AS num_items
  FROM (SELECT t.hh_id, CAST(month(t.tc_date) AS INTEGER) AS month,
               CAST(SUM(p.quantity_at_tc_prod_id) AS DOUBLE) / NULLIF(COUNT(p.quantity_at_tc_prod_id), 0) AS number
        FROM trips_y t JOIN households h ON t.hh_id = h.hh_id JOIN purchases p ON t.tc_id = p.tc_id
        GROUP BY t.hh_id, CAST(month(t.tc_date) AS INTEGER)) a
  GROUP BY month""")
_cte("trips_m", ["trips_y", "households"], """
  SELECT month, CAST(SUM(number) AS DOUBLE) / NULLIF(COUNT(number), 0) AS num_trips
  FROM (SELECT t.hh_id, CAST(month(t.tc_date) AS INTEGER) AS month, COUNT(t.tc_id) AS number
        FROM trips_y t JOIN households h ON t.hh_id = h.hh_id
        GROUP BY t.hh_id, CAST(month(t.tc_date) AS INTEGER)) b
  GROUP BY month""")
_cte("ivt", ["items", "trips_m"], """
  SELECT t.month, i.num_items, t.num_trips FROM trips_m t JOIN items i ON i.month = t.month""")
_cte("ppi", ["purchases"], """
  SELECT CAST(total_price_paid_at_tc_prod_id AS DOUBLE) / NULLIF(quantity_at_tc_prod_id, 0) AS avg_price_paid_per_item,
         quantity_at_tc_prod_id
  FROM purchases""")

# ---- products ----
_cte("dept", ["products"], """
  SELECT department_at_prod_id AS department, COUNT(DISTINCT prod_id) AS products,
         COUNT(DISTINCT module_at_prod_id) AS module
  FROM products WHERE department_at_prod_id IS NOT NULL GROUP BY department_at_prod_id""")
_cte("plgroup", ["products"], f"""
  SELECT group_at_prod_id, count_pl, count_all,
         CAST(count_pl AS DOUBLE) / NULLIF(CAST(count_all AS DOUBLE), 0) * 100 AS proportion
  FROM (SELECT group_at_prod_id,
               COUNT(CASE WHEN brand_at_prod_id = '{P.brand}' THEN brand_at_prod_id END) AS count_pl,
               COUNT(brand_at_prod_id) AS count_all
        FROM products WHERE group_at_prod_id IS NOT NULL GROUP BY group_at_prod_id) g
  WHERE count_pl > 0""")

# ---- private-label spend ----
_cte("plm", ["trips_y", "purchases", "products"], f"""
  SELECT CAST(month(t.tc_date) AS INTEGER) AS month,
         CAST(SUM(p.total_price_paid_at_tc_prod_id) AS DECIMAL(38,2)) AS all_prods,
         CAST(SUM(CASE WHEN f.pl THEN p.total_price_paid_at_tc_prod_id END) AS DECIMAL(38,2)) AS pl_prods,
         COUNT(CASE WHEN f.pl THEN 1 END) AS pl_lines
  FROM purchases p
  JOIN trips_y t ON p.tc_id = t.tc_id
  JOIN (SELECT prod_id, bool_or(COALESCE(brand_at_prod_id = '{P.brand}', false)) AS pl
        FROM products GROUP BY prod_id) f ON p.prod_id = f.prod_id
  GROUP BY CAST(month(t.tc_date) AS INTEGER)""")
_cte("plshare", ["plm"], """
  SELECT month, pl_prods, all_prods,
         CAST(pl_prods AS DOUBLE) / NULLIF(CAST(all_prods AS DOUBLE), 0) AS share
  FROM plm WHERE pl_lines > 0""")


def _band_case(col: str) -> str:
    return (f"CASE WHEN {col} BETWEEN 3 AND 15 THEN 'low' WHEN {col} BETWEEN 16 AND 21 THEN 'mid' "
            f"WHEN {col} > 21 THEN 'high' END")


_cte("bandmonth", ["purchases", "products", "trips", "households"], f"""
  SELECT band, year_month, total, private,
         CAST(private AS DOUBLE) / NULLIF(CAST(total AS DOUBLE), 0) AS percentage
  FROM (SELECT hb.band, strftime(t.tc_date, '%Y-%m') AS year_month,
               CAST(SUM(p.total_price_paid_at_tc_prod_id) AS DECIMAL(38,2)) AS total,
               CAST(SUM(CASE WHEN pl.prod_id IS NOT NULL THEN p.total_price_paid_at_tc_prod_id END) AS DECIMAL(38,2)) AS private,
               COUNT(pl.prod_id) AS n_pl
        FROM purchases p
        LEFT JOIN (SELECT DISTINCT prod_id FROM products
                   WHERE regexp_matches(brand_at_prod_id, '{P.brand}')) pl ON p.prod_id = pl.prod_id
        JOIN trips t ON p.tc_id = t.tc_id
        JOIN (SELECT DISTINCT hh_id, {_band_case('hh_income')} AS band FROM households) hb ON t.hh_id = hb.hh_id
        WHERE hb.band IS NOT NULL AND t.tc_date IS NOT NULL
        GROUP BY hb.band, strftime(t.tc_date, '%Y-%m')) m
  WHERE n_pl > 0""")


def _by_income(band: str | None) -> str:
    where = "" if band is None else f"WHERE band = '{band}'"
    return f"""
  SELECT band, months, avg_total, avg_private, avg_private / NULLIF(avg_total, 0) AS percentage
  FROM (SELECT band, COUNT(*) AS months,
               CAST(SUM(total) AS DOUBLE) / NULLIF(COUNT(total), 0) AS avg_total,
               CAST(SUM(private) AS DOUBLE) / NULLIF(COUNT(private), 0) AS avg_private
        FROM bandmonth {where} GROUP BY band) s"""


def _corr(source: str, columns: list[str]) -> str:
    parts = []
    for a, b in product(columns, columns):
        xa = f"CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
        xb = f"CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
        parts.append(
            f"SELECT '{a}' AS var_x, '{b}' AS var_y, "
            f"ROUND(covar_pop({xa}, {xb}) / NULLIF(stddev_pop({xa}) * stddev_pop({xb}), 0), 6) AS corr "
            f"FROM {source}"
        )
    return "\n  UNION ALL\n  ".join(parts)


def _histogram(source: str, column: str, bins: int) -> str:
    return f"""
  SELECT bin, s_lo + bin * ((s_hi - s_lo) / {bins}) AS lo,
         CASE WHEN s_hi = s_lo THEN s_hi ELSE s_lo + (bin + 1) * ((s_hi - s_lo) / {bins}) END AS hi, n
  FROM (SELECT CAST(CASE WHEN s.s_hi = s.s_lo THEN 0
                         ELSE LEAST(FLOOR((d.x - s.s_lo) / ((s.s_hi - s.s_lo) / {bins})), {bins - 1}) END AS BIGINT) AS bin,
               s.s_lo, s.s_hi, COUNT(*) AS n
        FROM (SELECT CAST({column} AS DOUBLE) AS x FROM {source} WHERE {column} IS NOT NULL) d,
             (SELECT MIN(CAST({column} AS DOUBLE)) AS s_lo, MAX(CAST({column} AS DOUBLE)) AS s_hi
              FROM {source} WHERE {column} IS NOT NULL) s
        GROUP BY 1, s.s_lo, s.s_hi) h"""


def _scatter_bins(source: str, x: str, y: str, bx: int, by: int) -> str:
    return f"""
  SELECT bin_x, bin_y,
         CASE WHEN x_hi = x_lo THEN x_lo ELSE x_lo + (bin_x + 0.5) * ((x_hi - x_lo) / {bx}) END AS x,
         CASE WHEN y_hi = y_lo THEN y_lo ELSE y_lo + (bin_y + 0.5) * ((y_hi - y_lo) / {by}) END AS y, n
  FROM (SELECT CAST(CASE WHEN s.x_hi = s.x_lo THEN 0
                         ELSE LEAST(FLOOR((d.x - s.x_lo) / ((s.x_hi - s.x_lo) / {bx})), {bx - 1}) END AS BIGINT) AS bin_x,
               CAST(CASE WHEN s.y_hi = s.y_lo THEN 0
                         ELSE LEAST(FLOOR((d.y - s.y_lo) / ((s.y_hi - s.y_lo) / {by})), {by - 1}) END AS BIGINT) AS bin_y,
               s.x_lo, s.x_hi, s.y_lo, s.y_hi, COUNT(*) AS n
        FROM (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source}
              WHERE {x} IS NOT NULL AND {y} IS NOT NULL) d,
             (SELECT MIN(CAST({x} AS DOUBLE)) AS x_lo, MAX(CAST({x} AS DOUBLE)) AS x_hi,
                     MIN(CAST({y} AS DOUBLE)) AS y_lo, MAX(CAST({y} AS DOUBLE)) AS y_hi
              FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) s
        GROUP BY 1, 2, s.x_lo, s.x_hi, s.y_lo, s.y_hi) h"""


# (dependencies, final SELECT) per catalog query
_QUERIES: dict[str, tuple[list[str], str]] = {
    "panel_households": (["households"], "SELECT * FROM households"),
    "panel_products": (["products"], "SELECT * FROM products"),
    "panel_trips": (["trips"], "SELECT * FROM trips"),
    "panel_purchases": (["purchases"], "SELECT * FROM purchases"),
    "sample_by_keys": (
        ["purchases", "trips", "active"],
        "SELECT * FROM purchases WHERE tc_id IN "
        "(SELECT tc_id FROM trips WHERE hh_id IN (SELECT hh_id FROM active))",
    ),
    "trips_in_year": (["trips_y"], "SELECT * FROM trips_y"),
    "trip_count": (["trips_y"], "SELECT COUNT(hh_id) AS n_trips FROM trips_y"),
    "household_count": (["households"], "SELECT COUNT(DISTINCT hh_id) AS n_households FROM households"),
    "retailer_count": (["trips_y"], "SELECT COUNT(DISTINCT tc_retailer_code) AS n_retailers FROM trips_y"),
    # the estimates themselves are sketches; that they are within their error bound is stated
    "distinct_by_quarter": (
        ["trips"],
        "SELECT concat(year(tc_date), '-Q', quarter(tc_date)) AS quarter, COUNT(DISTINCT hh_id) AS n_households, "
        "COUNT(DISTINCT tc_retailer_code) AS n_retailers, true AS households_close, true AS retailers_close "
        "FROM trips WHERE tc_date IS NOT NULL GROUP BY ALL",
    ),
    "products_per_group": (
        ["products"],
        "SELECT group_at_prod_id, COUNT(prod_id) AS n_products FROM products GROUP BY group_at_prod_id",
    ),
    "products_per_module": (
        ["products"],
        "SELECT module_at_prod_id, COUNT(prod_id) AS n_products FROM products GROUP BY module_at_prod_id",
    ),
    "department_profile": (["dept"], "SELECT * FROM dept"),
    "purchase_count": (["purchases"], "SELECT COUNT(tc_id) AS n_purchases FROM purchases"),
    "deal_purchase_count": (
        ["purchases"],
        "SELECT COUNT(tc_id) AS n_deal_purchases FROM purchases WHERE deal_flag_at_tc_prod_id = 1",
    ),
    "trip_sequence_by_date": (
        ["trips_y"],
        "SELECT hh_id, tc_date, tc_id, row_number() OVER (ORDER BY tc_date, tc_id) AS id FROM trips_y",
    ),
    "trip_sequence_by_household": (
        ["trips_y"],
        "SELECT hh_id, tc_date, tc_id, row_number() OVER (ORDER BY hh_id, tc_date, tc_id) AS id FROM trips_y",
    ),
    "next_trip_pairs": (["pairs"], "SELECT * FROM pairs"),
    "inactive_gap_count": (
        ["pairs"],
        f"SELECT COUNT(*) AS gaps, COUNT(DISTINCT hh_id_0) AS households FROM pairs WHERE time_window > {GAP_DAYS}",
    ),
    "global_gap_count": (
        ["trips_y"],
        f"""SELECT COUNT(*) AS gaps
  FROM (SELECT tc_date, row_number() OVER (ORDER BY tc_date) AS id FROM trips_y WHERE tc_date IS NOT NULL) a
  JOIN (SELECT tc_date, row_number() OVER (ORDER BY tc_date) AS id FROM trips_y WHERE tc_date IS NOT NULL) b ON b.id = a.id + 1
  WHERE date_diff('day', a.tc_date, b.tc_date) > {P.global_gap_days}""",
    ),
    "avg_gap_per_household": (
        ["pairs"],
        "SELECT hh_id_0 AS household, CAST(SUM(time_window) AS DOUBLE) / NULLIF(COUNT(time_window), 0) AS days "
        "FROM pairs GROUP BY hh_id_0",
    ),
    "monthly_active_households": (["active"], "SELECT * FROM active"),
    "monthly_active_trips": (["active_trips"], "SELECT * FROM active_trips"),
    "household_avg_spend": (
        ["active_trips"],
        f"SELECT hh_id, CAST(SUM(tc_total_spent) AS DOUBLE) / {P.months} AS avg_spent FROM active_trips GROUP BY hh_id",
    ),
    "household_retailer_avg_spend": (
        ["active_trips"],
        f"SELECT hh_id, tc_retailer_code, CAST(SUM(tc_total_spent) AS DOUBLE) / {P.months} AS avg_spent_per_retailer "
        "FROM active_trips GROUP BY hh_id, tc_retailer_code",
    ),
    "retailer_share": (["share"], "SELECT * FROM share"),
    "loyal_single": (["single"], "SELECT * FROM single"),
    "loyal_pair": (["pair"], "SELECT * FROM pair"),
    "loyal_pair_ordered": (
        ["share"],
        f"""SELECT a.hh_id, a.tc_retailer_code AS retailer_1, b.tc_retailer_code AS retailer_2,
         a.avg_spent_per_retailer AS avg_spent_1, b.avg_spent_per_retailer AS avg_spent_2,
         a.avg_spent_per_retailer + b.avg_spent_per_retailer AS avg_spent_both,
         (a.avg_spent_per_retailer + b.avg_spent_per_retailer) / NULLIF(a.avg_spent, 0) * 100 AS percentage_of_spent
  FROM share a JOIN share b ON a.hh_id = b.hh_id AND a.tc_retailer_code <> b.tc_retailer_code
  WHERE (a.avg_spent_per_retailer + b.avg_spent_per_retailer) / NULLIF(a.avg_spent, 0) * 100 > {P.pair_threshold}""",
    ),
    "loyal_households": (["loyal"], "SELECT * FROM loyal"),
    "loyal_household_income": (
        ["loyal", "households"],
        "SELECT l.kind, l.hh_id, h.hh_income FROM loyal l LEFT JOIN households h ON l.hh_id = h.hh_id",
    ),
    "loyal_income_comparison": (
        ["loyal", "households"],
        """SELECT CASE WHEN l.hh_id IS NOT NULL THEN 'loyal' ELSE 'other' END AS segment, COUNT(*) AS n,
         CAST(SUM(h.hh_income) AS DOUBLE) / NULLIF(COUNT(h.hh_income), 0) AS avg_income
  FROM households h LEFT JOIN (SELECT hh_id FROM loyal WHERE kind = 'pair') l ON h.hh_id = l.hh_id
  GROUP BY 1""",
    ),
    "top_retailer_by_spend": (
        ["trips"],
        """SELECT tc_retailer_code, CAST(SUM(tc_total_spent) AS DECIMAL(38,2)) AS total_spent
  FROM trips GROUP BY tc_retailer_code
  ORDER BY total_spent DESC NULLS LAST, tc_retailer_code ASC NULLS LAST LIMIT 1""",
    ),
    "loyalists_by_retailer": (
        ["single"],
        "SELECT tc_retailer_code, COUNT(DISTINCT hh_id) AS households FROM single GROUP BY tc_retailer_code",
    ),
    "top_loyalist_retailer": (
        ["single"],
        """SELECT tc_retailer_code, COUNT(DISTINCT hh_id) AS households FROM single GROUP BY tc_retailer_code
  ORDER BY households DESC, tc_retailer_code ASC NULLS LAST LIMIT 1""",
    ),
    "loyal_household_state": (["loyal_state"], "SELECT * FROM loyal_state"),
    "loyal_state_distribution": (
        ["loyal_state"],
        "SELECT kind, hh_state, COUNT(*) AS n FROM loyal_state GROUP BY kind, hh_state",
    ),
    "avg_items_by_month": (["items"], "SELECT * FROM items"),
    "avg_trips_by_month": (["trips_m"], "SELECT * FROM trips_m"),
    "items_vs_trips_by_month": (["ivt"], "SELECT * FROM ivt"),
    "items_trips_corr": (["ivt"], _corr("ivt", ["month", "num_items", "num_trips"])),
    "price_per_item": (["ppi"], "SELECT * FROM ppi"),
    "price_quantity_corr": (["ppi"], _corr("ppi", ["avg_price_paid_per_item", "quantity_at_tc_prod_id"])),
    "private_label_share_by_group": (["plgroup"], "SELECT * FROM plgroup"),
    "top_private_label_groups": (
        ["plgroup"],
        f"SELECT * FROM plgroup ORDER BY proportion DESC NULLS LAST, group_at_prod_id ASC LIMIT {P.top_groups}",
    ),
    "spend_by_month": (["plm"], "SELECT month AS month1, all_prods FROM plm"),
    "private_label_spend_by_month": (["plm"], "SELECT month AS month2, pl_prods FROM plm WHERE pl_lines > 0"),
    "private_label_expenditure_share": (["plshare"], "SELECT * FROM plshare"),
    "private_label_by_income": (["bandmonth"], _by_income(None)),
    "private_label_by_income_low": (["bandmonth"], _by_income("low")),
    "private_label_by_income_mid": (["bandmonth"], _by_income("mid")),
    "private_label_by_income_high": (["bandmonth"], _by_income("high")),
    "private_label_share_by_income_month": (["bandmonth"], "SELECT * FROM bandmonth"),
    "bar_department_products": (["dept"], "SELECT department AS category, products AS value FROM dept"),
    "bar_department_modules": (["dept"], "SELECT department AS category, module AS value FROM dept"),
    "bar_group_proportion": (["plgroup"], "SELECT group_at_prod_id AS category, proportion AS value FROM plgroup"),
    "bar_month_share": (["plshare"], "SELECT month AS category, share AS value FROM plshare"),
    "line_items_by_month": (["items"], "SELECT month AS x, num_items AS y FROM items"),
    "line_trips_by_month": (["trips_m"], "SELECT month AS x, num_trips AS y FROM trips_m"),
    "gap_histogram": (["pairs"], _histogram("pairs", "time_window", P.gap_bins)),
    "gap_histogram_view": (
        ["pairs"],
        f"SELECT * FROM ({_histogram('pairs', 'time_window', P.gap_bins)}) v WHERE lo <= {P.gap_view}",
    ),
    "income_share_histogram": (["bandmonth"], _histogram("bandmonth", "percentage", P.share_bins)),
    "scatter_items_trips": (
        ["ivt"],
        "SELECT CAST(num_items AS DOUBLE) AS x, CAST(num_trips AS DOUBLE) AS y FROM ivt",
    ),
    "scatter_price_quantity": (
        ["ppi"],
        _scatter_bins("ppi", "avg_price_paid_per_item", "quantity_at_tc_prod_id", *P.scatter_bins),
    ),
    "scatter_price_points": (
        ["purchases"],
        f"""SELECT CAST(total_price_paid_at_tc_prod_id AS DOUBLE) / NULLIF(quantity_at_tc_prod_id, 0) AS x,
               CAST(quantity_at_tc_prod_id AS DOUBLE) AS y
        FROM purchases
        ORDER BY md5(concat_ws(':', coalesce(CAST(tc_id AS VARCHAR), ''), coalesce(CAST(prod_id AS VARCHAR), ''),
                               coalesce(CAST(quantity_at_tc_prod_id AS VARCHAR), ''),
                               coalesce(CAST(CAST(total_price_paid_at_tc_prod_id * 100 AS BIGINT) AS VARCHAR), ''))),
                 x NULLS FIRST, y NULLS FIRST
        LIMIT {P.max_points}""",
    ),
}


def _closure(deps: list[str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for d in _CTE[name][0]:
            visit(d)
        ordered.append(name)

    for d in deps:
        visit(d)
    return ordered


def sql(name: str) -> str:
    deps, select = _QUERIES[name]
    ctes = ",\n".join(f"{n} AS ({_CTE[n][1]}\n)" for n in _closure(deps))
    return f"WITH {ctes}\n{select}"


def oracle_sql() -> dict[str, str]:
    return {name: sql(name) for name in _QUERIES}
