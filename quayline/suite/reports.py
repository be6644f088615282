"""Named reports over goods receipts."""

from quayline.plans import reports as N
from quayline.suite.registry import AS_OF, case

DAYS = 30
WINDOW = "adjustment_date BETWEEN DATE '2000-06-30' - 30 AND DATE '2000-06-30'"
TOTALS = """CAST(SUM(avl_quantity) AS BIGINT) AS total_avl,
           CAST(SUM(unavl_quantity) AS BIGINT) AS total_unavl"""
COST = "CAST(ROUND(SUM(extended_cost), 2) AS DOUBLE) AS total_cost"
RETURNS = "CAST(SUM(return_quantity) AS BIGINT) AS total_returns"


@case("facility_summary", f"""
    SELECT facility_id, COUNT(DISTINCT adjustment_date) AS days,
           COUNT(DISTINCT item_code) AS unique_skus, {TOTALS}, {RETURNS}, {COST}
    FROM goods_receipts WHERE {WINDOW} GROUP BY facility_id""")
def facility_summary(t):
    return N.facility_summary(t.goods_receipts, AS_OF, DAYS)


@case("daily_breakdown", f"""
    SELECT adjustment_date, facility_id, COUNT(DISTINCT item_code) AS unique_skus, {TOTALS}, {RETURNS}
    FROM goods_receipts WHERE {WINDOW} GROUP BY adjustment_date, facility_id""")
def daily_breakdown(t):
    return N.daily_breakdown(t.goods_receipts, AS_OF, DAYS)


@case("top_skus", f"""
    SELECT item_code, product_name, {TOTALS}, COUNT(DISTINCT adjustment_date) AS days_active,
           COUNT(DISTINCT facility_id) AS facilities
    FROM goods_receipts WHERE {WINDOW} AND facility_id = 'F1'
    GROUP BY item_code, product_name
    ORDER BY total_avl DESC, item_code, product_name NULLS FIRST LIMIT 20""")
def top_skus(t):
    return N.top_skus(t.goods_receipts, AS_OF, DAYS, facility="F1")


@case("sku_detail", """
    SELECT adjustment_date, facility_id, avl_quantity, unavl_quantity, return_quantity,
           CAST(std_cost AS DOUBLE) AS std_cost, CAST(extended_cost AS DOUBLE) AS extended_cost
    FROM goods_receipts
    WHERE adjustment_date BETWEEN DATE '2000-06-30' - 3650 AND DATE '2000-06-30' AND item_code = 17""")
def sku_detail(t):
    return N.sku_detail(t.goods_receipts, AS_OF, 17, days=3650)


@case("product_summary", f"""
    SELECT product_name, COUNT(DISTINCT item_code) AS sku_count, {TOTALS}, {COST}
    FROM goods_receipts WHERE {WINDOW} AND product_name IS NOT NULL AND product_name <> ''
    GROUP BY product_name ORDER BY total_avl DESC, product_name LIMIT 20""")
def product_summary(t):
    return N.product_summary(t.goods_receipts, AS_OF, DAYS)


@case("data_freshness", """
    SELECT (SELECT MAX(adjustment_date) FROM goods_receipts) AS latest_data_date,
           (SELECT MIN(adjustment_date) FROM goods_receipts) AS earliest_data_date,
           (SELECT COUNT(*) FROM goods_receipts) AS total_rows,
           (SELECT COUNT(DISTINCT item_code) FROM goods_receipts) AS total_skus,
           (SELECT COUNT(DISTINCT facility_id) FROM goods_receipts) AS total_facilities,
           (SELECT MAX(fetched_at) FROM goods_receipts) AS last_fetched,
           (SELECT COUNT(*) FROM run_log WHERE source_id = 'source1' AND status = 'success')
               AS successful_runs""")
def data_freshness(t):
    return N.data_freshness(t.goods_receipts, t.run_log, "source1")


WEEKS_SQL = """
    WITH this_week AS (
        SELECT facility_id, SUM(avl_quantity) AS avl FROM goods_receipts
        WHERE adjustment_date BETWEEN DATE '2000-06-23' AND DATE '2000-06-30' GROUP BY facility_id),
    last_week AS (
        SELECT facility_id, SUM(avl_quantity) AS avl FROM goods_receipts
        WHERE adjustment_date >= DATE '2000-06-16' AND adjustment_date < DATE '2000-06-23'
        GROUP BY facility_id)
    SELECT COALESCE(t.facility_id, l.facility_id) AS facility_id,
           CAST(COALESCE(t.avl, 0) AS BIGINT) AS this_week_avl,
           CAST(COALESCE(l.avl, 0) AS BIGINT) AS last_week_avl,
           CAST(COALESCE(t.avl, 0) - COALESCE(l.avl, 0) AS BIGINT) AS avl_change,
           CASE WHEN COALESCE(l.avl, 0) > 0
                THEN CAST(ROUND((COALESCE(t.avl, 0) - l.avl) * 100.0 / l.avl, 1) AS DOUBLE) END
               AS avl_pct_change
    FROM this_week t FULL JOIN last_week l ON t.facility_id = l.facility_id"""


@case("week_over_week", WEEKS_SQL)
def week_over_week(t):
    return N.week_over_week(t.goods_receipts, AS_OF)


@case("join_full_outer", WEEKS_SQL)
def join_full_outer(t):
    return N.week_over_week_joined(t.goods_receipts, AS_OF)


@case("collector_summary", f"""
    SELECT facility_id, COUNT(*) AS rows, {TOTALS}, COUNT(DISTINCT item_code) AS unique_skus,
           COUNT(DISTINCT adjustment_date) AS days_covered
    FROM goods_receipts WHERE {WINDOW} GROUP BY facility_id""")
def collector_summary(t):
    return N.collector_summary(t.goods_receipts, AS_OF, DAYS)


@case("collector_top10", f"""
    SELECT item_code, COALESCE(LEFT(product_name, 24), '') AS product_name, {TOTALS}
    FROM goods_receipts WHERE {WINDOW} GROUP BY item_code, goods_receipts.product_name
    ORDER BY total_avl DESC, item_code LIMIT 10""")
def collector_top10(t):
    return N.collector_top10(t.goods_receipts, AS_OF, DAYS)


@case("table_stats", """
    SELECT COUNT(*) AS total, MIN(adjustment_date) AS earliest, MAX(adjustment_date) AS latest,
           COUNT(DISTINCT facility_id) AS facilities, COUNT(DISTINCT item_code) AS skus
    FROM goods_receipts""")
def table_stats(t):
    return N.table_stats(t.goods_receipts)


@case("run_stats", """
    SELECT COUNT(*) FILTER (status = 'success') AS successful,
           COUNT(*) FILTER (status = 'error') AS errors
    FROM run_log""")
def run_stats(t):
    return N.run_stats(t.run_log)
