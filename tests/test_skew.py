"""Forms that spread a key with very many rows give the same rows as the plain forms."""

from datetime import date, datetime, timedelta

from pyspark.sql import Window, functions as F

from quayline.operators import relational as R
from quayline.plans import pipelines as P, reports as N
from quayline.streaming import messages as B


def same(left, right):
    columns = sorted(left.columns)
    assert sorted(right.columns) == columns
    a, b = left.select(*columns), right.select(*columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def hot(lines, key):
    """A third of all lines under one key."""
    return lines.withColumn(key, F.when(F.pmod(F.xxhash64("tracking_number"), F.lit(3)) == 0, F.lit("US-000000001"))
                            .otherwise(F.col(key)))


def test_a_heavy_order_is_folded_like_any_other(feeds):
    lines = hot(feeds.delivery_lines, "order_number")
    found = P.delivery_orders(lines).filter("order_number = 'US-000000001'").first()
    plain = lines.filter("order_number = 'US-000000001'").agg(
        F.sum("quantity"), F.countDistinct("tracking_number"), F.countDistinct("item_name"), F.min("ordered_date").cast("date"),
    ).first()
    assert (found.total_items, found.shipment_count, found.unique_skus, found.ordered_date) == tuple(plain)


def test_orders_of_some_requests(feeds):
    lines = hot(feeds.delivery_lines, "order_number")
    some = lines.filter("facility = 'F1'").select("order_number")
    wanted = P.delivery_orders(lines).join(some, "order_number", "left_semi")
    same(P.delivery_orders(lines, some), wanted)


def test_no_job_runs_before_the_caller_asks(spark, feeds):
    """Building a query of the roll-ups starts no job."""
    tracker = spark.sparkContext.statusTracker()
    lines, outbound, stock = feeds.delivery_lines, feeds.outbound_lines, feeds.onhand_eod  # reads schemas
    spark.sparkContext.setJobGroup("plans", "plans only")
    P.delivery_orders(lines)
    P.shipments(outbound, date(2000, 6, 30))
    R.at_latest_per_group(stock, "facility", "snapshot_date")
    assert tracker.getJobIdsForGroup("plans") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_previous_row_keeps_rows_without_a_time(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", None, 1, "x"), ("a", start, 2, "y"), ("a", None, 3, "z"), (None, start, 4, "w"), (None, None, 5, "v")]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int, issue string")
    found = R.with_previous(df, "k", "ts", "id", ["issue"]).select("id", "previous.id")
    plain = df.select("id", F.lag("id").over(Window.partitionBy("k").orderBy("ts", "id")))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, plain.collect())))


def test_previous_row_over_slots(spark):
    start = datetime(2024, 1, 1)
    rows = [("k" if n % 3 else str(n % 7), start + timedelta(minutes=(n * n * 37) % 5000), n, str(n % 4)) for n in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int, issue string")
    found = R.with_previous(df, "k", "ts", "id", ["issue"]).select("id", "previous.id", "previous.issue")
    window = Window.partitionBy("k").orderBy("ts", "id")
    plain = df.select("id", F.lag("id").over(window).alias("p"), F.lag("issue").over(window).alias("i"))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, plain.collect())))


def test_latest_per_group_forms(feeds):
    stock = feeds.onhand_eod
    same(R.at_latest_per_group(stock, "facility", "snapshot_date"),
         R.at_latest_per_group_by_window(stock, "facility", "snapshot_date"))


def test_week_forms(feeds):
    as_of = date(2000, 6, 30)
    same(N.week_over_week(feeds.goods_receipts, as_of), N.week_over_week_joined(feeds.goods_receipts, as_of))


def test_mention_forms(feeds):
    same(B.unanswered_mentions(feeds.thread_messages, "BOT"),
         B.unanswered_mentions_by_anti_join(feeds.thread_messages, "BOT"))


def test_alias_table(spark):
    rows = R.alias_table(spark, {"x": ["a", "b"], "y": ["b"]}).collect()
    assert sorted(map(tuple, rows)) == [("x", "a"), ("x", "b"), ("y", "b")]


def test_shares_of_many_keys_need_no_single_task(spark):
    from quayline.operators import triage

    rows = spark.range(4000).selectExpr("if(id % 3 = 0, -1, id) AS key", "if(id = 1, NULL, 'x') AS kind")
    mix = triage.mix(rows, "key", "kind")
    assert "Window" not in mix._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.key, r.kind): (r.tickets, float(r.share_pct)) for r in mix.collect()}
    assert found[(-1, "x")] == (1334, 33.4) and found[(1, None)][0] == 1 and len(found) == 2667
    assert triage.mix(rows.limit(0), "key").collect() == []
