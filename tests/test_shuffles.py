"""How often rows are shuffled, and that the rows stay the same."""

import time
from datetime import date

from pyspark.sql import functions as F

from quayline.operators import relational as R
from quayline.plans import lookup as L, pipelines as P
from quayline.session import SHUFFLE_CLEANUP, shuffles_dropped
from quayline.sources import files, tables

LINES = [
    ("US-1", "T1", "F1", "ups", "Item1", 2, True), ("US-1", "T1", "F1", "ups", "Item1", 2, True),
    ("US-1", "T2", "F0", None, "Item2", 3, False), ("US-1", None, None, "ups", "Item3", 5, None),
    (None, "T9", "F1", "ups", "Item1", 7, True),
]


def shuffles(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line and "ReusedExchange" not in line for line in plan.splitlines())


def some_lines(spark, feeds):
    named = "order_number string, tracking_number string, facility string, carrier_code string, item_name string, quantity long, is_delivered boolean"
    found = spark.createDataFrame(LINES, named)
    others = {c: t for c, t in feeds.delivery_lines.dtypes if c not in found.columns}
    day = {"shipped_date": date(2000, 1, 2)}
    return found.withColumns({c: F.lit(day.get(c)).cast(t) for c, t in others.items()})


def test_orders_are_folded_in_one_shuffle(spark, feeds):
    orders = P.delivery_orders(some_lines(spark, feeds))
    assert shuffles(orders) == 1
    columns = ["order_number", "facilities", "carriers", "unique_skus", "total_items", "shipment_count", "tracking_numbers", "order_status"]
    assert sorted(map(tuple, orders.select(columns).collect()), key=str) == [
        ("US-1", "F0, F1", "ups", 3, 12, 2, "T1, T2", "PARTIALLY_DELIVERED"),
        (None, "F1", "ups", 1, 7, 1, "T9", "DELIVERED"),
    ]


def test_shipments_are_folded_in_one_shuffle(feeds):
    lines = feeds.outbound_lines
    assert shuffles(P.shipments(lines, date(2000, 6, 30))) == 1


def test_a_bitmap_of_keys_keeps_the_rows_of_a_semi_join(spark):
    rows = spark.range(5000).selectExpr("nullif(concat('k', id % 900), 'k7') AS k", "id")
    keys = spark.range(400).selectExpr("nullif(concat('k', id * 3 % 500), 'k9') AS k", "id AS other")
    plain = rows.join(keys, "k", "left_semi")
    for words in (1, 4, R.FILTER_WORDS):  # with few words, most rows pass the bitmap
        found = R.among(rows, "k", keys, words)
        assert found.columns == rows.columns
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_lines_of_other_orders_go_before_a_shuffle(spark, feeds, tmp_path):
    feeds.delivery_lines.write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    some = lines.filter("source_order_number % 50 = 0").select("order_number")
    plan = P.delivery_orders(lines, some)._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan and "LeftSemi" not in plan


def test_the_best_hit_is_one_row_a_request(spark, feeds):
    lines = some_lines(spark, feeds).filter("order_number IS NOT NULL")
    numbered = lambda df, number: df.withColumn("order_number", F.lit(number))
    own, base, open_line = (numbered(lines, n) for n in ("US-000001-WR", "US-000001", "CA-000002"))
    curated = P.delivery_orders(own.unionByName(base))
    shipments = P.shipments(feeds.outbound_lines.filter("order_token = 'none'"), date(2000, 6, 30))
    asked = [("us-000001-wr",), ("US-000001",), ("CA-000002-WR",), ("GB-000003",), (None,)]
    requests = spark.createDataFrame(asked, "order_number string")
    found = L.order_lookup(requests, curated.unionByName(curated), shipments, open_line.unionByName(own))
    assert sorted(map(tuple, found.select("requested", "order_number", "source", "found_in", "total_items").collect())) == [
        ("CA-000002-WR", "CA-000002", "lines", "delivery", 12), ("US-000001", "US-000001", "curated", "delivery", 12),
        ("US-000001-WR", "US-000001-WR", "curated", "delivery", 12),
    ]


def test_rows_of_receipt_files_stay_where_they_are_read(spark, tmp_path):
    for n, text in enumerate(("ITEM_CODE,AVL_QUANTITY\na,1\nb,2\n", "AVL_QUANTITY,ITEM_CODE\n3,c\n")):
        (tmp_path / f"{n}.csv").write_text(text)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = files.read_receipts_csv(spark, str(tmp_path))
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.select("item_code", "avl_quantity").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_upsert_moves_no_rows_to_find_the_touched_partitions(spark, tmp_path, monkeypatch):
    plans, merged = [], tables.merged_rows

    def seen(base, *rest):
        plans.append(base._jdf.queryExecution().optimizedPlan().toString())
        return merged(base, *rest)

    monkeypatch.setattr(tables, "merged_rows", seen)
    batch = lambda rows: spark.createDataFrame(rows, "part int, id int, v string, fetched_at string, sequence int")
    target = str(tmp_path / "table")
    first = tables.upsert(spark, target, batch([(1, 1, "a", "x", 1), (2, 2, "b", "x", 1), (None, 3, "c", "x", 1)]), ["part", "id"], "part")
    again = tables.upsert(spark, target, batch([(1, 1, "A", "y", 1), (1, 4, "d", "y", 1)]), ["part", "id"], "part")
    assert (first.inserted, again.inserted, again.updated) == (3, 1, 1)
    assert sorted(r.v for r in spark.read.parquet(target).collect()) == ["A", "b", "c", "d"]
    assert "broadcast" in plans[-1]


def test_a_layout_makes_its_rows_once(spark, tmp_path):
    """Only the key columns are read a second time, for the bounds; Spark's range partitioning makes all rows twice."""
    made = spark.sparkContext.accumulator(0)

    def costly(n):
        made.add(1)
        return n

    rows = spark.range(60_000).selectExpr("CASE WHEN id % 9 > 0 THEN concat('k', pmod(xxhash64(id), 7000)) END AS k", "id % 5 AS n", "id")
    whole = rows.withColumn("text", F.udf(costly, "long")("id"))
    target = str(tmp_path / "t")
    assert tables.full_refresh(whole, target, ["k", "n"]) == 60_000
    assert made.value == 60_000
    back = spark.read.parquet(target).drop("synced_at")
    assert back.schema.names == whole.schema.names and back.select(*rows.columns).exceptAll(rows).isEmpty()
    # The files hold ranges of the keys that don't overlap, each sorted inside.
    key = F.struct("k", "n")
    files_of = back.groupBy(F.input_file_name().alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ends = spark.createDataFrame(files_of.collect(), files_of.schema).orderBy("low")
    assert ends.count() > 2
    place = [(r.low, r.high) for r in ends.collect()]
    null_first = lambda r: (r.k is not None, r.k or "", r.n)
    assert all(null_first(a[1]) < null_first(b[0]) for a, b in zip(place, place[1:]))
    for part in (tmp_path / "t").glob("part-*.parquet"):
        found = spark.read.parquet(str(part)).select("k", "n").collect()
        assert [null_first(r) for r in found] == sorted(map(null_first, found))


def test_layouts_of_few_rows(spark, tmp_path):
    for n in (0, 1, 7):
        rows = spark.range(n).selectExpr("nullif(id, 3) AS a", "id AS b")
        assert tables.full_refresh(rows, str(tmp_path / f"t{n}"), ["a", "b"]) == n
        assert spark.read.parquet(str(tmp_path / f"t{n}")).count() == n


def shuffle_files(spark) -> set[str]:
    jvm = spark._jvm
    found = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(found) if f.getName().startswith("shuffle_")}


def gone(spark, before: set[str]) -> bool:
    """No shuffle files but those of before; Spark removes them in the background."""
    for _ in range(100):
        if not shuffle_files(spark) - before:
            return True
        time.sleep(0.1)
    return False


def test_a_refresh_leaves_no_shuffle_files(spark, feeds, tmp_path):
    orders = P.delivery_orders(feeds.delivery_lines)
    count = orders.count()
    before = shuffle_files(spark)
    for made_first in (False, True):
        assert tables.full_refresh(orders, str(tmp_path / f"orders-{made_first}"), ["order_number"], made_first=made_first) == count
    assert gone(spark, before)
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == "false"
    for made_first in (False, True):
        back = spark.read.parquet(str(tmp_path / f"orders-{made_first}")).drop("synced_at")
        assert back.columns == orders.columns and back.exceptAll(orders).isEmpty() and orders.exceptAll(back).isEmpty()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["orders-False", "orders-True"]


def test_the_folds_are_off_the_disk_when_their_rows_are_laid_out(spark, feeds, tmp_path, monkeypatch):
    seen, laid_out = {}, R.laid_out
    before = shuffle_files(spark)

    def noted(df, keys, sample):
        seen[keys[0]] = shuffles(df), gone(spark, before)
        return laid_out(df, keys, sample)

    monkeypatch.setattr(R, "laid_out", noted)
    sources = {"delivery_orders": lambda: (feeds.delivery_lines,), "shipments": lambda: (feeds.outbound_lines, date(2000, 6, 30))}
    jobs = [job for job in P.refresh_jobs(str(tmp_path), sources) if job.name in sources]
    done = {r.name: (r.status, r.rows) for r in tables.run_jobs(spark, jobs).collect()}
    assert seen == {"order_number": (0, True), "order_token": (0, True)}
    assert done == {name: ("success", P.PIPELINES[name][0](*args()).count()) for name, args in sources.items()}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["delivery_orders", "shipments"]


def test_a_refresh_gives_the_session_its_own_setting_back(spark, tmp_path):
    for own in ("false", "true"):
        spark.conf.set(SHUFFLE_CLEANUP, own)
        try:
            with shuffles_dropped(spark):
                assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
            assert spark.conf.get(SHUFFLE_CLEANUP) == own
        finally:
            spark.conf.unset(SHUFFLE_CLEANUP)
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("k"))
    outcome = tables.run_jobs(spark, [tables.Job("broken", lambda: broken, str(tmp_path / "t"), ["k"], made_first=True)]).first()
    assert (outcome.status, outcome.rows) == ("error", 0) and not list(tmp_path.iterdir())
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == "false"
