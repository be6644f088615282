"""Readers, writers and table maintenance, each as a round trip over the given tables."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from quayline import config
from quayline.plans import pipelines as P
from quayline.session import scratch_path
from quayline.sources import files, ingest, pages, tables
from quayline.sources.derived import BASE_TABLES
from quayline.suite import pipelines as C
from quayline.suite.registry import AS_OF, case

RECEIPT_TEXT_SQL = """
    SELECT CAST(adjustment_date AS VARCHAR) AS adjustment_date, facility_id, CAST(item_code AS VARCHAR) AS item_code,
           item_description, COALESCE(product_name, '') AS product_name, client_code,
           CAST(adjustment_id AS VARCHAR) AS adjustment_id, avl_quantity, unavl_quantity, return_quantity,
           CAST(std_cost AS DOUBLE) AS std_cost, CAST(extended_cost AS DOUBLE) AS extended_cost,
           file_name, process_flag
    FROM goods_receipts"""


def plain(receipts: DataFrame) -> DataFrame:
    return C.costs_as_double(receipts.select(*config.RECEIPT_COLUMNS))


def receipt_rows(t) -> DataFrame:
    return t.goods_receipts.select(*config.RECEIPT_COLUMNS)


@case("read_receipts_csv", RECEIPT_TEXT_SQL)
def read_receipts_csv(t):
    """Upper-case headers, the misspelt facility header, quantities as `12.0` and blanks for zero."""
    path = scratch_path(t.spark, "receipts-csv")
    out = receipt_rows(t).withColumns({
        c: F.when(F.col(c) == 0, F.lit("")).otherwise(F.col(c).cast("double").cast("string"))
        for c in config.RECEIPT_INTEGERS
    })
    headers = {c: c.upper() for c in out.columns} | {"facility_id": "FACILILTY_ID"}
    files.write_csv(out.withColumnsRenamed(headers), path)
    return plain(files.read_receipts_csv(t.spark, path))


@case("read_result_json", """
    SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS quantity, l_returnflag FROM lineitem""")
def read_result_json(t):
    """One result document per part, each `{"data": [...]}` with rows of its order lines."""
    path = scratch_path(t.spark, "result-json")
    row = F.struct(
        "l_orderkey", "l_partkey", F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_returnflag"),
    )
    t.lineitem.select(F.array(row).alias("data")).write.json(path)
    schema = "data array<struct<l_orderkey bigint, l_partkey bigint, quantity bigint, l_returnflag string>>"
    return files.read_result_json(t.spark, path, schema, by_line=True)


PAGE_ROWS = 1000


@case("paged_source", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_shipdate FROM lineitem""")
def paged_source(t):
    """Order lines in pages of a thousand rows with their counts, as a service sends them, read page by page."""
    path = scratch_path(t.spark, "pages")
    row = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    place = row.withColumn("page", F.floor(F.monotonically_increasing_id() / PAGE_ROWS))
    documents = place.groupBy("page").agg(
        F.collect_list(F.struct(*row.columns)).alias("data"), F.count(F.lit(1)).alias("row_count")
    )
    documents.drop("page").write.json(path)
    t.spark.dataSource.register(pages.ResultPages)
    return t.spark.read.format("result_pages").schema(row.schema).load(path)


@case("export_csv", """
    SELECT p_partkey, ' ' || p_name || ', ' || chr(34) || p_brand || chr(34) || chr(10) || 'x ' AS p_name, p_brand, p_type,
           p_size, p_retailprice FROM part""")
def export_csv(t):
    """Texts with commas, quotes, line breaks and blanks around them come back as they were."""
    path = scratch_path(t.spark, "export")
    text = F.concat(F.lit(" "), "p_name", F.lit(', "'), "p_brand", F.lit('"\nx '))
    rows = t.part.withColumn("p_name", text)
    files.write_csv(rows, path)
    return t.spark.read.options(**files.CSV_QUOTES).csv(path, header=True, schema=rows.schema, multiLine=True)


@case("warehouse_source", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'")
def warehouse_source(t):
    table = files.warehouse_table(t.spark, path=f"{t.folder}/lineitem.parquet")
    return table.filter(F.col("l_shipdate") >= F.lit(datetime(2000, 1, 1)).cast("timestamp_ntz")).select(
        "l_orderkey", "l_quantity"
    )


@case("full_refresh", C.DELIVERY_SQL)
def full_refresh(t):
    path = scratch_path(t.spark, "delivery-orders")
    tables.full_refresh(P.delivery_orders(t.delivery_lines), path, ["order_number"], made_first=True)
    return t.spark.read.parquet(path).drop("synced_at")


@case("full_refresh_table", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def full_refresh_table(t):
    """Two refreshes of a catalog table: the first version has half of the rows, the second all; the first is then removed."""
    folder = scratch_path(t.spark, "versions")
    table = "refreshed_" + folder.rsplit("-", 1)[1]
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    for part in (rows.filter("o_orderkey % 2 = 0"), rows):
        tables.full_refresh(part, table, ["o_orderkey"], versions=folder)
    tables.drop_old_versions(t.spark, table, folder)
    current = tables.table_location(t.spark, table)
    t.spark.sql(f"DROP TABLE {table}")  # the definition; the version's files stay
    return t.spark.read.parquet(current).drop("synced_at")


UPSERT_SQL = """
    SELECT adjustment_date, facility_id, item_code, adjustment_id,
           CASE WHEN adjustment_date >= DATE '2001-01-01' THEN avl_quantity + 2
                WHEN adjustment_date >= DATE '2000-06-01' THEN avl_quantity + 1
                ELSE avl_quantity END AS avl_quantity
    FROM goods_receipts"""


@case("upsert_receipts", UPSERT_SQL)
def upsert_receipts(t):
    """First load up to 2000; then changed rows from June 2000 and new rows, the newest twice.

    Small data is kept in monthly partitions; large tables take `adjustment_date` itself.
    """
    target = scratch_path(t.spark, "receipts")
    rows = t.goods_receipts.select(*config.RECEIPT_COLUMNS, "fetched_at").withColumn(
        "receipt_month", F.trunc("adjustment_date", "month")
    )
    keys = ["receipt_month", *config.RECEIPT_KEY]
    day = F.col("adjustment_date")
    seq = lambda df, n: df.withColumn("sequence", F.lit(n))
    changed = rows.filter(day >= "2000-06-01").withColumn("avl_quantity", F.col("avl_quantity") + 1)
    again = changed.filter(day >= "2001-01-01").withColumn("avl_quantity", F.col("avl_quantity") + 1)
    for batch in (seq(rows.filter(day < "2001-01-01"), 1), seq(changed, 1).unionByName(seq(again, 2))):
        tables.upsert(t.spark, target, batch, keys, "receipt_month")
    return t.spark.read.parquet(target).select(*config.RECEIPT_KEY, "avl_quantity")


INGEST_SQL = """
    WITH rows AS (SELECT adjustment_date AS day, avl_quantity = 7 AS bad FROM goods_receipts),
    runs AS (
        SELECT 'r1' AS run_id, 'receipts' AS source_id, 'success' AS status, COUNT(*) AS rows_fetched,
               COUNT(*) FILTER (NOT bad) AS rows_inserted, 0 AS rows_updated, 0 AS rows_unchanged,
               COUNT(*) FILTER (bad) AS rows_rejected, NULL AS error
        FROM rows WHERE day < DATE '2000-01-01'
        UNION ALL
        SELECT 'r2', 'receipts', 'success', COUNT(*), COUNT(*) FILTER (NOT bad AND day >= DATE '2000-01-01'),
               COUNT(*) FILTER (NOT bad AND day >= DATE '1999-07-01' AND day < DATE '2000-01-01'),
               COUNT(*) FILTER (NOT bad AND day < DATE '1999-07-01'), COUNT(*) FILTER (bad), NULL
        FROM rows WHERE day >= DATE '1999-01-01'
        UNION ALL SELECT 'r3', 'broken', 'error', NULL, NULL, NULL, NULL, NULL, 'no such feed'
        UNION ALL SELECT 'r4', 'slow', 'abandoned', NULL, NULL, NULL, NULL, NULL, NULL
        UNION ALL SELECT 'r5', 'slow', 'running', NULL, NULL, NULL, NULL, NULL, NULL)
    SELECT r.*, CASE r.source_id WHEN 'receipts' THEN (SELECT rows_fetched FROM runs WHERE run_id = 'r2') END AS last_row_count,
           CASE r.source_id WHEN 'receipts' THEN 'active' ELSE 'declared' END AS source_status,
           (SELECT COUNT(*) FROM rows WHERE NOT bad) AS table_rows, (SELECT SUM(rows_rejected) FROM runs) AS quarantined
    FROM runs r"""


@case("ingest_job", INGEST_SQL)
def ingest_job(t):
    """Two loads that overlap, one that fails, one whose driver died two days ago, and one that has just begun."""
    target, journal = scratch_path(t.spark, "receipts"), scratch_path(t.spark, "journal")
    day = F.col("adjustment_date")
    rows = t.goods_receipts.select(*config.RECEIPT_COLUMNS).withColumns({
        "receipt_month": F.trunc(day, "month"), "sequence": F.lit(1), "bad_number": F.array().cast("array<string>"),
        "item_code": F.when(F.col("avl_quantity") != 7, F.col("item_code")),
    })
    quantity = F.when(day >= "1999-07-01", F.col("avl_quantity") + 1).otherwise(F.col("avl_quantity"))

    def no_feed() -> DataFrame:
        raise OSError("no such feed")

    load = lambda run, source, read: ingest.run_ingest(
        t.spark, journal, source, read, target, run_id=run, partition="receipt_month")
    load("r1", "receipts", lambda: rows.filter(day < "2000-01-01"))
    load("r2", "receipts", lambda: rows.filter(day >= "1999-01-01").withColumn("avl_quantity", quantity))
    load("r3", "broken", no_feed)
    ingest.note(t.spark, journal, "r4", "slow", "start", at=datetime.now() - timedelta(days=2))
    ingest.note(t.spark, journal, "r5", "slow", "start")
    runs = ingest.runs_of(ingest.journal_events(t.spark, journal))
    declared = runs.select("source_id").distinct().withColumns({
        "last_run_at": F.lit(None).cast("timestamp"), "last_row_count": F.lit(None).cast("bigint"), "status": F.lit("declared"),
    })
    registry = tables.registry_after_runs(declared, runs).select(
        "source_id", "last_row_count", F.col("status").alias("source_status")
    )
    table, quarantine = (
        t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).scalar() for path in (target, f"{target}_quarantine"))
    return runs.join(registry, "source_id").select(
        "run_id", "source_id", "status", *ingest.COUNTS, "error", "last_row_count", "source_status",
        table.alias("table_rows"), quarantine.alias("quarantined"),
    )


@case("constraint_gate", """
    WITH parents AS (SELECT DISTINCT source_id FROM run_log WHERE status = 'success' AND source_id <> 'source4'),
    ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id, started_at ORDER BY run_id) AS rn FROM run_log)
    SELECT r.run_id, LIST_AGGREGATE(LIST_FILTER([
               CASE WHEN r.rows_fetched = 7 THEN 'rows_fetched_not_null' END,
               CASE WHEN r.status = 'skipped' THEN 'status_check' END,
               CASE WHEN r.rn > 1 THEN 'unique' END,
               CASE WHEN r.source_id = 'source4' THEN 'foreign_key' END], lambda x: x IS NOT NULL),
               'string_agg', ',') AS violations
    FROM ranked r""")
def constraint_gate(t):
    runs = t.run_log.withColumn("rows_fetched", F.nullif("rows_fetched", F.lit(7)))
    rules = tables.not_null("rows_fetched") | tables.one_of("status", ["success", "error"])
    parents = runs.filter("source_id <> 'source4'").select("source_id").distinct()
    gated = tables.constraint_gate(
        runs, rules, unique=(["source_id", "started_at"], "run_id"),
        foreign=("source_id", parents, "source_id"),
    )
    joined = F.nullif(F.array_join("violations", ","), F.lit(""))
    return gated.select("run_id", joined.alias("violations"))


@case("incremental_sync", """
    SELECT e.user_id, ARG_MAX(e.event_type, e.event_id) AS event_type, MAX(e.event_id) AS event_id
    FROM events e GROUP BY e.user_id""")
def incremental_sync(t):
    """Three runs over a source that grows between them; each reads past the stored mark, and buckets split."""
    target, state = scratch_path(t.spark, "synced"), scratch_path(t.spark, "state")
    source = t.events.select("user_id", "event_type", "event_id")
    last, users = t.events.agg(F.max("event_id"), F.approx_count_distinct("user_id")).first()
    for share in (8, 2, 1):
        tables.sync_incremental(
            t.spark, "events", source.filter(F.col("event_id") <= last // share), target, state, "event_id",
            keys=["user_id"], bucket_rows=users // 12 + 1, buckets=1,
        )
    return t.spark.read.parquet(target).select("user_id", "event_type", "event_id")


DESCRIBE_SQL = " UNION ALL ".join(
    f"""SELECT '{table}' AS table_name, column_name AS field_name,
        CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
             WHEN 'FLOAT[]' THEN 'array<float>' ELSE LOWER(column_type) END AS data_type
        FROM (DESCRIBE SELECT * FROM {table})"""
    for table in BASE_TABLES
)


@case("discover_schema", DESCRIBE_SQL)
def discover_schema(t):
    found = files.discover_schema({name: getattr(t, name) for name in BASE_TABLES})
    return found.select("table_name", "field_name", "data_type")


@case("schema_drift", """
    WITH lines AS (
        SELECT doc_id, UNNEST(STRING_SPLIT(text, chr(10))) AS line, 0 AS now, 1 AS was FROM documents
        UNION ALL
        SELECT doc_id, UNNEST(STRING_SPLIT(REPLACE(text, 'the', 'THE'), chr(10))), 1, 0 FROM documents),
    counted AS (SELECT doc_id, line, SUM(now) AS now, SUM(was) AS was FROM lines GROUP BY doc_id, line)
    SELECT doc_id, CAST(SUM(CASE WHEN was = 0 THEN now ELSE 0 END) AS BIGINT) AS added,
           CAST(SUM(CASE WHEN now = 0 THEN was ELSE 0 END) AS BIGINT) AS removed
    FROM counted GROUP BY doc_id""")
def schema_drift(t):
    versions = t.documents.withColumn("revised", F.replace("text", F.lit("the"), F.lit("THE")))
    return files.line_drift(versions, "doc_id", "text", "revised")


@case("run_log_append", """
    SELECT run_id, source_id, status, rows_fetched, CAST(90 + ((run_id % 1000 + 5) // 10) / 100.0 AS DOUBLE) AS duration_secs
    FROM run_log""")
def run_log_append(t):
    path = scratch_path(t.spark, "run-log")
    millis = (F.col("run_id") % 1000) * F.expr("INTERVAL '0.001' SECOND")
    runs = t.run_log.withColumn("finished_at", F.col("finished_at") + millis)
    for half in (runs.filter("status = 'success'"), runs.filter("status <> 'success'")):
        tables.append_runs(t.spark, path, half)
    log = t.spark.read.parquet(path)
    return log.select("run_id", "source_id", "status", "rows_fetched", "duration_secs")


@case("run_history", """
    SELECT source_id, run_id, status FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rn
        FROM run_log) WHERE rn <= 20""")
def run_history(t):
    return tables.run_history(t.run_log).select("source_id", "run_id", "status")


@case("connection_status", """
    SELECT n.n_name AS name, r.last_sync, COALESCE(r.last_status, 'never_run') AS last_status
    FROM (SELECT n_name FROM nation UNION ALL SELECT DISTINCT source_id FROM run_log) n
    LEFT JOIN (SELECT source_id, MAX(finished_at) AS last_sync,
                      ARG_MAX(status, run_id) AS last_status FROM run_log GROUP BY source_id) r
      ON r.source_id = n.n_name""")
def connection_status(t):
    connections = t.nation.select(F.col("n_name").alias("name")).unionByName(
        t.run_log.select(F.col("source_id").alias("name")).distinct()
    )
    return tables.connection_status(connections, t.run_log)


@case("source_registry", """
    WITH wins AS (SELECT source_id, MAX(finished_at) AS ran, ARG_MAX(rows_fetched, run_id) AS rows_fetched
                  FROM run_log WHERE status = 'success' GROUP BY source_id)
    SELECT s.source_id, CASE WHEN w.ran IS NULL THEN 'paused' ELSE 'active' END AS status,
           w.ran AS last_run_at, COALESCE(w.rows_fetched, 0) AS last_row_count
    FROM (SELECT n_name AS source_id FROM nation UNION SELECT source_id FROM run_log) s
    LEFT JOIN wins w ON w.source_id = s.source_id""")
def source_registry(t):
    entry = lambda df, name: df.select(
        F.col(name).alias("source_id"), F.lit("paused").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("last_run_at"), F.lit(0).cast("bigint").alias("last_row_count"),
    ).distinct()
    registry = tables.register_sources(entry(t.nation, "n_name"), entry(t.run_log, "source_id"))
    return tables.registry_after_runs(registry, t.run_log)


@case("refresh_summary", f"""
    SELECT 'products' AS name, 'success' AS status, (SELECT COUNT(*) FROM ({C.PRODUCTS_SQL})) AS rows
    UNION ALL SELECT 'po_lines', 'success', (SELECT COUNT(*) FROM po_details)
    UNION ALL SELECT 'inventory_eod', 'success', (SELECT COUNT(*) FROM onhand_eod WHERE snapshot_date >= DATE '2000-06-30' - 90)
    UNION ALL SELECT 'goods_receipts', 'success', (SELECT COUNT(*) FROM ({C.RECEIPTS_SQL}))
    UNION ALL SELECT 'delivery_orders', 'success', (SELECT COUNT(*) FROM ({C.DELIVERY_SQL}))
    UNION ALL SELECT 'shipments', 'success', (SELECT COUNT(*) FROM ({C.SHIPMENTS_SQL}))
    UNION ALL SELECT 'broken', 'error', 0
    UNION ALL SELECT 'after_broken', 'skipped', 0""")
def refresh_summary(t):
    """The six curated tables with what each needs first, one job that fails and one that needs it."""
    folder = scratch_path(t.spark, "refresh")
    refreshed = lambda name: t.spark.read.parquet(f"{folder}/{name}").drop("synced_at")
    sources = {
        "products": lambda: (t.product_revisions, t.packaging_versions),
        "po_lines": lambda: (t.po_details,),
        "inventory_eod": lambda: (t.onhand_eod, refreshed("products"), AS_OF),
        "goods_receipts": lambda: (t.receipts_source, C.TENANTS, C.FACILITIES),
        "delivery_orders": lambda: (t.delivery_lines,),
        "shipments": lambda: (t.outbound_lines, AS_OF),
    }
    jobs = P.refresh_jobs(folder, sources) + [
        tables.Job("broken", lambda: t.events.select("no_such_column"), f"{folder}/broken"),
        tables.Job("after_broken", lambda: t.events, f"{folder}/after", needs=["broken"]),
    ]
    return tables.run_jobs(t.spark, jobs).select("name", "status", "rows")


REPORT_SQL = """
    SELECT adjustment_date, facility_id, item_code, item_description, product_name,
           avl_quantity, unavl_quantity {net} FROM goods_receipts
    WHERE adjustment_date BETWEEN DATE '2000-05-31' AND DATE '2000-06-30'"""


@case("receipt_report_30d", REPORT_SQL.format(net=""))
def receipt_report_30d(t):
    return files.receipt_report(t.goods_receipts, AS_OF)


@case("receipt_net_tab", REPORT_SQL.format(net=", avl_quantity + unavl_quantity AS net_quantity"))
def receipt_net_tab(t):
    return files.receipt_net_tab(t.goods_receipts, AS_OF)


@case("report_stamp", """
    SELECT strftime(MAX(ts) - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS last_updated FROM events""")
def report_stamp(t):
    return files.report_stamp(t.events, "ts")
