import csv
import json
from datetime import date, datetime
from pathlib import Path
from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quayline import config
from quayline.operators import distinct as D, relational as R
from quayline.session import scratch_path
from quayline.sources import files, ingest, tables


def write_text(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_with_mark_aliases_and_bad_numbers(spark, tmp_path):
    path = write_text(tmp_path / "r.csv", "﻿ADJUSTMENT_DATE,FACILILTY_ID,item_code,AVL_QUANTITY,std_cost\n"
                      "2024-01-02,F1,A,3.7,\n2024-01-03,F1,B,,2.50\n2024-01-04,F1,C,many,1\n")
    rows = files.read_receipts_csv(spark, path).orderBy("item_code").collect()
    assert [r.adjustment_date for r in rows] == ["2024-01-02", "2024-01-03", "2024-01-04"]
    assert [r.avl_quantity for r in rows] == [3, 0, None]
    assert [float(r.std_cost) for r in rows] == [0.0, 2.5, 1.0]
    assert [r.bad_number for r in rows] == [[], [], ["avl_quantity"]]
    assert rows[0].facility_id == "F1" and rows[0].product_name == ""


def test_header_presence_decides_the_alias(spark, tmp_path):
    path = write_text(tmp_path / "r.csv", "ITEM_CODE,FACILITY_ID,FACILILTY_ID\nA,,F9\n")
    assert files.read_receipts_csv(spark, path).first().facility_id == ""


def test_csv_with_standard_quotes_and_headers_in_any_order(spark, tmp_path):
    header = ["ITEM_CODE", "ITEM_DESCRIPTION", "AVL_QUANTITY"]
    odd = '24" screen, "new"\nboxed '
    for name, order in {"a": header, "b": header[::-1]}.items():
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as file:
            writer = csv.DictWriter(file, order)
            writer.writeheader()
            writer.writerow({"ITEM_CODE": name, "ITEM_DESCRIPTION": odd, "AVL_QUANTITY": "7"})
    found = files.read_receipts_csv(spark, str(tmp_path), line_breaks=True).orderBy("item_code").collect()
    assert [(r.item_code, r.item_description, r.avl_quantity, r.bad_number) for r in found] == [("a", odd, 7, []), ("b", odd, 7, [])]


def test_csv_with_any_number_of_other_columns(spark, tmp_path):
    others = [f"X{n}" for n in range(300)]
    write_text(tmp_path / "wide.csv", ",".join([*others, "ITEM_CODE", "AVL_QUANTITY"]) + "\n" + ",".join(["0"] * 300 + ["W", "4"]) + "\n")
    write_text(tmp_path / "slim.csv", "AVL_QUANTITY,ITEM_CODE\n5,S\n")
    found = files.read_receipts_csv(spark, str(tmp_path)).orderBy("item_code").collect()
    assert [(r.item_code, r.avl_quantity, r.bad_number) for r in found] == [("S", 5, []), ("W", 4, [])]


def test_exported_csv_is_read_by_others(spark, tmp_path):
    rows = [(1, ' "quoted", with\nbreak '), (2, "plain"), (3, 'back\\slash "')]
    files.write_csv(spark.createDataFrame(rows, "id int, text string").coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*.csv"))
    with part.open(newline="", encoding="utf-8") as file:
        assert [(int(r["id"]), r["text"]) for r in csv.DictReader(file)] == rows


def test_json_forms(spark, tmp_path):
    ragged = [{"item_code": "A", "avl_quantity": 1}, {"item_code": "B", "extra": "x"}]
    for name, document in {"data": {"data": ragged}, "rows": {"rows": ragged, "columns": ["item_code"]}, "list": ragged}.items():
        path = write_text(tmp_path / f"{name}.json", json.dumps(document, indent=1))
        found = files.read_result_json(spark, path)
        assert sorted(found.columns) == ["avl_quantity", "extra", "item_code"]
        assert [r.item_code for r in found.orderBy("item_code").collect()] == ["A", "B"]
        assert files.read_receipts_json(spark, path).filter("avl_quantity = 0").first().item_code == "B"


def batch(spark, rows):
    full = [dict(zip(config.RECEIPT_COLUMNS, [None] * 14)) | r | {"sequence": n} for n, r in enumerate(rows)]
    schema = ", ".join(
        f"{c} {'bigint' if c in config.RECEIPT_INTEGERS else 'decimal(18,2)' if c in config.RECEIPT_AMOUNTS else 'string'}"
        for c in config.RECEIPT_COLUMNS) + ", sequence int"
    names = [*config.RECEIPT_COLUMNS, "sequence"]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], schema).withColumn(
        "bad_number", F.array().cast("array<string>"))


def receipt(day, item, quantity, adjustment="1"):
    return {"adjustment_date": day, "facility_id": "F1", "item_code": item, "adjustment_id": adjustment, "avl_quantity": quantity}


def load(spark, target, rows):
    stamp = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    return tables.load_receipts(spark, target, batch(spark, rows), stamp)


def test_upsert_is_idempotent_and_counts_truthfully(spark):
    target = scratch_path(spark, "t")
    rows = [receipt("2024-01-01", "A", 1), receipt("2024-01-01", "A", 2), receipt("2024-01-02", "B", 3, None),
            receipt(None, "C", 1), receipt("soon", "D", 1)]
    first = load(spark, target, rows)
    assert (first.inserted, first.updated, first.unchanged, first.rejected) == (2, 0, 0, 2)
    content = lambda: sorted(map(tuple, spark.read.parquet(target).select(
        "adjustment_date", "item_code", "avl_quantity").collect()))
    before = content()
    assert before == [(date(2024, 1, 1), "A", 2), (date(2024, 1, 2), "B", 3)]
    again = load(spark, target, rows)
    assert (again.inserted, again.updated, again.unchanged) == (0, 0, 2)
    assert content() == before
    changed = load(spark, target, [receipt("2024-01-02", "B", 9, None), receipt("2024-01-03", "E", 1)])
    assert (changed.inserted, changed.updated, changed.unchanged) == (1, 1, 0)
    assert content() == [(date(2024, 1, 1), "A", 2), (date(2024, 1, 2), "B", 9), (date(2024, 1, 3), "E", 1)]
    quarantine = spark.read.parquet(f"{target}_quarantine")
    assert quarantine.filter("item_code = 'D'").first().violations == ["adjustment_date_check"]
    assert quarantine.count() == 2  # the same file loaded twice


def test_ingest_notes_start_and_end(spark):
    target, journal = scratch_path(spark, "t"), scratch_path(spark, "j")
    rows = [receipt("2024-01-01", "A", 1), receipt("soon", "B", 1)]
    seen = []

    def read():
        seen.extend((r.run_id, r.status) for r in ingest.runs_of(ingest.journal_events(spark, journal)).collect())
        return batch(spark, rows)

    def half_way():
        return batch(spark, rows).withColumn("avl_quantity", F.raise_error(F.lit("half way")).cast("bigint"))

    assert ingest.run_ingest(spark, journal, "s", read, target, run_id="1").inserted == 1
    assert seen == [("1", "running")]
    assert ingest.run_ingest(spark, journal, "s", half_way, target, run_id="2") is None
    assert ingest.run_ingest(spark, journal, "s", lambda: batch(spark, rows), target, run_id="3").unchanged == 1
    ingest.note(spark, journal, "4", "s", "start", at=datetime(2020, 1, 1))
    runs = {r.run_id: r for r in ingest.runs_of(ingest.journal_events(spark, journal)).collect()}
    assert [runs[n].status for n in "1234"] == ["success", "error", "success", "abandoned"]
    counts = lambda n: [runs[n][c] for c in ingest.COUNTS]
    assert counts("1") == [2, 1, 0, 0, 1] and counts("3") == [2, 0, 0, 1, 1] and counts("2") == [None] * 5
    assert "half way" in runs["2"].error and runs["1"].duration_secs > 0 and runs["4"].duration_secs is None
    assert spark.read.parquet(target).count() == 1 and spark.read.parquet(f"{target}_quarantine").count() == 1
    assert ingest.journal_events(spark, scratch_path(spark, "none")).count() == 0


def test_incremental_reads_past_the_mark_only(spark):
    target, state = scratch_path(spark, "t"), scratch_path(spark, "s")
    make = lambda rows: spark.createDataFrame(rows, "id int, status string, version int")
    sync = lambda df: tables.sync_incremental(spark, "c", df, target, state, "version")
    assert sync(make([(1, "new", 1), (2, "new", 2)])).inserted == 2
    # A row behind the mark is not read again; one past it replaces its key.
    result = sync(make([(9, "behind", 1), (1, "done", 3)]))
    assert (result.inserted, result.updated) == (0, 1)
    assert sync(make([(1, "done", 3)])).inserted == 0
    assert sorted(map(tuple, spark.read.parquet(target).select("id", "status").collect())) == [(1, "done"), (2, "new")]
    other = tables.sync_incremental(spark, "other", make([(5, "x", 1)]), target, state, "version")
    assert other.inserted == 1


def test_constraints(spark):
    rows = spark.createDataFrame(
        [(1, "a", "success"), (2, "a", "success"), (3, None, "wrong"), (4, None, None), (5, "z", "error")],
        "id int, source string, status string")
    parents = spark.createDataFrame([("a",)], "source string")
    gated = tables.constraint_gate(
        rows, tables.not_null("status") | tables.one_of("status", config.RUN_STATUSES),
        unique=(["source"], "id"), foreign=("source", parents, "source"))
    found = {r.id: r.violations for r in gated.collect()}
    assert found == {1: [], 2: ["unique"], 3: ["status_check"], 4: ["status_not_null"], 5: ["foreign_key"]}
    assert tables.accepted(gated).count() == 1 and tables.quarantined(gated).count() == 4


def test_jobs_isolate_failures_and_skip_dependents(spark):
    folder = scratch_path(spark, "jobs")
    good = spark.range(3).toDF("id")
    jobs = [tables.Job("a", lambda: good.select("missing"), f"{folder}/a"),
            tables.Job("b", lambda: good, f"{folder}/b", needs=["a"]),
            tables.Job("c", lambda: good, f"{folder}/c", ["id"])]
    rows = {r.name: (r.status, r.rows) for r in tables.run_jobs(spark, jobs, ["a", "b", "c", "d"]).collect()}
    assert rows == {"a": ("error", 0), "b": ("skipped", 0), "c": ("success", 3), "d": ("error", 0)}


def test_a_failed_refresh_leaves_the_table(spark):
    target = scratch_path(spark, "kept")
    assert tables.full_refresh(spark.range(3).toDF("id"), target) == 3
    broken = spark.range(3).select(F.raise_error(F.lit("half way")).alias("id"))
    try:
        tables.full_refresh(broken, target)
    except Exception as error:
        assert "half way" in str(error)
    assert spark.read.parquet(target).count() == 3
    assert tables.full_refresh(spark.range(5).toDF("id"), target) == 5


def test_schema_drift(spark):
    old = files.discover_schema({"t": spark.createDataFrame([], "a int, b string")})
    new = files.discover_schema({"t": spark.createDataFrame([], "a bigint, c string")})
    rows = {r.field_name: r.change for r in files.schema_drift(old, new).collect()}
    assert rows == {"a": "retyped", "b": "removed", "c": "added"}


def test_a_refused_rename_loses_nothing(spark, monkeypatch):
    target = scratch_path(spark, "kept")
    tables.full_refresh(spark.range(3).toDF("id"), target)
    real = tables.move_folder

    def refused(fs, source, place):
        if "__new_" in source.toString():
            raise OSError("refused")
        real(fs, source, place)

    monkeypatch.setattr(tables, "move_folder", refused)
    with pytest.raises(OSError):
        tables.full_refresh(spark.range(9).toDF("id"), target)
    assert spark.read.parquet(target).count() == 3
    monkeypatch.undo()
    with pytest.raises(OSError):  # a rename that says false
        tables.move_folder(SimpleNamespace(rename=lambda source, place: False), "a", "b")
    assert tables.full_refresh(spark.range(9).toDF("id"), target) == 9


def test_versions_of_a_catalog_table(spark, tmp_path, monkeypatch):
    folder, table = str(tmp_path / "items"), "versioned_items"
    refresh = lambda df: tables.full_refresh(df, table, ["id"], versions=folder)
    assert refresh(spark.range(5).toDF("id")) == 5
    planned = spark.table(table).select("id")
    assert refresh(spark.range(2).toDF("id")) == 2
    assert spark.table(table).count() == 2 and planned.count() in (2, 5)
    # A write that fails leaves the version that was there; so does a switch that fails.
    with pytest.raises(Exception, match="half way"):
        refresh(spark.range(3).select(F.raise_error(F.lit("half way")).cast("long").alias("id")))
    assert spark.table(table).count() == 2
    monkeypatch.setattr(tables, "same_columns", lambda *x: (_ for _ in ()).throw(OSError("no catalog")))
    with pytest.raises(OSError):
        refresh(spark.range(7).toDF("id"))
    monkeypatch.undo()
    assert spark.table(table).count() == 2
    # Other columns take the old definition's place.
    assert refresh(spark.range(4).selectExpr("id", "'x' AS name")) == 4
    assert spark.table(table).columns == ["id", "name", "synced_at"] and spark.table(table).count() == 4
    assert len(tables.table_versions(spark, folder)) >= 4
    gone = tables.drop_old_versions(spark, table, folder, keep=2)
    assert len(tables.table_versions(spark, folder)) == 2 and len(gone) >= 2
    assert spark.table(table).count() == 4
    spark.sql(f"DROP TABLE {table}")


def bucket_files(target):
    return {p.parent.name: {f.name for f in p.parent.glob("*.parquet")} for p in Path(target.removeprefix("file:")).glob("key_bucket=*/*.parquet")}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_one_more_bucket_moves_keys_of_one_bucket(spark, n):
    keys = spark.range(20_000).select("id", tables.key_bucket(["id"], n).alias("a"), tables.key_bucket(["id"], n + 1).alias("b"))
    moves = {tuple(r) for r in keys.filter("a <> b").select("a", "b").distinct().collect()}
    assert moves == {(tables.split_source(n, n), n)}
    sizes = [r["count"] for r in keys.groupBy("b").count().collect()]
    assert len(sizes) == n + 1


def test_results_do_not_depend_on_the_buckets(spark):
    rows = [(i, "a", i) for i in range(300)]
    later = [(i, "b", 1000 + i) for i in range(250, 330)]
    make = lambda rows: spark.createDataFrame(rows, "id int, status string, version int")
    found = set()
    for buckets, bucket_rows in ((1, 10**6), (64, 10**6), (1000, 10**6), (1, 40), (3, 17)):
        target, state = scratch_path(spark, "t"), scratch_path(spark, "s")
        for part in (rows, later):
            tables.sync_incremental(spark, "c", make(part), target, state, "version", bucket_rows=bucket_rows, buckets=buckets)
        found.add(tuple(sorted(map(tuple, spark.read.parquet(target).select("id", "status", "version").collect()))))
        assert tables.newest_layout(spark, target)["rows"] == 330
    assert len(found) == 1 and len(next(iter(found))) == 330


def test_a_small_batch_touches_the_buckets_of_its_keys(spark):
    target, state = scratch_path(spark, "t"), scratch_path(spark, "s")
    make = lambda rows: spark.createDataFrame(rows, "id int, version int")
    sync = lambda rows: tables.sync_incremental(spark, "c", make(rows), target, state, "version", bucket_rows=100)
    sync([(i, i) for i in range(1000)])
    before = bucket_files(target)
    assert len(before) == 10 and tables.newest_layout(spark, target)["buckets"] == 10
    sync([(7, 5000), (8, 5001)])
    after = bucket_files(target)
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2 and before.keys() == after.keys()
    sync([(2000 + i, 6000 + i) for i in range(3)])  # one bucket more
    grown = bucket_files(target)
    assert tables.newest_layout(spark, target)["buckets"] == 11 and grown.keys() - after.keys() == {"key_bucket=10"}
    assert sum(after[b] != grown[b] for b in after) <= 4
    assert spark.read.parquet(target).count() == 1003


def test_a_split_that_failed_is_ended_by_the_next_load(spark, monkeypatch):
    target, state = scratch_path(spark, "t"), scratch_path(spark, "s")
    make = lambda rows: spark.createDataFrame(rows, "id int, version int")
    sync = lambda rows: tables.sync_incremental(spark, "c", make(rows), target, state, "version", bucket_rows=50, buckets=1)
    real = tables.drop_folder
    monkeypatch.setattr(tables, "drop_folder", lambda spark, path: (_ for _ in ()).throw(OSError("lost")) if "split-" in path else real(spark, path))
    with pytest.raises(OSError):
        sync([(i, i) for i in range(200)])
    monkeypatch.undo()
    assert tables.newest_layout(spark, target)["split_from"] == 1
    sync([(i, 1000 + i) for i in range(100, 210)])
    found = sorted(map(tuple, spark.read.parquet(target).select("id", "version").collect()))
    assert found == [(i, i if i < 100 else 1000 + i) for i in range(210)]


def test_report_catalog(spark):
    from quayline.plans import reports

    assert {r.name for r in reports.report_catalog(spark).collect()} == set(reports.REPORTS)
    try:
        reports.run_report("nothing")
    except KeyError as error:
        assert "facility_summary" in str(error)
    else:
        raise AssertionError


def test_curve_lets_every_key_skip_files(spark, tmp_path):
    rows = spark.range(20_000).select(
        (F.xxhash64("id") % 300).alias("day"), F.concat(F.lit("F"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)).cast("string")).alias("site"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(500)).alias("item"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, None, None, -1), (None, "F1", None, -2)], rows.schema))
    keys = ["day", "site", "item"]
    R.write_on_curve(rows, f"{tmp_path}/curve", keys, files=64)
    rows.repartitionByRange(64, *keys).sortWithinPartitions(*keys).write.parquet(f"{tmp_path}/sorted")
    assert spark.read.parquet(f"{tmp_path}/curve").exceptAll(rows).isEmpty() and spark.read.parquet(f"{tmp_path}/curve").count() == 20_002

    def share(folder, key, value):
        """The share of files that a filter on one key has to read."""
        read = total = 0
        for file in Path(f"{tmp_path}/{folder}").glob("*.parquet"):
            meta = pq.ParquetFile(file).metadata
            place = meta.schema.names.index(key)
            stats = [meta.row_group(n).column(place).statistics for n in range(meta.num_row_groups)]
            read += any(s.has_min_max and s.min <= value <= s.max for s in stats)
            total += 1
        return read / total

    for key, value in (("day", 7), ("site", "F17"), ("item", 250)):
        assert share("curve", key, value) <= 0.5, key
    assert share("sorted", "item", 250) > 0.9


def test_curve_edges(spark, tmp_path):
    schema = "a int, b string"
    R.write_on_curve(spark.createDataFrame([], schema), f"{tmp_path}/none", ["a", "b"])
    assert spark.read.schema(schema).parquet(f"{tmp_path}/none").count() == 0
    hot = spark.createDataFrame([(1, "x")] * 500 + [(None, None)] * 3, schema)
    R.write_on_curve(hot, f"{tmp_path}/hot", ["a", "b"], files=4)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in Path(f"{tmp_path}/hot").glob("*.parquet")]
    assert sum(sizes) == 503 and max(sizes) < 250


def test_curve_files_start_at_round_places(spark):
    places = spark.range(4096).filter("id % 37 <> 5").toDF("_curve")
    assert R.curve_starts(places, 16) == list(range(256, 4096, 256)) and R.curve_starts(places, 1) == []
    assert R.curve_starts(spark.range(9).selectExpr("7L AS _curve"), 4) == [7, 7, 7]
    assert R.curve_starts(places.limit(0), 4) == []


def test_curve_in_one_file(spark, tmp_path):
    rows = spark.createDataFrame([(3, "x"), (None, "y"), (1, None)], "a int, b string")
    R.write_on_curve(rows, f"{tmp_path}/one", ["a", "b"], files=1)
    assert sorted(map(str, map(tuple, spark.read.parquet(f"{tmp_path}/one").collect()))) == ["(1, None)", "(3, 'x')", "(None, 'y')"]
    assert len(list(Path(f"{tmp_path}/one").glob("*.parquet"))) == 1


def test_distinct_levels(spark):
    rows = [("a", 1, "x", 7), ("a", 1, "x", 8), ("a", 2, "y", 7), ("b", 1, "x", None), ("b", None, None, 9), (None, 1, "z", 9), ("c", 3, None, None)]
    df = spark.createDataFrame(rows, "f string, c int, u string, v int")
    levels = {"fc": ["f", "c"], "f": ["f"], "all": []}
    got = D.distinct_levels(df, levels, {"us": "u", "vs": "v"})
    want = []
    for label, own in levels.items():
        for key in {tuple(r["fc".index(g)] for g in own) for r in rows}:
            mine = [r for r in rows if tuple(r["fc".index(g)] for g in own) == key]
            full = dict(zip(own, key))
            want.append((label, full.get("f"), full.get("c"), len({r[2] for r in mine} - {None}), len({r[3] for r in mine} - {None})))
    told = sorted(((r.level, r.f, r.c, r.us, r.vs) for r in got.select("level", "f", "c", "us", "vs").collect()), key=str)
    assert told == sorted(want, key=str)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    none = D.distinct_levels(df.limit(0), levels, {"us": "u"})
    assert [(r.level, r.us) for r in none.collect()] == [("all", 0)]


def test_distinct_values_over_several_buckets(spark):
    df = spark.range(70_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 69_000).alias("v"))
    got = D.distinct_levels(df, {"g": ["g"], "all": []}, {"n": "v"})
    assert sorted((str(r.g), r.n) for r in got.collect()) == sorted(
        [(str(r.g), r.n) for r in df.groupBy("g").agg(F.count_distinct("v").alias("n")).collect()] + [("None", 69_000)])
