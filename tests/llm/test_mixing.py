import duckdb
from brute import DOCS, told
from compare import connect, differences
from conftest import SMALL
from pyspark.sql import functions as F

from quayline.llm import catalog, mixing


def test_against_sql(spark):
    found = differences(catalog.QUERIES["op7_poisson_mix"](spark, SMALL), connect(SMALL), catalog.CHECKS["op7_poisson_mix"])
    assert found is None, found


def test_no_python_on_the_way(spark):
    plan = mixing.mixed(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_shares_and_order(spark):
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "a").alias("source"))
    found = mixing.mixed(df, {"hot": 0.5}).cache()
    count = {r.source: r["count"] for r in found.groupBy("source").count().collect()}
    assert abs(count["hot"] - 3000) < 250 and abs(count["a"] - 1500) < 200 and abs(count[None] - 1500) < 200
    assert mixing.mixed(df, {"hot": 0.5}, factor=2.0).count() > 1.9 * found.count()
    ids = [r.doc_id for r in found.orderBy("shuffle_key").limit(500).collect()]
    assert ids != sorted(ids) and max(ids) > 4000 > 1000 > min(ids)
    assert found.select("doc_id", "copy").distinct().count() == found.count()


def test_edge_rows(spark):
    rows = [(1, None, "en", "s", None), (1, None, "en", "s", None), (2, "", None, None, 0), (None, "t", None, "s", 1),
            (3, "long " * 50_000, None, "t", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"copy": F.lit("x"), "extra": F.lit(1), "mix_u": F.lit(2)})
    found = mixing.mixed(df, {"s": 0.4, "missing": 0.1}, factor=3.0)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "mix_u", "copy", "shuffle_key"]
    by = {}
    for r in found.collect():
        by.setdefault((r.doc_id, r.copy), []).append(r.shuffle_key)
    assert all(len(keys) == 2 and len(set(keys)) == 1 for (d, _), keys in by.items() if d == 1)
    assert told(mixing.mixed(spark.createDataFrame([], DOCS))) == []


def test_high_rates(spark, tmp_path):
    """One short document beside a large source: its rate is parted into draws, as in SQL."""
    df = spark.range(400).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "x").otherwise(F.repeat(F.lit("y"), 5000)).alias("text"),
        F.when(F.col("id") == 0, "tiny").otherwise("large").alias("source"))
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, copy, shuffle_key FROM ({mixing.check_sql({'tiny': 0.5})}) WHERE doc_id < 3").fetchall()
    found = mixing.mixed(df, {"tiny": 0.5}).where("doc_id < 3")
    assert told(found, "doc_id", "copy", "shuffle_key") == sorted(want)
    rate = 0.5 * (399 * 5001 + 2) / 2
    count = sum(1 for row in want if row[0] == 0)
    assert abs(count - rate) < 6 * rate ** 0.5


def test_a_rate_of_millions(spark):
    df = spark.createDataFrame([(1, "", "s"), (2, "z" * 2_000_000, "t")], "doc_id long, text string, source string")
    found = mixing.mixed(df, {"s": 0.5}).where("doc_id = 1").agg(F.count("*"), F.count_distinct("copy"), F.max("copy")).first()
    assert abs(found[0] - 1_000_001) < 6_000 and found[0] == found[1] and found[2] < 2_100_000
    table = mixing.thresholds(spark.createDataFrame([("s", 1e12), ("t", 1e-9), ("u", 256.0)], "source string, rate double"))
    for row in table.collect():
        assert len(row.below) <= mixing.STRIDE and abs(row.below[-1] - 1) < 1e-9 and row.below == sorted(row.below)


def test_large_inputs_get_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TASK_BYTES", 500)
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x" * 99).alias("text"), F.lit("s").alias("source"))
    assert mixing.mixed(df, {}).rdd.getNumPartitions() == 60
