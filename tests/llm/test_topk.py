import duckdb
import numpy as np
from brute import told
from compare import connect, differences
from conftest import SMALL
from pyspark.sql import functions as F

from quayline.llm import catalog, topk


def expected(ids, vectors, every, k):
    out = []
    for i, q in zip(ids, vectors):
        if i % every == 0:
            scored = sorted((-sum(int(a) * int(b) for a, b in zip(q, v)), j) for j, v in zip(ids, vectors) if j != i)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_against_sql(spark):
    found = differences(catalog.QUERIES["op10_topk_search"](spark, SMALL), connect(SMALL), catalog.CHECKS["op10_topk_search"])
    assert found is None, found


def test_many_tiles_with_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, (300, 6))
    rows = [(n, [float(x) for x in v]) for n, v in enumerate(vectors.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert told(topk.searched(df, every=10, scale=1), "query_id", "rank", "vec_id", "score") == expected(list(range(300)), vectors, 10, 5)


def test_large_values_are_exact(spark):
    rows = [(n, [float(2**20 + n), float(-(2**20) - 3 * n), 1.0]) for n in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = expected(list(range(4)), [[int(x) * 256 for x in v] for _, v in rows], 50, 5)
    assert told(topk.searched(df), "query_id", "rank", "vec_id", "score") == want


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, None), (100, [nan, 1.0]), (150, [1.0, None]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]),
            (2, [inf, 0.0]), (3, []), (4, [1.0]), (5, [-0.001, 0.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit("x"), "parts": F.lit(1), "block": F.lit(1)})
    got = told(topk.searched(df), "query_id", "rank", "vec_id", "score")
    assert got == [(0, 1, 4, 65536), (0, 2, 1, 32768), (0, 3, 1, 32768), (0, 4, 3, 0), (0, 5, 200, 0),
                   (200, 1, 0, 0), (200, 2, 1, 0), (200, 3, 1, 0), (200, 4, 3, 0), (200, 5, 4, 0)]
    assert told(topk.searched(df.limit(0))) == []


def test_rows_of_one_id_all_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 30)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(8)
    rows = [(n % 60, [float(x) for x in v]) for n, v in enumerate(rng.normal(size=(150, 5)).tolist())]
    rows += [(7, [0.5] * 5)] * 40 + [(50, [1.0] * 5)] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({catalog.CHECKS['op10_topk_search']})").fetchall())
    assert told(topk.searched(df), "query_id", "rank", "vec_id", "score") == want


def test_reading_stops_before_the_end(monkeypatch):
    """Lists with a few high values: bounds settle the queries before all is read."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(0, 4, (2000, 8))
    vectors[::100] += rng.integers(200, 300, (20, 8))
    queries = vectors[:7]
    ids = np.arange(2000)
    true = (queries @ vectors.T).astype(float)
    true[np.arange(7), np.arange(7)] = -1
    monkeypatch.setattr(topk, "DEPTHS", (1 / 4,))
    query_ids, found, _ = topk.best(queries, ids[:7], vectors, ids, 5)
    assert [found[query_ids == i].tolist() for i in range(7)] == [np.lexsort((ids, -true[i]))[:5].tolist() for i in range(7)]
