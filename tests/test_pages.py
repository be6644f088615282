"""Result pages: whole, ragged, empty and torn ones."""

import json
from datetime import datetime
from unittest.mock import patch

import pyarrow as pa
import pyarrow.fs as pafs
import pytest

from quayline.sources import pages

SCHEMA = "id bigint, name string, amount double, seen timestamp"


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(pages.ResultPages)
    write(tmp_path, "p1.json", {"data": [{"id": 1, "name": "a", "amount": 1.5, "seen": "2024-01-02T03:04:05.000Z"}], "row_count": 1})
    write(tmp_path, "p2.json", {"columns": ["id"], "data": [{"id": 2, "other": [1, {"x": 2}]}, {"name": "ünï", "seen": "2024-01-02 03:04:05"}]})
    write(tmp_path, "p3.json", {"data": [], "row_count": 0})
    write(tmp_path, "p4.json", {"data": None})
    write(tmp_path, "_SUCCESS", {"data": [{"id": 99}]})
    return tmp_path


def write(folder, name, *documents, indent=None):
    (folder / name).write_text("\n".join(json.dumps(d, indent=indent) for d in documents), encoding="utf-8")


def load(spark, folder, schema=SCHEMA, **options):
    return spark.read.format("result_pages").schema(schema).options(**options).load(str(folder))


def test_rows_lack_fields_or_have_others(spark, folder):
    time = datetime(2024, 1, 2, 3, 4, 5)
    rows = load(spark, folder).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [(1, "a", 1.5, time), (2, None, None, None), (None, "ünï", None, time)], key=str)


def test_a_page_may_hold_documents_over_several_lines(spark, tmp_path):
    spark.dataSource.register(pages.ResultPages)
    documents = [{"data": [{"id": n}, {"id": n + 1}], "row_count": 2} for n in (0, 2, 4)]
    write(tmp_path, "lines.json", *documents)
    write(tmp_path, "indented.json", *documents, indent=2)
    assert sorted(r.id for r in load(spark, tmp_path).collect()) == sorted(2 * list(range(6)))


def test_long_texts_and_many_rows(spark, tmp_path):
    spark.dataSource.register(pages.ResultPages)
    write(tmp_path, "p.json", {"data": [{"id": n, "name": "x" * 3000} for n in range(2000)], "row_count": 2000})
    assert load(spark, tmp_path).selectExpr("count(*)", "sum(id)", "sum(length(name))").first() == (2000, 1999000, 6000000)


def test_a_task_takes_small_pages_together_and_large_ones_alone(spark, folder):
    assert load(spark, folder).rdd.getNumPartitions() == 1
    assert load(spark, folder, task_bytes=1).rdd.getNumPartitions() == 4
    assert load(spark, folder, task_bytes=1).count() == 3


def test_an_empty_folder_has_no_rows_and_a_missing_one_fails(spark, tmp_path):
    spark.dataSource.register(pages.ResultPages)
    assert load(spark, tmp_path).collect() == []
    with pytest.raises(Exception, match="FileNotFoundError"):
        load(spark, tmp_path / "nowhere").collect()


TORN = {
    "ends early": '{"data": [{"id": 1}, {"id"',
    "rows": json.dumps({"data": [{"id": 1}], "row_count": 2}),
    "2nd document": json.dumps({"data": [{"id": 1}]}) + "\n" + json.dumps({"data": [{"id": 2}], "row_count": 0}),
    "type": json.dumps({"data": [{"id": "many"}]}),
    "time": json.dumps({"data": [{"seen": "noon"}]}),
    "refused": json.dumps({"error": "no such table"}),
    "empty": "",
}


@pytest.mark.parametrize("fault", TORN)
def test_a_torn_page_fails_by_name_or_is_kept_as_a_row(spark, folder, fault):
    (folder / "p9.json").write_text(TORN[fault])
    with pytest.raises(Exception, match="TornPage.*p9.json"):
        load(spark, folder).collect()
    rows = load(spark, folder, SCHEMA + ", page_error string", torn="keep").collect()
    kept = [r for r in rows if r.page_error]
    assert len(rows) == 4 and len(kept) == 1 and "p9.json" in kept[0].page_error and kept[0].id is None


def test_keep_needs_the_column(spark, folder):
    with pytest.raises(Exception, match="page_error"):
        load(spark, folder, torn="keep").collect()


def test_a_page_is_parsed_in_blocks_and_a_long_document_in_a_longer_one(tmp_path):
    held = [3] * 20 + [400] + [0] + [3] * 20
    numbers = iter(range(1000))
    documents = [{"data": [{"id": next(numbers), "name": "a\nb"} for _ in range(n)], "row_count": n} for n in held]
    page = tmp_path / "page.json"
    page.write_text("\n".join(json.dumps(d) for d in documents) + "\n")
    size, schema = page.stat().st_size, pa.schema([("id", pa.int64()), ("name", pa.string())])
    found = {}
    for block in (300, 2000, size + 1):
        with patch.object(pages, "BLOCK_BYTES", block):
            batches = list(pages.page_rows(pafs.LocalFileSystem(), str(page), size, schema))
        found[block] = [row["id"] for batch in batches for row in batch.to_pylist()]
        assert block > size or len(batches) > 2
    assert set(map(tuple, found.values())) == {tuple(range(sum(held)))}


def test_a_torn_document_after_whole_ones_names_its_page(tmp_path):
    page = tmp_path / "page.json"
    page.write_text('{"data": [{"id": 1}]}\n' * 100 + '{"data": [{"id": 2}')
    with patch.object(pages, "BLOCK_BYTES", 200), pytest.raises(pages.TornPage, match="page.json"):
        list(pages.page_rows(pafs.LocalFileSystem(), str(page), page.stat().st_size, pa.schema([("id", pa.int64())])))
