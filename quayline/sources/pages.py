"""Result pages of a query service as a partitioned Spark source.

    spark.dataSource.register(ResultPages)
    rows = spark.read.format("result_pages").schema("id bigint, name string").load(folder)

A page is a file of one or more documents `{"data": [{...}, ...]}`, with a `row_count` and an `error` if
the service sends them. Pages are read by the executors, several small ones in a task, and go to Spark as
Arrow batches. Rows may lack fields (null) and have others than the schema's (left out). A page without
rows gives none.

A torn page fails the read with its name: one that is no JSON or ends early, one whose rows aren't as many
as its `row_count`, one with values that the schema can't take, and one that holds an `error`. With the
option `torn` = `keep`, the schema needs a text column `page_error`: a torn page then gives one row that is
null but for the page's name and what is wrong there, and none of its rows; rows of whole pages have null there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.json as pj
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

ERROR = "page_error"
#: Bytes of pages that a task reads, about; a page over that is a task of its own.
TASK_BYTES = 64 << 20
#: Bytes that one document of a page may have; a larger one makes the page a torn one.
DOCUMENT_BYTES = 256 << 20
#: Bytes of a page that are parsed at once, more only where a document has more.
BLOCK_BYTES = 1 << 20


class TornPage(ValueError):
    """A page that can't be read whole."""


@dataclass
class Pages(InputPartition):
    """The pages of a task with their sizes."""

    names: list[tuple[str, int]]


class ResultPages(DataSource):
    """Options: `path`; `torn` (`fail` or `keep`); `task_bytes`."""

    @classmethod
    def name(cls) -> str:
        return "result_pages"

    def schema(self) -> StructType:
        raise ValueError("result_pages needs a schema: .schema(...)")

    def reader(self, schema: StructType) -> PagesReader:
        return PagesReader(schema, self.options)


class PagesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path = options.get("path")
        self.keep = options.get("torn", "fail") == "keep"
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))
        self.row_schema = schema
        if not self.path:
            raise ValueError("result_pages needs a path: .load(path)")
        if self.keep and (ERROR not in schema.names or schema[ERROR].dataType != StringType()):
            raise ValueError(f"torn = keep needs a column `{ERROR} string` in the schema")

    def partitions(self) -> list[InputPartition]:
        """Pages in the order of their names, dealt to tasks by size; names with `_` or `.` in front are no pages."""
        system, root = pafs.FileSystem.from_uri(self.path)
        found = system.get_file_info(root)
        if found.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else system.get_file_info(pafs.FileSelector(root))
        tasks, room = [], 0
        for file in sorted(files, key=lambda f: f.path):
            if not file.is_file or file.base_name[0] in "_.":
                continue
            if not tasks or file.size > room:
                tasks.append(Pages([]))
                room = self.task_bytes
            tasks[-1].names.append((file.path, file.size))
            room -= file.size
        return tasks or [Pages([])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(self.path)
        schema = to_arrow_schema(self.row_schema)
        for name, size in partition.names:
            try:
                batches = page_rows(system, name, size, schema)
                # What follows a fault takes back what came before it only where the page is held till its end.
                yield from list(batches) if self.keep else batches
            except TornPage as torn:
                if not self.keep:
                    raise
                yield pa.RecordBatch.from_pylist([{ERROR: str(torn)}], schema)


def page_rows(system: pafs.FileSystem, name: str, size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a page's documents in batches of the schema."""
    own = [field for field in schema if field.name != ERROR]
    # The JSON reader knows times without a zone only.
    row = pa.struct([pa.field(f.name, pa.string() if zoned(f.type) else f.type) for f in own])
    document = pa.schema([("data", pa.list_(row)), ("row_count", pa.int64()), ("error", pa.string())])
    if not size:
        raise TornPage(f"{name}: empty file")
    most, block, given = min(size + 1, DOCUMENT_BYTES), min(size + 1, BLOCK_BYTES), 0
    while True:
        try:
            with system.open_input_stream(name) as stream:
                passed = 0
                for found in pj.open_json(
                    stream,
                    read_options=pj.ReadOptions(use_threads=False, block_size=block),
                    parse_options=pj.ParseOptions(
                        explicit_schema=document, newlines_in_values=True, unexpected_field_behavior="ignore"),
                ):
                    again = min(max(given - passed, 0), found.num_rows)
                    passed += found.num_rows
                    if again < found.num_rows:
                        yield from document_rows(found.slice(again), name, schema)
                        given = passed
            return
        except pa.ArrowInvalid as fault:
            if block == most:
                raise TornPage(f"{name}: {fault}") from fault
            block = min(block * 8, most)  # a document may be longer than the block; those given are passed over


def zoned(kind: pa.DataType) -> bool:
    return pa.types.is_timestamp(kind) and kind.tz is not None


def as_type(values: pa.Array, kind: pa.DataType) -> pa.Array:
    """Values in the schema's type; times that name no zone are in UTC."""
    if zoned(kind):
        named = pc.match_substring_regex(values, r"(Z|[+-]\d\d:?\d\d)$")
        values = pc.if_else(named, values, pc.binary_join_element_wise(values, "Z", ""))
    return values.cast(kind)


def document_rows(found: pa.RecordBatch, name: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for error in found.column("error").drop_null():
        raise TornPage(f"{name}: the service answered {error.as_py()!r}")
    data = found.column("data")
    for rows, expected in zip(data, found.column("row_count")):
        held = len(rows) if rows.is_valid else 0
        if expected.is_valid and expected.as_py() != held:
            raise TornPage(f"{name}: {held} rows of {expected.as_py()}")
    rows = data.flatten()
    columns = dict(zip([f.name for f in rows.type], rows.flatten()))
    arrays = [
        as_type(columns[f.name], f.type) if f.name in columns else pa.nulls(len(rows), f.type) for f in schema
    ]
    if len(rows):
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)
