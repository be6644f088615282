"""Readers and writers for the receipt files and query results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quayline import config
from quayline.functions import scalars as S


def resolved_headers(columns: list[str]) -> dict[str, str]:
    """Receipt column -> header in the file. The upper-case form wins, then lower, then aliases."""
    found = {}
    for name in config.RECEIPT_COLUMNS:
        for header in [name.upper(), name, *config.RECEIPT_HEADER_ALIASES.get(name, [])]:
            if header in columns:
                found[name] = header
                break
    return found


def file_order() -> Column:
    """A sortable place of each row: file, split of the file, row in the split."""
    meta = F.col("_metadata")
    return F.struct(
        meta.getField("file_path").alias("file"),
        meta.getField("file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def receipts_from_text(raw: DataFrame, sequence: Column | None = None) -> DataFrame:
    """Typed receipts from text columns, with `bad_number` naming columns that do not parse."""
    headers = resolved_headers(raw.columns)
    columns, bad = [], []
    for name in config.RECEIPT_COLUMNS:
        source = F.col(f"`{headers[name]}`").cast("string") if name in headers else None
        if name in config.RECEIPT_INTEGERS:
            value = F.lit(0).cast("bigint") if source is None else S.whole_number(source)
        elif name in config.RECEIPT_AMOUNTS:
            value = F.lit(0).cast("decimal(18,2)") if source is None else S.amount(source)
        else:
            value = F.lit("") if source is None else F.coalesce(source, F.lit(""))
        if name in config.RECEIPT_INTEGERS + config.RECEIPT_AMOUNTS:
            bad.append(F.when(value.isNull(), F.lit(name)))
        columns.append(value.alias(name))
    extra = [F.array_compact(F.array(*bad)).alias("bad_number")]
    if sequence is not None:
        extra.append(sequence.alias("sequence"))
    return raw.select(*columns, *extra)


#: Standard quoting: a quote within quotes is doubled, and blanks belong to the text.
CSV_QUOTES = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def header_width(spark: SparkSession, path: str) -> int:
    """At least as many columns as the widest header below a path has: one more than the commas of its line."""
    lines = spark.read.text(path).select(
        file_order().alias("place"), F.col("_metadata.file_path").alias("file"), F.regexp_count("value", F.lit(",")).alias("commas")
    )
    first = lines.groupBy("file").agg(F.min_by("commas", "place").alias("commas"))
    return 1 + (first.agg(F.max("commas")).first()[0] or 0)


def read_receipts_csv(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Receipts from CSV files with a header; a byte-order mark and header aliases are accepted.

    Fields are taken by their names in the header of their own file, so files of one folder may order
    their columns differently, and have any number of others. Spark splits large files over tasks; with
    `line_breaks`, fields may hold line breaks and each file is one task. A header has no line breaks.
    """
    wide = ", ".join(f"_c{n} string" for n in range(header_width(spark, path)))
    raw = spark.read.schema(wide).options(**CSV_QUOTES, multiLine=line_breaks).csv(path)
    rows = raw.select(
        F.array(*raw.columns).alias("_cells"), file_order().alias("sequence"), F.col("_metadata.file_path").alias("_file")
    )
    first = rows.groupBy("_file").agg(
        F.min_by(F.transform("_cells", lambda c: F.replace(c, F.lit("\ufeff"), F.lit(""))), "sequence").alias("_header"),
        F.min("sequence").alias("_top"),
    )
    # One row a file goes to every task; the rows of the files stay where they are read.
    named = rows.join(F.broadcast(first), "_file").filter(F.col("sequence") > F.col("_top"))
    columns = []
    for name in config.RECEIPT_COLUMNS:
        places = [
            F.nullif(F.array_position("_header", header), F.lit(0))
            for header in (name.upper(), name, *config.RECEIPT_HEADER_ALIASES.get(name, []))
        ]
        columns.append(F.get("_cells", F.coalesce(*places).cast("int") - 1).alias(name.upper()))
    return receipts_from_text(named.select(*columns, "sequence"), F.col("sequence"))


def read_result_json(spark: SparkSession, path: str, schema: str | None = None, by_line: bool = False) -> DataFrame:
    """Rows of a result document: `{"data": [...]}`, `{"rows": [...]}` or a bare list.

    Rows with differing keys get the union of the keys. A whole-file document is read by one task;
    with `by_line` every line is a document of its own, and large files are split.
    """
    reader = spark.read.option("multiLine", not by_line)
    return rows_of((reader.schema(schema) if schema else reader).json(path))


def rows_of(document: DataFrame) -> DataFrame:
    """The rows that result documents hold; a document that is a row already stays one."""
    for name in ("data", "rows"):
        if name in document.columns and document.schema[name].dataType.simpleString().startswith("array<struct"):
            return document.select(F.inline(name))
    return document


def read_receipts_json(spark: SparkSession, path: str) -> DataFrame:
    rows = read_result_json(spark, path)
    return receipts_from_text(rows, F.struct(F.monotonically_increasing_id().alias("row")))


def run_sql(spark: SparkSession, text: str, params: dict, **frames: DataFrame) -> DataFrame:
    """SQL text with bound parameters (`:name`) over the given DataFrames (`{name}`)."""
    return spark.sql(text, args=params, **frames)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header and standard quoting; blanks around a text stay."""
    df.write.mode("overwrite").options(**CSV_QUOTES, header=True).csv(path)


def warehouse_table(
    spark: SparkSession, name: str | None = None, path: str | None = None, **jdbc: str
) -> DataFrame:
    """A source table by catalog name, by parquet path or over JDBC.

    A JDBC read takes `partitionColumn`, `lowerBound`, `upperBound` and `numPartitions` so that
    executors read in parallel; filters and column choice go to the source in all three forms.
    """
    if name:
        return spark.table(name)
    if path:
        return spark.read.parquet(path)
    return spark.read.format("jdbc").options(**jdbc).load()


def discover_schema(tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per field of each table."""
    rows = [
        (
            table, field.name, field.dataType.simpleString(), field.nullable,
            field.metadata.get("comment", ""), field.name in (keys or {}).get(table, []),
        )
        for table, df in tables.items()
        for field in df.schema.fields
    ]
    session = next(iter(tables.values())).sparkSession
    schema = ("table_name string, field_name string, data_type string, nullable boolean, "
              "description string, is_primary_key boolean")
    return session.createDataFrame(rows, schema)


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fields added, removed or retyped between two results of `discover_schema`."""
    before = old.select("table_name", "field_name", F.col("data_type").alias("old_type"))
    after = new.select("table_name", "field_name", F.col("data_type").alias("new_type"))
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    joined = before.join(after, ["table_name", "field_name"], "full").withColumn("change", change)
    return joined.filter(F.col("change").isNotNull())


def line_drift(documents: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Lines added and removed per document between two versions of its text.

    A line counts as added when the old version has it nowhere. Lines are counted per document
    and version before the versions meet.
    """
    lines = documents.select(
        key, F.explode(F.split(new, "\n")).alias("line"), F.lit(1).alias("now"), F.lit(0).alias("was")
    ).unionByName(documents.select(
        key, F.explode(F.split(old, "\n")).alias("line"), F.lit(0).alias("now"), F.lit(1).alias("was")
    ))
    counted = lines.groupBy(key, "line").agg(F.sum("now").alias("now"), F.sum("was").alias("was"))
    return counted.groupBy(key).agg(
        F.sum(F.when(F.col("was") == 0, F.col("now")).otherwise(0)).alias("added"),
        F.sum(F.when(F.col("now") == 0, F.col("was")).otherwise(0)).alias("removed"),
    )


def receipt_report(receipts: DataFrame, as_of, days: int = 30) -> DataFrame:
    """The spreadsheet slice: seven columns of the last days, numbers never blank."""
    cutoff = F.date_sub(S.as_date(as_of), days)
    text = [
        "adjustment_date", "facility_id", "item_code", "item_description", "product_name",
    ]
    return (
        receipts.filter((F.to_date("adjustment_date") >= cutoff)
                        & (F.to_date("adjustment_date") <= S.as_date(as_of)))
        .select(
            *text,
            *[S.number_or_zero(F.col(c).cast("string"), "bigint").alias(c)
              for c in ("avl_quantity", "unavl_quantity")],
        )
        .orderBy(F.desc("adjustment_date"), "facility_id", "item_code")
    )


def receipt_net_tab(receipts: DataFrame, as_of, days: int = 30) -> DataFrame:
    return receipt_report(receipts, as_of, days).withColumn(
        "net_quantity", F.col("avl_quantity") + F.col("unavl_quantity")
    )


def report_stamp(loaded: DataFrame, column: str, zone: str = "America/Los_Angeles") -> DataFrame:
    """The newest load time as the report's "last updated" cell, in a named zone."""
    local = F.from_utc_timestamp(F.max(F.col(column)).cast("timestamp"), zone)
    return loaded.agg(F.date_format(local, "yyyy-MM-dd HH:mm").alias("last_updated"))
