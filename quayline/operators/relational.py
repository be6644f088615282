"""Joins, windows and set operations shared by the pipelines and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quayline.functions import scalars as S
from quayline.session import scratch_path

def newest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Spark keeps one row per key before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def at_latest_per_group(df: DataFrame, group: str, stamp: str) -> DataFrame:
    """The rows at each group's own newest stamp.

    The newest stamps are aggregated first (one row per group); joining them back never gathers a
    group's rows in one task, which a window over the group would.
    """
    newest = df.groupBy(group).agg(F.max(stamp).alias(stamp))
    return df.join(newest, [group, stamp], "left_semi")


def at_latest_per_group_by_window(df: DataFrame, group: str, stamp: str) -> DataFrame:
    """The same rows by a window; the second form that the tests compare with."""
    newest = F.max(stamp).over(Window.partitionBy(group))
    return df.withColumn("_newest", newest).filter(F.col(stamp) == F.col("_newest")).drop("_newest")


def with_previous(
    df: DataFrame, key: str, ts: str, tie: str, carried: list[str], slot_seconds: int = 3600
) -> DataFrame:
    """Add `previous`, a struct of the carried columns of the key's row just before this one.

    Like lag over the key, but a key with very many rows is split into time slots: lag runs inside
    a slot, and the first row of a slot takes the last row of the key's slot before it. Rows without
    a time come first, as a slot of their own; so do rows of a null key, as a key.
    """
    slots = df.withColumn("_slot", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(slot_seconds * 1_000_000)))
    record = F.struct(ts, tie, *[c for c in carried if c not in (ts, tie)])
    last = (
        slots.groupBy(key, "_slot")
        .agg(F.max_by(record, F.struct(ts, tie)).alias("_last"))
        .withColumn(
            "_before", F.lag("_last").over(Window.partitionBy(key).orderBy("_slot"))
        )
        .select(F.col(key).alias("_key"), F.col("_slot").alias("_key_slot"), "_before")
    )
    inside = F.lag(record).over(Window.partitionBy(key, "_slot").orderBy(ts, tie))
    joined = slots.withColumn("_inside", inside).join(
        last, F.col(key).eqNullSafe(F.col("_key")) & F.col("_slot").eqNullSafe(F.col("_key_slot")), "left"
    )
    return joined.withColumn("previous", F.coalesce("_inside", "_before")).drop(
        "_slot", "_key", "_key_slot", "_before", "_inside"
    )


#: Words of 64 bits that a filter of keys has at most: 4 MB of bits, some 16 MB as a broadcast table.
FILTER_WORDS = 1 << 19


def among(df: DataFrame, column: str, keys: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """The rows whose value is among the keys, for keys that may be too many to broadcast.

    A bitmap of the keys' hashes, of a bounded size, goes to every task and drops most other rows before
    they are shuffled; the join by the keys themselves then decides. That join is an inner one with each
    key once: Spark would put a semi join below the bitmap's.
    """
    kind = df.schema[column].dataType
    place = F.pmod(F.xxhash64(F.col(column).cast(kind)), F.lit(64 * words))
    word, bit = F.shiftright("_place", 6), F.col("_place").bitwiseAND(63).cast("int")
    own = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = keys.select(place.alias("_place")).groupBy(word.alias("_word")).agg(F.bit_or(own).alias("_bits"))
    likely = df.withColumn("_place", place).join(F.broadcast(bits), word == F.col("_word"))
    each = keys.select(F.col(column).cast(kind).alias("_key")).distinct()
    return likely.filter(F.getbit("_bits", bit) == 1).join(each, F.col(column) == F.col("_key")).select(*df.columns)


def optional_equals(df: DataFrame, column: str, value) -> DataFrame:
    """Filter only when a value is given."""
    return df if value is None else df.filter(F.col(column) == F.lit(value))


def not_blank(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def since(column: str, as_of, days: int) -> Column:
    """The days from `as_of - days` through `as_of`."""
    today = S.as_date(as_of)
    return F.col(column).between(F.date_sub(today, days), today)


def half_open_days(column: str, as_of, days: int) -> Column:
    """The `days` calendar days that end with `as_of`, as a half-open range."""
    today = S.as_date(as_of)
    return (F.col(column) >= F.date_sub(today, days - 1)) & (F.col(column) < F.date_add(today, 1))


def expand_aliases(df: DataFrame, column: str, aliases: dict[str, list[str]]) -> DataFrame:
    """Add `alias` for every short name that stands for the column's code.

    The alias map is configuration; as a literal map it takes no join.
    """
    by_code: dict[str, list[str]] = {}
    for name, codes in aliases.items():
        for code in codes:
            by_code.setdefault(code, []).append(name)
    pairs = [
        item
        for code, names in by_code.items()
        for item in (F.lit(code), F.array(*[F.lit(n) for n in names]))
    ]
    lookup = F.create_map(*pairs)
    return df.withColumn("alias", F.explode(F.try_element_at(lookup, F.col(column))))


def alias_table(spark, aliases: dict[str, list[str]]) -> DataFrame:
    """An alias map as rows (alias, code)."""
    schema = "aliases map<string, array<string>>"
    source = spark.createDataFrame([(aliases,)], schema)
    pairs = source.select(F.explode("aliases").alias("alias", "codes"))
    return pairs.select("alias", F.explode("codes").alias("code"))


def rows_only_in(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.exceptAll(old)


def both_ways(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows on one side only, with their surplus count; counted once per side before joining."""
    columns = new.columns
    counted = (
        new.select(*columns, F.lit(1).alias("_weight"))
        .unionByName(old.select(*columns, F.lit(-1).alias("_weight")))
        .groupBy(*columns)
        .agg(F.sum("_weight").alias("surplus"))
        .filter("surplus <> 0")
    )
    side = F.when(F.col("surplus") > 0, "added").otherwise("removed")
    return counted.withColumn("side", side).withColumn("surplus", F.abs("surplus"))


def clustered_for_write(df: DataFrame, *order: Column | str) -> DataFrame:
    """Lay rows out for a sorted table: range partitions, each sorted inside."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


#: One of how many rows gives its keys for the bounds of a layout, and how many such keys a file stands for.
LAYOUT_SHARE, LAYOUT_KEYS = 2000, 100


def with_range(df: DataFrame, key: Column, bounds: Column, ranges: int) -> DataFrame:
    """Add `_range`, how many of the sorted bounds a row's key reaches, below `ranges`; found by halving."""
    out = df.withColumns({"_bounds": bounds, "_range": F.lit(0)})
    # A column for each step: as one expression it would double with every step.
    for step in (1 << n for n in reversed(range((ranges - 1).bit_length()))):
        reached = F.get("_bounds", F.col("_range") + (step - 1)) <= key  # null past the last bound
        out = out.withColumn("_range", F.col("_range") + F.coalesce(reached.cast("int"), F.lit(0)) * step)
    return out.drop("_bounds")


def laid_out(df: DataFrame, keys: list[str], sample: str) -> DataFrame:
    """The layout of `clustered_for_write` for rows that are costly to make: they are made once.

    Spark's range partitioning makes every row with all its columns once before, to sample the keys. Here the
    bounds come from a sample of the key columns by themselves, so Spark leaves out what only the other
    columns need. The sample shapes the layout and nothing else. It is written to the folder `sample`, which
    has to stay until the rows are written.
    """
    key = F.struct(*[F.col(name).alias(f"_{n}") for n, name in enumerate(keys)])
    df.select(key.alias("_key")).sample(1 / LAYOUT_SHARE, seed=1).write.parquet(sample)
    spark = df.sparkSession
    sampled = spark.read.schema(df.select(key.alias("_key")).schema).parquet(sample)
    found = sampled.count()
    # Files of about the same number of rows; a small table has at least a file for each core, if not too small.
    ranges = 1 + max(found // LAYOUT_KEYS, min(found // 10, spark.sparkContext.defaultParallelism))
    if ranges == 1:
        return df.repartition(1).sortWithinPartitions(*keys)
    place = F.floor(F.col("_n") * F.lit(found) / F.lit(ranges)).cast("int")
    bounds = (
        sampled.agg(F.sort_array(F.collect_list("_key")).alias("_keys"))
        .select("_keys", F.explode(F.sequence(F.lit(1), F.lit(ranges - 1))).alias("_n"))
        .agg(F.sort_array(F.collect_list(F.get("_keys", place))))
    )
    dealt = with_range(df, key, bounds.scalar(), ranges).repartitionById(ranges, "_range")
    return dealt.drop("_range").sortWithinPartitions(*keys)


#: Rows that the bounds of a curve's cells are taken from, about, and bits of each key's cell number.
CURVE_SAMPLE, CURVE_BITS = 20_000, 6


def curve_place(df: DataFrame, keys: list[str], bits: int = CURVE_BITS, sample: int = CURVE_SAMPLE) -> Column:
    """The place of a row on a Z-shaped curve through the cells that all keys span together.

    A key's range is cut into `2 ** bits` cells of about equal numbers of rows; the bits of the keys' cell
    numbers are interleaved, so rows that are near on the curve are near in each key. Bounds come from a
    random sample of about `sample` rows, as those of any range partitioning do: they shape the layout
    and nothing else. Nulls are in the lowest cell. The cells of a key with few values are spread over the
    whole range of numbers, so that its upper bits halve its rows as those of other keys do.
    """
    cells = 1 << bits
    seen = df.sample(min(1.0, sample / max(df.count(), 1)), seed=1).select(*keys).collect()
    place = F.lit(0).cast("long")
    for n, key in enumerate(keys):
        values = sorted(row[key] for row in seen if row[key] is not None)
        bounds = sorted({values[len(values) * cell // cells] for cell in range(1, cells)}) if values else []
        cell = F.lit(0)
        if bounds:
            own = F.col(key)
            reached = F.filter(F.array(*map(F.lit, bounds)), lambda bound: bound <= own)  # noqa: B023
            spread = F.floor(F.size(reached) * F.lit(cells) / F.lit(len(bounds) + 1)).cast("int")
            cell = F.when(own.isNull(), 0).otherwise(spread)
        for bit in range(bits):
            one = F.shiftright(cell, bit).bitwiseAND(1).cast("long")
            place = place.bitwiseOR(F.shiftleft(one, bit * len(keys) + n))
    return place


def curve_starts(rows: DataFrame, files: int) -> list[int]:
    """Where the files after the first start on the curve: within a quarter of a file of equal shares of rows, at
    the roundest number, since the rounder it is, the more keys have a cell that begins there."""
    shares = [(4 * n + side) / (4 * files) for n in range(1, files) for side in (-1, 1)]
    found = rows.agg(F.percentile_approx("_curve", shares, CURVE_SAMPLE)).first()[0] if shares else None
    starts = []
    for low, high in zip(found[::2], found[1::2]) if found else ():
        while high & (high - 1) > low:
            high &= high - 1
        starts.append(high)
    return starts


def write_on_curve(df: DataFrame, path: str, keys: list[str], files: int | None = None) -> None:
    """Parquet files laid out for filters on any one of the keys: each file holds a stretch of the curve.

    A sort by several keys lets readers skip files by the first one only. On the curve every key's
    smallest and largest value of a file are near, so a filter on each alone skips files. A stretch that
    many rows share is split at random, so a hot cell is never one task.
    """
    rows = df.withColumns({"_curve": curve_place(df, keys), "_tie": F.rand(1)})
    if files:
        starts = F.array(*map(F.lit, curve_starts(rows, files))).cast("array<bigint>")
        before = with_range(rows, F.col("_curve") - 1, starts, files).withColumnRenamed("_range", "_before")
        reached = with_range(before, F.col("_curve"), starts, files)
        # A place where several files start is dealt among them.
        same = F.greatest(F.col("_range") - F.col("_before"), F.lit(1))
        file = (F.col("_range") - F.floor(F.col("_tie") * same)).cast("int")
        dealt = reached.withColumn("_range", file).repartitionById(files, "_range").drop("_range", "_before")
    else:
        dealt = rows.repartitionByRange("_curve", "_tie")
    dealt.sortWithinPartitions("_curve", *keys).drop("_curve", "_tie").write.mode("overwrite").parquet(path)


def with_place(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """All rows with their place (from 1) in the given order; rows that compare equal follow in any order.

    Rows are dealt into ranges of the order, numbered inside each range and written once to the shared
    folder. The rows before a range come from one count for each range, so no task sees all rows.
    """
    columns = df.columns
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number is the range's in its upper bits and the row's place in the range in the lower 33.
    numbered = dealt.withColumn("_number", F.monotonically_increasing_id()).withColumn(
        "_range", F.shiftright("_number", 33)
    )
    path = scratch_path(df.sparkSession, "places")
    numbered.write.parquet(path)
    numbered = df.sparkSession.read.schema(numbered.schema).parquet(path)
    sizes = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_number").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.join(starts, "_range").select(*columns, place.alias(name))


def text_list(values: Column) -> Column:
    """A set of texts as `a, b, c`; null when it is empty."""
    return F.nullif(F.array_join(F.sort_array(values), ", "), F.lit(""))


def merged_set(values: str) -> Column:
    """The union of array values over a group."""
    return F.array_distinct(F.flatten(F.collect_set(values)))


def distinct_lists(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The distinct values of each column as sorted text lists per key.

    Sets combine before the shuffle, so a key sends each of its values once from a task, and no row
    is repeated for a column.
    """
    return df.groupBy(*keys).agg(*[
        text_list(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns
    ])


def with_total_and_breakdown(df: DataFrame, key: str, *measures: Column) -> DataFrame:
    """The total (null key) and the rows per key in one pass."""
    return df.groupingSets([[], [key]], key).agg(*measures)
