"""Exact distinct counts at several levels of grouping, by bitmaps over dictionary codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quayline.operators.relational import with_place
from quayline.session import scratch_path


def written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bitmaps(df: DataFrame, groups: list[str], column: str) -> DataFrame:
    """(groups, _bucket, _bits): which values of a column each group has, one bit for each value.

    Values are numbered densely in a dictionary of their own. Only distinct pairs of group and value meet
    it, never the rows; a bucket holds 32,768 values. Groups of a null are groups, null values none.
    """
    pairs = df.select(*groups, F.col(column).alias("_value")).filter("_value IS NOT NULL").distinct()
    pairs = written(pairs, "pairs")
    codes = with_place(pairs.select("_value").distinct(), "_code", F.col("_value"))
    coded = pairs.join(codes, "_value")
    return coded.groupBy(*groups, F.bitmap_bucket_number("_code").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_code")).alias("_bits")
    )


def distinct_levels(df: DataFrame, levels: dict[str, list[str]], columns: dict[str, str]) -> DataFrame:
    """(level, groups, counts): for each named level, `columns` gives the distinct non-null values of its groups.

    Distinct counts of a finer level don't add up to those of a coarser one, but bitmaps do: the
    finest level is built once and written, the others are unions of its bitmaps. Every group of a level
    has a row, with zero where it has no value; the empty level has one row even for no input.
    """
    groups = sorted({g for names in levels.values() for g in names})
    spark = df.sparkSession
    present = written(df.select(*groups).distinct(), "groups")
    finest = {name: written(bitmaps(df, groups, column), "bitmaps") for name, column in columns.items()}

    def level(label: str, own: list[str]) -> DataFrame:
        found = present.select(*own).distinct() if own else spark.range(1).select()
        for name, bits in finest.items():
            union = bits.groupBy(*own, "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))
            counts = union.groupBy(*own).agg(F.sum(F.bitmap_count("_bits")).alias(name))
            if own:
                keys = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in own]
                counts = counts.select(*[F.col(g).alias(f"_of_{g}") for g in own], name)
                found = found.join(counts, reduce(lambda a, b: a & b, keys), "left").drop(*[f"_of_{g}" for g in own])
            else:
                found = found.withColumn(name, counts.select(name).scalar())
        empty = [F.col(g) if g in own else F.lit(None).cast(df.schema[g].dataType).alias(g) for g in groups]
        return found.select(F.lit(label).alias("level"), *empty, *[F.coalesce(n, F.lit(0)).alias(n) for n in columns])

    return reduce(DataFrame.unionByName, [level(label, own) for label, own in levels.items()])
