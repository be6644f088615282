"""State that micro-batches carry on, kept in buckets: a batch reads and writes those its rows fall into."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quayline.sources.tables import file_system


def batch_folder(base: str, batch_id: int) -> str:
    return f"{base}/batch_id={batch_id}"


def batches(spark: SparkSession, base: str) -> list[int]:
    """The finished batches below a folder, in order; unfinished ones have no `_SUCCESS`."""
    fs, place = file_system(spark, base)
    if not fs.exists(place):
        return []
    found = [entry.getPath().getName() for entry in fs.listStatus(place)]
    numbers = [int(name.removeprefix("batch_id=")) for name in found if name.startswith("batch_id=")]
    return sorted(n for n in numbers if fs.exists(file_system(spark, f"{batch_folder(base, n)}/_SUCCESS")[1]))


def newest_before(spark: SparkSession, base: str, batch_id: int) -> DataFrame | None:
    """What the last finished batch below `batch_id` wrote, whatever numbers are missing between."""
    earlier = [n for n in batches(spark, base) if n < batch_id]
    try:
        return spark.read.parquet(batch_folder(base, earlier[-1])) if earlier else None
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # an empty table without a file
            return None
        raise


def drop_before(spark: SparkSession, base: str, kept: Iterable[int], batch_id: int) -> None:
    """Remove the folders of batches below `batch_id` that are not in `kept`."""
    for number in set(batches(spark, base)) - set(kept):
        if number < batch_id:
            fs, place = file_system(spark, batch_folder(base, number))
            fs.delete(place, True)


@dataclass
class BucketedState:
    """Rows by a hash of their key, as the last batch that touched their bucket left them.

    `base`/rows/batch_id=N/bucket=B holds a bucket after batch N; `base`/current/batch_id=N says which batch
    holds each bucket's newest rows, and is written last. A batch starts from the newest list below its own
    number, so one that runs again replaces its own rows and nothing else.
    """

    base: str
    key: list[str]
    schema: str
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows fall into; at most `buckets` of them."""
        return [r[0] for r in rows.select(self.bucket().alias("bucket")).distinct().collect()]

    def current(self, spark: SparkSession, batch_id: int) -> dict[int, int]:
        """The batch that holds each bucket's rows as `batch_id` finds them."""
        known = newest_before(spark, f"{self.base}/current", batch_id)
        return {} if known is None else {r["bucket"]: r["version"] for r in known.collect()}

    def load(self, spark: SparkSession, batch_id: int, touched: list[int]) -> DataFrame:
        """The rows of some buckets before `batch_id`."""
        known = self.current(spark, batch_id)
        return self.read(spark, {b: known[b] for b in touched if b in known})

    def read(self, spark: SparkSession, versions: dict[int, int]) -> DataFrame:
        paths = [f"{batch_folder(f'{self.base}/rows', v)}/bucket={b}" for b, v in sorted(versions.items())]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)

    def save(self, rows: DataFrame, batch_id: int, touched: list[int]) -> DataFrame:
        """Replace the touched buckets by `rows`, all of which fall into them; the rows as they are stored."""
        spark = rows.sparkSession
        target = batch_folder(f"{self.base}/rows", batch_id)
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        fs, place = file_system(spark, target)
        names = [entry.getPath().getName() for entry in fs.listStatus(place)]
        filled = {int(name.removeprefix("bucket=")) for name in names if name.startswith("bucket=")}
        versions = {b: v for b, v in self.current(spark, batch_id).items() if b not in touched}
        versions |= dict.fromkeys(filled, batch_id)
        lists = spark.createDataFrame(sorted(versions.items()), "bucket int, version long").coalesce(1)
        lists.write.mode("overwrite").parquet(batch_folder(f"{self.base}/current", batch_id))
        return self.read(spark, dict.fromkeys(filled, batch_id))

    def tidy(self, spark: SparkSession, batch_id: int) -> None:
        """Remove what neither `batch_id` nor a repetition of it reads any more."""
        before, after = self.current(spark, batch_id), self.current(spark, batch_id + 1)
        drop_before(spark, f"{self.base}/rows", {*before.values(), *after.values()}, batch_id)
        earlier = [n for n in batches(spark, f"{self.base}/current") if n < batch_id]
        drop_before(spark, f"{self.base}/current", earlier[-1:], batch_id)
