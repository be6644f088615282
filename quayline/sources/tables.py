"""Table maintenance on parquet: refresh, constraint gate, upsert, incremental load, run log."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from quayline import config
from quayline.operators import relational as R
from quayline.session import scratch_path, shuffles_dropped


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


# --- full refresh ------------------------------------------------------------------------------

def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it; on the driver only."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, place = file_system(spark, path)
    fs.delete(place, True)


def move_folder(fs, source, target) -> None:
    """Rename, or raise: Hadoop's rename says false where it is refused."""
    if not fs.rename(source, target):
        raise OSError(f"could not rename {source} to {target}")


def swap_folder(spark: SparkSession, staged: str, target: str) -> None:
    """Put a finished folder in a target's place by renames, which move no data.

    The old folder is deleted last. Where the new one can't take its place, the old one goes back.
    """
    fs, new = file_system(spark, staged)
    old = file_system(spark, f"{target}__old_{uuid.uuid4().hex}")[1]
    place = file_system(spark, target)[1]
    had = fs.exists(place)
    if had:
        move_folder(fs, place, old)
    try:
        move_folder(fs, new, place)
    except BaseException:
        if had:
            move_folder(fs, old, place)
        raise
    if had:
        fs.delete(old, True)


def table_location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Location'").collect()
    return rows[-1]["data_type"]


def same_columns(spark: SparkSession, table: str, df: DataFrame) -> bool:
    kinds = lambda schema: [(f.name.lower(), f.dataType) for f in schema.fields]
    return kinds(spark.table(table).schema) == kinds(df.schema)


def refresh_table(stamped: DataFrame, table: str, folder: str) -> int:
    """Write a new version of a catalog table below `folder` and point the catalog to it.

    Every version has a folder of its own, and the table's location is the pointer: readers see the old
    version or the new one, whole, and never a gap. A write or a switch that fails leaves the old version.
    Versions stay until `drop_old_versions`, so a query that has planned its files can end. The switch is
    one catalog call; only new columns need two, a rename of the old definition and a new one, and the
    old one is put back if the second fails.
    """
    spark = stamped.sparkSession
    version = f"{folder.rstrip('/')}/v-{time.time_ns()}-{uuid.uuid4().hex}"
    stamped.write.parquet(version)
    rows = spark.read.schema(stamped.schema).parquet(version).count()
    place = version.replace("'", "\\'")
    if not spark.catalog.tableExists(table):
        spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{place}'")
    elif same_columns(spark, table, stamped):
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{place}'")
    else:
        before = f"{table}__before_{uuid.uuid4().hex}"
        spark.sql(f"ALTER TABLE {table} RENAME TO {before}")
        try:
            spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{place}'")
        except BaseException:
            spark.sql(f"ALTER TABLE {before} RENAME TO {table}")
            raise
        spark.sql(f"DROP TABLE {before}")  # the definition only: its files are those of a version
    spark.catalog.refreshTable(table)
    return rows


def table_versions(spark: SparkSession, folder: str) -> list[str]:
    """The version folders of a table, oldest first."""
    fs, place = file_system(spark, folder)
    names = [entry.getPath().getName() for entry in fs.listStatus(place)] if fs.exists(place) else []
    return sorted((n for n in names if n.startswith("v-")), key=lambda n: int(n.split("-")[1]))


def drop_old_versions(spark: SparkSession, table: str, folder: str, keep: int = 1) -> list[str]:
    """Remove a table's versions but the current one and the `keep` - 1 newest others; the names of what went."""
    current = table_location(spark, table).rstrip("/").rsplit("/", 1)[1]
    others = [name for name in table_versions(spark, folder) if name != current]
    gone = others[:max(len(others) - keep + 1, 0)]
    for name in gone:
        drop_folder(spark, f"{folder.rstrip('/')}/{name}")
    return gone


def full_refresh(
    df: DataFrame, target: str, order: list[Column | str] | None = None, versions: str | None = None,
    made_first: bool = False,
) -> int:
    """Replace a table by the DataFrame plus a sync stamp; the row count is read back from it.

    The target is a folder, or, with the folder of its `versions`, a catalog table. The rows are written
    beside the target first, and take its place only when they are complete: a refresh that fails leaves
    the table as it was.

    Each step's shuffle files go when it ends. With `made_first`, for rows that are shuffled to be made, they
    are written as they come before they are laid out: the shuffles of the two steps are then never on disk
    together, and the layout's sample reads their keys from files.
    """
    spark = df.sparkSession
    staged = f"{target}__new_{uuid.uuid4().hex}"
    sample, made = (f"{(versions or target).rstrip('/')}__{part}_{uuid.uuid4().hex}" for part in ("keys", "rows"))
    try:
        with shuffles_dropped(spark):
            if order and made_first:
                df.write.parquet(made)
                df = spark.read.schema(df.schema).parquet(made)
            stamped = df.withColumn("synced_at", F.current_timestamp())
            if order and all(isinstance(key, str) for key in order):
                stamped = R.laid_out(stamped, order, sample)
            elif order:
                stamped = R.clustered_for_write(stamped, *order)
            if versions is not None:
                return refresh_table(stamped, target, versions)
            stamped.write.parquet(staged)
            swap_folder(spark, staged, target)
            return spark.read.parquet(target).count()
    finally:
        drop_folder(spark, sample)
        drop_folder(spark, made)
        if versions is None:
            drop_folder(spark, staged)


@dataclass
class Job:
    """A refresh job: `build` gives its DataFrame, `needs` are the jobs it reads the results of.

    `order` and `made_first` are those of `full_refresh`.
    """

    name: str
    build: Callable[[], DataFrame]
    target: str
    order: list | None = None
    needs: list[str] = field(default_factory=list)
    made_first: bool = False


SUMMARY_SCHEMA = "name string, status string, rows bigint, duration double, error string"


def run_jobs(spark: SparkSession, jobs: list[Job], targets: list[str] | None = None) -> DataFrame:
    """Refresh the jobs in order. A failure does not stop the rest, only the jobs that need it."""
    known = {job.name: job for job in jobs}
    outcome: dict[str, str] = {}
    rows = []
    for name in targets or list(known):
        if name not in known:
            rows.append((name, "error", 0, 0.0, f"unknown job; available: {', '.join(known)}"))
            continue
        job = known[name]
        started = time.monotonic()
        if any(outcome.get(need, "success") != "success" for need in job.needs):
            status, count, error = "skipped", 0, "a job it needs did not succeed"
        else:
            try:
                count = full_refresh(job.build(), job.target, job.order, made_first=job.made_first)
                status, error = "success", None
            except Exception as failure:
                status, count, error = "error", 0, str(failure).splitlines()[0]
        outcome[name] = status
        rows.append((name, status, count, round(time.monotonic() - started, 2), error))
    return spark.createDataFrame(rows, SUMMARY_SCHEMA)


def refresh_totals(summary: DataFrame) -> DataFrame:
    return summary.groupBy("status").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("rows").alias("total_rows"),
        F.sum("duration").alias("total_duration"),
    )


# --- constraints -------------------------------------------------------------------------------

def not_null(*columns: str) -> dict[str, Column]:
    return {f"{c}_not_null": F.col(c).isNotNull() for c in columns}


def one_of(column: str, values: list[str]) -> dict[str, Column]:
    """CHECK semantics: a null value passes."""
    return {f"{column}_check": F.col(column).isNull() | F.col(column).isin(values)}


def constraint_gate(
    df: DataFrame,
    rules: dict[str, Column],
    unique: tuple[list[str], str] | None = None,
    foreign: tuple[str, DataFrame, str] | None = None,
) -> DataFrame:
    """Add `violations`, the names of the rules each row breaks.

    `unique` is (key columns, order column): only the first row of a key passes, and, as in SQL, a
    key with a null never collides. `foreign` is (column, parent table, parent column).
    """
    checks = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    out = df
    if unique:
        keys, order = unique
        complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        first = out.filter(complete).groupBy(*keys).agg(F.min(order).alias("_first"))
        out = out.join(first, keys, "left")
        checks.append(F.when(F.col(order) != F.col("_first"), F.lit("unique")))
    if foreign:
        column, parent, parent_column = foreign
        known = parent.select(F.col(parent_column).alias("_parent")).distinct()
        out = out.join(known, out[column] == F.col("_parent"), "left")
        checks.append(
            F.when(F.col(column).isNotNull() & F.col("_parent").isNull(), F.lit("foreign_key"))
        )
    violations = F.array_compact(F.array(*checks))
    return out.withColumn("violations", violations).drop("_first", "_parent")


def accepted(gated: DataFrame) -> DataFrame:
    return gated.filter(F.size("violations") == 0).drop("violations")


def quarantined(gated: DataFrame) -> DataFrame:
    return gated.filter(F.size("violations") > 0)


def receipt_gate(batch: DataFrame) -> DataFrame:
    """The receipt rules; the date must be a date, since the table is partitioned by it."""
    rules = not_null("adjustment_date", "facility_id", "item_code")
    if "bad_number" in batch.columns:
        rules["numbers"] = F.size("bad_number") == 0
    rules["adjustment_date_check"] = F.col("adjustment_date").cast("string").try_cast("date").isNotNull()
    return constraint_gate(batch, rules)


# --- upsert ------------------------------------------------------------------------------------

@dataclass
class UpsertResult:
    inserted: int
    updated: int
    unchanged: int
    rejected: int = 0
    fetched: int = 0


def merged_rows(existing: DataFrame, batch: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Existing and batch rows by key; the last batch row wins, and nulls in keys are equal.

    Adds `_change`: inserted, updated, unchanged (same values came again) or kept.
    """
    values = [c for c in existing.columns if c not in keys and c != "fetched_at"]
    typed = [F.col(v).cast(existing.schema[v].dataType).alias(v) for v in values]
    last = R.newest_per_key(batch, keys, [F.desc(sequence)])
    old = existing.select(*keys, *values, "fetched_at", F.lit(0).alias("_side"))
    new = last.select(*keys, *typed, "fetched_at", F.lit(1).alias("_side"))
    # At most two rows share a key here: the batch row comes first, the row it replaces second.
    window = Window.partitionBy(*keys).orderBy(F.desc("_side"))
    change = (
        F.when(F.col("_side") == 0, "kept")
        .when(F.col("_before").isNull(), "inserted")
        .when(F.col("_before").eqNullSafe(F.struct(*values)), "unchanged")
        .otherwise("updated")
    )
    return (
        old.unionByName(new)
        .withColumn("_rank", F.row_number().over(window))
        .withColumn("_before", F.lead(F.struct(*values)).over(window))
        .filter("_rank = 1")
        .withColumn("_change", change)
        .select(*keys, *values, "fetched_at", "_change")
    )


def upsert(
    spark: SparkSession, target: str, batch: DataFrame, keys: list[str], partition: str,
    sequence: str = "sequence",
) -> UpsertResult:
    """Insert or overwrite rows of a parquet table partitioned by `partition`, a key column.

    Only the touched partitions are read and rewritten; a very large one is split over several
    tasks and files. Rows that are merged with a table's go to the shared folder first, so a lost
    executor or a failed merge leaves the table as it was.
    """
    existing = read_if_exists(spark, target)
    fresh = batch.drop(sequence).limit(0)
    base = fresh if existing is None else existing.select(*fresh.columns)
    # The touched partitions go to every task; the table's rows stay where they are read.
    touched = F.broadcast(batch.select(partition).distinct())
    merged = merged_rows(base.join(touched, partition, "left_semi"), batch, keys, sequence)
    staging = scratch_path(spark, "upsert")
    changes = ("inserted", "updated", "unchanged")
    counted = Observation()
    counts = [F.count_if(F.col("_change") == change).alias(change) for change in changes]
    staged = merged.observe(counted, *counts)
    if existing is not None:
        staged.write.parquet(staging)
        staged = spark.read.schema(merged.schema).parquet(staging)
    (
        staged.drop("_change")
        .hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(target)
    )
    drop_folder(spark, staging)
    return UpsertResult(*[counted.get[change] for change in changes])


def load_receipts(
    spark: SparkSession, target: str, batch: DataFrame, fetched_at: Column, partition: str = "adjustment_date"
) -> UpsertResult:
    """Gate a receipt file's rows and upsert the good ones; bad rows go beside the table.

    The gate runs once: its rows go to the shared folder, good and bad apart, and are counted in that same
    pass. The bad rows of a load have a folder named by their content, so the same load replaces its own.
    `partition` is the date or another column of the batch that follows from the key.
    """
    gated = receipt_gate(batch)
    content = [c for c in gated.columns if c != "sequence"]
    is_bad = F.size("violations") > 0
    counted = Observation()
    gated = gated.observe(
        counted, F.count(F.lit(1)).alias("fetched"), F.count_if(is_bad).alias("rejected"),
        F.sum(F.when(is_bad, F.xxhash64(*content).cast("decimal(20,0)"))).alias("digest"),
    )
    staging = scratch_path(spark, "gated")
    gated.withColumn("accepted", ~is_bad).write.partitionBy("accepted").parquet(staging)
    told = counted.get
    staged = spark.read.schema(gated.schema.add("accepted", "boolean")).parquet(staging)
    if told["rejected"]:
        bad = staged.filter(~F.col("accepted")).drop("accepted")
        bad.write.mode("overwrite").parquet(f"{target}_quarantine/load={told['rejected']}-{abs(int(told['digest']))}")
    good = (
        staged.filter("accepted").drop("accepted", "violations", "bad_number")
        .withColumn("adjustment_date", F.col("adjustment_date").cast("date"))
        .withColumn("fetched_at", fetched_at)
    )
    keys = config.RECEIPT_KEY if partition in config.RECEIPT_KEY else [partition, *config.RECEIPT_KEY]
    result = upsert(spark, target, good, keys, partition)
    drop_folder(spark, staging)
    result.rejected, result.fetched = told["rejected"], told["fetched"]
    return result


# --- incremental load --------------------------------------------------------------------------

def new_rows(source: DataFrame, cursor: str, high_water_mark, upto=None) -> DataFrame:
    """Rows past the mark and up to `upto`; all rows when there is no mark. The filter reaches the scan."""
    if upto is not None:
        source = source.filter(F.col(cursor) <= F.lit(upto))
    if high_water_mark is None:
        return source
    return source.filter(F.col(cursor) > F.lit(high_water_mark))


def newest_state(states: DataFrame) -> DataFrame:
    return R.newest_per_key(states, ["connection"], [F.desc("updated_at")])


#: Rows for which a synced table gets a bucket.
BUCKET_ROWS = 1_000_000
LAYOUT = "step long, buckets int, rows long, split_from int"


def key_bucket(keys: list[str], buckets: int) -> Column:
    """The bucket of a key by linear hashing, whatever else of its row changes.

    Going from n to n + 1 buckets moves keys of one bucket only, that of `split_source(n)`, and those
    that move go to bucket n.
    """
    half = 1 << (buckets.bit_length() - 1)
    hashed = F.xxhash64(*keys)
    wide = hashed.bitwiseAND(F.lit(2 * half - 1))
    return F.when(wide < buckets, wide).otherwise(hashed.bitwiseAND(F.lit(half - 1))).cast("int")


def split_source(bucket: int, below: int) -> int:
    """The one of the first `below` buckets that held a later bucket's keys."""
    while bucket >= below:
        bucket -= 1 << (bucket.bit_length() - 1)
    return bucket


def layout_path(target: str) -> str:
    return f"{target.rstrip('/')}__layout"


def newest_layout(spark: SparkSession, target: str) -> dict | None:
    """The last step of a synced table's layout: its buckets, its rows, and, during a split, the buckets before."""
    steps = read_if_exists(spark, layout_path(target))
    row = None if steps is None else steps.orderBy(F.desc("step")).first()
    return None if row is None else row.asDict()


def note_layout(spark: SparkSession, target: str, step: int, buckets: int, rows: int, split_from: int | None) -> None:
    spark.createDataFrame([(step, buckets, rows, split_from)], LAYOUT).coalesce(1).write.mode("append").parquet(layout_path(target))


def split_buckets(spark: SparkSession, target: str, keys: list[str], before: int, after: int) -> None:
    """Go from `before` to `after` buckets: only the buckets that give keys away are read and rewritten.

    It can run again after a failure half way: rows that have moved and are still in their old bucket too
    then count once. Readers of the files may see such rows twice while it runs.
    """
    sources = sorted({split_source(b, before) for b in range(before, after)})
    own = F.col("key_bucket")
    rows = spark.read.parquet(target).filter((own >= before) | own.isin(sources)).dropDuplicates(keys)
    staging = scratch_path(spark, "split")
    rows.withColumn("key_bucket", key_bucket(keys, after)).write.parquet(staging)
    staged = spark.read.parquet(staging)
    (
        staged.hint("rebalance", "key_bucket")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key_bucket").parquet(target)
    )
    filled = {r[0] for r in staged.select("key_bucket").distinct().collect()}
    for bucket in set(sources) - filled:  # an overwrite leaves partitions alone that it has no rows for
        drop_folder(spark, f"{target}/key_bucket={bucket}")
    drop_folder(spark, staging)


def grown(spark: SparkSession, target: str, keys: list[str], layout: dict, bucket_rows: int) -> None:
    """Add buckets until no bucket has more than `bucket_rows` rows on average; noted before and after."""
    before, rows = layout["buckets"], layout["rows"]
    after = max(before, -(-rows // bucket_rows))
    if after > before:
        note_layout(spark, target, layout["step"] + 1, after, rows, before)
        split_buckets(spark, target, keys, before, after)
        note_layout(spark, target, layout["step"] + 2, after, rows, None)


def sync_incremental(
    spark: SparkSession, connection: str, source: DataFrame, target: str, state_path: str,
    cursor: str, keys: list[str] | None = None, bucket_rows: int = BUCKET_ROWS, buckets: int | None = None,
) -> UpsertResult:
    """Merge the rows past the stored mark into the target by key and store the new mark.

    The target is partitioned by key bucket, and its buckets grow one at a time with its rows: a batch
    rewrites at most as many buckets as it has keys, each of about `bucket_rows` rows, and a split one
    bucket more. A new table starts with `buckets`, by default as many as its first rows ask for. The
    mark is saved last; a repeated run merges the same rows to the same result.
    """
    keys = keys or ["id"]
    states = read_if_exists(spark, state_path)
    mark = None
    if states is not None:
        row = newest_state(states.filter(F.col("connection") == connection)).first()
        mark = None if row is None else row["high_water_mark"]
    # The new mark first: rows that arrive during the load are past it, and the next load takes them.
    upto = source.agg(F.max(cursor)).first()[0]
    if upto is None or mark is not None and upto <= mark:
        return UpsertResult(0, 0, 0)
    rows = new_rows(source, cursor, mark, upto)
    layout = newest_layout(spark, target)
    if layout is None:
        first = buckets or max(1, -(-rows.count() // bucket_rows))
        layout = {"step": 0, "buckets": first, "rows": 0, "split_from": None}
        note_layout(spark, target, **layout)
    if layout["split_from"] is not None:  # a split that didn't end
        split_buckets(spark, target, keys, layout["split_from"], layout["buckets"])
    batch = (
        rows.withColumn("key_bucket", key_bucket(keys, layout["buckets"]))
        .withColumn("sequence", F.col(cursor))
        .withColumn("fetched_at", F.current_timestamp())
    )
    result = upsert(spark, target, batch, ["key_bucket", *keys], "key_bucket")
    layout |= {"step": layout["step"] + 1, "rows": layout["rows"] + result.inserted, "split_from": None}
    note_layout(spark, target, **layout)
    grown(spark, target, keys, layout, bucket_rows)
    (
        source.select(cursor).limit(0).agg(F.max(cursor).alias("high_water_mark"))
        .select(F.lit(connection).alias("connection"),
                F.lit(upto).cast(source.schema[cursor].dataType).alias("high_water_mark"),
                F.current_timestamp().alias("updated_at"))
        .write.mode("append").parquet(state_path)
    )
    return result


# --- run log and registry ----------------------------------------------------------------------

def finished_runs(runs: DataFrame) -> DataFrame:
    """Add the duration in seconds, rounded to two digits."""
    micros = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(
        F.col("started_at").cast("timestamp")
    )
    seconds = F.round(micros.cast("decimal(20,0)") / F.lit(1000000), 2).cast("double")
    return runs.withColumn("duration_secs", seconds)


def append_runs(spark: SparkSession, path: str, runs: DataFrame) -> None:
    finished_runs(runs).write.mode("append").partitionBy("source_id").parquet(path)


def run_history(runs: DataFrame, limit: int = config.HISTORY_ROWS) -> DataFrame:
    """The last runs of each source, oldest first."""
    newest = [F.desc("started_at"), F.desc("run_id")]
    return R.last_n(runs, ["source_id"], newest, limit).orderBy("source_id", "started_at", "run_id")


def connection_status(connections: DataFrame, runs: DataFrame) -> DataFrame:
    """Last sync and status of every connection; `never_run` without a run."""
    latest = runs.groupBy("source_id").agg(
        F.max("finished_at").alias("last_sync"),
        F.max_by("status", F.struct("started_at", "run_id")).alias("last_status"),
    )
    return (
        connections.join(latest, connections.name == latest.source_id, "left")
        .select("name", "last_sync",
                F.coalesce("last_status", F.lit("never_run")).alias("last_status"))
    )


def register_sources(registry: DataFrame, declared: DataFrame) -> DataFrame:
    """The registry with the declared sources it does not hold yet."""
    return registry.unionByName(declared.join(registry, "source_id", "left_anti"))


def registry_after_runs(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """The registry after runs: a success sets last run, row count and active status."""
    wins = (
        runs.filter(F.col("status") == "success")
        .groupBy("source_id")
        .agg(
            F.max("finished_at").alias("_run"),
            F.max_by("rows_fetched", F.struct("finished_at", "run_id")).alias("_rows"),
        )
    )
    ran = F.col("_run").isNotNull()
    return (
        registry.join(wins, "source_id", "left")
        .withColumn("last_run_at", F.when(ran, F.col("_run")).otherwise(F.col("last_run_at")))
        .withColumn("last_row_count", F.when(ran, F.col("_rows")).otherwise(F.col("last_row_count")))
        .withColumn("status", F.when(ran, F.lit("active")).otherwise(F.col("status")))
        .drop("_run", "_rows")
    )
