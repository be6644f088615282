"""Message streams: intake, answer selection and triage as Structured Streaming queries.

Intake steps are plain DataFrame transformations that run on batches and on streams alike. Steps
that look at earlier answers run once per micro-batch; each writes a folder named by its batch, so
a batch that runs again replaces its own rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from quayline import config
from quayline.functions import messages as M
from quayline.operators import relational as R
from quayline.plans.lookup import order_card, order_lookup
from quayline.session import scratch_path
from quayline.sources.tables import drop_folder
from quayline.streaming.state import batch_folder, newest_before


def message_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Messages arriving as files; other sources (such as Kafka) give the same columns."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_event_time(messages: DataFrame, ts: str = "message_ts") -> DataFrame:
    """Event time from epoch seconds in text; the text stays the key."""
    return messages.withColumn("event_time", F.timestamp_seconds(F.col(ts).cast("double")))


def within_age(messages: DataFrame, now: Column | None = None) -> DataFrame:
    """Messages younger than two hours at `now`, by default the time of the micro-batch."""
    now = F.current_timestamp() if now is None else now
    limit = F.expr(f"INTERVAL {config.MESSAGE_MAX_AGE}")
    return messages.filter(F.col("event_time") >= now - limit)


MESSAGE_KEY = ["channel", "message_ts"]


def once(messages: DataFrame, keep: str = config.MESSAGE_MAX_AGE, arrived: Column | None = None) -> DataFrame:
    """The messages of a stream, each once, whatever their order in time.

    Keys are kept in the state store from their arrival on, by default the time of the micro-batch, so
    that no message is late, and expire after `keep`. Messages are asked for their age first, which is
    why a key that has expired can't come again.
    """
    arrived = F.current_timestamp() if arrived is None else arrived
    return (
        messages.withColumn("arrived_at", arrived)
        .withWatermark("arrived_at", keep)
        .dropDuplicatesWithinWatermark(MESSAGE_KEY)
        .drop("arrived_at")
    )


def without_types(
    messages: DataFrame, skipped: list[str] = config.SKIPPED_SUBTYPES, bot: str | None = None
) -> DataFrame:
    kept = messages.filter(F.col("subtype").isNull() | ~F.col("subtype").isin(skipped))
    return kept if bot is None else kept.filter(~F.col("author").eqNullSafe(bot))


def with_channel_config(messages: DataFrame, overrides: DataFrame) -> DataFrame:
    """Channel settings: the default unless the channel's row sets another value."""
    joined = messages.join(overrides, "channel", "left")
    for name, default in config.CHANNEL_DEFAULTS.items():
        joined = joined.withColumn(name, F.coalesce(name, F.lit(default)))
    return joined


def questions_only(messages: DataFrame) -> DataFrame:
    return messages.filter(M.is_question(F.col("body")))


def split_by_quota(messages: DataFrame, quota: int = config.CHANNEL_QUOTA) -> DataFrame:
    """Mark the oldest messages of each channel `answered`, the rest `pending`.

    Only the few oldest per channel are ranked: Spark keeps `quota` rows per channel before the
    shuffle, so a channel with very many messages is never gathered in one task. Messages of one
    channel and time are told apart by their content; equal ones are as many as they are.
    """
    content = F.xxhash64(*messages.columns)
    nth = F.row_number().over(Window.partitionBy("channel", "message_ts", "_content").orderBy("channel"))
    numbered = messages.withColumn("_content", content).withColumn("_nth", nth)
    key = ["channel", "message_ts", "_content", "_nth"]
    oldest = R.last_n(
        numbered.select(*key), ["channel"],
        [F.col("message_ts").cast("double"), F.col("message_ts"), F.col("_content"), F.col("_nth")], quota,
    ).select(*[F.col(k).alias(f"_due{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"_due{k}")) for k in key]
    due = F.col("_due_nth").isNotNull()
    return (
        numbered.join(oldest, same, "left")
        .withColumn("state", F.when(due, "answered").otherwise("pending"))
        .select(*messages.columns, "state")
    )


def quota_writer(
    base: str, quota: int = config.CHANNEL_QUOTA, still_open: Callable[[DataFrame], DataFrame] | None = None
) -> Callable[[DataFrame, int], None]:
    """Per micro-batch: join the messages left over, answer up to the quota, keep the rest.

    A folder for each batch holds what it answered and what then waits. Only the newest batch before is
    read; of its waiting messages `still_open` keeps those that may still be answered.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        waiting = batch
        left = newest_before(spark, f"{base}/state", batch_id)
        if left is not None:
            left = left.filter("state = 'pending'").drop("state")
            waiting = batch.unionByName(still_open(left) if still_open else left)
        split_by_quota(waiting, quota).write.mode("overwrite").parquet(
            batch_folder(f"{base}/state", batch_id)
        )

    return write


def quota_state(spark: SparkSession, base: str) -> DataFrame:
    """Each message once: answered by any batch, or still waiting after the last one."""
    state = spark.read.parquet(f"{base}/state")
    last = state.select(F.max("batch_id")).scalar()
    return state.filter((F.col("state") == "answered") | (F.col("batch_id") == last)).drop("batch_id")


def answered_threads(replies: DataFrame, bot: str) -> DataFrame:
    return replies.filter(F.col("author") == bot).select("thread_id").distinct()


def without_answer(messages: DataFrame, replies: DataFrame, bot: str) -> DataFrame:
    """Messages whose thread holds no reply of the bot."""
    return messages.join(answered_threads(replies, bot), "thread_id", "left_anti")


def unanswered_mentions(thread: DataFrame, bot: str) -> DataFrame:
    """Replies that mention the bot and have no later reply of the bot.

    The bot's newest reply per thread decides, which is linear in the thread's length.
    """
    newest = (
        thread.filter(F.col("author") == bot).groupBy("thread_id").agg(F.max("turn").alias("_bot"))
    )
    mentions = thread.filter(
        (F.col("turn") > 0) & (F.col("author") != bot) & F.contains("body", F.lit(f"<@{bot}>"))
    )
    return (
        mentions.join(newest, "thread_id", "left")
        .filter(F.col("_bot").isNull() | (F.col("_bot") <= F.col("turn")))
        .drop("_bot")
    )


def unanswered_mentions_by_anti_join(thread: DataFrame, bot: str) -> DataFrame:
    """The same rows by an inequality anti join; the form that the tests compare with."""
    replies = thread.filter(F.col("author") == bot).select("thread_id", F.col("turn").alias("_later"))
    mentions = thread.filter(
        (F.col("turn") > 0) & (F.col("author") != bot) & F.contains("body", F.lit(f"<@{bot}>"))
    )
    later = (mentions.thread_id == replies.thread_id) & (F.col("_later") > F.col("turn"))
    return mentions.join(replies, later, "left_anti")


def unanswered_within(
    messages: DataFrame, replies: DataFrame, bot: str, wait: str, lateness: str = config.MESSAGE_MAX_AGE
) -> DataFrame:
    """Messages of a stream that no reply of the bot follows in their thread within `wait`.

    Both sides are streams. A message comes out once the watermark of both has passed its bound, and is
    then dropped from the state, as replies are that no later message can match. Turns that are more
    than `lateness` behind the newest ones don't take part.
    """
    own = messages.withWatermark("event_time", lateness)
    answers = (
        replies.filter(F.col("author") == bot)
        .select(F.col("thread_id").alias("_thread"), F.col("event_time").alias("_replied_at"))
        .withWatermark("_replied_at", lateness)
    )
    in_time = (
        (F.col("thread_id") == F.col("_thread"))
        & (F.col("_replied_at") >= F.col("event_time"))
        & (F.col("_replied_at") <= F.col("event_time") + F.expr(f"INTERVAL {wait}"))
    )
    return own.join(answers, in_time, "left").filter(F.col("_replied_at").isNull()).drop("_thread", "_replied_at")


def unanswered_writer(
    base: str, replies: Callable[[SparkSession], DataFrame], bot: str
) -> Callable[[DataFrame, int], None]:
    """Per micro-batch: the messages whose thread holds no reply of the bot at that moment."""

    def write(batch: DataFrame, batch_id: int) -> None:
        without_answer(batch, replies(batch.sparkSession), bot).write.mode("overwrite").parquet(
            batch_folder(base, batch_id)
        )

    return write


def answers(
    messages: DataFrame, orders: DataFrame, shipments: DataFrame, lines: DataFrame
) -> DataFrame:
    """One answer row per message: the intent, and for orders the card or that none is known."""
    clean, asked = F.col("clean_body"), M.is_question(F.col("body"))
    read = (
        messages.withColumn("clean_body", M.clean_markup(F.col("body")))
        .withColumn("intent", M.message_intent(clean, asked))
        .withColumn("requested", M.order_number(clean))
    )
    return with_cards(read, orders, shipments, lines)


def with_cards(read: DataFrame, orders: DataFrame, shipments: DataFrame, lines: DataFrame) -> DataFrame:
    """Add the answer to messages that name an order in `requested`: its card, or that none is known."""
    requests = read.filter(F.col("requested").isNotNull()).select(
        F.col("requested").alias("order_number")
    )
    cards = order_card(order_lookup(requests, orders, shipments, lines)).select("requested", "card", "order_status")
    # Messages that name no order skip the join: their null keys would all meet in one task.
    answer = F.coalesce("card", F.lit("not found"))
    named = (
        read.filter(F.col("requested").isNotNull())
        .join(cards, "requested", "left")
        .withColumn("answer", answer)
        .drop("card")
    )
    return named.unionByName(read.filter(F.col("requested").isNull()), allowMissingColumns=True)


def triage_writer(
    base: str, sources: Callable[[SparkSession], tuple[DataFrame, DataFrame, DataFrame]]
) -> Callable[[DataFrame, int], None]:
    """Per micro-batch: answer the messages from the tables as they are at that moment."""

    def write(batch: DataFrame, batch_id: int) -> None:
        answers(batch, *sources(batch.sparkSession)).write.mode("overwrite").parquet(
            batch_folder(base, batch_id)
        )

    return write


def to_answer(messages: DataFrame, bot: str, now: Column | None = None) -> DataFrame:
    """The messages of a stream that may be answered, each once. They need a `thread_id`."""
    return once(questions_only(without_types(within_age(messages, now), bot=bot)))


def listener_writer(
    base: str, tables: Callable[[SparkSession], tuple[DataFrame, DataFrame, DataFrame]],
    replies: Callable[[SparkSession], DataFrame], bot: str, now: Column | None = None,
    quota: int = config.CHANNEL_QUOTA,
) -> Callable[[DataFrame, int], None]:
    """Per micro-batch, the whole way of a message from its arrival to its answer.

    Young enough, of a kind that is answered, not seen before, a question, in a thread without an
    answer, within the channel's quota: such messages get an answer from the tables as they are at
    that moment. What the quota leaves over waits for the next batch and is then looked at again.
    The stream is that of `to_answer`. Answers are in `base`/answers, a folder for each batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        unanswered = lambda messages: without_answer(messages, replies(spark), bot)
        limited = quota_writer(f"{base}/quota", quota, lambda left: unanswered(within_age(left, now)))
        limited(unanswered(batch), batch_id)
        state = spark.read.parquet(batch_folder(f"{base}/quota/state", batch_id))
        due = state.filter("state = 'answered'").drop("state")
        answers(due, *tables(spark)).write.mode("overwrite").parquet(batch_folder(f"{base}/answers", batch_id))

    return write


class Settings:
    """Channel settings that a stream reads anew once `seconds` have passed; in between, its batches share them.

    What is read is kept as a table in the shared folder, so every batch of the interval sees the same rows
    whatever happens to their source. A read that fails or gives no rows changes nothing: the settings
    before stay, and the next batch tries again. Only the first read passes its failure on.
    """

    def __init__(self, read: Callable[[SparkSession], DataFrame], seconds: float = config.SETTINGS_SECONDS,
                 clock: Callable[[], float] = time.monotonic):
        self.read, self.seconds, self.clock = read, seconds, clock
        self.kept: str | None = None
        self.schema: StructType | None = None
        self.since = 0.0

    def current(self, spark: SparkSession) -> DataFrame:
        if self.kept is None or self.clock() - self.since >= self.seconds:
            try:
                self.renew(spark)
            except PySparkException:
                if self.kept is None:
                    raise
        return spark.read.schema(self.schema).parquet(self.kept)

    def renew(self, spark: SparkSession) -> None:
        path, now, gone = scratch_path(spark, "settings"), self.clock(), None
        try:
            found, gone = self.read(spark), path
            found.write.parquet(path)
            if self.kept is None or not spark.read.schema(found.schema).parquet(path).isEmpty():
                gone, self.kept, self.schema, self.since = self.kept, path, found.schema, now
        finally:
            if gone:
                drop_folder(spark, gone)


def config_writer(
    base: str, overrides: Callable[[SparkSession], DataFrame], seconds: float = config.SETTINGS_SECONDS,
    clock: Callable[[], float] = time.monotonic,
) -> Callable[[DataFrame, int], None]:
    """Per micro-batch: join channel settings that are read anew once `seconds` have passed."""
    settings = Settings(overrides, seconds, clock)

    def write(batch: DataFrame, batch_id: int) -> None:
        with_channel_config(batch, settings.current(batch.sparkSession)).write.mode("overwrite").parquet(
            batch_folder(base, batch_id)
        )

    return write


IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_to_end(
    stream: DataFrame, checkpoint: str, sink: str | Callable[[DataFrame, int], None],
    seconds: int = 3600, idle: bool = True,
) -> list[dict]:
    """Process everything that has arrived, into a parquet folder or a batch function; each batch's progress.

    Without `idle`, no batch runs for a watermark alone: to a batch function that has a quota for each
    batch, such batches would be polls of their own.
    """
    conf = stream.sparkSession.conf
    before = conf.get(IDLE)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    try:
        conf.set(IDLE, str(idle).lower())
        if callable(sink):
            query = writer.foreachBatch(sink).start()
        else:
            query = writer.format("parquet").outputMode("append").start(sink)
    finally:
        conf.set(IDLE, before)
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"stream did not finish in {seconds} s")
    return query.recentProgress
