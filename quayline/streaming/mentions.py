"""Mentions of the bot in threads: found, and answered under a quota, batch by batch.

What a thread has come to is kept by thread bucket: its parent, the bot's newest turn, and the mentions after
it. A batch reads the buckets of its own threads and never the log. All of it expires with the age limit, since
a thread whose parent is older is answered no more. Beside it, one folder a batch lists the mentions that wait
and those that were answered within the limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quayline import config
from quayline.functions import messages as M
from quayline.streaming import messages as B
from quayline.streaming.state import BucketedState, batch_folder, batches, drop_before, newest_before

THREAD_KEY = ["channel", "thread_id"]
MENTION_KEY = [*THREAD_KEY, "turn"]
SAID = ["author", "body", "event_time"]


def thread_state(base: str, thread_type: str, buckets: int) -> BucketedState:
    schema = f"channel string, thread_id {thread_type}, turn long, author string, body string, event_time timestamp"
    return BucketedState(f"{base}/threads", THREAD_KEY, schema, buckets)


def relevant(messages: DataFrame, bot: str) -> DataFrame:
    """The turns that decide what is open: parents, the bot's turns, and mentions of the bot."""
    mention = F.contains("body", F.lit(f"<@{bot}>"))
    wanted = (F.col("turn") == 0) | (F.col("author") == bot) | mention
    return messages.filter(wanted).select(*THREAD_KEY, F.col("turn").cast("long").alias("turn"), *SAID)


def same(left: DataFrame, right: DataFrame, key: list[str]) -> list[Column]:
    return [left[k].eqNullSafe(right[f"_{k}"]) for k in key]


def keyed(df: DataFrame, key: list[str]) -> DataFrame:
    """The key columns under names of their own, to join by."""
    return df.select(*[F.col(k).alias(f"_{k}") for k in key])


def still_open(turns: DataFrame, bot: str) -> DataFrame:
    """Parents, the bot's newest turn of each thread, and the mentions after it; a repeated turn counts once."""
    once = turns.groupBy(*MENTION_KEY).agg(F.min(F.struct(*SAID)).alias("said")).select(*MENTION_KEY, "said.*")
    newest = once.filter(F.col("author") == bot).groupBy(*[F.col(k).alias(f"_{k}") for k in THREAD_KEY]).agg(
        F.max("turn").alias("_bot_turn")
    )
    kept = (F.col("turn") == 0) | F.col("_bot_turn").isNull() | (F.col("turn") >= F.col("_bot_turn"))
    return once.join(newest, same(once, newest, THREAD_KEY), "left").filter(kept).select(*MENTION_KEY, *SAID)


def with_parent(turns: DataFrame, bot: str) -> DataFrame:
    """The mentions of threads whose parent is known, with their text, the parent's, and both joined."""
    parents = turns.filter("turn = 0").select(*[F.col(k).alias(f"_{k}") for k in THREAD_KEY], F.col("body").alias("parent_body"))
    mentions = turns.filter((F.col("turn") > 0) & ~F.col("author").eqNullSafe(bot))
    clean = M.stripped(F.replace("body", F.lit(f"<@{bot}>"), F.lit("")))
    return (
        mentions.join(parents, same(mentions, parents, THREAD_KEY))
        .drop(*[f"_{k}" for k in THREAD_KEY])
        .withColumn("clean_body", clean)
        .withColumn("context", F.concat_ws("\n\n", F.nullif("parent_body", F.lit("")), F.col("clean_body")))
        .withColumn("message_ts", (F.unix_micros("event_time") / 1000000).cast("decimal(20, 6)").cast("string"))
    )


def mention_answers(mentions: DataFrame, orders: DataFrame, shipments: DataFrame, lines: DataFrame) -> DataFrame:
    """One answer row per mention.

    Its own order number comes first, then small talk, then the parent's order number. Other questions go to
    the table that the mention names, or else to the one that parent and mention name together; `answered_from`
    says which text it was, and is null where neither names one.
    """
    own, parent = M.order_number(F.col("clean_body")), M.order_number(F.col("parent_body"))
    intent = (
        F.when(own.isNotNull(), "order").when(M.smalltalk_class(F.col("clean_body")).isNotNull(), "smalltalk")
        .when(parent.isNotNull(), "order").otherwise("data_question")
    )
    read = mentions.withColumn("intent", intent).withColumn("requested", F.when(F.col("intent") == "order", F.coalesce(own, parent)))
    asks = F.col("intent") == "data_question"
    first, second = M.topic_route(F.col("clean_body")), M.topic_route(F.col("context"))
    read = read.withColumn("topic", F.when(asks, F.coalesce(first, second))).withColumn(
        "answered_from", F.when(~asks | first.isNotNull(), "mention").when(second.isNotNull(), "thread")
    )
    return B.with_cards(read, orders, shipments, lines)


def mention_writer(
    base: str, bot: str, now: Column | None = None, quota: int = config.MENTION_QUOTA, buckets: int = 64,
    tables: Callable[[SparkSession], tuple[DataFrame, DataFrame, DataFrame]] | None = None,
) -> Callable[[DataFrame, int], None]:
    """Per micro-batch of thread turns: find the open mentions, answer up to the quota of each channel.

    Turns come in any order; a mention waits until its parent has come. The oldest mentions of a channel are
    answered first, once each; the others wait for the next batch, and go when a later turn of the bot comes or
    they are too old. With a quota of 0 the batch is only read, as a listener does that catches up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = thread_state(base, batch.schema["thread_id"].dataType.simpleString(), buckets)
        fresh = B.within_age(relevant(batch, bot), now)
        touched = state.touched(fresh)
        known = B.within_age(state.load(spark, batch_id, touched), now)
        turns = state.save(still_open(known.unionByName(fresh), bot), batch_id, touched)
        waiting = with_parent(turns, bot)
        before = newest_before(spark, f"{base}/mentions", batch_id)
        answered = None
        if before is not None:
            before = B.within_age(before, now)
            answered = before.filter("state = 'answered'")
            untouched = before.filter((F.col("state") == "pending") & ~state.bucket().isin(touched)).drop("state")
            done = keyed(answered, MENTION_KEY)
            waiting = waiting.unionByName(untouched)
            waiting = waiting.join(done, same(waiting, done, MENTION_KEY), "left_anti")
        decided = B.split_by_quota(waiting, quota)
        listed = decided if answered is None else decided.unionByName(answered)
        target = batch_folder(f"{base}/mentions", batch_id)
        listed.write.mode("overwrite").parquet(target)
        if tables is not None:
            stored = spark.read.schema(listed.schema).parquet(target).filter("state = 'answered'").drop("state")
            if answered is not None:
                done = keyed(answered, MENTION_KEY)
                stored = stored.join(done, same(stored, done, MENTION_KEY), "left_anti")
            mention_answers(stored, *tables(spark)).write.mode("overwrite").parquet(batch_folder(f"{base}/answers", batch_id))
        state.tidy(spark, batch_id)
        earlier = [n for n in batches(spark, f"{base}/mentions") if n < batch_id]
        drop_before(spark, f"{base}/mentions", earlier[-1:], batch_id)

    return write


def known_mentions(spark: SparkSession, base: str) -> DataFrame:
    """The mentions that wait, and those answered within the age limit, after the last batch."""
    return newest_before(spark, f"{base}/mentions", 1 << 62)
