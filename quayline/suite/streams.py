"""Message streams, run to the end over files that Spark writes from the given tables."""

from pyspark.sql import DataFrame, functions as F

from quayline import config
from quayline.session import scratch_path
from quayline.sources.tables import read_if_exists
from quayline.streaming import mentions as N
from quayline.streaming import messages as B
from quayline.suite.registry import case
from quayline.suite.relational import LATER_REPLY_SQL, curated
from quayline.suite.texts import CLEAN_SQL, ORDER_SQL, question_sql, smalltalk_sql, topic_sql
from quayline.suite.questions import BEST_SQL
from quayline.suite.triage import CARD_SQL, SHORT_CARD_SQL

NOW_SQL = "TIMESTAMP '2024-01-30 12:00:00'"
NOW = "2024-01-30 12:00:00"


FILES = 4


def arriving(t, messages: DataFrame, spread: str = "event_id") -> DataFrame:
    """The messages as a stream of files in the shared folder, a file in each micro-batch.

    Rows are dealt to the files by a hash of `spread`: times and channels are mixed in every batch.
    """
    path = scratch_path(t.spark, "arriving")
    messages.repartition(FILES, spread).write.parquet(path)
    return B.message_stream(t.spark, path, messages.schema, files_per_batch=1)


def arrives(messages: DataFrame, path: str) -> int:
    """Write messages to a stream's folder, a file for each task; how many files came."""
    spark = messages.sparkSession
    files = lambda: 0 if read_if_exists(spark, path) is None else len(spark.read.schema(messages.schema).parquet(path).inputFiles())
    before = files()
    messages.write.mode("append").parquet(path)
    return files() - before


def channel_messages(t) -> DataFrame:
    return t.channel_messages.withColumn("event_time", F.col("ts").cast("timestamp"))


def curated_tables(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The curated tables, written once as a refresh does, and the source lines: what each batch looks up in."""
    written = []
    for label, df in zip(("delivery_orders", "shipments"), curated(t)):
        path = scratch_path(t.spark, label)
        df.write.parquet(path)
        written.append(t.spark.read.schema(df.schema).parquet(path))
    return (*written, t.delivery_lines)


def through(t, stream: DataFrame, writer=None, result: str = "") -> DataFrame:
    """The stream's whole output as a batch: a parquet sink, or what a batch function left."""
    base = scratch_path(t.spark, "output")
    B.run_to_end(stream, scratch_path(t.spark, "progress"), writer(base) if writer else base)
    return t.spark.read.parquet(base + result)


@case("stream_messages", "SELECT channel, message_ts, event_id, author, body FROM channel_messages")
def stream_messages(t):
    stream = arriving(t, channel_messages(t))
    return through(t, stream).select("channel", "message_ts", "event_id", "author", "body")


@case("stream_late_cutoff", f"""
    SELECT event_id, message_ts FROM channel_messages WHERE ts >= {NOW_SQL} - INTERVAL 2 HOUR""")
def stream_late_cutoff(t):
    stream = B.within_age(arriving(t, channel_messages(t)), F.lit(NOW).cast("timestamp"))
    return through(t, stream).select("event_id", "message_ts")


@case("stream_dedup", "SELECT channel, message_ts, event_id FROM channel_messages")
def stream_dedup(t):
    """Every message arrives twice, in files of mixed times, and leaves once; the stream starts anew in between."""
    messages = channel_messages(t).select("channel", "message_ts", "event_id", "event_time").withColumn("copy", F.lit(1))
    twice = messages.unionByName(messages.withColumn("copy", F.lit(2)))
    path, out, progress = (scratch_path(t.spark, n) for n in ("arriving", "output", "progress"))
    for half in range(2):
        own = F.pmod(F.xxhash64("event_id", "copy"), F.lit(2)) == half
        twice.filter(own).repartition(FILES // 2, "message_ts").write.mode("append").parquet(path)
        stream = B.message_stream(t.spark, path, twice.schema, files_per_batch=1)
        B.run_to_end(B.once(stream), progress, out)
    return t.spark.read.parquet(out).select("channel", "message_ts", "event_id")


@case("stream_type_filter", """
    SELECT event_id, author, subtype FROM channel_messages WHERE subtype IS NULL AND author <> 'U7'""")
def stream_type_filter(t):
    stream = B.without_types(arriving(t, channel_messages(t)), bot="U7")
    return through(t, stream).select("event_id", "author", "subtype")


OVERRIDES_SQL = """
    SELECT event_id, channel, channel = 'C2' AS escalation_cc, channel IN ('C2', 'C4') AS disclaimer
    FROM channel_messages"""


def overrides(t) -> DataFrame:
    """Channel settings, derived from the channels that occur."""
    channel = F.col("channel")
    return (
        t.channel_messages.select("channel").distinct()
        .filter(channel.isin("C2", "C4"))
        .withColumn("escalation_cc", F.when(channel == "C2", True))
        .withColumn("disclaimer", F.lit(True))
    )


@case("stream_channel_config", OVERRIDES_SQL)
def stream_channel_config(t):
    stream = B.with_channel_config(arriving(t, channel_messages(t)), overrides(t))
    return through(t, stream).select("event_id", "channel", "escalation_cc", "disclaimer")


@case("stream_quota", f"""
    SELECT event_id, channel, CASE WHEN ROW_NUMBER() OVER (PARTITION BY channel
               ORDER BY CAST(message_ts AS DOUBLE)) <= 3 * {FILES} THEN 'answered' ELSE 'pending' END AS state
    FROM channel_messages WHERE {question_sql('body')}""")
def stream_quota(t):
    """All arrive in the first batch; it and the later ones answer three of each channel."""
    base, path, progress = (scratch_path(t.spark, n) for n in ("quota", "arriving", "progress"))
    messages = channel_messages(t)
    write = B.quota_writer(base)
    for n in range(FILES):  # each with its files, so in this order
        files = arrives(messages if n == 0 else messages.limit(0), path)
        B.run_to_end(B.questions_only(B.message_stream(t.spark, path, messages.schema, files)), progress, write)
    return B.quota_state(t.spark, base).select("event_id", "channel", "state")


@case("stream_answered_anti", """
    SELECT thread_id, turn FROM mention_threads m WHERE turn = 0
      AND NOT EXISTS (SELECT 1 FROM mention_threads r WHERE r.thread_id = m.thread_id AND r.author = 'BOT'
                      AND r.event_time BETWEEN m.event_time AND m.event_time + INTERVAL 10 MINUTE)""")
def stream_answered_anti(t):
    """Parents and replies are two streams, in batches of mixed times; one last turn far ahead ends the waiting."""
    turns = t.mention_threads.select("thread_id", "turn", "author", "event_time")
    last = turns.limit(1).agg(
        F.lit(-1).cast(turns.schema["thread_id"].dataType).alias("thread_id"),
        F.lit(0).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("BOT").alias("author"),
        F.lit("2030-01-01").cast(turns.schema["event_time"].dataType).alias("event_time"),
    )
    streams = []
    for label, rows in (("parents", turns.filter("turn = 0")), ("replies", turns)):
        path = scratch_path(t.spark, label)
        rows.repartition(FILES, F.xxhash64("thread_id", "turn")).write.parquet(path)
        streams.append(path)
    progress, out = scratch_path(t.spark, "progress"), scratch_path(t.spark, "output")

    def run() -> None:
        parents, replies = (B.message_stream(t.spark, path, turns.schema, files_per_batch=1) for path in streams)
        B.run_to_end(B.unanswered_within(parents, replies, "BOT", "10 minutes", "2 days"), progress, out)

    run()
    for _ in range(2):  # what the first one ends comes out with the second
        for path in streams:
            last.write.mode("append").parquet(path)
    run()
    return t.spark.read.parquet(out).filter("thread_id <> -1").select("thread_id", "turn")


def open_mentions(t) -> DataFrame:
    """Turns of a thread arrive in different batches, replies before the mentions they answer too."""
    base = scratch_path(t.spark, "mentions")
    messages = t.mention_threads.withColumn("deal", F.xxhash64("thread_id", "turn"))
    write = N.mention_writer(base, "BOT", F.lit("2024-01-30").cast("timestamp"), quota=0)
    B.run_to_end(arriving(t, messages, "deal"), scratch_path(t.spark, "progress"), write)
    return N.known_mentions(t.spark, base)


OPEN_SQL = LATER_REPLY_SQL.replace("thread_messages", "mention_threads")


@case("stream_unanswered_mentions", OPEN_SQL)
def stream_unanswered_mentions(t):
    return open_mentions(t).select("thread_id", "turn", "author")


CLEAN_MENTION_SQL = "TRIM(REPLACE(m.body, '<@BOT>', ''), ' \n')"


@case("stream_thread_context", f"""
    WITH open AS ({OPEN_SQL})
    SELECT o.thread_id, o.turn, {CLEAN_MENTION_SQL} AS clean_body,
           CONCAT_WS(chr(10) || chr(10), NULLIF(p.body, ''), {CLEAN_MENTION_SQL}) AS context
    FROM open o JOIN mention_threads m ON m.thread_id = o.thread_id AND m.turn = o.turn
    LEFT JOIN mention_threads p ON p.thread_id = o.thread_id AND p.turn = 0""")
def stream_thread_context(t):
    return open_mentions(t).select("thread_id", "turn", "clean_body", "context")


CYCLES = 2


def mentions_sql() -> str:
    own, parent = ORDER_SQL.format("clean"), ORDER_SQL.format("parent")
    known = BEST_SQL.replace("order_requests", "(SELECT requested AS order_number FROM asked)").strip()
    return f"""
    WITH young AS (SELECT * FROM mention_threads WHERE event_time >= {NOW_SQL} - INTERVAL 2 HOUR),
    waiting AS (
        SELECT m.*, {CLEAN_MENTION_SQL} AS clean, p.body AS parent,
               ROW_NUMBER() OVER (PARTITION BY m.channel ORDER BY m.event_time) AS place
        FROM young m JOIN young p ON p.thread_id = m.thread_id AND p.turn = 0
        JOIN ({OPEN_SQL}) o ON o.thread_id = m.thread_id AND o.turn = m.turn),
    asked AS (
        SELECT *, CASE WHEN {own} IS NOT NULL THEN {own} WHEN {smalltalk_sql('clean')} IS NULL THEN {parent} END AS requested,
               CASE WHEN {own} IS NOT NULL THEN 'order' WHEN {smalltalk_sql('clean')} IS NOT NULL THEN 'smalltalk'
                    WHEN {parent} IS NOT NULL THEN 'order' ELSE 'data_question' END AS intent
        FROM waiting),
    {known.removeprefix('WITH ')}
    SELECT a.thread_id, a.turn, CASE WHEN place <= {config.MENTION_QUOTA * CYCLES} THEN 'answered' ELSE 'pending' END AS state,
           CASE WHEN place <= {config.MENTION_QUOTA * CYCLES} THEN intent END AS intent,
           CASE WHEN place <= {config.MENTION_QUOTA * CYCLES} AND intent = 'data_question'
                THEN COALESCE({topic_sql('clean')}, {topic_sql("CONCAT_WS(chr(10), parent, clean)")}) END AS topic,
           CASE WHEN place > {config.MENTION_QUOTA * CYCLES} THEN NULL
                WHEN intent <> 'data_question' OR {topic_sql('clean')} IS NOT NULL THEN 'mention'
                WHEN {topic_sql("CONCAT_WS(chr(10), parent, clean)")} IS NOT NULL THEN 'thread' END AS answered_from,
           CASE WHEN place <= {config.MENTION_QUOTA * CYCLES} AND intent = 'order' THEN COALESCE(b.card, 'not found') END AS answer
    FROM asked a
    LEFT JOIN (SELECT requested, CASE WHEN found_in = 'shipment' THEN {SHORT_CARD_SQL} ELSE {CARD_SQL} END AS card
               FROM best WHERE rn = 1) b ON b.requested = a.requested"""


@case("stream_mentions", mentions_sql())
def stream_mentions(t):
    """A listener catches up with turns in batches of mixed times, then answers two of each channel in each batch."""
    base, path, progress = (scratch_path(t.spark, n) for n in ("mentions", "arriving", "progress"))
    messages, now = t.mention_threads, F.lit(NOW).cast("timestamp")
    messages.repartition(FILES, F.xxhash64("thread_id", "turn")).write.parquet(path)
    stream = lambda: B.message_stream(t.spark, path, messages.schema, 1)
    B.run_to_end(stream(), progress, N.mention_writer(base, "BOT", now, quota=0))
    tables = curated_tables(t)
    for _ in range(CYCLES):
        messages.limit(0).coalesce(1).write.mode("append").parquet(path)
        B.run_to_end(stream(), progress, N.mention_writer(base, "BOT", now, tables=lambda spark: tables))
    found = N.known_mentions(t.spark, base).select("channel", "thread_id", "turn", "state")
    answers = t.spark.read.parquet(f"{base}/answers").select(
        "thread_id", "turn", "intent", "topic", "answered_from", "answer"
    )
    return found.drop("channel").join(answers, ["thread_id", "turn"], "left")


def answer_sql() -> str:
    known = BEST_SQL.replace("order_requests", "(SELECT {order} AS order_number FROM channel_messages)")
    order = "NULLIF(UPPER(REGEXP_EXTRACT(body, '(US|CA|GB)-\\d{6,}(-WR)?', 0, 'i')), '')"
    return known.replace("{order}", order) + f"""
    SELECT m.event_id, m.intent, m.requested, CASE WHEN m.intent = 'order' THEN COALESCE(b.card, 'not found') END AS answer
    FROM (SELECT event_id, {order} AS requested,
                 CASE WHEN {order} IS NOT NULL THEN 'order' WHEN {smalltalk_sql(CLEAN_SQL)} IS NOT NULL
                      THEN 'smalltalk' ELSE 'data_question' END AS intent
          FROM channel_messages WHERE {question_sql('body')}) m
    LEFT JOIN (SELECT requested, CASE WHEN found_in = 'shipment' THEN {SHORT_CARD_SQL} ELSE {CARD_SQL} END AS card
               FROM best WHERE rn = 1) b ON b.requested = m.requested"""


@case("stream_triage", answer_sql())
def stream_triage(t):
    tables = curated_tables(t)
    sources = lambda spark: tables
    stream = B.questions_only(arriving(t, channel_messages(t)))
    found = through(t, stream, lambda base: B.triage_writer(base, sources))
    return found.select("event_id", "intent", "requested", "answer")


@case("stream_listener", f"""
    SELECT a.event_id, a.intent, a.requested, a.answer FROM ({answer_sql()}) a JOIN (
        SELECT event_id, ROW_NUMBER() OVER (PARTITION BY channel ORDER BY CAST(message_ts AS DOUBLE)) AS place
        FROM channel_messages
        WHERE ts >= {NOW_SQL} - INTERVAL 2 HOUR AND (subtype IS NULL OR subtype NOT IN ('channel_join', 'bot_message'))
          AND author <> 'U7' AND reply_count <> 2 AND {question_sql('body')}) e
      ON e.event_id = a.event_id AND e.place <= 3 * {FILES}""")
def stream_listener(t):
    """All arrive in the first batch and again in the next; every batch answers three of each channel."""
    base, path, progress = (scratch_path(t.spark, n) for n in ("listener", "arriving", "progress"))
    messages = channel_messages(t).withColumn("thread_id", F.concat_ws(":", "channel", "message_ts"))
    # Two replies in a thread mean that the bot has been there.
    replies = messages.filter("reply_count = 2").select("thread_id", F.lit("U7").alias("author"))
    tables, now = curated_tables(t), F.lit(NOW).cast("timestamp")
    write = B.listener_writer(base, lambda spark: tables, lambda spark: replies, "U7", now)
    for n in range(FILES):
        files = arrives(messages if n < 2 else messages.limit(0), path)
        stream = B.message_stream(t.spark, path, messages.schema, files)
        B.run_to_end(B.to_answer(stream, "U7", now), progress, write, idle=False)
    return t.spark.read.parquet(f"{base}/answers").select("event_id", "intent", "requested", "answer")


@case("stream_refresh_config", OVERRIDES_SQL)
def stream_refresh_config(t):
    path = scratch_path(t.spark, "settings")
    overrides(t).write.parquet(path)
    reread = lambda spark: spark.read.parquet(path)
    stream = arriving(t, channel_messages(t))
    found = through(t, stream, lambda base: B.config_writer(base, reread))
    return found.select("event_id", "channel", "escalation_cc", "disclaimer")
