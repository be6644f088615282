import random
from datetime import datetime, timedelta

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quayline.session import scratch_path
from quayline.streaming import mentions as N
from quayline.streaming import messages as B
from quayline.streaming.state import batch_folder, batches

SCHEMA = "channel string, message_ts string, event_time timestamp, body string"


def post(spark, path, numbers, channel="C1", minutes=1):
    start = datetime(2024, 1, 1)
    rows = [(channel, str(n), start + timedelta(minutes=n * minutes), f"what about {n}") for n in numbers]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return B.message_stream(spark, path, spark.read.parquet(path).schema)


def test_each_message_once_across_restarts(spark):
    path, out, progress = (scratch_path(spark, n) for n in ("in", "out", "progress"))
    # Times go back by days between batches: nothing is lost for being late.
    for numbers in ([9000, 2, 2, 3], [2, 3, 4, 1], [9000, 20000, 5], [1, 5, 20000]):
        post(spark, path, numbers)
        B.run_to_end(B.once(stream(spark, path)), progress, out)
    found = sorted(int(r.message_ts) for r in spark.read.parquet(out).collect())
    assert found == [1, 2, 3, 4, 5, 9000, 20000]


def test_keys_of_seen_messages_expire(spark):
    path, out, progress = (scratch_path(spark, n) for n in ("in", "out", "progress"))
    sizes = []
    # Five messages arrive in each of eight hours, with times of their own that are mixed.
    for hour in range(8):
        arrived = datetime(2024, 1, 1) + timedelta(hours=hour)
        rows = [("C1", str(5 * hour + n), arrived, datetime(2024, 1, 1 + n)) for n in range(5)] * 2
        rows += [("C1", str(5 * hour - 1), arrived, datetime(2024, 1, 5))] * (hour > 0)  # again, an hour later
        spark.createDataFrame(rows, "channel string, message_ts string, at timestamp, event_time timestamp").coalesce(1).write.mode("append").parquet(path)
        ran = B.run_to_end(B.once(stream(spark, path), "2 hours", F.col("at")), progress, out)
        sizes.append(ran[-1]["stateOperators"][0]["numRowsTotal"])
    assert sorted(int(r.message_ts) for r in spark.read.parquet(out).collect()) == list(range(40))
    assert max(sizes) <= 25 and sizes[-1] <= sizes[4]


def test_an_unanswered_message_comes_out_after_its_bound(spark):
    parents, replies, out, progress = (scratch_path(spark, n) for n in ("parents", "replies", "out", "progress"))
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)

    def batch(asked, replied):
        spark.createDataFrame(asked, "thread_id int, event_time timestamp").coalesce(1).write.mode("append").parquet(parents)
        spark.createDataFrame(replied, "thread_id int, author string, event_time timestamp").coalesce(1).write.mode("append").parquet(replies)
        own, others = (B.message_stream(spark, p, spark.read.parquet(p).schema) for p in (parents, replies))
        B.run_to_end(B.unanswered_within(own, others, "BOT", "10 minutes", "30 minutes"), progress, out)
        return sorted(r.thread_id for r in spark.read.parquet(out).collect())

    # 1: answered in time by a reply that arrives first. 2: too late. 3: by another author. 4: a reply before it.
    assert batch([(2, at(0)), (3, at(1)), (4, at(20))], [(1, "BOT", at(8)), (4, "BOT", at(19))]) == []
    assert batch([(1, at(2))], [(2, "BOT", at(11)), (3, "u", at(2))]) == []
    assert batch([(9, at(42))], [(9, "BOT", at(42))]) == [2, 3]  # the watermark is at minute 12
    assert batch([(9, at(300))], [(9, "BOT", at(42))]) == [2, 3]  # replies are not so far yet
    assert batch([(9, at(301))], [(9, "BOT", at(301))]) == [2, 3, 4]


def test_equal_messages_keep_their_number(spark):
    rows = [("C1", "1", "a"), ("C1", "1", "a"), ("C1", "1", "b"), ("C1", "2", "c"), (None, "3", "d")]
    df = spark.createDataFrame(rows, "channel string, message_ts string, body string")
    states = [(r.message_ts, r.state) for r in B.split_by_quota(df, 3).collect()]
    assert sorted(states) == [("1", "answered")] * 3 + [("2", "pending"), ("3", "answered")]


def test_messages_without_an_author_stay(spark):
    df = spark.createDataFrame([(None, None), ("BOT", None), ("U", "channel_join")], "author string, subtype string")
    assert [r.author for r in B.without_types(df, bot="BOT").collect()] == [None]


def test_quota_keeps_the_rest_for_the_next_batch(spark):
    path, base, progress = (scratch_path(spark, n) for n in ("in", "out", "progress"))
    answered = []
    for numbers in ([5, 1, 4, 2, 3], [6], [7]):
        post(spark, path, numbers)
        B.run_to_end(stream(spark, path), progress, B.quota_writer(base, 3))
        last = len(answered)
        state = spark.read.parquet(batch_folder(f"{base}/state", last))
        answered.append(sorted(r.message_ts for r in state.filter("state = 'answered'").collect()))
    assert answered == [["1", "2", "3"], ["4", "5", "6"], ["7"]]


def test_a_repeated_batch_changes_nothing(spark):
    base = scratch_path(spark, "out")
    write = B.quota_writer(base, 1)
    path = scratch_path(spark, "in")
    post(spark, path, [1, 2])
    batch = spark.read.parquet(path)
    for batch_id in (0, 1, 1):
        write(batch.limit(0) if batch_id else batch, batch_id)
    state = spark.read.parquet(batch_folder(f"{base}/state", 1)).collect()
    assert [(r.message_ts, r.state) for r in state] == [("2", "answered")]


def test_age_limit(spark):
    path = scratch_path(spark, "in")
    post(spark, path, [0, 59, 60, 180])
    now = F.lit("2024-01-01 03:00:00").cast("timestamp")
    kept = B.within_age(spark.read.parquet(path), now).collect()
    assert sorted(int(r.message_ts) for r in kept) == [60, 180]
    assert B.within_age(spark.read.parquet(path)).count() == 0


def test_event_time_from_epoch_text(spark):
    row = B.with_event_time(spark.createDataFrame([("1712345678.5",)], "message_ts string")).first()
    assert row.event_time == datetime(2024, 4, 5, 19, 34, 38, 500000)


TURN = "channel string, thread_id int, turn int, author string, body string, event_time timestamp"
NOON = datetime(2024, 1, 1, 12)
NOW = "2024-01-01 12:00:00"


def turn(thread, number, author, body, minutes=60, channel="C1"):
    return (channel, thread, number, author, body, NOON - timedelta(minutes=minutes) + timedelta(seconds=number))


def listen(spark, parts, quota=2, buckets=4, repeat=False, tables=None):
    """The mentions known after each part, as (thread, turn, state)."""
    base, told = scratch_path(spark, "mentions"), []
    write = N.mention_writer(base, "BOT", F.lit(NOW).cast("timestamp"), quota, buckets, tables)
    for number, rows in enumerate(parts):
        for _ in range(1 + repeat):
            write(spark.createDataFrame(rows, TURN), 3 * number)  # numbers may be left out
        known = N.known_mentions(spark, base)
        told.append(sorted((r.thread_id, r.turn, r.state) for r in known.collect()))
    return base, told


def test_mentions_over_several_batches(spark):
    parts = [
        [turn(1, 0, "a", "where is US-123456"), turn(1, 1, "a", "<@BOT> please"), turn(2, 1, "b", "<@BOT> hi"), turn(3, 0, "c", "x")],
        [turn(1, 2, "BOT", "here"), turn(2, 0, "b", "")],
        [turn(2, 1, "b", "<@BOT> hi"), turn(3, 1, "c", "<@BOT> again", 59), turn(3, 3, "c", "<@BOT> more", 58)],
    ]
    base, told = listen(spark, parts, quota=0)
    assert told == [[(1, 1, "pending")], [(2, 1, "pending")], [(2, 1, "pending"), (3, 1, "pending"), (3, 3, "pending")]]
    found = {(r.thread_id, r.turn): (r.clean_body, r.context) for r in N.known_mentions(spark, base).collect()}
    assert found == {(2, 1): ("hi", "hi"), (3, 1): ("again", "x\n\nagain"), (3, 3): ("more", "x\n\nmore")}
    assert listen(spark, parts, quota=0, repeat=True)[1] == told


def test_mentions_are_answered_once_oldest_first(spark):
    rows = [turn(n, 0, "a", "p", 90) for n in range(5)] + [turn(n, 1, "a", "<@BOT> q", 80 - n) for n in range(5)]
    rows += [turn(8, 0, "a", "p", 70, "C2"), turn(8, 1, "a", "<@BOT> q", 70, "C2"), turn(9, 0, "a", "p", 200), turn(9, 1, "a", "<@BOT> q")]
    rows += [turn(7, 0, "a", "p"), turn(7, 1, "a", "<@BOT> q", 121)]
    expected = lambda n: sorted([(i, 1, "answered" if i < n else "pending") for i in range(5)] + [(8, 1, "answered")])
    # All of it comes again in the second batch; nothing is answered twice.
    assert listen(spark, [rows, rows, []])[1] == [expected(2), expected(4), expected(5)]
    assert listen(spark, [rows, [], []], repeat=True)[1] == [expected(2), expected(4), expected(5)]


def test_mentions_in_any_order(spark):
    rows = [turn(n, 0, "a", f"parent {n}") for n in range(30)]
    rows += [turn(n, t, "BOT" if (n + t) % 4 == 0 else "a", "<@BOT> x" if t % 2 else "y", 50) for n in range(30) for t in range(1, 6)]
    last = set()
    for seed in range(3):
        dealt = random.Random(seed).sample(rows, len(rows))
        parts = [dealt[:20], dealt[20:90], dealt[90:]]
        last.add(tuple(listen(spark, parts, quota=0, buckets=(1, 5, 64)[seed])[1][-1]))
    assert len(last) == 1 and len(next(iter(last))) > 20


def test_a_batch_touches_its_own_buckets(spark):
    parts = [[turn(n, t, "a", "<@BOT> x") for n in range(40) for t in range(2)], [turn(3, 5, "a", "<@BOT> y")]]
    base, _ = listen(spark, parts, quota=0, buckets=16)
    lists = spark.read.parquet(batch_folder(f"{base}/threads/current", 3)).collect()
    assert [r.version for r in lists].count(3) == 1 and [r.version for r in lists].count(0) >= 10
    assert batches(spark, f"{base}/mentions") == [0, 3]


def test_a_mention_is_answered_from_its_thread_when_it_names_nothing(spark):
    rows = [
        turn(1, 0, "a", "where is US-123456"), turn(1, 1, "a", "<@BOT> please"), turn(2, 0, "b", "inventory question"),
        turn(2, 1, "b", "<@BOT> how many"), turn(3, 0, "c", "x"), turn(3, 1, "c", "<@BOT> any receipt?"),
        turn(4, 0, "d", "US-123456"), turn(4, 1, "d", "<@BOT> thanks"), turn(5, 0, "e", "z"), turn(5, 1, "e", "<@BOT> huh?"),
    ]
    base = scratch_path(spark, "mentions")
    N.mention_writer(base, "BOT", F.lit(NOW).cast("timestamp"), 0)(spark.createDataFrame(rows, TURN), 0)
    from quayline.sources.derived import Feeds
    from quayline.suite.relational import curated

    t = Feeds(spark, SMALL)
    found = N.mention_answers(N.known_mentions(spark, base).drop("state"), *curated(t), t.delivery_lines)
    told = {r.thread_id: (r.intent, r.requested, r.topic, r.answered_from, r.answer) for r in found.collect()}
    assert told == {
        1: ("order", "US-123456", None, "mention", "not found"), 2: ("data_question", None, "inventory_eod", "thread", None),
        3: ("data_question", None, "all_inbound", "mention", None), 4: ("smalltalk", None, None, "mention", None),
        5: ("data_question", None, None, None, None),
    }


def test_settings_are_read_anew_after_their_interval(spark):
    path, told, progress, out = (scratch_path(spark, n) for n in ("in", "settings", "progress", "out"))
    seconds, reads = [0.0], []

    def settings(session):
        reads.append(seconds[0])
        return session.read.schema("channel string, escalation_cc boolean, disclaimer boolean").parquet(told)

    def tell(*rows):
        spark.createDataFrame(rows, "channel string, escalation_cc boolean, disclaimer boolean").write.mode("overwrite").parquet(told)

    write = B.config_writer(out, settings, clock=lambda: seconds[0])
    on, off = ("C1", None, True), ("C1", None, False)
    # The clock, what the settings say from then on, and what the batch sees.
    steps = [(0, [on], True), (299, [off], True), (300, [off], False), (599, [on], False), (610, [], False), (611, [on], True)]
    for number, (now, rows, _) in enumerate(steps):
        tell(*rows)
        seconds[0] = float(now)
        post(spark, path, [number])
        B.run_to_end(stream(spark, path), progress, write)
    found = spark.read.parquet(out).orderBy("event_time").collect()
    assert [r.disclaimer for r in found] == [seen for _, _, seen in steps]
    assert reads == [0.0, 300.0, 610.0, 611.0]


def test_settings_that_cannot_be_read_stay_as_they_were(spark):
    seconds, fails = [0.0], [False]

    def settings(session):
        return session.table("no_such_settings") if fails[0] else session.range(1).selectExpr("'C1' AS channel", "id")

    kept = B.Settings(settings, 300, lambda: seconds[0])
    assert kept.current(spark).count() == 1
    seconds[0], fails[0] = 400.0, True
    assert kept.current(spark).first().channel == "C1"
    with pytest.raises(Exception, match="no_such_settings"):
        B.Settings(settings, 300, lambda: 0.0).current(spark)
