"""Packing documents into training sequences: a configuration linear program over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayline.llm.common import in_batches, slices, stored, texts
from quayline.llm.tokens import encoder, vocabulary

CAPACITY = 4096
#: Words of the encoder's memo, about 200 bytes each in every Python worker.
MEMO = 300_000
END_ID = 1
#: Rounds of the multiplicative weights: in each, every length is priced once.
ROUNDS = 16
#: A configuration is as good as the best if its value is within this share of it.
SLACK = 0.002
#: How strongly the price of a length follows its uncovered demand.
RATE = 0.05
#: Share of what a configuration could still cover that one step takes.
STEP = 0.35

Config = tuple[tuple[int, int], ...]  # what a sequence holds: lengths, longest first, and how many of each
Configurations = list[tuple[Config, int]]  # and how many such sequences


def pieces(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, with_ids: bool = False, memo: int = MEMO,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), with the `ids` themselves as little-endian bytes on demand.

    A document's ids and the end id, cut after every `capacity` ids.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length int, ids_crc32 long"
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, blanks=False, memo=memo).many
        for batch in slices(batches, "text"):
            owner, piece, parts = [], [], []
            for i, ids in enumerate(encode(texts(batch["text"]))):
                ids += end
                for k in range(0, len(ids), width):
                    owner.append(i)
                    piece.append(k // width)
                    parts.append(ids[k:k + width])
            number = np.array(piece, np.int32)
            columns = [
                batch["doc_id"].take(pa.array(owner, pa.int64())), pa.array(number), pa.array(number.astype(np.int64) * capacity),
                pa.array([len(p) // 4 for p in parts], pa.int32()), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return in_batches(rows).mapInArrow(run, kind + ", ids binary" * with_ids)


def packed(
    docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, memo: int = MEMO,
) -> DataFrame:
    """The rows of `pieces` with `sequence_id` and `offset`: sequences of at most `capacity` ids, gapless from 0.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they come, ids may
    be null, other columns are ignored; an empty table gives an empty one. Texts are encoded whole.

    The driver sees the histogram of lengths only, `capacity` rows at most whatever the data. There it
    solves for configurations, each a list of lengths that fit a sequence and how often it is used. A
    piece's place among those of its length picks its slot. The places come from counts of
    (length, bucket), so that a length with very many pieces is numbered by many tasks.
    """
    session = docs.sparkSession
    cut = stored(pieces(docs, tokenizer or vocabulary("word_bpe_49k.json"), doc_id, text, capacity, end_id, with_ids, memo), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = session.sparkContext.broadcast(slot_table(solve(counts, capacity)))
    buckets = int(session.conf.get("spark.sql.shuffle.partitions"))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = keyed.withColumn("place", place).join(before, ["length", "bucket"]).withColumn(
        "place", F.col("place") - 1 + F.col("before")
    ).select(*cut.columns, "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, sequence, offset, times = slots.value
        for batch in batches:
            length = batch["length"].to_numpy(zero_copy_only=False).astype(np.int64)
            place = batch["place"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (length << 44) + place, "right") - 1
            rest = place - first[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in batch.schema.names if c != "place"), pa.array(sequence[at] + rest // times[at]),
                 pa.array(offset[at] + rest % times[at] * length)],
                [*(c for c in batch.schema.names if c != "place"), "sequence_id", "offset"],
            )

    kind = cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked.mapInArrow(run, kind)


def slot_table(found: Configurations) -> tuple[np.ndarray, ...]:
    """For each length and configuration: key (length and first place), first place, first sequence, offset, times in it."""
    rows, met, base = [], {}, 0
    for lengths, copies in found:
        offset = 0
        for length, times in lengths:
            first = met.get(length, 0)
            rows.append(((length << 44) + first, first, base, offset, times))
            met[length] = first + times * copies
            offset += times * length
        base += copies
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(table.T.copy())


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Configurations:
    """Configurations that hold exactly `counts` pieces of each length.

    The linear program asks for the fewest configurations that cover the demand of every length. Its
    dual prices are multiplicative weights: they start at a length's share of a sequence and fall as
    the length gets covered. A knapsack dynamic program over the capacity prices all configurations;
    the best one with each length in it takes a step if it is nearly as good as the best of all. The
    fractional solution is rounded, up only for full sequences that demand allows, and what is left is
    filled in by best fit, longest first. The work depends on the capacity and not on the number of pieces.
    """
    found: dict[Config, float] = {}
    left = {length: float(n) for length, n in counts.items() if n}
    full = left.pop(capacity, 0)
    lengths = np.array(sorted(left), np.int64)
    demand = np.array([left[x] for x in lengths.tolist()])
    cover, log_weight = demand.copy(), np.zeros(len(lengths))
    for _ in range(ROUNDS if len(lengths) else 0):
        live = np.flatnonzero(cover > 0.02 * demand)
        if not len(live):
            break
        own = lengths[live]
        price = own / capacity * np.exp(log_weight[live] - log_weight[live].max())
        best, choice = knapsack(own, price, capacity)
        good = np.flatnonzero(price + best[capacity - own] >= (1 - SLACK) * best[capacity])
        size, pick, rest = own.tolist(), choice.tolist(), cover[live].tolist()
        for i in reversed(good.tolist()):
            items, room = {i: 1}, capacity - size[i]
            while pick[room] >= 0:
                k = pick[room]
                items[k] = items.get(k, 0) + 1
                room -= size[k]
            step = STEP * min(rest[k] / n for k, n in items.items())
            if step > 0:
                for k, n in items.items():
                    rest[k] -= step * n
                config = tuple((size[k], items[k]) for k in sorted(items, reverse=True))
                found[config] = found.get(config, 0.0) + step
        log_weight[live] -= RATE * (cover[live] - rest) / np.maximum(demand[live], 1)
        cover[live] = rest
    return rounded(found, counts, full, capacity)


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room: the best total price of lengths that fit, and one length of it (-1: none)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        k = fit[room]
        if k:
            total = best[room - lengths[:k]] + price[:k]
            at = int(total.argmax())
            if total[at] > best[room - 1]:
                best[room], choice[room] = total[at], at
                continue
        # Nothing fills this room exactly as well: it is worth what one less is, and starts there.
        best[room], choice[room] = best[room - 1], choice[room - 1]
    return best, choice


def rounded(found: dict[Config, float], counts: dict[int, int], full: float, capacity: int) -> Configurations:
    left = {length: n for length, n in counts.items() if n and length < capacity}
    out: dict[Config, int] = {((capacity, 1),): int(full)} if full else {}

    def take(config: Config, most: int) -> None:
        n = min(most, *(left[x] // times for x, times in config))
        if n > 0:
            out[config] = out.get(config, 0) + n
            for x, times in config:
                left[x] -= n * times

    for config, x in found.items():
        take(config, int(x))
    for config in sorted(found, key=lambda c: (found[c] % 1, c), reverse=True):
        if found[config] % 1 >= 0.5 and sum(x * n for x, n in config) == capacity:
            take(config, 1)
    for config, n in best_fit(left, capacity):
        out[config] = out.get(config, 0) + n
    return sorted(out.items())


def best_fit(left: dict[int, int], capacity: int) -> Configurations:
    """Best fit, longest first, on counts: sequences with the same content are handled as one."""
    rooms: list[dict[Config, int]] = [{} for _ in range(capacity + 1)]
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        todo = left[length]
        room = length
        while todo and room <= capacity:
            if not rooms[room]:
                room += 1
                continue
            # As many of this length as fit; a last sequence may take fewer.
            config, n = rooms[room].popitem()
            times = min(room // length, todo)
            used = min(n, todo // times)
            if n > used:
                rooms[room][config] = n - used
            own = dict(config)
            own[length] = own.get(length, 0) + times
            rest, longer = room - times * length, tuple(own.items())
            rooms[rest][longer] = rooms[rest].get(longer, 0) + used
            todo -= used * times
        # New sequences.
        most = capacity // length
        for times, n in ((most, todo // most), (todo % most, 1)):
            if times and n:
                config, rest = ((length, times),), capacity - times * length
                rooms[rest][config] = rooms[rest].get(config, 0) + n
    return [(config, n) for room in rooms for config, n in room.items()]
