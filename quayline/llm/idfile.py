"""Token ids on disk: Simple-8b words in blocks that decode apart from each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.llm.common import in_batches, slices, texts
from quayline.llm.tokens import encoder

#: By selector: values in a word, and bits of each. Selector 0 is the escape: the word holds the
#: place of one value of over 60 bits among the segment's escapes. Selector 1 isn't used.
COUNTS = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Bit lengths of small values.
SMALL = np.concatenate([[0], np.repeat(np.arange(1, 17), 1 << np.arange(16))]).astype(np.uint8)
#: Values in a block; each block starts with a new word.
BLOCK = 1024
#: A row of the file, its segment, takes documents up to about this much text.
SEGMENT_BYTES = 4 << 20
#: Words of the encoder's memo; nothing else of weight runs beside it here.
MEMO = 450_000
FIELDS = (
    "part int, start long, doc_ids array<long>, counts array<int>, "
    "words binary, block_words array<int>, escapes binary"
)


def encoded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block, and the escapes, of unsigned 64-bit values.

    Each word takes as many values as fit. For all places at once it is worked out how many that
    are; then all blocks advance together, a word at a time.
    """
    n = len(values)
    blocks, width = -(-n // BLOCK), BLOCK + int(COUNTS.max())
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = values
    bits = np.zeros((blocks, width), np.uint8)
    if n and int(values.max()) < len(SMALL):
        bits[:, :BLOCK] = SMALL[flat].reshape(blocks, BLOCK)
        selector = np.full((blocks, BLOCK), 15, np.uint8)
    else:
        # The exponent of a rounded value is its bit length, or one more, which still fits.
        bits[:, :BLOCK] = np.frexp(flat.astype(np.float32))[1].astype(np.uint8).reshape(blocks, BLOCK)
        selector = np.where(flat >> np.uint64(60) != 0, 0, 15).astype(np.uint8).reshape(blocks, BLOCK)
    most, run = bits, 1
    for choice in range(14, 1, -1):
        while run < COUNTS[choice]:
            most = np.maximum(most[:, :-1], bits[:, run:])
            run += 1
        fit = most[:, :BLOCK] <= BITS[choice]
        if not fit.any():  # then longer runs of smaller values don't fit either
            break
        np.copyto(selector, np.uint8(choice), where=fit)
    selector = selector.ravel()
    end = np.minimum((np.arange(blocks) + 1) * BLOCK, n)
    block, at = np.arange(blocks), np.arange(blocks) * BLOCK
    count, taken = np.zeros(blocks, np.int64), []
    while len(block):
        taken.append((block, at))
        count[block] += 1
        at = at + COUNTS[selector[at]]
        live = at < end[block]
        block, at = block[live], at[live]
    # A block's words stand together, in the order in which they were taken.
    first = np.cumsum(count) - count
    place = np.zeros(int(count.sum()), np.int64)
    for step, (block, at) in enumerate(taken):
        place[first[block] + step] = at
    chosen = selector[place]
    words = chosen.astype(np.uint64) << np.uint64(60)
    escaped = chosen == 0
    padded = np.concatenate([flat, np.zeros(int(COUNTS.max()), np.uint64)])
    last = np.repeat(end, count)
    for choice in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == choice)
        if choice:
            start, upto = place[mine], last[mine]
            for j in range(COUNTS[choice]):
                value = padded[start + j] << np.uint64(j * BITS[choice])
                words[mine] |= value if j == 0 else np.where(start + j < upto, value, np.uint64(0))
        else:
            words[mine] |= np.arange(len(mine), dtype=np.uint64)
    return words, first.astype(np.int32), flat[place[escaped]]


def decoded(words: np.ndarray, block_words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The `n` values of `encoded`; all words are unpacked together."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[chosen]
    before = np.cumsum(count) - count
    owner = np.searchsorted(block_words, np.arange(len(words)), "right") - 1
    at = before - before[block_words][owner] + owner * BLOCK if len(words) else before
    # A block's last word may hold zeros beyond its values.
    end = np.minimum((owner + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for choice in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == choice)
        mask = np.uint64((1 << int(BITS[choice])) - 1)
        for j in range(COUNTS[choice]):
            inside = mine[at[mine] + j < end[mine]]
            value = (words[inside] >> np.uint64(j * BITS[choice])) & mask
            out[at[inside] + j] = value if choice else escapes[value.astype(np.int64)]
    return out


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0,
) -> None:
    """Write each document's ids and the end id, in ascending doc_id order, to the folder `path`.

    Parquet is the container, so that Spark commits the files whole and any store will do. A row is a
    segment of consecutive documents: which they are, how many ids each has, the Simple-8b words, the
    first word of each block of 1024 ids, and the place of the segment's first id in its part. Parts
    are ranges of doc_id, numbered in order. Null ids come first; rows of one doc_id stay together, in
    the order of a hash of their text. Null and empty texts are the end id alone. Other columns are
    ignored; an empty table writes no segment. Texts are encoded whole.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = encoder(tokenizer, blanks=True, memo=MEMO).many, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text", SEGMENT_BYTES):
            parts = [ids + end for ids in encode(texts(batch["text"]))]
            ids = np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)
            words, block_words, escapes = encoded(ids)
            yield pa.RecordBatch.from_pylist([{
                "part": part, "start": start, "doc_ids": batch["doc_id"].to_pylist(),
                "counts": [len(p) // 4 for p in parts], "words": words.astype("<u8").tobytes(),
                "block_words": block_words.tolist(), "escapes": escapes.astype("<u8").tobytes(),
            }], pa.schema([
                ("part", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
                ("words", pa.binary()), ("block_words", pa.list_(pa.int32())), ("escapes", pa.binary()),
            ]))
            start += len(ids)

    in_batches(ordered).mapInArrow(run, FIELDS).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from a folder of `write_ids`; `ids` are little-endian 32-bit numbers.

    `start` counts the ids of all documents before. The driver adds up one number for each part.
    """
    segments = spark.read.schema(FIELDS).parquet(path)
    sizes = segments.groupBy("part").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")
    ).orderBy("part").collect()
    total, first = 0, {}
    for part, n in sizes:
        first[part], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch[name][i] for name in batch.schema.names}
                counts = row["counts"].values.to_numpy()
                ids = decoded(
                    np.frombuffer(row["words"].as_buffer(), "<u8"), row["block_words"].values.to_numpy(),
                    np.frombuffer(row["escapes"].as_buffer(), "<u8"), int(counts.sum()),
                ).astype("<u4").tobytes()
                ends = np.cumsum(counts)
                start = first[row["part"].as_py()] + row["start"].as_py() + ends - counts
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array(start), pa.array(counts.astype(np.int64)),
                     pa.array([ids[4 * a:4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist())], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
