"""What several operators share: text buffers, word hashes, held-out folds, scratch tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.session import scratch_path

#: The six ASCII blanks that end a word.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Text is worked on in slices of about this many bytes, so that a task's arrays stay small.
SLICE_BYTES = 4 << 20
LANE = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: it cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch of texts. Executor and Python worker hold a few batches each.
BATCH_ROWS, BATCH_BYTES = 4000, "12m"


def in_batches(df: DataFrame) -> DataFrame:
    """The DataFrame, in a session whose Arrow batches are bounded for long texts."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(parts)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` holds about `most` bytes in each; a longer row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_buffer(batch[column])[1][1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            upto = max(int(np.searchsorted(ends, base + most, "right")), at + 1)
            yield batch.slice(at, upto - at)
            at = upto


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the offset of each row; a null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None and bounds[-1] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each row; a null counts as empty."""
    data, bounds = text_buffer(column)
    whole = data.tobytes()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield whole[a:b]


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the number of words before it (one entry more than rows)."""
    blank = BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(~blank & (edge[:-1] | np.concatenate([[True], blank])[:-1]))
    ends = np.flatnonzero(~blank & (edge[1:] | np.concatenate([blank, [True]])[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    left = ends - starts
    out = mixed(left.astype(np.uint64) * M1)
    live, at = np.arange(len(starts)), starts
    while len(live):
        out[live] = mixed((out[live] ^ (lanes[at] & LANE[np.minimum(left, 8)])) * M1 + M2)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of `k` consecutive words, by doubling: few passes whatever `k`."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    block, width, factor = words, 1, np.full(1, M1)  # an array: scalars warn when they wrap
    out, done = None, 0
    while True:
        if k & width:
            if out is None:
                out = block
            else:
                n = min(len(out), len(block) - done)
                out = out[:n] * factor + block[done:done + n]
            done += width
        if width * 2 > k:
            return mixed(out[:len(words) - k + 1])
        block = block[:-width] * factor + block[width:]
        width, factor = width * 2, factor * factor
