"""Exact inner-product search by reading sorted lists: no-random-access aggregation, in tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
EVERY = 50
SCALE = 256
#: Candidates and queries of a tile.
CANDIDATES, QUERIES = 8192, 512
#: Shares of the lists that have been read after each round.
DEPTHS = (1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16, 1)
#: Reading stops for a query once at most this many candidates can still qualify; their scores are
#: then resolved. Lists read to their end leave no more to resolve than the bounds allow.
RESOLVED = 64
#: Sums up to here are exact in doubles.
EXACT = float(1 << 53)


def searched(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = K, scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the `k` rows with the highest scores, ties to the smaller vec_id.

    A component x counts as floor(`scale` * x) and a score is the inner product of those integers.
    Queries are the rows whose vec_id is divisible by `every`, candidates all rows of other ids. Rows
    without a vec_id or vector and those with a null or non-finite component take no part. Rows that
    share a vec_id are candidates each; a query of such an id has the best of all its rows, and none of
    them is its own candidate. A shorter vector counts as filled up with zeros. Other columns are
    ignored; an empty table gives an empty one, fewer than `k` candidates all. Scores are exact as long
    as they fit 63 bits.

    Of equal rows at most `k` can be among the best, so no more of them are searched. Blocks of queries
    meet blocks of candidates in tiles of bounded size, each a group of its own; a tile returns `k` rows
    a query, of which the best remain.
    """
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    rows = (
        vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull())
        .where(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .groupBy(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("parts")).agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
        .select("vec_id", "parts", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    )
    count, asked = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    blocks, groups = -(-count // CANDIDATES) or 1, -(-asked // QUERIES) or 1
    dealt = lambda label, n: F.pmod(F.xxhash64(F.lit(label), "vec_id", "parts", "copy"), F.lit(n)).cast("int")
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "parts", dealt("candidate", blocks).alias("block"), number(groups).alias("group"))
    queries = rows.where(F.col("vec_id") % every == 0).select(
        "vec_id", "parts", dealt("query", groups).alias("group"), number(blocks).alias("block")
    )

    def tile(own: pa.Table, asking: pa.Table) -> pa.Table:
        ids, parts = columns(own)
        query_ids, query_parts = columns(asking)
        width = max(parts.shape[1], query_parts.shape[1])
        found = best(padded(query_parts, width), query_ids, padded(parts, width), ids, k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found))))

    near = candidates.groupBy("block", "group").cogroup(queries.groupBy("block", "group")).applyInArrow(
        tile, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids in order, and a row of components for each."""
    table = table.select(["vec_id", "parts"]).combine_chunks()
    ids = table["vec_id"].to_numpy()
    if not len(ids):
        return ids.astype(np.int64), np.zeros((0, 0), np.int64)
    parts = table["parts"].chunk(0)
    size = parts.value_lengths().to_numpy()
    out = np.zeros((len(ids), size.max()), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = parts.flatten().to_numpy()
    order = np.argsort(ids)
    return ids[order], out[order]


def padded(parts: np.ndarray, width: int) -> np.ndarray:
    return np.pad(parts, ((0, 0), (0, width - parts.shape[1])))


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Query id, vector id and score of each query's best `k` of one tile; ids ascend.

    Each component has a list of the vectors sorted by it. A query reads the lists of its positive
    components from the top and those of its negative ones from the bottom, all to the same depth. What
    has been read of a vector adds up; each of its unread components lies between the last value read and
    the far end of the list, which bounds its score. Lists are the same for all queries of a tile, so
    what a round reads is added for all of them by products of matrices.
    """
    n, width = vectors.shape
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    if not n or not len(queries):
        return out[0]
    if float(np.abs(queries).max()) * float(np.abs(vectors).max()) * max(width, 1) < EXACT:
        queries, values = queries.astype(np.float64), vectors.astype(np.float64)
    else:  # too large for doubles
        values = vectors
    lists = np.sort(values, axis=0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    own = query_ids[:, None] == ids
    live = np.arange(len(queries))
    most = min(k, n)
    read = np.zeros((len(queries), n), values.dtype)  # the sums of what has been read
    above = below = np.zeros(values.shape, bool)  # what has been read from the top and from the bottom
    for share in DEPTHS:
        depth = max(int(np.ceil(share * n)), 1)
        top, bottom = lists[n - depth], lists[depth - 1]  # the last values read
        before, above, below = (above, below), values >= top, values <= bottom
        read += up[live] @ np.where(above & ~before[0], values, 0).T
        read += down[live] @ np.where(below & ~before[1], values, 0).T
        high = read + (up[live] * top) @ ~above.T + (down[live] * bottom) @ ~below.T
        low = read + (up[live] * lists[0]) @ ~above.T + (down[live] * lists[-1]) @ ~below.T
        outside = own[live]
        sure = np.where(outside, low.min() - 1, low)
        # The k-th best lower bound: what is below it cannot qualify, read or not.
        floor = np.partition(sure, n - most, axis=1)[:, n - most]
        can = (high >= floor[:, None]) & ~outside
        settled = (can.sum(1) <= max(RESOLVED, most)) | (depth == n)
        for i in np.flatnonzero(settled).tolist():
            near = np.flatnonzero(can[i])
            score = values[near] @ queries[live[i]]
            order = np.lexsort((near, -score))[:k]
            out.append((np.full(len(order), query_ids[live[i]]), ids[near[order]], score[order].astype(np.int64)))
        live, read = live[~settled], read[~settled]
        if not len(live):
            break
    return tuple(np.concatenate(part) for part in zip(*out))
