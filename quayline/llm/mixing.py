"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of named sources in the mix; the others share the rest evenly.
WEIGHTS = {"src0": 0.25}
SEED = 17
#: Digits of the hash that make a uniform number: 52 bits, all exact in a double.
DIGITS = 13
#: A higher rate is drawn as the sum of as many draws as bring each to this rate or less.
MOST = 256
#: A draw's copies are numbered from its number times this: over the longest table of a distribution.
STRIDE = 512
#: Input bytes of a task that writes, if the session's number of shuffle partitions gives more.
TASK_BYTES = 128 << 20
#: Draws of a document that one row stands for before they are exploded.
CHUNK = 1024


def uniform(seed: int, draw: Column, *keys: str) -> Column:
    """A number from [0, 1) that depends on the seed, the number of the draw and the keys alone."""
    label = F.when(draw == 0, F.lit(str(seed))).otherwise(F.concat_ws(":", F.lit(str(seed)), draw.cast("string")))
    hashed = F.md5(F.concat_ws("|", label, *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)))
    return F.conv(F.substring(hashed, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def rates(docs: DataFrame, weights: dict[str, float], factor: float, source: str, text: str) -> DataFrame:
    """(source, size, rate): how often a document of each source is to be repeated on average.

    A source's size is its code points and one more for each document, so that none is empty.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)) + 1).alias("size"))
    named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    sizes = sizes.withColumn("named", named[F.col("source")] if weights else F.lit(None).cast("double"))
    rest = sizes.select(
        (F.lit(1.0) - F.coalesce(F.sum("named"), F.lit(0.0))) / F.sum(F.col("named").isNull().cast("long"))
    ).scalar()
    total = sizes.select(F.sum("size")).scalar()
    return sizes.select("source", "size", (F.coalesce("named", rest) * total * factor / F.col("size")).alias("rate"))


def thresholds(rate: DataFrame) -> DataFrame:
    """(source, draws, below): into how many draws a source's rate is parted, and the Poisson distribution
    function of one at 0, 1, 2, ... as an ascending array.

    It runs to ten standard deviations and twenty steps beyond the mean, where a step is below the
    resolution of the uniform numbers. With at most `MOST` a draw it is shorter than `STRIDE`.
    """
    part = rate.withColumn("draws", F.greatest(F.ceil(F.col("rate") / MOST), F.lit(1)).cast("long")).select(
        "source", "draws", (F.col("rate") / F.col("draws")).alias("rate")
    )
    steps = F.sequence(F.lit(0), F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 20).cast("int"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return (
        part.select("source", "draws", "rate", F.explode(steps).alias("k"))
        .withColumn("log_factorial", F.sum(F.when(F.col("k") > 1, F.ln("k")).otherwise(0.0)).over(upto))
        .withColumn("p", F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("log_factorial")))
        .withColumn("below", F.sum("p").over(upto))
        .groupBy("source", "draws").agg(F.sort_array(F.collect_list("below")).alias("below"))
    )


def mixed(
    docs: DataFrame, weights: dict[str, float] | None = None, factor: float = 1.0, seed: int = SEED,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """All columns of `docs`, `copy` (from 1) and `shuffle_key`; columns of these two names are replaced.

    A document comes as often as a Poisson variable with its source's rate says, drawn by inverting
    the distribution at a number hashed from the seed and the doc_id. A rate above `MOST` is the sum of
    several such draws, each with a hash and a range of copy numbers of its own, so the table of a
    distribution never grows with the rate. A rate is the source's weight
    times `factor` times the size of all, over the source's own size: the mix has `factor` times the
    input's size, shared out by weight in expectation. Rows are dealt out by a hash of the copy's key
    and sorted by the key, which is a random order of all rows that depends on the seed alone.

    Sources without a weight, a null source among them, share what the named ones leave evenly.
    Rows of one doc_id are drawn alike; null ids count as one empty id. Null and empty texts have
    length zero. An empty table gives an empty one. Every source's rate meets its documents in a join
    by key, which adaptive execution splits for a source with very many documents.
    """
    weights = WEIGHTS if weights is None else weights
    if sum(weights.values()) > 1:
        raise ValueError("the weights of named sources exceed one")
    kept = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rows = docs.select(*kept)
    own = "mix"  # what the names of this function's columns start with
    while any(c.lower().startswith(own) for c in kept):
        own += "_"
    draws_of, below_of, chunk, draw, number, times = (f"{own}_{n}" for n in ("draws", "below", "chunk", "draw", "u", "times"))
    below = thresholds(rates(rows, weights, factor, source, text)).select(
        F.col("source").alias(f"{own}_source"), F.col("draws").alias(draws_of), F.col("below").alias(below_of)
    )
    dealt = rows.join(below, F.col(source).eqNullSafe(F.col(f"{own}_source")))
    # A document of a high rate becomes a row a chunk of draws, then a row a draw.
    chunks = F.sequence(F.lit(0).cast("long"), F.col(draws_of) - 1, F.lit(CHUNK).cast("long"))
    ends = F.least(F.col(chunk) + CHUNK, F.col(draws_of)) - 1
    draws = dealt.withColumn(chunk, F.explode(chunks)).withColumn(draw, F.explode(F.sequence(F.col(chunk), ends)))
    drawn = draws.withColumn(number, uniform(seed, F.col(draw), doc_id))
    drawn = drawn.withColumn(times, F.size(F.filter(below_of, lambda b: b <= F.col(number)))).where(F.col(times) > 0)
    first = F.col(draw) * STRIDE + 1
    copies = drawn.select(*kept, F.explode(F.sequence(first, first + F.col(times) - 1)).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col("copy").cast("string")))
    size = rows.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + F.lit(1))).first()[0] or 0
    tasks = math.ceil(size * factor / TASK_BYTES)
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = copies.withColumn("shuffle_key", key)
    dealt_out = copies.repartition(tasks, "shuffle_key") if tasks > least else copies.repartition("shuffle_key")
    return dealt_out.sortWithinPartitions("shuffle_key")


def check_sql(weights: dict[str, float] | None = None, factor: float = 1.0, seed: int = SEED) -> str:
    """DuckDB's SQL for (doc_id, source, copy, n_chars, shuffle_key) of the table `documents`."""
    weights = WEIGHTS if weights is None else weights
    named = " ".join(f"WHEN '{s}' THEN {w}::DOUBLE" for s, w in weights.items())
    return f"""
WITH sizes AS (
  SELECT source, sum(coalesce(length(text), 0) + 1) AS size, CASE source {named} END AS named
  FROM documents GROUP BY source
), whole AS (
  SELECT sum(size) AS total, coalesce(sum(named), 0) AS taken, count(*) - count(named) AS others FROM sizes
), rates AS (
  SELECT source, coalesce(named, (1.0::DOUBLE - taken) / others) * total * {float(factor)}::DOUBLE / size AS rate
  FROM sizes, whole
), parts AS (
  SELECT source, draws, rate / draws AS rate FROM (SELECT source, rate, greatest(ceil(rate / {MOST}), 1)::BIGINT AS draws FROM rates)
), steps AS (
  SELECT source, draws, rate, unnest(range(0, ceil(rate + 10 * sqrt(rate) + 20)::INT + 1)) AS k FROM parts
), terms AS (
  SELECT *, sum(CASE WHEN k > 1 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS log_factorial FROM steps
), below AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - log_factorial)) OVER (PARTITION BY source ORDER BY k) AS below FROM terms
), draws AS (
  SELECT d.*, unnest(range(0, draws)) AS draw FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
), drawn AS (
  SELECT doc_id, source, text, draw,
    ('0x' || substr(md5(concat_ws('|', CASE WHEN draw = 0 THEN '{seed}' ELSE '{seed}:' || draw END, coalesce(doc_id::VARCHAR, ''))), 1, {DIGITS}))::BIGINT::DOUBLE
      / {float(16**DIGITS)!r}::DOUBLE AS u
  FROM draws
), copies AS (
  SELECT doc_id, d.source, text, draw * {STRIDE} + k + 1 AS copy FROM drawn d JOIN below b ON d.source IS NOT DISTINCT FROM b.source AND b.below <= d.u
)
SELECT doc_id, source, copy::BIGINT AS copy, length(text)::INT AS n_chars,
  md5(concat_ws('|', '{seed}:order', coalesce(doc_id::VARCHAR, ''), copy::VARCHAR)) AS shuffle_key
FROM copies
"""
