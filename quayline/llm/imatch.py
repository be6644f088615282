"""I-Match fingerprints: hashes of a document's terms within randomised parts of a lexicon of middling terms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import M1, in_batches, mixed, slices, stored, text_buffer, word_bounds, word_hashes

#: Shares of documents that a term of the lexicon may occur in: its band of inverse document frequency.
RAREST, COMMONEST = 0.002, 0.1
#: A part of the documents reports a term only from this share of `RAREST` on. Terms of the lexicon
#: keep over 1 - REPORT of their documents in the reports, whatever the parts.
REPORT = 0.25
#: Lexicons: in each draw the parts are nested, each with half of the terms of the one before.
DRAWS, LEVELS = 6, 12
#: Every byte that is no ASCII letter or digit and not part of a longer character ends a term.
TERM = np.arange(256, dtype=np.uint8)
TERM[:128] = [ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(128)]
GRID = np.unique(np.round(2 ** np.arange(0, 20, 0.125)).astype(np.int64))


def terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each term, in the order of the text."""
    data = TERM[data]
    starts, ends, before = word_bounds(data, bounds)
    return np.repeat(np.arange(len(before) - 1), np.diff(before)), word_hashes(data, starts, ends)


def distinct(owner: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct terms, sorted."""
    order = np.lexsort((term, owner))
    owner, term = owner[order], term[order]
    fresh = np.ones(len(term), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])
    return owner[fresh], term[fresh]


def document_frequencies(rows: DataFrame, known: np.ndarray | None, least: float) -> DataFrame:
    """(term, n): in how many documents of each part of `rows` the terms occur; term null: the part's documents.

    Of all terms those in at least the share `least` of a part's documents, or of the terms `known` all.
    """
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, docs = shared.value, 0
        found, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in slices(batches, "text"):
            owner, term = terms(*text_buffer(batch["text"]))
            if only is not None:
                mine = among(term, only)
                owner, term = owner[mine], term[mine]
            new, n = np.unique(distinct(owner, term)[1], return_counts=True)
            found, at = np.unique(np.concatenate([found, new]), return_inverse=True)
            count = np.bincount(at, np.concatenate([count, n]), len(found)).astype(np.int64)
            docs += batch.num_rows
        keep = count >= least * docs
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *found[keep].view(np.int64).tolist()], pa.int64()), pa.array([docs, *count[keep].tolist()], pa.int64())],
            ["term", "n"],
        )

    return in_batches(rows).select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def among(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def lexicon(rows: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> np.ndarray:
    """The hashes of all terms that occur in `rarest` to `commonest` of the documents, sorted.

    A first pass finds candidates. Parts leave out terms in less than REPORT * rarest of their
    documents, so a term of the lexicon has at least (1 - REPORT) * rarest of all documents in the
    reports. At most (terms of an average document) / ((1 - REPORT) * rarest) terms can have that:
    this bounds what the driver holds and sends out, however large the corpus. A second pass counts
    the candidates in all documents.
    """
    first = stored(document_frequencies(rows, None, REPORT * rarest), "terms")
    total = first.where("term IS NULL").agg(F.sum("n")).first()[0] or 0
    near = first.where(F.col("term").isNotNull() & (F.col("n") >= (1 - REPORT) * rarest * total)).select("term")
    candidates = np.sort(near.toArrow()["term"].to_numpy().astype(np.int64).view(np.uint64))
    exact = document_frequencies(rows, candidates, 0.0).where(
        F.col("term").isNotNull() & F.col("n").between(rarest * total, commonest * total)
    )
    return np.sort(exact.select("term").toArrow()["term"].to_numpy().astype(np.int64).view(np.uint64))


def fingerprints(data: np.ndarray, bounds: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """A row of bytes for each text: the number of its terms, then a 16-bit hash for each draw and level.

    A hash is of the sorted distinct terms that belong to the level's part of the lexicon; no term
    gives zero. A text without a term of the lexicon goes by all of its terms instead.
    """
    n = len(bounds) - 1
    owner, term = terms(data, bounds)
    mine = among(term, lexicon)
    bare = np.bincount(owner[mine], minlength=n) == 0
    mine |= bare[owner]
    owner, term = distinct(owner[mine], term[mine])
    size = np.bincount(owner, minlength=n)
    signs = np.zeros((n, DRAWS * LEVELS), "<u2")
    for draw in range(DRAWS):
        drawn = mixed(term ^ mixed(np.full(1, draw + 1, np.uint64)))
        # Bit by bit: the part of each level is half of the part above it.
        row, hashed = owner, mixed(drawn + M1)
        for level in range(LEVELS):
            half = drawn >> np.uint64(63 - level) & np.uint64(1) == 1
            drawn, row, hashed = drawn[half], row[half], hashed[half]
            if not len(row):
                break
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            count = np.diff(np.append(first, len(row)))
            place = (np.arange(len(row)) - np.repeat(first, count)).astype(np.uint64)
            value = mixed(np.add.reduceat(hashed * (place * np.uint64(2) + np.uint64(1)), first))
            signs[row[first], draw * LEVELS + level] = (value % np.uint64(65535)).astype("<u2") + 1
    return np.concatenate([size.astype("<u4").view(np.uint8).reshape(n, 4), signs.view(np.uint8).reshape(n, -1)], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated share of the terms of either text that both have, from two fingerprints alone.

    A part of the lexicon with a share f of the terms hashes alike if it holds none of the d terms in
    which the texts differ, with a chance of (1 - f)^d. The likeliest d follows from all parts, between
    the difference of the numbers of terms and their sum. Equal fingerprints give 1.
    """
    x, y = (np.ascontiguousarray(s[:, :4]).view("<u4").ravel().astype(np.int64) for s in (a, b))
    same = (np.ascontiguousarray(a[:, 4:]).view("<u2") == np.ascontiguousarray(b[:, 4:]).view("<u2")).reshape(len(a), DRAWS, LEVELS).sum(1)
    stay = np.log1p(-(0.5 ** np.arange(1, LEVELS + 1)))
    alike = GRID[:, None] * stay
    differ = np.log(-np.expm1(alike))
    score = same @ alike.T + (DRAWS - same) @ differ.T
    allowed = (GRID >= np.abs(x - y)[:, None]) & (GRID <= np.maximum(x + y, 1)[:, None])
    d = GRID[np.where(allowed, score, -np.inf).argmax(1)]
    d = np.where(allowed.any(1), d, np.abs(x - y))
    d = np.where((a == b).all(1), 0, d)
    return np.where(d == 0, 1.0, np.clip((x + y - d) / np.maximum(x + y + d, 1), 0.0, 1.0))


def fingerprinted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """All columns of `docs` and `fingerprint`, bytes (one of that name is replaced).

    Terms are runs of letters and digits, A-Z lower-cased; other bytes below 128 end them. Null and
    empty texts have no term and the fingerprint of none. Equal texts have equal fingerprints.
    Repeated rows stay; an empty table gives an empty one.
    """
    rows = docs.select(*[c for c in docs.columns if c != "fingerprint"])
    known = docs.sparkSession.sparkContext.broadcast(lexicon(docs.select(F.col(text).alias("text")), rarest, commonest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = fingerprints(*text_buffer(batch[text]), known.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x.tobytes() for x in found], pa.binary())], [*batch.schema.names, "fingerprint"]
            )

    return rows.mapInArrow(run, rows.withColumn("fingerprint", F.lit(None).cast("binary")).schema)


PAIRS = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited binary, near_edited double, near_next double"
PAIR_NAMES = [part.split(" ")[0] for part in PAIRS.split(", ")]


def edited(own: str, following: str) -> str:
    """`own` with its last half replaced by as much of the start of `following`."""
    half = len(own) // 2
    return own[:len(own) - half] + following[:half]


def text_column(values: list[str]) -> pa.Array:
    return pa.array([v.encode() for v in values], pa.binary()).cast(pa.string())


def pairs(ids: pa.Array, own: list[str], following: list[str], known: np.ndarray) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(own, following)]
    first, second, third = (fingerprints(*text_buffer(text_column(x)), known) for x in (own, changed, following))
    return pa.RecordBatch.from_arrays([
        ids, pa.array([len(t) for t in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).digest() for t in changed], pa.binary()),
        *(pa.array([x.tobytes() for x in f], pa.binary()) for f in (first, second)),
        pa.array(likeness(first, second)), pa.array(likeness(first, third)),
    ], PAIR_NAMES)


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited, near_edited, near_next). Documents follow each
    other by descending doc_id, null ids last, rows of one id by a hash of their text; after the last
    comes the first. The edited text is `edited(own, next)`. Null texts count as empty; repeated rows
    stay; other columns are ignored; an empty table gives an empty one.

    Texts are moved once, dealt into ranges of doc_id. A range's last document waits for the first of
    the next range: two texts a range are written aside and joined by the range's number.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(lexicon(rows))
    ordered = rows.repartitionByRange(F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with `range` null are done; others are a range's first and last document with their texts."""
        part = TaskContext.get().partitionId()
        ids, held, first = None, [], None
        for batch in slices(batches, "text"):
            new = batch["text"].to_pylist()
            if first is None:
                first = new[0]
            own = [*held, *new]
            waiting = batch["doc_id"] if ids is None else pa.concat_arrays([ids, batch["doc_id"]])
            if len(own) > 1:
                yield with_range(pairs(waiting[:-1], own[:-1], own[1:], known.value))
            ids, held = waiting[-1:], own[-1:]
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, kinds.field(c).type) if c != "doc_id" else ids for c in PAIR_NAMES),
                 pa.array([part], pa.int32()), pa.array([first]), pa.array(held)],
                schema=kinds,
            )

    kinds = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
        ("edited", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("range", pa.int32()),
        ("first", pa.string()), ("last", pa.string()),
    ])

    def with_range(batch: pa.RecordBatch) -> pa.RecordBatch:
        none = [pa.nulls(batch.num_rows, kinds.field(c).type) for c in ("range", "first", "last")]
        return pa.RecordBatch.from_arrays([*batch.columns, *none], schema=kinds)

    found = stored(ordered.mapInArrow(run, PAIRS + ", range int, first string, last string"), "compared")
    ends = found.where("range IS NOT NULL").select("range", "doc_id", "first", "last")
    # The numbers of the ranges alone come to the driver.
    order = sorted(r[0] for r in ends.select("range").collect())
    after = dict(zip(order, [*order[1:], *order[:1]]))
    following = F.create_map(*[F.lit(x) for pair in after.items() for x in pair]) if after else None
    open_ends = ends.select("doc_id", F.col("last").alias("text"), (following[F.col("range")] if after else F.col("range")).alias("range"))
    closed = open_ends.join(ends.select("range", F.col("first").alias("following")), "range")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pairs(batch["doc_id"], batch["text"].to_pylist(), batch["following"].to_pylist(), known.value)

    last = closed.select("doc_id", "text", "following").mapInArrow(close, PAIRS)
    return found.where("range IS NULL").select(*PAIR_NAMES).unionByName(last)
