"""SimHash near-duplicates: links between fingerprints found with Gray-ordered hierarchical indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import in_batches, stored, texts
from quayline.llm.components import connected_components

#: Widths of the blocks that two fingerprints are compared by, at each depth of refinement. Two
#: fingerprints with at most three differing bits agree in at least one of four blocks, and again in
#: one of four blocks of the bits that are left.
BLOCKS = ((16, 16, 16, 16), (12, 12, 12, 12), (9, 9, 9, 9))
MAX_BITS = 3
#: Groups with more fingerprints than this are split by the next depth's blocks. A group is at most
#: compared with itself, so this bounds a task's work, not the result.
GROUP = 4096
#: Gray-ordered fingerprints below one index node, and child nodes below a node.
FANOUT = 8
#: Pairs of fingerprint and node that are held at once.
FRONTIER = 1 << 20


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """`docs` (without clashing columns) and `simhash`, a 64-bit long.

    A-Z are lower-cased and the words between ASCII blanks joined by one space; every run of
    `shingle` words (all words, if fewer) is hashed by XXH64 with seed 42. A bit is one if it is set
    in over half of the hashes. No word, an empty or a null text give zero.
    """
    kept = docs.select(*[c for c in docs.columns if c != "simhash"])
    schema = kept.withColumn("simhash", F.lit(0).cast("long")).drop(text).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(raw, shingle) for raw in texts(batch[text])], np.uint64)
            names = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), pa.array(found.view(np.int64))], [*names, "simhash"]
            )

    return in_batches(kept).mapInArrow(run, schema)


def simhash(raw: bytes, shingle: int = 3) -> int:
    """The fingerprint of one text's UTF-8 bytes."""
    words = raw.lower().split()  # on bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - shingle + 1, 1)
    last = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # long texts piece by piece
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, simhash, component_id): documents whose fingerprints link at three or fewer bits, directly or by a chain.

    `component_id` is the smallest doc_id reachable; a document alone has its own. Repeated rows stay
    repeated. A null doc_id takes part in links and yields to any other id; a component of only null
    ids has a null component. Columns besides the two are ignored; an empty table gives an empty one.
    """
    prints = stored(
        fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "simhash"
    )
    # One row for each fingerprint: copies meet here, after partial aggregation, and nowhere else.
    least = stored(prints.groupBy("simhash").agg(F.min("doc_id").alias("least")), "fingerprints")
    joined = connected_components(links(least.select("simhash"), group))
    members = joined.join(least.withColumnRenamed("simhash", "node"), "node")
    named = members.groupBy("component").agg(F.min("least").alias("component_id"))
    chains = members.join(named, "component").select(F.col("node").alias("simhash"), F.col("component_id"))
    named = (
        least.join(chains, "simhash", "left")
        .select("simhash", F.coalesce("component_id", "least").alias("component_id"))
    )
    return prints.join(named, "simhash").select("doc_id", "simhash", "component_id")


def links(prints: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b): enough links between distinct fingerprints to connect all that differ in at most three bits.

    Each fingerprint goes to one group for each of its four blocks; the groups are indexed and
    searched apart. Groups that hold more than `group` fingerprints are split by the blocks of the
    bits that are left, which loses no link, since a pair has an equal block at every depth.
    """
    keyed = prints.withColumn("fixed", F.lit(0).cast("long")).withColumn("key", F.lit(0).cast("long"))
    found = None
    for depth, widths in enumerate(BLOCKS):
        keyed = stored(split(keyed, widths), "blocks")
        if depth == len(BLOCKS) - 1:
            ready = keyed
        else:
            sizes = keyed.groupBy("fixed", "key").agg(F.count("*").alias("n"))
            large = sizes.where(F.col("n") > group).select("fixed", "key")
            ready = keyed.join(large, ["fixed", "key"], "left_anti")
        part = search(ready)
        found = part if found is None else found.unionByName(part)
        if depth == len(BLOCKS) - 1 or not large.take(1):
            return found
        keyed = keyed.join(large, ["fixed", "key"], "left_semi")


def split(keyed: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """Each row once for each block: `fixed` gains the block's bits, `key` is the fingerprint's bits there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch["simhash"].to_numpy(zero_copy_only=False).view(np.uint64)
            fixed = batch["fixed"].to_numpy(zero_copy_only=False).view(np.uint64)
            for block in range(len(widths)):
                mask = free_block(fixed, widths, block) | fixed
                yield pa.RecordBatch.from_arrays(
                    [batch["simhash"], pa.array(mask.view(np.int64)), pa.array((prints & mask).view(np.int64))],
                    ["simhash", "fixed", "key"],
                )

    return keyed.mapInArrow(run, "simhash long, fixed long, key long")


def free_block(fixed: np.ndarray, widths: tuple[int, ...], block: int) -> np.ndarray:
    """The mask of the `block`-th group of bits among those that are zero in `fixed`."""
    first = sum(widths[:block])
    out, met = np.zeros_like(fixed), np.zeros(len(fixed), np.int64)
    for bit in range(64):
        one = np.uint64(1 << bit)
        free = (fixed & one) == 0
        out[free & (met >= first) & (met < first + widths[block])] |= one
        met += free
    return out


def search(keyed: DataFrame) -> DataFrame:
    """The links inside every (fixed, key) group; each group is whole in one task and at most `GROUP` rows, or a last depth's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; whole groups are indexed together, about 64 Ki rows at a time."""
        held = np.zeros((0, 3), np.uint64)
        for batch in batches:
            rows = np.stack([batch[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fixed", "key", "simhash")], 1)
            held = np.concatenate([held, rows])
            if len(held) >= 1 << 16:
                fresh = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(1)) + 1
                if len(fresh):
                    yield from linked(held[:fresh[-1]])
                    held = held[fresh[-1]:]
        yield from linked(held)

    def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows):
            a, b = group_links(rows[:, 0], rows[:, 1], rows[:, 2])
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    parts = keyed.repartition("fixed", "key").sortWithinPartitions("fixed", "key")
    return parts.mapInArrow(run, "a long, b long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """A hierarchical index over fingerprints of many groups.

    Fingerprints of a group are sorted by Gray rank, so that neighbours share most bits. Above them
    stand levels of nodes over `FANOUT` children of one group; a node holds the mask of the bits in
    which all below agree and their pattern. The top node of each group is its root.
    """

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), group))
        self.codes, self.order = codes[order], order
        owner = group[order]
        mask, pattern = np.full(len(codes), ~np.uint64(0)), self.codes
        #: Levels from the leaves up: mask, pattern, first child in the level below, number of children.
        self.levels = []
        while len(owner) and len(mask) > owner[-1] + 1:
            first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
            size = np.diff(np.append(first, len(owner)))
            inside = np.arange(len(owner)) - np.repeat(first, size)
            child = np.flatnonzero(inside % FANOUT == 0)
            differ = np.bitwise_or.reduceat(pattern ^ pattern[np.repeat(child, np.diff(np.append(child, len(owner))))], child)
            mask = np.bitwise_and.reduceat(mask, child) & ~differ
            pattern = pattern[child] & mask
            self.levels.append((mask, pattern, child, np.diff(np.append(child, len(owner)))))
            owner = owner[child]

    def neighbours(self, roots: np.ndarray, most: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (query, other > query) within `most` bits. roots: of each fingerprint, its group's number."""
        todo = [(len(self.levels), np.arange(len(self.codes)), roots)]
        while todo:
            level, query, node = todo.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                todo += [(level, query[half:], node[half:]), (level, query[:half], node[:half])]
                continue
            if level == 0:
                near = (node > query) & (np.bitwise_count(self.codes[query] ^ self.codes[node]) <= most)
                yield query[near], node[near]
                continue
            mask, pattern, child, size = self.levels[level - 1]
            # All below the node differ from the query in at least these bits: the whole group goes.
            near = np.bitwise_count((self.codes[query] & mask[node]) ^ pattern[node]) <= most
            query, node = query[near], node[near]
            n = size[node]
            first = np.repeat(child[node] - np.cumsum(n) + n, n)
            todo.append((level - 1, np.repeat(query, n), first + np.arange(n.sum())))


def group_links(fixed: np.ndarray, key: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group: each fingerprint with the first of its linked set in the group."""
    fresh = np.concatenate([[True], (fixed[1:] != fixed[:-1]) | (key[1:] != key[:-1])])
    group = np.cumsum(fresh) - 1
    index = GrayIndex(group, codes)
    label = np.arange(len(codes))
    for a, b in index.neighbours(group[index.order]):
        label = hooked(label, a, b)
    codes = index.codes
    far = label != np.arange(len(label))
    return codes[label[far]], codes[far]


def hooked(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the pairs (a, b) have been joined: the smallest place of each set."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label
